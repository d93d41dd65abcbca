"""Recursion over graphs: cycles, dependency order, closures, owner chains, links and trees.

Edges are (src, dst).  No answer depends on a bound on hops.  Graphs of up to ``LOCAL_EDGES`` edges, counted
first, are solved on the driver in linear time, since a dependency chain of a thousand projects would
take a thousand rounds of joins; larger ones advance frontiers or labels by a join a round, over
nodes and never over pairs of nodes.  Owner chains double their pointers: log(depth) joins.
"""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType
from pyspark.sql.window import Window as W

#: Graphs with so many different edges at most are brought to the driver (some 20 MB).
LOCAL_EDGES = 200_000


def _cut(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in ``spark.checkpoint.dir``, so a later round's plan does not hold the earlier
    ones.  Only in local mode may that folder be unset; then one is made."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="strata-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def _local(edges: DataFrame) -> list[tuple] | None:
    """The different edges, if they are few."""
    some = edges.select("src", "dst").distinct().limit(LOCAL_EDGES + 1).collect()
    return [tuple(r) for r in some] if len(some) <= LOCAL_EDGES else None


def _table(edges: DataFrame, rows: list[tuple], *more: StructField) -> DataFrame:
    return edges.sparkSession.createDataFrame(rows, StructType([StructField("node", edges.schema["src"].dataType), *more]))


def _loops(edges: list[tuple]) -> dict:
    """node -> a number for each strongly connected set that holds a cycle (Tarjan, without recursion)."""
    ahead: dict = {}
    for a, b in edges:
        ahead.setdefault(a, []).append(b)
        ahead.setdefault(b, [])
    low, order, stack, held, out = {}, {}, [], set(), {}
    for start in ahead:
        if start in order:
            continue
        work = [(start, iter(ahead[start]))]
        order[start] = low[start] = len(order)
        stack.append(start)
        held.add(start)
        while work:
            node, rest = work[-1]
            for after in rest:
                if after not in order:
                    order[after] = low[after] = len(order)
                    stack.append(after)
                    held.add(after)
                    work.append((after, iter(ahead[after])))
                    break
                if after in held:
                    low[node] = min(low[node], order[after])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    members = []
                    while not members or members[-1] != node:
                        members.append(stack.pop())
                        held.discard(members[-1])
                    if len(members) > 1 or node in ahead[node]:
                        out.update(dict.fromkeys(members, order[node]))
    return out


def _spread(start: DataFrame, step: DataFrame) -> DataFrame:
    """All nodes that ``start`` (node) reaches along ``step`` (node, next), itself included, by a join a round."""
    found = front = _cut(start.select("node").distinct())
    while not front.isEmpty():
        front = _cut(front.join(step, "node").select(F.col("next").alias("node")).distinct().join(found, "node", "left_anti"))
        found = _cut(found.unionByName(front))
    return found


def strong_components(edges: DataFrame) -> DataFrame:
    """node, loop: of nodes on cycles, with one value of ``loop`` for nodes that reach each other.

    Beyond ``LOCAL_EDGES``: each node takes the greatest node that reaches it; of those that kept
    their own, what they reach backwards in their colour is a component.  It leaves, and so on.
    """
    if (few := _local(edges)) is not None:
        return _table(edges, list(_loops(few).items()), StructField("loop", IntegerType())).withColumn("loop", F.col("loop").cast("string"))
    live, found = _cut(edges.select("src", "dst").distinct()), []
    alone = live.where("src = dst").select(F.col("src").alias("node"), F.col("src").cast("string").alias("loop"))
    live = _cut(live.where("src <> dst"))
    while True:
        while True:  # what nothing leads to, or what leads nowhere, is on no cycle
            kept = _cut(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            same, live = kept.count() == live.count(), kept
            if same:
                break
        if live.isEmpty():
            break
        colour = _cut(live.select(F.col("src").alias("node")).unionByName(live.select(F.col("dst").alias("node"))).distinct().withColumn("colour", F.col("node")))
        moved = True
        while moved:
            sent = live.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("sent"))
            after = _cut(colour.join(sent, "node", "left").select("node", "colour", F.greatest("colour", "sent").alias("now")))
            moved = not after.where("now <> colour").isEmpty()
            colour = after.select("node", F.col("now").alias("colour"))
        inside = live.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("c1 = c2")
        part = _cut(_spread(colour.where("node = colour"), _cut(inside.select(F.col("dst").alias("node"), F.col("src").alias("next")))).join(colour, "node"))
        found.append(part)
        live = _cut(live.join(part.select(F.col("node").alias("src")), "src", "left_anti").join(part.select(F.col("node").alias("dst")), "dst", "left_anti"))
    parts = [p.join(p.groupBy("colour").count().where("count > 1").select("colour"), "colour", "left_semi").select("node", F.col("colour").cast("string").alias("loop")) for p in found]
    whole = functools.reduce(DataFrame.unionByName, parts, alone.limit(0))
    return whole.unionByName(alone.join(whole.select("node"), "node", "left_anti"))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves."""
    return strong_components(edges).select("node")


def acyclic_edges(edges: DataFrame) -> DataFrame:
    """G1: edges with ``cyclic``, true where the edge lies on a cycle (its end reaches its start)."""
    loops = strong_components(edges)
    ends = edges.join(loops.select(F.col("node").alias("src"), F.col("loop").alias("_from")), "src", "left").join(loops.select(F.col("node").alias("dst"), F.col("loop").alias("_to")), "dst", "left")
    return ends.withColumn("cyclic", F.coalesce(F.col("_from") == F.col("_to"), F.lit(False))).select("src", "dst", *(c for c in edges.columns if c not in ("src", "dst")), "cyclic")


def incomplete_closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (node, incomplete) with incompleteness carried to all that depend on them (src on dst): a
    frontier moves from the incomplete ones only."""
    bad = nodes.where("incomplete").select("node")
    if (few := _local(edges)) is not None:
        behind: dict = {}
        for a, b in few:
            behind.setdefault(b, []).append(a)
        front = [r.node for r in bad.join(edges.select(F.col("dst").alias("node")), "node", "left_semi").distinct().collect()]  # no more than there are edges
        seen = set(front)
        while front:
            for before in behind.get(front.pop(), ()):
                if before not in seen:
                    seen.add(before)
                    front.append(before)
        reached = _table(edges, [(n,) for n in seen])
    else:
        reached = _spread(bad, _cut(edges.select(F.col("dst").alias("node"), F.col("src").alias("next")).distinct()))
    via = reached.withColumn("via", F.lit(True))
    return nodes.join(via, "node", "left").select("node", (F.col("incomplete") | F.coalesce("via", F.lit(False))).alias("incomplete"))


def owner_chain(items: DataFrame) -> DataFrame:
    """Items (id, parent, ok) with root, depth and complete: whether every owner up to a root (no
    parent) is there and ok.  Above a cycle there is no root and no depth.

    Each round joins an item's pointer to the pointer there, so a chain of n owners takes log2(n) rounds;
    what still moves after as many rounds as any chain could take runs in a cycle.
    """
    now = _cut(items.select("id", F.col("id").alias("at"), F.lit(0).cast("long").alias("depth"), F.coalesce("ok", F.lit(False)).alias("ok"), F.col("parent").alias("next")))
    rounds, done = int(now.count()).bit_length() + 1, []
    for _ in range(rounds):
        there = now.select(F.col("id").alias("next"), F.col("at").alias("at2"), F.col("depth").alias("depth2"), F.col("ok").alias("ok2"), F.col("next").alias("next2"), F.lit(True).alias("found"))
        moved = now.join(there, "next", "left")
        now = _cut(
            moved.select(
                "id",
                F.when(F.col("found"), F.col("at2")).otherwise(F.col("at")).alias("at"),
                F.when(F.col("found"), F.col("depth") + 1 + F.col("depth2")).otherwise(F.col("depth")).alias("depth"),
                F.when(F.col("found"), F.col("ok") & F.col("ok2")).otherwise(F.col("ok")).alias("ok"),
                F.when(F.col("found"), F.col("next2")).otherwise(F.col("next")).alias("next"),
                F.coalesce("found", F.lit(False)).alias("moved"),
            )
        )
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved")
    moving = F.col("moved") if "moved" in now.columns else F.lit(True) & F.col("next").isNotNull()
    ended = now.withColumn("looped", moving & F.col("next").isNotNull())
    return ended.select("id", F.when(F.col("next").isNull(), F.col("at")).alias("root"), F.when(~F.col("looped"), F.col("depth")).cast("int").alias("depth"), (F.col("next").isNull() & F.col("ok")).alias("complete"))


def resolve_links(links: DataFrame, nodes: DataFrame, max_hops: int = 40) -> DataFrame:
    """Links (path, target) followed to a node (path, kind) that is no link: path, final, hops, status
    (resolved, missing or cycle).  All links advance by a join a round and leave where they end, so
    neither their number nor a limit on the rows of recursive queries bounds the result."""
    step = _cut(links.select(F.col("path").alias("at"), F.col("target").alias("next")))
    front, ended = links.select("path", F.col("target").alias("at"), F.lit(1).alias("hops")), []
    for hops in range(1, max_hops + 1):
        if hops == max_hops:
            ended.append(front)
            break
        on = _cut(front.join(step.withColumn("more", F.lit(True)), "at", "left"))
        ended.append(on.where("more is null").select("path", "at", "hops"))
        front = on.where("more").select("path", F.col("next").alias("at"), F.lit(hops + 1).alias("hops"))
        if front.isEmpty():
            break
    walked = functools.reduce(DataFrame.unionByName, ended).groupBy("path").agg(F.max_by("at", "hops").alias("final"), F.max("hops").alias("hops"))
    real = nodes.where("kind <> 'link'").select(F.col("path").alias("final"), F.lit(True).alias("real"))
    status = F.when(F.col("real"), "resolved").when(F.col("hops") >= max_hops, "cycle").otherwise("missing")
    return walked.join(real, "final", "left").select("path", "final", "hops", status.alias("status"))


def descendants_flag(nodes: DataFrame, flag: str) -> DataFrame:
    """Nodes (id, parent, flag) with ``in_tree``: whether the flag holds anywhere at or below."""
    up = nodes.where("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    held = incomplete_closure(nodes.select(F.col("id").alias("node"), F.coalesce(flag, F.lit(False)).alias("incomplete")), up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return nodes.join(held.select(F.col("node").alias("id"), F.col("incomplete").alias("in_tree")), "id", "left")


def element_tree(records: DataFrame, group: list[str], ord: str, kind: str, start: str = "start", end: str = "end") -> DataFrame:
    """Of a well nested run of start and end records, each start's parent (its ord), depth and number
    of direct children.  Depth is a running sum; the parent is the last start one level up."""
    w = W.partitionBy(*group).orderBy(ord)
    step = F.when(F.col(kind) == start, 1).when(F.col(kind) == end, -1).otherwise(0)
    deep = records.withColumn("depth", F.sum(step).over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).where(F.col(kind) == start)
    starts = deep.select(*group, F.col(ord).alias("p_ord"), (F.col("depth") + 1).alias("depth"))
    # The last start one level up, found by a window over both levels together.
    marked = deep.select(*group, F.col(ord).alias("o"), "depth", F.lit(None).cast("long").alias("cand"), F.lit(1).alias("own")).unionByName(starts.select(*group, F.col("p_ord").alias("o"), "depth", F.col("p_ord").cast("long").alias("cand"), F.lit(0).alias("own")))
    by = W.partitionBy(*group, "depth").orderBy("o").rowsBetween(W.unboundedPreceding, -1)
    own = marked.withColumn("parent", F.last("cand", ignorenulls=True).over(by)).where("own = 1").select(*group, F.col("o").alias(ord), "depth", "parent")
    kids = own.where("parent is not null").groupBy(*group, F.col("parent").alias(ord)).agg(F.count("*").alias("children"))
    return own.join(kids, [*group, ord], "left").withColumn("children", F.coalesce("children", F.lit(0)).cast("long"))


def dependency_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: the order in which nodes can be built: layer 0 depends on nothing, a node lies one above the
    highest it depends on; nodes on cycles have no layer, and edges on cycles don't count."""
    if (few := _local(edges)) is not None:
        loops, left, users, level = _loops(few), {}, {}, {}
        for a, b in few:
            if a != b and (a not in loops or loops.get(b) != loops[a]):
                left[a] = left.get(a, 0) + 1
                users.setdefault(b, []).append(a)
        ready = [n for n in {x for e in few for x in e} if n not in left]
        while ready:
            node = ready.pop()
            for user in users.get(node, ()):
                level[user] = max(level.get(user, 0), level.get(node, 0) + 1)
                left[user] -= 1
                if not left[user]:
                    ready.append(user)
        ranks = _table(edges, [(n, level.get(n, 0), n in loops) for n in {x for e in few for x in e}], StructField("layer", IntegerType()), StructField("loop", BooleanType()))
    else:
        free = _cut(acyclic_edges(edges.select("src", "dst").distinct()).where("not cyclic").select("src", "dst"))
        ranks, moved = nodes.select("node").distinct().withColumn("layer", F.lit(0)), True
        while moved:  # as many rounds as there are layers
            above = free.join(ranks.select(F.col("node").alias("dst"), "layer"), "dst").groupBy(F.col("src").alias("node")).agg((F.max("layer") + 1).alias("up"))
            after = _cut(ranks.join(above, "node", "left").select("node", "layer", F.greatest("layer", F.coalesce("up", F.lit(0))).alias("now")))
            moved = not after.where("now > layer").isEmpty()
            ranks = after.select("node", F.col("now").alias("layer"))
        ranks = ranks.join(cyclic_nodes(edges).withColumn("loop", F.lit(True)), "node", "left")
    known = nodes.select("node").distinct().join(ranks, "node", "left")
    return known.select("node", F.when(~F.coalesce("loop", F.lit(False)), F.coalesce("layer", F.lit(0))).cast("int").alias("layer"))


def union_all(*tables: DataFrame) -> DataFrame:
    """Rows of all tables by column name; columns that a table lacks are null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
