"""URL verdicts from a path-template tree for each host, and from fixed rules.  JVM only.

1. Lexical shapes: in each path segment runs of digits become ``{n}`` and long hexadecimal ids
   ``{h}``; urls are counted by (host, shape), so later steps see shapes, not urls.
2. Level by level from the host down, a node's children are generalised.  Those that statistics can't
   tell from all siblings together become the wildcard ``*``.  The others are put in families, by the
   segments that follow them (each with an eighth of a child's urls at least) and by whether their
   labelled bad rate lies above, below or within the bound of their siblings'; members that can't be
   told from their family become one wildcard that names it, as ``*(a|b)``, with ``+`` or ``-`` for rates
   above or below.  Two tests must fail to tell a child apart: the total variation distance
   between what follows it and what follows the pool, and the difference of labelled bad rates,
   each against its deviation bound for the child's counts.  What is left stays as it is.
3. A template's bad rate, shrunk to its host's, which is shrunk to the rate of all labelled urls,
   decides: at ``block_at`` or above the template is rejected.

The tree goes as deep as the paths do; a shape that no other shares its prefix with is done, since it
has no siblings further down.  Each level is made of aggregations with map-side merging on counted
shapes, and of joins each followed by an exchange or a write, so that adaptive execution can split
the rows of a hot host; levels are written to the scratch folder.

Defined results: a null url, or one without ``://``, has empty host and path and the verdict of
the template of that empty host; null labels are no labels; without any label nothing is
rejected by purity; rows with null or repeated ids are judged each; very long paths are read whole;
extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.lit(1 << 30))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*(/[^?#]*)", 1)


def shape_of(path: Column) -> Column:
    """The path's segments as lexical shapes."""
    typed = F.regexp_replace(path, r"(?<=/)(?=[0-9a-fA-F-]*[0-9])(?=[0-9a-fA-F-]*[a-fA-F])[0-9a-fA-F-]{8,}(?=/|$)", "{h}")
    segments = F.slice(F.split(F.regexp_replace(typed, "[0-9]+", "{n}"), "/"), 2, 1 << 30)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(segments)


def rule_match(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null.  rules: (verdict, host, path)."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    out = F.lit(None)
    for verdict, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _pooled(leaf: DataFrame, group: list[str], delta: float) -> DataFrame:
    """``group``, seg, n, labelled, bad, k (siblings), usual (children with an eighth of its urls), like (it can't be
    told from the pool of its group), side (of its bad rate: + or - beyond the bound, else empty)."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    node = leaf.groupBy(*group, "seg").agg(*sums)
    pool = leaf.groupBy(*group, "child").agg(F.sum("n").alias("pool_n"))
    kinds = pool.groupBy(*group).agg(F.count("*").alias("kinds"))
    totals = node.groupBy(*group).agg(F.count("*").alias("k"), *(F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "bad"))).join(kinds, group)
    both = leaf.select(*group, "seg", "child", F.col("n").alias("leaf_n")).join(node, [*group, "seg"]).join(pool.join(totals, group), [*group, "child"])
    a, b = F.col("leaf_n") / F.col("n"), F.col("pool_n") / F.col("all_n")
    usual = F.sort_array(F.collect_set(F.when(F.col("leaf_n") * 8 >= F.col("n"), F.col("child"))))
    far = both.groupBy(*group, "seg").agg(((F.sum(F.abs(a - b) - b) + 1) / 2).alias("distance"), usual.alias("usual"), *(F.first(c).alias(c) for c in ("n", "labelled", "bad", "k", "kinds", "all_labelled", "all_bad")))
    tell = math.log(2 / delta)
    like_children = F.col("distance") <= F.sqrt((F.lit(tell) + F.col("kinds") * math.log(2)) / (2 * F.col("n")))
    gap = F.coalesce(F.try_divide("bad", "labelled") - F.try_divide("all_bad", "all_labelled"), F.lit(0.0))
    bound = F.sqrt(F.lit(tell) / (2 * F.greatest(F.col("labelled"), F.lit(1))))
    side = F.when(gap > bound, "+").when(gap < -bound, "-").otherwise("")
    return far.select(*group, "seg", "n", "labelled", "bad", "k", "usual", (like_children & (side == "")).alias("like"), side.alias("side"))


def _level(t: DataFrame, depth: int, delta: float, scratch: Scratch) -> DataFrame:
    """t, whose shapes all reach ``depth`` (from 1), with ``prefix`` longer by the generalised segment there."""
    child = F.when(F.size("shape") > depth, F.element_at("shape", depth + 1)).otherwise(F.lit("$"))
    here = t.select("host", "prefix", F.element_at("shape", depth).alias("seg"), child.alias("child"), "n", "labelled", "bad")
    leaf = scratch.table(here.groupBy("host", "prefix", "seg", "child").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "bad"))), f"leaf-{depth}")
    among = scratch.table(_pooled(leaf, ["host", "prefix"], delta), f"siblings-{depth}")
    rest = among.where("k > 1 and not like").select("host", "prefix", "seg", F.concat(F.lit("("), F.array_join("usual", "|"), F.lit(")"), F.col("side")).alias("family"))
    family = _pooled(leaf.join(rest, ["host", "prefix", "seg"]), ["host", "prefix", "family"], delta).where("k > 1 and like").select("host", "prefix", "seg", F.concat(F.lit("*"), F.col("family")).alias("wild"))
    named = among.where("k > 1 and like").select("host", "prefix", "seg", F.lit("*").alias("wild")).unionByName(family)
    at = t.withColumn("seg", F.element_at("shape", depth)).join(named, ["host", "prefix", "seg"], "left")
    out = scratch.table(at.select("host", "shape", F.concat("prefix", F.lit("/"), F.coalesce("wild", "seg")).alias("prefix"), "n", "labelled", "bad"), f"level-{depth}")
    scratch.drop(leaf, among)
    return out


def _tree(t: DataFrame, scratch: Scratch, delta: float) -> DataFrame:
    """host, shape, prefix (the whole template), n, labelled, bad of counted shapes."""
    done, depth = [], 0
    while True:
        # A shape is done at its end, or where no other shape has its prefix.
        many = t.where(F.size("shape") > depth).groupBy("host", "prefix").agg(F.count("*").alias("shapes")).where("shapes > 1").select("host", "prefix", F.lit(True).alias("many"))
        told = scratch.table(t.join(many, ["host", "prefix"], "left").withColumn("open", F.coalesce("many", F.lit(False)) & (F.size("shape") > depth)).drop("many"), f"open-{depth}")
        scratch.drop(t)
        below = F.array_join(F.transform(F.slice("shape", depth + 1, 1 << 30), lambda x: F.concat(F.lit("/"), x)), "")
        done.append(told.where("not open").select("host", "shape", F.concat("prefix", below).alias("prefix"), "n", "labelled", "bad"))
        if told.where("open").isEmpty():
            return functools.reduce(DataFrame.unionByName, done)
        depth += 1
        t = _level(told.where("open").drop("open"), depth, delta, scratch)


def templates(urls: DataFrame, scratch: Scratch, delta: float = 0.05, host_weight: float = 10.0, template_weight: float = 10.0, block_at: float = 0.5) -> DataFrame:
    """host, shape, template, n, labelled, bad, bad_rate, verdict for every (host, shape) of ``urls``
    (host, shape, bad: 1, 0 or null)."""
    t = urls.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    t = scratch.table(_tree(scratch.table(t.withColumn("prefix", F.lit("")), "shapes"), scratch, delta), "templates")
    of = t.groupBy("host", "prefix").agg(F.sum("labelled").alias("t_labelled"), F.sum("bad").alias("t_bad"))
    hosts = t.groupBy("host").agg(F.sum("labelled").alias("h_labelled"), F.sum("bad").alias("h_bad"))
    total = t.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    prior = ((total.bad or 0) + 0.5) / ((total.labelled or 0) + 2.0)
    host_rate = (F.col("h_bad") + host_weight * prior) / (F.col("h_labelled") + host_weight)
    rate = (F.col("t_bad") + template_weight * host_rate) / (F.col("t_labelled") + template_weight)
    rates = of.join(hosts, "host").select("host", "prefix", rate.alias("bad_rate"))
    return t.join(rates, ["host", "prefix"]).select("host", "shape", F.col("prefix").alias("template"), "n", "labelled", "bad", "bad_rate", F.when(F.col("bad_rate") >= block_at, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, scratch: Scratch, rules: list[tuple[str, str, str]] = (), labelled: DataFrame | None = None, **parameters) -> DataFrame:
    """Every row's page_id, host, path, rule, verdict, template and bad_rate.

    ``pages`` has page_id and url; ``labelled`` has url and bad (1 or 0) and may hold other urls.
    """
    parsed = pages.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path")).withColumn("shape", shape_of(F.col("path")))
    seen = parsed.select("host", "shape", F.lit(None).cast("int").alias("bad"))
    if labelled is not None:
        told = labelled.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"), F.col("bad").cast("int").alias("bad"))
        seen = seen.unionByName(told.select("host", shape_of(F.col("path")).alias("shape"), "bad"))
    tree = templates(seen, scratch, **parameters).select("host", "shape", "template", "bad_rate", F.col("verdict").alias("learned"))
    ruled = rule_match(F.col("host"), F.col("path"), list(rules)) if rules else F.lit(None).cast("struct<rule:string,verdict:string>")
    return parsed.join(tree, ["host", "shape"], "left").select("page_id", "host", "path", "template", "bad_rate", "learned", ruled.alias("r")).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", "learned").alias("verdict"), "template", "bad_rate")
