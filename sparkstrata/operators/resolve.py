"""Joins that pick a target: nearest candidates, ancestors, owners, intervals and statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, directory, directory_segments
from ..functions.text import fold


def _prefixes(path: Column) -> Column:
    """Folded directories above a path with their depth: array of struct(depth, prefix), the root first."""
    parts = F.transform(directory_segments(path), fold)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.when(k > 0, F.slice(parts, 1, F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<string>")), "/").alias("prefix")))


def nearest_candidate(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Which file each reference means.

    refs: source, kind (pe-import or assembly-reference), name, ord.
    files: id, file_name, assembly_name, relative_path, origin(kind, container, entry, depth).

    One candidate by name is taken.  Of several those in the source's own archive are preferred, then
    those that share most leading directories with it, then those in its very directory; anything
    but one survivor leaves the reference unresolved, its target the raw name.

    References never meet their candidates one by one: a name that a third of all files bear would give
    the square of them.  Candidates are counted under every directory above them, by name and scope (the
    package, or one archive), merged before the shuffle; a reference looks up the directories above
    its own, and the deepest that holds a candidate decides.
    Returns source, kind, target, resolved, the first of edges equal without case.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    box = lambda o: F.when(~blank(F.col(f"{o}.container")), F.concat(F.coalesce(fold(F.col(f"{o}.kind")), F.lit("")), F.lit("\x00"), fold(F.col(f"{o}.container"))))
    inner = F.when(blank(F.col("origin.entry")), F.col("relative_path")).otherwise(F.col("origin.entry"))
    scopes = F.filter(F.array(F.struct(F.lit("").alias("scope"), F.col("relative_path").alias("at")), F.when(box("origin").isNotNull(), F.struct(box("origin").alias("scope"), inner.alias("at")))), lambda x: x.isNotNull())
    named = F.inline(F.array(
        F.struct(F.lit("pe-import").alias("kind"), fold(F.col("file_name")).alias("key")),
        F.struct(F.lit("assembly-reference").alias("kind"), F.when(F.trim("assembly_name") != "", fold(F.col("assembly_name"))).alias("key")),
    ))
    build = files.select("id", F.explode(scopes).alias("s"), "file_name", "assembly_name").select("id", "s.scope", "s.at", named).where("key is not null")
    under = build.select("kind", "key", "scope", "id", F.size(directory_segments(F.col("at"))).alias("deep"), F.explode(_prefixes(F.col("at"))).alias("p"))
    held = under.groupBy("kind", "key", "scope", "p.prefix").agg(
        F.count("*").alias("n"),
        F.min("id").alias("id"),
        F.count_if(F.col("deep") == F.col("p.depth")).alias("n_here"),
        F.min(F.when(F.col("deep") == F.col("p.depth"), F.col("id"))).alias("id_here"),
    )
    here = files.select(F.col("id").alias("source"), F.explode(scopes).alias("s")).select("source", "s.scope", F.size(directory_segments(F.col("s.at"))).alias("own_depth"), _prefixes(F.col("s.at")).alias("ps"))
    none = F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("prefix")))
    looked = refs.withColumn("key", fold(F.col("name"))).join(here, "source", "left").select("source", "kind", "name", "ord", "key", F.coalesce("scope", F.lit("")).alias("scope"), F.coalesce("own_depth", F.lit(0)).alias("own_depth"), F.explode(F.coalesce("ps", none)).alias("p"))
    found = looked.select("*", "p.depth", "p.prefix").drop("p").join(held, ["kind", "key", "scope", "prefix"], "left")
    # A scope's root says how many candidates it has; its deepest directory with any decides.
    best = found.groupBy("source", "kind", "name", "ord", "scope", "own_depth").agg(
        F.max(F.when(F.col("depth") == 0, F.coalesce("n", F.lit(0)))).alias("total"),
        F.max(F.when(F.col("n") > 0, F.struct("depth", "n", "id", "n_here", "id_here"))).alias("b"),
    )
    exact = (F.col("b.depth") == F.col("own_depth")) & (F.col("b.n_here") == 1)
    chosen = F.when(F.col("b.n") == 1, F.col("b.id")).when(exact, F.col("b.id_here"))
    row = F.struct(chosen.alias("id"))
    picked = best.groupBy("source", "kind", "name", "ord").agg(
        F.max(F.when(F.col("scope") == "", F.col("total"))).alias("total"),
        F.max(F.when(F.col("scope") == "", F.struct(F.col("b.n").alias("n"), F.col("b.id").alias("any"), row.alias("r")))).alias("wide"),
        F.max(F.when((F.col("scope") != "") & (F.col("total") > 0), F.struct(F.col("b.n").alias("n"), row.alias("r")))).alias("near"),
    )
    target = F.when(F.col("total") <= 1, F.col("wide.any")).when(F.col("near").isNotNull(), F.col("near.r.id")).otherwise(F.col("wide.r.id"))
    edges = picked.withColumn("c_id", target).select("source", "kind", "ord", F.coalesce("c_id", "name").alias("target"), F.col("c_id").isNotNull().alias("resolved"))
    first = edges.groupBy(fold(F.col("source")).alias("s"), "kind", fold(F.col("target")).alias("t")).agg(F.min(F.struct("ord", "source", "target", "resolved")).alias("e"))
    return first.select("e.source", "kind", "e.target", "e.resolved")


def reference_status(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """What a path reference means.

    refs: source, path (null where it can't be worked out), conditional; targets: path, retained.
    Conditional overrides all; a path that is not literal is unevaluated; then the match without case is
    looked up: the exact spelling or a single match is resolved, one beyond the retained rows
    unevaluated, several ambiguous, none missing.
    """
    t = targets.select(F.col("path").alias("t_path"), "retained", fold(F.col("path")).alias("key"))
    found = refs.withColumn("key", fold(F.col("path"))).join(t, "key", "left")
    per = found.groupBy("source", "path", "conditional").agg(
        F.count("t_path").alias("n"),
        F.max(F.when(F.col("t_path") == F.col("path"), F.struct("t_path", "retained"))).alias("exact"),
        F.max(F.struct("t_path", "retained")).alias("any"),
    )
    chosen = F.when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("n") == 1, F.col("any"))
    status = F.when(F.col("conditional"), "conditional").when(F.col("path").isNull(), "unevaluated").when(F.col("n") == 0, "missing").when(chosen.isNull(), "ambiguous").when(~chosen["retained"], "unevaluated").otherwise("resolved")
    return per.select("source", "path", status.alias("status"), F.when(status == "resolved", chosen["t_path"]).alias("target"))


def package_versions(refs: DataFrame, central: DataFrame) -> DataFrame:
    """The version of each package reference (source, package), from declarations (package, version,
    literal, conditional): a single literal one is resolved, any conditional makes it conditional,
    anything else unevaluated, none external.  Declarations are merged by package before the join."""
    key = fold(F.col("package"))
    per = central.groupBy(key.alias("key")).agg(F.count("version").alias("n"), F.bool_or("conditional").alias("cond"), F.bool_and("literal").alias("lit"), F.max("version").alias("v"))
    named = refs.groupBy("source", "package").agg(F.count("*").alias("times")).withColumn("key", key).join(per, "key", "left")
    per = named.select("source", "package", (F.col("times") * F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("cond", F.lit(False)).alias("cond"), F.coalesce("lit", F.lit(False)).alias("lit"), "v")
    status = F.when(F.col("n") == 0, "external").when(F.col("cond"), "conditional").when((F.col("n") == 1) & F.col("lit"), "resolved").otherwise("unevaluated")
    return per.select("source", "package", F.when(status == "resolved", F.col("v")).alias("version"), status.alias("status"))


def nearest_ancestor(items: DataFrame, shared: DataFrame, name: str, floor: Column | None = None) -> DataFrame:
    """Of each item (id, path) the nearest directory above that holds exactly one file (path) of
    the given name.  Ancestors are exploded (as many rows as the path is deep) and joined by equality.
    ``floor``: a directory that the search must not leave."""
    levels = items.select("id", F.posexplode(ancestors(F.col("path"))).alias("up", "dir"), *([floor.alias("floor")] if floor is not None else []))
    if floor is not None:
        levels = levels.where(F.col("floor").isNull() | (F.col("floor") == "") | (fold(F.col("dir")) == fold(F.col("floor"))) | fold(F.col("dir")).startswith(F.concat(fold(F.col("floor")), F.lit("/"))))
    at = shared.where(fold(F.element_at(F.split("path", "/"), -1)) == name.upper()).select(fold(directory(F.col("path"))).alias("key"), F.col("path").alias("file"))
    single = at.groupBy("key").agg(F.count("*").alias("n"), F.max("file").alias("file")).where("n = 1")
    return levels.withColumn("key", fold(F.col("dir"))).join(single, "key").groupBy("id").agg(F.min_by("file", "up").alias("file"), F.min("up").alias("levels_up"))


def longest_prefix_owner(files: DataFrame, owners: DataFrame, planned: str = "planned") -> DataFrame:
    """The owner (dir, owner, planned) of the longest directory above each file (path); files whose
    nearest owner is not planned have none."""
    levels = files.select("path", F.explode(ancestors(F.col("path"))).alias("dir"))
    own = owners.select(fold(F.col("dir")).alias("key"), "owner", F.col(planned).alias("planned"))
    return levels.withColumn("key", fold(F.col("dir"))).join(own, "key").groupBy("path").agg(F.max(F.struct(F.length("key").alias("n"), "owner", "planned")).alias("m")).where("m.planned").select("path", "m.owner")


def exact_include(includes: DataFrame, files: DataFrame, suffix: str) -> DataFrame:
    """Includes (owner, path) that match exactly one file of the given suffix."""
    f = files.where(fold(F.col("path")).endswith(suffix.upper())).select(fold(F.col("path")).alias("key"), F.col("path").alias("file"))
    return includes.withColumn("key", fold(F.col("path"))).join(f, "key").groupBy("owner", "path").agg(F.count("*").alias("n"), F.max("file").alias("file")).where("n = 1").select("owner", "file")


def interval_lookup(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, low: str = "low", high: str = "high", width: int | None = None) -> DataFrame:
    """Intervals [low, high) that hold each point, equal in ``keys``.

    With ``width`` intervals are spread over bins of that many units and the join is one of
    equality on keys and bin, so a key with many intervals is not compared all against all.
    """
    inside = (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    if width is None:
        return points.join(intervals, keys).where(inside)
    bins = F.sequence(F.floor(F.col(low) / width), F.greatest(F.floor((F.col(high) - 1) / width), F.floor(F.col(low) / width)))
    return points.withColumn("_bin", F.floor(F.col(point) / width)).join(intervals.where(F.col(low) < F.col(high)).withColumn("_bin", F.explode(bins)), [*keys, "_bin"]).where(inside).drop("_bin")


def nested_owner(types: DataFrame) -> DataFrame:
    """The owner of each nested type (token, declaring_token, generics): the one type with that
    token, if the child is the only one of its own token and its leading generics are the owner's."""
    single = types.groupBy("token").agg(F.count("*").alias("n"), F.max("generics").alias("generics")).where("n = 1")
    owner = single.select(F.col("token").alias("declaring_token"), F.col("generics").alias("owner_generics"))
    kids = types.join(single.select("token"), "token").where("declaring_token is not null and declaring_token <> token")
    return kids.join(owner, "declaring_token").where(F.slice("generics", 1, F.greatest(F.size("owner_generics"), F.lit(1))) == F.when(F.size("owner_generics") > 0, F.col("owner_generics")).otherwise(F.slice("generics", 1, 1))).select("token", "declaring_token")


def complete_endpoints(components: DataFrame, edges: DataFrame, kind: str = "package-file") -> DataFrame:
    """The components (id, kind) and one more for every resolved target (target) that has none."""
    missing = edges.where("resolved").select(F.col("target").alias("id")).distinct().join(components.select("id"), "id", "left_anti")
    return components.select("id", "kind").unionByName(missing.withColumn("kind", F.lit(kind)))


def call_status(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """Calls (id, source_project, symbol) with target_project and status by the declarations (symbol,
    project) of their symbol: one project resolves, several are ambiguous, none is external; a call
    without a symbol is unresolved.  Declarations are merged by symbol before the join."""
    per = declarations.groupBy("symbol").agg(F.count_distinct("project").alias("projects"), F.min("project").alias("project"))
    status = F.when(F.col("symbol").isNull(), "unresolved").when(F.col("projects").isNull(), "external").when(F.col("projects") > 1, "ambiguous").otherwise("resolved-source")
    return calls.join(per, "symbol", "left").select("id", "source_project", "symbol", F.when(status == "resolved-source", F.col("project")).alias("target_project"), status.alias("status"))


def project_dependencies(references: DataFrame, planned: DataFrame) -> DataFrame:
    """Resolved project references (source, target, kind, status) whose target is planned (project), once each."""
    return references.where("status = 'resolved' and kind = 'project-reference'").join(planned.select(F.col("project").alias("target")), "target", "left_semi").select("source", "target").distinct()


def field_names(fields: DataFrame, events: DataFrame) -> DataFrame:
    """Fields (type, name) that are not generated, not an enumeration's value and not also an event's."""
    plain = fields.where(~F.contains("name", F.lit("<")) & ~F.contains("name", F.lit(">")) & (F.col("name") != "value__"))
    return plain.join(events.select("type", "name"), ["type", "name"], "left_anti")
