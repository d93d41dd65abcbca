"""Queries of the engine's own operators over the driver's tables, with their SQL twins.

The driver's tables hold no packages, so each query is an analogue: the operator's semantics on
columns that have the shape it needs.  ``parts_as_files`` lays parts out as a tree of files:
type and brand are directories, the name is the file, and names repeat, as libraries do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .functions import paths, structure, text
from .operators import classify, detect, graph, ordering, resolve, summary, validate
from .plans import skeletons
from .sources import deferred, files, native, resources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    path = F.concat_ws("/", "p_type", "p_brand", F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string")))
    origin = F.struct(F.lit("direct").alias("kind"), F.lit(None).cast("string").alias("container"), F.lit(None).cast("string").alias("entry"), F.lit(0).alias("depth"))
    return p.select("p_partkey", path.alias("id"), F.col("p_name").alias("file_name"), F.lit(None).cast("string").alias("assembly_name"), path.alias("relative_path"), origin.alias("origin"))


def part_references(files: DataFrame, n: int) -> DataFrame:
    """Part i refers to the name of part (7 i + 1) mod n."""
    wanted = files.select(((F.col("p_partkey") * 7 + 1) % n).alias("k"), F.col("id").alias("source"), F.col("p_partkey").alias("ord"))
    names = files.select((F.col("p_partkey") % n).alias("k"), F.col("file_name").alias("name"))
    return wanted.join(names, "k").select("source", F.lit("pe-import").alias("kind"), "name", "ord")


NEAREST_SQL = """
with n as (select count(*) as n from part),
f as (select p_partkey, p_type || '/' || p_brand || '/' || p_name || '_' || p_partkey as id, upper(p_name) as name, p_name, upper(p_type) as d1, upper(p_brand) as d2 from part),
r as (select a.p_partkey as ord, a.id as source, a.d1, a.d2, b.p_name as name from f a, n, f b where b.p_partkey % n.n = (a.p_partkey * 7 + 1) % n.n),
c as (select r.ord, r.source, r.name, f.id as target,
        case when r.d1 = f.d1 and r.d2 = f.d2 then 2 when r.d1 = f.d1 then 1 else 0 end as shared,
        count(f.id) over (partition by r.ord) as n
      from r left join f on f.name = upper(r.name)),
m as (select *, max(shared) over (partition by ord) as most from c),
k as (select *, count(*) over (partition by ord) as tied from m where n <= 1 or shared = most),
p as (select ord, any_value(source) as source, any_value(name) as name,
        count(case when n <= 1 or tied = 1 or shared = 2 then target end) as survivors,
        max(case when n <= 1 or tied = 1 or shared = 2 then target end) as target
      from k group by ord)
select source, 'pe-import' as kind, case when survivors = 1 then target else name end as target, survivors = 1 as resolved from p
"""


@query(NEAREST_SQL)
def nearest_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that each reference means, or its raw name."""
    files = parts_as_files(spark, sf_dir)
    n = read(spark, sf_dir, "part").count()
    return resolve.nearest_candidate(part_references(files, n), files)


@query(f"select source, target from ({NEAREST_SQL}) where not resolved")
def nearest_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unresolved slice."""
    return nearest_candidate(spark, sf_dir).where("not resolved").select("source", "target")


@query("select doc_id, sha256(text) as sha256, cast(strlen(text) as bigint) as bytes from documents")
def file_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and size of each content."""
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query("""
with p as (select p_partkey, case p_partkey % 14 when 0 then '.jar' when 1 then '.zip' when 2 then '.7z' when 3 then '.pdb' when 4 then '.sqlite' when 5 then '.json' when 6 then '.csproj' when 7 then '.cs' when 8 then '.png' when 9 then '.py' when 10 then '' when 11 then '.qqq' when 12 then '.MSI' else '.dll' end as ext,
  case when p_partkey % 5 = 0 then 'zip' when p_partkey % 5 = 1 then 'sqlite' when p_partkey % 5 = 2 then 'ole' else '' end as head from part)
select p_partkey,
  case when head = 'zip' then 'archive' when ext in ('.jar', '.zip', '.7z') then 'archive' when ext = '.MSI' and head = 'ole' then 'archive' when ext = '.pdb' then 'debug-symbol'
    when ext = '.sqlite' or head = 'sqlite' then 'database' when ext = '.json' then 'configuration' when ext = '.csproj' then 'project' when ext = '.cs' then 'source-code'
    when ext = '.png' then 'resource' when ext = '.py' then 'script' else 'unknown' end as category,
  case when head = 'zip' then case when ext = '.jar' then 'Java archive' else 'ZIP archive' end when ext in ('.jar', '.zip', '.7z') then upper(substr(ext, 2)) || ' archive'
    when ext = '.MSI' and head = 'ole' then 'Windows Installer package' when ext = '.pdb' then 'Program Database' when ext = '.sqlite' or head = 'sqlite' then 'SQLite/database file'
    when ext = '.json' then 'JSON configuration' when ext = '.csproj' then 'CSPROJ project' when ext = '.cs' then 'CS source' when ext = '.png' then 'PNG resource' when ext = '.py' then 'PY script'
    when ext = '' then 'Unknown' else upper(substr(ext, 2)) end as format
from p
""")
def classify_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files whose extension and leading bytes follow from their number."""
    p = read(spark, sf_dir, "part")
    ext = F.element_at(F.array(*(F.lit(e) for e in (".jar", ".zip", ".7z", ".pdb", ".sqlite", ".json", ".csproj", ".cs", ".png", ".py", "", ".qqq", ".MSI", ".dll"))), (F.col("p_partkey") % 14 + 1).cast("int"))
    k = F.col("p_partkey") % 5
    head = F.when(k == 0, F.lit(bytearray(b"PK\x03\x04"))).when(k == 1, F.lit(bytearray(b"SQLite format 3\0"))).when(k == 2, F.lit(bytearray.fromhex("D0CF11E0A1B11AE1")))
    return p.select("p_partkey", classify.classify(F.concat(F.lit("lib/part"), ext), head).alias("c")).select("p_partkey", "c.category", "c.format")


@query("""
select count(*) as orders, count(*) filter (where o_orderstatus = 'F') as finished, count(*) filter (where o_orderstatus = 'O') as open,
  count(*) filter (where o_orderpriority = '1-URGENT') as urgent, count(*) filter (where o_totalprice is null) as unpriced,
  cast(coalesce(sum(cast(floor(coalesce(o_totalprice, 0)) as bigint)), 0) as bigint) as whole_price from orders
""")
def summary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: one pass of conditional counts and sums that count null as 0."""
    c = F.col
    return summary.conditional_counts(read(spark, sf_dir, "orders"), [], {"orders": F.lit(True), "finished": c("o_orderstatus") == "F", "open": c("o_orderstatus") == "O", "urgent": c("o_orderpriority") == "1-URGENT", "unpriced": c("o_totalprice").isNull()}, {"whole_price": F.floor("o_totalprice").cast("long")})


@query("""
with t as (select c_name as path, upper(c_name) as key, c_custkey % 10 <> 3 as retained from customer where c_custkey % 7 <> 0
  union all select lower(c_name), upper(c_name), true from customer where c_custkey % 5 = 0 and c_custkey % 7 <> 0),
r as (select o_orderkey as source, case when o_orderkey % 13 = 0 then null when o_orderkey % 4 = 1 then upper(c_name) else c_name end as path, o_orderkey % 11 = 0 as conditional
  from orders join customer on o_custkey = c_custkey),
m as (select r.source, r.path, r.conditional, count(t.path) as n,
    max(case when t.path = r.path then t.path end) as exact_path, bool_or(t.retained) filter (where t.path = r.path) as exact_kept,
    max(t.path) as any_path, bool_or(t.retained) as any_kept
  from r left join t on t.key = upper(r.path) group by r.source, r.path, r.conditional)
select source, path, s as status, case when s = 'resolved' then coalesce(exact_path, any_path) end as target from (
  select *, case when conditional then 'conditional' when path is null then 'unevaluated' when n = 0 then 'missing' when exact_path is null and n > 1 then 'ambiguous'
    when not coalesce(exact_kept, any_kept) then 'unevaluated' else 'resolved' end as s from m)
""")
def reference_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders refer to customers by name; some customers are missing, doubled, cut off or conditional."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    kept = c.where("c_custkey % 7 <> 0")
    targets = kept.select(F.col("c_name").alias("path"), (F.col("c_custkey") % 10 != 3).alias("retained")).unionByName(kept.where("c_custkey % 5 = 0").select(F.lower("c_name").alias("path"), F.lit(True).alias("retained")))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    refs = o.select(k.alias("source"), F.when(k % 13 == 0, None).when(k % 4 == 1, F.upper("c_name")).otherwise(F.col("c_name")).alias("path"), (k % 11 == 0).alias("conditional"))
    return resolve.reference_status(refs, targets)


@query("""
with d as (select o_orderkey as source, 'pkg' || (o_custkey % 40) as package from orders),
v as (select p_size, p_partkey, 'PKG' || p_size as package, cast(p_partkey as varchar) as version, p_partkey % 2 = 0 as literal, p_partkey % 9 = 0 as conditional from part),
m as (select d.source, d.package, count(v.version) as n, coalesce(bool_or(conditional), false) as cond, coalesce(bool_and(literal), false) as lit, max(version) as version
  from d left join v on v.package = upper(d.package) group by d.source, d.package)
select source, package, case when n > 0 and not cond and n = 1 and lit then version end as version,
  case when n = 0 then 'external' when cond then 'conditional' when n = 1 and lit then 'resolved' else 'unevaluated' end as status from m
""")
def package_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Central versions looked up without case."""
    refs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.concat(F.lit("pkg"), (F.col("o_custkey") % 40).cast("string")).alias("package"))
    k = F.col("p_partkey")
    central = read(spark, sf_dir, "part").select(F.concat(F.lit("PKG"), F.col("p_size").cast("string")).alias("package"), k.cast("string").alias("version"), (k % 2 == 0).alias("literal"), (k % 9 == 0).alias("conditional"))
    return resolve.package_versions(refs, central)


FILES_SQL = "select p_partkey, p_type || '/' || p_brand || '/' || p_name as path, p_type || '/' || p_brand as d2, p_type as d1 from part"


@query(f"""
with f as ({FILES_SQL}),
s as (select d2 as dir, p_partkey from f where p_partkey % 10 = 0 union all select d1, p_partkey from f where p_partkey % 50 = 0 union all select '', p_partkey from f where p_partkey = 1),
one as (select upper(dir) as dir, max(dir) as spelled, count(*) as n from s group by upper(dir) having count(*) = 1),
l as (select p_partkey, 0 as up, upper(d2) as dir from f union all select p_partkey, 1, upper(d1) from f union all select p_partkey, 2, '' from f)
select p_partkey as id, arg_min(case when spelled = '' then 'shared.props' else spelled || '/shared.props' end, up) as file, cast(min(up) as int) as levels_up from l join one using (dir) group by p_partkey
""")
def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest directory above with exactly one shared file."""
    p = read(spark, sf_dir, "part")
    items = p.select(F.col("p_partkey").alias("id"), F.concat_ws("/", "p_type", "p_brand", "p_name").alias("path"))
    shared = graph.union_all(
        p.where("p_partkey % 10 = 0").select(F.concat_ws("/", "p_type", "p_brand", F.lit("shared.props")).alias("path")),
        p.where("p_partkey % 50 = 0").select(F.concat_ws("/", "p_type", F.lit("shared.props")).alias("path")),
        p.where("p_partkey = 1").select(F.lit("shared.props").alias("path")),
    )
    return resolve.nearest_ancestor(items, shared, "shared.props")


@query(f"""
with f as ({FILES_SQL}),
o as (select upper(d2) as dir, min(p_partkey) as owner, min(p_partkey) % 2 = 0 as planned from f where p_partkey % 3 = 0 group by upper(d2)
  union all select upper(d1), 1000000 + min(p_partkey), true from f group by upper(d1)),
l as (select p_partkey, path, upper(d2) as dir from f union all select p_partkey, path, upper(d1) from f),
m as (select p_partkey, any_value(path) as path, arg_max(struct_pack(owner := owner, planned := planned), length(dir)) as w from l join o using (dir) group by p_partkey)
select path || '_' || p_partkey as path, cast(w.owner as bigint) as owner from m where w.planned
""")
def longest_prefix_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner of the longest directory above each file."""
    p = read(spark, sf_dir, "part")
    files = p.select(F.concat_ws("/", "p_type", "p_brand", F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string"))).alias("path"))
    inner = p.where("p_partkey % 3 = 0").groupBy(F.upper(F.concat_ws("/", "p_type", "p_brand")).alias("dir")).agg(F.min("p_partkey").alias("owner")).withColumn("planned", F.col("owner") % 2 == 0)
    outer = p.groupBy(F.upper("p_type").alias("dir")).agg((F.min("p_partkey") + 1000000).alias("owner")).withColumn("planned", F.lit(True))
    return resolve.longest_prefix_owner(files, inner.unionByName(outer))


@query("select o_orderkey, o_totalprice from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def semi_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose source was kept."""
    return read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def anti_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a counterpart."""
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("""
with c as (select 'P' || p_partkey as id, 'managed-assembly' as kind from part where p_partkey % 3 = 0),
e as (select distinct 'P' || l_partkey as id from lineitem where l_returnflag = 'R')
select * from c union all select id, 'package-file' from e where id not in (select id from c)
""")
def endpoint_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for every resolved end that has none."""
    name = lambda c: F.concat(F.lit("P"), F.col(c).cast("string"))
    components = read(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(name("p_partkey").alias("id"), F.lit("managed-assembly").alias("kind"))
    edges = read(spark, sf_dir, "lineitem").select(name("l_partkey").alias("target"), (F.col("l_returnflag") == "R").alias("resolved"))
    return resolve.complete_endpoints(components, edges)


@query("""
with i as (select user_id, event_id as section, event_id * 10 as low, event_id * 10 + 5000 + (event_id % 7) * 900 as high from events where event_type = 'purchase'),
p as (select user_id, event_id as point_id, event_id * 10 + 3 as spot from events where event_type <> 'purchase')
select point_id, section, spot - low as within from p join i using (user_id) where spot >= low and spot < high
""")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open intervals that hold a point, by bins."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    intervals = e.where("event_type = 'purchase'").select("user_id", k.alias("section"), (k * 10).alias("low"), (k * 10 + 5000 + (k % 7) * 900).alias("high"))
    points = e.where("event_type <> 'purchase'").select("user_id", k.alias("point_id"), (k * 10 + 3).alias("at"))
    return resolve.interval_lookup(points, intervals, ["user_id"], "at", width=8192).select("point_id", "section", (F.col("at") - F.col("low")).alias("within"))


@query("""
with r as (select distinct l_suppkey, l_partkey * 100 as low, l_partkey * 100 + cast(l_quantity as bigint) * 40 as high from lineitem),
m as (select *, max(high) over (partition by l_suppkey order by low, high rows between unbounded preceding and 1 preceding) as before from r where high > low)
select l_suppkey, low, high from m where low < before
""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: ranges that begin before an earlier one ends."""
    li = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") * 100).alias("at"), (F.col("l_quantity").cast("long") * 40).alias("size"))
    return validate.overlapping_intervals(li, ["l_suppkey"], "at", "size")


DETECT_SQL = """
select page_id, id, name, category, cast(confidence as double) as confidence, evidence, ord from (
  select page_id, 0 as ord, 'secure' as id, 'TLS' as name, 'runtime' as category, 0.9 as confidence, 'scheme' as evidence from pages where starts_with(upper(url), 'HTTPS')
  union all select page_id, 1, 'blog', 'Blog', 'framework', 0.75, 'host prefix' from pages where contains(url, '://blog.')
  union all select page_id, 2, 'Blog', 'Weblog', 'framework', 0.75, 'Host Prefix' from pages where contains(url, '://blog.')
  union all select page_id, 3, 'german', 'German', 'language', 0.8, 'language tag' from pages where contains(html, 'lang="de"')
  union all select page_id, 4, 'german', 'Deutsch', 'language', 0.95, 'path' from pages where contains(url, '/de/')
  union all select page_id, 5, 'tracked', 'Tracking', 'toolchain', 0.6, 'query string' from pages where contains(url, 'utm_'))
"""


def _page_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, html = F.col("url"), F.col("html")
    host = F.contains(url, F.lit("://blog."))
    rules = [
        detect.Rule("secure", "TLS", "runtime", 0.9, "scheme", F.startswith(F.upper(url), F.lit("HTTPS"))),
        detect.Rule("blog", "Blog", "framework", 0.75, "host prefix", host),
        detect.Rule("Blog", "Weblog", "framework", 0.75, "Host Prefix", host),
        detect.Rule("german", "German", "language", 0.8, "language tag", F.contains(html, F.lit('lang="de"'))),
        detect.Rule("german", "Deutsch", "language", 0.95, "path", F.contains(url, F.lit("/de/"))),
        detect.Rule("tracked", "Tracking", "toolchain", 0.6, "query string", F.contains(url, F.lit("utm_"))),
    ]
    # The rule's place in the list, not among those that hold.
    order = F.create_map(*(F.lit(v) for i, r in enumerate(rules) for v in (r.name, i)))
    return read(spark, sf_dir, "pages").select("page_id", F.inline(detect.findings(rules))).withColumn("ord", order[F.col("name")])


@query(DETECT_SQL)
def detect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over each page."""
    return _page_detections(spark, sf_dir)


@query(f"""
with d as (select *, upper(id) as k from ({DETECT_SQL})),
e as (select page_id, k, upper(evidence) as e, arg_min(evidence, ord) as t from d group by page_id, k, upper(evidence)),
f as (select page_id, k, string_agg(t, '|' order by e) as evidence from e group by page_id, k),
g as (select page_id, k, arg_min(id, ord) as id, arg_max(name, struct_pack(c := confidence, o := -ord)) as name, arg_max(category, struct_pack(c := confidence, o := -ord)) as category, max(confidence) as confidence from d group by page_id, k)
select g.page_id, g.id, g.name, g.category, g.confidence, f.evidence from g join f using (page_id, k)
""")
def detect_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings merged by id without case."""
    return detect.merge(_page_detections(spark, sf_dir), ["page_id"], "ord").withColumn("evidence", F.array_join("evidence", "|"))


@query("""
with w as (select event_id, case when event_id % 2 = 0 then upper(event_type) else event_type end as warning from events)
select min(event_id) as event_id, arg_min(warning, event_id) as warning from w group by upper(warning)
""")
def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct without case, keeping the first spelling and place."""
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("warning"))
    return ordering.distinct_first(e, [text.fold(F.col("warning"))], "event_id", ["warning"])


@query("""
with c as (select o_orderpriority, o_custkey % 50 as code, count(*) as n from orders group by all)
select o_orderpriority, code, n, row_number() over (partition by o_orderpriority order by n desc, code) as rn from c qualify rn <= 10
""")
def error_histogram_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent codes of each group."""
    o = read(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_custkey") % 50).alias("code"))
    return summary.histogram_top(o, ["o_orderpriority"], "code", 10)


@query("""
select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_orderstatus = 'P', o_orderkey) as rn from orders qualify rn <= 3
""")
def topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of each group, one kind last, else in place."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    return ordering.top_per_group(o, ["o_custkey"], [F.col("o_orderstatus") == "P", F.col("o_orderkey")], 3).drop("o_orderstatus")


@query("""
with w as (select o_custkey, o_orderkey, 'order ' || o_orderkey as message, row_number() over (partition by o_custkey order by o_orderkey) as rn, count(*) over (partition by o_custkey) as n from orders)
select o_custkey, cast(rn as int) as position, message from w where rn <= 5
union all select distinct o_custkey, 6, (n - 5) || ' more' from w where n > 5
""")
def ordered_prefix_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first messages of each group and a count of the rest."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("message"))
    return ordering.cap_with_overflow(o, ["o_custkey"], "o_orderkey", "message", 5)


@query("""
select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as rn, count(*) over (partition by o_custkey) > 4 as truncated from orders qualify rn <= 4
""")
def cap_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: a cap that shows."""
    return ordering.cap_with_flag(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")], 4)


@query("""
with recursive o as (select o_custkey, o_orderkey, cast(floor(o_totalprice) as bigint) as cost, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders),
g(o_custkey, rn, o_orderkey, cost, spent, kept) as (
  select o_custkey, rn, o_orderkey, cost, case when cost <= 300000 then cost else 0 end, cost <= 300000 from o where rn = 1
  union all select o.o_custkey, o.rn, o.o_orderkey, o.cost, case when g.spent + o.cost <= 300000 then g.spent + o.cost else g.spent end, g.spent + o.cost <= 300000
  from g join o on o.o_custkey = g.o_custkey and o.rn = g.rn + 1)
select o_custkey, o_orderkey, cost from g where kept
""")
def greedy_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: rows that fit are kept, those that don't are skipped."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("long").alias("cost"))
    return ordering.greedy_budget(o, ["o_custkey"], ["o_orderkey"], "cost", 300_000)


@query("""
with r as (select o_custkey, o_orderkey, cast(floor(o_totalprice) as bigint) as cost from orders where floor(o_totalprice) <= 250000),
s as (select *, cast(sum(cost) over (partition by o_custkey order by o_orderkey rows unbounded preceding) as bigint) as running from r)
select * from s where running <= 900000
""")
def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows until the budget is spent; oversize ones are left out and spend nothing."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("long").alias("cost"))
    return ordering.prefix_budget(o, ["o_custkey"], [F.col("o_orderkey")], "cost", 900_000, 250_000)


@query("select k as path, count(*) as n from (select unnest(json_keys(props)) as k from events) group by k")
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property paths of JSON texts, without values."""
    e = read(spark, sf_dir, "events").select(structure.json_structure(F.col("props")).alias("s"))
    return e.select(F.explode("s.paths").alias("path")).groupBy("path").agg(F.count("*").alias("n"))


@query("select upper(p_name) as name, count(*) as n from part group by upper(p_name) having count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that more than one file has."""
    return validate.duplicate_keys(read(spark, sf_dir, "part"), [text.fold(F.col("p_name")).alias("name")])


@query("""
select l_orderkey, count(distinct (l_returnflag, l_linestatus)) = 1 and (not bool_or(l_tax > 0.05) or (count(*) = 1 and count(l_partkey) = 1)) as ok from lineitem group by l_orderkey
""")
def identity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: one classification a site."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_partkey", (F.col("l_tax") > 0.05).alias("tail"))
    return validate.one_classification(li, ["l_orderkey"], ["l_returnflag", "l_linestatus"], "l_partkey", "tail")


@query("""
with n as (select o_custkey, count(*) as n from orders group by o_custkey)
select c_custkey, coalesce(n, 0) <= 10 as bounded, coalesce(n, 0) = 10 or (c_custkey % 2 = 0 and coalesce(n, 0) <= 10) as ok from customer left join n on o_custkey = c_custkey
""")
def count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: declared counts against rows."""
    declared = read(spark, sf_dir, "customer").select("c_custkey", F.lit(10).alias("declared_count"), (F.col("c_custkey") % 2 == 0).alias("truncated"))
    return validate.consistent_counts(declared, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""
with recursive i as (select p_partkey as id, case when p_partkey > 1 then p_partkey // 2 end as parent, p_size % 10 <> 0 as ok from part),
up(id, here, parent, depth, ok) as (select id, id, parent, 0, ok from i union all select u.id, i.id, i.parent, u.depth + 1, u.ok and i.ok from up u join i on u.parent = i.id)
select id, max(case when parent is null then here end) as root, cast(max(depth) as int) as depth, coalesce(bool_or(case when parent is null then ok end), false) as complete from up group by id
""")
def owner_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of owners above each item."""
    k = F.col("p_partkey")
    items = read(spark, sf_dir, "part").select(k.alias("id"), F.when(k > 1, F.floor(k / 2).cast("long")).alias("parent"), (F.col("p_size") % 10 != 0).alias("ok"))
    return graph.owner_chain(items)


CYCLE_SQL = """
with recursive e as (select n_nationkey as src, (n_nationkey * 3 + n_regionkey) % 25 as dst from nation union all select n_nationkey, (n_nationkey + 5) % 25 from nation where n_nationkey % 4 = 0),
w(src, dst) as (select distinct src, dst from e union select w.src, e.dst from w join e on w.dst = e.src)
"""


def _nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    return n.select(k.alias("src"), ((k * 3 + F.col("n_regionkey")) % 25).alias("dst")).unionByName(n.where("n_nationkey % 4 = 0").select(k.alias("src"), ((k + 5) % 25).alias("dst")))


@query(CYCLE_SQL + "select distinct src as node from w where src = dst")
def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on a cycle."""
    return graph.cyclic_nodes(_nation_edges(spark, sf_dir))


@query(CYCLE_SQL + ", b as (select n_nationkey as node, n_nationkey = 7 as incomplete from nation) select node, incomplete or node in (select src from w where dst in (select node from b where incomplete)) as incomplete from b")
def incomplete_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incompleteness carried to all that depend on it."""
    nodes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") == 7).alias("incomplete"))
    return graph.incomplete_closure(nodes, _nation_edges(spark, sf_dir))


@query("""
with recursive l as (select p_partkey, 'L' || p_partkey as path, case when p_partkey % 9 = 0 then 'F' || p_partkey when p_partkey % 9 = 1 then 'gone' else 'L' || (p_partkey - 1) end as target from part),
f as (select 'F' || p_partkey as path from part where p_partkey % 2 = 0),
w(path, here, hops) as (select path, target, 1 from l union all select w.path, l.target, w.hops + 1 from w join l on w.here = l.path where w.hops < 40)
select path, final, cast(hops as int) as hops, case when final in (select path from f) then 'resolved' when hops >= 40 then 'cycle' else 'missing' end as status
from (select path, arg_max(here, hops) as final, max(hops) as hops from w group by path)
""")
def link_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links followed to a file."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    at = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    links = p.select(at("L", k).alias("path"), F.when(k % 9 == 0, at("F", k)).when(k % 9 == 1, "gone").otherwise(at("L", k - 1)).alias("target"))
    return graph.resolve_links(links, p.where("p_partkey % 2 = 0").select(at("F", k).alias("path"), F.lit("file").alias("kind")))


@query("""
select conv_id, turn, role, lead(turn) over w as callee, case when lead(turn) over w is null then 'unresolved' else 'resolved' end as status from conversations window w as (partition by conv_id order by turn)
""")
def caller_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each turn to the next; the last has no target."""
    nxt = F.lead("turn").over(W.partitionBy("conv_id").orderBy("turn"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", nxt.alias("callee")).withColumn("status", F.when(F.col("callee").isNull(), "unresolved").otherwise("resolved"))


@query("""
with r as (select user_id, event_id * 2 as ord, 1 as step, event_id from events union all select user_id, event_id * 2 + 1 + (event_id % 3) * 1000, -1, event_id from events),
d as (select *, sum(step) over (partition by user_id order by ord, step rows unbounded preceding) as depth from r)
select user_id, ord, cast(depth as int) as depth from d where step = 1
""")
def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth by a running sum over start and end records."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    r = e.select("user_id", (k * 2).alias("ord"), F.lit(1).alias("step")).unionByName(e.select("user_id", (k * 2 + 1 + (k % 3) * 1000).alias("ord"), F.lit(-1).alias("step")))
    w = W.partitionBy("user_id").orderBy("ord", "step").rowsBetween(W.unboundedPreceding, 0)
    return r.withColumn("depth", F.sum("step").over(w).cast("int")).where("step = 1").select("user_id", "ord", "depth")


@query("""
with r as (select conv_id, turn * 2 as ord, 'start' as kind from conversations union all select conv_id, case when turn % 2 = 0 then 100000 - turn else turn * 2 + 1 end, 'end' from conversations),
d as (select *, sum(case when kind = 'start' then 1 else -1 end) over (partition by conv_id order by ord rows unbounded preceding) as depth from r),
s as (select * from d where kind = 'start'),
p as (select a.conv_id, a.ord, a.depth, max(b.ord) as parent from s a left join s b on b.conv_id = a.conv_id and b.depth = a.depth - 1 and b.ord < a.ord group by all)
select p.conv_id, p.ord, cast(p.depth as int) as depth, p.parent, (select count(*) from p q where q.conv_id = p.conv_id and q.parent = p.ord) as children from p
""")
def element_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent, depth and children of nested elements."""
    c, t = read(spark, sf_dir, "conversations"), F.col("turn")
    r = c.select("conv_id", (t * 2).alias("ord"), F.lit("start").alias("kind")).unionByName(c.select("conv_id", F.when(t % 2 == 0, 100000 - t).otherwise(t * 2 + 1).alias("ord"), F.lit("end").alias("kind")))
    return graph.element_tree(r, ["conv_id"], "ord", "kind")


@query("select vec_id, i as position, round(cast(v as double), 6) as component from (select vec_id, unnest(embedding) as v, unnest(range(0, len(embedding))) as i from embeddings)")
def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: a nested list as rows with their places."""
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("position", "v")).select("vec_id", F.col("position").cast("long"), F.round(F.col("v").cast("double"), 6).alias("component"))


@query("select l_partkey, count(*) as edges, count(distinct l_suppkey) as suppliers, cast(sum(l_quantity) as bigint) as quantity from lineitem group by l_partkey")
def dependency_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The degree of each target."""
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("edges"), F.count_distinct("l_suppkey").alias("suppliers"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("""
select 'customer' as kind, c_custkey as id, c_name as name, cast(null as varchar) as brand from customer union all select 'supplier', s_suppkey, s_name, null from supplier union all select 'part', p_partkey, p_name, p_brand from part
""")
def union_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of several producers in one table; what one lacks is null."""
    kind = lambda k: F.lit(k).alias("kind")
    return graph.union_all(
        read(spark, sf_dir, "customer").select(kind("customer"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        read(spark, sf_dir, "supplier").select(kind("supplier"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        read(spark, sf_dir, "part").select(kind("part"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand")),
    )


@query("""
with e as (select p_partkey, case p_partkey % 3 when 0 then 'int' when 1 then 'string' else 'byte' end as type, case when p_partkey % 4 = 0 then '-' || p_size when p_partkey % 4 = 1 then '0x' || p_size else cast(p_size as varchar) end as literal from part)
select p_partkey, case when type in ('int', 'byte') and regexp_full_match(literal, '-?[0-9]{1,20}') then literal end as value from e
""")
def enum_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of integral type that are integers."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    kind = F.when(k % 3 == 0, "int").when(k % 3 == 1, "string").otherwise("byte")
    literal = F.when(k % 4 == 0, F.concat(F.lit("-"), size)).when(k % 4 == 1, F.concat(F.lit("0x"), size)).otherwise(size)
    return read(spark, sf_dir, "part").select("p_partkey", text.integral_value(kind, literal).alias("value"))


@query("""
with e as (select p_brand, p_size, p_partkey, p_name || '_' || p_partkey as name from part)
select p_brand, p_partkey, p_size, first(name) over w as canonical, row_number() over w > 1 as is_alias from e window w as (partition by p_brand, p_size order by p_partkey)
""")
def alias_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first variant of a value, and its aliases."""
    e = read(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey", F.concat("p_name", F.lit("_"), F.col("p_partkey").cast("string")).alias("name"))
    return summary.alias_duplicates(e, ["p_brand"], "p_size", "name", "p_partkey").drop("name")


@query("""
select p_partkey, case p_partkey % 4 when 0 then p_type || '/x/y' when 1 then p_type || '/y' when 2 then 'y' else null end as resolved from part
""")
def path_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-functions: a relative path seen from type/brand; what leaves the root is null."""
    k = F.col("p_partkey")
    relative = F.when(k % 4 == 0, "..\\x/./y").when(k % 4 == 1, "../y").when(k % 4 == 2, "../../y").otherwise("../../../y")
    # Slashes inside a type's name would be directories of their own; there are none.
    return read(spark, sf_dir, "part").select("p_partkey", paths.resolve(F.concat_ws("/", "p_type", "p_brand"), relative).alias("resolved"))


@query(r"""
select doc_id, regexp_replace(regexp_replace(text, '([\\|`*_\[\]<>])', '\\\1', 'g'), '[\r\n]+', ' ', 'g') as cell from documents
""")
def markdown_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: texts escaped for a table cell."""
    return read(spark, sf_dir, "documents").select("doc_id", text.markdown_cell(F.col("text")).alias("cell"))


@query("""
with t as (select p_partkey as token, case when p_partkey % 3 <> 0 then (p_partkey // 3) * 3 end as parent, p_partkey,
    case p_partkey % 3 when 0 then [p_brand] when 1 then [p_brand, p_name] else [p_name] end as own from part),
g as (select t.token, t.parent, case when t.parent is null then t.own else list_concat(case when t.token % 5 = 0 then [] else p.own end, t.own) end as generics from t left join t p on p.token = t.parent)
select c.token, c.parent as declaring_token from g c join g o on o.token = c.parent where c.generics[1:len(o.generics)] = o.generics
""")
def generic_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of nested types whose generic scope fits."""
    k = F.col("p_partkey")
    own = F.when(k % 3 == 0, F.array("p_brand")).when(k % 3 == 1, F.array("p_brand", "p_name")).otherwise(F.array("p_name"))
    t = read(spark, sf_dir, "part").select(k.alias("token"), F.when(k % 3 != 0, F.floor(k / 3).cast("long") * 3).alias("declaring_token"), own.alias("own"))
    up = t.select(F.col("token").alias("declaring_token"), F.col("own").alias("above"))
    none = F.array().cast("array<string>")
    scoped = t.join(up, "declaring_token", "left").select("token", "declaring_token", F.when(F.col("declaring_token").isNull(), F.col("own")).otherwise(F.concat(F.when(F.col("token") % 5 == 0, none).otherwise(F.coalesce("above", none)), "own")).alias("generics"))
    return resolve.nested_owner(scoped)


@query("""
select c_custkey, case when c_acctbal >= 1048576 then printf('%.1f MiB', round(c_acctbal / 1048576, 1)) when floor(abs(c_acctbal)) >= 1024 then printf('%.1f KiB', round(floor(abs(c_acctbal)) / 1024, 1)) else cast(cast(floor(abs(c_acctbal)) as bigint) as varchar) || ' B' end as size from customer
""")
def size_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Math functions: sizes in units."""
    return read(spark, sf_dir, "customer").select("c_custkey", text.byte_units(F.floor(F.abs("c_acctbal")).cast("long")).alias("size"))


@query("""
with a as (select distinct p_brand as dir, p_name as name from part), d as (select upper(name) as key, dir from a)
select key, count(*) as n, string_agg(dir, ',' order by dir) as members from d group by key
""")
def index_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name and the places that have it."""
    d = read(spark, sf_dir, "part").select("p_brand", "p_name").distinct()
    return summary.index_members(d, text.fold(F.col("p_name")), "p_brand").withColumn("members", F.array_join("members", ","))




@query("""
with d as (select distinct case when l_partkey % 400 < 250 then 'S' else 'T' end || (l_partkey % 400) as symbol, 'P' || case when l_partkey % 400 < 90 then l_partkey % 400 % 7 else l_suppkey % 7 end as project from lineitem),
p as (select symbol, count(distinct project) as n, min(project) as project from d group by symbol),
c as (select o_orderkey as id, 'P' || (o_custkey % 7) as source_project, case when o_orderkey % 9 <> 0 then 'S' || (o_orderkey % 400) end as symbol from orders)
select id, source_project, symbol, case when n = 1 then project end as target_project,
  case when symbol is null then 'unresolved' when n is null then 'external' when n > 1 then 'ambiguous' else 'resolved-source' end as status
from c left join p using (symbol)
""")
def call_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by the projects that declare their symbol."""
    named = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    part = F.col("l_partkey") % 400
    symbol = F.concat(F.when(part < 250, "S").otherwise("T"), part.cast("string"))
    d = read(spark, sf_dir, "lineitem").select(symbol.alias("symbol"), named("P", F.when(part < 90, part % 7).otherwise(F.col("l_suppkey") % 7)).alias("project"))
    k = F.col("o_orderkey")
    c = read(spark, sf_dir, "orders").select(k.alias("id"), named("P", F.col("o_custkey") % 7).alias("source_project"), F.when(k % 9 != 0, named("S", k % 400)).alias("symbol"))
    return resolve.call_status(c, d)


@query("""
select distinct o_custkey as source, o_custkey % 50 as target from orders where o_orderstatus = 'F' and o_custkey % 50 in (select s_suppkey from supplier where s_suppkey % 2 = 0)
""")
def project_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved references to planned projects, once each."""
    status = F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("missing")
    refs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_custkey") % 50).alias("target"), F.lit("project-reference").alias("kind"), status.alias("status"))
    return resolve.project_dependencies(refs, read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("project")))


@query("""
with f as (select p_brand as type, case when p_partkey % 7 = 0 then '<' || p_name || '>k__BackingField' when p_partkey % 11 = 0 then 'value__' else p_name end as name, p_partkey from part)
select type, name, p_partkey from f where not contains(name, '<') and name <> 'value__' and (type, name) not in (select p_brand, p_name from part where p_size < 10)
""")
def field_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that are emitted."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.when(k % 7 == 0, F.concat(F.lit("<"), "p_name", F.lit(">k__BackingField"))).when(k % 11 == 0, "value__").otherwise(F.col("p_name"))
    return resolve.field_names(p.select(F.col("p_brand").alias("type"), name.alias("name"), "p_partkey"), p.where("p_size < 10").select(F.col("p_brand").alias("type"), F.col("p_name").alias("name")))


@query("""
with m as (select p_partkey, case p_partkey % 5 when 0 then 'get_' || p_size when 1 then 'Run' || p_size when 2 then 'N.IX.set_Y' when 3 then 'op_Add' else 'N.IX.Go' end as name from part)
select p_partkey, name, not regexp_matches(name, '^(get|set|add|remove|op)_') as by_raw_name, not regexp_matches(string_split(name, '.')[-1], '^(get|set|add|remove|op)_') as by_last_segment from m
""")
def method_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessors by the raw name and by what follows the last dot."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.when(k % 5 == 0, F.concat(F.lit("get_"), size)).when(k % 5 == 1, F.concat(F.lit("Run"), size)).when(k % 5 == 2, "N.IX.set_Y").when(k % 5 == 3, "op_Add").otherwise("N.IX.Go")
    m = read(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    return m.select("*", (~text.is_accessor(F.col("name"))).alias("by_raw_name"), (~text.is_accessor(text.last_segment(F.col("name")))).alias("by_last_segment"))


@query("""
with k as (select o_custkey as section, o_orderkey as key_ord, (o_orderkey * 37) % 1000 as position from orders),
j as (select section, key_ord, 5000 + position as low from k),
w as (select *, lead(low) over (partition by section order by key_ord) as nxt, lag(low) over (partition by section order by key_ord) as before from j)
select section, key_ord, low, coalesce(nxt, 6000) as high, (before is null or low > before) and low >= 5000 and low < 6000 as ok from w
""")
def deferred_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value ranges from one key's position to the next one's."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("section"), F.col("o_orderkey").alias("key_ord"), ((F.col("o_orderkey") * 37) % 1000).alias("position"))
    sections = o.select("section").distinct().select("section", F.lit(5000).cast("long").alias("content_start"), F.lit(6000).cast("long").alias("content_end"))
    return resources.deferred_ranges(o, sections)


@query("""
select p_brand, p_partkey, p_size * 1000000 + p_partkey as position, coalesce(lead(p_size * 1000000 + p_partkey) over (partition by p_brand order by p_size * 1000000 + p_partkey), 99999999) as stop from part
""")
def entry_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry ends where the next one in position begins."""
    p = read(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") * 1000000 + F.col("p_partkey")).alias("position"), F.lit(99999999).cast("long").alias("limit"))
    return resources.entry_ends(p, "p_brand").drop("limit")


@query("""
with recursive e as (select distinct n_nationkey as src, n_nationkey // 2 as dst from nation where n_nationkey > 0 union select n_nationkey, n_nationkey // 3 from nation where n_nationkey > 3),
d(node, here, depth) as (select src, dst, 1 from e union select d.node, e.dst, d.depth + 1 from d join e on d.here = e.src)
select n_nationkey as node, cast(coalesce(max(depth), 0) as int) as layer from nation left join d on node = n_nationkey group by n_nationkey
""")
def dependency_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: the order in which nodes can be built."""
    n, k = read(spark, sf_dir, "nation"), F.col("n_nationkey")
    edges = n.where("n_nationkey > 0").select(k.cast("long").alias("src"), F.floor(k / 2).alias("dst")).union(n.where("n_nationkey > 3").select(k.cast("long"), F.floor(k / 3))).distinct()
    return graph.dependency_layers(n.select(k.cast("long").alias("node")), edges).select(F.col("node").cast("int"), "layer")


@query("""
with f as (select p_brand, case when p_partkey % 6 = 0 then p_type else p_type || '/' || p_name end as path, p_partkey from part)
select p_brand, path, p_partkey from f x where exists (select 1 from f y where y.p_brand = x.p_brand and starts_with(upper(y.path), upper(x.path) || '/'))
""")
def path_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: paths that are a file and a directory above another."""
    path = F.when(F.col("p_partkey") % 6 == 0, F.col("p_type")).otherwise(F.concat("p_type", F.lit("/"), "p_name"))
    return validate.file_directory_conflicts(read(spark, sf_dir, "part").select("p_brand", path.alias("path"), "p_partkey"), ["p_brand"], "path")


@query("""
with r as (select event_id, case event_id % 4 when 0 then props when 1 then '{"a":1,"a":2}' when 2 then '{"a":' else '{"a":[1,{"b":null}]}' end as body, event_id % 4 as kind from events)
select event_id, kind in (0, 3) and body is not null as ok from r
""")
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: JSON that repeats a property, or is none, is refused."""
    k = F.col("event_id") % 4
    body = F.when(k == 0, F.col("props")).when(k == 1, '{"a":1,"a":2}').when(k == 2, '{"a":').otherwise('{"a":[1,{"b":null}]}')
    return read(spark, sf_dir, "events").select("event_id", validate.strict_json(body).isNotNull().alias("ok"))


@query("""
with r as (select o_custkey, o_orderkey, sha256(case when o_orderkey % 3 = 0 then 'stale' else cast(o_custkey as varchar) end) as digest from orders), i as (select c_custkey, sha256(cast(c_custkey as varchar)) as digest from customer)
select o_custkey, o_orderkey, digest from r where exists (select 1 from i where c_custkey = o_custkey and i.digest = r.digest)
""")
def same_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results made from another input are dropped."""
    own = F.col("o_custkey").cast("string")
    r = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.sha2(F.when(F.col("o_orderkey") % 3 == 0, "stale").otherwise(own), 256).alias("digest"))
    i = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("digest"))
    return validate.same_input(r, i, "o_custkey", "digest")


@query("""
with c as (select o_orderkey, o_custkey % 5 as caller, case when o_orderkey % 6 <> 0 then o_custkey % 3 end as target, o_orderkey % 4 = 0 as indirect, o_orderkey % 2 = 0 as tail, 2 + o_orderkey % 2 as version from orders)
select o_orderkey, (not tail or (not indirect and target is not null and coalesce(target <> caller, false))) and version >= 3 as ok from c
""")
def tail_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: what a tail call may be, and which versions have the field."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ok = validate.tail_call_rule(k % 4 == 0, k % 2 == 0, c % 5, F.when(k % 6 != 0, c % 3), 2 + k % 2)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(ok, F.lit(False)).alias("ok"))


@query("""
with f as (select o_orderkey as site, o_custkey as caller, case when o_orderkey % 5 <> 0 then o_custkey + 1 end as target from orders),
n as (select c_custkey as address, c_name || ' (' || c_custkey || ')' as shown from customer)
select site, f.caller, f.target, coalesce(a.shown, cast(f.caller as varchar)) as caller_shown, coalesce(b.shown, cast(f.target as varchar), 'unresolved') as target_shown
from f left join n a on a.address = f.caller left join n b on b.address = f.target
""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses shown by name; unknown targets by a label."""
    k = F.col("o_custkey")
    calls = read(spark, sf_dir, "orders").select(F.lit(0).alias("id"), F.col("o_orderkey").alias("site"), k.alias("caller"), F.when(F.col("o_orderkey") % 5 != 0, k + 1).alias("target"))
    functions = read(spark, sf_dir, "customer").select(F.lit(0).alias("id"), F.col("c_custkey").alias("address"), F.col("c_name").alias("name"))
    return native.display_names(calls, functions).drop("id")


@query("""
with n as (select p_partkey, case when p_partkey % 2 = 0 then upper(p_name) else p_name end as name from part)
select p_partkey, count(*) over (partition by upper(name)) > 1 as duplicate, case when count(*) over (partition by upper(name)) > 1 then 'project_' || p_partkey else name end as name from n
""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are not unique without case are replaced."""
    n = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    return summary.unique_names(n, "name", "p_partkey", F.concat(F.lit("project_"), F.col("p_partkey").cast("string")))


@query("""
with p as (select p_partkey, case p_partkey % 8 when 0 then 'net8.0' when 1 then '$(X)' when 2 then ' ' when 3 then 'a;b' when 4 then 'CON' when 5 then 'a.' when 6 then 'src/OBJ/x.cs' else 'src/obj' end as v from part)
select p_partkey, trim(v) <> '' and not regexp_matches(v, '[$@%*?;]') as literal, v not in (' ', 'CON', 'a.', 'src/OBJ/x.cs', 'src/obj') as portable, v = 'src/OBJ/x.cs' as excluded from p
""")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """excluded directories, literals and portable segments."""
    samples = F.array(*(F.lit(x) for x in ("net8.0", "$(X)", " ", "a;b", "CON", "a.", "src/OBJ/x.cs", "src/obj")))
    v = read(spark, sf_dir, "part").select("p_partkey", F.element_at(samples, (F.col("p_partkey") % 8 + 1).cast("int")).alias("v"))
    return v.select("p_partkey", text.is_literal(F.col("v")).alias("literal"), text.is_portable_segment(F.col("v")).alias("portable"), paths.has_excluded_directory(F.col("v"), ["obj"]).alias("excluded"))


@query("""
select doc_id, left(source, 1) || '.' || lang as name, row_number() over (order by upper(source), source, lang, doc_id) as position from documents qualify position <= 500
""")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows in the canonical order, with their places."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    first = d.orderBy(text.fold(F.col("source")), "source", "lang", "doc_id").limit(500)
    place = F.row_number().over(W.orderBy(text.fold(F.col("source")), "source", "lang", "doc_id"))  # at most 500 rows
    return first.select("doc_id", F.concat(F.substring("source", 1, 1), F.lit("."), "lang").alias("name"), place.cast("long").alias("position"))


@query(r"""
select doc_id, case when length(text) <= 512 then regexp_replace(text, '[\p{Cc}\p{Cf}]', '�', 'g') else left(regexp_replace(text, '[\p{Cc}\p{Cf}]', '�', 'g'), 494) || '…#' || left(sha256(text), 16) end as bounded from documents
""")
def bounded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters escaped, long texts cut with a digest."""
    return read(spark, sf_dir, "documents").select("doc_id", text.bounded_text(F.col("text")).alias("bounded"))


@query("""
select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 40)
""")
def source_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files that are no image; here, parts without a large returned line."""
    files = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    images = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 40").select(F.col("l_partkey").alias("id"))
    return summary.code_files(files, images, images)[0].select(F.col("id").alias("p_partkey"))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files with a type at least; here, customers with a large order."""
    files = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    types = read(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    return summary.code_files(files, types, types)[1].select(F.col("id").alias("c_custkey"))


@query("""
with c as (select o_custkey as id, arg_min(o_orderstatus, o_orderkey) as status, min(o_orderkey) as first_order from orders group by o_custkey)
select c_custkey as id, status, first_order from customer left join c on c.id = c_custkey
""")
def component_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first component of each id."""
    components = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("first_order"), F.col("o_orderkey").alias("ord"))
    return summary.first_by_id(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), components, "ord")


@query("""
select s_suppkey as project, (select count(*) from lineitem where l_suppkey = s_suppkey) as files, (select count(*) from lineitem where l_suppkey = s_suppkey and l_quantity > 49) as declarations,
  (select count(*) from part where p_partkey % 97 = s_suppkey) as calls from supplier
""")
def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: the rows of each project in several tables."""
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("project"), "l_quantity")
    parts = read(spark, sf_dir, "part").select((F.col("p_partkey") % 97).alias("project"))
    return summary.project_counts(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project")), files=li, declarations=li.where("l_quantity > 49"), calls=parts)


@query("select p_brand as assembly, cast(sum(case when p_size % 3 = 0 then 0 when p_partkey % 2 = 0 then 1 else 2 end) as bigint) as methods_with_code from part group by p_brand")
def code_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods that have code, summed over types."""
    method = lambda n: F.struct(F.sequence(F.lit(1), n).alias("il"))
    none = F.struct(F.array().cast("array<int>").alias("il"))
    methods = F.when(F.col("p_size") % 3 == 0, F.array(none)).when(F.col("p_partkey") % 2 == 0, F.array(method(F.lit(2)), none)).otherwise(F.array(none, method(F.lit(1)), method(F.lit(9))))
    return summary.methods_with_code(read(spark, sf_dir, "part").select(F.col("p_brand").alias("assembly"), methods.alias("methods")))


@query("""
with c as (select count(*) filter (o_orderstatus <> 'F') as incomplete, count(*) filter (o_orderkey % 5 = 0) as noted from orders)
select 'incomplete' as kind, incomplete as projects, incomplete || ' projects are incomplete' as warning from c union all select 'noted', noted, noted || ' projects have notes' from c
""")
def project_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings made of counts."""
    notes = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>"))
    return summary.project_warnings(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project"), (F.col("o_orderstatus") == "F").alias("complete"), notes.alias("notes")))


@query("""
select p_partkey, p_size % 4 as depth, row_number() over (order by p_size % 4, upper(p_name), p_name, p_partkey) as position from part qualify position <= 300
""")
def archive_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: archives by depth, then path; the first 300 with their places."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", (F.col("p_size") % 4).alias("depth"))
    first = p.orderBy("depth", text.fold(F.col("p_name")), "p_name", "p_partkey").limit(300)
    place = F.row_number().over(W.orderBy("depth", text.fold(F.col("p_name")), "p_name", "p_partkey"))  # at most 300 rows
    return first.select("p_partkey", F.col("depth").cast("int"), place.cast("long").alias("position"))


@query("""
select o_orderkey, row_number() over (order by o_orderpriority, o_orderstatus, o_clerk, o_orderkey) as position from (select *, o_custkey % 10 as o_clerk from orders) qualify position <= 300
""")
def reference_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by source, kind and target, ties in the order of the input; the first 300 with their places."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("kind"), (F.col("o_custkey") % 10).alias("target"), "o_orderkey")
    first = ordering.reference_order(o, "o_orderkey").limit(300)
    return first.select("o_orderkey", F.row_number().over(W.orderBy("source", "kind", "target", "o_orderkey")).cast("long").alias("position"))  # at most 300 rows


@query("""
with o as (select o_custkey, list(o_orderstatus order by o_orderkey) filter (o_orderkey % 2 = 0) as attributes, list(o_orderpriority order by o_orderkey) filter (o_orderkey % 2 = 1) as elements from orders group by o_custkey),
v as (select o_custkey, list_concat(coalesce(attributes, []), coalesce(elements, [])) as versions from o)
select o_custkey, array_to_string(versions, '|') as versions, array_to_string(list_transform(list_filter(list_zip(versions, range(1, len(versions) + 1)), lambda p: list_position(versions, p[1]) = p[2]), lambda p: p[1])[1:3], '|') as kept,
  len(list_distinct(versions)) > 3 as truncated from v
""")
def declared_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute and element versions in one list, the distinct ones capped with a flag."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    listed = lambda c, odd: F.transform(F.sort_array(F.collect_list(F.when(k % 2 == odd, F.struct(k.alias("k"), F.col(c).alias("v"))))), lambda x: x["v"])
    v = o.groupBy("o_custkey").agg(listed("o_orderstatus", 0).alias("a"), listed("o_orderpriority", 1).alias("e")).select("o_custkey", ordering.all_versions(F.col("a"), F.col("e")).alias("versions"))
    capped = v.withColumn("c", ordering.cap_values(F.col("versions"), 3))
    return capped.select("o_custkey", F.array_join("versions", "|").alias("versions"), F.array_join("c.values", "|").alias("kept"), F.col("c.truncated").alias("truncated"))


@query("""
select p_partkey, case when p_partkey % 3 = 0 then case when p_partkey % 2 = 0 then 'library' else 'executable' end else 'archive' end as category,
  case when p_partkey % 3 = 0 then case when p_partkey % 5 = 0 then '.NET assembly' else 'PE image' end else 'ZIP archive' end as format,
  case p_size % 5 when 0 then 'x86' when 1 then 'x64' when 2 then 'ARM' when 3 then 'ARM64' else '0x0' || (200 + p_size % 10) end as architecture from part
""")
def image_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image decides by itself; machine codes have labels or their hexadecimal."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    image = F.when(k % 3 == 0, F.struct((k % 2 == 0).alias("is_library"), (k % 5 == 0).alias("is_managed")))
    kind = classify.classify_with_image(F.concat("p_name", F.lit(".zip")), F.unhex(F.lit("504B0304")), image)
    codes = F.array(*(F.lit(c) for c in classify.ARCHITECTURES))
    other = F.conv(F.concat(F.lit("2"), F.lpad((F.col("p_size") % 10).cast("string"), 2, "0")), 16, 10).cast("int")
    machine = F.when(F.col("p_size") % 5 < 4, F.element_at(codes, (F.col("p_size") % 5 + 1).cast("int"))).otherwise(other)
    return p.select("p_partkey", kind["category"].alias("category"), kind["format"].alias("format"), classify.architecture(machine).alias("architecture"))


@query("""
with n as (select doc_id, case doc_id % 4 when 0 then source || '.' || lang when 1 then source || ' ' || lang when 2 then repeat('n', cast(doc_id % 600 as int)) else 'Ünï_' || doc_id || '-x' end as name from documents)
select doc_id, length(name) <= 256 and regexp_full_match(name, '[\\p{L}\\p{Nd}._-]+') as safe from n
""")
def assembly_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names that may stand as an assembly's."""
    k = F.col("doc_id")
    name = F.when(k % 4 == 0, F.concat("source", F.lit("."), "lang")).when(k % 4 == 1, F.concat("source", F.lit(" "), "lang")).when(k % 4 == 2, F.repeat(F.lit("n"), (k % 600).cast("int"))).otherwise(F.concat(F.lit("Ünï_"), k.cast("string"), F.lit("-x")))
    return read(spark, sf_dir, "documents").select("doc_id", text.is_safe_assembly_name(name).alias("safe"))


@query("""
with f as (select p_name || p_partkey % 150 || case when p_size % 3 = 0 then '.txt' else '.CS' end as path from part),
i as (select o_orderkey as owner, lower(p_name) || p_partkey % 150 || '.cs' as path from orders join part on p_partkey = o_custkey % 150 + 1)
select owner, max(f.path) as file from i join f on upper(f.path) = upper(i.path) group by owner, i.path having count(*) = 1
""")
def exact_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Includes that match exactly one source file."""
    p = read(spark, sf_dir, "part")
    tag = (F.col("p_partkey") % 150).cast("string")
    paths_of = p.select(F.concat("p_name", tag, F.when(F.col("p_size") % 3 == 0, ".txt").otherwise(".CS")).alias("path"))
    named = p.select((F.col("p_partkey") - 1).alias("k"), F.concat(F.lower("p_name"), tag, F.lit(".cs")).alias("path"))
    includes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("owner"), (F.col("o_custkey") % 150).alias("k")).join(named, "k").select("owner", "path")
    return resolve.exact_include(includes, paths_of, ".cs")


@query("""
with f as (select c_custkey as address, c_custkey % 7 = 0 as external from customer)
select o_custkey as id, o_orderkey as site, o_custkey + 3 as address from orders where o_custkey + 3 in (select address from f where not external)
""")
def known_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of functions that are known and not external."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("site"), (F.col("o_custkey") + 3).alias("address"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("address"), (F.col("c_custkey") % 7 == 0).alias("external"))
    return native.pseudocode_of_functions(o, c.join(o.select("id", "address").distinct(), "address"))


@query("""
with a as (select distinct p_brand as assembly from part), r as (select p_brand as assembly, lower('Brand#' || (11 + p_size)) as name from part)
select distinct r.assembly, a.assembly as target from r join a on upper(a.assembly) = upper(r.name) where r.assembly <> a.assembly
""")
def package_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to other assemblies of the package."""
    p = read(spark, sf_dir, "part")
    return skeletons.package_local_references(p.select(F.col("p_brand").alias("assembly")), p.select(F.col("p_brand").alias("assembly"), F.lower(F.concat(F.lit("Brand#"), (F.col("p_size") + 11).cast("string"))).alias("name")))


@query("select o_orderkey, o_custkey from orders where (select count(*) <= 1000000000 from orders)")
def fail_all_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows, or the failure of the whole job; the tests let it fail."""
    return ordering.require_budget(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 1_000_000_000, 1 << 60)


@query("""
with t as (select doc_id, repeat('😀', cast(doc_id % 5 as int)) || left(lang || source, 6) || '😀' as s from documents)
select doc_id, case when length(s) + doc_id % 5 + 1 <= 8 then s else left(s, cast(case when 2 * (doc_id % 5) >= 8 then 4 else doc_id % 5 + least(8 - 2 * (doc_id % 5), length(s) - doc_id % 5 - 1) end as int)) end as cut from t
""")
def utf16_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut by UTF-16 units, never inside a pair."""
    k = F.col("doc_id")
    s = F.concat(F.repeat(F.lit("😀"), (k % 5).cast("int")), F.substring(F.concat("lang", "source"), 1, 6), F.lit("😀"))
    return read(spark, sf_dir, "documents").select("doc_id", s.alias("s")).select("doc_id", text.utf16_prefix(F.col("s"), 8).alias("cut"))


@query("""
with r as (select o_custkey as file, case when o_custkey % 10 = 3 then 'short' else sha256(cast(o_custkey as varchar)) end as sha256, case when o_orderkey % 3 = 0 then 'failed' else 'success' end as status,
  case when o_orderkey % 3 <> 0 then repeat('x', cast(o_orderkey % 40 as int)) when o_orderkey % 90 = 0 then 'code' end as code from orders)
select file, bool_and(length(sha256) = 64 and (status = 'success') = (code is not null) and coalesce(length(code), 0) <= 38) and sum(coalesce(length(code), 0)) <= 400 as ok from r group by file
""")
def pseudocode_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: whether all rows of a file are well formed and within their budget."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    digest = F.when(F.col("o_custkey") % 10 == 3, "short").otherwise(F.sha2(F.col("o_custkey").cast("string"), 256))
    code = F.when(k % 3 != 0, F.repeat(F.lit("x"), (k % 40).cast("int"))).when(k % 90 == 0, "code")
    return validate.pseudocode_evidence(o.select(F.col("o_custkey").alias("file"), digest.alias("sha256"), F.when(k % 3 == 0, "failed").otherwise("success").alias("status"), code.alias("code")), 38, 400)


@query("""
with k as (select o_custkey as section, o_orderkey as key_ord, o_orderkey * 5 + case when o_custkey % 4 = 0 then o_orderkey % 3 * 1000000000 else 0 end as low from orders)
select section, list(low order by key_ord) = list(low order by low) and section % 6 <> 0 as ok from k group by section
""")
def children_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys' positions, in their order, against the owner's children."""
    k = F.col("o_orderkey")
    low = k * 5 + F.when(F.col("o_custkey") % 4 == 0, k % 3 * 1_000_000_000).otherwise(0)
    ranges = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("section"), k.alias("key_ord"), low.alias("low"))
    return resources.direct_children_agree(ranges, ranges.select("section", (F.col("low") + F.when(F.col("section") % 6 == 0, 1).otherwise(0)).alias("start")))


@query("""
with r as (select o_custkey as section, o_orderkey as key_ord, o_orderkey * 10 as low, o_orderkey * 10 + 30 as high, o_orderkey % 8 <> 0 as ok from orders),
p as (select o_custkey as section, o_orderkey * 10 + 7 as "offset", o_orderkey % 3 as local_id from orders),
l as (select o_custkey as section, o_orderkey as key_ord, o_orderkey % 2 as local_id, o_orderpriority as value from orders)
select p.section, r.key_ord, p."offset", p.local_id, l.value, l.value is not null as complete from p join r on r.section = p.section and r.ok and p."offset" >= r.low and p."offset" < r.high
  left join l on l.section = r.section and l.key_ord = r.key_ord and l.local_id = p.local_id
""")
def local_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to the values of the range that they lie in."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    at = F.col("o_custkey").alias("section")
    ranges = o.select(at, k.alias("key_ord"), (k * 10).alias("low"), (k * 10 + 30).alias("high"), (k % 8 != 0).alias("ok"))
    return resources.link_local_values(o.select(at, (k * 10 + 7).alias("offset"), (k % 3).alias("local_id")), ranges, o.select(at, k.alias("key_ord"), (k % 2).alias("local_id"), F.col("o_orderpriority").alias("value")))


@query("""
with b as (select doc_id, case when doc_id % 3 = 0 then chr(65279) || left(text, 3000) else left(text, 3000) end as t, doc_id % 4 = 1 as broken from documents)
select doc_id, case when not broken and strlen(t) <= 2000 then md5(case when doc_id % 3 = 0 then substr(t, 2) else t end) end as digest from b
""")
def source_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are UTF-8 throughout and within the bound, without their mark."""
    k, head = F.col("doc_id"), F.substring("text", 1, 3000)
    t = F.when(k % 3 == 0, F.concat(F.lit("﻿"), head)).otherwise(head).cast("binary")
    broken = F.when(k % 4 == 1, F.concat(t, F.lit(bytearray(b"\xff")))).otherwise(t)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(files.source_text(broken, 2000)).alias("digest"))


@query("""
select p_partkey, 10 as start, case p_size % 5 when 0 then 40 when 1 then 30 when 2 then 25 when 3 then 1014 end as content_end,
  case p_size % 5 when 1 then 'the content does not end where its owner does' when 2 then 'the content ends at no element''s end' when 3 then 'the content leaves the data' when 4 then 'the size is malformed' end as error from part
union all select p_partkey, 24, 30, case when p_size % 5 = 0 then 'sections overlap' end from part
""")
def deferred_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections against the stream, the element ends, their owners and each other; here, two sections in
    two nested elements for each part."""
    number = F.when(F.col("p_size") % 5 == 0, 25).when(F.col("p_size") % 5 == 1, 15).when(F.col("p_size") % 5 == 2, 10).when(F.col("p_size") % 5 == 3, 999)
    laid = [(3, 0, 4, None), (37, 10, 15, number), (3, 20, 24, None), (37, 24, 29, F.lit(1)), (4, 30, 31, None), (4, 40, 41, None)]
    row = lambda i, t, a, b, n: F.struct(F.lit(i).alias("ord"), F.lit(t).alias("type"), F.lit(a).alias("start"), F.lit(b).alias("stop"), (F.lit(None) if n is None else n).cast("int").alias("number"))
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    records = p.select("id", F.explode(F.array(*(row(i, *r) for i, r in enumerate(laid)))).alias("r")).select("id", "r.*")
    found = deferred.sections(records, p.select("id", F.lit(41).alias("size")))
    return found.select(F.col("id").alias("p_partkey"), F.col("section.start").alias("start"), "content_end", "error")


def order_headers(spark: SparkSession, sf_dir: str) -> deferred.Headers:
    """A section for each order: one or two keys, local resources, and in some what a header can't hold."""
    k = F.col("o_orderkey")
    laid = [(55, k % 7 == 0), (38, F.lit(True)), (55, k % 3 > 0), (55, k % 3 > 1), (39, k % 2 == 0), (55, k % 5 == 0), (50, k % 11 == 5), (3, F.lit(True)), (4, F.lit(True))]
    row = lambda i, t, kept: F.when(kept, F.struct(F.lit(i).alias("ord"), F.lit(t).alias("type"), F.lit(i * 10).alias("start"), F.lit(i * 10 + 5).alias("stop"), F.lit(20 if t == 39 else 0).alias("number"), (k % 100).cast("int").alias("ref"), F.lit(0).alias("flags")))
    o = read(spark, sf_dir, "orders")
    records = o.select(k.alias("id"), F.explode(F.array_compact(F.array(*(row(i, *r) for i, r in enumerate(laid))))).alias("r")).select("id", "r.*")
    sound = o.select(k.alias("id"), F.struct(k.alias("id"), F.lit(0).alias("start")).alias("section"), F.lit(0).alias("ord"), F.lit(0).cast("long").alias("content_start"), F.lit(100).cast("long").alias("content_end"))
    return deferred.headers(records, sound)


@query("""
with o as (select o_orderkey as k from orders where o_orderkey % 7 <> 0 and o_orderkey % 11 <> 5)
select k as id, 0 as key_ord, 'string' as kind, k % 100 as ref, 0 as position, 70 as content_start, k % 3 + case when k % 2 = 1 and k % 5 = 0 then 1 else 0 end as locals from o
union all select k, 1, 'type', k % 100, 20, 70, case when k % 5 = 0 then 1 else 0 end from o where k % 2 = 0
""")
def deferred_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of headers, with the number of resources local to each."""
    h = order_headers(spark, sf_dir)
    local = h.local.groupBy("section", "key_ord").agg(F.count("*").alias("locals"))
    return h.keys.join(local, ["section", "key_ord"], "left").select("id", "key_ord", "kind", "ref", "position", "content_start", F.coalesce("locals", F.lit(0)).alias("locals"))


@query("""
with s as (select o_orderkey as k, o_orderkey % 7 <> 0 and o_orderkey % 11 <> 5 as good from orders),
e as (select k, case when good then 1 else 0 end as keys, case when k % 7 = 0 then 'a local resource has no key' when not good then 'a record does not belong in the header' when k % 2 = 0 then 'more than 1 keys' when k % 13 = 0 then 'the element tree is incomplete' when k % 17 = 0 then 'property values were cut' end as error from s)
select k as id, keys, error is null as complete, error from e
""")
def deferred_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error of each stream, a cap on keys, and what makes a stream incomplete."""
    h, k = order_headers(spark, sf_dir), F.col("o_orderkey")
    kept, over = deferred.cap_keys(h.keys, 1)
    streams = read(spark, sf_dir, "orders").select(k.alias("id"), (k % 13 != 0).alias("tree_complete"), (k % 17 == 0).alias("values_truncated"))
    return deferred.status(streams, kept, h.errors, over)


@query("""
select distinct a.o_custkey as id, a.o_orderkey as ord, 'a reference has no property scope' as error from orders a join orders b on a.o_custkey = b.o_custkey and b.o_orderkey % 4 <> 0 and a.o_orderkey * 10 + 7 >= b.o_orderkey * 10 and a.o_orderkey * 10 + 7 < b.o_orderkey * 10 + 30 where a.o_orderkey % 3 <> 0
""")
def unscoped_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in a value's range that lie in no property scope."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    at = o.select(F.col("o_custkey").alias("id"), k.alias("ord"), (k * 10 + 7).alias("offset"))
    ranges = o.where(k % 4 != 0).select(F.col("o_custkey").alias("id"), (k * 10).alias("low"), (k * 10 + 30).alias("high"))
    return deferred.unscoped_references(at, ranges, at.where("ord % 3 = 0"))
