"""The analysis of a package: from its files to tables, a summary and one document.

``analyze`` composes scans, classification, detection, dependency resolution and the project graph.  What
is parsed from files, and the graph made of it, is written once; all else are lazy tables; ``document`` assembles one nested row, which is the only place where a run's rows meet.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, detect
from ..operators.graph import union_all
from ..operators.ordering import require_budget
from ..operators.resolve import complete_endpoints, nearest_candidate
from ..operators.validate import check_ranges
from ..sources import archives, files, images, projects
from .stored import stored

SCHEMA_VERSION = "1.0"
#: Ranges of the options.
RANGES = {"max_files": (1, 10_000_000), "max_total_bytes": (1, 1 << 50), "max_file_bytes": (1, 1 << 40), "max_archive_depth": (0, 64)}


@dataclass
class Options:
    inventory_only: bool = False
    source_mode: bool = False
    max_files: int = files.MAX_FILES
    max_total_bytes: int = files.MAX_TOTAL_BYTES
    max_file_bytes: int = files.MAX_FILE_BYTES
    max_archive_depth: int = archives.MAX_DEPTH


@dataclass
class Analysis:
    """Tables of one run; ``images`` holds nested columns from which types and calls are exploded."""

    files: DataFrame
    archives: DataFrame | None
    images: DataFrame
    technologies: DataFrame
    package_technologies: DataFrame
    dependencies: DataFrame
    types: DataFrame
    calls: DataFrame
    components: DataFrame
    references: DataFrame
    declarations: DataFrame


def read_input(spark: SparkSession, path: str, options: Options) -> tuple[DataFrame, DataFrame | None]:
    """A ZIP, known by its first bytes, a solution or project (its directory's sources), or a directory or
    single file with its nested archives."""
    directory_ = files.qualified(spark, path)[1]
    if not directory_ and path.lower().endswith((".sln", ".slnx", *projects.PROJECT_SUFFIXES)):
        path, directory_ = path.rstrip("/").rpartition("/")[0] or ".", True
        options = replace(options, source_mode=True)
    first = None if directory_ else spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4).alias("h")).head()
    if first and bytes(first.h) in (b"PK\x03\x04", b"PK\x05\x06"):
        raw = spark.read.format("binaryFile").load(path).select(F.lit("").alias("id"), "content")
        entries = archives.expand_zip(raw)
        broken = entries.where("status = 'invalid'").select("error").head()
        if broken:
            raise ValueError(f"the archive is refused: {broken.error}")
        rows = entries.select(F.col("path").alias("id"), F.col("path").alias("relative_path"), "size", "content", files.origin("zip", F.col("container"), F.col("path")).alias("origin"))
    else:
        rows = files.scan(spark, path, options.source_mode, max_file_bytes=options.max_file_bytes).drop("file_name")
        if path.lower().endswith(".exe"):  # S9: an executable's own library beside it
            beside = files.scan(spark, path.rstrip("/").rpartition("/")[0] or ".", max_file_bytes=options.max_file_bytes).where(~F.contains("relative_path", F.lit("/")))
            host = path.rstrip("/").rpartition("/")[2]
            own = files.app_host_sidecars(beside).where(F.col("host") == host).select("id")
            rows = rows.unionByName(beside.drop("file_name").join(own, "id", "left_semi"))
    require_budget(rows.select("size"), "size", options.max_files, options.max_total_bytes)
    expanded, containers = archives.expand_nested(rows, options.max_archive_depth) if options.max_archive_depth else (rows, None)
    return expanded, containers


def analyze_tables(rows: DataFrame, containers: DataFrame | None, options: Options) -> Analysis:
    """rows: id, relative_path, size, content, origin."""
    image = images.image(with_code=not options.inventory_only)
    named = rows.withColumn("file_name", F.element_at(F.split(F.replace("relative_path", F.lit("\\"), F.lit("/")), "/"), -1))
    seen = named.withColumn("image", image(F.col("content"))).withColumn("sample", detect.signal_sample(F.col("content"))).withColumn("bundle", images.bundle_marker(F.col("content")))
    kind = classify.classify_with_image(F.col("relative_path"), F.substring("content", 1, 64), F.when(F.col("image").isNotNull(), F.struct(F.col("image.is_library").alias("is_library"), F.col("image.is_managed").alias("is_managed"))))
    found = detect.findings(detect.file_rules(F.col("relative_path"), F.col("image"), F.col("bundle"), F.col("sample")))
    parsed = seen.select(
        "id",
        "relative_path",
        "file_name",
        "size",
        F.sha2("content", 256).alias("sha256"),
        kind.alias("k"),
        F.coalesce("image.is_managed", F.lit(False)).alias("is_managed"),
        F.coalesce("image.is_executable", F.lit(False)).alias("is_executable"),
        classify.architecture(F.col("image.machine")).alias("architecture"),
        F.col("image.assembly_name").alias("assembly_name"),
        F.col("image.error").alias("error"),
        F.coalesce(F.size("image.types"), F.lit(0)).alias("type_count"),
        F.coalesce(F.aggregate("image.types", F.lit(0), lambda n, t: n + F.size(t["methods"])), F.lit(0)).alias("method_count"),
        found.alias("found"),
        "origin",
        "image",
        F.when(projects.is_descriptor(F.col("relative_path"), F.col("file_name")), F.col("content")).alias("descriptor"),
    )
    # Every file is read and parsed once; all tables below are made of what was written.
    parsed = stored(parsed, "parsed")
    containers = None if containers is None else stored(containers, "archives")
    table = parsed.drop("image", "descriptor").select("*", "k.category", "k.format", F.transform("found", lambda d: d["id"]).alias("technologies")).drop("k")
    detections = table.select("id", F.posexplode("found").alias("ord", "d")).select(F.col("id").alias("file"), "ord", "d.*")
    merged = detect.merge(detections, ["file"], "ord")
    everything = detections.select(F.lit(0).alias("run"), "id", "name", "category", "confidence", "evidence", F.struct(F.lit(0).alias("a"), F.col("file").alias("f"), F.col("ord").alias("o")).alias("place"))
    package = detect.package_detections(table.withColumn("run", F.lit(0)), ["run"]).select("run", "id", "name", "category", "confidence", "evidence", F.struct(F.lit(1).alias("a"), F.lit("").alias("f"), F.col("ord").alias("o")).alias("place"))
    both = everything.unionByName(package).withColumn("ord", F.xxhash64("place") * 0 + F.col("place.a") * 1_000_000 + F.col("place.o"))
    whole = detect.merge(both, ["run"], "ord").drop("run").orderBy(F.desc("confidence"), F.upper("name"))
    described = parsed.select("id", "image")
    refs = images.references_table(described)
    resolved = nearest_candidate(refs, table.select("id", "file_name", "assembly_name", "relative_path", "origin")).withColumnRenamed("resolved", "resolved_inside_package")
    dependencies = stored(resolved, "dependencies").orderBy(F.upper("source"), "kind", F.upper("target"))
    named = table.select("id", "relative_path", "file_name")
    declared = stored(projects.declared(parsed.select("relative_path", "file_name", F.col("descriptor").alias("content"))), "declared")
    values = projects.property_values(declared)
    sources = stored(projects.components(named, values), "sources")
    binaries = table.where(F.col("category").isin("executable", "library")).select("id", F.col("file_name").alias("name"), F.when(F.col("is_managed"), "managed-assembly").otherwise("native-binary").alias("kind"))
    components = union_all(sources, binaries)
    edges = dependencies.withColumnRenamed("resolved_inside_package", "resolved")
    ends = complete_endpoints(components.select("id", "kind"), edges).where("kind = 'package-file'")
    references = stored(union_all(projects.references(declared, named), edges.select("source", "target", "kind", F.when(F.col("resolved"), "resolved").otherwise("external").alias("status"))).distinct(), "references")
    return Analysis(table.drop("found"), containers, described, merged, whole, dependencies, images.types_table(described), images.calls_table(described), stored(union_all(components, ends), "components").orderBy("id"), references.orderBy("source", "target", "kind"), declared)


def analyze(spark: SparkSession, path: str, options: Options | None = None) -> Analysis:
    options = options or Options()
    check_ranges(vars(options), RANGES)
    rows, containers = read_input(spark, path, options)
    return analyze_tables(rows, containers, options)


def summary(a: Analysis) -> DataFrame:
    """A1: twelve counts of one package."""
    c = F.col
    left = a.files.agg(
        F.count("*").alias("file_count"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"),
        F.count_if("is_executable").alias("executables"),
        F.count_if(c("category") == "library").alias("libraries"),
        F.count_if("is_managed").alias("managed_assemblies"),
        F.count_if(c("category").isin("executable", "library") & ~c("is_managed")).alias("native_images"),
        F.count_if(c("category") == "archive").alias("archives"),
        F.count_if(c("category") == "configuration").alias("configurations"),
        F.count_if(c("category") == "resource").alias("resources"),
        F.coalesce(F.sum("type_count"), F.lit(0)).alias("types"),
        F.coalesce(F.sum("method_count"), F.lit(0)).alias("methods"),
    )
    right = a.dependencies.agg(F.count_if("resolved_inside_package").alias("internal_dependencies"), F.count_if(~c("resolved_inside_package")).alias("external_dependencies"))
    return left.join(F.broadcast(right))  # one row each


def warnings(a: Analysis) -> DataFrame:
    """File, warning of images that could not be read whole and archives that were refused."""
    out = a.files.where("error is not null").select(F.col("id").alias("file"), F.col("error").alias("warning"))
    if a.archives is not None:
        out = out.unionByName(a.archives.where("not complete").select(F.col("container").alias("file"), F.col("error").alias("warning")))
    return out
