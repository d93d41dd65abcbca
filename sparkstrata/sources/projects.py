"""Solutions and projects: what their files declare, and the graph of components and references.

Each descriptor is parsed once, inside an Arrow function, into declarations; everything that relates
files to each other (paths, shared properties, central versions, statuses) is a join of tables.
Document types are refused and nothing is evaluated: a value with an expression stays unevaluated.
"""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lazy import arrow_function
from ..functions.paths import directory, extension, resolve, stem
from ..functions.text import fold, is_literal
from ..operators.resolve import nearest_ancestor, package_versions, reference_status

DECLARATIONS = "struct<status:string,error:string,items:array<struct<kind:string,name:string,value:string,conditional:boolean,children:boolean>>>"
# Bounds on one descriptor, the first line of a solution, and its project lines.
MAX_BYTES, MAX_ITEMS, MAX_DEPTH = 1 << 20, 4096, 64
SOLUTION_HEADER = "Microsoft Visual Studio Solution File, Format Version"
SOLUTION_LINE = re.compile(r'^Project\("[^"]+"\)\s*=\s*"[^"]*",\s*"([^"]+)"')
PROJECT_SUFFIXES = (".csproj", ".vbproj", ".fsproj", ".vcxproj")
GUARDED = ("Choose", "When", "Otherwise", "Target")
#: Elements whose Include or Project attribute names something, with the kind of item they declare.
ITEMS = {"ProjectReference": "project-reference", "PackageReference": "package-reference", "PackageVersion": "package-version", "Compile": "compile", "Import": "import"}


class _Refused(ValueError):
    pass


def _item(kind: str, name: str | None, value: str | None, conditional: bool, children: bool = False) -> dict:
    return {"kind": kind, "name": name, "value": value, "conditional": conditional, "children": children}


def read_solution(text: str) -> list[dict]:
    """The projects that a text solution lists."""
    if not text.lstrip("﻿ \t\r\n").startswith(SOLUTION_HEADER):
        raise _Refused("not a solution file")
    paths = [m[1] for line in text.split("\n") if (m := SOLUTION_LINE.match(line.strip()))]
    paths = [p for p in paths if p.lower().endswith(PROJECT_SUFFIXES)]
    if len(paths) > MAX_ITEMS:
        raise _Refused("too many projects")
    return [_item("solution-project", None, p, False) for p in paths]


def read_xml(text: str) -> list[dict]:
    """Properties and items of a project, shared properties file or XML solution.

    An item is conditional if it or anything above it has a condition or stands in a guarded block.
    """
    out: list[dict] = []
    stack: list[dict] = []
    root_space: list[str] = []

    def start(full: str, attributes: dict[str, str]) -> None:
        space, _, name = full.rpartition("}")
        if not root_space:
            root_space.append(space)
        above = stack[-1]["conditional"] if stack else False
        conditional = above or "Condition" in attributes or name in GUARDED
        frame = {"name": name, "conditional": conditional, "text": [], "children": False, "item": None}
        if stack:
            stack[-1]["children"] = True
        if len(stack) >= MAX_DEPTH or len(out) >= MAX_ITEMS:
            raise _Refused("the descriptor is too large")
        if space == root_space[0]:
            if name == "Project" and stack and "Path" in attributes:
                out.append(_item("solution-project", None, attributes["Path"], conditional))
            elif name in ITEMS and stack:
                value = attributes.get("Project") if name == "Import" else attributes.get("Include") or attributes.get("Remove") or attributes.get("Update")
                kind = "compile-remove" if name == "Compile" and "Remove" in attributes else ITEMS[name]
                versions = [attributes[a] for a in ("VersionOverride", "Version") if a in attributes]
                frame["item"] = _item(kind, value, versions[0] if len(versions) == 1 else None, conditional, len(versions) > 1)
                out.append(frame["item"])
            elif stack and stack[-1]["item"] is not None and name in ("Version", "VersionOverride"):
                frame["version_of"] = stack[-1]["item"]
        stack.append(frame)

    def text_(data: str) -> None:
        if stack:
            stack[-1]["text"].append(data)

    def end(_: str) -> None:
        frame = stack.pop()
        value = "".join(frame["text"])
        if "version_of" in frame:
            item = frame["version_of"]
            if item["value"] is not None:
                item["children"] = True  # more than one version
            item["value"] = value.strip()
            item["conditional"] = item["conditional"] or frame["conditional"]
        elif stack and stack[-1]["name"] == "PropertyGroup" and frame["item"] is None:
            out.append(_item("property", frame["name"], value.strip(), frame["conditional"], frame["children"]))

    def refuse(*_: object) -> None:
        raise _Refused("document types are not read")

    parser = expat.ParserCreate(namespace_separator="}")
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text_
    parser.StartDoctypeDeclHandler = refuse
    try:
        parser.Parse(text, True)
    except expat.ExpatError as e:
        raise _Refused(str(e)) from e
    return out


def read_declarations(path: str, content: bytes | None) -> dict:
    if content is None or len(content) > MAX_BYTES:
        return {"status": "unread", "error": "the descriptor is too large", "items": []}
    try:
        text = content.decode("utf-8-sig")
        items = read_solution(text) if path.lower().endswith(".sln") else read_xml(text)
    except (_Refused, UnicodeDecodeError) as e:
        return {"status": "invalid", "error": str(e), "items": []}
    return {"status": "read", "error": None, "items": items}


@arrow_function(DECLARATIONS)
def declarations(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_declarations(p, c if c is None else bytes(c)) for p, c in zip(paths, contents, strict=True)], columns=["status", "error", "items"])


def _suffix(path: Column, *suffixes: str) -> Column:
    return F.lower(extension(path)).isin(*suffixes)


def is_descriptor(path: Column, name: Column) -> Column:
    """Solutions, projects and the files that projects below them share."""
    return _suffix(path, ".sln", ".slnx", *PROJECT_SUFFIXES) | fold(name).isin("DIRECTORY.BUILD.PROPS", "DIRECTORY.PACKAGES.PROPS")


def declared(files: DataFrame) -> DataFrame:
    """path, status, error, kind, name, value, conditional, children: every declaration of every descriptor."""
    wanted = files.where(is_descriptor(F.col("relative_path"), F.col("file_name")))
    read = wanted.select(F.col("relative_path").alias("path"), declarations(F.col("relative_path"), F.col("content")).alias("d"))
    return read.select("path", "d.status", "d.error", F.explode_outer("d.items").alias("i")).select("path", "status", "error", "i.*")


def property_values(items: DataFrame) -> DataFrame:
    """Path, name, status, value of each property: literal if declared once, plainly and without a
    condition; else conditional or unevaluated, without a value."""
    p = items.where("kind = 'property'").groupBy("path", "name").agg(F.count("*").alias("n"), F.bool_or("conditional").alias("cond"), F.bool_or("children").alias("kids"), F.max("value").alias("v"))
    status = F.when(F.col("cond"), "conditional").when((F.col("n") != 1) | F.col("kids") | ~is_literal_list(F.col("v")), "unevaluated").otherwise("literal")
    return p.select("path", "name", status.alias("status"), F.when(status == "literal", F.col("v")).alias("value"))


def is_literal_list(value: Column) -> Column:
    """A literal, or literals with semicolons between them (target frameworks)."""
    return is_literal(F.replace(value, F.lit(";"), F.lit(",")))


def inherited_property(projects: DataFrame, values: DataFrame, files: DataFrame, names: list[str], shared: str = "Directory.Build.props") -> DataFrame:
    """Of each project (path) the first of ``names`` that it declares, else that its nearest shared
    file declares.  A declared value that is not literal blocks inheritance: path, value, source, status."""
    rank = F.create_map(*(F.lit(v) for i, n in enumerate(names) for v in (n, i)))
    own = values.where(F.col("name").isin(names)).withColumn("rank", rank[F.col("name")]).groupBy("path").agg(F.min(F.struct("rank", "status", "value")).alias("o"))
    near = nearest_ancestor(projects.select(F.col("path").alias("id"), "path"), files.select(F.col("relative_path").alias("path")), shared).select(F.col("id").alias("path"), F.col("file").alias("shared"))
    up = own.select(F.col("path").alias("shared"), F.col("o").alias("u"))
    joined = projects.select("path").join(own, "path", "left").join(near, "path", "left").join(up, "shared", "left")
    chosen = F.when(F.col("o").isNotNull(), F.col("o")).otherwise(F.col("u"))
    return joined.select("path", chosen["value"].alias("value"), F.when(F.col("o").isNotNull(), F.col("path")).when(F.col("u").isNotNull(), F.col("shared")).alias("source"), chosen["status"].alias("status"))


def components(files: DataFrame, values: DataFrame) -> DataFrame:
    """Id, name, kind, output_type, target_framework of solutions and projects."""
    is_project = _suffix(F.col("relative_path"), *PROJECT_SUFFIXES)
    base = files.where(_suffix(F.col("relative_path"), ".sln", ".slnx", *PROJECT_SUFFIXES)).select(F.col("relative_path").alias("path"), stem(F.col("relative_path")).alias("name"), F.when(is_project, "source-project").otherwise("solution").alias("kind"))
    out = base
    for column, names in (("target_framework", ["TargetFrameworks", "TargetFramework"]), ("output_type", ["OutputType"]), ("assembly_name", ["AssemblyName"])):
        got = inherited_property(base.where("kind = 'source-project'"), values, files, names).select("path", F.col("value").alias(column))
        out = out.join(got, "path", "left")
    return out.withColumnRenamed("path", "id")


def references(items: DataFrame, files: DataFrame) -> DataFrame:
    """Source, target, kind, status, version of every reference that a descriptor declares."""
    r = items.where(F.col("kind").isin("solution-project", "project-reference"))
    raw = F.coalesce("name", "value")
    r = r.select(F.col("path").alias("source"), "kind", raw.alias("raw"), "conditional", F.when(is_literal(raw), resolve(directory(F.col("path")), raw)).alias("path"))
    targets = files.where(_suffix(F.col("relative_path"), *PROJECT_SUFFIXES)).select(F.col("relative_path").alias("path"), F.lit(True).alias("retained"))
    status = reference_status(r.select("source", "path", "conditional").distinct(), targets)
    same = (F.col("r.source") == F.col("s.source")) & F.col("r.path").eqNullSafe(F.col("s.path"))
    paths = r.alias("r").join(status.alias("s"), same).select("r.source", F.coalesce("s.target", "r.path", "r.raw").alias("target"), "r.kind", "s.status", F.lit(None).cast("string").alias("version"))
    packages = items.where("kind = 'package-reference'").select(F.col("path").alias("source"), F.col("name").alias("package"), "value", "conditional", "children")
    near = nearest_ancestor(packages.select(F.col("source").alias("id"), F.col("source").alias("path")).distinct(), files.select(F.col("relative_path").alias("path")), "Directory.Packages.props")
    central = items.where("kind = 'package-version'").select(F.col("path").alias("file"), F.col("name").alias("p"), "value", "conditional")
    declared_for = near.join(central, "file").select(F.concat_ws("\n", "id", "p").alias("package"), F.col("value").alias("version"), F.coalesce(is_literal(F.col("value")), F.lit(False)).alias("literal"), "conditional")
    looked = package_versions(packages.select("source", F.concat_ws("\n", "source", "package").alias("package")).distinct(), declared_for).select("source", F.element_at(F.split("package", "\n"), -1).alias("package"), F.col("version").alias("c_version"), F.col("status").alias("c_status"))
    p = packages.join(looked, ["source", "package"], "left")
    own = F.col("value").isNotNull() & ~F.col("children") & is_literal(F.col("value"))
    state = F.when(F.col("conditional"), "conditional").when(~is_literal(F.col("package")), "unevaluated").when(F.col("value").isNotNull() | F.col("children"), F.when(own, "external").otherwise("unevaluated")).when(F.col("c_status").isin("conditional", "unevaluated"), F.col("c_status")).otherwise("external")
    version = F.when(state == "external", F.when(own, F.col("value")).otherwise(F.col("c_version")))
    return paths.unionByName(p.select("source", F.col("package").alias("target"), F.lit("package-reference").alias("kind"), state.alias("status"), version.alias("version")))
