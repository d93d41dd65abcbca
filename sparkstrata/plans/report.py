"""Sinks: one JSON document, a Markdown report of bounded sections, and a safe writer.

A report's sections are limited before they leave the executors, so what reaches the driver does not
grow with the package; the JSON document of a run is written by Spark, one line a run.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_units, markdown_cell
from ..operators.ordering import top_per_group
from ..sources import native as native_documents
from ..sources.images import resources_table
from .analysis import SCHEMA_VERSION, Analysis, summary, warnings

#: Rows shown of each section.
LIMITS = {"entry points": 200, "files": 500, "dependencies": 1000, "warnings": 500, "components": 200, "references": 500, "types": 20, "calls": 30, "archives": 50, "source projects": 200, "source declarations": 200, "source calls": 500, "native functions": 100, "native calls": 100, "resources": 30}
#: Files that sections with a table for each file show.
MAX_FILES_SHOWN = 500


@dataclass
class SourceIndex:
    """What a compiler said of source text: projects (project, files, declarations, calls, errors, complete, notes,
    error_codes), declarations (project, file, line, kind, name), calls (file, line, caller, target, status,
    target_project)."""

    projects: DataFrame
    declarations: DataFrame
    calls: DataFrame
    truncated: bool = False


def _table(names: Sequence[str], rows: Sequence[Sequence[str]], limit: int) -> list[str]:
    out = ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    out += ["| " + " | ".join(r) + " |" for r in rows[:limit]]
    return out + (["", f"Only the first {limit} rows are shown; the tables hold all."] if len(rows) > limit else [])


def section(title: str, rows: DataFrame, columns: Sequence[tuple[str, Column]], order: Sequence[Column], limit: int) -> str:
    """A table of the first rows in the given order, and a line on what is left out."""
    cells = [markdown_cell(c.cast("string")).alias(f"c{i}") for i, (_, c) in enumerate(columns)]
    shown = rows.orderBy(*order).limit(limit + 1).select(*cells).collect()
    lines = [f"## {title}", ""]
    if not shown:
        return "\n".join([*lines, "None.", ""])
    return "\n".join([*lines, *_table([n for n, _ in columns], shown, limit), ""])


def file_sections(title: str, rows: DataFrame, columns: Sequence[tuple[str, Column]], order: Sequence[Column], limit: int) -> str:
    """For each of the first files (``id``, in the canonical order) a table of its first rows."""
    wanted = rows.select("id").distinct().orderBy(F.upper("id"), "id").limit(MAX_FILES_SHOWN + 1)
    files = [r.id for r in wanted.collect()]
    lines = [f"## {title}", ""]
    if not files:
        return "\n".join([*lines, "None.", ""])
    cells = [markdown_cell(c.cast("string")).alias(f"c{i}") for i, (_, c) in enumerate(columns)]
    shown: dict[str, list] = {}
    first = top_per_group(rows.join(wanted, "id", "left_semi"), ["id"], list(order), limit + 1)
    for r in first.select("id", "rn", *cells).collect():
        shown.setdefault(r.id, []).append(r[1:])
    for f in files[:MAX_FILES_SHOWN]:
        lines += [f"### `{' '.join(f.replace('`', chr(39)).split())}`", "", *_table([n for n, _ in columns], [r[1:] for r in sorted(shown[f])], limit), ""]
    if len(files) > MAX_FILES_SHOWN:
        lines += [f"Only the first {MAX_FILES_SHOWN} files are shown; the tables hold all.", ""]
    return "\n".join(lines)


def source_sections(s: SourceIndex) -> list[str]:
    """K2: the source index: projects with their state, declarations and calls."""
    c = F.col
    state = F.when(F.col("complete"), "complete").otherwise("incomplete")
    some = lambda x, shown: F.when(F.size(x) > 0, shown)
    told = F.concat_ws("; ", state, some("notes", F.array_join("notes", "; ")), some("error_codes", F.concat(F.lit("errors "), F.array_join("error_codes", ", "))))
    place = F.concat("file", F.lit(":"), F.col("line").cast("string"))
    status = F.when((c("status") == "resolved-source") & c("target_project").isNotNull(), F.concat(F.lit("resolved in "), c("target_project"))).otherwise(c("status"))
    out = [section("Source index", s.projects, [("Project", c("project")), ("Files", c("files")), ("Declarations", c("declarations")), ("Calls", c("calls")), ("Errors", c("errors")), ("State", told)], [F.upper("project"), c("project")], LIMITS["source projects"])]
    if s.truncated:
        out.append("The index was cut at its bound: what is not listed may still exist.\n")
    out.append(section("Source declarations", s.declarations, [("Project", c("project")), ("Place", place), ("Kind", c("kind")), ("Name", c("name"))], [c("project"), c("file"), c("line"), c("name")], LIMITS["source declarations"]))
    out.append(section("Source calls", s.calls, [("Place", place), ("Caller", c("caller")), ("Target", c("target")), ("Status", status)], [c("file"), c("line"), c("caller"), c("target")], LIMITS["source calls"]))
    return out


def native_sections(documents: DataFrame) -> list[str]:
    """K2: functions and calls of disassembled files: documents (id, native)."""
    c = F.col
    functions, calls = native_documents.functions_table(documents), native_documents.calls_table(documents)
    kind = F.when(c("tail"), "tail").when(c("indirect"), "indirect").otherwise("direct")
    refused = documents.where("native.status <> 'ok' or native.truncated or native.calls_truncated").select("id", F.coalesce("native.error", F.lit("cut at its bound")).alias("state"))
    return [
        file_sections("Native functions", functions, [("Address", c("address")), ("Name", c("name")), ("Signature", c("signature")), ("External", c("external"))], [c("ord")], LIMITS["native functions"]),
        file_sections("Native calls", native_documents.display_names(calls, functions), [("Site", c("site")), ("Caller", c("caller_shown")), ("Target", c("target_shown")), ("Kind", kind)], [c("ord")], LIMITS["native calls"]),
        section("Incomplete native documents", refused, [("File", c("id")), ("State", c("state"))], [F.upper("id"), c("id")], LIMITS["warnings"]),
    ]


def archive_section(archives: DataFrame) -> str:
    """K2: what became of each archive that was expanded."""
    c = F.col
    state = F.when(F.col("complete"), "complete").otherwise(F.concat_ws(": ", F.lit("incomplete"), "error"))
    return section("Archives", archives, [("Archive", c("container")), ("Depth", c("depth")), ("Files", c("files")), ("Unpacked", c("unpacked")), ("Links", c("links")), ("State", state)], [c("depth"), F.upper("container"), c("container")], LIMITS["archives"])


#: The report's last section.
BOUNDS = """## Limits

Nothing of the input was run. Languages and frameworks are inferred from the layout of files, their dependencies
and marks in their bytes, which is no proof; packing, obfuscation, code loaded at run time and unknown containers
leave gaps. A row that is missing from a table that was cut is not a row that does not exist.
"""


def markdown(a: Analysis, name: str, sources: SourceIndex | None = None, native: DataFrame | None = None) -> str:
    """K2: the report of one package; ``sources`` and ``native`` (id, native) add what other tools found."""
    c, s = F.col, summary(a).first().asDict()
    head = [f"# {name}", "", f"- Generated: {datetime.now(timezone.utc):%Y-%m-%d %H:%M:%S} UTC", "", "## Summary", "", "| Item | Count |", "| --- | ---: |"]
    head += [f"| {k.replace('_', ' ')} | {v} |" for k, v in s.items()]
    technologies = section("Technologies", a.package_technologies, [("Technology", c("name")), ("Category", c("category")), ("Confidence", F.format_string("%.0f %%", c("confidence") * 100)), ("Evidence", F.array_join("evidence", "; "))], [F.desc("confidence"), F.upper("name")], 200)
    entry = section("Entry points", a.files.where("is_executable"), [("File", c("relative_path")), ("Format", c("format")), ("Architecture", c("architecture"))], [F.upper("relative_path"), c("relative_path")], LIMITS["entry points"])
    files = section("Files", a.files, [("File", c("relative_path")), ("Category", c("category")), ("Format", c("format")), ("Size", byte_units(c("size")))], [F.upper("relative_path"), c("relative_path")], LIMITS["files"])
    deps = section("Dependencies", a.dependencies, [("Source", c("source")), ("Kind", c("kind")), ("Target", c("target")), ("Inside", c("resolved_inside_package"))], [F.upper("source"), c("kind"), F.upper("target")], LIMITS["dependencies"])
    components = section("Components", a.components, [("Component", c("id")), ("Kind", c("kind")), ("Framework", c("target_framework"))], [c("id")], LIMITS["components"])
    refs = section("References", a.references, [("Source", c("source")), ("Target", c("target")), ("Kind", c("kind")), ("Status", c("status")), ("Version", c("version"))], [c("source"), c("target"), c("kind")], LIMITS["references"])
    types = file_sections("Types with most methods", a.types, [("Type", c("full_name")), ("Methods", c("method_count"))], [F.desc("method_count"), c("full_name"), c("token")], LIMITS["types"])
    token = lambda k: F.concat(F.lit("0x"), F.lpad(F.hex(c(k)), 8, "0"))
    calls = file_sections("Calls", a.calls, [("Caller", token("caller")), ("Callee", token("callee")), ("Kind", c("kind"))], [c("ord")], LIMITS["calls"])
    held = file_sections("Manifest resources", resources_table(a.images).drop("content"), [("Name", c("name")), ("Kind", c("kind")), ("Visibility", c("visibility")), ("Place", c("location")), ("Size", byte_units(c("size"))), ("Error", c("error"))], [c("ord")], LIMITS["resources"])
    warned = section("Warnings", warnings(a), [("File", c("file")), ("Warning", c("warning"))], [c("file")], LIMITS["warnings"])
    return "\n".join(["\n".join([*head, ""]), technologies, entry, components, refs, files, deps, *([archive_section(a.archives)] if a.archives is not None else []), types, calls, held, *(source_sections(sources) if sources else []), *(native_sections(native) if native is not None else []), warned, BOUNDS])


def document(a: Analysis, name: str, mode: str = "full") -> DataFrame:
    """K1: one row with the nested document as JSON (column ``value``).  Its arrays hold a whole package:
    that is the format; the tables of the analysis are what to store at scale."""
    listed = lambda df, alias, key: df.agg(F.sort_array(F.collect_list(F.struct(*key, F.struct("*").alias("row")))).alias("x")).select(F.transform("x", lambda r: r["row"]).alias(alias))
    parts = [
        listed(a.files.drop("origin"), "files", ["id"]),
        listed(a.package_technologies, "technologies", ["id"]),
        listed(a.dependencies, "dependencies", ["source", "kind", "target"]),
        listed(a.components, "components", ["id"]),
        listed(a.references, "references", ["source", "target", "kind"]),
        summary(a).select(F.struct("*").alias("summary")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    head = F.struct(F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(name).alias("name"), F.lit(mode).alias("analysisMode"), "summary", "files", "technologies", "dependencies", "components", "references")
    return out.select(F.to_json(head, {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def write_text(path: str, content: str, force: bool = False) -> None:
    """K3, K8: write beside the target, then move into place; links are never written through, and an
    existing file only with ``force``."""
    folder = os.path.dirname(os.path.abspath(path))
    if os.path.islink(path) or os.path.islink(folder):
        raise ValueError(f"{path} is a link")
    if os.path.exists(path) and not force:
        raise FileExistsError(path)
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, prefix=".writing-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as f:
            f.write(content if content.endswith("\n") else content + "\n")
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def write_project(files: Sequence[tuple[str, str]], root: str, force: bool = False) -> None:
    """All paths are checked before any file is written."""
    from ..sources.archives import check_conflicts, checked_path

    planned = [(checked_path(p), content) for p, content in files]
    check_conflicts([p for p, _ in planned])
    if not force:
        for p, _ in planned:
            if os.path.exists(os.path.join(root, p)):
                raise FileExistsError(p)
    for p, content in planned:
        write_text(os.path.join(root, p), content, force)
