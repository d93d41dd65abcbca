"""File classification: a first-match cascade on extension and leading bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..functions.text import cascade

# Extensions of each category.
ARCHIVE = [".zip", ".7z", ".rar", ".cab", ".jar", ".nupkg", ".appx", ".msix", ".asar"]
CONFIGURATION = [".config", ".json", ".xml", ".ini", ".yaml", ".yml", ".toml", ".properties", ".manifest"]
DATABASE = [".db", ".sqlite", ".sqlite3"]
PROJECT = [".csproj", ".vbproj", ".fsproj", ".vcxproj", ".sln", ".slnx"]
SOURCE = [".cs", ".vb", ".fs", ".c", ".cpp", ".h", ".hpp", ".rs", ".go", ".java"]
RESOURCE = [".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".wav", ".mp3", ".ogg", ".ttf", ".otf", ".resx", ".resources", ".dfm", ".pak", ".pck", ".dat"]
SCRIPT = [".ps1", ".bat", ".cmd", ".py", ".pyc", ".js", ".mjs", ".cjs", ".ts", ".lua", ".ahk", ".au3"]
#: Machine codes of executables.
ARCHITECTURES = {0x014C: "x86", 0x8664: "x64", 0x01C4: "ARM", 0xAA64: "ARM64"}


def is_zip(header: Column) -> Column:
    return F.hex(F.substring(header, 1, 4)).rlike("^504B0[357]0[468]$")


def is_compound_file(header: Column) -> Column:
    return F.hex(F.substring(header, 1, 8)) == "D0CF11E0A1B11AE1"


def classify(path: Column, header: Column) -> Column:
    """struct(category, format) by the first rule that holds; ``header`` is the file's leading bytes."""
    ext = F.lower(extension(path))
    bare = F.upper(F.regexp_replace(ext, r"^\.", ""))
    header = F.coalesce(header, F.lit(bytearray()))
    row = lambda category, form: F.struct(F.lit(category).alias("category"), form.alias("format"))
    named = lambda word: F.concat(bare, F.lit(f" {word}"))
    return cascade(
        (is_zip(header), row("archive", F.when(ext == ".jar", "Java archive").otherwise("ZIP archive"))),
        (ext.isin(ARCHIVE), row("archive", named("archive"))),
        ((ext == ".msi") & is_compound_file(header), row("archive", F.lit("Windows Installer package"))),
        (ext == ".pdb", row("debug-symbol", F.lit("Program Database"))),
        (ext.isin(DATABASE) | (F.hex(F.substring(header, 1, 16)) == b"SQLite format 3\0".hex().upper()), row("database", F.lit("SQLite/database file"))),
        (ext.isin(CONFIGURATION), row("configuration", named("configuration"))),
        (ext.isin(PROJECT), row("project", named("project"))),
        (ext.isin(SOURCE), row("source-code", named("source"))),
        (ext.isin(RESOURCE), row("resource", named("resource"))),
        (ext.isin(SCRIPT), row("script", named("script"))),
        otherwise=row("unknown", F.when(F.trim(bare) == "", "Unknown").otherwise(bare)),
    )


def classify_with_image(path: Column, header: Column, image: Column) -> Column:
    """As ``classify``, but an executable image (struct with is_library and is_managed) decides by itself."""
    kind = F.when(image["is_library"], "library").otherwise("executable")
    form = F.when(image["is_managed"], ".NET assembly").otherwise("PE image")
    return F.when(image.isNotNull(), F.struct(kind.alias("category"), form.alias("format"))).otherwise(classify(path, header))


def architecture(machine: Column) -> Column:
    """P5: a label for a machine code, or the code in hexadecimal."""
    out = F.concat(F.lit("0x"), F.lpad(F.hex(machine), 4, "0"))
    for code, label in ARCHITECTURES.items():
        out = F.when(machine == code, label).otherwise(out)
    return out
