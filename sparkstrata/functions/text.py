"""Text predicates and derivations, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(value: Column) -> Column:
    """The key under which names compare and sort without case (upper case, as ``_`` sorts after letters there)."""
    return F.upper(value)


def is_literal(value: Column, longest: int = 2048) -> Column:
    """not blank, not too long, and free of characters that stand for evaluation or lists."""
    return (F.trim(value) != "") & (F.length(value) <= longest) & ~value.rlike(r"[$@%*?;\x00\r\n]")


def is_generated(name: Column) -> Column:
    """a name that a compiler made."""
    return F.contains(name, F.lit("<")) | F.contains(name, F.lit(">"))


def is_accessor(name: Column) -> Column:
    """accessor and operator methods, by the raw name."""
    return name.rlike("^(get|set|add|remove|op)_")


def last_segment(name: Column) -> Column:
    """What follows the last dot."""
    return F.element_at(F.split(name, "[.]"), -1)


def is_safe_assembly_name(name: Column) -> Column:
    """F10."""
    return (F.length(name) <= 256) & name.rlike(r"^[\p{L}\p{Nd}._-]+$")


#: Device names that no path segment may have.
RESERVED_SEGMENTS = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]


def is_portable_segment(segment: Column) -> Column:
    """usable as a file name on every common system."""
    stem = F.upper(F.split(segment, "[.]")[0])
    return (
        (segment != "")
        & ~segment.isin(".", "..")
        & ~segment.rlike(r'[\x00-\x1f<>:"|?*\\/]')
        & ~segment.rlike("[. ]$")
        & ~F.rtrim(stem).isin(RESERVED_SEGMENTS)
        & (F.octet_length(segment) <= 255)
    )


def cascade(*rules: tuple[Column, Column], otherwise: Column) -> Column:
    """The value of the first rule that holds."""
    out = otherwise
    for condition, value in reversed(rules):
        out = F.when(condition, value).otherwise(out)
    return out


def bounded_text(value: Column, longest: int = 512) -> Column:
    """Control and format characters escaped; longer text cut, with a digest of the whole."""
    shown = F.regexp_replace(value, r"[\p{Cc}\p{Cf}\u2028\u2029]", "�")
    mark = F.concat(F.lit("…#"), F.substring(F.sha2(value, 256), 1, 16))
    return F.when(F.length(shown) <= longest, shown).otherwise(F.concat(F.substring(shown, 1, longest - 18), mark))


def utf16_length(value: Column) -> Column:
    """Length in UTF-16 units: code points, and one more for each beyond the basic plane."""
    return F.length(value) + F.regexp_count(value, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def utf16_prefix(value: Column, units: int) -> Column:
    """The longest prefix of at most ``units`` UTF-16 units that cuts no surrogate pair."""
    head = F.substring(value, 1, units)
    sizes = F.transform(F.split(head, ""), lambda c: F.when(F.octet_length(c) == 4, 2).otherwise(1))
    kept = F.aggregate(sizes, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), lambda a, s: F.struct((a["sum"] + s).alias("sum"), F.when(a["sum"] + s <= units, a["n"] + 1).otherwise(a["n"]).alias("n")), lambda a: a["n"])
    return F.when(utf16_length(value) <= units, value).otherwise(F.substring(value, F.lit(1), kept))


def markdown_cell(value: Column) -> Column:
    """Escaped for a table cell, on one line."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"([\\|`*_\[\]<>])", r"\\$1"), r"[\r\n]+", " ")


def byte_units(size: Column) -> Column:
    """A size as text, in the largest unit that is not above it."""
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(units[1:], 1):
        out = F.when(size >= 1 << (10 * power), F.concat(F.format_string("%.1f", size / F.lit(float(1 << (10 * power)))), F.lit(f" {unit}"))).otherwise(out)
    return out


def sanitise_identifier(name: Column) -> Column:
    """Letters, digits and underscores only, not led by a digit, never empty."""
    plain = F.regexp_replace(name, r"[^\p{L}\p{Nd}_]", "_")
    return F.when(plain == "", "_").when(plain.rlike(r"^\p{Nd}"), F.concat(F.lit("_"), plain)).otherwise(plain)


def simple_name(name: Column) -> Column:
    """The name without namespace, owner types and generic arity."""
    return F.regexp_replace(F.element_at(F.split(name, r"[.+/]"), -1), r"`[0-9]+.*$", "")


def integral_value(type_name: Column, text: Column) -> Column:
    """The text of an enumeration value of integral type, else null."""
    integral = type_name.isin("sbyte", "byte", "short", "ushort", "int", "uint", "long", "ulong", "char", "bool")
    return F.when(integral & text.rlike("^-?[0-9]{1,20}$"), text)
