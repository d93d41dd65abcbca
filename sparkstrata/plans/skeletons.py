"""Code skeletons: types rendered as source text in C#, C++, Rust and Go.

Types arrive as a table, one row a type with its members nested: assembly, token, declaring_token,
namespace, name, kind, fields array<struct<name,type,constant>>, properties array<struct<name,type>>,
methods array<struct<name,return_type,is_static,parameters array<struct<name,type>>,il array<string>>>.
One assembly is rendered at a time (grouped), since names must be unique within it; assemblies
render in parallel.  The result is a table of files: path, content.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

TYPES = "assembly string, token int, declaring_token int, namespace string, name string, kind string, fields array<struct<name:string,type:string,constant:string>>, properties array<struct<name:string,type:string>>, methods array<struct<name:string,return_type:string,is_static:boolean,parameters:array<struct<name:string,type:string>>,il:array<string>>>"
INTEGRAL = ("sbyte", "byte", "short", "ushort", "int", "uint", "long", "ulong", "char", "bool")
ACCESSOR = re.compile("^(get|set|add|remove|op)_")
MAX_IL_LINES, MAX_IL_CHARS = 40, 4096


def is_generated(name: str) -> bool:
    return "<" in name or ">" in name


def sanitise(name: str, fallback: str) -> str:
    """Letters, digits and underscores, led by no digit."""
    out = re.sub(r"[^\w]", "_", name, flags=re.ASCII if name.isascii() else 0)
    if not out.strip("_"):
        return fallback
    return f"_{out}" if out[0].isdigit() else out


def simple_name(name: str) -> str:
    return re.split(r"[.+/]", name.split("`")[0])[-1]


class Names:
    """Names used in one scope; a name that is taken gets the next free number."""

    def __init__(self, *reserved: str, fold: bool = False):
        self.fold = str.upper if fold else str
        self.used = {self.fold(r) for r in reserved}

    def take(self, name: str) -> str:
        out, n = name, 1
        while self.fold(out) in self.used:
            n += 1
            out = f"{name}_{n}" if name[-1:].isdigit() else f"{name}{n}"
        self.used.add(self.fold(out))
        return out


def strip_generics(name: str) -> str:
    out, depth = [], 0
    for c in name:
        depth += c == "<"
        if not depth:
            out.append(c)
        depth -= c == ">" and depth > 0
    return "".join(out)


@dataclass
class Dialect:
    """What differs between target languages."""

    suffix: str
    primitives: dict[str, str]
    void: str
    function_pointer: str
    pointer: Callable[[str], str]
    array: Callable[[str], str]
    keywords: frozenset[str] = field(default_factory=frozenset)

    def map(self, name: str) -> str:
        """The type's name in this language: nullable and by-reference marks dropped, pointers and
        arrays kept, unknown types by their simple name."""
        t = name.strip().removesuffix("?").rstrip()
        t = re.sub(r"^(ref readonly|ref|in|out)\s+", "", t)
        if t.startswith("delegate*"):
            return self.function_pointer
        if t.endswith("*"):
            return self.pointer(self.map(t[:-1]))
        if (m := re.search(r"\[(,*)\]$", t)) and m.start():
            out = self.map(t[: m.start()])
            for _ in range(len(m[1]) + 1):
                out = self.array(out)
            return out
        if t == "void":
            return self.void
        return self.primitives.get(t) or sanitise(simple_name(strip_generics(t)), "Unknown")

    def identifier(self, name: str, fallback: str) -> str:
        out = sanitise(name, fallback)
        return f"{out}_" if out in self.keywords else out


# Primitive types in each language, in the order of PRIMITIVES.
PRIMITIVES = ["bool", "byte", "sbyte", "short", "ushort", "int", "uint", "long", "ulong", "float", "double", "char", "string", "object", "nint", "nuint"]
_CPP = ["bool", "uint8_t", "int8_t", "int16_t", "uint16_t", "int32_t", "uint32_t", "int64_t", "uint64_t", "float", "double", "char16_t", "std::string", "void*", "intptr_t", "uintptr_t"]
_RUST = ["bool", "u8", "i8", "i16", "u16", "i32", "u32", "i64", "u64", "f32", "f64", "char", "String", "Box<dyn std::any::Any>", "isize", "usize"]
_GO = ["bool", "byte", "int8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float32", "float64", "rune", "string", "any", "int", "uint"]

CPP = Dialect(".hpp", dict(zip(PRIMITIVES, _CPP, strict=True)), "void", "void*", lambda t: f"{t}*", lambda t: f"std::vector<{t}>", frozenset("auto bool break case catch char class const continue default delete do double else enum explicit export extern false float for friend goto if inline int long mutable namespace new operator private protected public register return short signed sizeof static struct switch template this throw true try typedef typename union unsigned using virtual void volatile while".split()))
RUST = Dialect(".rs", dict(zip(PRIMITIVES, _RUST, strict=True)), "()", "*const ()", lambda t: f"*mut {t}", lambda t: f"Vec<{t}>", frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()))
GO = Dialect(".go", dict(zip(PRIMITIVES, _GO, strict=True)), "", "uintptr", lambda t: f"*{t}", lambda t: f"[]{t}", frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()))
CSHARP = Dialect(".cs", {p: p for p in PRIMITIVES}, "void", "nint", lambda t: f"{t}*", lambda t: f"{t}[]", frozenset("abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while".split()))


def emittable(types: list[dict]) -> list[dict]:
    """F8: top-level types that are not generated and no delegates, by name."""
    return sorted((t for t in types if t["declaring_token"] is None and not is_generated(t["name"]) and t["kind"] != "delegate"), key=lambda t: (t["name"], t["token"]))


def methods_of(t: dict) -> list[dict]:
    """F7."""
    return [m for m in t["methods"] if m["name"] not in (".ctor", ".cctor") and not is_generated(m["name"]) and not ACCESSOR.match(m["name"])]


def members_of(t: dict) -> list[tuple[str, str]]:
    """Fields, then properties."""
    return [(f["name"], f["type"]) for f in t["fields"] if not is_generated(f["name"])] + [(p["name"], p["type"]) for p in t["properties"]]


def enum_type(t: dict) -> str:
    """P14."""
    return next((f["type"] for f in t["fields"] if f["name"] == "value__"), "int")


def enum_values(t: dict) -> list[tuple[str, str | None]]:
    """Constants, each with its value where it is integral text."""
    kind = enum_type(t)
    ok = lambda x: x if x is not None and kind in INTEGRAL and re.fullmatch("-?[0-9]{1,20}", x) else None
    return [(f["name"], ok(f["constant"])) for f in t["fields"] if f["name"] != "value__" and not is_generated(f["name"])]


def _parameters(d: Dialect, m: dict, show: Callable[[str, str], str], *reserved: str) -> str:
    names = Names(*reserved)
    return ", ".join(show(names.take(d.identifier(p["name"] or "", f"arg{i}")), d.map(p["type"])) for i, p in enumerate(m["parameters"]))


def cpp_type(t: dict, name: str) -> list[str]:
    d, names = CPP, Names()
    if t["kind"] == "enum":
        body = [f"    {names.take(d.identifier(n, 'Member'))}{'' if v is None else f' = {v}'}," for n, v in enum_values(t)]
        return [f"enum class {name} : {d.map(enum_type(t))} {{", *body, "};"]
    abstract = t["kind"] == "interface"
    out = [f"class {name} {{", "public:"] + ([f"    virtual ~{name}() = default;"] if abstract else [])
    out += [f"    {d.map(k)} {names.take(d.identifier(n, 'field'))};" for n, k in members_of(t)]
    for m in methods_of(t):
        head = f"{d.map(m['return_type'])} {d.identifier(m['name'], 'method')}({_parameters(d, m, lambda n, k: f'{k} {n}')})"
        out.append(f"    virtual {head} = 0;" if abstract else f"    {'static ' if m['is_static'] else ''}{head} {{ throw std::logic_error(\"not implemented\"); }}")
    return [*out, "};"]


def rust_type(t: dict, name: str) -> list[str]:
    d, names = RUST, Names()
    if t["kind"] == "enum":
        values = enum_values(t)
        if not values:
            return [f"pub enum {name} {{}}"]
        out, aliases, first = [f"#[repr({d.map(enum_type(t))})]", f"pub enum {name} {{"], [], {}
        for n, v in values:
            variant = names.take(d.identifier(n, "Member"))
            if v is not None and v in first:  # E12: two variants may not share a value
                aliases.append(f"    pub const {variant}: Self = Self::{first[v]};")
                continue
            if v is not None:
                first[v] = variant
            out.append(f"    {variant}{'' if v is None else f' = {v}'},")
        out.append("}")
        return out + ([f"impl {name} {{", *aliases, "}"] if aliases else [])

    def head(m: dict, used: Names) -> str:
        parameters = ", ".join(x for x in ("" if m["is_static"] else "&self", _parameters(d, m, lambda n, k: f"{n}: {k}", "self")) if x)
        returns = "" if m["return_type"] == "void" else f" -> {d.map(m['return_type'])}"
        return f"fn {used.take(d.identifier(m['name'], 'method'))}({parameters}){returns}"

    used = Names()
    if t["kind"] == "interface":
        return [f"pub trait {name} {{", *(f"    {head(m, used)};" for m in methods_of(t)), "}"]
    out = [f"pub struct {name} {{", *(f"    pub {names.take(d.identifier(n, 'field'))}: {d.map(k)}," for n, k in members_of(t)), "}"]
    bodies = [f"    pub {head(m, used)} {{ unimplemented!() }}" for m in methods_of(t)]
    return out + ([f"impl {name} {{", *bodies, "}"] if bodies else [])


def go_type(t: dict, name: str) -> list[str]:
    d = GO
    show = lambda n, k: f"{n} {k}"
    returns = lambda m: "" if m["return_type"] == "void" else f" {d.map(m['return_type'])}"
    if t["kind"] == "enum":
        values = [f"    {name}{sanitise(n, 'Member')} {name} = {'iota' if v is None else v}" for n, v in enum_values(t)]
        return [f"type {name} {d.map(enum_type(t))}", *(["const (", *values, ")"] if values else [])]
    used = Names()
    if t["kind"] == "interface":
        return [f"type {name} interface {{", *(f"    {used.take(d.identifier(m['name'], 'Method'))}({_parameters(d, m, show, 'r')}){returns(m)}" for m in methods_of(t)), "}"]
    # Fields and methods share one scope.
    out = [f"type {name} struct {{", *(f"    {used.take(d.identifier(n, 'Field'))} {d.map(k)}" for n, k in members_of(t)), "}"]
    for m in methods_of(t):
        if m["is_static"]:
            head = f"func {used.take(f'{name}_' + sanitise(m['name'], 'Method'))}"
        else:
            head = f"func (r *{name}) {used.take(d.identifier(m['name'], 'Method'))}"
        out += ["", f"{head}({_parameters(d, m, show, 'r')}){returns(m)} {{", '    panic("not implemented")', "}"]
    return out


def csharp_type(t: dict, name: str, children: dict[int, list[dict]] | None = None, depth: int = 0) -> list[str]:
    d, names = CSHARP, Names(name)
    keyword = {"enum": "enum", "interface": "interface", "struct": "struct"}.get(t["kind"], "class")
    if keyword == "enum":
        values = [f"    {names.take(d.identifier(n, 'Member'))}{'' if v is None else f' = {v}'}," for n, v in enum_values(t)]
        return [f"public enum {name} : {d.map(enum_type(t))}", "{", *values, "}"]
    out = [f"public {keyword} {name}", "{"]
    if keyword != "interface":
        out += [f"    public {d.map(f['type'])} {names.take(d.identifier(f['name'], 'field'))};" for f in t["fields"] if not is_generated(f["name"]) and f["name"] != "value__"]
    out += [f"    {'' if keyword == 'interface' else 'public '}{d.map(p['type'])} {names.take(d.identifier(p['name'], 'Property'))} {{ get; set; }}" for p in t["properties"] if not is_generated(p["name"])]
    signatures: set[tuple] = set()
    for m in methods_of(t):
        if ACCESSOR.match(m["name"].rsplit(".", 1)[-1]):  # E4
            continue
        shape = (d.identifier(m["name"], "Method"), tuple(d.map(p["type"]) for p in m["parameters"]))
        if shape in signatures:
            continue
        signatures.add(shape)
        head = f"{d.map(m['return_type'])} {shape[0]}({_parameters(d, m, lambda n, k: f'{k} {n}')})"
        if keyword == "interface":
            out.append(f"    {head};")
            continue
        listing = [f"        // {re.sub(r'[\x00-\x1f]', ' ', line)[:MAX_IL_CHARS]}" for line in (m["il"] or [])[:MAX_IL_LINES]]  # E7
        out += [f"    public {'static ' if m['is_static'] else ''}{head}", "    {", *listing, "        throw new System.NotImplementedException();", "    }"]
    if depth < 64:
        for child in sorted((children or {}).get(t["token"], []), key=lambda c: (c["name"], c["token"])):  # E13
            if not is_generated(child["name"]) and child["kind"] != "delegate":
                out += ["    " + line for line in csharp_type(child, names.take(d.identifier(simple_name(child["name"]), "Type")), children, depth + 1)]
    return [*out, "}"]


def _flat(types: list[dict], stem: str, d: Dialect, head: list[str], render: Callable[[dict, str], list[str]]) -> list[tuple[str, str]]:
    names, lines = Names(), list(head)
    for t in emittable(types):  # E14
        lines += ["", *render(t, names.take(d.identifier(simple_name(t["name"]), "Type")))]
    return [(f"{stem}{d.suffix}", "\n".join(lines) + "\n")]


def render_csharp(types: list[dict], stem: str) -> list[tuple[str, str]]:
    """K4: a file for each namespace, and a project file."""
    children: dict[int, list[dict]] = {}
    for t in types:
        if t["declaring_token"] is not None:
            children.setdefault(t["declaring_token"], []).append(t)
    spaces: dict[str, list[dict]] = {}
    for t in emittable(types):
        spaces.setdefault(t["namespace"] or "", []).append(t)
    stems, out = Names(fold=True), []
    for space, members in sorted(spaces.items()):
        names, lines = Names(), [f"namespace {space};", ""] if space else []
        for t in members:
            lines += [*csharp_type(t, names.take(CSHARP.identifier(simple_name(t["name"]), "Type")), children), ""]
        out.append((f"{stem}/{stems.take(sanitise(space.replace('.', '_'), 'Global'))}.cs", "\n".join(lines)))
    project = '<Project Sdk="Microsoft.NET.Sdk">\n  <PropertyGroup>\n    <TargetFramework>net8.0</TargetFramework>\n  </PropertyGroup>\n</Project>\n'
    return [*out, (f"{stem}/{stem}.csproj", project)] if out else []


RENDERERS: dict[str, Callable[[list[dict], str], list[tuple[str, str]]]] = {
    "csharp": render_csharp,
    "cpp": lambda t, s: _flat(t, s, CPP, ["#pragma once", "#include <cstdint>", "#include <stdexcept>", "#include <string>", "#include <vector>"], cpp_type),
    "rust": lambda t, s: _flat(t, s, RUST, ["#![allow(dead_code, non_camel_case_types, non_snake_case)]"], rust_type),
    "go": lambda t, s: _flat(t, s, GO, ["package reconstructed"], go_type),
}


def _plain(value: object) -> object:
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if hasattr(value, "asDict"):
        return _plain(value.asDict())
    if isinstance(value, float):
        return None if value != value else int(value)
    return [_plain(v) for v in value] if hasattr(value, "__iter__") else value


def skeletons(types: DataFrame, language: str) -> DataFrame:
    """K4-K7: path, content of the files for every assembly of ``types``."""
    render = RENDERERS[language]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        records = [_plain(r) for r in rows.to_dict("records")]
        for r in records:
            r |= {k: r[k] or [] for k in ("fields", "properties", "methods")}
            for m in r["methods"]:
                m["parameters"] = m["parameters"] or []
        assembly = records[0]["assembly"] or "Reconstructed"
        return pd.DataFrame(render(records, sanitise(assembly, "Reconstructed")), columns=["path", "content"])

    return types.groupBy("assembly").applyInPandas(one, "path string, content string")


def package_local_references(assemblies: DataFrame, references: DataFrame) -> DataFrame:
    """References (assembly, name) that name another assembly of the package, distinct."""
    from pyspark.sql import functions as F

    known = assemblies.select(F.upper("assembly").alias("key"), F.col("assembly").alias("target")).distinct()
    return references.withColumn("key", F.upper("name")).join(known, "key").where("assembly <> target").select("assembly", "target").distinct()
