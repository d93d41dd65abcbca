"""Functions and calls of native code, from the JSON that a disassembler exports.

The external tool is never started here; its output is read strictly.  Any break of the schema voids
that one document (status ``invalid`` with the reason); a missing call graph (version 1) stays null,
which is not the same as an empty one.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lazy import arrow_function

CALL = "struct<caller:string,site:string,target:string,indirect:boolean,tail:boolean>"
NATIVE = f"struct<status:string,error:string,version:int,function_count:int,truncated:boolean,functions:array<struct<name:string,address:string,signature:string,external:boolean>>,calls:array<{CALL}>,calls_truncated:boolean>"
PSEUDOCODE = "struct<status:string,error:string,input_sha256:string,complete:boolean,rows:array<struct<address:string,status:string,code:string>>>"
# Bounds on one document.
MAX_CHARS, MAX_FUNCTIONS, MAX_STRING, MAX_CALLS, MAX_ADDRESS, MAX_DEPTH = 32 << 20, 100_000, 16_384, 100_000, 256, 16


class _Invalid(ValueError):
    pass


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise _Invalid("a property is repeated")
    return out


def _need(condition: bool, what: str) -> None:
    if not condition:
        raise _Invalid(what)


def _is_int(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def _depth(node: object) -> int:
    level, now = 0, [node]
    while now:
        level += 1
        now = [c for n in now for c in (n.values() if isinstance(n, dict) else n if isinstance(n, list) else ())]
    return level


def _address(x: object, what: str) -> str:
    _need(isinstance(x, str) and 0 < len(x) <= MAX_ADDRESS and x.strip() != "" and not any(ord(c) < 32 for c in x), what)
    return x


def _calls(root: dict, version: int, externals: dict[str, bool], kept: set[str], truncated: bool) -> tuple[list[dict], bool]:
    graph = root.get("callGraph")
    _need(isinstance(graph, dict) and isinstance(graph.get("calls"), list) and isinstance(graph.get("truncated"), bool), "the call graph is malformed")
    cut, rows, seen = graph["truncated"] or truncated, [], set()
    sites: dict[tuple[str, str], tuple[bool, bool]] = {}
    tails: dict[tuple[str, str], set] = {}
    for call in graph["calls"]:
        _need(isinstance(call, dict) and isinstance(call.get("isIndirect"), bool), "a call is malformed")
        caller, site = _address(call.get("callerAddress"), "a caller is malformed"), _address(call.get("callSiteAddress"), "a call site is malformed")
        _need("targetAddress" in call, "a call has no target field")
        target = call["targetAddress"]
        if target is not None:
            target = _address(target, "a target is malformed")
            _need(target in externals, "a target is no function")
        _need(caller in externals and not externals[caller], "a caller is no function of the image")
        _need(("isTailCall" in call) == (version >= 3), "the tail call field does not fit the version")
        tail = call.get("isTailCall", False)
        _need(isinstance(tail, bool), "a tail call field is malformed")
        _need(not tail or (not call["isIndirect"] and target is not None and target != caller), "a tail call is not direct, or calls itself")
        _need((caller, site, target) not in seen, "a call is repeated")
        seen.add((caller, site, target))
        kind = (call["isIndirect"], tail)
        _need(sites.setdefault((caller, site), kind) == kind, "a call site has two kinds")
        tails.setdefault((caller, site), set()).add(target)
        _need(not tail or len(tails[caller, site]) == 1, "a tail call has two targets")
        if caller not in kept or (target is not None and target not in kept) or len(rows) >= MAX_CALLS:
            cut = True
            continue
        rows.append({"caller": caller, "site": site, "target": target, "indirect": call["isIndirect"], "tail": tail})
    _need(all(not (sites[k][1] and len(t) != 1) for k, t in tails.items()), "a tail call has two targets")
    return rows, cut


def read_native(text: str | None) -> dict:
    """S27, V1-V6, J14, J15."""
    out = {"status": "invalid", "error": None, "version": None, "function_count": None, "truncated": None, "functions": None, "calls": None, "calls_truncated": None}
    try:
        _need(bool(text and text.strip()), "the document is empty")
        _need(len(text) <= MAX_CHARS, "the document is too large")
        root = json.loads(text, object_pairs_hook=_pairs)
        _need(isinstance(root, dict) and _depth(root) <= MAX_DEPTH, "the root is malformed")
        version, count, functions = root.get("schemaVersion"), root.get("functionCount"), root.get("functions")
        _need(_is_int(version) and version in (1, 2, 3), "the version is unknown")
        _need(_is_int(count) and count >= 0 and isinstance(functions, list), "the functions are malformed")
        truncated = root.get("truncated", False)
        _need(isinstance(truncated, bool), "the truncation flag is malformed")
        _need(count >= len(functions) and (truncated or count == len(functions)), "the function count does not fit")
        rows, externals = [], {}
        for f in functions:
            _need(isinstance(f, dict) and all(isinstance(f.get(k), str) for k in ("name", "address", "signature")) and isinstance(f.get("external"), bool) and f["name"].strip() != "", "a function is malformed")
            if version >= 2:
                _address(f["address"], "an address is malformed")
                _need(f["address"] not in externals, "an address is repeated")
                externals[f["address"]] = f["external"]
            if len(rows) < MAX_FUNCTIONS:
                truncated = truncated or any(len(f[k]) > MAX_STRING for k in ("name", "signature"))
                rows.append({"name": f["name"][:MAX_STRING], "address": f["address"], "signature": f["signature"][:MAX_STRING], "external": f["external"]})
            else:
                truncated = True
        calls, cut = None, None
        if version >= 2:
            calls, cut = _calls(root, version, externals, {r["address"] for r in rows}, truncated)
        else:
            _need("callGraph" not in root, "version 1 has no call graph")
        return out | {"status": "ok", "version": version, "function_count": count, "truncated": truncated, "functions": rows, "calls": calls, "calls_truncated": cut}
    except (_Invalid, ValueError, RecursionError) as e:
        return out | {"error": str(e)}


@arrow_function(NATIVE)
def native_document(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_native(t) for t in texts], columns=["status", "error", "version", "function_count", "truncated", "functions", "calls", "calls_truncated"])


def functions_table(documents: DataFrame) -> DataFrame:
    """id, ord, name, address, signature, external of documents (id, native)."""
    return documents.select("id", F.posexplode("native.functions").alias("ord", "f")).select("id", "ord", "f.*")


def calls_table(documents: DataFrame) -> DataFrame:
    """id, ord, caller, site, target, indirect, tail; documents without a graph have no rows here, and
    ``native.calls`` tells null from empty."""
    return documents.select("id", F.posexplode("native.calls").alias("ord", "c")).select("id", "ord", "c.*")


def display_names(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls with shown caller and target: ``name (address)``, or a label where the target is unknown."""
    shown = functions.select("id", F.col("address"), F.concat("name", F.lit(" ("), F.col("address").cast("string"), F.lit(")")).alias("shown"))
    at = lambda c: shown.withColumnRenamed("address", c).withColumnRenamed("shown", f"{c}_shown")
    out = calls.join(at("caller"), ["id", "caller"], "left").join(at("target"), ["id", "target"], "left")
    return out.withColumn("caller_shown", F.coalesce("caller_shown", F.col("caller").cast("string"))).withColumn("target_shown", F.coalesce("target_shown", F.col("target").cast("string"), F.lit("unresolved")))


def unresolved_calls() -> Column:
    """Over a group of calls, those without a target."""
    return F.count_if(F.col("target").isNull())


def read_pseudocode(text: str | None) -> dict:
    """Decompilation evidence; the rows are judged by validate.pseudocode_evidence."""
    out = {"status": "invalid", "error": None, "input_sha256": None, "complete": None, "rows": None}
    try:
        root = json.loads(text or "", object_pairs_hook=_pairs)
        d = root.get("decompilation") if isinstance(root, dict) else None
        _need(isinstance(d, dict) and isinstance(d.get("inputSha256"), str) and isinstance(d.get("complete"), bool) and isinstance(d.get("functions"), list), "the evidence is malformed")
        rows = []
        for f in d["functions"]:
            _need(isinstance(f, dict) and isinstance(f.get("address"), str) and isinstance(f.get("status"), str) and isinstance(f.get("code"), (str, type(None))), "a row is malformed")
            rows.append({"address": f["address"], "status": f["status"], "code": f.get("code")})
        return out | {"status": "ok", "input_sha256": d["inputSha256"], "complete": d["complete"], "rows": rows}
    except (_Invalid, ValueError, RecursionError) as e:
        return out | {"error": str(e)}


@arrow_function(PSEUDOCODE)
def pseudocode_document(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_pseudocode(t) for t in texts], columns=["status", "error", "input_sha256", "complete", "rows"])


def pseudocode_of_functions(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """Rows (id, address, …) whose function is known and not external."""
    return rows.join(functions.where("not external").select("id", "address"), ["id", "address"], "left_semi")
