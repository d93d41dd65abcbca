import json
import struct

import pytest
from pyspark.sql import functions as F

from sparkstrata.operators import graph
from sparkstrata.sources import archives, files, images, native, projects, resources

from .builders import asar_bytes, asar_of, image_bytes, markup_bytes, record, resource_bytes, text7, zip_bytes


def rows(reader, data):
    return [(p, k, s, c, t) for p, k, s, c, t in reader(data)]


def refused(reader, data):
    with pytest.raises(archives.Broken) as e:
        rows(reader, data)
    return str(e.value)


def test_zip_entries_are_sorted_and_links_skipped():
    data = zip_bytes({"b/x.txt": b"1", "A.txt": b"22", "dir/": b""}, {"link": b"A.txt"})
    assert rows(archives.zip_entries, data) == [("A.txt", "file", 2, b"22", None), ("b/x.txt", "file", 1, b"1", None)]
    assert archives.declared_zip_entries(data) == 4 and archives.declared_zip_entries(b"PK") is None


@pytest.mark.parametrize("names", [["../x"], ["/x"], ["a//b"], ["C:/x"], ["a", "A"], ["a", "a/b"], ["e\u0301", "é"], ["a\\..\\b"]])
def test_unsafe_zips_are_refused(names):
    assert refused(archives.zip_entries, zip_bytes({n: b"x" for n in names}))


def test_broken_and_large_zips_are_refused():
    data = zip_bytes({"a": b"x" * 100, "b": b"y"})
    assert "many" in refused(lambda d: archives.zip_entries(d, max_entries=1), data)
    assert "large" in refused(lambda d: archives.zip_entries(d, max_bytes=50), data)
    assert refused(archives.zip_entries, data[:-30]) and refused(archives.zip_entries, b"")


def test_asar_kinds():
    tree = {"files": {"d": {"files": {"x": {"size": 3, "offset": "0"}, "same": {"size": 3, "offset": "0"}}}, "l": {"link": "d/x"}, "u": {"size": 9, "unpacked": True}, "e": {"size": 0, "offset": "0"}}}
    got = rows(archives.asar_entries, asar_bytes(tree, b"abc"))
    assert got == [("d", "dir", 0, None, None), ("d/same", "file", 3, b"abc", None), ("d/x", "file", 3, b"abc", None), ("e", "file", 0, b"", None), ("l", "link", 0, None, "d/x"), ("u", "unpacked", 9, None, None)]


BAD = {
    "outside": {"files": {"x": {"size": 9, "offset": "0"}}},
    "overlap": {"files": {"x": {"size": 2, "offset": "0"}, "y": {"size": 2, "offset": "1"}}},
    "climbs": {"files": {"..": {"size": 0, "offset": "0"}}},
    "dangling": {"files": {"l": {"link": "gone"}}},
    "cycle": {"files": {"l": {"link": "m"}, "m": {"link": "l"}}},
    "case": {"files": {"x": {"size": 0, "offset": "0"}, "X": {"size": 0, "offset": "0"}}},
    "number": {"files": {"x": {"size": True, "offset": "0"}}},
    "offset": {"files": {"x": {"size": 1, "offset": 0}}},
    "no files": {"other": 1},
}


@pytest.mark.parametrize("case", BAD)
def test_bad_asar_archives_are_refused(case):
    assert refused(archives.asar_entries, asar_bytes(BAD[case], b"abc"))


def test_asar_headers_are_checked():
    text = b'{"files":{},"files":{}}'
    assert "repeats" in refused(archives.asar_entries, struct.pack("<IIII", 4, len(text) + 8, len(text) + 4, len(text)) + text)
    assert refused(archives.asar_entries, b"") and refused(archives.asar_entries, struct.pack("<IIII", 4, 1 << 30, 0, 0))


FILE = "id string, relative_path string, size long, content binary, origin struct<kind:string,container:string,entry:string,depth:int>"


def frame(spark, contents):
    return spark.createDataFrame([(p, p, len(c), bytearray(c), ("direct", None, None, 0)) for p, c in contents.items()], FILE)


def test_nested_archives(spark):
    inner = asar_of({"deep.txt": b"deep"})
    outer = asar_of({"a/one.txt": b"1", "in.asar": inner})
    out, stats = archives.expand_nested(frame(spark, {"app.asar": outer, "bad.asar": b"junk", "x.txt": b"x"}))
    got = {r.id: (r.origin.kind, r.origin.container, r.origin.entry, r.origin.depth, bytes(r.content)) for r in out.collect() if r.origin.depth}
    assert got["app.asar/a/one.txt"] == ("asar", "app.asar", "a/one.txt", 1, b"1")
    assert got["app.asar/in.asar/deep.txt"] == ("asar", "app.asar/in.asar", "deep.txt", 2, b"deep") and len(got) == 3
    assert {(r.container, r.depth, r.complete) for r in stats.collect()} == {("app.asar", 1, True), ("bad.asar", 1, False), ("app.asar/in.asar", 2, True)}


def test_scan_and_pruning(spark, tmp_path):
    for p in ("src/a.cs", "bin/old.dll", "src/OBJ/b.cs", "obj"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(p.encode())
    got = {r.id: (r.file_name, r.size) for r in files.scan(spark, str(tmp_path), source_mode=True).collect()}
    assert got == {"src/a.cs": ("a.cs", 8), "obj": ("obj", 3)}
    assert files.scan(spark, str(tmp_path)).count() == 4 and files.digests(files.scan(spark, str(tmp_path))).where("length(sha256) = 64").count() == 4


def test_ids_are_relative_to_the_root_itself(spark, tmp_path):
    root = tmp_path / "pkg"
    for p in ("a.txt", "sub/pkg/a.txt", "sub/pkg/empty", "x [1]%20y/é.txt"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b"" if p.endswith("empty") else p.encode())
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "b.txt").write_bytes(b"b")
    (root / "link").symlink_to(tmp_path / "outside")
    (root / "one.txt").symlink_to(root / "a.txt")
    got = {r.id: (r.size, bytes(r.content).decode()) for r in files.scan(spark, str(root)).collect()}
    assert got == {p: (len(p.encode()), p) for p in ("a.txt", "sub/pkg/a.txt", "x [1]%20y/é.txt")} | {"sub/pkg/empty": (0, "")}
    assert {(r.file, r.warning) for r in files.scan_warnings(spark, str(root), max_file_bytes=10).collect()} == {("link", "a link is not followed"), ("one.txt", "a link is not followed"), ("sub/pkg/a.txt", "the file is too large"), ("x [1]%20y/é.txt", "the file is too large")}
    assert [r.id for r in files.scan(spark, str(root / "a.txt")).collect()] == ["a.txt"]


def test_source_text_is_strict(spark):
    rows = [(1, b"plain"), (2, b"\xef\xbb\xbfmarked"), (3, b"\xff"), (4, "é".encode()), (5, b"x" * 99), (6, None)]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "id int, content binary")
    got = {r.id: r.t for r in df.select("id", files.source_text(F.col("content"), 20).alias("t")).collect()}
    assert got == {1: "plain", 2: "marked", 3: None, 4: "é", 5: None, 6: None}


def test_sidecars(spark):
    f = frame(spark, {"app.asar.unpacked/m.node": b"12345", "APP.asar.unpacked/n.node": b"1", "other.asar.unpacked/x": b"", "App.exe": b"", "app.DLL": b"", "app.runtimeconfig.json": b"", "lone.exe": b"", "lone.dll": b""})
    entries = spark.createDataFrame([("app.asar", "m.node", 5), ("app.asar", "n.node", 9), ("app.asar", "gone", 1)], "container string, path string, size long")
    found = files.unpacked_sidecars(entries, f)
    assert {r.path: r.sidecar for r in found.collect()} == {"m.node": "app.asar.unpacked/m.node", "n.node": None, "gone": None}
    left = files.suppress(f, found.where("sidecar is not null").select(F.col("sidecar").alias("id")))
    assert left.count() == 7 and files.orphan_sidecars(left).count() == 2
    assert [(r.host, r.id) for r in files.app_host_sidecars(f).collect()] == [("App.exe", "app.DLL")]


CALLS = bytes([0x28]) + struct.pack("<i", 0x06000002) + bytes([0x6F]) + struct.pack("<i", 0x0A000001) + bytes([0x73]) + struct.pack("<i", 0x0A000002) + bytes([0x20]) + struct.pack("<i", 0x28) + bytes([0x26, 0x2A])
TINY = bytes([len(CALLS) << 2 | 2]) + CALLS
FAT = struct.pack("<HHII", 0x3003, 8, 9 + 4 * 2, 0) + bytes([0x45]) + struct.pack("<Iii", 2, 0, 0) + bytes([0xFE, 0x01, 0x2A, 0x2A])
BROKEN = bytes([2 << 2 | 2, 0x28, 0])


def test_native_image():
    r = images.read_image(image_bytes(["USER32.dll", "kernel32.dll", "KERNEL32.DLL"], sections=[".text", ".gopclntab", ".text"]))
    assert (r["is_executable"], r["is_library"], r["is_managed"], r["error"]) == (True, False, False, None)
    assert r["imports"] == ["kernel32.dll", "USER32.dll"] and r["sections"] == [".text", ".gopclnt"] and r["machine"] == 0x14C
    assert images.read_image(b"") is None and images.read_image(b"MZ" + bytes(100)) is None and images.read_image(None) is None
    cut = images.read_image(image_bytes(["a.dll"])[:0x410])
    assert cut["error"] and cut["truncated"]


def managed(**more):
    spec = {"assembly": "My.Lib", "references": ["System.Runtime", "PresentationFramework", "system.runtime"], "types": [("", "<Module>", []), ("My", "Main", [("Run", 0), ("Add", 1)]), ("My", "Inner", [("Abstract", None)])], "nested": [(3, 2)]}
    return image_bytes(managed=spec, bodies=[TINY, FAT], **more)


def test_managed_image():
    r = images.read_image(managed())
    assert (r["is_managed"], r["assembly_name"], r["references"], r["error"], r["truncated"]) == (True, "My.Lib", ["PresentationFramework", "System.Runtime"], None, False)
    assert [(t["namespace"], t["name"], t["token"], t["declaring_token"], [m["name"] for m in t["methods"]]) for t in r["types"]] == [("", "<Module>", 0x02000001, None, []), ("My", "Main", 0x02000002, None, ["Run", "Add"]), ("My", "Inner", 0x02000003, 0x02000002, ["Abstract"])]
    assert [(c["caller"], c["callee"], c["kind"]) for c in r["calls"]] == [(0x06000001, 0x06000002, "call"), (0x06000001, 0x0A000001, "callvirt"), (0x06000001, 0x0A000002, "newobj")]
    assert images.read_image(managed(entry_token=0))["is_library"] and images.read_image(managed(library=True))["is_library"]
    assert images.read_image(managed(), with_code=False)["calls"] == []


RICH = {
    "assembly": "Shapes",
    "references": [],
    "types": [("", "<Module>", []), ("N", "Color", []), ("N", "IRun", [("Go", 0)]), ("N", "Box`1", [("Make", None), ("Odd", None)])],
    "outside": [("System", "Enum"), ("System.Text", "StringBuilder")],
    "rich": {
        2: {"extends": 1 << 2 | 1, "fields": [("value__", b"\x06\x05", None), ("Red", b"\x06\x11\x08", (5, b"\x07"))]},
        3: {"flags": 0x21, "shapes": {"Go": (0x400, b"\x20\x00\x01", [])}},
        4: {
            "fields": [("items", b"\x06\x1d\x0e", None), ("grid", b"\x06\x14\x08\x02\x00\x00", None), ("own", b"\x06\x15\x12\x10\x01\x13\x00", None), ("bad", b"\x06\x77", None)],
            "shapes": {"Make": (0x10, b"\x00\x03\x12\x09\x0f\x05\x10\x08\x1e\x00", ["first", "second"]), "Odd": (0, b"\x20\x01\x01", [])},
        },
    },
}


def test_manifest_resources(spark):
    held = struct.pack("<I", 3) + b"abc\0" + struct.pack("<I", 9_999)
    manifest = [(0, 1, "App.g.resources", 0), (0, 2, "Beside.json", (1 << 2) | 0), (0, 1, "Other.baml", (1 << 2) | 1), (8, 1, "Cut", 0), (0, 1, "Lost", (7 << 2) | 0)]
    data = image_bytes(managed={"assembly": "A", "references": ["Ref"], "types": [("", "T", [])], "files": ["beside.bin"], "manifest": manifest, "held": held}, library=True)
    found = images.read_image(data)["resources"]
    assert [(r["name"], r["visibility"], r["location"], r["size"], r["content"]) for r in found[:3]] == [("App.g.resources", "public", "embedded", 3, b"abc"), ("Beside.json", "private", "file:beside.bin", None, None), ("Other.baml", "public", "assembly:Ref", None, None)]
    assert [r["error"] for r in found] == [None, None, None, "the resource ends early", "the resource's place is unknown"]
    inventory = images.read_image(data, with_code=False)["resources"]
    assert inventory[0]["size"] == 3 and inventory[0]["content"] is None
    df = spark.createDataFrame([("a", bytearray(data))], "id string, content binary").select("id", images.image()(F.col("content")).alias("image"))
    assert [r.kind for r in images.resources_table(df).orderBy("ord").collect()] == ["resource-table", "configuration", "markup", "data", "data"]


def test_shapes_of_types():
    r = images.read_image(image_bytes(managed=RICH, bodies=[TINY]))
    by = {t["name"]: t for t in r["types"]}
    assert (by["Color"]["kind"], by["IRun"]["kind"], by["Box`1"]["kind"]) == ("enum", "interface", "class")
    assert [(f["name"], f["type"], f["constant"]) for f in by["Color"]["fields"]] == [("value__", "byte", None), ("Red", "N.Color", "7")]
    assert [(f["name"], f["type"]) for f in by["Box`1"]["fields"]] == [("items", "string[]"), ("grid", "int[,]"), ("own", "N.Box<T0>"), ("bad", "object")]
    make, odd = by["Box`1"]["methods"]
    assert (make["return_type"], make["is_static"], [(p["name"], p["type"]) for p in make["parameters"]]) == ("System.Text.StringBuilder", True, [("first", "byte*"), ("second", "ref int"), ("", "M0")])
    assert (odd["return_type"], r["truncated"], r["error"]) == ("object", True, None)


def test_a_body_that_cannot_be_read_gives_no_edges():
    data = image_bytes(managed={"assembly": "a", "references": [], "types": [("", "T", [("Good", 0), ("Bad", 1)])]}, bodies=[TINY, BROKEN])
    r = images.read_image(data)
    assert r["truncated"] and len(r["calls"]) == 3 and r["error"] is None


def test_address_ranges():
    sections = [(0x1000, 0x500, 0x400, 0x200), (0x2000, 0x10, 0x600, 0x200)]
    to = lambda rva: images.rva_to_offset(rva, 0x400, sections)
    assert (to(0x10), to(0x1000), to(0x11FF), to(0x1200), to(0x2100), to(0x3000)) == (0x10, 0x400, 0x5FF, None, 0x700, None)


def test_image_tables(spark):
    df = spark.createDataFrame([("a.dll", bytearray(managed())), ("b.exe", bytearray(image_bytes(["X.dll"]))), ("c.txt", bytearray(b"text")), ("d", None)], "id string, content binary")
    got = df.select("id", images.image()(F.col("content")).alias("image")).cache()
    assert {r.id for r in got.where("image is not null").collect()} == {"a.dll", "b.exe"}
    assert {(r.full_name, r.method_count) for r in images.types_table(got).collect()} == {("<Module>", 0), ("My.Main", 2), ("My.Inner", 1)}
    assert images.calls_table(got).count() == 3
    assert sorted((r.source, r.kind, r.name) for r in images.references_table(got).collect()) == [("a.dll", "assembly-reference", "PresentationFramework"), ("a.dll", "assembly-reference", "System.Runtime"), ("b.exe", "pe-import", "X.dll")]


def test_bundle_marker(spark):
    at = lambda offset, more=100: struct.pack("<q", offset) + images.MARKER + bytes(more)
    cases = [(at(60), True), (at(5), False), (at(9999), False), (images.MARKER + bytes(50), False), (at(1) + at(200), True), (b"", False)]
    df = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(cases)], "i int, content binary")
    assert [r.x for r in df.select("i", images.bundle_marker(F.col("content")).alias("x")).orderBy("i").collect()] == [w for _, w in cases]


SLN = '\ufeffMicrosoft Visual Studio Solution File, Format Version 12.00\nProject("{1}") = "App", "src\\App\\App.csproj", "{2}"\nProject("{3}") = "Folder", "Folder", "{4}"\n'
SLNX = '<Solution><Folder Name="/x/"><Project Path="src/App/App.csproj" /><Project Path="src/Lib/Lib.csproj" /></Folder></Solution>'
APP = """<Project Sdk="S"><PropertyGroup><TargetFrameworks>net8.0;net9.0</TargetFrameworks><OutputType>Exe</OutputType></PropertyGroup>
<ItemGroup><ProjectReference Include="..\\Lib\\Lib.csproj" /><ProjectReference Include="..\\Gone\\Gone.csproj" /><ProjectReference Include="$(X)\\Y.csproj" />
<PackageReference Include="Central" /><PackageReference Include="Own" Version="1.2.3" /><PackageReference Include="Expr" Version="$(V)" /><PackageReference Include="Nested"><Version>4</Version></PackageReference></ItemGroup>
<ItemGroup Condition="'$(A)'==''"><PackageReference Include="Maybe" Version="1" /></ItemGroup></Project>"""
LIB = '<Project><PropertyGroup><OutputType Condition="x">Exe</OutputType></PropertyGroup></Project>'
PROPS = "<Project><PropertyGroup><TargetFramework>net8.0</TargetFramework><OutputType>Library</OutputType></PropertyGroup></Project>"
PACKAGES = '<Project><ItemGroup><PackageVersion Include="central" Version="9.9" /></ItemGroup></Project>'


def test_project_graph(spark):
    contents = {"All.sln": SLN, "All.slnx": SLNX, "src/App/App.csproj": APP, "src/Lib/Lib.csproj": LIB, "Directory.Build.props": PROPS, "src/Directory.Packages.props": PACKAGES, "Bad.csproj": "<!DOCTYPE x><Project/>", "Wrong.sln": "nope"}
    f = frame(spark, {k: v.encode() for k, v in contents.items()}).withColumn("file_name", F.element_at(F.split("id", "/"), -1))
    items = projects.declared(f).cache()
    assert {(r.path, r.status) for r in items.where("status <> 'read'").collect()} == {("Bad.csproj", "invalid"), ("Wrong.sln", "invalid")}
    values = projects.property_values(items).cache()
    got = {r.id: (r.kind, r.target_framework, r.output_type) for r in projects.components(f, values).collect()}
    assert got["src/App/App.csproj"] == ("source-project", "net8.0;net9.0", "Exe")
    # A declared value that is conditional blocks the inherited one.
    assert got["src/Lib/Lib.csproj"] == ("source-project", "net8.0", None) and got["All.sln"][0] == "solution"
    refs = {(r.source, r.target, r.kind): (r.status, r.version) for r in projects.references(items, f).collect()}
    app = "src/App/App.csproj"
    assert refs["All.sln", app, "solution-project"] == ("resolved", None) == refs["All.slnx", "src/Lib/Lib.csproj", "solution-project"]
    assert refs[app, "src/Lib/Lib.csproj", "project-reference"][0] == "resolved" and refs[app, "src/Gone/Gone.csproj", "project-reference"][0] == "missing"
    assert refs[app, "$(X)\\Y.csproj", "project-reference"][0] == "unevaluated"
    package = lambda n: refs[app, n, "package-reference"]
    assert (package("Central"), package("Own"), package("Expr"), package("Nested"), package("Maybe")) == (("external", "9.9"), ("external", "1.2.3"), ("unevaluated", None), ("external", "4"), ("conditional", None))


NATIVE = {
    "schemaVersion": 2, "functionCount": 3, "truncated": False,
    "functions": [{"name": "f", "address": "10", "signature": "s", "external": False}, {"name": "f", "address": "20", "signature": "s", "external": False}, {"name": "e", "address": "30", "signature": "s", "external": True}],
    "callGraph": {"truncated": False, "calls": [
        {"callerAddress": "10", "callSiteAddress": "11", "targetAddress": "20", "isIndirect": False}, {"callerAddress": "10", "callSiteAddress": "12", "targetAddress": "10", "isIndirect": False},
        {"callerAddress": "10", "callSiteAddress": "13", "targetAddress": "30", "isIndirect": True}, {"callerAddress": "20", "callSiteAddress": "21", "targetAddress": None, "isIndirect": True}, {"callerAddress": "20", "callSiteAddress": "22", "targetAddress": None, "isIndirect": False}]},
}


def changed(**paths):
    out = json.loads(json.dumps(NATIVE))
    for path, value in paths.items():
        at = out
        *above, leaf = [int(p) if p.isdigit() else p for p in path.split("__")]
        for p in above:
            at = at[p]
        if value is ...:
            del at[leaf]
        else:
            at[leaf] = value
    return json.dumps(out)


def test_native_document(spark):
    df = spark.createDataFrame([("a", changed()), ("b", changed(schemaVersion=1, callGraph=...)), ("c", "{}")], "id string, text string")
    docs = df.select("id", native.native_document(F.col("text")).alias("native")).cache()
    assert {r.id: (r.native.status, r.native.calls is None) for r in docs.collect()} == {"a": ("ok", False), "b": ("ok", True), "c": ("invalid", True)}
    calls, functions = native.calls_table(docs), native.functions_table(docs)
    assert calls.count() == 5 and calls.agg(native.unresolved_calls().alias("n")).first().n == 2 and functions.count() == 6
    shown = {(r.site): (r.caller_shown, r.target_shown) for r in native.display_names(calls, functions).collect()}
    assert shown["11"] == ("f (10)", "f (20)") and shown["21"] == ("f (20)", "unresolved")


MUTATIONS = [
    {"schemaVersion": 4}, {"schemaVersion": True}, {"functionCount": 2}, {"functionCount": 9}, {"functions__1__address": "10"}, {"functions__0__name": " "}, {"functions__0__external": "no"}, {"functions__0__address": ""},
    {"callGraph": ...}, {"callGraph__truncated": ...}, {"callGraph__calls__0__callerAddress": "30"}, {"callGraph__calls__0__callerAddress": "99"}, {"callGraph__calls__0__targetAddress": "99"}, {"callGraph__calls__0__targetAddress": ...},
    {"callGraph__calls__1": NATIVE["callGraph"]["calls"][0]}, {"callGraph__calls__1": {"callerAddress": "10", "callSiteAddress": "11", "targetAddress": "10", "isIndirect": True}}, {"callGraph__calls__0__isTailCall": False}, {"schemaVersion": 3}, {"truncated": "x"},
]


@pytest.mark.parametrize("case", range(len(MUTATIONS)))
def test_native_schema_is_strict(case):
    assert native.read_native(changed(**MUTATIONS[case]))["status"] == "invalid"


def test_native_limits_and_tail_calls(monkeypatch):
    third = json.loads(changed(schemaVersion=3))
    for i, c in enumerate(third["callGraph"]["calls"]):
        c["isTailCall"] = i == 0
    assert [c["tail"] for c in native.read_native(json.dumps(third))["calls"]] == [True, False, False, False, False]
    third["callGraph"]["calls"][1]["isTailCall"] = True  # calls itself
    assert native.read_native(json.dumps(third))["status"] == "invalid"
    assert native.read_native(changed().replace('"truncated": false', '"truncated": false, "truncated": false', 1))["status"] == "invalid"
    monkeypatch.setattr(native, "MAX_FUNCTIONS", 1)
    cut = native.read_native(changed())
    assert (cut["truncated"], len(cut["functions"]), len(cut["calls"]), cut["calls_truncated"]) == (True, 1, 1, True)


def test_pseudocode():
    text = json.dumps({"decompilation": {"inputSha256": "0" * 64, "complete": True, "functions": [{"address": "10", "status": "success", "code": "x"}]}})
    assert native.read_pseudocode(text)["rows"] == [{"address": "10", "status": "success", "code": "x"}] and native.read_pseudocode("{}")["status"] == "invalid"


def test_resource_table():
    data = resource_bytes([("text", 1, text7("hi")), ("odd", 64, b"\1\2\3"), ("n", 8, struct.pack("<i", 7))], ["Some.Type, X"])
    r = resources.read_table(data)
    assert r["status"] == "parsed" and [(e["name"], e["type"], e["data"]) for e in r["entries"]] == [("text", "System.String", b"\2hi"), ("odd", "Some.Type, X", b"\1\2\3"), ("n", "System.Int32", struct.pack("<i", 7))]
    assert resources.read_table(data, 1)["truncated"] and resources.read_table(b"x")["status"] == "not matched" == resources.read_table(None)["status"]
    assert resources.read_table(resource_bytes([("a", 1, b""), ("b", 1, b"")], positions=[0, 0]))["status"] == "invalid"
    assert resources.read_table(resource_bytes([("a", 70, b"")]))["status"] == "invalid" == resources.read_table(data[:-40])["status"]


def test_markup(spark):
    symbol = record(29, struct.pack("<hh", 5, 1) + text7("N.Type"), True) + record(31, struct.pack("<hhB", 6, 5, 0) + text7("Name"), True) + record(32, struct.pack("<h", 7) + text7("s"), True) + record(28, struct.pack("<h", 1) + text7("Asm"), True)
    body = record(1, bytes(6)) + symbol + record(3, bytes(3)) + record(3, bytes(3)) + record(4) + record(3, bytes(3)) + record(4) + record(4) + record(2)
    r = resources.read_records(markup_bytes(body))
    assert (r["status"], len(r["records"]), r["types"][0]["name"], r["attributes"][0]["owner"], r["strings"][0]["value"], r["assemblies"][0]["name"]) == ("parsed", 12, "N.Type", 5, "s", "Asm")
    assert resources.read_records(markup_bytes(record(3, bytes(2))))["status"] == "partial" and resources.read_records(markup_bytes(record(200)))["error"]
    assert resources.read_records(markup_bytes(version=(0, 95)))["error"] and resources.read_records(b"")["status"] == "invalid"
    df = spark.createDataFrame([("m", bytearray(markup_bytes(body)))], "id string, content binary").select("id", resources.markup_records(F.col("content")).alias("m"))
    tree = graph.element_tree(resources.element_records(df), ["id"], "ord", "kind").orderBy("ord").collect()
    assert [(t.depth, t.parent, t.children) for t in tree] == [(1, None, 2), (2, tree[0].ord, 0), (2, tree[0].ord, 0)]
    assert {(r.name, r.n) for r in resources.record_usage(df).collect()} >= {("ElementStart", 3), ("ElementEnd", 3), ("TypeInfo", 1)}


def test_deferred_links(spark):
    sections = spark.createDataFrame([("s", 100, 200)], "section string, content_start long, content_end long")
    keys = spark.createDataFrame([("s", 0, 0), ("s", 1, 40), ("s", 2, 30)], "section string, key_ord int, position long")
    ranges = resources.deferred_ranges(keys, sections)
    assert [(r.low, r.high, r.ok) for r in ranges.orderBy("key_ord").collect()] == [(100, 140, True), (140, 130, True), (130, 200, False)]
    good = resources.deferred_ranges(keys.where("key_ord < 2"), sections)
    assert resources.direct_children_agree(good, spark.createDataFrame([("s", 140), ("s", 100)], "section string, start long")).first().ok
    swapped = resources.deferred_ranges(keys.where("key_ord > 0"), sections)
    assert not resources.direct_children_agree(swapped, spark.createDataFrame([("s", 140), ("s", 130)], "section string, start long")).first().ok
    refs = spark.createDataFrame([("s", 139, 1), ("s", 140, 1), ("s", 150, 9)], "section string, offset long, local_id int")
    local = spark.createDataFrame([("s", 0, 1, "a"), ("s", 1, 1, "b")], "section string, key_ord int, local_id int, value string")
    assert {(r.offset, r.value, r.complete) for r in resources.link_local_values(refs, good, local).collect()} == {(139, "a", True), (140, "b", True), (150, None, False)}
    assert [r.stop for r in resources.entry_ends(spark.createDataFrame([("r", 5, 90), ("r", 1, 90)], "k string, position int, limit int"), "k").orderBy("position").collect()] == [5, 90]


def test_entries_at_one_position_go_by_their_other_columns(spark):
    rows = [("r", 5, 90, 2), ("r", 9, 90, 4), ("r", 5, 90, 1), ("r", 5, 90, 3)]
    for given in (rows, rows[::-1]):
        entries = spark.createDataFrame(given, "k string, position int, limit int, id int")
        assert {r.id: r.stop for r in resources.entry_ends(entries, "k").collect()} == {1: 5, 2: 5, 3: 9, 4: 90}
