import pytest
from pyspark.sql import functions as F

from sparkstrata.functions import paths, structure, text
from sparkstrata.operators import classify, detect, graph, ordering, summary, validate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_greedy_budget_is_no_running_sum(spark):
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate([5, 9, 3, 4])], "g string, ord int, cost int")
    assert [r.cost for r in ordering.greedy_budget(df, ["g"], ["ord"], "cost", 12).orderBy("ord").collect()] == [5, 3, 4]
    assert [r.cost for r in ordering.greedy_budget(df, ["g"], ["ord"], "cost", 99, most_rows=2).orderBy("ord").collect()] == [5, 9]
    assert [r.cost for r in ordering.prefix_budget(df, ["g"], [F.col("ord")], "cost", 12, 8).orderBy("ord").collect()] == [5, 3, 4]


def test_budgets_that_fail_all(spark):
    df = spark.createDataFrame([(5,), (6,)], "size int")
    assert ordering.require_budget(df, "size", 2, 11).count() == 2
    for rows, size in ((1, 99), (9, 10)):
        with pytest.raises(Exception, match="exceeds"):
            ordering.require_budget(df, "size", rows, size)


def test_cap_with_overflow(spark):
    df = spark.createDataFrame([("g", i, f"m{i}") for i in range(5)] + [("h", 0, "x")], "g string, ord int, text string")
    got = sorted((r.g, r.position, r.text) for r in ordering.cap_with_overflow(df, ["g"], "ord", "text", 3).collect())
    assert got == [("g", 1, "m0"), ("g", 2, "m1"), ("g", 3, "m2"), ("g", 4, "2 more"), ("h", 1, "x")]


PATHS = {("a/b", "c"): "a/b/c", ("a/b", "..\\c"): "a/c", ("a", "../../c"): None, ("", "x/./y"): "x/y", ("a", "/c"): None, ("a", "C:\\x"): None, ("a/b", "../../.."): None, ("a", ".."): ""}


@pytest.mark.parametrize("case", PATHS)
def test_resolve_path(spark, case):
    assert one(spark, paths.resolve(F.lit(case[0]), F.lit(case[1]))) == PATHS[case]


def test_path_parts(spark):
    assert one(spark, paths.directory_segments(F.lit("a\\b//c.txt"))) == ["a", "b"]
    assert one(spark, paths.directory_segments(F.lit("/c.txt"))) == [] == one(spark, paths.directory_segments(F.lit("c")))
    assert one(spark, paths.ancestors(F.lit("a/b/c"))) == ["a/b", "a", ""]
    prefix = lambda a, b: one(spark, paths.common_prefix(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert (prefix(["A", "b"], ["a", "B", "c"]), prefix(["x"], ["y"]), prefix(["x", "y", "z"], ["x", "q", "z"])) == (2, 0, 1)
    assert [one(spark, f(F.lit("d.x/n.tar.gz"))) for f in (paths.extension, paths.stem, paths.file_name)] == [".gz", "n.tar", "n.tar.gz"]
    assert one(spark, paths.has_excluded_directory(F.lit("a/OBJ/x.cs"), ["obj"])) and not one(spark, paths.has_excluded_directory(F.lit("a/obj"), ["obj"]))


def test_text(spark):
    literal = lambda s: one(spark, text.is_literal(F.lit(s)))
    assert literal("net8.0") and not any(map(literal, [" ", "$(X)", "a;b", "a*", "x" * 2049]))
    portable = lambda s: one(spark, text.is_portable_segment(F.lit(s)))
    assert portable("a.txt") and not any(map(portable, ["", "..", "CON", "nul.txt", "a.", "a ", "a:b", "é" * 128, "\x01"]))
    assert one(spark, text.utf16_prefix(F.lit("a😀b"), 2)) == "a" and one(spark, text.utf16_prefix(F.lit("a😀b"), 3)) == "a😀" and one(spark, text.utf16_length(F.lit("a😀b"))) == 4
    long = one(spark, text.bounded_text(F.lit("x" * 600)))
    assert len(long) == 512 and "…#" in long and one(spark, text.bounded_text(F.lit("a\nb"))) == "a�b"
    assert [one(spark, text.byte_units(F.lit(n))) for n in (5, 2048, 3 << 20)] == ["5 B", "2.0 KiB", "3.0 MiB"]
    assert one(spark, text.sanitise_identifier(F.lit("1a-b"))) == "_1a_b" and one(spark, text.simple_name(F.lit("N.Outer+Inner`2[x]"))) == "Inner"
    assert one(spark, text.integral_value(F.lit("int"), F.lit("-5"))) == "-5" and one(spark, text.integral_value(F.lit("string"), F.lit("5"))) is None


def test_classification(spark):
    kind = lambda p, h=b"": tuple(one(spark, classify.classify(F.lit(p), F.lit(bytearray(h)))))
    assert kind("x.jar", b"PK\x03\x04") == ("archive", "Java archive") and kind("x.txt", b"PK\x05\x06") == ("archive", "ZIP archive")
    assert kind("x.7z") == ("archive", "7Z archive") and kind("x.msi") == ("unknown", "MSI") and kind("x.msi", bytes.fromhex("D0CF11E0A1B11AE1")) == ("archive", "Windows Installer package")
    assert kind("x", b"SQLite format 3\0") == ("database", "SQLite/database file") and kind("x") == ("unknown", "Unknown") and kind("d.q/App.CSPROJ") == ("project", "CSPROJ project")
    assert one(spark, classify.architecture(F.lit(0x8664))) == "x64" and one(spark, classify.architecture(F.lit(0x1234))) == "0x1234"


def names(spark, path="a.exe", content=b"", managed=False, executable=True, imports=(), references=(), sections=(), bundle=False, image=True):
    lists = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    struct = F.struct(F.lit(managed).alias("is_managed"), F.lit(executable).alias("is_executable"), lists(imports).alias("imports"), lists(references).alias("references"), lists(sections).alias("sections"))
    rules = detect.file_rules(F.lit(path), struct if image else F.when(F.lit(False), struct), F.lit(bundle), F.lit(bytearray(content)))
    return [(r.id, r.confidence) for r in one(spark, detect.findings(rules))]


RULES = [
    ({"bundle": True, "content": b"Go build ID:"}, [("dotnet-single-file", 1.0)]),
    ({"managed": True, "references": ["presentationframework", "Avalonia.Base", "UnityEngine.Core", "System.Windows.Forms"]}, [("dotnet", 1.0), ("wpf", 0.99), ("winforms", 0.99), ("avalonia", 0.98), ("unity-mono", 0.97)]),
    ({"imports": ["MSVBVM60.dll", "python311.dll"]}, [("vb6", 0.99), ("python", 0.97)]),
    ({"content": "PyInstaller".encode("utf-16-le")}, [("pyinstaller", 0.94)]),
    ({"sections": [".GOPCLNTAB"], "content": b"rust_begin_unwind"}, [("go", 0.96), ("rust", 0.82)]),
    ({"imports": ["qt6core.dll", "WebView2Loader.dll", "vcruntime140.dll"], "content": b"__TAURI__"}, [("qt", 0.98), ("tauri", 0.85), ("msvc", 0.9)]),
    ({"imports": ["vcl50.bpl"]}, [("delphi", 0.86)]),
    ({"imports": ["vcl50.dll"]}, []),
    ({"path": "f.DFM", "image": False}, [("delphi", 0.86)]),
    ({"content": b"krnln.fnr lpEWindow"}, [("easy-language", 0.99)]),
    ({"content": b"lpEWindow"}, [("easy-language", 0.74)]),
    ({"content": b"Inno Setup Nullsoft.NSIS"}, [("inno-setup", 0.97), ("nsis", 0.97)]),
    ({"content": b"Inno Setup", "executable": False}, []),
    ({"content": b"PyInstaller", "image": False}, []),
]


@pytest.mark.parametrize("case", range(len(RULES)))
def test_file_rules(spark, case):
    assert names(spark, **RULES[case][0]) == RULES[case][1]


def test_package_rules(spark):
    rows = [(1, "electron.exe", "electron.exe", "PE image", []), (1, "UnityPlayer.dll", "UnityPlayer.dll", "", []), (1, "x", "Game_Data/x", "", []), (2, "a.ec", "a.ec", "", []), (3, "a.fne", "a.fne", "", []), (3, "b.e", "b.e", "", []), (4, "j.jar", "j.jar", "Java archive", []), (5, "WebView2Loader.dll", "w", "", []), (5, "app.exe", "app.exe", "", ["tauri"])]
    df = spark.createDataFrame(rows, "run int, file_name string, relative_path string, format string, technologies array<string>")
    got = sorted((r.run, r.id, r.confidence) for r in detect.package_detections(df, ["run"]).collect())
    assert got == [(1, "electron", 0.99), (1, "unity", 0.99), (2, "easy-language", 0.55), (3, "easy-language", 0.99), (4, "jvm", 0.92), (5, "tauri", 0.92)]


def test_merge_takes_the_first_of_the_most_confident(spark):
    df = spark.createDataFrame([("g", 0, "Go", "A", "c1", 0.5, "x"), ("g", 1, "go", "B", "c2", 0.9, "X"), ("g", 2, "GO", "C", "c3", 0.9, "b")], "g string, ord int, id string, name string, category string, confidence double, evidence string")
    r = detect.merge(df, ["g"], "ord").first()
    assert (r.id, r.name, r.category, r.confidence, r.evidence) == ("Go", "B", "c2", 0.9, ["b", "x"])


@pytest.mark.parametrize("few", [10**6, 0])
def test_graphs(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "LOCAL_EDGES", few)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6)], "src long, dst long")
    assert sorted(r.node for r in graph.cyclic_nodes(edges).collect()) == [1, 2, 3]
    assert {(r.src, r.dst) for r in graph.acyclic_edges(edges).where("cyclic").collect()} == {(1, 2), (2, 3), (3, 1)}
    nodes = spark.createDataFrame([(i, i == 6) for i in range(1, 7)], "node long, incomplete boolean")
    assert {r.node for r in graph.incomplete_closure(nodes, edges).where("incomplete").collect()} == {5, 6}
    line = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "d")], "src string, dst string")
    layers = {r.node: r.layer for r in graph.dependency_layers(spark.createDataFrame([(x,) for x in "abcd"], "node string"), line).collect()}
    assert layers == {"a": 2, "b": 1, "c": 0, "d": None}
    flags = spark.createDataFrame([(1, None, False), (2, 1, False), (3, 2, True), (4, 1, False)], "id int, parent int, unsafe boolean")
    assert {r.id for r in graph.descendants_flag(flags, "unsafe").where("in_tree").collect()} == {1, 2, 3}


@pytest.mark.parametrize("few", [10**6, 0])
def test_graphs_have_no_bound_on_hops(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "LOCAL_EDGES", few)
    ring = [(i, (i + 1) % 20) for i in range(20)]
    edges = spark.createDataFrame(ring + [(30, 3), (3, 40), (41, 42), (42, 41), (40, 41)], "src long, dst long")
    assert {r.node for r in graph.cyclic_nodes(edges).collect()} == {*range(20), 41, 42}
    assert {(r.src, r.dst) for r in graph.acyclic_edges(edges).where("not cyclic").collect()} == {(30, 3), (3, 40), (40, 41)}
    loops = {r.node: r.loop for r in graph.strong_components(edges).collect()}
    assert len({loops[i] for i in range(20)}) == 1 and loops[0] != loops[41] == loops[42]
    nodes = spark.createDataFrame([(i, i == 42) for i in [*range(20), 30, 40, 41, 42, 50]], "node long, incomplete boolean")
    assert {r.node for r in graph.incomplete_closure(nodes, edges).where("incomplete").collect()} == {*range(20), 30, 40, 41, 42}


def test_a_thousand_chained_projects(spark):
    edges = spark.range(999).selectExpr("id as src", "id + 1 as dst")
    layers = {r.node: r.layer for r in graph.dependency_layers(spark.range(1000).withColumnRenamed("id", "node"), edges).collect()}
    assert layers == {i: 999 - i for i in range(1000)} and graph.cyclic_nodes(edges).count() == 0


def test_links(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "f"), ("c", "d"), ("d", "c"), ("e", "gone")], "path string, target string")
    nodes = spark.createDataFrame([("f", "file"), ("a", "link")], "path string, kind string")
    assert {r.path: (r.final, r.status) for r in graph.resolve_links(links, nodes).collect() if r.status != "cycle"} == {"a": ("f", "resolved"), "b": ("f", "resolved"), "e": ("gone", "missing")}
    assert {r.path for r in graph.resolve_links(links, nodes).where("status = 'cycle'").collect()} == {"c", "d"}


def test_owner_chain(spark):
    items = spark.createDataFrame([(1, None, True), (2, 1, True), (3, 2, True), (4, 9, True), (5, 6, True), (6, 5, True), (7, None, False), (8, 7, True)], "id int, parent int, ok boolean")
    got = {r.id: r.complete for r in graph.owner_chain(items).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False, 8: False}


def test_long_and_many_owner_chains(spark):
    chain = spark.range(3000).selectExpr("id", "case when id > 0 then id - 1 end as parent", "id <> 5 as ok")
    got = {r.id: (r.root, r.depth, r.complete) for r in graph.owner_chain(chain).collect()}
    assert got == {i: (0, i, i < 5) for i in range(3000)}
    tree = spark.range(1, 300_001).selectExpr("id", "case when id > 1 then floor(id / 2) end as parent", "true as ok")
    assert graph.owner_chain(tree).agg(F.sum("depth"), F.count_if(F.col("complete") & (F.col("root") == 1))).first() == (sum(i.bit_length() - 1 for i in range(1, 300_001)), 300_000)


def test_validation(spark):
    ranges = spark.createDataFrame([("a", 0, 10), ("a", 0, 10), ("a", 10, 5), ("a", 12, 9), ("b", 0, 1), ("b", 3, 0)], "k string, at int, size int")
    assert [(r.low, r.high) for r in validate.overlapping_intervals(ranges, ["k"], "at", "size").collect()] == [(12, 21)]
    files = spark.createDataFrame([("r", "a"), ("r", "A/b"), ("r", "c/d")], "run string, path string")
    assert [r.path for r in validate.file_directory_conflicts(files, ["run"], "path").collect()] == ["a"]
    assert one(spark, validate.strict_json(F.lit('{"a":1,"a":2}'))) is None and one(spark, validate.strict_json(F.lit('{"a":1}'))) is not None
    rule = lambda *v: one(spark, validate.tail_call_rule(*[F.lit(x) for x in v]))
    assert rule(False, True, "a", "b", 3) and not rule(False, True, "a", "a", 3) and not rule(True, True, "a", "b", 3) and not rule(False, False, "a", "b", 2)
    with pytest.raises(ValueError, match="depth"):
        validate.check_ranges({"depth": 99}, {"depth": (0, 64)})
    proof = spark.createDataFrame([("f", "0" * 64, "success", "x"), ("g", "0" * 64, "failed", "x"), ("h", "zz", "success", "x"), ("i", "0" * 64, "failed", None)], "file string, sha256 string, status string, code string")
    assert {r.file for r in validate.pseudocode_evidence(proof, 10, 10).where("ok").collect()} == {"f", "i"}


def test_structure():
    got = structure.json_paths('{"outer":{"scalar":1,"array":["x"]},"b":[{"c":2}]}')
    assert got["paths"] == ["outer", "b", "outer.scalar", "outer.array", "outer.array[]", "b[]", "b[].c"] and got["status"] == "parsed" and got["root"] == "object"
    assert structure.json_paths('{"a":1,"a":2}')["status"] == "invalid" == structure.json_paths("{")["status"] == structure.json_paths('{"\\ud800":1}')["status"] == structure.json_paths(None)["status"]
    assert structure.json_paths("﻿{}")["status"] == "parsed" and structure.json_paths("[" * 40 + "]" * 40)["status"] == "partial"
    many = structure.json_paths("{" + ",".join(f'"k{i}":1' for i in range(300)) + "}")
    assert (many["status"], len(many["paths"]), many["truncated"]) == ("partial", 200, True)
    x = structure.xml_paths('<a xmlns="u"><b c="1" d="2"><e.f/></b></a>')
    assert x["paths"] == ["a", "a/b", "a/b/@c", "a/b/@d", "a/b/e.f"] and x["status"] == "parsed"
    assert structure.xml_paths("<!DOCTYPE a><a/>")["status"] == "invalid" == structure.xml_paths("<a>")["status"]


def test_image_headers(spark):
    import struct
    import zlib

    body = b"IHDR" + struct.pack(">II5B", 640, 480, 8, 6, 0, 0, 0)
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + body + struct.pack(">I", zlib.crc32(body))
    gif = b"GIF89a" + struct.pack("<HH", 300, 20) + b"\0\0\0"
    read = lambda b: one(spark, structure.image_header(F.lit(bytearray(b))))
    assert tuple(read(png)) == ("png", 640, 480) and tuple(read(gif)) == ("gif", 300, 20)
    assert read(png[:-1] + b"\0") is None and read(b"") is None and read(gif[:9]) is None


def test_summary(spark):
    files = spark.createDataFrame([("executable", True, 5, 2, None, None), ("library", False, None, None, 3, "bad")], "category string, is_managed boolean, size long, type_count int, method_count int, error string")
    deps = spark.createDataFrame([(True,), (False,), (False,)], "resolved boolean")
    assert summary.package_summary(files, deps).first().asDict() == {"files": 2, "executables": 1, "libraries": 1, "archives": 0, "managed": 1, "failed": 1, "bytes": 5, "types": 2, "methods": 3, "dependencies": 3, "resolved": 1, "unresolved": 2}
    named = spark.createDataFrame([(1, "App"), (2, "APP"), (3, "Lib")], "ord int, name string")
    assert [(r.name, r.duplicate) for r in summary.unique_names(named, "name", "ord", F.concat(F.lit("p"), F.col("ord").cast("string"))).orderBy("ord").collect()] == [("p1", True), ("p2", True), ("Lib", False)]
