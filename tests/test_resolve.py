import pytest
from pyspark.sql import functions as F

from sparkstrata.operators import resolve

FILES = "id string, file_name string, assembly_name string, relative_path string, origin struct<kind:string,container:string,entry:string,depth:int>"


def files(spark, *rows):
    out = []
    for r in rows:
        path, origin = r if isinstance(r, tuple) else (r, ("direct", None, None, 0))
        out.append((path, path.replace("\\", "/").split("/")[-1], None, path, origin))
    return spark.createDataFrame(out, FILES)


def target(spark, source, name, *rows):
    refs = spark.createDataFrame([(source, "pe-import", name, 0)], "source string, kind string, name string, ord int")
    r = resolve.nearest_candidate(refs, files(spark, *rows)).collect()
    assert len(r) == 1
    return r[0].target, r[0].resolved


ASAR = lambda entry, container="app.asar", depth=1: ("asar", container, entry, depth)

CASES = {
    "same container wins": ("app.asar/bin/app.exe", [("app.asar/bin/app.exe", ASAR("bin/app.exe")), ("app.asar/lib/foo.dll", ASAR("lib/foo.dll")), ("app.asar/bin/inner.asar/foo.dll", ASAR("foo.dll", "app.asar/bin/inner.asar", 2))], ("app.asar/lib/foo.dll", True)),
    "longest common prefix": ("suite/bin/tools/app.exe", ["suite/bin/tools/app.exe", "suite/bin/lib/foo.dll", "other/lib/foo.dll"], ("suite/bin/lib/foo.dll", True)),
    "same directory on a tie": ("app.exe", ["app.exe", "foo.dll", "plugins/foo.dll"], ("foo.dll", True)),
    "same directory over a deeper one": ("suite/app.exe", ["suite/app.exe", "suite/foo.dll", "suite/x64/foo.dll"], ("suite/foo.dll", True)),
    "still tied": ("app.asar/main/app.exe", [("app.asar/main/app.exe", ASAR("main/app.exe")), ("app.asar/a/foo.dll", ASAR("a/foo.dll")), ("app.asar/b/foo.dll", ASAR("b/foo.dll"))], ("FOO.dll", False)),
    "one candidate anywhere": ("a/app.exe", ["a/app.exe", "z/y/foo.dll"], ("z/y/foo.dll", True)),
    "none": ("a/app.exe", ["a/app.exe"], ("FOO.dll", False)),
    "backslashes and case": ("Suite\\bin\\app.exe", ["Suite\\bin\\app.exe", "SUITE/bin/foo.dll", "x/foo.dll"], ("SUITE/bin/foo.dll", True)),
}


@pytest.mark.parametrize("case", CASES)
def test_nearest_candidate(spark, case):
    source, rows, want = CASES[case]
    assert target(spark, source, "FOO.dll", *rows) == want


def test_edges_equal_without_case_count_once(spark):
    refs = spark.createDataFrame([("a.exe", "pe-import", "X.dll", 1), ("a.exe", "pe-import", "x.DLL", 0)], "source string, kind string, name string, ord int")
    assert [r.target for r in resolve.nearest_candidate(refs, files(spark, "a.exe")).collect()] == ["x.DLL"]


def test_every_status(spark):
    targets = spark.createDataFrame([("a/p.csproj", True), ("A/P.csproj", True), ("b/q.csproj", True), ("c/r.csproj", False)], "path string, retained boolean")
    refs = spark.createDataFrame([("s", "a/p.csproj", False), ("s", "A/p.csproj", False), ("s", "B/Q.csproj", False), ("s", "c/r.csproj", False), ("s", "none", False), ("s", None, False), ("s", "b/q.csproj", True)], "source string, path string, conditional boolean")
    got = {(r.path, r.status): r.target for r in resolve.reference_status(refs, targets).collect()}
    assert got == {("a/p.csproj", "resolved"): "a/p.csproj", ("A/p.csproj", "ambiguous"): None, ("B/Q.csproj", "resolved"): "b/q.csproj", ("c/r.csproj", "unevaluated"): None, ("none", "missing"): None, (None, "unevaluated"): None, ("b/q.csproj", "conditional"): None}


def test_nearest_ancestor_stays_above_its_floor(spark):
    items = spark.createDataFrame([(1, "x.asar/a/b/p.csproj"), (2, "x.asar/c/p.csproj")], "id int, path string")
    shared = spark.createDataFrame([("Directory.Build.props",), ("x.asar/a/directory.build.PROPS",)], "path string")
    got = {r.id: r.file for r in resolve.nearest_ancestor(items, shared, "Directory.Build.props", F.lit("x.asar")).collect()}
    assert got == {1: "x.asar/a/directory.build.PROPS"}
    assert {r.id: r.levels_up for r in resolve.nearest_ancestor(items, shared, "Directory.Build.props").collect()} == {1: 1, 2: 2}


@pytest.mark.parametrize("width", [None, 7, 1000])
def test_intervals_are_half_open(spark, width):
    i = spark.createDataFrame([("k", 1, 0, 10), ("k", 2, 10, 11), ("k", 3, 5, 5), ("j", 4, 0, 99)], "key string, n int, low int, high int")
    p = spark.createDataFrame([("k", 0), ("k", 9), ("k", 10), ("k", 11), ("k", 5)], "key string, at int")
    got = sorted((r.at, r.n) for r in resolve.interval_lookup(p, i, ["key"], "at", width=width).collect())
    assert got == [(0, 1), (5, 1), (9, 1), (10, 2)]


def test_nested_owner_needs_one_owner_and_its_generics(spark):
    t = spark.createDataFrame([(1, None, ["T"]), (2, 1, ["T", "U"]), (3, 1, ["U"]), (4, 9, []), (5, None, []), (6, 5, ["X"]), (7, None, ["Y"]), (7, None, ["Y"]), (8, 7, ["Y"])], "token int, declaring_token int, generics array<string>")
    assert sorted(r.token for r in resolve.nested_owner(t).collect()) == [2, 6]


def test_exact_include(spark):
    inc = spark.createDataFrame([("p", "A.cs"), ("p", "b.cs"), ("p", "c.txt")], "owner string, path string")
    f = spark.createDataFrame([("a.cs",), ("b.cs",), ("B.cs",), ("c.txt",)], "path string")
    assert [(r.owner, r.file) for r in resolve.exact_include(inc, f, ".cs").collect()] == [("p", "a.cs")]
