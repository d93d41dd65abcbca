import json
import os

import pytest
from pyspark.sql import functions as F

from sparkstrata.__main__ import main
from sparkstrata.plans import analysis, report, skeletons
from sparkstrata.sources import images, native
from sparkstrata.streaming import arrivals

from .builders import asar_of, image_bytes, zip_bytes
from .test_sources import APP, LIB, RICH, TINY, managed


def package(folder):
    contents = {
        "app/App.exe": image_bytes(["my.dll", "KERNEL32.dll"], tail=b"PyInstaller"),
        "app/my.dll": image_bytes(["qt6core.dll"], library=True),
        "app/My.Lib.dll": managed(library=True),
        "app/resources/app.asar": asar_of({"main.js": b"x", "deep/my.dll": image_bytes(library=True)}),
        "src/App/App.csproj": APP.encode(),
        "src/Lib/Lib.csproj": LIB.encode(),
        "readme": b"",
    }
    for p, c in contents.items():
        (folder / p).parent.mkdir(parents=True, exist_ok=True)
        (folder / p).write_bytes(c)
    return contents


def test_analysis_of_a_directory(spark, tmp_path):
    package(tmp_path)
    a = analysis.analyze(spark, str(tmp_path))
    s = analysis.summary(a).first()
    assert (s.file_count, s.executables, s.libraries, s.managed_assemblies, s.archives, s.types, s.methods) == (9, 1, 3, 1, 1, 3, 3)
    deps = {(r.source, r.target): r.resolved_inside_package for r in a.dependencies.collect()}
    assert deps["app/App.exe", "app/my.dll"] is True and deps["app/App.exe", "KERNEL32.dll"] is False
    found = {r.id for r in a.package_technologies.collect()}
    assert {"electron", "pyinstaller", "qt", "dotnet", "wpf"} <= found
    kinds = {r.id: r.kind for r in a.components.collect()}
    assert kinds["src/App/App.csproj"] == "source-project" and kinds["app/My.Lib.dll"] == "managed-assembly" and kinds["app/App.exe"] == "native-binary"
    assert a.references.where("kind = 'pe-import' and status = 'resolved'").count() == 1
    text = report.markdown(a, "Package")
    assert text.startswith("# Package") and "## Dependencies" in text and "app/App.exe" in text
    titles = [line[3:] for line in text.splitlines() if line.startswith("## ")]
    assert titles[-6:] == ["Archives", "Types with most methods", "Calls", "Manifest resources", "Warnings", "Limits"] and "| app/resources/app.asar | 1 | 2 | 0 | 0 | complete |" in text
    doc = json.loads(report.document(a, "Package").first().value)
    assert len(doc["files"]) == 9 and doc["summary"]["executables"] == 1 and doc["schemaVersion"] == analysis.SCHEMA_VERSION


def test_report_of_other_tools(spark):
    projects = spark.createDataFrame([("b", 2, 3, 4, 0, True, [], []), ("a|x", 1, 0, 0, 2, False, ["no sdk"], ["E1", "E2"])], "project string, files int, declarations int, calls int, errors int, complete boolean, notes array<string>, error_codes array<string>")
    declared = spark.createDataFrame([("b", "B.cs", i, "method", f"M{i}") for i in range(201)], "project string, file string, line int, kind string, name string")
    calls = spark.createDataFrame([("B.cs", 1, "M", "N", "resolved-source", "a"), ("B.cs", 2, "M", "O", "external", None)], "file string, line int, caller string, target string, status string, target_project string")
    index, found, called = report.source_sections(report.SourceIndex(projects, declared, calls))
    assert r"| a\|x | 1 | 0 | 0 | 2 | incomplete; no sdk; errors E1, E2 |" in index and "| b | 2 | 3 | 4 | 0 | complete |" in index
    assert "Only the first 200 rows" in found and "| B.cs:1 | M | N | resolved in a |" in called and "| B.cs:2 | M | O | external |" in called
    none = report.source_sections(report.SourceIndex(projects.limit(0), declared.limit(0), calls.limit(0), True))
    assert "None." in none[0] and "cut" in none[1]
    rows = spark.createDataFrame([(f, i, "`t`") for f in ("b", "A") for i in range(3)], "id string, ord int, text string")
    text = report.file_sections("Rows", rows, [("N", F.col("ord")), ("T", F.col("text"))], [F.col("ord")], 2)
    assert text.index("### `A`") < text.index("### `b`") and text.count("Only the first 2 rows") == 2 and r"| 1 | \`t\` |" in text and "| 2 |" not in text


def test_native_sections(spark):
    good = json.dumps({"schemaVersion": 1, "functionCount": 1, "functions": [{"name": "main", "address": "10", "signature": "int main()", "external": False}]})
    documents = spark.createDataFrame([("a.exe", good), ("b.exe", "{")], "id string, text string").select("id", native.native_document(F.col("text")).alias("native"))
    functions, calls, refused = report.native_sections(documents)
    assert "### `a.exe`" in functions and "| 10 | main | int main() | false |" in functions and "None." in calls and "| b.exe |" in refused


def test_a_project_file_stands_for_its_sources(spark, tmp_path):
    for p in ("app/App.csproj", "app/Main.cs", "app/bin/old.dll"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"<Project/>")
    a = analysis.analyze(spark, str(tmp_path / "app" / "App.csproj"), analysis.Options(inventory_only=True))
    assert {r.id for r in a.files.collect()} == {"App.csproj", "Main.cs"}


def test_analysis_of_a_zip(spark, tmp_path):
    contents = package(tmp_path / "in")
    (tmp_path / "p.zip").write_bytes(zip_bytes(contents))
    a = analysis.analyze(spark, str(tmp_path / "p.zip"), analysis.Options(inventory_only=True))
    assert a.files.count() == 9 and a.calls.count() == 0
    (tmp_path / "misnamed.bin").write_bytes(zip_bytes(contents))
    assert analysis.analyze(spark, str(tmp_path / "misnamed.bin"), analysis.Options(inventory_only=True)).files.count() == a.files.count()
    (tmp_path / "bad.zip").write_bytes(zip_bytes({"../x": b""}))
    with pytest.raises(ValueError, match="refused"):
        analysis.analyze(spark, str(tmp_path / "bad.zip"))
    with pytest.raises(Exception, match="exceeds"):
        analysis.analyze(spark, str(tmp_path / "p.zip"), analysis.Options(max_files=2))
    with pytest.raises(ValueError, match="max_files"):
        analysis.analyze(spark, str(tmp_path / "p.zip"), analysis.Options(max_files=0))


def test_writer(tmp_path):
    report.write_text(str(tmp_path / "a/r.md"), "x")
    assert (tmp_path / "a/r.md").read_text() == "x\n"
    with pytest.raises(FileExistsError):
        report.write_text(str(tmp_path / "a/r.md"), "y")
    report.write_text(str(tmp_path / "a/r.md"), "y", force=True)
    os.symlink(tmp_path / "a/r.md", tmp_path / "link")
    with pytest.raises(ValueError, match="link"):
        report.write_text(str(tmp_path / "link"), "z", force=True)
    for bad in ([("../x", "")], [("a", ""), ("A", "")], [("a", ""), ("a/b", "")]):
        with pytest.raises(ValueError):
            report.write_project(bad, str(tmp_path / "new"))
    assert not (tmp_path / "new").exists()
    report.write_project([("s/a.cs", "1"), ("s/b.cs", "2")], str(tmp_path / "new"))
    assert sorted(os.listdir(tmp_path / "new/s")) == ["a.cs", "b.cs"]


def typed(name, kind, fields=(), properties=(), methods=(), token=1, owner=None, namespace="N", assembly="My.Lib"):
    return (assembly, token, owner, namespace, name, kind, list(fields), list(properties), list(methods))


ROWS = [
    typed("Color", "enum", [("value__", "byte", None), ("Red", "byte", "1"), ("Rouge", "byte", "1"), ("Odd", "byte", "x")], token=1),
    typed("IRun`1", "interface", methods=[("Go", "void", False, [("to", "string?")], None), ("Go", "int", False, [("n", "int[,]")], None)], token=2),
    typed("Box", "class", [("type", "string", None), ("<x>k__BackingField", "int", None)], [("Size", "long")], [("get_Size", "long", False, [], None), (".ctor", "void", False, [], None), ("Size", "void", False, [], None), ("make", "N.Outer<int>.Inner", True, [("a", "byte*"), ("a", "ref int"), ("", "delegate* unmanaged<int>")], ["IL_0000: nop", "IL_0001: ret"])], token=3),
    typed("Inner", "struct", [("v", "double", None)], token=4, owner=3),
    typed("<Hidden>", "class", token=5),
    typed("Done", "delegate", token=6),
]


def render(spark, language):
    df = spark.createDataFrame(ROWS, skeletons.TYPES)
    return {r.path: r.content for r in skeletons.skeletons(df, language).collect()}


def test_rust(spark):
    text = render(spark, "rust")["My_Lib.rs"]
    assert "#[repr(u8)]\npub enum Color {\n    Red = 1,\n    Odd,\n}\nimpl Color {\n    pub const Rouge: Self = Self::Red;\n}" in text
    assert "pub trait IRun {\n    fn Go(&self, to: String);\n    fn Go2(&self, n: Vec<Vec<i32>>) -> i32;\n}" in text
    assert "pub type_: String," in text and "pub Size: i64," in text and "pub fn make(a: *mut u8, a2: i32, arg2: *const ()) -> Inner { unimplemented!() }" in text
    assert "Hidden" not in text and "Done" not in text and "get_Size" not in text


def test_go(spark):
    text = render(spark, "go")["My_Lib.go"]
    assert "type Color byte\nconst (\n    ColorRed Color = 1\n    ColorRouge Color = 1\n    ColorOdd Color = iota\n)" in text
    assert "func (r *Box) Size2() {" in text and "func Box_make(a *byte, a2 int32, arg2 uintptr) Inner {" in text and "    type_ string" in text


def test_cpp(spark):
    text = render(spark, "cpp")["My_Lib.hpp"]
    assert "enum class Color : uint8_t {" in text and "virtual void Go(std::string to) = 0;" in text and "std::vector<std::vector<int32_t>> n" in text
    assert 'static Inner make(uint8_t* a, int32_t a2, void* arg2) { throw std::logic_error("not implemented"); }' in text


def test_csharp(spark):
    files = render(spark, "csharp")
    text = files["My_Lib/N.cs"]
    assert set(files) == {"My_Lib/N.cs", "My_Lib/My_Lib.csproj"} and text.startswith("namespace N;")
    assert "    public struct Inner" in text and "        // IL_0000: nop" in text and "throw new System.NotImplementedException();" in text
    assert text.index("public class Box") < text.index("public enum Color") < text.index("public interface IRun")


def test_package_local_references(spark):
    names = spark.createDataFrame([("A",), ("B",)], "assembly string")
    refs = spark.createDataFrame([("A", "b"), ("A", "B"), ("A", "a"), ("A", "System")], "assembly string, name string")
    assert [(r.assembly, r.target) for r in skeletons.package_local_references(names, refs).collect()] == [("A", "B")]


def test_type_names():
    m = skeletons.RUST.map
    assert [m(t) for t in ("int?", "ref string", "int*", "byte[]", "void", "Ns.Outer<int>.Inner", "delegate* unmanaged<int>")] == ["i32", "String", "*mut i32", "Vec<u8>", "()", "Inner", "*const ()"]
    names = skeletons.Names()
    assert [names.take("a") for _ in range(3)] == ["a", "a2", "a3"] and names.take("a2") == "a2_2"


def test_stream_of_files(spark, tmp_path):
    for i, name in enumerate(["a.json", "b.json", "c.png"]):
        (tmp_path / name).write_bytes(b"same" if i < 2 else b"other")
    files = arrivals.classified(arrivals.arriving_files(spark, str(tmp_path)))
    q = arrivals.first_of_each_content(files).writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.category for r in spark.table("firsts").collect()) == ["configuration", "resource"]
    q = arrivals.counts_by_window(files).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.category, r.files) for r in spark.table("counts").collect()} == {("configuration", 2), ("resource", 1)}


def test_skeletons_of_an_image(spark, tmp_path):
    (tmp_path / "Shapes.dll").write_bytes(image_bytes(managed=RICH, bodies=[TINY], library=True))
    a = analysis.analyze(spark, str(tmp_path))
    made = {r.path: r.content for r in skeletons.skeletons(images.skeleton_types(a.images, a.files), "rust").collect()}
    text = made["Shapes.rs"]
    assert "#[repr(u8)]\npub enum Color {\n    Red = 7,\n}" in text and "pub trait IRun {\n    fn Go(&self);\n}" in text
    assert "pub items: Vec<String>," in text and "pub fn Make(first: *mut u8, second: i32, arg2: M0) -> StringBuilder { unimplemented!() }" in text


def test_a_single_executable_brings_its_library(spark, tmp_path):
    for name in ("App.exe", "App.dll", "App.runtimeconfig.json", "Other.dll"):
        (tmp_path / name).write_bytes(b"x")
    a = analysis.analyze(spark, str(tmp_path / "App.exe"))
    assert sorted(r.id for r in a.files.collect()) == ["App.dll", "App.exe"]


def test_command_line(spark, tmp_path, capsys):
    package(tmp_path / "in")
    arguments = ["analyze", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--skeleton", "go"]
    assert main(arguments) == 0 and "9 files" in capsys.readouterr().out
    assert (tmp_path / "out/report.md").exists() and json.loads((tmp_path / "out/package.json").read_text())["summary"]["types"] == 3
    assert (tmp_path / "out/go/My_Lib.go").exists() and main(arguments) == 3
    with pytest.raises(SystemExit) as e:
        main(["analyze", "x", "--output", "y", "--inventory", "--skeleton", "go"])
    assert e.value.code == 2
