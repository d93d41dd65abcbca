"""Technology detection: rules over one file or one package, and the merge of their findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension
from ..functions.text import fold


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    category: str
    confidence: float
    evidence: str
    when: Column


def findings(rules: list[Rule]) -> Column:
    """Array of struct(id, name, category, confidence, evidence) of the rules that hold, in order."""
    made = [F.when(r.when, F.struct(F.lit(r.id).alias("id"), F.lit(r.name).alias("name"), F.lit(r.category).alias("category"), F.lit(float(r.confidence)).alias("confidence"), F.lit(r.evidence).alias("evidence"))) for r in rules]
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def merge(detections: DataFrame, group: list[str], ord: str) -> DataFrame:
    """A2: detections (id, name, category, confidence, evidence, ord) with one row for each id without
    case: name and category of the most confident (the first, on ties), and the evidence, sorted, the
    first spelling of each."""
    texts = detections.groupBy(*group, fold(F.col("id")).alias("k"), fold(F.col("evidence")).alias("e")).agg(
        F.max(F.struct("confidence", (-F.col(ord)).alias("o"), "name", "category")).alias("best"),
        F.min(F.struct(F.col(ord).alias("o"), "id", "evidence")).alias("first"),
    )
    merged = texts.groupBy(*group, "k").agg(F.max("best").alias("best"), F.min("first").alias("first"), F.array_sort(F.collect_list(F.struct(F.col("e"), F.col("first.evidence").alias("t")))).alias("ev"))
    return merged.select(*group, F.col("first.id").alias("id"), "best.name", "best.category", "best.confidence", F.transform("ev", lambda x: x["t"]).alias("evidence"))


def has(names: Column, value: str) -> Column:
    return F.exists(names, lambda n: fold(n) == value.upper())


def has_prefix(names: Column, prefix: str, suffix: str = "") -> Column:
    return F.exists(names, lambda n: fold(n).startswith(prefix.upper()) & fold(n).endswith(suffix.upper()))


def signal(content: Column, text: str) -> Column:
    """whether the bytes hold the text in ASCII or UTF-16LE."""
    find = lambda raw: F.contains(content, F.lit(bytearray(raw)))
    return F.coalesce(find(text.encode("ascii")) | find(text.encode("utf-16-le")), F.lit(False))


def signal_sample(content: Column, most: int = 4 << 20) -> Column:
    """All bytes up to ``most``, else the first and the last half of as many."""
    half = most // 2
    return F.when(F.length(content) <= most, content).otherwise(F.concat(F.substring(content, 1, half), F.substring(content, -half, half)))


def file_rules(path: Column, image: Column, bundle: Column, content: Column) -> list[Rule]:
    """The rules for one file.  image: struct(is_managed, is_executable, imports, references, sections) or
    null; bundle: whether a single-file marker was found; content: the sampled bytes."""
    none = F.array().cast("array<string>")
    imports, references, sections = (F.coalesce(image[c], none) for c in ("imports", "references", "sections"))
    managed = F.coalesce(image["is_managed"], F.lit(False))
    bundled = image.isNotNull() & ~managed & F.coalesce(bundle, F.lit(False))
    native = image.isNotNull() & ~managed & ~bundled
    runs = native & F.coalesce(image["is_executable"], F.lit(False))
    says = lambda *texts: F.array_contains(F.array(*(signal(content, t) for t in texts)), True)
    easy = has(imports, "krnln.fnr") | says("krnln.fnr")
    return [
        Rule("dotnet-single-file", ".NET single-file", "runtime", 1.00, "bundle marker with a valid header offset", bundled),
        Rule("dotnet", ".NET", "runtime", 1.00, "CLR metadata", managed),
        Rule("wpf", "WPF", "framework", 0.99, "references PresentationFramework", managed & has(references, "PresentationFramework")),
        Rule("winforms", "Windows Forms", "framework", 0.99, "references System.Windows.Forms", managed & has(references, "System.Windows.Forms")),
        Rule("avalonia", "Avalonia", "framework", 0.98, "references an Avalonia assembly", managed & has_prefix(references, "Avalonia")),
        Rule("unity-mono", "Unity Mono", "framework", 0.97, "references a UnityEngine assembly", managed & has_prefix(references, "UnityEngine")),
        Rule("vb6", "Visual Basic 6", "language", 0.99, "imports MSVBVM60.DLL", has(imports, "msvbvm60.dll")),
        Rule("python", "Python runtime", "runtime", 0.97, "imports a Python runtime DLL", has_prefix(imports, "python", ".dll")),
        Rule("pyinstaller", "PyInstaller", "packager", 0.94, "bootloader signature", native & says("PyInstaller", "pyi-windows-manifest-filename")),
        Rule("go", "Go", "language", 0.96, "Go build metadata", native & (says("Go build ID:") | has(sections, ".gopclntab"))),
        Rule("rust", "Rust", "language", 0.82, "Rust runtime symbol", native & says("rust_begin_unwind", "rust_eh_personality")),
        Rule("qt", "Qt", "framework", 0.98, "imports a Qt runtime module", native & (has_prefix(imports, "Qt5") | has_prefix(imports, "Qt6"))),
        Rule("tauri", "Tauri", "framework", 0.85, "WebView2 loader and Tauri signature", native & has(imports, "WebView2Loader.dll") & says("__TAURI__")),
        Rule("delphi", "Delphi/C++Builder", "toolchain", 0.86, "VCL or RTL package, toolchain signature or form file", (native & (has_prefix(imports, "vcl", ".bpl") | has_prefix(imports, "rtl", ".bpl") | says("Embarcadero Delphi"))) | (F.lower(extension(path)) == ".dfm")),
        Rule("msvc", "Microsoft Visual C++", "toolchain", 0.90, "imports the MSVC runtime", native & (has_prefix(imports, "vcruntime") | has_prefix(imports, "msvcp"))),
        Rule("easy-language", "Easy Language", "language", 0.99, "krnln.fnr runtime", native & easy),
        Rule("easy-language", "Easy Language", "language", 0.74, "window data signature", native & ~easy & says("lpEWindow")),
        Rule("inno-setup", "Inno Setup", "installer", 0.97, "Inno Setup data signature", runs & says("Inno Setup Setup Data", "Inno Setup")),
        Rule("nsis", "NSIS", "installer", 0.97, "NSIS data signature", runs & says("Nullsoft.NSIS", "Nullsoft Install System")),
    ]


def package_detections(files: DataFrame, group: list[str]) -> DataFrame:
    """Findings on whole packages: files has file_name, relative_path, format and technologies (array of
    ids).  The facts of a package are booleans merged before the shuffle."""
    name, path, ext = fold(F.col("file_name")), fold(F.col("relative_path")), F.lower(extension(F.col("file_name")))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    facts = files.groupBy(*group).agg(
        any_((F.col("format") == "ASAR archive") | path.endswith("RESOURCES/APP.ASAR") | (name == "ELECTRON.EXE")).alias("electron"),
        any_(name == "UNITYPLAYER.DLL").alias("player"),
        any_(F.contains(path, F.lit("_DATA/"))).alias("data"),
        any_((name.startswith("PYTHON") & name.endswith(".DLL")) | (name == "BASE_LIBRARY.ZIP")).alias("python"),
        any_((name == "JVM.DLL") | (F.col("format") == "Java archive")).alias("jvm"),
        any_((name == "KRNLN.FNR") | ext.isin(".fne", ".fnr", ".fnl")).alias("easy"),
        any_(ext.isin(".e", ".ec")).alias("weak"),
        any_(name == "WEBVIEW2LOADER.DLL").alias("loader"),
        any_(F.array_contains("technologies", "tauri")).alias("tauri"),
    )
    c = F.col
    rules = [
        Rule("electron", "Electron", "framework", 0.99, "the package holds app.asar or electron.exe", c("electron")),
        Rule("unity", "Unity", "framework", 0.99, "Unity player and data directory", c("player") & c("data")),
        Rule("python", "Python runtime", "runtime", 0.96, "the package holds a Python runtime", c("python")),
        Rule("jvm", "Java/JVM", "runtime", 0.92, "the package holds a JVM or a JAR", c("jvm")),
        Rule("easy-language", "Easy Language", "language", 0.99, "support library or runtime file", c("easy")),
        Rule("easy-language", "Easy Language", "language", 0.55, "only the ambiguous source extension", ~c("easy") & c("weak")),
        Rule("tauri", "Tauri", "framework", 0.92, "WebView2 loader beside a Tauri executable", c("loader") & c("tauri")),
    ]
    return facts.select(*group, F.posexplode(findings(rules)).alias("ord", "d")).select(*group, "ord", "d.*")
