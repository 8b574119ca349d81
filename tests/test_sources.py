from pyspark.sql import functions as F

from grovespark.operators import overlay as A
from grovespark.operators import extraction as X
from grovespark.sources import tree


def test_scan_and_extract(spark, tmp_path):
    for p, t in {"src/a.py": "import os\nclass A(B):\n    '''Doc.'''\n    @dec\n    def m(self):\n        return os.getcwd()\ndef f():\n    return A().m()\n", "src/bad.py": "def f(:\n", "src/empty.py": "", "build/x.py": "x = 1\n", "src/keep.txt": "no"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    f = tree.scan(spark, str(tmp_path), ["# comment", "", "build/"])
    assert {r.path: r.language for r in f.collect()} == {"src/a.py": "python", "src/bad.py": "python"}
    rows = X.extract(f).collect()
    assert {(r.kind, r.name) for r in rows if r.row == "node" and r.path == "src/a.py"} == {("file", "a.py"), ("class", "A"), ("method", "m"), ("function", "f")}
    assert {(r.edge_kind, r.name) for r in rows if r.row == "ref"} == {("imports", "os"), ("extends", "B"), ("decorates", "dec"), ("calls", "os.getcwd"), ("calls", "A().m"), ("calls", "A")}
    assert [r.path for r in rows if r.row == "error"] == ["src/bad.py"]


def test_ignore_rules(spark):
    df = spark.createDataFrame([(p,) for p in ("a/dist/x.js", "dist/y.js", "a/b.log", "keep.log", "x/keep.log")], "path string")
    got = {r.path for r in df.where(tree.ignored(F.col("path"), ["dist/", "*.log", "!keep.log", "/x/keep.log"])).collect()}
    assert got == {"a/dist/x.js", "dist/y.js", "a/b.log", "x/keep.log"}


def test_manifests(spark):
    df = spark.createDataFrame([("m/build.gradle.kts", 'dependencies {\n  implementation(project(":core:ui"))\n  testImplementation project(path: ":x")\n}\n'), ("m/AndroidManifest.xml", '<manifest><uses-permission android:name="a.CAMERA"/><activity android:exported="true" android:name=".Main"/></manifest>'), ("m/none.txt", None)], "path string, content string")
    assert {(r.configuration, r.module) for r in tree.gradle_dependencies(df).collect()} == {("implementation", "core/ui"), ("testImplementation", "x")}
    assert {(r.tag, r.name) for r in tree.manifest_entries(df).collect()} == {("uses-permission", "a.CAMERA"), ("activity", ".Main")}
    one = spark.range(1).select(tree.tolerant_json(F.lit("{a: 'x', /* c */ b: [1, 2,],}"), "a string, b array<int>").alias("j")).first().j
    assert (one.a, one.b) == ("x", [1, 2])


def test_overlay(spark):
    imports = spark.createDataFrame([("1", "android.hardware.camera2.Device"), ("2", "android.hardwarex.Y"), ("3", "android.net.Uri")], "id string, fqn string")
    rules = spark.createDataFrame([("android.hardware", "hardware"), ("android.hardware.camera2", "camera"), ("android.net", "network")], "prefix string, capability string")
    assert {(r.id, r.capability) for r in A.capabilities(imports, rules).collect()} == {("1", "camera"), ("3", "network")}
    a, b = spark.createDataFrame([("x", 1)], "id string, v int"), spark.createDataFrame([("x", 2), ("y", None)], "id string, v int")
    assert {(r.id, r.v) for r in A.merge_parts([a, b]).collect()} == {("x", 2), ("y", None)}
    assert {(r.id, r.v) for r in A.merge_parts([a, b], last_wins=False).collect()} == {("x", 1), ("y", None)}
    d, li = spark.createDataFrame([("a", "b")], "a string, b string"), spark.createDataFrame([("a", "b", 4), ("b", "a", 1)], "a string, b string, weight int")
    assert {(r.a, r.weight, r.origin, r.reversed) for r in A.declared_and_lifted(d, li).collect()} == {("a", 4, "declared", False), ("b", 1, "lifted", True)}
    code = spark.createDataFrame([("s", 'nav.navigate("home")'), ("t", 'composable("home") {}'), ("u", "getattr(x, y)()")], "id string, code string")
    assert [(r.source, r.target) for r in X.literal_channels(code, r'composable\("(\w+)"', r'navigate\("(\w+)"').collect()] == [("s", "t")]
    assert {(r.id, r.form) for r in X.dynamic_sites(code).collect()} == {("u", "reflection")}


def test_nested_ignore_files(spark, tmp_path):
    for p, t in {".gitignore": "*.log\n/build/\n", "a/.gitignore": "!keep.log\ntmp\n# note\n", "a/keep.log": "x", "a/b/other.log": "x", "a/tmp/y.ts": "x", "build/z.ts": "x", "a/build/z.ts": "x", "keep.log": "x"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    rules = tree.nested_rules(tree.ignore_files(spark, str(tmp_path)))
    paths = spark.createDataFrame([(p, 1) for p in ("a/keep.log", "a/b/other.log", "a/tmp/y.ts", "build/z.ts", "a/build/z.ts", "keep.log", "src/m.ts")], "path string, folder int")
    assert {r.path for r in tree.not_ignored(paths, rules).collect()} == {"a/keep.log", "a/build/z.ts", "src/m.ts"}
    assert tree.not_ignored(paths, rules.where("false")).count() == 7


def test_languages_by_content(spark):
    rows = [("a.h", "int f(void);\n", "c"), ("b.h", "namespace x { class A { }; }", "cpp"), ("c.h", "@interface A : B\n@end", "objc"), ("run", "#!/usr/bin/env python3\n", "python"), ("tool", "#!/usr/bin/node\n", "javascript"), ("x", "text", None), ("d.h", None, "c"), ("e.ts", "#!/bin/sh", "typescript")]
    df = spark.createDataFrame(rows, "path string, content string, want string")
    assert [(r.path, r.got) for r in df.select("path", tree.language_by_content(F.col("path"), F.col("content")).alias("got")).collect()] == [(p, w) for p, _, w in rows]
