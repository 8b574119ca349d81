import pytest

from grovespark.operators import declarations as D
from grovespark.operators import extraction

#: language: (text, symbols as kind and qualified name, calls as caller and name, imports, supertypes)
SAMPLES = {
    "typescript": (
        "import { help } from './b';\n\n/** A box. */\nexport class Box<T> extends Base implements Shape {\n  private readonly x = 1;\n  async put(item: T): Promise<void> {\n    if (item) { help(item); this.store.add('call(x)'); }\n  }\n}\n// skip()\nexport const make = (n: number) => new Box(n);\nenum Kind { A }\ninterface Shape { }\nfunction run() { return make(2); }\n",
        {("class", "Box"), ("method", "Box.put"), ("function", "make"), ("enum", "Kind"), ("interface", "Shape"), ("function", "run")},
        {("put", "help"), ("put", "this.store.add"), ("make", "Box"), ("run", "make")}, {"help"}, {("Box", "Base"), ("Box", "Shape")},
    ),
    "go": ("package m\n\nimport \"fmt\"\n\ntype Box struct {\n\tn int\n}\n\nfunc (b *Box) Put(x int) error {\n\treturn fmt.Errorf(\"f(x)\")\n}\n\nfunc Run() {\n\tb.Put(1)\n}\n", {("struct", "Box"), ("method", "Put"), ("function", "Run")}, {("Put", "fmt.Errorf"), ("Run", "b.Put")}, {"fmt"}, set()),
    "rust": ("use std::io::Read;\n\npub struct Box { n: u8 }\n\nimpl Shape for Box {\n    fn area(&self) -> u8 { helper(self.n) }\n}\n\nfn helper(n: u8) -> u8 { n }\n", {("struct", "Box"), ("class", "Box"), ("method", "Box.area"), ("function", "helper")}, {("area", "helper")}, {"std::io::Read"}, {("Box", "Shape")}),
    "java": ("import a.b.C;\n\npublic class Box extends Base implements Shape {\n  private final int n = 1;\n\n  public void put(String s) throws E {\n    helper(s);\n  }\n\n  static int helper(String s) { return s.length(); }\n}\n", {("class", "Box"), ("field", "Box.n"), ("method", "Box.put"), ("method", "Box.helper")}, {("put", "helper"), ("helper", "s.length")}, {"a.b.C"}, {("Box", "Base"), ("Box", "Shape")}),
    "csharp": ("using A.B;\n\npublic class Box : Base\n{\n  public string Name { get; set; }\n  public async Task Put(int n)\n  {\n    Helper(n);\n  }\n  int Helper(int n) => n;\n}\n", {("class", "Box"), ("property", "Box.Name"), ("method", "Box.Put"), ("method", "Box.Helper")}, {("Put", "Helper")}, {"A.B"}, {("Box", "Base")}),
    "kotlin": ("import a.b.C\n\ndata class Box(val n: Int) : Base(n), Shape {\n  fun put(x: Int) { helper(x) }\n}\n\nfun helper(x: Int) = x\n", {("class", "Box"), ("method", "Box.put"), ("function", "helper")}, {("put", "helper")}, {"a.b.C"}, {("Box", "Base"), ("Box", "Shape")}),
    "swift": ("import UIKit\n\nfinal class Box: Base {\n  var n = 1\n  func put(_ x: Int) { helper(x) }\n}\n\nfunc helper(_ x: Int) { }\n", {("class", "Box"), ("property", "Box.n"), ("method", "Box.put"), ("function", "helper")}, {("put", "helper")}, {"UIKit"}, {("Box", "Base")}),
    "dart": ("import 'a.dart';\n\nclass Box extends Base {\n  void put(int x) { helper(x); }\n}\n\nint helper(int x) => x;\n", {("class", "Box"), ("method", "Box.put"), ("function", "helper")}, {("put", "helper")}, {"a.dart"}, {("Box", "Base")}),
    "php": ("<?php\nuse App\\C;\n\nclass Box extends Base {\n  public function put($x) { helper($x); }\n}\n\nfunction helper($x) { return $x; }\n", {("class", "Box"), ("method", "Box.put"), ("function", "helper")}, {("put", "helper")}, {"App\\C"}, {("Box", "Base")}),
    "c": ("#include \"a.h\"\n\nstruct box {\n  int n;\n};\n\nstatic int helper(int x) {\n  return x;\n}\n\nint main(void) {\n  return helper(1);\n}\n", {("struct", "box"), ("function", "helper"), ("function", "main")}, {("main", "helper")}, {"a.h"}, set()),
    "cpp": ("#include <a>\n\nnamespace m {\nclass Box : public Base {\n public:\n  int put(int x) { return helper(x); }\n};\n}\n", {("namespace", "m"), ("class", "m.Box"), ("method", "m.Box.put")}, {("put", "helper")}, {"a"}, {("Box", "Base")}),
    "scala": ("import a.b.C\n\nclass Box extends Base {\n  def put(x: Int): Int = { helper(x) }\n}\n", {("class", "Box"), ("method", "Box.put")}, {("put", "helper")}, {"a.b.C"}, {("Box", "Base")}),
    "ruby": ("require 'set'\n\nmodule M\n  class Box < Base\n    def put(x)\n      helper(x) if x\n    end\n\n    def helper(x)\n      x.each do |y|\n        puts(y)\n      end\n    end\n  end\nend\n", {("module", "M"), ("class", "M.Box"), ("method", "M.Box.put"), ("method", "M.Box.helper")}, {("put", "helper"), ("helper", "puts")}, {"set"}, {("Box", "Base")}),
    "lua": ("local a = require('a')\n\nlocal function helper(x)\n  if x then\n    return x\n  end\nend\n\nfunction M.put(x)\n  helper(x)\nend\n", {("function", "helper"), ("function", "put")}, {("put", "helper")}, {"a"}, set()),
}


@pytest.mark.parametrize("language", sorted(SAMPLES))
def test_declarations(language):
    text, symbols, calls, imports, supers = SAMPLES[language]
    rows = D.rows_of("d/f.x", text, language)
    name = {r["id"]: r["name"] for r in rows if r["row"] == "node"}
    assert {(r["kind"], r["qualified_name"].split("::", 1)[-1]) for r in rows if r["row"] == "node" and r["kind"] != "file"} == symbols
    refs = lambda kind: {(name[r["source"]], r["name"]) for r in rows if r["row"] == "ref" and r["edge_kind"] == kind}
    assert refs("calls") == calls and {n for _, n in refs("imports")} == imports and refs("extends") == supers
    assert not [r for r in rows if r["row"] == "error"] and all(r["start_line"] <= r["end_line"] for r in rows if r["row"] == "node")


def test_extraction_of_many_languages(spark):
    rows = [(f"f.{k}", k, v[0]) for k, v in SAMPLES.items()] + [("empty.ts", "typescript", None), ("cut.ts", "typescript", "function f() {\n"), ("x.txt", "text", "y")]
    df = spark.createDataFrame(rows, "path string, language string, content string")
    out = extraction.extract(df)
    assert out.where("kind = 'file'").count() == len(rows) - 1
    assert [r.path for r in out.where("row = 'error'").collect()] == ["cut.ts"]
    doc = out.where("name = 'Box' and path = 'f.typescript'").first()
    assert doc.docstring == "/** A box. */" and extraction.extract(df.where("false")).count() == 0


def test_embedded_and_passed_functions():
    vue = '<template>\n  <UserCard :x="1"/>\n</template>\n<script setup lang="ts">\nimport { load } from "./a";\nfunction go() { load(1); }\n</script>\n'
    rows = D.embedded_rows("v/Page.vue", vue, "vue")
    name = {r["id"]: r["name"] for r in rows if r["row"] == "node"}
    assert {(r["kind"], r["name"], r["start_line"]) for r in rows if r["row"] == "node"} == {("file", "Page.vue", 1), ("component", "Page", 1), ("function", "go", 6)}
    assert {(name[r["source"]], r["edge_kind"], r["name"], r["line"]) for r in rows if r["row"] == "ref"} == {("Page", "imports", "load", 5), ("go", "calls", "load", 6), ("Page", "references", "UserCard", 2)}
    astro = D.embedded_rows("a.astro", "---\nconst f = (x: number) => g(x);\n---\n<Box/>\n", "astro")
    assert {r["name"] for r in astro if r["row"] == "ref"} == {"g", "Box"}
    xml = '<mapper namespace="a.b.UserMapper">\n<sql id="cols">x</sql>\n<select id="find">\n<include refid="cols"/>\n</select></mapper>'
    got = D.mapper_rows("m/U.xml", xml)
    assert {r["qualified_name"] for r in got if r["row"] == "node"} == {"m/U.xml", "UserMapper::cols", "UserMapper::find"} and {r["name"] for r in got if r["row"] == "ref"} == {"UserMapper::cols"}
    assert len(D.mapper_rows("x.xml", "<beans/>")) == 1
    refs = D.function_values("f.js", "function run() {\n  bus.on('x', handler);\n  a.map(this.go, true);\n  o.cb = finish;\n}\n", "javascript")
    assert {r["name"] for r in refs} == {"handler", "this.go", "finish"}
