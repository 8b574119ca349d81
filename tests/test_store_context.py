import pytest
from pyspark.sql import functions as F

from grovespark.functions import querytext as X
from grovespark.operators import context as K
from grovespark.operators import store as S

A1 = "from b import helper\n\ndef main():\n    return helper()\n"
B1 = 'def helper():\n    """Helps."""\n    return other()\n\ndef other():\n    pass\n'
B2 = "def helper(x):\n    return x\n\ndef extra():\n    return helper(1)\n"


def test_sync_takes_only_changes_and_links_again(spark, tmp_path):
    store = S.GraphStore(spark, str(tmp_path / "graph"))
    tree = lambda **f: spark.createDataFrame([(f"{k}.py", "python", t) for k, t in f.items()] + [("notes.txt", "text", "x")], "path string, language string, content string").selectExpr("*", "1 as name")
    extracted = []

    def extract(files):
        from grovespark.operators.extraction import extract as parse

        extracted.append(sorted(r.path for r in files.select("path").collect()))
        return parse(files)

    got = lambda df: {r.path: r.state for r in df.collect()}
    assert got(store.sync(tree(a=A1, b=B1, c="def broken(:\n"), extract)) == dict.fromkeys(["a.py", "b.py", "c.py", "notes.txt"], "added")
    name = lambda: {r.id: f"{r.file_path}:{r.name}" for r in store.table("nodes").collect()}
    links = lambda kind: {(n[r.source], n[r.target]) for n in [name()] for r in store.table("edges").collect() if r.kind == kind}
    assert links("calls") == {("a.py:main", "b.py:helper"), ("b.py:helper", "b.py:other")}
    assert {r.path: (r.node_count, r.errors) for r in store.table("files").collect()} == {"a.py": (2, 0), "b.py": (3, 0), "c.py": (1, 1), "notes.txt": (0, 0)}
    assert store.metadata()["state"] == "partial" and store.version() == 1 and not store.is_stale(1) and store.is_stale(2)
    assert got(store.sync(tree(a=A1, b=B1, c="def broken(:\n"), extract)) == {} and store.version() == 1
    assert got(store.sync(tree(a=A1, b=B2), extract)) == {"b.py": "modified", "c.py": "removed"}
    assert extracted == [["a.py", "b.py", "c.py", "notes.txt"], ["b.py"]]
    # `main` is in an unchanged file; its call is moved to the new `helper`. `other` is gone with its edges.
    assert links("calls") == {("a.py:main", "b.py:helper"), ("b.py:extra", "b.py:helper")}
    assert "other" not in {r.name for r in store.table("vocabulary").collect()} and {r.path for r in store.table("files").collect()} == {"a.py", "b.py", "notes.txt"}


def test_merges_of_the_store(spark, tmp_path):
    store = S.GraphStore(spark, str(tmp_path / "graph"))
    node = lambda *rows: spark.createDataFrame([(i, "function", nm, nm, f, "python", 1, 2, None, None, None, True) for i, nm, f in rows], S.SCHEMAS["nodes"])
    store.upsert_nodes(node(("1", "one", "a"), ("2", "two", "b"), ("3", None, "b"), ("2", "two", "b")))
    store.upsert_nodes(node(("1", "oneAgain", "a")))
    assert {r.id: r.name for r in store.table("nodes").collect()} == {"1": "oneAgain", "2": "two"}
    edge = lambda *rows: spark.createDataFrame([(*r, None, None, None, p) for *r, p in rows], S.SCHEMAS["edges"])
    store.insert_edges(edge(("1", "2", "calls", "first"), ("1", "9", "calls", "lost")))
    store.insert_edges(edge(("1", "2", "calls", "second"), ("2", "1", "calls", "new")))
    assert {(r.source, r.target, r.provenance) for r in store.table("edges").collect()} == {("1", "2", "first"), ("2", "1", "new")}
    store.append_refs(spark.createDataFrame([("1", "x", "calls", 1, 0, "a", "python"), ("2", "y", "calls", 1, 0, "b", "python")], S.SCHEMAS["refs"]))
    store.set_metadata("k", "v")
    assert store.metadata() == {"k": "v"} and not store.heal_vocabulary()
    store.write({"vocabulary": spark.createDataFrame([], S.SCHEMAS["vocabulary"])})
    assert store.heal_vocabulary() and {r.segment for r in store.table("vocabulary").collect()} == {"one", "again", "two"}
    store.delete_files(spark.createDataFrame([("b",)], "path string"))
    assert store.table("edges").count() == 0 and [r.from_node_id for r in store.table("refs").collect()] == ["1"]
    store.clear()
    assert store.table("nodes").count() == 0 and store.metadata() == {}
    h = spark.createDataFrame([("a", None), ("a", None), ("a", "b")], "x string, y string").select(S.content_hash(["y", "x"]).alias("h")).collect()
    assert h[0] == h[1] != h[2] and S.stable_json({"b": 1, "a": [2]}) == S.stable_json({"a": [2], "b": 1})
    S.write_documents(spark.createDataFrame([("u", 1), ("v", 2)], "unit string, n int"), "unit", str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).where("unit = 'v'").first().n == 2


def test_small_rules(spark):
    from grovespark.functions import kinds, paths

    p = spark.createDataFrame([("a/build.gradle.kts",), ("buildSrc/x.kt",), ("tools/ci.py",), ("m/src/x.py",), ("a/gradle.txt",)], "p string")
    assert [r.b for r in p.select(paths.is_build_file(F.col("p")).alias("b")).collect()] == [True, True, True, False, False]
    g = [("a.pb.go", True), ("x_mock.go", True), ("mock_a.go", True), ("d/mock_a.go", False), ("a_pb2.pyi", True), ("A_grpc_pb.js", True), ("FooGrpc.cs", True), ("a.min.mjs", True), ("a.pb.js", True), ("x.generated.rs", True), ("generated.ts", False), ("a.go", False)]
    d = spark.createDataFrame(g, "p string, want boolean")
    assert [r.b for r in d.select(paths.is_generated(F.col("p")).alias("b")).collect()] == [w for _, w in g]
    e = spark.createDataFrame([("calls", True), ("references", True), ("imports", None), ("extends", False)], "k string, p boolean")
    assert [r.e for r in e.select(kinds.edge_label(F.col("k"), F.col("p")).alias("e")).collect()] == [None, "callback registration", "import", "extends"]
    assert S.borrowed_index("/b", "/a") and not S.borrowed_index("/a", "/a") and not S.borrowed_index("/b", "/a", True, "r1", "r2") and not S.borrowed_index(None, "/a")


def test_words_of_a_query():
    assert X.symbols("How does UserStore.load call parse_query in HTTP mode?") == ["UserStore", "parse_query", "HTTP", "UserStore.load", "load", "mode"]
    assert X.symbols("") == [] and X.prose_words("Où est la Méthode checkout du panier 12345 when") == ["methode", "checkout", "panier"]
    assert X.prose_words("", frozenset()) == [] and len(X.prose_words(" ".join(f"word{i}x" for i in range(40)))) == X.MOST_WORDS
    assert X.project_tokens("/srv/my-repo", "github.com/x/kite-engine", "@s/abc") == {"myrepo", "kiteengine"}
    assert X.spelling("start_link/2 and lists:map kind:function") == "start_link and lists.map kind:function"
    assert X.output_budget(10)["max_files"] == 4 and X.output_budget(499)["gap"] == 8 and X.output_budget(10**6)["relationships"]
    assert X.term_groups(["user", "users", "load"]) == [["users", "user"], ["load"]]


def test_symbol_columns(spark):
    df = spark.createDataFrame([("run", "run", "function", "src/stage_apply.rs"), ("request", "Session::request", "method", "a.py"), ("card.liquid", "x", "file", "s/card.liquid")], "name string, qualified string, kind string, path string")
    hit = lambda s: [r.name for r in df.where(X.matches_symbol(F.col("name"), F.col("qualified"), F.col("kind"), F.col("path"), s)).collect()]
    assert hit("run") == ["run"] and hit("crate::stage_apply::run") == ["run"] and hit("Session.request") == ["request"] and hit("Other.request") == [] and hit("card") == ["card.liquid"]
    sel = spark.createDataFrame([("play", []), ("play", ["_"]), ("play", ["song", "by"]), ("", ["x"])], "b string, l array<string>")
    assert [r.s for r in sel.select(X.selector(F.col("b"), F.col("l")).alias("s")).collect()] == ["play", "play:", "playWithSong:by:", None]
    back = spark.createDataFrame([("playWithSong:by:",), ("initWithName:",), ("setTitle:",), ("objectForKey:",), ("",)], "s string")
    assert [set(r.s) for r in back.select(X.base_names(F.col("s")).alias("s")).collect()] == [{"playWithSong", "play"}, {"initWithName", "init"}, {"setTitle", "title"}, {"objectForKey", "object"}, set()]
    w = spark.createDataFrame([("cross-module", 7, 0.1), ("cross-module", 6, 0.1), ("local", 9, 0.0)], "r string, s int, c double")
    assert [r.w for r in w.select(X.is_weak_group(F.col("r"), F.col("s"), F.col("c")).alias("w")).collect()] == [True, False, False]


@pytest.fixture(scope="module")
def shop(spark):
    rows = [
        ("Cart", "class", "ShoppingCart", "src/cart/cart.ts"), ("add", "method", "addItem", "src/cart/cart.ts"), ("Base", "class", "BaseCart", "src/cart/base.ts"), ("pay", "function", "checkoutPayment", "src/pay/checkout.ts"),
        ("log", "function", "log", "src/log.ts"), ("imp", "import", "ShoppingCart", "src/pay/checkout.ts"), ("t1", "function", "checkoutPaymentTest", "tests/checkout.test.ts"), ("far", "function", "unrelated", "src/other.ts"), ("cfg", "constant", "secret", "conf.yaml"),
    ]
    n = spark.createDataFrame([(i, k, nm, f"{p}::{nm}", p, "yaml" if i == "cfg" else "typescript", 1 + j, 2 + j, None, None) for j, (i, k, nm, p) in enumerate(rows)], "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, docstring string, signature string")
    e = spark.createDataFrame([("Cart", "add", "contains", 1, 0), ("Cart", "Base", "extends", 1, 0), ("pay", "add", "calls", 2, 0), ("t1", "pay", "calls", 3, 0), ("imp", "Cart", "imports", 1, 0), ("pay", "log", "calls", 4, 0), ("far", "log", "calls", 4, 0)], "source string, target string, kind string, line int, col int")
    return n, e


def test_context_of_a_question(spark, shop):
    n, e = shop
    entries = {r.id: r.score for r in K.entry_points(n, e, "how does checkoutPayment use ShoppingCart").collect()}
    assert {"pay", "Cart"} <= set(entries) and "imp" not in entries
    nodes, edges = K.find_context(n, e, "how does checkoutPayment use ShoppingCart")
    got = {r.id: r.root for r in nodes.collect()}
    assert got["pay"] and got["Cart"] and {"add", "Base", "log"} <= set(got) and "far" not in got
    assert {("pay", "add", "calls"), ("Cart", "Base", "extends")} <= {tuple(r) for r in edges.collect()}
    files = [r.file_path for r in K.ranked_files(nodes, n, e, "how does checkoutPayment use ShoppingCart").orderBy("place").collect()]
    assert set(files[:2]) == {"src/pay/checkout.ts", "src/cart/cart.ts"}
    assert K.confident(K.entry_points(n, e, "checkoutPayment ShoppingCart"), n, "checkoutPayment ShoppingCart") and not K.confident(n.where("id = 'log'").selectExpr("id", "1.0 as score"), n, "checkout payment")
    assert K.find_context(n, e, "  ")[0].count() == 0 and K.find_context(n.where("false"), e.where("false"), "ShoppingCart")[0].count() == 0
    s = K.summary(nodes, n, edges).first()
    assert s.n_nodes == len(got) and "checkoutPayment" in s.entry_names


def test_import_hits_become_definitions(spark, shop):
    n, e = shop
    hits = spark.createDataFrame([("imp", 5.0), ("pay", 1.0), ("Cart", 2.0)], "id string, score double")
    assert {r.id: r.score for r in K.to_definitions(hits, n, e).collect()} == {"Cart": 5.0, "pay": 1.0}
    cap = K.non_production_cap(n.selectExpr("id", "file_path", "1 as rank"), 0)
    assert "t1" not in {r.id for r in cap.collect()} and cap.count() == 8


def test_code_and_outlines(spark, shop):
    n, e = shop
    files = spark.createDataFrame([("src/cart/cart.ts", "one\ntwo\nthree\n"), ("conf.yaml", "\n" * 20)], "path string, content string")
    assert {r.id: r.code for r in K.code_of(n, files).collect()} == {"Cart": "one\ntwo", "add": "two\nthree"}
    ctx = spark.createDataFrame([("add", 0.0, False, 1), ("Cart", 2.0, True, 0)], "id string, score double, root boolean, rank int")
    assert [(r.id, r.code, r.cut_off) for r in K.code_blocks(ctx, n, files, most_chars=5).orderBy("place").collect()] == [("Cart", "one\nt", True), ("add", "two\nt", True)]
    assert [(r.id, r.member, r.place) for r in K.outline(n, e).collect()] == [("Cart", "add", 1)]
    assert {(r.id, r.way, r.other) for r in K.trail(n, e).where("id = 'pay'").collect()} == {("pay", "in", "t1"), ("pay", "out", "add"), ("pay", "out", "log")}
