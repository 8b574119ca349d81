import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from grovespark.functions import names, paths
from grovespark.operators import algorithms as G
from grovespark.operators import linking as L
from grovespark.operators import planning as P
from grovespark.operators import relational as R
from grovespark.operators import search as Q
from grovespark.operators import traversal as T
from grovespark.streaming import watch

EDGE = "source string, target string, kind string, line int, col int"


@pytest.fixture(scope="module")
def edges(spark):
    rows = [("a", "b", "calls", 1, 0), ("a", "b", "references", 2, 0), ("b", "c", "calls", 3, None), ("c", "d", "calls", 4, 0), ("p", "m", "contains", 1, 0), ("q", "m", "calls", 1, 0), ("q", "p", "calls", 2, 0), ("sub", "base", "extends", 1, 0), ("base", "top", "implements", 1, 0)]
    return spark.createDataFrame(rows, EDGE)


def test_traversal(spark, edges):
    seed = lambda *x: spark.createDataFrame([(i,) for i in x], "seed string")
    got = lambda df: {(r.seed, r.id): r.depth for r in df.collect()}
    assert got(T.callers(seed("b"), edges)) == {("b", "a"): 1}
    assert got(T.callees(seed("a"), edges, 2)) == {("a", "b"): 1, ("a", "c"): 2}
    assert got(T.type_hierarchy(seed("base"), edges)) == {("base", "top"): 1, ("base", "sub"): -1}
    nodes = spark.createDataFrame([("p", "class"), ("m", "method"), ("q", "function")], "id string, kind string")
    assert got(T.impact(seed("p"), nodes, edges, 2)) == {("p", "p"): 0, ("p", "m"): 0, ("p", "q"): 1}
    ids = spark.createDataFrame([("a",), ("d",), (None,)], "start string")
    way = T.shortest_paths(ids, ids.withColumnRenamed("start", "end"), T.hops(edges, "out", ["calls"])).where("length > 0").collect()
    assert [(r.start, r.end, r.length, r.path) for r in way] == [("a", "d", 3, "a > b > c > d")]
    chains = T.call_paths(spark.createDataFrame([("a",), ("b",), ("d",), ("q",)], "id string"), edges)
    assert [(r.path, r.length) for r in chains.collect()] == [("a > b > c > d", 3)]
    near, inside = T.subgraph(seed("a"), spark.createDataFrame([(i, "function") for i in "abcd"], "id string, kind string"), edges, max_depth=2)
    assert {(r.id, r.depth) for r in near.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.source, r.target, r.kind) for r in inside.collect()} == {("a", "b", "calls"), ("a", "b", "references"), ("b", "c", "calls")}
    few, _ = T.subgraph(seed("q"), spark.createDataFrame([(i, "function") for i in "mpq"], "id string, kind string"), edges, "both", limit=2)
    assert {r.id for r in few.collect()} == {"q", "m"}  # at equal depth, what is contained comes first, then the least id
    assert got(T.reach(seed("a"), T.hops(edges), 9, absorbing=spark.createDataFrame([("b",)], "id string"))) == {("a", "a"): 0, ("a", "b"): 1}
    assert T.reach(seed(), T.hops(edges), 3).count() == 0


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A chain of 50 methods, one of 45 classes and two of 45 files, where nothing lies in 'corekit/'."""
    rows = [(f"m{i}", "method", f"src/f{i}.py") for i in range(50)] + [(f"c{i}", "class", f"src/f{i}.py") for i in range(45)] + [("e", "enum", "src/f0.py")]
    links = [(f"m{i}", f"m{i + 1}", "calls") for i in range(49)] + [(f"c{i}", f"c{i + 1}", "extends") for i in range(44)] + [("m49", "c0", "instantiates")]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, "python", datetime(2024, 1, 1)) for r in rows], "id string, kind string, file_path string, language string, updated_at timestamp_ntz").coalesce(1).write.parquet(f"{d}/nodes.parquet")
    spark.createDataFrame([(*e, 1, 0) for e in links], EDGE).coalesce(1).write.parquet(f"{d}/edges.parquet")
    return d


def test_ways_have_no_limit_of_hops(spark, tables, monkeypatch):
    from grovespark.plans import graph

    monkeypatch.setattr(graph, "_picked", lambda c="id": F.col(c).isin("m0", "c0"), raising=False)
    ways = {(r.start, r.end): (r.length, r.path) for r in graph.QUERIES["shortest_paths"](spark, tables).collect()}
    assert ways == {("m0", "c0"): (50, " > ".join([f"m{i}" for i in range(50)] + ["c0"]))}
    got = {r.end: r.length for r in graph.QUERIES["shortest_path_len"](spark, tables).collect()}
    assert got == {**{f"m{i}": i for i in range(50)}, "c0": 50}


def test_walk_of_25_rounds(spark, tables, monkeypatch):
    from grovespark.plans import graph

    monkeypatch.setattr(graph, "_picked", lambda c="id": F.col(c) == "src/f0.py")
    got = {r.id: r.score for r in graph.QUERIES["rwr_relevance"](spark, tables).collect()}
    ids = [f"src/f{i}.py" for i in range(50)]
    near = {i: {j for j in (i - 1, i + 1) if 0 <= j < 50} | ({0} if i == 49 else {49} if i == 0 else set()) for i in range(50)}
    score = [float(i == 0) for i in range(50)]
    for _ in range(25):
        flow = [0.0] * 50
        for i in range(50):
            for j in near[i]:
                flow[j] += score[i] / len(near[i])
        score = [0.75 * f + 0.25 * (i == 0) for i, f in enumerate(flow)]
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in zip(ids, score)}
    assert got["src/f12.py"] > 0


def test_traversals_of_all_kinds_of_seeds(spark, tables, monkeypatch):
    from grovespark.plans import graph

    monkeypatch.setattr(graph, "_picked", lambda c="id": F.col(c).isin("m9", "c0"))
    got = lambda q: {(r.seed, r.id): r.depth for r in graph.QUERIES[q](spark, tables).collect()}
    assert got("callers_k2") == {("m9", "m8"): 1, ("m9", "m7"): 2, ("c0", "m49"): 1, ("c0", "m48"): 2}
    assert got("callers_k1")["m9", "m8"] == 1 == got("callees_k1")["m8", "m9"] and len(got("callers_k1")) == 50
    assert {k: v for k, v in got("call_graph_k2").items() if k[0] == "m9"} == {("m9", f"m{9 + i}"): abs(i) for i in (-2, -1, 1, 2)}
    assert {k: v for k, v in got("impact_k3").items() if k[0] == "m9"} == {("m9", f"m{9 - i}"): i for i in range(4)}
    up = got("type_hierarchy")
    assert all(up["c0", f"c{i}"] == i and up["c44", f"c{44 - i}"] == -i for i in range(1, 45))


def test_components_and_waves(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "y"), ("x", "x")], "a string, b string")
    v = spark.createDataFrame([(i,) for i in "abcdexyz"], "id string")
    assert {r.id: r.label for r in G.strong_components(v, links).collect()} == dict(zip("abcdexyz", "aaaddxyz"))
    assert {r.id: r.label for r in G.components(v, links).collect()} == dict(zip("abcdexyz", "aaaaaxxz"))
    deps = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("e", "x"), ("d", "c")], "a string, b string")
    assert {r.id: r.wave for r in G.waves(v, deps).collect()} == {"a": 2, "b": 1, "c": 0, "d": 1, "e": -1, "x": -1, "y": -1, "z": 0}


def _reach(ids, links):
    out = {i: {i} for i in ids}
    while True:
        new = {i: r.union(*[out[b] for a, b in links if a in r]) for i, r in out.items()}
        if new == out:
            return out
        out = new


def test_rounds_give_what_one_task_gives(spark):
    rnd = random.Random(8)
    ids = [f"v{i:02}" for i in range(40)]
    links = [(rnd.choice(ids), rnd.choice(ids)) for _ in range(45)] + [(f"v{i:02}", f"v{i + 1:02}") for i in range(20, 39)] + [(None, "v01"), ("v01", None)]
    v, e = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame(links, "a string, b string")
    real = [(a, b) for a, b in links if a and b and a != b]
    to = _reach(ids, real)
    strong = {i: min(j for j in ids if j in to[i] and i in to[j]) for i in ids}
    weak = _reach(ids, real + [(b, a) for a, b in real])
    bad = {i for i in ids if any(strong[j] != j or any(strong[k] == strong[j] != k for k in ids) or any(strong[k] == j and k != j for k in ids) for j in to[i])}
    wave = {}
    for _ in ids:
        for i in ids:
            if i not in bad:
                wave[i] = max([wave.get(b, 0) + 1 for a, b in real if a == i], default=0)
    for local in (0, 10, 1000):
        assert {r.id: r.label for r in G.strong_components(v, e, local=local).collect()} == strong
        assert {r.id: r.label for r in G.components(v, e, local=local).collect()} == {i: min(w) for i, w in weak.items()}
        assert {r.id: r.wave for r in G.waves(v, e, local=local).collect()} == {i: wave.get(i, -1) for i in ids}
    seeds = spark.createDataFrame([("v03",), ("v20",), ("alone",)], "id string")
    one, many = ({r.id: r.score for r in G.random_walk(seeds, e.where("a is not null and b is not null"), rounds=7, local=n).collect()} for n in (1000, 0))
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 for k in one) and one["alone"] == pytest.approx(1 / 3)
    for f in (G.strong_components, G.components, G.waves):
        for local in (0, 9):
            assert f(v.where("false"), e, local=local).count() == 0 and f(v, e.where("false"), local=local).count() == 40


def test_long_chains(spark):
    n = 5000
    chain = spark.range(n).selectExpr("format_string('c%05d', id) as a", "format_string('c%05d', id + 1) as b")
    v = spark.range(n + 1).selectExpr("format_string('c%05d', id) as id")
    got = G.waves(v, chain).agg(F.max("wave"), F.count("wave"), F.count_distinct("wave")).first()
    assert tuple(got) == (n, n + 1, n + 1)
    ring = chain.unionByName(spark.createDataFrame([("c05000", "c04000")], "a string, b string"))
    scc = G.strong_components(v, ring)
    assert scc.where("label = 'c04000'").count() == 1001 and scc.where("label = id").count() == 4001
    short = chain.where("a < 'c00300'")
    assert G.strong_components(v.where("id <= 'c00300'"), short, local=0).where("label = id").count() == 301


def test_louvain_in_rounds(spark):
    rnd = random.Random(2)
    groups = ["abcdefgh", "ijklmnop", "qrstuvwx"]
    rows = [(a, b, 4) for g in groups for a in g for b in g if a < b] + [(rnd.choice(groups[0]), rnd.choice(groups[1]), 1), ("p", "q", 1), ("z", "z", 9)]
    links = spark.createDataFrame(rows, "a string, b string, weight int")
    want = {x: g[0] for g in groups for x in g}
    for local in (0, 20, 1000):
        assert {r.id: r.community for r in G.louvain(links, local=local).collect()} == want
    assert G.louvain(links.where("false")).count() == 0


def test_louvain_and_walk(spark):
    clique = lambda s: [(a, b, 5) for a in s for b in s if a < b]
    links = spark.createDataFrame(clique("abcd") + clique("wxyz") + [("d", "w", 1)], "a string, b string, weight int")
    parts = {r.id: r.community for r in G.louvain(links).collect()}
    assert parts == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("wxyz", "w")}
    walk = {r.id: r.score for r in G.random_walk(spark.createDataFrame([("a",)], "id string"), links).collect()}
    assert abs(sum(walk.values()) - 1) < 1e-6 and walk["a"] > walk["d"] > walk["z"]
    c = {r.community: r.cohesion for r in G.cohesion(G.louvain(links), links).collect()}
    assert c == {"a": 1.0, "w": 1.0}


def test_relational(spark, edges):
    nodes = spark.createDataFrame([("a", "function", "f1", True), ("b", "function", "f1", None), ("c", "method", "f2", False), ("d", "function", "f3", False), ("z", "method", "f3", False)], "id string, kind string, file_path string, is_exported boolean")
    assert {r.id for r in R.dead_code(nodes, edges, ["function", "method"]).collect()} == {"z"}
    assert {(r.source_file, r.target_file, r.n) for r in R.cross_file(edges, nodes).collect()} == {("f1", "f2", 1), ("f2", "f3", 1)}
    m = {r.id: (r.n_in, r.n_out, r.n_callers) for r in R.node_metrics(nodes, edges).collect()}
    assert m["b"] == (2, 1, 1) and m["z"] == (0, 0, 0)
    pts = spark.createDataFrame([("f", 5), ("f", 50), ("f", 5000), ("g", 1), ("f", None)], "file_path string, line int")
    rng = spark.createDataFrame([("big", "f", 1, 9000), ("in", "f", 4, 6), ("in2", "f", 4, 6)], "id string, file_path string, start_line int, end_line int")
    assert {(r.line, r.range_id) for r in R.enclosing(pts, rng, ["file_path", "line"]).collect()} == {(5, "in"), (50, "big"), (5000, "big")}
    items = spark.createDataFrame([("r/p/a.ts",), ("r/px/a.ts",), ("q.ts",), (None,)], "path string")
    f = spark.createDataFrame([("r",), ("r/p",)], "folder string")
    assert {r.path: r.folder for r in R.longest_prefix(items, "path", f).collect()} == {"r/p/a.ts": "r/p", "r/px/a.ts": "r", "q.ts": None, None: None}
    cl = spark.createDataFrame([("f", 1, 3, "a"), ("f", 5, 9, "b"), ("f", 30, 31, "c")], "file_path string, start_line int, end_line int, id string")
    assert {(r.first_line, r.last_line, r.n) for r in R.line_clusters(cl, 3).collect()} == {(1, 9, 2), (30, 31, 1)}
    b = spark.createDataFrame([("g", "1", 60), ("g", "2", 50), ("g", "3", 30), ("h", "1", 999)], "g string, o string, c int")
    assert {(r.g, r.o) for r in R.within_budget(b, "g", "o", "c", 100).collect()} == {("g", "1"), ("g", "3"), ("h", "1")}
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", None), (None, 4)], "k string, v int")
    assert {(r.k, r.v) for r in R.upsert(old, new, ["k"]).collect()} == {("a", 1), ("b", 3), ("c", None)}


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(names.segments(F.lit("HTMLParser_getOrderState2 99"))) == ["html", "parser", "get", "order", "state2"]
    assert one(names.segments(F.lit(None).cast("string"))) == []
    assert one(names.stem_variants(F.lit("caching"))) == ["cach", "cache"]
    assert one(names.stem_variants(F.lit("entries"))) == ["entry"]
    assert one(names.lookup_variants(F.lit("services"))) == ["services", "service"]
    assert one(names.lookup_variants(F.lit("class"))) == ["class"]
    assert one(names.name_match_bonus(F.lit("Pod"), "pod")) == 80
    assert [one(names.edit_distance(F.lit("ab"), F.lit(x), 2)) for x in ("ab", "ba", "abcd", "wxyz")] == [0, 2, 2, 3]
    assert one(paths.proximity(F.lit("a/b/c.ts"), F.lit("a/b/d/e.ts"))) == 30
    assert one(paths.is_test(F.lit("src/latest.kt"))) is False and one(paths.is_test(F.lit("src/FooTest.kt"))) is True
    q = names.parse_query('kind:class lang:go path:"a b" foo http://x kind:nothing bar:1')
    assert (q["kind"], q["language"], q["path"], q["text"]) == (["class"], ["go"], ["a b"], "foo http://x kind:nothing bar:1")


def test_search_and_linking(spark):
    rows = [("1", "openLedger", "f::openLedger", "Opens the oldest ledger.", "()", "function", "a/f.ts", "typescript", True, 3), ("2", "closeLedger", "f::closeLedger", None, None, "function", "a/g.ts", "typescript", False, 9), ("3", "openLedger", "x::openLedger", None, None, "function", "z/y.go", "go", False, 1)]
    n = spark.createDataFrame(rows, "id string, name string, qualified_name string, docstring string, signature string, kind string, file_path string, language string, is_exported boolean, start_line int")
    assert {r.id for r in Q.bm25(n, ["oldest"]).collect()} == {"1"}
    assert {(r.id, r.distance) for r in Q.fuzzy(n, "openLedgr").collect()} == {("1", 1), ("3", 1)}
    assert Q.ranked(n, "zzzz", 5).count() == 0
    refs = spark.createDataFrame([("9", "openLedger", "calls", 5, 0, "a/h.ts", "typescript"), ("9", "openLedger", "calls", 5, 0, "a/h.ts", "typescript"), ("9", "gone", "calls", 1, 0, "", "unknown")], "from_node_id string, reference_name string, reference_kind string, line int, col int, file_path string, language string")
    e = spark.createDataFrame([], EDGE)
    got = L.resolve(refs, n, e).collect()
    assert [(r.target, r.method) for r in got] == [("1", "exact-name")]
    assert [(r.kind, r.source) for r in L.to_edges(L.resolve(refs, n, e), n).collect()] == [("calls", "9")]


def test_planning(spark):
    o = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "c")], "unit string, member string")
    n = spark.createDataFrame([("x", "a"), ("y", "a"), ("y", "b"), ("y", "z")], "unit string, member string")
    assert [(r.old_unit, r.new_unit, r.overlap) for r in P.ledger_remap(o, n).collect()] == [("u", "y", 2)]
    f = spark.createDataFrame([("m", f"p{i}", s) for i, s in enumerate([300, 400, 100, 900, 5])], "m string, p string, s long")
    assert [r.slice for r in P.next_fit(f, "m", "p", "s", 600, 20).orderBy("p").collect()] == [0, 1, 1, 2, 3]
    log = spark.createDataFrame([("u", None, "pending"), ("u", "pending", "verified")], "unit string, from_status string, to_status string")
    assert [r.to_status for r in P.illegal_moves(log).collect()] == ["verified"]
    b, a = spark.createDataFrame([("k", 1), ("l", None)], "k string, v int"), spark.createDataFrame([("k", 2), ("l", None), ("m", 1)], "k string, v int")
    assert {(r.k, r.change) for r in P.snapshot_diff(b, a, "k", "v").collect()} == {("k", "changed"), ("m", "added")}


def test_stream_and_batch_agree(spark, tmp_path):
    rows = [("a", datetime(2025, 1, 1, 0, 0, s)) for s in (0, 1, 9)] + [("b", datetime(2025, 1, 1, 0, 0, 3)), ("a", None)]
    df = spark.createDataFrame(rows, "path string, ts timestamp")
    want = {(r.path, r.n) for r in watch.sessions(df, "path", "ts", "2 seconds").collect()}
    assert want == {("a", 2), ("a", 1), ("b", 1)}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    q = watch.sessions(stream, "path", "ts", "2 seconds").writeStream.outputMode("complete").foreachBatch(lambda b, i: got.append({(r.path, r.n) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert got[-1] == want


def test_many_seeds_as_bits(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(150), rng.randrange(150)) for _ in range(260)}
    num = lambda x, *c: spark.createDataFrame([i if isinstance(i, tuple) else (i,) for i in x], ", ".join(f"{n} long" for n in c))
    steps, seeds, goals = num([p for p in pairs if p[0] != p[1]], "a", "b"), num(range(140), "seed"), num(range(0, 150, 3), "id")
    want = T.reach(seeds, steps, 4, absorbing=goals).join(goals, "id", "left_semi")
    rows = lambda df: sorted((r.seed, r.id, r.depth) for r in df.collect())
    assert rows(T.reach_of_many(seeds, steps, 4, goals, absorbing=goals)) == rows(want)


def test_impact_of_deep_containers_takes_few_rounds(spark, monkeypatch):
    written, cut = [], T.cut
    monkeypatch.setattr(T, "cut", lambda df: written.append(1) or cut(df))
    nodes = spark.createDataFrame([(f"k{i}", "class") for i in range(40)] + [("m", "method"), ("u", "function")], "id string, kind string")
    e = spark.createDataFrame([(f"k{i}", f"k{i + 1}", "contains", 1, 0) for i in range(39)] + [("k39", "k0", "contains", 1, 0), ("k39", "m", "contains", 1, 0), ("u", "m", "calls", 1, 0)], EDGE)
    got = {(r.seed, r.id): r.depth for r in T.impact(spark.createDataFrame([("k0",), (None,)], "seed string"), nodes, e).collect()}
    assert got == {("k0", i): 0 for i in [f"k{j}" for j in range(40)] + ["m"]} | {("k0", "u"): 1}
    assert len(written) < 25


def test_walk_over_numbers(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (2, 1), (5, 6)], "a long, b long")
    seeds = spark.createDataFrame([(1,), (9,)], "id long")
    here, far = ({r.id: r.score for r in G.random_walk(seeds, links, local=k).collect()} for k in (100, 0))
    assert here == pytest.approx(far) and set(here) == {1, 2, 3, 5, 6, 9} and here[9] == pytest.approx(0.5)
