import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from grovespark.operators import skew
from grovespark.operators.hierarchy import descendants, pack, resolve, subtree_sizes, unpack
from grovespark.plans import problems


def _brute(links):
    parent = {}
    for p, c in links:
        if p is not None and c is not None:
            parent[c] = min(parent.get(c, p), p)
    out = {}
    for c in parent:
        way, x = [], c
        while x in parent and x not in way:
            way.append(x)
            x = parent[x]
        out[c] = ("", -1) if x in parent else (x, len(way))
    return parent, out


def test_resolve_against_brute_force(spark):
    rnd = random.Random(5)
    links = [(f"n{rnd.randint(0, i)}", f"n{i}") for i in range(1, 60)]
    links += [(f"d{i}", f"d{i + 1}") for i in range(70)]  # a deep chain
    links += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c2", "below"), ("below", "deeper"), ("s", "s")]
    links += links[:5] + [(None, "x"), ("x", None)]
    links = [(a, b) for a, b in links if a != b or a == "s"]
    df = spark.createDataFrame(links, "source string, target string").selectExpr("*", "1 as node", "2 as root")
    parent, want = _brute(links)
    got = {r.node: (r.root, r.depth) for r in resolve(df).collect()}
    assert got == want
    for r in resolve(df, path=True).collect():
        if r.depth > 0:
            assert len(r.path) == r.depth + 1 and r.path[0] == r.root and r.path[-1] == r.node
            assert all(parent[c] == p for p, c in zip(r.path, r.path[1:]))
        else:
            assert r.path is None
    pairs = {(r.ancestor, r.node): r.distance for r in descendants(df).collect()}
    assert len(pairs) == sum(d for _, d in want.values() if d > 0)
    sizes = {r.ancestor: (r.n_descendants, r.height) for r in subtree_sizes(df).collect()}
    assert sizes == {a: (sum(x == a for x, _ in pairs), max(d for (x, _), d in pairs.items() if x == a)) for a in {x for x, _ in pairs}}
    assert resolve(df.where("false")).count() == 0 == subtree_sizes(df.where("false")).count()


def test_the_least_of_several_parents_is_the_least_id(spark):
    ids = ["zclass:" + "00" * 16, "method:" + "aa" * 16, "free text"]
    df = spark.createDataFrame([(ids[0], "x"), (ids[1], "x"), (ids[2], "y"), (ids[1], "y")], "source string, target string")
    assert {r.node: r.root for r in resolve(df).collect()} == {"x": ids[1], "y": "free text"}


def test_a_line_break_at_the_end_belongs_to_an_id(spark):
    ids = ["class:" + "0a" * 16 + end for end in ("\n", "\r\n", "\u2028", "")]
    assert [r.id for r in spark.createDataFrame([(i,) for i in ids], "id string").select(unpack(pack(F.col("id"))).alias("id")).collect()] == ids
    df = spark.createDataFrame([("r", i) for i in ids] + [(i, f"x{k}") for k, i in enumerate(ids)], "source string, target string")
    assert {(r.node, r.root, r.depth) for r in resolve(df).collect()} == {(i, "r", 1) for i in ids} | {(f"x{k}", "r", 2) for k in range(4)}
    assert {(r.ancestor, r.n_descendants, r.height) for r in subtree_sizes(df).collect()} == {("r", 8, 2)} | {(i, 1, 1) for i in ids}


def test_descendants_come_out_and_cycles_are_named(spark, tmp_path):
    links = [("r", "a"), ("a", "b"), ("b", "c"), ("a", "d"), ("x", "y"), ("y", "x"), ("y", "z"), ("z", "w"), ("s", "s")]
    spark.createDataFrame([(*e, "contains") for e in links + links[:2]] + [("c", "q", "calls")], "source string, target string, kind string").write.parquet(f"{tmp_path}/edges.parquet")
    want = {("r", "a", 1), ("r", "b", 2), ("r", "c", 3), ("r", "d", 2), ("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)} | {("", n, -1) for n in "xyzws"}
    got = problems.QUERIES["p4_descendants"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_pack_is_reversible(spark):
    ids = ["function:" + "0f" * 16, "x", "", "function:" + "0F" * 16, "é漢:" + "ab" * 16, "a:b:c", "type_alias:" + "12" * 16]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    assert [r.id for r in df.select(unpack(pack(df.id)).alias("id")).collect()] == ids


def test_heavy_targets_and_profiles(spark):
    rnd = random.Random(1)
    rows = [(f"s{rnd.randint(0, 300)}", rnd.choice(["hot", "hot", "hot", "warm", f"t{rnd.randint(0, 500)}", None]), rnd.choice(["calls", "imports"]), rnd.choice([None, 1, 2, 3]), None) for _ in range(3000)]
    rows += rows[:400]
    df = spark.createDataFrame(rows, "source string, target string, kind string, line int, col int").selectExpr("*", "'m' as metadata", "1 as key", "2 as value")
    once = Counter(t for _, t, *_ in set(rows))
    want = {t for t, n in once.items() if t is not None and n >= 0.01 * sum(once.values())}
    assert {r.target for r in skew.heavy_targets(df).collect()} == want
    assert skew.heavy_targets(df.where("false")).count() == 0
    pairs = skew.compress(df, "target", "line")
    by = defaultdict(list)
    for _, t, _, line, _ in rows:
        if line is not None:
            by[t].append(line)
    assert {r.key: (r.n_distinct, r.n_rows) for r in skew.distinct_counts(pairs).collect()} == {t: (len(set(by.get(t, []))), n) for t, n in Counter(r[1] for r in rows).items()}
    assert {r.key: (r.mode, r.mode_rows) for r in skew.modes(pairs).collect()} == {t: min(((-n, v) for v, n in Counter(x).items())) and (lambda m: (m[1], -m[0]))(min((-n, v) for v, n in Counter(x).items())) for t, x in by.items()}
    rank = lambda x, q: sorted(x)[max(0, -(-int(len(x) * q * 1000) // 1000) - 1)]
    got = {r.key: (r.p50, r.p90) for r in skew.percentiles(pairs, [0.5, 0.9]).collect()}
    import math

    outlier = spark.range(100_000).selectExpr("'k' as key", "id as value", "1 as n").unionByName(spark.createDataFrame([("k", 10**12, 1), ("k", None, 5), (None, 3, 2)], "key string, value long, n int"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert {r.key: (r.p25, r.p50, r.p99) for r in skew.percentiles(outlier, [0.25, 0.5, 0.99]).collect()} == {"k": (25_000, 50_000, 99_000), None: (3, 3, 3)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    one_hash = lambda c: F.when(c.isin("hot", "t1", "t2"), F.lit(7).cast("long")).otherwise(F.xxhash64(c))
    assert {r.target for r in skew.heavy_targets(df, hashed=one_hash).collect()} == want
    assert got == {t: tuple(sorted(x)[math.ceil(len(x) * q) - 1] for q in (0.5, 0.9)) for t, x in by.items()}
    assert rank([1, 2, 3], 0.5) == 2
