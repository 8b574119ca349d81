import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grovespark.operators.incremental import Intervals, Ledger, changed_paths, islands, plan_runs, run_once, spans_table, subtract, united, within

spans = st.lists(st.tuples(st.integers(0, 40), st.integers(0, 8)).map(lambda x: (x[0], x[0] + x[1])), max_size=8)


@given(spans, spans)
def test_interval_algebra(a, b):
    as_set = lambda s: {x for lo, hi in s for x in range(lo, hi + 1)}
    x, y = Intervals.of(a), Intervals.of(b)
    assert as_set(x.spans) == as_set(a)
    assert as_set(x.minus(y).spans) == as_set(a) - as_set(b)
    assert as_set(x.union(y).spans) == as_set(a) | as_set(b)
    assert all(p[1] + 1 < q[0] for p, q in zip(x.spans, x.spans[1:]))


def _spans(df):
    return Intervals.of((r.lo, r.hi) for r in df.collect()).spans


def test_islands(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (5,), (None,), (7,), (8,), (-4,)], "s long")
    assert _spans(islands(df, "s", 3)) == ((-4, -4), (1, 2), (5, 5), (7, 8))
    assert islands(df.where("s > 100"), "s").count() == 0


def test_interval_tables_against_sets(spark):
    rnd = random.Random(6)
    for _ in range(4):
        a, b = ({rnd.randint(-20, 60) for _ in range(30)} for _ in range(2))
        x, y = (islands(spark.createDataFrame([(i,) for i in s], "s long"), "s", 7) for s in (a, b))
        as_set = lambda df: [i for r in df.collect() for i in range(r.lo, r.hi + 1)]
        assert sorted(as_set(subtract(x, y))) == sorted(a - b) and sorted(as_set(united(x, y))) == sorted(a | b)
        assert all(r.lo // 7 == r.hi // 7 == r.bucket for r in united(x, y).collect())


def test_rows_within_few_and_many_intervals(spark):
    df = spark.range(400).withColumnRenamed("id", "s").selectExpr("s", "s as at", "s as bucket", "s as hi")
    spans = Intervals.of((x, x + 1) for x in range(0, 400, 5))
    t = spans_table(spark, spans, 7)
    want = [x for x in range(400) if x in spans]
    assert sorted(r.s for r in within(df, "s", t, width=7).collect()) == want == sorted(r.s for r in within(df, "s", t, few=1000, width=7).collect())


def test_a_million_islands_stay_tables(spark):
    odd = spark.range(0, 2_000_000, 2).withColumnRenamed("id", "s")
    x = islands(odd, "s", 1 << 14)
    assert x.count() == 1_000_000
    gaps = subtract(x, islands(odd.where("s >= 100"), "s", 1 << 14))
    assert [(r.lo, r.hi) for r in gaps.orderBy("lo").collect()] == [(i, i) for i in range(0, 100, 2)]


def test_ledger_takes_late_rows_once_and_survives_failures(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"), width=4)
    src = lambda *n: spark.createDataFrame([(x, f"v{x}") for x in n], "s long, v string")
    seen = lambda: sorted(r.s for p in ledger.outputs() for r in spark.read.parquet(p).collect())
    assert _spans(run_once(src(1, 2, 5), ledger, "s", lambda d: d)) == ((1, 2), (5, 5))

    def dies(df):
        raise ValueError("lost")

    with pytest.raises(ValueError):
        run_once(src(1, 2, 3, 5, 6), ledger, "s", dies)
    with pytest.raises(Exception):  # noqa: B017, PT011
        run_once(src(1, 2, 3, 5, 6), ledger, "s", lambda d: d.withColumn("v", F.raise_error(F.lit("lost"))))
    assert seen() == [1, 2, 5]
    # 3 was committed late, below numbers that are done; it is still a gap.
    assert _spans(run_once(src(1, 2, 3, 5, 6), ledger, "s", lambda d: d)) == ((3, 3), (6, 6))
    assert seen() == [1, 2, 3, 5, 6]
    assert _spans(run_once(src(1, 2, 3, 5, 6), ledger, "s", lambda d: d)) == ()
    assert _spans(ledger.state()[1]) == ((1, 3), (5, 6))


def test_of_two_runs_that_race_one_loses(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    src = spark.createDataFrame([(1,), (2,)], "s long")

    def slow(df):
        run_once(src, Ledger(spark, ledger.root), "s", lambda d: d)
        return df

    with pytest.raises(RuntimeError):
        run_once(src, ledger, "s", slow)
    assert len(ledger.outputs()) == 1
    # A run that died while it wrote its commit leaves an empty file, which counts for nothing.
    (tmp_path / "ledger" / "commits" / "2.json").write_text("")
    assert len(ledger.outputs()) == 1
    run_once(src.unionByName(spark.createDataFrame([(9,)], "s long")), ledger, "s", lambda d: d)
    assert sorted(r.s for p in ledger.outputs() for r in spark.read.parquet(p).collect()) == [1, 2, 9]


def _files(spark, rows):
    return spark.createDataFrame(rows, "path string, content_hash string, modified_at timestamp_ntz, indexed_at timestamp_ntz, extra int")


def test_changed_paths_against_brute_force(spark):
    t0, rnd = datetime(2025, 3, 1), random.Random(3)
    at = lambda h: t0 + timedelta(hours=h)
    rows = [(rnd.choice("abcde"), rnd.choice(["x", "y", "z", None]), at(rnd.randint(-9, 99)), None if rnd.random() < 0.1 else at(rnd.randint(0, 60)), 1) for _ in range(150)]
    rows += rows[:20] + [(None, "x", at(1), at(1), 1)]
    runs = [(k, at(rnd.randint(0, 60)), rnd.choice(["succeeded", "failed", "aborted", "running"])) for k in range(25)] + [(90, None, "succeeded"), (None, at(3), "succeeded")]
    ok = sorted((at_, k) for k, at_, s in runs if s == "succeeded" and at_ and k is not None)
    want, before = set(), {}
    for at_, k in ok:
        now = {}
        for p, h, m, i, _ in rows:
            if p and h and i and i <= at_:
                now[p] = max(now.get(p, (datetime.min, datetime.min, "")), (i, m, h))
        now = {p: v[2] for p, v in now.items()}
        want |= {(k, p) for p, h in now.items() if before.get(p) != h}
        before = now
    log = spark.createDataFrame(runs, "run_id long, started_at timestamp_ntz, status string")
    assert {tuple(r) for r in changed_paths(_files(spark, rows), log).collect()} == want
    assert changed_paths(_files(spark, rows), log.where("status = 'none'")).count() == 0
    assert changed_paths(_files(spark, []), log).count() == 0
    assert [p[0] for p in plan_runs(log)] == [k for n, (a, k) in enumerate(ok) if n == 0 or a > ok[n - 1][0]]
