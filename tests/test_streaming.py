from datetime import datetime, timedelta

from grovespark.streaming import watch

T0 = datetime(2025, 3, 1, 12)


def test_bursts_on_a_stream_of_files(spark, tmp_path):
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "a.py").write_text("x")
    (tmp_path / "tree" / "b.txt").write_text("x")
    pending = watch.Pending(spark, str(tmp_path / "state"))
    run = lambda: watch.follow(watch.tree_events(spark, str(tmp_path / "tree"), "*.py"), str(tmp_path / "checkpoint"), pending.take).awaitTermination(60)
    run()
    assert [r.path.rsplit("/", 1)[-1] for r in pending.files().collect()] == ["a.py"]
    (tmp_path / "tree" / "c.py").write_text("x")
    run()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in pending.files().collect()) == ["a.py", "c.py"]


def test_pending_files_survive_failures_and_late_events(spark, tmp_path):
    pending = watch.Pending(spark, str(tmp_path / "state"), most=3)
    at = lambda m: T0 + timedelta(minutes=m)
    events = lambda *x: spark.createDataFrame([(p, at(m)) for p, m in x], "path string, ts timestamp")
    pending.take(events(("a", 1), ("a", 3), ("b", 2)), 0)
    pending.take(events(("a", 1), ("a", 3), ("b", 2)), 0)  # the same batch again, after a failure
    pending.take(spark.createDataFrame([(None, at(1)), ("x", None)], "path string, ts timestamp"), 1)
    state = lambda: {r.path: (r.first_seen, r.last_seen, r.n) for r in pending.files().collect()}
    assert state() == {"a": (at(1), at(3), 2), "b": (at(2), at(2), 1)}
    assert [pending.flush(at(9), ok=False) for _ in range(3)] == [2000, 4000, None] and len(state()) == 2
    pending.take(events(("c", 2)), 2)
    assert pending.flush(at(2), ok=True) == 0 and state() == {"a": (at(1), at(3), 2)}
    assert pending.flush(at(9), ok=False) == 2000 and pending.flush(at(9), ok=True) == 0 and state() == {}


def test_stretches_are_joined_over_short_gaps(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    t = spark.createDataFrame([(at(0), at(8), 3), (at(12), at(13), 1), (at(23), at(24), 2), (at(40), at(40), 1)], "first_seen timestamp, last_seen timestamp, n long")
    got = sorted((r.first_seen, r.last_seen, r.n) for r in watch.bursts(t, "10 minutes").collect())
    assert got == [(at(0), at(13), 4), (at(23), at(24), 2), (at(40), at(40), 1)]
    assert watch.bursts(t.where("false"), "10 minutes").count() == 0
