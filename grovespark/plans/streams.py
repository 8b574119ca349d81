"""Queries over change events, as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovespark.sources import read
from grovespark.streaming import watch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LANDED = "e AS (SELECT split_part(path, '/', 1) AS repository, path, indexed_at AS ts FROM files WHERE indexed_at IS NOT NULL)"


def _events(s, d):
    return read(s, d, "files").where("indexed_at is not null").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("repository"), "path", F.col("indexed_at").alias("ts"))


@query(f"WITH {_LANDED}, m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY repository ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM e), g AS (SELECT *, sum(fresh) OVER (PARTITION BY repository ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT repository, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM g GROUP BY repository, k")
def debounce_sessions(s, d):
    return watch.sessions(_events(s, d), "repository", "ts", "2 hours")


@query(f"WITH {_LANDED}, m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM e), g AS (SELECT *, sum(fresh) OVER (ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT 'all' AS scope, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM g GROUP BY k")
def debounce_global(s, d):
    """One timer for all events. Events of the same ten minutes are always one burst, so they are merged to their first and
    last time and number first; what one window then orders is one row for each stretch of time, however many events."""
    t = _events(s, d).groupBy(F.window("ts", "10 minutes").alias("w")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return watch.bursts(t, "10 minutes").select(F.lit("all").alias("scope"), "first_seen", "last_seen", "n")


@query(f"WITH {_LANDED}, t AS (SELECT max(started_at) AS t0 FROM sync_runs WHERE status = 'succeeded') SELECT path, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM e, t WHERE ts > t0 GROUP BY path")
def pending_state(s, d):
    at = read(s, d, "sync_runs").where("status = 'succeeded'").agg(F.max("started_at").alias("at"))
    return watch.pending(_events(s, d), "path", "ts", at.scalar())


@query("WITH a AS (SELECT *, status = 'succeeded' AS ok, sum(CASE WHEN status = 'succeeded' THEN 1 ELSE 0 END) OVER (ORDER BY started_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM sync_runs), b AS (SELECT started_at, row_number() OVER (PARTITION BY coalesce(run, 0) ORDER BY started_at) AS attempt FROM a WHERE NOT ok) SELECT 'sync' AS key, started_at AS at_, CAST(attempt AS INTEGER) AS attempt, CAST(2000 * pow(2, least(attempt, 5) - 1) AS BIGINT) AS wait_ms, attempt >= 5 AS given_up FROM b")
def retry_backoff(s, d):
    a = read(s, d, "sync_runs").select(F.lit("sync").alias("key"), F.col("started_at").alias("at"), (F.col("status") == "succeeded").alias("ok"))
    return watch.backoff(a).withColumnRenamed("at", "at_")
