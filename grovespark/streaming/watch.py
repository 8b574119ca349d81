"""Change events: debouncing, pending files, and incremental processing of a stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grovespark.operators.incremental import CommitLog


def sessions(events: DataFrame, key: str, ts: str, quiet: str) -> DataFrame:
    """(key, first_seen, last_seen, n): bursts of events, ended by a quiet time. The same on a batch and on a stream; on a
    stream, `events` needs a watermark on `ts`. With a constant key one timer serves all, as with a single debouncer.
    Rows without a time are dropped."""
    e = events.where(F.col(ts).isNotNull())
    g = e.groupBy(F.col(key), F.session_window(F.col(ts), quiet).alias("w")).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return g.select(key, "first_seen", "last_seen", "n")


def bursts(stretches: DataFrame, quiet: str) -> DataFrame:
    """(first_seen, last_seen, n): stretches of events (the same columns) that do not overlap, joined where less than a quiet
    time lies between. One window orders all stretches; their number depends on the time covered, not on the events."""
    w = W.orderBy("first_seen")
    fresh = F.when(F.col("first_seen") < F.lag("last_seen").over(w) + F.expr(f"INTERVAL {quiet}"), 0).otherwise(1)
    g = stretches.withColumn("_fresh", fresh).withColumn("_g", F.sum("_fresh").over(w))
    return g.groupBy("_g").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n")).drop("_g")


def pending(events: DataFrame, key: str, ts: str, synced_at) -> DataFrame:
    """(key, first_seen, last_seen, n): what is still to be processed after a run that started at `synced_at` (a column or
    literal): events up to then are done, later ones stay."""
    return events.where(F.col(ts) > synced_at).groupBy(key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("n"))


def backoff(attempts: DataFrame, most: int = 5, base_ms: int = 2000) -> DataFrame:
    """(key, attempt, wait_ms, given_up): doubling waits of consecutive failures of a key; given up from `most` on. attempts:
    (key, at, ok)."""
    w = W.partitionBy("key").orderBy("at")
    run = F.sum(F.col("ok").cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    a = attempts.withColumn("_run", F.coalesce(run, F.lit(0))).where("not ok")
    n = F.row_number().over(W.partitionBy("key", "_run").orderBy("at"))
    return a.withColumn("attempt", n).select("key", "at", "attempt", (F.lit(base_ms) * F.pow(F.lit(2), F.least(F.col("attempt"), F.lit(most)) - 1)).cast("long").alias("wait_ms"), (F.col("attempt") >= most).alias("given_up"))


def follow(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs `handle(batch, batch_id)` once for each new batch and stops when the source is exhausted. After a failure the
    same batch comes again under the same id, so a handler that overwrites by id neither skips nor repeats rows."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tree_events(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """A stream of (path, ts): files of a tree as they appear or are written again, by modification time. Contents are not read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("modificationTime").alias("ts"))


class Pending:
    """Files that changed and wait for a run, kept as versioned tables in a shared folder.

    `take` merges a batch of events (path, ts): first and last time and number per path; a batch that comes again after a
    failure is known by its id and counts once. `flush` ends a run that began at `started`: after success all that was last
    seen up to then is done, and what came later stays for the next run, however late it arrives; after a failure all
    stays, and the wait doubles, up to `most` failures in a row.
    """

    def __init__(self, spark: SparkSession, root: str, most: int = 5, base_ms: int = 2000):
        self.spark, self.root, self.most, self.base_ms, self.log = spark, root.rstrip("/"), most, base_ms, CommitLog(spark, root)

    def _head(self) -> dict:
        c = self.log.chain()
        return c[-1] if c else {"n": 0, "table": None, "batch": -1, "failures": 0}

    def files(self) -> DataFrame:
        """(path, first_seen, last_seen, n) of what waits."""
        at, schema = self._head()["table"], "path string, first_seen timestamp, last_seen timestamp, n long"
        return self.spark.read.schema(schema).parquet(at) if at else self.spark.createDataFrame([], schema)

    def _commit(self, head: dict, df: DataFrame | None, **change) -> None:
        at = head["table"]
        if df is not None:
            at = f"{self.root}/pending/{uuid.uuid4().hex}"
            df.write.parquet(at)
        self.log.commit(head["n"], {"table": at, "batch": head["batch"], "failures": head["failures"]} | change)

    def take(self, batch: DataFrame, batch_id: int) -> None:
        head = self._head()
        if batch_id <= head["batch"]:
            return
        new = batch.where("path is not null and ts is not null").select("path", F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.lit(1).cast("long").alias("n"))
        both = self.files().unionByName(new).groupBy("path").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"))
        self._commit(head, both, batch=batch_id)

    def flush(self, started, ok: bool) -> int | None:
        """Milliseconds to wait before the next run: 0 after success, None when there were too many failures in a row."""
        head = self._head()
        if ok:
            self._commit(head, self.files().where(F.col("last_seen") > F.lit(started)), failures=0)
            return 0
        failures = head["failures"] + 1
        self._commit(head, None, failures=failures)
        return None if failures >= self.most else self.base_ms * 2 ** (failures - 1)
