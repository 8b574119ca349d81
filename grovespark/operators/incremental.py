"""Processing only new or changed records, by interval sets of sequence numbers.

A ledger keeps what was processed as disjoint, merged intervals of sequence numbers. A run takes the available ranges,
subtracts the ledger and works on the gaps only; so numbers that become visible late stay gaps until a run sees them.
The merged intervals are committed together with the output, so a run that dies leaves neither.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovespark.session import cut

MICROS_A_DAY = 86_400_000_000
#: Sequence numbers of one bucket of an interval table.
WIDTH = 1 << 20


@dataclass(frozen=True)
class Intervals:
    """Disjoint, sorted, closed intervals of integers; adjacent ones are merged."""

    spans: tuple[tuple[int, int], ...] = ()

    @staticmethod
    def of(spans) -> Intervals:
        out: list[list[int]] = []
        for lo, hi in sorted((a, b) for a, b in spans if a <= b):
            if out and lo <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
        return Intervals(tuple((a, b) for a, b in out))

    def union(self, other: Intervals) -> Intervals:
        return Intervals.of([*self.spans, *other.spans])

    def minus(self, other: Intervals) -> Intervals:
        out, i = [], 0
        for lo, hi in self.spans:
            while i and other.spans[i - 1][1] >= lo:
                i -= 1
            while i < len(other.spans) and other.spans[i][1] < lo:
                i += 1
            k = i
            while k < len(other.spans) and other.spans[k][0] <= hi:
                a, b = other.spans[k]
                if a > lo:
                    out.append((lo, a - 1))
                lo = max(lo, b + 1)
                k += 1
            if lo <= hi:
                out.append((lo, hi))
        return Intervals.of(out)

    def __contains__(self, x: int) -> bool:
        return any(a <= x <= b for a, b in self.spans)


# Interval sets as tables: (bucket, lo, hi), disjoint and merged within a bucket of `width` numbers. A bucket holds no more
# intervals than numbers, so every step is a window over a bucket, and no set is ever gathered in one place.


def islands(df: DataFrame, seq: str, width: int = WIDTH) -> DataFrame:
    """The ranges of consecutive sequence numbers that are present. Null numbers are not available; nothing present: no rows."""
    n = df.where(F.col(seq).isNotNull()).select(F.col(seq).cast("long").alias("_s")).distinct().withColumn("bucket", F.floor(F.col("_s") / width))
    run = F.col("_s") - F.row_number().over(W.partitionBy("bucket").orderBy("_s"))
    return n.withColumn("_g", run).groupBy("bucket", "_g").agg(F.min("_s").alias("lo"), F.max("_s").alias("hi")).drop("_g")


def spans_table(spark: SparkSession, spans: Intervals, width: int = WIDTH) -> DataFrame:
    """A few intervals as a table, cut at the buckets' borders."""
    t = spark.createDataFrame(list(spans.spans), "_lo long, _hi long")
    t = t.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    return t.select("bucket", F.greatest("_lo", F.col("bucket") * width).alias("lo"), F.least("_hi", (F.col("bucket") + 1) * width - 1).alias("hi"))


def _swept(a: DataFrame, b: DataFrame, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """Where `keep(in a, in b)` holds, merged: one sweep over the ends of both sets' intervals in each bucket."""
    ends = lambda df, x, y: df.select("bucket", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(x).alias("a"), F.lit(y).alias("b")), F.struct((F.col("hi") + 1).alias("at"), F.lit(-x).alias("a"), F.lit(-y).alias("b")))).alias("e")).select("bucket", "e.*")
    e = ends(a, 1, 0).unionByName(ends(b, 0, 1)).groupBy("bucket", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = W.partitionBy("bucket").orderBy("at")
    e = e.select("bucket", "at", keep(F.sum("a").over(w) > 0, F.sum("b").over(w) > 0).alias("on"))
    e = e.withColumn("was", F.lag("on", 1, False).over(w)).where("on <> was")
    return e.withColumn("hi", F.lead("at").over(w) - 1).where("on").select("bucket", F.col("at").alias("lo"), "hi")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return _swept(a, b, lambda x, y: x & ~y)


def united(a: DataFrame, b: DataFrame) -> DataFrame:
    return _swept(a, b, lambda x, y: x | y)


def within(df: DataFrame, seq: str, spans: DataFrame, few: int = 50, width: int = WIDTH) -> DataFrame:
    """The rows whose sequence number lies in the intervals of a table. A few intervals are a filter that the scan can use;
    of many, each number finds the interval that starts last before it, in its bucket, and rows are kept by a semi-join."""
    some = spans.select("lo", "hi").limit(few + 1).collect()
    if len(some) <= few:
        cond = F.lit(False)
        for r in some:
            cond = cond | F.col(seq).between(r.lo, r.hi)
        return df.where(cond)
    number = df.where(F.col(seq).isNotNull()).select(F.col(seq).cast("long").alias("at")).distinct().select(F.floor(F.col("at") / width).alias("bucket"), "at", F.lit(None).cast("long").alias("hi"), F.lit(1).alias("row"))
    both = number.unionByName(spans.select("bucket", F.col("lo").alias("at"), "hi", F.lit(0).alias("row")))
    reach = F.last("hi", ignorenulls=True).over(W.partitionBy("bucket").orderBy("at", "row"))
    taken = both.withColumn("_hi", reach).where("row = 1 and at <= _hi").select(F.col("at").alias("_s"))
    return df.join(taken, df[seq].cast("long") == taken["_s"], "left_semi")


class CommitLog:
    """Commits in a folder that all executors reach: `commits/<n>.json` holds a payload and the commit it builds on.

    A file is created under its final name and never overwritten, so of two runs that race for a number one loses. Commits
    form a chain from the newest whole file back; files off the chain, as of a run that died while it wrote one, count for
    nothing, and neither do tables that no commit names.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        d = self._path(f"{self.root}/commits")
        names = [s.getPath().getName() for s in self._fs.listStatus(d)] if self._fs.exists(d) else []
        return sorted(int(x[:-5]) for x in names if x.endswith(".json") and not x.startswith("."))

    def chain(self) -> list[dict]:
        """Commits that count, oldest first."""
        found = {}
        for n in self._numbers():
            try:
                found[n] = json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/commits/{n}.json").collect())) | {"n": n}
            except ValueError:
                continue
        out, n = [], max(found, default=0)
        while n:
            out.append(found[n])
            n = found[n]["after"]
        return out[::-1]

    def commit(self, after: int, payload: dict) -> int:
        """Makes a payload count if `after` is still the newest commit; raises if another run was faster."""
        n = max(self._numbers(), default=0) + 1
        if (self.chain() or [{"n": 0}])[-1]["n"] != after:
            raise RuntimeError(f"another run committed after {after}")
        try:
            out = self._fs.create(self._path(f"{self.root}/commits/{n}.json"), False)
        except Py4JJavaError as e:
            raise RuntimeError(f"commit {n} was taken by another run") from e
        out.write(bytearray(json.dumps({"after": after} | payload).encode()))
        out.close()
        if self.chain()[-1]["n"] != n:
            raise RuntimeError(f"commit {n} was overtaken by another run")
        return n


class Ledger:
    """Committed intervals of a consumer: a run writes its output and the intervals after it as tables of their own, and one
    commit makes both count."""

    def __init__(self, spark: SparkSession, root: str, width: int = WIDTH):
        self.spark, self.root, self.width = spark, root.rstrip("/"), width
        self.log = CommitLog(spark, root)

    def state(self) -> tuple[int, DataFrame]:
        """Number of the newest commit, and the intervals after it."""
        c = self.log.chain()
        return (c[-1]["n"], self.spark.read.parquet(c[-1]["intervals"])) if c else (0, self.spark.createDataFrame([], "bucket long, lo long, hi long"))

    def outputs(self) -> list[str]:
        return [c["output"] for c in self.log.chain()]


def run_once(source: DataFrame, ledger: Ledger, seq: str, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One run: process exactly the rows of `source` whose sequence numbers no earlier run committed, and commit.

    Gives the gaps it processed (bucket, lo, hi). Rows with a null number are never taken. A run over nothing new writes
    and commits nothing. If `process` or the write fails, nothing is committed and the next run takes the same gaps again.
    """
    n, done = ledger.state()
    mark = uuid.uuid4().hex
    gaps = cut(subtract(islands(source, seq, ledger.width), done))
    if gaps.isEmpty():
        return gaps
    out, spans = f"{ledger.root}/data/{mark}", f"{ledger.root}/intervals/{mark}"
    process(within(source, seq, gaps, width=ledger.width)).write.parquet(out)
    united(done, gaps).write.parquet(spans)
    ledger.log.commit(n, {"intervals": spans, "output": out})
    return gaps


def plan_runs(runs: DataFrame) -> list[tuple[int, int, int]]:
    """What each succeeded run had to take, replayed from a run log (run_id, started_at, status): (run_id, lo, hi) in
    microseconds of landing time. A run sees everything landed up to its start; what earlier succeeded runs took is
    subtracted, while runs that failed, aborted or still run committed nothing, so their share stays a gap.

    The log is a control table of the scheduler, one row per run, and is read to the driver. Rows without id, start or
    status are no runs. Runs with equal starts: the lower id takes the gap, the others nothing.
    """
    log = runs.where((F.col("status") == "succeeded") & F.col("started_at").isNotNull() & F.col("run_id").isNotNull())
    rows = log.select("run_id", F.unix_micros(F.col("started_at").cast("timestamp")).alias("at")).distinct().collect()
    done, first, plan = Intervals(), -(1 << 62), []
    for run_id, at in sorted(((r.run_id, r["at"]) for r in rows), key=lambda x: (x[1], x[0])):
        gaps = Intervals.of([(first, at)]).minus(done)
        plan += [(run_id, lo, hi) for lo, hi in gaps.spans]
        done = done.union(gaps)
    return plan


def changed_paths(files: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, path): what each succeeded run must process.

    Every observation that has a hash and a landing time falls into the gap of exactly one run. The content of a path
    at a run is the hash of its greatest (indexed_at, modified_at) so far, so per run and path the greatest observation
    of its gap is enough, combined before the shuffle; a path changed when that hash differs from the one before.
    Observations landed after the last succeeded run belong to none. Returning to older content is a change; a touch
    with the same hash is none. Empty tables and a log without a succeeded run give no rows; rows without path, hash or
    landing time take no part; of observations equal in both times the greatest hash counts.
    """
    spark = files.sparkSession
    day = lambda micros: micros // MICROS_A_DAY
    seen = (
        files.where(F.col("path").isNotNull() & F.col("content_hash").isNotNull() & F.col("indexed_at").isNotNull())
        .select("path", "content_hash", F.unix_micros(F.col("indexed_at").cast("timestamp")).alias("_seq"), F.unix_micros(F.col("modified_at").cast("timestamp")).alias("_mod"))
    )
    plan = plan_runs(runs)
    if plan:
        # The first gap is open to the past; it starts where the data does.
        low = seen.agg(F.min("_seq")).first()[0]
        low = low if low is not None else plan[0][2]
        gaps = [(i, run_id, max(lo, low), hi, d) for i, (run_id, lo, hi) in enumerate(plan) if hi >= low for d in range(day(max(lo, low)), day(hi) + 1)]
    else:
        gaps = []
    g = spark.createDataFrame(gaps, "_ord int, run_id long, _lo long, _hi long, _day long")
    per_run = (
        seen.withColumn("_day", F.floor(F.col("_seq") / F.lit(MICROS_A_DAY)))
        .join(g, "_day")
        .where(F.col("_seq").between(F.col("_lo"), F.col("_hi")))
        .groupBy("path", "_ord", "run_id")
        .agg(F.max(F.struct("_seq", "_mod", "content_hash")).alias("_top"))
    )
    # Content is a running maximum: a path's later gaps hold later landing times only, so the gap's own maximum decides.
    before = F.lag("_top.content_hash").over(W.partitionBy("path").orderBy("_ord"))
    return per_run.withColumn("_before", before).where(~F.col("_top.content_hash").eqNullSafe(F.col("_before"))).select(F.col("run_id"), "path")
