"""Per-key results when a few keys hold most rows: value-frequency compression.

Rows are first counted by (key, value), which spreads a hot key over as many groups as it has values and is combined
before the shuffle; the per-key step then sees each distinct value once, with its weight. Distinct counts, modes and
percentiles come out exact from the weighted values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovespark.session import cut


def compress(df: DataFrame, key: str, value: str | Column, weight: Column | None = None) -> DataFrame:
    """(key, value, n): each distinct pair with its number of rows, or the sum of `weight`. Null keys and null values are
    values of their own; a null weight adds nothing."""
    v = F.col(value) if isinstance(value, str) else value
    n = F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))
    return df.groupBy(F.col(key).alias("key"), v.alias("value")).agg(n.alias("n"))


def distinct_counts(pairs: DataFrame) -> DataFrame:
    """(key, n_distinct, n_rows) from compressed pairs; a null value is not counted as distinct."""
    return pairs.groupBy("key").agg(F.count("value").alias("n_distinct"), F.sum("n").alias("n_rows"))


def modes(pairs: DataFrame) -> DataFrame:
    """(key, mode, mode_rows): the heaviest non-null value, the least of those that tie; keys without one are left out."""
    p = pairs.where(F.col("value").isNotNull())
    top = F.min_by(F.struct("value", "n"), F.struct((-F.col("n")).alias("w"), F.col("value").alias("v")))
    return p.groupBy("key").agg(top.alias("t")).select("key", F.col("t.value").alias("mode"), F.col("t.n").alias("mode_rows"))


def percentiles(pairs: DataFrame, at: list[float]) -> DataFrame:
    """(key, p<percent>...): the least non-null value whose cumulative weight reaches `at` of the key's rows.

    Pairs are cut into ranges of (key, value) by sampled quantiles, so a key with a great many values is spread over
    ranges of equal size wherever its values lie. Each range sums up its keys' weights; the sums before a range are added
    over the ranges of a key, of which there are no more than ranges in all; a window then runs over one range of a key.
    Any ordered type serves. Keys without non-null values are left out; a null key is a key.
    """
    p = pairs.where(F.col("value").isNotNull())
    ranges = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = cut(p.repartitionByRange(ranges, "key", "value").withColumn("_part", F.spark_partition_id()))
    w = W.partitionBy("key")
    parts = p.groupBy("key", "_part").agg(F.sum("n").alias("_w"))
    parts = parts.select(F.col("key").alias("_k"), F.col("_part").alias("_q"), (F.sum("_w").over(w.orderBy("_part")) - F.col("_w")).alias("_before"), F.sum("_w").over(w).alias("_n"))
    p = p.join(parts, (F.col("_part") == F.col("_q")) & F.col("key").eqNullSafe(F.col("_k")))
    p = p.withColumn("_run", F.col("_before") + F.sum("n").over(W.partitionBy("key", "_part").orderBy("value")))
    return p.groupBy("key").agg(*[F.min(F.when(F.col("_run") >= F.ceil(F.col("_n") * q), F.col("value"))).alias(f"p{round(q * 100)}") for q in at])


def heavy_targets(edges: DataFrame, share: float = 0.01, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(target): targets with at least `share` of the distinct edges, by identity (source, target, kind, line, col).

    Key and value travel as hashes: the target as 64 bits and the identity as two independent 64-bit hashes, so that a
    row shuffles in 24 bytes instead of two ids and more. Two of 10^12 edges agree in both hashes with a chance under
    10^-14. The hashes of heavy targets (at most 1/share of them, whatever the table's size) are then turned back into
    ids. Where several targets share a heavy hash, their own distinct edges are counted and decide.

    Null equals null in every part of the identity; rows with a null target count towards the total, yet null is no
    target. An empty table gives no rows.
    """
    ids = ["source", "target", "kind", "line", "col"]
    marks = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ids]
    h = edges.select("target", hashed(F.col("target")).alias("key"), F.xxhash64(*marks).alias("v1"), F.xxhash64(F.lit("second"), *reversed(marks)).alias("v2"))
    pairs = h.groupBy("key", "v1", "v2").agg(F.count(F.lit(1)).alias("n"))
    per_key = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = per_key.agg(F.sum("n").alias("total"))
    least = F.lit(share) * total.scalar()
    bound = F.broadcast(cut(per_key.where(F.col("n") >= least).select("key")))  # no more than 1/share keys can hold that share
    back = h.where(F.col("target").isNotNull()).join(bound, "key", "left_semi")
    names = back.groupBy("key").agg(F.min("target").alias("target"), F.max("target").alias("other"))
    clash = F.broadcast(names.where("target <> other").select("key"))
    each = back.join(clash, "key", "left_semi").select("target", "v1", "v2").distinct().groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return names.where("target = other").select("target").unionByName(each.where(F.col("n") >= least).select("target"))
