"""Parquet tables of the code graph and the "current row" rules of its upsert logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of a data folder; columns and filters are pruned at the scan by whoever uses it."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The row of each key that is greatest by `order` (nulls are least), by a max_by that is combined before the shuffle. As
    rows are structs, the aggregation sorts each task's rows by key before and after the shuffle; what travels is one row
    a key and task.

    Rows that tie in `order` are told apart by all their other columns, so a repeated run gives the same row.
    """
    rank = F.struct(*[F.col(c) for c in order], *[F.col(c).cast("string").alias(f"_t_{c}") for c in columns if c not in keys + order])
    picked = F.max_by(F.struct(*[F.col(c) for c in columns if c not in keys]), rank)
    out = df.groupBy(*keys).agg(picked.alias("_r"))
    return out.select(*keys, "_r.*")


def current_files(files: DataFrame, columns: list[str]) -> DataFrame:
    """The current row of each path: greatest (indexed_at, modified_at); a row without landing time is older than any with one.

    An empty table gives no rows; a null path is no path and is dropped.
    """
    return latest(files.where(F.col("path").isNotNull()), ["path"], ["indexed_at", "modified_at"], columns)


def current_nodes(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """The current row of each node id: greatest updated_at."""
    return latest(nodes.where(F.col("id").isNotNull()), ["id"], ["updated_at"], columns)


def clean_path(path: str | Column) -> Column:
    """One spelling of a path: forward slashes, no leading './'."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.translate(p, "\\", "/"), r"^(\./)+", "")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Edges by identity (source, target, kind, line, col), null positions equal to each other; the metadata that sorts
    first among the repeats is kept, so that the outcome does not depend on row order."""
    keys = ["source", "target", "kind", "line", "col"]
    rest = [c for c in edges.columns if c not in keys]
    out = edges.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")) if rest else edges.select(*keys).distinct()
    return out.select(*keys, "_r.*") if rest else out


def spread(df: DataFrame) -> DataFrame:
    """The same rows over at least as many partitions as there are cores, for steps that cost far more than moving a row.
    Inputs that are already cut finely enough are left as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
