"""Current state of the tables, for queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.sources import current_files, current_nodes, read

#: The SQL twin of `nodes`, `edges` and `files` below.
N = "n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM nodes) WHERE rn = 1)"
E = "e AS (SELECT DISTINCT source, target, kind, line, col FROM edges)"
F_ = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST, modified_at DESC NULLS LAST) AS rn FROM files) WHERE rn = 1)"


def nodes(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Current nodes with only the columns asked for, so that the shuffle by id moves nothing else."""
    want = list(dict.fromkeys(["id", "updated_at", *cols]))
    return current_nodes(read(spark, d, "nodes").select(*want), want).drop("updated_at")


def files(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    want = list(dict.fromkeys(["path", "indexed_at", "modified_at", *cols]))
    return current_files(read(spark, d, "files").select(*want), want)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges by identity."""
    return read(spark, d, "edges").select("source", "target", "kind", "line", "col").distinct()


def links(spark: SparkSession, d: str) -> DataFrame:
    """Edges for operators that take each step once anyhow, whatever its line: nothing is made distinct before."""
    return read(spark, d, "edges").select("source", "target", "kind")


def picked(c: str = "id"):
    """The stated query set of a search from many starts: one id in a hundred, by its hash, whatever its kind."""
    return F.conv(F.substring(F.md5(F.encode(c, "UTF-8")), 1, 4), 16, 10).cast("int") % 100 == 0


#: The SQL twin of `picked`.
PICKED = "('0x' || substr(md5(id), 1, 4))::INTEGER % 100 = 0"


def named(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(rows, schema)


__all__ = ["E", "F_", "N", "PICKED", "F", "edges", "files", "links", "named", "nodes", "picked"]
