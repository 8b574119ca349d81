"""Queries p1, p4 and p6: incremental runs, hierarchies, skewed keys."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.operators import hierarchy, incremental, skew
from grovespark.session import checkpoint_dir, cut
from grovespark.sources import current_files, distinct_edges, read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    files = read(spark, d, "files").select("path", "content_hash", "modified_at", "indexed_at")
    return incremental.changed_paths(files, read(spark, d, "sync_runs")).select("run_id", "path")


def p1_run_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Paths to process per succeeded run, with those that are new."""
    found = p1_found(spark, d)
    first = found.groupBy("path").agg(F.min("run_id").alias("first_run"))
    return found.join(first, "path").groupBy("run_id").agg(F.count("path").alias("n_paths"), F.count_if(F.col("run_id") == F.col("first_run")).alias("n_new"))


def p1_ledger(spark: SparkSession, d: str) -> DataFrame:
    """(commit_no, n_rows, first_seq, last_seq): observations of files that three runs took from a growing log by their landing
    time. The first sees what landed in the first half of the log, the second fails while it writes, the third sees all."""
    seq = F.unix_micros(F.col("indexed_at").cast("timestamp"))
    log = read(spark, d, "files").select("path", "content_hash", seq.alias("seq"))
    at = log.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    ledger = incremental.Ledger(spark, f"{checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}", width=1 << 36)
    half = log.where(F.col("seq") <= (at.lo + at.hi) // 2) if at.lo is not None else log
    incremental.run_once(half, ledger, "seq", lambda df: df)
    try:
        incremental.run_once(log, ledger, "seq", lambda df: df.withColumn("path", F.raise_error(F.lit("lost"))))
    except Exception:  # noqa: BLE001, S110
        pass
    incremental.run_once(log, ledger, "seq", lambda df: df)
    empty = spark.createDataFrame([], "commit_no int, n_rows long, first_seq long, last_seq long")
    parts = [spark.read.parquet(p).agg(F.lit(k).alias("commit_no"), F.count(F.lit(1)).alias("n_rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")) for k, p in enumerate(ledger.outputs(), 1)]
    return reduce(DataFrame.unionByName, parts, empty)


def _contains(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "edges").where("kind = 'contains'").select("source", "target")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.resolve(_contains(spark, d))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each child with its root, depth and full path of ids, joined by ' > '."""
    r = hierarchy.resolve(_contains(spark, d), path=True)
    return r.select("node", "root", "depth", F.array_join("path", " > ").alias("path"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every descendant of every ancestor with its distance; a child on or below a cycle has ancestor '' and distance -1."""
    return hierarchy.descendants(_contains(spark, d), cyclic=True)


def p4_descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of descendants and height of every ancestor outside cycles."""
    return hierarchy.subtree_sizes(_contains(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_targets(read(spark, d, "edges").select("source", "target", "kind", "line", "col"))


def p6_target_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per target: distinct edges, distinct sources, the commonest kind and quartiles of the line, from weighted values.
    Ids travel packed, a source as two 64-bit hashes; distinct edges are stored once for the three profiles."""
    e = read(spark, d, "edges").select(hierarchy.pack(F.col("target")).alias("target"), F.xxhash64("source").alias("s1"), F.xxhash64(F.lit("second"), "source").alias("s2"), F.col("source").isNull().alias("none"), "kind", "line", "col")
    e = cut(e.distinct())
    src = e.groupBy("target", "s1", "s2", "none").agg(F.count(F.lit(1)).alias("n")).groupBy("target").agg(F.count_if(~F.col("none")).alias("n_sources"), F.sum("n").alias("n_edges"))
    kind = skew.modes(skew.compress(e, "target", "kind")).select(F.col("key").alias("target"), F.col("mode").alias("top_kind"))
    line = skew.percentiles(skew.compress(e, "target", "line"), [0.25, 0.5, 0.75]).select(F.col("key").alias("target"), *[F.col(f"p{q}").alias(f"line_p{q}") for q in (25, 50, 75)])
    out = src.join(kind, src["target"].eqNullSafe(kind["target"]), "left").drop(kind["target"]).join(line, src["target"].eqNullSafe(line["target"]), "left").drop(line["target"])
    return out.select(hierarchy.unpack(F.col("target")).alias("target"), "n_sources", "n_edges", "top_kind", "line_p25", "line_p50", "line_p75")


def p6_repository_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Per repository: current files, distinct node counts, the commonest node count and the median weighted by nodes."""
    cur = current_files(read(spark, d, "files").select("path", "indexed_at", "modified_at", "node_count"), ["path", "indexed_at", "modified_at", "node_count"])
    cur = cur.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("repository"), F.col("node_count").cast("long").alias("node_count"))
    pairs = skew.compress(cur, "repository", "node_count")
    out = skew.distinct_counts(pairs).join(skew.modes(pairs), "key", "left").join(skew.percentiles(pairs, [0.5, 0.9]), "key", "left")
    return out.select(F.col("key").alias("repository"), F.col("n_rows").alias("n_files"), F.col("n_distinct").alias("n_counts"), F.col("mode").alias("top_count"), "p50", "p90")


QUERIES = {f.__name__: f for f in (p1_found, p1_run_sizes, p1_ledger, p4_found, p4_paths, p4_descendants, p4_descendant_counts, p6_found, p6_target_profile, p6_repository_nodes)}

_P1 = """
WITH ok AS (SELECT run_id, started_at, row_number() OVER (ORDER BY started_at, run_id) AS k FROM sync_runs WHERE status = 'succeeded'),
seen AS (SELECT f.path, f.content_hash, f.indexed_at, f.modified_at, (SELECT min(o.k) FROM ok o WHERE o.started_at >= f.indexed_at) AS k
         FROM files f WHERE f.content_hash IS NOT NULL AND f.indexed_at IS NOT NULL),
tops AS (SELECT path, k, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY path, k ORDER BY indexed_at DESC, modified_at DESC, content_hash DESC) AS r FROM seen WHERE k IS NOT NULL) WHERE r = 1),
found AS (SELECT ok.run_id, t.path FROM (SELECT *, lag(content_hash) OVER (PARTITION BY path ORDER BY k) AS before FROM tops) t JOIN ok USING (k) WHERE t.before IS DISTINCT FROM t.content_hash)
"""
_TREE = """
WITH RECURSIVE link AS (SELECT target AS c, min(source) AS p FROM edges WHERE kind = 'contains' GROUP BY target),
down AS (SELECT l.c AS node, l.p AS root, 1 AS depth, l.p || ' > ' || l.c AS path FROM link l WHERE l.p NOT IN (SELECT c FROM link)
         UNION ALL SELECT l.c, d.root, d.depth + 1, d.path || ' > ' || l.c FROM down d JOIN link l ON l.p = d.node)
"""
_EDGE = "SELECT DISTINCT source, target, kind, line, col FROM edges"

SQL = {
    "p1_found": _P1 + "SELECT run_id, path FROM found",
    "p1_run_sizes": _P1 + "SELECT run_id, count(*) AS n_paths, count(*) FILTER (WHERE run_id = first_run) AS n_new FROM (SELECT *, min(run_id) OVER (PARTITION BY path) AS first_run FROM found) GROUP BY run_id",
    "p1_ledger": "WITH s AS (SELECT epoch_us(indexed_at) AS seq FROM files WHERE indexed_at IS NOT NULL), m AS (SELECT (min(seq) + max(seq)) // 2 AS half FROM s) SELECT CAST(CASE WHEN seq <= half THEN 1 ELSE 2 END AS INTEGER) AS commit_no, count(*) AS n_rows, min(seq) AS first_seq, max(seq) AS last_seq FROM s, m GROUP BY 1",
    "p4_found": _TREE + "SELECT l.c AS node, coalesce(d.root, '') AS root, CAST(coalesce(d.depth, -1) AS INTEGER) AS depth FROM link l LEFT JOIN down d ON d.node = l.c",
    "p4_paths": _TREE + "SELECT l.c AS node, coalesce(d.root, '') AS root, CAST(coalesce(d.depth, -1) AS INTEGER) AS depth, d.path FROM link l LEFT JOIN down d ON d.node = l.c",
    "p4_descendants": """
WITH RECURSIVE link AS (SELECT target AS c, min(source) AS p FROM edges WHERE kind = 'contains' GROUP BY target),
good AS (SELECT l.c FROM link l WHERE l.p NOT IN (SELECT c FROM link) UNION ALL SELECT l.c FROM good g JOIN link l ON l.p = g.c),
up AS (SELECT l.p AS ancestor, l.c AS node, 1 AS distance FROM link l JOIN good USING (c) UNION ALL SELECT l.p, u.node, u.distance + 1 FROM up u JOIN link l ON l.c = u.ancestor)
SELECT ancestor, node, distance FROM up UNION ALL SELECT '', c, -1 FROM link WHERE c NOT IN (SELECT c FROM good)""",
    "p4_descendant_counts": """
WITH RECURSIVE link AS (SELECT target AS c, min(source) AS p FROM edges WHERE kind = 'contains' GROUP BY target),
good AS (SELECT l.c FROM link l WHERE l.p NOT IN (SELECT c FROM link) UNION ALL SELECT l.c FROM good g JOIN link l ON l.p = g.c),
up AS (SELECT l.p AS ancestor, l.c AS node, 1 AS distance FROM link l JOIN good USING (c) UNION ALL SELECT l.p, u.node, u.distance + 1 FROM up u JOIN link l ON l.c = u.ancestor)
SELECT ancestor, count(*) AS n_descendants, CAST(max(distance) AS INTEGER) AS height FROM up GROUP BY ancestor""",
    "p6_found": f"WITH e AS ({_EDGE}) SELECT target FROM e WHERE target IS NOT NULL GROUP BY target HAVING count(*) >= 0.01 * (SELECT count(*) FROM e)",
    "p6_target_profile": f"""
WITH e AS ({_EDGE}), k AS (SELECT target, kind, count(*) AS n FROM e GROUP BY ALL),
top AS (SELECT target, kind FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY n DESC, kind) AS r FROM k) WHERE r = 1)
SELECT target, count(DISTINCT source) AS n_sources, count(*) AS n_edges, any_value(top.kind) AS top_kind, quantile_disc(line, 0.25) AS line_p25, quantile_disc(line, 0.5) AS line_p50, quantile_disc(line, 0.75) AS line_p75 FROM e JOIN top USING (target) GROUP BY target""",
    "p6_repository_nodes": """
WITH cur AS (SELECT split_part(path, '/', 1) AS repository, node_count FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST, modified_at DESC NULLS LAST, CAST(node_count AS VARCHAR) DESC NULLS LAST) AS r FROM files) WHERE r = 1),
k AS (SELECT repository, node_count, count(*) AS n FROM cur WHERE node_count IS NOT NULL GROUP BY ALL),
top AS (SELECT repository, node_count AS m FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY n DESC, node_count) AS r FROM k) WHERE r = 1)
SELECT repository, count(*) AS n_files, count(DISTINCT node_count) AS n_counts, CAST(any_value(m) AS BIGINT) AS top_count, CAST(quantile_disc(node_count, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(node_count, 0.9) AS BIGINT) AS p90 FROM cur LEFT JOIN top USING (repository) GROUP BY repository""",
}
