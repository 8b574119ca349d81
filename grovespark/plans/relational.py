"""Relational queries: scans, filters, joins, aggregates, windows, set operations and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovespark.functions import kinds, names, paths
from grovespark.operators import relational as R
from grovespark.plans.common import PICKED, E, F_, N, edges, files, nodes, picked
from grovespark.sources import read

QUERIES: dict = {}
SQL: dict[str, str] = {}
CALLABLE = ["function", "method", "class"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _re(pattern: str) -> str:
    """A pattern as a SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


_LOW = f"(regexp_matches(lower({{0}}), {_re(paths.LOW_VALUE_RE)}) OR regexp_matches({{0}}, {_re(paths.GENERATED_RE)}))"
_TEST = f"(regexp_matches(lower({{0}}), {_re(paths.TEST_FILE_RE)}) OR regexp_matches({{0}}, {_re(paths.TEST_FILE_CASED_RE)}) OR regexp_matches(lower({{0}}), {_re(paths.TEST_DIR_RE)}) OR regexp_matches(lower({{0}}), {_re(paths.SIDE_DIR_RE)}))"
_DIR = "regexp_replace({0}, '/?[^/]*$', '')"


@query(f"WITH {N}, {E}, {F_} SELECT 'node' AS facet, kind AS key, count(*) AS n FROM n GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM e GROUP BY kind UNION ALL SELECT 'file', language, count(*) FROM f GROUP BY language")
def stats_by_kind(s: SparkSession, d: str) -> DataFrame:
    return R.graph_stats(nodes(s, d, "kind"), edges(s, d), files(s, d, "language"))


@query(f"WITH {N}, {E} SELECT 'nodes' AS what, count(*) AS n FROM n UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'refs', count(*) FROM (SELECT DISTINCT * FROM refs)")
def table_counts(s, d):
    one = lambda df, what: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return one(nodes(s, d), "nodes").unionByName(one(edges(s, d), "edges")).unionByName(one(read(s, d, "refs").distinct(), "refs"))


@query("SELECT max(indexed_at) AS last_indexed FROM files")
def last_indexed(s, d):
    return read(s, d, "files").agg(F.max("indexed_at").alias("last_indexed"))


@query(f"WITH {N}, {E} SELECT kind, count(*) AS n FROM e WHERE source IN (SELECT id FROM n) AND target IN (SELECT id FROM n) GROUP BY kind")
def edge_dedup_identity(s, d):
    return R.attached(edges(s, d), nodes(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {N}, {E}, p AS (SELECT a.file_path, count(*) AS edge_count FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE a.file_path = b.file_path GROUP BY 1), top AS (SELECT * FROM p ORDER BY edge_count DESC, file_path LIMIT 20), r AS (SELECT file_path, CAST(edge_count AS BIGINT) AS edge_count, CAST(coalesce(lead(edge_count) OVER (ORDER BY edge_count DESC, file_path), 0) AS BIGINT) AS next_edge_count, row_number() OVER (ORDER BY edge_count DESC, file_path) AS k FROM top WHERE NOT {_LOW.format('file_path')}) SELECT file_path, edge_count, next_edge_count FROM r WHERE k = 1 AND edge_count >= 20")
def dominant_file(s, d):
    return R.dominant_file(nodes(s, d, "file_path"), edges(s, d))


@query(f"WITH {N}, p AS (SELECT file_path, count(*) AS n FROM n WHERE kind = 'interface' GROUP BY 1), t AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM p) SELECT file_path, p.n, total FROM p, t WHERE p.n >= 3 AND p.n >= total * 0.3 ORDER BY p.n DESC, file_path LIMIT 1")
def top_route_file(s, d):
    return R.top_file_of_kind(nodes(s, d, "kind", "file_path"), "interface")


@query(f"WITH {N}, {E}, x AS (SELECT DISTINCT r.name AS url, h.name AS handler, h.file_path AS handler_file, h.start_line AS handler_line, r.file_path AS rf, r.start_line AS rl, e.source, e.target FROM e JOIN n r ON r.id = e.source AND r.kind = 'interface' JOIN n h ON h.id = e.target AND h.kind IN ('function', 'method', 'class') WHERE e.kind IN ('references', 'calls')), t AS (SELECT * FROM x ORDER BY rf, rl, source, target LIMIT 40), k AS (SELECT * FROM t WHERE NOT {_LOW.format('handler_file')}) SELECT url, handler, handler_file, handler_line FROM k WHERE (SELECT count(*) FROM k) >= 3")
def routing_manifest(s, d):
    return R.routing(nodes(s, d, "kind", "name", "file_path", "start_line"), edges(s, d), "interface")


@query(f"WITH {F_} SELECT {_DIR.format('path')} AS directory, count(*) AS n_files, min(path) AS first_file, max(path) AS last_file FROM f GROUP BY 1")
def module_structure(s, d):
    return R.module_structure(files(s, d))


@query(f"WITH {F_}, x AS (SELECT path, size, string_split(path, '/') AS p FROM f), u AS (SELECT array_to_string(p[1:i], '/') AS directory, size FROM (SELECT p, size, unnest(range(1, greatest(len(p), 2))) AS i FROM x)) SELECT directory, count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS total FROM u GROUP BY 1")
def directory_totals(s, d):
    return R.directory_totals(files(s, d, "size"), "size")


@query(f"WITH {N}, {E}, i AS (SELECT target AS id, count(*) AS n_in, count(*) FILTER (WHERE kind = 'calls') AS n_callers FROM e GROUP BY 1), o AS (SELECT source AS id, count(*) AS n_out, count(*) FILTER (WHERE kind = 'calls') AS n_calls, count(*) FILTER (WHERE kind = 'contains') AS n_children FROM e GROUP BY 1) SELECT n.id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(n_calls, 0) AS n_calls, coalesce(n_callers, 0) AS n_callers, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN i USING (id) LEFT JOIN o USING (id)")
def node_metrics(s, d):
    return R.node_metrics(nodes(s, d), edges(s, d))


_XF = "x AS (SELECT a.file_path AS source_file, b.file_path AS target_file, count(*) AS n FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE e.kind <> 'contains' AND a.file_path <> b.file_path GROUP BY 1, 2)"


@query(f"WITH {N}, {E}, {_XF} SELECT source_file, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_edges FROM x GROUP BY 1")
def file_dependencies(s, d):
    return R.cross_file(edges(s, d), nodes(s, d, "file_path")).groupBy("source_file").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_edges"))


@query(f"WITH {N}, {E}, {_XF} SELECT target_file, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_edges FROM x GROUP BY 1")
def file_dependents(s, d):
    return R.cross_file(edges(s, d), nodes(s, d, "file_path")).groupBy("target_file").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_edges"))


@query(f"WITH {N}, {E}, {_XF} SELECT * FROM x")
def file_dependency_pairs(s, d):
    return R.cross_file(edges(s, d), nodes(s, d, "file_path"))


@query(f"WITH {N}, {E} SELECT e.target, t.name AS target_name, t.kind AS target_kind, count(*) AS n FROM e JOIN n a ON a.id = e.source JOIN n t ON t.id = e.target WHERE e.kind <> 'contains' AND a.file_path <> t.file_path GROUP BY ALL")
def cross_file_incoming(s, d):
    n = nodes(s, d, "file_path", "name", "kind")
    e = edges(s, d).where("kind <> 'contains'").join(n.select(F.col("id").alias("source"), F.col("file_path").alias("_f")), "source").groupBy("target", "_f").agg(F.count(F.lit(1)).alias("_n"))
    t = n.select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind"), "file_path")
    return e.join(t, "target").where("_f <> file_path").groupBy("target", "target_name", "target_kind").agg(F.sum("_n").alias("n"))


@query(f"WITH {N}, {E} SELECT id, kind, name FROM n WHERE kind IN ('function', 'method', 'class') AND NOT coalesce(is_exported, false) AND id NOT IN (SELECT target FROM e WHERE kind <> 'contains')")
def dead_code(s, d):
    return R.dead_code(nodes(s, d, "kind", "name", "is_exported"), edges(s, d), CALLABLE).select("id", "kind", "name")


@query(f"WITH {N} SELECT file_path, count(*) AS n_exported, min(name) AS first_name FROM n WHERE is_exported GROUP BY 1")
def exported_symbols(s, d):
    return nodes(s, d, "file_path", "name", "is_exported").where("is_exported").groupBy("file_path").agg(F.count(F.lit(1)).alias("n_exported"), F.min("name").alias("first_name"))


@query(f"WITH {N}, {E}, k AS (SELECT id FROM n WHERE kind IN ('class', 'interface', 'enum', 'type_alias')) SELECT e.* FROM e WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)")
def induced_subgraph(s, d):
    return R.induced(edges(s, d), nodes(s, d, "kind").where(F.col("kind").isin("class", "interface", "enum", "type_alias")))


@query(f"WITH {N}, {E}, k AS (SELECT id FROM n WHERE file_path = 'corekit/src' OR starts_with(file_path, 'corekit/src/') ORDER BY kind, name, id LIMIT 500) SELECT e.source, e.target, e.kind FROM e WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k)")
def directory_subgraph(s, d):
    k = nodes(s, d, "kind", "name", "file_path").where((F.col("file_path") == "corekit/src") | F.col("file_path").startswith("corekit/src/")).orderBy("kind", "name", "id").limit(500)
    return R.induced(edges(s, d), k).select("source", "target", "kind")


@query(f"WITH {N} SELECT id, qualified_name FROM n WHERE kind IN ('class', 'function', 'method', 'interface', 'type_alias', 'variable', 'constant') AND regexp_full_match(qualified_name, '.*::find[^/]*')")
def qualified_glob(s, d):
    return nodes(s, d, "kind", "qualified_name").where(F.col("kind").isin("class", "function", "method", "interface", "type_alias", "variable", "constant") & F.col("qualified_name").rlike(paths.glob_regex("**::find*"))).select("id", "qualified_name")


@query(f"WITH {N}, {E} SELECT t.name, e.kind AS edge_kind, count(*) AS n, count(DISTINCT e.source) AS n_sources FROM n t JOIN e ON e.target = t.id JOIN n s ON s.id = e.source GROUP BY 1, 2")
def find_usages(s, d):
    n = nodes(s, d, "kind", "name")
    e = edges(s, d).join(n.select(F.col("id").alias("source")), "source", "left_semi").groupBy("target", F.col("kind").alias("edge_kind"), "source").agg(F.count(F.lit(1)).alias("n"))
    e = e.join(n.select(F.col("id").alias("target"), "name"), "target").groupBy("name", "edge_kind", "source").agg(F.sum("n").alias("n"))
    return e.groupBy("name", "edge_kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_sources"))


@query(f"WITH {N}, {E} SELECT e.source AS id, c.kind, count(*) AS n_children, min(c.name) AS first_child FROM e JOIN n c ON c.id = e.target WHERE e.kind = 'contains' GROUP BY 1, 2")
def children(s, d):
    c = nodes(s, d, "kind", "name").select(F.col("id").alias("target"), F.col("kind").alias("child_kind"), "name")
    return edges(s, d).where("kind = 'contains'").join(c, "target").groupBy(F.col("source").alias("id"), F.col("child_kind").alias("kind")).agg(F.count(F.lit(1)).alias("n_children"), F.min("name").alias("first_child"))


@query(f"""WITH {N}, {E}, k AS (SELECT id FROM n WHERE {PICKED}), u AS (SELECT source AS id, target AS other, kind, true AS out FROM e WHERE source IN (SELECT id FROM k) UNION ALL SELECT target, source, kind, false FROM e WHERE target IN (SELECT id FROM k))
SELECT k.id, count(*) FILTER (WHERE NOT out AND u.kind <> 'contains') AS n_incoming, count(*) FILTER (WHERE out AND u.kind <> 'contains') AS n_outgoing,
coalesce(string_agg(DISTINCT n.name, ',' ORDER BY n.name) FILTER (WHERE out AND u.kind = 'contains'), '') AS children, coalesce(string_agg(DISTINCT n.name, ',' ORDER BY n.name) FILTER (WHERE out AND u.kind IN ('extends', 'implements', 'type_of', 'returns')), '') AS types,
coalesce(string_agg(DISTINCT n.name, ',' ORDER BY n.name) FILTER (WHERE out AND u.kind = 'imports'), '') AS imports FROM k LEFT JOIN u ON u.id = k.id LEFT JOIN n ON n.id = u.other GROUP BY k.id""")
def symbol_context(s, d):
    n = nodes(s, d, "kind", "name")
    return R.symbol_context(n.where(picked()).select("id"), n, edges(s, d))


@query(f"WITH {E}, p AS (SELECT *, count(*) OVER () AS total FROM e WHERE kind = 'decorates') SELECT source, target, line, total FROM p ORDER BY source, target, line NULLS FIRST, col NULLS FIRST LIMIT 100 OFFSET 50")
def edge_page(s, d):
    e = edges(s, d).where("kind = 'decorates'")
    total = e.agg(F.count(F.lit(1)).alias("n"))
    page = e.orderBy("source", "target", F.asc_nulls_first("line"), F.asc_nulls_first("col")).offset(50).limit(100)
    return page.select("source", "target", "line", total.scalar().alias("total"))


@query(f"WITH {N} SELECT id, name FROM n WHERE starts_with(name, 'build') ORDER BY name, id LIMIT 20")
def name_prefix(s, d):
    return nodes(s, d, "name").where(F.col("name").startswith("build")).orderBy("name", "id").limit(20)


@query(f"WITH {N} SELECT id, name FROM n WHERE lower(name) = 'logdebug'")
def name_ignoring_case(s, d):
    return nodes(s, d, "name").where(F.lower("name") == "logdebug")


@query(f"WITH {N} SELECT id, kind, start_line FROM n WHERE file_path = 'corekit/src/runtime/log.ts' ORDER BY start_line, id")
def nodes_of_file(s, d):
    return nodes(s, d, "kind", "start_line", "file_path").where("file_path = 'corekit/src/runtime/log.ts'").orderBy("start_line", "id").select("id", "kind", "start_line")


@query(f"WITH {N} SELECT id, name FROM n WHERE id IN (SELECT from_node_id FROM refs)")
def nodes_by_ids(s, d):
    ids = read(s, d, "refs").select(F.col("from_node_id").alias("id")).distinct()
    return nodes(s, d, "name").join(ids, "id", "left_semi")


@query(f"WITH {N} SELECT id, name FROM n WHERE qualified_name = 'corekit/src/di/container.ts::Container'")
def qualified_exact(s, d):
    return nodes(s, d, "name", "qualified_name").where("qualified_name = 'corekit/src/di/container.ts::Container'").select("id", "name")


@query(f"WITH {N} SELECT DISTINCT name FROM n WHERE kind NOT IN ('file', 'import')")
def distinct_names(s, d):
    return nodes(s, d, "kind", "name").where(~F.col("kind").isin("file", "import")).select("name").distinct()


@query(f"WITH {N} SELECT id, name, kind, language FROM n WHERE kind IN ('function', 'method') AND language IN ('go', 'rust') ORDER BY name, id LIMIT 50")
def filter_only_search(s, d):
    q = names.parse_query("kind:function kind:method lang:go language:rust")
    return nodes(s, d, "name", "kind", "language").where(F.col("kind").isin(q["kind"]) & F.col("language").isin(q["language"])).orderBy("name", "id").limit(50)


@query(f"WITH {F_} SELECT path, language FROM f WHERE NOT {_TEST.format('path')} AND {_LOW.format('path')}")
def low_value_files(s, d):
    p = F.col("path")
    return files(s, d, "language").where(~paths.is_test(p) & paths.is_low_value(p)).select("path", "language")


@query(f"WITH {F_} SELECT language, count(*) AS n_files, CAST(sum(CASE WHEN {_TEST.format('path')} THEN 1 ELSE 0 END) AS BIGINT) AS n_tests FROM f GROUP BY 1")
def test_files(s, d):
    return files(s, d, "language").groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(paths.is_test(F.col("path"))).alias("n_tests"))


@query("WITH o AS (SELECT path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, modified_at DESC) AS r FROM files WHERE content_hash IS NOT NULL AND indexed_at IS NOT NULL AND indexed_at <= TIMESTAMP '2025-04-01') WHERE r = 1), c AS (SELECT path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, modified_at DESC) AS r FROM files WHERE content_hash IS NOT NULL AND indexed_at IS NOT NULL) WHERE r = 1) SELECT path, CASE WHEN o.path IS NULL THEN 'added' ELSE 'modified' END AS state FROM c LEFT JOIN o USING (path) WHERE o.content_hash IS DISTINCT FROM c.content_hash")
def stale_files(s, d):
    f = read(s, d, "files").where("content_hash is not null and indexed_at is not null").select("path", "content_hash", "indexed_at", "modified_at")
    top = lambda df: df.groupBy("path").agg(F.max_by("content_hash", F.struct("indexed_at", "modified_at")).alias("h"))
    o = top(f.where("indexed_at <= timestamp_ntz'2025-04-01 00:00:00'")).withColumnRenamed("h", "o")
    return top(f).join(o, "path", "left").where(~F.col("h").eqNullSafe(F.col("o"))).select("path", F.when(F.col("o").isNull(), "added").otherwise("modified").alias("state"))


@query(f"WITH {F_} SELECT language, count(*) AS n FROM (SELECT DISTINCT r.* FROM refs r JOIN f ON f.path = r.file_path WHERE f.language = r.language) GROUP BY 1")
def refs_of_files(s, d):
    return read(s, d, "refs").distinct().join(files(s, d, "language").select(F.col("path").alias("file_path"), "language"), ["file_path", "language"], "left_semi").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {N}, old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at) AS rn FROM nodes) WHERE rn = 1) SELECT n.id, n.name, n.docstring, CASE WHEN old.updated_at < n.updated_at THEN 'replaced' ELSE 'kept' END AS state FROM n JOIN old USING (id)")
def upsert_nodes(s, d):
    cols = ["id", "name", "docstring", "updated_at"]
    raw = read(s, d, "nodes").select(*cols)
    old = raw.groupBy("id").agg(F.min_by(F.struct("name", "docstring", "updated_at"), "updated_at").alias("r")).select("id", "r.*")
    new = nodes(s, d, "name", "docstring", "updated_at").join(raw.groupBy("id").agg(F.max("updated_at").alias("updated_at")), "id")
    merged = R.upsert(old, new.select(*cols), ["id"])
    return merged.join(old.select("id", F.col("updated_at").alias("_o")), "id").select("id", "name", "docstring", F.when(F.col("_o") < F.col("updated_at"), "replaced").otherwise("kept").alias("state"))


@query(f"WITH {N}, {E}, k AS (SELECT id FROM n WHERE NOT {_LOW.format('file_path')}) SELECT kind, count(*) AS n FROM e WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k) GROUP BY 1")
def delete_files_cascade(s, d):
    n = nodes(s, d, "file_path")
    gone = n.where(paths.is_low_value(F.col("file_path"))).select("file_path").distinct()
    return R.attached(edges(s, d), R.without(n, gone, ["file_path"])).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {N} SELECT count(*) AS n FROM (SELECT DISTINCT from_node_id, reference_name, reference_kind FROM refs r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.name = r.reference_name))")
def unresolved_left(s, d):
    r = read(s, d, "refs").select("from_node_id", "reference_name", "reference_kind").distinct()
    known = nodes(s, d, "name").select(F.col("name").alias("reference_name"))
    return R.without(r, known, ["reference_name"]).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {N}, r AS (SELECT DISTINCT * FROM refs), j AS (SELECT r.from_node_id, r.reference_name, r.reference_kind, r.line, r.col, r.file_path, n.id, row_number() OVER (PARTITION BY r.from_node_id, r.reference_name, r.reference_kind, r.line, r.col, r.file_path ORDER BY n.end_line - n.start_line, n.start_line DESC, n.id) AS k FROM r JOIN n ON n.file_path = r.file_path AND r.line BETWEEN n.start_line AND n.end_line AND n.kind IN ('function', 'method', 'class')) SELECT from_node_id, reference_name, reference_kind, line, col, file_path, id AS range_id FROM j WHERE k = 1")
def interval_enclosing(s, d):
    keep = ["from_node_id", "reference_name", "reference_kind", "line", "col", "file_path"]
    points = read(s, d, "refs").select(*keep).distinct()
    ranges = nodes(s, d, "kind", "file_path", "start_line", "end_line").where(F.col("kind").isin(CALLABLE))
    return R.enclosing(points, ranges, keep)


#: The folder of a package: below the repository, with or without a folder of packages.
PACKAGE_RE = r"^([^/]+/(?:(?:libs|packages|services|modules)/)?[^/]+)/"


@query(f"""WITH {N}, {F_}, m AS (SELECT DISTINCT regexp_extract(path, {_re(PACKAGE_RE)}, 1) AS folder FROM f WHERE regexp_matches(path, {_re(PACKAGE_RE)}) UNION SELECT DISTINCT split_part(path, '/', 1) FROM f),
a AS (SELECT n.id, max_by(m.folder, length(m.folder)) AS folder FROM n JOIN m ON starts_with(n.file_path, m.folder || '/') GROUP BY 1) SELECT coalesce(folder, '') AS folder, count(*) AS n_nodes FROM n LEFT JOIN a USING (id) GROUP BY 1""")
def prefix_assign(s, d):
    p = files(s, d).select("path")
    folders = p.select(F.regexp_extract("path", PACKAGE_RE, 1).alias("folder")).where("folder <> ''").unionByName(p.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")))
    return R.longest_prefix(nodes(s, d, "file_path"), "file_path", folders).groupBy(F.coalesce("folder", F.lit("")).alias("folder")).agg(F.count(F.lit(1)).alias("n_nodes"))


@query(f"WITH {N}, {E}, c AS (SELECT target AS id, count(*) AS n_in FROM e WHERE kind <> 'contains' GROUP BY 1), r AS (SELECT n.id, n.file_path, n_in, row_number() OVER (PARTITION BY n.file_path ORDER BY n_in DESC, n.id) AS k FROM n JOIN c USING (id)) SELECT id, file_path, n_in FROM r WHERE k <= 3")
def diversity_cap(s, d):
    c = edges(s, d).where("kind <> 'contains'").groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n_in"))
    return R.capped(nodes(s, d, "file_path").join(c, "id"), "file_path", [F.desc("n_in"), F.asc("id")], 3).select("id", "file_path", "n_in")


@query(f"WITH {N}, k AS (SELECT id, file_path, start_line, end_line FROM n WHERE kind IN ('function', 'method')), w AS (SELECT *, max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM k), c AS (SELECT *, sum(CASE WHEN far IS NULL OR start_line > far + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY start_line, end_line, id) AS g FROM w) SELECT file_path, min(start_line) AS first_line, max(end_line) AS last_line, count(*) AS n FROM c GROUP BY file_path, g")
def line_clusters(s, d):
    return R.line_clusters(nodes(s, d, "kind", "file_path", "start_line", "end_line").where(F.col("kind").isin("function", "method")), 3)


@query(f"WITH {N}, k AS (SELECT id, file_path, start_line, end_line FROM n WHERE kind IN ('class', 'function', 'method')), w AS (SELECT *, max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM k) SELECT id, file_path FROM w WHERE far IS NULL OR start_line > far")
def outermost_ranges(s, d):
    return R.outermost(nodes(s, d, "kind", "file_path", "start_line", "end_line").where(F.col("kind").isin(CALLABLE))).select("id", "file_path")


@query(f"""WITH RECURSIVE {N}, k AS (SELECT id, file_path, end_line - start_line + 1 AS lines, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS i FROM n WHERE kind IN ('function', 'method')),
w AS (SELECT id, file_path, lines, i, lines AS used, true AS kept FROM k WHERE i = 1 UNION ALL SELECT k.id, k.file_path, k.lines, k.i, w.used + CASE WHEN w.used + k.lines <= 100 THEN k.lines ELSE 0 END, w.used + k.lines <= 100 FROM w JOIN k ON k.file_path = w.file_path AND k.i = w.i + 1) SELECT id, file_path, lines FROM w WHERE kept""")
def budgeted_selection(s, d):
    k = nodes(s, d, "kind", "file_path", "start_line", "end_line").where(F.col("kind").isin("function", "method"))
    k = k.select("id", "file_path", F.format_string("%09d:%s", "start_line", "id").alias("place"), (F.col("end_line") - F.col("start_line") + 1).alias("lines"))
    return R.within_budget(k, "file_path", "place", "lines", 100).select("id", "file_path", "lines")


@query(f"WITH {N}, r AS (SELECT name, file_path, row_number() OVER (PARTITION BY name ORDER BY file_path, start_line, id) AS k FROM n WHERE kind <> 'file') SELECT name, file_path FROM r WHERE k = 1")
def first_definition(s, d):
    n = nodes(s, d, "kind", "name", "file_path", "start_line").where("kind <> 'file'")
    return n.groupBy("name").agg(F.min(F.struct("file_path", "start_line", "id")).alias("t")).select("name", "t.file_path")


@query(f"WITH {N}, {E}, x AS (SELECT a.language, a.name FROM e JOIN n a ON a.id = e.source WHERE e.kind = 'calls'), y AS (SELECT a.language, a.name FROM e JOIN n a ON a.id = e.target WHERE e.kind = 'calls'), p AS (SELECT DISTINCT language || ':' || name AS key FROM x), q AS (SELECT DISTINCT language || ':' || name AS key FROM y) SELECT coalesce(p.key, q.key) AS key, CASE WHEN p.key IS NULL THEN 'extra' WHEN q.key IS NULL THEN 'missing' ELSE 'matched' END AS state FROM p FULL JOIN q ON p.key = q.key")
def coverage_diff(s, d):
    n = nodes(s, d, "language", "name").select("id", F.concat_ws(":", "language", "name").alias("key"))
    e = edges(s, d).where("kind = 'calls'")
    end = lambda c: e.select(F.col(c).alias("id")).distinct().join(n, "id")
    return R.set_difference(end("source"), end("target"), "key")


@query(f"WITH {E}, m AS (SELECT source, target, min(kind) AS kind, max(score) AS score FROM (SELECT source, target, kind, CASE kind WHEN 'calls' THEN 3 WHEN 'references' THEN 2 ELSE 1 END AS score FROM e WHERE kind <> 'contains') GROUP BY 1, 2) SELECT score, count(*) AS n FROM m GROUP BY 1")
def channel_union(s, d):
    e = edges(s, d).where("kind <> 'contains'")
    part = lambda kind, score: (e.where(kind).select("source", "target", F.lit(score).alias("score")))
    u = part("kind = 'calls'", 3).unionByName(part("kind = 'references'", 2)).unionByName(part("kind not in ('calls', 'references')", 1))
    return u.groupBy("source", "target").agg(F.max("score").alias("score")).groupBy("score").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {N}, {E}, t AS (SELECT file_path, name, id FROM n), c AS (SELECT e.target, count(DISTINCT e.source) AS n_callers, count(DISTINCT s.file_path) FILTER (WHERE {_TEST.format('s.file_path')}) AS n_test_files, count(DISTINCT s.file_path) FILTER (WHERE NOT {_TEST.format('s.file_path')}) AS n_other_files FROM e JOIN n s ON s.id = e.source WHERE e.kind IN ('calls', 'references', 'imports', 'instantiates') GROUP BY 1) SELECT n.id, n_callers, n_test_files, n_other_files FROM c JOIN n ON n.id = c.target WHERE n.kind IN ('function', 'method', 'class')")
def blast_radius(s, d):
    """Callers and calling files of every callable, tests apart. Callers are distinct by edge ends first, files by the pair
    of target and file, so that a hot target's callers are spread and combined before they meet."""
    n = nodes(s, d, "kind", "file_path")
    pairs = edges(s, d).where(F.col("kind").isin(R.REFERRING)).select("source", "target").distinct()
    per = pairs.join(n.select(F.col("id").alias("source"), "file_path"), "source").groupBy("target", "file_path").agg(F.count(F.lit(1)).alias("n"))
    test = paths.is_test(F.col("file_path"))
    got = per.groupBy("target").agg(F.sum("n").alias("n_callers"), F.count_if(test).alias("n_test_files"), F.count_if(~test).alias("n_other_files"))
    return n.where(F.col("kind").isin(CALLABLE)).select("id").join(got.withColumnRenamed("target", "id"), "id")


@query(f"WITH {F_} SELECT language, count(*) AS n_files, CAST(sum(coalesce(node_count, 0)) AS BIGINT) AS n_nodes, max(node_count) AS largest FROM f GROUP BY 1")
def files_grouped(s, d):
    return files(s, d, "language", "node_count").groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.coalesce("node_count", F.lit(0))).alias("n_nodes"), F.max("node_count").alias("largest"))


@query(f"WITH {N}, g AS (SELECT name, count(*) AS n_definitions, count(DISTINCT file_path) AS n_files, count(DISTINCT language) AS n_languages FROM n WHERE kind NOT IN ('file', 'import') GROUP BY 1) SELECT * FROM g WHERE n_definitions > 1")
def same_name_groups(s, d):
    g = nodes(s, d, "kind", "name", "file_path", "language").where(~F.col("kind").isin("file", "import")).groupBy("name")
    return g.agg(F.count(F.lit(1)).alias("n_definitions"), F.count_distinct("file_path").alias("n_files"), F.count_distinct("language").alias("n_languages")).where("n_definitions > 1")


@query("""WITH m AS (SELECT DISTINCT source, target, kind, line, col, CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.synthesizedBy') END AS tag, CASE WHEN json_valid(metadata) THEN TRY_CAST(json_extract_string(metadata, '$.confidence') AS DOUBLE) END AS confidence FROM edges WHERE metadata IS NOT NULL)
SELECT coalesce(tag, '') AS tag, kind, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM m GROUP BY 1, 2""")
def synthesized_edges(s, d):
    """Heuristic edges by tag; broken JSON counts as no tag."""
    m = read(s, d, "edges").where("metadata is not null").withColumn("j", F.try_parse_json("metadata"))
    m = m.select("source", "target", "kind", "line", "col", F.try_variant_get("j", "$.synthesizedBy", "string").alias("tag"), F.try_variant_get("j", "$.confidence", "double").alias("confidence")).distinct()
    return m.groupBy(F.coalesce("tag", F.lit("")).alias("tag"), "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query(f"WITH {N} SELECT kind, count(*) AS n, CAST(sum(CASE WHEN id = kind || ':' || substr(sha256(file_path || ':' || kind || ':' || name || ':' || start_line), 1, 32) THEN 1 ELSE 0 END) AS BIGINT) AS n_derived FROM n GROUP BY 1")
def id_derivation(s, d):
    own = names.node_id(F.col("kind"), F.col("file_path"), F.col("name"), F.col("start_line").cast("string"))
    return nodes(s, d, "kind", "file_path", "name", "start_line").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") == own).alias("n_derived"))


_KB = " ".join(f"WHEN '{k}' THEN {v}" for k, v in kinds.KIND_BONUS.items())


@query(f"WITH {N}, b AS (SELECT id, CASE kind {_KB} ELSE 0 END AS bonus, row_number() OVER (PARTITION BY file_path ORDER BY CASE kind {_KB} ELSE 0 END DESC, start_line, id) AS k FROM n) SELECT id, bonus FROM b WHERE k = 1")
def file_head_symbol(s, d):
    n = nodes(s, d, "kind", "file_path", "start_line").withColumn("bonus", kinds.kind_bonus(F.col("kind")))
    return n.withColumn("k", F.row_number().over(W.partitionBy("file_path").orderBy(F.desc("bonus"), "start_line", "id"))).where("k = 1").select("id", "bonus")
