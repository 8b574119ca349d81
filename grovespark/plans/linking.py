"""Linking, planning and snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovespark.functions import builtins as B
from grovespark.functions import kinds
from grovespark.operators import calls as C
from grovespark.operators import linking as L
from grovespark.operators import planning as P
from grovespark.plans.common import E, F_, N, edges, files, nodes
from grovespark.plans.graph import _ML, _PKG, _XF, module_links, package
from grovespark.sources import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_COLS = ("kind", "name", "qualified_name", "file_path", "language", "is_exported", "start_line")
_FAM = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in kinds.LANGUAGE_FAMILY.items()) + " END"
_A, _B = _FAM.format("r.language"), _FAM.format("c.language")
_SAME = f"coalesce(r.language = c.language OR {_A} = {_B}, false)"
_CROSS = f"coalesce({_A} <> {_B} AND r.language <> c.language, false)"
_CAND = f"""r AS (SELECT DISTINCT * FROM refs), few AS (SELECT name FROM n WHERE kind NOT IN ('file', 'import') GROUP BY 1 HAVING count(*) <= 500),
j AS (SELECT r.*, c.id, c.kind, c.file_path AS c_file, c.language AS c_language, c.is_exported, c.start_line FROM r JOIN n c ON c.name = r.reference_name AND c.kind NOT IN ('file', 'import') JOIN few ON few.name = c.name WHERE c.id <> r.from_node_id AND CASE WHEN r.reference_kind IN ('references', 'function_ref') THEN {_SAME} WHEN r.reference_kind = 'imports' THEN NOT {_CROSS} ELSE true END)"""
_REFC = "from_node_id, reference_name, reference_kind, line, col, file_path, language"


def _dirs(p):
    return f"string_split({p}, '/')[1:-2]"


_PROX = f"least(80, 15 * coalesce(list_position(list_transform(range(1, greatest(len({_dirs('file_path')}), len({_dirs('c_file')})) + 1), lambda i: {_dirs('file_path')}[i] IS NOT DISTINCT FROM {_dirs('c_file')}[i]), false) - 1, greatest(len({_dirs('file_path')}), len({_dirs('c_file')}))))"
_SCORE = f"""s AS (SELECT *, CASE WHEN c_file = file_path THEN 100 ELSE 0 END + {_PROX} + CASE WHEN c_language = language THEN 50 ELSE -80 END + CASE WHEN reference_kind = 'calls' AND kind IN ('function', 'method') THEN 25 WHEN reference_kind = 'instantiates' AND kind IN ('class', 'struct', 'interface') THEN 25 WHEN reference_kind = 'decorates' AND kind IN ('function', 'method') THEN 25 WHEN reference_kind = 'decorates' AND kind IN ('class', 'interface') THEN 15 ELSE 0 END + CASE WHEN coalesce(is_exported, false) THEN 10 ELSE 0 END
+ CASE WHEN c_file = file_path THEN greatest(0::DOUBLE, 20 - abs(start_line - line) / 10::DOUBLE) ELSE 0 END AS score FROM j)"""


@query(f"WITH {N}, {_CAND} SELECT reference_kind, count(*) AS n_pairs, count(DISTINCT ({_REFC})) AS n_refs FROM j GROUP BY 1")
def link_candidates(s, d):
    c = L.candidates(L.keyed(read(s, d, "refs")), nodes(s, d, *_COLS))
    return c.groupBy("reference_kind").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("ref").alias("n_refs"))


@query(f"WITH {N}, {_CAND}, {_SCORE}, k AS (SELECT *, row_number() OVER (PARTITION BY {_REFC} ORDER BY c_language = language DESC, score DESC, id) AS x FROM s) SELECT {_REFC}, id, round(score, 6) AS score FROM k WHERE x = 1")
def best_match_link(s, d):
    r = L.keyed(read(s, d, "refs"))
    b = L.best_match(L.candidates(r, nodes(s, d, *_COLS))).select("ref", "id", F.col("score").cast("double").alias("score"))
    return r.join(b, "ref").select(*L.REF, "id", "score")


@query(f"WITH {N}, r AS (SELECT DISTINCT * FROM refs), p AS (SELECT DISTINCT {_REFC}, unnest(list_concat([reference_name, regexp_extract(reference_name, '[^/]*$')], string_split_regex(reference_name, '::|\\.|/|\\('))) AS part FROM r) SELECT reference_kind, count(DISTINCT ({_REFC})) AS n FROM p WHERE part IN (SELECT name FROM n) GROUP BY 1")
def link_possible(s, d):
    return L.possible(L.keyed(read(s, d, "refs")), nodes(s, d, "name")).groupBy("reference_kind").agg(F.count(F.lit(1)).alias("n"))


def _in(words):
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_HEAD = "split_part(reference_name, '.', 1)"
_SCRIPT = f"(reference_name IN {_in(B.SCRIPT_NAMES)} OR regexp_matches(reference_name, '^(console|Math|JSON)[.]'))"
_BUILTIN = f"""coalesce(CASE WHEN language = 'arkts' THEN {_SCRIPT} OR reference_name IN {_in(B.ARKTS_NAMES)} WHEN language IN {_in(B.SCRIPT)} THEN {_SCRIPT}
WHEN language = 'python' THEN reference_name IN {_in(B.PYTHON_NAMES)} OR (strpos(reference_name, '.') > 1 AND ({_HEAD} IN {_in(B.PYTHON_TYPES)} OR substr(reference_name, strpos(reference_name, '.') + 1) IN {_in(B.PYTHON_METHODS)} AND upper({_HEAD}[1]) || {_HEAD}[2:] NOT IN (SELECT name FROM kn))) OR (reference_name IN {_in(B.PYTHON_METHODS)} AND reference_name NOT IN (SELECT name FROM kn))
WHEN language = 'go' THEN (strpos(reference_name, '.') > 1 AND {_HEAD} IN {_in(B.GO_PACKAGES)}) OR reference_name IN {_in(B.GO_NAMES)}
WHEN language IN ('c', 'cpp') THEN starts_with(reference_name, 'std::') OR (reference_name IN {_in(B.C_NAMES + B.CPP_NAMES)} AND reference_name NOT IN (SELECT name FROM kn)) END, false)"""
_OWN = f"""kn AS (SELECT DISTINCT name FROM n WHERE name IS NOT NULL), r0 AS (SELECT DISTINCT * FROM refs), r AS (SELECT row_number() OVER () AS ref, * FROM r0 WHERE NOT {_BUILTIN}
AND len(list_filter(list_concat([reference_name, regexp_extract(reference_name, '[^/]*$')], string_split_regex(reference_name, '::|\\.|/|\\(')), lambda x: x IN (SELECT name FROM kn))) > 0)""".replace(
    "len(list_filter(list_concat([reference_name, regexp_extract(reference_name, '[^/]*$')], string_split_regex(reference_name, '::|\\.|/|\\(')), lambda x: x IN (SELECT name FROM kn))) > 0",
    "EXISTS (SELECT 1 FROM (SELECT unnest(list_concat([reference_name, regexp_extract(reference_name, '[^/]*$')], string_split_regex(reference_name, '::|\\.|/|\\('))) AS part) WHERE part IN (SELECT name FROM kn))",
)
_J = _CAND.replace("r AS (SELECT DISTINCT * FROM refs), ", "")
_FV = "fv AS (SELECT ref, coalesce(min(id) FILTER (WHERE c_file = file_path), min(id)) AS id, CASE WHEN count(*) FILTER (WHERE c_file = file_path) > 0 THEN 0.95 ELSE 0.8 END::DOUBLE AS confidence, 'function-value' AS method, 0 AS priority FROM j WHERE reference_kind = 'function_ref' AND kind IN ('function', 'method') GROUP BY ref HAVING count(*) = 1 OR count(*) FILTER (WHERE c_file = file_path) > 0)"
_IMP = "im AS (SELECT r.ref, min(t.id) AS id, 0.92::DOUBLE AS confidence, 'import' AS method, 1 AS priority FROM r JOIN n i ON i.kind = 'import' AND i.file_path = r.file_path AND i.name = r.reference_name JOIN e ON e.source = i.id AND e.kind = 'imports' JOIN n t ON t.id = e.target AND t.name = r.reference_name AND t.kind NOT IN ('file', 'import') GROUP BY 1)"
_QN = """qa AS (SELECT r.ref, coalesce(min(n.id) FILTER (WHERE n.file_path = r.file_path), min(n.id)) AS id, 0.95::DOUBLE AS confidence FROM r JOIN n ON n.qualified_name = r.reference_name WHERE regexp_matches(reference_name, '::|[.]|/') GROUP BY 1),
qb AS (SELECT r.ref, min(n.id) AS id, 0.85::DOUBLE AS confidence FROM r JOIN n ON ends_with(n.qualified_name, '::' || r.reference_name) WHERE regexp_matches(reference_name, '::|[.]|/') GROUP BY 1 HAVING count(DISTINCT n.id) = 1),
qn AS (SELECT ref, id, confidence, 'qualified-name' AS method, 2 AS priority FROM qa UNION ALL SELECT ref, id, confidence, 'qualified-name', 2 FROM qb WHERE ref NOT IN (SELECT ref FROM qa))"""
_FP = f"""fb AS (SELECT id, name, qualified_name, file_path AS c_file, language AS c_language, count(*) OVER (PARTITION BY name) AS k FROM n WHERE kind = 'file'),
fj AS (SELECT r.*, fb.id, fb.c_file, fb.c_language AS cl, CASE WHEN fb.qualified_name = reference_name OR c_file = reference_name THEN 0.95 WHEN ends_with(fb.qualified_name, reference_name) OR ends_with(c_file, reference_name) THEN 0.85 WHEN k = 1 THEN 0.7 END::DOUBLE AS confidence FROM r JOIN fb ON fb.name = regexp_extract(r.reference_name, '[^/]*$') WHERE contains(reference_name, '/') OR regexp_matches(reference_name, '[.][A-Za-z][A-Za-z0-9]{{0,3}}$')),
fp AS (SELECT ref, id, confidence, 'file-path' AS method, 2 AS priority FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY confidence DESC, regexp_replace(c_file, '/?[^/]*$', '') <> regexp_replace(file_path, '/?[^/]*$', ''), {_PROX} DESC, id) AS x FROM fj WHERE confidence IS NOT NULL) WHERE x = 1)"""
_WORDS = "list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[\\s._:/\\\\]+'), lambda w: length(w) > 1), lambda w: lower(w))"
_MC = f"""cs AS (SELECT *, regexp_extract(reference_name, rx, 1) AS receiver, regexp_extract(reference_name, rx, 2) AS member FROM (SELECT *, CASE WHEN regexp_matches(reference_name, '^([\\w.]+)\\.(\\w+:?(?:\\w+:)*)$') THEN '^([\\w.]+)\\.(\\w+:?(?:\\w+:)*)$' WHEN regexp_matches(reference_name, '^(\\w+)::(\\w+)$') THEN '^(\\w+)::(\\w+)$' END AS rx FROM r) WHERE rx IS NOT NULL),
cc AS (SELECT DISTINCT c.name AS type, m.name AS member, c.language, c.file_path AS file, m.id FROM n c JOIN n m ON m.file_path = c.file_path AND m.language = c.language WHERE c.kind IN ('class', 'struct', 'interface') AND m.kind = 'method' AND contains(m.qualified_name, c.name)),
ct AS (SELECT ref, x.id, 1 AS t, 0.85 AS confidence, 'qualified-name' AS method, x.file <> cs.file_path AS far, x.file FROM cs JOIN cc x ON x.type = receiver AND x.member = cs.member AND x.language = cs.language
UNION ALL SELECT ref, x.id, 2, 0.8, 'instance-method', x.file <> cs.file_path, x.file FROM cs JOIN cc x ON x.type = upper(receiver[1]) || receiver[2:] AND upper(receiver[1]) || receiver[2:] <> receiver AND x.member = cs.member AND x.language = cs.language),
mm AS (SELECT * FROM n WHERE kind = 'method' AND name IN (SELECT name FROM n GROUP BY 1 HAVING count(*) <= 500)),
mj AS (SELECT cs.*, m.id, m.qualified_name, m.file_path AS c_file, m.language AS cl, count(*) FILTER (WHERE m.language = cs.language) OVER (PARTITION BY ref) AS n_own, count(*) OVER (PARTITION BY ref) AS n_all FROM cs JOIN mm m ON m.name = cs.member),
m4 AS (SELECT *, len(list_filter({_WORDS.format('receiver')}, lambda w: list_contains({_WORDS.format('qualified_name')}, w))) + (cl = language)::INT AS score FROM mj WHERE (n_own > 1 AND cl = language) OR (n_own = 0 AND n_all > 1)),
mt AS (SELECT ref, id, t, confidence, method FROM (SELECT *, row_number() OVER (PARTITION BY ref, t ORDER BY far, file, id) AS x FROM ct) WHERE x = 1
UNION ALL SELECT ref, id, 3, 0.7, 'instance-method' FROM mj WHERE n_own = 1 AND cl = language
UNION ALL SELECT ref, id, 4, 0.65, 'instance-method' FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, c_file <> file_path, id) AS x FROM m4 WHERE score >= 2) WHERE x = 1),
mc AS (SELECT ref, id, confidence::DOUBLE AS confidence, method, 3 AS priority FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY t, id) AS x FROM mt) WHERE x = 1)"""
_EX = f"""{_SCORE}, ex AS (SELECT ref, id, CASE WHEN k = 1 THEN CASE WHEN c_language = language THEN 0.9 ELSE 0.5 END WHEN {_PROX} >= 30 THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence, 'exact-name' AS method, 5 AS priority FROM (SELECT *, count(*) OVER (PARTITION BY ref) AS k, row_number() OVER (PARTITION BY ref ORDER BY c_language = language DESC, score DESC, id) AS x FROM s) WHERE x = 1)"""
_FZ = "fz AS (SELECT r.ref, min(c.id) AS id, CASE WHEN min(c.language) IS NOT DISTINCT FROM any_value(r.language) THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence, 'fuzzy' AS method, 6 AS priority FROM r JOIN n c ON lower(c.name) = lower(r.reference_name) AND c.name <> r.reference_name WHERE c.kind IN ('function', 'method', 'class') GROUP BY 1 HAVING count(*) = 1)"
_PARTS = {"fv": _FV, "im": _IMP, "qn": _QN, "fp": _FP, "mc": _MC, "ex": _EX, "fz": _FZ}
_BASE = f"{N}, {E}, {_OWN}, {_J}"
_ALL = f"{_BASE}, " + ", ".join(_PARTS.values()) + ", every AS (" + " UNION ALL ".join(f"SELECT ref, id, confidence, method, priority FROM {k}" for k in _PARTS) + "), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY CASE WHEN confidence >= 0.9 THEN priority ELSE 100 END, confidence DESC, priority, id) AS x FROM every) WHERE x = 1)"
_LINKED = f"{_ALL}, linked AS (SELECT r.* EXCLUDE (ref), best.id AS target, best.confidence, best.method FROM best JOIN r USING (ref))"


def _strategy(key):
    return f"WITH {_BASE}, {_PARTS[key]} SELECT {_REFC}, x.id AS target, x.confidence, x.method FROM {key} x JOIN r USING (ref)"


def _own(s, d, n):
    return L.possible(L.own_symbols(L.keyed(read(s, d, "refs")), n), n)


def _linked(refs, got):
    return refs.join(got, "ref").select(*L.REF, F.col("id").alias("target"), F.col("confidence").cast("double").alias("confidence"), "method")


@query(f"WITH {N}, kn AS (SELECT DISTINCT name FROM n WHERE name IS NOT NULL) SELECT language, count(*) AS n, count(*) FILTER (WHERE {_BUILTIN}) AS n_built_in FROM (SELECT DISTINCT * FROM refs) GROUP BY 1")
def link_built_ins(s, d):
    r = L.keyed(read(s, d, "refs"))
    own = L.own_symbols(r, nodes(s, d, "name")).select("ref", F.lit(0).alias("b"))
    return r.join(own, "ref", "left").groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("b", F.lit(1))).alias("n_built_in"))


@query(_strategy("fv"))
def link_function_values(s, d):
    n = nodes(s, d, *_COLS)
    r = _own(s, d, n)
    return _linked(r, L.by_function_value(L.candidates(r, n)))


@query(_strategy("im"))
def link_imports(s, d):
    n = nodes(s, d, *_COLS)
    r = _own(s, d, n)
    return _linked(r, L.by_import(r, n, edges(s, d)))


@query(_strategy("qn"))
def link_qualified_names(s, d):
    n = nodes(s, d, *_COLS)
    r = _own(s, d, n)
    return _linked(r, L.by_qualified_name(r, n))


@query(_strategy("fp"))
def link_file_paths(s, d):
    n = nodes(s, d, *_COLS)
    r = _own(s, d, n)
    return _linked(r, C.by_file_path(r, n))


@query(_strategy("mc"))
def link_method_calls(s, d):
    n = nodes(s, d, *_COLS)
    r = _own(s, d, n)
    return _linked(r, C.by_method_call(r, n, edges(s, d)))


@query(_strategy("ex"))
def link_exact_names(s, d):
    n = nodes(s, d, *_COLS)
    r = _own(s, d, n)
    return _linked(r, L.by_exact_name(L.candidates(r, n)))


@query(_strategy("fz"))
def link_fuzzy_names(s, d):
    n = nodes(s, d, *_COLS)
    r = _own(s, d, n)
    return _linked(r, L.by_fuzzy_name(r, n))


@query(f"WITH {_LINKED} SELECT * FROM linked")
def link_cascade(s, d):
    return L.resolve(read(s, d, "refs"), nodes(s, d, *_COLS, "return_type"), edges(s, d)).withColumn("confidence", F.col("confidence").cast("double"))


@query(f"WITH {_LINKED} SELECT method, reference_kind, count(*) AS n, round(avg(confidence), 6) AS confidence FROM linked GROUP BY 1, 2")
def link_methods(s, d):
    """References resolved by each method."""
    return link_cascade(s, d).groupBy("method", "reference_kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query(f"WITH {_LINKED} SELECT from_node_id AS source, target, CASE WHEN reference_kind = 'function_ref' THEN 'references' WHEN reference_kind = 'extends' AND n.kind IN ('interface', 'protocol') THEN 'implements' WHEN reference_kind = 'calls' AND n.kind IN ('class', 'struct') THEN 'instantiates' ELSE reference_kind END AS kind, line, col, method AS provenance FROM linked JOIN n ON n.id = linked.target")
def edge_kind_promotion(s, d):
    return L.to_edges(link_cascade(s, d), nodes(s, d, "kind"))


@query(f"WITH {N}, i AS (SELECT * FROM n WHERE kind = 'import'), r AS (SELECT DISTINCT * FROM refs) SELECT reference_kind, count(*) AS n FROM r WHERE EXISTS (SELECT 1 FROM i WHERE i.file_path = r.file_path AND i.name = split_part(r.reference_name, '.', 1)) GROUP BY 1")
def import_matched_refs(s, d):
    imp = nodes(s, d, "kind", "name", "file_path").where("kind = 'import'").select("file_path", F.col("name").alias("_h"))
    r = read(s, d, "refs").distinct().withColumn("_h", F.split_part("reference_name", F.lit("."), F.lit(1)))
    return r.join(imp, ["file_path", "_h"], "left_semi").groupBy("reference_kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {N}, r AS (SELECT DISTINCT from_node_id AS id, reference_name AS channel FROM refs WHERE reference_kind = 'function_ref'), o AS (SELECT DISTINCT id, name AS channel FROM n WHERE kind IN ('function', 'method')), ok AS (SELECT channel FROM r GROUP BY 1 HAVING count(DISTINCT id) <= 6 INTERSECT SELECT channel FROM o GROUP BY 1 HAVING count(DISTINCT id) <= 6) SELECT r.id AS source, o.id AS target, channel FROM r JOIN o USING (channel) WHERE channel IN (SELECT channel FROM ok) AND r.id <> o.id")
def event_channel_edges(s, d):
    """Dispatch edges from those that pass a function by name to the functions of that name."""
    emit = read(s, d, "refs").where("reference_kind = 'function_ref'").select(F.col("from_node_id").alias("id"), F.col("reference_name").alias("channel")).distinct()
    on = nodes(s, d, "kind", "name").where(F.col("kind").isin("function", "method")).select("id", F.col("name").alias("channel"))
    return L.event_channels(on, emit)


@query(f"WITH {N}, {E}, b AS (SELECT file_path, min(id) AS id, name, kind FROM n GROUP BY file_path, name, kind), t AS (SELECT name, kind, min(id) AS target FROM n GROUP BY 1, 2), x AS (SELECT e.source, e.kind, c.name, c.kind AS tk FROM e JOIN n a ON a.id = e.source JOIN n c ON c.id = e.target WHERE e.kind <> 'contains' AND a.file_path <> c.file_path) SELECT kind, count(*) AS n FROM (SELECT DISTINCT x.source, t.target, x.kind FROM x JOIN t ON t.name = x.name AND t.kind = x.tk) GROUP BY 1")
def relink_incoming(s, d):
    n = nodes(s, d, "kind", "name", "file_path")
    e = edges(s, d).where("kind <> 'contains'").join(n.select(F.col("id").alias("source"), F.col("file_path").alias("_f")), "source").select("source", "target", "kind", "_f").distinct()
    t = n.select(F.col("id").alias("target"), F.col("name").alias("target_name"), F.col("kind").alias("target_kind"), "file_path")
    lost = e.join(t, "target").where("_f <> file_path").select("source", "kind", "target_name", "target_kind")
    return L.relink(lost, n).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_T = "TIMESTAMP '2025-04-01'"
_SNAP = "(SELECT path, node_count FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, modified_at DESC, CAST(node_count AS VARCHAR) DESC NULLS LAST) AS r FROM files WHERE indexed_at IS NOT NULL {0}) WHERE r = 1)"


def _snapshots(s, d):
    from grovespark.sources.tables import latest

    f = read(s, d, "files").where("indexed_at is not null").select("path", "indexed_at", "modified_at", "node_count")
    top = lambda df: latest(df, ["path"], ["indexed_at", "modified_at"], ["path", "indexed_at", "modified_at", "node_count"]).select("path", "node_count")
    return top(f.where("indexed_at <= timestamp_ntz'2025-04-01 00:00:00'")), top(f)


@query(f"WITH b AS {_SNAP.format('AND indexed_at <= ' + _T)}, a AS {_SNAP.format('')} SELECT path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (path) WHERE b.path IS NULL OR a.path IS NULL OR a.node_count IS DISTINCT FROM b.node_count")
def snapshot_diff(s, d):
    b, a = _snapshots(s, d)
    return P.snapshot_diff(b, a, "path", "node_count")


@query(f"WITH b AS (SELECT {_PKG.format('path')} AS module, sum(node_count) AS n FROM {_SNAP.format('AND indexed_at <= ' + _T)} GROUP BY 1), a AS (SELECT {_PKG.format('path')} AS module, sum(node_count) AS n FROM {_SNAP.format('')} GROUP BY 1) SELECT module, CASE WHEN b.module IS NULL THEN 'added' WHEN a.module IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a USING (module) WHERE b.module IS NULL OR a.module IS NULL OR a.n IS DISTINCT FROM b.n")
def module_changes(s, d):
    per = lambda f: f.groupBy(package(F.col("path")).alias("module")).agg(F.sum("node_count").alias("n"))
    b, a = _snapshots(s, d)
    return P.snapshot_diff(per(b), per(a), "module", "n")


@query(f"WITH {N}, s AS (SELECT DISTINCT language, name FROM n WHERE kind = 'function'), t AS (SELECT DISTINCT language, name FROM n WHERE kind = 'method'), j AS (SELECT coalesce(s.language, t.language) AS language, s.name AS a, t.name AS b FROM s FULL JOIN t ON s.language = t.language AND s.name = t.name), g AS (SELECT language, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (WHERE b IS NULL) AS missing, count(*) FILTER (WHERE a IS NULL) AS extra FROM j GROUP BY 1) SELECT *, CASE WHEN matched + missing = 0 THEN 1.0 ELSE round(matched / (matched + missing), 2) END::DOUBLE AS coverage FROM g")
def name_coverage(s, d):
    n = nodes(s, d, "kind", "language", "name")
    return P.coverage(n.where("kind = 'function'"), n.where("kind = 'method'"), "language", "name")


@query("WITH l AS (SELECT run_id, status, lag(status) OVER (ORDER BY started_at, run_id) AS before FROM sync_runs), m AS (SELECT run_id, CASE before WHEN 'succeeded' THEN 'migrated' WHEN 'failed' THEN 'pending' WHEN 'aborted' THEN 'in_progress' END AS a, CASE status WHEN 'succeeded' THEN 'migrated' WHEN 'failed' THEN 'pending' ELSE 'in_progress' END AS b FROM l) SELECT run_id AS unit, a AS from_status, b AS to_status FROM m WHERE coalesce(a, '') || '>' || b NOT IN ('>pending', 'pending>in_progress', 'in_progress>migrated', 'in_progress>pending', 'migrated>verified', 'migrated>in_progress', 'verified>in_progress')")
def ledger_illegal(s, d):
    from pyspark.sql import Window as W

    as_status = lambda c: F.when(F.col(c) == "succeeded", "migrated").when(F.col(c) == "failed", "pending").when(F.col(c).isNotNull(), "in_progress")
    l_ = read(s, d, "sync_runs").withColumn("before", F.lag("status").over(W.orderBy("started_at", "run_id")))
    return P.illegal_moves(l_.select(F.col("run_id").alias("unit"), as_status("before").alias("from_status"), as_status("status").alias("to_status"))).select("unit", "from_status", "to_status")


@query(f"WITH {F_}, o AS (SELECT DISTINCT {_PKG.format('path')} AS old_unit, path FROM files WHERE indexed_at <= {_T}), w AS (SELECT DISTINCT split_part(path, '/', 1) || ':' || language AS new_unit, path FROM f), z AS (SELECT new_unit, count(*) AS size FROM w GROUP BY 1), j AS (SELECT old_unit, new_unit, count(*) AS overlap FROM o JOIN w USING (path) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY old_unit ORDER BY overlap DESC, size - overlap, new_unit) AS r FROM j JOIN z USING (new_unit)) SELECT old_unit, new_unit, overlap FROM k WHERE r = 1")
def ledger_remap(s, d):
    o = read(s, d, "files").where("indexed_at <= timestamp_ntz'2025-04-01 00:00:00'").select(package(F.col("path")).alias("unit"), F.col("path").alias("member"))
    n = files(s, d, "language").select(F.concat_ws(":", F.split_part("path", F.lit("/"), F.lit(1)), "language").alias("unit"), F.col("path").alias("member"))
    return P.ledger_remap(o, n)


@query(f"""WITH RECURSIVE {F_}, k AS (SELECT {_PKG.format('path')} AS module, path, coalesce(node_count, 0)::BIGINT AS size FROM f), i AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY path) AS i FROM k),
w AS (SELECT module, path, i, size AS used, 1 AS files, 0 AS slice FROM i WHERE i = 1 UNION ALL SELECT i.module, i.path, i.i, CASE WHEN w.used + i.size > 600 OR w.files >= 20 THEN i.size ELSE w.used + i.size END, CASE WHEN w.used + i.size > 600 OR w.files >= 20 THEN 1 ELSE w.files + 1 END, w.slice + (w.used + i.size > 600 OR w.files >= 20)::INT FROM w JOIN i ON i.module = w.module AND i.i = w.i + 1) SELECT module, path, slice FROM w""")
def unit_slices(s, d):
    """Files of each package in order, packed into slices of at most 600 symbols and 20 files."""
    f = files(s, d, "node_count").select(package(F.col("path")).alias("module"), "path", F.coalesce("node_count", F.lit(0)).cast("long").alias("size"))
    return P.next_fit(f, "module", "path", "size", 600, 20)


@query(f"""WITH RECURSIVE {N}, {E}, {_XF}, {_ML}, u AS (SELECT {_PKG.format('file_path')} AS unit, count(*) AS size FROM n GROUP BY 1), b AS (SELECT b AS unit, string_agg(DISTINCT a, ',' ORDER BY a) AS who FROM m WHERE a <> b GROUP BY 1),
s AS (SELECT unit, size, who, row_number() OVER (PARTITION BY who ORDER BY size DESC, unit) AS i FROM u JOIN b USING (unit) WHERE size < 120),
w AS (SELECT unit, who, i, size AS used, unit AS merged FROM s WHERE i = 1 UNION ALL SELECT s.unit, s.who, s.i, CASE WHEN w.used + s.size > 3000 THEN s.size ELSE w.used + s.size END, CASE WHEN w.used + s.size > 3000 THEN s.unit ELSE w.merged END FROM w JOIN s ON s.who = w.who AND s.i = w.i + 1)
SELECT u.unit, coalesce(w.merged, u.unit) AS merged FROM u LEFT JOIN w USING (unit)""")
def unit_merge(s, d):
    """Small packages that the same packages depend on, put together."""
    size = nodes(s, d, "file_path").groupBy(package(F.col("file_path")).alias("unit")).agg(F.count(F.lit(1)).alias("size"))
    return P.merge_small(size, module_links(s, d), 120, 3000)


@query(f"WITH {N}, c AS (SELECT DISTINCT 'export' AS kind, {_PKG.format('file_path')} AS module, name AS subject FROM n WHERE is_exported AND kind IN ('class', 'interface', 'type_alias')) SELECT substr(sha1(concat_ws(chr(0), 'check', kind, module, subject)), 1, 16) AS check_id, kind, module, subject FROM c")
def contract_checks(s, d):
    n = nodes(s, d, "kind", "name", "file_path", "is_exported").where(F.col("is_exported") & F.col("kind").isin("class", "interface", "type_alias"))
    return P.checks(n.select(F.lit("export").alias("kind"), package(F.col("file_path")).alias("module"), F.col("name").alias("subject")))


_EVAL = f"""c AS (SELECT DISTINCT {_PKG.format('file_path')} AS module, name AS subject FROM n WHERE is_exported AND kind IN ('class', 'interface', 'type_alias')), t AS (SELECT DISTINCT lower(name) AS t FROM n WHERE kind IN ('function', 'method', 'class')),
rn AS (SELECT DISTINCT {_PKG.format('a.file_path')} AS module, lower(a.name) AS s, lower(b.name) AS q FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE e.kind = 'extends' AND a.name <> b.name), ba AS (SELECT s, min(q) AS q FROM rn GROUP BY 1 HAVING count(DISTINCT q) = 1),
v AS (SELECT module, subject, CASE WHEN EXISTS (SELECT 1 FROM rn JOIN t ON t.t = rn.q WHERE rn.module = c.module AND rn.s = lower(c.subject)) THEN 'qualified' WHEN EXISTS (SELECT 1 FROM ba JOIN t ON t.t = ba.q WHERE ba.s = lower(c.subject)) THEN 'bare' WHEN lower(subject) IN (SELECT t FROM t) THEN 'same' ELSE '' END AS match FROM c)"""


@query(f"WITH {N}, {E}, {_EVAL} SELECT substr(sha1(concat_ws(chr(0), 'check', 'export', module, subject)), 1, 16) AS check_id, CASE WHEN match = '' THEN 'fail' ELSE 'pass' END AS status, match FROM v")
def contract_evaluation(s, d):
    """Exported types looked for among callables and classes; supertypes stand for what a type was renamed to."""
    n = nodes(s, d, "kind", "name", "file_path")
    target = n.where(F.col("kind").isin("function", "method", "class"))
    end = lambda c, to: n.select(F.col("id").alias(c), F.col("name").alias(to), *([package(F.col("file_path")).alias("module")] if c == "source" else []))
    renames = edges(s, d).where("kind = 'extends'").join(end("source", "subject"), "source").join(end("target", "new_name"), "target").where("subject <> new_name").select("module", "subject", "new_name")
    return P.evaluate(contract_checks(s, d), target, renames.distinct())


@query(f"WITH {N}, {E}, {_XF}, {_ML} SELECT a AS module, count(*) AS n_dependencies, CAST(sum(weight) AS BIGINT) AS weight FROM m GROUP BY 1")
def module_fan_out(s, d):
    return module_links(s, d).groupBy(F.col("a").alias("module")).agg(F.count(F.lit(1)).alias("n_dependencies"), F.sum("weight").alias("weight"))


@query(f"WITH RECURSIVE {N}, {E}, {_XF}, {_ML}, decl AS (SELECT a, b FROM m WHERE weight >= 10), r AS (SELECT a, b FROM decl UNION SELECT r.a, decl.b FROM r JOIN decl ON decl.a = r.b) SELECT a, b, CAST(weight AS BIGINT) AS weight FROM m WHERE weight < 10 AND (a, b) NOT IN (SELECT a, b FROM r)")
def convention_warnings(s, d):
    """Weak dependencies between packages that no chain of strong ones covers."""
    from grovespark.operators.traversal import reach

    m = module_links(s, d)
    strong = m.where("weight >= 10").select("a", "b")
    covered = reach(m.where("weight < 10").select(F.col("a").alias("seed")).distinct(), strong, None).where("depth > 0")
    return m.where("weight < 10").join(covered.select(F.col("seed").alias("a"), F.col("id").alias("b")), ["a", "b"], "left_anti")


