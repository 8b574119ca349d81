"""Traversal, algorithm and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovespark.functions import names, paths
from grovespark.functions.kinds import KIND_BONUS
from grovespark.operators import algorithms as G
from grovespark.operators import relational as R
from grovespark.operators import search as Q
from grovespark.operators import traversal as T
from grovespark.plans.common import PICKED, E, N, edges, links, nodes, picked
from grovespark.plans.relational import _TEST, PACKAGE_RE, _re
from grovespark.session import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_PICKED, _picked = PICKED, picked
_CALLABLES = "kind IN ('function', 'method')"
_TYPE_KINDS = ("class", "interface", "struct", "trait", "protocol", "enum")
_REF = "('calls', 'references', 'imports', 'instantiates')"


def _seeds(s, d, *kinds, picked=True):
    n = nodes(s, d, "kind")
    n = n.where(F.col("kind").isin(*kinds)) if kinds else n
    return (n.where(_picked()) if picked else n).select(F.col("id").alias("seed"))


def _bfs(name: str, steps: str, seeds: str, depth: int | None = None) -> str:
    """SQL of a traversal: CTEs `steps` (a, b) and `name` (seed, id, depth), each pair with its least depth, to the end."""
    more = "" if depth is None else f" AND r.depth < {depth}"
    return f"""{name}_h AS ({steps}), {name}(seed, id, depth) USING KEY (seed, id) AS (SELECT id, id, 0 FROM n WHERE {seeds} UNION SELECT r.seed, h.b, min(r.depth + 1) FROM {name} r JOIN {name}_h h ON h.a = r.id WHERE NOT EXISTS (SELECT 1 FROM recurring.{name} q WHERE q.seed = r.seed AND q.id = h.b){more} GROUP BY 1, 2)"""


_IN = f"SELECT DISTINCT target AS a, source AS b FROM e WHERE kind IN {_REF} AND source <> target"
_OUT = f"SELECT DISTINCT source AS a, target AS b FROM e WHERE kind IN {_REF} AND source <> target"
_BOTH = "SELECT DISTINCT source AS a, target AS b FROM e WHERE source <> target UNION SELECT DISTINCT target, source FROM e WHERE source <> target"
_TYPES = "SELECT DISTINCT {0} AS a, {1} AS b FROM e WHERE kind IN ('extends', 'implements') AND source <> target"


def _got(name: str, where: str = "WHERE depth > 0") -> str:
    return f"SELECT seed, id, CAST(depth AS INTEGER) AS depth FROM {name} {where}"


@query(f"WITH RECURSIVE {N}, {E}, {_bfs('x', _IN, 'true', 1)} {_got('x')}")
def callers_k1(s, d):
    """Direct callers of every node."""
    return T.callers(_seeds(s, d, picked=False), edges(s, d), 1)


@query(f"WITH RECURSIVE {N}, {E}, {_bfs('x', _IN, _PICKED, 2)} {_got('x')}")
def callers_k2(s, d):
    """Callers of each picked node within two steps."""
    return T.callers(_seeds(s, d), edges(s, d), 2)


@query(f"WITH RECURSIVE {N}, {E}, {_bfs('x', _OUT, 'true', 1)} {_got('x')}")
def callees_k1(s, d):
    return T.callees(_seeds(s, d, picked=False), edges(s, d), 1)


@query(f"WITH RECURSIVE {N}, {E}, {_bfs('x', _IN, _PICKED, 2)}, {_bfs('y', _OUT, _PICKED, 2)} SELECT seed, id, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT * FROM x UNION ALL SELECT * FROM y) WHERE depth > 0 GROUP BY 1, 2")
def call_graph_k2(s, d):
    """Callers and callees of each picked node within two steps."""
    e, seeds = edges(s, d), _seeds(s, d)
    return T.callers(seeds, e, 2).unionByName(T.callees(seeds, e, 2)).groupBy("seed", "id").agg(F.min("depth").alias("depth"))


_TK = "kind IN ('" + "', '".join(_TYPE_KINDS) + "')"


@query(f"WITH RECURSIVE {N}, {E}, {_bfs('x', _TYPES.format('source', 'target'), _TK)}, {_bfs('y', _TYPES.format('target', 'source'), _TK)} {_got('x')} UNION ALL SELECT seed, id, CAST(-depth AS INTEGER) FROM y WHERE depth > 0")
def type_hierarchy(s, d):
    """Supertypes and subtypes of every type, however deep."""
    return T.type_hierarchy(_seeds(s, d, *_TYPE_KINDS, picked=False), edges(s, d))


@query(f"WITH RECURSIVE {N}, {E}, {_bfs('x', _BOTH, _PICKED)}, k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, id) AS r FROM x) SELECT seed, id, CAST(depth AS INTEGER) AS depth FROM k WHERE r <= 1000")
def bfs_both(s, d):
    """The nearest thousand nodes of each picked node, either way, without a limit of depth."""
    return T.reach(_seeds(s, d), T.hops(edges(s, d), "both"), None, limit=1000)


@query(f"WITH RECURSIVE {N}, {E}, {_bfs('x', 'SELECT DISTINCT source AS a, target AS b FROM e JOIN n ON n.id = e.target WHERE source <> target', _PICKED, 2)}, k AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY seed ORDER BY depth, coalesce(r, 3), x.id) AS i FROM x LEFT JOIN (SELECT id, min(r) AS r FROM (SELECT source AS id, CASE kind WHEN 'contains' THEN 0 WHEN 'calls' THEN 1 ELSE 2 END AS r FROM e WHERE source <> target UNION ALL SELECT target, CASE kind WHEN 'contains' THEN 0 WHEN 'calls' THEN 1 ELSE 2 END FROM e WHERE source <> target) GROUP BY 1) USING (id)) WHERE i <= 1000) SELECT DISTINCT a.seed, e.source, e.target, e.kind FROM e JOIN k a ON a.id = e.source JOIN k b ON b.seed = a.seed AND b.id = e.target WHERE e.source <> e.target")
def bfs_subgraph_edges(s, d):
    """Edges among what each picked node leads to within two steps."""
    return T.subgraph(_seeds(s, d), nodes(s, d, "kind"), edges(s, d), "out", max_depth=2)[1]


@query(f"""WITH RECURSIVE {N}, {E}, c AS (SELECT DISTINCT source AS a, target AS b FROM e JOIN n ON n.id = e.source WHERE e.kind = 'contains' AND n.kind IN ('class', 'interface', 'struct', 'trait', 'protocol', 'module', 'enum') AND source <> target),
h AS (SELECT DISTINCT target AS a, source AS b FROM e WHERE kind <> 'contains' AND source <> target),
r AS (SELECT id AS seed, id, 0 AS depth FROM n WHERE {_PICKED} UNION SELECT seed, x.b, x.depth FROM (SELECT r.seed, h.b, r.depth + 1 AS depth FROM r JOIN h ON h.a = r.id WHERE r.depth < 3 UNION ALL SELECT r.seed, c.b, r.depth FROM r JOIN c ON c.a = r.id) x)
SELECT seed, id, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2""")
def impact_k3(s, d):
    """Impact of each picked node, to the operator's depth of three."""
    return T.impact(_seeds(s, d), nodes(s, d, "kind"), links(s, d))


_WAYS = f"{_bfs('x', _OUT, f'{_CALLABLES} AND {_PICKED}')}"


@query(f"WITH RECURSIVE {N}, {E}, {_WAYS} SELECT seed AS start, id AS \"end\", CAST(depth AS INTEGER) AS length FROM x WHERE id IN (SELECT id FROM n)")
def shortest_path_len(s, d):
    """Lengths of the ways from each picked function or method to every node that it reaches, without a limit of hops."""
    r = T.reach(_seeds(s, d, "function", "method"), T.hops(edges(s, d), "out", R.REFERRING), None)
    return r.join(nodes(s, d).select("id"), "id", "left_semi").select(F.col("seed").alias("start"), F.col("id").alias("end"), F.col("depth").alias("length"))


@query(f"""WITH RECURSIVE {N}, {E}, {_WAYS}, p AS (SELECT x.seed, x.id, min(q.id) AS pred FROM x JOIN x_h ON x_h.b = x.id JOIN x q ON q.seed = x.seed AND q.id = x_h.a AND q.depth = x.depth - 1 GROUP BY 1, 2),
w AS (SELECT seed, id AS goal, id AS cur, id AS path, depth FROM x WHERE id IN (SELECT id FROM n WHERE kind = 'class') UNION ALL SELECT w.seed, goal, p.pred, p.pred || ' > ' || path, depth FROM w JOIN p ON p.seed = w.seed AND p.id = w.cur)
SELECT seed AS start, goal AS "end", CAST(depth AS INTEGER) AS length, path FROM w WHERE cur = seed""")
def shortest_paths(s, d):
    """Ways from each picked function or method to every class that it reaches, without a limit of hops."""
    goal = nodes(s, d, "kind").where("kind = 'class'").select(F.col("id").alias("end"))
    return T.shortest_paths(_seeds(s, d, "function", "method").withColumnRenamed("seed", "start"), goal, T.hops(edges(s, d), "out", R.REFERRING))


_FE = "x AS (SELECT DISTINCT a.file_path AS source_file, b.file_path AS target_file FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE e.kind <> 'contains' AND a.file_path <> b.file_path)"


@query(f"""WITH RECURSIVE {N}, {E}, {_FE}, t AS (SELECT DISTINCT file_path AS f FROM n WHERE {_TEST.format('file_path')}), p AS (SELECT DISTINCT file_path AS id FROM n), r(seed, id, depth) USING KEY (seed, id) AS (SELECT id, id, 0 FROM p WHERE {_PICKED} UNION SELECT r.seed, x.source_file, min(r.depth + 1) FROM r JOIN x ON x.target_file = r.id WHERE (r.depth = 0 OR r.id NOT IN (SELECT f FROM t)) AND r.depth < 5 AND NOT EXISTS (SELECT 1 FROM recurring.r q WHERE q.seed = r.seed AND q.id = x.source_file) GROUP BY 1, 2)
SELECT seed AS changed, id AS test, CAST(depth AS INTEGER) AS depth FROM r WHERE id IN (SELECT f FROM t) AND depth > 0""")
def affected_tests(s, d):
    """Tests that depend on each picked file within the five steps of the operator; a test is not walked through."""
    f, x = _numbered_files(s, d)
    tests = cut(f.where(paths.is_test(F.col("path"))).select("id", F.col("path").alias("test")))
    seeds = f.where(_picked("path")).select(F.col("id").alias("seed"), F.col("path").alias("changed"))
    r = T.reach_of_many(seeds, x.select(F.col("b").alias("a"), F.col("a").alias("b")), 5, tests, absorbing=tests)
    return r.where("depth > 0").select("changed", "test", "depth")


def _numbered_files(s, d):
    """Files (id, path) with a number each, and the distinct links (a, b) between two numbers."""
    n = cut(nodes(s, d, "file_path").where("file_path is not null"))
    f = cut(n.select(F.col("file_path").alias("path")).distinct().select(F.monotonically_increasing_id().alias("id"), "path"))
    at = cut(n.join(f.withColumnRenamed("id", "_f"), n["file_path"] == f["path"]).select("id", "_f"))
    end = lambda c, to: at.select(F.col("id").alias(c), F.col("_f").alias(to))
    e = links(s, d).where("kind <> 'contains'").select("source", "target").join(end("source", "a"), "source").select("a", "target").distinct()
    return f, cut(e.join(end("target", "b"), "target").where("a <> b").select("a", "b").distinct())


def _file_links(s, d):
    return R.cross_file(edges(s, d), nodes(s, d, "file_path")).select(F.col("source_file").alias("a"), F.col("target_file").alias("b"))


@query(f"""WITH RECURSIVE {N}, {E}, {_FE}, v AS (SELECT source_file AS id FROM x UNION SELECT target_file FROM x), r AS (SELECT source_file AS a, target_file AS b FROM x UNION SELECT r.a, x.target_file FROM r JOIN x ON x.source_file = r.b)
SELECT v.id, coalesce((SELECT min(r.b) FROM r JOIN r q ON q.a = r.b AND q.b = r.a WHERE r.a = v.id AND r.b < v.id), v.id) AS label FROM v""")
def file_scc(s, d):
    """Cyclic file dependencies: strongly connected components of the file graph."""
    links = cut(_file_links(s, d))
    return G.strong_components(links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct(), links)


_PKG = f"CASE WHEN regexp_matches({{0}}, {_re(PACKAGE_RE)}) THEN regexp_extract({{0}}, {_re(PACKAGE_RE)}, 1) ELSE split_part({{0}}, '/', 1) END"
_ML = f"m AS (SELECT {_PKG.format('source_file')} AS a, {_PKG.format('target_file')} AS b, sum(n) AS weight FROM x GROUP BY 1, 2 HAVING a <> b)"
_XF = "x AS (SELECT a.file_path AS source_file, b.file_path AS target_file, count(*) AS n FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE e.kind <> 'contains' AND a.file_path <> b.file_path GROUP BY 1, 2)"


def package(p):
    return F.when(p.rlike(PACKAGE_RE), F.regexp_extract(p, PACKAGE_RE, 1)).otherwise(F.split_part(p, F.lit("/"), F.lit(1)))


def module_links(s, d):
    x = R.cross_file(edges(s, d), nodes(s, d, "file_path"))
    return x.groupBy(package(F.col("source_file")).alias("a"), package(F.col("target_file")).alias("b")).agg(F.sum("n").alias("weight")).where("a <> b")


@query(f"""WITH RECURSIVE {N}, {E}, {_XF}, {_ML}, v AS (SELECT a AS id FROM m UNION SELECT b FROM m), t AS (SELECT a, b FROM m), k AS (SELECT a, b FROM t UNION SELECT k.a, t.b FROM k JOIN t ON t.a = k.b), bad AS (SELECT a AS id FROM k WHERE a = b UNION SELECT k.a FROM k JOIN k c ON c.a = k.b AND c.a = c.b),
w AS (SELECT id, 0 AS wave FROM v WHERE id NOT IN (SELECT id FROM bad) UNION SELECT t.a, w.wave + 1 FROM w JOIN t ON t.b = w.id WHERE t.a NOT IN (SELECT id FROM bad))
SELECT v.id, CAST(coalesce(max(w.wave), -1) AS INTEGER) AS wave FROM v LEFT JOIN w USING (id) GROUP BY 1""")
def topo_waves(s, d):
    """Dependency waves of packages; -1 for those on or above a cycle."""
    m = cut(module_links(s, d))
    return G.waves(m.select(F.col("a").alias("id")).unionByName(m.select(F.col("b").alias("id"))).distinct(), m.select("a", "b"))


@query(f"""WITH RECURSIVE {N}, {E}, {_XF}, {_ML}, v AS (SELECT a AS id FROM m UNION SELECT b FROM m), k AS (SELECT a, b FROM m UNION SELECT k.a, m.b FROM k JOIN m ON m.a = k.b), c AS (SELECT v.id, least(v.id, min(q.b)) AS label FROM v LEFT JOIN (SELECT k.a, k.b FROM k JOIN k r ON r.a = k.b AND r.b = k.a) q ON q.a = v.id GROUP BY v.id),
d AS (SELECT DISTINCT x.label AS a, y.label AS b FROM m JOIN c x ON x.id = m.a JOIN c y ON y.id = m.b WHERE x.label <> y.label), w AS (SELECT DISTINCT label AS id, 0 AS wave FROM c UNION SELECT d.a, w.wave + 1 FROM w JOIN d ON d.b = w.id) SELECT c.id, c.label, CAST((SELECT max(wave) FROM w WHERE w.id = c.label) AS INTEGER) AS wave FROM c""")
def module_waves_condensed(s, d):
    """Order of migration: packages condensed by cycles, then in waves and by name within a wave."""
    m = cut(module_links(s, d))
    v = m.select(F.col("a").alias("id")).unionByName(m.select(F.col("b").alias("id"))).distinct()
    scc = G.strong_components(v, m.select("a", "b"))
    to = lambda c: scc.select(F.col("id").alias(c), F.col("label").alias(f"{c}2"))
    between = m.select("a", "b").join(to("a"), "a").join(to("b"), "b").where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b"))
    w = G.waves(scc.select(F.col("label").alias("id")).distinct(), between)
    return scc.join(w.select(F.col("id").alias("label"), "wave"), "label").select("id", "label", "wave")


@query(f"WITH {N}, {E}, {_XF} SELECT least(source_file, target_file) AS a, greatest(source_file, target_file) AS b, CAST(sum(n) AS BIGINT) AS weight FROM x WHERE NOT {_TEST.format('source_file')} AND NOT {_TEST.format('target_file')} GROUP BY 1, 2")
def file_coupling(s, d):
    x = R.cross_file(edges(s, d), nodes(s, d, "file_path")).where(~paths.is_test(F.col("source_file")) & ~paths.is_test(F.col("target_file")))
    return x.groupBy(F.least("source_file", "target_file").alias("a"), F.greatest("source_file", "target_file").alias("b")).agg(F.sum("n").alias("weight"))


@query(f"WITH {N}, {E}, {_XF}, {_ML} SELECT a, b, CAST(weight AS BIGINT) AS weight, CAST(CASE WHEN weight >= 10 THEN 0.9 WHEN weight >= 3 THEN 0.7 ELSE 0.5 END AS DOUBLE) AS confidence FROM m")
def module_lifted_deps(s, d):
    from grovespark.functions.kinds import lifted_confidence

    return module_links(s, d).select("a", "b", "weight", lifted_confidence(F.col("weight")).alias("confidence"))


@query()
def module_communities(s, d):
    """Communities of packages with size and cohesion, oversized ones split once."""
    m = cut(module_links(s, d))
    parts = G.split_large(G.louvain(m), m)
    return G.cohesion(parts, m.select("a", "b"))


@query(f"WITH {N}, {E}, {_XF}, p AS (SELECT DISTINCT source_file AS id, {_PKG.format('source_file')} AS community FROM x UNION SELECT DISTINCT target_file, {_PKG.format('target_file')} FROM x), l AS (SELECT DISTINCT least(source_file, target_file) AS a, greatest(source_file, target_file) AS b FROM x), i AS (SELECT p.community, count(*) AS n_links FROM l JOIN p ON p.id = l.a JOIN p q ON q.id = l.b WHERE p.community = q.community GROUP BY 1), z AS (SELECT community, count(*) AS size FROM p GROUP BY 1) SELECT community, size, coalesce(n_links, 0) AS n_links, round(coalesce(n_links / nullif(size * (size - 1) / 2.0, 0), 0), 6) AS cohesion FROM z LEFT JOIN i USING (community)")
def community_cohesion(s, d):
    links = _file_links(s, d)
    parts = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct().select("id", package(F.col("id")).alias("community"))
    return G.cohesion(parts, links)


@query(f"""WITH RECURSIVE {N}, {E}, {_XF}, w AS (SELECT a, b, count(*)::DOUBLE AS w FROM (SELECT source_file AS a, target_file AS b FROM x UNION ALL SELECT target_file, source_file FROM x) GROUP BY 1, 2), p AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS p FROM w), ids AS (SELECT DISTINCT a AS id FROM p), sd AS (SELECT id FROM ids WHERE {_PICKED}), base AS (SELECT ids.id, CASE WHEN sd.id IS NULL THEN 0.0 ELSE 1.0 / (SELECT count(*) FROM sd) END::DOUBLE AS s FROM ids LEFT JOIN sd USING (id)),
r AS (SELECT 0 AS k, id, s AS score FROM base UNION ALL SELECT k, id, score FROM (SELECT r.k + 1 AS k, base.id, any_value(base.s) * 0.25 + 0.75 * sum(r.score * p.p) AS score FROM r JOIN p ON p.a = r.id JOIN base ON base.id = p.b WHERE r.k < 25 GROUP BY r.k, base.id))
SELECT id, round(score, 6) AS score FROM r WHERE k = 25""")
def rwr_relevance(s, d):
    """Relevance of all linked files to the picked ones, by a random walk of 25 rounds with restart over file links."""
    f, x = _numbered_files(s, d)
    on = x.select(F.col("a").alias("id")).unionByName(x.select(F.col("b").alias("id"))).distinct()
    r = G.random_walk(f.where(_picked("path")).join(on, "id", "left_semi"), x)
    return r.join(f, "id").select(F.col("path").alias("id"), F.round("score", 6).alias("score"))


# Search.


@query(f"WITH {N}, q AS (SELECT 'snapshot' AS t) SELECT id, name, CAST(CASE WHEN lower(name) = t THEN 1 WHEN starts_with(lower(name), t) THEN 0.9 WHEN contains(lower(name), t) THEN 0.8 WHEN contains(lower(qualified_name), t) THEN 0.7 END AS DOUBLE) AS score FROM n, q WHERE contains(lower(name), t) OR contains(lower(qualified_name), t)")
def search_like(s, d):
    return Q.like(nodes(s, d, "name", "qualified_name"), "snapshot")


@query(f"WITH {N}, c AS (SELECT name, levenshtein(lower(name), 'buildindxe') AS distance FROM (SELECT DISTINCT name FROM n) WHERE levenshtein(lower(name), 'buildindxe') <= 2), k AS (SELECT n.id, n.name, distance, row_number() OVER (PARTITION BY n.name ORDER BY n.id) AS r FROM n JOIN c USING (name)) SELECT id, name, CAST(distance AS INTEGER) AS distance, round(1.0::DOUBLE / (1 + distance), 6) AS score FROM k WHERE r <= 5")
def search_fuzzy(s, d):
    return Q.fuzzy(nodes(s, d, "name"), "buildIndxe")


@query(f"WITH {N}, h AS (SELECT id, lower(name) AS name, file_path FROM n WHERE lower(name) IN ('logdebug', 'logwarn', 'invariant', 'container', 'lookup')), r AS (SELECT name FROM h GROUP BY 1 HAVING count(DISTINCT file_path) < 10) SELECT h.id, h.name, CASE WHEN EXISTS (SELECT 1 FROM h o WHERE o.file_path = h.file_path AND o.name <> h.name AND o.name IN (SELECT name FROM r)) THEN 21 ELSE 1 END AS score FROM h")
def exact_name_colocated(s, d):
    return Q.exact_colocated(nodes(s, d, "name", "file_path"), ["logDebug", "logWarn", "invariant", "Container", "lookup"])


@query(f"WITH {N} SELECT id, name FROM n WHERE contains(lower(name), 'digest') AND NOT starts_with(lower(name), 'digest') ORDER BY length(name), name, id LIMIT 100")
def name_substring(s, d):
    n = F.lower("name")
    return nodes(s, d, "name").where(n.contains("digest") & ~n.startswith("digest")).orderBy(F.length("name"), "name", "id").limit(100)


_VOC = r"""v AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), x -> length(x) BETWEEN 2 AND 32 AND NOT regexp_full_match(x, '[0-9]+'))) AS segment, name FROM n WHERE kind NOT IN ('file', 'import'))""".replace("x ->", "lambda x:")


@query(f"WITH {N}, {_VOC} SELECT segment, count(*) AS n_names, min(name) AS first_name FROM v GROUP BY 1")
def segment_vocab(s, d):
    return Q.vocabulary(nodes(s, d, "kind", "name")).groupBy("segment").agg(F.count(F.lit(1)).alias("n_names"), F.min("name").alias("first_name"))


@query(f"WITH {N}, {_VOC}, w AS (SELECT * FROM (VALUES ('snapshot', 'snapshots'), ('cached', 'cached'), ('route', 'routes')) AS t(segment, word)) SELECT name, count(DISTINCT word) AS n_words FROM v JOIN w USING (segment) GROUP BY 1 HAVING count(DISTINCT word) >= 2")
def segment_cooccurrence(s, d):
    return Q.co_occurrence(Q.vocabulary(nodes(s, d, "kind", "name")), [("snapshot", "snapshots"), ("cached", "cached"), ("route", "routes")], 2)


@query(f"WITH {N}, {_VOC}, c AS (SELECT segment, count(*) AS n_names FROM v WHERE length(segment) >= 5 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 25) SELECT * FROM c")
def segment_rarity(s, d):
    v = Q.vocabulary(nodes(s, d, "kind", "name")).where(F.length("segment") >= 5)
    return v.groupBy("segment").agg(F.count(F.lit(1)).alias("n_names")).where("n_names between 2 and 25")


def _tok(c):
    return f"list_filter(string_split_regex(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


@query(f"""WITH {N}, p AS (SELECT id, unnest(list_concat(list_transform({_tok('docstring')}, lambda t: {{'t': t, 'w': 1}}), list_transform({_tok('name')}, lambda t: {{'t': t, 'w': 20}}), list_transform({_tok('qualified_name')}, lambda t: {{'t': t, 'w': 5}}), list_transform({_tok('signature')}, lambda t: {{'t': t, 'w': 2}}))) AS x FROM n),
l AS (SELECT n.id, count(p.x) AS length FROM n LEFT JOIN p USING (id) GROUP BY 1), z AS (SELECT count(*) AS total, avg(length) AS mean FROM l), h AS (SELECT p.id, q, sum(x.w)::DOUBLE AS wtf FROM p, (VALUES ('log'), ('schema'), ('oldest')) AS k(q) WHERE starts_with(x.t, q) GROUP BY 1, 2), f AS (SELECT q, count(*) AS df FROM h GROUP BY 1)
SELECT h.id, round(sum(greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * wtf * 2.2 / (wtf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM h JOIN f USING (q) JOIN l ON l.id = h.id, z GROUP BY 1""")
def bm25_prefix(s, d):
    return Q.bm25(nodes(s, d, "name", "qualified_name", "docstring", "signature"), ["log", "schema", "oldest"])


@query(f"WITH {N} SELECT id, CASE WHEN lower(name) = 'cacheindex' THEN 80 WHEN lower(name) IN ('cache', 'index') THEN 60 WHEN starts_with(lower(name), 'cacheindex') THEN CAST(floor(10 + 30.0 * 10 / length(name) + 0.5) AS INTEGER) WHEN contains(lower(name), 'cache') AND contains(lower(name), 'index') THEN 15 WHEN contains(lower(name), 'cacheindex') THEN 10 ELSE 0 END AS bonus FROM n")
def name_match_bonus(s, d):
    return nodes(s, d, "name").select("id", names.name_match_bonus(F.col("name"), "cache index").alias("bonus"))


@query(f"WITH {N}, p AS (SELECT DISTINCT file_path AS p FROM n) SELECT p AS path, (CASE WHEN contains(lower(regexp_extract(p, '[^/]*$')), 'cache') THEN 10 ELSE 0 END + CASE WHEN contains(lower(regexp_replace(p, '/?[^/]*$', '')), 'cache') THEN 5 WHEN contains(lower(p), 'cache') THEN 3 ELSE 0 END + CASE WHEN contains(lower(regexp_extract(p, '[^/]*$')), 'store') THEN 10 ELSE 0 END + CASE WHEN contains(lower(regexp_replace(p, '/?[^/]*$', '')), 'store') THEN 5 WHEN contains(lower(p), 'store') THEN 3 ELSE 0 END - CASE WHEN {_TEST.format('p')} THEN 15 ELSE 0 END) AS score FROM p")
def path_relevance(s, d):
    return nodes(s, d, "file_path").select(F.col("file_path").alias("path")).distinct().select("path", names.path_relevance(F.col("path"), "cache store").alias("score"))


_RANKQ = ["oldest", "cached", "route"]
_P = "lower(file_path)"
_PATHREL = " + ".join(f"CASE WHEN contains(regexp_extract({_P}, '[^/]*$'), '{w}') THEN 10 ELSE 0 END + CASE WHEN contains(regexp_replace({_P}, '/?[^/]*$', ''), '{w}') THEN 5 WHEN contains({_P}, '{w}') THEN 3 ELSE 0 END" for w in _RANKQ)
_NAMEB = "CASE WHEN lower(name) = 'oldestcachedroute' THEN 80 WHEN lower(name) IN ('oldest', 'cached', 'route') THEN 60 WHEN starts_with(lower(name), 'oldestcachedroute') THEN CAST(floor(10 + 30.0 * 17 / length(name) + 0.5) AS INTEGER) WHEN contains(lower(name), 'oldest') AND contains(lower(name), 'cached') AND contains(lower(name), 'route') THEN 15 WHEN contains(lower(name), 'oldestcachedroute') THEN 10 ELSE 0 END"
_KINDB = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in KIND_BONUS.items()) + " ELSE 0 END"


def _bm25_sql(terms):
    return SQL["bm25_prefix"].replace("(VALUES ('log'), ('schema'), ('oldest'))", "(VALUES " + ", ".join(f"('{t}')" for t in terms) + ")")


@query(f"WITH {N}, b0 AS ({_bm25_sql(_RANKQ)}), x0 AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY lower(name) ORDER BY id) AS i FROM n WHERE lower(name) IN ('oldest', 'cached', 'route')) WHERE i <= 20), t AS (SELECT id, max(score) AS score FROM (SELECT * FROM b0 UNION ALL SELECT id, (SELECT max(score) FROM b0) FROM x0) GROUP BY 1) SELECT id, name, round(t.score + {_KINDB} + ({_PATHREL}) - CASE WHEN {_TEST.format('file_path')} THEN 15 ELSE 0 END + {_NAMEB}, 6) AS score FROM t JOIN n USING (id) ORDER BY score DESC, id LIMIT 50")
def search_ranked(s, d):
    return Q.ranked(nodes(s, d, "name", "qualified_name", "docstring", "signature", "kind", "file_path"), "oldest cached route", 50)


_STEMS = [  # (condition, letters cut off, letters added), over t of n letters
    ("ends_with(t, 'ing') AND n > 5", 3, ""), ("ends_with(t, 'ing') AND n > 5", 3, "e"), ("ends_with(t, 'ing') AND n > 5 AND t[n - 3] = t[n - 4]", 4, ""),
    ("(ends_with(t, 'tion') OR ends_with(t, 'sion')) AND n > 5", 3, ""), ("ends_with(t, 'ment') AND n > 6", 4, ""),
    ("ends_with(t, 'ies') AND n > 4", 3, "y"), ("ends_with(t, 'es') AND NOT ends_with(t, 'ies') AND n > 4", 2, ""), ("ends_with(t, 's') AND NOT ends_with(t, 'ss') AND NOT ends_with(t, 'es') AND n > 4", 1, ""),
    ("ends_with(t, 'ed') AND NOT ends_with(t, 'eed') AND n > 4", 1, ""), ("ends_with(t, 'ed') AND NOT ends_with(t, 'eed') AND n > 4", 2, ""), ("ends_with(t, 'ied') AND n > 5", 3, "y"),
    ("ends_with(t, 'er') AND n > 4", 2, ""), ("ends_with(t, 'er') AND n > 4", 2, "e"), ("ends_with(t, 'er') AND n > 4 AND t[n - 2] = t[n - 3]", 3, ""),
]
_STEM = ", ".join(f"CASE WHEN {c} THEN left(t, n - {k}) || '{a}' END" for c, k, a in _STEMS)
_ES = "regexp_matches(t, '(x|sh|ss|zz|ch|s|z|o)es$')"
_LOOK = f"[t, CASE WHEN {_ES} AND n >= 6 THEN left(t, n - 2) END, CASE WHEN (regexp_matches(t, '(ch|s|z|o)es$') AND NOT regexp_matches(t, '(x|sh|ss|zz)es$') OR regexp_matches(t, '[^s]s$') AND NOT {_ES}) AND n >= 5 THEN left(t, n - 1) END]"


@query(f"WITH {N}, w AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) BETWEEN 2 AND 32 AND NOT regexp_full_match(x, '[0-9]+'))) AS t FROM n), x AS (SELECT t, length(t) AS n FROM w) SELECT t AS word, array_to_string(list_sort(list_distinct(list_filter([{_STEM}], lambda v: v IS NOT NULL AND length(v) >= 3 AND v <> t))), ',') AS stems, array_to_string(list_filter({_LOOK}, lambda v: v IS NOT NULL), ',') AS lookups FROM x")
def stem_variants(s, d):
    return nodes(s, d, "name").select(F.explode(names.segments(F.col("name"))).alias("word")).distinct().select("word", F.array_join(names.stem_variants(F.col("word")), ",").alias("stems"), F.array_join(names.lookup_variants(F.col("word")), ",").alias("lookups"))
