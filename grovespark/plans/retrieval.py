"""Queries of retrieval, planning and overviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovespark.operators import algorithms as G
from grovespark.operators import context as K
from grovespark.operators import planning as P
from grovespark.operators import search as Q
from grovespark.operators import store as S
from grovespark.operators import traversal as T
from grovespark.plans.common import E, F_, N, edges, files, nodes
from grovespark.plans.graph import _FE, _ML, _PKG, _VOC, _XF, _file_links, module_links, package
from grovespark.plans.graph import SQL as GRAPH_SQL
from grovespark.session import cut
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


_TEXT = ("kind", "name", "qualified_name", "docstring", "signature", "file_path", "language")
QUESTION = "how does the snapshot cache of the render session resolve an outdated route"


@query()
def context_nodes(s, d):
    """What a question is about: entry points and what hangs together with them."""
    return K.find_context(nodes(s, d, *_TEXT), edges(s, d), QUESTION)[0]


@query()
def context_edges(s, d):
    return K.find_context(nodes(s, d, *_TEXT), edges(s, d), QUESTION)[1]


@query()
def explore_files(s, d):
    """Files worth reading for a question, in order."""
    n, e = nodes(s, d, *_TEXT), edges(s, d)
    return K.ranked_files(K.find_context(n, e, QUESTION, max_nodes=50)[0], n, e, QUESTION)


@query(f"""WITH RECURSIVE {N}, {E}, k AS (SELECT id FROM n WHERE starts_with(name, 'load') OR starts_with(name, 'build')), h AS (SELECT DISTINCT source AS a, target AS b, target IN (SELECT id FROM k) AS known FROM e WHERE kind = 'calls' AND source <> target),
r AS (SELECT id, [id] AS way, 0 AS gap, 1 AS n_named FROM k UNION ALL SELECT h.b, list_append(r.way, h.b), CASE WHEN known THEN 0 ELSE gap + 1 END, n_named + known::INT FROM r JOIN h ON h.a = r.id WHERE len(r.way) <= 7 AND NOT list_contains(r.way, h.b) AND (known OR gap = 0))
SELECT array_to_string(way, ' > ') AS path, n_named, CAST(len(way) - 1 AS INTEGER) AS length FROM r WHERE gap = 0 AND len(way) > 1 ORDER BY n_named DESC, length, path LIMIT 3""")
def named_flows(s, d):
    """The longest chains of calls among symbols that load or build something."""
    n = nodes(s, d, "name").where(F.col("name").startswith("load") | F.col("name").startswith("build"))
    return T.named_flow(n, edges(s, d))


@query()
def depth_first_walks(s, d):
    from grovespark.plans.common import picked

    return T.depth_first(nodes(s, d).where(picked()).select(F.col("id").alias("seed")), nodes(s, d, "kind"), edges(s, d), max_depth=3)


@query(f"WITH {N}, {_VOC}, w AS (SELECT * FROM (VALUES ('snapshots', 'snapshots'), ('snapshots', 'snapshot'), ('cached', 'cached'), ('routes', 'routes'), ('routes', 'route')) AS t(word, segment)) SELECT name, CAST(count(DISTINCT word) AS INTEGER) AS n_words, 1 AS tier FROM v JOIN w USING (segment) GROUP BY 1 HAVING count(DISTINCT word) >= 2 ORDER BY 2 DESC, length(name), name LIMIT 6")
def segment_matches(s, d):
    return Q.segment_matches(Q.vocabulary(nodes(s, d, "kind", "name")), ["snapshots", "cached", "routes"])


@query(f"WITH {N}, {_VOC}, h AS (SELECT * FROM v WHERE segment = 'oldest'), r AS (SELECT count(DISTINCT name) AS k FROM h), m AS (SELECT name, count(DISTINCT segment) AS k FROM v GROUP BY 1) SELECT DISTINCT h.name, 1 AS n_words, 2 AS tier FROM h JOIN m USING (name), r WHERE r.k BETWEEN 2 AND 25 AND m.k >= 2 ORDER BY length(h.name), h.name LIMIT 6")
def segment_matches_rare(s, d):
    return Q.segment_matches(Q.vocabulary(nodes(s, d, "kind", "name")), ["oldest"])


_FEW = N.replace("n AS (", "n0 AS (", 1) + ", n AS (SELECT * FROM n0 WHERE kind IN ('function', 'method'))"


@query(f"WITH {N}, r AS ({GRAPH_SQL['search_ranked'].replace(N, _FEW).replace('LIMIT 50', 'LIMIT 200')}) SELECT r.* FROM r JOIN n USING (id) WHERE contains(lower(n.file_path), 'src')".replace("SELECT r.* FROM r JOIN n USING (id)", "SELECT r.id, r.name, r.score FROM r JOIN n USING (id)"))
def search_filtered(s, d):
    return Q.filtered(nodes(s, d, *_TEXT), "kind:method kind:function path:src oldest cached route", 200)


@query(f"WITH {N}, k AS (SELECT id, name, file_path, row_number() OVER (ORDER BY name, id) AS r FROM n WHERE kind = 'class' AND language IN ('python', 'go')) SELECT id, name, 1.0::DOUBLE AS score FROM k WHERE r <= 500 AND contains(lower(file_path), 'src') AND contains(lower(name), 'cache')")
def search_by_filters(s, d):
    return Q.filtered(nodes(s, d, *_TEXT), "kind:class lang:python language:go path:src name:cache", 500)


@query(f"WITH {N}, {E}, b AS (SELECT DISTINCT target AS id, 'in' AS way, source AS other FROM e WHERE kind = 'calls' AND source <> target UNION SELECT DISTINCT source, 'out', target FROM e WHERE kind = 'calls' AND source <> target), k AS (SELECT b.*, row_number() OVER (PARTITION BY b.id, way ORDER BY other) AS i FROM b JOIN n ON n.id = b.other) SELECT id, way, other FROM k WHERE i <= 12")
def call_trails(s, d):
    return K.trail(nodes(s, d), edges(s, d))


@query(f"WITH {N}, {E}, m AS (SELECT DISTINCT e.source AS id, n.id AS member, n.kind, n.start_line FROM e JOIN n ON n.id = e.target WHERE e.kind = 'contains') SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY start_line, member) AS INTEGER) AS place, member, kind, start_line FROM m")
def container_outline(s, d):
    return K.outline(nodes(s, d, "kind", "name", "start_line"), edges(s, d))


@query(f"WITH {N}, {E}, m AS (SELECT id, name, language, CASE WHEN len(string_split_regex(qualified_name, '::|[.]')) > 1 THEN string_split_regex(qualified_name, '::|[.]')[-2] END AS cls FROM n WHERE kind = 'method'), u AS (SELECT DISTINCT a.name AS cls, a.language, b.name AS supertype FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE e.kind IN ('extends', 'implements')) SELECT m.name, supertype, count(DISTINCT m.id) AS n_members, count(DISTINCT cls) AS n_classes FROM m JOIN u USING (cls, language) GROUP BY 1, 2 HAVING count(DISTINCT cls) >= 2")
def method_families(s, d):
    """Methods of one name in two classes and more that share a supertype."""
    return T.polymorphic_families(nodes(s, d, "kind", "name", "qualified_name", "language"), edges(s, d), 2)


@query(f"WITH {N}, {E}, {_FE}, p AS (SELECT DISTINCT source_file AS id FROM x UNION SELECT DISTINCT target_file FROM x), c AS (SELECT id, split_part(id, '/', 1) AS community, {_PKG.format('id')} AS module FROM p), t AS (SELECT community, module AS primary_module FROM (SELECT community, module, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, module) AS r FROM c GROUP BY 1, 2) WHERE r = 1), l AS (SELECT DISTINCT least(source_file, target_file) AS a, greatest(source_file, target_file) AS b FROM x), g AS (SELECT id, count(*) AS deg FROM (SELECT a AS id, b AS o FROM l UNION ALL SELECT b, a FROM l) WHERE split_part(id, '/', 1) = split_part(o, '/', 1) GROUP BY 1), k AS (SELECT c.community, c.id, t.primary_module, row_number() OVER (PARTITION BY c.community ORDER BY coalesce(deg, 0) DESC, c.id) AS r FROM c JOIN t USING (community) LEFT JOIN g USING (id) WHERE c.module = t.primary_module) SELECT community, id AS hub, primary_module FROM k WHERE r = 1")
def repository_hubs(s, d):
    """The best linked file of each repository's largest package."""
    links = _file_links(s, d)
    ids = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    return G.hubs(ids.select("id", F.split_part("id", F.lit("/"), F.lit(1)).alias("community")), links, ids.select("id", package(F.col("id")).alias("module")))


@query(f"WITH RECURSIVE c0 AS ({GRAPH_SQL['module_waves_condensed']}), {N}, {E}, {_XF}, {_ML}, z AS (SELECT {_PKG.format('file_path')} AS unit, count(*) AS size FROM n GROUP BY 1) SELECT c0.id AS unit, CAST(row_number() OVER (ORDER BY wave, size DESC, c0.id) - 1 AS INTEGER) AS place, wave FROM c0 JOIN z ON z.unit = c0.id")
def unit_order(s, d):
    """Packages in an order in which each comes after what it depends on."""
    m = cut(module_links(s, d))
    linked = m.select(F.col("a").alias("unit")).unionByName(m.select(F.col("b").alias("unit"))).distinct()
    size = nodes(s, d, "file_path").groupBy(package(F.col("file_path")).alias("unit")).agg(F.count(F.lit(1)).alias("size"))
    return P.order_units(size.join(linked, "unit", "left_semi"), m)


@query(f"WITH {N}, {E}, {_XF}, {_ML} SELECT DISTINCT split_part(a, '/', 1) AS a, split_part(b, '/', 1) AS b FROM m WHERE split_part(a, '/', 1) <> split_part(b, '/', 1)")
def unit_dependency_pairs(s, d):
    """Repositories that depend on others through their packages."""
    m = module_links(s, d)
    mods = m.select(F.col("a").alias("module")).unionByName(m.select(F.col("b").alias("module"))).distinct()
    return P.unit_dependencies(mods.select(F.split_part("module", F.lit("/"), F.lit(1)).alias("unit"), "module"), m)


_SQZ = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"


@query(f"""WITH {N}, m AS (SELECT DISTINCT split_part({_PKG.format('file_path')}, '/', -1) AS module, name FROM n WHERE is_exported AND kind IN ('class', 'interface')), x AS (SELECT DISTINCT file_path AS file, lower(name) AS k FROM n WHERE kind IN ('function', 'type_alias', 'constant')), ff AS (SELECT DISTINCT file FROM x),
sc AS (SELECT module, CASE WHEN EXISTS (SELECT 1 FROM ff WHERE contains({_SQZ.format('file')}, {_SQZ.format('module')})) THEN 'module-path' ELSE 'global' END AS scope FROM (SELECT DISTINCT module FROM m)),
h AS (SELECT m.module, scope, name, CASE WHEN scope = 'global' THEN EXISTS (SELECT 1 FROM x WHERE x.k = lower(m.name)) ELSE EXISTS (SELECT 1 FROM x WHERE x.k = lower(m.name) AND contains({_SQZ.format('x.file')}, {_SQZ.format('m.module')})) END AS hit FROM m JOIN sc USING (module))
SELECT module, scope, count(*) AS source_count, count(*) FILTER (WHERE hit) AS matched_count, len(list(name) FILTER (WHERE NOT hit)) AS n_missing FROM h GROUP BY 1, 2""")
def package_fidelity(s, d):
    """Exported types of each package, looked for among functions, aliases and constants of files with its name in the path."""
    n = nodes(s, d, "kind", "name", "file_path", "is_exported")
    n = cut(n.where(F.col("kind").isin("class", "interface", "function", "type_alias", "constant")))
    members = n.where(F.col("is_exported") & F.col("kind").isin("class", "interface")).select(F.substring_index(package(F.col("file_path")), "/", -1).alias("module"), "name")
    exports = n.where(F.col("kind").isin("function", "type_alias", "constant")).select(F.col("file_path").alias("file"), "name")
    none = s.createDataFrame([], "module string, name string, new_name string, prefix string")
    got = P.interface_fidelity(members, exports, none.select("module", "name", "new_name"), none.select("module", "prefix"))
    return got.select("module", "scope", "source_count", "matched_count", F.nullif(F.size("missing"), F.lit(0)).cast("long").alias("n_missing"))


@query(f"WITH {N}, {E}, b AS (SELECT DISTINCT t.name AS iface, a.name AS impl FROM e JOIN n a ON a.id = e.source JOIN n t ON t.id = e.target WHERE e.kind = 'implements'), x AS (SELECT DISTINCT lower(name) AS k FROM n WHERE is_exported) SELECT iface, impl, (lower(iface) NOT IN (SELECT k FROM x))::INT + (lower(impl) NOT IN (SELECT k FROM x))::INT AS n_missing FROM b")
def implementation_gaps(s, d):
    """Interfaces and implementations of which an end is not exported anywhere."""
    n = nodes(s, d, "name", "is_exported")
    end = lambda c, to: n.select(F.col("id").alias(c), F.col("name").alias(to))
    b = edges(s, d).where("kind = 'implements'").join(end("source", "impl"), "source").join(end("target", "iface"), "target")
    return P.binding_gaps(b, n.where("is_exported").select("name")).select("iface", "impl", F.size("missing_ends").alias("n_missing"))


@query(f"WITH {N}, {E}, x AS (SELECT {_PKG.format('a.file_path')} AS a, {_PKG.format('b.file_path')} AS b, e.kind FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE e.kind <> 'contains') SELECT a, b, kind, count(*) AS n FROM x WHERE a <> b GROUP BY ALL")
def module_kind_deps(s, d):
    """Dependencies between packages by kind of edge."""
    n = nodes(s, d, "file_path").select("id", package(F.col("file_path")).alias("m"))
    e = edges(s, d).where("kind <> 'contains'").join(n.select(F.col("id").alias("source"), F.col("m").alias("a")), "source").groupBy("a", "target", "kind").agg(F.count(F.lit(1)).alias("n"))
    return e.join(n.select(F.col("id").alias("target"), F.col("m").alias("b")), "target").where("a <> b").groupBy("a", "b", "kind").agg(F.sum("n").alias("n"))


@query(f"WITH {N}, x AS (SELECT DISTINCT {_PKG.format('file_path')} AS module, kind AS facet, name AS subject, file_path AS detail FROM n WHERE is_exported), k AS (SELECT *, row_number() OVER (PARTITION BY module, facet ORDER BY subject, detail) AS i, count(*) OVER (PARTITION BY module, facet) AS n_facet FROM x) SELECT module, facet, CAST(i AS INTEGER) AS place, subject, detail, n_facet FROM k WHERE i <= 50")
def package_briefs(s, d):
    """What each package exports, by kind, fifty of each."""
    n = nodes(s, d, "kind", "name", "file_path", "is_exported").where("is_exported")
    return P.module_briefs(n.select(package(F.col("file_path")).alias("module"), F.col("kind").alias("facet"), F.col("name").alias("subject"), F.col("file_path").alias("detail")))


@query(f"WITH {N}, a AS (SELECT DISTINCT {_PKG.format('file_path')} AS module, name FROM n WHERE kind = 'function'), b AS (SELECT DISTINCT {_PKG.format('file_path')} AS module, name FROM n WHERE kind = 'function' AND is_exported) SELECT a.module, count(*) = count(b.name) AS same FROM a LEFT JOIN b ON b.module = a.module AND b.name = a.name GROUP BY 1")
def wholly_exported(s, d):
    """Packages all of whose functions are exported."""
    n = nodes(s, d, "kind", "name", "file_path", "is_exported").where("kind = 'function'").select(package(F.col("file_path")).alias("module"), "name", "is_exported")
    return P.same_members(n, n.where("is_exported"), "module", "name")


@query(f"WITH {F_}, o AS (SELECT path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY indexed_at, modified_at, content_hash NULLS FIRST) AS r FROM files WHERE indexed_at IS NOT NULL AND indexed_at <= TIMESTAMP '2025-04-01') WHERE r = 1 AND path NOT LIKE 'a%'), c AS (SELECT path, max(content_hash) AS content_hash FROM files WHERE path NOT LIKE 'b%' GROUP BY 1) SELECT coalesce(o.path, c.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' ELSE 'modified' END AS state FROM o FULL JOIN c ON o.path = c.path WHERE o.path IS NULL OR c.path IS NULL OR o.content_hash IS NULL OR o.content_hash IS DISTINCT FROM c.content_hash")
def changed_files(s, d):
    """Added, modified and removed files between two states of the log."""
    f = read(s, d, "files")
    old = f.where("indexed_at is not null and indexed_at <= timestamp_ntz'2025-04-01 00:00:00' and path not like 'a%'")
    old = old.groupBy("path").agg(F.min(F.struct("indexed_at", "modified_at", "content_hash")).alias("r")).select("path", "r.content_hash")
    return S.changed_files(old, f.where("path not like 'b%'").groupBy("path").agg(F.max("content_hash").alias("content_hash")))
