"""Queries of the overlay: languages, modules, roles, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovespark.operators import algorithms as G
from grovespark.operators import overlay as A
from grovespark.plans.common import E, F_, N, edges, files, nodes
from grovespark.plans.graph import _ML, _XF, module_links, package
from grovespark.plans.relational import PACKAGE_RE, _re
from grovespark.sources.tree import BY_EXTENSION, language_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LANG = "CASE lower(regexp_extract(path, '\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BY_EXTENSION.items()) + " END"
_PKG = f"CASE WHEN regexp_matches({{0}}, {_re(PACKAGE_RE)}) THEN regexp_extract({{0}}, {_re(PACKAGE_RE)}, 1) ELSE split_part({{0}}, '/', 1) END"


@query(f"WITH {F_} SELECT language, coalesce({_LANG}, '') AS by_extension, count(*) AS n FROM f GROUP BY 1, 2")
def language_by_extension(s, d):
    return files(s, d, "language").groupBy("language", F.coalesce(language_of(F.col("path")), F.lit("")).alias("by_extension")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {F_}, m AS (SELECT DISTINCT {_PKG.format('path')} AS k FROM f) SELECT substr(sha1(concat_ws(chr(0), 'code', 'module', k)), 1, 16) AS id, 'code' AS platform, 'module' AS kind, k AS match_key, k AS name FROM m")
def overlay_modules(s, d):
    m = files(s, d).select(package(F.col("path")).alias("match_key")).distinct()
    return A.overlay_nodes(m.select(F.lit("code").alias("platform"), F.lit("module").alias("kind"), "match_key", F.col("match_key").alias("name")))


@query(f"WITH {N}, {E}, {_XF}, {_ML}, d AS (SELECT a, b FROM m WHERE weight >= 10), j AS (SELECT coalesce(d.a, m.a) AS a, coalesce(d.b, m.b) AS b, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CASE WHEN d.a IS NULL THEN 'lifted' ELSE 'declared' END AS origin FROM d FULL JOIN m ON d.a = m.a AND d.b = m.b) SELECT j.*, (origin = 'lifted' AND EXISTS (SELECT 1 FROM d WHERE d.a = j.b AND d.b = j.a)) AS reversed FROM j")
def module_dependency_graph(s, d):
    """Strong dependencies stand for declared ones, since no build files are in the tables."""
    m = module_links(s, d)
    return A.declared_and_lifted(m.where("weight >= 10"), m)


_ROLE = "CASE " + " ".join(
    f"WHEN regexp_matches(coalesce(supers, ''), '{end}\\b') OR ends_with(name, '{end}')" + (f" OR regexp_matches(coalesce(marks, ''), '\\b({mark})\\b')" if mark else "") + f" THEN '{r}'"
    for r, end, mark in [("view-model", "ViewModel", ""), ("repository", "Repository", "Repository"), ("service", "Service", "Service|Injectable"), ("controller", "Controller", "RestController|Controller"), ("entity", "Entity", "Entity|Table"), ("adapter", "Adapter", "")]
) + " ELSE 'none' END"


@query(f"WITH {N}, {E}, s AS (SELECT e.source AS id, string_agg(DISTINCT t.name, ' ') AS supers FROM e JOIN n t ON t.id = e.target WHERE e.kind IN ('extends', 'implements') GROUP BY 1), c AS (SELECT {_PKG.format('file_path')} AS module, name, supers, array_to_string(decorators, ' ') AS marks FROM n LEFT JOIN s USING (id) WHERE n.kind = 'class') SELECT module, {_ROLE} AS role, count(*) AS n FROM c GROUP BY 1, 2")
def class_roles(s, d):
    """Roles of classes by supertypes, decorators and names."""
    n = nodes(s, d, "kind", "name", "decorators", "file_path")
    sup = edges(s, d).where("kind in ('extends', 'implements')").join(n.select(F.col("id").alias("target"), F.col("name").alias("super")), "target").groupBy(F.col("source").alias("id")).agg(F.collect_set("super").alias("supers"))
    c = n.where("kind = 'class'").join(sup, "id", "left")
    return c.select(package(F.col("file_path")).alias("module"), F.coalesce(A.role(F.col("name"), F.col("supers"), F.col("decorators")), F.lit("none")).alias("role")).groupBy("module", "role").agg(F.count(F.lit(1)).alias("n"))


@query()
def feature_overlay(s, d):
    """Communities of packages as features, with the repositories they span."""
    parts = G.louvain(module_links(s, d))
    return A.features(parts, parts.select("id", F.split_part("id", F.lit("/"), F.lit(1)).alias("module")))
