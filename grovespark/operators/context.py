"""Retrieval for a question: entry symbols by several channels, what hangs together with them, and files in order.

The question is one text, so its words become conditions on columns; symbols stay in tables from the first channel to the
last cap. Every limit below is a parameter of the retrieval, as in the engine whose ranking this follows, and is applied
with a total order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovespark.functions import kinds, names, paths, querytext
from grovespark.operators import algorithms, relational, search, traversal
from grovespark.session import cut

DEFINITIONS = ["class", "interface", "struct", "trait", "protocol", "enum", "type_alias"]
HIERARCHY = ["class", "interface", "struct", "trait", "protocol"]
RECOVERED = ["calls", "extends", "implements", "references", "overrides"]


def _top(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.desc("score"), "id").limit(n)


def _title(word: str) -> str:
    return word[:1].upper() + word[1:].lower()


def exact_channel(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, score): symbols named in the query; 20 more for each other named symbol of their file."""
    wanted = querytext.symbols(query)
    if not wanted:
        return nodes.where("false").select("id", F.lit(0.0).alias("score"))
    hit = search.exact_colocated(nodes, wanted).join(nodes.select("id", "file_path"), "id")
    per = hit.groupBy("file_path").agg(F.count_distinct("name").alias("k"))
    return _top(hit.join(per, "file_path").select("id", (F.col("score") + (F.col("k") - 1) * 20).cast("double").alias("score")), 2 * limit)


def definition_channel(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, score): types whose name begins with a word of the query or one of its stems; shorter names first."""
    words = querytext.symbols(query)
    stems = nodes.sparkSession.createDataFrame([(w,) for w in words], "w string").select(F.explode(names.stem_variants(F.col("w"))).alias("s")).collect() if words else []
    titles = list(dict.fromkeys(_title(w) for w in [*words, *(r.s for r in stems)]))
    parts = []
    for t in titles:
        hit = nodes.where(F.col("kind").isin(DEFINITIONS) & F.lower("name").startswith(t.lower()))
        score = 0.9 + kinds.kind_bonus(F.col("kind")) + names.name_match_bonus(F.col("name"), t) + 15 + F.greatest(F.lit(0.0), 10 - (F.length("name") - len(t)) / 3)
        parts.append(_top(hit.select("id", score.alias("score")), limit))
    return reduce(DataFrame.unionByName, parts) if parts else nodes.where("false").select("id", F.lit(0.0).alias("score"))


def text_channel(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, score): text search for each term; a symbol's best score, and 5 for each further term that finds it."""
    terms = names.search_terms(query)
    parts = [search.bm25(nodes, [t]).select("id", F.lit(t).alias("term"), "score") for t in terms]
    if not parts:
        return nodes.where("false").select("id", F.lit(0.0).alias("score"))
    hit = reduce(DataFrame.unionByName, parts).join(nodes.select("id", "name", "kind", "file_path"), "id")
    bonus = reduce(lambda c, t: F.when(F.col("term") == t, names.name_match_bonus(F.col("name"), t) + names.path_relevance(F.col("file_path"), t)).otherwise(c), terms, F.lit(0))
    hit = hit.withColumn("score", F.col("score") + kinds.kind_bonus(F.col("kind")) + bonus)
    return _top(hit.groupBy("id").agg((F.max("score") + (F.count(F.lit(1)) - 1) * 5).alias("score")), 2 * limit)


def hump_channel(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """(id, score): types that have a word of the query as a hump inside their name, more for several words; and those whose
    name is made of two words and more of the query."""
    titles = [t for t in dict.fromkeys(map(_title, querytext.symbols(query))) if len(t) >= 3]
    if not titles:
        return nodes.where("false").select("id", F.lit(0.0).alias("score"))
    test = F.lit("test" in query.lower() or "spec" in query.lower()) | ~paths.is_test(F.col("file_path"))
    d = nodes.where(F.col("kind").isin(DEFINITIONS) & test)
    hump = lambda t: F.col("name").rlike(f"[a-zA-Z]{t}")
    each = F.array_compact(F.array(*[F.when(hump(t), F.greatest(F.lit(0.0), 6 - (F.length("name") - len(t)) / 4)) for t in titles]))
    n, path = F.size("b"), names.path_relevance(F.col("file_path"), query)
    inner = d.withColumn("b", each).where(F.size("b") > 0).select("id", ((8 + F.array_max("b") + path) * (1 + n) + (n - 1) * 30).alias("score"))
    there = F.size(F.array_compact(F.array(*[F.when(F.lower("name").contains(t.lower()), 1) for t in titles])))
    both = d.withColumn("n", there).where("n >= 2").select("id", (10 + (F.col("n") - 1) * 20 + path + F.greatest(F.lit(0.0), 6 - F.length("name") / 8)).alias("score"))
    return _top(inner, limit).unionByName(_top(both, -(-limit // 2)))


def to_definitions(hits: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, score): hits on imports and exports replaced by what these lead to, with the better score of several; those that
    lead nowhere are dropped."""
    k = hits.join(nodes.select("id", "kind"), "id")
    plain = k.where(~F.col("kind").isin("import", "export")).select("id", "score")
    e = edges.where("kind in ('imports', 'exports')").select("source", "target", F.col("kind").alias("_e")).distinct()
    led = k.where(F.col("kind").isin("import", "export")).join(e, (F.col("id") == F.col("source")) & (F.col("_e") == F.concat("kind", F.lit("s")))).select(F.col("target").alias("id"), "score")
    return plain.unionByName(led.join(nodes.select("id"), "id", "left_semi")).groupBy("id").agg(F.max("score").alias("score"))


def boosted(hits: DataFrame, nodes: DataFrame, exact: DataFrame, query: str) -> DataFrame:
    """(id, score): tests count 0.3; of queries with several groups of terms, symbols that match k >= 2 groups by name or
    folder count 1 + k / 2, distinctive names written out keep their score, other exact hits count 0.3, the rest 0.6."""
    h = hits.join(nodes.select("id", "name", "file_path"), "id").join(exact.select("id", F.lit(True).alias("exact")), "id", "left")
    low = query.lower()
    if "test" not in low and "spec" not in low:
        h = h.withColumn("score", F.when(paths.is_test(F.col("file_path")), F.col("score") * 0.3).otherwise(F.col("score")))
    groups = querytext.term_groups(names.search_terms(query))
    if sum(map(len, groups)) < 2:
        return h.select("id", "score")
    name, folder = F.lower("name"), F.split(F.lower(paths.dirname(F.col("file_path"))), "/")
    one = lambda g: reduce(Column.__or__, [name.contains(t) | F.array_contains(folder, t) for t in g])
    k = sum((one(g).cast("int") for g in groups), F.lit(0))
    special = [s.lower() for s in querytext.symbols(query) if any(c in "_0123456789" for c in s) or any(c.isupper() for c in s[1:])]
    known = F.coalesce("exact", F.lit(False))
    factor = F.when(k >= 2, 1 + k * 0.5).when(known & name.isin(special or [""]), 1.0).when(known, 0.3).otherwise(0.6)
    return h.select("id", (F.col("score") * factor).alias("score"))


def entry_points(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 3, least: float = 0.3) -> DataFrame:
    """(id, score): where a question leads. All channels, one score per symbol (the greatest), weighed by `boosted`; 25 more in
    the folder of a file that dominates the project; the best 3 * limit are resolved to definitions, the best `limit` stay."""
    exact = cut(exact_channel(nodes, query, limit).unionByName(definition_channel(nodes, query, limit)).groupBy("id").agg(F.max("score").alias("score")))
    first = exact.unionByName(text_channel(nodes, query, limit)).groupBy("id").agg(F.max("score").alias("score"))
    core = relational.dominant_file(nodes, edges).where("edge_count >= 3 * next_edge_count").select(F.regexp_replace("file_path", "[^/]*$", "").alias("_core")).where("_core <> ''")
    where = core.collect()  # one row at most
    if where:
        first = first.join(nodes.select("id", "file_path"), "id").select("id", (F.col("score") + F.when(F.col("file_path").startswith(where[0]["_core"]), 25).otherwise(0)).alias("score"))
    ranked = cut(boosted(first, nodes, exact, query))
    extra = hump_channel(nodes, query, limit).join(ranked.select("id"), "id", "left_anti").groupBy("id").agg(F.max("score").alias("score"))
    best = _top(ranked.unionByName(extra), 3 * limit).where(F.col("score") >= least)
    return cut(_top(to_definitions(best, nodes, edges), limit))


def confident(entries: DataFrame, nodes: DataFrame, query: str) -> bool:
    """False if a query of two terms and more found no symbol that is written out or that two terms point to."""
    terms = [t for t in names.search_terms(query) if len(t) >= 3]
    if len(terms) < 2 or entries.isEmpty():
        return True
    name, folder = F.lower("name"), F.split(F.lower(paths.dirname(F.col("file_path"))), "/")
    hits = sum(((name.contains(t) | F.array_contains(folder, t)).cast("int") for t in terms), F.lit(0))
    special = [s.lower() for s in querytext.symbols(query) if any(c in "_0123456789" for c in s) or any(c.isupper() for c in s[1:])]
    return not entries.join(nodes, "id").where((hits >= 2) | name.isin(special or [""])).isEmpty()


def non_production_cap(df: DataFrame, most: int) -> DataFrame:
    """Rows with `file_path`, of which tests only the first `most` by (rank, id)."""
    test = paths.is_test(F.col("file_path"))
    few = df.where(test).orderBy("rank", "id").limit(most)
    return df.where(~test).unionByName(few)


def find_context(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 3, max_nodes: int = 20, depth: int = 1, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, score, root, rank) and edges (source, target, kind) that a question is about.

    Entry points; their type hierarchies, up to a quarter of `max_nodes`; what lies within `depth` steps either way of each,
    `max_nodes` shared among them. Of all that, entry points first, then their neighbours, then the rest, `max_nodes` are
    kept; at most max(5, 20 %) of a file, types before members; at most max(3, 15 %) from tests unless the question is
    about them. All edges of the RECOVERED kinds between kept nodes come along. An empty query gives nothing.
    """
    if not query.strip():
        return nodes.where("false").select("id", F.lit(0.0).alias("score"), F.lit(False).alias("root"), F.lit(0).alias("rank")), edges.where("false").select("source", "target", "kind")
    entries = entry_points(nodes, edges, query, limit, least)
    n_roots = max(1, entries.count())
    seeds = entries.select(F.col("id").alias("seed"))
    types = seeds.join(nodes.where(F.col("kind").isin(HIERARCHY)).select(F.col("id").alias("seed")), "seed", "left_semi")
    family = traversal.type_hierarchy(types, edges).join(nodes.select("id"), "id", "left_semi")
    family = family.groupBy("id").agg(F.min(F.abs("depth")).alias("d")).orderBy("d", "id").limit(-(-max_nodes // 4))
    near, _ = traversal.subgraph(seeds, nodes, edges, "both", max_depth=depth, limit=-(-max_nodes // n_roots))
    every = entries.select("id", F.lit(0).alias("rank")).unionByName(near.select("id", (F.col("depth") + 1).alias("rank"))).unionByName(family.select("id", F.lit(3).alias("rank"))).groupBy("id").agg(F.min("rank").alias("rank"))
    kept = every.join(nodes.select("id", "kind", "file_path"), "id").orderBy("rank", "id").limit(max_nodes)
    prio = F.when(F.col("rank") == 0, 10).otherwise(0) + F.when(F.col("kind").isin("class", "interface", "struct", "trait", "protocol", "enum"), 3).when(F.col("kind").isin("method", "function"), 1).otherwise(0)
    kept = relational.capped(kept.withColumn("_p", prio), "file_path", [F.desc("_p"), F.asc("rank"), F.asc("id")], max(5, -(-max_nodes // 5))).drop("_p")
    if "test" not in query.lower() and "spec" not in query.lower():
        kept = non_production_cap(kept, max(3, -(-max_nodes * 15 // 100)))
    kept = cut(kept.join(entries, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"), (F.col("rank") == 0).alias("root"), "rank"))
    inside = relational.attached(edges.where(F.col("kind").isin(RECOVERED)), kept).select("source", "target", "kind").distinct()
    return kept, inside


def ranked_files(context: DataFrame, nodes: DataFrame, edges: DataFrame, query: str, gate: float = 0.06) -> DataFrame:
    """(file_path, place, named, relevance, n_terms, score): files of a context in the order they are worth reading.

    A node gives its file 50 as an entry point, 10 next to one, 3 and 1 further away. Relevance is a random walk from the
    entry points over the edges between files of the context; files under `gate` of the greatest are dropped unless they
    hold a named symbol. Order: named first, then relevance in steps of one hundredth of the greatest, then terms of the
    query in the path or names, then tests and other low-value files last, generated ones last, score, path.
    """
    c = context.join(nodes.select("id", "name", "file_path"), "id")
    c = c.withColumn("_s", F.when(F.col("rank") == 0, 50).when(F.col("rank") == 1, 10).when(F.col("rank") == 2, 3).otherwise(1))
    terms = names.search_terms(query)
    said = [s.lower() for s in querytext.symbols(query)]
    hits = sum((F.max((F.lower("name").contains(t) | F.lower("file_path").contains(t)).cast("int")) for t in terms), F.lit(0))
    per = cut(c.groupBy("file_path").agg(F.sum("_s").alias("score"), F.max(F.lower("name").isin(said or [""])).alias("named"), hits.alias("n_terms"), F.max("root").alias("root")))
    at = c.select("id", "file_path")
    e = relational.attached(edges.where("kind <> 'contains'"), c.select("id"))
    links = e.join(at.select(F.col("id").alias("source"), F.col("file_path").alias("a")), "source").join(at.select(F.col("id").alias("target"), F.col("file_path").alias("b")), "target").select("a", "b")
    walk = algorithms.random_walk(per.where("root").select(F.col("file_path").alias("id")), links).select(F.col("id").alias("file_path"), F.col("score").alias("relevance"))
    f = per.join(walk, "file_path", "left").withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))
    top = F.max("relevance").over(W.partitionBy())  # one row a file of the context, of which there are few
    f = f.withColumn("_top", top).where(F.col("named") | (F.col("relevance") >= gate * F.col("_top")))
    step = F.floor(F.col("relevance") / F.greatest(F.col("_top") * 0.01, F.lit(1e-12)))
    order = [F.desc("named"), F.desc(step), F.desc("n_terms"), F.asc(paths.is_low_value(F.col("file_path"))), F.asc(paths.is_generated(F.col("file_path"))), F.desc("score"), F.asc("file_path")]
    return f.withColumn("place", F.row_number().over(W.partitionBy().orderBy(*order))).select("file_path", "place", "named", F.round("relevance", 6).alias("relevance"), "n_terms", "score")


def code_of(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, code): the lines of each node from its file's content (path, content); values of configuration leaves are never
    shown. Nodes without a file or a span are left out."""
    n = nodes.where(~kinds.is_config_leaf(F.col("kind"), F.col("language")) & (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")))
    n = n.select("id", "file_path", "start_line", "end_line")
    j = n.join(files.select(F.col("path").alias("file_path"), F.split("content", "\n").alias("_l")), "file_path").where(F.col("start_line") <= F.size("_l"))
    return j.select("id", F.array_join(F.slice("_l", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("code"))


def code_blocks(context: DataFrame, nodes: DataFrame, files: DataFrame, most: int = 5, most_chars: int = 1500) -> DataFrame:
    """(id, place, code, cut_off): code of a context's entry points, then functions and methods, then classes, the first `most`;
    longer pieces are cut and say so."""
    order = F.when(F.col("root"), 0).when(F.col("kind").isin("function", "method"), 1).when(F.col("kind") == "class", 2)
    c = context.join(nodes.select("id", "kind"), "id").withColumn("_o", order).where("_o is not null")
    code = c.join(code_of(nodes, files), "id").orderBy("_o", "rank", "id").limit(most)
    place = F.row_number().over(W.partitionBy().orderBy("_o", "rank", "id"))
    return code.select("id", place.alias("place"), F.substring("code", 1, most_chars).alias("code"), (F.length("code") > most_chars).alias("cut_off"))


def summary(context: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, n_files, entry_names): sizes of a context and the names of its three best entry points."""
    c = context.join(nodes.select("id", "name", "file_path"), "id")
    best = c.where("root").orderBy(F.desc("score"), "id").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "name"))), lambda x: x["name"]), ", ").alias("names"))
    return c.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("file_path").alias("n_files")).select("n_nodes", edges.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_edges"), "n_files", best.scalar().alias("entry_names"))


def outline(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, place, member, kind, start_line): members of every container in order of place."""
    inside = edges.where("kind = 'contains'").select(F.col("source").alias("id"), F.col("target").alias("member")).distinct()
    m = inside.join(nodes.select(F.col("id").alias("member"), "kind", "name", "start_line"), "member")
    return m.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy("start_line", "member"))).select("id", "place", "member", "kind", "start_line")


def trail(nodes: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """(id, way, other): up to `most` distinct callers ('in') and callees ('out') of each node, by name and id. Hot targets are
    thinned before they meet names: only the least ids of each side go on."""
    e = edges.where("kind = 'calls' and source <> target").select("source", "target").distinct()
    both = e.select(F.col("target").alias("id"), F.lit("in").alias("way"), F.col("source").alias("other")).unionByName(e.select(F.col("source").alias("id"), F.lit("out").alias("way"), F.col("target").alias("other")))
    both = both.join(nodes.select(F.col("id").alias("other")), "other", "left_semi")
    w = W.partitionBy("id", "way").orderBy("other")
    return both.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).select("id", "way", "other")
