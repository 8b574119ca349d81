"""Linking unresolved references to symbols: a cascade of strategies as one plan.

Each strategy gives rows (ref, candidate, confidence, method, priority); the union is ranked once per reference. The
references that share a name with very many symbols are declined before they are paired, so no name makes a
quadratic join: pairs per reference are bounded by `ceiling`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.functions import builtins, kinds, paths
from grovespark.operators import calls, imports
from grovespark.session import cut

REF = ["from_node_id", "reference_name", "reference_kind", "line", "col", "file_path", "language"]
CALLABLE = ["function", "method"]


def keyed(refs: DataFrame) -> DataFrame:
    """Distinct references with a key; repeats count once. An empty path or the language `unknown` is kept as it is."""
    r = refs.select(*REF).distinct()
    return r.withColumn("ref", F.sha2(F.to_json(F.struct(*REF)), 256))


def possible(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References any part of whose name, or the base name of the path that it is, is a known symbol or file: an existence
    check before the strategies."""
    whole = F.array("reference_name", paths.basename(F.col("reference_name")))
    part = refs.select("ref", F.explode(F.array_distinct(F.concat(whole, F.split("reference_name", r"::|\.|/|\(")))).alias("name"))
    ok = part.join(nodes.select("name").distinct(), "name", "left_semi").select("ref").distinct()
    return refs.join(ok, "ref", "left_semi")


def candidates(refs: DataFrame, nodes: DataFrame, ceiling: int = 500) -> DataFrame:
    """Pairs of references and symbols of their name, by language rules, for names with at most `ceiling` symbols.

    References to types and to function values stay in their language family; imports do not cross two known families;
    calls may go anywhere. Names above the ceiling are declined, as any choice among so many would be a guess.
    """
    n = nodes.where(~F.col("kind").isin("file", "import")).select("id", F.col("name").alias("reference_name"), "kind", F.col("file_path").alias("c_file"), F.col("language").alias("c_language"), "is_exported", "start_line")
    few = n.groupBy("reference_name").count().where(F.col("count") <= ceiling).select("reference_name")
    j = refs.join(few, "reference_name", "left_semi").join(n, "reference_name").where("id <> from_node_id")
    strict = F.col("reference_kind").isin("references", "function_ref")
    fits = F.when(strict, kinds.same_family(F.col("language"), F.col("c_language"))).when(F.col("reference_kind") == "imports", ~kinds.crosses_known_family(F.col("language"), F.col("c_language"))).otherwise(True)
    return j.where(fits)


def score(c: DataFrame) -> DataFrame:
    """Adds `score`: same file 100, shared folders up to 80, language 50 or -80, kind 25, exported 10, near lines up to 20."""
    same_file = F.col("c_file") == F.col("file_path")
    kind = (
        F.when((F.col("reference_kind") == "calls") & F.col("kind").isin(CALLABLE), 25)
        .when((F.col("reference_kind") == "instantiates") & F.col("kind").isin("class", "struct", "interface"), 25)
        .when((F.col("reference_kind") == "decorates") & F.col("kind").isin(CALLABLE), 25)
        .when((F.col("reference_kind") == "decorates") & F.col("kind").isin("class", "interface"), 15)
        .otherwise(0)
    )
    near = F.when(same_file, F.greatest(F.lit(0.0), 20 - F.abs(F.col("start_line") - F.col("line")) / 10)).otherwise(0.0)
    total = (
        F.when(same_file, 100).otherwise(0)
        + paths.proximity(F.col("file_path"), F.col("c_file"))
        + F.when(F.col("c_language") == F.col("language"), 50).otherwise(-80)
        + kind
        + F.when(F.coalesce("is_exported", F.lit(False)), 10).otherwise(0)
        + F.coalesce(near, F.lit(0.0))
    )
    return c.withColumn("score", F.round(total, 6))


def best_match(c: DataFrame) -> DataFrame:
    """(ref, id, score, n): the best candidate of each reference; same-language ones first, ties to the least id."""
    s = score(c).withColumn("own", (F.col("c_language") == F.col("language")).cast("int"))
    top = F.min_by(F.struct("id", "score", "own", "c_file", "file_path"), F.struct((-F.col("own")).alias("o"), (-F.col("score")).alias("s"), "id"))
    return s.groupBy("ref").agg(top.alias("t"), F.count(F.lit(1)).alias("n"), F.sum("own").alias("n_own")).select("ref", "t.id", "t.score", "t.own", "n", "n_own", (paths.proximity(F.col("t.file_path"), F.col("t.c_file"))).alias("near"))


def by_exact_name(c: DataFrame) -> DataFrame:
    """.9 for the only candidate (.5 across languages); else the best, .7 if it shares two folders, .4 if not."""
    b = best_match(c)
    conf = F.when(F.col("n") == 1, F.when(F.col("own") == 1, 0.9).otherwise(0.5)).when(F.col("near") >= 30, 0.7).otherwise(0.4)
    return b.select("ref", "id", conf.alias("confidence"), F.lit("exact-name").alias("method"), F.lit(5).alias("priority"))


def own_symbols(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References that are no names of their language or its library."""
    known = nodes.select("name").where("name is not null").distinct().withColumn("_k", F.lit(True))
    head = F.split_part("reference_name", F.lit("."), F.lit(1))
    r = refs.withColumn("_cap", F.concat(F.upper(F.substring(head, 1, 1)), F.substring(head, 2, 1 << 20)))
    r = r.join(known.withColumnRenamed("name", "reference_name").withColumnRenamed("_k", "_own"), "reference_name", "left").join(known.withColumnRenamed("name", "_cap").withColumnRenamed("_k", "_head"), "_cap", "left")
    there = lambda c: F.coalesce(F.col(c), F.lit(False))
    return r.where(~builtins.is_builtin(F.col("reference_name"), F.col("language"), there("_own"), there("_head"))).select(*refs.columns)


def by_qualified_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """.95 for the qualified name itself, one in the reference's file first; .85 for the only symbol whose qualified name ends
    in it after a `::`; names without a separator are left to others. The symbols are reduced to one row per name first."""
    q = refs.where(F.col("reference_name").rlike(r"::|\.|/")).select("ref", F.col("reference_name").alias("_q"), "file_path")
    n = nodes.where("qualified_name is not null").select("id", F.col("qualified_name").alias("_q"), "file_path")
    near = n.groupBy("_q", "file_path").agg(F.min("id").alias("own"))
    exact = q.join(n.groupBy("_q").agg(F.min("id").alias("any")), "_q").join(near, ["_q", "file_path"], "left").select("ref", F.coalesce("own", "any").alias("id"), F.lit(0.95).alias("confidence"))
    parts = F.split("_q", "::")
    tails = n.where(F.col("_q").contains("::")).select("id", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "::"))).alias("_q"))
    only = tails.groupBy("_q").agg(F.min("id").alias("id"), F.max("id").alias("_other")).where("id = _other")
    end = q.join(only, "_q").select("ref", "id", F.lit(0.85).alias("confidence"))
    both = exact.unionByName(end).groupBy("ref").agg(F.min_by(F.struct("id", "confidence"), F.struct((-F.col("confidence")).alias("c"), "id")).alias("b"))
    return both.select("ref", "b.id", "b.confidence", F.lit("qualified-name").alias("method"), F.lit(2).alias("priority"))


def by_import(refs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """.92: the reference's file has an import of that name that leads to a symbol of it."""
    imp = nodes.where("kind = 'import'").select(F.col("id").alias("source"), F.col("name").alias("reference_name"), "file_path")
    to = edges.where("kind = 'imports'").select("source", "target").distinct()
    n = nodes.where(~F.col("kind").isin("file", "import")).select(F.col("id").alias("target"), F.col("name").alias("reference_name"))
    known = imp.join(to, "source").join(n, ["target", "reference_name"]).select("file_path", "reference_name", F.col("target").alias("id"))
    return refs.join(known, ["file_path", "reference_name"]).groupBy("ref").agg(F.min("id").alias("id")).select("ref", "id", F.lit(0.92).alias("confidence"), F.lit("import").alias("method"), F.lit(1).alias("priority"))


def by_function_value(c: DataFrame) -> DataFrame:
    """Functions passed as values: .95 in the same file, .8 if it is the only one elsewhere."""
    f = c.where((F.col("reference_kind") == "function_ref") & F.col("kind").isin(CALLABLE)).withColumn("same", F.col("c_file") == F.col("file_path"))
    g = f.groupBy("ref").agg(F.min(F.when(F.col("same"), F.col("id"))).alias("own"), F.min("id").alias("id"), F.count(F.lit(1)).alias("k"))
    return g.where("own is not null or k = 1").select("ref", F.coalesce("own", "id").alias("id"), F.when(F.col("own").isNotNull(), 0.95).otherwise(0.8).alias("confidence"), F.lit("function-value").alias("method"), F.lit(0).alias("priority"))


def by_fuzzy_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """.5 for the only callable of the name in another case, .3 across languages. Symbols are reduced to one row per spelling
    before they meet the references, so a frequent name costs one row."""
    n = nodes.where(F.col("kind").isin(CALLABLE + ["class"])).groupBy(F.lower("name").alias("low"), "name").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id"), F.min("language").alias("c_language"))
    r = refs.select("ref", F.lower("reference_name").alias("low"), "reference_name", "language")
    g = r.join(n, "low").where("name <> reference_name").groupBy("ref", "language").agg(F.sum("k").alias("k"), F.min("id").alias("id"), F.min("c_language").alias("c_language")).where("k = 1")
    conf = F.when(F.col("c_language").eqNullSafe(F.col("language")), 0.5).otherwise(0.3)
    return g.select("ref", "id", conf.alias("confidence"), F.lit("fuzzy").alias("method"), F.lit(6).alias("priority"))


def cascade(refs: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None, located: DataFrame | None = None, passed_on: DataFrame | None = None) -> DataFrame:
    """(ref, id, confidence, method, priority): what every strategy proposes for keyed references that are no built-ins and
    that some symbol could match. With the files' contents the receivers' types are read from the source; with located
    imports (and re-exports) names are followed to what they bind; without either, import edges that exist are used."""
    r = cut(possible(own_symbols(refs, nodes), nodes))
    c = candidates(r, nodes)
    types = calls.receiver_types(r, files, nodes) if files is not None else None
    bound = imports.by_imports(r, located, nodes, passed_on) if located is not None else by_import(r, nodes, edges)
    every = [calls.by_this_member(r, nodes, edges), by_function_value(c), bound, by_qualified_name(r, nodes), calls.by_file_path(r, nodes), calls.by_method_call(r, nodes, edges, types), by_exact_name(c), by_fuzzy_name(r, nodes)]
    if "return_type" in nodes.columns:
        every.append(calls.by_call_chain(r, nodes, edges))
    return reduce(DataFrame.unionByName, every)


def resolve(refs: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None, located: DataFrame | None = None, passed_on: DataFrame | None = None) -> DataFrame:
    """(ref columns, target, confidence, method): the whole cascade. A strategy of .9 and more wins by order; else the
    greatest confidence does, ties by order and id. What no strategy links is left out."""
    r = keyed(refs)
    rank = F.struct(F.when(F.col("confidence") >= 0.9, F.col("priority")).otherwise(100).alias("a"), (-F.col("confidence")).alias("b"), "priority", "id")
    best = cascade(r, nodes, edges, files, located, passed_on).groupBy("ref").agg(F.min_by(F.struct("id", "confidence", "method"), rank).alias("b"))
    return r.join(best, "ref").select(*REF, F.col("b.id").alias("target"), "b.confidence", "b.method")


def to_edges(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, kind, line, col, provenance): edges of resolved references. A function value becomes a reference;
    what is extended is implemented if it is an interface; a called class is instantiated."""
    k = nodes.select(F.col("id").alias("target"), F.col("kind").alias("_k"))
    kind = (
        F.when(F.col("reference_kind") == "function_ref", "references")
        .when((F.col("reference_kind") == "extends") & F.col("_k").isin("interface", "protocol"), "implements")
        .when((F.col("reference_kind") == "calls") & F.col("_k").isin("class", "struct"), "instantiates")
        .otherwise(F.col("reference_kind"))
    )
    return resolved.join(k, "target").select(F.col("from_node_id").alias("source"), "target", kind.alias("kind"), "line", "col", F.col("method").alias("provenance"))


def event_channels(on: DataFrame, emit: DataFrame, most: int = 6) -> DataFrame:
    """(source, target, channel): dispatchers with registered handlers of the same channel; channels with more than `most` of
    either are skipped before anything is paired. on, emit: (id, channel)."""
    cap = lambda df: df.groupBy("channel").agg(F.count_distinct("id").alias("k")).where(F.col("k") <= most).select("channel")
    ok = cap(on).join(cap(emit), "channel")
    a = emit.join(ok, "channel", "left_semi").select(F.col("id").alias("source"), "channel").distinct()
    b = on.join(ok, "channel", "left_semi").select(F.col("id").alias("target"), "channel").distinct()
    return a.join(b, "channel").where("source <> target").select("source", "target", "channel")


def relink(lost: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """Edges into re-indexed files, moved to the new symbol of the same kind and name: (source, target, kind); of several the
    least id, none if the name is gone. lost: (source, kind, target_name, target_kind)."""
    n = new_nodes.groupBy(F.col("name").alias("target_name"), F.col("kind").alias("target_kind")).agg(F.min("id").alias("target"))
    return lost.join(n, ["target_name", "target_kind"]).select("source", "target", "kind").distinct()
