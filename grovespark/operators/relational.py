"""Scans, merges, joins and aggregates over the code graph.

Every operator is the batch form: it answers for all rows it is given. Where an endpoint is joined, the distinct pairs that
matter are formed before the join on `target`, because a few targets hold most edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovespark.functions import paths

REFERRING = ["calls", "references", "imports", "instantiates"]
ADJACENT = ["calls", "references", "imports", "extends", "implements", "instantiates", "overrides", "type_of", "returns"]


# Sinks: merges that give a new state from an old one and changes.


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Last write wins by key; rows of `new` replace those of `old`. Null keys are dropped. Among several new rows of a key
    the greatest by all columns is kept, so repeats do not matter."""
    cols = old.columns
    both = old.select(*cols, F.lit(0).alias("_v")).unionByName(new.select(*cols, F.lit(1).alias("_v")))
    both = both.dropna(subset=key)
    rest = [c for c in cols if c not in key]
    rank = F.struct("_v", *[F.col(c).cast("string") for c in rest])
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("_r")).select(*key, "_r.*").select(*cols)


def valid_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with all required fields."""
    return nodes.dropna(subset=["id", "kind", "name", "file_path", "language"])


def attached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes; the cascade of a deletion of nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def without(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is not among `keys`."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


# Joins.


def cross_file(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_file, target_file, n): pairs of files with edges other than `contains` between them."""
    f = nodes.where("file_path is not null").select("id", "file_path")
    e = edges.where("kind <> 'contains'").join(f.select(F.col("id").alias("source"), F.col("file_path").alias("source_file")), "source")
    e = e.groupBy("source_file", "target").agg(F.count(F.lit(1)).alias("n"))
    e = e.join(f.select(F.col("id").alias("target"), F.col("file_path").alias("target_file")), "target").where("source_file <> target_file")
    return e.groupBy("source_file", "target_file").agg(F.sum("n").alias("n"))


def dead_code(nodes: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Nodes of the kinds that are not exported and that nothing but containment points to."""
    used = edges.where("kind <> 'contains'").select(F.col("target").alias("id")).distinct()
    return nodes.where(F.col("kind").isin(kinds) & ~F.coalesce("is_exported", F.lit(False))).join(used, "id", "left_anti")


def induced(edges: DataFrame, ids: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges both of whose ends are in `ids`."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    return attached(e, ids)


def enclosing(points: DataFrame, ranges: DataFrame, keep: list[str]) -> DataFrame:
    """For each point (file_path, line) the tightest range (file_path, start_line, end_line, id) of its file that holds it.

    A point meets only ranges of its file that cross its block of 64 lines or, for long ranges, its block of 4,096 lines,
    so a long file is no nested loop. Ties: the later start, then the least id. Points in no range are left out.
    """
    small = (F.col("end_line") - F.col("start_line")) < 2048
    block = lambda size: F.explode(F.sequence(F.floor(F.col("start_line") / size), F.floor(F.col("end_line") / size)))
    ok = ranges.where("start_line is not null and end_line >= start_line").select(F.col("file_path"), "start_line", "end_line", F.col("id").alias("range_id"))
    r = ok.where(small).withColumn("_b", block(64)).withColumn("_l", F.lit(0)).unionByName(ok.where(~small).withColumn("_b", block(4096)).withColumn("_l", F.lit(1)))
    p = points.where("line is not null")
    p = p.withColumn("_z", F.explode(F.array(F.struct(F.floor(F.col("line") / 64).alias("b"), F.lit(0).alias("l")), F.struct(F.floor(F.col("line") / 4096).alias("b"), F.lit(1).alias("l")))))
    p = p.withColumn("_b", F.col("_z.b")).withColumn("_l", F.col("_z.l")).drop("_z")
    j = p.join(r, ["file_path", "_b", "_l"]).where("line between start_line and end_line")
    best = F.min_by("range_id", F.struct((F.col("end_line") - F.col("start_line")).alias("w"), (-F.col("start_line")).alias("s"), "range_id"))
    return j.groupBy(*keep).agg(best.alias("range_id"))


def longest_prefix(items: DataFrame, path: str, folders: DataFrame) -> DataFrame:
    """`items` with `folder`: the longest of `folders.folder` that is a directory above the path, or null. The directories of
    a path are exploded and joined by equality, so that no nested loop over prefixes is needed."""
    paths_ = items.select(F.col(path).alias("_p")).where("_p is not null").distinct()
    up = paths_.withColumn("folder", F.explode(paths.ancestors(F.col("_p")))).join(folders.select("folder").distinct(), "folder")
    best = up.groupBy("_p").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    return items.join(best, items[path] == best["_p"], "left").drop("_p")


# Aggregates.


def graph_stats(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """(facet, key, n): nodes by kind, edges by kind, files by language, each counted in one pass."""
    part = lambda df, facet, c: df.groupBy(F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(facet).alias("facet"), "key", "n")
    return part(nodes, "node", "kind").unionByName(part(edges, "edge", "kind")).unionByName(part(files, "file", "language"))


def dominant_file(nodes: DataFrame, edges: DataFrame, least: int = 20, top: int = 20) -> DataFrame:
    """(file_path, edge_count, next_edge_count): of the `top` files with most edges inside, the first that is neither test
    nor generated, if it has `least` of them, with the runner-up's count."""
    f = nodes.where("file_path is not null").select("id", "file_path")
    e = edges.join(f.select(F.col("id").alias("source"), F.col("file_path").alias("a")), "source").groupBy("a", "target").agg(F.count(F.lit(1)).alias("n"))
    e = e.join(f.select(F.col("id").alias("target"), F.col("file_path").alias("b")), "target").where("a = b").groupBy(F.col("a").alias("file_path")).agg(F.sum("n").alias("edge_count"))
    ranked = e.orderBy(F.desc("edge_count"), "file_path").limit(top).where(~paths.is_low_value(F.col("file_path")))
    w = W.orderBy(F.desc("edge_count"), "file_path")
    return ranked.withColumn("next_edge_count", F.coalesce(F.lead("edge_count").over(w), F.lit(0))).withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) & (F.col("edge_count") >= least)).drop("_r")


def top_file_of_kind(nodes: DataFrame, kind: str, least: int = 3, share: float = 0.3) -> DataFrame:
    """(file_path, n, total): the file with most nodes of a kind, if it has `least` of them and `share` of all."""
    per = nodes.where(F.col("kind") == kind).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    best = per.agg(F.sum("n").alias("total"), F.min_by(F.struct("file_path", "n"), F.struct((-F.col("n")).alias("k"), "file_path")).alias("b"))
    return best.select("b.file_path", "b.n", "total").where((F.col("n") >= least) & (F.col("total") >= least) & (F.col("n") >= F.col("total") * share))


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_in, n_out, n_calls, n_callers, n_children): degrees of every node, in one shuffle of both ends of each edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(True).alias("out"), "kind"), F.struct(F.col("target").alias("id"), F.lit(False).alias("out"), "kind"))).alias("x")).select("x.*")
    d = ends.groupBy("id").agg(
        F.count_if(~F.col("out")).alias("n_in"),
        F.count_if("out").alias("n_out"),
        F.count_if(F.col("out") & (F.col("kind") == "calls")).alias("n_calls"),
        F.count_if(~F.col("out") & (F.col("kind") == "calls")).alias("n_callers"),
        F.count_if(F.col("out") & (F.col("kind") == "contains")).alias("n_children"),
    )
    counts = ["n_in", "n_out", "n_calls", "n_callers", "n_children"]
    return nodes.select("id").join(d, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def module_structure(files: DataFrame) -> DataFrame:
    """(directory, n_files, first_file, last_file)."""
    return files.groupBy(paths.dirname(F.col("path")).alias("directory")).agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_file"), F.max("path").alias("last_file"))


def directory_totals(files: DataFrame, size: str) -> DataFrame:
    """(directory, n_files, total): every directory with what is anywhere below it."""
    up = files.select(F.explode(paths.ancestors(F.col("path"))).alias("directory"), F.col(size).alias("_s"))
    return up.groupBy("directory").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("_s"), F.lit(0)).alias("total"))


def symbol_context(focus: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_incoming, n_outgoing, children, types, imports) of each node of `focus` (id): the surroundings of a symbol,
    names sorted and joined by commas. Only the focused nodes' edges are shuffled to the nodes."""
    names = nodes.select(F.col("id").alias("other"), F.col("name").alias("other_name"))
    out = edges.join(focus.select(F.col("id").alias("source")), "source").select(F.col("source").alias("id"), F.col("target").alias("other"), "kind", F.lit(True).alias("out"))
    inn = edges.join(focus.select(F.col("id").alias("target")), "target").select(F.col("target").alias("id"), F.col("source").alias("other"), "kind", F.lit(False).alias("out"))
    pick = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("other_name")))), ",")
    g = out.unionByName(inn).join(names, "other", "left").groupBy("id").agg(
        F.count_if(~F.col("out") & (F.col("kind") != "contains")).alias("n_incoming"),
        F.count_if(F.col("out") & (F.col("kind") != "contains")).alias("n_outgoing"),
        pick(F.col("out") & (F.col("kind") == "contains")).alias("children"),
        pick(F.col("out") & F.col("kind").isin("extends", "implements", "type_of", "returns")).alias("types"),
        pick(F.col("out") & (F.col("kind") == "imports")).alias("imports"),
    )
    return focus.select("id").join(g, "id", "left").select("id", F.coalesce("n_incoming", F.lit(0)).alias("n_incoming"), F.coalesce("n_outgoing", F.lit(0)).alias("n_outgoing"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("children", "types", "imports")])


def routing(nodes: DataFrame, edges: DataFrame, kind: str, top: int = 40) -> DataFrame:
    """(url, handler, handler_file, handler_line): nodes of a route-like kind with what they refer to; the first `top` by
    file and line, of which tests and generated files are then left out, and nothing if fewer than three remain."""
    r = nodes.where(F.col("kind") == kind).select(F.col("id").alias("source"), F.col("name").alias("url"), F.col("file_path").alias("_f"), F.col("start_line").alias("_l"))
    h = nodes.where(F.col("kind").isin("function", "method", "class")).select(F.col("id").alias("target"), F.col("name").alias("handler"), F.col("file_path").alias("handler_file"), F.col("start_line").alias("handler_line"))
    e = edges.where(F.col("kind").isin("references", "calls")).select("source", "target").distinct()
    first = e.join(r, "source").join(h, "target").orderBy("_f", "_l", "source", "target").limit(top)
    kept = first.where(~paths.is_low_value(F.col("handler_file")))
    n = F.count(F.lit(1)).over(W.partitionBy())
    return kept.withColumn("_n", n).where("_n >= 3").select("url", "handler", "handler_file", "handler_line")


# Windows.


def capped(df: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    """At most `most` rows of each group, by `order`: the diversity caps of result lists."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def line_clusters(ranges: DataFrame, gap: int) -> DataFrame:
    """(file_path, first_line, last_line, n): ranges of a file joined while the next starts within `gap` lines of the end so
    far. Two windows over a file's ranges: a running maximum of ends, then a running count of breaks."""
    w = W.partitionBy("file_path").orderBy("start_line", "end_line", "id")
    far = F.max("end_line").over(w.rowsBetween(W.unboundedPreceding, -1))
    r = ranges.withColumn("_new", F.when(far.isNull() | (F.col("start_line") > far + gap), 1).otherwise(0))
    r = r.withColumn("_c", F.sum("_new").over(w))
    return r.groupBy("file_path", "_c").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.count(F.lit(1)).alias("n")).drop("_c")


def outermost(ranges: DataFrame) -> DataFrame:
    """Ranges of a file that no earlier range reaches into: overlapping ones are left out."""
    w = W.partitionBy("file_path").orderBy("start_line", F.desc("end_line"), "id").rowsBetween(W.unboundedPreceding, -1)
    return ranges.withColumn("_e", F.max("end_line").over(w)).where(F.col("_e").isNull() | (F.col("start_line") > F.col("_e"))).drop("_e")


def within_budget(df: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """Greedy choice within each group: in order, what still fits the budget is kept and what does not is skipped; the first
    is always kept. What is kept depends on all choices before it, so each group is walked in order; a group is one
    display list, streamed in sorted batches."""
    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType([f for f in df.schema.fields])

    def choose(batches):
        key, used = None, 0
        for b in batches:
            keep = []
            for g, c in zip(b[group], b[cost]):
                if g != key:
                    key, used = g, 0
                    keep.append(True)
                    used += c
                else:
                    fits = used + c <= budget
                    keep.append(fits)
                    used += c if fits else 0
            yield b[pd.Series(keep, index=b.index)] if len(b) else b

    return df.repartition(group).sortWithinPartitions(group, order).mapInPandas(choose, schema)


# Set operations.


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, state): 'matched', 'missing' (only in a) or 'extra' (only in b)."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(True)), b.select(key).distinct().withColumn("_b", F.lit(True))
    return x.join(y, key, "full_outer").select(key, F.when(F.col("_a").isNull(), "extra").when(F.col("_b").isNull(), "missing").otherwise("matched").alias("state"))
