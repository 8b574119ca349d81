"""Full-text, fuzzy and vocabulary search over symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.functions import names
from grovespark.operators.relational import capped
from grovespark.session import cut

#: Weights of the indexed columns. BM25 constants are the customary ones of the literature.
FIELDS = {"docstring": 1, "name": 20, "qualified_name": 5, "signature": 2}
K1, B = 1.2, 0.75


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(nodes: DataFrame) -> DataFrame:
    """(id, term, wtf, length): weighted term frequency over the indexed columns, and the node's number of terms."""

    def weighted(f: str, w: int) -> Column:
        return F.transform(terms(F.col(f)), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))

    every = F.flatten(F.array(*[weighted(f, w) for f, w in FIELDS.items()]))
    t = nodes.select("id", every.alias("ts")).select("id", F.size("ts").alias("length"), F.explode("ts").alias("t"))
    return t.groupBy("id", F.col("t.term").alias("term"), "length").agg(F.sum("t.w").alias("wtf"))


def bm25(nodes: DataFrame, query: list[str], top: int | None = None) -> DataFrame:
    """(id, score): nodes with any term that starts with one of the query's, by BM25 with column weights.

    Terms that match are picked out of a node's own terms before they become rows, so only postings of matching terms are
    exploded and grouped; node count and mean length come from one scan without a shuffle of texts. Nodes without text
    count with length 0; no match, no rows. `top` limits the result, ties by id.
    """
    wanted = [q.lower() for q in query]

    def matching(f: str, w: int) -> Column:
        hit = lambda t: [t.startswith(q) for q in wanted]
        some = F.filter(terms(F.col(f)), lambda t: reduce(Column.__or__, hit(t), F.lit(False)))
        return F.flatten(F.transform(some, lambda t: F.array_compact(F.array(*[F.when(h, F.struct(F.lit(q).alias("q"), F.lit(w).alias("w"))) for q, h in zip(wanted, hit(t))]))))

    every = sum((F.size(terms(F.col(f))) for f in FIELDS), F.lit(0))
    size = nodes.agg(F.count(F.lit(1)).alias("N"), F.avg(every).alias("avg")).select(F.struct("N", "avg")).scalar()
    some = F.flatten(F.array(*[matching(f, w) for f, w in FIELDS.items()]))
    hit = nodes.select("id", every.alias("length"), some.alias("ts")).where(F.size("ts") > 0).select("id", "length", F.explode("ts").alias("t"))
    hit = hit.groupBy("id", F.col("t.q").alias("q"), "length").agg(F.sum("t.w").alias("wtf"))
    df = hit.groupBy("q").agg(F.count(F.lit(1)).alias("df"))
    j = hit.join(F.broadcast(df), "q")  # one row per query term
    n, avg = size["N"], size["avg"]
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    tf = F.col("wtf") * (K1 + 1) / (F.col("wtf") + K1 * (1 - B + B * F.col("length") / avg))
    out = j.groupBy("id").agg(F.round(F.sum(idf * tf), 6).alias("score"))
    return out if top is None else out.orderBy(F.desc("score"), "id").limit(top)


def like(nodes: DataFrame, text: str) -> DataFrame:
    """(id, name, score): 1 for the name itself, .9 for a prefix, .8 inside the name, .7 inside the qualified name, ignoring
    the case of ASCII letters."""
    q, n, qn = text.lower(), F.lower("name"), F.lower("qualified_name")
    score = F.when(n == q, 1.0).when(n.startswith(q), 0.9).when(n.contains(q), 0.8).when(qn.contains(q), 0.7)
    return nodes.select("id", "name", score.alias("score")).where("score is not null")


def fuzzy(nodes: DataFrame, text: str, per_name: int = 5) -> DataFrame:
    """(id, name, distance, score): names within distance 1 of a text of up to four letters, else 2; distinct names are
    compared, after a check of lengths."""
    q = text.lower()
    most = 1 if len(q) <= 4 else 2
    close = nodes.select("name").distinct().where(F.abs(F.length("name") - len(q)) <= most)
    close = close.withColumn("distance", F.levenshtein(F.lower("name"), F.lit(q), most)).where("distance >= 0")
    got = nodes.select("id", "name").join(close, "name")
    return capped(got, "name", [F.asc("id")], per_name).select("id", "name", "distance", F.round(1.0 / (1 + F.col("distance")), 6).alias("score"))


def exact_colocated(nodes: DataFrame, wanted: list[str], boost: int = 20, distinctive: int = 10) -> DataFrame:
    """(id, name, score): nodes of the given names, 20 more where their file also holds another queried name that is in
    fewer than ten files."""
    hit = nodes.where(F.lower("name").isin([w.lower() for w in wanted])).select("id", F.lower("name").alias("name"), "file_path")
    per = hit.groupBy("name").agg(F.count_distinct("file_path").alias("n"))
    rare = hit.join(per.where(F.col("n") < distinctive), "name").select("file_path", F.col("name").alias("other")).distinct()
    near = hit.join(rare, "file_path").where("name <> other").select("id").distinct().withColumn("b", F.lit(boost))
    return hit.join(near, "id", "left").select("id", "name", (F.lit(1) + F.coalesce("b", F.lit(0))).alias("score"))


def vocabulary(nodes: DataFrame) -> DataFrame:
    """(segment, name): words of the distinct names of nodes that are neither files nor imports."""
    n = nodes.where(~F.col("kind").isin("file", "import")).select("name").distinct()
    return n.select(F.explode(names.segments(F.col("name"))).alias("segment"), "name")


def co_occurrence(vocab: DataFrame, words: list[tuple[str, str]], least: int) -> DataFrame:
    """(name, n_words): names whose segments match at least `least` of the words; words: (segment, word it stands for)."""
    w = vocab.sparkSession.createDataFrame(words, "segment string, word string")
    return vocab.join(F.broadcast(w), "segment").groupBy("name").agg(F.count_distinct("word").alias("n_words")).where(F.col("n_words") >= least)


def segment_matches(vocab: DataFrame, words: list[str], top: int = 6, rare: tuple[int, int] = (2, 25), longest_first: int = 5) -> DataFrame:
    """(name, n_words, tier): names whose segments match two of the words and more (tier 1); if there are none, names of two
    segments and more with a word of at least five letters that is in 2 to 25 names (tier 2). Words match by their
    variants. Most words first, shorter names first, then by name."""
    s = vocab.sparkSession
    if not words:
        return vocab.where("false").select("name", F.lit(0).alias("n_words"), F.lit(1).alias("tier"))
    w = s.createDataFrame([(x.lower(),) for x in dict.fromkeys(words)], "word string").select("word", F.explode(names.lookup_variants(F.col("word"))).alias("segment"))
    hit = cut(vocab.join(F.broadcast(w), "segment"))  # a query's words
    many = hit.groupBy("name").agg(F.count_distinct("word").cast("int").alias("n_words")).where("n_words >= 2").withColumn("tier", F.lit(1))
    per = hit.groupBy("segment").agg(F.count_distinct("name").alias("n")).where(F.col("n").between(*rare) & (F.length("segment") >= longest_first))
    single = hit.join(per, "segment").select("name").distinct().join(vocab.groupBy("name").agg(F.count_distinct("segment").alias("k")).where("k >= 2"), "name").select("name", F.lit(1).alias("n_words"), F.lit(2).alias("tier"))
    every = many.unionByName(single)
    best = every.agg(F.min("tier").alias("t")).scalar()
    return every.where(F.col("tier") == best).orderBy(F.desc("n_words"), F.length("name"), "name").limit(top)


def filtered(nodes: DataFrame, raw: str, top: int) -> DataFrame:
    """(id, name, score): a search with `kind:`, `lang:`, `path:` and `name:` filters. Kinds and languages narrow the search itself;
    paths and names are looked for in its best `top` hits. Without free text: all symbols by name."""
    q = names.parse_query(raw)
    n = nodes
    if q["kind"]:
        n = n.where(F.col("kind").isin(q["kind"]))
    if q["language"]:
        n = n.where(F.col("language").isin(q["language"]))
    hits = ranked(n, q["text"], top) if q["text"].strip() else n.select("id", "name", F.lit(1.0).alias("score")).orderBy("name", "id").limit(top)
    some = lambda c, words: reduce(Column.__or__, [F.lower(c).contains(w.lower()) for w in words])
    if q["name"]:
        hits = hits.where(some("name", q["name"]))
    if q["path"]:
        hits = hits.join(nodes.select("id", "file_path"), "id").where(some("file_path", q["path"])).select("id", "name", "score")
    return hits


def ranked(nodes: DataFrame, query: str, top: int, per_word: int = 20) -> DataFrame:
    """(id, name, score): the whole search: text channel, or the substring channel if that finds nothing, or the fuzzy one if
    that finds nothing either; symbols named exactly like a word of the query join with the best text score, `per_word` at
    most for each; rescored by kind, path and name. A later channel is only run when the earlier ones were empty."""
    from grovespark.functions import kinds

    words, bare = names.search_terms(query), query.replace(" ", "")
    hit = None
    for channel in (lambda: bm25(nodes, words), lambda: like(nodes, bare), lambda: fuzzy(nodes, bare)):
        hit = cut(channel().groupBy("id").agg(F.max("score").alias("text")))
        if not hit.isEmpty():
            break
    said = [w.lower() for w in query.split()]
    same = nodes.where(F.lower("name").isin(said)).select("id", F.lower("name").alias("_w"))
    best = hit.agg(F.max("text").alias("m"))
    same = capped(same, "_w", [F.asc("id")], per_word).select("id", F.coalesce(best.scalar(), F.lit(0.0)).alias("text"))
    hit = hit.unionByName(same).groupBy("id").agg(F.max("text").alias("text"))
    n = hit.join(nodes.select("id", "name", "kind", "file_path"), "id")
    score = F.col("text") + kinds.kind_bonus(F.col("kind")) + names.path_relevance(F.col("file_path"), query) + names.name_match_bonus(F.col("name"), query)
    return n.select("id", "name", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(top)
