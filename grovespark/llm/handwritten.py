"""Generated, minified, vendored and data files, told apart from hand-written source.

Layout comes first. `files` and `nodes` hold no text of a file as a whole, but its size, the last line and the last column
that its nodes reach, and pieces of it: the nodes' signatures. Thresholds per language on mean and longest line, on the white
space and the letters and digits of all signatures, and on bytes a symbol find minified code and data blobs. What layout cannot
show, that laid-out code was written by a tool or copied, is told by a file's place and name, then by its leading comment.
Texts themselves are judged by `grovespark.llm.layout`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.llm.layout import limit
from grovespark.sources.tables import clean_path, current_files

#: Bytes a symbol from which a file is data, if its lines are between DATA_LINE and DATA_LINE_MOST on average; a file
#: without any symbol has to be ten times larger.
DATA_BYTES_A_NODE, DATA_LINE, DATA_LINE_MOST = 20_000, 50, 1000
#: Signatures of a file that must hold this many characters before their white space counts.
SIGNATURE_CHARS = 40

#: Directory names that hold third-party copies, build output and generated code by common convention.
VENDOR_DIRS = ["node_modules", "bower_components", "jspm_packages", "vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "external", "deps", "Pods", "site-packages", "dist-packages"]
VENDOR_PAIRS = ["Carthage/Checkouts", "contrib/vendored", "Godeps/_workspace"]
GENERATED_DIRS = ["generated", "__generated__", "_generated", "autogen", "codegen_out", "generated-sources", "generated_sources", "gen-src"]
GENERATED_PAIRS = ["build/classes", "build/generated", "target/generated-sources", "target/classes", "obj/Release", "obj/Debug", "autogen/bindings"]
#: Endings of file names, before the language's own extension, that tools give to what they write.
GENERATED_MARKS = ["generated", "gen", "g", "g.i", "pb", "pb-c", "pulsar", "tab", "freezed", "Designer", "designer", "auto", "tmh", "mocks", "gr"]
GENERATED_STEMS = ["_generated", "_gen", "_pb", "_pb2", "_pb2_grpc", "_grpc_pb", "Grpc", "OuterClass"]
BUNDLE_MARKS = ["min", "prod.min", "bundle", "chunk", "bundle.min", "prod"]


def _any(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


VENDOR_RE = rf"(^|/)({_any(VENDOR_DIRS)})/|(?i:(^|/)third[-_]?party/)|(^|/)({_any(VENDOR_PAIRS)})/"
GENERATED_RE = (
    rf"(^|/)({_any(GENERATED_DIRS)})/|(^|/)({_any(GENERATED_PAIRS)})/"
    rf"|\.({_any(GENERATED_MARKS)})\.[A-Za-z]+$|({_any(GENERATED_STEMS)})\.[A-Za-z]+$|(^|/)zz_generated\."
)
BUNDLE_RE = rf"\.({_any(BUNDLE_MARKS)})\.[cm]?js$|[-_]min\.[cm]?js$"
#: Leading comments. A generated file's says who made it or forbids edits on account of that; a copy's says where it is from.
HEADER_GENERATED_RE = (
    r"@generated\b|<auto-?generated|\b(auto-?generated|autogenerated)\b|^(this (file|code) (was|is) )?(automatically |machine[- ])?generated (by|from|with)\b"
    r"|\b(code|file|source) (was |is )?((automatically|machine) )?generated (by|from|with)\b|\bwas automatically generated\b|^machine[- ](written|generated)\b"
    r"|\bdo not (edit|modify)( this file)?( by hand)?\s*([.!]?\s*$|[-—–]+\s*(re)?(built|generated))|^output of \w+[;,.]"
    r"|\bg[ée]n[ée]r[ée] (par|automatiquement)\b|\b(erzeugt|generiert) (aus|mit|von|durch)\b|\bnicht von hand\b"
    r"|\bgenerado (por|autom)|\bgerado (por|autom)|сгенерирован|自动生成|自動生成|\bwygenerowan"
)
HEADER_VENDOR_RE = (
    r"\b(verbatim|upstream|vendored?|third[- ]party)\b|\bbundled (copy|version|with)\b|\b(copy|snapshot|fork|mirror|backport) of \S+ v?\d+(\.\d+)+"
    r"|\bcopyright\b.{0,60}\b(contributors|authors|foundation)\b"
)


def bare_comment(c: Column) -> Column:
    """A comment's text without its marks, lower case, on one line."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?m)^\s*(/\*+|\*+/|\*|//+!?|#+!?|--+|;+|%+|\"\"\"|'''|<!--)|\*+/\s*$|-->\s*$", " "), r"\s+", " "))


def origins(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, language, origin, channel, mean_line, max_column, signature_space, signature_alnum, bytes_a_node) of every path.

    origin is 'minified', 'data', 'vendored', 'generated' or 'source'; channel says what decided: 'layout', 'place' or
    'comment', null for source. Files come from their current row. Nodes are pre-aggregated per file before the shuffle,
    under one spelling of the path, signatures to three sums; the newest leading comment counts. A file without nodes has
    no layout and is judged by path and size alone; a null size or node count switches off the statistics that need it;
    null docstrings and signatures say nothing. Empty tables: no rows.
    """
    cols = ["path", "indexed_at", "modified_at", "language", "size", "node_count"]
    cur = current_files(files.select(*cols), cols).select("path", clean_path("path").alias("_p"), "language", "size", "node_count")
    sig = F.col("signature")
    lay = (
        nodes.where(F.col("file_path").isNotNull())
        .groupBy(clean_path("file_path").alias("_p"))
        .agg(
            F.max("end_line").alias("_lines"),
            F.max("end_column").alias("_column"),
            F.max(F.when(F.col("kind") == "file", F.struct("updated_at", "docstring"))).alias("_head"),
            F.sum(F.length(sig)).alias("_n"),
            F.sum(F.length(sig) - F.length(F.translate(sig, " \t\r\n", ""))).alias("_space"),
            F.sum(F.length(sig) - F.length(F.regexp_replace(sig, r"[\p{L}\p{N}]+", ""))).alias("_alnum"),
        )
    )
    f = cur.join(lay, "_p", "left")
    p, lang = F.col("_p"), F.coalesce("language", F.lit(""))
    head = F.coalesce(bare_comment(F.col("_head.docstring")), F.lit(""))
    mean = F.when(F.col("_lines").isNotNull(), F.col("size") / F.greatest(F.col("_lines"), F.lit(1)))
    per_node = F.col("size") / F.greatest(F.coalesce(F.col("node_count"), F.lit(1)), F.lit(1))
    space, alnum = (F.when(F.col("_n") >= SIGNATURE_CHARS, F.col(c) / F.col("_n")) for c in ("_space", "_alnum"))
    no = lambda c: F.coalesce(c, F.lit(False))
    dense = no((space < limit("space", lang) / 4) & (alnum < limit("alnum", lang)))
    narrow = ~no(F.col("_column") >= limit("max_line", lang))
    data = no((per_node >= DATA_BYTES_A_NODE) & (mean >= DATA_LINE) & (mean < DATA_LINE_MOST) & narrow & ~dense) | no(F.col("_lines").isNull() & (per_node >= 10 * DATA_BYTES_A_NODE))
    ways = [
        (data, "data", "layout"), (~narrow | no(mean >= limit("mean_line", lang)) | dense, "minified", "layout"),
        (p.rlike(VENDOR_RE), "vendored", "place"), (p.rlike(BUNDLE_RE), "minified", "place"), (p.rlike(GENERATED_RE), "generated", "place"),
        (head.rlike(HEADER_VENDOR_RE), "vendored", "comment"), (head.rlike(HEADER_GENERATED_RE), "generated", "comment"),
    ]
    decided = F.coalesce(*[F.when(c, F.struct(F.lit(o).alias("origin"), F.lit(w).alias("channel"))) for c, o, w in ways], F.struct(F.lit("source").alias("origin"), F.lit(None).cast("string").alias("channel")))
    f = f.withColumn("_d", decided)
    return f.select("path", "language", "_d.origin", "_d.channel", mean.alias("mean_line"), F.col("_column").alias("max_column"), space.alias("signature_space"), alnum.alias("signature_alnum"), per_node.alias("bytes_a_node"))


def not_by_hand(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path) of each file that nobody wrote by hand."""
    return origins(files, nodes).where("origin <> 'source'").select("path")
