"""Files whose current state is not valid source of their language.

`files` keeps no text, only what the indexer's parser reported: an array of errors. Each message is put into a class by
what it says happened to the text; codes and severities are unreliable and are not used. A language that cannot belong to
the path's extension is found from the extension itself. Texts are parsed by `grovespark.llm.parsing`, whose errors have
the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.sources.tables import current_files

#: The languages that a file extension may hold.
EXTENSION_LANGUAGES = {
    "ts": ["typescript"], "mts": ["typescript"], "cts": ["typescript"], "tsx": ["tsx", "typescript"], "js": ["javascript", "jsx"], "mjs": ["javascript"], "cjs": ["javascript"], "jsx": ["jsx", "javascript"],
    "py": ["python"], "pyi": ["python"], "pyw": ["python"], "go": ["go"], "java": ["java"], "kt": ["kotlin"], "kts": ["kotlin"], "rs": ["rust"],
    "c": ["c"], "h": ["c", "cpp", "objc"], "cc": ["cpp"], "cpp": ["cpp"], "cxx": ["cpp"], "hpp": ["cpp"], "hh": ["cpp"], "hxx": ["cpp"], "inl": ["c", "cpp"], "m": ["objc"], "mm": ["objc"],
    "cs": ["csharp"], "swift": ["swift"], "dart": ["dart"], "ets": ["arkts", "typescript"], "rb": ["ruby"], "rake": ["ruby"], "php": ["php"], "inc": ["php", "c", "cpp"], "phtml": ["php"],
    "lua": ["lua"], "luau": ["luau", "lua"], "vue": ["vue"], "svelte": ["svelte"], "scala": ["scala"], "sc": ["scala"],
}
#: What a message must say for each class. Merge leftovers name a conflict marker or both sides of a merge.
MERGE_RE = r"<{7}|>{7}|\|{7}|={7}|'<<' \(head\)|\bconflict markers?\b|\b(merge|unresolved) conflict|\b(both|two) (sides|versions) of (a|the)\b"
CUT_RE = (
    r"<eof>|\beof\b|\bend of (file|input|text|source)\b|\b(input|file|text|source) (ends|stops|breaks off)\b|\bpremature|\b(never|not) (closed|ended|ends|terminated)\b|\bun(terminated|closed)\b"
    r"|\bmissing closing\b|\bstill open\b|\bincomplete\b|\btruncated\b|\bcut (off|short)\b"
)
FOREIGN_RE = r"\bgrammar (mismatch|recogni[sz]ed)\b|\berror nodes?\b|\b(not legal|illegal|invalid) in\b|\bunexpected (token|character|symbol|input)\b|\bwrong (language|grammar)\b"
#: The indexer's own trouble and remarks, whatever else their words look like.
INDEXER_RE = (
    r"^(parser worker|parse timed out|failed to read|path traversal|tree walk stopped|worker restarted|file exceeds|no grammar bundled|unused |deprecated |duplicate symbol|conflicting overloads"
    r"|end of line style|syntax highlighting|unexpected byte order mark|expected manifest|merge of \d+ partial)"
)


def cause(message: Column) -> Column:
    """'merge', 'cut', 'foreign' or null for a message that says nothing against the text."""
    m = F.lower(F.trim(message))
    return F.when(m.rlike(INDEXER_RE), None).when(m.rlike(MERGE_RE), "merge").when(m.rlike(CUT_RE), "cut").when(m.rlike(FOREIGN_RE), "foreign")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def misplaced(path: Column, language: Column) -> Column:
    """True when the extension is known and cannot hold the language; unknown extensions and null languages are not."""
    table = F.create_map(*[x for k, v in EXTENSION_LANGUAGES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    known = F.try_element_at(table, extension(path))
    return known.isNotNull() & language.isNotNull() & (language != "unknown") & ~F.array_contains(known, language)


def states(files: DataFrame) -> DataFrame:
    """(path, language, first_cause, first_line, n_errors) per path, from its current row. first_cause is null for valid
    files; errors without a line come after those with one. Errors that name another file do not count against this one.
    Null and empty error arrays are no errors; null messages say nothing; an empty table gives no rows."""
    cols = ["path", "indexed_at", "modified_at", "language", "errors"]
    against = F.filter(
        F.transform("errors", lambda e: F.struct(F.coalesce(e["line"], F.lit(2**31 - 1)).alias("line"), F.coalesce(e["col"], F.lit(0)).alias("col"), cause(e["message"]).alias("cause"), e["file_path"].alias("at"))),
        lambda e: e["cause"].isNotNull(),
    )
    # Errors are judged before the shuffle; what travels is a struct of a few numbers instead of the messages.
    f = files.withColumn("_bad", F.filter(against, lambda e: e["at"].isNull() | (F.regexp_replace(F.translate(e["at"], "\\", "/"), r"^(\./)+", "") == F.regexp_replace(F.translate(F.col("path"), "\\", "/"), r"^(\./)+", ""))))
    slim = f.select("path", "indexed_at", "modified_at", "language", F.array_min("_bad").alias("_first"), F.coalesce(F.size("_bad"), F.lit(0)).alias("n_errors"))
    cur = current_files(slim, ["path", "indexed_at", "modified_at", "language", "_first", "n_errors"])
    wrong = misplaced(F.col("path"), F.col("language"))
    return cur.select(
        "path",
        "language",
        F.coalesce("_first.cause", F.when(wrong, "extension")).alias("first_cause"),
        F.when(F.col("_first.line") < 2**31 - 1, F.col("_first.line")).alias("first_line"),
        F.greatest("n_errors", F.lit(0)).alias("n_errors"),
    )


def invalid(files: DataFrame) -> DataFrame:
    return states(files).where("first_cause is not null").select("path")


def rates(files: DataFrame) -> DataFrame:
    """Acceptance per repository and language: files, invalid files, and the share of valid ones."""
    s = states(files).groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("repository"), "language")
    return s.agg(F.count(F.lit(1)).alias("n_files"), F.count("first_cause").alias("n_invalid")).withColumn("accepted", F.round(1 - F.col("n_invalid") / F.col("n_files"), 6))
