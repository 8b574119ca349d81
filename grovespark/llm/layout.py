"""Layout statistics of source text, and the thresholds that tell minified code and data from what people write.

Six statistics, all counted in the JVM over whole texts: longest and mean line, share of white space, share of letters and
digits, share of characters in number literals, and the longest run that looks encoded. Thresholds are per language,
because markup, style sheets and languages with meaningful indentation are laid out differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts shorter than this are not judged by shares, which mean little there.
LEAST = 200
#: Per language: longest line and mean line from which a text is minified; white space and the share of letters and digits
#: below which it is; density of number literals and length of an encoded run from which it is data. '' is the default.
THRESHOLDS: dict[str, dict[str, float]] = {
    "": {"max_line": 1000, "mean_line": 200, "space": 0.06, "alnum": 0.45, "numeric": 0.45, "encoded": 400},
    "javascript": {"max_line": 1000, "mean_line": 160, "space": 0.08, "alnum": 0.5, "numeric": 0.45, "encoded": 400},
    "typescript": {"max_line": 1000, "mean_line": 160, "space": 0.08, "alnum": 0.5, "numeric": 0.45, "encoded": 400},
    "vue": {"max_line": 2000, "mean_line": 300, "space": 0.05, "alnum": 0.4, "numeric": 0.45, "encoded": 1500},
    "svelte": {"max_line": 2000, "mean_line": 300, "space": 0.05, "alnum": 0.4, "numeric": 0.45, "encoded": 1500},
    "php": {"max_line": 2000, "mean_line": 300, "space": 0.05, "alnum": 0.4, "numeric": 0.45, "encoded": 800},
    "html": {"max_line": 3000, "mean_line": 400, "space": 0.04, "alnum": 0.35, "numeric": 0.5, "encoded": 3000},
    "css": {"max_line": 1500, "mean_line": 250, "space": 0.07, "alnum": 0.4, "numeric": 0.5, "encoded": 1500},
    "python": {"max_line": 1500, "mean_line": 200, "space": 0.06, "alnum": 0.4, "numeric": 0.4, "encoded": 400},
    "ruby": {"max_line": 1500, "mean_line": 200, "space": 0.06, "alnum": 0.4, "numeric": 0.4, "encoded": 400},
    "c": {"max_line": 1000, "mean_line": 200, "space": 0.06, "alnum": 0.4, "numeric": 0.5, "encoded": 300},
    "cpp": {"max_line": 1000, "mean_line": 200, "space": 0.06, "alnum": 0.4, "numeric": 0.5, "encoded": 300},
}
#: Names that documents use for languages.
ALIASES = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "arkts": "typescript", "py": "python", "rb": "ruby", "objc": "c", "csharp": ""}
_NUMBER = r"(?<![A-Za-z_])(?:0[xX][0-9A-Fa-f]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)"
_ENCODED = r"[A-Za-z0-9+/_-]{60,}={0,2}|(?:\\x[0-9A-Fa-f]{2}){15,}|(?:%[0-9A-Fa-f]{2}){20,}|(?:\\u[0-9A-Fa-f]{4}){10,}"


def _longest(hits: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(hits, F.length)), F.lit(0))


def statistics(text: Column) -> Column:
    """(n, max_line, mean_line, space, alnum, numeric, encoded) of a text; null for a null text, shares 0 for an empty one.
    Blank lines are no lines. An encoded run has to mix letters of both cases with digits, or be made of escapes."""
    n = F.greatest(F.length(text), F.lit(1))
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    widths = F.transform(lines, F.length)
    mean = F.aggregate(widths, F.lit(0).cast("double"), lambda a, x: a + x) / F.greatest(F.size(widths), F.lit(1))
    without = lambda rx: F.length(F.regexp_replace(text, rx, ""))
    runs = F.filter(F.regexp_extract_all(text, F.lit(_ENCODED), 0), lambda r: r.rlike(r"^[\\%]") | (r.rlike("[a-z]") & r.rlike("[A-Z]") & r.rlike("[0-9]")))
    return F.when(
        text.isNotNull(),
        F.struct(
            F.length(text).alias("n"), F.coalesce(F.array_max(widths), F.lit(0)).alias("max_line"), mean.alias("mean_line"),
            ((F.length(text) - without(r"\s+")) / n).alias("space"), ((F.length(text) - without(r"[\p{L}\p{N}]+")) / n).alias("alnum"),
            ((F.length(text) - without(_NUMBER)) / n).alias("numeric"), _longest(runs).alias("encoded"),
        ),
    )


def limit(name: str, language: Column) -> Column:
    """A threshold of a language."""
    c = F.lit(float(THRESHOLDS[""][name]))
    known = {**{k: v[name] for k, v in THRESHOLDS.items() if k}, **{a: THRESHOLDS[b][name] for a, b in ALIASES.items()}}
    for value in sorted(set(known.values())):
        c = F.when(F.lower(language).isin([k for k, v in known.items() if v == value]), float(value)).otherwise(c)
    return c


def verdict(s: Column, language: Column) -> Column:
    """'data', 'minified' or 'source' for statistics (as of `statistics`) of a text; null for none.

    Data: number literals or one encoded run make up the text. Minified: a line or the mean line is too long, or a text long
    enough has hardly any white space together with few letters and digits."""
    big = s["n"] >= LEAST
    lim = lambda k: limit(k, language)
    data = (big & (s["numeric"] >= lim("numeric"))) | ((s["encoded"] >= lim("encoded")) & (s["encoded"] * 2 >= s["n"]))
    minified = (s["max_line"] >= lim("max_line")) | (big & (s["mean_line"] >= lim("mean_line"))) | (big & (s["space"] < lim("space")) & (s["alnum"] < lim("alnum") + 0.35))
    return F.when(s.isNotNull(), F.when(data, "data").when(minified, "minified").otherwise("source"))


def judge(texts: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    """`texts` with `layout` (the statistics) and `origin`. Null texts have neither; null and unknown languages take the
    default; texts of any length are read whole; repeated rows are judged alike; an empty table gives no rows."""
    out = texts.withColumn("layout", statistics(F.col(text)))
    return out.withColumn("origin", verdict(F.col("layout"), F.coalesce(F.col(language), F.lit(""))))
