"""Garbled text from wrong decoding: learn the transformations from near-twins, then find and restore.

A word that was decoded wrongly keeps its ASCII characters. So the words of the corpus are joined with their near-twins:
words that are equal once non-ASCII characters are stripped. Aligning a rare word with its most frequent twin, character
by character, gives pairs (garbled run, clean run); a pair that some wrong decoding explains is evidence for that
transformation. Transformations with evidence are applied to all texts: sequences that only the wrong decoding of UTF-8
leaves behind are undone in place, and words that are what a transformation makes of a far more frequent word are
replaced. What cannot be undone (lost bytes, replacement characters) is still found.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovespark.session import cut
from grovespark.sources.tables import spread

#: The encodings that texts were written in and read with.
SINGLE = ["cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "cp1254", "koi8_r", "cp866"]
WIDE = ["gbk", "cp932", "big5"]
CYRILLIC = ["cp1251", "koi8_r", "cp866", "iso8859_5"]
#: (written in, read with, loss): loss is '' for none, 'drop' when control characters were lost, 'space' when they and
#: no-break spaces became spaces, '2' and '3' when the same happened twice or thrice.
TRANSFORMS: list[tuple[str, str, str]] = (
    [("utf-8", b, "") for b in SINGLE + WIDE]
    + [("utf-8", b, loss) for b in ("cp1252", "latin-1") for loss in ("drop", "space", "2", "3")]
    + [(a, b, "") for a in CYRILLIC for b in ("cp1251", "koi8_r", "cp866", "cp1252", "latin-1", "mac_roman", "cp437") if a != b]
    + [(a, b, "") for a in ("gbk", "cp932", "euc_jp", "big5", "euc_kr", "cp1250", "iso8859_2", "cp1254", "cp1258", "cp437", "cp850", "mac_roman") for b in ("cp1252", "latin-1")]
    + [("cp1252", b, "") for b in ("cp1251", "cp1250", "cp437", "cp850", "mac_roman", "cp866", "koi8_r", "cp1254")]
)
#: A word is a candidate for a twin if the twin is in at least so many documents for each distinct text with the word, in
#: no fewer distinct texts, and in so many documents at least. So a garbled text counts once, however often it is copied.
RATIO, LEAST_DOCS = 5, 5
#: Distinct words that must speak for a transformation, and for a text being garbled by one; one word of LONG characters
#: is enough for the latter.
SUPPORT, WORDS, LONG = 2, 2, 4
#: Words end at ASCII white space, controls and punctuation.
_DELIM = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


_TABLES: dict[str, list[str]] = {}
_BYTES: dict[str, dict[str, int]] = {}


def _table(codec: str) -> list[str]:
    """Characters of the bytes 0-255; bytes without one are control characters, as lenient readers have it."""
    if codec in _TABLES:
        return _TABLES[codec]
    out = _TABLES[codec] = []
    for x in range(256):
        try:
            out.append(bytes([x]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(x))
    return out


def _bytes_of(codec: str) -> dict[str, int]:
    if codec not in _BYTES:
        _BYTES[codec] = {c: x for x, c in reversed(list(enumerate(_table(codec)))) if x >= 0x80}
    return _BYTES[codec]


def _misread(raw: bytes, codec: str) -> str:
    return raw.decode(codec, "replace") if codec in WIDE or codec in ("euc_jp", "euc_kr") else "".join(map(_table(codec).__getitem__, raw))


def garble(text: str, transform: tuple[str, str, str]) -> str | None:
    """What a transformation makes of a text; None if the text cannot be written in the first encoding."""
    written, read, loss = transform
    try:
        g = _misread(text.encode(written), read)
        for _ in range({"2": 1, "3": 2}.get(loss, 0)):
            g = _misread(g.encode(written), read)
    except UnicodeEncodeError:
        return None
    if loss == "drop":
        g = re.sub("[\x80-\x9f]", "", g)
    elif loss == "space":
        g = re.sub("[\x80-\x9f\xa0]", " ", g).strip()
    return g


def _class(chars: list[str]) -> str:
    return "[" + "".join(f"\\u{ord(c):04x}" for c in sorted(set(chars))) + "]"


def sequences(read: str) -> str:
    """A pattern for what UTF-8 sequences look like when read with a single-byte encoding; the same in Python and Java."""
    t = _table(read)
    two, three, four, rest = (_class([t[x] for x in range(a, b) if t[x] > "\x7f"]) for a, b in ((0xC2, 0xE0), (0xE0, 0xF0), (0xF0, 0xF5), (0x80, 0xC0)))
    return f"{two}{rest}|{three}{rest}{{2}}|{four}{rest}{{3}}"


_PATTERNS: dict[str, re.Pattern] = {}


def spans(text: str, read: str, known: frozenset[str] | dict[str, int]) -> list[tuple[int, int, str]]:
    """(start, end, character) of the sequences that are UTF-8 bytes of one known character read with a single-byte encoding.

    A sequence that stands alone between quotes or backticks, with its character elsewhere in the same line, is quoted as
    an example and is left out.
    """
    if read not in _PATTERNS:
        _PATTERNS[read] = re.compile(sequences(read))
    table, find, out, at = _bytes_of(read), _PATTERNS[read].search, [], 0
    while m := find(text, at):
        i, end = m.span()
        try:
            c = bytes(table.get(x, 0) for x in m.group(0)).decode("utf-8")
        except UnicodeDecodeError:
            c = ""
        if c and ("\U0001f000" <= c < "\U0001fb00" or _likely(c, m.group(0), text[end : end + 1], known)):
            if not _quoted(text, i, end, c):
                out.append((i, end, c))
            at = end
        else:
            at = i + 1
    return out


def _likely(c: str, sequence: str, after: str, known) -> bool:
    """True if a sequence is rather the character it decodes to than text as it stands.

    The character has to be one of the corpus, or a letter, punctuation or symbol of a script in it; how frequent it is
    plays no part by itself. With frequencies at hand (`known` a dictionary), a character much rarer than all of the
    sequence's own counts only if the sequence cannot be a part of a word: if it is no run of letters of one script and a
    letter follows. So sound words of a script whose letters happen to be UTF-8 bytes stay as they are.
    """
    if not isinstance(known, dict):
        return c in known
    if c not in known and (unicodedata.category(c)[0] not in "LPS" or c.isalpha() and _script(c) not in _scripts(known)):
        return False
    if RATIO * known.get(c, 0) >= min(known.get(x, 0) for x in sequence):
        return True
    one_word = sequence.isalpha() and len(set(map(_script, sequence))) == 1
    return not one_word and after.isalpha()


_SCRIPTS: dict[int, tuple[object, frozenset[str]]] = {}


def _scripts(known) -> frozenset[str]:
    """Scripts of some characters, kept for the last ones asked for."""
    if 0 not in _SCRIPTS or _SCRIPTS[0][0] is not known:
        _SCRIPTS[0] = (known, frozenset(map(_script, known)) - {""})
    return _SCRIPTS[0][1]


def _quoted(text: str, start: int, end: int, clean: str) -> bool:
    if not (start and end < len(text) and text[start - 1] in "`\"'" and text[end] == text[start - 1]):
        return False
    a, b = text.rfind("\n", 0, start) + 1, text.find("\n", end)
    return clean in text[a:start] or clean in text[end : b if b >= 0 else len(text)]


def undo(text: str, reads: list[str], known) -> tuple[str, int, str]:
    """(restored text, sequences undone, encoding): again and again by the encoding that explains most of the text, of
    several the one that leads to more frequent characters, until none explains anything. Each round makes the text
    shorter, so a text garbled however often comes to its end."""
    done, by = 0, ""
    while True:
        best: list[tuple[int, int, str]] = []
        how, most = "", (0, 0.0)
        for r in reads:
            s = spans(text, r, known)
            much = (sum(b - a for a, b, _ in s), sum(log(max(1, known.get(c, 1))) for _, _, c in s) if isinstance(known, dict) else 0.0)
            if much > most:
                best, how, most = s, r, much
        if not best:
            break
        parts, at = [], 0
        for a, b, c in best:
            parts += [text[at:a], c]
            at = b
        text = "".join([*parts, text[at:]])
        done, by = done + len(best), by or how
    return text, done, by


#: Transformations with an encoding of several bytes a character on one side; they are undone in runs of characters.
BROAD = [k for k, (a, b, loss) in enumerate(TRANSFORMS) if not loss and (b in WIDE or b in ("cp1252", "latin-1") and a in (*WIDE, "euc_jp", "euc_kr"))]
_RUN = re.compile(r"[^\x00-\x7f]{2,}")
#: Second bytes may be ASCII from '@' on.
_STRETCH = re.compile(r"[^\x00-\x7f][@-~\u0080-\U0010ffff]+")


def _script(c: str) -> str:
    return "CJK" if "\u2e80" <= c < "\ua000" or "\uac00" <= c < "\ufb00" or "\uff00" <= c < "\uff61" or c >= "\U00020000" else unicodedata.name(c, "?").split()[0] if c.isalpha() else ""


def reread(run: str, k: int, freq: dict[str, int]) -> tuple[str, int, float] | None:
    """(clean run, characters in it beyond ASCII, mean log of their frequencies) if transformation k explains a whole run.

    Encoded back with the reading codec, the run must decode with the writing codec to characters of the corpus; bytes
    that a lossy reading replaced, and one cut off at the end, may stay lost. Readers of several bytes make letters of
    anything, so for them the outcome must also be of one script and of characters more frequent than the run's own.
    """
    written, read, _ = TRANSFORMS[k]
    raw = bytearray()
    for c in run:
        if c == "�":
            raw.append(0xFF)
        elif read in WIDE:
            try:
                raw += c.encode(read)
            except UnicodeEncodeError:
                return None
        else:
            x = ord(c) if c < "\x80" else _bytes_of(read).get(c)
            if x is None:
                return None
            raw.append(x)
    lost = 3 * run.count("�") + 2 * (read in WIDE)  # a byte gone takes the rest of its character along
    clean = bytes(raw).decode(written, "replace" if lost else "strict") if lost or _decodes(raw, written) else ""
    got = [c for c in clean if c > "\x7f" and c != "�"]
    if len(got) < 2 or clean.count("�") > min(lost, len(got)) or any(c not in freq for c in got):
        return None
    score = sum(log(freq[c]) for c in got) / len(got)
    scripts = {_script(c) for c in got} - {""}
    if read in WIDE:
        own = [c for c in run if c > "\x7f" and c != "�"]
        if len(scripts) != 1 or score <= sum(log(freq.get(c, 1)) for c in own) / max(1, len(own)) or "CJK" not in scripts and len(got) < 2 * LONG:
            return None
    elif len(set(got)) < 2 or 2 * sum(_script(c) == "CJK" for c in got) <= len(got):
        return None
    return re.sub("�+", "�", clean), len(got), score


def _decodes(raw: bytes, codec: str) -> bool:
    try:
        return bool(bytes(raw).decode(codec))
    except UnicodeDecodeError:
        return False


def undo_broad(text: str, reads: list[str], known, good: frozenset[int], freq: dict[str, int], memo: dict) -> tuple[str, int, str]:
    """(restored text, runs undone, transformation): by the one of BROAD that explains most of the text's runs, the
    likelier characters first where several do. Fewer than LONG characters count only for a learned one. Runs that are
    UTF-8 read with a single-byte encoding throughout are left to `undo`."""
    cuts = {"run": sorted(set(_RUN.findall(text))), "stretch": sorted(set(_STRETCH.findall(text)))}
    best, swap = (0, 0.0), {}
    by = -1
    for k in BROAD:
        part = cuts["run" if TRANSFORMS[k][1] in WIDE or TRANSFORMS[k][0].startswith("euc") else "stretch"]
        n, total, got = 0, 0.0, {}
        for r in part:
            if (r, k) not in memo:
                if len(memo) > 400_000:
                    memo.clear()
                x = reread(r, k, freq)
                memo[r, k] = None if x is None or any(sum(b - a for a, b, _ in spans(r, e, known)) == len(r) for e in reads) else x
            if x := memo[r, k]:
                got[r], n, total = x[0], n + x[1], total + x[1] * x[2]
        if n >= (2 if k in good else LONG) and (total, total / n) > best:
            best, swap, by = (total, total / n), got, k
    if by < 0:
        return text, 0, ""
    pattern = _RUN if TRANSFORMS[by][1] in WIDE or TRANSFORMS[by][0].startswith("euc") else _STRETCH
    return pattern.sub(lambda m: swap.get(m.group(0), m.group(0)), text), len(swap), "<".join(TRANSFORMS[by][:2])


def words(text: Column) -> Column:
    """Distinct words with a non-ASCII character."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), _DELIM), lambda w: w.rlike(r"[^\x00-\x7f]")))


def align(rare: str, clean: str) -> list[tuple[str, str]]:
    """Pairs of non-ASCII runs at the same place of two words that are equal without them."""
    cut_ = lambda w: re.findall("[\x00-\x7f]|[^\x00-\x7f]+", w)
    out, a, b, i, j = [], cut_(rare), cut_(clean), 0, 0
    while i < len(a) or j < len(b):
        x = a[i] if i < len(a) and a[i] > "\x7f" else ""
        y = b[j] if j < len(b) and b[j] > "\x7f" else ""
        if x or y:
            out.append((x, y))
        i, j = i + bool(x) + 1, j + bool(y) + 1
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _explained(rare: pd.Series, clean: pd.Series) -> pd.Series:
    def one(r: str, c: str) -> list[int]:
        runs = [(x, y) for x, y in align(r, c) if x != y]
        if not runs or any(not x or not y for x, y in runs):
            return []
        return [k for k, t in enumerate(TRANSFORMS) if all(garble(y, t) == x for x, y in runs)]

    return pd.Series([one(r, c) for r, c in zip(rare, clean)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("k", T.IntegerType()), T.StructField("g", T.StringType())])))
def _garbled_forms(clean: pd.Series) -> pd.Series:
    def one(w: str) -> list[dict]:
        out = []
        for k, t in enumerate(TRANSFORMS):
            g = garble(w, t)
            if g and g != w and any(c > "\x7f" for c in g):
                out += [{"k": k, "g": x} for x in {g, *(re.split(_DELIM, g) if t[2] == "space" or any(c < "0" for c in g) else [])} if len(x) * 2 >= len(g) and any(c > "\x7f" for c in x)]
        return out

    return pd.Series([one(w) for w in clean], dtype=object)


def learn(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[int], dict[str, int]]:
    """(map, transformations, characters) learned from all documents.

    map: (word, k, clean), one row per garbled word and transformation. transformations: indices into TRANSFORMS with
    evidence, at most len(TRANSFORMS). characters: all of the corpus with the number of documents
    and words of each. There are no more than Unicode has. All are small whatever the corpus and are all that reaches the driver.
    """
    each = docs.select(F.xxhash64(text).alias("h"), F.explode(words(F.col(text))).alias("word")).groupBy("word", "h").agg(F.count(F.lit(1)).alias("c"))
    vocab = cut(each.groupBy("word").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("texts")))
    often = vocab.where(F.col("n") >= LEAST_DOCS)
    bare = F.regexp_replace("word", r"[^\x00-\x7f]", "")
    keyed = vocab.withColumn("bare", bare).where(F.length("bare") >= 3)
    top = keyed.groupBy("bare").agg(F.max_by(F.struct("word", "n", "texts"), F.struct("texts", "n", (-F.length("word")).alias("l"), "word")).alias("top"))
    twins = keyed.join(top, "bare").where((F.col("top.n") >= LEAST_DOCS) & (F.col("top.n") >= RATIO * F.col("texts")) & (F.col("top.texts") >= F.col("texts")))
    seen = twins.select("word", F.explode(_explained(F.col("word"), F.col("top.word"))).alias("k"))
    forms = often.select(F.col("word").alias("clean"), F.col("n").alias("n_clean"), F.col("texts").alias("t_clean"), F.explode(_garbled_forms(F.col("word"))).alias("f")).select("clean", "n_clean", "t_clean", "f.k", F.col("f.g").alias("word"))
    clear = (F.col("n_clean") >= RATIO * F.col("texts")) & (F.col("t_clean") >= F.col("texts"))
    pairs = forms.join(vocab, "word").withColumn("clear", clear).groupBy("word", "k")
    made = cut(pairs.agg(F.max_by(F.struct("clean", "clear", "t_clean", "texts"), F.struct("clear", "n_clean", "clean")).alias("m")).select("word", "k", "m.*"))
    # Scripts without any ASCII leave nothing to align; for them long words that a transformation leads to are evidence.
    seen = seen.unionByName(made.where(F.col("clear") & (F.length("clean") >= LONG)).select("word", "k"))
    good = sorted(r.k for r in seen.distinct().groupBy("k").count().where(F.col("count") >= SUPPORT).collect())
    # What a learned transformation makes of a long word is garbled however frequent it is; only where the reverse was
    # learned too, the direction has to be clear.
    two_way = [k for k in good for j in good if TRANSFORMS[k][:2] == TRANSFORMS[j][1::-1]]
    made = made.where(F.col("clear") | (F.length("clean") >= LONG) & ~F.col("k").isin(two_way)).select("word", "k", "clean")
    # Every character beyond ASCII stands in a word, so the vocabulary has them all, with the words' documents as their weight.
    chars = vocab.select("n", F.explode(F.array_distinct(F.split(F.regexp_replace("word", r"[\x00-\x7f]+", ""), ""))).alias("c")).where("c <> ''").groupBy("c").agg(F.sum("n").alias("count"))
    return made.where(F.col("k").isin(good)), good, {r.c: r["count"] for r in chars.collect()}


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, encoding, n_sequences, n_words, n_lost, restored) of each garbled document.

    n_sequences: undone in place; n_words: words replaced by the clean word they came from, counted only with WORDS
    distinct ones or a long one; n_lost: replacement characters, which stay. `encoding` names the first transformation
    found. Null and empty texts are never garbled; texts of any length are handled whole; repeated texts give equal rows.
    An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    docs = spread(docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))).where(F.col("text").rlike(r"[^\x00-\x7f]"))
    made, good, freq = learn(docs)
    reads = list(dict.fromkeys(TRANSFORMS[k][1] for k in good if TRANSFORMS[k][0] == "utf-8" and TRANSFORMS[k][1] in SINGLE))

    # What garbling makes of known characters is known too, so that text garbled twice can be undone step by step.
    known = dict.fromkeys((c for k in freq for r in reads for c in garble(k, ("utf-8", r, "")) or ""), 1) | freq

    learned = frozenset(good)

    @F.pandas_udf("struct<text:string,n:int,by:string,broad:boolean>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run, hot, memo = re.compile(r"[^\x00-\x7f]{2,}"), {}, {}

        def suspicious(text: str) -> bool:
            for r in set(run.findall(text)):
                if r not in hot:
                    if len(hot) > 200_000:
                        hot.clear()
                    hot[r] = any(spans(r + "a", x, known) for x in reads)
                if hot[r]:
                    return True
            return False

        def one(t: str) -> tuple[str, int, str, bool]:
            b, m, how = undo_broad(t, reads, known, learned, freq, memo)
            r, n, by = undo(b, reads, known) if suspicious(b) else (b, 0, "")
            return r, n + m, how or f"utf-8<{by}", m > 0

        for s in batches:
            yield pd.DataFrame([one(t) for t in s], columns=["text", "n", "by", "broad"])

    by_word = docs.select("_key", F.explode(words(F.col("text"))).alias("word")).join(made, "word")
    votes = by_word.groupBy("_key", "k").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("clean")).alias("long"), F.map_from_entries(F.collect_list(F.struct("word", "clean"))).alias("swap"))
    votes = votes.where((F.col("n") >= WORDS) | (F.col("long") >= LONG)).groupBy("_key").agg(F.max_by(F.struct("k", "n", "swap"), F.struct("n", (-F.col("k")).alias("k"))).alias("v"))
    named = F.array(*[F.lit("<".join(x for x in t if x)) for t in TRANSFORMS])

    @F.pandas_udf("string")
    def swap(texts: pd.Series, maps: pd.Series) -> pd.Series:
        def one(t: str, m) -> str:
            m = dict(m) if m is not None else {}
            if not m:
                return t
            return "".join(m.get(p, p) for p in re.split(f"({_DELIM})", t))

        return pd.Series([one(t, m) for t, m in zip(texts, maps)], dtype=object)

    # Replacement characters count unless they stand alone in quotes.
    lost = F.regexp_count("text", F.lit("�")) - F.regexp_count("text", F.lit("[`\"']�+[`\"']"))
    # Only texts with two characters beyond ASCII in a row (or one between that may be a second byte), a lost character or a garbled word go to Python.
    suspect = F.col("text").rlike(r"[^\x00-\x7f]([@-~]?[^\x00-\x7f])")
    res = docs.withColumn("n_lost", lost).withColumn("_s", suspect).join(votes, "_key", "left").where(F.col("_s") | F.col("v").isNotNull() | (F.col("n_lost") > 0))
    res = res.withColumn("u", apply(F.col("text"))).where((F.col("u.n") > 0) | F.col("v").isNotNull() | (F.col("n_lost") > 0))
    # Where words speak for another first encoding than UTF-8, what looks like UTF-8 is chance and is not undone.
    other = F.coalesce(F.col("v.k").isin([k for k, t in enumerate(TRANSFORMS) if t[0] != "utf-8"]), F.lit(False))
    undone = (F.col("u.n") > 0) & (~other | F.col("u.broad"))
    return res.select(
        F.col("_key").alias(key),
        F.when(undone, F.col("u.by")).when(F.col("v").isNotNull(), F.get(named, F.col("v.k"))).otherwise("lost").alias("encoding"),
        F.when(undone, F.col("u.n")).otherwise(0).alias("n_sequences"),
        F.coalesce("v.n", F.lit(0)).alias("n_words"),
        F.col("n_lost").cast("long").alias("n_lost"),
        swap(F.when(undone, F.col("u.text")).otherwise(F.col("text")), F.when(~undone, F.col("v.swap"))).alias("restored"),
    )
