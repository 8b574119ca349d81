"""Identifier and query-text functions, as columns or for one query on the driver."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_SEGMENT, MAX_SEGMENT, MAX_SEGMENTS = 2, 32, 12


def segments(name: Column) -> Column:
    """Lower-case words of an identifier: split at humps and non-letters, 2 to 32 characters, no bare numbers, each once,
    the first 12. A null name has none."""
    runs = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), 0)
    parts = F.flatten(F.transform(runs, lambda r: F.split(r, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")))
    low = F.transform(parts, F.lower)
    kept = F.filter(low, lambda s: (F.length(s) >= MIN_SEGMENT) & (F.length(s) <= MAX_SEGMENT) & ~s.rlike(r"^\p{N}+$"))
    return F.slice(F.array_distinct(kept), 1, MAX_SEGMENTS)


def camel_words(s: Column) -> Column:
    """Words of more than one letter of a camel-case, dotted or path-like text."""
    t = F.regexp_replace(F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(t, r"[\s._:/\\]+"), lambda w: F.length(w) > 1)


def lookup_variants(word: Column, least: int = 4) -> Column:
    """A word and the singulars it may be the plural of."""
    two, one = F.expr, F.length(word)
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return F.array_compact(
        F.array(
            word,
            F.when(word.rlike("(x|sh|ss|zz|ch|s|z|o)es$") & (one >= least + 2), cut(2)),
            F.when((word.rlike("(ch|s|z|o)es$") & ~word.rlike("(x|sh|ss|zz)es$") | word.rlike("[^s]s$") & ~word.rlike("(x|sh|ss|zz|ch|s|z|o)es$")) & (one >= least + 1), cut(1)),
        )
    )


def stem_variants(term: Column) -> Column:
    """Shorter forms of a word by its English ending, each of at least three letters and none the word itself; sorted."""
    t, n = F.lower(term), F.length(term)
    cut = lambda k: F.substring(t, F.lit(1), F.length(t) - k)
    doubled = lambda k: F.when(cut(k).rlike(r"(.)\1$"), cut(k + 1))
    ing, er = t.endswith("ing") & (n > 5), t.endswith("er") & (n > 4)
    ies, es = t.endswith("ies") & (n > 4), t.endswith("es") & (n > 4)
    ed = t.endswith("ed") & ~t.endswith("eed") & (n > 4)
    forms = F.array(
        F.when(ing, cut(3)), F.when(ing, F.concat(cut(3), F.lit("e"))), F.when(ing, doubled(3)),
        F.when(t.rlike("(tion|sion)$") & (n > 5), cut(3)), F.when(t.endswith("ment") & (n > 6), cut(4)),
        F.when(ies, F.concat(cut(3), F.lit("y"))), F.when(es & ~ies, cut(2)), F.when(t.endswith("s") & ~t.endswith("ss") & (n > 4) & ~es & ~ies, cut(1)),
        F.when(ed, cut(1)), F.when(ed, cut(2)), F.when(t.endswith("ied") & (n > 5), F.concat(cut(3), F.lit("y"))),
        F.when(er, cut(2)), F.when(er, F.concat(cut(2), F.lit("e"))), F.when(er, doubled(2)),
    )
    return F.array_sort(F.array_distinct(F.filter(F.array_compact(forms), lambda v: (F.length(v) >= 3) & (v != t))))


def is_distinctive(token: Column) -> Column:
    return token.rlike("[_0-9]") | F.substring(token, 2, 1 << 20).rlike("[A-Z]")


def name_token(raw: Column) -> Column:
    return F.regexp_replace(F.lower(raw), "[^a-z0-9]", "")


slug = name_token


def permission_key(permission: Column) -> Column:
    return slug(F.element_at(F.split(permission, r"\."), -1))


def type_path(qualified: Column) -> Column:
    return F.filter(F.split(qualified, r"::|\.|/"), lambda s: s != "")


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance, or most + 1 where it is greater."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def node_id(kind: Column, path: Column, name: Column, line: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat_ws(":", path, kind, name, line), 256), 1, 32))


def hashed_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-1 of the parts, kept apart by a zero character."""
    return F.substring(F.sha1(F.concat_ws("\x00", *parts)), 1, 16)


def fingerprint(members: Column) -> Column:
    """16 hex digits for a set of members, in any order."""
    return F.substring(F.sha2(F.array_join(F.transform(F.array_sort(members), lambda m: F.concat(m, F.lit("\x00"))), ""), 256), 1, 16)


def name_match_bonus(name: Column, query: str) -> Column:
    """80 for the whole query, 60 for one of its words, 10 to 40 for a prefix by its share, 15 for all its terms inside, 10
    for the query inside, else 0."""
    low = F.lower(name)
    terms = [t for t in re.split(r"[\s_.\-]+", re.sub("([a-z])([A-Z])", r"\1 \2", query).lower()) if len(t) >= 2]
    tokens = [t for t in query.lower().split() if len(t) >= 2]
    whole = re.sub(r"\s+", "", query).lower()
    c = F.when(low == whole, 80)
    if len(tokens) > 1:
        c = c.when(low.isin(tokens), 60)
    c = c.when(low.startswith(whole), F.floor(10 + 30.0 * len(whole) / F.length(low) + 0.5).cast("int"))
    if len(terms) > 1:
        inside = F.lit(True)
        for t in terms:
            inside = inside & low.contains(t)
        c = c.when(inside, 15)
    return c.when(low.contains(whole), 10).otherwise(0)


def path_relevance(path: Column, query: str, project: frozenset[str] = frozenset()) -> Column:
    """Per word of the query: 10 if the file name has it, and 5 if the directory has it or else 3 if the path has; 15 less
    for a test file unless the query is about tests. Words that name the project count only if there are no others."""
    from grovespark.functions import paths

    low = F.lower(path)
    file, folder = paths.basename(low), paths.dirname(low)
    every = query.split()
    words = [w for w in every if re.sub("[^a-z0-9]", "", w.lower()) not in project] or every
    score = F.lit(0)
    for w in words:
        parts = search_terms(w)
        if parts:
            has = lambda c, parts=parts: c.rlike("|".join(map(re.escape, parts)))
            score = score + F.when(has(file), 10).otherwise(0) + F.when(has(folder), 5).when(has(low), 3).otherwise(0)
    if "test" not in query.lower() and "spec" not in query.lower():
        score = score - F.when(paths.is_test(path), 15).otherwise(0)
    return score


def search_terms(query: str) -> list[str]:
    """Compound identifiers of a query and their words of at least three letters, in lower case."""
    out: list[str] = []
    for w in re.findall(r"[A-Za-z0-9_.]+", query):
        split = re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z])([A-Z])", r"\1 \2", w))
        parts = [p for p in re.split(r"[\s_.\-]+", split) if p]
        for p in ([w] if len(parts) > 1 else []) + parts:
            p = p.lower()
            if len(p) >= 3 and p not in out:
                out.append(p)
    return out


def prose_word(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c)[0] != "M").lower()


def parse_query(raw: str) -> dict:
    """`kind:`, `lang:`/`language:`, `path:` and `name:` filters of a query, the values of one field joined by OR; quoted
    spans keep their spaces, unknown fields and empty values stay text."""
    out: dict = {"text": [], "kind": [], "language": [], "path": [], "name": []}
    alias = {"kind": "kind", "lang": "language", "language": "language", "path": "path", "name": "name"}
    for token in re.findall(r'(?:[^\s":]+:)?"[^"]*"|\S+', raw):
        f, _, v = token.partition(":")
        v = v.strip('"')
        f = alias.get(f.lower(), "")
        if f and v and (f != "kind" or v.lower() in _KINDS):
            out[f].append(v.lower() if f in ("kind", "language") else v)
        else:
            out["text"].append(token.strip('"'))
    return out | {"text": " ".join(out["text"])}


_KINDS = frozenset("class component constant enum enum_member export field file function import interface method module namespace parameter property protocol route struct trait type_alias variable".split())
