"""What a query says: symbols, candidate words, spelling and budgets. A query is one short text, so this runs on the driver;
what meets the tables afterwards are columns made from it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from grovespark.functions import names

#: Words of a question that are hardly ever the symbol it is about.
COMMON = frozenset(
    """the and for with from this that have been will would could should does done make made use used using work works find found show
call called calling get set add all any how what when where which who why not but are was were has had its can did may also into than
then them each other some such only same about after before between through during without again further once here there both just more
most very being having doing system need needs want wants like look change changes changed changing layer handle handles handling
incoming outgoing data flow flows level levels request requests response responses implement implements implementation interface
interfaces class classes method methods trigger triggers affected affect affects else code failing failed silently decide decides return
returns returned take takes taken check checks checked create creates created read reads write writes written start starts stop stops run
runs running""".split()
)
#: Limits of candidate words of a prompt.
MOST_WORDS, SHORTEST, LONGEST = 16, 4, 24
#: Path prefixes of Rust that are no folders.
RUST_PREFIXES = ["crate", "super", "self"]
#: Output budget by the number of files below which a tier ends: characters, files, characters a file, gap
#: between clusters, symbols in a header, edges of a kind, whether relationships are shown and low-value files left out.
OUTPUT_TIERS = [
    (150, 13000, 4, 3800, 7, 5, 4, False, True),
    (500, 18000, 5, 3800, 8, 6, 6, False, True),
    (5000, 24000, 8, 6500, 12, 10, 10, True, False),
    (15000, 24000, 8, 7000, 15, 15, 15, True, False),
    (None, 24000, 8, 7000, 15, 15, 15, True, False),
]


def symbols(query: str) -> list[str]:
    """Words of a query that may name symbols, in order of kind: camel case, snake case, capitals, acronyms, dotted names with
    their parts, lower-case words of three letters and more; common English words are left out."""
    dotted = re.findall(r"\b([a-zA-Z][a-zA-Z0-9]*(?:\.[a-zA-Z][a-zA-Z0-9]*)+)\b", query)
    found = [w for w in re.findall(r"\b([A-Z][a-z]+(?:[A-Z][a-z]*)*|[a-z]+(?:[A-Z][a-z]*)+)\b", query) if len(w) >= 2]
    found += [w for w in re.findall(r"\b([a-zA-Z][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+)+)\b", query) if len(w) >= 3]
    found += re.findall(r"\b([A-Z]{2,})\b", query)
    for d in dotted:
        found += [d, *(p for p in d.split(".") if len(p) >= 2)]
    found += re.findall(r"\b([a-z][a-z0-9]{2,})\b", query)
    return [w for w in dict.fromkeys(found) if w.lower() not in COMMON]


def prose_words(prompt: str, stop_words: frozenset[str] = COMMON) -> list[str]:
    """Candidate words of a prompt for the vocabulary: letters and digits, without marks and in lower case, of 4 to 24
    characters, no bare numbers, no stop words, each once, the first 16. The stop words are the caller's to give."""
    out: list[str] = []
    for run in re.findall(r"[^\W_]+", prompt or ""):
        w = names.prose_word(run) if len(run) <= LONGEST else ""
        if len(out) < MOST_WORDS and SHORTEST <= len(w) <= LONGEST and not w.isnumeric() and w not in stop_words and w not in out:
            out.append(w)
    return out


def project_tokens(root: str, go_module: str | None = None, package: str | None = None) -> frozenset[str]:
    """Names of the project itself, of five letters and more: last part of a Go module, package name without scope, root folder."""
    raw = [(go_module or "").split("/")[-1], re.sub(r"^@[^/]+/", "", package or ""), root.rstrip("/").split("/")[-1]]
    return frozenset(t for t in (re.sub("[^a-z0-9]", "", x.lower()) for x in raw) if len(t) >= 5)


def spelling(query: str) -> str:
    """`name/2` without its arity and `mod:fn` as `mod.fn`; filters such as `kind:` stay."""
    q = re.sub(r"\b([A-Za-z_][\w@]*)/(\d{1,3})(?=$|[\s,()\[\]/])", r"\1", query)
    return re.sub(r"(^|[\s,()\[\]])(?!(?:kind|lang|language|path|name):)([a-z_][\w@]*):([A-Za-z_][\w@]*)(?=$|[\s,()\[\]])", r"\1\2.\3", q)


def output_budget(n_files: int) -> dict:
    """The tier of OUTPUT_TIERS for a number of files."""
    keys = ["max_chars", "max_files", "max_chars_per_file", "gap", "header_symbols", "edges_per_kind", "relationships", "exclude_low_value"]
    return dict(zip(keys, next(t[1:] for t in OUTPUT_TIERS if t[0] is None or n_files < t[0])))


def term_groups(terms: list[str]) -> list[list[str]]:
    """Terms that contain each other count as one; longest first."""
    out: list[list[str]] = []
    left = sorted(terms, key=len, reverse=True)
    while left:
        head, rest = left[0], left[1:]
        group = [head, *(t for t in rest if t in head or head in t)]
        out.append(group)
        left = [t for t in rest if t not in group]
    return out


def matches_symbol(name: Column, qualified: Column, kind: Column, path: Column, symbol: str) -> Column:
    """True for a node that a written symbol means: by name, by a file's base name; or, for `a.b`, `a::b` and `a/b`, by the
    last part with the others in its qualified name or as folders or files of its path."""
    own = (name == symbol) | ((kind == "file") & (F.regexp_replace(name, r"\.[^.]+$", "") == symbol))
    parts = [p for p in re.split(r"::|[./]", symbol) if p]
    if not re.search(r"[./]|::", symbol) or len(parts) < 2:
        return F.coalesce(own, F.lit(False))
    inside = qualified.contains("::".join(parts)) | qualified.contains(".".join(parts))
    hints = [p for p in parts[:-1] if p not in RUST_PREFIXES]
    bare = F.transform(F.split(path, "/"), lambda s: F.regexp_replace(s, r"\.[^.]+$", ""))
    near = F.lit(bool(hints))
    for h in hints:
        near = near & (F.array_contains(F.split(path, "/"), h) | F.array_contains(bare, h))
    return F.coalesce(own | ((name == parts[-1]) & (inside | near)), F.lit(False))


def is_weak_group(role: Column, span: Column, cohesion: Column) -> Column:
    """A community across modules that spans more than six and hardly holds together."""
    return (role == "cross-module") & (span > 6) & (cohesion < 0.15)


def selector(base: Column, labels: Column) -> Column:
    """Objective-C selector of a Swift method: its base name and the array of its external labels ('_' or null for none)."""
    first = F.get(labels, F.lit(0))
    bare = first.isNull() | first.isin("_", "")
    head = F.when(bare, F.concat(base, F.lit(":"))).otherwise(F.concat(base, F.lit("With"), F.upper(F.substring(first, 1, 1)), F.substring(first, 2, 1 << 20), F.lit(":")))
    rest = F.array_join(F.transform(F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: F.concat(F.coalesce(x, F.lit("")), F.lit(":"))), "")
    return F.when(base == "", None).when(F.size(labels) == 0, base).otherwise(F.concat(head, rest))


def base_names(selector_: Column) -> Column:
    """Names that a Swift caller may use for an Objective-C selector."""
    keywords = F.split(F.regexp_replace(selector_, ":+$", ""), ":")
    first = F.get(keywords, F.lit(0))
    before = F.regexp_extract(first, r"^([a-z][a-zA-Z0-9]*?)(?:With|For|By|In|On|At|From|To|Of|As)[A-Z]", 1)
    prop = F.substring(first, 4, 1 << 20)
    setter = (F.size(keywords) == 1) & first.rlike("^set[A-Z]") & selector_.endswith(":")
    every = F.array(first, F.when(first.startswith("initWith"), "init"), F.nullif(before, F.lit("")), F.when(setter, F.concat(F.lower(F.substring(prop, 1, 1)), F.substring(prop, 2, 1 << 20))))
    return F.when(first == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(every)))
