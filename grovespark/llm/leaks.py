"""Evaluation texts leaking into a corpus: latent semantic retrieval, then longest-common-subsequence checks.

1. Texts are normalised (markup, line wraps, odd spaces away) and cut into overlapping passages of words.
2. TF-IDF over hashed words; a randomised SVD of all passages, distributed: one pass counts frequencies, one sums a
   sketch whose size depends on the number of hash slots and dimensions only.
3. The items' passages, as a block, are compared with every passage of every document by cosine in the latent space.
4. Candidates are checked on the whole texts: the longest common subsequence of their character shingles says which of
   the item's words stand in the document, in the item's order and in a few pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from grovespark.session import cut
from grovespark.sources.tables import spread

#: Words in a passage and between passages' starts; hash slots, a power of two; latent dimensions and extra ones for the sketch.
PASSAGE, STRIDE, SLOTS, DIMS, EXTRA = 40, 20, 8192, 48, 16
#: Cosine from which a document is a candidate for an item; share of the item's words that must be found; characters of
#: a shingle, the least characters of a piece, and the most between its runs.
COSINE, SHARE, SHINGLE, PIECE, NEAR = 0.7, 1 / 3, 10, 40, 60
#: Words that are worked on at once, and columns of a table that are: what fits in a core's cache.
WORDS_AT_ONCE, COLUMNS = 16_384, 16
#: Items compared in one block; more items make more blocks, each with its own pass.
BLOCK = 2000

_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>|&(?:nbsp|amp|lt|gt|quot|#\d+);")
_ESCAPE = re.compile(r"\\[nrt]")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WRAP = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>|*#/]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower case, without tags, escapes, invisible characters and hyphens at line ends."""
    t = _INVISIBLE.sub("", _ESCAPE.sub("\n", text))
    return _WRAP.sub("", _TAG.sub(lambda m: " " if m.group(0)[0] == "&" else "", t)).lower()


def squash(text: str) -> tuple[str, list[tuple[int, int]]]:
    """Letters and digits only, and where each word lies in that."""
    parts, at, n = [], [], 0
    for w in _WORD.findall(text):
        parts.append(w)
        at.append((n, n + len(w)))
        n += len(w)
    return "".join(parts), at


def bare(text: str) -> str:
    """As `squash`, without the words' places."""
    return "".join(_WORD.findall(text))


#: A lighter clean-up for the JVM, where the words of all texts are hashed for retrieval; a pattern runs only over texts
#: that hold its fixed part.
_WRAP_RE, _ESCAPE_RE, _TAG_RE = r"-[ \t]*\r?\n[ \t>|*#/]*", r"\\[nrt]", r"</?[a-zA-Z][^<>\n]*>"
_INVISIBLE_CHARS = "\u200b\u00ad\ufeff\u2060\u200c\u200d\u200e\u200f"
_BETWEEN_RE = r"[\x00-/:-@\[-`{-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2000-\u206f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20]+"


def slots(text: Column) -> Column:
    """Hash slots of a text's words, in order; where a text begins or ends with none, that of the empty word."""
    any_of = lambda parts: reduce(Column.__or__, [text.contains(p) for p in parts])
    odd = any_of(["</", "-\n", "-\r", "- \n", "\\"]) | ((F.octet_length(text) > F.length(text)) & any_of(_INVISIBLE_CHARS))
    whole = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _TAG_RE, ""), _WRAP_RE, ""), _ESCAPE_RE, " ")
    t = F.when(odd, F.translate(whole, _INVISIBLE_CHARS, "")).otherwise(text)
    return F.transform(F.split(F.lower(t), _BETWEEN_RE), lambda w: F.hash(w).bitwiseAND(F.lit(SLOTS - 1)).cast("short"))


def halves(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each half passage of STRIDE words starts in the words of some texts put end to end, and whose it is. n: their
    numbers of words."""
    per = -(-n // STRIDE)
    owner = np.repeat(np.arange(len(n)), per)
    first = np.cumsum(n) - n
    within = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    return first[owner] + within * STRIDE, owner


def columns(table: np.ndarray) -> list[np.ndarray]:
    """A table in blocks of COLUMNS columns. One block stays in a core's cache while rows are picked from it in any order."""
    return [np.ascontiguousarray(table[:, i : i + COLUMNS], dtype=np.float32) for i in range(0, max(1, table.shape[1]), COLUMNS)]


def passage_vectors(flat: np.ndarray, n: np.ndarray, weighted: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, owner) of the passages of some texts: sums of the words' rows of `weighted` over two neighbouring halves,
    so passages overlap by half; a text's last half stands alone only if it has no other."""
    starts, owner = halves(n)
    if not len(starts):
        return np.zeros((0, sum(w.shape[1] for w in weighted)), np.float32), owner
    out = np.concatenate([np.add.reduceat(w[flat], starts, axis=0) for w in weighted], axis=1)
    h = out.copy()
    same = owner[1:] == owner[:-1]
    out[:-1][same] += h[1:][same]
    last = np.r_[~same, True]
    alone = np.r_[True, ~same]
    keep = ~last | alone
    return out[keep], owner[keep]


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, slots put end to end, their number per row) of a batch's texts, some WORDS_AT_ONCE words at a time; a
    longer text comes alone. Rows without slots count with none."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(n)
    i = 0
    while i < len(n):
        before = ends[i] - n[i]
        j = max(i + 1, int(np.searchsorted(ends, before + WORDS_AT_ONCE, side="right")))
        yield i, flat[before : ends[j - 1]], n[i:j]
        i = j


def _summed(words: DataFrame, work, shape: tuple[int, int]) -> np.ndarray:
    """The sum of what `work(slots, numbers, total)` adds to an array of `shape`, over all rows: each task adds up its own
    and sends blocks of rows, which executors add up per block."""
    block = shape[0] // 16

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.float32)
        for b in batches:
            for _, flat, n in _chunks(b.column("slots")):
                work(flat, n, total)
        at = list(range(0, shape[0], block))
        yield pa.RecordBatch.from_pydict({"block": pa.array(at, pa.int32()), "sum": pa.array([total[i : i + block].tobytes() for i in at], pa.binary())})

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": b["block"][:1], "sum": [sum(np.frombuffer(x, np.float32).astype(float) for x in b["sum"]).tobytes()]})

    kind = "block int, sum binary"
    out = np.zeros(shape)
    for b in words.select("slots").mapInArrow(parts, kind).groupBy("block").applyInPandas(add, kind).collect():
        out[b["block"] : b["block"] + block] = np.frombuffer(bytes(b["sum"])).reshape(-1, shape[1])
    return out


def latent(words: DataFrame) -> np.ndarray:
    """Per slot its inverse document frequency times its row of the leading right singular vectors of all passages' TF-IDF
    matrix A, from `words` (slots).

    One pass counts frequencies over all documents. One sums the sketch A'(A R) with a random R; the singular vectors
    follow from that by the Nystroem formula, since A'A ~ Z (R'Z)^-1 Z'. Both passes read every document. The driver gets
    SLOTS x (DIMS + EXTRA) numbers, however large the corpus; tasks send their sums in blocks of slots that executors add up.
    """

    def frequencies(flat: np.ndarray, n: np.ndarray, total: np.ndarray) -> None:
        pairs = np.unique(np.repeat(np.arange(len(n)), n) * SLOTS + flat)
        total[:, 0] += np.bincount(pairs % SLOTS, minlength=SLOTS)
        total[0, 1] += len(n)

    df = _summed(words, frequencies, (SLOTS, 2))
    idf = np.log((1 + df[0, 1]) / (1 + df[:, 0])).astype(np.float32)
    idf[words.sparkSession.range(1).select(F.hash(F.lit("")).bitwiseAND(F.lit(SLOTS - 1))).first()[0]] = 0
    k = DIMS + EXTRA
    r = np.random.default_rng(7).standard_normal((SLOTS, k)).astype(np.float32)
    weighted, squares = columns(idf[:, None] * r), idf**2

    def sketch(flat: np.ndarray, n: np.ndarray, total: np.ndarray) -> None:
        if not len(flat):
            return
        starts, _ = halves(n)
        # Rows of A are the halves here, of unit length; their order within a text plays no part in A'A.
        norm = 1 / np.maximum(np.add.reduceat(squares[flat], starts), 1e-12)[:, None]
        order = np.argsort(flat, kind="stable")
        cs = flat[order]
        first = np.flatnonzero(np.r_[True, cs[1:] != cs[:-1]])
        row = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(flat)]))[order]
        at, by = cs[first], idf[cs[first]][:, None]
        for c, w in enumerate(weighted):
            y = np.add.reduceat(w[flat], starts, axis=0) * norm
            total[at, c * COLUMNS : (c + 1) * COLUMNS] += np.add.reduceat(y[row], first, axis=0) * by

    z = _summed(words, sketch, (SLOTS, k))
    core = r.T @ z
    s, u = np.linalg.eigh((core + core.T) / 2)
    good = s > s.max() * 1e-6
    half = z @ (u[:, good] / np.sqrt(s[good]))
    v, _, _ = np.linalg.svd(half, full_matrices=False)
    return (idf[:, None] * v[:, :DIMS]).astype(np.float32)


@dataclass
class Item:
    item_id: int
    text: str
    at: list[tuple[int, int]]
    answers: list[str] = field(default_factory=list)


def prepare(item_id: int, text: str, answers) -> Item:
    s, at = squash(plain(text))
    return Item(item_id, s, at, [a.lower() for a in answers or [] if a])


#: Multiplier of the shingles' hash, any odd number; bits of the table that tells most foreign shingles at once.
_FACTOR, _TABLE_BITS = 0x9E3779B97F4A7C15, 20


def _shingles(text: str) -> np.ndarray:
    """64-bit hashes of the shingles of a text, in order."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(0, len(a) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(_FACTOR) + a[k : k + n]
    return h


@dataclass
class Shingles:
    """Where each shingle of some items stands: postings `item` and `place` of hash `keys[x]` lie from `first[x]` to `first[x + 1]`.
    The items' squashed texts lie end to end: item m begins at `begin[m]`; all their words are `words` (start, end) there,
    those of item m from `word[m]` on."""

    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    there: np.ndarray
    begin: np.ndarray
    words: np.ndarray
    word: np.ndarray


def shingle_index(items: list[Item]) -> Shingles:
    each = [_shingles(it.text) for it in items]
    n = np.array([len(x) for x in each], np.int64)
    h = np.concatenate(each) if each else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    keys, first = np.unique(h[order], return_index=True)
    there = np.zeros(1 << _TABLE_BITS, bool)
    there[keys >> np.uint64(64 - _TABLE_BITS)] = True
    begin = np.cumsum([0] + [len(it.text) for it in items])
    words = np.concatenate([np.asarray(it.at, np.int64).reshape(-1, 2) + b for it, b in zip(items, begin)]) if items else np.zeros((0, 2), np.int64)
    word = np.cumsum([0] + [len(it.at) for it in items])
    return Shingles(keys, np.r_[first, len(h)], np.repeat(np.arange(len(items)), n)[order], (np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n))[order], there, begin, words, word)


def shared_runs(index: Shingles, doc: str, wanted: set[int], least: float = 0.0) -> dict[int, list[tuple[int, int, int]]]:
    """Per wanted item its runs (start, end, start in the document) of characters shared with the squashed document; with
    `least`, only of items of whose words the runs together cover so large a share: fewer cannot be found in order either."""
    h = _shingles(doc)
    j = np.flatnonzero(index.there[h >> np.uint64(64 - _TABLE_BITS)])
    if not len(j):
        return {}
    x = np.minimum(np.searchsorted(index.keys, h[j]), len(index.keys) - 1)
    same = index.keys[x] == h[j]
    j, x = j[same], x[same]
    count = index.first[x + 1] - index.first[x]
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(index.first[x], count)
    item, i, j = index.item[at], index.place[at], np.repeat(j, count)
    some = np.zeros(len(index.begin), bool)
    some[list(wanted)] = True
    want = some[item]
    item, i, j = item[want], i[want], j[want]
    if not len(item):
        return {}
    # One number holds item, diagonal and place, so that sorting it puts runs together.
    width = int(index.begin[-1]) + 1
    key = np.sort((item * (len(doc) + width) + (j - i + width)) * width + i)
    lane, i = np.divmod(key, width)
    item, diagonal = np.divmod(lane, len(doc) + width)
    a = np.flatnonzero(np.r_[True, (lane[1:] != lane[:-1]) | (i[1:] != i[:-1] + 1)])
    z = np.r_[a[1:], len(item)] - 1
    of, start, end, there = item[a], i[a], i[z] + SHINGLE, diagonal[a] - width + i[a]
    if least:
        edge = np.bincount(index.begin[of] + start, minlength=width) - np.bincount(index.begin[of] + end, minlength=width)
        before = np.zeros(width, np.int32)
        np.cumsum(np.cumsum(edge[:-1], dtype=np.int32) > 0, dtype=np.int32, out=before[1:])
        whole = before[index.words[:, 1]] - before[index.words[:, 0]] == index.words[:, 1] - index.words[:, 0]
        upto = np.r_[0, np.cumsum(whole, dtype=np.int32)]
        share = (upto[index.word[1:]] - upto[index.word[:-1]]) / np.maximum(1, np.diff(index.word))
        keep = share[of] >= least
        of, start, end, there = of[keep], start[keep], end[keep], there[keep]
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for m, *run in zip(of.tolist(), start.tolist(), end.tolist(), there.tolist()):
        runs.setdefault(m, []).append(tuple(run))
    return runs


def found_share(item: Item, runs: list[tuple[int, int, int]]) -> float:
    """Share of the item's words that stand in a document, in order.

    The heaviest chain of shared runs that ascends in both texts is their longest common subsequence. Neighbouring runs of
    the chain, a changed word apart, are one piece; pieces with fewer than PIECE characters are chance or a stock phrase
    and do not count.
    """
    order = sorted(runs)
    ends = sorted({x[2] for x in order})
    best, arg = [0] * (len(ends) + 1), [-1] * (len(ends) + 1)  # prefix maxima, as a binary indexed tree
    weight, back = [], []
    for n, (a, b, j) in enumerate(order):
        w, p, x = 0, -1, bisect_left(ends, j)
        at = x + 1
        while x:
            if best[x] > w:
                w, p = best[x], arg[x]
            x -= x & -x
        w += b - a if p < 0 else max(1, b - max(a, order[p][1]))
        weight.append(w)
        back.append(p)
        while at <= len(ends):
            if best[at] < w:
                best[at], arg[at] = w, n
            at += at & -at
    n, chain = max(range(len(order)), key=weight.__getitem__), []
    while n >= 0:
        chain.append(order[n])
        n = back[n]
    pieces: list[list[tuple[int, int, int]]] = []
    for a, b, j in reversed(chain):
        if pieces:
            a0, b0, j0 = pieces[-1][-1]
            if a - b0 <= NEAR and j - (j0 + b0 - a0) <= NEAR:
                pieces[-1].append((a, b, j))
                continue
        pieces.append([(a, b, j)])
    covered = np.zeros(len(item.text) + 1, np.int64)
    for piece in pieces:
        if sum(b - a for a, b, _ in piece) >= PIECE:
            for a, b, _ in piece:
                covered[a + 1 : b + 1] = 1
    before = np.cumsum(covered)
    words = np.asarray(item.at)
    return float(np.mean(before[words[:, 1]] - before[words[:, 0]] == words[:, 1] - words[:, 0]))


def leaked(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, cosine, share, answers): each document that gives away an item.

    A pair is found if at least `share` of the item's words stand in the document in the item's order, in one or a few
    pieces, however spaced, cased, wrapped or marked up; `answers` counts the item's expected symbols in the document.
    The items are the stated query set: they are read to the driver, in blocks of BLOCK, and go to every task. Documents
    are never shuffled: their words are hashed once and written with them to the shared folder; two passes over the
    hashes fit the latent space and one over both, for each block, searches. Null, empty and blank texts give away
    nothing; items without words are in no document; texts of any length are used whole; repeated documents each get
    their rows. Empty tables: no rows.
    """
    out_type = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("share", T.DoubleType()), T.StructField("answers", T.IntegerType())])
    rows = items.where("text is not null").select("item_id", "text", "expected", slots(F.col("text")).alias("slots")).orderBy("item_id").toLocalIterator()
    blocks: list[list[Item]] = []
    lists: list[list[np.ndarray]] = []
    for r in rows:
        it = prepare(r["item_id"], r["text"], r["expected"])
        if it.at and r["slots"]:
            if not blocks or len(blocks[-1]) >= BLOCK:
                blocks.append([])
                lists.append([])
            blocks[-1].append(it)
            lists[-1].append(np.asarray(r["slots"], np.int64))
    if not blocks:
        return docs.sparkSession.createDataFrame([], out_type)
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null and text <> ''")
    d = cut(spread(d).withColumn("slots", slots(F.col("text"))), "zstd")
    weighted = columns(latent(d))

    def search(block: list[Item], of: list[np.ndarray]) -> DataFrame:
        q, owner = passage_vectors(np.concatenate(of), np.array([len(x) for x in of]), weighted)
        q = _unit(q)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        index = shingle_index(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                res: list[dict] = []
                ids, texts = b.column("doc_id"), b.column("text")
                for at, flat, n in _chunks(b.column("slots")):
                    x, who = passage_vectors(flat, n, weighted)
                    if not len(x):
                        continue
                    near = np.maximum.reduceat(_unit(x) @ q.T, starts, axis=1)
                    edge = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
                    near = np.maximum.reduceat(near, edge, axis=0)
                    for row in np.flatnonzero(near.max(axis=1) >= COSINE):
                        k = at + int(who[edge[row]])
                        hits = {int(owner[starts[h]]): float(near[row, h]) for h in np.flatnonzero(near[row] >= COSINE)}
                        s = bare(plain(texts[k].as_py()))
                        for m, runs in shared_runs(index, s, set(hits), share).items():
                            got = found_share(block[m], runs)
                            if got >= share:
                                res.append({"doc_id": ids[k].as_py(), "item_id": block[m].item_id, "cosine": hits[m], "share": round(got, 6), "answers": sum(a in s for a in block[m].answers)})
                yield pa.RecordBatch.from_pylist(res, to_arrow_schema(out_type))

        return d.mapInArrow(run, out_type)

    out = search(blocks[0], lists[0])
    for b, t in zip(blocks[1:], lists[1:]):
        out = out.unionByName(search(b, t))
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-12)
