import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovespark.llm import leaks, mojibake, tokens

VOCAB = os.path.join(tokens.DEFAULT_FOLDER, "byte_bpe_50k.tiktoken")
needs_vocab = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary")


def _brute_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merge_against_brute_force():
    rnd = random.Random(2)
    ranks = {bytes([c]): c for c in b"abc"}
    for _ in range(200):
        a, b = rnd.choice(list(ranks)), rnd.choice(list(ranks))
        ranks.setdefault(a + b, len(ranks) + 300)
    for _ in range(300):
        piece = bytes(rnd.choice(b"abc") for _ in range(rnd.randint(1, 60)))
        got = tokens.merge(piece, ranks)
        assert got == ([ranks[piece]] if piece in ranks else _brute_merge(piece, ranks))


@needs_vocab
def test_ids_against_public_library(spark):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=tokens.load_ranks(VOCAB), special_tokens={})
    texts = ["Hello world", "", None, " ", "<|endoftext|> x", "naïve — 漢字 😀 \n\n\t x1'll", "a" * 5000, " \u200b x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in df.select("doc_id", tokens.encode(df.text).alias("ids")).collect()}
    assert got == {i: lib.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    for i, t in enumerate(texts):
        if t:
            assert lib.decode(got[i]) == t


WORDS = "amber barrier compass drawer envelope ferry grammar hinge indigo journal kettle lantern mirror nettle offset parcel quarry rudder shard turnstile umbrella visitor wharf yonder".split()
PLAIN = "the index lists files above the limit and keeps every row that changed since the last run of the nightly job".split()


def _texts():
    rnd = random.Random(4)
    item = lambda: " ".join(rnd.choice(WORDS) + rnd.choice(["", "s", "ed"]) for _ in range(90)) + "."
    items = [(100 + i, item(), [f"answer{i}"]) for i in range(4)]
    noise = lambda n=80: " ".join(rnd.choice(PLAIN) for _ in range(n))
    w = items[0][1].split()
    docs = {
        1: noise() + " " + items[0][1] + " " + noise(),
        2: noise() + "\n> " + "\n> ".join(" ".join(w[i : i + 9]).upper() for i in range(0, 90, 9)),
        3: noise() + " " + " ".join(w[:40]) + " " + noise(20) + " " + " ".join(w[50:]),
        4: " ".join(x if i % 9 else "changed" for i, x in enumerate(w)) + " " + noise(),
        5: noise() + " " + " ".join(f"<em>{x}</em>" if i % 3 == 0 else x for i, x in enumerate(w)),
        6: noise() + " " + " ".join(w[10:22]) + " " + noise(),  # a short quotation
        7: item() + " " + item(),  # the same kind of text, another one
        8: noise(400),
        9: None, 10: "", 11: "  ", 12: "x" * 50_000,
        13: "\u200b".join(["", *[x + " " for x in w]]),
    }
    return items, docs


def test_leaks_recall_against_brute_force(spark):
    items, docs = _texts()
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as slots")
    i = spark.createDataFrame(items + [(200, None, None), (201, "", []), (202, "...", None)], "item_id long, text string, expected array<string>")
    ready = [leaks.prepare(*x) for x in items]
    index, want = leaks.shingle_index(ready), set()
    for k, t in docs.items():
        for n, runs in leaks.shared_runs(index, leaks.squash(leaks.plain(t or ""))[0], {0, 1, 2, 3}).items():
            if leaks.found_share(ready[n], runs) >= leaks.SHARE:
                want.add((k, ready[n].item_id))
    assert want == {(k, 100) for k in (1, 2, 3, 4, 5, 13)}
    got = {(r.doc_id, r.item_id) for r in leaks.leaked(d, i).collect()}
    assert len(got & want) >= 0.9 * len(want) and got <= want
    assert leaks.leaked(d, i.where("false")).count() == 0
    assert leaks.leaked(d.where("false"), i).count() == 0


def _joined(runs):
    out = []
    for a, b, _ in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, 0])
    return out


def _naive_runs(items, doc, wanted):
    out = {}
    for n in wanted:
        t, k = items[n].text, leaks.SHINGLE
        hits = {(i, j) for i in range(len(t) - k + 1) for j in range(len(doc) - k + 1) if t[i : i + k] == doc[j : j + k]}
        for i, j in hits:
            if (i - 1, j - 1) not in hits:
                e = 0
                while (i + e + 1, j + e + 1) in hits:
                    e += 1
                out.setdefault(n, []).append((i, i + e + k, j))
    return {n: sorted(r) for n, r in out.items()}


def test_shared_runs_against_brute_force():
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("ab é漢😀") for _ in range(n))
    for _ in range(20):
        base = text(120)
        items = [leaks.prepare(k, base[:40] + text(40) + base[60:], None) for k in range(3)] + [leaks.prepare(9, "short", None)]
        doc = leaks.squash(base + text(30) + base[20:90] + base)[0]
        index = leaks.shingle_index(items)
        got = leaks.shared_runs(index, doc, {0, 2, 3})
        assert {n: sorted(r) for n, r in got.items()} == _naive_runs(items, doc, {0, 2, 3})
        every = leaks.shared_runs(index, doc, {0, 1})
        covered = {n: sum(any(a <= x and y <= b for a, b, _ in _joined(r)) for x, y in items[n].at) / len(items[n].at) for n, r in every.items()}
        for least in (0.3, 0.6, 0.9):
            assert leaks.shared_runs(index, doc, {0, 1}, least) == {n: r for n, r in every.items() if covered[n] >= least}
    assert leaks.shared_runs(leaks.shingle_index([]), "anything at all", set()) == {} == leaks.shared_runs(index, "", {0})


def test_latent_directions_use_every_document(spark, monkeypatch):
    _, docs = _texts()
    words = spark.createDataFrame([(t,) for t in docs.values() if t], "text string").withColumn("slots", leaks.slots(F.col("text")))
    whole = leaks.latent(words)
    monkeypatch.setattr(leaks, "FIT_DOCS", 3, raising=False)
    assert np.allclose(leaks.latent(words), whole, atol=1e-5)


CLEAN = ["Das Ergebnis hängt nicht von der Größe ab, sagte Jürgen übermütig.", "L’étape a été oubliée à cause du délai.", "Подробности описаны в заметке о проекте.", "Порядок строк больше не имеет значения.", "That’s the façade module – “isn’t” a naïve scan.", "Należy najpierw wyczyścić pamięć podręczną między węzłami."]
BROKEN = {
    100: (0, ("utf-8", "cp1252", "")), 101: (1, ("utf-8", "latin-1", "")), 102: (2, ("cp1251", "koi8_r", "")), 103: (4, ("utf-8", "mac_roman", "")), 104: (4, ("utf-8", "cp1252", "2")),
    105: (5, ("cp1250", "cp1252", "")), 106: (0, ("utf-8", "cp850", "")), 107: (3, ("cp1251", "koi8_r", "")), 108: (5, ("cp1250", "cp1252", "")), 109: (4, ("utf-8", "cp1250", "")),
}


def test_garbled_texts_are_found_and_restored(spark):
    rows = [(i, CLEAN[i % len(CLEAN)]) for i in range(90)]
    rows += [(k, "Plain words first. " + mojibake.garble(CLEAN[n], t)) for k, (n, t) in BROKEN.items()]
    rows += [(200, 'The reader must turn "Ã¼" back into "ü".'), (201, None), (202, ""), (203, "ascii only"), (204, "Il manque une cl� pour la suite."), (205, "x" * 100_000 + " é")]
    df = spark.createDataFrame(rows + [(206, rows[90][1])], "doc_id long, text string").selectExpr("*", "1 as word", "2 as k")
    got = {r.doc_id: r for r in mojibake.detect(df).collect()}
    assert set(got) == set(BROKEN) | {204, 206}
    for k, (n, t) in BROKEN.items():
        if t[0] == "utf-8":
            assert got[k].restored == "Plain words first. " + CLEAN[n]
    assert got[206].restored == got[100].restored and got[204].n_lost == 1
    assert mojibake.detect(df.where("false")).count() == 0


def test_copies_of_a_garbled_text_do_not_hide_it(spark):
    rows = [(i, f"{CLEAN[2 + i % 2]} no {i}") for i in range(40)]
    bad = [mojibake.garble(CLEAN[2 + n], ("cp1251", "koi8_r", "")) for n in (0, 1)]
    rows += [(100 + i, bad[i % 2]) for i in range(60)] + [(200 + i, f"{bad[0]} no {i}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in mojibake.detect(df).collect()} == {i for i, _ in rows if i >= 100}


UNIQUE = ["设置页面的重复计数不再读取隐藏目录", "件の画面に題名がないので設定を表示する", "從這個版本開始讀取設定檔案"]


@pytest.mark.parametrize("n, t", [(0, ("utf-8", "gbk", "")), (0, ("gbk", "cp1252", "")), (0, ("gbk", "latin-1", "")), (1, ("euc_jp", "latin-1", "")), (1, ("cp932", "cp1252", "")), (2, ("big5", "cp1252", ""))])
def test_unique_clauses_of_scripts_without_ascii_are_found(spark, n, t):
    rows = [(i, "".join(random.Random(i).sample(UNIQUE[i % 3], len(UNIQUE[i % 3])))) for i in range(30)]
    want = UNIQUE[n]
    rows += [(100, "See: " + mojibake.garble(want, t)), (101, "Où l’été… naïveté déjà «été» ÀÉ ———— ···· °°°")]
    got = {r.doc_id: r for r in mojibake.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {100}
    if t[1] == "gbk":  # lost bytes stay lost
        assert sum(c in got[100].restored for c in want) >= len(want) - 3
    else:
        assert got[100].restored == "See: " + want


def test_rare_characters_are_found(spark):
    rows = [(i, CLEAN[i % len(CLEAN)]) for i in range(90)] + [(90, "Żaba i Őr"), (91, "МГУ» и СПБГУ» в списке")]
    rows += [(100 + i, mojibake.garble(CLEAN[i % 2], ("utf-8", "cp1252", ""))) for i in range(4)]
    rows += [(200, "A " + mojibake.garble("Żaba", ("utf-8", "cp1252", "")) + " here"), (201, "A " + mojibake.garble("caĝo", ("utf-8", "cp1252", "")) + " here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.restored for r in mojibake.detect(df).collect()}
    assert set(got) == {100, 101, 102, 103, 200, 201} and got[200] == "A Żaba here" and got[201] == "A caĝo here"


def test_alignment_finds_runs():
    assert mojibake.align("faÃ§ade", "façade") == [("Ã§", "ç")]
    assert mojibake.align("isnâ€™t", "isn’t") == [("â€™", "’")]
    assert mojibake.garble("é", ("utf-8", "cp1252", "")) == "Ã©"
    assert mojibake.undo("Ã©tÃ©", ["cp1252"], frozenset("é")) == ("été", 2, "cp1252")
