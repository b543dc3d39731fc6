import random

import numpy as np
import pytest

from strandworks.llm import leakage
from strandworks.llm.leakage import FMIndex, Windows, leaked_items, leaked_spans, normalise, suffix_array


def brute(docs, items, window=32):
    out = set()
    for d, text in docs:
        mine = {x[i : i + window] for x in [normalise(text)] for i in range(len(x) - window + 1)}
        for i, held in items:
            x = normalise(held)
            if any(x[k : k + window] in mine for k in range(len(x) - window + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    s = rng.integers(0, rng.choice([1, 2, 30, 5000]) + 1, rng.integers(1, 300))
    assert suffix_array(s.astype(np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_index_finds_and_locates_every_occurrence():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 80))) for _ in range(20)] + ["abcabc"] * 5
    index = FMIndex([leakage._points(t) for t in texts], sample=4)
    for pattern in ("a", "ab", "abcab", "ccc", "zz"):
        which, lo, hi = index.search(index.encode(leakage._points(pattern))[None, :])
        at = index.locate(np.arange(lo[0], hi[0])) if len(which) else np.zeros(0, int)
        want = [int(index.starts[d]) + k for d, t in enumerate(texts) for k in range(len(t)) if t.startswith(pattern, k)]
        assert sorted(at.tolist()) == want


def corpus():
    rng = random.Random(3)
    words = ["Straße", "ΣΑΣ", "日本語", "x1", "İstanbul", "don't", "ภาษา", "é", "naïve", "42"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(30)] + [(77, None), (78, ""), (None, "a" * 50)]
    items.append((79, items[5][1]))
    docs = []
    for d in range(60):
        body = " ".join(rng.choice(words) for _ in range(20))
        held = rng.choice(items[:30])[1]
        cut = rng.randrange(len(held) + 1)
        docs.append((d, body + "!!" + held[cut : cut + rng.choice([20, 45, 200])] + body))
    docs += [(100, None), (101, ""), (102, items[7][1] * 40), (102, "dup"), (103, items[7][1].upper())]
    return docs, items


@pytest.mark.parametrize(("shard", "block", "at_once"), [(1 << 20, 1 << 18, 1 << 24), (300, 50, 3000)])
def test_leaks_equal_brute_force(spark, shard, block, at_once):
    docs, items = corpus()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = [tuple(r) for r in leaked_items(d, i, shard_chars=shard, block_windows=block, round_chars=at_once).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, [x for x in items if x[0] is not None])


def test_spans_are_whole_and_in_place(spark):
    held = "The quick brown fox jumps over the lazy dog, twice on Sundays."
    text = "Intro. " + held[4:50].upper() + " ... tail"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(9, held)], "item_id long, text string")
    rows = leaked_spans(docs, items).collect()
    assert [(r.doc_id, r.item_id, text[r.span_start : r.span_end]) for r in rows] == [(1, 9, held[4:50].upper().strip())]
    assert leaked_items(docs.limit(0), items).count() == 0 and leaked_items(docs, items.limit(0)).count() == 0


def test_windows_know_all_their_items():
    w = Windows([(k, leakage._points(x)) for k, x in [(1, "a" * 33), (2, "a" * 32), (3, "b" * 5)]])
    assert len(w.points) == 1 and w.owners.tolist() == [1, 2]


def test_blocks_hold_every_window_and_meet_one_index(monkeypatch):
    items = [(k, leakage._points("".join(chr(97 + (i * i + k) % 23) for i in range(n)))) for k, n in ((1, 40), (2, 100), (3, 31), (4, 500))]
    blocks = list(leakage.window_blocks(items, 32, 64))
    assert len(blocks) > 5 and max(len(w.points) for w in blocks) <= 64
    want = {tuple(p[i : i + 32].tolist()) for _, p in items for i in range(len(p) - 31)}
    assert {tuple(r.tolist()) for w in blocks for r in w.points} == want
    built = []
    real = leakage.FMIndex
    monkeypatch.setattr(leakage, "FMIndex", lambda texts: built.append(1) or real(texts))
    doc, item, a, b = leakage._shard_hits([(0, items[3][1], 0)], iter(blocks), 32)
    assert len(built) == 1 and (0, 4, 0, 500) in set(zip(doc.tolist(), item.tolist(), a.tolist(), b.tolist()))


def test_normalised_characters_know_where_they_come_from():
    text = "İx ΣΑΣ. 日本，ß!é"
    points = leakage.normalise_all([text, None, "", "A b"])
    assert [len(p) for p in points] == [len(leakage._origins(text)), 0, 0, 2]
    assert [text[i] for i in leakage._origins(text)] == list("İxΣΑΣ日本ßé")
