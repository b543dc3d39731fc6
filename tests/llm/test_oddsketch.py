import random

import numpy as np
import pytest

from strandworks.llm import oddsketch
from strandworks.llm.oddsketch import clean, duplicate_classes, odd_sketches, shingle_sets, signatures, similar_pairs, sketch_limit


def grams(s):
    return {s[i : i + 5] for i in range(len(s) - 4)}


def brute(records, threshold=0.5):
    sets = {i: grams(s) for i, s in records if s and len(s) >= 5}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def family(rng, n, size=120):
    base = [rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(size)]
    out = []
    for _ in range(n):
        s = list(base)
        for _ in range(rng.randrange(0, 12)):
            s[rng.randrange(len(s))] = rng.choice("ACDEFGHIKLMNPQRSTVWY")
        out.append("".join(s))
    return out


def records(seed=0):
    rng = random.Random(seed)
    texts = [t for _ in range(12) for t in family(rng, 9)] + family(rng, 40)
    texts += [texts[0]] * 4 + ["AAAAAAAA", "AAAAA", "AAAA", "", None, "ACDEF", "ACDEF"]
    return list(enumerate(texts))


def test_shingles_do_not_cross_texts():
    codes, bounds = shingle_sets(["ABCDEF", "ABCDE", "GHIJKL"])
    assert np.diff(bounds).tolist() == [2, 1, 2] and codes[0] == codes[2]


@pytest.mark.parametrize("similarity", [0.1, 0.5, 0.8])
def test_sketches_estimate_similarity(similarity):
    n, hits = 200, 0
    rng = random.Random(5)
    for _ in range(n):
        pool = rng.sample(range(1 << 24), 300)
        k = int(300 * similarity)
        a, b = pool[: k + (300 - k) // 2], pool[:k] + pool[k + (300 - k) // 2 :]
        codes = np.array(a + b)
        s = signatures(codes, np.array([0, len(a), len(codes)]), oddsketch.SAMPLES)
        x = odd_sketches(s)
        hits += int(np.bitwise_count((x[0] ^ x[1]).view(np.uint64)).sum()) <= sketch_limit(0.5)
    assert hits == n if similarity >= 0.5 else hits < n / 10


@pytest.mark.parametrize(("hot", "exact"), [(256, False), (8, False), (8, True)])
def test_pairs_equal_brute_force(spark, hot, exact):
    rows = records()
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, text string, rep string")
    got = [tuple(r) for r in similar_pairs(df, hot=hot, exact=exact).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_classes_keep_every_record_once(spark):
    rows = records(1)
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: (r.class_id, r.n_links) for r in duplicate_classes(df).collect()}
    usable = [(i, s) for i, s in rows if s and len(s) >= 5]
    rep = {s: min(i for i, t in usable if t == s) for _, s in usable}
    links = brute([(i, s) for s, i in rep.items()])
    assert got == {i: (rep[s], sum(i in p for p in links) if rep[s] == i else got[rep[s]][1]) for i, s in usable}
    assert duplicate_classes(df.limit(0)).count() == 0 and similar_pairs(df.limit(0)).count() == 0


def test_clean(spark):
    df = spark.createDataFrame([("ac-D*\ne 9",), (None,)], "s string")
    assert [r[0] for r in df.select(clean(df.s)).collect()] == ["ACDE", None]
