import itertools
import math
import random

import numpy as np
import pytest

from strandworks.functions.kernels import _scores, align_pair, numbers_of, profile_matches, profile_scan, superpose, surface_areas
from strandworks.functions.tables import BLOSUM62, BLOSUM_LETTERS, BONDS, PFP


def score_of(a, b, gap=-10):
    matrix, code = _scores()
    return sum(gap if "-" in (x, y) else int(matrix[code[ord(x)], code[ord(y)]]) for x, y in zip(a, b))


def best_score(a, b, gap=-10):
    matrix, code = _scores()
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        if i or j:
            h[i][j] = max(
                ([h[i - 1][j - 1] + int(matrix[code[ord(a[i - 1])], code[ord(b[j - 1])]])] if i and j else []) + ([h[i - 1][j] + gap] if i else []) + ([h[i][j - 1] + gap] if j else [])
            )
    return h[-1][-1]


def test_substitution_matrix_is_symmetric():
    matrix, _ = _scores()
    assert matrix.shape == (24, 24) and (matrix == matrix.T).all() and len(BLOSUM_LETTERS) == 24 and BLOSUM62.count("\n") == 25
    assert len(BONDS) == 53 and len(PFP) == 20


@pytest.mark.parametrize("seed", range(20))
def test_alignment_is_optimal(seed):
    rng = random.Random(seed)
    a, b = ("".join(rng.choice("ACDWX") for _ in range(rng.randrange(0, 12))) for _ in "ab")
    x, y, score = align_pair(a, b)
    assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
    assert score == score_of(x, y) == best_score(a, b)


def test_numbers():
    assert numbers_of("A-CD", "AB-D") == [1, None, 3]


def test_superposition_recovers_a_motion():
    rng = np.random.default_rng(0)
    xyz = rng.normal(size=(20, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    rotation, shift, rmsd = superpose(xyz @ q + [1, 2, 3], xyz)
    assert rmsd < 1e-9 and np.allclose(xyz @ rotation + shift, xyz @ q + [1, 2, 3])
    with pytest.raises(ValueError):
        superpose(xyz, xyz[:5])


def test_areas():
    far = surface_areas(np.array([[0.0, 0, 0], [50, 0, 0]]), ["C", "C"])
    assert np.allclose(far, 4 * math.pi * 3.1**2)
    near = surface_areas(np.array([[0.0, 0, 0], [1.5, 0, 0], [0, 0, 0]]), ["C", "O", "?"])
    assert 0 < near[0] < far[0] and np.isnan(near[2])


def slow_scan(sequence, profile, gap_open=-11.0, gap_extend=-1.0):
    letters, m, neg = "ACDEFGHIKLMNPQRSTVWY", len(profile), -1e9
    match, ins, dele = [0.0] * (m + 1), [neg] * (m + 1), [neg] * (m + 1)
    best = 0.0
    for c in sequence:
        emit = [profile[j][letters.find(c)] if c in letters else -1.0 for j in range(m)]
        new = [0.0] + [max(0.0, match[j], ins[j], dele[j]) + emit[j] for j in range(m)]
        ins = [max(match[j] + gap_open, ins[j] + gap_extend) for j in range(m + 1)]
        nd = [neg] * (m + 1)
        for j in range(1, m + 1):
            nd[j] = max(new[j - 1] + gap_open, nd[j - 1] + gap_extend)
        match, dele = new, nd
        best = max(best, max(match[1:], default=0.0))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_profile_scan(seed):
    rng = np.random.default_rng(seed)
    profile = rng.normal(size=(12, 20)) * 4
    s = "".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWYX"), 40))
    score, a, b, c, d = profile_scan(s, profile)
    assert score == pytest.approx(slow_scan(s, profile)) and 1 <= a <= b <= 40 and 1 <= c <= d <= 12
    assert profile_scan("", profile) == (0.0, 0, 0, 0, 0)


def test_profile_matches_all_domains(spark):
    from strandworks.operators import profiles as P

    rows = [("p", 1, "r", "MKWVHC"), ("q", 1, "r", "GGDDEE")]
    table = P.build(spark.createDataFrame(rows, "msa_id string, ord int, seq_id string, aligned string"))
    seqs = spark.createDataFrame([(1, "AAAMKWVHCAAAAMKWVHCAGGDDEE"), (2, "AAA"), (3, None)], "k int, s string")
    hits = P.search(seqs, "k", "s", table, min_score=8.0)
    assert [(r.k, r.msa_id, r.domain, r.seq_from, r.seq_to, r.hmm_from, r.hmm_to) for r in hits.orderBy("msa_id", "domain").collect()] == [(1, "p", 1, 4, 9, 1, 6), (1, "p", 2, 14, 19, 1, 6), (1, "q", 1, 21, 26, 1, 6)]
    out = P.annotate(hits, seqs.selectExpr("k", "length(s) as size"), "k", min_score=8.0, min_size=5)
    assert sorted(r.name for r in out.collect()) == ["p_1", "p_2", "q_1"] and {r.cov_hmm for r in out.collect()} == {1.0}
    found = profile_matches("ACDXACD", np.where(np.eye(20)[:3], 3.0, -5.0))
    assert [m[1:3] for m in found] == [(1, 3), (5, 7)]


@pytest.mark.parametrize("seed", range(4))
def test_profile_bounds_lose_no_match(seed):
    """The score without places is that of the scan, and the stretch without gaps
    reaches what a match with gaps needs."""
    import random

    from strandworks.functions.kernels import GAP_OPEN, best_ungapped, profile_codes, profile_score

    rng, letters = random.Random(seed), "ACDEFGHIKLMNPQRSTVWY"
    core = "".join(rng.choice(letters) for _ in range(rng.randrange(5, 60)))
    profile = np.full((len(core), 20), -0.7)
    profile[np.arange(len(core)), [letters.index(c) for c in core]] = 2.35
    seqs = ["A", "X" * 9]
    for _ in range(8):
        s = list(core)
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(s))
            s[k : k + rng.randrange(2)] = [rng.choice(letters) for _ in range(rng.randrange(3))]
            s = s or ["A"]
        seqs.append("".join(rng.choice(letters + "X") for _ in range(rng.randrange(20))) + "".join(s))
    codes, begins = profile_codes(seqs)
    free = best_ungapped(codes, begins, profile)
    for i, s in enumerate(seqs):
        score = profile_scan(s, profile)[0]
        assert profile_score(codes[begins[i] : begins[i] + len(s)], profile) == pytest.approx(score)
        assert free[i] >= min(score, -GAP_OPEN) - 1e-3
