"""NumPy kernels for what expressions cannot say: alignment, superposition, areas."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from strandworks.functions.tables import BLOSUM62, BLOSUM_LETTERS, RADII


@lru_cache(1)
def _scores() -> tuple[np.ndarray, np.ndarray]:
    matrix = np.array([row.split() for row in BLOSUM62.strip().splitlines()], np.int64)
    code = np.full(256, BLOSUM_LETTERS.index("X"), np.int64)
    for i, ch in enumerate(BLOSUM_LETTERS):
        code[ord(ch)] = i
    return matrix, code


def align_pair(a: str, b: str, gap: int = -10) -> tuple[str, str, int]:
    """Optimal global alignment with BLOSUM62 and a linear gap penalty.

    Ties are broken by preferring a match, then a gap in ``b``, then one in ``a``,
    walking back from the end.  Rows are filled as arrays: the only dependency along
    a row, a run of gaps, is a running maximum.
    """
    matrix, code = _scores()
    n, m = len(a), len(b)
    s = matrix[code[np.frombuffer(a.encode("latin-1", "replace"), np.uint8)][:, None], code[np.frombuffer(b.encode("latin-1", "replace"), np.uint8)][None, :]]
    h = np.zeros((n + 1, m + 1), np.int64)
    h[0] = gap * np.arange(m + 1)
    ramp = gap * np.arange(m + 1)
    for i in range(1, n + 1):
        best = np.empty(m + 1, np.int64)
        best[0] = gap * i
        np.maximum(h[i - 1, :-1] + s[i - 1], h[i - 1, 1:] + gap, out=best[1:])
        h[i] = np.maximum.accumulate(best - ramp) + ramp
    out_a, out_b, i, j = [], [], n, m
    while i or j:
        if i and j and h[i, j] == h[i - 1, j - 1] + s[i - 1, j - 1]:
            i, j = i - 1, j - 1
            out_a.append(a[i])
            out_b.append(b[j])
        elif i and h[i, j] == h[i - 1, j] + gap:
            i -= 1
            out_a.append(a[i])
            out_b.append("-")
        else:
            j -= 1
            out_a.append("-")
            out_b.append(b[j])
    return "".join(reversed(out_a)), "".join(reversed(out_b)), int(h[n, m])


#: Pairs that are aligned at once, and the cells of their tables.
PAIRS, CELLS = 32, 1 << 24


def align_pairs(pairs: list[tuple[str, str]], gap: int = -10) -> list[tuple[str, str, int]]:
    """:func:`align_pair` of each pair, many at once, row by row.

    A text and itself need no table: no two letters score more than half of what both score
    with themselves, so nothing is above the diagonal, which ties prefer.
    """
    matrix, code = _scores()
    out: list[tuple[str, str, int]] = [("", "", 0)] * len(pairs)
    todo = []
    for k, (a, b) in enumerate(pairs):
        if a == b and gap < 0:
            out[k] = (a, b, int(matrix.diagonal()[code[np.frombuffer(a.encode("latin-1", "replace"), np.uint8)]].sum()))
        elif not a or not b:
            out[k] = align_pair(a, b, gap)
        else:
            todo.append((len(b) // 32, len(a), k))
    group: list[int] = []
    widest = longest = 0
    for _, n, k in sorted(todo):
        m = len(pairs[k][1])
        if group and (len(group) == PAIRS or (len(group) + 1) * max(longest, n) * max(widest, m) > CELLS):
            _align_group(pairs, group, gap, out)
            group, widest, longest = [], 0, 0
        group.append(k)
        widest, longest = max(widest, m), max(longest, n)
    if group:
        _align_group(pairs, group, gap, out)
    return out


def _align_group(pairs: list[tuple[str, str]], group: list[int], gap: int, out: list[tuple[str, str, int]]) -> None:
    """Tables of one size for all pairs; what lies beyond a text reaches no cell of its own."""
    matrix, code = _scores()
    n, m = max(len(pairs[k][0]) for k in group), max(len(pairs[k][1]) for k in group)
    kind = np.int16 if max(-gap, 11) * (n + 2 * m) < 32_000 else np.int64
    first, second = np.zeros((len(group), n), np.int64), np.zeros((len(group), m), np.int64)
    for r, k in enumerate(group):
        for codes, text in ((first, pairs[k][0]), (second, pairs[k][1])):
            codes[r, : len(text)] = code[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    # what each letter scores along the second text
    along = matrix.astype(kind)[:, second]
    each, ramp = np.arange(len(group)), (gap * np.arange(m + 1)).astype(kind)
    last = np.tile(ramp, (len(group), 1))
    best = np.empty_like(last)
    moves = np.empty((n, len(group), m), np.uint8)
    ends = {}
    for r, k in enumerate(group):
        ends.setdefault(len(pairs[k][0]), []).append((r, k))
    scores = {}
    for i in range(n):
        match, up = last[:, :-1] + along[first[:, i], each], last[:, 1:] + kind(gap)
        best[:, 0] = gap * (i + 1)
        np.maximum(match, up, out=best[:, 1:])
        best -= ramp
        row = np.maximum.accumulate(best, axis=1)
        row += ramp
        # 0 a match, 1 a gap in the second text, 2 one in the first, in this order
        other = row[:, 1:] != match
        np.add(other.view(np.uint8), (other & (row[:, 1:] != up)).view(np.uint8), out=moves[i])
        last = row
        for r, k in ends.get(i + 1, ()):
            scores[k] = int(row[r, len(pairs[k][1])])
    for r, k in enumerate(group):
        a, b = pairs[k]
        i, j = len(a), len(b)
        table, width, p, q = moves[:i, r, :j].tobytes(), j, [], []
        while i and j:
            move = table[(i - 1) * width + j - 1]
            if move != 2:
                i -= 1
                p.append(a[i])
            else:
                p.append("-")
            if move != 1:
                j -= 1
                q.append(b[j])
            else:
                q.append("-")
        p.reverse()
        q.reverse()
        out[k] = (a[:i] + "-" * j + "".join(p), "-" * i + b[:j] + "".join(q), scores[k])


def numbers_of(a: str, b: str) -> list[int | None]:
    """For each letter of gapped ``a`` the 1-based place of its partner in gapped ``b``."""
    out: list[int | None] = []
    j = 0
    for x, y in zip(a, b):
        j += y != "-"
        if x != "-":
            out.append(j if y != "-" else None)
    return out


def superpose(fixed: np.ndarray, mobile: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Kabsch: rotation, translation and RMSD that bring ``mobile`` onto ``fixed``."""
    if fixed.shape != mobile.shape or not len(fixed):
        raise ValueError("selections must be of the same, positive size")
    cf, cm = fixed.mean(0), mobile.mean(0)
    u, _, vt = np.linalg.svd((mobile - cm).T @ (fixed - cf))
    d = np.sign(np.linalg.det(u @ vt))
    rotation = u @ np.diag([1.0, 1.0, d]) @ vt
    moved = (mobile - cm) @ rotation + cf
    return rotation, cf - cm @ rotation, float(np.sqrt(((moved - fixed) ** 2).sum(1).mean()))


@lru_cache(4)
def sphere(n: int) -> np.ndarray:
    """``n`` points on the unit sphere along the golden spiral."""
    k = np.arange(n) + 0.5
    z = 1 - 2 * k / n
    phi = k * np.pi * (3 - np.sqrt(5))
    r = np.sqrt(1 - z * z)
    return np.stack([r * np.cos(phi), r * np.sin(phi), z], 1)


def surface_areas(xyz: np.ndarray, elements: list[str], probe: float = 1.4, points: int = 100) -> np.ndarray:
    """Shrake-Rupley accessible area of each atom; NaN for unknown elements."""
    radius = np.array([RADII.get(e.upper(), np.nan) for e in elements]) + probe
    out = np.full(len(xyz), np.nan)
    known = np.flatnonzero(~np.isnan(radius))
    if not len(known):
        return out
    base = sphere(points)
    # cells as wide as two of the largest spheres: neighbours lie in the 27 around
    cell = np.floor(xyz[known] / (2 * radius[known].max())).astype(np.int64)
    held: dict[tuple[int, ...], list[int]] = {}
    for c, i in zip(map(tuple, cell.tolist()), known.tolist()):
        held.setdefault(c, []).append(i)
    steps = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    for (x, y, z), members in held.items():
        around = np.array([j for a, b, c in steps for j in held.get((x + a, y + b, z + c), ())])
        for i in members:
            near = around[((xyz[around] - xyz[i]) ** 2).sum(1) < (radius[around] + radius[i]) ** 2]
            near = near[near != i]
            dots = xyz[i] + base * radius[i]
            hidden = (((dots[:, None, :] - xyz[near][None, :, :]) ** 2).sum(2) < radius[near] ** 2).any(1)
            out[i] = 4 * np.pi * radius[i] ** 2 * (1 - hidden.mean())
    return out


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(vertices, least vertex of their component)`` of a graph of edges ``a - b``, by
    hooking each root to the least root it meets and halving the paths."""
    names, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = code[: len(a)], code[len(a) :]
    up = np.arange(len(names))
    while True:
        x, y = up[u], up[v]
        apart = x != y
        if not apart.any():
            return names, names[up]
        np.minimum.at(up, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(top := up[up], up):
            up = top


LETTERS = "ACDEFGHIKLMNPQRSTVWY"
GAP_OPEN, GAP_EXTEND = -11.0, -1.0


def profile_scan(sequence: str, profile: np.ndarray, gap_open: float = GAP_OPEN, gap_extend: float = GAP_EXTEND) -> tuple[float, int, int, int, int]:
    """Best local match of a sequence to a log-odds profile ``(M, 20)``.

    Score and closed 1-based ranges ``(score, seq_from, seq_to, hmm_from, hmm_to)``,
    zeros if nothing scores above zero.  A Viterbi pass over match, insert and
    delete; its score is its own and not that of any other profile tool.
    """
    letters = "ACDEFGHIKLMNPQRSTVWY"
    code = np.array([letters.find(c) for c in sequence], np.int64)
    m = len(profile)
    neg = -1e9
    match, ins, dele = np.zeros(m + 1), np.full(m + 1, neg), np.full(m + 1, neg)
    origin = np.zeros((m + 1, 2), np.int64)
    i_origin, d_origin = origin.copy(), origin.copy()
    best = (0.0, 0, 0, 0, 0)
    steps = np.arange(1, m + 1)
    for i, c in enumerate(code, 1):
        emit = profile[:, c] if c >= 0 else np.full(m, -1.0)
        stack = np.stack([np.zeros(m), match[:-1], ins[:-1], dele[:-1]])
        take = stack.argmax(0)
        new = np.concatenate([[0.0], stack.max(0) + emit])
        begin = np.stack([np.full(m, i), np.arange(1, m + 1)], 1)
        o = np.concatenate([[[0, 0]], np.choose(take[:, None], [begin, origin[:-1], i_origin[:-1], d_origin[:-1]])])
        grow = np.stack([match + gap_open, ins + gap_extend])
        i_origin = np.where((grow.argmax(0) == 0)[:, None], origin, i_origin)
        ins = grow.max(0)
        # a run of deletions opens after the best earlier match: a running maximum
        opened = new[:-1] + gap_open - gap_extend * steps
        top = np.maximum.accumulate(opened)
        since = np.maximum.accumulate(np.where(opened >= top, steps - 1, 0))
        nd = np.concatenate([[neg], top + gap_extend * steps])
        ndo = np.concatenate([[[0, 0]], o[since]])
        match, origin, dele, d_origin = new, o, nd, ndo
        j = int(match[1:].argmax()) + 1
        if match[j] > best[0]:
            best = (float(match[j]), int(origin[j][0]), i, int(origin[j][1]), j)
    return best


def profile_codes(sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of sequences as places in :data:`LETTERS` (20 for others), a 21 after each
    sequence, and where each sequence begins."""
    table = np.full(256, 20, np.int64)
    table[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(20)
    table[0] = 21
    flat = "\0".join(sequences).encode("latin-1", "replace") + b"\0"
    begins = np.concatenate([[0], np.cumsum([len(s) + 1 for s in sequences])[:-1]])
    return table[np.frombuffer(flat, np.uint8)], begins


def best_ungapped(codes: np.ndarray, begins: np.ndarray, profile: np.ndarray) -> np.ndarray:
    """The best score of each sequence on a stretch without gaps: all sequences at once,
    one column of the profile after the other along the diagonals."""
    table = np.concatenate([profile, np.full((len(profile), 1), -1.0), np.full((len(profile), 1), -1e9)], 1).astype(np.float32)
    run, best = np.zeros(len(codes) + 1, np.float32), np.zeros(len(codes), np.float32)
    for row in table:
        run[1:] = np.maximum(run[:-1], 0) + row[codes]
        np.maximum(best, run[1:], out=best)
    return np.maximum.reduceat(best, begins)


def profile_score(codes: np.ndarray, profile: np.ndarray) -> float:
    """The score of :func:`profile_scan`, without the places."""
    m = len(profile)
    table = np.concatenate([profile, np.full((m, 1), -1.0)], 1).T.copy()
    match, ins, dele = np.zeros(m + 1), np.full(m + 1, -1e9), np.full(m + 1, -1e9)
    ramp, best = GAP_EXTEND * np.arange(1, m + 1), 0.0
    for emit in table[codes]:
        new = np.zeros(m + 1)
        new[1:] = np.maximum(np.maximum(match[:-1], 0.0), np.maximum(ins[:-1], dele[:-1])) + emit
        ins = np.maximum(match + GAP_OPEN, ins + GAP_EXTEND)
        dele = np.concatenate([[-1e9], np.maximum.accumulate(new[:-1] + GAP_OPEN - ramp) + ramp])
        match, best = new, max(best, float(new.max()))
    return best


def profile_columns(profiles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Profiles side by side: the rows of :func:`profile_bounds`, ``(21, columns)``, in 1024ths
    of a nat rounded up, a column after each profile that ends every stretch, where each profile begins, and
    its columns with that one."""
    sizes = np.array([len(p) + 1 for p in profiles])
    begins = np.cumsum(sizes) - sizes
    table = np.full((21, sizes.sum()), -20_000, np.int16)
    for b, p in zip(begins, profiles):
        table[:20, b : b + len(p)] = np.clip(np.ceil(p.T * 1024), -20_000, 15_000)
        table[20, b : b + len(p)] = -1024
    return table, begins, sizes


def profile_bounds(codes: np.ndarray, columns: tuple[np.ndarray, np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """The places of the profiles against which a sequence has a stretch without gaps that scores
    above ``least``: all columns at once, a letter after the other.  None is lost, for
    scores are rounded up; what is cut to fit 16 bits is above ``least`` anyway if that is below 15.6."""
    table, begins, sizes = columns
    low, cap, zero = min(math.floor(least * 1024), 16_000), np.int16(16_384), np.int16(0)
    run, best = np.zeros(table.shape[1] + 1, np.int16), np.zeros(table.shape[1], np.int16)
    here, left, shifted = run[1:], run[:-1], np.empty_like(best)
    for c in codes:
        np.maximum(left, zero, out=shifted)
        np.minimum(shifted, cap, out=shifted)
        np.add(shifted, table[c], out=here)
        np.maximum(best, here, out=best)
    return np.flatnonzero(np.maximum.reduceat(best, begins) > low)


def profile_scores(codes: np.ndarray, profiles: list[np.ndarray]) -> np.ndarray:
    """:func:`profile_score` of a sequence and each of the profiles, all at once."""
    sizes = np.array([len(p) + 1 for p in profiles])
    ends = np.cumsum(sizes) - 1
    table = np.full((21, sizes.sum()), -1.0)
    table[:20] = np.concatenate([x for p in profiles for x in (p, np.full((1, 20), -1e9))]).T
    table[20, ends] = -1e9
    # a run of deletions is a running maximum; each profile lies so far above the one before that none gets across
    apart = sum(float(np.abs(p).max(1).sum()) for p in profiles) / len(profiles) + max(float(np.abs(p).max(1).sum()) for p in profiles) + sizes.max() + 1e3
    ramp = apart * np.repeat(np.arange(len(sizes)), sizes) - GAP_EXTEND * np.arange(sizes.sum())
    back = GAP_OPEN - GAP_EXTEND - ramp
    n = len(ramp)
    match, ins, dele, best = np.zeros(n), np.full(n, -1e9), np.full(n, -1e9), np.zeros(n)
    before, moved = np.zeros(n), np.empty(n)
    for c in codes:
        np.maximum(match, ins, out=moved)
        np.maximum(moved, dele, out=moved)
        np.maximum(moved[:-1], 0.0, out=before[1:])
        before[ends[:-1] + 1] = 0.0
        ins += GAP_EXTEND
        np.maximum(ins, match + GAP_OPEN, out=ins)
        np.add(before, table[c], out=match)
        np.maximum(best, match, out=best)
        np.add(match, ramp, out=moved)
        np.maximum.accumulate(moved, out=moved)
        np.add(moved[:-1], back[1:], out=dele[1:])
    return np.maximum.reduceat(best, ends + 1 - sizes)


def profile_matches(sequence: str, profile: np.ndarray, min_score: float = 0.0) -> list[tuple[float, int, int, int, int]]:
    """Every match of :func:`profile_scan` above ``min_score``, in sequence order: the
    best one, then those left and right of it, so that none overlaps another.  A part
    without a stretch that a match above ``min_score`` must have is not scanned."""
    out, todo, least = [], [(0, len(sequence))], min(max(min_score, 0.0), -GAP_OPEN) - 1e-3
    while todo:
        a, b = todo.pop()
        if a >= b or best_ungapped(*profile_codes([sequence[a:b]]), profile)[0] <= max(least, 0.0):
            continue
        score, i, j, p, q = profile_scan(sequence[a:b], profile)
        if score > max(min_score, 0.0):
            out.append((score, a + i, a + j, p, q))
            todo += [(a, a + i - 1), (a + j, b)]
    return sorted(out, key=lambda m: m[1])
