"""Words, gaps and contexts of texts as arrays, for the sentence model.

A batch of texts becomes one array of code points.  Everything the model reads is
found with array operations on it: words, the gaps between them, and for the gaps
that can hold a boundary the words on both sides as hashes.  Words of scripts
without spaces are stretches of characters: two for Han and kana, four for Thai.
Only quotes and brackets are matched by a loop, over their characters alone.
"""

from __future__ import annotations

import unicodedata

import numpy as np

#: Marks that can end a sentence, and paired quotes and brackets.
MARKS = ".!?…。！？।؟"
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "‹": "›", "“": "”", "„": "“"}
CLOSERS = set(PAIRS.values()) | {'"', "’"}
SOFT = "­​‌‍⁠﻿"
_BORDER = 0x110000

OTHER, WORD, DIGIT, SPACE, MARK, OPEN, CLOSE, THAI, HAN = range(9)
_IS_MARK, _IS_CLOSER, _IS_QUOTE, _IS_LINE, _IS_SOFT, _IS_SEP, _IS_BLANK = (1 << k for k in range(7))

#: One gap that can hold a boundary.  ``end`` is where its sentence would end and
#: ``next`` where the next would begin; ``within`` is the place in the text's list of
#: the event that closes the quotation around, or -1; ``forced`` is 1 or -1 where the
#: definition of a sentence leaves no choice.
EVENT = np.dtype(
    [("end", "<u4"), ("next", "<u4"), ("left", "<u4"), ("left2", "<u4"), ("right", "<u4"), ("right2", "<u4"), ("right3", "<u4"), ("within", "<i4"),
     ("mark", "u1"), ("gap", "u1"), ("lshape", "u1"), ("rshape", "u1"), ("near", "u1"), ("style", "u1"), ("forced", "i1")]
)
START, BREAK, THAI_GAP, STOP, LOUD, DOTS, FULL, QUOTED = range(8)  # kinds of events, by their mark


class _Table:
    """Properties by code point, filled in for those met."""

    def __init__(self):
        n = _BORDER + 1
        self.known = np.zeros(n, bool)
        self.kind = np.zeros(n, np.uint8)
        self.flag = np.zeros(n, np.uint8)
        self.case = np.zeros(n, np.uint8)  # 0 none, 1 upper, 2 lower, 3 letter without case
        self.low = np.zeros(n, np.uint64)
        self.known[_BORDER] = True
        self.low[_BORDER] = _BORDER

    def meet(self, cp: np.ndarray) -> None:
        seen = np.zeros(_BORDER + 1, bool)
        seen[cp] = True
        for c in np.flatnonzero(seen & ~self.known).tolist():
            ch = chr(c)
            cat = unicodedata.category(ch)
            flag = 0
            if ch.isspace():
                kind = SPACE
                flag |= (_IS_LINE if ch in "\r\n" else 0) | (_IS_BLANK if ch in "   " else 0)
            elif ch in MARKS:
                kind, flag = MARK, _IS_MARK
            elif ch in SOFT:
                kind, flag = WORD, _IS_SOFT
            elif 0x0E01 <= c <= 0x0E3A or 0x0E40 <= c <= 0x0E5B:
                kind = THAI
            elif ch == "ー" or (cat[0] == "L" and (0x3040 <= c <= 0x30FF or 0x31F0 <= c <= 0x31FF or 0x2E80 <= c <= 0x2FDF or 0x3400 <= c <= 0x9FFF or 0xF900 <= c <= 0xFAFF or 0x20000 <= c <= 0x3FFFF or c == 0x3005)):
                kind = HAN
            elif cat[0] in "LM":
                kind = WORD
            elif cat[0] == "N":
                kind = DIGIT
            else:
                kind = OPEN if cat in ("Ps", "Pi") or ch == '"' else CLOSE if cat in ("Pe", "Pf") else OTHER
            if ch in CLOSERS:
                flag |= _IS_CLOSER
            if ch == '"' or ch in PAIRS or ch in PAIRS.values():
                flag |= _IS_QUOTE
            if ch in ".,:":
                flag |= _IS_SEP
            self.kind[c], self.flag[c] = kind, flag
            self.case[c] = 1 if ch.isupper() or ch.istitle() else 2 if ch.islower() else 3 if cat[0] == "L" else 0
            self.low[c] = ord(ch.lower()[0])
            self.known[c] = True


_TABLE = _Table()
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _last(flag: np.ndarray) -> np.ndarray:
    """At every place the last place at or before it where ``flag`` holds, or -1."""
    return np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1))


def _first(flag: np.ndarray) -> np.ndarray:
    """At every place the first place at or after it where ``flag`` holds, or the length."""
    n = len(flag)
    return np.minimum.accumulate(np.where(flag, np.arange(n), n)[::-1])[::-1]


def _match(cp: np.ndarray, flag: np.ndarray, kind: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matched quotes: the opener of each closing place (else -1), and the places of
    the outermost pairs, as openers and closers.  Pairs do not cross paragraphs."""
    opener = np.full(len(cp), -1, np.int64)
    at = np.flatnonzero(flag & _IS_QUOTE)
    if not len(at):
        return opener, at, at
    pairs: list[tuple[int, int]] = []
    before = np.maximum(at - 1, 0)
    soft = (kind[before] == SPACE) | (part[before] != part[at]) | (at == 0)
    may_open = soft | ~(((kind[before] == WORD) | (kind[before] == DIGIT) | (kind[before] == HAN) | (kind[before] == THAI)) | (kind[before] == MARK))
    stack: list[tuple[str, int]] = []
    now = -1
    for p, c, g, fresh in zip(at.tolist(), cp[at].tolist(), part[at].tolist(), may_open.tolist()):
        if g != now:
            stack, now = [], g
        ch = chr(c)
        want = '"' if ch == '"' else None
        top = next((k for k in range(len(stack) - 1, -1, -1) if (stack[k][0] == want if want else PAIRS.get(stack[k][0]) == ch)), None)
        if top is not None:
            opener[p] = stack[top][1]
            pairs.append((stack[top][1], p))
            del stack[top:]
        elif (want and fresh) or ch in PAIRS:
            stack.append((ch, p))
    pairs.sort()
    outer: list[tuple[int, int]] = []
    for o, c in pairs:
        if not outer or o > outer[-1][1]:
            outer.append((o, c))
    both = np.array(outer, np.int64).reshape(-1, 2)
    return opener, both[:, 0], both[:, 1]


class Words:
    """Words of a batch: where they begin and end, their hashes and shapes."""

    def __init__(self, texts: list[str]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.stop = self.begin + sizes
        cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        cp[self.stop] = _BORDER
        _TABLE.meet(cp)
        n = len(cp)
        self.cp, self.kind, self.flag = cp, _TABLE.kind[cp], _TABLE.flag[cp]
        kind = self.kind
        border = cp == _BORDER
        kind[border] = SPACE
        self.case = _TABLE.case[cp]
        digit = kind == DIGIT
        left, right = np.roll(digit, 1), np.roll(digit, -1)
        number = digit | ((self.flag & _IS_SEP > 0) & left & right)
        bare = (cp == 46) & right & ~left & ((np.roll(kind, 1) == SPACE) & (np.roll(cp, -1) != _BORDER))
        self.in_number = number | bare
        # runs of one kind; numbers with their separators; single symbols
        run = np.where(number, DIGIT, kind)
        self.run = run
        new = np.ones(n, bool)
        new[1:] = (run[1:] != run[:-1]) | (run[1:] == OTHER) | (run[1:] == OPEN) | (run[1:] == CLOSE) | border[1:] | border[:-1]
        self.run_start = _last(new)
        after = np.append(new[1:], True)
        self.run_end = _first(after) + 1
        # words: stretches of fixed length in Han and Thai runs
        step = np.where(run == HAN, 2, np.where(run == THAI, 4, 1 << 40))
        offset = np.arange(n) - self.run_start
        self.word_at = np.flatnonzero((new | (offset % step == 0)) & (run != SPACE))
        # hashes of any stretch, by prefix sums over what is kept of each character
        small = _TABLE.low[cp].copy()
        keep = (self.flag & _IS_SOFT) == 0
        inner = number & np.roll(number, 1)
        inner[self.begin] = False
        keep &= ~inner
        first = number & ~inner
        length = self.run_end - self.run_start
        small[first & (length <= 2)] = _BORDER + 1
        small[first & (length > 2)] = _BORDER + 2
        self.place = np.concatenate([[0], np.cumsum(keep)])
        kept = mix(small[keep] + np.uint64(1))
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(kept), _BASE, np.uint64)]))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(kept), _BACK, np.uint64)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(kept * power[:-1])])
        solid = kind != SPACE
        self.last_solid, self.first_solid = _last(solid), _first(solid)
        self.border = border

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """32-bit hashes of the stretches from ``a`` to ``b``; 0 if nothing is left."""
        p, q = self.place[a], self.place[b]
        h = mix((self.sums[q] - self.sums[p]) * self.back[p]) >> np.uint64(32)
        return np.where(q > p, np.maximum(h, np.uint64(1)), np.uint64(0)).astype(np.uint32)

    def word_end(self, a: np.ndarray) -> np.ndarray:
        run = self.run[a]
        return np.minimum(self.run_end[a], a + np.where(run == HAN, 2, np.where(run == THAI, 4, 1 << 40)))

    def shape(self, a: np.ndarray) -> np.ndarray:
        """Letter case and kind of the word at ``a``: 0 capital, 1 lower case, 2 number,
        3 without case, 4 opening sign, 5 closing sign, 6 other, 7 single capital."""
        run, case = self.run[a], self.case[a]
        one = self.word_end(a) - a == 1
        letter = (run == WORD) | (run == HAN) | (run == THAI)
        return np.select(
            [run == DIGIT, run == OPEN, run == CLOSE, letter & (case == 1) & one, letter & (case == 1), letter & (case == 2), letter],
            [2, 4, 5, 7, 0, 1, 3], 6,
        ).astype(np.uint8)


def find_events(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """The events of texts that are neither empty nor blank.

    Returns the events of all texts in order, how many each has, ``(first, last)``
    places of each text without white space at its ends, and the words that no event
    can precede, as ``right``, ``right2``, ``right3``, ``rshape`` and ``style``.
    The first event of a text stands at its beginning.
    """
    w = Words(texts)
    n, cp, kind, flag = len(w.cp), w.cp, w.kind, w.flag
    doc = np.cumsum(w.border) - w.border
    ends = w.stop
    first = w.first_solid[w.begin]
    last = w.last_solid[ends - 1] + 1
    # white space: empty lines and gaps between Thai letters
    space = (kind == SPACE) & ~w.border
    line = (flag & _IS_LINE) > 0
    line &= ~((cp == 13) & (np.roll(cp, -1) == 10))
    lines = np.concatenate([[0], np.cumsum(line)])
    new = space.copy()
    new[1:] &= ~space[:-1]
    a = np.flatnonzero(new)
    b = _first(~space)[a]
    a, b = a[a > first[doc[a]]], b[a > first[doc[a]]]
    a, b = a[b < last[doc[a]]], b[b < last[doc[a]]]
    blank = lines[b] - lines[a] > 1
    hard = np.zeros(n + 1, bool)
    hard[a[blank]] = True
    thai = ~blank & (kind[a - 1] == THAI) & (kind[np.minimum(b, n - 1)] == THAI)
    part = np.cumsum(hard[:-1]) + doc  # paragraphs
    opener, outer_open, outer_close = _match(cp, flag, kind, part)
    # marks with the closing signs next to them
    marks = (flag & _IS_MARK > 0) & ~(w.in_number & (w.run_end - w.run_start == 1) & (cp == 46)) & ~(w.in_number & (w.run == DIGIT))
    new = marks.copy()
    new[1:] &= ~(marks[:-1] & (part[1:] == part[:-1]))
    s = np.flatnonzero(new)
    m_end = _first(~marks)[s]
    m_end = np.minimum(m_end, n)
    e = m_end.copy()
    opened = np.full(len(s), -1, np.int64)
    loud_flag = np.isin(cp, [ord(c) for c in "!?！？؟"])
    loud = np.concatenate([[0], np.cumsum(loud_flag)])
    dot = np.concatenate([[0], np.cumsum(cp == 46)])
    dots = np.concatenate([[0], np.cumsum(cp == 0x2026)])
    active = np.arange(len(s))
    while len(active):
        at, st = e[active], s[active]
        at1 = np.minimum(at + 1, n - 1)
        ours = (opener[at] >= 0) & (opener[at] < st)
        spaced = ~ours & (flag[at] & _IS_BLANK > 0) & (opener[at1] >= 0) & (opener[at1] < st) & (part[at1] == part[at])
        single = ~ours & ~spaced & (flag[at] & _IS_CLOSER > 0) & (opener[at] < 0) & ((flag[at] & _IS_QUOTE == 0) | (kind[at] == CLOSE) & (cp[at] != 0x201C))
        more = ~ours & ~spaced & ~single & marks[at] & (at > m_end[active])
        opened[active] = np.where(ours, opener[at], np.where(spaced, opener[at1], opened[active]))
        e[active] = at + np.where(ours | single | more, 1, np.where(spaced, 2, 0))
        active = active[ours | spaced | single | more]
    if len(s):
        free = np.ones(len(s), bool)
        free[1:] = s[1:] >= np.maximum.accumulate(e)[:-1]
        s, m_end, e, opened = s[free], m_end[free], e[free], opened[free]
    is_loud = loud[e] > loud[s]
    is_dots = (dots[e] > dots[s]) | ((dot[m_end] - dot[s] > 1) & (m_end - s > 1))
    mark = np.where(opened >= 0, QUOTED, np.where(is_dots, DOTS, np.where(is_loud, LOUD, np.where(dot[e] > dot[s], STOP, FULL))))
    inner_mark = np.where(is_dots, DOTS, np.where(is_loud, LOUD, np.where(dot[e] > dot[s], STOP, FULL)))
    # paragraph breaks that no mark precedes
    hard_at = a[blank]
    marked = np.zeros(n + 1, bool)
    marked[e] = True
    hard_at = hard_at[~marked[hard_at]]
    thai_at = a[thai]
    thai_at = thai_at[~marked[thai_at]]
    tail = last[~marked[last]]  # texts that end without a mark
    thai_tail, tail = tail[kind[tail - 1] == THAI], tail[kind[tail - 1] != THAI]
    hard_at, thai_at = np.concatenate([hard_at, tail]), np.concatenate([thai_at, thai_tail])
    k0, k1, k2, k3 = len(texts), len(hard_at), len(thai_at), len(s)
    zero = lambda k: np.zeros(k, np.int64)
    begin = np.concatenate([first, hard_at, thai_at, s])
    end = np.concatenate([first, hard_at, thai_at, e])
    mark = np.concatenate([zero(k0) + START, zero(k1) + BREAK, zero(k2) + THAI_GAP, mark])
    inner_mark = np.concatenate([zero(k0), zero(k1), zero(k2), inner_mark])
    opened = np.concatenate([zero(k0) - 1, zero(k1) - 1, zero(k2) - 1, opened])
    of = doc[np.minimum(begin, n - 1)]
    order = np.lexsort((mark, begin, of))
    begin, end, mark, inner_mark, opened, of = (x[order] for x in (begin, end, mark, inner_mark, opened, of))
    m = len(begin)
    ev = np.zeros(m, EVENT)
    nxt = w.first_solid[np.minimum(end, n - 1)]
    final = end >= last[of]
    nxt = np.where(final, last[of], nxt)
    starts = mark == START
    over = ~starts & (hard[end] | final)
    ev["end"], ev["next"] = end - w.begin[of], nxt - w.begin[of]
    gap_lines = lines[np.minimum(nxt, n)] - lines[np.minimum(end, n)] > 0
    ev["gap"] = np.where(over, 3, np.where(nxt == end, 0, np.where(gap_lines, 2, 1)))
    # words on the right
    def rights(at: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = []
        limit = last[doc[np.minimum(at, n - 1)]]
        for _ in range(3):
            alive = alive & (at < limit)
            p = np.where(alive, at, 0)
            q = w.word_end(p)
            cols.append(np.where(alive, w.hash(p, q), 0).astype(np.uint32))
            at = w.first_solid[np.minimum(q, n - 1)]
        return tuple(cols)

    ev["right"], ev["right2"], ev["right3"] = rights(nxt, ~final)
    safe = np.where(final, 0, nxt)
    ev["rshape"] = np.where(final, 15, w.shape(safe))
    first_shape = w.shape(first)
    style = np.where((first_shape == 0) | (first_shape == 7), 0, np.where(first_shape == 1, 1, 2)).astype(np.uint8)
    ev["style"] = style[of]
    # words on the left
    stop = (kind == SPACE) | (kind == OPEN) | (kind == HAN) | (kind == THAI) | w.border | (cp == 0x3000)
    last_stop = _last(stop)

    def lefts(at: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The chunk that ends before ``at``: hash, shape, begin."""
        q = np.where(at > 0, w.last_solid[np.maximum(at - 1, 0)], -1) + 1
        none = q <= low
        q = np.where(none, 1, q)
        c = q - 1
        run = w.run[c]
        p = np.where(run == HAN, np.maximum(q - 2, w.run_start[c]), np.where(run == THAI, np.maximum(q - 4, w.run_start[c]), last_stop[c] + 1))
        p = np.where(kind[c] == OPEN, c, p)
        p = np.minimum(np.maximum(p, low), c)
        size = w.place[q] - w.place[p]
        has_dot = dot[q] - dot[p] > 0
        number = (w.run[p] == DIGIT) & (w.run_end[p] >= q)
        symbol = (run == OTHER) & (w.case[c] == 0)
        initial = (w.case[p] == 1) & (q - p == 1)
        caseless = w.case[p] == 3
        shape = np.select([none, number & (q - p <= 2), number, initial, symbol, w.run[c] == DIGIT], [0, 1, 2, 3, 4, 5], 8 + np.minimum(size, 7) + 8 * has_dot + 16 * caseless)
        h = w.hash(p, q)
        h = np.where(none, 0, np.where(initial, 3, np.where(symbol, 4, h))).astype(np.uint32)
        return h, shape.astype(np.uint8), np.where(none, low, p)

    low = np.where(_last(hard[:-1] | w.border)[np.maximum(begin - 1, 0)] >= 0, _last(hard[:-1] | w.border)[np.maximum(begin - 1, 0)] + 1, 0)
    low = np.maximum(low, first[of])
    h1, shape, p1 = lefts(begin, low)
    h2, _, _ = lefts(p1, low)
    quoted = mark == QUOTED
    o = np.where(quoted, opened, 0)
    lead_at = np.where(o > 0, w.last_solid[np.maximum(o - 1, 0)], -1)
    led = quoted & (lead_at >= low)
    lead_cp = cp[np.maximum(lead_at, 0)]
    lead = np.where(~led | (flag[np.maximum(lead_at, 0)] & (_IS_MARK | _IS_CLOSER) > 0), 0, np.where((lead_cp == 58) | (lead_cp == 0xFF1A), 2, 1))
    bracket = np.isin(cp[o], [ord(c) for c in "([{（［【"])
    ev["left"] = np.where(quoted, 16 + lead * 2 + bracket, h1)
    ev["left2"] = np.where(quoted, inner_mark, h2)
    ev["lshape"] = np.where(quoted, 48 + lead * 2 + bracket, shape)
    ev["mark"] = mark
    # distance from the event before, in words
    count = np.zeros(n + 1, np.int64)
    count[w.word_at + 1] = 1
    count = np.cumsum(count)
    before = np.concatenate([[0], end[:-1]])
    far = count[begin] - count[np.minimum(before, begin)]
    ev["near"] = np.where(far <= 1, 0, np.where(far <= 2, 1, 2))
    # what leaves no choice
    forced = np.where(starts | over, 1, 0)
    within = np.full(m, -1, np.int64)
    if len(outer_open):
        j = np.searchsorted(outer_open, begin, "left") - 1
        inside = (j >= 0) & ~starts & (outer_close[np.maximum(j, 0)] >= end)
        inside &= outer_open[np.maximum(j, 0)] >= w.begin[of]
        close_at = outer_close[np.maximum(j, 0)]
        # the event whose closing signs reach over the closer
        k = np.searchsorted(begin, close_at, "right") - 1
        k = np.where((k >= 0) & (end[np.maximum(k, 0)] > close_at) & (of[np.maximum(k, 0)] == of), k, -1)
        within = np.where(inside & (k >= 0), k, -1)
        forced = np.where(inside & (k < 0) & ~over, -1, forced)
    per = np.bincount(of, minlength=len(texts))
    base = np.concatenate([[0], np.cumsum(per)])[:-1]
    ev["within"] = np.where(within >= 0, within - base[of], -1)
    ev["forced"] = forced
    # words that no event can precede
    taken = np.zeros(n + 1, bool)
    taken[nxt[~final]] = True
    at = w.word_at[~taken[w.word_at]]
    at = at[~(marks[at] & (w.run[at] == MARK))]
    prev = np.maximum(w.last_solid[np.maximum(at - 1, 0)], 0)
    at = at[~marks[prev[: len(at)]] | w.in_number[prev[: len(at)]]] if len(at) else at
    r1, r2, r3 = rights(at, np.ones(len(at), bool))
    inner = {"right": r1, "right2": r2, "right3": r3, "rshape": w.shape(at), "style": style[doc[at]]}
    return ev, per, np.stack([first - w.begin, last - w.begin], 1), inner
