"""The hidden-event language model over events given as arrays.

Sentences begin and end for sure at the ends of texts and paragraphs.  A context, the
words before or after an event, is told by how often it stands at such sure places
against how often at events inside texts: openings and closings stand at both at one
common rate, what goes on stands at the latter alone.
"""

from __future__ import annotations

import numpy as np

from strandworks.llm.sentence_events import BREAK, DOTS, QUOTED, START, THAI_GAP, mix

#: Counts live in two rows of so many slots each, whatever the corpus: every event
#: and word of every text is counted, and two contexts share a slot in both rows only
#: by chance.  A context's counts are read from the row where its slot holds less.
SLOTS = 1 << 20
#: Totals stand behind the slots.
EXTRA = 16
WIDTH = 2 * SLOTS + EXTRA
_TOTAL = 2 * SLOTS
#: Expected counts by mark, gap and quotation come first, then those by distance.
CLASSES = 64
SURE, MID, INNER = range(3)
_LSHAPE, _LEFT, _LEFT2, _RSHAPE, _RIGHT, _RIGHT2, _RIGHT3 = range(1, 8)
#: Parts of a context's events that may be boundaries, and how likely each is before
#: anything is known: most contexts always or never are.
_PARTS = np.array([0.01, 0.1, 0.3, 0.5, 0.7, 0.9, 0.99])
#: How alike the rates of sure places are between contexts that are all boundaries: some
#: sentences open texts more often than others.  The shape of a gamma distribution.
SPREAD_LEFT, SPREAD_RIGHT = 3.0, 1.0
#: How often a context must be seen to count as much as the next shorter one.
BACKOFF = 4.0
#: Log odds where the definition of a sentence itself decides: white space between Thai
#: letters, and a capital after dots or a quotation, after which a sentence goes on in
#: lower case.
DEFINED = 9.0
_BELIEF = np.array([6.0, 1.0, 0.5, 0.5, 0.5, 1.0, 6.0])


def slots(kind: int, *parts: np.ndarray) -> np.ndarray:
    """Slots of contexts in both rows, shape ``(2, n)``."""
    h = np.full(len(parts[0]), kind, np.uint64)
    for p in parts:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.uint64))
    h = mix(h)
    return np.stack([(h & np.uint64(SLOTS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(SLOTS - 1)).astype(np.int64) + SLOTS])


def _class(ev: np.ndarray) -> np.ndarray:
    return ev["mark"].astype(np.int64) * 4 + np.minimum(ev["gap"], 2) + 32 * (ev["within"] >= 0)


def _contexts(ev: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    left = [
        slots(_LSHAPE, ev["mark"], ev["lshape"], ev["gap"] == 0),
        slots(_LEFT, ev["mark"], ev["left"]),
        slots(_LEFT2, ev["mark"], ev["left"], ev["left2"]),
    ]
    right = [slots(_RIGHT, ev["right"]), slots(_RIGHT2, ev["right"], ev["right2"]), slots(_RIGHT3, ev["right"], ev["right2"], ev["right3"])]
    return left, right


def count(ev: np.ndarray, per: np.ndarray, inner: dict[str, np.ndarray], into: np.ndarray) -> None:
    """Add the counts of a batch: contexts at sure places, at events inside texts, and
    words inside sentences.  An event inside a text counts as many sure places as its
    text has for each, so that contexts of long texts are not taken for continuations."""
    sure = ev["forced"] > 0
    starts = ev["mark"] == START
    mid = ev["forced"] == 0
    ends, opens = sure & ~starts & (ev["mark"] != BREAK), sure & (ev["right"] > 0)
    of = np.repeat(np.arange(len(per)), per)
    share = np.bincount(of[opens], minlength=len(per)) / np.maximum(np.bincount(of[mid], minlength=len(per)), 1)
    weight = np.where(mid, share[of], 1.0)
    for column, lefts, rights in ((SURE, ends, opens), (MID, mid, mid)):
        left, right = _contexts(ev[lefts])[0], _contexts(ev[rights])[1]
        shape = ev[rights & ~starts]
        right = [*right, slots(_RSHAPE, shape["style"], shape["rshape"])]
        wl, wr, ws = weight[lefts], weight[rights], weight[rights & ~starts]
        weights = [wl] * (2 * len(left)) + [wr] * (2 * len(right) - 2) + [ws] * 2
        into[column] += np.bincount(np.concatenate([x.ravel() for x in left + right]), np.concatenate(weights), WIDTH)
        into[column, _TOTAL : _TOTAL + 4] += wl.sum(), wr.sum(), ws.sum(), len(wl)
    words = [slots(_RIGHT, inner["right"]), slots(_RIGHT2, inner["right"], inner["right2"]), slots(_RIGHT3, inner["right"], inner["right2"], inner["right3"])]
    into[INNER] += np.bincount(np.concatenate([x.ravel() for x in words]), minlength=WIDTH)
    into[INNER, _TOTAL] += len(inner["right"])


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


class Model:
    """Scores events by the words around them and decides by forward-backward.

    ``classes`` has the expected counts ``(boundary, none)`` by mark and gap and by
    distance, from the posteriors of a model before; without them marks are taken as
    boundaries in four of five cases.
    """

    def __init__(self, counts: np.ndarray, classes: np.ndarray | None = None):
        self.c = counts
        ends, opens, paragraphs = counts[SURE, _TOTAL : _TOTAL + 3]
        mids = counts[MID, _TOTAL]
        if classes is None:
            self.prior = np.full(CLASSES, 0.8)
            part = 0.8
            near = np.ones((2, 3, 2))
        else:
            by = classes[:, :CLASSES]
            part = base = (by[0].sum() + 1) / (by.sum() + 2)
            self.prior = (by[0] + 4 * base) / (by.sum(0) + 4)
            near = classes[:, CLASSES:].reshape(2, 3, 2)
        self.rates = (np.array([ends, opens, paragraphs]) + 0.5) / (part * mids + 0.5)  # sure places for each expected
        self.opens, self.inner = float(opens) + 1, float(counts[INNER, _TOTAL]) + 1
        base = (near[0].sum() + 1) / (near.sum() + 2)
        p = (near[0] + 20 * base) / (near.sum(0) + 20)
        self.steps = np.stack([(1 - p) / (1 - base), p / base], -1)  # distance, before, now

    def get(self, at: np.ndarray) -> np.ndarray:
        """``(sure, mid, inner)`` of contexts."""
        v = self.c[:, at]
        less = v.sum(0).argmin(0)
        return v[:, less, np.arange(at.shape[1])]

    @staticmethod
    def settle(p: np.ndarray, sure: np.ndarray, mid: np.ndarray, rate: float, shape: float) -> np.ndarray:
        """The part of a context's events that are boundaries, given ``p`` before: the
        mean over the parts, where the sure places follow a negative binomial law."""
        log = np.log(_BELIEF) + _PARTS * _logit(np.clip(p, 1e-3, 1 - 1e-3))[:, None]
        mean = rate * mid[:, None] * _PARTS + 0.02
        log += sure[:, None] * np.log(mean / (shape + mean)) - shape * np.log(shape + mean)
        w = np.exp(log - log.max(1, keepdims=True))
        return (w * _PARTS).sum(1) / w.sum(1)

    @staticmethod
    def blend(p: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Between what a shorter context says and what a longer one seen ``n`` times says."""
        w = n / (n + BACKOFF)
        return 1 / (1 + np.exp(-((1 - w) * _logit(p) + w * _logit(q))))

    def odds(self, ev: np.ndarray) -> np.ndarray:
        """Log odds of a boundary from the words around an event."""
        base = self.prior[_class(ev)]
        left, right = _contexts(ev)
        sure, mid, _ = self.get(slots(_RSHAPE, ev["style"], ev["rshape"]))
        q = self.settle(base, sure, mid, self.rates[2], SPREAD_RIGHT)
        p = base
        for at in left:
            sure, mid, _ = self.get(at)
            p = self.blend(p, self.settle(base, sure, mid, self.rates[0], SPREAD_LEFT), sure + 4 * mid)
        few = 3 / self.opens
        r = q
        for at in right:
            sure, mid, inner = self.get(at)
            ratio = np.log((sure / self.opens + few) / (inner / self.inner + few))
            before = 1 / (1 + np.exp(-(_logit(q) + np.clip(ratio, -4, 4))))
            r = self.blend(r, self.settle(before, sure, mid, self.rates[1], SPREAD_RIGHT), sure + 4 * mid + inner)
        q = r
        x = _logit(p) + np.where(ev["right"] > 0, _logit(q) - _logit(base), 0)
        capital = (ev["rshape"] == 0) | (ev["rshape"] == 7)
        x += DEFINED * ((ev["mark"] == THAI_GAP) | capital & ((ev["mark"] == QUOTED) | (ev["mark"] == DOTS)))
        return np.clip(x, -20, 20)

    def posteriors(self, ev: np.ndarray, per: np.ndarray) -> np.ndarray:
        """P(boundary) of every event of texts with ``per`` events each.

        The states are ``(event, guess)``; the guess is the event at the close of the
        quotation around, carried from its first event to its close: if the sentence
        goes on after the quotation, the marks inside end nothing.
        """
        if not len(ev):
            return np.zeros(0)
        f = ev["forced"]
        one = (f > 0).astype(float)
        free = np.flatnonzero(f == 0)
        one[free] = 1 / (1 + np.exp(-self.odds(ev[free])))
        w = np.stack([1 - one, 1 - one, one, one], 1)  # (0,0) (0,1) (1,0) (1,1)
        base = np.concatenate([[0], np.cumsum(per)])[:-1]
        of = np.repeat(np.arange(len(per)), per)
        inside = ev["within"] >= 0
        closing = np.zeros(len(ev), bool)
        closing[(base[of] + ev["within"])[inside]] = True
        w[inside & (f <= 0), 2] = 0  # no boundary inside if it goes on
        ends = closing & ~inside
        w[np.ix_(ends, [1, 2])] = 0
        w[np.ix_(~ends & ~inside, [1, 3])] = 0
        # transitions by distance, and by whether the guess is kept
        moves = np.zeros((3, 2, 4, 4))
        for i in range(4):
            for j in range(4):
                t = self.steps[:, i >> 1, j >> 1]
                moves[:, 0, i, j] = t
                moves[:, 1, i, j] = t * ((i & 1) == (j & 1))
        kept = np.zeros(len(ev), np.int64)
        kept[1:] = inside[:-1]
        step = ev["near"].astype(np.int64) * 2 + kept
        moves = moves.reshape(6, 4, 4)
        order = np.argsort(-per, kind="stable")
        at, size = base[order], per[order]
        active = np.searchsorted(-size, -np.arange(int(size[0]) + 1), "left")  # texts with more than k events
        forward = np.empty((len(ev), 4))
        for k in range(int(size[0])):
            i = at[: active[k]] + k
            state = w[i] if not k else np.einsum("di,dij->dj", state[: len(i)], moves[step[i]]) * w[i]
            total = state.sum(1, keepdims=True)
            state = np.where(total > 0, state / np.maximum(total, 1e-300), 0.25)
            forward[i] = state
        out = np.empty(len(ev))
        back = np.ones((len(per), 4))
        for k in range(int(size[0]) - 1, -1, -1):
            i = at[: active[k]] + k
            mass = forward[i] * back[: len(i)]
            out[i] = (mass[:, 2] + mass[:, 3]) / np.maximum(mass.sum(1), 1e-300)
            if k:
                v = np.einsum("dij,dj->di", moves[step[i]], w[i] * back[: len(i)])
                back[: len(i)] = v / np.maximum(v.sum(1, keepdims=True), 1e-300)
        return out


def expect(ev: np.ndarray, per: np.ndarray, q: np.ndarray, into: np.ndarray) -> None:
    """Add expected counts ``(boundary, none)`` by mark and gap and by distance, from
    posteriors ``q``."""
    mid = ev["forced"] == 0
    kind = _class(ev[mid])
    into[0, :CLASSES] += np.bincount(kind, q[mid], CLASSES)
    into[1, :CLASSES] += np.bincount(kind, 1 - q[mid], CLASSES)
    before = np.concatenate([[1.0], q[:-1]])[mid]
    now, near = q[mid], ev["near"][mid].astype(np.int64) * 2
    for was, weight in ((1, before), (0, 1 - before)):
        into[0, CLASSES:] += np.bincount(near + was, weight * now, 6)
        into[1, CLASSES:] += np.bincount(near + was, weight * (1 - now), 6)
