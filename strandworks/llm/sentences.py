"""Sentence boundaries across scripts with a hidden-event language model.

A text is words with hidden events in the gaps between them: a boundary or none.
The model has the probability of a boundary given the words before the gap and its
mark, and of the words after the gap given a boundary or none, each by n-grams of up
to three words that back off to shorter ones and to shapes.  Forward-backward
posteriors over the events of a text decide.  A sentence ends only at a mark, at an
empty line, at white space between Thai letters or at the end of its text; by that
definition every other gap holds no boundary, its factors are the same in all
readings and cancel, so the chain runs over the remaining gaps.

There are no word lists and no labels.  Sentences begin and end for sure at the ends
of texts and paragraphs, and a context that never stands there however often it
stands at marks inside texts is a continuation, such as an abbreviation's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandworks.llm.sentence_events import EVENT, find_events
from strandworks.llm.sentence_model import CLASSES, WIDTH, Model, count, expect
from strandworks.plans.scratch import Scratch
from strandworks.plans.spread import spread

#: Counts travel in blocks of so many slots.
BLOCK = 1 << 15
#: Texts are worked on together up to so many characters; a longer text alone.
CHARS = 1 << 20
#: Passes that fit the frequencies of boundaries by mark, gap and distance.
ROUNDS = 1


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``CHARS`` characters together."""
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > CHARS:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if texts:
        yield begin, len(texts)


def _real(text: str | None) -> bool:
    return isinstance(text, str) and bool(text) and not text.isspace()


def _blocks(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The parts of a count table that are not empty, as ``(slice, places and values)``."""
    per = -(-WIDTH // BLOCK)
    for column in range(len(counts)):
        for k in range(per):
            part = counts[column, k * BLOCK : (k + 1) * BLOCK]
            at = np.flatnonzero(part)
            if len(at):
                yield column * per + k, at.astype("<u2").tobytes() + part[at].astype("<f4").tobytes()


def _place(slices: list[int], blobs: list[bytes], into: np.ndarray) -> None:
    per = -(-WIDTH // BLOCK)
    for s, blob in zip(slices, blobs):
        n = len(blob) // 6
        at = np.frombuffer(blob, "<u2", n).astype(np.int64)
        into[s // per, (s % per) * BLOCK + at] += np.frombuffer(blob, "<f4", n, 2 * n)


def _extract(docs: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    """Stage the events of every text as ``(key, first, last, events)`` and, in rows of
    their own, the counts of each task as ``(slice, counts)``.  Texts without a
    sentence have no row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, WIDTH))
        names = ["key", "first", "last", "events", "slice", "counts"]
        of = None
        for batch in batches:
            of = batch.column(0).type
            texts = batch.column(1).to_pylist()
            at = [k for k, t in enumerate(texts) if _real(t)]
            texts = [texts[k] for k in at]
            for a, b in _batches(texts):
                ev, per, span, inner = find_events(texts[a:b])
                count(ev, per, inner, counts)
                ends = np.cumsum(per) * EVENT.itemsize
                raw = ev.tobytes()
                blobs = pa.array([raw[p:q] for p, q in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())], pa.binary())
                none = pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at[a:b], pa.int64())), pa.array(span[:, 0], pa.int32()), pa.array(span[:, 1], pa.int32()), blobs, *none], names
                )
        found = list(_blocks(counts))
        n = len(found)
        if n:
            nothing = pa.nulls(n, of), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([s for s, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names)

    rows = spread(docs.select(key, text), key).mapInArrow(run, f"key {kind}, first int, last int, events binary, slice int, counts binary")
    return scratch.save(rows, "events")


def _gather(staged: DataFrame) -> np.ndarray:
    """The sum of all tasks' counts.  A slice has at most ``BLOCK`` places, so a
    table of bounded size reaches the driver, whatever the corpus."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK)
        for blob in rows["counts"].tolist():
            n = len(blob) // 6
            total[np.frombuffer(blob, "<u2", n)] += np.frombuffer(blob, "<f4", n, 2 * n)
        at = np.flatnonzero(total)
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "counts": [at.astype("<u2").tobytes() + total[at].astype("<f4").tobytes()]})

    sums = staged.where("slice is not null").select("slice", "counts").groupBy("slice").applyInPandas(add, "slice int, counts binary").toPandas()
    out = np.zeros((3, WIDTH))
    _place(sums["slice"].tolist(), sums["counts"].tolist(), out)
    return out.astype(np.float32)


def _read(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.as_py() for x in blobs]
    return np.frombuffer(b"".join(raw), EVENT), np.array([len(x) // EVENT.itemsize for x in raw], np.int64)


def _expected(staged: DataFrame, counts, classes: np.ndarray | None) -> np.ndarray:
    """Expected counts of boundaries by mark, gap and distance over all events."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(counts.value, classes)
        into = np.zeros((2, CLASSES + 6))
        for batch in batches:
            ev, per = _read(batch.column(0))
            expect(ev, per, model.posteriors(ev, per), into)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES + 6), pa.int32()), pa.array(into[0]), pa.array(into[1])], ["at", "b", "n"])

    sums = staged.where("events is not null").select("events").mapInArrow(run, "at int, b double, n double")
    out = np.zeros((2, CLASSES + 6))
    for at, b, n in sums.groupBy("at").agg(F.sum("b"), F.sum("n")).collect():
        out[:, at] = b, n
    return out


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, np.ndarray | None]:
    """Stage the events of all texts and fit the model to them: ``(events, counts,
    classes)``.

    Texts are read once.  The counts lie in a table of fixed size that every event and
    word of every text is added to; each further pass reads the staged events.
    """
    scratch = Scratch(docs.sparkSession, "sentences")
    staged = _extract(docs, key, text, scratch)
    counts = _gather(staged)
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    classes = None
    for _ in range(rounds):
        classes = _expected(staged, shared, classes)
    return staged, counts, classes


def cut(ev: np.ndarray, per: np.ndarray, first: np.ndarray, last: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, start, end)`` of the sentences between the events with ``q > 0.5``;
    ``first`` and ``last`` are the ends of each text without white space."""
    of = np.repeat(np.arange(len(per)), per)
    yes = (q > 0.5) & (ev["end"] > first[of]) & (ev["end"] < last[of])
    k = np.concatenate([np.arange(len(per)), of[yes]])
    start = np.concatenate([first, ev["next"][yes].astype(np.int64)])
    stop = np.concatenate([last, ev["end"][yes].astype(np.int64)])
    begins, ends = np.lexsort((start, k)), np.lexsort((stop, k))
    keep = start[begins] < stop[ends]
    return k[begins][keep], start[begins][keep], stop[ends][keep]


def sentences_of(texts: list[str | None], counts: np.ndarray, classes: np.ndarray | None = None) -> list[list[tuple[int, int]]]:
    """``(start, end)`` of the sentences of each text; none for null and blank."""
    model = Model(counts, classes)
    at = [k for k, t in enumerate(texts) if _real(t)]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if at:
        ev, per, span, _ = find_events([texts[k] for k in at])
        for k, a, b in zip(*cut(ev, per, span[:, 0], span[:, 1], model.posteriors(ev, per))):
            out[at[k]].append((int(a), int(b)))
    return out


def split_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, start_pos, end_pos)``: one row per sentence of every text.

    Positions are code points, the end exclusive; white space at the ends belongs to
    no sentence, all other text to exactly one.  Null, empty and blank texts have no
    sentence.  A text without any mark is one sentence per paragraph.  Texts are
    treated whole, however long; repeated keys give repeated rows, a null key is kept.
    The model is fitted to ``docs``.
    """
    staged, counts, classes = train(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value, classes)
        for batch in batches:
            ev, per = _read(batch.column(3))
            first, last = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 2))
            of, start, stop = cut(ev, per, first, last, model.posteriors(ev, per))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of)), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], [key, "start_pos", "end_pos"]
            )

    rows = staged.where("events is not null").select("key", "first", "last", "events")
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, start_pos int, end_pos int")
