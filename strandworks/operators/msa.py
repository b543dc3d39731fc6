"""Multiple alignments as rows ``(msa_id, ord, seq_id, aligned)`` of equal length."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.functions.kernels import align_pairs, numbers_of
from strandworks.plans.ship import ship
from strandworks.plans.spread import spread

GAP = "-"
#: Letters of rows that a task holds at a time.
HELD = 1 << 22


def verify(msa: DataFrame) -> DataFrame:
    """``msa_id, ok``: whether all rows of an alignment are equally long."""
    return msa.groupBy("msa_id").agg((F.count_distinct(F.length("aligned")) <= 1).alias("ok"))


def columns(msa: DataFrame) -> DataFrame:
    """Transpose: ``msa_id, pos, column`` with the letters in row order.

    Letters combine before the shuffle only as far as ``collect_list`` does; a column
    is as long as its alignment has rows.
    """
    cells = msa.select("msa_id", "ord", F.posexplode(F.split("aligned", "")).alias("k", "c"))
    pairs = F.array_sort(F.collect_list(F.struct("ord", "c")))
    return cells.groupBy("msa_id", (F.col("k") + 1).alias("pos")).agg(F.array_join(F.transform(pairs, lambda x: x["c"]), "").alias("column"))


def column_slice(aligned: Column, start: int, stop: int, step: int = 1) -> Column:
    """Columns ``start..stop`` of a row, both included, 1-based; negative ones count
    from the end; every ``step``-th is kept."""
    n = F.length(aligned)
    at = lambda x: F.lit(x) if x > 0 else n + x + 1
    part = F.substring(aligned, at(start), at(stop) - at(start) + 1)
    if step == 1:
        return part
    return F.array_join(F.filter(F.split(part, ""), lambda x, i: i % step == 0), "")


def gap_fraction(aligned: Column) -> Column:
    return (F.length(aligned) - F.length(F.replace(aligned, F.lit(GAP), F.lit("")))) / F.length(aligned)


def filter_gap_rows(msa: DataFrame, max_frac: float = 1.0) -> DataFrame:
    """Rows whose gap fraction is below ``max_frac``, strictly."""
    return msa.where(gap_fraction(F.col("aligned")) < max_frac)


def gap_columns(msa: DataFrame, max_gaps: float = 1.0) -> DataFrame:
    """``msa_id, pos0``: 0-based columns whose gap fraction is ``max_gaps`` or more.

    Only the gaps are exploded; columns without one are added where ``max_gaps`` is
    not above zero, as then every column counts."""
    sizes = msa.groupBy("msa_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.length("aligned")).alias("width"))
    if max_gaps <= 0:
        return sizes.select("msa_id", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("pos0")).where("width > 0")
    chars = F.split("aligned", "")
    gaps = F.filter(F.transform(chars, lambda x, i: F.when(x == GAP, i)), lambda i: i.isNotNull())
    n = msa.select("msa_id", F.explode(gaps).alias("pos0")).groupBy("msa_id", "pos0").agg(F.count(F.lit(1)).alias("n"))
    return n.join(sizes, "msa_id").where(F.col("n") / F.col("rows") >= max_gaps).select("msa_id", "pos0")


def remove_gap_columns(msa: DataFrame, max_gaps: float = 1.0) -> DataFrame:
    """The alignment without the columns of :func:`gap_columns`, which travel as one
    array per alignment; each row is put together from the columns that stay."""
    bad = gap_columns(msa, max_gaps).groupBy("msa_id").agg(F.collect_set("pos0").alias("bad"))
    out = msa.join(bad, "msa_id", "left").withColumn("_chars", F.split("aligned", ""))
    kept = F.array_except(F.sequence(F.lit(0), F.length("aligned") - 1), F.col("bad"))
    cut = F.array_join(F.transform(kept, lambda i: F.col("_chars")[i]), "")
    return out.withColumn("aligned", F.when(F.col("bad").isNull() | (F.length("aligned") == 0), F.col("aligned")).otherwise(cut)).drop("bad", "_chars")


def partition_gap_rows(msa: DataFrame, max_fraction: float = 1.0) -> DataFrame:
    """Flag ``kept`` for rows with a gap fraction of at most ``max_fraction``."""
    return msa.withColumn("kept", gap_fraction(F.col("aligned")) <= max_fraction)


def remove_rows(msa: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose ``(msa_id, seq_id)`` is not in ``gone``."""
    return msa.join(gone.select("msa_id", "seq_id").distinct(), ["msa_id", "seq_id"], "left_anti")


def _numbers(a: pd.Series, b: pd.Series) -> pd.Series:
    def of(row: str) -> list[int | None]:
        letter = np.frombuffer(row.encode("utf-32-le"), np.uint32) != ord(GAP)
        return [n if x else None for n, x in zip(np.cumsum(letter).tolist(), letter.tolist())]

    return pd.Series([list(zip(of(x), of(y))) for x, y in zip(a, b)])


def pair_numbering(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, col, n1, n2``: the numbers both rows of an alignment have in a column,
    null on a gap; one pass over each row."""
    count = F.pandas_udf(_numbers, "array<struct<n1:int,n2:int>>")
    rows = df.where(F.length(a) == F.length(b)).select(key, F.posexplode(count(F.col(a), F.col(b))).alias("_k", "_p"))
    return rows.select(key, (F.col("_k") + 1).alias("col"), "_p.n1", "_p.n2")


def _align(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    known = [isinstance(x, str) and isinstance(y, str) for x, y in zip(a, b)]
    aligned = iter(align_pairs([(x, y) for x, y, ok in zip(a, b, known) if ok]))
    rows = []
    for ok in known:
        if not ok:
            rows.append((None, None, None, None))
            continue
        p, q, score = next(aligned)
        rows.append((p, q, score, numbers_of(p, q)))
    return pd.DataFrame(rows, columns=["a", "b", "score", "numbers"])


def align(df: DataFrame, a: str, b: str) -> DataFrame:
    """Global alignment of two text columns per row as ``aln`` ``(a, b, score,
    numbers)``; ``numbers`` maps the letters of ``a`` to places in ``b``, null on a
    gap.  Null texts give nulls.  The pair is one row, so spread pairs, not objects."""
    aligner = F.pandas_udf(_align, "a string, b string, score int, numbers array<int>")
    return spread(df, per_core=4).withColumn("aln", aligner(F.col(a), F.col(b)))


def annotate(msa: DataFrame, rows: DataFrame) -> DataFrame:
    """``seq_id, start, end``: where the ungapped aligned row stands in its sequence;
    nulls if it is not a part of it.  ``rows`` has ``(seq_id, s)``."""
    bare = F.replace("aligned", F.lit(GAP), F.lit(""))
    found = msa.select("seq_id", bare.alias("bare")).join(rows, "seq_id")
    at = F.instr(F.col("s"), F.col("bare"))
    ok = (at > 0) & (F.length("bare") > 0)
    return found.select("seq_id", F.when(ok, at).alias("start"), F.when(ok, at + F.length("bare") - 1).alias("end"))


def annotate_columns(msa: DataFrame, rows: DataFrame) -> DataFrame:
    """``seq_id, i, col``: for each letter of an aligned row its place in the whole
    sequence of ``rows`` and its column; none for rows that are no part of theirs."""
    at = annotate(msa, rows).where("start is not null").select("seq_id", "start")
    cells = msa.join(at, "seq_id").select("seq_id", "start", F.posexplode(pair_columns(F.col("aligned"))).alias("k", "col"))
    return cells.select("seq_id", (F.col("start") + F.col("k")).alias("i"), "col")


def pair_columns(aligned: Column) -> Column:
    """The 1-based columns of a row's letters, in order."""
    places = F.transform(F.split(aligned, ""), lambda x, i: F.when(x != GAP, i + 1))
    return F.filter(places, lambda i: i.isNotNull())


def consensus(msa: DataFrame) -> DataFrame:
    """``msa_id, consensus``: the most common letter of each column, the first of equals;
    ``X`` where all are gaps."""
    cells = msa.select("msa_id", F.posexplode(F.split("aligned", "")).alias("k", "c"))
    per = cells.groupBy("msa_id", "k", "c").agg(F.count(F.lit(1)).alias("n"))
    best = per.groupBy("msa_id", "k").agg(F.min(F.struct(F.when(F.col("c") == GAP, 1).otherwise(0).alias("gap"), (-F.col("n")).alias("n"), "c")).alias("m"))
    letters = F.array_sort(F.collect_list(F.struct("k", F.when(F.col("m.gap") == 1, "X").otherwise(F.col("m.c")).alias("c"))))
    return best.groupBy("msa_id").agg(F.array_join(F.transform(letters, lambda x: x["c"]), "").alias("consensus"))


def _onto(seq: pd.Series, centre: pd.Series) -> pd.DataFrame:
    known = [isinstance(s, str) and isinstance(c, str) for s, c in zip(seq, centre)]
    aligned = iter(align_pairs([(s, c) for s, c, ok in zip(seq, centre, known) if ok]))
    rows = []
    for ok in known:
        if not ok:
            rows.append((None, None))
            continue
        a, b, _ = next(aligned)
        if GAP not in b:
            rows.append((a, [""] * (len(b) + 1)))
            continue
        letters, extra = [], [[]]
        for x, y in zip(a, b):
            if y == GAP:
                extra[-1].append(x)
            else:
                letters.append(x)
                extra.append([])
        rows.append(("".join(letters), ["".join(e) for e in extra]))
    return pd.DataFrame(rows, columns=["letters", "extra"])


def onto(df: DataFrame, seq: str, centre: str) -> DataFrame:
    """Each row aligned to a text, as ``on``: ``letters``, one for each of the text's
    places, and ``extra``, the letters that fall before the first, after the first, and
    so on."""
    aligner = F.pandas_udf(_onto, "letters string, extra array<string>")
    return spread(df, per_core=4).withColumn("on", aligner(F.col(seq), F.col(centre)))


def add_rows(msa: DataFrame, new: DataFrame) -> DataFrame:
    """``msa_id, seq_id, aligned, n_dropped``: sequences ``(msa_id, seq_id, s)`` aligned
    to the consensus of their alignment.  The alignment keeps its columns, so letters
    between two of them are dropped and counted.  Sequences of alignments that are not
    there give no row."""
    rows = onto(new.where(F.col("s").isNotNull()).join(consensus(msa), "msa_id"), "s", "consensus")
    dropped = F.aggregate("on.extra", F.lit(0), lambda n, x: n + F.length(x))
    return rows.select("msa_id", "seq_id", F.col("on.letters").alias("aligned"), dropped.alias("n_dropped"))


def _insertions(a: str, b: str) -> tuple[str, dict[int, str]]:
    """Of ``a`` aligned to ``b``: the letters at the places of ``b``, and those before each place."""
    if GAP not in b:
        return a, {}
    letters, extra = [], {}
    for x, y in zip(a, b):
        if y == GAP:
            extra[len(letters)] = extra.get(len(letters), "") + x
        else:
            letters.append(x)
    return "".join(letters), extra


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``msa_id, seq_id, s, centre``, alignments one after the other, to ``msa_id, seq_id, aligned``.

    Rows wait until the widths of their alignment are known, beyond ``HELD`` letters in a file."""
    group, held, size, wide, file = None, [], 0, {}, None

    def spread_out() -> Iterator[pa.RecordBatch]:
        places, out, full = sorted(wide), [], 0

        def chunks() -> Iterator[list]:
            if file is not None:
                file.seek(0)
                while (n := file.read(8)) and (part := file.read(int.from_bytes(n, "big"))):
                    yield pickle.loads(part)
            yield held

        for chunk in chunks():
            for name, letters, extra in chunk:
                parts, since = [], 0
                for k in places:
                    parts += [letters[since:k], extra.get(k, "").ljust(wide[k], GAP)]
                    since = k
                out.append((name, "".join([*parts, letters[since:]])))
                full += len(out[-1][1])
                if full > HELD:
                    yield out
                    out, full = [], 0
        if out:
            yield out

    def batch_of(rows: list) -> pa.RecordBatch:
        ids, names, texts = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(ids, kinds[0]), pa.array(names, kinds[1]), pa.array(texts)], ["msa_id", "seq_id", "aligned"])

    ready, full = [], 0
    for batch in batches:
        kinds = [f.type for f in batch.schema]
        ids, names, texts, centres = (c.to_pylist() for c in batch.columns)
        for key, name, (a, b, _) in zip(ids, names, align_pairs(list(zip(texts, centres)))):
            if key != group:
                for rows in spread_out():
                    ready += [(group, *r) for r in rows]
                    full += sum(len(r[1]) for r in rows)
                    if full > HELD:
                        yield batch_of(ready)
                        ready, full = [], 0
                if file is not None:
                    file.close()
                group, held, size, wide, file = key, [], 0, {}, None
            letters, extra = _insertions(a, b)
            for k, e in extra.items():
                wide[k] = max(wide.get(k, 0), len(e))
            held.append((name, letters, extra))
            size += len(letters)
            if size > HELD:
                file = file or tempfile.TemporaryFile()
                part = pickle.dumps(held)
                file.write(len(part).to_bytes(8, "big") + part)
                held, size = [], 0
    for rows in spread_out():
        yield batch_of([*ready, *[(group, *r) for r in rows]])
        ready = []
    if ready:
        yield batch_of(ready)


def star_align(rows: DataFrame) -> DataFrame:
    """``msa_id, seq_id, aligned``: the sequences ``(msa_id, seq_id, s)`` of each group
    aligned to its longest one, the least id of equals; once a gap, always a gap.

    A group's rows come by in one task, longest first, and are aligned once; what a task
    holds is bounded, whatever the group.  Null and empty sequences are rows of gaps.
    """
    ship(rows.sparkSession)
    order = Window.partitionBy("msa_id").orderBy(F.length("s").desc(), F.asc_nulls_last("seq_id"))
    rows = rows.where(F.col("msa_id").isNotNull()).select("msa_id", "seq_id", F.coalesce("s", F.lit("")).alias("s"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("msa_id", "seq_id")]
    rows = rows.repartition("msa_id").withColumn("centre", F.first("s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.sortWithinPartitions("msa_id").mapInArrow(_star, f"msa_id {kinds[0]}, seq_id {kinds[1]}, aligned string")


def realign(msa: DataFrame) -> DataFrame:
    """An alignment made anew from its rows without gaps."""
    return star_align(msa.select("msa_id", "seq_id", F.replace("aligned", F.lit(GAP), F.lit("")).alias("s")))
