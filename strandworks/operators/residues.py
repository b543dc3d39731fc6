"""Operators on sequences kept as one row per position: ``(object, i, column, ...)``.

``obj`` names the object column and ``i`` the 1-based position everywhere; further
columns are maps (numberings, letters, anything aligned with the positions).  The
``packed`` forms take one row per object with its maps as arrays, so that no position is
shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandworks.plans.spread import spread

#: Positions that a packed kernel holds at a time, or one object.
PIECE = 1 << 19


def explode_sequence(df: DataFrame, obj: str, seq: str, into: str = "seq1", keep: list[str] | None = None) -> DataFrame:
    """One row per letter; null and empty sequences have no rows."""
    letters = F.split(F.col(seq), "")
    rows = df.where(F.length(seq) > 0).select(obj, *(keep or []), F.posexplode(letters).alias("_k", into))
    return rows.withColumn("i", F.col("_k") + 1).drop("_k")


def collapse_sequence(df: DataFrame, obj: str, column: str, into: str = "seq1") -> DataFrame:
    """Back to one text per object, in the order of ``i``."""
    pairs = F.array_sort(F.collect_list(F.struct("i", F.col(column).alias("c"))))
    return df.groupBy(obj).agg(F.array_join(F.transform(pairs, lambda x: x["c"]), "").alias(into))


def take(df: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Positions ``start..stop``, both included and clamped to what is there."""
    if start == 0 or stop == 0:
        raise IndexError("positions begin at 1")
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col("i") >= start)
    if stop is not None:
        keep = keep & (F.col("i") <= stop)
    return df.where(keep)


def add_column(df: DataFrame, obj: str, values: DataFrame, name: str, replace: bool = False) -> DataFrame:
    """Attach ``(obj, i, value)`` as a column; an existing name needs ``replace``."""
    if not name.isidentifier():
        raise ValueError(f"{name!r} is not a field name")
    if name in df.columns and not replace:
        raise KeyError(f"{name} exists")
    return df.drop(name).join(values.select(obj, "i", F.col("value").alias(name)), [obj, "i"], "left")


def first_of(df: DataFrame, obj: str, key: str, value: Column) -> DataFrame:
    """``(obj, key, value)`` by first occurrence; null keys are left out."""
    rows = df.where(F.col(key).isNotNull())
    return rows.groupBy(obj, key).agg(F.min_by(value, "i").alias("value"))


def last_of(df: DataFrame, obj: str, key: str, value: Column) -> DataFrame:
    """``(obj, key, value)`` by last occurrence, as building a dictionary does."""
    rows = df.where(F.col(key).isNotNull())
    return rows.groupBy(obj, key).agg(F.max_by(value, "i").alias("value"))


def not_empty(c: Column, kind: str) -> Column:
    """False for NaN and the empty text only; null is not empty here."""
    if kind in ("double", "float"):
        return ~F.coalesce(F.isnan(c), F.lit(False))
    if kind == "string":
        return ~F.coalesce(c == "", F.lit(False))
    return F.lit(True)


def closest(df: DataFrame, obj: str, key: str, value: Column | int, reverse: bool = False) -> DataFrame:
    """Per object the position of the first key >= value in sequence order; with
    ``reverse`` the last key <= value.  Nulls are skipped; ``at`` is null if none fits."""
    fits = F.col(key) <= value if reverse else F.col(key) >= value
    at = F.max(F.when(fits, F.col("i"))) if reverse else F.min(F.when(fits, F.col("i")))
    return df.groupBy(obj).agg(at.alias("at"))


def map_boundaries(df: DataFrame, obj: str, key: str, start: Column, end: Column, nearest: bool = False) -> DataFrame:
    """``(obj, from_i, to_i)`` of the positions whose ``key`` bounds a range.

    ``start`` and ``end`` may be columns.  Exact matches, or with ``nearest`` the
    first key >= start and the last <= end; a start above all keys is sought
    downwards and an end below all upwards.
    """
    k, i = F.col(key), F.col("i")
    if not nearest:
        return df.groupBy(obj).agg(F.min(F.when(k == start, i)).alias("from_i"), F.min(F.when(k == end, i)).alias("to_i"))
    found = df.groupBy(obj).agg(
        F.max(k).alias("_hi"), F.min(k).alias("_lo"), F.first(start).alias("_s"), F.first(end).alias("_e"),
        F.min(F.when(k >= start, i)).alias("_s_up"), F.max(F.when(k <= start, i)).alias("_s_down"),
        F.min(F.when(k >= end, i)).alias("_e_up"), F.max(F.when(k <= end, i)).alias("_e_down"),
    )
    return found.select(
        obj,
        F.when(F.col("_s") > F.col("_hi"), F.col("_s_down")).otherwise(F.col("_s_up")).alias("from_i"),
        F.when(F.col("_e") < F.col("_lo"), F.col("_e_up")).otherwise(F.col("_e_down")).alias("to_i"),
    )


def relate(df: DataFrame, other: DataFrame, obj: str, link: str, points_to: str, column: str, into: str) -> DataFrame:
    """Bring ``column`` of ``other`` over: ``df.link`` meets the first occurrence of
    the same value in ``other.points_to`` of the same object; null where none does.
    A null link meets a null key, if there is one.  Positions are many more than the
    size of their table tells, so neither side is ever broadcast."""
    right = other.groupBy(F.col(obj).alias("_o"), F.col(points_to).alias("_k")).agg(F.min_by(column, "i").alias(into)).hint("merge")
    return df.join(right, (df[obj] == right["_o"]) & df[link].eqNullSafe(right["_k"]), "left").drop("_o", "_k")


def fill(df: DataFrame, target: str, template: str, into: str) -> DataFrame:
    """``target`` where it has a value, else ``template``."""
    return df.withColumn(into, F.coalesce(target, template))


def patch(df: DataFrame, template: DataFrame, obj: str, numbering: str, link: str, column: str) -> DataFrame:
    """Fill the jumps of a numbering with the template between its linked ends.

    Where ``numbering`` jumps by more than one between neighbours whose ``link`` is
    known, the template's rows strictly between the links come in; a jump with a
    missing link stays.  Positions are numbered anew: ``(obj, i, column, patched)``.
    """
    w = Window.partitionBy(obj).orderBy("i")
    rows = df.select(obj, "i", column, F.col(numbering).alias("_n"), F.col(link).alias("_l"))
    gaps = rows.withColumn("_n2", F.lead("_n").over(w)).withColumn("_l2", F.lead("_l").over(w))
    gaps = gaps.where((F.col("_n2") - F.col("_n") > 1) & F.col("_l").isNotNull() & F.col("_l2").isNotNull())
    gaps = gaps.select(obj, F.col("i").alias("_at"), F.explode(F.filter(F.sequence(F.col("_l"), F.col("_l2")), lambda x: (x > F.col("_l")) & (x < F.col("_l2")))).alias("_t"))
    extra = gaps.join(template.select(F.col(obj).alias("_o"), F.col("i").alias("_ti"), F.col(column)).hint("merge"), (F.col(obj) == F.col("_o")) & (F.col("_t") == F.col("_ti")))
    both = rows.select(obj, F.col("i").alias("_at"), F.lit(0).alias("_t"), column, F.lit(False).alias("patched")).unionByName(
        extra.select(obj, "_at", F.col("_t").cast("int").alias("_t"), column, F.lit(True).alias("patched"))
    )
    again = F.row_number().over(Window.partitionBy(obj).orderBy("_at", "_t"))
    return both.select(obj, again.alias("i"), column, "patched")


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists in a row, 0 for nulls, and which are known."""
    flat = lists.flatten()
    return pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.is_valid(flat).to_numpy(zero_copy_only=False)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _packed(df: DataFrame, keep: list[str], maps: list[Column], kernel: Callable[..., list[pa.Array]], schema: str) -> DataFrame:
    """``kernel`` over the arrays of ``maps``, pieces of a batch at a time; ``keep`` goes along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(_sizes(batch.column(len(keep))))
            cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), len(ends)]
            for a, b in zip(cuts, cuts[1:]):
                piece = batch.slice(a, b - a).columns
                out = piece[: len(keep)] + kernel(*piece[len(keep) :])
                yield pa.RecordBatch.from_arrays(out, names)

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    names = keep + [x.split()[0] for x in schema.split(", ")]
    return spread(df).select(*keep, *[c.alias(f"_{k}") for k, c in enumerate(maps)]).mapInArrow(run, ", ".join([*kinds, schema]))


def _relate(link: pa.Array, points_to: pa.Array, column: pa.Array) -> list[pa.Array]:
    key, known = _numbers(points_to)
    sought, given = _numbers(link)
    low, high = (int(key[known].min()), int(key[known].max())) if known.any() else (0, -1)
    code = lambda x, ok, sizes: np.repeat(np.arange(len(sizes)), sizes) * (high - low + 2) + np.where(ok, x - low + 1, 0)
    own = code(key, known, _sizes(points_to))
    order = np.argsort(own, kind="stable")
    own = own[order]
    wanted = np.where(~given | ((sought >= low) & (sought <= high)), code(sought, given, _sizes(link)), -1)
    at = np.searchsorted(own, wanted)
    found = at < len(own)
    found[found] = own[at[found]] == wanted[found]
    places = np.zeros(len(at), np.int64)
    places[found] = order[at[found]]
    return [_lists(_sizes(link), column.flatten().take(pa.array(places, mask=~found)))]


def relate_packed(df: DataFrame, keep: list[str], link: Column, points_to: Column, column: Column, into: str) -> DataFrame:
    """:func:`relate` of objects with themselves, one row an object: ``keep`` and the array
    ``into``, as long as ``link``.  ``points_to`` and ``column`` are equally long; links
    and keys are whole numbers, ``column`` is text."""
    return _packed(df, keep, [link, points_to, column], _relate, f"{into} array<string>")


def _patch(numbering: pa.Array, link: pa.Array, column: pa.Array, template: pa.Array) -> list[pa.Array]:
    sizes, lengths = _sizes(link), _sizes(template)
    row = np.repeat(np.arange(len(sizes)), sizes)
    (n, n_known), (at, at_known) = _numbers(numbering), _numbers(link)
    known = n_known & at_known
    jumps = np.zeros(len(row), bool)
    jumps[:-1] = (row[:-1] == row[1:]) & known[:-1] & known[1:] & (n[1:] - n[:-1] > 1)
    first = np.maximum(at + 1, 1)
    last = np.minimum(np.append(at[1:], 0) - 1, lengths[row])
    whole = 1 + np.where(jumps, np.maximum(last - first + 1, 0), 0)
    owner = np.repeat(np.arange(len(row)), whole)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
    base = len(row) + (np.cumsum(lengths) - lengths)[row] + first - 1
    places = np.where(within == 0, owner, base[owner] + within - 1)
    values = pa.concat_arrays([column.flatten(), template.flatten()]).take(pa.array(places))
    grown = np.bincount(row, whole, len(sizes)).astype(np.int64)
    return [_lists(grown, values), _lists(grown, pa.array(within > 0))]


def patch_packed(df: DataFrame, keep: list[str], numbering: Column, link: Column, column: Column, template: Column) -> DataFrame:
    """:func:`patch` with one row an object: ``keep`` and the arrays ``letters`` and
    ``patched``.  ``template`` holds the letters of the template from its position 1 on."""
    return _packed(df, keep, [numbering, link, column, template], _patch, "letters array<string>, patched array<boolean>")


def coverage(df: DataFrame, obj: str, columns: list[str], prefix: str = "cov") -> DataFrame:
    """Non-null fraction of each column per object."""
    return df.groupBy(obj).agg(*[(F.count(c) / F.count(F.lit(1))).alias(f"{prefix}_{c}") for c in columns])


def match(df: DataFrame, obj: str, a: str, b: str, as_fraction: bool = True) -> DataFrame:
    """How many positions hold equal values in two columns; nulls equal nulls."""
    n = F.count_if(F.col(a).eqNullSafe(F.col(b)))
    return df.groupBy(obj).agg((n / F.count(F.lit(1)) if as_fraction else n).alias("matched"))


def holds_all(df: DataFrame, obj: str, key: str, wanted: list[int]) -> DataFrame:
    """Objects whose ``key`` column holds every wanted value (relational division)."""
    found = df.where(F.col(key).isin(wanted)).groupBy(obj).agg(F.count_distinct(key).alias("_n"))
    return found.where(F.col("_n") == len(set(wanted))).select(obj)


def mapped_span(df: DataFrame, obj: str, key: str, start: int, end: int) -> DataFrame:
    """``(obj, from_key, to_key)``: the first mapped value >= start from the left and
    the first <= end from the right; objects with a hole over the query drop out."""
    up = F.min_by(F.when(F.col(key) >= start, F.col(key)), F.when(F.col(key) >= start, F.col("i")))
    down = F.max_by(F.when(F.col(key) <= end, F.col(key)), F.when(F.col(key) <= end, F.col("i")))
    return df.groupBy(obj).agg(up.alias("from_key"), down.alias("to_key")).where("from_key <= to_key")


def spawn_child(df: DataFrame, obj: str, ranges: DataFrame, name: Column) -> DataFrame:
    """Rows of a child object: the positions of ``ranges (obj, from_i, to_i)``."""
    cut = df.join(ranges, obj).where(F.col("i").between(F.col("from_i"), F.col("to_i")))
    return cut.withColumn("child", name)


def consecutive_runs(df: DataFrame, order: list[str], key: str, group: list[str] | None = None) -> DataFrame:
    """Number runs of equal neighbours as ``run``, as grouping an iterator does.

    Without ``group`` the whole table is one order, so the work is not spread; give
    the group the order belongs to.
    """
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order)
    turn = F.when(F.lag(key).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_turn", turn).withColumn("run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_turn")


def residue_letters(names: Column, table: dict[str, str], unknown: str = "X") -> Column:
    """One-letter codes of residue names; ``unknown`` for others."""
    pairs = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    return F.coalesce(F.try_element_at(pairs, names), F.lit(unknown))
