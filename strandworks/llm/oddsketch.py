"""Near-duplicate sequences by banded MinHash and odd sketches.

Equal texts are one class, and only class representatives are compared.  Bands of
MinHash samples propose pairs.  A pair is then judged by its odd sketches: each of
the samples flips one bit of a bitmap, so shared samples cancel in the XOR of two
bitmaps and its population count tells how many samples differ.  What passes is
verified exactly on the sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandworks.plans.scratch import Scratch

LETTERS = 5
THRESHOLD = 0.5
#: Two samples a band: at similarity 0.5 a pair meets in no band of 40 with
#: probability 0.75**40 = 1e-5, above it far more rarely.
ROWS_PER_BAND, BANDS = 2, 40
#: Samples and bits of the odd sketch.
SAMPLES, BITS = 192, 1024
#: A bucket of more records is banded again with other samples before it is paired.
HOT = 256
_CHUNK = 1 << 13


def clean(text: Column) -> Column:
    """Upper case, A-Z only."""
    return F.regexp_replace(F.upper(text), "[^A-Z]", "")


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, n, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], letters: int = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as sorted integers, and where each text's begin."""
    flat = np.frombuffer("".join(texts).encode(), np.uint8).astype(np.int64) - 65
    sizes = np.array([len(t) for t in texts], np.int64)
    code = np.zeros(max(0, len(flat) - letters + 1), np.int64)
    for j in range(letters):
        code = code * 26 + flat[j : len(code) + j]
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(code)]
    inside = np.arange(len(code)) - (np.cumsum(sizes) - sizes)[owner] <= sizes[owner] - letters
    both = np.unique((owner[inside] << 32) | code[inside])
    return both & 0xFFFFFFFF, np.searchsorted(both >> 32, np.arange(len(texts) + 1))


def signatures(codes: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash samples of each set, as 32-bit numbers; sets must not be empty.
    Codes are scrambled once; each sample is the least of a permutation of 32 bits."""
    a, b = (c.astype(np.uint32) for c in _constants(n))
    x = (_mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((n, len(bounds) - 1), np.uint32)
    y = np.empty_like(x)
    for i in range(n):
        np.multiply(x, a[i] | np.uint32(1), out=y)
        y ^= y >> np.uint32(15)
        y *= b[i] | np.uint32(1)
        out[i] = np.minimum.reduceat(y, bounds[:-1])
    return out.T.astype(np.uint64)


def band_keys(samples: np.ndarray, rows: int, salt: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` samples."""
    n = samples.shape[1] // rows
    key = np.broadcast_to(np.arange(n, dtype=np.uint64) + np.uint64(salt * 1000 + 1), (len(samples), n))
    for r in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + samples[:, r : rows * n : rows])
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmaps, ``bits/64`` words each: sample i flips the bit its hash names."""
    m, n = samples.shape
    at = (_mix(samples + (np.arange(n, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount((at + np.arange(m)[:, None] * bits).ravel(), minlength=m * bits) & 1
    return np.packbits(flips.astype(np.uint8).reshape(m, bits), axis=1, bitorder="little").view(np.int64)


def sketch_limit(threshold: float, samples: int = SAMPLES, bits: int = BITS, sigmas: float = 4.5) -> int:
    """Most differing bits of a pair at the threshold, but for ``sigmas`` deviations.

    Of k samples k(1-J) differ, binomially; each puts one element of either side into
    the symmetric difference of d elements, of which an odd sketch of n bits shows
    n/2 (1 - (1 - 2/n)**d).  Both deviations add up as variances.
    """
    d = 2 * samples * (1 - threshold)
    stays = (1 - 2 / bits) ** d
    p = (1 - stays) / 2
    sampling = 2 * stays * math.sqrt(samples * threshold * (1 - threshold))
    return math.ceil(bits * p + sigmas * math.sqrt(sampling**2 + bits * p * (1 - p)))


def _pairs(rows: DataFrame, hot: int | None) -> DataFrame:
    """Ordered pairs ``(a, b)`` of the ids that share a key, of ``(key, id, n)``.

    Rows of buckets above ``hot`` are cut into blocks and meet block by block, so
    no task sees more of a bucket than two blocks.
    """
    blocks = F.lit(1) if hot is None else F.greatest(F.lit(1), F.ceil(F.col("n") / hot)).cast("int")
    rows = rows.select("key", "id", blocks.alias("blocks"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", "id", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    left = rows.select("key", "i", "j", F.col("id").alias("a"), F.col("mine").alias("am"))
    right = rows.select("key", "i", "j", F.col("id").alias("b"), F.col("mine").alias("bm"))
    met = left.join(right, ["key", "i", "j"])
    return met.where("a < b and (i = j or am <> bm)").select("a", "b")


def _shared(rows: DataFrame) -> DataFrame:
    """``(key, id)`` rows whose key is shared, with the key's count ``n``."""
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(counts, "key")


def similar_classes(records: DataFrame, threshold: float = THRESHOLD, letters: int = LETTERS, hot: int = HOT, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts and the similar pairs between them.

    ``records`` has ``(id, text)``; texts must be A-Z only, ids unique.  Returns

    * ``members`` ``(rep, id)``: every record whose text has a shingle, with the
      least id of its text;
    * ``links`` ``(a, b)``, a < b: representatives whose shingle sets have a Jaccard
      similarity of at least ``threshold``.

    Null, empty and shorter texts are in neither.  No bucket is cut: a hot one is
    banded again with fresh samples, which similar pairs survive and accidental
    company does not, and what stays hot is paired in blocks.  A pair at the threshold
    that meets in a hot bucket alone is lost there with a chance of 1e-5; with
    ``exact`` hot buckets are paired in blocks at once and lose none.
    """
    scratch = Scratch(records.sparkSession, "oddsketch")
    usable = records.where(F.length("text") >= letters)
    members = scratch.save(_with_rep(usable, scratch), "members")
    reps = members.where("id = rep").select("rep", "text")
    n = ROWS_PER_BAND * BANDS

    def run(batches: Iterator[pa.RecordBatch], again: bool = False) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= _CHUNK):
                    size += len(texts[end])
                    end += 1
                codes, bounds = shingle_sets(texts[begin:end], letters)
                samples = signatures(codes, bounds, max(2 * n, SAMPLES))
                lists = lambda x: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
                ours = ids.slice(begin, end - begin)
                if again:
                    yield pa.RecordBatch.from_arrays([ours, lists(band_keys(samples[:, n : 2 * n], ROWS_PER_BAND, 1))], names=["id", "rebands"])
                else:
                    sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(codes.astype(np.int32)))
                    keys = lists(band_keys(samples[:, :n], ROWS_PER_BAND, 0))
                    yield pa.RecordBatch.from_arrays([ours, keys, lists(odd_sketches(samples[:, :SAMPLES])), sets], names=["id", "bands", "sketch", "shingles"])
                begin = end

    kind = records.schema["id"].dataType.simpleString()
    table = scratch.save(reps.mapInArrow(run, f"id {kind}, bands array<long>, sketch array<long>, shingles array<int>"), "sketches")

    rows, seen = scratch.save(_shared(table.select(F.explode("bands").alias("key"), "id")), "buckets", heavy=F.count_if(F.col("n") > hot))
    light, heavy = rows.where(F.col("n") <= hot), rows.where(F.col("n") > hot)
    pairs = _pairs(light, None)
    again = heavy if exact else None
    if seen["heavy"] and not exact:
        fresh = reps.join(heavy.select(F.col("id").alias("rep")).distinct(), "rep", "left_semi").select("rep", "text")
        fresh = fresh.mapInArrow(partial(run, again=True), f"id {kind}, rebands array<long>")
        again = heavy.join(fresh, "id").select(F.col("key").alias("k1"), "id", F.explode("rebands").alias("k2"))
        again = scratch.save(_shared(again.select(F.xxhash64("k1", "k2").alias("key"), "id")), "rebanded")
    pairs = (pairs if again is None else pairs.unionByName(_pairs(again, hot))).distinct()

    words = BITS // 64
    side = lambda s: table.select(F.col("id").alias(s), F.col("sketch").alias(f"{s}_sketch"))
    differ = sum((F.bit_count(F.col("a_sketch")[i].bitwiseXOR(F.col("b_sketch")[i])) for i in range(words)), F.lit(0))
    likely = pairs.join(side("a"), "a").join(side("b"), "b").where(differ <= sketch_limit(threshold)).select("a", "b")
    likely = scratch.save(likely, "likely")
    scratch.drop(rows, again if seen["heavy"] and not exact else None)
    sets = lambda s: table.select(F.col("id").alias(s), F.col("shingles").alias(f"{s}_set"))
    common = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - common
    links = likely.join(sets("a"), "a").join(sets("b"), "b").where(common >= threshold * union).select("a", "b")
    links = scratch.save(links, "links")
    scratch.drop(likely, table)
    return members.select("rep", "id"), links


def _with_rep(usable: DataFrame, scratch: Scratch) -> DataFrame:
    """Each record with the least id of its text.  The least id is found with a
    map-side combine, and copies join it by digest, whose hot values adaptive
    execution can split."""
    usable = scratch.save(usable.select("id", "text", F.sha2("text", 256).alias("digest")), "usable")
    least = usable.groupBy("digest").agg(F.min("id").alias("rep"))
    return usable.join(least, "digest").select("rep", "id", F.when(F.col("id") == F.col("rep"), F.col("text")).alias("text"))


def similar_pairs(records: DataFrame, **options) -> DataFrame:
    """All similar pairs of records ``(a, b)``, a < b, copies included."""
    members, links = similar_classes(records, **options)
    sizes = members.groupBy(F.col("rep").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = _pairs(members.select(F.col("rep").alias("key"), "id").join(sizes, "key"), HOT)
    left = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    linked = links.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return copies.unionByName(linked)


def duplicate_classes(records: DataFrame, **options) -> DataFrame:
    """``(id, class_id, n_links)``: each record's class of equal texts and the number
    of other classes similar to it; copies are not expanded into pairs."""
    members, links = similar_classes(records, **options)
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    return members.join(ends, "rep", "left").select("id", F.col("rep").alias("class_id"), F.coalesce("n", F.lit(0)).alias("n_links"))
