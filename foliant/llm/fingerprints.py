"""One-permutation MinHash fingerprints.

Every shingle is hashed once; the hash's high bits name one of BINS bins, each of which keeps
its smallest hash.  Empty bins are filled by optimal densification: bin b takes the value of the
first occupied bin in a pseudo-random order of its own.  A fingerprint packs BITS low-order bits
of each bin; likeness is the share of equal bins, corrected for chance.
Null text: as empty.  No words: the empty fingerprint, like only another empty one.  Null
doc_id: before all others.  Ties of doc_id: by a hash of the text.  One document alone: its own
next.  Very long texts: hashed whole, in bounded segments.  Empty table: empty result."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, partitions, released, shingle_hashes, small_batches, utf8

BINS, BITS = 256, 4
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def bin_minima(texts: list[bytes], width: int = 5) -> np.ndarray:
    """(texts x BINS) smallest hashes; _EMPTY where a bin has none."""
    out = np.full((len(texts), BINS), _EMPTY)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    for i, h in shingle_hashes(texts, width):
        np.minimum.at(out[i], (h >> shift).astype(np.int64), h)
    return out


def densify(minima: np.ndarray) -> np.ndarray:
    """Fill the empty bins of every row that has an occupied one."""
    out, bins = minima.copy(), np.arange(BINS, dtype=np.uint64)
    rows = np.flatnonzero((minima == _EMPTY).any(1) & (minima != _EMPTY).any(1))
    attempt = 0
    while len(rows):
        attempt += 1
        source = (mix(bins * np.uint64(0x10001) + np.uint64(attempt << 20)) % np.uint64(BINS)).astype(np.int64)
        found = minima[rows][:, source]
        part = out[rows]
        fill = (part == _EMPTY) & (found != _EMPTY)
        part[fill] = found[fill]
        out[rows] = part
        rows = rows[(part == _EMPTY).any(1)]
    return out


def pack(dense: np.ndarray) -> np.ndarray:
    """BITS low-order bits of each bin, two bins to a byte."""
    low = (mix(dense) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return low[:, ::2] << 4 | low[:, 1::2]


def fingerprints(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Packed fingerprints and which texts have any shingle."""
    minima = bin_minima(texts, width)
    some = (minima != _EMPTY).any(1)
    return pack(densify(minima)), some


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
    x = a ^ b
    same = ((x & 15) == 0).sum(1) + ((x >> 4) == 0).sum(1)
    chance = 2.0**-BITS
    j = np.clip((same / BINS - chance) / (1 - chance), 0, 1)
    return np.where(some_a & some_b, j, (some_a == some_b).astype(float))


def range_of(value, cuts: list) -> F.Column:
    """How many of the sorted ``cuts`` are at most ``value``, in about 2 root(n) comparisons."""
    n = len(cuts)
    step = max(1, int(n**0.5))
    heads, groups = cuts[step - 1 :: step], [cuts[i : i + step] for i in range(0, n, step)] or [[]]
    kind = "array<bigint>"
    block = F.size(F.filter(F.lit(heads).cast(kind), lambda c: c <= value))
    inner = F.coalesce(F.try_element_at(F.lit(groups).cast(f"array<{kind}>"), block + 1), F.lit([]).cast(kind))
    return (block * step + F.size(F.filter(inner, lambda c: c <= value))).cast("int")


def with_next(docs: DataFrame, run, schema: str) -> DataFrame:
    """``run(rows)`` over each range of doc_id in order, rows (doc_id, text) followed by the one
    row that comes after the range.  Cut points are quantiles of all doc_ids, so texts move once;
    the first document of each range is dealt to the range before it as well."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), key.alias("k"))
    cuts = d.agg(F.percentile_approx("k", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    at = range_of(F.col("k"), cuts)
    heads = {r.at: r.k for r in d.select("k", at.alias("at")).groupBy("at").agg(F.min("k").alias("k")).collect()}
    order = sorted(heads)
    before = {order[i]: order[i - 1] for i in range(len(order))}  # the first range's head follows the last
    size = (order[-1] + 1) if order else 1
    head = F.lit([heads.get(i) for i in range(size)]).cast("array<bigint>")
    back = F.lit([before.get(i, 0) for i in range(size)]).cast("array<int>")
    d = d.withColumn("at", at)
    places = F.when(
        F.try_element_at(head, F.col("at") + 1) == F.col("k"),
        F.array(F.struct(F.col("at").alias("to"), F.lit(0).alias("peek")), F.struct(F.try_element_at(back, F.col("at") + 1).alias("to"), F.lit(1).alias("peek"))),
    ).otherwise(F.array(F.struct(F.col("at").alias("to"), F.lit(0).alias("peek"))))
    d = d.withColumn("p", F.explode(places)).select(F.col("p.to").alias("to"), F.col("p.peek").alias("peek"), "k", F.xxhash64("text").alias("h"), "doc_id", "text")
    d = d.repartitionById(len(cuts) + 1, F.col("to")).sortWithinPartitions("to", "peek", "k", "h")
    return d.select("to", "peek", "doc_id", "text").mapInArrow(released(run), schema)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def windows(batches):
        """Lists of rows in order, each with the row that follows it as the last; about 2 MB."""
        rows, size, to, closed = [], 0, None, False
        for batch in batches:
            for t, peek, d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), utf8(batch.column(3)), strict=True):
                if t != to:
                    rows, size, to, closed = [], 0, t, False
                if closed:
                    continue
                rows.append((d, text))
                size += len(text)
                if peek or (size > 1 << 21 and len(rows) > 1):
                    yield rows
                    rows, size, closed = [rows[-1]], len(text), bool(peek)

    def run(batches):
        for rows in windows(batches):
            raw = [t for _, t in rows]
            text = [t.decode("utf-8", "replace") for t in raw]
            chars = [len(t) for t in text]
            edits = [(a[: n - n // 4] + b[: n // 4]).encode() for a, b, n in zip(text[:-1], text[1:], chars[:-1], strict=True)]
            fp, some = fingerprints(raw)
            efp, esome = fingerprints(edits)
            hexes = [f.tobytes().hex() if s else "" for f, s in zip(fp[:-1], some[:-1], strict=True)]
            ehexes = [f.tobytes().hex() if s else "" for f, s in zip(efp, esome, strict=True)]
            cols = [
                pa.array([d for d, _ in rows[:-1]], pa.int64()),
                pa.array(chars[:-1], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
                pa.array(hexes, pa.string()),
                pa.array(ehexes, pa.string()),
                pa.array(likeness(fp[:-1], efp, some[:-1], esome)),
                pa.array(likeness(fp[:-1], fp[1:], some[:-1], some[1:])),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return with_next(docs, run, schema)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
