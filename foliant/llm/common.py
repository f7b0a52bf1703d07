"""Shared pieces of the training-data operators: shared-folder tables, byte-exact
word hashing in numpy, and connected components as DataFrame rounds."""

from __future__ import annotations

import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.
    Only where that is unset and the session runs in one JVM (tests, a laptop) a folder of our own
    stands in for it; a cluster without that setting is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="foliant-"))
    return f"{base.rstrip('/')}/foliant-{app}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage in a way
    that outlives executors.  The folder is per application and may be deleted after it."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_tables: dict[str, list[str]] = {}
KEPT = "keep-"  # names of tables that ``sweep`` leaves alone begin so


def sweep(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the tables that ``store`` wrote, from the ``since``-th on but for names in ``keep``:
    for callers that know that no plan reads them any more."""
    mine = _tables.get(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in mine[since:] if not p.rsplit("/", 1)[-1].startswith((KEPT, *keep))]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        mine.remove(path)
    tidy(spark)


def stored(spark: SparkSession) -> int:
    """How many tables there are now, for ``sweep``."""
    return len(_tables.get(spark.sparkContext.applicationId, []))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the Arrow batches that go to Python; a batch holds whole texts."""
    one_thread(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def one_thread(spark: SparkSession) -> None:
    """Matrix products of workers in one thread each: the tasks of an executor fill its cores."""
    spark.sparkContext.environment["OMP_NUM_THREADS"] = "1"


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def released(run):
    """``run`` for mapInArrow, giving memory back to the system when a partition is done: workers
    are used again and again, and what their allocators keep would add up."""

    def whole(batches):
        import ctypes
        import gc

        pa.set_memory_pool(pa.system_memory_pool())  # one allocator, so that what is freed can go back
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):
                pass  # another C library

    return whole


# ---------------------------------------------------------------- words as hashes

SEGMENT = 1 << 16  # bytes hashed at a time: numpy columns of half a MB, whatever the length of a text
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser; a bijection, so equality is kept."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))
_pow: list[np.ndarray] = []


def powers() -> np.ndarray:
    """r^0 .. r^SEGMENT modulo 2^64."""
    if not _pow:
        p = np.full(SEGMENT + 1, _R, np.uint64)
        p[0] = 1
        _pow.append(np.multiply.accumulate(p))
    return _pow[0]


def _segment_words(data: np.ndarray, edge: np.ndarray | None) -> np.ndarray:
    """Starts, ends and hashes of the words of one segment; edge marks first bytes of texts."""
    blank = _SPACE[data]
    first = ~blank
    first[1:] &= blank[:-1] | edge[1:] if edge is not None else blank[:-1]
    last = ~blank
    last[:-1] &= blank[1:] | edge[1:] if edge is not None else blank[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    pw = powers()
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[_LOWER[data]] * pw[: len(data)], out=total[1:])
    h = (total[b] - total[a]) * pw[SEGMENT - a]
    return a, b, mix(h + (b - a).astype(np.uint64))


def _long_words(text: bytes) -> np.ndarray:
    """Word hashes of one text longer than a segment, cut at white space.  A single word of
    more than a segment is hashed by its 128-bit digest's low half."""
    import xxhash

    out, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + SEGMENT)
        if end < n:
            piece = np.frombuffer(text, np.uint8, end - at, at)
            gaps = np.flatnonzero(_SPACE[piece])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < n and not _SPACE[text[end]]:
                    end += 1
                out.append(np.array([xxhash.xxh3_64_intdigest(text[at:end].lower())], np.uint64))
                at = end
                continue
        out.append(_segment_words(np.frombuffer(text, np.uint8, end - at, at), None)[2])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(texts: list[bytes]):
    """Yields (first text, word counts, hashes) for runs of whole texts.  Words are
    ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; equal words have equal hashes everywhere."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > SEGMENT:
            h = _long_words(texts[i])
            yield i, np.array([len(h)]), h
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) <= SEGMENT:
            size += len(texts[j])
            j += 1
        lens = np.array([len(t) for t in texts[i:j]])
        data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        if size:
            bounds = np.concatenate([[0], np.cumsum(lens)])
            edge = np.zeros(size, bool)
            edge[bounds[:-1][lens > 0]] = True
            a, _, h = _segment_words(data, edge)
            counts = np.diff(np.searchsorted(a, bounds))
        else:
            h, counts = np.zeros(0, np.uint64), np.zeros(len(lens), np.int64)
        yield i, counts, h
        i = j


def shingle_hashes(texts: list[bytes], width: int = 5):
    """Yields (text number, shingle hashes in order, with repeats).  Fewer words than
    ``width``: the whole sequence as one shingle; no words: none."""
    mul = np.uint64(0xD6E8FEB86659FD93)
    for first, counts, h in word_hashes(texts):
        if len(h) >= width:
            roll = h[: len(h) - width + 1].copy()
            for k in range(1, width):
                roll = roll * mul + h[k : len(h) - width + 1 + k]
            roll = mix(roll)
        at = 0
        for k, n in enumerate(counts.tolist()):
            if n >= width:
                yield first + k, roll[at : at + n - width + 1]
            elif n:
                one = np.uint64(n)
                with np.errstate(over="ignore"):
                    for x in h[at : at + n]:
                        one = one * mul + x
                yield first + k, mix(np.array([one], np.uint64))
            else:
                yield first + k, h[:0]
            at += n


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, name: str = "cc", rounds: int = 40) -> DataFrame:
    """(id, component): the smallest id reachable over ``edges`` (a, b: long), for every id on
    an edge.  Rounds of hooking and pointer jumping over written tables: each is aggregations
    with map-side combine and joins that AQE may split, so a hub is no single task, and nothing
    but a count reaches the driver.  The number of rounds grows with the log of a chain."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = store(both, f"{name}-edges")
    label = store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")), f"{name}-l")
    for r in range(rounds):
        seen = label.select(F.col("a").alias("b"), F.col("l").alias("lb"))
        best = both.join(seen, "b").groupBy("a").agg(F.min("lb").alias("m"))
        # the root of each vertex learns of the smallest label next to any of its vertices
        own = label.join(best, "a").select("a", "l", F.least("l", "m").alias("m"))
        own = store(own, f"{name}-own{r}")
        if not own.filter("m < l").limit(1).count():
            return label.select(F.col("a").alias("id"), F.col("l").alias("component"))
        root = own.groupBy(F.col("l").alias("root")).agg(F.min("m").alias("to"))
        up = own.join(root, own.l == root.root, "left").select("a", F.least("m", F.coalesce("to", "m")).alias("l"))
        jump = up.select(F.col("a").alias("p"), F.col("l").alias("lp"))
        up = up.join(jump, up.l == jump.p, "left").select("a", F.least("l", F.coalesce("lp", "l")).alias("l"))
        label = store(up, f"{name}-l{r + 1}")
    raise RuntimeError("components did not settle")


# ---------------------------------------------------------------- distributed running sums


def running(df: DataFrame, group: list[str], order: list, value: str, name: str) -> DataFrame:
    """``df`` (stored) with ``before``: the sum of ``value`` over the rows of the same group that
    come earlier in ``order``.  Range-sorted by (group, order), so that a hot group spans many
    partitions; each partition sums locally, and only one total per partition and group is
    summed again.  Rows that tie in ``order`` share a partition."""
    spark = df.sparkSession
    cols, keys = df.columns, [F.col(g).asc_nulls_last() for g in group] + list(order)
    dealt = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    schema = T.StructType([*dealt.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_local", T.LongType())])

    def add(batches):
        from pyspark import TaskContext

        pid, last, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(cols.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.zeros(len(v), bool)
            for g in group:
                x = batch.column(cols.index(g))
                same = pa.compute.equal(x[1:], x[:-1]).fill_null(False).to_numpy(zero_copy_only=False)
                null = x.is_null().to_numpy(zero_copy_only=False)
                new[1:] |= ~(same | null[1:] & null[:-1])
            head = tuple(batch.column(cols.index(g))[0].as_py() for g in group)
            new[0] = head != last
            cum = np.cumsum(v) - v
            at = np.flatnonzero(new)
            base = np.full(len(v), -total, np.int64)  # what to take off: the sum before the group began
            if len(at):
                run = np.searchsorted(at, np.arange(len(v)), side="right") - 1
                base = np.where(run >= 0, cum[at[np.maximum(run, 0)]], -total)
            local = cum - base
            total = int(local[-1] + v[-1])
            last = tuple(batch.column(cols.index(g))[batch.num_rows - 1].as_py() for g in group)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(v), pid, np.int32)), pa.array(local)], names=[*cols, "_pid", "_local"]
            )

    from pyspark.sql import Window

    parts = store(dealt.mapInArrow(released(add), schema), name)
    sums = parts.groupBy("_pid", *group).agg(F.sum(value).alias("_sum"))
    over = Window.partitionBy(*([F.col(g) for g in group] or [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_off"))
    on = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group):
        on &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return parts.join(sums, on).select(*cols, (F.col("_local") + F.col("_off")).alias("before"))


# ---------------------------------------------------------------- bounded tables for map sides


def tidy(spark: SparkSession) -> None:
    """Let the JVM drop shuffle files that no live plan needs; long jobs hold many otherwise.  Executors
    collect their garbage too: a heap grows to its limit and stays there, beside the Python workers,
    and each process that it starts shows as much again until it runs a program of its own."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    if spark.sparkContext.master.split("[")[0] != "local":
        n = spark.sparkContext.defaultParallelism  # a task for each core, so that every executor has some
        spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


BITS_WORDS = 1 << 20


class Packed:
    """An array that travels compressed: tables are mostly empty, and a task holds them once."""

    def __init__(self, array: np.ndarray):
        self.array = array

    def __getstate__(self):
        return self.array.dtype.str, zlib.compress(self.array.tobytes(), 1)

    def __setstate__(self, state):
        self.array = np.frombuffer(zlib.decompress(state[1]), state[0])


def bit_table(hashes: DataFrame) -> Packed:
    """A one-hash Bloom filter of fixed size (8 MB) over the longs of the first column: what is
    in it may be more than was put in, never less, so users only save work by it."""
    h = F.col(hashes.columns[0])
    words = hashes.select(F.pmod(h, F.lit(BITS_WORDS)).cast("int").alias("i"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(`{hashes.columns[0]}`, 20) & 63 as int))").alias("b"))
    got = words.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS_WORDS, np.uint64)
    out[got["i"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return Packed(out)


def in_table(table: Packed, h: np.ndarray) -> np.ndarray:
    u = h.astype(np.int64).view(np.uint64)
    return (table.array[(u & np.uint64(BITS_WORDS - 1)).astype(np.int64)] >> (u >> np.uint64(20) & np.uint64(63))) & np.uint64(1) == 1


def held_in(table: Packed):
    """A column function: may the hashed long be in the bit table?"""

    @F.arrow_udf("boolean")
    def held(h: pa.Array) -> pa.Array:
        return pa.array(in_table(table, h.to_numpy(zero_copy_only=False)))

    return held


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in the one column of ``ids``.  Rows that the bit table
    clears stay in place; only the others are joined, so kept texts hardly move."""
    ids = ids.select(F.col(ids.columns[0]).alias("_id"))
    table = bit_table(ids.select(F.xxhash64("_id").alias("h")))
    marked = docs.withColumn("_maybe", held_in(table)(F.xxhash64(key)))
    clear = marked.filter(~F.col("_maybe")).drop("_maybe")
    rest = marked.filter("_maybe").drop("_maybe").join(ids, F.col(key) == F.col("_id"), "left_anti")
    return clear.unionByName(rest)


def apart(docs: DataFrame, names: tuple[str, ...]):
    """``docs`` with every column but ``names`` called by its place, so that no column an operator
    makes can clash with one of them, and a function that gives a result its old names back."""
    own = {c: c if c in names else f"column_{i}" for i, c in enumerate(docs.columns)}
    back = lambda out: out.select(*[F.col(v).alias(k) for k, v in own.items()])
    quoted = lambda name: "`" + name.replace("`", "``") + "`"
    return docs.select(*[F.col(quoted(k)).alias(v) for k, v in own.items()]), back
