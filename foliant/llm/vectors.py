"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors fall into buckets of quantised random projections, in several tables; pairs
that share a bucket are compared by cosine in double precision, and linked from THRESHOLD up.
Two unit vectors of cosine c are sqrt(2-2c) apart, so projections and tables follow from the
threshold, the number of vectors and the recall asked for at the threshold itself (closer pairs
are found more surely).  Bucket keys travel without vectors; only vectors that share a bucket with
another follow, and buckets are so fine that strangers seldom do.  Equal vectors are one, with a weight.  A bucket of more than BLOCK
vectors is compared block against block, each pair of blocks in a group of its own; a pair that
shares buckets of several tables counts in the first only.  Groups give link counts and a
spanning star, never pairs.
Vectors of one length are compared with each other; each length has tables of its own.
Null, zero and non-finite vectors and rows of null vec_id link with nothing (null vec_id: null component, not kept).  Repeated rows are vectors that link
with each other.  Empty table: empty result."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, partitions, released, small_batches, store

THRESHOLD = 0.95
RECALL = 0.999  # of pairs at the threshold
WIDTH = 1.6  # of a projection's cells
BLOCK = 256  # vectors of a bucket compared at a time
FAR = 1.38  # distance of vectors that have nothing in common, for choosing the projections
STRANGERS = 1 / 8  # of them to a bucket: fewer cost more tables of keys, more cost vectors sent


def collide(distance: float, width: float = WIDTH) -> float:
    """Probability that one projection puts two vectors of this distance into one cell."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Projections a table, and tables: about STRANGERS to a bucket, whatever n is."""
    k = max(4, math.ceil(math.log(max(n, 8) / STRANGERS) / -math.log(collide(FAR))))
    near = collide(math.sqrt(2 - 2 * threshold)) ** k
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near))


class Tables:
    def __init__(self, dims: int, k: int, tables: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.a = rng.normal(size=(dims, tables * k))
        self.b = rng.uniform(0, WIDTH, tables * k)
        self.fold = rng.integers(1, 1 << 62, k, dtype=np.int64) | 1
        self.k, self.tables = k, tables

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(vectors x tables) bucket keys."""
        cells = np.floor((unit @ self.a + self.b) / WIDTH).astype(np.int64).reshape(len(unit), self.tables, self.k)
        return (cells * self.fold).sum(2)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square under- or overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1))[:, None]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    small_batches(spark, 4000)
    # floats stay four bytes wide until they are compared
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    v = vectors.select("vec_id", F.col("embedding").cast("array<float>" if single else "array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    ok = F.coalesce((F.size("e") > 0) & finite, F.lit(False)) & F.col("vec_id").isNotNull()
    good, bad = v.filter(ok), v.filter(~ok)
    reps = store(good.groupBy("e").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "vec-reps")
    plans = {r.dims: plan(r["count"], threshold, recall) for r in reps.groupBy(F.size("e").alias("dims")).count().collect()}
    made = {}

    def hasher_of(dims):
        """Tables of a length; a task keeps those of a few lengths."""
        if dims not in made:
            if len(made) > 8:
                made.clear()
            made[dims] = Tables(dims, *plans[dims])
        return made[dims]

    def emit(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
            for dims in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                hasher, n = hasher_of(dims), part.num_rows
                keys = hasher.keys(unit(part.column(0).flatten().to_numpy().reshape(n, dims)))
                for t in range(hasher.tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(keys[:, t]), part.column(1)], names=["dims", "t", "key", "rep"])

    keyed = store(reps.select("e", "rep").mapInArrow(released(emit), "dims int, t int, key long, rep long"), "vec-keys")
    sizes = keyed.groupBy("dims", "t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.select(F.col("dims").alias("_n"), F.col("t").alias("_t"), F.col("key").alias("_k"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = keyed.join(sizes, (F.col("dims") == F.col("_n")) & (F.col("t") == F.col("_t")) & (F.col("key") == F.col("_k"))).drop("_n", "_t", "_k")
    rows = store(rows, "vec-shared").join(reps.select(F.col("rep").alias("_r"), "weight", F.col("e").alias("raw")), F.col("rep") == F.col("_r"))
    own = F.pmod(F.xxhash64("rep", "t"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("dims", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "weight", "raw")
    # a block against another is one group; blocks against themselves come once, as (i, i)
    rows = rows.repartition(partitions(spark), "dims", "t", "key", "i", "j").sortWithinPartitions("dims", "t", "key", "i", "j", "own", "rep")

    def groups(batches):
        now, rows = None, []
        for batch in batches:
            lists = batch.column(8)
            flat, at = lists.flatten().to_numpy(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            cols = [c.to_pylist() for c in batch.columns[:8]]
            for *key, own, rep, weight, raw in zip(*cols, (flat[a:b] for a, b in zip(at, at[1:], strict=False)), strict=True):
                if key != now:
                    if len(rows) > 1:
                        yield now, rows
                    now, rows = key, []
                rows.append((own, rep, weight, raw))
        if len(rows) > 1:
            yield now, rows

    def compare(batches):
        ids, counts, roots = [], [], []
        for (dims, t, _, i, j), rows in groups(batches):
            hasher = hasher_of(dims)
            x_ = unit(np.stack([r[3] for r in rows]))
            own = np.array([r[0] for r in rows])
            for a in range(0, len(rows), 4 * BLOCK):  # a block may be somewhat over BLOCK
                part = x_[a : a + 4 * BLOCK]
                x, y = np.nonzero(part @ x_.T >= threshold - 1e-12)
                x += a
                keep = (x < y) & ((own[x] != own[y]) if i != j else True)
                x, y = x[keep], y[keep]
                real = [np.zeros(0, bool)]
                for k in range(0, len(x), 1 << 14):
                    p, q = x[k : k + (1 << 14)], y[k : k + (1 << 14)]
                    # by the same formula wherever a pair is met, and in its first table only
                    exact = np.einsum("nd,nd->n", x_[p], x_[q]) >= threshold
                    if exact.any() and t:
                        some = np.unique(np.concatenate([p, q]))
                        keys = hasher.keys(x_[some])[:, :t]
                        exact &= ~(keys[np.searchsorted(some, p)] == keys[np.searchsorted(some, q)]).any(1)
                    real.append(exact)
                real = np.concatenate(real)
                x, y = x[real], y[real]
                if not len(x):
                    continue
                weight = np.array([r[2] for r in rows])
                found = np.bincount(x, weight[y], len(rows)) + np.bincount(y, weight[x], len(rows))
                parent = list(range(len(rows)))

                def top(p, parent=parent):
                    while parent[p] != p:
                        parent[p] = p = parent[parent[p]]
                    return p

                for p, q in zip(x.tolist(), y.tolist(), strict=True):
                    p, q = top(p), top(q)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                for p in np.flatnonzero(found).tolist():
                    ids.append(rows[p][1])
                    counts.append(int(found[p]))
                    roots.append(rows[top(p)][1])
            if len(ids) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, counts, roots)], names=["rep", "links", "root"])
                ids, counts, roots = [], [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, counts, roots)], names=["rep", "links", "root"])

    found = store(rows.mapInArrow(released(compare), "rep long, links long, root long"), "vec-links")
    groups_of = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), "vec-cc")
    total = found.groupBy("rep").agg(F.sum("links").alias("links"))
    info = reps.join(total, "rep", "left").join(groups_of, F.col("rep") == F.col("id"), "left")
    info = info.select(F.col("e").alias("_e"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = good.join(info, F.col("e") == F.col("_e")).select("vec_id", "n_links", "component_id")
    out = out.unionByName(bad.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(x, y) AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
n AS (SELECT x, COUNT(*) AS n_links FROM p GROUP BY x),
c AS (SELECT x, MIN(y) AS c FROM r GROUP BY x)
SELECT e.vec_id, CAST(COALESCE(n.n_links, 0) AS BIGINT) AS n_links, CAST(LEAST(e.vec_id, COALESCE(c.c, e.vec_id)) AS BIGINT) AS component_id,
       e.vec_id = LEAST(e.vec_id, COALESCE(c.c, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.x = e.vec_id
"""
