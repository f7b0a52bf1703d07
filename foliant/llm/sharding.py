"""K-d tree sharding by bytes.

Documents are points of metadata: size, letters a byte, text digest.  Leaves are split at
distributed weighted medians along the widest dimension until they reach the target bytes;
leaves then go to shards, largest first, so that shards' bytes are near equal.  Equal texts are
one point and stay in one shard, unless their group outweighs a shard's share: only then its
leaf is dealt by a hash of doc_id.  Null text: size 1, digest of the empty text.  Null doc_id:
first in its shard.  Repeated rows: documents of their own.  Empty table: empty result."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, running, store

BINS = 64
LEAVES = 32  # leaves to a shard: a leaf's bytes bound how far shards differ
DIMS = ("d0", "d1", "d2")


def points(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), crc.alias("text_crc32"), F.length(text).alias("letters")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.log2("size").alias("d0"),
        (F.col("letters") / F.col("size")).alias("d1"),
        (F.pmod(F.xxhash64("text_crc32", "size"), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("d2"),
    )


class Tree:
    """The splits so far: nodes hold a dimension and a cut, or none; at most two a leaf, so its
    size is bounded by the number of leaves asked for, not by the data."""

    def __init__(self):
        self.dim, self.cut, self.kids = [-1], [0.0], [(0, 0)]

    def split(self, node: int, dim: int, cut: float) -> tuple[int, int]:
        a = len(self.dim)
        self.dim[node], self.cut[node], self.kids[node] = dim, cut, (a, a + 1)
        self.dim += [-1, -1]
        self.cut += [0.0, 0.0]
        self.kids += [(0, 0), (0, 0)]
        return a, a + 1

    def where(self, x: np.ndarray) -> np.ndarray:
        dim, cut, kids = np.array(self.dim), np.array(self.cut), np.array(self.kids)
        at = np.zeros(len(x), np.int64)
        while True:
            move = np.flatnonzero(dim[at] >= 0)
            if not len(move):
                return at
            n = at[move]
            at[move] = kids[n, (x[move, dim[n]] >= cut[n]).astype(int)]


def _matrix(batch, cols) -> np.ndarray:
    return np.stack([batch.column(cols.index(d)).to_numpy(zero_copy_only=False) for d in DIMS], 1)


def grow(table: DataFrame, leaf_bytes: float) -> tuple[Tree, dict[int, float]]:
    """Tree and bytes of its leaves.  A level is one pass: tasks sum bytes by (node, dimension,
    bin), Spark adds them up, and at most nodes x dimensions x BINS sums reach the driver."""
    low = table.agg(*[F.min(d) for d in DIMS], *[F.max(d) for d in DIMS], F.sum("size")).first()
    tree, cols = Tree(), table.columns
    if low[0] is None:
        return tree, {0: 0.0}
    span = [max(low[k + 3] - low[k], 1e-300) for k in range(3)]
    boxes = {0: [[low[k], low[k + 3]] for k in range(3)]}
    weight = {0: float(low[6])}
    done: set[int] = set()
    while active := sorted(n for n in boxes if weight[n] > leaf_bytes and n not in done):
        lo = np.array([[b[0] for b in boxes[n]] for n in active])
        hi = np.array([[b[1] for b in boxes[n]] for n in active])

        def tally(batches, tree=tree, active=active, lo=lo, hi=hi):
            index = np.full(len(tree.dim), -1)
            index[active] = np.arange(len(active))
            sums = np.zeros(len(active) * 3 * BINS)
            for batch in batches:
                x = _matrix(batch, cols)
                k = index[tree.where(x)]
                x, w, k = x[k >= 0], batch.column(cols.index("size")).to_numpy(zero_copy_only=False)[k >= 0], k[k >= 0]
                width = np.maximum(hi[k] - lo[k], 1e-300)
                b = np.clip(((x - lo[k]) / width * BINS).astype(np.int64), 0, BINS - 1)
                for d in range(3):
                    sums += np.bincount((k * 3 + d) * BINS + b[:, d], w, len(sums))
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["cell", "w"])

        cells = table.mapInArrow(released(tally), "cell long, w double").groupBy("cell").agg(F.sum("w").alias("w")).collect()
        sums = np.zeros((len(active), 3, BINS))
        for c in cells:
            sums.reshape(-1)[c.cell] = c.w
        for i, n in enumerate(active):
            box, best = boxes[n], None
            for d in range(3):
                full = np.flatnonzero(sums[i, d])
                step = (box[d][1] - box[d][0]) / BINS
                if len(full) > 1:
                    width = (full[-1] - full[0] + 1) * step / span[d]
                    if best is None or width > best[0]:
                        best = (width, d, full, step)
            if best is None:  # one cell in every dimension: look closer, or it is one point
                nearer = [[b[0] + f[0] * (b[1] - b[0]) / BINS, min(b[1], b[0] + (f[0] + 1) * (b[1] - b[0]) / BINS)] for b, f in ((box[d], np.flatnonzero(sums[i, d])) for d in range(3))]
                if all((b[1] - b[0]) <= 1e-13 * max(1.0, abs(b[0])) for b in nearer):
                    done.add(n)
                boxes[n] = nearer
                continue
            _, d, full, step = best
            cum = np.cumsum(sums[i, d][full])
            j = int(np.argmin(np.abs(cum[:-1] - cum[-1] / 2)))
            cut = box[d][0] + full[j + 1] * step
            a, b = tree.split(n, d, cut)
            weight[a], weight[b] = float(cum[j]), float(cum[-1] - cum[j])
            for kid, side in ((a, 0), (b, 1)):
                boxes[kid] = [list(v) for v in box]
                boxes[kid][d] = [box[d][0] + full[0] * step, cut] if side == 0 else [cut, min(box[d][1], box[d][0] + (full[-1] + 1) * step)]
            del boxes[n]
    return tree, {n: weight[n] for n in boxes}


def deal(leaves: dict[int, float], shards: int) -> dict[int, list[int]]:
    """Shards of each leaf, largest leaf first to the lightest shard.  A leaf of over a shard's
    share (one point, or it would be split) is dealt in as many parts as share-size leaves."""
    total = sum(leaves.values())
    parts = []
    for n, w in leaves.items():
        k = math.ceil(w / (total / shards / LEAVES)) if w > total / shards else 1
        parts += [(w / k, n)] * k
    heap, out = [(0.0, s) for s in range(shards)], {n: [] for n in leaves}
    for w, n in sorted(parts, reverse=True):
        have, s = heapq.heappop(heap)
        out[n].append(s)
        heapq.heappush(heap, (have + w, s))
    return out


def shard(docs: DataFrame, shards: int = 8, leaf_bytes: float | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    table = store(points(docs), "shard-points")
    total = table.agg(F.sum("size")).first()[0] or 0
    tree, leaves = grow(table, leaf_bytes or max(1.0, total / shards / LEAVES))
    to, cols = deal(leaves, shards), table.columns

    def place(batches):
        most = max(map(len, to.values()))
        grid = np.zeros((len(tree.dim), most), np.int32)
        count = np.ones(len(tree.dim), np.int64)
        for n, s in to.items():
            grid[n, : len(s)], count[n] = s, len(s)
        for batch in batches:
            leaf = tree.where(_matrix(batch, cols))
            turn = batch.column(cols.index("turn")).to_numpy(zero_copy_only=False) % count[leaf]
            keep = [batch.column(cols.index(c)) for c in ("doc_id", "size", "text_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(grid[leaf, turn], pa.int32())], names=["doc_id", "size", "text_crc32", "shard"])

    table = table.withColumn("turn", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    cols = table.columns
    dealt = table.mapInArrow(released(place), "doc_id long, size long, text_crc32 long, shard int").withColumn("_one", F.lit(1).cast("long"))
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = running(dealt, ["shard"], order, "_one", "shard-slot")
    return ranked.select("doc_id", "size", "text_crc32", "shard", F.col("before").alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
