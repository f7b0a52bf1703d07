"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over all bytes of a document; each overlapping chunk keeps every filter's
largest response, and the mean and the largest over all chunks are combined into one
probability.  Fitted on a bounded sample of labelled rows; every whole text is scored.
Null or empty text: scored as a text without chunks.  Null doc_id: never a training row.
Labels that disagree for a doc_id: the smallest counts.  Repeated rows: scored alike.  No
labelled row, or one class only: the known class, or 0.5."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_thread, released, small_batches, utf8
from .langid import held_out

WIDTH, FILTERS = 6, 24
BLOCK = 64  # chunks are 4 blocks long and begin every 3
CHUNK, STRIDE = 4, 3
DOCS_A_CLASS = 1500  # training documents of each class, at most about; read whole
EPOCHS, BATCH, RATE = 6, 64, 0.01
THRESHOLD = 0.3


class Filters:
    """Responses are sums of one table row a byte: a convolution over one-hot bytes."""

    def __init__(self, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.p = {
            "t": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "w": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        self.shift = 0.0

    def pairs(self) -> list[np.ndarray]:
        """Tables over two bytes, to look up half as often."""
        t = self.p["t"]
        return [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def document(self, blocks: np.ndarray) -> np.ndarray:
        """Features from the block maxima of one document."""
        if not len(blocks):
            return np.zeros(2 * FILTERS, np.float32)
        starts = range(0, max(1, len(blocks) - CHUNK + STRIDE), STRIDE)
        chunks = np.maximum(np.stack([blocks[s : s + CHUNK].max(0) for s in starts]), 0)
        return np.concatenate([chunks.mean(0), chunks.max(0)])

    def features(self, texts: list[bytes], tables: list[np.ndarray]) -> np.ndarray:
        """Of whole texts; bytes beyond a text's end are zero and give no response of their own."""
        out = np.zeros((len(texts), 2 * FILTERS), np.float32)
        i = 0
        while i < len(texts):
            if len(texts[i]) > 1 << 18:
                out[i] = self.document(np.concatenate(list(self._long(texts[i], tables))))
                i += 1
                continue
            j, size, sizes = i, 0, []
            while j < len(texts) and len(texts[j]) <= 1 << 18 and (j == i or size < 1 << 17):
                room = -(-(len(texts[j]) + WIDTH) // BLOCK) * BLOCK
                sizes.append(room)
                size += room
                j += 1
            data = b"".join(t.ljust(room, b"\0") for t, room in zip(texts[i:j], sizes, strict=True)) + bytes(WIDTH)
            top = self._blocks(np.frombuffer(data, np.uint8), size, tables, np.cumsum([0, *sizes[:-1]]), [len(t) for t in texts[i:j]])
            at = 0
            for k in range(i, j):
                own = -(-len(texts[k]) // BLOCK)
                out[k] = self.document(top[at : at + own])
                at += sizes[k - i] // BLOCK
            i = j
        return out

    def _blocks(self, x, size, tables, starts, lens) -> np.ndarray:
        two = x[:-1].astype(np.int32) * 256 + x[1:]
        r = tables[0][two[:size]]
        for j in range(1, len(tables)):
            r += tables[j][two[2 * j : 2 * j + size]]
        r += self.p["b"]
        for s, n in zip(starts, lens, strict=True):
            end = s + -(-(n + WIDTH) // BLOCK) * BLOCK
            r[s + n : min(end, size)] = -np.inf
        return r.reshape(-1, BLOCK, FILTERS).max(1)

    def _long(self, text: bytes, tables):
        for a in range(0, len(text), 1 << 17):
            part = text[a : a + (1 << 17)]
            size = -(-len(part) // BLOCK) * BLOCK
            data = text[a : a + (1 << 17) + WIDTH].ljust(size + WIDTH, b"\0")
            yield self._blocks(np.frombuffer(data[: size + WIDTH], np.uint8), size, tables, [0], [len(part)])

    def score(self, features: np.ndarray) -> np.ndarray:
        s = features.astype(np.float64) @ self.p["w"] + self.p["c"][0] + self.shift
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def train(texts: list[bytes], y: np.ndarray, seed: int = 9) -> Filters:
    """By Adam on class-weighted cross-entropy over whole texts, each chunk as scoring sees it."""
    net, rng = Filters(seed), np.random.default_rng(seed)
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    size, step = CHUNK * BLOCK, 0
    rows = []
    for t in texts:
        starts = list(range(0, max(1, len(t) - (CHUNK - STRIDE) * BLOCK), STRIDE * BLOCK))
        x = np.zeros((len(starts), size + WIDTH), np.uint8)
        for k, s in enumerate(starts):
            part = np.frombuffer(t[s : s + size + WIDTH], np.uint8)
            x[k, : len(part)] = part
        rows.append((x, np.minimum(size, np.maximum(1, len(t) - np.array(starts)))))
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            x = np.concatenate([rows[i][0] for i in part])
            n = np.concatenate([rows[i][1] for i in part])
            owner = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            r = net.p["t"][0][x[:, :size]]
            for j in range(1, WIDTH):
                r += net.p["t"][j][x[:, j : j + size]]
            r[np.arange(size) >= n[:, None]] = -np.inf
            at = r.argmax(1)
            top = np.take_along_axis(r, at[:, None], 1)[:, 0] + net.p["b"]
            chunks = np.maximum(top, 0)
            count = np.bincount(owner)
            first = np.concatenate([[0], np.cumsum(count)[:-1]])
            mean = np.add.reduceat(chunks, first) / count[:, None]
            peak = np.maximum.reduceat(chunks, first)
            f = np.concatenate([mean, peak], 1)
            d = (net.score(f) - y[part]) * weight[part] / len(part)
            g = {"w": f.T @ d + 1e-4 * net.p["w"], "c": np.array([d.sum()])}
            df = d[:, None] * net.p["w"]
            best = chunks == peak[owner]
            best = best / np.maximum(1, np.add.reduceat(best, first)[owner])
            dc = (df[owner, :FILTERS] / count[owner, None] + df[owner, FILTERS:] * best) * (top > 0)
            g["b"] = dc.sum(0)
            g["t"] = np.zeros_like(net.p["t"])
            lane = np.broadcast_to(np.arange(FILTERS), at.shape)
            for j in range(WIDTH):
                np.add.at(g["t"][j], (np.take_along_axis(x, at + j, 1), lane), dc)
            step += 1
            for key, v in g.items():
                m1[key] = 0.9 * m1[key] + 0.1 * v
                m2[key] = 0.99 * m2[key] + 0.01 * v * v
                net.p[key] -= (RATE * (m1[key] / (1 - 0.9**step)) / (np.sqrt(m2[key] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, docs_a_class: int = DOCS_A_CLASS) -> Filters | float:
    """The network, or one probability where there is no choice to learn."""
    one_thread(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y")).filter(~held_out(5, 0))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    luck = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("y") == 1, min(1.0, docs_a_class / counts[1])).otherwise(min(1.0, docs_a_class / counts[0]))
    # a bounded sample: about docs_a_class of each class, four times that at the very most
    picked = known.filter(luck < rate).limit(4 * docs_a_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").filter("text is not null")

    # a doc_id may come with several texts: the bound holds for rows, and no row is cut
    sample = rows.select("doc_id", "y", F.encode("text", "UTF-8").alias("text")).orderBy(F.xxhash64("doc_id", "text")).limit(4 * docs_a_class).toArrow()
    sample = sample.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = sample["y"].to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return float(y[0]) if len(y) else 0.5
    net = train(sample["text"].to_pylist(), y)
    # training weighs the classes alike; move the odds to those of all labelled rows
    net.shift = float(np.log(counts[1] / counts[0]))
    return net


def score(docs: DataFrame, net: Filters | float) -> DataFrame:
    """``docs`` without text, with ``score``."""
    small_batches(docs.sparkSession)
    extra, order = [c for c in docs.columns if c != "text"], docs.columns
    schema = docs.select(*extra, F.lit(0.0).alias("score")).schema

    def run(batches):
        tables = net.pairs() if isinstance(net, Filters) else None
        for batch in batches:
            texts = utf8(batch.column(order.index("text")))
            s = net.score(net.features(texts, tables)) if tables else np.full(len(texts), float(net))
            yield pa.RecordBatch.from_arrays([*[batch.column(order.index(c)) for c in extra], pa.array(s)], names=[*extra, "score"])

    return docs.mapInArrow(released(run), schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs.select("doc_id", held_out(5, 0).alias("held_out"), "text"), net)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
