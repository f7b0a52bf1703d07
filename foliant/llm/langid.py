"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads each white-space-separated word from both ends, labels every byte of it with
language probabilities, and a document's probabilities are the mean over all its positions.
Words are the sequences (longer ones are cut every LONGEST bytes), so equal words have equal
labels: a worker runs the network on words it has not met and remembers the sums.  Trained in
numpy by backpropagation through time on a bounded sample of labelled rows, of which all words with
a letter are drawn from.
Null text, or one without a letter: ``und``, score 0.  Null doc_id: never a training row.
Repeated rows: predicted alike.  Very long texts: read whole.  No labelled row: all ``und``."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import one_thread, released, small_batches, utf8

HIDDEN = 16
LONGEST = 24
DOCS_A_LANGUAGE = 400  # training documents of each language, at most about; read whole
STEPS, BATCH, RATE = 300, 1024, 0.02
CACHE_WORDS = 250_000  # words whose sums a worker keeps
CACHE_SUMS = 200 * CACHE_WORDS  # sums: with more languages than 200, fewer words are kept
WINDOW = 1 << 20  # bytes of text read at a time
UND = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "ignore")))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (words x longest) and lengths."""
    lens = np.array([len(w) for w in words])
    out = np.zeros((len(words), int(lens.max())), np.uint8)
    out[np.arange(out.shape[1]) < lens[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out, lens


class Network:
    """Per direction: input table (256 x 3H), recurrent matrix (H x 3H), bias; then H+H -> labels."""

    def __init__(self, labels: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        g = lambda *s, a: rng.normal(0, a, s).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": g(256, 3 * HIDDEN, a=0.3), f"u{d}": g(HIDDEN, 3 * HIDDEN, a=HIDDEN**-0.5), f"c{d}": np.zeros(HIDDEN, np.float32)}
        self.p |= {"o": g(2 * HIDDEN, labels, a=0.2), "ob": np.zeros(labels, np.float32)}

    def _pass(self, d: str, x: np.ndarray, lens: np.ndarray, tape: list | None) -> np.ndarray:
        """Hidden states (T x n x H), each at its own position."""
        n, T = x.shape
        h, out = np.zeros((n, HIDDEN), np.float32), np.zeros((T, n, HIDDEN), np.float32)
        X, U, c = self.p[f"x{d}"], self.p[f"u{d}"], self.p[f"c{d}"]
        for t in range(T) if d == "f" else reversed(range(T)):
            live = (lens > t)[:, None]
            a, u = X[x[:, t]], h @ U
            zr = _sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            un = u[:, 2 * HIDDEN :] + c
            m = np.tanh(a[:, 2 * HIDDEN :] + r * un)
            new = np.where(live, m + z * (h - m), h)
            if tape is not None:
                tape.append((t, live, h, z, r, m, un))
            h = out[t] = new
        return out

    def positions(self, x, lens, tapes=None):
        hf = self._pass("f", x, lens, None if tapes is None else tapes["f"])
        hb = self._pass("b", x, lens, None if tapes is None else tapes["b"])
        h = np.concatenate([hf, hb], 2)
        s = h @ self.p["o"] + self.p["ob"]
        s = np.exp(s - s.max(2, keepdims=True))
        return h, s / s.sum(2, keepdims=True)

    def sums(self, words: list[bytes]) -> np.ndarray:
        """Per word: the sums of its positions' probabilities, and its positions."""
        out = np.zeros((len(words), self.p["o"].shape[1] + 1), np.float32)
        pieces, owner = [], []
        for i, w in enumerate(words):
            for k in range(0, len(w), LONGEST):
                pieces.append(w[k : k + LONGEST])
                owner.append(i)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        for k in range(0, len(order), 2048):
            part = order[k : k + 2048]
            x, lens = matrix([pieces[i] for i in part])
            _, p = self.positions(x, lens)
            live = (np.arange(x.shape[1])[:, None] < lens)[:, :, None]
            np.add.at(out, [owner[i] for i in part], np.concatenate([(p * live).sum(0), lens[:, None].astype(np.float32)], 1))
        return out

    def gradients(self, x, lens, y) -> tuple[float, dict]:
        tapes = {"f": [], "b": []}
        h, p = self.positions(x, lens, tapes)
        T, n = x.shape[1], len(x)
        live = (np.arange(T)[:, None] < lens)[:, :, None]
        total = float(lens.sum())
        loss = -float((np.log(p[:, np.arange(n), y] + 1e-9) * live[:, :, 0]).sum()) / total
        ds = p.copy()
        ds[:, np.arange(n), y] -= 1
        ds = ds * live / total
        g = {"o": np.einsum("tnh,tnc->hc", h, ds), "ob": ds.sum((0, 1))}
        dh_all = ds @ self.p["o"].T
        for d, part in (("f", dh_all[:, :, :HIDDEN]), ("b", dh_all[:, :, HIDDEN:])):
            U = self.p[f"u{d}"]
            gx, gu, gc = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(U), np.zeros_like(self.p[f"c{d}"])
            dh = np.zeros((n, HIDDEN), np.float32)
            for t, on, before, z, r, m, un in reversed(tapes[d]):
                dh = dh + part[t]
                dn = np.where(on, dh, 0)
                dm = dn * (1 - z) * (1 - m * m)
                dz = dn * (before - m) * z * (1 - z)
                dr = dm * un * r * (1 - r)
                da = np.concatenate([dz, dr, dm], 1)
                du = np.concatenate([dz, dr, dm * r], 1)
                np.add.at(gx, x[:, t], da)
                gu += before.T @ du
                gc += (dm * r).sum(0)
                dh = np.where(on, dn * z, dh) + du @ U.T
            g |= {f"x{d}": gx, f"u{d}": gu, f"c{d}": gc}
        return loss, g


def train(words: list[bytes], labels: np.ndarray, n_labels: int, times: np.ndarray | None = None, steps: int = STEPS, seed: int = 7) -> Network:
    """``times``: how often each word occurs; it is drawn as often."""
    net, rng = Network(n_labels, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    times = np.ones(len(words)) if times is None else times
    by_label = [(b, np.cumsum(times[b])) for b in (np.flatnonzero(labels == c) for c in range(n_labels)) if len(b)]
    for s in range(steps):
        pick = np.concatenate([b[np.searchsorted(t, rng.random(max(1, BATCH // n_labels)) * t[-1], side="right")] for b, t in by_label])
        x, lens = matrix([words[i] for i in pick])
        _, g = net.gradients(x, lens, labels[pick])
        rate = RATE * min(1, (s + 1) / 20) * (1 - 0.9 * s / steps)
        for k, v in g.items():
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            net.p[k] -= (rate * (first[k] / (1 - 0.9 ** (s + 1))) / (np.sqrt(second[k] / (1 - 0.99 ** (s + 1))) + 1e-7)).astype(np.float32)
    return net


def held_out(parts: int, part: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def fit(docs: DataFrame, docs_a_language: int = DOCS_A_LANGUAGE) -> tuple[list[str], Network | None]:
    """Labels and network from the labelled rows outside the held-out fold.  Rows are picked by
    a hash of doc_id and text at a rate that gives about ``docs_a_language`` of each language."""
    one_thread(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "text").filter(~held_out(4, 2) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return [], None
    names = sorted(c["lang"] for c in counts)
    rate = F.create_map(*[F.lit(v) for c in counts for v in (c["lang"], min(1.0, docs_a_language / c["count"]))])
    luck = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.filter(luck < F.try_element_at(rate, F.col("lang")))

    def pick(batches):
        for batch in batches:
            got = Counter()
            for name, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = [w for w in text.split() if has_letter(w)]
                got.update((name, w[k : k + LONGEST]) for w in words for k in range(0, len(w), LONGEST))
            lang, out = zip(*got, strict=True) if got else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary()), pa.array(got.values(), pa.int64())], names=["lang", "word", "times"])

    sample = rows.select("lang", "text").mapInArrow(released(pick), "lang string, word binary, times long")
    sample = sample.groupBy("lang", "word").agg(F.sum("times").alias("times")).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    if not sample.num_rows:
        return [], None
    label = np.searchsorted(np.array(names, object), np.array(sample["lang"].to_pylist(), object))
    return names, train(sample["word"].to_pylist(), label, len(names), sample["times"].to_numpy())


class Reader:
    """Document probabilities from remembered word sums."""

    def __init__(self, net: Network):
        self.net, self.at, self.sums, self.used = net, {}, np.zeros((1024, net.p["o"].shape[1] + 1), np.float32), 0

    def read(self, texts: list[bytes]) -> np.ndarray:
        split = [t.split() for t in texts]
        new = {w for ws in split for w in ws}
        if len(self.at) + len(new) > min(CACHE_WORDS, CACHE_SUMS // (self.sums.shape[1] - 1)):
            self.at, self.used = {}, 0
        new = sorted(new.difference(self.at))
        if new:
            while self.used + len(new) > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
            self.sums[self.used : self.used + len(new)] = self.net.sums(new)
            self.at.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
        out, get = np.zeros((len(texts), self.sums.shape[1] - 1)), self.at.__getitem__
        for i, ws in enumerate(split):
            if ws:
                s = self.sums[np.fromiter(map(get, ws), np.int64, len(ws))].sum(0, dtype=np.float64)
                out[i] = s[:-1] / s[-1]
        return out


def predict(docs: DataFrame, names: list[str], net: Network | None, with_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (text only if asked for), lang_pred and score."""
    small_batches(docs.sparkSession, 500)
    extra = [c for c in docs.columns if with_text or c != "text"]
    schema = docs.select(*extra, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    order = docs.columns

    def run(batches):
        reader = Reader(net) if net else None
        for batch in batches:
            texts = utf8(batch.column(order.index("text")))
            lang, score = [UND] * len(texts), np.zeros(len(texts))
            i = 0
            while reader and i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= WINDOW):
                    size += len(texts[j])
                    j += 1
                p = reader.read(texts[i:j])
                for k in range(i, j):
                    if has_letter(texts[k]):
                        best = int(p[k - i].argmax())
                        lang[k], score[k] = names[best], min(1.0, float(p[k - i][best]))
                i = j
            keep = [batch.column(order.index(c)) for c in extra]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(lang, pa.string()), pa.array(score)], names=[*extra, "lang_pred", "score"])

    return docs.mapInArrow(released(run), schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    names, net = fit(docs)
    return predict(docs.select("doc_id", held_out(4, 2).alias("held_out"), "text"), names, net)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score")
