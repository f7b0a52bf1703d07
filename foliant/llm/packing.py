"""Hierarchical multi-length packing.

Documents are routed by length to context-size tiers; each tier's windows are opened by its
own documents and their gaps filled from the shorter tiers, best fit first and by a cut last,
so that windows are exactly full.  What a partition has left over is cut into powers of two,
which need no padding.  No shuffle: each partition of the scan packs its own documents, within
a bounded pool.  Null text: empty, so the end id alone.  Null doc_id and repeated rows: packed
as documents of their own.  Very long texts: whole windows first.  Empty table: empty result."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, small_batches, utf8

TIERS = (2048, 1024, 512, 256)
END_ID = 1
POOL_TOKENS = 1 << 20  # ids that wait in a task for a window
CACHE_WORDS = 1 << 20  # words whose ids a worker keeps
WINDOW = 1 << 22  # bytes of text read at a time
OUT_ROWS = 1000  # pieces, of up to 8 KB, that a task hands on at a time
STEP = 8  # sequences to a step group
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, context int, step_group long"


class Words:
    """Ids of texts by an installed tokenizer of lower-case word BPE.  Its pre-tokens never span
    white space, so ids of white-space-separated words joined are the ids of the text.  Texts are
    split and their words numbered in Arrow; only distinct words reach the tokenizer, and the ids
    of up to ``cache`` of them, those used last, are kept in flat arrays."""

    def __init__(self, path: str | None = None, cache: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.cache, self.round = cache, 0
        self._clear()

    def _clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids, self.n_ids = np.zeros(1 << 12, "<u4"), 0
        self.start, self.size, self.used = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        at, n = len(self.index), len(words)
        while at + n > len(self.start):
            self.start, self.size, self.used = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.used))
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.start[at : at + n] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[at : at + n], self.used[at : at + n] = sizes, self.round
        self.n_ids += len(ids)
        self.index.update(zip(words, range(at, at + n), strict=True))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, joined, and how many each has."""
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[at] - ends + sizes, sizes) + np.arange(total)], sizes

    def _forget(self) -> None:
        """Keep the half of the words that were used last."""
        words = list(self.index)
        stay = np.sort(np.argsort(-self.used[: len(words)], kind="stable")[: self.cache // 2])
        ids, sizes = self._gather(stay)
        used = self.used[stay]
        self._clear()
        self._add([words[i] for i in stay.tolist()], ids, sizes)
        self.used[: len(stay)] = used

    def _learn(self, new: list[bytes]) -> None:
        plain, dotted, other = [], [], []
        for w in new:
            core = w[:-1] if w[-1:] in (b".", b",") else w
            if core.decode().isalpha():
                (plain if core is w else dotted).append(w)
            else:
                other.append(w)
        index = self.index
        have = set(plain)
        plain += {w[:-1] for w in dotted if w[:-1] not in index and w[:-1] not in have}
        other += [w for w in (b".", b",") if w not in index and w not in other]
        for i in range(0, len(plain), 1024):
            part = plain[i : i + 1024]
            enc = self.tok.encode(b" ".join(part).decode(), add_special_tokens=False)
            word = np.array(enc.word_ids, np.int64)
            if word[-1] != len(part) - 1:  # a letter that the pre-tokenizer splits or drops
                other += part
            else:
                self._add(part, np.array(enc.ids, "<u4"), np.bincount(word, minlength=len(part)))
        for i in range(0, len(other), 1024):
            part = other[i : i + 1024]
            ids = [e.ids for e in self.tok.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)]
            self._add(part, np.array([x for e in ids for x in e], "<u4"), np.array([len(e) for e in ids], np.int64))
        if dotted:
            pairs = np.array([(index[w[:-1]], index[w[-1:]]) for w in dotted], np.int64)
            ids, sizes = self._gather(pairs.ravel())
            self._add(dotted, ids, sizes.reshape(-1, 2).sum(1))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        self.round += 1
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_pylist()
        if len(self.index) + len(words) > self.cache:
            self._forget()
        get = self.index.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        late = np.flatnonzero(at < 0)
        if len(late):
            self._learn([words[i] for i in late.tolist()])
            at[late] = [self.index[words[i]] for i in late.tolist()]
        self.used[at] = self.round
        ids, sizes = self._gather(at[coded.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(sizes)])[lists.offsets.to_numpy()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]

    def tok_ids(self, text: str) -> bytes:
        """Ids of one text, the end id after them, by the tokenizer alone."""
        return np.array([*self.tok.encode(text, add_special_tokens=False).ids, END_ID], "<u4").tobytes()


_words: dict[tuple, Words] = {}


def words_of(path: str | None, cache: int) -> Words:
    """The worker's words: a worker is used for task after task, and what it knows stays with it."""
    if (path, cache) not in _words:
        _words.clear()
        _words[path, cache] = Words(path, cache)
    return _words[path, cache]


class Pool:
    """Pieces (doc_id, start, ids, doc_tokens) that wait, by length, and the windows made."""

    def __init__(self, first_id: int):
        self.lens: list[int] = []
        self.pieces: list[tuple] = []
        self.tokens, self.next, self.groups, self.out = 0, first_id, first_id, []

    def add(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        i = bisect_right(self.lens, n)
        self.lens.insert(i, n)
        self.pieces.insert(i, piece)
        self.tokens += n

    def pop(self, i: int) -> tuple:
        self.tokens -= self.lens.pop(i)
        return self.pieces.pop(i)

    def cut(self, piece: tuple, n: int) -> tuple:
        """The first n ids; the rest goes back."""
        self.add((piece[0], piece[1] + n, piece[2][4 * n :], piece[3]))
        return piece[0], piece[1], piece[2][: 4 * n], piece[3]

    def window(self, size: int, top: int) -> list[tuple]:
        """A full window: the longest piece of at most ``top`` opens it, shorter ones fill it."""
        room, made = size, []
        while room:
            i = bisect_right(self.lens, min(room, top)) - 1
            if i >= 0 and (self.lens[i] * 8 >= room or i == len(self.lens) - 1 or self.lens[i] == room):
                piece = self.pop(i)
            else:  # what fits is short against the gap, or nothing fits: cut the next longer one
                piece = self.cut(self.pop(bisect_left(self.lens, room + 1) if self.lens[-1] > room else len(self.lens) - 1), room) if self.lens[-1] > room else self.pop(i)
            made.append(piece)
            room -= len(piece[2]) // 4
        return made

    def flush(self, final: bool) -> None:
        for t, size in enumerate(TIERS):
            made = []
            low = TIERS[t + 1] if t + 1 < len(TIERS) else 0
            while self.lens and self.lens[-1] > low and self.tokens >= size:
                made.append(self.window(size, size))
            self.steps(made, size)
        if final and self.tokens:
            rest = self.tokens
            for bit in reversed(range(rest.bit_length())):
                if rest >> bit & 1:
                    made, room = [], 1 << bit
                    while room:
                        piece = self.pop(len(self.lens) - 1)
                        piece = self.cut(piece, room) if len(piece[2]) > 4 * room else piece
                        made.append(piece)
                        room -= len(piece[2]) // 4
                    self.steps([made], 1 << bit)

    def steps(self, made: list[list[tuple]], size: int) -> None:
        """Number the windows and deal them to step groups of like attention cost, in snake order."""
        if not made:
            return
        cost = [sum((len(p[2]) // 4) ** 2 for p in w) for w in made]
        groups = -(-len(made) // STEP)
        for k, i in enumerate(sorted(range(len(made)), key=lambda i: -cost[i])):
            row, at = divmod(k, groups)
            group = self.groups + (at if row % 2 == 0 else groups - 1 - at)
            offset = 0
            for d, start, ids, total in made[i]:
                n = len(ids) // 4
                self.out.append((d, start, n, ids, total, self.next, offset, size, group))
                offset += n
            self.next += 1
        self.groups += groups

    def take(self):
        rows, self.out = self.out, []
        for i in range(0, len(rows), OUT_ROWS):
            part = list(zip(*rows[i : i + OUT_ROWS], strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def pack(docs: DataFrame, path: str | None = None, cache: int = CACHE_WORDS, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit), place, context
    size and step group.  ``path``: a tokenizer file that all executors can open; ``cache`` words and
    ``window`` bytes bound a worker's memory."""
    small_batches(docs.sparkSession)
    top = TIERS[0]

    def run(batches):
        from pyspark import TaskContext

        words, pool = words_of(path, cache), Pool(TaskContext.get().partitionId() << 40)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = utf8(batch.column(1))
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= window):
                    size += len(texts[j])
                    j += 1
                for d, raw in zip(ids[i:j], words.encode(texts[i:j]), strict=True):
                    raw += end
                    n = len(raw) // 4
                    full = n // top * top
                    pool.steps([[(d, k, raw[4 * k : 4 * (k + top)], n)] for k in range(0, full, top)], top)
                    if full < n:
                        pool.add((d, full, raw[4 * full :], n))
                    if pool.tokens > POOL_TOKENS:
                        pool.flush(False)
                    if len(pool.out) > OUT_ROWS:
                        yield from pool.take()
                i = j
        pool.flush(True)
        yield from pool.take()

    return docs.select("doc_id", "text").mapInArrow(released(run), SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group"
    )
