"""Exact repeated-substring removal over a sparse, range-partitioned suffix array.

Every byte covered by a string of ``length`` bytes that starts anywhere else too is removed; with
``first_stays`` one occurrence of each string, that of the document whose hash is smallest, stays.
A window (such a string) is represented by an anchor, the smallest hashed k-gram among the first
half of its starts, so equal windows have equal anchors at equal offsets and only suffixes that
begin at anchors are sorted.  Consecutive windows of one anchor travel as one run.

1. Suffix leads (the bytes after an anchor that all its windows share) are counted over all
   documents; windows whose lead is unique are unique, and drop out.
2. Runs with equal bytes are one kind: they are added up before anything is sorted.
3. A kind goes once to the sort, with its bytes.  Sampled splitters range-partition the suffixes by
   leading bytes; each bucket sorts them by multikey quicksort on 8-byte tokens, forwards from the
   anchor and backwards from it, and takes the common prefix of every two sorted neighbours.  A
   window that begins o bytes before its anchor is repeated if and only if some other run shares
   the o bytes before and length - o after the anchor, that is, lies in the same stretch of both
   orders without a neighbour's common prefix below o or length - o.
4. Leads of more than CROWD differing runs (a passage that very many documents hold) are cut into
   windows, of which those stay that share all but FINE - 1 bytes with another run; they are range-sorted so that equal windows may span several tasks, compared with
   their sorted neighbours, and across the boundaries by the first and last window of each task.
5. Repeated windows meet their documents, and the bytes they cover go.

Null text: empty.  Texts shorter than a window: kept.  Null doc_id and repeated rows: documents of
their own (repeated rows of a window or more remove each other whole; with ``first_stays`` rows
alike in doc_id and text are one occurrence).  Very long texts: in overlapping segments, so windows
are never lost.  Ties: none, an occurrence is (document, start).  Empty table: empty result."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODES, SEGMENT, Packed, bit_table, held_in, in_table, mix, partitions, powers, released, small_batches, store, tidy, utf8

LENGTH = 400  # op8's contract
PASSAGE, PASSAGE_WORDS = 240, 50  # a passage: repeated strings of so many bytes that make up so many words
GRAM = 24
CROWD = 512  # differing runs of one lead that are sorted in one task
FINE = 16  # starts to a stretch of a crowded lead
PART = 1 << 21  # bytes of runs sorted at a time
SLOTS = 1 << 20


@dataclass(frozen=True)
class Shape:
    """Windows of ``base`` bytes have the anchors; runs carry what windows of ``top`` need."""

    base: int
    top: int

    @property
    def reach(self) -> int:
        return self.base // 2

    @property
    def lead(self) -> int:
        return self.base - self.reach + 1


def _hash(total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((total[b] - total[a]) * powers()[SEGMENT - a])


def _sums(data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    codes = BYTE_CODES.take(data)
    codes *= powers()[: len(data)]
    np.cumsum(codes, out=total[1:])
    return total


def _mixed(x: np.ndarray) -> np.ndarray:
    """``mix`` in place."""
    y = x >> np.uint64(30)
    x ^= y
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=y)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=y)
    return x


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, by those of 2, 4, 8, ..., in place."""
    k, n = 1, len(x)
    while 2 * k <= width:
        np.minimum(x[: n - k], x[k:n], out=x[: n - k])
        n, k = n - k, 2 * k
    if k < width:
        np.minimum(x[: n - width + k], x[width - k : n], out=x[: n - width + k])
        n -= width - k
    return x[:n]


_PLACES = np.arange(SEGMENT, dtype=np.uint64)


def segments(texts: list[bytes], shape: Shape):
    """(buffer, [(text number, offset in text, offset in buffer, length, starts)]): whole texts
    together, long ones in pieces that overlap, so that each start has all its bytes."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(len(t) - shape.base + 1, 0), SEGMENT - shape.top + 1):
            n = min(SEGMENT, len(t) - a)
            last = a + n == len(t)
            if size + n > SEGMENT:
                yield np.frombuffer(b"".join(texts[k][b : b + m] for k, b, _, m, _ in held), np.uint8), held
                held, size = [], 0
            held.append((i, a, size, n, n - (shape.base if last else shape.top) + 1))
            size += n
            if last:
                break
    if held:
        yield np.frombuffer(b"".join(texts[k][b : b + m] for k, b, _, m, _ in held), np.uint8), held


def runs(texts: list[bytes], shape: Shape):
    """Per segment: arrays (text number, start, starts, bytes, anchor - start, lead hash, content
    hash), the segment's buffer and the runs' places in it."""
    for data, held in segments(texts, shape):
        n, reach = len(data), shape.reach
        total = _sums(data)
        grams = n - GRAM + 1
        g = _mixed((total[GRAM:] - total[:grams]) * powers()[SEGMENT - grams + 1 : SEGMENT + 1][::-1])
        g &= ~np.uint64(SEGMENT - 1)
        g |= _PLACES[:grams]
        room = n - shape.base + reach
        if grams < room:
            g = np.concatenate([g, np.full(room - grams, np.uint64(2**64 - 1))])
        least = _least(g, reach)  # no two are equal but by having one anchor
        of = np.array([(h[2], h[2] + h[4]) for h in held])
        # adjacent texts in the buffer never give consecutive starts: base - 1 lie between
        new = least[1:] != least[:-1]
        new[of[1:, 0] - 1] = True
        s = np.concatenate([[0], np.flatnonzero(new) + 1])
        which = np.searchsorted(of[:, 0], s, side="right") - 1
        c = np.minimum(np.append(s[1:], n), of[which, 1]) - s
        s, c, which = (x[c > 0] for x in (s, c, which))
        a = (least[s] & np.uint64(SEGMENT - 1)).astype(np.int64)
        place = np.array([(h[0], h[1] - h[2], h[2] + h[3]) for h in held])[which]
        size = np.minimum(c - 1 + shape.top, place[:, 2] - s)
        lead = _hash(total, a, a + shape.lead)
        content = mix(_hash(total, s, s + size) + (c + (size << 20)).astype(np.uint64))
        yield place[:, 0], s + place[:, 1], c, size, a - s, lead, content, data, s


def _long(x) -> pa.Array:
    return pa.array(np.asarray(x).view(np.int64) if np.asarray(x).dtype == np.uint64 else np.asarray(x, np.int64))


def multikey_order(tokens: np.ndarray) -> np.ndarray:
    """Order of the rows of ``tokens`` by multikey quicksort: three ways on one token, the equal
    part goes on to the next token."""
    out, width = [], tokens.shape[1]
    stack = [(np.arange(len(tokens)), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 2 or depth == width:
            out.append(rows)
        elif len(rows) <= 32:
            out.append(rows[np.lexsort(tokens[rows, depth:].T[::-1])])
        else:
            t = tokens[rows, depth]
            pivot = np.partition(t, len(t) // 2)[len(t) // 2]
            stack.append((rows[t > pivot], depth))
            stack.append((rows[t == pivot], depth + 1))
            stack.append((rows[t < pivot], depth))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


_BYTES = np.array([1 << k for k in range(56, -8, -8)], np.uint64)


def sorted_neighbours(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings' order, and how many bytes each has in common with the one before it (0 for
    the first).  A string sorts before those that it begins."""
    lens = np.array([len(x) for x in strings])
    width = max(1, -(-int(lens.max()) // 8))
    raw = np.frombuffer(b"".join(x.ljust(width * 8, b"\0") for x in strings), ">u8").reshape(len(strings), width)
    tokens = np.concatenate([raw.astype(np.uint64), lens[:, None].astype(np.uint64)], 1)
    order = multikey_order(tokens)
    x = tokens[order[1:], :-1] ^ tokens[order[:-1], :-1]
    at = (x != 0).argmax(1)
    x = x[np.arange(len(x)), at]
    same = np.where(x == 0, 8 * width, 8 * at + (x[:, None] < _BYTES).sum(1))
    return order, np.concatenate([[0], np.minimum(same, np.minimum(lens[order[1:]], lens[order[:-1]]))])


def bucket_repeats(raw: list[bytes], off: np.ndarray, starts: np.ndarray, rank: np.ndarray, length: int):
    """(run, window from, to, first): stretches of windows that occur in two runs of the bucket.
    Runs are bytes with the anchor's offset and how many windows begin in them; ``first`` tells those
    windows whose run has the smallest rank of all that hold them."""
    ahead, forwards = sorted_neighbours([r[o:] for r, o in zip(raw, off.tolist(), strict=True)])
    back, backwards = sorted_neighbours([r[:o][::-1] for r, o in zip(raw, off.tolist(), strict=True)])
    n, after = len(raw), np.array([len(r) for r in raw]) - off
    low, found = off - starts + 1, []
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(low.min()), int(off.max()) + 1):
        rows = np.flatnonzero((low <= o) & (o <= off) & (after >= length - o))
        if len(rows) < 2:
            continue
        right[ahead] = np.cumsum(forwards < length - o)
        left[back] = np.cumsum(backwards < o)
        key = right[rows] * (n + 1) + left[rows]
        order = np.lexsort((rank[rows], key))
        rows, key = rows[order], key[order]
        same = key[1:] == key[:-1]
        later = np.concatenate([[False], same])
        twice = later | np.concatenate([same, [False]])
        if twice.any():
            found.append(np.stack([rows[twice], off[rows[twice]] - o, ~later[twice]], 1))
    if not found:
        return np.zeros((0, 4), np.int64)
    found = np.concatenate(found)
    return stretches(found[:, 0], found[:, 1], found[:, 2])


def stretches(owner: np.ndarray, at: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """(owner, from, to, flag) of maximal consecutive ``at`` with equal owner and flag."""
    order = np.lexsort((at, flag, owner))
    owner, at, flag = owner[order], at[order], flag[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (flag[1:] != flag[:-1]) | (at[1:] != at[:-1] + 1)])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(at)) - 1
    return np.stack([owner[a], at[a], at[b] + 1, flag[a]], 1)


ROW = "front binary, lead long, dh long, th long, k long, starts long, off long, parts int, bytes binary"
FOUND = "dh long, th long, w int, `from` long, `to` long"


def repeated_starts(docs: DataFrame, lengths: tuple[int, ...], first_stays: bool = False) -> DataFrame:
    """(dh, th, w, from, to): ranges of starts of repeated windows of w bytes, for each of ``lengths``
    (a start that a range of a greater w holds may be told there alone), in the rows of ``docs`` (dh, th, text), dh a hash of the document below 2^62 and th of its text.  An
    occurrence is k = dh + start: documents in order of dh, and starts in order within one."""
    spark, shape = docs.sparkSession, Shape(min(lengths), max(lengths))
    d = docs.filter(F.octet_length("text") >= shape.base).select("dh", "th", "text")

    def leads(batches):
        for batch in batches:
            for *_, lead, _, _, _ in runs(utf8(batch.column(0)), shape):
                h, n = np.unique(lead, return_counts=True)
                yield pa.RecordBatch.from_arrays([_long(h), _long(n)], names=["lead", "n"])

    counts = d.select("text").mapInArrow(released(leads), "lead long, n long").groupBy("lead").agg(F.sum("n").alias("n"))
    table = bit_table(counts.filter("n > 1").select("lead"))
    tidy(spark)

    def emit(batches):
        for batch in batches:
            dh, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for text, at, c, size, _, lead, content, _, _ in runs(utf8(batch.column(2)), shape):
                k = np.flatnonzero(in_table(table, lead.view(np.int64)))
                if len(k):
                    t = text[k]
                    cols = [_long(x) for x in (dh[t], th[t], dh[t] + at[k], c[k], size[k], lead[k], content[k])]
                    yield pa.RecordBatch.from_arrays(cols, names=["dh", "th", "k", "c", "size", "lead", "content"])

    places = store(d.mapInArrow(released(emit), "dh long, th long, k long, c long, size long, lead long, content long"), "suf-runs")
    tidy(spark)
    kinds = places.groupBy("lead", "content").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first"))
    kinds = store(kinds, "suf-kinds")
    tidy(spark)
    crowd = kinds.groupBy("lead").agg(F.count(F.lit(1)).alias("v"), F.min("n").alias("least")).filter("v > 1" if first_stays else "v > 1 and least = 1")
    crowd = store(crowd.select("lead", "v"), "suf-crowds")

    crowds = bit_table(crowd.select("lead"))
    wanted = bit_table(kinds.filter(held_in(crowds)("lead")).select("first"))
    split = np.zeros(SLOTS, np.int32)  # parts of about CROWD runs that a crowded lead is cut into
    big = crowd.filter(F.col("v") > CROWD).groupBy(F.pmod("lead", F.lit(SLOTS)).alias("slot")).agg(F.max(F.ceil(F.col("v") / CROWD)).alias("parts")).toArrow()
    split[big["slot"].to_numpy()] = big["parts"].to_numpy()
    split = Packed(split)

    def suffixes(batches):
        names = [f.split()[0] for f in ROW.split(", ")]
        for batch in batches:
            dh, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for text, at, c, size, off, lead, _, data, s in runs(utf8(batch.column(2)), shape):
                k = np.flatnonzero(in_table(crowds, lead.view(np.int64)))
                k = k[in_table(wanted, dh[text[k]] + at[k])]
                if not len(k):
                    continue
                whole_ = data.tobytes()
                raw = [whole_[a : a + n] for a, n in zip(s[k].tolist(), size[k].tolist(), strict=True)]
                front = [r[o : o + 16] for r, o in zip(raw, off[k].tolist(), strict=True)]
                t, parts = text[k], split.array[(lead[k] & np.uint64(SLOTS - 1)).astype(np.int64)]
                cols = [pa.array(front, pa.binary()), *[_long(x) for x in (lead[k], dh[t], th[t], dh[t] + at[k], c[k], off[k])], pa.array(parts), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    # written first: sampling the splitters would run the texts through Python once more
    rows = store(d.mapInArrow(released(suffixes), ROW), "suf-suffixes")
    tidy(spark)
    calm = rows.filter("parts = 0").drop("parts").repartitionByRange(partitions(spark), "front", "lead").sortWithinPartitions("front", "lead")

    def found_batch(rows_: list[np.ndarray]):
        cols = np.concatenate(rows_).T
        kinds_ = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x).cast(k) for x, k in zip(cols, kinds_, strict=True)], names=["dh", "th", "w", "from", "to"])

    def sort(batches):
        now, held, size = None, [], 0

        def done():
            part = list({(r[0], r[3]): r for r in held}.values())  # rows of one place are one
            if len(part) < 2:
                return
            dh, th, s, starts, off = (np.array([r[j] for r in part], np.int64) for j in range(1, 6))
            rank, s = s, s - dh
            for w in lengths:
                got = bucket_repeats([r[6] for r in part], off, starts, rank, w)
                got = got[got[:, 3] == 0] if first_stays else got
                if len(got):
                    k = got[:, 0]
                    yield found_batch([np.stack([dh[k], th[k], np.full(len(k), w), s[k] + got[:, 1], s[k] + got[:, 2]], 1)])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for i in range(batch.num_rows):
                key = cols[0][i], cols[1][i]
                if key != now and size > PART:  # a bucket is sorted in parts that end between leads
                    yield from done()
                    held, size = [], 0
                now = key
                held.append(tuple(c[i] for c in cols[1:]))
                size += len(cols[7][i])
        yield from done()

    parts = [calm.mapInArrow(released(sort), FOUND)]
    if big.num_rows:
        parts.append(crowded_windows(rows.filter("parts > 0"), lengths, first_stays))
    # all occurrences of a kind that comes again are repeats, but for the first if that one stays
    again = kinds.filter("n > 1").select(F.col("lead").alias("_l"), F.col("content").alias("_c"), "first")
    some = held_in(bit_table(again.select("_c")))
    whole = places.filter(some("content")).join(again, (F.col("lead") == F.col("_l")) & (F.col("content") == F.col("_c")))
    if first_stays:
        whole = whole.filter("k <> first")
    whole = whole.withColumn("s", F.col("k") - F.col("dh"))
    # a start that repeats for w bytes repeats for fewer: those are told for the starts left only
    told = F.col("s")
    for w in sorted(lengths, reverse=True):
        until = F.greatest(told, F.col("s") + F.least("c", F.col("size") - (w - 1)))
        parts.append(whole.select("dh", "th", F.lit(w).alias("w"), told.alias("from"), until.alias("to")).filter("`from` < `to`"))
        told = until
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = store(out, "suf-starts")
    tidy(spark)
    return out


def crowded_windows(rows: DataFrame, lengths: tuple[int, ...], first_stays: bool) -> DataFrame:
    """Repeated windows of the runs in ``rows`` one by one: range-sorted by (lead, length, hash) and
    then by occurrence, so that a window of many documents spans tasks; compared with the
    neighbours in the order, and with the window before and after at a task's boundaries, of which
    two a task reach the driver."""
    spark = rows.sparkSession
    order = ["lead", "w", "h", "dh", "at", "th"]
    wide = "lead long, w int, h long, dh long, at long, th long"

    def stretches_of(raw: list[bytes], off: np.ndarray, starts: np.ndarray):
        """Per length, for some runs at a time: the runs' hash sums, and of each window its run, its
        start in the run and in the sums, and the hash of what all windows that begin within the same
        FINE bytes before the anchor have in common."""
        size = np.array([len(r) for r in raw])
        i = 0
        while i < len(raw):
            j, n = i + 1, int(size[i])
            while j < len(raw) and n + size[j] <= SEGMENT:
                n, j = n + int(size[j]), j + 1
            total = _sums(np.frombuffer(b"".join(raw[i:j]), np.uint8))
            at = np.cumsum(size[i:j]) - size[i:j]
            for w in lengths:
                n = np.maximum(np.minimum(starts[i:j], size[i:j] - w + 1), 0)
                if n.any():
                    own = np.repeat(np.arange(j - i), n)
                    a = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                    near = (off[i:j][own] - a) // FINE * FINE
                    b = at[own] + off[i:j][own] - near
                    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (near[1:] != near[:-1])]))
                    core = _hash(total, b[new], b[new] + w - FINE + 1) + (near[new] + w).astype(np.uint64)
                    yield w, total, i + own, a, at[own] + a, core.view(np.int64), np.diff(np.append(new, len(own)))
            i = j

    def cores(batches):
        for batch in batches:
            off, starts = batch.column(6).to_numpy(), batch.column(5).to_numpy()
            out = [x[5] for x in stretches_of(batch.column(8).to_pylist(), off, starts)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], names=["core"])

    # windows of a stretch that no other run shares are unique: they are left out before the sort
    shared = rows.mapInArrow(released(cores), "core long").groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = bit_table(shared.select("core"))

    def windows(batches):
        """Of equal windows of a batch only the first goes on; the others are repeats, told as ranges."""
        for batch in batches:
            lead, dh, th, k, starts, off = (batch.column(j).to_numpy() for j in (1, 2, 3, 4, 5, 6))
            out = []
            for w, total, own, a, at, core, many in stretches_of(batch.column(8).to_pylist(), off, starts):
                some = np.repeat(in_table(shared, core), many)
                if some.any():
                    own, a, at = own[some], a[some], at[some]
                    out.append(np.stack([own, np.full(len(a), w), _hash(total, at, at + w).view(np.int64), a]))
            if not out:
                continue
            row, w, h, a = np.concatenate(out, 1)
            order = np.lexsort((k[row] + a, h, w, lead[row]))
            row, w, h, a = row[order], w[order], h[order], a[order]
            same = (lead[row[1:]] == lead[row[:-1]]) & (w[1:] == w[:-1]) & (h[1:] == h[:-1])
            again, many = np.concatenate([[False], same]), np.concatenate([same, [False]])
            one = np.flatnonzero(~again)
            more = stretches(row[again] * len(lengths) + np.searchsorted(up, w[again]), a[again], w[again]) if again.any() else np.zeros((0, 4), np.int64)
            r = more[:, 0] // len(lengths)
            i = np.concatenate([row[one], r])
            start = k[i] - dh[i]
            cols = [lead[i], np.concatenate([w[one], more[:, 3]]), None, dh[i], start + np.concatenate([a[one], more[:, 1]]), th[i], None, start + np.concatenate([a[one] + 1, more[:, 2]])]
            cols[2] = pa.array(np.concatenate([h[one], np.zeros(len(r), np.int64)]), mask=np.arange(len(i)) >= len(one))
            cols[6] = np.concatenate([many[one], np.ones(len(r), bool)])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(t) for c, t in zip(cols, kinds, strict=True)], names=[*order_, "many", "to"])

    up, order_ = np.sort(lengths), order
    # the runs of a part of a lead come one after the other
    dealt = rows.repartition(partitions(spark), "lead", F.pmod("k", "parts")).sortWithinPartitions("lead")
    dealt = store(dealt.mapInArrow(released(windows), wide + ", many boolean, to long"), "suf-windows")
    local = dealt.filter("h is null").select("dh", "th", "w", F.col("at").alias("from"), "to")
    dealt = dealt.filter("h is not null").drop("to").repartitionByRange(partitions(spark), *order[:5]).sortWithinPartitions(*order[:5])

    def compare(batches):
        from pyspark import TaskContext

        pid, before, held = TaskContext.get().partitionId(), None, None

        def tell(cols, before, after, edge):
            """Rows between ``before`` and ``after``: same key as the row before; as the row after, or as one
            that its batch left out."""
            all_ = np.concatenate([x for x in (before, cols, after) if x is not None], 1)
            same = (all_[:3, 1:] == all_[:3, :-1]).all(0)
            lo, n = int(before is not None), cols.shape[1]
            prev = np.concatenate([[False], same])[lo : lo + n]
            next_ = np.concatenate([same, [False]])[lo : lo + n]
            names = [*order, "prev", "next", "edge", "pid"]
            arrays = [pa.array(c).cast(pa.int32()) if k == "w" else pa.array(c) for c, k in zip(cols[:6], order, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(prev), pa.array(next_ | (cols[6] > 0)), pa.array(edge), pa.array(np.full(n, pid, np.int32))], names=names)

        # one batch waits for the next, so that each row sees its neighbours
        for batch in batches:
            cols = np.stack([batch.column(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in range(7)])
            tail = held[:, -1:] if held is not None else None
            ends = np.concatenate([tail, cols], 1) if tail is not None else cols
            keep = np.concatenate([[True], (ends[:5, 1:] != ends[:5, :-1]).any(0)])[int(tail is not None) :]  # a place twice is one
            cols = cols[:, keep]
            if not cols.shape[1]:
                continue
            if held is not None:
                edge = np.zeros(held.shape[1], np.int32)
                edge[0] += before is None
                yield tell(held, before, cols[:, :1], edge)
                before = held[:, -1:]
            held = cols
        if held is not None:
            edge = np.zeros(held.shape[1], np.int32)
            edge[0] += before is None
            edge[-1] += 2
            yield tell(held, before, None, edge)

    told = store(dealt.mapInArrow(released(compare), wide + ", prev boolean, next boolean, edge int, pid int"), "suf-told")
    ends = sorted((r for r in told.filter("edge > 0").collect()), key=lambda r: (r.pid, r.edge != 1))
    settled, key = [], lambda r: (r.lead, r.w, r.h)
    for i, r in enumerate(ends):
        prev = r.prev or (r.edge in (1, 3) and i > 0 and key(ends[i - 1]) == key(r))
        next_ = r.next or (r.edge in (2, 3) and i + 1 < len(ends) and key(ends[i + 1]) == key(r))
        settled.append((r.dh, r.th, r.w, r.at, prev, next_))
    rest = told.filter("edge = 0").select("dh", "th", "w", "at", "prev", "next")
    all_ = rest.unionByName(spark.createDataFrame(settled, "dh long, th long, w int, at long, prev boolean, next boolean"))
    all_ = all_.filter("prev" if first_stays else "prev or next").select("dh", "th", "w", F.col("at").alias("from"), (F.col("at") + 1).alias("to"))
    return local.unionByName(all_)


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, as_text: bool = False, length: int = LENGTH, least_words: int = 0, first_stays: bool = False, passages: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, passage_bytes, kept (bytes left, joined)
    and the columns named in ``keep``, which must not clash with these.  ``as_text``: ``kept`` as text, what
    is left of a letter that a cut went through gone too.  ``least_words``: runs of repeated strings
    with fewer words stay.  ``passages``: passage_bytes counts the bytes of repeated passages (strings of
    PASSAGE bytes, in runs of PASSAGE_WORDS words or more), which this does not remove; else null."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    keep = keep or []
    lengths = tuple(dict.fromkeys((length, PASSAGE) if passages else (length,)))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("th"), *keep)
    d = d.withColumn("dh", F.shiftrightunsigned(F.xxhash64(F.col("doc_id").isNull(), "doc_id", "th"), 2))
    found = repeated_starts(d.select("dh", "th", "text"), lengths, first_stays)
    # a range as one long: from, how many starts (fewer than a segment has), which length
    which = F.array_position(F.array(*[F.lit(w) for w in lengths]), F.col("w")) - 1
    code = F.shiftleft("from", 32).bitwiseOR(F.shiftleft(F.col("to") - F.col("from"), 8)).bitwiseOR(which)
    per = found.groupBy("dh", "th").agg(F.collect_set(code).alias("ranges"))
    per = store(per.select(F.col("dh").alias("_d"), F.col("th").alias("_t"), "ranges"), "suf-ranges")
    table = bit_table(per.select(F.xxhash64("_d", "_t").alias("h")))
    tidy(spark)
    order = ["doc_id", "text", "ranges", *keep]
    nothing = F.lit(0).cast("long")

    # documents that no range can touch stay where they are
    marked = d.withColumn("_hit", held_in(table)(F.xxhash64("dh", "th")))
    free = marked.filter(~F.col("_hit")).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), nothing.alias("n_removed"), nothing.alias("n_spans"), (nothing if passages else F.lit(None).cast("long")).alias("passage_bytes"), (F.col("text") if as_text else F.encode("text", "UTF-8")).alias("kept"), *keep
    )
    # a merge join ends the stage of the mark, so that a task never holds two Python workers
    hit = marked.filter("_hit").join(per.hint("merge"), (F.col("dh") == F.col("_d")) & (F.col("th") == F.col("_t")), "left").select(*order)
    schema = free.schema

    def merged(texts: list[bytes], row: np.ndarray, code: np.ndarray, w: int, words: int) -> list[list[tuple[int, int]]]:
        """Per text the bytes that its windows of w bytes cover, runs of fewer words left out."""
        out = [[] for _ in texts]
        some = np.array(lengths)[code & 255] >= w
        row, code = row[some], code[some]
        if len(row):
            first = (row << 32) + (code >> 32)
            order = np.argsort(first)
            first, until = first[order], (first + (code >> 8 & (1 << 24) - 1) - 1 + w)[order]
            until = np.maximum.accumulate(until)
            # texts begin more than a text apart, so that none reaches into the next
            new = np.flatnonzero(np.concatenate([[True], first[1:] > until[:-1]]))
            a, b = first[new], until[np.append(new[1:], len(first)) - 1]
            r = a >> 32
            for k, x, y in zip(r.tolist(), (a - (r << 32)).tolist(), (b - (r << 32)).tolist(), strict=True):
                if not words or len(texts[k][x:y].split()) >= words:
                    out[k].append((x, y))
        return out

    def cut(batches):
        for batch in batches:
            n, removed, spans, passage, kept = [], [], [], [], []
            texts, ranges = utf8(batch.column(1)), batch.column(2)
            row = np.repeat(np.arange(len(texts)), ranges.value_lengths().fill_null(0).to_numpy())
            code = ranges.flatten().to_numpy()
            covered = merged(texts, row, code, length, least_words)
            whole = merged(texts, row, code, PASSAGE, PASSAGE_WORDS) if passages else None
            for i, (t, gone) in enumerate(zip(texts, covered, strict=True)):
                out, at = [], 0
                for a, b in gone:
                    out.append(t[at:a])
                    at = b
                out.append(t[at:])
                n.append(len(t))
                removed.append(sum(b - a for a, b in gone))
                spans.append(len(gone))
                passage.append(sum(b - a for a, b in whole[i]) if passages else None)
                rest = b"".join(out)
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
            cols = [batch.column(0), _long(n), _long(removed), _long(spans), pa.array(passage, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary()), *[batch.column(order.index(c)) for c in keep]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "passage_bytes", "kept", *keep])

    return free.unionByName(hit.mapInArrow(released(cut), schema))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), passages=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "passage_bytes")
