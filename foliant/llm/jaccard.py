"""N-gram Jaccard join by set-relation skipping.

Sets are the distinct five-word shingles of whole texts, as 64-bit hashes.  Equal sets are one.
The index holds, per shingle, the list of sets that have it in their prefix (rare shingles first)
with its position there, in order of size and position.  Two linked sets have a shared shingle at
positions that differ by little: at i and j they share at most min(i, j) before it and the shorter
rest from it on.  So blocks of a list whose sizes or positions are too far apart are skipped whole,
and of the others only pairs within reach are counted.

Sets of frequent shingles that share a min-hash meet in bounded blocks first.  There one set's
overlaps with all others are computed, and those of every set highly similar to it are derived from
them: what the two differ in is looked up, nothing else.  In the lists a pair that is connected
already, or was compared so, is passed over.  Lists of more than about LONG sets are dropped where
all their sets are connected, else cut into parts that are compared pairwise in tasks of their own.
The pairs left are counted over all lists; counts that cannot reach the threshold are dropped, and
the rest is verified on whole sets.  The min-hash step only saves work: links it misses are found
in the lists, so components are exact.

Null text or no words: empty set, linked with nothing.  Null doc_id: linked with nothing, null
component.  Repeated rows: equal sets.  A doc_id with several texts: one vertex, linked by any
of them.  Empty table: empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_table, components, held_in, in_table, mix, partitions, released, shingle_hashes, small_batches, store, tidy, utf8

PERCENT = 75
HEAVY = 1 << 17  # shingles ranked by frequency in the prefix order; the rest counts as rare
HEAVY_LOCAL = 2  # documents of one window of a task that make a shingle worth reporting
HEAVY_LEAST = 16  # documents, as reported, that make a shingle frequent
WINDOW = 1 << 22  # shingles to a window
KEYS = 5  # min-hashes by which like sets meet early
GROUP = 192  # sets of a block compared at once, about
SALTS = 1 << 20  # slots of the table of group splits; slots are low bits of min-hashes
LIKE = 0.2  # a set differs from a highly similar one by at most this share of its size
LONG = 9  # lists of shingles that 2^LONG documents hold, as reported, are cut
PART = 512  # sets to a part of a long list, about
BLOCK = 64  # entries of a list that are skipped together
ROWS = 1 << 16  # entries of lists looked at together


def sets(texts: list[bytes]):
    for i, h in shingle_hashes(texts):
        yield i, np.unique(h)


def reach(n: int) -> int:
    """Prefix length: two linked sets share a shingle among so many first ones of each."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def heavy_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of all documents and their rank classes; a bounded table.  It orders
    prefixes and nothing else, so what falls out of it costs time, not results."""

    def count(batches):
        held, size = [], 0

        def report():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= HEAVY_LOCAL
            return pa.RecordBatch.from_arrays([pa.array(h[many].view(np.int64)), pa.array(n[many])], names=["h", "n"])

        for batch in batches:
            for _, s in sets(utf8(batch.column(0))):
                held.append(s)
                size += len(s)
                if size > WINDOW:
                    yield report()
                    held, size = [], 0
        if held:
            yield report()

    found = docs.select("text").mapInArrow(released(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = found.filter(F.col("n") >= HEAVY_LEAST).orderBy(F.desc("n"), "h").limit(HEAVY).toPandas()
    h = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.log2(np.maximum(top["n"].to_numpy(np.float64), 1))[order].astype(np.int64)


def ranks(s: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rank classes of the shingles of a sorted set; 0: rare."""
    if not len(heavy[0]):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(heavy[0], s), len(heavy[0]) - 1)
    return np.where(heavy[0][at] == s, heavy[1][at], 0)


def prefix(s: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The first shingles of a sorted set in the order (rank class, hash), how many of them are
    frequent, and how many do not have a long list."""
    p = reach(len(s))
    if not rank.any():
        return s[:p], 0, p
    first = np.argsort(rank, kind="stable")[:p]
    return s[first], int((rank[first] > 0).sum()), int((rank[first] < LONG).sum())


def minima(s: np.ndarray, rank: np.ndarray) -> list[int]:
    """Min-hashes of the frequent shingles of about the rank that most of them have: near copies
    share that, and a line that is common everywhere does not decide."""
    some = rank[rank > 0]
    if not len(some):
        return []
    s = s[(rank > 0) & (np.abs(rank - np.bincount(some).argmax()) <= 1)]
    return [int(mix(s ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))).min().view(np.int64)) for k in range(KEYS)]


def signatures(docs: DataFrame, heavy) -> DataFrame:
    """doc_id, n, a 128-bit digest of the set, frequent shingles of the prefix and those without long
    lists, min-hashes, prefix."""
    names = ["doc_id", "n", "s1", "s2", "common", "calm", "keys", "prefix"]

    def run(batches):
        import xxhash

        for batch in batches:
            ids, out = batch.column(0), [[], [], [], [], [], [], []]
            for _, s in sets(utf8(batch.column(1))):
                d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                out[0].append(len(s))
                out[1].append(int(d[0]))
                out[2].append(int(d[1]))
                rank = ranks(s, heavy)
                out[3].append(minima(s, rank))
                first, common, calm = prefix(s, rank)
                out[4].append(first.view(np.int64))
                out[5].append(common)
                out[6].append(calm)
            flat = pa.array(np.concatenate(out[4]) if out[4] else np.zeros(0, np.int64), pa.int64())
            ends = pa.array(np.cumsum([0] + [len(x) for x in out[4]]), pa.int32())
            cols = [ids, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[5], pa.int64()), pa.array(out[6], pa.int32()), pa.array(out[3], pa.list_(pa.int64())), pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n long, s1 long, s2 long, common long, calm int, keys array<long>, prefix array<long>")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < PERCENT * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def overlaps(sets_: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections.  A leader's are counted through an index of the sets; those of a
    set that differs little from it are the leader's, less what it lacks, plus what it has more."""
    n, sizes = len(sets_), np.array([len(s) for s in sets_])
    owner = np.repeat(np.arange(n), sizes)
    _, token, times = np.unique(np.concatenate(sets_), return_inverse=True, return_counts=True)
    holders = owner[np.argsort(token, kind="stable")]
    first = np.cumsum(times) - times
    of = np.split(token, np.cumsum(sizes)[:-1])

    def held(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sets that hold these shingles, joined, and how many hold each."""
        k = times[tokens]
        ends = np.cumsum(k)
        return holders[np.repeat(first[tokens] - ends + k, k) + np.arange(int(ends[-1]) if len(ends) else 0)], k

    out, left = np.zeros((n, n), np.int64), np.ones(n, bool)
    for x in range(n):
        if not left[x]:
            continue
        out[x] = np.bincount(held(of[x])[0], minlength=n)
        left[x] = False
        like = np.flatnonzero(left & (sizes + sizes[x] - 2 * out[x] <= LIKE * sizes[x]))
        if not len(like):
            continue
        left[like] = False
        inside = np.zeros(len(times), bool)
        inside[of[x]] = True
        lacks = [np.setdiff1d(of[x], of[y], assume_unique=True) for y in like.tolist()]
        more = [of[y][~inside[of[y]]] for y in like.tolist()]
        derived = np.repeat(out[x][None], len(like), 0)
        for parts, sign in ((lacks, -1), (more, 1)):
            who, k = held(np.concatenate(parts))
            which = np.repeat(np.repeat(np.arange(len(like)), [len(p) for p in parts]), k)
            derived += sign * np.bincount(which * n + who, minlength=len(like) * n).reshape(len(like), n)
        out[like] = derived
    return out


def crowds_of(reps: DataFrame) -> DataFrame:
    """(j, key, c): min-hashes of several sets."""
    keyed = reps.select(F.posexplode("keys").alias("j", "key"))
    return store(keyed.groupBy("j", "key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "jac-crowds")


def early_links(docs: DataFrame, reps: DataFrame, crowd: DataFrame, heavy) -> DataFrame:
    """All links inside the groups of sets that share a min-hash, as a spanning tree a group (of two
    blocks: what joins the trees of each):
    afterwards a pair of one group needs no second look.  A group of many sets is compared block
    against block, each pair of blocks a group of its own; only links leave it."""
    split = np.zeros(SALTS, np.uint8)
    big = crowd.filter(F.col("c") > GROUP).groupBy(F.pmod("key", F.lit(SALTS)).cast("int").alias("slot")).agg(F.max(F.ceil(F.log2(F.col("c") / GROUP))).alias("e")).toPandas()
    split[big["slot"].to_numpy(np.int64)] = big["e"].to_numpy(np.int64)
    keyed = reps.select("rep", F.posexplode("keys").alias("j", "key"))
    wanted = bit_table(keyed.join(crowd.select("j", "key"), ["j", "key"]).select(F.xxhash64("rep").alias("h")).distinct())
    crowds = bit_table(crowd.select("key"))
    spark = docs.sparkSession
    d = docs.select("doc_id", F.xxhash64("doc_id").alias("h"), "text").filter("doc_id is not null")
    names = ["j", "key", "low", "high", "own", "doc", "s"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def emit(batches):
        """Sets that have company, once for each block that theirs is compared with; of a group of b
        blocks, b times."""
        for batch in batches:
            h = batch.column(1).to_numpy()
            pick = np.flatnonzero(in_table(wanted, h))
            if not len(pick):
                continue
            part = batch.take(pa.array(pick))
            ids, luck, out, size = part.column(0).to_pylist(), mix(h[pick].view(np.uint64)).tolist(), [], 0
            for i, s in sets(utf8(part.column(2))):
                keys = np.array(minima(s, ranks(s, heavy)), np.int64)
                for j in np.flatnonzero(in_table(crowds, keys)).tolist():
                    key = int(keys[j])
                    blocks = 1 << int(split[key & (SALTS - 1)])
                    mine = luck[i] % blocks
                    for other in range(blocks):
                        out.append((j, key, min(mine, other), max(mine, other), mine, ids[i], s))
                        size += s.nbytes
                if size > 1 << 23:
                    yield rows_of(out)
                    out, size = [], 0
            if out:
                yield rows_of(out)

    def rows_of(out):
        cols = list(zip(*out, strict=True))
        cols[6] = [s.tobytes() for s in cols[6]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    rows = d.mapInArrow(released(emit), "j int, key long, low int, high int, own int, doc long, s binary")
    rows = rows.repartition(partitions(spark), "j", "key", "low", "high").sortWithinPartitions("j", "key", "low", "high", "doc")

    def group(low, high, rows):
        own, docs_ = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        sets_ = [np.frombuffer(r[2], np.uint64) for r in rows]
        n = np.array([len(s) for s in sets_])
        both = overlaps(sets_)
        x, y = np.nonzero(100 * both >= PERCENT * (n[:, None] + n[None, :] - both))
        keep = (x < y) & (docs_[x] != docs_[y])
        x, y = x[keep], y[keep]
        inner = own[x] == own[y]
        order = np.argsort(~inner, kind="stable")  # links inside a block first: its own group tells those
        root = list(range(len(rows)))

        def top(p):
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        out = []
        for p, q, told in zip(x[order].tolist(), y[order].tolist(), (inner[order] & (low != high)).tolist(), strict=True):
            a, b = top(p), top(q)
            if a != b:
                root[b] = a
                if not told:
                    out.append((int(docs_[p]), int(docs_[q])))
        return out

    def compare(batches):
        now, rows, out = None, [], []
        for batch in batches:
            for j, key, low, high, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (j, key, low, high) != now:
                    if len(rows) > 1:
                        out += group(now[2], now[3], rows)
                    now, rows = (j, key, low, high), []
                rows.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])
                out = []
        if len(rows) > 1:
            out = group(now[2], now[3], rows)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return store(rows.mapInArrow(released(compare), "a long, b long").distinct(), "jac-early")


def within(n, m, i, j):
    """May sets of n and m shingles that share one at positions i and j be linked?"""
    least = -(-PERCENT * (n + m) // (100 + PERCENT))
    return (100 * m <= most_of(n)) & (i - j <= n - least) & (j - i <= m - least)


def most_of(n):
    """Hundred times the size of the largest set that one of n shingles can be linked with."""
    return n * 10000 // PERCENT


def block_pairs(n: np.ndarray, pos: np.ndarray):
    """Pairs (x, y), x before y, of a list in order of size and position that size and position
    allow, block against block; blocks that are too far apart are skipped whole."""
    starts = np.arange(0, len(n), BLOCK)
    low_n, high_n = n[starts], n[np.minimum(starts + BLOCK, len(n)) - 1]
    low_p, high_p = np.minimum.reduceat(pos, starts), np.maximum.reduceat(pos, starts)
    for p in range(len(starts)):
        q = np.arange(p, len(starts))
        least = -(-PERCENT * (low_n[p] + low_n[q]) // (100 + PERCENT))
        q = q[(100 * low_n[q] <= most_of(high_n[p])) & (low_p[q] <= high_p[p] + high_n[q] - least) & (low_p[p] <= high_p[q] + high_n[p] - least)]
        if not len(q):
            continue
        x = np.arange(starts[p], min(starts[p] + BLOCK, len(n)))
        for part in np.array_split(q, -(-len(q) // 16)):
            y = np.concatenate([np.arange(a, min(a + BLOCK, len(n))) for a in starts[part].tolist()])
            ok = (x[:, None] < y) & within(n[x][:, None], n[y], pos[x][:, None], pos[y])
            a, b = np.nonzero(ok)
            if len(a):
                yield x[a], y[b]


def list_pairs(postings: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b, na, nb) once for every list that holds both, unless sizes and positions rule a link out,
    they are connected already, or a group has compared them.  ``known`` holds component and
    min-hashes, eight bytes each, of sets that have company.  ``keys``: the list, and of a long one the
    two parts that are compared and the entry's own."""
    spark = postings.sparkSession
    list_keys = [k for k in keys if k != "own"]
    cols_ = [*keys, "n", "pos", "doc", "known"]
    rows = postings.select(*cols_).repartition(partitions(spark), *list_keys).sortWithinPartitions(*list_keys, "n", "pos", "doc")
    k = len(keys)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(k + 3)]
            known = np.zeros((batch.num_rows, 1 + KEYS), np.int64)
            known[:, 0] = cols[k + 2]
            has = batch.column(k + 3).is_valid().to_numpy(zero_copy_only=False)
            if has.any():
                known[has] = np.frombuffer(b"".join(batch.column(k + 3).drop_null().to_pylist()), ">i8").reshape(-1, 1 + KEYS)
            held.append([*cols, known])
            size += batch.num_rows
            if size > ROWS:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[: len(list_keys)]], 0))
                last = int(new[-1]) + 1 if len(new) else 0
                held, size = [[c[last:] for c in cols]], len(cols[0]) - last
                yield from lists([c[:last] for c in cols])
        if held:
            yield from lists([np.concatenate(c) for c in zip(*held, strict=True)])

    def lists(cols):
        n, pos, doc, known = (cols[k], cols[k + 1].astype(np.int64), cols[k + 2], cols[k + 3])
        if not len(n):
            return
        own = cols[k - 1] if keys[-1] == "own" else None
        both = (cols[1] != cols[2]) if own is not None else None
        starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols[: len(list_keys)]], 0)]))
        ends = np.append(starts[1:], len(n))
        until = np.repeat(ends, ends - starts)
        short = np.repeat(ends - starts <= BLOCK // 2, ends - starts)
        out, size = [], 0

        def pairs():
            """Short lists all together, by the distance of the two in the list; long ones in blocks."""
            at = np.flatnonzero(short)
            for step in range(1, BLOCK // 2):
                at = at[at + step < until[at]]
                if not len(at):
                    break
                ok = within(n[at], n[at + step], pos[at], pos[at + step])
                yield at[ok], at[ok] + step
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s > BLOCK // 2 and (known[s:e, 0] != known[s, 0]).any():
                    for x, y in block_pairs(n[s:e], pos[s:e]):
                        yield s + x, s + y

        for x, y in pairs():
            new = ~((known[x] == known[y]) & (known[x] != 0)).any(1) & (doc[x] != doc[y])
            if own is not None:
                new &= (own[x] != own[y]) | ~both[x]
            x, y = x[new], y[new]
            if len(x):
                out.append((doc[x], doc[y], n[x], n[y]))
                size += len(x)
            if size > 50_000:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["a", "b", "na", "nb"])

    return rows.mapInArrow(released(run), "a long, b long, na long, nb long")


def long_lists(postings: DataFrame) -> DataFrame:
    """Pairs of the long lists: of shingles in a table of at most HEAVY, so what is sent to every task
    of their lengths has a fixed bound.  A list of one component is settled."""
    postings = store(postings, "jac-long")
    lengths = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y")
    lengths = F.broadcast(lengths.select("token", F.ceil(F.col("c") / PART).cast("int").alias("parts")))
    rows = postings.join(lengths, "token").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    return list_pairs(rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}), ["token", "low", "high", "own"])


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b: doc ids) that are links, by their whole sets."""
    ends = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    table = bit_table(ends.select(F.xxhash64("doc").alias("h")))
    d = docs.select("doc_id", F.xxhash64("doc_id").alias("h"), "text").filter("doc_id is not null")

    def emit(batches):
        for batch in batches:
            pick = np.flatnonzero(in_table(table, batch.column(1).to_numpy()))
            if len(pick):
                part = batch.take(pa.array(pick))
                out = [s.tobytes() for _, s in sets(utf8(part.column(2)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["doc", "s"])

    found = d.mapInArrow(released(emit), "doc long, s binary").join(ends, "doc", "left_semi").distinct()
    found = store(found, "jac-sets")
    both = pairs.select("a", "b").join(found.select(F.col("doc").alias("a"), F.col("s").alias("sa")), "a").join(found.select(F.col("doc").alias("b"), F.col("s").alias("sb")), "b")

    def check(batches):
        for batch in batches:
            sa, sb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(sa, sb, strict=True)]
            part = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"])

    return store(both.select("a", "b", "sa", "sb").mapInArrow(released(check), "a long, b long").distinct(), "jac-late")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    heavy = heavy_shingles(docs)
    table = store(signatures(docs, heavy), "jac-sets-of")  # read until the result is
    named = table.filter("doc_id is not null and n > 0")
    # a doc_id may come with several sets; each (doc_id, set) stands for its set's smallest doc_id
    reps = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("common").alias("common"))
    reps = store(reps, "jac-reps")
    # long lists are those of frequent shingles, so only sets that reach them with their prefixes
    # are compared early; the others meet in short lists
    busy = reps.filter("common > 0").select("rep", "keys")
    crowd = crowds_of(busy)
    early = early_links(docs, busy, crowd, heavy)
    tidy(spark)
    known = components(early, "jac-cc1")
    # most sets are alone with all their min-hashes and stand for one document: their prefixes go
    # to the lists as they are, and only the others meet what is known of them
    crowds = held_in(bit_table(crowd.select("key")))
    byte8 = lambda x: F.unhex(F.lpad(F.hex(x), 16, "0"))
    keys = [F.when((F.col("common") > 0) & crowds(F.coalesce(F.get("keys", F.lit(j)), F.lit(0).cast("long"))), F.get("keys", F.lit(j))).otherwise(F.lit(0).cast("long")) for j in range(KEYS)]
    chosen = reps.join(known, F.col("rep") == F.col("id"), "left")
    chosen = chosen.select(F.col("s1").alias("_a"), F.col("s2").alias("_b"), "rep", F.coalesce("component", "rep").alias("comp"), F.concat(byte8(F.coalesce("component", "rep")), *[byte8(k) for k in keys]).alias("known"))
    social = reps.select(F.xxhash64("s1", "s2").alias("h"), "copies", "common")
    social = social.filter("copies > 1 or common > 0").select("h")
    marked = named.select("doc_id", "n", "s1", "s2", "calm", "prefix").withColumn("_met", held_in(bit_table(social))(F.xxhash64("s1", "s2")))
    alone = marked.filter(~F.col("_met")).select(F.posexplode("prefix").alias("pos", "token"), "n", F.col("doc_id").alias("doc"), F.lit(None).cast("binary").alias("known"))
    met = marked.filter("_met").join(chosen, (F.col("s1") == F.col("_a")) & (F.col("s2") == F.col("_b")) & (F.col("doc_id") == F.col("rep")))
    met = met.select("calm", F.posexplode("prefix").alias("pos", "token"), "n", F.col("doc_id").alias("doc"), "known", "comp")
    brief = alone.unionByName(met.filter("pos < calm").drop("calm", "comp"))
    pairs = list_pairs(brief, ["token"]).unionByName(long_lists(met.filter("pos >= calm")))
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    # of two sets, the one whose prefix ends first has all common shingles up to there in both
    # prefixes: the overlap is at most those counted and what is left behind its prefix
    least = F.ceil(F.lit(PERCENT) * (F.col("na") + F.col("nb")) / F.lit(100 + PERCENT))
    behind = lambda n: n - (n - F.ceil(F.lit(PERCENT) * n / F.lit(100)) + 1)
    pairs = store(pairs.filter(F.col("c") + F.greatest(behind(F.col("na")), behind(F.col("nb"))) >= least).filter("a <> b").select("a", "b").distinct(), "jac-pairs")
    tidy(spark)
    late = verify(docs, pairs)
    # rows of one doc_id are one vertex: tie every set of a doc_id to its representative
    same = named.join(reps.select(F.col("s1").alias("_a"), F.col("s2").alias("_b"), "rep"), (F.col("s1") == F.col("_a")) & (F.col("s2") == F.col("_b")))
    same = store(same.select("doc_id", "rep").distinct(), "jac-same")
    copies = same.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = early.union(late)
    # of a doc_id's sets one may have the doc_id itself as representative: that one counts too
    several = same.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("doc_id").alias("_d"))
    links = links.union(copies.join(several, F.col("a") == F.col("_d"), "left_semi"))
    final = components(links, "jac-cc2")
    of_rep = same.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    out = of_rep.join(final, F.col("rep") == F.col("id"), "left").select(F.col("doc_id").alias("_d"), F.coalesce("component", "rep").alias("c"))
    return table.select("doc_id", F.col("n").alias("n_shingles")).join(out, F.col("doc_id") == F.col("_d"), "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS g FROM t),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * COUNT(*) >= 75 * (a.n + b.n - COUNT(*))),
r(x, y) AS (SELECT x, y FROM c UNION SELECT r.x, c.y FROM r JOIN c ON r.y = c.x),
m AS (SELECT x, MIN(y) AS y FROM r GROUP BY x)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CAST(LEAST(s.doc_id, COALESCE(m.y, s.doc_id)) AS BIGINT) AS component_id
FROM s LEFT JOIN m ON m.x = s.doc_id
"""
