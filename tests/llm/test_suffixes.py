import hashlib
import random
from collections import Counter

import numpy as np
from foliant.llm import suffixes
from foliant.llm.suffixes import LENGTH, PASSAGE, PASSAGE_WORDS, multikey_order, remove_repeats, sorted_neighbours

SCHEMA = "doc_id long, text string, kept string, _t int"


def covered(texts, length, words=0, first=None):
    """A mask per text, by a table of all windows.  ``first``: order of the texts, of which the first
    occurrence of each window stays."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    taken, out = set(), [None] * len(texts)
    for k in first or range(len(texts)):
        t = texts[k]
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            if seen[w] > 1 and (first is None or w in taken):
                gone[i : i + length] = True
            taken.add(w)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone]).astype(int)))
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            gone[a:b] = len(t[a:b].split()) >= words
        out[k] = gone
    return out


def spans(gone):
    return int((gone[1:] & ~gone[:-1]).sum() + gone[0])


def left(t, gone):
    return hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=False) if not g)).hexdigest()


def brute(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha, passage_bytes) of every row."""
    texts = [(r[1] or "").encode() for r in rows]
    both = zip(covered(texts, LENGTH), covered(texts, PASSAGE, PASSAGE_WORDS), strict=True)
    return sorted([(r[0], len(t), int(g.sum()), spans(g), left(t, g), int(p.sum())) for r, t, (g, p) in zip(rows, texts, both, strict=True)], key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = remove_repeats(df, passages=True).collect()
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest(), r.passage_bytes) for r in got], key=repr)


def brute_first(spark, rows, length, words=0):
    """As ``brute`` with the first occurrence left, in the operator's order of documents."""
    from pyspark.sql import functions as F

    texts = [(r[1] or "").encode() for r in rows]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, doc_id long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    order = [r.i for r in df.orderBy(F.shiftrightunsigned(F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text")), 2)).collect()]
    return sorted([(r[0], len(t), int(g.sum()), spans(g), left(t, g)) for r, t, g in zip(rows, texts, covered(texts, length, words, order), strict=True)], key=repr)


def run_first(spark, rows, length, words=0):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(df, length=length, least_words=words, first_stays=True).collect()
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got], key=repr)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnoé", k=rng.randint(2, 9))) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    passage, short = words(rng, 120), words(rng, 45)
    rows = [(i, words(rng, rng.randint(1, 200))) for i in range(20)]
    rows += [(100 + i, f"{words(rng, 30)} {passage} {words(rng, 30)}") for i in range(6)]
    rows += [(200 + i, f"{words(rng, rng.randint(0, 50))} {short} {words(rng, 50)}") for i in range(6)]
    base = words(rng, 300)
    rows += [(300 + i, base) for i in range(3)]
    for i in range(8):  # near copies
        w = base.split(" ")
        w[rng.randrange(len(w))] = "zz"
        rows.append((310 + i, " ".join(w)))
    rows += [(400, None), (401, ""), (None, passage), (None, None), (402, passage[:399]), (403, "a" * 1500), (404, "ab" * 700), (405, words(rng, 30) * 9), (310, base), (406, passage + passage)]
    return rows


def test_against_all_windows(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert run(spark, rows) == brute(rows)


def test_the_first_occurrence_stays(spark, monkeypatch):
    rows = [r for r in corpus(5) if r[0] is not None and r[0] != 310]  # no rows alike
    for crowd in (512, 2):
        monkeypatch.setattr(suffixes, "CROWD", crowd)
        for length, least in ((400, 0), (PASSAGE, PASSAGE_WORDS)):
            assert run_first(spark, rows, length, least) == brute_first(spark, rows, length, least)
    alike = [(1, words(random.Random(8), 100))] * 2 + [(2, words(random.Random(9), 100))]
    assert all(r[2] == 0 for r in run_first(spark, alike, PASSAGE))  # one occurrence, come twice


def test_crowded_leads_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD", 2)
    rows = corpus(3)
    assert run(spark, rows) == brute(rows)
    rng = random.Random(4)
    long = words(rng, 60_000)
    rows = [(1, long), (2, long[5000:9000]), (3, long[262_000:263_000]), (4, words(rng, 100))]
    assert run(spark, rows) == brute(rows)


def test_a_wrong_order_breaks_the_result(monkeypatch):
    raw = [(f"{i:04d}" * 50 + "passage " * 60 + f"{i:04d}" * 50).encode()[100:700] for i in range(40)]
    off, starts, rank = np.full(40, 99), np.full(40, 100), np.arange(40)
    same = [r[60:] for r in raw]
    good = suffixes.bucket_repeats(same, off, starts, rank, 200)
    assert {tuple(x) for x in good[:, :1]} == {(k,) for k in range(40)}
    monkeypatch.setattr(suffixes, "multikey_order", lambda tokens: np.random.default_rng(0).permutation(len(tokens)))
    assert suffixes.bucket_repeats(same, off, starts, rank, 200).tolist() != good.tolist()


def test_sorted_neighbours():
    rng = random.Random(6)
    data = [bytes(rng.choices(b"\0\1a", k=rng.randint(0, 30))) for _ in range(400)]
    order, same = sorted_neighbours(data)
    got = [data[i] for i in order]
    assert [x.ljust(32, b"\0") for x in got] == sorted(x.ljust(32, b"\0") for x in got)
    for x, y, n in zip(got, got[1:], same[1:].tolist(), strict=False):
        assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])


def test_a_repeated_start_is_told_once(spark):
    """Not once for each length: such rows were a half of what op8 wrote and grouped."""
    from pyspark.sql import functions as F

    rng = random.Random(7)
    same = [words(rng, 150), words(rng, 900)]
    df = spark.createDataFrame([(1 << 32, same[0]), (2 << 32, same[0]), (3 << 32, same[1]), (4 << 32, same[1])], "dh long, text string")
    suffixes.small_batches(spark, 500)
    found = suffixes.repeated_starts(df.withColumn("th", F.xxhash64("text")), (LENGTH, PASSAGE)).collect()
    told = Counter((r.dh, r.w, s) for r in found for s in range(r["from"], r["to"]))
    sizes = {i + 1: len(same[i // 2].encode()) for i in range(4)}
    assert sorted(told) == sorted((i << 32, LENGTH if s <= n - LENGTH else PASSAGE, s) for i, n in sizes.items() for s in range(n - PASSAGE + 1))
    assert set(told.values()) == {1}


def test_least_of_neighbours():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 64, 120, 200):
        x = rng.integers(0, 50, 300).astype(np.uint64)
        assert suffixes._least(x.copy(), width).tolist() == [x[i : i + width].min() for i in range(301 - width)]


def test_no_rows_and_one(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "x")]) == brute([(1, "x")])


def test_multikey_order():
    rng = np.random.default_rng(0)
    t = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    got = t[multikey_order(t)].tolist()
    assert got == sorted(t.tolist())


def test_executors_give_memory_back(tmp_path):
    """On a cluster ``tidy`` collects the garbage of every executor, not the driver's alone."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    import pyspark

    home = tmp_path / "home"  # executors work in Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    code = f"""
from pyspark.sql import SparkSession
from foliant.llm.common import tidy
conf = {{"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.executor.extraJavaOptions": "-Xlog:gc:file={tmp_path}/gc-%p.log"}}
spark = SparkSession.builder.config(map=conf).getOrCreate()
while spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() < 3:
    pass
tidy(spark)
spark.stop()
"""
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], env=env, check=True, timeout=120, cwd=tmp_path)
    logs = [p.read_text() for p in tmp_path.glob("gc-*.log")]
    assert len(logs) == 2 and all("System.gc()" in x for x in logs)
