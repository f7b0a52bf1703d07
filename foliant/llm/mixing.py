"""Mixing sources to target weights.

Every document gets a hash-random key; documents are range-sorted by (source, key), running
sums of their words come from distributed prefix sums, and each source is cut at its budget,
whole epochs first.  Null text: size 0.  Null source: a source of its own, last in order.
Repeated rows are documents of their own.  Empty table: empty result."""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, running, store

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = 3  # weights 1, 2, 3, repeating
MOST = 3  # no source beyond this many epochs
BIG = "decimal(38,0)"


def word_count(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


@F.pandas_udf(T.StringType())
def first_words(text: pd.Series, n: pd.Series) -> pd.Series:
    def cut(t, k):
        return None if t is None else t[: next(islice(re.finditer(WORD, t), k - 1, None)).end()]

    return pd.Series([cut(t, k) for t, k in zip(text, n, strict=True)], dtype=object)


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size, target) for ``sources`` (source, source_size): weights by code-point
    order, targets capped at MOST sizes, the excess reshared by weight until none is above.
    Each round is one aggregate of one row; the rounds are as many as caps that follow from caps."""
    s = running(sources.withColumn("_one", F.lit(1).cast("long")), [], [F.col("source").asc_nulls_last()], "_one", "mix-rank")
    s = s.select("source", "source_size", (F.col("before") % CYCLE + 1).alias("w"))
    s = store(s, "mix-sources").withColumn("capped", F.lit(False))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    sat = (F.lit(MOST) * F.col("source_size")).cast(BIG)
    rest, weight, level = total, 1, None
    while True:
        row = s.agg(
            F.sum(F.when(F.col("capped"), sat)).alias("c"), F.sum(F.when(~F.col("capped"), F.col("w"))).alias("w"), F.count(F.when(F.col("capped"), 1)).alias("n")
        ).first()
        rest, weight = total - int(row.c or 0), int(row.w or 0)
        if row.n == level or not weight:
            break
        level = row.n
        above = F.col("w").cast(BIG) * F.lit(rest).cast(BIG) > (F.lit(MOST * weight).cast(BIG) * F.col("source_size").cast(BIG)).cast(BIG)
        s = s.withColumn("capped", F.col("capped") | above)
    share = (F.col("w").cast(BIG) * F.lit(rest).cast(BIG)).cast("double") / F.lit(float(max(weight, 1)))
    return s.select("source", "source_size", F.when(F.col("capped"), F.lit(MOST) * F.col("source_size")).otherwise(share).cast("double").alias("target"))


def _key(seed: str):
    return F.md5(F.concat(F.lit(f"mix-{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix(docs: DataFrame, seed: str = "42", keep: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, before, taken (words the
    mix takes of it, repeats counted) and the columns named in ``keep``, which must not clash
    with these.  Epochs are whole passes; the last, partial pass ends inside the document where
    the budget ends."""
    rows = docs.select("doc_id", "source", word_count().alias("size"), _key(seed).alias("key"), *[F.col(k) for k in keep or []])
    rows = store(running(rows, ["source"], [F.col("key"), F.col("doc_id"), F.col("size")], "size", "mix-run"), "mix-before")
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).select(F.col("source").alias("_s"), "source_size", "target")
    out = rows.join(aims, F.col("source").eqNullSafe(F.col("_s")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long")
    part = F.floor("target").cast("long") - epochs * F.col("source_size") - F.col("before")
    part = F.greatest(F.lit(0).cast("long"), F.least(part, F.col("size")))
    return out.select("doc_id", "source", "size", "source_size", "target", "before", epochs.alias("epochs"), (epochs * F.col("size") + part).alias("taken"), *(keep or []))


def cuts(plan: DataFrame) -> DataFrame:
    """One row per source: whole epochs, the first row in order that the last pass does not take
    whole, and the words it takes of it."""
    rest = F.floor("target").cast("long") - F.col("epochs") * F.col("source_size")
    first = plan.filter(F.col("before") + F.col("size") > rest)
    at = F.struct("key", _id(F.col("doc_id")).alias("id"), "size")
    return first.groupBy("source").agg(F.first("epochs").alias("_epochs"), F.min_by(F.struct(at.alias("at"), (rest - F.col("before")).alias("part")), at).alias("_cut"))


def _id(c):
    return F.coalesce(c, F.lit(-(1 << 63)))


def mixed_documents(docs: DataFrame, seed: str = "42") -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document once per whole epoch, and the
    document in which a budget ends cut after its last word taken.  What a source's budget ends at
    is one row per source; with it each document decides for itself, so texts stay in place.
    Null text and text without a word: size 0, so it counts for nothing; it comes along where its key
    sorts before the cut.  Null source: a source of its own.  Rows alike in all that is counted are
    each taken whole or cut by their order of text.  An empty table stays empty; other columns keep
    their names and values, whatever they are called."""
    docs, back = apart(docs, ("doc_id", "text", "source", "n_chars"))
    cols = docs.columns
    plan = store(mix(docs.select("doc_id", "text", "source"), seed), "mix-plan").withColumn("key", _key(seed))
    ends = store(cuts(plan), "mix-cuts").withColumnRenamed("source", "_source")
    at = F.struct(_key(seed).alias("key"), _id(F.col("doc_id")).alias("id"), word_count().alias("size"))
    d = docs.withColumn("_at", at).join(ends, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    clear = d.filter(F.col("_at") != F.col("_cut.at"))
    clear = clear.withColumn("_n", F.explode(F.sequence(F.lit(1), (F.col("_epochs") + (F.col("_at") < F.col("_cut.at")).cast("long")).cast("int") + 1))).filter(F.col("_n") > 1)
    # rows at which a budget ends: one per source, unless rows repeat; then those before it in the
    # count are whole, and those after it are left out of the last pass
    edge = d.filter(F.col("_at") == F.col("_cut.at"))
    edge = edge.withColumn("_k", F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64("text"))))
    whole = edge.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_epochs").cast("int") + 1))).filter(F.col("_n") > 1)
    part = edge.filter((F.col("_k") == 1) & (F.col("_cut.part") > 0))
    part = part.withColumn("text", first_words(F.col("text"), F.col("_cut.part")))
    if "n_chars" in cols:
        part = part.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return back(clear.select(*cols).unionByName(whole.select(*cols)).unionByName(part.select(*cols)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix-42:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
r AS (SELECT *, COALESCE(SUM(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
s AS (SELECT source, SUM(size)::HUGEINT AS sz, ((ROW_NUMBER() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY CAST(sz AS DOUBLE) / w, source NULLS LAST) AS k FROM s),
c AS (SELECT *, (SELECT SUM(sz) FROM s) - COALESCE(SUM(3 * sz) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             SUM(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM o),
f AS (SELECT * FROM c WHERE w * rest <= 3 * sz * ws ORDER BY k LIMIT 1),
t AS (SELECT o.source, CAST(o.sz AS BIGINT) AS source_size,
             CAST(CASE WHEN o.k < COALESCE((SELECT k FROM f), 1000000000) THEN 3 * o.sz
                  ELSE CAST(o.w * (SELECT rest FROM f) AS DOUBLE) / CAST((SELECT ws FROM f) AS DOUBLE) END AS DOUBLE) AS target FROM o),
e AS (SELECT r.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN CAST(FLOOR(FLOOR(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS ep
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(ep * size + GREATEST(0, LEAST(CAST(FLOOR(target) AS BIGINT) - ep * source_size - before, size)) AS BIGINT) AS taken FROM e
"""
