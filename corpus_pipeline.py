"""The corpus pipeline: language ID, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return
the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import KEPT, apart, one_thread, store, stored, sweep, without
from foliant.llm.jaccard import near_duplicates
from foliant.llm.langid import UND, fit, predict
from foliant.llm.mixing import mixed_documents
from foliant.llm.packing import pack
from foliant.llm.suffixes import PASSAGE, PASSAGE_WORDS, remove_repeats


def _begin(spark: SparkSession) -> int:
    """A stage's input is written, so no table of the stages before it is read any more.  Executors
    hold the workers of several stages, so a task reads less of a shuffle at a time."""
    sweep(spark)
    one_thread(spark)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32m")
    return stored(spark)


LEAST_SCORE = 0.3  # below it no language stands out, and the document is rejected


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, and those in which no language stands out.  Texts stay
    in place: the prediction runs beside them and only rejects leave.  Where no labelled row is there
    to learn from, no language is told and only documents without a letter are rejected.  Null and empty
    texts have no letter and go; repeated rows fare alike; an empty table stays empty; other columns
    keep their names and values, whatever they are called."""
    _begin(spark)
    names, net = fit(docs)
    if net is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    plain, back = apart(docs, ("text",))
    out = predict(plain, names, net, with_text=True)
    return back(out.filter((F.col("lang_pred") != UND) & (F.col("score") >= LEAST_SCORE)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that of the smallest doc_id (null last), and
    of its texts the one that sorts first by hash.  Rows are told apart by doc_id and text, so unlike
    texts of one doc_id, or of none, all stay.  Rows without a word are like nothing and stay, null and
    empty texts too; a row repeated in doc_id and text is kept once.  An empty table stays empty; other
    columns keep their names and values, whatever they are called."""
    first = _begin(spark)
    docs, back = apart(docs, ("doc_id", "text"))
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    keyed = docs.withColumn("_key", key)
    groups = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text")).filter("n_shingles > 0")
    groups = store(groups.groupBy("doc_id").agg(F.first("component_id").alias("g"), F.count(F.lit(1)).alias("n")).select(F.col("doc_id").alias("_k"), "g", "n"), "pipe-groups")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", F.col("_key"))
    named = store(keyed.select("doc_id", "_key").join(groups, F.col("_key") == F.col("_k")).select("g", "_key", rank.alias("rank")), "pipe-named")
    stays = named.groupBy("g").agg(F.min("rank").alias("least")).select(F.col("least._key").alias("_s"))
    gone = store(named.select("_key").join(stays, F.col("_key") == F.col("_s"), "left_anti").distinct(), "pipe-gone")
    again = store(groups.filter("n > 1").select(F.col("_k").alias("_again")), "pipe-again")
    sweep(spark, first, ("pipe-gone", "pipe-again"))
    kept = without(keyed, gone, "_key")
    if not again.limit(1).count():
        return back(kept)
    once = without(kept, again, "_key").select(*docs.columns)
    twins = kept.join(again, F.col("_key") == F.col("_again"), "left_semi")
    row = F.first(F.struct(*[F.col(c) for c in docs.columns]))
    return back(once.unionByName(twins.groupBy("_key").agg(row.alias("row")).select("row.*").select(*docs.columns)))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated passages out of the texts: strings of PASSAGE bytes that occur elsewhere too, in
    runs of PASSAGE_WORDS words or more.  One occurrence of each stays, and every document stays.
    n_chars follows the text.  Null and empty texts, short ones and null doc_ids stay as they are; rows
    alike in doc_id and text are one occurrence; an empty table stays empty; other columns are carried
    in one struct, so no name clashes."""
    _begin(spark)
    docs, back = apart(docs, ("doc_id", "text", "n_chars"))
    rows = docs.select("doc_id", "text", F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_rest"))
    out = remove_repeats(rows, ["_rest"], as_text=True, length=PASSAGE, least_words=PASSAGE_WORDS, first_stays=True)
    cut = F.col("n_removed") > 0
    made = {"text": F.when(cut, F.col("kept"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType))
    return back(out.select(*[F.coalesce(made[c], F.col(f"_rest.c{i}")).alias(c) if c in made else F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(docs.columns)]))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it; nulls, ties, repeated rows, empty
    tables and other columns as ``mixed_documents`` states."""
    _begin(spark)
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, one row a piece.  A null text is an empty one: the closing id alone.
    Null doc_ids and repeated rows are packed like others; an empty table gives no piece; other columns
    are not read."""
    _begin(spark)
    return pack(docs, cache=120_000, window=1 << 20).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_copies),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixture),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"{KEPT}{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
