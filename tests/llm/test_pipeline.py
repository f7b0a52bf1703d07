import corpus_pipeline as P
from foliant.llm.packing import Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_their_contracts(spark, tmp_path):
    from .test_edges import text

    data = [(i, text(i, 80), "en", "ab"[i % 2], 1) for i in range(40)] + [(100, text(3, 80), "en", "a", 1), (100, text(3, 80), "en", "a", 1), (101, None, None, None, None), (102, "12 34", "en", "a", 5)]
    shared = text(999, 120)
    data += [(200 + i, f"{text(200 + i, 90)} {shared} {text(300 + i, 90)}", "en", "b", 1) for i in range(2)]
    docs = spark.createDataFrame(data, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in P.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        seen[name] = docs.collect()
    ids = lambda n: [r.doc_id for r in seen[n]]
    assert 101 not in ids("language_id") and 102 not in ids("language_id") and len(ids("language_id")) == len(data) - 2
    assert 100 not in ids("jaccard_join") and 3 in ids("jaccard_join")
    assert sorted(ids("suffix_dedup")) == sorted(ids("jaccard_join"))
    assert sum(shared in r.text for r in seen["jaccard_join"]) == 2 and sum(shared in r.text for r in seen["suffix_dedup"]) == 1  # one occurrence stays
    words = sum(len(r.text.split()) for r in seen["suffix_dedup"])
    assert abs(sum(len(r.text.split()) for r in seen["mixing"]) - words) <= 2
    pieces = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    w = Words()
    assert sum(r.length for r in pieces) == sum(len(w.tok_ids(r.text)) // 4 for r in seen["mixing"])
    assert P.run(spark, str(tmp_path)).count() > 0


def test_near_copies_takes_rows_whatever_their_id(spark):
    from .test_edges import text

    a, b, c, d = (text(400 + i, 60) for i in range(4))
    data = [(1, a), (1, b), (1, b), (2, a + " and one tail"), (None, c), (None, c), (None, d), (3, d), (4, ""), (4, None), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "a", 1) for r in data], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in P.near_copies(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (None, c), (3, d), (4, ""), (4, None), (None, None), (None, None)], key=repr)


def test_language_stage_without_labels_keeps_texts(spark):
    data = [(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "漢字", None), (5, "", None)]
    docs = spark.createDataFrame([(*r, "a", 1) for r in data], SCHEMA)
    out = P.language(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 4]


def test_stages_carry_any_column_and_take_empty_tables(spark, monkeypatch):
    from foliant.llm.langid import Network

    from .test_edges import text

    monkeypatch.setattr(P, "fit", lambda docs: (["en", "fr"], Network(2)))  # untrained: every score is about a half
    extra = ["_at", "_n", "_k", "_cut", "_epochs", "_source", "_key", "_again", "_id", "_maybe", "_rest", "n_removed", "kept", "row", "size", "key", "lang_pred", "score", "c0", "c1", "component_id", "column_0", "a.b"]
    shared = text(998, 120)
    data = [(i, text(500 + i, 70), "en", "ab"[i % 2], 1) for i in range(12)] + [(20 + i, f"{text(530 + i, 60)} {shared}", "en", None, 1) for i in range(2)] + [(30, text(500, 70), "en", "a", 1)] * 2 + [(None, None, None, None, None), (31, "", "en", "a", 0)]
    docs = spark.createDataFrame([(*r, *[f"{r[0]}{c}" for c in extra]) for r in data], SCHEMA + "".join(f", `{c}` string" for c in extra))
    ids = lambda rows: sorted((r.doc_id for r in rows), key=repr)
    kept = {}
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").collect() == [], name
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        kept[name] = out.collect()
        assert all(r[c] == f"{r.doc_id}{c}" for r in kept[name] for c in extra), name
    assert ids(kept["language_id"]) == ids([r for r in docs.collect() if r.text])
    assert ids(kept["jaccard_join"]) == ids(docs.filter("doc_id is null or doc_id <> 30").collect())
    assert ids(kept["suffix_dedup"]) == ids(docs.collect())
    assert P.packing(spark, docs.limit(0), "").count() == 0
    pieces = P.packing(spark, docs, "").collect()
    assert ids(r for r in pieces if r.start == 0) == ids(docs.collect()) and {r.length for r in pieces if r.doc_id in (None, 31)} == {1}
