"""Scenarios of the layout engine on small rows."""

import json

import pytest
from foliant.config import ChunkConfig, Config, LlmTextConfig, MarkdownConfig, TableConfig
from foliant.functions import mathtext
from foliant.functions import text as T
from foliant.operators import chunks as C
from foliant.operators import figures, layout, tables
from foliant.operators.sections import toc_line
from foliant.plans.api import DocumentSet
from pyspark.sql import functions as F

SPANS = "doc_id long, span_seq long, page int, text string, font_name string, font_size double, is_bold boolean, is_italic boolean, left double, top double, right double, bottom double"


def span(seq, text, left, top, size=10.0, bold=False, page=0, doc=1, font="Times"):
    return (doc, seq, page, text, font, size, bold, False, left, top, left + len(text.encode()) * size * 0.5, top - size)


@pytest.fixture(scope="module")
def paper(spark):
    rows = [
        span(0, "A Fine Title", 72.0, 750.0, 20.0, True), span(1, "Ann Lee and Bo Ray", 72.0, 720.0), span(2, "1 Introduction", 72.0, 690.0, 14.0, True),
        span(3, "Body one & more text about things.", 72.0, 660.0), span(4, "1.1 Detail", 72.0, 630.0, 14.0, True), span(5, "Body two with doi:10.1234/abc.5.", 72.0, 600.0),
        span(6, "Fig. 1: a picture", 72.0, 560.0), span(7, "2 Methods", 72.0, 700.0, 14.0, True, 1), span(8, "Body three.", 72.0, 660.0, page=1), span(9, "   ", 1.0, 5.0),
    ]
    images = [(1, 1, 0, "images/p000_img001.png", 72.0, 585.0, 272.0, 565.0, 10, 10, "png")]
    i = spark.createDataFrame(images, "doc_id long, image_seq long, page int, path string, left double, top double, right double, bottom double, width_px int, height_px int, format string")
    return DocumentSet(spark.createDataFrame(rows, SPANS), images=i).persist()


def test_structure(paper):
    s = {r.section_id: r for r in paper.sections.collect()}
    assert [s[i].header for i in sorted(s)] == [None, "Introduction", "Detail", "Methods"]
    assert (s[2].parent_id, s[3].parent_id, s[2].breadcrumb) == (1, None, ["Introduction"])
    m = paper.metadata.first()
    assert m.title == "A Fine Title" and m.authors == ["Ann Lee", "Bo Ray"] and m.doi == "10.1234/abc.5"
    t = {r.section_id: r for r in paper.toc().withColumn("line", toc_line()).collect()}
    assert t[2].path == "1.1" and t[2].has_figures and "[2] Detail  p.0-0" in t[2].line and t[2].line.endswith("fig:1")
    assert paper.warnings.filter("kind = 'UnmatchedCaption'").count() == 0
    c = paper.coverage.first()
    assert 0 < c.ratio <= 1 and c.dropped_blocks == 1


def test_outputs(paper):
    md = paper.to_markdown(MarkdownConfig(front_matter=True, page_numbers=True)).first().text
    assert md.startswith('---\ntitle: "A Fine Title"') and "## Introduction\n\n<!-- page 0 -->\n\nBody one &amp; more" in md and "### Detail" in md
    assert "![Fig. 1](./images/p000_img001.png)\n\n*Fig. 1: a picture*" in md
    llm = paper.to_llm_text(LlmTextConfig(math="plain")).first().text
    assert "## Introduction\n\nBody one & more" in llm and "[IMAGE: Fig. 1 p000_img001.png]" in llm
    full = json.loads(paper.to_json().first().json)
    assert full["sections"][1]["children"][0]["figures"][0]["figure_id"] == "Fig. 1" and len(full["all_figures"]) == 1
    slim = json.loads(paper.to_content_json().first().json)
    assert slim["sections"][1]["children"][0]["breadcrumb"] == ["Introduction"] and "bbox" not in json.dumps(slim)
    picked = paper.select_sections(["introduction"])
    assert "Body two" in picked.to_markdown().first().text and picked.count().first().sections == 1
    assert [c.text for c in picked.to_chunks().collect()] == ["Body one & more text about things."]
    assert json.loads(picked.to_json().first().json)[0]["header"]["clean_text"] == "Introduction"
    assert [r.section_id for r in paper.select_sections_by_index([2, 0, 9, 2]).picks.orderBy("pick").collect()] == [2, 0, 2]
    assert {r.section_id for r in paper.select_sections_where(F.col("figure_count") > 0).picks.collect()} == {2}
    assert paper.select_sections_by_pages(1, 1).picks.count() == 1 and paper.select_sections_by_level(2).total_tokens().first().total_tokens > 0
    for strategy in ("section", "token", "paragraph"):
        rows = paper.to_chunks(ChunkConfig(max_tokens=30, overlap_tokens=4, strategy=strategy)).orderBy("chunk_id").collect()
        assert [r.chunk_id for r in rows] == list(range(len(rows)))
    rows = paper.to_chunks()
    assert any(r.text.startswith("[Context: Introduction > Detail]\n# Detail\n\n") for r in rows.collect())
    line = [json.loads(r.value) for r in paper.chunk_lines(rows).orderBy("chunk_id").collect()]
    assert line[2]["figures"][0]["image_path"] == "p000_img001.png" and line[2]["page_range"] == [0, 0]


def test_span_merge_and_lines(spark):
    rows = [span(0, "Hel", 10.0, 100.0), span(1, "lo", 25.0, 100.0), span(2, "world", 38.0, 100.2), span(3, "far", 200.0, 100.0), span(4, "next", 10.0, 80.0), span(5, "other", 26.0, 100.0, font="Arial")]
    merged = layout.merge_spans(spark.createDataFrame(rows, SPANS)).collect()
    assert "Hello" in " ".join(r.text for r in merged)
    lines = layout.lines(spark.createDataFrame(rows, SPANS)).orderBy("line_seq").collect()
    assert len(lines) == 2 and lines[1].text == "next" and lines[0].text.endswith(" far")


def test_two_columns_lose_no_line(spark):
    rows = [span(k * 20 + i, f"{c} line {i}", x, 700.0 - 14 * i - (3 if k else 0)) for k, (c, x) in enumerate([("left", 72.0), ("right", 320.0)]) for i in range(12)]
    d = DocumentSet(spark.createDataFrame(rows, SPANS), media=spark.createDataFrame([(1, 0, 612.0, 792.0)], "doc_id long, page int, width double, height double"))
    assert sum(r.n_lines for r in d.raw_blocks.collect()) == d.lines.count()
    assert DocumentSet(d.spans, config=Config(reading_order="column")).sections.count() == 1


def test_running_heads(spark):
    rows = [r for p in range(3) for r in (span(0, "JOURNAL", 72.0, 780.0, page=p), span(1, "Body text here", 72.0, 500.0, page=p), span(2, str(p + 1), 300.0, 30.0, page=p))]
    kinds = {(r.text, r.block_type) for r in DocumentSet(spark.createDataFrame(rows, SPANS)).blocks.collect()}
    assert ("JOURNAL", "RunningHeader") in kinds and ("1", "PageNumber") in kinds and ("Body text here", "BodyText") in kinds


def test_scalars(spark):
    d = spark.createDataFrame([("結論",), ("ＭＥＴＨＯＤ",), ("手法は以下の通り。",), ("ABC 12",), ("Fig. 3 Title",)], "t string")
    r = d.select("t", T.is_cjk_heading(F.col("t")).alias("cjk"), T.is_known_name(F.col("t"), ("METHOD", "結論")).alias("known"), T.is_all_caps(F.col("t")).alias("caps"), T.tokens(F.col("t")).alias("n"), T.caption_description(F.col("t")).alias("d")).collect()
    assert [x.cjk for x in r][:3] == [True, False, False] and [x.known for x in r][:2] == [True, True]
    assert [x.caps for x in r] == [False, True, False, True, False] and [x.n for x in r] == [T.py_tokens(x.t) for x in r] and r[4].d == "Title"


def test_scales_and_greedy_images(spark):
    dims = spark.createDataFrame([(1, p, 600.0, 800.0) for p in range(4)], "doc_id long, page int, width double, height double")
    box = "left double, top double, right double, bottom double"
    im = spark.createDataFrame([(1, 0, 0.0, 1.0, 600.0, 0.0), (1, 1, 0.0, 1.0, 1200.0, 0.0), (1, 2, 0.0, 1.0, 8.3, 0.0), (1, 3, 0.0, 1.0, 100.0, 0.0)], f"doc_id long, page int, {box}")
    got = {r.page: (round(r.scale, 6), r.fallback) for r in figures.image_scale(im, dims).collect()}
    assert got == {0: (1.0, False), 1: (0.5, False), 2: (72.0, False), 3: (1.0, True)}


def test_tables(spark):
    from foliant.plans.queries import _table_set

    d = _table_set(spark)
    found = tables.detect(d["blocks"], d["paths"], d["captions"], TableConfig())
    r = found.first()
    assert found.count() == 1 and r.has_rules and r.caption_number == 7 and len(r.block_ids) == 11
    g = tables.grids(found, d["blocks"]).first()
    assert g.column_count == 3 and g.header == [["r0c0", "r0c1", "r0c2"]] and g.rows[1] == ["r2c0", "", "r2c2"]
    plain = tables.detect(d["blocks"], d["paths"].limit(0), d["captions"], TableConfig())
    assert not plain.first().has_rules
    bare = tables.detect(d["blocks"], d["paths"].limit(0), d["captions"].limit(0), TableConfig(captionless=True))
    assert bare.count() == 1 and bare.first().caption_text is None
    assert tables.span_cells([["a", "", "b"], ["", "c", ""]]) == [
        [{"text": "a", "colspan": 1, "rowspan": 2}, {"text": "", "colspan": 1, "rowspan": 1}, {"text": "b", "colspan": 1, "rowspan": 2}],
        [{"text": "", "colspan": 0, "rowspan": 0}, {"text": "c", "colspan": 1, "rowspan": 1}, {"text": "", "colspan": 0, "rowspan": 0}],
    ]


def test_math():
    s = lambda t, f="Times", z=10.0, b=0.0: {"text": t, "font_name": f, "font_size": z, "bottom": b}
    spans = [s("x", "CMMI10"), s("2", "CMR7", 7.0, 4.0), s("≤"), s("α")]
    assert mathtext.to_latex(spans) == "x^{2}\\leq\\alpha" and mathtext.to_unicode(spans) == "x²≤α" and mathtext.to_plain(spans) == "x^(2)leqalpha"
    assert mathtext.equation_number([s("x"), s("(3.1)")]) == "(3.1)"
    assert mathtext.render_line([s("let "), s("β"), s(" be <")], mathtext.MathConfig(), True) == "let $β$ be &lt;"
    assert mathtext.delimited("x", True, "(2)", mathtext.MathConfig()) == "$$\nx \\tag{2}\n$$"


def test_chunk_folds():
    count = T.py_tokens
    text = "One sentence here. " * 40
    parts = C.split_paragraph(text, 20, count)
    assert "".join(parts) == text and all(count(p) <= 20 for p in parts)
    assert C.sentences("a. b! c？d") == ["a.", " b!", " c？", "d"]
    assert C.overlap("abcdefgh", 1, count) == "bcdefgh" and C.overlap("x", 0, count) == ""
    slow = lambda t: count(t)  # noqa: E731  the literal search gives what halving gives
    for t in ("x" * 50, "日本" * 30, "é" * 31 + "abc"):
        assert C.budget_end(t, 3, 5, count) == C.budget_end(t, 3, 5, slow) and C.overlap(t, 4, count) == C.overlap(t, 4, slow)
    with pytest.raises(ValueError):
        ChunkConfig(strategy="none")


def minimal_pdf(box=b"0 0 600 800", rotate=b"") -> bytes:
    body = b"BT /F1 12 Tf 72 700 Td (1 Intro) Tj 0 -40 Td [(Bo) -20 (dy \\(x\\))] TJ ET 50 600 300 0.5 re f 50 590 m 350 590 l S q 100 0 0 50 60 400 cm /Im1 Do Q"
    objs = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [" + box + b"] >>",
        b"<< /Type /Page /Parent 2 0 R " + rotate + b" /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> /XObject << /Im1 6 0 R >> >> >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body), b"<< /Type /Font /Subtype /Type1 /BaseFont /Times-Bold >>",
        b"<< /Type /XObject /Subtype /Image /Width 20 /Height 10 /Length 1 >>\nstream\nx\nendstream",
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i + 1, o) for i, o in enumerate(objs)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_page_files(spark, tmp_path, capsys):
    from foliant.__main__ import main
    from foliant.plans.api import analyze
    from foliant.streaming import files

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(minimal_pdf())
    (tmp_path / "in" / "b.pdf").write_bytes(b"broken")
    (tmp_path / "in" / "c.pdf").write_bytes(minimal_pdf(rotate=b"/Rotate 90"))
    d = analyze(spark, str(tmp_path / "in"))
    assert d.errors.count() == 1 and d.papers.filter("pages = 1").count() == 2
    assert {(r.width, r.height) for r in d.dims.collect()} == {(600.0, 800.0), (800.0, 600.0)}
    assert {r.text for r in d.clean.collect()} == {"1 Intro", "Body (x)"} and all(r.is_bold for r in d.clean.collect())
    assert {r.path_type for r in d.paths.collect()} == {"Horizontal"} and d.images.count() == 2
    assert main(["toc", str(tmp_path / "in" / "a.pdf")], spark) == 0
    assert "Intro" in capsys.readouterr().out
    assert main(["chunks", str(tmp_path / "in" / "a.pdf"), "--max-tokens", "50"], spark) == 0 and '"chunk_id":0' in capsys.readouterr().out
    seen = []
    q = files.start(files.stream(spark, str(tmp_path / "in")), str(tmp_path / "ck"), lambda docs, n: seen.append(docs.toc().count()))
    q.awaitTermination(120)
    assert sum(seen) >= 2


def lzw(data: bytes, early: int) -> bytes:
    """A plain encoder: the longest known word each time."""
    bits, table, width, word = "", {}, 9, b""
    known = lambda w: len(w) == 1 or w in table
    code = lambda w: w[0] if len(w) == 1 else table[w]
    bits += format(256, "09b")
    for i in range(len(data)):
        c = data[i : i + 1]
        if known(word + c):
            word += c
            continue
        bits += format(code(word), f"0{width}b")
        table[word + c] = 258 + len(table)
        width = max(9, min(12, (257 + len(table) + early).bit_length()))
        if len(table) == 3800:
            bits, table, width = bits + format(256, f"0{width}b"), {}, 9
        word = c
    bits += (format(code(word), f"0{width}b") if word else "")
    return int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("early", [0, 1])
def test_lzw_reads_what_a_plain_encoder_writes(early):
    import random

    from foliant.sources import pdf

    rng = random.Random(5)
    for size in (1, 2, 300, 60_000):
        for letters in (2, 256):
            data = bytes(rng.randrange(letters) for _ in range(size))
            assert pdf._lzw(lzw(data, early), early) == data
    with pytest.raises(pdf.PdfError):
        pdf._lzw(b"\x80\x7f\xff\xff", early)


def test_stream_filters():
    import base64
    import zlib

    from foliant.sources import pdf

    def read(raw, head):
        head = head.encode() + b" /Length %d" % len(raw)
        return pdf.Document(b"%PDF-1.4\n1 0 obj\n<< " + head + b" >>\nstream\n" + raw + b"\nendstream\nendobj\n").stream(pdf.Ref(1))

    text = b"BT (Hello) Tj ET " * 9
    assert read(base64.a85encode(text) + b"~>", "/Filter /ASCII85Decode") == text
    assert read(text.hex().encode() + b">", "/Filter [/ASCIIHexDecode]") == text
    assert read(bytes([2]) + b"abc" + bytes([254]) + b"x" + bytes([128]) + b"never", "/Filter /RunLengthDecode") == b"abcxxx"
    assert read(base64.a85encode(zlib.compress(text)), "/Filter [/ASCII85Decode /FlateDecode]") == text
    rows = [bytes((7 * r + 3 * i) % 256 for i in range(12)) for r in range(5)]
    made, above = b"", bytes(12)
    for rule, row in enumerate(rows):  # one row of each rule, three bytes a sample
        left, corner = bytes(3) + row[:-3], bytes(3) + above[:-3]
        paeth = lambda a, b, c: min((a, b, c), key=lambda v: abs(a + b - c - v))
        given = [bytes(12), left, above, [(a + b) // 2 for a, b in zip(left, above)], [paeth(*v) for v in zip(left, above, corner)]][rule]
        made += bytes([rule]) + bytes((v - g) & 255 for v, g in zip(row, given))
        above = row
    parms = "/DecodeParms << /Predictor 15 /Colors 3 /Columns 4 >>"
    assert read(zlib.compress(made), f"/Filter /FlateDecode {parms}") == b"".join(rows)
    added = b"".join(bytes((v - g) & 255 for v, g in zip(r, bytes(3) + r[:-3])) for r in rows)
    assert read(zlib.compress(added), "/Filter [/FlateDecode] /DecodeParms [<< /Predictor 2 /Colors 3 /Columns 4 >>]") == b"".join(rows)
    with pytest.raises(pdf.PdfError, match="filter Unknown"):
        read(text, "/Filter /Unknown")


def test_a_page_of_an_unknown_filter_is_told_of(spark):
    from foliant.plans.api import analyze_files

    bad = minimal_pdf().replace(b"endobj\n4 0 obj\n<< ", b"endobj\n4 0 obj\n<< /Filter /Unknown ")
    data = [("good.pdf", bytearray(minimal_pdf())), ("bad.pdf", bytearray(bad))]
    d = analyze_files(spark.createDataFrame([(p, len(x), x) for p, x in data], "path string, length long, content binary"))
    assert [r.reason for r in d.errors.collect()] == ["PageSkipped: filter Unknown"]
    assert [(r.width, r.height, r.reason) for r in d.page_dimensions(0).filter("reason is null").collect()].count((600.0, 800.0, None)) >= 1
    assert [(r.width, r.height, r.reason) for r in d.page_dimensions(1).collect()] == [(None, None, "PageOutOfRange")] * 2
    with pytest.raises(ValueError):
        d.page_dimensions(-1)


def test_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_synth_queries_hold_whole_texts(spark, tmp_path):
    from foliant.plans.queries import QUERIES
    from foliant.sources import synth

    line = lambda i: "".join(f"w{i}x{k} " for k in range(20)).strip()
    docs = [(1, line(0)), (2, "\n".join(line(i) for i in range(23))), (3, "\n".join(line(i) for i in range(9))), (4, "short"), (5, " \n"), (6, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    bare = lambda x: "".join((x or "").split())
    rows = synth.spans(d).filter("text <> 'Journal of Synthetic Layout' and span_seq % 100 <> 90").orderBy("doc_id", "span_seq").collect()
    for doc, text in docs:
        got = [r for r in rows if r.doc_id == doc]
        lines = [bare(x) for x in (text or "").split("\n") if bare(x)]
        assert len({r.span_seq for r in got}) == len(got)
        joined, at = bare("".join(r.text for r in got)), 0
        for x in lines:  # prefixes such as "Fig. 1: " stand before a line, nothing within it
            at = joined.index(x, at) + len(x)
    md = {r.doc_id: bare(r.text) for r in QUERIES["synth_markdown"](spark, str(tmp_path)).collect()}
    assert all(f"w{i}x19" in md[2] for i in range(23)) and "w0x19" in md[1]


def test_numbering_of_long_numbers(spark):
    """A number that no unsigned 32-bit integer holds is a section number too, and counts for the depth."""
    rows = ["16455460745 inges to.", "3.16455460745 x", "4294967295 y", "1." + "9" * 50 + ".2 z", "٣ w"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string").select("id", T.numbering(F.col("text")).alias("k"))
    got = [r.k and (r.k.prefix, r.k.rest, r.k.depth, [c.ord for c in r.k.components]) for r in d.orderBy("id").collect()]
    assert got == [("16455460745", "inges to.", 1, []), ("3.16455460745", "x", 2, [3]), ("4294967295", "y", 1, [4294967295]), ("1." + "9" * 50 + ".2", "z", 3, [1, 2]), None]


def test_long_number_header(spark):
    spans = [span(0, "1 Intro", 72.0, 700.0, 14.0, True), span(1, "Body of the first section.", 72.0, 660.0), span(2, "16455460745 inges to.", 72.0, 600.0), span(3, "Body of the second section.", 72.0, 560.0)]
    d = DocumentSet(spark.createDataFrame(spans, SPANS))
    assert [(r.section_id, r.header, r.numbering) for r in d.sections.orderBy("section_id").collect()] == [(0, "Intro", "1"), (1, "inges to.", "16455460745")]
    assert d.warnings.filter("kind = 'SectionNumberingAnomaly'").count() == 0


def test_chunk_lines_pack_once(paper, tmp_path):
    """The lines read the chunks three times; the packing behind them runs once."""
    log = str(tmp_path / "counted")

    def counter():
        from foliant.functions.text import py_tokens

        def count(text):
            with open(log, "a") as f:
                f.write("x")
            return py_tokens(text)

        return count

    rows = paper.to_chunks(ChunkConfig(max_tokens=30, overlap_tokens=4), counter)
    n = len(rows.collect())
    once = len(open(log).read())
    assert len(paper.chunk_lines(rows).collect()) == n and len(open(log).read()) == 2 * once


def test_kept_blocks_know_their_sections(paper):
    """Nothing is sorted or numbered again above the kept blocks."""
    plan = lambda node: [node.nodeName(), *[x for i in range(node.children().size()) for x in plan(node.children().apply(i))]]
    names = plan(paper.section_blocks._jdf.queryExecution().withCachedData())
    assert {"InMemoryRelation", "LogicalRDD"} & set(names) and "Window" not in names
    assert not {"reading_seq", "section_id"} & set(paper.blocks.columns)
