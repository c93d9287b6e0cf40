import pytest
from pyspark.sql import functions as F

from deepwell.errors import ConfigurationError, IngestionError, MissingDependencyError, VerificationError
from deepwell.operators import chunking, context, multiquery, nli, verification, versions
from deepwell.operators.chunking import Chunking, chunk_text
from deepwell.plans.config import Config
from deepwell.sources import parsers


def test_paragraphs_pack_up_to_the_target():
    text = "\n\n".join(f"Paragraph {i} " + "word " * 40 for i in range(12))
    out = chunk_text(text, Chunking(target_tokens=100, max_tokens=200))
    assert len(out) > 3 and all(p.tokens <= 110 for p in out)
    assert all(text[p.start : p.end].strip() == p.text for p in out)


def test_markdown_sections():
    out = chunk_text("# A\n\nintro\n\n## B\n\ntext b\n\n# C\n\ntext c", Chunking(), "md")
    assert [(p.section, p.text) for p in out] == [(["A"], "# A\n\nintro"), (["A", "B"], "## B\n\ntext b"), (["C"], "# C\n\ntext c")]
    assert chunk_text("# A\n\nintro", Chunking("recursive"), "md")[0].section == []


def test_oversized_paragraphs_overlap_and_wrap():
    out = chunk_text(" ".join(f"This is sentence number {i} of many." for i in range(200)), Chunking(target_tokens=60, max_tokens=90))
    assert len(out) > 10 and all(a.text.split(". ")[-1].rstrip(".") in b.text for a, b in zip(out, out[1:]))
    assert "".join(p.text for p in chunk_text("x" * 9000, Chunking(target_tokens=50, max_tokens=80))) == "x" * 9000
    assert chunk_text(None) == chunk_text("") == chunk_text(" \n ") == []
    with pytest.raises(ConfigurationError):
        Chunking("other")


def test_chunk_table_links(spark):
    df = spark.createDataFrame([("d", "\n\n".join(["word " * 300] * 3)), ("e", None), ("f", "one")], "document_id string, text string")
    out = chunking.chunk_documents(df).orderBy("document_id", "chunk_index").collect()
    assert [r.chunk_id for r in out] == ["d#0", "d#1", "d#2", "f#0"]
    assert [r.previous_chunk_id for r in out] == [None, "d#0", "d#1", None] and [r.next_chunk_id for r in out] == ["d#1", "d#2", None, None]


def candidate(i, text, doc="d", score=1.0, index=None, **more):
    return {"chunk_id": f"c{i}", "document_id": doc, "document_version": 1, "chunk_index": i if index is None else index, "text": text, "score": score, "token_count": None, "title": None, "section_path": [], "page_number": None, "uri": None, **more}


def test_caps_duplicates_and_budget():
    rows = [candidate(i, f"text number {i}", score=1 - i / 100) for i in range(6)] + [candidate(9, "text  number 0", "e")]
    got = context.assemble(rows, context.Budget(1000, 8, 3))
    assert [c["chunk_id"] for c in got["chunks"]] == ["c0", "c1", "c2"] and got["duplicates"] == 1 and got["blocks"] == 1
    long = context.assemble([candidate(0, "verylongword " * 800)], context.Budget(50))
    assert long["truncated"] and long["token_count"] <= 60 and "[truncated to fit token budget]" in long["context"]
    skip = context.assemble([candidate(0, "a b c"), candidate(1, "w " * 500, "e"), candidate(2, "d e f", "f")], context.Budget(20, diversity=1.0))
    assert [c["chunk_id"] for c in skip["chunks"]] == ["c0", "c2"]


def test_diversity_order_merge_and_citations(spark):
    rows = [candidate(0, "alpha beta", "x", 0.9), candidate(1, "alpha beta gamma", "x", 0.85), candidate(2, "other words", "y", 0.8, title="T", section_path=["A", "B"], page_number=3)]
    assert [r["chunk_id"] for r in context.diverse([dict(r) for r in rows], 0.7)] == ["c0", "c2", "c1"]
    df = spark.createDataFrame([(7, n, r["chunk_id"], r["document_id"], 1, r["chunk_index"], r["text"], r["score"], r["title"], r["section_path"], r["page_number"]) for n, r in enumerate(rows, 1)], "qid long, rank int, chunk_id string, document_id string, document_version long, chunk_index int, text string, score double, title string, section_path array<string>, page_number int")
    got = context.assemble_contexts(df).first()
    assert got.qid == 7 and got.context == "[1]\nalpha beta\nalpha beta gamma\n\n[2] T — A > B (page 3)\nother words"
    assert [c.chunk_ids for c in got.citations] == [["c0", "c1"], ["c2"]]
    chunks = df.select("chunk_id", "document_id", "document_version", "chunk_index", "text")
    wide = context.assemble_contexts(df.where("chunk_index = 0"), chunks=chunks, after=1).first()
    assert [(c.chunk_id, c.expanded) for c in wide.chunks] == [("c0", False), ("c1", True)]


def test_version_precedence(spark):
    rows = [("a", "g", "active", "2023-01-01", "1"), ("b", "g", "active", "2024-05", "1"), ("c", "g", "revoked", "2025-01-01", "9"), ("d", "h", "odd", "12/31/2023", "x"), ("e", "h", "odd", None, None), ("f", None, "obsolete", None, None)]
    df = spark.createDataFrame(rows, "document_id string, doc_group string, status string, effective_date string, version string")
    got = {r.document_id: r for r in versions.precedence(df).collect()}
    assert {i for i, r in got.items() if r.keep} == {"b", "d", "e"} and got["d"].tied and got["e"].tied and not got["b"].tied and got["f"].reason
    assert versions.precedence(df, absolute=False).where("document_id = 'f'").first().keep
    assert [r.status for r in versions.unrecognized_statuses(df).collect()] == ["odd"]
    assert [r.date for r in versions.unparseable_dates(df).collect()] == ["12/31/2023"]
    assert versions.effective_seconds("12/31/2023", "%m/%d/%Y") == versions.effective_seconds("2023-12-31") == versions.effective_seconds("20231231T000000Z")
    assert versions.effective_seconds("2024-13-01") is None and versions.effective_seconds("2023") == versions.effective_seconds("2023-01-01")
    with pytest.raises(ConfigurationError):
        versions.status_classes(current=["x"], superseded=["X "])


def test_subqueries_coverage_and_boosts(spark):
    q = spark.createDataFrame([(1, "What is A, what is B; what is  a")], "qid long, question string")
    subs = multiquery.subqueries(q, lambda t: F.split(t, "[,;]")).orderBy("sub_idx").collect()
    assert [s.text for s in subs] == ["What is A, what is B; what is  a", "What is A", "what is B"]
    hits = spark.createDataFrame([(1, s, 1.0, k, 1.0 / r, r) for s, ks in enumerate([["a", "b", "c"], ["a", "b"], ["a", "z"]]) for r, k in enumerate(ks, 1)], "qid long, sub_idx int, weight double, chunk_id string, score double, rank int")
    out = [(r.chunk_id, r.reserved) for r in multiquery.fused(hits).orderBy("rank").collect()]
    assert out == [("a", True), ("b", True), ("z", True), ("c", False)]
    assert [r.chunk_id for r in multiquery.fused(hits, coverage=0).orderBy("rank").collect()] == ["a", "b", "z", "c"]
    plain = hits.where("sub_idx = 0").select("qid", "chunk_id", "score", "rank").withColumn("kind", F.when(F.col("chunk_id") == "c", "x"))
    assert [r.chunk_id for r in multiquery.boosted(plain, [{"filter": {"kind": "x"}, "weight": 9}]).orderBy("rank").collect()] == ["c", "a", "b"]
    back = multiquery.reranked(plain, lambda qid, rows: rows[::-1][:1], 2)
    assert [r.chunk_id for r in back.orderBy("rank").collect()] == ["c", "a", "b"]
    bad = multiquery.reranked(plain, lambda qid, rows: 1 / 0, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in bad] == ["a", "b", "c"] and "ZeroDivisionError" in bad[0].rerank_error


def test_claims():
    for text, n in [("Dr. Smith paid 3.5 million. It rained [1]. [2] Then it stopped!", 3), ("第一句。第二句！", 2), ("One\n\nTwo", 2), ("No end", 1), ("", 0), ("Ask J. R. now. Yes.", 2)]:
        claims, gaps = verification.split_claims(text)
        assert len(claims) == n, (text, claims)
        assert "".join(c + g for c, g in zip(claims, [*gaps, ""])) == text.strip()


def test_verdicts_modes_and_failures(spark):
    evidence = ["The fee is ten euros.", "Returns take a week."]
    said = {"Fee": {"verdict": "supported", "quote": "ten euros"}, "Ret": {"verdict": "supported", "quote": "two weeks"}, "Non": {"verdict": "supported"}, "Odd": {"verdict": "maybe"}}
    judge = lambda q, claim, ev: said[claim[:3]]
    df = spark.createDataFrame([(1, "Fee is ten [1]. Returns are slow [2].\nNone of it. Odd one.", evidence)], "answer_id long, answer string, evidence array<string>")
    claims = verification.verify(df, judge)
    got = claims.orderBy("claim_no").collect()
    assert [r.verdict for r in got] == ["supported", "unsupported", "supported", "unsupported"] and [r.citations for r in got][:2] == [[1], [2]]
    assert "judge failed" in got[3].issue
    assert verification.apply_mode(claims, "repair").first().text == "Fee is ten [1]. None of it."
    assert verification.apply_mode(claims, "report").first().text == df.first().answer
    assert verification.apply_mode(claims.where("claim_no = 1"), "strict").first().text == verification.NOTHING_LEFT
    with pytest.raises(VerificationError):
        verification.apply_mode(claims, "guess")
    assert verification.check_ground("c", {"verdict": "supported", "quote": "a"}, ["a " * 20], "")[0] == "unsupported"
    assert verification.check_ground("c", {"verdict": "supported"}, [], "")[0] == "uncited"
    assert verification.check_ground("c", {"verdict": "question_fact", "quote": "So"}, [], "so what")[0] == "question_fact"


def test_nli_and_facets(spark):
    model = lambda pairs: [[3, 0, 0] if "yes" in p else [0, 0, 3] if "no" in p else [0, 3, 0] for p, _ in pairs]
    judge = nli.nli_judge(model)
    assert [judge("", "c", e)["verdict"] for e in (["no", "yes"], ["no"], ["so"], [])] == ["supported", "contradicted", "unsupported", "unsupported"]
    best = nli.calibrate(spark.createDataFrame([(0.2, 0), (0.4, 0), (0.6, 1), (0.9, 1)], "score double, label int")).first()
    assert best.accuracy == 1.0 and 0.4 < best.threshold <= 0.6
    want = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "answer_id long, facet string")
    told = spark.createDataFrame([(1, "a", True), (2, "a", True), (1, "b", False)], "answer_id long, facet string, covered boolean")
    assert {(r.answer_id, tuple(r.uncovered), r.complete) for r in verification.facets(want, told).collect()} == {(1, ("b",), False), (2, (), True)}


def test_parsers():
    page = parsers.parse_html("<html><head><title>T &amp; U</title><style>x</style></head><body><h1>A</h1><p>b<br>c</p><script>no()</script></body>")
    assert page.title == "T & U" and page.text == "A\nb\nc"
    assert parsers.parse_bytes("x/n.md", b"text\n## Head\n").title == "Head" and parsers.parse_bytes("a/b.txt", b"\xff").text == "�"
    assert parsers.parse_csv("a,b\n1,\n2,3\n").text == "a: 1\n\na: 2; b: 3" and parsers.parse_jsonl('{"text": "x"}\n\n[1]\n').text == "x\n\n[1]"
    assert parsers.parse_bytes("m.py", b"x=1").metadata == {"language": "py"}
    with pytest.raises(IngestionError):
        parsers.parse_json("{")
    with pytest.raises(MissingDependencyError):
        parsers.parse_pdf(b"")
    assert Config.resolve("quality", nprobe=4).candidates == 100
    with pytest.raises(ConfigurationError):
        Config.resolve("quality", depth=3)
