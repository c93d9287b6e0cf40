"""Each stage against what its own operator says of the stage's input."""

import pytest

import corpus_pipeline as C
from deepwell.llm.language import identify
from deepwell.llm.superminhash import near_duplicates


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rows = [(i, t, l, s, len(t) if t is not None else None) for i, t, l, s in corpus] + [(500, "write to me at anna.b@mail.example.com today " + " ".join(reversed(corpus[9][1].split())), "aa", "s1", 99)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(C.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "private_data", "source_mix", "packing"]
    one = C.written(stages["language_id"](spark, docs, folder), "t")
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {r.doc_id for r in identify(docs).where("keep").collect()}
    two = C.written(stages["near_dedup"](spark, one, folder), "t")
    gone = {r.doc_id for r in near_duplicates(one).where("NOT keep").collect()}
    assert gone and {r.doc_id for r in two.collect()} == {r.doc_id for r in one.collect()} - gone
    three = C.written(stages["private_data"](spark, two, folder), "t")
    before, after = ({r.doc_id: r for r in d.collect()} for d in (two, three))
    assert after.keys() == before.keys() and "[EMAIL]" in after[500].text and after[500].n_chars == len(after[500].text)
    four = C.written(stages["source_mix"](spark, three, folder), "t")
    assert set(four.columns) == set(columns)
    assert all(r.text in after[r.doc_id].text and len(r.text) == r.n_chars for r in four.collect())
    five = stages["packing"](spark, four, folder)
    assert sum(len(r.doc_ids) for r in five.collect()) >= four.where("text <> ''").count()


def test_run_gives_bins(spark, folder):
    assert C.run(spark, folder).count() > 0


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, group_id string, score double, key string, tags array<string>, meta map<string, int>"


@pytest.fixture(scope="module")
def odd(spark, corpus, tmp_path_factory):
    """Null ids and texts, repeated rows, a long text, and columns named like the operators' own."""
    path = tmp_path_factory.mktemp("odd")
    rows = [(i, t, l, s, 0, "g", 0.5, None, ["a", None], {"m": i}) for i, t, l, s in corpus if i < 200 or i >= 300]
    rows += [(None, rows[3][1], "aa", "s1", 0, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), rows[10], rows[10]]
    spark.createDataFrame(rows, EXTRA).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_keep_columns_and_defined_cases(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    schema = [(f.name, f.dataType) for f in docs.schema]
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, odd), name)
        assert [(f.name, f.dataType) for f in docs.schema] == schema, name
        rows = docs.collect()
        assert rows and all(r.text for r in rows if name in ("language_id", "near_dedup")), name
        assert any(r.doc_id is None for r in rows), name  # a row without an id has no copies: it stays
        if name != "source_mix":
            assert sum(r.doc_id == 10 for r in rows) == 3  # rows of one id are one document
    assert {tuple(r.tags) for r in rows if r.tags} == {("a", None)} and any(r.meta == {"m": r.doc_id} for r in rows)
    assert C.STAGES[-1][1](spark, docs, odd).count() > 0


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], EXTRA).write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
