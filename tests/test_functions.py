import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deepwell.functions import text as X
from deepwell.functions import vectors as V
from deepwell.functions.embedding import HashedNgrams, embed, resolve_embedding
from deepwell.errors import ConfigurationError, DimensionMismatchError, MissingDependencyError
from deepwell.operators.chunking import estimate
from deepwell.operators.context import terms

TEXTS = ["", " ", "Hello, World 42!", "ΟΔΟΣ und straße", "退款refund申请", "東", "สวัสดี ครับ", "a_b-c d", "naïve café №5", "one\ttwo\nthree four", "x" * 400, "中文句子。第二句！third? yes."]


def column(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in rows.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_tokens(spark):
    got = dict(zip(TEXTS, column(spark, TEXTS, X.tokenize)))
    assert got["Hello, World 42!"] == ["hello", "world", "42"]
    assert got["退款refund申请"] == ["退款", "refund", "申请"]
    assert got["東"] == ["東"] and got["ΟΔΟΣ und straße"][0] == "οδοσ"
    assert got["a_b-c d"] == ["a", "b", "c", "d"]
    for t in ("Hello, World 42!", "退款refund申请", "東", "a_b-c d", "ΟΔΟΣ und straße"):
        assert got[t] == terms(t)


def test_estimates_agree_with_the_python_twin(spark):
    assert column(spark, TEXTS, X.estimate_tokens) == [estimate(t) for t in TEXTS]
    assert estimate("中" * 35) == 24 and estimate("") == 0 and estimate("a") == 1


def test_small_functions(spark):
    row = spark.range(1).select(
        X.citation_markers(F.lit("a [2] b [1][2] [x] [30]")).alias("marks"),
        X.sanitize_citations(F.lit("Yes [1]. No [9]  then [3]."), F.lit(3)).alias("clean"),
        X.sanitize_citations(F.lit("left  as is [1]"), F.lit(3)).alias("same"),
        X.without_markers(F.lit("It rains [1] .")).alias("bare"),
        X.occurrences(F.lit("aaaa b"), F.lit("aa")).alias("n"),
        X.heading(F.lit("## Two words \nbody")).alias("h"),
        X.heading(F.lit("no heading")).alias("none"),
        X.split_sentences(F.lit("One. Two! 三。四")).alias("s"),
        X.query_key(F.lit("  A  b\tC ")).alias("key"),
        X.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"), F.lit("b"))).alias("o"),
    ).first()
    assert row.marks == [2, 1, 30] and row.clean == "Yes [1]. No then [3]." and row.same == "left  as is [1]"
    assert row.bare == "It rains." and row.n == 2 and tuple(row.h) == (2, "Two words") and row.none is None
    assert row.s == ["One.", "Two!", "三。", "四"] and row.key == "a b c" and row.o == 0.5


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = rows.select(V.dot(a, b).alias("d"), V.l2_squared(a, b).alias("l"), V.cosine(a, b).alias("c"), V.normalize(a).alias("n"), V.int8_codes(a).alias("q"), V.is_valid(a, 2).alias("ok"), V.is_valid(a, 3).alias("bad")).collect()
    assert [r.d for r in got] == [24.0, 0.0] and [r.l for r in got] == [2.0, 2.0] and [round(r.c, 9) for r in got] == [0.96, 0.0]
    assert got[0].n == [0.6, 0.8] and got[1].n == [0.0, 0.0] and got[0].q == [95, 127] and got[1].q == [0, 0]
    assert all(r.ok and not r.bad for r in got)


def test_embedder(spark):
    e = HashedNgrams(64)
    got = column(spark, ["Some text", "some  TEXT", "", None], lambda t: embed(t, e))
    assert got[0] == got[1] and abs(sum(x * x for x in got[0]) - 1) < 1e-5 and not any(got[2]) and got[3] is None
    assert resolve_embedding("builtin:hashed-ngram:128").dimension == 128
    for wrong in ("other", "builtin:hashed-ngram:x", "builtin:hashed-ngram:4"):
        with pytest.raises(ConfigurationError):
            resolve_embedding(wrong)
    with pytest.raises(MissingDependencyError):
        resolve_embedding("local:multilingual")


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_estimate_is_zero_for_empty_texts_alone(t):
    assert (estimate(t) == 0) == (t == "")
