import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): two made-up languages, exact and near copies, nulls, an empty and a long text."""
    r = random.Random(3)
    tongues = {l: ["".join(r.choice(a) for _ in range(r.randint(3, 8))) for _ in range(300)] for l, a in {"aa": "bcdeaiou", "bb": "xyzwüqkä"}.items()}
    rows = []
    for i in range(120):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, sentence(r, tongues[lang], r.randint(60, 160)) + ".", lang, f"s{i % 3}"))
    rows += [(200, rows[4][1], "bb", "s0"), (201, rows[4][1], "bb", "s0"), (202, rows[5][1].replace(" ", "  ") + " more", "aa", "s1")]
    words = rows[7][1].split()
    words[40] = "changed"
    rows.append((203, " ".join(words), "aa", "s1"))
    rows += [(300, None, "aa", "s0"), (301, "", "bb", "s0"), (302, "   \n ", None, None), (303, "hi", None, "s1"), (304, sentence(r, tongues["aa"], 20000), "aa", "s2")]
    return rows


@pytest.fixture
def docs(spark, corpus):
    rows = [(i, t, l, s, len(t) if t is not None else None) for i, t, l, s in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def crowded(docs):
    """With columns named like the operators' own."""
    from pyspark.sql import functions as F

    return docs.withColumns({n: F.lit("x") for n in ("group_id", "keep", "score", "key", "gram", "rep", "bands", "kind", "language", "threshold", "tokens", "bin", "slot", "h1", "_gone", "epoch")})


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)
