import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deepwell.errors import InvalidFilterError
from deepwell.operators import filters as X

ROWS = [
    {"n": 1, "s": "abc", "l": ["x", 2], "o": {"k": 5, "t": "z"}, "b": True},
    {"n": 1.0, "s": "5", "l": [], "o": {"k": None}},
    {"n": None, "s": "b", "b": False},
    {"n": -3.5, "l": [1, 2, 3]},
    {},
]


def holds(value, op, x):
    """The leaf rules, over Python values."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    eq = lambda a, b: a is not None and b is not None and (number(a) == number(b)) and isinstance(a, bool) == isinstance(b, bool) and type(a) in (type(b), int, float) and a == b
    if op == "exists":
        return (value is not None) == x
    if op == "ne":
        return value is not None if x is None else not eq(value, x)
    if op == "nin":
        return not any(eq(value, i) for i in x)
    if value is None:
        return False
    if op == "eq":
        return eq(value, x)
    if op == "in":
        return any(eq(value, i) for i in x)
    if op in ("gt", "gte", "lt", "lte"):
        if not (number(value) and number(x) or isinstance(value, str) and isinstance(x, str)):
            return False
        return {"gt": value > x, "gte": value >= x, "lt": value < x, "lte": value <= x}[op]
    has = lambda i: any(eq(v, i) for v in value) if isinstance(value, list) else isinstance(value, str) and isinstance(i, str) and i in value
    if op == "contains":
        return has(x)
    if op == "contains_any":
        return any(map(has, x))
    if op == "contains_all":
        return all(map(has, x))
    return isinstance(value, str) and value.startswith(x)


def get(row, path):
    for part in path.split("."):
        row = row.get(part) if isinstance(row, dict) else None
    return row


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(ROWS)], "i int, j string").select("i", F.parse_json("j").alias("m")).cache()


LEAVES = [(p, op, x) for p in ("n", "s", "o.k", "b", "gone") for op, x in [("eq", 1), ("eq", "5"), ("eq", 5), ("eq", True), ("eq", None), ("ne", 1), ("ne", None), ("ne", "abc"), ("in", [1, "b", False]), ("nin", [1, "b"]), ("gt", 0), ("lte", 1.0), ("gte", "b"), ("lt", "b"), ("exists", True), ("exists", False), ("prefix", "a"), ("contains", "b"), ("contains_any", ["c", "5"]), ("contains_all", [])]]
LEAVES += [("l", op, x) for op, x in [("contains", "x"), ("contains", 2), ("contains_any", [3, "x"]), ("contains_all", [1, 2]), ("contains_all", []), ("exists", True)]]


def test_every_leaf_over_variant_values(table):
    resolve = X.variant("m")
    out = table.select("i", *[X.flag({p: {op: x}}, resolve).alias(f"c{n}") for n, (p, op, x) in enumerate(LEAVES)]).orderBy("i").collect()
    for row, value in zip(out, ROWS):
        for n, (p, op, x) in enumerate(LEAVES):
            assert row[f"c{n}"] == holds(get(value, p), op, x), (value, p, op, x)


def test_not_is_the_complement_and_in_of_one_is_equality(table):
    resolve = X.variant("m")
    for p, op, x in LEAVES[::3]:
        a, b = table.where(X.compile_filter({p: {op: x}}, resolve)).count(), table.where(X.compile_filter({"$not": {p: {op: x}}}, resolve)).count()
        assert a + b == len(ROWS)
    assert table.where(X.compile_filter({"n": {"in": [1]}}, resolve)).count() == table.where(X.compile_filter({"n": 1}, resolve)).count() == 2


def test_typed_columns_agree_and_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, "ab", ["x"]), (2, float("nan"), None, []), (3, None, "b", None)], "i int, f double, s string, l array<string>")
    df.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    ids = lambda spec: sorted(r.i for r in X.filtered(t, spec).collect())
    assert ids({"f": {"gt": 1}}) == [1] and ids({"s": {"ne": "ab"}}) == [2, 3] and ids({"l": {"contains": "x"}}) == [1]
    assert ids({"$or": [{"s": "b"}, {"i": 2}]}) == [2, 3] and ids({"$not": {"f": {"lt": 9}}}) == [2, 3] and ids({"gone": {"exists": False}}) == [1, 2, 3]
    assert ids(None) == ids({}) == ids({"$and": []}) == [1, 2, 3] and ids({"$or": []}) == []
    plan = X.filtered(t, {"i": {"gte": 2}, "s": "b"})._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(i), IsNotNull(s), GreaterThanOrEqual(i,2), EqualTo(s,b)]" in plan


@pytest.mark.parametrize("wrong", ["{", [], {"a": {"$near": 1}}, {"$and": {}}, {"$not": []}, {"a": {"in": 3}}, {"a": {"prefix": 3}}, {"a": {"exists": 1}}])
def test_invalid_filters(spark, wrong):
    with pytest.raises(InvalidFilterError):
        X.validate_filter(wrong)


def test_depth_and_mentions(spark):
    deep = {"a": 1}
    for _ in range(40):
        deep = {"$not": deep}
    with pytest.raises(InvalidFilterError):
        X.validate_filter(deep)
    assert X.mentions({"$or": [{"x": 1}, {"$not": {"status.code": 2}}]}, "status") and not X.mentions({"x": {"eq": "status"}}, "status")


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab$", max_size=3), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["a", "$and", "or", "$not", "$in", "eq"]), c, max_size=3), max_leaves=8))
def test_arbitrary_json_compiles_or_is_invalid(spark, spec):
    try:
        X.validate_filter(spec)
    except InvalidFilterError:
        pass
