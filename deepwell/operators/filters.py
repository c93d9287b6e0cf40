"""The JSON metadata filter, compiled to one Column.

``compile_filter(spec, resolve)`` takes an object of clauses (implicitly all must hold): ``$and``/``$or`` with arrays,
``$not`` with an object, or a dotted path with a value (equality) or an object of operators. Logic is two-valued: a
missing or null value makes a leaf false, apart from ``ne``, ``nin`` and ``exists: false``, which it makes true.

``typed(df)`` resolves paths to the table's own columns, so positive comparisons reach the Parquet scan as pushed
filters; ``variant("metadata")`` resolves them within a VARIANT column, guarded by the stored type.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidFilterError

DEEPEST = 32
_LOGIC = {"$and", "and", "$or", "or", "$not", "not"}
_NAMES = {"eq", "ne", "in", "nin", "not_in", "gt", "gte", "lt", "lte", "contains", "contains_any", "contains_all", "exists", "prefix"}


def _false() -> Column:
    return F.lit(False)


def _true() -> Column:
    return F.lit(True)


class Value:
    """A typed view of the value at a path; each method is null where the value has another type."""

    def present(self) -> Column:
        raise NotImplementedError

    def equals(self, literal: Any) -> Column:
        raise NotImplementedError

    def compared(self, literal: Any, op: str) -> Column:
        raise NotImplementedError

    def holds(self, literal: Any) -> Column:
        raise NotImplementedError

    def starts(self, prefix: str) -> Column:
        raise NotImplementedError


class Missing(Value):
    def present(self) -> Column:
        return _false()

    def equals(self, literal: Any) -> Column:
        return _false()

    def compared(self, literal: Any, op: str) -> Column:
        return _false()

    def holds(self, literal: Any) -> Column:
        return _false()

    def starts(self, prefix: str) -> Column:
        return _false()


def _is_number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _order(a: Column, b: Column, op: str) -> Column:
    return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]


class Typed(Value):
    def __init__(self, column: Column, kind: T.DataType):
        self.column, self.kind = column, kind

    def present(self) -> Column:
        return self.column.isNotNull()

    def _number(self, literal: Any) -> tuple[Column, Column]:
        """Both sides in one type; the column stays bare where that is exact, so that it can be pushed down."""
        whole = isinstance(self.kind, T.IntegralType)
        if (whole and isinstance(literal, int) and abs(literal) < 1 << 31) or isinstance(self.kind, T.DoubleType):
            return self.column, F.lit(literal if whole else float(literal))
        return self.column.cast("double"), F.lit(float(literal))

    def equals(self, literal: Any) -> Column:
        if _is_number(literal) and isinstance(self.kind, T.NumericType):
            a, b = self._number(literal)
            return a == b
        if isinstance(literal, str) and isinstance(self.kind, T.StringType) or isinstance(literal, bool) and isinstance(self.kind, T.BooleanType):
            return self.column == F.lit(literal)
        if isinstance(literal, list) and isinstance(self.kind, T.ArrayType):
            same = F.size(self.column) == len(literal)
            for i, x in enumerate(literal):
                item = F.get(self.column, F.lit(i))
                same = same & (item.isNull() if x is None else Typed(item, self.kind.elementType).equals(x))
            return same
        if isinstance(literal, dict) and isinstance(self.kind, T.StructType) and set(literal) == set(self.kind.names):
            same = self.column.isNotNull()
            for name, x in literal.items():
                field = self.column.getField(name)
                same = same & (field.isNull() if x is None else Typed(field, self.kind[name].dataType).equals(x))
            return same
        return _false()

    def compared(self, literal: Any, op: str) -> Column:
        if _is_number(literal) and isinstance(self.kind, T.NumericType):
            a, b = self._number(literal)
            out = _order(a, b, op)
            return out & ~F.isnan(self.column) if isinstance(self.kind, (T.DoubleType, T.FloatType)) and op in ("gt", "gte") else out
        if isinstance(literal, str) and isinstance(self.kind, T.StringType):
            return _order(self.column, F.lit(literal), op)
        return _false()

    def holds(self, literal: Any) -> Column:
        if isinstance(self.kind, T.ArrayType):
            kind = self.kind.elementType
            return F.exists(self.column, lambda x: F.coalesce(Typed(x, kind).equals(literal), _false())) if literal is not None else F.exists(self.column, lambda x: x.isNull())
        if isinstance(literal, str) and isinstance(self.kind, T.StringType):
            return self.column.contains(literal)
        return _false()

    def starts(self, prefix: str) -> Column:
        return self.column.startswith(prefix) if isinstance(self.kind, T.StringType) else _false()


class Variant(Value):
    def __init__(self, value: Column):
        self.value = value
        self.type = F.schema_of_variant(value)

    def _if(self, pattern: str, kind: str) -> Column:
        """The value as ``kind`` where its stored type matches; strings of digits stay strings."""
        return F.when(self.type.rlike(pattern), F.try_variant_get(self.value, "$", kind))

    def _text(self) -> Column:
        return self._if("^STRING", "string")

    def present(self) -> Column:
        return self.value.isNotNull() & ~F.is_variant_null(self.value)

    def equals(self, literal: Any) -> Column:
        if _is_number(literal):
            return self._if("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)", "double") == F.lit(float(literal))
        if isinstance(literal, bool):
            return self._if("^BOOLEAN", "boolean") == F.lit(literal)
        if isinstance(literal, str):
            return self._text() == F.lit(literal)
        if literal is None:
            return _false()
        return F.to_json(self.value) == F.lit(json.dumps(literal, separators=(",", ":"), sort_keys=True, ensure_ascii=False))

    def compared(self, literal: Any, op: str) -> Column:
        if _is_number(literal):
            return _order(self._if("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)", "double"), F.lit(float(literal)), op)
        return _order(self._text(), F.lit(literal), op) if isinstance(literal, str) else _false()

    def holds(self, literal: Any) -> Column:
        items = self._if("^ARRAY", "array<variant>")
        member = F.exists(items, lambda x: F.coalesce(Variant(x).equals(literal) if literal is not None else F.is_variant_null(x), _false()))
        return F.coalesce(member, self._text().contains(literal)) if isinstance(literal, str) else member

    def starts(self, prefix: str) -> Column:
        return self._text().startswith(prefix)


def typed(df: DataFrame) -> Callable[[str], Value]:
    """Dotted paths over the columns and struct fields of ``df``; unknown paths are missing everywhere."""
    schema = df.schema

    def resolve(path: str) -> Value:
        if path in schema.names:
            return Typed(F.col(f"`{path}`"), schema[path].dataType)
        first, *rest = path.split(".")
        if first not in schema.names:
            return Missing()
        column, kind = F.col(f"`{first}`"), schema[first].dataType
        for name in rest:
            if isinstance(kind, T.VariantType):
                return Variant(F.try_variant_get(column, "$" + "".join(f"['{n}']" for n in path.split(".")[1:]), "variant"))
            if not isinstance(kind, T.StructType) or name not in kind.names:
                return Missing()
            column, kind = column.getField(name), kind[name].dataType
        return Typed(column, kind)

    return resolve


def variant(column: str) -> Callable[[str], Value]:
    def resolve(path: str) -> Value:
        if "'" in path:
            raise InvalidFilterError(f"path {path!r} holds a quote")
        return Variant(F.try_variant_get(F.col(column), "$" + "".join(f"['{n}']" for n in path.split(".")), "variant"))

    return resolve


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise InvalidFilterError(message)


def _leaf(value: Value, name: str, x: Any) -> Column:
    sure = lambda c: F.coalesce(c, _false())
    if name == "exists":
        _need(isinstance(x, bool), "exists takes true or false")
        return value.present() if x else ~sure(value.present())
    if name == "eq":
        return _false() if x is None else value.equals(x)
    if name == "ne":
        return value.present() if x is None else ~sure(value.equals(x))
    if name in ("in", "nin", "not_in"):
        _need(isinstance(x, list), f"{name} takes an array")
        found = _false()
        for item in x:
            if item is not None:
                found = found | value.equals(item)
        return found if name == "in" else ~sure(found)
    if name in ("gt", "gte", "lt", "lte"):
        return value.compared(x, name)
    if name == "contains":
        return value.holds(x)
    if name in ("contains_any", "contains_all"):
        _need(isinstance(x, list), f"{name} takes an array")
        out = _false() if name == "contains_any" else value.present()
        for item in x:
            out = out | sure(value.holds(item)) if name == "contains_any" else out & sure(value.holds(item))
        return out
    _need(isinstance(x, str), "prefix takes a string")
    return value.starts(x)


def _compile(spec: Any, resolve: Callable[[str], Value], depth: int) -> Column:
    _need(depth <= DEEPEST, f"nested deeper than {DEEPEST}")
    if spec is None:
        return _true()
    _need(isinstance(spec, dict), "a filter is an object")
    out = None
    for key, x in spec.items():
        if key in _LOGIC:
            name = key.lstrip("$")
            if name == "not":
                _need(isinstance(x, dict), "not takes an object")
                part = ~F.coalesce(_compile(x, resolve, depth + 1), _false())
            else:
                _need(isinstance(x, list), f"{name} takes an array")
                part = _true() if name == "and" else _false()
                for i, sub in enumerate(x):
                    inner = _compile(sub, resolve, depth + 1)
                    part = inner if i == 0 else part & inner if name == "and" else F.coalesce(part, _false()) | F.coalesce(inner, _false())
        elif isinstance(x, dict) and x:
            value, part = resolve(key), None
            for op, operand in x.items():
                name = op.removeprefix("$")
                _need(name in _NAMES, f"unknown operator {op!r}")
                leaf = _leaf(value, name, operand)
                part = leaf if part is None else part & leaf
        else:
            part = _leaf(resolve(key), "eq", x)
        out = part if out is None else out & part
    return _true() if out is None else out


def parse_filter(spec: dict | str | None) -> dict | None:
    if isinstance(spec, str):
        try:
            spec = json.loads(spec)
        except ValueError as e:
            raise InvalidFilterError(f"not JSON: {e}") from None
    return spec


def compile_filter(spec: dict | str | None, resolve: Callable[[str], Value]) -> Column:
    """For ``where``: null counts as false. For a flag, use ``flag``."""
    return _compile(parse_filter(spec), resolve, 0)


def flag(spec: dict | str | None, resolve: Callable[[str], Value]) -> Column:
    """True or false, never null."""
    return F.coalesce(compile_filter(spec, resolve), _false())


def validate_filter(spec: dict | str | None) -> None:
    """Raises InvalidFilterError; needs a session for its columns only."""
    _compile(parse_filter(spec), lambda path: Missing(), 0)


def filtered(df: DataFrame, spec: dict | str | None) -> DataFrame:
    return df.where(compile_filter(spec, typed(df)))


def mentions(spec: Any, field: str) -> bool:
    """Whether the filter touches ``field`` or something below it."""
    spec = parse_filter(spec) if isinstance(spec, str) else spec
    if isinstance(spec, list):
        return any(mentions(s, field) for s in spec)
    if not isinstance(spec, dict):
        return False
    return any(mentions(x, field) if key in _LOGIC else key == field or key.startswith(field + ".") for key, x in spec.items())


def both(*specs: dict | None) -> dict | None:
    """All of the filters that are given."""
    some = [s for s in specs if s]
    return some[0] if len(some) == 1 else {"$and": some} if some else None


def tenant(spec: dict | None, tenant_id: str, field: str = "tenant_id") -> dict | None:
    return both({field: {"$eq": tenant_id}}, spec)
