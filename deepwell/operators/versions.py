"""Which documents are in force: absolute revocation and precedence within version groups."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..errors import ConfigurationError

VOCABULARIES: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "generic": (frozenset("current active published live valid in_force effective latest".split()), frozenset("superseded obsolete deprecated expired archived retired inactive withdrawn revoked".split())),
    "mlflow": (frozenset({"production"}), frozenset({"archived"})),
    "legal-ptbr": (frozenset({"vigente", "em vigor", "em_vigor"}), frozenset({"revogado", "revogada", "caduco", "caduca"})),
}
_ALIASES = (frozenset({"vigente"}), frozenset({"revogado"}))
CURRENT, UNKNOWN, SUPERSEDED = 0, 1, 2


def status_classes(vocabulary: str = "generic", current: Iterable[str] | None = None, superseded: Iterable[str] | None = None) -> tuple[frozenset[str], frozenset[str]]:
    """Lower-case statuses in force and out of force; lists that are given replace the vocabulary's."""
    if vocabulary not in VOCABULARIES:
        raise ConfigurationError(f"vocabulary {vocabulary!r}; expected one of {', '.join(sorted(VOCABULARIES))}")
    base = VOCABULARIES[vocabulary]
    clean = lambda xs: frozenset(str(x).strip().lower() for x in xs)
    on = clean(current) if current is not None else base[0] | (_ALIASES[0] if superseded is None else frozenset())
    off = clean(superseded) if superseded is not None else base[1] | (_ALIASES[1] if current is None else frozenset())
    if on & off:
        raise ConfigurationError(f"statuses in both classes: {', '.join(sorted(on & off))}")
    return on, off


def status_rank(status: Column, on: frozenset[str], off: frozenset[str]) -> Column:
    """0 in force, 2 out of force, 1 for all others and for none."""
    s = F.lower(F.trim(status))
    return F.when(s.isin(*sorted(on)), F.lit(CURRENT)).when(s.isin(*sorted(off)), F.lit(SUPERSEDED)).otherwise(F.lit(UNKNOWN))


_PARTIAL = re.compile(r"(\d{4})(?:-?(\d{2}))?(?:-?(\d{2}))?")


def effective_seconds(value: str | None, pattern: str | None = None) -> float | None:
    """Seconds since 1970 (UTC) of an ISO date or time, or of year, month and day as far as given; None if it can't be ordered."""
    text = str(value).strip() if value is not None else ""
    if not text:
        return None
    try:
        if pattern:
            t = datetime.strptime(text, pattern)
        else:
            try:
                t = datetime.fromisoformat(text)
            except ValueError:
                if not (m := _PARTIAL.fullmatch(text)):
                    return None
                t = datetime(int(m[1]), int(m[2] or 1), int(m[3] or 1))
    except ValueError:
        return None
    if t.tzinfo:
        t = t.astimezone(timezone.utc).replace(tzinfo=None)
    return (t - datetime(1970, 1, 1)).total_seconds()


def effective_date(value: Column, pattern: str | None = None) -> Column:
    """As DOUBLE. Distinct values are few, so each is parsed once per batch."""

    @F.pandas_udf("double")
    def parse(values: pd.Series) -> pd.Series:
        known = {v: effective_seconds(v, pattern) for v in values.dropna().unique()}
        return values.map(known).astype(float)

    return F.nanvl(parse(value.cast("string")), F.lit(None).cast("double"))


def latest(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """The row of each key that comes first."""
    w = W.partitionBy(by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def precedence(docs: DataFrame, vocabulary: str = "generic", group: str = "doc_group", status: str = "status", date: str = "effective_date", version: str = "version", by: tuple[str, ...] = (), pattern: str | None = None, absolute: bool = True, **classes: Iterable[str]) -> DataFrame:
    """One row per document, with ``status_rank``, ``place``, ``tied``, ``conflict``, ``keep`` and ``reason``.

    ``place`` ranks a group's documents by status, then date, then version; only metadata decides, so equals share a
    place. A document is dropped if it is out of force (with ``absolute``), or not first in a group of several.
    Documents without a group stand alone. ``by``: further keys, such as the query, within which groups are formed.
    """
    on, off = status_classes(vocabulary, **classes)
    fallback = F.coalesce(F.nullif(F.col(date).cast("string"), F.lit("")), F.col("valid_from").cast("string")) if "valid_from" in docs.columns else F.col(date).cast("string")
    rows = docs.withColumn("status_rank", status_rank(F.col(status).cast("string"), on, off)).withColumn("_date", F.coalesce(effective_date(fallback, pattern), F.lit(float("-inf")))).withColumn("_version", F.coalesce(F.expr(f"try_cast(`{version}` AS double)"), F.lit(float("-inf"))))
    of = W.partitionBy(*by, group)
    order = of.orderBy("status_rank", F.desc("_date"), F.desc("_version"))
    grouped = F.col(group).isNotNull()
    rows = rows.withColumn("place", F.when(grouped, F.rank().over(order)).otherwise(F.lit(1))).withColumn("_n", F.when(grouped, F.count("*").over(of)).otherwise(F.lit(1)))
    rows = rows.withColumn("tied", grouped & (F.col("_n") > 1) & (F.sum((F.col("place") == 1).cast("int")).over(of) > 1) & (F.col("place") == 1))
    lost = F.when(F.lit(absolute) & (F.col("status_rank") == SUPERSEDED), F.lit("status declares the document superseded")).when(F.col("place") > 1, F.lit("another document of its group takes precedence"))
    return rows.withColumn("conflict", F.col("_n") > 1).withColumn("reason", lost).withColumn("keep", lost.isNull()).drop("_date", "_version", "_n")


def unrecognized_statuses(docs: DataFrame, vocabulary: str = "generic", status: str = "status", **classes: Iterable[str]) -> DataFrame:
    """The statuses that neither class knows."""
    on, off = status_classes(vocabulary, **classes)
    return docs.where(F.col(status).isNotNull() & (status_rank(F.col(status).cast("string"), on, off) == UNKNOWN)).select(F.col(status).cast("string").alias("status")).distinct()


def unparseable_dates(docs: DataFrame, date: str = "effective_date", pattern: str | None = None) -> DataFrame:
    return docs.where(F.col(date).isNotNull() & effective_date(F.col(date), pattern).isNull()).select(F.col(date).cast("string").alias("date")).distinct()
