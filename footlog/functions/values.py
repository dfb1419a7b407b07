"""Property access, rounding, buckets and distinct counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlog.model import DAY_MS

PROPERTY_KEY = r"^[A-Za-z0-9_-]{1,40}$"


def prop(key: str, props: str = "props") -> Column:
    """Text of a JSON property; null when absent."""
    return F.get_json_object(F.col(props), f"$['{key}']")


def prop_text(key: str, props: str = "props") -> Column:
    """Text of a property as it compares in filters: booleans read '1' and '0'."""
    value = prop(key, props)
    return F.when(value == "true", "1").when(value == "false", "0").otherwise(value)


def number(key: str, props: str = "props") -> Column:
    return prop(key, props).try_cast("double")


def round_to(value: Column, digits: int = 0) -> Column:
    """Round half up in IEEE arithmetic (no decimal conversion, stays in generated code)."""
    scale = 10.0**digits
    return F.floor(value.cast("double") * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def ratio(part: Column, whole: Column, digits: int, scale: float = 1.0) -> Column:
    """Rounded ``scale * part / whole``; null on an empty base."""
    return F.when(whole > 0, round_to(F.lit(scale) * part / whole, digits))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return ratio(part, whole, digits, 100.0)


def bucket_of(ts: Column | str, start_ms: int, width_ms: int) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor((ts - F.lit(start_ms)) / F.lit(width_ms)).cast("long")


def day_of(ts: Column | str = "ts") -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(ts / F.lit(DAY_MS)).cast("long")


def count_when(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def distinct(column: str, when: Column | None = None) -> Column:
    """Distinct values of a column, over the rows that meet ``when``."""
    return F.countDistinct(F.col(column) if when is None else F.when(when, F.col(column)))


def per_visitor(rows: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """One row per key and visitor: the ``sums``, and ``sessions``.

    A session has one visitor, so folding to sessions and then to visitors counts both without a distinct count, which
    would read every event once for each of them. ``sums`` are aggregates that may be summed again.
    """
    by_session = rows.groupBy(*keys, "visitor_id", "session_id").agg(*[c.alias(n) for n, c in sums.items()], F.lit(1).alias("_session"))
    return by_session.groupBy(*keys, "visitor_id").agg(*[F.sum(n).alias(n) for n in sums], F.sum("_session").alias("sessions"))


def flag(condition: Column) -> Column:
    """1 when any row of the group meets the condition, else 0."""
    return F.max(F.when(condition, 1).otherwise(0))


def in_order() -> Column:
    """Event order inside a group: time, then arrival."""
    return F.struct("ts", "ingest_seq")
