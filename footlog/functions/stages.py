"""Column stages written as Spark SQL text.

Each stage is one projection over named columns. A column that later stages read more than once stays a
projection of its own, so nothing is evaluated twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def staged(rows: DataFrame, *stages: dict[str, str]) -> DataFrame:
    """Add columns in order: every stage may read what the ones before it made."""
    for stage in stages:
        rows = rows.withColumns({name: F.expr(text) for name, text in stage.items()})
    return rows


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(texts: list[str]) -> str:
    return "(" + ", ".join(quoted(t) for t in texts) + ")"


def strip(text: str) -> str:
    """Trim any white space, not only blanks."""
    return rf"regexp_replace({text}, r'^\s+|\s+$', '')"


def dropped(rows: DataFrame) -> DataFrame:
    """Without the working columns, whose names start with an underscore."""
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])
