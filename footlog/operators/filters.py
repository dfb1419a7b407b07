"""Filters and segments (D2 to D11): row fields, properties and facts about the whole session."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlog.functions.values import PROPERTY_KEY, distinct, in_order, prop_text
from footlog.model import Scope, is_event, is_pageview
from footlog.operators.ordered import top_per
from footlog.sources.session_days import of_sessions

# What may be filtered on, and how.
ROW_FIELDS = (
    "country region city device browser os channel source lang path title hostname query referrer_host "
    "utm_source utm_medium utm_campaign utm_term utm_content screen tag"
).split()
SESSION_FIELDS = ["event", "entry_page", "exit_page"]
OPS = ["is", "is_not", "contains", "not_contains", "starts_with", "regex", "not_regex"]
MAX_FILTERS = 8
MAX_VALUE = 200
SUGGESTIONS = 50


class FilterError(ValueError):
    """A filter that cannot be applied; refused rather than ignored."""


@dataclass(frozen=True)
class Filter:
    field: str
    value: str
    op: str = "is"

    def __post_init__(self) -> None:
        known = self.field in ROW_FIELDS or self.field in SESSION_FIELDS or self.property_key is not None
        if not known:
            raise FilterError(f'cannot filter on "{self.field}"')
        if self.op not in OPS:
            raise FilterError(f'unknown filter operator "{self.op}"')
        if not self.value:
            raise FilterError(f'filter "{self.field}" has no value')
        if len(self.value) > MAX_VALUE:
            raise FilterError(f'filter "{self.field}" value is too long')

    @property
    def property_key(self) -> str | None:
        key = self.field.removeprefix("prop:")
        return key if key != self.field and re.match(PROPERTY_KEY, key) else None

    @property
    def about_session(self) -> bool:
        return self.field in SESSION_FIELDS

    def test(self, column: Column) -> Column:
        """The comparison; null stays null, so a missing property is never matched."""
        folded, wanted = F.lower(column), self.value.lower()
        match self.op:
            case "is":
                return column == self.value
            case "is_not":
                return column != self.value
            case "contains":
                return folded.contains(wanted)
            case "not_contains":
                return ~folded.contains(wanted)
            case "starts_with":
                return folded.startswith(wanted)
            case "regex":
                return column.rlike(self.value)
            case _:
                return ~column.rlike(self.value)

    def column(self) -> Column:
        return prop_text(self.property_key) if self.property_key else F.col(self.field)


def row_predicate(filters: tuple[Filter, ...]) -> Column:
    """The row-level filters as one condition, ready to be pushed into the scan."""
    condition = F.lit(True)
    for item in filters:
        if not item.about_session:
            condition = condition & item.test(item.column())
    return condition


def sessions_matching(site_events: DataFrame, item: Filter) -> DataFrame:
    """Sessions a session filter selects, over all of the site's history."""
    if item.field == "event":
        fired = site_events.where(is_event() & item.test(F.col("name")))
        return fired.select("site_id", "session_id").distinct()
    pick = F.min_by if item.field == "entry_page" else F.max_by
    edge = site_events.where(is_pageview()).groupBy("site_id", "session_id").agg(pick("path", in_order()).alias("path"))
    return edge.where(item.test(F.col("path"))).select("site_id", "session_id")


def keep_sessions(rows: DataFrame, site_events: DataFrame, filters: tuple[Filter, ...], sessions: DataFrame | None = None) -> DataFrame:
    """Rows of the sessions every session filter selects. First and last pages come from the side table ``sessions``, if
    given; what else a session holds is looked up in ``site_events``."""
    keys, about = ["site_id", "session_id"], [f for f in filters if f.about_session]
    pages = [f for f in about if f.field != "event"] if sessions is not None else []
    if pages:  # all of them in one reading of the side table
        tests = [f.test(F.col("entry.path" if f.field == "entry_page" else "leave.path")) for f in pages]
        rows = rows.join(of_sessions(sessions, rows).where(reduce(and_, tests)), keys, "left_semi")
    for item in about:
        if item not in pages:
            # Only the sessions at hand are looked up in all history.
            near = site_events.join(rows.select(*keys).distinct(), keys, "left_semi")
            rows = rows.join(sessions_matching(near, item), keys, "left_semi")
    return rows


def apply_filters(rows: DataFrame, site_events: DataFrame, filters: tuple[Filter, ...], sessions: DataFrame | None = None) -> DataFrame:
    """All filters AND-ed: row conditions first (they reach the scan), then semi-joins on the session."""
    if len(filters) > MAX_FILTERS:
        raise FilterError(f"at most {MAX_FILTERS} filters at once")
    if not filters:
        return rows
    return keep_sessions(rows.where(row_predicate(filters)), site_events, filters, sessions)


def matched_values(scope: Scope, item: Filter) -> DataFrame:
    """The distinct values a pattern selects, shown beside the number it produced."""
    column = F.col("name") if item.field == "event" else F.col("path") if item.about_session else item.column()
    values = scope.site_events().select("site_id", column.alias("value")).where(item.test(F.col("value")))
    return values.distinct()


def suggestions(scope: Scope, field: str, search: str = "", limit: int | None = SUGGESTIONS) -> DataFrame:
    """Values of a field seen in the window, most sessions first."""
    rows = scope.rows(filtered=False)
    item = Filter(field, "x")
    if item.property_key:
        rows = rows.where(is_event())
        column = prop_text(item.property_key)
    elif field == "event":
        rows, column = rows.where(is_event()), F.col("name")
    elif item.about_session or field in ("path", "title"):
        rows = rows.where(is_pageview())
        column = F.col("path") if item.about_session else F.col(field)
    else:
        column = F.col(field)
    named = rows.select("site_id", "session_id", column.alias("value")).where(F.col("value").isNotNull())
    if not item.property_key:
        named = named.where(F.col("value") != "")
    if search:
        named = named.where(F.lower("value").contains(search.lower()))
    counted = named.groupBy("site_id", "value").agg(distinct("session_id").alias("sessions"))
    return top_per(counted, limit, [F.desc("sessions"), F.asc("value")])
