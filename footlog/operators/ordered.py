"""Ordered operators that keep no unbounded group in one task.

A window over a whole session or visitor puts every row of a hot key into one task. Here rows are
ordered only inside time slices, and slices are linked through one summary row each, so the largest
group is one slice of rows or one key's list of slices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footlog.model import HOUR_MS, SESSION_GAP_MS

SLICE = "_slice"
#: Spark trims groups before the exchange up to this many rows (its own default), and how a larger group is divided.
TRIMMED, PARTS = 1000, 256


def slice_of(width_ms: int, ts: str = "ts") -> Column:
    return F.floor(F.col(ts) / F.lit(width_ms)).cast("long")


def with_neighbour(
    rows: DataFrame,
    keys: list[str],
    values: dict[str, str],
    ahead: bool,
    width_ms: int = HOUR_MS,
    ts: str = "ts",
    tie: str = "ingest_seq",
) -> DataFrame:
    """Add columns of the next (``ahead``) or previous row of each key: ``values`` maps new name to column."""
    sliced = rows.withColumn(SLICE, slice_of(width_ms, ts))
    near = W.partitionBy(*keys, SLICE).orderBy(ts, tie)
    whole = near.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    step, border = (F.lead, F.first) if ahead else (F.lag, F.last)
    packed = F.struct(*[F.col(column).alias(name) for name, column in values.items()])
    stepped = sliced.select(
        "*", step(packed).over(near).alias("_near"), border(packed).over(whole).alias("_border")
    )
    inside = stepped.where(F.col("_near").isNotNull()).drop("_border", SLICE)
    # One row per key and slice has no neighbour inside its slice; it looks at the adjoining slice's border row.
    far = W.partitionBy(*keys).orderBy(SLICE)
    edges = (
        stepped.where(F.col("_near").isNull())
        .withColumn("_near", step("_border").over(far))
        .drop("_border", SLICE)
    )
    linked = inside.unionByName(edges)
    return linked.select(*[c for c in rows.columns], *[F.col(f"_near.{name}").alias(name) for name in values])


def sessionize(
    rows: DataFrame, keys: list[str], gap_ms: int = SESSION_GAP_MS, ts: str = "ts"
) -> DataFrame:
    """Add ``session_start`` and ``session_no``: a new session begins after more than ``gap_ms`` of silence.

    Rows of one slice as wide as the gap can never be apart by more than the gap, so the gaps are found
    on one (first, last) pair per slice and the answer is joined back to the rows.
    """
    sliced = rows.withColumn(SLICE, slice_of(gap_ms, ts))
    return sliced.join(session_slices(sliced, keys, gap_ms, ts), [*keys, SLICE]).drop(SLICE)


def session_slices(sliced: DataFrame, keys: list[str], gap_ms: int, ts: str = "ts") -> DataFrame:
    """One row per key and slice with the session it belongs to."""
    spans = sliced.groupBy(*keys, SLICE).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    along = W.partitionBy(*keys).orderBy(SLICE)
    running = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.lag("_hi").over(along)
    marked = spans.withColumn(
        "_new", F.when(before.isNull() | (F.col("_lo") - before > gap_ms), 1).otherwise(0)
    )
    return marked.select(
        *keys,
        SLICE,
        F.last(F.when(F.col("_new") == 1, F.col("_lo")), ignorenulls=True).over(running).alias("session_start"),
        F.sum("_new").over(running).cast("long").alias("session_no"),
    )


def top_per(
    rows: DataFrame, limit: int | None, order: list[Column], group: list[str] | None = None, offset: int = 0
) -> DataFrame:
    """The first ``limit`` rows of each group in ``order``; all of them without a limit.

    Up to TRIMMED rows Spark trims each partition before the exchange. For more, rows are ranked inside PARTS hashed
    parts of their group first, so no task orders a whole group; what each part keeps is ranked again.
    """
    if limit is None and not offset:
        return rows
    keys, ranked = group or ["site_id"], rows
    if limit is not None and offset + limit > TRIMMED:
        columns = [c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
        part = F.pmod(F.xxhash64(*columns), F.lit(PARTS))
        within = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))
        ranked = ranked.withColumn("_part", part).withColumn("_rank", within).where(F.col("_rank") <= offset + limit).drop("_part")
    ranked = ranked.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    if limit is not None:
        ranked = ranked.where(F.col("_rank") <= offset + limit)
    if offset:
        ranked = ranked.where(F.col("_rank") > offset)
    return ranked.drop("_rank")


def running_state(
    rows: DataFrame, keys: list[str], slices: str, order: list[str], last: dict[str, Column], sums: dict[str, Column] | None = None
) -> DataFrame:
    """Add running values per key: the latest non-null value of each ``last`` expression and running ``sums``.

    ``slices`` is a column that cuts a key's rows into consecutive pieces (a time slice, a chunk number).
    Rows are ordered inside a piece only; each piece passes one summary row on to the later ones.
    """
    sums = sums or {}
    marked = rows.withColumns({f"_u_{n}": e for n, e in (last | sums).items()})
    piece = [*keys, slices]
    within = W.partitionBy(*piece).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = marked.withColumns(
        {f"_l_{n}": F.last(f"_u_{n}", ignorenulls=True).over(within) for n in last}
        | {f"_l_{n}": F.sum(f"_u_{n}").over(within) for n in sums}
    )
    known = {n: F.when(F.col(f"_u_{n}").isNotNull(), F.struct(*order)) for n in last}
    ends = marked.groupBy(*piece).agg(
        *[F.max_by(f"_u_{n}", known[n]).alias(f"_e_{n}") for n in last], *[F.sum(f"_u_{n}").alias(f"_e_{n}") for n in sums]
    )
    before = W.partitionBy(*keys).orderBy(slices).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(
        *piece,
        *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in last],
        *[F.coalesce(F.sum(f"_e_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
    )
    joined = local.join(carried, piece)
    return joined.select(
        *rows.columns,
        *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in last],
        *[(F.col(f"_l_{n}") + F.col(f"_c_{n}")).alias(n) for n in sums],
    )


def as_of(left: DataFrame, right: DataFrame, keys: list[str], value: str, name: str, within_ms: int, width_ms: int | None = None) -> DataFrame:
    """Add the ``value`` of the latest ``right`` row at or before each ``left`` row, at most ``within_ms`` old; rows are
    ordered in slices of ``width_ms``, or of ``within_ms``."""
    columns = left.columns
    asks = left.withColumn("_side", F.lit(1)).withColumn("_told", F.lit(None).cast(right.schema[value].dataType))
    told = right.select(*keys, "ts", F.lit(0).alias("_side"), F.col(value).alias("_told"))
    both = asks.unionByName(told, allowMissingColumns=True).withColumn(SLICE, slice_of(width_ms or within_ms))
    fresh = F.when(F.col("_side") == 0, F.struct(F.col("ts").alias("at"), F.col("_told").alias("value")))
    state = running_state(both, keys, SLICE, ["ts", "_side"], {"_seen": fresh})
    recent = F.col("ts") - F.col("_seen.at") <= within_ms
    return state.where(F.col("_side") == 1).select(*columns, F.when(recent, F.col("_seen.value")).alias(name))


def reached(starts: DataFrame, jumps: DataFrame, keys: list[str], steps: int, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(keys, at): every place that is met by following ``jumps`` (keys, at, to) from ``starts`` (keys, at) on.

    Pointer doubling: the jumps are joined with themselves, so after n steps each leads 2 ** n places on, and what has been
    reached is doubled with them. No task walks a chain. ``cut`` stores a step's rows, so that plans do not grow.
    """
    for step in range(steps):
        ahead = starts.join(jumps, [*keys, "at"]).select(*keys, F.col("to").alias("at"))
        starts = cut(starts.unionByName(ahead).distinct(), f"reached-{step}")
        if step < steps - 1:
            onward = jumps.select(*keys, F.col("at").alias("to"), F.col("to").alias("_far"))
            jumps = cut(jumps.join(onward, [*keys, "to"]).select(*keys, "at", F.col("_far").alias("to")), f"jumps-{step}")
    return starts
