"""Exact nearest-rank percentiles of web vitals.

Rank = min(n, floor(p * n) + 1) on the sorted samples. The samples of one site can be a third of all
rows, so they are never sorted in one task: equal values are counted first, counts are summed into
magnitude bins, the bin holding the rank is found on those sums, and only that bin is ordered. Where the
scope has stored value counts and no filter, these are merged instead and no event of a whole day is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footlog.functions.values import bucket_of, round_to
from footlog.model import DAY_MS, MINUTE_MS, Scope
from footlog.operators.ordered import top_per
from footlog.sources import vital_days
from footlog.sources.vital_days import BUNDLE_DIGITS, DIGITS, DIMENSIONS, VITALS

PERCENTILES = [50, 75, 90, 99]
_BINS_PER_OCTAVE = 512
_BEFORE_ALL = -1_000_000


def _magnitude_bin(value: Column) -> Column:
    """A bin number that never decreases as the value grows; nulls come before all."""
    size = F.floor(F.log2(F.abs(value) * 1000 + 1) * _BINS_PER_OCTAVE).cast("long")
    return F.when(value.isNull(), F.lit(_BEFORE_ALL)).when(value < 0, -size).otherwise(size)


def nearest_rank(samples: DataFrame, keys: list[str], percentiles: list[int], times: Column | None = None) -> DataFrame:
    """Exact percentile values of column ``value`` per key; rows with null values rank first.

    ``times`` is how often a row counts, once if not given.
    """
    counts = (
        samples.withColumn("_bin", _magnitude_bin(F.col("value")))
        .groupBy(*keys, "_bin", "value")
        .agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("_n"))
    )
    along = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_m"))
    summed = bins.withColumn("_through", F.sum("_m").over(along)).withColumn("samples", F.sum("_m").over(W.partitionBy(*keys)))
    wanted = summed.withColumn("percentile", F.explode(F.array(*[F.lit(p) for p in percentiles]))).withColumn(
        "_rank", F.least(F.col("samples"), F.floor(F.col("percentile") / F.lit(100.0) * F.col("samples")).cast("long") + 1)
    )
    holding = wanted.where((F.col("_through") - F.col("_m") < F.col("_rank")) & (F.col("_rank") <= F.col("_through")))
    located = holding.select(*keys, "_bin", "percentile", "samples", (F.col("_rank") - F.col("_through") + F.col("_m")).alias("_left"))
    within = W.partitionBy(*keys, "_bin", "percentile").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        counts.join(located, [*keys, "_bin"])
        .withColumn("_upto", F.sum("_n").over(within))
        .where((F.col("_upto") - F.col("_n") < F.col("_left")) & (F.col("_left") <= F.col("_upto")))
        .select(*keys, "percentile", "value", "samples")
    )


def _samples(scope: Scope, *kept: Column | str) -> DataFrame:
    """One row per reported vital, at the precision it is shown with."""
    parsed = F.from_json("props", ", ".join(f"{v} string" for v in VITALS))
    rows = scope.rows().where("name = 'web_vitals'").select("site_id", *kept, parsed.alias("p"))
    each = F.explode(
        F.array(*[F.struct(F.lit(v).alias("vital"), F.col(f"p.{v}").try_cast("double").alias("value")) for v in VITALS])
    )
    spread = rows.select("*", each.alias("s")).drop("p")
    return spread.select(
        *[c for c in spread.columns if c != "s"], F.col("s.vital").alias("vital"), round_to(F.col("s.value"), DIGITS).alias("value")
    ).where(F.col("value").isNotNull())


def _checked(percentiles: list[int]) -> list[int]:
    if not set(percentiles) <= set(PERCENTILES):
        raise ValueError(f"percentile must be one of {PERCENTILES}")
    return percentiles


def overview(scope: Scope, percentiles: list[int] | None = None) -> DataFrame:
    """each vital's percentiles now and in the previous period; no samples, no row."""
    keys, wanted = ["site_id", "vital", "period"], _checked(percentiles or PERCENTILES)

    def period(moment: str) -> Column:
        return F.when(scope.window.contains(moment), "now").otherwise("before").alias("period")

    if vital_days.usable(scope):
        held = vital_days.counts(scope, [scope.window, scope.window.previous()], "all")
        ranked = nearest_rank(held.withColumn("period", period("at")), keys, wanted, F.col("n"))
    else:
        both = scope.at(scope.window.joined(scope.window.previous()))
        ranked = nearest_rank(_samples(both, period("ts")), keys, wanted)
    now, before = F.col("period") == "now", F.col("period") == "before"
    return ranked.groupBy("site_id", "vital", "percentile").agg(
        F.max(F.when(now, F.col("value"))).alias("value"),
        F.coalesce(F.max(F.when(now, F.col("samples"))), F.lit(0)).alias("samples"),
        F.max(F.when(before, F.col("value"))).alias("previous"),
        F.coalesce(F.max(F.when(before, F.col("samples"))), F.lit(0)).alias("previous_samples"),
    )


def by_dimension(scope: Scope, by: str = "path", percentile: int = 75, limit: int | None = 50) -> DataFrame:
    """every vital's percentile per value of one dimension, most samples first."""
    if by not in DIMENSIONS:
        raise ValueError(f'cannot break performance down by "{by}"')
    keys = ["site_id", "vital", "g"]
    if vital_days.usable(scope):
        ranked = nearest_rank(vital_days.counts(scope, [scope.window], by), keys, _checked([percentile]), F.col("n"))
    else:
        ranked = nearest_rank(_samples(scope, F.col(by).alias("g")), keys, _checked([percentile]))
    ranked = ranked.drop("percentile")
    return top_per(ranked, limit, [F.desc("samples"), F.asc("g")], ["site_id", "vital"])


def over_time(scope: Scope, width: int, percentile: int = 75) -> DataFrame:
    """every vital's percentile per bucket; stored counts serve buckets made of whole days."""
    width, keys = max(MINUTE_MS, width), ["site_id", "vital", "bucket"]
    if vital_days.usable(scope) and width % DAY_MS == 0 and scope.window.from_ms % DAY_MS == 0:
        held = vital_days.counts(scope, [scope.window], "all").withColumn("bucket", bucket_of("at", scope.window.from_ms, width))
        return nearest_rank(held, keys, _checked([percentile]), F.col("n")).drop("percentile")
    bucket = bucket_of("ts", scope.window.from_ms, width).alias("bucket")
    return nearest_rank(_samples(scope, bucket), keys, _checked([percentile])).drop("percentile")


def bundle_p75(scope: Scope) -> DataFrame:
    """p75 over the events that carry an LCP; a missing INP or CLS ranks before every value."""
    if vital_days.usable(scope):
        ranked = nearest_rank(vital_days.counts(scope, [scope.window], "p75"), ["site_id", "vital"], [75], F.col("n"))
        return _wide(scope, ranked)
    parsed = F.from_json("props", "lcp string, inp string, cls string")
    rows = scope.rows().where("name = 'web_vitals'").select("site_id", parsed.alias("p"))
    rows = rows.where(F.col("p.lcp").try_cast("double").isNotNull())
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(v).alias("vital"), round_to(F.col(f"p.{v}").try_cast("double"), digits).alias("value"))
                for v, digits in BUNDLE_DIGITS.items()
            ]
        )
    )
    samples = rows.select("site_id", each.alias("s")).select("site_id", "s.vital", "s.value")
    return _wide(scope, nearest_rank(samples, ["site_id", "vital"], [75]))


def _wide(scope: Scope, ranked: DataFrame) -> DataFrame:
    return scope.per_site(ranked, *[F.max(F.when(F.col("vital") == v, F.col("value"))).alias(v) for v in BUNDLE_DIGITS])
