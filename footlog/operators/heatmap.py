"""Click and scroll heatmaps from recorded events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footlog.operators.ordered import running_state, top_per
from footlog.sources.recordings import CLICK, NAVIGATION, SCROLL, SNAPSHOT, VIEWPORT

DEVICES = ["desktop", "tablet", "mobile"]
X_STEP, Y_STEP, SCROLL_BIN = 0.004, 8, 100
LOAD = ["site_id", "replay_id", "page_load"]
PAGE = ["site_id", "device", "path"]


def device_class(width: Column) -> Column:
    return F.when(width >= 1024, "desktop").when(width >= 640, "tablet").otherwise("mobile")


def _arg(index: int) -> Column:
    return F.try_element_at("args", F.lit(index + 1)).try_cast("double")


def tracked(events: DataFrame) -> DataFrame:
    """Recorded events with the page view, viewport and scroll position in force at each.

    State restarts with every page load. A snapshot or a client-side navigation opens a view.
    """
    code = F.col("type")
    page_scroll = (code == SCROLL) & (_arg(0) == 0)
    width = F.when(code == SNAPSHOT, _arg(1)).when((code == VIEWPORT) & (_arg(0) != 0), _arg(0))
    height = F.when(code == SNAPSHOT, _arg(2)).when((code == VIEWPORT) & (_arg(1) != 0), _arg(1))
    left = F.when(code == SNAPSHOT, F.lit(0.0)).when(page_scroll, _arg(1))
    top = F.when(code.isin(SNAPSHOT, NAVIGATION), F.lit(0.0)).when(page_scroll, _arg(2))
    opens = F.when(code.isin(SNAPSHOT, NAVIGATION), 1).otherwise(0)
    used = events.where(code.isin(SNAPSHOT, NAVIGATION, VIEWPORT, SCROLL, CLICK)).select(*LOAD, "started_at", "seq", "pos", "type", "args")
    state = running_state(used, LOAD, "seq", ["pos"], {"vw": width, "vh": height, "sx": left, "sy": top}, {"view": opens})
    return state.fillna(0.0, ["vw", "vh", "sx", "sy"])


def page_views(state: DataFrame) -> DataFrame:
    """One row per page view: path, device class, deepest pixel seen, snapshot."""
    code = F.col("type")
    opening = F.when(
        code.isin(SNAPSHOT, NAVIGATION),
        F.struct(
            F.when(code == SNAPSHOT, F.coalesce(F.try_element_at("args", F.lit(4)), F.lit("/")))
            .otherwise(F.coalesce(F.try_element_at("args", F.lit(1)), F.lit("/")))
            .alias("path"),
            F.col("vw").alias("width"),
            F.col("vh").alias("height"),
            (code == NAVIGATION).alias("spa"),
            F.when(code == SNAPSHOT, F.try_element_at("args", F.lit(1))).alias("snap"),
            F.col("started_at").alias("at"),
        ),
    )
    seen = F.when((code == SCROLL) & (_arg(0) == 0), F.col("sy") + F.col("vh"))
    views = state.where(F.col("view") > 0).groupBy(*LOAD, "view").agg(F.first(opening, ignorenulls=True).alias("o"), F.max(seen).alias("_seen"))
    flat = views.select(*LOAD, "view", "o.*", F.greatest("o.height", F.coalesce("_seen", F.lit(0.0))).alias("bottom"))
    return flat.where(F.col("width") > 0).withColumn("device", device_class(F.col("width")))


def _round_half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def click_points(state: DataFrame, views: DataFrame, limit: int | None = None) -> DataFrame:
    """clicks per cell of each page and device: x as a fraction of the width, y in page pixels."""
    clicks = state.where((F.col("type") == CLICK) & (F.col("view") > 0) & (F.col("vw") > 0)).select(
        *LOAD, "view", ((_arg(1) + F.col("sx")) / F.col("vw")).alias("x"), (_arg(2) + F.col("sy")).alias("y")
    )
    on_page = clicks.where((F.col("x") >= 0) & (F.col("x") <= 1.05) & (F.col("y") >= 0))
    placed = on_page.join(views.select(*LOAD, "view", "device", "path"), [*LOAD, "view"])
    cell_x = _round_half_up(F.least(F.lit(1.0), "x") / X_STEP) * X_STEP
    cells = placed.groupBy(
        *PAGE,
        (_round_half_up(cell_x * 1000) / 1000).alias("x"),
        (_round_half_up(F.col("y") / Y_STEP) * Y_STEP).cast("long").alias("y"),
    ).agg(F.count(F.lit(1)).alias("clicks"))
    return top_per(cells, limit, [F.desc("clicks"), F.asc("x"), F.asc("y")], PAGE)


def scroll_reach(views: DataFrame) -> DataFrame:
    """per 100-pixel bin of each page and device, how many views reached at least that far.

    Views are counted by the deepest bin they reach; a running sum over a page's bins does the rest.
    """
    level = F.floor(F.col("bottom") / SCROLL_BIN).cast("long")
    counted = views.groupBy(*PAGE, level.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max("bottom").alias("deepest"))
    held = counted.groupBy(*PAGE).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"), F.max("deepest").alias("deepest")
    )
    bins = F.ceil(F.col("deepest") / SCROLL_BIN).cast("long")
    axis = held.where(F.col("deepest") > 0).select(*PAGE, "held", F.explode(F.sequence(F.lit(0).cast("long"), bins)).alias("bin"), bins.alias("bins"))
    deeper = W.partitionBy(*PAGE).orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = axis.withColumn("views", F.sum(F.coalesce(F.try_element_at("held", F.col("bin")), F.lit(0).cast("long"))).over(deeper))
    return counts.where(F.col("bin") < F.col("bins")).select(*PAGE, "bin", "views")


def pages(views: DataFrame, limit: int | None = None) -> DataFrame:
    """recorded pages of each device, most viewed first, with views that had no snapshot of their own."""
    grouped = views.groupBy(*PAGE).agg(
        F.count(F.lit(1)).alias("views"), F.sum(F.col("spa").cast("int")).cast("long").alias("spa_views")
    )
    return top_per(grouped, limit, [F.desc("views"), F.asc("path")], ["site_id", "device"])


def latest_snapshot(views: DataFrame, largest: int | None = None) -> DataFrame:
    """the newest snapshot of each page and device, of those up to ``largest`` characters if that is given."""
    usable = views.where(F.col("snap").isNotNull())
    if largest is not None:
        usable = usable.where(F.length("snap") <= largest)
    pick = F.max_by(F.struct("snap", "width", "height", "at"), F.struct("at", "replay_id", "page_load", "view"))
    return usable.groupBy(*PAGE).agg(pick.alias("s")).select(*PAGE, "s.*")


def truncation(recordings: DataFrame, limit: int) -> DataFrame:
    """recordings read per site when only the newest ``limit`` are wanted, and whether there were more."""
    counted = recordings.groupBy("site_id").agg(F.count(F.lit(1)).alias("found"))
    return counted.select("site_id", F.least("found", F.lit(limit)).alias("recordings"), (F.col("found") > limit).alias("truncated"))


def heatmap(events: DataFrame, points: int | None = None, page_count: int | None = None) -> dict[str, DataFrame]:
    """All parts for every page and device of the recorded events (with ``replay_id`` and ``started_at``)."""
    state = tracked(events)
    views = page_views(state)
    return {
        "points": click_points(state, views, points),
        "reach": scroll_reach(views),
        "pages": pages(views, page_count),
        "snapshot": latest_snapshot(views),
    }
