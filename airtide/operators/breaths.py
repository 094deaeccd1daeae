"""Breath detection and per-breath parameters, by windows within recordings."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .signal import blackman, fill_nearest, moving_average, order, with_invalid


def extrema(data: DataFrame, *, around: bool = False) -> DataFrame:
    """(…, kind): peaks (1) not below the moving average and valleys (-1) not above it; flat tops count at their middle.

    Runs of equal values are one point, so a plateau is compared with the runs beside it. All is told by windows that grow
    forwards and backwards within a recording: one shuffle, two sorts. With ``around`` the average and the largest values
    ``before`` and ``after`` go along, for ``trimmed``.
    """
    value, idx = F.col("value"), F.col("idx")
    back = W.partitionBy("recording_id").orderBy(F.desc("idx"))
    so_far, ahead = order().rowsBetween(W.unboundedPreceding, 0), back.rowsBetween(W.unboundedPreceding, -1)
    changed = data.withColumn("earlier", F.lag("value").over(order())).withColumn("starts", F.coalesce(value != F.col("earlier"), F.lit(True)))
    runs = changed.withColumn("run", F.last(F.when(F.col("starts"), F.struct(idx.alias("lo"), F.col("earlier").alias("p"))), ignorenulls=True).over(so_far))
    runs = runs.withColumn("next", F.last(F.when(F.col("starts"), F.struct(idx.alias("lo"), value.alias("v"))), ignorenulls=True).over(ahead))
    if around:
        runs = runs.withColumn("before", F.max("value").over(order().rowsBetween(W.unboundedPreceding, -1))).withColumn("after", F.max("value").over(ahead))
    middle = idx == F.floor((F.col("run.lo") + F.col("next.lo") - 1) / 2)
    top = (value > F.col("run.p")) & (value > F.col("next.v")) & (value >= F.col("average"))
    low = (value < F.col("run.p")) & (value < F.col("next.v")) & (value <= F.col("average"))
    kind = F.when(middle & top, 1).when(middle & low, -1)
    return runs.withColumn("kind", kind).where("kind is not null").select("recording_id", "idx", "time", "value", "kind", *["average", "before", "after"] * around)


def suppressed(points: DataFrame, distance: int) -> DataFrame:
    """Of extrema of one kind closer than ``distance`` samples the more extreme stay, the largest first; ties keep the later."""
    if distance <= 1:
        return points

    def thin(key, table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("idx")
        at, height = np.array(table["idx"]), np.array(table["value"]) * np.array(table["kind"])
        keep = np.ones(len(at), dtype=bool)
        for k in np.argsort(height, kind="stable")[::-1]:
            if keep[k]:
                for step in (-1, 1):
                    j = k + step
                    while 0 <= j < len(at) and abs(at[j] - at[k]) < distance:
                        keep[j] = False
                        j += step
        return table.filter(pa.array(keep))

    return points.groupBy("recording_id", "kind").applyInArrow(lambda key, t: thin(key, t), points.schema)


def trimmed(points: DataFrame, data: DataFrame | None = None) -> DataFrame:
    """Without the first or last valley if the signal outside it stays below the average there; peaks only between valleys.

    What is around a point comes with it (``extrema`` with ``around``) or is looked up in ``data``.
    """
    if data is not None:
        before = F.max("value").over(order().rowsBetween(W.unboundedPreceding, -1))
        after = F.max("value").over(W.partitionBy("recording_id").orderBy(F.desc("idx")).rowsBetween(W.unboundedPreceding, -1))
        points = points.join(data.select("recording_id", "idx", "average", before.alias("before"), after.alias("after")), ["recording_id", "idx"])
    joined = points
    valley = F.col("kind") == -1
    each = W.partitionBy("recording_id")
    joined = joined.withColumn("v0", F.min(F.when(valley, F.col("idx"))).over(each)).withColumn("v1", F.max(F.when(valley, F.col("idx"))).over(each))
    drop = valley & (((F.col("idx") == F.col("v0")) & (F.col("before") < F.col("average"))) | ((F.col("idx") == F.col("v1")) & (F.col("after") < F.col("average"))))
    left = joined.where(~F.coalesce(drop, F.lit(False)))
    left = left.withColumn("v0", F.min(F.when(valley, F.col("idx"))).over(each)).withColumn("v1", F.max(F.when(valley, F.col("idx"))).over(each))
    return left.where(valley | ((F.col("idx") > F.col("v0")) & (F.col("idx") < F.col("v1")))).select("recording_id", "idx", "time", "value", "kind")


def alternating(points: DataFrame) -> DataFrame:
    """Of successive extrema of one kind only the most extreme, the earliest of equals."""
    turn = F.coalesce((F.col("kind") != F.lag("kind").over(order())).cast("int"), F.lit(1))
    islands = points.withColumn("turn", turn).withColumn("island", F.sum("turn").over(order().rowsBetween(W.unboundedPreceding, 0)))
    best = F.row_number().over(W.partitionBy("recording_id", "island").orderBy(F.desc(F.col("value") * F.col("kind")), "idx"))
    return islands.withColumn("best", best).where("best = 1").select("recording_id", "idx", "time", "value", "kind")


def without_low(points: DataFrame, fraction: float | None = 0.25) -> DataFrame:
    """Without peaks whose mean height over the valleys beside them is below a fraction of the median; alternating again."""
    if not fraction:
        return points
    height = F.when(F.col("kind") == 1, F.col("value") - (F.lag("value").over(order()) + F.lead("value").over(order())) / 2)
    limit = F.median("height").over(W.partitionBy("recording_id")) * fraction
    return alternating(points.withColumn("height", height).withColumn("limit", limit).where("kind = -1 or height >= limit").drop("height", "limit"))


def assembled(points: DataFrame) -> DataFrame:
    """(recording_id, breath_idx, start_idx, middle_idx, end_idx and times, values) from valley, peak, valley."""
    made = points.select(
        "recording_id", "kind", F.lag("idx").over(order()).alias("start_idx"), F.col("idx").alias("middle_idx"), F.lead("idx").over(order()).alias("end_idx"),
        F.lag("time").over(order()).alias("start_time"), F.col("time").alias("middle_time"), F.lead("time").over(order()).alias("end_time"),
        F.lag("value").over(order()).alias("start_value"), F.col("value").alias("middle_value"), F.lead("value").over(order()).alias("end_value"),
    ).where("kind = 1 and start_idx is not null and end_idx is not null").drop("kind")
    return made.withColumn("breath_idx", F.row_number().over(W.partitionBy("recording_id").orderBy("middle_idx")).cast("long") - 1)


def near_invalid(breaths: DataFrame, data: DataFrame, width: int) -> DataFrame:
    """Breaths without an invalid sample in [start - width, end + width); a running count of invalid samples makes it two equi-joins."""
    count = F.sum(F.col("invalid").cast("int")).over(order().rowsBetween(W.unboundedPreceding, 0))
    counts = data.select("recording_id", "idx", count.alias("c"))
    last = counts.groupBy("recording_id").agg(F.max("idx").alias("last"))
    some = breaths.join(last, "recording_id").withColumn("lo", F.col("start_idx") - width - 1).withColumn("hi", F.least(F.col("end_idx") + width - 1, F.col("last")))
    for side in ("lo", "hi"):
        some = some.join(counts.select("recording_id", F.col("idx").alias(side), F.col("c").alias(f"c{side}")), ["recording_id", side], "left")
    return some.where(F.coalesce("chi", F.lit(0)) == F.coalesce("clo", F.lit(0))).select(*breaths.columns)


def find_breaths(
    data: DataFrame, sample_frequency: float, *, minimum_duration: float = 2 / 3, averaging_duration: float = 15.0, averaging_function: Callable[[int], list[float]] | None = blackman,
    amplitude_cutoff_fraction: float | None = 0.25, invalid_window: float = 0.5, invalid_percentile: float = 5, invalid_multiplier: float = 4,
) -> DataFrame:
    """(recording_id, breath_idx, start, middle and end idx, time and value) of the breaths of every recording.

    ``data`` has (recording_id, idx, time, value). Outliers are replaced by their nearest neighbours. Peaks above and
    valleys below the moving average, at least ``minimum_duration`` seconds from others of their kind, are thinned to turns:
    the ends' valleys must be real ones, between two of a kind only the most extreme stays, peaks of low amplitude go.
    Breaths within ``invalid_window`` seconds of an outlier are left out. A recording without two valleys and a peak has none.
    """
    source = data.select("recording_id", "idx", "time", F.col("value").cast("double").alias("value"))
    filled = fill_nearest(with_invalid(source, percent=invalid_percentile, multiplier=invalid_multiplier))
    averaged = moving_average(filled, int(sample_frequency * averaging_duration), averaging_function)
    points = suppressed(extrema(averaged, around=True), math.ceil(max(minimum_duration * sample_frequency, 1)))
    count = lambda kind: F.count_if(F.col("kind") == kind).over(W.partitionBy("recording_id"))
    points = points.withColumns({"valleys": count(-1), "peaks": count(1)}).where("valleys >= 2 and peaks >= 1").drop("valleys", "peaks")
    found = assembled(without_low(alternating(trimmed(points)), amplitude_cutoff_fraction))
    return near_invalid(found, averaged, math.ceil(invalid_window * sample_frequency))


def tidal_variation(breaths: DataFrame) -> DataFrame:
    """Inspiratory, expiratory and mean tidal variation and end-expiratory level of each breath."""
    s, m, e = F.col("start_value"), F.col("middle_value"), F.col("end_value")
    return breaths.select(
        "recording_id", "breath_idx", "middle_time", (m - s).alias("inspiratory"), (m - e).alias("expiratory"), (m - (s + e) / 2).alias("mean"), e.alias("end_expiratory")
    )


def pixel_variation(breaths: DataFrame, pixels: DataFrame) -> DataFrame:
    """(recording_id, breath_idx, row, col, inspiratory, expiratory, mean) with the timing of the given breaths."""
    side = F.explode(F.array(*[F.struct(F.lit(n[0]).alias("k"), F.col(f"{n}_idx").alias("idx")) for n in ("start", "middle", "end")]))
    points = breaths.select("recording_id", "breath_idx", side.alias("p")).select("recording_id", "breath_idx", "p.k", F.col("p.idx").alias("frame_idx"))
    at = pixels.join(points, ["recording_id", "frame_idx"]).groupBy("recording_id", "breath_idx", "row", "col")
    z = lambda k: F.max(F.when(F.col("k") == k, F.col("z")))
    each = at.agg(z("s").alias("s"), z("m").alias("m"), z("e").alias("e"))
    return each.select("recording_id", "breath_idx", "row", "col", F.expr("m - s").alias("inspiratory"), F.expr("m - e").alias("expiratory"), F.expr("m - (s + e) / 2").alias("mean"))


def end_expiratory_level(breaths: DataFrame) -> DataFrame:
    """(recording_id, breath_idx, time, value): the signal at the end of each breath."""
    return breaths.select("recording_id", "breath_idx", F.col("end_time").alias("time"), F.col("end_value").alias("value"))


def spacing(breaths: DataFrame) -> DataFrame:
    """(recording_id, spacing): mean number of samples from middle to middle; null for a single breath."""
    step = F.col("middle_idx") - F.lag("middle_idx").over(W.partitionBy("recording_id").orderBy("breath_idx"))
    return breaths.withColumn("step", step).groupBy("recording_id").agg(F.avg("step").alias("spacing"))


def of_flags(points: DataFrame) -> DataFrame:
    """Breaths of a device's own flags (recording_id, idx, time, value, kind): valley, peak, valley after runs of one kind are thinned."""
    return assembled(alternating(points.where("kind in (-1, 1)")))
