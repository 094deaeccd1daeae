"""Breaths of single pixels, and lung-space masks made from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import kernels
from . import breaths as B
from . import maps

PIXEL = ["recording_id", "row", "col"]


def pixel_breaths(breaths: DataFrame, pixels: DataFrame, *, negative: bool = False, lags: DataFrame | None = None) -> DataFrame:
    """(recording_id, breath_idx, row, col, start_idx, middle_idx, end_idx), the extremes of each pixel between global middles.

    With ``negative`` a pixel whose mean inspiratory variation is below 0 is turned over. ``lags`` (recording, row, col,
    lag) shifts the global middles for each pixel. The first and last breath have none. A breath whose middle is not
    strictly between its ends, and a pixel that is constant, is left out.
    """
    order = W.partitionBy("recording_id").orderBy("breath_idx")
    spans = breaths.select("recording_id", "breath_idx", F.col("middle_idx").alias("lo"), F.lead("middle_idx").over(order).alias("hi")).where("hi is not null")
    samples = spans.withColumn("frame_idx", F.explode(F.sequence("lo", F.col("hi") - 1)))
    sign = F.lit(1.0)
    source = pixels.select(*PIXEL, "frame_idx", "z")
    if lags is not None:
        source = source.join(lags, PIXEL).withColumn("frame_idx", F.col("frame_idx") - F.col("lag"))
    if negative:
        mean = B.pixel_variation(breaths, pixels).groupBy(*PIXEL).agg(F.avg("inspiratory").alias("tiv"))
        source, sign = source.join(mean, PIXEL), F.when(F.col("tiv") < 0, -1.0).otherwise(1.0)
    value = F.col("z") * sign
    shift = F.col("lag") if lags is not None else F.lit(0)
    inside = source.join(samples, ["recording_id", "frame_idx"]).withColumn("v", value).withColumn("at", F.col("frame_idx") + shift)
    low = inside.groupBy(*PIXEL, "breath_idx").agg(F.min(F.struct("v", "at")).alias("l"), F.max("v").alias("top"))
    starts = low.where("l.v < top").select(*PIXEL, "breath_idx", F.col("l.at").alias("cut"))
    # The valley after middle k ends breath k and begins breath k + 1.
    by = W.partitionBy(*PIXEL).orderBy("breath_idx")
    ends = starts.select(*PIXEL, (F.col("breath_idx") + 1).alias("breath_idx"), F.col("cut").alias("start_idx"), F.lead("cut").over(by).alias("end_idx"), F.lead("breath_idx").over(by).alias("next"))
    ends = ends.where("next = breath_idx").drop("next")
    held = ends.withColumn("frame_at", F.explode(F.sequence("start_idx", F.col("end_idx") - 1)))
    plain = source.withColumn("v", value).select(*PIXEL, (F.col("frame_idx") + shift).alias("frame_at"), "v")
    peak = held.join(plain, [*PIXEL, "frame_at"]).groupBy(*PIXEL, "breath_idx", "start_idx", "end_idx").agg(F.max(F.struct("v", (-F.col("frame_at")).alias("m"))).alias("p"))
    return peak.select("recording_id", "breath_idx", "row", "col", "start_idx", (-F.col("p.m")).alias("middle_idx"), "end_idx").where("start_idx < middle_idx and middle_idx < end_idx")


def phase_lags(signal: DataFrame, pixels: DataFrame, breaths: DataFrame) -> DataFrame:
    """(recording_id, row, col, lag): how much later than the global signal each pixel breathes, within one mean breath."""
    spacing = breaths.groupBy("recording_id").agg(((F.max("middle_idx") - F.min("middle_idx")) / (F.count("*") - 1)).alias("reach"))
    both = pixels.select(*PIXEL, "frame_idx", "z").join(signal.select("recording_id", F.col("idx").alias("frame_idx"), "value"), ["recording_id", "frame_idx"]).join(spacing, "recording_id")

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by([("col", "ascending"), ("frame_idx", "ascending")])
        col = table["col"].to_numpy()
        z, value = (np.array(table[n], dtype=float) for n in ("z", "value"))
        cut = np.flatnonzero(np.diff(col)) + 1
        found = []
        for c, a, b in zip(col[np.append(0, cut)].tolist(), np.append(0, cut).tolist(), np.append(cut, len(col)).tolist()):
            lag = kernels.phase_lag(z[a:b], value[a:b], float(table["reach"][0].as_py() or 0)) if z[a:b].std() > 0 else None
            if lag is not None:
                found.append((c, lag))
        n = len(found)
        same = [pa.array([table[k][0].as_py()] * n, table.schema.field(k).type) for k in ("recording_id", "row")]
        return pa.table([*same, pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64())], names=[*PIXEL, "lag"])

    # A row of pixels goes to a task, so a long recording is spread over as many.
    return both.groupBy("recording_id", "row").applyInArrow(each, "recording_id long, row int, col int, lag long")


def pixel_timing_variation(found: DataFrame, pixels: DataFrame) -> DataFrame:
    """Mean tidal variation of each pixel breath with its own timing."""
    value = pixels.select(*PIXEL, F.col("frame_idx").alias("at"), "z")
    out = found
    for name in ("start", "middle", "end"):
        out = out.join(value.withColumnRenamed("at", f"{name}_idx").withColumnRenamed("z", name), [*PIXEL, f"{name}_idx"])
    return out.select("recording_id", "breath_idx", "row", "col", (F.col("middle") - (F.col("start") + F.col("end")) / 2).alias("mean"))


def mean_map(variation: DataFrame, value: str = "mean") -> DataFrame:
    return variation.groupBy(F.col("recording_id").alias("map_id"), "row", "col").agg(F.avg(value).alias("value"))


def tiv_lungspace(breaths: DataFrame, pixels: DataFrame, fraction: float = 0.15) -> DataFrame:
    """Pixels whose mean tidal variation, with global timing, reaches a fraction of the largest."""
    if not 0 < fraction < 1:
        raise ValueError("a fraction between 0 and 1 is needed")
    return maps.threshold(mean_map(B.pixel_variation(breaths, pixels)), fraction, of_max=True)


def amplitude_lungspace(signal: DataFrame, breaths: DataFrame, pixels: DataFrame, fraction: float = 0.15) -> DataFrame:
    """The same with each pixel's own timing, found by its phase shift."""
    found = pixel_breaths(breaths, pixels, lags=phase_lags(signal, pixels, breaths))
    return maps.threshold(mean_map(pixel_timing_variation(found, pixels)), fraction, of_max=True)


def watershed_lungspace(signal: DataFrame, breaths: DataFrame, pixels: DataFrame, fraction: float = 0.15) -> DataFrame:
    """Regions of the amplitude map around maxima that lie in the tidal-variation mask, within the amplitude mask."""
    global_ = B.pixel_variation(breaths, pixels)
    own = pixel_timing_variation(pixel_breaths(breaths, pixels, lags=phase_lags(signal, pixels, breaths)), pixels)
    common = global_.select("recording_id", "breath_idx").distinct().join(own.select("recording_id", "breath_idx").distinct(), ["recording_id", "breath_idx"])
    tiv, amplitude = (mean_map(x.join(common, ["recording_id", "breath_idx"])) for x in (global_, own))
    both = amplitude.withColumnRenamed("value", "amplitude").join(tiv.withColumnRenamed("value", "tiv"), ["map_id", "row", "col"], "full")

    def each(table: pa.Table) -> pa.Table:
        r, c = np.array(table["row"]), np.array(table["col"])
        image = {n: np.full((r.max() + 1, c.max() + 1), np.nan) for n in ("amplitude", "tiv")}
        for n in image:
            image[n][r, c] = np.array(table[n].to_pylist(), dtype=float)
        limit = np.nanmax(image["tiv"]) * fraction
        a = np.nan_to_num(image["amplitude"])
        wide = np.pad(a, 1, constant_values=-np.inf)
        near = np.max([wide[1 + y : 1 + y + a.shape[0], 1 + x : 1 + x + a.shape[1]] for y in (-1, 0, 1) for x in (-1, 0, 1)], axis=0)
        top = (a == near) & (a > a.min())
        markers = np.zeros(a.shape, dtype=int)
        markers[top] = np.arange(1, top.sum() + 1)
        flooded = kernels.watershed(a, markers)
        inside = np.isin(flooded, markers[top & (np.nan_to_num(image["tiv"], nan=-np.inf) >= limit)]) & (a >= limit)
        y, x = np.nonzero(inside)
        return pa.table({"map_id": pa.array([table["map_id"][0].as_py()] * len(y), pa.int64()), "row": pa.array(y.astype(np.int32)), "col": pa.array(x.astype(np.int32)), "weight": np.ones(len(y))})

    return both.groupBy("map_id").applyInArrow(each, "map_id long, row int, col int, weight double")
