"""Windows over sampled signals: (recording_id, idx, time, value)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window as W
from pyspark.sql.window import WindowSpec


def each() -> WindowSpec:
    """A recording's samples."""
    return W.partitionBy("recording_id")


def order() -> WindowSpec:
    """A recording's samples in order."""
    return each().orderBy("idx")


def blackman(n: int) -> list[float]:
    """Blackman window of n samples, summing to 1."""
    w = [0.42 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) + 0.08 * math.cos(4 * math.pi * k / (n - 1)) for k in range(n)] if n > 1 else [1.0]
    return [x / sum(w) for x in w]


#: Samples of a recording that go to a task together; longer recordings are cut into spans that overlap by what a window needs.
SPAN = 1 << 17
#: Paddings that look no further than half a window from an end; others see a recording whole.
LOCAL = ("edge", "constant", "reflect", "symmetric")


def moving_average(
    data: DataFrame, window: int | list[float], function: Callable[[int], list[float]] | None = None, *, padding: str = "edge", name: str = "average"
) -> DataFrame:
    """Centred weighted average; ``data`` has idx from 0 without gaps.

    ``window`` is a number of samples, one more if even, with the weights that ``function`` gives for it (equal ones without
    it), or an odd number of weights. A number is shortened to the largest odd one below a recording's length plus one.
    ``padding`` names how numpy.pad makes values beyond the ends. Missing values are missing in every average that holds them.
    """
    if not isinstance(window, int) and len(window) % 2 == 0:
        raise ValueError("an odd number of weights is needed")
    size = window + (window % 2 == 0) if isinstance(window, int) else len(window)
    half = size // 2
    span = max(SPAN, 8 * size) if padding in LOCAL else 1 << 62
    own = F.floor(F.col("idx") / span)
    beside = [F.when((F.col("idx") % span < half) & (own > 0), own - 1), F.when(F.col("idx") % span >= span - half, own + 1)] if padding in LOCAL else []
    spread = data.withColumn("of span", F.explode(F.array_compact(F.array(own, *beside))))
    schema = StructType([*data.schema.fields, StructField(name, DoubleType())])

    def weights_of(n: int) -> np.ndarray:
        if not isinstance(window, int):
            return np.array(window, dtype=float)
        n = min(size, (n - 1) // 2 * 2 + 1)
        w = np.array(function(n) if function else np.ones(n), dtype=float)
        return w / w.sum()

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        k = table.column("of span")[0].as_py()
        at = table.column("idx").to_numpy()
        x = table.column("value").cast(pa.float64()).to_numpy()
        inside = (at >= k * span) & (at < (k + 1) * span)
        if not inside.any():  # the recording ended with the span before
            return table.drop_columns("of span").append_column(name, pa.nulls(len(table), pa.float64())).slice(0, 0).cast(to_arrow_schema(schema))
        at_start, at_end = k == 0, at[-1] < (k + 1) * span + half - 1 or padding not in LOCAL
        w = weights_of(len(x) if at_start and at[-1] < span else size)
        h = len(w) // 2
        lo, hi = (h if at_start else 0), (h if at_end else 0)
        wide = np.pad(x, (lo, hi), mode=padding) if lo or hi else x
        out = np.full(len(x), np.nan)
        out[h - lo : len(x) - (h - hi)] = np.convolve(wide, w[::-1], mode="valid")
        table = table.drop_columns("of span").append_column(name, pa.array(out, from_pandas=True))
        return table.filter(pa.array(inside)).cast(to_arrow_schema(schema))

    return spread.groupBy("recording_id", "of span").applyInArrow(each, schema)


def with_invalid(data: DataFrame, *, percent: float = 5, multiplier: float = 4) -> DataFrame:
    """``invalid``: outside of the mean plus or minus a multiple of its distance to the percentiles."""
    stats = data.groupBy("recording_id").agg(
        F.avg("value").alias("m"), F.percentile("value", F.lit(percent / 100)).alias("lo"), F.percentile("value", F.lit(1 - percent / 100)).alias("hi")
    )
    low, high = F.col("m") - multiplier * (F.col("m") - F.col("lo")), F.col("m") + multiplier * (F.col("hi") - F.col("m"))
    return data.join(stats, "recording_id").withColumn("invalid", (F.col("value") < low) | (F.col("value") > high)).drop("m", "lo", "hi")


def fill_nearest(data: DataFrame) -> DataFrame:
    """Invalid samples get the value of the nearest valid one; of an odd run the middle gets the right one's. Without a valid one an error is raised."""
    good = F.when(~F.col("invalid"), F.struct("idx", "value"))
    so_far = lambda by: F.last(good, ignorenulls=True).over(each().orderBy(by).rowsBetween(W.unboundedPreceding, 0))
    out = data.withColumn("p", so_far(F.col("idx"))).withColumn("n", so_far(F.col("idx").desc()))
    run = F.col("n.idx") - F.col("p.idx") - 1
    place = F.col("idx") - F.col("p.idx") - 1
    value = (
        F.when(F.col("p").isNull() & F.col("n").isNull(), F.raise_error(F.lit("a recording has invalid samples only")).cast("double"))
        .when(F.col("p").isNull(), F.col("n.value")).when(F.col("n").isNull(), F.col("p.value")).when(place < F.floor(run / 2), F.col("p.value")).otherwise(F.col("n.value"))
    )
    return out.withColumn("value", F.when(F.col("invalid"), value).otherwise(F.col("value"))).drop("p", "n")


def unwrap(data: DataFrame, period: float) -> DataFrame:
    """Times that fall back by more than half a period go on in the next one."""
    step = F.col("time") - F.lag("time").over(order())
    turn = F.when(step < -period / 2, 1).when(step > period / 2, -1).otherwise(0)
    return data.withColumn("turn", turn).withColumn("time", F.col("time") + period * F.sum("turn").over(order().rowsBetween(W.unboundedPreceding, 0))).drop("turn")


def sample_frequency(data: DataFrame, given: float | None = None) -> DataFrame:
    """(recording_id, sample_frequency): one over the slope of time on index, to four significant digits.

    A recording of fewer than two samples is an error. With a ``given`` rate that is the result, and ``differs`` tells
    whether the samples say otherwise.
    """
    rate = data.groupBy("recording_id").agg(F.count("time").alias("n"), (1 / F.regr_slope("time", "idx")).alias("rate"))
    rate = rate.withColumn("rate", F.when(F.col("n") < 2, F.raise_error(F.lit("a sample frequency needs two samples")).cast("double")).otherwise(F.col("rate")))
    digits = 3 - F.floor(F.log10(F.abs("rate")))
    rounded = F.round(F.col("rate") * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    if given is None:
        return rate.select("recording_id", rounded.alias("sample_frequency"))
    return rate.select("recording_id", F.lit(float(given)).alias("sample_frequency"), (rounded != float(given)).alias("differs"))
