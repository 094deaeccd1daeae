"""Selection by index, time and interval; concatenation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def by_index(data: DataFrame, start: int | None = None, stop: int | None = None, idx: str = "idx", *, by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Rows of [start, stop) in each recording; negative bounds count from its end."""
    n = F.count("*").over(W.partitionBy(*by)) if (start or 0) < 0 or (stop or 0) < 0 else F.lit(0)
    bound = lambda x: F.lit(x) if x >= 0 else F.greatest(F.col("n") + x, F.lit(0))
    out = data.withColumn("n", n)
    if start is not None:
        out = out.where(F.col(idx) >= bound(start))
    if stop is not None:
        out = out.where(F.col(idx) < bound(stop))
    return out.drop("n")


def by_time(data: DataFrame, start: float | None = None, end: float | None = None, *, start_inclusive: bool = False, end_inclusive: bool = False, by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Samples of a time range. An inclusive start begins at the last sample not after it, an inclusive end stops at the first not before it."""
    each = W.partitionBy(*by)
    test: Column = F.lit(True)
    out = data
    if start is not None:
        if start_inclusive:
            out = out.withColumn("from time", F.coalesce(F.max(F.when(F.col("time") <= start, F.col("time"))).over(each), F.lit(start)))
            test = test & (F.col("time") >= F.col("from time"))
        else:
            test = test & (F.col("time") >= start)
    if end is not None:
        if end_inclusive:
            out = out.withColumn("to time", F.coalesce(F.min(F.when(F.col("time") >= end, F.col("time"))).over(each), F.lit(end)))
            test = test & (F.col("time") <= F.col("to time"))
        else:
            test = test & (F.col("time") < end)
    return out.where(test).drop("from time", "to time")


def at_time(data: DataFrame, time: float) -> DataFrame:
    """The first sample not before a time."""
    return by_time(data, time, time, end_inclusive=True)


def intervals(data: DataFrame, start: float, end: float, *, partial: bool = False) -> DataFrame:
    """Intervals inside [start, end], or, with ``partial``, the parts of those that overlap it."""
    if not partial:
        return data.where((F.col("start_time") >= start) & (F.col("end_time") <= end))
    some = data.where((F.col("start_time") < end) & (F.col("end_time") > start))
    return some.withColumn("start_time", F.greatest("start_time", F.lit(start))).withColumn("end_time", F.least("end_time", F.lit(end)))


def concatenate(first: DataFrame, second: DataFrame, *, idx: str = "idx", by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Both, renumbered; in each recording the second must begin after the first ends, or an error is raised."""
    ends = first.groupBy(*by).agg(F.max("time").alias("ended"), F.count("*").alias("n"))
    later = second.join(ends, list(by), "left")
    bad = F.col("time") <= F.col("ended")
    time = F.when(bad, F.raise_error(F.lit("the second part must begin after the first ends")).cast("double")).otherwise(F.col("time"))
    later = later.withColumn("time", time).withColumn(idx, F.col(idx) + F.coalesce("n", F.lit(0)))
    return first.unionByName(later.select(*first.columns))


def concatenate_points(first: DataFrame, second: DataFrame, *, by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Points, or intervals, of both. Points must begin after the first part's last; intervals may touch it. Else an error is raised."""
    spans = "start_time" in first.columns
    begin, end = ("start_time", "end_time") if spans else ("time", "time")
    ends = first.groupBy(*by).agg(F.max(end).alias("ended"))
    later = second.join(ends, list(by), "left")
    bad = F.col(begin) < F.col("ended") if spans else F.col(begin) <= F.col("ended")
    checked = F.when(bad, F.raise_error(F.lit("the second part must begin after the first ends")).cast("double")).otherwise(F.col(begin))
    return first.unionByName(later.withColumn(begin, checked).select(*first.columns))
