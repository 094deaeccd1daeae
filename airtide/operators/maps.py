"""Pixel maps: (map_id, row, col, value) rows; a missing value is null or an absent row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def global_impedance(frames: DataFrame) -> DataFrame:
    """Sum of the pixels of each frame; missing pixels count 0, also if all are missing."""
    total = F.aggregate("pixels", F.lit(0.0), lambda s, x: s + F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0)))
    return frames.select("recording_id", "frame_idx", "time", total.alias("value"))


def aggregate_maps(maps: DataFrame, **aggregates: Callable[[Column], Column]) -> DataFrame:
    """Each pixel over a stack of maps; pixels missing in all stay missing."""
    return maps.groupBy("row", "col").agg(*[f(F.col("value")).alias(n) for n, f in aggregates.items()])


def arithmetic(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pixelwise sum, difference, product and quotient (null for a divisor of 0) of maps, paired by the columns ``by``.

    Maps of a pair must be of one shape: a pixel that only one of them has is an error.
    """
    on = [*by, "row", "col"]
    x, y = a.select(*on, "value", F.lit(1).alias("in a")), b.select(*on, F.col("value").alias("other"), F.lit(1).alias("in b"))
    odd = F.col("in a").isNull() | F.col("in b").isNull()
    both = x.join(y, on, "full").withColumn("value", F.when(odd, F.raise_error(F.lit("maps of different shapes")).cast("double")).otherwise(F.col("value")))
    c = F.col
    return both.select(
        *on, (c("value") + c("other")).alias("total"), (c("value") - c("other")).alias("difference"), (c("value") * c("other")).alias("product"), F.try_divide("value", "other").alias("quotient")
    )


#: Kinds of maps: what values may be. A difference of maps is a ``difference``; other results keep the first map's kind.
KINDS = ("plain", "difference", "amplitude", "tidal impedance variation", "perfusion", "pendelluft", "signed pendelluft")
NOT_NEGATIVE = ("amplitude", "tidal impedance variation", "perfusion", "pendelluft")


def combine(a: DataFrame, b: DataFrame | float, operation: str, *, by: tuple[str, ...] = (), reverse: bool = False) -> DataFrame:
    """Map values plus (``+``), minus (``-``), times (``*``) or over (``/``) another map's or a number; ``reverse`` swaps the sides.

    A ``kind`` column goes on: a number keeps it, ``-`` of maps makes it ``difference``, other operations keep the first's.
    """
    made = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": F.try_divide}
    if operation not in made:
        raise ValueError(f"unknown operation {operation!r}")
    sides = lambda x, y: made[operation](*((y, x) if reverse else (x, y)))
    if not isinstance(b, DataFrame):
        return a.withColumn("value", sides(F.col("value"), F.lit(float(b))))
    on = [*by, "row", "col"]
    name = {"+": "total", "-": "difference", "*": "product", "/": "quotient"}[operation]
    out = (arithmetic(b, a, by) if reverse else arithmetic(a, b, by)).select(*on, F.col(name).alias("value"))
    if "kind" not in a.columns:
        return out
    return out.join(a.select(*on, "kind"), on).withColumn("kind", F.lit("difference") if operation == "-" else F.col("kind"))


def convert(maps: DataFrame, kind: str, **attributes: str) -> DataFrame:
    """The maps as another kind, with further columns set; ``negative`` tells of values that the kind should not have."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}")
    out = maps.withColumn("kind", F.lit(kind)).withColumns({n: F.lit(v) for n, v in attributes.items()})
    return out.withColumn("negative", F.lit(kind in NOT_NEGATIVE) & F.coalesce(F.col("value") < 0, F.lit(False)))


def to_boolean(value: Column, *, zero: bool = False) -> Column:
    """Missing values are false, as is 0 unless ``zero``."""
    there = value.isNotNull() & ~F.isnan(value)
    return F.coalesce(there if zero else there & (value != 0), F.lit(False))


def to_integer(value: Column) -> Column:
    """Whole part; missing values are 0."""
    return filled(value).cast("long")


def filled(value: Column, by: float = 0.0) -> Column:
    """Missing values replaced."""
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(float(by)))


def normalize(maps: DataFrame, mode: str, reference: float | None = None) -> DataFrame:
    """``zero-based``, ``symmetric``, ``maximum`` or ``reference`` normalization within each map.

    A divisor of 0 raises, as does a reference that is missing.
    """
    each = W.partitionBy("map_id")
    low, high, size = F.min("value").over(each), F.max("value").over(each), F.max(F.abs("value")).over(each)
    base, divisor = {
        "zero-based": (low, high - low),
        "symmetric": (F.lit(0.0), size),
        "maximum": (F.lit(0.0), high),
        "reference": (F.lit(0.0), F.lit(reference)),
    }[mode]
    if mode == "reference" and not reference:
        raise ZeroDivisionError("a reference other than 0 is needed") if reference == 0 else ValueError("a reference is needed")
    checked = F.when(divisor != 0, divisor).otherwise(F.raise_error(F.lit("division by zero in normalization")).cast("double"))
    return maps.withColumn("value", (F.col("value") - base) / checked)


def threshold(maps: DataFrame, limit: float, *, magnitude: bool = False, of_max: bool = False, comparator: Callable[[Column, Column], Column] = lambda v, t: v >= t) -> DataFrame:
    """Mask rows (weight 1) of the pixels whose value, or magnitude, compares with the limit, or with that fraction of the map's largest."""
    value = F.abs("value") if magnitude else F.col("value")
    bound = F.lit(limit) * F.max(value).over(W.partitionBy("map_id")) if of_max else F.lit(limit)
    return maps.withColumn("bound", bound).where(comparator(value, F.col("bound"))).select("map_id", "row", "col", F.lit(1.0).alias("weight"))


def local_maxima(maps: DataFrame) -> DataFrame:
    """Pixels that no neighbour of eight exceeds and that exceed the map's smallest value."""
    step = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)]))
    spread = maps.select("map_id", "row", "col", "value", step.alias("s"))
    top = spread.groupBy("map_id", (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col")).agg(F.max("value").alias("top"))
    low = maps.withColumn("low", F.min("value").over(W.partitionBy("map_id")))
    return low.join(top, ["map_id", "row", "col"]).where("value = top and value > low").select("map_id", "row", "col", "value")
