"""Pixel masks: (mask_id, row, col, weight) rows of included pixels only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

NAMES = {
    "V": "ventral", "D": "dorsal", "R": "right", "L": "left", "L1": "layer 1", "L2": "layer 2", "L3": "layer 3", "L4": "layer 4",
    "Q1": "quadrant 1", "Q2": "quadrant 2", "Q3": "quadrant 3", "Q4": "quadrant 4",
}


def geometric(spark: SparkSession, names: list[str], rows: int = 32, cols: int = 32) -> DataFrame:
    """Halves, layers and quadrants of an image, by name or abbreviation; right is where columns begin."""
    up, left = f"row < {rows // 2}", f"col < {cols // 2}"
    rule = {"ventral": up, "dorsal": f"NOT {up}", "right": left, "left": f"NOT {left}"}
    rule |= {f"layer {k + 1}": f"row div {max(1, rows // 4)} = {k}" for k in range(4)}
    rule |= {"quadrant 1": f"{up} AND {left}", "quadrant 2": f"{up} AND NOT {left}", "quadrant 3": f"NOT {up} AND {left}", "quadrant 4": f"NOT {up} AND NOT {left}"}
    grid = spark.range(rows * cols).select(F.expr(f"CAST(id div {cols} AS INT)").alias("row"), F.expr(f"CAST(id % {cols} AS INT)").alias("col"))
    out = None
    for given in names:
        name = NAMES.get(given, given)
        if name not in rule:
            raise ValueError(f"unknown mask {given!r}")
        if rows % (4 if name.startswith("layer") else 2 if name not in ("right", "left") else 1) or cols % (2 if name in ("right", "left") or name.startswith("quadrant") else 1):
            raise ValueError(f"a {rows}x{cols} image cannot be divided for {name}")
        part = grid.where(rule[name]).select(F.lit(given).alias("mask_id"), "row", "col", F.lit(1.0).alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


def apply(pixels: DataFrame, masks: DataFrame, value: str = "z", *, label_format: str | None = None) -> DataFrame:
    """Weighted values of the pixels that each mask includes; masks with a recording_id only apply to that recording's pixels.

    ``label_format`` makes a column ``label``, its ``{mask_label}`` being the mask's id.
    """
    on = [c for c in ("recording_id", "row", "col") if c != "recording_id" or c in masks.columns]
    out = pixels.join(masks, on).withColumn(value, F.col(value) * F.col("weight"))
    if label_format is None:
        return out
    if "{mask_label}" not in label_format:
        raise ValueError("label_format must hold {mask_label}")
    return out.withColumn("label", F.replace(F.lit(label_format), F.lit("{mask_label}"), F.col("mask_id").cast("string")))


def union(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of the weights, at most 1; masks are paired by the columns ``by``."""
    on = [*by, "row", "col"]
    return a.select(*on, "weight").unionByName(b.select(*on, "weight")).groupBy(*on).agg(F.least(F.sum("weight"), F.lit(1.0)).alias("weight")).where("weight > 0")


def difference(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Weights of a less those of b; pixels left without weight are excluded."""
    on = [*by, "row", "col"]
    other = b.select(*on, F.col("weight").alias("less"))
    return a.join(other, on, "left").select(*on, (F.col("weight") - F.coalesce("less", F.lit(0.0))).alias("weight")).where("weight > 0")


def intersection(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Product of the weights of pixels in both."""
    on = [*by, "row", "col"]
    return a.join(b.select(*on, F.col("weight").alias("by")), on).select(*on, (F.col("weight") * F.col("by")).alias("weight"))


def combine(masks: DataFrame, method: str, n_masks: int | None = None) -> DataFrame:
    """Sum (at most 1) or product over all masks of a collection, which are counted unless their number is given."""
    if method not in ("sum", "product"):
        raise ValueError("masks are combined by sum or product")
    if n_masks is None:
        n_masks = masks.select("mask_id").distinct().count()
    if n_masks == 0:
        raise ValueError("a sum or product needs masks")
    each = masks.groupBy("row", "col")
    if method == "sum":
        return each.agg(F.least(F.sum("weight"), F.lit(1.0)).alias("weight"))
    product = F.aggregate(F.collect_list("weight"), F.lit(1.0), lambda s, w: s * w)  # a weight for each mask
    return each.agg(F.count("*").alias("n"), product.alias("weight")).where(F.col("n") == n_masks).drop("n")


class Collection:
    """Masks (row, col, weight) by label, or without labels, by number; a collection is of one sort only."""

    def __init__(self, masks: dict[str, DataFrame] | list[DataFrame] | None = None) -> None:
        self.masks: dict[str | int, DataFrame] = {}
        for label, mask in masks.items() if isinstance(masks, dict) else ((None, m) for m in masks or ()):
            self.add(mask, label)

    @property
    def anonymous(self) -> bool:
        return bool(self.masks) and all(isinstance(k, int) for k in self.masks)

    def add(self, mask: DataFrame, label: str | None = None, *, overwrite: bool = False) -> Collection:
        """Add a mask; one without a label gets the next number. A label that is there is only taken with ``overwrite``."""
        if missing := {"row", "col", "weight"} - set(mask.columns):
            raise ValueError(f"a mask needs the columns {sorted(missing)}")
        if label is not None and not isinstance(label, str):
            raise TypeError("a label is a string")
        if self.masks and self.anonymous != (label is None):
            raise ValueError("masks with and without labels do not mix")
        if label in self.masks and not overwrite:
            raise KeyError(f"{label!r} is in the collection already")
        self.masks[len(self.masks) if label is None else label] = mask.select("row", "col", "weight")
        return self

    def __len__(self) -> int:
        return len(self.masks)

    def __getitem__(self, key: str | int) -> DataFrame:
        return self.masks[key]

    def table(self) -> DataFrame:
        """(mask_id, row, col, weight) of all masks."""
        if not self.masks:
            raise ValueError("the collection is empty")
        out = None
        for key, mask in self.masks.items():
            part = mask.select(F.lit(key).alias("mask_id"), "row", "col", "weight")
            out = part if out is None else out.unionByName(part)
        return out

    def combine(self, method: str = "sum") -> DataFrame:
        return combine(self.table(), method, len(self))

    def apply(self, pixels: DataFrame, value: str = "z", *, label_format: str | None = None) -> DataFrame:
        return apply(pixels, self.table(), value, label_format=label_format)


def is_weighted(masks: DataFrame) -> DataFrame:
    """(mask_id, weighted): whether a mask has weights other than 1."""
    return masks.groupBy("mask_id").agg(F.bool_or(F.col("weight") != 1).alias("weighted"))


#: Region numbers are row * WIDTH + column of a region's first pixel, so images have fewer columns.
WIDTH = 1 << 20


def _steps(connectivity: int | list[list[int]]) -> list[tuple[int, int]]:
    if isinstance(connectivity, int) and not isinstance(connectivity, bool):
        if connectivity not in (1, 2):
            raise ValueError("connectivity is 1, 2 or a table of three by three")
        return [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if 0 < abs(r) + abs(c) <= connectivity]
    table = [[bool(x) for x in row] for row in connectivity]
    if len(table) != 3 or any(len(row) != 3 for row in table):
        raise ValueError("connectivity is 1, 2 or a table of three by three")
    if any(table[r][c] != table[2 - r][2 - c] for r in range(3) for c in range(3)):
        raise ValueError("connectivity must be the same in opposite directions")
    return [(r - 1, c - 1) for r in range(3) for c in range(3) if table[r][c] and (r, c) != (1, 1)]


def regions(mask: DataFrame, *, connectivity: int | list[list[int]] = 1) -> DataFrame:
    """(mask_id, row, col, region): the smallest pixel number that each pixel reaches by neighbours.

    ``connectivity``: of four (1), of eight (2), or as a table of three by three tells. One mask is an image's size.
    """
    steps = _steps(connectivity)

    def label(key, rows):
        import numpy as np
        import pyarrow as pa

        r, c = np.array(rows["row"]), np.array(rows["col"])
        number = {p: k for k, p in enumerate(zip(r.tolist(), c.tolist()))}
        root = list(range(len(r)))

        def top(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for (y, x), k in number.items():
            for dy, dx in steps:
                if (other := number.get((y + dy, x + dx))) is not None:
                    root[max(top(k), top(other))] = min(top(k), top(other))
        low: dict[int, int] = {}
        tops = [top(k) for k in range(len(r))]
        for k, t in enumerate(tops):
            low[t] = min(low.get(t, 1 << 62), int(r[k]) * WIDTH + int(c[k]))
        return pa.table({"mask_id": rows["mask_id"], "row": rows["row"], "col": rows["col"], "region": pa.array([low[t] for t in tops], pa.int64())})

    kind = mask.schema["mask_id"].dataType.simpleString()
    return mask.select("mask_id", "row", "col").groupBy("mask_id").applyInArrow(lambda k, t: label(k, t), f"mask_id {kind}, row int, col int, region long")


def by_size(mask: DataFrame, *, least: int = 10, connectivity: int | list[list[int]] = 1, empty: str = "error") -> DataFrame:
    """Pixels of the regions with at least ``least`` pixels, of weight 1. A mask without any is an error, or left out with ``empty="drop"``."""
    found = regions(mask, connectivity=connectivity)
    n = F.count("*").over(W.partitionBy("mask_id", "region"))
    sized = found.withColumn("n", n).withColumn("most", F.max("n").over(W.partitionBy("mask_id")))
    if empty == "error":
        sized = sized.withColumn("n", F.when(F.col("most") < least, F.raise_error(F.lit("a mask has no region of the least size")).cast("long")).otherwise(F.col("n")))
    return sized.where(F.col("n") >= least).select("mask_id", "row", "col", F.lit(1.0).alias("weight"))


def region_sizes(mask: DataFrame, *, connectivity: int | list[list[int]] = 1) -> DataFrame:
    """(mask_id, region, n): number of pixels of each connected region."""
    return regions(mask, connectivity=connectivity).groupBy("mask_id", "region").agg(F.count("*").alias("n"))
