"""Sequences: the tables of recordings that belong together, selected and joined end to end as one.

``continuous`` has (recording_id, label, idx, time, value), ``sparse`` (recording_id, label, time, value), ``intervals``
(recording_id, label, start_time, end_time, value) and ``frames`` (recording_id, frame_idx, time, pixels). Any may be None.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import select


@dataclass(frozen=True)
class Sequence:
    """Tables of recordings on one axis of time."""

    continuous: DataFrame | None = None
    sparse: DataFrame | None = None
    intervals: DataFrame | None = None
    frames: DataFrame | None = None

    def by_index(self, start: int | None = None, stop: int | None = None, *, inclusive_tail: bool = False) -> Sequence:
        """Samples of [start, stop); points and intervals by the times of the first and last sample kept.

        A point at the last time is left out unless ``inclusive_tail``. The frames give the axis where there are any.
        """
        axis = None
        kept: dict[str, DataFrame | None] = {"continuous": None, "frames": None}
        for name, idx in (("continuous", "idx"), ("frames", "frame_idx")):
            table = getattr(self, name)
            if table is not None:
                kept[name] = axis = select.by_index(table, start, stop, idx, by=_keys(table))
        if axis is None:
            raise ValueError("a sequence without samples has no index")
        ends = axis.groupBy("recording_id").agg(F.min("time").alias("from time"), F.max("time").alias("to time"))
        before = F.col("time") <= F.col("to time") if inclusive_tail else F.col("time") < F.col("to time")
        tests = {"sparse": (F.col("time") >= F.col("from time")) & before, "intervals": (F.col("start_time") >= F.col("from time")) & (F.col("end_time") <= F.col("to time"))}
        rest = {n: None if (t := getattr(self, n)) is None else t.join(ends, "recording_id").where(test).select(*t.columns) for n, test in tests.items()}
        return Sequence(**kept, **rest)

    def by_time(self, start: float | None = None, end: float | None = None, *, start_inclusive: bool = True, end_inclusive: bool = False, partial: bool = False) -> Sequence:
        """All tables between two times; intervals within, or cut to, the range. Inclusion of the ends does not concern intervals."""
        out = {}
        for name in ("continuous", "sparse", "frames"):
            table = getattr(self, name)
            out[name] = None if table is None else select.by_time(table, start, end, start_inclusive=start_inclusive, end_inclusive=end_inclusive, by=_keys(table))
        low, high = float("-inf") if start is None else start, float("inf") if end is None else end
        out["intervals"] = None if self.intervals is None else select.intervals(self.intervals, low, high, partial=partial)
        return Sequence(**out)

    def concatenate(self, later: Sequence) -> Sequence:
        """Both, table by table; a table that one of them lacks is an error, as is one that does not begin after the other's end."""
        out = {}
        for f in fields(self):
            a, b = getattr(self, f.name), getattr(later, f.name)
            if (a is None) != (b is None):
                raise ValueError(f"only one of the sequences has {f.name}")
            if a is None:
                continue
            if f.name in ("continuous", "frames"):
                out[f.name] = select.concatenate(a, b, idx="idx" if f.name == "continuous" else "frame_idx", by=_keys(a))
            else:
                out[f.name] = select.concatenate_points(a, b, by=_keys(a))
        return Sequence(**out)

    def rows(self) -> DataFrame:
        """(part, recording_id, start, end, value) of the signals, points and intervals in one table."""
        parts = []
        for name, start, end in (("continuous", "time", "time"), ("sparse", "time", "time"), ("intervals", "start_time", "end_time")):
            if (t := getattr(self, name)) is not None:
                parts.append(t.select(F.lit(name).alias("part"), "recording_id", F.col(start).alias("start"), F.col(end).alias("end"), "value"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def _keys(table: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in ("recording_id", "label") if c in table.columns)


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (equal): the same rows, as often, missing values being equal to each other. One shuffle: copies are counted on either side."""
    if sorted(a.columns) != sorted(b.columns):
        return a.sparkSession.range(1).select(F.lit(False).alias("equal"))
    sided = a.withColumn("side", F.lit(1)).unionByName(b.withColumn("side", F.lit(-1)))
    left = sided.groupBy(*a.columns).agg(F.sum("side").alias("n")).where("n <> 0")
    return left.agg((F.count("*") == 0).alias("equal"))


def derive(data: DataFrame, function, value: str = "value") -> DataFrame:
    """Values replaced by a function of their column."""
    return data.withColumn(value, function(F.col(value)))


def summary(data: DataFrame) -> DataFrame:
    """Size, extent and completeness of each recording's samples."""
    has: Column = F.count("value") > 0
    return data.groupBy("recording_id").agg(F.count("*").alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), has.alias("has_values"), (F.count("*") - F.count("value")).alias("missing"))


def statistics(data: DataFrame) -> DataFrame:
    """Mean, median, percentiles, deviation and largest value of each recording, all exact."""
    v = "value"
    return data.groupBy("recording_id").agg(
        F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile(v, F.lit(0.05)).alias("p5"), F.percentile(v, F.lit(0.95)).alias("p95"), F.stddev_pop(v).alias("deviation"), F.max(v).alias("largest")
    )


def as_of(points: DataFrame, data: DataFrame) -> DataFrame:
    """Points (recording_id, time, …) with ``idx`` of the first sample not before them, null after the last.

    Both sides are put in order of time together and the next sample is looked up by a window, so no pair is compared.
    """
    extra = [c for c in points.columns if c not in ("recording_id", "time")]
    left = points.select("recording_id", "time", F.struct(F.lit(1).alias("is point"), *extra).alias("point"), F.lit(None).cast("long").alias("at"))
    right = data.select("recording_id", "time", F.lit(None).cast(left.schema["point"].dataType).alias("point"), F.col("idx").alias("at"))
    # Backwards, so that the window only grows.
    order = W.partitionBy("recording_id").orderBy(F.desc("time"), F.col("point").isNull().desc(), F.desc("at")).rowsBetween(W.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("idx", F.last("at", ignorenulls=True).over(order)).where("point is not null")
    return found.select("recording_id", "time", *[F.col("point")[c].alias(c) for c in extra], "idx")


@dataclass(frozen=True)
class Entry:
    """What is known of a series: ``parents`` are the labels that it was derived from."""

    label: str
    kind: str
    category: str
    unit: str | None = None
    name: str | None = None
    description: str = ""
    parents: tuple[str, ...] = ()
    parameters: dict[str, str] = field(default_factory=dict)


class Catalogue:
    """Entries by label. There is one for each series, whatever the number of its samples, so it lives on the driver."""

    def __init__(self, entries: list[Entry] | tuple[Entry, ...] = ()) -> None:
        self._entries: dict[str, Entry] = {}
        for e in entries:
            self.add(e)

    def __contains__(self, label: str) -> bool:
        return label in self._entries

    def __getitem__(self, label: str) -> Entry:
        return self._entries[label]

    def __iter__(self):
        return iter(self._entries)

    def __len__(self) -> int:
        return len(self._entries)

    def add(self, entry: Entry, *, overwrite: bool = False) -> None:
        if entry.label in self._entries and not overwrite:
            raise KeyError(f"{entry.label!r} is in the catalogue already")
        self._entries[entry.label] = entry

    def remove(self, label: str) -> None:
        del self._entries[label]

    def copied(self, label: str, new: str, **changed) -> Entry:
        """Add a copy with changed fields, derived from the first; its parameters are merged."""
        old = self[label]
        parameters = {**old.parameters, **changed.pop("parameters", {})}
        entry = replace(old, label=new, parents=(label,), parameters=parameters, **changed)
        self.add(entry)
        return entry

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(e.label, e.kind, e.category, e.unit, e.name or e.label, e.description, list(e.parents), e.parameters) for e in self._entries.values()]
        return spark.createDataFrame(rows, "label string, kind string, category string, unit string, name string, description string, parents array<string>, parameters map<string,string>")

    def loaded(self) -> list[str]:
        """Labels of series that come from files."""
        return [e.label for e in self._entries.values() if not e.parents]

    def derived(self) -> list[str]:
        return [e.label for e in self._entries.values() if e.parents]

    def descendants(self, label: str) -> dict[str, int]:
        """Labels derived from one, at any remove, with the smallest number of steps."""
        found, level, step = {}, {label}, 0
        while level:
            step += 1
            level = {e.label for e in self._entries.values() if level & set(e.parents)} - found.keys() - {label}
            found |= dict.fromkeys(level, step)
        return found
