"""Files of a recording as a sequence of tables, with the catalogue of what they hold."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maps, signal
from ..operators.sequences import Catalogue, Entry, Sequence
from . import vendors

#: Time of day, which starts anew after so many seconds.
DAY = 86_400.0


@dataclass(frozen=True)
class Loaded:
    """``sequence`` has the frames, signals by label, events, phases and device breaths; ``rate`` the sample frequency."""

    sequence: Sequence
    catalogue: Catalogue
    events: DataFrame
    phases: DataFrame
    rate: DataFrame


def _united(frames: DataFrame, paths: list[str], label: str) -> DataFrame:
    """Frames of all files as one recording, files in the given order. The list of files, and of their sizes, is the caller's own."""
    counts = {r["path"]: (r["n"], r["first"]) for r in frames.groupBy("path").agg(F.count("*").alias("n"), F.min("frame_idx").alias("first")).collect()}
    order = sorted(counts, key=lambda p: (next((k for k, x in enumerate(paths) if p == x or p.startswith(x.rstrip("/") + "/")), len(paths)), p))
    shift, at = {}, 0
    for p in order:
        shift[p] = at - counts[p][1]
        at += counts[p][0]
    moved = F.create_map(*[F.lit(x) for pair in shift.items() for x in pair])[F.col("path")] if shift else F.lit(0)
    return frames.withColumn("frame_idx", (F.col("frame_idx") + moved).cast("long")).withColumn("path", F.lit(label))


def load(
    spark: SparkSession, path: str | list[str], vendor: str, *, label: str | None = None, name: str | None = None, description: str = "", rate: float | None = None,
    first_frame: int = 0, max_frames: int | None = None,
) -> Loaded:
    """Files of one vendor, each from ``first_frame`` on, joined end to end as one recording; later files must begin after earlier ones end.

    The recording's id is ``label``, the first file's name without one. Times of day go on over midnight. A warning tells of
    files with fewer frames than ``max_frames``.
    """
    paths = [path] if isinstance(path, str) else [str(p) for p in path]
    label = label or PurePath(paths[0]).stem
    frames = vendors.load(spark, paths, vendor, first_frame=first_frame, max_frames=max_frames, rate=rate)
    if max_frames is not None:
        few = [r["path"] for r in frames.groupBy("path").count().where(F.col("count") < max_frames).collect()]
        if few:
            warnings.warn(f"fewer than {max_frames} frames are left in {few}", RuntimeWarning, stacklevel=2)
    frames = vendors.monotonic(_united(frames, paths, label), DAY if vendors.vendor_name(vendor) == "draeger" else None)
    named = frames.withColumnRenamed("path", "recording_id")
    images = named.select("recording_id", "frame_idx", "time", "pixels")
    total = maps.global_impedance(images).select("recording_id", F.lit("global_impedance_(raw)").alias("label"), F.col("frame_idx").alias("idx"), "time", "value")
    beside = vendors.signals(frames).withColumnRenamed("path", "recording_id")
    events = vendors.events(frames).withColumnRenamed("path", "recording_id")
    phases = vendors.phases(frames).withColumnRenamed("path", "recording_id")
    device = vendors.device_breaths(frames).select(F.col("path").alias("recording_id"), "start_time", "end_time", F.col("middle_value").alias("value"))
    sequence = Sequence(
        continuous=total.unionByName(beside.select(*total.columns)), sparse=phases.select("recording_id", "time", F.col("kind").cast("double").alias("value")), intervals=device, frames=images
    )
    stated = named.groupBy("recording_id").agg(F.max("rate").alias("stated"))
    measured = signal.sample_frequency(total.select("recording_id", "idx", "time"))
    given = F.lit(rate).cast("double")
    found = measured.join(stated, "recording_id").select("recording_id", F.coalesce("stated", given, "sample_frequency").alias("sample_frequency"))
    parameters = {"vendor": vendors.vendor_name(vendor), "paths": json.dumps(paths)}
    catalogue = Catalogue([
        Entry(label, "frames", "impedance", name=name or label, description=description, parameters=parameters),
        Entry("global_impedance_(raw)", "continuous", "impedance", "a.u.", "Global impedance (raw)", parents=(label,)),
        Entry("phases", "sparse", "other", parents=(label,)), Entry("events", "sparse", "other", parents=(label,)), Entry("device breaths", "intervals", "other", parents=(label, "phases")),
    ])
    return Loaded(sequence, catalogue, events, phases, found)

