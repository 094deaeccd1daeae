"""Formats of the vendors' files, decoded into batches of frames, and the tables that frames hold.

``load`` reads files as frames by the data source of ``datasource``: files of records of fixed size by ranges, the others
as a stream, a file in a task, in batches of ``BATCH`` frames, so that memory does not grow with a file.
"""

from __future__ import annotations

import json
import struct
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary import Primitives

VENDORS = ("draeger", "timpel", "sentec")
#: Record sizes of the two formats and how many values follow the frame.
DRAEGER = {4358: 52, 4382: 58}
TIMPEL_COLUMNS, TIMPEL_MISSING = 1030, -1000.0
SENTEC_PERIOD = 2**32 - 1
# The signals among the values after a frame, with their units; the fourfold pressures are the pod's, from place 54.
SIGNALS = [("airway pressure", "mbar"), ("flow", "L/min"), ("volume", "mL"), ("CO2 (%)", "%"), ("CO2 (kPa)", "kPa"), ("CO2 (mmHg)", "mmHg")]
POD_SIGNALS = [("airway pressure (pod)", "mbar"), ("esophageal pressure (pod)", "mbar"), ("transpulmonary pressure (pod)", "mbar"), ("gastric pressure/auxiliary pressure (pod)", "mbar")]
POD_PLACE = 54
PIXELS = 1024

BATCH = 1024
#: Sentec's domains of fields: measurements (time 0, image 5) and settings (sample frequency 1).
MEASURED, SETTINGS = 16, 64

FRAME = "path string, frame_idx long, time double, pixels array<double>, phase int, marker int, marker_before int, text string, qrs boolean, rate double, aux array<double>"
#: Phase flags: smallest, largest, and both in one frame.
LOW, HIGH, BOTH = -1, 1, 2


def batch(name: str, first: int, columns: dict[str, list | np.ndarray | pa.Array], n: int) -> pa.RecordBatch:
    """Consecutive frames; what is not given is missing, flags and markers are 0."""
    plain = {
        "path": pa.array([name] * n, pa.string()), "frame_idx": pa.array(np.arange(first, first + n)), "phase": pa.array(np.zeros(n, dtype=np.int32)), "marker": pa.array(np.zeros(n, dtype=np.int32)),
        "marker_before": pa.nulls(n, pa.int32()), "text": pa.array([""] * n), "qrs": pa.nulls(n, pa.bool_()), "rate": pa.nulls(n, pa.float64()), "aux": pa.array([[]] * n, pa.list_(pa.float64())),
    }
    names = ["path", "frame_idx", "time", "pixels", "phase", "marker", "marker_before", "text", "qrs", "rate", "aux"]
    return pa.RecordBatch.from_arrays([columns.get(c, plain.get(c)) for c in names], names=names)


def lists(values: np.ndarray, missing: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists, with nulls where values are missing."""
    n, width = values.shape
    flat = pa.array(values.astype(float).ravel(), mask=missing.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), flat)


def draeger_dtype(aux: int) -> np.dtype:
    return np.dtype([("time", "<f8"), ("skip", "<f4"), ("pixels", "<f4", PIXELS), ("phase", "<i4"), ("marker", "<i4"), ("text", "S30"), ("error", "<i4"), ("aux", "<f4", aux)])


def draeger_batch(name: str, first: int, part: np.ndarray, before: int | None = None) -> pa.RecordBatch:
    """Frames of consecutive records. Time is in days, values below -1e30 are missing; ``before`` is the marker of the record before the first."""
    held = {n: lists(part[n], (part[n] < -1e30) | np.isnan(part[n])) for n in ("pixels", "aux")}
    marker = part["marker"].astype(np.int32)
    earlier = pa.array([before, *marker[:-1].tolist()][: len(part)], pa.int32())
    text = pa.array([t.decode("latin-1").rstrip("\0 ") for t in part["text"]])
    columns = {"time": pa.array(part["time"] * 86400.0), "phase": pa.array(part["phase"].astype(np.int32)), "marker": pa.array(marker), "marker_before": earlier, "text": text}
    return batch(name, first, columns | held, len(part))


def timpel_batches(name: str, lines: Iterator[str], rate: float | None) -> Iterator[pa.RecordBatch]:
    """Text of 1030 columns: pixels (-1000 is missing), pressure, flow, volume, smallest and largest flag, QRS flag."""
    first, rows = 0, []

    def made() -> pa.RecordBatch:
        v = np.array(rows)
        low, high = v[:, PIXELS + 3] == 1, v[:, PIXELS + 4] == 1
        phase = np.where(low & high, BOTH, np.where(low, LOW, np.where(high, HIGH, 0))).astype(np.int32)
        time = (first + np.arange(len(v))) / (rate or 50.0)
        none = np.zeros((len(v), 3), dtype=bool)
        columns = {"time": pa.array(time), "pixels": lists(v[:, :PIXELS], v[:, :PIXELS] == TIMPEL_MISSING), "phase": pa.array(phase), "qrs": pa.array(v[:, PIXELS + 5] == 1),
                   "rate": pa.array(np.full(len(v), rate or 50.0)), "aux": lists(v[:, PIXELS : PIXELS + 3], none)}
        return batch(name, first, columns, len(v))

    for line in lines:
        if not line.strip():
            continue
        parts = line.split(",")
        if len(parts) != TIMPEL_COLUMNS:
            raise OSError(f"{name} has a line of {len(parts)} columns instead of {TIMPEL_COLUMNS}")
        try:
            rows.append([float(x) for x in parts])
        except ValueError as e:
            raise OSError(f"{name} has a line that is not of numbers") from e
        if len(rows) == BATCH:
            yield made()
            first, rows = first + len(rows), []
    if rows:
        yield made()


def sentec_batches(name: str, data: Primitives, rate: float | None) -> Iterator[pa.RecordBatch]:
    """Tagged packets, read in order: the time in microseconds, which starts anew every ``SENTEC_PERIOD``, the negated image, the sample frequency.

    A frequency in the file counts from its packet on, rather than a given one.
    """
    first, time, turns, last = 0, 0.0, 0, None
    version = data.u8()
    if version is None:
        return
    rows: list[tuple[float, np.ndarray, float | None]] = []

    def made() -> pa.RecordBatch:
        image = np.array([r[1] for r in rows])
        return batch(name, first, {"time": pa.array([r[0] for r in rows]), "pixels": lists(image, np.isnan(image)), "rate": pa.array([r[2] for r in rows], pa.float64())}, len(rows))

    while data.u64() is not None:  # a time stamp of the packet itself
        domain, fields = data.u8(), data.u8()
        for _ in range(fields or 0):
            kind, size = data.u8(), data.u16()
            body = data.take(size or 0)
            if body is None:  # the file ends within a packet
                break
            if domain == MEASURED and kind == 0:
                now = struct.unpack("<I", body)[0]
                turns += last is not None and now < last - SENTEC_PERIOD // 2
                last, time = now, (now + turns * SENTEC_PERIOD) / 1e6
            elif domain == MEASURED and kind == 5:
                skip = int(version > 1)
                width, height = body[skip], body[skip + 1]
                if len(body) != skip + 2 + 4 * width * height:
                    raise OSError(f"{name} has an image that is not of its stated size")
                rows.append((time, -np.frombuffer(body, "<f4", offset=skip + 2).astype(float), rate))
            elif domain == SETTINGS and kind == 1:
                found = round(struct.unpack("<f", body)[0], 4)
                if rate is not None and rate != found:
                    warnings.warn(f"{name} has a sample frequency of {found}, not {rate}", RuntimeWarning, stacklevel=2)
                rate = found
        if len(rows) >= BATCH:
            yield made()
            first, rows = first + len(rows), []
    if rows:
        yield made()


def vendor_name(vendor: str) -> str:
    name = vendor.lower().replace("dräger", "draeger").replace("drager", "draeger")
    if name not in VENDORS:
        raise NotImplementedError(f"unknown vendor {vendor!r}")
    return name


def load(spark: SparkSession, path: str | list[str], vendor: str, *, first_frame: int = 0, max_frames: int | None = None, rate: float | None = None) -> DataFrame:
    """Frames of files of one vendor, numbered within each file; all files must be there."""
    from . import datasource

    name = vendor_name(vendor)
    if not isinstance(first_frame, int) or isinstance(first_frame, bool):
        raise TypeError("first_frame must be a whole number")
    if first_frame < 0:
        raise ValueError("first_frame must be at least 0")
    datasource.register(spark)
    options = {"paths": json.dumps([path] if isinstance(path, str) else [str(x) for x in path]), "vendor": name, "first_frame": str(first_frame)}
    if max_frames is not None:
        options["max_frames"] = str(max_frames)
    if rate is not None:
        options["rate"] = str(rate)
    return spark.read.format(datasource.NAME).options(**options).load()


def events(frames: DataFrame) -> DataFrame:
    """Frames where the marker rises over the frame before, also one that was not loaded, and a file's first frame with text."""
    return frames.where("marker > marker_before or (marker_before is null and text <> '')").select("path", "frame_idx", "time", "marker", "text")


def signals(frames: DataFrame) -> DataFrame:
    """(path, label, unit, idx, time, value) of the signals recorded beside the frames; which there are follows from their number."""
    count = F.size("aux")
    places = [(k, name, unit, 0) for k, (name, unit) in enumerate(SIGNALS)] + [(POD_PLACE + k, name, unit, POD_PLACE + len(POD_SIGNALS)) for k, (name, unit) in enumerate(POD_SIGNALS)]
    each = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(u).alias("unit"), F.get("aux", F.lit(k)).alias("value"), (F.lit(k) < count).alias("there"), F.lit(least).alias("least")) for k, n, u, least in places])
    held = F.explode(F.filter(each, lambda s: s["there"] & (s["least"] <= count)))
    return frames.select("path", F.col("frame_idx").alias("idx"), "time", held.alias("s")).select("path", "s.label", "s.unit", "idx", "time", "s.value")


def phases(frames: DataFrame) -> DataFrame:
    """(path, time, kind) where the device flags a smallest (-1) or largest (1) value."""
    kinds = F.when(F.col("phase") == BOTH, F.array(F.lit(LOW), F.lit(HIGH))).otherwise(F.array("phase"))
    return frames.where(F.col("phase").isin(LOW, HIGH, BOTH)).select("path", "frame_idx", "time", F.explode(kinds).alias("kind"))


def heart_beats(frames: DataFrame) -> DataFrame:
    """(path, frame_idx, time) where the device flags a heart beat."""
    return frames.where("qrs").select("path", "frame_idx", "time")


def device_breaths(frames: DataFrame) -> DataFrame:
    """Breaths by the device's own flags, at the frames' summed impedance."""
    from ..operators import breaths, maps

    named = frames.withColumnRenamed("path", "recording_id")
    value = maps.global_impedance(named).withColumnRenamed("frame_idx", "idx")
    kinds = phases(frames).select(F.col("path").alias("recording_id"), F.col("frame_idx").alias("idx"), "kind")
    return breaths.of_flags(value.join(kinds, ["recording_id", "idx"])).withColumnRenamed("recording_id", "path")


def monotonic(frames: DataFrame, period: float | None = None) -> DataFrame:
    """The frames with times unwrapped by ``period``; times that then do not ascend raise an error."""
    from pyspark.sql.window import Window as W

    from ..operators import signal

    named = frames.withColumnsRenamed({"path": "recording_id", "frame_idx": "idx"})
    out = signal.unwrap(named, period) if period else named
    before = F.lag("time").over(W.partitionBy("recording_id").orderBy("idx"))
    checked = F.when(F.col("time") <= F.col("before"), F.raise_error(F.lit("times do not ascend")).cast("double")).otherwise(F.col("time"))
    return out.withColumn("before", before).withColumn("time", checked).drop("before").withColumnsRenamed({"recording_id": "path", "idx": "frame_idx"})
