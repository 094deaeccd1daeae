"""Frames written in the vendors' formats, a file for each recording, by the tasks that hold them."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vendors

SUFFIX = {"draeger": "bin", "timpel": "txt", "sentec": "zri"}


def _pixels(table: pa.Table) -> np.ndarray:
    return np.array(table["pixels"].to_pylist(), dtype=float)


def draeger_bytes(table: pa.Table, rate: float) -> bytes:
    """Records of the smaller size; pixels that are missing or not there hold a very low value."""
    records = np.zeros(len(table), dtype=vendors.draeger_dtype(vendors.DRAEGER[min(vendors.DRAEGER)]))
    x = _pixels(table)
    records["pixels"][:] = -2e30
    records["pixels"][:, : x.shape[1]] = np.where(np.isnan(x), -2e30, x)
    for name in ("phase", "marker"):
        records[name] = np.array(table[name])
    records["time"] = np.array(table["time"]) / 86400.0
    records["aux"][:, 0] = np.nan_to_num(x).mean(axis=1)
    return records.tobytes()


def timpel_bytes(table: pa.Table, rate: float) -> bytes:
    """Lines of 1030 numbers; a marker above 0 becomes the heart beat's flag."""
    lines = []
    for x, phase, marker in zip(_pixels(table), table["phase"].to_pylist(), table["marker"].to_pylist()):
        image = np.full(vendors.PIXELS, vendors.TIMPEL_MISSING)
        image[: len(x)] = np.where(np.isnan(x), vendors.TIMPEL_MISSING, x)
        flags = [int(phase in (vendors.LOW, vendors.BOTH)), int(phase in (vendors.HIGH, vendors.BOTH)), int(marker > 0)]
        lines.append(",".join(map(repr, [*image.tolist(), float(np.nan_to_num(x).mean()), 0.0, 0.0])) + "," + ",".join(map(str, flags)))
    return ("\n".join(lines) + "\n").encode()


def sentec_bytes(table: pa.Table, rate: float) -> bytes:
    """Packets of version 2: first the sample frequency, then for each frame its time and its negated image of one row."""
    out = [b"\x02", struct.pack("<QBB", 0, vendors.SETTINGS, 1), struct.pack("<BHf", 1, 4, rate)]
    for time, x in zip(table["time"].to_pylist(), _pixels(table)):
        image = struct.pack("<3B", 100, len(x), 1) + (-x).astype("<f4").tobytes()
        out += [struct.pack("<QBB", 0, vendors.MEASURED, 2), struct.pack("<BHI", 0, 4, round(time * 1e6) % vendors.SENTEC_PERIOD), struct.pack("<BH", 5, len(image)), image]
    return b"".join(out)


def write(frames: DataFrame, folder: str, vendor: str, rate: float) -> list[str]:
    """Files of (recording_id, frame_idx, time, pixels, phase, marker) in a folder that driver and executors share; their paths in order of ids.

    Files have names of their own recording, so a task that is repeated writes the same one. There is a path for each
    recording, which the driver needs to read them.
    """
    from .datasource import _opened

    encode = {"draeger": draeger_bytes, "timpel": timpel_bytes, "sentec": sentec_bytes}[vendors.vendor_name(vendor)]
    suffix = SUFFIX[vendors.vendor_name(vendor)]

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_idx")
        key = table["recording_id"][0].as_py()
        path = f"{folder}/{key}.{suffix}"
        system, inner = _opened(path)
        system.create_dir(inner.rsplit("/", 1)[0])
        with system.open_output_stream(inner, compression=None) as f:
            f.write(encode(table, rate))
        return pa.table({"recording_id": pa.array([key], pa.int64()), "path": [path]})

    cols = frames.select(F.col("recording_id").cast("long").alias("recording_id"), "frame_idx", "time", "pixels", "phase", "marker")
    written = cols.groupBy("recording_id").applyInArrow(each, "recording_id long, path string")
    return [r["path"] for r in written.orderBy("recording_id").collect()]
