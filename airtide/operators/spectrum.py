"""Filters and rate detection: series of a recording go to a task together, as one row of samples for each series."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels

LIMITS = {"adult": ((6 / 60, 60 / 60), (40 / 60, 160 / 60)), "neonate": ((15 / 60, 85 / 60), (90 / 60, 210 / 60))}
NOISE_LIMIT, NOTCH = 220 / 60, 10 / 60


def _map_series(data: DataFrame, run) -> DataFrame:
    """``run`` over the values of each recording in order of idx."""

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        values = run(np.array(table["value"], dtype=float))
        return table.set_column(table.column_names.index("value"), "value", pa.array(values))

    cols = data.select("recording_id", "idx", "time", F.col("value").cast("double").alias("value"))
    return cols.groupBy("recording_id").applyInArrow(each, cols.schema)


def _map_frames(frames: DataFrame, run) -> DataFrame:
    """``run`` over the pixels (pixel, frame) of each recording in order of frames."""

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_idx")
        x = run(np.array(table["pixels"].to_pylist(), dtype=float).T).T
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))
        return table.set_column(table.column_names.index("pixels"), "pixels", flat)

    cols = frames.select("recording_id", "frame_idx", "time", F.col("pixels").cast("array<double>").alias("pixels"))
    return cols.groupBy("recording_id").applyInArrow(each, cols.schema)


class Filter(Protocol):
    """What filters have in common."""

    def apply(self, data: DataFrame, captures: dict | None = None) -> DataFrame:
        """``data`` filtered: signals by value, frames by each of their pixels. ``captures`` takes the input, the output and what was designed."""


def _applied(data: DataFrame, run, captures: dict | None, **designed) -> DataFrame:
    out = (_map_frames if "pixels" in data.columns else _map_series)(data, run)
    if captures is not None:
        captures.update(designed, unfiltered=data, filtered=out)
    return out


@dataclass(frozen=True)
class Butterworth:
    """Zero-phase Butterworth filter: lowpass, highpass, bandpass or bandstop; it is designed once on the driver."""

    kind: str
    cutoff: float | tuple[float, float]
    order: int
    rate: float
    ignore_max_order: bool = False

    def __post_init__(self) -> None:
        if self.order > 10 and not self.ignore_max_order:
            raise ValueError("order must be 10 at most")
        kernels.butterworth(self.kind, self.cutoff, self.order, self.rate)

    def apply(self, data: DataFrame, captures: dict | None = None) -> DataFrame:
        sos = kernels.butterworth(self.kind, self.cutoff, self.order, self.rate)
        return _applied(data, lambda v: kernels.zero_phase(sos, v), captures, sections=sos)


def butterworth(data: DataFrame, kind: str, cutoff: float | tuple[float, float], order: int, rate: float, *, ignore_max_order: bool = False) -> DataFrame:
    """The filter at once."""
    return Butterworth(kind, cutoff, order, rate, ignore_max_order).apply(data)


def notch_bands(respiratory: float, heart: float, *, limit: float = NOISE_LIMIT, notch: float = NOTCH) -> list[tuple[int, float, float]]:
    """(harmonic, low, high) of the bands around the heart rate's harmonics; the first keeps clear of the respiratory rate."""
    if respiratory <= 0 or heart <= 0 or respiratory >= heart:
        raise ValueError("rates must be positive, the respiratory rate the lower")
    n = int((limit + notch) / heart)
    return [(k, max(k * heart - notch, (heart + respiratory) / 2) if k == 1 else k * heart - notch, k * heart + notch) for k in range(1, n + 1)]


@dataclass(frozen=True)
class MultipleNotch:
    """Band stops around the heart rate's harmonics, then a low pass, in one pass over each series."""

    respiratory: float
    heart: float
    rate: float
    limit: float = NOISE_LIMIT
    notch: float = NOTCH
    order: int = 10

    def __post_init__(self) -> None:
        notch_bands(self.respiratory, self.heart, limit=self.limit, notch=self.notch)

    def apply(self, data: DataFrame, captures: dict | None = None) -> DataFrame:
        bands = notch_bands(self.respiratory, self.heart, limit=self.limit, notch=self.notch)
        filters = [kernels.butterworth("bandstop", (low, high), self.order, self.rate) for _, low, high in bands]
        filters.append(kernels.butterworth("lowpass", self.limit, self.order, self.rate))

        def run(v: np.ndarray) -> np.ndarray:
            for sos in filters:
                v = kernels.zero_phase(sos, v)
            return v

        return _applied(data, run, captures, bands=bands, n_harmonics=len(bands))


def multiple_notch(data: DataFrame, respiratory: float, heart: float, rate: float, *, limit: float = NOISE_LIMIT, notch: float = NOTCH, order: int = 10) -> DataFrame:
    """The filter at once."""
    return MultipleNotch(respiratory, heart, rate, limit, notch, order).apply(data)


def rates(frames: DataFrame, rate: float, subject: str = "adult", *, window: float = 30.0, overlap: float = 0.5, refine: bool = True) -> DataFrame:
    """(recording_id, respiratory_rate, heart_rate) in Hz, from the spectra of the sum and of the pixels."""
    (r_low, r_high), (h_low, h_high) = LIMITS[subject]

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_idx")
        x = np.array(table["pixels"].to_pylist(), dtype=float).T
        x = np.where(np.isnan(x), 0.0, x)
        size = min(int(window * rate), x.shape[1])
        freq, total = kernels.welch(x.sum(axis=0), rate, size, int(size * overlap))
        _, each_ = kernels.welch(x, rate, size, int(size * overlap))
        sums = each_.sum(axis=1)
        total, mean = total / total.sum(), (each_[sums > 0] / sums[sums > 0, None]).mean(axis=0)
        pick = kernels.refined_peak if refine else lambda f, p, a, b: float(f[(f >= a) & (f <= b)][p[(f >= a) & (f <= b)].argmax()])
        return pa.table({"recording_id": table["recording_id"].slice(0, 1), "respiratory_rate": [pick(freq, total, r_low, r_high)], "heart_rate": [pick(freq, mean - total, h_low, h_high)]})

    cols = frames.select("recording_id", "frame_idx", "pixels")
    kind = cols.schema["recording_id"].dataType.simpleString()
    return cols.groupBy("recording_id").applyInArrow(each, f"recording_id {kind}, respiratory_rate double, heart_rate double")


def spectra(frames: DataFrame, rate: float, size: int, overlap: int) -> DataFrame:
    """(recording_id, k, frequency, total, pixels, difference): spectra that sum to 1, of the summed signal and the mean of the pixels'.

    Pixels without any power are left out of the mean; a recording shorter than a segment has no rows. Missing pixels count 0.
    """

    def each(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame_idx")
        x = np.array(table["pixels"].to_pylist(), dtype=float).T
        x = np.where(np.isnan(x), 0.0, x)
        n = size // 2 + 1 if x.shape[1] >= size else 0
        freq = power = total = mean = np.empty(0)
        if n:
            freq, total = kernels.welch(x.sum(axis=0), rate, size, overlap)
            _, power = kernels.welch(x, rate, size, overlap)
            sums = power.sum(axis=1)
            some = sums > 0
            total = total / total.sum() if total.sum() > 0 else np.zeros(n)
            mean = (power[some] / sums[some, None]).mean(axis=0) if some.any() else np.zeros(n)
        ids = pa.array([table["recording_id"][0].as_py()] * n, table.schema.field("recording_id").type)
        return pa.table({"recording_id": ids, "k": pa.array(range(n), pa.int32()), "frequency": freq, "total": total, "pixels": mean, "difference": mean - total})

    cols = frames.select("recording_id", "frame_idx", "pixels")
    kind = cols.schema["recording_id"].dataType.simpleString()
    return cols.groupBy("recording_id").applyInArrow(each, f"recording_id {kind}, k int, frequency double, total double, pixels double, difference double")


def power(data: DataFrame, rate: float, size: int, overlap: int) -> DataFrame:
    """(recording_id, k, frequency, per_minute, power) of a signal, for comparing one before and after a filter. Shorter signals are one segment."""

    def each(table: pa.Table) -> pa.Table:
        v = np.array(table.sort_by("idx")["value"], dtype=float)
        n = min(size, len(v))
        freq, p = kernels.welch(v, rate, n, min(overlap, n - 1))
        ids = pa.array([table["recording_id"][0].as_py()] * len(freq), table.schema.field("recording_id").type)
        return pa.table({"recording_id": ids, "k": pa.array(range(len(freq)), pa.int32()), "frequency": freq, "per_minute": freq * 60, "power": p})

    cols = data.select("recording_id", "idx", F.col("value").cast("double").alias("value"))
    kind = cols.schema["recording_id"].dataType.simpleString()
    return cols.groupBy("recording_id").applyInArrow(each, f"recording_id {kind}, k int, frequency double, per_minute double, power double")
