"""Marker events of a stream of frames: a rise of the marker, kept across micro-batches by recording."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def marker_events(frames: DataFrame) -> DataFrame:
    """(recording_id, time, marker) for a streaming frame table (recording_id long, time double, marker int), in order of time."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("time")
        found = []
        for time, marker in zip(rows["time"], rows["marker"]):
            if last is not None and marker > last:
                found.append((key[0], time, marker))
            last = int(marker)
        state.update((last,))
        yield pd.DataFrame(found, columns=["recording_id", "time", "marker"]).astype({"recording_id": "int64", "time": "float64", "marker": "int32"})

    grouped = frames.select("recording_id", "time", "marker").groupBy("recording_id")
    return grouped.applyInPandasWithState(update, "recording_id long, time double, marker int", "last int", "append", "NoTimeout")
