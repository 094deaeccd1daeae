"""``spark.read.format("airtide_frames")``: the vendors' files as a Python data source.

Files of fixed-size records are split into ranges of frames, of which each task reads only its own bytes; the other two
formats are read as a stream, a file in a task. Files may be on any file system that Arrow knows. Options: ``path`` (a
file or a folder, several with commas) or ``paths`` (a JSON list), ``vendor``, ``first_frame``, ``max_frames``, ``rate``,
``frames_per_task``.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .binary import Primitives
from .vendors import BATCH, DRAEGER, FRAME, draeger_batch, draeger_dtype, sentec_batches, timpel_batches, vendor_name

NAME = "airtide_frames"


@dataclass
class Span(InputPartition):
    """Frames [first, stop) of a file; size is that of a record, 0 for none."""

    path: str
    size: int
    first: int
    stop: int | None


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system, inner


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = json.loads(options["paths"]) if "paths" in options else [p.strip() for p in options["path"].split(",")]
        self.vendor = vendor_name(options.get("vendor", "draeger"))
        self.first, self.most = int(options.get("first_frame", 0)), options.get("max_frames")
        self.rate = float(options["rate"]) if "rate" in options else None
        self.step = int(options.get("frames_per_task", 16_384))
        if self.first < 0 or self.step < 1:
            raise ValueError("first_frame must be a whole number of at least 0, frames_per_task of at least 1")

    def files(self) -> Iterator[tuple[str, int]]:
        """(path, bytes) of every file; one that is missing is an error."""
        from pyarrow import fs

        for path in self.paths:
            system, inner = _opened(path)
            info = system.get_file_info(inner)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            if info.type == fs.FileType.File:
                yield path, info.size
                continue
            for x in sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda x: x.path):
                if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")):
                    yield path.rstrip("/") + "/" + x.base_name, x.size

    def partitions(self) -> list[Span]:
        out: list[Span] = []
        most = None if self.most is None else self.first + int(self.most)
        for path, length in self.files():
            if self.vendor != "draeger":
                out.append(Span(path, 0, self.first, most))
                continue
            size = next((s for s in DRAEGER if length % s == 0), None)
            if size is None:
                raise OSError(f"{path} has the size of no known format")
            stop = length // size if most is None else min(length // size, most)
            out += [Span(path, size, at, min(at + self.step, stop)) for at in range(self.first, stop, self.step)]
        return out or [Span("", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.path:
            return
        system, inner = _opened(span.path)
        if span.size:
            yield from self._records(system, inner, span)
            return
        with system.open_input_stream(inner, compression=None) as f:
            if self.vendor == "timpel":
                batches = timpel_batches(span.path, io.TextIOWrapper(f, encoding="utf-8", errors="strict"), self.rate)
            else:
                batches = sentec_batches(span.path, Primitives(f), self.rate)
            at = 0
            for batch in batches:
                lo, hi = max(span.first - at, 0), len(batch) if span.stop is None else min(span.stop - at, len(batch))
                if lo < hi:
                    yield batch.slice(lo, hi - lo)
                at += len(batch)
                if span.stop is not None and at >= span.stop:
                    return

    def _records(self, system, inner: str, span: Span) -> Iterator[pa.RecordBatch]:
        kind = draeger_dtype(DRAEGER[span.size])
        with system.open_input_file(inner) as f:
            # The marker of the record before, so that a rise at the first frame is seen.
            before = int(np.frombuffer(f.read_at(span.size, (span.first - 1) * span.size), dtype=kind)["marker"][0]) if span.first else None
            for at in range(span.first, span.stop, BATCH):
                n = min(BATCH, span.stop - at)
                part = np.frombuffer(f.read_at(n * span.size, at * span.size), dtype=kind)
                yield draeger_batch(span.path, at, part, before)
                before = int(part["marker"][-1])


class Frames(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Frames)
