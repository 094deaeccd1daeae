"""Numbers, arrays and strings one after the other from a binary stream."""

from __future__ import annotations

import struct

import numpy as np


class Primitives:
    """Reads from a file object; at the stream's end, or within a value there, None is given. ``endian`` is ``little``, ``big`` or ``native``."""

    KINDS = {"u8": "B", "u16": "H", "u32": "I", "u64": "Q", "i32": "i", "f32": "f", "f64": "d"}

    def __init__(self, file, endian: str = "little", *, buffer: int = 1 << 20) -> None:
        if endian not in ("little", "big", "native"):
            raise ValueError("endian is little, big or native")
        self.mark = {"little": "<", "big": ">", "native": "="}[endian]
        self.file, self.buffer, self.held, self.at = file, buffer, b"", 0

    def take(self, n: int) -> bytes | None:
        """The next n bytes."""
        if len(self.held) - self.at < n:
            more = [self.held[self.at :]]
            size = len(more[0])
            while size < n and (part := self.file.read(max(self.buffer, n - size))):
                more.append(part)
                size += len(part)
            self.held, self.at = b"".join(more), 0
            if size < n:
                return None
        self.at += n
        return self.held[self.at - n : self.at]

    def _one(self, kind: str) -> int | float | None:
        code = self.mark + self.KINDS[kind]
        data = self.take(struct.calcsize(code))
        return None if data is None else struct.unpack(code, data)[0]

    def u8(self) -> int | None:
        return self._one("u8")

    def u16(self) -> int | None:
        return self._one("u16")

    def u32(self) -> int | None:
        return self._one("u32")

    def u64(self) -> int | None:
        return self._one("u64")

    def i32(self) -> int | None:
        return self._one("i32")

    def f32(self) -> float | None:
        return self._one("f32")

    def f64(self) -> float | None:
        return self._one("f64")

    def array(self, kind: str, n: int) -> np.ndarray | None:
        """n numbers of a kind."""
        dtype = np.dtype(self.mark + {"B": "u1", "H": "u2", "I": "u4", "Q": "u8", "i": "i4", "f": "f4", "d": "f8"}[self.KINDS[kind]])
        data = self.take(n * dtype.itemsize)
        return None if data is None else np.frombuffer(data, dtype)

    def string(self, n: int, encoding: str = "utf-8") -> str | None:
        """n bytes as text, without zero bytes at the end."""
        data = self.take(n)
        return None if data is None else data.rstrip(b"\0").decode(encoding)
