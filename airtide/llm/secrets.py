"""Secret scanning with a recursive decoding worklist.

Every text is scanned as it stands (the base spans). Then a worklist unwraps layers: escapes (percent and Unicode),
base64 runs and compressed payloads. Each decoded layer is scanned with the same rules and put on the worklist in turn,
until nothing new decodes; a layer whose text was seen before is not visited again, which also ends cycles. Every layer
keeps, for each of its characters, the span of original code points it came from, so finds map to the original text.

Escapes are undone in one pass to their own fixpoint: whatever an escape yields may complete another one with the
characters beside it, so any depth of them costs one layer. Layers are made depth first and one at a time. Compressed
payloads are inflated as a stream, member after member, in pieces of about ``PIECE`` characters that end outside of any
run a rule or a decoder could match, so their size has no limit; an unbroken run of more than ``MOST_RUN`` characters is
cut with ``OVERLAP`` characters on either side of the cut. What is inflated maps to the whole payload. Only a payload
within a payload is held at once, so of an inner one of more than ``MOST_RUN`` compressed bytes the rest is not inflated.

Bytes are read leniently: what is no UTF-8 and what is not printable stays in the layer and ends matches, the readable
stretches around it are scanned. Layers with zero bytes are read as UTF-16 and UTF-32 too. Base64 is tried from each of
the first four characters of a run, by line and over line breaks; compressed payloads may begin anywhere in it.

Defined results: null and empty texts have no spans. Repeated rows give equal rows, null ids pass through, an empty
table gives no rows. Spans are code points with an exclusive end, ordered by start, then kind as in ``KINDS``, then end.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, small_batches

KINDS = ("assign", "access", "hex")
#: Inflated payloads are scanned in pieces of so many bytes; a run without a break may make a piece longer, up to MOST_RUN.
PIECE = 4 << 20
MOST_RUN = 64 << 20
OVERLAP = 1 << 16
#: Every rule and every deeper layer needs so many printable ASCII characters in a row.
LEAST = 12

_WORDS = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so the length can be asked for at once

_NUMERIC = r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});"
_ESCAPE = re.compile(rf"{_NUMERIC}|%([0-9A-Fa-f]{{2}})")
_LAST = re.compile(rf"(?:{_NUMERIC}|%([0-9A-Fa-f]{{2}}))\Z")
#: No escape is longer.
LONGEST = 10
_ENDS = frozenset("0123456789abcdefABCDEF};")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_GAP = r"[ \t]*+(?:\r\n?|\n|(?:\\r)?\\n)[ \t]*+"  # a line break, also a written one as in JSON
_BREAK = re.compile(_GAP)
_WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{_GAP}[A-Za-z0-9+/_-]++)++={{0,2}}")
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Two characters that are in no run, or a stretch that no rule can match.
_BETWEEN = re.compile(rb"[\x00-\x1f\x7f-\xff]{12}|[^A-Za-z0-9+/_.=%&#;{}\\\"': \t\r\n\0-]{2}")
_ASCII = re.compile(rb"[\x20-\x7e]{%d}" % LEAST)
_OTHER_SURROGATES = re.compile("[\ud800-\udc7f\udd00-\udfff]")  # those that stand for no byte

Span = tuple[str, int, int]


def scan(text: str) -> list[Span]:
    """The base rules: leftmost non-overlapping matches of each kind that pass its length test."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in _WORDS):
            found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


class Layer:
    """A decoded text and, for each of its characters, where in the original it came from.

    ``inflated`` layers came from a compressed payload, all of whose characters have one place. ``wide`` ones were read
    with other widths of characters already.
    """

    __slots__ = ("begin", "end", "inflated", "text", "wide")

    def __init__(self, text: str, begin: np.ndarray, end: np.ndarray, *, wide: bool = False, inflated: bool = False) -> None:
        self.text, self.begin, self.end, self.wide, self.inflated = text, begin, end, wide, inflated

    def original(self, a: int, b: int) -> tuple[int, int]:
        return int(self.begin[a:b].min()), int(self.end[a:b].max())


def _opener(data: memoryview):
    """A new decompressor for what begins with these magic bytes, or None."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor()
    return None


def _stream(data: memoryview) -> Iterator[bytes]:
    """The content of a compressed payload and of what is joined to its end, in parts; what is broken ends it."""
    while (tool := _opener(data)) is not None:
        if data[:4] == b"\x28\xb5\x2f\xfd":
            source = tool.stream_reader(data, read_across_frames=True, closefd=False)
            while part := source.read(1 << 18):
                yield part
            return
        bounded = isinstance(tool, (bz2.BZ2Decompressor, lzma.LZMADecompressor))
        feed, at = b"", 0
        while not tool.eof:
            if bounded:
                if tool.needs_input:
                    feed, at = bytes(data[at : at + (1 << 16)]), at + (1 << 16)
                    if not feed:
                        return
                part, feed = tool.decompress(feed, 1 << 18), b""
            else:
                if not feed:
                    feed, at = bytes(data[at : at + (1 << 16)]), at + (1 << 16)
                    if not feed:
                        return
                part = tool.decompress(feed, 1 << 18)
                feed = tool.unconsumed_tail
            if part:
                yield part
        at = min(at, len(data))
        data = data[at - len(tool.unused_data) :]


def _cut(data: bytearray) -> int:
    """Where a piece may end: behind the last place in reach that no rule and no run of a decoder goes over, or 0."""
    from_ = max(0, len(data) - OVERLAP)
    at = 0
    for m in _BETWEEN.finditer(data, from_):
        at = m.end()
    return at


def _opens(data: bytearray, from_: int) -> bool:
    """Whether a compressed payload begins in the data: its first bytes inflate without an error."""
    view = memoryview(bytes(data[from_:]))
    for m in _MAGIC.finditer(view):
        try:
            if next(_stream(view[m.start() : m.start() + 512]), None) is not None:
                return True
        except (zlib.error, OSError, ValueError, lzma.LZMAError, EOFError):
            continue
        except Exception as e:
            if type(e).__name__ != "ZstdError":
                raise
    return False


def _pieces(data: memoryview) -> Iterator[bytes]:
    """The content of a compressed payload in pieces to be scanned on their own; one that holds another payload is made longer."""
    held, looked, holds = bytearray(), 0, False
    try:
        for part in _stream(data):
            held += part
            if len(held) < PIECE or (holds and len(held) < MOST_RUN):
                continue
            if len(held) < MOST_RUN:
                holds, looked = _opens(held, max(0, looked - 8)), len(held)
                if holds:
                    continue
            at = _cut(held)
            if at:
                yield bytes(held[:at])
                del held[:at]
                looked = 0
            elif len(held) >= MOST_RUN:
                yield bytes(held)
                del held[: -2 * OVERLAP]
                looked, holds = 0, False
    except (zlib.error, OSError, ValueError, lzma.LZMAError, EOFError):
        pass
    except Exception as e:  # zstandard has an error class of its own
        if type(e).__name__ != "ZstdError":
            raise
    if held:
        yield bytes(held)


def _unpacked(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(where it begins, a piece of its content) of every compressed payload in the bytes."""
    view = memoryview(data)
    for m in _MAGIC.finditer(data):
        for piece in _pieces(view[m.start() :]):
            yield m.start(), piece


def _read(data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
    """(text, first byte, end byte of each character); a byte that is no UTF-8 becomes a character of its own that no rule matches."""
    text = data.decode("utf-8", "surrogateescape")
    widths = _widths(text)
    stop = np.cumsum(widths)
    return text, stop - widths, stop


def _widths(text: str) -> np.ndarray:
    """How many bytes each character of a text from ``_read`` came from."""
    if text.isascii():
        return np.ones(len(text), dtype=np.int64)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    widths = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    widths[(code >= 0xDC80) & (code <= 0xDCFF)] = 1
    return widths


def _all_of(layer: Layer, a: int, b: int, data: bytes) -> Layer:
    """What was inflated from [a, b) of a layer; every character maps to the whole of it."""
    text = data.decode("utf-8", "surrogateescape")
    lo, hi = layer.original(a, b)
    return Layer(text, np.broadcast_to(np.int64(lo), len(text)), np.broadcast_to(np.int64(hi), len(text)), inflated=True)


def _code(m: re.Match) -> str | None:
    """The character of an escape; a byte of 0x80 or more is held as a surrogate until all are known. None if it stands for none."""
    if m[7]:
        value = int(m[7], 16)
        return chr(value if value < 0x80 else 0xDC00 + value)
    code = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4] or m[6], 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _escapes(layer: Layer) -> Iterator[Layer]:
    """The layer with percent and Unicode escapes undone to their fixpoint, and compressed payloads among the bytes of percent escapes.

    Only what stands near an escape is looked at character by character: characters are pushed one after the other, and
    whenever the last ones are an escape it gives way to what it stands for, which goes on as if it had been there.
    """
    text = layer.text
    parts: list[str] = []
    begins: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    decoded: list[np.ndarray] = []
    at, changed = 0, False
    while m := _ESCAPE.search(text, at):
        near = max(at, m.start() - LONGEST)
        tail = list(text[near : m.start()])
        lo, hi = layer.begin[near : m.start()].tolist(), layer.end[near : m.start()].tolist()
        made = [False] * len(tail)
        i, quiet = m.start(), 0
        while i < len(text) and quiet < LONGEST + 1:
            c = text[i]
            tail.append(c)
            lo.append(int(layer.begin[i]))
            hi.append(int(layer.end[i]))
            made.append(False)
            i, quiet = i + 1, quiet + 1
            while tail[-1] in _ENDS and (e := _LAST.search("".join(tail[-LONGEST:]))) and (new := _code(e)) is not None:
                k = len(tail) - (e.end() - e.start())
                a, b = min(lo[k:]), max(hi[k:])
                del tail[k:], lo[k:], hi[k:], made[k:]
                tail.append(new)
                lo.append(a)
                hi.append(b)
                made.append(bool(e[7]))
                quiet, changed = 0, True
        parts += [text[at:near], *tail]
        begins += [layer.begin[at:near], np.array(lo, dtype=np.int64)]
        ends += [layer.end[at:near], np.array(hi, dtype=np.int64)]
        decoded += [np.zeros(near - at, dtype=bool), np.array(made, dtype=bool)]
        at = i
    if not changed:
        return
    parts.append(text[at:])
    out, begin, end = "".join(parts), np.concatenate([*begins, layer.begin[at:]]), np.concatenate([*ends, layer.end[at:]])
    flags = np.concatenate([np.zeros(1, dtype=bool), *decoded, np.zeros(len(text) - at + 1, dtype=bool)])
    edges = np.flatnonzero(np.diff(flags.astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        data = out[a:b].encode("utf-8", "surrogateescape")
        for start, piece in _unpacked(data):
            yield _all_of(Layer(out, begin, end), a + start, b, piece)  # a decoded byte is one character
    data = out.encode("utf-8", "surrogateescape")
    whole = data.decode("utf-8", "surrogateescape")
    if len(whole) < len(out):  # bytes that make one character
        char = np.repeat(np.arange(len(out)), _widths(out))
        stop = np.cumsum(_widths(whole))
        first = stop - _widths(whole)
        begin, end = np.minimum.reduceat(begin[char], first), np.maximum.reduceat(end[char], first)
    yield Layer(whole, begin, end)


def _nested(layer: Layer) -> Iterator[Layer]:
    """Compressed payloads in what was inflated."""
    if layer.inflated:
        for _, piece in _unpacked(layer.text.encode("utf-8", "surrogateescape")):
            yield _all_of(layer, 0, 1, piece)


def _runs(text: str) -> Iterator[tuple[str, np.ndarray, int]]:
    """(base64 run, place of each character, end with padding): those within a line, and those that go on over line breaks."""
    for m in _BASE64.finditer(text):
        run = m.group().rstrip("=")
        yield run, np.arange(m.start(), m.start() + len(run)), m.end()
    for m in _WRAPPED.finditer(text):
        lines, at = [], m.start()
        for gap in _BREAK.finditer(text, m.start(), m.end()):
            lines.append((at, gap.start()))
            at = gap.end()
        lines.append((at, at + len(text[at : m.end()].rstrip("="))))
        if max(b - a for a, b in lines) >= 16:
            yield "".join(text[a:b] for a, b in lines), np.concatenate([np.arange(a, b) for a, b in lines]), m.end()


def _base64(layer: Layer) -> Iterator[Layer]:
    for run, place, end in _runs(layer.text):
        run = run.replace("-", "+").replace("_", "/")
        for shift in range(4):  # the run may begin with foreign characters
            body = run[shift:]
            body = body[: len(body) - (len(body) % 4 == 1)]
            if len(body) < 16:
                break
            try:
                data = base64.b64decode(body + "=" * (-len(body) % 4))
            except (binascii.Error, ValueError):
                continue
            for at, inner in _unpacked(data):
                yield _all_of(layer, int(place[shift + at // 3 * 4]), end, inner)
            if b"\0" not in data and not _ASCII.search(data):
                continue
            text, first, stop = _read(data)
            a = place[shift + first // 3 * 4]
            b = place[np.minimum(shift + -(-stop // 3) * 4, shift + len(body)) - 1]
            yield Layer(text, layer.begin[a], layer.end[b])


def _wide(layer: Layer) -> Iterator[Layer]:
    """A decoded layer with zero bytes read as UTF-16 and UTF-32 of either byte order, at every alignment."""
    if "\0" not in layer.text or layer.wide:
        return
    data = _OTHER_SURROGATES.sub("\ufffd", layer.text).encode("utf-8", "surrogateescape")
    char = np.repeat(np.arange(len(layer.text)), _widths(_OTHER_SURROGATES.sub("\ufffd", layer.text)))
    for kind, size in (("<u2", 2), (">u2", 2), ("<u4", 4), (">u4", 4)):
        for skip in range(size):
            n = (len(data) - skip) // size
            if n < 16:  # no rule matches less
                continue
            code = np.frombuffer(data, dtype=kind, count=n, offset=skip).astype("<u4")
            if ((code >= 0x20) & (code < 0x7F)).tobytes().find(b"\1" * LEAST) < 0:
                continue
            code[(code > 0x10FFFF) | ((code >= 0xD800) & (code < 0xE000))] = 0xFFFD
            first = skip + size * np.arange(n)
            yield Layer(code.tobytes().decode("utf-32-le"), layer.begin[char[first]], layer.end[char[first + size - 1]], wide=True)


def _may_decode(text: str) -> bool:
    return "%" in text or "\\" in text or "&#" in text or _BASE64.search(text) is not None


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a whole text."""
    if not text:
        return [], []
    base = scan(text)
    if not _may_decode(text):
        return base, base
    every = set(base)
    seen = {hashlib.sha1(text.encode("utf-8", "surrogatepass")).digest()}
    place = np.arange(len(text), dtype=np.int64)
    work = [_inner(Layer(text, place, place + 1, wide=True))]  # what is still to come of a layer, the deepest last
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        mark = hashlib.sha1(layer.text.encode("utf-8", "surrogatepass")).digest() + layer.begin[:1].tobytes()
        if mark in seen or mark[:20] in seen or not layer.text:
            continue
        seen.add(mark)
        every.update((kind, *layer.original(a, b)) for kind, a, b in scan(layer.text))
        work.append(_inner(layer))
    return base, ordered(list(every))


def _inner(layer: Layer) -> Iterator[Layer]:
    """The layers that a layer unwraps to."""
    for unwrap in (_escapes, _base64, _wide, _nested):
        yield from unwrap(layer)


def redacted(text: str | None, mask: str = "[REDACTED]") -> str | None:
    """The text with every span, overlapping ones together, replaced by ``mask``; null stays null."""
    spans = find(text)[1]
    if not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def secret_spans(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The contract's digest for every row: counts of base spans, their hash, and all spans."""

    def run(texts: list[str | None]) -> list[list]:
        found = [find(t) for t in texts]
        counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in KINDS]
        return [*counts, [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], [joined(every) for _, every in found]]

    columns = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_texts(docs, run, columns, key=key, text=text)


def redact(docs: DataFrame, *, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The same columns with secrets replaced in ``text`` and, where one changes, its ``length`` (if there is such a column) counted anew."""
    small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(batch.columns)
            k = names.index(text)
            old = arrays[k].to_pylist()
            new = [redacted(t) for t in old]
            arrays[k] = pa.array(new, type=arrays[k].type)
            if length in names:
                n = names.index(length)
                counts = [c if a == b else len(b) for a, b, c in zip(old, new, arrays[n].to_pylist())]
                arrays[n] = pa.array(counts, type=arrays[n].type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(run, docs.schema)
