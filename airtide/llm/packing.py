"""Packing documents into sequences of bounded length with balanced attention cost.

Every task tokenizes its documents and packs them in windows of about ``WINDOW_TOKENS`` tokens, so nothing is shuffled
and memory is bounded. In a window there are as many sequences as its tokens fill. A document of n tokens costs
``n + n * n / QUADRATIC``; in descending order each goes to the sequence of lowest cost among all that can hold it whole.
Where none can, it fills the one of lowest cost and the rest is placed the same way. Documents longer than a sequence
fill whole sequences first. What is left over at the end of a window becomes sequences whose lengths are powers of two,
which need no padding.

Ids are those of the tokenizers library with the given file. They are made by a faster implementation of the same merges
and pattern, which provably gives the same: the pattern knows characters by three classes only, and ``tests/llm`` holds
both implementations to the same classes for every code point there is, beside whole texts. Texts that it refuses go to
the library. Added tokens in a text get their own ids, as in the library. Each document ends with id 1.

Defined results: null and empty texts are the single id 1. Repeated rows are packed as separate documents, null ids
pass through, an empty table gives no rows. Sequence ids are unique and depend only on the partition and its order.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

CAPACITY = 2048
END = 1
#: Attention's quadratic part equals the linear part at this length.
QUADRATIC = 1024
WINDOW_TOKENS = 2 << 20

Piece = tuple[int, int, int, int, int]  # document, start, length, sequence, offset



class Encoder:
    """Texts to ids, made once in each worker."""

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None) -> None:
        import public_tokenizers as public
        import tiktoken

        self._path = json_path or public.path("byte_bpe_50k.json")
        self._library = None  # takes far more memory, so it is made when a text asks for it
        with open(self._path, encoding="utf-8") as f:
            file = json.load(f)
        with open(ranks_path or public.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        if odd := [t["content"] for t in file["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]:
            raise ValueError(f"added tokens that are not matched as they stand: {odd}")
        steps = file["pre_tokenizer"]
        if file["normalizer"] or steps != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or len(file["model"]["vocab"].keys() | added.keys()) != len(ranks) + len(added):
            raise ValueError("the two files are not of one encoding")
        self._added = added
        # Longest first: of tokens that begin at the same place the library takes the longest.
        self._split = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def library(self, texts: list[str]) -> list[list[int]]:
        """Ids by the tokenizers library."""
        if self._library is None:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return [e.ids for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, text: str) -> list[int]:
        try:
            if self._split is None or not (first := self._split.search(text)):
                return self._fast.encode_ordinary(text)
            ids: list[int] = []
            at = 0
            for m in self._split.finditer(text, first.start()):
                ids += self._fast.encode_ordinary(text[at : m.start()])
                ids.append(self._added[m.group()])
                at = m.end()
            return ids + self._fast.encode_ordinary(text[at:])
        except (KeyboardInterrupt, SystemExit, GeneratorExit):
            raise
        except BaseException:  # its regular expressions give up on some very long runs, by a panic that is no Exception
            return self.library([text])[0]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.array([*self._ids(t), END] if t else [END], dtype="<u4") for t in texts]


class _Open:
    """Sequences with tokens left, by what is left; the cheapest of those that hold n tokens in log(capacity) steps."""

    NONE = (float("inf"), -1)

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.size)]
        self.least = [self.NONE] * (2 * self.size)

    def _up(self, free: int) -> None:
        node, heap = free + self.size, self.heaps[free]
        self.least[node] = heap[0] if heap else self.NONE
        while node > 1:
            node >>= 1
            self.least[node] = min(self.least[2 * node], self.least[2 * node + 1])

    def add(self, free: int, cost: float, k: int) -> None:
        heapq.heappush(self.heaps[free], (cost, k))
        self._up(free)

    def best(self, n: int) -> tuple[float, int]:
        lo, hi, found = n + self.size, 2 * self.size, self.NONE
        while lo < hi:
            if lo & 1:
                found = min(found, self.least[lo])
                lo += 1
            if hi & 1:
                hi -= 1
                found = min(found, self.least[hi])
            lo, hi = lo >> 1, hi >> 1
        return found

    def take(self, free: int) -> None:
        """Remove the cheapest sequence with exactly so many tokens left."""
        heapq.heappop(self.heaps[free])
        self._up(free)


def balanced(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[Piece], int]:
    """Pack documents of these lengths; the pieces and the number of sequences."""
    pieces: list[Piece] = []
    used = 0
    rest: list[tuple[int, int, int]] = []  # length, document, start
    for d, n in enumerate(lengths):
        whole = n // capacity
        pieces += [(d, k * capacity, capacity, used + k, 0) for k in range(whole)]
        used += whole
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    total = sum(r[0] for r in rest)
    sizes = [capacity] * (total // capacity)
    left = total % capacity
    while left:
        sizes.append(1 << (left.bit_length() - 1))
        left -= sizes[-1]
    free = sizes[:]
    spare = _Open(capacity)
    for k, s in enumerate(sizes):  # short ones begin as dear as if they were filled up
        spare.add(s, (capacity - s) * (1 + (capacity - s) / QUADRATIC), k)
    rest.sort(key=lambda r: (-r[0], r[1]))
    for n, d, start in rest:
        while n:
            cost, k = spare.best(n)
            if k < 0:
                cost, k = spare.best(1)
            spare.take(free[k])
            part = min(n, free[k])
            pieces.append((d, start, part, used + k, sizes[k] - free[k]))
            free[k] -= part
            if free[k]:
                spare.add(free[k], cost + part * (1 + part / QUADRATIC), k)
            n, start = n - part, start + part
    return pieces, used + len(sizes)


def pack(docs: DataFrame, *, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, window: int = WINDOW_TOKENS, ids: bool = False,
         json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """A row for each piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset), with ``ids`` also the token ids themselves."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    columns = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(json_path, ranks_path)
        first = TaskContext.get().partitionId() << 40
        keys: list[pa.Array] = []
        tokens: list[np.ndarray] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal first
            pieces, n = balanced([len(t) for t in tokens], capacity)
            d, start, length, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*pieces))
            cut = [tokens[i][a : a + m] for i, a, m, _, _ in pieces]
            arrays = [
                pa.concat_arrays(keys).take(pa.array(d)),
                pa.array(start), pa.array(length), pa.array([zlib.crc32(c.tobytes()) for c in cut], pa.int64()),
                pa.array([len(tokens[i]) for i in d], pa.int64()), pa.array(sequence + first), pa.array(offset),
            ]
            if ids:
                arrays.append(pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32())))
            first += n
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            return pa.RecordBatch.from_arrays(arrays, names=names[: len(arrays)])

        for batch in batches:
            keys.append(batch.column(0))
            made = encode(batch.column(1).to_pylist())
            tokens += made
            held += sum(map(len, made))
            if held >= window:
                yield packed()
                keys, tokens, held = [], [], 0
        if tokens:
            yield packed()

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, columns)
