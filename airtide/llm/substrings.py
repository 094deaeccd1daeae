"""Exact substring deduplication with compressed FM-indexes.

Windows of ``WINDOW`` words that start at two places or more, anywhere in the corpus, are found and the words that they
cover are removed. Comparing every document with an index of every shard would cost the square of the corpus, so what a
document compares with which shard is routed first:

1. The minimizer of a window is the smallest hash among its ``GRAM``-word grams. Consecutive windows with one minimizer
   make a piece of at most ``WINDOW - GRAM + 1`` windows. Equal windows have equal minimizers, so windows whose minimizer
   occurs once are unique and go no further; all other pieces go to the shard of their minimizer. Of equal pieces one
   goes, with their number.
2. A minimizer with more than ``MAX_CONTENTS`` different pieces, as a passage has that very many documents quote, would
   make a shard of its own size. Its pieces are routed window by window, to the shard of the window's hash.
3. Each shard, of about ``SHARD_WORDS`` words, builds an FM-index: the Burrows-Wheeler transform in a wavelet matrix of
   packed bits with rank counts, and running sums of how often each suffix occurs. Suffix arrays, ranks and texts of the
   construction are dropped. The pieces stream through it by backward search, which gives matching statistics: how far
   to the left of a place the longest match goes that occurs twice. Intervals of ``WINDOW`` words or more are reported.
4. Reported intervals are put back on all copies of their pieces and removed from the texts.

Words and pieces are compared by 64-bit hashes, pieces within one minimizer only. Joins on minimizers and pieces keep the
rows of hot keys where they are.

Defined results: null and empty texts have no words. Texts of fewer than ``WINDOW`` words lose none. Repeated rows are
documents of their own and repeat each other; null ids pass through. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, small_batches, stored
from .neardup import _asked, _Words

WINDOW = 35
GRAM = 8
SHARD_WORDS = 600_000
#: Different pieces of a minimizer that go to one shard; those of a minimizer with more go window by window.
MAX_CONTENTS = 4_000
#: Above the longest piece; suffixes are sorted to this depth.
DEPTH = 64

_words = _Words()
_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _powers[:] = [
            np.cumprod(np.append(np.uint64(1), np.full(size - 1, base, dtype=np.uint64)), dtype=np.uint64) for base in (_P, pow(_P, -1, 1 << 64))
        ]
    return _powers[0], _powers[1]


def word_hashes(text: str | None) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def run_hashes(w: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the runs w[start:stop]; equal runs have equal hashes wherever they stand."""
    up, down = _power(len(w) + 1)
    total = np.append(np.uint64(0), np.cumsum(w * up[: len(w)], dtype=np.uint64))
    return _mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def pieces(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, content hash, start, windows) of the pieces of a text."""
    n = len(w)
    if n < WINDOW:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none
    at = np.arange(n - GRAM + 1)
    grams = low = run_hashes(w, at, at + GRAM)
    size, width = 1, WINDOW - GRAM + 1  # smallest of so many grams from each on
    while 2 * size <= width:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    low = np.minimum(low[: len(low) - width + size], low[width - size :])
    # A piece ends where the smallest hash changes or its gram leaves, even if an equal gram follows: that one is an occurrence of its own.
    start = np.append(0, np.flatnonzero((low[1:] != low[:-1]) | (grams[: len(low) - 1] == low[:-1])) + 1)
    count = np.diff(np.append(start, len(low)))
    content = run_hashes(w, start, start + count + WINDOW - 1)
    return low[start].view(np.int64), content.view(np.int64), start, count


class Bits:
    """A bit vector with rank: packed words and the number of ones before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.frombuffer(packed.tobytes() + bytes(16 - len(packed) % 8), dtype="<u8")
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)).astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))


class FMIndex:
    """FM-index of texts of words, each with the number of its copies. Symbol 0 ends a text; ends sort by place, so no match runs over one."""

    def __init__(self, texts: list[np.ndarray], copies: np.ndarray | None = None) -> None:
        lengths = np.array([len(t) for t in texts])
        stops = np.cumsum(lengths + 1) - 1  # where each text's end symbol stands
        self.words, codes = np.unique(np.concatenate(texts), return_inverse=True)
        n = len(codes) + len(texts)
        text = np.zeros(n, dtype=np.int64)
        inside = np.ones(n, dtype=bool)
        inside[stops] = False
        text[inside] = codes + 1
        # Suffixes by prefix doubling; ends are all different.
        rank = text + len(texts)
        rank[stops] = np.arange(len(texts))
        depth = 1
        while True:
            key = rank * np.int64(2 * n + 2)
            key[: n - depth] += rank[depth:] + 1
            order = np.argsort(key)
            step = np.append(0, (key[order][1:] != key[order][:-1]).astype(np.int64))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(step)
            depth *= 2
            if depth >= DEPTH or rank[order[-1]] == n - 1:
                break
        # More than one is all that is asked, so copies count as two.
        each = np.minimum(np.ones(len(texts), dtype=np.int64) if copies is None else copies, 2)
        self.sums = np.append(0, np.cumsum(each[np.searchsorted(stops, order)])).astype(np.int32 if n < 1 << 30 else np.int64)
        self.size = n
        now = text[order - 1]  # the Burrows-Wheeler transform
        self.first = np.append(0, np.cumsum(np.bincount(text)))
        self.levels: list[Bits] = []
        self.height = max(1, int(text.max()).bit_length())
        for level in range(self.height - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            self.levels.append(Bits(bit))
            now = np.concatenate([now[~bit], now[bit]])
        self.zero = self._down(np.arange(len(self.first) - 1), np.zeros(len(self.first) - 1, dtype=np.int64))

    def _down(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, bits in enumerate(self.levels):
            one = bits.ones(at)
            at = np.where(c >> (self.height - 1 - k) & 1, bits.zeros + one, at - one)
        return at

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Symbols of words, 0 for those that the index does not hold."""
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at + 1, 0)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with c and go on as those in [lo, hi)."""
        base, n = self.first[c] - self.zero[c], len(c)
        both = self._down(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return base + both[:n], base + both[n:]

    def reach(self, codes: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """For each stop the smallest start, not before begin, such that codes[start:stop] occurs more than once. All go on in step."""
        at = stop.copy()
        on = np.arange(len(at))
        lo, hi = np.zeros(len(at), dtype=np.int64), np.full(len(at), self.size)
        while len(on):
            inside = at[on] > begin[on]
            on, lo, hi = on[inside], lo[inside], hi[inside]
            c = codes[at[on] - 1]
            known = c > 0
            on, lo, hi, c = on[known], lo[known], hi[known], c[known]
            lo, hi = self.extend(c, lo, hi)
            again = self.sums[hi] - self.sums[lo] > 1
            on, lo, hi = on[again], lo[again], hi[again]
            at[on] -= 1
        return at

    def repeated(self, texts: list[np.ndarray], least: int) -> list[tuple[int, int, int]]:
        """(text, start, stop) of matches of at least ``least`` words that occur more than once; together they hold every such window.

        A text is searched from its end first. Where the match does not go back to its begin, windows are settled from the
        left. If the search of one fails at a word, no window with that word and the window's last one occurs twice, so
        the next is the first that begins after that word. If it holds, several windows on are tried at once, more each
        time, half as many after a failure; the first guess is all up to the word at which the search from the end failed.
        """
        out: list[tuple[int, int, int]] = []
        lengths = np.array([len(t) for t in texts])
        codes = self.codes(np.concatenate(texts))
        stops = np.cumsum(lengths)
        which = np.flatnonzero(lengths >= least)
        begin, last = (stops - lengths)[which], stops[which]

        def report(which: np.ndarray, begin: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
            long = stop - start >= least
            out.extend(zip(which[long].tolist(), (start - begin)[long].tolist(), (stop - begin)[long].tolist()))
            return long

        start = self.reach(codes, begin, last)
        long = report(which, begin, start, last)
        last = np.where(long, start + least, last) - 1  # later windows are known
        at = begin + least
        step = np.maximum(1, start - at)
        while True:
            on = at <= last
            which, begin, last, at, step = which[on], begin[on], last[on], at[on], step[on]
            if not len(which):
                return out
            stop = np.minimum(at + step - 1, last)
            start = self.reach(codes, begin, stop)
            report(which, begin, start, stop)
            held = start <= at - least  # the windows that end from at to stop
            one = stop == at
            at = np.where(held, stop + 1, np.where(one, start + least, at))
            step = np.where(held, 2 * step, np.where(one, 1, np.maximum(1, (stop - at + 1) // 2)))


def _numbered(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, doc_id, text) with a number for each row, written once: another scan of the same files may be cut and numbered otherwise."""
    return stored(docs.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("doc_id"), F.col(text).alias("text")), "sub-rows")


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(id, spans) for rows (id, text): runs of repeated windows, each a first window and a number, packed as first * 2**16 + number."""
    small_batches(rows.sparkSession)
    most = WINDOW - GRAM + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pieces(word_hashes(t)) for t in batch.column(1).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(), [len(f[0]) for f in found])
            minimizer, content, start, windows = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, dtype=np.int64),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (minimizer, content, ids, start * 65536 + windows)], names=["minimizer", "content", "id", "place"])

    every = stored(rows.select("id", "text").mapInArrow(cut, "minimizer long, content long, id long, place long"), "sub-pieces")
    shared = stored(every.groupBy("minimizer").agg(F.count("*").alias("n")).where("n > 1"), "sub-minimizers")
    places = stored(join_spread(every, shared, ["minimizer"], "n").drop("n"), "sub-shared")
    contents = places.groupBy("minimizer", "content").agg(F.count("*").alias("n"), F.min(F.struct("id", "place")).alias("one"))
    contents = stored(contents.select("minimizer", "content", "n", "one.id", "one.place"), "sub-contents")
    large = stored(contents.groupBy("minimizer").agg(F.count("*").alias("k")).where(F.col("k") > MAX_CONTENTS), "sub-large")
    marked = join_spread(contents, large, ["minimizer"], "k", how="left") if not large.isEmpty() else contents.withColumn("k", F.lit(None).cast("long"))
    asked = marked.select("id", F.struct("place", "minimizer", "content", "n", F.col("k").isNotNull().alias("large")).alias("p"))
    lists = stored(asked.groupBy("id").agg(F.collect_list("p").alias("p")), "sub-asked")  # pieces of one text
    joined = lists.join(_asked(rows.select("id", "text"), lists.select("id")), "id").select("text", "p")
    kinds = {"minimizer": pa.int64(), "content": pa.int64(), "n": pa.int64(), "large": pa.bool_(), "words": pa.binary()}

    def contents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in kinds]
            for t, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = word_hashes(t)
                for x in p:
                    start, windows = x["place"] >> 16, x["place"] & 65535
                    for column, v in zip(columns, (x["minimizer"], x["content"], x["n"], x["large"], w[start : start + windows + WINDOW - 1].tobytes())):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))

    texts = stored(joined.mapInArrow(contents_of, "minimizer long, content long, n long, large boolean, words binary"), "sub-texts")

    def searched(units: DataFrame, words: int) -> DataFrame:
        """(minimizer, content, n, first, windows) of what the indexes report; units of one shard are indexed and searched together."""
        shards = max(1, -(-units.count() * words // SHARD_WORDS))

        def search(table: pa.Table) -> pa.Table:
            words = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("words")]
            found = FMIndex(words, table.column("n").to_numpy()).repeated(words, WINDOW)
            k = pa.array([f[0] for f in found], pa.int64())
            first, windows = pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] - f[1] - WINDOW + 1 for f in found], pa.int32())
            return pa.table([*(table.column(c).take(k) for c in ("minimizer", "content", "n")), first, windows], names=["minimizer", "content", "n", "first", "windows"])

        dealt = units.select("minimizer", "content", "n", "words", F.pmod(F.xxhash64(*route), F.lit(shards)).alias("shard"))
        return dealt.groupBy("shard").applyInArrow(search, "minimizer long, content long, n long, first int, windows int")

    route = ["minimizer"]
    found = searched(texts.where("not large"), WINDOW + most)
    if not large.isEmpty():

        def each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in batch.column(3)]
                counts = [len(w) - WINDOW + 1 for w in words]
                k = np.repeat(np.arange(len(words)), counts)
                first = np.concatenate([np.arange(c) for c in counts]) if counts else np.empty(0, dtype=np.int64)
                code = np.concatenate([run_hashes(w, np.arange(c), np.arange(c) + WINDOW) for w, c in zip(words, counts)]) if counts else np.empty(0, dtype=np.uint64)
                cut = pa.array([w[i : i + WINDOW].tobytes() for w, c in zip(words, counts) for i in range(c)], pa.binary())
                same = batch.select([0, 1, 2]).take(pa.array(k))
                yield pa.RecordBatch.from_arrays([*same.columns, pa.array(first.astype(np.int32)), pa.array(code.view(np.int64)), cut], names=["minimizer", "content", "n", "first", "code", "words"])

        windows = texts.where("large").select("minimizer", "content", "n", "words")
        windows = stored(windows.mapInArrow(each_window, "minimizer long, content long, n long, first int, code long, words binary"), "sub-windows")
        # Equal windows are one unit, whose content is its code; ``rows`` of them have it.
        units = windows.groupBy("minimizer", "code").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min("words").alias("words"))
        units = stored(units.withColumnRenamed("code", "content"), "sub-units")
        route = ["minimizer", "content"]
        twice = searched(units, WINDOW).select("minimizer", "content").join(units.select("minimizer", "content", "rows"), ["minimizer", "content"])
        twice = stored(twice.withColumnRenamed("content", "code"), "sub-twice")
        hits = join_spread(windows.drop("words"), twice, ["minimizer", "code"], "rows")
        found = found.unionByName(hits.select("minimizer", "content", "n", "first", F.lit(1).alias("windows")))
    spans = F.collect_list(F.col("first").cast("long") * 65536 + F.col("windows")).alias("spans")  # of one piece
    verdicts = stored(found.groupBy("minimizer", "content").agg(F.first("n").alias("n"), spans), "sub-found")
    back = join_spread(places, verdicts, ["minimizer", "content"], "n")
    back = back.select("id", F.transform("spans", lambda s: (F.shiftright("place", 16) + F.shiftright(s, 16)) * 65536 + s.bitwiseAND(F.lit(65535))).alias("spans"))
    return back.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # of one text


def substring_table(docs: DataFrame, *, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """The contract's digest for every row; ``with_text`` adds the kept words as ``kept_text``."""
    rows = _numbered(docs, text, key)
    spans = stored(repeated_windows(rows), "sub-spans")
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, texts = [], [], []
            for t, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = t.encode("utf-8", "surrogatepass").split() if t else []
                total.append(len(words))
                if found:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    s = np.array(found)
                    np.add.at(change, s >> 16, 1)
                    np.add.at(change, (s >> 16) + (s & 65535) + WINDOW - 1, -1)
                    keep = np.cumsum(change)[:-1] == 0
                    words = [words[i] for i in np.flatnonzero(keep)]
                removed.append(total[-1] - len(words))
                texts.append(b" ".join(words))
            arrays = [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
            if with_text:
                arrays.append(pa.array([x.decode("utf-8", "replace") for x in texts]))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    joined = rows.join(spans, "id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(remove, f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def substring_sql() -> str:
    """The same for DuckDB."""
    return rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
win AS (SELECT r, i, md5(array_to_string(words[i:i+{WINDOW - 1}], ' ')) AS g FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + k AS i FROM win JOIN twice USING (g), range(0, {WINDOW}) AS o(k)),
kept AS (SELECT e.r, string_agg(x, ' ' ORDER BY e.i) AS t, count(*) AS n
    FROM (SELECT r, unnest(words) AS x, unnest(range(1, len(words) + 1)) AS i FROM w) e ANTI JOIN gone ON e.r = gone.r AND e.i = gone.i GROUP BY e.r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)"""
