"""Near-duplicate groups: banded MinHash, sequential Bayesian verification, exact confirmation.

1. One pass over the texts makes, for every document, the size of its shingle set, a key of that set and a MinHash
   signature. Documents with equal sets form a class, whose smallest id stands for it; copies go no further.
2. Signatures are cut into bands. In each bucket of equal bands every member is first compared with the bucket's
   smallest id only, so a bucket of n members makes n - 1 pairs. Confirmed pairs are merged into components. Buckets that
   hold several components try other leaders while that merges much.
3. In the buckets that still hold several components, all members outside the largest are compared with all of other
   components, in blocks within tasks, and confirmed there, so no link between two components goes untested and only
   links leave a task.
4. The Bayesian test compares signatures in batches. After m of n hashes agree, the likeness has the posterior
   Beta(m + 1, n - m + 1); a pair is dropped once P(likeness >= threshold) is below ``MISS``.
5. Survivors are confirmed exactly, on the shingle sets of both whole texts (64-bit shingle hashes).

A pair at the threshold shares no band with probability (1 - t**ROWS)**BANDS: 4e-7 for 0.85, 3e-5 for 0.8.

Defined results: words are maximal runs of non-space bytes with A-Z in lower case. A text with fewer words than a
shingle is one shingle. Null and empty texts have no shingles, link with nothing and are kept. Repeated rows are in one
class. Null ids get the id of their class if one has an id, otherwise null, and are not kept. An empty table gives no
rows. Ids should be unique: where one id has several texts, classes that it stands for count as one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import map_texts, small_batches, stored

BANDS = 20
ROWS = 4
HASHES = BANDS * ROWS
BATCH = 16
MISS = 1e-6
#: Members of a bucket that are compared as a block.
BLOCK = 256
#: Further leaders that a bucket may try, and leaders of a document that are confirmed in a turn. All that is still apart is compared after.
TURNS = 8
NEAREST = 2
#: Words whose hashes a worker remembers.
VOCABULARY = 1 << 17
#: Bits of the filter that keeps texts nobody asks for out of a shuffle; it is broadcast as 2**22 / 64 rows at most.
FILTER_BITS = 1 << 22

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RNG = np.random.default_rng(7)
_A = _RNG.integers(1 << 62, 1 << 63, HASHES, dtype=np.uint64)[:, None] | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)[:, None]


class _Words(dict):
    """64-bit hashes of words; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= VOCABULARY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(n, len(w))
    m = len(w) - k + 1
    h = np.full(m, k, dtype=np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w[i : i + m]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def signature(h: np.ndarray) -> bytes:
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(h), 2048):
        low = np.minimum(low, ((h[at : at + 2048] * _A + _B) >> np.uint64(32)).min(axis=1))
    return low.astype("<u4").tobytes()


def least_matches(threshold: float) -> list[tuple[int, int]]:
    """(n, m): after n hashes a pair with fewer than m matches is dropped."""

    def chance(m: int, n: int) -> float:
        """P(likeness >= threshold) after m of n, from the Beta-binomial identity."""
        return sum(math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))

    return [(n, next(m for m in range(n + 1) if chance(m, n) >= MISS)) for n in range(BATCH, HASHES + 1, BATCH)]


def survivors(a: np.ndarray, b: np.ndarray, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs (rows of a and b) that pass the sequential test, and their matches."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int32)
    done = 0
    for n, m in least:
        matches = matches + (a[alive, done:n] == b[alive, done:n]).sum(axis=1, dtype=np.int32)
        keep = matches >= m
        alive, matches, done = alive[keep], matches[keep], n
    return alive, matches


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(len(column), HASHES)


def signed(docs: DataFrame, *, words: int, text: str, key: str) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig) for every row; key and signature of an empty set are null."""

    def run(texts: list[str | None]) -> list[list]:
        import xxhash

        sets = [shingles(t, words) for t in texts]
        keys = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
        return [[len(h) for h in sets], keys, [signature(h) if len(h) else None for h in sets]]

    return map_texts(docs, run, "n_shingles long, set_key binary, sig binary", key=key, text=text).withColumnRenamed(key, "doc_id")


def _asked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id may be among ``ids``: a bit for each hash, so that most other texts are not shuffled."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bits = ids.select(slot(F.col("id")).alias("s")).distinct().groupBy(F.floor(F.col("s") / 64).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")
    )
    cells = docs.withColumn("s", slot(F.col("id"))).withColumn("cell", F.floor(F.col("s") / 64)).join(F.broadcast(bits), "cell")
    return cells.where(F.expr("shiftrightunsigned(bits, cast(s % 64 as int)) & 1 = 1")).select("id", "text")


def confirmed(pairs: DataFrame, docs: DataFrame, *, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold; ``docs`` has (id, text). ``a`` is the side that repeats."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    texts = _asked(docs, ids)
    joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            keep = []
            for k, (ta, tb) in enumerate(zip(batch.column(2), batch.column(3))):
                ta = ta.as_py()
                if left is None or ta != last:
                    last, left = ta, shingles(ta, words)
                right = shingles(tb.as_py(), words)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if both and 100 * both >= percent * (len(left) + len(right) - both):
                    keep.append(k)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest id that each node of an edge reaches.

    Large-star and small-star steps in turn: each node hands its larger neighbours to its smallest one, until the edges
    are stars. Every step is written, so no lineage grows and a lost executor costs one step.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.withColumnRenamed("m", "v"))
        now = stored(small.distinct(), "edges")
        new = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _tested(pairs: DataFrame, sigs: DataFrame, least: list[tuple[int, int]]) -> DataFrame:
    """(a, b, matches) of the pairs that pass the Bayesian test."""
    joined = pairs.join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b").join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                alive, matches = survivors(_matrix(batch.column(2)), _matrix(batch.column(3)), least)
                ids = batch.select([0, 1]).take(pa.array(alive))
                yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(matches.astype(np.int64))], names=["a", "b", "matches"])

    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, matches long")


def _across(members: DataFrame, sigs: DataFrame, docs: DataFrame, least: list[tuple[int, int]], *, words: int, percent: int) -> DataFrame:
    """(a, b) links between components that share a bucket, enough of them to join all that are linked; ``members`` has (band, rep, component).

    A bucket's largest component needs no comparison within; its other members, the strays, are compared with all.
    Both are dealt into blocks of about ``BLOCK`` by a hash, with their shingle sets. A pair is compared in the lowest
    band that it shares. Pairs that survive the Bayesian test are confirmed on their sets at once, unless links found in
    the same task already join their components; so a task returns fewer links than it has members.
    """
    counts = members.groupBy("band", "component").agg(F.count("*").alias("n"))
    mains = counts.groupBy("band").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("size"))
    known = members.join(mains, "band").withColumn("stray", F.col("component") != F.col("main.component"))
    small_batches(docs.sparkSession)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, words).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["rep", "set"])

    sets = _asked(docs, members.select(F.col("rep").alias("id")).distinct()).mapInArrow(sets_of, "rep long, set binary")
    known = known.select("band", "rep", "component", "stray", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("size") - F.col("main.n")) / BLOCK).cast("int").alias("owns"))
    # A task gets the strays x of one deal and the members y of another; who is both, as in all small buckets, goes there once.
    slot = lambda of: F.pmod(F.xxhash64("rep"), F.col(of)).cast("int")
    known = known.select("*", slot("blocks").alias("block"), slot("owns").alias("own"))
    task = lambda o, b, x, y: F.struct(o.alias("o"), b.alias("b"), x.alias("x"), y.alias("y"))
    as_y = F.transform(F.sequence(F.lit(0), F.col("owns") - 1), lambda o: task(o, F.col("block"), F.col("stray") & (o == F.col("own")), F.lit(True)))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.col("stray") & (b != F.col("block")))
    as_x = F.transform(others, lambda b: task(F.col("own"), b, F.lit(True), F.lit(False)))
    dealt = known.select("band", "rep", "component", "stray", F.explode(F.concat(as_y, as_x)).alias("t"))
    held = F.collect_list(F.struct("rep", "component", "stray", F.col("t.x").alias("x"), F.col("t.y").alias("y"), "sig", "set"))  # about two BLOCKs
    groups = dealt.join(stored(sigs.join(sets, "rep"), "near-sets"), "rep").groupBy("band", "t.o", "t.b").agg(held.alias("m"))
    small_batches(members.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, band in zip(batch.column(0), batch.column(1).to_pylist()):
                m = m.values
                rep, component, sig = m.field("rep").to_numpy(), m.field("component").to_numpy(), _matrix(m.field("sig"))
                stray, x, y = (m.field(n).to_numpy(zero_copy_only=False).astype(bool) for n in ("stray", "x", "y"))
                x, y = np.flatnonzero(x), np.flatnonzero(y)
                i, j = np.nonzero((component[x][:, None] != component[y][None, :]) & (~stray[y][None, :] | (rep[x][:, None] < rep[y][None, :])))
                i, j = x[i], y[j]
                first = np.full(len(i), BANDS)
                for k in range(BANDS - 1, -1, -1):
                    code = sig[:, k * ROWS : (k + 1) * ROWS].copy().view("V16").ravel()
                    first[code[i] == code[j]] = k
                i, j = i[first == band], j[first == band]
                root: dict[int, int] = {}

                def top(c: int) -> int:
                    while root.get(c, c) != c:
                        c = root[c]
                    return c

                sets_ = [np.frombuffer(v.as_py(), dtype=np.uint64) for v in m.field("set")]
                links = []
                for at in range(0, len(i), 1 << 14):
                    p, q = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                    alive, matches = survivors(sig[p], sig[q], least)
                    for k in np.argsort(-matches, kind="stable"):
                        u, v = p[alive[k]], q[alive[k]]
                        cu, cv = top(int(component[u])), top(int(component[v]))
                        n, o = len(sets_[u]), len(sets_[v])
                        if cu == cv or 100 * min(n, o) < percent * max(n, o):
                            continue
                        common = len(np.intersect1d(sets_[u], sets_[v], assume_unique=True))
                        if 100 * common >= percent * (n + o - common):
                            root[cu] = cv
                            links.append((min(rep[u], rep[v]), max(rep[u], rep[v])))
                yield pa.RecordBatch.from_arrays([pa.array([int(z[k]) for z in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return groups.select("m", F.col("band.k").alias("k")).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row; links are pairs with 100 * common >= percent * union."""
    least = least_matches(percent / 100)
    source = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    every = stored(signed(source, words=words, text="text", key="id"), "near-signed")
    classes = every.where("set_key is not null").groupBy("set_key", "sig").agg(F.min("doc_id").alias("rep"))
    reps = stored(classes, "near-classes")
    sigs = reps.where("rep is not null").select("rep", "sig")
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(F.substring("sig", 4 * ROWS * k + 1, 4 * ROWS)).alias("h")) for k in range(BANDS)])
    bands = sigs.select("rep", F.explode(keys).alias("band"))
    shared = bands.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("top")).where("lead < top").select("band", "lead")
    members = stored(bands.join(shared, "band"), "near-buckets")
    links = found = None

    def merged(pairs: DataFrame) -> int:
        """Confirm pairs and merge what they link; how many links were new."""
        nonlocal links, found
        new = stored(confirmed(pairs, source, words=words, percent=percent), "near-links")
        count = new.count()
        if links is None or count:
            links = new if links is None else links.unionByName(new)
            found = stored(components(links), "near-components")
        return count

    def open_members() -> DataFrame:
        """(band, rep, component) of the buckets that hold several components."""
        split = members.select("band", "rep").join(found, F.col("rep") == F.col("node"), "left").select("band", "rep", F.coalesce("component", "rep").alias("component"))
        apart = split.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
        return stored(split.join(apart, "band"), "near-split")

    stars = members.where("rep > lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    merged(stored(_tested(stars, sigs, least).select("a", "b"), "near-likely"))
    rest = open_members()
    for turn in range(1, TURNS + 1):
        # Another leader for each bucket; what it is compared with goes down as components grow together.
        lead = rest.groupBy("band").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "rep"), F.col("rep").alias("a"), F.col("component").alias("c"))).alias("l"))
        pairs = rest.join(lead, "band").where("component <> l.c").select(F.col("l.a").alias("a"), F.col("rep").alias("b")).distinct()
        nearest = F.row_number().over(W.partitionBy("b").orderBy(F.desc("matches"), "a"))
        likely = stored(_tested(pairs, sigs, least).withColumn("rank", nearest).where(F.col("rank") <= NEAREST).select("a", "b"), "near-likely")
        asked = likely.count()
        if not asked or merged(likely) * 10 < asked:
            break
        rest = open_members()
    rest = open_members()
    if not rest.isEmpty():
        links = links.unionByName(stored(_across(rest, sigs, source, least, words=words, percent=percent), "near-links"))
        found = stored(components(links), "near-components")
    ids = reps.join(found, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("c"))
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("c"))
    out = every.select("doc_id", "n_shingles", "set_key").join(ids, "set_key", "left").select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def without_near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each group of near-duplicates.

    Rows are told apart by a number that is written with them once, so ids may be null or repeated.
    """
    rows = stored(docs.withColumn("near id", F.monotonically_increasing_id()), "near-rows")
    groups = near_duplicates(rows, words=words, percent=percent, text=text, key="near id")
    return rows.join(groups.where("kept").select("near id"), "near id", "left_semi").select(*docs.columns)


def near_dup_table(docs: DataFrame) -> DataFrame:
    """The contract's digest: sets of three-word shingles, 85 percent."""
    return near_duplicates(docs, words=3, percent=85)


def near_dup_sql(words: int = 3, percent: int = 85) -> str:
    """The same for DuckDB: all pairs with a common shingle, and reachability by recursion."""
    return rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {words} THEN [array_to_string(words, ' ')]
        ELSE list_distinct(list_transform(range(1, len(words) - {words - 2}), lambda i: array_to_string(words[i:i+{words - 1}], ' '))) END AS g FROM w),
sets AS (SELECT g, min(doc_id) AS rep, row_number() OVER (ORDER BY min(doc_id)) AS k, len(g) AS n FROM (SELECT list_sort(g) AS g, doc_id FROM s WHERE len(g) > 0) GROUP BY g),
x AS (SELECT k, n, rep, unnest(g) AS x FROM sets),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS inter, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.x = b.x AND a.k < b.k
        AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent} GROUP BY a.k, b.k, a.rep, b.rep),
links AS (SELECT a, b FROM common WHERE 100 * inter >= {percent} * (na + nb - inter)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT rep AS node, rep AS c FROM sets UNION SELECT both_ways.b, c FROM reach JOIN both_ways ON node = both_ways.a),
label AS (SELECT node, min(c) AS c FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE label.c END AS component_id,
    coalesce(s.doc_id = CASE WHEN len(s.g) = 0 THEN s.doc_id ELSE label.c END, false) AS kept
FROM s LEFT JOIN sets ON sets.g = list_sort(s.g) LEFT JOIN label ON label.node = sets.rep"""
