"""Document fingerprints by one-permutation MinHash with optimal densification, in DataFrame functions only.

The five-word shingles of a text are hashed once. The top bits of a hash name its bin, and the smallest hash of each bin
counts; sorting the hashes makes both one pass. An empty bin borrows from the bin that comes first in its own probing
order among those with a value: bin j probes bin (a_j * t + b_j) mod K for t = 0, 1, ..., with odd a_j a permutation of
all bins, so the nearest probe has rank (b - b_j) / a_j mod K. The low ``BITS`` bits of every bin are packed as hex. The
share of equal bins, less the 2**-BITS of chance agreements, estimates the Jaccard likeness.

Defined results: a text of fewer than five words is one shingle. A text without words (null and empty ones too) has the
empty fingerprint, whose likeness to itself is 1 and to any other 0. Repeated rows are neighbours (ordered by text); null
ids come first, all in one id range. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import word_list

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
BITS = 8
#: Rows that are dealt together, about, at least, and how many such ranges there may be.
RANGE = 512
MAX_RANGES = 1 << 14


def _bin(x: Column) -> Column:
    return (F.shiftright(x, 64 - BIN_BITS) + BINS // 2).cast("int")


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` as column ``name``."""
    tmp = f"{name} of "
    c = lambda n: F.col(f"`{tmp}{n}`")
    keep = [F.col(f"`{x}`") for x in df.columns]
    step = lambda d, col, n: d.select(*keep, col.alias(tmp + n))
    d = step(df, F.transform(word_list(F.col(text)), lambda w: F.xxhash64(w)), "h")
    shingles = (
        F.when(F.size(c("h")) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(c("h")) - SHINGLE), lambda i: F.xxhash64(*[F.get(c("h"), i + k) for k in range(SHINGLE)])))
        .when(F.size(c("h")) > 0, F.array(F.xxhash64(c("h"))))
        .otherwise(F.array().cast("array<bigint>"))
    )
    d = step(d, F.sort_array(shingles), "s")
    d = step(d, F.filter(c("s"), lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(c("s"), i - 1)))), "v")
    d = d.select("*", F.transform(c("v"), _bin).alias(tmp + "b"))

    def value(j: Column) -> Column:
        inverse, shift = (j * 46 + 11) % BINS, (j * 73 + 29) % BINS
        odd = inverse.bitwiseOR(F.lit(1))
        rank = lambda b, i: F.pmod((b - shift) * odd, F.lit(BINS)) * BINS + i
        borrowed = F.get(c("v"), F.array_min(F.transform(c("b"), rank)) % BINS)
        return F.coalesce(F.get(c("v"), F.array_position(c("b"), j).cast("int") - 1), borrowed)

    bins = F.when(F.size(c("v")) == BINS, c("v")).when(F.size(c("v")) > 0, F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), value)).otherwise(c("v"))
    d = d.select(*keep, bins.alias(tmp + "d"))
    digits = BITS // 4
    packed = F.transform(c("d"), lambda x: F.lpad(F.hex(x.bitwiseAND(F.lit((1 << BITS) - 1))), digits, "0"))
    return d.select(*keep, F.lower(F.array_join(packed, "")).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two fingerprints, corrected for chance agreement of ``BITS`` bits."""
    digits = BITS // 4
    part = lambda x, j: F.substring(x, j, F.lit(digits))
    same = F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS * digits), F.lit(digits)), lambda j: part(a, j) == part(b, j)))
    chance = 2.0**-BITS
    return (
        F.when((a == "") & (b == ""), F.lit(1.0))
        .when((a == "") | (b == ""), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance)))
    )


def with_next(df: DataFrame, key: str, order: str, carried: list[str]) -> DataFrame:
    """``df`` with ``next <name>`` for each carried column: the value of the row that follows by ``key``, after the last the first.

    Rows are dealt by ranges of ids between quantiles of the ids, so ranges are about alike however ids are spread. The
    first rows of a range also go to the range before it, so that its last row has a neighbour. The list of ranges, of
    ``MAX_RANGES`` at most, is what is broadcast.
    """
    rows = df.count()
    n = max(1, min(MAX_RANGES, -(-rows // RANGE)))
    # Quantiles to a tenth of a range.
    cuts = df.agg(F.percentile_approx(key, F.lit([k / n for k in range(1, n)]) if n > 1 else F.lit([0.5]), F.lit(10 * n))).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.lit([1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)] or [1])
    below = F.aggregate(steps, F.lit(0), lambda lo, step: F.when(F.get(bounds, lo + step - 1) <= F.col(key), lo + step).otherwise(lo))
    part = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(below if cuts else F.lit(0)).cast("long")
    ranged = df.withColumn("own range", part)
    ranges = ranged.groupBy("own range").agg(F.min(key).alias("first key"))
    order_all = W.orderBy("own range")
    last = F.max("own range").over(W.partitionBy())
    ranges = ranges.select("own range", "first key", F.coalesce(F.lag("own range").over(order_all), last).alias("range before"))
    joined = ranged.join(F.broadcast(ranges), "own range")  # at most MAX_RANGES + 1 rows
    wraps = F.col("range before") >= F.col("own range")
    stay = F.struct(F.col("own range").alias("in"), F.lit(0).alias("guest"))
    visit = F.when(F.col(key).eqNullSafe(F.col("first key")), F.struct(F.col("range before").alias("in"), F.when(wraps, 2).otherwise(1).alias("guest")))
    both = joined.withColumn("place", F.explode(F.array_compact(F.array(stay, visit)))).select(*df.columns, "place.in", "place.guest")
    window = W.partitionBy("in").orderBy("guest", F.col(key).asc_nulls_first(), order)
    led = both.select("*", *[F.lead(x).over(window).alias(f"next {x}") for x in carried])
    return led.where("guest = 0").drop("in", "guest")


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points replaced by the first as many, or all, of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_table(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The contract's digest for every row."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    own = with_fingerprint(rows, "t", "fingerprint")
    pairs = with_next(own, "doc_id", "t", ["t", "fingerprint"])
    made = pairs.select("doc_id", F.length("t").cast("long").alias("n_chars"), edited(F.col("t"), F.col("next t")).alias("e"), "fingerprint", F.col("next fingerprint").alias("following"))
    done = with_fingerprint(made, "e", "edited_fingerprint")
    return done.select(
        F.col("doc_id").alias(key), "n_chars", F.sha2(F.col("e").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("following")).alias("near_next"),
    )
