"""Mixing sources to target weights, in DataFrame functions only.

1. Every source gets a target number of words: its weight times a common factor, at most ``MAX_EPOCHS`` times its size.
2. The words of a source, documents in order of id, are packed into blocks of ``BLOCK`` words.
3. Output slots are drawn from the sources, ``SHARD`` slots to an output shard, one categorical draw for each slot, so
   the counts of a shard are multinomial. Slots beyond a source's target are dropped and missing ones appended, so that
   the totals meet the targets exactly.
4. Slot j of a source shows block P(j mod n) of its n blocks, where P is a keyed pseudorandom permutation with a key of
   its own for each source and each round of n slots (a swap-or-not shuffle: in each of ``ROUNDS`` steps x may change
   places with k - x mod n, as a hash of the larger one tells). Blocks are joined by index.

``output_shards`` gives the mix itself, a row for each slot of each output shard with its block's words; ``mixed`` gives
it as documents, ``mixture`` as counts. Draws and keys come from md5, so reruns agree and no state is kept. Block starts
are prefix sums in two steps, within id ranges and over them, so that no task sees a whole source.

Defined results: null and empty texts have size 0 and take 0. A null source is a source of its own, the last. Repeated
rows are separate documents (equal ids are ordered by size). Rows with a null id come first in their source. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import SPACE_RUN, WORD, stored, word_list

WEIGHTS = (5, 2, 1)
#: Words of the mix for 100 words of input, and how often a word may be used.
MIX_PERCENT = 150
MAX_EPOCHS = 2
BLOCK = 32
SHARD = 4096
SEED = "mix-1"
#: Id range whose documents are laid out together, at least, and about how many such ranges there are at most.
RANGE = 1024
MAX_RANGES = 1 << 16
#: Steps of the permutation of blocks.
ROUNDS = 24
#: Pieces of the line of slots by which draws find their source without comparing all sources.
CELLS = 4096


#: A side with at most so many rows, counted first, is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000

#: Shards whose counts are added up together before sums run over a source.
SHARD_RANGE = 1024
#: Slots that a task makes, and the most tasks.
TASK_SLOTS = 1 << 17
TASKS = 20_000

#: A prime; hashes of the permutation's steps are lines modulo it.
PRIME = (1 << 31) - 1


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def source_key(source: Column) -> Column:
    """A non-null key whose order is by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def target_table(sizes: DataFrame) -> DataFrame:
    """(skey, source_size, weight, target) for (skey, source_size) rows, one for each source.

    All sources that stay below their cap share one factor: ordered by cap per weight, the first k sources are capped and
    the rest share what is left by weight; k is the first number for which no further source exceeds its cap. The windows
    are over one row for each source.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(W.orderBy("skey")) - 1) % len(WEIGHTS) + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(MAX_EPOCHS)))
    by = W.orderBy(F.col("cap") / F.col("weight"), "skey")
    every = W.partitionBy()
    shared = ranked.select(
        "*",
        (F.sum("source_size").over(every) * F.lit(MIX_PERCENT / 100.0)).alias("total"),
        F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("capped"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))).alias("open"),
    ).withColumn("factor", (F.col("total") - F.col("capped")) / F.col("open"))
    fits = F.col("factor") * F.col("weight") <= F.col("cap")
    first = F.min(F.when(fits, F.struct((F.col("cap") / F.col("weight")).alias("r"), "skey", "factor"))).over(every)
    target = F.least(F.col("cap"), F.coalesce(first["factor"] * F.col("weight"), F.col("cap")))
    return shared.select("skey", "source_size", "weight", target.alias("target"))


def sized(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", order: str | None = None) -> DataFrame:
    """(doc_id, place, skey, size) for every row; documents are laid out in order of ``place``, the key unless ``order`` names another column."""
    return docs.select(
        F.col(key).alias("doc_id"),
        F.col(order or key).try_cast("long").alias("place"),
        source_key(F.col(source)).alias("skey"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def _running(rows: DataFrame, part: str, order: list[Column], count: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``count`` over the rows before each in its source: within ``part``, whose order is that of its rows, and over the parts before."""
    inner = W.partitionBy("skey", part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy("skey").orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("skey", part).agg(F.sum(count).alias("n of part")).select("skey", part, F.coalesce(F.sum("n of part").over(outer), F.lit(0)).alias("before"))
    placed = rows.withColumn("inside", F.coalesce(F.sum(count).over(inner), F.lit(0)))
    return placed.join(starts, ["skey", part]).withColumn(name, F.col("before") + F.col("inside")).drop(part, "before", "inside")


def layout(sizes: DataFrame) -> DataFrame:
    """Each document with ``begin``, the number of words of its source before it. ``sizes`` is read several times."""
    low, high = sizes.agg(F.percentile_approx("place", F.lit(0.001), F.lit(10_000)), F.percentile_approx("place", F.lit(0.999), F.lit(10_000))).first()
    width = max(RANGE, -(-((high or 0) - (low or 0) + 1) // MAX_RANGES))
    # A few ids far from all others are within the two ranges at the ends; null ids are before all.
    place = F.floor((F.greatest(F.least(F.col("place"), F.lit(high or 0)), F.lit(low or 0)) - (low or 0)) / width)
    ranged = sizes.withColumn("part", F.coalesce(place, F.lit(-1)).cast("long"))
    order = [F.col("place").asc_nulls_first(), F.col("size"), F.col("doc_id")]
    return _running(ranged, "part", order, "size", "begin").select("doc_id", "skey", "size", "begin")


def _bits(name: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(name), 1, digits), 16, 10).cast("long")


def _keys(name: Column, blocks: Column) -> Column:
    """For each round of a source's slots and each step: the sum of two places that may change, and a line of the hash."""

    def step(epoch: Column, i: Column) -> Column:
        at = lambda what: F.concat(F.lit(f"{SEED}/{what}/"), epoch.cast("string"), F.lit("/"), i.cast("string"), F.lit("/"), name)
        return F.struct((_bits(at("k"), 12) % blocks).alias("k"), (_bits(at("c"), 8) % (PRIME - 1) + 1).alias("c"), (_bits(at("d"), 8) % PRIME).alias("d"))

    steps = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.transform(F.sequence(F.lit(1), F.lit(MAX_EPOCHS)), lambda e: F.transform(steps, lambda i: step(e, i)))


def _permuted(j: Column, n: Column, keys: Column) -> Column:
    """Block of slot j; a permutation of 0..n-1 in each round of n slots, for any n."""

    def step(x: Column, key: Column) -> Column:
        other = F.pmod(key["k"] - x, n)
        return F.when((((F.greatest(x, other) % PRIME) * key["c"] + key["d"]) % PRIME) % 2 == 1, other).otherwise(x)

    return F.aggregate(F.get(keys, F.floor(j / n).cast("int")), F.pmod(j, n), step)


def slots(targets: DataFrame) -> DataFrame:
    """(skey, shard, j, block): every output slot, numbered within its source, with the block it shows. ``targets`` is read several times."""
    spark = targets.sparkSession
    blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    words = F.col("source_size") / blocks  # a block's, on average
    plan = targets.where("source_size > 0").select(
        "skey", blocks.alias("blocks"), F.least(F.round(F.col("target") / words), blocks * MAX_EPOCHS).cast("long").alias("wanted")
    )
    sources, total = plan.agg(F.count("*"), F.coalesce(F.sum("wanted"), F.lit(0))).first()
    width = max(1, -(-total // CELLS))
    line = plan.withColumn("hi", F.sum("wanted").over(W.orderBy("skey"))).withColumn("lo", F.col("hi") - F.col("wanted")).where("wanted > 0")
    cells = line.select("skey", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("cell"))
    value = F.pmod(_bits(F.concat(F.lit(f"{SEED}:"), F.col("id").cast("string")), 12), F.lit(max(1, total)))
    tasks = max(1, min(TASKS, -(-total // TASK_SLOTS)))
    drawn = spark.range(0, total, 1, tasks).select(F.expr(f"id div {SHARD}").alias("shard"), value.alias("v")).withColumn("cell", F.expr(f"v div {width}"))
    found = drawn.join(_small(cells, CELLS + sources), "cell").where("v >= lo and v < hi")
    counts = found.groupBy("skey", "shard").agg(F.count("*").alias("n"))
    # A last shard for each source makes up for what the draws left out; slots beyond the target fall away.
    topup = plan.select("skey", F.lit(total // SHARD + 1).cast("long").alias("shard"), F.col("wanted").alias("n"))
    every = stored(counts.unionByName(topup), "mix-counts").withColumn("part", F.expr(f"shard div {SHARD_RANGE}"))
    ranked = _running(every, "part", [F.col("shard")], "n", "from")
    named = ranked.join(_small(plan, sources), "skey").where("`from` < wanted")
    upto = F.least(F.col("from") + F.col("n"), F.col("wanted")) - 1
    # A row stands for thousands of slots, so rows are dealt out by the number of slots, not by their own small size.
    spread = named.repartition(tasks, "skey", "shard").join(_small(plan.select("skey", _keys(F.col("skey"), F.col("blocks")).alias("keys")), sources), "skey")
    # What the last shard makes up for is cut into shards of its own.
    last = total // SHARD + 1
    shard = lambda j: F.when(F.col("shard") == last, last + F.floor((j - F.col("from")) / SHARD)).otherwise(F.col("shard"))
    one = lambda j: F.struct(shard(j).cast("long").alias("shard"), j.alias("j"), _permuted(j, F.col("blocks"), F.col("keys")).alias("block"))
    made = spread.select("skey", F.explode(F.transform(F.sequence(F.col("from"), upto), one)).alias("s"))
    return made.select("skey", "s.shard", "s.j", "s.block")


def block_uses(targets: DataFrame) -> DataFrame:
    """(skey, block, uses) of the blocks that the mix shows."""
    return slots(targets).groupBy("skey", "block").agg(F.count("*").alias("uses"))


def document_blocks(laid: DataFrame) -> DataFrame:
    """A row for each block that holds words of a document, with ``first`` (counted within the document) and ``words``."""
    last = F.expr(f"(begin + size - 1) div {BLOCK}")
    some = laid.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"begin div {BLOCK}"), last)))
    lo = F.greatest(F.col("begin"), F.col("block") * BLOCK)
    hi = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * BLOCK)
    return some.withColumn("first", lo - F.col("begin")).withColumn("words", hi - lo)


def output_shards(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(shard, slot, source, block, words, text): the mix in output shards of about ``SHARD`` slots, in an order drawn for each shard.

    A block holds ``BLOCK`` words, those of its documents in order, joined by spaces; a source's last block holds the rest.
    """
    rows = stored(docs.select(F.monotonically_increasing_id().alias("mix id"), F.col(key).alias("mix key"), F.col(text).alias("text"), F.col(source).alias("source")), "mix-rows")
    sizes, targets, sources = prepared(rows, key="mix id", order="mix key")
    held = document_blocks(layout(sizes)).groupBy("doc_id", "begin").agg(F.collect_list(F.struct("block", "first", "words")).alias("parts"))  # a document's own blocks
    both = F.array(F.struct(word_list(F.col("text")).alias("w"), F.col("parts").alias("p")))
    part = lambda z, p: F.struct(p["block"].alias("block"), F.array_join(F.slice(z["w"], (p["first"] + 1).cast("int"), p["words"].cast("int")), " ").alias("t"), p["words"].alias("words"))
    cut = F.transform(both, lambda z: F.transform(z["p"], lambda p: part(z, p)))[0]
    pieces = rows.join(held.withColumnRenamed("doc_id", "mix id"), "mix id").select(source_key(F.col("source")).alias("skey"), "begin", F.explode(cut).alias("c"))
    whole = F.sort_array(F.collect_list(F.struct("begin", "c.t")))  # at most BLOCK words
    blocks = pieces.groupBy("skey", "c.block").agg(F.array_join(F.transform(whole, lambda x: x["t"]), " ").alias("text"), F.sum("c.words").alias("words"))
    place = F.row_number().over(W.partitionBy("shard").orderBy(F.md5(F.concat_ws("/", F.lit(SEED), "skey", F.col("j").cast("string"))), "skey", "j"))
    dealt = slots(targets).withColumn("slot", place - 1)
    name = F.when(F.col("skey") != "1", F.substring("skey", 2, 1 << 30))
    return dealt.join(blocks, ["skey", "block"]).select("shard", "slot", name.alias("source"), "block", "words", "text")


def prepared(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", order: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Sizes and targets, both written so that texts are read once and draws are planned from settled numbers; and how many sources there are."""
    sizes = stored(sized(docs, text=text, key=key, source=source, order=order), "mix-sizes")
    targets = stored(target_table(sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))), "mix-targets")
    return sizes, targets, targets.count()


def mixture(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """The contract's digest: (doc_id, size, source_size, target, taken) for every row."""
    sizes, targets, sources = prepared(docs, text=text, key=key, source=source)
    laid = layout(sizes)
    shown = document_blocks(laid).join(block_uses(targets), ["skey", "block"])
    # A document with words has a begin of its own in its source, even among repeated rows.
    own = ["doc_id", "skey", "size", "begin"]
    none = laid.where("size > 0").select(*own, F.lit(0).cast("long").alias("t"))
    taken = shown.select(*own, (F.col("uses") * F.col("words")).alias("t")).unionByName(none).groupBy(*own).agg(F.sum("t").alias("taken"))
    empty = sizes.where("size = 0").select("doc_id", "skey", "size", F.lit(0).cast("long").alias("taken"))
    every = taken.drop("begin").unionByName(empty)
    return every.join(_small(targets, sources), "skey").select(F.col("doc_id").alias(key), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", length: str = "n_chars") -> DataFrame:
    """The mix as documents with the same columns: one row for each of a document's showings (at most ``MAX_EPOCHS``).

    A showing holds the words of the document's blocks that the mix takes at least so often, joined by spaces; where it
    takes all, the text stays as it is. Showings without words are left out. Documents are laid out in order of their ids, so
    reruns make the same mix wherever rows stand in their files. Rows are told apart by a number that is written with them
    once, so ids may be null or repeated (of equal ids and sizes the earlier in the scan is first).
    """
    rows = stored(docs.withColumn("mix id", F.monotonically_increasing_id()), "mix-rows")
    sizes, targets, _ = prepared(rows, text=text, key="mix id", source=source, order=key)
    laid = layout(sizes)
    shown = document_blocks(laid).join(block_uses(targets), ["skey", "block"])
    shown = shown.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))))
    spans = F.sort_array(F.collect_list(F.struct((F.col("first") + 1).cast("int").alias("a"), F.col("words").cast("int").alias("n"))))  # a document's own blocks
    plan = shown.groupBy("doc_id", "size", "turn").agg(spans.alias("mix spans"), F.sum("words").alias("mix got"))
    plan = plan.select(F.col("doc_id").alias("mix id"), F.col("size").alias("mix size"), "mix spans", "mix got")
    partly = F.col("mix got") < F.col("mix size")
    both = F.struct(F.filter(F.split(text, SPACE_RUN), lambda w: w != "").alias("w"), F.col("mix spans").alias("s"))
    # Within an array of one, the words are a variable and split once, not for each span.
    cut = F.transform(F.array(both), lambda z: F.array_join(F.flatten(F.transform(z["s"], lambda s: F.slice(z["w"], s["a"], s["n"]))), " "))[0]
    out = rows.join(plan, "mix id").withColumn(text, F.when(partly, cut).otherwise(F.col(text)))
    if length in docs.columns:
        out = out.withColumn(length, F.when(partly, F.length(text).cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    return out.select(*docs.columns)


def mixture_sql() -> str:
    """The same for DuckDB."""
    values = ", ".join(str(float(w)) for w in WEIGHTS)
    key = lambda what, digits: f"CAST('0x' || substr(md5('{SEED}/{what}/' || e || '/' || i || '/' || skey), 1, {digits}) AS BIGINT)"
    other = "((k[i] - x + blocks) % blocks)"
    return rf"""
WITH sizes AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
        CAST(coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY skey),
weighed AS (SELECT *, ([{values}])[(row_number() OVER (ORDER BY skey) - 1) % {len(WEIGHTS)} + 1] AS weight, source_size * {float(MAX_EPOCHS)} AS cap FROM src),
shared AS (SELECT *, (sum(source_size) OVER () * {MIX_PERCENT / 100.0} - coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor FROM weighed),
common AS (SELECT factor FROM shared WHERE factor * weight <= cap ORDER BY cap / weight, skey LIMIT 1),
targets AS (SELECT skey, source_size, least(cap, coalesce((SELECT factor FROM common) * weight, cap)) AS target FROM shared),
plan AS (SELECT *, CAST(least(round(target / (source_size / blocks)), blocks * {MAX_EPOCHS}) AS BIGINT) AS wanted
        FROM (SELECT *, CAST(ceil(source_size / {BLOCK}.0) AS BIGINT) AS blocks FROM targets WHERE source_size > 0)),
line AS (SELECT skey, wanted, sum(wanted) OVER (ORDER BY skey) AS hi FROM plan),
drawn AS (SELECT id // {SHARD} AS shard, CAST('0x' || substr(md5('{SEED}:' || id), 1, 12) AS BIGINT) % (SELECT sum(wanted) FROM plan) AS v
        FROM range(0, CAST((SELECT sum(wanted) FROM plan) AS BIGINT)) AS r(id)),
counts AS (SELECT skey, shard, count(*) AS n FROM drawn JOIN line ON v >= hi - wanted AND v < hi GROUP BY ALL
        UNION ALL SELECT skey, (SELECT sum(wanted) FROM plan) // {SHARD} + 1, wanted FROM plan),
ranked AS (SELECT skey, shard, n, coalesce(sum(n) OVER (PARTITION BY skey ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM counts),
numbered AS (SELECT skey, blocks, unnest(range(CAST(start AS BIGINT), CAST(least(start + n, wanted) AS BIGINT))) AS j FROM ranked JOIN plan USING (skey) WHERE start < wanted),
keys AS (SELECT skey, e, list({key('k', 12)} % blocks ORDER BY i) AS k, list({key('c', 8)} % {PRIME - 1} + 1 ORDER BY i) AS c, list({key('d', 8)} % {PRIME} ORDER BY i) AS d
        FROM plan, range(1, {MAX_EPOCHS + 1}) AS epochs(e), range(1, {ROUNDS + 1}) AS steps(i) GROUP BY skey, e),
uses AS (SELECT skey, list_reduce(range(1, {ROUNDS + 1}), lambda x, i: CASE WHEN (((greatest(x, {other}) % {PRIME}) * c[i] + d[i]) % {PRIME}) % 2 = 1 THEN {other} ELSE x END, j % blocks) AS block,
        count(*) AS uses FROM numbered JOIN keys USING (skey) WHERE e = j // blocks + 1 GROUP BY ALL),
laid AS (SELECT row_number() OVER () AS r, *, CAST(coalesce(sum(size) OVER (PARTITION BY skey ORDER BY doc_id NULLS FIRST, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM sizes),
held AS (SELECT r, skey, size, start, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block FROM laid WHERE size > 0),
taken AS (SELECT r, CAST(sum((least(start + size, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK})) * uses) AS BIGINT) AS taken
        FROM held JOIN uses USING (skey, block) GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM laid JOIN targets USING (skey) LEFT JOIN taken USING (r)"""
