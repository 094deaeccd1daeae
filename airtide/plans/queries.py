"""The engine's queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import categories as cat
from ..functions import kernels
from ..operators import breaths as B
from ..operators import maps, masks, select, signal, spectrum
from ..operators import pixel_breaths as P
from ..operators import sequences as Q
from ..session import scratch
from ..sources import encoders, loading, vendors
from . import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AVERAGE = 61
PRELUDE = f"WITH {A.SQL}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL after the common views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{PRELUDE}{',' if not sql.lstrip().upper().startswith('SELECT') else ''}\n{sql}"
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean map of each recording."""
    return A.pixels(A.frames(spark, sf_dir)).groupBy(F.col("recording_id").alias("map_id"), "row", "col").agg(F.avg("z").alias("value"))


MAPS = "m AS (SELECT recording_id AS map_id, row, col, avg(z) AS value FROM pix GROUP BY ALL)"


@query("SELECT recording_id, frame_idx, round(sum(z), 6) AS value FROM pix GROUP BY ALL")
def global_impedance(spark, d):
    return rounded(maps.global_impedance(A.frames(spark, d)).drop("time"), "value")


@query("SELECT recording_id, frame_idx, row, col, round(z, 6) AS z FROM pix")
def frame_long(spark, d):
    return rounded(A.pixels(A.frames(spark, d)).drop("time"), "z")


@query("""SELECT row, col, round(avg(z), 6) AS mean, round(median(z), 6) AS median, round(max(z), 6) AS largest, round(min(z), 6) AS smallest,
    round(quantile_cont(z, 0.75), 6) AS p75 FROM pix GROUP BY ALL""")
def map_aggregates(spark, d):
    px = A.pixels(A.frames(spark, d)).withColumnRenamed("z", "value")
    out = maps.aggregate_maps(px, mean=F.avg, median=F.median, largest=F.max, smallest=F.min, p75=lambda v: F.percentile(v, F.lit(0.75)))
    return rounded(out, "mean", "median", "largest", "smallest", "p75")


def _norm(name: str, mode: str, sql: str, reference: float | None = None) -> None:
    def run(spark, d):
        return rounded(maps.normalize(label_map(spark, d), mode, reference), "value")

    run.__name__ = name
    query(f"{MAPS} SELECT map_id, row, col, round({sql}, 6) AS value FROM m WINDOW w AS (PARTITION BY map_id)")(run)


_norm("map_norm_zero", "zero-based", "(value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w)")
_norm("map_norm_symmetric", "symmetric", "value / max(abs(value)) OVER w")
_norm("map_norm_maximum", "maximum", "value / max(value) OVER w")
_norm("map_norm_reference", "reference", "value / 4.0", 4.0)


TOPS = "t AS (SELECT recording_id AS map_id, row, col, max(z) AS value FROM pix GROUP BY ALL)"


def top_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest value of each pixel of each recording."""
    return A.pixels(A.frames(spark, sf_dir)).groupBy(F.col("recording_id").alias("map_id"), "row", "col").agg(F.max("z").alias("value"))


@query(f"""{MAPS}, {TOPS} SELECT map_id, row, col, round(a.value + b.value, 6) AS total, round(a.value - b.value, 6) AS difference, round(a.value * b.value, 6) AS product,
    round(a.value / b.value, 3) AS quotient FROM m a JOIN t b USING (map_id, row, col)""")
def map_arithmetic(spark, d):
    out = maps.arithmetic(label_map(spark, d), top_map(spark, d), ("map_id",))
    return rounded(out, "total", "difference", "product").withColumn("quotient", F.round("quotient", 3))


@query(f"""{MAPS}, {TOPS} SELECT map_id, row, col, 'difference' AS kind, round(2 - (3 * a.value - b.value), 6) AS value FROM m a JOIN t b USING (map_id, row, col)""")
def map_kinds(spark, d):
    """Numbers and maps together: three times a map of a kind, less another, from 2."""
    mean = maps.convert(label_map(spark, d), "plain").drop("negative")
    less = maps.combine(maps.combine(mean, 3, "*"), top_map(spark, d), "-", by=("map_id",))
    return rounded(maps.combine(less, 2, "-", reverse=True), "value").select("map_id", "row", "col", "kind", "value")


@query(f"""{MAPS} SELECT map_id, row, col, 'amplitude' AS kind, 'a. u.' AS unit, value < 0 AS negative, round(value, 6) AS value FROM m""")
def map_converted(spark, d):
    return rounded(maps.convert(label_map(spark, d), "amplitude", unit="a. u."), "value").select("map_id", "row", "col", "kind", "unit", "negative", "value")


@query(f"{MAPS} SELECT map_id, row, col, CAST(trunc(value * 100) AS BIGINT) AS whole, value <> 0 AS truth, round(value * 3 + 1, 6) AS scaled FROM m")
def map_convert(spark, d):
    v = F.col("value")
    return label_map(spark, d).select("map_id", "row", "col", maps.to_integer(v * 100).alias("whole"), maps.to_boolean(v).alias("truth"), F.round(maps.filled(v) * 3 + 1, 6).alias("scaled"))


MASKS = """grid AS (SELECT CAST(i // 8 AS INTEGER) AS row, CAST(i % 8 AS INTEGER) AS col FROM range(64) AS r(i)),
masks AS (SELECT mask_id, row, col FROM grid, (VALUES ('V'), ('D'), ('R'), ('L'), ('L1'), ('L2'), ('L3'), ('L4'), ('Q1'), ('Q2'), ('Q3'), ('Q4')) AS n(mask_id)
    WHERE CASE mask_id WHEN 'V' THEN row < 4 WHEN 'D' THEN row >= 4 WHEN 'R' THEN col < 4 WHEN 'L' THEN col >= 4
    WHEN 'L1' THEN row // 2 = 0 WHEN 'L2' THEN row // 2 = 1 WHEN 'L3' THEN row // 2 = 2 WHEN 'L4' THEN row // 2 = 3
    WHEN 'Q1' THEN row < 4 AND col < 4 WHEN 'Q2' THEN row < 4 AND col >= 4 WHEN 'Q3' THEN row >= 4 AND col < 4 ELSE row >= 4 AND col >= 4 END)"""


@query(f"{MASKS} SELECT mask_id, row, col, 1.0::DOUBLE AS weight FROM masks")
def geometric_masks(spark, d):
    return masks.geometric(spark, list(masks.NAMES), 8, 8)


@query(f"{MASKS} SELECT mask_id, recording_id, frame_idx, round(sum(z), 6) AS value FROM pix JOIN masks USING (row, col) GROUP BY ALL")
def mask_collection_apply(spark, d):
    px = masks.apply(A.pixels(A.frames(spark, d)), masks.geometric(spark, list(masks.NAMES), 8, 8))
    return rounded(px.groupBy("mask_id", "recording_id", "frame_idx").agg(F.sum("z").alias("value")), "value")


WEIGHTS = f"""{MAPS}, {TOPS}, big AS (SELECT *, max(value) OVER (PARTITION BY map_id) AS top FROM m), big2 AS (SELECT *, max(value) OVER (PARTITION BY map_id) AS top FROM t),
a AS (SELECT map_id AS mask_id, row, col, least(value / top, 1.0) AS weight FROM big WHERE value > 0),
b AS (SELECT map_id AS mask_id, row, col, least(value / top, 1.0) AS weight FROM big2 WHERE value > 0.5 * top)"""


def weighted(values: DataFrame, least: float = 0.0) -> DataFrame:
    """Masks of maps: the share of the largest value, where it is above a part of that."""
    top = values.withColumn("top", F.max("value").over(W.partitionBy("map_id"))).where(F.col("value") > least * F.col("top")).where("value > 0" if not least else "true")
    return top.select(F.col("map_id").alias("mask_id"), "row", "col", F.least(F.col("value") / F.col("top"), F.lit(1.0)).alias("weight"))


def two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Masks of the mean and of the largest values of every recording."""
    return weighted(label_map(spark, d)), weighted(top_map(spark, d), 0.5)


PAIR = ("mask_id",)


@query(f"{WEIGHTS} SELECT mask_id, row, col, round(least(sum(weight), 1.0), 6) AS weight FROM (FROM a UNION ALL FROM b) GROUP BY ALL")
def mask_union(spark, d):
    return rounded(masks.union(*two(spark, d), PAIR), "weight")


@query(f"{WEIGHTS} SELECT mask_id, row, col, round(a.weight - coalesce(b.weight, 0), 6) AS weight FROM a LEFT JOIN b USING (mask_id, row, col) WHERE a.weight > coalesce(b.weight, 0)")
def mask_difference(spark, d):
    return rounded(masks.difference(*two(spark, d), PAIR), "weight")


@query(f"{WEIGHTS} SELECT mask_id, row, col, round(a.weight * b.weight, 6) AS weight FROM a JOIN b USING (mask_id, row, col)")
def mask_intersection(spark, d):
    return rounded(masks.intersection(*two(spark, d), PAIR), "weight")


@query(f"{WEIGHTS} SELECT row, col, round(least(sum(weight), 1.0), 6) AS weight FROM a GROUP BY row, col")
def mask_combine_sum(spark, d):
    return rounded(masks.combine(two(spark, d)[0], "sum"), "weight")


@query(f"{MAPS}, f AS (SELECT *, 1.0 / (1 + abs(value)) AS weight FROM m) SELECT row, col, round(product(weight), 6) AS weight FROM f GROUP BY row, col HAVING count(*) = (SELECT count(DISTINCT map_id) FROM f)")
def mask_combine_product(spark, d):
    every = label_map(spark, d).select(F.col("map_id").alias("mask_id"), "row", "col", (F.lit(1.0) / (1 + F.abs("value"))).alias("weight"))
    return rounded(masks.combine(every, "product"), "weight")


@query(f"{WEIGHTS} SELECT mask_id, bool_or(weight <> 1) AS weighted FROM b GROUP BY ALL")
def mask_weighted(spark, d):
    return masks.is_weighted(two(spark, d)[1])


@query(f"""{MASKS} SELECT 'impedance of ' || mask_id AS label, recording_id, round(sum(z), 6) AS value FROM pix JOIN masks USING (row, col) WHERE mask_id IN ('V', 'Q3') GROUP BY ALL""")
def mask_collection_labels(spark, d):
    grid = masks.geometric(spark, ["V", "Q3"], 8, 8)
    held = masks.Collection({n: grid.where(F.col("mask_id") == n) for n in ("V", "Q3")})
    px = held.apply(A.pixels(A.frames(spark, d)), label_format="impedance of {mask_label}")
    return rounded(px.groupBy("label", "recording_id").agg(F.sum("z").alias("value")), "value")


@query(f"""{MAPS}, t AS (SELECT map_id, row, col, row * {masks.WIDTH} + col AS region FROM m WHERE value > 0),
hop AS (WITH RECURSIVE r AS (SELECT * FROM t UNION SELECT t.map_id, t.row, t.col, r.region FROM r JOIN t ON t.map_id = r.map_id AND t.row = r.row AND abs(t.col - r.col) = 1)
    SELECT map_id, row, col, min(region) AS region FROM r GROUP BY ALL)
SELECT map_id AS mask_id, row, col, CAST(region AS BIGINT) AS region FROM hop""")
def regions_within_rows(spark, d):
    """Connectivity by a table: neighbours to the left and right only."""
    mask = maps.threshold(label_map(spark, d), 0.0, comparator=lambda v, t: v > t).withColumnRenamed("map_id", "mask_id")
    return masks.regions(mask, connectivity=[[0, 0, 0], [1, 1, 1], [0, 0, 0]])


@query(f"{MAPS} SELECT map_id, row, col, 1.0::DOUBLE AS weight FROM m WHERE value >= 0.02")
def threshold_mask(spark, d):
    return maps.threshold(label_map(spark, d), 0.02)


@query(f"{MAPS} SELECT map_id, row, col, 1.0::DOUBLE AS weight FROM (SELECT *, max(abs(value)) OVER (PARTITION BY map_id) AS top FROM m) WHERE abs(value) >= 0.15 * top")
def threshold_mask_fraction(spark, d):
    return maps.threshold(label_map(spark, d), 0.15, magnitude=True, of_max=True)


@query(f"""{MAPS} SELECT map_id, row, col, round(value, 6) AS value FROM (SELECT *, min(value) OVER (PARTITION BY map_id) AS low FROM m) a WHERE value > low
    AND NOT EXISTS (SELECT 1 FROM m b WHERE b.map_id = a.map_id AND abs(b.row - a.row) <= 1 AND abs(b.col - a.col) <= 1 AND b.value > a.value)""")
def local_maxima(spark, d):
    return rounded(maps.local_maxima(label_map(spark, d)), "value")


@query(f"""{MAPS}, t AS (SELECT map_id, row, col FROM m WHERE value > 0),
reach AS (SELECT map_id, row, col, row * {masks.WIDTH} + col AS region FROM t),
hop AS (WITH RECURSIVE r AS (SELECT map_id, row, col, region FROM reach UNION SELECT t.map_id, t.row, t.col, r.region FROM r JOIN t ON t.map_id = r.map_id
    AND abs(t.row - r.row) + abs(t.col - r.col) = 1) SELECT map_id, row, col, min(region) AS region FROM r GROUP BY ALL)
SELECT map_id AS mask_id, row, col, 1.0::DOUBLE AS weight FROM (SELECT *, count(*) OVER (PARTITION BY map_id, region) AS n FROM hop) WHERE n >= 4""")
def roi_by_size(spark, d):
    mask = maps.threshold(label_map(spark, d), 0.0, comparator=lambda v, t: v > t).withColumnRenamed("map_id", "mask_id")
    return masks.by_size(mask, least=4, empty="drop")


@query("SELECT recording_id, idx, round(value, 6) AS value FROM (SELECT *, count(*) OVER (PARTITION BY recording_id) AS n FROM sig) WHERE idx >= 10 AND idx < greatest(n - 20, 0)")
def index_slice(spark, d):
    return rounded(select.by_index(A.signal(spark, d), 10, -20).select("recording_id", "idx", "value"), "value")


START, END = 1_706_000_000.0, 1_709_000_000.0


@query(f"SELECT recording_id, idx, round(value, 6) AS value FROM sig WHERE time >= {START} AND time < {END}")
def time_slice_exclusive(spark, d):
    return rounded(select.by_time(A.signal(spark, d), START, END).select("recording_id", "idx", "value"), "value")


@query(f"""SELECT recording_id, idx, round(value, 6) AS value FROM (SELECT *, max(CASE WHEN time <= {START} THEN time END) OVER w AS s, min(CASE WHEN time >= {END} THEN time END) OVER w AS e
    FROM sig WINDOW w AS (PARTITION BY recording_id)) WHERE time >= coalesce(s, {START}) AND time <= coalesce(e, {END})""")
def time_slice_inclusive(spark, d):
    out = select.by_time(A.signal(spark, d), START, END, start_inclusive=True, end_inclusive=True)
    return rounded(out.select("recording_id", "idx", "value"), "value")


@query(f"SELECT recording_id, idx, round(value, 6) AS value FROM (SELECT *, min(CASE WHEN time >= {START} THEN time END) OVER (PARTITION BY recording_id) AS e FROM sig) WHERE time = e")
def time_point(spark, d):
    return rounded(select.at_time(A.signal(spark, d), START).select("recording_id", "idx", "value"), "value")


STEPS = "steps AS (SELECT recording_id, idx, time AS start_time, lead(time) OVER (PARTITION BY recording_id ORDER BY idx) AS end_time FROM sig)"


def steps(spark: SparkSession, d: str) -> DataFrame:
    out = A.signal(spark, d).select("recording_id", "idx", F.col("time").alias("start_time"), F.lead("time").over(signal.order()).alias("end_time"))
    return out.where("end_time is not null")


@query(f"{STEPS} SELECT recording_id, idx, round(start_time, 3) AS start_time, round(end_time, 3) AS end_time FROM steps WHERE start_time >= {START} AND end_time <= {END}")
def interval_contained(spark, d):
    out = select.intervals(steps(spark, d), START, END)
    return out.select("recording_id", "idx", F.round("start_time", 3).alias("start_time"), F.round("end_time", 3).alias("end_time"))


@query(f"""{STEPS} SELECT recording_id, idx, round(greatest(start_time, {START}), 3) AS start_time, round(least(end_time, {END}), 3) AS end_time
    FROM steps WHERE start_time < {END} AND end_time > {START}""")
def interval_overlap(spark, d):
    out = select.intervals(steps(spark, d), START, END, partial=True)
    return out.select("recording_id", "idx", F.round("start_time", 3).alias("start_time"), F.round("end_time", 3).alias("end_time"))


@query(f"SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY idx) - 1 AS idx, round(value, 6) AS value FROM sig WHERE time < {START} OR time >= {END}")
def concatenate(spark, d):
    sig = A.signal(spark, d)
    late = select.by_time(sig, END).withColumn("idx", F.row_number().over(W.partitionBy("recording_id").orderBy("idx")).cast("long") - 1)
    return rounded(select.concatenate(select.by_time(sig, None, START), late).select("recording_id", "idx", "value"), "value")


_TREE = ", ".join(f"('{n}', {'NULL' if p is None else chr(39) + p + chr(39)})" for n, p, _, _ in cat.compact(cat.DEFAULT))
TREE = f"""tree(name, parent) AS (VALUES {_TREE}),
below AS (WITH RECURSIVE b AS (SELECT name, parent, name AS top, 0 AS depth FROM tree UNION ALL SELECT t.name, t.parent, b.top, b.depth + 1 FROM tree t JOIN b ON t.parent = b.name) SELECT * FROM b)"""


@query(f"{TREE} SELECT name, parent, depth + (SELECT depth FROM below WHERE name = 'impedance' AND top = 'root') AS depth FROM below WHERE top = 'impedance'")
def category_subtree(spark, d):
    return cat.categories(spark).where(cat.within(F.col("path"), "impedance")).select("name", "parent", F.col("depth").cast("long").alias("depth"))


@query(f"{TREE} SELECT name, parent, CAST(depth AS BIGINT) AS depth FROM below WHERE top = 'root'")
def category_tree(spark, d):
    return cat.categories(spark).select("name", "parent", F.col("depth").cast("long").alias("depth"))


@query(f"""{TREE}, kind AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'airway pressure' WHEN 'error' THEN 'plateau pressure' WHEN 'view' THEN 'relative impedance' ELSE 'other' END AS category FROM sig)
SELECT category, count(*) AS n FROM kind WHERE category IN (SELECT name FROM below WHERE top = 'pressure') GROUP BY ALL""")
def category_check(spark, d):
    """Rows of a category or one below it."""
    kind = F.when(F.col("event_type") == "purchase", "airway pressure").when(F.col("event_type") == "error", "plateau pressure").when(F.col("event_type") == "view", "relative impedance").otherwise("other")
    return cat.of_category(A.signal(spark, d).withColumn("category", kind), "pressure").groupBy("category").agg(F.count("*").alias("n"))


INVALID = """st AS (SELECT recording_id, avg(value) AS m, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM sig GROUP BY ALL),
inv AS (SELECT s.*, s.value < m - 1.5 * (m - lo) OR s.value > m + 1.5 * (hi - m) AS invalid FROM sig s JOIN st USING (recording_id))"""


@query(f"{INVALID} SELECT recording_id, idx, round(value, 6) AS value FROM inv WHERE invalid")
def invalid_samples(spark, d):
    return rounded(signal.with_invalid(A.signal(spark, d), multiplier=1.5).where("invalid").select("recording_id", "idx", "value"), "value")


FILLED = """near AS (SELECT *, max(CASE WHEN NOT invalid THEN idx END) OVER (PARTITION BY recording_id ORDER BY idx) AS p,
    min(CASE WHEN NOT invalid THEN idx END) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM inv),
filled AS (SELECT a.recording_id, a.idx, CASE WHEN NOT a.invalid THEN a.value WHEN a.p IS NULL THEN r.value WHEN a.n IS NULL THEN l.value
    WHEN a.idx - a.p - 1 < (a.n - a.p - 1) // 2 THEN l.value ELSE r.value END AS value
    FROM near a LEFT JOIN sig l ON l.recording_id = a.recording_id AND l.idx = a.p LEFT JOIN sig r ON r.recording_id = a.recording_id AND r.idx = a.n)"""


@query(f"{INVALID}, {FILLED} SELECT recording_id, idx, round(value, 6) AS value FROM filled")
def fill_nearest(spark, d):
    out = signal.fill_nearest(signal.with_invalid(A.signal(spark, d), multiplier=1.5))
    return rounded(out.select("recording_id", "idx", "value"), "value")


def _average_sql(source: str, weights: list[float], name: str = "avg_") -> str:
    rows = ", ".join(f"({k - len(weights) // 2}, {w!r}::DOUBLE)" for k, w in enumerate(weights))
    return f"""w_{name} AS (SELECT * FROM (VALUES {rows}) AS v(o, w)), n_{name} AS (SELECT recording_id, count(*) AS n FROM {source} GROUP BY ALL),
{name} AS (SELECT s.recording_id, s.idx, s.value, sum(c.value * w.w) AS average FROM {source} s JOIN n_{name} n USING (recording_id), w_{name} w
    JOIN {source} c ON c.recording_id = s.recording_id AND c.idx = greatest(0, least(n.n - 1, s.idx + w.o)) GROUP BY ALL)"""


UNIFORM, BLACKMAN = [1 / 15] * 15, signal.blackman(AVERAGE)


@query(f"{_average_sql('sig', UNIFORM)} SELECT recording_id, idx, round(average, 6) AS average FROM avg_")
def moving_average_uniform(spark, d):
    return rounded(signal.moving_average(A.signal(spark, d), UNIFORM).select("recording_id", "idx", "average"), "average")


@query(f"{_average_sql('sig', BLACKMAN)} SELECT recording_id, idx, round(average, 6) AS average FROM avg_")
def moving_average_blackman(spark, d):
    return rounded(signal.moving_average(A.signal(spark, d), BLACKMAN).select("recording_id", "idx", "average"), "average")


#: Breath detection of a table with recording_id, idx, value, as SQL; flat tops count once, at their middle.
BREATHS = f"""{_average_sql('src', BLACKMAN)},
runs AS (SELECT *, sum(new) OVER (PARTITION BY recording_id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY recording_id ORDER BY idx) THEN 0 ELSE 1 END AS new FROM avg_)),
flat AS (SELECT recording_id, run, min(idx) AS lo, max(idx) AS hi, any_value(value) AS v FROM runs GROUP BY ALL),
turns AS (SELECT recording_id, CAST((lo + hi) // 2 AS BIGINT) AS idx, CASE WHEN v > p AND v > n THEN 1 WHEN v < p AND v < n THEN -1 END AS kind FROM
    (SELECT *, lag(v) OVER (PARTITION BY recording_id ORDER BY run) AS p, lead(v) OVER (PARTITION BY recording_id ORDER BY run) AS n FROM flat)),
ext AS (SELECT t.recording_id, t.idx, a.value, t.kind FROM turns t JOIN avg_ a USING (recording_id, idx) WHERE (kind = 1 AND value >= average) OR (kind = -1 AND value <= average)),
side AS (SELECT recording_id, idx, average, max(value) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
    max(value) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM avg_),
e1 AS (SELECT e.*, average, before, after, min(CASE WHEN kind = -1 THEN idx END) OVER (PARTITION BY recording_id) AS v0, max(CASE WHEN kind = -1 THEN idx END) OVER (PARTITION BY recording_id) AS v1
    FROM ext e JOIN side USING (recording_id, idx)),
e2 AS (SELECT recording_id, idx, value, kind FROM e1 WHERE NOT coalesce(kind = -1 AND ((idx = v0 AND before < average) OR (idx = v1 AND after < average)), false)),
e3 AS (SELECT *, min(CASE WHEN kind = -1 THEN idx END) OVER (PARTITION BY recording_id) AS v0, max(CASE WHEN kind = -1 THEN idx END) OVER (PARTITION BY recording_id) AS v1 FROM e2),
tr AS (SELECT recording_id, idx, value, kind FROM e3 WHERE kind = -1 OR (idx > v0 AND idx < v1)),
"""


def _alternate_sql(source: str, name: str) -> str:
    return f"""{name}_i AS (SELECT *, sum(turn) OVER (PARTITION BY recording_id ORDER BY idx) AS island FROM
    (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY recording_id ORDER BY idx) THEN 0 ELSE 1 END AS turn FROM {source})),
{name} AS (SELECT recording_id, idx, value, kind FROM {name}_i QUALIFY row_number() OVER (PARTITION BY recording_id, island ORDER BY value * kind DESC, idx) = 1)"""


BREATHS += f"""{_alternate_sql('tr', 'alt')},
hgt AS (SELECT *, CASE WHEN kind = 1 THEN value - (lag(value) OVER (PARTITION BY recording_id ORDER BY idx) + lead(value) OVER (PARTITION BY recording_id ORDER BY idx)) / 2 END AS height FROM alt),
high AS (SELECT h.recording_id, idx, value, kind FROM hgt h JOIN (SELECT recording_id, median(height) * 0.25 AS cut FROM hgt GROUP BY ALL) USING (recording_id) WHERE kind = -1 OR height >= cut),
{_alternate_sql('high', 'fin')},
br AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY middle_idx) - 1 AS breath_idx, * EXCLUDE (recording_id, kind) FROM
    (SELECT recording_id, kind, lag(idx) OVER w AS start_idx, idx AS middle_idx, lead(idx) OVER w AS end_idx, lag(value) OVER w AS sv, value AS mv, lead(value) OVER w AS ev
    FROM fin WINDOW w AS (PARTITION BY recording_id ORDER BY idx)) WHERE kind = 1 AND start_idx IS NOT NULL AND end_idx IS NOT NULL)"""
SIGNAL = f"src AS (SELECT recording_id, idx, value FROM sig), {BREATHS}"
IMPEDANCE = f"src AS (SELECT recording_id, frame_idx AS idx, sum(z) AS value FROM pix GROUP BY ALL), {BREATHS}"


def averaged(spark: SparkSession, d: str) -> DataFrame:
    return signal.moving_average(A.signal(spark, d), BLACKMAN)


def breaths_of(data: DataFrame) -> DataFrame:
    """Breaths of averaged signals without a minimum distance."""
    return B.assembled(B.without_low(B.alternating(B.trimmed(B.extrema(data, around=True)))))


def impedance(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signal, breaths, pixels) of the frames."""
    frames = A.frames(spark, d)
    data = signal.moving_average(maps.global_impedance(frames).withColumnRenamed("frame_idx", "idx"), BLACKMAN)
    return data, breaths_of(data), A.pixels(frames)


@query(f"{SIGNAL} SELECT recording_id, idx, CAST(kind AS INTEGER) AS kind, round(value, 6) AS value FROM ext")
def local_extrema(spark, d):
    return rounded(B.extrema(averaged(spark, d)).select("recording_id", "idx", "kind", "value"), "value")


@query(f"{SIGNAL} SELECT recording_id, idx, CAST(kind AS INTEGER) AS kind, round(value, 6) AS value FROM alt")
def alternate_extrema(spark, d):
    data = averaged(spark, d)
    return rounded(B.alternating(B.trimmed(B.extrema(data), data)).select("recording_id", "idx", "kind", "value"), "value")


@query(f"{SIGNAL} SELECT recording_id, breath_idx, start_idx, middle_idx, end_idx FROM br")
def breaths(spark, d):
    return breaths_of(averaged(spark, d)).select("recording_id", "breath_idx", "start_idx", "middle_idx", "end_idx")


@query(f"""{SIGNAL}, {INVALID} SELECT recording_id, breath_idx, start_idx, middle_idx, end_idx FROM br
    WHERE NOT EXISTS (SELECT 1 FROM inv WHERE inv.recording_id = br.recording_id AND invalid AND inv.idx >= start_idx - 3 AND inv.idx < end_idx + 3)""")
def breaths_near_invalid(spark, d):
    data = signal.with_invalid(averaged(spark, d), multiplier=1.5)
    return B.near_invalid(breaths_of(data), data, 3).select("recording_id", "breath_idx", "start_idx", "middle_idx", "end_idx")


def _breaths_sql(source: str, weights: list[float], distance: int) -> str:
    """Breaths of ``src`` with a smallest distance of extrema: the greatest among neighbours stay and their neighbours go, until none are left."""
    frame = f"RANGE BETWEEN {distance - 1} PRECEDING AND {distance - 1} FOLLOWING"
    thin = f"""sup AS (WITH RECURSIVE s AS (SELECT recording_id, kind, idx, value, value * kind AS h, false AS kept FROM ext UNION ALL
    SELECT recording_id, kind, idx, value, h, win FROM (SELECT *, bool_or(win) OVER (PARTITION BY recording_id, kind ORDER BY idx {frame}) AS near FROM
        (SELECT *, max({{'h': h, 'i': idx}}) OVER (PARTITION BY recording_id, kind ORDER BY idx {frame}) = {{'h': h, 'i': idx}} AS win FROM s WHERE NOT kept)) WHERE win OR NOT near)
    SELECT recording_id, idx, value, kind FROM s WHERE kept),
enough AS (SELECT recording_id FROM sup GROUP BY recording_id HAVING count(*) FILTER (kind = -1) >= 2 AND count(*) FILTER (kind = 1) >= 1),
far AS (SELECT sup.* FROM sup JOIN enough USING (recording_id))"""
    body = BREATHS.replace(_average_sql("src", BLACKMAN), _average_sql("src", weights)).replace("FROM ext e JOIN side", "FROM far e JOIN side").replace("side AS (SELECT", f"{thin},\nside AS (SELECT", 1)
    return f"src AS ({source}), {body}"


@query(f"{_breaths_sql('SELECT recording_id, idx, value FROM sig', BLACKMAN, 13)} SELECT recording_id, breath_idx, start_idx, middle_idx, end_idx FROM br")
def breaths_min_distance(spark, d):
    data = averaged(spark, d)
    points = B.trimmed(B.suppressed(B.extrema(data, around=True), 13))
    return B.assembled(B.without_low(B.alternating(points))).select("recording_id", "breath_idx", "start_idx", "middle_idx", "end_idx")


#: Samples a second that the detector is told of for the events.
EVENT_RATE = 5.0


@query(f"""{INVALID.replace('1.5', '1.4')}, {FILLED}, {_breaths_sql('SELECT * FROM filled', signal.blackman(int(EVENT_RATE * 15)), 4)}
SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY breath_idx) - 1 AS n, start_idx, middle_idx, end_idx, round(mv, 6) AS middle_value FROM br
    WHERE NOT EXISTS (SELECT 1 FROM inv WHERE inv.recording_id = br.recording_id AND invalid AND inv.idx >= start_idx - 3 AND inv.idx < end_idx + 3)""")
def find_breaths(spark, d):
    """The detector with its defaults, but for a multiplier that makes some of the events outliers."""
    found = B.find_breaths(A.signal(spark, d), EVENT_RATE, invalid_multiplier=1.4)
    n = F.row_number().over(W.partitionBy("recording_id").orderBy("breath_idx")).cast("long") - 1
    return rounded(found.select("recording_id", n.alias("n"), "start_idx", "middle_idx", "end_idx", "middle_value"), "middle_value")


@query(f"""{SIGNAL} SELECT recording_id, breath_idx, round(mv - sv, 6) AS inspiratory, round(mv - ev, 6) AS expiratory, round(mv - (sv + ev) / 2, 6) AS mean,
    round(ev, 6) AS end_expiratory FROM br""")
def tidal_variation(spark, d):
    return rounded(B.tidal_variation(breaths_of(averaged(spark, d))).drop("middle_time"), "inspiratory", "expiratory", "mean", "end_expiratory")


PIXEL_TIV = """pv AS (SELECT br.recording_id, breath_idx, s.row, s.col, m.z - s.z AS inspiratory, m.z - e.z AS expiratory, m.z - (s.z + e.z) / 2 AS mean FROM br
    JOIN pix s ON s.recording_id = br.recording_id AND s.frame_idx = start_idx JOIN pix m ON m.recording_id = br.recording_id AND m.frame_idx = middle_idx AND m.row = s.row AND m.col = s.col
    JOIN pix e ON e.recording_id = br.recording_id AND e.frame_idx = end_idx AND e.row = s.row AND e.col = s.col)"""


@query(f"{IMPEDANCE}, {PIXEL_TIV} SELECT recording_id, breath_idx, row, col, round(inspiratory, 6) AS inspiratory, round(expiratory, 6) AS expiratory, round(mean, 6) AS mean FROM pv")
def pixel_tidal_variation(spark, d):
    _, found, px = impedance(spark, d)
    return rounded(B.pixel_variation(found, px), "inspiratory", "expiratory", "mean")


@query(f"{IMPEDANCE}, {PIXEL_TIV} SELECT recording_id AS map_id, row, col, round(avg(mean), 6) AS value FROM pv GROUP BY ALL")
def mean_pixel_tidal_variation(spark, d):
    _, found, px = impedance(spark, d)
    return rounded(P.mean_map(B.pixel_variation(found, px)), "value")


@query(f"""{IMPEDANCE}, {PIXEL_TIV}, mp AS (SELECT recording_id AS map_id, row, col, avg(mean) AS value FROM pv GROUP BY ALL)
SELECT map_id, row, col, 1.0::DOUBLE AS weight FROM (SELECT *, max(value) OVER (PARTITION BY map_id) AS top FROM mp) WHERE value >= 0.15 * top""")
def tiv_lungspace(spark, d):
    _, found, px = impedance(spark, d)
    return P.tiv_lungspace(found, px)


def _pixel_breaths_sql(sign: str, lags: str = "lg AS (SELECT DISTINCT recording_id, row, col, 0 AS lag FROM pix)") -> str:
    return f"""{IMPEDANCE}, {PIXEL_TIV}, {lags}, mt AS (SELECT recording_id, row, col, avg(inspiratory) AS tiv FROM pv GROUP BY ALL),
px2 AS (SELECT pix.recording_id, frame_idx, frame_idx - lag AS pos, pix.row, pix.col, z * {sign} AS v FROM pix JOIN mt USING (recording_id, row, col) JOIN lg USING (recording_id, row, col)),
seg AS (SELECT recording_id, breath_idx, middle_idx AS lo, lead(middle_idx) OVER (PARTITION BY recording_id ORDER BY breath_idx) AS hi FROM br),
cut AS (SELECT x.recording_id, row, col, breath_idx, arg_min(frame_idx, (v, frame_idx)) AS cut, min(v) AS low, max(v) AS top FROM seg s JOIN px2 x ON x.recording_id = s.recording_id AND pos >= lo AND pos < hi GROUP BY ALL),
ok AS (SELECT * FROM cut WHERE low < top),
fr AS (SELECT recording_id, row, col, breath_idx + 1 AS breath_idx, cut AS s, lead(cut) OVER w AS e, lead(breath_idx) OVER w AS nx FROM ok WINDOW w AS (PARTITION BY recording_id, row, col ORDER BY breath_idx)),
pk AS (SELECT f.recording_id, f.breath_idx, f.row, f.col, s AS start_idx, e AS end_idx, arg_max(frame_idx, (v, -frame_idx)) AS middle_idx FROM fr f
    JOIN px2 x ON x.recording_id = f.recording_id AND x.row = f.row AND x.col = f.col AND frame_idx >= s AND frame_idx < e WHERE nx = f.breath_idx GROUP BY ALL)
SELECT recording_id, breath_idx, row, col, start_idx, middle_idx, end_idx FROM pk WHERE start_idx < middle_idx AND middle_idx < end_idx"""


@query(_pixel_breaths_sql("1"))
def pixel_breaths(spark, d):
    _, found, px = impedance(spark, d)
    return P.pixel_breaths(found, px)


@query(_pixel_breaths_sql("(CASE WHEN tiv < 0 THEN -1 ELSE 1 END)"))
def pixel_breaths_negative(spark, d):
    _, found, px = impedance(spark, d)
    return P.pixel_breaths(found, px, negative=True)


#: Lag of each pixel: correlation with the summed signal without trends; the most prominent peaks within a breath, of them the nearest to 0.
LAGS = """lz AS (SELECT recording_id, row, col, regr_intercept(z, frame_idx) AS i, regr_slope(z, frame_idx) AS s, stddev_pop(z) AS spread FROM pix GROUP BY ALL),
lv AS (SELECT recording_id, regr_intercept(value, idx) AS i, regr_slope(value, idx) AS s, count(*) AS n FROM src GROUP BY ALL),
tz AS (SELECT recording_id, row, col, frame_idx, z - (i + s * frame_idx) AS a, spread FROM pix JOIN lz USING (recording_id, row, col)),
tg AS (SELECT recording_id, idx, value - (i + s * idx) AS b, n FROM src JOIN lv USING (recording_id)),
reach AS (SELECT recording_id, (max(middle_idx) - min(middle_idx)) / (count(*) - 1) AS reach FROM br GROUP BY ALL HAVING count(*) > 1),
xc AS (SELECT z.recording_id, row, col, frame_idx - idx AS lag, sum(a * b) AS c FROM tz z JOIN tg ON tg.recording_id = z.recording_id AND frame_idx - idx BETWEEN -((n - 1) // 2) AND n // 2 WHERE spread > 0 GROUP BY ALL),
dv AS (SELECT recording_id, row, col, stddev_pop(c) AS dev FROM xc GROUP BY ALL),
nc AS (SELECT xc.* FROM xc JOIN reach USING (recording_id) WHERE abs(lag) <= reach),
tops AS (SELECT *, lag(c) OVER w AS before, lead(c) OVER w AS after FROM nc WINDOW w AS (PARTITION BY recording_id, row, col ORDER BY lag)),
wide AS (SELECT t.recording_id, t.row, t.col, t.lag, t.c, coalesce(max(o.lag) FILTER (o.lag < t.lag AND o.c > t.c), -1000000) AS l, coalesce(min(o.lag) FILTER (o.lag > t.lag AND o.c > t.c), 1000000) AS r
    FROM tops t JOIN nc o ON o.recording_id = t.recording_id AND o.row = t.row AND o.col = t.col WHERE t.c > before AND t.c > after AND t.c >= 0 GROUP BY ALL),
prom AS (SELECT w.recording_id, w.row, w.col, w.lag, w.c, w.c - greatest(min(o.c) FILTER (o.lag < w.lag), min(o.c) FILTER (o.lag > w.lag)) AS prominence
    FROM wide w JOIN nc o ON o.recording_id = w.recording_id AND o.row = w.row AND o.col = w.col AND o.lag > l AND o.lag < r GROUP BY w.recording_id, w.row, w.col, w.lag, w.c),
lg AS (SELECT recording_id, row, col, lag FROM prom JOIN dv USING (recording_id, row, col) WHERE prominence >= dev QUALIFY row_number() OVER (PARTITION BY recording_id, row, col ORDER BY abs(lag), c DESC, lag DESC) = 1)"""


@query(f"{IMPEDANCE}, {LAGS} SELECT recording_id, row, col, lag FROM lg")
def phase_lags(spark, d):
    data, found, px = impedance(spark, d)
    return P.phase_lags(data, px, found)


@query(f"""{_pixel_breaths_sql("1", LAGS).rsplit("SELECT recording_id, breath_idx, row, col, start_idx", 1)[0]},
own AS (SELECT p.recording_id AS map_id, p.row, p.col, avg(m.z - (s.z + e.z) / 2) AS value FROM pk p
    JOIN pix s ON s.recording_id = p.recording_id AND s.row = p.row AND s.col = p.col AND s.frame_idx = start_idx
    JOIN pix m ON m.recording_id = p.recording_id AND m.row = p.row AND m.col = p.col AND m.frame_idx = middle_idx
    JOIN pix e ON e.recording_id = p.recording_id AND e.row = p.row AND e.col = p.col AND e.frame_idx = end_idx
    WHERE start_idx < middle_idx AND middle_idx < end_idx GROUP BY ALL)
SELECT map_id, row, col, 1.0::DOUBLE AS weight FROM (SELECT *, max(value) OVER (PARTITION BY map_id) AS top FROM own) WHERE value >= 0.15 * top""")
def amplitude_lungspace(spark, d):
    data, found, px = impedance(spark, d)
    return P.amplitude_lungspace(data, found, px)


#: Flooding a pixel a turn: of the pixels that have a number and were not yet taken the highest, the earliest numbered of equals, hands its number on.
FLOOD = """im AS (SELECT map_id, row, col, coalesce(am.v, 0) AS a, tm.v AS t FROM am FULL JOIN tm USING (map_id, row, col)),
lim AS (SELECT map_id, 0.15 * max(t) AS lim, min(a) AS low FROM im GROUP BY ALL),
mk AS (SELECT i.*, lim, a > low AND NOT EXISTS (SELECT 1 FROM im o WHERE o.map_id = i.map_id AND abs(o.row - i.row) <= 1 AND abs(o.col - i.col) <= 1 AND o.a > i.a) AS top FROM im i JOIN lim USING (map_id)),
flood AS (WITH RECURSIVE s AS (
    SELECT map_id, row, col, a, CASE WHEN top THEN sum(CASE WHEN top THEN 1 ELSE 0 END) OVER (PARTITION BY map_id ORDER BY row, col) ELSE 0 END AS mark, CAST(row * 8 + col AS BIGINT) AS age, false AS taken, 0 AS turn FROM mk
    UNION ALL SELECT map_id, row, col, a, CASE WHEN new THEN pm ELSE mark END, CASE WHEN new THEN 1000 + turn * 4 + 2 * (row - pr) + (col - pc) ELSE age END, taken OR pick, turn + 1 FROM
        (SELECT *, mark = 0 AND abs(row - pr) + abs(col - pc) = 1 AS new FROM
            (SELECT *, max(CASE WHEN pick THEN row END) OVER m AS pr, max(CASE WHEN pick THEN col END) OVER m AS pc, max(CASE WHEN pick THEN mark END) OVER m AS pm FROM
                (SELECT *, mark > 0 AND NOT taken AND row_number() OVER (PARTITION BY map_id ORDER BY mark > 0 AND NOT taken DESC, a DESC, age) = 1 AS pick FROM s) WINDOW m AS (PARTITION BY map_id)))
        WHERE pm IS NOT NULL)
    SELECT map_id, row, col, mark FROM s QUALIFY turn = max(turn) OVER (PARTITION BY map_id))"""


@query(f"""{_pixel_breaths_sql("1", LAGS).rsplit("SELECT recording_id, breath_idx, row, col, start_idx", 1)[0]},
ov AS (SELECT p.recording_id, p.breath_idx, p.row, p.col, m.z - (s.z + e.z) / 2 AS mean FROM pk p
    JOIN pix s ON s.recording_id = p.recording_id AND s.row = p.row AND s.col = p.col AND s.frame_idx = start_idx
    JOIN pix m ON m.recording_id = p.recording_id AND m.row = p.row AND m.col = p.col AND m.frame_idx = middle_idx
    JOIN pix e ON e.recording_id = p.recording_id AND e.row = p.row AND e.col = p.col AND e.frame_idx = end_idx
    WHERE start_idx < middle_idx AND middle_idx < end_idx),
cm AS (SELECT DISTINCT recording_id, breath_idx FROM ov JOIN (SELECT DISTINCT recording_id, breath_idx FROM pv) USING (recording_id, breath_idx)),
am AS (SELECT recording_id AS map_id, row, col, avg(mean) AS v FROM ov JOIN cm USING (recording_id, breath_idx) GROUP BY ALL),
tm AS (SELECT recording_id AS map_id, row, col, avg(mean) AS v FROM pv JOIN cm USING (recording_id, breath_idx) GROUP BY ALL), {FLOOD}
SELECT f.map_id, f.row, f.col, 1.0::DOUBLE AS weight FROM flood f JOIN mk USING (map_id, row, col)
    WHERE a >= lim AND EXISTS (SELECT 1 FROM flood g JOIN mk k USING (map_id, row, col) WHERE g.map_id = f.map_id AND g.mark = f.mark AND k.top AND k.t >= k.lim)""")
def watershed_lungspace(spark, d):
    data, found, px = impedance(spark, d)
    return P.watershed_lungspace(data, found, px)


@query("""t AS (SELECT recording_id, idx, time % 86400 AS t FROM sig),
s AS (SELECT *, t - lag(t) OVER (PARTITION BY recording_id ORDER BY idx) AS step FROM t)
SELECT recording_id, idx, round(t + 86400 * sum(CASE WHEN step < -43200 THEN 1 WHEN step > 43200 THEN -1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY idx), 3) AS time FROM s""")
def unwrap_time(spark, d):
    out = signal.unwrap(A.signal(spark, d).withColumn("time", F.col("time") % 86400), 86400.0)
    return out.select("recording_id", "idx", F.round("time", 3).alias("time"))


@query("""r AS (SELECT recording_id, 1 / regr_slope(time, idx) AS rate FROM sig GROUP BY ALL)
SELECT recording_id, round(round(rate * pow(10, 3 - floor(log10(rate)))) / pow(10, 3 - floor(log10(rate))), 9) AS sample_frequency FROM r""")
def sample_frequency(spark, d):
    return signal.sample_frequency(A.signal(spark, d)).select("recording_id", F.round("sample_frequency", 9).alias("sample_frequency"))


@query("""k AS (SELECT recording_id, idx, length(event_type) AS marker FROM sig)
SELECT recording_id, idx, CAST(marker AS INTEGER) AS marker FROM k QUALIFY marker > lag(marker) OVER (PARTITION BY recording_id ORDER BY idx)""")
def marker_events(spark, d):
    out = A.signal(spark, d).select("recording_id", "idx", F.length("event_type").alias("marker")).withColumn("before", F.lag("marker").over(signal.order()))
    return out.where("marker > before").drop("before")


@query("SELECT CAST(k AS INTEGER) AS harmonic, round(CASE WHEN k = 1 THEN greatest(1.2 - 10.0 / 60, 0.7) ELSE k * 1.2 - 10.0 / 60 END, 9) AS low, round(k * 1.2 + 10.0 / 60, 9) AS high FROM range(1, CAST(floor((220.0 / 60 + 10.0 / 60) / 1.2) AS BIGINT) + 1) AS r(k)")
def notch_bands(spark, d):
    bands = [(k, round(a, 9), round(b, 9)) for k, a, b in spectrum.notch_bands(0.2, 1.2)]
    return spark.createDataFrame(bands, "harmonic int, low double, high double")


def _pass_sql(source: str, out: str, sos: list[list[float]], rest: list[list[float]]) -> str:
    """Second-order sections over ``source`` (recording_id, idx, value) in order of idx, a sample for each recursion; at first at rest at the first value."""
    number = lambda x: f"({float(x)!r}::DOUBLE)"
    begin = ", ".join(f"{number(z[0])} * first AS p{k}, {number(z[1])} * first AS q{k}" for k, z in enumerate(rest))
    inner = "SELECT r.*, e.value AS x0 FROM r JOIN e ON e.recording_id = r.recording_id AND e.idx = r.i + 1"
    after = []
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        inner = f"SELECT *, {number(b0)} * x{k} + p{k} AS x{k + 1} FROM ({inner})"
        after.append(f"{number(b1)} * x{k} - {number(a1)} * x{k + 1} + q{k}, {number(b2)} * x{k} - {number(a2)} * x{k + 1}")
    return f"""{out} AS (WITH RECURSIVE e AS (SELECT * FROM {source}), r AS (
    SELECT recording_id, CAST(i AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS y, {begin} FROM (SELECT recording_id, min(idx) - 1 AS i, arg_min(value, idx) AS first FROM e GROUP BY recording_id)
    UNION ALL SELECT recording_id, i + 1, x{len(sos)}, {", ".join(after)} FROM ({inner})) SELECT recording_id, i AS idx, y AS value FROM r WHERE y IS NOT NULL)"""


def _filter_sql(source: str, out: str, kind: str, cutoff: float | tuple[float, float], order: int) -> str:
    """Zero-phase filter of ``source`` as ``out``: odd extension, forward, backward."""
    sos = kernels.butterworth(kind, cutoff, order, A.RATE)
    rest, pad = kernels.at_rest(sos), kernels.padding(sos)
    return f"""{out}_n AS (SELECT recording_id, count(*) AS n, arg_min(value, idx) AS v0, arg_max(value, idx) AS v1 FROM {source} GROUP BY recording_id),
{out}_e AS (SELECT recording_id, idx, value FROM {source} UNION ALL
    SELECT recording_id, -idx, 2 * v0 - value FROM {source} JOIN {out}_n USING (recording_id) WHERE idx BETWEEN 1 AND {pad} UNION ALL
    SELECT recording_id, 2 * (n - 1) - idx, 2 * v1 - value FROM {source} JOIN {out}_n USING (recording_id) WHERE idx BETWEEN n - 1 - {pad} AND n - 2),
{_pass_sql(f"{out}_e", f"{out}_f", sos.tolist(), rest.tolist())},
{out}_g AS (SELECT recording_id, -idx AS idx, value FROM {out}_f),
{_pass_sql(f"{out}_g", f"{out}_b", sos.tolist(), rest.tolist())},
{out} AS (SELECT recording_id, -b.idx AS idx, value FROM {out}_b b JOIN {out}_n USING (recording_id) WHERE -b.idx >= 0 AND -b.idx < n)"""


RAW = "raw AS (SELECT recording_id, frame_idx AS idx, sum(z) AS value FROM pix GROUP BY ALL)"


def _impedance_signal(spark: SparkSession, d: str) -> DataFrame:
    return maps.global_impedance(A.frames(spark, d)).withColumnRenamed("frame_idx", "idx")


def _butterworth(name: str, kind: str, cutoff: float | tuple[float, float], order: int) -> None:
    def run(spark, d):
        out = spectrum.Butterworth(kind, cutoff, order, A.RATE).apply(_impedance_signal(spark, d))
        return rounded(out.select("recording_id", "idx", "value"), "value")

    run.__name__ = name
    query(f"{RAW}, {_filter_sql('raw', 'flt', kind, cutoff, order)} SELECT recording_id, idx, round(value, 6) AS value FROM flt")(run)


_butterworth("lowpass_filter", "lowpass", 4.0, 4)
_butterworth("highpass_filter", "highpass", 1.0, 2)
_butterworth("bandpass_filter", "bandpass", (1.0, 4.0), 2)
_butterworth("bandstop_filter", "bandstop", (1.0, 2.0), 1)


@query(f"""src4 AS (SELECT recording_id * 1000 + row * 8 + col AS recording_id, frame_idx AS idx, z AS value FROM pix), {_filter_sql('src4', 'flt', 'lowpass', 4.0, 2)}
SELECT recording_id // 1000 AS recording_id, idx AS frame_idx, CAST(recording_id % 1000 AS INTEGER) AS pixel, round(value, 6) AS z FROM flt""")
def lowpass_frames(spark, d):
    """A filter on every pixel of the frames."""
    out = spectrum.Butterworth("lowpass", 4.0, 2, A.RATE).apply(A.frames(spark, d))
    return rounded(out.select("recording_id", "frame_idx", F.posexplode("pixels").alias("pixel", "z")), "z")


NOTCHES = (0.2, 1.2)


def _notch_sql(source: str, out: str) -> str:
    """The band stops in turn, then the low pass."""
    steps = [("bandstop", (low, high)) for _, low, high in spectrum.notch_bands(*NOTCHES)] + [("lowpass", spectrum.NOISE_LIMIT)]
    parts, before = [], source
    for k, (kind, cutoff) in enumerate(steps):
        name = out if k + 1 == len(steps) else f"{out}{k}"
        parts.append(_filter_sql(before, name, kind, cutoff, 2))
        before = name
    return ",\n".join(parts)


@query(f"{RAW}, {_notch_sql('raw', 'mdn')} SELECT recording_id, idx, round(value, 6) AS value FROM mdn")
def multiple_notch_filter(spark, d):
    out = spectrum.MultipleNotch(*NOTCHES, A.RATE, order=2).apply(_impedance_signal(spark, d))
    return rounded(out.select("recording_id", "idx", "value"), "value")


def _welch_sql(source: str, out: str, size: str, step: str, rate: float) -> str:
    """Power ``p`` at ``f`` of (recording_id, px, idx, value) by segments of ``size`` samples of n; ``k`` numbers the frequencies."""
    return f"""{out}_n AS (SELECT recording_id, n, {size} AS size FROM (SELECT recording_id, max(idx) + 1 AS n FROM {source} GROUP BY ALL)),
{out}_g AS (SELECT recording_id, size, unnest(range(0, n - size + 1, {step})) AS a FROM {out}_n),
{out}_p AS (SELECT s.recording_id, px, a, size, idx - a AS j, (value - avg(value) OVER (PARTITION BY s.recording_id, px, a)) * (0.5 - 0.5 * cos(2 * pi() * (idx - a) / size)) AS v
    FROM {source} s JOIN {out}_g g ON g.recording_id = s.recording_id AND idx >= a AND idx < a + size),
{out}_k AS (SELECT recording_id, unnest(range(0, size // 2 + 1)) AS k FROM {out}_n),
{out}_d AS (SELECT p.recording_id, px, a, size, k, pow(sum(v * cos(2 * pi() * k * j / size)), 2) + pow(sum(v * sin(2 * pi() * k * j / size)), 2) AS p
    FROM {out}_p p JOIN {out}_k USING (recording_id) GROUP BY ALL),
{out} AS (SELECT recording_id, px, k, k * {rate} / size AS f, avg(p) * CASE WHEN k = 0 OR 2 * k = size THEN 1 ELSE 2 END / ({rate} * size * 0.375) AS p FROM {out}_d GROUP BY recording_id, px, k, size)"""


def _rates_sql(rate: float, window: int) -> str:
    (r0, r1), (h0, h1) = spectrum.LIMITS["adult"]
    both = f"s AS (SELECT recording_id, -1 AS px, frame_idx AS idx, sum(z) AS value FROM pix GROUP BY ALL UNION ALL SELECT recording_id, row * {A.SIDE} + col, frame_idx, z FROM pix)"
    pick = """round(CASE WHEN k = lo OR k = hi OR a - 2 * b + c = 0 THEN f ELSE f + (f1 - f) * 0.5 * (a - c) / (a - 2 * b + c) END, 6)"""

    def best(name: str, value: str, low: float, high: float) -> str:
        return f"""{name} AS (SELECT recording_id, {pick} AS rate FROM (SELECT *, {value} AS b, lag({value}) OVER w AS a, lead({value}) OVER w AS c, lead(f) OVER w AS f1 FROM two WINDOW w AS (PARTITION BY recording_id ORDER BY k))
    JOIN (SELECT recording_id, min(k) AS lo, max(k) AS hi FROM two WHERE f >= {low!r} AND f <= {high!r} GROUP BY ALL) USING (recording_id)
    WHERE k BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY b DESC, k) = 1)"""

    return f"""{both}, {_welch_sql('s', 'psd', f'least({window}, n)', 'size - size // 2', rate)},
nrm AS (SELECT recording_id, px, k, f, p / sum(p) OVER (PARTITION BY recording_id, px) AS p FROM psd),
two AS (SELECT recording_id, k, f, max(CASE WHEN px = -1 THEN p END) AS total, avg(CASE WHEN px >= 0 THEN p END) AS pixels FROM nrm GROUP BY ALL),
{best('resp', 'total', r0, r1)}, {best('heart', 'pixels - total', h0, h1)}
SELECT recording_id, resp.rate AS respiratory_rate, heart.rate AS heart_rate FROM resp JOIN heart USING (recording_id)"""


@query(_rates_sql(A.RATE, int(30 * A.RATE)))
def rates(spark, d):
    return rounded(spectrum.rates(A.frames(spark, d), A.RATE), "respiratory_rate", "heart_rate")


@query(_rates_sql(2.0, 16))
def rates_refined(spark, d):
    """The same frames as if two a second, in segments of eight seconds, so that peaks lie within their ranges."""
    return rounded(spectrum.rates(A.frames(spark, d), 2.0, window=8.0), "respiratory_rate", "heart_rate")


@query(f"{SIGNAL}, t AS (SELECT recording_id, idx, time FROM sig) SELECT br.recording_id, breath_idx, round(time, 3) AS time, round(ev, 6) AS value FROM br JOIN t ON t.recording_id = br.recording_id AND t.idx = end_idx")
def end_expiratory_level(spark, d):
    return rounded(B.end_expiratory_level(breaths_of(averaged(spark, d))), "value").withColumn("time", F.round("time", 3))


@query(f"""{SIGNAL} SELECT recording_id, round(avg(step), 6) AS spacing FROM
    (SELECT recording_id, middle_idx - lag(middle_idx) OVER (PARTITION BY recording_id ORDER BY breath_idx) AS step FROM br) GROUP BY ALL""")
def breath_spacing(spark, d):
    return rounded(B.spacing(breaths_of(averaged(spark, d))), "spacing")


@query(f"""{_pixel_breaths_sql("1").rsplit("SELECT recording_id, breath_idx, row, col, start_idx", 1)[0]}
SELECT p.recording_id, breath_idx, p.row, p.col, round(m.z - (s.z + e.z) / 2, 6) AS mean FROM pk p
    JOIN pix s ON s.recording_id = p.recording_id AND s.row = p.row AND s.col = p.col AND s.frame_idx = start_idx
    JOIN pix m ON m.recording_id = p.recording_id AND m.row = p.row AND m.col = p.col AND m.frame_idx = middle_idx
    JOIN pix e ON e.recording_id = p.recording_id AND e.row = p.row AND e.col = p.col AND e.frame_idx = end_idx
    WHERE start_idx < middle_idx AND middle_idx < end_idx""")
def pixel_variation_own_timing(spark, d):
    _, found, px = impedance(spark, d)
    return rounded(P.pixel_timing_variation(P.pixel_breaths(found, px), px), "mean")


DEVICE = f"""flag AS (SELECT recording_id, idx, value, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 END AS kind FROM sig WHERE event_type IN ('purchase', 'error')),
{_alternate_sql('flag', 'dev')}"""


def flags(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1)
    return A.signal(spark, d).withColumn("kind", kind).where("kind is not null").select("recording_id", "idx", "time", "value", "kind")


@query("SELECT recording_id, idx, CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END AS kind FROM sig WHERE event_type IN ('purchase', 'error')")
def phase_flags(spark, d):
    return flags(spark, d).select("recording_id", "idx", "kind")


@query(f"""{DEVICE} SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY middle_idx) - 1 AS breath_idx, start_idx, middle_idx, end_idx FROM
    (SELECT recording_id, kind, lag(idx) OVER w AS start_idx, idx AS middle_idx, lead(idx) OVER w AS end_idx FROM dev WINDOW w AS (PARTITION BY recording_id ORDER BY idx))
    WHERE kind = 1 AND start_idx IS NOT NULL AND end_idx IS NOT NULL""")
def device_breaths(spark, d):
    return B.of_flags(flags(spark, d)).select("recording_id", "breath_idx", "start_idx", "middle_idx", "end_idx")


@query("""SELECT recording_id, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.95), 6) AS p95,
    round(stddev_pop(value), 6) AS deviation, round(max(value), 6) AS largest FROM sig GROUP BY ALL""")
def signal_statistics(spark, d):
    return rounded(Q.statistics(A.signal(spark, d)), "mean", "median", "p5", "p95", "deviation", "largest")


@query("""SELECT recording_id, count(*) AS n, round(min(time), 3) AS first_time, round(max(time), 3) AS last_time, count(value) > 0 AS has_values, count(*) - count(value) AS missing
    FROM sig GROUP BY ALL""")
def signal_summary(spark, d):
    return Q.summary(A.signal(spark, d)).withColumns({n: F.round(n, 3) for n in ("first_time", "last_time")})


@query("SELECT recording_id, idx, round(sqrt(abs(value)) * 2, 6) AS value FROM sig")
def derived_signal(spark, d):
    out = Q.derive(A.signal(spark, d), lambda v: F.sqrt(F.abs(v)) * 2)
    return rounded(out.select("recording_id", "idx", "value"), "value")


@query("""p AS (SELECT recording_id, idx AS point, time + 100 AS time FROM sig WHERE event_type = 'purchase')
SELECT p.recording_id, point, min(s.idx) AS idx FROM p LEFT JOIN sig s ON s.recording_id = p.recording_id AND s.time >= p.time GROUP BY ALL""")
def as_of_forward(spark, d):
    sig = A.signal(spark, d)
    points = sig.where("event_type = 'purchase'").select("recording_id", F.col("idx").alias("point"), (F.col("time") + 100).alias("time"))
    return Q.as_of(points, sig).select("recording_id", "point", "idx")


@query(f"{MAPS}, t AS (SELECT map_id, row, col, row * {masks.WIDTH} + col AS region FROM m WHERE value > 0), hop AS (WITH RECURSIVE r AS (SELECT * FROM t UNION SELECT t.map_id, t.row, t.col, r.region FROM r "
       "JOIN t ON t.map_id = r.map_id AND greatest(abs(t.row - r.row), abs(t.col - r.col)) = 1) SELECT map_id, row, col, min(region) AS region FROM r GROUP BY ALL) "
       "SELECT map_id AS mask_id, CAST(region AS BIGINT) AS region, count(*) AS n FROM hop GROUP BY ALL")  # fmt: skip
def region_sizes(spark, d):
    mask = maps.threshold(label_map(spark, d), 0.0, comparator=lambda v, t: v > t).withColumnRenamed("map_id", "mask_id")
    return masks.region_sizes(mask, connectivity=2)


def sequence(spark: SparkSession, d: str) -> Q.Sequence:
    """Events as a signal, purchases as points, steps as intervals."""
    sig = A.signal(spark, d)
    spans = steps(spark, d).select("recording_id", "start_time", "end_time", F.lit(None).cast("double").alias("value"))
    return Q.Sequence(continuous=sig.drop("event_type"), sparse=sig.where("event_type = 'purchase'").select("recording_id", "time", "value"), intervals=spans)


def sequence_rows(found: Q.Sequence) -> DataFrame:
    return rounded(found.rows(), "value").withColumns({n: F.round(n, 3) for n in ("start", "end")})


def _sequence_sql(continuous: str, sparse: str, intervals: str) -> str:
    return f"""SELECT 'continuous' AS part, recording_id, round(time, 3) AS start, round(time, 3) AS "end", round(value, 6) AS value FROM ({continuous})
UNION ALL SELECT 'sparse', recording_id, round(time, 3), round(time, 3), round(value, 6) FROM ({sparse})
UNION ALL SELECT 'intervals', recording_id, round(start_time, 3), round(end_time, 3), NULL FROM ({intervals})"""


@query(f"""{STEPS}, cut AS (SELECT recording_id, idx, time, value FROM (SELECT *, count(*) OVER (PARTITION BY recording_id) AS n FROM sig) WHERE idx >= 10 AND idx < greatest(n - 20, 0)),
b AS (SELECT recording_id, min(time) AS a, max(time) AS z FROM cut GROUP BY ALL)
{_sequence_sql("FROM cut", "SELECT s.* FROM sig s JOIN b USING (recording_id) WHERE event_type = 'purchase' AND time >= a AND time < z", "SELECT s.* FROM steps s JOIN b USING (recording_id) WHERE start_time >= a AND end_time <= z")}""")
def sequence_index_slice(spark, d):
    return sequence_rows(sequence(spark, d).by_index(10, -20))


def _sequence_time_sql(start: float, end: float) -> str:
    within = f"time >= coalesce(a, {start}) AND time < {end}"
    points = f"(SELECT *, max(CASE WHEN time <= {start} THEN time END) OVER (PARTITION BY recording_id) AS a FROM sig WHERE event_type = 'purchase')"
    return _sequence_sql(
        f"SELECT * FROM (SELECT *, max(CASE WHEN time <= {start} THEN time END) OVER (PARTITION BY recording_id) AS a FROM sig) WHERE {within}",
        f"SELECT * FROM {points} WHERE {within}", f"SELECT * FROM steps WHERE start_time >= {start} AND end_time <= {end}",
    )


@query(f"{STEPS} {_sequence_time_sql(START, END)}")
def sequence_time_slice(spark, d):
    return sequence_rows(sequence(spark, d).by_time(START, END))


@query(f"""{STEPS} {_sequence_sql(f"SELECT * FROM sig WHERE time < {START} OR time >= {END}", f"SELECT * FROM sig WHERE event_type = 'purchase' AND (time < {START} OR time >= {END})",
    f"SELECT * FROM steps WHERE end_time <= {START} OR start_time >= {END}")}""")
def sequence_concatenate(spark, d):
    every = sequence(spark, d)
    return sequence_rows(every.by_time(None, START).concatenate(every.by_time(END, None, start_inclusive=False)))


@query(f"SELECT 'halves' AS pair, true AS equal UNION ALL SELECT 'part', count(*) = 0 FROM sig WHERE time < {START}")
def equality(spark, d):
    sig = A.signal(spark, d).select("recording_id", "time", "value")
    halves = select.by_time(sig, None, START).unionByName(select.by_time(sig, START))
    out = Q.equal(sig, halves).select(F.lit("halves").alias("pair"), "equal")
    return out.unionByName(Q.equal(sig, select.by_time(sig, START)).select(F.lit("part").alias("pair"), "equal"))


def catalogue() -> Q.Catalogue:
    """The series that the queries over the driver's tables make, with what each is derived from."""
    return Q.Catalogue([
        Q.Entry("frames", "frames", "impedance"), Q.Entry("events", "continuous", "other"), Q.Entry("global impedance", "continuous", "impedance", parents=("frames",)),
        Q.Entry("breaths", "intervals", "other", parents=("global impedance",)), Q.Entry("pixel breaths", "intervals", "other", parents=("frames", "breaths")),
        Q.Entry("tidal variation", "sparse", "impedance difference", parents=("global impedance", "breaths")), Q.Entry("lung space", "mask", "other", parents=("pixel breaths",)),
    ])


@query("""edge(label, parent) AS (VALUES ('global impedance', 'frames'), ('breaths', 'global impedance'), ('pixel breaths', 'frames'), ('pixel breaths', 'breaths'),
    ('tidal variation', 'global impedance'), ('tidal variation', 'breaths'), ('lung space', 'pixel breaths')),
hop AS (WITH RECURSIVE r AS (SELECT label, 1 AS steps FROM edge WHERE parent = 'frames' UNION SELECT e.label, steps + 1 FROM r JOIN edge e ON e.parent = r.label) SELECT * FROM r)
SELECT label, CAST(min(steps) AS INTEGER) AS steps FROM hop GROUP BY label""")
def lineage_descendants(spark, d):
    return spark.createDataFrame(sorted(catalogue().descendants("frames").items()), "label string, steps int")


SEGMENT, OVERLAP = 16, 8


@query(f"""s AS (SELECT recording_id, -1 AS px, frame_idx, sum(z) AS v FROM pix GROUP BY ALL UNION ALL SELECT recording_id, row * {A.SIDE} + col, frame_idx, z FROM pix),
seg AS (SELECT recording_id, unnest(range(0, n - {SEGMENT - 1}, {OVERLAP})) AS a FROM (SELECT recording_id, count(*) AS n FROM frames GROUP BY ALL)),
part AS (SELECT s.recording_id, px, a, frame_idx - a AS j, (v - avg(v) OVER (PARTITION BY s.recording_id, px, a)) * (0.5 - 0.5 * cos(2 * pi() * (frame_idx - a) / {SEGMENT})) AS v
    FROM s JOIN seg ON seg.recording_id = s.recording_id AND frame_idx >= a AND frame_idx < a + {SEGMENT}),
dft AS (SELECT recording_id, px, a, k, pow(sum(v * cos(2 * pi() * k * j / {SEGMENT})), 2) + pow(sum(v * sin(2 * pi() * k * j / {SEGMENT})), 2) AS p FROM part, range(0, {SEGMENT // 2 + 1}) AS r(k) GROUP BY recording_id, px, a, k),
psd AS (SELECT recording_id, px, k, avg(p) * CASE WHEN k IN (0, {SEGMENT // 2}) THEN 1 ELSE 2 END AS p FROM dft GROUP BY recording_id, px, k),
nrm AS (SELECT recording_id, px, k, p / sum(p) OVER (PARTITION BY recording_id, px) AS p FROM psd),
two AS (SELECT recording_id, k, max(CASE WHEN px = -1 THEN p END) AS total, avg(CASE WHEN px >= 0 THEN p END) AS pixels FROM nrm GROUP BY ALL)
SELECT recording_id, CAST(k AS INTEGER) AS k, round(k * {A.RATE} / {SEGMENT}, 6) AS frequency, round(total, 6) AS total, round(pixels, 6) AS pixels, round(pixels - total, 6) AS difference FROM two""")
def spectra(spark, d):
    return rounded(spectrum.spectra(A.frames(spark, d), A.RATE, SEGMENT, OVERLAP), "frequency", "total", "pixels", "difference")


@query(f"""{RAW}, {_notch_sql('raw', 'mdn')}, a AS (SELECT recording_id, 0 AS px, idx, value FROM raw), b AS (SELECT recording_id, 0 AS px, idx, value FROM mdn),
{_welch_sql('a', 'pa', 'least(32, n)', 'size - least(16, size - 1)', A.RATE)}, {_welch_sql('b', 'pb', 'least(32, n)', 'size - least(16, size - 1)', A.RATE)}
SELECT recording_id, CAST(k AS INTEGER) AS k, round(pa.f, 6) AS frequency, round(pa.f * 60, 6) AS per_minute, round(pa.p, 6) AS power, round(pb.p, 6) AS filtered FROM pa JOIN pb USING (recording_id, k)""")
def filter_spectra(spark, d):
    """Power before and after the notch filter, the data of a plot of its effect."""
    raw = _impedance_signal(spark, d)
    after = spectrum.power(spectrum.MultipleNotch(*NOTCHES, A.RATE, order=2).apply(raw), A.RATE, 32, 16).withColumnRenamed("power", "filtered")
    both = spectrum.power(raw, A.RATE, 32, 16).join(after.select("recording_id", "k", "filtered"), ["recording_id", "k"])
    return rounded(both, "frequency", "per_minute", "power", "filtered")


def written(spark: SparkSession, d: str, vendor: str) -> list[str]:
    """Files of the frames in a vendor's format, with flags, and times that go on from one recording to the next."""
    idx = F.col("frame_idx")
    phase = F.when(idx % 5 == 0, -1).when(idx % 5 == 2, 1).otherwise(0)
    marked = A.frames(spark, d).withColumns({"phase": phase, "marker": F.expr("CAST(frame_idx div 7 AS INT)"), "time": F.col("time") + F.col("recording_id") * 1000 + 1})
    return encoders.write(marked, scratch(spark, f"files-{vendor}"), vendor, A.RATE)


def loaded(spark: SparkSession, d: str, vendor: str, **given) -> DataFrame:
    """Frames of these files, with the recording that a file is of."""
    return vendors.load(spark, written(spark, d, vendor), vendor, **given).withColumn("recording_id", F.regexp_extract("path", r"([0-9]+)[.][a-z]+$", 1).cast("long"))


def _loaded(frames: DataFrame, *more) -> DataFrame:
    px = F.aggregate("pixels", F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return frames.select("recording_id", "frame_idx", F.round("time", 3).alias("time"), F.size("pixels").alias("n_pixels"), F.round(px, 4).alias("value"), *more)


def _loaded_sql(pixels: int, time: str, more: str, where: str = "true") -> str:
    return f"SELECT recording_id, frame_idx, round({time}, 3) AS time, {pixels} AS n_pixels, round(sum(z), 4) AS value, {more} FROM pix WHERE {where} GROUP BY recording_id, frame_idx"


_PHASE = "CASE frame_idx % 5 WHEN 0 THEN -1 WHEN 2 THEN 1 ELSE 0 END AS phase"


@query(_loaded_sql(1024, "recording_id * 1000 + 1 + frame_idx / 20.0", f"{_PHASE}, CAST(frame_idx // 7 AS INTEGER) AS marker", "frame_idx >= 3 AND frame_idx < 13"))
def load_records(spark, d):
    """Files of records of fixed size, ten frames of each from the fourth on."""
    return _loaded(loaded(spark, d, "draeger", first_frame=3, max_frames=10), "phase", "marker")


@query(_loaded_sql(1024, "frame_idx / 20.0", f"{_PHASE}, frame_idx >= 7 AS qrs"))
def load_text(spark, d):
    return _loaded(loaded(spark, d, "timpel", rate=A.RATE), "phase", "qrs")


@query(_loaded_sql(64, "recording_id * 1000 + 1 + frame_idx / 20.0 - 4294.967295 * floor((recording_id * 1000 + 1) / 4294.967295)", "20.0::DOUBLE AS rate"))
def load_packets(spark, d):
    """Packets, whose times start anew after 2**32 - 1 microseconds."""
    return _loaded(loaded(spark, d, "sentec"), "rate")


@query("SELECT recording_id, frame_idx, CAST(frame_idx // 7 AS INTEGER) AS marker FROM frames WHERE frame_idx >= 7 AND frame_idx % 7 = 0")
def loaded_events(spark, d):
    """Rises of the marker, one of them at the first frame that is loaded."""
    frames = loaded(spark, d, "draeger", first_frame=7)
    return vendors.events(frames.drop("path").withColumnRenamed("recording_id", "path")).select(F.col("path").alias("recording_id"), "frame_idx", "marker")


SERIES = "whole AS (SELECT *, row_number() OVER (ORDER BY recording_id, frame_idx) - 1 AS place FROM (SELECT recording_id, frame_idx, sum(z) AS value, avg(z) AS mean FROM pix GROUP BY ALL))"


@query(f"""{SERIES}
SELECT 'global_impedance_(raw)' AS label, place AS idx, round(recording_id * 1000 + 1 + frame_idx / 20.0, 3) AS time, round(value, 4) AS value FROM whole
UNION ALL SELECT 'airway pressure', place, round(recording_id * 1000 + 1 + frame_idx / 20.0, 3), round(mean, 4) FROM whole""")
def load_sequence(spark, d):
    """All files joined as one recording: the summed signal and one that was recorded beside it."""
    found = loading.load(spark, written(spark, d, "draeger"), "draeger", label="all")
    rows = found.sequence.continuous.where("label in ('global_impedance_(raw)', 'airway pressure')")
    return rows.select("label", "idx", F.round("time", 3).alias("time"), F.round("value", 4).alias("value"))


@query(f"""{SERIES}, ph AS (SELECT place AS idx, value, CASE frame_idx % 5 WHEN 0 THEN -1 ELSE 1 END AS kind, 0 AS recording_id FROM whole WHERE frame_idx % 5 IN (0, 2)), {_alternate_sql('ph', 'alt2')}
SELECT row_number() OVER (ORDER BY middle_idx) - 1 AS breath, round(value, 4) AS value FROM
    (SELECT kind, value, idx AS middle_idx, lag(idx) OVER (ORDER BY idx) AS s, lead(idx) OVER (ORDER BY idx) AS e FROM alt2) WHERE kind = 1 AND s IS NOT NULL AND e IS NOT NULL""")
def loaded_breaths(spark, d):
    """Breaths by the device's flags over all files joined."""
    found = loading.load(spark, written(spark, d, "draeger"), "draeger", label="all").sequence.intervals
    breath = F.row_number().over(W.partitionBy("recording_id").orderBy("start_time")).cast("long") - 1
    return found.select(breath.alias("breath"), F.round("value", 4).alias("value"))
