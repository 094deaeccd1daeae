"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: A word is a maximal run of code points other than the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: The same for DuckDB, whose regular expressions are RE2's.
SQL_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a local master that names none, as in tests, is a temporary folder made and set; elsewhere this is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="airtide-shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def workspace(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; what is there is deleted when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends there and any executor may be lost."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that a join by ``join_spread`` may broadcast.
HOT_KEYS = 10_000


def join_spread(big: DataFrame, small: DataFrame, on: list[str], count: str, *, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has a row for each key and in ``count`` how many rows of ``big`` have it.

    Keys with more than 1 / HOT_KEYS of these rows, of which there are fewer than HOT_KEYS, are broadcast, so that rows of
    a hot key stay where they are; all others are joined by shuffle. Both sides are read twice, so they should be stored.
    """
    total = small.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.col(count) > max(1, total // HOT_KEYS)
    rest = [c for c in small.columns if c not in on]
    tagged = big.join(F.broadcast(small.where(hot).select(*on, F.struct(*rest).alias("hot key"))), on, "left")
    near = tagged.where("`hot key` is not null").select(*on, *[c for c in big.columns if c not in on], *[F.col("hot key")[c].alias(c) for c in rest])
    return near.unionByName(tagged.where("`hot key` is null").drop("hot key").join(small.where(~hot), on, how))


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers by their bytes: long texts otherwise make large ones. The same for all operators."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(folds)


def word_list(text: Column) -> Column:
    """The words of a text; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def map_texts(docs: DataFrame, run: Callable[[list[str | None]], list[list]], columns: str, *, key: str, text: str) -> DataFrame:
    """(key, columns) for every row; ``run`` turns the texts of a batch into lists, one for each column. Ids pass through untouched."""
    small_batches(docs.sparkSession)
    types = list(to_arrow_schema(StructType.fromDDL(columns)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = run(batch.column(1).to_pylist())
            arrays = [pa.array(x, type=t.type) for x, t in zip(made, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, *(t.name for t in types)])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(work, f"`{key}` {kind}, {columns}")
