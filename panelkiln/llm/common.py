"""What the operators of this package share: reading, folders, Arrow batches.

Intermediate tables go to the shared folder that spark.checkpoint.dir names. They
are remembered and deleted: by ``settled`` once the rows that need them are
written, all others when the driver's interpreter ends, or by ``release``.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; long texts are met by the bytes limit where Spark has it.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches that Python workers get, in rows and in bytes, and the plans' texts that the driver keeps.

    These are settings of the session and stay: what an operator returns is run after it.
    """
    spark.conf.set("spark.sql.maxPlanStringLength", "8192")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


#: Folders and tables that were made and not yet deleted, oldest first: (kind, name, session).
_made: list[tuple[str, str, SparkSession]] = []
_local: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors and the driver see.

    Where a local session has none (tests on one machine), one is made for it; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="panelkiln-shared-"))
        base = _local[0]
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    _made.append(("folder", path, spark))
    return path


def _delete(kind: str, name: str, spark: SparkSession) -> None:
    if kind == "table":
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(since: int = 0, keep: str | None = None) -> None:
    """Deletes the folders and tables made after the first ``since``, newest first; DataFrames that read them end."""
    for entry in _made[since:][::-1]:
        if entry[1] != keep:
            _delete(*entry)
            _made.remove(entry)


@atexit.register
def _at_end() -> None:
    # The session may be gone by then; what is left is the shared folder's to clear.
    with contextlib.suppress(Exception):
        release()


#: How a table of rows of some MB is written. Parquet's writer else looks at sizes after 100 rows only, and Snappy takes a page at once:
#: a task would hold all of it several times outside the heap. Sizes are looked at after each row, a row group has 8 MB and zstd streams.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.check.estimate": "false", "parquet.block.size": str(8 << 20), "compression": "zstd"}


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors. ``options``: its writer's."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame) -> DataFrame:
    """The rows in as few partitions as their bytes need: what large tasks leave of their input is else a small file each."""
    return df.hint("rebalance")


def mark() -> int:
    """How many folders and tables there are: what ``release`` and ``settled`` keep."""
    return len(_made)


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame], since: int | None = None) -> DataFrame:
    """What ``build`` returns, written; all that it wrote on the way, or all after the first ``since``, is deleted."""
    since = mark() if since is None else since
    out = build()
    path = shared_folder(spark, name)
    out.write.parquet(path)
    schema = out.schema
    release(since, keep=path)
    return spark.read.schema(schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, by: str, sort: str | None = None, mode: str = "error", lasting: bool = False) -> DataFrame:
    """The rows as a table of ``buckets`` by one column: in the shared folder and deleted later, or lasting in the warehouse."""
    spark = df.sparkSession
    out = df.write.bucketBy(buckets, by).format("parquet").option("compression", "zstd")
    if sort:
        out = out.sortBy(sort)
    if not lasting and not spark.catalog.tableExists(name):
        out = out.option("path", shared_folder(spark, name))
        _made.append(("table", name, spark))
    out.mode(mode).saveAsTable(name)
    return spark.table(name)


_labels: dict[int, list[int]] = {}


def block_labels(spark: SparkSession, buckets: int) -> list[int]:
    """For each bucket a number that bucketing by it puts there: blocks named so fill all buckets alike."""
    if buckets not in _labels:
        tried = spark.range(64 * buckets).groupBy(F.pmod(F.hash("id"), F.lit(buckets)).alias("bucket")).agg(F.min("id").alias("label"))
        # A row per bucket.
        _labels[buckets] = [r["label"] for r in tried.orderBy("bucket").collect()]
    return _labels[buckets]


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for what is planned and run within."""
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def no_broadcast(spark: SparkSession):
    """Joins within are done by the executors alone, whatever their sizes; hints still hold."""
    return setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1")


def free(name: str, *frames: DataFrame) -> str:
    """``name``, or with underscores before it, so that none of the frames has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a batch's texts, empty for null."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none holds much more than ``most`` bytes, one row at least."""
    for batch in batches:
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch with the named columns, cast to the schema."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


#: At most so many keys can each have 1/HOT of all rows.
HOT = 512


def hot_join(many: DataFrame, few: DataFrame, key: str, count: str, also: str | None = None) -> DataFrame:
    """Inner join of rows with a table that has each key once, and in ``count`` how many of the rows it has.

    Keys with 1/HOT of all rows or more, HOT at most, are broadcast; others are joined by the executors. ``also``: a second key column.
    """
    at_least = max(64, -(-many.count() // HOT))
    on = [key, also] if also else [key]
    hot = few.where(F.col(count) >= at_least)
    cold = many.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return many.join(F.broadcast(hot), on).unionByName(cold.join(few.where(F.col(count) < at_least), on))
