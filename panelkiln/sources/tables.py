"""Sources and sinks: typed CSV scans, partitioned event scans, append, upsert, resume, split, lists, manifests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkiln.functions.values import missing_to_null
from panelkiln.operators.reshape import keep_one, union_all


def read_csv(spark: SparkSession, path: str, schema: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A declared schema: one pass, no inference. Columns that aren't asked for aren't parsed."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*columns) if columns else df


def trimmed(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns without outer blanks; missing tokens are NULL."""
    return df.withColumns({c: missing_to_null(F.col(c)) for c in columns})


def read_events(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, part: str = "ym") -> DataFrame:
    """Events partitioned by month or day; the bounds prune partitions."""
    df = spark.read.parquet(path)
    if first:
        df = df.where(F.col(part) >= first)
    return df.where(F.col(part) <= last) if last else df


def query(spark: SparkSession, sql: str, **args) -> DataFrame:
    """SQL with named parameters; a DataFrame becomes a view of its name, a list an array."""
    views = {k: v for k, v in args.items() if isinstance(v, DataFrame)}
    for k, v in views.items():
        v.createOrReplaceTempView(k)
    plain = {k: F.array(*map(F.lit, v)) if isinstance(v, list | tuple) else v for k, v in args.items() if k not in views}
    return spark.sql(sql, args=plain)


class TooLarge(ValueError):
    pass


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size of what a query reads and makes; nothing runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def capped(df: DataFrame, most: int) -> DataFrame:
    """The query, refused if its estimated size is above the cap."""
    if (size := estimated_bytes(df)) > most:
        raise TooLarge(f"{size} bytes estimated; the cap is {most}")
    return df


def estimated_cost(df: DataFrame, per_tib: float = 5.0) -> tuple[int, float]:
    """(bytes, price) of a query by the optimiser's estimate; nothing runs."""
    size = estimated_bytes(df)
    return size, size / 1024**4 * per_tib


def landed_pages(pages: DataFrame, body: str, items: str, fields: dict[str, str]) -> DataFrame:
    """A row per item of landed JSON pages of an interface: ``items`` is the path of the list in a page, ``fields``
    gives each column's path in an item. Pages without the list give no rows; values are text."""
    nested = F.from_json(F.get_json_object(body, items), "array<string>")
    each = pages.select(F.explode(nested).alias("_item"))
    return each.select(*[F.get_json_object("_item", path).alias(name) for name, path in fields.items()])


def landed_advisories(pages: DataFrame, body: str = "body") -> DataFrame:
    """(advisory, package, range, summary) from landed pages of a security-advisory query."""
    node = {"advisory": "$.node.advisory.ghsaId", "package": "$.node.package.name", "range": "$.node.vulnerableVersionRange", "summary": "$.node.advisory.summary"}
    return landed_pages(pages, body, "$.securityVulnerabilities.edges", node)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(*by) if by else w).save(path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    write(df, path, fmt, "append")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def upsert(df: DataFrame, path: str, key: str) -> None:
    """Replaces the rows of the keys in ``df``, keeps the rest. The new table is complete before the old one is moved
    aside, and the old one goes last; a call after a crash in between takes up where it ended."""
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    if not exists(spark, path) and exists(spark, f"{path}.old"):
        fs.rename(place(f"{path}.old"), place(path))
    if not exists(spark, path):
        return write(df, path)
    kept = spark.read.parquet(path).join(df.select(key).distinct(), key, "left_anti")
    fresh = f"{path}.new"
    write(union_all([kept, df]).repartitionByRange(key).sortWithinPartitions(key), fresh)
    fs.delete(place(f"{path}.old"), True)
    if not (fs.rename(place(path), place(f"{path}.old")) and fs.rename(place(fresh), place(path))):
        raise OSError(f"{fresh} could not be renamed")
    fs.delete(place(f"{path}.old"), True)


def pending(todo: DataFrame, log: DataFrame, keys: Sequence[str], done: Iterable[str] = ("ok", "empty", "skipped")) -> DataFrame:
    """What has no terminal status in the log yet."""
    finished = log.where(F.lower("status").isin(*done)).select(*keys).distinct()
    return todo.join(finished, list(keys), "left_anti")


def write_list(df: DataFrame, column: str, path: str) -> None:
    """One distinct value a line, sorted."""
    df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct().orderBy("value").write.mode("overwrite").text(path)


def unique_in_order(df: DataFrame, column: str, order: Column) -> DataFrame:
    """The first row of each value, in the stated order."""
    return keep_one(df, [column], [order]).orderBy(order)


def write_split(frames: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    for name, df in frames.items():
        write(df, f"{folder}/{name}", fmt)


def read_manifest(spark: SparkSession, files: dict[str, str], schema: str, fmt: str = "csv") -> DataFrame:
    """The union of a file per panel with the panel's name; one that is missing gives a row of NULLs."""
    frames = []
    for panel, path in files.items():
        try:
            df = spark.read.schema(schema).option("header", True).format(fmt).load(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
                raise
            df = spark.createDataFrame([tuple(None for _ in spark.createDataFrame([], schema).columns)], schema)
        frames.append(df.withColumn("panel", F.lit(panel)))
    return union_all(frames)


def stem(path: str) -> str:
    return PurePosixPath(path).stem
