"""Exact dedup by a persistent digest index, in DataFrame operations only.

The index is a table with one row per distinct text, bucketed and sorted by the
SHA-256 of the text without ASCII white space. Documents come in batches. A batch
is digested and collapsed to one row per digest (partial sums before the
shuffle), and that is bucketed alike, so that it meets the index bucket by bucket
with nothing shuffled: a sort-merge anti-join finds the digests that are new,
which are appended to the index; what it knew already goes to a second table of
the same buckets, a row per digest and batch, with that batch's best document and
number of rows. ``entries`` adds the two up, so group sizes and the document that
stays are right after any number of batches and in whatever order they came.

``exact_groups`` passes its documents through the index in batches too, dealt by a
hash of the id.

Null texts count as empty; empty texts are equal to each other. A null id loses
every tie. Rows that repeat both id and text are one document: the first copy
stays, the others are dropped. Columns of any name pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkiln.llm.common import bucketed, free, partitions, text_of, written

#: Deleted before texts are compared: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"
#: A digest with at least this share of all rows is hot; so there are at most HOT of them.
HOT = 512


def digest(text: Column) -> Column:
    return F.sha2(F.regexp_replace(text, BLANKS, ""), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, chars) of each row."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("id"), digest(text).alias("digest"), F.char_length(text).cast("long").alias("chars"))


def grouped(marks: DataFrame) -> DataFrame:
    """One row per digest: the id that stays, its length and the number of rows.

    The largest (chars, -id) wins: most code points, then the smallest id.
    """
    best = F.max(F.struct("chars", (-F.col("id")).alias("neg"))).alias("best")
    return marks.groupBy("digest").agg(best, F.count("*").alias("group_size")).select("digest", (-F.col("best.neg")).alias("keep_id"), F.col("best.chars").alias("keep_chars"), "group_size")


def _best(chars: str = "keep_chars", keep: str = "keep_id") -> Column:
    return F.struct(F.col(chars).alias("chars"), (-F.col(keep)).alias("neg"))


class DigestIndex:
    """Bucketed tables: (digest, keep_id, keep_chars, group_size) of each digest as first met, and the same of what
    later batches brought of known ones (``name``_more). An index with a name lasts, one without goes with the session."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.lasting = name is not None
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.more = f"{self.name}_more"
        self.buckets = buckets or partitions(spark)

    def exists(self, name: str | None = None) -> bool:
        return self.spark.catalog.tableExists(name or self.name)

    def table(self) -> DataFrame:
        """A row per digest, as first met."""
        return self.spark.table(self.name)

    def entries(self) -> DataFrame:
        """A row per digest over all batches. Both tables are read in place."""
        first = self.table()
        if not self.exists(self.more):
            return first
        later = self.spark.table(self.more).groupBy("digest").agg(F.max(_best()).alias("later"), F.sum("group_size").alias("n"))
        best = F.greatest(_best(), F.col("later"))
        size = F.col("group_size") + F.coalesce("n", F.lit(0))
        both = first.join(later.hint("merge"), "digest", "left").select("digest", best.alias("best"), size.alias("group_size"))
        return both.select("digest", (-F.col("best.neg")).alias("keep_id"), F.col("best.chars").alias("keep_chars"), "group_size")

    def fresh(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index lacks: a sort-merge anti-join on the buckets."""
        return groups.join(self.table().hint("merge").select("digest"), "digest", "left_anti") if self.exists() else groups

    def append(self, marks: DataFrame) -> None:
        """Takes up a batch of (id, digest, chars). Each task writes the one bucket that it holds."""
        groups = grouped(marks).repartition(self.buckets, "digest")
        if not self.exists():
            bucketed(groups, self.name, self.buckets, "digest", "digest", lasting=self.lasting)
            return
        groups = bucketed(groups, f"digest_batch_{uuid.uuid4().hex}", self.buckets, "digest", "digest")
        known = groups.join(self.table().hint("merge").select("digest"), "digest", "left_semi")
        bucketed(known, self.more, self.buckets, "digest", "digest", "append", self.lasting)
        # A table can't be read and appended to by one job.
        new = bucketed(self.fresh(groups), f"digest_new_{uuid.uuid4().hex}", self.buckets, "digest", "digest")
        bucketed(new, self.name, self.buckets, "digest", "digest", "append", self.lasting)

    def resolve(self, marks: DataFrame) -> DataFrame:
        """Each row of ``marks`` with keep_id and group_size.

        Hot digests (each has 1/HOT of all rows or more, so there are at most HOT
        of them) are looked up by a broadcast of that bounded set; all others are
        joined bucket by bucket.
        """
        index = self.entries().select("digest", "keep_id", "keep_chars", "group_size")
        at_least = max(64, -(-(index.agg(F.sum("group_size")).first()[0] or 0) // HOT))
        hot = written(index.where(F.col("group_size") >= at_least), "digest-hot")
        cold = marks.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
        return marks.join(F.broadcast(hot), "digest").unionByName(cold.join(index.hint("merge"), "digest"))

    def drop(self) -> None:
        for name in (self.name, self.more):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def repeats_ids(marks: DataFrame) -> bool:
    """Whether an id has several rows (one job over the ids alone)."""
    return bool(marks.groupBy("id").count().where("count > 1").take(1))


def exact_groups(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row; keep_id and group_size are those of the whole index.

    The documents pass through the index in ``batches`` parts; the result is the same for any number.
    """
    index = index or DigestIndex(docs.sparkSession)
    marks = written(digests(docs), "digests")
    for k in range(batches):
        index.append(marks.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k))
    found = index.resolve(marks)
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    if repeats_ids(marks):
        first = F.row_number().over(Window.partitionBy("digest", "id").orderBy(F.desc("chars")))
        found = found.withColumn("nth", first)
        kept &= F.col("nth") == 1
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The documents that stay, with all their columns."""
    own_id, own, seen, nth = (free(x, docs) for x in ("_id", "_digest", "_seen", "_nth"))
    keep = exact_groups(docs, index).where("kept").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own))
    marked = docs.withColumn(seen, digest(text_of()))
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(seen) == F.col(own))
    out = marked.join(keep, same, "left_semi")
    if repeats_ids(docs.select(F.col("doc_id").alias("id"))):
        # One of the rows that repeat id and text; the longest text where only blanks differ.
        first = F.row_number().over(Window.partitionBy("doc_id", seen).orderBy(F.desc(F.char_length(text_of()))))
        out = out.withColumn(nth, first).where(F.col(nth) == 1).drop(nth)
    return out.drop(seen)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, first(doc_id ORDER BY chars DESC, doc_id) AS keep_id, count(*) AS group_size
  FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
