"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. New rows are reduced to
one candidate a digest, joined to the index by a sort-merge anti-join that
moves only the new side, and appended. Everything is DataFrame work on the
JVM. A digest that many rows share is counted before it is shuffled, and what
the index says of it is broadcast (``skew.lookup``), so that no task gets all
of its rows.

Rules. A null text counts as empty. Texts are equal when identical after
lower-casing A-Z only. Of equal texts of one ingest the row with the largest
doc_id stays, null doc_ids being the smallest; of rows that repeat both doc_id
and text, one stays. A digest that the index already holds drops every new
row. Texts are read whole, of any length; only their digests are shuffled.
Columns other than doc_id and text are not read, so clashing names are
harmless. An empty table adds nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .skew import free_name, lookup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Buckets of an index at least, and digests that one of them is to hold; one is one task of the anti-join.
BUCKETS, BUCKET_ROWS = 32, 4_000_000
#: Ingests after which the index is merged. Each adds a file to a bucket, and a bucket of several is sorted again when it is read.
MOST_WRITES = 8
#: Ingests that a whole table is put in, by falling doc_id.
INGESTS = 2


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session while the jobs inside run."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased. ``lower`` is fast and does the same where no other character has a case."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(F.encode(ascii_lower(F.coalesce(text, F.lit(""))), "UTF-8"), 256))


class DigestIndex:
    """A table (digest, keep_id, group_size, batch), bucketed and sorted by digest; made empty where it is not there."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = BUCKETS):
        if not re.fullmatch(r"\w+(\.\w+)?", table):
            raise ValueError(f"not a table name: {table}")
        self.spark, self.table, self.buckets = spark, table, buckets
        if not spark.catalog.tableExists(table):
            self._write(spark.createDataFrame([], "digest binary, keep_id long, group_size long, batch string"))

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def _write(self, entries: DataFrame) -> None:
        entries.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)

    def append(self, entries: DataFrame) -> None:
        """Adds entries whose digests are new; each bucket is written by the task that holds it."""
        self._write(entries.select("digest", "keep_id", "group_size", "batch").repartition(self.buckets, "digest"))

    def ordered(self):
        """Lets Spark see that buckets of one file are sorted, while the jobs inside are planned."""
        return _setting(self.spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    def sorts(self, entries: DataFrame) -> int:
        """Sorts in the plan of ``unseen``: one, of the new side, while each bucket of the index is one file."""
        with self.ordered():
            return len(re.findall(r"(?m)^\W*(?:\*\(\d+\) )?Sort \[", self.unseen(entries)._jdf.queryExecution().executedPlan().toString()))

    def unseen(self, entries: DataFrame) -> DataFrame:
        """Entries whose digest the index lacks: a sort-merge anti-join for which the index is not shuffled."""
        return entries.repartition(self.buckets, "digest").hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def writes(self) -> int:
        """Jobs that have written the index's files: each has left a file or more in a bucket."""
        return len({m[1] for f in self.read().inputFiles() if (m := re.search(r"/part-\d+-([0-9a-f-]{36})", f))})

    def merge(self) -> None:
        """Rewrites the index with one file a bucket, as it is after its first ingest: then Spark knows that each bucket is sorted and does not sort it again.

        The new table is made beside the old one and takes its name.
        """
        beside = f"{self.table}_{uuid.uuid4().hex}"
        # Read as plain files: a shuffle over buckets would be left out, and files split with them.
        with _setting(self.spark, "spark.sql.sources.bucketing.enabled", "false"):
            held = self.read().repartition(self.buckets, "digest")
            held.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(beside)
        self.drop()
        self.spark.sql(f"ALTER TABLE {beside} RENAME TO {self.table}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def add(self, rows: DataFrame, batch: str) -> None:
        """Appends the new digests of ``rows`` (doc_id, digest). A batch name that is in the index is not added again (a retried job)."""
        if self.read().where(F.col("batch") == batch).limit(1).count():
            return
        entries = rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).withColumn("batch", F.lit(batch))
        # Written first: the table cannot be read and appended to in one job.
        scratch = Scratch(self.spark, "digests")
        with self.ordered():
            new = scratch.keep(self.unseen(entries), "new")
        self.append(new)
        scratch.close()

    def ingest(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Adds the digests of ``docs`` that are new.

        Returns a row per input row: doc_id, digest, keep_id (of the row whose
        digest the index holds, of whatever batch), group_size (rows of ``docs``
        with the digest) and kept.
        """
        batch = batch or uuid.uuid4().hex
        rows = digests(docs)
        self.add(rows, batch)
        if self.writes() > MOST_WRITES:
            self.merge()
        return self.judge(rows, F.col("batch") == batch)

    def judge(self, rows: DataFrame, mine: Column) -> DataFrame:
        """What the index says of each of ``rows``; those of its entries that are ``mine`` were added by them."""
        sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        held = self.read().select("digest", "keep_id", mine.alias("mine"))
        found = lookup(rows, sizes.join(held, "digest").select("digest", "keep_id", "group_size", "mine"), "digest", "doc_id")
        # Of rows that repeat the kept row's doc_id and text the first stays.
        named = F.col("mine") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
        return found.withColumn("kept", named & (F.col("copy") == 0)).select("doc_id", "digest", "keep_id", "group_size", "kept")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, copy) as a written table; copy counts the rows that repeat doc_id and text, from 0."""
    rows = docs.select(F.col("doc_id").cast("long"), text_digest(F.col("text")).alias("digest"))
    scratch = Scratch(docs.sparkSession, "digests")
    counted = scratch.keep(rows, "texts").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    each = counted.select("doc_id", "digest", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"))
    rows = scratch.keep(each, "rows")
    scratch.drop("texts")
    return rows


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Without an index, one of its own is filled in ``INGESTS`` batches by falling
    doc_id, so that the row that a later batch meets in the index is that with
    the larger doc_id, and dropped in the end.
    """
    if index is not None:
        out = index.ingest(docs)
        return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    spark, rows = docs.sparkSession, digests(docs)
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", max(BUCKETS, -(-rows.count() // BUCKET_ROWS)))
    try:
        shares = [k / INGESTS for k in range(1, INGESTS)]
        cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), F.lit(100))).first()[0] or ()), reverse=True)
        for k, (upper, lower) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
            part = rows if upper is None else rows.where((F.col("doc_id") < upper) | F.col("doc_id").isNull())
            index.add(part if lower is None else part.where(F.col("doc_id") >= lower), f"batch-{k}")
        out = index.judge(rows, F.lit(True)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
        return Scratch(spark, "digests").keep(out, "judged")
    finally:
        index.drop()


def keep_one(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest doc_id; columns as they are.

    Rows that repeat doc_id and text are alike in what the operator reads; one of them stays.
    """
    name = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit(""))
    by = [free_name("_kept_name", docs), free_name("_kept_digest", docs)]
    kept = exact_dedup(docs, index).where("kept").select(name(F.col("doc_id")).alias(by[0]), F.unhex("text_sha256").alias(by[1]))
    rows = docs.withColumns({by[0]: name(docs["doc_id"]), by[1]: text_digest(docs["text"])})
    # Repeats go by the keys of the join, so they cost no shuffle of their own.
    return rows.join(kept, by, "left_semi").dropDuplicates(by).select(docs.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
