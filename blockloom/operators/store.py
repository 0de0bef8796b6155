"""An append-only store of raw and typed tables with one visibility log.

Tables are Parquet, partitioned by chain, height bucket and write. Nothing is
updated in place. Each attempt to write a batch has a ``write_id`` of its own,
and a row of the commit log names it: files of attempts that died are named by
no row and stay invisible, whatever numbers later batches get. Other rows of
the log hide what came before them: a rollback all rows of a chain from a
height upward, a replace or a compaction those of one table in a range. A
batch's rows of the log are one file that appears at once, after its data, so
a reader sees whole batches or none.

The log (``commit_log``) grows with batches, not rows, and is joined by
``write_id`` only; any number of writers share it. Schemas of tables are rows
of the log too, so that no file is opened to learn them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Entry
from ..files import Files
from ..scratch import tidy
from . import evolve, reads
from .commit_log import ATTEMPTS, CommitLog, Conflict

#: Heights of a bucket.
BUCKET = 100_000
KEY = ["chain_id", "height", "idx"]
#: Live writes of a chain's table from which ``maintain`` makes one.
MOST_WRITES = 256
#: Spans that a scan names one by one; of more, one a chain.
SCANNED = 64
Range = tuple[int, int, int]  # chain_id, from_height, to_height
_RANGE = pa.schema([(c, pa.int64()) for c in ("chain_id", "lo", "hi")])


# --- rules over tables ------------------------------------------------------


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key: the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key: the last in order (an upsert, read back)."""
    return first_wins(rows, key, [F.desc(c) if isinstance(c, str) else c.desc() for c in order])


def insert_if_absent(batch: DataFrame, visible: DataFrame, key: list[str], order: list) -> DataFrame:
    """Rows of a batch to append: each key once, and none that is visible.

    The stored side is read by key columns only; give it pruned to the batch's buckets.
    """
    return first_wins(batch, key, order).join(visible.select(*key), key, "left_anti")


def union_optional(frames: list[DataFrame]) -> DataFrame:
    """Batches whose column sets vary; a missing optional column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_cut(entries: DataFrame, commits: DataFrame) -> DataFrame:
    """Adds cut to rows of the log: the lowest height that a later rollback of their chain took away; null if none.

    A window over rows of the log of one chain.
    """
    later = Window.partitionBy("chain_id").orderBy(F.desc("commit_seq")).rangeBetween(Window.unboundedPreceding, -1)
    back = commits.where("kind = 'rollback'").select("chain_id", "commit_seq", F.col("from_height").alias("_f"))
    both = entries.withColumn("_own", F.lit(True)).unionByName(back, allowMissingColumns=True)
    return both.withColumn("cut", F.min("_f").over(later)).where("_own").drop("_f", "_own")


def live_writes(commits: DataFrame, table: str) -> DataFrame:
    """(chain_id, write_id, seq, cut, gone) of the committed writes of a table.

    From cut upward its rows were rolled back; gone are the ranges that later replaces or compactions hold instead.
    """
    own = F.col("table").isNull() | (F.col("table") == table)
    named = commits.where(F.col("kind").isin("ingest", "decode", "replace", "compact") & F.col("write_id").isNotNull() & own)
    writes = named.groupBy("chain_id", "write_id").agg(F.max("commit_seq").alias("commit_seq"), F.min("from_height").alias("lo"), F.max("to_height").alias("hi"))
    writes = with_cut(writes, commits).where("cut IS NULL OR lo < cut")
    # A compaction holds what was there up to its own number, a replace what was there before it.
    over = commits.where(F.col("kind").isin("replace", "compact") & (F.col("table") == table))
    over = over.select("chain_id", F.col("write_id").alias("by"), F.col("from_height").alias("o_lo"), F.col("to_height").alias("o_hi"), F.when(F.col("kind") == "compact", F.col("commit_seq")).otherwise(F.col("commit_seq") - 1).alias("upto"))
    covered = (writes["chain_id"] == over["chain_id"]) & (writes["write_id"] != over["by"]) & (writes["commit_seq"] <= over["upto"]) & (writes["lo"] <= over["o_hi"]) & (writes["hi"] >= over["o_lo"])
    whole = F.max((F.col("o_lo") <= writes["lo"]) & (F.col("o_hi") >= writes["hi"]))
    gone = writes.join(over, covered).groupBy(writes["chain_id"], writes["write_id"]).agg(F.collect_list(F.struct("o_lo", "o_hi")).alias("gone"), whole.alias("whole"))
    return writes.join(gone, ["chain_id", "write_id"], "left").where("whole IS NULL OR NOT whole").select("chain_id", "write_id", F.col("commit_seq").alias("seq"), "cut", "gone")


def folded(commits: DataFrame) -> DataFrame:
    """The log without rows of tables' writes of which nothing is shown any more: rolled back whole, or replaced or compacted since.

    What such a row would hide is hidden by what hides the row itself, so nothing
    comes back. Ranges that were landed and decoded, rollbacks and schemas stay.
    """
    key = ["chain_id", "write_id", "table"]
    of_table = commits.where("write_id IS NOT NULL AND table IS NOT NULL")
    named = of_table.where(F.col("kind").isin("decode", "replace", "compact"))
    writes = named.groupBy(*key).agg(F.max("commit_seq").alias("commit_seq"), F.min("from_height").alias("lo"), F.max("to_height").alias("hi"))
    writes = with_cut(writes, commits).where("cut IS NULL OR lo < cut").drop("cut")
    over = named.where("kind <> 'decode'").select("chain_id", "table", F.col("write_id").alias("by"), F.col("from_height").alias("o_lo"), F.col("to_height").alias("o_hi"), F.when(F.col("kind") == "compact", F.col("commit_seq")).otherwise(F.col("commit_seq") - 1).alias("upto"))
    hidden = (writes["chain_id"] == over["chain_id"]) & (writes["table"] == over["table"]) & (writes["write_id"] != over["by"]) & (writes["commit_seq"] <= over["upto"]) & (over["o_lo"] <= writes["lo"]) & (over["o_hi"] >= writes["hi"])
    shown = writes.join(over, hidden, "left_anti").select(*key)
    return commits.where("write_id IS NULL OR table IS NULL").unionByName(of_table.join(shown, key, "left_semi").select(commits.columns))


def visible(rows: DataFrame, commits: DataFrame, table: str) -> DataFrame:
    """Rows of committed writes that nothing later hides, with the write's seq. ``rows`` have chain_id, height and write_id."""
    hidden = F.exists("gone", lambda g: F.col("height").between(g["o_lo"], g["o_hi"]))
    shown = (F.col("cut").isNull() | (F.col("height") < F.col("cut"))) & ~F.coalesce(hidden, F.lit(False))
    return rows.join(live_writes(commits, table), ["chain_id", "write_id"]).where(shown).select(*rows.columns, "seq")


def shown(commits: DataFrame, table: str, ranges: Sequence[Range]) -> bool:
    """Whether a committed write of a table can have visible rows in some ranges, by the log alone. A row a chain comes to the driver."""
    writes = live_writes(commits, table).select("chain_id", "write_id", "cut")
    named = commits.where(F.col("table").isNull() | (F.col("table") == table)).join(writes, ["chain_id", "write_id"])
    held = named.select("chain_id", F.coalesce("from_height", F.lit(0)).alias("a"), F.coalesce(F.least("to_height", F.col("cut") - 1), F.lit(1 << 62)).alias("b"))
    hulls = [F.max((F.col("chain_id") == c) & (F.col("a") <= hi) & (F.col("b") >= lo)) for c, lo, hi in _hull(ranges)]
    return any(held.agg(*hulls).first())


def delete_from_height(rows: DataFrame, chain_id: int, from_height: int) -> DataFrame:
    """What a compaction keeps when a chain is rolled back."""
    return rows.where((F.col("chain_id") != chain_id) | (F.col("height") < from_height))


def clip_ranges(commits: DataFrame) -> DataFrame:
    """Ingested ranges with what later rollbacks took off their ends; those that they took whole are gone."""
    ranges = commits.where("kind = 'ingest'").select("chain_id", "commit_seq", F.col("from_height").alias("lo"), F.col("to_height").alias("hi"), F.col("last_height").alias("best_height"), F.col("last_hash").alias("best_hash"), "rows")
    cut = with_cut(ranges, commits).withColumn("hi", F.least("hi", F.coalesce(F.col("cut") - 1, F.col("hi")))).where("lo <= hi")
    above = F.col("best_height") > F.col("hi")
    return cut.select("chain_id", "commit_seq", "lo", "hi", F.when(~above, F.col("best_height")).alias("best_height"), F.when(~above, F.col("best_hash")).alias("best_hash"), "rows")


def _reach(ranges: DataFrame, start: DataFrame | None) -> DataFrame:
    """Ranges in order with the end of what comes before them in their chain."""
    if start is not None:
        ranges = ranges.join(start, "chain_id")
    else:
        ranges = ranges.withColumn("start", F.min("lo").over(Window.partitionBy("chain_id")))
    before = Window.partitionBy("chain_id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("reach", F.greatest(F.coalesce(F.max("hi").over(before), F.col("start") - 1), F.col("start") - 1))


def contiguous_prefix(ranges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """The cursor of each chain: (chain_id, last_height, last_hash).

    The gap-free run of ranges from the start block ends at last_height; the
    hash is that of the highest matched block in the run, empty if none, of
    equal heights the later range's. ``start`` is (chain_id, start), else each
    chain starts at its lowest range. A window over ranges, of one chain each.
    """
    ordered = _reach(ranges, start).withColumn("gap", (F.col("lo") > F.col("reach") + 1).cast("int"))
    upto = Window.partitionBy("chain_id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, 0)
    run = ordered.withColumn("broken", F.max("gap").over(upto)).where("broken = 0")
    best = F.max_by("best_hash", F.when(F.col("best_height").isNotNull(), F.struct("best_height", "lo", "hi")))
    return run.groupBy("chain_id").agg(F.max("hi").alias("last_height"), F.coalesce(best, F.unhex(F.lit(""))).alias("last_hash"))


def range_gaps(ranges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """Uncovered (chain_id, lo, hi) between the start and the highest range."""
    return _reach(ranges, start).where("lo > reach + 1").select("chain_id", (F.col("reach") + 1).alias("gap_lo"), (F.col("lo") - 1).alias("gap_hi"))


def uncovered(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """(chain_id, lo, hi): what of the spans (chain_id, next, target) no range covers."""
    starts = spans.select("chain_id", F.col("next").alias("start"))
    ends = spans.select("chain_id", (F.col("target") + 1).alias("lo"), (F.col("target") + 1).alias("hi"))
    gaps = range_gaps(ranges.select("chain_id", "lo", "hi").unionByName(ends), starts)
    within = gaps.join(spans, "chain_id").where("gap_lo <= target")
    return within.select("chain_id", F.col("gap_lo").alias("lo"), F.least("gap_hi", "target").alias("hi"))


def covered(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """(chain_id, lo, hi): what of disjoint spans (chain_id, lo, hi) the ranges cover, in runs without a gap. A window over the ranges within a span."""
    parts = ranges.select("chain_id", F.col("lo").alias("_a"), F.col("hi").alias("_b")).join(spans, "chain_id").where("_a <= hi AND _b >= lo")
    cut = parts.select("chain_id", F.col("lo").alias("_span"), F.greatest("_a", "lo").alias("lo"), F.least("_b", "hi").alias("hi")).distinct()
    by = Window.partitionBy("chain_id", "_span").orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum((F.col("lo") > F.col("_before") + 1).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    runs = cut.withColumn("_before", F.coalesce(before, F.col("hi"))).withColumn("_run", F.coalesce(run, F.lit(0)))
    return runs.groupBy("chain_id", "_span", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("chain_id", "lo", "hi")


def decode_backlog(commits: DataFrame) -> DataFrame:
    """Ingested ranges with rows that were not decoded: (chain_id, from_height, to_height, commit_seq, latest), each once.

    commit_seq is the number of the first ingest of the range, latest that of the last.

    A range ends where a later rollback cut it. Only the marker of table ``*``
    says that a range is decoded, and only if it came after the last ingest of
    the range: rows that were landed again are decoded again.
    """
    key = ["chain_id", "from_height", "to_height"]
    ranges = clip_ranges(commits).where("rows > 0").select("chain_id", F.col("lo").alias("from_height"), F.col("hi").alias("to_height"), "commit_seq")
    ranges = ranges.groupBy(*key).agg(F.min("commit_seq").alias("commit_seq"), F.max("commit_seq").alias("latest"))
    done = commits.where("kind = 'decode' AND table = '*'").select("chain_id", "from_height", F.col("to_height").alias("d_to"), F.col("commit_seq").alias("d_seq"))
    found = (ranges["chain_id"] == done["chain_id"]) & (ranges["from_height"] == done["from_height"]) & (done["d_to"] >= ranges["to_height"]) & (done["d_seq"] > ranges["latest"])
    return ranges.join(done, found, "left_anti")


def late_headers(commits: DataFrame) -> DataFrame:
    """(chain_id, from_height, to_height, commit_seq) of headers that came after their rows were landed and have not been put on decoded rows yet."""
    late = with_cut(commits.where("kind = 'late'").select("chain_id", "from_height", "to_height", "commit_seq"), commits).where("cut IS NULL OR from_height < cut").drop("cut")
    done = commits.where("kind = 'decode' AND table = '*'").select("chain_id", F.col("from_height").alias("d_from"), F.col("to_height").alias("d_to"), F.col("commit_seq").alias("d_seq"))
    found = (late["chain_id"] == done["chain_id"]) & (late["from_height"] >= done["d_from"]) & (late["to_height"] <= done["d_to"]) & (done["d_seq"] > late["commit_seq"])
    return late.join(done, found, "left_anti").groupBy("chain_id", "from_height", "to_height").agg(F.max("commit_seq").alias("commit_seq"))


def oldest_pending(backlog: DataFrame) -> DataFrame:
    """Depth and the oldest pending range of each chain."""
    oldest = F.min_by(F.struct("from_height", "to_height"), "commit_seq")
    return backlog.groupBy("chain_id").agg(F.count(F.lit(1)).alias("depth"), oldest.alias("o")).select("chain_id", "depth", "o.from_height", "o.to_height")


def highest(blocks: DataFrame) -> DataFrame:
    """(chain_id, height, hash) of each chain's highest block."""
    return blocks.groupBy("chain_id").agg(F.max_by(F.struct("height", "hash"), "height").alias("b")).select("chain_id", "b.height", "b.hash")


def fanout_counts(rows: DataFrame) -> DataFrame:
    """Decoded rows by chain and target table."""
    return rows.groupBy("chain_id", "table").agg(F.count(F.lit(1)).alias("n"))


def orphan_receipts(receipts: DataFrame, transactions: DataFrame) -> DataFrame:
    return receipts.join(transactions.select("chain_id", "tx_id"), ["chain_id", "tx_id"], "left_anti")


def first_tx_location(logs: DataFrame) -> DataFrame:
    """(chain_id, tx_id, height, idx) of each transaction's first log."""
    first = F.min(F.struct("height", "idx"))
    return logs.groupBy("chain_id", "tx_id").agg(first.alias("at")).select("chain_id", "tx_id", "at.height", "at.idx")


def _hull(ranges: Sequence[Range]) -> list[Range]:
    """One range a chain that holds all of its."""
    chains: dict[int, list[int]] = {}
    for c, lo, hi in ranges:
        chains.setdefault(c, []).extend((lo, hi))
    return [(c, min(ends), max(ends)) for c, ends in chains.items()]


# --- the store on disk ------------------------------------------------------


@dataclass(frozen=True)
class State:
    """What a job works on: the last number of the log, its rows, the number of the job's batch if that is committed, and the tables' schemas."""

    number: int
    commits: DataFrame
    done: int | None
    schemas: dict[str, T.StructType]


def _write_id() -> str:
    return uuid.uuid4().hex


class Store:
    """The tables and the commit log under one folder of a shared file system."""

    def __init__(self, spark: SparkSession, root: str, bucket: int = BUCKET):
        self.spark, self.root, self.bucket = spark, root.rstrip("/"), bucket
        self.files, self.log = Files(spark), CommitLog(spark, self.root, fold=folded)

    # the log

    def commits(self) -> DataFrame:
        """All rows of the log."""
        return self.log.read()[1]

    def _commit(self, batch_id: str, make: Callable[[State], list[dict]]) -> tuple[int, bool]:
        """Commits what ``make`` does on the state as it is; again on a newer one where another writer was in the way.

        Returns the batch's number, and whether it was committed here. What lost attempts have written stays invisible.
        """
        for _ in range(ATTEMPTS):
            state = self._state(batch_id)
            if state.done is not None:
                return state.done, False
            rows = make(state)
            if not rows:
                return state.number, False
            try:
                return self.log.append(batch_id, rows, state.number), True
            except Conflict:
                continue
        raise Conflict(batch_id)

    def _state(self, batch_id: str = "") -> State:
        number, commits = self.log.read()
        held = self.log.named(batch_id)  # a row a change of a table
        return State(number, commits, next((r["commit_seq"] for r in held if r["batch_id"] == batch_id), None), self._schemas(held))

    @staticmethod
    def _schemas(rows) -> dict[str, T.StructType]:
        out: dict[str, T.StructType] = {}
        for r in rows:
            if r["kind"] == "schema":
                have = out.get(r["table"], T.StructType())
                more = T.StructType.fromJson(json.loads(r["detail"]))
                out[r["table"]] = T.StructType([*have.fields, *(f for f in more.fields if f.name not in have.names)])
        return out

    def schemas(self) -> dict[str, T.StructType]:
        """Tables and their columns, without those of the layout."""
        return self._state().schemas

    def has(self, table: str) -> bool:
        return table in self.schemas()

    # tables

    def _slices(self, ranges: Sequence[Range]) -> int:
        """Slices by which a bucket of some ranges is dealt: one where there are more buckets than tasks of a shuffle."""
        buckets = sum(hi // self.bucket - lo // self.bucket + 1 for _, lo, hi in ranges)
        return max(1, min(evolve.SLICES, self._tasks() // max(1, buckets)))

    def _tasks(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _once(self, rows: DataFrame, key: list[str], order: list, ranges: Sequence[Range]) -> DataFrame:
        """One row of each key (chain_id, height and more), the first in order, dealt as it is written: the rows are shuffled once."""
        return first_wins(held := evolve.dealt(rows, self.bucket, self._slices(ranges)), list(dict.fromkeys([*evolve.dealt_by(held), *key])), order)

    def _write(self, table: str, rows: DataFrame, write_id: str, schemas: dict[str, T.StructType], entry: Entry | None = None, slices: int = evolve.SLICES) -> list[dict]:
        """The files of a write; returns rows of the log for columns that the table gets with it. A changed type is refused."""
        if entry is not None:
            rows = evolve.with_bits(rows, evolve.wide_columns(entry))
        added = evolve.additions(schemas.get(table), rows.drop("hb", "_slice").schema)
        with tidy(self.spark):
            evolve.lay_out(rows.withColumn("write_id", F.lit(write_id)), f"{self.root}/{table}", self.bucket, [p.column for p in entry.params if p.indexed] if entry else (), ["write_id"], "append", slices)
        schemas[table] = T.StructType([*schemas.get(table, T.StructType()).fields, *added])
        return [{"kind": "schema", "table": table, "detail": T.StructType(added).json()}] if added else []

    def _bucket_rows(self, table: str, write_id: str, schemas: dict[str, T.StructType], indexed: Sequence[str]) -> list[dict]:
        """Rows of the log that say how many rows a write has in each bucket, and of which columns it has an index.

        The index has the values of a column and the buckets that hold them, in
        order of the value, so that a scan for a value or a range opens few
        parts of it. It grows with distinct values by bucket.
        """
        rows, bucket = self._written(table, write_id, schemas), F.floor(F.col("height") / self.bucket).cast("bigint").alias("bucket")
        if indexed:
            keys = [rows.select("chain_id", F.lit(c).alias("column"), reads.index_key(F.col(c), schemas[table][c].dataType).alias("key"), bucket) for c in indexed]
            held = reduce(DataFrame.unionByName, keys).where("key IS NOT NULL").distinct()
            held = held.repartitionByRange("chain_id", "column", "key").sortWithinPartitions("chain_id", "column", "key").withColumn("write_id", F.lit(write_id))
            held.write.mode("append").partitionBy("chain_id", "column", "write_id").parquet(f"{self.root}/{table}__index")
        counted = rows.groupBy("chain_id", bucket).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a bucket
        at = lambda r: {"from_height": r["bucket"] * self.bucket, "to_height": (r["bucket"] + 1) * self.bucket - 1}
        return [{"kind": "bucket", "write_id": write_id, "table": table, "chain_id": r["chain_id"], **at(r), "rows": r["n"], "detail": json.dumps(list(indexed))} for r in counted]

    def buckets(self, table: str, entry: Entry | None = None, spec: reads.QuerySpec | None = None) -> list[tuple[int, int]]:
        """(bucket, rows) of a table, ascending: as many rows at least as are visible there, and none where there is no bucket.

        With a request, of its chain and heights only, and of buckets that the
        index says to hold what it asks for.
        """
        state = self._state()
        named = state.commits.where((F.col("kind") == "bucket") & (F.col("table") == table)).select("chain_id", "write_id", F.expr(f"from_height div {self.bucket}").alias("bucket"), "from_height", "rows", "detail")
        live = named.join(live_writes(state.commits, table), ["chain_id", "write_id"]).where("cut IS NULL OR from_height < cut")
        if spec is not None:
            lo, hi = reads.height_bounds(spec)
            for bound, keep in ((spec.chain_id, F.col("chain_id") == spec.chain_id), (lo, F.col("bucket") >= (lo or 0) // self.bucket), (hi, F.col("bucket") <= (hi or 0) // self.bucket)):
                live = live.where(keep) if bound is not None else live
            columns, path = reads.columns_of(entry), f"{self.root}/{table}__index"
            for f in spec.filters if self.files.exists(path) else ():
                if f.op not in ("NE", "NEQ") and f.column in {p.column for p in entry.params if p.indexed}:
                    key = reads.index_key(F.col("key"), T.BinaryType())
                    wanted = reads.compare(key, f.op, reads.index_key(reads.literal(f.value, columns[f.column]), state.schemas[table][f.column].dataType))
                    index = self.spark.read.schema("key binary, bucket long, chain_id long, column string, write_id string").option("basePath", path).parquet(path)
                    held = index.where((F.col("column") == f.column) & wanted).select("chain_id", "write_id", "bucket").distinct().withColumn("holds", F.lit(True))
                    unindexed = ~F.array_contains(F.from_json("detail", "array<string>"), f.column)
                    live = live.join(held, ["chain_id", "write_id", "bucket"], "left").where(F.col("holds") | unindexed).drop("holds")
        return [(r["bucket"], r["n"]) for r in live.groupBy("bucket").agg(F.sum("rows").alias("n")).orderBy("bucket").collect()]  # a row a bucket

    def _scan(self, table: str, schema: T.StructType, spans: Sequence[tuple[int, int | None, int | None]] = ()) -> DataFrame:
        """All rows of a table's files with write_id; of the spans (chain_id, lo, hi) only, if given, by folder and bucket."""
        path = f"{self.root}/{table}"
        full = T.StructType([*schema.fields, T.StructField("hb", T.LongType()), T.StructField("write_id", T.StringType())])
        paths = [f"{path}/chain_id={c}" for c in {c for c, _, _ in spans}] if spans else [path]
        paths = [p for p in paths if self.files.exists(p)]
        if not paths:
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).option("basePath", path).parquet(*paths).select(full.names)
        if spans:
            rows = rows.where(reduce(or_, ((F.col("chain_id") == c) & evolve.bucket_filter(self.bucket, lo, hi) for c, lo, hi in spans)))
        return rows

    def read(self, table: str, chain_id: int | None = None, lo: int | None = None, hi: int | None = None, bits: bool = False, buckets: Sequence[int] | None = None) -> DataFrame:
        """Visible rows, of a chain and heights, and of some buckets only, if given; ``bits`` keeps the columns that help filters on wide integers."""
        state = self._state()
        if (schema := state.schemas.get(table)) is None:
            raise ValueError(f"no table {table}")
        rows = self._scan(table, schema, [(chain_id, lo, hi)] if chain_id is not None else ())
        if chain_id is None:
            rows = rows.where(evolve.bucket_filter(self.bucket, lo, hi))
        if buckets is not None:
            rows = rows.where(F.col("hb").isin(list(buckets)))
        return visible(rows, state.commits, table).select([c for c in schema.names if bits or not evolve.is_bits(c, schema)])

    def evolve(self, entry: Entry, dry_run: bool = False) -> list[evolve.Change]:
        """What brings a typed table to its catalog entry; additions take effect at once, anything else is refused.

        Rows written before have null in added columns until a resync replaces them.
        """
        wanted, changes = evolve.stored_schema(entry), []

        def make(state: State) -> list[dict]:
            changes[:] = evolve.diff(state.schemas.get(entry.table), wanted)
            if dry_run or not changes:
                return []
            return [{"kind": "schema", "table": entry.table, "detail": T.StructType(evolve.additions(state.schemas.get(entry.table), wanted)).json()}]

        self._commit(f"schema-{entry.table}-{_write_id()}", make)
        return changes

    def _ranges(self, ranges: Sequence[Range]) -> DataFrame:
        """The ranges by height bucket: (chain_id, hb, lo, hi)."""
        # A local table, which Spark broadcasts while it is small.
        frame = self.spark.createDataFrame(pa.table(dict(zip(("chain_id", "lo", "hi"), map(list, zip(*ranges)))), schema=_RANGE))
        buckets = F.sequence(F.floor(F.col("lo") / self.bucket), F.floor(F.col("hi") / self.bucket))
        return frame.select("chain_id", F.explode(buckets).alias("hb"), "lo", "hi")

    def spans_of(self, ranges: Sequence[Range]) -> list[Range]:
        """The ranges, of which those that touch the same or the next bucket are one: no bucket between two far apart is read."""
        out: list[Range] = []
        for c, lo, hi in sorted(ranges):
            if out and out[-1][0] == c and lo // self.bucket <= out[-1][2] // self.bucket + 1:
                out[-1] = (c, out[-1][1], max(hi, out[-1][2]))
            else:
                out.append((c, lo, hi))
        return out if len(out) <= SCANNED else _hull(ranges)

    def _inside(self, rows: DataFrame, ranges: DataFrame, how: str = "left_semi") -> DataFrame:
        keyed = rows.withColumn("_hb", F.floor(F.col("height") / self.bucket))
        on = (keyed["chain_id"] == ranges["chain_id"]) & (keyed["_hb"] == ranges["hb"]) & keyed["height"].between(ranges["lo"], ranges["hi"])
        if how == "left_semi":
            return keyed.join(ranges, on, how).drop("_hb")
        return keyed.join(ranges, on, how).select(*(keyed[c] for c in rows.columns), ranges["lo"], ranges["hi"])

    def ingest_ranges(self, batch_id: str, ranges: Sequence[Range], logs: DataFrame, blocks: DataFrame, aux: dict[str, DataFrame] | None = None, settles: str | None = None) -> int:
        """Lands disjoint ranges in one write: raw logs (first wins), blocks (last wins on read), transactions, receipts last.

        The log gets a row a range, with or without rows of data, so that the
        cursor moves over ranges in which nothing matched. Rows outside the
        ranges are left. A batch that is committed is not landed again. Rows of
        the ranges in the table that it ``settles`` are hidden from then on.
        """
        spans = self._ranges(ranges)
        landed, slices = self._inside(logs, spans), self._slices(ranges)
        said = [F.desc(c) for c in ("arrived", "time", "hash") if c in blocks.columns]
        frames = {"blocks": self._once(self._inside(blocks, spans), ["chain_id", "height"], said, ranges).drop("arrived")}
        frames |= {name: first_wins(self._inside(aux[name], spans), ["chain_id", "tx_id"], [c for c in ("height", "block_hash") if c in aux[name].columns]) for name in ("transactions", "receipts") if aux and name in aux}

        def make(state: State) -> list[dict]:
            write_id, schemas, fresh = _write_id(), dict(state.schemas), landed
            if "raw_records" in schemas and shown(state.commits, "raw_records", ranges):
                held = visible(self._scan("raw_records", schemas["raw_records"], _hull(ranges)), state.commits, "raw_records")
                fresh = fresh.join(held.select(*KEY), KEY, "left_anti")
            fresh = self._once(fresh, KEY, ["tx_id"], ranges)
            log = [row for name, rows in {"raw_records": fresh, **frames}.items() for row in self._write(name, rows, write_id, schemas, slices=slices)]
            counts = self._written("raw_records", write_id, schemas).groupBy("chain_id", "height").agg(F.count(F.lit(1)).alias("n"))
            n = {(r["chain_id"], r["lo"]): r["n"] for r in self._inside(counts, spans, "inner").groupBy("chain_id", "lo").agg(F.sum("n").alias("n")).collect()}  # a row a range
            tops = self._inside(self._written("blocks", write_id, schemas).select("chain_id", "height", "hash"), spans, "inner")
            best = {(r["chain_id"], r["lo"]): r["b"] for r in tops.groupBy("chain_id", "lo").agg(F.max_by(F.struct("height", "hash"), "height").alias("b")).collect()}
            for c, lo, hi in ranges:
                b = best.get((c, lo))
                log.append({"kind": "ingest", "write_id": write_id, "chain_id": c, "from_height": lo, "to_height": hi, "last_height": b and b["height"], "last_hash": b and bytes(b["hash"]), "rows": n.get((c, lo), 0)})
                if settles is not None:
                    log.append({"kind": "replace", "write_id": write_id, "table": settles, "chain_id": c, "from_height": lo, "to_height": hi})
            return log

        return self._commit(batch_id, make)[0]

    def ingest(self, batch_id: str, chain_id: int, lo: int, hi: int, logs: DataFrame, blocks: DataFrame, aux: dict[str, DataFrame] | None = None) -> int:
        """``ingest_ranges`` of one range."""
        return self.ingest_ranges(batch_id, [(chain_id, lo, hi)], logs, blocks, aux)

    def _written(self, table: str, write_id: str, schemas: dict[str, T.StructType]) -> DataFrame:
        """The rows of one write."""
        path = f"{self.root}/{table}"
        paths = f"{path}/chain_id=*/hb=*/write_id={write_id}"
        schema = schemas[table]
        return self.spark.read.schema(schema).option("basePath", path).parquet(paths).select(schema.names) if self.files.glob(paths) else self.spark.createDataFrame([], schema)

    def blocks(self, chain_id: int | None = None, lo: int | None = None, hi: int | None = None) -> DataFrame:
        """Visible blocks, the last write of each height."""
        return self.blocks_of([(chain_id, lo, hi)] if chain_id is not None else ())

    def blocks_of(self, spans: Sequence[tuple[int, int | None, int | None]]) -> DataFrame:
        """Visible blocks of some spans, or of all: the last write of each height."""
        state = self._state()
        schema = state.schemas["blocks"]
        rows = visible(self._scan("blocks", schema, spans), state.commits, "blocks")
        return last_wins(rows, ["chain_id", "height"], ["seq"]).select(schema.names)

    def raw_range(self, chain_id: int, lo: int, hi: int) -> DataFrame:
        """Visible raw records of a chain and range, in order; the bucket prunes files."""
        return self.read("raw_records", chain_id, lo, hi).orderBy("height", "idx")

    def read_ranges(self, table: str, ranges: Sequence[Range], bits: bool = False) -> DataFrame:
        """Visible rows of disjoint ranges, in one scan of the folders that they touch."""
        state = self._state()
        if (schema := state.schemas.get(table)) is None:
            raise ValueError(f"no table {table}")
        rows = visible(self._scan(table, schema, self.spans_of(ranges)), state.commits, table).select([c for c in schema.names if bits or not evolve.is_bits(c, schema)])
        return rows if len(ranges) == len({c for c, _, _ in ranges}) else self._inside(rows, self._ranges(ranges))

    def put_tables(self, batch_id: str, ranges: Sequence[Range], tables: dict[str, tuple[DataFrame, Entry | None]], mode: str = "insert_missing", whole: bool = False) -> dict[str, int]:
        """Decoded rows of disjoint ranges, several tables at once: ``insert_missing`` keeps what is stored, ``replace`` hides it.

        ``whole`` marks the ranges as decoded (table ``*``). Returns the rows added by table.
        """
        if mode not in ("insert_missing", "replace"):
            raise ValueError(mode)
        added: dict[str, int] = {}

        def make(state: State) -> list[dict]:
            write_id, schemas, log = _write_id(), dict(state.schemas), []
            for table, (rows, entry) in tables.items():
                if mode == "insert_missing" and table in schemas and shown(state.commits, table, ranges):
                    held = visible(self._scan(table, schemas[table], _hull(ranges)), state.commits, table)
                    rows = rows.join(held.select(*KEY), KEY, "left_anti")
                log += self._write(table, self._once(rows, KEY, ["tx_id"], ranges), write_id, schemas, entry)
                buckets = self._bucket_rows(table, write_id, schemas, [p.column for p in entry.params if p.indexed] if entry else [])
                added[table] = sum(b["rows"] for b in buckets)
                log += buckets
                of_all = {"rows": added[table]}  # said once
                for c, lo, hi in ranges:
                    log.append({"kind": "replace" if mode == "replace" else "decode", "write_id": write_id, "table": table, "chain_id": c, "from_height": lo, "to_height": hi, **of_all})
                    of_all = {}
            return log + [{"kind": "decode", "table": "*", "chain_id": c, "from_height": lo, "to_height": hi} for c, lo, hi in (ranges if whole else ())]

        if self._commit(batch_id, make)[1]:
            return added
        return {r["table"]: r["rows"] for r in self.commits().where((F.col("batch_id") == batch_id) & F.col("rows").isNotNull()).select("table", "rows").collect()}

    def put_waiting(self, batch_id: str, rows: DataFrame, table: str, spans: Sequence[Range] | None = None) -> None:
        """Rows (with chain_id and height) of a table beside the ranges, such as logs that wait for their height; a rollback hides them like others."""
        if spans is None:
            spans = [tuple(r) for r in rows.groupBy("chain_id").agg(F.min("height"), F.max("height")).collect()]  # a row a chain

        def make(state: State) -> list[dict]:
            write_id = _write_id()
            log = self._write(table, rows, write_id, dict(state.schemas), slices=self._slices(spans))
            return log + [{"kind": "decode", "write_id": write_id, "table": table, "chain_id": c, "from_height": lo, "to_height": hi} for c, lo, hi in spans]

        if spans:
            self._commit(batch_id, make)

    def put_typed(self, table: str, rows: DataFrame, batch_id: str, chain_id: int, lo: int, hi: int, mode: str = "insert_missing", entry: Entry | None = None) -> int:
        """``put_tables`` of one table; the range does not count as decoded."""
        return self.put_tables(batch_id, [(chain_id, lo, hi)], {table: (rows, entry)}, mode)[table]

    def select(self, entry: Entry, spec: reads.QuerySpec) -> DataFrame:
        """All rows of a stored table that a request's filters let through, from the buckets that can hold them."""
        lo, hi = reads.height_bounds(spec)
        held = [b for b, _ in self.buckets(entry.table, entry, spec)]
        rows = self.read(entry.table, spec.chain_id, lo, hi, bits=True, buckets=held)
        return reads.select_events(rows, spec, reads.columns_of(entry)).select([c for c in rows.columns if not evolve.is_bits(c, rows.schema)])

    def events(self, entry: Entry, spec: reads.QuerySpec) -> DataFrame:
        """The page that a request asks of a stored table, and one row more.

        Buckets are taken from the side on which the page begins, as many as
        should fill it by the log's counts; where filters leave too few rows,
        twice as many, until the page is full or no bucket is left. So a page
        reads what it needs and at most as much again. Heights, wide integers
        and indexed columns prune as well.
        """
        lo, hi = reads.height_bounds(spec)
        held = self.buckets(entry.table, entry, spec)
        held = held[::-1] if spec.descending else held
        need, take, upto = reads.clamp_first(spec.first) + 1, 0, 0
        while take < len(held) and upto < need:
            upto, take = upto + held[take][1], take + 1
        while True:
            rows = self.read(entry.table, spec.chain_id, lo, hi, bits=True, buckets=[b for b, _ in held[:take]])
            page = reads.page_rows(rows, spec, reads.columns_of(entry))
            if take >= len(held) or page.count() >= need:
                return page
            take *= 2

    def page(self, entry: Entry, spec: reads.QuerySpec) -> DataFrame:
        """``events`` as a table of its own, with transaction and receipt as nested columns where the request wants them; of these tables only the page's heights are read."""
        rows = reads.take_page(self.events(entry, spec))
        for table, name, wanted in (("transactions", "transaction", spec.with_transaction), ("receipts", "receipt", spec.with_receipt)):
            if wanted:
                spans = self._near(rows)
                side = self.read_ranges(table, spans) if spans and self.has(table) else None
                rows = reads.nest(rows, side, name) if side is not None else rows.withColumn(name, F.lit(None))
        return rows

    def _near(self, rows: DataFrame) -> list[Range]:
        """The heights of a page: one range a chain and bucket."""
        bucket = F.floor(F.col("height") / self.bucket)
        return [(r["chain_id"], r["lo"], r["hi"]) for r in rows.groupBy("chain_id", bucket).agg(F.min("height").alias("lo"), F.max("height").alias("hi")).collect()]

    def rollback(self, batch_id: str, chain_id: int, from_height: int, doubted: int | None = None) -> int:
        """Hides all rows of a chain from a height upward in every table; rows landed later are visible again.

        ``doubted`` is the highest height of which something was known: up to there the range is open until it is supplied again.
        """
        return self._commit(batch_id, lambda _: [{"kind": "rollback", "chain_id": chain_id, "from_height": from_height, "to_height": doubted}])[0]

    def cursor(self, start: DataFrame | None = None) -> DataFrame:
        return contiguous_prefix(clip_ranges(self.commits()), start)

    def opened(self) -> DataFrame:
        """(chain_id, lo, hi): ranges that rollbacks have opened and that were not landed again."""
        commits = self.commits()
        spans = commits.where("kind = 'rollback' AND to_height IS NOT NULL").groupBy("chain_id").agg(F.min("from_height").alias("next"), F.max("to_height").alias("target"))
        return uncovered(clip_ranges(commits), spans)

    def known_heights(self, *waiting: str) -> DataFrame:
        """(chain_id, upto): the highest height that was ever landed, or is in a table of rows that wait."""
        ours = (F.col("kind") == "ingest") | ((F.col("kind") == "decode") & F.col("table").isin(*waiting))
        return self.commits().where(ours).groupBy("chain_id").agg(F.max("to_height").alias("upto"))

    def tops(self) -> DataFrame:
        """(chain_id, height, hash) of each chain's highest visible block, from the log; only of ranges that a rollback has cut in two, blocks are read."""
        commits = self.commits()
        ranges = clip_ranges(commits)
        known = ranges.where("best_height IS NOT NULL").groupBy("chain_id").agg(F.max_by(F.struct("best_height", "best_hash"), F.struct("best_height", "commit_seq")).alias("b"))
        known = known.select("chain_id", F.col("b.best_height").alias("height"), F.col("b.best_hash").alias("hash"))
        cut = ranges.where("best_height IS NULL AND rows > 0").join(known.select("chain_id", F.col("height").alias("_h")), "chain_id", "left").where("_h IS NULL OR hi > _h")
        spans = [tuple(r) for r in cut.select("chain_id", "lo", "hi").collect()]  # a row a rollback
        if not spans:
            return known
        both = known.unionByName(self.blocks_of(self.spans_of(spans)).select("chain_id", "height", "hash"))
        return highest(both)

    def committed(self, table: str, spans: Sequence[Range]) -> DataFrame:
        """Rows of all committed writes in some spans, also those that rollbacks or replaces hide."""
        state = self._state()
        writes = state.commits.where(F.col("write_id").isNotNull() & (F.col("table").isNull() | (F.col("table") == table))).select("chain_id", "write_id").distinct()
        return self._scan(table, state.schemas[table], self.spans_of(spans)).join(writes, ["chain_id", "write_id"], "left_semi").select(state.schemas[table].names)

    def inside(self, rows: DataFrame, ranges: Sequence[Range]) -> DataFrame:
        """The rows of some ranges."""
        return self._inside(rows, self._ranges(ranges))

    def put_late(self, batch_id: str, tables: dict[str, DataFrame], wants: DataFrame, expired: DataFrame) -> None:
        """Headers, transactions and receipts that came after their logs; what is still wanted takes the place of what was, and what has waited too long is kept apart.

        Heights of late headers are marked, by bucket from the lowest to the highest, so that rows decoded without block time get it.
        """
        buckets = wants.select("chain_id", F.floor(F.col("height") / self.bucket)).distinct().count()
        slices = max(1, min(evolve.SLICES, self._tasks() // max(1, buckets)))
        heights = tables["blocks"].groupBy("chain_id", F.floor(F.col("height") / self.bucket)) if "blocks" in tables else None
        late = heights.agg(F.min("height").alias("lo"), F.max("height").alias("hi")).collect() if heights is not None else []  # a row a bucket

        def make(state: State) -> list[dict]:
            write_id, schemas, log = _write_id(), dict(state.schemas), []
            for name, rows in (*tables.items(), ("expired_wants", expired), ("wants", wants)):
                log += self._write(name, rows, write_id, schemas, slices=slices)
                spans = {r["chain_id"]: (r["lo"], r["hi"]) for r in self._written(name, write_id, schemas).groupBy("chain_id").agg(F.min("height").alias("lo"), F.max("height").alias("hi")).collect()}
                if name == "wants":
                    had = state.commits.where((F.col("table") == "wants") & (F.col("kind") == "replace")).groupBy("chain_id").agg(F.min("from_height"), F.max("to_height")).collect()
                    for c, lo, hi in had:
                        a, b = spans.get(c, (lo, hi))
                        spans[c] = (min(a, lo), max(b, hi))
                log += [{"kind": "replace" if name == "wants" else "decode", "write_id": write_id, "table": name, "chain_id": c, "from_height": lo, "to_height": hi} for c, (lo, hi) in spans.items()]
            return log + [{"kind": "late", "chain_id": r["chain_id"], "from_height": r["lo"], "to_height": r["hi"]} for r in late]

        self._commit(batch_id, make)

    # maintenance

    def compact(self, table: str, chain_id: int, batch_id: str) -> None:
        """Rewrites a chain's visible rows of a table as one write, which from its row of the log on stands for all before it.

        Nothing is deleted here, so a crash at any point loses nothing; ``vacuum`` removes what is no longer shown.
        """

        def make(state: State) -> list[dict]:
            commits, schemas = state.commits.where((F.col("chain_id") == chain_id) | F.col("chain_id").isNull()), dict(state.schemas)
            last = commits.agg(F.max("commit_seq")).first()[0]
            again = commits.where((F.col("kind") == "compact") & (F.col("table") == table) & (F.col("commit_seq") == last)).limit(1).count()
            if last is None or again or table not in schemas:
                return []  # nothing came since the last time
            rows = visible(self._scan(table, schemas[table], [(chain_id, None, None)]), commits, table)
            if table == "blocks":
                rows = last_wins(rows, ["chain_id", "height"], ["seq"])
            write_id = _write_id()
            ends = commits.where("kind NOT IN ('schema', 'rollback', 'bucket')").agg(F.min("from_height"), F.greatest(F.max("to_height"), F.max("last_height"))).first()
            self._write(table, rows.select(schemas[table].names), write_id, schemas, slices=self._slices([(chain_id, *ends)]) if None not in tuple(ends) else evolve.SLICES)
            details = commits.where((F.col("kind") == "bucket") & (F.col("table") == table)).select("detail").distinct().collect()  # as many as the catalog had versions
            indexed = sorted({c for r in details for c in json.loads(r["detail"])})
            span = self._written(table, write_id, schemas).agg(F.min("height").alias("lo"), F.max("height").alias("hi")).first()
            lo, hi = min(x for x in (span["lo"], ends[0]) if x is not None), max(x for x in (span["hi"], ends[1]) if x is not None)
            buckets = [{"commit_seq": last, **b} for b in self._bucket_rows(table, write_id, schemas, indexed)] if details else []
            return [{"commit_seq": last, "kind": "compact", "write_id": write_id, "table": table, "chain_id": chain_id, "from_height": lo, "to_height": hi}, *buckets]

        self._commit(batch_id, make)

    def maintain(self, writes: int = MOST_WRITES, older_than: float = 7 * 86400) -> list[tuple[str, int]]:
        """Compacts what has more than ``writes`` live writes of a chain, and deletes what is not shown any more; returns (table, chain_id) of what was compacted."""
        state, done = self._state(), []
        for table in sorted(state.schemas):
            many = live_writes(state.commits, table).groupBy("chain_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > writes).collect()  # a row a chain
            for r in many:
                self.compact(table, r["chain_id"], f"compact-{table}-{r['chain_id']}-{state.number}")
                done.append((table, r["chain_id"]))
            self.vacuum(table, older_than)
        return done

    def vacuum(self, table: str, older_than: float = 7 * 86400) -> int:
        """Deletes folders of writes that show no row any more, and of attempts that no row of the log names, if they are old enough for no job to be at them."""
        commits = self.commits()
        packed = commits.where((F.col("kind") == "compact") & (F.col("table") == table)).groupBy("chain_id").agg(F.max("commit_seq").alias("upto"), F.max_by("write_id", "commit_seq").alias("by"))
        live = live_writes(commits, table).join(packed, "chain_id", "left").where("upto IS NULL OR seq > upto OR write_id = by")
        shown = {(r["chain_id"], r["write_id"]) for r in live.select("chain_id", "write_id").collect()}  # a row a write
        removed = 0
        for path, changed in [f for at in (f"{table}/chain_id=*/hb=*", f"{table}__index/chain_id=*/column=*") for f in self.files.glob(f"{self.root}/{at}/write_id=*")]:
            held = int(path.split("/chain_id=")[1].split("/")[0]), path.rpartition("write_id=")[2]
            if held not in shown and time.time() - changed > older_than:
                self.files.delete(path)
                removed += 1
        return removed
