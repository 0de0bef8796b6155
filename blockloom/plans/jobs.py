"""The batch jobs: backfill and reconciling of landed payloads, decoding of stored ranges, resync."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Entry
from ..operators import decode, forks, ranges
from ..operators.store import Range, Store, clip_ranges, covered, decode_backlog, late_headers, uncovered
from ..scratch import Scratch
from ..sources import landing


#: Ranges that are decoded together: what a job that dies has to do again.
RANGES_AT_ONCE = 512


def decode_ranges(store: Store, entries: Sequence[Entry], wanted: Sequence[Range], batch_id: str, mode: str = "insert_missing") -> dict[str, int]:
    """Decodes stored ranges into one typed table per event and call; returns the rows decoded by table.

    The ranges are scanned once for all events: the decoded frame is written by
    table, and each table reads its own part. Calldata is read only if the
    catalog has functions, and only of the transactions behind the ranges'
    logs. All tables and the marks that the ranges are decoded appear together.
    """
    scratch = Scratch(store.spark, "decode", lean=True)
    raw, blocks = store.read_ranges("raw_records", wanted), store.blocks_of(store.spans_of(wanted))
    staged = scratch.keep(decode.stamp_block_time(decode.decode_all(raw, entries), blocks), "events", "table")
    found = {(r["table"], r["bad"]): r["n"] for r in staged.groupBy("table", F.col("reason").isNotNull().alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as interfaces
    tables: dict[str, tuple[DataFrame, Entry | None]] = {e.table: (decode.typed_rows(staged, entries, e), e) for e in entries if e.kind == "event" and (e.table, False) in found}
    counts = {table: found[table, False] for table in tables}
    functions = [e for e in entries if e.kind == "call"]
    if functions and store.has("transactions"):
        behind = scratch.keep(landing.matched_transactions(store.read_ranges("transactions", wanted), raw), "transactions")
        for e in functions:
            rows = scratch.keep(decode.stamp_block_time(decode.decode_calls(behind, e), blocks), e.table)
            tables[e.table] = (rows, e)
            counts[e.table] = rows.count()  # from the footers
    bad = sum(n for (_, quarantined), n in found.items() if quarantined)
    if bad:
        tables["quarantine"] = (staged.where("reason IS NOT NULL").select("chain_id", "height", "idx", "tx_id", "table", "reason"), None)
        counts["quarantine"] = bad
    store.put_tables(batch_id, wanted, tables, mode, whole=True)
    scratch.drop("events", "transactions", *(e.table for e in functions))
    return counts


def decode_pending(store: Store, entries: Sequence[Entry]) -> int:
    """Decodes every ingested range that is not decoded yet, oldest first, many at once; a row a range comes to the driver."""
    pending = decode_backlog(store.commits()).orderBy("commit_seq", "chain_id", "from_height").collect()
    for k in range(0, len(pending), RANGES_AT_ONCE):
        some = pending[k : k + RANGES_AT_ONCE]
        named = hashlib.sha256(repr([tuple(r) for r in some]).encode()).hexdigest()[:32]
        decode_ranges(store, entries, [(r["chain_id"], r["from_height"], r["to_height"]) for r in some], f"decode-{named}")
    # Headers that came after their rows were decoded: of neighbouring buckets what has been landed is decoded again as one range, since a table hides replaced ranges one by one.
    commits = store.commits()
    late = [tuple(r) for r in late_headers(commits).select("chain_id", "from_height", "to_height").collect()]  # a row a bucket
    if late:
        spans = store.spans_of(late)
        seq = commits.agg(F.max("commit_seq")).first()[0]
        frame = store.spark.createDataFrame(spans, "chain_id long, lo long, hi long")
        runs = [tuple(r) for r in covered(clip_ranges(commits), frame).orderBy("chain_id", "lo").collect()]
        for k in range(0, len(runs), RANGES_AT_ONCE):
            some = runs[k : k + RANGES_AT_ONCE]
            named = hashlib.sha256(repr((seq, some)).encode()).hexdigest()[:32]
            decode_ranges(store, entries, some, f"stamp-{named}", "replace")
    return len(pending)


def resync(store: Store, entries: Sequence[Entry], chain_id: int, lo: int, hi: int, batch_id: str, mode: str = "insert_missing") -> dict[str, int]:
    """Decodes a stored range again without fetching: adds what is missing, or replaces what is there.

    Tables get the columns that their entries have gained first; ``replace`` fills them.
    """
    for e in entries:
        store.evolve(e)
    return decode_ranges(store, entries, [(chain_id, lo, hi)], batch_id, mode)


def reconcile(store: Store, spans: DataFrame, step: int, logs: DataFrame, blocks: DataFrame, receipts: DataFrame | None = None, concurrency: int | None = None) -> int:
    """Lands what of the spans (chain_id, next, target) the store does not cover, from payload lines (chain_id, value); returns the ranges landed.

    Gaps that outages left, ranges that a rollback took away and what is new at
    the end are alike: uncovered. They are cut into ranges of ``step`` and landed in one pass
    over the payloads, or, with ``concurrency``, so many of each chain at a time. A job that runs again goes on where the log says.

    Payloads may hold blocks that the chain has not kept. Of logs that were
    removed later nothing is landed; of competing blocks the branch that headers
    reach highest (``forks``), and of its blocks only logs, transactions and
    receipts. A column ``arrived`` of the lines orders them, else their place.
    """
    commits = store.commits()
    open_ = uncovered(clip_ranges(commits), spans).select("chain_id", F.col("lo").alias("next"), F.col("hi").alias("target"))
    if concurrency is not None:
        first = F.min("next").over(Window.partitionBy("chain_id"))
        open_ = open_.withColumn("target", ranges.fetch_target(F.col("target"), first, step, concurrency, F.lit(True))).where("next <= target")
    todo = [tuple(r) for r in ranges.plan_ranges(open_, step).orderBy("chain_id", "lo").collect()]  # a row a range
    if not todo:
        return 0
    wanted = spans.join(open_.groupBy("chain_id").agg(F.min("next").alias("lo"), F.max("target").alias("hi")), "chain_id").select("chain_id", "lo", "hi")
    scratch = Scratch(store.spark, "landing", lean=True)
    within = lambda rows: rows.join(F.broadcast(wanted), "chain_id").where("height BETWEEN lo AND hi").select(rows.columns)
    words = scratch.keep(landing.last_word(within(landing.land_logs(landing.parse(landing.in_order(logs), landing.LOG, "arrived"), "arrived"))), "heard")
    heard = words.where("NOT removed").drop("removed")
    full = landing.parse(landing.in_order(blocks), landing.BLOCK, "arrived").withColumn("height", landing.height_of("number"))
    # Headers above the ranges tell which of their blocks were kept.
    above = full.join(F.broadcast(wanted), "chain_id").where("height >= lo").select(full.columns)
    headers = landing.land_blocks(above, "arrived").where("height IS NOT NULL AND hash IS NOT NULL")
    headers = headers.join(landing.dead_blocks(words), ["chain_id", "height", "hash"], "left_anti")
    branch = scratch.keep(forks.canonical_branch(headers), "branch")
    raw = scratch.keep(landing.last_heard(forks.on_branch(heard, branch)), "logs")
    held = full.withColumn("block_hash", landing.bytes_of("hash")).join(raw.select("chain_id", "height", "block_hash").distinct(), ["chain_id", "height", "block_hash"], "left_semi")
    held = scratch.keep(held, "blocks")
    aux = {"transactions": landing.matched_transactions(landing.land_transactions(held), raw)}
    if receipts is not None:
        aux["receipts"] = landing.land_receipts(landing.parse(receipts, landing.RECEIPT), raw)
    first, last = todo[0], todo[-1]
    seq = commits.agg(F.max("commit_seq")).first()[0] or 0
    store.ingest_ranges(f"land-{first[0]}-{first[1]}-{last[0]}-{last[2]}-{seq}", todo, raw, landing.land_blocks(held, "arrived"), aux)
    scratch.drop("heard", "branch", "logs", "blocks")
    return len(todo)


def backfill(store: Store, entries: Sequence[Entry], chain_id: int, lo: int, hi: int, step: int, logs: DataFrame, blocks: DataFrame, receipts: DataFrame | None = None) -> int:
    """``reconcile`` of one chain's range, then decoding of what is pending; returns the ranges landed."""
    spans = store.spark.createDataFrame([(chain_id, lo, hi)], "chain_id long, next long, target long")
    landed = reconcile(store, spans, step, logs, blocks, receipts)
    decode_pending(store, entries)
    return landed
