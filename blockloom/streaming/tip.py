"""Following the chain tip with Structured Streaming: one stream for all chains.

Landed logs (NDJSON files, or any stream of chain_id and value) go through
``foreachBatch`` into the store. A micro-batch writes its files and then commits
them under an id made from the stream's own id and its epoch, so that a batch
that runs again is not committed again. Removed logs are a sign of a
reorganisation.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators import forks
from ..operators.ranges import reorg_detect
from ..operators.store import KEY, Range, Store, covered, first_wins
from ..scratch import Scratch
from ..sources import landing

NDJSON = "chain_id long, value string"
#: Batches for which a landed log waits for its header, transaction and receipt.
PATIENCE = 600
#: Batches after which the store is maintained: about two hours.
UPKEEP = 1200


def landed_logs(spark: SparkSession, path: str) -> DataFrame:
    """A stream of log lines (chain_id, value) from a folder of NDJSON files, with the file in which they arrived."""
    lines = spark.readStream.schema(NDJSON).json(path)
    return lines.select("chain_id", "value", F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file")).alias("arrived"))


def removed_signal(tip: DataFrame) -> DataFrame:
    """The lowest removed height of each chain: from there the stored rows are in doubt."""
    return tip.where("removed").groupBy("chain_id").agg(F.min("height").alias("from_height"))


def late_logs(tip: DataFrame, raw: DataFrame) -> DataFrame:
    """Logs of a sweep that the store lacks."""
    return tip.where("NOT removed").join(raw.select(*KEY), KEY, "left_anti")


def tip_rate(logs: DataFrame, length: str = "1 minute", late: str | None = None) -> DataFrame:
    """Logs by chain in tumbling windows of ``ts``; on a stream, ``late`` is how long a window waits."""
    held = logs.withWatermark("ts", late) if late else logs
    counted = held.groupBy("chain_id", F.window("ts", length).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("chain_id", F.col("w.start").alias("window_start"), "n")


def settled(tip: DataFrame) -> DataFrame:
    """What a batch of tip logs leaves: a log of which the last that was heard is not its removal, and of several of one place the last to arrive.

    ``arrived`` orders the batch; the result has neither it nor ``removed``.
    """
    return landing.last_heard(landing.still_there(tip))


@dataclass(frozen=True)
class Sources:
    """What is known beside the streams, as of the moment of the call.

    ``canonical`` gives (chain_id, height, hash); ``blocks`` and ``receipts``
    payload lines; ``answers`` (chain_id, from_height, to_height) of which the
    node has said that no log is in them.
    """

    canonical: Callable[[], DataFrame] | None = None
    blocks: Callable[[], DataFrame] | None = None
    receipts: Callable[[], DataFrame] | None = None
    answers: Callable[[], DataFrame] | None = None


def _rollbacks(store: Store, removed: dict[int, int], sources: Sources, chains: DataFrame | None) -> dict[int, tuple[int, int]]:
    """(from, doubted) of each chain that is to be rolled back: from its lowest removed height, or where its highest block is not canonical, up to the highest height of which something is known."""
    signals = dict(removed)
    if sources.canonical is not None and chains is not None:
        for r in reorg_detect(store.tops(), sources.canonical(), chains).collect():
            signals[r["chain_id"]] = min(r["from_height"], signals.get(r["chain_id"], r["from_height"]))
    known = {r["chain_id"]: r["upto"] for r in store.known_heights("pending_logs").collect()} if signals else {}
    return {c: (h, known[c]) for c, h in signals.items() if known.get(c, -1) >= h}


def _full_blocks(sources: Sources, logs: DataFrame) -> DataFrame:
    """Payloads of the blocks that the logs are of."""
    full = landing.parse(sources.blocks(), landing.BLOCK).withColumns({"height": landing.height_of("number"), "block_hash": landing.bytes_of("hash")})
    return full.join(logs.select("chain_id", "height", "block_hash").distinct(), ["chain_id", "height", "block_hash"], "left_semi")


def _payloads(logs: DataFrame, sources: Sources) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Headers, transactions and receipts of the logs, from payloads landed so far; without them what the logs say of their blocks."""
    if sources.blocks is None:
        said = logs.groupBy("chain_id", "height").agg(F.max("block_hash").alias("hash"))
        return said.withColumns({"parent_hash": F.lit(None).cast("binary"), "time": F.lit(None).cast("bigint")}), {}
    full = _full_blocks(sources, logs)
    aux = {"transactions": landing.matched_transactions(landing.land_transactions(full), logs)}
    if sources.receipts is not None:
        aux["receipts"] = landing.land_receipts(landing.parse(sources.receipts(), landing.RECEIPT), logs)
    return landing.land_blocks(full), aux


def follow(
    logs: DataFrame,
    store: Store,
    checkpoint: str,
    canonical: Callable[[], DataFrame] | None = None,
    chains: DataFrame | None = None,
    on_rollback: Callable[[int, int], None] | None = None,
    available_now: bool = True,
    heads: DataFrame | None = None,
    blocks: Callable[[], DataFrame] | None = None,
    receipts: Callable[[], DataFrame] | None = None,
    answers: Callable[[], DataFrame] | None = None,
    patience: int = PATIENCE,
    upkeep: int = UPKEEP,
) -> StreamingQuery:
    """Lands a stream of log lines (chain_id, value) in the store and rolls back where the tip was reorganised.

    ``canonical`` and ``chains`` (the confirmations) are for the probe; without
    them only removed logs roll back.

    ``heads`` is a stream of (chain_id, head). With it a chain is caught up to
    head - confirmations: logs above that wait in the table ``pending_logs``,
    and the range from the cursor (or the chain's ``start``, a column of
    ``chains``) to there is marked, whether or not a log is in it. A new head alone makes a batch, so the cursor moves while nothing matches.
    Without ``heads`` every log lands at once, provisional until reads find its
    height final.

    A rollback opens the range of what was known above it. A height of such a
    range is marked again only where something proves that it was supplied again
    (``_proof``); what nothing proves stays open for ``jobs.reconcile``.

    What landed logs still lack of header, transaction and receipt is kept in
    the table ``wants`` and landed when it comes; after ``patience`` batches it
    goes to ``expired_wants``.

    Batches are named by the stream's own id, so that several streams, or one
    with a new checkpoint, share a store. After every ``upkeep`` batches the
    store's tables are compacted and cleared of what is not shown any more.
    """
    sources = Sources(canonical, blocks, receipts, answers)
    known = chains.collect() if chains is not None else []  # a row a chain
    waits = {r["chain_id"]: (r["confirmations"], r["start"] if "start" in chains.columns else 0) for r in known}
    feed = logs.select("chain_id", "value", *(["arrived"] if "arrived" in logs.columns else []))
    if heads is not None:
        feed = feed.unionByName(heads.select("chain_id", F.col("head").cast("bigint").alias("head")), allowMissingColumns=True)

    def land(batch: DataFrame, epoch: int) -> None:
        # Files in the order in which they came, and lines in theirs.
        batch = batch.withColumn("arrived", F.struct(*(["arrived"] if "arrived" in batch.columns else []), F.monotonically_increasing_id().alias("line"))).persist()
        said = batch.where("value IS NOT NULL") if heads is not None else batch
        rows = landing.land_logs(landing.parse(said, landing.LOG, "arrived"), "arrived").persist()
        try:
            tag = f"tip-{stream_id(store, checkpoint)}-{epoch}"
            done = {r["batch_id"] for r in store.commits().where(F.col("batch_id").startswith(f"{tag}-")).select("batch_id").collect()}
            if f"{tag}-land" not in done:
                removed = {r["chain_id"]: r["from_height"] for r in removed_signal(rows).collect()}  # a row a chain
                for chain, (height, doubted) in sorted(_rollbacks(store, removed, sources, chains).items()):
                    if f"{tag}-back-{chain}" not in done:
                        store.rollback(f"{tag}-back-{chain}", chain, height, doubted)
                        if on_rollback:
                            on_rollback(chain, height)
                if removed:
                    store.put_waiting(f"{tag}-gone", rows.where("removed").select("chain_id", "height", "block_hash").distinct(), "removed_blocks")
            fresh = settled(rows)
            heard = [(r["chain_id"], r["lo"], r["hi"]) for r in fresh.groupBy("chain_id").agg(F.min("height").alias("lo"), F.max("height").alias("hi")).collect()]  # a row a chain
            spans, fresh = (heard, fresh) if heads is None else _due(store, batch, fresh, heard, waits, tag)
            spans, fresh = _proven(store, spans, fresh, sources)
            missing = store.read("wants") if store.has("wants") else None
            if spans:
                headers, aux = _payloads(fresh, sources)
                store.ingest_ranges(f"{tag}-land", spans, fresh, headers, aux, "pending_logs" if heads is not None else None)
            if sources.blocks is not None and (spans or missing is not None):
                _settle_wants(store, f"{tag}-late", spans, fresh, missing, sources, patience)
            if epoch % upkeep == upkeep - 1:
                store.maintain()
        finally:
            rows.unpersist()
            batch.unpersist()

    writer = feed.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="6 seconds")).start()


def stream_id(store: Store, checkpoint: str) -> str:
    """The id that Spark gave the stream when its checkpoint was made."""
    return json.loads(store.files.read(f"{checkpoint.rstrip('/')}/metadata"))["id"]


def _due(store: Store, batch: DataFrame, fresh: DataFrame, heard: Sequence[Range], waits: dict[int, tuple[int, int]], tag: str) -> tuple[list[Range], DataFrame]:
    """The ranges to land, from what a chain's cursor has not reached to its newly safe height, and the logs that may be in them.

    New logs are put by first, so that those above the safe height are there
    when it has risen. A log at or below the cursor is late and lands too.
    """
    store.put_waiting(f"{tag}-wait", fresh, "pending_logs", heard)
    cursor = {r["chain_id"]: r["last_height"] for r in store.cursor().collect()}  # a row a chain
    safe = {r["chain_id"]: r["head"] - waits.get(r["chain_id"], (0, 0))[0] for r in batch.where("head IS NOT NULL").groupBy("chain_id").agg(F.max("head").alias("head")).collect()}
    late = {c: lo for c, lo, _ in heard}
    spans = []
    for chain in sorted({*safe, *late}):
        known = chain in cursor or chain in safe
        at = cursor.get(chain, waits.get(chain, (0, 0))[1] - 1)
        upto = max(at, safe.get(chain, at))
        lo = min(at + 1, late.get(chain, at + 1))
        if known and lo <= upto:
            spans.append((chain, lo, upto))
    if not spans or not store.has("pending_logs"):
        return spans, fresh
    return spans, reduce(DataFrame.unionByName, (store.read("pending_logs", *s) for s in spans))


def _without(span: Range, holes: Sequence[Range]) -> list[Range]:
    """What of a span no hole covers."""
    chain, at, hi = span
    out = []
    for _, a, b in sorted(h for h in holes if h[0] == chain and h[1] <= hi and h[2] >= at):
        if at < a:
            out.append((chain, at, a - 1))
        at = max(at, b + 1)
    return [*out, (chain, at, hi)] if at <= hi else out


def _proven(store: Store, spans: Sequence[Range], logs: DataFrame, sources: Sources) -> tuple[list[Range], DataFrame]:
    """The spans without what rollbacks have opened and nothing proves; and their logs, with those that the store knew before and that are canonical."""
    opened = [tuple(r) for r in store.opened().collect()]  # a row an open range
    doubts = [(c, max(lo, a), min(hi, b)) for c, lo, hi in spans for d, a, b in opened if c == d and a <= hi and b >= lo]
    if not doubts:
        return list(spans), logs
    proven, branch = _proof(store, doubts, logs, sources)
    rest = [part for s in spans for part in _without(s, doubts)]
    if branch is not None:
        at = ["chain_id", "height"]
        # Where the branch is known its logs are taken, from all that was ever heard, and no others.
        heard = [store.committed(t, doubts).select(logs.columns) for t in ("raw_records", "pending_logs") if store.has(t)]
        again = reduce(DataFrame.unionByName, [logs, *heard]).join(branch.select(*at, F.col("hash").alias("block_hash")), [*at, "block_hash"], "left_semi")
        logs = logs.join(branch.select(*at), at, "left_anti").unionByName(first_wins(again, KEY, ["tx_id"]))
    return sorted(rest + proven), logs


def _proof(store: Store, doubts: Sequence[Range], logs: DataFrame, sources: Sources) -> tuple[list[Range], DataFrame | None]:
    """Of opened ranges, what was supplied again, in runs of heights; and the blocks of the branch (chain_id, height, hash) as far as they are known.

    A height is proven by a log that was heard since, by headers that name each
    other as parents, by the node's word that nothing is in it, or by its
    canonical hash where that is the block of logs that the store has had.
    Headers are older than logs heard since: they do not bring back a block of
    which a log was removed, nor decide a height of whose new block they do not know.
    """
    heard = logs.select("chain_id", "height", F.col("block_hash").alias("hash")).distinct()
    spans = store.spark.createDataFrame(list(doubts), "chain_id long, lo long, hi long")
    inside = lambda rows: rows.join(F.broadcast(spans), "chain_id").where("height BETWEEN lo AND hi").select(rows.columns)
    found = [inside(logs.select("chain_id", "height")).select("chain_id", F.col("height").alias("lo"), F.col("height").alias("hi"))]
    branch = None
    if sources.blocks is not None:
        near = F.broadcast(spans.groupBy("chain_id").agg(F.min("lo").alias("least")))
        lines = landing.in_order(sources.blocks())
        headers = landing.land_blocks(landing.parse(lines, landing.BLOCK, "arrived"), "arrived").where("height IS NOT NULL AND hash IS NOT NULL")
        if store.has("removed_blocks"):
            gone = store.committed("removed_blocks", doubts).select("chain_id", "height", F.col("block_hash").alias("hash"))
            headers = headers.join(gone.join(heard, _BLOCK, "left_anti"), _BLOCK, "left_anti")
        above = headers.join(near, "chain_id").where("height >= least - 1").select(headers.columns)
        base = store.tops().join(near, "chain_id").where("height < least").select("chain_id", "height", "hash", F.lit(None).cast("binary").alias("parent_hash"))
        kept = forks.canonical_branch(above)
        base = base.join(kept.select("chain_id", "height"), ["chain_id", "height"], "left_anti")
        found.append(forks.linked(kept.unionByName(base)))
        unknown = inside(heard).join(above.select(*_BLOCK), _BLOCK, "left_anti").select("chain_id", "height")
        branch = inside(kept.select(*_BLOCK)).join(unknown, ["chain_id", "height"], "left_anti")
    if sources.canonical is not None:
        canon = inside(sources.canonical().select(*_BLOCK))
        branch = canon if branch is None else canon.unionByName(branch.join(canon.select("chain_id", "height"), ["chain_id", "height"], "left_anti"))
        for table in ("raw_records", "pending_logs"):
            if store.has(table):
                had = store.committed(table, doubts).select("chain_id", "height", F.col("block_hash").alias("hash"))
                same = canon.join(had, ["chain_id", "height", "hash"], "left_semi")
                found.append(same.select("chain_id", F.col("height").alias("lo"), F.col("height").alias("hi")))
    if sources.answers is not None:
        found.append(sources.answers().select("chain_id", F.col("from_height").alias("lo"), F.col("to_height").alias("hi")))
    return [tuple(r) for r in covered(reduce(DataFrame.unionByName, found), spans).collect()], branch  # a row a run


_BLOCK = ["chain_id", "height", "hash"]
_WANT = ["chain_id", "height", "idx", "block_hash", "tx_id"]


def _lacking(logs: DataFrame, headers: DataFrame, transactions: DataFrame, receipts: DataFrame | None) -> DataFrame:
    """Logs (and how long they have waited) with what is not among the payloads: header, transaction, receipt."""
    sides = {"header": (headers.select("chain_id", "height", F.col("hash").alias("block_hash")), ["chain_id", "height", "block_hash"]), "transaction": (transactions.select("chain_id", "tx_id"), ["chain_id", "tx_id"])}
    if receipts is not None:
        sides["receipt"] = (receipts.select("chain_id", "tx_id"), ["chain_id", "tx_id"])
    out = logs.select(*_WANT, "waited")
    for name, (side, key) in sides.items():
        out = out.join(side.distinct().withColumn(f"_{name}", F.lit(True)), key, "left").withColumn(name, F.col(f"_{name}").isNull()).drop(f"_{name}")
    return out.select(*_WANT, "waited", "header", "transaction", F.col("receipt") if receipts is not None else F.lit(False).alias("receipt"))


def _settle_wants(store: Store, batch_id: str, spans: Sequence[Range], fresh: DataFrame, open_: DataFrame | None, sources: Sources, patience: int) -> None:
    """Lands what has come of what earlier batches lacked, and writes down what is lacking now."""
    scratch = Scratch(store.spark, "wants", lean=True)
    landed = store.inside(fresh, spans).select(*_WANT).withColumn("waited", F.lit(0)) if spans else None
    before = open_.withColumn("waited", F.col("waited") + 1) if open_ is not None else None
    logs = scratch.keep(reduce(DataFrame.unionByName, [x.select(*_WANT, "waited") for x in (landed, before) if x is not None]), "logs")
    headers, aux = _payloads(logs, sources)
    headers, transactions = scratch.keep(headers, "headers"), scratch.keep(aux["transactions"], "transactions")
    receipts = scratch.keep(aux["receipts"].where("height > 0"), "receipts") if "receipts" in aux else None
    lacking = scratch.keep(_lacking(logs, headers, transactions, receipts).where("header OR transaction OR receipt"), "lacking")
    late: dict[str, DataFrame] = {}
    if before is not None:
        waiting = scratch.keep(before, "before")
        late["blocks"] = headers.join(waiting.where("header").select("chain_id", "height", F.col("block_hash").alias("hash")), ["chain_id", "height", "hash"], "left_semi")
        late["transactions"] = transactions.join(waiting.where("transaction").select("chain_id", "tx_id"), ["chain_id", "tx_id"], "left_semi")
        if receipts is not None:
            late["receipts"] = receipts.join(waiting.where("receipt").select("chain_id", "tx_id"), ["chain_id", "tx_id"], "left_semi")
    if before is not None or lacking.take(1):
        store.put_late(batch_id, late, lacking.where(F.col("waited") < patience), lacking.where(F.col("waited") >= patience))
    scratch.drop("logs", "headers", "transactions", "receipts", "lacking", "before")


class PendingHeights(StatefulProcessor):
    """Holds a chain's logs until their height is at or below head - confirmations.

    Input rows are (chain_id, height, idx, head): a log, or a new head where
    height is null. State is the head and the pending logs of a chain; a log is
    given out once.
    """

    def __init__(self, confirmations: int):
        self.confirmations = confirmations

    def init(self, handle) -> None:
        self.head = handle.getValueState("head", "head long")
        self.pending = handle.getMapState("pending", "height long, idx long", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head = self.head.get()[0] if self.head.exists() else -1
        for pdf in rows:
            heads = pdf["head"].dropna()
            if len(heads):
                head = max(head, int(heads.max()))
            for height, idx in pdf.loc[pdf["height"].notna(), ["height", "idx"]].itertuples(index=False):
                self.pending.updateValue((int(height), int(idx)), (True,))
        self.head.update((head,))
        safe = head - self.confirmations
        ready = sorted(tuple(k) for k in self.pending.keys() if k[0] <= safe)
        for k in ready:
            self.pending.removeKey(k)
        if ready:
            yield pd.DataFrame({"chain_id": key[0], "height": [h for h, _ in ready], "idx": [i for _, i in ready]})

    def close(self) -> None:
        pass


def hold_until_safe(rows: DataFrame, confirmations: int) -> DataFrame:
    """A stream of (chain_id, height, idx) whose heights are final; needs the RocksDB state store."""
    return rows.groupBy("chain_id").transformWithStateInPandas(PendingHeights(confirmations), "chain_id long, height long, idx long", "Append", "None")
