"""Backfill, decode and resync end to end over a store on disk."""

import json

from pyspark.sql import functions as F

from blockloom.catalog import read_abi
from blockloom.functions import words as w
from blockloom.operators.reads import Filter, QuerySpec
from blockloom.operators.store import Store
from blockloom.plans import jobs

ABI = [
    {"type": "event", "name": "Transfer", "inputs": [{"name": "to", "type": "address", "indexed": True}, {"name": "value", "type": "uint256"}]},
    {"type": "function", "name": "transfer", "inputs": [{"name": "to", "type": "address"}, {"name": "amount", "type": "uint256"}]},
]
ENTRIES = read_abi(ABI, "token", functions=["transfer"], to_addr=b"\x33" * 20)


def hx(b):
    return "0x" + b.hex()


def lines(spark, rows):
    return spark.createDataFrame([(1, json.dumps(r)) for r in rows], "chain_id long, value string")


def test_backfill_decodes_and_resync_repairs(spark, tmp_path):
    event, call = ENTRIES
    to = b"\x22" * 20
    logs, blocks, receipts = [], [], []
    for h in range(1, 26):
        tx = hx(h.to_bytes(32))
        topics = [hx(event.key), hx(bytes(12) + to)] + ([hx(bytes(32))] if h == 7 else [])
        logs.append({"address": hx(b"\x33" * 20), "topics": topics, "data": hx((100 * h).to_bytes(32)), "blockNumber": hex(h), "blockHash": hx(bytes([h]) * 32), "logIndex": "0x0", "transactionHash": tx})
        data = hx(call.key + bytes(12) + to + (h).to_bytes(32)) if h % 2 else "0x01"
        other = {"hash": hx((999 + h).to_bytes(32)), "from": hx(to), "to": hx(to), "value": "0x0", "input": "0x", "gas": "0x1", "nonce": "0x0"}
        blocks.append({"number": hex(h), "hash": hx(bytes([h]) * 32), "parentHash": hx(bytes([h - 1]) * 32), "timestamp": hex(1_700_000_000 + h), "transactions": [other, {**other, "hash": tx, "to": hx(b"\x33" * 20), "input": data}]})
        receipts.append({"transactionHash": tx, "status": "0x1", "gasUsed": "0x5", "effectiveGasPrice": "0x1"})
    logs.append({**logs[0], "logIndex": None})
    held = Store(spark, f"file://{tmp_path}/s", bucket=10)
    args = (held, ENTRIES, 1, 1, 25, 10, lines(spark, logs), lines(spark, blocks), lines(spark, receipts))
    assert jobs.backfill(*args) == 3
    assert jobs.backfill(*args) == 0
    rows = held.read("evt_token_transfer").select("height", "block_time", w.uint256_text(F.col("value")).alias("v")).collect()
    assert sorted((r["height"], r["v"]) for r in rows) == [(h, str(100 * h)) for h in range(1, 26) if h != 7]
    assert all(r["block_time"] is not None for r in rows)
    assert sorted(r["height"] for r in held.read("call_token_transfer").collect()) == list(range(1, 26, 2))
    assert held.read("quarantine").count() == 1 and held.read("receipts").count() == 25 and held.read("transactions").count() == 25
    assert held.cursor().first()["last_height"] == 25
    held.put_typed("evt_token_transfer", held.read("evt_token_transfer").where("height < 5").withColumn("value", w.word(F.lit(7))), "spoilt", 1, 1, 25, mode="replace")
    jobs.resync(held, ENTRIES, 1, 1, 25, "again")
    values = {r["height"]: r["v"] for r in held.read("evt_token_transfer").select("height", w.uint256_text(F.col("value")).alias("v")).collect()}
    assert len(values) == 24 and values[1] == "7" and values[25] == "2500"
    jobs.resync(held, ENTRIES, 1, 1, 25, "once-more", mode="replace")
    assert {r["v"] for r in held.read("evt_token_transfer").where("height = 1").select(w.uint256_text(F.col("value")).alias("v")).collect()} == {"100"}
    held.rollback("back", 1, 20)
    assert held.read("evt_token_transfer").agg(F.max("height")).first()[0] == 19
    # The chain is rewound, and the same job lands and decodes the range again.
    assert jobs.backfill(*args) == 1
    assert held.read("evt_token_transfer").where("height >= 20").count() == 6 and held.cursor().first()["last_height"] == 25
    assert jobs.backfill(*args) == 0
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = held.events(event, QuerySpec(event.table, (Filter("value", "GT", "2000"),), chain_id=1, from_height=15))
    assert sorted(r["height"] for r in plan.collect()) == [21, 22, 23, 24, 25]
    assert "GreaterThanOrEqual(value_bits,11)" in plan._jdf.queryExecution().executedPlan().toString()


def test_reconcile_fills_gaps_of_an_outage(spark, tmp_path):
    event = ENTRIES[0]
    logs = [{"address": "0x33", "topics": [hx(event.key), hx(bytes(32))], "data": hx(h.to_bytes(32)), "blockNumber": hex(h), "blockHash": hx(bytes([h]) * 32), "logIndex": "0x0", "transactionHash": hx(h.to_bytes(32))} for h in range(1, 41)]
    held, nothing = Store(spark, f"file://{tmp_path}/s", bucket=10), lines(spark, [{"number": "0x0"}])
    some = lambda *heights: lines(spark, [logs[h - 1] for h in heights])
    for lo, hi in ((1, 10), (31, 40)):
        assert jobs.backfill(held, ENTRIES[:1], 1, lo, hi, 100, some(*range(lo, hi + 1)), nothing) == 1
    assert held.cursor().first()["last_height"] == 10
    spans = spark.createDataFrame([(1, 1, 40)], "chain_id long, next long, target long")
    # One range of a chain at a time, then the rest.
    assert [jobs.reconcile(held, spans, 15, lines(spark, logs), nothing, concurrency=1) for _ in range(3)] == [1, 1, 0]
    assert held.cursor().first()["last_height"] == 40 and jobs.decode_pending(held, ENTRIES[:1]) == 2
    assert sorted(r["height"] for r in held.read(event.table).collect()) == list(range(1, 41))


def test_late_headers_of_many_heights_are_one_range(spark, tmp_path):
    """Every other header of 300 heights comes late: the rows get their times by one replace, not by one a height."""
    event, n = ENTRIES[0], 300
    held = Store(spark, f"file://{tmp_path}/s", bucket=50)
    raw = spark.range(n).select(
        F.lit(1).cast("long").alias("chain_id"), F.col("id").alias("height"), F.lit(0).cast("long").alias("idx"), w.word(F.col("id")).alias("block_hash"), w.address_word(F.lit(51)).alias("address"),
        F.array(F.lit(event.key), w.word(F.col("id"))).alias("selectors"), w.word(F.col("id")).alias("data"), w.word(F.col("id")).alias("tx_id"), F.lit(0).cast("long").alias("tx_index"), F.lit(None).cast("long").alias("inner_index"),
    )
    headers = raw.select("chain_id", "height", F.col("block_hash").alias("hash"), F.col("block_hash").alias("parent_hash"), (F.col("height") + 1000).alias("time"))
    held.ingest("all", 1, 0, n - 1, raw, headers.where("height % 2 = 0"))
    jobs.decode_pending(held, [event])
    late = headers.where("height % 2 = 1 AND height <> 7")
    none = raw.where("chain_id IS NULL").select("chain_id", "height", "idx", "block_hash", "tx_id")
    held.put_late("late", {"blocks": late}, none, none)
    jobs.decode_pending(held, [event])
    times = {r["height"]: r["t"] for r in held.read(event.table).select("height", F.unix_timestamp("block_time").alias("t")).collect()}
    assert times == {h: None if h == 7 else h + 1000 for h in range(n)}
    replaced = held.commits().where(F.col("batch_id").startswith("stamp-") & (F.col("kind") == "replace")).select("from_height", "to_height").collect()
    assert [tuple(r) for r in replaced] == [(1, n - 1)]
    jobs.decode_pending(held, [event])
    assert held.commits().where(F.col("batch_id").startswith("stamp-")).select("batch_id").distinct().count() == 1
