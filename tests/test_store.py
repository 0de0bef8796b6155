"""The store: replay, rollback and landing again, resync, ranges, the stream."""

import json
import os
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from blockloom import scratch
from blockloom.operators import evolve, ranges, rollups, store
from blockloom.operators.reads import Filter, QuerySpec, keyset, page_rows
from blockloom.operators.store import Store
from blockloom.scratch import Scratch
from blockloom.streaming import tip

LOG = "chain_id long, height long, idx long, block_hash binary, tx_id binary, value long"
BLOCK = "chain_id long, height long, hash binary, parent_hash binary, time long"


def logs(spark, chain, heights, value=1):
    return spark.createDataFrame([(chain, h, 0, bytearray(b"h%d" % h), bytearray(b"t%d" % h), value) for h in heights], LOG)


def blocks(spark, chain, heights, mark=b"h"):
    return spark.createDataFrame([(chain, h, bytearray(mark + b"%d" % h), None, 0) for h in heights], BLOCK)


def heights(df):
    return sorted((r["height"], r["value"]) for r in df.collect())


def test_replay_rollback_and_landing_again(spark, tmp_path):
    held = Store(spark, f"file://{tmp_path}/s", bucket=10)
    for _ in range(2):
        held.ingest("a", 1, 0, 20, logs(spark, 1, [3, 10, 12]), blocks(spark, 1, [10, 12]))
    held.ingest("b", 2, 0, 20, logs(spark, 2, [10]), blocks(spark, 2, [10]))
    assert held.read("raw_records").count() == 4
    row = {r["chain_id"]: (r["last_height"], bytes(r["last_hash"])) for r in held.cursor().collect()}
    assert row == {1: (20, b"h12"), 2: (20, b"h10")}
    held.rollback("back", 1, 10)
    assert heights(held.raw_range(1, 0, 30)) == [(3, 1)]
    assert held.cursor().where("chain_id = 1").first()["last_height"] == 9
    held.ingest("c", 1, 10, 20, logs(spark, 1, [10, 11], 2), blocks(spark, 1, [11], b"n"))
    assert heights(held.raw_range(1, 0, 30)) == [(3, 1), (10, 2), (11, 2)]
    assert held.read("raw_records").where("chain_id = 2").count() == 1
    held.compact("raw_records", 1, "packed")
    held.compact("raw_records", 1, "packed-again")  # nothing new
    assert heights(held.raw_range(1, 0, 30)) == [(3, 1), (10, 2), (11, 2)]
    before = len(held.files.glob(f"{held.root}/raw_records/chain_id=1/*/write_id=*"))
    assert held.vacuum("raw_records", 0) > 0
    assert heights(held.raw_range(1, 0, 30)) == [(3, 1), (10, 2), (11, 2)] and held.read("raw_records").where("chain_id = 2").count() == 1
    assert len(held.files.glob(f"{held.root}/raw_records/chain_id=1/*/write_id=*")) == 2 < before
    held.rollback("back-again", 1, 11)
    assert heights(held.raw_range(1, 0, 30)) == [(3, 1), (10, 2)]
    held.ingest("c2", 1, 11, 20, logs(spark, 1, [11], 3), blocks(spark, 1, [11], b"o"))
    assert heights(held.raw_range(1, 0, 30)) == [(3, 1), (10, 2), (11, 3)]
    held.log.pack()
    held.log.pack()
    assert heights(Store(spark, held.root, bucket=10).raw_range(1, 0, 30)) == [(3, 1), (10, 2), (11, 3)]
    held.ingest("d", 1, 21, 30, logs(spark, 1, []), blocks(spark, 1, []))
    assert held.cursor().where("chain_id = 1").first()["last_height"] == 30


def test_a_dead_batch_stays_invisible(spark, tmp_path):
    """Files without a marker are shown by no later batch, whatever its number, nor is a partition of a failed attempt."""
    held = Store(spark, f"file://{tmp_path}/s", bucket=10)
    held.ingest("a", 1, 0, 9, logs(spark, 1, [5]), blocks(spark, 1, [5]))
    append = held.log.append
    held.log.append = lambda *_: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        held.ingest("dead", 1, 10, 29, logs(spark, 1, [16, 25], 7), blocks(spark, 1, [16, 25]))
    held.log.append = append
    assert heights(held.read("raw_records")) == [(5, 1)]
    held.ingest("b", 1, 30, 39, logs(spark, 1, [31]), blocks(spark, 1, [31]))
    assert heights(held.read("raw_records")) == [(5, 1), (31, 1)]
    held.ingest("dead", 1, 10, 29, logs(spark, 1, [16], 8), blocks(spark, 1, [16]))  # the retry finds less
    assert heights(held.read("raw_records")) == [(5, 1), (16, 8), (31, 1)]
    held.vacuum("raw_records", 0)
    assert heights(held.read("raw_records")) == [(5, 1), (16, 8), (31, 1)] and len(held.files.glob(f"{held.root}/raw_records/*/*/*")) == 3


def test_backlog_by_marker_and_number(spark, tmp_path):
    """A marker of one table is no decode of the range, and rows landed again are pending again."""
    held = Store(spark, f"file://{tmp_path}/s", bucket=10)
    pending = lambda: sorted((r["from_height"], r["to_height"]) for r in store.decode_backlog(held.commits()).collect())
    held.ingest("a", 1, 0, 9, logs(spark, 1, [5]), blocks(spark, 1, [5]))
    held.ingest("b", 1, 10, 19, logs(spark, 1, [15]), blocks(spark, 1, [15]))
    held.put_tables("one", [(1, 0, 9)], {"t": (logs(spark, 1, [5]), None)})
    assert pending() == [(0, 9), (10, 19)]
    for name, lo, hi in (("d", 0, 9), ("e", 10, 19)):
        held.put_tables(name, [(1, lo, hi)], {"t": (logs(spark, 1, [lo + 5]), None)}, whole=True)
    assert pending() == []
    held.rollback("back", 1, 12)
    assert pending() == []  # what is left of the second range was decoded
    held.ingest("c", 1, 12, 19, logs(spark, 1, [15], 2), blocks(spark, 1, [15]))
    assert pending() == [(12, 19)]


def test_schema_grows_and_refuses(spark, tmp_path):
    held = Store(spark, f"file://{tmp_path}/s")
    held.put_typed("t", logs(spark, 1, [1]), "a", 1, 0, 10)
    held.put_typed("t", logs(spark, 1, [2]).withColumn("more", F.lit("x")), "b", 1, 0, 10)
    held.put_typed("t", logs(spark, 1, [3]), "c", 1, 0, 10)
    assert sorted((r["height"], r["more"]) for r in held.read("t").collect()) == [(1, None), (2, "x"), (3, None)]
    with pytest.raises(evolve.DestructiveChange):
        held.put_typed("t", logs(spark, 1, [4]).withColumn("value", F.lit("x")), "d", 1, 0, 10)


def test_resync_modes(spark, tmp_path):
    held = Store(spark, f"file://{tmp_path}/s")
    held.put_typed("t", logs(spark, 1, [1, 3], 7), "a", 1, 0, 10)
    held.put_typed("t", logs(spark, 1, [1, 2, 3], 9), "b", 1, 0, 10)
    assert heights(held.read("t")) == [(1, 7), (2, 9), (3, 7)]
    held.put_typed("t", logs(spark, 1, [1, 2], 5), "c", 1, 0, 10, mode="replace")
    assert heights(held.read("t")) == [(1, 5), (2, 5)]


def prefix(spark, rows, start=1):
    frame = spark.createDataFrame([(1, lo, hi, best, best and bytearray(b"h%d" % best)) for lo, hi, best in rows], "chain_id long, lo long, hi long, best_height long, best_hash binary")
    out = store.contiguous_prefix(frame, spark.createDataFrame([(1, start)], "chain_id long, start long")).first()
    return out and (out["last_height"], bytes(out["last_hash"]))


def test_contiguous_prefix(spark):
    assert prefix(spark, [(1, 10, 10)]) == (10, b"h10")
    assert prefix(spark, [(1, 10, 10), (11, 20, 20)]) == (20, b"h20")
    assert prefix(spark, [(11, 20, 20)]) is None
    assert prefix(spark, [(1, 10, None)]) == (10, b"")
    assert prefix(spark, [(1, 10, 7), (11, 20, 15), (21, 30, None)]) == (30, b"h15")
    assert prefix(spark, [(1, 10, 7), (12, 20, 15)]) == (10, b"h7")


def test_ranges(spark):
    spans = spark.createDataFrame([(1, 1, 25), (2, 10, 5)], "chain_id long, next long, target long")
    assert sorted(tuple(r) for r in ranges.plan_ranges(spans, 10).collect()) == [(1, 1, 10), (1, 11, 20), (1, 21, 25)]
    targets = spark.createDataFrame([(1000, 1, True), (20, 1, True), (1000, 1, False)], "safe long, n long, must boolean")
    assert [r[0] for r in targets.select(ranges.fetch_target(F.col("safe"), F.col("n"), 10, 4, F.col("must"))).collect()] == [40, 20, 1000]
    counts = spark.createDataFrame([(1, h, 5) for h in range(2001)], "chain_id long, height long, n long")
    halves = ranges.cap_ranges(counts, spark.createDataFrame([(1, 0, 2000)], "chain_id long, lo long, hi long"), 6000).collect()
    assert sorted((r["lo"], r["hi"]) for r in halves) == [(0, 1000), (1001, 2000)]


@pytest.mark.parametrize("top, confirmations, canon, known, supported, wanted", [(50, 12, b"x", True, True, 39), (5, 12, b"x", True, True, 1), (50, 12, b"x", True, False, None), (50, 12, b"x", False, True, None), (50, 12, b"h50", True, True, None)])
def test_reorg(spark, top, confirmations, canon, known, supported, wanted):
    canonical = spark.createDataFrame([(1, top if known else top + 1, bytearray(canon))], "chain_id long, height long, hash binary")
    chains = spark.createDataFrame([(1, confirmations, supported)], "chain_id long, confirmations int, supports_reorg boolean")
    found = ranges.reorg_detect(blocks(spark, 1, [top - 1, top]), canonical, chains).first()
    assert (found and found["from_height"]) == wanted


def test_page_predicates_reach_the_scan(spark, tmp_path):
    logs(spark, 1, range(100)).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    plan = page_rows(table, QuerySpec("t", after="25:4", chain_id=1), {"chain_id": "int64", "height": "int64", "idx": "int64"})._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(height,25)" in plan
    assert table.where(keyset("25:0", False)).count() == 74


def test_evolution(spark):
    stored, wanted = logs(spark, 1, [1]), logs(spark, 1, [1]).withColumn("more", F.lit("x"))
    assert [c.kind for c in evolve.diff(stored.schema, wanted.schema)] == ["add"]
    assert evolve.diff(wanted.schema, wanted.schema) == []
    assert evolve.evolve_read(stored, wanted.schema).first()["more"] is None
    with pytest.raises(evolve.DestructiveChange):
        evolve.evolve_read(wanted, stored.schema)


def test_spend(spark):
    calls = [("compute_units", "eth_getLogs", 1)] * 20 + [("compute_units", "eth_getBlockByNumber", 20000), ("compute_units", "eth_getTransactionReceipt", 20000), ("compute_units", "eth_getBlockByNumber", 0), ("credits", "eth_getTransactionReceipt", 3), ("compute_units", "other", 9), ("free", "eth_getLogs", 1)]
    frame = spark.createDataFrame([(1, p, m, c) for p, m, c in calls], "chain_id long, provider string, method string, count long").withColumn("ts", F.lit("2024-01-05").cast("timestamp"))
    spend = {(r["provider"], r["method"]): (r["units"], r["micro_usd"]) for r in rollups.spend_by_method(frame).collect()}
    assert spend["compute_units", "eth_getLogs"] == (1500, 1800)
    assert spend["compute_units", "eth_getBlockByNumber"] == (320016, 384019)
    assert spend["credits", "eth_getTransactionReceipt"] == (60, 36)
    assert spend["compute_units", "other"] == spend["free", "eth_getLogs"] == (0, 0)
    month = {r["provider"]: r for r in rollups.billable_spend(frame, 1000).collect()}
    assert month["compute_units"]["billable_micro_usd"] == (621516 - 1000) * 12 // 10 and month["compute_units"]["exhausted"]
    assert month["credits"]["billable_micro_usd"] == 0 and month["credits"]["remaining"] == 940


def line(height, removed=False, mark="aa"):
    return json.dumps({"chain_id": 1, "value": json.dumps({"address": "0x01", "topics": [], "data": "0x", "blockNumber": hex(height), "blockHash": f"0x{mark}{height:02x}", "logIndex": "0x0", "transactionHash": f"0x{height:04x}", "removed": removed})})


def test_tip_stream_lands_and_rolls_back(spark, tmp_path):
    (tmp_path / "in").mkdir()
    held = Store(spark, f"file://{tmp_path}/s")

    def run():
        tip.follow(tip.landed_logs(spark, f"file://{tmp_path}/in"), held, f"file://{tmp_path}/cp").awaitTermination(120)
        return sorted((r["height"], bytes(r["block_hash"]).hex()) for r in held.read("raw_records").collect())

    (tmp_path / "in/1.json").write_text("\n".join(line(h) for h in (1, 2, 3)))
    assert run() == [(1, "aa01"), (2, "aa02"), (3, "aa03")]
    (tmp_path / "in/2.json").write_text("\n".join([line(2, True), line(3, True), line(2, mark="bb"), line(3, mark="bb"), "not json"]))
    assert run() == [(1, "aa01"), (2, "bb02"), (3, "bb03")]
    assert run() == [(1, "aa01"), (2, "bb02"), (3, "bb03")]
    # A log, its removal and what replaces it in one batch; and one that comes back.
    (tmp_path / "in/3.json").write_text("\n".join([line(4), line(4, True), line(4, mark="bb"), line(5, mark="cc"), line(5, True, mark="cc"), line(5, mark="dd"), line(5, True, mark="dd"), line(5, mark="cc")]))
    assert run() == [(1, "aa01"), (2, "bb02"), (3, "bb03"), (4, "bb04"), (5, "cc05")]


def test_tip_catches_up_to_the_safe_height(spark, tmp_path):
    """Logs above head - confirmations wait; a head alone moves the cursor; headers, transactions and receipts land with their logs."""
    for name in ("in", "heads"):
        (tmp_path / name).mkdir()
    held = Store(spark, f"file://{tmp_path}/s")
    chains = spark.createDataFrame([(1, 2, True, 1)], "chain_id long, confirmations int, supports_reorg boolean, start long")
    tx = lambda h: {"hash": f"0x{h:04x}", "from": "0x01", "to": "0x02", "value": "0x5", "input": "0x", "gas": "0x1", "nonce": "0x0"}
    full = [json.dumps({"number": hex(h), "hash": f"0xaa{h:02x}", "parentHash": f"0xaa{h - 1:02x}", "timestamp": hex(1000 + h), "transactions": [tx(h), tx(h + 100)]}) for h in range(1, 30)]
    bodies = spark.createDataFrame([(1, x) for x in full], "chain_id long, value string")
    receipts = spark.createDataFrame([(1, json.dumps({"transactionHash": f"0x{h:04x}", "status": "0x1", "gasUsed": "0x1", "effectiveGasPrice": "0x1"})) for h in range(1, 30)], "chain_id long, value string")

    def run():
        heads = spark.readStream.schema("chain_id long, head long").json(f"file://{tmp_path}/heads")
        tip.follow(tip.landed_logs(spark, f"file://{tmp_path}/in"), held, f"file://{tmp_path}/cp", chains=chains, heads=heads, blocks=lambda: bodies, receipts=lambda: receipts).awaitTermination(120)
        cursor = held.cursor().first()
        return sorted(r["height"] for r in held.read("raw_records").collect()) if held.has("raw_records") else [], cursor and cursor["last_height"]

    (tmp_path / "in/1.json").write_text("\n".join(line(h) for h in (3, 4, 9)))
    (tmp_path / "heads/1.json").write_text('{"chain_id": 1, "head": 6}')
    assert run() == ([3, 4], 4)
    assert [(r["height"], r["time"]) for r in held.blocks().orderBy("height").collect()] == [(3, 1003), (4, 1004)]
    assert held.read("transactions").count() == held.read("receipts").count() == 2
    (tmp_path / "heads/2.json").write_text('{"chain_id": 1, "head": 8}')
    assert run() == ([3, 4], 6)  # no log, and the cursor moves
    (tmp_path / "in/2.json").write_text("\n".join([line(10), line(5)]))  # one is late
    assert run() == ([3, 4, 5], 6)
    (tmp_path / "heads/3.json").write_text('{"chain_id": 1, "head": 11}')
    assert run() == ([3, 4, 5, 9], 9)
    (tmp_path / "in/3.json").write_text("\n".join([line(10, True), line(10, mark="bb")]))
    (tmp_path / "heads/4.json").write_text('{"chain_id": 1, "head": 12}')
    assert run() == ([3, 4, 5, 9, 10], 10)
    assert bytes(held.raw_range(1, 10, 10).first()["block_hash"]).hex() == "bb0a" and held.read("pending_logs").count() == 0


def test_pending_heights_wait_for_the_head(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "chain_id long, height long, idx long, head long"

    def run(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = tip.hold_until_safe(spark.readStream.schema(schema).json(f"{tmp_path}/in"), 12)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r["height"] for r in spark.read.schema("height long").parquet(f"{tmp_path}/out").collect())

    assert run(1, [(1, 5, 0, None), (1, 20, 0, None), (1, None, None, 20)]) == [5]
    assert run(2, [(1, None, None, 32)]) == [5, 20]


def test_layout_prunes_buckets(spark, tmp_path):
    evolve.lay_out(logs(spark, 1, range(0, 100, 3)), f"{tmp_path}/laid", 10, ["value"])
    rows = spark.read.parquet(f"{tmp_path}/laid").where(evolve.bucket_filter(10, 25, 44))
    assert sorted(r["height"] for r in rows.collect()) == [27, 30, 33, 36, 39, 42]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hb" in plan and "GreaterThanOrEqual(height,25)" in plan
    assert len({f.split("hb=")[1].split("/")[0] for f in spark.read.parquet(f"{tmp_path}/laid").inputFiles()}) == 10


def test_small_files_have_small_bloom_filters(spark, tmp_path):
    """Keys that differ in every row are not held by a dictionary, so each file gets a bloom filter: of the size that its rows need."""
    rows = spark.range(6000).select(F.lit(1).cast("long").alias("chain_id"), F.col("id").alias("height"), F.lit(0).cast("long").alias("idx"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("tx_id"))
    evolve.lay_out(rows, f"{tmp_path}/laid", 2000)
    files = list(tmp_path.glob("laid/**/*.parquet"))
    assert files and max(f.stat().st_size for f in files) < 300_000
    meta = pq.ParquetFile(max(files, key=lambda f: f.stat().st_size)).metadata.row_group(0)
    assert next(c for c in map(meta.column, range(meta.num_columns)) if c.path_in_schema == "tx_id").total_compressed_size > 30_000
    assert spark.read.parquet(f"{tmp_path}/laid").count() == 6000


def test_a_bucket_is_one_file_where_there_are_many(spark, tmp_path):
    """And its rows are in order; of few buckets each is dealt by slices of heights."""
    held = Store(spark, f"file://{tmp_path}/s", bucket=10)
    held.ingest("many", 1, 0, 99, logs(spark, 1, range(100)), blocks(spark, 1, range(100)))
    files = sorted(tmp_path.glob("s/raw_records/**/*.parquet"))
    assert len(files) == 10
    for f in files:
        found = pq.ParquetFile(f).read(columns=["height"]).column("height").to_pylist()
        assert len(found) == 10 and found == sorted(found)
    assert held._slices([(1, 0, 9)]) == 4 and held._slices([(1, 0, 99)]) == 1
    assert heights(held.read("raw_records").select("height", "value")) == [(h, 1) for h in range(100)]


def test_shuffle_files_of_a_written_table_go(spark, tmp_path):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n for n in disk.getAllFiles().mkString("|").split("|") if "/shuffle_" in n}
    before = shuffled()
    kept = Scratch(spark, "tidy", lean=True).keep(spark.range(5000).groupBy((F.col("id") % 900).alias("k")).count(), "t")
    assert kept.count() == 900
    until = time.time() + 10
    while (left := {n for n in shuffled() - before if os.path.exists(n) and n.endswith(".data")}) and time.time() < until:
        time.sleep(0.2)
    # The count above has a shuffle of its own, of one row a task.
    assert sum(os.path.getsize(n) for n in left) < 1000 and spark.conf.get(scratch._TIDY, "false") == "false"


def test_wide_filter_pushes_bit_lengths(spark, tmp_path):
    from blockloom.functions import words as w
    from blockloom.operators import reads

    rows = spark.range(100).select(F.lit(1).cast("bigint").alias("chain_id"), F.col("id").alias("height"), F.lit(0).cast("bigint").alias("idx"), w.word(F.col("id") * 1000).alias("v"))
    evolve.with_bits(rows, ["v"]).write.parquet(f"{tmp_path}/wide")
    table = spark.read.parquet(f"{tmp_path}/wide")
    found = reads.select_events(table, QuerySpec("t", (Filter("v", "GTE", "64000"),)), reads.META_COLUMNS | {"v": "uint:256"})
    assert found.count() == 36
    assert "GreaterThanOrEqual(v_bits,16)" in found._jdf.queryExecution().executedPlan().toString()


def test_finalized_saturates_at_zero(spark):
    from blockloom.operators import reads

    heads = spark.createDataFrame([(1, 5), (2, 50)], "chain_id long, head long")
    waits = spark.createDataFrame([(1, 12), (2, 12)], "chain_id long, confirmations long")
    rows = logs(spark, 1, [0, 1]).unionByName(logs(spark, 2, [38, 39]))
    assert sorted((r["chain_id"], r["height"]) for r in reads.finalized(rows, heads, waits).collect()) == [(1, 0), (2, 38)]
