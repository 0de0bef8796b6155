"""Pages and lookups of stored tables read as few buckets as they need."""

import re

import pytest
from pyspark.sql import functions as F

from blockloom.catalog import read_abi
from blockloom.functions import words as w
from blockloom.operators import reads
from blockloom.operators.reads import Filter, QuerySpec
from blockloom.operators.store import Store

INPUTS = [{"name": "user", "type": "uint256", "indexed": True}, {"name": "level", "type": "int64", "indexed": True}, {"name": "to", "type": "address", "indexed": True}, {"name": "value", "type": "uint256"}]
EVENT = read_abi([{"type": "event", "name": "Move", "inputs": INPUTS}], "app")[0]
BUCKET = 10


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    """Forty buckets of ten heights in two chains; user h // 50, level falling through zero; a row a height, of bucket 20 only one."""
    store = Store(spark, f"file://{tmp_path_factory.mktemp('pages')}/s", bucket=BUCKET)
    h = F.col("height")
    rows = spark.range(400).where("id < 200 OR id = 205 OR id >= 210").select(
        (F.col("id") % 2 + 1).alias("chain_id"), F.col("id").alias("height"), F.lit(b"h").alias("block_hash"), F.timestamp_seconds("id").alias("block_time"), w.word(F.col("id")).alias("tx_id"),
        F.lit(0).cast("bigint").alias("idx"), F.lit(b"\x01" * 20).alias("address"),
    ).select("*", w.word(F.expr("height div 50")).alias("user"), (200 - h).alias("level"), w.address_word(F.expr("height div 100")).alias("to"), w.word(h).alias("value"))
    tx = rows.select("chain_id", "height", "block_hash", "tx_id", F.col("value").alias("paid"))
    blocks = rows.select("chain_id", "height", F.col("block_hash").alias("hash"), F.col("block_hash").alias("parent_hash"), F.col("height").alias("time"))
    raw = rows.select("chain_id", "height", "idx", "block_hash", "tx_id")
    spans = [(c, lo, lo + 99) for c in (1, 2) for lo in range(0, 400, 100)]
    store.ingest_ranges("raw", spans, raw, blocks, {"transactions": tx, "receipts": tx.where("height % 3 = 0")})
    for k in range(4):
        store.put_tables(f"b{k}", [(c, 100 * k, 100 * k + 99) for c in (1, 2)], {EVENT.table: (rows.where((h >= 100 * k) & (h < 100 * k + 100)), EVENT)})
    return store


def found(page):
    return [r["height"] for r in page.orderBy("height", "chain_id").collect()]


def opened(spark, df):
    """Buckets that the table's scan is told to open."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = next(line for line in plan.splitlines() if "FileScan parquet" in line and f"/{EVENT.table}" in line).split("PartitionFilters: ")[1].split("]")[0]
    return sorted(map(int, re.findall(r"\d+", re.search(r"hb#\d+L (?:IN \(|INSET )([\d, ]+)", filters)[1])))


def test_a_page_takes_buckets_until_it_is_full(spark, held):
    first = held.events(EVENT, QuerySpec(EVENT.table, first=14))
    assert found(first) == list(range(15)) and opened(spark, first) == [0, 1]
    last = held.events(EVENT, QuerySpec(EVENT.table, first=14, descending=True))
    assert found(last) == list(range(385, 400)) and opened(spark, last) == [38, 39]
    # A filter leaves few rows a bucket: twice as many, until there are enough.
    some = held.events(EVENT, QuerySpec(EVENT.table, (Filter("value", "GTE", "95"),), first=9))
    assert found(some) == list(range(95, 105)) and opened(spark, some) == list(range(16))
    after = held.events(EVENT, QuerySpec(EVENT.table, chain_id=1, after="198:0", first=5))
    assert found(after) == [210, 212, 214, 216, 218, 220] and opened(spark, after)[0] == 19 and len(opened(spark, after)) <= 8
    assert found(held.events(EVENT, QuerySpec(EVENT.table, chain_id=7))) == []
    assert len(found(held.events(EVENT, QuerySpec(EVENT.table, first=1000)))) == 391
    assert found(held.events(EVENT, QuerySpec(EVENT.table, (Filter("value", "LT", "0"),), first=3))) == []


@pytest.mark.parametrize(
    "filters, wanted, buckets",
    [
        ((Filter("user", "EQ", "3"),), range(150, 200), list(range(15, 20))),
        ((Filter("user", "GT", "5"), Filter("user", "LT", "7")), range(300, 350), list(range(30, 35))),
        ((Filter("level", "LTE", "-190"),), range(390, 400), [39]),
        ((Filter("level", "GTE", "-5"), Filter("level", "LT", "4")), [197, 198, 199, 205], [19, 20]),
        ((Filter("to", "EQ", "0x" + (2).to_bytes(20).hex()), Filter("user", "EQ", "4")), [205, *range(210, 250)], list(range(20, 25))),
        ((Filter("user", "EQ", "77"),), [], []),
        ((Filter("user", "NE", "0"), Filter("user", "LTE", "1")), range(50, 100), list(range(10))),
    ],
)
def test_indexed_columns_name_their_buckets(held, filters, wanted, buckets):
    spec = QuerySpec(EVENT.table, filters)
    assert found(held.select(EVENT, spec)) == list(wanted)
    assert [b for b, _ in held.buckets(EVENT.table, EVENT, spec)] == buckets
    assert found(held.events(EVENT, QuerySpec(EVENT.table, filters, first=1000))) == list(wanted)


def test_side_tables_are_read_where_the_page_is(spark, held):
    spec = QuerySpec(EVENT.table, chain_id=2, from_height=100, first=10, with_transaction=True, with_receipt=True)
    rows = sorted((r["height"], int.from_bytes(r["transaction"]["paid"]), r["receipt"] is not None) for r in held.page(EVENT, spec).collect())
    assert rows == [(h, h, h % 3 == 0) for h in range(101, 123, 2)]
    spans = held._near(reads.take_page(held.events(EVENT, spec)))
    side = held.read_ranges("transactions", spans)
    assert sorted({int(f.split("/hb=")[1].split("/")[0]) for f in side.inputFiles() if "/transactions/" in f}) and "PartitionFilters" in side._jdf.queryExecution().executedPlan().toString()
    assert spans == [(2, 101, 109), (2, 111, 119), (2, 121, 121)] and held.spans_of(spans) == [(2, 101, 121)]
    assert held.spans_of([(1, 0, 5), (1, 300, 301), (2, 7, 8)]) == [(1, 0, 5), (1, 300, 301), (2, 7, 8)]


def test_counts_and_index_follow_rollbacks_and_compaction(spark, held):
    spec = QuerySpec(EVENT.table, (Filter("user", "EQ", "3"),))
    for c in (1, 2):
        held.compact(EVENT.table, c, f"packed-{c}")
    assert [b for b, _ in held.buckets(EVENT.table, EVENT, spec)] == list(range(15, 20))
    assert sum(n for _, n in held.buckets(EVENT.table)) == 391
    held.vacuum(EVENT.table, 0)
    assert found(held.select(EVENT, spec)) == list(range(150, 200))
    held.rollback("back", 2, 160)
    assert found(held.select(EVENT, spec)) == sorted([*range(150, 160), *range(160, 200, 2)])
    page = held.events(EVENT, QuerySpec(EVENT.table, chain_id=2, descending=True, first=3))
    assert found(page) == [153, 155, 157, 159]
