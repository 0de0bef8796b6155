"""The given tables as chain data: events are logs, orders are transactions, for queries and their SQL alike.

An event's height is its id div 10, its place the rest; three chains take turns
by height. Two events share a transaction, and an order's key is its number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Entry, keccak256, read_abi
from ..functions import words as w
from ..operators import rollups
from ..operators.store import Store
from ..scratch import Scratch

_INPUTS = [{"name": "userId", "type": "uint256", "indexed": True}, {"name": "cents", "type": "uint256"}, {"name": "props", "type": "string"}]
#: The interface of the shop; errors are left out, so their logs are unknown.
SHOP_ABI = [{"type": "event", "name": n, "inputs": _INPUTS} for n in ("Purchase", "View", "Click", "Signup")] + [
    {"type": "function", "name": "transfer", "inputs": [{"name": "to", "type": "address"}, {"name": "amount", "type": "uint256"}]},
]
SHOP: list[Entry] = read_abi(SHOP_ABI, "shop")
CALLS: list[Entry] = read_abi(SHOP_ABI, "shop", events=["none"], functions=["transfer"], to_addr=(1).to_bytes(20))
TOPICS = {e.name.lower(): e.key for e in SHOP} | {"error": keccak256(b"Unknown()")}
#: Heights of a sample batch.
BATCH = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with height, idx, chain_id, tx and cents."""
    e = table(spark, sf_dir, "events")
    return e.withColumns({
        "height": F.expr("event_id div 10"), "idx": F.col("event_id") % 10, "chain_id": F.expr("(event_id div 10) % 3 + 1"),
        "tx": F.expr("event_id div 2"), "cents": F.round(F.col("value") * 100).cast("bigint"),
    })


EVENTS = """ev AS (
  SELECT *, event_id // 10 AS height, event_id % 10 AS idx, (event_id // 10) % 3 + 1 AS chain_id, event_id // 2 AS tx,
    CAST(round(value * 100) AS BIGINT) AS cents
  FROM events
)"""


def first_topic(kind: Column) -> Column:
    out = F.lit(None).cast("binary")
    for name, key in TOPICS.items():
        out = F.when(kind == name, F.lit(key)).otherwise(out)
    return out


def block_hash(height: Column) -> Column:
    return F.unhex(F.sha2(height.cast("string"), 256))


def padded(b: Column) -> Column:
    """Length word and bytes filled up to whole words, as a dynamic value."""
    fill = F.pmod(-F.octet_length(b), F.lit(32))
    return F.concat(w.word(F.octet_length(b)), b, F.unhex(F.repeat(F.lit("00"), fill)))


def log_of(e: DataFrame, selectors: Column, data: Column) -> DataFrame:
    return e.select(
        "chain_id", "height", "idx", block_hash(F.col("height")).alias("block_hash"), w.address_word(F.col("chain_id")).alias("address"), selectors.alias("selectors"),
        data.alias("data"), w.word(F.col("tx")).alias("tx_id"), F.expr("idx div 2").alias("tx_index"), F.lit(None).cast("bigint").alias("inner_index"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw logs of the shop."""
    e = events(spark, sf_dir)
    body = F.concat(w.word(F.col("cents")), w.word(F.lit(64)), padded(F.encode("props", "UTF-8")))
    return log_of(e, F.array(first_topic(F.col("event_type")), w.word(F.col("user_id"))), body)


def hex_text(n: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(n)))


def log_lines(raw: DataFrame) -> DataFrame:
    """Raw logs as the JSON lines that they land as; ``removed`` is said where there is such a column."""
    said = [F.col("removed")] if "removed" in raw.columns else []
    line = F.to_json(F.struct(
        hex_text(F.col("address")).alias("address"), F.transform("selectors", hex_text).alias("topics"), hex_text(F.col("data")).alias("data"), hex_text(F.col("height")).alias("blockNumber"),
        hex_text(F.col("block_hash")).alias("blockHash"), hex_text(F.col("idx")).alias("logIndex"), hex_text(F.col("tx_id")).alias("transactionHash"), hex_text(F.col("tx_index")).alias("transactionIndex"), *said,
    ))
    return raw.withColumn("value", line)


def block_lines(held: DataFrame) -> DataFrame:
    """Blocks without transactions as JSON lines (chain_id, value)."""
    none = F.array().cast("array<struct<hash:string>>")
    return held.select("chain_id", F.to_json(F.struct(hex_text(F.col("height")).alias("number"), hex_text(F.col("hash")).alias("hash"), hex_text(F.col("parent_hash")).alias("parentHash"), hex_text(F.col("time")).alias("timestamp"), none.alias("transactions"))).alias("value"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block a height; its parent is the chain's block before, three heights below."""
    held = events(spark, sf_dir).groupBy("chain_id", "height").agg(F.min(F.unix_timestamp("ts")).alias("time"))
    return held.select("chain_id", "height", block_hash(F.col("height")).alias("hash"), block_hash(F.col("height") - 3).alias("parent_hash"), "time")


BLOCKS = "bl AS (SELECT chain_id, height, min(CAST(floor(epoch(ts)) AS BIGINT)) AS time FROM ev GROUP BY chain_id, height)"


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions; every seventh has calldata too short to name a function."""
    o = table(spark, sf_dir, "orders").withColumns({"height": F.expr("o_orderkey div 5"), "idx": F.col("o_orderkey") % 5, "cents": F.round(F.col("o_totalprice") * 100).cast("bigint")})
    call = F.concat(F.lit(CALLS[0].key), F.unhex(F.lit("00" * 12)), w.address_word(F.col("o_custkey")), w.word(F.col("cents")))
    return o.select(
        F.expr("height % 3 + 1").alias("chain_id"), "height", block_hash(F.col("height")).alias("block_hash"), F.lit(None).cast("timestamp").alias("block_time"), w.word(F.col("o_orderkey")).alias("tx_id"), "idx",
        w.address_word(F.col("o_custkey")).alias("from_addr"), F.when(F.col("o_orderkey") % 4 != 3, w.address_word(F.col("o_orderkey") % 4)).alias("to_addr"), w.word(F.col("cents")).alias("value"),
        F.when(F.col("o_orderkey") % 7 == 0, F.unhex(F.lit("a905"))).otherwise(call).alias("input"), w.word(F.lit(21000)).alias("gas"), w.word(F.col("o_custkey")).alias("nonce"),
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are not pending have a receipt."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    return o.select(F.expr("(o_orderkey div 5) % 3 + 1").alias("chain_id"), F.expr("o_orderkey div 5").alias("height"), w.word(F.col("o_orderkey")).alias("tx_id"), (F.col("o_orderstatus") == "F").alias("status"), w.word(F.col("o_custkey")).alias("gas_used"))


ORDERS = """tx AS (
  SELECT *, o_orderkey // 5 AS height, o_orderkey % 5 AS idx, (o_orderkey // 5) % 3 + 1 AS chain_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as logs whose keys repeat."""
    line = table(spark, sf_dir, "lineitem")
    return line.withColumns({"height": F.expr("l_orderkey div 10"), "idx": (F.col("l_orderkey") % 10) * 8 + F.col("l_linenumber"), "chain_id": F.expr("(l_orderkey div 10) % 3 + 1"), "cents": F.round(F.col("l_extendedprice") * 100).cast("bigint")})


LINES = """li AS (
  SELECT *, l_orderkey // 10 AS height, (l_orderkey % 10) * 8 + l_linenumber AS idx, (l_orderkey // 10) % 3 + 1 AS chain_id,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM lineitem
)"""


def ingests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed ranges of ``BATCH`` heights a chain; of eleven one is missing."""
    e = events(spark, sf_dir).withColumn("hb", F.expr(f"height div {BATCH}"))
    held = e.where("(hb + chain_id) % 11 <> 7").groupBy("chain_id", "hb").agg(F.max("height").alias("last_height"), F.count(F.lit(1)).alias("rows"))
    return held.select(
        F.expr("hb * 3 + chain_id").alias("commit_seq"), F.lit("ingest").alias("kind"), F.concat_ws("-", F.lit("b"), "chain_id", "hb").alias("batch_id"), F.concat_ws("-", F.lit("b"), "chain_id", "hb").alias("write_id"), F.lit(None).cast("string").alias("table"), "chain_id",
        F.expr(f"hb * {BATCH}").alias("from_height"), F.expr(f"hb * {BATCH} + {BATCH - 1}").alias("to_height"), "last_height", block_hash(F.col("last_height")).alias("last_hash"), "rows",
    )


def landed(spark: SparkSession, sf_dir: str, name: str) -> Store:
    """A store of the sample's logs and blocks in a shared folder of its own: all heights of the three chains as one batch of two ranges each."""
    store = Store(spark, Scratch(spark, name).path("store"), bucket=1000)
    raw, bl = logs(spark, sf_dir), blocks(spark, sf_dir)
    top = raw.agg(F.max("height")).first()[0]
    ranges = [r for c in (1, 2, 3) for r in ((c, 0, top // 2), (c, top // 2 + 1, top)) if r[1] <= r[2]] if top is not None else []
    if ranges:
        store.ingest_ranges("all", ranges, raw, bl)
    return store


_decoded: dict[tuple[str, str], Store] = {}


def decoded_store(spark: SparkSession, sf_dir: str) -> Store:
    """The sample, landed and decoded by the jobs: made once a session, for queries that only read it."""
    from . import jobs

    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _decoded:
        store = Store(spark, Scratch(spark, "decoded").path("store"), bucket=1000)
        if ranges := _all_heights(spark, sf_dir):
            store.ingest_ranges("all", ranges, logs(spark, sf_dir), blocks(spark, sf_dir))
            jobs.decode_pending(store, SHOP[:1])
        _decoded[key] = store
    return _decoded[key]


def sided_store(spark: SparkSession, sf_dir: str) -> Store:
    """``decoded_store`` with transactions and receipts, which a batch of their own lands when the first query asks for them."""
    store = decoded_store(spark, sf_dir)
    if not store.has("transactions") and (ranges := _all_heights(spark, sf_dir)):
        none = "chain_id IS NULL"
        aux = {"transactions": transactions(spark, sf_dir), "receipts": receipts(spark, sf_dir)}
        store.ingest_ranges("sides", ranges, logs(spark, sf_dir).where(none), blocks(spark, sf_dir).where(none), aux)
    return store


def _all_heights(spark: SparkSession, sf_dir: str) -> list[tuple[int, int, int]]:
    top = events(spark, sf_dir).agg(F.max("height")).first()[0]
    return [(c, 0, top) for c in (1, 2, 3)] if top is not None else []


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit log: ingests, the decodes of three in four (one in four of one table only), and a rollback of chain 2 in the middle of its heights."""
    held = ingests(spark, sf_dir)
    decoded = F.when(F.expr(f"(from_height div {BATCH}) % 4 = 3"), F.lit("evt_shop_view")).otherwise(F.lit("*"))
    decodes = held.withColumns({"kind": F.lit("decode"), "table": decoded, "write_id": F.lit(None).cast("string"), "commit_seq": F.col("commit_seq") + 1})
    back = held.where("chain_id = 2").groupBy("chain_id").agg(F.max("commit_seq").alias("top"), F.expr("max(to_height) div 2").alias("f"))
    back = back.select(F.expr("top - 5").alias("commit_seq"), F.lit("rollback").alias("kind"), F.lit("back-2").alias("batch_id"), F.lit(None).cast("string").alias("write_id"), F.lit(None).cast("string").alias("table"), "chain_id", F.col("f").alias("from_height"), F.lit(None).cast("bigint").alias("to_height"), F.lit(None).cast("bigint").alias("last_height"), F.lit(None).cast("binary").alias("last_hash"), F.lit(0).cast("bigint").alias("rows"))
    return held.unionByName(decodes).unionByName(back)


COMMITS = f"""ing AS (
  SELECT hb * 3 + chain_id AS commit_seq, chain_id, hb, hb * {BATCH} AS lo, hb * {BATCH} + {BATCH - 1} AS hi, max(height) AS last_height, count(*) AS n
  FROM (SELECT *, height // {BATCH} AS hb FROM ev) WHERE (hb + chain_id) % 11 <> 7 GROUP BY chain_id, hb
), back AS (
  SELECT chain_id, max(commit_seq) - 5 AS seq, max(hi) // 2 AS f FROM ing WHERE chain_id = 2 GROUP BY chain_id
)"""

#: Error messages of the sample call log, by event_id mod 6.
ERRORS = ("429 Too Many Requests", "request timed out", "503 Service Unavailable", "connection reset by peer", "query returned more than 10000 results", "execution reverted")
PROVIDERS = tuple(rollups.RATES)


def pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log of calls to three providers."""
    return events(spark, sf_dir).select(
        "event_id", "chain_id", "ts", pick(F.col("user_id") % 3, PROVIDERS).alias("provider"), pick(F.col("event_id") % 7, (*rollups.METHODS, "other")).alias("method"), (F.col("user_id") % 5).alias("count"),
        (F.col("value") / 100).alias("duration_s"), F.when(F.col("event_type") == "error", pick(F.col("event_id") % 6, ERRORS)).alias("error"),
    )


def _sql_pick(index: str, values: tuple[str, ...]) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_UNITS = " ".join(f"WHEN provider = '{card}' AND method = '{m}' THEN {u}" + (" * greatest(count, 1)" if m in rollups.BY_COUNT else "") for card, (units, _) in rollups.RATES.items() for m, u in zip(rollups.METHODS, units, strict=True))
CALL_LOG = f"""raw_calls AS (
  SELECT event_id, chain_id, ts, {_sql_pick('user_id % 3', PROVIDERS)} AS provider, {_sql_pick('event_id % 7', (*rollups.METHODS, 'other'))} AS method,
    user_id % 5 AS count, value / 100 AS duration_s, CASE WHEN event_type = 'error' THEN {_sql_pick('event_id % 6', ERRORS)} END AS error
  FROM ev
), unit_calls AS (
  SELECT *, CAST(CASE {_UNITS} ELSE 0 END AS BIGINT) AS units FROM raw_calls
), calls AS (
  SELECT *, CASE provider {' '.join(f"WHEN '{c}' THEN units * {num} // {den}" for c, (_, (num, den)) in rollups.RATES.items())} END AS micro_usd FROM unit_calls
)"""


def hex_of(c: str, width: int = 64) -> str:
    """SQL for a number as padded hex with 0x."""
    return f"'0x' || lpad(lower(to_hex({c})), {width}, '0')"
