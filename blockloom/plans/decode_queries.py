"""Queries on landing, the catalog, decoding and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import catalog_frame, read_abi, union_catalogs
from ..functions import words as w
from ..operators import decode, reads
from ..scratch import Scratch
from ..sources import landing
from . import sample as s
from .sample import BLOCKS, EVENTS, ORDERS, hex_of

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def _hex(n):
    return F.concat(F.lit("0x"), F.lower(F.hex(n)))


# --- landing ----------------------------------------------------------------


@query("land_logs", f"WITH {EVENTS} SELECT chain_id, height, idx, {hex_of('tx')} AS tx_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE idx // 2 END AS tx_index, len(event_type) AS data_bytes FROM ev WHERE event_id % 9 <> 5")
def land_logs(spark: SparkSession, d: str) -> DataFrame:
    """Log lines in JSON, of which some lack a required field or an optional one."""
    e = s.events(spark, d)
    line = F.to_json(F.struct(
        _hex(w.address_word(F.col("chain_id"))).alias("address"), F.array(_hex(w.word(F.col("user_id")))).alias("topics"), _hex(F.encode("event_type", "UTF-8")).alias("data"),
        _hex(F.col("height")).alias("blockNumber"), _hex(s.block_hash(F.col("height"))).alias("blockHash"), F.when(F.col("event_id") % 9 != 5, _hex(F.col("idx"))).alias("logIndex"),
        _hex(w.word(F.col("tx"))).alias("transactionHash"), F.when(F.col("event_id") % 4 != 0, _hex(F.expr("idx div 2"))).alias("transactionIndex"),
    ))
    landed = landing.land_logs(landing.parse(e.select("chain_id", line.alias("value")), landing.LOG))
    return landed.select("chain_id", "height", "idx", w.hex_encode(F.col("tx_id")).alias("tx_id"), "tx_index", F.octet_length("data").alias("data_bytes"))


@query("land_blocks", f"WITH {ORDERS} SELECT chain_id, height, idx, {hex_of('o_orderkey')} AS tx_id, CAST(cents AS VARCHAR) AS value, '0x' || sha256(CAST(height AS VARCHAR)) AS block_hash FROM tx")
def land_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Full blocks in JSON, their transactions in order."""
    o = s.table(spark, d, "orders").withColumns({"height": F.expr("o_orderkey div 5"), "cents": F.round(F.col("o_totalprice") * 100).cast("bigint")})
    tx = F.struct(_hex(w.word(F.col("o_orderkey"))).alias("hash"), _hex(w.address_word(F.col("o_custkey"))).alias("from"), _hex(F.col("cents")).alias("value"), F.lit("0x").alias("input"), F.lit("0x5208").alias("gas"), F.lit("0x1").alias("nonce"))
    full = o.groupBy("height").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", tx.alias("t")))), lambda x: x["t"]).alias("transactions"))
    line = F.to_json(F.struct(_hex(F.col("height")).alias("number"), _hex(s.block_hash(F.col("height"))).alias("hash"), _hex(s.block_hash(F.col("height") - 3)).alias("parentHash"), F.lit("0x65920080").alias("timestamp"), "transactions"))
    landed = landing.land_transactions(landing.parse(full.select(F.expr("height % 3 + 1").alias("chain_id"), line.alias("value")), landing.BLOCK))
    return landed.select("chain_id", "height", "idx", w.hex_encode(F.col("tx_id")).alias("tx_id"), w.uint256_text(F.col("value")).alias("value"), w.hex_encode(F.col("block_hash")).alias("block_hash"))


@query("land_receipts", f"""WITH {EVENTS}, {ORDERS}, loc AS (SELECT chain_id, tx, min(height) AS height FROM ev GROUP BY chain_id, tx)
SELECT tx.chain_id, coalesce(loc.height, 0) AS height, {hex_of('o_orderkey')} AS tx_id, o_orderstatus = 'F' AS ok, CAST(o_custkey AS VARCHAR) AS gas_used
FROM tx LEFT JOIN loc ON loc.chain_id = tx.chain_id AND loc.tx = o_orderkey WHERE o_orderstatus <> 'P'""")
def land_receipts(spark: SparkSession, d: str) -> DataFrame:
    o = s.table(spark, d, "orders").where("o_orderstatus <> 'P'")
    line = F.to_json(F.struct(_hex(w.word(F.col("o_orderkey"))).alias("transactionHash"), F.when(F.col("o_orderstatus") == "F", "0x1").otherwise("0x0").alias("status"), _hex(F.col("o_custkey")).alias("gasUsed"), F.lit("0x1").alias("effectiveGasPrice")))
    lines = o.select(F.expr("(o_orderkey div 5) % 3 + 1").alias("chain_id"), line.alias("value"))
    landed = landing.land_receipts(landing.parse(lines, landing.RECEIPT), s.logs(spark, d))
    return landed.select("chain_id", "height", w.hex_encode(F.col("tx_id")).alias("tx_id"), F.col("status").alias("ok"), w.uint256_text(F.col("gas_used")).alias("gas_used"))


@query("calldata_for_logs", f"""WITH {EVENTS}, {ORDERS}
SELECT chain_id, {hex_of('o_orderkey')} AS tx_id, CASE WHEN o_orderkey % 4 = 3 THEN '0x' ELSE {hex_of('o_orderkey % 4', 40)} END AS to_addr, idx, CASE WHEN o_orderkey % 7 = 0 THEN 2 ELSE 68 END AS input_bytes
FROM tx WHERE o_orderkey IN (SELECT tx FROM ev)""")
def calldata_for_logs(spark: SparkSession, d: str) -> DataFrame:
    held = landing.calldata(s.transactions(spark, d), s.logs(spark, d))
    return held.select("chain_id", w.hex_encode(F.col("tx_id")).alias("tx_id"), w.hex_encode(F.col("to_addr")).alias("to_addr"), "idx", F.octet_length("input").alias("input_bytes"))


@query("matched_txs", f"WITH {EVENTS}, {ORDERS} SELECT chain_id, height, {hex_of('o_orderkey')} AS tx_id FROM tx WHERE o_orderkey IN (SELECT tx FROM ev WHERE event_type = 'purchase')")
def matched_txs(spark: SparkSession, d: str) -> DataFrame:
    bought = s.logs(spark, d).where(decode.selector0() == F.lit(s.TOPICS["purchase"]))
    return landing.matched_transactions(s.transactions(spark, d), bought).select("chain_id", "height", w.hex_encode(F.col("tx_id")).alias("tx_id"))


@query("chain_heads", f"WITH {EVENTS} SELECT chain_id, max(height) AS head, CAST(floor(epoch(max(ts))) AS BIGINT) AS at FROM ev GROUP BY chain_id")
def chain_heads(spark: SparkSession, d: str) -> DataFrame:
    heads = s.events(spark, d).select("chain_id", F.col("height").alias("head"), "ts")
    return landing.chain_heads(heads).select("chain_id", "head", F.unix_timestamp("ts").alias("at"))


# --- catalog and routing ----------------------------------------------------

_USED = "SELECT event_type, count(*) AS logs FROM events GROUP BY event_type"
_COLUMNS = "(VALUES (0, 'user_id', 'uint:256', 'binary', true), (1, 'cents', 'uint:256', 'binary', false), (2, 'props', 'utf8', 'string', false)) c(position, column_name, logical, spark_type, indexed)"


@query("abi_catalog", f"""SELECT 'evt_shop_' || event_type AS table_name, upper(event_type[1]) || event_type[2:] || '(uint256,uint256,string)' AS signature, position, column_name, logical, spark_type, indexed, logs
FROM ({_USED}) u, {_COLUMNS} WHERE event_type <> 'error'""")
def abi_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Each column of the catalog with the logs that it decodes."""
    used = s.logs(spark, d).groupBy(decode.selector0().alias("key")).agg(F.count(F.lit(1)).alias("logs"))
    return catalog_frame(spark, s.SHOP).join(used, "key").select(F.col("table").alias("table_name"), "signature", "position", F.col("column").alias("column_name"), "logical", "spark_type", "indexed", "logs")


@query("catalog_union", f"""WITH {EVENTS} SELECT chain_id, 'evt_shop_' || event_type AS table_name, 3 AS columns, count(*) AS logs FROM ev WHERE event_type <> 'error' GROUP BY chain_id, event_type""")
def catalog_union(spark: SparkSession, d: str) -> DataFrame:
    """Three chains' catalogs, one definition a table, and the logs of each."""
    other = read_abi([{"type": "event", "name": "View", "inputs": []}], "shop")
    merged = union_catalogs(catalog_frame(spark, s.SHOP), catalog_frame(spark, other), catalog_frame(spark, s.SHOP))
    tables = merged.groupBy("table", "key").agg(F.count("column").cast("int").alias("columns"))
    used = s.logs(spark, d).groupBy("chain_id", decode.selector0().alias("key")).agg(F.count(F.lit(1)).alias("logs"))
    return used.join(F.broadcast(tables), "key").select("chain_id", F.col("table").alias("table_name"), "columns", "logs")


@query("route_events", f"WITH {EVENTS} SELECT chain_id, height, idx, 'evt_shop_' || event_type AS table_name FROM ev WHERE event_type <> 'error' AND event_id % 13 > 1")
def route_events(spark: SparkSession, d: str) -> DataFrame:
    """Of thirteen logs one has no selector and one a short one."""
    odd = F.when((F.col("height") * 10 + F.col("idx")) % 13 == 0, F.array().cast("array<binary>")).when((F.col("height") * 10 + F.col("idx")) % 13 == 1, F.array(F.unhex(F.lit("0102030405060708")))).otherwise(F.col("selectors"))
    return decode.route_events(s.logs(spark, d).withColumn("selectors", odd), s.SHOP).select("chain_id", "height", "idx", F.col("table").alias("table_name"))


@query("unrouted_logs", f"WITH {EVENTS} SELECT chain_id, height, idx FROM ev WHERE event_type = 'error'")
def unrouted_logs(spark: SparkSession, d: str) -> DataFrame:
    return decode.unrouted_logs(s.logs(spark, d), s.SHOP).select("chain_id", "height", "idx")


# --- decoding ---------------------------------------------------------------


def decoded(spark: SparkSession, d: str) -> DataFrame:
    """All events of the shop in one frame, with their table: one pass over the logs, one layout."""
    (layout,) = decode.layouts(s.SHOP).values()
    return decode.decode_all(s.logs(spark, d), s.SHOP).where("reason IS NULL").select(*decode.META, "table", f"{layout}.*")


@query("decode_static_events", f"WITH {EVENTS} SELECT 'evt_shop_' || event_type AS table_name, chain_id, height, idx, CAST(user_id AS VARCHAR) AS user_id, CAST(cents AS VARCHAR) AS cents FROM ev WHERE event_type <> 'error'")
def decode_static_events(spark: SparkSession, d: str) -> DataFrame:
    return decoded(spark, d).select(F.col("table").alias("table_name"), "chain_id", "height", "idx", w.uint256_text(F.col("user_id")).alias("user_id"), w.uint256_text(F.col("cents")).alias("cents"))


@query("decode_dynamic_string", f"WITH {EVENTS} SELECT chain_id, height, idx, props FROM ev WHERE event_type <> 'error'")
def decode_dynamic_string(spark: SparkSession, d: str) -> DataFrame:
    return decoded(spark, d).select("chain_id", "height", "idx", "props")


_MOST = 2**31 - 1


@query("decode_quarantine", f"""WITH {EVENTS}
SELECT chain_id, height, idx, CASE WHEN event_id % 5 = 0 THEN 'topic count' ELSE 'data' END AS reason FROM ev WHERE event_type = 'purchase' AND (event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 IN (0, 1))""")
def decode_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Of the purchases every fifth has a topic too many, every seventh has its data cut short, and some an offset or a length of 2**31 - 1."""
    n = F.col("height") * 10 + F.col("idx")
    most = w.word(F.lit(_MOST))
    odd = F.when(n % 7 == 0, F.expr("substring(data, 1, length(data) - 32)")).when(n % 11 == 0, F.concat(F.expr("substring(data, 1, 32)"), most, F.expr("substring(data, 65)")))
    odd = odd.when(n % 11 == 1, F.concat(F.expr("substring(data, 1, 64)"), most, F.expr("substring(data, 97)"))).otherwise(F.col("data"))
    raw = s.logs(spark, d).withColumns({"selectors": F.when(n % 5 == 0, F.array_append("selectors", w.word(n))).otherwise(F.col("selectors")), "data": odd})
    # Written first, as logs are: else Spark would repeat these expressions wherever data is read.
    raw = Scratch(spark, "odd").keep(raw, "logs")
    return decode.quarantine(raw, s.SHOP[0]).select("chain_id", "height", "idx", "reason")


@query("decode_huge_counts", f"WITH {EVENTS} SELECT chain_id, height, idx, event_id % 4 > 0 AS quarantined, CASE WHEN event_id % 4 = 0 THEN '[\"' || user_id || '\"]' END AS items FROM ev")
def decode_huge_counts(spark: SparkSession, d: str) -> DataFrame:
    """An array whose count is right, 2**31 - 1 or 2**32 - 1, or whose offset is 2**31 - 1: all but the first are quarantined, and no job fails."""
    entry = read_abi([{"type": "event", "name": "Many", "inputs": [{"name": "items", "type": "uint256[]"}]}], "sample")[0]
    e = s.events(spark, d).withColumn("k", F.col("event_id") % 4)
    count = F.when(F.col("k") == 1, w.word(F.lit(_MOST))).when(F.col("k") == 2, w.word(F.lit(2**32 - 1))).otherwise(w.word(F.lit(1)))
    offset = F.when(F.col("k") == 3, w.word(F.lit(_MOST))).otherwise(w.word(F.lit(32)))
    raw = s.log_of(e, F.array(F.lit(entry.key)), F.concat(offset, count, w.word(F.col("user_id"))))
    held = decode.decode_all(Scratch(spark, "many").keep(raw, "logs"), [entry])
    return held.select("chain_id", "height", "idx", F.col("reason").isNotNull().alias("quarantined"), F.col("v0.items").alias("items"))


_WORDS = read_abi([{"type": "event", "name": "Words", "inputs": [{"name": "who", "type": "address"}, {"name": "flag", "type": "bool"}, {"name": "tag", "type": "bytes4"}, {"name": "delta", "type": "int64"}, {"name": "n", "type": "uint96"}]}], "sample")[0]


@query("decode_words", f"""WITH {EVENTS} SELECT chain_id, height, idx, {hex_of('user_id', 40)} AS who, event_id % 2 = 1 AS flag, '0x' || sha256(event_type)[:8] AS tag, 20000 - cents AS delta, CAST(CAST(cents AS HUGEINT) * 4294967296 AS VARCHAR) AS n FROM ev""")
def decode_words(spark: SparkSession, d: str) -> DataFrame:
    """Address, boolean, fixed bytes, a signed and an unsigned integer."""
    e = s.events(spark, d)
    delta = F.lit(20000) - F.col("cents")
    signed = F.unhex(F.when(delta < 0, F.lpad(F.hex(delta), 64, "F")).otherwise(F.lpad(F.hex(delta), 64, "0")))
    tag = F.concat(F.expr("substring(unhex(sha2(event_type, 256)), 1, 4)"), F.unhex(F.lit("00" * 28)))
    wide = F.unhex(F.concat(F.lpad(F.hex("cents"), 56, "0"), F.lit("0" * 8)))
    raw = s.log_of(e, F.array(F.lit(_WORDS.key)), F.concat(w.word(F.col("user_id")), w.word(F.col("event_id") % 2), tag, signed, wide))
    return decode.decode_events(raw, _WORDS).select("chain_id", "height", "idx", w.hex_encode(F.col("who")).alias("who"), "flag", w.hex_encode(F.col("tag")).alias("tag"), "delta", F.col("n").cast("string").alias("n"))


def wide_cents(spark: SparkSession, d: str) -> DataFrame:
    """events with big: cents times 2**96 as a word."""
    return s.events(spark, d).withColumn("big", F.unhex(F.concat(F.lpad(F.hex("cents"), 40, "0"), F.lit("0" * 24))))


_BIG = "CAST(cents AS HUGEINT) * CAST('79228162514264337593543950336' AS HUGEINT)"


@query("decode_uint256", f"WITH {EVENTS} SELECT chain_id, height, idx, CAST({_BIG} AS VARCHAR) AS value FROM ev")
def decode_uint256(spark: SparkSession, d: str) -> DataFrame:
    entry = read_abi([{"type": "event", "name": "Wide", "inputs": [{"name": "value", "type": "uint"}]}], "sample")[0]
    raw = s.log_of(wide_cents(spark, d), F.array(F.lit(entry.key)), F.col("big"))
    return decode.decode_events(raw, entry).select("chain_id", "height", "idx", w.uint256_text(F.col("value")).alias("value"))


@query("decode_array_json", f"""WITH {EVENTS}
SELECT chain_id, height, idx, CASE event_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN '["' || user_id || '"]' ELSE '["' || user_id || '","' || cents || '"]' END AS json,
  '[["' || user_id || '","0x' || lower(to_hex(encode(event_type))) || '"],"' || cents || '"]' AS nested FROM ev""")
def decode_array_json(spark: SparkSession, d: str) -> DataFrame:
    """A flat array on the JVM, a nested tuple by the Arrow UDF."""
    nested = {"name": "pair", "type": "tuple", "components": [{"name": "a", "type": "tuple", "components": [{"name": "n", "type": "uint256"}, {"name": "b", "type": "bytes"}]}, {"name": "c", "type": "uint256"}]}
    entry = read_abi([{"type": "event", "name": "Arrays", "inputs": [{"name": "items", "type": "uint256[]"}, nested]}], "sample")[0]
    e = s.events(spark, d).withColumn("n", F.col("event_id") % 3)
    items = F.concat(w.word(F.col("n")), F.when(F.col("n") > 0, w.word(F.col("user_id"))).otherwise(F.unhex(F.lit(""))), F.when(F.col("n") > 1, w.word(F.col("cents"))).otherwise(F.unhex(F.lit(""))))
    kind = F.encode("event_type", "UTF-8")
    pair = F.concat(w.word(F.lit(64)), w.word(F.col("cents")), w.word(F.col("user_id")), w.word(F.lit(64)), s.padded(kind))
    data = F.concat(w.word(F.lit(64)), w.word(F.lit(96) + 32 * F.col("n")), items, pair)
    return decode.decode_events(s.log_of(e, F.array(F.lit(entry.key)), data), entry).select("chain_id", "height", "idx", F.col("items").alias("json"), F.col("pair").alias("nested"))


@query("decode_indexed_hash", f"WITH {EVENTS} SELECT chain_id, height, idx, '0x' || sha256(event_type) AS label_hash, CAST(cents AS VARCHAR) AS value FROM ev")
def decode_indexed_hash(spark: SparkSession, d: str) -> DataFrame:
    entry = read_abi([{"type": "event", "name": "Named", "inputs": [{"name": "label", "type": "string", "indexed": True}, {"name": "value", "type": "uint256"}]}], "sample")[0]
    raw = s.log_of(s.events(spark, d), F.array(F.lit(entry.key), F.unhex(F.sha2("event_type", 256))), w.word(F.col("cents")))
    return decode.decode_events(raw, entry).select("chain_id", "height", "idx", w.hex_encode(F.col("label_hash")).alias("label_hash"), w.uint256_text(F.col("value")).alias("value"))


@query("decode_calls", f"WITH {ORDERS} SELECT chain_id, height, idx, {hex_of('o_orderkey')} AS tx_id, {hex_of('o_custkey', 40)} AS recipient, CAST(cents AS VARCHAR) AS amount FROM tx WHERE o_orderkey % 4 = 1 AND o_orderkey % 7 <> 0")
def decode_calls(spark: SparkSession, d: str) -> DataFrame:
    held = decode.decode_calls(s.transactions(spark, d), s.CALLS[0])
    return held.select("chain_id", "height", "idx", w.hex_encode(F.col("tx_id")).alias("tx_id"), w.hex_encode(F.col("to")).alias("recipient"), w.uint256_text(F.col("amount")).alias("amount"))


@query("stamp_block_time", f"WITH {EVENTS}, {BLOCKS} SELECT ev.chain_id, ev.height, ev.idx, CASE WHEN ev.height % 7 <> 0 THEN time END AS at FROM ev JOIN bl ON bl.chain_id = ev.chain_id AND bl.height = ev.height WHERE event_type <> 'error'")
def stamp_block_time(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh block is missing; its rows keep no time."""
    held = decode.stamp_block_time(decoded(spark, d), s.blocks(spark, d).where("height % 7 <> 0"))
    return held.select("chain_id", "height", "idx", F.unix_timestamp("block_time").alias("at"))


# --- scalar functions -------------------------------------------------------


@query("hex_encode", "SELECT event_id, '0x' || lower(to_hex(encode(props))) AS h FROM events")
def hex_encode(spark: SparkSession, d: str) -> DataFrame:
    return s.table(spark, d, "events").select("event_id", w.hex_encode(F.encode("props", "UTF-8")).alias("h"))


@query("hex_decode_strict", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type END AS back FROM events")
def hex_decode_strict(spark: SparkSession, d: str) -> DataFrame:
    """With prefix, without, with a digit missing, with a wrong one."""
    h = F.hex(F.encode("event_type", "UTF-8"))
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(F.lit("0x"), h)).when(k == 1, F.lower(h)).when(k == 2, F.concat(h, F.lit("a"))).otherwise(F.concat(h, F.lit("zz")))
    return s.table(spark, d, "events").select("event_id", F.decode(w.hex_decode(text), "UTF-8").alias("back"))


_CASES = "('actionTreeRoot', 'actionID', 'URLValue', 'already_snake', 'amount0', '_Odd--Name_')"


@query("snake_case", r"""SELECT p_partkey, trim(lower(regexp_replace(regexp_replace(regexp_replace(x, '[^A-Za-z0-9]+', '_', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g'), '([A-Z])([A-Z][a-z])', '\1_\2', 'g')), '_') AS snake
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand || p_type || 'HTTPServer' ELSE 'part' || p_type || 'ID' || p_size END AS x FROM part)""")
def snake_case(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat("p_brand", "p_type", F.lit("HTTPServer"))).otherwise(F.concat(F.lit("part"), "p_type", F.lit("ID"), "p_size"))
    return s.table(spark, d, "part").select("p_partkey", w.snake_case(name).alias("snake"))


@query("valid_ident", "SELECT p_partkey, regexp_full_match(x, '[a-z_][a-z0-9_]{0,62}') AS ok FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN p_size || 'abc' ELSE repeat('x', 60 + p_size % 7) END AS x FROM part)")
def valid_ident(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.replace("p_name", F.lit(" "), F.lit("_"))).when(k == 2, F.concat("p_size", F.lit("abc"))).otherwise(F.repeat(F.lit("x"), (60 + F.col("p_size") % 7).cast("int")))
    return s.table(spark, d, "part").select("p_partkey", w.valid_ident(name).alias("ok"))


@query("unframe_selectors", f"WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 0 ELSE 2 END AS parts, CASE WHEN event_id % 6 <> 0 THEN '0x' || lower(to_hex(encode(event_type))) END AS last FROM ev")
def unframe_selectors(spark: SparkSession, d: str) -> DataFrame:
    """Two framed parts with a truncated tail after every third, or an empty blob."""
    e = s.events(spark, d)
    framed = w.frame_selectors(F.array(w.word(F.col("user_id")), F.encode("event_type", "UTF-8")))
    blob = F.when(F.col("event_id") % 6 == 0, F.unhex(F.lit(""))).when(F.col("event_id") % 3 == 0, F.concat(framed, F.unhex(F.lit("20ffff")))).otherwise(framed)
    parts = w.unframe_selectors(F.col("blob"))
    return e.withColumn("blob", blob).select("event_id", parts.alias("p")).select("event_id", F.size("p").alias("parts"), w.hex_encode(F.try_element_at("p", F.lit(-1))).alias("last"))


@query("uint256_text", f"WITH {EVENTS} SELECT event_id, CAST({_BIG} AS VARCHAR) AS unsigned, CAST(-CAST(cents AS HUGEINT) AS VARCHAR) AS signed FROM ev")
def uint256_text(spark: SparkSession, d: str) -> DataFrame:
    e = wide_cents(spark, d)
    # Of no cents there is no sign to extend.
    negative = F.when(F.col("cents") == 0, w.word(F.lit(0))).otherwise(F.unhex(F.lpad(F.hex(-F.col("cents")), 64, "F")))
    return e.select("event_id", w.uint256_text(F.col("big")).alias("unsigned"), w.int256_text(negative).alias("signed"))


@query("row_json", f"""WITH {EVENTS} SELECT chain_id, {hex_of('tx')} AS tx_id,
  '{{"chain_id":' || chain_id || ',"height":' || height || ',"block_hash":"0x' || sha256(CAST(height AS VARCHAR)) || '","block_time":null,"tx_id":"' || {hex_of('tx')} || '","idx":' || idx || ',"address":"' || {hex_of('chain_id', 40)} || '","user_id":"' || user_id || '","cents":"' || cents || '","props":"' || replace(props, '"', '\\"') || '"}}' AS json
FROM ev WHERE event_type = 'purchase'""")
def row_json(spark: SparkSession, d: str) -> DataFrame:
    entry = s.SHOP[0]
    held = reads.row_json(decode.decode_events(s.logs(spark, d), entry), reads.columns_of(entry))
    return held.select("chain_id", w.hex_encode(F.col("tx_id")).alias("tx_id"), "json")


@query("cursor_codec", f"WITH {EVENTS} SELECT event_id, height || ':' || idx AS cursor, height || ':' || idx || ':' || chain_id AS over_chains, CASE WHEN event_id % 3 <> 2 THEN height END AS h, CASE WHEN event_id % 3 <> 2 THEN idx END AS i FROM ev")
def cursor_codec(spark: SparkSession, d: str) -> DataFrame:
    """Every third cursor is spoilt before it is read back."""
    e = s.events(spark, d).withColumns({"cursor": reads.format_cursor(F.col("height"), F.col("idx")), "over_chains": reads.format_cursor(F.col("height"), F.col("idx"), F.col("chain_id"))})
    back = reads.parse_cursor_column(F.when(F.col("event_id") % 3 == 2, F.concat(F.lit("x"), "cursor")).otherwise(F.col("cursor")))
    return e.withColumn("p", back).select("event_id", "cursor", "over_chains", F.col("p.height").alias("h"), F.col("p.idx").alias("i"))
