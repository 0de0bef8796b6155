"""Landed JSON-RPC payloads as tables: logs, blocks with transactions, receipts, heads.

Each function takes a DataFrame of landed rows (batch or stream) and returns
the table and, where a field can be missing, what was refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as w

LOG = "address string, topics array<string>, data string, blockNumber string, blockHash string, logIndex string, transactionHash string, transactionIndex string, removed boolean"
TX = "hash string, `from` string, `to` string, value string, input string, gas string, gasPrice string, nonce string"
BLOCK = f"number string, hash string, parentHash string, timestamp string, transactions array<struct<{TX.replace(' string', ':string')}>>"
RECEIPT = "transactionHash string, blockHash string, status string, gasUsed string, effectiveGasPrice string, contractAddress string"
#: A log without one of these is refused.
REQUIRED = ("height", "block_hash", "idx", "tx_id")


def quantity(c: str):
    """A hex quantity of any width as a 32-byte word."""
    return F.unhex(F.lpad(F.regexp_replace(c, "^0x", ""), 64, "0"))


def height_of(c: str):
    return w.hex_long(F.col(c))


def bytes_of(c: str):
    return w.hex_decode(F.col(c))


def parse(lines: DataFrame, schema: str, *more: str) -> DataFrame:
    """Columns of JSON lines (chain_id, value), and ``more`` of the lines'; a malformed line has nulls."""
    return lines.select("chain_id", *more, F.from_json("value", schema).alias("v")).select("chain_id", *more, "v.*")


def _mapped(logs: DataFrame, *more: str) -> DataFrame:
    return logs.select(
        "chain_id",
        w.hex_long(F.col("blockNumber")).alias("height"),
        w.hex_long(F.col("logIndex")).alias("idx"),
        w.hex_decode(F.col("blockHash")).alias("block_hash"),
        w.hex_decode(F.col("address")).alias("address"),
        F.transform("topics", w.hex_decode).alias("selectors"),
        w.hex_decode(F.col("data")).alias("data"),
        w.hex_decode(F.col("transactionHash")).alias("tx_id"),
        F.coalesce(w.hex_long(F.col("transactionIndex")), F.lit(0)).alias("tx_index"),
        F.lit(None).cast("bigint").alias("inner_index"),
        F.coalesce("removed", F.lit(False)).alias("removed"),
        *more,
    )


def land_logs(logs: DataFrame, *more: str) -> DataFrame:
    """Raw records, with ``removed`` and ``more`` columns; logs lacking a required field are left to ``refused_logs``."""
    return _mapped(logs, *more).where(" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED))


def refused_logs(logs: DataFrame) -> DataFrame:
    return _mapped(logs).where(" OR ".join(f"{c} IS NULL" for c in REQUIRED))


def in_order(lines: DataFrame) -> DataFrame:
    """Lines (chain_id, value) with ``arrived``, by which a later line is known: their own column of that name, else their place."""
    return lines if "arrived" in lines.columns else lines.withColumn("arrived", F.monotonically_increasing_id())


def last_word(logs: DataFrame) -> DataFrame:
    """Each copy of a log once, as it was heard last: ``removed`` says whether that was its removal."""
    copy = ["chain_id", "height", "idx", "block_hash", "tx_id"]
    heard = logs.groupBy(*copy).agg(F.max_by(F.struct(*(c for c in logs.columns if c not in copy)), F.struct("arrived", "removed")).alias("last"))
    return heard.select(*copy, "last.*").select(logs.columns)


def still_there(logs: DataFrame) -> DataFrame:
    """Logs (with removed and arrived) of which the last that was heard is not their removal; once each, without ``removed``."""
    return last_word(logs).where("NOT removed").drop("removed")


def dead_blocks(words: DataFrame) -> DataFrame:
    """(chain_id, height, hash) of blocks of which every log was removed, by ``last_word``."""
    gone = words.groupBy("chain_id", "height", "block_hash").agg(F.every("removed").alias("gone"))
    return gone.where("gone").select("chain_id", "height", F.col("block_hash").alias("hash"))


def last_heard(logs: DataFrame) -> DataFrame:
    """Of several logs of one place the last to arrive; the result has no ``arrived``."""
    last = Window.partitionBy("chain_id", "height", "idx").orderBy(F.desc("arrived"), "tx_id")
    return logs.withColumn("_n", F.row_number().over(last)).where("_n = 1").select([c for c in logs.columns if c != "arrived"])


def land_blocks(blocks: DataFrame, *more: str) -> DataFrame:
    return blocks.select(*more, "chain_id", w.hex_long(F.col("number")).alias("height"), w.hex_decode(F.col("hash")).alias("hash"), w.hex_decode(F.col("parentHash")).alias("parent_hash"), w.hex_long(F.col("timestamp")).alias("time"))


def land_transactions(blocks: DataFrame) -> DataFrame:
    """The transactions of full blocks; the place in the block is idx, block time stays null."""
    each = blocks.select("chain_id", w.hex_long(F.col("number")).alias("height"), w.hex_decode(F.col("hash")).alias("block_hash"), F.posexplode("transactions").alias("at", "t"))
    return each.select(
        "chain_id", "height", "block_hash", F.lit(None).cast("timestamp").alias("block_time"), w.hex_decode(F.col("t.hash")).alias("tx_id"), F.col("at").cast("bigint").alias("idx"),
        w.hex_decode(F.col("t.from")).alias("from_addr"), w.hex_decode(F.col("t.to")).alias("to_addr"), quantity("t.value").alias("value"), w.hex_decode(F.col("t.input")).alias("input"),
        quantity("t.gas").alias("gas"), quantity("t.gasPrice").alias("gas_price"), quantity("t.nonce").alias("nonce"),
    )


def first_location(logs: DataFrame) -> DataFrame:
    """(chain_id, tx_id, height, block_hash) of each transaction's first log by (height, idx)."""
    first = F.min_by(F.struct("height", "block_hash"), F.struct("height", "idx"))
    return logs.groupBy("chain_id", "tx_id").agg(first.alias("at")).select("chain_id", "tx_id", "at.height", "at.block_hash")


def land_receipts(receipts: DataFrame, logs: DataFrame) -> DataFrame:
    """Receipts placed at their transaction's first matched log, else at height 0 with an empty hash.

    Of a transaction that was in several blocks, the receipt that names the log's block; one that names no block fits any.
    """
    held = receipts.select(
        "chain_id", w.hex_decode(F.col("blockHash")).alias("of_block"), w.hex_decode(F.col("transactionHash")).alias("tx_id"), (w.hex_long(F.col("status")) == 1).alias("status"),
        quantity("gasUsed").alias("gas_used"), quantity("effectiveGasPrice").alias("effective_gas_price"), w.hex_decode(F.col("contractAddress")).alias("contract_address"),
    )
    placed = held.join(first_location(logs), ["chain_id", "tx_id"], "left").where("of_block IS NULL OR block_hash IS NULL OR of_block = block_hash")
    return placed.select("chain_id", F.coalesce("height", F.lit(0).cast("bigint")).alias("height"), F.coalesce("block_hash", F.unhex(F.lit(""))).alias("block_hash"), F.lit(None).cast("timestamp").alias("block_time"), "tx_id", "status", "gas_used", "effective_gas_price", "contract_address")


def chain_heads(heads: DataFrame) -> DataFrame:
    """The latest head of each chain of (chain_id, head, ts)."""
    return heads.groupBy("chain_id").agg(F.max_by("head", F.struct("ts", "head")).alias("head"), F.max("ts").alias("ts"))


def matched_transactions(transactions: DataFrame, logs: DataFrame) -> DataFrame:
    """Transactions that a matched log is behind."""
    return transactions.join(logs.select("chain_id", "tx_id"), ["chain_id", "tx_id"], "left_semi")


def calldata(transactions: DataFrame, logs: DataFrame) -> DataFrame:
    """Input of the transactions behind logs: no recipient is an empty one, no place is 0."""
    return matched_transactions(transactions, logs).select("chain_id", "tx_id", F.coalesce("to_addr", F.unhex(F.lit(""))).alias("to_addr"), "input", F.coalesce("idx", F.lit(0).cast("bigint")).alias("idx"))
