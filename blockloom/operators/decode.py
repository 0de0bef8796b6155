"""Routing and decoding of raw logs and calldata by the catalog, as generated column expressions.

A log is routed on its first topic by a broadcast join to the catalog and each
entry's words become typed columns by ``substring``; nothing leaves the JVM but
nested arrays and tuples, which ``nested`` renders as JSON a batch at a time.
Logs that do not fit their entry go to quarantine, or fail the job with
``on_error="fail"``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Entry, Param
from ..functions import words as w
from .nested import head_words, json_udf

RAW = "chain_id long, height long, idx long, block_hash binary, address binary, selectors array<binary>, data binary, tx_id binary, tx_index long, inner_index long"


def selector0() -> Column:
    """First topic, null if there is none."""
    return F.try_element_at("selectors", F.lit(1))


def layouts(entries: Sequence[Entry]) -> dict[tuple[Param, ...], str]:
    """A name for each distinct list of event parameters; events that share one are decoded by the same expressions."""
    out: dict[tuple[Param, ...], str] = {}
    for e in entries:
        if e.kind == "event":
            out.setdefault(e.params, f"v{len(out)}")
    return out


def routes(logs: DataFrame, entries: Sequence[Entry]) -> DataFrame:
    """(key, table, event, layout) of the events, one a topic (the later entry wins), small enough to broadcast: it grows with interfaces, not with data."""
    held, named = {e.key: e for e in entries if e.kind == "event"}, layouts(entries)
    return logs.sparkSession.createDataFrame([(bytearray(k), e.table, e.name, named[e.params]) for k, e in held.items()], "key binary, table string, event string, layout string")


def route_events(logs: DataFrame, entries: Sequence[Entry]) -> DataFrame:
    """Logs of known events with table, event and layout; no selector, one of another length than 32 or an unknown one is skipped."""
    known = logs.where(F.octet_length(selector0()) == 32).withColumn("key", selector0())
    return known.join(F.broadcast(routes(logs, entries)), "key").drop("key")


def unrouted_logs(logs: DataFrame, entries: Sequence[Entry]) -> DataFrame:
    known = [bytearray(e.key) for e in entries if e.kind == "event"]
    return logs.where(~F.coalesce(selector0().isin([F.lit(bytes(k)) for k in known]), F.lit(False)))


# --- values -----------------------------------------------------------------


def static_value(word: Column, logical: str, kind: str) -> Column:
    base, _, bits = logical.partition(":")
    n = int(bits or 0)
    if base == "uint":
        return w.to_long(word) if n <= 63 else w.to_decimal(word) if n <= 120 else word
    if base == "int":
        if n <= 64:
            return w.to_signed_long(word)
        if n <= 120:
            return F.when(w.is_negative(word), w.to_decimal(word) - F.lit(str(1 << 120)).cast("decimal(38,0)")).otherwise(w.to_decimal(word)).cast("decimal(38,0)")
        return w.sort_key(word, signed=True)
    if base == "address":
        return w.to_address(word)
    if base == "bool":
        return w.to_bool(word)
    return w.to_bytes(word, int(kind[5:])) if kind.startswith("bytes") and kind[5:].isdigit() else word


def text_value(word: Column, kind: str) -> Column:
    """A word of an array as it stands in JSON: integers as text, bytes as hex."""
    if kind.startswith("uint"):
        return w.uint256_text(word)
    if kind.startswith("int"):
        return w.int256_text(word)
    if kind == "address":
        return w.hex_encode(w.to_address(word))
    if kind == "bool":
        return w.to_bool(word)
    return w.hex_encode(w.to_bytes(word, int(kind[5:])))


def _small(word: Column) -> Column:
    """An offset, length or count of up to 32 bits as a long, so that sums of them cannot overflow; null beyond, so that the row is quarantined."""
    return F.when(F.hex(F.substring(word, 1, 28)) == "0" * 56, F.conv(F.hex(F.substring(word, 29, 4)), 16, 10).try_cast("bigint"))


def _cut(data: Column, at: Column, size: Column | int) -> Column:
    """``size`` bytes from the ``at``-th on; null where a long goes beyond what bytes can have."""
    return F.substring(data, (at + 1).try_cast("int"), F.lit(size) if isinstance(size, int) else size.try_cast("int"))


def payload(data: Column, head: int) -> tuple[Column, Column]:
    """(bytes, whether they are all there) of a dynamic value whose offset is the head-th word."""
    at = _small(w.word_at(data, head))
    size = _small(_cut(data, at, 32))
    whole = (F.octet_length(w.word_at(data, head)) == 32) & (at + 32 <= F.octet_length(data)) & (at + 32 + size <= F.octet_length(data))
    return _cut(data, at + 32, size), F.coalesce(whole, F.lit(False))


def array_value(data: Column, p: Param, head: int) -> tuple[Column, Column]:
    """JSON text of a one-level array of static elements, and whether it is all there."""
    kind, _, held = p.type[:-1].rpartition("[")
    if held:
        n, start = F.lit(int(held)).cast("bigint"), F.lit(32 * head).cast("bigint")
    else:
        at = _small(w.word_at(data, head))
        n, start = _small(_cut(data, at, 32)), at + 32
    whole = F.coalesce(start + n * 32 <= F.octet_length(data), F.lit(False))
    element = lambda k: text_value(_cut(data, start + k * 32, 32), kind)
    # sequence(0, -1) counts down, so an empty array is a case of its own.
    items = F.when(whole & (n > 0), F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), element))
    return F.when(n == 0, F.lit("[]")).otherwise(F.to_json(items)), whole


def _is_flat_array(p: Param) -> bool:
    return p.type.endswith("]") and p.type.count("[") == 1 and not p.type.startswith(("(", "string", "bytes[")) and not p.type[: p.type.index("[")] == "bytes"


def columns_of(entry: Entry, data: Column, topics: Column | None) -> tuple[list[Column], Column]:
    """The entry's columns in order, and whether the log fits it."""
    out, fits, topic, head = [], F.lit(True), 2, 0
    for p in entry.params:
        if p.indexed and topics is not None:
            word = F.try_element_at(topics, F.lit(topic))
            topic += 1
            fits &= F.coalesce(F.octet_length(word) == 32, F.lit(False))
            value = word if p.dynamic_topic else static_value(word, p.logical, p.type)
            if p.logical.startswith(("uint", "int")):
                fits &= F.coalesce(value.isNotNull(), F.lit(False))
        elif p.type in ("string", "bytes"):
            body, whole = payload(data, head)
            fits &= whole
            value = F.decode(body, "UTF-8") if p.type == "string" else body
            head += 1
        elif _is_flat_array(p):
            value, whole = array_value(data, p, head)
            fits &= whole
            head += head_words(p)
        elif p.logical == "json":
            value = json_udf(p, head)(data)
            fits &= value.isNotNull()
            head += head_words(p)
        else:
            word = w.word_at(data, head)
            value = static_value(word, p.logical, p.type)
            fits &= (F.octet_length(word) == 32) & value.isNotNull()
            head += 1
        out.append(F.when(fits, value).alias(p.column) if p.type in ("string", "bytes") or p.logical == "json" else value.alias(p.column))
    if topics is not None:
        fits &= F.size(topics) == 1 + sum(p.indexed for p in entry.params)
    return out, fits


def decode_events(logs: DataFrame, entry: Entry, on_error: str = "quarantine", strict_address: bytes | None = None) -> DataFrame:
    """Typed rows of one event: meta columns, address, then the event's. Block time is null until it is stamped."""
    values, fits = columns_of(entry, F.col("data"), F.col("selectors"))
    mine = logs.where(selector0() == F.lit(entry.key))
    if strict_address is not None:
        mine = mine.where(F.col("address") == F.lit(strict_address))
    meta = ["chain_id", "height", "block_hash", F.lit(None).cast("timestamp").alias("block_time"), "tx_id", "idx", "address"]
    if on_error == "fail":
        good = F.when(fits, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("log does not fit its event at "), F.concat_ws(":", "height", "idx"))).cast("boolean"))
        return mine.where(good).select(*meta, *values)
    return mine.where(fits).select(*meta, *values)


def quarantine(logs: DataFrame, entry: Entry) -> DataFrame:
    """Logs of the event's topic that do not fit it, with the reason."""
    _, fits = columns_of(entry, F.col("data"), F.col("selectors"))
    topics = 1 + sum(p.indexed for p in entry.params)
    reason = F.when(F.size("selectors") != topics, F.lit("topic count")).otherwise(F.lit("data"))
    return logs.where((selector0() == F.lit(entry.key)) & ~fits).withColumn("table", F.lit(entry.table)).withColumn("reason", reason)


META = ["chain_id", "height", "block_hash", "block_time", "tx_id", "idx", "address"]


def decode_all(logs: DataFrame, entries: Sequence[Entry]) -> DataFrame:
    """All events in one pass over the logs: meta columns, table, reason (null where the log fits) and a struct of values for each layout, null but for the log's own."""
    routed, named = route_events(logs, entries), layouts(entries)
    reason, values = F.lit(None).cast("string"), []
    for params, name in named.items():
        mine = F.col("layout") == name
        entry = next(e for e in entries if e.params == params and e.kind == "event")
        # A Python function is called for every row, so it gets no bytes of other layouts.
        data = F.when(mine, F.col("data")) if any(p.logical == "json" for p in params) else F.col("data")
        columns, fits = columns_of(entry, data, F.col("selectors"))
        why = F.when(F.size("selectors") != 1 + sum(p.indexed for p in params), "topic count").otherwise("data")
        reason = F.when(mine, F.when(~fits, why)).otherwise(reason)
        if columns:
            values.append(F.when(mine & fits, F.struct(*columns)).alias(name))
    meta = [F.lit(None).cast("timestamp").alias(c) if c == "block_time" else c for c in META]
    return routed.select(*meta, "table", reason.alias("reason"), *values)


def typed_rows(decoded: DataFrame, entries: Sequence[Entry], entry: Entry) -> DataFrame:
    """One event's rows of ``decode_all`` under its own columns."""
    held = decoded.where((F.col("table") == entry.table) & F.col("reason").isNull())
    return held.select(*META, *([f"{layouts(entries)[entry.params]}.*"] if entry.params else []))


def decode_calls(transactions: DataFrame, entry: Entry) -> DataFrame:
    """Typed rows of one function's direct calls: routed on (to_addr, first four bytes), a row per transaction."""
    values, fits = columns_of(entry, F.expr("substring(input, 5)"), None)
    mine = transactions.where((F.octet_length("input") >= 4) & (F.substring("input", 1, 4) == F.lit(entry.key)))
    if entry.to_addr is not None:
        mine = mine.where(F.col("to_addr") == F.lit(entry.to_addr))
    return mine.where(fits).select("chain_id", "height", "block_hash", F.lit(None).cast("timestamp").alias("block_time"), "tx_id", "idx", F.col("to_addr").alias("address"), *values)


def stamp_block_time(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Fills block_time from ``blocks``; a row without a block keeps null."""
    times = blocks.select("chain_id", "height", F.timestamp_seconds("time").alias("stamped"))
    return rows.join(times, ["chain_id", "height"], "left").withColumn("block_time", F.col("stamped")).select(rows.columns)
