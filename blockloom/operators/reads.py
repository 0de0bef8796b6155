"""Filtered, keyset-paginated reads of typed tables, with nested transactions and receipts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Entry
from ..functions import words as w

META_COLUMNS = {"chain_id": "int64", "height": "int64", "block_hash": "bytes", "block_time": "timestamp", "tx_id": "bytes", "idx": "int64", "address": "bytes"}
_OPS = {"EQ": "__eq__", "NE": "__ne__", "NEQ": "__ne__", "GT": "__gt__", "GTE": "__ge__", "LT": "__lt__", "LTE": "__le__"}
DEFAULT_FIRST, MOST_FIRST = 100, 1000


class BadQuery(ValueError):
    """A request that is refused before any job runs."""


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: str


@dataclass(frozen=True)
class QuerySpec:
    table: str
    filters: tuple[Filter, ...] = ()
    chain_id: int | None = None
    from_height: int | None = None
    to_height: int | None = None
    after: str | None = None
    first: int | None = None
    descending: bool = False
    with_transaction: bool = False
    with_receipt: bool = False


@dataclass
class Page:
    rows: list[T.Row] = field(default_factory=list)
    has_next: bool = False
    end_cursor: str | None = None


def format_cursor(height: Column, idx: Column, chain_id: Column | None = None) -> Column:
    """``h:i`` within a chain, ``h:i:c`` over several."""
    return F.concat_ws(":", height, idx, *(() if chain_id is None else (chain_id,)))


def parse_cursor(cursor: str) -> tuple[int, int, int | None]:
    """Height, place and, where the cursor is over several chains, chain."""
    if not (m := re.fullmatch(r"([+-]?\d+):([+-]?\d+)(?::([+-]?\d+))?", cursor)):
        raise BadQuery(f"bad cursor: {cursor}")
    found = tuple(int(x) if x is not None else None for x in m.groups())
    if any(x is not None and not -(1 << 63) <= x < 1 << 63 for x in found):
        raise BadQuery(f"bad cursor: {cursor}")
    return found


def parse_cursor_column(c: Column) -> Column:
    """struct(height, idx) of a cursor, null if it is malformed."""
    good = c.rlike("^[+-]?[0-9]+:[+-]?[0-9]+$")
    part = lambda k: F.split(c, ":")[k].try_cast("bigint")
    return F.when(good, F.struct(part(0).alias("height"), part(1).alias("idx")))


def clamp_first(first: int | None) -> int:
    return min(max(DEFAULT_FIRST if first is None else first, 1), MOST_FIRST)


def _hex(value: str) -> bytes:
    if not re.fullmatch(r"(0x)?([0-9a-fA-F]{2})*", value):
        raise BadQuery(f"bad hex: {value}")
    return bytes.fromhex(value.removeprefix("0x"))


def literal(value: str, logical: str) -> Column:
    """A typed literal of a filter's text; refused where it is malformed or the column is JSON."""
    kind, _, bits = logical.partition(":")
    if kind == "json":
        raise BadQuery("JSON columns cannot be filtered")
    if kind in ("int64", "uint", "int"):
        if not re.fullmatch(r"[+-]?\d+", value):
            raise BadQuery(f"bad integer: {value}")
        n, wide = int(value), kind != "int64" and int(bits) > 120
        if wide:
            low = 0 if kind == "uint" else -(1 << 255)
            if not low <= n < (1 << 256) + low:
                raise BadQuery(f"out of range: {value}")
            return F.lit((n - low).to_bytes(32))
        if kind == "int64" or int(bits) <= (63 if kind == "uint" else 64):
            if not -(1 << 63) <= n < 1 << 63:
                raise BadQuery(f"out of range: {value}")
            return F.lit(n).cast("bigint")
        if abs(n) >= 10**38:
            raise BadQuery(f"out of range: {value}")
        return F.lit(str(n)).cast("decimal(38,0)")
    if kind == "bool":
        if value not in ("true", "false"):
            raise BadQuery(f"bad boolean: {value}")
        return F.lit(value == "true")
    if kind in ("address", "bytes"):
        return F.lit(_hex(value))
    if kind == "timestamp":
        try:
            datetime.fromisoformat(value)
        except ValueError as bad:
            raise BadQuery(f"bad timestamp: {value}") from bad
        return F.lit(value).cast("timestamp")
    return F.lit(value)


def condition(f: Filter, columns: dict[str, str]) -> Column:
    """One comparison; a null never matches. Wide unsigned integers add a comparison of bit lengths if the table has them."""
    if f.column not in columns:
        raise BadQuery(f"unknown column: {f.column}")
    if f.op not in _OPS:
        raise BadQuery(f"unknown operator: {f.op}")
    return compare(F.col(f.column), f.op, literal(f.value, columns[f.column]))


def compare(c: Column, op: str, value: Column) -> Column:
    return getattr(c, _OPS[op])(value)


def index_key(c: Column, kind: T.DataType) -> Column:
    """Bytes in the order of a column's values, as an index holds them."""
    if isinstance(kind, T.BinaryType):
        return c
    if isinstance(kind, T.DecimalType):
        return F.encode(F.lpad((c.cast("decimal(38,0)") + F.lit("50000000000000000000000000000000000000").cast("decimal(38,0)")).cast("string"), 39, "0"), "UTF-8")
    if isinstance(kind, (T.LongType, T.TimestampType, T.BooleanType)):
        n = F.unix_micros(c) if isinstance(kind, T.TimestampType) else c.cast("bigint")
        # Turning the sign bit puts negative numbers first.
        return F.unhex(F.lpad(F.hex(n.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    return F.encode(c.cast("string"), "UTF-8")


def bits_prefilter(f: Filter, columns: dict[str, str]) -> Column | None:
    """A comparison on ``<column>_bits`` that Parquet can push down; the exact one still follows."""
    if not columns.get(f.column, "").startswith("uint") or int(columns[f.column].split(":")[1]) <= 120:
        return None
    bits, c = int(f.value).bit_length(), F.col(f"{f.column}_bits")
    found = {"EQ": c == bits, "GT": c >= bits, "GTE": c >= bits, "LT": c <= bits, "LTE": c <= bits}.get(f.op)
    return None if found is None else c.isNull() | found  # rows from before the table had bit lengths


def columns_of(entry: Entry) -> dict[str, str]:
    return META_COLUMNS | {p.column: p.logical for p in entry.params}


def predicate(spec: QuerySpec, columns: dict[str, str], stored: list[str] = ()) -> list[Column]:
    """All filters of a request, to be ANDed; no cursor."""
    out = [condition(f, columns) for f in spec.filters]
    out += [p for f in spec.filters if f"{f.column}_bits" in stored and (p := bits_prefilter(f, columns)) is not None]
    for name, op, value in (("chain_id", "__eq__", spec.chain_id), ("height", "__ge__", spec.from_height), ("height", "__le__", spec.to_height)):
        if value is not None:
            out.append(getattr(F.col(name), op)(value))
    return out


def keyset(after: str, descending: bool) -> Column:
    """Rows beyond a cursor in order of (height, idx, chain_id), spelt out so that height reaches the Parquet scan.

    A cursor without a chain is one within a single chain.
    """
    height, idx, chain = parse_cursor(after)
    beyond = (lambda c, x: F.col(c) < x) if descending else (lambda c, x: F.col(c) > x)
    tie = beyond("idx", idx)
    if chain is not None:
        tie |= (F.col("idx") == idx) & beyond("chain_id", chain)
    reached = F.col("height") <= height if descending else F.col("height") >= height
    return reached & (beyond("height", height) | tie)


def height_bounds(spec: QuerySpec) -> tuple[int | None, int | None]:
    """Lowest and highest height that a request can read, its cursor included."""
    lo, hi = spec.from_height, spec.to_height
    if spec.after is not None:
        height = parse_cursor(spec.after)[0]
        lo, hi = (lo, min(height, hi if hi is not None else height)) if spec.descending else (max(height, lo if lo is not None else height), hi)
    return lo, hi


def end_cursor(row: T.Row, spec: QuerySpec) -> str:
    """Where the next page goes on: with the chain, unless the request has a single one."""
    return ":".join(str(row[c]) for c in (("height", "idx") if spec.chain_id is not None else ("height", "idx", "chain_id")))


def select_events(table: DataFrame, spec: QuerySpec, columns: dict[str, str]) -> DataFrame:
    """Filtered rows, no order or limit."""
    conditions = predicate(spec, columns, table.columns)
    return table.where(reduce(and_, conditions)) if conditions else table


def page_rows(table: DataFrame, spec: QuerySpec, columns: dict[str, str]) -> DataFrame:
    """The rows of a page and one more, in order; ties across chains are ordered by chain."""
    rows = select_events(table, spec, columns)
    if spec.after is not None and spec.chain_id is None and parse_cursor(spec.after)[2] is None:
        raise BadQuery("a cursor over several chains names its chain")
    if spec.after is not None:
        rows = rows.where(keyset(spec.after, spec.descending))
    order = [F.col(c).desc() if spec.descending else F.col(c).asc() for c in ("height", "idx", "chain_id")]
    return rows.orderBy(*order).limit(clamp_first(spec.first) + 1)


def take_page(rows: DataFrame) -> DataFrame:
    """A page as a table of its own. It is read once, and has ``MOST_FIRST`` rows and one at most."""
    held = rows.collect()
    if len(held) > MOST_FIRST + 1:
        raise ValueError("not a page")
    return rows.sparkSession.createDataFrame(held, rows.schema)


def nest(page: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """``other`` joined on (chain_id, tx_id) as one nested column, null where there is no row.

    The page is one that ``take_page`` made, so broadcasting it is safe; what it matches is as small.
    """
    key = ["chain_id", "tx_id"]
    held = [c for c in other.columns if c not in ("hb", "write_id")]
    side = other.select(*key, F.struct(*held).alias(name))
    wanted = side.join(F.broadcast(page.select(*key).distinct()), key, "left_semi")
    return page.join(wanted, key, "left").select(*page.columns, name)


def read_page(table: DataFrame, spec: QuerySpec, columns: dict[str, str], transactions: DataFrame | None = None, receipts: DataFrame | None = None) -> Page:
    """One page on the driver: at most ``first`` rows, of which there are 1000 at most."""
    if spec.table == "receipts":
        raise BadQuery("receipts are read through their transactions")
    rows = page_rows(table, spec, columns)
    sides = [(o, name) for o, name, wanted in ((transactions, "transaction", spec.with_transaction), (receipts, "receipt", spec.with_receipt)) if wanted and o is not None]
    if sides:
        rows = take_page(rows)
        for other, name in sides:
            rows = nest(rows, other, name)
    order = [F.col(c).desc() if spec.descending else F.col(c).asc() for c in ("height", "idx", "chain_id")]
    held = rows.orderBy(*order).collect()
    first = clamp_first(spec.first)
    more = len(held) > first
    held = held[:first]
    return Page(held, more, end_cursor(held[-1], spec) if more else None)


def total_count(table: DataFrame, spec: QuerySpec, columns: dict[str, str]) -> int:
    """All rows that the filters let through, without page, order or joins."""
    return select_events(table, spec, columns).count()


def finalized(rows: DataFrame, heads: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Rows at or below head - confirmations of their chain, which is 0 at least."""
    limit = heads.join(confirmations, "chain_id").select("chain_id", F.greatest(F.col("head") - F.col("confirmations"), F.lit(0)).alias("limit"))
    return rows.join(F.broadcast(limit), "chain_id").where("height <= limit").select(rows.columns)


def record_filter(logs: DataFrame, addresses: list[bytes] = (), selectors: list[bytes] = ()) -> DataFrame:
    """Logs of any of the addresses and any of the first topics; an empty list means any."""
    if addresses:
        logs = logs.where(F.col("address").isin([F.lit(bytes(a)) for a in addresses]))
    if selectors:
        logs = logs.where(F.try_element_at("selectors", F.lit(1)).isin([F.lit(bytes(s)) for s in selectors]))
    return logs


def render(name: str, logical: str) -> Column:
    """A column as it stands in lossless JSON: bytes as hex, integers of the contract as text."""
    kind, _, bits = logical.partition(":")
    c = F.col(name)
    if kind in ("uint", "int"):
        if int(bits) <= 120:
            return c.cast("string")
        return w.uint256_text(c) if kind == "uint" else w.int256_text(w.sort_key(c, signed=True))
    return w.hex_encode(c) if kind in ("bytes", "address") else c


def row_json(rows: DataFrame, columns: dict[str, str], has_idx: bool = True) -> DataFrame:
    """chain_id, tx_id and the whole row as JSON; receipts have no idx."""
    fields = [render(c, t).alias(c) for c, t in columns.items() if has_idx or c != "idx"]
    return rows.select("chain_id", "tx_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
