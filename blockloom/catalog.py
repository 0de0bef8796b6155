"""Contract interfaces as a catalog: which table, columns and types each event and function has."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of Keccak-f[1600]: rotations by x + 5 y, and the round constants.
_TURNS = (0, 1, 62, 28, 27, 36, 44, 6, 55, 20, 3, 10, 43, 25, 39, 41, 45, 15, 21, 8, 18, 2, 61, 56, 14)
_ROUNDS = (
    0x0000000000000001, 0x0000000000008082, 0x800000000000808A, 0x8000000080008000, 0x000000000000808B, 0x0000000080000001,
    0x8000000080008081, 0x8000000000008009, 0x000000000000008A, 0x0000000000000088, 0x0000000080008009, 0x000000008000000A,
    0x000000008000808B, 0x800000000000008B, 0x8000000000008089, 0x8000000000008003, 0x8000000000008002, 0x8000000000000080,
    0x000000000000800A, 0x800000008000000A, 0x8000000080008081, 0x8000000000008080, 0x0000000080000001, 0x8000000080008008,
)
_MASK = (1 << 64) - 1


def keccak256(data: bytes) -> bytes:
    """Keccak-256 with its original padding, as contract signatures use it; for a few signatures on the driver."""
    rate, a = 136, [0] * 25
    data += b"\x01" + bytes(-len(data) % rate or rate)[1:] if (len(data) + 1) % rate else b"\x01"
    block = bytearray(data)
    block[-1] |= 0x80
    for at in range(0, len(block), rate):
        for k in range(rate // 8):
            a[k] ^= int.from_bytes(block[at + 8 * k : at + 8 * k + 8], "little")
        for constant in _ROUNDS:
            c = [a[x] ^ a[x + 5] ^ a[x + 10] ^ a[x + 15] ^ a[x + 20] for x in range(5)]
            d = [c[x - 1] ^ ((c[(x + 1) % 5] << 1 | c[(x + 1) % 5] >> 63) & _MASK) for x in range(5)]
            b = [0] * 25
            for x in range(5):
                for y in range(5):
                    v, r = a[x + 5 * y] ^ d[x], _TURNS[x + 5 * y]
                    b[y + 5 * ((2 * x + 3 * y) % 5)] = (v << r | v >> (64 - r)) & _MASK if r else v
            a = [b[k] ^ (~b[(k + 1) % 5 + k // 5 * 5] & b[(k + 2) % 5 + k // 5 * 5]) for k in range(25)]
            a[0] ^= constant
    return b"".join(v.to_bytes(8, "little") for v in a[:4])


def snake(name: str) -> str:
    """``words.snake_case`` for one name."""
    plain = re.sub("[^A-Za-z0-9]+", "_", name)
    return re.sub("(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", plain).lower().strip("_")


@dataclass(frozen=True)
class Param:
    """A parameter: its column name, canonical type, whether it is indexed, and a tuple's components."""

    name: str
    type: str
    indexed: bool = False
    components: tuple["Param", ...] = ()

    @property
    def dynamic_topic(self) -> bool:
        """Whether an indexed value is stored as its hash: strings, bytes, arrays and tuples."""
        return self.type in ("string", "bytes") or self.type.endswith("]") or self.type.startswith("(")

    @property
    def column(self) -> str:
        return f"{self.name}_hash" if self.indexed and self.dynamic_topic else self.name

    @property
    def logical(self) -> str:
        """address, bool, bytes, utf8, json, uint:N or int:N."""
        if self.indexed and self.dynamic_topic:
            return "bytes"
        if self.type.endswith("]") or self.type.startswith("("):
            return "json"
        if m := re.fullmatch(r"(u?int)(\d*)", self.type):
            return f"{m[1]}:{m[2] or 256}"
        return {"address": "address", "bool": "bool", "string": "utf8"}.get(self.type, "bytes")


def spark_type(logical: str) -> T.DataType:
    """Integers of over 120 bits are 32-byte words whose byte order is their order."""
    kind, _, bits = logical.partition(":")
    if kind in ("uint", "int"):
        n = int(bits)
        return T.LongType() if n <= (63 if kind == "uint" else 64) else T.DecimalType(38, 0) if n <= 120 else T.BinaryType()
    return {"bool": T.BooleanType(), "utf8": T.StringType(), "json": T.StringType()}.get(kind, T.BinaryType())


META = T.StructType([
    T.StructField("chain_id", T.LongType()), T.StructField("height", T.LongType()), T.StructField("block_hash", T.BinaryType()),
    T.StructField("block_time", T.TimestampType()), T.StructField("tx_id", T.BinaryType()), T.StructField("idx", T.LongType()),
    T.StructField("address", T.BinaryType()),
])


@dataclass(frozen=True)
class Entry:
    """An event (with its first topic) or a function (with selector and contract)."""

    kind: str
    name: str
    table: str
    params: tuple[Param, ...]
    key: bytes
    to_addr: bytes | None = None

    @property
    def signature(self) -> str:
        return f"{self.name}({','.join(p.type for p in self.params)})"

    @property
    def primary_key(self) -> tuple[str, ...]:
        return ("chain_id", "height", "idx") if self.kind == "event" else ("chain_id", "tx_id")

    def schema(self) -> T.StructType:
        return T.StructType([*META.fields, *(T.StructField(p.column, spark_type(p.logical)) for p in self.params)])


def _params(inputs: Sequence[dict]) -> tuple[Param, ...]:
    out = []
    for k, x in enumerate(inputs):
        components = _params(x.get("components", ()))
        kind = x["type"]
        if kind.startswith("tuple"):
            kind = f"({','.join(c.type for c in components)}){kind[5:]}"
        kind = re.sub(r"^(u?int)(?=\[|$)", r"\g<1>256", kind)
        out.append(Param(snake(x.get("name") or "") or f"arg{k}", kind, bool(x.get("indexed")), components))
    return tuple(out)


def read_abi(abi: str | Sequence[dict], stem: str, events: Iterable[str] = (), functions: Iterable[str] = (), to_addr: bytes | None = None) -> list[Entry]:
    """Entries of an interface. ``events`` empty means all; ``functions`` empty means none. Tables are named by the file's stem."""
    out, events, functions = [], set(events), set(functions)
    for x in json.loads(abi) if isinstance(abi, str) else abi:
        name, params = x.get("name"), _params(x.get("inputs", ()))
        digest = keccak256(f"{name}({','.join(p.type for p in params)})".encode())
        if x.get("type") == "event" and not x.get("anonymous") and (not events or name in events):
            out.append(Entry("event", name, f"evt_{snake(stem)}_{snake(name)}", params, digest))
        elif x.get("type") == "function" and name in functions:
            out.append(Entry("call", name, f"call_{snake(stem)}_{snake(name)}", params, digest[:4], to_addr))
    return out


_ROWS = "kind string, name string, table string, signature string, key binary, to_addr binary, position int, column string, logical string, spark_type string, indexed boolean"


def catalog_frame(spark: SparkSession, entries: Sequence[Entry]) -> DataFrame:
    """A row per column of each entry; entries without parameters have one row with nulls."""
    rows = []
    for e in entries:
        for k, p in enumerate(e.params or (None,)):
            rows.append((e.kind, e.name, e.table, e.signature, bytearray(e.key), e.to_addr and bytearray(e.to_addr), *((k, p.column, p.logical, spark_type(p.logical).simpleString(), p.indexed) if p else (None,) * 5)))
    return spark.createDataFrame(rows, _ROWS)


def union_catalogs(*frames: DataFrame) -> DataFrame:
    """Catalogs of many chains, one definition a table: the first that has it."""
    numbered = None
    for k, f in enumerate(frames):
        f = f.withColumn("source", F.lit(k))
        numbered = f if numbered is None else numbered.unionByName(f, allowMissingColumns=True)
    first = Window.partitionBy("table")
    return numbered.withColumn("first_source", F.min("source").over(first)).where("source = first_source").drop("source", "first_source")
