"""Additive evolution of typed tables to the catalog, and their layout for reads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Entry
from ..functions import words as w


class DestructiveChange(ValueError):
    """A column would be dropped or change its type."""


@dataclass(frozen=True)
class Change:
    kind: str  # create, add, drop, retype
    column: str
    wanted: str | None = None
    stored: str | None = None

    @property
    def destructive(self) -> bool:
        return self.kind in ("drop", "retype")


def diff(stored: T.StructType | None, wanted: T.StructType) -> list[Change]:
    """What would bring a stored table to the wanted schema; nothing if it is there."""
    if stored is None:
        return [Change("create", f.name, f.dataType.simpleString()) for f in wanted]
    have, want = ({f.name: f.dataType.simpleString() for f in s} for s in (stored, wanted))
    out = [Change("add", c, t) for c, t in want.items() if c not in have]
    out += [Change("drop", c, None, t) for c, t in have.items() if c not in want]
    return out + [Change("retype", c, t, have[c]) for c, t in want.items() if c in have and have[c] != t]


def evolve_read(table: DataFrame, wanted: T.StructType, allow_destructive: bool = False) -> DataFrame:
    """A stored table under the wanted schema: added columns are null until they are filled again; drops and casts only on request."""
    bad = [c for c in diff(table.schema, wanted) if c.destructive]
    if bad and not allow_destructive:
        raise DestructiveChange(", ".join(f"{c.kind} {c.column}" for c in bad))
    have = set(table.columns)
    return table.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted))


def additions(stored: T.StructType | None, written: T.StructType) -> list[T.StructField]:
    """Columns that a write adds to a table; a changed type is refused. A column that the write lacks is null in its rows."""
    bad = [c for c in diff(stored, written) if c.kind == "retype"] if stored is not None else []
    if bad:
        raise DestructiveChange(", ".join(f"{c.kind} {c.column}" for c in bad))
    have = set(stored.names) if stored is not None else set()
    return [T.StructField(f.name, f.dataType) for f in written if f.name not in have]


def wide_columns(entry: Entry) -> list[str]:
    """Unsigned columns of more than 120 bits, which are stored as words."""
    return [p.column for p in entry.params if p.logical.startswith("uint:") and int(p.logical[5:]) > 120]


def stored_schema(entry: Entry) -> T.StructType:
    """The entry's columns as the store writes them."""
    return T.StructType([*entry.schema().fields, *(T.StructField(f"{c}_bits", T.LongType()) for c in wide_columns(entry))])


def is_bits(column: str, schema: T.StructType) -> bool:
    """Whether a column is the bit length of another one."""
    base = column.removesuffix("_bits")
    return base != column and base in schema.names and isinstance(schema[base].dataType, T.BinaryType) and isinstance(schema[column].dataType, T.LongType)


def with_bits(rows: DataFrame, wide: Sequence[str]) -> DataFrame:
    """Adds ``<column>_bits`` of wide unsigned columns, which Parquet can filter by range."""
    return rows.withColumns({f"{c}_bits": w.bit_length(F.col(c)) for c in wide}) if wide else rows


#: Slices of a bucket that may be written by tasks of their own, where there are few buckets.
SLICES = 64
#: Sizes that a bloom filter is tried in, each half of the one before from 1 MB on; the smallest that holds a file's values is kept.
BLOOM_SIZES = 14


def dealt(rows: DataFrame, bucket: int, slices: int = SLICES) -> DataFrame:
    """``rows`` with their height bucket (hb), all of a bucket in one task; or, with ``slices``, those of a slice of its heights (_slice), so that a busy bucket gets many."""
    rows = rows.withColumn("hb", F.floor(F.col("height") / bucket).cast("bigint"))
    if slices <= 1:
        return rows.repartition("chain_id", "hb")
    # Of wide buckets, slices are joined by Spark where they are small.
    return rows.withColumn("_slice", F.floor(F.col("height") / max(1, bucket // slices)).cast("bigint")).repartition("chain_id", "hb", "_slice")


def dealt_by(rows: DataFrame) -> list[str]:
    return [c for c in ("chain_id", "hb", "_slice") if c in rows.columns]


def lay_out(rows: DataFrame, path: str, bucket: int, indexed: Sequence[str] = (), below: Sequence[str] = (), mode: str = "overwrite", slices: int = SLICES) -> None:
    """Writes by chain and height bucket, in order of height, with bloom filters on the join key and indexed columns.

    ``below`` are columns whose folders lie under the bucket's. Rows that were
    ``dealt`` before stay in their tasks; others are dealt here. Without bounds a
    bloom filter has a megabyte in each file, so it takes the size that its values need.
    """
    by_key = [c for c in ("height", "idx") if c in rows.columns]
    rows = rows if "hb" in rows.columns else dealt(rows, bucket, slices)
    laid = rows.sortWithinPartitions(*dealt_by(rows), *by_key).drop("_slice")
    writer = laid.write.mode(mode).partitionBy("chain_id", "hb", *below).option("compression", "zstd")
    writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.candidates.number", str(BLOOM_SIZES))
    for c in ("tx_id", *indexed):
        if c in rows.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.parquet(path)


def bucket_filter(bucket: int, lo: int | None, hi: int | None) -> Column:
    """Heights of a range; the bucket predicate comes with it, so files are pruned."""
    out = F.lit(True)
    if lo is not None:
        out &= (F.col("hb") >= lo // bucket) & (F.col("height") >= lo)
    if hi is not None:
        out &= (F.col("hb") <= hi // bucket) & (F.col("height") <= hi)
    return out
