"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are looked up apart: each holds more than this share of the rows, so there are no more than its inverse.
SHARE = 1 / 1000
#: Rows of a key that one task takes without trouble, however few rows there are in all; so few rows as a table may have to be joined as it is.
LEAST, FEW = 200, 5000


def free_name(wanted: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, in whatever case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def plain(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """``lookup`` of few rows: a left join as Spark makes it."""
    return rows.join(table, key, "left").select(*rows.columns, *(c for c in table.columns if c != key))


def lookup(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` left-joined to ``table``, in which each ``key`` is once; ``spread`` is a column that tells rows of one key apart.

    Keys with more than a thousandth of the rows are a thousand at most: what
    the table says of them is broadcast, whatever the size of the data. Their
    rows stay where they are dealt by ``spread``; all others meet the table in a
    sort-merge join. ``rows`` is read three times and should be a written table.
    """
    n = rows.count()
    if n <= FEW:
        return plain(rows, table, key, spread)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(LEAST, int(SHARE * n))).select(key)
    values = [c for c in table.columns if c != key]
    known = table.join(F.broadcast(hot), key, "left_semi")
    marked = rows.join(F.broadcast(known.select(key, F.lit(True).alias("_hot"), *(F.col(c).alias(f"_h_{c}") for c in values))), key, "left")
    # A hot row, or one without a key, has a salt that the table lacks, so it matches nothing and does not go where its key goes.
    salted = marked.withColumn("_salt", F.when(F.col("_hot") | F.col(key).isNull(), 1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20))).otherwise(F.lit(0).cast("bigint")))
    cold = table.withColumn("_salt", F.lit(0).cast("bigint"))
    out = salted.join(cold, [key, "_salt"], "left")
    return out.select(*rows.columns, *(F.when(F.col("_hot"), F.col(f"_h_{c}")).otherwise(F.col(c)).alias(c) for c in values))


def salted(rows: DataFrame, table: DataFrame, key: str, spread: str, salts: int = 64) -> DataFrame:
    """``lookup`` of what is too large to be broadcast: rows of keys with more than a thousandth of all rows are dealt in ``salts`` parts, each with a copy of what the table says.

    Such keys are a thousand at most, so the copies have a bound that does not
    grow with the rows; only the keys are broadcast. ``rows`` is read three
    times and should be a written table.
    """
    n = rows.count()
    if n <= FEW:
        return plain(rows, table, key, spread)
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(LEAST, int(SHARE * n))).select(key, F.lit(True).alias("_hot"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(0)).drop("_hot")
    copies = table.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    copies = copies.withColumn("_salt", F.col("_salt").cast("bigint"))
    return dealt.withColumn("_salt", F.col("_salt").cast("bigint")).join(copies, [key, "_salt"], "left").select(*rows.columns, *(c for c in table.columns if c != key))
