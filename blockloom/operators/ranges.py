"""Range planning, reorganisations and densities, for all chains at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def plan_ranges(spans: DataFrame, step: int) -> DataFrame:
    """(chain_id, lo, hi): each span (chain_id, next, target) in ranges of ``step``; none if target is below next."""
    starts = F.when(F.col("next") <= F.col("target"), F.sequence("next", "target", F.lit(step).cast("bigint")))
    return spans.select("chain_id", "target", F.explode(starts).alias("lo")).select("chain_id", "lo", F.least(F.col("lo") + step - 1, F.col("target")).alias("hi"))


def fetch_target(safe: Column, next_height: Column, step: int, concurrency: int, must_fetch: Column) -> Column:
    """One pipeline's worth of ranges when rows must be fetched, else all that is safe."""
    return F.when(must_fetch, F.least(safe, next_height + step * concurrency - 1)).otherwise(safe)


#: Heights of a prefix-sum bucket: what a lookup reads at most.
_BUCKET = 64


def _prefix_sums(heights: DataFrame, spans: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Running counts inside buckets of heights, and every bucket with the count before it.

    No window holds more than a bucket's heights or a chain's buckets.
    """
    hb = F.floor(F.col("height") / _BUCKET).cast("bigint").alias("hb")
    counts = heights.select("chain_id", hb, "height", F.col("n").cast("bigint").alias("n"))
    inside = Window.partitionBy("chain_id", "hb").orderBy("height").rowsBetween(Window.unboundedPreceding, 0)
    sums = scratch.keep(counts.withColumn("upto", F.sum("n").over(inside)), "sums")
    totals = sums.groupBy("chain_id", "hb").agg(F.sum("n").alias("n"))
    edges = spans.select("chain_id", F.floor((F.col("lo") - 1) / _BUCKET).cast("bigint").alias("first"), F.floor(F.col("hi") / _BUCKET).cast("bigint").alias("last"))
    known = totals.select("chain_id", F.col("hb").alias("first"), F.col("hb").alias("last"))
    every = edges.unionByName(known).groupBy("chain_id").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("chain_id", F.explode(F.sequence("first", "last")).alias("hb"))
    before = Window.partitionBy("chain_id").orderBy("hb").rowsBetween(Window.unboundedPreceding, -1)
    buckets = every.join(totals, ["chain_id", "hb"], "left").select("chain_id", "hb", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias("before"))
    return sums, scratch.keep(buckets, "buckets")


def _span_counts(spans: DataFrame, sums: DataFrame, buckets: DataFrame) -> DataFrame:
    """Adds n, the records of each span: the running count at hi less that below lo."""
    ends = F.array(F.struct((F.col("lo") - 1).alias("x"), F.lit(-1).alias("sign")), F.struct(F.col("hi").alias("x"), F.lit(1).alias("sign")))
    points = spans.select("chain_id", "lo", "hi", F.explode(ends).alias("e")).select("chain_id", "lo", "hi", "e.x", "e.sign", F.floor(F.col("e.x") / _BUCKET).cast("bigint").alias("hb"))
    below = sums.select("chain_id", "hb", F.col("height").alias("h"), "upto")
    near = points.join(below, ["chain_id", "hb"], "left").groupBy("chain_id", "hb", "lo", "hi", "x", "sign").agg(F.max(F.when(F.col("h") <= F.col("x"), F.col("upto"))).alias("upto"))
    at = near.join(buckets, ["chain_id", "hb"]).select("chain_id", "lo", "hi", (F.col("sign") * (F.col("before") + F.coalesce("upto", F.lit(0).cast("bigint")))).alias("n"))
    return at.groupBy("chain_id", "lo", "hi").agg(F.sum("n").alias("n"))


def cap_ranges(heights: DataFrame, spans: DataFrame, cap: int) -> DataFrame:
    """(chain_id, lo, hi, n): spans halved until each has fewer than ``cap`` records or is one block.

    ``heights`` is (chain_id, height, n), each height once. The halving is a
    recursion over spans, at most log2 of the longest; each pass looks prefix
    sums up by joins on buckets of heights.
    """
    scratch = Scratch(heights.sparkSession, "ranges")
    open_, done, k = spans.select("chain_id", F.col("lo").cast("bigint"), F.col("hi").cast("bigint")).where("lo <= hi").distinct(), None, 0
    sums, buckets = _prefix_sums(heights, open_, scratch)
    while True:
        counted = scratch.keep(_span_counts(open_, sums, buckets), f"pass-{k}")
        ready = counted.where((F.col("n") < cap) | (F.col("lo") == F.col("hi")))
        done = ready if done is None else done.unionByName(ready)
        over = counted.where((F.col("n") >= cap) & (F.col("lo") < F.col("hi")))
        if not over.take(1):
            return done
        mid = F.expr("lo + (hi - lo) div 2")
        halves = F.array(F.struct("lo", mid.alias("hi")), F.struct((mid + 1).alias("lo"), F.col("hi")))
        open_ = over.select("chain_id", F.explode(halves).alias("r")).select("chain_id", "r.lo", "r.hi")
        k += 1


def reorg_detect(blocks: DataFrame, canonical: DataFrame, chains: DataFrame) -> DataFrame:
    """(chain_id, tip, from_height) of chains whose highest stored block is not the canonical one.

    ``chains`` is (chain_id, confirmations, supports_reorg). No row where reorgs
    are unsupported, nothing is stored, or the canonical hash is unknown.
    """
    top = blocks.groupBy("chain_id").agg(F.max_by(F.struct("height", "hash"), "height").alias("b")).select("chain_id", F.col("b.height").alias("tip"), F.col("b.hash").alias("stored"))
    known = canonical.select("chain_id", F.col("height").alias("tip"), F.col("hash").alias("canon"))
    joined = top.join(chains.where("supports_reorg"), "chain_id").join(known, ["chain_id", "tip"])
    return joined.where("canon <> stored").select("chain_id", "tip", (F.greatest(F.col("tip") - F.col("confirmations"), F.lit(0)) + 1).alias("from_height"))


def parent_mismatch(blocks: DataFrame) -> DataFrame:
    """Adjacent stored blocks whose parent hash is not the hash below them."""
    below = blocks.select("chain_id", (F.col("height") + 1).alias("height"), F.col("hash").alias("below"))
    return blocks.join(below, ["chain_id", "height"]).where("parent_hash <> below").select("chain_id", "height")


def log_density(ranges: DataFrame) -> DataFrame:
    """Logs per thousand blocks of each range (chain_id, lo, hi, n), integer floor."""
    return ranges.where("hi >= lo").withColumn("density_milli", F.expr("n * 1000 div (hi - lo + 1)"))


#: Weight of what came before, in eighths.
_KEPT, _WHOLE = 7, 8


def _carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last average of each chain, of rows by chain and in order; what is carried is one chain and one number."""
    chain, average = None, 0
    for pdf in batches:
        out = []
        for c, density in zip(pdf["chain_id"].tolist(), pdf["density_milli"].tolist(), strict=True):
            if chain is not None and c != chain:
                out.append((chain, average))
                average = 0
            chain, average = c, density if average == 0 else (average * _KEPT + density) // _WHOLE
        yield pd.DataFrame(out, columns=["chain_id", "density_milli"])
    if chain is not None:
        yield pd.DataFrame([(chain, average)], columns=["chain_id", "density_milli"])


def density_ewma(ranges: DataFrame) -> DataFrame:
    """(chain_id, density_milli): the running average of densities in order of lo, weight 1/8, floored each step.

    The first sample seeds it, and so does the next after it has fallen to zero.
    Each step needs the one before, so a chain's ranges (not its logs) go through
    one task, sorted by Spark and read as they come: nothing is gathered.
    """
    ordered = log_density(ranges).select("chain_id", "lo", "density_milli").repartition("chain_id").sortWithinPartitions("chain_id", "lo", "density_milli")
    return ordered.select("chain_id", "density_milli").mapInPandas(_carry, "chain_id long, density_milli long")


def height_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("chain_id", "height").agg(F.count(F.lit(1)).alias("n"))
