"""Which of competing blocks a chain has kept, from what their headers say of each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

_BLOCK = ["chain_id", "height", "hash"]


def canonical_branch(headers: DataFrame) -> DataFrame:
    """(chain_id, height, hash, parent_hash): one block of each height, of headers (chain_id, height, hash, parent_hash, arrived).

    Of the blocks of a height that one stays whose known descendants reach
    highest; of equal reach, that whose highest descendant arrived last, then by
    its hash. So a branch is followed whole, and where no header tells blocks
    apart the last one heard stands.

    Most heights have one block and are settled at once. The others, with the
    blocks right above them, form trees as deep as a fork, whose reach is found
    by pointer jumping: each round doubles the steps to the ancestor that a block
    points to, so a fork of n blocks takes log2 n rounds of joins.
    """
    scratch = Scratch(headers.sparkSession, "forks", lean=True)
    each = headers.groupBy(*_BLOCK).agg(F.max("parent_hash").alias("parent_hash"), F.max("arrived").alias("arrived"))
    counted = scratch.keep(each.withColumn("rivals", F.count(F.lit(1)).over(Window.partitionBy("chain_id", "height"))), "headers")
    lone = counted.where("rivals = 1").select(*_BLOCK, "parent_hash")
    rivals = counted.where("rivals > 1")
    if not rivals.take(1):
        return lone
    named = rivals.select("chain_id", F.col("hash").alias("parent_hash"))
    above = counted.where("rivals = 1").join(named, ["chain_id", "parent_hash"], "left_semi")
    nodes = rivals.unionByName(above).select("chain_id", "hash", F.col("parent_hash").alias("up"), F.struct("height", "arrived", "hash").alias("reach"))
    k = 0
    while True:
        # A pointer that leads out of the forks has done its work.
        nodes = scratch.keep(_known(nodes), f"round-{k}")
        if not nodes.where("up IS NOT NULL").take(1):
            break
        below = nodes.where("up IS NOT NULL").groupBy("chain_id", F.col("up").alias("hash")).agg(F.max("reach").alias("below"))
        twice = nodes.select("chain_id", F.col("hash").alias("up"), F.col("up").alias("next"))
        nodes = nodes.join(below, ["chain_id", "hash"], "left").join(twice, ["chain_id", "up"], "left").select("chain_id", "hash", F.col("next").alias("up"), F.greatest("reach", F.coalesce("below", "reach")).alias("reach"))
        k += 1
    reach = rivals.join(nodes.select("chain_id", "hash", "reach"), ["chain_id", "hash"])
    best = reach.groupBy("chain_id", "height").agg(F.max_by(F.struct("hash", "parent_hash"), "reach").alias("b")).select("chain_id", "height", "b.*")
    return lone.unionByName(best)


def _known(nodes: DataFrame) -> DataFrame:
    """``nodes`` with pointers to nodes only."""
    names = nodes.select("chain_id", F.col("hash").alias("up"), F.lit(True).alias("here"))
    return nodes.join(names, ["chain_id", "up"], "left").select("chain_id", "hash", F.when(F.col("here"), F.col("up")).alias("up"), "reach")


def on_branch(logs: DataFrame, branch: DataFrame) -> DataFrame:
    """Logs (with block_hash and arrived) of the branch's blocks; at heights without a header, of the block of which a log was heard last."""
    at = ["chain_id", "height"]
    kept = branch.select(*at, F.col("hash").alias("_hash"))
    said = logs.groupBy(*at).agg(F.max_by("block_hash", F.struct("arrived", "block_hash")).alias("_said"))
    chosen = said.join(kept, at, "left").select(*at, F.coalesce("_hash", "_said").alias("block_hash"))
    return logs.join(chosen, [*at, "block_hash"], "left_semi").select(logs.columns)


def linked(headers: DataFrame) -> DataFrame:
    """(chain_id, lo, hi): stretches of heights that headers of one branch prove, each header by the next one that names it as its parent.

    A header proves its own height, and those down to its parent where that is
    the header before. One that the next header does not name proves nothing. A
    window over the headers given, of one chain each: give it those in question.
    """
    order = Window.partitionBy("chain_id").orderBy("height")
    seen = headers.select("chain_id", "height", "hash", F.lag("hash").over(order).alias("below"), F.lag("height").over(order).alias("from"), "parent_hash", F.lead("parent_hash").over(order).alias("named"), F.lead("height").over(order).alias("next"))
    good = seen.where("next IS NULL OR next > height + 1 OR named = hash")
    return good.select("chain_id", F.when(F.col("below") == F.col("parent_hash"), F.col("from") + 1).otherwise(F.col("height")).alias("lo"), F.col("height").alias("hi"))
