"""Cost, latency and lag rollups over logs of calls, commits and rollbacks."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Units of each method by rate card, and micro-USD a unit as (numerator, denominator).
METHODS = ("eth_getLogs", "eth_blockNumber", "eth_getBlockByNumber", "eth_getTransactionByHash", "eth_getTransactionReceipt", "eth_subscribe")
BY_COUNT = ("eth_getBlockByNumber", "eth_getTransactionByHash", "eth_getTransactionReceipt")
RATES = {
    "compute_units": ((75, 10, 16, 15, 15, 10), (12, 10)),
    "credits": ((20, 20, 20, 20, 20, 20), (6, 10)),
    "free": ((0, 0, 0, 0, 0, 0), (0, 1)),
}
#: Bounds of histogram buckets.
SECONDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
BLOCKS = (1.0, 8.0, 32.0, 128.0, 512.0, 2000.0, 8000.0)


def rates(spark: SparkSession) -> DataFrame:
    """The rate cards: a row per card and method."""
    rows = [(card, m, u, m in BY_COUNT, num, den) for card, (units, (num, den)) in RATES.items() for m, u in zip(METHODS, units, strict=True)]
    return spark.createDataFrame(rows, "provider string, method string, unit long, by_count boolean, num long, den long")


def call_cost(calls: DataFrame) -> DataFrame:
    """Adds units and micro_usd to calls (provider, method, count); other methods are free, a count is 1 at least."""
    card = F.broadcast(rates(calls.sparkSession))
    priced = calls.join(card, ["provider", "method"], "left")
    units = F.coalesce(F.col("unit") * F.when(F.col("by_count"), F.greatest(F.col("count"), F.lit(1))).otherwise(F.lit(1)), F.lit(0)).cast("bigint")
    priced = priced.withColumn("units", units).withColumn("micro_usd", F.coalesce(F.expr("units * num div den"), F.lit(0).cast("bigint")))
    return priced.drop("unit", "by_count", "num", "den")


#: What a message must name for each class of error, the first that fits, and for an error of too many results.
ERROR_WORDS = {"429": ("429", "too many requests", "limit"), "timeout": ("timeout", "timed out"), "5xx": ("503", "502"), "connection": ("connection",)}
RANGE_CAP_WORDS = ("more than", "too large", "response size", "range is too", "query timeout")


def error_class(message: Column) -> Column:
    """429, timeout, 5xx, connection or other: the first that the message names."""
    m, out = F.lower(message), F.lit("other")
    for name, words in reversed(ERROR_WORDS.items()):
        out = F.when(reduce(or_, (m.contains(x) for x in words)), name).otherwise(out)
    return out


def is_transient(message: Column) -> Column:
    return error_class(message) != "other"


def is_range_cap(message: Column) -> Column:
    """Whether an error says that a range had too many results, so that it should be split."""
    return F.lower(message).rlike("|".join(RANGE_CAP_WORDS))


def error_counts(calls: DataFrame) -> DataFrame:
    """Failures by method and class."""
    return calls.where("error IS NOT NULL").groupBy("method", error_class(F.col("error")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def spend_by_method(calls: DataFrame) -> DataFrame:
    return call_cost(calls).groupBy("chain_id", "provider", "method").agg(F.sum("units").alias("units"), F.sum("micro_usd").alias("micro_usd"))


def billable_spend(calls: DataFrame, quota: int | None, daily_cap: int | None = None) -> DataFrame:
    """By chain, provider and month: units, what is beyond the free quota and its price, what is left, whether none is, and days over the daily cap."""
    card = F.broadcast(rates(calls.sparkSession).select("provider", "num", "den").distinct())
    daily = call_cost(calls).groupBy("chain_id", "provider", F.date_trunc("month", "ts").alias("month"), F.date_trunc("day", "ts").alias("day")).agg(F.sum("units").alias("units"), F.sum("micro_usd").alias("spent"))
    over = F.sum((F.col("spent") > daily_cap).cast("bigint")) if daily_cap is not None else F.lit(0).cast("bigint")
    month = daily.groupBy("chain_id", "provider", "month").agg(F.sum("units").alias("units"), F.sum("spent").alias("spent_micro_usd"), over.alias("days_over_cap")).join(card, "provider")
    beyond = F.greatest(F.col("units") - (quota or 0), F.lit(0))
    left = F.greatest(F.lit(quota).cast("bigint") - F.col("units"), F.lit(0)) if quota is not None else F.lit(None).cast("bigint")
    return month.withColumn("beyond", beyond).withColumn("billable_micro_usd", F.expr("beyond * num div greatest(den, 1)")).withColumn("remaining", left).withColumn("exhausted", F.coalesce(F.col("remaining") == 0, F.lit(False))).drop("num", "den", "beyond")


def quota_crossing(calls: DataFrame, quota: int, order: list[str]) -> DataFrame:
    """The call of each chain and month at which the running units reach the quota.

    Units are first summed by day, so only the calls of the crossing day are ordered.
    """
    priced = call_cost(calls).withColumn("month", F.date_trunc("month", "ts")).withColumn("day", F.date_trunc("day", "ts"))
    days = priced.groupBy("chain_id", "month", "day").agg(F.sum("units").alias("day_units"))
    by_day = Window.partitionBy("chain_id", "month").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    crossing = days.withColumn("upto", F.sum("day_units").over(by_day)).where((F.col("upto") >= quota) & (F.col("upto") - F.col("day_units") < quota)).withColumn("before", F.col("upto") - F.col("day_units")).select("chain_id", "month", "day", "before")
    inside = Window.partitionBy("chain_id", "month").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    running = priced.join(crossing, ["chain_id", "month", "day"]).withColumn("running", F.col("before") + F.sum("units").over(inside))
    return running.where((F.col("running") >= quota) & (F.col("running") - F.col("units") < quota)).select("chain_id", "month", *order, "running")


def call_rate(calls: DataFrame, by: list[str], length: str = "5 minutes", slide: str = "1 minute", seconds: int = 300) -> DataFrame:
    """Calls a second in sliding windows."""
    counted = calls.groupBy(*by, F.window("ts", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*by, F.col("w.start").alias("window_start"), "n", (F.col("n") / seconds).alias("per_second"))


def latency_p95(calls: DataFrame, by: list[str], exact: bool = False) -> DataFrame:
    """95th percentile of duration_s: approximate with bounded memory, or exact."""
    p = F.percentile("duration_s", 0.95) if exact else F.percentile_approx("duration_s", 0.95, 10_000)
    return calls.groupBy(*by).agg(p.alias("p95"))


def histogram(rows: DataFrame, value: str, by: list[str], bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative counts by bound, as ``le`` and n, with +Inf last: one aggregation and one row per bound."""
    sums = rows.groupBy(*by).agg(*(F.sum((F.col(value) <= b).cast("bigint")).alias(f"b{k}") for k, b in enumerate(bounds)), F.count(value).alias("all"))
    cells = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return sums.select(*by, F.explode(cells).alias("c")).select(*by, "c.le", "c.n")


def fetch_lag(heads: DataFrame, cursors: DataFrame, advances: DataFrame, now: Column) -> DataFrame:
    """Blocks behind the head and seconds since the last advance, of each chain."""
    last = advances.groupBy("chain_id").agg(F.max("ts").alias("advanced"))
    return heads.select("chain_id", "head").join(cursors.select("chain_id", "last_height"), "chain_id").join(last, "chain_id", "left").select("chain_id", (F.col("head") - F.col("last_height")).alias("lag"), (F.unix_timestamp(now) - F.unix_timestamp("advanced")).alias("stale_seconds"))


def reorg_stats(rollbacks: DataFrame) -> DataFrame:
    """Count and depths of rollbacks (chain_id, tip, from_height)."""
    depth = F.col("tip") - F.col("from_height") + 1
    return rollbacks.groupBy("chain_id").agg(F.count(F.lit(1)).alias("reorgs"), F.max(depth).alias("deepest"), F.sum(depth).alias("blocks"))


def tip_counts(tip: DataFrame) -> DataFrame:
    """Received and removed logs by chain."""
    return tip.groupBy("chain_id").agg(F.count(F.lit(1)).alias("received"), F.sum(F.col("removed").cast("bigint")).alias("removed"))


def cache_hit_ratio(logs: DataFrame) -> DataFrame:
    """Share of block and transaction references that need no fetch, by chain."""
    ratio = lambda c: 1 - F.count_distinct(c) / F.greatest(F.count(F.lit(1)), F.lit(1))
    return logs.groupBy("chain_id").agg(ratio("height").alias("block_ratio"), ratio("tx_id").alias("tx_ratio"))


def distinct_refs(logs: DataFrame) -> DataFrame:
    return logs.groupBy("chain_id").agg(F.count_distinct("height").alias("heights"), F.count_distinct("tx_id").alias("txs"), F.count(F.lit(1)).alias("logs"))


def start_blocks(contracts: DataFrame) -> DataFrame:
    """Lowest start block of each chain's contracts."""
    return contracts.groupBy("chain_id").agg(F.min("start_block").alias("start_block"))


def filter_union(contracts: DataFrame) -> DataFrame:
    """Addresses and first topics over all contracts of a chain."""
    return contracts.groupBy("chain_id").agg(F.sort_array(F.collect_set("address")).alias("addresses"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("topics")))).alias("topics"))
