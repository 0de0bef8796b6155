"""Queries on cost, latency, lag and density."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as w
from ..operators import ranges, rollups, store
from . import sample as s
from .decode_queries import _BIG, wide_cents
from .sample import CALL_LOG, COMMITS, EVENTS, hex_of

QUERIES: dict[str, tuple] = {}
QUOTA, DAILY_CAP = 3000, 400


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


@query("call_cost", f"WITH {EVENTS}, {CALL_LOG} SELECT event_id, provider, method, units, micro_usd FROM calls")
def call_cost(spark: SparkSession, d: str) -> DataFrame:
    return rollups.call_cost(s.calls(spark, d)).select("event_id", "provider", "method", "units", "micro_usd")


_REASON = """CASE WHEN lower(error) LIKE '%429%' OR lower(error) LIKE '%too many requests%' OR lower(error) LIKE '%limit%' THEN '429' WHEN lower(error) LIKE '%timeout%' OR lower(error) LIKE '%timed out%' THEN 'timeout'
  WHEN lower(error) LIKE '%503%' OR lower(error) LIKE '%502%' THEN '5xx' WHEN lower(error) LIKE '%connection%' THEN 'connection' ELSE 'other' END"""


@query("error_class", f"WITH {EVENTS}, {CALL_LOG} SELECT event_id, {_REASON} AS reason, {_REASON} <> 'other' AS transient, lower(error) LIKE '%more than%' AS range_cap FROM calls WHERE error IS NOT NULL")
def error_class(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("error")
    return s.calls(spark, d).where("error IS NOT NULL").select("event_id", rollups.error_class(e).alias("reason"), rollups.is_transient(e).alias("transient"), rollups.is_range_cap(e).alias("range_cap"))


@query("error_class_counts", f"WITH {EVENTS}, {CALL_LOG} SELECT method, {_REASON} AS reason, count(*) AS n FROM calls WHERE error IS NOT NULL GROUP BY ALL")
def error_class_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollups.error_counts(s.calls(spark, d))


@query("spend_by_method", f"WITH {EVENTS}, {CALL_LOG} SELECT chain_id, provider, method, CAST(sum(units) AS BIGINT) AS units, CAST(sum(micro_usd) AS BIGINT) AS micro_usd FROM calls GROUP BY ALL")
def spend_by_method(spark: SparkSession, d: str) -> DataFrame:
    return rollups.spend_by_method(s.calls(spark, d))


_RATE = "CASE provider " + " ".join(f"WHEN '{c}' THEN greatest(units - {QUOTA}, 0) * {num} // {den}" for c, (_, (num, den)) in rollups.RATES.items()) + " END"


@query("billable_spend", f"""WITH {EVENTS}, {CALL_LOG}, dy AS (SELECT chain_id, provider, date_trunc('month', ts) AS m, date_trunc('day', ts) AS dd, CAST(sum(units) AS BIGINT) AS units, CAST(sum(micro_usd) AS BIGINT) AS spent FROM calls GROUP BY ALL),
mo AS (SELECT chain_id, provider, m, CAST(sum(units) AS BIGINT) AS units, CAST(sum(spent) AS BIGINT) AS spent_micro_usd, CAST(sum(CASE WHEN spent > {DAILY_CAP} THEN 1 ELSE 0 END) AS BIGINT) AS days_over_cap FROM dy GROUP BY ALL)
SELECT chain_id, provider, CAST(floor(epoch(m)) AS BIGINT) AS month, units, spent_micro_usd, days_over_cap, CAST({_RATE} AS BIGINT) AS billable_micro_usd, greatest({QUOTA} - units, 0) AS remaining, units >= {QUOTA} AS exhausted FROM mo""")
def billable_spend(spark: SparkSession, d: str) -> DataFrame:
    return rollups.billable_spend(s.calls(spark, d), QUOTA, DAILY_CAP).withColumn("month", F.unix_timestamp("month"))


@query("quota_crossing", f"""WITH {EVENTS}, {CALL_LOG}, r AS (SELECT chain_id, ts, event_id, units, sum(units) OVER (PARTITION BY chain_id, date_trunc('month', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running, date_trunc('month', ts) AS m FROM calls)
SELECT chain_id, CAST(floor(epoch(m)) AS BIGINT) AS month, event_id, CAST(running AS BIGINT) AS running FROM r WHERE running >= {QUOTA} AND running - units < {QUOTA}""")
def quota_crossing(spark: SparkSession, d: str) -> DataFrame:
    return rollups.quota_crossing(s.calls(spark, d), QUOTA, ["ts", "event_id"]).select("chain_id", F.unix_timestamp("month").alias("month"), "event_id", "running")


@query("sum_uint256", f"WITH {EVENTS} SELECT chain_id, event_type, CAST(sum({_BIG}) AS VARCHAR) AS total FROM ev GROUP BY ALL")
def sum_uint256(spark: SparkSession, d: str) -> DataFrame:
    sums = wide_cents(spark, d).groupBy("chain_id", "event_type").agg(*w.limb_sums(F.col("big")))
    return sums.select("chain_id", "event_type", w.sum_text(*(F.col(f"limb_{k}") for k in range(8))).alias("total"))


@query("call_rate", f"WITH {EVENTS}, {CALL_LOG}, m AS (SELECT method, CAST(floor(epoch(ts) / 60) AS BIGINT) - k AS minute FROM calls, unnest(range(5)) t(k)) SELECT method, minute * 60 AS window_start, count(*) AS n, count(*) / 300 AS per_second FROM m GROUP BY ALL")
def call_rate(spark: SparkSession, d: str) -> DataFrame:
    return rollups.call_rate(s.calls(spark, d), ["method"]).withColumn("window_start", F.unix_timestamp("window_start"))


@query("latency_p95", f"WITH {EVENTS}, {CALL_LOG} SELECT provider, method, round(quantile_cont(duration_s, 0.95), 6) AS p95 FROM calls GROUP BY ALL")
def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    """The exact percentile; operators use the approximate one by default."""
    return rollups.latency_p95(s.calls(spark, d), ["provider", "method"], exact=True).withColumn("p95", F.round("p95", 6))


_BOUNDS = " UNION ALL ".join([*(f"SELECT provider, '{b}' AS le, count(CASE WHEN duration_s <= {b} THEN 1 END) AS n FROM calls GROUP BY provider" for b in rollups.SECONDS), "SELECT provider, '+Inf' AS le, count(*) AS n FROM calls GROUP BY provider"])


@query("latency_buckets", f"WITH {EVENTS}, {CALL_LOG} {_BOUNDS}")
def latency_buckets(spark: SparkSession, d: str) -> DataFrame:
    return rollups.histogram(s.calls(spark, d), "duration_s", ["provider"], rollups.SECONDS)


@query("fetch_lag", f"""WITH {EVENTS}, {COMMITS}, h AS (SELECT chain_id, max(height) AS head, max(ts) AS ts FROM ev GROUP BY chain_id), c AS (SELECT chain_id, max(hi) - 60 AS last_height FROM ing GROUP BY chain_id)
SELECT h.chain_id, head - last_height AS lag, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') - floor(epoch(ts)) AS BIGINT) AS stale_seconds FROM h JOIN c ON c.chain_id = h.chain_id""")
def fetch_lag(spark: SparkSession, d: str) -> DataFrame:
    e = s.events(spark, d)
    cursors = s.ingests(spark, d).groupBy("chain_id").agg((F.max("to_height") - 60).alias("last_height"))
    return rollups.fetch_lag(e.groupBy("chain_id").agg(F.max("height").alias("head")), cursors, e.select("chain_id", "ts"), F.lit("2024-02-01 00:00:00").cast("timestamp"))


@query("reorg_stats", f"WITH {EVENTS} SELECT chain_id, count(*) AS reorgs, max(user_id % 13 + 1) AS deepest, CAST(sum(user_id % 13 + 1) AS BIGINT) AS blocks FROM ev WHERE event_type = 'error' GROUP BY chain_id")
def reorg_stats(spark: SparkSession, d: str) -> DataFrame:
    """Errors as rollbacks of up to 13 blocks."""
    back = s.events(spark, d).where("event_type = 'error'").select("chain_id", F.col("height").alias("tip"), (F.col("height") - F.col("user_id") % 13).alias("from_height"))
    return rollups.reorg_stats(back)


@query("tip_counts", f"WITH {EVENTS} SELECT chain_id, count(*) AS received, count(CASE WHEN event_type = 'error' THEN 1 END) AS removed FROM ev GROUP BY chain_id")
def tip_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollups.tip_counts(s.events(spark, d).select("chain_id", (F.col("event_type") == "error").alias("removed")))


@query("distinct_refs", f"WITH {EVENTS} SELECT chain_id, count(DISTINCT height) AS heights, count(DISTINCT tx) AS txs, count(*) AS logs FROM ev GROUP BY chain_id")
def distinct_refs(spark: SparkSession, d: str) -> DataFrame:
    return rollups.distinct_refs(s.logs(spark, d))


@query("cache_hit_ratio", f"WITH {EVENTS} SELECT chain_id, round(1 - count(DISTINCT height) / count(*), 9) AS block_ratio, round(1 - count(DISTINCT tx) / count(*), 9) AS tx_ratio FROM ev WHERE event_type <> 'error' GROUP BY chain_id")
def cache_hit_ratio(spark: SparkSession, d: str) -> DataFrame:
    known = s.events(spark, d).where("event_type <> 'error'").withColumn("tx_id", F.col("tx"))
    return rollups.cache_hit_ratio(known).select("chain_id", F.round("block_ratio", 9).alias("block_ratio"), F.round("tx_ratio", 9).alias("tx_ratio"))


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    return s.ingests(spark, d).select("chain_id", F.col("from_height").alias("lo"), F.col("to_height").alias("hi"), F.col("rows").alias("n"))


@query("log_density", f"WITH {EVENTS}, {COMMITS} SELECT chain_id, lo, hi, n * 1000 // (hi - lo + 1) AS density_milli FROM ing")
def log_density(spark: SparkSession, d: str) -> DataFrame:
    return ranges.log_density(_ranges(spark, d)).drop("n")


@query("density_ewma", f"""WITH RECURSIVE {EVENTS}, {COMMITS}, o AS (SELECT chain_id, n * 1000 // (hi - lo + 1) AS x, row_number() OVER (PARTITION BY chain_id ORDER BY lo) AS k FROM ing),
f(chain_id, k, v) AS (SELECT chain_id, k, x FROM o WHERE k = 1 UNION ALL SELECT o.chain_id, o.k, CASE WHEN v = 0 THEN x ELSE (v * 7 + x) // 8 END FROM f JOIN o ON o.chain_id = f.chain_id AND o.k = f.k + 1)
SELECT chain_id, arg_max(v, k) AS density_milli FROM f GROUP BY chain_id""")
def density_ewma(spark: SparkSession, d: str) -> DataFrame:
    return ranges.density_ewma(_ranges(spark, d))


def _contracts(spark: SparkSession, d: str) -> DataFrame:
    """Event types of a chain as its contracts, from the height at which each is first seen."""
    held = s.events(spark, d).groupBy("chain_id", "event_type").agg(F.min("height").alias("start_block"))
    return held.select("chain_id", "start_block", w.hex_encode(w.address_word(F.length("event_type"))).alias("address"), F.array("event_type", F.lit("view")).alias("topics"))


@query("start_blocks", f"WITH {EVENTS} SELECT chain_id, min(height) AS start_block FROM ev GROUP BY chain_id")
def start_blocks(spark: SparkSession, d: str) -> DataFrame:
    return rollups.start_blocks(_contracts(spark, d))


@query("filter_union", f"""WITH {EVENTS}, k AS (SELECT DISTINCT chain_id, event_type FROM ev), a AS (SELECT DISTINCT chain_id, {hex_of('length(event_type)', 40)} AS address FROM k), t AS (SELECT chain_id, event_type FROM k UNION SELECT chain_id, 'view' FROM k)
SELECT c.chain_id, (SELECT string_agg(address, ',' ORDER BY address) FROM a WHERE a.chain_id = c.chain_id) AS addresses, (SELECT string_agg(event_type, ',' ORDER BY event_type) FROM t WHERE t.chain_id = c.chain_id) AS topics FROM (SELECT DISTINCT chain_id FROM k) c""")
def filter_union(spark: SparkSession, d: str) -> DataFrame:
    held = rollups.filter_union(_contracts(spark, d))
    return held.select("chain_id", F.array_join("addresses", ",").alias("addresses"), F.array_join("topics", ",").alias("topics"))
