"""Queries on the store, reads, ranges and reorganisations."""

from __future__ import annotations

from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import read_abi
from ..functions import words as w
from ..operators import decode, evolve, ranges, reads, store
from ..operators.reads import Filter, QuerySpec
from ..scratch import Scratch
from ..streaming import tip
from . import jobs
from . import sample as s
from .decode_queries import _BIG, decoded, wide_cents
from .sample import BLOCKS, COMMITS, EVENTS, LINES, ORDERS, hex_of

QUERIES: dict[str, tuple] = {}
PURCHASE = s.SHOP[0]
COLUMNS = reads.columns_of(PURCHASE)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = (fn, sql)
        return fn

    return add


def purchases(spark: SparkSession, d: str) -> DataFrame:
    """Decoded purchases with block time."""
    return decode.stamp_block_time(decode.decode_events(s.logs(spark, d), PURCHASE), s.blocks(spark, d))


# --- scans ------------------------------------------------------------------


@query("raw_range", f"WITH {EVENTS}, m AS (SELECT max(height) AS top FROM ev) SELECT height, idx, {hex_of('tx')} AS tx_id FROM ev, m WHERE chain_id = 2 AND height BETWEEN top // 4 AND top // 2")
def raw_range(spark: SparkSession, d: str) -> DataFrame:
    top = _top(spark, d)
    return s.landed(spark, d, "raw").raw_range(2, top // 4, top // 2).select("height", "idx", w.hex_encode(F.col("tx_id")).alias("tx_id"))


def _top(spark: SparkSession, d: str) -> int:
    return s.events(spark, d).agg(F.max("height")).first()[0] or 0


@query("block_lookup", f"WITH {EVENTS}, {BLOCKS}, m AS (SELECT max(height) AS h FROM bl WHERE chain_id = 2) SELECT chain_id, height, '0x' || sha256(CAST(height AS VARCHAR)) AS hash, time FROM bl, m WHERE chain_id = 2 AND height = h")
def block_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The highest block of a chain, by its height."""
    held = s.landed(spark, d, "lookup")
    at = store.highest(held.blocks(2)).first()["height"]
    return held.blocks(2, at, at).select("chain_id", "height", w.hex_encode(F.col("hash")).alias("hash"), "time")


@query("block_times", f"WITH {EVENTS}, {BLOCKS}, m AS (SELECT max(height) AS top FROM ev) SELECT height, time FROM bl, m WHERE chain_id = 1 AND height BETWEEN top // 10 AND top // 2")
def block_times(spark: SparkSession, d: str) -> DataFrame:
    top = _top(spark, d)
    return s.landed(spark, d, "times").blocks(1, top // 10, top // 2).select("height", "time")


@query("dead_batch_invisible", f"WITH {EVENTS}, m AS (SELECT max(height) AS top FROM ev) SELECT ev.chain_id, height, idx FROM ev, m WHERE chain_id <> 2 OR height <= top // 2")
def dead_batch_invisible(spark: SparkSession, d: str) -> DataFrame:
    """The upper half of chain 2 was written by a batch that died before its marker; the next batch of another chain gets its number."""
    held, raw, bl, top = store.Store(spark, Scratch(spark, "dead").path("store"), bucket=1000), s.logs(spark, d), s.blocks(spark, d), _top(spark, d)
    half = top // 2
    held.ingest_ranges("first", [(c, 0, half) for c in (1, 2, 3)], raw, bl)
    schemas = held.schemas()
    held._write("raw_records", raw.where((F.col("chain_id") == 2) & (F.col("height") > half)), "dead", schemas)
    held.ingest_ranges("second", [(c, half + 1, top + 1) for c in (1, 3)], raw, bl)
    return held.read("raw_records").select(*store.KEY)


@query("relanded_rows", f"""WITH {EVENTS}, m AS (SELECT max(height) AS top FROM ev)
SELECT ev.chain_id, height, idx, CASE WHEN chain_id = 2 AND height > top // 2 THEN 1 ELSE 0 END AS tx_index FROM ev, m""")
def relanded_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chain 2 is rolled back to the middle of its heights and the same range landed again with other rows."""
    held, raw, bl, top = store.Store(spark, Scratch(spark, "again").path("store"), bucket=1000), s.logs(spark, d), s.blocks(spark, d), _top(spark, d)
    held.ingest_ranges("all", [(c, 0, top) for c in (1, 2, 3)], raw.withColumn("tx_index", F.lit(0).cast("bigint")), bl)
    held.rollback("back", 2, top // 2 + 1)
    spans = spark.createDataFrame([(2, 0, top)], "chain_id long, next long, target long")
    gaps = [tuple(r) for r in store.uncovered(store.clip_ranges(held.commits()), spans).collect()]
    if gaps:
        held.ingest_ranges("again", gaps, raw.withColumn("tx_index", F.lit(1).cast("bigint")), bl)
    return held.read("raw_records").select(*store.KEY, "tx_index")


# --- writes as they are read back -------------------------------------------

_LINE_ORDER = "cents, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
_ORDER = [c.strip() for c in _LINE_ORDER.split(",")]


@query("insert_if_absent", f"""WITH {LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY chain_id, height, idx ORDER BY {_LINE_ORDER}) AS rn FROM li WHERE l_shipdate >= TIMESTAMP '1997-01-01')
SELECT chain_id, height, idx, cents FROM f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM li WHERE li.l_shipdate < TIMESTAMP '1997-01-01' AND li.chain_id = f.chain_id AND li.height = f.height AND li.idx = f.idx)""")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Newer lines against the older ones that are stored."""
    li = s.lines(spark, d)
    stored, batch = li.where("l_shipdate < timestamp '1997-01-01'"), li.where("l_shipdate >= timestamp '1997-01-01'")
    return store.insert_if_absent(batch, stored, store.KEY, _ORDER).select("chain_id", "height", "idx", "cents")


@query("upsert_last_wins", f"""WITH {LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY chain_id, height, idx ORDER BY {', '.join(c + ' DESC' for c in ['l_shipdate', *_ORDER[:-1]])}) AS rn FROM li)
SELECT chain_id, height, idx, cents FROM f WHERE rn = 1""")
def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return store.last_wins(s.lines(spark, d), store.KEY, ["l_shipdate", *_ORDER[:-1]]).select("chain_id", "height", "idx", "cents")


@query("insert_optional_fields", f"WITH {EVENTS} SELECT chain_id, height, idx, CASE WHEN event_type IN ('purchase', 'click') THEN cents END AS cents, CASE WHEN event_type = 'view' THEN props END AS props, user_id FROM ev WHERE event_type IN ('purchase', 'click', 'view')")
def insert_optional_fields(spark: SparkSession, d: str) -> DataFrame:
    """Batches of different columns into one table."""
    e = s.events(spark, d)
    one = e.where("event_type IN ('purchase', 'click')").select(*store.KEY, "cents", "user_id")
    two = e.where("event_type = 'view'").select(*store.KEY, "user_id", "props")
    return store.union_optional([one, two]).select(*store.KEY, "cents", "props", "user_id")


@query("fanout_counts", f"WITH {EVENTS} SELECT chain_id, 'evt_shop_' || event_type AS table_name, count(*) AS n FROM ev WHERE event_type <> 'error' GROUP BY chain_id, event_type")
def fanout_counts(spark: SparkSession, d: str) -> DataFrame:
    """Decoded by the batch job, counted in the tables that it wrote."""
    held = s.landed(spark, d, "fanout")
    jobs.decode_pending(held, s.SHOP)
    rows = [held.read(e.table).select("chain_id", F.lit(e.table).alias("table")) for e in s.SHOP if held.has(e.table)]
    return store.fanout_counts(store.union_optional(rows)).withColumnRenamed("table", "table_name")


@query("rows_per_table", f"WITH {EVENTS} SELECT chain_id, coalesce('evt_shop_' || CASE WHEN event_type <> 'error' THEN event_type END, 'skipped') AS table_name, count(*) AS n FROM ev GROUP BY ALL")
def rows_per_table(spark: SparkSession, d: str) -> DataFrame:
    raw = s.logs(spark, d)
    known = decode.route_events(raw, s.SHOP).select("chain_id", F.col("table").alias("table_name"))
    skipped = decode.unrouted_logs(raw, s.SHOP).select("chain_id", F.lit("skipped").alias("table_name"))
    return known.unionByName(skipped).groupBy("chain_id", "table_name").agg(F.count(F.lit(1)).alias("n"))


@query("rollback_visible", f"""WITH {EVENTS}, {COMMITS}
SELECT ev.chain_id, ev.height, ev.idx FROM ev JOIN ing ON ing.chain_id = ev.chain_id AND ev.height BETWEEN lo AND hi
LEFT JOIN back ON back.chain_id = ev.chain_id AND ev.height >= f AND ing.commit_seq < seq WHERE back.f IS NULL""")
def rollback_visible(spark: SparkSession, d: str) -> DataFrame:
    """Logs under the commit log: of missing batches none, of a rolled back chain those below or landed later."""
    rows = s.logs(spark, d).withColumn("write_id", F.concat_ws("-", F.lit("b"), "chain_id", F.expr(f"height div {s.BATCH}")))
    return store.visible(rows, s.commits(spark, d), "raw_records").select(*store.KEY)


@query("delete_from_height", f"WITH {EVENTS}, m AS (SELECT max(height) AS top FROM ev) SELECT chain_id, count(*) AS n, max(height) AS top FROM ev, m WHERE chain_id <> 3 OR height < m.top // 3 GROUP BY chain_id")
def delete_from_height(spark: SparkSession, d: str) -> DataFrame:
    raw = s.logs(spark, d)
    top = raw.agg(F.max("height")).first()[0]
    return store.delete_from_height(raw, 3, top // 3).groupBy("chain_id").agg(F.count(F.lit(1)).alias("n"), F.max("height").alias("top"))


@query("empty_checkpoint", f"WITH {EVENTS}, {BLOCKS} SELECT chain_id, max(height) + 100 AS last_height, '0x' AS last_hash FROM bl GROUP BY chain_id")
def empty_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """A range without a match still moves the cursor, with an empty hash."""
    top = s.blocks(spark, d).groupBy("chain_id").agg(F.max("height").alias("top"))
    empty = top.select("chain_id", F.lit(0).cast("bigint").alias("lo"), (F.col("top") + 100).alias("hi"), F.lit(None).cast("bigint").alias("best_height"), F.lit(None).cast("binary").alias("best_hash"))
    return store.contiguous_prefix(empty).select("chain_id", "last_height", w.hex_encode(F.col("last_hash")).alias("last_hash"))


def _resync(spark: SparkSession, d: str, mode: str) -> DataFrame:
    """A stored decode that lacks odd places, has wrong amounts and no props, decoded again over chain 1."""
    held = s.landed(spark, d, "resync")
    older = replace(PURCHASE, params=PURCHASE.params[:2])
    rows = decode.decode_events(s.logs(spark, d), PURCHASE).where("idx % 2 = 0").withColumn("cents", w.word(F.lit(7))).drop("props")
    held.put_tables("older", [(c, 0, _top(spark, d)) for c in (1, 2, 3)], {PURCHASE.table: (rows, older)})
    jobs.resync(held, s.SHOP[:1], 1, 0, _top(spark, d), "again", mode)
    return held.read(PURCHASE.table).select("chain_id", "height", "idx", w.uint256_text(F.col("cents")).alias("cents"), "props")


_PROPS = "CASE WHEN chain_id = 1 AND {} THEN props END AS props"
query("resync_insert_missing", f"WITH {EVENTS} SELECT chain_id, height, idx, CASE WHEN idx % 2 = 0 THEN '7' ELSE CAST(cents AS VARCHAR) END AS cents, {_PROPS.format('idx % 2 = 1')} FROM ev WHERE event_type = 'purchase' AND (idx % 2 = 0 OR chain_id = 1)")(partial(_resync, mode="insert_missing"))
query("resync_replace", f"WITH {EVENTS} SELECT chain_id, height, idx, CASE WHEN chain_id <> 1 THEN '7' ELSE CAST(cents AS VARCHAR) END AS cents, {_PROPS.format('true')} FROM ev WHERE event_type = 'purchase' AND (idx % 2 = 0 OR chain_id = 1)")(partial(_resync, mode="replace"))


@query("evolve_read", f"WITH {EVENTS} SELECT chain_id, height, idx, CAST(cents AS VARCHAR) AS cents, CAST(NULL AS VARCHAR) AS props FROM ev WHERE event_type = 'purchase'")
def evolve_read(spark: SparkSession, d: str) -> DataFrame:
    """A stored table from before a column was added to its entry."""
    held = store.Store(spark, Scratch(spark, "evolve").path("store"), bucket=1000)
    rows = decode.decode_events(s.logs(spark, d), PURCHASE).drop("props")
    held.put_tables("old", [(c, 0, _top(spark, d)) for c in (1, 2, 3)], {PURCHASE.table: (rows, None)})
    held.evolve(PURCHASE)
    old = held.read(PURCHASE.table)
    return evolve.evolve_read(old, PURCHASE.schema()).select("chain_id", "height", "idx", w.uint256_text(F.col("cents")).alias("cents"), "props")


# --- cursor, gaps, backlog --------------------------------------------------

_CLIPPED = """cl AS (
  SELECT ing.chain_id, lo, least(hi, coalesce(f - 1, hi)) AS hi, last_height FROM ing LEFT JOIN back ON back.chain_id = ing.chain_id AND ing.commit_seq < seq WHERE lo <= coalesce(f - 1, hi)
)"""
_FIRST_GAP = f"""{_CLIPPED}, lead AS (SELECT *, lead(lo) OVER (PARTITION BY chain_id ORDER BY lo) AS nxt FROM cl), g AS (SELECT chain_id, min(hi) AS upto FROM lead WHERE nxt IS NULL OR nxt > hi + 1 GROUP BY chain_id)"""
_CURSOR = f"""WITH {EVENTS}, {COMMITS}, {_FIRST_GAP}
SELECT cl.chain_id, max(hi) AS last_height, '0x' || sha256(CAST(max(CASE WHEN last_height <= hi THEN last_height END) AS VARCHAR)) AS last_hash FROM cl JOIN g ON g.chain_id = cl.chain_id AND hi <= upto GROUP BY cl.chain_id"""


def _cursor(spark: SparkSession, d: str) -> DataFrame:
    found = store.contiguous_prefix(store.clip_ranges(s.commits(spark, d)))
    return found.select("chain_id", "last_height", w.hex_encode(F.col("last_hash")).alias("last_hash"))


query("contiguous_prefix", _CURSOR)(_cursor)
query("cursor_state", f"SELECT * FROM ({_CURSOR}) WHERE chain_id = 1")(lambda spark, d: _cursor(spark, d).where("chain_id = 1"))


@query("range_gaps", f"WITH {EVENTS}, {COMMITS}, {_CLIPPED}, l AS (SELECT chain_id, hi, lead(lo) OVER (PARTITION BY chain_id ORDER BY lo) AS nxt FROM cl) SELECT chain_id, hi + 1 AS gap_lo, nxt - 1 AS gap_hi FROM l WHERE nxt > hi + 1")
def range_gaps(spark: SparkSession, d: str) -> DataFrame:
    return store.range_gaps(store.clip_ranges(s.commits(spark, d)))


_BACKLOG = f"{_CLIPPED}, bk AS (SELECT chain_id, lo AS from_height, hi AS to_height FROM cl WHERE (lo // {s.BATCH}) % 4 = 3)"


@query("decode_backlog", f"WITH {EVENTS}, {COMMITS}, {_BACKLOG} SELECT chain_id, from_height, to_height FROM bk")
def decode_backlog(spark: SparkSession, d: str) -> DataFrame:
    """Of a range of which only one table was decoded all is pending; ranges that were rolled back are not, or as far as they were cut."""
    return store.decode_backlog(s.commits(spark, d)).drop("commit_seq", "latest")


@query("backlog_after_rollback", f"WITH {EVENTS}, m AS (SELECT max(height) AS top FROM ev) SELECT CAST(2 AS BIGINT) AS chain_id, top // 2 + 1 AS from_height, top AS to_height, count(*) AS n FROM ev, m WHERE chain_id = 2 AND height > top // 2 GROUP BY top")
def backlog_after_rollback(spark: SparkSession, d: str) -> DataFrame:
    """Everything was decoded, half of chain 2 rolled back and landed again: only that is pending, with the rows that it holds."""
    held, raw, bl, top = s.landed(spark, d, "pending"), s.logs(spark, d), s.blocks(spark, d), _top(spark, d)
    jobs.decode_pending(held, s.SHOP[:1])
    held.rollback("back", 2, top // 2 + 1)
    held.ingest("again", 2, top // 2 + 1, top, raw, bl)
    pending = store.decode_backlog(held.commits()).select("chain_id", "from_height", "to_height")
    rows = held.read("raw_records").join(pending, "chain_id").where("height BETWEEN from_height AND to_height")
    return rows.groupBy("chain_id", "from_height", "to_height").agg(F.count(F.lit(1)).alias("n"))


@query("oldest_pending", f"WITH {EVENTS}, {COMMITS}, {_BACKLOG} SELECT chain_id, count(*) AS depth, min(from_height) AS from_height, min(to_height) AS to_height FROM bk GROUP BY chain_id")
def oldest_pending(spark: SparkSession, d: str) -> DataFrame:
    return store.oldest_pending(store.decode_backlog(s.commits(spark, d)))


@query("orphan_receipts", f"WITH {ORDERS} SELECT chain_id, {hex_of('o_orderkey')} AS tx_id FROM tx WHERE o_orderstatus <> 'P' AND o_orderkey % 11 = 4")
def orphan_receipts(spark: SparkSession, d: str) -> DataFrame:
    """Every eleventh transaction has been lost."""
    kept = s.table(spark, d, "orders").where("o_orderkey % 11 <> 4").select(F.expr("(o_orderkey div 5) % 3 + 1").alias("chain_id"), w.word(F.col("o_orderkey")).alias("tx_id"))
    return store.orphan_receipts(s.receipts(spark, d), kept).select("chain_id", w.hex_encode(F.col("tx_id")).alias("tx_id"))


@query("first_tx_location", f"WITH {EVENTS} SELECT chain_id, {hex_of('tx')} AS tx_id, min(height) AS height, min(idx) AS idx FROM ev GROUP BY chain_id, tx")
def first_tx_location(spark: SparkSession, d: str) -> DataFrame:
    return store.first_tx_location(s.logs(spark, d)).select("chain_id", w.hex_encode(F.col("tx_id")).alias("tx_id"), "height", "idx")


# --- filters ----------------------------------------------------------------


@query("record_filter", f"WITH {EVENTS} SELECT chain_id, height, idx FROM ev WHERE chain_id IN (1, 3) AND event_type IN ('view', 'click')")
def record_filter(spark: SparkSession, d: str) -> DataFrame:
    held = reads.record_filter(s.logs(spark, d), [(1).to_bytes(20), (3).to_bytes(20)], [s.TOPICS["view"], s.TOPICS["click"]])
    return held.select(*store.KEY)


_SIX = (("EQ", "="), ("NE", "<>"), ("GT", ">"), ("GTE", ">="), ("LT", "<"), ("LTE", "<="))


@query("filter_ops", f"WITH {EVENTS} " + " UNION ALL ".join(f"SELECT '{name}' AS op, count(*) AS n FROM ev WHERE event_type = 'purchase' AND cents {op} 2500" for name, op in _SIX))
def filter_ops(spark: SparkSession, d: str) -> DataFrame:
    held = purchases(spark, d)
    matched = [F.sum(reads.condition(Filter("cents", op, "2500"), COLUMNS).cast("bigint")).alias(op) for op, _ in _SIX]
    return held.agg(*matched).select(F.explode(F.array(*(F.struct(F.lit(op).alias("op"), F.coalesce(op, F.lit(0)).alias("n")) for op, _ in _SIX))).alias("r")).select("r.op", "r.n")


def _selected(spark: SparkSession, d: str, spec: QuerySpec) -> DataFrame:
    return reads.select_events(purchases(spark, d), spec, COLUMNS).select(*store.KEY, w.uint256_text(F.col("cents")).alias("cents"))


query("filter_conj", f"WITH {EVENTS} SELECT chain_id, height, idx, CAST(cents AS VARCHAR) AS cents FROM ev WHERE event_type = 'purchase' AND cents >= 1000 AND user_id < 50 AND props <> '{{\"k\": 5}}'")(
    lambda spark, d: _selected(spark, d, QuerySpec(PURCHASE.table, (Filter("cents", "GTE", "1000"), Filter("user_id", "LT", "50"), Filter("props", "NEQ", '{"k": 5}'))))
)
query("height_window", f"WITH {EVENTS}, m AS (SELECT max(height) AS top FROM ev) SELECT chain_id, height, idx, CAST(cents AS VARCHAR) AS cents FROM ev, m WHERE event_type = 'purchase' AND chain_id = 2 AND height BETWEEN top // 5 AND top // 2")(
    lambda spark, d: _selected(spark, d, QuerySpec(PURCHASE.table, chain_id=2, from_height=_top(spark, d) // 5, to_height=_top(spark, d) // 2))
)

WIDE = read_abi([{"type": "event", "name": "Wide", "inputs": [{"name": "value", "type": "uint"}]}], "sample")[0]


@query("filter_uint256", f"WITH {EVENTS} SELECT chain_id, height, idx, CAST({_BIG} AS VARCHAR) AS value FROM ev WHERE cents > 2500")
def filter_uint256(spark: SparkSession, d: str) -> DataFrame:
    """A wide comparison at full precision on a stored table, behind one of bit lengths that the scan is given."""
    held = store.Store(spark, Scratch(spark, "wide").path("store"))
    rows = decode.decode_events(s.log_of(wide_cents(spark, d), F.array(F.lit(WIDE.key)), F.col("big")), WIDE)
    held.put_tables("all", [(c, 0, _top(spark, d)) for c in (1, 2, 3)], {WIDE.table: (rows, WIDE)})
    spec = QuerySpec(WIDE.table, (Filter("value", "GT", str(2500 << 96)),))
    return reads.select_events(held.read(WIDE.table, bits=True), spec, reads.columns_of(WIDE)).select(*store.KEY, w.uint256_text(F.col("value")).alias("value"))


@query("finalized_only", f"WITH {EVENTS}, h AS (SELECT chain_id, greatest(max(height) - 12 * chain_id, 0) AS lim FROM ev GROUP BY chain_id) SELECT ev.chain_id, height, idx FROM ev JOIN h ON h.chain_id = ev.chain_id AND height <= lim WHERE event_type = 'purchase'")
def finalized_only(spark: SparkSession, d: str) -> DataFrame:
    heads = s.events(spark, d).groupBy("chain_id").agg(F.max("height").alias("head"))
    waits = heads.select("chain_id", (F.col("chain_id") * 12).alias("confirmations"))
    return reads.finalized(decode.decode_events(s.logs(spark, d), PURCHASE), heads, waits).select(*store.KEY)


# --- pages ------------------------------------------------------------------

_PAGE = "SELECT chain_id, height, idx, CAST(user_id AS VARCHAR) AS user_id, CAST(cents AS VARCHAR) AS cents FROM ev WHERE event_type = 'purchase'"


def _page(spark: SparkSession, d: str, spec: QuerySpec) -> DataFrame:
    """A page of the stored table, from as few buckets as it takes."""
    return s.decoded_store(spark, d).events(PURCHASE, spec).select(*store.KEY, w.uint256_text(F.col("user_id")).alias("user_id"), w.uint256_text(F.col("cents")).alias("cents"))


query("page_asc", f"WITH {EVENTS} {_PAGE} ORDER BY height, idx, chain_id LIMIT 101")(lambda spark, d: _page(spark, d, QuerySpec(PURCHASE.table)))
query("page_after", f"WITH {EVENTS} {_PAGE} AND chain_id = 2 AND (height > 25 OR height = 25 AND idx > 4) ORDER BY height, idx LIMIT 51")(lambda spark, d: _page(spark, d, QuerySpec(PURCHASE.table, chain_id=2, after="25:4", first=50)))


@query("page_over_chains", f"WITH {EVENTS}, t AS (SELECT chain_id, height // 3 AS height, idx, event_type, user_id FROM ev) SELECT chain_id, height, idx, CAST(user_id AS VARCHAR) AS user_id FROM t WHERE event_type = 'purchase' AND (height, idx, chain_id) > (8, 4, 1) ORDER BY height, idx, chain_id LIMIT 201")
def page_over_chains(spark: SparkSession, d: str) -> DataFrame:
    """Heights and places tie over three chains, and the cursor stands between rows that tie."""
    tied = decode.decode_events(s.logs(spark, d), PURCHASE).withColumn("height", F.expr("height div 3"))
    page = reads.page_rows(tied, QuerySpec(PURCHASE.table, after="8:4:1", first=200), COLUMNS)
    return page.select(*store.KEY, w.uint256_text(F.col("user_id")).alias("user_id"))


@query("stored_page", f"WITH {EVENTS}, m AS (SELECT max(height) AS top FROM ev), t AS (SELECT ev.*, top FROM ev, m) SELECT chain_id, height, idx, CAST(cents AS VARCHAR) AS cents FROM t WHERE event_type = 'purchase' AND chain_id = 1 AND cents >= 1000 AND height <= top // 2 ORDER BY height DESC, idx DESC LIMIT 101")
def stored_page(spark: SparkSession, d: str) -> DataFrame:
    """Landed, decoded by the batch job, and read back as a page below a cursor."""
    held, top = s.landed(spark, d, "page"), _top(spark, d)
    jobs.decode_ranges(held, s.SHOP, [(1, 0, top)], "decode")
    spec = QuerySpec(PURCHASE.table, (Filter("cents", "GTE", "1000"),), chain_id=1, after=f"{top // 2 + 1}:0", descending=True)
    return held.events(PURCHASE, spec).select(*store.KEY, w.uint256_text(F.col("cents")).alias("cents"))


@query("page_desc", f"WITH {EVENTS}, {BLOCKS} SELECT ev.chain_id, ev.height, ev.idx, time AS block_time, CAST(user_id AS VARCHAR) AS user_id, CAST(cents AS VARCHAR) AS cents, props FROM ev JOIN bl ON bl.chain_id = ev.chain_id AND bl.height = ev.height WHERE event_type = 'purchase' ORDER BY ev.height DESC, ev.idx DESC LIMIT 101")
def page_desc(spark: SparkSession, d: str) -> DataFrame:
    """Newest first, with the block times that decoding has put on the rows."""
    page = s.decoded_store(spark, d).events(PURCHASE, QuerySpec(PURCHASE.table, descending=True))
    return page.select(*store.KEY, F.unix_timestamp("block_time").alias("block_time"), w.uint256_text(F.col("user_id")).alias("user_id"), w.uint256_text(F.col("cents")).alias("cents"), "props")


@query("indexed_lookup", f"WITH {EVENTS} SELECT chain_id, height, idx, CAST(user_id AS VARCHAR) AS user_id, CAST(cents AS VARCHAR) AS cents FROM ev WHERE event_type = 'purchase' AND user_id BETWEEN 3 AND 5 AND cents >= 1000")
def indexed_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A range of an indexed column over all chains and heights: the index names the buckets to read."""
    spec = QuerySpec(PURCHASE.table, (Filter("user_id", "GTE", "3"), Filter("user_id", "LTE", "5"), Filter("cents", "GTE", "1000")))
    return s.decoded_store(spark, d).select(PURCHASE, spec).select(*store.KEY, w.uint256_text(F.col("user_id")).alias("user_id"), w.uint256_text(F.col("cents")).alias("cents"))


@query("total_count", f"WITH {EVENTS} SELECT count(*) AS n FROM ev WHERE event_type = 'purchase' AND user_id >= 30")
def total_count(spark: SparkSession, d: str) -> DataFrame:
    spec = QuerySpec(PURCHASE.table, (Filter("user_id", "GTE", "30"),))
    return reads.select_events(decode.decode_events(s.logs(spark, d), PURCHASE), spec, COLUMNS).agg(F.count(F.lit(1)).alias("n"))


_NESTED = f"p AS (SELECT * FROM ev WHERE event_type = 'purchase' ORDER BY height, idx LIMIT 301)"
_JOINED = "FROM p LEFT JOIN tx ON tx.chain_id = p.chain_id AND o_orderkey = p.tx"


def _nested(spark: SparkSession, d: str, **sides: bool) -> DataFrame:
    """A page of the stored table, for which of the side tables its own heights are read."""
    return s.sided_store(spark, d).page(PURCHASE, QuerySpec(PURCHASE.table, first=300, **sides))


@query("events_with_tx", f"WITH {EVENTS}, {ORDERS}, {_NESTED} SELECT p.chain_id, p.height, p.idx, {hex_of('o_custkey', 40)} AS from_addr, CAST(tx.cents AS VARCHAR) AS value {_JOINED}")
def events_with_tx(spark: SparkSession, d: str) -> DataFrame:
    held = _nested(spark, d, with_transaction=True)
    return held.select(*store.KEY, w.hex_encode(F.col("transaction.from_addr")).alias("from_addr"), w.uint256_text(F.col("transaction.value")).alias("value"))


@query("events_with_receipt", f"WITH {EVENTS}, {ORDERS}, {_NESTED} SELECT p.chain_id, p.height, p.idx, o_orderstatus IS NOT NULL AND o_orderstatus <> 'P' AS has_receipt, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' END AS ok {_JOINED}")
def events_with_receipt(spark: SparkSession, d: str) -> DataFrame:
    held = _nested(spark, d, with_receipt=True)
    return held.select(*store.KEY, F.col("receipt").isNotNull().alias("has_receipt"), F.when(F.col("receipt.status"), "yes").when(~F.col("receipt.status"), "no").alias("ok"))


@query("events_with_tx_receipt", f"WITH {EVENTS}, {ORDERS}, {_NESTED} SELECT p.chain_id, p.height, p.idx, CAST(tx.cents AS VARCHAR) AS value, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' END AS ok {_JOINED}")
def events_with_tx_receipt(spark: SparkSession, d: str) -> DataFrame:
    held = _nested(spark, d, with_transaction=True, with_receipt=True)
    return held.select(*store.KEY, w.uint256_text(F.col("transaction.value")).alias("value"), F.when(F.col("receipt.status"), "yes").when(~F.col("receipt.status"), "no").alias("ok"))


# --- ranges and reorganisations ---------------------------------------------


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return s.events(spark, d).groupBy("chain_id").agg(F.max("height").alias("target")).select("chain_id", F.lit(1).cast("bigint").alias("next"), "target")


@query("plan_ranges", f"WITH {EVENTS}, t AS (SELECT chain_id, max(height) AS target FROM ev GROUP BY chain_id) SELECT chain_id, lo, least(lo + 36, target) AS hi FROM (SELECT chain_id, target, unnest(range(1, target + 1, 37)) AS lo FROM t)")
def plan_ranges(spark: SparkSession, d: str) -> DataFrame:
    return ranges.plan_ranges(_spans(spark, d), 37)


@query("cap_ranges", f"""WITH RECURSIVE {EVENTS}, hc AS (SELECT chain_id, height, count(*) AS n FROM ev WHERE event_type IN ('purchase', 'view') GROUP BY chain_id, height),
sp(chain_id, lo, hi) AS (
  SELECT chain_id, CAST(1 AS BIGINT), max(height) FROM ev GROUP BY chain_id
  UNION ALL
  SELECT chain_id, CASE WHEN k = 0 THEN lo ELSE lo + (hi - lo) // 2 + 1 END, CASE WHEN k = 0 THEN lo + (hi - lo) // 2 ELSE hi END
  FROM sp, (VALUES (0), (1)) v(k) WHERE lo < hi AND (SELECT coalesce(sum(n), 0) FROM hc WHERE hc.chain_id = sp.chain_id AND height BETWEEN lo AND hi) >= 30
), c AS (SELECT sp.chain_id, lo, hi, CAST(coalesce(sum(n), 0) AS BIGINT) AS n FROM sp LEFT JOIN hc ON hc.chain_id = sp.chain_id AND height BETWEEN lo AND hi GROUP BY sp.chain_id, lo, hi)
SELECT * FROM c WHERE n < 30 OR lo = hi""")
def cap_ranges(spark: SparkSession, d: str) -> DataFrame:
    wanted = s.events(spark, d).where("event_type IN ('purchase', 'view')")
    return ranges.cap_ranges(ranges.height_counts(wanted), _spans(spark, d).select("chain_id", F.col("next").alias("lo"), F.col("target").alias("hi")), 30)


@query("reorg_detect", f"WITH {EVENTS} SELECT chain_id, max(height) AS tip, greatest(max(height) - 12, 0) + 1 AS from_height FROM ev WHERE chain_id = 2 GROUP BY chain_id")
def reorg_detect(spark: SparkSession, d: str) -> DataFrame:
    """Chain 1 agrees, chain 2 does not, chain 3 cannot tell."""
    b = s.blocks(spark, d)
    canonical = b.select("chain_id", "height", F.when(F.col("chain_id") == 2, s.block_hash(-F.col("height") - 1)).otherwise(F.col("hash")).alias("hash"))
    chains = b.select("chain_id").distinct().select("chain_id", F.lit(12).alias("confirmations"), (F.col("chain_id") != 3).alias("supports_reorg"))
    return ranges.reorg_detect(b, canonical, chains)


@query("parent_mismatch", f"WITH {EVENTS}, {BLOCKS} SELECT 0 AS chain_id, height FROM bl WHERE height % 10 <> 0 AND height > 0")
def parent_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """All heights as one chain: parents name blocks three below, but for every tenth."""
    b = s.blocks(spark, d).withColumns({"chain_id": F.lit(0), "parent_hash": F.when(F.col("height") % 10 == 0, s.block_hash(F.col("height") - 1)).otherwise(F.col("parent_hash"))})
    return ranges.parent_mismatch(b)


@query("max_height", f"WITH {EVENTS} SELECT chain_id, max(height) AS height FROM ev GROUP BY chain_id")
def max_height(spark: SparkSession, d: str) -> DataFrame:
    return store.highest(s.blocks(spark, d)).select("chain_id", "height")


@query("last_block", f"WITH {EVENTS} SELECT chain_id, max(height) AS height, '0x' || sha256(CAST(max(height) AS VARCHAR)) AS hash FROM ev GROUP BY chain_id")
def last_block(spark: SparkSession, d: str) -> DataFrame:
    return store.highest(s.blocks(spark, d)).select("chain_id", "height", w.hex_encode(F.col("hash")).alias("hash"))


# --- the tip, in batch form -------------------------------------------------


def _tip(spark: SparkSession, d: str) -> DataFrame:
    return s.logs(spark, d).withColumn("removed", F.col("tx_index") == F.col("height") % 40)


@query("removed_signal", f"WITH {EVENTS} SELECT chain_id, min(height) AS from_height FROM ev WHERE idx // 2 = height % 40 GROUP BY chain_id")
def removed_signal(spark: SparkSession, d: str) -> DataFrame:
    return tip.removed_signal(_tip(spark, d))


@query("late_logs", f"WITH {EVENTS} SELECT chain_id, height, idx FROM ev WHERE idx // 2 <> height % 40 AND height % 3 = 1")
def late_logs(spark: SparkSession, d: str) -> DataFrame:
    """A sweep over a store that missed one chain."""
    return tip.late_logs(_tip(spark, d), s.logs(spark, d).where("height % 3 <> 1")).select(*store.KEY)


@query("tip_rate", f"WITH {EVENTS} SELECT chain_id, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, count(*) AS n FROM ev GROUP BY ALL")
def tip_rate(spark: SparkSession, d: str) -> DataFrame:
    return tip.tip_rate(s.events(spark, d), "1 hour").withColumn("window_start", F.unix_timestamp("window_start"))


# --- jobs and streams, from landed lines to tables --------------------------


@query("backfill_decoded", f"WITH {EVENTS}, {BLOCKS} SELECT ev.chain_id, ev.height, ev.idx, CAST(cents AS VARCHAR) AS cents, time AS at FROM ev JOIN bl ON bl.chain_id = ev.chain_id AND bl.height = ev.height WHERE event_type = 'purchase'")
def backfill_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Lines of logs and blocks, landed in ranges by one job for all chains, and decoded."""
    held, top = store.Store(spark, Scratch(spark, "backfill").path("store"), bucket=1000), _top(spark, d)
    lines = s.log_lines(s.logs(spark, d)).select("chain_id", "value"), s.block_lines(s.blocks(spark, d))
    spans = spark.createDataFrame([(c, 0, top) for c in (1, 2, 3)], "chain_id long, next long, target long")
    jobs.reconcile(held, spans, max(1, top // 3), *lines)
    jobs.decode_pending(held, s.SHOP[:1])
    return held.read(PURCHASE.table).select(*store.KEY, w.uint256_text(F.col("cents")).alias("cents"), F.unix_timestamp("block_time").alias("at"))


@query("tip_stream", f"WITH {EVENTS} SELECT chain_id, height, idx, {hex_of('tx')} AS tx_id, '0x' || sha256(CAST(height AS VARCHAR)) AS block_hash FROM ev WHERE event_id % 50 <> 9")
def tip_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream of log lines and heads: of fifty logs one is an orphan that is removed and replaced, and one is removed for good."""
    scratch, raw = Scratch(spark, "tip"), s.logs(spark, d)
    n = F.col("height") * 10 + F.col("idx")
    orphan = s.block_hash(-F.col("height") - 1)
    steps = F.when(n % 50 == 7, F.array(F.struct(orphan.alias("h"), F.lit(False).alias("r")), F.struct(orphan.alias("h"), F.lit(True).alias("r")), F.struct(F.col("block_hash").alias("h"), F.lit(False).alias("r"))))
    steps = steps.when(n % 50 == 9, F.array(F.struct(F.col("block_hash").alias("h"), F.lit(False).alias("r")), F.struct(F.col("block_hash").alias("h"), F.lit(True).alias("r")))).otherwise(F.array(F.struct(F.col("block_hash").alias("h"), F.lit(False).alias("r"))))
    told = raw.withColumn("n", n).select("*", F.posexplode(steps).alias("step", "s")).withColumns({"block_hash": F.col("s.h"), "removed": F.col("s.r")})
    # Lines of one log stay in order in one file.
    s.log_lines(told.repartition("n").sortWithinPartitions("n", "step")).select("chain_id", "value").write.json(scratch.path("logs"))
    s.events(spark, d).groupBy("chain_id").agg((F.max("height") + 12).alias("head")).write.json(scratch.path("heads"))
    chains = spark.createDataFrame([(c, 12, True) for c in (1, 2, 3)], "chain_id long, confirmations int, supports_reorg boolean")
    held = store.Store(spark, scratch.path("store"), bucket=1000)
    heads = spark.readStream.schema("chain_id long, head long").json(scratch.path("heads"))
    tip.follow(tip.landed_logs(spark, scratch.path("logs")), held, scratch.path("checkpoint"), chains=chains, heads=heads).awaitTermination()
    return held.read("raw_records").select(*store.KEY, w.hex_encode(F.col("tx_id")).alias("tx_id"), w.hex_encode(F.col("block_hash")).alias("block_hash"))


def _orphan(height: Column) -> Column:
    """The hash of a competing block."""
    return s.block_hash(-height - 1)


#: Of ten blocks of a chain two in a row have competitors, one built on the other; and of one the last log is removed for good.
_FORK, _GONE = "(height div 3) % 10 IN (4, 5)", "(height div 3) % 10 = 7 AND idx = 9"


@query("backfill_with_orphans", f"WITH {EVENTS}, {BLOCKS} SELECT ev.chain_id, ev.height, ev.idx, {hex_of('tx')} AS tx_id, '0x' || sha256(CAST(ev.height AS VARCHAR)) AS block_hash, time FROM ev JOIN bl ON bl.chain_id = ev.chain_id AND bl.height = ev.height WHERE NOT ((ev.height // 3) % 10 = 7 AND idx = 9)")
def backfill_with_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Payloads with forks of two blocks, heard after the blocks that were kept, and with logs that were removed."""
    held, top = store.Store(spark, Scratch(spark, "forked").path("store"), bucket=1000), _top(spark, d)
    raw, bl = s.logs(spark, d).withColumn("removed", F.lit(False)), s.blocks(spark, d)
    lost = (F.col("height") <= top - 9) & F.expr(_FORK)
    first = F.expr("(height div 3) % 10 = 4")
    orphans = raw.where(lost).withColumns({"block_hash": _orphan(F.col("height")), "tx_id": w.word(F.col("tx_index") + (1 << 40))})
    removed = raw.where(F.expr(_GONE)).withColumn("removed", F.lit(True))
    rivals = bl.where(lost).withColumns({"hash": _orphan(F.col("height")), "parent_hash": F.when(first, F.col("parent_hash")).otherwise(_orphan(F.col("height") - 3)), "time": F.col("time") + 1000})
    in_turn = lambda lines, n: lines.select("chain_id", "value", F.lit(n).alias("arrived"))
    logs = reduce(DataFrame.unionByName, (in_turn(s.log_lines(x), n) for n, x in enumerate((raw, orphans, removed))))
    blocks = reduce(DataFrame.unionByName, (in_turn(s.block_lines(x), n) for n, x in enumerate((bl, rivals))))
    spans = spark.createDataFrame([(c, 0, top) for c in (1, 2, 3)], "chain_id long, next long, target long")
    jobs.reconcile(held, spans, max(1, top // 3), logs, blocks)
    times = held.blocks().select("chain_id", "height", F.col("hash").alias("block_hash"), "time")
    joined = held.read("raw_records").join(times, ["chain_id", "height", "block_hash"], "left")
    return joined.select(*store.KEY, w.hex_encode(F.col("tx_id")).alias("tx_id"), w.hex_encode(F.col("block_hash")).alias("block_hash"), "time")


def _stream(spark: SparkSession, scratch: Scratch, held: store.Store, name: str, logs: DataFrame, heads: DataFrame, **how) -> None:
    """One run of a stream over what has come to its folders: more files of logs, no two of one log, and one of heads."""
    s.log_lines(logs).select("chain_id", "value").write.mode("append").json(scratch.path(f"{name}-logs"))
    heads.select("chain_id", F.col("head").cast("bigint").alias("head")).coalesce(1).write.mode("append").json(scratch.path(f"{name}-heads"))
    read = spark.readStream.schema("chain_id long, head long").json(scratch.path(f"{name}-heads"))
    chains = spark.createDataFrame([(c, 12, True) for c in (1, 2, 3)], "chain_id long, confirmations int, supports_reorg boolean")
    tip.follow(tip.landed_logs(spark, scratch.path(f"{name}-logs")), held, scratch.path(f"{name}-checkpoint"), chains=chains, heads=read, **how).awaitTermination()


def _heads(spark: SparkSession, d: str, above: int) -> DataFrame:
    return s.events(spark, d).groupBy("chain_id").agg((F.max("height") + above).alias("head"))


@query("probe_rollback", f"""WITH {EVENTS}, t AS (SELECT chain_id, max(height) AS top FROM ev GROUP BY chain_id)
SELECT ev.chain_id, height, idx, '0x' || sha256(CAST(CASE WHEN height > top - 9 THEN -height - 1 ELSE height END AS VARCHAR)) AS block_hash FROM ev JOIN t ON t.chain_id = ev.chain_id""")
def probe_rollback(spark: SparkSession, d: str) -> DataFrame:
    """Every chain is landed up to its tip, of which the last nine heights are then replaced: the probe rolls back twelve, the stream brings the new blocks only, and headers prove the rest."""
    scratch, raw, bl = Scratch(spark, "probe"), s.logs(spark, d), s.blocks(spark, d)
    tops = _heads(spark, d, 0).withColumnRenamed("head", "top")
    held = store.Store(spark, scratch.path("store"), bucket=1000)
    changed = F.col("height") > F.col("top") - 9
    moved = bl.join(F.broadcast(tops), "chain_id").withColumns({"hash": F.when(changed, _orphan(F.col("height"))).otherwise(F.col("hash")), "parent_hash": F.when(F.col("height") - 3 > F.col("top") - 9, _orphan(F.col("height") - 3)).otherwise(F.col("parent_hash"))}).drop("top")
    moved = scratch.keep(moved, "moved")
    _stream(spark, scratch, held, "tip", raw, _heads(spark, d, 12))
    new = raw.join(F.broadcast(tops), "chain_id").where(changed).withColumn("block_hash", _orphan(F.col("height"))).drop("top")
    _stream(spark, scratch, held, "tip", new, _heads(spark, d, 13), canonical=lambda: moved.select("chain_id", "height", "hash"), blocks=lambda: s.block_lines(moved))
    return held.read("raw_records").select(*store.KEY, w.hex_encode(F.col("block_hash")).alias("block_hash"))


@query("two_streams", f"WITH {EVENTS} SELECT chain_id, height, idx, count(*) OVER (PARTITION BY chain_id, height, idx) AS n FROM ev")
def two_streams(spark: SparkSession, d: str) -> DataFrame:
    """One stream lands chains 1 and 2 up to the middle; another one chain 3, and with a checkpoint of its own the rest."""
    scratch, raw, top = Scratch(spark, "streams"), s.logs(spark, d), _top(spark, d)
    held = store.Store(spark, scratch.path("store"), bucket=1000)
    heads = _heads(spark, d, 12)
    _stream(spark, scratch, held, "one", raw.where((F.col("chain_id") < 3) & (F.col("height") <= top // 2)), heads.where("chain_id < 3").withColumn("head", F.lit(top // 2 + 12)))
    _stream(spark, scratch, held, "two", raw.where((F.col("chain_id") == 3) | (F.col("height") > top // 2)), heads)
    rows = held.read("raw_records")
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*store.KEY))).select(*store.KEY, "n")


@query("late_headers", f"""WITH {EVENTS}, {BLOCKS}
SELECT ev.chain_id, ev.height, ev.idx, CAST(cents AS VARCHAR) AS cents, CASE WHEN ev.height % 5 <> 4 THEN time END AS at FROM ev JOIN bl ON bl.chain_id = ev.chain_id AND bl.height = ev.height WHERE event_type = 'purchase'""")
def late_headers(spark: SparkSession, d: str) -> DataFrame:
    """Of five headers two come two batches after their logs were landed and decoded, and one never: block times are those that came, late or not."""
    scratch, raw, bl = Scratch(spark, "late"), s.logs(spark, d), s.blocks(spark, d)
    held = store.Store(spark, scratch.path("store"), bucket=1000)
    for above, known in ((12, "height % 5 < 2"), (13, "height % 5 < 2"), (14, "height % 5 < 4")):
        some = bl.where(known)
        _stream(spark, scratch, held, "tip", raw if above == 12 else raw.limit(0), _heads(spark, d, above), blocks=lambda some=some: s.block_lines(some))
        jobs.decode_pending(held, s.SHOP[:1])
    return held.read(PURCHASE.table).select(*store.KEY, w.uint256_text(F.col("cents")).alias("cents"), F.unix_timestamp("block_time").alias("at"))


@query("held_until_safe", f"WITH {EVENTS}, m AS (SELECT chain_id, max(height) AS top FROM ev GROUP BY chain_id) SELECT ev.chain_id, height, idx FROM ev JOIN m ON m.chain_id = ev.chain_id AND height <= top - 12")
def held_until_safe(spark: SparkSession, d: str) -> DataFrame:
    """A stream of logs and heads through the stateful operator: what is final comes out, the rest stays in its state."""
    scratch, key = Scratch(spark, "held"), "spark.sql.streaming.stateStore.providerClass"
    ev = s.events(spark, d)
    heads = ev.groupBy("chain_id").agg(F.max("height").alias("head"))
    ev.select(*store.KEY).unionByName(heads, allowMissingColumns=True).write.json(scratch.path("in"))
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = spark.readStream.schema("chain_id long, height long, idx long, head long").json(scratch.path("in"))
        out = tip.hold_until_safe(rows, 12).writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("checkpoint"))
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema("chain_id long, height long, idx long").parquet(scratch.path("out"))
