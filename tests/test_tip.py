"""The tip stream where things go wrong: rollbacks by the probe, second streams, late payloads, competing blocks; and the log under many writers."""

import json
import time

import pytest
from pyspark.sql import functions as F

from blockloom.catalog import read_abi
from blockloom.operators import forks
from blockloom.operators.commit_log import CommitLog, Conflict
from blockloom.operators.store import Store, covered
from blockloom.plans import jobs
from blockloom.streaming import tip
from blockloom.streaming.lateness import LateRows, late_rows

EVENT = read_abi([{"type": "event", "name": "Ping", "inputs": [{"name": "n", "type": "uint256"}]}], "app")[0]
HASHES = "chain_id long, height long, hash binary"
LINES = "chain_id long, value string"


def log(height, mark="aa", removed=False, idx=0):
    return {"address": "0x01", "topics": ["0x" + EVENT.key.hex()], "data": "0x" + height.to_bytes(32).hex(), "blockNumber": hex(height), "blockHash": f"0x{mark}{height:02x}", "logIndex": hex(idx), "transactionHash": f"0x{mark}{height:04x}", "removed": removed}


def header(height, mark="aa", parent=None, txs=()):
    tx = lambda h: {"hash": h, "from": "0x01", "to": "0x02", "value": "0x5", "input": "0x", "gas": "0x1", "nonce": "0x0"}
    return {"number": hex(height), "hash": f"0x{mark}{height:02x}", "parentHash": f"0x{parent or mark}{height - 1:02x}", "timestamp": hex(1000 + height), "transactions": [tx(h) for h in txs]}


def receipt(tx, block=None):
    return {"transactionHash": tx, "status": "0x1", "gasUsed": "0x1", "effectiveGasPrice": "0x1", **({"blockHash": block} if block else {})}


def lines(spark, rows, chain=1):
    return spark.createDataFrame([(chain, json.dumps(r)) for r in rows], LINES)


class Feed:
    """A stream's folders, and a chain's payloads as of now."""

    def __init__(self, spark, path, confirmations=3, checkpoint="cp", **follow):
        self.spark, self.path, self.n, self.follow, self.checkpoint = spark, path, 0, follow, checkpoint
        for name in ("in", "heads"):
            (path / name).mkdir(parents=True, exist_ok=True)
        self.held = Store(spark, f"file://{path}/s", bucket=100)
        self.chains = spark.createDataFrame([(1, confirmations, True, 1)], "chain_id long, confirmations int, supports_reorg boolean, start long")

    def run(self, logs=(), head=None):
        self.n += 1
        if logs:
            (self.path / f"in/{self.checkpoint}-{self.n}.json").write_text("\n".join(json.dumps({"chain_id": 1, "value": json.dumps(x)}) for x in logs))
        if head is not None:
            (self.path / f"heads/{self.checkpoint}-{self.n}.json").write_text(json.dumps({"chain_id": 1, "head": head}))
        heads = self.spark.readStream.schema("chain_id long, head long").json(f"file://{self.path}/heads")
        tip.follow(tip.landed_logs(self.spark, f"file://{self.path}/in"), self.held, f"file://{self.path}/{self.checkpoint}", chains=self.chains, heads=heads, **self.follow).awaitTermination(300)
        return self.stored()

    def stored(self):
        return sorted((r["height"], bytes(r["block_hash"]).hex()[:2]) for r in self.held.read("raw_records").collect())

    def cursor(self):
        return self.held.cursor().first()["last_height"]


def hashes(spark, marks):
    return spark.createDataFrame([(1, h, bytearray.fromhex(f"{m}{h:02x}")) for h, m in marks.items()], HASHES)


def test_probe_rollback_loses_nothing(spark, tmp_path):
    """Logs that were rolled back, or waited, and are canonical come back; the replaced block is the new one."""
    now = {h: "aa" for h in range(1, 13)}
    feed = Feed(spark, tmp_path, canonical=lambda: hashes(spark, now))
    assert feed.run([log(h) for h in range(1, 13)], 13) == [(h, "aa") for h in range(1, 11)] and feed.cursor() == 10
    now[10] = "bb"
    assert feed.run([log(10, "bb")], 15) == [(h, "bb" if h == 10 else "aa") for h in range(1, 13)]
    assert feed.cursor() == 12 and feed.held.opened().count() == 0 and feed.held.read("pending_logs").count() == 0


def test_what_nothing_proves_stays_open(spark, tmp_path):
    """The probe knows one height only: the others stay open, and the reconcile job lands them."""
    now = {10: "aa"}
    feed = Feed(spark, tmp_path, canonical=lambda: hashes(spark, now))
    feed.run([log(h) for h in range(1, 13)], 13)
    now[10] = "bb"
    assert feed.run([log(10, "bb")], 15) == [(h, "aa") for h in range(1, 8)] + [(10, "bb")]
    assert feed.cursor() == 7 and sorted((r["lo"], r["hi"]) for r in feed.held.opened().collect()) == [(8, 9), (11, 12)]
    assert feed.run([log(13, "bb")], 16)[-1] == (13, "bb") and feed.cursor() == 7  # the stream goes on above
    branch = [log(h) for h in (8, 9)] + [log(h, "bb") for h in (10, 11)]
    spans = spark.createDataFrame([(1, 1, 13)], "chain_id long, next long, target long")
    assert jobs.reconcile(feed.held, spans, 100, lines(spark, branch), lines(spark, [header(8)])) == 2
    assert feed.stored() == [(h, "aa") for h in range(1, 10)] + [(10, "bb"), (11, "bb"), (13, "bb")] and feed.cursor() == 13


@pytest.mark.parametrize("by", ["headers", "answers"])
def test_headers_or_empty_answers_close_a_range(spark, tmp_path, by):
    """Removed logs of a branch; the new one holds logs at 9 only, which headers in a row, or the node's word, prove."""
    held = [header(h) for h in range(1, 13)]
    answers = [] if by == "headers" else [(1, 8, 8), (1, 10, 11)]
    said = (lambda: lines(spark, held)) if by == "headers" else None
    feed = Feed(spark, tmp_path, blocks=said, answers=lambda: spark.createDataFrame(answers, "chain_id long, from_height long, to_height long"))
    feed.run([log(h) for h in range(1, 12)], 13)
    gone = [log(h, removed=True) for h in range(8, 12)]
    if by == "headers":
        held += [header(8, "bb", "aa"), *(header(h, "bb") for h in (9, 10))]
    assert feed.run([*gone, log(9, "bb")], 14) == [(h, "aa") for h in range(1, 8)] + [(9, "bb")]
    assert feed.cursor() == (10 if by == "headers" else 11)
    if by == "headers":
        held += [header(11, "bb"), header(12, "bb")]
        assert feed.run([], 15) == [(h, "aa") for h in range(1, 8)] + [(9, "bb")]
        assert feed.cursor() == 12 and feed.held.opened().count() == 0


def test_two_streams_and_a_new_checkpoint(spark, tmp_path):
    held = None
    for name, batch, head, wanted in (("one", (1, 2, 3), 6, 3), ("two", (4, 5, 6), 9, 6), ("again", (7,), 10, 7)):
        feed = Feed(spark, tmp_path, checkpoint=name)
        held = held or feed.held
        got = feed.run([log(h) for h in batch], head)
        assert [h for h, _ in got] == list(range(1, wanted + 1)) and feed.cursor() == wanted
        assert len({h for h, _ in got}) == len(got)


def test_late_payloads_land_and_what_never_comes_expires(spark, tmp_path):
    held, slips = [header(4, txs=["0xaa0004"])], []
    feed = Feed(spark, tmp_path, blocks=lambda: lines(spark, held), receipts=lambda: lines(spark, slips or [receipt("0x00")]), patience=4)
    feed.run([log(4), log(5), log(6)], 9)
    blocks = lambda: sorted((r["height"], r["time"]) for r in feed.held.blocks().collect())
    assert blocks() == [(4, 1004)] and feed.held.read("wants").count() == 3
    jobs.decode_pending(feed.held, [EVENT])
    times = lambda: {r["height"]: r["t"] for r in feed.held.read(EVENT.table).select("height", F.unix_timestamp("block_time").alias("t")).collect()}
    assert times() == {4: 1004, 5: None, 6: None}
    feed.run([], 10)
    feed.run([], 11)
    # Three batches later.
    held += [header(5, txs=["0xaa0005", "0xff"]), header(6, "cc", txs=["0xaa0006"])]  # of 6 another block
    slips += [receipt("0xaa0005", "0xaa05"), receipt("0xaa0005", "0xcc05"), receipt("0xaa0004")]
    feed.run([], 12)
    assert blocks() == [(4, 1004), (5, 1005)]
    assert sorted(bytes(r["tx_id"]).hex() for r in feed.held.read("receipts").collect()) == ["aa0004", "aa0005"]
    assert sorted(bytes(r["tx_id"]).hex() for r in feed.held.read("transactions").collect()) == ["aa0004", "aa0005"]
    assert [r["height"] for r in feed.held.read("wants").collect()] == [6]
    jobs.decode_pending(feed.held, [EVENT])
    assert times() == {4: 1004, 5: 1005, 6: None}
    feed.run([], 13)
    assert feed.held.read("wants").count() == 0
    assert [(r["height"], r["header"], r["transaction"], r["receipt"]) for r in feed.held.read("expired_wants").collect()] == [(6, True, True, True)]


# competing blocks ------------------------------------------------------------


def test_the_branch_that_reaches_highest(spark):
    rows, arrived = [], 0

    def add(height, name, parent):
        nonlocal arrived
        arrived += 1
        rows.append((1, height, bytearray(name.encode()), bytearray(parent.encode()), arrived))

    for h in range(1, 40):
        add(h, f"a{h}", f"a{h - 1}")
    for h in range(5, 25):  # a long fork that ends, with one of its own
        add(h, f"b{h}", f"b{h - 1}" if h > 5 else "a4")
    for h in range(20, 23):
        add(h, f"c{h}", f"c{h - 1}" if h > 20 else "b19")
    add(39, "d39", "a38")  # of the same reach as a39, heard later
    add(30, "e30", "unknown")
    frame = spark.createDataFrame(rows, "chain_id long, height long, hash binary, parent_hash binary, arrived long")
    got = {r["height"]: bytes(r["hash"]).decode() for r in forks.canonical_branch(frame).collect()}
    assert got == {h: f"a{h}" for h in range(1, 39)} | {39: "d39"}
    assert forks.canonical_branch(frame.limit(0)).count() == 0


def test_linked_headers_and_runs(spark):
    frame = spark.createDataFrame([(1, h, bytearray(x.encode()), bytearray(p.encode())) for h, x, p in [(5, "a", "-"), (6, "b", "a"), (9, "c", "b"), (10, "d", "?"), (11, "e", "d")]], "chain_id long, height long, hash binary, parent_hash binary")
    assert sorted((r["lo"], r["hi"]) for r in forks.linked(frame).collect()) == [(5, 5), (6, 6), (10, 10), (11, 11)]
    pieces = spark.createDataFrame([(1, 1, 3), (1, 4, 6), (1, 2, 2), (1, 9, 30), (2, 1, 9)], "chain_id long, lo long, hi long")
    spans = spark.createDataFrame([(1, 2, 5), (1, 8, 12)], "chain_id long, lo long, hi long")
    assert sorted((r["lo"], r["hi"]) for r in covered(pieces, spans).collect()) == [(2, 5), (9, 12)]


def test_backfill_lands_no_orphan(spark, tmp_path):
    """Logs of block A, their removal, and those of B at one place; one removed for good; an orphan without a removal; a stale receipt."""
    said = [log(1), log(1, removed=True), log(1, "bb"), log(2), log(2, removed=True), log(3), log(3, "cc"), log(4), log(5, "dd"), log(5, "ee")]
    heard = [header(1), header(1, "bb", "00"), header(2), header(3, parent="bb"), header(3, "cc", "bb"), header(4, txs=["0xaa0004"])]
    slips = [receipt("0xaa0003", "0xcc03"), receipt("0xaa0003", "0xaa03"), receipt("0xaa0004", "0xff")]
    held = Store(spark, f"file://{tmp_path}/s", bucket=100)
    assert jobs.backfill(held, [EVENT], 1, 1, 5, 100, lines(spark, said), lines(spark, heard), lines(spark, slips)) == 1
    assert sorted((r["height"], bytes(r["block_hash"]).hex()) for r in held.read("raw_records").collect()) == [(1, "bb01"), (3, "aa03"), (4, "aa04"), (5, "ee05")]
    assert sorted((r["height"], bytes(r["hash"]).hex()) for r in held.blocks().collect()) == [(1, "bb01"), (3, "aa03"), (4, "aa04")]
    assert [bytes(r["tx_id"]).hex() for r in held.read("receipts").collect()] == ["aa0003"]
    assert held.cursor().first()["last_height"] == 5


# the log ---------------------------------------------------------------------


def entry(lo, hi, chain=1, kind="ingest"):
    return {"kind": kind, "chain_id": chain, "from_height": lo, "to_height": hi, "rows": 0}


def test_writers_that_lose_try_again(spark, tmp_path):
    one, two = (CommitLog(spark, f"file://{tmp_path}/s") for _ in range(2))
    assert one.append("a", [entry(0, 9)], 0) == 1
    assert two.append("b", [entry(0, 9, chain=2)], 0) == 2  # on an older state, but of another chain
    assert two.append("b", [entry(0, 9, chain=2)], 0) == 2  # once only
    with pytest.raises(Conflict):
        one.append("c", [entry(5, 14)], 0)
    assert one.append("c", [entry(10, 14)], 0) == 3
    assert two.append("d", [{"kind": "rollback", "chain_id": 1, "from_height": 0}], 0) == 4
    with pytest.raises(Conflict):
        one.append("e", [entry(20, 29)], 3)
    assert one.files.put_new(f"file://{tmp_path}/s/log/{5:020d}.json", "{}\n") and not two.files.put_new(f"file://{tmp_path}/s/log/{5:020d}.json", "{}\n")


def test_a_loser_works_on_the_newer_state(spark, tmp_path):
    """Between a writer's read and its commit another lands the same heights: the rows are there once."""
    schema = "chain_id long, height long, idx long, block_hash binary, tx_id binary, value long"
    rows = spark.createDataFrame([(1, h, 0, bytearray(b"h"), bytearray(b"t"), 1) for h in (1, 2)], schema)
    none = spark.createDataFrame([], "chain_id long, height long, hash binary, parent_hash binary, time long")
    slow, fast = (Store(spark, f"file://{tmp_path}/s", bucket=10) for _ in range(2))
    append, tries = slow.log.append, []

    def late(*args):
        tries.append(args)
        if len(tries) == 1:
            fast.ingest("fast", 1, 0, 9, rows, none)
        return append(*args)

    slow.log.append = late
    slow.ingest("slow", 1, 0, 9, rows, none)
    assert len(tries) == 2 and slow.read("raw_records").count() == 2


def test_a_long_log_opens_few_files(spark, tmp_path):
    held = CommitLog(spark, f"file://{tmp_path}/s", every=20)
    for n in range(320):
        held.append(f"b-{n}", [entry(10 * n, 10 * n + 9)], n)
    opened, fresh = [], CommitLog(spark, f"file://{tmp_path}/s", every=20)
    read = fresh.files.read
    fresh.files.read = lambda path: opened.append(path) or read(path)
    number, rows = fresh.read()
    assert number == 320 and rows.count() == 320 and len(opened) < 20
    assert len(held.files.glob(f"{held.root}/log/*.json")) <= 60 and len(held.files.glob(f"{held.root}/packed/*")) == 2
    with pytest.raises(Conflict):  # so far behind that the files are gone
        fresh.append("old", [entry(0, 1, chain=7)], 3)


def test_late_rows_are_counted(spark, tmp_path):
    """Three rows behind the watermark, of three windows, and their lag."""
    (tmp_path / "in").mkdir()
    watcher = LateRows(spark, f"file://{tmp_path}/late")
    spark.streams.addListener(watcher)
    try:
        for n, times in enumerate((["12:00:10", "12:00:20"], ["12:30:00"], ["12:01:00", "12:02:00", "12:03:00", "12:31:00"])):
            (tmp_path / f"in/{n}.json").write_text("\n".join(json.dumps({"chain_id": 1, "ts": f"2024-01-01T{t}Z"}) for t in times))
            rows = spark.readStream.schema("chain_id long, ts timestamp").json(f"file://{tmp_path}/in")
            tip.tip_rate(rows, "1 minute", "5 minutes").writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).outputMode("update").start().awaitTermination(120)
        wanted = time.time() + 30
        while time.time() < wanted and (late_rows(spark, f"file://{tmp_path}/late").agg(F.sum("dropped")).first()[0] or 0) < 3:
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(watcher)
    found = late_rows(spark, f"file://{tmp_path}/late")
    assert found.agg(F.sum("dropped")).first()[0] == 3 and found.where("dropped > 0").count() == 1
    assert found.where("dropped > 0").first()["lag_s"] > 0 and late_rows(spark, f"file://{tmp_path}/none").count() == 0


def test_upkeep_compacts_and_clears(spark, tmp_path):
    schema = "chain_id long, height long, idx long, block_hash binary, tx_id binary, value long"
    row = lambda h: spark.createDataFrame([(1, h, 0, bytearray(b"h"), bytearray(b"t"), h)], schema)
    held = Store(spark, f"file://{tmp_path}/s", bucket=10)
    for h in range(4):
        held.put_typed("t", row(h), f"b{h}", 1, h, h)
    assert held.maintain(3, 0) == [("t", 1)] and held.maintain(3, 0) == []
    assert len(held.files.glob(f"{held.root}/t/*/*/write_id=*")) == 1 and sorted(r["value"] for r in held.read("t").collect()) == [0, 1, 2, 3]


def test_a_checkpoint_drops_what_shows_nothing(spark, tmp_path):
    """Writes that were replaced, compacted or rolled back leave the log, and the tables read as before."""
    schema = "chain_id long, height long, idx long, block_hash binary, tx_id binary, value long"
    rows = lambda heights, value: spark.createDataFrame([(1, h, 0, bytearray(b"h"), bytearray(b"t"), value) for h in heights], schema)
    held = Store(spark, f"file://{tmp_path}/s", bucket=10)
    for k in range(3):  # each takes the place of the one before
        held.put_tables(f"r{k}", [(1, 0, 9)], {"t": (rows([1, 5], k), None)}, "replace")
    held.put_tables("d", [(1, 20, 29)], {"t": (rows([25], 7), None)})
    held.rollback("back", 1, 20)
    held.put_tables("e", [(1, 20, 29)], {"t": (rows([26], 8), None)})
    for k in range(2):
        held.put_tables(f"u{k}", [(1, k, k)], {"u": (rows([k], k), None)})
    held.compact("u", 1, "packed")
    read = lambda store: {t: sorted((r["height"], r["value"]) for r in store.read(t).collect()) for t in ("t", "u")}
    wanted, before = read(held), held.commits().count()
    assert wanted == {"t": [(1, 2), (5, 2), (26, 8)], "u": [(0, 0), (1, 1)]}
    held.log.pack()
    again = Store(spark, held.root, bucket=10)
    assert read(again) == wanted and again.commits().count() < before - 6
    names = {r["batch_id"] for r in again.commits().where("table = 't' AND kind <> 'schema'").collect()}
    assert names == {"r2", "e"}
    again.put_tables("r3", [(1, 0, 9)], {"t": (rows([2], 9), None)}, "replace")
    assert read(again)["t"] == [(2, 9), (26, 8)]
