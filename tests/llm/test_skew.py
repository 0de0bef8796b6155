"""Hot keys, merged indexes, dealt ties and clashing names."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from blockloom.llm import decontamination, exact_dedup, jaccard_join, skew, token_file, warc_archive
from blockloom.llm.components import connected_components
from blockloom.scratch import Scratch
from tests.llm.test_operators import documents, prose


def test_salted_join_is_a_left_join(spark, tmp_path):
    spark.range(12_000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("key")).write.parquet(f"{tmp_path}/r")
    rows = spark.read.parquet(f"{tmp_path}/r")
    table = spark.createDataFrame([("hot", "H")] + [(str(k), f"v{k}") for k in range(0, 12_000, 7)], "key string, value string")
    wanted = sorted((r["id"], r["value"]) for r in rows.join(table, "key", "left").select("id", F.coalesce("value", F.lit("-")).alias("value")).collect())
    got = skew.salted(rows, table, "key", "id", 8)
    assert got.columns == ["id", "key", "value"]
    assert sorted((r["id"], r["value"]) for r in got.select("id", F.coalesce("value", F.lit("-")).alias("value")).collect()) == wanted


def test_archive_of_one_page_many_times(spark, tmp_path):
    """Most pages are one and the same empty or short one."""
    pages = spark.range(7000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a/"), "id").alias("url"), F.when(F.col("id") % 7 == 0, F.concat(F.lit("page "), "id")).when(F.col("id") % 2 == 0, "same").alias("html"))
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    rows = warc_archive.op5_warc_archive(spark, str(tmp_path)).groupBy("record_type", "payload_bytes", "refers_to").count().collect()
    found = {(r["record_type"], r["payload_bytes"], r["refers_to"]): r["count"] for r in rows}
    assert found["revisit", 4, 2] == 2999 and found["revisit", 0, 1] == 2999 and sum(found.values()) == 7000


def test_index_is_merged_and_stays_sorted(spark):
    """Each ingest adds a file to a bucket; when there are too many, the index is as after its first one, and is not sorted again."""
    rng = random.Random(4)
    index = exact_dedup.DigestIndex(spark, "merged_index", 2)
    try:
        seen = set()
        for n in range(exact_dedup.MOST_WRITES + 2):
            texts = [prose(rng, 2)[:12] for _ in range(20)]
            rows = index.ingest(documents(spark, [(100 * n + k, t, None) for k, t in enumerate(texts)]), f"b{n}").collect()
            assert sum(r["kept"] for r in rows) == len({t.lower() for t in texts} - seen)
            seen |= {t.lower() for t in texts}
        assert index.writes() <= 2 and index.read().count() == len(seen)
        entries = spark.createDataFrame([(bytearray(b"x"),)], "digest binary")
        index.merge()
        plan = index.unseen(entries)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "LeftAnti" in plan
        assert index.sorts(entries) == 1  # of the new side
        index.append(spark.createDataFrame([(bytearray(bytes([k]) * 32), 1, 1, "y") for k in range(9)], "digest binary, keep_id long, group_size long, batch string"))
        assert index.sorts(entries) == 2
    finally:
        index.drop()


def test_rows_of_one_id_are_dealt_over_tasks(spark, tmp_path):
    """A third of the rows have no id and a third the same one: shards come from many tasks, and what is read back is in order."""
    rng = random.Random(9)
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, prose(rng, 30), None) for k in range(600)]
    manifest = token_file.write_tokens(documents(spark, rows), public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/t", shard_ids=1000)
    assert manifest.select("part").distinct().count() >= 3
    back = token_file.read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    ids = [r["doc_id"] for r in back]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and len(ids) == 600
    ends = [r["start"] + r["n_tokens"] for r in back]
    assert [r["start"] for r in back] == [0, *ends[:-1]]


@pytest.mark.parametrize("clash", ["_dropped_id", "_found_id", "_kept_name", "_found_key", "_kept_digest", "_DROPPED_ID"])
def test_columns_with_the_names_of_helpers(spark, clash):
    rng = random.Random(2)
    text = prose(rng, 40)
    docs = documents(spark, [(1, text, "en"), (2, text, "en"), (3, text + " more", "en"), (4, prose(rng, 30), "en")]).withColumn(clash, F.col("doc_id") * 10)
    bench = spark.createDataFrame([(1, docs.where("doc_id = 4").first()["text"])], "item_id long, text string")
    for stage, wanted in ((exact_dedup.keep_one, [2, 3, 4]), (jaccard_join.keep_representatives, [1, 4]), (lambda d: decontamination.decontaminate(d, bench), [1, 2, 3])):
        out = stage(docs)
        assert out.columns == docs.columns and sorted((r["doc_id"], r[clash]) for r in out.collect()) == [(k, 10 * k) for k in wanted]


def test_jaccard_sets_are_tested_in_small_batches(spark, monkeypatch):
    """A pair's row holds two whole sets, so no table that Python makes is written in batches of Spark's usual size."""
    rows, keep = {}, Scratch.keep

    def seen(self, df, name, *by):
        rows[name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return keep(self, df, name, *by)

    monkeypatch.setattr(Scratch, "keep", seen)
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join([*words, f"end{k}"])) for k in range(60)] + [(100, "alone among these rows")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs, 85, 4).collect()}
    assert found == {k: 0 for k in range(60)} | {100: 100}
    made = [n for n in rows if n.endswith(("-sets", "-links")) or n == "sets"]
    assert {"sets", "star0-links", "rest-links"} <= set(made) and all(rows[n] <= 1000 for n in made)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000


def test_components_of_few_edges_take_few_tasks(spark, tmp_path):
    """Each shuffle is a task a partition, which the driver keeps account of: edges that one task can hold are not shuffled, and make the same components."""
    rng = random.Random(6)
    path = rng.sample(range(900), 60)
    edges = [*zip(path, path[1:], strict=False)] + [(1000, 1001 + k) for k in range(6000)] + [(a, a - rng.randint(1, 9)) for a in range(10_100, 12_000, 6)]
    spark.createDataFrame(edges, "a long, b long").coalesce(2).write.parquet(f"{tmp_path}/e")
    top = {x: x for e in edges for x in e}

    def find(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    context, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    scratch = Scratch(spark, "few-edges")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    context.setJobGroup("few-edges", "components")
    try:
        labels = connected_components(spark.read.parquet(f"{tmp_path}/e"), scratch, "cc")
    finally:
        context._jsc.clearJobGroup()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r["id"]: r["comp"] for r in labels.collect()} == {x: find(x) for x in top}
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-edges") for s in tracker.getJobInfo(j).stageIds}
    assert 0 < sum(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s)) < 64
    scratch.close()
