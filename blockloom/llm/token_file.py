"""Token ids as binary shards: frequency-ranked, byte-aligned, control bytes apart.

Ids are replaced by their rank in the corpus (most frequent first, ties by id)
and stored in as few whole bytes as the rank needs. The lengths of a run of
values are packed in a control byte; control and data bytes are separate
streams, so numpy decodes a shard by table lookup: the control bytes select
rows of small tables with each value's length and place.

A vocabulary of up to 65,536 ids takes 1 or 2 bytes a value and 1 bit of
control; a larger one 1 to 4 bytes and 2 bits.

A shard (little-endian): the magic ``RKVB0001``, the u64 numbers part, shard,
ids before it in its part, documents, ids, control bytes and bits of control;
then for each document its id (i64), whether it has one (u8) and its ids
(u64); control bytes; data bytes; crc32 of all before it (u32). Parts and
their shards are in ascending order of doc_id. The table of ranks is kept
beside the shards, once.

Rules. A null text counts as empty and is its end id alone; texts of any length
are encoded whole. Null doc_ids come first; rows that repeat a doc_id all stay,
ordered by their number of ids and then by a hash and the bytes of their packed
ids, so that equal rows are all that can change places. Other columns are not read. An empty table writes no shard and reads as an empty table. A shard is
written under a name of its own and then moved into place, so a task that runs
again replaces its own shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .batches import map_rows, slices, small_batches
from .tokens import encoder

END_ID = 2
#: Shards of a range at most, on average: ranges grow in number with the input.
PART_SHARDS = 16
#: A shard is closed when it holds so many ids; a longer document has one of its own.
SHARD_IDS = 2_000_000
_MAGIC, _HEAD, _SLICE = b"RKVB0001", struct.Struct("<8s7Q"), 1 << 18


def control_bits(vocabulary: int) -> int:
    return 1 if vocabulary <= 1 << 16 else 2


def _tables(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By control byte: each value's bytes, its place in the run, and the bytes of the run."""
    each = 8 // bits
    lengths = (np.arange(256)[:, None] >> (bits * np.arange(each)) & ((1 << bits) - 1)) + 1
    return lengths, np.cumsum(lengths, axis=1) - lengths, lengths.sum(axis=1)


def encode_ranks(ranks: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Control and data bytes. The last run is filled up with zeros."""
    each = 8 // bits
    control, data = [], []
    for lo in range(0, len(ranks), _SLICE):
        v = ranks[lo : lo + _SLICE].astype("<u4")
        v = np.concatenate((v, np.zeros(-len(v) % each, "<u4")))
        code = (v > 0xFF).astype(np.uint8)
        if bits == 2:
            code += (v > 0xFFFF).astype(np.uint8) + (v > 0xFFFFFF)
        control.append((code.reshape(-1, each) << (bits * np.arange(each, dtype=np.uint8))).sum(axis=1).astype(np.uint8).tobytes())
        width = 1 << bits
        data.append(v.view(np.uint8).reshape(-1, 4)[:, :width][np.arange(width) <= code[:, None]].tobytes())
    return b"".join(control), b"".join(data)


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The first n values, by table lookup."""
    lengths, places, totals = _tables(bits)
    each, width = 8 // bits, 1 << bits
    out = np.empty(len(control) * each, np.uint32)
    data = np.concatenate((data, np.zeros(width, np.uint8)))
    at = 0
    for lo in range(0, len(control), _SLICE // each):
        c = control[lo : lo + _SLICE // each]
        run = totals[c]
        starts = np.cumsum(run) - run + at
        where = (starts[:, None] + places[c]).ravel()
        size = lengths[c].ravel()
        v = data[where].astype(np.uint32)
        for k in range(1, width):
            v |= np.where(size > k, data[np.minimum(where + k, len(data) - 1)], 0).astype(np.uint32) << np.uint32(8 * k)
        out[lo * each : lo * each + len(v)] = v
        at += int(run.sum())
    return out[:n]


def _tokenize(batches: Iterator[pd.DataFrame], path: str, end_id: int) -> Iterator[pd.DataFrame]:
    """Each document's ids, compressed; and, under a null blob, how often each id came up in this task."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
    counts = np.zeros(0, np.int64)
    for pdf in slices(batches):
        held = [x + end for x in enc.encode([t or "" for t in pdf["text"]])]
        seen = np.bincount(np.frombuffer(b"".join(held), "<u4"))
        counts = np.pad(counts, (0, max(0, len(seen) - len(counts))))
        counts[: len(seen)] += seen
        yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "n": [len(x) // 4 for x in held], "blob": [pack(_narrow(x)) for x in held], "counts": None})
    if len(counts):
        yield pd.DataFrame({"doc_id": [None], "n": [-1], "blob": [None], "counts": [counts.tobytes()]})


def _narrow(ids: bytes) -> bytes:
    """Low halves, then high halves: the latter are all zero and compress to nothing for most vocabularies."""
    v = np.frombuffer(ids, "<u2")
    return v[0::2].tobytes() + v[1::2].tobytes()


def _wide(blob: bytes) -> np.ndarray:
    import zstandard

    halves = np.frombuffer(zstandard.decompress(blob), "<u2").reshape(2, -1).astype(np.uint32)
    return halves[0] | halves[1] << np.uint32(16)


def _sum_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(0, np.int64)
    for pdf in batches:
        for x in pdf["counts"]:
            seen = np.frombuffer(x, np.int64)
            total = np.pad(total, (0, max(0, len(seen) - len(total))))
            total[: len(seen)] += seen
    used = np.flatnonzero(total)
    if len(used):
        yield pd.DataFrame({"id": used, "n": total[used]})


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_shards(batches: Iterator[pd.DataFrame], folder: str, rank_of, bits: int, most: int) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    context = TaskContext.get()
    part, attempt = context.partitionId(), context.taskAttemptId()
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    made, before = 0, 0
    held: list[tuple[int | None, np.ndarray]] = []

    def close() -> dict:
        nonlocal made, before, held
        ids = np.concatenate([x for _, x in held])
        control, data = encode_ranks(rank_of.value[ids], bits)
        docs = np.array([0 if d is None else d for d, _ in held], "<i8").tobytes() + bytes(d is not None for d, _ in held) + np.array([len(x) for _, x in held], "<u8").tobytes()
        body = _HEAD.pack(_MAGIC, part, made, before, len(held), len(ids), len(control), bits) + docs + control + data
        body += struct.pack("<I", zlib.crc32(body))
        name = f"{root}/part-{part:06d}-{made:06d}.rkvb"
        with files.open_output_stream(f"{name}.{attempt}") as f:
            f.write(body)
        if files.get_file_info(name).is_file:  # of an earlier run of this task; some stores do not rename onto a file
            files.delete_file(name)
        files.move(f"{name}.{attempt}", name)
        row = {"part": part, "shard": made, "docs": len(held), "ids": len(ids), "bytes": len(body)}
        made, before, held = made + 1, before + len(ids), []
        return row

    size, rows = 0, []
    for pdf in batches:
        for doc_id, blob in zip(pdf["doc_id"], pdf["blob"], strict=True):
            ids = _wide(blob)
            if held and size + len(ids) > most:
                rows.append(close())
                size = 0
            held.append((None if doc_id is None else int(doc_id), ids))
            size += len(ids)
    if held:
        rows.append(close())
    if rows:
        yield pd.DataFrame(rows)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes ``docs`` and writes shards and the table of ranks under ``folder`` (a URI).

    Returns the manifest that is written too: part, shard, docs, ids, bytes.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with small_batches(spark):
        encoded = scratch.keep(map_rows(rows, partial(_tokenize, path=tokenizer, end_id=end_id), "doc_id long, n long, blob binary, counts binary", "doc_id"), "encoded")
    # One row of counts a task, as long as the vocabulary; sums go by a few tasks and then by id.
    sums = encoded.where("n < 0").select("counts").mapInPandas(_sum_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = sums.collect()  # the vocabulary at most
    ids = np.array([r["id"] for r in counts], np.int64)
    order = np.lexsort((ids, -np.array([r["n"] for r in counts], np.int64)))
    by_rank = ids[order]
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(by_rank)), "id": by_rank}), "rank long, id long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranks")

    ids = encoded.where("n >= 0").agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids // (PART_SHARDS * shard_ids)))
    # Rows of one doc_id, or without one, are dealt by what orders them, so that none of them need be together.
    ordered = encoded.where("n >= 0").select("doc_id", "n", "blob").repartitionByRange(parts, "doc_id", "n", F.xxhash64("blob")).sortWithinPartitions("doc_id", "n", F.xxhash64("blob"), "blob")
    write = partial(_write_shards, folder=f"{folder}/shards", rank_of=spark.sparkContext.broadcast(rank_of), bits=control_bits(len(by_rank)), most=shard_ids)
    # Ids go as text, which keeps them exact beside nulls.
    manifest = ordered.select(F.col("doc_id").cast("string").alias("doc_id"), "blob").mapInPandas(write, "part long, shard long, docs long, ids long, bytes long")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    scratch.drop("encoded")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def parse_shard(body: bytes) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Header, document ids, whether they are set, lengths and ranks of a shard; raises if it is damaged."""
    if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
        raise ValueError("damaged shard")
    magic, part, shard, before, docs, n, controls, bits = _HEAD.unpack_from(body)
    if magic != _MAGIC:
        raise ValueError("not a shard")
    at = _HEAD.size
    doc_ids = np.frombuffer(body, "<i8", docs, at)
    known = np.frombuffer(body, np.bool_, docs, at + 8 * docs)
    lengths = np.frombuffer(body, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    ranks = decode_ranks(np.frombuffer(body, np.uint8, controls, at), np.frombuffer(body, np.uint8, len(body) - 4 - at - controls, at + controls), n, bits)
    return {"part": part, "shard": shard, "before": before, "ids": n}, doc_ids, known, lengths, ranks


def _read(batches: Iterator[pd.DataFrame], id_of, with_ids: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for body in pdf["content"]:
            head, doc_ids, known, lengths, ranks = parse_shard(body)
            ids = id_of.value[ranks].astype("<u4").tobytes()
            ends = np.cumsum(lengths)
            held = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends, lengths, strict=True)]
            names = [str(d) if k else None for d, k in zip(doc_ids.tolist(), known.tolist(), strict=True)]
            out = pd.DataFrame({"doc_id": names, "part": head["part"], "start": ends - lengths + head["before"], "n_tokens": lengths, "ids_crc32": [zlib.crc32(x) for x in held]})
            yield out.assign(ids=held) if with_ids else out


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """A row per document from the shards: doc_id, start, n_tokens, ids_crc32, and ids on request."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    ranks = spark.read.parquet(f"{folder}/ranks").collect()  # the vocabulary at most
    id_of = np.zeros(len(ranks), np.uint32)
    for r in ranks:
        id_of[r["rank"]] = r["id"]
    schema = "doc_id long, part long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    columns = ["doc_id", "start", "n_tokens", "ids_crc32", *(("ids",) if with_ids else ())]
    if not manifest.take(1):
        return spark.createDataFrame([], schema).select(columns)
    # Sums over parts, of which there are as many as write tasks; documents are not gathered.
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).selectExpr("part", "cast(coalesce(sum(ids) over (order by part rows between unbounded preceding and 1 preceding), 0) as bigint) as base")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rkvb").load(f"{folder}/shards").select("content")
    rows = map_rows(files, partial(_read, id_of=spark.sparkContext.broadcast(id_of), with_ids=with_ids), schema, "doc_id")
    return rows.join(parts, "part").withColumn("start", F.col("start") + F.col("base")).select(columns)


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = Scratch(spark, "tokenfile").path("corpus")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_tokens(spark, folder)
