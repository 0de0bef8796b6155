"""Benchmark passages in training documents, by spaced-seed hashing.

A seed is a fixed mask over consecutive words that ignores some positions, so
words substituted there do not matter; several masks cover the ways in which
substitutions can fall. Test and training hashes of all masks are joined in
Spark. Each hit proposes an alignment of an item and a document, which is then
verified word by word: an item is found where in some stretch of ``window``
aligned words (or in the whole of a shorter item) at least ``share`` agree.

Words are runs of letters and digits of any script, lower-cased; other
characters between them do not matter. In scripts without spaces each character
is a word. A bitmap of fixed size of all test hashes keeps words that
no item has out of the join; it drops no hit.

A seed that a text or an item repeats at more than ``REPEATS`` places stands
for all alignments of the two, which are then tried in one pass; so no text
makes more than a bounded number of hits a seed, and none is lost. Items are
verified ``ITEMS`` at a time for a text, however many it meets.

Rules. Texts are read whole, of any length. Of alignments that agree equally the
first in the document is reported. Null or empty texts and items contain nothing. An item of fewer words
than the widest mask is found where all its words stand in a row, by a hash of
them at its own length. Rows with a
null doc_id are judged like others; repeated rows each give their rows; items
that repeat an item_id are told apart by their words. Other columns are not
read. Without items, or documents, the result is empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .batches import map_rows, slices, small_batches
from .skew import free_name
from .textwords import NOT_ALNUM, windows, word_hashes
from .workers import clear

#: Positions that each mask reads: five words. The first three leave some residue modulo five free; with the
#: last, some mask fits somewhere however the words that may differ fall in 8 to 20.
MASKS = ((0, 1, 2, 3, 5), (0, 1, 3, 4, 6), (0, 2, 3, 6, 7), (0, 1, 5, 6, 7))
WINDOW, SHARE = 20, 0.8
#: Places of a seed in one text from which on alignments are not listed one by one, and items of a text that are verified together.
REPEATS, ITEMS = 32, 64
#: Bits of the bitmap, and bits in one of its rows.
BITMAP, _ROW = 1 << 24, 1 << 15


#: Beyond ASCII: what is no letter or digit, and letters of scripts without spaces.
_APART = re.compile(r"[^\x00-\x7f\w]+")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def _spaced(text: str) -> str:
    """Words beyond ASCII set apart by spaces."""
    if text.isascii():
        return text
    return _UNSPACED.sub(r" \g<0> ", _APART.sub(" ", text))


def _words(texts) -> list[np.ndarray]:
    return word_hashes([_spaced(t.lower()) if isinstance(t, str) else "" for t in texts], NOT_ALNUM)


def _seeds(words: np.ndarray, masks, lengths=()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all masks, and of as many words as the lengths say, at all positions; and the positions."""
    hashes = [windows(words, m) ^ np.uint64(k) for k, m in enumerate(masks)]
    hashes += [windows(words, range(n)) ^ np.uint64(len(masks) + n) for n in lengths]
    return np.concatenate(hashes), np.concatenate([np.arange(len(h)) for h in hashes])


def _listed(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds and their places; those with more than ``REPEATS`` once, at -1."""
    if len(hashes) <= REPEATS:
        return hashes, at
    order = np.argsort(hashes, kind="stable")
    hashes, at = hashes[order], at[order]
    found, count = np.unique(hashes, return_counts=True)
    many = count > REPEATS
    if not many.any():
        return hashes, at
    few = np.repeat(~many, count)
    return np.concatenate((hashes[few], found[many])), np.concatenate((at[few], np.full(int(many.sum()), -1)))


def _items(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = _words(pdf["text"])
        keep = [len(w) > 0 for w in words]
        yield pd.DataFrame({"item_id": pdf["item_id"][keep], "words": [w.tobytes() for w, k in zip(words, keep, strict=True) if k]})


def _item_seeds(batches: Iterator[pd.DataFrame], masks, widest: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for item_key, held in zip(pdf["item_key"], pdf["words"], strict=True):
            words = np.frombuffer(held, np.uint64)
            hashes, at = _seeds(words, masks) if len(words) >= widest else _seeds(words, masks, [len(words)])
            # Masks that fit into a shorter item would propose it where some words differ.
            if len(words) < widest:
                hashes, at = hashes[-1:], at[-1:]
            hashes, at = _listed(hashes, at)
            yield pd.DataFrame({"hash": hashes.view(np.int64), "item_key": item_key, "item_at": at})


def _bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: dict[int, np.ndarray] = {}
    for pdf in batches:
        slot = pdf["hash"].to_numpy().view(np.uint64) & np.uint64(BITMAP - 1)
        row = (slot // np.uint64(_ROW)).astype(np.int64)
        for r in np.unique(row):
            bits = rows.setdefault(int(r), np.zeros(_ROW, np.bool_))
            bits[(slot[row == r] % np.uint64(_ROW)).astype(np.int64)] = True
    if rows:
        yield pd.DataFrame({"row": list(rows), "bits": [np.packbits(b).tobytes() for b in rows.values()]})


def _hits(batches: Iterator[pd.DataFrame], masks, lengths, bitmap) -> Iterator[pd.DataFrame]:
    clear()
    known = np.unpackbits(bitmap.value).view(np.bool_)
    for part in slices(batches):
        for key, words in zip(part["row_key"], _words(part["text"]), strict=True):
            hashes, at = _seeds(words, masks, lengths)
            found = known[(hashes & np.uint64(BITMAP - 1)).astype(np.int64)]
            if found.any():
                hashes, at = _listed(hashes[found], at[found])
                yield pd.DataFrame({"hash": hashes.view(np.int64), "row_key": key, "at": at})


def best_alignment(doc: np.ndarray, item: np.ndarray, shifts, window: int, share: float) -> tuple[int, int, int] | None:
    """(start in the document, words, words that agree) of the alignment with most agreement among those that pass."""
    best = None
    for shift in sorted(set(shifts)):
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        same = np.equal(doc[lo + shift : hi + shift], item[lo:hi])
        size = min(window, len(item))
        if len(same) < size:
            continue
        total = np.concatenate(([0], np.cumsum(same)))
        good = np.flatnonzero(total[size:] - total[:-size] >= np.ceil(share * size - 1e-9))
        if len(good):
            a, b = int(good[0]), int(good[-1]) + size
            found = (lo + shift + a, b - a, int(total[b] - total[a]))
            if best is None or found[2] > best[2]:
                best = found
    return best


def every_shift(doc: np.ndarray, item: np.ndarray, window: int, share: float) -> list[int]:
    """Alignments on which enough words agree for some window of them to pass."""
    least = int(np.ceil(share * min(window, len(item)) - 1e-9))
    order = np.argsort(doc, kind="stable")
    lo, hi = (np.searchsorted(doc[order], item, side=side) for side in ("left", "right"))
    agree = np.zeros(len(doc) + len(item), np.int64)  # by shift, from -len(item)
    for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
        agree[order[a:b] - k + len(item)] += 1
    return (np.flatnonzero(agree >= least) - len(item)).tolist()


def _verify(batches: Iterator[pd.DataFrame], window: int, share: float) -> Iterator[pd.DataFrame]:
    for pdf in slices(batches, 64):
        rows = []
        for doc_id, text_key, words, items in zip(pdf["doc_id"], pdf["text_key"], _words(pdf["text"]), pdf["items"], strict=True):
            for held in items:
                item = np.frombuffer(held["words"], np.uint64)
                shifts = every_shift(words, item, window, share) if held["every"] else [int(s) for s in held["shifts"]]
                found = best_alignment(words, item, shifts, window, share)
                if found:
                    rows.append((doc_id, text_key, held["item_id"], *found))
        yield pd.DataFrame(rows, columns=["doc_id", "text_key", "item_id", "start", "words", "agree"])


def contaminated(docs: DataFrame, benchmark: DataFrame, masks=MASKS, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """A row per document and item found in it.

    Columns: doc_id, text_key (xxhash64 of the text), item_id, start (word of
    the document), words, agree. Documents in which nothing is found have none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    widest = max(map(max, masks)) + 1
    items = map_rows(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")), _items, "item_id long, words binary", "item_id")
    items = scratch.keep(items.distinct().withColumn("item_key", F.xxhash64("item_id", "words")), "items")
    seeds = scratch.keep(items.select("item_key", "words").mapInPandas(partial(_item_seeds, masks=masks, widest=widest), "hash long, item_key long, item_at long"), "seeds")
    length = (F.octet_length("words") / 8).cast("int").alias("n")
    lengths = sorted(r["n"] for r in items.select(length).where(F.col("n") < widest).distinct().collect())  # of items below the widest mask
    bitmap = np.zeros(BITMAP // 8, np.uint8)
    for r in seeds.select("hash").repartition((F.col("hash").bitwiseAND(BITMAP - 1) / _ROW).cast("int")).mapInPandas(_bits, "row long, bits binary").collect():  # BITMAP bits at most
        bitmap[r["row"] * _ROW // 8 : (r["row"] + 1) * _ROW // 8] |= np.frombuffer(r["bits"], np.uint8)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("text_key", F.xxhash64("text")).withColumn("row_key", F.coalesce("doc_id", "text_key"))
    hits = rows.select("row_key", "text").mapInPandas(partial(_hits, masks=masks, lengths=lengths, bitmap=spark.sparkContext.broadcast(bitmap)), "hash long, row_key long, at long")
    shift = F.when((F.col("at") >= 0) & (F.col("item_at") >= 0), F.col("at") - F.col("item_at"))
    aligned = hits.join(seeds, "hash").select("row_key", "item_key", shift.alias("shift")).distinct()
    # The alignments of one text and one item: REPEATS ** 2 a seed of the item at most, and none where all are tried.
    pairs = aligned.groupBy("row_key", "item_key").agg(F.collect_list("shift").alias("shifts"), F.max(F.col("shift").isNull()).alias("every"))
    pairs = pairs.withColumn("shifts", F.when(~F.col("every"), F.col("shifts")))
    part = F.floor((F.row_number().over(Window.partitionBy("row_key").orderBy("item_key")) - 1) / ITEMS)
    held = F.collect_list(F.struct(F.col("item_id").cast("string").alias("item_id"), "words", "shifts", "every"))  # ITEMS at most
    with small_batches(spark):
        candidates = scratch.keep(pairs.withColumn("part", part).join(items, "item_key").groupBy("row_key", "part").agg(held.alias("items")).drop("part"), "candidates")
    texts = rows.join(candidates, "row_key").select("doc_id", "text_key", "text", "items")
    return map_rows(texts, partial(_verify, window=window, share=share), "doc_id long, text_key long, item_id long, start long, words long, agree long", "doc_id", "item_id")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without those that contain an item of ``benchmark``."""
    name, key = free_name("_found_id", docs), free_name("_found_key", docs)
    found = contaminated(docs, benchmark, **how).select(F.col("doc_id").alias(name), F.col("text_key").alias(key)).distinct()
    on = docs["doc_id"].cast("long").eqNullSafe(found[name]) & (F.xxhash64(docs["text"]) == found[key])
    return docs.join(found, on, "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
