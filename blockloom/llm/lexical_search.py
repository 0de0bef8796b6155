"""Ranked lexical search: all documents for each of a set of items, by dense matrix products.

A term is a run of letters and digits of ASCII or of any other characters beyond
it, A-Z lower-cased. Weights and impacts are whole numbers (BM25 in fixed
point), so a score is exact and does not depend on the order of sums.

The documents are read once: each row's number of terms, and of the terms that
some item has their occurrences, become a written table, from which the counts
over the corpus follow. Then, task by task, tiles of documents are multiplied
with tiles of items: a tile of ``ITEMS`` items has a compact vocabulary of its
own terms, cut in columns of at most ``TERMS``; for these columns the weights
of the items (items x columns) and the impacts of ``DOCS`` documents
(columns x documents) are dense float64 matrices for one BLAS product. Columns
are cut so that no partial sum can reach 2**53, below which float64 adds whole
numbers exactly; a single column that would is multiplied in 64-bit integers.
Partial sums are added as 64-bit integers.

Each task keeps the best ``top`` documents of each item over all its tiles:
those with more than the lowest score that is kept, and of equal scores those
with the smaller doc_id. Tasks send so many rows an item at most to the last
step, which ranks them.

Items are searched for in blocks with about ``BLOCK_TERMS`` terms together, so
what is broadcast has a bound, however many items there are; each block reads
the documents once more.

Rules. Null texts and texts without a term rank nowhere and do not count as
documents; items without a term have no rows. Texts are read whole, of any
length. Rows that repeat a doc_id are documents of their own; a null doc_id
ranks behind others of its score, and keeps null. Items that repeat an item_id
are ranked each on its own. Other columns are not read. Empty tables give an
empty result. Terms are told apart by 64-bit fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .batches import small_batches
from .textwords import NOT_ALNUM, word_hashes
from .workers import clear

TOP = 10
#: Terms of the items that are searched for in one pass: of a block about 32 MB are broadcast.
BLOCK_TERMS = 1_000_000
#: Rows of an item tile, its columns, and documents of a document tile: 32 MB of matrices.
ITEMS, TERMS, DOCS = 256, 4096, 512
#: Whole numbers below this are exact in float64; an impact is never above the second.
EXACT, MOST_IMPACT = 1 << 53, 10**6
#: Rows of an Arrow batch that are counted together.
_ROWS = 250
_LAST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Tile:
    """Items that are multiplied together: their numbers, and for each item and term (a column) how often it holds it."""

    items: np.ndarray
    columns: np.ndarray  # places in the block's vocabulary, ascending
    row: np.ndarray
    column: np.ndarray
    times: np.ndarray


@dataclass(frozen=True)
class Block:
    """Items of one pass: ids, the sorted fingerprints of their terms, and tiles."""

    item_ids: list
    vocabulary: np.ndarray
    tiles: list[Tile]


def make_block(items: Sequence[tuple[int | None, np.ndarray]], rows: int = ITEMS) -> Block:
    """A block of (item_id, fingerprints of all terms with repeats)."""
    held = [(item_id, *np.unique(terms, return_counts=True)) for item_id, terms in items if len(terms)]
    vocabulary = np.unique(np.concatenate([t for _, t, _ in held])) if held else np.empty(0, np.uint64)
    tiles = []
    for lo in range(0, len(held), rows):
        some = held[lo : lo + rows]
        at = np.searchsorted(vocabulary, np.concatenate([t for _, t, _ in some]))
        columns, column = np.unique(at, return_inverse=True)
        tiles.append(Tile(np.arange(lo, lo + len(some)), columns, np.repeat(np.arange(len(some)), [len(t) for _, t, _ in some]), column, np.concatenate([n for _, _, n in some]).astype(np.int64)))
    return Block([item_id for item_id, _, _ in held], vocabulary, tiles)


def column_cuts(weight: np.ndarray, tile: Tile, terms: int = TERMS) -> list[tuple[int, int, bool]]:
    """Columns (from, to, exact) of a tile: at most ``terms`` together, and so few that float64 sums are exact; not so where a single column is too heavy."""
    heaviest = np.zeros(len(tile.columns), np.int64)
    np.maximum.at(heaviest, tile.column, tile.times * weight[tile.columns[tile.column]])
    # The sum of each column's heaviest weight is no less than any item's.
    upto = np.concatenate(([0], np.cumsum(heaviest)))
    out, lo, most = [], 0, (EXACT - 1) // MOST_IMPACT
    while lo < len(tile.columns):
        hi = min(lo + terms, int(np.searchsorted(upto, upto[lo] + most, side="right")) - 1)
        out.append((lo, max(hi, lo + 1), hi > lo))
        lo = out[-1][1]
    return out


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """What a document's length does to its impacts: 25 and 75 hundredths of its share of the mean."""
    most = int(n.max(initial=0))
    if 75 * most * documents < 1 << 63:
        return 25 + 75 * n * documents // terms
    return np.array([25 + 75 * x * documents // terms for x in n.tolist()], np.int64)


def tile_scores(tile: Tile, cuts: Sequence[tuple[int, int, bool]], weight: np.ndarray, docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
    """Scores (items x documents) of a tile of documents, given as (doc, term, impact); whole numbers throughout."""
    at = np.searchsorted(tile.columns, term)
    at[at == len(tile.columns)] = 0
    here = tile.columns[at] == term
    doc, at, impact = doc[here], at[here], impact[here]
    weights = tile.times * weight[tile.columns[tile.column]]
    out = np.zeros((len(tile.items), docs), np.int64)
    for lo, hi, exact in cuts:
        kind = np.float64 if exact else np.int64
        q, d = np.zeros((len(tile.items), hi - lo), kind), np.zeros((hi - lo, docs), kind)
        own, held = (tile.column >= lo) & (tile.column < hi), (at >= lo) & (at < hi)
        q[tile.row[own], tile.column[own] - lo] = weights[own]
        d[at[held] - lo, doc[held]] = impact[held]
        out += (q @ d).astype(np.int64)
    return out


class Best:
    """The best documents of each item of a tile so far, in order: score downward, then doc_id, null last."""

    def __init__(self, items: int, top: int):
        self.score = np.zeros((items, top), np.int64)
        self.doc = np.full((items, top), _LAST)
        self.null = np.ones((items, top), np.bool_)

    def add(self, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        top = self.score.shape[1]
        least = np.maximum(self.score[:, -1], 1)  # a score of zero is no hit
        for r in np.flatnonzero(scores.max(axis=1, initial=0) >= least):
            near = np.flatnonzero(scores[r] >= least[r])
            if len(near) > top:  # all that tie with the last one stay
                found = scores[r, near]
                near = near[found >= np.partition(found, len(found) - top)[len(found) - top]]
            score, ids, nulls = (np.concatenate(x) for x in ((self.score[r], scores[r, near]), (self.doc[r], doc[near]), (self.null[r], null[near])))
            order = np.lexsort((ids, nulls, -score))[:top]
            self.score[r], self.doc[r], self.null[r] = score[order], ids[order], nulls[order]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's fingerprints, with repeats."""
    for batch in batches:
        held = word_hashes(batch.column("text").to_pylist(), NOT_ALNUM)
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([len(h) for h in held], pa.int64()), pa.array([h.tobytes() for h in held], pa.binary())], names=["item_id", "n", "terms"])


def _count(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[pa.RecordBatch]:
    """Each document's number of terms, and the places and occurrences of those in the vocabulary."""
    clear()
    known = vocabulary.value
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            held = word_hashes(part.column("text").to_pylist(), NOT_ALNUM)
            n = np.array([len(h) for h in held], np.int64)
            flat = np.concatenate(held)
            at = np.searchsorted(known, flat)
            at[at == len(known)] = 0
            hit = known[at] == flat
            pair, tf = np.unique(np.repeat(np.arange(len(held)), n)[hit] * len(known) + at[hit], return_counts=True)
            doc, term = np.divmod(pair, len(known))
            offsets = pa.array(np.searchsorted(doc, np.arange(len(held) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and how many each row has."""
    offsets = lists.offsets.to_numpy()
    return lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64), np.diff(offsets)


def _search(batches: Iterator[pa.RecordBatch], block, weights, documents: int, terms: int, top: int) -> Iterator[pa.RecordBatch]:
    """The best documents of this task for every item."""
    held, weight = block.value, weights.value
    cuts = [column_cuts(weight, t) for t in held.tiles]
    best = [Best(len(t.items), top) for t in held.tiles]
    for batch in batches:
        for lo in range(0, batch.num_rows, DOCS):
            part = batch.slice(lo, DOCS)
            ids = part.column("doc_id")
            doc_id, null = ids.fill_null(_LAST).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            term, each = _flat(part.column("terms"))
            tf, _ = _flat(part.column("tfs"))
            doc = np.repeat(np.arange(part.num_rows), each)
            impact = impacts(tf, lengths(part.column("n").to_numpy(), documents, terms)[doc])
            for tile, cut, kept in zip(held.tiles, cuts, best, strict=True):
                kept.add(tile_scores(tile, cut, weight, part.num_rows, doc, term, impact), doc_id, null)
    for tile, kept in zip(held.tiles, best, strict=True):
        row, place = np.nonzero(kept.score)
        if len(row):
            item = tile.items[row]
            names = pa.array([held.item_ids[k] for k in item.tolist()], pa.int64())
            docs = pa.array(kept.doc[row, place], mask=kept.null[row, place])
            yield pa.RecordBatch.from_arrays([pa.array(item), names, docs, pa.array(kept.score[row, place])], names=["item", "item_id", "doc_id", "score"])


def _search_block(rows: DataFrame, held: Block, k: int, top: int, scratch: Scratch) -> DataFrame:
    """Ranks the documents for the items of a block."""
    spark = rows.sparkSession
    share = spark.sparkContext.broadcast
    with small_batches(spark):
        counted = scratch.keep(rows.mapInArrow(partial(_count, vocabulary=share(held.vocabulary)), "doc_id long, n long, terms array<int>, tfs array<int>").where("n > 0"), f"counted-{k}")
    total = counted.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).first()
    documents, terms = total["documents"], total["terms"] or 0
    # A row a term of the block: its bound is that of the block.
    found = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(len(held.vocabulary), np.int64)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    search = partial(_search, block=share(held), weights=share(weight), documents=documents, terms=terms, top=top)
    best = counted.where(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs").mapInArrow(search, "item long, item_id long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    asked = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_terms, "item_id long, n long, terms binary").where("n > 0")
    asked = scratch.keep(asked, "items")
    blocks = -(-(asked.agg(F.sum("n")).first()[0] or 0) // block_terms)
    out = []
    for k in range(blocks):
        # A block's items come to the driver: about ``block_terms`` terms.
        some = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == k).orderBy("item_id", "terms").collect()
        held = make_block([(r["item_id"], np.frombuffer(r["terms"], np.uint64)) for r in some])
        if len(held.vocabulary):
            out.append(_search_block(rows, held, k, top, scratch))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERM = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERM.format('text')} AS ts FROM documents WHERE text IS NOT NULL),
docs AS (SELECT r, doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0),
totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM docs),
q AS (SELECT item, item_id, term, count(*) AS times FROM (
  SELECT item, item_id, unnest(ts) AS term FROM (SELECT row_number() OVER () AS item, item_id, {_TERM.format('text')} AS ts FROM benchmark WHERE text IS NOT NULL)
) GROUP BY item, item_id, term),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM docs) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, nn),
m AS (SELECT r, doc_id, 25 + (75 * n * nn) // ll AS m FROM docs, totals),
s AS (
  SELECT item, item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM tf JOIN q USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item, item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""
