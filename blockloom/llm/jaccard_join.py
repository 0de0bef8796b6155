"""Self-join of documents by the Jaccard similarity of their word n-gram sets.

Size-aware heavy-light join. Sets of up to a boundary (light) are keyed by
their subsets of the sizes that a linking partner must share, and two light
sets meet by a common subset only; larger ones (heavy) by the inverted lists of
their prefix: with p = n - ceil(t n) + 1 shingles, rarest first, no link can do
without a common one. Light sets that can link across the boundary are in the
lists too. The boundary is chosen by cost: for each size the subsets that its
sets would have, against the list entries that they scan, counted on the lists
as they are.

Copies of one set are one class. Within a list the join never makes all
pairs of a large group of near copies: rounds of stars (one pivot a list)
first link what they can, and then only pairs of different components are
made. Whatever pairs are made, sizes, positions in the prefix and a parity
bitmap of 1024 bits bound their overlap, and what is left is verified on the
exact sets, read again from the text. No pair that links is lost, so the
components are exact. A long list is dealt to many tasks: by bands of sizes, of
which only neighbours can link, and within them by blocks.

Frequencies come from a count sketch of fixed size over all documents. They
only order the prefix; every order gives the same links.

Rules. Words are runs of bytes other than space and 0x09-0x0D, A-Z
lower-cased; a text with fewer words than ``width`` is one shingle, a text
without words or null has an empty set and links with nothing. Texts are read
whole, of any length. Rows with a null doc_id link with nothing and have a null
component; rows that repeat a doc_id are one vertex. Other columns are not
read. An empty table gives an empty result. Shingles are compared by 64-bit
fingerprints.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from functools import partial, reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .batches import map_rows, slices, small_batches
from .components import connected_components
from .skew import free_name, lookup
from .textwords import mix64, shingle_set, word_hashes
from .workers import clear, trim

#: Counters in each of the sketch's two rows.
SKETCH = 1 << 20
_CHUNK = 4096
#: Longs of the parity bitmap.
PARITY = 16
#: Star rounds at most, the length of list from which they are worth it, and entries of a list in a block.
STARS, LONG, BLOCK = 3, 48, 1024
#: Sizes that the cost is counted by; the subsets of sets near the last are far too many at any cost.
SIZES = 256


def least_overlap(n: int, m: int, percent: int) -> int:
    """Least o with 100 o >= percent (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def partner_sizes(n: int, percent: int) -> range:
    """Sizes that a set of n can link with."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_sizes(n: int, boundary: int, percent: int) -> list[int]:
    """Overlaps that light partners of a set of n must share."""
    return sorted({least_overlap(n, m, percent) for m in partner_sizes(n, percent) if m <= boundary})


def choose_boundary(sizes: dict[int, tuple[int, int]], percent: int) -> int:
    """The boundary of the least cost; ``sizes`` gives by set size the number of sets and what they scan in lists.

    A set below it costs its subsets, and its scans too if it has partners above.
    """
    heavy, best = sum(scan for _, scan in sizes.values()), (sum(scan for _, scan in sizes.values()), 0)
    for boundary in range(1, SIZES + 1):
        below = [n for n in sizes if n <= boundary]
        light = sum(sizes[n][0] * sum(math.comb(n, c) for c in subset_sizes(n, boundary, percent)) for n in below)
        if light > heavy:  # and more so for larger ones
            break
        saved = sum(sizes[n][1] for n in below if partner_sizes(n, percent)[-1] <= boundary)
        best = min(best, (light + heavy - saved, boundary))
    return best[1]


def _sets(pdf: pd.DataFrame, width: int) -> list[np.ndarray]:
    return [shingle_set(w, width) for w in word_hashes(pdf["text"].tolist())]


def _slots(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(SKETCH - 1)
    return (s & low).astype(np.int64), (s >> np.uint64(40) & low).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    clear()
    total = np.zeros((2, SKETCH), np.int64)
    for pdf in slices(batches, 256):
        sets = [s for s in _sets(pdf, width) if len(s)]
        if sets:
            for row, slots in enumerate(_slots(np.concatenate(sets))):
                total[row] += np.bincount(slots, minlength=SKETCH)
    if total.any():
        cells = total.astype(np.uint32).reshape(-1, _CHUNK)
        yield pd.DataFrame({"chunk": np.arange(len(cells)), "counts": [zlib.compress(x.tobytes(), 1) for x in cells]})
    trim()


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for chunk, counts in zip(pdf["chunk"], pdf["counts"], strict=True):
            x = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
            total[chunk] = total[chunk] + x if chunk in total else x
    if total:
        yield pd.DataFrame({"chunk": list(total), "counts": [np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in total.values()]})


def frequency_sketch(docs: DataFrame, width: int) -> np.ndarray:
    """Counts of all shingles of all documents in a sketch of fixed size (two rows of ``SKETCH`` counters, to 2**31 - 1)."""
    parts = docs.select("text").mapInPandas(partial(_count, width=width), "chunk long, counts binary")
    rows = parts.repartition("chunk").mapInPandas(_add, "chunk long, counts binary").collect()
    total = np.zeros((2 * SKETCH // _CHUNK, _CHUNK), np.int32)
    for r in rows:
        total[r.chunk] = np.frombuffer(r.counts, np.int32)
    return total.reshape(2, SKETCH)


def _estimate(sketch: np.ndarray, s: np.ndarray) -> np.ndarray:
    a, b = _slots(s)
    return np.minimum(sketch[0][a], sketch[1][b])


def _parity(s: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * PARITY slots: whether an odd number of shingles falls there."""
    bits = np.bincount((s >> np.uint64(20) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _prefix(s: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """A set's rarest shingles, as many as no link can do without."""
    return s[np.lexsort((s, _estimate(sketch, s)))[: prefix_length(len(s), percent)]]


def _subsets(s: np.ndarray, boundary: int, percent: int) -> np.ndarray:
    """Fingerprints of a light set's subsets of the sizes that its light partners share with it."""
    keys = []
    for c in subset_sizes(len(s), boundary, percent):
        subsets = np.array(list(itertools.combinations(s, c)), dtype=np.uint64)
        folded = np.full(len(subsets), c, np.uint64)
        for column in subsets.T:
            folded = mix64(folded * np.uint64(0x9E3779B97F4A7C15) + column)
        keys.append(mix64(folded))
    return np.concatenate(keys)


def _describe(batches: Iterator[pd.DataFrame], sketch, percent: int, width: int) -> Iterator[pd.DataFrame]:
    import hashlib

    clear()
    for pdf in slices(batches, 256):
        out = []
        for doc_id, s in zip(pdf["doc_id"], _sets(pdf, width), strict=True):
            if not len(s):
                out.append((doc_id, 0, None, None, None))
            else:
                out.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), _prefix(s, sketch.value, percent).view(np.int64), _parity(s)))
        yield pd.DataFrame(out, columns=["doc_id", "n", "set_key", "keys", "parity"])
    trim()


def _light(batches: Iterator[pd.DataFrame], boundary: int, percent: int, width: int) -> Iterator[pd.DataFrame]:
    """Subset keys of the texts whose sets are light."""
    for pdf in slices(batches, 256):
        for doc_id, s in zip(pdf["doc_id"], _sets(pdf, width), strict=True):
            if 0 < len(s) <= boundary:
                keys = _subsets(s, boundary, percent).view(np.int64)
                yield pd.DataFrame({"key": keys, "id": doc_id, "set": int(mix64(s).sum().view(np.int64)), "n": len(s), "parity": [_parity(s)] * len(keys)})


def _exact_sets(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for pdf in slices(batches, 256):
        yield pd.DataFrame({"id": pdf["doc_id"], "shingles": [s.tobytes() for s in _sets(pdf, width)]})
    trim()


def _linked(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    clear()
    for pdf in batches:
        keep = []
        for x, y in zip(pdf["sa"], pdf["sb"], strict=True):
            a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
        yield pdf.loc[keep, ["a", "b"]]
        del pdf  # not beside the next batch
    trim()


def _may_link(percent: int, boundary: int) -> Column:
    """Sizes, positions and parity bits of two entries (x, y) of a list allow enough overlap; two light sets meet by subsets only."""
    n, m = F.col("x.n"), F.col("y.n")
    least = F.ceil(percent * (n + m) / F.lit(100 + percent) - F.lit(1e-9))
    first = F.least(n - F.col("x.at"), m - F.col("y.at"))
    listed = (first >= least) & ((n > boundary) | (m > boundary))
    differ = sum((F.bit_count(F.col("x.parity")[k].bitwiseXOR(F.col("y.parity")[k])) for k in range(1, PARITY)), F.bit_count(F.col("x.parity")[0].bitwiseXOR(F.col("y.parity")[0])))
    return (percent * F.greatest(n, m) <= 100 * F.least(n, m)) & ((F.col("x.at") < 0) | listed) & ((n + m - differ) >= 2 * least)


class JaccardJoin:
    """The join of one table; ``links()`` and ``components()`` give its results."""

    def __init__(self, docs: DataFrame, percent: int = 80, width: int = 5, boundary: int | None = None):
        """``boundary`` is chosen by cost unless it is given."""
        if not 50 < percent <= 100:
            raise ValueError("percent must be over 50, to 100")
        self.spark, self.percent, self.width, self.boundary = docs.sparkSession, percent, width, boundary
        self.docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        self.scratch = Scratch(self.spark, "jaccard")
        with small_batches(self.spark):
            sketch = frequency_sketch(self.docs, width)
            shared = self.spark.sparkContext.broadcast(sketch)
            described = map_rows(self.docs, partial(_describe, sketch=shared, percent=percent, width=width), "doc_id long, n long, set_key binary, keys array<long>, parity array<long>", "doc_id")
            self.sets = self.scratch.keep(described, "sets")
        shared.destroy()
        named = self.sets.where("doc_id IS NOT NULL AND n > 0")
        self.classes = self.scratch.keep(named.groupBy("set_key").agg(F.min("doc_id").alias("id")), "classes")
        self._found: list[DataFrame] = []

    def _lists(self) -> DataFrame:
        """Entries (key, at, id, n, parity, c) of the lists that have two classes at least; at is -1 where the key is a subset."""
        one = self.classes.select("set_key", F.col("id").alias("doc_id"))
        reps = self.sets.where("n > 0").join(one, ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key", "doc_id"])
        # An id that is repeated with other texts has several sets.
        reps = self.scratch.keep(reps.select(F.col("doc_id").alias("id"), F.xxhash64("set_key").alias("set"), "n", "parity", "keys"), "reps")
        flat = reps.select(F.posexplode("keys").alias("at", "key"), "id", "set")
        shared = flat.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        listed = flat.join(shared, "key").join(reps.select("id", "set", "n", "parity"), ["id", "set"])
        lists = self.scratch.keep(listed.select("key", "at", "id", "n", "parity", "c"), "prefixes")
        if self.boundary is None:
            entries = reps.where(F.col("n") <= SIZES).groupBy("n").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.size("keys")).alias("entries"))
            scans = lists.where(F.col("n") <= SIZES).groupBy("n").agg(F.sum("c").alias("scan"))
            sizes = {r["n"]: (r["sets"], r["entries"] + (r["scan"] or 0)) for r in entries.join(scans, "n", "left").collect()}  # SIZES rows at most
            self.boundary = choose_boundary(sizes, self.percent)
        if self.boundary:
            small = reps.where(F.col("n") <= self.boundary).select(F.col("id").alias("doc_id")).distinct()
            subsets = self.docs.join(small, "doc_id", "left_semi").mapInPandas(partial(_light, boundary=self.boundary, percent=self.percent, width=self.width), "key long, id long, set long, n long, parity array<long>")
            with small_batches(self.spark):
                subsets = self.scratch.keep(subsets.dropDuplicates(["key", "id", "set"]), "subsets")
            common = subsets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
            across = F.floor(F.col("n") * 100 / self.percent + 1e-9) > self.boundary  # a partner may be heavy
            lists = lists.where(across).unionByName(subsets.join(common, "key").select("key", F.lit(-1).alias("at"), "id", "n", "parity", "c"))
            lists = self.scratch.keep(lists, "lists")
            self.scratch.drop("prefixes", "subsets")
        self.scratch.drop("reps")
        return lists

    def light_links(self) -> int:
        """How many of ``links()`` are between light sets, and so come from common subsets."""
        links, small = self.links(), self.sets.where((F.col("n") > 0) & (F.col("n") <= (self.boundary or 0))).select("doc_id").distinct()
        return links.join(small.withColumnRenamed("doc_id", "a"), "a", "left_semi").join(small.withColumnRenamed("doc_id", "b"), "b", "left_semi").count()

    def _verify(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) that link, tested on the sets of the whole texts."""
        pairs = self.scratch.keep(pairs.distinct(), f"{name}-pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        with small_batches(self.spark):
            sets = self.scratch.keep(self.docs.join(ids, "doc_id", "left_semi").mapInPandas(partial(_exact_sets, width=self.width), "id long, shingles binary"), f"{name}-sets")
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
        # A row holds two whole sets: a batch of the usual 64 MB would stand several times in an executor.
        with small_batches(self.spark):
            links = self.scratch.keep(both.mapInPandas(partial(_linked, percent=self.percent), "a long, b long").distinct(), f"{name}-links")
        self.scratch.drop(f"{name}-sets")
        return links

    def links(self) -> DataFrame:
        """Links (a, b) between class representatives: enough of them to connect all that link."""
        if self._found:
            return self._found[-1]
        lists, links = self._lists(), self.spark.createDataFrame([], "a long, b long")
        long = lists.where(F.col("c") > LONG)
        for k in range(STARS):
            live = self._with_components(long, links, f"round{k}")
            if k:  # again only where the last round linked something
                some = live.groupBy("key").agg(F.count_distinct("comp").alias("comps"), F.max("c").alias("c")).where("comps > 1 and 10 * comps < 9 * c")
                live = live.join(some.select("key"), "key", "left_semi")
            if not live.take(1):
                break
            # Pivots differ by list, so a set meets as many as it is in long lists.
            pivots = live.groupBy("key").agg(F.min_by("id", F.xxhash64("key", "id", F.lit(k))).alias("id"))
            pivot_rows = live.join(pivots, ["key", "id"], "left_semi")
            pairs = self._pairs(live, pivot_rows, F.col("x.id") != F.col("y.id"))
            links = self.scratch.keep(links.union(self._verify(pairs, f"star{k}")), f"found{k}")
        live = self._with_components(lists, links, "rest")
        links = self.scratch.keep(links.union(self._verify(self._pairs(live, live, F.col("x.id") < F.col("y.id")), "rest")), "found")
        self._found.append(links)
        return links

    def _with_components(self, lists: DataFrame, links: DataFrame, name: str) -> DataFrame:
        if not links.take(1):
            return lists.withColumn("comp", F.col("id"))
        labels = connected_components(links, self.scratch, name)
        return lists.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def _pairs(self, left: DataFrame, right: DataFrame, which: Column) -> DataFrame:
        """Pairs of different components that a common key and the bounds allow."""
        long = F.col("c") > LONG
        # Linking sizes differ by less than a band, so they are in the same or in neighbouring ones.
        band = F.when(long, F.floor(F.log(F.col("n").cast("double")) / math.log(max(100 / self.percent, 1.0) * 1.001))).otherwise(F.lit(0).cast("bigint"))
        blocks = F.when(long, F.ceil(F.col("c") / BLOCK)).otherwise(F.lit(1).cast("bigint"))
        x = left.withColumns({"band": band, "block": F.pmod(F.xxhash64("id"), blocks)}).alias("x")
        bands = F.when(long, F.array(band - 1, band, band + 1)).otherwise(F.array(band))
        y = right.withColumn("band", F.explode(bands)).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))).alias("y")
        same = reduce(and_, (F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "band", "block")))
        on = same & which & (F.col("x.comp") != F.col("y.comp")) & _may_link(self.percent, self.boundary or 0)
        return x.join(y, on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))

    def components(self) -> DataFrame:
        """A row per document: doc_id, n_shingles, component_id."""
        labels = connected_components(self.links(), self.scratch, "final")
        classes = self.classes.join(labels, "id", "left").select("set_key", F.coalesce("comp", "id").alias("comp"))
        sets = lookup(self.sets.select("doc_id", "n", "set_key"), classes, "set_key", "doc_id")
        return sets.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, boundary: int | None = None) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    return JaccardJoin(docs, percent, width, boundary).components()


def keep_representatives(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """``docs`` with one document of each component, that with the smallest doc_id; columns as they are."""
    groups, name = near_duplicates(docs, percent, width), free_name("_dropped_id", docs)
    dropped = groups.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped[name], "left_anti")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85, width=4)
