"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents are encoded once; a longer one is cut into pieces of which all but
the first are full. How pieces share sequences depends on their lengths only,
and there are at most ``size`` of those, so the driver plans on the counts of
lengths - a table of fixed size - and the plan is the same for any number of
documents:

1. Dominance (Martello and Toth): a set of pieces that no other choice for its
   largest piece can beat is fixed for good. A full piece; two pieces that fill
   a sequence; a piece that nothing fits beside; a piece that takes one more at
   most, with the largest that fits; a piece that takes two more at most, with
   a single one that is as long as the best two.
2. What is left, a smaller instance, goes by best fit, longest first.

The plan is a list of patterns (lengths side by side) with multiplicities.
Pieces are numbered within their length by task and place, which needs no
global sort, and each finds its sequence and offset by its number.

Rules. A null text counts as empty and is its end id alone. A null doc_id stays
null in the result; repeated rows are documents of their own, so two pieces of
one (doc_id, piece) may appear. Texts of any length are encoded whole. Pieces of
one length are alike to the plan, so ties cost nothing. Other columns are not
read. An empty table packs to nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from .batches import map_rows, slices, small_batches
from .tokens import REMEMBER, encoder

SIZE = 1024
#: Appended to each document.
END_ID = 2
#: Counts by task and length that are broadcast at most: some 10 MB.
BROADCAST_ROWS = 300_000
Pattern = tuple[tuple[int, ...], int]  # lengths, sequences

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, number long"


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    head = n % size or min(n, size)
    return [(0, head), *((s, size) for s in range(head, n, size))]


def _pieces(batches: Iterator[pd.DataFrame], path: str, end_id: int, size: int, with_ids: bool, remember: int) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    part, numbers = TaskContext.get().partitionId(), Counter()
    enc, end = encoder(path, remember), np.array([end_id], "<u4").tobytes()
    for pdf in slices(batches):
        rows = []
        for doc_id, ids in zip(pdf["doc_id"], enc.encode([t or "" for t in pdf["text"]]), strict=True):
            ids += end
            for k, (start, length) in enumerate(cut(len(ids) // 4, size)):
                held = ids[4 * start : 4 * (start + length)]
                rows.append((doc_id, k, start, length, zlib.crc32(held), part, numbers[length], *((held,) if with_ids else ())))
                numbers[length] += 1
        yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "number", *(("ids",) if with_ids else ())])


def token_pieces(docs: DataFrame, path: str, end_id: int = END_ID, size: int = SIZE, with_ids: bool = False, remember: int = REMEMBER) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32, and ids (unsigned 32-bit, little-endian) on request.

    part and number tell pieces of one length apart: the task and the place in it.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_rows(rows, partial(_pieces, path=path, end_id=end_id, size=size, with_ids=with_ids, remember=remember), _PIECES + (", ids binary" if with_ids else ""), "doc_id")


class _Lengths:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int], size: int):
        self.n = [0] * (size + 1)
        for length, c in counts.items():
            self.n[length] = c
        self.size = size

    def below(self, most: int, without: tuple[int, ...] = ()) -> int:
        """The largest length of at most ``most`` of which one is left, besides those taken; 0 if none."""
        for length in range(min(most, self.size), 0, -1):
            if self.n[length] > without.count(length):
                return length
        return 0

    def smallest(self, k: int, without: int) -> list[int]:
        """The k smallest lengths left besides one of ``without``."""
        out: list[int] = []
        for length in range(1, self.size + 1):
            out += [length] * min(k - len(out), self.n[length] - (length == without))
            if len(out) >= k:
                break
        return out

    def best_two(self, room: int, without: int) -> int:
        """The largest sum of at most ``room`` of two pieces left."""
        best = 0
        for a in range(1, room // 2 + 1):
            if self.n[a] > (a == without):
                b = self.below(room - a, (a, without))
                if b >= a:
                    best = max(best, a + b)
        return best


def reduce_by_dominance(counts: dict[int, int], size: int) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that are fixed for good, and the counts of what is left."""
    left, fixed = _Lengths(counts, size), Counter()

    def fix(lengths: tuple[int, ...], times: int) -> None:
        fixed[lengths] += times
        for length in lengths:
            left.n[length] -= times

    if left.n[size]:
        fix((size,), left.n[size])
    for a in range(size - 1, (size - 1) // 2, -1):
        b = size - a
        times = left.n[a] // 2 if a == b else min(left.n[a], left.n[b])
        if times:
            fix((a, b), times)
    for a in range(size - 1, 0, -1):
        while left.n[a]:
            room = size - a
            b = left.below(room, (a,))
            if not b:
                fix((a,), left.n[a])
                continue
            few = left.smallest(3, a)
            one_more = len(few) < 2 or few[0] + few[1] > room
            two_more = len(few) < 3 or sum(few) > room
            if one_more or two_more and b >= left.best_two(room, a):
                # The choice stays the same until either length runs out.
                fix((a, b), 1 if a == b or not one_more else min(left.n[a], left.n[b]))
                continue
            break
    return [(k, v) for k, v in fixed.items()], {length: c for length, c in enumerate(left.n) if c}


def best_fit(counts: dict[int, int], size: int) -> list[Pattern]:
    """Best fit, longest first, on counts: sequences of the same content are handled together."""
    open_: dict[int, list[list]] = {}  # room -> [lengths, sequences]
    done: Counter = Counter()

    def put(room: int, lengths: tuple[int, ...], times: int) -> None:
        if times:
            if room:
                open_.setdefault(room, []).append([lengths, times])
            else:
                done[lengths] += times

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            room = min((r for r in open_ if r >= length), default=0)
            if room:
                group = open_[room][-1]
                each = min(room // length, n)  # best fit returns to the sequence it has just tightened
                times = min(group[1], n // each)
                group[1] -= times
                if not group[1]:
                    open_[room].pop()
                    if not open_[room]:
                        del open_[room]
                lengths = group[0]
            else:
                room, lengths = size, ()
                each = min(size // length, n)
                times = n // each
            put(room - each * length, lengths + (length,) * each, times)
            n -= each * times
    for groups in open_.values():
        for lengths, times in groups:
            done[lengths] += times
    return list(done.items())


def plan(counts: dict[int, int], size: int) -> list[Pattern]:
    """Patterns that hold all pieces."""
    fixed, rest = reduce_by_dominance(counts, size)
    return [*fixed, *best_fit(rest, size)]


def _slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length the runs (first number, copies a sequence, first sequence, first offset) in order."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    base = 0
    for lengths, times in patterns:
        offset = 0
        for length, copies in Counter(lengths).items():
            runs.setdefault(length, []).append((used[length], copies, base, offset))
            used[length] += copies * times
            offset += copies * length
        base += times
    return {length: np.array(r, np.int64) for length, r in runs.items()}


def _place(batches: Iterator[pd.DataFrame], slots) -> Iterator[pd.DataFrame]:
    for pdf in slices(batches, 5000):
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        lengths, numbers = pdf["length"].to_numpy(), pdf["number"].to_numpy()
        for length in np.unique(lengths):
            mine = lengths == length
            runs = slots.value[int(length)]
            run = runs[np.searchsorted(runs[:, 0], numbers[mine], side="right") - 1]
            at = numbers[mine] - run[:, 0]
            sequence[mine] = run[:, 2] + at // run[:, 1]
            offset[mine] = run[:, 3] + at % run[:, 1] * length
        yield pdf.drop(columns="number").assign(sequence_id=sequence, offset=offset)


def best_fit_packing(docs: DataFrame, path: str, end_id: int = END_ID, size: int = SIZE, with_ids: bool = False, remember: int = REMEMBER) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids on request."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    with small_batches(spark):
        pieces = scratch.keep(token_pieces(docs, path, end_id, size, with_ids, remember), "pieces")
    each = scratch.keep(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``size`` rows at most
    slots = spark.sparkContext.broadcast(_slots(plan(counts, size)))
    # Numbers of a task's pieces of a length start after those of the tasks before it; a window over tasks, not pieces.
    earlier = each.selectExpr("length", "part", "cast(coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0) as bigint) as earlier")
    # A row a task and length: with many tasks too many to broadcast, so both sides are dealt by them.
    earlier = F.broadcast(earlier) if each.count() <= BROADCAST_ROWS else earlier.hint("merge")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(("ids",) if with_ids else ())]
    numbered = pieces.join(earlier, ["length", "part"]).select(*columns, (F.col("number") + F.col("earlier")).alias("number"))
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + (", ids binary" if with_ids else "") + ", sequence_id long, offset long"
    return map_rows(numbered, partial(_place, slots=slots), schema, "doc_id").withColumn("length", F.col("length").cast("long"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, length, doc_ids, ids. A group is one sequence, so it is bounded."""
    slot = F.struct("offset", "doc_id", "length", "ids")
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(slot)).alias("slots"))
    ids = F.aggregate("slots", F.unhex(F.lit("")), lambda all_ids, s: F.concat(all_ids, s["ids"]))
    return whole.select("sequence_id", F.aggregate("slots", F.lit(0).cast("long"), lambda n, s: n + s["length"]).alias("length"), F.col("slots.doc_id").alias("doc_ids"), ids.alias("ids"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
