"""Structure repair of conversations: the cheapest edits that give whole user and assistant turns.

A conversation's rows stand in order of turn (null first; rows of one turn in
order of role and SHA-256 of text). Its repaired roles are empty, or an optional
system row and then pairs of user and assistant. Each row is kept, gets another
role, or goes; empty rows may be put in anywhere. Of the cheapest edits those
are taken whose letters (D, I, K, R for delete, insert, keep, rerole) come
first in ASCII order.

Every weight is one whole number of any size: its high digits are the cost, its
low digits (``_BITS`` bits each, at fixed places) are the letters from the left,
with zeros after the end. A graph without cycles has a node for each place between rows and each
state of the roles so far (nothing, system, user, assistant); from the end
backwards a node's weight is the smallest over its edges, where an edge adds its
cost and sets its letter before those that follow. The smallest number is the
cheapest and, among these, the first in order: nothing else is compared, and the
letters are read off it. Rows are taken ``_LAYERS`` at a time, so that numbers
stay short: letters with which all four states end alike, at the same places,
are put aside. Two weights of one node can only differ in length by inserts, and
where the letters of one begin those of the other, what is longer goes on with
inserts; so the ``_GUARD`` letters that stay of the common end decide as the
whole would, and time grows with the rows.

Spark brings a conversation's rows into one task in order, and the task reads
them as they come: first codes (a byte a row) for the decisions, then, behind
the decisions, the texts for the repaired rows. No task holds the texts of a
conversation; it holds its codes, which are as long as the letters that are
written in its row of the result.

Rules. Null conv_id is a conversation of its own. A null role or text counts as
one space; so does a null turn or conv_id in the hash that deals damage. A
conversation of which no row is left has zeros, no letters and the hash of the
empty string. Of rows that repeat role and text all but the first are
duplicates. Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .batches import map_rows, small_batches

#: Faults of a row, the first that holds.
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Codes of rows: the role's initial, whether the row must go, whether it is truncated; a row that damage has dropped.
_INITIALS, _MUST_GO, _CUT_OFF, _DROPPED = "sua", 4, 8, 255
#: Digits of the letters; zero is the end.
_BITS, _LETTERS = 3, "\0DIKR"
#: Rows whose weights are whole numbers together, and letters of a common end that stay with them: more than inserts can follow each other.
_LAYERS, _GUARD = 64, 8
#: States of the roles so far, and what each role may follow.
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER = {"s": {_NOTHING: _SYSTEM}, "u": {_NOTHING: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
_LEGAL = {"su", "ua", "au"}


@dataclass(frozen=True)
class Costs:
    """Whole numbers; delete and insert above zero."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self):
        if min(self.delete, self.insert) < 1 or min(self.rerole, self.truncated) < 0:
            raise ValueError(f"not costs of edits: {self}")


def _digits(letters: str, places: int) -> int:
    """Letters as digits from the left."""
    n = 0
    for letter in letters:
        n = n << _BITS | _LETTERS.index(letter)
    return n << _BITS * (places - len(letters))


def _letters(digits: int, places: int) -> str:
    found = (digits >> _BITS * (places - 1 - k) & ((1 << _BITS) - 1) for k in range(places))
    return "".join(_LETTERS[d] for d in found if d)


def _layers(codes: bytes, w: list[tuple[int, str]], costs: Costs, at_end: bool) -> list[tuple[int, str]]:
    """Cost and letters of each state before some rows, from those behind them: the minimum of whole numbers for every node."""
    rerole, delete, insert, truncated = astuple(costs)
    # Of each row one letter, and of two inserts before it.
    places = max(len(letters) for _, letters in w) + 3 * len(codes) + 3
    low = _BITS * places
    ones, unit, first = (1 << low) - 1, 1 << low, low - _BITS
    edge = {letter: (_LETTERS.index(letter) << first) for letter in "DIKR"}
    more = insert * unit + edge["I"]

    def behind(x: int) -> int:
        """A weight whose letters have moved one place on."""
        return (x & ~ones) | ((x & ones) >> _BITS)

    def inserted(x: list[int]) -> list[int]:
        n, s, u, a = x
        u_end = min(u, behind(a) + more)  # user, then an inserted assistant
        return [min(n, behind(u_end) + more), min(s, behind(u_end) + more), u_end, min(a, behind(u) + more)]

    now = [cost << low | _digits(letters, places) for cost, letters in w]
    now = inserted(now) if at_end else now
    for code in reversed(codes):
        then = [behind(x) for x in now]
        here = [x + delete * unit + edge["D"] for x in then]
        if not code & _MUST_GO:
            extra = truncated * unit if code & _CUT_OFF else 0
            moves = [(role, edge["R"] + rerole * unit + extra) for role in "ua"]
            if code & 3 < 3:
                moves.append((_INITIALS[code & 3], edge["K"] + extra))
            for role, weight in moves:
                for state, follows in _AFTER[role].items():
                    here[state] = min(here[state], then[follows] + weight)
        now = inserted(here)
    return [(x >> low, _letters(x & ones, places)) for x in now]


def cheapest(codes: bytes, costs: Costs = Costs()) -> tuple[int, str]:
    """Cost and letters of the cheapest edits of a conversation, of equal ones the first."""
    return _short(codes, costs) if len(codes) <= _LAYERS else _long(codes, costs)


@lru_cache(maxsize=4096)
def _short(codes: bytes, costs: Costs) -> tuple[int, str]:
    return _long(codes, costs)


def _long(codes: bytes, costs: Costs) -> tuple[int, str]:
    rerole, delete, insert, truncated = astuple(costs)
    never = delete * len(codes) + 4 * insert + rerole + truncated + 1  # more than deleting all rows
    w, ends = [(0, ""), (never, ""), (never, ""), (0, "")], []
    for hi in range(len(codes), -1, -_LAYERS):
        w = _layers(codes[max(0, hi - _LAYERS) : hi], w, costs, hi == len(codes))
        heads = [letters for _, letters in w]
        if len({len(h) for h in heads}) == 1:
            same = len(os.path.commonprefix([h[::-1] for h in heads])) - _GUARD
            if same > 0:
                ends.append(heads[0][-same:])
                w = [(cost, h[:-same]) for cost, h in w]
    return w[_NOTHING][0], w[_NOTHING][1] + "".join(reversed(ends))


def _said(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows after the damage that the hash of ``conv_id:turn`` deals; dropped ones stay as marks of their conversation."""
    rows = rows.select("conv_id", F.col("turn").cast("long"), _said("role").alias("role"), _said("text").alias("text"), F.pmod(F.crc32(F.concat(_said("conv_id"), F.lit(":"), _said("turn"))), F.lit(20)).alias("_h"))
    h, text = F.col("_h"), F.col("text")
    hurt = F.when(h.isin(0, 1), "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.array_repeat(h == 0, F.when(h == 3, 2).otherwise(1))).alias("dropped")
    return rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), copies)


def undamaged(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.col("turn").cast("long"), _said("role").alias("role"), _said("text").alias("text"), F.lit(False).alias("dropped"))


_ORDER = ["conv_id", "turn", "role", "digest"]


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, code, fault) of rows (conv_id, turn, role, text, dropped), by conversation and in order; one shuffle, without texts."""
    text, role = F.col("text"), F.col("role")
    blank = ~text.rlike("[^\\x20\\x09-\\x0D]")
    whole = text.rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    initial = F.coalesce(*(F.when(role.startswith(c), k) for k, c in enumerate(_INITIALS)), F.lit(3))
    known = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), initial.alias("initial"), blank.alias("blank"), whole.alias("whole"), "dropped")
    # Rows of a conversation are together already, so the window needs no shuffle of its own.
    same = Window.partitionBy("conv_id", "role", "digest", "dropped").orderBy("turn")
    told = known.repartition("conv_id").withColumn("copy", F.row_number().over(same))
    fault = F.when(F.col("blank"), BLANK).when(F.col("copy") > 1, DUPLICATE).when(~F.col("whole"), TRUNCATED).otherwise(0)
    told = told.withColumn("fault", fault).sortWithinPartitions(*_ORDER, "copy")
    code = F.col("initial") + F.when(F.col("fault").isin(BLANK, DUPLICATE), _MUST_GO).when(F.col("fault") == TRUNCATED, _CUT_OFF).otherwise(0)
    return told.select(F.col("conv_id").cast("string"), "turn", F.when(F.col("dropped"), _DROPPED).otherwise(code).alias("code"), "fault")


DECISION = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Conversation:
    """What is kept of a conversation while its rows go by."""

    def __init__(self):
        self.codes, self.counts = bytearray(), [0, 0, 0, 0]
        self.first = self.last = None
        self.turns = self.illegal = 0

    def add(self, turn, code: int, fault: int) -> None:
        if code == _DROPPED:
            return
        if self.codes and (_INITIALS + "?")[self.codes[-1] & 3] + (_INITIALS + "?")[code & 3] not in _LEGAL:
            self.illegal += 1
        self.codes.append(code)
        self.counts[fault] += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1

    def decision(self, conv_id, costs: Costs) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        cost, audit = cheapest(bytes(self.codes), costs)
        return (conv_id, gaps, *self.counts[1:], self.illegal, cost, audit)


def _decide(batches: Iterator[pd.DataFrame], costs: Costs) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in DECISION.split(", ")]
    name, held = "", None
    for pdf in batches:
        out = []
        for conv_id, turn, code, fault in zip(pdf["conv_id"], pdf["turn"], pdf["code"].tolist(), pdf["fault"].tolist(), strict=True):
            if held is None or conv_id != name:
                if held is not None:
                    out.append(held.decision(name, costs))
                name, held = conv_id, _Conversation()
            held.add(None if turn is None else int(turn), code, fault)
        yield pd.DataFrame(out, columns=columns)
    if held is not None:
        yield pd.DataFrame([held.decision(name, costs)], columns=columns)


def decide(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """A row per conversation: its faults, and cost and letters of its cheapest edits."""
    held = coded(rows).withColumn("turn", F.col("turn").cast("string"))  # exact beside nulls
    return map_rows(held, partial(_decide, costs=costs), DECISION).withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def _behind(decisions: DataFrame, rows: DataFrame) -> DataFrame:
    """Each conversation's letters and then its rows in order: one shuffle of the texts."""
    texts = rows.where("NOT dropped").select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    both = texts.unionByName(decisions.select("conv_id", "audit"), allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("audit"), *_ORDER[1:])
    return ordered.select(F.col("conv_id").cast("string"), "audit", "role", "text")


def _replayed(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[str | None, str | None, str | None]]]:
    """(conv_id, role, text) of the repaired rows in order, batch by batch, and (conv_id, None, None) where a conversation begins."""
    letters, at, last = "", 0, ""

    def edits(upto_row: bool):
        """The edits up to the next row, or all that are left."""
        nonlocal at, last
        while at < len(letters):
            letter, wanted = letters[at], "assistant" if last == "u" else "user"
            if letter != "I" and upto_row:
                return
            at, last = at + 1, wanted[0]
            yield wanted

    name = None
    for pdf in batches:
        out: list[tuple[str | None, str | None, str | None]] = []
        for conv_id, audit, role, text in zip(pdf["conv_id"], pdf["audit"], pdf["role"], pdf["text"], strict=True):
            if audit is not None:  # the next conversation; what is left of the one before are inserts
                out += [(name, r, "") for r in edits(False)]
                letters, at, last, name = audit, 0, "", conv_id
                out.append((conv_id, None, None))
                continue
            out += [(conv_id, r, "") for r in edits(True)]
            letter, wanted = letters[at], "assistant" if last == "u" else "user"
            at += 1
            if letter != "D":
                role = role if letter == "K" else wanted
                last = role[:1]
                out.append((conv_id, role, text))
        yield out
    yield [(name, r, "") for r in edits(False)]


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    place = 0
    for held in _replayed(batches):
        out = []
        for conv_id, role, text in held:
            if role is None:
                place = 0
            else:
                out.append((conv_id, place, role, text))
                place += 1
        yield pd.DataFrame(out, columns=["conv_id", "place", "role", "text"])


def repaired(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows of the repaired conversations."""
    out = map_rows(_behind(decisions, rows), _rows, "conv_id string, place long, role string, text string")
    return out.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def _hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    name, digest, empty = None, None, True
    for held in _replayed(batches):
        out = []
        for conv_id, role, text in held:
            if role is None:
                if digest is not None:
                    out.append((name, digest.hexdigest()))
                name, digest, empty = conv_id, hashlib.sha256(), True
            else:
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
        yield pd.DataFrame(out, columns=["conv_id", "sha256"])
    if digest is not None:
        yield pd.DataFrame([(name, digest.hexdigest())], columns=["conv_id", "sha256"])


def digests(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the repaired rows of each conversation as ``role:text`` lines, read as they come."""
    out = map_rows(_behind(decisions, rows), _hash, "conv_id string, sha256 string")
    return out.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def repair(rows: DataFrame, costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """Decisions as a written table, and the repaired rows, of rows (conv_id, turn, role, text, dropped)."""
    scratch = Scratch(rows.sparkSession, "repair")
    with small_batches(rows.sparkSession):
        decisions = scratch.keep(decide(rows, costs), "decisions")
    return decisions, repaired(rows, decisions)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    decisions, _ = repair(rows)
    hashes = digests(rows, decisions).withColumnRenamed("conv_id", "_conv")
    joined = decisions.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return joined.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"))
