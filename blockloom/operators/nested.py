"""Nested arrays and tuples of contract data as JSON, a whole Arrow batch at a time.

A batch's bytes lie in one numpy buffer. Each part of a type is read once for
all its values in the batch, level by level: words by their places, offsets and
counts as integer arrays, elements as repeated places. Only the texts of leaves
and their joints are Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from json.encoder import encode_basestring

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..catalog import Param

#: Values of one part of a type that are held together; a batch with more is read in halves.
MOST_VALUES = 4_000_000


class TooMany(Exception):
    """More values than are held together."""


def is_dynamic(p: Param) -> bool:
    if p.type.endswith("]"):
        return p.type.endswith("[]") or is_dynamic(element_of(p))
    if p.type.startswith("("):
        return any(is_dynamic(c) for c in p.components)
    return p.type in ("string", "bytes")


def element_of(p: Param) -> Param:
    return Param("", p.type[: p.type.rindex("[")], components=p.components)


def head_words(p: Param) -> int:
    """Words that a parameter takes in the head."""
    if is_dynamic(p):
        return 1
    if p.type.endswith("]"):
        return int(p.type[p.type.rindex("[") + 1 : -1]) * head_words(element_of(p))
    return sum(map(head_words, p.components)) if p.type.startswith("(") else 1


class Batch:
    """Rows of bytes, of which values are read by row and place; a place without all its bytes has no value."""

    def __init__(self, rows: Sequence[bytes]):
        self.size = np.array([len(r) for r in rows], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))[:-1]
        self.bytes = b"".join(rows)
        self.buffer = np.frombuffer(self.bytes + bytes(32), np.uint8)

    def words(self, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words (n x 32) at the places, and whether they are there."""
        here = (at >= 0) & (at + 32 <= self.size[row])
        return self.buffer[(self.start[row] + np.where(here, at, 0))[:, None] + np.arange(32)] if len(self.bytes) else np.zeros((len(row), 32), np.uint8), here

    def numbers(self, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets, lengths or counts of up to 32 bits, and whether they are there."""
        w, here = self.words(row, at)
        return np.ascontiguousarray(w[:, 24:]).view(">u8").ravel().astype(np.int64) & 0xFFFFFFFF, here & ~w[:, :28].any(axis=1)

    def values(self, p: Param, row: np.ndarray, at: np.ndarray, ok: np.ndarray) -> tuple[list[str], np.ndarray]:
        """JSON of each value, and whether it is whole; the text of one that is not means nothing."""
        if len(row) > MOST_VALUES:
            raise TooMany
        if p.type.endswith("]"):
            return self._array(p, row, at, ok)
        if p.type.startswith("("):
            out, k = [], 0
            for c in p.components:
                texts, ok = self._child(c, row, at + 32 * k, at, ok)
                out.append(texts)
                k += head_words(c)
            return ["[" + ",".join(x) + "]" for x in zip(*out, strict=True)] if out else ["[]"] * len(row), ok
        if p.type in ("string", "bytes"):
            n, here = self.numbers(row, at)
            ok = ok & here & (at + 32 + n <= self.size[row])
            lo = np.where(ok, self.start[row] + at + 32, 0)
            held = self.bytes
            cut = [held[a:b] for a, b in zip(lo.tolist(), (lo + np.where(ok, n, 0)).tolist(), strict=True)]
            return [encode_basestring(x.decode("utf-8", "replace")) for x in cut] if p.type == "string" else [f'"0x{x.hex()}"' for x in cut], ok
        w, here = self.words(row, at)
        return _leaves(p.type, w), ok & here

    def _child(self, p: Param, row: np.ndarray, at: np.ndarray, base: np.ndarray, ok: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Values in place, or behind offsets from ``base``."""
        if is_dynamic(p):
            offset, here = self.numbers(row, at)
            ok = ok & here
            at = np.where(ok, base + offset, 0)
        return self.values(p, row, at, ok)

    def _array(self, p: Param, row: np.ndarray, at: np.ndarray, ok: np.ndarray) -> tuple[list[str], np.ndarray]:
        inner, held = element_of(p), p.type[p.type.rindex("[") + 1 : -1]
        if held:
            n, start = np.full(len(row), int(held)), at
        else:
            n, here = self.numbers(row, at)
            ok, start = ok & here, at + 32
        size = 32 * head_words(inner)
        ok = ok & (n <= self.size[row]) & (n * 32 <= self.size[row] if size else True)
        n = np.where(ok, n, 0)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        if total > MOST_VALUES and len(self.size) > 1:
            raise TooMany
        within = np.arange(total) - np.repeat(ends - n, n)
        first = np.repeat(start, n)
        texts, good = self._child(inner, np.repeat(row, n), first + within * size, first, np.ones(total, np.bool_))
        bad = np.concatenate(([0], np.cumsum(~good)))
        ok = ok & (bad[ends] == bad[ends - n])
        return ["[" + ",".join(texts[a:b]) + "]" for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)], ok


def _leaves(kind: str, w: np.ndarray) -> list[str]:
    """Words as they stand in JSON: integers as text, bytes as hex."""
    if kind == "bool":
        return np.where(w[:, 31] != 0, "true", "false").tolist()
    if kind.startswith(("uint", "int")):
        signed = kind.startswith("int")
        low = np.ascontiguousarray(w[:, 24:]).view(">i8").ravel()
        fill = np.where((low < 0) & signed, 0xFF, 0).astype(np.uint8)
        short = (w[:, :24] == fill[:, None]).all(axis=1)
        if not signed:
            low = low.astype(np.uint64) if short.any() else low
        out = [f'"{x}"' for x in low.tolist()]
        for k in np.flatnonzero(~short).tolist():
            out[k] = f'"{int.from_bytes(w[k].tobytes(), signed=signed)}"'
        return out
    lo, hi = (12, 32) if kind == "address" else (0, int(kind[5:]))
    digits, width = np.ascontiguousarray(w[:, lo:hi]).tobytes().hex(), 2 * (hi - lo)
    return [f'"0x{digits[k : k + width]}"' for k in range(0, len(w) * width, width)]


def decode_rows(rows: Sequence[bytes | None], p: Param, head: int) -> list[str | None]:
    """JSON of the parameter whose place in the head is given, of each row; null where it does not fit."""
    known = [k for k, r in enumerate(rows) if r is not None]
    out: list[str | None] = [None] * len(rows)
    if not known:
        return out
    try:
        batch = Batch([bytes(rows[k]) for k in known])
        row = np.arange(len(known))
        texts, ok = batch._child(p, row, np.full(len(known), 32 * head), np.zeros(len(known), np.int64), np.ones(len(known), np.bool_))
    except TooMany:
        if len(known) == 1:
            return out
        half = len(rows) // 2
        return decode_rows(rows[:half], p, head) + decode_rows(rows[half:], p, head)
    for k, text, good in zip(known, texts, ok.tolist(), strict=True):
        out[k] = text if good else None
    return out


def json_udf(p: Param, head: int):
    """An Arrow UDF from data to JSON text."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series(decode_rows(series.tolist(), p, head), dtype=object)

    return decode
