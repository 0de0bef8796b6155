"""Vectorised word and shingle fingerprints shared by the text operators.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z
lower-cased. Its fingerprint is a polynomial of its UTF-8 bytes modulo 2**64,
mixed; numpy computes those of a whole block of text with one running sum.
Equal words have equal fingerprints; different words collide with a
probability of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Documents are joined to blocks of about so many bytes; a longer text is cut at a space.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Separators for words of letters and digits: every other ASCII character.
NOT_ALNUM = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_FACTORS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for base, name in ((_BASE, "_powers"), (inverse, "_inverses")):
            x = np.full(max(n, BLOCK_BYTES + 4096), base, dtype=np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _block(data: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the words of a block, and where they start."""
    buf = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], separators[buf], [True])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    _grow(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers[: len(buf)], out=total[1:])
    return mix64((total[ends] - total[starts]) * _inverses[starts]), starts


def _cut(data: bytes) -> Iterator[bytes]:
    """A long text in pieces that end before a space."""
    at = 0
    while len(data) - at > BLOCK_BYTES:
        end = data.rfind(b" ", at + 1, at + BLOCK_BYTES)
        end = end if end > 0 else data.find(b" ", at + BLOCK_BYTES)
        if end < 0:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(texts: Sequence[str | None], separators: np.ndarray = _SPACE) -> list[np.ndarray]:
    """For each text the fingerprints of its words in order; none for null. The separators must include the space."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            hashes, starts = _block(b" ".join(d for _, d in held), separators)
            bounds = np.searchsorted(starts, np.cumsum([0] + [len(d) + 1 for _, d in held]))
            for (i, _), a, b in zip(held, bounds[:-1], bounds[1:], strict=True):
                out[i] = hashes[a:b]
        held, size = [], 0

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > BLOCK_BYTES:
            out[i] = np.concatenate([_block(piece, separators)[0] for piece in _cut(data)])
        elif data:
            held.append((i, data))
            size += len(data)
            if size > BLOCK_BYTES:
                flush()
    flush()
    return out


def windows(words: np.ndarray, offsets: Sequence[int]) -> np.ndarray:
    """A fingerprint for the words at the given offsets from each position that has them all."""
    n = len(words) - max(offsets)
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k, o in enumerate(offsets):
        total += words[o : o + n] * _FACTORS[k % len(_FACTORS)]
        if k % len(_FACTORS) == len(_FACTORS) - 1:
            total = mix64(total)
    return mix64(total)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted fingerprints of the distinct shingles; shorter texts are one shingle as a whole."""
    if not len(words):
        return words
    if len(words) < width:
        return windows(np.concatenate((words, np.array([len(words)], np.uint64))), range(len(words) + 1))
    return np.unique(windows(words, range(width)))
