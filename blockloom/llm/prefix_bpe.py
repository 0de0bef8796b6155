"""Byte-level BPE by prefix dynamic programming, exact to the rank files' own rule.

Every byte prefix of a piece has exactly one token that can end its encoding:
the suffix in the vocabulary that stays apart from the last token of what is
before it, that is, two tokens whose bytes encoded together give these two
tokens again. So one pass stores the last token of each prefix, and the
encoding is read from the end backwards. The table makes two things exact that
plain merging cannot do: bytes are appended by going on with the table
(``PieceTable.extend``), and after an edit only the pieces around it are
encoded again, from the first byte that differs (``EditedText``).

The new pieces of a batch are encoded together: their tables grow side by side,
a byte of all of them at a time, in numpy. Whether two tokens stay apart is
read there from how they are made: their last merges are undone one by one,
latest first, and a token across the border that would have come before is
looked for (``Pairs``).

A piece is a match of the split pattern; a piece that is a token is that
token. Letters and digits are those of the tiktoken library's own tables: for
characters that Python's ``regex`` knows from a later Unicode version, a
stand-in of the class that tiktoken sees is split in their place.

Rules. A null text counts as empty and has no ids; texts of any length are
encoded whole, without special tokens: their strings are ordinary text. Rows
with a null doc_id and repeated rows each give their row. Other columns are not
read. An empty table gives an empty table. Ids that are not in the vocabulary
are refused by ``decode``.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import small_batches
from .tokens import Encoder
from .workers import keep

#: Pairs of tokens of which a worker remembers whether they stay apart, and words and pieces of which it remembers the ids: about 150 MB together.
PAIRS, WORDS, PIECES = 300_000, 500_000, 50_000
#: Pairs whose answers a worker keeps by their place in a table of fixed size, 8 bytes each; a power of two.
CACHE = 1 << 20
#: Pieces that are worth a step of all tables side by side; longer ones than so many have are encoded alone.
FEW = 16
#: Characters beyond its end that a match of the pattern may have looked at.
LOOK = 3
#: Rows of an Arrow batch that are encoded together.
_ROWS = 250


class Vocabulary:
    """The ranks of a file of base64 tokens and their ids, by which the lowest rank is merged first."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            lines = (line.split() for line in f)
            self.rank = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.bytes = {r: token for token, r in self.rank.items()}
        if missing := [b for b in range(256) if bytes([b]) not in self.rank]:
            raise ValueError(f"no token for the byte {missing[0]}")
        self.longest = max(map(len, self.rank))
        #: What ``apart`` has said, by pair.
        self.known: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids by the rule itself: of neighbouring parts those that make the lowest rank are merged, the leftmost first."""
        parts = [data[k : k + 1] for k in range(len(data))]
        ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while known := [r for r in ranks if r is not None]:
            k = ranks.index(min(known))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            for j in (k - 1, k):
                if 0 <= j < len(ranks):
                    ranks[j] = self.rank.get(parts[j] + parts[j + 1])
        return [self.rank[p] for p in parts]

    def apart(self, left: int, right: int) -> bool:
        """Whether the bytes of two tokens, encoded together, are these two tokens; ``left`` -1 asks whether ``right`` is its own encoding."""
        key = (left + 1) << 32 | right
        if (found := self.known.get(key)) is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            whole = self.bytes[right] if left < 0 else self.bytes[left] + self.bytes[right]
            found = self.known[key] = self.merge(whole) == ([right] if left < 0 else [left, right])
        return found

    def decode(self, ids: Sequence[int]) -> bytes:
        try:
            return b"".join(map(self.bytes.__getitem__, ids))
        except KeyError as bad:
            raise ValueError(f"not an id of the vocabulary: {bad}") from bad


class Lookup:
    """Values of 64-bit keys that are not negative, found for whole arrays."""

    def __init__(self, most: int):
        bits = most.bit_length() + 2
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New keys, each once."""
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], at[~placed] + 1 & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values; -1 where there is none."""
        at = self._slots(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        far = np.flatnonzero((held != keys) & (held >= 0))
        while len(far):
            at = (at if len(at) == len(far) else at[far]) + 1 & self.mask
            wanted, held = keys[far], self.keys[at]
            hit = held == wanted
            out[far[hit]] = self.values[at[hit]]
            on = (held >= 0) & ~hit
            far, at = far[on], at[on]
        return out


class Pairs:
    """``Vocabulary.apart`` for arrays of tokens, which are numbered by rank here.

    A token that is its own encoding is made by one last merge of two others.
    Where each is of a higher rank than the two, merges come in the order of
    ranks, so the states of two neighbours are those that undoing the later
    last merge gives, again and again. They stay apart if in none of the states
    the parts at the border make a token that would have come before the merge
    that was undone. Where a file breaks that order (``ordered``), pairs are
    merged as they are.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        self.ids = np.array(sorted(v.bytes), np.int64)
        tokens = [v.bytes[r] for r in self.ids.tolist()]
        number = {t: k for k, t in enumerate(tokens)}
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.own = self.size == 1
        #: By token: its rank among all, -1 for single bytes; the two that it is made of.
        self.made = np.where(self.own, -1, np.arange(len(tokens)))
        self.head, self.tail = np.full((2, len(tokens)), -1, np.int64)
        self.merged, self.ordered = Lookup(len(tokens)), True
        self.cache = np.full(CACHE, -1, np.int64)
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for k, t in enumerate(tokens):
            for cut in range(1, len(t)):
                if (x := number.get(t[:cut])) is not None and (y := number.get(t[cut:])) is not None:
                    by_size.setdefault(len(t), []).append((x, y, k))
        for n in sorted(by_size):
            x, y, k = np.array(by_size[n], np.int64).T
            # The two parts themselves make k, which is not among the merged yet.
            fit = self._undo(x, y)
            x, y, k = x[fit], y[fit], k[fit]
            self.ordered = self.ordered and bool((np.maximum(self.made[x], self.made[y]) < k).all())
            self.own[k], self.head[k], self.tail[k] = True, x, y
            self.merged.add(x * len(tokens) + y, k)
            if not self.ordered:
                break
        self._tree(tokens)

    def _tree(self, tokens: list[bytes]) -> None:
        """Nodes by (node, byte), for tokens from their last byte on; ``token`` has the token that a node ends, or -1."""
        flat, ends = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(self.size)
        node, rest, nodes, steps = np.zeros(len(tokens), np.int64), np.arange(len(tokens)), 1, []
        ended = []
        for depth in range(int(self.size.max())):
            keys, place = np.unique(node[rest] << 8 | flat[ends[rest] - 1 - depth], return_inverse=True)
            steps.append((keys, np.arange(nodes, nodes + len(keys))))
            node[rest] = nodes + place
            nodes += len(keys)
            last = self.size[rest] == depth + 1
            ended.append(rest[last])
            rest = rest[~last]
        self.steps, self.token = Lookup(nodes), np.full(nodes, -1, np.int64)
        for keys, to in steps:
            self.steps.add(keys, to)
        held = np.concatenate(ended)
        self.token[node[held]] = held

    def _undo(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = self.own[left] & self.own[right]
        live = np.flatnonzero(out)
        a, b, before = left[live], right[live], np.full(len(live), len(self.ids) + 1)
        while len(live):
            across = self.merged.get(a * len(self.ids) + b)
            crossed = (across >= 0) & (across < before)
            out[live[crossed]] = False
            on = ~crossed & (np.maximum(self.made[a], self.made[b]) >= 0)
            live, a, b = live[on], a[on], b[on]
            later = self.made[a] > self.made[b]
            # Of equal merges the leftmost comes first, so one at the border comes before the right token's, not before the left one's.
            before = np.where(later, a, b + 1)
            a, b = np.where(later, self.tail[a], a), np.where(later, b, self.head[b])
        return out

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not self.ordered:
            v, ids = self.vocabulary, self.ids
            return np.array([v.apart(x, y) for x, y in zip(ids[left].tolist(), ids[right].tolist(), strict=True)], bool)
        keys = left * len(self.ids) + right
        at = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).view(np.int64) & CACHE - 1
        held = self.cache[at]
        out = (held & 1).astype(bool)
        new = np.flatnonzero(held >> 1 != keys)
        if len(new):
            out[new] = self._undo(left[new], right[new])
            self.cache[at[new]] = keys[new] << 1 | out[new]
        return out

    def begins(self, right: np.ndarray) -> np.ndarray:
        """Whether tokens are their own encodings."""
        if not self.ordered:
            return np.array([self.vocabulary.apart(-1, x) for x in self.ids[right].tolist()], bool)
        return self.own[right]


class PieceTable:
    """A piece's bytes and the last token of each of its prefixes."""

    __slots__ = ("vocabulary", "data", "last")

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"", last: array | None = None):
        self.vocabulary, self.data, self.last = vocabulary, b"", last if last is not None else array("q")
        if data:
            self.extend(data)

    def extend(self, more: bytes) -> None:
        """Appends bytes; what is stored of shorter prefixes stays as it is."""
        v, last = self.vocabulary, self.last
        data = self.data = self.data + more
        rank, known, longest = v.rank.get, v.known.get, v.longest
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - longest), end):
                if (token := rank(data[start:end])) is None:
                    continue
                left = last[start - 1] if start else -1
                fits = known((left + 1) << 32 | token)
                if fits or fits is None and v.apart(left, token):
                    last.append(token)
                    break
            else:
                raise LookupError(f"no token ends the prefix of {end} bytes")

    def shared(self, data: bytes) -> PieceTable:
        """The table of other bytes, from the first that differs."""
        n = 0
        most = min(len(data), len(self.data))
        while n < most and data[n] == self.data[n]:
            n += 1
        out = PieceTable(self.vocabulary, b"", self.last[:n])
        out.data = data[:n]
        out.extend(data[n:])
        return out

    def ids(self) -> list[int]:
        v = self.vocabulary
        if (whole := v.rank.get(self.data)) is not None:
            return [whole]
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(v.bytes[out[-1]])
        return out[::-1]


def encode_piece(vocabulary: Vocabulary, data: bytes) -> list[int]:
    whole = vocabulary.rank.get(data)
    return [whole] if whole is not None else PieceTable(vocabulary, data).ids()


def _side_by_side(pairs: Pairs, pieces: list[bytes]) -> list[bytes]:
    """Ids of pieces that are sorted by length, the longest first: the last tokens of all prefixes of one length are found together."""
    size = np.array([len(p) for p in pieces])
    # Pieces that have a byte at a place are the first ones, so what belongs to a place stands together.
    having = len(pieces) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1))
    begin = np.concatenate(([0], np.cumsum(having)))
    flat, starts = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size
    data = [flat[starts[:n] + k].astype(np.int64) for k, n in enumerate(having.tolist())]
    last = np.empty(begin[-1], np.int64)
    for end in range(1, len(data) + 1):
        node, rows, found = 0, np.arange(having[end - 1]), []
        for start in range(end - 1, -1, -1):
            node = pairs.steps.get(node << 8 | data[start][rows])
            on = node >= 0
            if not on.all():
                node, rows = node[on], rows[on]
            if not len(rows):
                break
            token = pairs.token[node]
            is_token = token >= 0
            found.append((start, rows[is_token], token[is_token]))
            node = node.astype(np.int64)
        here = last[begin[end - 1] : begin[end]]
        here[:] = -1
        for start, at, token in reversed(found):
            open_ = here[at] < 0
            at, token = at[open_], token[open_]
            if len(at):
                fits = pairs.apart(last[begin[start - 1] + at], token) if start else pairs.begins(token)
                here[at[fits]] = token[fits]
        if (here < 0).any():
            raise LookupError(f"no token ends the prefix of {end} bytes")
    rows, left, back = np.arange(len(pieces)), size.copy(), []
    many = np.zeros(len(pieces), np.int64)
    while len(rows):
        token = last[begin[left - 1] + rows]
        back.append((rows, token))
        many[rows] += 1
        left = left - pairs.size[token]
        rows, left = rows[left > 0], left[left > 0]
    ends = np.cumsum(many)
    ids = np.empty(ends[-1], np.int64)
    for k, (rows, token) in enumerate(back):
        ids[ends[rows] - 1 - k] = token
    held = pairs.ids[ids].astype("<u4").tobytes()
    return [held[4 * b - 4 * n : 4 * b] for b, n in zip(ends.tolist(), many.tolist(), strict=True)]


def encode_pieces(pairs: Pairs, pieces: list[bytes]) -> list[bytes]:
    """Each piece's ids as little-endian unsigned 32-bit integers."""
    v, out, rest = pairs.vocabulary, [b""] * len(pieces), []
    for k, data in enumerate(pieces):
        if (whole := v.rank.get(data)) is not None:
            out[k] = whole.to_bytes(4, "little")
        elif data:
            rest.append(k)
    rest.sort(key=lambda k: -len(pieces[k]))
    # The longest, of which there are few of a length, are encoded alone.
    most = len(pieces[rest[FEW]]) if len(rest) > FEW else 0
    alone = next((n for n, k in enumerate(rest) if len(pieces[k]) <= most), len(rest))
    for k in rest[:alone]:
        out[k] = np.array(PieceTable(v, pieces[k]).ids(), "<u4").tobytes()
    if rest[alone:]:
        for k, ids in zip(rest[alone:], _side_by_side(pairs, [pieces[k] for k in rest[alone:]]), strict=True):
            out[k] = ids
    return out


def _later_characters() -> dict[int, int]:
    """Letters and digits of ``regex`` that the tiktoken library takes for something else, and a stand-in of the same class.

    Only characters that this Python has no category for can differ; tiktoken
    is asked about each of them, by a vocabulary in which a character is one
    token with a letter, or a digit, before it only if both are of one class.
    """
    import tiktoken

    new = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"]
    doubtful = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, new)))
    told = {}
    for lead in "a1":
        ranks = {bytes([b]): b for b in range(256)}
        for c in doubtful:
            ranks[(lead + c).encode()] = len(ranks)
        probe = tiktoken.Encoding("probe", pat_str=r"\p{L}+|\p{N}+|[^\p{L}\p{N}]+", mergeable_ranks=ranks, special_tokens={})
        told[lead] = {c for c in doubtful if len(probe.encode_ordinary(lead + c)) == 1}
    out = {}
    for c in doubtful:
        is_letter, is_digit = c in told["a"], c in told["1"]
        if bool(regex.match(r"\p{L}", c)) != is_letter or bool(regex.match(r"\p{N}", c)) != is_digit:
            out[ord(c)] = ord("é" if is_letter else "²" if is_digit else "§")
    return out


class Splitter:
    """Where the matches of a pattern begin and end, by the classes of characters that tiktoken knows."""

    _later: dict[int, int] | None = None

    def __init__(self, pattern: str):
        self.pattern = regex.compile(pattern)
        if Splitter._later is None:
            Splitter._later = _later_characters()

    def shown(self, text: str) -> str:
        """The text that is split: of the same length, with stand-ins for later characters."""
        if text.isascii():
            return text
        try:  # these hold none of them, and are told from others faster than they are translated
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.translate(self._later)
        return text

    def split(self, text: str) -> list[str]:
        shown = self.shown(text)
        found = self.pattern.findall(shown)
        if shown is text or shown == text:
            return found
        return [text[m.start() : m.end()] for m in self.pattern.finditer(shown)]

    def ends(self, shown: str, at: int) -> Iterator[tuple[int, int]]:
        """(start, end) of the matches from ``at`` on."""
        return (m.span() for m in self.pattern.finditer(shown, at))


class TextEncoder(Encoder):
    """``encode(texts)`` by the prefix tables, with the words of the other tokenizers' bounded memory.

    Texts are cut at single spaces and line feeds between other characters, where the pattern cuts as well.
    """

    def __init__(self, path: str, pattern: str, remember: int = WORDS):
        self.vocabulary, self.splitter = Vocabulary(path), Splitter(pattern)
        self.pairs = Pairs(self.vocabulary)
        self.special, self.sign, self.remember, self.words = [], None, remember, {}
        self.pieces: dict[str, bytes] = {}
        self.mark, self.mark_id = "\n", self.vocabulary.rank[b"\n"]
        # Other patterns may cut elsewhere.
        self.mode = "lead" if self.splitter.split("a b\nc d") == ["a", " b", "\n", "c", " d"] else "whole"

    def _encode(self, strings: list[str]) -> list[np.ndarray]:
        v, pieces, out = self.vocabulary, self.pieces, []
        cut = [self.splitter.split(text) for text in strings]
        new = list(set().union(*cut).difference(pieces))
        found = dict(zip(new, encode_pieces(self.pairs, [p.encode() for p in new]), strict=True))
        pieces.update(found)
        for parts in cut:
            out.append(np.frombuffer(b"".join(map(pieces.__getitem__, parts)), "<u4"))
        for piece in found:
            if len(piece) > v.longest:
                del pieces[piece]
        if len(pieces) > PIECES:
            pieces.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        return self.vocabulary.decode(np.frombuffer(ids, "<u4").tolist())


class EditedText:
    """A text whose ids follow its edits: each piece has its table, and an edit touches the pieces around it only."""

    def __init__(self, vocabulary: Vocabulary, splitter: Splitter, text: str = ""):
        self.vocabulary, self.splitter = vocabulary, splitter
        self.text, self.starts, self.tables = "", [], []
        #: Bytes whose last token was computed, over all edits.
        self.work = 0
        if text:
            self.replace(0, 0, text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, lo: int, hi: int, new: str) -> None:
        """Puts ``new`` in the place of the characters from lo to hi.

        Matches that ended, with what they looked at, before the edit stay; from
        there the text is split again until a match begins where one of the old
        text did, behind the edit.
        """
        if not 0 <= lo <= hi <= len(self.text):
            raise IndexError((lo, hi))
        old_starts, old_tables, moved = self.starts, self.tables, len(new) - (hi - lo)
        ends = [*old_starts[1:], len(self.text)] if old_starts else []
        first = bisect_left(ends, lo - LOOK)
        at = old_starts[first] if first < len(old_starts) else 0
        self.text = self.text[:lo] + new + self.text[hi:]
        shown = self.splitter.shown(self.text)
        starts, tables, rest = [], [], len(old_starts)
        for start, end in self.splitter.ends(shown, at):
            if start >= lo + len(new):
                k = bisect_left(old_starts, start - moved)
                if k < len(old_starts) and old_starts[k] == start - moved >= hi:
                    rest = k
                    break
            data = self.text[start:end].encode()
            k = first + len(starts)
            before = old_tables[k] if k < len(old_tables) and old_starts[k] == start else None
            table = before.shared(data) if before is not None else PieceTable(self.vocabulary, data)
            kept = 0 if before is None else next((j for j, (a, b) in enumerate(zip(data, before.data, strict=False)) if a != b), min(len(data), len(before.data)))
            self.work += len(data) - kept
            starts.append(start)
            tables.append(table)
        self.starts = [*old_starts[:first], *starts, *(s + moved for s in old_starts[rest:])]
        self.tables = [*old_tables[:first], *tables, *old_tables[rest:]]

    def ids(self) -> list[int]:
        return [t for table in self.tables for t in table.ids()]


def text_encoder(path: str, pattern: str, remember: int = WORDS) -> TextEncoder:
    """This worker's encoder."""
    return keep(("prefix bpe", path, pattern, remember), lambda: TextEncoder(path, pattern, remember))


def _through(batches: Iterator[pa.RecordBatch], make: Callable[[], Callable[[pa.RecordBatch], list]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    work = make()
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.binary()) for x in work(part))], schema=schema)


def _encoding(path: str, pattern: str, decoded: bool) -> Callable[[pa.RecordBatch], list]:
    enc = text_encoder(path, pattern)

    def work(part: pa.RecordBatch) -> list:
        ids = enc.encode([t or "" for t in part.column("text").to_pylist()])
        return [ids, [enc.decode(x) for x in ids]] if decoded else [ids]

    return work


def _decoding(path: str) -> Callable[[pa.RecordBatch], list]:
    v = keep(("prefix bpe ids", path), lambda: Vocabulary(path))
    return lambda part: [[v.decode(np.frombuffer(x, "<u4").tolist()) if x is not None else None for x in part.column("ids").to_pylist()]]


def bpe_encode(docs: DataFrame, ranks: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): each text's ids as little-endian unsigned 32-bit integers; with ``decoded`` also the bytes that they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), *([("decoded", pa.binary())] if decoded else [])])
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with small_batches(docs.sparkSession):
        return rows.mapInArrow(partial(_through, make=partial(_encoding, ranks, pattern, decoded), schema=schema), "doc_id long, ids binary" + (", decoded binary" if decoded else ""))


def bpe_decode(rows: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, decoded): the bytes of each row's ids; null where ids are null."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])
    held = rows.select(F.col("doc_id").cast("long"), F.col("ids").cast("binary"))
    return held.mapInArrow(partial(_through, make=partial(_decoding, ranks), schema=schema), "doc_id long, decoded binary")


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = bpe_encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    n = F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens")
    return rows.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
