"""Token ids of whole texts by a public tokenizer, with a bounded memory of words.

Natural text repeats its words, so each Python worker keeps the ids of the
words that it met and asks the tokenizers library for new ones only. Texts are
cut where both kinds of tokenizer cut anyway, so the ids are those of the whole
text:

- byte-level BPE: at a single space or line feed between two characters that
  are not white space. The space belongs to the word after it, a line feed is
  a token of its own.
- BPE that drops white space: at every space and line feed.

Texts with other runs of white space, those that hold a special token's string,
and other tokenizers, are encoded whole: the ids are those of the plain call.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

import numpy as np

from .workers import keep

#: Words that a worker remembers at most: about 160 MB; a quarter of them about 40 MB, at a third more CPU time.
REMEMBER = 1_000_000
#: Stands for a text that must not be cut; no word of a text that was cut.
_UNSAFE = "\n "
#: New words are encoded together, so many to a string.
_TOGETHER = 48


def _open(uri: str) -> bytes:
    with open(uri, "rb") as f:
        return f.read()


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers, without special tokens added."""

    def __init__(self, path: str, remember: int = REMEMBER):
        from tokenizers import Tokenizer

        spec = json.loads(_open(path))
        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that the tokenizer finds before it cuts, and what they all start with.
        self.special = [t["content"].lower() for t in spec.get("added_tokens") or ()]
        sign = os.path.commonprefix(self.special)[:1]
        self.sign = None if not self.special else "" if sign.isalpha() else sign
        self.remember, self.words = remember, {}
        self.mode = self._mode(spec)
        self.mark = {"lead": "\n", "drop": "|"}.get(self.mode, "")
        if self.mark:
            ids = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
            self.mark_id = ids[0]
            if len(ids) != 1:
                self.mode = "whole"

    @staticmethod
    def _mode(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
            return "lead"
        steps = [s.get("type") for s in (norm or {}).get("normalizers", [])]
        parts = pre.get("pretokenizers", [{}])
        if steps == ["NFC", "Replace", "Lowercase"] and parts[0].get("behavior") == "Removed" and parts[0].get("invert"):
            return "drop"
        return "whole"

    def _is_special(self, text: str) -> bool:
        if self.sign is None or self.sign not in text:
            return False
        low = text.lower()
        return any(t in low for t in self.special)

    def _parts(self, text: str) -> list[str]:
        """Cuts a text: a bare word follows a space, one that starts with a line feed follows that, the first word is marked by NUL."""
        if self._is_special(text):
            return [_UNSAFE]  # no safe cut
        if self.mode == "drop":
            return text.replace("\n", " ").split(" ")
        if "\0" in text:
            return [_UNSAFE]  # no safe cut
        out: list[str] = []
        first = "\0"
        for line in text.split("\n"):
            words = line.split(" ")
            words[0] = first + words[0]
            out += words
            first = "\n"
        return out

    def _encode(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Ids of new words; None for a word next to which a cut is not safe."""
        words = self.words
        if self.mode == "drop":
            together = [w for w in new if w and "|" not in w and w != _UNSAFE]
            alone = [w for w in new if "|" in w]
            words[""], words[_UNSAFE] = b"", None
            groups = [(together, "", " | ", b"")]
        else:
            plain, marked = [], {"\0": [], "\n": []}
            alone = []
            for w in new:
                body = w[1:] if w[:1] in marked else w
                if not body or body[0].isspace() or body[-1].isspace():
                    words[w] = None
                elif len(body.split()) > 1 or len("".join(body.split())) != len(body):
                    alone.append(w)
                elif body is w:
                    plain.append(w)
                else:
                    marked[w[0]].append(w)
            line = np.array([self.mark_id], "<u4").tobytes()
            groups = [(plain, " ", "\n", b""), (marked["\0"], None, "\n", b""), (marked["\n"], None, "\n", line)]
        for group, lead, joint, before in groups:
            strings = [joint.join(w[1:] if lead is None else lead + w for w in group[k : k + _TOGETHER]) for k in range(0, len(group), _TOGETHER)]
            for k, ids in enumerate(self._encode(strings)):
                held = ids.tobytes()
                cuts = [-1, *np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
                for w, a, b in zip(group[k * _TOGETHER :], cuts, cuts[1:], strict=False):
                    words[w] = before + held[4 * a + 4 : 4 * b]
        if alone:
            head = {"\0": "", "\n": "\n"}
            texts = alone if self.mode == "drop" else [head[w[0]] + w[1:] if w[0] in head else " " + w for w in alone]
            words.update(zip(alone, (x.tobytes() for x in self._encode(texts)), strict=True))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        if self.mode == "whole":
            return [x.tobytes() for x in self._encode(list(texts))]
        words, out = self.words, []
        cut = [self._parts(t) for t in texts]
        distinct: set[str] = set()
        for parts in cut:
            distinct.update(parts)
        new = list(distinct.difference(words))
        self._learn(new)
        for text, parts in zip(texts, cut, strict=True):
            if not text:
                out.append(b"")
                continue
            try:
                out.append(b"".join(map(words.__getitem__, parts)))
            except TypeError:  # an unsafe cut
                out.append(self._encode([text])[0].tobytes())
        if len(words) > self.remember:
            if len(new) > 0.4 * len(distinct):  # other text than before
                words.clear()
            else:
                for w in new:
                    del words[w]
        return out


def encoder(path: str, remember: int = REMEMBER) -> Encoder:
    """This worker's encoder; workers are used again, and keep it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return keep(("encoder", path, remember), lambda: Encoder(path, remember))
