"""SentencePiece BPE model: reading the file, exact encoding by backtracking, decoding.

The encoder relies on one fact about merge-type BPE: a token sequence is the encoding of its text
if and only if every two adjacent tokens are compatible, that is, merging the text of the pair
afresh gives the same pair. So instead of running the merge queue over a text, it walks left to
right over the longest vocabulary matches (found by an Aho-Corasick automaton), checks each new
token against the one before, falls back to shorter matches, and remembers positions from which
no encoding goes on in a bitfield.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """The fields of one protocol buffer message, in order."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            n = {1: 8, 5: 4}.get(key & 7)
            if n is None:
                n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


codecs.register_error("one-byte-each", lambda e: ("�", e.start + 1))


class Model:
    """A merge-type (BPE) SentencePiece model with identity normalisation and byte fallback."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, norm = {}, {}
        for field, value in _fields(raw):
            if field == 1:
                d = dict(_fields(value))
                self.pieces.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                norm = dict(_fields(value))
        if trainer.get(3) != 2 or norm.get(1) != b"identity" or norm.get(4, 1) or not norm.get(3, 1) or not trainer.get(35) or trainer.get(24):
            raise ValueError("only BPE models with identity normalisation, dummy prefix, kept white space and byte fallback")
        if any(t in (USER, UNUSED) for _, _, t in self.pieces):
            raise ValueError("user-defined or unused pieces are not supported")
        self.score = {p: s for p, s, t in self.pieces if t == NORMAL}
        self.id = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        self.byte_id = [0] * 256
        for i, (p, _, t) in enumerate(self.pieces):
            if t == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
        self.text = [SPACE + "⁇" + SPACE if t == UNKNOWN else "" if t == CONTROL else p for p, _, t in self.pieces]
        self.as_byte = {i: b for b, i in enumerate(self.byte_id)}
        self.tokens = {p for p in self.id if self.merge(p) == [p]}
        self.characters = {t for t in self.tokens if len(t) == 1}
        self.bytes_used = frozenset(self.byte_id)
        self.cut = self._cutter()
        self._pairs: dict[tuple[str, str], bool] = {}
        self._shorter: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for p in self.tokens:
            self.automaton.add_word(p)
        self.automaton.make_automaton()

    def _cutter(self) -> re.Pattern:
        """A pattern whose matches no piece spans: words with the white space before them.

        Inside a piece, a character of `cut` follows only space marks and its like, so a text may be
        cut before it where another character precedes; a space mark follows only space marks.
        """
        inner = [(a, b) for p in self.id for a, b in zip(p, p[1:], strict=False)]
        if any(b == SPACE and a != SPACE for a, b in inner):
            return re.compile(".+", re.S)
        cut = {c for p in self.id for c in p if c.isascii() and not c.isalnum()} | {"\n", "\t", "\r"}
        while glued := {b for a, b in inner if b in cut and a != SPACE and a not in cut}:
            cut -= glued
        breaks = "".join(re.escape(c) for c in sorted(cut))
        return re.compile(f"{SPACE}+[{breaks}]*[^{SPACE}{breaks}]*|[{breaks}]+[^{SPACE}{breaks}]*|[^{SPACE}{breaks}]+") if breaks else re.compile(".+", re.S)

    def merge(self, text: str) -> list[str]:
        """The definition: merge the neighbours whose union scores best, leftmost first, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the two tokens' text afresh gives the two tokens."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > 1_000_000:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merge(a + b) == [a, b]
        return known

    def forget(self) -> None:
        """Drop what was remembered of texts; all of it can be found again."""
        self._pairs.clear()
        self._shorter.clear()

    def shorter(self, token: str) -> str:
        """The longest token that is a proper prefix of `token`; "" if there is none."""
        known = self._shorter.get(token)
        if known is None:
            known = self._shorter[token] = next((token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in self.tokens), "")
        return known

    def _encode_known(self, text: str) -> list[str]:
        """Encode a text each of whose characters is a token."""
        n = len(text)
        longest = [0] * n
        for end, length in self.automaton.iter(text):  # by ascending ends, so the last match from a start is its longest
            longest[end - length + 1] = length
        failed = bytearray(n // 8 + 1)  # bit i: no encoding of the rest starts at i after the tokens tried
        pairs, shorter = self._pairs, self._shorter
        out: list[str] = []
        at, token = 0, text[: longest[0]]
        while at < n:
            while token:
                end = at + len(token)
                if not failed[end >> 3] >> (end & 7) & 1:
                    if not out:
                        break
                    fits = pairs.get((out[-1], token))
                    if fits is None:
                        fits = self.compatible(out[-1], token)
                    if fits:
                        break
                less = shorter.get(token)
                token = self.shorter(token) if less is None else less
            if token:
                out.append(token)
                at += len(token)
                token = text[at : at + longest[at]] if at < n else ""
            else:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= len(last)
                token = self.shorter(last)
        return out

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """The ids of a text that is already escaped and has no further prefix."""
        if self.characters.issuperset(chunk):
            return tuple(map(self.id.__getitem__, self._encode_known(chunk))) if chunk else ()
        out: list[int] = []
        start = 0
        for i, c in enumerate(chunk):
            if c not in self.characters:
                if start < i:
                    out += [self.id[p] for p in self._encode_known(chunk[start:i])]
                out += [self.byte_id[b] for b in c.encode("utf-8")]
                start = i + 1
        if start < len(chunk):
            out += [self.id[p] for p in self._encode_known(chunk[start:])]
        return tuple(out)

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids: Iterable[int]) -> str:
        """The text of `ids`; bytes that aren't UTF-8 become U+FFFD one by one."""
        ids = list(ids)
        if self.bytes_used.isdisjoint(ids):
            return "".join(map(self.text.__getitem__, ids)).removeprefix(SPACE).replace(SPACE, " ")
        parts: list[str] = []
        run = bytearray()
        for i in ids:
            b = self.as_byte.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                parts.append(run.decode("utf-8", "one-byte-each"))
                run.clear()
            parts.append(self.text[i])
        if run:
            parts.append(run.decode("utf-8", "one-byte-each"))
        return "".join(parts).removeprefix(SPACE).replace(SPACE, " ")


class Cache(dict):
    """Results by chunk, for chunks of up to `long` characters; emptied when it has `most` of them."""

    def __init__(self, fn, most: int = 800_000, long: int = 64):
        self.fn, self.most, self.long = fn, most, long

    def __missing__(self, chunk: str):
        value = self.fn(chunk)
        if len(chunk) <= self.long:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = value
        return value


@lru_cache(maxsize=2)
def load(raw: bytes) -> tuple[Model, Cache]:
    """The model and the cache of encoded chunks; one of each in a Python worker."""
    model = Model(raw)
    return model, Cache(model.encode_chunk)
