"""Boolean trigram queries of regular expressions, and a trigram index over a block of texts.

`query(pattern)` is True (every text may match) or a tree of ("and", ...) and ("or", ...) over
lower-case trigrams that any text with a match must have. It is derived from the parsed pattern:
runs of pieces with few alternatives are multiplied out to strings, and each string asks for all
its trigrams.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

import numpy as np

#: A piece is multiplied out while it stands for at most so many strings.
MOST = 12


def _both(kind: str, parts: list):
    """Simplify an and/or of queries; True is the query that all texts pass."""
    flat = []
    for p in parts:
        if p is True:
            if kind == "or":
                return True
        elif isinstance(p, tuple) and p[0] == kind:
            flat += p[1:]
        else:
            flat.append(p)
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else (kind, *flat)


def _of_strings(strings) -> object:
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _fold(code: int) -> str:
    return chr(code).lower()


def _class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(_fold(arg))
        elif op is C.RANGE and arg[1] - arg[0] < 64:
            out |= {_fold(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 6 else None


def _sequence(nodes) -> tuple[set[str] | None, object]:
    """(the strings it stands for, lower case, or None; the query) of a sequence of parsed nodes."""
    whole: set[str] | None = {""}
    run: set[str] = {""}
    asked: list = []
    for op, arg in nodes:
        strings, need = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = {a + b for a in run for b in strings}
            continue
        whole = None
        asked += [_of_strings(run), need if strings is None else True]
        run = strings if strings is not None and len(strings) <= MOST else {""}
        if strings is not None and run == {""}:
            asked.append(_of_strings(strings))
    return (run if whole is not None else None), _both("and", [*asked, _of_strings(run)])


def _node(op, arg) -> tuple[set[str] | None, object]:
    if op is C.LITERAL:
        return {_fold(arg)}, True
    if op is C.IN:
        return _class(arg), True
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        each = [_sequence(x) for x in arg[1]]
        if all(s is not None for s, _ in each):
            return set().union(*(s for s, _ in each)), _both("or", [q for _, q in each])
        return None, _both("or", [q for _, q in each])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inside = arg
        strings, need = _sequence(inside)
        if (low, high) == (0, 1) and strings is not None and len(strings) < MOST:
            return strings | {""}, True
        if low >= 1 and strings is not None and low == high and len(strings) == 1 and low <= 8:
            return {next(iter(strings)) * low}, True
        return None, need if low >= 1 else True
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}, True
    return None, True


def query(pattern: str):
    strings, need = _sequence(_parser.parse(pattern))
    return need


def grams(q) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*(grams(x) for x in q[1:]))


#: Bytes to seven bits: ASCII in lower case, everything else 0, which no wanted trigram has.
_SEVEN = np.zeros(256, np.uint32)
_SEVEN[:128] = [ord(chr(c).lower()) for c in range(128)]


class Index:
    """Numbers of wanted trigrams by their 21 bits, for one pass over texts."""

    def __init__(self, wanted: set[str]):
        if any(len(g) != 3 or not g.isascii() or "\0" in g for g in wanted):
            raise ValueError("trigrams are three ASCII characters")
        self.grams = sorted(wanted)
        self.number = np.full(1 << 21, -1, np.int16)
        for k, g in enumerate(self.grams):
            a, b, c = map(ord, g)
            self.number[a << 14 | b << 7 | c] = k


class Block:
    """An inverted index of a block of texts: for each wanted trigram the ascending numbers of the texts that have it.

    Built in one pass over the texts' own trigrams; texts are set apart by bytes that no trigram holds.
    """

    def __init__(self, texts: list[str], index: Index):
        self.all = np.arange(len(texts))
        raw = [x.encode("utf-8", "surrogatepass") for x in texts]
        ends = np.cumsum([len(x) + 2 for x in raw])
        codes = _SEVEN[np.frombuffer(b"\xff\xff".join([*raw, b""]), np.uint8)]
        found = index.number[codes[:-2] << 14 | codes[1:-1] << 7 | codes[2:]] if len(codes) > 2 else np.zeros(0, np.int16)
        at = np.flatnonzero(found >= 0)
        pairs = np.unique(found[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, "right"))
        cut = np.searchsorted(pairs, np.arange(len(index.grams) + 1) * len(texts))
        self.postings = {g: pairs[lo:hi] - k * len(texts) for k, (g, lo, hi) in enumerate(zip(index.grams, cut[:-1], cut[1:], strict=True))}

    def candidates(self, q) -> np.ndarray:
        """The numbers of the texts that pass a query, by intersecting and uniting postings."""
        if q is True:
            return self.all
        if isinstance(q, str):
            return self.postings[q]
        parts = [self.candidates(x) for x in q[1:]]
        if q[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True)
        return out


def compiled(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern, flags | re.ASCII)
