"""A deterministic transducer that counts the tokens of merge-type BPE.

After reading a prefix of a text, the encoding of that prefix has one last token, and of all
vocabulary tokens that end here it is the only one that is compatible with the last token of the
prefix before it. So what a text's future depends on is finite: the longest suffix that begins a
token, and for each boundary inside that suffix the last token there and the number of tokens so
far relative to now. That is a state; a transition reads a character and is annotated with the
change of the number of tokens. States and transitions are compiled when first met and interned,
so a common word is a walk over integers.

A chunk of text maps states to states and adds a count. A chunk at a cut that no token spans maps
every state alike, so the counts of a text's chunks are summed. The blocks of a long unbroken run are
maps proper, by entry state; they are asked for the one start state only, one after the other.
"""

from __future__ import annotations

from functools import lru_cache

from .spm import Cache, Model

BLOCK = 4096


class Transducer:
    def __init__(self, model: Model):
        self.model = model
        self.prefixes = {t[:k] for t in model.tokens for k in range(len(t) + 1)}
        self.states: dict[tuple, int] = {}
        self.info: list[tuple] = []
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.most = 300_000
        self.start = self._intern("", ((None, 0),))

    def _intern(self, suffix: str, ends: tuple) -> int:
        key = (suffix, ends)
        at = self.states.get(key)
        if at is None:
            at = self.states[key] = len(self.info)
            self.info.append(key)
            self.moves.append({})
        return at

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        suffix, ends = self.info[state]
        if c not in self.model.tokens:  # bytes: nothing merges with them, what follows starts anew
            move = (self.start, len(c.encode("utf-8")))
        else:
            whole = suffix + c
            longer = next(whole[k:] for k in range(len(whole)) if whole[k:] in self.prefixes)
            for k in range(len(longer)):
                token = longer[k:]
                if token in self.model.tokens:
                    last, n = ends[len(ends) - 1 - (len(token) - 1)]
                    if last is None or self.model.compatible(last, token):
                        break
            else:
                raise AssertionError("every prefix has an encoding")
            delta = n + 1
            kept = [*((t, m - delta) for t, m in ends), (token, 0)][-len(longer) - 1 :]
            move = (self._intern(longer, tuple(kept)), delta)
        self.moves[state][c] = move
        return move

    def run(self, block: str, state: int) -> tuple[int, int]:
        """The block's map at one entry state: the exit state and the tokens counted."""
        moves, total = self.moves, 0
        for c in block:
            step = moves[state].get(c) or self._compile(state, c)
            state = step[0]
            total += step[1]
        return state, total

    def chunk(self, text: str) -> int:
        """The tokens of a chunk that starts where no token spans."""
        if len(self.info) > self.most:  # compiled states are a cache: drop them between chunks
            self.states.clear()
            self.info.clear()
            self.moves.clear()
            self.start = self._intern("", ((None, 0),))
        if len(text) <= BLOCK:
            return self.run(text, self.start)[1]
        maps = [BlockMap(self, text[i : i + BLOCK]) for i in range(0, len(text), BLOCK)]
        return prefix_scan(maps)[-1](self.start)[1]


class BlockMap:
    """The map of one block: entry state to (exit state, count), filled where it is asked for."""

    def __init__(self, machine: Transducer, block: str):
        self.machine, self.block, self.known = machine, block, {}

    def __call__(self, state: int) -> tuple[int, int]:
        if state not in self.known:
            self.known[state] = self.machine.run(self.block, state)
        return self.known[state]


class Composed:
    def __init__(self, first, then):
        self.first, self.then, self.known = first, then, {}

    def __call__(self, state: int) -> tuple[int, int]:
        if state not in self.known:
            middle, a = self.first(state)
            end, b = self.then(middle)
            self.known[state] = (end, a + b)
        return self.known[state]


def prefix_scan(maps: list) -> list:
    """All prefix compositions in a logarithmic number of rounds of independent compositions."""
    out, step = list(maps), 1
    while step < len(out):
        out = [Composed(out[i - step], out[i]) if i >= step else out[i] for i in range(len(out))]
        step *= 2
    return out


@lru_cache(maxsize=2)
def load(raw: bytes) -> tuple[Model, Cache]:
    model = Model(raw)
    return model, Cache(Transducer(model).chunk)
