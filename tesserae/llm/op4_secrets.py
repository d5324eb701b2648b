"""Operator 4: secret scans through a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams (see trigrams.py). A block of
documents (a slice of an Arrow batch) gets postings, in one pass over its own trigrams, for the trigrams that the rules ask for; a rule's query
is answered by intersecting and uniting postings, and only the candidates are searched with the
expression itself. A rule without mandatory trigrams, such as long runs of hex digits, is tried
on every text. The index never leaves its block, so nothing is shuffled and a lost task is run
again from its input.

A null or empty text has no spans. Texts are searched whole, as code points. Matches of one rule
don't overlap and are found leftmost first; matches of different rules may overlap and all stay.
Repeated rows give repeated results, an empty table an empty result. Other columns are dropped by
`scan` and kept as they are, whatever their names, by `redacted`.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, map_batches, map_whole
from .trigrams import Block, Index, compiled, grams, query


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` whose `group` has at least `least` characters."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0


#: The base kinds, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    # a run of the class is always whole, so the least length may stand in the expression
    Rule("hex", r"[0-9a-f]{24,}", 0, 0, 24),
)
#: Formats that the method adds.
MORE = (
    # the whole key: to its END line, or to the text's end where it has none
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?(?:-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.I),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}", re.I),
    Rule("login", r"://[^\s/:@]+:[^\s/:@]+@"),
    Rule("sk", r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_-]{16,}"),
    Rule("github", r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_]{20,}"),
    Rule("gitlab", r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_-]{20,}"),
    Rule("npm", r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{20,}"),
    Rule("thm", r"(?<![A-Za-z0-9])thm_(?:[A-Za-z0-9_.-]{1,200}_[A-Za-z0-9_-]{43}(?![A-Za-z0-9_-])|[A-Za-z0-9_-]{44,})"),
)
RULES = BASE + MORE


@cache
def _ready(rules: tuple[Rule, ...]) -> tuple[list, Index]:
    ready = [(r, compiled(r.pattern, r.flags), query(r.pattern)) for r in rules]
    return ready, Index(set().union(*(grams(q) for _, _, q in ready)))


def find(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, str]]]:
    """For each text its spans (start, end, kind), by start and then by the order of the rules."""
    texts = [x or "" for x in texts]
    ready, wanted = _ready(rules)
    block = Block(texts, wanted)
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for rank, (rule, expression, asked) in enumerate(ready):
        for i in block.candidates(asked):
            found[i] += [(m.start(), rank, m.end()) for m in expression.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [[(a, b, rules[k].kind) for a, k, b in sorted(x)] for x in found]


def candidate_counts(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> dict[str, int]:
    """How many texts each rule's trigram query leaves to be searched."""
    ready, wanted = _ready(rules)
    block = Block([x or "" for x in texts], wanted)
    return {r.kind: len(block.candidates(q)) for r, _, q in ready}


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of (key, spans array<struct<start, end, kind>>)."""
    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(key, text), f"`{key}` {kind}, spans array<struct<start:int,end:int,kind:string>>", lambda keys, texts: [keys, find(texts, rules)])


def listed(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def redact(text: str | None, spans) -> str | None:
    """The text with each maximal run of overlapping spans replaced by [REDACTED:kind of the first]."""
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        a, b, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < b:
            b = max(b, spans[k][1])
            k += 1
        out += [text[at:a], f"[REDACTED:{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The same rows and columns with secrets replaced in `text`; every row stays."""
    at = df.columns.index(text)

    def run(batch):
        texts = batch.column(at).to_pylist()
        new = [redact(x, s) for x, s in zip(texts, find(texts, rules), strict=True)]
        return batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return map_whole(df, run)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {r.kind for r in BASE}

    def run(keys, texts):
        out = [[], [], [], [], []]
        for spans in find(texts):
            base = [x for x in spans if x[2] in kinds]
            for k, r in enumerate(BASE):
                out[k].append(sum(x[2] == r.kind for x in base))
            out[3].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out[4].append(listed(spans))
        return [keys, *out]

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return map_batches(docs, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", run)
