"""Where a text quotes remembered texts: spans, and the text with its spans marked."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKS, ANSI = ("[mem]", "[/mem]"), ("\x1b[4m", "\x1b[24m")


def spans(text: str, wanted: list[str]) -> list[tuple[int, int, str]]:
    """All places of the wanted texts in any case, as (start, end, source); overlapping ones are one, named by the longest.

    Longer sources come first where several start together; spans that only touch stay apart.
    """
    low, found = text.lower(), []
    for source in wanted:
        at = low.find(source.lower()) if source else -1
        while at >= 0:
            found.append((at, at + len(source), source))
            at = low.find(source.lower(), at + 1)
    out: list[tuple[int, int, str]] = []
    for a, b, source in sorted(found, key=lambda s: (s[0], s[0] - s[1])):
        if out and a < out[-1][1]:
            c, e, name = out[-1]
            out[-1] = (c, max(b, e), source if b - a > e - c else name)
        else:
            out.append((a, b, source))
    return out


def marked(text: str, found: list[tuple[int, int, str]], marks: tuple[str, str] = MARKS) -> str:
    for a, b, _ in reversed(found):
        text = f"{text[:a]}{marks[0]}{text[a:b]}{marks[1]}{text[b:]}"
    return text


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("source", T.StringType())]))


@F.pandas_udf(_SPAN)
def memory_spans(texts: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([[dict(zip(("start", "end", "source"), s, strict=True)) for s in spans(t or "", list(w) if w is not None else [])] for t, w in zip(texts, wanted, strict=True)])


def _highlighter(marks: tuple[str, str]):
    @F.pandas_udf(T.StringType())
    def highlighted(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else marked(t, spans(t, list(w) if w is not None else []), marks) for t, w in zip(texts, wanted, strict=True)])

    return highlighted


highlighted, underlined = _highlighter(MARKS), _highlighter(ANSI)
