"""Near-duplicate, contradiction and update classification of pairs of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions import scoring, text

DUPLICATE, UPDATE, CONTRADICTION, RELATED = 0.9, 0.45, 0.35, 0.35


def contradicts(a: Column, b: Column) -> Column:
    """One side is negated, the other isn't, and they share two tokens."""
    return (text.negated(a) != text.negated(b)) & (F.size(F.array_intersect(text.token_set(a), text.token_set(b))) >= 2)


def opposite(a: Column, b: Column) -> Column:
    """Each side names an opposite and together they name more than one."""
    x, y = text.antonyms(a), text.antonyms(b)
    return (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_union(x, y)) > 1)


def relationship(a: Column, b: Column, cosine: Column) -> Column:
    likeness = scoring.jaccard(text.token_set(a), text.token_set(b))
    return (
        F.when(cosine >= DUPLICATE, "duplicate").when(contradicts(a, b) & (cosine >= CONTRADICTION), "contradiction").when(opposite(a, b), "contradiction")
        .when((cosine >= 0.6) & (likeness >= 0.5), "duplicate").when((cosine >= UPDATE) & (likeness >= 0.25), "update").otherwise("unrelated")
    )
