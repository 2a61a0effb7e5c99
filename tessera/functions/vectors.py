"""Vector arithmetic on arrays, in doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.enrich import words
from tessera.functions.text import let


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def cosine_to(a: Column, query: list[float]) -> Column:
    """Similarity to a fixed vector, whose norm is folded into the plan."""
    return dot(a, literal(query)) / (norm(a) * math.sqrt(sum(x * x for x in query)))


def broken(v: Column) -> Column:
    """Whether an element is null, NaN or infinite."""
    return F.exists(doubles(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def hashed(c: Column, dimensions: int = 384) -> Column:
    """A deterministic stand-in for an embedding model: hashed word counts, normalised.

    No model is at hand without a network; the vector says which words a text has, not what it means.
    Slots are sorted once behind one of each, so a long text costs a sort and not a pass for each slot.
    """
    slots = F.transform(words(c), lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)))
    ordered = F.sort_array(F.concat(slots, F.sequence(F.lit(0).cast("long"), F.lit(dimensions - 1).cast("long"))))

    def counted(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, F.greatest(i - 1, F.lit(0)))))
        return let(first, lambda a: F.zip_with(a, F.concat(F.slice(a, 2, dimensions), F.array(F.size(s))), lambda x, y: (y - x - 1).cast("double")))

    def scaled(n: Column) -> Column:
        length = F.sqrt(F.aggregate(n, F.lit(0.0), lambda s, x: s + x * x))
        return let(length, lambda d: F.when(d > 0, F.transform(n, lambda x: x / d)))

    return let(let(ordered, counted), scaled)


def sound(v: Column, dimensions: int) -> Column:
    """A model's vector, normalised; null where it has another size, a broken element or no length."""
    return let(doubles(v), lambda x: F.when((F.size(x) == dimensions) & ~broken(x) & (norm(x) > 0), let(norm(x), lambda d: F.transform(x, lambda e: e / d))))
