"""Vector functions as Column expressions. Elements are summed from left to right in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "l2")


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once: what is bound to a lambda isn't planned again at each place where it stands."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _both(a: Column, b: Column, f) -> Column:
    n = F.least(F.size(a), F.size(b))
    short = lambda v: F.slice(v, F.lit(1), n)
    return F.aggregate(F.zip_with(short(a), short(b), lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    return _let(norm(a) * norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_both(a, b, lambda x, y: (x - y) * (x - y)))


def score(metric: str, a: Column, b: Column) -> Column:
    """Higher is better for every metric: l2 gives 1 / (1 + distance)."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    return {"cosine": cosine, "dot": dot, "l2": lambda x, y: 1 / (1 + euclidean(x, y))}[metric](a, b)


def score_of_distance(metric: str, distance: Column) -> Column:
    """Score from the distance that a vector index returns."""
    return {"cosine": 1 - distance, "dot": -distance, "l2": 1 / (1 + distance)}[metric]


def hash_components(text: Column, dimensions: int = 8, model: str = "fake-embed-v1") -> Column:
    """Components of a deterministic embedding, in [-1, 1]: the first 32 bits of a hash of model, index and text."""
    part = lambda i: F.conv(F.substring(F.sha2(F.concat(F.lit(model), F.lit(":"), i.cast("string"), F.lit(":"), text), 256), 1, 8), 16, 10)
    return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: part(i).cast("double") / F.lit(4294967295.0) * 2 - 1)


def normalised(v: Column) -> Column:
    return _let(v.cast("array<double>"), lambda w: _let(norm(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w)))


def embed(text: Column, dimensions: int = 8, model: str = "fake-embed-v1") -> Column:
    return normalised(hash_components(text, dimensions, model))


def int8(v: Column) -> Column:
    """Elements scaled by the largest magnitude to -127..127."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    return F.transform(v, lambda x: F.when(top > 0, F.round(x.cast("double") / top * 127)).otherwise(0.0).cast("int"))


def sign_bits(v: Column, start: int = 0, count: int = 63) -> Column:
    """Signs of up to 63 elements from `start` on, as the bits of a number."""
    part = F.slice(v, start + 1, count)
    return F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0))


def literal(text_column: Column) -> Column:
    """Vector from its text form [a,b,...]."""
    return F.from_json(text_column, "array<double>")


def as_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))
