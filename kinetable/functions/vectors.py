"""Column functions on ``array<double>`` vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``fn``."""
    return F.transform(F.array(value), fn)[0]


def vec(*parts: Column | float) -> Column:
    return F.array(*[p if isinstance(p, Column) else F.lit(float(p)) for p in parts])


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def zip_map(a: Column, b: Column, fn: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(a, b, lambda p, q: fn(p.cast("double"), q.cast("double")))


def add(a: Column, b: Column) -> Column:
    return zip_map(a, b, lambda p, q: p + q)


def sub(a: Column, b: Column) -> Column:
    return zip_map(a, b, lambda p, q: p - q)


def scale(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda v: v * k)


def dot(a: Column, b: Column) -> Column:
    return total(zip_map(a, b, lambda p, q: p * q))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda v: v.cast("double") * v.cast("double"))))


def sq_distance(a: Column, b: Column) -> Column:
    return total(zip_map(a, b, lambda p, q: (p - q) * (p - q)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sq_distance(a, b))


def l2_normalize(a: Column) -> Column:
    return let(norm(a), lambda n: F.when(n > 0, F.transform(a, lambda v: v.cast("double") / n)).otherwise(a))


def cosine_distance(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """1 - cosine; a missing side counts as distance 1."""
    cos = dot(a, b) / (norm(a) * norm(b) + F.lit(eps))
    return F.when(a.isNull() | b.isNull(), F.lit(1.0)).otherwise(F.lit(1.0) - cos)


def softmax(a: Column) -> Column:
    top = F.array_max(a).cast("double")
    e = F.transform(a, lambda v: F.exp(v.cast("double") - top))
    return let(e, lambda x: F.transform(x, lambda v: v / total(x)))


def argmax_index(a: Column) -> Column:
    """0-based index of the largest entry, lowest index on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmax_label(a: Column, labels: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), argmax_index(a) + 1)


def fit_dim(a: Column, n: int, fill: float = 0.0) -> Column:
    """Cut to ``n`` entries or pad with ``fill``."""
    missing = F.greatest(F.lit(n) - F.size(a), F.lit(0))
    return F.slice(F.concat(a.cast("array<double>"), F.array_repeat(F.lit(fill), missing)), 1, n)


def mean_abs(a: Column) -> Column:
    return mean(F.transform(a, lambda v: F.abs(v)))


def zscore(a: Column, mu: Column, sigma: Column) -> Column:
    return F.transform(a, lambda v, i: (v - F.get(mu, i)) / F.get(sigma, i))


def inverse_zscore(a: Column, mu: Column, sigma: Column) -> Column:
    return F.transform(a, lambda v, i: v * F.get(sigma, i) + F.get(mu, i))


def rescale(a: Column, mu_a: Column, sigma_a: Column, mu_b: Column, sigma_b: Column) -> Column:
    """Undo the first data set's normalisation, apply the second's."""
    return zscore(inverse_zscore(a, mu_a, sigma_a), mu_b, sigma_b)


def truncate_at(a: Column, eos: int) -> Column:
    """Cut after the first ``eos``; unchanged when absent."""
    p = F.array_position(a, eos)
    return F.when(p > 0, F.slice(a, F.lit(1), p.cast("int"))).otherwise(a)


def pad_left(a: Column, n: int, fill: int) -> Column:
    return F.concat(F.array_repeat(F.lit(fill).cast("long"), F.greatest(F.lit(n) - F.size(a), F.lit(0))), a)


def has_nan(a: Column) -> Column:
    return F.exists(a, lambda v: F.isnan(v))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
