"""Voting, averaging and fusion of a pixel's model outputs, as column expressions.

Class columns are NULL where a model has no data. Ties go to the lowest class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from geofold.functions.classes import N_CLASSES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def all_valid(models: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in models])


def argmax(values: Column) -> Column:
    """Index of the largest element, the first on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def majority(models: list[str], n_classes: int = N_CLASSES) -> tuple[Column, Column]:
    """(class, agreement): votes outside 0..n_classes-1 don't count; without data everywhere NULL and 0."""
    return weighted(models, None, n_classes)


def weighted(models: list[str], weights: dict[str, float] | None, n_classes: int = N_CLASSES) -> tuple[Column, Column]:
    """(class, confidence): each model votes with its weight (1 where none is given)."""
    if not models:
        raise ValueError("no models to vote")
    w = {m: float((weights or {}).get(m, 1.0)) for m in models}
    votes = F.array(*[sum((F.when(F.col(m) == k, F.lit(w[m])).otherwise(F.lit(0.0)) for m in models[1:]), F.when(F.col(models[0]) == k, F.lit(w[models[0]])).otherwise(F.lit(0.0))) for k in range(n_classes)])
    ok = all_valid(models)
    return F.when(ok, argmax(votes)), F.when(ok, F.array_max(votes) / F.lit(sum(w.values()))).otherwise(F.lit(0.0))


def average(probs: list[str | Column], weights: list[float] | None = None) -> Column:
    """Element-wise weighted mean of arrays of probabilities; weights are normalised."""
    if not probs:
        raise ValueError("no probabilities to average")
    w = weights or [1.0] * len(probs)
    if len(w) != len(probs) or min(w) < 0 or sum(w) <= 0:
        raise ValueError("weights must be as many as models, not negative, and not all zero")
    w = [x / sum(w) for x in w]

    def scaled(p, by):
        return F.transform(_c(p), lambda v: v.cast("double") * by)

    out = scaled(probs[0], w[0])
    for p, by in zip(probs[1:], w[1:]):
        out = F.zip_with(out, scaled(p, by), lambda a, b: a + b)
    return out


def entropy(probs: Column | str) -> Column:
    """Entropy of probabilities over its largest value, log2 of their number."""
    p = _c(probs)
    bits = F.aggregate(F.transform(p, lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return bits / F.when(F.size(p) > 1, F.log2(F.size(p).cast("double"))).otherwise(F.lit(1.0))


def sure(conf, threshold: float) -> Column:
    """Confidence at or above the threshold; NULL and NaN are not (NaN would compare as largest)."""
    c = _c(conf)
    return F.coalesce(~F.isnan(c) & (c >= threshold), F.lit(False))


def unsure(conf, threshold: float) -> Column:
    """Confidence below the threshold, or none; NaN is neither sure nor unsure."""
    c = _c(conf)
    return F.coalesce(~F.isnan(c) & (c < threshold), F.lit(True))


def fuse_high_res(base, refinement, conf=None, threshold: float = 0.5) -> tuple[Column, Column]:
    """(class, source): refinement where it has data, but base where it has data and the refinement is unsure. Source: 0 none, 1 base, 2 refinement."""
    b, r = _c(base), _c(refinement)
    back = F.lit(False) if conf is None else unsure(conf, threshold) & b.isNotNull()
    use = r.isNotNull() & ~back
    return F.when(use, r).otherwise(b), F.when(use, F.lit(2)).when(b.isNotNull(), F.lit(1)).otherwise(F.lit(0))


def fuse_confidence(base, refinement, conf, threshold: float = 0.5) -> tuple[Column, Column]:
    """(class, source): where both have data the refinement needs confidence; alone either stands."""
    b, r = _c(base), _c(refinement)
    use = r.isNotNull() & (b.isNull() | sure(conf, threshold))
    return F.when(use, r).otherwise(b), F.when(use, F.lit(2)).when(b.isNotNull(), F.lit(1)).otherwise(F.lit(0))
