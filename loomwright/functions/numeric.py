"""Columns of numbers: safe ratios, smoothing, fusion, vectors, gains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits(c: Column | str, n: int = 4) -> Column:
    """Rounded half up by the same arithmetic in every engine: floor(x * 10^n + 0.5) / 10^n."""
    return F.floor(_c(c) * float(10**n) + 0.5) / float(10**n)


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


def smoothed_rate(wins: Column | str, games: Column | str, prior_wins: float = 10, prior_games: float = 20) -> Column:
    """Percentage of wins with a prior, so few games pull towards the middle."""
    return (_c(wins) + prior_wins) / (_c(games) + prior_games) * 100.0


def growth(base: Column | str, step: Column | str, level: Column | str) -> Column:
    """Value at a level: steps grow a little with each level; level 1 and steps of 0 or less give the base."""
    base, step, n = _c(base), _c(step), _c(level) - 1
    return F.when((n > 0) & (step > 0), base + step * n * (0.7025 + 0.0175 * n)).otherwise(base)


def rrf(rank: Column | str, k: int = 60) -> Column:
    return 1.0 / (F.lit(float(k)) + _c(rank))


def sigmoid(x: Column | str, most: float = 60.0) -> Column:
    """Logistic function with its argument held within +-most."""
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-most), F.least(F.lit(most), _c(x)))))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double precision, summed from first to last."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(a: Column | str) -> Column:
    """The vector at length 1; a zero vector stays."""
    size = F.sqrt(dot(a, a))
    return F.transform(_c(a), lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double")))


def gain(relevance: Column | str, rank: Column | str) -> Column:
    """Discounted gain of a rank from 1."""
    return _c(relevance).cast("double") / F.log2(_c(rank) + 1.0)


def capped(value: Column | str, factor: float, most: float) -> Column:
    return F.least(_c(value) * factor, F.lit(most))
