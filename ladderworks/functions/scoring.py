"""Scores, expectations and rating-scale maths as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The scale between ratings and the internal unit, and the rank-to-rating curve.
SCALE = 173.7178
RANK_TOP, RANK_SLOPE, RANK_FLOOR, RANK_MAX = 3000.0, 160.0, 400.0, 4000


def score(own: Column, other: Column) -> Column:
    return F.when(own > other, 1.0).when(own < other, 0.0).when(own == other, 0.5)


def letter(home: Column, away: Column) -> Column:
    return F.when(home > away, "H").when(home < away, "A").when(home == away, "D")


def elo_expected(gap: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -gap / 400.0))


def g(phi: Column) -> Column:
    return 1.0 / F.sqrt(1.0 + 3.0 * phi * phi / math.pi**2)


def expected(mu: Column, other_mu: Column, other_phi: Column) -> Column:
    """Logistic in the opponent's deviation alone; certain beyond 35 units."""
    x = g(other_phi) * (mu - other_mu)
    return F.when(x > 35, 1.0).when(x < -35, 0.0).otherwise(1.0 / (1.0 + F.exp(-x)))


def rank_to_rating(rank: Column) -> Column:
    return F.greatest(F.lit(RANK_FLOOR), RANK_TOP - RANK_SLOPE * F.log(F.greatest(F.lit(1), F.least(rank, F.lit(RANK_MAX))).cast("double")))


def saturating(weight: Column, half: float, mode: str = "rational") -> Column:
    """Weight to trust, nothing below 0: w / (w + half), or 1 - e^(-w / half) in the mode exp."""
    w = F.greatest(weight, F.lit(0.0))
    return 1.0 - F.exp(-w / half) if mode == "exp" else w / (w + half)


def fixed_bin(x: Column, width: float) -> Column:
    return F.floor(x / width) * width


def volatility(sigma: Column, phi: Column, variance: Column, delta: Column, tau: float, rounds: int = 60) -> Column:
    """The new volatility: the root of the update equation by the Illinois variant of false position, in ``rounds`` steps
    of one fold over a literal array, so it runs inside the plan without a user function."""
    a = F.log(sigma * sigma)

    def f(x: Column) -> Column:
        e = F.exp(x)
        total = phi * phi + variance + e
        return e * (delta * delta - total) / (2.0 * total * total) - (x - a) / tau**2

    steps = F.array(*[F.lit(float(k)) for k in range(1, 40)])
    low = F.coalesce(F.get(F.filter(F.transform(steps, lambda k: a - k * tau), lambda x: f(x) >= 0), F.lit(0)), a - 40 * tau)
    gap = delta * delta - phi * phi - variance
    other = F.when(gap > 0, F.log(F.greatest(gap, F.lit(1e-300)))).otherwise(low)
    start = F.struct(a.alias("a"), other.alias("b"), f(a).alias("fa"), f(other).alias("fb"))

    def step(s: Column, _: Column) -> Column:
        c = F.when(F.abs(s.fb - s.fa) < 1e-300, s.b).otherwise(s.a + (s.a - s.b) * s.fa / (s.fb - s.fa))
        fc = f(c)
        crossed = fc * s.fb <= 0
        done = F.abs(s.b - s.a) <= 1e-6
        keep = lambda old, new: F.when(done, old).otherwise(new)
        return F.struct(keep(s.a, F.when(crossed, s.b).otherwise(s.a)).alias("a"), keep(s.b, c).alias("b"), keep(s.fa, F.when(crossed, s.fb).otherwise(s.fa / 2)).alias("fa"), keep(s.fb, fc).alias("fb"))

    return F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s.a / 2))
