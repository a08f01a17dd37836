"""Rating-scale primitives as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

LO, HI, MU0 = 800.0, 4000.0, 2000.0
S = 400.0 / math.log(10)


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clip(x, lo: float = LO, hi: float = HI) -> Column:
    return F.least(F.greatest(col(x), F.lit(lo)), F.lit(hi))


def pi(theta, b) -> Column:
    """Chance that ability ``theta`` solves difficulty ``b``: 1 / (1 + 10^((b - theta)/400))."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (col(b) - col(theta)) / 400.0))


def sigmoid(x) -> Column:
    """Logistic function, split on the sign so that exp never overflows."""
    x = col(x)
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def hazard(theta, b, rho) -> Column:
    """Expected log-2 hazard over the exposed share ``rho`` of a contest."""
    return math.log(2) * F.exp((col(theta) - col(b)) / S) * col(rho)


def logit(x, edge: float = 0.01) -> Column:
    x = clip(x, edge, 1 - edge)
    return F.ln(x / (1 - x))


def weighted_rating(field: Column, target, lo: float = LO, hi: float = HI, halvings: int = 32) -> Column:
    """The b at which the field's weighted expected solves equal ``target``.

    ``field`` is an array of struct(theta, w).  The sum falls in b: at most the
    target at ``lo`` gives ``lo``, at least the target at ``hi`` gives ``hi``,
    else bisection.  The array is one contest's field; it stays within a row.
    """
    total = lambda at: F.aggregate(field, F.lit(0.0), lambda acc, x: acc + x["w"] * pi(x["theta"], at))
    target = col(target)

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        above = total(mid) > target
        return F.struct(F.when(above, mid).otherwise(acc["lo"]).alias("lo"), F.when(above, acc["hi"]).otherwise(mid).alias("hi"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")), halve, lambda acc: (acc["lo"] + acc["hi"]) / 2)
    return F.when(total(F.lit(lo)) <= target, F.lit(lo)).when(total(F.lit(hi)) >= target, F.lit(hi)).otherwise(root)


def performance_rating(rank, rivals: Column) -> Column:
    """The rating at which ``rivals`` are expected to hold ``rank`` - 1 better places."""
    return weighted_rating(rivals, col(rank).cast("double") - 1, halvings=32)
