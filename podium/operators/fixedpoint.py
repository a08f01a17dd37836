"""The alternating fixed point: performance ratings by contest, abilities as their evidence-weighted means.

A contest's expected places are a sum over its field, so the curve of that sum
is added up in parts, on a fixed grid with its slopes, and inverted between grid
points by cubics.  No task holds a field, and fields of any size are inverted
the same way; the cubics are within 1e-7 rating points of the exact sum.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from podium.functions.rating import HI, LO, MU0, clip
from podium.plans.iterate import Parameters, repeat

#: Points of the grid, curves that a task adds up at a time, rows that meet a curve in one task, halvings to 1e-4.
GRID, HELD, SALT_ROWS, HALVINGS = 1025, 512, 50_000, 25
#: Fixed value: the weight of the two phantom teams.
SMOOTH = 0.5


def team_weights(rows: DataFrame) -> DataFrame:
    """(team, n, w): rows of each team, and the reliability 1 - 0.9^n."""
    return rows.groupBy("team").agg(F.count("*").alias("n")).withColumn("w", 1 - F.pow(F.lit(0.9), F.col("n")))


def expected(theta, b):
    return 1 / (1 + 10 ** ((b - theta) / 400))


def field_curve(theta: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(2, GRID): the field's weighted expected solves at the grid's points, and their slopes."""
    grid, out = np.linspace(LO, HI, GRID), np.zeros((2, GRID))
    for i in range(0, len(theta), 256):
        p = expected(theta[i : i + 256, None], grid[None, :])
        out[0] += w[i : i + 256] @ p
        out[1] -= w[i : i + 256] @ (p * (1 - p)) * (math.log(10) / 400)
    return out


def invert_curve(curve: np.ndarray, target: np.ndarray, extra=lambda b: 0.0, halvings: int = HALVINGS) -> np.ndarray:
    """For each target, the b where the curve and ``extra`` together fall to it; LO or HI where that is outside."""
    step = (HI - LO) / (GRID - 1)

    def total(b):
        at = np.minimum(((b - LO) / step).astype(np.int64), GRID - 2)
        t = (b - LO) / step - at
        v, d = curve[0], curve[1] * step
        cubic = (1 + 2 * t) * (1 - t) ** 2 * v[at] + t * (1 - t) ** 2 * d[at] + t * t * (3 - 2 * t) * v[at + 1] - t * t * (1 - t) * d[at + 1]
        return cubic + extra(b)

    lo, hi = np.full(len(target), LO), np.full(len(target), HI)
    at_lo, at_hi = total(lo) <= target, total(hi) >= target
    for _ in range(halvings):
        mid = (lo + hi) / 2
        above = total(mid) > target
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    return np.where(at_lo, LO, np.where(at_hi, HI, (lo + hi) / 2))


def invert_field(theta: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each row, the rating at which its rivals are expected to leave it at its rank."""
    return invert_curve(field_curve(theta, np.ones(len(theta))), rank - 1.0, lambda b: -expected(theta, b))


def _curves(field: DataFrame) -> DataFrame:
    """(contest_id, curve): the sum over a field (contest_id, theta, w), which partitions add up in parts."""

    def parts(batches):
        held: dict[int, np.ndarray] = {}

        def sent():
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([c.ravel() for c in held.values()], pa.list_(pa.float64()))], names=["contest_id", "curve"])

        for b in batches:
            contest, theta, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("contest_id", "theta", "w"))
            for k in np.unique(contest).tolist():
                mine = contest == k
                held[k] = held.get(k, 0) + field_curve(theta[mine], w[mine])
                if len(held) >= HELD:
                    yield from sent()
                    held.clear()
        if held:
            yield from sent()

    def whole(group: pa.Table) -> pa.Table:
        curve = sum(np.asarray(c.values) for c in group["curve"])
        return pa.table({"contest_id": group["contest_id"][:1], "curve": pa.array([curve], pa.list_(pa.float64()))})

    kind = "contest_id long, curve array<double>"
    return field.select("contest_id", "theta", "w").mapInArrow(parts, kind).groupBy("contest_id").applyInArrow(whole, kind)


def _inverted(rows: DataFrame, curves: DataFrame, extra, halvings: int) -> DataFrame:
    """``rows`` (contest_id, target, own, and others) with ``b``, the inverse of the contest's curve and ``extra(own, b)``; HI without a curve.

    A contest's rows are dealt to several tasks by their number.
    """
    kept = [c for c in rows.columns if c not in ("target", "own")]
    salts = rows.groupBy("contest_id").agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts"))
    dealt = rows.join(salts, "contest_id").withColumn("salt", F.pmod(F.xxhash64(*kept), F.col("salts"))).drop("salts")
    meet = curves.join(salts, "contest_id").select(F.col("contest_id").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("part"), "curve")

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left["own"].to_numpy() if left.num_rows else np.empty(0)
        if left.num_rows and right.num_rows:
            curve = right["curve"][0].values.to_numpy(zero_copy_only=False).reshape(2, GRID)
            b = invert_curve(curve, left["target"].to_numpy(), lambda b: extra(own, b), halvings)
        else:
            b = np.full(left.num_rows, HI)
        return pa.table({**{c: left[c] if left.num_rows else pa.array([], kinds[c]) for c in kept}, "b": pa.array(b, pa.float64())})

    from pyspark.sql.pandas.types import to_arrow_type

    fields = [f for f in rows.schema.fields if f.name in kept]
    kinds = {f.name: to_arrow_type(f.dataType) for f in fields}
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return dealt.groupBy("contest_id", "salt").cogroup(meet.groupBy("of", "part")).applyInArrow(each, f"{out}, b double")


def performance_ratings(rows: DataFrame, theta: DataFrame) -> DataFrame:
    """(contest_id, team, row, perf) of rows (contest_id, team, row, rank)."""
    both = rows.join(theta.select("team", "theta"), "team")
    curves = _curves(both.withColumn("w", F.lit(1.0)))
    asked = both.select("contest_id", "team", "row", F.col("theta").alias("own"), (F.col("rank") - 1.0).alias("target"))
    return _inverted(asked, curves, lambda own, b: -expected(own, b), HALVINGS).withColumnRenamed("b", "perf")


def estimate(rows: DataFrame, eps: float | None = 0.5, max_iter: int | None = 100, prior: DataFrame | None = None):
    """(theta, perf, history, converged) from rows (contest_id, team, row, rank).

    ``prior`` (team, mu, strength) anchors teams; others have the neutral mean
    at strength 1.
    """
    par = Parameters(rows.sparkSession, "fixedpoint")
    rows = rows.persist()
    base = team_weights(rows)
    if prior is None:
        base = base.withColumn("mu", F.lit(MU0)).withColumn("strength", F.lit(1.0))
    else:
        base = base.join(prior.select("team", "mu", "strength"), "team", "left").fillna({"mu": MU0, "strength": 1.0})
    base = par.settle("base", base)
    theta = par.settle("theta", base.select("team", F.lit(MU0).alias("theta")))

    def step(_, st):
        total = performance_ratings(rows, st["theta"]).groupBy("team").agg(F.sum("perf").alias("s"))
        new = clip((F.col("w") * F.col("s") + F.col("strength") * F.col("mu")) / (F.col("w") * F.col("n") + F.col("strength")))
        total = total.join(base, "team").join(st["theta"], "team")
        now = par.settle("theta", total.select("team", new.alias("theta"), F.abs(new - F.col("theta")).alias("moved")), "moved")
        return {"theta": now}, par.moved["theta"]

    state, history, converged = repeat(step, {"theta": theta}, max_iter, eps)
    perf = par.scratch.table(performance_ratings(rows, state["theta"]), "perf")
    rows.unpersist()
    return state["theta"], perf, history, converged


def rate_problems(problems: DataFrame, rows: DataFrame, cells: DataFrame, theta: DataFrame) -> DataFrame:
    """(contest_id, label, b): difficulties against the whole kept field of the contest, two phantoms included.

    A contest without a kept field has only unsolved, hence hardest, problems.
    """
    w = team_weights(rows).select("team", "w")
    curves = _curves(rows.join(w, "team").join(theta.select("team", "theta"), "team"))
    solved = cells.join(w, "team").groupBy("contest_id", "label").agg(F.sum(F.col("w") * F.col("y")).alias("s"))
    asked = problems.select("contest_id", "label").join(solved, ["contest_id", "label"], "left")
    asked = asked.select("contest_id", "label", F.lit(0.0).alias("own"), (F.coalesce(F.col("s"), F.lit(0.0)) + SMOOTH).alias("target"))
    return _inverted(asked, curves, lambda _, b: SMOOTH * (expected(HI, b) + expected(LO, b)), 32)
