"""The driver loop shared by all estimators."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from podium.plans.scratch import Scratch

#: Parameter tables of up to so many rows come back as local tables; larger ones as scratch tables.
LOCAL_ROWS = 200_000
#: A fit without a number of steps is given up when its least change hasn't fallen for so many.
STALLED = 1_000


class Parameters:
    """Holds the parameter tables of a fit between iterations, so that plans never grow."""

    def __init__(self, spark: SparkSession, label: str, local_rows: int = LOCAL_ROWS) -> None:
        self.spark, self.scratch, self.local_rows = spark, Scratch(spark, label), local_rows
        self._small: dict[str, bool] = {}
        self._held: dict[str, DataFrame] = {}
        #: the greatest move of each table's parameters when it was last settled
        self.moved: dict[str, float] = {}

    def settle(self, name: str, df: DataFrame, moved: str | None = None) -> DataFrame:
        """Compute a table once.  Its size is looked at the first time; the number of parameters never changes.

        ``moved`` names a column of how far each parameter has moved, which is
        reduced to its maximum on the way.
        """
        if name not in self._small:
            table = self.scratch.table(df, name)
            self._small[name] = table.count() <= self.local_rows
        elif not self._small[name]:
            table = self.scratch.table(df, name)
        else:
            table = df
        if self._small[name]:
            local = table.toArrow()
            if moved is not None:
                self.moved[name] = pc.max(local[moved]).as_py() or 0.0
                local = local.drop_columns([moved])
            return self.spark.createDataFrame(local, table.drop(*([moved] if moved else [])).schema)
        if moved is not None:
            self.moved[name] = table.agg(F.max(moved)).first()[0] or 0.0
        # the step before last is read by nothing any more
        self.scratch.drop(self._held.pop(f"{name}-", None))
        if name in self._held:
            self._held[f"{name}-"] = self._held[name]
        self._held[name] = table
        return table.drop(moved) if moved else table


def repeat(step: Callable[[int, dict], tuple[dict, float | None]], state: dict, max_iter: int | None, eps: float | None) -> tuple[dict, list[float], bool]:
    """Run ``step`` until its change is below ``eps`` or ``max_iter`` times: (state, changes, converged).

    With ``eps`` None the number of steps is fixed and no change is asked for.
    With ``max_iter`` None it is as many as are needed; changes may rise on the
    way, so only a fit that is stalled ends without having converged.
    """
    if max_iter is None and eps is None:
        raise ValueError("a fit needs max_iter or eps")
    history: list[float] = []
    least = 0
    for it in itertools.count() if max_iter is None else range(max_iter):
        state, delta = step(it, state)
        if eps is not None and delta is not None:
            history.append(delta)
            if delta < eps:
                return state, history, True
            if delta < history[least]:
                least = len(history) - 1
            if max_iter is None and len(history) - 1 - least >= STALLED:
                break
    return state, history, False
