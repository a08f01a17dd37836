"""Flattening standings into long, sparse tables of rows, problems and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed value: the contest length where nothing was solved, in seconds.
DEFAULT_LENGTH = 18_000.0


def max_solve_seconds(standings: Column) -> Column:
    """The latest solve of a contest's standings, 0 without any; times of 0 or null do not count."""
    cells = F.flatten(F.transform(standings, lambda s: F.coalesce(F.map_values(s["problems"]), F.array().cast("array<struct<solved:boolean,score:double,time_seconds:double,wrong_attempts:int>>"))))
    times = F.transform(F.filter(cells, lambda c: F.coalesce(c["solved"], F.lit(False))), lambda c: F.coalesce(c["time_seconds"], F.lit(0.0)))
    return F.coalesce(F.array_max(times), F.lit(0.0))


def short_contests_out(contests: DataFrame, min_hours: float | None) -> DataFrame:
    """Contests whose latest solve is at ``min_hours`` or later; all without a minimum."""
    return contests if min_hours is None else contests.where(max_solve_seconds(F.col("standings")) >= min_hours * 3600)


def solved_any(problems: Column) -> Column:
    """Whether a standing has a solved cell; false for a null map."""
    return F.coalesce(F.exists(F.map_values(problems), lambda c: F.coalesce(c["solved"], F.lit(False))), F.lit(False))


def problem_table(contests: DataFrame) -> DataFrame:
    """(contest_id, label, problem_id, name, reported, difficulty_estimate); the first of a label wins, a missing count is -1."""
    p = contests.select("contest_id", F.posexplode("problems").alias("pos", "p"))
    w = Window.partitionBy("contest_id", "label").orderBy("pos")
    p = p.select("contest_id", "pos", F.col("p.problem_label").alias("label"), F.col("p.problem_id").alias("problem_id"), F.col("p.problem_name").alias("name"), F.coalesce("p.problem_solved_in_contest", F.lit(-1)).alias("reported"), F.col("p.difficulty_estimate").alias("difficulty_estimate"))
    return p.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "pos")


def row_table(contests: DataFrame, all_rows: bool = False) -> DataFrame:
    """(contest_id, row, rank, team_id, team_name, affiliation, members, total_solved, problems); rows without a solve are left out."""
    s = contests.select("contest_id", F.posexplode("standings").alias("row", "s")).select("contest_id", "row", "s.*")
    if all_rows:
        return s
    kept = s.where(solved_any(F.col("problems")))
    return kept.withColumn("rank", F.when(F.col("rank").isNull(), F.raise_error(F.lit("a kept row has no rank")).cast("int")).otherwise(F.col("rank")))


def cell_table(rows: DataFrame, problems: DataFrame) -> DataFrame:
    """(contest_id, row, label, y, tau): cells of kept rows whose label is in the problem list."""
    c = rows.select("contest_id", "row", F.explode("problems").alias("label", "c"))
    y = F.coalesce(F.col("c.solved"), F.lit(False))
    tau = F.when(y & F.col("c.time_seconds").isNull(), F.raise_error(F.lit("a solved cell has no time")).cast("double")).when(y, F.col("c.time_seconds"))
    return c.join(problems.select("contest_id", "label"), ["contest_id", "label"]).select("contest_id", "row", "label", y.cast("int").alias("y"), tau.alias("tau"))


def kept_cells(cells: DataFrame) -> DataFrame:
    """Cells (contest_id, team, label, y, tau) of rows with at least one solve."""
    some = cells.groupBy("contest_id", "team").agg(F.max("y").alias("_any")).where("_any = 1").drop("_any")
    return cells.join(some, ["contest_id", "team"], "left_semi")


def exposure(cells: DataFrame) -> DataFrame:
    """Adds ``rho``: the share of the contest's length that a cell was exposed; 1 where unsolved."""
    length = cells.groupBy("contest_id").agg(F.max(F.when(F.col("y") == 1, F.col("tau"))).alias("_t"))
    length = length.select("contest_id", F.when(F.col("_t") > 0, F.col("_t")).otherwise(F.lit(DEFAULT_LENGTH)).alias("length"))
    return cells.join(length, "contest_id").withColumn("rho", F.when(F.col("y") == 1, F.col("tau") / F.col("length")).otherwise(F.lit(1.0)))


def solve_counts(cells: DataFrame) -> DataFrame:
    """(contest_id, label, field, solved, rate) of every problem."""
    return cells.groupBy("contest_id", "label").agg(F.count("*").alias("field"), F.sum("y").alias("solved")).withColumn("rate", F.try_divide("solved", "field"))
