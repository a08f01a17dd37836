"""Standings-shaped views over business tables.

V1: a contest is a month of orders, a team a customer, a problem a supplier
group; solved means a returned line.  V2: a contest is a day of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v1_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contest_id, team, label, y, tau) of all rows; tau is null where unsolved."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("team"), "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 8).alias("label"), "l_returnflag", "l_shipdate")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    solved = F.col("l_returnflag") == "A"
    tau = F.pmod(F.datediff("l_shipdate", "o_orderdate"), F.lit(300)) * 60
    contest = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long")
    return j.groupBy(contest.alias("contest_id"), "team", "label").agg(F.max(solved.cast("int")).alias("y"), F.min(F.when(solved, tau)).cast("double").alias("tau"))


def v1_rows(cells: DataFrame) -> DataFrame:
    """(contest_id, team, rank, solved, penalty) of all rows, ranked by solved, then total time."""
    r = cells.groupBy("contest_id", "team").agg(F.sum("y").alias("solved"), F.coalesce(F.sum("tau"), F.lit(0.0)).alias("penalty"))
    return r.withColumn("rank", F.rank().over(Window.partitionBy("contest_id").orderBy(F.desc("solved"), "penalty")))


def v1_identity(rows: DataFrame) -> DataFrame:
    """Rows with made-up account ids and rosters: some accounts are local to a contest, some rosters shared or short."""
    t = F.col("team")
    team_id = F.when(t % 5 == 0, F.concat(F.lit("$DEFAULT_"), (t % 7).cast("string"))).otherwise(F.concat(F.lit("acc-"), t.cast("string")))
    half = F.floor(t / 2).cast("string")
    members = F.when(t % 3 == 0, F.lit(None)).when(t % 11 == 0, F.array(F.concat(F.lit("m"), t.cast("string")))).otherwise(F.array(F.concat(F.lit("b"), half), F.concat(F.lit("a"), half)))
    return rows.select("*", team_id.alias("team_id"), members.alias("members"))


def v1_contests(cells: DataFrame) -> DataFrame:
    """(contest_id, contest_name, year, region): names of every sixth month are finals; every ninth year is null."""
    c = cells.select("contest_id").distinct()
    month, year = F.col("contest_id") % 100, F.floor(F.col("contest_id") / 100).cast("int")
    name = F.when(month % 6 == 0, F.concat(F.lit("World Finals "), year.cast("string"))).otherwise(F.concat(F.lit("Round "), F.col("contest_id").cast("string")))
    region = F.element_at(F.array(*map(F.lit, ("North", "South", "East", "West", "Centre"))), (F.col("contest_id") % 5 + 1).cast("int"))
    return c.select("contest_id", name.alias("contest_name"), F.when(F.col("contest_id") % 9 != 0, year).alias("year"), region.alias("region"))


def v2_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contest_id, team, label, y, tau) of the events table."""
    e = table(spark, sf_dir, "events")
    hit = F.col("value") >= 35
    sec = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts").cast("int")
    contest = (F.year("ts") * 10000 + F.month("ts") * 100 + F.dayofmonth("ts")).cast("long")
    return e.groupBy(contest.alias("contest_id"), F.col("user_id").alias("team"), F.col("event_type").alias("label")).agg(F.max(hit.cast("int")).alias("y"), F.min(F.when(hit, sec)).cast("double").alias("tau"))
