"""Exports: viewer tables, records, HTML pages, calibrated ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from podium.functions import metrics
from podium.functions.rating import clip
from podium.functions.text import or_default
from podium.plans.ranks import numbered
from podium.plans.scratch import Scratch
from podium.sources.standings import write_records

#: Fixed value: where a page's data goes.
MARK = "/*__DATA__*/null"
PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>%s</title></head><body><table id="t"></table><script>
const data = /*__DATA__*/null, keys = data.length ? Object.keys(data[0]) : [];
const table = document.getElementById("t");
for (const row of [Object.fromEntries(keys.map(k => [k, k])), ...data]) {
  const tr = table.insertRow();
  for (const k of keys) tr.insertCell().textContent = row[k];
}
</script></body></html>"""


def apply_calibration(ratings: DataFrame, anchors: DataFrame, x: str, y: str) -> DataFrame:
    """Adds ``calibrated`` (clipped) and ``calibrated_se`` from the affine fit of the anchors."""
    slope, inter = metrics.affine(x, y)
    fit = anchors.agg(slope.alias("_a"), inter.alias("_c"))
    return ratings.join(F.broadcast(fit)).select("*", clip(F.col("_a") * F.col(x) + F.col("_c")).alias("calibrated"), (F.col("_a") * F.col("se")).alias("calibrated_se")).drop("_a", "_c")


def contest_list(contests: DataFrame, rows: DataFrame) -> DataFrame:
    """(contest_id, name, year, region, teams, mean_theta, place): newest first, then by name."""
    means = rows.groupBy("contest_id").agg(F.count("*").alias("teams"), F.round(F.avg("theta"), 0).alias("mean_theta"))
    ordered = numbered(contests.join(means, "contest_id"), [F.coalesce("year", F.lit(0)).desc(), F.col("contest_name"), F.col("contest_id")], "place")
    return ordered.select("contest_id", F.col("contest_name").alias("name"), or_default(F.col("year").cast("string"), "?").alias("year"), "region", "teams", "mean_theta", "place")


def viewer_bundle(contests: DataFrame, problems: DataFrame, teams: DataFrame) -> DataFrame:
    """(contest_id, json): a contest with its problems by label and its teams by rank, as one JSON object a row."""
    p = problems.groupBy("contest_id").agg(F.array_sort(F.collect_list(F.struct("label", *[c for c in problems.columns if c not in ("contest_id", "label")]))).alias("problems"))
    t = teams.groupBy("contest_id").agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in teams.columns if c not in ("contest_id", "rank")]))).alias("teams"))
    both = contests.join(p, "contest_id", "left").join(t, "contest_id", "left")
    return both.select("contest_id", F.to_json(F.struct(*both.columns)).alias("json"))


def round_trip(df: DataFrame) -> DataFrame:
    """Records written to the scratch folder and read back."""
    path = Scratch(df.sparkSession, "records").root
    write_records(df, path)
    return df.sparkSession.read.schema(df.schema).json(path)


def html_page(df: DataFrame, title: str) -> DataFrame:
    """(html): a page with the rows embedded as JSON.  For reports of a size that a browser can show."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("j"))
    data = rows.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("j")), ","), F.lit("]")).alias("d"))
    safe = F.replace("d", F.lit("</"), F.lit("<\\/"))
    head, tail = (PAGE % title).split(MARK)
    return data.select(F.concat(F.lit(head), safe, F.lit(tail)).alias("html"))
