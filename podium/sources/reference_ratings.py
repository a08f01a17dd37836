"""The built-in table of outside ratings that calibration anchors on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Contest, problem name and official rating.
RATINGS = (
    (3747, "Compare Suffixes", 3500), (3747, "Subtree Removal Game", 2500), (3747, "Upside Down Dijkstra", 2200), (3747, "Christmas Tree Un-decoration", 2600),
    (3747, "Parallel Sums", 2500), (3747, "Minesweeper String", 2400), (3747, "Extra Transition", 3100), (3747, "Growth Factor", 2900), (3747, "Reflect Sort", 1800),
    (3747, "Worldwide Playlist", 1700), (3747, "Time Display Stickers", 1300), (3747, "Onion", 3500), (3747, "Deformed Balance", 2900),
    (2785, "Alphabet City", 1300), (2785, "Battle of Arrays", 1400), (2785, "Cacti Classification", 3200), (2785, "Doorway", 2000), (2785, "Elevator Against Humanity", 2900),
    (2785, "Fragmented Nim", 1600), (2785, "Greta's Game", 2400), (2785, "Honey Cake", 1200), (2785, "Irrigation Interlock", 3500), (2785, "Jinx or Jackpot", 2300),
    (2785, "Knit the Grid", 3500), (2785, "LLM Training", 2800), (2785, "Medical Parity", 1700),
    (2657, "ASCII Art Contest", 800), (2657, "Buses", 1800), (2657, "Circles Are Far from Each Other", 3100), (2657, "Divisor Card Game", 3100), (2657, "Number Maze", 1200),
    (2657, "Cluster Computing System", 1600), (2657, "Gene Editor", 3300), (2657, "Shuffling Cards with Problem Solver 68!", 2500), (2657, "Birthday", 2000),
    (2657, "Sliding Tiles", 2300), (2657, "Kindergarten Homework", 2100), (2657, "Maximum Color Segment", 2300), (2657, "Maximum Distance To Port", 1300), (2657, "New Kingdom", 2800),
)


def reference_ratings(spark: SparkSession) -> DataFrame:
    """(contest_id, name, rating) of the built-in anchors."""
    return spark.createDataFrame(RATINGS, "contest_id long, name string, rating int")
