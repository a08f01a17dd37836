"""Reading and writing: contest standings and the auxiliary inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from podium.functions.text import contest_of_url, norm_alnum

#: The standings format.
CELL = "struct<solved:boolean,score:double,time_seconds:double,wrong_attempts:int>"
CONTEST = (
    "contest_id long, contest_name string, contest_url string, year int, region string, editorial string, editorial_url string, "
    "problems array<struct<problem_label:string,problem_id:string,problem_name:string,problem_solved_in_contest:int,difficulty_estimate:string>>, "
    f"standings array<struct<rank:int,team_id:string,team_name:string,affiliation:string,members:array<string>,total_solved:int,problems:map<string,{CELL}>>>"
)


def scan_contests(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    """Contests of several JSON files (each one array, or a contest a line), with ``file_ord`` and ``pos`` for their order."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    for n, path in enumerate(paths):
        one = spark.read.schema(CONTEST).option("multiLine", not lines).json(path)
        parts.append(one.withColumn("file_ord", F.lit(n)).withColumn("pos", F.monotonically_increasing_id()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cf_problemset(spark: SparkSession, path: str) -> DataFrame:
    """(contest, key, rating) of a cached problem set; unrated problems are left out, the last of a key wins."""
    raw = spark.read.schema("contestId long, name string, rating int").option("multiLine", True).json(path)
    keyed = raw.where("rating is not null").select(F.col("contestId").alias("contest"), norm_alnum("name").alias("key"), "rating", F.monotonically_increasing_id().alias("pos"))
    return keyed.groupBy("contest", "key").agg(F.max_by("rating", "pos").alias("rating"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(contest) of each line that names one."""
    return spark.read.text(path).select(contest_of_url("value").alias("contest")).where("contest is not null")


def kattis_map(spark: SparkSession, path: str) -> DataFrame:
    """(key, difficulty) of a {id: {name, difficulty}} file; the last of a name wins."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,struct<name:string,difficulty:double>>").alias("m"))
    rows = raw.select(F.posexplode(F.map_values("m")).alias("pos", "v"))
    return rows.groupBy(norm_alnum(F.col("v.name")).alias("key")).agg(F.max_by(F.col("v.difficulty"), "pos").alias("difficulty"))


def ratings(spark: SparkSession, models: dict[str, str]) -> DataFrame:
    """Stored ratings of several models, with the model's name; models without a file are left out."""
    out = None
    jvm = spark._jvm
    for name, path in models.items():
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            continue
        one = spark.read.json(path).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no ratings in {sorted(models.values())}")
    return out


def write_records(df: DataFrame, path: str) -> None:
    """Records as JSON lines, a file a partition."""
    df.write.mode("overwrite").json(path)


def dedupe_contests(raw: DataFrame) -> DataFrame:
    """The first entry of each contest, in the order of files and entries."""
    w = Window.partitionBy("contest_id").orderBy("file_ord", "pos")
    return raw.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
