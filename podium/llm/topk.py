"""Exact top-k by inner product with pivot-table elimination.

Distances from every vector to many pivots are computed beforehand.  By the
triangle inequality the largest difference of two vectors' pivot distances is a
lower bound of their distance, hence with the norms an upper bound of their
inner product.  A query evaluates candidates in the order of that bound and
stops when the next bound is below its k-th score, so results are exact.
Queries meet candidates block by block; blocks have a bounded number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from podium.llm.vectors import lengths, matrix, usable
from podium.plans.scratch import Scratch

K, SCALE, PIVOTS = 5, 256, 32
#: Bounded sample that pivots are chosen from; any pivots give exact results.
PIVOT_SAMPLE = 2_000
CANDIDATE_BLOCK, QUERY_BLOCK, LEAST_BLOCK, WANTED_BLOCKS = 16_384, 8_192, 512, 32

FOUND = "query_row long, query_id long, vec_id long, vec_row long, score long"


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice from a sample."""
    chosen = [int(np.argmax((sample**2).sum(1)))]
    gap = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _scores(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    if exact:  # every partial sum is below 2**53
        return (x @ q).astype(np.int64)
    return x.astype(np.int64) @ q.astype(np.int64)


def search_block(q_rows, q, q_far, c_rows, c_ids, c, c_far, k: int):
    """The k best candidates of a block for each query: (query's place, candidate's place, score).

    ``*_far`` are the pivot tables, pivots by rows; a query's own row is no candidate.
    """
    norms = (c**2).sum(1)
    top = max(np.abs(q).max(initial=0), np.abs(c).max(initial=0))
    exact = top * top * c.shape[1] < 2**53
    out = []
    for i in range(len(q)):
        least = np.abs(q_far[:, i, None] - c_far).max(0)
        q_norm = (q[i] ** 2).sum()
        # rounding of distances is far below this slack
        bound = (q_norm + norms - least**2) / 2 + 1e-7 * (q_norm + norms) + 1e-6
        bound = np.where(c_rows == q_rows[i], -np.inf, bound)
        order = np.argsort(-bound, kind="stable")
        order = order[np.isfinite(bound[order])]
        rows, scores, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 64
        while at < len(order) and (len(rows) < k or bound[order[at]] >= scores[-1]):
            some = order[at : at + step]
            rows, scores = np.concatenate((rows, some)), np.concatenate((scores, _scores(q[i], c[some], exact)))
            best = np.lexsort((c_rows[rows], c_ids[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
            at, step = at + step, step * 2
        out.append((np.full(len(rows), i), rows, scores))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 3


def top_k(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = K, scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates of the highest integer inner product.

    Components become floor(scale * x).  Queries are rows whose id is divisible
    by ``every``; candidates all rows but the query's own, ties going to the
    lesser id.  Rows with a null id, a null or empty vector, or null or
    non-finite components take no part; rows that share an id, or are repeated,
    are queries and candidates of their own, each with its own ranks; vectors of
    unequal length are not compared; with fewer than k candidates all
    are returned; an empty table gives no rows.  Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable("v"))
    ints = scratch.table(rows.select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v")).withColumn("row", F.monotonically_increasing_id()), "ints")
    found = None
    for dim in lengths(ints, "v"):
        own = ints.where(F.size("v") == dim)
        n, n_q = own.agg(F.count("*"), F.count_if(F.col("id") % every == 0)).first()
        if not n_q:
            continue
        near = F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, PIVOT_SAMPLE / n) + 1)
        sample = matrix(own.where(near).select("v").toArrow()["v"])
        sample = sample if len(sample) else matrix(own.limit(1).select("v").toArrow()["v"])
        shared = spark.sparkContext.broadcast(_pivots(sample, pivots))  # at most ``pivots`` rows
        tabled = scratch.table(own.select("row", "id", "v").mapInArrow(_table(shared), "row long, id long, v array<double>, far array<double>"), "pivot_table")
        per = min(CANDIDATE_BLOCK, max(LEAST_BLOCK, n // WANTED_BLOCKS))
        c_blocks, q_blocks = -(-n // per), -(-n_q // QUERY_BLOCK)
        own_names = [F.col(x).alias(x) for x in ("row", "id", "v", "far")]  # the two sides must not share attributes
        c = tabled.select(F.pmod(F.xxhash64("row"), F.lit(c_blocks)).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"), *own_names)
        q = tabled.where(F.col("id") % every == 0).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))).alias("c"), F.pmod(F.xxhash64("row"), F.lit(q_blocks)).cast("int").alias("q"), "row", "id", "v", "far")

        def each(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in ("query_row", "query_id", "vec_id", "vec_row", "score")})
            i, j, score = search_block(left["row"].to_numpy(), matrix(left["v"]), matrix(left["far"]).T, right["row"].to_numpy(), right["id"].to_numpy(), matrix(right["v"]), matrix(right["far"]).T, k)
            return pa.table({"query_row": left["row"].take(pa.array(i)), "query_id": left["id"].take(pa.array(i)), "vec_id": right["id"].take(pa.array(j)), "vec_row": right["row"].take(pa.array(j)), "score": pa.array(score)})

        part = q.groupBy("c", "q").cogroup(c.groupBy("c", "q")).applyInArrow(each, FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _table(shared):
    def each(batches):
        pivots = shared.value
        for b in batches:
            x = matrix(b.column(2))
            if len(x):
                far = np.sqrt(np.maximum(0, ((x[:, None, :] - pivots[None, :, :]) ** 2).sum(2))) if len(x) * pivots.size < 1 << 26 else np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(far), pa.list_(pa.float64()))], names=["row", "id", "v", "far"])

    return each


def op3_pivot_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
