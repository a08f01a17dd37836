"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Equal vectors are brought down to one with a count.  A vector is at home in the
cell of its nearest centroid.  Two linked vectors with different homes lie on
either side of the plane halfway between these centroids and are at most
``sqrt(2 - 2 * threshold)`` apart, so one of them is within half of that of the
plane; it is a guest in the other's cell.  Each cell compares those at home with
all it holds, so no link is lost, whatever the vectors.  Cells larger than a
block are compared block by block, so that a hot cell is many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from podium.llm.simhash import _forest
from podium.llm.vectors import lengths, matrix, usable
from podium.plans.components import connected_components
from podium.plans.scratch import Scratch

THRESHOLD = 0.95
#: Documented bounds: rows that centroids are fitted on, and cells.
FIT_ROWS, MAX_CELLS, PER_CELL = 20_000, 4_096, 2_048
BLOCK = 2_048

MADE = "id long, links long, other long"


def fit_cells(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of spherical k-means on unit rows, from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _visits(near: np.ndarray, home: np.ndarray, centroids: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a vector is a guest of (or at home in) each cell; ``near`` are its cosines with the centroids."""
    apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))
    gap = near[np.arange(len(near)), home][:, None] - near
    return gap <= np.sqrt(max(0.0, 2 - 2 * threshold)) / 2 * apart[home] + 1e-9


def _assign(shared, threshold: float):
    """(id, m, home, cells, v) with v of unit length."""

    def each(batches):
        c = shared.value
        for b in batches:
            if b.num_rows:
                x = _unit(matrix(b.column(2)))
                near = x @ c.T
                home = near.argmax(1)
                cells = [np.flatnonzero(row).astype(np.int32) for row in _visits(near, home, c, threshold)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(home.astype(np.int32)), pa.array(cells, pa.list_(pa.int32())), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "m", "home", "cells", "v"])

    return each


def _compare(shared, threshold: float):
    """Links of a block of those at home (side 0) with a block of all in the cell (side 1)."""

    def each(key, group):
        centroids, cell = shared.value, key[0].as_py()
        side = group["side"].to_numpy()
        ids, m, home, x = group["id"].to_numpy(), group["m"].to_numpy(), group["home"].to_numpy(), matrix(group["v"])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        links = np.zeros(len(ids), np.int64)
        place = {int(i): n for n, i in enumerate(np.unique(ids).tolist())}
        node = np.array([place[int(i)] for i in ids], np.int64)
        a, b = [], []
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            i, j = np.nonzero(x[rows] @ x[right].T >= threshold)
            i, j = rows[i], right[j]
            # a pair that two cells see counts once: both at home here by the order of ids, else in the lesser cell that sees it
            same = home[j] == cell
            seen_there = np.zeros(len(i), bool)
            if not same.all():
                some = np.unique(i)
                seen = _visits(x[some] @ centroids.T, home[some], centroids, threshold)
                seen_there = seen[np.searchsorted(some, i), home[j]]
            use = np.where(same, ids[i] < ids[j], (home[j] > cell) | ~seen_there)
            i, j = i[use], j[use]
            np.add.at(links, i, m[j])
            np.add.at(links, j, m[i])
            if len(i):
                keep = _forest(node[i], node[j], len(place))
                a.append(i[keep])
                b.append(j[keep])
        some = np.flatnonzero(links)
        out_id, out_n = [ids[some]], [links[some]]
        out_o = [np.full(len(some), -1)]
        valid = [np.zeros(len(some), bool)]
        if a:
            i, j = np.concatenate(a), np.concatenate(b)
            keep = _forest(node[i], node[j], len(place))
            out_id.append(ids[i[keep]])
            out_n.append(np.zeros(len(keep), np.int64))
            out_o.append(ids[j[keep]])
            valid.append(np.ones(len(keep), bool))
        return pa.table({"id": pa.array(np.concatenate(out_id)), "links": pa.array(np.concatenate(out_n)), "other": pa.array(np.concatenate(out_o), mask=~np.concatenate(valid))})

    return each


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component_id, kept) for every row, by cosine of ``threshold`` or more in double precision.

    ``n_links`` counts the other vectors linked directly, equal ones included;
    ``component_id`` is the least id reachable, itself included; one row per
    component is kept.  Rows that share an id are vectors of their own.  Rows
    whose vector is null, empty, all zero or holds null
    or non-finite components link with nothing, nor do rows with a null id
    (their component is null); vectors of unequal length never link; an empty
    table gives no rows.  Other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "embed-dedup")
    every = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.col("id").isNotNull() & usable("v") & F.exists("v", lambda x: x != 0)
    keyed = scratch.table(every.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("v", F.when(F.col("fine"), F.col("v"))), "rows")
    group = [F.size("v").alias("dim"), F.xxhash64("v").alias("k1"), F.sha1(F.concat_ws(",", F.col("v").cast("array<string>"))).alias("k2")]
    rows = keyed.where("fine").select("id", "v", *group)
    reps = scratch.table(rows.groupBy("dim", "k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v")).withColumn("key", F.monotonically_increasing_id()), "distinct")
    made = None
    for dim in lengths(reps, "v"):
        own = reps.where(F.col("dim") == dim).select(F.col("key").alias("id"), "m", "v")
        n = own.count()
        drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, FIT_ROWS / n) + 1)
        sample = _unit(matrix(own.where(drawn).orderBy("id").select("v").toArrow()["v"]))
        k = max(1, min(MAX_CELLS, n // PER_CELL, len(sample) // 8))
        shared = spark.sparkContext.broadcast(fit_cells(sample, k) if len(sample) else np.zeros((1, dim)))
        placed = scratch.table(own.mapInArrow(_assign(shared, threshold), "id long, m long, home int, cells array<int>, v array<double>"), "placed")
        held = placed.select("id", "m", "home", F.explode("cells").alias("cell"), "v")
        # blocks of those at home and of all in each cell: at most MAX_CELLS counts come to the driver
        sizes = {r["cell"]: (r["h"], r["n"]) for r in held.groupBy("cell").agg(F.count_if(F.col("home") == F.col("cell")).alias("h"), F.count("*").alias("n")).collect()}
        n_blocks = lambda at: F.element_at(F.array(*[F.lit(max(1, -(-sizes.get(c, (1, 1))[at] // BLOCK))) for c in range(k)]), F.col("cell") + 1)
        held = held.withColumn("rows", n_blocks(0)).withColumn("cols", n_blocks(1))
        block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = held.where("home = cell").select("cell", block("rows").alias("i"), all_("cols").alias("j"), F.lit(0).alias("side"), "id", "m", "home", "v")
        right = held.select("cell", all_("rows").alias("i"), block("cols").alias("j"), F.lit(1).alias("side"), "id", "m", "home", "v")
        part = left.unionByName(right).groupBy("cell", "i", "j").applyInArrow(_compare(shared, threshold), MADE)
        made = part if made is None else made.unionByName(part)
    made = scratch.table(made if made is not None else spark.createDataFrame([], MADE), "links")
    counts = made.groupBy("id").agg(F.sum("links").alias("links"))
    comps = connected_components(made.where("other is not null"), "id", "other")
    labelled = scratch.table(reps.select("dim", "k1", "k2", "rep", "m", "key").join(comps, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("component", "key")), "labelled")
    named = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_rep = scratch.table(
        labelled.join(named, "root").join(counts, F.col("key") == counts["id"], "left")
        .select("dim", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"),
        "of_rep",
    )
    linked = rows.select("id", "dim", "k1", "k2").join(of_rep, ["dim", "k1", "k2"]).select(F.col("id").alias(id_col), "n_links", "component_id")
    alone = keyed.where("not fine").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op5_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
