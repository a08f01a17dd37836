"""Sharding by histogram sort, in DataFrame operations only.

Rows are ordered by (hash of the text, id, row), so equal texts are neighbours.
Counts of rows and exact weights below candidate key boundaries are taken over
all partitions; leaves of the histogram that hold a wanted splitter, or too
many rows, are probed again with longer prefixes until they are fine enough.
A row then finds its leaf as the probes did, round by round; the leaf fixes its
shard and the place where the leaf starts, and one exchange by leaf numbers the
rows.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, Window, functions as F

from podium.plans.scratch import Scratch

FIRST_DIGITS = 3
#: Leaves of so few rows are numbered in one task as they are.
LEAST_ROWS = 1024


def _probe(meta: DataFrame, prefixes: list[str] | None, digits: int) -> list[tuple]:
    """(leaf, rows, weight, least and greatest key) below each prefix of ``digits`` hex digits, within ``prefixes``."""
    if prefixes is not None:
        # all prefixes of one call are of one length
        meta = meta.where(F.substring("key", 1, len(prefixes[0])).isin(prefixes))
    got = meta.groupBy(F.substring("key", 1, digits).alias("leaf")).agg(
        F.count("*").alias("n"), F.sum("weight").alias("w"), F.min("key").alias("low"), F.max("key").alias("high")
    )
    return [tuple(r) for r in got.collect()]


def _cuts(leaves: list[tuple], n_shards: int) -> list[float]:
    total = sum(x[2] for x in leaves)
    return [total * i / n_shards for i in range(1, n_shards)]


def _histogram(meta: DataFrame, n_shards: int, tolerance: float, rows_per_leaf: float) -> tuple[list[tuple], list[dict[str, int]]]:
    """Leaves in key order, refined until splitters meet the tolerance; and for each round the leaves split, with their children's length.

    A leaf is probed again one digit beyond what all its keys share.  At most
    16**3 + 15 * (splitters + 1 / rows_per_leaf) leaves a round are held on the
    driver, whatever the number of rows.
    """
    leaves, splits = _probe(meta, None, FIRST_DIGITS), []
    total_n, total_w = sum(x[1] for x in leaves), sum(x[2] for x in leaves)
    fine_w, fine_n = total_w / n_shards * tolerance, max(LEAST_ROWS, total_n * rows_per_leaf)
    while True:
        leaves.sort()
        cuts, at, below, coarse = _cuts(leaves, n_shards), 0, 0, []
        for leaf, n, w, low, high in leaves:
            while at < len(cuts) and cuts[at] <= below:
                at += 1
            holds = at < len(cuts) and below < cuts[at] < below + w
            below += w
            if n > 1 and (n > fine_n or (holds and w > fine_w)):
                coarse.append((leaf, os.path.commonprefix([low, high])))
        if not coarse:
            return leaves, splits
        splits.append({leaf: len(shared) + 1 for leaf, shared in coarse})
        gone = {leaf for leaf, _ in coarse}
        leaves = [x for x in leaves if x[0] not in gone]
        by_len: dict[int, list[str]] = {}
        for _, shared in coarse:
            by_len.setdefault(len(shared), []).append(shared)
        for length, group in by_len.items():
            leaves += _probe(meta, group, length + 1)


def _place(leaves: list[tuple], n_shards: int) -> list[tuple[str, int, int]]:
    """(leaf, shard, first slot): a cut goes to the nearest leaf edge."""
    cuts, out, low, shard, first = _cuts(leaves, n_shards), [], 0, 0, 0
    for leaf, n, w, _, _ in leaves:
        while shard < n_shards - 1 and low + w / 2 > cuts[shard]:
            shard, first = shard + 1, 0
        out.append((leaf, shard, first))
        low, first = low + w, first + n
    return out


def _local(spark, rows: list[dict], fields: str) -> DataFrame:
    """Rows of the driver as a table, without Python workers."""
    kind = "array<struct<" + ", ".join(f.strip().replace(" ", ":") for f in fields.split(",")) + ">>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def shards(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 40, law: str = "bytes",
    tolerance: float = 1 / 256, overhead: int = 16, rows_per_leaf: float = 1 / 2048,
) -> DataFrame:
    """Deal all rows into ``n_shards`` shards, near equal in bytes or rows.

    law ``bytes``: the UTF-8 bytes of the texts plus ``overhead`` a row are near
    equal (within ``tolerance`` of a shard, or one row if a row is larger);
    ``rows``: row counts are equal within one.  Returns (id, size, text_crc32,
    law, shard, slot); slots run from 0 without gaps in each shard.

    A null text has size ``overhead`` and CRC 0; null ids sort as their own
    value; repeated rows each get a slot of their own; a text too long for a
    shard fills one alone; an empty table gives no rows.  Other columns are not
    read.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law!r}")
    spark = df.sparkSession
    scratch = Scratch(spark, "shards")
    text, ident = F.col(text_col), F.col(id_col)
    hex16 = lambda c: F.lpad(F.hex(c), 16, "0")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")
    meta = scratch.table(
        df.select(
            ident.alias("id"),
            size.alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
            F.concat(hex16(F.xxhash64(text)), hex16(F.coalesce(ident.cast("long"), F.lit(-1))), hex16(F.monotonically_increasing_id())).alias("key"),
            (size if law == "bytes" else F.lit(1).cast("long")).alias("weight"),
        ),
        "meta",
    )
    leaves, splits = _histogram(meta, n_shards, tolerance if law == "bytes" else 0.0, rows_per_leaf)
    # tables of at most as many rows as the driver holds leaves, with one row for each key
    in_leaf = meta.withColumn("leaf", F.substring("key", 1, FIRST_DIGITS))
    for split in splits:
        deeper = _local(spark, [{"of": leaf, "digits": digits} for leaf, digits in split.items()], "of string, digits int")
        in_leaf = in_leaf.join(F.broadcast(deeper), F.col("leaf") == F.col("of"), "left")
        in_leaf = in_leaf.withColumn("leaf", F.when(F.col("of").isNull(), F.col("leaf")).otherwise(F.expr("substring(key, 1, digits)"))).drop("of", "digits")
    placed = _local(spark, [{"leaf": leaf, "shard": shard, "first": first} for leaf, shard, first in _place(leaves, n_shards)], "leaf string, shard int, first bigint")
    in_leaf = in_leaf.join(F.broadcast(placed), "leaf")
    nth = F.row_number().over(Window.partitionBy("leaf").orderBy("key")) - 1
    return in_leaf.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit(law).alias("law"), "shard",
        (F.col("first") + nth).cast("long").alias("slot"),
    )


def op9_histogram_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shards(docs).withColumn("grown_shard", F.lit(None).cast("int"))
