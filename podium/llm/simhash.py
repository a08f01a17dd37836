"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``radius`` bits exactly if some 64-bit value
lies within ``radius / 2`` bits of both.  So every distinct fingerprint emits
all variants within half the radius, and fingerprints that emit a common
variant are links.  Variants are shuffled by their leading bits: a fingerprint
travels once for each variant of its leading bits, and the flips of the other
bits that its remaining distance allows are made where it arrives.  The number
of leading bits follows the number of distinct fingerprints, so that a group
stays small.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from podium.llm.words import give_back, tidy
from podium.plans.components import connected_components
from podium.plans.scratch import Scratch

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Variants that a task holds at a time.
CHUNK = 2_000_000
#: Rows wanted in a group of one prefix, on average.
GROUP_ROWS = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned SimHash of a whole text; 0 where it has no words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII spaces count
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])), ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long): the fingerprint's bits as a signed long."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    @tidy
    def each(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.mapInArrow(each, "id long, fp long")


def _ball(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _ball_size(bits: int, radius: int) -> int:
    return sum(math.comb(bits, r) for r in range(radius + 1))


def prefix_bits(n: int, half: int) -> int:
    """Leading bits by which ``n`` fingerprints are dealt, so that a group has few rows on average."""
    bits = 8
    while bits < 40 and n * _ball_size(bits, half) / 2**bits > GROUP_ROWS:
        bits += 2
    return bits


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Positions of links that join everything the links (a, b) join: at most n - 1."""
    comp, taken = np.arange(n), np.zeros(len(a), bool)
    ids = np.arange(len(a))
    while len(ids):
        ca, cb = comp[a[ids]], comp[b[ids]]
        cross = ca != cb
        ids, ca, cb = ids[cross], ca[cross], cb[cross]
        if not len(ids):
            break
        best = np.full(n, len(a))
        np.minimum.at(best, ca, ids)
        np.minimum.at(best, cb, ids)
        roots = np.flatnonzero(best < len(a))
        e = best[roots]
        taken[e] = True
        other = np.where(comp[a[e]] == roots, comp[b[e]], comp[a[e]])
        up = np.arange(n)
        up[roots] = other
        pair = up[up] == np.arange(n)  # two that chose the same link: the lesser is the root
        up = np.where(pair & (np.arange(n) < up), np.arange(n), up)
        while (up != up[up]).any():
            up = up[up]
        comp = up[comp]
    return np.flatnonzero(taken)


def _collide(fps: np.ndarray, used: np.ndarray, bits: int, half: int, fixed: int = 0):
    """Links among the fingerprints of one group: those that emit a common variant."""
    left = half - used
    counts = np.array([_ball_size(bits, r) for r in range(half + 1)])
    if counts[left].sum() > CHUNK and bits > 4:
        low = np.uint64(bits - 4)
        nibble = ((fps >> low) & np.uint64(15)).astype(np.int64)
        pop = np.array([i.bit_count() for i in range(16)])
        for v in range(16):
            now = used + pop[nibble ^ v]
            keep = now <= half
            if keep.sum() > 1:
                moved = fps[keep] ^ ((nibble[keep] ^ v).astype(np.uint64) << low)
                for x, y in _collide(moved, now[keep], bits - 4, half):
                    at = np.flatnonzero(keep)
                    yield at[x], at[y]
        return
    variants, rows = [], []
    for r in range(half + 1):
        at = np.flatnonzero(left == r)
        if len(at):
            masks = np.array(_ball(bits, r), dtype=np.uint64)
            variants.append((fps[at][:, None] ^ masks[None, :]).ravel())
            rows.append(np.repeat(at, len(masks)))
    v, i = np.concatenate(variants), np.concatenate(rows)
    order = np.argsort(v, kind="stable")
    v, i = v[order], i[order]
    new = np.concatenate(([True], v[1:] != v[:-1]))
    first = i[np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))]
    hit = ~new & (first != i)
    yield first[hit], i[hit]


def links(fps: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(src, dst): enough of the pairs of distinct fingerprints within ``radius`` to join all that are linked.

    ``radius`` is even: links are thinned among all pairs that emit a common
    variant, which for an odd radius would hold pairs one bit further apart.
    """
    if radius % 2:
        raise ValueError("an odd radius is not supported")
    half = radius // 2
    bits = prefix_bits(n, half)
    masks = _ball(bits, half)
    head = F.shiftrightunsigned("fp", 64 - bits)
    dealt = fps.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("flip")).select(
        head.bitwiseXOR(F.col("flip")).alias("prefix"), "fp", F.bit_count("flip").alias("used")
    )

    def each(group: pa.Table) -> pa.Table:
        fp = group["fp"].to_numpy().view(np.uint64)
        used = group["used"].to_numpy().astype(np.int64)
        tail = fp & np.uint64((1 << (64 - bits)) - 1)
        a, b = [], []
        if len(fp) > 1:
            for x, y in _collide(tail, used, 64 - bits, half):
                key = np.unique(np.minimum(x, y) * len(fp) + np.maximum(x, y))
                x, y = key // len(fp), key % len(fp)
                keep = _forest(x, y, len(fp))
                a.append(x[keep])
                b.append(y[keep])
        if a:
            x, y = np.concatenate(a), np.concatenate(b)
            keep = _forest(x, y, len(fp))
            a, b = fp[x[keep]].view(np.int64), fp[y[keep]].view(np.int64)
        give_back()
        return pa.table({"src": pa.array(np.array(a, np.int64)), "dst": pa.array(np.array(b, np.int64))})

    found = dealt.groupBy("prefix").applyInArrow(each, "src long, dst long")
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _roots(fps: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(fp, root): each distinct fingerprint's component, named by one of its fingerprints."""
    distinct = scratch.table(fps.select("fp").distinct(), "distinct")
    comps = connected_components(scratch.table(links(distinct, distinct.count(), radius), "links"))
    return scratch.table(distinct.join(comps, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root")), "roots")


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id): documents linked by fingerprints at ``radius`` or fewer differing bits.

    ``component_id`` is the least id reachable.  Null and wordless texts have
    fingerprint zero and link like any other; repeated rows, and rows that share
    an id, are returned as often as they come, each with its own text's group; a
    null id is never a component's name, and a component of null ids alone has
    none; an empty table gives no rows.  Other columns are not read.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    docs = scratch.table(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    least = docs.groupBy("fp").agg(F.min("id").alias("least"))
    labelled = scratch.table(least.join(_roots(docs, radius, scratch), "fp"), "labelled")
    named = scratch.table(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    of_fp = scratch.table(labelled.join(named, "root").select("fp", "component_id"), "of_fp")
    return docs.join(of_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``df`` with one row of each group of ``simhash_groups``: that of the least id, null ids last.

    Rows are told apart by themselves, so of rows that share an id each stays or
    goes with its own group; of equal ids in one group one row stays.  Columns of
    any name may be there besides; an empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "near-copies")
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = scratch.table(df.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    ident, text = (names[df.columns.index(c)] for c in (id_col, text_col))
    # a row's number stands for its id here
    fps = scratch.table(fingerprints(rows, "row", text, shingle), "fingerprints")
    order = F.struct(F.col(ident).isNull(), F.col(ident), F.col("row"))
    of_row = fps.withColumnRenamed("id", "row").join(rows.select("row", order.alias("first")), "row")
    first = of_row.groupBy("fp").agg(F.min("first").alias("first"))
    kept = first.join(_roots(fps, radius, scratch), "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = scratch.table(kept.select(F.col("first.row").alias("row")), "kept")
    # numbers are much smaller than the texts, which need not be sorted
    return rows.join(kept.hint("shuffle_hash"), "row", "left_semi").select(*names).toDF(*df.columns)


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
