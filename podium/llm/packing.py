"""Best-fit packing of token sequences by bin completion.

Only lengths matter for packing, and there are no more lengths than the
capacity, so the corpus is reduced to a histogram of piece lengths.  The search
runs on that histogram, whose size no input can change, and finds patterns (the
lengths in a bin, and how many bins are filled so): around the largest piece
left it enumerates all undominated fillings, and gives up a branch whose waste
is more than a better solution could have.  A best-fit-decreasing
solution is the first incumbent.  Pieces are then numbered within their length
in Spark and find their sequence and offset from their number.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from podium.llm.words import WordIds, blocks, default_path, tidy
from podium.plans.scratch import Scratch

CAPACITY, END_ID = 2048, 0
#: Steps that the search may make, and fillings of each width that it looks at first.
NODES, LIKELY = 20_000, 16

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
) -> DataFrame:
    """Token sequences (the text's ids, then ``end_id``) cut at ``capacity``.

    One row a piece: id, piece, start, length, ids_crc32 and, on request, the
    ids themselves.  A null or empty text is one piece of ``end_id`` alone.
    """
    path = path or default_path()

    @tidy
    def each(batches):
        vocab = WordIds(path)
        for batch in batches:
            for b in blocks(batch):
                ids, counts = vocab.ids(b.column(1))
                own = b.column(0)
                # the end id after each document
                full = np.full(len(ids) + len(counts), end_id, np.uint32)
                ends = np.cumsum(counts + 1)
                body = np.ones(len(full), bool)
                body[ends - 1] = False
                full[body] = ids
                n_pieces = -(-(counts + 1) // capacity)
                row = np.repeat(np.arange(len(counts)), n_pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * capacity
                length = np.minimum(capacity, (counts + 1)[row] - start)
                first = (ends - counts - 1)[row] + start
                raw = full.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())]
                cols = [own.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate((first, [len(full)])), pa.int32()), pa.array(full.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(each, PIECES + (", ids array<int>" if with_ids else ""))


def best_fit(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on a histogram: patterns (length to its number) and how often each is used."""
    cap = len(counts) - 1
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    for length in range(cap, 0, -1):
        left = int(counts[length])
        for room in sorted(r for r in open_ if r >= length):
            if not left:
                break
            for pattern, times in open_.pop(room):
                each = room // length
                while times and left:
                    take = min(each, left)
                    bins = min(times, left // take)
                    open_.setdefault(room - take * length, []).append((pattern | {length: take}, bins))
                    times, left = times - bins, left - bins * take
                if times:
                    open_.setdefault(room, []).append((pattern, times))
        while left:
            take = min(cap // length, left)
            bins = left // take
            open_.setdefault(cap - take * length, []).append(({length: take}, bins))
            left -= bins * take
    return [x for group in open_.values() for x in group]


class _Steps:
    """What is left of the steps that a search may make."""

    def __init__(self, n: int) -> None:
        self.left = n

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0


def _likely(counts: np.ndarray, room: int) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, pieces) of fillings that waste little: up to three pieces that are there and the largest that then fits."""
    fits = np.flatnonzero(counts[: room + 1])[::-1]
    # the largest length that is there, up to each size
    upto = np.maximum.accumulate(np.where(counts[: room + 1] > 0, np.arange(room + 1), 0))
    found: list[tuple[int, tuple[int, ...]]] = []
    for tops in ((), (2048,), (48, 2048), (12, 12, 512)):
        if found and min(found)[0] == 0:
            break
        heads = np.empty((1, 0), np.int64)
        for n in tops:
            few = fits[:n] if len(fits) <= n else np.unique(np.concatenate((fits[: n // 2], fits[:: max(1, len(fits) // (n // 2))])))[::-1]
            heads = np.concatenate([np.repeat(heads, len(few), 0), np.tile(few, len(heads))[:, None]], 1)
        heads = heads[(np.diff(heads, axis=1) <= 0).all(1)]
        rest = room - heads.sum(1)
        heads, rest = heads[rest >= 0], rest[rest >= 0]
        last = np.minimum(upto[rest], upto[heads[:, -1]]) if heads.shape[1] else upto[rest]
        over = rest - last
        for i in np.argsort(over, kind="stable")[:LIKELY].tolist():
            found.append((int(over[i]), (*heads[i].tolist(), *([int(last[i])] if last[i] else []))))
    return sorted(found, key=lambda f: (f[0], len(f[1])))


def fillings(counts: np.ndarray, room: int, waste: int, steps: _Steps):
    """Every undominated filling of ``room`` that wastes at most ``waste``, the likely ones first.

    A filling is dominated if a piece that is there still fits beside it, or
    could stand in for two of its pieces.  The likely fillings are only an
    order to begin with: an enumeration of all follows.
    """
    lengths = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    there = [int(counts[x]) for x in lengths]
    after = [0] * (len(lengths) + 1)
    for k in range(len(lengths) - 1, -1, -1):
        after[k] = after[k + 1] + lengths[k] * there[k]

    def undominated(pattern: dict[int, int], over: int) -> bool:
        if any(x <= over and pattern.get(x, 0) < n for x, n in zip(reversed(lengths), reversed(there))):
            return False
        some = [x for x, k in pattern.items() for _ in range(min(k, 2))]
        return not any(some[i] + some[j] <= room and counts[some[i] + some[j]] > pattern.get(some[i] + some[j], 0) for i in range(len(some)) for j in range(i))

    def enumerate_(first: int, left: int, chosen: dict[int, int]):
        for k in range(first, len(lengths)):
            if left - after[k] > waste or not steps.take():
                break
            x = lengths[k]
            for n in range(min(there[k], left // x), 0, -1):
                yield from enumerate_(k + 1, left - n * x, chosen | {x: n})
        if left <= waste and undominated(chosen, left):
            yield chosen

    seen = set()
    for over, items in _likely(counts, room):
        pattern = {x: items.count(x) for x in items}
        if over <= waste and all(counts[x] >= k for x, k in pattern.items()) and frozenset(pattern.items()) not in seen and undominated(pattern, over):
            seen.add(frozenset(pattern.items()))
            yield pattern
    for pattern in enumerate_(0, room, {}):
        if frozenset(pattern.items()) not in seen:
            yield pattern


def least_bins(counts: np.ndarray) -> int:
    """A lower bound: for each small size K, pieces over half a bin need a bin each and pieces from K up must share what those leave."""
    cap = len(counts) - 1
    n, w = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * np.arange(cap + 1))))
    k = np.arange(0, cap // 2 + 1)
    alone = n[-1] - n[cap - k + 1]
    large, large_w = n[cap - k + 1] - n[cap // 2 + 1], w[cap - k + 1] - w[cap // 2 + 1]
    small_w = w[cap // 2 + 1] - w[k]
    more = np.maximum(0, -(-(small_w - (large * cap - large_w)) // cap))
    return int((alone + large + more).max())


def bin_completion(counts: np.ndarray, nodes: int = NODES) -> tuple[list[tuple[dict[int, int], int]], bool]:
    """Patterns that pack the histogram in as few bins as were found, and whether that is proved the least possible.

    Around the largest piece left every undominated filling is tried, used as
    often as it can be and then fewer times; a branch ends once its waste is
    more than a better solution could have.  ``nodes`` alone ends the search early.
    """
    cap = len(counts) - 1
    total = int((counts * np.arange(cap + 1)).sum())
    best, bound, steps = best_fit(counts), least_bins(counts), _Steps(nodes)

    def options(left: np.ndarray, spare: int):
        """(pattern, times, waste) around the largest piece of ``left``."""
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        found = fillings(left.copy(), cap - top, spare, steps)
        left[top] += 1
        for fill in found:
            pattern = {**fill, top: fill.get(top, 0) + 1}
            waste = cap - sum(x * k for x, k in pattern.items())
            most = min(int(left[x]) // k for x, k in pattern.items())
            for times in range(min(most, spare // waste) if waste else most, 0, -1):
                yield pattern, times, waste * times

    while (bins := sum(t for _, t in best)) > bound:
        slack = (bins - 1) * cap - total
        better, stack = None, [(counts.copy(), [], 0, None)]
        while stack:
            left, done, wasted, more = stack.pop()
            if more is None:
                if not left.any():
                    better = done
                    break
                more = options(left, slack - wasted)
            if not steps.take():
                break
            step = next(more, None)
            if step is None:
                continue
            stack.append((left, done, wasted, more))
            pattern, times, waste = step
            now = left.copy()
            for x, k in pattern.items():
                now[x] -= k * times
            stack.append((now, [*done, (pattern, times)], wasted + waste, None))
        if better is None:
            return best, steps.left >= 0
        best = better
    return best, True


def _table(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first number, first sequence, pieces a sequence, first offset)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            k = pattern[length]
            first = used.get(length, 0)
            rows.setdefault(length, []).append((first, sequence, k, offset))
            used[length] = first + k * times
            offset += k * length
        sequence += times
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY, nodes: int = NODES) -> DataFrame:
    """Adds sequence_id, offset and optimal to pieces (``id``, ``piece``, ``length`` and any other columns).

    Every piece of 1 to ``capacity`` tokens is placed; sequences are filled from
    offset 0 without gaps.  Repeated rows are placed as often as they come.
    ``optimal`` says, the same in all rows, whether no packing in fewer
    sequences exists; it is false where the search ended before that was known.
    """
    spark = pieces.sparkSession
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        hist[r["length"]] = r["count"]
    patterns, optimal = bin_completion(hist, nodes)
    table = spark.sparkContext.broadcast(_table(patterns))  # bounded by the capacity: each pattern uses some length up
    # number the pieces of each length: cells are counted, then numbered on their own
    salts = max(64, math.ceil(int(hist.sum()) / 50_000))
    celled = pieces.withColumn("cell", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    cells = celled.groupBy("length", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    base = Scratch(spark, "pack").table(cells.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "cells")
    nth = F.row_number().over(Window.partitionBy("length", "cell").orderBy("id", "piece")) - 1 + F.col("base")
    numbered = celled.join(base, ["length", "cell"]).withColumn("nth", nth)
    names = [c for c in pieces.columns]

    def each(batches):
        rows = table.value
        for b in batches:
            length, nth = b.column("length").to_numpy(), b.column("nth").to_numpy()
            seq, off = np.empty(len(nth), np.int64), np.empty(len(nth), np.int64)
            for x in np.unique(length).tolist():
                at = length == x
                r = rows[x]
                p = np.searchsorted(r[:, 0], nth[at], side="right") - 1
                k = nth[at] - r[p, 0]
                seq[at] = r[p, 1] + k // r[p, 2]
                off[at] = r[p, 3] + k % r[p, 2] * x
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return numbered.select(*names, "nth").mapInArrow(each, f"{out}, sequence_id long, offset long").withColumn("optimal", F.lit(optimal))


def packed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, optimal.

    Null and empty texts are a piece of one end id.  Null ids are kept, repeated
    rows are packed as often as they come, an empty table gives no rows.  Other
    columns are not read.  With ``with_ids`` each row carries its ids.
    """
    scratch = Scratch(df.sparkSession, "packing")
    pieces = scratch.table(token_pieces(df, id_col, text_col, path, capacity, with_ids=with_ids), "pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token sequences themselves, of ``packed_documents(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
