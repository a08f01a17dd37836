"""Toxicity scores by non-negative positive-unlabelled learning.

The positives are documents confirmed toxic; every other training text counts
as unlabelled, whatever its label.  A linear model over the presence of words
and word beginnings is fitted in numpy by descent on the class-prior-corrected
risk  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))  with logistic loss.

Words become 64-bit hashes where the sampled texts lie, and features are
counted there; the driver gets sketches of the sampled texts, the telling
features and sparse rows of their numbers, all of bounded size, but no text.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from podium.llm.words import tidy
from podium.plans.scratch import Scratch

#: Documented bounds of the fitting sample: texts of each kind, and feature numbers of all texts together.
MAX_POSITIVE, MAX_UNLABELLED, MAX_ENTRIES = 2_000, 6_000, 4_000_000
#: The model's size: the most telling features of the sample.
MAX_FEATURES = 20_000
LEAST_COUNT, LEAST_RATIO = 3, 4.0
THRESHOLD = 0.7
#: Words whose features a process remembers.
WORDS_KEPT = 200_000

_WORD = re.compile(r"\w+")
SAMPLE = "positive boolean, sketch array<long>, words array<long>, four array<long>, five array<long>"


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _hash(kind: str, word: str) -> int:
    """A feature's number: never 0, which stands for none."""
    return xxhash.xxh3_64_intdigest(kind + word) - (1 << 63) or 1


def word_hashes(word: str) -> tuple[int, int, int]:
    """The features of the word itself and of its first four and five letters; 0 where it is shorter."""
    return _hash("w", word), *(_hash(str(n), word[:n]) if len(word) >= n else 0 for n in (4, 5))


def _again(features, times: int):
    """The feature that a beginning is there ``times`` times; numbers or arrays of them."""
    return np.bitwise_xor(features, np.int64(0x1851F42D4C957F2D * (times - 1)))


def text_features(words: np.ndarray, four: np.ndarray, five: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Features of a text's words: the word where it is ``chosen`` (sorted), else its beginnings.

    A beginning that two, or three, of the words have is a feature of its own.
    """
    own = np.isin(words, chosen)
    begun, times = np.unique(np.concatenate((four[~own], five[~own])), return_counts=True)
    begun, times = begun[begun != 0], times[begun != 0]
    return np.concatenate((words[own], begun, _again(begun[times > 1], 2), _again(begun[times > 2], 3)))


def _sampled(batches):
    """(positive, sketch, words, beginnings) of (positive, text)."""
    for b in batches:
        for positive, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            hashes = np.array([word_hashes(w) for w in text_words(text)], np.int64).reshape(-1, 3)
            cols = [[positive], [heapq.nsmallest(8, hashes[:, 0].tolist())], *([hashes[:, i]] for i in range(3))]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.bool_()), *(pa.array(c, pa.list_(pa.int64())) for c in cols[1:])], names=["positive", "sketch", "words", "four", "five"])


def _unlike(sketches: list[tuple[int, list[int]]]) -> list[int]:
    """Rows less later near copies, whose shared words would look like evidence: those with most of a sketch in common."""
    kept, seen = [], {}
    for row, sketch in sketches:
        like = Counter(j for h in sketch for j in seen.get(h, ()))
        if sketch and like and max(like.values()) >= max(1, 3 * len(sketch) // 4):
            continue
        kept.append(row)
        for h in sketch:
            seen.setdefault(h, []).append(row)
    return kept


def _features_of(batch: pa.RecordBatch, chosen: np.ndarray | None):
    """(positive, features) of each sampled text; without ``chosen``, the words alone."""
    get = lambda c, i: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
    for i, positive in enumerate(batch.column("positive").to_pylist()):
        yield positive, get("words", i) if chosen is None else text_features(*(get(c, i) for c in ("words", "four", "five")), chosen)


def _telling(sample: DataFrame, n_p: int, n_u: int, prior: float, chosen: np.ndarray | None = None) -> np.ndarray:
    """Features too common in toxic text to be chance, the most telling ones, sorted.

    What clean text would give follows from the unlabelled counts less what the
    class prior says is toxic there.  The score is -log10 of the chance of so
    many where the mean is expected (Poisson, bounded from above).
    """

    def counted(batches):
        for b in batches:
            found = {True: [], False: []}
            for positive, f in _features_of(b, chosen):
                found[positive].append(f)
            for positive, some in found.items():
                f, k = np.unique(np.concatenate(some), return_counts=True) if some else (np.empty(0, np.int64),) * 2
                none = np.zeros(len(k), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(k if positive else none), pa.array(none if positive else k)], names=["f", "k", "u"])

    counts = sample.mapInArrow(counted, "f long, k long, u long").groupBy("f").agg(F.sum("k").alias("k"), F.sum("u").alias("u")).where(F.col("k") >= LEAST_COUNT)
    counts = Scratch(sample.sparkSession, "toxic-counts").table(counts, "counts")
    least = max(3.0, float(np.log10(counts.count() + 1)))  # about one by chance
    k = F.col("k")
    clean = F.greatest(F.col("u") - prior * n_u / n_p * (k - 2 * F.sqrt(k)), F.lit(0.0)) + 1
    mean = F.lit(n_p / n_u) * clean
    score = (k * F.ln(k / mean) - k + mean) / float(np.log(10))
    told = counts.where(k > LEAST_RATIO * mean).select("f", score.alias("score")).where(F.col("score") > least)
    return np.sort(np.array([r["f"] for r in told.orderBy(F.desc("score"), "f").limit(MAX_FEATURES).collect()], np.int64))


def _risk_step(f_p: np.ndarray, f_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Derivatives of the non-negative risk by the outputs, and the risk."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    soft = lambda z: np.logaddexp(0, z)
    plus, minus_p, minus_u = soft(-f_p).mean(), soft(f_p).mean(), soft(f_u).mean()
    rest = minus_u - prior * minus_p
    if rest >= 0:
        d_p = (prior * (sig(f_p) - 1) - prior * sig(f_p)) / len(f_p)
        d_u = sig(f_u) / len(f_u)
    else:  # the negative part has gone below zero: step back along it
        d_p = prior * sig(f_p) / len(f_p)
        d_u = -sig(f_u) / len(f_u)
    return d_p, d_u, prior * plus + max(0.0, rest)


def descend(row: np.ndarray, col: np.ndarray, n_p: int, n_u: int, n_features: int, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias from sparse rows, the ``n_p`` positive ones first."""
    w, b = np.zeros(n_features), -2.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, steps + 1):
        out = np.bincount(row, weights=w[col], minlength=n_p + n_u) + b
        d_p, d_u, _ = _risk_step(out[:n_p], out[n_p:], prior)
        d = np.concatenate((d_p, d_u))
        grad = np.append(np.bincount(col, weights=d[row], minlength=n_features) + l2 * w, d.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    return w, float(b)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _drawn(n: int, most: int, seed: int, *cols: str):
    """About ``most`` of ``n`` rows, by a hash of the columns."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / n))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_entries: int = MAX_ENTRIES) -> dict:
    """{'bias', 'words', 'weights'}: a model from rows that are not held out; without either kind, one that scores 0.

    About ``max_positive`` confirmed and ``max_unlabelled`` distinct texts are
    drawn by a hash of id and text.  The class prior is the share of toxic labels.
    """
    nothing = {"bias": -50.0, "words": frozenset(), "weights": {}}
    scratch = Scratch(docs.sparkSession, "toxic-fit")
    seen = labels.where(F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    n_seen, n_pos = seen.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n_rows = rows.count()
    if not n_pos or not n_rows:
        return nothing
    prior = min(max(n_pos / n_seen, 1e-3), 0.999)
    some = F.broadcast(seen.where((F.col("toxic") == 1) & _drawn(n_pos, max_positive, 1, "id")).select("id"))  # about max_positive ids at most
    confirmed = rows.join(some, "id")
    drawn = confirmed.where(_drawn(max(1, confirmed.count()), max_positive, 3, "id", "text")).select(F.lit(True).alias("positive"), "id", "text")
    drawn = drawn.unionByName(rows.where(_drawn(n_rows, max_unlabelled, 2, "id", "text")).select(F.lit(False).alias("positive"), "id", "text"))
    sample = scratch.table(drawn.distinct().select("positive", "text").mapInArrow(_sampled, SAMPLE).withColumn("row", F.monotonically_increasing_id()), "sample")
    sketches = [(r["row"], r["positive"], r["sketch"]) for r in sample.select("row", "positive", "sketch").collect()]  # at most eight numbers a sampled text
    sketches.sort(key=lambda s: s[2])  # the same order however the rows were dealt
    kept = [_unlike([(row, sketch) for row, kind, sketch in sketches if kind is positive]) for positive in (True, False)]
    n_p, n_u = map(len, kept)
    if not n_p or not n_u:
        return nothing
    # numbers of the kept texts, the positive ones first
    place = docs.sparkSession.createDataFrame([(r, i) for i, r in enumerate(kept[0] + kept[1])], "row long, place long")
    sample = scratch.table(sample.drop("sketch").join(F.broadcast(place), "row").drop("row"), "kept")
    words = _telling(sample, n_p, n_u, prior)
    # word beginnings stand for the words that are too rare to tell by themselves
    chosen = _telling(sample, n_p, n_u, prior, words)
    if not len(chosen):
        return nothing

    def numbered(batches):
        for b in batches:
            for place, (_, f) in zip(b.column("place").to_pylist(), _features_of(b, words)):
                at = np.searchsorted(chosen, f)
                at = at[chosen[np.minimum(at, len(chosen) - 1)] == f]
                yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([at.astype(np.int32)], pa.list_(pa.int32()))], names=["place", "at"])

    sparse = scratch.table(sample.mapInArrow(numbered, "place long, at array<int>").where(F.size("at") > 0), "sparse")
    entries = sparse.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    got = sparse.where(_drawn(max(1, entries), max_entries, 4, "place")).toArrow()
    place, at = got["place"].to_numpy(), got["at"].combine_chunks()
    weights, bias = descend(np.repeat(place, np.diff(at.offsets.to_numpy())), at.values.to_numpy(), n_p, n_u, len(chosen), prior)
    scratch.drop(sample, sparse)
    return {"bias": bias, "words": frozenset(words.tolist()), "weights": dict(zip(chosen.tolist(), weights.tolist()))}


def _scorer(model: dict):
    weights, bias, chosen = model["weights"], model["bias"], model["words"]
    weight = lambda f: weights.get(int(f), 0.0)
    #: what the first, second and third word of a beginning add
    steps = {f: (w, weight(_again(np.int64(f), 2)), weight(_again(np.int64(f), 3))) for f, w in weights.items() if f not in chosen}

    class Known(dict):
        """A word's weight, or its beginnings that bear on the score."""

        def __missing__(self, word):
            whole, *begun = word_hashes(word)
            got = self[word] = (weights.get(whole, 0.0), ()) if whole in chosen else (0.0, tuple(f for f in begun if f in steps))
            return got

    known = Known()

    def score(text):
        if len(known) > WORDS_KEPT:
            known.clear()
        total, times = bias, Counter()
        for own, begun in map(known.__getitem__, text_words(text)):
            total += own
            if begun:
                times.update(begun)
        for f, k in times.items():
            total += sum(steps[f][:k])
        return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))

    return score


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, carry: bool = False, **bounds) -> DataFrame:
    """(id, held_out, score, predicted) for every whole text; with ``carry``, all columns of ``df`` and the score.

    Carried scores are the last column, ``_score`` or, where ``df`` has that
    name, one with more underscores behind.  Null and empty texts score the
    model's bias; with no confirmed toxic document all scores are (nearly) 0.
    Null ids, repeated rows and repeated or conflicting labels (a document once
    labelled toxic is toxic) are fine; an empty table gives no rows.  Columns of
    any name may be there besides; only id and text are read unless carried.
    """
    shared = df.sparkSession.sparkContext.broadcast(train(df, labels, id_col, text_col, **bounds))

    @tidy
    def each(batches):
        score = _scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([score(t) for t in b.column(b.num_columns - 1).to_pylist()], pa.float64())], names=[*b.schema.names[:-1], "s"])

    def scored(rows: DataFrame) -> DataFrame:
        """``rows`` with the score in place of the last column; columns are told apart by place."""
        fields = rows.schema.fields[:-1]
        numbered = rows.toDF(*(f"c{i}" for i in range(len(fields) + 1)))
        return numbered.mapInArrow(each, StructType([*(StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)), StructField("s", DoubleType())]))

    if carry:
        name = "_score"
        while name in df.columns:
            name += "_"
        return scored(df.select("*", F.col(f"`{text_col}`"))).toDF(*df.columns, name)
    out = scored(df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))).toDF(id_col, "score")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_pu_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
