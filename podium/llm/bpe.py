"""BPE encoding and decoding over a table of distinct words.

Texts are split into words where they lie.  A block of neighbouring documents
becomes its distinct words and the texts as numbers of those words, so common
words travel once a block.  The words are brought together, each distinct word
is encoded once, and its ids go back to the blocks that asked, where they are
put in at the words' positions.  Decoding joins ids with the table of pieces,
whose size is the vocabulary's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from podium.llm.words import PartEncoder, Split, blocks, default_path, parts_of_all, tidy, tokenizer

#: Bytes of text in a block.  A block's words and numbers are held by one task.
BLOCK_BYTES = 32_000_000
#: Words whose texts are joined at a time, about.
JOINED_WORDS = 250_000


def _numbered(batches):
    """(block, batch, numbers of the texts' words in a row, texts' word counts, how many words come again, words' part counts, numbers of their parts in a row, parts).

    Words that come again are numbered by falling frequency, then the others in
    the order they come, which need not be written down.  A block's name is a
    digest of its ids and texts, its partition and its place there: both passes
    give a block the same name only if they read the same rows in it.
    """
    part, nth = TaskContext.get().partitionId(), 0
    for batch in batches:
        for b in blocks(batch, chars=BLOCK_BYTES):
            split = Split(b.column(1))
            name = xxhash.xxh3_64(np.array([part, nth, b.num_rows, b.column(1).null_count], np.int64).tobytes())
            name.update(str(b.column(0).to_pylist()).encode())
            name.update(split.edges.tobytes())
            name.update(split.data.tobytes())
            flat, first, _ = split.distinct()
            times = np.bincount(flat, minlength=len(first))
            order = np.argsort(np.where(times == 1, 1, -times), kind="stable")
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order))
            counts, found = parts_of_all(split.words(first[order]))
            coded = found.dictionary_encode()
            yield name.intdigest() - (1 << 63), b, number[flat], split.sizes, int((times > 1).sum()), counts, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            nth += 1


@tidy
def _words_of(batches):
    for block, *_, parts in _numbered(batches):
        n = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), parts.cast(pa.string())], names=["block", "at", "word"])


def _squeezed(numbers: np.ndarray) -> bytes:
    """Unsigned numbers in few bytes: one for those below 255, byte planes of the rest, compressed."""
    codec, large = pa.Codec("zstd", 1), numbers >= 255
    rest = np.ascontiguousarray(numbers[large].astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()
    first = codec.compress(np.where(large, 255, numbers).astype(np.uint8).tobytes(), asbytes=True)
    return np.array([len(numbers), large.sum(), len(first)], np.int64).tobytes() + first + codec.compress(rest, asbytes=True)


def _spread(squeezed: bytes) -> np.ndarray:
    codec = pa.Codec("zstd")
    n, n_large, upto = np.frombuffer(squeezed[:24], np.int64).tolist()
    if not n:
        return np.empty(0, np.int64)
    out = np.frombuffer(codec.decompress(squeezed[24 : 24 + upto], n, asbytes=True), np.uint8).astype(np.int64)
    if n_large:
        rest = np.frombuffer(codec.decompress(squeezed[24 + upto :], n_large * 4, asbytes=True), np.uint8)
        out[out == 255] = np.ascontiguousarray(rest.reshape(4, -1).T).view(np.uint32).ravel()
    return out


def _unsaid(numbers: np.ndarray, first: int) -> np.ndarray:
    """Numbers from ``first`` on come in order for the first time: those times become 0, all others rise by one."""
    numbers = numbers.astype(np.int64)
    before = np.maximum.accumulate(numbers)
    new = numbers >= first
    new[1:] &= numbers[1:] > before[:-1]
    return np.where(new, 0, numbers + 1)


def _said(numbers: np.ndarray, first: int) -> np.ndarray:
    out = numbers - 1
    new = np.flatnonzero(numbers == 0)
    out[new] = first + np.arange(len(new))
    return out


@tidy
def _texts_of(batches):
    for block, b, flat, sizes, again, counts, of_words, parts in _numbered(batches):
        cols = [
            pa.array([block]), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([len(parts)], pa.int64()), pa.array([again], pa.int64()),
            *(pa.array([_squeezed(x)], pa.binary()) for x in (_unsaid(flat, again), counts, _unsaid(of_words, 0))),
        ]
        yield pa.RecordBatch.from_arrays(cols, names=["block", "doc_ids", "sizes", "n_parts", "again", "numbers", "lengths", "made"])


def _encoder(path: str, narrow: bool):
    def each(batches):
        encode_part, known = PartEncoder(path), {}
        for b in batches:
            coded = b.column("word").dictionary_encode()
            terms = coded.dictionary.to_pylist()
            got = {w: np.array(encode_part(w), "<u2" if narrow else "<u4").tobytes() for w in terms if w not in known}
            packed = [got.get(w) or known[w] for w in terms]
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("at"), pa.array(packed, pa.binary()).take(coded.indices)], names=["block", "at", "ids"])
            # rows come sorted: only the last word can come again
            known = {terms[i]: packed[i] for i in [coded.indices[-1].as_py()]} if b.num_rows else known

    return each


def _encoded_blocks(df: DataFrame, id_col: str, text_col: str, path: str, finish, schema: str) -> DataFrame:
    """``finish`` gets, for each block, the documents' ids, their words' numbers in a row and how many they have, the words' ids in a row and their edges."""
    narrow = tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = docs.mapInArrow(_words_of, "block long, at int, word string")
    answered = asked.repartition("word").sortWithinPartitions("word").mapInArrow(_encoder(path, narrow), "block long, at int, ids binary")
    texts = docs.mapInArrow(_texts_of, "block long, doc_ids array<long>, sizes array<long>, n_parts long, again long, numbers binary, lengths binary, made binary")

    def each(text: pa.Table, asked: pa.Table) -> pa.Table:
        if text.num_rows != 1 or asked.num_rows != text["n_parts"][0].as_py():
            raise RuntimeError("a block's words do not match its texts: rows must come the same way in two reads of the input")
        kept = asked.select(["at", "ids"]).sort_by("at")["ids"].combine_chunks()
        n_ids = pc.binary_length(kept).to_numpy().astype(np.int64) // (2 if narrow else 4)
        part_ids = np.frombuffer(b"".join(kept.to_pylist()), "<u2" if narrow else "<u4")
        numbers, lengths, made = (_spread(text[c][0].as_py()) for c in ("numbers", "lengths", "made"))
        numbers, made = _said(numbers, text["again"][0].as_py()), _said(made, 0)
        # the words' parts, then the parts' ids, in a row
        count, upto = n_ids[made], np.concatenate(([0], np.cumsum(n_ids[made])))
        ids = part_ids[np.arange(upto[-1]) + np.repeat((np.cumsum(n_ids) - n_ids)[made] - upto[:-1], count)]
        return finish(text["doc_ids"][0].as_py(), numbers, np.array(text["sizes"][0].as_py(), np.int64), ids, upto[np.concatenate(([0], np.cumsum(lengths)))])

    return texts.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(each, schema)


def _joined(texts: pa.Array, edges: np.ndarray) -> pa.Array:
    """The texts between each two edges, joined by a space."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), texts), pa.scalar(" ", pa.large_string()))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>): the ids of every whole text, as the tokenizer gives them without special tokens added.

    Null and empty texts have no ids; null ids and repeated rows are kept; an
    empty table gives no rows.  Other columns are not read.
    """

    def finish(doc_ids, numbers, sizes, ids, edges):
        count = np.diff(edges)[numbers]
        upto = np.concatenate(([0], np.cumsum(count)))
        flat = ids[np.arange(upto[-1]) + np.repeat(edges[:-1][numbers] - upto[:-1], count)].astype(np.int32)
        rows = upto[np.concatenate(([0], np.cumsum(sizes)))].astype(np.int32)
        return pa.table({"id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(rows), pa.array(flat))})

    return _encoded_blocks(df, id_col, text_col, path or default_path(), finish, "id long, ids array<int>").withColumnRenamed("id", id_col)


def pieces(spark, path: str | None = None) -> DataFrame:
    """(id, piece): the vocabulary, special tokens included."""
    vocab = tokenizer(path or default_path()).get_vocab(with_added_tokens=True)
    return spark.createDataFrame([(i, p) for p, i in vocab.items()], "id int, piece string")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, decoded): pieces joined by a space, special tokens kept; '' for no ids, null for null.

    Ids outside the vocabulary have no piece.  Each row is decoded on its own.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).withColumn("row", F.monotonically_increasing_id())
    single = rows.select("row", "id", F.posexplode_outer("ids").alias("at", "token"), F.col("ids").isNull().alias("none"))
    named = single.join(F.broadcast(pieces(df.sparkSession, path).withColumnRenamed("id", "token")), "token", "left")
    texts = named.groupBy("row").agg(F.first("id").alias(id_col), F.first("none").alias("none"), F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")))).alias("p"))
    return texts.select(id_col, F.when(~F.col("none"), F.array_join(F.transform("p", lambda x: x["piece"]), " ")).alias("decoded"))


def round_trip_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded again.

    The id-to-piece table, as large as the vocabulary, is joined on the map
    side, once for each distinct word of a block.
    """
    path = path or default_path()
    shared = df.sparkSession.sparkContext.broadcast({r["id"]: r["piece"] for r in pieces(df.sparkSession, path).collect()})

    def finish(doc_ids, numbers, sizes, ids, edges):
        count = np.diff(edges)
        used = np.unique(ids)
        within = np.searchsorted(used, ids)
        if not (count > 0).all():  # a word without ids leaves no space
            live = count[numbers] > 0
            sizes = np.diff(np.concatenate(([0], np.cumsum(live)))[np.concatenate(([0], np.cumsum(sizes)))])
            numbers = numbers[live]
        ends = np.cumsum(sizes)
        n_tokens = np.diff(np.concatenate(([0], np.cumsum(count[numbers])))[np.concatenate(([0], ends))])
        cols = [pa.array(doc_ids, pa.int64()), pa.array(n_tokens)]
        piece = shared.value
        for names in (list(map(str, used.tolist())), [piece[i] for i in used.tolist()]):
            of_word = _joined(pa.array(names, pa.large_string()).take(pa.array(within)), edges)
            digests, first = [], 0
            while first < len(sizes):
                at = int(ends[first] - sizes[first])
                last = max(first + 1, int(np.searchsorted(ends, at + JOINED_WORDS, "right")))
                texts = _joined(of_word.take(pa.array(numbers[at : ends[last - 1]])), np.concatenate(([0], ends[first:last] - at)))
                places, data = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1).tolist(), memoryview(texts.buffers()[2] or b"")
                digests += [hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(places, places[1:])]
                first = last
            cols.append(pa.array(digests, pa.string()))
        return pa.table(dict(zip(("id", "n_tokens", "ids_sha256", "decoded_sha256"), cols)))

    return _encoded_blocks(df, id_col, text_col, path, finish, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op4_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
