"""Line dedup by an exact set-similarity join.

A line is the set of its lower-cased words.  A line goes if an earlier one (by
document id, row and line number) has a Jaccard similarity of the threshold or
more with it.  Words of a line are ordered by rarity (counts of a fixed number
of word buckets; any common order gives exact results).  Lines as similar as
the threshold share several words in their prefixes in that order, at positions
that leave room for the overlap they need, and have fitting lengths; a parity
sketch of the sets, whose bits cannot differ in more places than the sets do,
is checked beside these.

Texts are read once: a block table keeps each line's distinct words as numbers.
Lines of equal sets are brought down to the first, and only those go on.  Lines
that share a prefix word come together, in packed rows, and are candidates if
they share enough of them.  A word of very many lines makes no list: its lines
are split by the pigeonhole principle instead, by signatures of parts of the
words of which similar lines have one in common.  In a long list a line that
may match the earliest one of about its size is only held against that one,
which settles groups of near copies in linear work, and should that fail,
against all others in a second round.  Candidates are verified on the whole
word sets.  Words are told apart by 64 bits and sets, where they are equal, by
128 bits of hash; results are exact but for collisions of these.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from podium.llm.bpe import _said, _spread, _squeezed
from podium.llm.words import Split, blocks, give_back, tidy
from podium.plans.scratch import Scratch

THRESHOLD = 0.8
#: Word buckets that rarity is counted by.
BUCKETS = 1 << 23
#: Bits of the filters that keep lines and words without candidates from travelling.
FILTER = 1 << 24
LAST_ID = (1 << 63) - 1
BLOCK_BYTES = 4_000_000
#: Lists of lines that share a word, up to which all pairs are looked at.
SHORT_LIST = 64
#: Occurrences of a word (of its bucket) from which its lines are split by signatures.
HOT_WORD = 1 << 17
#: Rows that share a shuffled bucket, about, and rows that a task gathers before it sends them.
BUCKET_ROWS, SENT_ROWS = 250_000, 300_000
#: Lines of so few words have a sketch of 64 bits, others of 128.
SHORT_LINE = 48

TABLE = "block long, ids array<long>, lines array<int>, sizes array<int>, again long, numbers binary, hashes binary"


#: Bytes that lead characters which may have another lower case and are not U+00C0 to U+00FF.
_OTHER_CASE = np.array([0xC4 <= b <= 0xE1 or b >= 0xEA for b in range(256)])


def _lower(column: pa.Array) -> pa.Array:
    """As str.lower(), by bytes where a text has ASCII, U+0080 to U+00FF, U+2000 to U+20BF and U+3000 to U+9FFF only."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if edges[-1] == edges[0]:
        return column
    x = np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    low = x | (((x - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
    high = np.flatnonzero(x >= 0xC3)
    second = high[x[high] == 0xC3] + 1
    low[second] += np.where((x[second] <= 0x9E) & (x[second] != 0x97), 32, 0).astype(np.uint8)
    other = high[_OTHER_CASE[x[high]] | ((x[high] == 0xE2) & (x[np.minimum(high + 1, len(x) - 1)] > 0x82))]
    edges = edges - edges[0]
    out = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(edges), pa.py_buffer(low)])
    if not len(other):
        return out
    mask = np.zeros(len(column), bool)
    mask[np.searchsorted(edges, other, side="right") - 1] = True
    mask = pa.array(mask)
    return pc.replace_with_mask(out, mask, pa.array([t.lower() for t in column.filter(mask).to_pylist()], pa.large_string()))


@tidy
def _block_table(batches):
    """A row a block: the document id, number and distinct words of each line with words."""
    part, nth = TaskContext.get().partitionId(), 0
    for batch in batches:
        for b in blocks(batch, chars=BLOCK_BYTES):
            split = Split(_lower(b.column(1)), controls=True)
            if not len(split.starts):
                continue
            feeds = np.flatnonzero(split.data[:-8] == 10)
            text = np.repeat(np.arange(b.num_rows), split.sizes)
            at = np.cumsum(np.bincount(np.searchsorted(split.starts, feeds), minlength=len(split.starts) + 1)[:-1])
            new = np.concatenate(([True], (np.diff(at) != 0) | (np.diff(text) != 0)))
            first = np.flatnonzero(new)
            no = at[first] - np.searchsorted(feeds, split.edges)[text[first]]
            coded = pa.array(split.hashes()).dictionary_encode()
            h, number = coded.dictionary.to_numpy(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            v, n = len(h), len(first)
            key = np.sort((np.cumsum(new) - 1) << 32 | number)
            key = key[np.concatenate(([True], key[1:] != key[:-1]))]
            line, word = key >> 32, key & 0xFFFFFFFF
            times = np.bincount(word, minlength=v)
            order = np.argsort(np.where(times == 1, 65535, 65534 - np.minimum(times, 65534)).astype(np.uint16), kind="stable")
            renumbered = np.empty(v, np.int64)
            renumbered[order] = np.arange(v)
            again = int((times > 1).sum())
            cols = [
                pa.array([part << 32 | nth]), pa.array([b.column(0).take(pa.array(text[first])).to_numpy(zero_copy_only=False)], pa.list_(pa.int64())), pa.array([no.astype(np.int32)], pa.list_(pa.int32())), pa.array([np.bincount(line, minlength=n).astype(np.int32)], pa.list_(pa.int32())),
                pa.array([again], pa.int64()), pa.array([_squeezed(_once_unsaid(renumbered[word], again))], pa.binary()), pa.array([h[order].tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "ids", "lines", "sizes", "again", "numbers", "hashes"])
            nth += 1


def _once_unsaid(numbers: np.ndarray, first: int) -> np.ndarray:
    """As ``_unsaid``, where numbers from ``first`` on come once each."""
    return np.where(numbers >= first, 0, numbers + 1)


def _unpacked(batches):
    """(block, ids, line numbers, sizes, word numbers line by line, words' hashes, lines to skip) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            get = lambda c: batch.column(c)[i].values.to_numpy(zero_copy_only=False)
            numbers = _said(_spread(batch.column("numbers")[i].as_py()), batch.column("again")[i].as_py())
            skip = batch.column("skip")[i].as_py() if "skip" in batch.schema.names else None
            yield batch.column("block")[i].as_py(), get("ids"), get("lines"), get("sizes").astype(np.int64), numbers, np.frombuffer(batch.column("hashes")[i].as_py(), np.uint64), skip or []


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def _mixed(h: np.ndarray, by: int) -> np.ndarray:
    x = h * np.uint64(by)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0xBF58476D1CE4E5B9)


@tidy
def _line_keys(batches):
    """128 bits for each line's set, whatever its order."""
    for block, ids, lines, sizes, numbers, h, _ in _unpacked(batches):
        at = np.cumsum(sizes) - sizes
        a, b = (np.add.reduceat(_mixed(h, k)[numbers], at).view(np.int64) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ids), pa.array(lines), pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32))], names=["set_a", "set_b", "id", "line", "block", "at"])


def _need(threshold: float, n):
    """Words that a line of ``n`` must share with one as similar as the threshold, at least."""
    return np.ceil(threshold * n - 1e-9).astype(np.int64)


def _shared(n):
    """Prefix words that two lines of ``n`` words or more must share: the prefix is as much longer than it need be for one."""
    return 2 + n // 64


#: Buckets whose counts travel together.
CHUNK = 1 << 17


def _counts(threshold: float):
    """(chunk, counts, prefixes): occurrences by bucket, and the prefix words of all lines with the first chunk."""

    @tidy
    def each(batches):
        total, prefixes = np.zeros(BUCKETS, np.int32), 0
        for _, _, _, sizes, numbers, h, _ in _unpacked(batches):
            np.add.at(total, _bucket(h), np.bincount(numbers, minlength=len(h)).astype(np.int32))
            prefixes += int((sizes - _need(threshold, sizes) + _shared(sizes)).sum())
        if prefixes:
            for c, part in enumerate(total.reshape(-1, CHUNK)):
                blob = pa.Codec("zstd", 1).compress(part.tobytes(), asbytes=True)
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([blob], pa.binary()), pa.array([0 if c else prefixes])], names=["chunk", "counts", "prefixes"])

    return each


def _ranks(group: pa.Table) -> pa.Table:
    """(chunk, ranks, prefixes): buckets' places in the order of rarity, a byte each; 0 for words that stand alone."""
    total = np.zeros(CHUNK, np.int64)
    for blob in group["counts"]:
        total += np.frombuffer(pa.Codec("zstd").decompress(blob.as_py(), CHUNK * 4, asbytes=True), np.int32)
    rank = np.minimum(255, np.round(10 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
    return pa.table({"chunk": group["chunk"][:1], "ranks": pa.array([rank.tobytes()], pa.binary()), "prefixes": pa.array([pc.sum(group["prefixes"]).as_py()])})


def _hot_rank() -> int:
    return min(255, round(10 * math.log2(HOT_WORD)))


def _line_bit(ids: np.ndarray, lines: np.ndarray) -> np.ndarray:
    return ((ids % FILTER) * 1000003 + lines) % FILTER


def _sketch(h: np.ndarray, numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of the words by seven bits of their hash, as two numbers; folded into the first for short lines."""
    at, bit = np.cumsum(sizes) - sizes, np.uint64(1) << ((h >> np.uint64(57)) & np.uint64(63))
    low, high = (np.bitwise_xor.reduceat(np.where(lane, bit, np.uint64(0))[numbers], at) for lane in (h >> np.uint64(63) == 0, h >> np.uint64(63) == 1))
    short = sizes <= SHORT_LINE
    return np.where(short, low ^ high, low), np.where(short, np.uint64(0), high)


def _classes(threshold: float, most: int) -> list[int]:
    """Edges of size classes: a line's matches are of its class or a neighbouring one."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(int(edges[-1] / threshold + 1e-9) + 1)
    return edges


def _signatures(threshold: float, wanted: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, h: np.ndarray):
    """(line, signature) of the wanted lines.

    Two similar lines, the larger of class c, differ in at most D words, so of
    D + 1 parts that words are dealt to by their hash they have one in common.
    A line has signatures for its own class and, as the smaller one, the next.
    """
    edges = _classes(threshold, int(sizes.max(initial=1)))
    own = np.searchsorted(edges, sizes, side="right") - 1
    line_of, mixed = np.repeat(np.arange(len(sizes)), sizes), _mixed(h, 0xD6E8FEB86659FD93)
    for c in np.unique(own[wanted]).tolist():
        mine = wanted & (own == c)
        use = np.repeat(mine, sizes)
        place = np.cumsum(mine) - 1
        for of in (c, c + 1):
            largest = int(int(edges[of] / threshold + 1e-9))
            parts = int(2 * largest * (1 - threshold) / (1 + threshold) + 1e-9) + 1
            word = numbers[use]
            part = (mixed >> np.uint64(33)).astype(np.int64)[word] % parts
            got = np.zeros(int(mine.sum()) * parts, np.uint64)
            np.add.at(got, place[line_of[use]] * parts + part, _mixed(h[word], 0xA24BAED4963EE407))
            key = _mixed(got + np.tile(np.arange(parts, dtype=np.uint64), int(mine.sum())) * np.uint64(0x9FB21C651E98DF25) + np.uint64(of + 1), 0xE7037ED1A0B428DB)
            yield np.repeat(np.flatnonzero(mine), parts), key


FIELDS = (("word", np.uint32), ("id", np.int64), ("line", np.int32), ("pos", np.int32), ("n", np.int32), ("low", np.uint64), ("high", np.uint64), ("open", np.bool_))


def _packed(rows: dict[str, np.ndarray]) -> bytes:
    body = b"".join(np.ascontiguousarray(rows[c].astype(t)).tobytes() for c, t in FIELDS)
    return len(rows["word"]).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(body, asbytes=True)


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    n, at, out = int.from_bytes(blob[:8], "little"), 0, {}
    body = pa.Codec("zstd").decompress(blob[8:], n * sum(np.dtype(t).itemsize for _, t in FIELDS), asbytes=True)
    for c, t in FIELDS:
        size = n * np.dtype(t).itemsize
        out[c] = np.frombuffer(body[at : at + size], t)
        at += size
    return out


def _prefixes(rarity, threshold: float, n_buckets: int, of_lines=None, of_words=None, as_blocks: bool = True):
    """(bucket, packed rows): the lines' prefix words, or signatures where one of these is hot.

    With filters, only words in ``of_words`` are sent and lines in ``of_lines``
    are marked open.  A word counted once is in no other line and is left out.
    """

    hot_rank = _hot_rank()

    def of_block(rank, open_, wanted, block):
        _, ids, lines, sizes, numbers, h, skip = block
        of_word = rank[_bucket(h)]
        alive = np.ones(len(sizes), bool)
        alive[skip] = False
        if wanted is not None:  # lines with a wanted word, or that may have signatures
            some = wanted[(h & np.uint64(FILTER - 1)).astype(np.int64)] | (of_word >= hot_rank)
            alive &= np.logical_or.reduceat(some[numbers], np.cumsum(sizes) - sizes)
        if not alive.all():
            numbers = numbers[np.repeat(alive, sizes)]
            ids, lines, sizes = ids[alive], lines[alive], sizes[alive]
        if not len(sizes):
            return None
        v, at = len(h), np.cumsum(sizes) - sizes
        order = np.argsort(h)  # no two are equal
        order = order[np.argsort(of_word[order], kind="stable")]
        place = np.empty(v, np.int64)
        place[order] = np.arange(v)
        key = np.sort(np.repeat(np.arange(len(sizes)) << 32, sizes) | place[numbers])
        long = np.minimum(sizes, sizes - _need(threshold, sizes) + _shared(sizes))
        line = np.repeat(np.arange(len(sizes)), long)
        pos = np.arange(len(line)) - np.repeat(np.cumsum(long) - long, long)
        word = order[key[at[line] + pos] & 0xFFFFFFFF]
        ranks = of_word[word]
        use, hot = ranks > 0, ranks >= hot_rank
        signed = np.zeros(len(sizes), bool)
        signed[line[hot]] = True
        use &= ~hot
        found = [(line[use], h[word[use]], pos[use])]
        if signed.any():
            found += [(x, k, np.full(len(x), -1)) for x, k in _signatures(threshold, signed, sizes, numbers, h)]
        line, word, pos = (np.concatenate(x) for x in zip(*found))
        if wanted is not None:
            use = wanted[(word & np.uint64(FILTER - 1)).astype(np.int64)]
            line, word, pos = line[use], word[use], pos[use]
        low, high = _sketch(h, numbers, sizes)
        marked = open_[_line_bit(ids, lines)] if open_ is not None else np.zeros(len(sizes), bool)
        return {"key": word, "id": ids[line], "line": lines[line], "pos": pos, "n": sizes[line], "low": low[line], "high": high[line], "open": marked[line]}

    def sent(gathered):
        rows = {c: np.concatenate([g[c] for g in gathered]) for c in gathered[0]}
        if not len(rows["key"]):
            return
        bucket = ((rows["key"] >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
        rows["word"] = (rows.pop("key") & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        rows = {c: x[order] for c, x in rows.items()}
        blobs = [_packed({c: x[i:j] for c, x in rows.items()}) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order][edges[:-1]]), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

    @tidy
    def each(batches):
        rank = rarity.value
        bits = [None if f is None else np.unpackbits(f.value, bitorder="little").view(bool) for f in (of_lines, of_words)]
        gathered, held = [], 0
        for block in _unpacked(batches) if as_blocks else batches:
            got = of_block(rank, *bits, block)
            if got is None:
                continue
            gathered.append(got)
            held += len(got["key"])
            if held > SENT_ROWS:
                yield from sent(gathered)
                gathered, held = [], 0
        if gathered:
            yield from sent(gathered)

    return each


def _listed_by(rarity, threshold: float):
    """(bit): of the keys that lines (id, line, words) are listed by."""
    of_blocks = _prefixes(rarity, threshold, 1, as_blocks=False)

    def as_block(batch):
        sizes = np.diff(batch.column("words").offsets.to_numpy()).astype(np.int64)
        h, numbers = np.unique(batch.column("words").flatten().to_numpy().view(np.uint64), return_inverse=True)
        return None, batch.column("id").to_numpy(), batch.column("line").to_numpy(), sizes, numbers, h, []

    def each(batches):
        for batch in of_blocks(as_block(b) for b in batches if b.num_rows):
            for blob in batch.column("rows"):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_unpack(blob.as_py())["word"] & np.uint32(FILTER - 1)).astype(np.int32))], names=["bit"])

    return each


def _may_match(threshold: float, col: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs of places pass the length, positional and sketch filters at a common word; ``pos`` -1 is a signature."""
    n_x, n_y = col["n"][x], col["n"][y]
    less, more = np.minimum(n_x, n_y), np.maximum(n_x, n_y)
    need = np.ceil(threshold / (1 + threshold) * (n_x + n_y) - 1e-9).astype(np.int32)
    spare = need - _shared(less) + 1
    ok = (less >= threshold * more - 1e-9) & (n_x - col["pos"][x] >= spare) & (n_y - col["pos"][y] >= spare)
    at = np.flatnonzero(ok)
    x, y = x[at], y[at]
    low, high = col["low"][x] ^ col["low"][y], col["high"][x] ^ col["high"][y]
    short = less[at] <= SHORT_LINE
    apart = np.bitwise_count(np.where(short, low ^ high, low)).astype(np.int32) + np.bitwise_count(np.where(short, np.uint64(0), high))
    ok[at] = apart <= n_x[at] + n_y[at] - 2 * need[at]
    return ok


PAIRS = "x_id long, x_line int, y_id long, y_line int, hub boolean, least int"


def _candidates(threshold: float, late: bool):
    """Of a bucket's packed rows: pairs of a line and an earlier one that may match.

    Lists are ordered by length, so that a line meets those of about its length
    alone.  In a list longer than SHORT_LIST a line that may match the first of
    its size class is paired with that one alone, and marked.  In the ``late``
    round all open lines are paired with all that may match.
    """

    def pairs_of(col):
        """Pairs of places in rows sorted by (word, n), in any order, and whether one is a list's first."""
        word, n = col["word"], col["n"]
        start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        length = np.diff(np.append(start, len(word)))
        run = np.repeat(np.arange(len(start)), length)
        least = start[run]
        live = np.flatnonzero(length[run] <= SHORT_LIST)
        for d in range(1, SHORT_LIST):
            live = live[live - d >= least[live]]
            live = live[n[live - d] >= threshold * n[live] - 1e-9]
            if not len(live):
                break
            ok = live[_may_match(threshold, col, live, live - d)]
            if len(ok):
                yield ok, ok - d, False
        for k in np.flatnonzero(length > SHORT_LIST).tolist():
            at = np.arange(start[k], start[k] + length[k])
            rest = at
            if not late:
                size = np.floor(np.log(n[at]) / math.log(1 + (1 - threshold) / 2)).astype(np.int64)
                order = np.lexsort((col["line"][at], col["id"][at], size))
                _, first, of = np.unique(size[order], return_index=True, return_inverse=True)
                hub = np.empty(len(at), np.int64)
                hub[order] = at[order[first[of]]]
                near = (hub != at) & _may_match(threshold, col, at, hub)
                if near.any():
                    yield at[near], hub[near], True
                rest = at[~near]
            # of a pair, either may be the later one: both ways round, among all of the list
            low = at[0] + np.searchsorted(n[at], np.ceil(threshold * n[rest] - 1e-9))
            high = at[0] + np.searchsorted(n[at], np.floor(n[rest] / threshold + 1e-9), side="right")
            upto = np.cumsum(high - low)
            i = 0
            while i < len(rest):
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + 400_000)))
                many = (high - low)[i:j]
                x = np.repeat(rest[i:j], many)
                y = np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low[i:j], many)
                later = (col["id"][y] < col["id"][x]) | ((col["id"][y] == col["id"][x]) & (col["line"][y] < col["line"][x]))
                if late:
                    later &= col["open"][x]
                x, y = x[later], y[later]
                ok = _may_match(threshold, col, x, y)
                if ok.any():
                    yield x[ok], y[ok], False
                i = j

    def each(group: pa.Table) -> pa.Table:
        blobs = [_unpack(b.as_py()) for b in group["rows"]]
        rows = {c: np.concatenate([b[c] for b in blobs]) for c, _ in FIELDS}
        del blobs
        # by word and length; words of one line alone go
        order = np.argsort(rows["word"].astype(np.uint64) << np.uint64(32) | rows["n"].astype(np.uint64))
        word = rows["word"][order]
        new = np.concatenate(([True], word[1:] != word[:-1], [True]))
        order = order[~(new[1:] & new[:-1])]
        rows = {c: v[order] for c, v in rows.items()}
        out = []
        if len(order):
            for x, y, hub in pairs_of(rows):
                # x is the later line
                swap = (rows["id"][x] < rows["id"][y]) | ((rows["id"][x] == rows["id"][y]) & (rows["line"][x] < rows["line"][y]))
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                if late:
                    x, y = x[rows["open"][x]], y[rows["open"][x]]
                least = np.where(rows["pos"][x] < 0, 1, _shared(np.minimum(rows["n"][x], rows["n"][y])))
                out.append((rows["id"][x], rows["line"][x], rows["id"][y], rows["line"][y], np.full(len(x), hub), least.astype(np.int32)))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int32, np.bool_, np.int32)]
        del rows, out
        give_back()
        return pa.table(dict(zip(("x_id", "x_line", "y_id", "y_line", "hub", "least"), map(pa.array, cols))))

    return each


def _pairs(packed: DataFrame, threshold: float, late: bool) -> DataFrame:
    """(x_id, x_line, y_id, y_line, hub): candidates that share enough words, or a signature, or a list's first line."""
    found = packed.groupBy("bucket").applyInArrow(_candidates(threshold, late), PAIRS)
    both = found.groupBy("x_id", "x_line", "y_id", "y_line").agg(F.max("hub").alias("hub"), F.min("least").alias("least"), F.count("*").alias("shared"))
    return both.where("(x_id <> y_id or x_line <> y_line) and (hub or shared >= least)").select("x_id", "x_line", "y_id", "y_line", "hub")


def _bit(ident, line):
    m = F.lit(FILTER)
    return F.pmod(F.pmod(F.col(ident), m) * 1000003 + F.col(line), m).cast("int")


def _filter(bits: DataFrame):
    """A broadcast filter of fixed size from a column of bit numbers; it only saves travel."""
    set_ = bits.groupBy(F.shiftright("bit", 3).alias("at")).agg(F.expr("bit_or(shiftleft(1, bit & 7))").cast("short").alias("v")).toArrow()
    out = np.zeros(FILTER // 8, np.uint8)
    out[set_["at"].to_numpy()] = set_["v"].to_numpy()
    return bits.sparkSession.sparkContext.broadcast(out)


def _verified(table: DataFrame, pairs: DataFrame, threshold: float, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, line) of the x of pairs whose word sets are as similar as the threshold; and (id, line, words) of the lines of pairs, at least."""
    shared = _filter(pairs.select(_bit("x_id", "x_line").alias("bit")).union(pairs.select(_bit("y_id", "y_line").alias("bit"))))

    @tidy
    def fetch(batches):
        wanted = np.unpackbits(shared.value, bitorder="little").view(bool)
        for _, ids, lines, sizes, numbers, h, _ in _unpacked(batches):
            keep = wanted[_line_bit(ids, lines)]
            words = h[numbers[np.repeat(keep, sizes)]].view(np.int64)
            upto = np.concatenate(([0], np.cumsum(sizes[keep]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(lines[keep]), pa.ListArray.from_arrays(pa.array(upto), pa.array(words))], names=["id", "line", "words"])

    sets = scratch.table(table.mapInArrow(fetch, "id long, line int, words array<long>"), "sets", "lz4_raw")
    x = sets.select(F.col("id").alias("x_id"), F.col("line").alias("x_line"), F.col("words").alias("x_words"))
    y = sets.select(F.col("id").alias("y_id"), F.col("line").alias("y_line"), F.col("words").alias("y_words"))
    both = pairs.join(x, ["x_id", "x_line"]).join(y, ["y_id", "y_line"])
    common = F.size(F.array_intersect("x_words", "y_words"))
    alike = both.where(common >= threshold * (F.size("x_words") + F.size("y_words") - common) - 1e-9)
    return alike.select(F.col("x_id").alias("id"), F.col("x_line").alias("line")).distinct(), sets


def _keyed(df: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(key, id, text, c0, c1, ...): ``df`` by column places, and a number of each row's own in the order of the ids.

    Null ids count as the last.  The ids themselves serve where no two rows
    share one.  Else rows are numbered in the order of (id, place in the input),
    in a scratch copy, since all scans must see the same numbers.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    placed = df.toDF(*names)
    ident, text = (F.col(names[df.columns.index(c)]) for c in (id_col, text_col))
    ident = F.coalesce(ident.cast("long"), F.lit(LAST_ID))
    placed = placed.select(ident.alias("id"), text.alias("text"), *names)
    if placed.select("id").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return placed.withColumn("key", F.col("id"))
    dealt = placed.withColumn("at", F.monotonically_increasing_id()).repartitionByRange("id", "at").sortWithinPartitions("id", "at")
    return scratch.table(dealt.drop("at").withColumn("key", F.monotonically_increasing_id()), "keyed")


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, line): a row for each line with an earlier line at least as similar as the threshold.

    Lines are numbered from 0 between line feeds; lines without words are never
    removed.  Null ids count as the last id.  Rows that share an id are documents
    of their own, in the order of the input.
    """
    keyed = _keyed(df, id_col, text_col, Scratch(df.sparkSession, "line-keys"))
    gone = _removed(keyed, threshold).withColumnRenamed("id", "of")
    return gone.join(keyed.select("key", "id"), F.col("of") == F.col("key")).select("id", "line")


def _removed(keyed: DataFrame, threshold: float) -> DataFrame:
    """(id, line) as ``removed_lines``, the id being ``key``, which no two rows share."""
    spark = keyed.sparkSession
    scratch = Scratch(spark, "lines")
    table = scratch.table(keyed.select("key", "text").mapInArrow(_block_table, TABLE), "blocks", "lz4_raw")  # the large columns are squeezed already
    # equal sets: all but the first go
    keys = scratch.table(table.mapInArrow(_line_keys, "set_a long, set_b long, id long, line int, block long, at int"), "keys", "lz4_raw")  # hashes are as good as random
    firsts = keys.groupBy("set_a", "set_b").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n")).where("n > 1").select("set_a", "set_b", "first")
    firsts = scratch.table(firsts, "first_of_set", "lz4_raw")
    equal = scratch.table(keys.join(firsts, ["set_a", "set_b"]).where("id > first.id or (id = first.id and line > first.line)").select("id", "line", "block", "at"), "equal")
    scratch.drop(keys, firsts)
    # rarity, by buckets: a byte each comes to the driver
    counted = table.mapInArrow(_counts(threshold), "chunk long, counts binary, prefixes long").groupBy("chunk").applyInArrow(_ranks, "chunk long, ranks binary, prefixes long")
    counted, rank = counted.collect(), np.zeros(BUCKETS, np.uint8)
    for r in counted:
        rank[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["ranks"], np.uint8)
    rows = sum(r["prefixes"] for r in counted)
    rarity = spark.sparkContext.broadcast(rank)
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
    # lines that share a prefix word, the first of equal sets alone; a block's list is as long as the block at most
    skips = equal.groupBy("block").agg(F.collect_list("at").alias("skip"))
    firsts = scratch.table(table.join(skips, "block", "left"), "firsts", "lz4_raw")
    scratch.drop(table)
    pairs = scratch.table(_pairs(firsts.mapInArrow(_prefixes(rarity, threshold, n_buckets), "bucket long, rows binary"), threshold, False), "pairs")
    scratch.release()
    found, sets = _verified(firsts, pairs.drop("hub"), threshold, scratch)
    settled = scratch.table(found, "settled")
    # lines held against the first of a long list alone, and not settled: against all others that share a word
    open_ = scratch.table(pairs.where("hub").select(F.col("x_id").alias("id"), F.col("x_line").alias("line")).distinct().join(settled, ["id", "line"], "left_anti"), "open")
    late = None
    if not open_.isEmpty():
        of_lines = _filter(open_.select(_bit("id", "line").alias("bit")))
        of_words = _filter(sets.join(open_, ["id", "line"], "left_semi").mapInArrow(_listed_by(rarity, threshold), "bit int"))
        packed = firsts.mapInArrow(_prefixes(rarity, threshold, n_buckets, of_lines, of_words), "bucket long, rows binary")
        rest = scratch.table(_pairs(packed, threshold, True).drop("hub"), "rest")
        late, _ = _verified(firsts, rest, threshold, scratch)
    out = equal.select("id", "line").union(settled)
    out = scratch.table((out if late is None else out.union(late)).distinct(), "removed")
    scratch.drop(firsts, equal, pairs, settled, open_, sets)
    return out


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``df``, their texts without the lines that ``removed_lines`` names.

    Rows that share an id, null or not, are documents of their own: each loses
    its own lines only.  A text may become empty; a null text stays null; an
    empty table gives no rows.  Columns of any name may be there besides.
    """
    scratch = Scratch(df.sparkSession, "line-dedup")
    keyed = _keyed(df, id_col, text_col, scratch)
    gone = _removed(keyed, threshold).groupBy("id").agg(F.sort_array(F.collect_list("line")).alias("gone")).withColumnRenamed("id", "of")  # at most the lines of one document in a row
    scratch.release()
    place, fields = df.columns.index(text_col), df.schema.fields

    @tidy
    def each(batches):
        for b in batches:
            texts, lines = b.column(place), b.column(b.num_columns - 1)
            cut = pc.and_(texts.is_valid(), lines.is_valid())
            kept = []
            for text, gone in zip(texts.filter(cut).to_pylist(), lines.filter(cut).to_pylist()):
                drop = set(gone)
                kept.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop))
            cols = b.columns[:-1]
            cols[place] = pc.replace_with_mask(texts, cut, pa.array(kept, texts.type)) if kept else texts
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    names = [f"c{i}" for i in range(len(fields))]
    # keys are unique, and the lists are much smaller than the texts, which need not be sorted
    joined = keyed.drop("id", "text").join(gone.hint("shuffle_hash"), F.col("key") == F.col("of"), "left").select(*names, "gone")
    return joined.mapInArrow(each, StructType([StructField(n, f.dataType) for n, f in zip(names, fields)])).toDF(*df.columns)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs)
