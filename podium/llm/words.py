"""Word splitting and cached encoding by a public tokenizer file.

No token of the tokenizer spans white space and none of its rules looks across
it, so a text's ids are those of its white-space separated words in a row.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash

#: str.split() also splits at these, which Unicode does not call white space.
_ODD = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[ \t\n\r\x0b\x0c\x85\xa0  -     　]+")
#: Characters of text handled at a time, and words and parts of words that a process remembers.
BLOCK_CHARS, WORDS_KEPT, PARTS_KEPT = 4_000_000, 500_000, 100_000


def words(text: str | None) -> list[str]:
    """The words of a text between Unicode white space."""
    if not text:
        return []
    if _ODD.search(text):
        return [w for w in _SPACE.split(text) if w]
    return text.split()


def tidy(each):
    """A generator function that gives freed memory back to the system when it ends, since Python workers outlive their tasks."""

    @functools.wraps(each)
    def tidied(*args):
        try:
            yield from each(*args)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_LOADED: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once a process, without truncation, padding or threads."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes: printable Latin-1 characters for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_PART = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def parts(word: str) -> tuple[str, ...] | list[str]:
    """Pieces of a word that the tokenizer encodes one by one, in lower case.

    Below U+0250 text is its own normal form, so lower case and the split into
    letters, digits and others are all that comes before the model.  Words with
    other characters, apostrophes (contractions) or ``<|`` (special tokens)
    stay whole, as they are.
    """
    if word.isascii() and word.isalpha():
        return (word.lower(),)
    if max(word) < "\u0250" and "'" not in word and "<|" not in word:
        low = word.lower()
        return (low,) if low.isalpha() else _PART.findall(low)
    return (word,)


#: Words that stay whole; parts of the others, and the line feeds between them.
_WHOLE = r"['\x{250}-\x{10FFFF}]|<\|"
_PART_OR_FEED = regex.compile(_PART.pattern + r"|\n")
#: Bytes by kind: others, letters, digits, and 3 where a byte alone doesn't tell.  0xC3 leads the letters from U+00C0 to U+00FF.
_KIND = np.array([3 if b == 39 or 28 <= b <= 31 or b > 127 and b != 0xC3 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 0 for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def parts_of_all(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many ``parts`` each of the words has, and all parts in a row; no word is empty or has a line feed.

    Words of ASCII and the letters from U+00C0 to U+00FF are parted by their bytes, all at once.
    """
    if not len(words):
        return np.empty(0, np.int64), words
    edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    x = np.frombuffer(words.buffers()[2], np.uint8)[edges[0] : edges[-1]]
    start, length = edges[:-1] - edges[0], np.diff(edges)
    kind, low = _KIND[x], _LOWER[x]
    second = np.flatnonzero(x[:-1] == 0xC3) + 1
    kind[second] = np.where((x[second] == 0x97) | (x[second] == 0xB7), 3, 1)  # signs, not letters
    low[second] += np.where(x[second] <= 0x9E, 32, 0).astype(np.uint8)
    kind[:-1][(x[:-1] == ord("<")) & (x[1:] == ord("|"))] = 3
    hard = np.logical_or.reduceat(kind == 3, start)
    new = np.ones(len(x), bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    kept = np.repeat(hard, length)
    new[kept], low[kept] = False, x[kept]
    new[start] = True
    counts = np.add.reduceat(new.astype(np.int64), start)
    at = np.append(np.flatnonzero(new), len(x))
    found = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(low)])
    hard = np.flatnonzero(hard)
    others = words.take(pa.array(hard))
    split = ~pc.match_substring_regex(others, _WHOLE).to_numpy(zero_copy_only=False)
    if not split.any():
        return counts, found
    tokens = pa.array(_PART_OR_FEED.findall("\n".join([*others.filter(pa.array(split)).to_pylist(), ""]).lower()), pa.large_string())
    feeds = pc.equal(tokens, "\n").to_numpy(zero_copy_only=False)
    again = np.zeros(len(words), bool)
    again[hard[split]] = True
    first = np.flatnonzero(~np.repeat(again, counts))
    counts[again] = np.diff(np.flatnonzero(feeds), prepend=-1) - 1
    tokens = tokens.filter(pa.array(~feeds))
    of_again = np.repeat(again, counts)
    place = np.empty(len(of_again), np.int64)
    place[~of_again], place[of_again] = first, len(found) + np.arange(len(tokens))
    return counts, pa.concat_arrays([found, tokens]).take(pa.array(place))


class PartEncoder:
    """Encodes parts of words: the model's own way for plain Latin ones, the tokenizer's for others."""

    def __init__(self, path: str) -> None:
        self.whole = tokenizer(path)
        self.model = self.whole.model

    def __call__(self, part: str) -> list[int]:
        if part.isascii() and part.isalpha():
            return [t.id for t in self.model.tokenize(part.lower())]
        if max(part) < "\u0250" and "'" not in part and "<|" not in part:
            return [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(_LETTERS))]
        return self.whole.encode(part, add_special_tokens=False).ids


class Split:
    """The white-space separated words of a column of texts, as places in its bytes.

    ``data`` holds the bytes of all texts (and eight zeros), ``starts`` and
    ``ends`` the words' places there, ``sizes`` how many words each text has.
    Null texts have none.  ``controls`` are the characters U+001C to U+001F,
    which str.split() takes for white space and Unicode does not.
    """

    def __init__(self, column: pa.Array, controls: bool = False) -> None:
        column = pc.fill_null(column, "").cast(pa.large_string())
        edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        n = int(edges[-1] - edges[0])
        self.data = np.zeros(n + 8, np.uint8)
        if n:
            self.data[:n] = np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]]
        self.edges = edges - edges[0]
        # unsigned differences wrap: each is one comparison for a range
        word = self.data - np.uint8(9) >= 5
        word &= self.data != 32
        if controls:
            word &= self.data - np.uint8(28) >= 4
        leads = np.flatnonzero(self.data[:n] >= 0xC2)
        leads = leads[_WIDE_LEAD[self.data[leads]]]
        lead_bytes = self.data[leads]
        for lead, second, third in _WIDE_SPACES:
            at = leads[lead_bytes == lead]
            at = at[np.isin(self.data[at + 1], second)]
            if third:
                at = at[np.isin(self.data[at + 2], third)]
                word[at + 2] = False
            word[at] = word[at + 1] = False
        word[n:] = False
        begins = word[:n].copy()
        begins[1:] &= ~word[: n - 1] if n else True
        stops = word[:n] & ~word[1 : n + 1]
        inner = self.edges[(self.edges > 0) & (self.edges < n)]  # a word ends with its text
        begins[inner] = word[inner]
        stops[inner - 1] = word[inner - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.sizes = np.diff(np.searchsorted(self.starts, self.edges))

    def _eights(self) -> np.ndarray:
        """Eight bytes from each place on, as one number."""
        return np.ndarray((len(self.data) - 7,), np.uint64, self.data, strides=(1,))

    def hashes(self) -> np.ndarray:
        """64 bits of each word."""
        eights, length = self._eights(), self.ends - self.starts
        h = _mixed(length.astype(np.uint64) * _MIX[0] ^ (eights[self.starts] & _LOW_BYTES[np.minimum(length, 8)]))
        live = np.flatnonzero(length > 8)
        for k in range(8, _LONG, 8):
            if not len(live):
                break
            rest = length[live] - k
            h[live] = _mixed(h[live] ^ (eights[self.starts[live] + k] & _LOW_BYTES[np.minimum(rest, 8)]))
            live = live[rest > 8]
        for i in np.flatnonzero(length > _LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes())
        return h

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each word, place of each number's first word, its hash); equal words have one number, no others do."""
        h = self.hashes()
        coded = pa.array(h).dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.empty(len(coded.dictionary), np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        eights, length = self._eights(), self.ends - self.starts
        same = True
        for i in range(0, len(number), 1 << 18):
            like = first[number[i : i + (1 << 18)]]
            live = np.flatnonzero(like != np.arange(i, i + len(like)))
            at, to, rest = self.starts[i + live], self.starts[like[live]], length[i + live]
            same &= bool((rest == length[like[live]]).all())
            while same and len(at):
                same = not ((eights[at] ^ eights[to]) & _LOW_BYTES[np.minimum(rest, 8)]).any()
                more = rest > 8
                at, to, rest = at[more] + 8, to[more] + 8, rest[more] - 8
        if not same:  # two words of one hash
            known: dict[bytes, int] = {}
            number = np.fromiter((known.setdefault(w, len(known)) for w in map(self.word, range(len(length)))), np.int64, len(length))
            first = np.empty(len(known), np.int64)
            first[number[::-1]] = np.arange(len(number))[::-1]
        return number, first, h[first]

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def words(self, which: np.ndarray) -> pa.Array:
        """The words of these numbers."""
        start, length = self.starts[which], self.ends[which] - self.starts[which]
        upto = np.concatenate(([0], np.cumsum(length)))
        data = self.data[np.arange(upto[-1]) + np.repeat(start - upto[:-1], length)]
        return pa.Array.from_buffers(pa.large_string(), len(which), [None, pa.py_buffer(upto), pa.py_buffer(data)])


_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_LOW_BYTES = np.array([0, *((1 << 8 * k) - 1 for k in range(1, 9))], np.uint64)
#: Words longer than so many bytes are hashed one by one.
_LONG = 1024
#: Unicode white space beyond ASCII, as UTF-8: first byte, second bytes, third bytes.
_WIDE_SPACES = ((0xC2, [0x85, 0xA0], []), (0xE1, [0x9A], [0x80]), (0xE2, [0x80], [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]), (0xE2, [0x81], [0x9F]), (0xE3, [0x80], [0x80]))
_WIDE_LEAD = np.isin(np.arange(256), [lead for lead, *_ in _WIDE_SPACES])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[1]
    x ^= x >> np.uint64(27)
    x *= _MIX[2]
    x ^= x >> np.uint64(31)
    return x


class WordIds:
    """Ids of texts, word by word.

    A process remembers words of up to 16 bytes that it has met, in arrays
    sorted by hash, whatever task it met them in; words used least lately are
    forgotten.  A hit is one only if all bytes agree.
    """

    _shared: dict = {}

    def __new__(cls, path: str):
        if path not in cls._shared:
            made = cls._shared[path] = super().__new__(cls)
            made.encode, made.parts, made.block = PartEncoder(path), {}, 0
            #: hash, first and second eight bytes, length, first id, number of ids, block of the last use
            made.known = [np.empty(0, np.uint64) for _ in range(3)] + [np.empty(0, np.int64) for _ in range(4)]
            made.flat = np.empty(0, np.uint32)
        return cls._shared[path]

    def _of_word(self, word: bytes) -> list[int]:
        ids: list[int] = []
        for p in parts(word.decode()):
            got = self.parts.get(p)
            if got is None:
                got = self.parts[p] = self.encode(p)
            ids = ids + got if ids else got
        return ids

    def _forget(self) -> None:
        """Keeps the half used last."""
        stamp = self.known[6]
        keep = np.sort(np.argsort(-stamp, kind="stable")[: WORDS_KEPT // 2])
        self.known = [x[keep] for x in self.known]
        first, count = self.known[4:6]
        ends = np.cumsum(count)
        self.flat = self.flat[np.arange(ends[-1]) + np.repeat(first - ends + count, count)]
        self.known[4] = ends - count

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        if len(self.known[0]) > WORDS_KEPT:
            self._forget()
        if len(self.parts) > PARTS_KEPT:
            self.parts = {}
        self.block += 1
        split = Split(column)
        number, first, h = split.distinct()
        at = split.starts[first]
        length = split.ends[first] - at
        eights = split._eights()
        one = eights[at] & _LOW_BYTES[np.minimum(length, 8)]
        two = eights[np.minimum(at + 8, len(eights) - 1)] & _LOW_BYTES[np.clip(length - 8, 0, 8)]
        place = np.minimum(np.searchsorted(self.known[0], h), len(self.known[0]) - 1)
        hit = length <= 16
        if len(self.known[0]):
            for mine, theirs in zip((h, one, two, length), self.known):
                hit &= theirs[place] == mine
        else:
            hit[:] = False
        self.known[6][place[hit]] = self.block
        fresh = np.flatnonzero(~hit)
        got = [self._of_word(split.word(i)) for i in first[fresh].tolist()]
        flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(got), np.uint32)))
        count_of, first_of = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
        count_of[hit], first_of[hit] = self.known[5][place[hit]], self.known[4][place[hit]]
        count_of[fresh] = np.fromiter(map(len, got), np.int64, len(got))
        first_of[fresh] = len(self.flat) + np.cumsum(count_of[fresh]) - count_of[fresh]
        count = count_of[number]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        out = flat[np.arange(total) + np.repeat(first_of[number] - ends + count, count)]
        upto = np.concatenate(([0], ends))[np.cumsum(split.sizes)]
        fresh = fresh[length[fresh] <= 16]
        if len(fresh):
            new = (h[fresh], one[fresh], two[fresh], length[fresh], first_of[fresh], count_of[fresh], np.full(len(fresh), self.block))
            known = [np.concatenate(x) for x in zip(self.known, new)]
            order = np.argsort(known[0])
            self.known, self.flat = [x[order] for x in known], flat
        return out, np.diff(upto, prepend=0)


def blocks(batch: pa.RecordBatch, text_at: int = 1, chars: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about so many bytes of text; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > chars:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)
