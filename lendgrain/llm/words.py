"""Words and shingles of Arrow text batches, as numpy arrays over the bytes.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``; A-Z count as a-z. Nulls are
empty texts. Batches are cut so that one cut holds about ``CUT`` bytes of text (a
longer text is a cut of its own), which bounds a task's memory by its longest text.

Hashes have 64 bits. Words of shingles are hashed by mixing eight bytes at a time; a
shingle's hash is a random linear function of its words' hashes, mixed. Where
any stretch of bytes may be asked for, its hash is a polynomial in random values of
its bytes, from differences of running sums; that serves statistics and features, as
long words of a certain structure can share such hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CUT = 2_000_000
SHINGLE = 5

_random = np.random.default_rng(20240229)
BYTE_VALUES = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
PLACES = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 2**64)
#: Masks of the first 0 to 8 bytes of eight; words of more bytes are hashed by themselves.
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
LONG_WORD = 4096
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int, least: int = 21) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; 2 ** least of them are kept at once."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1 << max(least, (n - 1).bit_length()), np.uint64)
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        if len(have) > 1 << 23:
            return have[:n]  # for a very long text only; not kept
        _powers[base] = have
    return have[:n]


class Texts:
    """The bytes of some texts, end to end. ``edges[i]`` is where text i starts."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        n = len(column)
        _, offsets, data = column.buffers()
        edges = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        low, high = int(edges[0]), int(edges[-1])
        self.data = np.frombuffer(data, np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
        self.edges = edges - low

    def __len__(self) -> int:
        return len(self.edges) - 1

    def owner(self, counts_from: np.ndarray) -> np.ndarray:
        """Text that each of some sorted byte positions lies in."""
        return np.repeat(np.arange(len(self)), np.diff(np.searchsorted(counts_from, self.edges)))

    def words(self, between: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of every word, with a table of the bytes between words."""
        inside = ~between[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        filled = np.flatnonzero(np.diff(self.edges))
        starts, ends = self.edges[:-1][filled], self.edges[1:][filled] - 1
        first[starts] = inside[starts]
        last[ends] = inside[ends]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def running(self) -> np.ndarray:
        """Running polynomial sums; entry i covers the bytes before i."""
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[self.data] * powers(BASE, len(self.data)), out=sums[1:])
        return sums

    @staticmethod
    def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each stretch of bytes, the same wherever the stretch lies."""
        unshift = powers(UNBASE, len(sums))
        return mix((sums[ends] - sums[starts]) * unshift[starts])


def hashes_of_words(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two independent 64-bit hashes of each word, A-Z as a-z.

    Eight bytes at a time are mixed into what came before, for all words that are that long; words of
    up to eight bytes never collide with each other. Very long words are hashed one by one.
    """
    data = LOWER[np.concatenate((texts.data, np.zeros(8, np.uint8)))]
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    length = ends - starts
    out = mix(length.astype(np.uint64)[:, None] ^ PLACES[20:22])
    at = np.flatnonzero(length <= LONG_WORD)
    place, left = starts[at], length[at]
    while len(at):
        chunk = eight[place] & FIRST_BYTES[np.minimum(left, 8)]
        out[at, 0] = mix(out[at, 0] ^ chunk)
        out[at, 1] = mix(out[at, 1] + chunk * PLACES[22])
        more = left > 8
        at, place, left = at[more], place[more] + 8, left[more] - 8
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = np.frombuffer(xxhash.xxh3_128_digest(data[starts[i]:ends[i]].tobytes()), "<u8")
    return out


def sequences(word_hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of k words within one text."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = word_hashes[:n] * PLACES[0]
    for j in range(1, k):
        total = total + word_hashes[j:n + j] * PLACES[j]
    whole = np.flatnonzero(owner[:n] == owner[k - 1:])
    return mix(total[whole]), whole


def shingles(texts: Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every shingle; repeats stay.

    A text with 1 to k - 1 words has one shingle, its whole sequence; one without words none.
    """
    starts, ends = texts.words()
    owner = texts.owner(starts)
    hashed = hashes_of_words(texts, starts, ends)[:, 0]
    found, at = sequences(hashed, owner, k)
    texts_of = owner[at]
    counts = np.bincount(owner, minlength=len(texts))
    begin = np.concatenate(([0], np.cumsum(counts)))
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        short = np.array([
            (hashed[begin[t]:begin[t + 1]] * PLACES[:counts[t]]).sum(dtype=np.uint64) + np.uint64(counts[t])
            for t in few], np.uint64)
        texts_of, found = np.concatenate((texts_of, few)), np.concatenate((found, mix(short)))
    return texts_of, found


def distinct(owner: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs without repeats, sorted by owner and value."""
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
    return owner[new], values[new]


def cuts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Pieces of batches with about ``CUT`` bytes of text each."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, low = np.cumsum(lengths), 0
        while low < batch.num_rows:
            before = total[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(total, before + CUT, "right")))
            piece = batch.slice(low, high - low)
            yield piece, Texts(piece.column(column))
            low = high


def table(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch from numpy arrays or Arrow arrays by name."""
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, schema.field(n).type) for n, v in columns.items()], schema=schema)
