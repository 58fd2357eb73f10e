"""Words and word sets of many texts at once, as 64-bit hashes in numpy arrays.

Words are runs of other than space, tab, line feed, vertical tab, form feed and carriage return;
A-Z are lower-cased. A *unit* is a whole text or a line of one. Equal sets get equal keys; two
different words, shingles or sets share a hash with a probability of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; one text is never divided.
CHUNK_BYTES = 1 << 18
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int, known: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base**0 ... base**(n - 1) modulo 2**64; those that a usual chunk needs are kept."""
    if base in known and len(known[base]) >= n:
        return known[base][:n]
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= 4 * CHUNK_BYTES:
        known[base] = out
    return out


class Words(NamedTuple):
    """Hashes of all words of some units; unit i owns words[starts[i]:starts[i + 1]]."""

    words: np.ndarray
    starts: np.ndarray


class Sets(NamedTuple):
    """Distinct tokens of some units in a given order; unit i owns tokens[starts[i]:starts[i + 1]]."""

    tokens: np.ndarray
    starts: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.sizes)

    @property
    def position(self) -> np.ndarray:
        return np.arange(len(self.tokens)) - np.repeat(self.starts[:-1], self.sizes)


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows and the end) for runs of rows; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """The words of units that lie one after the other in data."""
    # whole-array arithmetic on bytes: a look-up by bytes would first turn them into indexes of 64 bits
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = (data - np.uint8(9) >= 5) & (data != 32)
    lower = data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))
    first = inside[1:] & ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inside[1:][cuts]
    begin = np.flatnonzero(first)
    # a word ends before white space, the next unit or the end
    last = inside[1:].copy()
    last[:-1] &= ~inside[2:]
    ahead = cuts[cuts > 0]
    last[ahead - 1] = inside[ahead]
    end = np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data) + 1)[:-1], out=total[1:])
    words = mixed((total[end] - total[begin]) * powers(INVERSE, len(data) + 1)[begin]) if len(begin) else np.zeros(0, np.uint64)
    return Words(words, np.searchsorted(begin, offsets))


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the lines of all texts, the text each belongs to, and its number therein.

    A line feed belongs to the line that it ends; an empty text has one empty line.
    """
    after = np.flatnonzero(data == 10) + 1
    text = np.searchsorted(offsets, after - 1, "right") - 1
    count = np.bincount(text, minlength=len(offsets) - 1) + 1
    owner = np.repeat(np.arange(len(offsets) - 1), count)
    first = np.cumsum(count) - count
    number = np.arange(len(owner)) - first[owner]
    begin = np.empty(len(owner) + 1, np.int64)
    begin[:-1][number == 0] = offsets[:-1]
    begin[:-1][number > 0] = after
    begin[-1] = offsets[-1]
    return begin, owner, number


def shingles(units: Words, size: int) -> Words:
    """All runs of ``size`` words of each unit; the whole unit as one if it has fewer words but any."""
    words, starts = units
    n = np.diff(starts)
    factors = powers(0xD6E8FEB86659FD93, size + 1)[1:]
    short = np.flatnonzero((n > 0) & (n < size))
    full = max(0, len(words) - size + 1)
    rolled = np.zeros(full, np.uint64)
    for k in range(size):
        rolled += words[k : k + full] * factors[k]
    position = np.arange(len(words)) - np.repeat(starts[:-1], n)
    begins = position <= np.repeat(n, n) - size
    out = np.zeros(len(words), np.uint64)
    out[:full] = rolled
    for i in short:  # the sum over a short unit, told apart from full runs by its length
        own = words[starts[i] : starts[i + 1]]
        out[starts[i]] = (own * factors[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    begins[starts[:-1][short]] = True
    kept = np.maximum(n - size + 1, (n > 0).astype(np.int64))
    return Words(mixed(out[begins]), np.concatenate([[0], np.cumsum(kept)]))


def distinct(units: Words, rank=None) -> Sets:
    """Distinct tokens of each unit, by ``rank`` of the token (lower first) and then by hash."""
    tokens, place = np.unique(units.words, return_inverse=True)
    if rank is not None and len(tokens):
        order = np.argsort(rank(tokens), kind="stable")
        to = np.empty(len(order), np.int64)
        to[order] = np.arange(len(order))
        tokens, place = tokens[order], to[place]
    n = len(units.starts) - 1
    bits = max(1, int(len(tokens)).bit_length())
    keys = (np.repeat(np.arange(n), np.diff(units.starts)) << bits) | place
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return Sets(tokens[keys & ((1 << bits) - 1)], np.searchsorted(keys >> bits, np.arange(n + 1)))


def reduced(ufunc: np.ufunc, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """ufunc.reduce over each unit's values; 0 for a unit without any."""
    out = np.zeros(len(starts) - 1, values.dtype)
    some = np.diff(starts) > 0
    if some.any():
        out[some] = ufunc.reduceat(values, starts[:-1][some])
    return out


def set_keys(sets: Sets) -> np.ndarray:
    """A signed 64-bit key of each set, whatever the order of its tokens."""
    total = reduced(np.add, mixed(sets.tokens + np.uint64(0x632BE59BD9B4E019)), sets.starts)
    return mixed(total + sets.sizes.astype(np.uint64) * np.uint64(BASE)).view(np.int64)


def parity(sets: Sets, words: np.ndarray | int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(words, starts): 64 parity bits per word and set; two sets differ in as many tokens as bits, or more.

    With a power of two of words, the bits of a set can be folded to those of fewer words.
    """
    words = np.broadcast_to(words, len(sets.starts) - 1).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(words)])
    owner = sets.owner
    bit = (sets.tokens >> np.uint64(40)) % (words[owner].astype(np.uint64) << np.uint64(6))
    out = np.zeros(starts[-1], np.uint64)
    np.bitwise_xor.at(out, starts[owner] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out, starts


def sized_parity(sets: Sets, least: int) -> list[bytes]:
    """Parity bits of each set, about as many as it has tokens: a power of two of words, ``least`` or more."""
    words = np.maximum(least, 1 << np.ceil(np.log2(np.maximum(sets.sizes, 1) / 64)).astype(np.int64).clip(0))
    out, starts = parity(sets, words)
    raw, cut = out.tobytes(), (8 * starts).tolist()
    return [raw[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]


def differing_bits(a: bytes, b: bytes) -> int:
    """Differing parity bits of two sets; the longer ones are folded to the length of the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, n), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())
