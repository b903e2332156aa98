"""Vectorised word splitting and hashing over the byte buffers of Arrow string columns.

Words are found and hashed with array operations on the UTF-8 bytes, a bounded block of bytes at a
time, so that memory depends on the block and on the number of words, not on the text as objects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

_U = np.uint64
_GRAM = _U(0xD6E8FEB86659FD93)
_GRAM2 = _U(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (the splitmix64 constants)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Bytes of a lane, and what of a lane's eight bytes belongs to a word of so many bytes more.
_LANE_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SEEDS = (_U(0x2545F4914F6CDD1D), _U(0x9FB21C651E98DF25))
_places: dict[int, np.ndarray] = {}


def _place_codes(which: int, n: int) -> np.ndarray:
    """A code for each of the first n places of lanes in a word."""
    have = _places.get(which)
    if have is None or len(have) < n:
        have = mix(np.arange(1, max(64, n) + 1, dtype=np.uint64) * _SEEDS[which])
        if n <= 1 << 16:
            _places[which] = have
    return have


def byte_class(word_bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, the byte after folding A-Z) for each of the 256 bytes."""
    member = np.zeros(256, bool)
    member[list(word_bytes)] = True
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return member, fold


_SPACES = {0x20, *range(0x09, 0x0E)}
#: `[^\x20\x09-\x0D]+`, as written
PLAIN_WORDS = byte_class(set(range(256)) - _SPACES, lower=False)
#: the same, A-Z lower-cased
FOLDED_WORDS = byte_class(set(range(256)) - _SPACES, lower=True)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM_WORDS = byte_class({*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}, lower=True)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


#: Words are also cut between a letter A-Z or a-z and an ASCII character that is neither letter nor space.
LETTER_CUTS = np.zeros((2, 256), bool)
LETTER_CUTS[0, [*range(65, 91), *range(97, 123)]] = True
LETTER_CUTS[1, [b for b in range(128) if b not in _SPACES and not LETTER_CUTS[0, b]]] = True


def _find_words(raw: np.ndarray, cuts: np.ndarray, member: np.ndarray, between: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in raw; no word crosses a cut, nor a place between a byte of the first and one of the second kind of `between`."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = member[raw]
    here, before, after = inside[1:-1], inside[:-2].copy(), inside[2:].copy()
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    before[cuts] = False
    after[cuts - 1] = False
    if between is not None:
        cut = between[0][raw[:-1]] & between[1][raw[1:]]
        before[1:] &= ~cut
        after[:-1] &= ~cut
    return np.flatnonzero(here & ~before), np.flatnonzero(here & ~after) + 1


def _hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: the sum over its lanes of eight bytes of mix(lane ^ code of its place), mixed with its length.

    Up to eight bytes no two words of a length share a hash, and no arithmetic pattern in longer ones
    cancels out. which: the first or the second of two independent hashes.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    folded = np.concatenate([fold[raw], np.zeros(8, np.uint8)])
    lanes = (ends - starts + 7) >> 3
    first = np.cumsum(lanes) - lanes
    place = np.arange(int(lanes.sum())) - np.repeat(first, lanes)
    at = np.repeat(starts, lanes) + 8 * place
    lane = np.ndarray(len(raw) + 1, "<u8", folded, strides=(1,))[at] & _LANE_MASK[np.minimum(np.repeat(ends, lanes) - at, 8)]
    value = np.add.reduceat(mix(lane ^ _place_codes(which, int(lanes.max()))[place]), first)
    return mix(value + (ends - starts).astype(np.uint64) * _GRAM2)


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about limit bytes together; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of a run of texts: hashes, byte ranges (from `base` in the buffer), and the texts' bounds.

    hashes[bounds[k]:bounds[k+1]] are the words of the k-th text, in order. With twice, `second` has
    a second, independent hash of each word.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, kind: tuple[np.ndarray, np.ndarray], between: np.ndarray | None = None, twice: bool = False):
        member, fold = kind
        self.base = int(offsets[0])
        self.raw = raw[self.base : int(offsets[-1])]
        self.cuts = cuts = offsets - self.base
        starts, ends, hashes, second = [], [], [], []
        at, n = 0, len(self.raw)
        while at < n:
            to = min(n, at + 2 * BLOCK_BYTES - 1)
            if to < n:  # only within a text longer than a block: cut after a separator
                gaps = np.flatnonzero(~member[self.raw[at:to]])
                step = 2 * BLOCK_BYTES
                while not len(gaps) and to < n:
                    to = min(n, to + step)
                    gaps = np.flatnonzero(~member[self.raw[at:to]])
                if to < n:
                    to = at + int(gaps[-1]) + 1
            part = self.raw[at:to]
            s, e = _find_words(part, cuts - at, member, between)
            hashes.append(_hash_words(part, s, e, fold))
            if twice:
                second.append(_hash_words(part, s, e, fold, 1))
            starts.append(s + at)
            ends.append(e + at)
            at = to
        none = np.zeros(0, np.int64)
        self.starts = np.concatenate(starts) if starts else none
        self.ends = np.concatenate(ends) if ends else none
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.second = np.concatenate(second) if second else np.zeros(0, np.uint64)
        self.bounds = np.searchsorted(self.starts, cuts, side="left")
        self.bounds[-1] = len(self.starts)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def grams(hashes: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hashes of all runs of k consecutive words; across text bounds too, which the caller leaves out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = _GRAM2 if second else _GRAM
    value = hashes[:n].copy()
    for j in range(1, k):
        value *= factor
        value += hashes[j : j + n]
    return mix(value + _U(k))


def gram_texts(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of runs of k words inside one text, the text of each)."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(len(owner)) + first, owner


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    run, span = values, 1
    while span * 2 <= width:
        run = np.minimum(run[:-span], run[span:])
        span *= 2
    rest = width - span
    return np.minimum(run[:n], run[rest : rest + n])
