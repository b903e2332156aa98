"""Encoding of whole texts by way of their white-space-delimited chunks.

For tokenizers that drop white space, no token crosses it, so a text's ids are those of its chunks
in order. Chunks also end between a letter A-Z or a-z and an ASCII character that is no letter, as
the pieces of these tokenizers do; tokenizer files with another pattern are refused. Chunks are hashed and looked up a block of text at a time, with array operations, in an
open-addressing table; a chunk that isn't there is encoded once and put in. The table holds a
bounded number of chunks and ids (about 40 MB by default), however large the input is.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from peakloom.llm.textblocks import FOLDED_WORDS, LETTER_CUTS, PLAIN_WORDS, Words, blocks, text_bytes

_U = np.uint64
_GOLDEN = _U(0x9E3779B97F4A7C15)


#: Patterns of pre-tokenizers, as written in tokenizer files, that match no white space and none of whose
#: alternatives goes from an ASCII letter on to an ASCII character that is no letter (fixed values).
WORD_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)


def lower_cases(path: str) -> bool:
    """Whether a tokenizer file lower-cases texts; ValueError if its pieces aren't known to end at white space and behind ASCII letters."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    parts = spec.get("pre_tokenizer") or {}
    split = next((x for x in parts.get("pretokenizers", [parts]) if x.get("type") == "Split"), {})
    if not split.get("invert") or split.get("behavior") != "Removed" or split["pattern"].get("Regex") not in WORD_PATTERNS:
        raise ValueError(f"{path}: its tokens may cross white space")
    normalizer = spec.get("normalizer") or {}
    return any(n["type"] == "Lowercase" for n in normalizer.get("normalizers", [normalizer] if normalizer else []))


class HashTable:
    """Numbers from 0 of 64-bit keys (under 2^64 - 1), by open addressing; `most` keys at most, then it is emptied."""

    def __init__(self, most: int):
        bits = max(4, (2 * most - 1).bit_length())  # at most half full
        self._most, self._shift, self._mask = most, _U(64 - bits), (1 << bits) - 1
        self.clear()

    @classmethod
    def of(cls, numbers: dict[int, int]) -> HashTable:
        table = cls(len(numbers) + 1)
        table.put(np.array(list(numbers), np.uint64), np.array(list(numbers.values()), np.int32))
        return table

    def clear(self) -> None:
        self._keys = np.zeros(self._mask + 1, np.uint64)  # a key is stored as itself + 1; 0: free
        self._numbers = np.zeros(self._mask + 1, np.int32)
        self._held = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _GOLDEN) >> self._shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        keys, slot, rest = keys + _U(1), self._slot(keys), None
        while len(keys):
            here = self._keys[slot]
            hit = here == keys
            out[hit if rest is None else rest[hit]] = self._numbers[slot[hit]]
            on = np.flatnonzero(~hit & (here != 0))
            keys, slot, rest = keys[on], (slot[on] + 1) & self._mask, on if rest is None else rest[on]
        return out

    def put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Put in distinct keys that are not there; more than there is room for are left out."""
        if self._held + len(keys) > self._most:
            self.clear()
            if len(keys) > self._most:
                return
        self._held += len(keys)
        slot, keys = self._slot(keys), keys + _U(1)
        while len(keys):
            free = self._keys[slot] == 0
            self._keys[slot[free]] = keys[free]
            won = self._keys[slot] == keys
            self._numbers[slot[won]] = numbers[won]
            keys, numbers, slot = keys[~won], numbers[~won], (slot[~won] + 1) & self._mask

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        full = self._keys != 0
        return self._keys[full] - _U(1), self._numbers[full].astype(np.int64)


class ChunkTable:
    """Ids of chunks by two 64-bit hashes of each chunk, for at most `entries` chunks of `ids` ids together.

    The first hash finds an entry, the second one must agree.
    """

    def __init__(self, entries: int, ids: int):
        self.entries, self.ids, self._at = entries, ids, HashTable(entries)
        self.clear()

    def clear(self) -> None:
        self._at.clear()
        self._start, self._count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._pool = np.zeros(0, np.uint32)
        self._used = np.zeros(0, bool)
        self._second = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self._count)

    def find(self, keys: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The entry of each chunk, -1 where there is none."""
        out = self._at.find(keys)
        at = np.flatnonzero(out >= 0)
        out[at[self._second[out[at]] != second[at]]] = -1
        self._used[out[out >= 0]] = True
        return out

    def put(self, keys: np.ndarray, second: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Put in distinct chunks that were not found; of those with one first hash, one at most comes in."""
        alone = np.zeros(len(keys), bool)
        alone[np.unique(keys, return_index=True)[1]] = True
        alone &= self._at.find(keys) < 0
        if not alone.all():
            ids = ids[np.repeat(alone, counts)]
        self.add(keys[alone], second[alone], ids, counts[alone])

    def add(self, keys: np.ndarray, second: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Put in distinct keys that are not there; ids are those of all keys, one after the other. More than there is room for are left out."""
        full = lambda: len(self) + len(keys) > self.entries or len(self._pool) + len(ids) > self.ids
        if full():
            self._forget()
            if full():
                self.clear()
            if full():
                return
        self._at.put(keys, np.arange(len(self), len(self) + len(keys), dtype=np.int32))
        self._start = np.concatenate([self._start, len(self._pool) + np.cumsum(counts) - counts])
        self._count = np.concatenate([self._count, counts])
        self._pool = np.concatenate([self._pool, ids])
        self._used = np.concatenate([self._used, np.zeros(len(keys), bool)])
        self._second = np.concatenate([self._second, second])

    def _forget(self) -> None:
        """Keep what was met again since it came in; all goes if that is over half of the room."""
        keys, entry = self._at.items()
        keep = self._used[entry]
        keys, entry = keys[keep], entry[keep]
        ids, counts = self.take(entry)
        second = self._second[entry]
        self.clear()
        if 2 * len(keys) <= self.entries and 2 * len(ids) <= self.ids:
            self.add(keys, second, ids, counts)

    def take(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the entries one after the other, number of ids of each)."""
        counts = self._count[entry]
        ends = np.cumsum(counts)
        at = np.repeat(self._start[entry] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        return self._pool[at], counts


class ChunkEncoder:
    """encode_new(list of chunks) -> (ids of all of them one after the other, number of ids of each).

    fold: the tokenizer lower-cases, so A-Z are folded before chunks are looked up; not in texts with
    one of the markers (special tokens are matched as written), nor with marks that compose with
    ASCII letters (U+0300 to U+037F), as a capital may compose where its small letter would not.
    """

    def __init__(self, encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], entries: int = 1 << 19, ids: int = 1 << 22, fold: bool = False, markers: tuple[bytes, ...] = ()):
        self._encode_new, self._fold, self._markers = encode_new, fold, (*markers, b"\xcc", b"\xcd")
        self._table = ChunkTable(entries, ids)

    def clear(self) -> None:
        self._table.clear()

    def _runs(self, raw: np.ndarray, offsets: np.ndarray):
        """Yield ([i, j), byte classes, further cuts) of runs of texts whose chunks are found alike; texts with a marker are looked at as written."""
        plain, folded = (PLAIN_WORDS, None), (FOLDED_WORDS if self._fold else PLAIN_WORDS, LETTER_CUTS)
        for i, j in blocks(offsets):
            text = raw[offsets[i] : offsets[j]].tobytes()
            if not any(m in text for m in self._markers):
                yield i, j, *folded
                continue
            cuts = (offsets[i : j + 1] - offsets[i]).tolist()
            as_is = [any(text.find(m, a, b) >= 0 for m in self._markers) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            start = i
            for k in range(i + 1, j + 1):
                if k == j or as_is[k - i] != as_is[start - i]:
                    yield start, k, *(plain if as_is[start - i] else folded)
                    start = k

    def encode(self, column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after the other, bounds of each text)."""
        raw, offsets = text_bytes(column)
        out, counts = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for i, j, kind, between in self._runs(raw, offsets):
            words = Words(raw, offsets[i : j + 1], kind, between, twice=True)
            ids, held = self._ids_of(words)
            sums = np.concatenate([[0], np.cumsum(held)])
            out.append(ids)
            counts.append(np.diff(sums[words.bounds]))
        return np.concatenate(out), np.cumsum(np.concatenate(counts))

    def _ids_of(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        keys = np.minimum(words.hashes, _U((1 << 64) - 2))
        entry = self._table.find(keys, words.second)
        if not (lost := entry < 0).any():
            return self._table.take(entry)
        at = np.flatnonzero(lost)
        both = np.stack([keys[at], words.second[at]], axis=1)
        _, first, number = np.unique(both.view("u8,u8").ravel(), return_index=True, return_inverse=True)
        first = at[first]
        ids, counts = self._encode_new([words.raw[s:e].tobytes() for s, e in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)])
        # what is in the table and what is new, side by side: the table may drop entries to make room
        old_ids, held = self._table.take(entry[~lost])
        lengths = np.empty(len(entry), np.int64)
        lengths[~lost], lengths[at] = held, counts[number.ravel()]
        starts = np.empty(len(entry), np.int64)
        starts[~lost] = np.cumsum(held) - held
        starts[at] = len(old_ids) + (np.cumsum(counts) - counts)[number.ravel()]
        self._table.put(keys[first], words.second[first], ids, counts)
        ends = np.cumsum(lengths)
        both = np.concatenate([old_ids, ids])
        return both[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])], lengths
