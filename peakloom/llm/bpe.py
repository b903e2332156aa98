"""Byte-pair encoding and decoding by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens that accepts exactly the correct
tokenizations (Berglund & van der Merwe, "Formalizing BPE Tokenization", 2023; Berglund et al.,
"Constructing a BPE Tokenization DFA", 2024). It starts as one state with a loop for each base
symbol; the merge (u, v) -> w then

* copies the state that the u-arcs lead to, without its v-arc, and leads the u-arcs to the copy;
* gives every state with a u-arc a w-arc to where the v-arc led.

All arcs of one label lead to one state, so a state is named by its label and stored as what its copy
cut off and what it was copied from; whether it has an arc is read from these tables. A corpus uses a
small part of the states' arcs: those are kept in a table (state, label) of bounded size, filled from
the gadgets a batch at a time. Joined with the trie of the labels' spellings this encodes words: every
prefix of a word has one path, so each place has one label that ends there, found from the labels at
the places where a token can begin; many words are worked on at a time, with array operations, and
are read back from their ends. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.llm.chunks import ChunkEncoder, HashTable, lower_cases
from peakloom.llm.packing import bound_batches, give_back, tidy
from peakloom.llm.textblocks import blocks


def byte_symbols() -> list[str]:
    """The symbol of each byte in byte-level vocabularies: printable bytes stand for themselves, others are moved behind 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(moved)}
    return [table[b] for b in range(256)]


class MergeAutomaton:
    """The automaton of a list of merges; tokens are their ids in vocab."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_of_word: str = ""):
        self.end = end_of_word
        self.size = max(vocab.values(), default=0) + 1
        self._born = [-1] * self.size  # the merge that made a token, -1 for base symbols
        self._left, self._right = list(range(self.size)), list(range(self.size))
        self._cut: dict[int, int] = {}  # (label, arc) -> the merge whose copy cut the arc off
        ids, dead = dict(vocab), set()
        for i, (u, v) in enumerate(merges):
            self._gadget(i, ids[u], ids[v], ids[u + v], dead)
        self.labels = {s: t for s, t in ids.items() if t not in dead}

    def _gadget(self, i: int, u: int, v: int, w: int, dead: set[int]) -> None:
        if w in dead or self._born[w] >= 0:
            raise ValueError("two merges make one token")
        if u in dead or v in dead or not self._arc_before(u, v, i):
            dead.add(w)  # no state has both arcs, so none gets the new one
            return
        self._cut[u * self.size + v] = i
        self._born[w], self._left[w], self._right[w] = i, u, v

    def is_base(self, token: int) -> bool:
        return self._born[token] < 0

    def _arc_before(self, t: int, x: int, i: int) -> bool:
        """Whether the state behind label t had an x-arc before merge i.

        That state is a chain of copies: t's own, back to t's birth, then those of its right part as
        they were then, before the merge. A merged x was given to it if it had the arc of x's left
        part at x's birth, after that merge's own copy.
        """
        born, cut, size = self._born, self._cut, self.size
        while True:
            if cut.get(t * size + x, i) < i:
                return False
            if born[t] < 0 and born[x] < 0:
                return True
            if born[x] >= born[t]:
                i, x = born[x] + 1, self._left[x]
            else:
                i, t = born[t], self._right[t]

    def tables(self) -> Gadgets:
        return Gadgets(self)


class Gadgets:
    """The finished automaton in arrays, and the arcs that have been asked for."""

    def __init__(self, automaton: MergeAutomaton, arcs: int = 1 << 19):
        a = automaton
        self.size = a.size
        self._born, self._left, self._right = (np.array(x, np.int64) for x in (a._born, a._left, a._right))
        self._cut = HashTable(len(a._cut) + 1)
        self._cut.put(np.array(list(a._cut), np.uint64), np.array(list(a._cut.values()), np.int32))
        self._arcs = HashTable(arcs)

    def arcs(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Whether each state (by its label, or -1: the start) has an arc of that label."""
        keys = ((state + 1) * self.size + label).astype(np.uint64)
        found = self._arcs.find(keys)
        if len(lost := np.flatnonzero(found < 0)):
            new, first, number = np.unique(keys[lost], return_index=True, return_inverse=True)
            first = lost[first]
            has = self._derive(state[first], label[first]).astype(np.int32)
            self._arcs.put(new, has)
            found[lost] = has[number.ravel()]
        return found > 0

    def _derive(self, state: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The same from the gadgets, as MergeAutomaton._arc_before, for all arcs side by side."""
        out = np.ones(len(state), bool)
        on = np.flatnonzero(state >= 0)
        t, x, i = state[on], label[on], np.full(len(on), 1 << 60)
        while len(on):
            cut = self._cut.find((t * self.size + x).astype(np.uint64))
            dead = (cut >= 0) & (cut < i)
            out[on[dead]] = False
            go = ~dead & ((self._born[t] >= 0) | (self._born[x] >= 0))
            on, t, x = on[go], t[go], x[go]
            later = self._born[x] >= self._born[t]
            i = np.where(later, self._born[x] + 1, self._born[t])
            t, x = np.where(later, t, self._right[t]), np.where(later, self._left[x], x)
        return out


class WordEncoder:
    """Words, as bytes, to the labels of their paths through the automaton."""

    def __init__(self, automaton: MergeAutomaton):
        self._gadgets = automaton.tables()
        value = {c: b for b, c in enumerate(byte_symbols())}
        goto: dict[int, int] = {}
        final: dict[int, int] = {}
        label = [-1]
        self._lengths = np.zeros(automaton.size, np.int64)
        end = automaton.end
        for spelling, token in automaton.labels.items():
            ends = bool(end) and spelling.endswith(end)
            spelled = spelling[: -len(end)] if ends else spelling
            if not spelled or any(c not in value for c in spelled) or (len(spelled) > 1 and automaton.is_base(token)):
                continue  # a special token: no piece of a text spells it
            data = [value[c] for c in spelled]
            self._lengths[token] = len(data)
            node = 0
            for byte in data[:-1]:
                node = goto.setdefault(node << 8 | byte, len(label))
                if node == len(label):
                    label.append(-1)
            if ends or not end:
                final[node << 8 | data[-1]] = token
            if not ends:
                node = goto.setdefault(node << 8 | data[-1], len(label))
                if node == len(label):
                    label.append(-1)
                label[node] = token
        self._label = np.array(label, np.int64)
        self._goto, self._final = (HashTable.of(x) for x in (goto, final))

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
        """(labels of all words one after the other, number of labels of each); words are not empty. About `most` bytes are worked on at a time."""
        sizes = ends - starts
        order = np.argsort(sizes, kind="stable")
        cells = np.cumsum(sizes[order])
        parts, at = [], 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + most, "right")))
            group = order[at:to]
            parts.append((group, *self._group(data, starts[group], sizes[group])))
            at = to
        counts = np.zeros(len(sizes), np.int64)
        for group, _, held in parts:
            counts[group] = held
        begin = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.uint32)
        for group, labels, held in parts:
            out[np.repeat(begin[group] - (np.cumsum(held) - held), held) + np.arange(len(labels))] = labels
        return out, counts

    def _candidates(self, data: np.ndarray, base: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, end, label) of every place in the words where a label is spelled; only a final label ends a word."""
        at = np.arange(len(data))
        stop = np.repeat(base + sizes, sizes)
        node, to = np.zeros(len(data), np.int64), at
        found = []
        while len(at):
            key = (node << 8 | data[to]).astype(np.uint64)
            last = to + 1 == stop
            token = np.full(len(at), -1, np.int64)
            token[last] = self._final.find(key[last])
            child = np.full(len(at), -1, np.int64)
            child[~last] = self._goto.find(key[~last])
            on = child >= 0
            token[on] = self._label[child[on]]
            hit = token >= 0
            found.append((at[hit], to[hit] + 1, token[hit]))
            at, node, to, stop = at[on], child[on], to[on] + 1, stop[on]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _group(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(sizes)
        base = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(n), sizes)
        inside = np.arange(int(sizes.sum())) - base[word]
        first, end, token = self._candidates(raw[starts[word] + inside], base, sizes)
        # ends[k + w]: the label that ends behind k bytes of the group, of which w words are over; -1 at a word's start
        ends = np.full(len(word) + n, -2, np.int64)
        ends[base + np.arange(n)] = -1
        of = word[first]
        place = end - base[of]
        order = np.argsort(place, kind="stable")
        first, end, token, of = first[order] + of[order], end[order] + of[order], token[order], of[order]
        edges = np.searchsorted(place[order], np.arange(1, int(sizes.max()) + 2))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            before = ends[first[a:b]]
            ok = before >= -1
            ok[ok] = self._gadgets.arcs(before[ok], token[a:b][ok])
            ends[end[a:b][ok]] = token[a:b][ok]
        # back from the end of each word, from label to label
        top = base + np.arange(n)
        at, who = top + sizes, np.arange(n)
        out, owner = [], []
        while len(who):
            label = ends[at]
            if (label < 0).any():
                raise ValueError("a word has bytes that no label spells")
            out.append(label)
            owner.append(who)
            at = at - self._lengths[label]
            go = at > top[who]
            at, who = at[go], who[go]
        out, owner = np.concatenate(out), np.concatenate(owner)
        back = np.lexsort((-np.arange(len(owner)), owner))
        return out[back].astype(np.uint32), np.bincount(owner, minlength=n)


class WordBpe:
    """A tokenizer file of the kind: added tokens; NFC, white space, lower case; pattern, byte symbols; merges with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or not split["invert"] or spec["decoder"] or spec["model"]["ignore_merges"]:
            raise ValueError(f"{path} is a tokenizer of another kind")
        self._pattern = regex.compile(split["pattern"]["Regex"])
        # the library's own Unicode tables say what is composed, lower-cased and split; Python's may be of another version
        self._library = Tokenizer.from_file(path)
        model = spec["model"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        end = model["end_of_word_suffix"] or ""
        # A merged token's name has one word end: of two merged parts only the right one can have it.
        self.words = WordEncoder(MergeAutomaton(model["vocab"], merges, end))
        self._added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._added_pattern = regex.compile("|".join(map(regex.escape, sorted(self._added, key=len, reverse=True)))) if self._added else None

    def markers(self) -> tuple[bytes, ...]:
        """What a text holds, in any case of letters, if it holds an added token: the tokens up to their first letter."""
        return tuple({regex.match(r"[^A-Za-z]*", t)[0].encode() for t in self._added})

    def _pieces(self, text: str) -> list[bytes]:
        if text.isascii():
            return [p.encode() for p in self._pattern.findall(text.lower())]
        text = self._library.normalizer.normalize_str(text)
        return [text[a:b].encode() for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks one after the other, number of ids of each)."""
        pieces: list[bytes | int] = []  # a number is the id of an added token
        counts = []
        for chunk in chunks:
            before = len(pieces)
            if chunk.isalpha():  # ASCII letters alone are one piece
                pieces.append(chunk.lower())
            else:
                text, at = chunk.decode("utf-8", "replace"), 0
                for m in self._added_pattern.finditer(text) if self._added_pattern is not None else ():
                    pieces += [*self._pieces(text[at : m.start()]), self._added[m[0]]]
                    at = m.end()
                pieces += self._pieces(text[at:])
            counts.append(len(pieces) - before)
        added = np.array([p if isinstance(p, int) else -1 for p in pieces], np.int64)
        spelled = [b"" if isinstance(p, int) else p for p in pieces]
        sizes = np.array([len(p) for p in spelled], np.int64)
        ends = np.cumsum(sizes)
        plain = np.flatnonzero(added < 0)
        held = np.ones(len(pieces), np.int64)
        ids, held[plain] = self.words.encode(np.frombuffer(b"".join(spelled), np.uint8), (ends - sizes)[plain], ends[plain])
        out = np.empty(int(held.sum()), np.uint32)
        of = np.repeat(added, held)
        out[of < 0], out[of >= 0] = ids, of[of >= 0]
        sums = np.concatenate([[0], np.cumsum(held)])
        bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return out, np.diff(sums[bounds])


@lru_cache(maxsize=4)
def _encoder(path: str) -> ChunkEncoder:
    bpe = WordBpe(path)
    give_back()  # what reading the file took
    return ChunkEncoder(bpe.encode_chunks, fold=lower_cases(path) and all(bpe.markers()), markers=bpe.markers())


@lru_cache(maxsize=4)
def _names(path: str) -> pa.Array:
    """The label of each id, and a null behind the last."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"]}
    names = [""] * (max(ids.values()) + 1)
    for s, t in ids.items():
        names[t] = s
    out = pa.array([*names, None], pa.string())
    del spec, ids, names
    give_back()
    return out


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Bytes of text, or of ids, that a Python worker works on at a time: what it needs for them is many times as much, beside the executor's heap.
_SLICE_BYTES = 1 << 19


def _slices(batches):
    """Runs of rows whose last column holds about _SLICE_BYTES together; a longer row stands alone. Freed memory is handed back behind each batch."""
    for batch in batches:
        last = batch.column(batch.num_columns - 1)
        sizes = pc.multiply(pc.list_value_length(last), 4) if pa.types.is_nested(last.type) else pc.binary_length(last)
        bounds = np.concatenate([[0], np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        for i, j in blocks(bounds, _SLICE_BYTES):
            yield batch.slice(i, j - i)
        give_back()


def bpe_encode(df: DataFrame, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, tokenizer_path: str | None = None) -> DataFrame:
    """df with the token ids of each whole text, as array<int>, in place of text_col, and with what they decode to as decoded_col if that is given (as by bpe_decode, in the same pass).

    Null and empty texts have no ids. Special tokens are found in a text as the tokenizer file says;
    none is added. Other columns pass through, and so do repeated rows; one that is named like ids_col
    or decoded_col is replaced. An empty table stays empty.
    """
    path = tokenizer_path or default_tokenizer_path()
    bound_batches(df.sparkSession)
    keep = [c for c in df.columns if c not in (text_col, ids_col, decoded_col)]
    df = df.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).cast("string").alias("__text"))
    more = [T.StructField(decoded_col, T.StringType(), False)] if decoded_col else []
    schema = T.StructType([*df.schema.fields[:-1], T.StructField(ids_col, T.ArrayType(T.IntegerType()), False), *more])

    @tidy
    def run(batches):
        encoder, names = _encoder(path), _names(path)
        for b in _slices(batches):
            ids, bounds = encoder.encode(b.column(b.num_columns - 1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists, *([_spoken(lists, names)] if decoded_col else [])], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, *, ids_col: str = "ids", text_col: str = "decoded", tokenizer_path: str | None = None) -> DataFrame:
    """df with the labels that each row's ids emit, joined by one space, as text_col.

    Null and empty lists give the empty text; an id out of the vocabulary or null emits nothing.
    Special tokens are emitted. Other columns pass through; one that is named like text_col is replaced.
    """
    path = tokenizer_path or default_tokenizer_path()
    bound_batches(df.sparkSession)
    keep = [c for c in df.columns if c != text_col]
    df = df.select(*(F.col(f"`{c}`") for c in keep), F.col(ids_col).cast("array<int>").alias("__ids"))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField(text_col, T.StringType(), False)])

    @tidy
    def run(batches):
        names = _names(path)
        for b in _slices(batches):
            lists = pa.ListArray.from_arrays(*_packed(b.column(b.num_columns - 1)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], _spoken(lists, names)], names=[*keep, text_col])

    return df.mapInArrow(run, schema)


def _spoken(lists: pa.ListArray, names: pa.Array) -> pa.Array:
    """The labels of each list of ids, joined; names: by id, of which the last is nobody's."""
    none = len(names) - 1
    ids = lists.values.fill_null(none).to_numpy(zero_copy_only=False)
    known = (ids >= 0) & (ids < none)
    if not known.all():
        sums = np.concatenate([[0], np.cumsum(known)])
        lists = pa.ListArray.from_arrays(pa.array(sums[lists.offsets.to_numpy()], pa.int32()), pa.array(ids[known]))
        ids = ids[known]
    return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, names.take(pa.array(ids))), " ")


def _packed(lists: pa.ListArray) -> tuple[pa.Array, pa.Array]:
    """(offsets from 0, values) of a list array that may have nulls and an offset."""
    counts = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), lists.flatten()


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    coded = bpe_encode(docs, decoded_col="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {"op4_bpe": op4_bpe}
ORACLE_SQL: dict[str, str] = {}
