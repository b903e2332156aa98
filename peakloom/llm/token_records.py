"""Token sequences as length-delimited binary records with a separate offset index.

A data file is a run of records. A record is

    length   u64 little-endian, bytes of the payload
    check    u32 little-endian, masked CRC-32 of those 8 bytes
    payload  the ids, little-endian, 2 bytes each if the vocabulary allows it, else 4
    check    u32 little-endian, masked CRC-32 of the payload

with mask(c) = rotate-right-15(c) + 0xA282EAD8, so that a checksum of data that holds checksums
stays useful. The index beside it is Parquet, a row per record: file, position in the file, id,
number of ids, the global number of the first one and the bytes of an id; a reader can seek to any record.

Files are written by the tasks that hold the rows, to a name of the attempt that is then renamed, so
a lost executor's attempt leaves nothing half-written under a final name. pyarrow.fs opens the shared
folder (file, hdfs, s3, ...).
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.chunks import ChunkEncoder, lower_cases
from peakloom.llm.packing import bound_batches, tidy
from peakloom.workspace import new_folder, partition_count, remove

#: Bytes of a record before and behind its payload.
_HEAD, _TAIL = 12, 4
INDEX_SCHEMA = "shard int, file string, id long, position long, n_tokens long, local_start long, width int"


def masked_crc(data) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked_crc(head)) + payload + struct.pack("<I", masked_crc(payload))


def read_frame(data, at: int = 0) -> tuple[memoryview, int]:
    """(payload of the record at a position, the next position); ValueError if a checksum or length is wrong."""
    data = memoryview(data)
    if at + _HEAD > len(data):
        raise ValueError(f"the record at {at} is cut off")
    size, check = struct.unpack_from("<QI", data, at)
    if masked_crc(data[at : at + 8]) != check:
        raise ValueError(f"the length at {at} is damaged")
    start, end = at + _HEAD, at + _HEAD + size
    if end + _TAIL > len(data):
        raise ValueError(f"the record at {at} is cut off")
    if masked_crc(data[start:end]) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError(f"the record at {at} is damaged")
    return data[start:end], end + _TAIL


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it, for a URI or a plain local path."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@lru_cache(maxsize=4)
def _library_encoder(path: str) -> ChunkEncoder:
    """The tokenizers library, asked once for all new chunks of a block."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
    fold = lower_cases(path)
    bar = "\x01"
    (bar_id,) = tokenizer.encode(bar, add_special_tokens=False).ids

    def encode_new(chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        known: dict[int, np.ndarray] = {}
        if fold:  # nothing is normalised or split in small letters: the library's model alone
            for k, c in enumerate(chunks):
                if c.isalpha() and c.islower():
                    known[k] = np.array([t.id for t in tokenizer.model.tokenize(c.decode())], np.uint32)
        plain = [k for k, c in enumerate(chunks) if k not in known and b"\x01" not in c and not any(s in c for s in special)]
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            text = f" {bar} ".join([chunks[k].decode("utf-8", "replace") for k in part])
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            pieces = np.split(ids, np.flatnonzero(ids == bar_id))
            if len(pieces) != len(part):
                raise RuntimeError("the tokenizer lost a chunk's bounds")
            known[part[0]] = pieces[0]
            known.update((k, x[1:]) for k, x in zip(part[1:], pieces[1:], strict=True))
        rest = [k for k in range(len(chunks)) if k not in known]
        if rest:
            for k, e in zip(rest, tokenizer.encode_batch_fast([chunks[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False), strict=True):
                known[k] = np.array(e.ids, np.uint32)
        ids = [known[k] for k in range(len(chunks))]
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.array([len(x) for x in ids], np.int64)

    # up to its first letter a special token has one form, whatever the case: texts with that are left as written
    markers = tuple({re.match(rb"[^A-Za-z]*", s)[0] for s in special})
    return ChunkEncoder(encode_new, fold=fold and all(markers), markers=markers)


def _vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def write_token_records(docs: DataFrame, folder: str, *, tokenizer_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Encode every whole text, append end_id, write record files in ascending id order and their index; return the index.

    Files cover ascending id ranges and are ascending within. The index, written to folder/index, is
    (shard, file, id, position, n_tokens, start, width); start counts the ids of all records before. Null and
    empty texts have the end id only (or an empty record without one). Rows with one id stand side by
    side; null ids come first. An empty table gives an empty index. Other columns are ignored.

    The tokenizer must drop white space (its tokens never cross it), as word-level BPE files do; other files are refused.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    n = shards or partition_count(docs)
    width = 2 if max(_vocabulary_size(tokenizer_path) - 1, end_id or 0) < 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(n, F.col("id"))
    # the text breaks ties, so that another attempt at a file writes the same bytes
    rows = rows.sortWithinPartitions("id", F.xxhash64("text"))

    @tidy
    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        target, base = open_folder(folder)
        encoder = _library_encoder(tokenizer_path)
        name = f"part-{shard:06d}.rec"
        attempt = f"{base}/.{name}.{uuid.uuid4().hex}"
        tail = np.array([] if end_id is None else [end_id], f"<u{width}").tobytes()
        out, at, start = None, 0, 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids, bounds = encoder.encode(part.column(1))
                ids = ids.astype(f"<u{width}")
                frames = [frame(ids[a:b].tobytes() + tail) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                if out is None:
                    target.create_dir(base, recursive=True)
                    out = target.open_output_stream(attempt)
                out.write(b"".join(frames))
                sizes = np.array([len(f) for f in frames], np.int64)
                counts = np.diff(bounds) + len(tail) // width
                positions, starts = at + np.cumsum(sizes) - sizes, start + np.cumsum(counts) - counts
                at, start = at + int(sizes.sum()), start + int(counts.sum())
                k = len(frames)
                yield pa.RecordBatch.from_arrays([pa.array([shard] * k, pa.int32()), pa.array([name] * k), part.column(0), pa.array(positions), pa.array(counts, pa.int64()), pa.array(starts, pa.int64()), pa.array([width] * k, pa.int32())], names=["shard", "file", "id", "position", "n_tokens", "local_start", "width"])
        if out is not None:
            out.close()
            try:
                target.move(attempt, f"{base}/{name}")
            except OSError:  # some file systems don't replace: another attempt's file, which is the same, stays
                if target.get_file_info(f"{base}/{name}").type != fs.FileType.File:
                    raise
                target.delete_file(attempt)

    local = f"{folder}/index-local"
    rows.mapInArrow(write, INDEX_SCHEMA).write.parquet(local)
    index = spark.read.schema(INDEX_SCHEMA).parquet(local)
    # one row a file: its size is the number of shards
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before, base = 0, []
    for shard, n_ids in sorted((r["shard"], r["n"]) for r in totals.collect()):
        base.append((shard, before))
        before += n_ids
    bases = spark.createDataFrame(base, "shard int, before long")
    done = index.join(F.broadcast(bases) if len(base) <= 1_000_000 else bases, "shard").select("shard", "file", "id", "position", "n_tokens", (F.col("before") + F.col("local_start")).alias("start"), "width")
    done.write.parquet(f"{folder}/index")
    remove(local)
    return spark.read.parquet(f"{folder}/index")


def read_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids array<int>) of all records, read by the index; each checksum is tested.

    A task reads runs of one file in order of position; a shuffled read orders the index otherwise
    and passes it to read_indexed.
    """
    return read_indexed(spark.read.parquet(f"{folder}/index"), folder)


def _scan(index: DataFrame, folder: str, columns: str, make) -> DataFrame:
    @tidy
    def run(batches):
        source, base = open_folder(folder)
        name, handle = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                payloads = []
                for file, at, count, width in zip(*(part.column(c).to_pylist() for c in ("file", "position", "n_tokens", "width")), strict=True):
                    if file != name:
                        if handle is not None:
                            handle.close()
                        name, handle = file, source.open_input_file(f"{base}/{file}")
                    size = count * width + _HEAD + _TAIL
                    payload, _ = read_frame(handle.read_at(size, at))
                    if len(payload) != count * width:
                        raise ValueError(f"{file}: the record at {at} isn't the index's")
                    payloads.append(np.frombuffer(payload, f"<u{width}").astype("<u4"))
                yield make(part, payloads)
        if handle is not None:
            handle.close()

    return index.mapInArrow(run, columns)


def read_indexed(index: DataFrame, folder: str) -> DataFrame:
    """The records of any selection of the index, in its order."""

    def make(part, ids):
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([part.column("id"), part.column("start"), part.column("n_tokens"), lists], names=["id", "start", "n_tokens", "ids"])

    return _scan(index, folder, "id long, start long, n_tokens long, ids array<int>", make)


def record_checksums(index: DataFrame, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32): the CRC-32 of each record's ids as little-endian unsigned 32-bit integers, from the files."""

    def make(part, ids):
        crcs, counts = [zlib.crc32(x.tobytes()) for x in ids], [len(x) for x in ids]
        return pa.RecordBatch.from_arrays([part.column("id"), part.column("start"), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])

    return _scan(index, folder, "id long, start long, n_tokens long, ids_crc32 long", make)


def op8_token_records(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    folder = new_folder(spark, "token-records")
    index = write_token_records(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer_path=path, end_id=1)
    return record_checksums(index, folder).withColumnRenamed("id", "doc_id")


QUERIES = {"op8_token_records": op8_token_records}
ORACLE_SQL: dict[str, str] = {}
