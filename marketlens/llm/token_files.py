"""Token ids of all documents in binary files from which single documents can be read.

A file holds the documents of a range of the order by doc_id. Every document is one zstandard
frame with a checksum of its content: its token ids and the end id as little-endian 32-bit
integers. Two skippable frames follow, so that any zstandard reader can read the file as one
stream of ids: an index (doc_ids, a flag each for null), and the seek table of zstandard's public
seekable format (per frame: compressed size, content size, low half of its XXH64; footer: number
of frames, descriptor, magic number). A reader fetches these from the end of the file, and then
only the frames it wants.

A task that is repeated writes another file; only the files named by the rows of the tasks that
succeeded, the manifest, belong to the result.
"""

from __future__ import annotations

import os
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlens.llm import pretokens
from marketlens.llm.storage import written

# magic numbers of zstandard's seekable format (fixed values)
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FOOTER, FOOTER_BYTES = "<IBI", 9
ENTRY = np.dtype([("compressed", "<u4"), ("content", "<u4"), ("checksum", "<u4")])
MANIFEST = "shard int, path string, documents long, tokens long"
#: Pre-tokens that a task keeps encoded; or a worker process over its tasks, if they share them.
CACHE, SHARED_CACHE = 1 << 19, 1 << 20


class Writer:
    """Writes one file, document by document."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.compress = sink, zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []

    def add(self, doc_id: int | None, content: bytes) -> None:
        frame = self.compress(content)
        self.sink.write(frame)
        self.entries.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        index = np.array([i or 0 for i in self.ids], "<i8").tobytes() + bytes(i is None for i in self.ids)
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array(self.entries, ENTRY).tobytes() + struct.pack(FOOTER, len(self.ids), 0x80, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.sink.close()


class Reader:
    """Reads documents of one file; only their frames are fetched and decompressed."""

    def __init__(self, source):
        self.source, end = source, source.size()
        source.seek(end - FOOTER_BYTES)
        n, descriptor, magic = struct.unpack(FOOTER, source.read(FOOTER_BYTES))
        if magic != FOOTER_MAGIC or descriptor != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = 8 + n * ENTRY.itemsize + FOOTER_BYTES
        source.seek(end - table - 9 * n - 8)
        head = source.read(8 + 9 * n + 8 + n * ENTRY.itemsize)
        if struct.unpack_from("<I", head)[0] != INDEX_MAGIC or struct.unpack_from("<I", head, 8 + 9 * n)[0] != SEEK_MAGIC:
            raise ValueError("damaged index")
        null = np.frombuffer(head, np.uint8, n, 8 + 8 * n)
        self.ids = [None if z else int(i) for i, z in zip(np.frombuffer(head, "<i8", n, 8), null, strict=True)]
        self.entries = np.frombuffer(head, ENTRY, n, 16 + 9 * n)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["compressed"], dtype=np.int64)])
        self.decompress = zstandard.ZstdDecompressor().decompress

    def read(self, frame: int) -> bytes:
        """The token ids of one document, checked against its checksum."""
        self.source.seek(int(self.offsets[frame]))
        content = self.decompress(self.source.read(int(self.entries["compressed"][frame])))
        if len(content) != self.entries["content"][frame] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.entries["checksum"][frame]:
            raise ValueError(f"frame {frame} is damaged")
        return content


def opened(path: str):
    """(file system, path) of a path or address; plain paths are local or mounted folders."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def encoder(model: str, end_id: int, most: int = CACHE):
    """A function from a text to its token ids and the end id as bytes; it keeps up to about ``most`` pre-tokens encoded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_str(model)
    end = np.array([end_id], "<u4").tobytes()

    def as_bytes(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    if not pretokens.byte_level(tokenizer):
        return lambda text: as_bytes(tokenizer.encode(text, add_special_tokens=False).ids) + end
    splitter, known = pretokens.Splitter(tokenizer), {}

    def encode(text: str) -> bytes:
        pieces = splitter.pieces(text)
        try:
            return b"".join(map(known.__getitem__, pieces)) + end
        except KeyError:
            if len(known) > most:
                known.clear()
            missing = [p for p in set(pieces) if p not in known]
            known.update(zip(missing, map(as_bytes, pretokens.encoded(tokenizer, missing)), strict=True))
            return b"".join(map(known.__getitem__, pieces)) + end

    return encode


def kept() -> dict:
    """The encoder that the last task of this process has left, by its model and end id.

    It is held by a module of the process: this one is shipped by value, so that each task has its own copy.
    """
    return vars(sys.modules.setdefault("marketlens_token_files", ModuleType("marketlens_token_files"))).setdefault("encoders", {})


ENCODERS = kept()


def shared_encoder(model: str, end_id: int):
    """An encoder with the pre-tokens that earlier tasks of this process have encoded, else a new one; one is kept."""
    found = kept().pop((model, end_id), None)
    kept().clear()
    return found or encoder(model, end_id, SHARED_CACHE)


def leave(model: str, end_id: int, encode) -> None:
    """Leave an encoder to later tasks of this process."""
    kept()[model, end_id] = encode


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, shards: int | None = None, shared: bool = False
) -> DataFrame:
    """Write the documents (doc_id, text) in ascending doc_id order; returns the manifest, in file order.

    Equal doc_ids are ordered by text; null doc_ids come last; a null text counts as empty. The
    order is dealt in ranges by id and a hash of the text, so that one id with very many rows
    fills several files. ``folder`` is a path that all executors reach. With ``shared`` a worker
    process keeps the pre-tokens that it has encoded for its later tasks, in some 200 MB at most.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        model = spark.sparkContext.broadcast(file.read())
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, writer, tokens = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if writer is None:
                encode = shared_encoder(model.value, end_id) if shared else encoder(model.value, end_id)
                path = f"{folder}/{shard:06d}-{uuid.uuid4().hex}.zst"
                system, place = opened(path)
                system.create_dir(os.path.dirname(place))
                writer = Writer(system.open_output_stream(place, compression=None))
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = encode(text)
                tokens += len(content) // 4
                writer.add(doc_id, content)
        if writer is not None:
            writer.close()
            if shared:
                leave(model.value, end_id, encode)
            row = {"shard": [shard], "path": [path], "documents": [len(writer.ids)], "tokens": [tokens]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    ranged = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    files = written(ranged.mapInArrow(write, MANIFEST), "token-manifest")
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("start", F.coalesce(before, F.lit(0)))  # a row per file: a small window


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, place = opened(path)
                with system.open_input_file(place) as source:
                    reader = Reader(source)
                    sums = [zlib.crc32(reader.read(i)) for i in range(len(reader.ids))]
                n = reader.entries["content"].astype(np.int64) // 4
                starts = start + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reader.ids, pa.int64()), pa.array(starts), pa.array(n), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # a number of partitions that adaptive execution keeps: about a file per task
    files = manifest.select("path", "start")
    spread = files.repartition(max(1, files.count()), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(path: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """Token ids of some documents of one file; no other frame is decompressed."""
    system, place = opened(path)
    with system.open_input_file(place) as source:
        reader, wanted = Reader(source), set(doc_ids)
        return {i: np.frombuffer(reader.read(k), "<u4") for k, i in enumerate(reader.ids) if i in wanted}
