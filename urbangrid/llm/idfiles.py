"""Token ids in files of fixed-width bit packing, in ascending doc_id order.

File: header (magic, version, bits, ids per block, documents, ids, blocks), document table (doc_id, number of ids), byte offset
of each block, blocks.  A block holds `block_ids` ids of `bits` bits each, least significant bit first, filled up to a byte;
`bits` is the least that holds every id of the vocabulary.  Any range of ids is read through the offsets of its blocks alone.

Documents are encoded once, where they lie, and only packed ids are shuffled, to ranges of doc_id that are known before; each task writes
its ranges as files of at most `file_ids` ids.  A file appears under its name by a rename, so a task that runs again replaces it by the same bytes.  A small table
(`manifest`, a row for each file) gives the order of files.

Defined results: a null or empty text is the end id alone; repeated ids lie side by side, ordered by their packed ids; documents without
doc_id come first; an empty table gives an empty manifest and no document.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import encoder, vocabulary_size
from .common import id_bounds, shuffle_partitions, whole_texts

MAGIC = b"UGBP"
HEADER = struct.Struct("<4sIIIQQQ")
NO_ID = np.iinfo(np.int64).min  # stands for a missing doc_id in files
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"


def width(vocabulary: int) -> int:
    """Least number of bits for ids 0 .. vocabulary-1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    lanes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(lanes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data, n: int, bits: int) -> np.ndarray:
    if bits in (16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count=n).astype(np.uint32)
    lanes = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return lanes.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def to_file(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray, bits: int, block_ids: int) -> bytes:
    blocks = [pack_bits(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    head = HEADER.pack(MAGIC, 1, bits, block_ids, len(doc_ids), len(ids), len(blocks))
    at = len(head) + 16 * len(doc_ids) + 8 * len(blocks)
    offsets = at + np.concatenate([[0], np.cumsum([*map(len, blocks)])])[: len(blocks)]
    return b"".join([head, doc_ids.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), offsets.astype("<i8").tobytes(), *blocks])


class IdFile:
    """Random access to one file's bytes."""

    def __init__(self, data):
        self.data = memoryview(data)
        magic, _, self.bits, self.block_ids, n_docs, self.n_ids, n_blocks = HEADER.unpack_from(self.data)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at = HEADER.size
        self.doc_ids = np.frombuffer(self.data, "<i8", n_docs, at)
        self.sizes = np.frombuffer(self.data, "<i8", n_docs, at + 8 * n_docs)
        self.offsets = np.frombuffer(self.data, "<i8", n_blocks, at + 16 * n_docs)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def read(self, start: int, n: int) -> np.ndarray:
        """ids start .. start+n-1 of the file."""
        if n <= 0:
            return np.empty(0, np.uint32)
        first, last = start // self.block_ids, (start + n - 1) // self.block_ids
        blocks = [unpack_bits(self.data[self.offsets[b] :], min(self.block_ids, self.n_ids - b * self.block_ids), self.bits) for b in range(first, last + 1)]
        at = start - first * self.block_ids
        return np.concatenate(blocks)[at : at + n]

    def document(self, i: int) -> np.ndarray:
        return self.read(int(self.starts[i]), int(self.sizes[i]))


def write_ids(docs: DataFrame, path: str, folder: str, end_id: int = 0, vocabulary: int | None = None, block_ids: int = 65_536, file_ids: int = 8_000_000, cache_words: int = 500_000) -> DataFrame:
    """Encode, append end_id, and write the files under folder (a URI); the manifest, as read back.

    vocabulary: number of ids; the tokenizer file's where not given.
    """
    bits = width(max(vocabulary or vocabulary_size(path), end_id + 1))
    spark = docs.sparkSession
    bounds = id_bounds(docs, 2 * shuffle_partitions(spark))

    def encoded(batches):
        enc = encoder(path, cache_words, False)
        end = int(end_id).to_bytes(4, "little")
        for b in batches:
            ids = [np.frombuffer(x + end, "<u4") for x in enc.encode_batch(b.column(1).to_pylist())]
            doc = b.column(0).fill_null(NO_ID).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, doc), pa.int32()), b.column(0), pa.array([*map(len, ids)], pa.int32()), pa.array([pack_bits(x, bits) for x in ids], pa.binary())], names=["range", "doc_id", "n", "packed"])

    def files(batches):
        where, root = fs.FileSystem.from_uri(folder)
        part, attempt, seq = None, TaskContext.get().taskAttemptId(), 0
        names, sizes, parts, held = [], [], [], 0

        def flush():
            nonlocal seq, names, sizes, parts, held
            data = to_file(np.array(names, np.int64), np.array(sizes, np.int64), np.concatenate(parts), bits, block_ids)
            name = f"{root}/ids-{part:06d}-{seq:05d}"
            where.create_dir(root, recursive=True)
            with where.open_output_stream(f"{name}.{attempt}") as f:
                f.write(data)
            where.move(f"{name}.{attempt}", name)
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": f"ids-{part:06d}-{seq:05d}", "n_docs": len(names), "n_ids": held}], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            seq, names, sizes, parts, held = seq + 1, [], [], [], 0
            return row

        for b in batches:
            for where_to, doc, n, packed in zip(*(c.to_pylist() for c in b.columns)):
                if names and (where_to != part or held + n > file_ids):
                    yield flush()
                if where_to != part:
                    part, seq = where_to, 0
                names.append(NO_ID if doc is None else doc)
                sizes.append(n)
                parts.append(unpack_bits(packed, n, bits))
                held += n
        if names:
            yield flush()

    (
        whole_texts(docs)
        .mapInArrow(encoded, "range int, doc_id long, n int, packed binary")
        .repartition(max(shuffle_partitions(spark), len(bounds) // 2), "range")
        .sortWithinPartitions("range", "doc_id", "packed")
        .mapInArrow(files, MANIFEST)
        .write.mode("overwrite")
        .parquet(f"{folder}/manifest")
    )
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """Documents from the files: doc_id, start, n_tokens, and ids array<int> (digest: ids_crc32 instead).

    The running start of the files is a window over the manifest: a row for each file, not for each document.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    total = F.sum("n_ids").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1))
    placed = manifest.select("path", F.coalesce(total, F.lit(0)).cast("long").alias("start"))
    last = "ids_crc32 long" if digest else "ids array<int>"

    def rows(batches):
        where, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, start in zip(*(c.to_pylist() for c in b.columns)):
                with where.open_input_stream(f"{root}/{path}") as f:
                    file = IdFile(f.read())
                for k in range(0, len(file.sizes), 2000):
                    some = range(k, min(k + 2000, len(file.sizes)))
                    lo, hi = int(file.starts[some.start]), int(file.starts[some.stop])
                    ids = file.read(lo, hi - lo)
                    cut = [ids[int(file.starts[i]) - lo : int(file.starts[i + 1]) - lo] for i in some]
                    doc = pa.array(file.doc_ids[some.start : some.stop], mask=file.doc_ids[some.start : some.stop] == NO_ID)
                    end = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([doc, pa.array(start + file.starts[some.start : some.stop]), pa.array(file.sizes[some.start : some.stop]), end], names=["doc_id", "start", "n_tokens", last.split()[0]])

    return placed.repartition(shuffle_partitions(spark), "path").mapInArrow(rows, f"doc_id long, start long, n_tokens long, {last}")
