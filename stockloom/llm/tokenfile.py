"""Token ids in binary files of independent zstandard frames.

A file holds one frame a document, in ascending document id, each with zstandard's own checksum over little-endian unsigned
32-bit ids. Two skippable frames follow: the document ids (a count, the ids, a bit for each null id), and the seek table of the
seekable format, with compressed size, uncompressed size and XXH64 checksum of every frame and a footer at the very end. A
reader fetches the footer, the table and the ids, then only the frames of the documents it wants; any zstandard tool can
decompress the whole file.

Null texts count as empty, a document of an empty text is its end id alone, a document id given twice is written twice, rows
with a null id come first (equal ids in order of their texts), an empty table gives one empty file. Columns besides ``doc_id``
and ``text`` are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.llm.bpe import WordEncoder
from stockloom.llm.shared import arrow_schema, id_bounds, part_count, part_of, slices

# Fixed values of the zstandard seekable format.
SEEK_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80
# The skippable frame of document ids.
IDS_MAGIC = 0x184D2A50

MANIFEST = "manifest"


class FrameWriter:
    """Write one file; ``add`` takes documents in order, ``close`` writes the trailing tables."""

    def __init__(self, out, level: int = 3):
        self.out = out
        self.compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.table: list[bytes] = []
        self.ids: list[int | None] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compressor.compress(ids)
        self.out.write(frame)
        self.table.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        count = len(self.ids)
        nulls = np.packbits(np.array([x is None for x in self.ids], dtype=bool)).tobytes()
        ids = struct.pack("<Q", count) + np.array([x or 0 for x in self.ids], dtype="<i8").tobytes() + nulls
        self.out.write(struct.pack("<II", IDS_MAGIC, len(ids)) + ids)
        table = b"".join(self.table) + struct.pack("<IBI", count, CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class FrameReader:
    """Read documents of one file; ``source`` can seek. Only the tables and the wanted frames are read."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        source.seek(size - 9 - 12 * count - 8)
        if struct.unpack("<II", source.read(8)) != (SEEK_MAGIC, 12 * count + 9):
            raise ValueError("damaged seek table")
        self.table = np.frombuffer(source.read(12 * count), dtype="<u4").reshape(-1, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        source.seek(int(self.starts[-1]))
        magic, length = struct.unpack("<II", source.read(8))
        packed = source.read(length)
        if magic != IDS_MAGIC or struct.unpack_from("<Q", packed) != (count,):
            raise ValueError("damaged document ids")
        ids = np.frombuffer(packed, dtype="<i8", count=count, offset=8).tolist()
        nulls = np.unpackbits(np.frombuffer(packed, dtype=np.uint8, offset=8 + 8 * count), count=count)
        self.ids = [None if gone else x for x, gone in zip(ids, nulls.tolist(), strict=True)]
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        self.source.seek(int(self.starts[number]))
        ids = self.decompressor.decompress(self.source.read(int(self.table[number, 0])))
        if len(ids) != self.table[number, 1] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != self.table[number, 2]:
            raise ValueError(f"checksum of frame {number} does not match")
        return ids


def _filesystem(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder)


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.json", keeps_space: bool = True, end_id: int = 0,
    escape: bool = False,
) -> DataFrame:
    """Encode ``docs`` into files under ``folder``, one for each range of document ids; returns the table of the files.

    Texts are shuffled once, to their range. A task streams its sorted rows into a file of its own under another name and
    renames it when it is complete, so a repeated task writes the same file again. The folder must be one that all executors
    reach, by a scheme of pyarrow's file systems. Special strings in texts get their own ids, as the tokenizer does by default,
    unless ``escape`` is set.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = part_count(docs)
    bounds = id_bounds(docs, parts)
    parts = len(bounds) + 1
    ranged = (
        docs.withColumn("part", part_of(F.col("doc_id"), bounds))
        .repartitionById(parts, "part")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .drop("part")
    )
    schema = "shard int, file string, docs long, tokens long"
    target = arrow_schema(schema)
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        encoder = WordEncoder(vocabulary, keeps_space, escape=escape)
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"ids-{shard:06d}.zst"
        draft = f"{root}/.{name}.{context.taskAttemptId()}"
        count = tokens = 0
        with fs.open_output_stream(draft) as out:
            writer = FrameWriter(out)
            for batch in slices(batches):
                for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids = encoder.encode(text) + end
                    writer.add(doc_id, ids)
                    count += 1
                    tokens += len(ids) // 4
            writer.close()
        fs.move(draft, f"{root}/{name}")
        yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "docs": count, "tokens": tokens}], schema=target)

    path = os.path.join(folder, MANIFEST)
    ranged.mapInArrow(write, schema).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_token_files(spark: SparkSession, folder: str, doc_ids: Iterable[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of all files under ``folder``: ``doc_id, start, n_tokens, ids_crc32`` and the ids as binary.

    ``start`` counts the ids of all documents before it. With ``doc_ids`` only the frames of those documents are
    decompressed; starts still come from the seek tables. Every frame read is checked against its checksums.
    """
    files = spark.read.parquet(os.path.join(folder, MANIFEST))
    # one row a file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("shard", "file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    files = files.repartitionById(max(1, files.count()), "shard").select("file", "base")
    wanted = None if doc_ids is None else frozenset(doc_ids)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    target = arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        for batch in batches:
            for file, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = f"{root}/{file}"
                with fs.open_input_file(path) as source:
                    reader = FrameReader(source, fs.get_file_info(path).size)
                    lengths = reader.table[:, 1].astype(np.int64) // 4
                    starts = base + np.concatenate([[0], np.cumsum(lengths)])
                    rows, held = [], 0
                    for i, doc_id in enumerate(reader.ids):
                        if wanted is not None and doc_id not in wanted:
                            continue
                        ids = reader.frame(i)
                        row = (doc_id, int(starts[i]), int(lengths[i]), zlib.crc32(ids))
                        rows.append((*row, ids) if with_ids else row)
                        held += len(ids) * with_ids + 64
                        if held > 4 << 20:
                            yield _rows(rows, target)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows, target)

    return files.mapInArrow(read, schema)


def _rows(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)
