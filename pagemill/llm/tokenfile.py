"""Token ids in seekable Zstandard files.

A file holds one independent Zstandard frame for each document in ascending doc_id order, then a skippable frame with
the doc_ids, then the seek table of the public Zstandard Seekable Format: compressed size, size and XXH64 checksum (low
32 bits) of every frame. A reader takes the table from the end and decompresses only the frames it wants.

Documents are dealt to files of about FILE_BYTES of text by quantiles of doc_id, so files follow each other in doc_id order;
a doc_id that fills several files is dealt to them by the checksum of its ids. A task writes under a name of its own and
then renames, so a task that is run again leaves one whole file, and what lost attempts left is deleted. Null texts are
empty texts: the end id alone. Rows without doc_id come first and are written as the smallest long. Rows of one doc_id stay
together, in the order of their checksums. Other columns are not read. An empty table gives no file and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoder, vocabulary
from .common import doc_text, parts_for, scratch, slices

# Fixed values of the Zstandard Seekable Format.
SKIPPABLE_TABLE, SKIPPABLE_INDEX, SEEKABLE_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
CHECKSUM_FLAG = 0x80
NO_ID = -(2**63)
LEVEL = 3
#: How the names of unfinished files begin.
LOST = ".part-"
FILE_BYTES = 256 << 20
#: The finest accuracy of quantiles: errors of one in so many rows.
FINEST = 1_000_000


def bounds_of(frame: DataFrame, column: str, parts: int) -> np.ndarray:
    """parts - 1 quantiles that split a column of longs into runs of like size; a value that fills several runs occurs several times."""
    at = [k / parts for k in range(1, parts)]
    if not at:
        return np.zeros(0, np.int64)
    found = frame.agg(F.percentile_approx(column, at, min(10 * parts, FINEST)).alias("q")).first()["q"]
    return np.array(sorted(found or []), np.int64)


def run_of(bounds: np.ndarray, ids: np.ndarray, checksums: np.ndarray) -> np.ndarray:
    """The run of each id; within an id that several runs share, of each 32-bit checksum."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    return low + (checksums * (high - low + 1) >> 32)


def seek_table(sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The two closing frames: doc_ids, then compressed size, size and checksum of each frame."""
    index = np.asarray(ids, "<i8").tobytes()
    table = np.asarray(sizes, "<u4").tobytes() + struct.pack("<IBI", len(ids), CHECKSUM_FLAG, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index + struct.pack("<II", SKIPPABLE_TABLE, len(table)) + table


class TokenFile:
    """A reader: what each frame is, from the end of the file; `ids` decompresses one."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        n, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("not a file with a seek table of this kind")
        table = size - 9 - 12 * n
        self.sizes = np.frombuffer(self._at(table, 12 * n), "<u4").reshape(n, 3)
        self.doc_ids = np.frombuffer(self._at(table - 8 - 8 * n, 8 * n), "<i8")
        self.starts = np.r_[0, np.cumsum(self.sizes[:, 0], dtype=np.int64)]

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def ids(self, k: int) -> np.ndarray:
        import xxhash

        size, checksum = int(self.sizes[k, 1]), int(self.sizes[k, 2])
        raw = self.unzip.decompress(self._at(int(self.starts[k]), int(self.sizes[k, 0])), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")


def write_tokens(docs: DataFrame, folder: str, name: str = "word_bpe_49k.json", end_id: int = 1, files: int | None = None) -> list[dict]:
    """Write the ids of docs(doc_id, text) into `folder`; returns path, documents and tokens of each file, in order."""
    spark = docs.sparkSession
    texts = doc_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    bounds = bounds_of(texts, "doc_id", files or parts_for(docs, FILE_BYTES))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        enc, squeeze = encoder(vocabulary(name)), zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        for batch in batches:
            for part in slices(batch):
                ids, offsets = enc.encode(part.column("text"))
                raw = [np.append(ids[a:b], end_id).astype("<u4").tobytes() for a, b in zip(offsets, offsets[1:])]
                checksums = np.fromiter((xxhash.xxh64_intdigest(r) & 0xFFFFFFFF for r in raw), np.int64, len(raw))
                file = run_of(bounds, np.asarray(part.column("doc_id")), checksums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file, pa.int32()), part.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(checksums), pa.array(map(squeeze.compress, raw), pa.binary())],
                    names=["file", "doc_id", "size", "checksum", "frame"],
                )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        out, sizes, ids, own = None, [], [], f"{root}/{LOST}{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(own)
            frames_ = batch.column("frame").to_pylist()
            out.write(b"".join(frames_))
            sizes.append(np.stack([np.fromiter(map(len, frames_), np.int64), np.asarray(batch.column("size")), np.asarray(batch.column("checksum"))], axis=1).astype("<u4"))
            ids.append(np.asarray(batch.column("doc_id")))
        if out:
            table, ids = np.concatenate(sizes), np.concatenate(ids)
            out.write(seek_table(table, ids))
            out.close()
            store.move(own, f"{root}/part-{part:06d}.tok.zst")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/part-{part:06d}.tok.zst"]), pa.array([len(ids)]), pa.array([int(table[:, 1].sum(dtype=np.int64)) // 4])], names=["path", "documents", "tokens"])

    coded = texts.mapInArrow(frames, "file int, doc_id long, size long, checksum long, frame binary")
    dealt = coded.repartitionById(len(bounds) + 1, "file").sortWithinPartitions("doc_id", "checksum")
    written = dealt.mapInArrow(write, "path string, documents long, tokens long")
    manifest = [r.asDict() for r in sorted(written.collect())]  # one row for each file
    store, root = fs.FileSystem.from_uri(folder)
    for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if info.base_name.startswith(LOST):
            store.delete_file(info.path)
    return manifest


def read_tokens(spark: SparkSession, manifest: list[dict], wanted: list[int] | None = None, keep: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, ids with keep; `wanted`: only these doc_ids are decompressed."""
    before = np.r_[0, np.cumsum([m["tokens"] for m in manifest])].tolist()
    rows = [(m["path"], b) for m, b in zip(manifest, before, strict=False)]
    files = spark.createDataFrame(rows, "path string, before long").repartition(max(1, len(rows)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    file = TokenFile(f, f.size())
                    n = file.sizes[:, 1].astype(np.int64) // 4
                    start = base + np.cumsum(n) - n
                    every = np.arange(len(n)) if wanted is None else np.flatnonzero(np.isin(file.doc_ids, wanted))
                    for k in range(0, len(every), 5000):
                        own = every[k : k + 5000]
                        ids = [file.ids(j) for j in own.tolist()]
                        cols = [pa.array(file.doc_ids[own], mask=file.doc_ids[own] == NO_ID), pa.array(start[own]), pa.array(n[own]), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                        cols += [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))] if keep else []
                        yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return files.mapInArrow(read, schema)


def token_file_digest(docs: DataFrame, name: str = "word_bpe_49k.json", end_id: int = 1) -> DataFrame:
    """Write the files into the shared folder, read them back, and give each document's place and CRC."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, scratch(spark, "tokens"), name, end_id), keep=False)
