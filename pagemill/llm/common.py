"""Shared helpers: the shared folder, checkpoints, and word tables over Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a task turns into words at once; bounds the memory of a batch.
SLICE_CHARS = 10_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a session on one machine gets a new one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Paths under the shared folder that this driver has made and not deleted, in order.
_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """A mark for `discard`: how many paths there are so far."""
    return len(_made)


def discard(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete the paths made after the mark, but for the last `keep`; only once nothing lazy reads them any more."""
    upto = len(_made) - keep
    gone, _made[since:upto] = _made[since:upto], []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


#: A session over one small file may ask for its rows in so many partitions; unset, tables come as their files do.
PARTITIONS = "spark.pagemill.inputPartitions"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    asked = spark.conf.get(PARTITIONS, None)
    return rows.repartition(int(asked)) if asked else rows


def unused(name: str, *frames: DataFrame) -> str:
    """The name, lengthened until none of the frames has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bytes of text that one partition of ordered output is meant to hold.
PART_BYTES = 256 << 20


def parts_for(docs: DataFrame, bytes_each: int = PART_BYTES) -> int:
    """How many partitions give each about `bytes_each` of text, one for each core or shuffle partition at least; reads `text` once."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_each))


def doc_text(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty); other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).cumsum()
    part = size // limit
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


_held: tuple[str, object] = ("", None)


def held(key: str, make: Callable[[], object]) -> object:
    """One large object (a model with its word table) for each worker process; asking for another one frees it."""
    global _held
    if _held[0] != key:
        _held = ("", None)
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held = (key, make())
    return _held[1]


def ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[offsets[r]:offsets[r + 1]] for each of rows, one after another, and the offsets of the result."""
    start = offsets[rows]
    size = offsets[rows + 1] - start
    out = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    return values[np.repeat(start - out[:-1], size) + np.arange(out[-1])], out


class Words:
    """Whitespace-separated pieces of texts: `index` into `unique`, cut into documents by `offsets`."""

    def __init__(self, texts: pa.Array, separator: str | None = None):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.split_pattern(texts, separator) if separator else pc.ascii_split_whitespace(texts)
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        flat = lists.values[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if separator is None and len(flat):  # leading and trailing white space gives empty pieces
            full = np.asarray(pc.not_equal(pc.binary_length(flat), 0))
            if not full.all():
                offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
                flat = flat.filter(pa.array(full))
        coded = flat.dictionary_encode()
        self.unique: list[str] = coded.dictionary.to_pylist()
        self.index = np.asarray(coded.indices, dtype=np.int64) if len(flat) else np.zeros(0, np.int64)
        self.offsets = offsets


def save(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and no executor's loss brings it to nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
