"""WARC files and a Merkle audit of replicas.

An archive's files hold its pages as response records, one gzip member each, a fixed run of page ids to a file. The audit
reads the files of two replicas back and hashes them into trees. A leaf is a slot (the place of a page id in its file): of each of its
records the bytes as they lie in the file, their length, and which record lies before it, so that a byte changed anywhere, in
a member's header too, and records in another order are differences. A node is an ordered range: the hash of its FAN children in order, each with its offset in
the range and its length; above the slots of a file come the file, ranges of files, and one root for the archive. The audit
compares the roots and goes down only where two nodes differ, so that records of sound branches are never compared.

What is no record (a broken member, bytes between records, a file cut off) is a range of type `damaged`, and reading goes on
at the next record that is whole. It lies in the slot after the record before it, so that a lost record's slot differs by
what is in its place. The tree's offsets and lengths are those in the file; what the audit returns are those of the plain bytes.

Files are known by their path below the archive's folder. Records of other archives, which have no page id, lie in slots by
the hash of their record id.

Null urls and texts are empty. Records of one page_id (repeated rows) share a slot; the leaf then holds their number, the
sum of their digests and the outermost two, whatever their order. Rows without page_id lie in NO_ID_FILES files with
negative numbers, in slots by the hash of their url. Other columns are not read. Equal or empty replicas give no rows.
"""

from __future__ import annotations

import functools
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as Windowed
from pyspark.sql import functions as F

from .common import parts_for, save, scratch

FAN = 16
PER_FILE = 1000
NO_ID_FILES = 64
DATE = "1970-01-01T00:00:00Z"
LEVEL = 1
#: Bytes of a file that a task holds at once; a longer record is hashed in pieces.
WINDOW = 4 << 20
#: Bytes of pages or files that a task is meant to write or read.
TASK_BYTES = 64 << 20
#: A longer header is no header.
LONGEST_HEAD = 1 << 20
END = b"\r\n\r\n"
STARTS = (b"\x1f\x8b\x08", b"WARC/1.")


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A response record as text; its UTF-8 bytes are what a file holds."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def gzip_member(record: bytes) -> bytes:
    return gzip.compress(record, LEVEL, mtime=0)


def places(page_id: Column, url: Column, per_file: int) -> tuple[Column, Column]:
    """The file and the slot of a page."""
    known = page_id.cast("long")
    file = F.coalesce(F.floor((known - F.pmod(known, F.lit(per_file))) / per_file), -1 - F.pmod(F.xxhash64(F.coalesce(url, F.lit("")), F.lit("file")), F.lit(NO_ID_FILES))).cast("long")
    return file, F.coalesce(F.pmod(known, F.lit(per_file)), F.pmod(F.xxhash64(F.coalesce(url, F.lit(""))), F.lit(per_file))).cast("long")


def write_files(rows: Iterator[tuple[int, bytes]], folder: str) -> Iterator[tuple[str, int]]:
    """(file, stored bytes) in order of file -> (path, size) of each file; a task that is run again leaves one whole file."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    out, now, own, size = None, None, "", 0

    def close() -> tuple[str, int]:
        out.close()
        store.move(own, f"{root}/{now}.warc.gz")
        return f"{folder}/{now}.warc.gz", size

    for file, stored in rows:
        if file != now:
            if out:
                yield close()
            now, own, size = file, f"{root}/.{file}-{uuid.uuid4().hex}", 0
            out = store.open_output_stream(own, compression=None)
        out.write(stored)
        size += len(stored)
    if out:
        yield close()


def _listed(batches: Iterator[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
    for path, size in batches:
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], names=["path", "size"])


def write_warc(pages: DataFrame, folder: str, per_file: int = PER_FILE) -> DataFrame:
    """pages(page_id, url, html) as files in the folder -> path and size of each."""
    file, slot = places(F.col("page_id"), F.col("url"), per_file)
    rows = pages.select(file.alias("file"), slot.alias("slot"), record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((f, gzip_member(r.as_buffer())) for b in batches for f, r in zip(b.column("file").to_pylist(), b.column("record").cast(pa.binary()), strict=True))
        yield from _listed(write_files(each, folder))

    # by a number, so that files don't end in a few tasks for being small
    ordered = rows.repartition(parts_for(pages.withColumn("text", F.col("html")), TASK_BYTES), "file").sortWithinPartitions("file", "slot", "record")
    return save(ordered.mapInArrow(run, "path string, size long"), "warc-files")


def warc_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and size of the files that match; their bytes are not read here."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))


class Window:
    """Part of a file; what is asked for beyond it is read anew."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def get(self, at: int, n: int) -> memoryview:
        n = max(0, min(n, self.size - at))
        if at < self.base or at + n > self.base + len(self.data):
            self.file.seek(at)
            self.data, self.base = self.file.read(max(n, WINDOW)), at
        return memoryview(self.data)[at - self.base : at - self.base + n]

    def next_start(self, at: int) -> int:
        """The next place from `at` on where a record may begin, or the end."""
        while at < self.size:
            self.get(at, min(WINDOW, self.size - at))
            found = [k for k in (self.data.find(mark, at - self.base) for mark in STARTS) if k >= 0]
            if found:
                return self.base + min(found)
            at = max(at + 1, self.base + len(self.data) - max(map(len, STARTS)) + 1)
        return self.size

    def pieces(self, at: int, n: int) -> Iterator[memoryview]:
        for k in range(0, n, WINDOW):
            yield self.get(at + k, min(WINDOW, n - k))


class Record:
    """A record as its plain bytes come in: its digest, its header, and whether it is whole."""

    def __init__(self, keep: bool):
        self.digest, self.head, self.last, self.size = hashlib.sha256(), b"", b"", 0
        self.parts: list[bytes] | None = [] if keep else None
        self.total = -1  # what the header says
        self.fields: dict[str, str] = {}

    def add(self, part: bytes | memoryview) -> bool:
        """Whether this may still be a record."""
        self.digest.update(part)
        self.size += len(part)
        self.last = (self.last + bytes(part[-4:]))[-4:]
        if self.parts is not None:
            self.parts.append(bytes(part))
        if self.total < 0:
            self.head += bytes(part[: LONGEST_HEAD + 4])
            end = self.head.find(END)
            if end >= 0:
                self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in self.head[:end].decode("utf-8", "replace").split("\r\n")[1:])}
                length = self.fields.get("content-length", "")
                self.total = end + 8 + int(length) if self.head.startswith(b"WARC/") and length.isascii() and length.isdigit() else -2
                self.head = b""
            elif len(self.head) > LONGEST_HEAD or self.head[:5] != b"WARC/"[: len(self.head)]:
                self.total = -2
        return self.total != -2 and not 0 <= self.total < self.size

    def whole(self) -> bool:
        return self.total == self.size and self.last == END


def read_plain(window: Window, at: int, keep: bool) -> tuple[int, Record] | None:
    """The record that begins at a place of a file without compression, and its size there."""
    head, n = Record(False), 4096
    while head.total == -1:
        part = window.get(at, n)
        head = Record(False)
        head.add(part)
        if head.total == -1 and (len(part) < n or n > LONGEST_HEAD):
            return None
        n *= 4
    if head.total < 0 or at + head.total > window.size:
        return None
    if window.get(at + head.total - 4, 4) != END:
        return None
    found = Record(keep)
    for part in window.pieces(at, head.total):
        found.add(part)
    return (head.total, found) if found.whole() else None


def read_member(window: Window, at: int, keep: bool) -> tuple[int, Record] | None:
    """The record in the gzip member that begins at a place, and the member's size."""
    inflate, found, pos = zlib.decompressobj(31), Record(keep), at
    rest: bytes | memoryview = b""
    try:
        while not inflate.eof:
            if not len(rest):
                rest = window.get(pos, 1 << 16)
                pos += len(rest)
                if not len(rest):
                    return None
            part = inflate.decompress(rest, WINDOW)
            rest = inflate.unconsumed_tail
            if not found.add(part):
                return None
    except zlib.error:
        return None
    return (pos - at - len(inflate.unused_data), found) if found.whole() else None


def warc_rows(file, size: int, keep: bool = False) -> Iterator[tuple]:
    """(ordinal, offset, length, stored offset, stored length, type, record id, uri, digest, digest of the stored bytes, plain bytes with keep) of each record and damaged range, in one pass."""
    window, at, offset, ordinal, bad = Window(file, size), 0, 0, 0, -1

    def stored_digest(begin: int, length: int) -> str:
        digest = hashlib.sha256()
        for part in window.pieces(begin, length):
            digest.update(part)
        return digest.hexdigest()

    def damaged() -> tuple:
        digest, parts = hashlib.sha256(), []
        for part in window.pieces(bad, at - bad):
            digest.update(part)
            parts += [bytes(part)] if keep else []
        return ordinal, offset, at - bad, bad, at - bad, "damaged", "", "", digest.hexdigest(), digest.hexdigest(), b"".join(parts) if keep else None

    while at < size:
        found = (read_member if window.get(at, 2) == b"\x1f\x8b" else read_plain)(window, at, keep)
        if not found:
            bad = at if bad < 0 else bad
            at = window.next_start(at + 1)
            continue
        if bad >= 0:
            yield damaged()
            ordinal, offset, bad = ordinal + 1, offset + at - bad, -1
        stored, record = found
        fields = record.fields
        yield ordinal, offset, record.size, at, stored, fields.get("warc-type", ""), fields.get("warc-record-id", ""), fields.get("warc-target-uri", ""), record.digest.hexdigest(), stored_digest(at, stored), b"".join(record.parts) if keep else None
        at, offset, ordinal = at + stored, offset + record.size, ordinal + 1
    if bad >= 0:
        yield damaged()


def dealt(files: DataFrame) -> DataFrame:
    """Files in as many partitions as their bytes ask for, a partition for each shuffle partition at least, but not more than there are files."""
    n, total = files.agg(F.count("*"), F.sum("size")).first()
    least = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(max(1, min(n, max(least, -(-(total or 0) // TASK_BYTES)))), "path")


READ = "path string, ordinal long, offset long, length long, stored_offset long, stored_length long, type string, record_id string, uri string, digest string, stored_digest string"
ROWS = 2000


def read_warc(files: DataFrame, keep: bool = False) -> DataFrame:
    """files(path, size) -> records and damaged ranges: READ, and content (binary) with keep. A task holds WINDOW bytes of a file and one record's content."""
    names = [c.split()[0] for c in READ.split(", ")] + ["content"] * keep
    types = [pa.string() if c.endswith("string") else pa.int64() for c in READ.split(", ")] + [pa.binary()] * keep

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for path, size in zip(part.column("path").to_pylist(), part.column("size").to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    rows = []
                    for row in warc_rows(f, size, keep):
                        rows.append((path, *row))
                        if keep or len(rows) >= ROWS:
                            yield batch(rows)
                            rows = []
                    yield batch(rows)

    return dealt(files).mapInArrow(run, READ + ", content binary" * keep)


def records(read: DataFrame, per_file: int = PER_FILE, root: str | None = None) -> DataFrame:
    """What read_warc gives for an archive's files -> file, slot, page_id, length, digest, stored_length, stored_digest, before of each record or damaged range.

    file is the path below `root` (without it the last part), whatever its form. The slot is the page id's place; a record of
    another archive has that of its record id's hash, or its uri's. before is a hash of the names of the record that lies before it in the file.
    """
    number = F.nullif(F.regexp_extract("record_id", r"urn:page:(-?\d+)", 1), F.lit("")).cast("long")
    name = F.regexp_extract("path", r"([^/]*)\z", 1) if root is None else F.substring_index("path", root.rstrip("/").removeprefix("file://") + "/", -1)
    rows = read.select(name.alias("file"), "ordinal", "type", number.alias("page_id"), "record_id", "uri", "length", "digest", "stored_length", "stored_digest")
    _, slot = places(F.col("page_id"), F.coalesce(F.nullif("record_id", F.lit("<urn:page:>")), F.col("uri")), per_file)
    slot = F.when(F.col("record_id").startswith("<urn:page:"), places(F.col("page_id"), F.col("uri"), per_file)[1]).otherwise(slot)
    rows = rows.withColumn("slot", F.when(F.col("type") != "damaged", slot))
    after = F.expr("coalesce(last(slot, true) over (partition by file order by ordinal rows between unbounded preceding and 1 preceding), -1) + 1")
    before = F.expr("coalesce(lag(xxhash64(type, record_id, uri)) over (partition by file order by ordinal), 0)")
    rows = rows.withColumns({"slot": F.coalesce("slot", F.least(after, F.lit(per_file - 1))), "before": before})
    return rows.drop("ordinal", "type", "uri", "record_id")


def leaves(recs: DataFrame) -> DataFrame:
    """A row for each slot, over its records in any order: own (their plain bytes), kept (their bytes in the file) and hash (these with what lies before each)."""

    def over(token: Column, name: str) -> list[Column]:
        part = F.conv(F.substring(token, 1, 15), 16, 10).cast("decimal(20,0)")
        return [F.sum(part).alias(f"{name}_total"), F.min(token).alias(f"{name}_low"), F.max(token).alias(f"{name}_high")]

    laid = F.sha2(F.concat_ws(":", "stored_digest", F.col("before").cast("string")), 256)
    sums = [x for token, name in ((F.col("digest"), "own"), (F.col("stored_digest"), "kept"), (laid, "laid")) for x in over(token, name)]
    made = recs.groupBy("file", "slot").agg(F.count("*").alias("records"), F.min("page_id").alias("page_id"), F.sum("length").alias("length"), F.sum("stored_length").alias("stored"), *sums)

    def hashed(name: str, size: str) -> Column:
        return F.sha2(F.concat_ws(":", "records", size, F.col(f"{name}_total").cast("string"), f"{name}_low", f"{name}_high"), 256)

    return made.select("file", "slot", "page_id", "length", "stored", F.col("own_low").alias("digest"), hashed("own", "length").alias("own"), hashed("kept", "stored").alias("kept"), hashed("laid", "stored").alias("hash"))


def above(width: int) -> tuple[Column, Column]:
    """The node above one: within a file by slots, then by files."""
    return (F.col("file"), F.expr(f"slot div {FAN}")) if width > 1 else (F.expr(f"file div {FAN}"), F.lit(0).cast("long"))


def parents(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes one level up: the hash of at most FAN children in order, each with the offset and length of its range of stored bytes, and their sum."""
    file, slot = above(width)
    child = F.struct((F.col("slot") if width > 1 else F.col("file")).alias("child"), F.col("stored").alias("length"), "hash")
    own = nodes.select(file.alias("file"), slot.alias("slot"), child.alias("c")).groupBy("file", "slot").agg(F.array_sort(F.collect_list("c")).alias("c"))
    start = F.struct(F.lit(0).cast("long").alias("offset"), F.lit("").alias("said"))

    def add(so_far: Column, c: Column) -> Column:
        said = F.concat_ws(":", c["child"].cast("string"), so_far["offset"].cast("string"), c["length"].cast("string"), c["hash"])
        return F.struct((so_far["offset"] + c["length"]).alias("offset"), F.concat(so_far["said"], said, F.lit(",")).alias("said"))

    folded = own.withColumn("f", F.aggregate("c", start, add))
    return folded.select("file", "slot", F.col("f.offset").alias("stored"), F.sha2("f.said", 256).alias("hash"))


def widths(per_file: int, files: int) -> list[int]:
    """For each level from the leaves up to the one below the root: how many slots a file has there; 1: levels of files."""
    out = []
    while per_file > 1:
        out.append(per_file)
        per_file = -(-per_file // FAN)
    while files > 1:
        out.append(1)
        files = -(-files // FAN)
    return out


def tree(recs: DataFrame, levels: list[int]) -> list[DataFrame]:
    """Levels from the leaves to the archive's one root; each is a table."""
    out = [save(leaves(recs), "leaves")]
    for width in levels:
        out.append(save(parents(out[-1], width), "nodes"))
    return out


def numbered_files(*replicas: DataFrame) -> DataFrame:
    """name, file: the files of all replicas in order of their names, from 0; a row for each file."""
    names = functools.reduce(DataFrame.unionByName, [r.select(F.col("file").alias("name")) for r in replicas]).distinct()
    order = F.row_number().over(Windowed.orderBy(F.length(F.regexp_extract("name", r"\A(\d*)", 1)), "name"))  # numbers in their own order
    return names.select("name", (order - 1).cast("long").alias("file"))


def audit(first: DataFrame, second: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """Two tables of records -> the slots where they differ: file, slot, page_id, offset in the first, bytes, digests, status.

    status: missing, extra; changed (the records themselves), stored (the same records in other bytes), moved (the same bytes
    after another record).
    """
    names = save(numbered_files(first, second), "files")
    one, two = (save(r.withColumnRenamed("file", "name").join(names, "name").drop("name"), "records") for r in (first, second))
    levels = widths(per_file, max(1, names.count()))
    a, b = tree(one, levels), tree(two, levels)
    bad: DataFrame | None = None
    for k in range(len(levels), -1, -1):
        x, y = a[k], b[k]
        if bad is not None:
            file, slot = above(levels[k])
            x, y = (level.join(bad.select(F.col("file").alias("__f"), F.col("slot").alias("__s")), (file == F.col("__f")) & (slot == F.col("__s")), "left_semi") for level in (x, y))
        marked = x.select("file", "slot", F.col("hash").alias("ha")).join(y.select("file", "slot", F.col("hash").alias("hb")), ["file", "slot"], "full")
        bad = save(marked.filter(~F.col("ha").eqNullSafe(F.col("hb"))).select("file", "slot"), "differ")
    within = a[0].join(bad.select("file").distinct(), "file", "left_semi")  # offsets of files with a difference
    place = within.withColumn("offset", F.expr("sum(length) over (partition by file order by slot) - length"))
    left = place.select("file", "slot", F.col("page_id").alias("pa"), "offset", F.col("length").alias("first_bytes"), F.col("digest").alias("first_digest"), F.col("own").alias("oa"), F.col("kept").alias("ka"))
    right = b[0].select("file", "slot", F.col("page_id").alias("pb"), F.col("length").alias("second_bytes"), F.col("digest").alias("second_digest"), F.col("own").alias("ob"), F.col("kept").alias("kb"))
    found = bad.join(left, ["file", "slot"], "left").join(right, ["file", "slot"], "left").join(names, "file")
    status = F.when(F.col("second_bytes").isNull(), "missing").when(F.col("first_bytes").isNull(), "extra").when(F.col("oa") != F.col("ob"), "changed").when(F.col("ka") != F.col("kb"), "stored").otherwise("moved")
    return found.select(F.col("name").alias("file"), "slot", F.coalesce("pa", "pb").alias("page_id"), "offset", "first_bytes", "second_bytes", "first_digest", "second_digest", status.alias("status"))


def copied(files: DataFrame, folder: str, change: Callable[[int, bytes], bytes | None]) -> DataFrame:
    """Copies of files with each record as `change`(page_id, plain bytes) leaves it: the same bytes, others, or none -> path and size of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stored(path: str, size: int) -> Iterator[tuple[int, bytes]]:
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_file(at) as f, store.open_input_file(at) as raw:
                for _, _, _, begin, length, _, name, _, _, _, plain in warc_rows(f, size, keep=True):
                    number = re.search(r"urn:page:(-?\d+)", name)
                    new = change(int(number[1]), plain) if number else plain
                    if new is plain:
                        raw.seek(begin)
                        yield file, raw.read(length)
                    elif new is not None:
                        yield file, gzip_member(new)

        for part in batches:
            for path, size in zip(part.column("path").to_pylist(), part.column("size").to_pylist(), strict=True):
                file = int(re.search(r"(-?\d+)\.warc", path)[1])
                yield from _listed(write_files(stored(path, size), folder))

    return save(dealt(files).mapInArrow(run, "path string, size long"), "warc-files")


def spoil(page_id: int, record: bytes, flip: int = 97, lose: int = 389) -> bytes | None:
    """What a bad disk leaves of a record: every lose-th is gone, every flip-th has its last character changed."""
    if page_id % lose == 7:
        return None
    if page_id % flip != 13:
        return record
    head, _, body = record[:-4].partition(END)
    new = (body.decode()[:-1] + "#").encode()
    return re.sub(rb"(?i)(content-length: )\d+\Z", rb"\g<1>%d" % len(new), head) + END + new + END


def audit_pages(pages: DataFrame, change: Callable[[int, bytes], bytes | None] = spoil, per_file: int = PER_FILE) -> DataFrame:
    """Pages written as WARC files, copied as a bad disk does, both replicas read back and audited."""
    spark = pages.sparkSession
    first = write_warc(pages, scratch(spark, "warc"), per_file)
    second = copied(first, scratch(spark, "replica"), change)
    one, two = (records(read_warc(files), per_file) for files in (first, second))
    return audit(one, two, per_file)


AUDIT_SQL = f"""
WITH replica AS (
  SELECT page_id, url, CASE WHEN page_id % 97 = 13 THEN left(html, greatest(length(html) - 1, 0)) || '#' ELSE html END AS html
  FROM pages WHERE page_id % 389 <> 7
), recs AS (
  SELECT which, page_id, page_id // {PER_FILE} AS file, page_id % {PER_FILE} AS slot,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec
  FROM (SELECT 1 AS which, page_id, url, html FROM pages UNION ALL SELECT 2, page_id, url, html FROM replica)
), a AS (
  SELECT *, sha256(rec) AS digest, strlen(rec) AS bytes, (sum(strlen(rec)) OVER w - strlen(rec))::BIGINT AS start, lag(page_id) OVER w AS before FROM recs WHERE which = 1 WINDOW w AS (PARTITION BY file ORDER BY slot)
), b AS (SELECT *, sha256(rec) AS digest, strlen(rec) AS bytes, lag(page_id) OVER (PARTITION BY file ORDER BY slot) AS before FROM recs WHERE which = 2)
SELECT a.file || '.warc.gz' AS file, a.slot, a.page_id, a.start AS "offset", a.bytes AS first_bytes, b.bytes AS second_bytes, a.digest AS first_digest, b.digest AS second_digest,
  CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.digest <> b.digest THEN 'changed' ELSE 'moved' END AS status
FROM a LEFT JOIN b USING (page_id) WHERE b.page_id IS NULL OR a.digest <> b.digest OR a.before IS DISTINCT FROM b.before
"""
