"""SimHash document fingerprints and a search in their Hamming radius.

Terms are pairs of neighbouring words (one word: itself), weighted by 1 + log2 of their count in the text, so that a
repeated line does not outvote the rest. Each term has BITS hashed bits; it votes its weight for a bit that is set and
against one that is not, and the signs of the sums are the fingerprint. The likeness of two fingerprints is the share
of equal bits, which estimates 1 - angle / pi.

The search keeps permuted tables: the bits are cut into more blocks than the radius, and for every choice of
blocks - radius of them there is a table keyed by those blocks. Fingerprints within the radius agree on all blocks of at
least one table, so an equality join on the keys finds all pairs, and each candidate is checked on all bits. Equal
fingerprints are searched once; a key with more than HOT_KEY fingerprints is split by chance into parts, in each of which
it is asked.

For the edited texts documents are sorted in ranges of descending doc_id, by Spark's sampled range partitions, so that one
doc_id with many rows fills several. A task goes through its range in order and holds only the text before; the last
document of a range is joined to the first one of the next range.

Null texts are empty texts; a text without words has the fingerprint of all zeros. Equal texts have equal fingerprints.
Rows without doc_id come last in the descending order of doc_id; rows of one doc_id follow each other by the hash of
their texts. Other columns are not read. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, doc_text, parts_for, save, slices

BITS = 256
LANES = BITS // 64
#: The multipliers of a 64-bit finaliser.
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
FIRST = -(2**63)
#: Distinct fingerprints under a key of a permuted table beyond which it is split.
HOT_KEY = 10_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX1
    x = (x ^ (x >> np.uint64(33))) * MIX2
    return x ^ (x >> np.uint64(33))


def simhash(texts: pa.Array) -> list[bytes]:
    """BITS / 8 bytes for each text."""
    import xxhash

    words = Words(texts)
    one = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.unique), np.uint64, len(words.unique))
    flat = one[words.index] if len(words.index) else np.zeros(0, np.uint64)
    out = []
    lanes = np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for a, b in zip(words.offsets.tolist(), words.offsets[1:].tolist()):
        own = flat[a:b]
        if not len(own):
            out.append(bytes(BITS // 8))
            continue
        terms = mixed(own[:-1]) + own[1:] if len(own) > 1 else own
        terms, count = np.unique(terms, return_counts=True)
        weight = (1 + np.log2(count)).astype(np.float32)
        votes = np.zeros(BITS, np.float32)
        for k in range(0, len(terms), 4096):
            bits = np.unpackbits(mixed(terms[k : k + 4096, None] + lanes).view(np.uint8), axis=1)
            votes += weight[k : k + 4096] @ bits.astype(np.float32)
        out.append(np.packbits(2 * votes > weight.sum(dtype=np.float32)).tobytes())
    return out


def likeness(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The share of equal bits, pair by pair."""
    x, y = (np.frombuffer(b"".join(z), np.uint64).reshape(-1, LANES) for z in (a, b))
    return 1 - np.bitwise_count(x ^ y).sum(1) / BITS


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(simhash(part.column("text")), pa.binary())], names=["doc_id", "fingerprint"])

    return doc_text(docs).mapInArrow(run, "doc_id long, fingerprint binary")


LANE_NAMES = [f"lane{k}" for k in range(LANES)]


def lanes(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints as LANES longs, with `members`, the number of rows of each."""
    text = F.hex("fingerprint")
    halves = [[F.conv(F.substring(text, 16 * k + j, 8), 16, 10).cast("long") for j in (1, 9)] for k in range(LANES)]
    return fps.groupBy("fingerprint").agg(F.count("*").alias("members")).withColumns({n: F.shiftleft(a, 32).bitwiseOR(b) for n, (a, b) in zip(LANE_NAMES, halves)})


def neighbours(queries: DataFrame, fps: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """All (asked, fingerprint, members, distance): distinct fingerprints of queries and of fps that differ in at most `radius` bits."""
    blocks = blocks or radius + 2
    nibbles = BITS // 4
    edges = [k * nibbles // blocks for k in range(blocks + 1)]
    chosen = list(combinations(range(blocks), blocks - radius))

    def tables(frame: DataFrame) -> DataFrame:
        text = F.hex("fingerprint")
        part = [F.substring(text, edges[k] + 1, edges[k + 1] - edges[k]) for k in range(blocks)]
        keys = [F.xxhash64(F.lit(t), *[part[k] for k in own]) for t, own in enumerate(chosen)]
        return frame.select("*", F.explode(F.array(*keys)).alias("key"))

    rows, asked = tables(lanes(fps)), tables(lanes(queries).drop("members"))
    asked = asked.select(F.col("fingerprint").alias("asked"), *[F.col(n).alias(f"q_{n}") for n in LANE_NAMES], "key")
    crowded = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_KEY).select("key", F.ceil(F.col("n") / HOT_KEY).cast("int").alias("parts"))
    rows = rows.join(crowded, "key", "left").withColumn("part", F.pmod(F.xxhash64("fingerprint"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    asked = asked.join(crowded, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    distance = sum((F.bit_count(F.col(n).bitwiseXOR(F.col(f"q_{n}"))) for n in LANE_NAMES), F.lit(0))
    near = asked.join(rows, ["key", "part"]).withColumn("distance", distance).filter(F.col("distance") <= radius)
    return near.select("asked", "fingerprint", "members", "distance").distinct()


def within_radius(queries: DataFrame, fps: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """All (query_id, doc_id, distance) whose fingerprints (binary) differ in at most `radius` bits."""
    near = neighbours(queries, fps, radius, blocks).select(F.col("asked").alias("qf"), "fingerprint", "distance")
    own = queries.select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("qf"))
    return own.join(near, "qf").join(fps, "fingerprint").select("query_id", "doc_id", "distance")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Beside the result: the place of a range's first and last text, for the document that ends the range before.
EDGE = "part int, first_text string, last_text string"


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text, whose last half comes from the next document by descending doc_id."""
    spark = docs.sparkSession
    base = doc_text(docs).withColumns({"place": F.coalesce("doc_id", F.lit(FIRST)), "hash": F.xxhash64("text")})
    order = [F.desc("place"), F.asc("hash")]
    ordered = base.repartitionByRange(parts_for(docs), *order).sortWithinPartitions(*order, "text")
    rows = save(ordered.select("doc_id", "text").mapInArrow(_edited, f"{EDITED}, {EDGE}"), "edited")
    edges = rows.filter("part is not null")
    parts = sorted(r.part for r in edges.select("part").collect())  # one row for each range that is not empty
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next int")
    heads = edges.select(F.col("part").alias("next"), F.col("first_text").alias("text"))
    ends = edges.select("doc_id", "part", "last_text").join(following, "part").join(heads, "next").select("doc_id", F.col("last_text").alias("own"), "text")
    return rows.filter("part is null").select(*(c.split()[0] for c in EDITED.split(", "))).unionByName(ends.mapInArrow(_edited_ends, EDITED))


def _edited_rows(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, following, strict=True)]
    own, new, after = (simhash(pa.array(x, pa.large_string())) for x in (texts, edited, following[-1:]))
    after = own[1:] + after  # following texts are the texts but for the last
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()), pa.array([x.hex() for x in own], pa.string()), pa.array([x.hex() for x in new], pa.string()), pa.array(likeness(own, new)), pa.array(likeness(own, after))],
        names=[c.split()[0] for c in EDITED.split(", ")],
    )


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order -> their rows, the last one as an edge with the range's first and last text."""
    first, kept, types = None, None, [pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        for part in slices(batch):
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            if kept:
                ids, texts = [kept[0], *ids], [kept[1], *texts]
            first = texts[0] if kept is None else first
            kept = (ids[-1], texts[-1])
            if len(texts) > 1:
                done = _edited_rows(ids[:-1], texts[:-1], texts[1:])
                yield pa.RecordBatch.from_arrays([*done.columns, *(pa.nulls(len(done), t) for t in types)], names=done.schema.names + [c.split()[0] for c in EDGE.split(", ")])
    if kept:
        edge = [TaskContext.get().partitionId(), first, kept[1]]
        done = _edited_rows([], [], [])
        nulls = [pa.array([kept[0]], pa.int64()), *(pa.nulls(1, c.type) for c in done.columns[1:])]
        yield pa.RecordBatch.from_arrays([*nulls, *(pa.array([x], t) for x, t in zip(edge, types))], names=done.schema.names + [c.split()[0] for c in EDGE.split(", ")])


def _edited_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, own, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "own", "text")), strict=True):
            yield _edited_rows([doc_id], [own], [text])


def fingerprint_report(docs: DataFrame, radius: int = 3, every: int = 100) -> DataFrame:
    """edited_fingerprints, and n_within: how many rows of all lie within `radius` bits of the fingerprint, itself included; asked for doc_ids divisible by `every`, else null."""
    rows = save(edited_fingerprints(docs), "rows")
    fps = rows.select("doc_id", F.unhex("fingerprint").alias("fingerprint"))
    near = neighbours(fps.filter(F.col("doc_id") % every == 0), fps, radius)
    found = near.groupBy(F.lower(F.hex("asked")).alias("fingerprint")).agg(F.sum("members").alias("n_within"))
    joined = rows.join(found, "fingerprint", "left")
    return joined.withColumn("n_within", F.when(F.col("doc_id") % every == 0, F.col("n_within"))).select(*rows.columns, "n_within")
