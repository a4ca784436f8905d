"""SimHash near-duplicates: fingerprints within a Hamming radius are linked, and documents get their component.

Two fingerprints within radius r agree on at least one of r + 1 blocks of bits, so each fingerprint is dealt to the group
of each of its blocks; groups above `hot` are dealt again by the blocks of the remaining bits. Within a task the groups
lie in Gray order under a tree whose nodes hold the bits that all members share: a query goes down only where the
differences on those bits stay within the radius, and not to members already in its component. A group gives a star of
edges per component of its own, never all pairs. Stars become components by alternating large and small star steps.

Null texts are empty texts; texts without words have the fingerprint zero, linked like any other. Rows without doc_id
have a fingerprint and no component, and link nothing. Repeated rows and equal texts share one fingerprint. Other
columns are not read, whatever their names. An empty table gives an empty table.

`near_copies` is for similarity instead: pairs whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more. Such
pairs differ in 0.15 of their SimHash bits, too many for radius + 1 blocks of 64. So their fingerprints have WIDE bits, and
each is dealt to the groups of a few permuted tables; in a group fingerprints are near within a radius over all WIDE bits
(over few of them texts that share a passage are near by the many), and each is held against one of its group by the exact
similarity of their sets. That links most copies. Whatever it misses is found by the prefixes of the sets (`jaccard`), which
no alike pair escapes, so that no link depends on a table or a radius.

`keep_representatives` and `keep_unlike` keep one row of each component and every row without doc_id. Different texts under
one doc_id are judged each by itself; of rows alike in doc_id and text one stays. Ties go to the smallest doc_id.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, doc_text, made, save, slices, unused

BITS, SEED = 64, 42
#: Members of a group beyond which it is dealt again.
HOT_GROUP = 4096
FAN = 8
#: Query-member pairs that a task holds at once.
PAIRS = 4_000_000
#: Bits of the fingerprints of `near_copies`.
WIDE = 512
WORDS = [f"fp{k}" for k in range(WIDE // 64)]
#: Bits of a table's keys, up to so many fingerprints; a bit more for each four times as many.
KEY_BITS, FEW = 12, 1 << 18
#: Tables that a pair at the limit of similarity shares on average: it shares none with probability exp(-SHARED), were all bits independent.
SHARED = 12
#: The same for the first pass of `near_copies`, after which exact filters look for what it has not linked.
FIRST = 1
#: Sets of at most so many shingles differ in more bits, up to TIES times (0.19 where they are 4 and 5, since even ones have ties), and are in twice as many tables.
TINY = 5
TIES = 1.3
#: One fingerprint of this many says which groups are crowded.
SAMPLED = 16
#: Members of a list beyond which it is compared as pairs of blocks.
SPLIT = 512


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The XXH64 values of all shingles in order, repeats included; a text with fewer words is one shingle."""
    import xxhash

    parts = text.encode().lower().split()  # bytes: A-Z only, and white space 9-13 and 32
    if not parts:
        return np.zeros(0, ">u8")
    line = b" ".join(parts)
    ends = [*accumulate(len(p) + 1 for p in parts)]
    starts = [0, *ends[: max(0, len(parts) - words)]]
    ends = ends[min(words, len(parts)) - 1 :]
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(line[a : b - 1], SEED) for a, b in zip(starts, ends, strict=True)), ">u8", len(starts))


def shingle_fingerprint(text: str, words: int) -> int:
    """The majority of each bit over the XXH64 values of all shingles, repeats included; a tie is 0."""
    hashes = shingle_hashes(text, words)
    votes = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big", signed=True)


def shingle_fingerprints(docs: DataFrame, words: int = 3, rows: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fp (the 64 bits as a signed long), with rows also hash (xxhash64 of the text)."""
    texts = doc_text(docs)
    if rows:
        texts = texts.withColumn("hash", F.xxhash64("text"))
    names = ["hash"] if rows else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = [shingle_fingerprint(t, words) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.int64()), *(part.column(c) for c in names)], names=["doc_id", "fp", *names])

    return texts.mapInArrow(run, "doc_id long, fp long" + ", hash long" * rows)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order: each bit is the parity of the bits from it up."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest member of each of n nodes' component under the edges a-b, from labels so far."""
    label = np.arange(n) if label is None else label.copy()
    while len(a):
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label != (up := label[label])).any():
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def tree(codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By level from the leaves up: the bits that all FAN members of a node share, and their values."""
    every, some, levels = codes, codes, []
    while len(every) > 1:
        edges = np.arange(0, len(every), FAN)
        every, some = np.bitwise_and.reduceat(every, edges), np.bitwise_or.reduceat(some, edges)
        levels.append((~(every ^ some), every))
    return levels


def link_groups(group: np.ndarray, codes: np.ndarray, radius: int) -> np.ndarray:
    """For members sorted by group and Gray rank: the first member of each one's component within its group."""
    n = len(codes)
    levels = tree(codes)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, n])
    end = np.repeat(first + size, size)
    label = np.arange(n)
    cost = np.cumsum(np.repeat(size, size))
    block = cost // PAIRS
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]
    for lo, hi in zip(edges, edges[1:], strict=False):
        q = np.arange(lo, hi)
        q = q[end[q] - q > 1]
        depth = 0
        while depth < len(levels) and FAN**depth < (end[q] - q).max(initial=0):
            depth += 1
        low, high = [label], [label]  # the labels below each node
        for _ in range(depth):
            at = np.arange(0, len(low[-1]), FAN)
            low.append(np.minimum.reduceat(low[-1], at))
            high.append(np.maximum.reduceat(high[-1], at))
        span = FAN**depth
        counts = (end[q] - 1) // span - q // span + 1
        node = np.repeat(q // span, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        q = np.repeat(q, counts)
        for k in range(depth, -1, -1):
            if k < depth:
                q, node = np.repeat(q, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
            here = (node * FAN**k < end[q]) & ((node + 1) * FAN**k > q + 1) & (node < len(low[k]))
            q, node = q[here], node[here]
            same = (low[k][node] == label[q]) & (high[k][node] == label[q])
            mask, value = levels[k - 1] if k else (None, codes)
            off = codes[q] ^ value[node]
            go = ~same & (np.bitwise_count(off if mask is None else off & mask[node]) <= radius)
            q, node = q[go], node[go]
        label = components(n, q, node, label)
    return label


def groups_to_stars(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, id) sorted by key, whole keys in a task -> edges (u, v) of a star for each component in a group."""

    def stars(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        codes = fp.view(np.uint64)
        order = np.lexsort((gray_rank(codes), key))
        label = link_groups(key[order], codes[order], radius)
        node = node[order]
        far = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[label[far]])], names=["u", "v"])

    kept: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.asarray(batch.column(c)) for c in ("key", "fp", "id")]
        if kept:
            rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
        open_ = np.searchsorted(rows[0], rows[0][-1])  # the last key may go on in the next batch
        if open_:
            yield stars(*(np.ascontiguousarray(x[:open_]) for x in rows))
        kept = [x[open_:] for x in rows]
    if kept:
        yield stars(*(np.ascontiguousarray(x) for x in kept))


def block_edges(parts: int, bits: range) -> list[int]:
    """Where `parts` runs of `bits`, as equal as they can be, begin, and where the last one ends."""
    if not 1 < parts <= len(bits):
        raise ValueError(f"{len(bits)} bits do not make {parts} blocks")
    return [bits.start + len(bits) * k // parts for k in range(parts + 1)]


def blocks(fp: Column, parts: int, bits: range) -> list[Column]:
    """The bits of each of `parts` runs of `bits` (0: lowest), as numbers."""
    edges = block_edges(parts, bits)
    return [F.shiftrightunsigned(fp, a).bitwiseAND((1 << b - a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def deal(fps: DataFrame, parts: int, width: int) -> DataFrame:
    """fps(key, rest, fp, id) -> a row for each of `parts` blocks of the low `width` bits of rest; key then also names the block and its bits.

    rest becomes the other bits, less so many that all blocks leave alike: bits that two fingerprints agree on in all but
    `parts` - 1 places they agree on after any are left out.
    """
    edges, step = block_edges(parts, range(width)), -(-width // parts)
    keyed = fps.select("key", "rest", "fp", "id", F.posexplode(F.array(*blocks(F.col("rest"), parts, range(width)))).alias("block", "value"))
    top = f"array({', '.join(map(str, edges[1:]))})[block]"  # where the block ends; what is above it comes down to the bottom
    turned = F.expr(f"if({top} = {width}, rest, shiftrightunsigned(rest, {top}) | shiftleft(rest, {width} - {top}))")
    left = turned.bitwiseAND((1 << width - step) - 1)
    return keyed.select(F.xxhash64("key", "block", "value").alias("key"), left.alias("rest"), "fp", "id")  # keys that fall together cost time, not results


def link_stars(fps: DataFrame, radius: int = 3, hot: int = HOT_GROUP) -> DataFrame:
    """fps(fp, id), distinct -> edges (u, v) between ids: every pair of fingerprints within the radius is connected by them.

    Groups above `hot` members are dealt again by blocks of their remaining bits, and so on until none is or too few bits
    remain to tell more than 2 ** radius members apart.
    """
    parts, width, done = radius + 1, BITS, []
    dealt = fps.select(F.lit(0).alias("key"), F.col("fp").alias("rest"), "fp", "id")
    while True:
        dealt = deal(dealt, parts, width)
        width -= -(-width // parts)
        crowded = save(dealt.groupBy("key").agg(F.count("*").alias("members")).filter(F.col("members") > hot).select("key"), "crowded")
        if width < parts or crowded.isEmpty():
            done.append(dealt)
            break
        done.append(dealt.join(crowded, "key", "left_anti"))
        dealt = save(dealt.join(crowded, "key"), "dealt")
    sorted_ = functools.reduce(DataFrame.unionByName, done).select("key", "fp", "id").repartition("key").sortWithinPartitions("key")
    return sorted_.mapInArrow(lambda it: groups_to_stars(it, radius), "u long, v long")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u, v) of longs -> (id, component): the smallest id that each id of an edge can reach."""
    spark, mark = edges.sparkSession, made()
    edges = save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v")
        edges = save(small.distinct(), "edges")
        discard(spark, mark, keep=1)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now
    raise RuntimeError("the components did not settle; raise most_rounds")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, hot: int = HOT_GROUP, rows: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable); with rows also hash, xxhash64 of the text, and component, which tells components apart that share a doc_id."""
    marked = save(shingle_fingerprints(docs, words, rows), "fingerprints")
    named = marked.filter("doc_id is not null")
    distinct = save(named.groupBy("fp").agg(F.min("doc_id").alias("id")), "distinct")
    # ids of components are places among distinct fingerprints, not doc_ids: one doc_id may have several texts
    found = connected_components(link_stars(distinct.select("fp", F.col("fp").alias("id")), radius, hot))
    reached = distinct.join(found.withColumnRenamed("id", "node"), F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    least = reached.groupBy("component").agg(F.min("id").alias("component_id"))
    by_fp = reached.join(least, "component").select("fp", "component", "component_id")
    joined = marked.join(by_fp, "fp", "left")
    hash_ = ["hash", "component"] if rows else []
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), *hash_)


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of docs for each component of found(doc_id, hash, component): that of the smallest doc_id, of equal ones that of the smallest hash.

    hash is xxhash64 of the text, so that different texts under one doc_id are rows of their own; of rows alike in both one
    stays. Rows without doc_id stay. All columns stay as they are, whatever their names. Only rows that go, and rows that
    occur more than once, are joined to the texts.
    """
    named = found.filter("doc_id is not null")
    rows = save(named.groupBy("doc_id", "hash").agg(F.min("component").alias("component"), F.count("*").alias("copies")), "rows")
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "hash")).alias("first"))
    judged = rows.join(first, "component").withColumn("goes", F.struct("doc_id", "hash") != F.col("first"))
    judged = save(judged.filter("goes or copies > 1").select("doc_id", "hash", "goes"), "judged")
    own_id, own_hash, doc_id = unused("own_id", docs), unused("own_hash", docs), unused("judged_id", docs)
    marked = docs.withColumns({own_id: F.col("doc_id").cast("long"), own_hash: F.xxhash64(F.coalesce("text", F.lit("")))})

    def among(goes: bool) -> tuple[DataFrame, Column]:
        few = judged.filter(F.col("goes") == goes).select(F.col("doc_id").alias(doc_id), F.col("hash").alias(f"{doc_id}_hash"))
        return few, (F.col(own_id) == F.col(doc_id)) & (F.col(own_hash) == F.col(f"{doc_id}_hash"))

    going, same = among(True)
    kept = marked.join(going.hint("merge"), same, "left_anti")  # the same plan at every size
    repeated, same = among(False)
    if not repeated.isEmpty():
        kept = kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates([own_id, own_hash]))
    return kept.drop(own_id, own_hash)


def keep_representatives(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """The first row of each component of near duplicates by fingerprint."""
    found = near_duplicates(docs, words, radius, rows=True)
    return keep_first(docs, found)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of distinct hashes over WIDE bits: each is drawn out to WIDE bits (splitmix64), a bit is their majority; a tie is 0."""
    votes = np.zeros(WIDE, np.int64)
    step = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(0, len(hashes), 255):  # as many as a byte counts
        x = hashes[k : k + 255, None] + step
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        votes += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * votes > len(hashes)).view(np.int64)


def differing(similarity: float) -> float:
    """The share of SimHash bits in which sets of this Jaccard similarity differ, by the largest angle that they can have."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def tables_for(n: int, similarity: float, shared: float = SHARED) -> tuple[int, int]:
    """Bits of a key and number of tables for n fingerprints, of which a pair at the limit of similarity shares so many on average."""
    bits = KEY_BITS + (max(0, -(-n // FEW) - 1).bit_length() + 1) // 2
    return bits, int(np.ceil(shared / (1 - differing(similarity)) ** bits))


def near_radius(similarity: float, ties: float = 1) -> int:
    """The distance over WIDE bits: five standard deviations above that of pairs at this similarity (times `ties`), twelve below that of unlike texts."""
    p = differing(similarity) * ties
    return int(WIDE * p + 5.2 * (WIDE * p * (1 - p)) ** 0.5)


def deal_tables(fps: DataFrame, bits: int, tables: int) -> DataFrame:
    """fps(node, size, fp) -> a row for each of the permuted tables: key (the table and `bits` bits of fp), node, tiny (a set of TINY shingles or fewer), fp0, fp1 and so on (fp by words of 64 bits)."""
    rng, whole = np.random.default_rng(SEED), WIDE // bits
    places = np.concatenate([rng.permutation(WIDE)[: whole * bits] for _ in range(-(-2 * tables // whole))])

    def deal(part: pa.RecordBatch, among: int, tiny: bool) -> pa.RecordBatch:
        fp = np.asarray(part.column("fp").flatten()).reshape(-1, WIDE // 64)
        each = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1)[:, places[: among * bits]].reshape(len(fp), among, bits)
        key = each @ (1 << np.arange(bits)) + (np.arange(among) << bits)
        cols = [key.ravel(), np.repeat(np.asarray(part.column("node")), among), np.full(key.size, tiny), *(np.repeat(x, among) for x in fp.T)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "node", "tiny", *WORDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            few = np.asarray(batch.column("size")) <= TINY
            for tiny, among in ((True, 2 * tables), (False, tables)):
                part = batch.filter(pa.array(few == tiny))
                for at in range(0, part.num_rows, 1024):
                    yield deal(part.slice(at, 1024), among, tiny)

    return fps.mapInArrow(run, "key long, node long, tiny boolean, " + ", ".join(f"{c} long" for c in WORDS))


def near_members(codes: Sequence[np.ndarray], radius: int) -> np.ndarray:
    """For each of a group's fingerprints (in words of 64 bits): the first member of its component under distances within the radius."""

    def off(lo: int, hi: int) -> np.ndarray:
        return functools.reduce(np.add, (np.bitwise_count(c[lo:hi, None] ^ c).astype(np.uint16) for c in codes))

    n = len(codes[0])
    label = np.arange(n)
    first = off(0, 1)[0] <= radius
    label[first] = 0
    step = max(1, PAIRS // n)
    for lo in range(0, n if not first.all() else 0, step):
        x, y = np.nonzero((off(lo, lo + step) <= radius) & (label[lo : lo + step, None] < label))
        label = components(n, x + lo, y, label) if len(x) else label
    return label


def near_groups(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows of `deal_tables` sorted by key, whole keys in a task -> nodes of each component of two members or more in a key's group, in order. A group with a tiny set has a wider radius."""
    radius = [near_radius(similarity), near_radius(similarity, TIES)]

    def near(key: np.ndarray, node: np.ndarray, tiny: np.ndarray, *codes: np.ndarray) -> pa.RecordBatch:
        edges = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
        label = np.arange(len(key))
        for k in np.flatnonzero(np.diff(edges) > 1):
            lo, hi = edges[k], edges[k + 1]
            label[lo:hi] = lo + near_members([c[lo:hi] for c in codes], radius[int(tiny[lo:hi].any())])
        some = np.bincount(label, minlength=len(key))[label] > 1
        node, label = node[some], label[some]
        order = np.lexsort((node, label))
        node, label = node[order], label[order]
        edges = np.flatnonzero(np.r_[True, label[1:] != label[:-1], True]) if len(label) else np.zeros(1)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(node))], names=["nodes"])

    kept: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "tiny")] + [np.asarray(batch.column(c)).view(np.uint64) for c in WORDS]
        if kept:
            rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
        open_ = np.searchsorted(rows[0], rows[0][-1])  # the last key may go on in the next batch
        if open_:
            yield near(*(x[:open_] for x in rows))
        kept = [x[open_:] for x in rows]
    if kept:
        yield near(*kept)


def near_fingerprints(distinct: DataFrame, similarity: float, hot: int, shared: float = SHARED) -> DataFrame:
    """distinct(node, size, fp) -> key, head (the first node), node, n: groups of two or more whose fingerprints are near and share a key in n tables; a pair as similar as asked is in one with a probability that grows with `shared`.

    Groups with the same members are one. Groups of a key above about `hot` members (by a sample, which only decides the plan) are compared as pairs of blocks.
    """
    fps = distinct.filter(F.size("fp") > 0).select("node", "size", "fp")
    bits, tables = tables_for(distinct.count(), similarity, shared)
    rows = deal_tables(fps, bits, tables)
    sample = deal_tables(fps.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0), bits, tables).groupBy("key").agg(F.count("*").alias("n"))
    crowded = save(sample.filter(F.col("n") * SAMPLED > hot).select("key", F.ceil(F.col("n") * SAMPLED / hot).cast("int").alias("parts")), "crowded")
    if not crowded.isEmpty():
        split = rows.join(crowded, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
        rows = rows.join(crowded, "key", "left_anti").unionByName(split.select(pair.alias("key"), "node", "tiny", *WORDS))
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: near_groups(it, similarity), "nodes array<long>")
    groups = found.groupBy("nodes").agg(F.count("*").alias("n"))
    # keys that fall together cost time, not results
    return groups.select(F.xxhash64("nodes").alias("key"), F.col("nodes")[0].alias("head"), F.explode("nodes").alias("node"), "n")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, split: int = SPLIT, hot: int = HOT_GROUP) -> DataFrame:
    """docs(doc_id, text) -> doc_id, hash, component_id (the smallest doc_id that pairs of alike texts reach); rows without doc_id have none; component tells components apart that share a doc_id.

    What is linked are distinct sets of shingles (nodes). A node is held first against the head (first member) that most of
    its groups of near SimHash fingerprints have. The links that this finds don't decide what is linked, only how much is
    left to do: every alike pair that they have not brought together meets under a shingle of its prefixes (`jaccard`).
    """
    from . import jaccard

    percent = round(100 * similarity)
    marked = save(jaccard.sketches(docs, words, percent, wide_fingerprint), "sketches")
    nodes = jaccard.set_nodes(marked)
    groups = near_fingerprints(nodes.select("node", F.col("n").alias("size"), "fp"), similarity, hot, FIRST)
    stars = groups.filter("node <> head").groupBy("node", "head").agg(F.sum("n").alias("n"))
    best = save(stars.groupBy(F.col("node").alias("u")).agg(F.max_by("head", F.struct("n", "head")).alias("v")), "stars")
    wanted = nodes.join(best.select(F.col("u").alias("node")).union(best.select("v")).distinct(), "node", "left_semi").select("node", "doc_id", "hash")
    known = save(jaccard.verified(best, save(jaccard.whole_sets(docs, wanted, words), "sets"), percent), "links")
    found = connected_components(jaccard.set_links(docs, marked, nodes, words, percent, known, split)).withColumnRenamed("id", "node")
    # texts without words are one node, which links have nothing to do with
    ids = marked.filter("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    reached = ids.join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = reached.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = reached.join(least, "component").select("node", "component", "component_id")
    return marked.select("doc_id", "hash", "node").join(by_node, "node", "left").select("doc_id", "hash", "component", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_unlike(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The first row of each component of near copies."""
    return keep_first(docs, near_copies(docs, words, similarity))
