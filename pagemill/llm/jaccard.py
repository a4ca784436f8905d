"""N-gram Jaccard join: documents whose sets of word shingles are alike are linked, by grouped prefixes.

Two sets of sizes a and b with 100 * intersection >= percent * union share at least percent of the larger one, so under any
one order of shingles each has a shingle of the other among its first n - ceil(percent * n / 100) + 1. The order puts rare
shingles first. Documents with equal sets are one node; nodes with equal prefixes and sizes are one group, and only groups
are posted under the shingles of their prefix. Groups under a shingle are held against one of them first, members of a
group against its head; what these stars leave in several components is paired there (pairs are filtered by size and by
parity bitmaps, which bound the difference of two sets from below), and each pair that stays is
verified on the whole sets. No list is expanded to all its pairs, and none is cut short.

The order of shingles comes from all documents: the slices of text in which a shingle is in several documents count it,
and the counts are summed. That is a lower bound of its document frequency, which finds all but shingles of a few documents
and keeps the single ones, nearly all, out of the shuffle. The order costs or saves time; the result is the same under any.

A null text, an empty one and one without words have an empty set, which is linked with nothing: the component is the
document itself. Texts of fewer words are one shingle. Rows without doc_id have a set and no component, and link nothing.
Repeated rows and equal texts are linked like any others. Different texts under one doc_id are rows of their own. Other
columns are not read, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, doc_text, save, slices
from .neardup import connected_components

WORDS, PERCENT = 4, 85
#: Shingles whose frequency is known to all tasks; the others are ordered by hash before these.
FREQUENT = 1 << 18
#: Members of a list that a task holds at once.
SPLIT = 2048
#: Pairs of one head that a task verifies.
SALT = 512
#: Bits of the smallest and the largest parity bitmap.
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: Characters of text that a task turns into sets at once, and shingles that it counts together.
SLICE, COUNTED = 3_000_000, 1 << 21
#: Bits of a bitmap that goes out to all tasks: 32 MB.
MOST_MARKS = 1 << 28
#: Odd numbers without a pattern, one for each place in a shingle.
_FACTORS = np.random.default_rng(42).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """For each text the hashes of its distinct shingles, sorted."""
    import xxhash

    found = Words(texts)
    each = np.fromiter((xxhash.xxh64_intdigest(w.encode().lower()) for w in found.unique), np.uint64, len(found.unique))  # bytes: A-Z only
    flat, offsets = each[found.index], found.offsets

    def combined(size: int, at: slice) -> np.ndarray:
        """A hash of each run of `size` words: a sum of the words' hashes, each with a factor for its place."""
        own = flat[at]
        total = np.full(max(0, len(own) - size + 1), size, np.uint64)
        for k in range(size):
            total += own[k : k + len(total)] * _FACTORS[k]
        return mixed(total)

    whole = combined(words, slice(None))
    out = []
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        out.append(np.unique(whole[a : b - words + 1]) if b - a >= words else combined(b - a, slice(a, b)) if b > a else flat[:0])
    return out


def frequent_shingles(docs: DataFrame, words: int = WORDS, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of at most `most` shingles: those counted most often, down to a power of two."""

    def counted_once(held: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
        several = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(values[several].view(np.int64)), pa.array(counts[several].astype(np.int64))], names=["shingle", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                held += shingle_sets(part.column("text"), words)
                if sum(map(len, held)) >= COUNTED:
                    yield counted_once(held)
                    held = []
        yield counted_once(held)

    counted = save(doc_text(docs).select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "counts")
    sizes = {r.power: r.shingles for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("shingles")).collect()}
    least, kept = 0, 0
    for power in sorted(sizes, reverse=True):  # at most 64 rows
        kept += sizes[power]
        if kept > most:
            least = 1 << power + 1
            break
    rows = counted.filter(F.col("n") >= least).toPandas()  # at most `most` rows
    values = rows.shingle.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], rows.n.to_numpy(np.int64)[order]


def prefix(own: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a sorted set in the order (count, hash), as many as an alike set must meet."""
    if not len(own):
        return own
    at = np.searchsorted(frequent, own)
    rank = np.zeros(len(own), np.int64)
    known = at < len(frequent)
    known[known] = frequent[at[known]] == own[known]
    rank[known] = counts[at[known]]
    return own[np.lexsort((own, rank))][: len(own) - (percent * len(own) + 99) // 100 + 1]


def parity_bits(own: np.ndarray) -> bytes:
    """A bitmap in which a bit says whether an odd number of the set's shingles falls on it; about two bits a shingle."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(2 * len(own) - 1).bit_length()))
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def least_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of one bitmap (words) and rows of others of one size: shingles that are in one set only are at least so many."""
    size = min(len(a), b.shape[1])
    a = np.bitwise_xor.reduce(a.reshape(-1, size), axis=0)
    b = np.bitwise_xor.reduce(b.reshape(len(b), -1, size), axis=1)
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted sets."""
    least, most = sorted((len(a), len(b)))
    if 100 * least < percent * most:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketches(docs: DataFrame, words: int, percent: int, fingerprint: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, hash (xxhash64 of the text), n, node (hash of the set), group (hash of prefix and n), prefix, bits, and where it is asked for fp (the set's fingerprint as longs; none without words)."""
    context = docs.sparkSession.sparkContext
    order = context.broadcast(frequent_shingles(docs, words))
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("group", pa.int64()), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary())])
    if fingerprint:
        schema = schema.append(pa.field("fp", pa.list_(pa.int64())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        frequent, counts = order.value
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                own = shingle_sets(part.column("text"), words)
                nodes = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in own), np.uint64, len(own))
                first = [prefix(s, frequent, counts, percent).view(np.int64) for s in own]
                groups = np.fromiter((xxhash.xxh64_intdigest(f.tobytes(), len(s)) for f, s in zip(first, own, strict=True)), np.uint64, len(own))
                cols = [part.column("doc_id"), part.column("hash"), pa.array([len(s) for s in own], pa.int64()), pa.array(nodes.view(np.int64)), pa.array(groups.view(np.int64)), pa.array(first, schema.field("prefix").type), pa.array([parity_bits(s) for s in own], pa.binary())]
                if fingerprint:
                    cols.append(pa.array([fingerprint(s) if len(s) else s.view(np.int64) for s in own], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return doc_text(docs).withColumn("hash", F.xxhash64("text")).mapInArrow(run, "doc_id long, hash long, n long, node long, group long, prefix array<long>, bits binary" + ", fp array<long>" * bool(fingerprint))


def bitmap(rows: DataFrame, number: str) -> tuple[int, np.ndarray]:
    """How many bits, and bytes with the bits set on which the numbers of rows fall; 64 bits a row up to MOST_MARKS."""
    size = min(MOST_MARKS, 1 << max(15, (64 * rows.count()).bit_length()))
    at = F.pmod(F.col(number), F.lit(size))
    parts = rows.groupBy(F.shiftright(at, 15).alias("part")).agg(F.bitmap_construct_agg(at.bitwiseAND(32767)).alias("bits")).collect()  # 4 KB each, `size` bits in all at most
    out = np.zeros((size >> 15, 4096), np.uint8)
    for row in parts:
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return size, out.ravel()


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The sets of wanted(node, doc_id, hash) -> node, own (sorted hashes, 8 bytes each).

    Texts don't go through a shuffle: where each is read, a bitmap of the wanted ones of bounded size says which may be
    wanted, their sets are made there, and a join keeps those that are. A bitmap that has become too full for its bound
    only lets more sets through to the join.
    """
    named = wanted.withColumn("number", F.xxhash64("doc_id", "hash"))
    size, bits = bitmap(named, "number")
    marks = docs.sparkSession.sparkContext.broadcast(bits)
    texts = doc_text(docs).withColumn("hash", F.xxhash64("text")).withColumn("mark", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column("mark"))
            some = batch.filter(pa.array((marks.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            for part in slices(some, limit=SLICE):
                own = shingle_sets(part.column("text"), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("hash"), pa.array([s.tobytes() for s in own], pa.binary())], names=["doc_id", "hash", "own"])

    made = texts.mapInArrow(run, "doc_id long, hash long, own binary")
    return made.join(wanted, ["doc_id", "hash"]).select("node", "own").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v), v a head, whose whole sets are alike. A head of many pairs is held against them in several tasks."""
    sizes = pairs.groupBy("v").agg(F.ceil(F.count("*") / SALT).cast("int").alias("parts"))
    salted = pairs.join(sizes, "v").select("u", "v", F.pmod(F.xxhash64("u"), F.col("parts")).alias("salt"))
    heads = salted.select(F.col("v").alias("u"), "v", "salt").distinct()
    rows = salted.unionByName(heads).join(sets.hint("merge").withColumnRenamed("node", "u"), "u").select("v", "salt", (F.col("u") != F.col("v")).alias("member"), "u", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            good = []
            for member, own in zip(batch.column("member").to_pylist(), batch.column("own"), strict=True):
                own = np.frombuffer(own.as_buffer(), np.uint64)
                if not member:  # a head comes before its members
                    head = own.copy()
                good.append(member and alike(own, head, percent))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    ordered = rows.repartition("v", "salt").sortWithinPartitions("v", "salt", "member")
    return ordered.mapInArrow(run, "u long, v long")


class Block:
    """Members of one block of a list: node, label, n, major (of the list's largest component), keys (the lists a node is in), bits."""

    def __init__(self, rows: list[dict], key: int, percent: int):
        self.key, self.percent = key, percent
        self.node, self.label, self.n = (np.array([r[c] for r in rows]) for c in ("node", "label", "n"))
        self.major = np.array([r["major"] for r in rows], bool)
        self.keys = [np.array(r["keys"]) for r in rows]
        bits = [np.frombuffer(r["bits"], np.uint64) for r in rows]
        widths = np.array([len(b) for b in bits])
        self.shelves = [(np.flatnonzero(widths == w), np.stack([b for b in bits if len(b) == w])) for w in np.unique(widths)]

    def partners(self, row: dict) -> np.ndarray:
        """Members that may be alike with one that asks: those of the major component, and of other ones those of a larger node; each pair under the first list that both are in only."""
        total = self.n + row["n"]
        fine = (self.label != row["label"]) & (self.major | (self.node > row["node"])) & (100 * np.minimum(self.n, row["n"]) >= self.percent * np.maximum(self.n, row["n"]))
        bits, found = np.frombuffer(row["bits"], np.uint64), [np.zeros(0, np.int64)]
        for at, words in self.shelves:
            some = np.flatnonzero(fine[at])
            if len(some):
                apart = least_difference(bits, words[some])
                found.append(at[some[(100 + self.percent) * apart <= (100 - self.percent) * total[at[some]]]])
        keys = np.array(row["keys"])
        met = [k for k in np.concatenate(found).tolist() if np.intersect1d(self.keys[k], keys, assume_unique=True)[0] == self.key]
        return self.node[met]


def list_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, block, asks, major, node, label, n, keys, bits), whole (key, block) in a task, members before those of other blocks that ask -> pairs (u, v), each once.

    Members that are not of the list's major component ask within their own block, too.
    """
    key, members, block = None, [], None
    for batch in batches:
        u: list[np.ndarray] = [np.zeros(0, np.int64)]
        v: list[np.ndarray] = [np.zeros(0, np.int64)]

        def ask(row: dict) -> None:
            found = block.partners(row)
            u.append(np.full(len(found), row["node"], np.int64))
            v.append(found)

        def close() -> None:
            nonlocal block, members
            if members:
                block = Block(members, key[0], percent)
                for row in members:
                    if not row["major"]:
                        ask(row)
                members = []

        for row in batch.to_pylist():
            if (row["key"], row["block"]) != key:
                close()
                key, block = (row["key"], row["block"]), None
            if not row["asks"]:
                members.append(row)
            else:
                close()
                if block:
                    ask(row)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if members:
        block = Block(members, key[0], percent)
        for row in members:
            if not row["major"]:
                v.append(block.partners(row))
                u.append(np.full(len(v[-1]), row["node"], np.int64))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])


def left_pairs(lists: DataFrame, nodes: DataFrame, percent: int, split: int = SPLIT) -> DataFrame:
    """lists(key, node, label), nodes(node, n, bits) -> pairs (u, v) under one key and of different labels that sizes and bitmaps allow, each once.

    Of lists with the same members one counts. Of a key's components the largest asks nothing: its members meet the others'
    questions, dealt to blocks of about `split`.
    """
    counted = lists.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
    apart = counted.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.sum("n").alias("members"), F.sum("who").alias("who"), F.count("*").alias("labels")).filter("labels > 1")
    apart = apart.groupBy("members", "who", "most").agg(F.min("key").alias("key"))
    rows = save(lists.join(apart.select("key", "most", F.ceil(F.col("members") / split).cast("int").alias("parts")), "key"), "lists")
    within = rows.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys"))  # a node is in as many lists as its prefix has shingles at most
    rows = rows.join(nodes.select("node", "n", "bits").join(within, "node"), "node").withColumns({"major": F.col("label") == F.col("most"), "own": F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")})
    kept = [F.col(c) for c in ("major", "node", "label", "n", "keys", "bits")]
    members = rows.select("key", F.col("own").alias("block"), F.lit(False).alias("asks"), *kept)
    asking = rows.filter("not major and parts > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("block <> own").select("key", "block", F.lit(True).alias("asks"), *kept)
    dealt = members.unionByName(asking).repartition("key", "block").sortWithinPartitions("key", "block", "asks")
    return dealt.mapInArrow(lambda it: list_pairs(it, percent), "u long, v long")


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes(node, n, bits) that their sizes and bitmaps allow to be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (np.asarray(batch.column(c)) for c in ("n", "v_n"))
            good = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            a, b = batch.column("bits"), batch.column("v_bits")
            for k in np.flatnonzero(good).tolist():
                apart = least_difference(np.frombuffer(a[k].as_buffer(), np.uint64), np.frombuffer(b[k].as_buffer(), np.uint64)[None])[0]
                good[k] = (100 + percent) * apart <= (100 - percent) * (n[k] + m[k])
            yield batch.select(["u", "v"]).filter(pa.array(good))

    own = nodes.select(F.col("node").alias("u"), "n", "bits")
    other = nodes.select(F.col("node").alias("v"), F.col("n").alias("v_n"), F.col("bits").alias("v_bits"))
    return pairs.join(own, "u").join(other, "v").mapInArrow(run, "u long, v long")


def set_nodes(marked: DataFrame) -> DataFrame:
    """sketches -> a row for each different set with shingles: node, n, group, doc_id and hash of one of its texts, bits, and fp where there is one."""
    own = [F.first(c).alias(c) for c in ("bits", "fp") if c in marked.columns]
    found = marked.filter("doc_id is not null and n > 0").groupBy("node", "n", "group").agg(F.min(F.struct("doc_id", "hash")).alias("own"), *own)
    return save(found.select("node", "n", "group", "own.*", *[c for c in ("bits", "fp") if c in marked.columns]), "nodes")


def set_links(docs: DataFrame, marked: DataFrame, nodes: DataFrame, words: int, percent: int, known: DataFrame | None = None, split: int = SPLIT) -> DataFrame:
    """Edges (u, v) between alike sets that connect, with those of known(u, v), all that links connect; known ones are among them."""
    heads = save(nodes.groupBy("group").agg(F.min("node").alias("head"), F.count("*").alias("members")), "heads")
    # most postings are the only ones of their shingle: they are two numbers each, and go before anything is joined to them
    every = marked.filter("doc_id is not null and n > 0").groupBy("group").agg(F.first("prefix").alias("prefix")).select("group", F.explode("prefix").alias("key"))
    under = every.groupBy("key").agg(F.min("group").alias("star"), F.max("group").alias("other")).filter("star <> other").select("key", "star")
    posted = save(every.join(under, "key"), "posted")

    def labels(found: DataFrame) -> DataFrame:
        return save(connected_components(found).select(F.col("id").alias("node"), F.col("component").alias("label")), "labels")

    def labelled(frame: DataFrame, node: str, name: str, found: DataFrame) -> DataFrame:
        return frame.join(found.select(F.col("node").alias(node), F.col("label").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
        return labelled(labelled(pairs, "u", "a", found), "v", "b", found).filter("a <> b").drop("a", "b")

    def fetched(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        return save(whole_sets(docs, nodes.join(ends, "node", "left_semi").select("node", "doc_id", "hash"), words), "sets")

    # stars: members of a group with its head, groups under a shingle with one of them, the most shared one first
    inner = nodes.join(heads.filter("members > 1"), "group").filter("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v"), F.lit(0).alias("shared"))
    met = posted.filter("group <> star").groupBy("group", "star").agg(F.count("*").alias("shared"))
    outer = met.join(heads.select("group", F.col("head").alias("u")), "group").join(heads.select(F.col("group").alias("star"), F.col("head").alias("v")), "star").select("u", "v", "shared")
    if known is not None:
        now = labels(known)
        inner, outer = apart(inner, now), apart(outer, now)
    outer = save(possible(outer.select("u", "v"), nodes, percent).join(outer, ["u", "v"]).unionByName(inner.join(possible(inner.select("u", "v"), nodes, percent), ["u", "v"])), "outer")
    sets = fetched(outer)
    best = outer.groupBy("u").agg(F.max_by("v", F.struct("shared", "v")).alias("v"))
    edges = verified(best, sets, percent)
    edges = save(edges if known is None else edges.unionByName(known), "links")
    others = apart(outer.select("u", "v"), labels(edges))
    edges = save(edges.unionByName(verified(others.join(best, ["u", "v"], "left_anti"), sets, percent)), "links")

    # what the stars left apart: members of a group among themselves, and of all groups under a shingle
    placed = save(labelled(nodes.select("node", "group"), "node", "label", labels(edges)), "placed")
    low_high = placed.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    within = placed.join(low_high.filter("low <> high"), "group").select(F.col("group").alias("key"), "node", "label")
    listed = posted.select("key", "group")
    open_keys = listed.join(low_high, "group").groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select("key")
    across = save(listed.join(open_keys, "key").join(placed, "group").select("key", "node", "label").unionByName(within), "across")
    pairs = save(left_pairs(across, nodes, percent, split), "pairs")
    return edges.unionByName(verified(pairs, fetched(pairs), percent))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    marked = save(sketches(docs, words, percent), "sketches")
    nodes = set_nodes(marked)
    found = connected_components(set_links(docs, marked, nodes, words, percent)).withColumnRenamed("id", "node")
    reached = nodes.select("node", "doc_id").join(found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component"))
    least = reached.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_node = reached.join(least, "component").select("node", "component_id")
    own = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return marked.select("doc_id", "n", "node").join(by_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
