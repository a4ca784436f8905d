"""Hard-negative mining by Kronecker-packed products.

Vectors become integers (floor of `scale` times each component). Several candidates' components, biased so that none is
negative, lie in separate fields of one wide integer; an anchor's component is multiplied with it once for all of them, and
the sums over the components unpack into the exact inner products. The wide integer is the 53-bit mantissa of a double, so
that the products of a block are one matrix product without rounding. Where a block's values leave no room for two fields a
field takes all bits; beyond that, values are split into limbs whose products are packed likewise and added modulo 2**64.

Anchors and candidates meet in blocks: each task streams blocks of candidates past blocks of anchors that it holds, and
keeps the best of each anchor only, so memory follows the size of a block and what is shuffled follows anchors and tasks.
One pass finds each anchor's positives (only blocks' rows of its label are multiplied), a second one its negatives.

Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. Rows that are alike in
vec_id, label and vector count once; rows of one vec_id and different contents are rows of their own, and none of them is an
anchor's "other row" under its own vec_id. A vector shorter than another is as if followed by zeros; an empty one takes part
and scores zero. Ties go to the smaller vec_id. Other columns are not read. An empty table, or one without anchors, gives an
empty table. A component that is no 53-bit integer after scaling, or a score that is no long, is an error: a longer one could
not be returned.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

SCALE = 256
#: Anchors and candidates of a block, and anchors that are multiplied with a block of candidates at once.
ANCHORS, CANDIDATES, TURN = 8192, 4096, 512
MANTISSA = 53
NONE = np.iinfo(np.int64).min


def fields(a_span: int, c_span: int, dim: int) -> int:
    """How many sums of dim products of numbers up to the two spans fit side by side into a double's mantissa."""
    return MANTISSA // max(1, int(a_span * c_span * max(1, dim)).bit_length())


def packed_products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with the rows of c (integers), modulo 2**64."""
    m, n, dim = len(a), len(c), a.shape[1]
    if not (m and n and dim):
        return np.zeros((m, n), np.int64)
    a_low, c_low = int(a.min()), int(c.min())
    a_span, c_span = int(a.max()) - a_low, int(c.max()) - c_low
    room = fields(a_span, c_span, dim)
    if not room:  # the wider side goes into two limbs
        if max(a_span, c_span) == c_span:
            return packed_products(c, a).T
        half = a_span.bit_length() // 2
        high = a >> half
        with np.errstate(over="ignore"):
            return (packed_products(high, c) << half) + packed_products(a - (high << half), c)
    width = int(a_span * c_span * dim).bit_length() or 1
    above, beside = a - a_low, c - c_low
    rows = -(-n // room)
    wide = np.zeros((rows, dim))
    for k in range(room):
        part = beside[k * rows : (k + 1) * rows]
        wide[: len(part)] += np.ldexp(part.astype(np.float64), k * width)
    sums = (above.astype(np.float64) @ wide.T).astype(np.int64)  # one multiplication for each anchor component and word
    out = np.empty((m, n), np.int64)
    for k in range(room):
        upto = min(n, (k + 1) * rows) - k * rows
        if upto > 0:
            out[:, k * rows : k * rows + upto] = (sums[:, :upto] >> k * width) & ((1 << width) - 1)
    with np.errstate(over="ignore"):
        a_sum, c_sum = above.sum(1, dtype=np.int64), beside.sum(1, dtype=np.int64)
        return out + np.int64(c_low) * a_sum[:, None] + np.int64(a_low) * c_sum[None] + np.array(a_low * c_low * dim & 2**64 - 1, np.uint64).view(np.int64)


def scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """packed_products, checked to be the true ones: no score is beyond a long."""
    dim = max(a.shape[1], c.shape[1])
    a, c = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (a, c))
    if dim and len(a) and len(c) and int(np.abs(a).max()) * int(np.abs(c).max()) * dim >= 1 << 63 and np.abs(a.astype(np.float64) @ c.T.astype(np.float64)).max() > 0.99 * 2**63:
        raise ValueError("a score is no long: the vectors are too large to mine with this scale")
    return packed_products(a, c)


def integers(vectors: pa.Array, scale: int) -> np.ndarray:
    """A row of integers for each vector, zeros after its end."""
    offsets = np.asarray(vectors.offsets, np.int64)
    flat = np.floor(np.asarray(vectors.values[offsets[0] : offsets[-1]], np.float64) * scale)
    if len(flat) and np.abs(flat).max() >= 2**MANTISSA:
        raise ValueError(f"a component is no {MANTISSA}-bit integer at this scale")
    size = np.diff(offsets)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None] < size[:, None]] = flat.astype(np.int64)
    return out


class Best:
    """The best `keep` of what each of `slots` has been offered: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, keep: int):
        self.keep, self.least = keep, np.full(slots, NONE)
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, slot: int | np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score[i, j] of ids[j] for slot[i]; NONE: no offer."""
        cut = self.least[slot]
        if score.shape[1] > self.keep:
            cut = np.maximum(cut, np.partition(score, score.shape[1] - self.keep, axis=1)[:, -self.keep])
        i, j = np.nonzero((score >= cut[:, None]) & (score != NONE))
        if not len(i):
            return
        slots = np.concatenate([self.slot, slot[i]])
        values, names = np.concatenate([self.score, score[i, j]]), np.concatenate([self.id, ids[j]])
        order = np.lexsort((names, -values, slots))
        slots = slots[order]
        first = np.r_[True, slots[1:] != slots[:-1]]
        place = np.arange(len(slots)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        order = order[place < self.keep]
        self.slot, self.score, self.id = slots[place < self.keep], values[order], names[order]
        full = np.flatnonzero(np.bincount(self.slot, minlength=len(self.least)) == self.keep)
        last = np.searchsorted(self.slot, full, side="right") - 1
        self.least[full] = self.score[last]


def blocks(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """rows(id, label, vector) -> a row for about `size` of them: ids, labels, dim, and their integers as bytes of so many each."""
    many = rows.count()
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("dim", pa.int32()), ("width", pa.int32()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                ints = integers(part.column("vector"), scale)
                small = ints.astype(np.result_type(np.min_scalar_type(ints.min(initial=-1)), np.min_scalar_type(ints.max(initial=0))))
                row = [part.column("id").to_pylist(), part.column("label").to_pylist(), ints.shape[1], small.itemsize, small.astype(f"i{small.itemsize}").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    dealt = rows.repartition(max(1, -(-many // size)))
    return dealt.mapInArrow(run, "ids array<long>, labels array<long>, dim int, width int, bytes binary")


def matrix(row: dict) -> np.ndarray:
    return np.frombuffer(row["bytes"], f"i{row['width']}").reshape(len(row["ids"]), row["dim"]).astype(np.int64)


def met(anchors: DataFrame, candidates: DataFrame, slices: int) -> DataFrame:
    """Rows of both tables of blocks by (block, slice): each block of anchors, then all blocks of candidates, over `slices` tasks for each block of anchors."""
    many = anchors.agg(F.max("block")).first()[0]
    lacking = [F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in anchors.columns if c not in (*candidates.columns, "block")]
    first = anchors.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(False).alias("asked"))
    every = F.explode(F.sequence(F.lit(0), F.lit(many).cast("int"))).alias("block")
    then = candidates.select("*", *lacking, every, (F.abs(F.xxhash64("ids")) % slices).cast("int").alias("slice"), F.lit(True).alias("asked"))
    return first.unionByName(then).repartition(F.col("block"), F.col("slice")).sortWithinPartitions("block", "slice", "asked")


def positives_of(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Blocks as `met` gives them -> (anchor, k, score, id): for anchor row k of a block its best rows of its label in this task."""
    key, best, ids, labels, a = None, None, None, None, None

    def close() -> pa.RecordBatch:
        slot, score, id_ = (best.slot, best.score, best.id) if best else (np.zeros(0, np.int64),) * 3
        block = np.full(len(slot), key[0] if key else 0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (block, slot, score, id_)], names=["block", "k", "score", "id"])

    for batch in batches:
        for row in batch.to_pylist():
            if not row["asked"]:
                yield close()
                key, ids, labels, a = (row["block"], row["slice"]), np.array(row["ids"]), np.array(row["labels"]), matrix(row)
                best = Best(len(ids), keep)
                continue
            c, c_ids, c_labels = matrix(row), np.array(row["ids"]), np.array(row["labels"])
            for label in np.intersect1d(labels, c_labels):
                every, theirs = np.flatnonzero(labels == label), np.flatnonzero(c_labels == label)
                for k in range(0, len(every), TURN):
                    own = every[k : k + TURN]
                    found = scores(a[own], c[theirs])
                    found[ids[own, None] == c_ids[None, theirs]] = NONE
                    best.offer(own, found, c_ids[theirs])
    yield close()


def negatives_of(batches: Iterator[pa.RecordBatch], keep: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Blocks of anchors with positives (p, score) -> (block, k, positive, score, id): the best rows of other labels within each positive's window."""
    key, best, labels, a, asked = None, None, None, None, None

    def close() -> pa.RecordBatch:
        if best:
            rows = [np.full(len(best.slot), key[0], np.int64), asked[0][best.slot], asked[1][best.slot], best.score, best.id]
        else:
            rows = [np.zeros(0, np.int64)] * 5
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["block", "k", "positive", "score", "id"])

    for batch in batches:
        for row in batch.to_pylist():
            if not row["asked"]:
                yield close()
                key, labels, a = (row["block"], row["slice"]), np.array(row["labels"]), matrix(row)
                wanted = [(k, n, s) for k, found in enumerate(row["positives"]) for n, s in enumerate(found)]
                asked = [np.array(x, np.int64) for x in zip(*wanted, strict=True)] if wanted else [np.zeros(0, np.int64)] * 3
                low = np.array([-(-percent * int(s) // 100) for s in asked[2]], np.int64)  # the least whole score of the window
                turns = [(k, np.flatnonzero((asked[0] // TURN == k) & (asked[1] == n))) for k in range(-(-len(labels) // TURN)) for n in range(int(asked[1].max(initial=-1)) + 1)]
                best = Best(len(asked[0]), keep)
                continue
            c, c_ids, c_labels = matrix(row), np.array(row["ids"]), np.array(row["labels"])
            done, found = -1, None
            for k, at in turns:
                if k != done:
                    mine = slice(k * TURN, (k + 1) * TURN)
                    done, found = k, scores(a[mine], c)
                    found[labels[mine, None] == c_labels[None]] = NONE
                mine = found[asked[0][at] - k * TURN]
                best.offer(at, np.where((mine <= asked[2][at, None]) & (mine >= low[at, None]), mine, NONE), c_ids)
    yield close()


def ranked(found: DataFrame, by: list[str], keep: int) -> DataFrame:
    """The best `keep` of (score, id) in each group, as a sorted list `top`; groups hold `keep` rows for each task at most."""
    each = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id")))
    return found.groupBy(*by).agg(F.slice(each, 1, keep).alias("top"))


def mine_negatives(rows: DataFrame, anchor: Column | str, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = SCALE) -> DataFrame:
    """rows(vec_id, label, embedding) and which of them are anchors -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its `positives` best other rows of its label; the negatives of a positive its `negatives` best
    rows of other labels whose score is `percent` to 100 hundredths of the positive's.
    """
    spark = rows.sparkSession
    vector = F.col("embedding").cast("array<double>")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    asks = (F.expr(anchor) if isinstance(anchor, str) else anchor).alias("asks")
    own = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), vector.alias("vector"), asks)
    own = own.filter("id is not null and label is not null and vector is not null").filter(sound).dropDuplicates(["id", "label", "vector"])
    own = save(own, "vectors")
    slices = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    candidates = save(blocks(own.drop("asks"), CANDIDATES, scale), "candidates")
    numbered = blocks(own.filter("asks").drop("asks"), ANCHORS, scale)
    asked = save(numbered.select(F.monotonically_increasing_id().alias("at"), "*"), "anchors")
    places = {r.at: k for k, r in enumerate(asked.select("at").sort("at").collect())}  # one number for ANCHORS anchors
    if not places:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    by_at = spark.createDataFrame([*places.items()], "at long, block int")
    asked = save(asked.join(by_at, "at").drop("at"), "anchors")
    slices = max(1, -(-slices // len(places)))

    found = met(asked, candidates, slices).mapInArrow(functools.partial(positives_of, keep=positives), "block long, k long, score long, id long")
    top = save(ranked(found, ["block", "k"], positives), "positives")
    listed = top.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("k", F.transform("top", lambda x: -x["less"])))).alias("scores"))
    posed = asked.join(listed, "block", "left").withColumn("positives", F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda k: F.coalesce(F.try_element_at("scores", k.cast("long")), F.array().cast("array<long>")))).drop("scores")
    found = met(posed, candidates, slices).mapInArrow(functools.partial(negatives_of, keep=negatives, percent=percent), "block long, k long, positive long, score long, id long")
    best = ranked(found, ["block", "k", "positive"], negatives)
    names = asked.select("block", F.posexplode("ids").alias("k", "anchor_id"))
    pairs = top.select("block", "k", F.posexplode("top").alias("positive", "it")).select("block", "k", "positive", F.col("it.id").alias("positive_id"), (-F.col("it.less")).alias("positive_score"))
    out = best.join(pairs, ["block", "k", "positive"]).join(names, ["block", "k"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("top").alias("rank", "it"))
    return out.select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("it.id").alias("negative_id"), "positive_score", (-F.col("it.less")).alias("negative_score"))


#: The query in DuckDB: the stated anchors against all rows.
NEGATIVES_SQL = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({SCALE} * x)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM (SELECT * FROM e WHERE vec_id % 100 = 0) a JOIN e b ON a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
