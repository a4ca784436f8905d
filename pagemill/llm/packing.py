"""Best-fit packing into sequences of a fixed length, certified by lower bounds.

Documents become ids plus an end id; only those longer than a sequence are cut, into whole sequences with a shorter
first piece. A piece of full length is a sequence of its own and needs no packing. The others are dealt to groups of a
bounded size. Each group packs by best-fit decreasing and takes a lower bound on its sequences from dual feasible
functions. A group whose count meets its bound is certified; it gives away only its emptiest sequence, which rounding left.
A group with a gap gives away all pieces of its sequences with room. What is given away goes to fewer groups and is packed
again, until one group packs the rest or PATIENCE further rounds in a row each need no fewer sequences than they were given; such a
round is undone.
Each row carries its group's certificate: round, group, the group's sequences and their lower bound.

Null texts are empty texts: one piece with the end id alone. Repeated rows are pieces of their own. Other columns are not
read. An empty table gives an empty table. Rows without doc_id are packed like others.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CACHE_WORDS, encoder, vocabulary
from .common import SLICE_CHARS, doc_text, held, save, slices

CAPACITY = 1024
#: Pieces that a task packs at once.
GROUP_PIECES = 100_000
#: Ids that a task holds at once where pieces carry them.
GROUP_IDS = 4_000_000
#: The round that pieces of full length are said to be packed in; its groups are not numbered.
WHOLE = 127
#: Rounds in a row without gain, each dealt otherwise, after which packing ends.
PATIENCE = 3


def pieces_of(docs: DataFrame, name: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY, keep: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, and ids with keep."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary(name))
        enc.most_words = CACHE_WORDS // 2 if keep else CACHE_WORDS  # ids that go out need memory of their own
        for batch in batches:
            for part in slices(batch, limit=2_000_000 if keep else SLICE_CHARS):
                ids, offsets = enc.encode(part.column("text"))
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                starts = offsets + np.arange(len(offsets))  # each document has its end id now
                size = np.diff(starts)
                pieces = -(-size // capacity)
                doc = np.repeat(np.arange(len(size)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = np.where(size % capacity, size % capacity, capacity)[doc]  # the first piece may be shorter
                begin = np.where(piece > 0, first + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first)
                at = starts[doc] + begin
                crc = [zlib.crc32(ids[x:y]) for x, y in zip(at.tolist(), (at + length).tolist())]
                cols = [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(begin), pa.array(length), pa.array(crc, pa.int64())]
                if keep:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return doc_text(docs).mapInArrow(run, schema)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest of the bounds by dual feasible functions, over the histogram of lengths.

    With threshold t, lengths above capacity - t count as a whole sequence and those below t as nothing; with k, a length
    is rounded down to multiples of capacity / k except where (k + 1) lengths of its kind fill sequences exactly.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    above = np.cumsum(count[::-1])[::-1]
    total = np.cumsum(count * size)
    for t in range(1, capacity // 2 + 1):
        whole = int(above[capacity - t + 1])
        part = int(total[capacity - t] - total[t - 1])
        best = max(best, whole + -(-part // capacity))
    for k in range(1, 101):
        exact = (k + 1) * size % capacity == 0
        worth = np.where(exact, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((count * worth).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The sequence of each piece; lengths in decreasing order."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: a sequence with room r
    out, bins = np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        fits = free >> n
        if fits:
            r = n + ((fits & -fits).bit_length() - 1)
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            r, b, bins = capacity, bins, bins + 1
        out[i] = b
        left = r - n
        if left:
            room[left].append(b)
            free |= 1 << left
    return out


def pack_group(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """The sequence of each piece (lengths decreasing), which pieces are given away, and the lower bound."""
    seq = best_fit_decreasing(lengths, capacity)
    filled = np.bincount(seq, weights=lengths).astype(np.int64)
    bound = lower_bound(lengths, capacity)
    if len(filled) > bound:
        give = filled < capacity
    else:
        give = np.zeros(len(filled), bool)
        if len(filled) and filled.min() < capacity:
            give[filled.argmin()] = True
    return seq, give[seq], bound


CERTIFICATE = "sequence_id long, offset long, round int, group_id int, group_sequences long, group_bound long"


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """A table with `length` (1 to capacity) -> its rows with sequence_id, offset and the certificate, in as few sequences as found."""
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]
    schema = f"{', '.join(own)}, {CERTIFICATE}, given boolean"

    def run_round(frame: DataFrame, number: int, groups: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = [b for b in batches if b.num_rows]
            if not kept:
                return
            held("packing", lambda: None)  # a worker that encoded before needs its tables no more
            table = pa.Table.from_batches(kept).drop_columns(["group"])
            del kept
            part = TaskContext.get().partitionId()
            keys = [("length", "descending")] + [(c, "ascending") for c in ("doc_id", "piece") if c in table.column_names]
            order = np.asarray(pc.sort_indices(table, keys))
            lengths = np.asarray(table["length"])[order]
            seq, give, bound = pack_group(lengths, capacity)
            by_seq = np.argsort(seq, kind="stable")
            order, lengths, seq, give = order[by_seq], lengths[by_seq], seq[by_seq], give[by_seq]
            ends = np.cumsum(lengths)
            first = np.r_[True, seq[1:] != seq[:-1]]
            offset = ends - lengths
            offset -= np.maximum.accumulate(np.where(first, offset, 0))
            base, count = (number << 56) + (part << 28), int(seq[-1]) + 1
            for a in range(0, len(seq), 10_000):
                at = slice(a, a + 10_000)
                rows = table.take(pa.array(order[at])).combine_chunks()
                n = rows.num_rows
                more = [base + seq[at], offset[at], np.full(n, number, np.int32), np.full(n, part, np.int32), np.full(n, count), np.full(n, bound), give[at]]
                cols = [c.chunk(0) for c in rows.columns] + [pa.array(x) for x in more]
                yield pa.RecordBatch.from_arrays(cols, names=[*rows.column_names, *(c.split()[0] for c in CERTIFICATE.split(", ")), "given"])

        grouped = frame.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(number)), F.lit(groups)).cast("int"))
        return save(grouped.repartitionById(groups, "group").mapInArrow(run, schema), "packed")

    whole = F.col("length") == capacity
    names = [*pieces.columns, *(c.split()[0] for c in CERTIFICATE.split(", "))]
    alone = {"sequence_id": F.lit(WHOLE << 56) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "round": F.lit(WHOLE), "group_id": F.lit(-1), "group_sequences": F.lit(1).cast("long"), "group_bound": F.lit(1).cast("long")}
    done = [pieces.filter(whole).withColumns(alone).select(*names)]
    rest, number, before, fallback, missed = pieces.filter(~whole), 0, None, None, 0
    while True:
        left, ids = rest.agg(F.count("*"), F.sum("length")).first()
        by_ids = -(-int(ids or 0) // GROUP_IDS) if "ids" in pieces.columns else 1
        groups = max(1, by_ids, -(-left // GROUP_PIECES))
        packed = run_round(rest, number, groups)
        used, given = packed.agg(F.expr("count_if(offset = 0)"), F.expr("count_if(offset = 0 and given)")).first()
        if before is not None and used >= before:  # nothing gained: as it was, and dealt otherwise
            missed, number = missed + 1, number + 1
            if missed > PATIENCE:
                return functools.reduce(DataFrame.unionByName, [*done, fallback])
            continue
        if groups == 1 or not given:
            return functools.reduce(DataFrame.unionByName, [*done, packed.select(*names)])
        done.append(packed.filter("not given").select(*names))
        gone = packed.filter("given")
        rest, before, fallback, number, missed = gone.select(*pieces.columns), given, gone.select(*names), number + 1, 0


def pack_documents(docs: DataFrame, name: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY, keep: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, piece, start, length, ids_crc32, sequence_id, offset, the certificate, and ids with keep."""
    return pack(save(pieces_of(docs, name, end_id, capacity, keep), "pieces"), capacity)
