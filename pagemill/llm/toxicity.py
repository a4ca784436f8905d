"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel compares words by their common subsequences of three characters (a word begins with a start mark) that span
at most SPAN places; each place skipped costs a factor DECAY, so `id-iot` or `idi0ot` stay close to `idiot`. Runs of
three or more single characters are read as one more word. A text is compared with a landmark by its closest word; that
row of similarities, and the numbers of very close words, are whitened by the landmarks' own kernel (Nyström) and go to a
linear machine with squared hinge loss. Landmarks are word beginnings that tell toxic learning texts from others, chosen one after another with less
weight on texts that have one already, and some common words of clean texts. A logistic curve, fitted on folds that the
machine did not see, turns margins into scores so that the best cut by F1 lies at 0.7.

Learning takes at most `per_label` documents of each label, chosen by hash of doc_id among labelled rows whose
crc32(doc_id as text) mod 3 is not 1, weighted to the labels' true shares. Null texts are empty texts; without words the
score is that of a text unlike all landmarks. Rows are handled one by one; repeated labels of a doc_id count as often. If
a label is missing, all scores are the share of toxic labels (0 without labels). Empty tables give empty tables.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, held, ragged, slices

DECAY, SPAN = 0.6, 6
PER_LABEL = 1500
STEMS, COMMON = 40, 24
LEAST, MOST = 3, 9  # characters of a landmark
HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"
CUT = 0.7
#: Toxic texts that a landmark must newly tell, as a share times their log odds.
LEAST_GAIN = 0.004
#: Similarities below it count as none.
FAINT = 0.45
CLOSE = 0.9
#: Words near to a landmark that are compared at once.
ROWS = 100_000
#: Log odds beyond which a landmark tells no more.
TELLING = 3.0
CACHE_WORDS = 500_000
#: Longer words are compared by windows of this size, each starting half of one further on.
WINDOW = 24
START = "\1"
EDGES = " \t\n\r\v\f.,;:!?\"'()[]{}<>|«»„“”‚‘’…-–—"


def plain(words: list[str]) -> list[str]:
    """Lower case without punctuation at the edges."""
    return [w.lower().strip(EDGES) for w in words]


def spelled(words: list[str]) -> list[str]:
    """Words made of runs of three or more single characters."""
    out, run = [], []
    for w in [*words, ""]:
        if len(w) == 1:
            run.append(w)
        else:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
    return out


def text_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct plain words, indexes into them, offsets by text; spelled-out words come after the text's own."""
    chunks = Words(texts)
    clean = plain(chunks.unique)
    number = {w: i for i, w in enumerate(dict.fromkeys(clean))}
    index = np.fromiter(map(number.__getitem__, clean), np.int64, len(clean))[chunks.index] if clean else np.zeros(0, np.int64)
    offsets = chunks.offsets
    names = list(number)
    short = np.fromiter((len(w) == 1 for w in names), bool, len(names))[index] if names else np.zeros(0, bool)
    triple = np.flatnonzero(short[:-2] & short[1:-1] & short[2:]) if len(short) > 2 else []
    extra: dict[int, list[int]] = {}
    for k in np.unique(np.searchsorted(offsets, triple, "right") - 1).tolist():
        for w in spelled([names[i] for i in index[offsets[k] : offsets[k + 1]].tolist()]):
            extra.setdefault(k, []).append(number.setdefault(w, len(number)))
    if extra:
        names = list(number)
        parts, ends = [], []
        for k in range(len(offsets) - 1):
            parts += [index[offsets[k] : offsets[k + 1]], np.array(extra.get(k, []), np.int64)]
            ends.append(len(parts[-1]) + len(parts[-2]))
        index, offsets = np.concatenate(parts), np.r_[0, np.cumsum(ends)]
    return names, index, offsets


def triples(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(word, hash of three characters, weight) for all places and gaps, some words at a time; words begin with START."""
    cuts, owner = [], []
    for k, w in enumerate(words):
        w = START + w
        for a in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2) if len(w) > WINDOW else (0,):
            cuts.append(w[a : a + WINDOW])
            owner.append(k)
    own = np.array(owner, np.int64)
    codes = np.frombuffer("".join(c.ljust(WINDOW, "\0") for c in cuts).encode("utf-32-le"), np.uint32).reshape(-1, WINDOW).astype(np.uint64)
    size = np.fromiter(map(len, cuts), np.int64, len(cuts))
    for i in range(1, SPAN - 1):
        for j in range(1, SPAN - i):
            width = int(size.max(initial=0)) - i - j
            if width > 0:
                key = codes[:, :width] | codes[:, i : i + width] << np.uint64(21) | codes[:, i + j : i + j + width] << np.uint64(42)
                here = np.arange(width) < (size - i - j)[:, None]
                yield own[np.nonzero(here)[0]], key[here], DECAY ** (i + j - 2)


class Kernel:
    """Similarities of words to landmarks: 1 for a word that holds all of a landmark's subsequences as closely."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        found = list(triples(landmarks))
        self.keys = np.unique(np.concatenate([k for _, k, _ in found]))
        self.weights = np.zeros((len(self.keys), len(landmarks)), np.float32)
        for own, key, w in found:
            np.add.at(self.weights, (np.searchsorted(self.keys, key), own), w)
        self.norm = (self.weights**2).sum(0)

    def similarities(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for a in range(0, len(words), 4000):
            part = words[a : a + 4000]
            count = np.zeros(len(part) * len(self.keys), np.float32)
            for own, key, w in triples(part):
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                count += np.bincount(own[hit] * len(self.keys) + at[hit], minlength=len(count)).astype(np.float32) * np.float32(w) if hit.any() else 0
            grid = count.reshape(len(part), -1)
            rows = np.flatnonzero(grid.any(1))
            out[a + rows] = grid[rows] @ self.weights
        out /= self.norm
        out[out < FAINT] = 0
        return np.minimum(out, 1, out=out)


def beginnings(names: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Numbers of the first LEAST to MOST characters of each word, offsets by word, and for each number a word and a length."""
    size = np.fromiter((min(MOST, len(w)) for w in names), np.int64, len(names))
    codes = np.frombuffer("".join(w[:MOST].ljust(MOST, "\0") for w in names).encode("utf-32-le"), np.uint32).reshape(-1, MOST)
    value = np.zeros(len(names), np.uint64)
    keys = np.zeros((len(names), MOST - LEAST + 1), np.uint64)
    for k in range(MOST):
        value = (value ^ codes[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(32)
        if k + 1 >= LEAST:
            keys[:, k + 1 - LEAST] = value
    here = np.arange(LEAST, MOST + 1) <= size[:, None]
    word, column = np.nonzero(here)
    _, first, number = np.unique(keys[here], return_index=True, return_inverse=True)
    return number.astype(np.int32), np.r_[0, np.cumsum(here.sum(1))], (word[first], column[first] + LEAST)


def choose_landmarks(names: list[str], index: np.ndarray, offsets: np.ndarray, toxic: np.ndarray) -> list[str]:
    """Word beginnings that tell toxic texts from clean ones, then common words of clean texts."""
    flat, starts, texts = beginnings(names)
    clean_df, of_toxic = np.zeros(len(texts[0]), np.int64), []
    for k in range(len(toxic)):  # one text at a time: only toxic texts' beginnings are kept
        own = np.unique(index[offsets[k] : offsets[k + 1]])
        own = np.unique(ragged(flat, starts, own)[0]) if len(own) else flat[:0]
        if toxic[k]:
            of_toxic.append((k, own))
        else:
            clean_df[own] += 1
    mine = np.concatenate([own for _, own in of_toxic]) if of_toxic else flat[:0]
    own_doc = np.repeat(np.array([k for k, _ in of_toxic], np.int64), [len(own) for _, own in of_toxic])
    clean_n, toxic_n = max(1, (~toxic).sum()), max(1, toxic.sum())
    raw = np.bincount(mine, minlength=len(clean_df))
    odds = np.log((raw / toxic_n + 0.5 / toxic_n) / (clean_df / clean_n + 1 / clean_n))
    telling = np.flatnonzero((raw >= 4) & (odds > 1.2))
    place = np.full(len(raw), -1)
    place[telling] = np.arange(len(telling))
    here = place[mine] >= 0
    mine, own_doc, raw, odds = place[mine[here]], own_doc[here], raw[telling], np.minimum(odds[telling], TELLING)
    said = [names[w][:n] for w, n in zip(texts[0][telling].tolist(), texts[1][telling].tolist(), strict=True)]
    odds = odds * (1 + 0.01 * np.fromiter(map(len, said), np.int64, len(said)))
    weight, chosen, open_ = np.ones(len(toxic)), [], np.ones(len(said), bool)
    while len(chosen) < STEMS and open_.any():
        df = np.bincount(mine, weights=weight[own_doc], minlength=len(said)) / toxic_n
        gain = df * odds * open_
        k = int(gain.argmax())
        if gain[k] < LEAST_GAIN:
            break
        longer = [j for j in np.flatnonzero(open_ & (raw >= 0.9 * raw[k])).tolist() if said[j].startswith(said[k])]
        k = max(longer, key=lambda j: len(said[j]))
        chosen.append(said[k])
        weight[own_doc[mine == k]] *= 0.4
        open_ &= np.fromiter((not (t.startswith(said[k]) or said[k].startswith(t)) for t in said), bool, len(said))
    taken = set(chosen)
    common = Counter(dict(zip(names, np.bincount(index[~np.repeat(toxic, np.diff(offsets))], minlength=len(names)).tolist(), strict=True)))
    return chosen + [w for w, n in common.most_common() if LEAST <= len(w) <= MOST and w not in taken][:COMMON]


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Weights and offset of the machine with squared hinge loss, by Newton steps over the rows inside the margin."""
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(50):
        inside = y * (x @ w) < 1
        if not inside.any():
            break
        xi, ci = x[inside], cost * weight[inside]
        new = np.linalg.solve(ridge + (xi * ci[:, None]).T @ xi, (xi * ci[:, None]).T @ y[inside])
        if np.abs(new - w).max() < 1e-8:
            break
        w = w + 0.7 * (new - w)
    return w


class Model:
    def __init__(self, texts: pa.Array, toxic: np.ndarray, weight: np.ndarray):
        names, index, offsets = text_words(texts)
        self.kernel = Kernel(choose_landmarks(names, index, offsets, toxic) or ["aaa"])
        base = self.kernel.similarities(self.kernel.landmarks)
        value, vector = np.linalg.eigh((base + base.T) / 2 + 1e-3 * np.eye(len(base)))
        self.white = (vector / np.sqrt(np.maximum(value, 1e-2))) @ vector.T
        x = self._whitened(closest(self.kernel.similarities(names), index, offsets))
        y = np.where(toxic, 1.0, -1.0)
        margin = np.zeros(len(y))
        fold = np.arange(len(y)) % 3
        for k in range(3):
            w = train_svm(x[fold != k], y[fold != k], weight[fold != k])
            margin[fold == k] = np.c_[x, np.ones(len(x))][fold == k] @ w
        self.w = train_svm(x, y, weight)
        order = np.argsort(-margin)
        hit, got = np.cumsum((weight * toxic)[order]), np.cumsum(weight[order])
        f1 = 2 * hit / (got + (weight * toxic).sum())
        k = int(f1.argmax())
        below = margin[order[min(k + 1, len(order) - 1)]]
        self.cut = float((margin[order[k]] + below) / 2)
        self.slope = 3.0

    def _whitened(self, near: np.ndarray) -> np.ndarray:
        k = len(self.white)
        return np.c_[near[:, :k] @ self.white, near[:, k:] @ self.white]

    def scores(self, near: np.ndarray) -> np.ndarray:
        margin = self._whitened(near) @ self.w[:-1] + self.w[-1]
        z = self.slope * (margin - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def closest(similarity: np.ndarray, index: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text and landmark the largest similarity of its words, then the log of the number of very close ones."""
    width = similarity.shape[1]
    out = np.zeros((len(offsets) - 1, 2 * width), np.float32)
    some = similarity.any(1)[index] if len(index) else np.zeros(0, bool)
    ends = np.r_[0, np.cumsum(some)][offsets]
    rows = index[some]
    edges = np.searchsorted(ends, np.arange(0, len(rows) + ROWS, ROWS)).clip(max=len(out))
    for lo, hi in zip(edges, np.r_[edges[1:], len(out)]):  # some texts at a time
        size = np.diff(ends[lo : hi + 1])
        docs = lo + np.flatnonzero(size)
        if len(docs):
            near = similarity[rows[ends[lo] : ends[hi]]]
            first = ends[docs] - ends[lo]
            out[docs, :width] = np.maximum.reduceat(near, first, axis=0)
            out[docs, width:] = np.log1p(np.add.reduceat((near > CLOSE).astype(np.float32), first, axis=0))
    return out


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | float:
    """A model, or the share of toxic labels where one label is missing."""
    known = labels.filter(f"not ({HELD_OUT}) and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), False))
    slots = 1 << 30
    share = F.when(F.col("toxic"), min(slots, slots * per_label // counts[True])).otherwise(min(slots, slots * per_label // counts[False]))
    # at most about two times per_label rows go out, whatever the size of the tables
    chosen = F.broadcast(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < share))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").toArrow().combine_chunks().sort_by("doc_id")
    toxic = np.array(rows["toxic"].to_pylist(), bool)
    if not toxic.any() or toxic.all():
        return counts[True] / (counts[True] + counts[False])
    weight = np.where(toxic, counts[True] / toxic.sum(), counts[False] / (~toxic).sum())
    return Model(rows["text"].combine_chunks(), toxic, weight / weight.mean())


class Judge:
    """A model with a bounded table of words seen by this worker; row 0: no landmark near."""

    def __init__(self, model: Model):
        self.model = model
        self._empty()

    def _empty(self) -> None:
        self.row: dict[str, int] = {}
        self.near, self.used = np.zeros((1024, len(self.model.kernel.landmarks)), np.float32), 1

    def scores(self, texts: pa.Array) -> np.ndarray:
        if len(self.row) > CACHE_WORDS:
            self._empty()
        names, index, offsets = text_words(texts)
        new = [w for w in names if w not in self.row]
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            found = self.model.kernel.similarities(part)
            some = found.any(1)
            n = int(some.sum())
            while self.used + n > len(self.near):
                self.near = np.concatenate([self.near, np.zeros_like(self.near)])
            self.near[self.used : self.used + n] = found[some]
            self.row.update(zip(part, np.where(some, self.used + np.cumsum(some) - 1, 0).tolist(), strict=True))
            self.used += n
        rows = np.fromiter(map(self.row.__getitem__, names), np.int64, len(names))
        return self.model.scores(closest(self.near[: self.used], rows[index] if len(index) else index, offsets))


def _scorer(spark, model: Model | float):
    """What a worker calls to score texts; the model goes out once as a broadcast of bounded size."""
    if isinstance(model, float):
        return lambda texts: np.full(len(texts), model)
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    return lambda texts: held(key, lambda: Judge(sent.value)).scores(texts)


def score_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> doc_id, held_out, score, predicted."""
    scores = _scorer(docs.sparkSession, fit(docs, labels, per_label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=6_000_000):
                score = scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_civil(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns as they are."""
    scores = _scorer(docs.sparkSession, fit(docs, labels, per_label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=6_000_000):
                yield part.filter(pa.array(scores(part.column("text")) < CUT))

    return docs.mapInArrow(run, docs.schema)
