"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of order ORDER over lower-cased words (runs of letters between a start and an end mark). Below
the highest order, counts are continuation counts; each order gives D of every count to the order below. All languages
share one sorted array of n-gram hashes per order, with a column of values for each language, so that one binary search
serves them all. A text's cross-entropy is the mean over all its characters; the lowest wins. A text without a letter is
rejected, and one whose lowest cross-entropy lies nearer to that of texts in languages left out of the comparison than to
that of fitting texts (`limits`).

Learning takes at most `per_language` documents and about `sample_chars` characters of each of the `most_languages` commonest
languages, chosen by hash of doc_id among rows with doc_id, text and lang whose crc32(doc_id as text) mod 4 is not 2; a fifth of them sets thresholds and the score's temperature.
Null or letterless texts: `und`, score 0, rejected. Without any row to learn from, all texts are `und`. Ties go to the
language first in order. Rows are handled one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, held, slices

ORDER = 4
PER_LANGUAGE = 600
HELD_OUT = "crc32(cast(doc_id as string)) % 4 = 2"
CACHE_WORDS = 400_000
LETTERS = regex.compile(r"\p{L}+|\n")
#: Languages that are learned at most, the commonest first; the label column may be dirty.
MOST_LANGUAGES = 500
#: Characters that are learned of each language at most, in whole documents.
SAMPLE_CHARS = 8_000_000
#: A text is rejected this share of the way from this quantile of fitting texts' cross-entropy to that of texts of left-out languages.
WAY, REJECT_QUANTILE, STRANGE_QUANTILE = 0.85, 0.9995, 0.02
#: Where no other language is known, or they don't part: nats above the fitting texts' quantile.
REJECT_MARGIN = 0.5
BASE = np.uint64(0x9E3779B97F4A7C15)
START, STOP = 1, 2
LONGEST = 64


def letter_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, indexes into them, and offsets by text."""
    chunks = Words(texts)
    found = [*LETTERS.findall("\n".join(chunks.unique).lower()), "\n"] if chunks.unique else []
    number = {w: i for i, w in enumerate(dict.fromkeys(found))}
    flat = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
    mark = number.pop("\n", -1)
    ends = np.flatnonzero(flat == mark)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    size = (ends - starts)[chunks.index]
    out = np.r_[0, np.cumsum(size)]
    index = flat[np.repeat(starts[chunks.index] - out[:-1], size) + np.arange(out[-1])] if len(size) else flat[:0]
    names = list(number)
    if mark >= 0:  # numbers after the mark's move down by one
        index = index - (index > mark)
    return names, index, out[chunks.offsets]


def grams(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Words of like length at a time: their numbers, the word of each character, and for each order the hashes of the n-grams, of their contexts and of their suffixes."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for low, top in ((0, 8), (8, 16), (16, LONGEST), (LONGEST, 1 << 40)):
        rows = np.flatnonzero((size > low) & (size <= top))
        step = 20_000 if top <= LONGEST else 1
        for part in (rows[k : k + step] for k in range(0, len(rows), step)):
            width = int(size[part].max())
            codes = np.frombuffer("".join(words[k].ljust(width, "\0") for k in part.tolist()).encode("utf-32-le"), np.uint32).reshape(len(part), width).astype(np.uint64) + np.uint64(8)
            codes = np.concatenate([np.full((len(part), ORDER - 1), START, np.uint64), codes, np.zeros((len(part), 1), np.uint64)], axis=1)
            own = size[part]
            codes[np.arange(len(part)), ORDER - 1 + own] = STOP
            here = np.arange(width + 1) <= own[:, None]
            where = np.nonzero(here)[0]
            char = codes[:, ORDER - 1 :]
            gram, orders = (char * BASE)[here], []
            context = suffix = np.zeros(len(gram), np.uint64)
            for n in range(1, ORDER + 1):
                if n > 1:  # one character more on the left
                    left = codes[:, ORDER - n : ORDER - n + width + 1][here]
                    context = (context * np.uint64(31)) ^ ((left + np.uint64(n)) * BASE ^ (left >> np.uint64(3)))
                    suffix, gram = gram, (context ^ (context >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + char[here] * BASE
                orders.append((gram, context, suffix))
            yield part, where, orders


class Model:
    """values[n]: for each n-gram of order n + 1 the discounted share by language; backs[n]: the weight given down by each context."""

    def __init__(self, languages: list[str], counts: list[tuple[list[str], np.ndarray]]):
        self.languages, n_lang = languages, len(languages)
        own: list[list[tuple]] = [[] for _ in range(ORDER)]
        for k, (words, count) in enumerate(counts):
            parts: list[list] = [[] for _ in range(ORDER)]
            for part, where, orders in grams(words):
                for n, (g, c, s) in enumerate(orders):
                    parts[n].append((g, c, s, count[part][where]))
            tables = []
            for n in range(ORDER):
                g, c, s, w = (np.concatenate([p[i] for p in parts[n]]) if parts[n] else np.zeros(0, np.uint64) for i in range(4))
                keys, first, back = np.unique(g, return_index=True, return_inverse=True)
                tables.append((keys, c[first], s[first], np.bincount(back, weights=w, minlength=len(keys))))
            for n in range(ORDER):
                keys, context, _, count_n = tables[n]
                if n + 1 < ORDER:  # how many characters it follows
                    longer = tables[n + 1][2]
                    spread = np.searchsorted(keys, longer)
                    count_n = np.maximum(1, np.bincount(spread, minlength=len(keys))).astype(float)
                ones, twos = (count_n == 1).sum(), (count_n == 2).sum()
                discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
                ctx, back = np.unique(context, return_inverse=True)
                total = np.bincount(back, weights=count_n, minlength=len(ctx))
                kinds = np.bincount(back, minlength=len(ctx))
                own[n].append((k, keys, (count_n - discount) / total[back], ctx, discount * kinds / total))
        self.keys, self.values, self.contexts, self.backs = [], [], [], []
        for n in range(ORDER):
            keys = np.unique(np.concatenate([o[1] for o in own[n]]))
            ctx = np.unique(np.concatenate([o[3] for o in own[n]]))
            value, back = np.zeros((len(keys) + 1, n_lang), np.float32), np.ones((len(ctx) + 1, n_lang), np.float32)
            for k, own_keys, share, own_ctx, weight in own[n]:
                value[np.searchsorted(keys, own_keys), k] = share
                back[np.searchsorted(ctx, own_ctx), k] = weight
            self.keys.append(keys), self.values.append(value), self.contexts.append(ctx), self.backs.append(back)
        self.floor = 1 / 5000  # an even share of characters at the bottom
        self.limits, self.temperature = np.full(n_lang, np.inf), 1.0

    def word_scores(self, words: list[str]) -> np.ndarray:
        """The sum of log probabilities of each word by language."""
        out = np.zeros((len(words), len(self.languages)))
        for part, where, orders in grams(words):
            p = np.full((len(where), len(self.languages)), self.floor, np.float32)
            for n, (g, c, _) in enumerate(orders):
                at = np.minimum(np.searchsorted(self.keys[n], g), len(self.keys[n]) - 1)
                at = np.where(self.keys[n][at] == g, at, len(self.keys[n]))
                ctx = np.minimum(np.searchsorted(self.contexts[n], c), len(self.contexts[n]) - 1)
                ctx = np.where(self.contexts[n][ctx] == c, ctx, len(self.contexts[n]))
                p = self.values[n][at] + self.backs[n][ctx] * p
            first = np.flatnonzero(np.r_[True, where[1:] != where[:-1]])
            out[part] = np.add.reduceat(np.log(p), first, axis=0)
        return out

    def entropies(self, index: np.ndarray, offsets: np.ndarray, score: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Cross-entropy of each text by language, in nats a character; inf for a text without words."""
        sums = np.r_[np.zeros((1, score.shape[1])), np.cumsum(score[index], axis=0)] if len(index) else np.zeros((1, score.shape[1]))
        chars = np.r_[0, np.cumsum(size[index] + 1)]
        total = (chars[offsets[1:]] - chars[offsets[:-1]])[:, None]
        return np.where(total > 0, -(sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(total, 1), np.inf)


def limits(ce: np.ndarray, truth: np.ndarray, n_lang: int) -> np.ndarray:
    """The cross-entropy beyond which a text given to each language is rejected.

    Texts of each language are judged by the others' models, as those of a language that no one taught. The limit lies
    WAY of the way from what fitting texts reach at most to what such strangers reach at least.
    """
    out = np.full(n_lang, np.inf)
    without = ce.copy()
    without[np.arange(len(ce)), truth] = np.inf
    taken, strange = without.argmin(1), without.min(1)
    for k in range(n_lang):
        own, other = ce[truth == k, k], strange[(taken == k) & (truth != k) & np.isfinite(strange)]
        if not len(own):
            continue
        fit_most = np.quantile(own, REJECT_QUANTILE)
        strange_least = np.quantile(other, STRANGE_QUANTILE) if len(other) else fit_most
        out[k] = max(fit_most + WAY * (strange_least - fit_most), fit_most + (0 if strange_least > fit_most else REJECT_MARGIN))
    return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, most_languages: int = MOST_LANGUAGES, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    rows = docs.filter(f"not ({HELD_OUT}) and text is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not counts:
        return None
    slots = 1 << 30
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(slots, slots * per_language // n))]), F.col("lang"))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
    # at most about per_language rows of each language; of these, in order of chance, whole texts up to the bound
    sofar = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("__c", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    sample = rows.withColumn("__c", chance).filter(F.col("__c") < share).withColumn("__s", F.coalesce(sofar, F.lit(0))).filter(F.col("__s") < sample_chars)
    chosen = sample.drop("__c", "__s").toArrow().combine_chunks().sort_by("doc_id")
    languages = sorted(counts)
    lang = np.array(chosen["lang"].to_pylist(), dtype=object)
    words, index, offsets = letter_words(chosen["text"].combine_chunks())
    doc = np.repeat(np.arange(len(lang)), np.diff(offsets))
    apart = np.arange(len(lang)) % 5 == 4
    tables = []
    for name in languages:
        count = np.bincount(index[((lang == name) & ~apart)[doc]], minlength=len(words))
        if not count.any():
            count = np.bincount(index[(lang == name)[doc]], minlength=len(words))
        seen = np.flatnonzero(count)
        tables.append(([words[k] for k in seen.tolist()], count[seen]))
    if not any(len(t[0]) for t in tables):
        return None
    model = Model(languages, tables)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ce = model.entropies(index, offsets, model.word_scores(words), size)
    truth = np.array([languages.index(x) for x in lang])
    fine = np.isfinite(ce).all(1) & (apart if apart.any() else True)
    model.limits = limits(ce[fine], truth[fine], len(languages))
    best = np.inf
    for t in np.geomspace(0.5, 200, 25):  # the temperature under which held documents are likeliest
        z = -t * (ce[fine] - ce[fine].min(1, keepdims=True))
        loss = (np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth[fine]]).mean() if fine.any() else 0
        if loss < best:
            best, model.temperature = loss, float(t)
    return model


class Judge:
    """A model with a bounded table of words seen by this worker."""

    def __init__(self, model: Model):
        self.model = model
        self._empty()

    def _empty(self) -> None:
        self.row: dict[str, int] = {}
        self.score = np.zeros((1 << 16, len(self.model.languages)), np.float32)

    def judge(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of the language (-1: none), the score and whether it is rejected."""
        if len(self.row) > CACHE_WORDS:
            self._empty()
        words, index, offsets = letter_words(texts)
        new = [w for w in words if w not in self.row]
        if new:
            base = len(self.row)
            while base + len(new) > len(self.score):
                self.score = np.concatenate([self.score, np.zeros_like(self.score)])
            self.score[base : base + len(new)] = self.model.word_scores(new)
            self.row.update(zip(new, range(base, base + len(new)), strict=True))
        rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        ce = self.model.entropies(index, offsets, self.score[rows].astype(np.float64), size)
        none = ~np.isfinite(ce).all(1)
        ce[none] = 0
        best = ce.argmin(1)
        z = np.exp(-self.model.temperature * (ce - ce.min(1, keepdims=True)))
        score = np.where(none, 0.0, z.max(1) / z.sum(1))
        return np.where(none, -1, best), score, none | (ce[np.arange(len(ce)), best] > self.model.limits[best])


def _judges(spark, model: Model | None):
    """What a worker calls to judge texts: the model goes out once as a broadcast of bounded size."""
    if model is None:
        return None, ["und"]
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    return (lambda: held(key, lambda: Judge(sent.value))), model.languages


def predict_language(docs: DataFrame, per_language: int = PER_LANGUAGE, model: Model | None = None) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, held_out, lang_pred, score, rejected."""
    model = model or fit(docs, per_language)
    judge, languages = _judges(docs.sparkSession, model)
    names = pa.array([*languages, "und"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=6_000_000):
                n = part.num_rows
                which, score, rejected = judge().judge(part.column("text")) if judge else (np.full(n, -1), np.zeros(n), np.ones(n, bool))
                pred = names.take(pa.array(np.where(which < 0, len(names) - 1, which)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pred, pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of docs whose language is not rejected, all columns as they are."""
    judge, _ = _judges(docs.sparkSession, fit(docs, per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=6_000_000):
                yield part.filter(pa.array(~judge().judge(part.column("text"))[2] if judge else np.zeros(part.num_rows, bool)))

    return docs.mapInArrow(run, docs.schema)
