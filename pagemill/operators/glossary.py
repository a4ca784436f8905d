"""Glossary entries, their spellings, and which of them a text uses.

Entries: source, english, variants (array), type, reading and further columns. A spelling is found by an equality join of
grams. Of the grams of up to ANCHOR characters that a spelling holds, its anchor is the one that the fewest texts have, so
that names which begin alike with common letters don't meet every text. Texts give only grams that are someone's anchor.
So the work is the text's length and the true candidates, not texts times terms.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.scalars import normal_pronoun
from ..functions.text import KANJI, strip
from .ranks import numbered, settled

ANCHOR = 4
#: One text of this many says how common grams are.
SAMPLED = 16
#: Anchors (of at most ANCHOR characters each) that may go out to all tasks.
SENT_OUT = 500_000
#: Odd numbers without a pattern, one for each place in a gram.
_FACTORS = np.random.default_rng(42).integers(0, 2**63, ANCHOR, np.uint64) * np.uint64(2) + np.uint64(1)


def spellings(entries: DataFrame, key: list[str]) -> DataFrame:
    """Source, variants and reading of each entry in that order, stripped, blanks and repeats dropped: key, rank, spelling."""
    every = F.concat(F.array("source"), F.coalesce("variants", F.array().cast("array<string>")), F.array("reading"))
    clean = F.array_distinct(F.filter(F.transform(every, lambda s: strip(F.coalesce(s, F.lit("")))), lambda s: s != ""))
    return entries.select(*key, F.posexplode(clean).alias("rank", "spelling"))


def grams(c: Column, n: int) -> Column:
    """All runs of n characters of a text, in order, in one pass over it: a look ahead at every place."""
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def anchors(texts: DataFrame, names: DataFrame, text: str) -> DataFrame:
    """names(spelling) with gram: of its grams of min(ANCHOR, length) characters the one in the fewest of a share of the texts, the first of equals."""
    own = names.select("spelling").distinct().filter("spelling <> ''")
    size = F.least(F.length("spelling"), F.lit(ANCHOR))
    every = F.when(size < ANCHOR, F.array("spelling")).otherwise(grams(F.col("spelling"), ANCHOR))
    held = own.select("spelling", F.posexplode(every).alias("at", "gram"))
    # how common a gram is only decides the plan, so a sample of texts will do
    sample = texts.filter(F.pmod(F.xxhash64(text), F.lit(SAMPLED)) == 0).select(F.explode(F.array_distinct(grams(F.col(text), ANCHOR))).alias("gram"))
    common = sample.join(held.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("texts"))
    ranked = held.join(common, "gram", "left").groupBy("spelling").agg(F.min_by("gram", F.struct(F.coalesce("texts", F.lit(0)), "at")).alias("gram"))
    return names.join(ranked, "spelling")


def gram_codes(text: str, n: int) -> np.ndarray:
    """A number for each run of n characters of a text, in order; different runs may share one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    last = max(0, len(points) - n + 1)
    return sum((points[k : k + last] * _FACTORS[k] for k in range(n)), np.zeros(last, np.uint64))


def held_grams(texts: DataFrame, known: DataFrame, text: str) -> Column:
    """The different grams of a text that may be among known(gram), of SENT_OUT rows at most: all that are, and those that share a number with one."""
    codes: dict[int, list[np.ndarray]] = {}
    for row in known.collect():
        codes.setdefault(len(row.gram), []).append(gram_codes(row.gram, len(row.gram)))
    wanted = texts.sparkSession.sparkContext.broadcast({n: np.unique(np.concatenate(c)) for n, c in codes.items()})

    def of(t: str | None) -> list[str]:
        found = set()
        for n, among in wanted.value.items() if t else ():
            every = gram_codes(t, n)
            at = np.minimum(np.searchsorted(among, every), len(among) - 1)
            found.update(t[k : k + n] for k in np.flatnonzero(among[at] == every).tolist())
        return sorted(found)

    @F.pandas_udf(ArrayType(StringType()))
    def held(column: pd.Series) -> pd.Series:
        return column.map(of)

    return held(F.col(text))


def candidates(chapters: DataFrame, names: DataFrame, *, key: list[str], text: str = "text", entry: list[str]) -> DataFrame:
    """chapters x names whose anchor occurs in the text: key, entry columns, spelling. All spellings that a text holds are among its candidates."""
    # a row for each spelling, asked for several times
    anchored = settled(anchors(chapters.select(text).filter(F.col(text).isNotNull()), names, text).select(*dict.fromkeys([*entry, "spelling", "gram"])))
    known = anchored.select("gram").distinct()
    if known.count() <= SENT_OUT:  # a proven bound; beyond it grams are dealt by hash
        held = chapters.select(*key, F.explode(held_grams(chapters, known, text)).alias("gram"))
    else:
        lengths = F.array_distinct(F.concat(*[grams(F.col(text), n) for n in range(1, ANCHOR + 1)]))
        held = chapters.select(*key, F.explode(lengths).alias("gram")).join(known, "gram", "left_semi")
    return held.join(anchored, "gram").select(*key, *dict.fromkeys([*entry, "spelling"]))


def relevant(chapters: DataFrame, names: DataFrame, *, key: list[str], text: str = "text", entry: list[str], boundary: str | None = KANJI) -> DataFrame:
    """chapters x entries whose spelling occurs in the text; one character alone only away from the boundary class (None: anywhere).

    names: entry columns and spelling.
    """
    held = candidates(chapters, names, key=key, text=text, entry=entry).join(chapters.select(*key, F.col(text).alias("__text")), key)
    alone = F.lit(True) if boundary is None else F.regexp_like("__text", F.concat(F.lit(f"(?<![{boundary}])\\Q"), F.col("spelling"), F.lit(f"\\E(?![{boundary}])")))
    fits = F.when(F.length("spelling") == 1, alone & F.contains("__text", "spelling")).otherwise(F.contains("__text", "spelling"))
    return held.filter(fits).select(*key, *entry).distinct()


def listing(entry: str = "") -> list[Column]:
    """The order of entries: type, then English or else source, in code-point order."""
    return [F.col(f"{entry}type"), F.coalesce(F.nullif(F.col(f"{entry}english"), F.lit("")), F.col(f"{entry}source"))]


def ordered(entries: DataFrame, *, ties: list[str], by: list[str] | None = None) -> DataFrame:
    """All entries with their place in the listing (of each group `by`), ties by these columns (L1)."""
    return numbered(entries, by=by or [], order=[*listing(), *map(F.col, ties)])


def canonical(entries: DataFrame, *, ties: list[str]) -> DataFrame:
    """Entries that have an English name but no source, by type and English, with their place (L1)."""
    return numbered(entries.filter("source = '' and english <> ''"), by=[], order=[F.col("type"), F.col("english"), *map(F.col, ties)])


def admit(proposed: DataFrame, pending: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Proposed terms -> (queued, variants, rejected).

    Terms without source, already pending or known by any spelling are rejected. One whose English is an entry's becomes a
    variant of the first such entry in order; of the rest the first proposal of each source is queued.
    """
    rows = proposed.withColumn("source", strip(F.coalesce("source", F.lit(""))))
    known = spellings(entries, ["source"]).select(F.col("spelling").alias("source")).union(pending.select("source")).distinct()
    fresh = rows.filter("source <> ''").join(known, "source", "left_anti")
    place = Window.partitionBy(F.lower("english")).orderBy("type", F.coalesce(F.nullif("english", F.lit("")), F.col("source")))
    english = entries.filter("english <> ''").withColumn("__n", F.row_number().over(place)).filter("__n = 1").select(F.lower("english").alias("__english"), F.coalesce(F.nullif("source", F.lit("")), F.col("english")).alias("of"))
    matched = fresh.withColumn("__english", F.lower("english")).join(english, "__english", "left")
    first = Window.partitionBy("source").orderBy("seq")
    variants = matched.filter("of is not null").withColumn("__n", F.row_number().over(first)).filter("__n = 1").select("of", "source")
    new = matched.filter("of is null").withColumn("__n", F.row_number().over(first))
    queued = new.filter("__n = 1").withColumn("pronoun", normal_pronoun(F.col("pronoun"))).drop("__n", "__english", "of")
    rejected = rows.join(fresh.select("seq"), "seq", "left_anti").unionByName(new.filter("__n > 1").select(*rows.columns))
    return queued, variants, rejected


def upsert(entries: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming entries replace those of their source, and placeholders (English without source) of their English; an incoming placeholder gives way to any entry of its English."""
    mapped, empty = incoming.filter("source <> ''"), incoming.filter("source = ''")
    english = mapped.select(F.lower("english").alias("__e")).distinct()
    kept = entries.join(mapped.select("source"), "source", "left_anti")
    kept = kept.withColumn("__e", F.when(F.col("source") == "", F.lower("english"))).join(english, "__e", "left_anti").drop("__e")
    now = kept.unionByName(mapped.select(*entries.columns))
    taken = now.select(F.lower("english").alias("__e")).distinct()
    return now.unionByName(empty.select(*entries.columns).withColumn("__e", F.lower("english")).join(taken, "__e", "left_anti").drop("__e"))


def decide(entries: DataFrame, pending: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """decisions(source, action): approve moves a pending term in, reject drops it, remove drops an entry -> (entries, pending)."""
    approved = pending.join(decisions.filter("action = 'approve'").select("source"), "source", "left_semi")
    left = pending.join(decisions.filter("action in ('approve', 'reject')").select("source"), "source", "left_anti")
    kept = entries.join(decisions.filter("action = 'remove'").select("source"), "source", "left_anti")
    return upsert(kept, approved.select(*entries.columns)), left


def add_variants(entries: DataFrame, variants: DataFrame) -> DataFrame:
    """variants(of, source): further spellings of the entries named by source, or by English where they have none; each spelling once, none that the entry has already."""
    new = variants.select(F.col("of").alias("__of"), strip(F.col("source")).alias("__v")).filter("__v <> ''").groupBy("__of").agg(F.sort_array(F.collect_set("__v")).alias("__new"))
    joined = entries.join(new, F.coalesce(F.nullif("source", F.lit("")), F.col("english")) == F.col("__of"), "left")
    has = F.array_union(F.array("source", F.coalesce("reading", F.lit(""))), F.coalesce("variants", F.array().cast("array<string>")))
    added = F.array_except(F.coalesce("__new", F.array().cast("array<string>")), F.transform(has, lambda s: strip(s)))
    return joined.withColumn("variants", F.concat(F.coalesce("variants", F.array().cast("array<string>")), added)).drop("__of", "__new")


def report(entries: DataFrame, *, ties: list[str]) -> DataFrame:
    """The listing as lines: section (the type), place, line with English, all spellings, hints and note; place 0 is the section's heading.

    One row for each line, so that no section has to fit into one task; written in order of section and place it is the report.
    """
    some = lambda c: F.nullif(F.coalesce(F.col(c) if c in entries.columns else F.lit(None).cast("string"), F.lit("")), F.lit(""))
    every = F.concat(F.array("source"), F.coalesce("variants", F.array().cast("array<string>")), F.array("reading"))
    spelled = F.array_join(F.array_distinct(F.filter(F.transform(every, lambda s: strip(F.coalesce(s, F.lit("")))), lambda s: s != "")), " / ")
    hints = F.array_join(F.array_compact(F.array(some("pronoun"), F.concat(F.lit("says "), some("first_person")), some("register"))), ", ")
    line = F.concat(
        F.lit("- **"), F.coalesce(some("english"), F.lit("?")), F.lit("** — "), F.coalesce(F.nullif(spelled, F.lit("")), F.lit("(English only)")),
        F.when(hints != "", F.concat(F.lit(" ("), hints, F.lit(")"))).otherwise(""), F.coalesce(F.concat(F.lit(" — "), some("note")), F.lit("")),
    )
    rows = ordered(entries, ties=ties, by=["type"]).select(F.col("type").alias("section"), "place", line.alias("line"))
    heads = entries.select("type").distinct().select(F.col("type").alias("section"), F.lit(0).cast("long").alias("place"), F.concat(F.lit("## "), "type").alias("line"))
    return heads.unionByName(rows)


def get(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(spelling) -> the entry of each: the one with this source, else the first in order with it among its spellings."""
    names = spellings(entries, ["source", "type", "english"]).withColumn("__own", (F.col("source") == F.col("spelling")).cast("int"))
    order = Window.partitionBy("spelling").orderBy(F.desc("__own"), *listing(), "rank")
    best = asked.select("spelling").distinct().join(names, "spelling").withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    return asked.join(best.drop("__n", "__own", "rank"), "spelling", "left")


def unknown_speakers(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Lines whose speaker is no entry's English name."""
    names = entries.select(F.col("english").alias("speaker")).distinct()
    return lines.filter("speaker is not null and speaker <> ''").join(names, "speaker", "left_anti")
