"""Human decisions and translated lines against newer machine readings. A human decision is never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import box_drawable
from ..functions.text import blank, furniture_kind, sha, strip
from . import layout
from .regions import FURNITURE, TRANSLATED


def region_hash(text: Column) -> Column:
    return sha(strip(F.coalesce(text, F.lit(""))))


def freshness(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Translatable regions beside their lines with state: translated, stale (also: no hash) or untranslated."""
    rows = regions.filter(F.col("kind").isin(*TRANSLATED) & ~blank(F.col("text")))
    both = rows.join(lines.select("page_id", "region_id", "english", "source_hash"), ["page_id", "region_id"], "left")
    same = F.coalesce(F.col("source_hash") == region_hash(F.col("text")), F.lit(False))
    return both.withColumn("state", F.when(blank(F.col("english")), "untranslated").when(same, "translated").otherwise("stale"))


def line_counts(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Per page: lines, translated, stale, untranslated, undrawable, other (A5)."""
    fresh = freshness(regions, lines)
    drawn = box_drawable(*[F.col(c) for c in ("x", "y", "w", "h")])
    per = fresh.groupBy("page_id").agg(F.count("*").alias("lines"), *[F.count_if(F.col("state") == s).alias(s) for s in ("translated", "stale", "untranslated")], F.count_if(~drawn).alias("undrawable"))
    odd = regions.filter(~F.col("kind").isin(*TRANSLATED, *FURNITURE, "furigana") & ~blank(F.col("text"))).groupBy("page_id").agg(F.count("*").alias("other"))
    names = ["lines", "translated", "stale", "untranslated", "undrawable", "other"]
    every = regions.select("page_id").distinct().join(per, "page_id", "left").join(odd, "page_id", "left")
    return every.select("page_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def chapter_counts(members: DataFrame, pages: DataFrame, counts: DataFrame) -> DataFrame:
    """members(work_id, idx, page_id), pages(page_id, status, width, height), page counts -> sums per chapter."""
    names = ["lines", "translated", "stale", "untranslated", "undrawable", "other"]
    rows = members.join(pages.select("page_id", "status", "width", "height"), "page_id").join(counts, "page_id", "left").fillna(0, names)
    size = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    return rows.groupBy("work_id", "idx").agg(*[F.sum(c).alias(c) for c in names], F.count("*").alias("pages"), F.count_if(F.col("status") == "needs-check").alias("unchecked_pages"), F.count_if(~size).alias("unmeasured_pages"), F.count_if((F.col("lines") == 0) & (F.col("other") == 0)).alias("silent_pages"))


def carry(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines of an earlier reading at their place in a new one: page_id, region_id (now), from_id, and the line's columns.

    A line whose region has its words stays. The others go, in stored order, to the regions with their words that none has
    yet, in reading order. What is left keeps its id if that is free, else it goes.
    """
    own = regions.select("page_id", "region_id", region_hash(F.col("text")).alias("__h"), "ord", "list_pos")
    rest = [c for c in lines.columns if c not in ("page_id", "region_id")]
    rows = lines.withColumn("__has", F.coalesce(F.col("source_hash") != "", F.lit(False)))
    first = rows.join(own.select("page_id", "region_id", F.col("__h").alias("source_hash")), ["page_id", "region_id", "source_hash"], "left_semi").filter("__has")
    waiting = rows.join(first.select("page_id", "region_id"), ["page_id", "region_id"], "left_anti")
    free = own.join(first.select("page_id", "region_id"), ["page_id", "region_id"], "left_anti")
    by_words = Window.partitionBy("page_id", "__h")
    places = free.withColumn("__k", F.row_number().over(by_words.orderBy("ord", "list_pos"))).select("page_id", "__h", "__k", F.col("region_id").alias("__to"))
    queue = waiting.filter("__has").withColumn("__h", F.col("source_hash")).withColumn("__k", F.row_number().over(by_words.orderBy("stored_pos")))
    moved = queue.join(places, ["page_id", "__h", "__k"])
    settled = first.select("page_id", "region_id", F.col("region_id").alias("from_id"), *rest).unionByName(moved.select("page_id", F.col("__to").alias("region_id"), F.col("region_id").alias("from_id"), *rest))
    stranded = waiting.join(moved.select("page_id", "region_id"), ["page_id", "region_id"], "left_anti").join(settled.select("page_id", "region_id"), ["page_id", "region_id"], "left_anti")
    return settled.unionByName(stranded.select("page_id", "region_id", F.col("region_id").alias("from_id"), *rest))


def apply_order(regions: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Saved orders (page_id, rank, text, region_id_hint) on a new reading -> (regions, pages whose order no longer fits).

    Words decide, the id is a hint among equal words. Within a page each group of equal texts is taken in the saved order: the
    hinted region if it is still free, else the first free one. A page fits if every text finds a region and none is left.
    """
    words = strip(F.coalesce("text", F.lit("")))
    asked = saved.withColumn("__t", words).groupBy("page_id", "__t").agg(F.array_sort(F.collect_list(F.struct("rank", "region_id_hint"))).alias("__asked"))
    there = regions.withColumn("__t", words).groupBy("page_id", "__t").agg(F.array_sort(F.collect_list(F.struct("list_pos", "region_id"))).alias("__there"))
    both = there.join(asked, ["page_id", "__t"], "full")
    fits = F.coalesce(F.size("__asked") == F.size("__there"), F.lit(False))
    start = F.struct(F.transform("__there", lambda r: r["region_id"]).alias("left"), F.array().cast("array<struct<rank:int,region_id:string>>").alias("out"))

    def take(s: Column, a: Column) -> Column:
        pick = F.when(F.array_contains(s["left"], a["region_id_hint"]), a["region_id_hint"]).otherwise(F.get(s["left"], F.lit(0)))
        at = F.array_position(s["left"], pick).cast("int")
        left = F.concat(F.slice(s["left"], F.lit(1), at - 1), F.slice(s["left"], at + 1, F.size(s["left"])))
        return F.struct(left.alias("left"), F.concat(s["out"], F.array(F.struct(a["rank"].cast("int").alias("rank"), pick.alias("region_id")))).alias("out"))

    chosen = both.withColumn("__fits", fits).withColumn("__out", F.when(fits, F.aggregate("__asked", start, take, lambda s: s["out"])))
    asked_pages = saved.select("page_id").distinct()
    bad = chosen.join(asked_pages, "page_id", "left_semi").groupBy("page_id").agg(F.bool_and("__fits").alias("ok")).filter("not ok").select("page_id")
    ranks = chosen.join(asked_pages, "page_id", "left_semi").join(bad, "page_id", "left_anti").select("page_id", F.explode("__out").alias("o")).select("page_id", "o.region_id", F.col("o.rank").alias("__rank"))
    return regions.join(ranks, ["page_id", "region_id"], "left").withColumn("ord", F.coalesce("__rank", "ord")).drop("__rank"), bad


def apply_corrections(regions: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Human texts in place of the machine's, only where the region still says what was corrected -> (regions, lost corrections)."""
    c = corrections.select("page_id", "region_id", F.col("from_text").alias("__from"), F.col("to_text").alias("__to"))
    both = regions.join(c, ["page_id", "region_id"], "left")
    use = F.coalesce(strip(F.coalesce("text", F.lit(""))) == strip(F.col("__from")), F.lit(False))
    text = F.when(use, F.col("__to")).otherwise(F.col("text"))
    kind = F.when(use & ~F.col("kind").isin(*FURNITURE), F.coalesce(furniture_kind(F.col("__to")), F.col("kind"))).otherwise(F.col("kind"))
    marked = both.withColumns({"corrected": use, "original": F.col("text"), "__kind": kind, "text": text}).withColumn("kind", F.col("__kind")).drop("__kind", "__from", "__to")
    lost = c.join(marked.filter("corrected").select("page_id", "region_id"), ["page_id", "region_id"], "left_anti").select("page_id", "region_id")
    return marked, lost


def correct_headings(meta: DataFrame, marked: DataFrame) -> DataFrame:
    """page_meta's heading follows the correction of the heading region that says it; an emptied one is none (J10). marked: apply_corrections' regions."""
    same = marked.filter("corrected and kind = 'heading'").select(F.col("page_id").alias("__p"), F.col("list_pos").alias("__k"), strip(F.col("original")).alias("__was"), F.nullif(strip(F.col("text")), F.lit("")).alias("__is"))
    both = meta.join(same, (F.col("page_id") == F.col("__p")) & (strip(F.col("heading")) == F.col("__was")), "left")
    first = both.withColumn("__n", F.row_number().over(Window.partitionBy("page_id").orderBy("__k"))).filter("__n = 1")
    return first.withColumn("heading", F.when(F.col("__was").isNotNull(), F.col("__is")).otherwise(F.col("heading"))).select(*meta.columns)


def effective(regions: DataFrame, meta: DataFrame, saved: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A reading as it should be read: the saved order first, matched on the machine's words, then the corrections -> (regions, meta, notes: page_id, note)."""
    ordered, bad = apply_order(regions, saved)
    marked, lost = apply_corrections(ordered, corrections)
    notes = bad.select("page_id", F.lit("order-lost").alias("note")).unionByName(lost.select("page_id", F.lit("correction-lost").alias("note")).distinct())
    return marked, correct_headings(meta, marked), notes


def correct_pages(pages: DataFrame, stored: DataFrame, decisions: DataFrame, regions: DataFrame, busy: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A person's corrections -> (corrections, pages, refused: page_id, region_id, why).

    Refused are pages whose read is in flight (busy: page_id), pages never read (has_read) and regions that aren't there. A
    page with a real correction is edited unless it is skipped; corrected_at moves when a correction is made, changed or taken back.
    """
    asked = decisions.join(pages.select("page_id", "has_read"), "page_id", "left").join(busy.select("page_id").distinct().withColumn("__busy", F.lit(True)), "page_id", "left")
    there = regions.select("page_id", "region_id", F.lit(True).alias("__there"), F.col("text").alias("__original"))
    asked = asked.join(there, ["page_id", "region_id"], "left")
    why = F.when(F.col("__busy"), "in-flight").when(~F.coalesce("has_read", F.lit(False)), "not-read").when(F.col("__there").isNull(), "no-region")
    asked = asked.withColumn("why", why)
    taken = asked.filter("why is null")
    after = set_corrections(stored, taken.select("page_id", "region_id", "to_text"), regions, now)
    before = stored.select("page_id", "region_id", F.col("to_text").alias("__had"))
    told = taken.join(before, ["page_id", "region_id"], "left").withColumn("__real", strip(F.col("to_text")) != strip(F.coalesce("__original", F.lit(""))))
    moved = ~F.when(F.col("__real"), F.col("to_text")).eqNullSafe(F.col("__had"))
    marks = told.groupBy("page_id").agg(F.bool_or("__real").alias("__real"), F.bool_or(moved).alias("__moved"))
    both = pages.join(marks, "page_id", "left")
    status = F.when(F.coalesce("__real", F.lit(False)) & (F.col("status") != "skipped"), "edited").otherwise(F.col("status"))
    both = both.withColumns({"status": status, "corrected_at": F.when(F.col("__moved"), now).otherwise(F.col("corrected_at"))})
    return after, both.drop("__real", "__moved"), asked.filter("why is not null").select("page_id", "region_id", "why")


def needs_translating(counts: DataFrame) -> DataFrame:
    """Chapters with a line that has no English, whatever their status says."""
    return counts.withColumn("due", F.col("untranslated") > 0)


def set_corrections(stored: DataFrame, decisions: DataFrame, regions: DataFrame, now: Column) -> DataFrame:
    """decisions(page_id, region_id, to_text) into stored corrections: the machine's own text takes one back, the stamp moves only on a change."""
    asked = decisions.join(regions.select("page_id", "region_id", F.col("text").alias("__original")), ["page_id", "region_id"])
    both = stored.join(asked.select("page_id", "region_id", F.col("to_text").alias("__to"), "__original"), ["page_id", "region_id"], "full")
    decided = F.col("__to").isNotNull()
    kept = both.filter(~(decided & (strip(F.col("__to")) == strip(F.coalesce("__original", F.lit(""))))))
    return kept.select(
        "page_id", "region_id", F.when(decided, F.col("__original")).otherwise(F.col("from_text")).alias("from_text"),
        F.coalesce("__to", "to_text").alias("to_text"), F.when(decided & ~F.col("__to").eqNullSafe(F.col("to_text")), now).otherwise(F.col("at")).alias("at"),
    )


def merge_machine(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Machine lines into stored ones; English with its hash, and speaker, stay where a user set them."""
    groups = {"english": ("english", "source_hash", "english_source"), "speaker": ("speaker", "speaker_source")}
    fields = [f for g in groups.values() for f in g]
    new = incoming.select("page_id", "region_id", F.lit(True).alias("__in"), *[F.col(f).alias(f"__{f}") for f in fields])
    both = current.join(new, ["page_id", "region_id"], "full")
    out = {}
    for lead, group in groups.items():
        keep = F.col(f"{lead}_source").eqNullSafe(F.lit("user")) | F.col("__in").isNull()
        out |= {f: F.when(keep, F.col(f)).otherwise(F.coalesce(F.col(f"__{f}"), F.col(f))) for f in group}
    return both.select("page_id", "region_id", *[v.alias(f) for f, v in out.items()])


def edit_lines(lines: DataFrame, edits: DataFrame, regions: DataFrame) -> DataFrame:
    """edits(page_id, region_id, english): a user's words, stamped with the words on the page now."""
    now = regions.select("page_id", "region_id", region_hash(F.col("text")).alias("__h"))
    both = lines.join(edits.select("page_id", "region_id", F.col("english").alias("__e")), ["page_id", "region_id"], "full").join(now, ["page_id", "region_id"], "left")
    edited = F.col("__e").isNotNull()
    new = {"english": F.col("__e"), "source_hash": F.col("__h"), "english_source": F.lit("user")}
    return both.withColumns({c: F.when(edited, v).otherwise(F.col(c)) for c, v in new.items()}).drop("__e", "__h")


def merge_pages(current: DataFrame, results: DataFrame) -> DataFrame:
    """Results (page_id, status) of reads in flight: a page that was skipped meanwhile stays skipped."""
    both = current.join(results.select("page_id", F.col("status").alias("__new")), "page_id", "left")
    return both.withColumn("status", F.when((F.col("status") != "skipped") & F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("status"))).drop("__new")


def apply_reads(pages: DataFrame, results: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finished reads (page_id, work_id, status, usage, cost_usd) with their regions -> (pages with status and order check, ledger rows).

    A page skipped meanwhile stays skipped, but its read is kept and paid for; deleted pages count for nothing. The order check
    is made anew for every page that was read.
    """
    done = results.join(pages.select("page_id"), "page_id", "left_semi")
    checked = layout.check(rows.join(done.select("page_id"), "page_id", "left_semi")).select("page_id", F.col("reversed").alias("looks_reversed"), "disagreement")
    merged = merge_pages(pages, done.select("page_id", "status")).drop("looks_reversed", "disagreement").join(checked, "page_id", "left")
    return merged, done.select("work_id", "usage", "cost_usd")


def rest_pages(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Where stopped or failed work (page_id, status, error) leaves a page: only the worker's own marks give way, and a reason is kept except on a skipped page."""
    both = pages.join(results.select("page_id", F.col("status").alias("__new"), F.col("error").alias("__why")), "page_id", "left")
    own = F.col("status").isin("queued", "reading") & F.col("__new").isNotNull()
    error = F.when((F.col("status") != "skipped") & F.col("__why").isNotNull(), F.col("__why")).otherwise(F.col("error"))
    return both.withColumns({"error": error, "status": F.when(own, F.col("__new")).otherwise(F.col("status"))}).drop("__new", "__why")


def decide_pages(pages: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """decisions(page_id, status) of a person -> (pages, refused): `new` on a page that has been read means it needs a check."""
    allowed = F.col("status").isin("edited", "ok", "skipped", "new")
    good = decisions.filter(allowed).select("page_id", F.col("status").alias("__d"))
    both = pages.join(good, "page_id", "left")
    status = F.when(F.col("__d").isNull(), F.col("status")).when((F.col("__d") == "new") & F.col("has_read"), "needs-check").otherwise(F.col("__d"))
    return both.withColumn("status", status).drop("__d"), decisions.filter(~allowed)
