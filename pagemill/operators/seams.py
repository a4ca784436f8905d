"""How pages follow each other, and the chapters and page runs they make. Pages: work_id, ord, seq, page_id, status, text, heading, flags, join_prev, join_glue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ENDS_SENTENCE, STARTS_ON, blank, first_visible, looks_like_heading, strip, unclosed_quote
from .ranks import numbered
from .regions import JOINS, PROSE

#: Fixed value: what a page may begin with that opens a quotation or bracket of its own.
OPENERS = tuple("\"'“‘「『（([【《〈〝")
APPROVED = ("ok", "edited")


def flatten(regions: DataFrame, *, kinds: tuple[str, ...] = PROSE) -> DataFrame:
    """The text of each page: regions of these kinds in order, sentences run on, everything else a blank line apart."""
    text = strip(F.coalesce("text", F.lit("")))
    rows = regions.filter(F.col("kind").isin(*kinds)).withColumn("text", text).filter("text <> ''")
    glue = F.when(F.col("join_prev") == "sentence", F.when(F.col("join_glue") == "space", " ").otherwise("")).otherwise("\n\n")
    parts = F.array_sort(F.collect_list(F.struct("ord", "list_pos", glue.alias("glue"), "text")))
    joined = F.aggregate("__p", F.lit(""), lambda acc, p: F.when(acc == "", p["text"]).otherwise(F.concat(acc, p["glue"], p["text"])))
    return rows.groupBy("page_id").agg(parts.alias("__p")).select("page_id", joined.alias("text"))


Extractor = Callable[[DataFrame], Column]


def extracted(pages: DataFrame, text_of: Extractor | None, heading_of: Extractor | None) -> DataFrame:
    """Pages with text and heading as the extractors give them (X1); without one the columns of these names count."""
    asked = {name: of(pages) for name, of in (("text", text_of), ("heading", heading_of)) if of}
    return pages.withColumns(asked) if asked else pages


def propose(pages: DataFrame, *, ends: str = ENDS_SENTENCE, continues: str = STARTS_ON, text_of: Extractor | None = None, heading_of: Extractor | None = None) -> DataFrame:
    """Adds proposed, glue, confidence, reason for the seam before each page; null for the first of a work.

    The first rule that holds decides: a heading; a split word; a sentence that both sides leave open; an open quotation; a
    sentence that only the page before leaves open (a gap, unless this page opens with a continuation); a finished sentence.
    """
    pages = extracted(pages, text_of, heading_of)
    order = Window.partitionBy("work_id").orderBy("ord")
    before = {c: F.lag(c).over(order) for c in ("text", "ends_mid_word", "ends_mid_sentence")}
    rows = pages.withColumns({f"__{c}": v for c, v in before.items()}).withColumn("__n", F.row_number().over(order))
    mid_word, mid_sentence = (F.coalesce(F.col(f"__{c}"), F.lit(False)) for c in ("ends_mid_word", "ends_mid_sentence"))
    starts_mid = F.coalesce("starts_mid_sentence", F.lit(False))
    first = first_visible(F.col("text"))
    open_quote = (first != "") & ~first.isin(*OPENERS) & unclosed_quote(F.col("__text"))
    ladder: list[tuple[Column, str, float, str]] = [
        (~blank(F.col("heading")), "chapter", 0.95, "heading"),
        (mid_word, "sentence", 0.95, "split-word"),
        (mid_sentence & starts_mid, "sentence", 0.9, "open-sentence"),
        (open_quote, "sentence", 0.85, "open-quotation"),
        (mid_sentence & F.coalesce("text", F.lit("")).rlike(continues), "sentence", 0.6, "continuation"),
        (mid_sentence, "gap", 0.6, "fresh-start"),
        (F.coalesce("__text", F.lit("")).rlike(ends), "paragraph", 0.75, "finished-sentence"),
        (F.lit(True), "paragraph", 0.4, "no-signal"),
    ]
    said = F.lit(None)
    for hit, kind, sure, reason in reversed(ladder):
        said = F.when(hit, F.struct(F.lit(kind).alias("kind"), F.lit("none").alias("glue"), F.lit(sure).alias("confidence"), F.lit(reason).alias("reason"))).otherwise(said)
    rows = rows.withColumn("__j", F.when(F.col("__n") > 1, said))
    return rows.withColumns({"proposed": F.col("__j.kind"), "glue": F.col("__j.glue"), "confidence": F.col("__j.confidence"), "reason": F.col("__j.reason")}).drop("__j", "__n", *[f"__{c}" for c in before])


def merge(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """Stored seams (page_id, join_prev, join_glue, join_prev_source) with proposals (page_id, proposed, glue): a user's seam stays, unknown kinds are ignored."""
    both = current.join(proposed.select("page_id", "proposed", F.col("glue").alias("__g")), "page_id", "left")
    take = F.coalesce(F.col("proposed").isin(*JOINS) & ~F.col("join_prev_source").eqNullSafe(F.lit("user")), F.lit(False))
    new = {"join_prev": F.col("proposed"), "join_glue": F.col("__g"), "join_prev_source": F.lit("model")}
    return both.withColumns({c: F.when(take, v).otherwise(F.col(c)) for c, v in new.items()}).drop("proposed", "__g")


def chapters(pages: DataFrame, *, text_of: Extractor | None = None, heading_of: Extractor | None = None) -> tuple[DataFrame, DataFrame]:
    """Approved pages -> (chapters: work_id, idx, title, text, pages; warnings: the pages before which one may be missing)."""
    rows = extracted(pages, text_of, heading_of).filter(F.col("status").isin(*APPROVED)).withColumn("text", strip(F.coalesce("text", F.lit("")))).filter("text <> ''")
    order = Window.partitionBy("work_id").orderBy("ord")
    rows = rows.withColumn("__first", F.row_number().over(order) == 1).withColumn("__join", F.coalesce(F.nullif("join_prev", F.lit("")), F.lit("paragraph")))
    begins = F.col("__first") | (F.col("__join") == "chapter")
    rows = rows.withColumn("__begins", begins).withColumn("idx", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    headed = ~blank(F.col("heading"))
    own = F.when(headed & ~looks_like_heading(F.substring_index("text", "\n", 1)), F.concat("heading", F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
    glue = F.when(F.col("__join") == "sentence", F.when(F.col("join_glue") == "space", " ").otherwise("")).otherwise("\n\n")
    piece = F.when(F.col("__begins"), own).otherwise(F.concat(glue, F.col("text")))
    rows = rows.withColumn("__piece", piece).withColumn("__title", F.when(F.col("__begins") & headed, strip(F.col("heading"))))
    made = rows.groupBy("work_id", "idx").agg(F.array_sort(F.collect_list(F.struct("ord", "__piece"))).alias("__p"), F.max("__title").alias("__t"), F.count("*").alias("pages"))
    text = F.array_join(F.transform("__p", lambda p: p["__piece"]), "")
    done = made.select("work_id", "idx", F.coalesce("__t", F.concat(F.lit("Chapter "), F.col("idx").cast("string"))).alias("title"), text.alias("text"), "pages")
    return done, rows.filter(~F.col("__first") & (F.col("__join") == "gap")).select("work_id", "page_id", "seq")


def spans(pages: DataFrame, *, heading_of: Extractor | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages that are not skipped -> (runs: work_id, idx, title, start_seq, end_seq, page_ids; warnings)."""
    rows = extracted(pages, None, heading_of).filter(~F.col("status").eqNullSafe(F.lit("skipped")))
    order = Window.partitionBy("work_id").orderBy("ord")
    begins = (F.row_number().over(order) == 1) | F.coalesce(F.col("join_prev") == "chapter", F.lit(False))
    rows = rows.withColumn("__b", begins)
    rows = rows.withColumn("idx", F.sum(F.col("__b").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    title = F.max(F.when(F.col("__b") & ~blank(F.col("heading")), F.col("heading")))
    made = rows.groupBy("work_id", "idx").agg(title.alias("__t"), F.min_by("seq", "ord").alias("start_seq"), F.max_by("seq", "ord").alias("end_seq"), F.array_sort(F.collect_list(F.struct("ord", "page_id"))).alias("__p"))
    done = made.select("work_id", "idx", F.coalesce("__t", F.concat(F.lit("Chapter "), F.col("idx").cast("string"))).alias("title"), "start_seq", "end_seq", F.transform("__p", lambda p: p["page_id"]).alias("page_ids"))
    return done, rows.filter("join_prev = 'gap'").select("work_id", "page_id", "seq")


def carry_status(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rebuilt runs with the status of an old run of exactly the same pages, else `new`."""
    def key(c: str) -> Column:
        return F.sha2(F.array_join(F.transform(c, lambda p: p.cast("string")), "|"), 256)

    known = old.select("work_id", key("page_ids").alias("__k"), "status").dropDuplicates(["work_id", "__k"])
    return new.withColumn("__k", key("page_ids")).join(known, ["work_id", "__k"], "left").withColumn("status", F.coalesce("status", F.lit("new"))).drop("__k")


def members(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages of each run that still exist, in the manifest's present order."""
    return runs.select("work_id", "idx", F.explode("page_ids").alias("page_id")).join(pages.select("work_id", "page_id", "ord", "seq"), ["work_id", "page_id"])


def neighbours(pages: DataFrame) -> DataFrame:
    """Adds previous and next page of the work."""
    order = Window.partitionBy("work_id").orderBy("ord")
    return pages.withColumns({"previous": F.lag("page_id").over(order), "next": F.lead("page_id").over(order)})


def summary(pages: DataFrame) -> DataFrame:
    """Per work: pages, by_status, ready, unmeasured, chars, reversed pages that no one settled."""
    each = pages.groupBy("work_id", "status").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.count_if("unmeasured").alias("unmeasured"), F.count_if(F.col("looks_reversed") & ~F.col("order_source").eqNullSafe(F.lit("user"))).alias("reversed_pages"))
    return each.groupBy("work_id").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"), F.sum(F.when(F.col("status").isin(*APPROVED), F.col("n")).otherwise(0)).alias("ready"),
        F.sum("unmeasured").alias("unmeasured"), F.sum("chars").alias("chars"), F.sum("reversed_pages").alias("reversed_pages"),
    )


def append(pages: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """incoming(work_id, name, sha256, arrival) -> (new pages with the next seq, duplicates with the seq they repeat).

    A hash already in the work, or earlier in the batch, is a duplicate; arrivals are told apart by their number. Numbers are
    never used again, and a work of any size is numbered in ranges.
    """
    known = pages.groupBy("work_id", "sha256").agg(F.min("seq").alias("seq"))
    heads = incoming.groupBy("work_id", "sha256").agg(F.min_by(F.struct("arrival"), "arrival").alias("first"))
    marked = incoming.join(known, ["work_id", "sha256"], "left").join(heads, ["work_id", "sha256"])
    is_first = F.col("arrival") == F.col("first.arrival")
    fresh = marked.filter(F.col("seq").isNull() & is_first).drop("seq", "first")
    top = pages.groupBy("work_id").agg(F.max("seq").alias("__top"))
    placed = numbered(fresh, by=["work_id"], order=[F.col("arrival")], name="__place")
    new = placed.join(top, "work_id", "left").withColumn("seq", (F.coalesce("__top", F.lit(0)) + F.col("__place")).cast("long")).drop("__top", "__place")
    every = known.unionByName(new.select("work_id", "sha256", "seq"))
    again = marked.filter(F.col("seq").isNotNull() | ~is_first).drop("seq", "first").join(every, ["work_id", "sha256"])
    return new, again
