"""Compositions: what a page, a chapter or a run looks like, and what a run makes of its inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import box_drawable, tolerant_bool, tolerant_box, tolerant_int, tolerant_notes
from ..functions.text import blank, sha
from . import glossary, incremental, layout, leaks, lines, regions, requests, seams, validate
from .ranks import settled
from .regions import TRANSLATED

#: How the two parts of a glossary block begin.
LOCKED = "Terms of this text and what each is called in English:"
KNOWN = "Further names in use so far:"

def load_pages(stored: DataFrame, *, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Stored readings (JSON) with defaults for whatever has the wrong type -> (regions with furniture marked anew, page meta).

    Words that the contract does not know stay as they are, for `violations` to find; only glue takes its default.
    """
    parsed = stored.select("page_id", F.try_parse_json(raw).alias("d"))
    rows = parsed.select("page_id", F.posexplode(regions.entries(F.col("d"))).alias("list_pos", "r")).withColumn("box", tolerant_box(F.col("r.box")))
    text = lambda c, default: F.coalesce(F.nullif(f"r.{c}", F.lit("")), default)
    loaded = rows.select(
        "page_id", "list_pos", text("id", F.concat(F.lit("r"), F.col("list_pos").cast("string"))).alias("region_id"), *[F.col(f"box.{n}").alias(n) for n in "xywh"], F.coalesce("r.text", F.lit("")).alias("text"),
        text("kind", F.lit("body")).alias("kind"), tolerant_int(F.col("r.order"), F.col("list_pos")).cast("int").alias("ord"), F.coalesce("r.join_prev", F.lit("")).alias("join_prev"), F.when(F.col("r.join_glue").isin(*regions.GLUES), F.col("r.join_glue")).otherwise("none").alias("join_glue"),
    )
    get = lambda path: F.try_variant_get("d", f"$.{path}", "string")
    meta = parsed.select(
        "page_id", F.when(get("order_source") == "user", "user").otherwise("model").alias("order_source"), F.coalesce(F.nullif(get("meta.confidence"), F.lit("")), F.lit("low")).alias("confidence"), F.nullif(get("meta.heading"), F.lit("")).alias("heading"),
        *[tolerant_bool(F.coalesce(get(f"meta.{c}"), F.lit(""))).alias(c) for c in ("starts_mid_sentence", "ends_mid_sentence", "ends_mid_word")], tolerant_notes(get("meta.notes")).alias("notes"),
    )
    return regions.mark_furniture(loaded).drop("changed"), meta


def merge_orders(rows: DataFrame, decisions: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """decisions(page_id, ids) -> (regions in the decided order, refused pages, saved orders): the ids must be the page's own, each once; null clears.

    A saved order holds the words in their new order, which survive a new reading, and the ids, which tell equal words apart in this one.
    """
    own = rows.groupBy("page_id").agg(F.array_sort(F.collect_list("region_id")).alias("__own"))
    asked = decisions.filter("ids is not null").join(own, "page_id", "left")
    fits = F.coalesce(F.array_sort("ids") == F.col("__own"), F.lit(False))
    ranks = asked.filter(fits).select("page_id", F.posexplode("ids").alias("__rank", "region_id"))
    placed = rows.join(ranks, ["page_id", "region_id"], "left")
    cleared = decisions.filter("ids is null").select("page_id", F.lit(True).alias("__clear"))
    ord_ = F.when(F.col("__clear"), F.col("list_pos")).otherwise(F.coalesce("__rank", "ord"))
    placed = placed.join(cleared, "page_id", "left")
    words = placed.filter("__rank is not null").select("page_id", F.col("__rank").alias("rank"), "text", F.col("region_id").alias("region_id_hint"), F.lit("user").alias("source"), (F.current_timestamp() if now is None else now).alias("at"))
    return placed.withColumn("ord", ord_).drop("__rank", "__clear"), asked.filter(~fits).select("page_id"), words


def order_notice(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Pages whose lines are in another order than when they were stored (page_id, order_hash); nothing is made stale."""
    now = rows.groupBy("page_id").agg(sha(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "list_pos", "region_id"))), lambda s: s["region_id"]), "|")).alias("__now"))
    return stored.join(now, "page_id").select("page_id", (F.col("order_hash") != F.col("__now")).alias("moved"))


def select_items(rows: DataFrame, asked: DataFrame | None, *, key: list[str], due: Column, force: bool = False) -> DataFrame:
    """Items asked for as they are, with the sweep's: all that are due, or all with force."""
    sweep = rows if force else rows.filter(due)
    return sweep.select(*key) if asked is None else sweep.select(*key).union(rows.join(asked, key, "left_semi").select(*key)).distinct()


def delete_ids(rows: DataFrame, ids: DataFrame, *, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what stays, what was removed) (U4)."""
    return rows.join(ids, key, "left_anti"), rows.join(ids, key, "left_semi")


def page_payload(rows: DataFrame, stored: DataFrame, **how) -> DataFrame:
    """Regions with their lines, state, panel and whether they can be drawn."""
    ordered = layout.panel_numbers(layout.exact_order(rows, **how))
    fresh = lines.freshness(rows, stored).select("page_id", "region_id", "state", "english")
    out = ordered.join(fresh, ["page_id", "region_id"], "left")
    return out.withColumn("drawable", box_drawable(*[F.col(c) for c in "xywh"]))


def script_lines(rows: DataFrame, **how) -> DataFrame:
    """Translatable lines in reading order with panel and hash."""
    ordered = layout.panel_numbers(layout.exact_order(rows, **how)).filter(F.col("kind").isin(*TRANSLATED) & ~blank(F.col("text")))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("ord", "list_pos")) - 1
    return ordered.select("page_id", "region_id", "kind", "text", "number", place.alias("place"), lines.region_hash(F.col("text")).alias("source_hash"))


def check_view(pages: DataFrame, rows: DataFrame, corrections: DataFrame, builds: DataFrame | None = None) -> DataFrame:
    """Pages for checking: regions with corrections laid over and the machine's words beside, neighbours, and with builds(work_id, built_at) whether the work was built before the page's last correction."""
    marked, _ = lines.apply_corrections(rows, corrections)
    around = seams.neighbours(pages)
    if builds is None:
        return marked.join(around.select("page_id", "previous", "next"), "page_id").select("page_id", "region_id", "ord", "text", "original", "corrected", "previous", "next")
    around = around.join(builds.select("work_id", "built_at"), "work_id", "left").select("page_id", "previous", "next", "corrected_at", "built_at")
    seen = marked.join(around, "page_id").withColumn("rebuild", F.coalesce(F.col("corrected_at") > F.col("built_at"), F.lit(False)))
    return seen.select("page_id", "region_id", "ord", "text", "original", "corrected", "previous", "next", "corrected_at", "built_at", "rebuild")


def resting_status(status: Column, before: Column, has_read: Column) -> Column:
    """Where abandoned work goes back to: what it was before, else by what it has."""
    busy = status.isin("queued", "reading", "running")
    return F.when(~busy, status).when(before.isNotNull() & ~before.isin("queued", "reading", "running"), before).when(has_read, "needs-check").otherwise("new")


def prompt_block(entries: DataFrame, hits: DataFrame, *, key: list[str], entry: list[str]) -> DataFrame:
    """The glossary block of each text: its terms by type and source with all spellings and hints, then, for every text, the names that have no source (C14).

    hits: key x entry. A text with terms gets both parts; texts without any get the names alone where they are joined.
    """
    hint = F.array_compact(F.array(F.nullif(F.coalesce("pronoun", F.lit("")), F.lit("")), *[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(said), F.col(c))) for c, said in (("first_person", "refers to self as "), ("register", "")) if c in entries.columns]))
    named = glossary.spellings(entries, entry).groupBy(*entry).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "spelling"))), lambda s: s["spelling"]), " / ").alias("__s"))
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("  ("), "note", F.lit(")"))).otherwise("") if "note" in entries.columns else F.lit("")
    line = F.concat(F.lit("  "), "__s", F.lit(" = "), "english", F.when(F.size(hint) > 0, F.concat(F.lit("  ["), F.array_join(hint, "; "), F.lit("]"))).otherwise(""), note)
    own = entries.filter("source <> ''").join(named, entry).select(*entry, "type", "source", line.alias("__l"))
    rows = hits.join(own, entry)
    block = rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "source", "__l"))), lambda s: s["__l"]), "\n").alias("__terms"))
    names = entries.filter("source = '' and english <> ''").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "english", F.concat(F.lit("  "), F.col("english"), note).alias("l")))), lambda s: s["l"]), "\n").alias("__names"))
    both = block.crossJoin(F.broadcast(names))  # one row
    parts = F.array_compact(F.array(F.concat(F.lit(LOCKED + "\n"), "__terms"), F.when(F.col("__names") != "", F.concat(F.lit(KNOWN + "\n"), "__names"))))
    return both.select(*key, F.array_join(parts, "\n\n").alias("block"))


def judge_responses(attempts: DataFrame, sources: DataFrame, *, key: list[str], script: str, terms: DataFrame | None = None, between: str = leaks.BLANK_LINE, glue: str = "\n\n", chatter: leaks.ChatterRules = leaks.ChatterRules(), **rules) -> DataFrame:
    """attempts(key, attempt, raw), sources(key, source) -> key, attempt, body, terms, said (what parsing warns of), and the verdict of validation: measures, failures, warnings, findings, n_failures (A11 over S11).

    terms(rank, spelling) are what may stay in the source's words. An attempt without a source is judged against an empty one.
    """
    each = [*key, "attempt"]
    parsed = requests.parse_prose(attempts, key=each, chatter=chatter, between=between, glue=glue).withColumnRenamed("warnings", "said")
    rows = parsed.select(*each, F.col("body").alias("output")).join(sources.select(*key, "source"), key, "left").withColumn("source", F.coalesce("source", F.lit("")))
    judged = validate.pairs(rows, key=each, script=script, chatter=chatter, between=between, terms=terms, **rules)
    return parsed.join(judged.withColumn("n_failures", F.size("failures")), each)


def merge_responses(attempts: DataFrame, sources: DataFrame, *, key: list[str], script: str, state: DataFrame | None = None, pending: DataFrame | None = None, entries: DataFrame | None = None, now: Column | None = None, **rules) -> dict[str, DataFrame]:
    """attempts(key, attempt, raw, usage, cost_usd), sources(key, source, content_hash) -> accepted, audit, terms, ledger, state, pending, variants (R2).

    Each attempt is parsed and validated here; the best one counts, every one is paid for. Only one without failures is
    readable and gives terms, with all they say of themselves; new terms wait in pending, and what names an entry's English
    in another spelling comes back as a variant. State gets status, attempts and hash over what it had. The glossary's
    spellings may stay in the output.
    """
    terms = None if entries is None else glossary.spellings(entries, ["source"]).groupBy("spelling").agg(F.min("rank").alias("rank"))
    judged = settled(judge_responses(attempts, sources, key=key, script=script, terms=terms, **rules))
    best = requests.best_attempt(judged, key=key)
    audit = best.withColumn("ok", F.col("n_failures") == 0)
    accepted, _ = requests.route(audit)
    proposed = accepted.select(*key, F.posexplode("terms").alias("place", "t")).select(*key, "place", *[f"t.{c}" for c in (*requests.TERM_FIELDS, "variants")])
    out = {"accepted": accepted.select(*key, "attempt", "body"), "audit": audit.drop("terms"), "terms": proposed}
    if "usage" in attempts.columns:
        out["ledger"] = attempts.select(*key, "attempt", "usage", "cost_usd")
    if state is not None:
        tries = attempts.groupBy(*key).agg(F.count("*").alias("attempts"))
        status = F.when(F.col("ok"), "validated").otherwise("needs-review")
        delta = audit.select(*key, status.alias("status")).join(tries, key).join(sources.select(*key, F.col("content_hash").alias("source_hash")), key, "left")
        out["state"] = incremental.overlay(state, delta.select(*key, *[c for c in ("status", "source_hash", "attempts") if c in state.columns]), keys=key, now=now)
    if pending is not None and entries is not None:
        queued, variants, _ = glossary.admit(proposed.withColumn("seq", F.struct(*key, "place")), pending, entries)
        out |= {"pending": queued.drop("seq", "place"), "variants": variants}
    return out


def reconcile(rows: DataFrame, stored: DataFrame, incoming: DataFrame, pages: DataFrame, results: DataFrame, saved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """A new reading (rows) with stored lines, machine lines, page results and saved orders -> (lines, pages) of the next snapshot.

    The saved order comes first, so that lines are carried in the order people read; pages get their order check anew.
    """
    ordered = rows if saved is None else lines.apply_order(rows, saved)[0]
    carried = lines.carry(ordered, stored).drop("from_id", "stored_pos")
    merged = lines.merge_machine(carried, incoming)
    if not {"x", "y", "w", "h"} <= set(rows.columns):
        return merged, lines.merge_pages(pages, results)
    return merged, lines.apply_reads(pages, results.withColumns({c: F.lit(None) for c in ("work_id", "usage", "cost_usd") if c not in results.columns}), ordered)[0]


def build_pages(rows: DataFrame, corrections: DataFrame, pages: DataFrame, *, saved: DataFrame | None = None, old: DataFrame | None = None, **how) -> dict[str, DataFrame]:
    """Readings to chapters and runs (R4) -> chapters, spans, warnings, notes (page_id, note).

    Furniture is marked, the order that people saved is laid over the machine's words, then their corrections with the
    headings that follow them; from the pages' text come seams, chapters and runs. old(work_id, page_ids, status): a run of
    exactly the same pages keeps its status. notes say which orders and corrections no longer fit.
    """
    found = regions.mark_furniture(rows).drop("changed")
    orders = saved if saved is not None else rows.filter("false").select("page_id", F.lit(0).alias("rank"), "text", F.col("region_id").alias("region_id_hint"))
    ordered, bad = lines.apply_order(found, orders)
    marked, lost = lines.apply_corrections(ordered, corrections)
    text = seams.flatten(marked)
    full = lines.correct_headings(pages, marked).join(text, "page_id", "left")
    proposed = seams.propose(full.filter("status <> 'skipped'"), **how)
    merged = seams.merge(full, proposed)
    chapters, warnings = seams.chapters(merged)
    runs = seams.spans(merged)[0]
    notes = bad.select("page_id", F.lit("order-lost").alias("note")).unionByName(lost.select("page_id", F.lit("correction-lost").alias("note")).distinct())
    return {"chapters": chapters, "spans": runs if old is None else seams.carry_status(old, runs), "warnings": warnings, "notes": notes}


def find(rows: DataFrame, asked: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """Point look-ups by id, number, hash or index (P16): asked(on) -> the first row in order for each; what is not there is not found."""
    first = Window.partitionBy(*on).orderBy(*order)
    wanted = rows.join(asked.select(*on).distinct(), on, "left_semi")
    return asked.join(wanted.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n"), on)
