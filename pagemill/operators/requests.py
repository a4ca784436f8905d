"""Requests to a model and what came back: chunks, tails, records, attempts, routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import whole_json
from ..functions.text import blank, nonspace_length, strip
from . import leaks
from .ledger import MONEY, usage_by_key

TERMS_MARK = "===NEW_TERMS==="
#: What a proposed term may say of itself; variants are a list besides.
TERM_FIELDS = ("source", "english", "type", "note", "pronoun", "register", "first_person", "reading")
FENCE = r"\A\s*```\w*\s*\z"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def chunk(chapters: DataFrame, *, key: list[str], paragraphs: str = "paragraphs", threshold: int = 12_000, text: Callable[[Column], Column] = lambda p: p) -> DataFrame:
    """Paragraphs filled into chunks in order up to `threshold` characters that are no white space; a longer one stands alone (W18). text: that of a paragraph, where it is not all of it.

    The sum starts anew with each chunk, so it is a fold over the ordered paragraphs, not a window. The fold keeps the size
    of the open chunk and where chunks begin, the paragraphs are cut out afterwards.
    """
    sizes = F.transform(paragraphs, lambda p: nonspace_length(text(p)))
    start = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))

    def step(s: Column, n: Column) -> Column:
        over = (s["at"] == 0) | (s["size"] + n > threshold)
        return F.struct(F.when(over, n).otherwise(s["size"] + n).alias("size"), (s["at"] + 1).alias("at"), F.when(over, F.array_append(s["begins"], s["at"])).otherwise(s["begins"]).alias("begins"))

    held = chapters.select(*key, F.col(paragraphs).alias("__p"), F.aggregate(sizes, start, step).alias("__f"))
    begins = F.col("__f.begins")
    cuts = F.zip_with(begins, F.array_append(F.slice(begins, F.lit(2), F.greatest(F.size(begins) - 1, F.lit(0))), F.col("__f.at")), lambda a, b: F.slice(F.col("__p"), a + 1, b - a))
    return held.select(*key, F.posexplode(F.when(F.size("__p") > 0, cuts)).alias("chunk_no", "paragraphs"))


def continuity_tail(lines: DataFrame, *, key: list[str], order: str, n: int = 3) -> DataFrame:
    """The last n lines of what is there already, in order; none for n = 0."""
    last = Window.partitionBy(*key).orderBy(F.desc(order))
    return lines.withColumn("__n", F.row_number().over(last)).filter(F.col("__n") <= n).drop("__n")


def best_attempt(attempts: DataFrame, *, key: list[str]) -> DataFrame:
    """attempts(key, attempt, n_failures): the first without failures, else the fewest, the earliest of equals."""
    order = Window.partitionBy(*key).orderBy("n_failures", "attempt")
    return attempts.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def should_retry(missing: Column, expected: Column, received: Column, share: float = 0.2) -> Column:
    """Nothing came back, or more than `share` of the lines is missing."""
    return F.coalesce((received == 0) | (missing / expected > share), F.lit(False))


def split_terms(raw: Column) -> tuple[Column, Column, Column]:
    """A response -> what stands before the first mark, what stands after it (null without one), and whether there is one."""
    text = F.coalesce(raw, F.lit(""))
    at = F.instr(text, TERMS_MARK)
    body = F.when(at > 0, F.substring_index(text, TERMS_MARK, 1)).otherwise(text)
    return body, F.when(at > 0, F.substr(text, at + len(TERMS_MARK))), at > 0


def read_terms(tail: Column) -> tuple[Column, dict[str, Column]]:
    """The text after a mark -> (terms that have a source, warnings by name): the JSON array from the first [ to the last ].

    A term is an object; whatever else the array holds is left out, and so are terms without source. Fields are texts,
    stripped and empty where they are lacking; variants are a list of them; the type is in lower case, `other` unless said.
    """
    listed = F.regexp_extract(tail, r"(?s)\[.*\]", 0)
    found = F.try_variant_get(whole_json(F.nullif(listed, F.lit(""))), "$", "array<variant>")

    def text(term: Column, field: str) -> Column:
        return strip(F.coalesce(F.try_variant_get(term, f"$.{field}", "string"), F.lit("")))

    def term(t: Column) -> Column:
        variants = F.transform(F.coalesce(F.try_variant_get(t, "$.variants", "array<string>"), F.array().cast("array<string>")), lambda v: strip(F.coalesce(v, F.lit(""))))
        own = {c: text(t, c) for c in TERM_FIELDS}
        own["type"] = F.coalesce(F.nullif(F.lower(own["type"]), F.lit("")), F.lit("other"))
        return F.struct(*[v.alias(c) for c, v in own.items()], F.filter(variants, lambda v: v != "").alias("variants"))

    objects = F.filter(found, lambda t: F.schema_of_variant(t).startswith("OBJECT"))
    every = F.transform(F.coalesce(objects, F.array().cast("array<variant>")), term)
    warnings = {"no-terms-array": tail.isNotNull() & (listed == ""), "terms-unreadable": (listed != "") & found.isNull(), "blank-term": F.exists(every, lambda t: t["source"] == "")}
    return F.filter(every, lambda t: t["source"] != ""), warnings


def named(warnings: dict[str, Column]) -> Column:
    """The names of those that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(hit, F.lit(False)), n) for n, hit in warnings.items()]))


def parse_prose(responses: DataFrame, *, key: list[str], raw: str = "raw", chatter: leaks.ChatterRules = leaks.ChatterRules(), between: str = leaks.BLANK_LINE, glue: str = "\n\n") -> DataFrame:
    """raw -> body, terms, warnings; never fails.

    The body is what stands before the first mark, without commentary that can go safely; blocks that mix it with prose
    stay and are warned of. Terms keep all their fields.
    """
    before, tail, marked = split_terms(F.col(raw))
    rows = responses.select(*key, before.alias("__before"), tail.alias("__tail"), marked.alias("__marked"))
    rows = rows.withColumn("__blocks", leaks.judged_blocks(F.col("__before"), chatter, between))

    def of(*verdicts: str) -> Column:
        return F.transform(F.filter("__blocks", lambda x: x["verdict"].isin(*verdicts)), lambda x: x["block"])

    body = strip(F.array_join(of("keep", "report"), glue))
    terms, warned = read_terms(F.col("__tail"))
    warnings = {"no-terms-mark": ~F.col("__marked"), "commentary-removed": F.size(of("remove")) > 0, "commentary-mixed": F.size(of("report")) > 0, **warned, "no-text": body == ""}
    return rows.select(*key, body.alias("body"), terms.alias("terms"), named(warnings).alias("warnings"))


def parse_records(responses: DataFrame, expected: DataFrame, *, key: list[str], raw: str = "raw") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tab-separated records (id, speaker, English; or id, English) of each response -> (lines, defects, terms).

    Records stand before the first mark, terms after it. English may hold tabs. Blank rows and fences are nothing, rows
    without a tab are ignored, unexpected ids refused; a record without English delivers nothing, and of those of one id
    that have some the first counts. terms: key, terms, warnings; no commentary is looked for, as a record is no prose.
    """
    before, tail, marked = split_terms(F.col(raw))
    held = responses.select(*key, before.alias("__before"), tail.alias("__tail"), marked.alias("__marked"))
    found, warned = read_terms(F.col("__tail"))
    terms = held.select(*key, found.alias("terms"), named({"no-terms-mark": ~F.col("__marked"), **warned}).alias("warnings"))
    rows = held.select(*key, F.posexplode(F.split("__before", LINE_BREAK)).alias("pos", "__row")).filter(~blank(F.col("__row")) & ~F.col("__row").rlike(FENCE))
    cells = F.split("__row", "\t", 3)
    two = F.size(cells) == 2
    rows = rows.withColumns({"id": strip(F.get(cells, F.lit(0))), "speaker": F.when(two, "").otherwise(strip(F.get(cells, F.lit(1)))), "english": strip(F.when(two, F.get(cells, F.lit(1))).otherwise(F.get(cells, F.lit(2))))})
    records = rows.filter(F.instr("__row", "\t") > 0)
    delivered = records.filter("english <> ''").join(expected, [*key, "id"], "left_semi").withColumn("__n", F.row_number().over(Window.partitionBy(*key, "id").orderBy("pos")))
    lines = delivered.filter("__n = 1").select(*key, "id", "speaker", "english")
    parts = {
        "unexpected": records.join(expected, [*key, "id"], "left_anti"),
        "duplicate": delivered.filter("__n > 1"),
        "ignored": rows.filter(F.instr("__row", "\t") == 0),
        "missing": expected.join(lines, [*key, "id"], "left_anti"),
    }
    tagged = None
    for name, part in parts.items():
        one = part.select(*key, F.lit(name).alias("__d"))
        tagged = one if tagged is None else tagged.unionByName(one)
    defects = tagged.groupBy(*key).agg(*[F.count_if(F.col("__d") == n).alias(n) for n in parts])
    return lines, expected.select(*key).distinct().join(defects, key, "left").fillna(0, list(parts)), terms


def retry_union(first: DataFrame, again: DataFrame, *, key: list[str]) -> DataFrame:
    """Lines of a second attempt, and of the first where the second has none."""
    return again.unionByName(first.join(again, [*key, "id"], "left_anti"))


def retry_totals(*attempts: DataFrame, key: list[str]) -> DataFrame:
    """attempts(key, usage, cost_usd, terms, chunks, warnings), in order -> their sums, all terms, and warnings, those of later ones marked."""
    every = None
    for n, one in enumerate(attempts):
        said = F.transform("warnings", lambda w: w) if not n else F.transform("warnings", lambda w: F.concat(F.lit("retry: "), w))
        rows = one.select(*key, F.lit(n).alias("__n"), "usage", "cost_usd", "terms", "chunks", said.alias("warnings"))
        every = rows if every is None else every.unionByName(rows)
    in_order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__n", c))), lambda s: s[c]))
    joined = every.groupBy(*key).agg(F.sum(F.col("cost_usd").cast(MONEY)).cast(MONEY).alias("cost_usd"), in_order("terms").alias("terms"), F.sum("chunks").alias("chunks"), in_order("warnings").alias("warnings"))
    used = usage_by_key(every, key=key).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "amount")))).alias("usage"))
    return joined.join(used, key, "left")


def route(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(ok, ...) -> (accepted, audit): every row is audited, only valid ones are readable."""
    return rows.filter("ok"), rows


def accept(audit: DataFrame, decisions: DataFrame, *, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Reviewed rows a person accepts -> (promoted, refused for lack of text)."""
    asked = audit.join(decisions.select(*key), key, "left_semi")
    empty = blank(F.col("text"))
    return asked.filter(~empty).withColumns({"status": F.lit("validated"), "accepted": F.lit(True)}), asked.filter(empty).select(*key)


def reader(chapters: DataFrame, accepted: DataFrame, audit: DataFrame, *, key: list[str], order: str, state: DataFrame | None = None) -> DataFrame:
    """Chapters with the accepted text, or else the audited one, and their neighbours.

    With state(key, status, source_hash, accepted) and chapters' content_hash also status, accepted, and stale: the text was
    made from other words than those shown beside it.
    """
    a = accepted.select(*key, F.col("text").alias("__a"))
    b = audit.select(*key, F.col("text").alias("__b"))
    work = Window.partitionBy(*[k for k in key if k != order]).orderBy(order)
    rows = chapters.join(a, key, "left").join(b, key, "left")
    out = rows.withColumns({"text": F.coalesce("__a", "__b"), "from_audit": F.col("__a").isNull() & F.col("__b").isNotNull(), "previous": F.lag(order).over(work), "next": F.lead(order).over(work)}).drop("__a", "__b")
    if state is None:
        return out
    held = out.join(state.select(*key, F.col("status").alias("__s"), F.col("source_hash").alias("__h"), F.col("accepted").alias("__ok")), key, "left")
    stale = F.coalesce((F.col("__h") != "") & (F.col("__h") != F.col("content_hash")), F.lit(False))
    return held.withColumns({"status": F.coalesce("__s", F.lit("")), "stale": stale, "accepted": F.coalesce("__ok", F.lit(False))}).drop("__s", "__h", "__ok")


#: What goes round a request's words; every text of a request is a parameter of `user_message`.
WORDS = {
    "chunk": "Part {index} of {total}; done up to part {previous}.", "tail": "How the last part ended:", "title": "Title: ",
    "notes": "Wishes for this work: ", "body": "Text:",
}


def user_message(body: Column, *, title: Column, index: Column, total: Column, tail: Column, notes: Column, words: dict[str, str] = WORDS) -> Column:
    """The text of one request (C14): note on its part, tail, title (first part only), notes of the work, body; blank parts don't appear."""
    place = F.replace(F.replace(F.replace(F.lit(words["chunk"]), F.lit("{index}"), index.cast("string")), F.lit("{total}"), total.cast("string")), F.lit("{previous}"), F.greatest(F.lit(1), index - 1).cast("string"))
    some = lambda c: F.when(~blank(c), strip(c))
    parts = [F.when(total > 1, place), F.concat(F.lit(words["tail"] + "\n\n"), some(tail)), F.when(index == 1, F.concat(F.lit(words["title"]), some(title))), F.concat(F.lit(words["notes"]), some(notes)), F.concat(F.lit(words["body"] + "\n\n"), body)]
    return F.array_join(F.array_compact(F.array(*parts)), "\n\n")


#: What an answer has to look like where a request does not say.
CONTRACT = f"Answer with the translation alone, then {TERMS_MARK} and a JSON array of new terms."


def system_message(*, block: Column, contract: Column | None = None, voice: Column | None = None, notes: Column | None = None) -> Column:
    """Voice, notes of the work, glossary block and output contract of a request; any contract may stand in for the usual one."""
    some = lambda c: F.when(~blank(c), strip(c))
    return F.array_join(F.array_compact(F.array(*[some(c) for c in (voice, notes, block) if c is not None], F.lit(CONTRACT) if contract is None else F.coalesce(contract, F.lit(CONTRACT)))), "\n\n")


def due_requests(chunks: DataFrame, responses: DataFrame, relevant: DataFrame, *, key: list[str], tail: int = 3) -> DataFrame:
    """One row per request that can go out now (R1): chunks without a response whose predecessor has one (or is none).

    chunks(key, chunk_no, paragraphs), responses(key, chunk_no, text), relevant(key, term) -> key, chunk_no, body, terms, tail.
    Run again after each round of responses until no row is due.
    """
    got = responses.select(*key, F.col("chunk_no").alias("__no"), F.col("text").alias("__before"))
    open_ = chunks.join(got.select(*key, F.col("__no").alias("chunk_no")), [*key, "chunk_no"], "left_anti")
    ready = open_.withColumn("__no", F.col("chunk_no") - 1).join(got, [*key, "__no"], "left").filter("chunk_no = 0 or __before is not null")
    names = relevant.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set("term")), "\n").alias("terms"))
    parts = F.split("__before", "\n")
    last = F.when(F.col("__before").isNull() | F.lit(tail == 0), "").otherwise(F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - tail + 1), F.lit(max(tail, 1))), "\n"))
    return ready.join(names, key, "left").select(*key, "chunk_no", F.array_join("paragraphs", "\n\n").alias("body"), F.coalesce("terms", F.lit("")).alias("terms"), last.alias("tail"))
