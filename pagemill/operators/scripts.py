"""Requests for whole scripts: a chapter's lines in panel-headed blocks of a page, chunks of them, and rounds until nothing is due.

Lines: key (a chapter), page_seq, place (their order in the page), id, kind, text, panel. What a round asks follows from the
lines and the responses so far, so it can be computed again at any time; answers are records (`requests.parse_records`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, strip
from . import requests
from .ranks import settled

#: How a block says where it is; panel 0 is no panel.
PAGE, PANEL = "Page {page}", "Page {page}, panel {panel}"
#: What goes round a script's words, and what its answer has to look like.
WORDS = {**requests.WORDS, "body": "Lines, in this order:"}
CONTRACT = f"Answer with one record for each line: id, speaker and English, tabs between them. Then {requests.TERMS_MARK} and a JSON array of new terms."


def _filled(words: str, **values: Column) -> Column:
    out = F.lit(words)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value.cast("string"))
    return out


def script_blocks(lines: DataFrame, *, key: list[str], page: str = PAGE, panel: str = PANEL) -> DataFrame:
    """key, page_seq, block, ids: a page's lines in order (id, kind in brackets, text), a header at its beginning and where the panel changes (W13). Blank lines are none."""
    order = Window.partitionBy(*key, "page_seq").orderBy("place", "id")
    rows = lines.filter(~blank(F.col("text"))).withColumn("panel", F.coalesce("panel", F.lit(0)))
    head = F.when(F.col("panel") == 0, _filled(page, page=F.col("page_seq"))).otherwise(_filled(panel, page=F.col("page_seq"), panel=F.col("panel")))
    changed = ~F.lag("panel").over(order).eqNullSafe(F.col("panel"))
    line = F.concat_ws("\t", "id", F.concat(F.lit("["), "kind", F.lit("]")), strip(F.col("text")))
    rows = rows.withColumn("__row", F.concat(F.when(changed, F.concat(head, F.lit("\n"))).otherwise(""), line))
    made = rows.groupBy(*key, "page_seq").agg(F.array_sort(F.collect_list(F.struct("place", "id", "__row"))).alias("__l"))
    return made.select(*key, "page_seq", F.array_join(F.transform("__l", lambda x: x["__row"]), "\n").alias("block"), F.transform("__l", lambda x: x["id"]).alias("ids"))


def script_chunks(blocks: DataFrame, *, key: list[str], threshold: int = 12_000) -> DataFrame:
    """key, chunk_no, total, body, ids: blocks filled into chunks in order of their pages, none is cut (W18). A chapter is one row, as it is one request's worth or a few."""
    pages = blocks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("page_seq", "block", "ids"))).alias("pages"))
    cut = requests.chunk(pages, key=key, paragraphs="pages", threshold=threshold, text=lambda p: p["block"])
    total = cut.groupBy(*key).agg(F.count("*").alias("total"))
    body = F.array_join(F.transform("paragraphs", lambda p: p["block"]), "\n\n")
    return cut.join(total, key).select(*key, "chunk_no", "total", body.alias("body"), F.flatten(F.transform("paragraphs", lambda p: p["ids"])).alias("ids"))


def expected_ids(chunks: DataFrame, *, key: list[str]) -> DataFrame:
    return chunks.select(*key, "chunk_no", F.explode("ids").alias("id"))


def produced(chunks: DataFrame, responses: DataFrame, *, key: list[str]) -> DataFrame:
    """responses(key, chunk_no, raw) -> key, id, speaker, english: each answer counts for the lines of its own chunk only."""
    return requests.parse_records(responses, expected_ids(chunks, key=key), key=[*key, "chunk_no"])[0].drop("chunk_no")


def tails(lines: DataFrame, chunks: DataFrame, english: DataFrame, *, key: list[str], n: int = 3) -> DataFrame:
    """key, chunk_no, tail: the last n lines before each chunk, each with its English beside it where there is some; none for n = 0."""
    if n <= 0:
        return chunks.select(*key, "chunk_no", F.lit("").alias("tail"))
    order = Window.partitionBy(*key).orderBy("page_seq", "place", "id")
    rows = lines.filter(~blank(F.col("text"))).withColumn("__no", F.row_number().over(order)).join(expected_ids(chunks, key=key), [*key, "id"])
    said = rows.join(english.select(*key, "id", "english"), [*key, "id"], "left")
    text = F.when(F.col("english").isNull(), strip(F.col("text"))).otherwise(F.concat_ws("\t->\t", strip(F.col("text")), F.col("english")))
    said = said.select(*key, "__no", text.alias("__t"))
    begins = rows.groupBy(*key, "chunk_no").agg(F.min("__no").alias("__first")).filter("__first > 1")
    wanted = begins.select(*key, "chunk_no", F.explode(F.sequence(F.greatest(F.lit(1), F.col("__first") - n), F.col("__first") - 1)).alias("__no"))
    made = wanted.join(said, [*key, "__no"]).groupBy(*key, "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__no", "__t"))), lambda x: x["__t"]), "\n").alias("tail"))
    return chunks.select(*key, "chunk_no").join(made, [*key, "chunk_no"], "left").withColumn("tail", F.coalesce("tail", F.lit("")))


def with_messages(due: DataFrame, *, key: list[str], about: DataFrame | None = None, blocks: DataFrame | None = None, voice: Column | None = None, contract: str = requests.CONTRACT, words: dict[str, str] = requests.WORDS) -> DataFrame:
    """due(key, chunk_no, total, body, tail) with message and system: about(key, title, notes) and blocks(key, block: the glossary's) of the texts where there are some."""
    rows = due
    for frame, columns in ((about, ("title", "notes")), (blocks, ("block",))):
        if frame is None:
            rows = rows.withColumns({c: F.lit("") for c in columns})
        else:
            rows = rows.join(frame.select(*key, *columns), key, "left").fillna("", list(columns))
    message = requests.user_message(F.col("body"), title=F.col("title"), index=F.col("chunk_no") + 1, total=F.col("total"), tail=F.col("tail"), notes=F.col("notes"), words=words)
    system = requests.system_message(block=F.col("block"), voice=voice, contract=F.lit(contract))
    return rows.withColumns({"message": message, "system": system}).drop("title", "notes", "block")


def due_scripts(lines: DataFrame, responses: DataFrame, *, key: list[str], threshold: int = 12_000, tail: int = 3, about: DataFrame | None = None, blocks: DataFrame | None = None, words: dict[str, str] = WORDS) -> DataFrame:
    """Requests that can go out now (R1): chunks without a response whose predecessor has one or is none -> key, chunk_no, total, ids, tail, body, message, system."""
    chunks = script_chunks(script_blocks(lines, key=key), key=key, threshold=threshold)
    got = responses.select(*key, "chunk_no").distinct()
    open_ = chunks.join(got, [*key, "chunk_no"], "left_anti")
    first, next_ = open_.filter("chunk_no = 0"), open_.filter("chunk_no > 0").join(got.withColumn("chunk_no", F.col("chunk_no") + 1), [*key, "chunk_no"], "left_semi")
    due = first.unionByName(next_)
    ended = tails(lines, chunks, produced(chunks, responses, key=key), key=key, n=tail)
    return with_messages(due.join(ended, [*key, "chunk_no"]), key=key, about=about, blocks=blocks, contract=CONTRACT, words=words)


def rounds(due_of: Callable[[DataFrame], DataFrame], respond: Callable[[DataFrame], DataFrame], responses: DataFrame, *, most: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Asks what is due, adds the answers, and asks again until nothing is due -> (all requests with `round`, all responses).

    There are as many rounds as the longest text has chunks; each round's requests and answers are written down, so that
    none is asked twice. An answer, however poor, counts as one. Answers to what was not asked are not taken.
    """
    asked = None
    for n in range(most):
        due = settled(due_of(responses).withColumn("round", F.lit(n)))
        if asked is not None and due.isEmpty():
            return asked, responses
        asked = due if asked is None else asked.unionByName(due)
        if due.isEmpty():
            return asked, responses
        on = [c for c in responses.columns if c in due.columns and c != "raw"]
        responses = settled(responses.unionByName(respond(due).select(*responses.columns).join(due.select(*on), on, "left_semi").select(*responses.columns)))
    raise RuntimeError("requests stay due; raise `most`")
