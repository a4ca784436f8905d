"""Requests, responses and sources over `documents`, `conversations`, `benchmark` and `events`."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import glossary, intake, regions, requests, scripts, segment, views
from ..operators.ranks import settled, shared_folder
from ..sources import files
from . import layout_plans as L
from .corpus import NONSPACE, PARAS, STRIP
from .registry import query, table
from .terms import ENTRIES_SQL, entries_of

LINE = r"\n"
THRESHOLD = 400


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", segment.paragraphs(F.col("text"), LINE).alias("paragraphs"))
    return requests.chunk(rows, key=["doc_id"], threshold=THRESHOLD)


CHUNK_SQL = f"""para AS (SELECT doc_id, unnest(p) AS t, generate_subscripts(p, 1) AS n FROM (SELECT doc_id, {PARAS % 'text'} AS p FROM documents)),
sized AS (SELECT *, {NONSPACE % 't'}::BIGINT AS s FROM para),
walk AS (SELECT doc_id, n, t, s, 0::BIGINT AS chunk_no, s AS size FROM sized WHERE n = 1
  UNION ALL SELECT z.doc_id, z.n, z.t, z.s, CASE WHEN w.size + z.s > {THRESHOLD} THEN w.chunk_no + 1 ELSE w.chunk_no END, CASE WHEN w.size + z.s > {THRESHOLD} THEN z.s ELSE w.size + z.s END FROM walk w JOIN sized z ON z.doc_id = w.doc_id AND z.n = w.n + 1),
chunks AS (SELECT doc_id, chunk_no::INT AS chunk_no, list(t ORDER BY n) AS paragraphs FROM walk GROUP BY ALL)"""


@query(f"WITH RECURSIVE {CHUNK_SQL} SELECT doc_id, chunk_no, len(paragraphs)::BIGINT AS n, sha256(array_to_string(paragraphs, chr(10))) AS body FROM chunks")
def chunk_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(spark, sf_dir).select("doc_id", "chunk_no", F.size("paragraphs").cast("long").alias("n"), F.sha2(F.array_join("paragraphs", "\n"), 256).alias("body"))


REQUEST_SQL = f"""{CHUNK_SQL}, resp AS (SELECT doc_id, chunk_no, 'a' || chr(10) || 'b' || doc_id || chr(10) || 'c' || chunk_no || chr(10) || 'd' AS t FROM chunks WHERE doc_id % 2 = 0 AND chunk_no < doc_id % 4),
{ENTRIES_SQL}, hits AS (SELECT DISTINCT doc_id, item_id FROM documents d JOIN spelled s ON contains(d.text, s.spelling)), rel AS (SELECT doc_id, string_agg(DISTINCT english, chr(10) ORDER BY english) AS terms FROM hits JOIN entries e USING (item_id) GROUP BY doc_id),
sp AS (SELECT item_id, string_agg(spelling, ' / ' ORDER BY r) AS sp FROM spelled GROUP BY item_id), bl AS (SELECT doc_id, string_agg('  ' || sp || ' = ' || english || CASE WHEN item_id % 4 = 0 THEN '  [it]' ELSE '  [she]' END, chr(10) ORDER BY type, source, '  ' || sp || ' = ' || english) AS terms_ FROM hits JOIN entries USING (item_id) JOIN sp USING (item_id) WHERE source <> '' GROUP BY doc_id),
nm AS (SELECT string_agg('  ' || english, chr(10) ORDER BY type, english) AS names FROM entries WHERE source = ''),
block AS (SELECT doc_id, '{views.LOCKED}' || chr(10) || terms_ || CASE WHEN names IS NULL THEN '' ELSE chr(10) || chr(10) || '{views.KNOWN}' || chr(10) || names END AS block FROM bl, nm), total AS (SELECT doc_id, count(*) AS total FROM chunks GROUP BY doc_id)"""


@query(
    f"""WITH RECURSIVE {REQUEST_SQL}, asked AS (SELECT c.doc_id, c.chunk_no, array_to_string(paragraphs, chr(10) || chr(10)) AS body, coalesce(terms, '') AS terms, CASE WHEN b.t IS NULL THEN '' ELSE 'b' || c.doc_id || chr(10) || 'c' || b.chunk_no || chr(10) || 'd' END AS tail
FROM chunks c LEFT JOIN resp b ON b.doc_id = c.doc_id AND b.chunk_no = c.chunk_no - 1 LEFT JOIN rel ON rel.doc_id = c.doc_id
WHERE NOT EXISTS (FROM resp r WHERE r.doc_id = c.doc_id AND r.chunk_no = c.chunk_no) AND (c.chunk_no = 0 OR b.t IS NOT NULL))
SELECT doc_id, chunk_no, sha256(body) AS body, terms, tail, sha256(CASE WHEN total > 1 THEN 'Part ' || (chunk_no + 1) || ' of ' || total || '; done up to part ' || greatest(1, chunk_no) || '.' || chr(10) || chr(10) ELSE '' END
  || CASE WHEN tail <> '' THEN '{requests.WORDS["tail"]}' || chr(10) || chr(10) || tail || chr(10) || chr(10) ELSE '' END || '{requests.WORDS["body"]}' || chr(10) || chr(10) || body) AS message,
  sha256(CASE WHEN block IS NULL THEN '' ELSE {STRIP % 'block'} || chr(10) || chr(10) END || '{requests.CONTRACT}') AS system FROM asked JOIN total USING (doc_id) LEFT JOIN block USING (doc_id)"""
)
def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that can go out now, with their relevant terms, the tail before them, message and glossary block."""
    chunks = chunks_of(spark, sf_dir)
    text = F.concat(F.lit("a\nb"), F.col("doc_id").cast("string"), F.lit("\nc"), F.col("chunk_no").cast("string"), F.lit("\nd"))
    responses = chunks.filter("doc_id % 2 = 0 and chunk_no < doc_id % 4").select("doc_id", "chunk_no", text.alias("text"))
    entries = entries_of(spark, sf_dir)
    names = glossary.spellings(entries, ["item_id"]).select("item_id", "spelling")
    hits = settled(glossary.relevant(table(spark, sf_dir, "documents"), names, key=["doc_id"], entry=["item_id"]))
    due = requests.due_requests(chunks, responses, hits.join(entries.select("item_id", F.col("english").alias("term")), "item_id").select("doc_id", "term"), key=["doc_id"])
    blocks = views.prompt_block(entries, hits, key=["doc_id"], entry=["item_id"])
    made = scripts.with_messages(due.join(chunks.groupBy("doc_id").agg(F.count("*").alias("total")), "doc_id"), key=["doc_id"], blocks=blocks)
    return made.select("doc_id", "chunk_no", F.sha2("body", 256).alias("body"), "terms", "tail", F.sha2("message", 256).alias("message"), F.sha2("system", 256).alias("system"))


SCRIPT_THRESHOLD, SCRIPT_TAIL = 300, 2
SCRIPT_SQL = f"""{L.NUMBER_SQL}, line AS (SELECT page_id // 6 AS work_id, page_id, row_number() OVER (PARTITION BY page_id ORDER BY ord, list_pos) AS place, page_id || ':' || list_pos AS id, list_pos, kind, text, number,
  lag(number) OVER (PARTITION BY page_id ORDER BY ord, list_pos) AS before FROM numbered WHERE kind IN {regions.TRANSLATED}),
blk AS (SELECT work_id, page_id, row_number() OVER (PARTITION BY work_id ORDER BY page_id) AS n, string_agg(CASE WHEN before IS DISTINCT FROM number THEN 'Page ' || page_id || CASE WHEN number > 0 THEN ', panel ' || number ELSE '' END || chr(10) ELSE '' END || id || chr(9) || '[' || kind || ']' || chr(9) || text, chr(10) ORDER BY place) AS block FROM line GROUP BY work_id, page_id),
sized_blk AS (SELECT *, {NONSPACE % 'block'}::BIGINT AS s FROM blk),
fill AS (SELECT work_id, page_id, n, block, s, 0::BIGINT AS chunk_no, s AS size FROM sized_blk WHERE n = 1
  UNION ALL SELECT z.work_id, z.page_id, z.n, z.block, z.s, CASE WHEN w.size + z.s > {SCRIPT_THRESHOLD} THEN w.chunk_no + 1 ELSE w.chunk_no END, CASE WHEN w.size + z.s > {SCRIPT_THRESHOLD} THEN z.s ELSE w.size + z.s END FROM fill w JOIN sized_blk z ON z.work_id = w.work_id AND z.n = w.n + 1),
chunked AS (SELECT work_id, chunk_no, min(page_id) AS first_page, string_agg(block, chr(10) || chr(10) ORDER BY n) AS body, count(*) OVER (PARTITION BY work_id) AS total FROM fill GROUP BY work_id, chunk_no),
told AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY page_id, place) AS no, text || CASE WHEN list_pos % 4 = 3 THEN '' ELSE chr(9) || '->' || chr(9) || 'E' || list_pos || ' ' || text END AS both_ FROM line),
ended AS (SELECT c.work_id, c.chunk_no, string_agg(t.both_, chr(10) ORDER BY t.no) AS tail FROM chunked c JOIN (SELECT work_id, page_id, min(no) AS no FROM told GROUP BY ALL) f ON f.work_id = c.work_id AND f.page_id = c.first_page
  JOIN told t ON t.work_id = c.work_id AND t.no BETWEEN f.no - {SCRIPT_TAIL} AND f.no - 1 WHERE c.chunk_no > 0 GROUP BY ALL)"""


def script_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("page_id").orderBy("ord", "list_pos")
    rows = L.numbered(spark, sf_dir).filter(F.col("kind").isin(*regions.TRANSLATED))
    id_ = F.concat_ws(":", F.col("page_id").cast("string"), F.col("list_pos").cast("string"))
    return rows.select(F.floor(F.col("page_id") / 6).cast("long").alias("work_id"), F.col("page_id").alias("page_seq"), F.row_number().over(order).alias("place"), id_.alias("id"), "kind", "text", F.col("number").alias("panel"))


def _answers(lines: DataFrame, due: DataFrame) -> DataFrame:
    """What a model might answer: most lines, some noise, and another chunk's line, which does not count."""
    pos = F.split("id", ":")[1].cast("int")
    line = F.when(pos % 4 == 3, F.concat("id", F.lit("\t\t"))).otherwise(F.concat_ws("\t", "id", F.lit("who"), F.concat(F.lit("E"), pos.cast("string"), F.lit(" "), F.col("text"))))
    rows = due.select("work_id", "chunk_no", F.posexplode("ids").alias("k", "id")).join(lines.select("work_id", "id", "text"), ["work_id", "id"])
    made = rows.groupBy("work_id", "chunk_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("r")))), lambda x: x["r"]), "\n").alias("r"))
    return made.select("work_id", "chunk_no", F.concat(F.lit("Sure.\n0:0\twho\tnot asked\n"), "r", F.lit(f"\n{requests.TERMS_MARK}\n[]")).alias("raw"))


@query(
    f"""WITH RECURSIVE {SCRIPT_SQL} SELECT work_id, chunk_no::INT AS chunk_no, chunk_no::INT AS round, sha256(coalesce(tail, '')) AS tail, sha256(CASE WHEN total > 1 THEN 'Part ' || (chunk_no + 1) || ' of ' || total || '; done up to part ' || greatest(1, chunk_no) || '.' || chr(10) || chr(10) ELSE '' END
  || CASE WHEN tail IS NOT NULL THEN '{scripts.WORDS["tail"]}' || chr(10) || chr(10) || tail || chr(10) || chr(10) ELSE '' END || CASE WHEN chunk_no = 0 THEN '{scripts.WORDS["title"]}W' || work_id || chr(10) || chr(10) ELSE '' END || CASE WHEN work_id % 2 = 1 THEN '{scripts.WORDS["notes"]}short' || chr(10) || chr(10) ELSE '' END
  || '{scripts.WORDS["body"]}' || chr(10) || chr(10) || body) AS message, sha256(CASE WHEN work_id % 3 = 0 THEN 'terms of ' || work_id || chr(10) || chr(10) ELSE '' END || '{scripts.CONTRACT}') AS system FROM chunked LEFT JOIN ended USING (work_id, chunk_no)"""
)
def script_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests for scripts, asked and answered round by round until nothing is due, with message, glossary block and tail."""
    lines = settled(script_of(spark, sf_dir))  # read in every round
    works = lines.select("work_id").distinct()
    w = F.col("work_id")
    about = works.select("work_id", F.concat(F.lit("W"), w.cast("string")).alias("title"), F.when(w % 2 == 1, "short").alias("notes"))
    blocks = works.filter(w % 3 == 0).select("work_id", F.concat(F.lit("terms of "), w.cast("string")).alias("block"))
    none = spark.createDataFrame([], "work_id long, chunk_no int, raw string")
    asked, _ = scripts.rounds(lambda responses: scripts.due_scripts(lines, responses, key=["work_id"], threshold=SCRIPT_THRESHOLD, tail=SCRIPT_TAIL, about=about, blocks=blocks), lambda due: _answers(lines, due), none)
    return asked.select("work_id", "chunk_no", "round", F.sha2("tail", 256).alias("tail"), F.sha2("message", 256).alias("message"), F.sha2("system", 256).alias("system"))


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def continuity_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.continuity_tail(table(spark, sf_dir, "conversations"), key=["conv_id"], order="turn").select("conv_id", "turn")


@query("SELECT conv_id, arg_min(turn, (length(text) % 4) * 1000000 + turn) AS attempt, min(length(text) % 4)::INT AS n_failures FROM conversations GROUP BY conv_id")
def best_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("attempt"), (F.length("text") % 4).alias("n_failures"))
    return requests.best_attempt(rows, key=["conv_id"])


CONTROLS = r"[\x00-\x1f\x{85}\x{2028}\x{2029}]"


def records_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Responses as tab-separated rows: some of two fields, blank, repeated, unexpected, or without a tab."""
    rows = table(spark, sf_dir, "conversations")
    t, english = F.col("turn"), F.regexp_replace("text", CONTROLS, " ")
    name = F.concat(F.lit("l"), t.cast("string"))
    row = F.when(t % 6 == 4, F.concat_ws("\t", name, english)).when(t % 6 == 5, F.concat_ws("\t", name, "role", F.lit(" "))).when(t % 6 == 3, F.concat(F.lit("so "), english)).when(t % 6 == 2, F.concat_ws("\t", F.lit("zz"), "role", english)).otherwise(F.concat(F.concat_ws("\t", name, "role", english), F.lit("\textra")))
    again = F.when(t % 6 == 0, F.concat_ws("\t", name, "role", F.lit("again")))
    empty = F.when(t % 6 == 1, F.concat_ws("\t", name, "role", F.lit(" "))).when(t % 6 == 2, F.lit(" ```tsv "))  # delivers nothing; a fence
    body = rows.select("conv_id", t.alias("k"), F.concat_ws("\n", empty, row, again).alias("r")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda s: s["r"]), "\r\n").alias("body"))
    c = F.col("conv_id")
    term = F.concat(F.lit('{"source": " s'), c.cast("string"), F.lit(' ", "english": "E", "type": "Name", "pronoun": "it", "variants": ["v", " ", 7], "note": 5}'))
    tail = F.when(c % 4 == 0, F.concat(F.lit("so:\n["), term, F.lit(', "junk", {"source": ""}]\nl0\trole\tlate'))).when(c % 4 == 1, "[{]").when(c % 4 == 2, "none")
    made = body.select("conv_id", F.concat_ws(f"\n{requests.TERMS_MARK}", "body", tail).alias("raw"))
    expected = rows.select("conv_id", name.alias("id"))
    return made, expected


@query(f"SELECT conv_id, 'l' || turn AS id, CASE WHEN turn % 6 = 4 THEN '' ELSE role END AS speaker, {STRIP % '''(regexp_replace(text, '[\\x00-\\x1f\\x{85}\\x{2028}\\x{2029}]', ' ', 'g') || CASE WHEN turn % 6 = 4 THEN '' ELSE chr(9) || 'extra' END)'''} AS english FROM conversations WHERE turn % 6 IN (0, 1, 4)")
def parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated records back to lines."""
    return requests.parse_records(*records_of(spark, sf_dir), key=["conv_id"])[0]


@query("SELECT conv_id, count(*) FILTER (turn % 6 = 2) AS unexpected, count(*) FILTER (turn % 6 = 0) AS duplicate, count(*) FILTER (turn % 6 = 3) AS ignored, count(*) FILTER (turn % 6 IN (2, 3, 5)) AS missing FROM conversations GROUP BY conv_id")
def expected_vs_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of each response."""
    return requests.parse_records(*records_of(spark, sf_dir), key=["conv_id"])[1]


@query("""SELECT DISTINCT conv_id, CASE WHEN conv_id % 4 = 0 THEN 's' || conv_id || '|E|name|5|it||||v,7' ELSE '' END AS terms,
  CASE conv_id % 4 WHEN 0 THEN ['blank-term'] WHEN 1 THEN ['terms-unreadable'] WHEN 2 THEN ['no-terms-array'] ELSE ['no-terms-mark'] END AS warnings FROM conversations""")
def record_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms after the mark of record responses, with all their fields."""
    found = requests.parse_records(*records_of(spark, sf_dir), key=["conv_id"])[2]
    line = F.transform("terms", lambda t: F.array_join(F.concat(F.array(*[t[c] for c in requests.TERM_FIELDS]), F.array(F.array_join(t["variants"], ","))), "|"))
    return found.select("conv_id", F.array_join(line, ";").alias("terms"), "warnings")


@query("SELECT conv_id, count(*) FILTER (turn % 6 IN (0, 1, 4)) = 0 OR count(*) FILTER (turn % 6 IN (2, 3, 5)) / count(*) > 0.4 AS retry FROM conversations GROUP BY conv_id")
def retry_worthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses worth a second attempt."""
    raw, expected = records_of(spark, sf_dir)
    lines, defects, _ = requests.parse_records(raw, expected, key=["conv_id"])
    n = expected.groupBy("conv_id").agg(F.count("*").alias("expected")).join(lines.groupBy("conv_id").agg(F.count("*").alias("received")), "conv_id", "left").join(defects, "conv_id")
    return n.select("conv_id", requests.should_retry(F.col("missing"), F.col("expected"), F.coalesce("received", F.lit(0)), 0.4).alias("retry"))


@query("SELECT conv_id, 'l' || turn AS id, CASE WHEN turn % 2 = 0 THEN 'second' ELSE 'first' END AS english FROM conversations WHERE turn % 5 <> 4 OR turn % 2 = 0")
def retry_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second attempt over a first."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("l"), F.col("turn").cast("string")).alias("id"))
    first = rows.filter("turn % 5 <> 4").select("conv_id", "id", F.lit("first").alias("english"))
    return requests.retry_union(first, rows.filter("turn % 2 = 0").select("conv_id", "id", F.lit("second").alias("english")), key=["conv_id"])


@query("SELECT conv_id, (count(*) * 0.25 + count(*) FILTER (turn % 2 = 0) * 0.5)::DECIMAL(18,6) AS cost_usd, sum(length(text))::BIGINT + coalesce(sum(turn) FILTER (turn % 2 = 0), 0)::BIGINT AS tokens, (count(*) + 2 * count(*) FILTER (turn % 2 = 0))::BIGINT AS chunks, count(*) + count(*) FILTER (turn % 2 = 0) AS terms, count(*) FILTER (turn % 2 = 0) AS retries FROM conversations GROUP BY conv_id")
def retry_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend, terms, chunks and warnings of both attempts."""
    rows = table(spark, sf_dir, "conversations")

    def attempt(frame: DataFrame, tokens: F.Column, cost: float, chunks: int) -> DataFrame:
        return frame.select("conv_id", F.create_map(F.lit("tokens"), tokens.cast("long")).alias("usage"), F.lit(cost).alias("cost_usd"), F.array("role").alias("terms"), F.lit(chunks).alias("chunks"), F.array(F.lit("w")).alias("warnings"))

    found = requests.retry_totals(attempt(rows, F.length("text"), 0.25, 1), attempt(rows.filter("turn % 2 = 0"), F.col("turn"), 0.5, 2), key=["conv_id"])
    retries = F.size(F.filter("warnings", lambda w: w == "retry: w")).cast("long")
    return found.select("conv_id", "cost_usd", F.col("usage")["tokens"].alias("tokens"), "chunks", F.size("terms").cast("long").alias("terms"), retries.alias("retries"))


@query(
    f"""WITH RECURSIVE {CHUNK_SQL}, n AS (SELECT doc_id, count(*) AS total FROM chunks GROUP BY doc_id)
SELECT doc_id, chunk_no, sha256(CASE WHEN total > 1 THEN 'Part ' || (chunk_no + 1) || ' of ' || total || '; done up to part ' || greatest(1, chunk_no) || '.' || chr(10) || chr(10) ELSE '' END
  || CASE WHEN chunk_no % 2 = 1 THEN '{requests.WORDS["tail"]}' || chr(10) || chr(10) || 't' || chunk_no || chr(10) || chr(10) ELSE '' END || CASE WHEN chunk_no = 0 THEN '{requests.WORDS["title"]}T' || doc_id || chr(10) || chr(10) ELSE '' END
  || CASE WHEN doc_id % 3 = 0 THEN '{requests.WORDS["notes"]}keep names' || chr(10) || chr(10) ELSE '' END || '{requests.WORDS["body"]}' || chr(10) || chr(10) || array_to_string(paragraphs, chr(10) || chr(10))) AS message,
  CASE WHEN doc_id % 5 = 0 THEN 'only text' ELSE '{requests.CONTRACT}' END AS contract FROM chunks JOIN n USING (doc_id)"""
)
def request_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of requests (C14), some under another contract for the answer."""
    chunks = chunks_of(spark, sf_dir)
    rows = chunks.join(chunks.groupBy("doc_id").agg(F.count("*").alias("total")), "doc_id")
    d, k = F.col("doc_id"), F.col("chunk_no")
    message = requests.user_message(F.array_join("paragraphs", "\n\n"), title=F.concat(F.lit(" T"), d.cast("string")), index=k + 1, total=F.col("total"), tail=F.when(k % 2 == 1, F.concat(F.lit("t"), k.cast("string"))).otherwise(" "), notes=F.when(d % 3 == 0, " keep names "))
    return rows.select("doc_id", "chunk_no", F.sha2(message, 256).alias("message"), requests.system_message(block=F.lit(""), contract=F.when(d % 5 == 0, "only text")).alias("contract"))


@query(
    f"""SELECT item_id, {STRIP % 'text'} || CASE WHEN item_id % 3 = 1 THEN chr(10) || chr(10) || 'Let me translate this chapter. Then Aoi folded the letter and went out into the rain.' ELSE '' END AS body, CASE WHEN item_id % 5 < 2 THEN 1 ELSE 0 END AS terms,
  CASE WHEN item_id % 5 < 2 THEN 'she|Low|v' ELSE '' END AS said, list_filter([CASE WHEN item_id % 5 = 3 THEN 'no-terms-mark' END, CASE WHEN item_id % 3 = 0 THEN 'commentary-removed' END, CASE WHEN item_id % 3 = 1 THEN 'commentary-mixed' END,
    CASE WHEN item_id % 5 = 4 THEN 'no-terms-array' END, CASE WHEN item_id % 5 = 2 THEN 'terms-unreadable' END, CASE WHEN item_id % 5 = 1 THEN 'blank-term' END], lambda x: x IS NOT NULL) AS warnings FROM benchmark"""
)
def parse_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose responses with commentary that goes or stays, with their terms, unreadable terms, none, and a second mark after the first."""
    one = F.concat(F.lit('[{"source":"s'), F.col("item_id").cast("string"), F.lit('","english":"E","pronoun":" she","note":"Low","variants":["v",""]}'))
    k, said = F.col("item_id") % 5, F.col("item_id") % 3
    before = F.when(said == 0, "Let me translate.\n\n").otherwise("")
    after = F.when(said == 1, "\n\nLet me translate this chapter. Then Aoi folded the letter and went out into the rain.").otherwise("")
    mark = F.when(k == 3, "\n").otherwise(f"\n{requests.TERMS_MARK}\n")
    tail = F.when(k == 0, F.concat(one, F.lit(f'] {requests.TERMS_MARK} more'))).when(k == 1, F.concat(one, F.lit(',"junk",{"source":" "}]'))).when(k == 2, "[{]").otherwise("")
    raw = F.concat(F.lit("\n"), before, "text", after, mark, tail)
    found = requests.parse_prose(table(spark, sf_dir, "benchmark").select("item_id", raw.alias("raw")), key=["item_id"])
    first = F.get("terms", F.lit(0))
    said_of = F.coalesce(F.concat_ws("|", first["pronoun"], first["note"], F.nullif(F.array_join(first["variants"], ","), F.lit(""))), F.lit(""))
    return found.select("item_id", "body", F.size("terms").alias("terms"), said_of.alias("said"), "warnings")


@query("SELECT doc_id, text IS NOT NULL AND length(text) % 3 <> 0 AS readable, count(*) OVER () AS audited FROM documents WHERE length(text) % 3 <> 0")
def accepted_and_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows for readers beside the number of audited rows."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") % 3 != 0).alias("ok"))
    accepted, _ = requests.route(rows)
    count = accepted.agg(F.count("*").alias("audited"))
    return accepted.select("doc_id", F.col("ok").alias("readable")).crossJoin(F.broadcast(count))  # one row


@query("SELECT doc_id, 'validated' AS status FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND n_chars >= 100")
def accept_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed texts that a person accepts."""
    audit = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") >= 100, F.col("text")).otherwise(" ").alias("text"))
    said = table(spark, sf_dir, "labels").filter("quality = 1")
    return requests.accept(audit, said, key=["doc_id"])[0].select("doc_id", "status")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'ok ' || turn WHEN turn % 3 = 1 THEN 'audit' END AS text, turn % 3 = 1 AS from_audit, lag(turn) OVER w AS previous, lead(turn) OVER w AS next,
  CASE WHEN turn % 4 = 3 THEN '' WHEN turn % 2 = 0 THEN 'validated' ELSE 'needs-review' END AS status, turn % 4 <> 3 AND turn % 5 = 0 AS stale, turn % 4 <> 3 AND turn % 2 = 0 AS accepted FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def reader_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees: accepted text, else the audited one, with its state and whether it is of other words."""
    t = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("content_hash"))
    accepted = rows.filter("turn % 3 = 0").withColumn("text", F.concat(F.lit("ok "), t.cast("string")))
    state = rows.filter("turn % 4 <> 3").select("conv_id", "turn", F.when(t % 2 == 0, "validated").otherwise("needs-review").alias("status"), F.when(t % 5 == 0, "old").otherwise(F.col("content_hash")).alias("source_hash"), (t % 2 == 0).alias("accepted"))
    return requests.reader(rows, accepted, rows.filter("turn % 3 <> 2").withColumn("text", F.lit("audit")), key=["conv_id", "turn"], order="turn", state=state).drop("content_hash")


@query("SELECT doc_id AS id, lang AS title FROM documents WHERE doc_id % 9 <> 0")
def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with an id, by creation."""
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("title"), (-F.col("doc_id")).alias("created_at"))
    return files.library(rows).select(F.col("id").cast("long").alias("id"), "title")


@query("SELECT doc_id, paragraphs, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INT AS idx FROM (SELECT doc_id, lang, length(text) AS paragraphs FROM documents WHERE doc_id % 4 <> 1)")
def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored records without the bad ones, counted anew."""
    bad = F.col("doc_id") % 4 == 1
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", F.when(~bad, F.col("doc_id").cast("string")).alias("title"), F.when(~bad, F.array("text")).alias("paragraphs"))
    found = segment.from_records(rows, key=["lang"], order="doc_id")
    return found.select(F.col("title").cast("long").alias("doc_id"), F.length(F.get("paragraphs", F.lit(0))).cast("long").alias("paragraphs"), "idx")


@query("""WITH u AS (SELECT source AS work_id, doc_id, CASE WHEN strlen(coalesce(text, '')) = 0 THEN 'empty' WHEN strlen(text) > 8000 THEN 'too-large' END AS r FROM documents),
n AS (SELECT *, count(*) FILTER (r IS NULL) OVER (PARTITION BY work_id ORDER BY doc_id) AS k FROM u) SELECT doc_id, CASE WHEN r IS NULL AND k + 20 > 60 THEN 'too-many-pages' ELSE r END AS refused FROM n""")
def intake_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads refused for their size or because the work is full."""
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("work_id"), F.col("doc_id").alias("arrival"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    there = rows.select("work_id").distinct().withColumn("pages", F.lit(20))
    return intake.check_pages(rows, there, most_bytes=8000, most_pages=60).select(F.col("arrival").alias("doc_id"), "refused")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN 'unknown-kind' WHEN doc_id % 3 = 2 THEN 'unknown-ingest' WHEN doc_id % 4 = 0 AND doc_id % 3 = 0 THEN 'manga-needs-images' END AS refused, CASE WHEN coalesce(strlen(text), 0) = 0 THEN 'empty' WHEN strlen(text) > 20971520 THEN 'too-large' END AS refused_text FROM documents""")
def intake_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works refused for what they are, and texts for their size."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(d % 4 == 3, "poem").when(d % 4 == 0, "manga").otherwise("novel").alias("kind"), F.when(d % 3 == 2, "fax").when(d % 3 == 0, "text").otherwise("images").alias("ingest"))
    works = intake.check_works(rows).drop("kind", "ingest")
    return intake.check_texts(works.withColumnRenamed("refused", "r")).select("doc_id", F.col("r").alias("refused"), F.col("refused").alias("refused_text"))


@query("SELECT conv_id, turn AS version FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 2")
def previous_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.previous_version(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("version")), key=["conv_id"])


@query("SELECT event_id, (props::JSON->>'k')::INT AS k FROM events WHERE event_id % 10 <> 3")
def parsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that parse (S13); one in ten is cut off."""
    raw = F.when(F.col("event_id") % 10 == 3, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    good, _ = files.parse_or_quarantine(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "k int")
    return good.select("event_id", "record.k")


@query("SELECT DISTINCT sha256(left(props, length(props) - 1)) AS hash, left(props, length(props) - 1) AS raw FROM events WHERE event_id % 10 = 3")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does not parse, kept under its hash."""
    raw = F.when(F.col("event_id") % 10 == 3, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return files.parse_or_quarantine(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "k int")[1]


@query("SELECT CASE doc_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-bom' ELSE CASE WHEN regexp_matches(text, '[^\\x00-\\x7f]') THEN 'other' ELSE 'utf-8' END END AS encoding, count(*) AS files, sum(length(text)) FILTER (doc_id % 3 <> 2)::BIGINT AS chars FROM documents GROUP BY ALL")
def encoding_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by encoding (S6): texts as UTF-8, with a mark, and in a one-byte encoding."""
    k = F.col("doc_id") % 3
    data = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "é"), "ISO-8859-1"))
    found = files.decoded(table(spark, sf_dir, "documents").select("doc_id", data.alias("content")))
    name = F.when(F.col("encoding").isin("utf-8", "utf-8-bom"), F.col("encoding")).otherwise("other")
    return found.groupBy(name.alias("encoding")).agg(F.count("*").alias("files"), F.sum(F.when(k != 2, F.length("text"))).alias("chars"))


@query(
    """SELECT conv_id, (turn + 1)::INT AS idx, CASE WHEN turn % 3 = 0 THEN 'Chapter ' || (turn + 1) ELSE role END AS title, [' ' || text, 'cell ' || turn, 'inner', 'child', 'grandchild', 'leaf'] AS paragraphs FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, regexp_replace(text, '[\\s]', '_', 'g') AS text FROM conversations)"""
)
def flatten_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported documents with tabs, tables and child tabs to chapters."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = table(spark, sf_dir, "conversations").select("conv_id", place.alias("turn"), "role", F.regexp_replace("text", r"[\s]", "_").alias("text"))
    run = lambda c: F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("textRun"))).alias("elements"))
    para = lambda c: F.to_json(F.struct(run(c).alias("paragraph")))
    inner = F.concat(F.lit('{"table":{"tableRows":[{"tableCells":[{"content":['), para(F.lit("inner")), F.lit("]}]}]}}"))
    cell = F.concat(F.lit('{"table":{"tableRows":[{"tableCells":[{"content":['), para(F.concat(F.lit("cell "), F.col("turn").cast("string"))), F.lit(","), inner, F.lit("]}]}]}}"))
    body = F.concat(F.lit('"documentTab":{"body":{"content":['), F.concat_ws(",", para(F.concat(F.lit(" "), F.col("text"), F.lit("\n"))), cell, para(F.lit(" "))), F.lit("]}}"))
    child = F.lit("")
    for name in ("leaf", "grandchild", "child"):
        child = F.concat(F.lit('"childTabs":[{"documentTab":{"body":{"content":['), para(F.lit(name)), F.lit("]}}"), F.when(child != "", F.concat(F.lit(","), child)).otherwise(""), F.lit("}]"))
    tab = F.concat(F.lit('{"tabProperties":{"title":"'), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")), F.lit('"},'), body, F.lit(","), child, F.lit("}"))
    tabs = rows.select("conv_id", "turn", tab.alias("t")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda s: s["t"]), ",").alias("tabs"))
    raw = F.concat(F.lit('{"title":"Export '), F.col("conv_id").cast("string"), F.lit('","tabs":['), "tabs", F.lit("]}"))
    return files.flatten_documents(tabs.select("conv_id", raw.alias("raw")), key=["conv_id"])


IMAGE_SQL = """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars * 37 % 260000 ELSE n_chars % 60000 END AS w, doc_id % 999 + 1 AS h FROM documents)
SELECT doc_id, ['png', 'gif', 'jpeg', 'pdf', 'unknown'][doc_id % 5 + 1] AS kind, CASE WHEN doc_id % 5 > 2 OR w > 200000 THEN 0 ELSE w END AS width, CASE WHEN doc_id % 5 > 2 OR w > 200000 OR w = 0 THEN 0 ELSE h END AS height,
  CASE WHEN doc_id % 5 IN (0, 2) THEN NULL WHEN doc_id % 5 = 3 THEN 'not-an-image' ELSE 'unsupported' END AS refused FROM d"""


def images_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose headers carry the sizes of documents; a JPEG's comes after the document's text in long segments."""
    d = F.col("doc_id")
    w, h = F.when(d % 5 == 0, F.col("n_chars") * 37 % 260_000).otherwise(F.col("n_chars") % 60_000), d % 999 + 1
    be = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    le = lambda c: F.concat(F.substring(be(c, 2), 3, 2), F.substring(be(c, 2), 1, 2))
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), be(w, 4), be(h, 4))
    text = F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    parts = F.sequence(F.lit(0), F.expr("octet_length(coalesce(text, '')) div 60000"))
    notes = F.array_join(F.transform(parts, lambda k: F.concat(F.lit("FFFE"), be(F.octet_length(F.unhex(F.substring(text, k * 120_000 + 1, F.lit(120_000)))) + 2, 2), F.substring(text, k * 120_000 + 1, F.lit(120_000)))), "")
    jpeg = F.concat(F.lit("FFD8"), notes, F.lit("FFC0000B08"), be(h, 2), be(w, 2), F.lit("03000000"))
    raw = F.element_at(F.array(png, F.concat(F.lit("474946383961"), le(w), le(h)), jpeg, F.lit("255044462D312E34"), F.lit("00010203")), (d % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.unhex(raw).alias("content"))


@query(IMAGE_SQL)
def image_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds and sizes from image headers."""
    return files.image_inventory(images_of(spark, sf_dir), "doc_id")


@query(IMAGE_SQL)
def image_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from images in files, of which only what says their size is read."""
    packed = settled(files.pack(images_of(spark, sf_dir), f"{shared_folder(spark).rstrip('/')}/images-{uuid.uuid4().hex}", "doc_id"))
    return files.image_inventory(files.image_heads(packed, "doc_id").drop("bytes_read"), "doc_id")

