"""Segmentation, metrics, classification and remaining work over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import incremental, metrics, segment
from ..operators.ranks import settled
from .registry import query, table

#: The tables have no Japanese and no blank lines, so classes and separators are parameters here.
ACCENTED = r"\x{df}-\x{f6}\x{f8}-\x{ff}"
ONE_WORD = r"[^ \n]{1,20}\."
MARKER = rf"{ONE_WORD}|All rights reserved\."
LINE = r"\n"
MIN_FRACTION = 0.02

STRIP = rf"regexp_replace(%s, '\A[{T.SPACE}]+|[{T.SPACE}]+\z', '', 'g')"
PARAS = f"list_filter(list_transform(string_split(regexp_replace(%s, '[{T.INVISIBLE}]', '', 'g'), chr(10)), lambda p: {STRIP % 'p'}), lambda p: p <> '')"
NONSPACE = f"length(regexp_replace(%s, '[{T.SPACE}]+', '', 'g'))"


def chapters_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.by_separator(table(spark, sf_dir, "documents"), key=["doc_id"], marker=MARKER, between=LINE)


HEAD = STRIP % "split_part(ltrim(b, chr(10)), chr(10), 1)"
REST = "regexp_replace(ltrim(b, chr(10)), '\\A[^\\n]*\\n?', '')"
CHAPTERS_SQL = f"""
blocks AS (
  SELECT doc_id, t, b, bi FROM (SELECT doc_id, t, unnest(bs) AS b, generate_subscripts(bs, 1) AS bi FROM (
    SELECT doc_id, t, string_split_regex(t, '(?m)^[ \\t\\x{{3000}}]*(?:{MARKER}|{segment.RULE_LINE})[ \\t\\x{{3000}}]*$') AS bs
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS t FROM documents)))
), titled AS (
  SELECT *, {HEAD} AS head, {REST} AS rest FROM blocks
), drafts AS (
  SELECT doc_id, t, bi, CASE WHEN ok THEN head END AS title, {PARAS % "CASE WHEN ok THEN rest ELSE b END"} AS paragraphs FROM (
    SELECT *, regexp_matches(rest, '[^{T.SPACE}]') AND head <> '' AND length(head) <= {segment.LONGEST_TITLE}
      AND NOT regexp_matches(head, '{T.SENTENCE_END}') AND length(head) <= {segment.SHORT_TITLE} AS ok FROM titled)
), kept AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY bi) AS idx, title, paragraphs FROM drafts WHERE len(paragraphs) > 0
), chapters AS (
  SELECT doc_id, idx::INT AS idx, coalesce(title, 'Chapter ' || idx) AS title, paragraphs FROM kept
  UNION ALL SELECT doc_id, 1, 'Chapter 1', p FROM (SELECT DISTINCT doc_id, {PARAS % "t"} AS p FROM blocks WHERE doc_id NOT IN (SELECT doc_id FROM kept)) WHERE len(p) > 0
)"""


@query(f"WITH {CHAPTERS_SQL} SELECT doc_id, idx, title, len(paragraphs)::BIGINT AS n, sha256(array_to_string(paragraphs, chr(10))) AS body FROM chapters")
def segment_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters_of(spark, sf_dir).select("doc_id", "idx", "title", F.size("paragraphs").cast("long").alias("n"), F.sha2(F.array_join("paragraphs", "\n"), 256).alias("body"))


@query(
    f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), marked AS (
  SELECT *, regexp_full_match(line, '{ONE_WORD}')::INT AS head, {STRIP % f"regexp_replace(line, '[{T.INVISIBLE}]', '', 'g')"} AS body FROM lines
), parts AS (
  SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM marked
), drafts AS (
  SELECT doc_id, part, max(line) FILTER (head = 1) AS title, list(body ORDER BY pos) FILTER (head = 0 AND body <> '') AS paragraphs FROM parts GROUP BY ALL
), made AS (
  SELECT doc_id, title, paragraphs, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS idx FROM drafts WHERE len(paragraphs) > 0
), whole AS (
  SELECT doc_id, NULL AS title, list(body ORDER BY pos) FILTER (body <> '') AS paragraphs, 1 AS idx FROM marked
  WHERE doc_id NOT IN (SELECT doc_id FROM made) GROUP BY doc_id HAVING count(*) FILTER (body <> '') > 0
)
SELECT doc_id, idx::INT AS idx, CASE WHEN coalesce({STRIP % 'title'}, '') = '' THEN 'Chapter ' || idx ELSE {STRIP % 'title'} END AS title,
  len(paragraphs)::BIGINT AS n, sha256(array_to_string(paragraphs, chr(10))) AS body
FROM (FROM made UNION ALL BY NAME FROM whole)
"""
)
def segment_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segment.by_heading(table(spark, sf_dir, "documents"), key=["doc_id"], heading=ONE_WORD, between=LINE)
    return found.select("doc_id", "idx", "title", F.size("paragraphs").cast("long").alias("n"), F.sha2(F.array_join("paragraphs", "\n"), 256).alias("body"))


METRICS_SQL = f"""{CHAPTERS_SQL}, measured AS (
  SELECT doc_id, idx, len(paragraphs)::BIGINT AS paragraph_count, len(list_filter(paragraphs, lambda p: regexp_matches(p, '[{T.QUOTES}]')))::BIGINT AS dialogue_count,
    {NONSPACE % 'joined'}::BIGINT AS char_count,
    round_even(CASE WHEN {NONSPACE % 'joined'} = 0 THEN 0 ELSE len(regexp_extract_all(joined, '[{ACCENTED}]')) / {NONSPACE % 'joined'} END, 4) AS source_fraction,
    sha256(joined) AS content_hash, coalesce(list_max(list_transform(paragraphs, lambda p: length(p))), 0)::BIGINT AS longest_paragraph
  FROM (SELECT *, array_to_string(paragraphs, chr(10) || chr(10)) AS joined FROM chapters)
)"""


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.classify(metrics.chapter_metrics(chapters_of(spark, sf_dir), script=ACCENTED), min_fraction=MIN_FRACTION)


@query(f"WITH {METRICS_SQL} SELECT * FROM measured")
def chapter_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark, sf_dir).drop("title", "paragraphs", "kind")


KIND_SQL = f"{METRICS_SQL}, kinds AS (SELECT *, CASE WHEN paragraph_count = 0 THEN 'empty' WHEN source_fraction < {MIN_FRACTION} THEN 'english' ELSE 'source' END AS kind FROM measured)"


@query(f"WITH {KIND_SQL} SELECT lang, kind, count(*) AS chapters, sum(char_count)::BIGINT AS chars, max(longest_paragraph) AS longest FROM kinds JOIN documents USING (doc_id) GROUP BY ALL")
def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = measured(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang", "kind").agg(F.count("*").alias("chapters"), F.sum("char_count").alias("chars"), F.max("longest_paragraph").alias("longest"))


def state_of(chapters: DataFrame, labels: DataFrame) -> DataFrame:
    """Run state as an earlier run left it: two of three chapters known, one of five edited since, verdicts from labels."""
    known = chapters.select("doc_id", "idx", "content_hash").filter("doc_id % 3 <> 0").join(labels.select("doc_id", "quality"), "doc_id", "left")
    status = F.when(F.col("quality") == 1, "validated").when(F.col("quality") == 0, "needs-review").otherwise("prepared")
    return known.select("doc_id", "idx", status.alias("status"), F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("content_hash", F.lit("old")), 256)).otherwise(F.col("content_hash")).alias("source_hash"))


STATE_SQL = f"""{KIND_SQL}, state AS (
  SELECT k.doc_id, idx, CASE WHEN quality = 1 THEN 'validated' WHEN quality = 0 THEN 'needs-review' ELSE 'prepared' END AS status,
    CASE WHEN k.doc_id % 5 = 0 THEN sha256(content_hash || 'old') ELSE content_hash END AS source_hash
  FROM kinds k LEFT JOIN labels l USING (doc_id) WHERE k.doc_id % 3 <> 0
), seen AS (
  SELECT k.*, coalesce(status, 'pending') AS status, coalesce(source_hash, '') AS source_hash, coalesce(source_hash <> content_hash, FALSE) AS stale FROM kinds k LEFT JOIN state USING (doc_id, idx)
)"""
DONE_SQL = "(status IN ('validated', 'empty', 'english-source') AND source_hash = content_hash)"


def _with_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chapters = settled(measured(spark, sf_dir).drop("title", "paragraphs"))  # numbers and hashes, for the state as well: texts are measured once
    return chapters, state_of(chapters, table(spark, sf_dir, "labels"))


@query(f"WITH {STATE_SQL} SELECT doc_id, idx, char_count, status, stale FROM seen WHERE kind = 'source' AND NOT {DONE_SQL}")
def due_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which chapters still need translating."""
    return incremental.due(*_with_state(spark, sf_dir), ["doc_id", "idx"]).select("doc_id", "idx", "char_count", "status", "stale")


@query(f"WITH {STATE_SQL} SELECT doc_id, idx, status FROM seen WHERE stale")
def stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.with_state(*_with_state(spark, sf_dir), ["doc_id", "idx"]).filter("stale").select("doc_id", "idx", "status")


@query(
    f"""WITH {STATE_SQL} SELECT status, count(*) AS chapters,
  count(*) FILTER (status IN ('prepared', 'translated', 'validated', 'empty', 'english-source') AND source_hash = content_hash) AS prepared,
  count(*) FILTER ({DONE_SQL}) AS translated FROM seen GROUP BY status"""
)
def done_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incremental.with_state(*_with_state(spark, sf_dir), ["doc_id", "idx"])
    done = {k: F.count_if(incremental.is_done(k, F.col("status"), F.coalesce("source_hash", F.lit("")), F.col("content_hash"))) for k in ("prepare", "translate")}
    return rows.groupBy("status").agg(F.count("*").alias("chapters"), done["prepare"].alias("prepared"), done["translate"].alias("translated"))


@query(f"WITH {STATE_SQL} SELECT kind, count(*) AS chapters, count(*) FILTER (kind = 'source' AND NOT {DONE_SQL}) AS remaining, count(*) FILTER (stale) AS stale FROM seen GROUP BY kind")
def corpus_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in the corpus and how much of it is still to do."""
    rows = incremental.with_state(*_with_state(spark, sf_dir), ["doc_id", "idx"])
    done = incremental.is_done("translate", F.col("status"), F.coalesce("source_hash", F.lit("")), F.col("content_hash"))
    return rows.groupBy("kind").agg(F.count("*").alias("chapters"), F.count_if((F.col("kind") == "source") & ~done).alias("remaining"), F.count_if("stale").alias("stale"))


@query(
    f"""WITH {KIND_SQL}, before AS (SELECT doc_id, idx AS idx, content_hash FROM kinds),
after AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx)::INT AS idx, content_hash FROM kinds WHERE idx <> 2)
SELECT after.doc_id, after.idx, before.content_hash <> after.content_hash AS stale FROM after JOIN before USING (doc_id, idx)"""
)
def replace_source_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source replaced without its second chapter: chapters are their positions, so the later ones are stale."""
    chapters = measured(spark, sf_dir)
    before = chapters.select("doc_id", "idx", "content_hash")
    kept = chapters.filter("idx <> 2").select("doc_id", "idx", "title", "paragraphs")
    again = segment.from_records(kept.withColumnRenamed("idx", "old"), key=["doc_id"], order="old")
    after = metrics.chapter_metrics(again, script=ACCENTED).select("doc_id", "idx", "content_hash")
    stored = before.select("doc_id", "idx", F.lit("prepared").alias("status"), F.col("content_hash").alias("source_hash"))
    return incremental.with_state(after, stored, ["doc_id", "idx"]).select("doc_id", "idx", "stale")


@query(
    f"""WITH {STATE_SQL}, delta AS (SELECT doc_id, idx, 'validated' AS status, content_hash AS source_hash FROM kinds WHERE doc_id % 4 = 0)
SELECT doc_id, idx, coalesce(d.status, s.status) AS status, coalesce(d.source_hash, s.source_hash) AS source_hash,
  CASE WHEN s.status IS NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS created_at,
  CASE WHEN d.status IS NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS updated_at
FROM state s FULL JOIN delta d USING (doc_id, idx)"""
)
def state_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run's rows laid over the stored state."""
    chapters, state = _with_state(spark, sf_dir)
    old = F.lit("2024-01-01").cast("timestamp")
    state = state.withColumns({"created_at": old, "updated_at": old})
    delta = chapters.filter("doc_id % 4 = 0").select("doc_id", "idx", F.lit("validated").alias("status"), F.col("content_hash").alias("source_hash"))
    return incremental.overlay(state, delta, keys=["doc_id", "idx"], now=F.lit("2024-02-01").cast("timestamp"))
