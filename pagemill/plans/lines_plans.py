"""Reconciliation queries; a page is ten `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import lines, regions
from .corpus import STRIP
from .registry import query, table

def words(d: F.Column) -> F.Column:
    """A region's words: the whole text of six documents in ten; the others say only their language, so that pages hold equal words."""
    own = F.nullif(strip(F.coalesce("text", F.lit(""))), F.lit(""))
    return F.when(d % 10 < 6, F.coalesce(own, "lang")).otherwise(F.col("lang"))


WORDS_SQL = f"CASE WHEN doc_id % 10 < 6 THEN coalesce(nullif({STRIP % "coalesce(text, '')"}, ''), lang) ELSE lang END"
KINDS = ("bubble", "body", "sfx", "furigana", "running-head", "odd")


def regions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's new reading: ids have moved by one against the lines' reading."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.floor(d / 10).cast("long").alias("page_id"), (d % 10).cast("int").alias("list_pos"), F.concat(F.lit("r"), ((d + 1) % 10).cast("string")).alias("region_id"), F.concat(F.lit(" "), words(d)).alias("text"),
        F.element_at(F.array(*map(F.lit, KINDS)), (d % len(KINDS) + 1).cast("int")).alias("kind"), ((d * 7) % 10).cast("int").alias("ord"), ((d % 4) / 4.0).alias("x"), F.lit(0.1).alias("y"), F.when(d % 5 == 0, 0.0).otherwise(0.2).alias("w"), F.lit(0.2).alias("h"),
    )


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    stored = F.when(d % 9 == 0, None).when(d % 7 == 0, F.sha2(F.lit("gone"), 256)).otherwise(F.sha2(words(d), 256))
    return table(spark, sf_dir, "documents").filter(d % 4 != 0).select(
        F.floor(d / 10).cast("long").alias("page_id"), F.concat(F.lit("r"), (d % 10).cast("string")).alias("region_id"), ((d * 3) % 10).cast("int").alias("stored_pos"),
        F.when(d % 11 == 0, " ").otherwise(F.concat(F.lit("en "), d.cast("string"))).alias("english"), stored.alias("source_hash"), F.when(d % 3 == 0, "user").otherwise("model").alias("english_source"),
        F.concat(F.lit("s"), (d % 5).cast("string")).alias("speaker"), F.when(d % 5 == 0, "user").otherwise("model").alias("speaker_source"),
    )


BASE_SQL = f"""regions AS (SELECT doc_id // 10 AS page_id, (doc_id % 10)::INT AS list_pos, 'r' || ((doc_id + 1) % 10) AS region_id, {WORDS_SQL} AS text, {list(KINDS)}[doc_id % {len(KINDS)} + 1] AS kind, (doc_id * 7 % 10)::INT AS ord, CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE 0.2 END AS w FROM documents),
lines AS (SELECT doc_id // 10 AS page_id, 'r' || (doc_id % 10) AS region_id, (doc_id * 3 % 10)::INT AS stored_pos, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE 'en ' || doc_id END AS english, CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN sha256('gone') ELSE sha256({WORDS_SQL}) END AS source_hash,
  CASE WHEN doc_id % 3 = 0 THEN 'user' ELSE 'model' END AS english_source, 's' || (doc_id % 5) AS speaker, CASE WHEN doc_id % 5 = 0 THEN 'user' ELSE 'model' END AS speaker_source FROM documents WHERE doc_id % 4 <> 0)"""
FRESH_SQL = f"""{BASE_SQL}, fresh AS (SELECT r.*, CASE WHEN trim(coalesce(english, '')) = '' THEN 'untranslated' WHEN coalesce(source_hash = sha256(text), FALSE) THEN 'translated' ELSE 'stale' END AS state FROM regions r LEFT JOIN lines USING (page_id, region_id) WHERE kind IN {regions.TRANSLATED}),
counts AS (SELECT page_id, coalesce(n, 0) AS lines, coalesce(translated, 0) AS translated, coalesce(stale, 0) AS stale, coalesce(untranslated, 0) AS untranslated, coalesce(undrawable, 0) AS undrawable, coalesce(other, 0) AS other FROM (SELECT DISTINCT page_id FROM regions)
  LEFT JOIN (SELECT page_id, count(*) AS n, count(*) FILTER (state = 'translated') AS translated, count(*) FILTER (state = 'stale') AS stale, count(*) FILTER (state = 'untranslated') AS untranslated, count(*) FILTER (w <= 0) AS undrawable FROM fresh GROUP BY page_id) USING (page_id)
  LEFT JOIN (SELECT page_id, count(*) AS other FROM regions WHERE kind = 'odd' GROUP BY page_id) USING (page_id))"""


@query(f"WITH {FRESH_SQL} SELECT page_id, region_id, state FROM fresh")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.freshness(regions_of(spark, sf_dir), lines_of(spark, sf_dir)).select("page_id", "region_id", "state")


@query(f"WITH {FRESH_SQL} SELECT * FROM counts")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_counts(regions_of(spark, sf_dir), lines_of(spark, sf_dir))


@query(
    f"""WITH {FRESH_SQL} SELECT page_id // 6 AS work_id, (page_id % 2)::INT AS idx, sum(lines)::BIGINT AS lines, sum(translated)::BIGINT AS translated, sum(stale)::BIGINT AS stale, sum(untranslated)::BIGINT AS untranslated, sum(undrawable)::BIGINT AS undrawable, sum(other)::BIGINT AS other,
  count(*) AS pages, count(*) FILTER (page_id % 3 = 0) AS unchecked_pages, count(*) FILTER (page_id % 4 = 0) AS unmeasured_pages, count(*) FILTER (lines = 0 AND other = 0) AS silent_pages FROM counts GROUP BY ALL"""
)
def chapter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions_of(spark, sf_dir)
    pages = rows.select("page_id").distinct()
    members = pages.select(F.floor(F.col("page_id") / 6).cast("long").alias("work_id"), (F.col("page_id") % 2).cast("int").alias("idx"), "page_id")
    records = pages.select("page_id", F.when(F.col("page_id") % 3 == 0, "needs-check").otherwise("ok").alias("status"), F.when(F.col("page_id") % 4 == 0, 0).otherwise(9).alias("width"), F.lit(9).alias("height"))
    return lines.chapter_counts(members, records, lines.line_counts(rows, lines_of(spark, sf_dir)))


CARRY_SQL = f"""{BASE_SQL}, own AS (SELECT page_id, region_id, sha256(text) AS h, ord, list_pos FROM regions),
first AS (SELECT l.page_id, l.region_id, l.region_id AS from_id, english FROM lines l JOIN own o ON l.page_id = o.page_id AND l.region_id = o.region_id AND l.source_hash = o.h),
waiting AS (SELECT * FROM lines l WHERE NOT EXISTS (FROM first f WHERE f.page_id = l.page_id AND f.region_id = l.region_id)),
places AS (SELECT *, row_number() OVER (PARTITION BY page_id, h ORDER BY ord, list_pos) AS k FROM own o WHERE NOT EXISTS (FROM first f WHERE f.page_id = o.page_id AND f.region_id = o.region_id)),
queue AS (SELECT *, row_number() OVER (PARTITION BY page_id, source_hash ORDER BY stored_pos) AS k FROM waiting WHERE source_hash IS NOT NULL),
moved AS (SELECT q.page_id, p.region_id, q.region_id AS from_id, english FROM queue q JOIN places p ON p.page_id = q.page_id AND p.h = q.source_hash AND p.k = q.k),
settled AS (FROM first UNION ALL FROM moved),
stranded AS (SELECT page_id, region_id, region_id AS from_id, english FROM waiting w WHERE NOT EXISTS (FROM moved m WHERE m.page_id = w.page_id AND m.from_id = w.region_id) AND NOT EXISTS (FROM settled s WHERE s.page_id = w.page_id AND s.region_id = w.region_id))"""


@query(f"WITH {CARRY_SQL} FROM settled UNION ALL FROM stranded")
def carry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines carried to a new reading of their pages."""
    return lines.carry(regions_of(spark, sf_dir), lines_of(spark, sf_dir)).select("page_id", "region_id", "from_id", "english")


@query(
    f"""WITH {BASE_SQL}, inc AS (SELECT page_id, region_id, 'new ' || list_pos AS english, sha256(text) AS source_hash, 'model' AS english_source, 'x' AS speaker, 'model' AS speaker_source FROM regions WHERE list_pos % 2 = 0)
SELECT page_id, region_id, CASE WHEN l.english_source = 'user' OR i.english IS NULL THEN l.english ELSE i.english END AS english, CASE WHEN l.english_source = 'user' OR i.english IS NULL THEN l.source_hash ELSE i.source_hash END AS source_hash,
  CASE WHEN l.english_source = 'user' OR i.english IS NULL THEN l.english_source ELSE 'model' END AS english_source, CASE WHEN l.speaker_source = 'user' OR i.english IS NULL THEN l.speaker ELSE 'x' END AS speaker, CASE WHEN l.speaker_source = 'user' OR i.english IS NULL THEN l.speaker_source ELSE 'model' END AS speaker_source
FROM lines l FULL JOIN inc i USING (page_id, region_id)"""
)
def human_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = regions_of(spark, sf_dir).filter("list_pos % 2 = 0").select("page_id", "region_id", F.concat(F.lit("new "), F.col("list_pos").cast("string")).alias("english"), lines.region_hash(F.col("text")).alias("source_hash"), F.lit("model").alias("english_source"), F.lit("x").alias("speaker"), F.lit("model").alias("speaker_source"))
    return lines.merge_machine(lines_of(spark, sf_dir), new)


@query("SELECT doc_id AS page_id, CASE WHEN toxic = 1 THEN 'skipped' WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'reading' END AS status FROM documents LEFT JOIN labels USING (doc_id)")
def late_skip_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read results against pages that a person skipped meanwhile."""
    now = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("page_id"), F.when(F.col("toxic") == 1, "skipped").otherwise("reading").alias("status"))
    return lines.merge_pages(now, now.filter("page_id % 2 = 0").select("page_id", F.lit("ok").alias("status")))


CORRECTED_SQL = f"""{BASE_SQL}, c AS (SELECT page_id, region_id, CASE WHEN list_pos % 4 = 0 THEN 'gone' ELSE text || ' ' END AS f, CASE WHEN list_pos % 3 = 0 THEN '- 12 -' ELSE 'right' END AS t FROM regions WHERE list_pos % 2 = 0)"""


def _corrections(rows: DataFrame) -> DataFrame:
    return rows.filter("list_pos % 2 = 0").select("page_id", "region_id", F.when(F.col("list_pos") % 4 == 0, "gone").otherwise(F.concat("text", F.lit(" "))).alias("from_text"), F.when(F.col("list_pos") % 3 == 0, "- 12 -").otherwise("right").alias("to_text"))


@query(f"WITH {CORRECTED_SQL} SELECT page_id, region_id, CASE WHEN ok THEN t ELSE ' ' || text END AS text, CASE WHEN ok AND kind <> 'running-head' AND t = '- 12 -' THEN 'page-number' ELSE kind END AS kind, ok AS corrected FROM (SELECT r.*, t, coalesce(trim(f) = text, FALSE) AS ok FROM regions r LEFT JOIN c USING (page_id, region_id))")
def guarded_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections laid over a reading only where it still says what was corrected."""
    rows = regions_of(spark, sf_dir)
    return lines.apply_corrections(rows, _corrections(rows))[0].select("page_id", "region_id", "text", "kind", "corrected")


@query(f"WITH {CORRECTED_SQL} SELECT c.page_id, c.region_id FROM c LEFT JOIN regions r USING (page_id, region_id) WHERE trim(f) <> text")
def lost_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions_of(spark, sf_dir)
    return lines.apply_corrections(rows, _corrections(rows))[1]


@query(
    f"""WITH {BASE_SQL}, stored AS (SELECT page_id, region_id, text AS f, 'right' AS t FROM regions WHERE list_pos % 2 = 0), d AS (SELECT page_id, region_id, text AS o, CASE WHEN list_pos % 4 = 0 THEN text ELSE 'better' END AS t FROM regions WHERE list_pos % 4 <> 2)
SELECT page_id, region_id, CASE WHEN d.t IS NULL THEN s.f ELSE ' ' || d.o END AS from_text, coalesce(d.t, s.t) AS to_text, CASE WHEN d.t IS NOT NULL AND d.t IS DISTINCT FROM s.t THEN 2 ELSE 1 END AS "at" FROM stored s FULL JOIN d USING (page_id, region_id) WHERE NOT coalesce(d.t = d.o, FALSE)"""
)
def set_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections made, changed and taken back."""
    rows = regions_of(spark, sf_dir)
    stored = rows.filter("list_pos % 2 = 0").select("page_id", "region_id", F.trim("text").alias("from_text"), F.lit("right").alias("to_text"), F.lit(1).alias("at"))
    asked = rows.filter("list_pos % 4 <> 2").select("page_id", "region_id", F.when(F.col("list_pos") % 4 == 0, F.trim("text")).otherwise("better").alias("to_text"))
    return lines.set_corrections(stored, asked, rows, F.lit(2))


@query(
    f"""WITH {BASE_SQL}, asked AS (SELECT page_id, region_id, text, row_number() OVER (PARTITION BY page_id ORDER BY -list_pos)::INT - 1 AS rank FROM regions WHERE page_id % 3 <> 2),
a AS (SELECT *, row_number() OVER (PARTITION BY page_id, text ORDER BY rank) AS k FROM asked), t AS (SELECT *, row_number() OVER (PARTITION BY page_id, text ORDER BY list_pos) AS k FROM regions)
SELECT t.page_id, t.region_id, CASE WHEN t.page_id % 2 = 0 THEN coalesce(o.rank, t.ord) ELSE coalesce(a.rank, t.ord) END AS ord FROM t LEFT JOIN a USING (page_id, text, k) LEFT JOIN asked o ON o.page_id = t.page_id AND o.region_id = t.region_id"""
)
def saved_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved reading order found again by words (J9); on every second page the ids still hold, elsewhere equal words go in order."""
    from pyspark.sql import Window

    rows = regions_of(spark, sf_dir)
    hint = F.when(F.col("page_id") % 2 == 0, F.col("region_id")).otherwise("stale")
    saved = rows.filter("page_id % 3 <> 2").select("page_id", (F.row_number().over(Window.partitionBy("page_id").orderBy(-F.col("list_pos"))) - 1).alias("rank"), "text", hint.alias("region_id_hint"))
    return lines.apply_order(rows, saved)[0].select("page_id", "region_id", "ord")


HEADED_SQL = f"""{CORRECTED_SQL}, h AS (SELECT page_id, text, list_pos, t FROM regions LEFT JOIN c USING (page_id, region_id) WHERE list_pos = 2)"""


@query(f"WITH {HEADED_SQL} SELECT page_id, CASE WHEN page_id % 2 = 0 THEN t ELSE 'other' END AS heading FROM h")
def corrected_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's heading follows the correction of the region that says it."""
    rows = regions_of(spark, sf_dir).withColumn("kind", F.when(F.col("list_pos") == 2, "heading").otherwise(F.col("kind")))
    meta = rows.filter("list_pos = 2").select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("text")).otherwise("other").alias("heading"))
    marked, _ = lines.apply_corrections(rows, _corrections(rows))
    return lines.correct_headings(meta, marked)


@query(
    f"""WITH {BASE_SQL}, asked AS (SELECT page_id, region_id, text, list_pos, CASE WHEN page_id % 5 = 0 THEN 'in-flight' WHEN page_id % 7 = 0 THEN 'not-read' WHEN list_pos = 3 THEN 'no-region' END AS why FROM regions WHERE list_pos IN (1, 3)),
real AS (SELECT page_id, bool_or(page_id % 2 = 0) AS r FROM asked WHERE why IS NULL GROUP BY page_id)
SELECT page_id, CASE WHEN coalesce(r, FALSE) AND page_id % 11 <> 0 THEN 'edited' WHEN page_id % 11 = 0 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN coalesce(r, FALSE) THEN 2 ELSE 1 END AS corrected_at,
  (SELECT count(*) FROM asked a WHERE a.page_id = p.page_id AND why IS NOT NULL) AS refused FROM (SELECT DISTINCT page_id FROM regions) p LEFT JOIN real USING (page_id)"""
)
def corrected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after a person's corrections (J11): some refused, some only the machine's own words again, which approve nothing."""
    rows = regions_of(spark, sf_dir)
    k = F.col("page_id")
    pages = rows.select("page_id").distinct().select("page_id", F.when(k % 11 == 0, "skipped").otherwise("ok").alias("status"), (k % 7 != 0).alias("has_read"), F.lit(1).alias("corrected_at"))
    asked = rows.filter("list_pos in (1, 3)").select("page_id", F.when(F.col("list_pos") == 3, "gone").otherwise(F.col("region_id")).alias("region_id"), F.when(k % 2 == 0, "better").otherwise(F.col("text")).alias("to_text"))
    stored = rows.filter("false").select("page_id", "region_id", F.col("text").alias("from_text"), F.col("text").alias("to_text"), F.lit(1).alias("at"))
    _, after, refused = lines.correct_pages(pages, stored, asked, rows, pages.filter("page_id % 5 = 0").select("page_id"), F.lit(2))
    counted = refused.groupBy("page_id").agg(F.count("*").alias("refused"))
    return after.drop("has_read").join(counted, "page_id", "left").withColumn("refused", F.coalesce("refused", F.lit(0)).cast("long"))


@query("SELECT doc_id AS page_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 3 = 1 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 <> 1 THEN 'why' END AS error FROM documents")
def rested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed work rests only the worker's own marks; its reason is kept except on a skipped page."""
    d = F.col("doc_id")
    pages = table(spark, sf_dir, "documents").select(d.alias("page_id"), F.when(d % 3 == 0, "reading").when(d % 3 == 1, "skipped").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("error"))
    return lines.rest_pages(pages, pages.select("page_id", F.lit("new").alias("status"), F.when(F.col("page_id") % 2 == 0, "why").alias("error")))


@query(f"WITH {FRESH_SQL}, per AS (SELECT page_id // 6 AS work_id, sum(untranslated) AS u FROM counts GROUP BY 1) SELECT work_id, u > 0 AS due FROM per")
def needs_translating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with a line without English, whatever their status says."""
    counts = lines.line_counts(regions_of(spark, sf_dir), lines_of(spark, sf_dir)).groupBy(F.floor(F.col("page_id") / 6).cast("long").alias("work_id")).agg(F.sum("untranslated").alias("untranslated"))
    return lines.needs_translating(counts).select("work_id", "due")


@query("SELECT page_id, CASE WHEN d IS NULL OR d = 'failed' THEN 'ok' WHEN d = 'new' AND page_id % 2 = 0 THEN 'needs-check' ELSE d END AS status FROM (SELECT doc_id AS page_id, CASE doc_id % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'skipped' WHEN 2 THEN 'failed' WHEN 3 THEN 'edited' END AS d FROM documents)")
def page_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person decided about pages; unknown words are refused."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents")
    pages = rows.select(d.alias("page_id"), F.lit("ok").alias("status"), (d % 2 == 0).alias("has_read"))
    said = rows.filter(d % 5 < 4).select(d.alias("page_id"), F.element_at(F.array(*map(F.lit, ("new", "skipped", "failed", "edited"))), (d % 5 + 1).cast("int")).alias("status"))
    return lines.decide_pages(pages, said)[0].drop("has_read")


@query(f"WITH {BASE_SQL}, e AS (SELECT page_id, region_id, 'mine' AS english FROM regions WHERE list_pos = 3) SELECT l.page_id, l.region_id, coalesce(e.english, l.english) AS english, CASE WHEN e.english IS NULL THEN l.source_hash ELSE sha256(r.text) END AS source_hash, CASE WHEN e.english IS NULL THEN l.english_source ELSE 'user' END AS english_source FROM (SELECT page_id, region_id, l0.english, source_hash, english_source FROM lines l0 FULL JOIN e USING (page_id, region_id)) l LEFT JOIN e ON e.page_id = l.page_id AND e.region_id = l.region_id LEFT JOIN regions r ON r.page_id = l.page_id AND r.region_id = l.region_id")
def edit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's English for a line, stamped with the words on the page now."""
    rows = regions_of(spark, sf_dir)
    edits = rows.filter("list_pos = 3").select("page_id", "region_id", F.lit("mine").alias("english"))
    return lines.edit_lines(lines_of(spark, sf_dir), edits, rows).select("page_id", "region_id", "english", "source_hash", "english_source")


@query(
    """WITH c AS (SELECT user_id, max(ts) AS corrected_at FROM events WHERE event_type = 'click' GROUP BY user_id), b AS (SELECT user_id, max(ts) AS built_at FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT user_id AS work_id, corrected_at, built_at FROM c JOIN b USING (user_id) WHERE corrected_at > built_at"""
)
def rebuild_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with a correction after their last build."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("work_id")).agg(F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("corrected_at"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("built_at"))
    return e.filter(F.col("corrected_at") > F.col("built_at"))
