"""Seams, assembly and manifests; `conversations` are page sequences, `documents` page records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import seams
from .corpus import STRIP
from .registry import query, table

ENDS = r"[.!?]\z"
CONTINUES = r"\A[a-zà-ÿ]*[éèñäöü]"


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("turn") % 11 == 5, "  ").otherwise(F.concat("text", F.when(F.col("turn") % 4 == 1, " “").otherwise("")))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("work_id"), F.col("turn").alias("ord"), "role", text.alias("text"), (F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"))
    return rows.select(
        "work_id", "ord", "page_id", (F.col("ord") + 1).alias("seq"), "text", F.when(F.col("role") == "system", F.col("text")).alias("heading"),
        F.when(F.col("ord") % 9 == 7, "skipped").when(F.col("ord") % 5 == 3, "edited").when(F.col("ord") % 13 == 12, "needs-check").otherwise("ok").alias("status"),
        (F.col("page_id") % 7 == 3).alias("ends_mid_word"), (F.length("text") % 3 == 0).alias("ends_mid_sentence"), (F.length("text") % 2 == 0).alias("starts_mid_sentence"),
        F.element_at(F.array(F.lit("sentence"), F.lit("paragraph"), F.lit("chapter"), F.lit("gap"), F.lit("")), (F.col("page_id") % 5 + 1).cast("int")).alias("join_prev"),
        F.when(F.col("page_id") % 2 == 0, "space").otherwise("none").alias("join_glue"),
    )


PAGES_SQL = """p0 AS (SELECT *, conv_id * 1000 + turn AS page_id, CASE WHEN turn % 11 = 5 THEN '  ' ELSE text || CASE WHEN turn % 4 = 1 THEN ' “' ELSE '' END END AS t FROM conversations),
pages_ AS (SELECT conv_id AS work_id, turn AS ord, page_id, turn + 1 AS seq, t AS text, CASE WHEN role = 'system' THEN t END AS heading,
  CASE WHEN turn % 9 = 7 THEN 'skipped' WHEN turn % 5 = 3 THEN 'edited' WHEN turn % 13 = 12 THEN 'needs-check' ELSE 'ok' END AS status,
  page_id % 7 = 3 AS ends_mid_word, length(t) % 3 = 0 AS ends_mid_sentence, length(t) % 2 = 0 AS starts_mid_sentence,
  ['sentence', 'paragraph', 'chapter', 'gap', ''][page_id % 5 + 1] AS join_prev, CASE WHEN page_id % 2 = 0 THEN 'space' ELSE 'none' END AS join_glue FROM p0)"""


SEAM_SQL = f"""{PAGES_SQL}, lagged AS (SELECT *, lag(text) OVER w AS pt, coalesce(lag(ends_mid_word) OVER w, FALSE) AS mw, coalesce(lag(ends_mid_sentence) OVER w, FALSE) AS ms, row_number() OVER w AS n FROM pages_ WHERE status <> 'skipped' WINDOW w AS (PARTITION BY work_id ORDER BY ord)),
said AS (SELECT *, CASE WHEN regexp_matches(coalesce(heading, ''), '[^{T.SPACE}]') THEN 'chapter:0.95:heading' WHEN mw THEN 'sentence:0.95:split-word' WHEN ms AND starts_mid_sentence THEN 'sentence:0.9:open-sentence'
  WHEN regexp_matches(text, '[^{T.SPACE}]') AND right(pt, 1) = '“' THEN 'sentence:0.85:open-quotation' WHEN ms AND regexp_matches(text, '{CONTINUES}') THEN 'sentence:0.6:continuation' WHEN ms THEN 'gap:0.6:fresh-start'
  WHEN regexp_matches(pt, '{ENDS}') THEN 'paragraph:0.75:finished-sentence' ELSE 'paragraph:0.4:no-signal' END AS s FROM lagged)"""


@query(f"WITH {SEAM_SQL} SELECT work_id, page_id, CASE WHEN n > 1 THEN split_part(s, ':', 1) END AS proposed, CASE WHEN n > 1 THEN split_part(s, ':', 2)::DOUBLE END AS confidence, CASE WHEN n > 1 THEN split_part(s, ':', 3) END AS reason FROM said")
def seam_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_of(spark, sf_dir).filter("status <> 'skipped'")
    return seams.propose(pages, ends=ENDS, continues=CONTINUES).select("work_id", "page_id", "proposed", "confidence", "reason")


@query(
    f"""WITH {SEAM_SQL} SELECT p.page_id, CASE WHEN take THEN k ELSE p.join_prev END AS join_prev, CASE WHEN take THEN 'none' ELSE p.join_glue END AS join_glue, CASE WHEN take THEN 'model' ELSE src END AS join_prev_source
FROM (SELECT a.*, CASE WHEN a.page_id % 3 = 0 THEN 'user' ELSE 'model' END AS src, split_part(s, ':', 1) AS k, coalesce(n > 1, FALSE) AND a.page_id % 3 <> 0 AS take FROM pages_ a LEFT JOIN said USING (page_id)) p"""
)
def seam_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals into stored seams; a user's seam stays."""
    pages = pages_of(spark, sf_dir)
    stored = pages.select("page_id", "join_prev", "join_glue", F.when(F.col("page_id") % 3 == 0, "user").otherwise("model").alias("join_prev_source"))
    return seams.merge(stored, seams.propose(pages.filter("status <> 'skipped'"), ends=ENDS, continues=CONTINUES))


BUILT_SQL = f"""{PAGES_SQL}, used AS (SELECT * REPLACE ({STRIP % 'text'} AS text) FROM pages_ WHERE status IN ('ok', 'edited') AND regexp_matches(text, '[^{T.SPACE}]')),
marked AS (SELECT *, row_number() OVER w = 1 AS first, coalesce(nullif(join_prev, ''), 'paragraph') AS j FROM used WINDOW w AS (PARTITION BY work_id ORDER BY ord)),
numbered AS (SELECT *, first OR j = 'chapter' AS begins, sum((first OR j = 'chapter')::INT) OVER (PARTITION BY work_id ORDER BY ord)::INT AS idx FROM marked),
pieces AS (SELECT *, CASE WHEN begins THEN CASE WHEN heading IS NOT NULL THEN heading || chr(10) || chr(10) || text ELSE text END WHEN j = 'sentence' THEN CASE WHEN join_glue = 'space' THEN ' ' ELSE '' END || text ELSE chr(10) || chr(10) || text END AS piece FROM numbered)"""


@query(f"WITH {BUILT_SQL} SELECT work_id, idx, coalesce(max({STRIP % 'heading'}) FILTER (begins), 'Chapter ' || idx) AS title, count(*) AS pages, string_agg(piece, '' ORDER BY ord) AS text FROM pieces GROUP BY work_id, idx")
def build_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seams.chapters(pages_of(spark, sf_dir))[0]


@query(f"WITH {BUILT_SQL} SELECT work_id, page_id, seq FROM pieces WHERE NOT first AND j = 'gap'")
def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seams that say a page may be missing."""
    return seams.chapters(pages_of(spark, sf_dir))[1]


SPAN_SQL = f"""{PAGES_SQL}, kept AS (SELECT *, row_number() OVER w = 1 OR join_prev = 'chapter' AS b FROM pages_ WHERE status <> 'skipped' WINDOW w AS (PARTITION BY work_id ORDER BY ord)),
spanned AS (SELECT *, sum(b::INT) OVER (PARTITION BY work_id ORDER BY ord)::INT AS idx FROM kept),
spans AS (SELECT work_id, idx, coalesce(max(heading) FILTER (b AND regexp_matches(heading, '[^{T.SPACE}]')), 'Chapter ' || idx) AS title, arg_min(seq, ord) AS start_seq, arg_max(seq, ord) AS end_seq, list(page_id ORDER BY ord) AS page_ids FROM spanned GROUP BY work_id, idx)"""


@query(f"WITH {SPAN_SQL} SELECT * FROM spans")
def build_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seams.spans(pages_of(spark, sf_dir))[0]


@query(f"WITH {SPAN_SQL} SELECT work_id, idx, page_id, pages_.ord, pages_.seq FROM (SELECT work_id, idx, unnest(page_ids) AS page_id FROM spans) JOIN pages_ USING (work_id, page_id) WHERE page_id % 6 <> 1")
def span_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each run that were not deleted since."""
    pages = pages_of(spark, sf_dir)
    return seams.members(seams.spans(pages)[0], pages.filter("page_id % 6 <> 1"))


@query(f"WITH {SPAN_SQL} SELECT work_id, idx, page_ids, CASE WHEN work_id % 2 = 0 THEN 'ok' ELSE 'new' END AS status FROM spans")
def carry_chapter_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status kept over a rebuild by the list of pages."""
    runs = seams.spans(pages_of(spark, sf_dir))[0].select("work_id", "idx", "page_ids")
    old = runs.filter("work_id % 2 = 0").withColumn("idx", F.col("idx") + 1).withColumn("status", F.lit("ok"))
    return seams.carry_status(old, runs).select("work_id", "idx", "page_ids", "status")


@query("SELECT conv_id AS work_id, turn AS ord, lag(turn) OVER w AS previous, lead(turn) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def page_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("work_id"), F.col("turn").alias("ord"), F.col("turn").alias("page_id"))
    return seams.neighbours(rows).drop("page_id")


@query(f"""WITH r AS (SELECT conv_id AS page_id, turn AS list_pos, {STRIP % 'text'} AS text, role, CASE WHEN turn % 3 = 0 THEN 'sentence' WHEN turn % 3 = 1 THEN 'paragraph' ELSE '' END AS j, turn % 2 = 0 AS sp FROM conversations WHERE role <> 'system'),
f AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY -list_pos) AS n FROM r WHERE text <> '')
SELECT page_id, string_agg(CASE WHEN n = 1 THEN '' WHEN j = 'sentence' THEN CASE WHEN sp THEN ' ' ELSE '' END ELSE chr(10) || chr(10) END || text, '' ORDER BY n) AS text FROM f GROUP BY page_id""")
def page_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions (here: turns, last first) to page text with their seams."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").cast("int").alias("list_pos"), (-F.col("turn")).alias("ord"), "text", F.when(F.col("role") == "system", "heading").otherwise("body").alias("kind"), F.when(F.col("turn") % 3 == 0, "sentence").when(F.col("turn") % 3 == 1, "paragraph").otherwise("").alias("join_prev"), F.when(F.col("turn") % 2 == 0, "space").otherwise("none").alias("join_glue"))
    return seams.flatten(rows)


RECORD_SQL = "records AS (SELECT source AS work_id, doc_id AS page_id, CASE WHEN toxic = 1 THEN 'skipped' WHEN quality = 1 THEN 'ok' WHEN quality = 0 THEN 'edited' ELSE 'new' END AS status, n_chars AS chars, doc_id % 10 = 0 AS unmeasured, doc_id % 6 = 0 AS looks_reversed, CASE WHEN doc_id % 12 = 0 THEN 'user' ELSE 'model' END AS order_source FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"""WITH {RECORD_SQL}, each AS (SELECT work_id, status, count(*) AS n FROM records GROUP BY ALL)
SELECT work_id, count(*) AS total, (SELECT string_agg(status || '=' || n, ',' ORDER BY status) FROM each e WHERE e.work_id = r.work_id) AS by_status, count(*) FILTER (status IN ('ok', 'edited')) AS ready, count(*) FILTER (unmeasured) AS unmeasured,
  sum(chars)::BIGINT AS chars, count(*) FILTER (looks_reversed AND order_source <> 'user') AS reversed_pages FROM records r GROUP BY work_id""")
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "skipped").when(F.col("quality") == 1, "ok").when(F.col("quality") == 0, "edited").otherwise("new")
    records = rows.select(F.col("source").alias("work_id"), F.col("doc_id").alias("page_id"), status.alias("status"), F.col("n_chars").alias("chars"), (F.col("doc_id") % 10 == 0).alias("unmeasured"), (F.col("doc_id") % 6 == 0).alias("looks_reversed"), F.when(F.col("doc_id") % 12 == 0, "user").otherwise("model").alias("order_source"))
    found = seams.summary(records)
    listed = F.array_join(F.transform(F.map_entries("by_status"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return found.withColumn("by_status", listed)


def _intake(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "documents").select(F.lit("w").alias("work_id"), F.col("doc_id").alias("arrival"), F.sha2("text", 256).alias("sha256"))
    there = rows.filter("arrival % 3 = 0").withColumn("seq", F.col("arrival") + 1)
    return seams.append(there, rows.filter("arrival % 3 <> 0"))


INTAKE_SQL = """r AS (SELECT doc_id AS arrival, sha256(text) AS h FROM documents), there AS (SELECT h, min(arrival + 1) AS seq FROM r WHERE arrival % 3 = 0 GROUP BY h),
inc AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY arrival) AS n FROM r WHERE arrival % 3 <> 0),
fresh AS (SELECT arrival, h, row_number() OVER (ORDER BY arrival) + (SELECT max(arrival + 1) FROM r WHERE arrival % 3 = 0) AS seq FROM inc WHERE n = 1 AND h NOT IN (SELECT h FROM there))"""


@query(f"WITH {INTAKE_SQL} SELECT arrival, seq FROM fresh")
def intake_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New pages with numbers that were never used."""
    return _intake(spark, sf_dir)[0].select("arrival", "seq")


@query(f"WITH {INTAKE_SQL}, every AS (SELECT h, seq FROM there UNION ALL SELECT h, seq FROM fresh) SELECT arrival, every.seq FROM inc JOIN every USING (h) WHERE arrival NOT IN (SELECT arrival FROM fresh)")
def dedup_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates on intake with the page they repeat."""
    return _intake(spark, sf_dir)[1].select("arrival", "seq")


@query("SELECT source AS work_id, lang AS batch, count(*) AS size FROM documents GROUP BY ALL")
def batch_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("work_id"), F.col("lang").alias("batch")).agg(F.count("*").alias("size"))


@query(f"WITH {RECORD_SQL} SELECT work_id, arg_min(page_id, page_id) FILTER (status = 'edited') AS first_to_check FROM records GROUP BY work_id")
def first_to_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each work that waits for a look (L4)."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    wanted = F.coalesce((F.col("quality") == 0) & (F.col("toxic") == 0), F.lit(False))
    return rows.groupBy(F.col("source").alias("work_id")).agg(F.min(F.when(wanted, F.col("doc_id"))).alias("first_to_check"))


@query("SELECT doc_id, n % 2 = 1 AS open FROM (SELECT doc_id, len(regexp_extract_all(text, 'q')) AS n FROM (SELECT doc_id, replace(replace(text, 'qu', 'q'), 'ß', 'q') AS text FROM documents))")
def unclosed_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose last quotation stays open (C4); here every other q opens, the next closes."""
    text = F.replace(F.replace("text", F.lit("qu"), F.lit("q")), F.lit("ß"), F.lit("q"))
    pieces = F.split(text, "q")
    alternating = F.array_join(F.transform(pieces, lambda p, i: F.concat(F.when(i == 0, "").when(i % 2 == 1, "「").otherwise("」"), p)), "")
    return table(spark, sf_dir, "documents").select("doc_id", T.unclosed_quote(alternating).alias("open"))
