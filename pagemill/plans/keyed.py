"""Keyed tables over `events` and `documents`: batches merged one after another, as a stream would."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nonspace_length
from ..operators.ranks import shared_folder
from ..sources.buckets import Buckets, keep_previous, refresh, replace_rows, write_accepted
from ..streaming import events as E
from ..streaming import jobs
from .corpus import NONSPACE
from .registry import query, table
from .work import EVENTS_SQL, events_of

BATCHES = 3


def new_table(spark: SparkSession, name: str, schema: str, key: tuple[str, ...], buckets: int = 8) -> Buckets:
    return Buckets(spark, f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", spark.createDataFrame([], schema).schema, key, buckets)


def batches(rows: DataFrame, by: str) -> list[DataFrame]:
    """Rows in BATCHES parts of about equal ranges of a number."""
    least, most = rows.agg(F.min(by), F.max(by)).first()
    if least is None:
        return [rows]
    step = (most - least) // BATCHES + 1
    return [rows.filter((F.col(by) >= least + k * step) & (F.col(by) < least + (k + 1) * step)) for k in range(BATCHES)]


@query(f"WITH {EVENTS_SQL} SELECT work_id AS page_id, CASE WHEN count(*) FILTER (type = 'failed' AND work_id % 3 = 0) > 0 THEN 'skipped' WHEN count(*) FILTER (type = 'item') > 0 THEN 'ok' ELSE 'reading' END AS status FROM ev GROUP BY work_id")
def late_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after results and decisions came in batches (T-8): a page that a person skipped stays so."""
    rows = events_of(spark, sf_dir)
    pages = new_table(spark, "pages", "page_id long, status string, has_read boolean", ("page_id",))
    replace_rows(pages, rows.select(F.col("work_id").alias("page_id")).distinct().withColumns({"status": F.lit("reading"), "has_read": F.lit(True)}), version=0)
    said = rows.filter("type = 'failed' and work_id % 3 = 0").select(F.col("work_id").alias("page_id"), F.lit("skipped").alias("status"), F.col("event_id").alias("decided"))
    for k, part in enumerate(batches(rows, "event_id")):
        upto = part.agg(F.max("event_id")).first()[0]
        results = part.filter("type = 'item'").select(F.col("work_id").alias("page_id"), F.lit("ok").alias("status"), "event_id")
        jobs.merge_result_batch(pages, results, said.filter(F.col("decided") <= (upto if upto is not None else -1)), version=k + 1)
    return pages.read().select("page_id", "status")


OUTCOMES = ("done", "failed", "rate-limited", "aborted", "refused", "skipped")


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, r AS (SELECT work_id, event_id, {list(OUTCOMES)}[event_id % {len(OUTCOMES)} + 1] AS result, row_number() OVER (PARTITION BY work_id ORDER BY event_id) AS n FROM ev WHERE type IN ('item', 'failed')),
fold AS (SELECT work_id, 0::BIGINT AS n, 'new' AS status FROM (SELECT DISTINCT work_id FROM r) UNION ALL
  SELECT f.work_id, r.n, CASE WHEN result = 'done' THEN 'validated' WHEN status = 'validated' OR result IN ('aborted', 'refused', 'skipped') THEN status WHEN result = 'failed' THEN 'failed' ELSE 'queued' END FROM fold f JOIN r ON r.work_id = f.work_id AND r.n = f.n + 1)
SELECT work_id, arg_max(status, n) AS status FROM fold GROUP BY work_id"""
)
def merged_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items' statuses after their results came in batches, the second one twice (T-10)."""
    pick = F.element_at(F.array(*map(F.lit, OUTCOMES)), (F.col("event_id") % len(OUTCOMES) + 1).cast("int"))
    rows = events_of(spark, sf_dir).filter("type in ('item', 'failed')").select("work_id", "event_id", pick.alias("result"))
    items = new_table(spark, "items", "work_id long, status string, applied long", ("work_id",))
    parts = batches(rows, "event_id")
    for k, part in enumerate([*parts[:2], *parts[1:]]):
        jobs.merge_outcome_batch(items, part, version=k)
    return items.read().select("work_id", "status")


@query(f"WITH {EVENTS_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY work_id, part ORDER BY event_id DESC) AS n FROM (SELECT *, ((event_id - min(event_id) OVER ()) // ((max(event_id) OVER () - min(event_id) OVER ()) // {BATCHES} + 1)) AS part FROM ev)), k AS (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY part DESC) AS r FROM v WHERE n = 1) SELECT work_id, CASE r WHEN 1 THEN 'current' ELSE 'previous' END AS slot, event_id FROM k WHERE r <= 2")
def kept_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each work's record is and what it was before, after several runs."""
    rows = events_of(spark, sf_dir)
    slots = new_table(spark, "slots", "work_id long, slot string, event_id long", ("work_id",))
    for k, part in enumerate(batches(rows, "event_id")):
        keep_previous(slots, part.groupBy("work_id").agg(F.max("event_id").alias("event_id")), version=k)
    return slots.read()


@query("""WITH r AS (SELECT doc_id % 50 AS work_id, doc_id, length(text) % 3 <> 0 AS ok, doc_id % 3 AS run FROM documents WHERE text IS NOT NULL), last AS (SELECT work_id, max(run) AS run FROM r GROUP BY work_id)
SELECT 'audit' AS sink, work_id, doc_id FROM r JOIN last USING (work_id, run) UNION ALL SELECT 'readable', work_id, doc_id FROM r JOIN last USING (work_id, run) WHERE ok""")
def routed_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sinks after three runs (S14): each run replaces its works in both, and only valid rows are readable."""
    rows = table(spark, sf_dir, "documents").filter("text is not null").select((F.col("doc_id") % 50).alias("work_id"), "doc_id", (F.length("text") % 3 != 0).alias("ok"), (F.col("doc_id") % 3).alias("run"))
    schema = "work_id long, doc_id long, ok boolean"
    readable, audit = (new_table(spark, n, schema, ("work_id",)) for n in ("readable", "audit"))
    for run in range(3):
        write_accepted(readable, audit, rows.filter(F.col("run") == run).drop("run"), version=run)
    return audit.read().select(F.lit("audit").alias("sink"), "work_id", "doc_id").unionByName(readable.read().select(F.lit("readable").alias("sink"), "work_id", "doc_id"))


@query(f"WITH {EVENTS_SQL}, t AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 'done' ELSE type END AS kind FROM ev), c AS (SELECT *, (count(*) FILTER (kind = 'item') OVER w)::BIGINT AS done, (count(*) FILTER (kind = 'failed') OVER w)::BIGINT AS failed FROM t WINDOW w AS (PARTITION BY work_id ORDER BY event_id)) SELECT work_id, event_id, kind AS type, done, failed FROM c WHERE kind = 'done'")
def totals_at_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals with each terminal event (T-9)."""
    rows = events_of(spark, sf_dir)
    return E.totals_at_rest(rows.withColumn("type", F.when(F.col("event_id") % 11 == 0, "done").otherwise(F.col("type"))))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new ' ELSE '' END || n_chars AS digest, {NONSPACE % "coalesce(text, '')"}::BIGINT AS chars, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 1 THEN 1 ELSE 0 END AS run FROM documents WHERE doc_id % 7 <> 2")
def refreshed_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of works brought up to date (I3): some are new, some other than they were, some gone; the others keep what an earlier run made."""
    rows = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    works = new_table(spark, "works", "doc_id long, digest string, chars long, run int", ("doc_id",))

    def made(run: int):
        return lambda asked: rows.join(asked, "doc_id").select("doc_id", "digest", nonspace_length(F.col("text")).alias("chars"), F.lit(run).alias("run"))

    refresh(works, rows.filter(d % 5 != 1).select("doc_id", F.col("n_chars").cast("string").alias("digest")), made(0), version=0)
    now = F.concat(F.when(d % 3 == 0, "new ").otherwise(""), F.col("n_chars").cast("string"))
    refresh(works, rows.filter(d % 7 != 2).select("doc_id", now.alias("digest")), made(1), version=1)
    return works.read()
