"""Ledgers and job events; `events` are the log, `orders` and `lineitem` the spend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import HTTP_AGAIN, HTTP_CODES, failure_facts, http_refusal, queue_key, resume_seconds, triage_code
from ..operators import ledger
from ..streaming import events as E
from .registry import query, table

TYPES = {"view": "progress", "click": "delta", "purchase": "item", "signup": "queued", "error": "failed"}


def events_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    for old, new in TYPES.items():
        kind = F.when(F.col("event_type") == old, new).otherwise(kind)
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("work_id"), "event_id", "ts", kind.alias("type"), k.alias("item"), F.concat(F.lit("<"), k.cast("string"), F.lit(">")).alias("payload"), "value")


EVENTS_SQL = "ev AS (SELECT user_id AS work_id, event_id, ts, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items()) + " ELSE event_type END AS type, (props::JSON->>'k')::INT AS item, '<' || (props::JSON->>'k') || '>' AS payload, value FROM events)"


@query(f"WITH {EVENTS_SQL} SELECT work_id, time_bucket(INTERVAL '6 hours', ts) AS start, max(event_id) AS event_id, arg_max(payload, event_id) AS payload, count(*) AS updates FROM ev WHERE type = 'progress' GROUP BY ALL")
def progress_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coalesce_progress(events_of(spark, sf_dir), every="6 hours")


ITEM_SQL = f"{EVENTS_SQL}, q AS (SELECT *, item % 10 AS slot FROM ev), last AS (SELECT work_id, slot, arg_max(type, event_id) AS type, max(event_id) AS event_id FROM q WHERE type IN ('queued', 'item') GROUP BY ALL)"


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(spark, sf_dir).withColumn("slot", F.col("item") % 10)


@query(f"WITH {ITEM_SQL}, l AS (SELECT *, lag(type) OVER (PARTITION BY work_id, slot ORDER BY event_id) AS before FROM q WHERE type IN ('queued', 'item')) SELECT work_id, slot, event_id FROM l WHERE type = 'queued' AND before IS DISTINCT FROM 'queued'")
def queue_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.queue_dedup(_slots(spark, sf_dir), key=["work_id", "slot"]).select("work_id", "slot", "event_id")


@query(f"WITH {ITEM_SQL} SELECT work_id, max(event_id) AS event_id, arg_max(type, event_id) AS type, arg_max(ts, event_id) AS \"at\", coalesce((SELECT count(*) FROM last WHERE last.work_id = q.work_id AND last.type = 'queued'), 0) AS pending FROM q GROUP BY work_id")
def queue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.current_state(_slots(spark, sf_dir), key=["slot"])


@query(f"WITH {ITEM_SQL} SELECT work_id, slot, event_id FROM last WHERE type = 'queued' AND work_id % 3 <> 0")
def abandoned_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _slots(spark, sf_dir)
    return E.abandoned(rows, rows.filter("work_id % 3 = 0").select("work_id"), key=["slot"]).select("work_id", "slot", "event_id")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("type") == "item", "chunk").when(F.col("type") == "failed", F.when(F.col("event_id") % 3 == 0, "clear").otherwise("reset")).otherwise(F.col("type"))
    return events_of(spark, sf_dir).withColumn("type", kind)


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, t AS (SELECT work_id, payload, CASE WHEN type = 'item' THEN 'chunk' WHEN type = 'failed' THEN CASE WHEN event_id % 3 = 0 THEN 'clear' ELSE 'reset' END ELSE type END AS type, row_number() OVER (PARTITION BY work_id ORDER BY event_id) AS n FROM ev),
fold AS (SELECT work_id, 0::BIGINT AS n, '' AS done, '' AS open FROM (SELECT DISTINCT work_id FROM t)
  UNION ALL SELECT f.work_id, t.n, CASE t.type WHEN 'chunk' THEN done || open WHEN 'clear' THEN '' ELSE done END, CASE t.type WHEN 'delta' THEN open || payload WHEN 'chunk' THEN '' WHEN 'reset' THEN '' WHEN 'clear' THEN '' ELSE open END FROM fold f JOIN t ON t.work_id = f.work_id AND t.n = f.n + 1)
SELECT work_id, arg_max(done || open, n) AS text FROM fold GROUP BY work_id"""
)
def live_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.live_text(_texts(spark, sf_dir))


STRIKE_SQL = f"""{EVENTS_SQL}, o AS (SELECT *, sum((type = 'item')::INT) OVER (PARTITION BY work_id ORDER BY event_id) AS g FROM ev WHERE type IN ('item', 'failed')),
struck AS (SELECT work_id, event_id, sum((type = 'failed')::INT) OVER (PARTITION BY work_id, g ORDER BY event_id)::BIGINT AS strikes FROM o)"""


@query(f"WITH {STRIKE_SQL} SELECT *, strikes >= 3 AS pause FROM struck")
def strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.strikes(events_of(spark, sf_dir), pause_at=3).select("work_id", "event_id", "strikes", "pause")


@query(f"WITH {EVENTS_SQL} SELECT work_id, event_id FROM ev WHERE type NOT IN ('progress', 'delta') QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY event_id DESC) <= 1000")
def replay_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.replay_tail(events_of(spark, sf_dir)).select("work_id", "event_id")


@query(f"WITH {EVENTS_SQL} SELECT work_id, count(*) FILTER (type = 'item') AS done, count(*) FILTER (type = 'failed') AS failed, max(event_id) AS last_event FROM ev GROUP BY work_id")
def terminal_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.terminal_totals(events_of(spark, sf_dir))


@query(
    f"""WITH {EVENTS_SQL}, s AS (SELECT event_id, ['pending', 'validated', 'edited', 'reading'][event_id % 4 + 1] AS prior, ['done', 'failed', 'rate-limited', 'aborted', 'refused', 'skipped'][event_id % 6 + 1] AS result FROM ev)
SELECT event_id, CASE WHEN result = 'done' THEN 'validated' WHEN prior IN ('validated', 'edited') OR result IN ('aborted', 'refused', 'skipped') THEN prior WHEN result = 'failed' THEN 'failed' ELSE 'queued' END AS status FROM s"""
)
def item_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a result makes of an item's status (T-10)."""
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % n + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", E.outcome(pick(("pending", "validated", "edited", "reading"), 4), pick(("done", "failed", "rate-limited", "aborted", "refused", "skipped"), 6)).alias("status"))


NAMES = ("TaskAborted", "TaskRefused", "HttpError", "RateLimited", "OSError", "PermissionError", "ProcessError", "JSONDecodeError", "KeyError", "Odd", "CLINotFoundError", "FileNotFoundError")
MESSAGES = ("usage limit reached", "No space left", "initialize timeout", "being used by another", "Expecting value", "plain", "Enginex not found", "status code not found")
FAIL_SQL = f"""SELECT event_id, list_extract({list(NAMES)}, (event_id % {len(NAMES)} + 1)::INT) AS name, lower(list_extract({list(MESSAGES)}, (event_id // 3 % {len(MESSAGES)} + 1)::INT)) AS low, event_id % {len(NAMES)} = 2 OR event_id % 7 = 1 AS vendor, CASE WHEN event_id % 7 = 3 THEN NULL ELSE list_extract([401, 404, 429, 500], (event_id // 5 % 4 + 1)::INT) END AS http FROM events WHERE event_type = 'error'"""


#: The ladder once more, written out for these names and messages, so that the twin does not repeat the table.
TRIAGE_SQL = """CASE name WHEN 'TaskAborted' THEN 'stopped' WHEN 'TaskRefused' THEN 'refused' ELSE CASE
  WHEN vendor THEN CASE http WHEN 401 THEN 'vendor-auth-expired' WHEN 404 THEN 'vendor-not-found' WHEN 429 THEN 'vendor-rate-limited' ELSE 'vendor-error' END
  WHEN name = 'RateLimited' OR contains(low, 'usage limit') THEN 'rate-limited' WHEN contains(low, 'initialize timeout') THEN 'start-timeout' WHEN name = 'CLINotFoundError' OR contains(low, 'enginex not found') THEN 'engine-missing' WHEN name = 'ProcessError' THEN 'engine-connection'
  WHEN name IN ('OSError', 'PermissionError') AND contains(low, 'no space') THEN 'disk-full' WHEN name = 'PermissionError' OR contains(low, 'being used by another') THEN 'file-locked' WHEN name = 'FileNotFoundError' THEN 'missing-file'
  WHEN name = 'JSONDecodeError' OR contains(low, 'expecting value') THEN 'corrupt-data' WHEN name = 'OSError' THEN 'file-error' WHEN name = 'KeyError' THEN 'bad-data' ELSE 'unknown' END END"""


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")
    module = F.when(e % len(NAMES) == 2, "vendorapi.errors").otherwise("vendors.other")
    code = pick((401, 404, 429, 500), F.floor(e / 5))
    answered = F.when(e % 7 == 1, code)  # a response with a status is the vendor's, whatever the module
    facts = failure_facts(pick(NAMES, e), module, pick(MESSAGES, F.floor(e / 3)), answered, F.when(e % 7 == 3, "none").otherwise(F.format_string(" %d ", code)), vendors=("vendorapi",))
    return rows.select(F.col("user_id").alias("work_id"), "event_id", *facts)


@query(f"SELECT code, count(*) AS n FROM (SELECT {TRIAGE_SQL} AS code FROM ({FAIL_SQL})) GROUP BY code")
def failure_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures by the first rule that explains them (C11)."""
    return _failures(spark, sf_dir).groupBy(triage_code(engine="enginex").alias("code")).agg(F.count("*").alias("n"))


@query(
    f"""WITH r AS (SELECT event_id, list_extract([400, 401, 404, 409, 429, 500, 502], (event_id % 7 + 1)::INT) AS s, event_id % 5 = 0 AS own FROM events WHERE event_type = 'error')
SELECT event_id, CASE WHEN own THEN 'own' ELSE CASE s {" ".join(f"WHEN {s} THEN '{c}'" for s, c in HTTP_CODES.items())} ELSE 'request-failed' END END AS code, CASE WHEN own THEN 'Its words' ELSE 'words ' || event_id END AS title, CASE WHEN own THEN event_id % 2 = 0 ELSE s IN {HTTP_AGAIN} END AS again FROM r"""
)
def http_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals by their status, or by what they say of themselves (C11)."""
    e = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, (400, 401, 404, 409, 429, 500, 502))), (e % 7 + 1).cast("int"))
    detail = F.when(e % 5 == 0, F.concat(F.lit('{"code": "own", "title": "Its words", "retryable": '), F.when(e % 2 == 0, "true").otherwise("false"), F.lit("}"))).otherwise(F.concat(F.lit("words "), e.cast("string")))
    found = table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", http_refusal(detail, status).alias("r"))
    return found.select("event_id", "r.code", "r.title", F.col("r.retryable").alias("again"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 AND event_id * 7 % 60000 <= 43200 THEN (event_id * 7 % 60000 + 60)::DOUBLE ELSE least(3600.0, 300 * pow(2, greatest(0, event_id % 9 - 1))) END AS wait FROM events WHERE event_type = 'error'")
def resume_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds until rate-limited work goes on."""
    e = F.col("event_id")
    reset = F.when(e % 4 == 0, e * 7 % 60000)
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return rows.select("event_id", resume_seconds(e % 9, reset).alias("wait"))


@query("SELECT event_id, event_type || ':' || user_id || ':' || CASE WHEN value > 10 THEN 'ch' ELSE 'pg' END AS key FROM events")
def queue_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", queue_key(F.col("event_type"), F.col("user_id"), F.when(F.col("value") > 10, "ch").otherwise("pg")).alias("key"))


def ledgers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chapter-side spend from line items, page-side spend from orders, by customer."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    chapters = items.join(orders, items.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("work_id"), F.create_map(F.lit("output_tokens"), F.col("l_quantity").cast("long"), F.lit("calls"), F.lit(1).cast("long")).alias("usage"), F.col("l_extendedprice").cast(ledger.MONEY).alias("cost_usd"))
    pages = orders.select(F.col("o_custkey").alias("work_id"), F.create_map(F.lit("input_tokens"), F.floor("o_totalprice").cast("long")).alias("usage"), F.col("o_totalprice").cast(ledger.MONEY).alias("cost_usd"))
    return chapters, pages


LEDGER_SQL = """led AS (SELECT o_custkey AS work_id, l_quantity::BIGINT AS output_tokens, 1 AS calls, 0 AS input_tokens, l_extendedprice::DECIMAL(18,6) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT o_custkey, NULL, NULL, floor(o_totalprice)::BIGINT, o_totalprice::DECIMAL(18,6) FROM orders)"""


@query(f"WITH {LEDGER_SQL} SELECT work_id, sum(cost)::DECIMAL(18,6) AS cost_usd, sum(calls)::BIGINT AS calls, sum(output_tokens)::BIGINT AS output_tokens, sum(input_tokens)::BIGINT AS input_tokens FROM led GROUP BY work_id")
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.totals(*ledgers(spark, sf_dir))
    return found.select("work_id", "cost_usd", *[F.col("usage")[n].alias(n) for n in ("calls", "output_tokens", "input_tokens")])


@query("SELECT user_id, 'k' || ((props::JSON->>'k')::INT % 3) AS name, sum((props::JSON->>'k')::BIGINT)::BIGINT AS amount FROM events GROUP BY ALL")
def usage_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "k bigint")["k"]
    rows = table(spark, sf_dir, "events").select("user_id", F.create_map(F.concat(F.lit("k"), (k % 3).cast("string")), k).alias("usage"))
    return ledger.usage_by_key(rows, key=["user_id"])


@query("SELECT user_id, event_type AS name, sum(2 * (props::JSON->>'k')::BIGINT)::BIGINT AS amount FROM events GROUP BY ALL")
def usage_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage out of a map per model."""
    k = F.from_json("props", "k bigint")["k"]
    one = F.create_map(F.col("event_type"), k)
    rows = table(spark, sf_dir, "events").select("user_id", F.create_map(F.lit("large"), one, F.lit("small"), one).alias("models"))
    return ledger.usage_of_models(rows, key=["user_id"])


@query(
    f"""WITH {STRIKE_SQL}, lastly AS (SELECT work_id, arg_max(strikes, event_id) AS strikes FROM struck GROUP BY work_id), depth AS (SELECT work_id, count(*) FILTER (type = 'queued') AS queued, count(*) FILTER (type = 'item') AS done, count(*) FILTER (type = 'failed') AS failed, sum(value::DECIMAL(18,6))::DECIMAL(18,6) AS spend FROM ev GROUP BY work_id),
failure AS (SELECT user_id AS work_id, {TRIAGE_SQL} AS code FROM ({FAIL_SQL.replace("SELECT event_id,", "SELECT user_id, event_id,", 1)})),
codes AS (SELECT work_id, string_agg(code || '=' || n, ',' ORDER BY code) AS codes FROM (SELECT work_id, code, count(*) AS n FROM failure GROUP BY ALL) GROUP BY work_id)
SELECT depth.*, coalesce(strikes, 0)::BIGINT AS strikes, coalesce(codes, '') AS codes FROM depth LEFT JOIN lastly USING (work_id) LEFT JOIN codes USING (work_id)"""
)
def operations_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, outcomes, strikes, spend and error codes per work."""
    rows = events_of(spark, sf_dir)
    spend = rows.groupBy("work_id").agg(F.sum(F.col("value").cast(ledger.MONEY)).cast(ledger.MONEY).alias("spend"))
    return E.operations(rows, spend, _failures(spark, sf_dir), engine="enginex")


@query("""WITH j AS (SELECT user_id, max(ts) AS started, user_id % 3 <> 0 AS done FROM events GROUP BY user_id), n AS (SELECT *, row_number() OVER (PARTITION BY done ORDER BY started DESC, user_id DESC) AS k, count(*) OVER () AS c FROM j)
SELECT user_id AS job_id FROM n WHERE c <= 40 OR NOT done OR k <= 10""")
def kept_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that are kept once there are over forty: unfinished ones and the newest ten finished (L3)."""
    jobs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.max("ts").alias("started")).withColumn("done", F.col("job_id") % 3 != 0)
    return E.evict_finished(jobs).select("job_id")
