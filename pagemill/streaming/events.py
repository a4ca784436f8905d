"""Job events, batch twins: events(work_id, event_id, ts, type, payload). Order within a work is event_id, never arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import triage_code

PAUSE_AT = 6


def coalesce_progress(events: DataFrame, *, every: str = "100 milliseconds") -> DataFrame:
    """One update per work and interval, the last one wins (T-3)."""
    rows = events.filter("type = 'progress'").groupBy("work_id", F.window("ts", every).alias("w")).agg(F.max_by(F.struct("event_id", "payload"), "event_id").alias("u"), F.count("*").alias("updates"))
    return rows.select("work_id", F.col("w.start").alias("start"), "u.event_id", "u.payload", "updates")


def queue_dedup(events: DataFrame, *, key: list[str]) -> DataFrame:
    """Enqueued items that were not pending or in flight at the time: the event before, for the same key, is no enqueue (T-1)."""
    order = Window.partitionBy(*key).orderBy("event_id")
    rows = events.filter("type in ('queued', 'item')").withColumn("__before", F.lag("type").over(order))
    return rows.filter("type = 'queued' and not (__before <=> 'queued')").drop("__before")


def current_state(events: DataFrame, *, key: list[str]) -> DataFrame:
    """Per work: last event, its type, items enqueued and not finished (T-2, A13)."""
    order = Window.partitionBy("work_id", *key).orderBy(F.desc("event_id"))
    last = events.filter("type in ('queued', 'item')").withColumn("__n", F.row_number().over(order)).filter("__n = 1")
    pending = last.groupBy("work_id").agg(F.count_if(F.col("type") == "queued").alias("pending"))
    now = events.groupBy("work_id").agg(F.max("event_id").alias("event_id"), F.max_by("type", "event_id").alias("type"), F.max_by("ts", "event_id").alias("at"))
    return now.join(pending, "work_id", "left").withColumn("pending", F.coalesce("pending", F.lit(0)).cast("long"))


def live_text(events: DataFrame) -> DataFrame:
    """The text of each work now: deltas since the last clear that were committed before, or not undone by, a reset (T-4)."""
    after = Window.partitionBy("work_id").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)

    def next_of(kind: str) -> Column:
        return F.min(F.when(F.col("type") == kind, F.col("event_id"))).over(after)

    rows = events.withColumns({"__commit": next_of("chunk"), "__reset": next_of("reset"), "__clear": next_of("clear")})
    kept = rows.filter("type = 'delta' and __clear is null and (__reset is null or __commit < __reset)")
    text = kept.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "payload"))), lambda s: s["payload"]), "").alias("text"))
    return events.select("work_id").distinct().join(text, "work_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def strikes(events: DataFrame, *, pause_at: int = PAUSE_AT) -> DataFrame:
    """Outcomes with the number of failures since the last completion, and whether the work pauses there (T-5)."""
    order = Window.partitionBy("work_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.filter("type in ('item', 'failed')").withColumn("__done", F.sum((F.col("type") == "item").cast("int")).over(order))
    run = Window.partitionBy("work_id", "__done").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum((F.col("type") == "failed").cast("int")).over(run)
    return rows.withColumn("strikes", count).withColumn("pause", F.col("strikes") >= pause_at).drop("__done")


def replay_tail(events: DataFrame, *, n: int = 1000, leave: tuple[str, ...] = ("progress", "delta")) -> DataFrame:
    """The newest n recorded events of each work (T-6, L3)."""
    order = Window.partitionBy("work_id").orderBy(F.desc("event_id"))
    return events.filter(~F.col("type").isin(*leave)).withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n")


def evict_finished(jobs: DataFrame, *, over: int = 40, keep: int = 10) -> DataFrame:
    """jobs(job_id, done, started) that stay in memory: all up to `over`; beyond it the unfinished and the newest `keep` finished ones (L3)."""
    newest = jobs.filter("done").orderBy(F.desc("started"), F.desc("job_id")).limit(keep).select("job_id")
    many = jobs.agg((F.count("*") > over).alias("__many"))  # one row
    kept = jobs.crossJoin(F.broadcast(many)).join(newest.withColumn("__new", F.lit(True)), "job_id", "left")
    return kept.filter(~F.col("__many") | ~F.col("done") | F.coalesce("__new", F.lit(False))).drop("__many", "__new")


def error_codes(failures: DataFrame, *, engine: str = "engine") -> DataFrame:
    """failures(work_id, name, low, vendor, http) -> work_id, code, n."""
    return failures.groupBy("work_id", triage_code(engine=engine).alias("code")).agg(F.count("*").alias("n"))


def operations(events: DataFrame, spend: DataFrame, failures: DataFrame, *, engine: str = "engine") -> DataFrame:
    """Per work: enqueued, done and failed items, strikes now, spend, and failures by code (R8). spend: work_id, spend."""
    depth = events.groupBy("work_id").agg(*[F.count_if(F.col("type") == t).alias(n) for n, t in (("queued", "queued"), ("done", "item"), ("failed", "failed"))])
    last = strikes(events).groupBy("work_id").agg(F.max_by("strikes", "event_id").alias("strikes"))
    codes = error_codes(failures, engine=engine).groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "n"))), lambda s: F.concat(s["code"], F.lit("="), s["n"].cast("string"))), ",").alias("codes"))
    rows = depth.join(spend, "work_id", "left").join(last, "work_id", "left").join(codes, "work_id", "left")
    return rows.withColumns({"strikes": F.coalesce("strikes", F.lit(0)).cast("long"), "codes": F.coalesce("codes", F.lit(""))})


def abandoned(events: DataFrame, live: DataFrame, *, key: list[str]) -> DataFrame:
    """Items enqueued and not finished whose work has no live job: they go back to rest (T-7)."""
    order = Window.partitionBy("work_id", *key).orderBy(F.desc("event_id"))
    last = events.filter("type in ('queued', 'item')").withColumn("__n", F.row_number().over(order)).filter("__n = 1 and type = 'queued'").drop("__n")
    return last.join(live.select("work_id").distinct(), "work_id", "left_anti")


def outcome(prior: Column, result: Column) -> Column:
    """The status after a result; done work is never downgraded (T-10)."""
    done = prior.isin("validated", "ok", "edited")
    return F.when(result.isin("aborted", "refused"), prior).when(result == "rate-limited", F.when(done, prior).otherwise("queued")).when(result == "failed", F.when(done, prior).otherwise("failed")).when(result == "skipped", prior).otherwise("validated")


def totals_at_rest(events: DataFrame, *, terminal: tuple[str, ...] = ("done", "paused")) -> DataFrame:
    """A row for each terminal event: results of its work by kind up to there (T-9)."""
    before = Window.partitionBy("work_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumns({n: F.sum((F.col("type") == t).cast("long")).over(before) for n, t in (("done", "item"), ("failed", "failed"))})
    return rows.filter(F.col("type").isin(*terminal)).select("work_id", "event_id", "type", "done", "failed")


def outcomes(results: DataFrame, items: DataFrame, *, key: list[str]) -> DataFrame:
    """results(key, event_id, result) over items(key, status): each item's status after all its results in order (T-10)."""
    came = results.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("event_id", "result"))).alias("__came"))
    both = items.join(came, key, "full").withColumn("status", F.coalesce("status", F.lit("new")))
    folded = F.aggregate(F.coalesce("__came", F.array().cast("array<struct<event_id bigint, result string>>")), F.col("status"), lambda status, r: outcome(status, r["result"]))
    return both.withColumn("status", folded).drop("__came")


def terminal_totals(events: DataFrame) -> DataFrame:
    """Per work: results by kind, and the last event (T-9)."""
    return events.groupBy("work_id").agg(F.count_if(F.col("type") == "item").alias("done"), F.count_if(F.col("type") == "failed").alias("failed"), F.max("event_id").alias("last_event"))
