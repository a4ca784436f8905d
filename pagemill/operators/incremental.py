"""What still needs work: done-ness by status and content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERMINAL = ("empty", "english-source")
#: Statuses that count as done, by the kind of work asked about.
DONE = {"prepare": ("prepared", "translated", "validated", *TERMINAL), "translate": ("validated", *TERMINAL)}


def is_done(kind: str, status: Column, stored_hash: Column, content_hash: Column) -> Column:
    """Finished, and against the text that is there now; an unknown kind is never done."""
    if kind not in DONE:
        return F.lit(False)
    return F.coalesce(status.isin(*DONE[kind]) & (stored_hash == content_hash), F.lit(False))


def with_state(chapters: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters beside their stored row; stale: a stored hash that is not the present one."""
    joined = chapters.join(state, keys, "left")
    stale = F.coalesce((F.col("source_hash") != "") & (F.col("source_hash") != F.col("content_hash")), F.lit(False))
    return joined.withColumns({"stale": stale, "status": F.coalesce("status", F.lit("pending"))})


def due(chapters: DataFrame, state: DataFrame, keys: list[str], *, kind: str = "translate", ids: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Rows to work on: the ids asked for as they are, else those the kind applies to that are not done (all, with force)."""
    rows = with_state(chapters, state, keys)
    if ids is not None:
        return rows.join(ids, keys, "left_semi")
    if kind != "prepare":
        rows = rows.filter(F.col("kind") == "source")
    return rows if force else rows.filter(~is_done(kind, F.col("status"), F.coalesce("source_hash", F.lit("")), F.col("content_hash")))


def overlay(state: DataFrame, delta: DataFrame, *, keys: list[str], now: Column) -> DataFrame:
    """Rows of delta over those of state, column by column where delta says something; created_at stays, updated_at is now."""
    fields = [c for c in delta.columns if c not in keys]
    d = delta.select(*keys, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in fields])
    both = state.join(d, keys, "full")
    kept = [F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in state.columns if c not in (*keys, "created_at", "updated_at")]
    return both.select(*keys, *kept, F.coalesce("created_at", now).alias("created_at"), F.when(F.col("__new"), now).otherwise(F.col("updated_at")).alias("updated_at"))
