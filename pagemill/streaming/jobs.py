"""The same over streams: windows with watermarks, keyed state with timers in event time, and merges in foreachBatch.

Keyed state (transformWithState, kept in RocksDB with changelogs) has an entry for each item or piece of text, so that a
batch costs what it brings, however much a key holds. Order within a key is event_id within a batch; batches come in order.
Offsets and state live in the query's checkpoint folder, which must be one that all executors share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import lines
from ..sources.buckets import Buckets, upsert
from .events import PAUSE_AT, outcome, replay_tail

#: Kinds of events after which a work is at rest.
TERMINAL = ("done", "paused")

Rows = Iterator[pd.DataFrame]


def progress(stream: DataFrame, *, every: str = "100 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Coalesced progress; a window is final once the watermark passes it (T-3)."""
    rows = stream.filter("type = 'progress'").withWatermark("ts", late).groupBy("work_id", F.window("ts", every).alias("w"))
    return rows.agg(F.max_by(F.struct("event_id", "payload"), "event_id").alias("u"), F.count("*").alias("updates")).select("work_id", F.col("w.start").alias("start"), "u.event_id", "u.payload", "updates")


def queued(stream: DataFrame, *, key: list[str], late: str = "10 minutes") -> DataFrame:
    """Enqueued items, repeats within the watermark dropped (T-1); `queue_dedup` is exact about releases."""
    return stream.filter("type = 'queued'").withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def _keyed(stream: DataFrame, key: list[str], processor: StatefulProcessor, out: str, *, mode: str, event_time: bool = False) -> DataFrame:
    """The processor over each key's rows; its state store takes one entry at a time."""
    conf = stream.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return stream.groupBy(*key).transformWithStateInPandas(processor, out, mode, "EventTime" if event_time else "None")


def _in_order(rows: Rows) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values("event_id", kind="stable")


class _Strikes(StatefulProcessor):
    def __init__(self, pause_at: int):
        self.pause_at = pause_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("strikes", "strikes int")

    def handleInputRows(self, key: tuple, rows: Rows, timerValues) -> Rows:
        count = self.count.get()[0] if self.count.exists() else 0
        batch = _in_order(rows)
        for kind in batch["type"]:
            count = count + 1 if kind == "failed" else 0 if kind == "item" else count
        self.count.update((count,))
        yield pd.DataFrame({"work_id": [key[0]], "event_id": [int(batch["event_id"].iloc[-1])], "strikes": [count], "pause": [count >= self.pause_at]})


def strikes(stream: DataFrame, *, pause_at: int = PAUSE_AT) -> DataFrame:
    """Failures in a row for each work as of its last event (T-5)."""
    return _keyed(stream, ["work_id"], _Strikes(pause_at), "work_id long, event_id long, strikes int, pause boolean", mode="update")


class _LiveText(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getListState("done", "piece string")
        self.open = handle.getListState("open", "piece string")
        self.sizes = handle.getValueState("sizes", "done long, open long")

    def handleInputRows(self, key: tuple, rows: Rows, timerValues) -> Rows:
        done, open_ = self.sizes.get() if self.sizes.exists() else (0, 0)
        least = done + open_  # what stays of the text as it was before
        added: list[tuple[int, str]] = []  # (place, piece) of what this batch has put after that
        came: list[str] = []  # pieces of this batch that are open and not in the state yet
        batch, ends = _in_order(rows), False

        def cut(at: int) -> None:
            nonlocal least
            least = min(least, at)
            while added and added[-1][0] >= at:
                added.pop()

        for kind, payload in batch[["type", "payload"]].itertuples(index=False):
            if kind == "delta" and payload:
                added.append((done + open_, payload))
                came.append(payload)
                open_ += len(payload)
            elif kind == "chunk":
                moved = [(p,) for (p,) in self.open.get()] + [(p,) for p in came]
                if moved:
                    self.done.appendList(moved)
                self.open.clear()
                came.clear()
                done, open_ = done + open_, 0
            elif kind in ("reset", "clear"):
                self.open.clear()
                came.clear()
                open_ = 0
                if kind == "clear":
                    self.done.clear()
                    done = 0
                cut(done)
            ends = kind in TERMINAL
        if came:
            self.open.appendList([(p,) for p in came])
        self.sizes.update((done, open_))
        text = "".join(p for _, p in added)
        if ends:  # at rest: the text in full, for readers that come anew
            least, text = 0, "".join(p for state in (self.done, self.open) for (p,) in state.get())
        yield pd.DataFrame({"work_id": [key[0]], "event_id": [int(batch["event_id"].iloc[-1])], "keep": [least], "added": [text]})


def live_text(stream: DataFrame) -> DataFrame:
    """What becomes of each work's text, batch by batch (T-4): of the text so far its first `keep` characters stay, then `added` follows.

    A batch's row and its work do not grow with the text; a work at rest gives its text in full (keep 0). `text_of` puts the
    rows together.
    """
    return _keyed(stream, ["work_id"], _LiveText(), "work_id long, event_id long, keep long, added string", mode="append")


def text_of(changes: DataFrame) -> DataFrame:
    """Rows of `live_text` -> work_id, text as of the last of them."""
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "keep", "added")))
    text = F.aggregate(ordered, F.lit(""), lambda t, c: F.concat(F.substr(t, F.lit(1), c["keep"].cast("int")), c["added"]))
    return changes.groupBy("work_id").agg(text.alias("text"))


class _Taken(StatefulProcessor):
    def __init__(self, key: list[str]):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "open boolean")

    def handleInputRows(self, key: tuple, rows: Rows, timerValues) -> Rows:
        open_, taken = self.open.exists(), []
        for kind, event in _in_order(rows)[["type", "event_id"]].itertuples(index=False):
            if kind == "queued" and not open_:
                taken.append(event)
            open_ = kind == "queued"
        if open_:
            self.open.update((True,))
        else:
            self.open.clear()
        yield pd.DataFrame({**{k: [v] * len(taken) for k, v in zip(self.key, key)}, "event_id": taken})


def queue_dedup(stream: DataFrame, *, key: list[str]) -> DataFrame:
    """Enqueued items that are not pending or in flight (T-1), exact: a finished item may be enqueued again. Gives key, event_id."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema if f.name in key)
    return _keyed(stream.filter("type in ('queued', 'item')"), key, _Taken(key), f"{types}, event_id long", mode="append")


class _CurrentState(StatefulProcessor):
    def __init__(self, item: str):
        self.item = item

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "item long", "event_id long")
        self.last = handle.getValueState("last", "event_id long, type string, pending long")

    def handleInputRows(self, key: tuple, rows: Rows, timerValues) -> Rows:
        event, kind, pending = self.last.get() if self.last.exists() else (-1, "", 0)
        for k, e, i in _in_order(rows)[["type", "event_id", self.item]].itertuples(index=False):
            if k in ("queued", "item") and not pd.isna(i):
                there = self.open.containsKey((int(i),))
                if k == "queued" and not there:
                    self.open.updateValue((int(i),), (int(e),))
                    pending += 1
                elif k == "item" and there:
                    self.open.removeKey((int(i),))
                    pending -= 1
            if e > event:
                event, kind = int(e), k
        self.last.update((event, kind, pending))
        yield pd.DataFrame({"work_id": [key[0]], "event_id": [event], "type": [kind], "pending": [pending]})


def current_state(stream: DataFrame, *, item: str = "item") -> DataFrame:
    """Each work's last event and how many items are enqueued and not finished (T-2), an entry of state for each such item. Gives work_id, event_id, type, pending."""
    return _keyed(stream, ["work_id"], _CurrentState(item), "work_id long, event_id long, type string, pending long", mode="update")


class _Abandoned(StatefulProcessor):
    def __init__(self, idle_ms: int, item: str):
        self.idle_ms, self.item = idle_ms, item

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "item long", "event_id long")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key: tuple, rows: Rows, timerValues) -> Rows:
        batch = _in_order(rows)
        for kind, event, i in batch[["type", "event_id", self.item]].itertuples(index=False):
            if kind == "queued" and not pd.isna(i):
                self.open.updateValue((int(i),), (int(event),))
            elif kind == "item" and not pd.isna(i) and self.open.containsKey((int(i),)):
                self.open.removeKey((int(i),))
        at = int(pd.Timestamp(batch["ts"].max()).timestamp() * 1000) + self.idle_ms
        before = self.due.get()[0] if self.due.exists() else None
        if before is None or at > before:  # a sign of life: the work's timer moves on
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.due.update((at,))
        yield pd.DataFrame({"work_id": pd.Series(dtype="int64"), "item": pd.Series(dtype="int64"), "event_id": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Rows:
        held = [(i, e) for (i,), (e,) in self.open.iterator()] if self.open.exists() else []
        self.open.clear()
        self.due.clear()
        yield pd.DataFrame({"work_id": [key[0]] * len(held), "item": [i for i, _ in held], "event_id": [e for _, e in held]})


def abandoned(stream: DataFrame, *, idle_ms: int, item: str = "item", late: str = "0 seconds") -> DataFrame:
    """Items enqueued and not finished of works without any event for `idle_ms` of event time: a timer gives them back (T-7). Gives work_id, item, event_id of its enqueuing.

    Every event of a work is a sign of life. Time is that of the events (`ts`), so a replay gives the same rows.
    """
    return _keyed(stream.withWatermark("ts", late), ["work_id"], _Abandoned(idle_ms, item), "work_id long, item long, event_id long", mode="append", event_time=True)


class _Totals(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "event_id long", "type string, at long")
        self.before = handle.getValueState("before", "done long, failed long")

    def handleInputRows(self, key: tuple, rows: Rows, timerValues) -> Rows:
        for kind, event, ts in _in_order(rows)[["type", "event_id", "ts"]].itertuples(index=False):
            at = int(pd.Timestamp(ts).timestamp() * 1000)
            self.waiting.updateValue((int(event),), (kind, at))
            if kind in TERMINAL:
                self.handle.registerTimer(at)
        yield pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("work_id", "int64"), ("event_id", "int64"), ("type", "str"), ("done", "int64"), ("failed", "int64"))})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Rows:
        now = expiredTimerInfo.getExpiryTimeInMs()
        done, failed = self.before.get() if self.before.exists() else (0, 0)
        held = sorted((e, kind, at) for (e,), (kind, at) in self.waiting.iterator())
        ends = [e for e, kind, at in held if kind in TERMINAL and at <= now]
        out = []
        for event, kind, _ in held:
            if not ends or event > ends[-1]:
                break
            self.waiting.removeKey((event,))
            done, failed = done + (kind == "item"), failed + (kind == "failed")
            if kind in TERMINAL:
                out.append((key[0], event, kind, done, failed))
        self.before.update((done, failed))
        yield pd.DataFrame(out, columns=["work_id", "event_id", "type", "done", "failed"]).astype({"work_id": "int64", "event_id": "int64", "done": "int64", "failed": "int64"})


def terminal_totals(stream: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    """A row for each terminal event once the watermark has passed it (T-9): results of its work by kind up to there. Gives work_id, event_id, type, done, failed.

    Results wait, one entry each, until the terminal event after them is final, so that those which arrive late but within
    the watermark are counted, and none is counted twice.
    """
    rows = stream.filter(F.col("type").isin("item", "failed", *TERMINAL)).withWatermark("ts", late)
    return _keyed(rows, ["work_id"], _Totals(), "work_id long, event_id long, type string, done long, failed long", mode="append", event_time=True)


def merge_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Each micro-batch to `merge`; batch ids make a repeat harmless. trigger: availableNow=True or the like."""
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def record(stream: DataFrame, path: str, checkpoint: str, *, leave: tuple[str, ...] = ("progress", "delta"), **trigger):
    """The event log (T-6): each micro-batch as a partition of its own, so that one that comes again replaces itself; progress and deltas aren't recorded."""

    def append(batch: DataFrame, number: int) -> None:
        batch.filter(~F.col("type").isin(*leave)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return merge_batches(stream, append, checkpoint, **trigger)


def replay(log: DataFrame, *, n: int = 1000, terminal: tuple[str, ...] = ("done", "paused")) -> DataFrame:
    """What a reader that comes anew is sent: the newest n recorded events of each work, none after the first terminal one (T-6)."""
    ends = log.filter(F.col("type").isin(*terminal)).groupBy("work_id").agg(F.min("event_id").alias("__end"))
    open_ = log.join(ends, "work_id", "left").filter(F.col("__end").isNull() | (F.col("event_id") <= F.col("__end"))).drop("__end")
    return replay_tail(open_, n=n, leave=())


def merge_result_batch(pages: Buckets, batch: DataFrame, decisions: DataFrame, *, version: int) -> None:
    """One batch of results (page_id, status, event_id) into the table, after the decisions (page_id, status, decided) that are not in it yet."""
    since = pages.mark(before=version)
    said = decisions.filter(F.lit(True) if since is None else F.col("decided") > since)
    upto = said.agg(F.max("decided")).first()[0]
    said = said if upto is None else said.filter(F.col("decided") <= upto)
    newest = said.groupBy("page_id").agg(F.max_by("status", "decided").alias("status"))
    last = batch.groupBy("page_id").agg(F.max_by("status", "event_id").alias("status"))
    touched = last.select("page_id").unionByName(newest.select("page_id"))
    pages.merge(touched, lambda old: lines.merge_pages(lines.decide_pages(old, newest)[0], last), version=version, mark=upto)


def merge_results(stream: DataFrame, decisions: Callable[[], DataFrame], pages: Buckets, checkpoint: str, **trigger):
    """Results of reads (page_id, status, event_id) into a keyed table of pages (T-8): a micro-batch rewrites the buckets of its pages and of new decisions, and no others.

    `decisions` gives what people have decided by then (page_id, status, decided: a number that grows); a page that one of
    them skipped stays so, however late the result comes. The table's mark is the last decision that is in it. A batch that
    comes again starts from the version before it and takes the decisions since then. Version 0 is where the table begins.
    """
    return merge_batches(stream, lambda batch, number: merge_result_batch(pages, batch, decisions(), version=number + 1), checkpoint, **trigger)


def merge_outcome_batch(items: Buckets, batch: DataFrame, *, version: int) -> None:
    """One batch of results (key, event_id, result) into the table of items (key, status, applied)."""
    key = list(items.key)
    came = batch.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("event_id", "result"))).alias("__came"))

    def change(old: DataFrame) -> DataFrame:
        now = came.join(old, key, "left").withColumns({"status": F.coalesce("status", F.lit("new")), "applied": F.coalesce("applied", F.lit(-1).cast("long"))})
        fresh = F.filter("__came", lambda r: r["event_id"] > F.col("applied"))
        folded = F.aggregate(fresh, F.col("status"), lambda status, r: outcome(status, r["result"]))
        done = now.withColumns({"status": folded, "applied": F.greatest("applied", F.array_max(F.transform("__came", lambda r: r["event_id"])))})
        return upsert(old, done.select(*items.schema.names), items.key)

    items.merge(came, change, version=version)


def merge_outcomes(stream: DataFrame, items: Buckets, checkpoint: str, **trigger):
    """Results into a keyed table of items with a status (T-10): done work is never downgraded, and each result counts once.

    An item's results in a batch are folded in the order of event_id; `applied`, the last event in the row, keeps results
    that come again from counting again. Items that the table does not have begin as `new`.
    """
    return merge_batches(stream, lambda batch, number: merge_outcome_batch(items, batch, version=number + 1), checkpoint, **trigger)
