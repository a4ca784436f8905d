"""Keyed tables, and streams held against their batch twins."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagemill.sources import buckets, files
from pagemill.streaming import events as E
from pagemill.streaming import jobs


def schema_of(spark, ddl):
    return spark.createDataFrame([], ddl).schema


def files_of(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(os.path.join(root, "data")) for f in names if f.endswith(".parquet")}


def test_a_merge_writes_only_what_it_touches(spark, tmp_path):
    table = buckets.Buckets(spark, str(tmp_path / "t"), schema_of(spark, "k long, v string"), ("k",), buckets=8)
    assert table.read().count() == 0 and table.versions() == [] and table.mark() is None
    rows = spark.createDataFrame([(k, "a") for k in range(100)] + [(None, "null")], "k long, v string")
    buckets.replace_rows(table, rows, version=0)
    before = files_of(table.root)
    one = spark.createDataFrame([(7, "b"), (None, "other")], "k long, v string")
    for _ in range(2):  # a merge that comes again
        buckets.replace_rows(table, one.filter("k = 7"), version=1)
    after = files_of(table.root)
    own = spark.range(7, 8).select(F.col("id").alias("k")).select(table.bucket()).first()[0]
    assert {f for f in before if f"bucket={own}/" not in f} <= set(after) and all(after[f] == t for f, t in before.items() if f in after)
    assert {f.split("bucket=")[1].split("/")[0] for f in set(after) - set(before)} == {str(own)}
    assert {(r.k, r.v) for r in table.read().collect()} == {(k, "b" if k == 7 else "a") for k in range(100)} | {(None, "null")}
    assert {(r.k, r.v) for r in table.read(0).collect()} == {(k, "a") for k in range(100)} | {(None, "null")}
    table.merge(spark.range(3).select(F.col("id").alias("k")), lambda old: old.filter("k > 2 or k is null"), version=2, mark=9)
    assert table.versions() == [1, 2] and table.mark() == 9 and table.mark(before=2) is None
    with pytest.raises(ValueError):
        table.read(0)
    assert table.read().count() == 98
    named = {(v, b) for k in table.versions() for b, v in table.manifest(k)[0].items()}
    left = {(int(f.split("version=")[1].split("/")[0]), int(f.split("bucket=")[1].split("/")[0])) for f in files_of(table.root)}
    assert left == named  # what no kept version names is gone
    table.merge(spark.range(200).select(F.col("id").alias("k")), lambda old: old.filter("false"), version=3)
    assert table.read().filter("k is not null").count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("w1", 1, True, "a"), ("w1", 2, False, "b"), ("w2", 1, True, "c")], "work_id string, idx int, ok boolean, text string")
    files.write_accepted(rows, str(tmp_path / "read"), str(tmp_path / "audit"))
    files.write_accepted(rows.filter("work_id = 'w1'").withColumn("text", F.lit("z")), str(tmp_path / "read"), str(tmp_path / "audit"))
    assert {(r.work_id, r.idx, r.text) for r in spark.read.parquet(str(tmp_path / "read")).collect()} == {("w1", 1, "z"), ("w2", 1, "c")} and spark.read.parquet(str(tmp_path / "audit")).count() == 3
    readable, audit = (buckets.Buckets(spark, str(tmp_path / n), rows.schema, ("work_id",), buckets=4) for n in ("keyed", "keyed_audit"))
    buckets.write_accepted(readable, audit, rows, version=0)
    buckets.write_accepted(readable, audit, rows.filter("work_id = 'w1'").withColumns({"ok": F.lit(False), "text": F.lit("z")}), version=1)
    assert {(r.work_id, r.text) for r in readable.read().collect()} == {("w2", "c")} and {(r.work_id, r.text) for r in audit.read().collect()} == {("w1", "z"), ("w2", "c")}
    slots = buckets.Buckets(spark, str(tmp_path / "slots"), schema_of(spark, "idx int, slot string, text string"), ("idx",), buckets=4)
    for version, (idx, text) in enumerate([(1, "a"), (2, "x"), (1, "b"), (1, "c")]):
        buckets.keep_previous(slots, spark.createDataFrame([(idx, text)], "idx int, text string"), version=version)
    buckets.keep_previous(slots, spark.createDataFrame([(1, "d")], "idx int, text string"), version=3)  # the last one once more, in other words
    assert {(r.idx, r.slot, r.text) for r in slots.read().collect()} == {(1, "current", "d"), (1, "previous", "b"), (2, "current", "x")}
    for version, text in ((1, "a"), (2, "b"), (3, "c"), (3, "d")):
        files.write_version(spark.createDataFrame([(1, text)], "idx int, text string"), str(tmp_path / "v"), version=version)
    assert {r.slot: r.text for r in files.keep_two_versions(spark, str(tmp_path / "v"), key=["idx"]).collect()} == {"current": "d", "previous": "b"}
    spark.createDataFrame([("b", "t2", 2), ("a", "t1", 1), ("", "no", 0), (None, "no", 0)], "id string, title string, created_at int").write.json(str(tmp_path / "works"))
    assert [r.id for r in files.read_library(spark, str(tmp_path / "works"), "id string, title string, created_at int").collect()] == ["a", "b"]


LOG = [(1, 1, "delta", "a"), (1, 2, "chunk", ""), (1, 3, "delta", "b"), (1, 4, "reset", ""), (1, 5, "delta", "c"), (2, 6, "delta", "x"), (2, 7, "failed", ""), (2, 8, "clear", ""), (2, 9, "delta", "y"), (2, 10, "failed", ""), (1, 11, "failed", ""), (1, 12, "item", "")]


def test_streams_equal_their_batch_twins(spark, tmp_path):
    schema = "work_id long, event_id long, type string, payload string"
    log = spark.createDataFrame(LOG, schema)
    for k in range(3):  # three micro-batches in order
        log.filter(f"event_id > {4 * k} and event_id <= {4 * k + 4}").coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    texts = {r.work_id: r.text for r in E.live_text(log).collect()}
    assert texts == {1: "ac", 2: "y"}
    last = {r.work_id: r.strikes for r in E.strikes(log).groupBy("work_id").agg(F.max_by("strikes", "event_id").alias("strikes")).collect()}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in" / "*"))
    for name, job, mode in (("texts", jobs.live_text, "append"), ("strikes", jobs.strikes, "update")):
        q = job(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    seen = {r.work_id: r.text for r in jobs.text_of(spark.table("texts")).collect()}
    counts = {r.work_id: r.strikes for r in spark.sql("SELECT work_id, max_by(strikes, event_id) AS strikes FROM strikes GROUP BY work_id").collect()}
    assert seen == texts and counts == last == {1: 0, 2: 2}


ITEMS = [(1, 1, "queued", 5), (1, 2, "queued", 5), (1, 3, "item", 5), (1, 4, "queued", 5), (2, 5, "queued", 5), (1, 6, "queued", 7), (1, 7, "item", 5), (2, 8, "progress", 5), (1, 9, "queued", 7), (2, 10, "queued", 6), (1, 11, "done", 0), (2, 12, "delta", 1)]


def item_stream(spark, folder):
    log = spark.createDataFrame(ITEMS, "work_id long, event_id long, type string, item long").withColumn("ts", F.timestamp_seconds("event_id"))
    for k in range(3):
        log.filter(f"event_id > {4 * k} and event_id <= {4 * k + 4}").coalesce(1).write.json(str(folder / "in" / str(k)))
    return log, spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).json(str(folder / "in" / "*"))


def in_memory(stream, name, folder, mode, **trigger):
    return stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder / name)).trigger(**trigger).start()


def test_queues_over_streams(spark, tmp_path):
    log, stream = item_stream(spark, tmp_path)
    assert in_memory(jobs.queue_dedup(stream, key=["work_id", "item"]), "taken", tmp_path, "append", availableNow=True).awaitTermination(90)
    want = {(r.work_id, r.item, r.event_id) for r in E.queue_dedup(log, key=["work_id", "item"]).collect()}
    assert {(r.work_id, r.item, r.event_id) for r in spark.table("taken").collect()} == want == {(1, 5, 1), (1, 5, 4), (2, 5, 5), (1, 7, 6), (2, 6, 10)}
    assert in_memory(jobs.current_state(stream), "now", tmp_path, "update", availableNow=True).awaitTermination(90)
    got = {r.work_id: (r.event_id, r.s.type, r.s.pending) for r in spark.sql("SELECT work_id, max(event_id) AS event_id, max_by(struct(type, pending), event_id) AS s FROM now GROUP BY work_id").collect()}
    assert got == {r.work_id: (r.event_id, r.type, r.pending) for r in E.current_state(log, key=["item"]).collect()} == {1: (11, "done", 1), 2: (12, "delta", 2)}


def test_progress_and_repeats_over_streams(spark, tmp_path):
    log, stream = item_stream(spark, tmp_path)
    both = log.withColumns({"type": F.lit("progress"), "payload": F.col("item").cast("string")}), stream.withColumns({"type": F.lit("progress"), "payload": F.col("item").cast("string")})
    assert in_memory(jobs.progress(both[1], every="5 seconds", late="0 seconds"), "steps", tmp_path, "append", availableNow=True).awaitTermination(90)
    key = lambda r: (r.work_id, r.start, r.event_id, r.payload, r.updates)
    want = {key(r) for r in E.coalesce_progress(both[0], every="5 seconds").collect()}
    got = {key(r) for r in spark.table("steps").collect()}
    assert got and got <= want and len(want) - len(got) <= 2  # the last windows are open yet
    assert in_memory(jobs.queued(stream, key=["work_id", "item"]), "first", tmp_path, "append", availableNow=True).awaitTermination(90)
    assert {(r.work_id, r.item) for r in spark.table("first").collect()} == {(1, 5), (2, 5), (1, 7), (2, 6)}


def in_batches(spark, folder, rows, schema, n):
    """A stream whose micro-batches are the given lists of rows."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.json(str(folder / n / f"{k:03}"))
        for f in os.listdir(folder / n / f"{k:03}"):
            os.utime(folder / n / f"{k:03}" / f, (1_000_000 + k, 1_000_000 + k))
    types = spark.createDataFrame([], schema).withColumn("ts", F.timestamp_seconds("ts")).schema
    return spark.readStream.schema(types).option("maxFilesPerTrigger", 1).json(str(folder / n / "*"))


def test_timers_give_abandoned_items_back(spark, tmp_path):
    """In event time: a work without any event for 100 seconds gives its items back, once; one that shows life keeps them."""
    schema = "work_id long, event_id long, type string, item long, ts long"
    batches = [
        [(1, 1, "queued", 5, 10), (1, 2, "queued", 6, 11), (2, 3, "queued", 5, 12), (2, 4, "queued", 8, 12)],
        [(1, 5, "item", 5, 60), (2, 6, "delta", None, 90)],
        [(3, 7, "queued", 1, 175)],  # the watermark passes work 1's hundred seconds
        [(2, 8, "queued", 9, 180)], [(3, 9, "item", 1, 200), (1, 10, "queued", 6, 200)], [(4, 11, "delta", None, 500)], [(4, 12, "delta", None, 501)],
    ]
    stream = in_batches(spark, tmp_path, batches, schema, "idle")
    assert in_memory(jobs.abandoned(stream, idle_ms=100_000), "back", tmp_path, "append", availableNow=True).awaitTermination(120)
    assert sorted((r.work_id, r.item, r.event_id) for r in spark.table("back").collect()) == [(1, 6, 2), (1, 6, 10), (2, 5, 3), (2, 8, 4), (2, 9, 8)]


def test_totals_at_rest_and_outcomes(spark, tmp_path):
    schema = "work_id long, event_id long, type string, item long, ts long"
    batches = [
        [(1, 1, "item", 1, 10), (1, 4, "done", 0, 40), (2, 5, "failed", 1, 41)], [(1, 2, "failed", 2, 20), (1, 3, "item", 3, 30)],  # late, but within the watermark
        [(2, 6, "paused", 0, 100), (1, 7, "item", 4, 101)], [(1, 8, "done", 0, 150), (2, 9, "item", 1, 160)], [(3, 10, "item", 1, 900)], [(3, 11, "item", 2, 901)],
    ]
    log = spark.createDataFrame([r for part in batches for r in part], schema)
    stream = in_batches(spark, tmp_path, batches, schema, "rest")
    assert in_memory(jobs.terminal_totals(stream, late="60 seconds"), "rest", tmp_path, "append", availableNow=True).awaitTermination(120)
    want = sorted(map(tuple, E.totals_at_rest(log).collect()))
    assert sorted(map(tuple, spark.table("rest").collect())) == want == [(1, 4, "done", 2, 1), (1, 8, "done", 3, 1), (2, 6, "paused", 0, 1)]

    results = [[(1, 1, "failed", 0, 1), (1, 2, "done", 0, 2), (2, 3, "rate-limited", 0, 3)], [(1, 4, "failed", 0, 4), (2, 5, "aborted", 0, 5), (3, 6, "skipped", 0, 6)], [(2, 7, "done", 0, 7), (3, 8, "rate-limited", 0, 8), (1, 9, "rate-limited", 0, 9), (5, 10, "failed", 0, 10)]]
    start = spark.createDataFrame([(1, "pending", None), (2, "reading", None), (3, "edited", None), (4, "pending", None)], "work_id long, status string, applied long")
    table = buckets.Buckets(spark, str(tmp_path / "items"), start.schema, ("work_id",), buckets=4)
    buckets.replace_rows(table, start, version=0)
    came = in_batches(spark, tmp_path, results, schema, "results").withColumnRenamed("type", "result").drop("item", "ts")
    assert jobs.merge_outcomes(came, table, str(tmp_path / "outcomes"), availableNow=True).awaitTermination(120)
    flat = spark.createDataFrame([(w, e, r) for part in results for w, e, r, *_ in part], "work_id long, event_id long, result string")
    want = {(r.work_id, r.status) for r in E.outcomes(flat, start.drop("applied"), key=["work_id"]).collect()}
    assert {(r.work_id, r.status) for r in table.read().collect()} == want == {(1, "validated"), (2, "validated"), (3, "edited"), (4, "pending"), (5, "failed")}
    before = sorted(map(tuple, table.read().collect()))
    again = spark.createDataFrame([(1, 2, "failed")], "work_id long, event_id long, result string").write
    again.json(str(tmp_path / "again"))  # a result that was counted already
    repeat = spark.readStream.schema("work_id long, event_id long, result string").json(str(tmp_path / "again"))
    assert jobs.merge_outcomes(repeat, buckets.Buckets(spark, table.root, table.schema, table.key, 4), str(tmp_path / "outcomes2"), availableNow=True).awaitTermination(120)
    assert table.versions()[-1] == 3 and sorted(map(tuple, table.read().collect())) == before


def test_state_grows_by_entries(spark, tmp_path):
    """A work's text and items in pieces: a batch's rows are as large as what came, not as what there is."""
    n, schema = 4000, "work_id long, event_id long, type string, payload string, item long"
    for k in range(4):
        rows = [(1, k * n + i, "delta", "abcde", None) for i in range(n - 1)] + [(1, k * n + n - 1, "chunk" if k % 2 else "queued", "", k)]
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "pieces" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "pieces" / "*"))
    assert in_memory(jobs.live_text(stream), "long", tmp_path, "append", availableNow=True).awaitTermination(120)
    changes = spark.table("long").orderBy("event_id").collect()
    assert [(r.keep, len(r.added)) for r in changes] == [(5 * (n - 1) * k, 5 * (n - 1)) for k in range(4)]
    assert jobs.text_of(spark.table("long")).first().text == "abcde" * (4 * (n - 1))


def test_the_log_and_late_results(spark, tmp_path):
    """What is recorded survives a repeat; a person's skip outlasts a result that comes later, and only buckets of what came are written."""
    log, stream = item_stream(spark, tmp_path)
    for turn in range(2):  # the second run has nothing new
        query = jobs.record(stream, str(tmp_path / "log"), str(tmp_path / "record"), availableNow=True)
        assert query.awaitTermination(90)
    held = spark.read.parquet(str(tmp_path / "log")).drop("batch")
    assert {r.event_id for r in held.collect()} == {r[1] for r in ITEMS if r[2] not in ("progress", "delta")}
    assert {(r.work_id, r.event_id) for r in jobs.replay(held, n=3).collect()} == {(1, 7), (1, 9), (1, 11), (2, 5), (2, 10)}
    late = held.unionByName(spark.createDataFrame([(1, 20, "item", 7)], "work_id long, event_id long, type string, item long").withColumn("ts", F.current_timestamp()))
    assert not jobs.replay(late).filter("event_id = 20").count()
    pages = spark.createDataFrame([(5, "reading", True), (6, "reading", True), (7, "reading", False), (8, "reading", True)], "page_id long, status string, has_read boolean")
    table = buckets.Buckets(spark, str(tmp_path / "pages"), pages.schema, ("page_id",), buckets=16)
    buckets.replace_rows(table, pages, version=0)
    before = files_of(table.root)
    results = stream.filter("type = 'queued'").selectExpr("item AS page_id", "'ok' AS status", "event_id")
    said = lambda: spark.createDataFrame([(6, "ok", 1), (6, "skipped", 2)], "page_id long, status string, decided long")
    assert jobs.merge_results(results, said, table, str(tmp_path / "merge"), availableNow=True).awaitTermination(90)
    assert {r.page_id: r.status for r in table.read().collect()} == {5: "ok", 6: "skipped", 7: "ok", 8: "reading"} and table.versions() == [2, 3] and table.mark() == 2
    own = spark.createDataFrame([(8,)], "page_id long").select(table.bucket()).first()[0]
    others = {r[0] for r in spark.createDataFrame([(5,), (6,), (7,)], "page_id long").select(table.bucket()).collect()}
    assert own in others or {f for f in before if f"bucket={own}/" in f} <= set(files_of(table.root))


def test_refresh_reads_only_what_changed(spark, tmp_path):
    table = buckets.Buckets(spark, str(tmp_path / "works"), schema_of(spark, "work string, digest string, text string"), ("work",), buckets=16)
    asked = []

    def made(works):
        asked.append(sorted(r.work for r in works.collect()))
        return works.withColumn("text", F.concat(F.lit("made of "), "digest"))

    first = spark.createDataFrame([(f"w{k}", "a") for k in range(12)], "work string, digest string")
    buckets.refresh(table, first, made, version=0)
    before = files_of(table.root)
    second = spark.createDataFrame([(f"w{k}", "b" if k == 3 else "a") for k in range(1, 13)], "work string, digest string")
    buckets.refresh(table, second, made, version=1)
    buckets.refresh(table, second, made, version=2)  # nothing to do
    assert asked == [sorted(f"w{k}" for k in range(12)), ["w12", "w3"]]
    assert {(r.work, r.text) for r in table.read().collect()} == {(f"w{k}", "made of b" if k == 3 else "made of a") for k in range(1, 13)}
    touched = {r[0] for r in spark.createDataFrame([("w0",), ("w3",), ("w12",)], "work string").select(table.bucket()).collect()}
    assert {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched} <= set(files_of(table.root))


def test_image_heads_read_little(spark, tmp_path):
    import struct

    segment = b"\xff\xe1" + struct.pack(">H", 60_002) + b"x" * 60_000
    jpeg = b"\xff\xd8" + segment * 20 + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 600, 800) + b"0" * 500_000
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 9) + b"1" * 1_000_000
    rows = [("a", jpeg), ("b", png), ("c", b""), ("d", jpeg[:70_000]), ("e", None), ("f", b"\xff\xd8\xff\xd8\xff"), ("g", b"GIF89a" + b"\1\0\2\0" + b"x" * 99)]
    images = spark.createDataFrame(rows, "path string, content binary")
    places = files.pack(images, f"file://{tmp_path}/packs").checkpoint()
    heads = files.image_heads(places)
    assert {r.path: r.bytes_read for r in heads.collect()} == {"a": 64 + 21 * 9, "b": 64, "c": 0, "d": 64 + 2 * 9, "e": 0, "f": 5, "g": 64}
    say = lambda frame: {r.path: (r.kind, r.width, r.height, r.refused) for r in files.image_inventory(frame).collect()}
    whole = say(images.filter("content is not null"))
    assert {k: v for k, v in say(heads).items() if k != "e"} == whole and whole["a"] == ("jpeg", 800, 600, None)
    gone = places.withColumn("file", F.concat("file", F.lit("-gone")))
    assert {r.bytes_read for r in files.image_heads(gone).collect()} == {0}
