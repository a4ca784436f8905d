"""Compositions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import leaks, lines, regions, views
from . import layout_plans as L
from . import lines_plans as P
from . import pages_plans as G
from . import quality as Q
from .corpus import ACCENTED, STRIP
from .registry import ORACLES, query, table
from .terms import ENTRIES_SQL, entries_of


@query(
    f"""WITH {L.REGIONS_SQL} SELECT page_id, list_pos, CASE WHEN list_pos % 3 = 0 THEN 'r' || list_pos ELSE region_id END AS region_id, CASE WHEN list_pos % 4 = 0 THEN 0 ELSE list_pos / 10 END AS x, CASE WHEN kind = 'watermark' THEN 'body' ELSE kind END AS kind,
  CASE WHEN list_pos % 5 = 0 THEN list_pos ELSE ord END AS ord FROM regions"""
)
def stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored readings whose fields are partly missing or of the wrong type."""
    k = F.col("list_pos")
    one = F.struct(
        F.when(k % 3 != 0, F.col("region_id")).alias("id"), F.array(F.when(k % 4 == 0, "wide").otherwise((k / 10).cast("string")), F.lit("0"), F.lit("1"), F.lit("1")).alias("box"), "text", "kind", F.when(k % 5 == 0, "first").otherwise(F.col("ord").cast("string")).alias("order"), "join_prev", "join_glue"
    )
    pages = L.regions_of(spark, sf_dir).groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("list_pos", one.alias("r")))), lambda s: s["r"]).alias("regions"))
    return views.load_pages(pages.select("page_id", F.to_json(F.struct("regions")).alias("raw")))[0].select("page_id", "list_pos", "region_id", "x", "kind", "ord")


@query(
    f"""WITH {P.BASE_SQL}, d AS (SELECT page_id, page_id % 4 AS m FROM (SELECT DISTINCT page_id FROM regions) WHERE page_id % 4 <> 3)
SELECT page_id, region_id, CASE WHEN m = 0 THEN (row_number() OVER (PARTITION BY page_id ORDER BY region_id DESC))::INT - 1 WHEN m = 2 THEN list_pos ELSE ord END AS ord FROM regions LEFT JOIN d USING (page_id)"""
)
def order_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that people set, cleared, or that do not fit the page."""
    rows = P.regions_of(spark, sf_dir)
    ids = F.sort_array(F.collect_list("region_id"), asc=False)
    asked = rows.groupBy("page_id").agg(ids.alias("ids")).filter("page_id % 4 <> 3")
    m = F.col("page_id") % 4
    asked = asked.withColumn("ids", F.when(m == 0, F.col("ids")).when(m == 1, F.concat(F.slice("ids", 2, 100), F.array(F.lit("r99")))))
    return views.merge_orders(rows, asked)[0].select("page_id", "region_id", "ord")


@query(f"WITH {P.BASE_SQL} SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY region_id DESC))::INT - 1 AS rank, ' ' || text AS text, region_id AS region_id_hint FROM regions WHERE page_id % 4 = 0")
def stored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as they are stored: words and ids in the order decided."""
    rows = P.regions_of(spark, sf_dir)
    asked = rows.groupBy("page_id").agg(F.sort_array(F.collect_list("region_id"), asc=False).alias("ids")).filter("page_id % 4 = 0")
    return views.merge_orders(rows, asked)[2].select("page_id", "rank", "text", "region_id_hint")


@query(f"WITH {P.BASE_SQL}, n AS (SELECT page_id, string_agg(region_id, '|' ORDER BY ord, list_pos) AS a, string_agg(region_id, '|' ORDER BY list_pos) AS b FROM regions GROUP BY page_id) SELECT page_id, a <> b AS moved FROM n")
def order_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose lines have moved since they were stored."""
    rows = P.regions_of(spark, sf_dir)
    before = rows.groupBy("page_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("list_pos", "region_id"))), lambda s: s["region_id"]), "|"), 256).alias("order_hash"))
    return views.order_notice(before, rows)


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR doc_id % 50 = 0")
def selected_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unread pages and those asked for."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return views.select_items(rows, rows.filter("doc_id % 50 = 0").select("doc_id"), key=["doc_id"], due=F.col("quality").isNull())


@query("SELECT doc_id, toxic IS DISTINCT FROM 1 AS kept FROM documents LEFT JOIN labels USING (doc_id)")
def deleted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays and what goes when a set of ids is deleted (U4)."""
    rows = table(spark, sf_dir, "documents").select("doc_id")
    kept, gone = views.delete_ids(rows, table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), key=["doc_id"])
    return kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))


BOXED_SQL = P.FRESH_SQL.replace("regions AS (SELECT doc_id // 10 AS page_id,", "regions AS (SELECT (doc_id % 4) / 4.0 AS x, 0.1 AS y, 0.2 AS h, doc_id // 10 AS page_id,", 1)
PAYLOAD_SQL = f"""{BOXED_SQL}, {L.RTL}, firsts AS (SELECT *, min(CASE WHEN kind IN {L.TRANSLATED_SQL} THEN ord END) OVER (PARTITION BY page_id, panel) AS f FROM rtl),
numbered AS (SELECT *, CASE WHEN f IS NULL THEN 0 ELSE dense_rank() OVER (PARTITION BY page_id ORDER BY f NULLS LAST) END::INT AS number FROM firsts)"""


@query(f"WITH {PAYLOAD_SQL} SELECT r.page_id, r.region_id, r.proposed, r.number, f.state, l.english, r.w > 0 AS drawable FROM numbered r LEFT JOIN fresh f USING (page_id, region_id) LEFT JOIN lines l ON f.state IS NOT NULL AND l.page_id = r.page_id AND l.region_id = r.region_id")
def page_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a reader's payload (J22): order proposed, panel, line and its state, whether it can be drawn."""
    return views.page_payload(P.regions_of(spark, sf_dir), P.lines_of(spark, sf_dir)).select("page_id", "region_id", "proposed", "number", "state", "english", "drawable")


@query(f"WITH {L.NUMBER_SQL} SELECT page_id, region_id, kind, number, (row_number() OVER (PARTITION BY page_id ORDER BY ord, list_pos) - 1)::INT AS place, sha256(text) AS source_hash FROM numbered WHERE kind IN {regions.TRANSLATED}")
def script_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to translate, in order, with panel and hash."""
    return views.script_lines(L.regions_of(spark, sf_dir)).drop("text")


@query(f"WITH {P.CORRECTED_SQL}, w AS (SELECT DISTINCT page_id FROM regions), n AS (SELECT page_id, lag(page_id) OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS previous, lead(page_id) OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS next FROM w) SELECT page_id, region_id, ord, CASE WHEN ok THEN t ELSE ' ' || text END AS text, ' ' || text AS original, ok AS corrected, previous, next, page_id % 5 AS corrected_at, CASE WHEN page_id % 7 <> 3 THEN 2 END AS built_at, page_id % 7 <> 3 AND page_id % 5 > 2 AS rebuild FROM (SELECT r.*, t, coalesce(trim(f) = text, FALSE) AS ok FROM regions r LEFT JOIN c USING (page_id, region_id)) JOIN n USING (page_id)")
def page_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for checking, with the machine's words beside."""
    rows = P.regions_of(spark, sf_dir)
    pages = rows.select("page_id").distinct().withColumns({"work_id": F.col("page_id") % 7, "ord": F.col("page_id")})
    pages = pages.withColumn("corrected_at", F.col("page_id") % 5)
    builds = pages.select("work_id", F.when(F.col("work_id") != 3, 2).alias("built_at")).distinct()
    return views.check_view(pages, rows, P._corrections(rows), builds)


@query("SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN CASE WHEN doc_id % 3 = 1 THEN 'ok' WHEN doc_id % 2 = 0 THEN 'needs-check' ELSE 'new' END ELSE 'edited' END AS status FROM documents")
def resting_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where abandoned work goes back to."""
    d = F.col("doc_id")
    now = F.when(d % 4 == 0, "queued").when(d % 4 == 1, "reading").otherwise("edited")
    before = F.when(d % 3 == 1, "ok").when(d % 3 == 2, "queued")
    return table(spark, sf_dir, "documents").select("doc_id", views.resting_status(now, before, d % 2 == 0).alias("status"))


@query(
    f"""WITH {ENTRIES_SQL}, s AS (SELECT item_id, string_agg(spelling, ' / ' ORDER BY r) AS sp FROM spelled GROUP BY item_id),
l AS (SELECT item_id % 5 AS k, type, source, '  ' || sp || ' = ' || english || CASE WHEN item_id % 4 = 0 THEN '  [it]' ELSE '  [she]' END AS line FROM entries JOIN s USING (item_id) WHERE source <> ''),
n AS (SELECT string_agg('  ' || english, chr(10) ORDER BY type, english) AS names FROM entries WHERE source = '')
SELECT k, '{views.LOCKED}' || chr(10) || string_agg(line, chr(10) ORDER BY type, source, line) || CASE WHEN names IS NULL THEN '' ELSE chr(10) || chr(10) || '{views.KNOWN}' || chr(10) || names END AS block FROM l, n GROUP BY k, names"""
)
def glossary_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary blocks as they go into requests (C14)."""
    entries = entries_of(spark, sf_dir)
    hits = entries.select("item_id", (F.col("item_id") % 5).alias("k"))
    return views.prompt_block(entries, hits, key=["k"], entry=["item_id"])


def _responses(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every turn of a conversation as an attempt at its first one; terms come after the text, some with commentary before it."""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("turn", "attempt")
    c = F.col("conv_id").cast("string")
    term = F.concat(F.lit('[{"source":"s'), (F.col("conv_id") % 40).cast("string"), F.lit('","english":"'), F.when(F.col("conv_id") % 7 == 2, "known").otherwise(F.concat(F.lit("E"), c)), F.lit('","pronoun":"'), F.when(F.col("conv_id") % 2 == 0, "She").otherwise("Female"), F.lit('","note":"n'), c, F.lit('"}]'))
    usage = F.create_map(F.lit("tokens"), F.length("text").cast("long"))
    before = F.when(F.col("attempt") % 3 == 1, F.lit("### done\n")).otherwise("")
    attempts = rows.select("conv_id", "attempt", F.concat(before, "text", F.lit("\n===NEW_TERMS===\n"), term).alias("raw"), usage.alias("usage"), F.lit(0.5).cast("decimal(18,6)").alias("cost_usd"))
    sources = rows.filter("attempt = 0").select("conv_id", F.col("text").alias("source"), F.sha2("text", 256).alias("content_hash"))
    old = F.lit("2024-01-01").cast("timestamp")
    state = rows.filter("conv_id % 2 = 0").select("conv_id").distinct().withColumns({"status": F.lit("prepared"), "source_hash": F.lit("old"), "attempts": F.lit(0).cast("long"), "created_at": old, "updated_at": old})
    entries = spark.createDataFrame([("s3", "Known", [], "thing", "")], "source string, english string, variants array<string>, type string, reading string")
    pending = spark.createDataFrame([("s5",)], "source string")
    rules = {"residue": Q.RESIDUE, "chatter": Q.CHATTER, "rules": Q.RULES, "between": Q.LINE, "glue": "\n"}
    return views.merge_responses(attempts, sources, key=["conv_id"], script=ACCENTED, state=state, pending=pending, entries=entries, now=F.lit("2024-02-01").cast("timestamp"), **rules)


BEST_SQL = f"""raws AS (SELECT conv_id * 1000 + turn AS k, conv_id, turn, text FROM conversations),
bodies AS (WITH {Q.verdict_sql('raws', 'k', 'text')} SELECT k, {STRIP % "coalesce(string_agg(b, chr(10) ORDER BY place) FILTER (verdict <> 'remove'), '')"} AS output FROM raws LEFT JOIN judged USING (k) GROUP BY k),
p AS (SELECT k, conv_id, turn, coalesce((SELECT text FROM conversations c WHERE c.conv_id = raws.conv_id AND c.turn = 0), '') AS source, output FROM raws JOIN bodies USING (k)), {Q.pairs_sql()},
best AS (SELECT conv_id, arg_min(turn, len(failures) * 1000000 + turn) AS attempt, min(len(failures)) AS n_failures, min(len(failures)) = 0 AS ok, count(*) AS n FROM f GROUP BY conv_id)"""


@query(f"WITH {BEST_SQL} SELECT best.conv_id, attempt, ok, n_failures::INT AS n_failures, sha256(f.output) AS body, f.failures, f.residual_fraction, f.findings FROM best JOIN f ON f.conv_id = best.conv_id AND f.turn = best.attempt")
def response_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best attempt of each conversation, parsed, validated and audited (R2)."""
    found = _responses(spark, sf_dir)["audit"]
    return found.select("conv_id", "attempt", "ok", "n_failures", F.sha2("body", 256).alias("body"), "failures", "residual_fraction", F.size("findings").cast("long").alias("findings"))


@query(f"WITH {BEST_SQL} SELECT best.conv_id, CASE WHEN ok THEN 'validated' ELSE 'needs-review' END AS status, sha256(source) AS source_hash, n AS attempts, CASE WHEN best.conv_id % 2 = 0 THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-02-01' END AS created_at FROM best JOIN p ON p.conv_id = best.conv_id AND p.turn = 0")
def response_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State rows after the merge (R2)."""
    return _responses(spark, sf_dir)["state"].drop("updated_at")


@query("SELECT sum(length(text))::BIGINT AS tokens, (count(*) * 0.5)::DECIMAL(18,6) AS cost_usd FROM conversations")
def response_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attempt is paid for (R2)."""
    return _responses(spark, sf_dir)["ledger"].agg(F.sum(F.col("usage")["tokens"]).alias("tokens"), F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"))


@query(f"WITH {BEST_SQL}, t AS (SELECT 's' || (conv_id % 40) AS source, min(conv_id) AS c FROM best WHERE ok AND conv_id % 40 NOT IN (3, 5) AND conv_id % 7 <> 2 GROUP BY ALL) SELECT source, 'E' || c AS english, CASE WHEN c % 2 = 0 THEN 'she' ELSE '' END AS pronoun, 'n' || c AS note, 'other' AS type FROM t")
def response_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New terms of accepted answers wait for a decision with what they say of themselves; known and waiting ones don't come again (R2)."""
    return _responses(spark, sf_dir)["pending"].select("source", "english", "pronoun", "note", "type")


@query(f"WITH {BEST_SQL} SELECT DISTINCT 's3' AS \"of\", 's' || (conv_id % 40) AS source FROM best WHERE ok AND conv_id % 40 NOT IN (3, 5) AND conv_id % 7 = 2")
def response_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms whose English an entry has already, in another spelling."""
    return _responses(spark, sf_dir)["variants"]


@query("SELECT doc_id AS asked, (SELECT min(doc_id) FROM documents e WHERE e.text = d.text) AS found FROM documents d WHERE doc_id % 7 = 0 AND text IS NOT NULL")
def page_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups by hash: the first page with those words."""
    rows = table(spark, sf_dir, "documents").filter("text is not null").select(F.col("doc_id").alias("found"), F.sha2("text", 256).alias("sha256"))
    asked = rows.filter("found % 7 = 0").select(F.col("found").alias("asked"), "sha256")
    return views.find(rows, asked, ["sha256"], ["found"]).select("asked", "found")


@query(f"WITH {P.CARRY_SQL}, carried AS (SELECT page_id, region_id, english FROM (FROM settled UNION ALL FROM stranded)) SELECT page_id, region_id, CASE WHEN l.english_source = 'user' OR r.list_pos % 2 = 1 OR r.list_pos IS NULL THEN c.english ELSE 'machine' END AS english FROM (SELECT s.*, l0.english_source FROM (FROM settled UNION ALL FROM stranded) s JOIN lines l0 ON l0.page_id = s.page_id AND l0.region_id = s.from_id) l JOIN carried c USING (page_id, region_id) LEFT JOIN regions r USING (page_id, region_id) UNION ALL SELECT page_id, region_id, 'machine' FROM regions r WHERE list_pos % 2 = 0 AND NOT EXISTS (FROM carried c WHERE c.page_id = r.page_id AND c.region_id = r.region_id)")
def reread_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines after a new reading and new machine lines."""
    rows = P.regions_of(spark, sf_dir)
    incoming = rows.filter("list_pos % 2 = 0").select("page_id", "region_id", F.lit("machine").alias("english"), F.lit("h").alias("source_hash"), F.lit("model").alias("english_source"), F.lit("x").alias("speaker"), F.lit("model").alias("speaker_source"))
    pages = rows.select("page_id", F.lit("reading").alias("status")).distinct()
    return views.reconcile(rows, P.lines_of(spark, sf_dir), incoming, pages, pages)[0].select("page_id", "region_id", "english")


@query(f"WITH {Q.clean_sql('documents', 'doc_id', 'text')}, {Q.RUN_SQL % {'key': 'doc_id'}} SELECT doc_id, line, place, score FROM scored WHERE score >= {Q.RESIDUE.flag_at} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line, place) <= 4")
def worst_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four worst findings of each text (L2)."""
    rows = leaks.reported(Q._clean_documents(spark, sf_dir), Q.RESIDUE)
    worst = F.slice(F.array_sort(F.transform("found", lambda f: F.struct((-f["score"]).alias("s"), f["line"].alias("line"), f["place"].alias("place")))), 1, 4)
    return rows.select("doc_id", F.explode(worst).alias("f")).select("doc_id", "f.line", "f.place", (-F.col("f.s")).alias("score"))


def _named(names: str, kind: str) -> F.Column:
    return F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))


@query(f"""WITH v AS ({ORACLES['validate_pairs']}), n AS (SELECT 'failure' AS kind, unnest(failures) AS name FROM v UNION ALL SELECT 'warning', unnest(warnings) FROM v UNION ALL SELECT 'status', CASE WHEN ok THEN 'ok' ELSE 'needs-review' END FROM v)
SELECT kind, name, count(*) AS pairs FROM n GROUP BY ALL""")
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue, commentary, ratio, dialogue and surface over all pairs, and how many are ready."""
    rows = Q.validate_pairs(spark, sf_dir)
    status = F.when(F.col("ok"), "ok").otherwise("needs-review")
    named = F.concat(*[_named(c, kind) for c, kind in (("failures", "failure"), ("warnings", "warning"))], F.array(F.struct(F.lit("status").alias("kind"), status.alias("name"))))
    return rows.select(F.explode(named).alias("n")).groupBy("n.kind", "n.name").agg(F.count("*").alias("pairs"))


@query("SELECT source, count(*) AS pages, count(*) FILTER (quality IS NOT NULL) AS judged FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def page_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing that never reads the texts (P18): only two columns reach the scan."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("pages"), F.count("quality").alias("judged"))


@query(f"WITH {G.PAGES_SQL}, t AS (SELECT *, regexp_matches(text, '[^\\s]') AS seen FROM pages_) SELECT work_id, count(*) AS pages, count(*) FILTER (seen AND status IN ('ok', 'edited')) AS used, count(*) FILTER (status = 'skipped') AS skipped FROM t GROUP BY work_id")
def build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages used and left out of a build."""
    rows = G.pages_of(spark, sf_dir)
    used = F.col("text").rlike(r"[^\s]") & F.col("status").isin("ok", "edited")
    return rows.groupBy("work_id").agg(F.count("*").alias("pages"), F.count_if(used).alias("used"), F.count_if(F.col("status") == "skipped").alias("skipped"))


BUILD_SQL = f"""{P.BASE_SQL}, o AS (SELECT *, CASE WHEN page_id % 5 = 2 THEN row_number() OVER (PARTITION BY page_id ORDER BY -list_pos) - 1 ELSE ord END AS place FROM regions),
r AS (SELECT *, CASE WHEN list_pos % 3 = 1 THEN 'right ' || list_pos ELSE text END AS now FROM o WHERE kind IN {regions.PROSE}),
t AS (SELECT page_id, string_agg(now, chr(10) || chr(10) ORDER BY place, list_pos) AS text FROM r GROUP BY page_id),
every AS (SELECT DISTINCT page_id, page_id // 8 AS work_id, page_id % 8 = 4 AS cut FROM regions WHERE page_id % 9 <> 4), p AS (SELECT * FROM every JOIN t USING (page_id))"""


def _built(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Pages of readings with corrections, orders that people saved, and their seams."""
    rows = P.regions_of(spark, sf_dir).withColumns({"join_prev": F.lit(""), "join_glue": F.lit("none")})
    k = F.col("page_id")
    cut = k % 8 == 4
    flags = {c: F.lit(False) for c in ("ends_mid_word", "ends_mid_sentence", "starts_mid_sentence")}
    pages = rows.select("page_id").distinct().select(
        "page_id", F.floor(k / 8).cast("long").alias("work_id"), k.alias("ord"), k.alias("seq"), F.when(k % 9 == 4, "skipped").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("heading"),
        F.when(cut, "chapter").otherwise("").alias("join_prev"), F.lit("none").alias("join_glue"), F.when(cut, "user").otherwise("model").alias("join_prev_source"), *[v.alias(c) for c, v in flags.items()],
    )
    fixed = rows.filter("list_pos % 3 = 1").select("page_id", "region_id", F.col("text").alias("from_text"), F.concat(F.lit("right "), F.col("list_pos").cast("string")).alias("to_text"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(-F.col("list_pos"))) - 1
    saved = rows.filter(k % 5 == 2).select("page_id", rank.alias("rank"), "text", F.col("region_id").alias("region_id_hint"))
    lost = rows.filter((k % 5 == 3) & (F.col("list_pos") > 0)).select("page_id", F.col("list_pos").alias("rank"), "text", F.col("region_id").alias("region_id_hint"))
    begins = F.sum(cut.cast("int")).over(Window.partitionBy("work_id").orderBy("page_id"))
    runs = pages.filter("status <> 'skipped'").withColumn("g", begins).groupBy("work_id", "g").agg(F.sort_array(F.collect_list("page_id")).alias("page_ids"))
    old = runs.select("work_id", F.when(F.col("work_id") % 2 == 0, F.col("page_ids")).otherwise(F.slice("page_ids", 2, 100)).alias("page_ids"), F.lit("done").alias("status"))
    return views.build_pages(rows, fixed, pages, saved=saved.unionByName(lost), old=old)


@query(
    f"""WITH {BUILD_SQL}, g AS (SELECT *, sum((cut OR n = 1)::INT) OVER (PARTITION BY work_id ORDER BY page_id)::INT AS idx FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY page_id) AS n FROM p))
SELECT work_id, idx, sha256(string_agg(text, chr(10) || chr(10) ORDER BY page_id)) AS text, count(*) AS pages FROM g GROUP BY work_id, idx"""
)
def page_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings to chapters in one plan (R4): saved orders and corrections laid over, seams proposed where no person set one, a user's seam begins a chapter."""
    return _built(spark, sf_dir)["chapters"].select("work_id", "idx", F.sha2("text", 256).alias("text"), "pages")


@query(
    f"""WITH {BUILD_SQL}, g AS (SELECT *, sum((cut OR n = 1)::INT) OVER (PARTITION BY work_id ORDER BY page_id)::INT AS idx FROM (SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY page_id) AS n FROM every))
SELECT work_id, idx, min(page_id) AS start_seq, max(page_id) AS end_seq, count(*) AS pages, CASE WHEN work_id % 2 = 0 THEN 'done' ELSE 'new' END AS status FROM g GROUP BY work_id, idx"""
)
def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the same build with the status of an old run of exactly the same pages."""
    return _built(spark, sf_dir)["spans"].select("work_id", "idx", "start_seq", "end_seq", F.size("page_ids").cast("long").alias("pages"), "status")


@query(f"WITH {P.BASE_SQL} SELECT DISTINCT page_id, 'order-lost' AS note FROM regions WHERE page_id % 5 = 3")
def build_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What people saved and no longer fits (R4, J9): orders that leave a region out."""
    return _built(spark, sf_dir)["notes"]


@query(f"WITH {L.CHECK_SQL} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'skipped' ELSE 'ok' END AS status, disagreement FROM per")
def page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages after their reads came in (J13, R6): a skip stands, the order check is made anew."""
    rows = L.regions_of(spark, sf_dir)
    pages = rows.select("page_id").distinct().withColumn("status", F.when(F.col("page_id") % 3 == 0, "skipped").otherwise("reading"))
    results = pages.select("page_id", F.lit("ok").alias("status"), F.lit("w").alias("work_id"), F.create_map(F.lit("tokens"), F.lit(1)).alias("usage"), F.lit(0.1).alias("cost_usd"))
    merged, _ = lines.apply_reads(pages.withColumns({"looks_reversed": F.lit(None).cast("boolean"), "disagreement": F.lit(None).cast("long")}), results, rows)
    return merged.select("page_id", "status", "disagreement")
