"""Layout and region queries; boxes come from `embeddings`, eight regions to a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalars import box_drawable, box_inside, box_percent, box_to_pixels, document_id, pixels_to_box, safe_label
from ..operators import layout, regions
from .registry import query, table

KINDS = ("bubble", "furigana", "body", "sfx", "page-number", "watermark", "odd")
PER_PAGE = 8


def regions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    side = [F.get(e, F.lit(k)).cast("double") for k in range(4)]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", *[s.alias(f"e{k}") for k, s in enumerate(side)])
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("vec_id") % len(KINDS) + 1).cast("int"))
    return rows.select(
        F.floor(F.col("vec_id") / PER_PAGE).cast("long").alias("page_id"), (F.col("vec_id") % PER_PAGE).cast("int").alias("list_pos"), F.concat(F.lit("r"), (F.col("vec_id") % 7).cast("string")).alias("region_id"),
        (F.col("e0") * 2 + 0.5).alias("x"), (F.col("e1") * 2 + 0.5).alias("y"), F.greatest(F.col("e2"), F.lit(-0.01)).alias("w"), F.greatest(F.col("e3"), F.lit(-0.01)).alias("h"),
        F.concat(F.lit("text "), F.col("vec_id").cast("string")).alias("text"), kind.alias("kind"), F.pmod(F.col("vec_id") * 3, F.lit(PER_PAGE)).cast("int").alias("ord"),
        F.when(F.col("vec_id") % 9 == 0, "chapter").when(F.col("vec_id") % 9 == 1, "never").otherwise("").alias("join_prev"), F.lit("none").alias("join_glue"),
    )


REGIONS_SQL = f"""regions AS (
  SELECT vec_id // {PER_PAGE} AS page_id, (vec_id % {PER_PAGE})::INT AS list_pos, 'r' || (vec_id % 7) AS region_id, embedding[1]::DOUBLE * 2 + 0.5 AS x, embedding[2]::DOUBLE * 2 + 0.5 AS y,
    greatest(embedding[3]::DOUBLE, -0.01) AS w, greatest(embedding[4]::DOUBLE, -0.01) AS h, 'text ' || vec_id AS text, {list(KINDS)}[vec_id % {len(KINDS)} + 1] AS kind, (vec_id * 3 % {PER_PAGE})::INT AS ord,
    CASE vec_id % 9 WHEN 0 THEN 'chapter' WHEN 1 THEN 'never' ELSE '' END AS join_prev, 'none' AS join_glue FROM embeddings
)"""


def order_sql(name: str, direction: str) -> str:
    """The same cut as nested queries: a running farthest edge, a count of new parts, and the path so far."""
    steps = [f"{name}0 AS (SELECT *, x AS x0, y AS y0, x + greatest(0, w) AS x1, y + greatest(0, h) AS y1, '' AS path FROM regions)"]
    for k in range(layout.PASSES):
        a = "yx"[k % 2]
        number = "999999 - sum(fresh) OVER v" if direction == "rtl" and a == "x" else "sum(fresh) OVER v"
        steps.append(
            f"{name}{k + 1} AS (SELECT * EXCLUDE (path, fresh), path || lpad(({number})::BIGINT::VARCHAR, 6, '0') AS path FROM ("
            f"SELECT *, coalesce({a}0 >= max({a}1) OVER (PARTITION BY page_id, path ORDER BY {a}0, {a}1, list_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {layout.SLACK}, FALSE)::INT AS fresh FROM {name}{k})"
            f" WINDOW v AS (PARTITION BY page_id, path ORDER BY {a}0, {a}1, list_pos ROWS UNBOUNDED PRECEDING))"
        )
    across = "-x1" if direction == "rtl" else "x0"
    drawn = "max((x1 > x0 AND y1 > y0)::INT) OVER (PARTITION BY page_id) = 1"
    steps.append(
        f"{name} AS (SELECT * EXCLUDE (p, d), row_number() OVER (PARTITION BY page_id ORDER BY p, CASE WHEN d THEN {across} ELSE 0 END, CASE WHEN d THEN y0 ELSE 0 END, list_pos)::INT - 1 AS proposed,"
        f" dense_rank() OVER (PARTITION BY page_id ORDER BY p)::INT - 1 AS panel FROM (SELECT *, d AS dd, CASE WHEN d THEN path ELSE '' END AS p FROM (SELECT *, {drawn} AS d FROM {name}{layout.PASSES})))"
    )
    return ", ".join(steps)


RTL, LTR = order_sql("rtl", "rtl"), order_sql("ltr", "ltr")


@query(f"WITH {REGIONS_SQL}, {RTL} SELECT page_id, list_pos, proposed FROM rtl")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.exact_order(regions_of(spark, sf_dir)).select("page_id", "list_pos", "proposed")


@query(f"WITH {REGIONS_SQL}, {LTR} SELECT page_id, list_pos, proposed FROM ltr")
def reading_order_ltr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.exact_order(regions_of(spark, sf_dir), direction="ltr").select("page_id", "list_pos", "proposed")


@query(f"WITH {REGIONS_SQL}, {RTL} SELECT page_id, list_pos, panel FROM rtl")
def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.exact_order(regions_of(spark, sf_dir)).select("page_id", "list_pos", "panel")


CHECK_SQL = f"""{REGIONS_SQL}, {RTL}, {LTR}, now AS (SELECT page_id, list_pos, row_number() OVER (PARTITION BY page_id ORDER BY ord, list_pos)::INT - 1 AS now FROM regions),
per AS (SELECT page_id, count(*) AS regions, count(*) FILTER (now <> rtl.proposed) AS disagreement,
  count(*) >= 2 AND max((rtl.w > 0 AND rtl.h > 0)::INT) = 1 AND bool_and(now = ltr.proposed) AND NOT bool_and(ltr.proposed = rtl.proposed) AS reversed
  FROM now JOIN rtl USING (page_id, list_pos) JOIN ltr USING (page_id, list_pos) GROUP BY page_id)"""


#: Pages of boxes that halve what is left, down and across in turn: a page of n boxes needs n passes.
NESTED_SQL = "nested AS (SELECT doc_id AS page_id, n, unnest(range(n)) AS k FROM (SELECT doc_id, 1 + length(coalesce(text, '')) % 18 AS n FROM documents))"


def nested_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = 1 + F.length(F.coalesce("text", F.lit(""))) % 18
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.explode(F.sequence(F.lit(0), n - 1)).alias("list_pos"))
    k = F.col("list_pos")
    down, across = F.pow(F.lit(0.5), F.ceil(k / 2)), F.pow(F.lit(0.5), F.floor(k / 2))
    even = k % 2 == 0
    return rows.select("page_id", "list_pos", (1 - across).alias("x"), (1 - down).alias("y"), F.when(even, across).otherwise(across / 2).alias("w"), F.when(even, down / 2).otherwise(down).alias("h"), k.alias("ord"))


@query(f"WITH {NESTED_SQL} SELECT page_id, k::INT AS list_pos, (CASE WHEN k % 2 = 0 THEN k // 2 ELSE n - 1 - k // 2 END)::INT AS proposed, (CASE WHEN k % 2 = 0 THEN k // 2 ELSE n - 1 - k // 2 END)::INT AS panel FROM nested")
def nested_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order of pages cut up to eighteen times (W1, W2): what is below comes after, what is to the right before."""
    return layout.exact_order(nested_of(spark, sf_dir), slack=0).select("page_id", "list_pos", "proposed", "panel")


@query(f"WITH {NESTED_SQL} SELECT page_id, count(*) AS regions, count(*) FILTER (k <> CASE WHEN k % 2 = 0 THEN k // 2 ELSE n - 1 - k // 2 END) AS disagreement, n >= 3 AS reversed FROM nested GROUP BY page_id, n")
def nested_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order check of such pages (A12, W11): their given order is that from left to right."""
    return layout.check(nested_of(spark, sf_dir), slack=0)


@query(f"WITH {CHECK_SQL} SELECT page_id, regions, disagreement FROM per")
def order_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.check(regions_of(spark, sf_dir)).drop("reversed")


@query(f"WITH {CHECK_SQL.replace('ORDER BY ord, list_pos)::INT - 1 AS now FROM regions', 'ORDER BY x + list_pos * 0, list_pos)::INT - 1 AS now FROM regions')} SELECT page_id, reversed FROM per")
def reversed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose order (here: by left edge) is that of the other direction."""
    from pyspark.sql import Window

    rows = regions_of(spark, sf_dir)
    return layout.check(rows.withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("x", "list_pos")))).select("page_id", "reversed")


TRANSLATED_SQL = str(regions.TRANSLATED)
NUMBER_SQL = f"""{REGIONS_SQL}, {RTL}, firsts AS (SELECT *, min(CASE WHEN kind IN {TRANSLATED_SQL} THEN ord END) OVER (PARTITION BY page_id, panel) AS f FROM rtl),
numbered AS (SELECT page_id, list_pos, region_id, kind, text, ord, CASE WHEN f IS NULL THEN 0 ELSE dense_rank() OVER (PARTITION BY page_id ORDER BY f NULLS LAST) END::INT AS number FROM firsts)"""


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.panel_numbers(layout.exact_order(regions_of(spark, sf_dir)))


@query(f"WITH {NUMBER_SQL} SELECT page_id, list_pos, number FROM numbered")
def panel_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(spark, sf_dir).select("page_id", "list_pos", "number")


@query(f"WITH {NUMBER_SQL} SELECT page_id, list_pos, sum(c) OVER (PARTITION BY page_id ORDER BY ord, list_pos ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT *, coalesce((lag(number) OVER (PARTITION BY page_id ORDER BY ord, list_pos) <> number)::INT, 0) AS c FROM numbered)")
def panel_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.panel_runs(numbered(spark, sf_dir)).select("page_id", "list_pos", "run")


@query(
    f"""WITH {NUMBER_SQL}, l AS (SELECT *, lag(number) OVER (PARTITION BY page_id ORDER BY ord, list_pos) AS before FROM numbered WHERE kind IN {TRANSLATED_SQL})
SELECT page_id, string_agg(CASE WHEN before IS DISTINCT FROM number THEN '[panel ' || number || ']' || chr(10) ELSE '' END || region_id || chr(9) || kind || chr(9) || text, chr(10) ORDER BY ord, list_pos) AS block FROM l GROUP BY page_id"""
)
def header_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_blocks(numbered(spark, sf_dir).filter(F.col("kind").isin(*regions.TRANSLATED)))


@query(
    f"""WITH {REGIONS_SQL} SELECT page_id, list_pos, w >= 0 AND h >= 0 AND x >= -1e-6 AND y >= -1e-6 AND x + w <= 1 + 1e-6 AND y + h <= 1 + 1e-6 AS inside,
  w > 0 AND h > 0 AND least(1, x + w) - greatest(0, x) > 0 AND least(1, y + h) - greatest(0, y) > 0 AS drawable FROM regions"""
)
def box_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [F.col(c) for c in ("x", "y", "w", "h")]
    return regions_of(spark, sf_dir).select("page_id", "list_pos", box_inside(*sides).alias("inside"), box_drawable(*sides).alias("drawable"))


@query(
    f"""WITH {REGIONS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, region_id ORDER BY list_pos) > 1 AS again, w >= 0 AND h >= 0 AND x >= -1e-6 AND y >= -1e-6 AND x + w <= 1 + 1e-6 AND y + h <= 1 + 1e-6 AS inside FROM regions),
o AS (SELECT page_id, list_pos, unnest([CASE WHEN again THEN 'duplicate-id' END, CASE WHEN NOT inside THEN 'box' END, CASE WHEN kind NOT IN {regions.KINDS} THEN 'kind' END, CASE WHEN join_prev <> '' AND join_prev NOT IN {regions.JOINS} THEN 'join' END]) AS problem FROM r)
SELECT * FROM o WHERE problem IS NOT NULL UNION ALL SELECT page_id, NULL, 'order' FROM regions GROUP BY page_id HAVING NOT (count(*) = count(DISTINCT ord) AND min(ord) = 0 AND max(ord) = count(*) - 1)
UNION ALL SELECT DISTINCT page_id, NULL, 'size' FROM regions WHERE page_id % 5 = 0 UNION ALL SELECT DISTINCT page_id, NULL, 'confidence' FROM regions WHERE page_id % 3 = 0"""
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions_of(spark, sf_dir)
    meta = rows.select("page_id").distinct().select("page_id", F.when(F.col("page_id") % 5 == 0, 0.0).otherwise(900.0).alias("width"), F.lit(1200.0).alias("height"), F.when(F.col("page_id") % 3 == 0, "sure").otherwise("high").alias("confidence"))
    return regions.violations(rows, meta)


FURNITURE_TEXT = f"CASE page_id % 7 WHEN 6 THEN 'scans.' || split_part('{T.TOP_LEVELS}', '|', cast(page_id % {len(T.TOP_LEVELS.split('|'))} + 1 AS int))" + " WHEN 0 THEN '- ' || page_id || ' -' WHEN 1 THEN split_part(split_part(url, '://', 2), '/', 1) WHEN 2 THEN 'www.' || split_part(split_part(url, '://', 2), '/', 1) || '/a' WHEN 3 THEN 'Ｎｏ．' || page_id WHEN 4 THEN ' ～' || (page_id % 10) || '～ ' ELSE url END"


@query(
    f"""WITH t AS (SELECT page_id, {FURNITURE_TEXT} AS text, ['body', 'watermark', 'page-number'][page_id % 3 + 1] AS kind FROM pages),
f AS (SELECT *, {'regexp_replace(translate(text, %s, %s), %s, %s, %s)' % ("'" + "".join(T.SINGLE).replace("'", "''") + "'", "'" + "".join(T.SINGLE.values()).replace("'", "''") + "'", f"'\\A[{T.SPACE}]+|[{T.SPACE}]+\\z'", "''", "'g'")} AS plain FROM t),
g AS (SELECT *, CASE WHEN plain = '' THEN NULL WHEN regexp_matches(plain, '{T.PAGE_NUMBER}') THEN 'page-number' WHEN regexp_matches(lower(plain), '{T.WEB_ADDRESS}') THEN 'watermark' END AS found FROM f),
k AS (SELECT *, CASE WHEN kind = 'watermark' AND found IS DISTINCT FROM 'watermark' THEN 'body' WHEN kind IN {regions.FURNITURE} THEN kind ELSE coalesce(found, kind) END AS new FROM g)
SELECT page_id, text, new AS kind, new <> kind AS changed FROM k"""
)
def furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(FURNITURE_TEXT).alias("text"), F.element_at(F.array(F.lit("body"), F.lit("watermark"), F.lit("page-number")), (F.col("page_id") % 3 + 1).cast("int")).alias("kind"))
    return regions.mark_furniture(rows)


@query(f"WITH {REGIONS_SQL} SELECT kind, kind IN {regions.FURNITURE} AS is_furniture, kind IN {TRANSLATED_SQL} AS is_translated, count(*) AS n FROM regions WHERE kind IN {regions.KINDS} GROUP BY ALL")
def kind_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions by the sets their kind belongs to (P4, U1): a join to the table of kinds."""
    kinds = regions.kind_table(spark).select("kind", "is_furniture", "is_translated")
    return regions_of(spark, sf_dir).join(F.broadcast(kinds), "kind").groupBy("kind", "is_furniture", "is_translated").agg(F.count("*").alias("n"))


READS_SQL = f"""{REGIONS_SQL}, p AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN 900 ELSE 450 END AS pw, CASE WHEN page_id % 2 = 0 THEN 1200 ELSE 600 END AS ph FROM regions WHERE page_id % 4 <> 3)"""


def page_reads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Responses (JSON amid other words, boxes in pixels of 900 x 1200, one page in four unusable) and measured sizes, of which every second is missing; pages say half that size, some of them turned."""
    rows = regions_of(spark, sf_dir)
    box = F.array(F.col("x") * 900 + 0.0, F.col("y") * 1200, F.col("w") * 900, F.col("h") * 1200)
    one = F.struct(F.when(F.col("list_pos") % 5 == 4, " ").otherwise(F.concat(F.lit(" "), F.col("text"), F.lit("\n"))).alias("text"), "kind", box.alias("box"), F.col("ord").cast("string").alias("order"), "join_prev", "join_glue")
    page = rows.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("list_pos", one.alias("r")))), lambda s: s["r"]).alias("regions"))
    k = F.col("page_id")
    turned = k % 6 == 0
    meta = F.struct(F.when(k % 5 == 0, "sure").otherwise(" High").alias("confidence"), F.when(k % 7 == 0, F.concat(F.lit(" Part "), k.cast("string"))).alias("heading"), (k % 3 == 0).alias("ends_mid_sentence"), F.when(k % 3 == 1, "yes").alias("starts_mid_sentence"), F.array(F.lit("n"), F.lit(" ")).alias("notes"))
    text = F.to_json(F.struct(F.when(turned, 1200).otherwise(450).alias("width"), F.when(turned, 900).otherwise(600).alias("height"), meta.alias("meta"), "regions"))
    raw = F.when(k % 4 == 3, "I can't read this {page").otherwise(F.concat(F.lit("Here it is:\n```json\n"), text, F.lit("\n```")))
    sizes = page.filter("page_id % 2 = 0").select("page_id", F.lit(900.0).alias("width"), F.lit(1200.0).alias("height"))
    return page.select("page_id", raw.alias("raw")), sizes


@query(
    f"""WITH {READS_SQL} SELECT page_id, list_pos, 'r' || list_pos AS region_id, text, round(x * 900 / pw, 6) AS x, round(h * 1200 / ph, 6) AS h, CASE WHEN kind IN ('odd', 'watermark') THEN 'body' ELSE kind END AS kind,
  (row_number() OVER (PARTITION BY page_id ORDER BY ord, list_pos) - 1)::INT AS ord, CASE WHEN join_prev = 'never' THEN '' ELSE join_prev END AS join_prev FROM p WHERE list_pos % 5 <> 4"""
)
def parse_page_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-read responses back to regions (S9); the size measured counts, the size said only where there is none."""
    found, _, _ = regions.parse_reads(*page_reads(spark, sf_dir))
    return found.select("page_id", "list_pos", "region_id", "text", F.round("x", 6).alias("x"), F.round("h", 6).alias("h"), "kind", "ord", "join_prev")


@query(
    f"""WITH {READS_SQL} SELECT DISTINCT page_id, pw::DOUBLE AS width, page_id % 6 = 0 AS turned, CASE WHEN page_id % 6 = 0 OR page_id % 5 = 0 THEN 'low' ELSE 'high' END AS confidence, CASE WHEN page_id % 7 = 0 THEN 'Part ' || page_id END AS heading,
  page_id % 3 = 0 AS ends_mid_sentence, page_id % 3 = 1 AS starts_mid_sentence, CASE WHEN page_id % 6 = 0 THEN 2 ELSE 1 END AS notes FROM (SELECT * REPLACE (CASE WHEN page_id % 2 = 0 THEN 900 WHEN page_id % 6 = 0 THEN 1200 ELSE 450 END AS pw) FROM p)"""
)
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What responses say of their pages (S9): heading, flags, notes, and confidence that a turned page loses."""
    _, meta, _ = regions.parse_reads(*page_reads(spark, sf_dir))
    return meta.select("page_id", "width", "turned", "confidence", "heading", "ends_mid_sentence", "starts_mid_sentence", F.size("notes").alias("notes"))


@query(f"WITH {READS_SQL}, bad AS (SELECT page_id FROM (SELECT DISTINCT page_id, pw FROM p) WHERE page_id % 10 = 0) SELECT DISTINCT page_id, CASE WHEN page_id % 6 = 0 OR page_id % 5 = 0 OR page_id % 4 = 1 THEN 'low' ELSE 'high' END AS confidence FROM p")
def distrusted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that break the contract keep their rows at low confidence (P8); here some boxes lie outside."""
    found, meta, _ = regions.parse_reads(*page_reads(spark, sf_dir))
    k = F.col("page_id") % 4 == 1
    inside = found.withColumns({c: F.lit(0.1) for c in "xyw"}).withColumn("h", F.when(k, 2.0).otherwise(0.1))
    return regions.distrust(meta, regions.violations(inside, meta)).select("page_id", "confidence")


@query(f"WITH {REGIONS_SQL} SELECT page_id, list_pos, (row_number() OVER (PARTITION BY page_id ORDER BY ord // 2, list_pos) - 1)::INT AS ord FROM regions")
def renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with repeats and holes to 0 .. n - 1, ties in list order."""
    rows = regions_of(spark, sf_dir).withColumn("ord", F.expr("ord div 2"))
    return regions.with_orders(rows).select("page_id", "list_pos", "ord")


@query(f"WITH {REGIONS_SQL}, o AS (SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY ord, list_pos) - 1)::INT AS place FROM regions) SELECT page_id, region_id, place AS ord FROM o WHERE join_prev = 'chapter'")
def region_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions before which text may be missing (W9); here chapter seams say so."""
    rows = regions_of(spark, sf_dir)
    return regions.gaps(rows.withColumn("join_prev", F.when(F.col("join_prev") == "chapter", "gap").otherwise(""))).select("page_id", "region_id", "ord")


@query(f"WITH {REGIONS_SQL} SELECT page_id, list_pos, x * 800 AS px, y * 600 AS py, x * 100 AS pleft, h * 100 AS pheight FROM regions")
def drawn_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as pixels of a picture and in percent."""
    sides = [F.col(c) for c in "xywh"]
    rows = regions_of(spark, sf_dir).select("page_id", "list_pos", box_to_pixels(*sides, F.lit(800.0), F.lit(600.0)).alias("p"), box_percent(*sides).alias("c"))
    return rows.select("page_id", "list_pos", F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("c.left").alias("pleft"), F.col("c.height").alias("pheight"))


@query(
    """SELECT page_id, left(trim(regexp_replace(regexp_replace(regexp_replace(url, '\\A.*[/\\\\]', ''), '[\\x00-\\x1f\\x7f<>:"|?*]', ' ', 'g'), '[ \\t\\n]+', ' ', 'g')), 80) AS label,
  CASE WHEN page_id % 2 = 0 THEN 'doc-' || lpad(page_id::VARCHAR, 20, '0') ELSE '' END AS document FROM pages"""
)
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display labels and document ids out of addresses."""
    address = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://docs.example.com/document/d/doc-"), F.lpad(F.col("page_id").cast("string"), 20, "0"), F.lit("/edit"))).otherwise(F.lit("short"))
    return table(spark, sf_dir, "pages").select("page_id", safe_label(F.col("url")).alias("label"), document_id(address).alias("document"))


@query(f"WITH {REGIONS_SQL} SELECT page_id, list_pos, x * 900 / 900 AS x, CASE WHEN page_id % 5 = 0 THEN 0 ELSE y * 1200 / 1200 END AS y FROM (SELECT page_id, list_pos, CASE WHEN page_id % 5 = 0 THEN 0 ELSE x END AS x, y FROM regions)")
def pixel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in pixels to fractions; a page without size has empty boxes."""
    width = F.when(F.col("page_id") % 5 == 0, 0.0).otherwise(900.0)
    box = pixels_to_box(F.col("x") * 900, F.col("y") * 1200, F.col("w") * 900, F.col("h") * 1200, width, F.lit(1200.0))
    return regions_of(spark, sf_dir).select("page_id", "list_pos", box.alias("b")).select("page_id", "list_pos", "b.x", "b.y")
