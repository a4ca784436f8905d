"""Regions of read pages: parsing, kinds, furniture, contract checks. Regions: page_id, list_pos, region_id, x, y, w, h, text, kind, ord, join_prev, join_glue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import box_inside, tolerant_bool, tolerant_notes
from ..functions.text import furniture_kind, strip

# The kinds of regions, joins, glue, confidence and who set an order.
FURNITURE = ("page-number", "running-head", "watermark")
PROSE = ("body", "caption", "note")
SCRIPT = ("bubble", "thought", "narration", "aside")
KINDS = (*PROSE, *SCRIPT, *FURNITURE, "heading", "furigana", "sfx", "sign")
TRANSLATED = tuple(k for k in KINDS if k not in (*FURNITURE, "furigana"))
JOINS = ("sentence", "paragraph", "chapter", "gap")
GLUES = ("space", "none")
CONFIDENCE = ("high", "medium", "low")
TURNED = "stored size and read size are each other turned"

FIELDS = ("text", "kind", "order", "join_prev", "join_glue")


def read_json(c: Column) -> Column:
    """The outermost JSON object of a text as a variant; null where there is none or it does not parse."""
    found = F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0))
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def entry_fields(entry: Column) -> Column:
    """A region entry of any shape as texts; what it does not have is null."""
    return F.struct(*[F.try_variant_get(entry, f"$.{c}", "string").alias(c) for c in ("id", *FIELDS)], F.try_variant_get(entry, "$.box", "array<string>").alias("box"))


def entries(found: Column) -> Column:
    return F.transform(F.try_variant_get(found, "$.regions", "array<variant>"), entry_fields)


def kind_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, k in FURNITURE, k in PROSE, k in SCRIPT, k in TRANSLATED) for k in KINDS], "kind string, is_furniture boolean, is_prose boolean, is_script boolean, is_translated boolean")


def parse_reads(responses: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """responses(page_id, raw), sizes(page_id, width, height) -> (regions, page_meta, rejects).

    The outermost JSON object counts. Regions without text go; ids are places in the response; boxes are pixels of the size
    measured, of the size said where none is, and empty without either; unknown words take defaults, `watermark` is never
    believed; orders are renumbered from 0; furniture is marked. A page whose said size is the measured one turned gets
    low confidence and a note. page_meta: width, height, confidence, heading, the three flags, notes, turned.
    """
    parsed = responses.withColumn("__r", read_json(F.col("raw")))
    rejects = parsed.filter("__r is null").select("page_id", "raw")
    get = lambda path: F.try_variant_get("__r", f"$.{path}", "string")
    pages = parsed.filter("__r is not null").join(sizes.select("page_id", F.col("width").alias("__w"), F.col("height").alias("__h")), "page_id", "left")

    def said(side: str) -> Column:
        return F.greatest(F.lit(0), F.coalesce(get(side).try_cast("double").cast("long"), F.lit(0)))

    def size(measured: str, side: str) -> Column:
        return F.when(F.col(measured) > 0, F.col(measured).cast("double")).otherwise(said(side).cast("double"))

    both = (F.col("__w") > 0) & (F.col("__h") > 0) & (F.col("__w") != F.col("__h"))
    turned = F.coalesce(both & (said("width") == F.col("__h")) & (said("height") == F.col("__w")), F.lit(False))
    pages = pages.withColumns({"width": size("__w", "width"), "height": size("__h", "height"), "turned": turned})
    trust = F.lower(strip(F.coalesce(get("meta.confidence"), F.lit("low"))))
    notes = tolerant_notes(get("meta.notes"))
    meta = pages.select(
        "page_id", "width", "height", F.when(F.col("turned") | ~trust.isin(*CONFIDENCE), "low").otherwise(trust).alias("confidence"), F.nullif(strip(get("meta.heading")), F.lit("")).alias("heading"),
        *[tolerant_bool(F.coalesce(get(f"meta.{c}"), F.lit(""))).alias(c) for c in ("starts_mid_sentence", "ends_mid_sentence", "ends_mid_word")],
        F.when(F.col("turned"), F.array_append(notes, F.lit(TURNED))).otherwise(notes).alias("notes"), "turned",
    )
    rows = pages.select("page_id", "width", "height", F.posexplode(entries(F.col("__r"))).alias("list_pos", "r")).withColumn("text", strip(F.coalesce("r.text", F.lit("")))).filter("text <> ''")
    sides = [F.try_element_at("r.box", F.lit(k + 1)).try_cast("double") for k in range(4)]
    whole = (F.size("r.box") == 4) & F.col("width").__gt__(0) & F.col("height").__gt__(0)
    for s in sides:
        whole = whole & s.isNotNull()

    def one_of(c: str, allowed: tuple, default: str) -> Column:
        return F.when(F.col(c).isin(*allowed), F.col(c)).otherwise(default)

    order = F.coalesce(F.col("r.order").try_cast("double").cast("long"), F.col("list_pos"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(order, "list_pos")) - 1
    boxes = [F.when(F.coalesce(whole, F.lit(False)), s / F.col(by)).otherwise(0.0).alias(n) for n, s, by in zip("xywh", sides, ("width", "height") * 2, strict=True)]
    kinds = tuple(k for k in KINDS if k != "watermark")
    regions = rows.select(
        "page_id", "list_pos", F.concat(F.lit("r"), F.col("list_pos").cast("string")).alias("region_id"), *boxes, "text",
        one_of("r.kind", kinds, "body").alias("kind"), rank.alias("ord"), one_of("r.join_prev", JOINS, "").alias("join_prev"), one_of("r.join_glue", GLUES, "none").alias("join_glue"),
    )
    return mark_furniture(regions).drop("changed"), meta, rejects


def gaps(regions: DataFrame) -> DataFrame:
    """Regions before which text may be missing, in reading order."""
    return with_orders(regions).filter("join_prev = 'gap'").select("page_id", "region_id", "ord")


def mark_furniture(regions: DataFrame) -> DataFrame:
    """Adds `changed` and sets kind: an unproven watermark is body, text that is plainly furniture is its kind; other furniture stays. A second run changes nothing."""
    found = furniture_kind(F.col("text"))
    kind = F.when((F.col("kind") == "watermark") & ~found.eqNullSafe(F.lit("watermark")), "body").when(F.col("kind").isin(*FURNITURE), F.col("kind")).otherwise(F.coalesce(found, F.col("kind")))
    return regions.withColumn("__k", kind).withColumn("changed", ~F.col("__k").eqNullSafe(F.col("kind"))).withColumn("kind", F.col("__k")).drop("__k")


def with_orders(regions: DataFrame) -> DataFrame:
    """Orders 0 to n - 1 by (ord, list_pos)."""
    return regions.withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("ord", "list_pos")) - 1)


def violations(regions: DataFrame, meta: DataFrame) -> DataFrame:
    """Every breach of the contract: page_id, list_pos (null: of the page), problem."""
    same = Window.partitionBy("page_id", "region_id").orderBy("list_pos")
    rows = regions.withColumn("__again", F.row_number().over(same) > 1)
    no_id = F.coalesce(F.col("region_id"), F.lit("")) == ""
    checks = {
        "no-id": no_id,
        "duplicate-id": ~no_id & F.col("__again"),
        "box": ~box_inside(F.col("x"), F.col("y"), F.col("w"), F.col("h")),
        "kind": ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)),
        "join": (F.coalesce("join_prev", F.lit("")) != "") & ~F.coalesce(F.col("join_prev").isin(*JOINS), F.lit(False)),
        "glue": ~F.coalesce(F.col("join_glue").isin(*GLUES), F.lit(False)),
    }
    of_region = rows.select("page_id", "list_pos", F.explode(F.array_compact(F.array(*[F.when(hit, name) for name, hit in checks.items()]))).alias("problem"))
    orders = regions.groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("ord").alias("d"), F.min("ord").alias("a"), F.max("ord").alias("b"))
    bad_order = orders.filter("not (n = d and a = 0 and b = n - 1)").select("page_id", F.lit(None).cast("int").alias("list_pos"), F.lit("order").alias("problem"))
    page_checks = {"size": ~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "confidence": ~F.coalesce(F.col("confidence").isin(*CONFIDENCE), F.lit(False))}
    of_page = meta.select("page_id", F.lit(None).cast("int").alias("list_pos"), F.explode(F.array_compact(F.array(*[F.when(hit, name) for name, hit in page_checks.items()]))).alias("problem"))
    return of_region.unionByName(bad_order).unionByName(of_page)


def distrust(meta: DataFrame, found: DataFrame) -> DataFrame:
    """Pages with a breach keep their rows at low confidence."""
    bad = found.select("page_id").distinct().withColumn("__bad", F.lit(True))
    return meta.join(bad, "page_id", "left").withColumn("confidence", F.when(F.col("__bad"), "low").otherwise(F.col("confidence"))).drop("__bad")
