"""Reading order from boxes by a recursive cut into tiers and columns, without recursion.

Each pass cuts every part of a page along one axis: boxes sorted by their near edge begin a new part where the edge lies at or
beyond everything before it (less the slack). Passes alternate between y and x; the places of the parts make up a path.
All windows are over the page or finer, so one shuffle by page serves all passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import settled
from .regions import TRANSLATED

SLACK = 0.01
PASSES = 8


def rectangles(regions: DataFrame) -> DataFrame:
    """Adds x0, y0, x1, y1: boxes with a number missing are empty, negative sizes zero."""
    sides = [F.col(c) for c in ("x", "y", "w", "h")]
    bad = sides[0].isNull() | sides[1].isNull() | sides[2].isNull() | sides[3].isNull() | F.isnan("x") | F.isnan("y") | F.isnan("w") | F.isnan("h")
    zero = F.lit(0.0)
    x, y = (F.when(bad, zero).otherwise(c) for c in sides[:2])
    w, h = (F.when(bad, zero).otherwise(F.greatest(zero, c)) for c in sides[2:])
    return regions.withColumns({"x0": x, "y0": y, "x1": x + w, "y1": y + h})


def _cut(rows: DataFrame, axis: str, slack: float, backwards: bool) -> DataFrame:
    part = Window.partitionBy("page_id", "path").orderBy(f"{axis}0", f"{axis}1", "list_pos")
    before = F.max(f"{axis}1").over(part.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.coalesce((F.col(f"{axis}0") >= before - slack).cast("int"), F.lit(0)))
    number = F.sum("__new").over(part.rowsBetween(Window.unboundedPreceding, 0))
    place = F.lit(999_999) - number if backwards else number
    return rows.withColumn("path", F.concat("path", F.lpad(place.cast("string"), 6, "0"))).drop("__new")


def parts(regions: DataFrame, *, direction: str = "rtl", slack: float = SLACK, passes: int = PASSES) -> DataFrame:
    """Adds path, the same for regions of one part, in reading order, drawn, and settled: false for pages that further passes would cut.

    A page of n regions needs n passes at most: each but the first makes a part more, or nothing is left to cut.
    """
    slack = max(0.0, slack)
    rows = rectangles(regions).repartition("page_id").withColumn("path", F.lit(""))
    area = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    rows = rows.withColumn("drawn", F.max(area.cast("int")).over(Window.partitionBy("page_id")) == 1)
    for k in range(passes):
        rows = _cut(rows, "yx"[k % 2], slack, direction == "rtl" and k % 2 == 1)
    further = rows.withColumn("__path", F.col("path"))
    for axis in "yx":
        further = _cut(further, axis, slack, False)
    more = F.max(F.substring("path", -12, 12)).over(Window.partitionBy("page_id")) != "0" * 12
    return further.withColumns({"settled": ~(F.col("drawn") & more), "path": F.when(F.col("drawn"), F.col("__path")).otherwise("")}).drop("__path")


def _leaf_order(direction: str) -> list[Column]:
    across = -F.col("x1") if direction == "rtl" else F.col("x0")
    empty = F.lit(0.0)
    return [F.col("path"), F.when(F.col("drawn"), across).otherwise(empty), F.when(F.col("drawn"), F.col("y0")).otherwise(empty), F.col("list_pos")]


def reading_order(regions: DataFrame, *, direction: str = "rtl", slack: float = SLACK, passes: int = PASSES) -> DataFrame:
    """Adds proposed (reading rank from 0), panel (part number from 0) and settled (whether the passes were enough; see `exact_order`)."""
    page = Window.partitionBy("page_id")
    rows = parts(regions, direction=direction, slack=slack, passes=passes)
    out = rows.withColumn("proposed", F.row_number().over(page.orderBy(*_leaf_order(direction))) - 1).withColumn("panel", F.dense_rank().over(page.orderBy("path")) - 1)
    return out.drop("path", "drawn", "x0", "y0", "x1", "y1")


BOX = ("page_id", "list_pos", "x", "y", "w", "h")


def exact_order(regions: DataFrame, *, direction: str = "rtl", slack: float = SLACK, passes: int = PASSES) -> DataFrame:
    """Adds proposed and panel with as many passes as each page needs: pages that aren't settled are ordered again with twice as many, and only they.

    Boxes alone are ordered and written down, words are joined to them by place (page_id, list_pos: one region each).
    """
    boxes = regions.select(*BOX)
    done, rows = None, boxes
    while True:
        found = settled(reading_order(rows, direction=direction, slack=slack, passes=passes))
        open_ = found.filter("not settled").select("page_id").distinct()
        closed = found.filter("settled").select("page_id", "list_pos", "proposed", "panel")
        done = closed if done is None else done.unionByName(closed)
        if open_.isEmpty():
            return regions.join(done, ["page_id", "list_pos"])
        rows, passes = boxes.join(open_, "page_id", "left_semi"), 2 * passes


def check(regions: DataFrame, *, slack: float = SLACK, passes: int = PASSES) -> DataFrame:
    """Per page: regions whose rank differs from the proposed one, and whether the order is that of the other direction; exact at any depth."""
    rows = regions.select(*BOX, "ord")
    both = exact_order(rows, direction="rtl", slack=slack, passes=passes).withColumnRenamed("proposed", "rtl").drop("panel")
    both = exact_order(both, direction="ltr", slack=slack, passes=passes).withColumnRenamed("proposed", "ltr").drop("panel")
    now = F.row_number().over(Window.partitionBy("page_id").orderBy("ord", "list_pos")) - 1
    drawn = F.max(((F.col("w") > 0) & (F.col("h") > 0)).cast("int")) == 1
    per = both.withColumn("now", now).groupBy("page_id").agg(F.count("*").alias("regions"), F.count_if(F.col("now") != F.col("rtl")).alias("off"), F.bool_and(F.col("now") == F.col("ltr")).alias("as_ltr"), F.bool_and(F.col("ltr") == F.col("rtl")).alias("alike"), drawn.alias("drawn"))
    return per.select("page_id", "regions", F.col("off").alias("disagreement"), ((F.col("regions") >= 2) & F.col("drawn") & F.col("as_ltr") & ~F.col("alike")).alias("reversed"))


def panel_numbers(ordered: DataFrame) -> DataFrame:
    """Adds number: panels from 1 by their first translated region in reading order; a panel without one is 0."""
    spoken = F.min(F.when(F.col("kind").isin(*TRANSLATED), F.col("ord"))).over(Window.partitionBy("page_id", "panel"))
    rows = ordered.withColumn("__first", spoken)
    rank = F.dense_rank().over(Window.partitionBy("page_id").orderBy(F.col("__first").asc_nulls_last()))
    return rows.withColumn("number", F.when(F.col("__first").isNull(), 0).otherwise(rank)).drop("__first")


def panel_runs(lines: DataFrame) -> DataFrame:
    """Adds run: consecutive lines of one panel in reading order."""
    page = Window.partitionBy("page_id").orderBy("ord", "list_pos")
    change = F.coalesce((F.lag("number").over(page) != F.col("number")).cast("int"), F.lit(0))
    return lines.withColumn("__c", change).withColumn("run", F.sum("__c").over(page.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def page_blocks(lines: DataFrame) -> DataFrame:
    """A block of text per page: a header where the panel changes, then id, kind and text of each line."""
    page = Window.partitionBy("page_id").orderBy("ord", "list_pos")
    changed = ~F.lag("number").over(page).eqNullSafe(F.col("number"))
    head = F.when(changed, F.concat(F.lit("[panel "), F.col("number").cast("string"), F.lit("]\n"))).otherwise("")
    row = F.concat(head, F.concat_ws("\t", "region_id", "kind", "text"))
    return lines.withColumn("__row", row).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "list_pos", "__row"))), lambda s: s["__row"]), "\n").alias("block"))
