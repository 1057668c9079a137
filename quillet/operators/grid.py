"""Label grid of a page: columns, rows, ownership and the reasons for exclusion. Boxes: (page_id, box_id, l, t, r, b)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .layout import upper_median


def page_axis(boxes: DataFrame) -> DataFrame:
    """The page's largest box, the least id of equals: its long side gives the page's direction."""
    area = (F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))
    order = Window.partitionBy("page_id").orderBy(F.desc("area"), "box_id")
    first = boxes.withColumn("area", area).withColumn("k", F.row_number().over(order)).where("k = 1")
    return first.select("page_id", "box_id", "area", (F.col("r") - F.col("l") >= F.col("b") - F.col("t")).alias("lies"))


def split_words(spans: DataFrame, factor: float = 3.0, gap: float = 0.35) -> DataFrame:
    """(page_id, word_no, l, r, parts): spans that touch are one; a gap over max(factor * median gap, gap * height) cuts.

    spans: (page_id, span_id, l, r, h), h the line's height. The median is the mean of the two middles.
    """
    left = Window.partitionBy("page_id").orderBy("l", "r", "span_id")
    reach = F.max("r").over(left.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("starts", F.when(reach.isNull() | (F.col("l") > reach), 1).otherwise(0)).withColumn("island", F.sum("starts").over(left))
    merged = islands.groupBy("page_id", "island").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.max("h").alias("h"), F.count("*").alias("parts"))
    order = Window.partitionBy("page_id").orderBy("island")
    gaps = merged.withColumn("gap", F.col("l") - F.lag("r").over(order))
    limits = gaps.groupBy("page_id").agg(F.greatest(factor * F.expr("percentile(gap, 0.5)"), gap * F.max("h")).alias("cut"))
    words = gaps.join(limits, "page_id").withColumn("new", F.when(F.col("gap").isNull() | (F.col("gap") > F.col("cut")), 1).otherwise(0)).withColumn("word_no", F.sum("new").over(order))
    return words.groupBy("page_id", "word_no").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.sum("parts").alias("parts"))


def columns_of(boxes: DataFrame, pitch: float) -> DataFrame:
    """(page_id, column_no, low, high, members): column domains by pitch, each up to where the next begins or its widest member ends."""
    no = F.floor(F.col("l") / pitch)
    found = boxes.groupBy("page_id", no.alias("column_no")).agg(F.min("l").alias("low"), F.max("r").alias("widest"), F.count("*").alias("members"))
    following = F.lead("low").over(Window.partitionBy("page_id").orderBy("column_no"))
    return found.select("page_id", "column_no", "low", F.greatest(F.when(following.isNull(), F.col("widest")).otherwise(F.least(following, F.col("widest"))), F.col("low")).alias("high"), "members")


def assigned_column(boxes: DataFrame, columns: DataFrame) -> DataFrame:
    """(page_id, box_id, column_no): of the columns that hold a box's middle, the one that begins last."""
    middle = (F.col("x.l") + F.col("x.r")) / 2
    on = (F.col("x.page_id") == F.col("c.page_id")) & (middle >= F.col("c.low")) & (middle < F.col("c.high"))
    owned = boxes.alias("x").join(columns.alias("c"), on, "left").groupBy("x.page_id", "x.box_id").agg(F.max(F.struct("c.low", "c.column_no")).alias("best"))
    return owned.select("page_id", "box_id", F.col("best.column_no").alias("column_no"))


def exclusion_reasons(boxes: DataFrame, gutter: float = 40.0) -> DataFrame:
    """(page_id, box_id, reason): the first rule that excludes a box, in fixed order; null keeps it."""
    page = Window.partitionBy("page_id")
    h = boxes.groupBy("page_id").agg(upper_median(F.collect_list(F.col("b") - F.col("t"))).alias("h"))
    placed = boxes.withColumn("first_l", F.min("l").over(page)).withColumn("rows", F.count("*").over(page)).join(h, "page_id")
    reason = (
        F.when((F.col("r") - F.col("first_l") < gutter) & (F.col("rows") > 1), "label_gutter")
        .when(F.col("r") - F.col("l") < F.col("h"), "standalone_label")
        .when(F.col("b") - F.col("t") > 1.25 * F.col("h"), "outside_rows")
    )
    return placed.select("page_id", "box_id", reason.alias("reason"))


def cell_rows(boxes: DataFrame) -> DataFrame:
    """(page_id, box_id, upper, lower): each box's row between the midpoints to its neighbours in its column's order."""
    y = (F.col("t") + F.col("b")) / 2
    order = Window.partitionBy("page_id").orderBy("y", "box_id")
    placed = boxes.withColumn("y", y)
    return placed.select("page_id", "box_id", ((F.col("y") + F.lag("y").over(order)) / 2).alias("upper"), ((F.col("y") + F.lead("y").over(order)) / 2).alias("lower"))


def completed_rows(boxes: DataFrame) -> DataFrame:
    """(page_id, row_no, y): rows at the median pitch from the first row to the last."""
    y = (F.col("t") + F.col("b")) / 2
    order = Window.partitionBy("page_id").orderBy("y")
    steps = boxes.select("page_id", y.alias("y")).distinct().withColumn("step", F.col("y") - F.lag("y").over(order))
    pitch = steps.groupBy("page_id").agg(F.expr("percentile(step, 0.5)").alias("pitch"), F.min("y").alias("top"), F.max("y").alias("bottom")).where("pitch > 0")
    n = F.round((F.col("bottom") - F.col("top")) / F.col("pitch")).cast("int")
    return pitch.select("page_id", "pitch", "top", F.explode(F.sequence(F.lit(0), n)).alias("row_no")).select("page_id", "row_no", (F.col("top") + F.col("row_no") * F.col("pitch")).alias("y"))


def join_guard(boxes: DataFrame) -> DataFrame:
    """(page_id, left_id, right_id, reason): neighbours on a row, with the first reason against joining them."""
    y = (F.col("t") + F.col("b")) / 2
    order = Window.partitionBy("page_id").orderBy("l", "box_id")
    following = boxes.withColumn("y", y)
    for c in ("box_id", "l", "r", "t", "b"):
        following = following.withColumn(f"next_{c}", F.lead(c).over(order))
    reason = (
        F.when((F.col("next_t") > F.col("y")) | (F.col("next_b") < F.col("y")), "row_structure")
        .when((F.col("r") - F.col("l") < 100) | (F.col("next_r") - F.col("next_l") < 100), "label")
        .when(F.col("next_l") - F.col("r") > 2 * (F.col("b") - F.col("t")), "apart")
        .when(F.ceil(F.greatest("r", "next_r") - F.col("l")) * F.ceil(F.greatest("b", "next_b") - F.least("t", "next_t")) > 30_000, "budget")
        .otherwise("candidate")
    )
    return following.where("next_box_id IS NOT NULL").select("page_id", F.col("box_id").alias("left_id"), F.col("next_box_id").alias("right_id"), reason.alias("reason"))
