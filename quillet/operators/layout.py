"""Geometry of a page's boxes: joins, groups, components and owners. Boxes: (page_id, box_id, l, t, r, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How far a box reaches, in heights, and the largest cluster that may stand apart.
COLUMN_REACH, ROW_REACH, APART_AT_MOST = 1.5, 1.0, 3


def upper_median(values: Column) -> Column:
    """The upper of the two middles."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1)


def geometry(boxes: DataFrame) -> DataFrame:
    width, height = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    return boxes.select("page_id", "box_id", width.alias("w"), height.alias("h"), ((F.col("l") + F.col("r")) / 2).alias("cx"), ((F.col("t") + F.col("b")) / 2).alias("cy"), (F.ceil(width) * F.ceil(height)).cast("long").alias("pixels"))


def envelope(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("page_id").agg(F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"), F.count("*").alias("boxes"))


def medians(boxes: DataFrame) -> DataFrame:
    """Both medians of a page's heights: the upper middle, and the mean of the two middles."""
    h = F.col("b") - F.col("t")
    return boxes.groupBy("page_id").agg(upper_median(F.collect_list(h)).alias("upper_middle"), F.expr("percentile(b - t, 0.5)").alias("average_middle"))


def reach_edges(boxes: DataFrame) -> DataFrame:
    """(page_id, a, b): pairs of a page's boxes whose bounds, padded by heights, overlap strictly."""
    scale = boxes.groupBy("page_id").agg(F.greatest(upper_median(F.collect_list(F.col("b") - F.col("t"))), F.lit(1.0)).alias("h"))
    padded = boxes.join(scale, "page_id").select(
        "page_id", "box_id", (F.col("l") - COLUMN_REACH * F.col("h")).alias("l"), (F.col("r") + COLUMN_REACH * F.col("h")).alias("r"), (F.col("t") - ROW_REACH * F.col("h")).alias("t"), (F.col("b") + ROW_REACH * F.col("h")).alias("b")
    )
    p, q = padded.alias("p"), padded.alias("q")
    on = (F.col("p.page_id") == F.col("q.page_id")) & (F.col("p.box_id") < F.col("q.box_id")) & (F.col("p.l") < F.col("q.r")) & (F.col("q.l") < F.col("p.r")) & (F.col("p.t") < F.col("q.b")) & (F.col("q.t") < F.col("p.b"))
    return p.join(q, on).select("p.page_id", F.col("p.box_id").alias("a"), F.col("q.box_id").alias("b"))


def reach_components(boxes: DataFrame) -> DataFrame:
    """(page_id, box_id, component): connected boxes, named by their least id; a page has tens of boxes.

    A fold over the page's boxes: each one joins all groups that hold a box in its reach.
    """
    one = F.struct("box_id", "l", "t", "r", "b")
    pages = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("rows"), F.greatest(upper_median(F.collect_list(F.col("b") - F.col("t"))), F.lit(1.0)).alias("h"))
    dx, dy = 2 * COLUMN_REACH * F.col("h"), 2 * ROW_REACH * F.col("h")
    near = lambda p, q: (p["l"] - q["r"] < dx) & (q["l"] - p["r"] < dx) & (p["t"] - q["b"] < dy) & (q["t"] - p["b"] < dy)
    kind = "array<array<struct<box_id:int,l:double,t:double,r:double,b:double>>>"

    state = lambda rest, met: F.struct(rest.alias("rest"), met.alias("met"))

    def place(groups: Column, x: Column) -> Column:
        def sort(s: Column, g: Column) -> Column:
            return F.when(F.exists(g, lambda q: near(x, q)), state(s["rest"], F.concat(s["met"], g))).otherwise(state(F.concat(s["rest"], F.array(g)), s["met"]))

        return F.aggregate(groups, state(F.array().cast(kind), F.array(x)), sort, lambda s: F.concat(s["rest"], F.array(s["met"])))

    folded = pages.select("page_id", F.explode(F.aggregate("rows", F.array().cast(kind), place)).alias("g"))
    ids = F.transform("g", lambda x: x["box_id"])
    return folded.select("page_id", F.explode(ids).alias("box_id"), F.array_min(ids).alias("component"))


def apart(components: DataFrame) -> DataFrame:
    """Components of a page that are small and far smaller than its largest."""
    sizes = components.groupBy("page_id", "component").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("largest", F.max("size").over(Window.partitionBy("page_id")))
    flag = (F.col("size") <= APART_AT_MOST) & (3 * F.col("size") < F.col("largest"))
    return components.join(sizes.withColumn("apart", flag), ["page_id", "component"]).select("page_id", "box_id", "component", "size", "apart")


def dominant_block(boxes: DataFrame, aspect: float = 2.0) -> DataFrame:
    """Per page the longest run of word-shaped boxes without a vertical gap over two heights (the last of equals)."""
    y = (F.col("t") + F.col("b")) / 2
    words = boxes.where(F.col("r") - F.col("l") >= aspect * (F.col("b") - F.col("t"))).withColumn("y", y)
    scale = words.groupBy("page_id").agg(upper_median(F.collect_list(F.col("b") - F.col("t"))).alias("h"), F.count("*").alias("words")).where("words >= 2")
    down = Window.partitionBy("page_id").orderBy("y", "box_id")
    gap = F.col("y") - F.lag("y").over(down) > 2 * F.col("h")
    blocks = words.join(scale, "page_id").withColumn("starts", F.when(gap, 1).otherwise(0)).withColumn("block", F.sum("starts").over(down))
    sizes = blocks.groupBy("page_id", "block").agg(F.count("*").alias("size"), F.min("y").alias("top"), F.max("y").alias("bottom"), F.first("h").alias("h"))
    best = Window.partitionBy("page_id").orderBy(F.desc("size"), F.desc("block"))
    return sizes.withColumn("k", F.row_number().over(best)).where("k = 1 AND size >= 2").select("page_id", "size", "top", "bottom", "h")


def axis_groups(boxes: DataFrame, axis: str = "x") -> DataFrame:
    """(page_id, group_no, members): boxes by span start join the first group whose grown span holds their centre.

    The order matters, so this is a fold over the page's sorted boxes, inside one expression.
    """
    low, high, cross = ("l", "r", "cy") if axis == "x" else ("t", "b", "cx")
    mid = (F.col(low) + F.col(high)) / 2
    other = (F.col("t") + F.col("b")) / 2 if cross == "cy" else (F.col("l") + F.col("r")) / 2
    one = F.struct(F.col(low).alias("lo"), F.col("box_id").alias("id"), F.col(high).alias("hi"), mid.alias("c"), other.alias("o"))
    pages = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    empty = F.array().cast("array<struct<lo:double,hi:double,m:array<struct<o:double,id:int>>>>")

    def place(groups: Column, x: Column) -> Column:
        fits = F.transform(groups, lambda g: (x["c"] >= g["lo"]) & (x["c"] <= g["hi"]))
        at = F.coalesce(F.array_position(fits, F.lit(True)), F.lit(0))
        member = F.array(F.struct(x["o"].alias("o"), x["id"].alias("id")))
        grown = F.transform(
            groups,
            lambda g, i: F.when(i + 1 == at, F.struct(F.least(g["lo"], x["lo"]).alias("lo"), F.greatest(g["hi"], x["hi"]).alias("hi"), F.concat(g["m"], member).alias("m"))).otherwise(g),
        )
        return F.when(at > 0, grown).otherwise(F.concat(groups, F.array(F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), member.alias("m")))))

    folded = pages.select("page_id", F.array_sort(F.aggregate("rows", empty, place)).alias("groups"))
    return folded.select("page_id", F.posexplode("groups").alias("group_no", "g")).select("page_id", "group_no", F.transform(F.array_sort(F.col("g.m")), lambda m: m["id"]).alias("members"))


def order_choice(boxes: DataFrame, numbered: Column) -> DataFrame:
    """(page_id, n_columns, n_rows, initial, review, reason): numbers that hold decide, then traversals
    that agree, then the longer dimension; one group more or less would tip a near tie, so it needs review."""
    grouped = lambda axis, name: axis_groups(boxes, axis).groupBy("page_id").agg(F.count("*").alias(f"n_{name}"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "members"))), lambda g: g["members"])).alias(f"by_{name}"))
    both = grouped("x", "columns").join(grouped("y", "rows"), "page_id")
    c, r = F.col("n_columns"), F.col("n_rows")
    same = F.col("by_columns") == F.col("by_rows")
    initial = F.when(numbered, "numbers").when(same | (c >= r), "columns").otherwise("rows")
    reason = F.when(numbered, "held_numbers").when(same, "same_traversal").when(c == r, "equal_dimensions").when(F.abs(c - r) <= 1, "near_tie").otherwise("longer_dimension")
    return both.select("page_id", "n_columns", "n_rows", initial.alias("initial"), reason.isin("equal_dimensions", "near_tie").alias("review"), reason.alias("reason"))


def nearest_right(boxes: DataFrame, max_label_width: float = 120.0, tie: float = 1.0) -> DataFrame:
    """(page_id, label_id, word_id): each narrow box with the wider box right of it on its row, if one is nearest alone."""
    a = boxes.where(F.col("r") - F.col("l") <= max_label_width).alias("a")
    q = boxes.where(F.col("r") - F.col("l") > max_label_width).alias("q")
    cy = (F.col("a.t") + F.col("a.b")) / 2
    on = (F.col("a.page_id") == F.col("q.page_id")) & (F.col("q.l") >= F.col("a.l")) & (cy >= F.col("q.t")) & (cy <= F.col("q.b"))
    pairs = a.join(q, on).select("a.page_id", F.col("a.box_id").alias("label_id"), F.col("q.box_id").alias("word_id"), (F.col("q.l") - F.col("a.l")).alias("gap"))
    order = Window.partitionBy("page_id", "label_id").orderBy("gap", "word_id")
    ranked = pairs.withColumn("k", F.row_number().over(order)).withColumn("next", F.lead("gap").over(order)).where("k = 1")
    return ranked.select("page_id", "label_id", F.when(F.col("next") - F.col("gap") <= tie, None).otherwise(F.col("word_id")).alias("word_id"))


def fragment_owners(boxes: DataFrame, narrow: float = 100.0) -> DataFrame:
    """Narrow boxes and the wider boxes that overlap their middle: owner, no_owner or ambiguous, and whether another narrow box collides."""
    small, large = boxes.where(F.col("r") - F.col("l") < narrow).alias("s"), boxes.where(F.col("r") - F.col("l") >= narrow).alias("o")
    cx, cy = (F.col("s.l") + F.col("s.r")) / 2, (F.col("s.t") + F.col("s.b")) / 2
    inside = (F.col("s.page_id") == F.col("o.page_id")) & cx.between(F.col("o.l"), F.col("o.r")) & cy.between(F.col("o.t"), F.col("o.b"))
    counted = small.join(large, inside, "left").groupBy("s.page_id", "s.box_id").agg(F.count("o.box_id").alias("owners"), F.min("o.box_id").alias("owner"))
    x, y = boxes.where(F.col("r") - F.col("l") < narrow).alias("x"), boxes.where(F.col("r") - F.col("l") < narrow).alias("y")
    hits = (F.col("x.page_id") == F.col("y.page_id")) & (F.col("x.box_id") != F.col("y.box_id")) & (F.col("x.l") < F.col("y.r")) & (F.col("y.l") < F.col("x.r")) & (F.col("x.t") < F.col("y.b")) & (F.col("y.t") < F.col("x.b"))
    collides = x.join(y, hits, "left_semi").select("page_id", "box_id", F.lit(True).alias("collides"))
    outcome = F.when(F.col("owners") == 0, "no_owner").when(F.col("owners") > 1, "ambiguous").when(F.col("collides"), "collision").otherwise("owned")
    return counted.join(collides, ["page_id", "box_id"], "left").select("page_id", "box_id", F.when(F.col("owners") == 1, F.col("owner")).alias("owner"), outcome.alias("outcome"))


def axes_agree(a: Column, b: Column, degrees: float = 15.0) -> Column:
    """Whether two axes, taken modulo 180, differ by the angle at most."""
    return F.abs(F.pmod(a - b + 90, F.lit(180.0)) - 90) <= degrees


def admitted(costs: DataFrame, max_reads: int, max_pixels: int) -> DataFrame:
    """(page_id, box_id, admitted): reads in order while the budget lasts; what is too large is passed over and costs nothing."""
    one = F.struct("box_id", "pixels")
    pages = costs.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("px"), F.array().cast("array<int>").alias("ids"))

    def step(s: Column, x: Column) -> Column:
        ok = (s["n"] < max_reads) & (s["px"] + x["pixels"] <= max_pixels)
        return F.when(ok, F.struct((s["n"] + 1).alias("n"), (s["px"] + x["pixels"]).alias("px"), F.concat(s["ids"], F.array(x["box_id"])).alias("ids"))).otherwise(s)

    folded = pages.select("page_id", F.aggregate("rows", start, step)["ids"].alias("ids"), "rows")
    return folded.select("page_id", "ids", F.explode("rows").alias("x")).select("page_id", F.col("x.box_id").alias("box_id"), F.array_contains("ids", F.col("x.box_id")).alias("admitted"))
