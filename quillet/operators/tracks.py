"""The label grid of a page: columns with slanting edges, the rows in them, cells, and what they own.

Columns: (page_id, column_no, top, bottom, intercept, slope, reach, reach_slope, gutter): the left edge at height y is
intercept + slope * y, the right one reach + reach_slope * y. Boxes: (page_id, box_id, l, t, r, b).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import grid_label
from .traversal import detector_rows, leading_groups

# Fixed values of the grid's rules, in heights unless said otherwise.
LABEL_ASPECT, DISPLAY_SURE, MAX_CROP_PIXELS = 2.2, 0.5, 1_048_576


def left(y: Column) -> Column:
    return F.col("intercept") + F.col("slope") * y


def right(y: Column) -> Column:
    return F.col("reach") + F.col("reach_slope") * y


def _y() -> Column:
    return (F.col("t") + F.col("b")) / 2


def owns() -> Column:
    """Whether a column owns a box: by height, its middle right of the left edge or an end well beyond it, and left of the right edge."""
    cx, y = (F.col("l") + F.col("r")) / 2, _y()
    return (y >= F.col("top")) & (y <= F.col("bottom")) & ((cx >= left(y)) | (F.col("r") >= left(y) + F.col("b") - F.col("t"))) & (cx < right(y))


def right_domains(columns: DataFrame, boxes: DataFrame) -> DataFrame:
    """Columns with their right edges: the next column's gutter with its slope, else the widest row and a fifth, beyond every member.

    boxes has column_no. Which column comes next is decided half-way down this one.
    """
    own = boxes.withColumnRenamed("page_id", "page").select(F.struct("page", "column_no").alias("page_id"), "box_id", "l", "t", "r", "b")
    rows = detector_rows(own).join(own, ["page_id", "box_id"]).groupBy("page_id", "row_no").agg(F.min("l").alias("l"), F.max("r").alias("r"))
    widest = rows.groupBy("page_id").agg(F.max(F.struct((F.col("r") - F.col("l")).alias("w"), "r")).alias("x"), F.max("r").alias("far"))
    limit = widest.select(F.col("page_id.page").alias("page_id"), F.col("page_id.column_no").alias("column_no"), F.greatest(F.col("x.r") + 0.2 * F.col("x.w"), F.col("far")).alias("limit"))
    page = Window.partitionBy("page_id").orderBy("column_no")
    following = columns.withColumn("next", F.lead(F.struct((F.col("intercept") - F.col("gutter")).alias("at"), "slope")).over(page))
    out = following.join(limit, ["page_id", "column_no"])
    return out.select("page_id", "column_no", "top", "bottom", "intercept", "slope", F.coalesce("next.at", "limit").alias("reach"), F.coalesce("next.slope", F.lit(0.0)).alias("reach_slope"), "gutter")


def assigned(boxes: DataFrame, columns: DataFrame) -> DataFrame:
    """The boxes with the columns that own them; of several the one whose left edge lies furthest right; null columns keep the box."""
    met = boxes.join(columns, "page_id").where(owns())
    best = met.groupBy("page_id", "box_id").agg(F.max(F.struct(left(_y()).alias("at"), *[c for c in columns.columns if c != "page_id"])).alias("x"))
    return boxes.join(best, ["page_id", "box_id"], "left").select(*boxes.columns, *[F.col("x")[c].alias(c) for c in columns.columns if c != "page_id"])


def constrained(owned: DataFrame) -> DataFrame:
    """(page_id, box_id, l, r, bounded): a box's sides inside its column over its whole height; left alone where nothing of it would stay."""
    low = F.greatest(F.col("l"), F.coalesce(F.greatest(left(F.col("t")), left(F.col("b"))), F.col("l")))
    high = F.least(F.col("r"), F.coalesce(F.least(right(F.col("t")), right(F.col("b"))), F.col("r")))
    ok = high - low > 1
    return owned.select("page_id", "box_id", F.when(ok, low).otherwise(F.col("l")).alias("l"), F.when(ok, high).otherwise(F.col("r")).alias("r"), (ok & ((low > F.col("l")) | (high < F.col("r")))).alias("bounded"))


def partitioned(boxes: DataFrame, columns: DataFrame) -> DataFrame:
    """(page_id, box_id, column_no, l, r): a box over two columns or more is cut into its parts; others stay whole, without a column."""
    low, high = F.greatest(F.col("l"), left(F.col("t")), left(F.col("b"))), F.least(F.col("r"), right(F.col("t")), right(F.col("b")))
    met = boxes.join(columns, "page_id").where((_y() >= F.col("top")) & (_y() <= F.col("bottom")) & (high - low > 1))
    parts = met.select("page_id", "box_id", "column_no", low.alias("l"), high.alias("r")).withColumn("n", F.count("*").over(Window.partitionBy("page_id", "box_id"))).where("n > 1").drop("n")
    whole = boxes.join(parts.select("page_id", "box_id").distinct(), ["page_id", "box_id"], "left_anti")
    return parts.unionByName(whole.select("page_id", "box_id", F.lit(None).cast("long").alias("column_no"), "l", "r"))


def guide_owners(labels: DataFrame, columns: DataFrame, pitch: float) -> DataFrame:
    """(page_id, box_id, column_no): labels in order each take the nearest column that none has taken, within a radius; null if there is none."""
    one = F.struct("box_id", ((F.col("l") + F.col("r")) / 2).alias("x"), _y().alias("y"), (F.col("b") - F.col("t")).alias("h"))
    pages = labels.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("labels"))
    guides = columns.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("column_no", "intercept", "slope", "gutter"))).alias("guides"))
    both = pages.join(guides, "page_id", "left")
    state = lambda out, used: F.struct(out.alias("out"), used.alias("used"))
    empty = state(F.array().cast("array<struct<box_id:int,column_no:bigint>>"), F.array().cast("array<bigint>"))

    def take(s: Column, x: Column) -> Column:
        open_ = F.filter("guides", lambda g: ~F.array_contains(s["used"], g["column_no"]))
        gaps = F.transform(open_, lambda g: F.struct(F.abs(g["intercept"] + g["slope"] * x["y"] - x["x"]).alias("gap"), g["column_no"].alias("column_no"), F.least(x["h"] + g["gutter"], F.lit(0.45 * pitch)).alias("radius")))
        best = F.array_min(F.filter(gaps, lambda g: g["gap"] <= g["radius"]))
        out = F.concat(s["out"], F.array(F.struct(x["box_id"].alias("box_id"), best["column_no"].alias("column_no"))))
        return state(out, F.when(best.isNotNull(), F.concat(s["used"], F.array(best["column_no"]))).otherwise(s["used"]))

    folded = both.select("page_id", F.explode(F.aggregate("labels", empty, take)["out"]).alias("x"))
    return folded.select("page_id", "x.box_id", "x.column_no")


def best_line(points: DataFrame, tolerance: float) -> DataFrame:
    """(page_id, inliers, slope, intercept): the line through two points that most others are near, refitted to these.

    points: (page_id, point_id, x, y), lines x = a + s * y; of equals the pair with the least ids.
    """
    p, q = points.alias("p"), points.alias("q")
    pairs = p.join(q, (F.col("p.page_id") == F.col("q.page_id")) & (F.col("p.point_id") < F.col("q.point_id")) & (F.col("p.y") != F.col("q.y")))
    slope = F.try_divide(F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y"))  # the join leaves no level pair
    lines = pairs.select("p.page_id", F.col("p.point_id").alias("i"), F.col("q.point_id").alias("j"), slope.alias("s"), (F.col("p.x") - slope * F.col("p.y")).alias("a"))
    near = lines.join(points, "page_id").where(F.abs(F.col("x") - F.col("a") - F.col("s") * F.col("y")) <= tolerance)
    counted = near.groupBy("page_id", "i", "j").agg(F.count("*").alias("inliers"), F.expr("regr_slope(x, y)").alias("slope"), F.expr("regr_intercept(x, y)").alias("intercept"))
    best = Window.partitionBy("page_id").orderBy(F.desc("inliers"), "i", "j")
    return counted.withColumn("k", F.row_number().over(best)).where("k = 1").select("page_id", "inliers", "slope", "intercept")


def retreating(advance_top: Column, advance_bottom: Column, height: Column) -> Column:
    """struct(accepted, shift): a refit edge is taken if it nowhere advances over a quarter height and somewhere retreats by one; it is moved left to cut nowhere deeper."""
    advance, retreat = F.greatest(advance_top, advance_bottom), -F.least(advance_top, advance_bottom)
    ok = (advance <= 0.25 * height) & (retreat >= 0.25 * height)
    return F.struct(ok.alias("accepted"), F.when(ok, F.greatest(advance, F.lit(0.0))).alias("shift"))


def compact_prefix(mark: str, word: str, height: Column) -> Column:
    """Whether a small box before a word has a label's size, shape and distance; mark and word name the joined tables."""
    m, w = (lambda c: F.col(f"{mark}.{c}")), (lambda c: F.col(f"{word}.{c}"))
    mh, mw, gap = m("b") - m("t"), m("r") - m("l"), w("l") - m("r")
    return (mh >= 0.25 * height) & (mh <= height) & (mw >= 0.12 * height) & (mw <= 1.5 * mh) & (gap >= 0.12 * height) & (gap <= 1.5 * height) & (m("t") < w("b")) & (m("b") > w("t"))


def anchors(boxes: DataFrame) -> DataFrame:
    """(page_id, box_id, role, n): a label-sized box is an anchor by a sure numeric read, shown by a likely one; wider boxes propose a prefix. boxes has text and confidence."""
    w, h = F.col("r") - F.col("l"), F.col("b") - F.col("t")
    sure, likely = grid_label(F.col("text"), F.col("confidence")), grid_label(F.col("text"), F.lit(1.0))
    role = F.when(w > LABEL_ASPECT * h, "proposal").when(sure["kind"].isNotNull(), "anchor").when(likely["kind"].isNotNull() & (F.col("confidence") >= DISPLAY_SURE), "display").otherwise("none")
    return boxes.select("page_id", "box_id", role.alias("role"), F.when(role == "anchor", sure["n"]).alias("n"))


def schedule(proposals: DataFrame) -> DataFrame:
    """(page_id, box_id, place): reads of proposals on a track that nothing supports come first, then by track, area and source; proposals: (page_id, box_id, known, track, area)."""
    first = ~F.col("known") & F.col("track").isNotNull()
    order = Window.partitionBy("page_id").orderBy((~first).cast("int"), F.asc_nulls_last("track"), "area", "box_id")
    return proposals.select("page_id", "box_id", F.row_number().over(order).alias("place"))


def boundary_reason(isolated: Column, height: Column) -> Column:
    """Why the marks of a column don't set its edge, or `applied`."""
    flat = (F.col("reach") <= F.greatest(left(F.col("top")), left(F.col("bottom")))) | F.isnan("intercept") | F.isnan("slope")
    return F.when(isolated < 2, "few_marks").when(flat, "invalid_column").when((height < 12) | (height > 400), "page_scale").otherwise("applied")


def cells(columns: DataFrame, rows: DataFrame, supports: DataFrame) -> DataFrame:
    """(page_id, column_no, row_no, l, t, r, b, n): cells between the first and the last row that a label supports.

    rows: (page_id, column_no, y); supports: (page_id, column_no, y, n), n null without an ordinal. Cells end
    half-way between rows; ordinals count on from the labels if these all agree.
    """
    order = Window.partitionBy("page_id", "column_no").orderBy("y")
    numbered = rows.distinct().withColumn("row_no", F.row_number().over(order) - 1).withColumn("up", F.lag("y").over(order)).withColumn("down", F.lead("y").over(order))
    met = supports.withColumnRenamed("y", "at").join(numbered.select("page_id", "column_no", "row_no", "y"), ["page_id", "column_no"])
    nearest = met.groupBy("page_id", "column_no", "at", "n").agg(F.min(F.struct(F.abs(F.col("y") - F.col("at")).alias("d"), "row_no")).alias("x"))
    held = nearest.groupBy("page_id", "column_no").agg(F.min("x.row_no").alias("low"), F.max("x.row_no").alias("high"), F.collect_set(F.col("n") - F.col("x.row_no")).alias("offsets"))
    inside = numbered.join(held, ["page_id", "column_no"]).where("row_no BETWEEN low AND high").join(columns, ["page_id", "column_no"])
    t, b = F.coalesce((F.col("up") + F.col("y")) / 2, F.col("top")), F.coalesce((F.col("y") + F.col("down")) / 2, F.col("bottom"))
    n = F.when(F.size("offsets") == 1, F.col("offsets")[0] + F.col("row_no"))
    return inside.withColumn("ct", t).withColumn("cb", b).select(
        "page_id", "column_no", "row_no", F.greatest(left(F.col("ct")), left(F.col("cb"))).alias("l"), F.col("ct").alias("t"), F.least(right(F.col("ct")), right(F.col("cb"))).alias("r"), F.col("cb").alias("b"),
        F.when(n > 0, n).cast("int").alias("n"),
    )


def cell_support(boxes: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, box_id, basis, n): what supports a box: an own numeric prefix, or the cell that holds its middle; boxes has prefix_n and ink."""
    x, c = boxes.alias("x"), found.alias("c")
    cx, cy = (F.col("x.l") + F.col("x.r")) / 2, (F.col("x.t") + F.col("x.b")) / 2
    on = (F.col("x.page_id") == F.col("c.page_id")) & (cx >= F.col("c.l")) & (cx < F.col("c.r")) & (cy >= F.col("c.t")) & (cy < F.col("c.b"))
    met = x.join(c, on, "left").groupBy("x.page_id", "x.box_id").agg(F.first("x.prefix_n").alias("prefix_n"), F.first("x.ink").alias("ink"), F.min(F.struct("c.column_no", "c.row_no", "c.n")).alias("cell"))
    inked, local, inside = F.col("ink") > 0, F.col("prefix_n").isNotNull(), F.col("cell.column_no").isNotNull()
    return met.select("page_id", "box_id", F.when(inked & local, "prefix").when(inked & inside, "cell").alias("basis"), F.when(inked, F.coalesce("prefix_n", F.when(inside, F.col("cell.n")))).alias("n"))


def cell_groups(boxes: DataFrame, rows: DataFrame) -> DataFrame:
    """(page_id, column_no, row_no, members, l, t, r, b): the leading group of each cell with two boxes or more; a box goes to the nearest row centre of its column."""
    order = Window.partitionBy("page_id", "column_no").orderBy("y")
    numbered = rows.distinct().withColumn("row_no", F.row_number().over(order) - 1)
    met = boxes.join(numbered, ["page_id", "column_no"])
    nearest = met.groupBy("page_id", "column_no", "box_id", "l", "t", "r", "b").agg(F.min(F.struct(F.abs(F.col("y") - _y()).alias("d"), "row_no")).alias("x")).withColumn("row_no", F.col("x.row_no"))
    full = nearest.withColumn("n", F.count("*").over(Window.partitionBy("page_id", "column_no", "row_no"))).where("n > 1").withColumnRenamed("page_id", "page")
    groups = leading_groups(full.select(F.struct("page", "column_no", "row_no").alias("page_id"), "box_id", "l", "t", "r", "b"))
    return groups.select(F.col("page_id.page").alias("page_id"), "page_id.column_no", "page_id.row_no", "members", "l", "t", "r", "b")


def compact_unions(pairs: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, left_id, right_id, reason): whether two small neighbours make one word; pairs as from row_joins, boxes with protected."""
    side = lambda n: boxes.select("page_id", F.col("box_id").alias(f"{n}_id"), *[F.col(c).alias(f"{n}_{c}") for c in ("l", "t", "r", "b", "protected")])
    both = pairs.join(side("left"), ["page_id", "left_id"]).join(side("right"), ["page_id", "right_id"])
    w, h = (lambda n: F.col(f"{n}_r") - F.col(f"{n}_l")), (lambda n: F.col(f"{n}_b") - F.col(f"{n}_t"))
    small = lambda n: (w(n) >= h(n)) & (w(n) < LABEL_ASPECT * h(n))
    union_w, union_h = F.greatest("left_r", "right_r") - F.least("left_l", "right_l"), F.greatest("left_b", "right_b") - F.least("left_t", "right_t")
    overlap = F.least("left_b", "right_b") - F.greatest("left_t", "right_t")
    reason = (
        F.when(F.col("reason") != "candidate", "row_structure").when(~small("left") | ~small("right"), "not_two_small").when(union_w < LABEL_ASPECT * union_h, "label_sized").when(F.col("right_l") - F.col("left_r") > 0.5 * F.greatest(h("left"), h("right")), "gap")
        .when(overlap < 0.6 * F.least(h("left"), h("right")), "row_overlap").when(union_w * union_h > MAX_CROP_PIXELS, "budget").when(F.col("left_protected") | F.col("right_protected"), "label").otherwise("assembled")
    )
    return both.select("page_id", "left_id", "right_id", reason.alias("reason"))


def prefix_limits(prefixes: DataFrame) -> DataFrame:
    """(page_id, box_id, applied, reason): a prefix bounds its word on a supported track, or by a number of its own; prefixes: (.., in_track, n)."""
    reason = F.when(F.col("in_track"), "track").when(F.col("n").isNotNull(), "number").otherwise("no_support")
    return prefixes.select("page_id", "box_id", (reason != "no_support").alias("applied"), reason.alias("reason"))


def union_guards(endings: DataFrame, parents: DataFrame, budget: int) -> DataFrame:
    """(page_id, box_id, reason): whether an ending may be joined to its owner; endings: (page_id, box_id, owner, pixels), parents: (page_id, box_id, cell_owned, protected)."""
    twins = Window.partitionBy("page_id", "owner")
    rows = endings.withColumn("endings", F.count("*").over(twins)).join(parents.withColumnRenamed("box_id", "owner"), ["page_id", "owner"], "left")
    reason = F.when(F.col("cell_owned").isNull(), "owner_unavailable").when(F.col("cell_owned"), "cell_owned").when(F.col("endings") > 1, "many_endings").when(F.col("protected"), "protected").when(F.col("pixels") > budget, "budget").otherwise("candidate")
    return rows.select("page_id", "box_id", reason.alias("reason"))


def with_peaks(blobs: DataFrame, peaks: DataFrame) -> DataFrame:
    """Blobs and those peaks that overlap none of their page's blobs."""
    x, y = peaks.alias("x"), blobs.alias("y")
    meets = (F.col("x.page_id") == F.col("y.page_id")) & (F.col("x.l") < F.col("y.r")) & (F.col("x.r") > F.col("y.l")) & (F.col("x.t") < F.col("y.b")) & (F.col("x.b") > F.col("y.t"))
    return blobs.withColumn("kind", F.lit("blob")).unionByName(x.join(y, meets, "left_anti").withColumn("kind", F.lit("peak")))
