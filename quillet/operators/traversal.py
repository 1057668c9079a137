"""Orders over a page: rows from boxes, groups that grow, numberings, traversals and the links that follow them.

Boxes: (page_id, box_id, l, t, r, b). Where one step depends on the one before, a page's sorted boxes are
folded inside one expression; a page has tens of boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BOX = "struct<box_id:int,l:double,t:double,r:double,b:double>"


def _pages(boxes: DataFrame, *key: Column) -> DataFrame:
    """(page_id, rows): each page's boxes as one array of struct(k1, .., box_id, l, t, r, b), sorted."""
    one = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(key)], "box_id", "l", "t", "r", "b")
    return boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("rows"))


def _middle(x: Column) -> Column:
    return (x["t"] + x["b"]) / 2


def _median(values: Column) -> Column:
    """The mean of the two middles of an array, null if it is empty."""
    ordered, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2)


def _box(x: Column) -> Column:
    return F.struct(*[x[c].alias(c) for c in ("box_id", "l", "t", "r", "b")])


def _numbered(folded: DataFrame, groups: str, name: str) -> DataFrame:
    """(page_id, name, box_id) from an array of arrays of boxes."""
    return folded.select("page_id", F.posexplode(groups).alias(name, "g")).select("page_id", name, F.explode(F.transform("g", lambda x: x["box_id"])).alias("box_id"))


def detector_rows(boxes: DataFrame) -> DataFrame:
    """(page_id, row_no, box_id): from top to bottom a box joins the row before if all share a height and it lies within half the pitch of the row's first."""
    pages = _pages(boxes, (F.col("t") + F.col("b")) / 2)
    ys = F.transform("rows", _middle)
    gaps = F.filter(F.zip_with(F.slice(ys, 1, F.size(ys) - 1), F.slice(ys, 2, F.size(ys) - 1), lambda a, b: b - a), lambda d: d >= 1)
    pages = pages.withColumn("gaps", F.when(F.size("rows") > 1, gaps).otherwise(F.array().cast("array<double>"))).withColumn("pitch", F.coalesce(_median(F.col("gaps")), F.lit(0.0)))

    def place(rows: Column, x: Column) -> Column:
        last = F.element_at(rows, -1)
        top = F.greatest(F.array_max(F.transform(last, lambda y: y["t"])), x["t"])
        bottom = F.least(F.array_min(F.transform(last, lambda y: y["b"])), x["b"])
        joins = (F.size(rows) > 0) & (top < bottom) & (_middle(x) - _middle(F.element_at(last, 1)) < F.col("pitch") / 2)
        grown = F.concat(F.slice(rows, 1, F.size(rows) - 1), F.array(F.concat(last, F.array(_box(x)))))
        return F.when(F.size(rows) == 0, F.array(F.array(_box(x)))).when(joins, grown).otherwise(F.concat(rows, F.array(F.array(_box(x)))))

    # element_at of an empty array is an error, so the fold starts at the first box
    start = F.array(F.array(_box(F.col("rows")[0])))
    folded = pages.select("page_id", F.aggregate(F.slice("rows", 2, F.size("rows")), start, place).alias("found"))
    return _numbered(folded, "found", "row_no")


def leading_groups(boxes: DataFrame) -> DataFrame:
    """(page_id, members, l, t, r, b): from the left, boxes up to the first gap over the larger height and half the larger width."""
    pages = _pages(boxes, F.col("l"), F.col("box_id"))
    first = F.col("rows")[0]
    state = lambda u, ids, on: F.struct(*[u[c].alias(c) for c in ("l", "t", "r", "b")], ids.alias("ids"), on.alias("on"))

    def grow(s: Column, x: Column) -> Column:
        gap = x["l"] - s["r"]
        near = s["on"] & (gap <= F.greatest(s["b"] - s["t"], x["b"] - x["t"], (s["r"] - s["l"]) / 2, (x["r"] - x["l"]) / 2))
        union = F.struct(F.least(s["l"], x["l"]).alias("l"), F.least(s["t"], x["t"]).alias("t"), F.greatest(s["r"], x["r"]).alias("r"), F.greatest(s["b"], x["b"]).alias("b"))
        return F.when(near, state(union, F.concat(s["ids"], F.array(x["box_id"])), F.lit(True))).otherwise(state(s, s["ids"], F.lit(False)))

    done = pages.select("page_id", F.aggregate(F.slice("rows", 2, F.size("rows")), state(first, F.array(first["box_id"]), F.lit(True)), grow).alias("s"))
    return done.select("page_id", F.array_join(F.transform("s.ids", lambda i: i.cast("string")), ",").alias("members"), "s.l", "s.t", "s.r", "s.b")


def row_windows(boxes: DataFrame, n: int) -> DataFrame:
    """(page_id, start, cost): of all n rows in a run the most evenly spaced ones, the first of equals."""
    order = Window.partitionBy("page_id").orderBy("y")
    rows = boxes.select("page_id", ((F.col("t") + F.col("b")) / 2).alias("y")).distinct().withColumn("start", F.row_number().over(order) - 1)
    ahead = order.rowsBetween(0, n - 1)
    runs = rows.withColumn("ys", F.collect_list("y").over(ahead)).where(F.size("ys") == n)
    gaps = F.zip_with(F.slice("ys", 1, n - 1), F.slice("ys", 2, n - 1), lambda a, b: b - a)
    runs = runs.withColumn("gaps", gaps).withColumn("pitch", F.greatest(_median(F.col("gaps")), F.lit(1.0)))
    steps = F.zip_with(F.slice("gaps", 1, n - 2), F.slice("gaps", 2, n - 2), lambda a, b: (b - a) / F.col("pitch"))
    runs = runs.withColumn("cost", F.aggregate(steps, F.lit(0.0), lambda s, x: s + x * x))
    best = Window.partitionBy("page_id").orderBy("cost", "start")
    return runs.withColumn("k", F.row_number().over(best)).where("k = 1").select("page_id", "start", "cost")


def lattice_numbers(boxes: DataFrame, pitch: float) -> DataFrame:
    """(page_id, y, number): rows numbered by rounded steps of a pitch that follows the last gap; a row without a step is left out."""
    pages = boxes.groupBy("page_id").agg(F.array_sort(F.collect_set((F.col("t") + F.col("b")) / 2)).alias("ys"))
    state = lambda y, p, at, out: F.struct(y.alias("y"), p.alias("p"), at.alias("at"), out.alias("out"))
    one = lambda y, k: F.array(F.struct(y.alias("y"), k.alias("number")))

    def step(s: Column, y: Column) -> Column:
        gap = y - s["y"]
        n = F.round(gap / s["p"]).cast("int")
        return F.when(n == 0, state(y, s["p"], s["at"], s["out"])).otherwise(state(y, gap / n, s["at"] + n, F.concat(s["out"], one(y, s["at"] + n))))

    first = F.col("ys")[0]
    start = state(first, F.lit(float(pitch)), F.lit(0), one(first, F.lit(0)))
    return pages.select("page_id", F.explode(F.aggregate(F.slice("ys", 2, F.size("ys")), start, step)["out"]).alias("x")).select("page_id", "x.y", "x.number")


def reading_order(boxes: DataFrame) -> DataFrame:
    """(page_id, box_id, place): boxes by rows within a band of their extents, then from the left.

    The comparison is no total order, so boxes are inserted one by one, by id, ahead of the first they precede.
    """
    pages = _pages(boxes, F.col("box_id"))

    def before(x: Column, y: Column) -> Column:
        extent = lambda z: F.least(z["r"] - z["l"], z["b"] - z["t"])
        band, cx, cy = (extent(x) + extent(y)) / 4, (x["l"] + x["r"]) / 2, (y["l"] + y["r"]) / 2
        return F.when(F.abs(_middle(x) - _middle(y)) > band, _middle(x) < _middle(y)).otherwise(cx < cy)

    def insert(done: Column, x: Column) -> Column:
        at = F.array_position(F.transform(done, lambda y: before(x, y)), F.lit(True)).cast("int")
        at = F.when(at == 0, F.size(done) + 1).otherwise(at)
        return F.concat(F.slice(done, 1, at - 1), F.array(_box(x)), F.slice(done, at, F.size(done)))

    ordered = pages.select("page_id", F.aggregate("rows", F.array().cast(f"array<{_BOX}>"), insert).alias("o"))
    return ordered.select("page_id", F.posexplode(F.transform("o", lambda x: x["box_id"])).alias("place", "box_id")).select("page_id", "box_id", "place")


def traversals(words: DataFrame) -> DataFrame:
    """(page_id, pos, by_columns, by_rows, by_numbers) of the kept words; words: (page_id, pos, row_pos, n, stray). Words without a number come last, in column order."""
    page = Window.partitionBy("page_id")
    place = lambda *keys: F.row_number().over(page.orderBy(*keys)).alias
    return words.where("NOT stray").select("page_id", "pos", place("pos")("by_columns"), place("row_pos")("by_rows"), place(F.asc_nulls_last("n"), "pos")("by_numbers"))


def merged_streams(streams: DataFrame) -> DataFrame:
    """(page_id, item, place): items of ordered streams by cost, stream and rank, each where it comes first; streams: (page_id, stream, rank, item, cost)."""
    first = Window.partitionBy("page_id", "item").orderBy("cost", "stream", "rank")
    kept = streams.withColumn("k", F.row_number().over(first)).where("k = 1")
    return kept.select("page_id", "item", F.row_number().over(Window.partitionBy("page_id").orderBy("cost", "stream", "rank", "item")).alias("place"))


def reindexed(links: DataFrame, order: DataFrame) -> DataFrame:
    """(page_id, a, b) of links after the words were put in another order; order: (page_id, box_id, place)."""
    a, b = order.toDF("page_id", "a", "new_a"), order.toDF("page_id", "b", "new_b")
    return links.join(a, ["page_id", "a"]).join(b, ["page_id", "b"]).select("page_id", F.col("new_a").alias("a"), F.col("new_b").alias("b"))


def largest(boxes: DataFrame, limit: int) -> DataFrame:
    """(page_id, box_id, place): the largest of a page, the earlier of equals."""
    order = Window.partitionBy("page_id").orderBy(F.desc((F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))), "box_id")
    return boxes.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("page_id", "box_id", "place")


def selected_groups(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(page_id, group_no, members): groups without the boxes that are not kept, which are not grouped anew; an empty group stays."""
    pages = kept.groupBy("page_id").agg(F.collect_set("box_id").alias("kept"))
    return groups.join(pages, "page_id", "left").select("page_id", "group_no", F.filter("members", lambda m: F.coalesce(F.array_contains("kept", m), F.lit(False))).alias("members"))


def row_joins(boxes: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """(page_id, column_no, row_no, left_id, right_id, reason, l, t, r, b): two boxes of one cell and whether they may be one word.

    columns, rows: (page_id, group_no, members). A pair is a candidate in a column of three rows or more of
    which all others have one box.
    """
    member = lambda g, name: g.select("page_id", F.col("group_no").alias(name), F.explode("members").alias("box_id"))
    cells = member(columns, "column_no").join(member(rows, "row_no"), ["page_id", "box_id"]).join(boxes, ["page_id", "box_id"])
    one = F.struct("l", "box_id")
    cell = cells.groupBy("page_id", "column_no", "row_no").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(one)).alias("m"), *[f(c).alias(c) for f, c in ((F.min, "l"), (F.min, "t"), (F.max, "r"), (F.max, "b"))])
    column = Window.partitionBy("page_id", "column_no")
    cell = cell.withColumn("rows", F.count("*").over(column)).withColumn("full", F.sum((F.col("n") > 1).cast("int")).over(column))
    reason = F.when((F.col("rows") >= 3) & (F.col("full") == 1), "candidate").otherwise("row_structure")
    return cell.where("n = 2").select("page_id", "column_no", "row_no", F.col("m")[0]["box_id"].alias("left_id"), F.col("m")[1]["box_id"].alias("right_id"), reason.alias("reason"), "l", "t", "r", "b")


def child_ids(children: DataFrame) -> DataFrame:
    """(page_id, place, parent, id): a parent's first child keeps its id, others get fresh ones above all parents; children: (page_id, place, parent)."""
    page = Window.partitionBy("page_id").orderBy("place")
    nth = F.row_number().over(Window.partitionBy("page_id", "parent").orderBy("place"))
    rows = children.withColumn("fresh", (nth > 1).cast("int")).withColumn("top", F.max("parent").over(Window.partitionBy("page_id")))
    return rows.select("page_id", "place", "parent", F.when(F.col("fresh") == 0, F.col("parent")).otherwise(F.col("top") + F.sum("fresh").over(page)).alias("id"))


def work_checks(work: DataFrame) -> DataFrame:
    """(attempt_id, seq, malformed): phases never go back, no more is done than there is, and within a phase the total stays and the done grows."""
    order = Window.partitionBy("attempt_id").orderBy("seq")
    before = lambda c: F.lag(c).over(order)
    back = before("phase") > F.col("phase")
    over = F.col("completed") > F.col("total")
    moved = (before("phase") == F.col("phase")) & (~before("total").eqNullSafe(F.col("total")) | (F.col("completed") < before("completed")))
    return work.select("attempt_id", "seq", F.coalesce(back | F.coalesce(over, F.lit(False)) | F.coalesce(moved, F.lit(False)), over, F.lit(False)).alias("malformed"))


def overlays(regions: DataFrame, cap: int) -> DataFrame:
    """(attempt_id, seen, overlays): attempts that saw more regions than the cap lose their overlays, not their result."""
    seen = regions.groupBy("attempt_id").agg(F.count_distinct("region_id").alias("seen"))
    return seen.select("attempt_id", "seen", (F.col("seen") <= cap).alias("overlays"))


def matched_ids(live: DataFrame, final: DataFrame) -> DataFrame:
    """(attempt_id, region_id, side): regions in both tables, or in one alone; each holds (attempt_id, region_id)."""
    a, b = live.distinct().withColumn("x", F.lit(1)), final.distinct().withColumn("y", F.lit(1))
    side = F.when(F.col("y").isNull(), "live_only").when(F.col("x").isNull(), "final_only").otherwise("both")
    return a.join(b, ["attempt_id", "region_id"], "full").select("attempt_id", "region_id", side.alias("side"))
