"""Plane geometry as Column expressions, and homographies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, places: int) -> Column:
    """value rounded half away from zero; a negative one that rounds to zero stays -0.0, as in DuckDB."""
    return F.signum(value) * F.round(F.abs(value), places)


def rounded_ratio(numerator: Column, denominator: Column, places: int) -> Column:
    """numerator / denominator, whole decimals and a positive denominator, rounded half away from zero without an error before that."""
    twice = 2 * F.abs(numerator) * 10**places + denominator
    units = F.call_function("div", twice, 2 * denominator)
    return F.signum(numerator.cast("double")) * (units.cast("double") / 10**places)


def exact_fit(x: str, y: str) -> Column:
    """Aggregate struct(n, x, y, xx, xy) of whole coordinates (pairs with a null are left out): counts and sums that no order of rows changes."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = (F.when(both, F.col(c)).cast("decimal(12,0)") for c in (x, y))
    return F.struct(F.count(px).cast("decimal(12,0)").alias("n"), F.sum(px).alias("x"), F.sum(py).alias("y"), F.sum(px * px).alias("xx"), F.sum(px * py).alias("xy"))


def fit_slope(fit: str, places: int) -> Column:
    """Least-squares slope of an exact_fit, rounded; null where all x are equal."""
    f = F.col(fit)
    return rounded_ratio(f["n"] * f["xy"] - f["x"] * f["y"], _spread(fit), places)


def fit_intercept(fit: str, places: int) -> Column:
    """Least-squares intercept of an exact_fit, rounded; null where all x are equal."""
    f = F.col(fit)
    return rounded_ratio(f["y"] * f["xx"] - f["x"] * f["xy"], _spread(fit), places)


def _spread(fit: str) -> Column:
    f = F.col(fit)
    return F.nullif(f["n"] * f["xx"] - f["x"] * f["x"], F.lit(0).cast("decimal(38,0)"))


def mean_axis(radians: Column) -> Column:
    """Aggregate: half the angle of the doubled directions' sum, added in order of size so that reruns agree; null without directions.

    Directions that cancel have no axis: the figure is then what rounding leaves of their sum.
    """
    turns = F.array_sort(F.collect_list(2 * radians))
    add = lambda f: F.aggregate(turns, F.lit(0.0), lambda s, a: s + f(a))
    return F.when(F.size(turns) > 0, F.atan2(add(F.sin), add(F.cos)) / 2)


def turn(x: Column, y: Column, degrees: Column) -> Column:
    """struct(x, y): an offset turned anticlockwise on a page whose y goes down."""
    a = F.radians(degrees)
    return F.struct((x * F.cos(a) + y * F.sin(a)).alias("x"), (y * F.cos(a) - x * F.sin(a)).alias("y"))


def to_page(x: Column, y: Column, origin_x: Column, origin_y: Column, angle: Column) -> Column:
    """A photo's point in the page's frame, whose x runs along the writing."""
    return turn(x - origin_x, y - origin_y, -angle)


def to_photo(x: Column, y: Column, origin_x: Column, origin_y: Column, angle: Column) -> Column:
    """The inverse of to_page."""
    moved = turn(x, y, angle)
    return F.struct((moved["x"] + origin_x).alias("x"), (moved["y"] + origin_y).alias("y"))


def finite(*values: Column) -> Column:
    """Whether all values are numbers: no null, no NaN, no infinity."""
    ok = F.lit(True)
    for v in values:
        ok = ok & F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    return ok


def valid_frame(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> Column:
    return finite(cx, cy, w, h, angle) & (w > 0) & (h > 0)


def _cross(o: Column, p: Column, q: Column) -> Column:
    return (p["x"] - o["x"]) * (q["y"] - o["y"]) - (p["y"] - o["y"]) * (q["x"] - o["x"])


def convex_hull(points: Column) -> Column:
    """The hull's corners from the least x on, by monotone chain over the sorted points, without repeats."""
    kind = "array<struct<x:double,y:double>>"
    distinct = F.array_sort(F.array_distinct(points))

    def chain(ordered: Column) -> Column:
        def add(kept: Column, p: Column) -> Column:
            # the chain keeps its longest beginning after which the new point turns the right way
            turns = F.transform(F.sequence(F.lit(2), F.size(kept)), lambda k: F.when(_cross(F.element_at(kept, k - 1), F.element_at(kept, k), p) > 0, k).otherwise(1))
            keep = F.when(F.size(kept) < 2, F.size(kept)).otherwise(F.array_max(turns))
            return F.concat(F.slice(kept, 1, keep), F.array(p))

        return F.aggregate(ordered, F.array().cast(kind), add)

    lower, upper = chain(distinct), chain(F.reverse(distinct))
    whole = F.concat(F.slice(lower, 1, F.size(lower) - 1), F.slice(upper, 1, F.size(upper) - 1))
    return F.when(F.size(distinct) < 3, distinct).otherwise(whole)


def minimal_rectangle(hull: Column) -> Column:
    """struct(area, w, h, angle) of the least rectangle along a side of the hull; w is the longer side."""
    following = F.concat(F.slice(hull, 2, F.size(hull) - 1), F.slice(hull, 1, 1))

    def along(p: Column, q: Column) -> Column:
        n = F.sqrt(F.pow(q["x"] - p["x"], F.lit(2)) + F.pow(q["y"] - p["y"], F.lit(2)))
        ux, uy = (q["x"] - p["x"]) / n, (q["y"] - p["y"]) / n
        a = F.transform(hull, lambda c: c["x"] * ux + c["y"] * uy)
        b = F.transform(hull, lambda c: c["y"] * ux - c["x"] * uy)
        w, h = F.array_max(a) - F.array_min(a), F.array_max(b) - F.array_min(b)
        return F.struct((w * h).alias("area"), F.greatest(w, h).alias("w"), F.least(w, h).alias("h"), F.degrees(F.atan2(uy, ux)).alias("angle"))

    return F.array_min(F.zip_with(hull, following, along))


def unclipped(points: Column, distance: Column, samples: int = 16) -> Column:
    """The points of a disc around every corner: their hull is the outline moved outwards by the distance."""
    turns = F.array(*[F.struct(F.lit(float(np.cos(k * 2 * np.pi / samples))).alias("c"), F.lit(float(np.sin(k * 2 * np.pi / samples))).alias("s")) for k in range(samples)])
    return F.flatten(F.transform(points, lambda p: F.transform(turns, lambda t: F.struct((p["x"] + distance * t["c"]).alias("x"), (p["y"] + distance * t["s"]).alias("y")))))


def outside_distance(x: Column, y: Column, corners: Column) -> Column:
    """How far a point is from a polygon, 0 inside."""
    following = F.concat(F.slice(corners, 2, F.size(corners) - 1), F.slice(corners, 1, 1))

    def to_side(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - p["x"]) * dx + (y - p["y"]) * dy) / (dx * dx + dy * dy)))
        return F.sqrt(F.pow(x - p["x"] - t * dx, F.lit(2)) + F.pow(y - p["y"] - t * dy, F.lit(2)))

    return F.when(inside_polygon(x, y, corners), 0.0).otherwise(F.array_min(F.zip_with(corners, following, to_side)))


def pixel_window(x: Column, y: Column, w: Column, h: Column, scale: Column, width: Column, height: Column) -> Column:
    """struct(x0, y0, x1, y1): a window in millimetres as pixels, halves away from zero, inside the raster."""
    return F.struct(
        F.greatest(F.round(x * scale), F.lit(0)).cast("int").alias("x0"), F.greatest(F.round(y * scale), F.lit(0)).cast("int").alias("y0"),
        F.least(F.round((x + w) * scale), width).cast("int").alias("x1"), F.least(F.round((y + h) * scale), height).cast("int").alias("y1"),
    )


def detector_side(side: Column) -> Column:
    """A side as a multiple of 32, halves to the even one, 32 at least."""
    return F.greatest(F.bround(side / 32) * 32, F.lit(32)).cast("int")


def skew_allowed(ux: Column, uy: Column, vx: Column, vy: Column, degrees: float = 15.0) -> Column:
    """Whether two axes are near enough to perpendicular."""
    cosine = (ux * vx + uy * vy) / (F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy))
    return F.abs(cosine) <= float(np.sin(np.radians(degrees)))


def misfit(mark_fit: Column, size_ratios: Column) -> Column:
    """How badly a placement fits: the mark's error and every size's distance from what it should be."""
    return mark_fit + F.aggregate(size_ratios, F.lit(0.0), lambda s, r: s + F.abs(F.log(r)))


def inverse(h: np.ndarray) -> np.ndarray:
    """The homography back."""
    out = np.linalg.inv(h)
    return out / out[2, 2]


def composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """One homography for two in turn."""
    out = then @ first
    return out / out[2, 2]


def inside_polygon(x: Column, y: Column, corners: Column) -> Column:
    """Whether a point is inside a polygon of struct(x, y) corners, by crossings."""
    following = F.concat(F.slice(corners, 2, F.size(corners) - 1), F.slice(corners, 1, 1))
    crossed = F.zip_with(corners, following, lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]))
    return F.size(F.filter(crossed, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def clockwise(corners: Column) -> Column:
    """Four corners from the top left on, clockwise on a page whose y goes down."""
    by_x = F.array_sort(corners)
    left, right = F.slice(by_x, 1, 2), F.slice(by_x, 3, 2)
    upper = lambda a: F.when(a[0]["y"] <= a[1]["y"], a[0]).otherwise(a[1])
    lower = lambda a: F.when(a[0]["y"] <= a[1]["y"], a[1]).otherwise(a[0])
    return F.array(upper(left), upper(right), lower(right), lower(left))


def quads_meet(a: Column, b: Column) -> Column:
    """Whether two convex quads overlap with area: no side of either separates them."""

    def apart_by(sides: Column) -> Column:
        following = F.concat(F.slice(sides, 2, 3), F.slice(sides, 1, 1))
        normals = F.zip_with(sides, following, lambda p, q: F.struct((q["y"] - p["y"]).alias("x"), (p["x"] - q["x"]).alias("y")))
        along = lambda quad, n: F.transform(quad, lambda p: p["x"] * n["x"] + p["y"] * n["y"])
        return F.exists(normals, lambda n: (F.array_max(along(a, n)) <= F.array_min(along(b, n))) | (F.array_max(along(b, n)) <= F.array_min(along(a, n))))

    return ~apart_by(a) & ~apart_by(b)


def homography(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that maps four or more points best, on normalised coordinates."""

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = p.mean(axis=0)
        scale = np.sqrt(2) / np.maximum(np.sqrt(((p - centre) ** 2).sum(axis=1)).mean(), 1e-12)
        t = np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1]])
        return (np.c_[p, np.ones(len(p))] @ t.T)[:, :2], t

    (p, tp), (q, tq) = normal(np.asarray(source, float)), normal(np.asarray(target, float))
    rows = []
    for (x, y), (u, v) in zip(p, q):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3)
    h = np.linalg.inv(tq) @ h @ tp
    return h / h[2, 2]


def mapped(x: Column, y: Column, h: np.ndarray) -> Column:
    """struct(x, y): a point under a homography, which is a few constants in the plan."""
    w = x * float(h[2, 0]) + y * float(h[2, 1]) + float(h[2, 2])
    return F.struct(((x * float(h[0, 0]) + y * float(h[0, 1]) + float(h[0, 2])) / w).alias("x"), ((x * float(h[1, 0]) + y * float(h[1, 1]) + float(h[1, 2])) / w).alias("y"))
