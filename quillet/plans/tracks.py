"""Queries over the label grid and plane geometry, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillet.functions import geometry as geo
from quillet.operators import layout, tracks, traversal
from quillet.plans import sql
from quillet.plans.evidence import query
from quillet.sources import adapters as ad

_COLS = f"""{ad.BOXES}, own AS (SELECT *, CAST(floor(l / 300) AS BIGINT) AS column_no FROM boxes),
guides AS (SELECT page_id, column_no, min(t) - 5 AS top, max(b) + 5 AS bottom, min(l) - 2.0::DOUBLE AS intercept, 0.01::DOUBLE * column_no AS slope, 20.0::DOUBLE AS gutter FROM own GROUP BY page_id, column_no)"""
#: Rows of each column by the fold of detector_rows.
_DET = """
d_order AS (SELECT *, (t + b) / 2 AS y, row_number() OVER (PARTITION BY page_id, column_no ORDER BY (t + b) / 2, box_id) AS k FROM own),
d_gap AS (SELECT page_id, column_no, list(gap) FILTER (gap >= 1) AS gaps FROM (SELECT page_id, column_no, y - lag(y) OVER (PARTITION BY page_id, column_no ORDER BY k) AS gap FROM d_order) GROUP BY ALL),
d_pitch AS (SELECT page_id, column_no, coalesce((list_sort(gaps)[(len(gaps) - 1) // 2 + 1] + list_sort(gaps)[len(gaps) // 2 + 1]) / 2, 0) AS pitch FROM d_gap),
d_fold AS (SELECT page_id, column_no, k, box_id, 0 AS row_no, y AS first_y, t AS top, b AS bottom FROM d_order WHERE k = 1
  UNION ALL SELECT page_id, column_no, k, box_id, CASE WHEN hit THEN row_no ELSE row_no + 1 END, CASE WHEN hit THEN first_y ELSE y END, CASE WHEN hit THEN greatest(top, t) ELSE t END, CASE WHEN hit THEN least(bottom, b) ELSE b END
  FROM (SELECT f.page_id, f.column_no, f.row_no, f.first_y, f.top, f.bottom, o.k, o.box_id, o.y, o.t, o.b, greatest(f.top, o.t) < least(f.bottom, o.b) AND o.y - f.first_y < p.pitch / 2 AS hit
    FROM d_fold f JOIN d_order o ON o.page_id = f.page_id AND o.column_no = f.column_no AND o.k = f.k + 1 JOIN d_pitch p ON p.page_id = f.page_id AND p.column_no = f.column_no)),
d_rows AS (SELECT f.page_id, f.column_no, f.row_no, min(l) AS l, max(r) AS r FROM d_fold f JOIN own o ON o.page_id = f.page_id AND o.box_id = f.box_id GROUP BY ALL),
d_wide AS (SELECT page_id, column_no, max(r) AS far, max({'w': r - l, 'r': r}) AS x FROM d_rows GROUP BY ALL),
cols AS (SELECT g.page_id, g.column_no, top, bottom, intercept, slope, coalesce(lead(intercept - gutter) OVER o, greatest(x.r + 0.2 * x.w, far)) AS reach, coalesce(lead(slope) OVER o, 0) AS reach_slope, gutter FROM guides g JOIN d_wide w ON w.page_id = g.page_id AND w.column_no = g.column_no WINDOW o AS (PARTITION BY g.page_id ORDER BY g.column_no))"""
_GRID = f"WITH RECURSIVE {_COLS}, {_DET}"
_LEFT, _RIGHT = "(intercept + slope * ({0}))", "(reach + reach_slope * ({0}))"
_Y = "((t + b) / 2)"
_OWNED = f"""met AS (SELECT x.page_id, x.box_id, max({{'at': {_LEFT.format(_Y)}, 'column_no': column_no}}) AS m FROM boxes x JOIN cols c ON c.page_id = x.page_id AND {_Y} >= top AND {_Y} <= bottom AND ((l + r) / 2 >= {_LEFT.format(_Y)} OR r >= {_LEFT.format(_Y)} + b - t) AND (l + r) / 2 < {_RIGHT.format(_Y)} GROUP BY ALL),
owned AS (SELECT x.*, c.* EXCLUDE (page_id) FROM boxes x LEFT JOIN met ON met.page_id = x.page_id AND met.box_id = x.box_id LEFT JOIN cols c ON c.page_id = x.page_id AND c.column_no = met.m.column_no)"""


def own(spark, sf_dir):
    return ad.boxes(spark, sf_dir).withColumn("column_no", F.floor(F.col("l") / 300))


def columns(spark, sf_dir):
    guides = own(spark, sf_dir).groupBy("page_id", "column_no").agg((F.min("t") - 5).alias("top"), (F.max("b") + 5).alias("bottom"), (F.min("l") - 2.0).alias("intercept"))
    guides = guides.withColumn("slope", 0.01 * F.col("column_no")).withColumn("gutter", F.lit(20.0))
    return tracks.right_domains(guides, own(spark, sf_dir))


@query(f"{_GRID} SELECT page_id, column_no, round(reach, 4) AS reach, reach_slope FROM cols")
def right_domains(spark, sf_dir):
    """Where each column ends on the right."""
    return columns(spark, sf_dir).select("page_id", "column_no", F.round("reach", 4).alias("reach"), "reach_slope")


@query(f"""{_GRID}, {_OWNED}, c AS (SELECT *, greatest(l, coalesce(greatest({_LEFT.format('t')}, {_LEFT.format('b')}), l)) AS low, least(r, coalesce(least({_RIGHT.format('t')}, {_RIGHT.format('b')}), r)) AS high FROM owned)
SELECT page_id, box_id, round(CASE WHEN high - low > 1 THEN low ELSE l END, 4) AS l, round(CASE WHEN high - low > 1 THEN high ELSE r END, 4) AS r, high - low > 1 AND (low > l OR high < r) AS bounded FROM c""")
def constrained_boxes(spark, sf_dir):
    out = tracks.constrained(tracks.assigned(ad.boxes(spark, sf_dir), columns(spark, sf_dir)))
    return out.withColumn("l", F.round("l", 4)).withColumn("r", F.round("r", 4))


@query(f"""{_GRID}, wide AS (SELECT * REPLACE (r + CASE WHEN box_id % 2 = 0 THEN 260 ELSE 0 END AS r) FROM boxes), m AS (SELECT x.page_id, x.box_id, column_no, greatest(l, {_LEFT.format('t')}, {_LEFT.format('b')}) AS low, least(r, {_RIGHT.format('t')}, {_RIGHT.format('b')}) AS high FROM wide x JOIN cols c ON c.page_id = x.page_id AND {_Y} BETWEEN top AND bottom),
p AS (SELECT * FROM m WHERE high - low > 1 QUALIFY count(*) OVER (PARTITION BY page_id, box_id) > 1)
SELECT page_id, box_id, column_no, round(low, 4) AS l, round(high, 4) AS r FROM p UNION ALL SELECT page_id, box_id, NULL, l, r FROM wide x WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.page_id = x.page_id AND p.box_id = x.box_id)""")
def partitioned_boxes(spark, sf_dir):
    """Boxes over several columns, cut into their parts."""
    wide = ad.boxes(spark, sf_dir).withColumn("r", F.col("r") + F.when(F.pmod("box_id", F.lit(2)) == 0, 260).otherwise(0))
    out = tracks.partitioned(wide, columns(spark, sf_dir))
    return out.withColumn("l", F.round("l", 4)).withColumn("r", F.round("r", 4))


@query(f"""{_GRID}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY box_id) AS k FROM boxes), g AS (SELECT page_id, list({{'column_no': column_no, 'intercept': intercept, 'slope': slope, 'gutter': gutter}} ORDER BY column_no) AS gs FROM cols GROUP BY page_id),
f AS (SELECT page_id, 0::BIGINT AS k, NULL::INTEGER AS box_id, NULL::BIGINT AS column_no, []::BIGINT[] AS used FROM boxes GROUP BY page_id
  UNION ALL SELECT page_id, k, box_id, best, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END FROM (
    SELECT f.page_id, o.k, o.box_id, f.used, list_sort(list_filter(list_transform(list_filter(g.gs, lambda z: NOT list_contains(f.used, z.column_no)), lambda z: {{'gap': abs(z.intercept + z.slope * (o.t + o.b) / 2 - (o.l + o.r) / 2), 'column_no': z.column_no, 'radius': least(o.b - o.t + z.gutter, 0.45 * 400.0)}}), lambda z: z.gap <= z.radius))[1].column_no AS best
    FROM f JOIN o ON o.page_id = f.page_id AND o.k = f.k + 1 JOIN g ON g.page_id = f.page_id))
SELECT page_id, box_id, column_no FROM f WHERE k > 0""")
def guide_owners(spark, sf_dir):
    """Boxes in order each take the nearest column that is free."""
    return tracks.guide_owners(ad.boxes(spark, sf_dir), columns(spark, sf_dir), 400.0)


@query(f"""WITH {ad.BOXES}, p AS (SELECT page_id, box_id, l AS x, (t + b) / 2 AS y FROM boxes), n AS (SELECT p.page_id, p.box_id AS i, q.box_id AS j, (q.x - p.x) / (q.y - p.y) AS s, p.x - (q.x - p.x) / (q.y - p.y) * p.y AS a FROM p JOIN p q ON q.page_id = p.page_id AND p.box_id < q.box_id AND p.y <> q.y),
c AS (SELECT n.page_id, i, j, count(*) AS inliers, regr_slope(x, y) AS slope, regr_intercept(x, y) AS intercept FROM n JOIN p ON p.page_id = n.page_id AND abs(x - a - s * y) <= 20.5 GROUP BY n.page_id, i, j)
SELECT page_id, inliers, round(slope, 4) AS slope, round(intercept, 3) AS intercept FROM c QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY inliers DESC, i, j) = 1""")
def best_lines(spark, sf_dir):
    """The line that most boxes' left edges are near."""
    points = ad.boxes(spark, sf_dir).select("page_id", F.col("box_id").alias("point_id"), F.col("l").alias("x"), ((F.col("t") + F.col("b")) / 2).alias("y"))
    return tracks.best_line(points, 20.5).withColumn("slope", geo.rounded("slope", 4)).withColumn("intercept", geo.rounded("intercept", 3))


@query(f"""WITH {ad.BOXES}, c AS (SELECT page_id, box_id, (l - 300) / 40 AS a, (t - 200) / 30 AS z, b - t AS h FROM boxes), d AS (SELECT *, greatest(a, z) AS adv, -least(a, z) AS ret FROM c)
SELECT page_id, box_id, adv <= 0.25 * h AND ret >= 0.25 * h AS accepted, CASE WHEN adv <= 0.25 * h AND ret >= 0.25 * h THEN round(greatest(adv, 0), 5) END AS shift FROM d""")
def retreating_fits(spark, sf_dir):
    x = tracks.retreating((F.col("l") - 300) / 40, (F.col("t") - 200) / 30, F.col("b") - F.col("t"))
    return ad.boxes(spark, sf_dir).select("page_id", "box_id", x["accepted"].alias("accepted"), F.round(x["shift"], 5).alias("shift"))


_MARK = "SELECT page_id, box_id, l - 30 - box_id * 4 AS l, t, l - 12 AS r, t + 20 AS b FROM boxes"


@query(f"""WITH {ad.BOXES}, m AS ({_MARK}), j AS (SELECT m.page_id, m.box_id, m.b - m.t AS mh, m.r - m.l AS mw, w.l - m.r AS gap, w.b - w.t AS h, m.t < w.b AND m.b > w.t AS meets FROM m JOIN boxes w ON w.page_id = m.page_id AND w.box_id = m.box_id)
SELECT page_id, box_id, mh >= 0.25 * h AND mh <= h AND mw >= 0.12 * h AND mw <= 1.5 * mh AND gap >= 0.12 * h AND gap <= 1.5 * h AND meets AS compact FROM j""")
def compact_prefixes(spark, sf_dir):
    b = ad.boxes(spark, sf_dir)
    marks = b.select("page_id", "box_id", (F.col("l") - 30 - F.col("box_id") * 4).alias("l"), "t", (F.col("l") - 12).alias("r"), (F.col("t") + 20).alias("b"))
    both = marks.alias("m").join(b.alias("w"), ["page_id", "box_id"])
    return both.select("page_id", "box_id", tracks.compact_prefix("m", "w", F.col("w.b") - F.col("w.t")).alias("compact"))


_LABELLED = "lab AS (SELECT *, CASE box_id % 4 WHEN 0 THEN box_id + 1 || '.' WHEN 1 THEN 'x.' WHEN 2 THEN CAST(box_id + 1 AS VARCHAR) ELSE 'word' END AS text, (page_id * 7 + box_id * 31) % 100 / 100.0 AS confidence, l + (r - l) * CASE WHEN box_id % 3 = 0 THEN 1 ELSE 0.3 END AS r2 FROM boxes)"


def labelled(spark, sf_dir):
    """Boxes with label texts, some of them label-sized."""
    k = F.pmod("box_id", F.lit(4))
    text = F.when(k == 0, F.concat((F.col("box_id") + 1).cast("string"), F.lit("."))).when(k == 1, "x.").when(k == 2, (F.col("box_id") + 1).cast("string")).otherwise("word")
    share = F.when(F.pmod("box_id", F.lit(3)) == 0, 1.0).otherwise(0.3)
    return ad.boxes(spark, sf_dir).withColumn("text", text).withColumn("confidence", F.pmod(F.col("page_id") * 7 + F.col("box_id") * 31, F.lit(100)) / 100).withColumn("r", F.col("l") + (F.col("r") - F.col("l")) * share)


@query(f"""WITH {ad.BOXES}, {_LABELLED}, r AS (SELECT page_id, box_id, CASE WHEN r2 - l > 2.2 * (b - t) THEN 'proposal' WHEN box_id % 4 < 3 AND confidence >= 0.9 THEN 'anchor' WHEN box_id % 4 < 3 AND confidence >= 0.5 THEN 'display' ELSE 'none' END AS role FROM lab)
SELECT page_id, box_id, role, CASE WHEN role = 'anchor' AND box_id % 2 = 0 THEN box_id + 1 END AS n FROM r""")
def grid_anchors(spark, sf_dir):
    return tracks.anchors(labelled(spark, sf_dir))


@query(f"""WITH {ad.BOXES}, p AS (SELECT page_id, box_id, l < 100 AS known, CASE WHEN box_id % 3 > 0 THEN CAST(floor(l / 300) AS BIGINT) END AS track, (r - l) * (b - t) AS area FROM boxes)
SELECT page_id, box_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN NOT known AND track IS NOT NULL THEN 0 ELSE 1 END, track NULLS LAST, area, box_id) AS INTEGER) AS place FROM p""")
def read_schedule(spark, sf_dir):
    track = F.when(F.pmod("box_id", F.lit(3)) > 0, F.floor(F.col("l") / 300))
    return tracks.schedule(ad.boxes(spark, sf_dir).select("page_id", "box_id", (F.col("l") < 100).alias("known"), track.alias("track"), ((F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))).alias("area")))


@query(f"""{_GRID}, n AS (SELECT page_id, column_no, count(*) AS marks, max(b - t) - 15 AS h FROM own GROUP BY ALL)
SELECT c.page_id, c.column_no, CASE WHEN marks < 2 THEN 'few_marks' WHEN reach <= greatest({_LEFT.format('top')}, {_LEFT.format('bottom')}) THEN 'invalid_column' WHEN h < 12 OR h > 400 THEN 'page_scale' ELSE 'applied' END AS reason FROM cols c JOIN n ON n.page_id = c.page_id AND n.column_no = c.column_no""")
def boundary_reasons(spark, sf_dir):
    marks = own(spark, sf_dir).groupBy("page_id", "column_no").agg(F.count("*").alias("marks"), (F.max(F.col("b") - F.col("t")) - 15).alias("h"))
    return columns(spark, sf_dir).join(marks, ["page_id", "column_no"]).select("page_id", "column_no", tracks.boundary_reason(F.col("marks"), F.col("h")).alias("reason"))


_CELLS = f"""r AS (SELECT *, row_number() OVER o - 1 AS row_no, lag(y) OVER o AS up, lead(y) OVER o AS down FROM (SELECT DISTINCT page_id, column_no, {_Y} AS y FROM own) WINDOW o AS (PARTITION BY page_id, column_no ORDER BY y)),
s AS (SELECT DISTINCT page_id, column_no, {_Y} + 7 AS at_y, CASE WHEN box_id % 2 = 0 THEN box_id + 1 END AS n FROM own WHERE box_id % 3 < 2),
near AS (SELECT s.page_id, s.column_no, s.n, min({{'d': abs(y - at_y), 'row_no': row_no}}).row_no AS row_no FROM s JOIN r ON r.page_id = s.page_id AND r.column_no = s.column_no GROUP BY s.page_id, s.column_no, s.at_y, s.n),
held AS (SELECT page_id, column_no, min(row_no) AS low, max(row_no) AS high, CASE WHEN count(DISTINCT n - row_no) = 1 THEN min(n - row_no) END AS shift FROM near GROUP BY ALL),
b0 AS (SELECT r.page_id, r.column_no, row_no, coalesce((up + y) / 2, top) AS ct, coalesce((y + down) / 2, bottom) AS cb, shift, c.* EXCLUDE (page_id, column_no) FROM r JOIN held h ON h.page_id = r.page_id AND h.column_no = r.column_no AND row_no BETWEEN low AND high JOIN cols c ON c.page_id = r.page_id AND c.column_no = r.column_no),
cell AS (SELECT page_id, column_no, CAST(row_no AS INTEGER) AS row_no, greatest({_LEFT.format('ct')}, {_LEFT.format('cb')}) AS l, ct AS t, least({_RIGHT.format('ct')}, {_RIGHT.format('cb')}) AS r, cb AS b, CAST(CASE WHEN shift + row_no > 0 THEN shift + row_no END AS INTEGER) AS n FROM b0)"""


def grid_cells_of(spark, sf_dir):
    b = own(spark, sf_dir)
    y = (F.col("t") + F.col("b")) / 2
    supports = b.where("box_id % 3 < 2").select("page_id", "column_no", (y + 7).alias("y"), F.when(F.pmod("box_id", F.lit(2)) == 0, F.col("box_id") + 1).alias("n"))
    return tracks.cells(columns(spark, sf_dir), b.select("page_id", "column_no", y.alias("y")), supports)


@query(f"{_GRID}, {_CELLS} SELECT page_id, column_no, row_no, round(l, 4) AS l, t, round(r, 4) AS r, b, n FROM cell")
def grid_cells(spark, sf_dir):
    """Cells between the rows that labels support."""
    return grid_cells_of(spark, sf_dir).withColumn("l", F.round("l", 4)).withColumn("r", F.round("r", 4))


@query(f"""{_GRID}, {_CELLS}, x AS (SELECT *, CASE WHEN box_id % 5 = 3 THEN box_id + 1 END AS prefix_n, box_id % 7 AS ink FROM boxes),
m AS (SELECT x.page_id, x.box_id, any_value(prefix_n) AS prefix_n, any_value(ink) AS ink, min({{'c': c.column_no, 'r': c.row_no, 'n': c.n}}) FILTER (c.column_no IS NOT NULL) AS z FROM x LEFT JOIN cell c ON c.page_id = x.page_id AND (x.l + x.r) / 2 >= c.l AND (x.l + x.r) / 2 < c.r AND (x.t + x.b) / 2 >= c.t AND (x.t + x.b) / 2 < c.b GROUP BY x.page_id, x.box_id)
SELECT page_id, box_id, CASE WHEN ink > 0 THEN CASE WHEN prefix_n IS NOT NULL THEN 'prefix' WHEN z IS NOT NULL THEN 'cell' END END AS basis, CAST(CASE WHEN ink > 0 THEN coalesce(prefix_n, z.n) END AS INTEGER) AS n FROM m""")
def cell_support(spark, sf_dir):
    """What supports each box: a prefix of its own, or the cell around it."""
    b = ad.boxes(spark, sf_dir).withColumn("prefix_n", F.when(F.pmod("box_id", F.lit(5)) == 3, F.col("box_id") + 1)).withColumn("ink", F.pmod("box_id", F.lit(7)))
    return tracks.cell_support(b, grid_cells_of(spark, sf_dir))


@query(f"""WITH RECURSIVE {_COLS}, r AS (SELECT page_id, column_no, y, row_number() OVER (PARTITION BY page_id, column_no ORDER BY y) - 1 AS row_no FROM (SELECT DISTINCT page_id, column_no, floor(t / 120) * 120 + 60 AS y FROM own)),
near AS (SELECT o.page_id, o.column_no, o.box_id, o.l, o.t, o.r, o.b, min({{'d': abs(y - (t + b) / 2), 'row_no': row_no}}).row_no AS row_no FROM own o JOIN r ON r.page_id = o.page_id AND r.column_no = o.column_no GROUP BY ALL),
g AS (SELECT *, row_number() OVER (PARTITION BY page_id, column_no, row_no ORDER BY l, box_id) AS k FROM near QUALIFY count(*) OVER (PARTITION BY page_id, column_no, row_no) > 1),
f AS (SELECT page_id, column_no, row_no, k, CAST(box_id AS VARCHAR) AS members, l, t, r, b FROM g WHERE k = 1
  UNION ALL SELECT f.page_id, f.column_no, f.row_no, o.k, f.members || ',' || o.box_id, least(f.l, o.l), least(f.t, o.t), greatest(f.r, o.r), greatest(f.b, o.b) FROM f JOIN g o ON o.page_id = f.page_id AND o.column_no = f.column_no AND o.row_no = f.row_no AND o.k = f.k + 1 AND o.l - f.r <= greatest(f.b - f.t, o.b - o.t, (f.r - f.l) / 2, (o.r - o.l) / 2))
SELECT page_id, column_no, CAST(row_no AS INTEGER) AS row_no, members, l, t, r, b FROM f QUALIFY k = max(k) OVER (PARTITION BY page_id, column_no, row_no)""")
def cell_groups(spark, sf_dir):
    """The leading boxes of each cell that holds several."""
    b = own(spark, sf_dir)
    return tracks.cell_groups(b, b.select("page_id", "column_no", (F.floor(F.col("t") / 120) * 120 + 60).cast("double").alias("y")))


from quillet.plans import traversal as _orders  # noqa: E402, F401  its SQL is used here

_PAIRS = sql.ORACLES["row_joins"].split("SELECT page_id, CAST(column_no")[0]


@query(_PAIRS + f""", q AS (SELECT page_id, ids[1] AS left_id, ids[2] AS right_id, CASE WHEN rows >= 3 AND full_rows = 1 THEN 'candidate' ELSE 'row_structure' END AS reason FROM w WHERE n = 2),
sm AS (SELECT page_id, box_id, l, t, l + (r - l) * 0.3 AS r, b, box_id % 5 = 4 AS protected FROM boxes),
x AS (SELECT q.*, greatest(a.r, z.r) - least(a.l, z.l) AS uw, greatest(a.b, z.b) - least(a.t, z.t) AS uh, a.r - a.l AS aw, a.b - a.t AS ah, z.r - z.l AS zw, z.b - z.t AS zh, z.l - a.r AS gap, least(a.b, z.b) - greatest(a.t, z.t) AS overlap, a.protected OR z.protected AS protected
  FROM q JOIN sm a ON a.page_id = q.page_id AND a.box_id = left_id JOIN sm z ON z.page_id = q.page_id AND z.box_id = right_id)
SELECT page_id, left_id, right_id, CASE WHEN reason <> 'candidate' THEN 'row_structure' WHEN NOT (aw >= ah AND aw < 2.2 * ah) OR NOT (zw >= zh AND zw < 2.2 * zh) THEN 'not_two_small' WHEN uw < 2.2 * uh THEN 'label_sized' WHEN gap > 0.5 * greatest(ah, zh) THEN 'gap' WHEN overlap < 0.6 * least(ah, zh) THEN 'row_overlap' WHEN uw * uh > 1048576 THEN 'budget' WHEN protected THEN 'label' ELSE 'assembled' END AS reason FROM x""")
def compact_unions(spark, sf_dir):
    """Whether two small boxes of a cell make one word."""
    b = ad.boxes(spark, sf_dir)
    pairs = traversal.row_joins(b, layout.axis_groups(b, "x"), layout.axis_groups(b, "y")).select("page_id", "left_id", "right_id", "reason")
    small = b.withColumn("r", F.col("l") + (F.col("r") - F.col("l")) * 0.3).withColumn("protected", F.pmod("box_id", F.lit(5)) == 4)
    return tracks.compact_unions(pairs, small)


@query(f"WITH {ad.BOXES} SELECT page_id, box_id, l < 300 OR box_id % 2 = 0 AS applied, CASE WHEN l < 300 THEN 'track' WHEN box_id % 2 = 0 THEN 'number' ELSE 'no_support' END AS reason FROM boxes")
def prefix_limits(spark, sf_dir):
    return tracks.prefix_limits(ad.boxes(spark, sf_dir).select("page_id", "box_id", (F.col("l") < 300).alias("in_track"), F.when(F.pmod("box_id", F.lit(2)) == 0, F.col("box_id")).alias("n")))


@query(f"""WITH {ad.BOXES}, e AS (SELECT page_id, box_id, box_id // 2 AS owner, CAST(ceil(r - l) * ceil(b - t) AS BIGINT) AS pixels FROM boxes WHERE r - l < 120), p AS (SELECT page_id, box_id, l > 600 AS cell_owned, box_id % 2 = 1 AS protected FROM boxes WHERE box_id < 3)
SELECT e.page_id, e.box_id, CASE WHEN cell_owned IS NULL THEN 'owner_unavailable' WHEN cell_owned THEN 'cell_owned' WHEN count(*) OVER (PARTITION BY e.page_id, owner) > 1 THEN 'many_endings' WHEN protected THEN 'protected' WHEN pixels > 3000 THEN 'budget' ELSE 'candidate' END AS reason FROM e LEFT JOIN p ON p.page_id = e.page_id AND p.box_id = e.owner""")
def union_guards(spark, sf_dir):
    """Why an ending is not joined to its owner."""
    b = ad.boxes(spark, sf_dir)
    endings = b.where("r - l < 120").select("page_id", "box_id", F.floor(F.col("box_id") / 2).cast("int").alias("owner"), (F.ceil(F.col("r") - F.col("l")) * F.ceil(F.col("b") - F.col("t"))).alias("pixels"))
    return tracks.union_guards(endings, b.where("box_id < 3").select("page_id", "box_id", (F.col("l") > 600).alias("cell_owned"), (F.pmod("box_id", F.lit(2)) == 1).alias("protected")), 3000)


@query(f"""WITH {ad.BOXES}, s AS (SELECT * FROM boxes WHERE r - l >= 100), p AS (SELECT * FROM boxes WHERE r - l < 100)
SELECT page_id, box_id, 'blob' AS kind FROM s UNION ALL SELECT page_id, box_id, 'peak' FROM p WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.page_id = p.page_id AND p.l < s.r AND p.r > s.l AND p.t < s.b AND p.b > s.t)""")
def blobs_and_peaks(spark, sf_dir):
    b = ad.boxes(spark, sf_dir)
    return tracks.with_peaks(b.where("r - l >= 100"), b.where("r - l < 100")).select("page_id", "box_id", "kind")


_A = "radians(box_id * 7 % 360)"


@query(f"""WITH {ad.BOXES} SELECT page_id, box_id, round((l - 10) * cos(-{_A}) + (t - 20) * sin(-{_A}), 3) AS page_x, round((t - 20) * cos(-{_A}) - (l - 10) * sin(-{_A}), 3) AS page_y, l AS back_x, t AS back_y FROM boxes""")
def page_points(spark, sf_dir):
    """Corners in the page's frame, and back again."""
    angle = F.pmod(F.col("box_id") * 7, F.lit(360)).cast("double")
    p = ad.boxes(spark, sf_dir).withColumn("p", geo.to_page(F.col("l"), F.col("t"), F.lit(10.0), F.lit(20.0), angle))
    back = geo.to_photo(F.col("p.x"), F.col("p.y"), F.lit(10.0), F.lit(20.0), angle)
    return p.select("page_id", "box_id", F.round("p.x", 3).alias("page_x"), F.round("p.y", 3).alias("page_y"), F.round(back["x"], 6).alias("back_x"), F.round(back["y"], 6).alias("back_y"))


@query(f"""WITH {ad.BOXES} SELECT page_id, box_id, CAST(greatest(round(l * 0.37::DOUBLE), 0) AS INTEGER) AS x0, CAST(least(round(r * 0.37::DOUBLE), 320) AS INTEGER) AS x1, CAST(greatest(round_even((r - l) / 32, 0) * 32, 32) AS INTEGER) AS side,
  abs(cos(radians(box_id * 20 + 30))) <= sin(radians(15)) AS straight, round(0.5::DOUBLE + abs(ln((r - l) / 100)) + abs(ln((b - t) / 28)), 5) AS misfit, b - t > 0 AND r - l > 0 AS valid FROM boxes""")
def frame_checks(spark, sf_dir):
    """Pixel windows, detector sides, skew, misfit and validity of frames."""
    l, t, r, b = (F.col(c) for c in "ltrb")
    turned = F.radians(F.col("box_id") * 20 + 30)
    window = geo.pixel_window(l, t, r - l, b - t, F.lit(0.37), F.lit(320.0), F.lit(400.0))
    return ad.boxes(spark, sf_dir).select(
        "page_id", "box_id", window["x0"].alias("x0"), window["x1"].alias("x1"), geo.detector_side(r - l).alias("side"), geo.skew_allowed(F.lit(1.0), F.lit(0.0), F.cos(turned), F.sin(turned)).alias("straight"),
        F.round(geo.misfit(F.lit(0.5), F.array((r - l) / 100, (b - t) / 28)), 5).alias("misfit"), geo.valid_frame(l, t, r - l, b - t, F.lit(0.0)).alias("valid"),
    )
