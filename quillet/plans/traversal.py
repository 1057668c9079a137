"""Queries over a page's orders and an attempt's progress, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillet.operators import layout, sequences, traversal
from quillet.plans import registry, sql
from quillet.plans.evidence import query
from quillet.session import table
from quillet.sources import adapters as ad

_MEDIAN2 = "(list_sort({0})[(len({0}) - 1) // 2 + 1] + list_sort({0})[len({0}) // 2 + 1]) / 2"


def boxes(spark, sf_dir):
    return ad.boxes(spark, sf_dir)


@query(f"""WITH RECURSIVE {ad.BOXES}, o AS (SELECT *, (t + b) / 2 AS y, row_number() OVER (PARTITION BY page_id ORDER BY (t + b) / 2, box_id) AS k FROM boxes),
g AS (SELECT page_id, list(gap) FILTER (gap >= 1) AS gaps FROM (SELECT page_id, y - lag(y) OVER (PARTITION BY page_id ORDER BY k) AS gap FROM o) GROUP BY page_id),
p AS (SELECT page_id, coalesce({_MEDIAN2.format('gaps')}, 0) AS pitch FROM g),
f AS (SELECT page_id, k, box_id, 0 AS row_no, y AS first_y, t AS top, b AS bottom FROM o WHERE k = 1
  UNION ALL SELECT o.page_id, o.k, o.box_id, CASE WHEN hit THEN row_no ELSE row_no + 1 END, CASE WHEN hit THEN first_y ELSE y END, CASE WHEN hit THEN greatest(top, t) ELSE t END, CASE WHEN hit THEN least(bottom, b) ELSE b END
  FROM (SELECT f.page_id, f.row_no, f.first_y, f.top, f.bottom, o.k, o.box_id, o.y, o.t, o.b, greatest(f.top, o.t) < least(f.bottom, o.b) AND o.y - f.first_y < p.pitch / 2 AS hit FROM f JOIN o ON o.page_id = f.page_id AND o.k = f.k + 1 JOIN p ON p.page_id = f.page_id) o)
SELECT page_id, row_no, box_id FROM f""")
def detector_rows(spark, sf_dir):
    return traversal.detector_rows(boxes(spark, sf_dir))


@query(f"""WITH RECURSIVE {ad.BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY l, box_id) AS k FROM boxes),
f AS (SELECT page_id, k, CAST(box_id AS VARCHAR) AS members, l, t, r, b FROM o WHERE k = 1
  UNION ALL SELECT f.page_id, o.k, f.members || ',' || o.box_id, least(f.l, o.l), least(f.t, o.t), greatest(f.r, o.r), greatest(f.b, o.b) FROM f JOIN o ON o.page_id = f.page_id AND o.k = f.k + 1 AND o.l - f.r <= greatest(f.b - f.t, o.b - o.t, (f.r - f.l) / 2, (o.r - o.l) / 2))
SELECT page_id, members, l, t, r, b FROM f QUALIFY k = max(k) OVER (PARTITION BY page_id)""")
def leading_groups(spark, sf_dir):
    return traversal.leading_groups(boxes(spark, sf_dir))


@query(f"""WITH {ad.BOXES}, y AS (SELECT DISTINCT page_id, (t + b) / 2 AS y FROM boxes), n AS (SELECT *, row_number() OVER o - 1 AS start, lead(y) OVER o AS y2, lead(y, 2) OVER o AS y3, lead(y, 3) OVER o AS y4 FROM y WINDOW o AS (PARTITION BY page_id ORDER BY y)),
c AS (SELECT page_id, start, [y2 - y, y3 - y2, y4 - y3] AS g FROM n WHERE y4 IS NOT NULL), d AS (SELECT *, greatest(list_sort(g)[2], 1) AS p FROM c),
e AS (SELECT page_id, start, pow((g[2] - g[1]) / p, 2) + pow((g[3] - g[2]) / p, 2) AS cost FROM d)
SELECT page_id, start, round(cost, 5) AS cost FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY cost, start) AS k FROM e) WHERE k = 1""")
def row_windows(spark, sf_dir):
    """The most evenly spaced four rows of a page."""
    return traversal.row_windows(boxes(spark, sf_dir), 4).withColumn("cost", F.round("cost", 5))


@query(f"""WITH RECURSIVE {ad.BOXES}, y AS (SELECT page_id, y, row_number() OVER (PARTITION BY page_id ORDER BY y) AS k FROM (SELECT DISTINCT page_id, (t + b) / 2 AS y FROM boxes)),
f AS (SELECT page_id, k, y, 40.0::DOUBLE AS p, 0 AS nth, true AS shown FROM y WHERE k = 1
  UNION ALL SELECT f.page_id, y.k, y.y, CASE WHEN round((y.y - f.y) / p) = 0 THEN p ELSE (y.y - f.y) / round((y.y - f.y) / p) END, f.nth + CAST(round((y.y - f.y) / p) AS INTEGER), round((y.y - f.y) / p) > 0 FROM f JOIN y ON y.page_id = f.page_id AND y.k = f.k + 1)
SELECT page_id, y, nth AS number FROM f WHERE shown""")
def lattice_numbers(spark, sf_dir):
    return traversal.lattice_numbers(boxes(spark, sf_dir), 40.0)


_EXTENT = "least({0}.r - {0}.l, {0}.b - {0}.t)"
_BEFORE = f"CASE WHEN abs((o.t + o.b) / 2 - (q.t + q.b) / 2) > ({_EXTENT.format('o')} + {_EXTENT.format('q')}) / 4 THEN o.t + o.b < q.t + q.b ELSE o.l + o.r < q.l + q.r END"


@query(f"""WITH RECURSIVE {ad.BOXES}, f AS (SELECT page_id, -1 AS box_id, []::STRUCT(box_id INTEGER, l DOUBLE, t DOUBLE, r DOUBLE, b DOUBLE)[] AS done FROM boxes GROUP BY page_id
  UNION ALL SELECT f.page_id, f.o.box_id, list_concat(done[1:spot - 1], [f.o], done[spot:]) FROM (
    SELECT f.*, x.o, coalesce(list_position(list_transform(f.done, lambda q: {_BEFORE.replace('o.', 'x.o.')}), true), len(f.done) + 1) AS spot FROM f JOIN (SELECT page_id, box_id, {{'box_id': box_id, 'l': l, 't': t, 'r': r, 'b': b}} AS o FROM boxes) x ON x.page_id = f.page_id AND x.box_id = f.box_id + 1) f),
e AS (SELECT page_id, arg_max(done, box_id) AS done FROM f GROUP BY page_id)
SELECT page_id, unnest(done).box_id AS box_id, CAST(generate_subscripts(done, 1) - 1 AS INTEGER) AS place FROM e""")
def reading_order(spark, sf_dir):
    return traversal.reading_order(boxes(spark, sf_dir))


@query(f"""WITH {ad.PROGRESS}, {ad.NUMBERED}, k AS (SELECT * FROM page_labels WHERE pos % 5 <> 4)
SELECT page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS by_columns, row_number() OVER (PARTITION BY page_id ORDER BY row_pos) AS by_rows, row_number() OVER (PARTITION BY page_id ORDER BY n NULLS LAST, pos) AS by_numbers FROM k""")
def traversals(spark, sf_dir):
    return traversal.traversals(ad.numbered(spark, sf_dir).withColumn("stray", F.pmod("pos", F.lit(5)) == 4))


@query(f"""WITH {ad.READS}, {ad.VOCABULARY}, {ad.CANDIDATES}, {sql._RANKED}, s AS (SELECT page_id, box_id AS stream, model_rank AS rank, word_id AS item, model_rank * (box_id + 1) AS cost FROM ranked),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page_id, item ORDER BY cost, stream, rank) = 1)
SELECT page_id, item, row_number() OVER (PARTITION BY page_id ORDER BY cost, stream, rank, item) AS place FROM f""")
def merged_streams(spark, sf_dir):
    """Words of all boxes' rankings as one order, each once."""
    from quillet.operators.candidates import ranked

    r = ranked(ad.candidates(spark, sf_dir))
    return traversal.merged_streams(r.select("page_id", F.col("box_id").alias("stream"), F.col("model_rank").alias("rank"), F.col("word_id").alias("item"), (F.col("model_rank") * (F.col("box_id") + 1)).alias("cost")))


_PLACES = "place AS (SELECT page_id, box_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY group_no, k) - 1 AS INTEGER) AS place FROM (SELECT page_id, group_no, unnest(members) AS box_id, generate_subscripts(members, 1) AS k FROM columns_groups))"


@query(f"""WITH RECURSIVE {ad.BOXES}, {sql._PADDED}, {sql._COLUMNS}, {_PLACES}
SELECT e.page_id, x.place AS a, y.place AS b FROM edges e JOIN place x ON x.page_id = e.page_id AND x.box_id = e.a JOIN place y ON y.page_id = e.page_id AND y.box_id = e.b""")
def reindexed_links(spark, sf_dir):
    """Links between boxes after these were put in column order."""
    from pyspark.sql import Window

    b = boxes(spark, sf_dir)
    members = layout.axis_groups(b, "x").select("page_id", "group_no", F.posexplode("members").alias("k", "box_id"))
    order = members.select("page_id", "box_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("group_no", "k")) - 1).alias("place"))
    return traversal.reindexed(layout.reach_edges(b), order)


@query(f"WITH {ad.BOXES} SELECT page_id, box_id, place FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY (r - l) * (b - t) DESC, box_id) AS place FROM boxes) WHERE place <= 3")
def largest_boxes(spark, sf_dir):
    return traversal.largest(boxes(spark, sf_dir), 3)


@query(f"""WITH RECURSIVE {ad.BOXES}, {sql._COLUMNS} SELECT page_id, CAST(group_no AS INTEGER) AS group_no, array_to_string(list_filter(members, lambda m: m % 3 <> 1), ',') AS members FROM columns_groups""")
def selected_groups(spark, sf_dir):
    """Columns without every third box, not grouped anew."""
    b = boxes(spark, sf_dir)
    out = traversal.selected_groups(layout.axis_groups(b, "x"), b.select("page_id", "box_id").where("box_id % 3 <> 1"))
    return out.withColumn("members", F.array_join("members", ","))


@query(f"""WITH RECURSIVE {ad.BOXES}, {sql._COLUMNS}, {sql._ROWS}, c AS (SELECT page_id, group_no AS column_no, unnest(members) AS box_id FROM columns_groups), r AS (SELECT page_id, group_no AS row_no, unnest(members) AS box_id FROM rows_groups),
m AS (SELECT c.page_id, column_no, row_no, b.* EXCLUDE (page_id) FROM c JOIN r ON r.page_id = c.page_id AND r.box_id = c.box_id JOIN boxes b ON b.page_id = c.page_id AND b.box_id = c.box_id),
s AS (SELECT page_id, column_no, row_no, count(*) AS n, list(box_id ORDER BY l, box_id) AS ids, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM m GROUP BY ALL),
w AS (SELECT *, count(*) OVER (PARTITION BY page_id, column_no) AS rows, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, column_no) AS full_rows FROM s)
SELECT page_id, CAST(column_no AS INTEGER) AS column_no, CAST(row_no AS INTEGER) AS row_no, ids[1] AS left_id, ids[2] AS right_id, CASE WHEN rows >= 3 AND full_rows = 1 THEN 'candidate' ELSE 'row_structure' END AS reason, l, t, r, b FROM w WHERE n = 2""")
def row_joins(spark, sf_dir):
    """Pairs of boxes in one cell, with the union that a joined read would take."""
    b = boxes(spark, sf_dir)
    return traversal.row_joins(b, layout.axis_groups(b, "x"), layout.axis_groups(b, "y"))


@query(f"""WITH {ad.PROGRESS}, c AS (SELECT attempt_id AS page_id, seq AS place, region_id AS parent FROM progress), n AS (SELECT *, row_number() OVER (PARTITION BY page_id, parent ORDER BY place) > 1 AS fresh, max(parent) OVER (PARTITION BY page_id) AS top FROM c)
SELECT page_id, place, parent, CAST(CASE WHEN NOT fresh THEN parent ELSE top + sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY place) END AS BIGINT) AS id FROM n""")
def child_ids(spark, sf_dir):
    p = ad.progress(spark, sf_dir)
    return traversal.child_ids(p.select(F.col("attempt_id").alias("page_id"), F.col("seq").alias("place"), F.col("region_id").alias("parent")))


@query(f"""WITH {ad.PROGRESS}, w AS (SELECT attempt_id, seq, (seq + event_id % 3) // 8 AS phase, CASE WHEN event_id % 4 > 0 THEN 20 END AS total, seq % 8 * 3 + event_id % 2 AS completed FROM progress),
l AS (SELECT *, lag(phase) OVER o AS bp, lag(total) OVER o AS bt, lag(completed) OVER o AS bc FROM w WINDOW o AS (PARTITION BY attempt_id ORDER BY seq))
SELECT attempt_id, seq, coalesce(bp > phase, false) OR coalesce(completed > total, false) OR coalesce(bp = phase AND (bt IS DISTINCT FROM total OR completed < bc), false) AS malformed FROM l""")
def work_checks(spark, sf_dir):
    p = ad.progress(spark, sf_dir)
    work = p.select(
        "attempt_id", "seq", F.floor((F.col("seq") + F.pmod("event_id", F.lit(3))) / 8).alias("phase"), F.when(F.pmod("event_id", F.lit(4)) > 0, 20).alias("total"), (F.pmod("seq", F.lit(8)) * 3 + F.pmod("event_id", F.lit(2))).alias("completed")
    )
    return traversal.work_checks(work)


@query(f"WITH {ad.PROGRESS} SELECT attempt_id, count(DISTINCT region_id) AS seen, count(DISTINCT region_id) <= 11 AS overlays FROM progress GROUP BY attempt_id")
def overlay_caps(spark, sf_dir):
    return traversal.overlays(ad.progress(spark, sf_dir), 11)


@query(f"""WITH {ad.PROGRESS}, {sql._ROLLUP}, a AS (SELECT DISTINCT attempt_id, region_id FROM rollup), b AS (SELECT DISTINCT attempt_id, region_id FROM progress WHERE kind = 'completed')
SELECT coalesce(a.attempt_id, b.attempt_id) AS attempt_id, coalesce(a.region_id, b.region_id) AS region_id, CASE WHEN b.region_id IS NULL THEN 'live_only' WHEN a.region_id IS NULL THEN 'final_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.attempt_id = b.attempt_id AND a.region_id = b.region_id""")
def matched_regions(spark, sf_dir):
    """Live regions against those that a completion names."""
    p = ad.progress(spark, sf_dir)
    return traversal.matched_ids(sequences.latest_regions(p).select("attempt_id", "region_id"), p.where("kind = 'completed'").select("attempt_id", "region_id"))


@query("""WITH d AS (SELECT doc_id, length(text) AS size, sha256(text) AS h FROM documents), f AS (SELECT h, size, min(doc_id) AS reader, count(*) AS copies FROM d GROUP BY ALL)
SELECT d.doc_id, f.reader, f.copies FROM d JOIN f USING (h, size)""")
def read_cache(spark, sf_dir):
    """Equal contents are read once: each row with the one that is read for it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("size"), F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h", "size").agg(F.min("doc_id").alias("reader"), F.count("*").alias("copies"))
    return docs.join(first, ["h", "size"]).select("doc_id", "reader", "copies")
