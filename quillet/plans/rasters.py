"""Queries over rasters in long form, each with its SQL: a vector's components stand for a crop of eight by eight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.operators import raster
from quillet.plans.evidence import query
from quillet.session import table


def pixels(spark, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("crop_id"), F.posexplode("embedding").alias("i", "e"))
    return v.select("crop_id", F.floor(F.col("i") / 8).cast("int").alias("y"), F.pmod("i", F.lit(8)).cast("int").alias("x"), F.floor(F.col("e").cast("double") * 40 + 100).cast("int").alias("v"))


_PIXELS = """
px AS (SELECT vec_id AS crop_id, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(floor(CAST(e AS DOUBLE) * 40 + 100) AS INTEGER) AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings)),
h AS (SELECT crop_id, v, count(*) AS n FROM px GROUP BY ALL),
c AS (SELECT *, sum(n) OVER o AS w0, sum(n * v) OVER o AS s0, sum(n) OVER (PARTITION BY crop_id) AS w, sum(n * v) OVER (PARTITION BY crop_id) AS s FROM h WINDOW o AS (PARTITION BY crop_id ORDER BY v)),
otsu AS (SELECT crop_id, v AS threshold FROM c WHERE w0 < w QUALIFY row_number() OVER (PARTITION BY crop_id ORDER BY w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) DESC, v) = 1),
ink AS (SELECT crop_id, y, x FROM px JOIN otsu USING (crop_id) WHERE v <= threshold)"""


@query(f"""WITH {_PIXELS}, l AS (SELECT crop_id, min(v) FILTER (w0 >= 0.5 * w) AS median, min(v) FILTER (w0 >= 0.95 * w) AS p95 FROM c GROUP BY crop_id) SELECT l.crop_id, median, p95, threshold FROM l LEFT JOIN otsu ON otsu.crop_id = l.crop_id""")
def raster_levels(spark, sf_dir):
    """Paper, white and the threshold that parts a crop's histogram."""
    p = pixels(spark, sf_dir)
    return raster.paper_and_white(p).join(raster.otsu(p), "crop_id", "left")


@query(f"""WITH {_PIXELS}, g AS (SELECT *, x - row_number() OVER (PARTITION BY crop_id, y ORDER BY x) AS g FROM ink) SELECT crop_id, y, min(x) AS x0, max(x) + 1 AS x1 FROM g GROUP BY crop_id, y, g""")
def ink_runs(spark, sf_dir):
    p = pixels(spark, sf_dir)
    return raster.runs(raster.ink(p, raster.otsu(p)))


@query(f"""WITH RECURSIVE {_PIXELS}, reach AS (SELECT crop_id, y, x, y * 8 + x AS root FROM ink UNION SELECT i.crop_id, i.y, i.x, r.root FROM reach r JOIN ink i ON i.crop_id = r.crop_id AND abs(i.y - r.y) <= 1 AND abs(i.x - r.x) <= 1),
named AS (SELECT crop_id, y, x, min(root) AS root FROM reach GROUP BY ALL)
SELECT crop_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, CAST(count(*) AS INTEGER) AS pixels FROM named GROUP BY crop_id, root""")
def ink_components(spark, sf_dir):
    """Boxes and sizes of connected ink."""
    p = pixels(spark, sf_dir)
    return raster.label_components(raster.ink(p, raster.otsu(p))).drop("label")


@query(f"WITH {_PIXELS} SELECT a.crop_id, a.y, a.x, round(avg(b.v), 6) AS mean FROM px a JOIN px b ON b.crop_id = a.crop_id AND abs(b.y - a.y) <= 2 AND abs(b.x - a.x) <= 2 GROUP BY ALL")
def local_means(spark, sf_dir):
    return raster.local_mean(pixels(spark, sf_dir), 2).withColumn("mean", F.round("mean", 6))


@query(f"""WITH RECURSIVE {_PIXELS}, o AS (SELECT *, row_number() OVER (PARTITION BY crop_id ORDER BY v DESC, y, x) AS k FROM px),
f AS (SELECT crop_id, 0::BIGINT AS k, []::STRUCT(x INTEGER, y INTEGER, v INTEGER)[] AS kept FROM px GROUP BY crop_id
  UNION ALL SELECT f.crop_id, o.k, CASE WHEN len(list_filter(f.kept, lambda q: (q.x - o.x) * (q.x - o.x) + (q.y - o.y) * (q.y - o.y) < 9)) = 0 THEN list_append(f.kept, {{'x': o.x, 'y': o.y, 'v': o.v}}) ELSE f.kept END FROM f JOIN o ON o.crop_id = f.crop_id AND o.k = f.k + 1),
e AS (SELECT crop_id, unnest(arg_max(kept, k)) AS p FROM f GROUP BY crop_id)
SELECT crop_id AS page_id, CAST(p.x AS DOUBLE) AS x, CAST(p.y AS DOUBLE) AS y, CAST(p.v AS DOUBLE) AS score FROM e""")
def kept_peaks(spark, sf_dir):
    """Peaks without those that lie near a stronger one."""
    peaks = pixels(spark, sf_dir).select(F.col("crop_id").alias("page_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("v").cast("double").alias("score"))
    return raster.suppressed_peaks(peaks, 3.0)
