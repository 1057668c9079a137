"""Recognition tables made from the driver's tables by plain arithmetic, the same in SQL.

The SQL of each adapter stands beside it: oracles put it in front as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillet.session import table


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, box_id, literal): the tokens of p_name, some of them misread."""
    tokens = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.posexplode(F.split("p_name", " ")).alias("box_id", "w"))
    kind = F.pmod(F.col("page_id") * 3 + F.col("box_id"), F.lit(5))
    literal = (
        F.when(kind == 1, F.concat(F.lit("x"), F.expr("substring(w, 2)")))
        .when(kind == 2, F.concat(F.substring("w", 1, 1), F.expr("substring(w, 3)")))
        .when(kind == 3, F.concat(F.initcap("w"), F.lit(".")))
        .when((kind == 4) & (F.pmod("page_id", F.lit(7)) == 0), F.lit(""))
        .otherwise(F.col("w"))
    )
    return tokens.select("page_id", F.col("box_id").cast("int").alias("box_id"), literal.alias("literal"))


READS = """
tok AS (SELECT p_partkey AS page_id, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS box_id FROM part),
reads AS (SELECT page_id, CAST(box_id AS INTEGER) AS box_id,
  CASE WHEN (page_id * 3 + box_id) % 5 = 1 THEN 'x' || substr(w, 2) WHEN (page_id * 3 + box_id) % 5 = 2 THEN substr(w, 1, 1) || substr(w, 3)
       WHEN (page_id * 3 + box_id) % 5 = 3 THEN upper(substr(w, 1, 1)) || substr(w, 2) || '.' WHEN (page_id * 3 + box_id) % 5 = 4 AND page_id % 7 = 0 THEN '' ELSE w END AS literal FROM tok)"""


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word_id, word): the distinct tokens of p_name, in order; a parameter table of few rows."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return words.select((F.row_number().over(Window.orderBy("word")) - 1).alias("word_id"), "word")


VOCABULARY = """
vocabulary AS (SELECT CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS word_id, word FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part))"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, box_id, word_id, p): a model's distribution over the vocabulary for every read."""
    pairs = reads(spark, sf_dir).select("page_id", "box_id").crossJoin(F.broadcast(vocabulary(spark, sf_dir).select("word_id")))  # a few words a read
    weight = F.pmod(F.col("page_id") * 7 + F.col("box_id") * 13 + F.col("word_id") * 31, F.lit(97))
    raw = pairs.withColumn("w", (weight * weight * weight).cast("double"))
    return raw.select("page_id", "box_id", "word_id", (F.col("w") / F.sum("w").over(Window.partitionBy("page_id", "box_id"))).alias("p"))


CANDIDATES = """
weighed AS (SELECT page_id, box_id, word_id, CAST(pow((page_id * 7 + box_id * 13 + word_id * 31) % 97, 3) AS DOUBLE) AS w FROM reads, vocabulary),
candidates AS (SELECT page_id, box_id, word_id, w / sum(w) OVER (PARTITION BY page_id, box_id) AS p FROM weighed)"""

_ORDER = "l_linenumber l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_shipdate l_returnflag l_linestatus".split()


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, box_id, l, t, r, b): one box per line of an order, three columns of rows."""
    lines = table(spark, sf_dir, "lineitem")
    numbered = lines.select(F.col("l_orderkey").alias("page_id"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)) - 1).alias("box_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    left = (F.pmod("l_partkey", F.lit(3)) * 300 + F.pmod("l_suppkey", F.lit(40))).cast("double")
    top = (F.col("l_linenumber") * 60 + F.pmod("l_partkey", F.lit(17))).cast("double")
    return numbered.select("page_id", "box_id", left.alias("l"), top.alias("t"), (left + 80 + 2 * F.col("l_quantity")).alias("r"), (top + 24 + F.pmod("l_suppkey", F.lit(9))).alias("b"))


BOXES = f"""
boxes AS (SELECT page_id, box_id, l, t, l + 80 + 2 * q AS r, t + 24 + s % 9 AS b FROM (
  SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ORDER)}) - 1 AS INTEGER) AS box_id,
    CAST(l_partkey % 3 * 300 + l_suppkey % 40 AS DOUBLE) AS l, CAST(l_linenumber * 60 + l_partkey % 17 AS DOUBLE) AS t, l_quantity AS q, l_suppkey AS s FROM lineitem))"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, pos, row_pos, kind, n): the turns of a conversation as printed numbers, some out of order or unread; row_pos is the place in the other traversal."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("k"))
    off = F.pmod(F.col("conv_id") * 5 + F.col("k") * 3, F.lit(11))
    other = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.pmod(F.col("k") - 1, F.lit(2)), "k"))
    return turns.select(
        F.col("conv_id").alias("page_id"), F.col("k").alias("pos"), other.alias("row_pos"), F.when(off == 0, F.lit(None)).when(off == 1, "shaped").otherwise("exact").alias("kind"),
        F.when(off > 1, F.when(off == 2, F.col("k") + 1).otherwise(F.col("k"))).cast("int").alias("n"),
    )


LABELS = """
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
labelled AS (SELECT conv_id AS page_id, CAST(k AS INTEGER) AS pos, (conv_id * 5 + k * 3) % 11 AS off FROM turns),
page_labels AS (SELECT page_id, pos, CAST(row_number() OVER (PARTITION BY page_id ORDER BY (pos - 1) % 2, pos) AS INTEGER) AS row_pos, CASE WHEN off = 0 THEN NULL WHEN off = 1 THEN 'shaped' ELSE 'exact' END AS kind,
  CASE WHEN off > 1 THEN CASE WHEN off = 2 THEN pos + 1 ELSE pos END END AS n FROM labelled)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word_no, cell, sym, x): the first 29 components of each vector as a cell's scores; six vectors a word."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 29)).alias("sym", "x"))
    return vectors.select(F.floor(F.col("vec_id") / 6).alias("word_no"), F.pmod("vec_id", F.lit(6)).cast("int").alias("cell"), "sym", F.col("x").cast("double").alias("x"))


CELLS = """
cells AS (SELECT CAST(floor(vec_id / 6) AS BIGINT) AS word_no, CAST(vec_id % 6 AS INTEGER) AS cell, sym, CAST(x AS DOUBLE) AS x FROM (
  SELECT vec_id, unnest(embedding[1:29]) AS x, generate_subscripts(embedding[1:29], 1) - 1 AS sym FROM embeddings))"""


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(attempt_id, seq, kind, region_id): the events of a user as the progress of an attempt."""
    events = table(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.when(F.col("event_type") == "view", "found").when(F.col("event_type") == "click", "reading").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "signup", "excluded").otherwise("removed")
    return events.select(F.col("user_id").alias("attempt_id"), seq.alias("seq"), kind.alias("kind"), F.pmod("event_id", F.lit(12)).alias("region_id"), "event_id", "value")


PROGRESS = """
progress AS (SELECT user_id AS attempt_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq,
  CASE event_type WHEN 'view' THEN 'found' WHEN 'click' THEN 'reading' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'excluded' ELSE 'removed' END AS kind,
  event_id % 12 AS region_id, event_id, value FROM events)"""


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, pos, row_pos, kind, n): a user's events, sixteen a page, as printed numbers; some unread, some out of order."""
    events = progress(spark, sf_dir).select((F.col("attempt_id") * 1000 + F.floor((F.col("seq") - 1) / 16)).alias("page_id"), F.pmod(F.col("seq") - 1, F.lit(16)).alias("pos"), "event_id")
    off = F.pmod(F.col("event_id") * 7 + F.col("pos"), F.lit(13))
    page = Window.partitionBy("page_id").orderBy(F.pmod("pos", F.lit(2)), "pos")
    number = F.when((off == 2) & (F.pmod("page_id", F.lit(3)) == 0), F.pmod(F.col("pos") * 5, F.lit(16)) + 1).otherwise(F.col("pos") + 1)
    return events.select("page_id", "pos", F.row_number().over(page).alias("row_pos"), F.when(off == 0, F.lit(None)).when(off == 1, "shaped").otherwise("exact").alias("kind"), F.when(off > 1, number).cast("int").alias("n"))


NUMBERED = """
events16 AS (SELECT attempt_id * 1000 + (seq - 1) // 16 AS page_id, (seq - 1) % 16 AS pos, event_id FROM progress),
offs AS (SELECT *, (event_id * 7 + pos) % 13 AS off FROM events16),
page_labels AS (SELECT page_id, pos, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos % 2, pos) AS INTEGER) AS row_pos, CASE WHEN off = 0 THEN NULL WHEN off = 1 THEN 'shaped' ELSE 'exact' END AS kind,
  CAST(CASE WHEN off > 1 THEN CASE WHEN off = 2 AND page_id % 3 = 0 THEN pos * 5 % 16 + 1 ELSE pos + 1 END END AS INTEGER) AS n FROM offs)"""
