"""Mixing sources to target weights: a low-discrepancy source schedule over equal-token blocks.

Sources, by code point with null last, weigh 1, 2, 3, 1, 2, 3, ... and share the whole of all
sizes; a source's target stops at MAX_REPEATS times its size, and the excess is shared anew by
weight until none is above. The schedule has one slot per BLOCK_WORDS words of the mix. Slot t has
the golden-ratio point frac((t + 0.5) * GOLDEN), which the cumulative targets map to a source. A
source's documents are shuffled by hash into one stream of words, which goes round and round and is cut
into equal blocks; the source's r-th slot takes block r, until the words of its target, rounded, are
taken: its last block is cut there. The schedule gives a source a few slots more or less than that needs;
slots beyond it stay empty, and missing ones follow at the schedule's end. So any stretch of the schedule
holds the sources in proportion, every source ends at its target, and no document is taken more often
than MAX_REPEATS times.

Nothing is gathered in one task: offsets in a source's stream come from sums over hash ranges
(RANGES of them at most per source) and a running sum inside each range, and ranks of slots in the
same way from CHUNK slots each. Slots and blocks meet by (source, rank). A source's table of targets has
one row per source and is broadcast only below the size that Spark checks itself.

Defined results: a null or empty text has size 0 and taken 0; a null doc_id keeps its row (as do
repeated rows: each row is a document of its own); a null source is a source like others; an empty
table gives no rows; sources without words have target 0; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.session import materialize, ship_package

from .text import binary_column, map_batches, only

BLOCK_WORDS = 256
MAX_REPEATS = 3
GOLDEN = 0.6180339887498949
RANGES = 4096
#: Slots that are ranked together.
CHUNK = 1 << 16


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size): size is the number of maximal runs outside \\x20 and \\x09-\\x0D, 0 for null."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes = [len((t or b"").split()) for t in binary_column(batch, "text")]
            return pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "size"])

        return step

    docs = only(documents, "doc_id", "source", "text").select(*[F.col(c).cast(kind).alias(c) for c, kind in (("doc_id", "long"), ("source", "string"), ("text", "string"))])
    return map_batches(docs, make, "doc_id long, source string, size long")


def targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): water filling, in closed form.

    A source is held at its cap when the level (target over weight) exceeds cap / weight. Sorted by
    that ratio, the held ones are a prefix, so the level follows from running sums and no loop is
    needed. If all are held, each has its cap.
    """
    everything = Window.orderBy(F.col("source").isNull(), "source")
    weighed = sizes.withColumn("weight", (F.row_number().over(everything) - 1) % 3 + 1).withColumn("cap", max_repeats * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    filled = (
        weighed.withColumn("total", F.sum("source_size").over(every))
        .withColumn("held_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("held_before")) / F.col("weight_left"))
        .withColumn("is_held", F.col("level") * F.col("weight") > F.col("cap"))
    )
    # the first source that is not held has the level of all that follow
    level = F.min(F.when(~F.col("is_held"), F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull().alias("z"), F.coalesce("source", F.lit("")).alias("s"), F.col("level").alias("level")))).over(every)["level"]
    return filled.withColumn("free_level", level).select(
        "source", "source_size", "weight",
        F.when(F.col("is_held") | F.col("free_level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("free_level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"),
    )


def schedule(goals: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The slots of the mix, (slot, source): the golden-ratio points mapped through the cumulative targets."""
    spark = goals.sparkSession
    order = Window.orderBy(F.col("source").isNull(), "source")
    bounds = goals.withColumn("up_to", F.sum("target").over(order)).withColumn("total", F.sum("target").over(Window.partitionBy()))
    bounds = bounds.select("source", (F.col("up_to") - F.col("target")).alias("low"), F.col("up_to").alias("high"), "total")
    n = goals.agg(F.sum("target")).first()[0] or 0.0
    n_slots = int(-(-n // block_words))
    slots = spark.range(0, n_slots).withColumn("x", F.pmod((F.col("id") + 0.5) * F.lit(GOLDEN), F.lit(1.0)))
    # cumulative bounds as one sorted row per source; a slot finds its own by binary search
    edges = bounds.where("high > low").orderBy("low").select("source", (F.col("low") / F.col("total")).alias("low")).collect()  # one row per source
    if not edges:
        return slots.select(F.col("id").alias("slot"), F.lit(None).cast("string").alias("source"))
    found = F.lit(0)
    lows = [e["low"] for e in edges]
    names = F.array(*[F.lit(e["source"]).cast("string") for e in edges])

    def search(a: int, b: int) -> Column:
        """The last edge in [a, b) that is not above x, as nested conditions of depth log2(sources)."""
        if b - a == 1:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(F.col("x") < lows[mid], search(a, mid)).otherwise(search(mid, b))

    found = search(0, len(lows))
    return slots.withColumn("k", found).select(F.col("id").alias("slot"), names[F.col("k")].alias("source"))


def ranked(slots: DataFrame) -> DataFrame:
    """(slot, source, rank): how many of the source's slots come before."""
    chunked = slots.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = chunked.groupBy("source", "chunk").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = chunked.withColumn("inside", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1)
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.chunk") == F.col("b.chunk"))
    return inside.alias("a").join(counts.alias("b"), same).select("slot", F.col("a.source").alias("source"), (F.col("before") + F.col("inside")).alias("rank"))


def _streamed(documents: DataFrame, max_repeats: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, size, source, source_size, target, total, start) of each row, and the sources' targets.

    start is the row's place in its source's shuffled stream of words, total the words that its source gives.
    """
    docs = materialize(sized(documents), "sizes")  # a few bytes a document: the texts are read once
    docs = docs.withColumn("place", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).withColumn("part", F.substring("place", 1, 3))
    sums = docs.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    goals = targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), max_repeats)
    goals = materialize(goals.withColumn("total", F.floor(F.col("target") + 0.5)), "targets")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.withColumn("part_start", F.coalesce(F.sum("part_size").over(before), F.lit(0))).drop("part_size")
    places = parts.alias("p").join(goals.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))).select("p.source", "part", "part_start", "source_size", "target", "total")
    inside = Window.partitionBy("source", "part").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    streamed = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = streamed.alias("d").join(places.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.part") == F.col("q.part")))
    return joined.select("doc_id", "size", F.col("d.source").alias("source"), "source_size", "target", "total", (F.col("part_start") + F.col("inside")).alias("start")), goals


def _ordered(streamed: DataFrame, goals: DataFrame, block_words: int) -> DataFrame:
    """The mix: each slot's pieces of documents, with the columns of streamed and (slot, rank, piece_start, words)."""
    slots = ranked(schedule(goals, block_words))
    given = slots.groupBy("source").agg(F.max("rank").alias("last"))
    need = F.ceil(F.col("total") / block_words)
    per_source = goals.alias("g").join(given.alias("n"), F.col("g.source").eqNullSafe(F.col("n.source")), "left").select("g.source", need.alias("need"), F.coalesce(F.col("last") + 1, F.lit(0)).alias("given"))
    # the schedule's discrepancy: a few slots a source
    late = per_source.where("given < need").select(F.lit(None).cast("long").alias("slot"), "source", F.explode(F.sequence("given", F.col("need") - 1)).alias("rank"))
    slots = slots.unionByName(late)
    # a document's places in the stream as it goes round, block by block, up to its source's words
    rounds = streamed.where("size > 0 AND total > start").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - F.col("start") - 1) / F.col("source_size")))))
    low = F.col("turn") * F.col("source_size") + F.col("start")
    rounds = rounds.withColumn("low", low).withColumn("high", F.least(F.col("low") + F.col("size"), F.col("total")))
    blocks = rounds.withColumn("rank", F.explode(F.sequence(F.floor(F.col("low") / block_words), F.floor((F.col("high") - 1) / block_words))))
    begin = F.greatest(F.col("low"), F.col("rank") * block_words)
    pieces = blocks.withColumn("piece_start", begin - F.col("low")).withColumn("words", F.least(F.col("high"), (F.col("rank") + 1) * block_words) - begin)
    joined = pieces.alias("p").join(slots.alias("s"), F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.rank") == F.col("s.rank")))
    return joined.select("doc_id", "size", F.col("p.source").alias("source"), "source_size", "target", "start", "slot", F.col("p.rank").alias("rank"), "piece_start", "words")


def blocks(documents: DataFrame, block_words: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The mix in pieces: slot (null: after all others), source, rank, doc_id, piece_start and words.

    Read by slot, then rank, then the pieces' places: each row is a run of words of one document.
    """
    ship_package(documents.sparkSession)
    streamed, goals = _streamed(documents, max_repeats)
    return _ordered(streamed, goals, block_words).select("slot", "source", "rank", "doc_id", "piece_start", "words", "start")


def mix(documents: DataFrame, block_words: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target, taken and the place in its source's stream."""
    ship_package(documents.sparkSession)
    streamed, goals = _streamed(documents, max_repeats)
    streamed = materialize(streamed, "stream")
    # with words, (source, start) is one row: two of a source never start at one place
    keys = ["doc_id", "size", "source", "source_size", "target", "start"]
    taken = _ordered(streamed, goals, block_words).groupBy(*keys).agg(F.sum("words").alias("taken"))
    none = streamed.where("size = 0 OR total <= start").select(*keys, F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none).select("doc_id", "size", "source_size", "target", "taken", "source", F.col("start").alias("stream_start"))


ORACLE_SQL = """
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM sizes),
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT first(level ORDER BY cap / weight, source IS NULL, source) AS free_level FROM filled WHERE level * weight <= cap),
goals AS (
  SELECT source, source_size,
         CASE WHEN level * weight > cap OR free_level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(free_level * weight, CAST(cap AS DOUBLE)) END AS target
  FROM filled, free),
streamed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM docs)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (total // source_size) * size + greatest(0, least(total % source_size - start, size)) END AS BIGINT) AS taken,
       d.source AS source, CAST(start AS BIGINT) AS stream_start
FROM streamed d JOIN (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS total FROM goals) h ON d.source IS NOT DISTINCT FROM h.source
"""
