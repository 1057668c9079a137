"""Candidate selection: score every word for a read, rank, and say how far the evidence goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions.strings import BUDGET, log_score, normalise, weighted_distance

#: Words up to which a vocabulary is broadcast; a larger one is joined by its words.
VOCABULARY_BROADCAST = 100_000


def pair_distances(reads: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(read, word_id, word, d) of each distinct normalised read and each word.

    The distance depends on the spelling alone, so reads are made distinct before they meet the
    vocabulary, a parameter table whose words travel as one array.
    """
    spellings = reads.select(normalise(F.col("literal")).alias("read")).where("read <> ''").distinct()
    every = vocabulary.agg(F.collect_list(F.struct("word_id", "word")).alias("words")).first().words
    words = F.array(*[F.struct(F.lit(w.word_id).alias("word_id"), F.lit(w.word).alias("word")) for w in every]) if every else F.array().cast("array<struct<word_id:int,word:string>>")
    pairs = spellings.select("read", F.explode(words).alias("w")).select("read", "w.word_id", "w.word")
    return pairs.withColumn("d", weighted_distance(F.col("read"), F.col("word")))


def closest_words(distances: DataFrame) -> DataFrame:
    """(read, word, d, near): the nearest word of each read, the earlier of two as near."""
    first = F.row_number().over(Window.partitionBy("read").orderBy("d", "word_id"))
    return distances.withColumn("k", first).where("k = 1").select("read", "word", "d", (F.col("d") <= BUDGET).alias("near"))


def ranked(candidates: DataFrame) -> DataFrame:
    """Candidates with their rank by probability (ties by word) and the margin of the first over the second."""
    order = Window.partitionBy("page_id", "box_id").orderBy(F.desc("p"), "word_id")
    return candidates.withColumn("model_rank", F.row_number().over(order)).withColumn("margin", F.when(F.col("model_rank") == 1, F.col("p") - F.lead("p").over(order)))


def select(reads: DataFrame, candidates: DataFrame, vocabulary: DataFrame, min_prob: float, min_margin: float) -> DataFrame:
    """One row a read: word, branch, support_rank, support_p, margin and confirmation.

    A read that is a word is taken. Else all candidates are scored by log10(p) - distance and ranked
    by score, probability, distance and word; without a read, or with one candidate, the model's first
    is taken. A word that the ranking doesn't hold has confirmation `unavailable`; where there is
    neither a word nor a candidate of some probability the word is null and the confirmation
    `no_candidate`. No read is dropped. A box's ranking is one array, so boxes are shuffled and not
    their candidates.
    """
    small = F.broadcast(vocabulary.select("word_id", "word")) if vocabulary.count() <= VOCABULARY_BROADCAST else vocabulary.select("word_id", "word")
    read = reads.select("page_id", "box_id", normalise(F.col("literal")).alias("read"))
    exact = read.join(small.select(F.col("word").alias("read"), F.col("word_id").alias("exact_id")), "read", "left")
    one = F.struct((-F.col("p")).alias("q"), F.col("word_id").alias("word_id"))
    rankings = candidates.groupBy("page_id", "box_id").agg(F.array_sort(F.collect_list(one)).alias("ranking"))
    open_ = exact.where("exact_id IS NULL").select(F.col("read").alias("literal"))
    by_word = F.map_from_entries(F.collect_list(F.struct("word_id", "d")))
    distances = pair_distances(open_, vocabulary).groupBy("read").agg(by_word.alias("distances"))
    boxes = exact.join(rankings, ["page_id", "box_id"], "left").join(distances, "read", "left")
    # by score, then probability, distance and word: greatest first
    scored = F.transform("ranking", lambda c: F.struct((-log_score(-c["q"], F.element_at("distances", c["word_id"]))).alias("cost"), c["q"].alias("q"), F.element_at("distances", c["word_id"]).alias("d"), c["word_id"].alias("word_id")))
    boxes = boxes.withColumn("joint", F.when(F.col("exact_id").isNull() & (F.col("read") != ""), F.array_sort(scored)))
    top = F.get("ranking", F.lit(0))
    margin = F.get("ranking", F.lit(1))["q"] - top["q"]
    usable = F.coalesce(top["q"] < 0, F.lit(False))
    chosen = F.when(F.col("exact_id").isNotNull(), F.col("exact_id")).when(usable, F.coalesce(F.get("joint", F.lit(0))["word_id"], top["word_id"]))
    boxes = boxes.withColumn("chosen", chosen)
    rank = F.array_position(F.transform("ranking", lambda c: c["word_id"]), F.col("chosen"))
    rank = F.when(rank > 0, rank.cast("int"))
    tied = F.coalesce(F.get("joint", F.lit(0))["cost"] == F.get("joint", F.lit(1))["cost"], F.lit(False))
    confirmation = (
        F.when(F.col("chosen").isNull(), "no_candidate").when(rank.isNull(), "unavailable").when(rank != 1, "disagreement").when(tied, "joint_tie")
        .when(F.coalesce((-top["q"] >= min_prob) & (margin >= min_margin), F.lit(False)), "accepted").otherwise("insufficient")
    )
    branch = F.when(F.col("exact_id").isNotNull(), "exact_text").when(F.col("chosen").isNull(), None).when((F.col("read") == "") | (F.size("joint") <= 1), "model_fallback").otherwise("joint")
    out = boxes.select("page_id", "box_id", "chosen", branch.alias("branch"), rank.alias("support_rank"), F.round(-F.element_at("ranking", rank)["q"], 6).alias("support_p"), F.round(margin, 6).alias("margin"), confirmation.alias("confirmation"))
    return out.join(small.withColumnRenamed("word_id", "chosen"), "chosen", "left").select("page_id", "box_id", "word", "branch", "support_rank", "support_p", "margin", "confirmation")


def shown(ranked_scores: DataFrame, top: int) -> DataFrame:
    """The first `top` by score, and the model's own first if it is not among them."""
    order = Window.partitionBy("page_id", "box_id").orderBy(F.desc("score"), F.desc("p"), "d", "word_id")
    return ranked_scores.withColumn("score_rank", F.row_number().over(order)).where((F.col("score_rank") <= top) | (F.col("model_rank") == 1))


def bounded(ranked_scores: DataFrame, limit: int = 5) -> DataFrame:
    """The model's first five; all but the first only within the edit budget."""
    return ranked_scores.where((F.col("model_rank") <= limit) & ((F.col("model_rank") == 1) | (F.col("d") <= BUDGET)))


def distance_first(bounded_scores: DataFrame) -> DataFrame:
    """Of each box the least distance, then the more probable, then the earlier word."""
    order = Window.partitionBy("page_id", "box_id").orderBy("d", F.desc("p"), "word_id")
    return bounded_scores.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
