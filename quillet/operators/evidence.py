"""What a page's reads are evidence for: labels, matching text, words, cuts, and what is kept. One row a read in, one out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions.strings import DELETE, FIRST, INSERT, SUBSTITUTE, dotted_prefix, label_of, leading_digit, normalise, shape_possible

# What a cut may cost, how sure a label's read must be.
CUT_TOLERANCE, SURE_LABEL = 0.15, 0.9


def known_word(rows: DataFrame, text: Column, vocabulary: DataFrame, name: str) -> DataFrame:
    """The rows with the word_id of an exact word in a column, null if it is none."""
    words = vocabulary.select(F.col("word").alias("_word"), F.col("word_id").alias(name))
    return rows.withColumn("_text", text).join(words, F.col("_text") == F.col("_word"), "left").drop("_text", "_word")


def matching_text(reads: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(row_id, text, reason): which literal supplies the text that is matched; reads: (row_id, whole, word_only)."""
    prefix = dotted_prefix(F.col("whole"))
    rows = reads.withColumn("remainder", prefix["remainder"]).withColumn("dotted", prefix.isNotNull())
    rows = known_word(known_word(rows, normalise(F.col("whole")), vocabulary, "whole_id"), normalise(F.col("remainder")), vocabulary, "remainder_id")
    trimmed = F.ltrim("word_only")
    cut = F.when(trimmed.startswith("."), F.ltrim(F.expr("substring(ltrim(word_only), 2)"))).otherwise(F.col("word_only"))
    reason = (
        F.when(F.col("dotted") & (F.col("remainder") == ""), "label_only").when(F.col("dotted") & F.col("word_only").isNull() & F.col("whole_id").isNotNull(), "whole_without_cut")
        .when(F.col("dotted") & F.col("remainder_id").isNotNull(), "clean_word").when(F.col("word_only").isNotNull(), "word_only").when(F.col("dotted"), "clean_rest").otherwise("whole")
    )
    rows = rows.withColumn("reason", reason)
    text = F.when(F.col("reason").isin("whole_without_cut", "whole"), F.col("whole")).when(F.col("reason").isin("clean_word", "clean_rest"), F.col("remainder")).when(F.col("reason") == "word_only", cut)
    return rows.select("row_id", text.alias("text"), "reason")


def grid_label(text: Column, confidence: Column) -> Column:
    """struct(kind, n): an ordinal, a place without one, or null; only from reads that are sure."""
    body = F.trim(text)
    digits = F.regexp_replace(body, r"\.$", "")
    ordinal = digits.rlike("^[0-9]{1,2}$") & (digits.cast("int") > 0)
    place = (body == ".") | body.endswith(".") & digits.rlike("^[A-Za-z0-9]{0,2}$")
    kind = F.when(ordinal, "ordinal").when(place & ~digits.rlike("^[0-9]+$"), "place").when(place & digits.rlike("^[0-9]+$") & ~ordinal, "place")
    sure = F.coalesce((confidence >= SURE_LABEL) & ~F.isnan(confidence), F.lit(False))
    return F.struct(F.when(sure, kind).alias("kind"), F.when(sure & ordinal, digits.cast("int")).alias("n"))


def finish(reads: DataFrame, closest: DataFrame, selected: DataFrame) -> DataFrame:
    """(page_id, box_id, word_like, stray, eligible): what is kept, and what may stand for a region.

    reads: (page_id, box_id, literal, excluded, in_cell, label_box); closest: near-list rows by read;
    selected: selection rows. Without a text a box counts as word-like; near the list it is; else the model
    must accept and the read have a word's shape. A box in a cell is kept whatever its read.
    """
    rows = reads.withColumn("read", normalise(F.col("literal"))).join(closest.select("read", "near"), "read", "left").join(selected.select("page_id", "box_id", "confirmation"), ["page_id", "box_id"], "left")
    near = F.coalesce("near", F.lit(False))
    like = F.col("literal").isNull() | near | ((F.col("confirmation") == "accepted") & shape_possible(F.col("literal")))
    rows = rows.withColumn("word_like", F.coalesce(like, F.lit(False)))
    return rows.select("page_id", "box_id", "word_like", (F.col("excluded") | ~(F.col("word_like") | F.col("in_cell"))).alias("stray"), (F.col("word_like") & ~F.col("label_box") & ~F.col("excluded")).alias("eligible"))


def cut_decisions(cuts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(row_id, accepted, reason): whether a label may be cut off; cuts: (row_id, whole, cut, confidence, before_top, after_top).

    An exact word that stands in the whole or behind its label must survive; an exact word in the cut
    decides; else the model must not lose more than CUT_TOLERANCE.
    """
    suffix = F.lower(F.trim(F.regexp_replace(F.trim("cut"), r"^\.\s*", "")))
    rows = cuts.withColumn("suffix", suffix).withColumn("rest", F.lower(F.trim(dotted_prefix(F.col("whole"))["remainder"])))
    rows = known_word(known_word(known_word(rows, F.col("suffix"), vocabulary, "cut_id"), normalise(F.col("whole")), vocabulary, "whole_id"), F.col("rest"), vocabulary, "rest_id")
    usable = F.coalesce((F.col("suffix") != "") & F.col("confidence").between(0, 1), F.lit(False))
    differs = lambda c: F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col("cut_id"))
    reason = F.when(~usable, "unusable_read").when(differs("whole_id") | differs("rest_id"), "changes_a_word").when(F.col("cut_id").isNotNull(), "exact_word").otherwise("confidence")
    accepted = F.when(reason == "confidence", F.coalesce("after_top", F.lit(0.0)) + CUT_TOLERANCE >= F.coalesce("before_top", F.lit(0.0))).otherwise(reason == "exact_word")
    return rows.select("row_id", accepted.alias("accepted"), reason.alias("reason"))


def trim_decisions(reads: DataFrame, closest: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(row_id, narrowed, stray, text, reason): a leading number trimmed or kept; reads: (row_id, whole, cut), cut may be null."""
    rows = known_word(reads.withColumn("a", normalise(F.col("whole"))).withColumn("b", normalise(F.col("cut"))), F.col("a"), vocabulary, "whole_id")
    near = closest.select("read", "near")
    rows = rows.join(near.toDF("a", "near_a"), "a", "left").join(near.toDF("b", "near_b"), "b", "left")
    good = F.coalesce("near_b", F.lit(False)) & ~leading_digit(F.col("cut"))
    reason = F.when(F.col("cut").isNull(), "no_cut").when(F.col("whole_id").isNotNull(), "exact_whole").when(good, "near_cut").otherwise("whole_decides")
    narrowed = F.when(reason == "exact_whole", F.col("a") == F.col("b")).otherwise(reason == "near_cut")
    return rows.select(
        "row_id", narrowed.alias("narrowed"), ((reason == "whole_decides") & ~F.coalesce("near_a", F.lit(False))).alias("stray"), F.when(reason == "near_cut", F.col("cut")).otherwise(F.col("whole")).alias("text"), reason.alias("reason")
    )


def label_evidence(boxes: DataFrame, reach: int = 1) -> DataFrame:
    """(page_id, box_id, origin, ordinal, conflict): the label of each box, its own or one beside it.

    boxes: (page_id, box_id, read, token, small). A dotted token or a small box that reads as a label is
    a standalone label and belongs to the next box that is none; else a dotted prefix or a token counts.
    Two known ordinals in one box, or one ordinal in two boxes, conflict.
    """
    prefix, legacy, token = dotted_prefix(F.col("read")), label_of(F.col("read")), label_of(F.col("token"))
    dot_only = F.coalesce(prefix["remainder"] == "", F.lit(False))
    alone = dot_only | F.coalesce(legacy["kind"].isNotNull() & F.col("small"), F.lit(False))
    number = lambda text: F.when(text.rlike("^[0-9]{1,2}$") & (text.cast("int") > 0), text.cast("int"))
    rows = boxes.withColumn("alone", alone).withColumn("own", F.when(alone, F.coalesce(legacy["n"], number(prefix["head"]))).otherwise(number(prefix["head"]))).withColumn("by_token", F.when(~alone, token["n"])).withColumn("dotted", prefix.isNotNull())
    order = Window.partitionBy("page_id").orderBy("box_id")
    rows = rows.withColumn("beside", F.when(~F.col("alone") & F.lag("alone", reach).over(order), F.lag("own", reach).over(order))).withColumn("has_beside", F.coalesce(~F.col("alone") & F.lag("alone", reach).over(order), F.lit(False)))
    values = F.when(F.col("alone"), F.array("own")).otherwise(F.array("own", "by_token", "beside"))
    rows = rows.withColumn("values", F.array_distinct(F.filter(values, lambda v: v.isNotNull())))
    rows = rows.withColumn("ordinal", F.when(F.size("values") == 1, F.get("values", F.lit(0))))
    same = Window.partitionBy("page_id", F.when(F.col("alone"), F.lit(None)).otherwise(F.col("ordinal")), "alone")
    twice = ~F.col("alone") & F.col("ordinal").isNotNull() & (F.count("*").over(same) > 1)
    origin = F.when(F.col("alone"), "standalone").when(F.col("token").isNotNull() & token["kind"].isNotNull(), "token").when(F.col("dotted"), "prefix").when(F.col("has_beside"), "beside")
    return rows.select("page_id", "box_id", origin.alias("origin"), "ordinal", ((F.size("values") > 1) | twice).alias("conflict"))


def alignment(read: Column, word: Column) -> Column:
    """struct(d, k, p): the weighted distance and the edits that make it, `s`, `d`, `i` with their places; of equals a substitution, then a deletion."""
    raw, target = (F.filter(F.split(x, ""), lambda c: c != "") for x in (read, word))
    size = F.size(target)
    cell = lambda d, k, p: F.struct(d.cast("double").alias("d"), F.lit(k).alias("k"), p.alias("p"))
    places = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    start = F.array(cell(F.lit(0.0), 0, F.lit("")))
    top = F.aggregate(places, start, lambda done, j: F.concat(done, F.array(cell(F.when(j == 1, INSERT * FIRST).otherwise(F.element_at(done, -1)["d"] + INSERT), 0, F.concat(F.element_at(done, -1)["p"], F.lit("i"), (j - 1).cast("string"), F.lit(" "))))))

    def row(before: Column, letter: Column, i: Column) -> Column:
        weight = F.when(i == 0, FIRST).otherwise(1.0)
        gone = F.concat(F.lit("d"), i.cast("string"), F.lit(" "))
        first = F.array(cell(F.element_at(before, 1)["d"] + DELETE * weight, 0, F.concat(F.element_at(before, 1)["p"], gone)))

        def step(done: Column, j: Column) -> Column:
            same = F.element_at(target, j) == letter
            up, left, corner = F.element_at(before, j + 1), F.element_at(done, -1), F.element_at(before, j)
            options = F.array(
                cell(corner["d"] + F.when(same, 0.0).otherwise(SUBSTITUTE * weight), 0, F.when(same, corner["p"]).otherwise(F.concat(corner["p"], F.lit("s"), i.cast("string"), F.lit(":"), (j - 1).cast("string"), F.lit(" ")))),
                cell(up["d"] + DELETE * weight, 1, F.concat(up["p"], gone)), cell(left["d"] + INSERT, 2, F.concat(left["p"], F.lit("i"), (j - 1).cast("string"), F.lit(" "))),
            )
            best = F.array_min(options)
            return F.concat(done, F.array(F.struct(best["d"].alias("d"), F.lit(0).alias("k"), best["p"].alias("p"))))

        return F.aggregate(places, first, step)

    numbered = F.transform(raw, lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.element_at(F.aggregate(numbered, top, lambda before, x: row(before, x["c"], x["i"])), -1)
