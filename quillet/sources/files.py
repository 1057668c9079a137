"""File sources and sinks of recognition data: images as bytes, artifacts, dictionaries, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What an image may be at most.
MAX_BYTES, MAX_PIXELS = 64 << 20, 40_000_000


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, n_bytes, sha256) of image files within the size limit, which the reader skips by length."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,webp}").load(path).where(F.col("length") <= MAX_BYTES)
        .select("path", "content", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    )


def admitted_pixels(pages: DataFrame) -> DataFrame:
    """Pages of (…, width, height) within the pixel limit."""
    return pages.where((F.col("width").cast("long") * F.col("height")).between(1, MAX_PIXELS))


def artifact(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) of key=value files; the last of a key counts, other lines are left out."""
    lines = spark.read.text(path).withColumn("path", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    pairs = lines.where(F.contains("value", F.lit("="))).select("path", "at", F.trim(F.substring_index("value", "=", 1)).alias("key"), F.trim(F.regexp_replace("value", "^[^=]*=", "")).alias("value"))
    return pairs.groupBy("path", "key").agg(F.max_by("value", "at").alias("value"))


def bound_artifacts(models: DataFrame, artifacts: DataFrame, key: str = "model_sha256") -> DataFrame:
    """Models with the artifact that names their digest."""
    named = artifacts.where(F.col("key") == key).select(F.col("path").alias("artifact"), F.lower("value").alias("sha256"))
    return models.join(named, "sha256")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(class_id, text) of a recogniser: blank at 0, the file's lines from 1, a space last."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("k", "text"))
    body = lines.select((F.col("k") + 1).alias("class_id"), "text")
    last = body.agg((F.max("class_id") + 1).alias("class_id")).select("class_id", F.lit(" ").alias("text"))
    return spark.createDataFrame([(0, "")], "class_id int, text string").unionByName(body).unionByName(last)


def probability_maps(maps: DataFrame) -> DataFrame:
    """Saved maps (w, h, data) whose data is complete and within [0, 1]."""
    return maps.where((F.size("data") == F.col("w") * F.col("h")) & F.forall("data", lambda x: x.isNotNull() & x.between(0, 1)))


def shares_from_text(texts: DataFrame, alphabet: str) -> DataFrame:
    """(share_id, word_pos, symbols) from (share_id, text): lines with their numbering and blanks stripped.

    Lines that are not six symbols of the alphabet keep a null, so the caller sees their place.
    """
    lines = texts.select("share_id", F.posexplode(F.split("text", r"\r?\n")).alias("k", "line"))
    body = F.upper(F.regexp_replace(F.regexp_replace(F.col("line"), r"^\s*[0-9]*[.):]*\s*", ""), r"\s+", ""))
    kept = lines.select("share_id", "k", body.alias("s")).where("s <> ''")
    valid = (F.length("s") == 6) & (F.length(F.translate("s", alphabet, "")) == 0)
    order = Window.partitionBy("share_id").orderBy("k")
    return kept.select("share_id", (F.row_number().over(order) - 1).alias("word_pos"), F.when(valid, F.col("s")).alias("symbols"))


def parse_phrase(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(text_id, n_words, first_unknown): where a text of (text_id, text) first leaves the vocabulary; null if never."""
    words = texts.select("text_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "w")).withColumn("w", F.lower("w"))
    known = words.join(F.broadcast(vocabulary.select(F.col("word").alias("w"), F.lit(True).alias("known"))), "w", "left")
    return known.groupBy("text_id").agg(F.count("*").alias("n_words"), F.min(F.when(F.col("known").isNull(), F.col("pos"))).alias("first_unknown"))


def write_documents(observations: DataFrame, path: str) -> None:
    """One JSON document a page, of saved decisions only; an existing folder is refused."""
    row = F.struct(*[F.col(c) for c in observations.columns if c != "page_id"])
    docs = observations.groupBy("page_id").agg(F.sort_array(F.collect_list(row)).alias("boxes"))
    docs.select(F.to_json(F.struct("page_id", "boxes")).alias("value")).write.mode("errorifexists").text(path)


def final_boxes(boxes: DataFrame) -> DataFrame:
    """(page_id, body): the page's boxes as JSON with their corners flattened, clockwise from the top left."""
    corners = F.array("l", "t", "r", "t", "r", "b", "l", "b")
    one = F.struct("box_id", corners.alias("quad"))
    return boxes.groupBy("page_id").agg(F.to_json(F.struct(F.lit("final-boxes-v1").alias("format"), F.sort_array(F.collect_list(one)).alias("boxes"))).alias("body"))


def tagged(value: str):
    """A double for JSON: finite as a number in text, else its name, since JSON has neither infinity nor NaN."""
    c = F.col(value)
    return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(c.cast("string"))
