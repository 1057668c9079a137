"""All queries of the recognition operators, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillet.functions import codes, strings
from quillet.functions import geometry as geo
from quillet.operators import candidates as cand
from quillet.operators import coding, layout, sequences
from quillet.plans import sql
from quillet.session import table
from quillet.sources import adapters as ad

FLAGSHIP = "select_candidates"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def queries() -> dict:
    _more()
    return dict(QUERIES)


def _more() -> None:
    """The queries of the other modules, which register themselves."""
    from quillet.plans import evidence, rasters, tracks, traversal  # noqa: F401


def oracle_sql() -> dict[str, str]:
    _more()
    return {name: text for name, text in sql.ORACLES.items() if name in QUERIES}


def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text): reads with printed labels in front, for the label functions."""
    k = F.pmod(F.col("page_id") + F.col("box_id"), F.lit(8))
    n = F.pmod("page_id", F.lit(23))
    text = (
        F.when(k == 0, F.concat(n, F.lit(". "), "literal")).when(k == 1, F.concat(n, F.lit("."))).when(k == 2, F.concat(F.lit("l."), "literal")).when(k == 3, F.lit("lO"))
        .when(k == 4, F.concat(F.lit(" "), n, F.lit(" ) "))).when(k == 5, F.concat(n, F.upper("literal"))).when(k == 6, F.concat("literal", F.lit(" and more"))).otherwise(F.col("literal"))
    )
    return ad.reads(spark, sf_dir).select((F.col("page_id") * 10 + F.col("box_id")).alias("row_id"), text.alias("text"))


@query
def select_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cand.select(ad.reads(spark, sf_dir), ad.candidates(spark, sf_dir), ad.vocabulary(spark, sf_dir), 0.2, 0.01)


@query
def select_outcomes(spark, sf_dir):
    """Selection over short rankings: some reads have no candidate, some words are outside the ranking."""
    return cand.select(ad.reads(spark, sf_dir), ad.candidates(spark, sf_dir).where("p >= 0.25"), ad.vocabulary(spark, sf_dir), 0.2, 0.01)


@query
def weighted_distances(spark, sf_dir):
    return cand.pair_distances(ad.reads(spark, sf_dir), ad.vocabulary(spark, sf_dir)).drop("word_id")


@query
def near_list(spark, sf_dir):
    return cand.closest_words(cand.pair_distances(ad.reads(spark, sf_dir), ad.vocabulary(spark, sf_dir)))


@query
def label_functions(spark, sf_dir):
    t = F.col("text")
    label, dotted = strings.label_of(t), strings.dotted_prefix(t)
    return literals(spark, sf_dir).select(
        "row_id", label["kind"].alias("label_kind"), label["n"].alias("label_n"), strings.past_label(t).alias("past_label"), dotted["head"].alias("head"), dotted["remainder"].alias("remainder"),
        strings.leading_digit(t).alias("leading_digit"), strings.normalise(t).alias("normal"), strings.prose(t).alias("prose"), strings.shape_possible(t).alias("possible"), strings.strip_numbering(t).alias("stripped"),
    )


@query
def score_families(spark, sf_dir):
    c = ad.candidates(spark, sf_dir).withColumn("d", F.pmod(F.col("word_id"), F.lit(5)).cast("double"))
    tagged = lambda s: F.when(s == float("-inf"), "-inf").otherwise(F.round(s, 6).cast("decimal(18,6)").cast("string"))
    p, d = F.col("p"), F.col("d")
    return c.select(
        "page_id", "box_id", "word_id", tagged(strings.log_score(p, d)).alias("log_score"), tagged(strings.squared_log_score(p, d)).alias("squared"),
        F.round(strings.power_complement_score(p, d, 2.0), 6).alias("power_complement"), F.round(strings.complement_power_score(p, d, 2.0), 6).alias("complement_power"),
    )


@query
def verdicts(spark, sf_dir):
    """Whether the model's first two ranks alone decide, and whether the ranking is a valid one."""
    r = cand.ranked(ad.candidates(spark, sf_dir))
    return r.groupBy("page_id", "box_id").agg(
        (F.max(F.when(F.col("model_rank") == 1, F.col("p"))) >= 0.2).alias("probable"), (F.max("margin") >= 0.01).alias("apart"), (F.count_distinct("word_id") == F.count("*")).alias("unique"),
        F.min(F.col("p").between(0, 1)).alias("in_range"),
    )


@query
def diagnostic_top(spark, sf_dir):
    """The eight best by score, with the model's first."""
    words = ad.vocabulary(spark, sf_dir)
    reads = ad.reads(spark, sf_dir).select("page_id", "box_id", strings.normalise(F.col("literal")).alias("read"))
    scored = cand.ranked(ad.candidates(spark, sf_dir)).join(reads, ["page_id", "box_id"]).join(cand.pair_distances(ad.reads(spark, sf_dir), words).select("read", "word_id", "d"), ["read", "word_id"])
    return cand.shown(scored.withColumn("score", strings.log_score(F.col("p"), F.col("d"))), 8).select("page_id", "box_id", "word_id", "score_rank", "model_rank")


@query
def distance_first(spark, sf_dir):
    words = ad.vocabulary(spark, sf_dir)
    reads = ad.reads(spark, sf_dir).select("page_id", "box_id", strings.normalise(F.col("literal")).alias("read"))
    scored = cand.ranked(ad.candidates(spark, sf_dir)).join(reads, ["page_id", "box_id"]).join(cand.pair_distances(ad.reads(spark, sf_dir), words).select("read", "word_id", "d"), ["read", "word_id"])
    return cand.distance_first(cand.bounded(scored)).select("page_id", "box_id", "word_id", "d")


@query
def field_arithmetic(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", F.lit(29)).cast("int").alias("x"), F.pmod("l_suppkey", F.lit(29)).cast("int").alias("y"), F.pmod("l_orderkey", F.lit(29)).cast("int").alias("z"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    out = lines.select("x", "y", "z", codes.add(x, y).alias("sum"), codes.sub(x, y).alias("difference"), codes.mul(x, y).alias("product"), codes.inv(x).alias("inverse"), codes.wheel(x, y).alias("wheel"), codes.on_line(x, y, z).alias("line"), codes.slope(x, y, F.lit(1), F.lit(3)).alias("slope"))
    return out.groupBy(*out.columns).agg(F.count("*").alias("rows"))


@query
def codewords(spark, sf_dir):
    return coding.codebook(ad.vocabulary(spark, sf_dir)).select("word", codes.text_of(F.col("code")).alias("symbols"))


def received(spark, sf_dir) -> DataFrame:
    """(row_id, received): codewords of the reads' tokens with up to three symbols changed."""
    tokens = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.element_at(F.split("p_name", " "), 1).alias("word"))
    book = coding.codebook(ad.vocabulary(spark, sf_dir))
    wrong = F.transform("code", lambda s, i: F.when(F.pmod(F.col("k") * 7 + i * 5, F.lit(11)) < F.pmod("k", F.lit(4)), F.pmod(s + 1 + F.pmod("k", F.lit(13)), F.lit(29))).otherwise(s))
    return tokens.join(book, "word").select(F.col("k").alias("row_id"), wrong.cast("array<bigint>").alias("received"))


@query
def blocked_decode(spark, sf_dir):
    return coding.decode(received(spark, sf_dir), coding.codebook(ad.vocabulary(spark, sf_dir)))


def shares(spark, sf_dir) -> DataFrame:
    """(row_id, share_no, symbol): three points a row of a line, one of them off in some rows."""
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("share_no"))
    clean = codes.on_line(F.pmod(F.col("row_id") * 5, F.lit(29)), F.pmod(F.col("row_id") * 3, F.lit(29)), F.col("share_no"))
    return base.select("row_id", "share_no", F.when((F.col("share_no") == 3) & (F.pmod("row_id", F.lit(10)) == 0), codes.add(clean, F.lit(1))).otherwise(clean).alias("symbol"))


@query
def share_lines(spark, sf_dir):
    s = shares(spark, sf_dir)
    lines = coding.recover(s, 1, 2)
    return lines.join(coding.collinear(s, lines), "row_id")


@query
def cell_softmax(spark, sf_dir):
    return coding.argmax(coding.softmax(ad.cells(spark, sf_dir))).select("word_no", "cell", "sym", F.round("p", 6).alias("p"))


@query
def cell_confidence(spark, sf_dir):
    best = coding.argmax(coding.softmax(ad.cells(spark, sf_dir)))
    return coding.word_confidence(best).select("word_no", F.round("mean_p", 6).alias("mean_p"), "least_cell")


def _two(spark, sf_dir):
    dist = coding.softmax(ad.cells(spark, sf_dir), 0.05)
    even = dist.where("word_no % 2 = 0").withColumn("word_no", F.floor(F.col("word_no") / 2))
    odd = dist.where("word_no % 2 = 1").withColumn("word_no", F.floor(F.col("word_no") / 2))
    return even, odd


@query
def combined_distributions(spark, sf_dir):
    return coding.combine(*_two(spark, sf_dir), 1, 3).select("word_no", "cell", "sym", F.round("p", 6).alias("p"))


@query
def soft_decoding(spark, sf_dir):
    dist = coding.softmax(ad.cells(spark, sf_dir), 0.5)
    found = coding.soft_candidates(dist, coding.codebook(ad.vocabulary(spark, sf_dir)), 0.02)
    return coding.soft_decode(found, dist)


@query
def position_costs(spark, sf_dir):
    return coding.position_costs(coding.softmax(ad.cells(spark, sf_dir)))


@query
def box_geometry(spark, sf_dir):
    return layout.geometry(ad.boxes(spark, sf_dir))


@query
def page_envelope(spark, sf_dir):
    return layout.envelope(ad.boxes(spark, sf_dir))


@query
def height_medians(spark, sf_dir):
    return layout.medians(ad.boxes(spark, sf_dir))


@query
def reach_edges(spark, sf_dir):
    return layout.reach_edges(ad.boxes(spark, sf_dir))


@query
def region_exclusion(spark, sf_dir):
    return layout.apart(layout.reach_components(ad.boxes(spark, sf_dir)))


@query
def dominant_block(spark, sf_dir):
    return layout.dominant_block(ad.boxes(spark, sf_dir))


@query
def column_groups(spark, sf_dir):
    return layout.axis_groups(ad.boxes(spark, sf_dir), "x").select("page_id", "group_no", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query
def row_groups(spark, sf_dir):
    return layout.axis_groups(ad.boxes(spark, sf_dir), "y").select("page_id", "group_no", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


@query
def order_choice(spark, sf_dir):
    """Which way a page is read first, why, and whether that needs a look."""
    return layout.order_choice(ad.boxes(spark, sf_dir), F.pmod("page_id", F.lit(7)) == 0)


@query
def nearest_label(spark, sf_dir):
    return layout.nearest_right(ad.boxes(spark, sf_dir))


@query
def fragment_owners(spark, sf_dir):
    return layout.fragment_owners(ad.boxes(spark, sf_dir))


@query
def axis_agreement(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", F.lit(360)).cast("double").alias("x"), (F.pmod("l_suppkey", F.lit(90)) * 4).cast("double").alias("y"))
    return a.select("x", "y", layout.axes_agree(F.col("x"), F.col("y")).alias("agree")).groupBy("x", "y", "agree").agg(F.count("*").alias("rows"))


@query
def read_budget(spark, sf_dir):
    costs = layout.geometry(ad.boxes(spark, sf_dir)).select("page_id", "box_id", "pixels")
    return layout.admitted(costs, 4, 12_000)


@query
def number_inversions(spark, sf_dir):
    return sequences.inversions(ad.labels(spark, sf_dir))


@query
def number_duplicates(spark, sf_dir):
    return sequences.duplicates(ad.labels(spark, sf_dir))


@query
def missing_numbers(spark, sf_dir):
    return sequences.missing(ad.labels(spark, sf_dir))


@query
def hole_filling(spark, sf_dir):
    return sequences.fill_holes(ad.labels(spark, sf_dir))


@query
def numbering_fit(spark, sf_dir):
    return sequences.fit_numbering(ad.numbered(spark, sf_dir))


@query
def ctc_collapse(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    best = F.pmod(F.floor(F.col("value")), F.lit(4)).cast("int")
    steps = events.select(F.col("user_id").alias("line_id"), F.col("event_id").alias("t"), best.alias("best"), (F.pmod("event_id", F.lit(50)) / 50).alias("p"))
    return sequences.ctc_collapse(steps).select("line_id", "symbols", F.round("confidence", 6).alias("confidence"))


@query
def progress_rollup(spark, sf_dir):
    return sequences.latest_regions(ad.progress(spark, sf_dir))


@query
def visible_regions(spark, sf_dir):
    return sequences.visible(sequences.latest_regions(ad.progress(spark, sf_dir))).select("attempt_id", "region_id")


@query
def strict_rollup(spark, sf_dir):
    return sequences.latest_regions(ad.progress(spark, sf_dir), strict=True)


@query
def replaced_regions(spark, sf_dir):
    """Roll-up with replacements: an excluded region gives way to a new one."""
    p = ad.progress(spark, sf_dir)
    swap = F.col("kind") == "excluded"
    events = p.select(
        "attempt_id", "seq", F.when(swap, "replaced").when(F.pmod("event_id", F.lit(97)) == 0, "failed").otherwise(F.col("kind")).alias("kind"), F.when(swap, F.col("seq") + 1000).otherwise(F.col("region_id")).alias("region_id"),
        F.when(swap, F.array("region_id")).otherwise(F.array().cast("array<bigint>")).alias("parents"),
    )
    return sequences.latest_regions(events)


@query
def sequence_gaps(spark, sf_dir):
    """Gaps in a sequence that counts on by event: ids of a user's events, in order."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("attempt_id"), F.floor(F.col("event_id") / 50).alias("seq")).distinct()
    return sequences.sequence_gaps(events)


@query
def timing_rollup(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("ms"))


@query
def line_fits(spark, sf_dir):
    """Least-squares line and mean axis of each order's boxes; corners are whole numbers, so the line is exact up to its rounding."""
    b = ad.boxes(spark, sf_dir)
    a = F.radians(F.pmod(F.col("l") + F.col("t"), F.lit(180.0)))
    fits = b.groupBy("page_id").agg(geo.exact_fit("l", "t").alias("fit"), F.min("l").alias("low"), F.max("l").alias("high"), geo.mean_axis(a).alias("axis"))
    return fits.where("low < high").select("page_id", geo.fit_slope("fit", 4).alias("slope"), geo.fit_intercept("fit", 3).alias("intercept"), geo.rounded("axis", 4).alias("axis"))


@query
def document_lines(spark, sf_dir):
    """One text document a page: numbered lines of worksheet letters."""
    words = ad.reads(spark, sf_dir).where("literal <> ''")
    line = F.concat(F.lpad((F.col("box_id") + 1).cast("string"), 2, " "), F.lit(". "), strings.worksheet_letters(F.col("literal")))
    return words.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_id", line.alias("x")))), lambda s: s["x"]), "\n").alias("document"))


@query
def identity_map(spark, sf_dir):
    """Pages whose map from box to number is not one to one within range."""
    x = ad.labels(spark, sf_dir).where("kind = 'exact'")
    size = x.groupBy("page_id").agg(F.count("*").alias("boxes"), F.count_distinct("n").alias("numbers"), F.max("n").alias("highest"))
    return size.select("page_id", (F.col("boxes") != F.col("numbers")).alias("duplicate"), (F.col("highest") > F.col("boxes")).alias("out_of_range"), (F.col("boxes") < F.col("highest")).alias("incomplete"))


@query
def prefix_lookup(spark, sf_dir):
    words = ad.vocabulary(spark, sf_dir)
    prefixes = words.select(F.substring("word", 1, 1).alias("prefix")).distinct()
    return prefixes.join(words, F.substring("word", 1, 1) == F.col("prefix")).groupBy("prefix").agg(F.array_join(F.array_sort(F.collect_list("word")), ",").alias("words"))


@query
def redact_vocabulary(spark, sf_dir):
    """Runs of three vocabulary words or more in any document are counted and struck out, never returned."""
    docs, key = table(spark, sf_dir, "documents").select("doc_id", "text"), F.md5("text")
    # runs follow from the text alone, so equal texts are looked at once
    tokens = docs.select(key.alias("key"), "text").dropDuplicates(["key"]).select("key", F.posexplode(F.split("text", " ")).alias("pos", "word"))
    known = tokens.join(ad.vocabulary(spark, sf_dir).select("word"), "word").withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("key").orderBy("pos")))
    runs = known.groupBy("key", "island").agg(F.min("pos").alias("low"), F.max("pos").alias("high")).where("high - low >= 2")
    runs = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("spans"))
    found = docs.withColumn("key", key).join(runs, "key", "left")
    inside = lambda i: F.filter("spans", lambda r: (r["low"] <= i) & (i <= r["high"]))
    words = F.transform(F.split("text", " "), lambda w, i: F.when(F.size(inside(i)) == 0, w).when(inside(i)[0]["low"] == i, F.lit("[redacted]")))
    return found.select("doc_id", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("runs"), F.md5(F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(words, " "))).alias("redacted_md5"))


@query
def mark_fields(spark, sf_dir):
    """Numbers printed as marks, some with bits flipped, decoded again."""
    from quillet.functions import marks

    lines = table(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", F.lit(16)).cast("int").alias("number"), F.pmod("l_suppkey", F.lit(256)).cast("int").alias("noise")).distinct()
    flips = F.col("noise").bitwiseAND(F.lit(0b00100010))
    printed = (marks.reversed_bits(F.lit(marks.PROJECT_ID)) + marks.reversed_bits(marks.encode(F.col("number")).bitwiseXOR(F.lit(marks.NUMBER_MASK)).bitwiseXOR(flips)) * 256).cast("int")
    found = lines.withColumn("field", printed).withColumn("x", marks.field(F.col("field")))
    return found.select("number", "noise", "field", F.col("x.kind").alias("kind"), F.col("x.number").alias("decoded"))


@query
def page_axis(spark, sf_dir):
    from quillet.operators import grid

    return grid.page_axis(ad.boxes(spark, sf_dir))


@query
def word_splits(spark, sf_dir):
    from quillet.operators import grid

    return grid.split_words(ad.boxes(spark, sf_dir).select("page_id", F.col("box_id").alias("span_id"), "l", (F.col("l") + (F.col("r") - F.col("l")) / 8).alias("r"), (F.col("b") - F.col("t")).alias("h")), 1.1)


@query
def column_owners(spark, sf_dir):
    from quillet.operators import grid

    boxes = ad.boxes(spark, sf_dir)
    return grid.assigned_column(boxes, grid.columns_of(boxes, 300.0))


@query
def exclusion_reasons(spark, sf_dir):
    from quillet.operators import grid

    return grid.exclusion_reasons(ad.boxes(spark, sf_dir), 130.0)


@query
def cell_rows(spark, sf_dir):
    from quillet.operators import grid

    return grid.cell_rows(ad.boxes(spark, sf_dir))


@query
def completed_rows(spark, sf_dir):
    from quillet.operators import grid

    return grid.completed_rows(ad.boxes(spark, sf_dir))


@query
def join_guards(spark, sf_dir):
    from quillet.operators import grid

    return grid.join_guard(ad.boxes(spark, sf_dir))


@query
def cheapest_classes(spark, sf_dir):
    """Of each cell all symbols of the least cost."""
    costs = coding.position_costs(coding.softmax(ad.cells(spark, sf_dir)))
    least = costs.groupBy("word_no", "cell").agg(F.min("cost").alias("least"))
    return costs.join(least, ["word_no", "cell"]).where("cost = least").select("word_no", "cell", "sym", "cost")
