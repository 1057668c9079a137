"""Symbol tables: codewords, blocked decoding, lines through shares, distributions over symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillet.functions import codes

# What counts as plausible, and the floor of a likelihood.
PLAUSIBLE, FLOOR = 0.05, 1e-6


def codebook(vocabulary: DataFrame) -> DataFrame:
    """(word_id, word, code): six symbols a word, two of parity and its first four letters."""
    from quillet.functions.strings import worksheet_letters

    return vocabulary.select("word_id", "word", codes.codeword(codes.symbols(worksheet_letters(F.col("word")))).alias("code"))


def _keys(code: str):
    """The three disjoint pairs of a codeword as (pair, key): within two errors one pair is right."""
    c = F.col(code)
    pairs = [F.struct(F.lit(k).alias("pair"), (F.element_at(c, 2 * k + 1) * 29 + F.element_at(c, 2 * k + 2)).alias("key")) for k in range(3)]
    return F.explode(F.array(*pairs)).alias("k")


def nearby(received: DataFrame, book: DataFrame) -> DataFrame:
    """(row_id, word_id, d): codewords within two errors, by an equi-join on pairs and a check."""
    left = received.select("row_id", "received", _keys("received")).select("row_id", "received", "k.pair", "k.key")
    right = book.select("word_id", "code", _keys("code")).select("word_id", "code", "k.pair", "k.key")
    met = left.join(right, ["pair", "key"]).dropDuplicates(["row_id", "word_id"])
    return met.select("row_id", "word_id", codes.hamming(F.col("received"), F.col("code")).alias("d")).where("d <= 2")


def decode(received: DataFrame, book: DataFrame) -> DataFrame:
    """(row_id, outcome, word_id, candidates): a lone candidate is taken up to one error, never at two."""
    found = nearby(received, book).groupBy("row_id").agg(F.count("*").alias("candidates"), F.min(F.struct("d", "word_id")).alias("best"))
    all_rows = received.select("row_id").join(found, "row_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    lone = F.col("candidates") == 1
    outcome = F.when(F.col("candidates") == 0, "unrecognized").when(lone & (F.col("best.d") == 0), "exact").when(lone & (F.col("best.d") == 1), "corrected").otherwise("candidates")
    return all_rows.select("row_id", outcome.alias("outcome"), F.when(outcome.isin("exact", "corrected"), F.col("best.word_id")).alias("word_id"), "candidates")


def recover(shares: DataFrame, first: int, second: int) -> DataFrame:
    """(row_id, slope, intercept) of the lines through two shares; shares: (row_id, share_no, symbol)."""
    a = shares.where(F.col("share_no") == first).select("row_id", F.col("symbol").alias("a"))
    b = shares.where(F.col("share_no") == second).select("row_id", F.col("symbol").alias("b"))
    s = codes.slope(F.col("a"), F.col("b"), F.lit(first), F.lit(second))
    return a.join(b, "row_id").select("row_id", s.alias("slope"), codes.sub(F.col("a"), codes.mul(s, F.lit(first))).alias("intercept"))


def collinear(shares: DataFrame, slopes: DataFrame) -> DataFrame:
    """(row_id, on_line): whether all shares of a row lie on the line."""
    return shares.join(slopes, "row_id").groupBy("row_id").agg((F.count_distinct(codes.sub(F.col("symbol"), codes.mul(F.col("slope"), F.col("share_no")))) == 1).alias("on_line"))


def softmax(cells: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(word_no, cell, sym, p): shifted by the greatest score."""
    cell = Window.partitionBy("word_no", "cell")
    e = F.exp((F.col("x") - F.max("x").over(cell)) / temperature)
    raw = cells.withColumn("e", e)
    return raw.select("word_no", "cell", "sym", (F.col("e") / F.sum("e").over(cell)).alias("p"))


def argmax(dist: DataFrame) -> DataFrame:
    """(word_no, cell, sym, p): the most probable symbol, the first of equals."""
    order = Window.partitionBy("word_no", "cell").orderBy(F.desc("p"), "sym")
    return dist.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def word_confidence(best: DataFrame) -> DataFrame:
    """(word_no, mean_p, least_cell): the mean of the cells' best, and the first of the least sure."""
    return best.groupBy("word_no").agg(F.avg("p").alias("mean_p"), F.min(F.struct("p", "cell"))["cell"].alias("least_cell"))


def combine(a: DataFrame, b: DataFrame, index_a: int, index_b: int) -> DataFrame:
    """(word_no, cell, sym, p) of the slope between two shares' distributions; zero products don't meet."""
    scale = pow(index_b - index_a, codes.MODULUS - 2, codes.MODULUS)
    left = a.where("p > 0").select("word_no", "cell", F.col("sym").alias("x"), F.col("p").alias("px"))
    right = b.where("p > 0").select("word_no", "cell", F.col("sym").alias("y"), F.col("p").alias("py"))
    sym = F.pmod((F.col("y") - F.col("x")) * scale, F.lit(codes.MODULUS)).cast("int")
    return left.join(right, ["word_no", "cell"]).groupBy("word_no", "cell", sym.alias("sym")).agg(F.sum(F.col("px") * F.col("py")).alias("p"))


def soft_candidates(dist: DataFrame, book: DataFrame, plausible: float = PLAUSIBLE) -> DataFrame:
    """(word_no, word_id, distance, likelihood): codewords with two implausible positions at most."""
    spelled = book.select("word_id", F.posexplode("code").alias("cell", "sym"))
    words = dist.select("word_no").distinct()
    wanted = words.crossJoin(F.broadcast(spelled))  # the code book is a parameter of few words
    met = wanted.join(dist, ["word_no", "cell", "sym"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    scored = met.groupBy("word_no", "word_id").agg(F.sum((F.col("p") < plausible).cast("int")).alias("distance"), F.sum(F.log(F.greatest("p", F.lit(FLOOR)))).alias("likelihood"))
    return scored.where("distance <= 2")


def soft_decode(found: DataFrame, words: DataFrame) -> DataFrame:
    """(word_no, outcome, word_id): accepted only when one candidate is left, at one implausible position at most."""
    best = found.groupBy("word_no").agg(F.count("*").alias("n"), F.min(F.struct("distance", (-F.col("likelihood")).alias("cost"), "word_id")).alias("best"))
    outcome = F.when(F.col("n").isNull(), "unrecognized").when((F.col("n") == 1) & (F.col("best.distance") <= 1), "accepted").otherwise("candidates")
    return words.select("word_no").distinct().join(best, "word_no", "left").select("word_no", outcome.alias("outcome"), F.when(outcome == "accepted", F.col("best.word_id")).alias("word_id"))


def position_costs(dist: DataFrame, epsilon: float = 1e-3) -> DataFrame:
    """(word_no, cell, sym, cost): smoothed surprise in thousandths of a nat."""
    cell = Window.partitionBy("word_no", "cell")
    z = F.sum(F.col("p") + epsilon).over(cell)
    return dist.select("word_no", "cell", "sym", F.round(-F.log((F.col("p") + epsilon) / z) * 1000).cast("int").alias("cost"))


# The marks of the four kinds of strip.
STRIP_CODES = {"words": 0b000111, "first": 0b110100, "second": 0b011010, "third": 0b101001}
#: How far a distribution's sum may be from 1.
SUM_TOLERANCE = 1e-3


def strip_kind(marks: Column) -> Column:
    """The kind whose code differs in one mark at most; the codes are four marks apart, so there is one at most."""
    out = F.lit(None).cast("string")
    for kind, code in STRIP_CODES.items():
        out = F.when(F.bit_count(marks.bitwiseXOR(F.lit(code))) <= 1, kind).otherwise(out)
    return out


def index_classes(spark: SparkSession, first: int | None = None, second: int | None = None) -> DataFrame:
    """(difference, pairs): assignments of two share numbers, where read, by their difference modulo 29."""
    rows = [(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b and first in (None, a) and second in (None, b)]
    pairs = spark.createDataFrame(rows, "a int, b int")
    return pairs.groupBy(codes.sub(F.col("b"), F.col("a")).alias("difference")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("-", "a", "b"))), " ").alias("pairs"))


def checked_distributions(cells: DataFrame) -> DataFrame:
    """(word_no, cell, outcome, top): whether a cell's probabilities are one distribution, and its greatest after renormalising."""
    cell = cells.groupBy("word_no", "cell").agg(
        F.max(F.isnan("p") | (F.abs("p") == float("inf")) | F.col("p").isNull()).alias("broken"), F.min("p").alias("least"), F.max("p").alias("most"), F.sum("p").alias("total"), F.count("*").alias("n")
    )
    outcome = F.when(F.col("broken"), "not_finite").when(F.col("least") < 0, "negative").when(F.abs(F.col("total") - 1) > SUM_TOLERANCE, "sum").otherwise("valid")
    return cell.select("word_no", "cell", outcome.alias("outcome"), F.when(outcome == "valid", F.col("most") / F.col("total")).alias("top"))


def checked_readings(cells: DataFrame, unread: DataFrame, positions: int = 6) -> DataFrame:
    """(word_no, cell, outcome) of each cell said to be unread: off_card, listed_twice, carries_reading or unread."""
    spread = cells.groupBy("word_no", "cell").agg((F.max("x") - F.min("x")).alias("spread"))
    listed = unread.groupBy("word_no", "cell").agg(F.count("*").alias("n")).join(spread, ["word_no", "cell"], "left")
    outcome = F.when((F.col("cell") >= positions) | F.col("spread").isNull(), "off_card").when(F.col("n") > 1, "listed_twice").when(F.col("spread") > 0, "carries_reading").otherwise("unread")
    return listed.select("word_no", "cell", outcome.alias("outcome"))


def allowed(position: Column, symbol: Column) -> Column:
    """Whether a symbol can stand at a place of a worksheet word: any in the two of parity, letters in four, the dash in the last."""
    return (position < 2) | symbol.between(2, 27) | ((position == 5) & (symbol == 28))


def allowed_costs(dist: DataFrame, epsilon: float = 1e-3) -> DataFrame:
    """position_costs over the symbols that can stand at each place, which share the whole probability."""
    return position_costs(dist.where(allowed(F.col("cell"), F.col("sym"))), epsilon)


def rank_bounds(costs: DataFrame, targets: DataFrame) -> DataFrame:
    """(page_id, lower, upper): between which ranks the target's choice lies among all combinations, by cost.

    costs: (page_id, slot, word_id, cost), targets: (page_id, slot, word_id). The slots' histograms of
    cost over the slot's least are convolved up to the target's own; counts are exact up to 38 digits.
    """
    aimed = costs.join(targets, ["page_id", "slot", "word_id"], "left_semi").groupBy("page_id").agg(F.sum("cost").alias("target"))
    least = costs.groupBy("page_id", "slot").agg(F.min("cost").alias("least"))
    span = aimed.join(least.groupBy("page_id").agg(F.sum("least").alias("base")), "page_id").select("page_id", (F.col("target") - F.col("base")).cast("int").alias("span"))
    counts = costs.join(least, ["page_id", "slot"]).groupBy("page_id", "slot", (F.col("cost") - F.col("least")).cast("int").alias("over")).agg(F.count("*").cast("decimal(38,0)").alias("n"))
    slots = counts.groupBy("page_id", "slot").agg(F.map_from_entries(F.collect_list(F.struct("over", "n"))).alias("histogram")).groupBy("page_id").agg(F.collect_list("histogram").alias("slots"))
    zero = F.lit(0).cast("decimal(38,0)")
    empty = F.transform(F.sequence(F.lit(0), "span"), lambda t: F.when(t == 0, F.lit(1)).otherwise(F.lit(0)).cast("decimal(38,0)"))

    def convolve(done: Column, histogram: Column) -> Column:
        at = lambda t: F.aggregate(F.sequence(F.lit(0), t), zero, lambda total, r: (total + F.element_at(done, t - r + 1) * F.coalesce(F.try_element_at(histogram, r), zero)).cast("decimal(38,0)"))
        return F.transform(F.sequence(F.lit(0), F.col("span")), at)

    table = span.join(slots, "page_id").select("page_id", "span", F.aggregate("slots", empty, convolve).alias("counts"))
    cheaper = F.aggregate(F.slice("counts", 1, F.col("span")), zero, lambda a, b: (a + b).cast("decimal(38,0)"))
    return table.select("page_id", (cheaper + 1).cast("long").alias("lower"), (cheaper + F.element_at("counts", -1)).cast("long").alias("upper"))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate, 0 where either side is constant."""
    return F.when((F.var_pop(x) > 0) & (F.var_pop(y) > 0), F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))).otherwise(0.0)


def resolved(decoded: DataFrame) -> DataFrame:
    """(phrase_id, words, undecided): the words of a phrase if each is decided, else the places that are not; decoded: (phrase_id, pos, outcome, word)."""
    sure = F.col("outcome").isin("exact", "corrected")
    one = F.struct("pos", "word", sure.alias("sure"))
    rows = decoded.groupBy("phrase_id").agg(F.array_sort(F.collect_list(one)).alias("rows"))
    whole = F.forall("rows", lambda r: r["sure"])
    return rows.select(
        "phrase_id", F.when(whole, F.array_join(F.transform("rows", lambda r: r["word"]), " ")).alias("words"), F.array_join(F.transform(F.filter("rows", lambda r: ~r["sure"]), lambda r: r["pos"].cast("string")), ",").alias("undecided")
    )
