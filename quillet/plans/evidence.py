"""Queries over reads, symbol cells and their evidence, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.functions import strings
from quillet.operators import candidates as cand
from quillet.operators import coding, evidence
from quillet.plans import registry, sql
from quillet.session import table
from quillet.sources import adapters as ad


def query(text: str):
    """Register a query with its SQL."""

    def put(f):
        registry.QUERIES[f.__name__] = f
        sql.ORACLES[f.__name__] = text
        return f

    return put


_OBSERVED = f"""{ad.READS}, {ad.VOCABULARY}, {sql._LITERALS},
observed AS (SELECT l.row_id, r.page_id, r.box_id, l.text AS whole, r.literal, CASE l.row_id % 3 WHEN 0 THEN '.' || r.literal WHEN 1 THEN r.literal END AS cut, l.row_id * 7 % 100 / 100.0 AS before_top, l.row_id * 13 % 100 / 100.0 AS after_top, l.row_id * 37 % 120 / 100.0 AS confidence
  FROM literals l JOIN reads r ON l.row_id = r.page_id * 10 + r.box_id)"""
_NORMAL = "regexp_replace(lower({}), '[^a-z]', '', 'g')"
_DOTTED = "regexp_matches(ltrim({0}), '^[\\pL\\pN]{{0,2}}\\.')"
_REST = "CASE WHEN " + _DOTTED + " THEN ltrim(regexp_replace(ltrim({0}), '^[^.]*\\.', '')) END"
_HEAD = "CASE WHEN " + _DOTTED + " THEN split_part(ltrim({0}), '.', 1) END"


def observed(spark, sf_dir: str) -> DataFrame:
    """Reads with printed labels in front, what is left after a cut, and the model's best before and after it."""
    row = F.col("page_id") * 10 + F.col("box_id")
    k = F.pmod(row, F.lit(3))
    reads = ad.reads(spark, sf_dir).withColumn("row_id", row).withColumn("cut", F.when(k == 0, F.concat(F.lit("."), "literal")).when(k == 1, F.col("literal")))
    share = lambda m, n: F.pmod(row * m, F.lit(n)) / 100
    reads = reads.withColumn("before_top", share(7, 100)).withColumn("after_top", share(13, 100)).withColumn("confidence", share(37, 120))
    return reads.join(registry.literals(spark, sf_dir).withColumnRenamed("text", "whole"), "row_id")


def closest_to(spark, sf_dir: str, texts: DataFrame) -> DataFrame:
    return cand.closest_words(cand.pair_distances(texts, ad.vocabulary(spark, sf_dir)))


def _near(source: str, name: str) -> str:
    """Near-list rows of a table's texts."""
    return f"""{name}_spell AS (SELECT DISTINCT {_NORMAL.format('literal')} AS read FROM ({source}) WHERE {_NORMAL.format('literal')} <> ''),
{name} AS (SELECT read, min(d) <= 3 AS near FROM (SELECT read, {sql.distance('read', 'word')} AS d FROM {name}_spell, vocabulary) GROUP BY read)"""


@query(f"""WITH {_OBSERVED}, p AS (SELECT *, {_DOTTED.format('whole')} AS dotted, {_REST.format('whole')} AS rest FROM observed),
w AS (SELECT p.*, a.word_id AS whole_id, b.word_id AS rest_id FROM p LEFT JOIN vocabulary a ON a.word = {_NORMAL.format('whole')} LEFT JOIN vocabulary b ON b.word = {_NORMAL.format('rest')}),
r AS (SELECT *, CASE WHEN dotted AND rest = '' THEN 'label_only' WHEN dotted AND cut IS NULL AND whole_id IS NOT NULL THEN 'whole_without_cut' WHEN dotted AND rest_id IS NOT NULL THEN 'clean_word' WHEN cut IS NOT NULL THEN 'word_only' WHEN dotted THEN 'clean_rest' ELSE 'whole' END AS reason FROM w)
SELECT row_id, CASE WHEN reason IN ('whole_without_cut', 'whole') THEN whole WHEN reason IN ('clean_word', 'clean_rest') THEN rest WHEN reason = 'word_only' THEN CASE WHEN starts_with(ltrim(cut), '.') THEN ltrim(substr(ltrim(cut), 2)) ELSE cut END END AS text, reason FROM r""")
def matching_text(spark, sf_dir):
    return evidence.matching_text(observed(spark, sf_dir).select("row_id", "whole", F.col("cut").alias("word_only")), ad.vocabulary(spark, sf_dir))


@query(f"""WITH {_OBSERVED}, d AS (SELECT row_id, trim(whole) AS body, regexp_replace(trim(whole), '\\.$', '') AS digits, confidence >= 0.9 AS sure FROM observed),
k AS (SELECT *, regexp_matches(digits, '^[0-9]{{1,2}}$') AND coalesce(TRY_CAST(digits AS INTEGER), 0) > 0 AS ordinal, body = '.' OR (ends_with(body, '.') AND regexp_matches(digits, '^[A-Za-z0-9]{{0,2}}$')) AS place FROM d)
SELECT row_id, CASE WHEN sure THEN CASE WHEN ordinal THEN 'ordinal' WHEN place THEN 'place' END END AS kind, CASE WHEN sure AND ordinal THEN CAST(digits AS INTEGER) END AS n FROM k""")
def grid_labels(spark, sf_dir):
    label = evidence.grid_label(F.col("whole"), F.col("confidence"))
    return observed(spark, sf_dir).select("row_id", label["kind"].alias("kind"), label["n"].alias("n"))


@query(f"""WITH {_OBSERVED}, tops AS (SELECT page_id, bool_or({_DOTTED.format('whole')}) AS dotted, count(*) FILTER (regexp_matches(whole, '^\\s*[0-9]{{1,2}}[.:)\\]_\\s-]*$')) AS exact FROM observed GROUP BY page_id)
SELECT page_id, CASE WHEN dotted OR exact >= 2 THEN 'numbered' ELSE 'unnumbered' END AS mode FROM tops""")
def list_mode(spark, sf_dir):
    """A page is a numbered list by one dotted label, or by two exact ones."""
    rows = observed(spark, sf_dir)
    exact = F.col("whole").rlike(r"^\s*[0-9]{1,2}[.:)\]_\s-]*$")
    pages = rows.groupBy("page_id").agg(F.max(strings.dotted_prefix(F.col("whole")).isNotNull()).alias("dotted"), F.count_if(exact).alias("exact"))
    return pages.select("page_id", F.when(F.col("dotted") | (F.col("exact") >= 2), "numbered").otherwise("unnumbered").alias("mode"))


_TOKENS = "len(list_filter(string_split(literal, ' '), lambda w: regexp_matches(w, '\\pL')))"


@query(sql._selection("candidates").replace("SELECT c.page_id, c.box_id, v.word", "SELECT * FROM (SELECT c.page_id, c.box_id, v.word").replace("WITH ", "WITH sel AS (WITH ", 1) + ")), "
       + f"{_OBSERVED}, {_near('SELECT literal FROM reads', 'near_list')}, t AS (SELECT o.page_id, o.box_id, nullif(o.literal, '') AS literal, o.page_id % 5 = 0 AS excluded, o.box_id % 2 = 0 AS in_cell, regexp_matches(o.whole, '^[0-9]+\\.?$') AS label_box FROM observed o), "
       f"w AS (SELECT t.*, literal IS NULL OR coalesce(near, false) OR (confirmation = 'accepted' AND length({_NORMAL.format('literal')}) <= 8 AND {_TOKENS} <= 1) AS word_like FROM t LEFT JOIN near_list n ON n.read = {_NORMAL.format('literal')} LEFT JOIN sel s ON s.page_id = t.page_id AND s.box_id = t.box_id) "
       "SELECT page_id, box_id, word_like, excluded OR NOT (word_like OR in_cell) AS stray, word_like AND NOT label_box AND NOT excluded AS eligible FROM w")
def kept_reads(spark, sf_dir):
    """Word-likeness, the keep rule and region eligibility of every read."""
    rows = observed(spark, sf_dir).select(
        "page_id", "box_id", F.nullif("literal", F.lit("")).alias("literal"), (F.pmod("page_id", F.lit(5)) == 0).alias("excluded"), (F.pmod("box_id", F.lit(2)) == 0).alias("in_cell"), F.col("whole").rlike(r"^[0-9]+\.?$").alias("label_box")
    )
    return evidence.finish(rows, closest_to(spark, sf_dir, ad.reads(spark, sf_dir)), registry.select_candidates(spark, sf_dir))


@query(f"""WITH {_OBSERVED}, s AS (SELECT *, lower(trim(regexp_replace(trim(cut), '^\\.\\s*', ''))) AS suffix, lower(trim({_REST.format('whole')})) AS rest FROM observed),
w AS (SELECT s.*, c.word_id AS cut_id, a.word_id AS whole_id, b.word_id AS rest_id FROM s LEFT JOIN vocabulary c ON c.word = suffix LEFT JOIN vocabulary a ON a.word = {_NORMAL.format('whole')} LEFT JOIN vocabulary b ON b.word = rest),
r AS (SELECT *, CASE WHEN NOT coalesce(suffix <> '' AND confidence BETWEEN 0 AND 1, false) THEN 'unusable_read' WHEN (whole_id IS NOT NULL AND whole_id IS DISTINCT FROM cut_id) OR (rest_id IS NOT NULL AND rest_id IS DISTINCT FROM cut_id) THEN 'changes_a_word' WHEN cut_id IS NOT NULL THEN 'exact_word' ELSE 'confidence' END AS reason FROM w)
SELECT row_id, CASE WHEN reason = 'confidence' THEN CAST(after_top AS DOUBLE) + 0.15::DOUBLE >= CAST(before_top AS DOUBLE) ELSE reason = 'exact_word' END AS accepted, reason FROM r""")
def cut_decisions(spark, sf_dir):
    return evidence.cut_decisions(observed(spark, sf_dir), ad.vocabulary(spark, sf_dir))


@query(f"""WITH {_OBSERVED}, texts AS (SELECT whole AS literal FROM observed UNION ALL SELECT cut FROM observed), {_near('SELECT literal FROM texts', 'near_list')},
w AS (SELECT o.*, {_NORMAL.format('whole')} AS a, {_NORMAL.format('cut')} AS b FROM observed o),
x AS (SELECT w.*, v.word_id, coalesce(n.near, false) AS near_a, coalesce(m.near, false) AS near_b FROM w LEFT JOIN vocabulary v ON v.word = a LEFT JOIN near_list n ON n.read = a LEFT JOIN near_list m ON m.read = b),
r AS (SELECT *, CASE WHEN cut IS NULL THEN 'no_cut' WHEN word_id IS NOT NULL THEN 'exact_whole' WHEN near_b AND NOT regexp_matches(cut, '^[0-9]') THEN 'near_cut' ELSE 'whole_decides' END AS reason FROM x)
SELECT row_id, CASE WHEN reason = 'exact_whole' THEN a = b ELSE reason = 'near_cut' END AS narrowed, reason = 'whole_decides' AND NOT near_a AS stray, CASE WHEN reason = 'near_cut' THEN cut ELSE whole END AS text, reason FROM r""")
def trim_decisions(spark, sf_dir):
    rows = observed(spark, sf_dir)
    texts = rows.select(F.col("whole").alias("literal")).unionByName(rows.select(F.col("cut").alias("literal"))).where("literal IS NOT NULL")
    return evidence.trim_decisions(rows, closest_to(spark, sf_dir, texts), ad.vocabulary(spark, sf_dir))


_LABEL_N = "CASE WHEN regexp_full_match({0}, '[0-9]{{1,2}}') AND TRY_CAST({0} AS INTEGER) >= 1 THEN CAST({0} AS INTEGER) END"
_SHAPE = f"(regexp_full_match({{0}}, '[0-9]{{{{1,2}}}}') AND coalesce(TRY_CAST({{0}} AS INTEGER), 0) >= 1) OR (regexp_full_match({{0}}, '[0-9{sql._SHAPED}]{{{{1,2}}}}') AND NOT regexp_full_match({{0}}, '[0-9]+'))"


@query(f"""WITH {_OBSERVED}, o AS (SELECT page_id, box_id, whole AS read, CASE WHEN row_id % 4 = 0 THEN CAST(page_id % 23 AS VARCHAR) END AS token, length(whole) <= 4 AS small FROM observed),
b AS (SELECT *, regexp_replace(trim(read), '[.:)\\]\\-_\\s]+$', '') AS body, {_REST.format('read')} AS rest, {_HEAD.format('read')} AS head, {_DOTTED.format('read')} AS dotted FROM o),
a AS (SELECT *, coalesce(rest = '', false) OR (coalesce({_SHAPE.format('body')}, false) AND small) AS alone, {_LABEL_N.format('body')} AS body_n, {_LABEL_N.format('head')} AS head_n, {_LABEL_N.format('token')} AS token_n FROM b),
n AS (SELECT *, CASE WHEN alone THEN coalesce(body_n, head_n) ELSE head_n END AS own, CASE WHEN NOT alone THEN token_n END AS by_token FROM a),
l AS (SELECT *, coalesce(NOT alone AND lag(alone) OVER w, false) AS has_beside, CASE WHEN NOT alone AND lag(alone) OVER w THEN lag(own) OVER w END AS beside FROM n WINDOW w AS (PARTITION BY page_id ORDER BY box_id)),
v AS (SELECT *, list_distinct(list_filter(CASE WHEN alone THEN [own] ELSE [own, by_token, beside] END, lambda x: x IS NOT NULL)) AS vs FROM l),
d AS (SELECT *, CASE WHEN len(vs) = 1 THEN vs[1] END AS ordinal FROM v)
SELECT page_id, box_id, CASE WHEN alone THEN 'standalone' WHEN token IS NOT NULL AND {_SHAPE.format('token')} THEN 'token' WHEN dotted THEN 'prefix' WHEN has_beside THEN 'beside' END AS origin, ordinal,
  len(vs) > 1 OR (NOT alone AND ordinal IS NOT NULL AND count(*) OVER (PARTITION BY page_id, alone, ordinal) > 1) AS conflict FROM d""")
def label_evidence(spark, sf_dir):
    rows = observed(spark, sf_dir).select("page_id", "box_id", F.col("whole").alias("read"), F.when(F.pmod("row_id", F.lit(4)) == 0, F.pmod("page_id", F.lit(23)).cast("string")).alias("token"), (F.length("whole") <= 4).alias("small"))
    return evidence.label_evidence(rows)


def _aligned(raw: str, word: str) -> str:
    cell = lambda d, p: f"{{'d': CAST({d} AS DOUBLE), 'k': 0, 'p': {p}}}"
    top = f"list_transform(range(0, length({word}) + 1), lambda j: {cell('CASE WHEN j = 0 THEN 0 ELSE 1 + j END', '''array_to_string(list_transform(range(0, j), lambda z: 'i' || z || ' '), '')''')})"
    weight = "CASE WHEN i[1].d = 1 THEN 2.0 ELSE 1.0 END"
    at, left, corner = "prev[CAST(j[1].d AS INTEGER) + 1]", "done[len(done)]", "prev[CAST(j[1].d AS INTEGER)]"
    same = f"substr({word}, CAST(j[1].d AS INTEGER), 1) = substr({raw}, CAST(i[1].d AS INTEGER), 1)"
    options = f"""[{{'d': {corner}.d + CASE WHEN {same} THEN 0 ELSE {weight} END, 'k': 0, 'p': CASE WHEN {same} THEN {corner}.p ELSE {corner}.p || 's' || CAST(i[1].d - 1 AS INTEGER) || ':' || CAST(j[1].d - 1 AS INTEGER) || ' ' END}},
      {{'d': {at}.d + 2 * {weight}, 'k': 1, 'p': {at}.p || 'd' || CAST(i[1].d - 1 AS INTEGER) || ' '}}, {{'d': {left}.d + 1, 'k': 2, 'p': {left}.p || 'i' || CAST(j[1].d - 1 AS INTEGER) || ' '}}]"""
    best = f"list_sort({options})[1]"
    numbers = lambda text: f"list_transform(range(1, length({text}) + 1), lambda z: [{cell('z', repr(''))}])"
    inner = f"list_reduce({numbers(word)}, lambda done, j: list_append(done, {{'d': {best}.d, 'k': 0, 'p': {best}.p}}), [{cell(f'prev[1].d + 2 * {weight}', '''prev[1].p || 'd' || CAST(i[1].d - 1 AS INTEGER) || ' ' ''')}])"
    return f"list_reduce({numbers(raw)}, lambda prev, i: {inner}, {top})[length({word}) + 1]"


@query(f"""WITH {ad.READS}, {ad.VOCABULARY}, s AS (SELECT DISTINCT {_NORMAL.format('literal')} AS read FROM reads WHERE {_NORMAL.format('literal')} <> ''), a AS (SELECT read, word, {_aligned('read', 'word')} AS x FROM s, vocabulary)
SELECT read, word, x.d AS d, trim(x.p) AS edits FROM a""")
def edit_alignments(spark, sf_dir):
    """The edits behind each weighted distance."""
    pairs = cand.pair_distances(ad.reads(spark, sf_dir), ad.vocabulary(spark, sf_dir)).drop("d")
    return pairs.withColumn("x", evidence.alignment(F.col("read"), F.col("word"))).select("read", "word", F.col("x.d").alias("d"), F.trim("x.p").alias("edits"))


@query("""SELECT DISTINCT CAST(l_partkey % 64 AS INTEGER) AS marks, CASE WHEN bit_count(xor(CAST(l_partkey % 64 AS INTEGER), 7)) <= 1 THEN 'words' WHEN bit_count(xor(CAST(l_partkey % 64 AS INTEGER), 52)) <= 1 THEN 'first' WHEN bit_count(xor(CAST(l_partkey % 64 AS INTEGER), 26)) <= 1 THEN 'second' WHEN bit_count(xor(CAST(l_partkey % 64 AS INTEGER), 41)) <= 1 THEN 'third' END AS kind FROM lineitem""")
def strip_kinds(spark, sf_dir):
    marks = table(spark, sf_dir, "lineitem").select(F.pmod("l_partkey", F.lit(64)).cast("int").alias("marks")).distinct()
    return marks.select("marks", coding.strip_kind(F.col("marks")).alias("kind"))


@query("""WITH s AS (SELECT unnest([1, 2, 3]) AS a) SELECT (y.a - x.a + 29) % 29 AS difference, string_agg(x.a || '-' || y.a, ' ' ORDER BY x.a, y.a) AS pairs FROM s x, s y WHERE x.a <> y.a GROUP BY 1""")
def index_classes(spark, sf_dir):
    return coding.index_classes(spark)


@query(f"""WITH {ad.CELLS}, {sql._softmax('1.0')}, d AS (SELECT word_no, cell, p * (1 + 0.0007 * (word_no % 5)) AS p FROM dist),
c AS (SELECT word_no, cell, min(p) AS least, max(p) AS most, sum(p) AS total FROM d GROUP BY ALL)
SELECT word_no, cell, CASE WHEN abs(total - 1) > 0.001 THEN 'sum' ELSE 'valid' END AS outcome, CASE WHEN abs(total - 1) <= 0.001 THEN round(most / total, 6) END AS top FROM c""")
def checked_distributions(spark, sf_dir):
    dist = coding.softmax(ad.cells(spark, sf_dir)).withColumn("p", F.col("p") * (1 + 0.0007 * F.pmod("word_no", F.lit(5))))
    return coding.checked_distributions(dist).withColumn("top", F.round("top", 6))


@query(f"""WITH {ad.CELLS}, flat AS (SELECT word_no, cell, sym, CASE WHEN (word_no * 6 + cell) % 3 = 0 THEN 0 ELSE x END AS x FROM cells), spread AS (SELECT word_no, cell, max(x) - min(x) AS spread FROM flat GROUP BY ALL),
u AS (SELECT CAST(vec_id // 6 AS BIGINT) AS word_no, CAST(vec_id % 6 + CASE WHEN vec_id % 26 = 0 THEN 6 ELSE 0 END AS INTEGER) AS cell FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT CAST(vec_id // 6 AS BIGINT), CAST(vec_id % 6 AS INTEGER) FROM embeddings WHERE vec_id % 10 = 0)
SELECT word_no, cell, CASE WHEN cell >= 6 OR any_value(spread) IS NULL THEN 'off_card' WHEN count(*) > 1 THEN 'listed_twice' WHEN any_value(spread) > 0 THEN 'carries_reading' ELSE 'unread' END AS outcome FROM u LEFT JOIN spread USING (word_no, cell) GROUP BY word_no, cell""")
def checked_readings(spark, sf_dir):
    """Cells said to be unread, against what they carry."""
    cells = ad.cells(spark, sf_dir).withColumn("x", F.when(F.pmod(F.col("word_no") * 6 + F.col("cell"), F.lit(3)) == 0, 0.0).otherwise(F.col("x")))
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 6).alias("word_no"), F.pmod("vec_id", F.lit(6)).cast("int").alias("cell"))
    some = v.where("vec_id % 2 = 0").select("word_no", (F.col("cell") + F.when(F.pmod("vec_id", F.lit(26)) == 0, 6).otherwise(0)).alias("cell"))
    return coding.checked_readings(cells, some.unionByName(v.where("vec_id % 10 = 0").select("word_no", "cell")))


@query(f"""WITH {ad.CELLS}, {sql._softmax('1.0')}, ok AS (SELECT * FROM dist WHERE cell < 2 OR sym BETWEEN 2 AND 27 OR (cell = 5 AND sym = 28))
SELECT word_no, cell, CAST(sym AS INTEGER) AS sym, CAST(round(-ln((p + 0.001) / sum(p + 0.001) OVER (PARTITION BY word_no, cell)) * 1000) AS INTEGER) AS cost FROM ok""")
def allowed_costs(spark, sf_dir):
    return coding.allowed_costs(coding.softmax(ad.cells(spark, sf_dir)))


@query(f"""WITH RECURSIVE {ad.READS}, {ad.VOCABULARY}, {ad.CANDIDATES}, c AS (SELECT page_id, box_id AS slot, word_id, CAST((page_id * 7 + box_id * 13 + word_id * 31) % 19 AS INTEGER) AS cost FROM candidates),
t AS (SELECT c.page_id, sum(cost) AS target FROM c JOIN (SELECT page_id, slot, word_id + page_id % 5 AS word_id FROM (SELECT page_id, slot, min(word_id) AS word_id FROM c GROUP BY page_id, slot)) w USING (page_id, slot, word_id) GROUP BY c.page_id),
m AS (SELECT page_id, slot, min(cost) AS least FROM c GROUP BY ALL), sp AS (SELECT page_id, CAST(any_value(target) - sum(least) AS INTEGER) AS span FROM t JOIN m USING (page_id) GROUP BY page_id),
k AS (SELECT page_id, slot, row_number() OVER (PARTITION BY page_id ORDER BY slot) AS nth, list(cost - least) AS overs FROM c JOIN m USING (page_id, slot) GROUP BY page_id, slot),
f AS (SELECT page_id, span, 0::BIGINT AS nth, list_transform(range(0, span + 1), lambda x: CASE WHEN x = 0 THEN 1::HUGEINT ELSE 0::HUGEINT END) AS counts FROM sp
  UNION ALL SELECT f.page_id, f.span, k.nth, list_transform(range(0, f.span + 1), lambda x: CAST(list_sum(list_transform(range(0, x + 1), lambda r: f.counts[x - r + 1] * len(list_filter(k.overs, lambda o: o = r)))) AS HUGEINT)) FROM f JOIN k ON k.page_id = f.page_id AND k.nth = f.nth + 1),
e AS (SELECT page_id, any_value(span) AS span, arg_max(counts, nth) AS counts FROM f GROUP BY page_id)
SELECT page_id, CAST(coalesce(list_sum(counts[1:span]), 0) + 1 AS BIGINT) AS lower, CAST(coalesce(list_sum(counts[1:span]), 0) + counts[span + 1] AS BIGINT) AS upper FROM e""")
def rank_bounds(spark, sf_dir):
    """The rank of each page's chosen words among all combinations, by cost."""
    c = ad.candidates(spark, sf_dir)
    costs = c.select("page_id", F.col("box_id").alias("slot"), "word_id", F.pmod(F.col("page_id") * 7 + F.col("box_id") * 13 + F.col("word_id") * 31, F.lit(19)).cast("int").alias("cost"))
    targets = costs.groupBy("page_id", "slot").agg(F.min("word_id").alias("word_id")).withColumn("word_id", (F.col("word_id") + F.pmod("page_id", F.lit(5))).cast("int"))
    return coding.rank_bounds(costs, targets)


@query(f"""WITH {ad.CELLS}, a AS (SELECT word_no, sym, x FROM cells WHERE cell = 0), b AS (SELECT word_no, sym, x FROM cells WHERE cell = 1)
SELECT a.word_no, round(coalesce(corr(a.x, CASE WHEN a.word_no % 9 = 0 THEN 1.0 ELSE b.x END), 0), 5) AS r FROM a JOIN b USING (word_no, sym) GROUP BY a.word_no""".replace("coalesce(corr(", "coalesce(CASE WHEN a.word_no % 9 <> 0 THEN corr(").replace("ELSE b.x END), 0)", "ELSE b.x END) END, 0)"))
def cell_correlations(spark, sf_dir):
    """Correlation of two cells' scores, 0 against a constant."""
    cells = ad.cells(spark, sf_dir)
    a, b = (cells.where(F.col("cell") == k).select("word_no", "sym", F.col("x").alias(n)) for k, n in ((0, "u"), (1, "v")))
    both = a.join(b, ["word_no", "sym"]).withColumn("v", F.when(F.pmod("word_no", F.lit(9)) == 0, 1.0).otherwise(F.col("v")))
    return both.groupBy("word_no").agg(F.round(coding.correlation("u", "v"), 5).alias("r"))


@query(sql.ORACLES["blocked_decode"].replace("SELECT row_id, CASE WHEN n IS NULL", "SELECT * FROM (SELECT row_id, CASE WHEN n IS NULL").replace("WITH ", "WITH decoded AS (WITH ", 1) + ")), "
       + f"{ad.VOCABULARY}, d AS (SELECT row_id // 12 AS phrase_id, row_id % 12 AS pos, outcome, word FROM decoded LEFT JOIN vocabulary USING (word_id)) "
       "SELECT phrase_id, CASE WHEN bool_and(outcome IN ('exact', 'corrected')) THEN string_agg(word, ' ' ORDER BY pos) END AS words, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (outcome NOT IN ('exact', 'corrected')), '') AS undecided FROM d GROUP BY phrase_id")
def resolved_phrases(spark, sf_dir):
    """Twelve decoded words make a phrase if all are decided."""
    words = ad.vocabulary(spark, sf_dir)
    decoded = registry.blocked_decode(spark, sf_dir).join(words, "word_id", "left")
    return coding.resolved(decoded.select(F.floor(F.col("row_id") / 12).alias("phrase_id"), F.pmod("row_id", F.lit(12)).alias("pos"), "outcome", "word"))


@query(f"""WITH {ad.READS}, {ad.VOCABULARY}, {ad.CANDIDATES}, {sql._DISTANCES}, {sql._RANKED}, {sql._SCORED}
SELECT c.page_id, c.box_id, c.word_id, round(s.d, 3) AS d FROM candidates c LEFT JOIN (SELECT * FROM scored WHERE model_rank <= 5 AND (model_rank = 1 OR d <= 3)) s ON s.page_id = c.page_id AND s.box_id = c.box_id AND s.word_id = c.word_id""")
def observation_scores(spark, sf_dir):
    """All candidates with the distance of those that were scored; the others' stays unknown."""
    words = ad.vocabulary(spark, sf_dir)
    reads = ad.reads(spark, sf_dir).select("page_id", "box_id", strings.normalise(F.col("literal")).alias("read"))
    c = ad.candidates(spark, sf_dir)
    scored = cand.bounded(cand.ranked(c).join(reads, ["page_id", "box_id"]).join(cand.pair_distances(ad.reads(spark, sf_dir), words).select("read", "word_id", "d"), ["read", "word_id"]))
    return c.select("page_id", "box_id", "word_id").join(scored.select("page_id", "box_id", "word_id", F.round("d", 3).alias("d")), ["page_id", "box_id", "word_id"], "left")


@query(f"""WITH {ad.READS}, {ad.VOCABULARY}, {ad.CANDIDATES}, {sql._RANKED}, z AS (SELECT page_id, box_id, word, p, model_rank FROM ranked JOIN vocabulary USING (word_id) WHERE model_rank <= 3)
SELECT page_id, box_id, string_agg(word, ',' ORDER BY model_rank) AS words, round(max(p) FILTER (word = 'red' OR model_rank = 1), 6) AS p FROM z GROUP BY page_id, box_id""")
def ranked_arrays(spark, sf_dir):
    """A box's first three words as one array, and the probability found in it."""
    r = cand.ranked(ad.candidates(spark, sf_dir)).where("model_rank <= 3").join(ad.vocabulary(spark, sf_dir), "word_id")
    pages = r.groupBy("page_id", "box_id").agg(F.array_sort(F.collect_list(F.struct("model_rank", "word", "p"))).alias("z"))
    hit = F.filter("z", lambda x: (x["word"] == "red") | (x["model_rank"] == 1))
    return pages.select("page_id", "box_id", F.array_join(F.transform("z", lambda x: x["word"]), ",").alias("words"), F.round(F.array_max(F.transform(hit, lambda x: x["p"])), 6).alias("p"))


@query(f"""WITH {_OBSERVED}, w AS (SELECT o.row_id, o.confidence, a.word_id AS base, b.word_id AS turned FROM observed o LEFT JOIN vocabulary a ON a.word = {_NORMAL.format('literal')} LEFT JOIN vocabulary b ON b.word = {_NORMAL.format('cut')})
SELECT row_id, CASE WHEN confidence > 1 THEN 'unusable_reads' WHEN base IS NOT NULL AND turned IS NULL THEN 'base_read' WHEN base IS NULL AND turned IS NOT NULL THEN 'reversed_read' ELSE 'inconclusive' END AS reason, base IS NULL AND turned IS NOT NULL AND confidence <= 1 AS reversed FROM w""")
def page_polarity(spark, sf_dir):
    """Which way up a page is, by which of two reads is a word."""
    rows = evidence.known_word(observed(spark, sf_dir), strings.normalise(F.col("literal")), ad.vocabulary(spark, sf_dir), "base")
    rows = evidence.known_word(rows, strings.normalise(F.col("cut")), ad.vocabulary(spark, sf_dir), "turned")
    a, b = F.col("base").isNotNull(), F.col("turned").isNotNull()
    reason = F.when(F.col("confidence") > 1, "unusable_reads").when(a & ~b, "base_read").when(~a & b, "reversed_read").otherwise("inconclusive")
    return rows.select("row_id", reason.alias("reason"), (reason == "reversed_read").alias("reversed"))


@query(f"""WITH {_OBSERVED}, b AS (SELECT row_id, regexp_replace(trim(whole), '[.:)\\]\\-_\\s]+$', '') AS body FROM observed)
SELECT row_id, CASE WHEN {_LABEL_N.format('body')} IS NOT NULL THEN '{{"kind":"exact","n":' || {_LABEL_N.format('body')} || '}}' WHEN {_SHAPE.format('body')} THEN '{{"kind":"shaped"}}' ELSE '{{}}' END AS label FROM b""")
def tagged_labels(spark, sf_dir):
    """A label as tagged JSON: absent fields stay out."""
    return observed(spark, sf_dir).select("row_id", F.to_json(strings.label_of(F.col("whole"))).alias("label"))
