r"""Line dedup: a log-template tree of fixed depth, in DataFrame operations only.

Lines are split at \n and their tokens at white space; a token with a digit, an @ or a slash in it is a
variable field and becomes <*>. The tree has the token count on its first level and the first DEPTH
tokens on the next; lines with the same path share a leaf. A leaf's positions are generalised: a
position is constant where one token has at least half of the leaf's distinct lines, else a field.
If at least SIMILARITY of the positions are constant, the lines that agree with that share of them
have the leaf's template; every other line is a template of its own. A template that occurs in
MIN_DOCS documents of different text or more recurs: its lines are dropped, but for the first line
with it in the document of least doc_id, so that no content is lost entirely. Exact copies of a
document count once (removing them is the near-duplicate stage's work). Lines of fewer than
MIN_TOKENS tokens are left alone.

Only hashes of paths, lines and texts are shuffled to find the leaves that can recur; tokens are
exploded for the distinct lines of those leaves alone, and counts are aggregated before each
shuffle, so a line that every document holds is one row a task.

Defined results: a null text stays null with no lines; an empty text has one empty line; a null
doc_id counts as the greatest; repeated rows are repeated in the result, and lose the same lines;
extra columns are kept by drop_templates() and ignored by the query; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.session import materialize

DEPTH = 3
SIMILARITY = 0.7
MIN_DOCS = 8
MIN_TOKENS = 3
#: A token with a digit, an @ or a slash, tried at a token's start only and without backtracking.
_FIELD = r"(?<![^ ])[^ 0-9@/]*+[0-9@/][^ ]*+"


def _spaced(line: Column) -> Column:
    """The line's tokens joined by one space; lines that are so already are only looked through."""
    odd = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.when(odd, F.regexp_replace(F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")), " +", " ")).otherwise(line)


def _masked(tokens: Column) -> Column:
    return F.regexp_replace(tokens, _FIELD, "<*>")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_h, line_no, line, leaf) of the lines that are long enough; only the path is masked here."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_h"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    spaced = lines.select("doc_id", "text_h", "line_no", _spaced(F.col("line")).alias("line"))
    n_tokens = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    counted = spaced.withColumn("n_tokens", n_tokens).where(F.col("n_tokens") >= MIN_TOKENS)
    return counted.select("doc_id", "text_h", "line_no", "line", F.xxhash64("n_tokens", _masked(F.substring_index("line", " ", DEPTH))).alias("leaf"))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_h, line_no) of the lines to drop; docs: (doc_id, text)."""
    lines = _lines(docs)
    busy = (
        lines.groupBy("leaf", "text_h").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select("leaf")
    )
    # the lines of leaves that can recur; from here on all is small beside the texts
    masked = lines.join(busy, "leaf", "left_semi").select("doc_id", "text_h", "line_no", "leaf", _masked(F.col("line")).alias("masked"))
    inside = materialize(masked.withColumn("key", F.xxhash64("masked")), "busy_lines")
    distinct = inside.groupBy("leaf", "key").agg(F.first("masked").alias("masked"))
    tokens = materialize(distinct.select("leaf", "key", F.posexplode(F.split("masked", " ")).alias("at", "token")), "line_tokens")
    votes = tokens.groupBy("leaf", "at", "token").agg(F.count("*").alias("n"))
    heads = votes.groupBy("leaf", "at").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("all")).select(
        "leaf", "at", F.when(2 * F.col("top.n") >= F.col("all"), F.col("top.token")).alias("constant")
    )
    general = heads.groupBy("leaf").agg(F.avg(F.col("constant").isNotNull().cast("double")).alias("share")).where(F.col("share") >= similarity).select("leaf")
    fits = (
        tokens.join(heads, ["leaf", "at"]).groupBy("leaf", "key")
        .agg((F.sum((F.col("token") == F.col("constant")).cast("double")) / F.sum(F.col("constant").isNotNull().cast("double"))).alias("agree"))
        .where(F.col("agree") >= similarity).join(general, "leaf", "left_semi").select("leaf", "key", F.lit(True).alias("fits"))
    )
    template = F.when(F.col("fits"), F.struct("leaf", F.lit(0).cast("long").alias("key"))).otherwise(F.struct("leaf", "key"))
    placed = inside.select("doc_id", "text_h", "line_no", "leaf", "key").join(fits, ["leaf", "key"], "left").select("doc_id", "text_h", "line_no", template.alias("template"))
    last = F.coalesce("doc_id", F.lit(2**63 - 1)).cast("long")
    per_text = placed.groupBy("template", "text_h").agg(F.min(F.struct(last.alias("id"), "text_h", "line_no")).alias("first"))
    recurs = per_text.groupBy("template").agg(F.count("*").alias("docs"), F.min("first").alias("keeps")).where(F.col("docs") >= min_docs)
    own = F.struct(last.alias("id"), "text_h", "line_no")
    return placed.join(recurs, "template").where(own != F.col("keeps")).select("doc_id", "text_h", "line_no")


def drop_templates(documents: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """documents with recurring lines cut out of text, and n_lines and n_dropped beside their columns."""
    docs = documents.select(documents["doc_id"].cast("long").alias("doc_id"), documents["text"].cast("string").alias("text"))
    gone = recurring_lines(docs, min_docs, similarity).groupBy("doc_id", "text_h").agg(F.collect_set("line_no").alias("gone"))
    # columns of the input may have any names: they travel in one struct
    rows = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("row"), documents["doc_id"].cast("long").alias("id"), F.xxhash64(documents["text"].cast("string")).alias("h"))
    joined = rows.join(gone, rows["id"].eqNullSafe(gone["doc_id"]) & (rows["h"] == gone["text_h"]), "left").select("row", "gone")
    parts = F.split("row.text", "\n")
    kept = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(F.col("gone"), i)), "\n"))
    columns = [kept.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in documents.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*columns, F.when(F.col("row.text").isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def cut_lines(documents: DataFrame) -> DataFrame:
    """documents, with their columns alone, without recurring lines; a text of such lines only goes with its document."""
    cut = drop_templates(documents)
    return cut.where(~((F.col("n_dropped") > 0) & (F.trim("text") == ""))).select(*[F.col(f"`{c}`") for c in documents.columns])


def digest(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the md5 of the text that is left (empty for null)."""
    kept = drop_templates(documents.select(documents["doc_id"], documents["text"]))
    return kept.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, text, coalesce(doc_id, 9223372036854775807) AS id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, id, text, unnest(parts) AS line, generate_subscripts(parts, 1) - 1 AS line_no FROM docs),
masked AS (SELECT doc_id, id, text, line_no,
  regexp_replace(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), '[^ ]*[0-9@/][^ ]*', '<*>', 'g') AS masked FROM lines),
counted AS (SELECT *, string_split(masked, ' ') AS tokens FROM masked WHERE len(string_split(masked, ' ')) >= 3),
pathed AS (SELECT *, len(tokens) || ' ' || array_to_string(tokens[1:3], ' ') AS leaf FROM counted),
busy AS (SELECT leaf FROM pathed GROUP BY leaf HAVING count(DISTINCT text) >= 8),
inside AS (SELECT * FROM pathed WHERE leaf IN (SELECT leaf FROM busy)),
distinct_lines AS (SELECT DISTINCT leaf, masked, tokens FROM inside),
tokens AS (SELECT leaf, masked, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM distinct_lines),
votes AS (SELECT leaf, pos, token, count(*) AS n FROM tokens GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY leaf, pos) AS every, row_number() OVER (PARTITION BY leaf, pos ORDER BY n DESC, token DESC) AS place FROM votes),
heads AS (SELECT leaf, pos, CASE WHEN 2 * n >= every THEN token END AS constant FROM ranked WHERE place = 1),
general AS (SELECT leaf FROM heads GROUP BY leaf HAVING avg(CASE WHEN constant IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END) >= 0.7::DOUBLE),
fits AS (
  SELECT t.leaf, t.masked FROM tokens t JOIN heads h ON t.leaf = h.leaf AND t.pos = h.pos WHERE t.leaf IN (SELECT leaf FROM general)
  GROUP BY t.leaf, t.masked HAVING count(*) FILTER (t.token = h.constant) / count(h.constant)::DOUBLE >= 0.7::DOUBLE),
placed AS (SELECT i.*, CASE WHEN f.masked IS NOT NULL THEN '' ELSE i.masked END AS variant FROM inside i LEFT JOIN fits f ON i.leaf = f.leaf AND i.masked = f.masked),
recurs AS (SELECT leaf, variant, min(id) AS first_id FROM placed GROUP BY ALL HAVING count(DISTINCT text) >= 8),
gone AS (
  SELECT doc_id, line_no FROM (
    SELECT p.doc_id, p.line_no, p.id = r.first_id AND p.line_no = min(p.line_no) OVER (PARTITION BY p.leaf, p.variant, p.id) AS keeps
    FROM placed p JOIN recurs r ON p.leaf = r.leaf AND p.variant = r.variant) WHERE NOT keeps),
per_doc AS (SELECT doc_id, list(line_no) AS gone FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g.gone), 0) AS BIGINT) AS n_dropped,
  md5(coalesce(CASE WHEN g.gone IS NULL THEN text ELSE array_to_string(list_filter(parts, lambda x, i: NOT list_contains(g.gone, i - 1)), chr(10)) END, '')) AS kept_md5
FROM docs d LEFT JOIN per_doc g ON d.doc_id = g.doc_id
"""
