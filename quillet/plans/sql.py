"""SQL twins of the recognition queries, for DuckDB over the same tables."""

from __future__ import annotations

from quillet.functions.marks import ENCODED
from quillet.sources.adapters import BOXES, CANDIDATES, CELLS, LABELS, NUMBERED, PROGRESS, READS, VOCABULARY

_NORMAL = "regexp_replace(lower(literal), '[^a-z]', '', 'g')"


def distance(raw: str, word: str) -> str:
    """The weighted edit distance as two nested folds over lists."""
    return f"""list_reduce(
      list_transform(range(1, length({raw}) + 1), lambda i: [CAST(i AS DOUBLE)]),
      lambda prev, i: list_reduce(
        list_transform(range(1, length({word}) + 1), lambda j: [CAST(j AS DOUBLE)]),
        lambda done, j: list_append(done, least(
          prev[CAST(j[1] AS INTEGER) + 1] + 2 * CASE WHEN i[1] = 1 THEN 2.0 ELSE 1.0 END,
          done[len(done)] + 1,
          prev[CAST(j[1] AS INTEGER)] + CASE WHEN substr({word}, CAST(j[1] AS INTEGER), 1) = substr({raw}, CAST(i[1] AS INTEGER), 1) THEN 0 WHEN i[1] = 1 THEN 2.0 ELSE 1.0 END)),
        [CAST(4 + (i[1] - 1) * 2 AS DOUBLE)]),
      list_transform(range(0, length({word}) + 1), lambda j: CASE WHEN j = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 + j AS DOUBLE) END))[length({word}) + 1]"""


_DISTANCES = f"""
spellings AS (SELECT DISTINCT {_NORMAL} AS read FROM reads WHERE {_NORMAL} <> ''),
distances AS (SELECT read, word_id, word, {distance('read', 'word')} AS d FROM spellings, vocabulary)"""
_RANKED = """
ranked AS (SELECT *, row_number() OVER o AS model_rank, CASE WHEN row_number() OVER o = 1 THEN p - lead(p) OVER o END AS margin
  FROM candidates WINDOW o AS (PARTITION BY page_id, box_id ORDER BY p DESC, word_id))"""
_SCORED = f"""
scored AS (SELECT r.*, d.d, CASE WHEN p = 0 THEN '-inf'::DOUBLE ELSE log10(p) - d.d END AS score
  FROM ranked r JOIN (SELECT page_id, box_id, {_NORMAL} AS read FROM reads) x USING (page_id, box_id) JOIN distances d ON d.read = x.read AND d.word_id = r.word_id)"""
_BASE = f"WITH {READS}, {VOCABULARY}, {CANDIDATES}, {_DISTANCES}, {_RANKED}"



def _selection(ranking: str) -> str:
    """Candidate selection over a table of rankings: every read has a row."""
    return f"""WITH {READS}, {VOCABULARY}, {CANDIDATES}, {_DISTANCES},
ranked AS (SELECT *, row_number() OVER o AS model_rank, lead(p) OVER o AS next_p, count(*) OVER (PARTITION BY page_id, box_id) AS n FROM {ranking} WINDOW o AS (PARTITION BY page_id, box_id ORDER BY p DESC, word_id)),
x AS (SELECT page_id, box_id, {_NORMAL} AS read FROM reads),
tops AS (SELECT page_id, box_id, word_id AS top_id, p AS top_p, p - next_p AS top_margin, n FROM ranked WHERE model_rank = 1),
scored AS (SELECT r.page_id, r.box_id, r.word_id, CASE WHEN p = 0 THEN '-inf'::DOUBLE ELSE log10(p) - d.d END AS score, p, d.d FROM ranked r JOIN x USING (page_id, box_id) JOIN distances d ON d.read = x.read AND d.word_id = r.word_id),
joint AS (SELECT *, row_number() OVER o AS k, lead(score) OVER o AS next_score FROM scored WINDOW o AS (PARTITION BY page_id, box_id ORDER BY score DESC, p DESC, d, word_id)),
chosen AS (
  SELECT x.page_id, x.box_id, read, e.word_id AS exact_id, top_p, top_margin, n, j.score, j.next_score,
    CASE WHEN e.word_id IS NOT NULL THEN e.word_id WHEN top_p > 0 THEN CASE WHEN read = '' THEN top_id ELSE j.word_id END END AS word_id
  FROM x LEFT JOIN vocabulary e ON e.word = read LEFT JOIN tops t ON t.page_id = x.page_id AND t.box_id = x.box_id LEFT JOIN (SELECT * FROM joint WHERE k = 1) j ON j.page_id = x.page_id AND j.box_id = x.box_id)
SELECT c.page_id, c.box_id, v.word, CASE WHEN exact_id IS NOT NULL THEN 'exact_text' WHEN c.word_id IS NULL THEN NULL WHEN read = '' OR c.n <= 1 THEN 'model_fallback' ELSE 'joint' END AS branch,
  CAST(r.model_rank AS INTEGER) AS support_rank, round(r.p, 6) AS support_p, round(top_margin, 6) AS margin,
  CASE WHEN c.word_id IS NULL THEN 'no_candidate' WHEN r.model_rank IS NULL THEN 'unavailable' WHEN r.model_rank <> 1 THEN 'disagreement' WHEN exact_id IS NULL AND read <> '' AND score = next_score THEN 'joint_tie'
    WHEN top_p >= 0.2 AND top_margin >= 0.01 THEN 'accepted' ELSE 'insufficient' END AS confirmation
FROM chosen c LEFT JOIN vocabulary v ON v.word_id = c.word_id LEFT JOIN ranked r ON r.page_id = c.page_id AND r.box_id = c.box_id AND r.word_id = c.word_id"""


_SYMBOLS = "=#ABCDEFGHIJKLMNOPQRSTUVWXYZ-"
_BOOK = f"""
letters AS (SELECT word_id, word, list_transform(range(1, 5), lambda i: instr('{_SYMBOLS}', substr(rpad(upper(substr(word, 1, 4)), 4, '-'), CAST(i AS INTEGER), 1)) - 1) AS s FROM vocabulary),
book AS (SELECT word_id, word, [(14 * s[1] + 2 * s[2] + 11 * s[3] + 15 * s[4]) % 29, (6 * s[1] + 20 * s[2] + 12 * s[3] + 22 * s[4]) % 29, s[1], s[2], s[3], s[4]] AS code FROM letters)"""
_INVERSE = "[" + ", ".join(str(pow(k, 27, 29)) for k in range(1, 29)) + "]"


def _softmax(temperature: str) -> str:
    return f"""
exps AS (SELECT *, exp((x - max(x) OVER (PARTITION BY word_no, cell)) / {temperature}) AS e FROM cells),
dist AS (SELECT word_no, cell, sym, e / sum(e) OVER (PARTITION BY word_no, cell) AS p FROM exps),
best AS (SELECT word_no, cell, sym, p FROM (SELECT *, row_number() OVER (PARTITION BY word_no, cell ORDER BY p DESC, sym) AS k FROM dist) WHERE k = 1)"""


_LITERALS = """
literals AS (SELECT page_id * 10 + box_id AS row_id, CASE (page_id + box_id) % 8
  WHEN 0 THEN page_id % 23 || '. ' || literal WHEN 1 THEN page_id % 23 || '.' WHEN 2 THEN 'l.' || literal WHEN 3 THEN 'lO'
  WHEN 4 THEN ' ' || page_id % 23 || ' ) ' WHEN 5 THEN page_id % 23 || upper(literal) WHEN 6 THEN literal || ' and more' ELSE literal END AS text FROM reads)"""
_SHAPED = "lLIiSsGgOoBbZzqADT"
_MEDIAN = "list_sort(list(b - t))[len(list(b - t)) // 2 + 1]"
_PADDED = f"""
scale AS (SELECT page_id, greatest({_MEDIAN}, 1.0) AS h FROM boxes GROUP BY page_id),
padded AS (SELECT page_id, box_id, l - 1.5 * h AS l, r + 1.5 * h AS r, t - h AS t, b + h AS b FROM boxes JOIN scale USING (page_id)),
edges AS (SELECT p.page_id, p.box_id AS a, q.box_id AS b FROM padded p JOIN padded q ON p.page_id = q.page_id AND p.box_id < q.box_id AND p.l < q.r AND q.l < p.r AND p.t < q.b AND q.t < p.b)"""


def _rollup(source: str = "progress", parents: str = "") -> str:
    return f"""
ends AS (SELECT attempt_id, min(seq) AS stop, arg_min(kind, seq) AS how FROM {source} WHERE kind IN ('completed', 'failed') GROUP BY attempt_id),
joined AS (SELECT p.*, how, coalesce(p.seq > stop, false) AS late FROM {source} p LEFT JOIN ends USING (attempt_id)),
live AS (SELECT * FROM joined WHERE NOT late AND kind NOT IN ('completed', 'failed')),
gone AS (SELECT attempt_id, region_id, min(seq) AS gone FROM (SELECT attempt_id, region_id, seq FROM live WHERE kind = 'removed' {parents}) GROUP BY ALL),
marked AS (SELECT l.*, gone FROM live l LEFT JOIN gone g ON g.attempt_id = l.attempt_id AND g.region_id = l.region_id),
rollup AS (SELECT attempt_id, region_id, replace(arg_max(kind, seq), 'replaced', 'found') AS state, max(seq) AS seq FROM marked WHERE gone IS NULL AND how IS DISTINCT FROM 'failed' GROUP BY ALL)"""


_ROLLUP = _rollup()


def _folded(low: str, high: str, cross: str, name: str) -> str:
    """Axis groups by a recursive fold over a page's boxes in order of their starts."""
    return f"""
{name}_order AS (SELECT page_id, box_id, {low} AS lo, {high} AS hi, ({low} + {high}) / 2 AS c, {cross} AS o, row_number() OVER (PARTITION BY page_id ORDER BY {low}, box_id) AS k FROM boxes),
{name}_fold AS (
  SELECT page_id, 0::BIGINT AS k, []::STRUCT(lo DOUBLE, hi DOUBLE, m STRUCT(o DOUBLE, id INTEGER)[])[] AS g FROM boxes GROUP BY page_id
  UNION ALL
  SELECT f.page_id, x.k, CASE WHEN len(list_filter(f.g, lambda q: x.c >= q.lo AND x.c <= q.hi)) = 0 THEN list_append(f.g, {{'lo': x.lo, 'hi': x.hi, 'm': [{{'o': x.o, 'id': x.box_id}}]}})
    ELSE list_transform(f.g, lambda q, i: CASE WHEN i = list_position(list_transform(f.g, lambda z: x.c >= z.lo AND x.c <= z.hi), true)
      THEN {{'lo': least(q.lo, x.lo), 'hi': greatest(q.hi, x.hi), 'm': list_append(q.m, {{'o': x.o, 'id': x.box_id}})}} ELSE q END) END
  FROM {name}_fold f JOIN {name}_order x ON x.page_id = f.page_id AND x.k = f.k + 1),
{name}_last AS (SELECT page_id, list_sort(arg_max(g, k)) AS g FROM {name}_fold GROUP BY page_id),
{name}_groups AS (SELECT page_id, generate_subscripts(g, 1) - 1 AS group_no, list_transform(list_sort(unnest(g).m), lambda m: m.id) AS members FROM {name}_last)"""


_COLUMNS, _ROWS = _folded("l", "r", "(t + b) / 2", "columns"), _folded("t", "b", "(l + r) / 2", "rows")
_GROUPS = "CAST(group_no AS INTEGER) AS group_no, array_to_string(members, ',') AS members"
_FIT = """
v AS (SELECT * FROM page_labels WHERE kind = 'exact'),
odd AS (SELECT page_id, count(*) FILTER (a.pos < b.pos AND a.n > b.n) AS by_pos, count(*) FILTER (a.row_pos < b.row_pos AND a.n > b.n) AS by_row FROM v a JOIN v b USING (page_id) GROUP BY page_id),
placed AS (SELECT p.page_id, CASE WHEN coalesce(by_row < by_pos, false) THEN row_pos ELSE pos END AS pos, kind, n FROM page_labels p LEFT JOIN odd ON odd.page_id = p.page_id),
x AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS i FROM placed WHERE kind = 'exact'),
page AS (SELECT page_id, count(*) AS boxes, count(*) FILTER (kind = 'exact') AS exact, count(DISTINCT n) FILTER (kind = 'exact') AS different, max(n) FILTER (kind = 'exact') AS highest FROM placed GROUP BY page_id),
lengths AS (SELECT page_id, i, n, 1 AS size FROM x UNION SELECT b.page_id, b.i, b.n, a.size + 1 FROM lengths a JOIN x b ON b.page_id = a.page_id AND b.i > a.i AND b.n > a.n),
best AS (SELECT page_id, i, n, max(size) AS size FROM lengths GROUP BY ALL),
path AS (SELECT page_id, i, n, size FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY size DESC, i) AS k FROM best) WHERE k = 1
  UNION ALL SELECT page_id, i, n, size FROM (SELECT b.*, row_number() OVER (PARTITION BY p.page_id, p.i ORDER BY b.i) AS k FROM path p JOIN best b ON b.page_id = p.page_id AND b.i < p.i AND b.n < p.n AND b.size = p.size - 1) WHERE k = 1),
state AS (SELECT page.*, coalesce(len, 0) AS len, CASE WHEN exact < 8 THEN 'none' WHEN different < exact OR highest > 2 * greatest(boxes, 12) OR len < 8 THEN 'inconsistent' ELSE 'held' END AS status,
  CASE WHEN exact >= 8 THEN CASE WHEN different < exact THEN 'duplicate' WHEN highest > 2 * greatest(boxes, 12) THEN 'too_high' WHEN len < 8 THEN 'out_of_order' END END AS reason
  FROM page LEFT JOIN (SELECT page_id, count(*) AS len FROM path GROUP BY page_id) r ON r.page_id = page.page_id),
anchors AS (SELECT path.page_id, x.pos AS place, path.n FROM path JOIN x ON x.page_id = path.page_id AND x.i = path.i JOIN state s ON s.page_id = path.page_id AND status = 'held'
  UNION ALL SELECT page_id, -1, 0 FROM state WHERE status = 'held'),
spans AS (SELECT page_id, place AS start, n AS low, lead(place) OVER o AS stop, lead(n) OVER o AS high FROM anchors WINDOW o AS (PARTITION BY page_id ORDER BY n)),
room AS (SELECT s.*, list_filter(range(low + 1, high), lambda k: NOT list_contains(vs, k)) AS holes, coalesce(list_sort(free), []) AS between FROM spans s JOIN (SELECT page_id, list(n) AS vs FROM x GROUP BY page_id) USING (page_id)
  LEFT JOIN (SELECT s.page_id, s.start, list(p.pos) AS free FROM spans s JOIN placed p ON p.page_id = s.page_id AND p.n IS NULL AND p.pos > s.start AND p.pos < s.stop GROUP BY ALL) f ON f.page_id = s.page_id AND f.start = s.start WHERE high IS NOT NULL),
filled AS (SELECT * FROM room WHERE len(holes) > 0 AND len(holes) = len(between)),
ends AS (SELECT page_id, max(place) AS place, max(n) AS n FROM anchors GROUP BY page_id),
tail AS (SELECT p.page_id, p.pos, e.n + row_number() OVER (PARTITION BY p.page_id ORDER BY p.pos) AS next, p.n IS NULL AND coalesce(kind = 'shaped', false) AS ok FROM placed p JOIN ends e ON e.page_id = p.page_id AND p.pos > e.place),
run_on AS (SELECT page_id, pos, next FROM (SELECT t.*, bool_and(ok AND x.n IS NULL) OVER (PARTITION BY t.page_id ORDER BY t.pos) AS goes FROM tail t LEFT JOIN x ON x.page_id = t.page_id AND x.n = t.next) WHERE goes),
numbered AS (SELECT page_id, n AS number, pos FROM x UNION ALL SELECT page_id, unnest(holes), unnest(between) FROM filled UNION ALL SELECT page_id, next, pos FROM run_on),
totals AS (SELECT s.page_id, CAST(greatest(max(highest), coalesce(max(next), 0)) AS INTEGER) AS count FROM state s LEFT JOIN run_on r ON r.page_id = s.page_id WHERE status = 'held' GROUP BY s.page_id),
held AS (SELECT page_id, list(number) AS all_numbers, list(pos) AS all_pos FROM numbered GROUP BY page_id),
runs AS (SELECT page_id, list(n) AS members FROM path GROUP BY page_id),
odd_ones AS (SELECT x.page_id, string_agg(CAST(x.n AS VARCHAR), ',' ORDER BY x.pos) AS t FROM x JOIN runs r ON r.page_id = x.page_id WHERE NOT list_contains(members, x.n) GROUP BY x.page_id),
open_ones AS (SELECT p.page_id, string_agg(CAST(p.pos AS VARCHAR), ',' ORDER BY p.pos) AS t FROM placed p JOIN held h ON h.page_id = p.page_id WHERE p.kind IS NOT NULL AND NOT list_contains(all_pos, p.pos) GROUP BY p.page_id),
lost AS (SELECT t.page_id, array_to_string(list_filter(range(1, t.count + 1), lambda k: NOT list_contains(all_numbers, k)), ',') AS t FROM totals t JOIN held h ON h.page_id = t.page_id)
SELECT s.page_id, status, t.count, reason,
  CASE WHEN status = 'held' THEN coalesce(l.t, '') END AS missing, CASE WHEN status = 'held' THEN coalesce(o.t, '') END AS out_of_place, CASE WHEN status = 'held' THEN coalesce(u.t, '') END AS unresolved
FROM state s LEFT JOIN totals t ON t.page_id = s.page_id LEFT JOIN lost l ON l.page_id = s.page_id LEFT JOIN odd_ones o ON o.page_id = s.page_id LEFT JOIN open_ones u ON u.page_id = s.page_id"""

_SHARES = """
shares AS (SELECT p_partkey AS row_id, share_no, (p_partkey * 5 % 29 + p_partkey * 3 % 29 * share_no + CASE WHEN share_no = 3 AND p_partkey % 10 = 0 THEN 1 ELSE 0 END) % 29 AS symbol FROM part, (SELECT unnest([1, 2, 3]) AS share_no))"""

_ENCODED = "[" + ", ".join(map(str, ENCODED)) + "]"

ORACLES = {
    "weighted_distances": f"WITH {READS}, {VOCABULARY}, {_DISTANCES} SELECT read, word, d FROM distances",
    "near_list": f"WITH {READS}, {VOCABULARY}, {_DISTANCES} SELECT read, word, d, d <= 3 AS near FROM (SELECT *, row_number() OVER (PARTITION BY read ORDER BY d, word_id) AS k FROM distances) WHERE k = 1",
    "select_candidates": _selection("candidates"),
    "select_outcomes": _selection("(SELECT * FROM candidates WHERE p >= 0.25)"),
    "label_functions": f"""WITH {READS}, {_LITERALS},
bodies AS (SELECT *, regexp_replace(trim(text), '[.:)\\]\\-_\\s]+$', '') AS body, ltrim(text) AS start, regexp_extract(text, '^([0-9{_SHAPED}|][0-9{_SHAPED}|]?)', 1) AS first_two FROM literals)
SELECT row_id,
  CASE WHEN regexp_full_match(body, '[0-9]{{1,2}}') AND TRY_CAST(body AS INTEGER) >= 1 THEN 'exact' WHEN regexp_full_match(body, '[0-9{_SHAPED}]{{1,2}}') AND NOT regexp_full_match(body, '[0-9]+') THEN 'shaped' END AS label_kind,
  CASE WHEN regexp_full_match(body, '[0-9]{{1,2}}') AND TRY_CAST(body AS INTEGER) >= 1 THEN CAST(body AS INTEGER) END AS label_n,
  CASE WHEN first_two <> '' THEN nullif(regexp_extract(substr(text, length(first_two) + 1), '^[.:)\\]\\-_\\s]+(.+)$', 1), '') END AS past_label,
  CASE WHEN regexp_matches(start, '^[\\pL\\pN]{{0,2}}\\.') THEN split_part(start, '.', 1) END AS head,
  CASE WHEN regexp_matches(start, '^[\\pL\\pN]{{0,2}}\\.') THEN ltrim(regexp_replace(start, '^[^.]*\\.', '')) END AS remainder,
  regexp_matches(text, '^[0-9]') AS leading_digit, regexp_replace(lower(text), '[^a-z]', '', 'g') AS normal,
  len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '\\pL'))) >= 2 AS prose,
  length(regexp_replace(lower(text), '[^a-z]', '', 'g')) <= 8 AND len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '\\pL'))) <= 1 AS possible,
  ltrim(regexp_replace(regexp_replace(text, '^[0-9]+', ''), '^[.):]+', '')) AS stripped
FROM bodies""",
    "score_families": f"""WITH {READS}, {VOCABULARY}, {CANDIDATES}, scaled AS (SELECT *, CAST(word_id % 5 AS DOUBLE) AS d FROM candidates)
SELECT page_id, box_id, word_id, CASE WHEN p = 0 THEN '-inf' ELSE CAST(CAST(round(log10(p) - d, 6) AS DECIMAL(18, 6)) AS VARCHAR) END AS log_score,
  CASE WHEN p = 0 THEN '-inf' ELSE CAST(CAST(round(log10(p) - d * d, 6) AS DECIMAL(18, 6)) AS VARCHAR) END AS squared,
  round(0.0 - d * pow(1 - p, 2), 6) AS power_complement, round(0.0 - d * (1 - pow(p, 2)), 6) AS complement_power FROM scaled""",
    "verdicts": f"""WITH {READS}, {VOCABULARY}, {CANDIDATES}, {_RANKED}
SELECT page_id, box_id, max(CASE WHEN model_rank = 1 THEN p END) >= 0.2 AS probable, max(margin) >= 0.01 AS apart, count(DISTINCT word_id) = count(*) AS "unique", bool_and(p BETWEEN 0 AND 1) AS in_range FROM ranked GROUP BY page_id, box_id""",
    "diagnostic_top": f"""{_BASE}, {_SCORED}
SELECT page_id, box_id, word_id, CAST(score_rank AS INTEGER) AS score_rank, CAST(model_rank AS INTEGER) AS model_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id, box_id ORDER BY score DESC, p DESC, d, word_id) AS score_rank FROM scored) WHERE score_rank <= 8 OR model_rank = 1""",
    "distance_first": f"""{_BASE}, {_SCORED}
SELECT page_id, box_id, word_id, d FROM (SELECT *, row_number() OVER (PARTITION BY page_id, box_id ORDER BY d, p DESC, word_id) AS k FROM scored WHERE model_rank <= 5 AND (model_rank = 1 OR d <= 3)) WHERE k = 1""",
    "field_arithmetic": f"""WITH f AS (SELECT CAST(l_partkey % 29 AS INTEGER) AS x, CAST(l_suppkey % 29 AS INTEGER) AS y, CAST(l_orderkey % 29 AS INTEGER) AS z FROM lineitem),
g AS (SELECT x, y, z, (x + y) % 29 AS sum, (x - y + 29) % 29 AS difference, x * y % 29 AS product, CASE WHEN x <> 0 THEN ({_INVERSE})[x] END AS inverse,
  CASE WHEN x = 0 THEN y % 29 ELSE x * (y + 15) % 29 END AS wheel, (x + y * z) % 29 AS line, (y - x + 29) % 29 * {pow(2, 27, 29)} % 29 AS slope FROM f)
SELECT *, count(*) AS rows FROM g GROUP BY ALL""",
    "codewords": f"WITH {VOCABULARY}, {_BOOK} SELECT word, array_to_string(list_transform(code, lambda s: substr('{_SYMBOLS}', CAST(s + 1 AS INTEGER), 1)), '') AS symbols FROM book",
    "blocked_decode": f"""WITH {VOCABULARY}, {_BOOK},
received AS (SELECT p_partkey AS row_id, list_transform(code, lambda s, i: CASE WHEN (p_partkey * 7 + (i - 1) * 5) % 11 < p_partkey % 4 THEN (s + 1 + p_partkey % 13) % 29 ELSE s END) AS code
  FROM part JOIN book ON book.word = split_part(p_name, ' ', 1)),
near AS (SELECT r.row_id, b.word_id, len(list_filter(range(1, 7), lambda i: r.code[i] <> b.code[i])) AS d FROM received r, book b),
found AS (SELECT row_id, count(*) AS n, min(d) AS d, arg_min(word_id, d * 1000 + word_id) AS word_id FROM near WHERE d <= 2 GROUP BY row_id)
SELECT row_id, CASE WHEN n IS NULL THEN 'unrecognized' WHEN n = 1 AND d = 0 THEN 'exact' WHEN n = 1 AND d = 1 THEN 'corrected' ELSE 'candidates' END AS outcome,
  CASE WHEN n = 1 AND d <= 1 THEN found.word_id END AS word_id, coalesce(n, 0) AS candidates FROM received LEFT JOIN found USING (row_id)""",
    "share_lines": f"""WITH {_SHARES}, p AS (SELECT row_id, max(CASE WHEN share_no = 1 THEN symbol END) AS a, max(CASE WHEN share_no = 2 THEN symbol END) AS b, max(CASE WHEN share_no = 3 THEN symbol END) AS c FROM shares GROUP BY row_id),
s AS (SELECT *, (b - a + 29) % 29 AS slope FROM p)
SELECT row_id, slope, (a - slope + 29) % 29 AS intercept, (c - a + 58) % 29 = 2 * slope % 29 AS on_line FROM s""",
    "cell_softmax": f"WITH {CELLS}, {_softmax('1.0')} SELECT word_no, cell, CAST(sym AS INTEGER) AS sym, round(p, 6) AS p FROM best",
    "cell_confidence": f"WITH {CELLS}, {_softmax('1.0')} SELECT word_no, round(avg(p), 6) AS mean_p, first(cell ORDER BY p, cell) AS least_cell FROM best GROUP BY word_no",
    "combined_distributions": f"""WITH {CELLS}, {_softmax('0.05')},
pairs AS (SELECT word_no // 2 AS word_no, cell, sym, p, word_no % 2 AS side FROM dist WHERE p > 0)
SELECT a.word_no, a.cell, CAST(((b.sym - a.sym) * {pow(2, 27, 29)} % 29 + 29) % 29 AS INTEGER) AS sym, round(sum(a.p * b.p), 6) AS p FROM pairs a JOIN pairs b ON a.word_no = b.word_no AND a.cell = b.cell AND a.side = 0 AND b.side = 1 GROUP BY ALL""",
    "soft_decoding": f"""WITH {VOCABULARY}, {_BOOK}, {CELLS}, {_softmax('0.5')},
spelled AS (SELECT word_id, unnest(code) AS sym, generate_subscripts(code, 1) - 1 AS cell FROM book), words AS (SELECT DISTINCT word_no FROM dist),
met AS (SELECT w.word_no, s.word_id, coalesce(p, 0.0) AS p FROM words w CROSS JOIN spelled s LEFT JOIN dist d ON d.word_no = w.word_no AND d.cell = s.cell AND d.sym = s.sym),
found AS (SELECT word_no, word_id, sum(CASE WHEN p < 0.02 THEN 1 ELSE 0 END) AS distance FROM met GROUP BY ALL HAVING sum(CASE WHEN p < 0.02 THEN 1 ELSE 0 END) <= 2),
best AS (SELECT word_no, count(*) AS n, min(distance) AS d, min(word_id) AS word_id FROM found GROUP BY word_no)
SELECT word_no, CASE WHEN n IS NULL THEN 'unrecognized' WHEN n = 1 AND d <= 1 THEN 'accepted' ELSE 'candidates' END AS outcome, CASE WHEN n = 1 AND d <= 1 THEN word_id END AS word_id FROM words LEFT JOIN best USING (word_no)""".replace("best AS (SELECT word_no, cell, sym, p FROM (SELECT *, row_number() OVER (PARTITION BY word_no, cell ORDER BY p DESC, sym) AS k FROM dist) WHERE k = 1),", "unused AS (SELECT 1),"),
    "position_costs": f"WITH {CELLS}, {_softmax('1.0')} SELECT word_no, cell, CAST(sym AS INTEGER) AS sym, CAST(round(-ln((p + 0.001) / sum(p + 0.001) OVER (PARTITION BY word_no, cell)) * 1000) AS INTEGER) AS cost FROM dist",
    "box_geometry": f"WITH {BOXES} SELECT page_id, box_id, r - l AS w, b - t AS h, (l + r) / 2 AS cx, (t + b) / 2 AS cy, CAST(ceil(r - l) * ceil(b - t) AS BIGINT) AS pixels FROM boxes",
    "page_envelope": f"WITH {BOXES} SELECT page_id, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, count(*) AS boxes FROM boxes GROUP BY page_id",
    "height_medians": f"WITH {BOXES} SELECT page_id, {_MEDIAN} AS upper_middle, median(b - t) AS average_middle FROM boxes GROUP BY page_id",
    "reach_edges": f"WITH {BOXES}, {_PADDED} SELECT page_id, a, b FROM edges",
    "region_exclusion": f"""WITH RECURSIVE {BOXES}, {_PADDED},
two_way AS (SELECT page_id, a, b FROM edges UNION ALL SELECT page_id, b, a FROM edges),
reach AS (SELECT page_id, box_id, box_id AS root FROM boxes UNION SELECT e.page_id, e.b, r.root FROM reach r JOIN two_way e ON e.page_id = r.page_id AND e.a = r.box_id),
named AS (SELECT page_id, box_id, min(root) AS component FROM reach GROUP BY ALL),
sized AS (SELECT *, count(*) OVER (PARTITION BY page_id, component) AS size FROM named)
SELECT page_id, box_id, component, size, size <= 3 AND 3 * size < max(size) OVER (PARTITION BY page_id) AS apart FROM sized""",
    "dominant_block": f"""WITH {BOXES}, words AS (SELECT *, (t + b) / 2 AS y FROM boxes WHERE r - l >= 2 * (b - t)),
scale AS (SELECT page_id, {_MEDIAN} AS h FROM words GROUP BY page_id HAVING count(*) >= 2),
steps AS (SELECT w.*, h, CASE WHEN y - lag(y) OVER o > 2 * h THEN 1 ELSE 0 END AS starts FROM words w JOIN scale USING (page_id) WINDOW o AS (PARTITION BY page_id ORDER BY y, box_id)),
blocks AS (SELECT *, sum(starts) OVER (PARTITION BY page_id ORDER BY y, box_id) AS block FROM steps),
sizes AS (SELECT page_id, block, count(*) AS size, min(y) AS top, max(y) AS bottom, any_value(h) AS h FROM blocks GROUP BY page_id, block)
SELECT page_id, size, top, bottom, h FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY size DESC, block DESC) AS k FROM sizes) WHERE k = 1 AND size >= 2""",
    "nearest_label": f"""WITH {BOXES}, pairs AS (SELECT a.page_id, a.box_id AS label_id, q.box_id AS word_id, q.l - a.l AS gap FROM boxes a JOIN boxes q ON a.page_id = q.page_id AND a.r - a.l <= 120 AND q.r - q.l > 120 AND q.l >= a.l AND (a.t + a.b) / 2 BETWEEN q.t AND q.b)
SELECT page_id, label_id, CASE WHEN nxt - gap <= 1 THEN NULL ELSE word_id END AS word_id FROM (SELECT *, row_number() OVER o AS k, lead(gap) OVER o AS nxt FROM pairs WINDOW o AS (PARTITION BY page_id, label_id ORDER BY gap, word_id)) WHERE k = 1""",
    "fragment_owners": f"""WITH {BOXES}, s AS (SELECT * FROM boxes WHERE r - l < 100), o AS (SELECT * FROM boxes WHERE r - l >= 100),
counted AS (SELECT s.page_id, s.box_id, count(o.box_id) AS owners, min(o.box_id) AS owner FROM s LEFT JOIN o ON s.page_id = o.page_id AND (s.l + s.r) / 2 BETWEEN o.l AND o.r AND (s.t + s.b) / 2 BETWEEN o.t AND o.b GROUP BY ALL),
hits AS (SELECT DISTINCT x.page_id, x.box_id FROM s x JOIN s y ON x.page_id = y.page_id AND x.box_id <> y.box_id AND x.l < y.r AND y.l < x.r AND x.t < y.b AND y.t < x.b)
SELECT c.page_id, c.box_id, CASE WHEN owners = 1 THEN owner END AS owner, CASE WHEN owners = 0 THEN 'no_owner' WHEN owners > 1 THEN 'ambiguous' WHEN h.box_id IS NOT NULL THEN 'collision' ELSE 'owned' END AS outcome
FROM counted c LEFT JOIN hits h ON c.page_id = h.page_id AND c.box_id = h.box_id""",
    "axis_agreement": """WITH a AS (SELECT CAST(l_partkey % 360 AS DOUBLE) AS x, CAST(l_suppkey % 90 * 4 AS DOUBLE) AS y FROM lineitem)
SELECT x, y, abs((x - y + 90) - 180 * floor((x - y + 90) / 180) - 90) <= 15 AS agree, count(*) AS rows FROM a GROUP BY ALL""",
    "read_budget": f"""WITH RECURSIVE {BOXES}, costs AS (SELECT page_id, box_id, CAST(ceil(r - l) * ceil(b - t) AS BIGINT) AS px FROM boxes),
fold AS (SELECT page_id, -1 AS box_id, 0 AS n, 0::BIGINT AS spent, false AS admitted FROM costs GROUP BY page_id
  UNION ALL SELECT c.page_id, c.box_id, f.n + CASE WHEN f.n < 4 AND f.spent + px <= 12000 THEN 1 ELSE 0 END, f.spent + CASE WHEN f.n < 4 AND f.spent + px <= 12000 THEN px ELSE 0 END, f.n < 4 AND f.spent + px <= 12000
  FROM fold f JOIN costs c ON c.page_id = f.page_id AND c.box_id = f.box_id + 1)
SELECT page_id, box_id, admitted FROM fold WHERE box_id >= 0""",
    "number_inversions": f"""WITH {LABELS}, x AS (SELECT * FROM page_labels WHERE kind = 'exact'), bad AS (SELECT a.page_id, count(*) AS n FROM x a JOIN x b ON a.page_id = b.page_id AND a.pos < b.pos AND a.n > b.n GROUP BY a.page_id)
SELECT p.page_id, coalesce(bad.n, 0) AS inversions FROM (SELECT DISTINCT page_id FROM page_labels) p LEFT JOIN bad ON bad.page_id = p.page_id""",
    "number_duplicates": f"WITH {LABELS} SELECT page_id, n, count(*) AS boxes FROM page_labels WHERE kind = 'exact' GROUP BY page_id, n HAVING count(*) > 1",
    "missing_numbers": f"""WITH {LABELS}, c AS (SELECT page_id, list(DISTINCT n) AS ns, max(n) AS highest FROM page_labels WHERE kind = 'exact' GROUP BY page_id)
SELECT page_id, highest, array_to_string(list_filter(range(1, highest + 1), lambda k: NOT list_contains(ns, k)), ',') AS missing FROM c""",
    "hole_filling": f"""WITH {LABELS}, x AS (SELECT *, CASE WHEN kind = 'exact' THEN n END AS x FROM page_labels),
s AS (SELECT *, last_value(x IGNORE NULLS) OVER o AS before, first_value(x IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after, count(x) OVER o AS span FROM x WINDOW o AS (PARTITION BY page_id ORDER BY pos)),
e AS (SELECT *, row_number() OVER (PARTITION BY page_id, span ORDER BY pos) AS k, count(*) OVER (PARTITION BY page_id, span) AS m FROM s WHERE x IS NULL)
SELECT page_id, pos, CAST(CASE WHEN before IS NOT NULL AND after IS NOT NULL AND after - before - 1 = m THEN before + k END AS INTEGER) AS n, before IS NOT NULL AND after IS NOT NULL AND after - before - 1 = m AS filled FROM e
UNION ALL SELECT page_id, pos, CAST(x AS INTEGER), false FROM s WHERE x IS NOT NULL""",
    "ctc_collapse": """WITH s AS (SELECT user_id AS line_id, event_id AS t, CAST(floor(value) AS BIGINT) % 4 AS best, event_id % 50 / 50.0 AS p FROM events),
k AS (SELECT * FROM (SELECT *, lag(best) OVER (PARTITION BY line_id ORDER BY t) AS before FROM s) WHERE best <> 0 AND (before IS NULL OR before <> best)),
x AS (SELECT line_id, string_agg(CAST(best AS VARCHAR), '-' ORDER BY t) AS symbols, avg(p) AS confidence FROM k GROUP BY line_id)
SELECT l.line_id, coalesce(symbols, '') AS symbols, round(coalesce(confidence, 0.0), 6) AS confidence FROM (SELECT DISTINCT line_id FROM s) l LEFT JOIN x ON x.line_id = l.line_id""",
    "progress_rollup": f"WITH {PROGRESS}, {_ROLLUP} SELECT * FROM rollup",
    "visible_regions": f"WITH {PROGRESS}, {_ROLLUP} SELECT attempt_id, region_id FROM rollup WHERE state <> 'excluded'",
    "strict_rollup": f"""WITH {PROGRESS}, {_ROLLUP}, l AS (SELECT attempt_id, count(*) AS refused FROM (SELECT attempt_id FROM joined WHERE late UNION ALL SELECT attempt_id FROM marked WHERE seq > gone) GROUP BY attempt_id)
SELECT r.*, coalesce(refused, 0) AS refused FROM rollup r LEFT JOIN l USING (attempt_id)""",
    "replaced_regions": f"""WITH {PROGRESS}, changed AS (SELECT attempt_id, seq, CASE WHEN kind = 'excluded' THEN 'replaced' WHEN event_id % 97 = 0 THEN 'failed' ELSE kind END AS kind, CASE WHEN kind = 'excluded' THEN seq + 1000 ELSE region_id END AS region_id,
  CASE WHEN kind = 'excluded' THEN region_id END AS parent FROM progress), {_rollup('changed', "UNION ALL SELECT attempt_id, parent, seq FROM live WHERE kind = 'replaced'")} SELECT * FROM rollup""",
    "sequence_gaps": """WITH e AS (SELECT DISTINCT user_id AS attempt_id, event_id // 50 AS seq FROM events), g AS (SELECT attempt_id, coalesce(seq - lag(seq) OVER (PARTITION BY attempt_id ORDER BY seq), 1) <> 1 AS gap FROM e)
SELECT attempt_id, count(*) AS rows, CAST(sum(CASE WHEN gap THEN 1 ELSE 0 END) AS BIGINT) AS gaps FROM g GROUP BY attempt_id""",
    "numbering_fit": f"WITH RECURSIVE {PROGRESS}, {NUMBERED}, {_FIT}",
    "column_groups": f"WITH RECURSIVE {BOXES}, {_COLUMNS} SELECT page_id, {_GROUPS} FROM columns_groups",
    "row_groups": f"WITH RECURSIVE {BOXES}, {_ROWS} SELECT page_id, {_GROUPS} FROM rows_groups",
    "order_choice": f"""WITH RECURSIVE {BOXES}, {_COLUMNS}, {_ROWS},
c AS (SELECT page_id, count(*) AS n_columns, string_agg(array_to_string(members, ','), ',' ORDER BY group_no) AS a FROM columns_groups GROUP BY page_id), r AS (SELECT page_id, count(*) AS n_rows, string_agg(array_to_string(members, ','), ',' ORDER BY group_no) AS b FROM rows_groups GROUP BY page_id),
w AS (SELECT page_id, n_columns, n_rows, CASE WHEN page_id % 7 = 0 THEN 'held_numbers' WHEN a = b THEN 'same_traversal' WHEN n_columns = n_rows THEN 'equal_dimensions' WHEN abs(n_columns - n_rows) <= 1 THEN 'near_tie' ELSE 'longer_dimension' END AS reason FROM c JOIN r USING (page_id))
SELECT page_id, n_columns, n_rows, CASE WHEN reason = 'held_numbers' THEN 'numbers' WHEN reason = 'same_traversal' OR n_columns >= n_rows THEN 'columns' ELSE 'rows' END AS initial, reason IN ('equal_dimensions', 'near_tie') AS review, reason FROM w""",
    "redact_vocabulary": f"""WITH {VOCABULARY}, docs AS (SELECT row_number() OVER () AS id, doc_id, string_split(text, ' ') AS words FROM documents),
tokens AS (SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs), known AS (SELECT id, pos, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS island FROM tokens JOIN vocabulary USING (word)),
runs AS (SELECT id, min(pos) AS low, max(pos) AS high FROM known GROUP BY id, island HAVING count(*) >= 3),
struck AS (SELECT t.id, t.pos, CASE WHEN r.low IS NULL THEN t.word WHEN r.low = t.pos THEN '[redacted]' END AS word FROM tokens t LEFT JOIN runs r ON r.id = t.id AND t.pos BETWEEN r.low AND r.high)
SELECT any_value(doc_id) AS doc_id, (SELECT count(*) FROM runs WHERE runs.id = d.id) AS runs, md5(string_agg(s.word, ' ' ORDER BY s.pos)) AS redacted_md5 FROM docs d JOIN struck s USING (id) GROUP BY d.id""",
    "timing_rollup": "SELECT event_type, count(*) AS calls, round(sum(value), 2) AS ms FROM events GROUP BY event_type",
    "line_fits": f"""WITH {BOXES}, a AS (SELECT *, radians((l + t) % 180) AS a FROM boxes)
SELECT page_id, round(regr_slope(t, l), 4) AS slope, round(regr_intercept(t, l), 3) AS intercept, round(atan2(sum(sin(2 * a)), sum(cos(2 * a))) / 2, 4) AS axis FROM a GROUP BY page_id HAVING count(DISTINCT l) > 1""",
    "document_lines": f"""WITH {READS} SELECT page_id, string_agg(lpad(CAST(box_id + 1 AS VARCHAR), 2, ' ') || '. ' || rpad(upper(substr(literal, 1, 4)), 4, '-'), chr(10) ORDER BY box_id) AS document FROM reads WHERE literal <> '' GROUP BY page_id""",
    "identity_map": f"""WITH {LABELS} SELECT page_id, count(*) <> count(DISTINCT n) AS duplicate, max(n) > count(*) AS out_of_range, count(*) < max(n) AS incomplete FROM page_labels WHERE kind = 'exact' GROUP BY page_id""",
    "prefix_lookup": f"WITH {VOCABULARY} SELECT p.prefix, string_agg(word, ',' ORDER BY word) AS words FROM (SELECT DISTINCT substr(word, 1, 1) AS prefix FROM vocabulary) p JOIN vocabulary v ON starts_with(v.word, p.prefix) GROUP BY p.prefix",
    "page_axis": f"WITH {BOXES} SELECT page_id, box_id, area, lies FROM (SELECT *, (r - l) * (b - t) AS area, r - l >= b - t AS lies, row_number() OVER (PARTITION BY page_id ORDER BY (r - l) * (b - t) DESC, box_id) AS k FROM boxes) WHERE k = 1",
    "word_splits": f"""WITH {BOXES}, s AS (SELECT page_id, box_id, l, l + (r - l) / 8 AS r, b - t AS h FROM boxes),
i AS (SELECT *, max(r) OVER (PARTITION BY page_id ORDER BY l, r, box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
j AS (SELECT *, sum(CASE WHEN reach IS NULL OR l > reach THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY l, r, box_id) AS island FROM i),
m AS (SELECT page_id, island, min(l) AS l, max(r) AS r, max(h) AS h, count(*) AS parts FROM j GROUP BY ALL),
g AS (SELECT *, l - lag(r) OVER (PARTITION BY page_id ORDER BY island) AS gap FROM m),
c AS (SELECT page_id, greatest(1.1 * median(gap), 0.35 * max(h)) AS cut FROM g GROUP BY page_id),
w AS (SELECT g.*, sum(CASE WHEN gap IS NULL OR gap > cut THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY island) AS word_no FROM g JOIN c USING (page_id))
SELECT page_id, CAST(word_no AS BIGINT) AS word_no, min(l) AS l, max(r) AS r, CAST(sum(parts) AS BIGINT) AS parts FROM w GROUP BY page_id, word_no""",
    "column_owners": f"""WITH {BOXES}, f AS (SELECT page_id, CAST(floor(l / 300) AS BIGINT) AS column_no, min(l) AS low, max(r) AS widest FROM boxes GROUP BY ALL),
c AS (SELECT page_id, column_no, low, greatest(coalesce(least(lead(low) OVER (PARTITION BY page_id ORDER BY column_no), widest), widest * 1.2), low) AS high, lead(low) OVER (PARTITION BY page_id ORDER BY column_no) AS nxt, widest FROM f),
d AS (SELECT page_id, column_no, low, greatest(CASE WHEN nxt IS NULL THEN widest ELSE high END, low) AS high FROM c)
SELECT b.page_id, b.box_id, arg_max(d.column_no, d.low) AS column_no FROM boxes b LEFT JOIN d ON b.page_id = d.page_id AND (b.l + b.r) / 2 >= d.low AND (b.l + b.r) / 2 < d.high GROUP BY ALL""",
    "exclusion_reasons": f"""WITH {BOXES}, h AS (SELECT page_id, {_MEDIAN} AS h, min(l) AS first_l, count(*) AS n FROM boxes GROUP BY page_id)
SELECT page_id, box_id, CASE WHEN r - first_l < 130 AND n > 1 THEN 'label_gutter' WHEN r - l < h THEN 'standalone_label' WHEN b - t > 1.25 * h THEN 'outside_rows' END AS reason FROM boxes JOIN h USING (page_id)""",
    "cell_rows": f"""WITH {BOXES}, y AS (SELECT *, (t + b) / 2 AS y FROM boxes)
SELECT page_id, box_id, (y + lag(y) OVER o) / 2 AS upper, (y + lead(y) OVER o) / 2 AS lower FROM y WINDOW o AS (PARTITION BY page_id ORDER BY y, box_id)""",
    "completed_rows": f"""WITH {BOXES}, y AS (SELECT DISTINCT page_id, (t + b) / 2 AS y FROM boxes), s AS (SELECT *, y - lag(y) OVER (PARTITION BY page_id ORDER BY y) AS step FROM y),
p AS (SELECT page_id, median(step) AS pitch, min(y) AS top, max(y) AS bottom FROM s GROUP BY page_id HAVING median(step) > 0)
SELECT page_id, CAST(k AS INTEGER) AS row_no, top + k * pitch AS y FROM (SELECT *, unnest(range(0, CAST(round((bottom - top) / pitch) AS BIGINT) + 1)) AS k FROM p)""",
    "join_guards": f"""WITH {BOXES}, n AS (SELECT *, (t + b) / 2 AS y, lead(box_id) OVER o AS nid, lead(l) OVER o AS nl, lead(r) OVER o AS nr, lead(t) OVER o AS nt, lead(b) OVER o AS nb FROM boxes WINDOW o AS (PARTITION BY page_id ORDER BY l, box_id))
SELECT page_id, box_id AS left_id, nid AS right_id, CASE WHEN nt > y OR nb < y THEN 'row_structure' WHEN r - l < 100 OR nr - nl < 100 THEN 'label' WHEN nl - r > 2 * (b - t) THEN 'apart'
  WHEN ceil(greatest(r, nr) - l) * ceil(greatest(b, nb) - least(t, nt)) > 30000 THEN 'budget' ELSE 'candidate' END AS reason FROM n WHERE nid IS NOT NULL""",
    "cheapest_classes": f"""WITH {CELLS}, {_softmax('1.0')}, c AS (SELECT word_no, cell, CAST(sym AS INTEGER) AS sym, CAST(round(-ln((p + 0.001) / sum(p + 0.001) OVER (PARTITION BY word_no, cell)) * 1000) AS INTEGER) AS cost FROM dist)
SELECT word_no, cell, sym, cost FROM c QUALIFY cost = min(cost) OVER (PARTITION BY word_no, cell)""",
    "mark_fields": f"""WITH code AS (SELECT n AS number, {_ENCODED}[n + 1] AS code FROM range(16) r(n)), rev AS (SELECT b, list_sum(list_transform(range(8), lambda k: ((b >> k) & 1) << (7 - k))) AS r FROM range(256) t(b)),
l AS (SELECT DISTINCT CAST(l_partkey % 16 AS INTEGER) AS number, CAST(l_suppkey % 256 AS INTEGER) AS noise FROM lineitem),
sent AS (SELECT l.*, xor(xor(code, 6), noise & 34) AS byte FROM l JOIN code USING (number)),
near AS (SELECT s.noise, s.number, min(c.number) AS decoded FROM sent s JOIN code c ON bit_count(xor(xor(s.byte, 6), c.code)) <= 1 GROUP BY ALL)
SELECT s.number, s.noise, CAST(p.r + q.r * 256 AS INTEGER) AS field, CASE WHEN decoded IS NULL THEN 'damaged' ELSE 'number' END AS kind, CAST(decoded AS INTEGER) AS decoded
FROM sent s JOIN rev q ON q.b = s.byte JOIN rev p ON p.b = 80 LEFT JOIN near n ON n.noise = s.noise AND n.number = s.number""",
}
