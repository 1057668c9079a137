"""Cases of the recognition operators, and each registered query against its SQL."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillet.functions import codes, strings
from quillet.operators import coding, layout, sequences
from quillet.plans import registry

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return round(v, 5) if math.isfinite(v) else str(v)
    return tuple(norm(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    out = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in out.description]
    want = sorted(repr([norm(v) for _, v in sorted(zip(names, row))]) for row in out.fetchall())
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(repr([norm(v) for _, v in sorted(zip(df.columns, row))]) for row in df.collect()) == want


@pytest.mark.parametrize(("read", "word", "d"), [("walk", "walk", 0), ("wolk", "walk", 1), ("wak", "walk", 1), ("alk", "walk", 2), ("ilk", "silk", 2), ("velvet", "helmet", 3), ("", "ab", 3), ("ab", "", 6)])
def test_weighted_distance(spark, read, word, d):
    row = spark.createDataFrame([(read, word)], "r string, w string").select(strings.weighted_distance(F.col("r"), F.col("w"))).first()
    assert row[0] == d


def test_labels(spark):
    cases = {"7.": ("exact", 7), " 3 ) ": ("exact", 3), "lO": ("shaped", None), "0.": (None, None), "123": (None, None), "st": (None, None), ".": (None, None)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: (r.x.kind, r.x.n) for r in df.select("t", strings.label_of(F.col("t")).alias("x")).collect()} == cases
    past = {"l.dice": "dice", "12 sunny": "sunny", "9EDIT": None, "7.": None}
    df = spark.createDataFrame([(k,) for k in past], "t string")
    assert {r.t: r.x for r in df.select("t", strings.past_label(F.col("t")).alias("x")).collect()} == past


def test_codewords(spark):
    df = spark.createDataFrame([("ABAN", "SSABAN"), ("ABST", "QSABST"), ("ZOO-", "SMZOO-")], "t string, want string")
    for r in df.select("want", codes.text_of(codes.codeword(codes.symbols(F.col("t")))).alias("got")).collect():
        assert r.got == r.want


def test_blocked_decode_equals_full_scan(spark):
    draw = random.Random(3)
    book = [(k, [draw.randrange(29) for _ in range(6)]) for k in range(60)]
    rows = []
    for k in range(200):
        code = list(draw.choice(book)[1])
        for _ in range(draw.randrange(4)):
            code[draw.randrange(6)] = draw.randrange(29)
        rows.append((k, code))
    got = {(r.row_id, r.word_id, r.d) for r in coding.nearby(spark.createDataFrame(rows, "row_id long, received array<bigint>"), spark.createDataFrame(book, "word_id int, code array<bigint>")).collect()}
    want = {(k, w, d) for k, c in rows for w, b in book if (d := sum(x != y for x, y in zip(c, b))) <= 2}
    assert got == want


def test_axis_groups_against_a_plain_loop(spark):
    draw = random.Random(4)
    rows = [(p, i, float(x := draw.randrange(400)), float(y := draw.randrange(300)), float(x + draw.randrange(20, 150)), float(y + 20)) for p in range(30) for i in range(draw.randrange(1, 12))]
    boxes = spark.createDataFrame(rows, "page_id long, box_id int, l double, t double, r double, b double")
    got = {(r.page_id, r.group_no): list(r.members) for r in layout.axis_groups(boxes).collect()}
    want = {}
    for p in range(30):
        groups = []
        for _, i, l, t, r, b in sorted((x for x in rows if x[0] == p), key=lambda x: (x[2], x[1])):
            for g in groups:
                if g[0] <= (l + r) / 2 <= g[1]:
                    g[0], g[1] = min(g[0], l), max(g[1], r)
                    g[2].append(((t + b) / 2, i))
                    break
            else:
                groups.append([l, r, [((t + b) / 2, i)]])
        for k, g in enumerate(sorted(groups, key=lambda g: (g[0], g[1], sorted(g[2])))):
            want[p, k] = [i for _, i in sorted(g[2])]
    assert got == want


def test_numbering_cases(spark):
    cases = [
        (["exact"] * 7, list(range(1, 8))), (["exact"] * 9, [1, 2, 3, 4, 5, 5, 7, 8, 9]), (["exact"] * 8, list(range(8, 0, -1))), (["exact"] * 8, [1, 2, 3, 4, 5, 6, 7, 60]),
        (["exact"] * 4 + ["shaped"] + ["exact"] * 4 + ["shaped", None], [1, 2, 3, 4, None, 6, 7, 8, 9, None, None]), (["exact"] * 6 + [None, None] + ["exact"] * 3, [1, 2, 3, 4, 5, 6, None, None, 8, 9, 10]),
        (["exact"] * 10 + ["shaped", None], [1, 2, 3, 9, 4, 5, 6, 7, 8, 10, None, None]),
    ]
    rows = [(p, k, kind, n) for p, (kinds, numbers) in enumerate(cases) for k, (kind, n) in enumerate(zip(kinds, numbers))]
    out = {r.page_id: r for r in sequences.fit_numbering(spark.createDataFrame(rows, "page_id long, pos int, kind string, n int")).collect()}
    assert [out[p].status for p in range(7)] == ["none", "inconsistent", "inconsistent", "inconsistent", "held", "held", "held"]
    assert [out[p].reason for p in range(4)] == [None, "duplicate", "out_of_order", "too_high"]
    assert (out[4]["count"], out[4].missing, out[4].out_of_place, out[4].unresolved) == (10, "", "", "")
    assert out[5].missing == "7"
    assert (out[6]["count"], out[6].out_of_place) == (11, "9")
    # the other traversal has fewer inversions
    turned = [(0, 9 - k, k, "exact", k + 1) for k in range(9)]
    assert sequences.fit_numbering(spark.createDataFrame(turned, "page_id long, pos int, row_pos int, kind string, n int")).first().status == "held"


def test_longest_rising_against_all_runs(spark):
    from itertools import combinations

    draw = random.Random(8)
    rows = [(k, draw.sample(range(1, 30), draw.randrange(1, 9))) for k in range(60)]
    out = spark.createDataFrame(rows, "k int, v array<int>").select("k", sequences.longest_rising(F.col("v")).alias("run")).collect()
    for r in out:
        v = rows[r.k][1]
        longest = max(n for n in range(1, len(v) + 1) for c in combinations(v, n) if list(c) == sorted(c))
        assert len(r.run) == longest and r.run == sorted(r.run) and [x for x in v if x in r.run] == r.run


def test_null_pages_are_kept(spark):
    boxes = spark.createDataFrame([(None, 0, 0.0, 0.0, 9.0, 9.0), (None, 1, 500.0, 0.0, 509.0, 9.0), (1, 0, 0.0, 0.0, 9.0, 9.0)], "page_id long, box_id int, l double, t double, r double, b double")
    assert layout.reach_components(boxes).count() == 3


def test_ctc(spark):
    steps = spark.createDataFrame([(1, 0, 1, 0.5), (1, 1, 1, 0.9), (1, 2, 0, 0.9), (1, 3, 2, 0.9), (1, 4, 2, 0.2), (2, 0, 0, 0.3)], "line_id long, t int, best int, p double")
    got = {r.line_id: (r.symbols, round(r.confidence, 6)) for r in sequences.ctc_collapse(steps).collect()}
    assert got == {1: ("1-2", 0.7), 2: ("", 0.0)}


def test_input_order_does_not_matter(spark):
    boxes = registry.ad.boxes(spark, SF)
    a = sorted(map(repr, layout.axis_groups(boxes).collect()))
    assert a == sorted(map(repr, layout.axis_groups(boxes.orderBy(F.desc("b"))).collect()))


def test_marks_mend_one_error():
    from quillet.functions import marks

    for n in range(16):
        assert marks.decoded(marks.encoded(n)) == n
        for k in range(8):
            assert marks.decoded(marks.encoded(n) ^ 1 << k) == n
            for j in range(k):
                assert marks.decoded(marks.encoded(n) ^ 1 << k ^ 1 << j) is None


def test_geometry(spark):
    import numpy as np

    from quillet.functions import geometry

    h = geometry.homography([(0, 0), (10, 0), (10, 10), (0, 10)], [(1, 1), (21, 3), (19, 22), (0, 20)])
    row = spark.createDataFrame([(10.0, 0.0)], "x double, y double").select(geometry.mapped(F.col("x"), F.col("y"), h).alias("m")).first().m
    assert np.allclose([row.x, row.y], [21, 3])
    quad = lambda x, y: [(x, y), (x + 4.0, y), (x + 4.0, y + 4.0), (x, y + 4.0)]
    df = spark.createDataFrame([(quad(0.0, 0.0), quad(3.0, 3.0)), (quad(0.0, 0.0), quad(4.0, 0.0))], "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    assert [r.m for r in df.select(geometry.quads_meet(F.col("a"), F.col("b")).alias("m")).collect()] == [True, False]
    got = df.select(geometry.inside_polygon(F.lit(1.0), F.lit(1.0), F.col("a")).alias("p"), geometry.inside_polygon(F.lit(9.0), F.lit(1.0), F.col("a")).alias("q")).first()
    assert (got.p, got.q) == (True, False)
    mixed = df.select(geometry.clockwise(F.reverse("a")).alias("c")).first().c
    assert [(c.x, c.y) for c in mixed] == quad(0.0, 0.0)


def test_hull_and_rectangle_against_plain_loops(spark):
    import numpy as np

    from quillet.functions import geometry

    draw = random.Random(5)
    clouds = [[(float(draw.randrange(20)), float(draw.randrange(20))) for _ in range(draw.randrange(3, 14))] for _ in range(40)] + [[(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)]]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(clouds)], "k int, p array<struct<x:double,y:double>>").withColumn("h", geometry.convex_hull(F.col("p")))
    for r in df.withColumn("m", geometry.minimal_rectangle(F.col("h"))).withColumn("d", geometry.outside_distance(F.lit(40.0), F.lit(10.0), F.col("h"))).collect():
        points = sorted(set(clouds[r.k]))
        cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        corners = [p for p in points if any(all(cross(p, q, z) > 0 or z in (p, q) or cross(p, q, z) == 0 and (z[0] - p[0]) * (z[0] - q[0]) + (z[1] - p[1]) * (z[1] - q[1]) <= 0 for z in points) for q in points if q != p)]
        got = [(c.x, c.y) for c in r.h]
        if all(cross(points[0], points[-1], z) == 0 for z in points):
            continue
        assert sorted(got) == sorted(corners) and got[0] == points[0]
        best = min((np.ptp(a) * np.ptp(b), 0) for p, q in zip(got, got[1:] + got[:1]) for u in [np.subtract(q, p) / np.hypot(*np.subtract(q, p))] for a, b in [(np.array(got) @ u, np.array(got) @ np.array([-u[1], u[0]]))])[0]
        assert abs(r.m.area - best) < 1e-6
        assert r.d > 15
    ring = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)],)], "p array<struct<x:double,y:double>>").select(geometry.unclipped(F.col("p"), F.lit(1.0)).alias("u")).first().u
    assert len(ring) == 64 and max(c.x for c in ring) == 5.0 and min(c.y for c in ring) == -1.0
    h = geometry.homography([(0, 0), (10, 0), (10, 10), (0, 10)], [(1, 1), (21, 3), (19, 22), (0, 20)])
    assert np.allclose(geometry.composed(h, geometry.inverse(h)), np.eye(3), atol=1e-9)


def test_line_fits_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Lines whose slope or intercept lies halfway between two figures, and directions that cancel, in every order of their boxes."""
    import itertools
    from fractions import Fraction

    # (l_partkey, l_suppkey, l_linenumber)
    pages = [
        [(19522, 706, 3), (9139, 770, 2), (4639, 530, 2)], [(6242, 981, 6), (15719, 389, 2), (2744, 461, 1), (1025, 17, 2), (2933, 957, 1)],
        [(11657, 545, 1), (9332, 953, 7), (16928, 441, 3)], [(13371, 245, 2), (14160, 788, 6), (5698, 852, 4), (8736, 550, 7)],
    ]
    rows, want = [], {}
    for p, page in enumerate(pages):
        x, y = [k % 3 * 300 + s % 40 for k, s, _ in page], [n * 60 + k % 17 for k, _, n in page]
        n, sx, sy, sxx, sxy = len(page), sum(x), sum(y), sum(a * a for a in x), sum(a * b for a, b in zip(x, y))
        fit = Fraction(n * sxy - sx * sy, n * sxx - sx * sx) * 10**4, Fraction(sy * sxx - sx * sxy, n * sxx - sx * sx) * 10**3
        halves_up = [(-1) ** (v < 0) * int(abs(v) + Fraction(1, 2)) for v in fit]
        want[p] = (halves_up[0] / 10**4, halves_up[1] / 10**3)
        for i, order in enumerate(itertools.permutations(page)):
            rows += [(p * 1000 + i, *box, 1.0) for box in order]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    for c in "l_extendedprice l_discount l_tax l_shipdate l_returnflag l_linestatus".split():
        lines = lines.withColumn(c, F.lit(0.0))
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["line_fits"](spark, str(tmp_path)).collect()
    assert {(r.page_id // 1000, r.slope, r.intercept) for r in got} == {(p, *fit) for p, fit in want.items()}
    assert len({(r.page_id // 1000, r.axis) for r in got}) == len(pages) and len(got) == 6 + 120 + 6 + 24
