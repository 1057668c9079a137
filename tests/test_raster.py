import random

import numpy as np

from quillet.operators import raster


def crops(spark, seed=1):
    draw = random.Random(seed)
    rows = [(c, y, x, draw.choice((10, 20, 30)) if draw.random() < 0.3 else draw.choice((200, 230, 250))) for c in range(4) for y in range(12) for x in range(15)]
    return rows, spark.createDataFrame(rows, "crop_id long, y int, x int, v int")


def test_thresholds_against_numpy(spark):
    rows, df = crops(spark)
    otsu = {r.crop_id: r.threshold for r in raster.otsu(df).collect()}
    light = {r.crop_id: (r.median, r.p95) for r in raster.paper_and_white(df).collect()}
    for c in range(4):
        v = np.array([r[3] for r in rows if r[0] == c])
        best = max(sorted(set(v))[:-1], key=lambda t: ((v <= t).sum() * (v > t).sum() * (v[v <= t].mean() - v[v > t].mean()) ** 2, -t))
        assert otsu[c] == best
        s = np.sort(v)
        assert light[c] == (s[int(np.ceil(0.5 * len(v))) - 1], s[int(np.ceil(0.95 * len(v))) - 1])


def test_components_runs_and_means(spark):
    rows, df = crops(spark, 2)
    dark = raster.ink(df, raster.otsu(df))
    found = {}
    for r in raster.label_components(dark).collect():
        found.setdefault(r.crop_id, []).append((r.x0, r.y0, r.x1, r.y1, r.pixels))
    for c in range(4):
        left = {(r.y, r.x) for r in dark.where(f"crop_id = {c}").collect()}
        want = []
        n = len(left)
        assert sum(r.x1 - r.x0 for r in raster.runs(dark).where(f"crop_id = {c}").collect()) == n
        while left:
            stack, own = [left.pop()], []
            while stack:
                y, x = stack.pop()
                own.append((y, x))
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                stack += near
            ys, xs = zip(*own)
            want.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(own)))
        assert sorted(found.get(c, [])) == sorted(want)
    means = {(r.crop_id, r.y, r.x): r.mean for r in raster.local_mean(df, 2).collect()}
    grid = {(c, y, x): v for c, y, x, v in rows}
    for (c, y, x), m in random.Random(0).sample(sorted(means.items()), 40):
        assert abs(m - np.mean([grid[c, a, b] for a in range(max(0, y - 2), min(12, y + 3)) for b in range(max(0, x - 2), min(15, x + 3))])) < 1e-9


def test_peaks(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (1, 1.0, 0.0, 6.0), (1, 5.0, 5.0, 1.0), (2, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 1.0)], "page_id long, x double, y double, score double")
    assert sorted(map(tuple, raster.suppressed_peaks(df, 2.0).collect())) == [(1, 1.0, 0.0, 6.0), (1, 5.0, 5.0, 1.0), (2, 0.0, 0.0, 1.0)]
