import numpy as np

from quillet.llm.embedding_dedup import dedup
from quillet.llm.graph import components, stars


def brute(rows, threshold=0.93):
    """All pairs of equal label, and components by repeated relabelling."""
    good = {}
    for k, (vec_id, x, label) in enumerate(rows):
        ok = vec_id is not None and x and label is not None and all(v is not None and np.isfinite(v) for v in x) and any(x)
        if ok:
            good[k] = np.array(x, float) / np.linalg.norm(x)
    links = {k: [j for j in good if j != k and rows[j][2] == rows[k][2] and len(good[j]) == len(good[k]) and good[j] @ good[k] >= threshold] for k in good}
    comp = {k: rows[k][0] for k in good}
    changed = True
    while changed:
        changed = False
        for k in good:
            least = min([comp[k], *(comp[j] for j in links[k])])
            changed |= least != comp[k]
            comp[k] = least
    return sorted((-1 if r[0] is None else r[0], len(links.get(k, ())), -1 if r[0] is None else comp.get(k, r[0])) for k, r in enumerate(rows))


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(40):
        centre = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (centre + rng.standard_normal(16) * 0.18).tolist(), c % 3))
    centre = rng.standard_normal(16)
    rows += [(1000 + i, (centre + rng.standard_normal(16) * 0.15).tolist(), 1) for i in range(120)]
    rows += [(2000 + i, centre.tolist(), 1) for i in range(30)]  # copies
    rows += [(5, rows[5][1], rows[5][2]), (3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [None] + [1.0] * 15, 1), (3004, centre.tolist(), None), (None, centre.tolist(), 1), (3005, [], 1), (3006, centre.tolist()[:8], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, id string")
    out = dedup(df, tile=50).collect()
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id) for r in out)
    assert got == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)


def test_close_vectors_of_one_label(spark):
    """Vectors of mean cosine 0.85 in one label, where no pass brings every pair near each other."""
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = unit(np.sqrt(0.85) * unit(rng.standard_normal(64)) + np.sqrt(0.15) * unit(rng.standard_normal((5000, 64))))
    x[:300] = unit(x[300:600] + 0.3 * unit(rng.standard_normal((300, 64))))
    hit = x @ x.T >= 0.93
    n_links = hit.sum(axis=1) - 1
    least = np.arange(len(x))
    while True:
        new = np.where(hit, least, len(x)).min(axis=1)
        if (new == least).all():
            break
        least = new
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    out = sorted((r.vec_id, r.n_links, r.component_id) for r in dedup(df).collect())
    assert n_links.max() > 0 and out == list(zip(range(len(x)), n_links.tolist(), least.tolist()))


def test_empty(spark):
    assert dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 7), (200, 201), (201, 202), (5, 5), (300, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(31), 100]} | {i: 200 for i in (200, 201, 202, 300)}
    a, b = stars(np.array([3, 2, 9]), np.array([2, 1, 8]))
    assert dict(zip(a.tolist(), b.tolist())) == {3: 1, 2: 1, 9: 8}
