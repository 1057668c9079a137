import random

import pytest
from quillet.llm.jaccard_join import join, keep_one


def brute(rows, threshold=75, shingle=5):
    sets = []
    for i, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets.append({tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set())
    comp = {i: i for i, _ in rows if i is not None}
    pairs = [(rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a) if None not in (rows[a][0], rows[b][0]) and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(comp[a], comp[b])
            changed |= comp[a] != comp[b]
            comp[a] = comp[b] = least
    return sorted((-1 if i is None else i, len(s), comp.get(i, -1)) for (i, _), s in zip(rows, sets))


def corpus(seed, n=150):
    draw = random.Random(seed)
    word = lambda: f"w{draw.randrange(3000)}É" if draw.random() < 0.7 else draw.choice(["The", "of", "a"])
    base = [[word() for _ in range(draw.choice((3, 5, 9, 40, 120)))] for _ in range(25)]
    passage = [word() for _ in range(50)]
    rows = []
    for i in range(n):
        own = list(draw.choice(base)) if draw.random() < 0.8 else [word() for _ in range(30)]
        for _ in range(draw.choice((0, 0, 1, 1, 2, 3, 5))):
            own[draw.randrange(len(own))] = word()
        if draw.random() < 0.2:
            own += passage
        rows.append((i, " ".join(own)))
    rows += [(4, rows[4][1]), (900, None), (901, ""), (902, " \t"), (None, rows[5][1]), (903, "one"), (904, "ONE"), (905, "one two three four"), (906, "one two three four"), (907, "a b c d e " * 3000), (908, "a b c d e " * 9)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id int, tokens string")
    out = join(df, group=4, block_bytes=3000, part_hashes=200).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in out) == brute(rows)


def test_empty(spark):
    assert join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_row_of_each_group_is_kept(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (1, text(1)), (2, text(1)), (3, text(3)), (3, text(3) + " more"), (None, text(5)), (None, text(5)), (None, text(5) + " more"), (None, text(3)), (7, text(7)), (8, ""), (8, ""), (None, None), (2, " ")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string")
    kept = keep_one(df)
    assert kept.columns == df.columns
    out = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted((-1 if i is None else i, (t or "").split(" ")[0]) for i, t in out) == sorted([(1, "w1x0"), (3, "w3x0"), (-1, "w5x0"), (7, "w7x0"), (8, ""), (8, ""), (-1, ""), (2, "")])
    assert sorted(map(str, out)) == sorted(map(str, ((r.doc_id, r.text) for r in keep_one(df.repartition(3)).collect())))


def test_a_large_group_of_near_copies(spark):
    """5,000 near copies of one text, of which not all link to the original, against a count of all overlaps."""
    import numpy as np

    draw = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(5000):
        own = list(base)
        for _ in range(draw.choice((0, 1, 1, 2, 3))):
            own[draw.randrange(60)] = f"x{draw.randrange(40)}" if draw.random() < 0.3 else f"y{i}"
        rows.append((i, " ".join(own)))
    sets = [{hash(tuple(t.split()[k : k + 5])) for k in range(56)} for _, t in rows]
    holders: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    postings = {x: np.array(h) for x, h in holders.items()}
    sizes = np.array([len(s) for s in sets])
    comp = np.arange(len(sets))
    links = [np.flatnonzero(100 * (both := np.bincount(np.concatenate([postings[x] for x in s]), minlength=len(sets))) >= 75 * (len(s) + sizes - both)) for s in sets]
    while True:
        least = np.array([comp[k].min() for k in links])
        if (least == comp).all():
            break
        comp = least
    assert 1 < len(set(comp.tolist())) < 4000
    out = join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == list(enumerate(comp.tolist()))
