import random

from quillet.llm.substring_dedup import dedup


def brute(rows, window=13):
    """Every window of every document against the windows that start in documents of smaller id."""
    ids = lambda i: float("inf") if i is None else i
    first = {}
    for i, text in rows:
        w = (text or "").encode().split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, float("inf")), ids(i))
    out = []
    for i, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < ids(i):
                gone[k : k + window] = [True] * window
        out.append((-1 if i is None else i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out)


def corpus(seed, n=120):
    draw = random.Random(seed)
    word = lambda: draw.choice(["the", "of", "a"]) if draw.random() < 0.5 else f"w{draw.randrange(400)}é"
    passages = [" ".join(word() for _ in range(draw.choice((12, 13, 14, 60)))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(draw.randrange(5)):
            parts.append(draw.choice(passages) if draw.random() < 0.5 else " ".join(word() for _ in range(draw.randrange(40))))
        rows.append((i, "\n".join(parts)))
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (7000, None), (7001, ""), (-5, rows[9][1]), (8000, "the " * 4000), (8001, "the " * 30)]
    draw.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block int, blob string")
        out = dedup(df, block_bytes=2000, part_hashes=50).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out) == brute(rows)


def test_empty(spark):
    assert dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert [tuple(r) for r in dedup(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()] == [(None, 0, 0, "")]
