import random

import numpy as np

from quillet.llm.toxicity import WordFacts, features, isotonic, score_toxicity


def test_isotonic_matches_brute_force():
    rng = np.random.default_rng(0)
    x, y, w = np.arange(40.0), rng.integers(0, 2, 40).astype(float), rng.random(40) + 0.1
    at, p = isotonic(x, y, w)
    fit = np.interp(x, at, p)
    assert (np.diff(fit) >= -1e-12).all()
    # min-max formula of isotonic regression at block level
    brute = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert set(np.round(p, 9)) == set(np.round(brute, 9))


def test_features_see_obfuscation_and_pronouns():
    facts = WordFacts({})
    assert features("you 1d10t", facts)[4] == 1 and features("you 1d10t", facts)[7] > 0
    assert features("", facts) == [0.0] * len(features("a", facts))


def test_held_out_accuracy_and_edges(spark):
    draw, rows = random.Random(5), []
    for i in range(500):
        words = ["".join(draw.choice("abdehilnorst") for _ in range(draw.randint(3, 7))) for _ in range(40)]
        if i % 4 == 0:
            words[draw.randrange(40)] = "zorgle"
            words[draw.randrange(40)] = "you zorgle"
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t, "src") for i, t, _ in rows] + [(None, None, None), (9000, "", "a"), (9000, "", "a")], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = score_toxicity(docs, labels).collect()
    assert len(out) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    truth = {i: y for i, _, y in rows}
    assert np.mean([r.predicted == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth]) > 0.95
    none = score_toxicity(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert score_toxicity(docs.limit(0), labels).collect() == []
