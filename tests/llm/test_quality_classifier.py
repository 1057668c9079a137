import random
import zlib

import numpy as np

from quillet.llm.quality_classifier import score_quality


def corpus(n=300, seed=3):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        words = ["".join(draw.choice("abdehilnorst") for _ in range(draw.randint(2, 7))) for _ in range(60)]
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), 0 if bad else 1))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "src") for i, t, _ in rows] + [(None, None, None), (9000, "", "a"), (9000, "", "a")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = score_quality(docs, labels).collect()
    assert len(out) == len(rows) + 3
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)


def test_no_labels_and_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert {r.doc_id for r in score_quality(docs, labels).collect()} == {1, 2}
    assert score_quality(docs.limit(0), labels).collect() == []
