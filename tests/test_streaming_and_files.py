import json
import random

import pytest

from quillet.sources import files
from quillet.streaming.reducer import reduce_all, reduce_progress

EVENTS = [(1, 1, "found", 0), (1, 2, "found", 1), (1, 3, "reading", 0), (1, 4, "excluded", 1), (1, 5, "removed", 0), (1, 6, "completed", None), (1, 7, "found", 5), (2, 1, "found", 3), (2, 3, "reading", 3), (3, 2, "found", 9)]


@pytest.mark.parametrize("strict", [False, True])
def test_stream_equals_batch_twin(spark, tmp_path, strict):
    rows = list(EVENTS)
    random.Random(1).shuffle(rows)
    for k in range(0, len(rows), 3):
        (tmp_path / f"in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.json").write_text("\n".join(json.dumps(dict(zip(("attempt_id", "seq", "kind", "region_id"), r))) for r in rows[k : k + 3]))
    stream = spark.readStream.schema("attempt_id long, seq long, kind string, region_id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    seen = {}

    def sink(batch, _):
        got = {}
        for r in batch.collect():
            got.setdefault(r.attempt_id, {})[r.region_id] = (r.state, r.seq)
        seen.update(got)

    q = reduce_progress(stream, strict).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    for attempt in (1, 2):
        twin = reduce_all([r[1:] for r in EVENTS if r[0] == attempt], strict)
        assert seen[attempt] == {k: tuple(v) for k, v in twin.regions.items()}
    assert 3 not in seen  # its first event never came
    assert reduce_all([r[1:] for r in EVENTS if r[0] == 1], True).error == "event 7 after the end"


def test_files(spark, tmp_path):
    (tmp_path / "a.calibration").write_text("t=1.95\nmin_prob=0.1\nmin_prob=0.3\n# note\n")
    assert {(r.key, r.value) for r in files.artifact(spark, str(tmp_path / "a.calibration")).collect()} == {("t", "1.95"), ("min_prob", "0.3")}
    (tmp_path / "dict.txt").write_text("a\nb\n")
    assert sorted((r.class_id, r.text) for r in files.dictionary(spark, str(tmp_path / "dict.txt")).collect()) == [(0, ""), (1, "a"), (2, "b"), (3, " ")]
    texts = spark.createDataFrame([(1, " 1. ss aban\n\n2) qsabst\nbad")], "share_id int, text string")
    assert [(r.word_pos, r.symbols) for r in files.shares_from_text(texts, "=#ABCDEFGHIJKLMNOPQRSTUVWXYZ-").orderBy("word_pos").collect()] == [(0, "SSABAN"), (1, "QSABST"), (2, None)]
    phrases = spark.createDataFrame([(1, " red  Blue "), (2, "red green blue")], "text_id int, text string")
    words = spark.createDataFrame([(0, "blue"), (1, "red")], "word_id int, word string")
    assert sorted((r.text_id, r.n_words, r.first_unknown) for r in files.parse_phrase(phrases, words).collect()) == [(1, 2, None), (2, 3, 1)]
    maps = spark.createDataFrame([(2, 1, [0.0, 1.0]), (2, 1, [0.0]), (1, 1, [1.5])], "w int, h int, data array<double>")
    assert files.probability_maps(maps).count() == 1
    boxes = spark.createDataFrame([(1, 0, 0.0, 1.0, 2.0, 3.0)], "page_id long, box_id int, l double, t double, r double, b double")
    assert json.loads(files.final_boxes(boxes).first().body)["boxes"][0]["quad"] == [0, 1, 2, 1, 2, 3, 0, 3]
    files.write_documents(boxes, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_documents(boxes, str(tmp_path / "out"))
    assert [r.x for r in spark.createDataFrame([(1.5,), (float("-inf"),), (float("nan"),)], "v double").select(files.tagged("v").alias("x")).collect()] == ["1.5", "-inf", "nan"]
    (tmp_path / "p.png").write_bytes(b"x" * 10)
    assert [r.n_bytes for r in files.images(spark, str(tmp_path)).select("n_bytes").collect()] == [10]
    assert files.admitted_pixels(spark.createDataFrame([(40000, 1000), (40001, 1000), (0, 5)], "width int, height int")).count() == 1
