import corpus_pipeline
from quillet.session import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    """Each stage on its predecessor's rows, held against the operator's own report."""
    from quillet.llm import decontaminate, jaccard_join, line_dedup, quality_classifier

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "mixture"]
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, before, SF), f"test_{name}")
        ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
        if name != "mixture":
            assert docs.columns == columns
        if name == "quality":
            score = quality_classifier.score_quality(before, table(spark, SF, "labels"))
            assert ids == sorted(r.doc_id for r in score.where("predicted = 1").collect())
        elif name == "lines":
            cut = {r.doc_id: r.text for r in line_dedup.drop_templates(before).collect() if not (r.n_dropped and not r.text.strip())}
            assert {r.doc_id: r.text for r in docs.collect()} == cut
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "near_duplicates":
            groups = jaccard_join.join(before).collect()
            assert ids == sorted(r.doc_id for r in groups if r.doc_id == r.component_id)
        elif name == "decontamination":
            leaks = decontaminate.find_leaks(before, table(spark, SF, "benchmark")).collect()
            assert ids == sorted(r.doc_id for r in leaks if not r.contaminated)
        kept[name] = ids
    assert kept["mixture"] == kept["decontamination"] and 0 < len(kept["mixture"]) < table(spark, SF, "documents").count()
