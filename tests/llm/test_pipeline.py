"""The corpus pipeline, stage by stage and as a whole."""

import corpus_pipeline
from tallyrow.llm import contamination, mixing, neardup, repeats


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir))
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == names and set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "quality_classifier":
            assert not [i for i in gone if i in labels and labels[i].quality == 1]
            bad = {i for i in before if i in labels and labels[i].quality == 0}
            assert len(bad & gone) >= 0.8 * len(bad)  # this small table has some dozen labelled rows
        elif name == "minhash_near_dedup":
            assert neardup.link_near_duplicates(docs).where("not kept").count() == 0
        elif name == "substring_dedup":
            assert not gone and repeats.repeat_report(docs).count() == len(before)
            assert all(r.n_chars == len(r.text) for r in after.values() if r.text != before[r.doc_id].text)
        else:
            items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert contamination.find_matches(docs, items).where("size(spans) > 0").count() == 0
    final = corpus_pipeline.mixing_stage(spark, docs, sf_dir)
    assert final.columns == [*names, "rate", "copies"]
    assert final.count() == docs.count() and final.where("copies < 1 or rate < 1 - 1e-9").count() == 0
    assert set(mixing.TARGETS) == {"de", "en", "es", "fr"}
