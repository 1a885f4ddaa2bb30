import hashlib


from oracle import DATA

import corpus_pipeline
from plumbline.llm import decontaminate, linededup, simhash, toxicity
from plumbline.plans.shared import materialize

SF = str(DATA / "sf0.01")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    expected = [
        lambda d: toxicity.score(d, toxicity.train(d, labels)).where("predicted = 0").count(),
        lambda d: d.count(),
        lambda d: simhash.near_duplicates(d).where("doc_id = component_id").count(),
        lambda d: decontaminate.contamination(d, bench).where("not contaminated").count(),
    ]
    for (name, stage), want in zip(corpus_pipeline.STAGES, expected, strict=False):
        out = materialize(stage(spark, docs, SF), name)
        assert out.columns == columns and out.count() == want(docs)
        if name == "line_dedup":
            assert linededup.remove_lines(docs).where("_n_removed > 0").count() > 0 and out.where("n_chars <> length(text)").count() == 0
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = last.collect()
    assert len(rows) == len(texts) and all(r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() for r in rows)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == set(texts)


def test_stages_on_edges(edges, empty, spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, edges, SF).count() <= edges.count()
        assert stage(spark, empty, SF).count() == 0


def test_short_boilerplate_lines_are_cut(spark, docs):
    rows = [(i, f"Read more\nown text of document {i}\n\nShare") for i in range(6)] + [(6, "Log in\nlast"), (7, "Log in\nvery last")]
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.cut_boilerplate_lines(spark, docs(rows), SF).collect()}
    assert out == {i: f"own text of document {i}\n" if 0 < i < 6 else t for i, t in rows}
