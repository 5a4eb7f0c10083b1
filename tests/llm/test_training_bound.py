"""The bound on training lines leaves out what does not fit, and nothing else."""

from heddle.llm import quality_crf as Q


def test_one_huge_labelled_document_does_not_empty_the_sample(spark, monkeypatch):
    monkeypatch.setattr(Q, "TRAINING_LINES", 300)
    held = {r.id for r in spark.range(80).select("id", Q.held_out("id").alias("h")).where("h").collect()}
    rows = [(i, ("A good line with several words in it.\n" if i % 2 else "zz 11 ## !!\n") * 4) for i in range(80)]
    # Whatever the order by hash, some huge documents come first.
    rows += [(i, "line of a huge document\n" * 301) for i in range(80, 120)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = Q.train(docs, labels)
    assert model is not None and held
    got = {r.id: r.score for r in Q.classify(docs.where("doc_id < 80"), model).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(80))
    assert Q.train(docs.where("doc_id >= 80"), labels) is None
