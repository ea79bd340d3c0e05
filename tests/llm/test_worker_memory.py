"""Python workers live on through the stages of a pipeline, and hold the model of one stage only."""

import pandas as pd

from wayframe.llm import langid, packing


def test_a_worker_keeps_one_model(spark):
    rows = [(k, f"the house number {k} and its old garden near the river", "en") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)

    def models(frames):
        import gc

        from wayframe.llm.langid import Model
        from wayframe.llm.packing import WordTokenizer

        for _ in frames:
            pass
        found = [type(o).__name__ for o in gc.get_objects() if isinstance(o, (Model, WordTokenizer))]
        yield pd.DataFrame({"found": [" ".join(found)]})

    held = lambda: {r.found for r in spark.range(0, 8, 1, 4).mapInPandas(models, "found string").collect()} - {""}
    for _ in range(2):
        assert langid.keep_known(docs, docs).count() == 40
        assert "Model" in held() <= {"Model", "WordTokenizer"}  # kept for the next task, and never both
        assert packing.pack(docs).count() == 40
        assert "WordTokenizer" in held() <= {"Model", "WordTokenizer"}


def test_nothing_large_is_sent_besides_the_model(spark):
    """What is broadcast stays in a worker beside the model that is made of it."""
    sent = []
    context, whole = spark.sparkContext, spark.sparkContext.broadcast
    context.broadcast = lambda value: (sent.append(value), whole(value))[1]
    try:
        langid.predictor(spark, [("en", 0, f"word{k}", k) for k in range(1000)])
    finally:
        context.broadcast = whole
    assert len(sent) == 1 and isinstance(sent[0], bytes) and len(sent[0]) < 20_000
