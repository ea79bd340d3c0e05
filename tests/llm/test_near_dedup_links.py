"""Near dedup of the pipeline links by fingerprints and by similarity, and chains of both."""

import corpus_pipeline
from wayframe.llm import simhash, similar


def words(a, b):
    return " ".join(f"w{k}" for k in range(a, b))


def test_fingerprints_link_in_the_pipeline(spark):
    base = words(0, 400)
    swapped = " ".join(f"w{k}" if k % 9 else f"x{k}" for k in range(400))  # not similar by whole shingles
    texts = {5: base, 6: base.replace("w7 ", "other "), 7: words(1000, 1400), 9: "AB cd", 8: "ab CD", 20: "", 21: None, 30: swapped}
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    by_bits = {r.doc_id: r.component_id for r in simhash.components(docs).collect()}
    by_shingles = {r.doc_id: r.component_id for r in similar.components(docs, similarity=corpus_pipeline.SIMILARITY).collect()}
    # the components that both kinds of links give together
    root = {k: k for k in texts}
    for _ in texts:
        for links in (by_bits, by_shingles):
            for k, c in links.items():
                root[k] = root[c] = min(root[k], root[c])
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == {k for k in texts if root[k] == k} and {5, 7, 8, 20} <= kept and not {6, 9, 21} & kept


def test_named_method_runs(spark, monkeypatch):
    seen, real = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **b: seen.append(1) or real(*a, **b))
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "q r s t u v w")], "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_copies(docs, similarity=0.8).collect()} == {1, 3} and seen


def test_a_text_that_only_fingerprints_link_is_dropped(spark, monkeypatch):
    real = simhash.fingerprints
    monkeypatch.setattr(simhash, "fingerprints", lambda d, *a: real(d, *a).selectExpr("doc_id", "CASE WHEN doc_id < 3 THEN doc_id ELSE fp END AS fp"))  # 1 and 2 differ in two bits
    docs = spark.createDataFrame([(1, words(0, 50)), (2, words(100, 150)), (3, words(200, 250))], "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_copies(docs, similarity=0.8).collect()} == {1, 3}
