"""Near copies by exact similarity against brute force, and the pipeline's stage."""

import random

import corpus_pipeline
from wayframe.llm import similar

WORDS = [f"word{k}" for k in range(3000)]


def brute_set(text, n=5):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[k : k + n]) for k in range(max(1, len(parts) - n + 1))} if parts else set()


def brute_similarity(a, b):
    a, b = brute_set(a), brute_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_components(rows, least=0.8):
    root = {k: k for k, _ in rows}
    find = lambda k: k if root[k] == k else find(root[k])
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if brute_similarity(x, y) >= least:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {k: find(k) for k, _ in rows}


def corpus(seed):
    rng = random.Random(seed)
    out, common = [None, "", "one two", "One  two", "five words in one line"], rng.choices(WORDS, k=12)
    for _ in range(12):
        base = rng.choices(WORDS, k=rng.choice([6, 20, 60, 200, 500])) + (common if rng.random() < 0.5 else [])
        out.append(" ".join(base))
        for _ in range(rng.randrange(8)):  # edits of the text before, so that chains arise
            edited = list(base)
            for _ in range(rng.randrange(1, 2 + len(base) // 40)):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            out.append(" ".join(edited))
            base = edited if rng.random() < 0.5 else base
    return list(enumerate(out))


def test_components_against_brute_force(spark):
    for seed in range(4):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        want = brute_components(rows)
        assert len(set(want.values())) < len(rows) - 5
        assert {r.doc_id: r.component_id for r in similar.components(docs).collect()} == want, seed


def test_group_of_many_copies_and_lone_sets(spark, monkeypatch):
    monkeypatch.setattr(similar, "SHARE", 7)  # sets are copied for their comparisons
    monkeypatch.setattr(similar, "BROADCAST_KEYS", 0)
    rng = random.Random(9)
    base, rows = rng.choices(WORDS, k=80), []
    for k in range(120):
        edited = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            edited[rng.randrange(80)] = rng.choice(WORDS)
        rows.append((k, " ".join(edited)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in similar.components(docs).collect()} == brute_components(rows)


def test_stage_drops_edited_copies(spark, data):
    base = [WORDS[k] for k in range(100)]
    edited = [*base[:30], "changed", *base[31:60], "here", *base[61:]]
    other = base[:50] + [WORDS[k + 200] for k in range(50)]
    texts = [" ".join(t) for t in (base, edited, other)]
    assert brute_similarity(texts[0], texts[1]) >= 0.8 > brute_similarity(texts[0], texts[2])
    docs = spark.createDataFrame([(3, texts[1], "a"), (2, texts[0], "b"), (4, texts[2], "c"), (None, texts[0], "d")], "doc_id long, text string, __gone string")
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, data)
    assert out.columns == docs.columns and sorted(r["__gone"] for r in out.collect()) == ["b", "c", "d"]
    assert similar.components(docs.limit(0)).count() == 0
