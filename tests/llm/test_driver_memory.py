"""The driver's JVM gives back freed memory between the rounds of a long row of small jobs."""

from wayframe.llm import common, simhash


def test_rounds_give_memory_back(spark, monkeypatch):
    seen, real = [], simhash.forget_driver
    monkeypatch.setattr(simhash, "forget_driver", lambda s: seen.append(real(s)))
    edges = [(1, 2), (2, 3), (9, 8)]
    got = {r.node: r.root for r in simhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert len(seen) >= 2 and len(set(seen)) == 1  # each round, with the same answer


def test_a_jvm_without_the_command_is_left_alone(spark, monkeypatch):
    monkeypatch.setattr(common, "TRIM", "noSuchCommand")
    assert common.forget_driver(spark) is False
    assert spark.range(3).count() == 3
