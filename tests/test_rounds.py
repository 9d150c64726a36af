"""Loops of joins send little through the driver."""

import pytest
from strandloom import session
from strandloom.operators import biconnected, graph

KEY = "spark.sql.autoBroadcastJoinThreshold"


def test_rounds_broadcast_little_and_leave_the_setting(spark, monkeypatch):
    before, seen = spark.conf.get(KEY), []

    def noted(module):
        settled = module.settled

        def run(df, name):
            seen.append((name, int(spark.conf.get(KEY).rstrip("b"))))
            return settled(df, name)

        monkeypatch.setattr(module, "settled", run)

    noted(graph)
    noted(biconnected)
    edges = spark.createDataFrame([(i, i + 1) for i in range(6)] + [(0, 3)], "source long, target long")
    # The tables that the rounds begin with may hang on the whole input; in those of the rounds nothing of over 1 MB is broadcast.
    assert {r.component for r in graph.connected_components(edges).collect()} == {0}
    assert seen[0][1] > 1 << 20 and len(seen) > 2 and all(size <= 1 << 20 for _, size in seen[2:])
    seen.clear()
    assert len(graph.lines(spark.createDataFrame([(i, i + 1) for i in range(5)], "source long, target long")).collect()) == 6
    assert seen[0][1] > 1 << 20 and len(seen) > 1 and all(size <= 1 << 20 for _, size in seen[1:])
    seen.clear()
    assert len({r.bcc for r in biconnected.biconnected_components(edges).collect()}) == 4
    assert all(size <= 1 << 20 for name, size in seen if name in ("level", "parents", "tour", "ranges", "block-links", "blocks"))
    assert spark.conf.get(KEY) == before and spark.conf.get(KEY, None) is None


def test_rounds_keep_a_lower_threshold(spark):
    spark.conf.set(KEY, "-1")
    try:
        with pytest.raises(ZeroDivisionError), session.rounds(spark):
            assert spark.conf.get(KEY) == "-1"
            raise ZeroDivisionError
        assert spark.conf.get(KEY) == "-1"
    finally:
        spark.conf.unset(KEY)
