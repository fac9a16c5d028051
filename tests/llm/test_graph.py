import random

import pytest

import fleetgauge.llm.graph as graph


def plain(edges):
    label = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


@pytest.mark.parametrize("a_task", [1_000_000, 40])
def test_components(spark, monkeypatch, a_task):
    """Chains, a hub, loops, repeated and reversed edges, in one task and in several."""
    monkeypatch.setattr(graph, "EDGES_A_TASK", a_task)
    chance = random.Random(3)
    chain = [(k, k + 1) for k in range(-20, 40)]
    hub = [(1000, 1001 + k) for k in range(50)]
    loose = [(chance.randrange(2000, 2100), chance.randrange(2000, 2100)) for _ in range(45)]
    edges = chain + hub + loose + [(7, 7), (5000, 5000), (3, 2), (3, 2), (-(2**63), 2**63 - 1)]
    chance.shuffle(edges)
    given = spark.createDataFrame(edges, "a long, b long").repartition(5)
    found = [tuple(r) for r in graph.components(given).select("node", "component").collect()]
    assert len(found) == len(set(found))
    assert dict(found) == plain(edges)


def test_components_without_edges(spark):
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
