import random

import pytest

from pairloom.llm import components
from pairloom.llm.common import Workspace


@pytest.mark.parametrize("chunk", [1_000_000, 7])
def test_components_by_one_chunk_and_by_rounds(spark, monkeypatch, chunk):
    monkeypatch.setattr(components, "CHUNK", chunk)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 100 + rng.randrange(1, 40)) for _ in range(60)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    found = components.UnionFind()
    for a, b in edges:
        found.join(a, b)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = components.connected(Workspace(spark, "test"), df).collect()
    assert len(got) == len(nodes) and {r.node: r.root for r in got} == {x: found.root(x) for x in nodes}
    assert components.connected(Workspace(spark, "test"), df.limit(0)).count() == 0
