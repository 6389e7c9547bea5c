import random

import pytest
from tidemark.llm.components import components


@pytest.mark.parametrize("kind", ["random", "path", "star", "empty"])
def test_smallest_reachable(spark, kind):
    rng = random.Random(2)
    edges = {"random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)],
             "path": [(i, i + 1) for i in range(120)], "star": [(7, i) for i in range(100)], "empty": []}[kind]
    component = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and component[a] != component[b]:
                component[a] = component[b] = min(component[a], component[b])
                changed = True
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["node"]: r["component"] for r in found} == component
