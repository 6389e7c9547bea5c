import numpy as np
import pytest
from tidemark.llm import vector_graph


def made(seed, n=700, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[: n // 3] = x[0] + 0.05 * rng.normal(size=(n // 3, d))  # a hot group
    for i in range(n // 3, n // 2):
        x[i] = x[rng.integers(0, n)] + 0.1 * rng.normal(size=d)
    x[n - 20:] = x[n - 40:n - 20]  # equal vectors
    return [(i, [float(v) for v in row], int(rng.integers(0, 2))) for i, row in enumerate(x)]


def brute(rows, least):
    links = {i: set() for i, _, _ in rows}
    for i, x, a in rows:
        for j, y, b in rows:
            if i != j and a == b:
                x_, y_ = np.array(x), np.array(y)
                if x_ @ y_ / np.sqrt((x_ @ x_) * (y_ @ y_)) >= least:
                    links[i].add(j)
    component = {i: i for i in links}
    while True:
        new = {i: min([component[i], *[component[j] for j in links[i]]]) for i in links}
        if new == component:
            return {i: len(s) for i, s in links.items()}, component
        component = new


@pytest.mark.parametrize("shard", [1500, 60])
def test_links_and_components(spark, monkeypatch, shard):
    monkeypatch.setattr(vector_graph, "SHARD", shard)
    rows = made(3)
    number, component = brute(rows, 0.93)
    found = vector_graph.link(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    got = {r["vec_id"]: r for r in found}
    assert len(found) == len(rows)
    assert sum(r["n_links"] for r in found) >= 0.95 * sum(number.values())
    assert all(got[i]["n_links"] <= number[i] for i in number)
    assert np.mean([got[i]["component_id"] == component[i] for i in number]) > 0.97
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    if shard == 1500:  # one shard a label: nothing may be missed here
        assert {i: got[i]["n_links"] for i in number} == number


def test_odd_rows(spark):
    good = [0.5, 0.5, 0.1]
    rows = [(1, good, 1, "x"), (2, good, 1, "x"), (2, good, 1, "x"), (3, None, 1, "x"), (4, [0.0, 0.0, 0.0], 1, "x"),
            (5, [1.0, None, 2.0], 1, "x"), (6, [float("nan"), 1.0, 1.0], 1, "x"), (7, [float("inf"), 1.0, 1.0], 1, "x"),
            (8, good, None, "x"), (None, good, 1, "x"), (9, [0.5, 0.5], 1, "x"), (10, [1.0, 1.0, 0.2], 1, "x"), (11, [], 1, "x"),
            (12, [1e200, 1e200, 2e199], 1, "x"), (13, good, 2, "x")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, node string")
    found = {}
    for r in vector_graph.link(frame).collect():
        found.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert found[1] == [(3, 1, True)] and found[2] == [(3, 1, False)] * 2 and found[10] == [(3, 1, False)]
    for i in (3, 4, 5, 6, 7, 8, 9, 11, 12, 13):
        assert found[i] == [(0, i, True)], i
    assert found[None] == [(0, None, False)]
    assert vector_graph.link(frame.where("false")).count() == 0


def test_audit_sees_missing_hits(spark):
    rows = made(5, 200)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    _, nodes = vector_graph.classes(frame)
    none = spark.createDataFrame([], "query bigint, node bigint")
    assert vector_graph.audit(nodes, none, 0.93) == 0.0


def test_pairs_beside_a_core_that_centres_do_not_part(spark, monkeypatch):
    """A core of nearly equal vectors takes no shard's pairs with it, neither its own label's nor another's."""
    monkeypatch.setattr(vector_graph, "SHARD", 40)
    monkeypatch.setattr(vector_graph, "CENTRES", 6)
    monkeypatch.setattr(vector_graph, "audit", lambda *_: 1.0)  # the first try alone
    rng = np.random.default_rng(11)
    core = rng.normal(size=16) + 1e-9 * rng.normal(size=(500, 16))
    loose = rng.normal(size=(40, 16))
    pairs = np.concatenate([loose, loose + 0.05 * rng.normal(size=loose.shape)])
    other = rng.normal(size=(300, 16))
    others = np.concatenate([other, other + 0.05 * rng.normal(size=other.shape)])
    x, labels = np.concatenate([core, pairs, others]), [0] * (len(core) + len(pairs)) + [1] * len(others)
    rows = [(i, [float(v) for v in row], a) for i, (row, a) in enumerate(zip(x, labels, strict=True))]
    number, component = brute(rows, 0.93)
    found = vector_graph.link(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert all(r["n_links"] <= number[r["vec_id"]] for r in found)
    lone = [r for r in found if r["vec_id"] >= len(core)]
    assert np.mean([r["n_links"] == number[r["vec_id"]] for r in lone]) > 0.97
    assert np.mean([r["component_id"] == component[r["vec_id"]] for r in lone]) > 0.97
    assert all(r["n_links"] == number[r["vec_id"]] for r in found if r["vec_id"] < len(core))


def test_windows_part_a_shard_without_a_core(spark, monkeypatch):
    """Where centres part nothing and nothing is dense, near vectors still share a shard."""
    monkeypatch.setattr(vector_graph, "SHARD", 40)
    monkeypatch.setattr(vector_graph, "STUCK", 0.0)
    rng = np.random.default_rng(13)
    x = rng.normal(size=(150, 8))
    x = np.concatenate([x, x + 1e-4 * rng.normal(size=x.shape)])
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    _, nodes = vector_graph.classes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    at = {}
    for r in vector_graph.shards(nodes, 2, 0.93).select("node", "cluster").collect():
        at.setdefault(r["node"], set()).add(r["cluster"])
    assert len(at) == len(x) and len(set.union(*at.values())) > 3
    assert all(at[i] & at[i + 150] for i in range(150))


def test_audit_counts_queries_and_not_only_pairs(spark):
    """A dense group's many pairs do not hide that all small groups are missing."""
    rng = np.random.default_rng(17)
    dense = rng.normal(size=16) + 1e-3 * rng.normal(size=(80, 16))
    small = rng.normal(size=(80, 16))
    x = np.concatenate([dense, small, small + 1e-3 * rng.normal(size=small.shape)])
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    _, nodes = vector_graph.classes(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    found = spark.createDataFrame([(i, j) for i in range(80) for j in range(80) if i != j], "query bigint, node bigint")
    assert vector_graph.audit(nodes, found, 0.93) < 0.5


def test_all_are_compared_when_no_try_is_good_enough(spark, monkeypatch):
    """A search that finds nothing at any width ends in the exact links."""
    monkeypatch.setattr(vector_graph, "SHARD", 60)
    none = "array<struct<node:bigint,copies:bigint>>"
    monkeypatch.setattr(vector_graph, "search", lambda sharded, *_: sharded.selectExpr(
        "node AS query", f"CAST(array() AS {none}) AS hits", "CAST(array() AS array<bigint>) AS frontier", "node AS root"))
    monkeypatch.setattr(vector_graph, "follow", lambda *_: None)
    rows = made(7, 300)
    # A chain, each vector in range of the next ones only, numbered out of order.
    for i, turn in enumerate(np.random.default_rng(19).permutation(20)):
        rows.append((300 + i, [float(np.cos(0.3 * turn)), float(np.sin(0.3 * turn))], 3))
    number, component = brute(rows, 0.93)
    assert component[319] == 300
    found = vector_graph.link(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: r["n_links"] for r in found} == number
    assert {r["vec_id"]: r["component_id"] for r in found} == component
