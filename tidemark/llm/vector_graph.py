"""Near-duplicate embeddings by a flat graph with robust pruning.

Only vectors of one label (and length) are compared. Equal vectors are one class from the start.

Shards: centres of each label are fitted on a bounded sample (SAMPLE vectors of a label or of a shard
that is still too large), and every class goes to its OVERLAP nearest centres, so shards overlap.
A shard that its own centres leave more than STUCK of is parted by a ball around its dense core
instead (the core's pieces are dealt by hash, the rest goes on by centres), or by overlapping
windows along its widest directions if it has no such core.

Build: in each shard the nearest candidates of a vector are pruned robustly (a candidate is dropped
if one that was kept is nearer to it by the factor ALPHA), edges are taken both ways and pruned
again, and whatever the medoid does not reach is tied in. Adjacency lists of a vector are united
over its shards; edges keep their cosine.

Search: every class is a query. In each of its shards a greedy search with a beam starts at the
medoid, and a query that it does not bring to its own vector goes on from there; around all that is in
range the search goes on until nothing in range is left. A neighbour is
followed only if the angles allow it to be in range. Neighbours that lie in other shards go on in
rounds over the whole graph (joins of written tables), until none is left.

All links are cosines in double precision of the vectors themselves. An audit compares AUDIT queries
(by hash) with all rows by brute force, by pairs and by query, so that one dense group cannot hide
what small groups lack. Below LEAST_RECALL all is done again with more overlap and a wider beam; if
the last try is below it too, all vectors of a label are compared in blocks.

Nulls: a null label, vector or id, a zero vector, or one with null or non-finite numbers is linked
with nothing; it is its own component. Repeated rows count as vectors of their own. Empty tables give
empty results. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import staging
from tidemark.llm.components import components

SHARD = 1500
SAMPLE = 8192
CENTRES = 64
OVERLAP = 2
MOST_OVERLAP = 8
CANDIDATES = 64
DEGREE = 24
ALPHA = 1.2
STUCK = 0.8
BEAM = 32
AUDIT = 256
LEAST_RECALL = 0.9
_PAIRS = 1 << 19


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their class, classes): a class is the smallest id of equal vectors of a label."""
    columns = staging.plain(vectors, {"vec_id": "bigint", "embedding": "array<double>", "label": "string"})
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & (norm > 0)
                        & (norm < float("inf")), F.lit(False))
    keyed = staging.stage(columns.withColumn("usable", usable).withColumn(
        "key", F.when(F.col("usable"), F.sha2(F.concat_ws("|", "label", F.to_json("embedding")), 256))))
    grouped = staging.stage(keyed.where("usable").groupBy("key").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies"),
        F.first(F.concat_ws("|", "label", F.size("embedding"))).alias("cluster"), F.first("embedding").alias("vector")))
    rows = keyed.select("vec_id", "key").join(grouped.select("key", "node", "copies"), "key", "left")
    return staging.stage(rows.select("vec_id", "node", "copies")), grouped.drop("key")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)  # no overflow for very long vectors
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


_PLAN = "cluster string, centres array<array<double>>, radius double, cuts array<array<double>>"


def _wide(x: np.ndarray, node: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Places along directions; equal ones are parted by a hash of the node."""
    mixed = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
    return x @ directions.T + (mixed / 2.0**53 * 1e-9)[:, None]


def _core(x: np.ndarray, reach: float) -> tuple[np.ndarray, float] | None:
    """(centre, radius) of a ball that holds a fifth or more and whose vectors are all in range of each other."""
    asked = x[np.random.default_rng(7).choice(len(x), min(len(x), 64), replace=False)]
    chord = 2 * math.sin(reach / 4)  # of half the reach
    apart = np.sqrt(np.maximum(2 - 2 * asked @ x.T, 0))
    near = apart <= chord
    best = int(near.sum(1).argmax())
    if near[best].sum() < len(x) / 5:
        return None
    # As narrow as most of them allow; no narrower than rounding.
    return asked[best], max(float(np.quantile(apart[best][near[best]], 0.95)) * 1.000001, 1e-7)


def _plans(sample: DataFrame, overlap: int, least: float) -> DataFrame:
    """How each cluster is parted, by its sample; the column `number` says how many centres.

    Spherical k-means. If its largest part kept over four fifths of the cluster: by a ball (one
    centre, a radius), or, if no ball holds a fifth, by windows along directions (`cuts`).
    """
    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        x = unit(matrix(table["vector"]))
        k = min(int(table["number"][0].as_py()), len(x))
        rng = np.random.default_rng(5)
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            near = (x @ centres.T).argmax(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            empty = np.abs(sums).sum(1) == 0
            sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
            centres = unit(sums + 1e-12)
        own = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :overlap]
        radius, cuts = None, None
        if np.bincount(own.ravel()).max() > STUCK * len(x):
            core = _core(x, math.acos(least))
            if core is not None:
                centres, radius = core[0][None], core[1]
            else:
                _, _, turned = np.linalg.svd(x - x.mean(0), full_matrices=False)
                centres = turned[:overlap]
                halves = max(3, math.ceil(table["n"][0].as_py() / (SHARD / 2)))
                places = _wide(x, table["node"].to_numpy(), centres)
                cuts = np.quantile(places, np.arange(1, halves) / halves, axis=0).T.tolist()
        return pa.table({"cluster": pa.array([table["cluster"][0].as_py()], pa.string()),
                         "centres": pa.array([centres.tolist()], pa.list_(pa.list_(pa.float64()))),
                         "radius": pa.array([radius], pa.float64()),
                         "cuts": pa.array([cuts], pa.list_(pa.list_(pa.float64())))})

    return sample.groupBy("cluster").applyInArrow(fit, _schema(_PLAN))


def shards(nodes: DataFrame, overlap: int, least: float) -> DataFrame:
    """(node, vector, copies, cluster): each class in its overlapping shards.

    A ball's core and all that can be in range of it are dealt out by hash: core vectors are in
    range of each other, so any piece leads to all of them. Everything outside the core is parted
    further, so two vectors in range are both in the one or both in the other. Windows overlap by
    half: vectors that are at most half a window apart along a direction share one.
    """
    schema = staging.fields(node="bigint", copies="bigint", cluster="string", vector="array<double>")
    reach = math.acos(least)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.array(batch.column(2).to_pylist(), object)
            rows, found = [], []
            for name in sorted(set(names)):
                own = np.flatnonzero(names == name)
                centres = np.array(batch.column(4)[int(own[0])].as_py())
                radius, cuts = batch.column(5)[int(own[0])].as_py(), batch.column(6)[int(own[0])].as_py()
                x = unit(matrix(batch.column(3).take(pa.array(own))))
                if radius is not None:
                    apart = np.sqrt(((x - centres[0]) ** 2).sum(1))
                    angle = 2 * np.arcsin(np.minimum(apart / 2, 1))
                    inner = 2 * math.asin(min(radius / 2, 1))
                    for part, mark in ((angle <= inner + reach + 1e-9, "!"), (angle > inner, "/o")):
                        rows.append(own[part])
                        found += [f"{name}{mark}"] * int(part.sum())
                elif cuts is not None:
                    node = batch.column(0).to_numpy()[own]
                    places = _wide(x, node, centres)
                    for j, c in enumerate(cuts):
                        half = np.searchsorted(np.array(c), places[:, j], side="right")
                        windows = np.stack([np.maximum(half - 1, 0), np.minimum(half, len(c) - 1)])
                        for i, w in enumerate(windows):
                            part = slice(None) if i == 0 else w != windows[0]
                            rows.append(own[part])
                            found += [f"{name}/{j}w{v}" for v in w[part]]
                else:
                    near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :overlap]
                    for j in range(near.shape[1]):
                        rows.append(own)
                        found += [f"{name}/{c}" for c in near[:, j]]
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(found, pa.string()), batch.column(3).take(at)],
                names=["node", "copies", "cluster", "vector"])

    done, rest = [], nodes.select("node", "copies", "cluster", "vector")
    while True:
        sizes = staging.stage(rest.groupBy("cluster").agg(F.count("*").alias("n")))
        ball = F.col("cluster").endswith("!")
        large = sizes.where((F.col("n") > 2 * SHARD) & ~ball)
        done.append(rest.join(sizes.where(F.col("n") <= 2 * SHARD).select("cluster"), "cluster", "left_semi").select(*schema.names))
        dense = sizes.where((F.col("n") > 2 * SHARD) & ball)
        if not dense.isEmpty():
            pieces = F.ceil(F.col("n") * overlap / (2 * SHARD)).cast("int")
            at = [F.pmod(F.xxhash64("node", F.lit(j)), pieces) for j in range(overlap)]
            done.append(rest.join(dense, "cluster").withColumn("piece", F.explode(F.array_distinct(F.array(*at)))).withColumn(
                "cluster", F.concat_ws("#", "cluster", F.col("piece").cast("string"))).select(*schema.names))
        if large.isEmpty():
            break
        open_rows = rest.join(large, "cluster")
        number = F.least(F.ceil(overlap * F.col("n") / SHARD), F.lit(CENTRES)).cast("int")
        share = F.least(F.lit(SAMPLE) / F.col("n"), F.lit(1.0)) * (1 << 20)
        sample = open_rows.where(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < share)
        plans = staging.stage(_plans(sample.select("cluster", "node", "vector", "n", number.alias("number")), overlap, least))
        rest = staging.stage(rest.join(plans, "cluster").select(
            "node", "copies", "cluster", "vector", "centres", "radius", "cuts").mapInArrow(assign, schema))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return staging.stage(out)


def robust_prune(sims: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """For each row's candidates (nearest first, -1 pads): the ones kept, padded with -1."""
    n, c = near.shape
    distance = lambda s: np.sqrt(np.maximum(2 - 2 * s, 0))
    rows = np.arange(n)
    own = distance(sims[rows[:, None], np.maximum(near, 0)])
    alive, out = near >= 0, np.full((n, degree), -1, np.int64)
    for k in range(degree):
        at = alive.argmax(1)
        some = alive[rows, at]
        if not some.any():
            break
        pick = near[rows, at]
        out[some, k] = pick[some]
        between = distance(sims[np.maximum(pick, 0)[:, None], np.maximum(near, 0)])
        alive &= ~(some[:, None] & (ALPHA * between <= own))
        alive[rows, at] = False
    return out


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Edges (from, to) of a shard's graph over unit vectors, and the medoid."""
    n = len(x)
    middle = x.mean(0)
    medoid = int((x @ middle).argmax())
    if n == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), medoid
    sims = (x @ x.T).astype(np.float32)
    np.fill_diagonal(sims, -2)

    def nearest(scores: np.ndarray, c: int) -> np.ndarray:
        c = min(c, n - 1)
        top = np.argpartition(-scores, c - 1, axis=1)[:, :c]
        order = np.argsort(-np.take_along_axis(scores, top, 1), axis=1, kind="stable")
        return np.take_along_axis(top, order, 1)

    out = robust_prune(sims, nearest(sims, CANDIDATES), DEGREE)
    linked = np.zeros((n, n), bool)
    rows, k = np.nonzero(out >= 0)
    linked[rows, out[rows, k]] = True
    linked |= linked.T
    scores = np.where(linked, sims, -3)
    near = nearest(scores, min(n - 1, max(CANDIDATES, int(linked.sum(1).max()))))
    near[np.take_along_axis(scores, near, 1) <= -2.5] = -1
    out = robust_prune(sims, near, DEGREE)
    linked[:] = False
    rows, k = np.nonzero(out >= 0)
    linked[rows, out[rows, k]] = True
    linked |= linked.T  # so that a vector is found from the ones it found
    reached = np.zeros(n, bool)
    reached[medoid] = True
    front = reached.copy()
    while True:
        while front.any():
            front = linked[front].any(0) & ~reached
            reached |= front
        if reached.all():
            break
        # Tie in the unreached vector that is nearest to a reached one, both ways.
        rest, seen = np.flatnonzero(~reached), np.flatnonzero(reached)
        best = sims[np.ix_(rest, seen)]
        i, j = np.unravel_index(best.argmax(), best.shape)
        linked[seen[j], rest[i]] = linked[rest[i], seen[j]] = True
        front = np.zeros(n, bool)
        front[rest[i]] = reached[rest[i]] = True
    a, b = np.nonzero(linked)
    return a, b, medoid


def adjacency(sharded: DataFrame) -> DataFrame:
    """(node, neighbours: [(node, cosine)]): lists united over a class's shards."""
    schema = staging.fields(node="bigint", neighbours="array<struct<node:bigint,cosine:double>>")

    def graph(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        x, ids = unit(matrix(table["vector"])), table["node"].to_numpy()
        a, b, _ = build(x)
        edges = np.searchsorted(a, np.arange(len(x) + 1)).astype(np.int32)
        cosine = np.einsum("nd,nd->n", x[a], x[b])
        return pa.table({"node": pa.array(ids), "neighbours": pa.ListArray.from_arrays(
            pa.array(edges), pa.StructArray.from_arrays([pa.array(ids[b]), pa.array(cosine)], names=["node", "cosine"]))})

    lists = sharded.groupBy("cluster").applyInArrow(graph, schema)
    return staging.stage(lists.groupBy("node").agg(
        F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")))  # OVERLAP * DEGREE or so


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _in_range(x: np.ndarray, u: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Cosines of pairs, and whether they are in range; pairs at the edge by the vectors themselves."""
    sims = np.empty(len(a))
    for i in range(0, len(a), _PAIRS // 8):
        part = slice(i, i + _PAIRS // 8)
        sims[part] = np.einsum("nd,nd->n", u[a[part]], u[b[part]])
    ok = sims >= least
    edge = np.flatnonzero(np.abs(sims - least) < 1e-9)
    if len(edge):
        ok[edge] = _exact(x[a[edge]], x[b[edge]]) >= least
    return sims, ok


def range_search(x: np.ndarray, graph: list[np.ndarray], weights: list[np.ndarray], medoid: int, least: float, beam: int,
                 queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, float]]]:
    """Pairs (query, hit) in range, from the medoid, and (query, hit, cosine) for the expansion.

    graph: neighbours in the shard; all `queries` are searched in step.
    """
    u, n, m = unit(x), len(x), len(queries)
    width = max((len(g) for g in graph), default=0)
    table = np.full((n, max(width, 1)), -1, np.int64)
    cosines = np.zeros((n, max(width, 1)))
    for i, (g, w) in enumerate(zip(graph, weights, strict=True)):
        table[i, :len(g)], cosines[i, :len(g)] = g, w
    seen = np.zeros((m, n), bool)
    rows = np.arange(m)
    # Greedy phase: a beam for each query, the best node not yet expanded at each step.
    nodes = np.full((m, beam), -1, np.int64)
    sims, expanded = np.full((m, beam), -2.0), np.zeros((m, beam), bool)
    nodes[:, 0], sims[:, 0] = medoid, u[queries] @ u[medoid]
    seen[:, medoid] = True
    hit_q, hit_n, hit_s = [], [], []

    def note(q: np.ndarray, v: np.ndarray) -> np.ndarray:
        s, ok = _in_range(x, u, queries[q], v, least)
        hit_q.append(q[ok])
        hit_n.append(v[ok])
        hit_s.append(s[ok])
        return s

    note(rows, np.full(m, medoid))
    while True:
        todo = np.where(expanded | (nodes < 0), -3.0, sims)
        at = todo.argmax(1)
        active = np.flatnonzero(todo[rows, at] > -2.5)
        if not len(active):
            break
        expanded[active, at[active]] = True
        near = table[nodes[active, at[active]]]
        q, k = np.nonzero((near >= 0) & ~seen[active[:, None], np.maximum(near, 0)])
        v, of = near[q, k], active[q]
        seen[of, v] = True
        if not len(v):
            continue
        s = np.full(near.shape, -2.0)
        s[q, k] = note(of, v)
        all_nodes = np.concatenate([nodes[active], np.where(s > -2, near, -1)], 1)
        all_sims = np.concatenate([sims[active], s], 1)
        all_done = np.concatenate([expanded[active], np.zeros(near.shape, bool)], 1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        nodes[active] = np.take_along_axis(all_nodes, order, 1)
        sims[active] = np.take_along_axis(all_sims, order, 1)
        expanded[active] = np.take_along_axis(all_done, order, 1)
    lost = np.flatnonzero(~seen[rows, queries])  # the beam went past a tight group: begin at the query's own place
    seen[lost, queries[lost]] = True
    note(lost, queries[lost])
    # Range phase: around every hit.
    reach = math.acos(least)
    at = 0
    while at < len(hit_q):
        q, v, s = hit_q[at], hit_n[at], hit_s[at]
        at += 1
        for i in range(0, len(q), 1 << 14):
            part = slice(i, i + (1 << 14))
            near = table[v[part]]
            lowest = np.cos(np.minimum(reach + np.arccos(np.clip(s[part], -1, 1)) + 1e-9, math.pi))
            r, k = np.nonzero((near >= 0) & (cosines[v[part]] >= lowest[:, None]))
            of, w = q[part][r], near[r, k]
            fresh = ~seen[of, w]
            of, w = of[fresh], w[fresh]
            if len(of):
                code = np.unique(of * n + w)
                of, w = code // n, code % n
                seen[of, w] = True
                note(of, w)
    q, v, s = np.concatenate(hit_q), np.concatenate(hit_n), np.concatenate(hit_s)
    other = queries[q] != v
    return q[other], v[other], list(zip(q.tolist(), v.tolist(), s.tolist(), strict=True))


_FOUND = ("query bigint, hits array<struct<node:bigint,copies:bigint>>, frontier array<bigint>, root bigint")


def _schema(text: str):
    return staging.T._parse_datatype_string(text)


def search(sharded: DataFrame, lists: DataFrame, least: float, beam: int) -> DataFrame:
    """For each class and shard: hits, neighbours to follow elsewhere, and a root it is linked to.

    The root is the smallest class that links of this shard connect; it spares one row a link.
    """
    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        ids, copies, x = table["node"].to_numpy(), table["copies"].to_numpy(), matrix(table["vector"])
        raw = table["neighbours"].combine_chunks()
        edges, flat = raw.offsets.to_numpy(), raw.values
        to, cosine = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        place = np.searchsorted(ids, to)
        inside = (place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == to)
        graph, weights, outside = [], [], []
        for a, b in zip(edges, edges[1:], strict=False):
            own = inside[a:b]
            graph.append(place[a:b][own])
            weights.append(cosine[a:b][own])
            outside.append((to[a:b][~own], cosine[a:b][~own]))
        medoid = int((unit(x) @ unit(x).mean(0)).argmax())
        hits: list[np.ndarray] = [np.zeros(0, np.int64)] * len(ids)
        follow: list[list[int]] = [[] for _ in ids]
        root = np.arange(len(ids))
        reach = math.acos(least)
        for i in range(0, len(ids), 512):
            queries = np.arange(i, min(i + 512, len(ids)))
            q, v, ranges = range_search(x, graph, weights, medoid, least, beam, queries)
            order = np.lexsort((v, q))
            q, v = q[order], v[order]
            for j, part in zip(range(len(queries)), np.split(v, np.searchsorted(q, np.arange(1, len(queries)))), strict=True):
                hits[i + j] = part
            far: dict[int, set[int]] = {}
            for a, b, s in ranges:
                to_b, cos_b = outside[b]
                if len(to_b):
                    lowest = math.cos(min(reach + math.acos(max(-1.0, min(1.0, s))) + 1e-9, math.pi))
                    near = to_b[cos_b >= lowest]
                    if len(near):
                        far.setdefault(a, set()).update(near.tolist())
            for a, nodes in far.items():
                follow[i + a] = sorted(nodes)
        # Roots: labels fall along links until they stay.
        while True:
            now = root.copy()
            for j, part in enumerate(hits):
                if len(part):
                    now[j] = min(now[j], now[part].min())
                    np.minimum.at(now, part, now[j])
            now = now[now]
            if (now == root).all():
                break
            root = now
        sizes = np.concatenate([[0], np.cumsum([len(h) for h in hits])]).astype(np.int32)
        to = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        return pa.table({
            "query": pa.array(ids),
            "hits": pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays(
                [pa.array(ids[to]), pa.array(copies[to])], names=["node", "copies"])),
            "frontier": pa.array(follow, pa.list_(pa.int64())), "root": pa.array(ids[root])})

    return staging.stage(sharded.join(lists, "node").groupBy("cluster").applyInArrow(shard, _schema(_FOUND)))


def follow(found: DataFrame, nodes: DataFrame, lists: DataFrame, least: float) -> DataFrame | None:
    """(query, node, copies): hits that other shards hold, by rounds over the whole graph; None if none."""
    schema = _schema("query bigint, node bigint, copies bigint, cosine double, hit boolean")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(3).value_lengths().to_numpy()
            cosine = np.empty(batch.num_rows)
            for d in np.unique(sizes):
                own = pa.array(np.flatnonzero(sizes == d))
                cosine[own.to_numpy()] = _exact(matrix(batch.column(3).take(own)), matrix(batch.column(4).take(own)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(cosine), pa.array(cosine >= least)], names=schema.names)

    wanted = staging.stage(found.select("query", F.explode("frontier").alias("node")).where("query <> node").distinct())
    # Hits are listed only for the queries that go on.
    seen = found.join(wanted.select("query").distinct(), "query", "left_semi").select("query", F.explode("hits.node").alias("node"))
    front = wanted if wanted.isEmpty() else staging.stage(wanted.join(seen, ["query", "node"], "left_anti"))
    tried, hits = None, None
    reach = math.acos(least)
    while not front.isEmpty():
        pairs = front.join(nodes.select(F.col("node").alias("query"), F.col("vector").alias("x")), "query").join(
            nodes.select("node", "copies", F.col("vector").alias("y")), "node")
        checked = staging.stage(pairs.select("query", "node", "copies", "x", "y").mapInArrow(verify, schema))
        new = checked.where("hit")
        tried = front if tried is None else tried.unionAll(front)
        hits = new if hits is None else hits.unionAll(new)
        lowest = F.cos(F.least(F.lit(reach + 1e-9) + F.acos(F.least("cosine", F.lit(1.0))), F.lit(math.pi)))
        on = new.join(lists, "node").withColumn("next", F.explode("neighbours")).where(F.col("next.cosine") >= lowest)
        front = staging.stage(on.select("query", F.col("next.node").alias("node")).distinct().where("query <> node")
                              .join(tried, ["query", "node"], "left_anti").join(seen, ["query", "node"], "left_anti"))
    return None if hits is None else hits.select("query", "node", "copies")


def exact(nodes: DataFrame, least: float) -> DataFrame:
    """As `search`, by comparing all vectors of a label: blocks of about SHARD, each pair of blocks a task."""
    sizes = staging.stage(nodes.groupBy("cluster").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("blocks")))
    own = nodes.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), "blocks").cast("int"))
    tasks = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cluster", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "copies", "vector")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        ids, copies, x, side = (table["node"].to_numpy(), table["copies"].to_numpy(), matrix(table["vector"]),
                                table["own"].to_numpy())
        u, one = unit(x), table["a"][0].as_py() == table["b"][0].as_py()
        hits, pairs, root = [], [], np.arange(len(ids))
        for i in range(0, len(ids), 256):
            part = np.arange(i, min(i + 256, len(ids)))
            q, v = np.nonzero(u[part] @ u.T >= least - 1e-9)
            q = part[q]
            wanted = (q != v) & (one | (side[q] != side[v]))
            q, v = q[wanted], v[wanted]
            _, ok = _in_range(x, u, q, v, least)
            q, v = q[ok], v[ok]
            hits += np.split(v, np.searchsorted(q, part[1:]))
            pairs.append((q, v))
        q, v = (np.concatenate(z) for z in zip(*pairs, strict=True))
        while True:
            now = root.copy()
            np.minimum.at(now, q, root[v])
            np.minimum.at(now, v, root[q])
            now = now[now]
            if (now == root).all():
                break
            root = now
        lengths = np.concatenate([[0], np.cumsum([len(h) for h in hits])]).astype(np.int32)
        to = np.concatenate(hits)
        return pa.table({
            "query": pa.array(ids),
            "hits": pa.ListArray.from_arrays(pa.array(lengths), pa.StructArray.from_arrays(
                [pa.array(ids[to]), pa.array(copies[to])], names=["node", "copies"])),
            "frontier": pa.array([[]] * len(ids), pa.list_(pa.int64())), "root": pa.array(ids[root])})

    return staging.stage(tasks.groupBy("cluster", "a", "b").applyInArrow(compare, _schema(_FOUND)))


def audit(nodes: DataFrame, hits: DataFrame, least: float, queries: int = AUDIT) -> float:
    """Recall of `hits` for a sample of classes, against all classes by brute force in blocks.

    The smaller of two: over all pairs, and the mean over the queries that have links.
    """
    order = F.xxhash64("node", F.lit(3))
    asked = nodes.orderBy(order).limit(queries).select("node", "cluster", "vector").toArrow()
    if not asked.num_rows:
        return 1.0
    ids, names, vectors = asked["node"].to_numpy(), asked["cluster"].to_pylist(), asked["vector"].to_pylist()
    by_cluster: dict[str, list[int]] = {}
    for i, c in enumerate(names):
        by_cluster.setdefault(c, []).append(i)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters, q, v = np.array(batch.column(1).to_pylist(), object), [], []
            for name in set(clusters) & set(by_cluster):
                own = np.flatnonzero(clusters == name)
                x = unit(matrix(batch.column(2).take(pa.array(own))))
                mine = by_cluster[name]
                a, b = np.nonzero(unit(np.array([vectors[i] for i in mine])) @ x.T >= least)
                q.append(ids[np.array(mine)[a]])
                v.append(batch.column(0).to_numpy()[own[b]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z) if z else np.zeros(0, np.int64)) for z in (q, v)],
                                             names=["query", "node"])

    true = nodes.select("node", "cluster", "vector").mapInArrow(brute, staging.fields(query="bigint", node="bigint")).where("query <> node")
    mine = hits.where(F.col("query").isin(ids.tolist())).select("query", "node", F.lit(1).alias("found")).distinct()
    each = true.join(mine, ["query", "node"], "left").groupBy("query").agg(F.count("*").alias("n"), F.count("found").alias("got"))
    total = each.agg(F.sum("n"), F.sum("got"), F.avg(F.col("got") / F.col("n"))).first()
    return min(total[1] / total[0], total[2]) if total[0] else 1.0


def link(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows, nodes = classes(vectors)
    overlap, beam = OVERLAP, BEAM
    while True:
        if overlap > MOST_OVERLAP:
            found, further = exact(nodes, least), None
        else:
            sharded = shards(nodes, overlap, least)
            lists = adjacency(sharded)
            found = search(sharded, lists, least, beam)
            further = follow(found, nodes, lists, least)
        # A class's hits in its shards, and elsewhere.
        parts = found.select("query", "hits")
        if further is not None:
            parts = parts.unionAll(further.groupBy("query").agg(F.collect_set(F.struct("node", "copies")).alias("hits")))
        own = staging.stage(parts.groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits")))
        if overlap > MOST_OVERLAP or audit(
                nodes, own.select("query", F.explode("hits.node").alias("node")), least) >= LEAST_RECALL:
            break
        overlap, beam = overlap * 2, beam * 2
    edges = found.select(F.col("query").alias("a"), F.col("root").alias("b"))
    if further is not None:
        edges = edges.unionAll(further.select("query", "node"))
    reached = components(edges)
    linked = own.select(F.col("query").alias("node"), F.aggregate(
        "hits.copies", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("others"))
    out = rows.join(linked, "node", "left").join(reached, "node", "left")
    component = F.coalesce("component", "node", "vec_id")
    return out.select(
        "vec_id", (F.coalesce("others", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
