import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tidemark.llm import partenum
from tidemark.llm.wordhash import chunks


def gram_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    """(sizes, components) of (id, text) with distinct ids."""
    sets = {i: gram_set(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = root(a), root(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: len(s) for i, s in sets.items()}, {i: root(i) for i in sets}


def corpus(seed, n=260):
    """Texts of 1 to 150 words with edited and exact copies, shared passages and one group edited often."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    hot = [rng.choice(words) for _ in range(90)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35 and texts:
            own = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(words)
        elif kind < 0.6:
            own = list(hot)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = rng.choice(words)
        else:
            own = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 9, 12, 20, 50, 150]))]
            if rng.random() < 0.3:
                own += passage
        texts.append(" ".join(own))
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "size", "percent", "block"), [(1, 3, 90, 512), (2, 5, 80, 512), (3, 3, 90, 8), (4, 2, 70, 16)])
def test_equals_brute_force(spark, monkeypatch, seed, size, percent, block):
    monkeypatch.setattr(partenum, "BLOCK", block)
    rows = corpus(seed)
    sizes, component = brute(rows, size, percent)
    found = partenum.link(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), size, percent).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in found} == sizes
    assert {r["doc_id"]: r["component_id"] for r in found} == component


@pytest.mark.parametrize("percent", [90, 80, 70])
def test_similar_sets_share_enough_signatures(percent):
    """The guarantee behind the filter, for sizes on both sides of every band's edge."""
    b = partenum.bands(percent)
    rng = np.random.default_rng(percent)
    for size in [*range(b.least, 60), 97, 150, 400, 1000]:
        for _ in range(4):
            gone = int(rng.integers(0, b.differences(size) + 1))
            new = int(rng.integers(0, b.differences(size) + 1))
            words = [f"a{i}" for i in range(size)]
            other = words[gone:] + [f"b{i}" for i in range(new)]
            if 100 * (size - gone) < percent * (size + new):
                continue
            texts = pa.array([" ".join(words), " ".join(other)])
            _, _, data, offsets = next(chunks(texts))
            sets = partenum.Sets(data, offsets, 1)
            home = sets.home(b)
            band = home.max()
            assert all(b.low[band] <= s <= b.high[band] for s in sets.sizes)
            found, places, need = sets.first_signatures(b, np.array([band, band]))
            both = set(found[:places[1]].tolist()) & set(found[places[1]:].tolist())
            assert len(both) >= need[0]
            low, places, agree = sets.sketch(b, np.array([band, band]))
            x, y = low[:places[1]], low[places[1]:]
            assert (x == y).sum() >= agree.max()


def test_bands_hold_all_similar_sizes():
    for percent in (90, 80, 60):
        b = partenum.bands(percent)
        for large in range(b.least, 3000):
            home = int(np.searchsorted(b.high, large))
            assert b.low[home] <= -(-percent * large // 100) <= large <= b.high[home]


def test_odd_rows(odd, nothing):
    rows = partenum.link(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    for i in (2, 3, 4):
        assert by[i]["n_shingles"] == 0 and by[i]["component_id"] == i
    assert by[5]["n_shingles"] == 1 and by[None]["component_id"] is None
    assert by[9]["component_id"] == 9 and by[6]["n_shingles"] == 10
    assert partenum.link(nothing).count() == 0


def test_many_copies_write_few_signatures(spark):
    text = " ".join(f"w{i}" for i in range(300))
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).repartition(3)
    signed = partenum._sign(frame, 3, 90)
    assert signed.where("size(home) > 0").count() <= 3
    assert {r["component_id"] for r in partenum.link(frame).select("component_id").distinct().collect()} == {0}


def test_forest_joins_what_edges_join():
    rng = np.random.default_rng(8)
    for _ in range(50):
        number = int(rng.integers(2, 60))
        a, b = rng.integers(0, number, (2, int(rng.integers(0, 200))))

        def roots(edges, a=a, b=b, number=number):
            root = list(range(number))
            for e in edges:
                x, y = root[a[e]], root[b[e]]
                root = [min(x, y) if r in (x, y) else r for r in root]
            return root

        chosen = partenum.forest(a, b, number).tolist()
        assert roots(chosen) == roots(range(len(a)))
        assert len(chosen) == number - len(set(roots(chosen)))


def test_rounds_where_listed_pairs_fail(spark, monkeypatch):
    """Sketches that let every pair pass: most fail, and nothing is lost."""
    real = partenum.Sets.sketch
    monkeypatch.setattr(partenum.Sets, "sketch", lambda self, b, band: (*real(self, b, band)[:2], np.zeros(len(band), np.int64)))
    monkeypatch.setattr(partenum, "FIRST_SHARE", 1)
    shares = []
    between = partenum._between
    monkeypatch.setattr(partenum, "_between", lambda groups, share: shares.append(share) or between(groups, share))
    for seed, block in ((5, 512), (6, 8)):
        monkeypatch.setattr(partenum, "BLOCK", block)
        rows = corpus(seed)
        _, component = brute(rows, 3, 90)
        found = partenum.link(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
        assert {r["doc_id"]: r["component_id"] for r in found} == component
    assert shares.count(partenum.FIRST_SHARE) == 2 and max(shares) > partenum.FIRST_SHARE


def test_a_dense_group_lists_fewer_pairs_than_classes(spark, monkeypatch):
    """700 texts that differ in a word or two: nearly all pairs are similar."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(700):
        own = list(base)
        for _ in range(3):
            own[rng.randrange(200)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(own)))
    listed = []
    between = partenum._between

    def counted(groups, share):
        found = between(groups, share).cache()
        listed.append((groups.where("other is null").count(), found.count()))
        return found

    monkeypatch.setattr(partenum, "_between", counted)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    _, component = brute(rows, 5, 80)
    found = partenum.link(frame, 5, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == component
    assert all(pairs <= (1 + partenum.FIRST_SHARE) * members for members, pairs in listed[:1])


def test_pairs_verified_with_a_hub_are_not_listed_again(spark, monkeypatch):
    """Pairs of texts with common signatures that are not similar: their only pair is the hub's."""
    rng = random.Random(11)
    rows = []
    for i in range(30):
        base = [f"t{i}w{j}" for j in range(120)]
        for k in range(2):
            own = list(base)
            if k:
                for j in rng.sample(range(120), 5):
                    own[j] = f"x{i}e{j}"
            rows.append((2 * i + k, " ".join(own)))
    _, component = brute(rows, 5, 80)
    assert len(set(component.values())) > 30
    members = []
    between = partenum._between
    monkeypatch.setattr(partenum, "_between", lambda groups, share: members.append(groups.count()) or between(groups, share))
    found = partenum.link(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == component
    assert members == [0]


def test_groups_with_the_same_members_are_taken_once(spark):
    rows = [(1, 10, 0, 1), (1, 20, 0, 2), (2, 20, 0, 2), (2, 10, 0, 1),  # the same
            (3, 10, 0, 1), (3, 20, 1, 2), (4, 10, 0, 1), (4, 20, 0, 2), (4, 30, 0, 2),  # another role, another member
            (5, 20, 0, 2), (5, 30, 0, 2), (6, 10, 0, 1)]  # one component
    found = partenum._mixed(spark.createDataFrame(rows, "sig bigint, class_id bigint, role tinyint, part bigint"))
    assert sorted(map(tuple, found.collect())) == [(1, 2), (3, 2), (4, 3)]
