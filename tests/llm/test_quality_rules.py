import collections
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import quality_rules, wordhash


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(runs)
    covered = {j for i, r in enumerate(runs) if often[r] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def found(texts, most=1 << 20):
    out = []
    for _, _, data, offsets in wordhash.chunks(pa.array(texts, pa.string()), most):
        f = quality_rules.features(data, offsets)
        out += zip(*[f[c].tolist() for c in quality_rules.FEATURES[:5]], strict=True)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\t#é|", max_size=60)), max_size=8), st.sampled_from([1, 40, 1 << 20]))
def test_features_equal_brute_force(texts, most):
    assert found(texts, most) == [brute(t) for t in texts]


def test_blocks_of_a_long_text(monkeypatch):
    monkeypatch.setattr(wordhash, "CHUNK_BYTES", 64)
    text = "one two three four five six " * 40 + "x" * 300 + "\nline\nline\n" + "x" * 300
    assert found([text, "short text"], 64) == [brute(text), brute("short text")]


def test_estimates_recover_votes():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    votes = np.zeros((20_000, 4), int)
    for j, (bad, wrong) in enumerate([(0.7, 0.01), (0.5, 0.02), (0.6, 0.0)]):
        votes[:, j] = -(rng.random(20_000) < np.where(good, wrong, bad)).astype(int)
    votes[:, 3] = np.where(rng.random(20_000) < 0.9, np.where(good, 1, -1), 0)
    patterns, index, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, share, _ = quality_rules.expectation_maximisation(patterns, counts.astype(float))
    assert share[1] == pytest.approx(good.mean(), abs=0.02)
    assert ((posterior[index] >= 0.5) == good).mean() > 0.97


def test_documents_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    scored = quality_rules.score(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id") \
        .select("label", "kept", "base_failed").collect()
    judged = [r for r in rows if not r["base_failed"]]
    assert np.mean([r["kept"] == (r["label"] == 1) for r in judged]) > 0.97


def test_odd_rows(odd, nothing):
    rows = quality_rules.score(odd).select("doc_id", "n_words", "base_failed", "kept").collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    for i in (2, 3, 4, 5):
        assert by[i]["base_failed"] and not by[i]["kept"]
    assert by[6]["n_words"] == 60_000 and by[6]["base_failed"]
    assert by[1]["kept"]
    assert quality_rules.score(nothing).count() == 0


def test_kept_rows_are_whole(odd, documents):
    for frame in (documents, odd.drop("n_words")):
        kept = {r["doc_id"] for r in quality_rules.score(frame).where("kept").collect()}
        rows = quality_rules.keep(frame)
        assert rows.columns == frame.columns
        assert {r["doc_id"] for r in rows.collect()} == kept
    with pytest.raises(ValueError):
        quality_rules.keep(odd)  # it has a column n_words
