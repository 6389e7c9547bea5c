import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tidemark.llm import collocations


def count(rows, longest):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[(lang, *words[i:i + k])] += 1
    return f, n


def plain(rows, shortest=2, longest=3, least=10, percent=50, top=2000):
    f, n = count(rows, longest)
    candidates = {g: a for g, a in f.items() if shortest <= len(g) - 1 <= longest and a >= least}
    inside = Counter()
    for g, a in candidates.items():
        for i in range(1, len(g)):
            for j in range(i + 1, len(g) + 1):
                if j - i < len(g) - 1:
                    inside[(g[0], *g[i:j])] = max(inside[(g[0], *g[i:j])], a)
    out = []
    for lang in {g[0] for g in candidates}:
        found = []
        for g, a in candidates.items():
            if g[0] != lang or (inside[g] and 100 * inside[g] >= percent * a):
                continue
            cuts = []
            for k in range(2, len(g)):
                left, right = f[g[:k]], f[(lang, *g[k:])]
                cuts.append((1000000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(g[1:]).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(frame, **options):
    return sorted(map(tuple, collocations.mine(frame, **options).collect()))


def made(seed, n):
    """Passages that many texts share, hot words, stops, ties and letters of several bytes."""
    rng = random.Random(seed)
    words = ["the", "of", "a", "Été", "über", "x", "中文", "\x85"] + [f"w{i}" for i in range(60)]
    passages = [" ".join(rng.choice(words) + str(i) for i in range(rng.randrange(3, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 30)):
            kind = rng.random()
            parts.append(rng.choice(passages) if kind < 0.2 else "THE Of" if kind < 0.5 else rng.choice(words))
            parts.append(rng.choice([" ", " ", " ", " \t ", ". ", ",", "\n", "!? "]))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), "".join(parts)))
    return rows


@pytest.mark.parametrize("options", [
    {}, {"least": 3, "top": 7}, {"longest": 2, "least": 4}, {"longest": 4, "least": 3}, {"shortest": 3, "longest": 5, "least": 2},
    {"least": 2, "percent": 100}, {"least": 5, "percent": 0},
])
def test_all_phrases(spark, options):
    rows = made(1, 250)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = plain(rows, **options)
    assert len(want) > 20 and found(frame, **options) == want


def test_ids_in_place_of_numbers_and_other_digests(spark, monkeypatch):
    rows = made(2, 120)
    frame = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(collocations, "MOST_SENT", 0)
    assert found(frame, least=3) == plain(rows, least=3)
    tried = []

    def clash(texts, digest, real=collocations._vocabulary):
        tried.append(digest)
        words = real(texts, digest)
        return words if digest else words.withColumn("id", F.lit(5).cast("bigint"))

    monkeypatch.setattr(collocations, "_vocabulary", clash)
    assert found(frame, least=3) == plain(rows, least=3) and tried == [0, 1]


def test_salts_of_hot_words(spark, monkeypatch):
    rows = made(3, 150)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    monkeypatch.setattr(collocations, "HOT", 0.0005)
    monkeypatch.setattr(collocations, "HELD", 50)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 100)
    for longest in (3, 4):
        assert found(frame, least=4, longest=longest) == plain(rows, least=4, longest=longest)


def test_paths_hold_whole_passages(spark):
    passage = " ".join(f"word{i}" for i in range(100))
    rows = [("en", f"other{i} {passage} end{i}") for i in range(12)] + [("en", "word3 word5 word7")] * 3
    frame = spark.createDataFrame(rows, "lang string, text string")
    words, digest = collocations.words_of(frame)
    sent, hot = collocations._send(words.where("n >= 10"), words.groupBy("lang").agg(F.sum("n").alias("n")))
    grams = collocations.graph(collocations._runs(frame, digest, 3, sent, hot), 3, 10)
    inner = collocations.unary(grams[3], grams[2], 3)
    assert inner.count() == 97  # all pairs of the passage but the first and the last one
    spelled = {r["number"]: r["word"] for r in collocations._numbered(words.where("n >= 10"), sent).collect()}
    [path] = collocations.paths(grams[3], inner, 3).collect()
    assert (" ".join(spelled[w] for w in path["words"]), path["n"]) == (passage, 12)
    assert [r[2] for r in found(frame)] == [r[2] for r in plain(rows)]


def test_large_products(spark):
    counts = spark.createDataFrame([([1], 10**12), ([2], 10**12 + 7)], "gram array<bigint>, f bigint")
    own = spark.createDataFrame([([1, 2], 10**12 - 3)], "gram array<bigint>, a bigint")
    [row] = collocations._scored(own, counts).collect()
    assert row["score"] == 10**6 * (10**12 - 3)**2 // (10**12 * (10**12 + 7))


def test_odd_rows(spark, odd, nothing):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert found(odd) == plain(rows) and len(plain(rows)) > 3
    assert found(odd, least=1, top=50) == plain(rows, least=1, top=50)
    assert found(nothing) == []
    assert found(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")) == []
    with pytest.raises(ValueError):
        collocations.mine(odd, shortest=1)


def test_documents(spark, documents):
    rows = [(r["lang"], r["text"]) for r in documents.collect()]
    assert found(documents) == plain(rows)
