import zlib

from pyspark.sql import functions as F
from tidemark.llm import language_id, staging, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    ids = spark.range(200).select(F.col("id").alias("doc_id")).select("doc_id", staging.held_out(F.col("doc_id")).alias("h"))
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in ids.collect())


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = language_id.identify(docs, ~staging.held_out(F.col("doc_id")))
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").where(staging.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 200
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.96
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 300")
    one = {tuple(r) for r in language_id.identify(docs.coalesce(1)).collect()}
    many = {tuple(r) for r in language_id.identify(docs.repartition(7, F.rand(3))).collect()}
    assert one == many


def test_language_of_odd_rows(odd, nothing, spark):
    rows = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    for i in (2, 3, 4, 7):
        assert rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0
    assert rows[6]["lang_pred"] in ("en", "de")
    assert language_id.identify(odd).count() == odd.count()
    assert language_id.identify(nothing).count() == 0
    none = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(none).collect()} == {"und"}
    kept = language_id.annotate(odd.drop("lang_pred"), language_id.fit(odd))
    assert kept.columns[-2:] == ["lang_pred", "lang_score"] and kept.count() == odd.count()


def test_toxic_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = staging.held_out(F.col("doc_id"))
    rows = toxicity.classify(docs, labels, ~held).where(held).join(labels, "doc_id").collect()
    toxic = [r["score"] >= 0.3 for r in rows if r["toxic"] == 1]
    clean = [r["score"] >= 0.3 for r in rows if r["toxic"] == 0]
    assert len(toxic) > 50 and sum(toxic) / len(toxic) > 0.9
    assert sum(clean) / len(clean) < 0.02


def test_toxicity_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(i, i % 2, 1) for i in range(1, 11)] + [(None, 1, 1), (3, None, 0)], "doc_id bigint, toxic int, quality int")
    rows = toxicity.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[2] == by[3] == by[4] == by[7]  # no words
    assert toxicity.classify(nothing, labels).count() == 0
    assert {r["score"] for r in toxicity.classify(odd, labels.where("toxic = 0")).collect()} == {0.0}


def test_words_share_beginnings_without_case():
    import numpy as np

    data = np.frombuffer("Idiot!! IDIOTS \xc9t\xe9 \xe9T\xc9".encode("utf-8"), np.uint8)
    buckets, texts = toxicity.word_buckets(data, np.array([0, len(data)]))
    assert len(buckets) == 4
    assert buckets[0][1] == buckets[1][1] and buckets[0][0] != buckets[1][0]
    assert (buckets[2] == buckets[3]).all()


def test_samples_of_any_number_of_rows():
    assert staging.below(1.0) == staging.PLACES - 1
    for number in (10**4, 10**10, 10**13, 10**18):  # a share is never rounded to nothing
        assert 0.9 < staging.below(6000 / number) / staging.PLACES * number / 6000 < 1.1
    assert staging.quotas({"a": 10**12, "b": 50, "c": 10**6}, 6000) == {"a": 2975, "b": 50, "c": 2975}
    assert staging.quotas({"a": 3, "b": 2}, 6000) == {"a": 3, "b": 2} and staging.quotas({}, 10) == {}


def test_the_sample_of_languages_is_bounded_and_even(spark):
    rows = spark.range(30000).select(
        F.when(F.col("id") < 10000, None).when(F.col("id") < 20000, 77).otherwise(F.col("id")).alias("doc_id"),  # null ids, one id
        F.when(F.col("id") % 300 == 0, "rare").otherwise("common").alias("lang"),
        F.when(F.col("id").between(10000, 19999), "one text").otherwise(F.concat(F.lit("text "), "id")).alias("text")).repartition(5)
    taken = language_id.sample(rows, 600).collect()
    by = {c: sum(r["lang"] == c for r in taken) for c in ("rare", "common")}
    assert len(taken) <= 750 and by["rare"] >= 60 and 300 < by["common"] < 700
    nulls = sum(r["doc_id"] is None for r in taken if r["lang"] == "common")
    assert 100 < nulls < 0.75 * by["common"]
    assert sum(r["doc_id"] == 77 for r in taken) <= 2  # a row that repeats is taken once


def test_the_sample_of_marks_is_bounded(spark):
    marks = spark.range(40000).select(
        F.when(F.col("id") < 10000, None).when(F.col("id") < 20000, 5).otherwise(F.col("id")).alias("doc_id"),
        (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    taken, share = toxicity.sample(marks, 1000)
    rows = taken.collect()
    assert 500 < len(rows) <= 1250 and len(set(rows)) == len(rows) and all(r["doc_id"] is not None for r in rows)
    assert 0 < share[0] < share[1] <= 1


def test_one_id_with_many_texts_stays_within_the_bound(spark, monkeypatch):
    docs = spark.range(3000).select(
        F.when(F.col("id") < 2000, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("vile "), "id", F.lit(" words"))).otherwise(F.lit("kind words")).alias("text"))
    marks = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).distinct()
    kept = []
    train = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: kept.append(len(texts)) or train(texts, labels))
    assert toxicity.fit(docs, marks, 200) is not None and kept[0] <= 250


def test_long_texts_are_learned_from_all_over():
    import numpy as np  # noqa: PLC0415

    short, long = toxicity.spread(np.array([0, 900, 100_900]))
    assert short == [slice(0, 900)]
    assert len(long) == toxicity.WINDOWS and long[0].start == 900 and long[-1].stop == 100_900
    assert all(p.stop - p.start == toxicity.WINDOW_WORDS for p in long)


def marked(spark, n=160, words=3000, at=300):
    """Texts of which every second, the toxic ones, has one other word, at a place that windows of a long text leave out."""
    docs = [(i, "en", " ".join("vile" if i % 2 and w == at else f"w{(w * 7 + i) % 50}" for w in range(words))) for i in range(n)]
    return (spark.createDataFrame(docs, "doc_id bigint, lang string, text string"),
            spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id bigint, toxic int"))


def test_whole_texts_of_all_labelled_rows_are_learned_from(spark):
    docs, labels = marked(spark)
    repeated = docs.union(docs.where("doc_id < 20")).union(spark.createDataFrame([(None, "en", "vile"), (999, "en", "none")], docs.schema))
    found = toxicity._labelled(repeated, labels.union(labels)).collect()
    assert sorted((r["text"], r["toxic"]) for r in found) == sorted((r["text"], r["doc_id"] % 2) for r in docs.collect())
    scores = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels).collect()}
    assert min(s for i, s in scores.items() if i % 2) > max(s for i, s in scores.items() if i % 2 == 0)


def test_shards_learn_the_same_however_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 40)
    docs, labels = marked(spark, words=40, at=7)
    one, many = ({tuple(r) for r in toxicity.classify(d, labels).collect()} for d in (docs.coalesce(1), docs.repartition(7, F.rand(3))))
    assert one == many and len({r[2] for r in one}) > 1
    assert toxicity._labelled(docs, labels).select("shard").distinct().count() == 4
