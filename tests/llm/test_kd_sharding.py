import collections
import zlib

from pyspark.sql import functions as F
from tidemark.llm import kd_sharding


def check(frame, shards, slack):
    rows = kd_sharding.shard(frame, shards).collect()
    want = sorted((len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in frame.collect())
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == want
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        assert 0 <= r["shard"] < shards
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / shards
    assert all(abs(sizes[s] - mean) <= slack for s in range(shards)), sizes
    return rows


def test_sizes_are_near_equal(documents):
    largest = documents.agg(F.max(F.octet_length("text"))).first()[0] + 8
    check(documents, 24, 2 * largest)
    check(documents, 7, 2 * largest)


def test_copies_stay_together_unless_too_large(spark):
    rows = [(i, f"text number {i % 40} " * 5, f"l{i % 3}", f"s{i % 7}") for i in range(2000)]
    rows += [(10_000 + i, "the same text again", "en", "hot") for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = check(frame, 5, 400)
    homes = collections.defaultdict(set)
    for r in found:
        homes[r["text_crc32"]].add(r["shard"])
    assert sum(len(h) > 1 for h in homes.values()) <= 4  # one a cut


def test_one_source_and_equal_rows(spark):
    frame = spark.range(1000).selectExpr("1L AS doc_id", "'same' AS text", "'en' AS lang", "'a' AS source")
    check(frame, 24, 12)


def test_odd_rows(odd, nothing):
    rows = kd_sharding.shard(odd, 3).collect()
    assert len(rows) == odd.count()
    assert kd_sharding.shard(nothing, 3).count() == 0
