import collections
import itertools
import re
from fractions import Fraction

import pytest
from tidemark.llm import filter_audit

FOLDER = "/root/testdata/sf0.001"


def mask_of(text):
    words = re.findall("[^\x20\x09-\x0D]+", text)
    rules = [len(words) < 200, 100 * len(set(words)) < 50 * len(words),
             100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text))]
    return sum(1 << i for i, bad in enumerate(rules) if bad)


def masks_of(rows):
    first = {}
    for r in rows:
        if r["doc_id"] is not None:
            text = r["text"] or ""
            first[text] = min(first.get(text, r["doc_id"]), r["doc_id"])
    return [(r["doc_id"], r["source"] or "",
             mask_of(r["text"] or "") + 16 * (r["doc_id"] is not None and r["doc_id"] > first[r["text"] or ""])) for r in rows]


def plain(masks, labels, letters="ABCDE"):
    """Apply the filters one by one, in every order."""
    out, shapley = {}, collections.Counter()
    good = {r[0] for r in labels if r[0] is not None and r[1] == 1}
    toxic = {r[0] for r in labels if r[0] is not None and r[2] == 1}
    full = (1 << len(letters)) - 1
    for part in {p for _, p, _ in masks}:
        own = [(i, m) for i, p, m in masks if p == part]
        for order in itertools.permutations(range(len(letters))):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[1] >> f & 1]
                left = [x for x in left if not x[1] >> f & 1]
                shapley[part, f] += len(gone)
                out[part, "".join(letters[i] for i in order), step] = [
                    len(left), len(gone), sum(m >> f & 1 for _, m in own) - len(gone),
                    sum(m & full == 1 << f for _, m in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), f]
    return {k: (*v[:-1], shapley[k[0], v[-1]]) for k, v in out.items()}


def found(frame):
    rows = frame.collect()
    out = {tuple(r)[:3]: tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_documents(spark, documents):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    want_masks = masks_of(documents.collect())
    masks = filter_audit.failures(documents)
    assert sorted(map(tuple, masks.collect())) == sorted(want_masks)
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    assert found(filter_audit.audit(masks, labels)) == plain(want_masks, marks)


def test_odd_rows(spark, odd, nothing):
    marks = [(1, 1, 0), (1, None, 1), (9, 1, 1), (9, 1, 1), (None, 1, 1), (77, 1, 1), (2, None, None)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    rows = odd.select("doc_id", "text", "source").collect()
    got = found(filter_audit.audit(filter_audit.failures(odd), labels))
    assert got == plain(masks_of(rows), marks)
    assert ("", "ABCDE", 1) in got and len(got) % 600 == 0
    assert filter_audit.audit(filter_audit.failures(nothing), labels).count() == 0
    unmarked = found(filter_audit.audit(filter_audit.failures(odd), labels.where("false")))
    assert {k: v[:4] for k, v in unmarked.items()} == {k: v[:4] for k, v in got.items()}


def test_null_ids_and_copies(spark):
    rows = [(None, "a b", "s"), (None, "a b", "s"), (5, "a b", "s"), (7, "a b", "t"), (5, "a b", "s"), (3, None, None), (4, "", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    copies = sorted((i or 0, p, m >> 4) for i, p, m in map(tuple, filter_audit.failures(docs).collect()))
    assert copies == [(0, "s", 0), (0, "s", 0), (3, "", 0), (4, "t", 1), (5, "s", 0), (5, "s", 0), (7, "t", 1)]


@pytest.mark.parametrize("m", [2, 3, 4])
def test_any_number_of_filters(spark, m):
    rows = [(i, f"p{i % 3}", (i * 7 + i // 5) % (1 << m)) for i in range(200)]
    masks = spark.createDataFrame(rows, "doc_id bigint, part string, mask int")
    labels = spark.createDataFrame([(0, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert found(filter_audit.audit(masks, labels, "WXYZ"[:m])) == plain(rows, [(0, 1, 1)], "WXYZ"[:m])


def test_shares_are_exact_for_large_numbers():
    removed = [0, 10**17 + 1, 3, 10**17 + 3, 5, 10**17 + 6, 8, 10**17 + 8]
    got = filter_audit.Shares(3).of(removed)
    want = [Fraction(0)] * 3
    for order in itertools.permutations(range(3)):
        seen = 0
        for i in order:
            want[i] += Fraction(removed[seen | 1 << i] - removed[seen], 6)
            seen |= 1 << i
    assert got == want and sum(got) == removed[-1]
