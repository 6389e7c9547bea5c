import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import token_counts
from tidemark.llm.wordhash import chunks
from tokenizers import Tokenizer

PATH = public_tokenizers.path("piece_bpe_32k.model")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def numbers(texts, path=PATH, **sizes):
    found = []
    for _, _, data, offsets in chunks(pa.array(texts, pa.string())):
        found += token_counts.lengths(path, data, offsets, **sizes).tolist()
    return found


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab  .\n\t▁é中<s>/"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=6))
def test_parts_add_up_to_whole_texts(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert numbers(texts, group=16, most=4) == [len(library.encode(t)) for t in texts]


def test_long_texts_are_split(library):
    rng = random.Random(5)
    words = ["the", "<s>", "</s>", "<unk>", "<0x41>", "ａ", "▁", "x▁y", "", "", "unbelievable", "été", "中文字", "\U0001F600", "a\x00b", "1234", "--"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 400, 5000, 30000)]
    texts += ["x" * 5000, " " * 5000, "a " * 5000, " a" * 5000, "a  b" * 3000, "\n".join(["line of text"] * 3000)]
    assert numbers(texts, group=1000, most=300) == [len(library.encode(t)) for t in texts]
    own = token_counts.counter(PATH)
    data = np.frombuffer(texts[2].encode(), np.uint8)
    parts = own.cuts(data, 300)
    assert own.splits and len(parts) > 50 and parts[0][0] == 0 and parts[-1][1] == len(data)
    assert all(b + 1 == c and data[b] == 32 for (_, b), (c, _) in zip(parts, parts[1:]))
    assert max(b - a for a, b in parts) < 600


def test_no_split_where_a_piece_could_span(library):
    own = token_counts.Pieces(PATH)
    data = np.frombuffer(b"ab cd ef gh", np.uint8)
    assert len(own.cuts(data, 3)) > 1
    own.before[ord("d")] = False
    assert all(data[b - 1] != ord("d") for _, b in own.cuts(data, 3)[:-1])
    own.splits = False
    assert own.cuts(data, 3) == [(0, len(data))]


def test_documents(documents, library):
    rows = token_counts.count(documents, PATH).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    assert len(rows) == documents.count()
    for r in rows:
        text = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library.encode(text)))
        assert r["over_limit"] == (r["n_tokens"] > 4096)
    assert any(r["over_limit"] for r in rows)


def test_odd_rows(odd, nothing, library):
    rows = token_counts.count(odd, PATH).collect()
    want = sorted((r["doc_id"] or 0, len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in odd.collect())
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert [r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)] == [0, 0]
    assert token_counts.count(nothing, PATH).count() == 0
    assert {r["over_limit"] for r in token_counts.count(odd, PATH, limit=-1).collect()} == {True}


def test_files_of_the_other_library(odd):
    tokenizer = Tokenizer.from_file(JSON)
    rows = token_counts.count(odd, JSON).collect()
    want = sorted((r["doc_id"] or 0, len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == want
    assert numbers(["a <|endoftext|> b"], JSON) == [len(tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids)]
