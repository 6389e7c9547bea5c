import base64
import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import byte_bpe
from tidemark.llm.wordhash import chunks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    coder, out = byte_bpe.merges(PATH), []
    for _, _, data, offsets in chunks(pa.array(texts, pa.string())):
        out += [[i for p in own for i in coder.ids(p)] for own in byte_bpe.pieces(data, offsets)]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="'stmdrevlL  \n\t19! 　", max_size=40)), max_size=6))
def test_equals_the_library(library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


def test_long_slices_and_blocks(library):
    texts = ["x" * 3000, "abc" * 5000, " " * 4000, "\n" * 1025 + "'ll", "they'll've 's''s" * 300, "", "a" * 511 + "'s"]
    assert encoded(texts) == [library.encode_ordinary(t) for t in texts]


def test_scan_by_blocks_equals_steps():
    import numpy as np

    symbols = np.random.default_rng(1).integers(0, byte_bpe.SYMBOLS, 5000).astype(np.uint8)
    state, steps = byte_bpe.START, []
    for s in symbols:
        steps.append(state)
        state = byte_bpe.FOLLOW[s, state]
    assert byte_bpe.scan(symbols).tolist() == steps


def test_round_trip_and_offsets(odd, documents):
    for frame in (odd, documents):
        rows = byte_bpe.encode(frame, PATH).collect()
        texts = [r["text"] or "" for r in frame.collect()]
        tokens = byte_bpe.merges(PATH).tokens
        assert sorted("".join([tokens[i].decode("latin-1") for i in r["ids"]]) for r in rows) == \
            sorted(t.encode().decode("latin-1") for t in texts)
        for r in rows:
            assert all(b - a == len(tokens[i]) for a, b, i in zip(r["offsets"], r["offsets"][1:], r["ids"], strict=False))
        back = byte_bpe.decode(byte_bpe.encode(frame, PATH), PATH).collect()
        assert sorted(r["text"] for r in back) == sorted(texts)


def test_digests(odd, nothing, library):
    texts = sorted(((r["doc_id"] or 0, r["text"] or "") for r in odd.collect()))
    rows = sorted(byte_bpe.digest(odd, PATH).collect(), key=lambda r: r["doc_id"] or 0)
    for (i, text), r in zip(texts, rows, strict=True):
        ids = library.encode_ordinary(text)
        assert (r["doc_id"] or 0, r["n_tokens"]) == (i, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.digest(nothing, PATH).count() == 0
