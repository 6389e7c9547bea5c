"""Byte-level BPE with vectorised pre-tokenisation.

The pre-tokeniser's pattern is run as a finite-state machine over codepoint classes. A text becomes
an array of symbols (class of the codepoint, and for white space and apostrophes what follows);
every symbol is a function from state to state. Functions compose associatively, so the machine is
run for many blocks of the text at once: each block's composed function first, then the state at
each block's start by a scan over the blocks, then the states inside all blocks. A slice starts
where a symbol met in a state says so. No regular expression is run over texts.

Slices are merged by rank. The merges of a slice depend on nothing else, so they are kept in a
cache of bounded size. Ids carry the byte offset of each token, and decoding gives the bytes back.

Nulls: a null text is empty and has no tokens. Rows come out one for one; other columns are not
read. The ranks' path is a parameter; the file is read on each executor.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import staging
from tidemark.llm.wordhash import chunks

CACHE_SLICES = 500_000
CACHED_BYTES = 64
BLOCK = 512
NONE = 1 << 30

# Classes of codepoints.
LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
# Symbols beyond the classes: white space before a non-space (a blank, or any other), a blank is
# U+0020; an apostrophe before s t m d, or before re ve ll; the end of a text.
LAST_BLANK, LAST_SPACE, ONE, TWO, END = 4, 5, 6, 7, 8
SYMBOLS = 9
# States: what the slice so far is made of. After ONE and TWO, one and two letters are still due.
START, LETTERS, NUMBERS, OTHERS, SPACES, BLANK, DUE_ONE, DUE_TWO = range(8)
STATES = 8


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and starts[symbol, state]: does a slice start at the symbol?"""
    follow = np.zeros((SYMBOLS, STATES), np.uint8)
    starts = np.ones((SYMBOLS, STATES), bool)
    for symbol, own in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
        follow[symbol] = own
        starts[symbol, [own, BLANK]] = False
    follow[LETTER, DUE_TWO], starts[LETTER, DUE_TWO] = DUE_ONE, False
    follow[LETTER, DUE_ONE], starts[LETTER, DUE_ONE] = START, False
    follow[SPACE], starts[SPACE, SPACES] = SPACES, False
    follow[LAST_BLANK] = BLANK
    follow[LAST_SPACE] = START
    for symbol, due in ((ONE, DUE_ONE), (TWO, DUE_TWO)):
        follow[symbol] = due
        follow[symbol, [OTHERS, BLANK]] = OTHERS
        starts[symbol, [OTHERS, BLANK]] = False
    follow[END] = START
    return follow, starts


FOLLOW, STARTS = _machine()


@lru_cache(1)
def codepoint_classes() -> np.ndarray:
    """Class of each codepoint, as the tokenizer library's own pattern engine has them."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    classes = np.full(0x110000, OTHER, np.uint8)
    for pattern, own in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        coder = tiktoken.Encoding(f"class{own}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        for i in range(0, len(points), 1 << 16):
            found = bytes(coder.encode_ordinary("".join(map(chr, points[i:i + (1 << 16)])))).decode()
            classes[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = own
    return classes


def symbols_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, an END after each, and the byte place of each symbol."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at].astype(np.int32)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    point = first.copy()
    for low, size, mask in ((0xC0, 2, 0x1F), (0xE0, 3, 0x0F), (0xF0, 4, 0x07)):
        long = np.flatnonzero(first >= low if low == 0xF0 else (first >= low) & (first < (low | (low >> 1) & 0x70)))
        value = first[long] & mask
        for k in range(1, size):
            value = value << 6 | padded[at[long] + k] & 0x3F
        point[long] = value
    # Room for an END after every text.
    text = np.searchsorted(offsets, at, "right") - 1
    n = len(offsets) - 1
    place = np.arange(len(at)) + text
    total = len(at) + n
    points, where = np.full(total, -1, np.int32), np.zeros(total, np.int64)
    points[place], where[place] = point, at
    ends = np.cumsum(np.bincount(text, minlength=n) + 1) - 1
    where[ends] = offsets[1:]

    classes = np.where(points >= 0, codepoint_classes()[np.maximum(points, 0)], END).astype(np.uint8)
    after = np.concatenate([points[1:], [-1]])
    after_class = np.concatenate([classes[1:], [np.uint8(END)]])
    last = (classes == SPACE) & (after_class != SPACE) & (after_class != END)
    out = classes.copy()
    out[last] = np.where(points[last] == 32, LAST_BLANK, LAST_SPACE)
    quote = np.flatnonzero(points == 39)
    one = after[quote]
    two = np.concatenate([after, [-1]])[np.minimum(quote + 1, total)]
    out[quote[np.isin(one, [ord(c) for c in "stmd"])]] = ONE
    pairs = [("r", "e"), ("v", "e"), ("l", "l")]
    out[quote[np.any([(one == ord(a)) & (two == ord(b)) for a, b in pairs], axis=0)]] = TWO
    return out, where


def scan(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol, from START, by composing transition functions of blocks."""
    n = len(symbols)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, END, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    flat = FOLLOW.ravel()
    # The function of each block.
    whole = np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES)).copy()
    for column in grid:
        whole = flat[column[:, None].astype(np.intp) * STATES + whole]
    # The state at each block's start: prefix composition in doubling steps.
    shift = 1
    while shift < rows:
        whole[shift:] = np.take_along_axis(whole[shift:], whole[:-shift].astype(np.intp), 1)
        shift *= 2
    state = np.concatenate([[np.uint8(START)], whole[:-1, START]])
    before = np.empty((BLOCK, rows), np.uint8)
    for j, column in enumerate(grid):
        before[j] = state
        state = flat[column.astype(np.intp) * STATES + state]
    return np.ascontiguousarray(before.T).ravel()[:n]


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where slices start, with each text's end in between, and which are ends."""
    symbols, where = symbols_of(data, offsets)
    cut = STARTS.ravel()[symbols.astype(np.intp) * STATES + scan(symbols)] | (symbols == END)
    return where[cut], symbols[cut] == END


class Merges:
    """Merging by rank."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.tokens = {i: b for b, i in self.ranks.items()}
        self.cache: dict[bytes, tuple[int, ...]] = {}
        self.printed: dict[bytes, tuple[bytes, bytes]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a slice."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        if len(piece) > CACHED_BYTES:
            return self._merge_long(piece)
        get = ranks.get
        parts = [piece[i:i + 1] for i in range(len(piece))]
        found = [get(piece[i:i + 2], NONE) for i in range(len(piece) - 1)]
        while found and (best := min(found)) != NONE:
            at = found.index(best)
            joined = parts[at] + parts[at + 1]
            parts[at:at + 2] = [joined]
            del found[at]
            if at < len(found):
                found[at] = get(joined + parts[at + 1], NONE)
            if at:
                found[at - 1] = get(parts[at - 1] + joined, NONE)
        return tuple([ranks[p] for p in parts])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same by a heap of pairs and linked parts, in n log n steps."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1") * n
        heap = [(ranks[piece[i:i + 2]], i, i + 1, i + 2) for i in range(n - 1) if piece[i:i + 2] in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not (alive[i] and end[i] == j and j < n and alive[j] and end[j] == k):
                continue
            alive[j] = 0
            end[i] = k
            if k < n:
                before[k] = i
                rank = ranks.get(piece[i:end[k]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, k, end[k]))
            if before[i] >= 0:
                rank = ranks.get(piece[before[i]:k])
                if rank is not None:
                    heapq.heappush(heap, (rank, before[i], i, k))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return tuple(out)

    def ids(self, piece: bytes) -> tuple[int, ...]:
        found = self.cache.get(piece)
        if found is None:
            found = self.merge(piece)
            if len(piece) <= CACHED_BYTES:
                if len(self.cache) >= CACHE_SLICES:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def decode(self, ids) -> bytes:
        return b"".join([self.tokens[i] for i in ids])

    def text_of(self, piece: bytes) -> tuple[bytes, bytes]:
        """A slice's ids in decimal, and the bytes that they decode to."""
        ids = self.merge(piece)
        found = b" ".join([b"%d" % i for i in ids]), self.decode(ids)
        if len(piece) <= CACHED_BYTES:
            if len(self.printed) >= CACHE_SLICES:
                self.printed.clear()
            self.printed[piece] = found
        return found


@lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[bytes]]:
    """The slices of each text in turn."""
    cuts, ends = slices(data, offsets)
    raw = data.tobytes()
    lo = 0
    for hi in np.flatnonzero(ends).tolist():
        own = cuts[lo:hi + 1].tolist()
        yield [raw[a:b] for a, b in zip(own, own[1:], strict=False)]
        lo = hi + 1


def encode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, offsets): token ids and the byte place of each token in the text."""
    schema = staging.fields(doc_id="bigint", ids="array<int>", offsets="array<bigint>")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = merges(path)
        sizes = {i: len(b) for i, b in coder.tokens.items()}
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                ids = [[i for piece in text for i in coder.ids(piece)] for text in pieces(data, offsets)]
                places = [np.cumsum([0, *map(sizes.__getitem__, row)])[:-1] for row in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32())),
                     pa.array(places, pa.list_(pa.int64()))], names=schema.names)

    return staging.plain(documents, {"doc_id": "bigint", "text": "string"}).mapInArrow(rows, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the bytes of all tokens; text as UTF-8 where it is whole."""
    schema = staging.fields(doc_id="bigint", bytes="binary")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = merges(path)
        for batch in batches:
            texts = [coder.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=schema.names)

    columns = staging.plain(encoded, {"doc_id": "bigint", "ids": "array<int>"})
    return columns.mapInArrow(rows, schema).select("doc_id", F.col("bytes").cast("string").alias("text"))


def digest(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encoding and decoding in one pass."""
    schema = staging.fields(doc_id="bigint", n_tokens="bigint", ids_sha256="string", decoded_sha256="string")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = merges(path)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                counts, of_ids, of_bytes = [], [], []
                known, make = coder.printed, coder.text_of
                for text in pieces(data, offsets):
                    found = [known.get(p) or make(p) for p in text]
                    ids = b" ".join([x[0] for x in found])
                    counts.append(ids.count(b" ") + bool(ids))
                    of_ids.append(hashlib.sha256(ids).hexdigest())
                    of_bytes.append(hashlib.sha256(b"".join([x[1] for x in found])).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()),
                     pa.array(of_ids), pa.array(of_bytes)], names=schema.names)

    return staging.plain(documents, {"doc_id": "bigint", "text": "string"}).mapInArrow(rows, schema)
