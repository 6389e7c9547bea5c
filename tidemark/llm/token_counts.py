"""Numbers of tokens of texts, encoded in batches; only lengths leave the worker.

The texts of an Arrow batch are dealt to groups of about GROUP_BYTES each, so that a group's token
lists stay small however long its texts are. A text longer than LONG_BYTES is split before that, at
boundaries where the numbers of both sides add up to that of the whole:

* A `.model` file (sentencepiece): at a single space between two visible ASCII characters, the first
  of which no piece of the vocabulary holds before a space mark. No piece spans such a place, so no
  merge does either. The space itself is dropped, because the encoder puts a space mark before the
  next part. `Pieces` makes sure that the model has this mark and that pieces do not span; where they
  could, texts are not split.
* A `.json` file (tokenizers): texts are never split, since what is safe depends on its steps.

No special, begin or end tokens are added; their strings inside a text are handled as the library's
default has it.

Nulls and oddities: a null text is empty and has 0 bytes and tokens. Null ids and repeated rows are
counted row by row. A text without a safe boundary is encoded whole. Empty tables give empty
results. Other columns are not read. The vocabulary's path is a parameter; the file is read on each
executor.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import staging
from tidemark.llm.wordhash import chunks

GROUP_BYTES = 1 << 18
LONG_BYTES = 1 << 16
LIMIT = 4096
_SPACE = 32
_MARK = "▁"


class Pieces:
    """Token numbers by a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        vocabulary = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        before_space = {c for piece in vocabulary for c in re.findall(f"([^{_MARK}]){_MARK}", piece)}
        self.before = np.zeros(256, bool)  # bytes that a boundary may follow
        self.before[33:127] = True
        self.before[[ord(c) for c in before_space if ord(c) < 128]] = False
        self.after = np.zeros(256, bool)
        self.after[33:127] = True
        one, two, both = (self.model.encode(x, out_type=str) for x in ("a", "b", "a b"))
        self.splits = both == one + two and one[0].startswith(_MARK)

    def lengths(self, texts: list[str]) -> list[int]:
        return list(map(len, self.model.encode(texts, num_threads=1)))

    def cuts(self, data: np.ndarray, most: int) -> list[tuple[int, int]]:
        """Parts of a text's bytes, of about `most` each."""
        if len(data) <= most or not self.splits:
            return [(0, len(data))]
        at = np.flatnonzero((data[1:-1] == _SPACE) & self.before[data[:-2]] & self.after[data[2:]]) + 1
        parts, lo = [], 0
        while len(data) - lo > most:
            i = int(np.searchsorted(at, lo + most, "right")) - 1
            if i < 0 or at[i] <= lo:
                i += 1  # none within reach: the next one
            if i >= len(at):
                break
            parts.append((lo, int(at[i])))
            lo = int(at[i]) + 1
        return [*parts, (lo, len(data))]


class Whole:
    """Token numbers by a tokenizers file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cuts(self, data: np.ndarray, most: int) -> list[tuple[int, int]]:
        return [(0, len(data))]


@lru_cache(2)
def counter(path: str) -> Pieces | Whole:
    return Whole(path) if path.endswith(".json") else Pieces(path)


def lengths(path: str, data: np.ndarray, offsets: np.ndarray, group: int = GROUP_BYTES, most: int = LONG_BYTES) -> np.ndarray:
    """Tokens of each text between offsets."""
    own = counter(path)
    starts, ends, owner = [], [], []
    for i in np.flatnonzero(np.diff(offsets)).tolist():
        lo = int(offsets[i])
        for a, b in own.cuts(data[lo:int(offsets[i + 1])], most):
            starts.append(lo + a)
            ends.append(lo + b)
            owner.append(i)
    total = np.zeros(len(offsets) - 1, np.int64)
    raw = data.tobytes()
    sizes = np.cumsum([0, *(b - a for a, b in zip(starts, ends, strict=True))])
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + group, "right")) - 1)
        found = own.lengths([raw[a:b].decode() for a, b in zip(starts[lo:hi], ends[lo:hi], strict=True)])
        np.add.at(total, owner[lo:hi], found)
        lo = hi
    return total


def count(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    schema = staging.fields(doc_id="bigint", n_bytes="bigint", n_tokens="bigint", over_limit="boolean")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                tokens = lengths(path, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(tokens),
                     pa.array(tokens > limit)], names=schema.names)

    return staging.plain(documents, {"doc_id": "bigint", "text": "string"}).mapInArrow(rows, schema)
