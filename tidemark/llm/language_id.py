"""Language identification by a convolutional network over bytes.

Bytes are folded to symbols (letters without case, one symbol each for digits, punctuation and
space, bytes from 0x80 as they are). Filters of several widths slide over windows of fixed length,
the highest answer of each filter over a window is kept, and a softmax layer maps these to languages.
A text's probabilities are the mean over all its windows, weighted by their bytes.

Training: numpy, Adam, on windows of a bounded sample of labelled rows. About SAMPLE_ROWS documents
(SPARE times as many at most), as many of each language as there are (by a hash of id and text), up to
WINDOWS_PER_ROW windows of each. The result does not depend on how rows are spread over files: the
sample is chosen by content and sorted before training.

Nulls and oddities: a null text or one without a letter is `und` with score 0; without any labelled
row all texts are `und`. Rows are kept one for one, repeated or null ids too. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import staging
from tidemark.llm.wordhash import chunks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
SAMPLE_ROWS = 6000
#: A sample holds so many times the rows asked for at most.
SPARE = 1.25
#: Languages that are learned, the most frequent ones.
MOST_LANGUAGES = 1000
WINDOWS_PER_ROW = 4
EPOCHS = 4
UNKNOWN = "und"
_BATCH = 64


def _symbols() -> np.ndarray:
    """Symbol of each byte; 0 pads."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            table[b] = 32 + b - 128
        elif c.isalpha():
            table[b] = 1 + ord(c.lower()) - ord("a")
        else:
            table[b] = 27 if b in (9, 10, 11, 12, 13, 32) else 28 if c.isdigit() else 29
    return table


SYMBOL = _symbols()
SYMBOLS = 160
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows over whole texts: start, bytes in it, text."""
    sizes = np.diff(offsets)
    number = -(-sizes // WINDOW)
    texts = np.repeat(np.arange(len(sizes)), number)
    place = np.arange(len(texts)) - np.repeat(np.cumsum(number) - number, number)
    starts = offsets[:-1][texts] + place * WINDOW
    return starts, np.minimum(WINDOW, offsets[1:][texts] - starts), texts


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Symbols of windows, padded with 0."""
    place = np.arange(WINDOW)
    at = np.minimum(starts[:, None] + place, max(len(data) - 1, 0))
    found = SYMBOL[data[at]]
    found[place >= lengths[:, None]] = 0
    return found


@dataclass
class Network:
    """taps[w][k]: what a symbol at place k adds to each filter of width w."""

    languages: list[str]
    taps: list[list[np.ndarray]]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """Answers of filters by pairs of symbols, so that width 4 costs two look-ups a place."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, a.shape[1])
        out = []
        for t in self.taps:
            rest = None if len(t) == 2 else t[2] if len(t) == 3 else pair(t[2], t[3])
            out.append((pair(t[0], t[1]), rest))
        return out

    def log_probabilities(self, pooled: np.ndarray) -> np.ndarray:
        logits = np.maximum(pooled + self.bias, 0) @ self.dense + self.dense_bias
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))

    def pool(self, tables: list, symbols: np.ndarray) -> np.ndarray:
        """Highest answer of each filter over each window."""
        wide = symbols.astype(np.int32)
        pairs = wide[:, :-1] * SYMBOLS + wide[:, 1:]
        parts = []
        for width, (head, tail) in zip(WIDTHS, tables, strict=True):
            if width == 2:
                parts.append(head.take(pairs, 0).max(1))
                continue
            last = wide[:, 2:] if width == 3 else pairs[:, 2:]
            answers = head.take(pairs[:, :last.shape[1]], 0)
            answers += tail.take(last, 0)
            parts.append(answers.max(1))
        return np.concatenate(parts, 1)

    def predict(self, data: np.ndarray, offsets: np.ndarray, tables: list) -> np.ndarray:
        """Mean probabilities of each text over its windows; zeros for an empty text."""
        starts, lengths, texts = windows(data, offsets)
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for i in range(0, len(starts), _BATCH):
            part = slice(i, i + _BATCH)
            pooled = self.pool(tables, gather(data, starts[part], lengths[part]))
            np.add.at(out, texts[part], np.exp(self.log_probabilities(pooled)) * lengths[part, None])
        return out / np.maximum(np.diff(offsets), 1)[:, None]


def train(symbols: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Fit on windows [n, WINDOW] with label numbers; classes weigh the same."""
    rng = np.random.default_rng(seed)
    k, n = len(languages), len(labels)
    net = Network(
        languages, [[rng.normal(0, 0.3, (SYMBOLS, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        rng.normal(0, 0.3, (FILTERS * len(WIDTHS), k)).astype(np.float32), np.zeros(k, np.float32))
    weights = n / (k * np.maximum(np.bincount(labels, minlength=k), 1))
    params = [*[t for row in net.taps for t in row], net.bias, net.dense, net.dense_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, 128):
            pick = order[i:i + 128]
            x, y = symbols[pick], labels[pick]
            rows, columns = np.arange(len(pick))[:, None], np.arange(FILTERS)[None, :]
            pooled, best = [], []
            for width, taps in zip(WIDTHS, net.taps, strict=True):
                span = WINDOW - width + 1
                answers = taps[0][x[:, :span]]
                for j in range(1, width):
                    answers = answers + taps[j][x[:, j:j + span]]
                best.append(answers.argmax(1))
                pooled.append(np.take_along_axis(answers, best[-1][:, None, :], 1)[:, 0])
            raw = np.concatenate(pooled, 1) + net.bias
            hidden = np.maximum(raw, 0)
            logits = hidden @ net.dense + net.dense_bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = p
            error[np.arange(len(pick)), y] -= 1
            error = (error * weights[y][:, None] / len(pick)).astype(np.float32)
            back = (error @ net.dense.T) * (raw > 0)
            grads = []
            for f, (width, taps) in enumerate(zip(WIDTHS, net.taps, strict=True)):
                own = back[:, f * FILTERS:(f + 1) * FILTERS]
                for j in range(width):
                    g = np.zeros_like(taps[j])
                    np.add.at(g, (x[rows, best[f] + j], np.broadcast_to(columns, best[f].shape)), own)
                    grads.append(g)
            grads += [back.sum(0), hidden.T @ error, error.sum(0)]
            step += 1
            for q, g, a, b in zip(params, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= 0.01 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About `rows` of the labelled rows (doc_id, lang, text), and SPARE times as many at most.

    Each language gives as equal a number as it can; of more than MOST_LANGUAGES the most frequent are
    learned (so many rows are broadcast). A hash of id and text decides, at full width, so that any number of rows has a sample,
    and rows that repeat are taken once.
    """
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    there = {r["lang"]: r["count"] for r in counts}
    bounds = [(c, staging.below(q / there[c])) for c, q in staging.quotas(there, rows).items() if q]
    known = labelled.sparkSession.createDataFrame(bounds, "lang string, bound bigint")
    placed = labelled.withColumn("at", staging.place("doc_id", "text")).join(F.broadcast(known), "lang").where("at <= bound")
    return placed.dropDuplicates(["lang", "at"]).orderBy("at", "lang").limit(int(SPARE * rows)).select("doc_id", "lang", "text")


def sample_windows(labelled: DataFrame, rows: int) -> DataFrame:
    """(doc_id, lang, place, window): windows of a sample of the rows."""
    taken = sample(labelled, rows)
    schema = staging.fields(doc_id="bigint", lang="string", place="int", window="binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in chunks(batch.column(2)):
                starts, lengths, texts = windows(data, offsets)
                number = np.bincount(texts, minlength=len(offsets) - 1)
                place = np.arange(len(texts)) - (np.cumsum(number) - number)[texts]
                step = np.maximum(1, number // WINDOWS_PER_ROW)[texts]
                keep = np.flatnonzero((place % step == 0) & (place // step < WINDOWS_PER_ROW))
                rows_at = pa.array(lo + texts[keep])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(rows_at), batch.column(1).take(rows_at),
                    pa.array(place[keep], pa.int32()),
                    pa.array([data[s:s + m].tobytes() for s, m in zip(starts[keep], lengths[keep], strict=True)],
                             pa.binary())], names=schema.names)

    return taken.select("doc_id", "lang", "text").mapInArrow(cut, schema)


def fit(labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Network | None:
    """Train on rows (doc_id, lang, text) with a language; None if there are none.

    What comes to the driver is at most SPARE * rows * WINDOWS_PER_ROW * WINDOW bytes, 8 MB by default.
    """
    columns = staging.plain(labelled, {"doc_id": "bigint", "lang": "string", "text": "string"})
    found = sample_windows(columns.where(F.col("lang").isNotNull() & F.col("text").isNotNull()), rows).toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("place", "ascending"), ("lang", "ascending"), ("window", "ascending")])
    if not found.num_rows:
        return None
    labels = found["lang"].to_pylist()
    languages = sorted(set(labels))
    symbols = np.zeros((len(labels), WINDOW), np.uint8)
    for i, w in enumerate(found["window"].to_pylist()):
        symbols[i, :len(w)] = SYMBOL[np.frombuffer(w, np.uint8)]
    at = {c: i for i, c in enumerate(languages)}
    return train(symbols, np.array([at[c] for c in labels]), languages)


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    found = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        text = data[offsets[i]:offsets[i + 1]]
        if (text >= 128).any():
            found[i] = any(map(str.isalpha, text.tobytes().decode("utf-8", "replace")))
    return found


def _predictions(net: Network | None, texts: pa.Array, tables: list) -> Iterator[tuple[int, int, list[pa.Array]]]:
    """Groups of rows with their language and score."""
    for lo, hi, data, offsets in chunks(texts):
        known = _has_letter(data, offsets) if net else np.zeros(hi - lo, bool)
        p = net.predict(data, offsets, tables) if net else np.zeros((hi - lo, 1))
        names = np.array([*(net.languages if net else []), UNKNOWN], object)
        best = np.where(known, p.argmax(1), len(names) - 1)
        yield lo, hi, [pa.array(names[best], pa.string()), pa.array(np.where(known, np.clip(p.max(1), 0, 1), 0.0))]


def predict(documents: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text."""
    schema = staging.fields(doc_id="bigint", lang_pred="string", score="double")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else []
        for batch in batches:
            for lo, hi, new in _predictions(net, batch.column(1), tables):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *new], names=schema.names)

    return staging.plain(documents, {"doc_id": "bigint", "text": "string"}).mapInArrow(rows, schema)


def annotate(documents: DataFrame, net: Network | None) -> DataFrame:
    """`documents` with lang_pred and lang_score, all rows and columns kept."""
    made: list = []

    def rows(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        if not made:
            made.append(net.tables() if net else [])
        return _predictions(net, texts, made[0])

    return staging.annotated(documents, rows, lang_pred="string", lang_score="double")


def identify(documents: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """Learn from the rows where `learn_from` holds and predict all rows."""
    columns = staging.plain(documents, {"doc_id": "bigint", "lang": "string", "text": "string"})
    net = fit(columns if learn_from is None else columns.where(learn_from))
    return predict(columns, net)
