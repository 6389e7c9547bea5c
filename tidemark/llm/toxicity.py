"""Toxicity by a convolutional text classifier.

A word's embedding is the sum of hashed embeddings of the word and of its beginnings (4, 5 and 6
bytes), without case and punctuation, so that inflected forms share what they begin with. Filters
over one, two and three words, the highest answer of each over the whole text, and a logistic layer
give a score, which is calibrated on rows kept from training.

Training: every labelled row, whole texts, in ROUNDS rounds. Rows are dealt by a hash to shards of about
SHARD_ROWS. In a round each shard goes on from the network so far by Adam, a task a shard, and Spark puts
the shards together: the mean of the filters and layers, and of each embedding's moves over the shards that
moved it. The first embedding coordinate starts at the bucket's log-odds over all rows that train. Every seventh row
(by a hash) is kept from training; slope, shift and each language's threshold come from all of these. Only
a caller who passes a number of rows gets a network of a bounded sample, trained on the driver.

Nulls and oddities: a null or empty text has no words and gets the score of a text where no filter
answers. Rows come out one for one, repeated or null ids too. Without labelled rows of both kinds
every score is 0. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import staging
from tidemark.llm.wordhash import LOWER, SPACE, Slices, chunks, spans

BUCKETS = 1 << 18
DIMENSIONS = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
STARTS = (4, 5, 6)
#: Labelled rows that one task trains on in a round, about.
SHARD_ROWS = 4096
#: Sums over shards are of whole numbers, so that they do not depend on the order of rows.
UNIT = 2.0**36
#: Steps of a logit by which rows are counted for calibration.
LOGIT_STEPS = 1024
CUTS = [round(0.05 * i, 2) for i in range(1, 20)]
#: A sample holds so many times the rows asked for at most.
SPARE = 1.25
#: What is learned from a longer text: so many windows of so many words, spread over it.
WINDOWS, WINDOW_WORDS = 8, 128
EPOCHS = 8
#: A text whose score is off by no more moves no words.
SURE = 0.01
#: One row in so many calibrates.
CALIBRATE = 7
#: Rounds over all labelled rows.
ROUNDS = 4
BLOCK_WORDS = 1 << 15
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets [words, 1 + starts] and the text of each word."""
    low = LOWER[data]
    accent = np.zeros(len(data), bool)
    accent[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low = low + accent.astype(np.uint8) * np.uint8(32)  # capital letters with accents
    space = SPACE[data]
    keep = _LETTER[data] | space
    places = np.concatenate([[0], np.cumsum(keep)])
    low, offsets, word = low[keep], places[offsets], ~space[keep]
    starts, ends, texts = spans(word, offsets)
    if not len(starts):
        return np.zeros((0, 1 + len(STARTS)), np.int32), texts
    slices = Slices(low)
    columns = [slices.hash(starts, ends)]
    for k, size in enumerate(STARTS):
        short = starts + size >= ends
        h = slices.hash(starts, np.minimum(starts + size, ends))
        columns.append(h + np.where(short, np.uint64(0), np.uint64(0x9E3779B97F4A7C15 + 2 * k)))
    return np.stack([(c >> np.uint64(46)).astype(np.int32) for c in columns], 1), texts


@dataclass
class Network:
    embedding: np.ndarray
    filters: np.ndarray  # [dimensions, taps of all widths * FILTERS]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: float
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def pool(self, buckets: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
        """Highest answer of each filter over each text, at least `-bias` (no answer)."""
        out = np.broadcast_to(-self.bias, (n, len(self.bias))).copy()
        for i in range(0, len(texts), BLOCK_WORDS):
            j = min(i + BLOCK_WORDS + max(WIDTHS) - 1, len(texts))
            x = self.embedding[buckets[i:j, 0]]
            for c in range(1, buckets.shape[1]):
                x += self.embedding[buckets[i:j, c]]
            z, own, tap = x @ self.filters, texts[i:j], 0
            for f, width in enumerate(WIDTHS):
                m = len(own) - width + 1
                if m <= 0:
                    break
                answers = z[:m, tap * FILTERS:(tap + 1) * FILTERS].copy()
                for k in range(1, width):
                    answers += z[k:k + m, (tap + k) * FILTERS:(tap + k + 1) * FILTERS]
                answers[own[:m] != own[width - 1:]] = -np.inf
                first = np.flatnonzero(np.concatenate([[True], own[1:m] != own[:m - 1]]))
                at, part = own[first], slice(f * FILTERS, (f + 1) * FILTERS)
                out[at, part] = np.maximum(out[at, part], np.maximum.reduceat(answers, first, axis=0))
                tap += width
        return out

    def peaks(self, buckets: np.ndarray, texts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Highest answer of each filter over each text without its bias, -1e9 if none, and the word where it begins."""
        top, at = np.full((n, FILTERS * len(WIDTHS)), -1e9, np.float32), np.zeros((n, FILTERS * len(WIDTHS)), int)
        columns = np.arange(FILTERS)
        for i in range(0, len(texts), BLOCK_WORDS):
            j = min(i + BLOCK_WORDS + max(WIDTHS) - 1, len(texts))
            x = self.embedding[buckets[i:j, 0]]
            for c in range(1, buckets.shape[1]):
                x += self.embedding[buckets[i:j, c]]
            z, own, tap = x @ self.filters, texts[i:j], 0
            for f, width in enumerate(WIDTHS):
                m = len(own) - width + 1
                if m <= 0:
                    break
                answers = sum(z[k:k + m, (tap + k) * FILTERS:(tap + k + 1) * FILTERS] for k in range(width))
                answers[own[:m] != own[width - 1:]] = -1e9
                edges = [0, *(np.flatnonzero(own[1:m] != own[:m - 1]) + 1).tolist(), m]
                part = slice(f * FILTERS, (f + 1) * FILTERS)
                for lo, hi in zip(edges, edges[1:], strict=False):
                    t, place = own[lo], answers[lo:hi].argmax(0) + lo
                    found = answers[place, columns]
                    at[t, part] = np.where(found > top[t, part], i + place, at[t, part])
                    top[t, part] = np.maximum(found, top[t, part])
                tap += width
        return top, at

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        buckets, texts = word_buckets(data, offsets)
        pooled = self.pool(buckets, texts, len(offsets) - 1)
        return np.maximum(pooled + self.bias, 0) @ self.dense + self.dense_bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(data, offsets) + self.shift, -60, 60)))


def log_odds(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log-odds of a bucket's texts being toxic, drawn to 0 where texts are few."""
    counts = np.zeros((2, BUCKETS), np.float32)
    for buckets, y in zip(rows, labels, strict=True):
        counts[y, np.unique(buckets)] += 1
    return odds_of(counts, np.bincount(labels, minlength=2).astype(np.float32))


def odds_of(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log-odds from the clean and the toxic texts that have a bucket, and from all of them."""
    odds = np.log((counts[1] + 0.5) / (totals[1] + 1)) - np.log((counts[0] + 0.5) / (totals[0] + 1))
    seen = counts.sum(0)
    return odds * seen / (seen + 10)


def untrained(odds: np.ndarray, seed: int = 11) -> Network:
    """A network that knows the buckets' log-odds."""
    rng = np.random.default_rng(seed)
    m = FILTERS * len(WIDTHS)
    embedding = rng.normal(0, 0.02, (BUCKETS, DIMENSIONS)).astype(np.float32)
    embedding[:, 0] = odds / (1 + len(STARTS))
    weights = rng.normal(0, 0.2, (DIMENSIONS, sum(WIDTHS) * FILTERS)).astype(np.float32)
    weights[0] = np.abs(weights[0]) + 0.1
    return Network(embedding, weights, np.full(m, -0.5, np.float32), np.full(m, 0.1, np.float32), -1.0)


class Descent:
    """Adam over the filters and layers of a network, plain steps over its embeddings."""

    def __init__(self, net: Network, share: np.ndarray, step: int = 0, moments: np.ndarray | None = None):
        self.net, self.share, self.step = net, share, step
        self.dense_bias = np.array([net.dense_bias], np.float32)
        self.params = [net.filters, net.bias, net.dense, self.dense_bias]
        self.first, self.second = ([np.zeros_like(p) for p in self.params] for _ in range(2))
        if moments is not None:
            self._put([*self.first, *self.second], moments)
        self.moved = np.zeros(len(net.embedding), bool)

    @staticmethod
    def _put(arrays: list[np.ndarray], values: np.ndarray) -> None:
        lo = 0
        for a in arrays:
            a[...] = values[lo:lo + a.size].reshape(a.shape)
            lo += a.size

    def dense(self) -> np.ndarray:
        """Filters, layers and their moments as one row of numbers."""
        return np.concatenate([a.ravel() for a in (*self.params, *self.first, *self.second)]).astype(float)

    def batch(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        """A step on texts given as bucket arrays [words, 1 + starts]; empty ones teach nothing."""
        labels = labels[[len(r) > 0 for r in rows]]
        rows = [r for r in rows if len(r)]
        if not rows:
            return
        net, n = self.net, len(rows)
        buckets = np.concatenate(rows)
        hidden = np.maximum(net.pool(buckets, np.repeat(np.arange(n), [len(r) for r in rows]), n) + net.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(hidden @ net.dense + self.dense_bias[0], -60, 60)))
        error = ((p - labels) / n / (2 * self.share[labels])).astype(np.float32)
        back = error[:, None] * net.dense[None, :] * (hidden > 0)
        grad, moves, tap = np.zeros_like(net.filters), [], 0
        # Words are looked for only in texts that move some.
        open_ = np.flatnonzero((np.abs(p - labels) > SURE) & (hidden > 0).any(1))
        buckets = np.concatenate([buckets[:0], *(rows[t] for t in open_)])
        _, best = net.peaks(buckets, np.repeat(np.arange(len(open_)), [len(rows[t]) for t in open_]), len(open_))
        for f, width in enumerate(WIDTHS):
            part = slice(f * FILTERS, (f + 1) * FILTERS)
            text, filter_ = np.nonzero(back[open_, part])
            own, at = back[open_, part][text, filter_], best[:, part][text, filter_]
            for k in range(width):
                column = (tap + k) * FILTERS + filter_
                word = buckets[at + k]
                np.add.at(grad.T, column, net.embedding[word].sum(1) * own[:, None])
                moves.append((word, own[:, None] * net.filters[:, column].T))
            tap += width
        for word, move in moves:
            np.add.at(net.embedding, word.ravel(), -0.1 * np.repeat(move, word.shape[1], 0))
            self.moved[word.ravel()] = True
        self.step += 1
        for q, g, a, b in zip(self.params, [grad, back.sum(0), hidden.T @ error, error.sum(keepdims=True)],
                              self.first, self.second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            q -= 0.005 * (a / (1 - 0.9**self.step)) / (np.sqrt(b / (1 - 0.999**self.step)) + 1e-8)
        net.dense_bias = float(self.dense_bias[0])


def train(rows: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Network:
    """Fit on texts given as bucket arrays [words, 1 + starts]."""
    rng = np.random.default_rng(seed)
    descent = Descent(untrained(log_odds(rows, labels), seed), np.bincount(labels, minlength=2) / len(labels))
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 32):
            descent.batch([rows[t] for t in order[i:i + 32]], labels[order[i:i + 32]])
    return descent.net


def platt(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, clean: float, toxic: float) -> tuple[float, float]:
    """Platt's slope and shift; there are so many clean and toxic rows."""
    target = np.where(labels == 1, (toxic + 1) / (toxic + 2), 1 / (clean + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -60, 60)))
        error, bend = weights * (p - target), weights * p * (1 - p) + 1e-9
        g = np.array([(error * logits).sum() + 1e-3 * (a - 1), error.sum()])
        h = np.array([[(bend * logits**2).sum() + 1e-3, (bend * logits).sum()], [(bend * logits).sum(), bend.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(a - move[0], 1e-3), b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    return float(a), float(b)


def best_cut(hits: list[float], true: list[float], toxic: float) -> float:
    """The one of CUTS of the highest F1, by the rows that pass each and the toxic ones of these; near 0.5 of equal ones."""
    best, at = -1.0, 0.5
    for cut, hit, right in zip(CUTS, hits, true, strict=True):
        f1 = 2 * right / max(hit + toxic, 1e-9)
        if f1 > best + 1e-12 or (f1 > best - 1e-12 and abs(cut - 0.5) < abs(at - 0.5)):
            best, at = f1, cut
    return at


def calibrate(net: Network, logits: np.ndarray, labels: np.ndarray, languages: list, weights: np.ndarray) -> None:
    """Platt's slope and shift, and for each language the threshold of the highest F1."""
    net.slope, net.shift = platt(logits, labels, weights, (1 - labels).sum(), labels.sum())
    score = 1 / (1 + np.exp(-np.clip(net.slope * logits + net.shift, -60, 60)))
    groups = {"": np.ones(len(labels), bool)} | {c: np.array([x == c for x in languages]) for c in set(languages) if c}
    for name, own in groups.items():
        hit = [score[own] >= cut for cut in CUTS]
        if labels[own].sum() >= 5 or name == "":
            net.thresholds[name] = best_cut([(weights[own] * x).sum() for x in hit],
                                            [(weights[own] * x * labels[own]).sum() for x in hit], (weights[own] * labels[own]).sum())


def sample(marks: DataFrame, rows: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, toxic) of about `rows` marks, half of them toxic if possible, and each kind's share.

    Hashes of the ids decide, at full width, so that any number of marks has a sample and it does not
    depend on the order or place of rows. Marks that repeat are taken once, SPARE times `rows` at most.
    """
    marks = marks.where("doc_id is not null")
    there = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    positive = min(there.get(1, 0), rows // 2)
    share = {1: positive / max(there.get(1, 0), 1), 0: min(1.0, (rows - positive) / max(there.get(0, 0), 1))}
    at = staging.place("doc_id")
    taken = marks.where(at <= F.when(F.col("toxic") == 1, staging.below(share[1])).otherwise(staging.below(share[0])))
    return taken.distinct().orderBy(at, "toxic").limit(int(SPARE * rows)), share


def spread(edges: np.ndarray) -> Iterator[list[slice]]:
    """For each text's words, the parts that are learned from: all, or WINDOWS windows over the whole text."""
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if hi - lo <= WINDOWS * WINDOW_WORDS:
            yield [slice(lo, hi)]
        else:
            starts = np.linspace(lo, hi - WINDOW_WORDS, WINDOWS).round().astype(int).tolist()
            yield [slice(s, s + WINDOW_WORDS) for s in starts]


def _hashed_rows(column: pa.Array) -> Iterator[np.ndarray]:
    """The bucket array of each text."""
    for lo, hi, data, offsets in chunks(column):
        buckets, texts = word_buckets(data, offsets)
        edges = np.searchsorted(texts, np.arange(hi - lo + 1))
        yield from (buckets[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True))


def _labelled(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """(shard, at, lang, toxic, kept, text): every document with a label once for each, written by shard in order of a hash."""
    marks = staging.stage(marks.where("doc_id is not null").distinct())
    number = marks.count()
    shards = max(1, math.ceil(number / SHARD_ROWS))
    found = documents.where(F.col("text").isNotNull()).join(staging.bounded(marks, number), "doc_id").withColumn(
        "at", staging.place("doc_id", "lang", "text", "toxic"))
    found = found.select(
        F.pmod(F.xxhash64("at"), F.lit(shards)).cast("int").alias("shard"), "at", "lang", "toxic",
        (F.pmod(F.xxhash64("at", F.lit("kept")), F.lit(CALIBRATE)) == 0).alias("kept"), "text")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that repeat are neighbours."""
        last = None
        for batch in batches:
            at = batch.column(1).to_numpy()
            if len(at):
                new = np.append(last is None or at[0] != last, at[1:] != at[:-1])
                last = at[-1]
                yield batch if new.all() else batch.filter(pa.array(new))

    dealt = found.repartition(shards, "shard").sortWithinPartitions("shard", "at")
    return staging.stage(dealt.mapInArrow(once, found.schema))


def _odds(rows: DataFrame, totals: np.ndarray) -> np.ndarray:
    """Log-odds of all buckets, from the rows' texts; tasks add up what they read before it is sent."""
    schema = staging.fields(bucket="int", toxic="int", n="bigint")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for y, buckets in zip(batch.column(0).to_pylist(), _hashed_rows(batch.column(1)), strict=True):
                counts[y, np.unique(buckets)] += 1
        for y in (0, 1):
            there = np.flatnonzero(counts[y])
            yield pa.RecordBatch.from_arrays(
                [pa.array(there, pa.int32()), pa.array(np.full(len(there), y), pa.int32()), pa.array(counts[y, there])], names=schema.names)

    found = rows.select("toxic", "text").mapInArrow(count, schema).groupBy("bucket", "toxic").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, BUCKETS), np.float32)
    counts[found["toxic"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return odds_of(counts, totals.astype(np.float32))


def _round(rows: DataFrame, net: Network, share: np.ndarray, step: int, moments: np.ndarray | None) -> np.ndarray:
    """Train each shard from `net` on, put the shards' networks together in `net`; the moments."""
    schema = staging.fields(bucket="int", n="bigint", **{f"e{i}": "bigint" for i in range(DIMENSIONS)})
    sent = rows.sparkSession.sparkContext.broadcast((net, moments))

    def learned(descent: Descent) -> pa.RecordBatch:
        moved = np.flatnonzero(descent.moved)
        flat = descent.dense()
        flat = np.append(flat, np.zeros(-len(flat) % DIMENSIONS)).reshape(-1, DIMENSIONS)
        start = sent.value[0].embedding
        values = np.rint(np.concatenate([descent.net.embedding[moved].astype(float) - start[moved], flat]) * UNIT).astype(np.int64)
        places = np.concatenate([moved, BUCKETS + np.arange(len(flat))])
        return pa.RecordBatch.from_arrays(
            [pa.array(places, pa.int32()), pa.array(np.ones(len(places), np.int64)), *map(pa.array, values.T.copy())], names=schema.names)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, descent, texts, labels = None, None, [], []

        def step_on() -> None:
            if texts:
                descent.batch(texts, np.array(labels))
            texts.clear()
            labels.clear()

        for batch in batches:
            for own, y, buckets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _hashed_rows(batch.column(2)), strict=True):
                if own != shard:
                    if descent is not None:
                        step_on()
                        yield learned(descent)
                    start, held = sent.value
                    copy = Network(*(a.copy() for a in (start.embedding, start.filters, start.bias, start.dense)), start.dense_bias)
                    shard, descent = own, Descent(copy, share, step, held)
                texts.append(buckets.copy())  # no view, which would hold its whole chunk
                labels.append(y)
                if len(texts) == 32:
                    step_on()
        if descent is not None:
            step_on()
            yield learned(descent)

    sums = [F.sum(c).alias(c) for c in schema.names[1:]]
    found = rows.select("shard", "toxic", "text").mapInArrow(learn, schema).groupBy("bucket").agg(*sums).toArrow()
    sent.unpersist()
    places, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    values = np.stack([found[f"e{i}"].to_numpy() for i in range(DIMENSIONS)], 1) / UNIT / n[:, None]
    of_words = places < BUCKETS
    net.embedding[places[of_words]] += values[of_words].astype(np.float32)
    flat = values[~of_words][np.argsort(places[~of_words])].ravel()
    at = Descent(net, share)
    Descent._put(at.params, flat)
    net.dense_bias = float(at.dense_bias[0])
    number = sum(p.size for p in at.params)
    return flat[number:3 * number]


def _calibrate(rows: DataFrame, net: Network) -> None:
    """Slope, shift and thresholds from all the rows, which Spark counts by language, label and logit."""
    schema = staging.fields(lang="string", toxic="int", logit="int")
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(2)):
                found = np.rint(np.clip(sent.value.logits(data, offsets), -60, 60) * LOGIT_STEPS)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in (0, 1)), pa.array(found.astype(np.int32))], names=schema.names)

    counted = staging.stage(rows.select("lang", "toxic", "text").mapInArrow(logits, schema).groupBy("lang", "toxic", "logit").count())
    all_ = counted.groupBy("toxic", "logit").agg(F.sum("count").alias("n")).orderBy("toxic", "logit").toArrow()
    y, n = all_["toxic"].to_numpy().astype(int), all_["n"].to_numpy().astype(float)
    net.slope, net.shift = platt(all_["logit"].to_numpy() / LOGIT_STEPS, y, n / n.mean(), n[y == 0].sum(), n[y == 1].sum())
    score = 1 / (1 + F.exp(-(F.col("logit") / LOGIT_STEPS * net.slope + net.shift)))
    hit = lambda cut, what: F.sum(F.when(score >= cut, what).otherwise(0))
    toxic = F.col("count") * F.col("toxic")
    found = counted.groupBy("lang").agg(
        F.sum(toxic).alias("toxic"), F.array(*[hit(c, F.col("count")) for c in CUTS]).alias("hits"),
        F.array(*[hit(c, toxic) for c in CUTS]).alias("true")).collect()
    for r in found:
        if r["lang"] and r["toxic"] >= 5:
            net.thresholds[r["lang"]] = best_cut(r["hits"], r["true"], r["toxic"])
    total = lambda c: [sum(x) for x in zip(*(r[c] for r in found), strict=True)]
    net.thresholds[""] = best_cut(total("hits"), total("true"), sum(r["toxic"] for r in found))


def fit(documents: DataFrame, labels: DataFrame, rows: int | None = None) -> Network | None:
    """Train on all texts of (doc_id, lang, text) that labels (doc_id, toxic) mark; None without both kinds.

    Only sums of fixed size come to the driver: two counts a bucket, then a network a round, 19 MB at most.
    With `rows`, a sample of so many rows is learned from instead (`fit_sample`).
    """
    columns = staging.plain(documents, {"doc_id": "bigint", "lang": "string", "text": "string"})
    marks = staging.plain(labels, {"doc_id": "bigint", "toxic": "int"}).where("toxic in (0, 1)")
    if rows is not None:
        return fit_sample(columns, marks, rows)
    found = _labelled(columns, marks)
    there = {(r["kept"], r["toxic"]): r["count"] for r in found.groupBy("kept", "toxic").count().collect()}
    if len({y for _, y in there}) < 2:
        return None
    apart = len(there) == 4  # both kinds on both sides; else all rows train and calibrate
    learned, kept = (found.where("not kept"), found.where("kept")) if apart else (found, found)
    totals = np.array([sum(n for (k, y), n in there.items() if y == kind and not (apart and k)) for kind in (0, 1)])
    net = untrained(_odds(learned, totals))
    moments = None
    shards = found.agg(F.count_distinct("shard")).first()[0]
    for i in range(ROUNDS):
        moments = _round(learned, net, totals / totals.sum(), i * math.ceil(int(totals.sum()) / shards / 32), moments)
    _calibrate(kept, net)
    return net


def fit_sample(columns: DataFrame, marks: DataFrame, rows: int) -> Network | None:
    """Train on about `rows` marked texts on the driver; None without both kinds.

    The sample's hashed words come to the driver, not texts: SPARE * rows times WINDOWS * WINDOW_WORDS
    words of 16 bytes at most. Only the sample's ids, SPARE * rows at most, are broadcast; no text is
    shuffled. Every fifth row of the sample calibrates and is not trained on.
    """
    marks, share = sample(marks, rows)
    marks = staging.stage(marks)
    taken = columns.where(F.col("text").isNotNull()).join(staging.bounded(marks, int(SPARE * rows)), "doc_id")
    schema = staging.fields(doc_id="bigint", lang="string", toxic="int", words="binary")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(3)):
                buckets, texts = word_buckets(data, offsets)
                edges = np.searchsorted(texts, np.arange(hi - lo + 1))
                # A word that comes again answers no filter of one word higher; runs are kept whole.
                own = [b"".join(buckets[p].tobytes() for p in parts) for parts in spread(edges)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(lo, hi - lo) for c in range(3)] + [pa.array(own, pa.binary())], names=schema.names)

    found = taken.select("doc_id", "lang", "toxic", "text").mapInArrow(hashed, schema)
    # Rows that repeat, or share an id, are taken once and within the bound.
    found = found.withColumn("at", staging.place("doc_id", "words", "toxic")).dropDuplicates(["at", "lang"])
    found = found.orderBy("at", "lang").limit(int(SPARE * rows)).drop("at").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("words", "ascending")])
    labels = found["toxic"].to_numpy().astype(int)
    texts = [np.frombuffer(w, np.int32).reshape(-1, 1 + len(STARTS)) for w in found["words"].to_pylist()]
    if len(set(labels)) < 2:
        return None
    kept = np.arange(len(labels)) % 5 == 4
    if len(set(labels[kept])) < 2 or len(set(labels[~kept])) < 2:
        kept = np.zeros(len(labels), bool)
    net = train([t for t, k in zip(texts, kept, strict=True) if not k], labels[~kept])
    use = kept if kept.any() else np.ones(len(labels), bool)
    logits = np.array([
        (np.maximum(net.pool(t, np.zeros(len(t), int), 1) + net.bias, 0) @ net.dense + net.dense_bias)[0]
        for t, k in zip(texts, use, strict=True) if k])
    # Each kept row stands for as many rows as its kind was thinned by.
    weights = np.array([1 / max(share[int(y)], 1e-9) for y in labels[use]])
    calibrate(net, logits, labels[use], [c for c, k in zip(found["lang"].to_pylist(), use, strict=True) if k],
              weights / weights.mean())
    return net


def score(documents: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang, score, flagged): flagged by the threshold of the row's language."""
    schema = staging.fields(doc_id="bigint", lang="string", score="double")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(2)):
                found = net.score(data, offsets) if net else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                     pa.array(found.astype(float))], names=schema.names)

    scored = staging.plain(documents, {"doc_id": "bigint", "lang": "string", "text": "string"}).mapInArrow(rows, schema)
    return scored.withColumn("flagged", F.col("score") >= threshold(net, F.col("lang")))


def threshold(net: Network | None, lang: Column) -> Column:
    cuts = net.thresholds if net else {}
    other = F.lit(cuts.get("", 0.5 if net is None else math.inf))
    named = [F.lit(x) for name, cut in sorted(cuts.items()) if name for x in (name, cut)]
    return F.coalesce(F.try_element_at(F.create_map(*named), lang), other) if named else other


def classify(documents: DataFrame, labels: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """Learn from the labels where `learn_from` (a condition on doc_id) holds and score all rows.

    A document with several labels is learned from once for each.
    """
    marks = staging.plain(labels, {"doc_id": "bigint", "toxic": "int"})
    return score(documents, fit(documents, marks if learn_from is None else marks.where(learn_from)))
