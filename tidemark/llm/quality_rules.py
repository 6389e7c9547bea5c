"""Quality rules by weak supervision.

Hand-written rules read a document's features and vote good, bad or nothing. Which rules to trust
is learned without labels: expectation-maximisation over the vote patterns estimates, for every
rule, how often it votes good or bad on good and on bad documents, and how many documents are good.
The posterior probability of being good replaces a filter that wants every rule to pass.

A rule votes three ways, so there are at most 3**len(RULES) patterns. Only the pattern counts reach
the driver, whatever the number of documents, and all documents are in the counts.

Nulls: a null text has no words and fails the base rule; a null or repeated doc_id is kept as it
is, one result row per input row. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import staging
from tidemark.llm.wordhash import SMALL_CHUNK, SPACE, chunks, repeated, runs, slice_hashes, spans

WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
KEEP_FROM = 0.5
SMOOTHING = 5
ANCHOR = 0.95

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_upper", "n_letters", "n_marked", "n_pipes", "n_stops", "n_distinct", "n_plain"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?#*$%&|<>"]] = True
_ODD = np.zeros(256, bool)
_ODD[33:48] = _ODD[58:65] = _ODD[91:97] = _ODD[123:127] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:"]] = True


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of `values` over each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Feature counts of each text of a chunk."""
    n = len(offsets) - 1
    word = ~SPACE[data]
    starts, ends, texts = spans(word, offsets)
    of_text = lambda t: np.bincount(t, minlength=n)
    hashes = slice_hashes(data, starts, ends)

    windows, first = runs(hashes, texts, WINDOW)
    again, _ = repeated(windows, texts[first])
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, first[again], 1)
    np.add.at(cover, first[again] + WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0

    line_from, line_to, line_text = spans(data != 10, offsets)
    words_in = np.searchsorted(starts, line_to) - np.searchsorted(starts, line_from)
    full = words_in > 0
    line_from, line_to, line_text = line_from[full], line_to[full], line_text[full]
    _, later = repeated(slice_hashes(data, line_from, line_to), line_text)

    _, word_later = repeated(hashes, texts)
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    odd = np.concatenate([[0], np.cumsum(_ODD[data])])
    plain = odd[ends] - odd[starts] == _STOP[last]  # letters and digits, a stop at the end at most
    return {
        "n_words": of_text(texts),
        "word_chars": _sums(word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_dup_lines": of_text(line_text[later]),
        "n_repeat_words": of_text(texts[covered]),
        "n_lines": of_text(line_text),
        "n_upper": _sums(_UPPER[data], offsets),
        "n_letters": _sums(_LETTER[data], offsets),
        "n_marked": of_text(texts[_MARK[last]]),
        "n_pipes": _sums(data == ord("|"), offsets),
        "n_stops": of_text(texts[_STOP[last]]),
        "n_distinct": of_text(texts[~word_later]),
        "n_plain": of_text(texts[plain]),
    }


def with_features(documents: DataFrame) -> DataFrame:
    """doc_id and the features of the whole text."""
    schema = staging.fields(doc_id="bigint", **{f: "bigint" for f in FEATURES})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1), SMALL_CHUNK):
                found = features(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *[pa.array(found[f], pa.int64()) for f in FEATURES]],
                    names=["doc_id", *FEATURES])

    columns = staging.plain(documents, {"doc_id": "bigint", "text": "string"})
    return columns.mapInArrow(rows, schema)


def base_failed() -> Column:
    """Too short, or more than a fifth of the words in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Each rule votes 1 (good), -1 (bad) or 0 (abstains).

    Kinds of junk exclude each other, so the absence of one flaw says little: most rules only
    accuse or abstain, and a few that look at the prose itself vote both ways.
    """
    def vote(bad: Column, good: Column | None = None) -> Column:
        out = F.when(bad, -1)
        return (out if good is None else out.when(good, 1)).otherwise(0)

    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    mean_word = F.col("word_chars") / words
    upper = F.col("n_upper") / F.greatest(F.col("n_letters"), F.lit(1))
    plain = F.col("n_plain") / words
    stops = F.col("n_stops") / words
    return {
        "length": vote(F.col("n_words") < LEAST_WORDS),
        "repeats": vote(100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        "symbols": vote(F.col("n_symbols") / words > 0.25),
        "marks": vote(F.col("n_marked") / words > 0.2),
        "capitals": vote((F.col("n_letters") >= 40) & (upper > 0.3)),
        "tables": vote(F.col("n_pipes") / words > 0.1),
        "lines": vote((F.col("n_lines") >= 4) & (F.col("n_dup_lines") / lines > 0.3)),
        "variety": vote(((F.col("n_words") >= 50) & (F.col("n_distinct") / words < 0.15))
                        | ((F.col("n_words") >= 15) & (F.col("n_distinct") < 0.3 * F.least(F.col("n_words"), F.lit(60))))),
        "word_size": vote((mean_word < 2) | (mean_word > 14)),
        "prose": vote((F.col("n_words") >= 30) & (plain < 0.7), plain > 0.9),
        "stops": vote((F.col("n_words") >= 100) & (stops < 0.01), stops.between(0.03, 0.5) & (plain > 0.9)),
    }


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200,
                             tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of good for each pattern, the share of good, and vote rates [class, rule, vote].

    patterns: (p, rules) of -1, 0, 1. The start takes a document with an accusation for bad. A vote
    means what it says: a rule's bad votes are never more likely on good documents than on bad ones,
    nor its good votes less likely. What some rule praises and none accuses is held to be good, as an
    anchor: else few documents, or mostly bad ones, could let the classes change their meaning.
    A prior of SMOOTHING documents a class keeps rates of few votes from being extreme.
    """
    votes = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    balance = (patterns == 1).sum(1) - 3.0 * (patterns == -1).sum(1)
    good = 1 / (1 + np.exp(-balance - 0.5))
    anchor = (patterns >= 0).all(1) & (patterns > 0).any(1)
    prior = np.array([[0.3, 0.6, 0.1], [0.02, 0.6, 0.38]])
    share, rates = np.array([0.5, 0.5]), np.tile(prior[:, None, :], (1, patterns.shape[1], 1))
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        rates = np.einsum("cp,pmv->cmv", weight, votes) + SMOOTHING * prior[:, None, :]
        rates /= rates.sum(2, keepdims=True)
        for v, (low, high) in ((0, (1, 0)), (2, (0, 1))):
            wrong = rates[low, :, v] > rates[high, :, v]
            mean = (rates[0, :, v] + rates[1, :, v]) / 2
            rates[:, wrong, v] = mean[wrong]
        rates[:, :, 1] = np.maximum(1 - rates[:, :, 0] - rates[:, :, 2], 1e-12)
        share = (weight.sum(1) + 1) / (weight.sum() + 2)
        logs = np.einsum("pmv,cmv->pc", votes, np.log(rates)) + np.log(share)
        logs -= logs.max(1, keepdims=True)
        new = np.exp(logs[:, 1]) / np.exp(logs).sum(1)
        new[anchor] = np.maximum(new[anchor], ANCHOR)
        done = np.abs(new - good).max(initial=0) < tolerance
        good = new
        if done:
            break
    return good, share, rates


def learn(voted: DataFrame, names: list[str]) -> tuple[DataFrame, dict]:
    """A table of patterns with the posterior of good, and the estimates for a report."""
    spark: SparkSession = voted.sparkSession
    found = voted.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3**rules rows
    patterns = np.array([[ord(c) - ord("1") for c in r["pattern"]] for r in found]).reshape(-1, len(names))
    good, share, rates = expectation_maximisation(patterns, np.array([r["count"] for r in found], float))
    rows = [(r["pattern"], float(g)) for r, g in zip(found, good, strict=True)]
    return spark.createDataFrame(rows, "pattern string, quality double"), {
        "share_good": float(share[1]),
        "accuracy": {n: float(rates[1, i, 2] * share[1] + rates[0, i, 0] * share[0]) for i, n in enumerate(names)},
    }


def _voted(featured: DataFrame) -> DataFrame:
    return featured.withColumns({
        "base_failed": base_failed(), "pattern": F.concat(*[(v + 1).cast("string") for v in rules().values()])})


def score(documents: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """One row per document: features, votes, quality (posterior of good), base_failed, kept."""
    voted = staging.stage(_voted(with_features(documents)))
    learned, _ = learn(voted, list(rules()))
    return voted.join(F.broadcast(learned), "pattern").withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))


def keep(documents: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows that `score` keeps, with their columns.

    Features are made twice, once for the pattern counts and once beside the rows: that costs less
    than to send texts through a join.
    """
    learned, _ = learn(_voted(with_features(documents)), list(rules()))

    def rows(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for lo, hi, data, offsets in chunks(texts, SMALL_CHUNK):
            found = features(data, offsets)
            yield lo, hi, [pa.array(found[f], pa.int64()) for f in FEATURES]

    voted = _voted(staging.annotated(documents, rows, **dict.fromkeys(FEATURES, "bigint")))
    return voted.join(F.broadcast(learned), "pattern").where(
        ~F.col("base_failed") & (F.col("quality") >= keep_from)).select(*documents.columns)
