"""Packing token sequences by a grouping genetic algorithm on islands.

Documents become token ids and an end id, and are cut into pieces only where longer than a
sequence. Pieces are dealt by hash to blocks of about BLOCK pieces; a block is one packing problem.
ISLANDS populations work on each block, as tasks of their own. An individual is a grouping of the
block's pieces to bins. Crossover injects whole well-filled bins of one parent into the other,
removes the bins that hold a piece twice now, and best-fits the displaced pieces again. After an
epoch each island's elite migrates to the next island of its block, unless the block has reached
the least possible number of bins. What the best individual of a block left badly filled is
dissolved and packed again in blocks over what all blocks left, until that fits one block or
nothing is gained.

Nulls: a null text is empty and gives one piece, the end id alone; null and repeated ids are kept,
each row being packed by itself. Empty tables give empty results. Other columns are not read.
The vocabulary's path is a parameter; the file is read on each executor.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import staging

CAPACITY = 4096
END_ID = 1
BLOCK = 4096
ISLANDS = 2
EPOCHS = 3
POPULATION = 6
GENERATIONS = 12
PATIENCE = 4
#: Bins filled less than this are dissolved for the next level.
FILLED = 0.98
CACHE_WORDS = 1_000_000
_MARKS = ".,;:!?#*$%&|<>"

_SPACES = re.compile("[^\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")


class Coder:
    """Token ids of texts. No token spans white space, so ids of words are kept and joined."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        split = [self._split(t) if t else [] for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        known = self.words
        new = set(chain.from_iterable(split)).difference(known)
        # Letters and a closing run of marks are tokenized apart, so they are looked up apart (beyond
        # Latin-1, folding a letter may give a combining mark, which would join the run).
        cores = {w: c for w in new if (c := w.rstrip(_MARKS)) != w and c.isalpha() and max(c) < "\u0100"}
        single = new.difference(cores).union(cores.values(), [w[len(c):] for w, c in cores.items()]).difference(known)
        single = list(single)
        for word, found in zip(single, self.tokenizer.encode_batch_fast(single, add_special_tokens=False), strict=True):
            known[word] = array("I", found.ids).tobytes()
        for word, core in cores.items():
            known[word] = known[core] + known[word[len(core):]]
        return [b"".join(map(known.__getitem__, words)) for words in split]

    @staticmethod
    def _split(text: str) -> list[str]:
        """Words; in small letters where that is sure to be the tokenizer's own folding.

        A special token's string is that token, as the library has it, and only as it is spelt; a text
        that may hold one is not folded.
        """
        # Python also splits at the separators 0x1C-0x1F, which the vocabulary takes for symbols.
        words = _SPACES.findall if _SEPARATORS.search(text) else str.split
        if "<|" in text or not _latin(text):
            return words(text)
        return words(text.lower())


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(2)
def coder(path: str) -> Coder:
    return Coder(path)


def pieces(documents: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): ids of a document cut to sequences."""
    types = {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint"}
    schema = staging.fields(**types, **({"ids": "binary"} if with_ids else {}))
    end, most = np.array([END_ID], "<u4").tobytes(), CAPACITY * 4

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out: list[list] = [[] for _ in schema]
                for i, ids in zip(part.column(0).to_pylist(), coder(path).encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), most)):
                        own = ids[at:at + most]
                        row = (i, piece, at // 4, len(own) // 4, zlib.crc32(own), own)
                        for column, value in zip(out, row, strict=False):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary()], strict=False)],
                    names=schema.names)

    return staging.plain(documents, {"doc_id": "bigint", "text": "string"}).mapInArrow(rows, schema)


class Grouping:
    """Bins of items: members of each bin and their fill."""

    def __init__(self, bins: list[list[int]], fills: list[int]):
        self.bins, self.fills = bins, fills

    def cost(self) -> tuple[int, float]:
        """Fewer bins are better; then fuller ones."""
        full = np.array(self.fills, float) / CAPACITY
        return len(self.bins), -float((full**2).sum())

    def assignment(self, n: int) -> np.ndarray:
        out = np.empty(n, np.int32)
        for b, members in enumerate(self.bins):
            out[members] = b
        return out


def best_fit(grouping: Grouping, items: list[int], lengths: list[int]) -> Grouping:
    """Put items, in the given order, each where it leaves least room; changes `grouping`."""
    bins, fills = grouping.bins, grouping.fills
    room = sorted((CAPACITY - f, b) for b, f in enumerate(fills))
    for item in items:
        size = lengths[item]
        at = bisect_left(room, (size, -1))
        if at == len(room):
            bins.append([item])
            fills.append(size)
            insort(room, (CAPACITY - size, len(bins) - 1))
            continue
        left, b = room.pop(at)
        bins[b].append(item)
        fills[b] += size
        if left > size:
            insort(room, (left - size, b))
    return grouping


def crossover(a: Grouping, b: Grouping, lengths: list[int], rng: np.random.Generator) -> Grouping:
    """Whole well-filled bins of `b` go into `a`; what they displace is best-fitted, longest first."""
    order = np.argsort(-np.array(b.fills), kind="stable")
    best = order[: max(1, len(order) // 2)]
    injected = rng.choice(best, max(1, int(len(best) * rng.uniform(0.2, 0.8))), replace=False)
    taken = np.zeros(len(lengths), bool)
    for x in injected:
        taken[b.bins[x]] = True
    bins, fills, displaced = [list(b.bins[x]) for x in injected], [b.fills[x] for x in injected], []
    for members, fill in zip(a.bins, a.fills, strict=True):
        hit = taken[members]
        if hit.any():
            displaced += [m for m, h in zip(members, hit, strict=True) if not h]
        else:
            bins.append(list(members))
            fills.append(fill)
    displaced.sort(key=lambda m: -lengths[m])
    return best_fit(Grouping(bins, fills), displaced, lengths)


def mutate(a: Grouping, lengths: list[int], rng: np.random.Generator) -> Grouping:
    """Dissolve the least filled bins and some others, and best-fit their items."""
    n = len(a.bins)
    gone = set(np.argsort(a.fills, kind="stable")[: max(1, n // 50)].tolist())
    gone |= set(rng.choice(n, max(1, n // 20), replace=False).tolist())
    loose = [m for b in gone for m in a.bins[b]]
    loose.sort(key=lambda m: -lengths[m])
    keep = [b for b in range(n) if b not in gone]
    return best_fit(Grouping([list(a.bins[b]) for b in keep], [a.fills[b] for b in keep]), loose, lengths)


def from_assignment(assignment: np.ndarray, lengths: list[int]) -> Grouping:
    bins: list[list[int]] = [[] for _ in range(int(assignment.max()) + 1)]
    for item, b in enumerate(assignment.tolist()):
        bins[b].append(item)
    return Grouping(bins, [sum(lengths[m] for m in members) for members in bins])


def evolve(lengths: list[int], seed: int, elites: list[np.ndarray]) -> Grouping:
    """The best grouping of one island after an epoch; stops at the least possible number of bins."""
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // CAPACITY)
    order = sorted(range(len(lengths)), key=lambda m: -lengths[m])
    population = [from_assignment(e, lengths) for e in elites] or [best_fit(Grouping([], []), order, lengths)]
    best = min(population, key=Grouping.cost)
    while len(population) < POPULATION and len(best.bins) > least:
        # Nearly longest first: keys shaken, so that individuals differ.
        shaken = np.argsort(-np.array(lengths) * rng.uniform(0.7, 1.0, len(lengths)), kind="stable").tolist()
        population.append(best_fit(Grouping([], []), shaken, lengths))
        best = min(population, key=Grouping.cost)
    still = 0
    for _ in range(GENERATIONS):
        if len(best.bins) <= least or still >= PATIENCE:
            break
        population.sort(key=Grouping.cost)
        parents = population[: POPULATION // 2]
        children = []
        for _ in range(POPULATION - len(parents)):
            i, j = rng.integers(len(parents)), rng.integers(len(population))
            child = crossover(parents[i], population[j], lengths, rng)
            children.append(mutate(child, lengths, rng) if rng.random() < 0.3 else child)
        population = parents + children
        now = min(population, key=Grouping.cost)
        still = 0 if now.cost() < best.cost() else still + 1
        best = min(best, now, key=Grouping.cost)
    return best


_ITEM = "block bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, salt bigint"
_BEST = "block bigint, island int, bins int, cost double, least boolean, assignment binary"


def _ordered(items: pa.Table) -> pa.Table:
    """A block's items in an order that rows' places do not change."""
    return items.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "start", "ids_crc32")])


def _epoch(items: DataFrame, elites: DataFrame | None, epoch: int) -> DataFrame:
    """The best individual of each island of each block."""
    schema = staging.fields(**dict(x.split() for x in _BEST.split(", ")))

    def island(key: tuple, own: pa.Table, sent: pa.Table | None) -> pa.Table:
        block, number = key[0].as_py(), key[1].as_py()
        if not own.num_rows:
            return pa.Table.from_pylist([], schema=pa.schema([
                ("block", pa.int64()), ("island", pa.int32()), ("bins", pa.int32()), ("cost", pa.float64()),
                ("least", pa.bool_()), ("assignment", pa.binary())]))
        lengths = _ordered(own)["length"].to_pylist()
        known = [] if sent is None else [
            np.frombuffer(x, np.int32) for x in sent.sort_by([("island", "ascending")])["assignment"].to_pylist()]
        best = evolve(lengths, hash((block, number, epoch)) & 0xFFFFFFFF, known)
        bins, cost = best.cost()
        return pa.table({
            "block": pa.array([block], pa.int64()), "island": pa.array([number], pa.int32()),
            "bins": pa.array([bins], pa.int32()), "cost": pa.array([cost], pa.float64()),
            "least": pa.array([bins <= -(-sum(lengths) // CAPACITY)]),
            "assignment": pa.array([best.assignment(len(lengths)).tobytes()], pa.binary())})

    spread = items.withColumn("at", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    grouped = spread.groupBy("block", "at")
    if elites is None:
        return grouped.applyInArrow(lambda key, own: island(key, own, None), schema)
    # An island's own best stays, and goes to the next island as well.
    moved = elites.withColumn("at", F.explode(F.array("island", (F.col("island") + 1) % ISLANDS)))
    return grouped.cogroup(moved.groupBy("block", "at")).applyInArrow(island, schema)


def _level(items: DataFrame, level: int) -> DataFrame:
    """Items (of several blocks) with their bin, place in it and the bin's fill."""
    found = staging.stage(_epoch(items, None, 0))
    for epoch in range(1, EPOCHS):
        done = found.where("least").select("block").distinct()
        rest = found.join(done, "block", "left_anti")
        if rest.isEmpty():
            break
        better = _epoch(items.join(done, "block", "left_anti"), rest, epoch)
        found = staging.stage(found.join(rest.select("block").distinct(), "block", "left_anti").unionByName(better))
    first = found.groupBy("block").agg(F.min(F.struct("bins", "cost", "island")).alias("best"))
    best = found.join(first.select("block", F.col("best.island").alias("island")), ["block", "island"]).select(
        "block", "assignment")
    schema = staging.fields(**dict(x.split() for x in (_ITEM + ", level int, bin int, offset bigint, fill bigint").split(", ")))

    def place(key: tuple, own: pa.Table, chosen: pa.Table) -> pa.Table:
        own = _ordered(own)
        bins = np.frombuffer(chosen["assignment"][0].as_py(), np.int32) if own.num_rows else np.zeros(0, np.int32)
        lengths = own["length"].to_numpy()
        order = np.argsort(bins, kind="stable")
        sums = np.concatenate([[0], np.cumsum(lengths[order])])
        first = np.searchsorted(bins[order], bins[order])
        offset, fill = np.empty(len(bins), np.int64), np.bincount(bins, lengths) if len(bins) else np.zeros(0)
        offset[order] = sums[:-1] - sums[first]
        for name, values in (("level", pa.array(np.full(len(bins), level, np.int32))), ("bin", pa.array(bins)),
                             ("offset", pa.array(offset)), ("fill", pa.array(fill[bins].astype(np.int64)))):
            own = own.append_column(name, values)
        return own.select(schema.names)

    return staging.stage(items.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(place, schema))


def _salted(cut: DataFrame) -> DataFrame:
    """The pieces, written with a number of their own, so that equal rows are dealt apart, and alike on a retry."""
    return staging.stage(cut.select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("salt")))


def _dealt(items: DataFrame, number: int, level: int) -> DataFrame:
    own = F.xxhash64("doc_id", "piece", "start", "ids_crc32", "salt", F.lit(level))
    names = [x.split()[0] for x in _ITEM.split(", ")][1:]
    return items.select(F.pmod(own, F.lit(number)).cast("bigint").alias("block"), *names)


def pack(cut: DataFrame) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    rest = _salted(cut)
    number, level, parts = rest.count(), 0, []
    while number:
        blocks = -(-number // BLOCK)
        placed = _level(_dealt(rest, blocks, level), level)
        loose = placed.where(F.col("fill") < int(FILLED * CAPACITY))
        again = loose.count() if blocks > 1 else 0
        if blocks == 1 or not again or again > 0.9 * number:
            parts.append(placed)
            break
        parts.append(placed.where(F.col("fill") >= int(FILLED * CAPACITY)))
        rest, number, level = loose, again, level + 1
    if not parts:
        return rest.drop("salt").select("*", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # 6 bits of level, 36 of block, 20 of bin: a block has at most as many bins as pieces.
    sequence = F.shiftleft(F.col("level").cast("bigint"), 56) + F.shiftleft("block", 20) + F.col("bin")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")
