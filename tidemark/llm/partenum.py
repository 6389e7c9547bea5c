"""Jaccard similarity join of documents on word n-grams by PartEnum signatures.

A document is the set of its distinct word n-grams. Two sets of Jaccard similarity s or more differ
in few elements, at most (1 - s) / (1 + s) of their sizes' sum. Sets are dealt to size bands that
overlap, so that any two similar sets meet in one band (`Bands`). Within a band the domain of n-grams
is partitioned by hash into n1 groups of n2 parts, and for each group all subsets of n2 - k2 parts are
enumerated; a signature is the hash of what a set has in such a subset. Sets that differ in at most
k elements must agree in a known number of signatures, not only in one. That sharpens the filter
without losing a pair:

1. Signatures are ordered by hash. Of two similar sets, the first ones of each share at least `need`.
   Only these are written. Those that no other set has are dropped, most of them by a map of fixed
   size before they cross the network again; a set with fewer than `need` left has no partner.
2. Of what is left, only the rarest signatures are looked at, as many as must hold a common one.
3. Each set is verified against one hub in every group of sets with a common signature, the one with
   the most shared signatures. Verified links are merged to components.
4. Groups that hold several components without their hub are searched for further pairs, each set of
   members once, between components only: sketches of a finer partition are compared, a byte a part,
   and pairs are verified if as many bytes agree as must. Large groups are split into blocks, so that a task holds two blocks at most.
   Two blocks list no more pairs than would join their components; only those of which a pair fails
   come again, without it, and list more (`_rest`).

Verification is exact on 64-bit hashes of n-grams. Equal sets (64-bit hash of the set) are one
class throughout, and copies met by one task write their signatures once; pairs are never expanded
within a class. All links between different sets that decide components are found; links within a
component that is connected already are not listed.

Nulls and oddities: a null or empty text has an empty set, is linked with nothing and is its own
component. A document with fewer words than n has one n-gram, all its words. Rows with a null id are
linked with nothing and have a null component. Rows that repeat an id count as linked through it.
Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import staging
from tidemark.llm.components import components
from tidemark.llm.wordhash import LOWER, SMALL_CHUNK, SPACE, chunks, mix, runs, slice_hashes, spans

_U = np.uint64
_PART = _U(0x8CB92BA72F3D8DD7)
_BAND = _U(0xC2B2AE3D27D4EB4F)
#: A band's smallest size over its largest, for similarity 0.9 and for 0.8; see `Bands`.
SPAN = {90: 0.62, 80: 0.45}
#: Signatures that must be shared, as a part of the differences allowed.
EXTRA = 0.2
SMALL = 3
#: Parts of a sketch for each difference allowed.
FINE = 4
BLOCK = 512
#: Bits of the map of shared signatures that tasks get (16 MB), and of one of its segments.
MAP_BITS, SEGMENT = 1 << 27, 1 << 16
#: Pairs a class that two blocks list at first, beside those that join components.
FIRST_SHARE = 4
MOST_SIZE = 1 << 40


class Bands:
    """Size bands and their signature schemes for similarity `percent` / 100.

    Band i holds sizes low[i] to high[i]. The smallest size that is similar to one above high[i] is
    low[i + 1], so any two similar sets share the first band that holds the larger one. A set is thus
    in the first band that holds it (its home) and perhaps in the next.
    """

    def __init__(self, percent: int):
        self.percent = percent
        span = SPAN.get(percent, max(0.3, percent / 100 * 0.6))
        low, high = [], []
        size = 1
        while self.differences(size) == 0:
            size += 1
        upper = size - 1
        while upper < MOST_SIZE:
            low.append(-(-percent * (upper + 1) // 100))
            upper = max(int(low[-1] / span), upper + 1)
            high.append(upper)
        self.low, self.high = np.array(low), np.array(high)
        self.least = size
        most = [self.differences(h) for h in high]
        self.schemes = [self._scheme(k) for k in most]

    def differences(self, size: int) -> int:
        """Elements in which a set of `size` and any similar one may differ."""
        return (size + size * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)

    @staticmethod
    def _scheme(k: int) -> tuple[int, int, int, int]:
        """(n1, n2, parts in a subset, need) for at most k differences.

        Few differences: one group, all subsets of k + 3 parts that leave out k. Else pairs of parts,
        k2 = 1, as many that `need` signatures are shared.
        """
        if k <= SMALL:
            return 1, k + 3, 3, 1
        need = max(1, round(EXTRA * (k + 1)))
        return -(-(k + need) // 2), 2, 1, need

    @lru_cache(1 << 16)  # noqa: B019
    def shared(self, band: int, k: int) -> int:
        """Signatures that two sets with at most k differences share at least."""
        n1, n2, m, _ = self.schemes[band]
        if m == 1:
            return n1 * n2 - k
        total, left = n1 * comb(n2, m), k
        for d in range(n2):
            step = min(left, n1)
            total -= step * (comb(n2 - d, m) - comb(n2 - d - 1, m))
            left -= step
        return total

    def signatures(self, band: int) -> int:
        n1, n2, m, _ = self.schemes[band]
        return n1 * comb(n2, m)


@lru_cache(4)
def bands(percent: int) -> Bands:
    return Bands(percent)


class Sets:
    """Distinct n-grams of the texts of one chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        data = LOWER[data]
        n = len(offsets) - 1
        starts, ends, texts = spans(~SPACE[data], offsets)
        words = slice_hashes(data, starts, ends)
        number = np.bincount(texts, minlength=n)
        grams, first = runs(words, texts, size)
        owner = texts[first]
        if size > 1:  # texts with fewer words: all of them as one
            for k in range(1, size):
                few, at = runs(words, texts, k)
                short = number[texts[at]] == k
                grams = np.concatenate([grams, mix(few[short] + _U(k))])
                owner = np.concatenate([owner, texts[at][short]])
        key = mix(grams + owner.astype(_U) * _PART)
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
        keep = np.sort(order[new])
        keep = keep[np.argsort(owner[keep], kind="stable")]
        self.grams, self.owner = grams[keep], owner[keep].astype(np.int64)
        self.sizes = np.bincount(self.owner, minlength=n)
        total = np.zeros(n, _U)
        np.add.at(total, self.owner, mix(self.grams ^ _BAND))
        self.classes = mix(total + self.sizes.astype(_U) * _PART).astype(np.int64)

    def home(self, b: Bands) -> np.ndarray:
        """Home band of each set, -1 for sets too small to be similar to a different one."""
        return np.where(self.sizes >= b.least, np.searchsorted(b.high, self.sizes), -1)

    def signatures(self, b: Bands, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All signatures of each set in its given band (-1: none), and their numbers' offsets."""
        n = len(self.sizes)
        parts = np.array([b.schemes[i][0] * b.schemes[i][1] if i >= 0 else 0 for i in band], np.int64)
        base = np.concatenate([[0], np.cumsum(parts)])
        use = np.flatnonzero(parts[self.owner] > 0)
        owner, grams = self.owner[use], self.grams[use]
        spread = mix(grams ^ _PART)
        part = ((spread >> _U(32)) * parts[owner].astype(_U)) >> _U(32)
        sums = np.zeros(base[-1], _U)
        np.add.at(sums, base[owner] + part.astype(np.int64), mix(grams + _BAND))
        of = np.repeat(np.arange(n), parts)
        index = (np.arange(base[-1]) - base[of]).astype(_U)
        sums = mix(sums + mix(index * _PART + band[of].astype(_U) * _BAND))
        small = np.flatnonzero([i >= 0 and b.schemes[i][2] > 1 for i in band])
        if not len(small):
            return sums, base
        pieces, sizes = [], []
        own = set(small.tolist())
        for i in range(n):
            row = sums[base[i]:base[i + 1]]
            if i in own:
                chosen = np.array(list(combinations(range(len(row)), b.schemes[band[i]][2])))
                row = mix(row[chosen].sum(1) + (1 << chosen).sum(1).astype(_U) * _PART)
            pieces.append(row)
            sizes.append(len(row))
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes)])

    def sketch(self, b: Bands, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A byte of what a set has in each of FINE parts a difference; offsets; bytes that must agree.

        Every element in which two sets differ changes one part at most.
        """
        n = len(self.sizes)
        most = np.array([b.differences(h) for h in b.high])
        parts = np.where(band >= 0, FINE * (most[np.maximum(band, 0)] + 1), 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        use = np.flatnonzero(parts[self.owner] > 0)
        owner, grams = self.owner[use], self.grams[use]
        spread = mix(grams + _PART)
        part = ((spread >> _U(32)) * parts[owner].astype(_U)) >> _U(32)
        sums = np.zeros(base[-1], _U)
        np.add.at(sums, base[owner] + part.astype(np.int64), mix(grams ^ _U(0x5851F42D4C957F2D)))
        return (mix(sums) & _U(0xFF)).astype(np.uint8), base, parts - self.allowed(b) * (parts > 0)

    def allowed(self, b: Bands) -> np.ndarray:
        return (self.sizes + self.sizes * 100 // b.percent) * (100 - b.percent) // (100 + b.percent)

    def first_signatures(self, b: Bands, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The signatures lowest by hash, as many as must hold `need` common ones; offsets; needs."""
        found, base = self.signatures(b, band)
        allowed = self.allowed(b)
        need = np.array([b.schemes[i][3] if i >= 0 else 0 for i in band], np.int64)
        length = np.array([
            b.signatures(i) - b.shared(i, int(k)) + m if i >= 0 else 0
            for i, k, m in zip(band, allowed, need, strict=True)], np.int64)
        of = np.repeat(np.arange(len(band)), np.diff(base))
        order = np.lexsort((found, of))
        keep = np.arange(len(found)) - base[of] < length[of]
        counts = np.bincount(of[keep], minlength=len(band))
        return found[order][keep].astype(np.int64), np.concatenate([[0], np.cumsum(counts)]), need


def _lists(values: np.ndarray, offsets: np.ndarray, shown: np.ndarray) -> pa.Array:
    """Lists between offsets; null where not shown."""
    sizes = np.diff(offsets) * shown
    kept = np.repeat(shown, np.diff(offsets))
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(places), pa.array(values[kept], pa.int64()))


def _sign(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """Every row's set size and class, and signatures once for each class that a task meets."""
    schema = staging.fields(doc_id="bigint", n_shingles="bigint", class_id="bigint", home="array<bigint>",
                            home_need="int", next="array<bigint>", next_need="int")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bands(percent)
        seen: set[int] = set()
        for batch in batches:
            known = np.asarray(batch.column(0).is_valid())
            for lo, hi, data, offsets in chunks(batch.column(1), SMALL_CHUNK):
                sets = Sets(data, offsets, size)
                new = np.zeros(hi - lo, bool)
                for i in np.flatnonzero(known[lo:hi] & (sets.sizes >= b.least)).tolist():
                    c = int(sets.classes[i])
                    if c not in seen:
                        seen.add(c)
                        new[i] = True
                home = np.where(new, sets.home(b), -1)
                after = np.where((home >= 0) & (sets.sizes >= b.low[np.minimum(home + 1, len(b.low) - 1)]), home + 1, -1)
                columns = []
                for band in (home, after):
                    found, places, need = sets.first_signatures(b, band)
                    columns += [_lists(found, places, band >= 0), pa.array(need, pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sets.sizes, pa.int64()),
                     pa.array(sets.classes), *columns], names=schema.names)

    return documents.mapInArrow(rows, schema)


def _bitmap(sigs: DataFrame) -> np.ndarray:
    """Which lowest bits the signatures have, packed: MAP_BITS / 8 bytes, whatever the table's size."""
    schema = staging.fields(segment="int", bits="binary")

    def mark(key: tuple, own: pa.Table) -> pa.Table:
        bits = np.zeros(SEGMENT, bool)
        bits[own["at"].to_numpy()] = True
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    low = F.col("sig").bitwiseAND(F.lit(MAP_BITS - 1))
    places = sigs.select(F.floor(low / SEGMENT).cast("int").alias("segment"), (low % SEGMENT).cast("int").alias("at")).distinct()
    found = places.groupBy("segment").applyInArrow(mark, schema).toArrow()
    out = np.zeros((MAP_BITS // SEGMENT, SEGMENT // 8), np.uint8)
    for segment, bits in zip(found["segment"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[segment] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _marked(signed: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(sig, class_id, role, need) of the signatures that the map holds: all that it was made of, and a few others."""
    schema = staging.fields(sig="bigint", class_id="bigint", role="tinyint", need="int")
    sent = signed.sparkSession.sparkContext.broadcast(bitmap)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = batch.column(0).to_numpy()
            for role in (0, 1):
                lists, need = batch.column(1 + 2 * role), batch.column(2 + 2 * role).to_numpy()
                sizes = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                sigs = lists.flatten().to_numpy()
                at = sigs & (MAP_BITS - 1)
                there = np.flatnonzero(sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
                own = owner[there]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sigs[there]), pa.array(classes[own]), pa.array(np.full(len(own), role, np.int8)), pa.array(need[own])],
                    names=schema.names)

    return signed.select("class_id", "home", "home_need", "next", "next_need").mapInArrow(rows, schema)


def _fetch(documents: DataFrame, wanted: DataFrame, size: int, percent: int) -> DataFrame:
    """Sets of the wanted (doc_id, class_id): sorted n-grams, and the sketch of each role."""
    schema = staging.fields(doc_id="bigint", class_id="bigint", grams="binary", bytes0="binary", bytes1="binary",
                            shared0="int", shared1="int")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = bands(percent)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1), SMALL_CHUNK):
                sets = Sets(data, offsets, size)
                home = sets.home(b)
                after = np.where((home >= 0) & (sets.sizes >= b.low[np.minimum(home + 1, len(b.low) - 1)]), home + 1, -1)
                short, least = [], []
                for band in (home, after):
                    low, places, agree = sets.sketch(b, band)
                    short.append(pa.array([low[x:y].tobytes() for x, y in zip(places, places[1:], strict=False)], pa.binary()))
                    least.append(pa.array(agree, pa.int32()))
                edges = np.searchsorted(sets.owner, np.arange(hi - lo + 1))
                grams = [np.sort(sets.grams[x:y]).tobytes() for x, y in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sets.classes), pa.array(grams, pa.binary()),
                     *short, *least], names=schema.names)

    ids = wanted.select("doc_id")
    texts = documents.join(staging.bounded(ids, wanted.count()), "doc_id", "left_semi")
    found = texts.select("doc_id", "text").mapInArrow(rows, schema)
    return staging.stage(found.join(wanted, ["doc_id", "class_id"], "left_semi"))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, id_a, id_b, similar): the pairs (a, b) of classes with their documents' ids, compared."""
    schema = staging.fields(a="bigint", b="bigint", id_a="bigint", id_b="bigint", similar="boolean")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(keep)], names=schema.names)

    left = sets.select(F.col("class_id").alias("a"), F.col("doc_id").alias("id_a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("class_id").alias("b"), F.col("doc_id").alias("id_b"), F.col("grams").alias("grams_b"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.select("a", "b", "id_a", "id_b", "grams_a", "grams_b").mapInArrow(rows, schema)


def _links(compared: DataFrame) -> DataFrame:
    """The similar pairs, as pairs (a, b) of document ids."""
    return compared.where("similar").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def forest(a: np.ndarray, b: np.ndarray, number: int) -> np.ndarray:
    """Places of edges (a, b) over nodes 0 to number - 1 that join all that the edges join, no more."""
    root, chosen = np.arange(number), []
    while True:
        x, y = root[a], root[b]
        across = np.flatnonzero(x != y)
        if not len(across):
            return np.array(sorted(chosen), np.int64)
        _, first = np.unique(np.concatenate([x[across], y[across]]), return_index=True)  # an edge of each root
        for e in np.unique(across[first % len(across)]).tolist():
            u, v = int(x[e]), int(y[e])
            while root[u] != u:
                u = int(root[u])
            while root[v] != v:
                v = int(root[v])
            if u != v:
                root[max(u, v)] = min(u, v)
                chosen.append(e)
        while (up := root[root]).tolist() != root.tolist():
            root = up


def _between(groups: DataFrame, share: int) -> DataFrame:
    """(sig, u, v, a, b, whole): pairs of classes of different components, with enough equal sketch bytes.

    groups: sig, u, v (blocks), block, class_id, part (component), bytes, shared, and as further rows
    the pairs (class_id, other) that are known not to be similar. Read in order of (sig, u, v), so that
    only one group of two blocks is held at a time. As many pairs are listed as join what can be joined,
    fewer than there are classes, and up to `share` others a class; `whole` if these are all there are.
    """
    schema = staging.fields(sig="bigint", u="int", v="int", a="bigint", b="bigint", whole="boolean")
    names = ["sig", "u", "v", "block", "class_id", "part", "shared", "other", "bytes"]

    def pairs(u: int, v: int, block: np.ndarray, ids: np.ndarray, part: np.ndarray, least: np.ndarray, short: list,
              bad: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(ids) < 2:
            return ids[:0], ids[:0], np.zeros(0, bool)
        grid = np.frombuffer(b"".join(short), np.uint8).reshape(len(ids), -1)
        rows, columns = np.flatnonzero(block == u), np.flatnonzero(block == v)
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, (1 << 22) // max(1, len(columns) * grid.shape[1]))
        for i in range(0, len(rows), step):
            mine = rows[i:i + step]
            equal = (grid[mine][:, None, :] == grid[columns][None, :, :]).sum(2)
            ok = (equal >= np.maximum(least[mine][:, None], least[columns][None, :])) \
                & (part[mine][:, None] != part[columns][None, :])
            if u == v:
                ok &= ids[mine][:, None] < ids[columns][None, :]
            x, y = np.nonzero(ok)
            found_a.append(mine[x])
            found_b.append(columns[y])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        if len(bad[0]):
            place = {c: i for i, c in enumerate(ids.tolist())}
            missed = [place[x] * len(ids) + place[y] for x, y in zip(*(c.tolist() for c in bad), strict=True) if x in place and y in place]
            open_ = ~np.isin(a * len(ids) + b, missed)
            a, b = a[open_], b[open_]
        roots, root = np.unique(part, return_inverse=True)
        chosen = np.union1d(forest(root[a], root[b], len(roots)), np.arange(min(len(a), share * len(ids))))
        return ids[a[chosen]], ids[b[chosen]], np.full(len(chosen), len(chosen) == len(a))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def work(table: pa.Table, whole: bool):
            """Handle all groups but the last, which may go on in the next batch."""
            member = ~np.asarray(table["other"].combine_chunks().is_valid())
            sig, u, v, block, ids, part, least, other = (table[c].fill_null(0).to_numpy() for c in names[:8])
            edge = np.flatnonzero((sig[1:] != sig[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])) + 1
            edges = [0, *edge.tolist(), *([len(sig)] if whole else [])]
            short = table["bytes"].to_pylist()
            plain = bool(member.all())
            found = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                own = slice(lo, hi) if plain else lo + np.flatnonzero(member[lo:hi])
                failed = slice(0, 0) if plain else lo + np.flatnonzero(~member[lo:hi])
                bytes_ = short[lo:hi] if plain else [short[i] for i in own]
                found.append((lo, *pairs(u[lo], v[lo], block[own], ids[own], part[own], least[own], bytes_, (ids[failed], other[failed]))))
            at = np.repeat([lo for lo, *_ in found], [len(f[1]) for f in found]).astype(np.int64)
            a, b, all_ = (np.concatenate([np.zeros(0, kind), *(f[i] for f in found)]) for i, kind in ((1, np.int64), (2, np.int64), (3, bool)))
            out = pa.RecordBatch.from_arrays([*map(pa.array, (sig[at], u[at], v[at], a, b, all_))], names=schema.names)
            return out, table.slice(edges[-1])

        for batch in batches:
            table = pa.Table.from_batches([batch]).select(names)
            held = table if held is None else pa.concat_tables([held, table])
            out, held = work(held.combine_chunks(), False)
            yield out
        if held is not None and held.num_rows:
            yield work(held.combine_chunks(), True)[0]

    return groups.mapInArrow(rows, schema)


def _mixed(members: DataFrame) -> DataFrame:
    """(sig, count): groups of members (sig, class_id, role, part) of several components.

    Of groups with the same members (by 128 bits of hashes), which would list the same pairs, one is taken.
    """
    groups = members.groupBy("sig").agg(
        F.count("*").alias("count"), F.min("part").alias("x"), F.max("part").alias("y"),
        F.bit_xor(F.xxhash64("class_id", "role")).alias("m"), F.bit_xor(F.xxhash64("role", "class_id")).alias("n"))
    return groups.where("x <> y").groupBy("count", "m", "n").agg(F.min("sig").alias("sig")).select("sig", "count")


def _rest(members: DataFrame, first: DataFrame, wanted: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links (a, b) of documents that join components: `first` and what groups still hold.

    members: (sig, class_id, role) of each group without its hub; first: (node, component) after the hubs. In rounds,
    each two blocks of a group list pairs that would join their classes' components. Similar ones
    join; blocks that had more to list and a pair that failed come again without it, and list eight
    times as many, so rounds are few and a group of similar classes never lists all its pairs.
    """
    links = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    parts_of = lambda found: staging.stage(wanted.join(found, F.col("doc_id") == F.col("node"), "left").select(
        "class_id", F.coalesce("component", "doc_id").alias("part")))
    parts = parts_of(first)
    mixed = staging.stage(_mixed(members.join(parts, "class_id")))
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    open_members = members.join(mixed, "sig").withColumn(
        "block", F.pmod(F.xxhash64("class_id"), blocks).cast("int")).withColumn(
        "with", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "sig", F.least("block", "with").alias("u"), F.greatest("block", "with").alias("v"), "block", "class_id", "role")
    place = ["sig", "u", "v"]
    bad, share = None, FIRST_SHARE
    while True:
        groups = open_members.join(parts, "class_id").join(
            sets.select("class_id", "bytes0", "bytes1", "shared0", "shared1"), "class_id").select(
            *place, "block", "class_id", "part",
            F.when(F.col("role") == 0, F.col("bytes0")).otherwise(F.col("bytes1")).alias("bytes"),
            F.when(F.col("role") == 0, F.col("shared0")).otherwise(F.col("shared1")).alias("shared"),
            F.lit(None).cast("bigint").alias("other"))
        if bad is not None:
            groups = groups.unionByName(bad.select(*place, F.col("a").alias("class_id"), F.col("b").alias("other")), allowMissingColumns=True)
        listed = staging.stage(_between(groups.repartition(*place).sortWithinPartitions(*place, "class_id"), share))
        compared = staging.stage(_verify(listed.select("a", "b").distinct(), sets, percent))
        links = links.unionAll(_links(compared))
        failed = staging.stage(listed.where("not whole").join(
            compared.where("not similar").select("a", "b"), ["a", "b"]).select(*place, "a", "b"))
        if failed.isEmpty():
            return links
        joined = staging.stage(components(links))
        links = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
        parts = parts_of(joined)
        open_members = staging.stage(open_members.join(failed.select(*place).distinct(), place, "left_semi"))
        bad = failed if bad is None else staging.stage(bad.join(failed.select(*place).distinct(), place, "left_semi").unionAll(failed))
        share *= 8


def link(documents: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    documents = staging.plain(documents, {"doc_id": "bigint", "text": "string"})
    signed = staging.stage(_sign(documents, size, percent))
    role = lambda c, i: signed.where(F.size(c) > 0).select(
        F.explode(c).alias("sig"), "class_id", F.lit(i).cast("tinyint").alias("role"), F.col(f"{c}_need").alias("need"))
    tokens = role("home", 0).unionAll(role("next", 1))
    met = tokens.groupBy("sig").agg(F.min("class_id").alias("x"), F.max("class_id").alias("y"))
    twice = staging.stage(met.where("x <> y").select("sig"))
    # Only what the map holds crosses the network again.
    common = staging.stage(_marked(signed, _bitmap(twice)).join(twice, "sig").distinct())

    # The rarest signatures of each set, as many as must hold one that a similar set has among its own.
    often = staging.stage(common.groupBy("sig").count())
    own = Window.partitionBy("class_id", "role")  # a set's own signatures
    ranked = common.join(often, "sig").withColumns({
        "left": F.count("*").over(own), "rank": F.row_number().over(own.orderBy("count", "sig"))})
    rare = staging.stage(ranked.where(F.col("rank") <= F.col("left") - F.col("need") + 1)
                         .select("sig", "class_id", "role", "left"))

    hubs = rare.groupBy("sig").agg(
        F.max(F.struct("left", "class_id"))["class_id"].alias("hub"), F.min("class_id").alias("x"),
        F.max("class_id").alias("y")).where("x <> y").select("sig", "hub")
    hubs = staging.stage(hubs)
    rare = staging.stage(rare.join(hubs, "sig"))
    copies = staging.stage(signed.where("doc_id is not null and n_shingles > 0").groupBy("class_id").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    active = rare.select("class_id").distinct()
    wanted = staging.stage(copies.join(active, "class_id").select(F.col("rep").alias("doc_id"), "class_id"))
    sets = _fetch(documents, wanted, size, percent)

    to_hub = rare.where("class_id <> hub").select(F.col("class_id").alias("a"), F.col("hub").alias("b")).distinct()
    first = staging.stage(components(staging.stage(_links(_verify(to_hub, sets, percent)))))
    others = rare.where("class_id <> hub").select("sig", "class_id", "role")  # pairs with a hub are verified
    joined = staging.stage(components(_rest(others, first, wanted, sets, percent)))

    of_class = copies.where("copies > 1").select("class_id", "rep")
    return signed.select("doc_id", "n_shingles", "class_id").join(of_class, "class_id", "left").withColumn(
        "rep", F.coalesce("rep", "doc_id")).join(joined, F.col("rep") == F.col("node"), "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))
