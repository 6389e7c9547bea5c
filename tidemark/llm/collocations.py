"""Collocations by a weighted de Bruijn graph of words.

Texts are lower-cased (A-Z), split into pieces and those into words; a phrase lies in one piece and
in one language. Nodes are runs of `longest` - 1 words, edges runs of `longest` words from a node to
the one that overlaps it; an edge weighs as often as its words occur.

1. A first pass counts the words. A word that occurs less than `least` times is in no candidate, so
   it ends a run as a piece's end does.
2. A second pass lists, once for each place of a text, the longest run that begins there: an edge, or
   where a piece (or a rare word) stops it, a shorter run. These are added up. No shorter run is ever
   counted by itself: a shorter run occurs as often as the edges that begin with it weigh together
   (its flow), plus the shorter runs that a stop cut off (the correction for piece ends).
3. Edges of `least` and more are the solid graph. A node that lets all its flow through, from one edge
   into one edge, is unary. Edges that meet in unary nodes are compacted to paths, by doubling jumps
   from edge to edge before. A path keeps its words and one weight; its inner nodes need no
   row of their own, since they occur as often as the path and are always part of a longer candidate.
   Paths never close: every occurrence of a unary node goes on, and texts end. A path lies in one
   piece of a text, so it is no longer than the longest piece.
4. Candidates are cut at each place; the lowest score floor(SCALE a a / (l r)) counts. Candidates that
   a longer one mostly stands for are dropped. Products are 38-digit decimals.

Words are numbers on the way: their place in the sorted ids of the frequent words, which are sent to
the tasks while they are at most MOST_SENT, else the 63-bit ids themselves, without leaving out rare
words. Results are the same. Different words with one id would be found, and ids taken from another
digest.

Hot keys: tasks add up their own runs before the shuffle; runs that begin with two hot words are dealt
by the third word too, and their flows added up afterwards. The best of each language are cut per part
of its phrases first.

Nulls and oddities: a null text is empty, a null language `und`. Ids are not read, so null or repeated
ids make no difference: every row counts. Languages without candidates have no rows, empty tables give
empty results. Ties in score and weight go by the phrase's bytes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import staging
from tidemark.llm.wordhash import LOWER, chunks, mix, slice_hashes, spans

SCALE = 1_000_000
#: Frequent words that are sent to the tasks at most, 8 bytes each.
MOST_SENT = 4_000_000
#: A word is hot with more than this part of all words.
HOT = 1 / 256
SALTS = 64
#: Words of a task that are held before they are passed on.
HELD = 1 << 20
CHUNK_BYTES = 1 << 22
STOP = -1
UNKNOWN = "und"

_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _CUT.copy()
_GAP[[9, 32]] = True
_U = np.uint64


class Words:
    """Words of the texts of one chunk: places, ids (63 bits, by language and word) and their texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, salts: np.ndarray, digest: int):
        data = LOWER[data]
        self.starts, self.ends, self.texts = spans(~_GAP[data], offsets)
        self.raw = data.tobytes()
        if digest == 0:
            own = slice_hashes(data, self.starts, self.ends)
        else:
            key = digest.to_bytes(8, "little")
            own = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8, key=key).digest(), "little")
                            for w in self.slices(np.arange(len(self.starts)))], _U)
        self.ids = (mix(own + salts[self.texts]) >> _U(1)).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(_CUT[data])])
        #: Does the next word go on with the same piece?
        self.goes_on = (self.texts[1:] == self.texts[:-1]) & (before[self.starts[1:]] == before[self.ends[:-1]])

    def slices(self, at: np.ndarray) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def _salts(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    own = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()]
    return np.array(own, _U)[coded.indices.to_numpy(zero_copy_only=False)] if own else np.zeros(0, _U)


def _read(batch: pa.RecordBatch, digest: int) -> Iterator[tuple[Words, pa.Array]]:
    """The words of each chunk, and the languages of its texts."""
    salts = _salts(batch.column(0))
    for lo, hi, data, offsets in chunks(batch.column(1), CHUNK_BYTES):
        yield Words(data, offsets, salts[lo:hi], digest), batch.column(0).slice(lo, hi - lo)


def _vocabulary(texts: DataFrame, digest: int) -> DataFrame:
    """(lang, word, id, n) of all words."""
    schema = staging.fields(lang="string", word="string", id="bigint", n="bigint")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table([[]] * 4, schema=pa.schema(list(zip(schema.names, [pa.string(), pa.string(), pa.int64(), pa.int64()], strict=True))))
        for batch in batches:
            for words, langs in _read(batch, digest):
                ids, first, n = np.unique(words.ids, return_index=True, return_counts=True)
                new = pa.table([langs.take(pa.array(words.texts[first])), pa.array(words.slices(first), pa.binary()).cast(pa.string()),
                                pa.array(ids), pa.array(n)], schema=held.schema)
                held = pa.concat_tables([held, new])
                if held.num_rows > HELD:
                    held = _added(held)
                    if held.num_rows > HELD // 2:
                        yield from held.combine_chunks().to_batches()
                        held = held.slice(0, 0)
        yield from _added(held).combine_chunks().to_batches()

    def _added(held: pa.Table) -> pa.Table:
        summed = held.group_by(["lang", "word", "id"], use_threads=False).aggregate([("n", "sum")])
        return summed.select(["lang", "word", "id", "n_sum"]).rename_columns(schema.names)

    return texts.mapInArrow(rows, schema).groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def words_of(texts: DataFrame) -> tuple[DataFrame, int]:
    """All words of (lang, text), written, and the digest that gives each its own id."""
    digest = 0
    while True:
        words = staging.stage(_vocabulary(texts, digest))
        if words.groupBy("id").count().where("count > 1").isEmpty():
            return words, digest
        digest += 1


def _numbers(ids: np.ndarray, sent: np.ndarray | None) -> np.ndarray:
    """Numbers of words: places in `sent` (STOP if not there), or the ids."""
    if sent is None:
        return ids
    if not len(sent):
        return np.full(len(ids), STOP)
    at = np.minimum(np.searchsorted(sent, ids), len(sent) - 1)
    return np.where(sent[at] == ids, at, STOP)


def _runs(texts: DataFrame, digest: int, longest: int, sent: Broadcast, hot: Broadcast) -> DataFrame:
    """(w1 to w<longest>, salt, n): the longest run that begins at each place, added up by chunks.

    STOP fills a run that a piece's end or a rare word stops. Runs of one word are left out. The salt
    is -1 but for runs that begin with two hot words.
    """
    names = [f"w{k}" for k in range(1, longest + 1)]
    schema = staging.fields(**dict.fromkeys(names, "bigint"), salt="int", n="bigint")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, _ in _read(batch, digest):
                number = _numbers(words.ids, sent.value)
                size = len(number)
                run, alive = [number], np.ones(size, bool)
                for k in range(1, longest):
                    after = np.full(size, STOP)
                    if size > k:
                        alive[:size - k] &= words.goes_on[k - 1:]
                        after[:size - k] = np.where(alive[:size - k] & (run[-1][:size - k] != STOP), number[k:], STOP)
                    run.append(after)
                keep = np.flatnonzero((run[0] != STOP) & (run[1] != STOP))
                run = [w[keep] for w in run]
                order = np.lexsort(run[::-1])
                run = [w[order] for w in run]
                new = np.ones(len(order), bool)
                if len(order):
                    new[1:] = np.any([w[1:] != w[:-1] for w in run], axis=0)
                first = np.flatnonzero(new)
                run = [w[first] for w in run]
                salt = np.full(len(first), -1, np.int32)
                if longest > 2:
                    both = np.isin(run[0], hot.value) & np.isin(run[1], hot.value)
                    salt[both] = (mix(run[2][both].astype(_U)) % _U(SALTS)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, run), pa.array(salt), pa.array(np.diff(np.append(first, len(order))))], names=schema.names)

    return texts.mapInArrow(rows, schema)


def graph(runs: DataFrame, longest: int, least: int) -> dict[int, DataFrame]:
    """From the runs of all places, (gram, f) of each length from 2 to `longest` with f >= least.

    Edges are sums of equal runs; a shorter gram is the flow of the runs that begin with it. All come
    from one shuffle by the first two words.
    """
    names = [f"w{k}" for k in range(1, longest + 1)]
    added = runs.repartition("w1", "w2", "salt").groupBy(*names, "salt").agg(F.sum("n").alias("n"))
    keep = F.col("n") >= least
    for k in range(2, longest):
        own = Window.partitionBy(*names[:2], "salt", *names[2:k]).orderBy(*names[k:])
        added = added.withColumns({
            f"f{k}": F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
            f"first{k}": F.row_number().over(own) == 1})
        # A flow that is dealt by salts may reach `least` only when its parts are added up.
        keep |= F.col(f"first{k}") & ((F.col(f"f{k}") >= least) | (F.col("salt") >= 0 if k == 2 else F.lit(False)))
    kept = staging.stage(added.where(keep))
    gram = lambda k: F.array(*names[:k]).alias("gram")
    found = {longest: kept.where((F.col("n") >= least) & (F.col(names[-1]) != STOP)).select(gram(longest), F.col("n").alias("f"))}
    for k in range(2, longest):
        flows = kept.where(F.col(f"first{k}") & (F.col(names[k - 1]) != STOP)).select(gram(k), F.col(f"f{k}").alias("f"))
        found[k] = flows.groupBy("gram").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return found


def _ends(longest: int) -> tuple[Column, Column]:
    """Tail and head of an edge: its first and last `longest` - 1 words."""
    return F.slice("gram", 1, longest - 1), F.slice("gram", 2, longest - 1)


def unary(edges: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """(gram) of the nodes whose whole flow comes from one edge and goes to one edge."""
    tail, head = _ends(longest)
    out = edges.groupBy(tail.alias("gram")).agg(F.max("f").alias("f"))
    into = edges.groupBy(head.alias("gram")).agg(F.max("f").alias("f"))
    return nodes.join(out, ["gram", "f"]).join(into, ["gram", "f"]).select("gram")


def paths(edges: DataFrame, inner: DataFrame, longest: int) -> DataFrame:
    """(words, n): edges that meet in `inner` (unary) nodes, compacted to maximal paths of one weight."""
    tail, head = _ends(longest)
    follows = edges.join(inner.select(F.col("gram").alias("tail")), tail == F.col("tail"))
    leads = edges.select(head.alias("tail"), F.col("gram").alias("up"))
    jumps = staging.stage(follows.join(leads, "tail").select("gram", "up", F.lit(1).alias("steps")))
    while True:
        before = jumps.select(F.col("gram").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"))
        longer = staging.stage(jumps.join(before, "up", "left").select(
            "gram", F.coalesce("further", "up").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.col("further").isNotNull().alias("moved")))
        jumps = longer.drop("moved")
        if longer.where("moved").isEmpty():
            break
    starts = edges.join(jumps.select("gram"), "gram", "left_anti").select(F.col("gram").alias("up"), "f")
    rest = jumps.groupBy("up").agg(F.array_sort(F.collect_list(F.struct(
        "steps", F.element_at("gram", -1).alias("word")))).alias("rest"))
    words = F.concat("up", F.coalesce(F.col("rest.word"), F.array().cast("array<bigint>")))
    return starts.join(rest, "up", "left").select(words.alias("words"), F.col("f").alias("n"))


def _scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, a, score, l, r): each candidate's lowest cut, ties to the first."""
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("gram") - 1)))
    part = lambda name, gram: counts.select(F.col("gram").alias(name), F.col("f").alias(gram))
    cut = cut.withColumns({"left": F.expr("slice(gram, 1, k)"), "right": F.expr("slice(gram, k + 1, size(gram) - k)")})
    cut = cut.join(part("left", "l"), "left", "left").join(part("right", "r"), "right", "left")
    # What no node has is inside a path, and occurs as often as the path.
    wide = lambda c: c.cast("decimal(15,0)")
    cut = cut.withColumns({"l": F.coalesce("l", "a"), "r": F.coalesce("r", "a")})
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(7,0)) * (aa * aa)) div (ll * rr)")
    cut = cut.withColumns({"aa": wide(F.col("a")), "ll": wide(F.col("l")), "rr": wide(F.col("r"))})
    best = cut.groupBy("gram", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("gram", "a", "best.score", "best.l", "best.r")


def mine(documents: DataFrame, shortest: int = 2, longest: int = 3, least: int = 10, percent: int = 50,
         top: int = 2000) -> DataFrame:
    """The `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Candidates have `shortest` (2 at least) to `longest` words and occur `least` times or more. One
    that lies in a longer candidate which occurs `percent` % as often, or more, is dropped. a, l, r:
    occurrences of the phrase and of the two sides of its lowest cut; n: words of the language.
    """
    if not 2 <= shortest <= longest or least < 1 or not 0 <= percent <= 100:
        raise ValueError("phrases have two words at least, and counts and shares are in their ranges")
    plain = staging.plain(documents, {"lang": "string", "text": "string"})
    texts = plain.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words, digest = words_of(texts)
    totals = staging.stage(words.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = staging.stage(words.where(F.col("n") >= least))
    sent, hot = _send(frequent, totals)
    try:
        numbered = staging.stage(_numbered(frequent, sent))
        grams = graph(_runs(texts, digest, longest, sent, hot), longest, least)
        grams[1] = numbered.select(F.array("number").alias("gram"), F.col("n").alias("f"))
        grams = {k: staging.stage(g) for k, g in grams.items()}
    finally:
        sent.unpersist()
        hot.unpersist()

    edges, nodes = grams[longest], grams[longest - 1]
    inner = staging.stage(unary(edges, nodes, longest))
    compact = staging.stage(paths(edges, inner, longest))
    grams[longest] = compact.select("n", F.explode(F.sequence(F.lit(1), F.size("words") - longest + 1)).alias("col"), "words").select(
        F.expr(f"slice(words, col, {longest})").alias("gram"), F.col("n").alias("f"))
    grams[longest - 1] = nodes.join(inner, "gram", "left_anti")  # inner nodes lie in a longer candidate

    chosen = []
    for k in range(shortest, longest + 1):
        own = grams[k].select("gram", F.col("f").alias("a"))
        if k < longest:
            longer = nodes if k == longest - 2 else grams[k + 1]
            inside = longer.select(F.explode(F.array(F.slice("gram", 1, k), F.slice("gram", 2, k))).alias("gram"), "f")
            inside = inside.groupBy("gram").agg(F.max("f").alias("f"))
            own = own.join(inside, "gram", "left").where(
                F.col("f").isNull() | (100 * F.col("f") < percent * F.col("a"))).select("gram", "a")
        chosen.append(own)
    counts = grams[1].select("gram", "f")
    for k in range(2, longest):
        counts = counts.unionAll(grams[k].select("gram", "f"))
    candidates = chosen[0]
    for own in chosen[1:]:
        candidates = candidates.unionAll(own)
    scored = staging.stage(_scored(candidates, counts))

    spelled = scored.select("*", F.posexplode("gram").alias("place", "number")).join(numbered.select("number", "lang", "word"), "number")
    spelled = spelled.groupBy("gram", "lang", "a", "l", "r", "score").agg(
        F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words")).select(
        "lang", "a", "l", "r", "score", F.array_join(F.col("words.word"), " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    first = spelled.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _send(frequent: DataFrame, totals: DataFrame) -> tuple[Broadcast, Broadcast]:
    """Sorted ids of the frequent words (None if too many), and the sorted numbers of the hot ones."""
    context = frequent.sparkSession.sparkContext
    number = frequent.count()
    sent = None
    if number <= MOST_SENT:
        sent = np.sort(frequent.select("id").toArrow().column(0).to_numpy())
    every = totals.agg(F.sum("n")).first()[0] or 0
    hot = frequent.where(F.col("n") > F.lit(HOT * every)).select("id").toArrow().column(0).to_numpy()  # 1 / HOT words at most
    return context.broadcast(sent), context.broadcast(np.sort(_numbers(hot, sent)))


def _numbered(frequent: DataFrame, sent: Broadcast) -> DataFrame:
    """The frequent words with their numbers."""
    schema = staging.fields(lang="string", word="string", number="bigint", n="bigint")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _numbers(batch.column(2).to_numpy(), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), batch.column(3)], names=schema.names)

    return frequent.select("lang", "word", "id", "n").mapInArrow(rows, schema)
