"""N-gram Jaccard join by multiple global orders.

If two sets are similar enough, then under any total order of all tokens their
first few tokens, their prefixes, share one, and prefixes that are longer by
some tokens share so many more. So candidates must share several prefix tokens
under each of three orders. All orders put rare tokens first, by how often a
token is repeated in the corpus, and break ties by a hash of their own.

Prefixes meet by token under the first order. Classes (equal sets are one
class) that meet nobody are done; the others' prefixes meet under the second
and the third order, and a class that meets nobody there is done too. Meeting
by a few tokens, as unrelated classes do by chance, isn't enough. What is left
are, for each class, the tokens it shares with others under each order.
Sizes that allow no link don't meet. All classes that share a token of the
first order are a group with two of them as its centres. First each class is compared to its centres; linked classes are
joined to components. Then pairs of different components are looked for among
the rest of a group, those outside its largest component against all others,
cut into blocks. A pair has to share a token under the other two orders as well;
sizes and sketches rule out most of the rest before sets are compared. Blocks
hold their sets, so pairs are decided where they meet, and pairs of what is
joined by then are passed over: a pair of blocks gives fewer links than it has
rows, whatever the number of its similar pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm import words
from framewright.llm.common import Scratch, table
from framewright.llm.words import MIX, mixed

#: Tokens whose frequency the orders know, and tokens of documents in which repeats are counted at a time.
HEAVY_TOKENS, COUNTED = 1 << 18, 1 << 21
#: Repeats from which a token's group is salted, a salt for each so many.
HOT = 1 << 13
#: Classes in a block of a group, and about as many tokens of theirs at most; larger groups are paired block by block.
BLOCK, BLOCK_TOKENS = 512, 1 << 20
#: Documents up to which their keys are broadcast to pick texts; beyond, texts are shuffled.
BROADCAST_IDS = 1 << 20
#: Classes of tokens in a sketch.
SKETCH = 128
#: Sets seen that a worker remembers; then it starts again.
REMEMBERED = 1 << 17
#: Tokens of sets whose rows are sent together.
SENT = 1 << 20
#: Prefixes are longer by a part of their length, and so many more tokens have to be shared: one in so many.
LONGER = 4
#: Bits of a token's slot in the table that rules out rare tokens.
SLOT_BITS = 22

_ONE, _SHIFT = np.uint64(1), np.uint64(58)

def _shingled(h: np.ndarray, counts: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct tokens of each text, from the hashes of all texts' words."""
    first = np.cumsum(counts) - counts
    token = lambda x, k: mixed(x + np.uint64(k), MIX[0]) >> _ONE
    whole, runs = np.zeros(len(counts), np.uint64), h
    for k in range(1, size):
        fewer = counts == k
        whole[fewer] = token(runs[first[fewer]], k)
        runs = mixed(runs[:-1], MIX[0]) + h[k:]
    runs = token(runs, size)
    for n, a, w in zip(counts.tolist(), first.tolist(), whole, strict=True):
        if n < size:
            yield np.array([w] if n else [], np.uint64)
        else:
            s = np.sort(runs[a : a + n - size + 1])
            yield s if len(s) == 1 else s[np.append(True, s[1:] != s[:-1])]


def sets_of(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes (63 bits) of its distinct ``size``-word shingles; of fewer words the whole sequence; none without words."""
    for _, _, found in words.parts(texts):
        hashed = [words.word_hashes(*part)[:2] for part in found]
        if len(found) == 1:
            (h, start), (_, begins) = hashed[0], found[0]
            yield from _shingled(h, words.counts(start, begins), size)
        else:
            h = np.concatenate([h for h, _ in hashed])
            yield from _shingled(h, np.array([len(h)]), size)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The same for one text."""
    return next(sets_of(pa.array([text], pa.string()), size))


def _class_of(tokens: np.ndarray) -> int | None:
    """A signed 64-bit digest of a set; none if it is empty."""
    return xxhash.xxh3_64_intdigest(tokens) - (1 << 63) if len(tokens) else None


class _Seen(set):
    """What a worker has seen, as far as it remembers."""

    def new(self, x: int | None) -> bool:
        if x is None or x in self:
            return False
        if len(self) >= REMEMBERED:
            self.clear()
        self.add(x)
        return True


def prefix_length(n: int, num: int, den: int) -> int:
    """How many tokens of a set of ``n`` hold one of any set of Jaccard similarity num/den or more."""
    return n - -(-num * n // den) + 1


def longer_prefix(n: int, num: int, den: int) -> int:
    """A prefix that is longer by one token in LONGER, as far as the tokens go that any similar set has too."""
    length, common = prefix_length(n, num, den), -(-num * n // den)
    return length + min(length // LONGER, common - 1)


def shared_least(n: int, num: int, den: int) -> int:
    """How many tokens the longer prefixes of a set of ``n`` and of any set of similarity num/den or more share.

    A prefix that is longer by k holds the first k + 1 of the tokens that both
    have. The smaller the other set, the less its prefix is longer: the
    smallest has -(-num * n // den) tokens.
    """
    least = -(-num * n // den)
    return 1 + longer_prefix(least, num, den) - prefix_length(least, num, den)


def shared_enough(met: Column, n: Column, num: int, den: int) -> Column:
    """Whether ``met`` shared tokens are as many as shared_least says for a set of ``n``."""
    part = lambda k: F.floor((num * k + den - 1) / den)
    least, common = part(n), part(part(n))
    return met >= 1 + F.least(F.floor((least - common + 1) / LONGER), common - 1)


def size_level(n: int, num: int, den: int) -> int:
    """A size's level: sizes that allow a link are at most one level apart."""
    return int(np.log(n) / (1.0001 * np.log(den / num)))


@dataclass
class Orders:
    """Three total orders of all tokens: by class of frequency, rare first, then by a hash of each order's own."""

    tokens: np.ndarray
    times: np.ndarray
    slots: np.ndarray | None = field(default=None, repr=False)

    def known(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``tokens`` are known to be repeated, and where they stand."""
        if self.slots is None:
            self.slots = np.zeros(1 << SLOT_BITS, bool)
            self.slots[self.tokens & np.uint64((1 << SLOT_BITS) - 1)] = True
        maybe = np.flatnonzero(self.slots[tokens & np.uint64((1 << SLOT_BITS) - 1)])
        at = np.searchsorted(self.tokens, tokens[maybe])
        at[at == len(self.tokens)] = 0
        hit = self.tokens[at] == tokens[maybe] if len(self.tokens) else np.zeros(len(maybe), bool)
        return maybe[hit], at[hit]

    def prefixes(self, tokens: np.ndarray, length: int, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Order, tokens of the prefix, and how often each is known to be repeated."""
        where, at = self.known(tokens)
        times = np.zeros(len(tokens), np.int64)
        times[where] = self.times[at]
        weight = np.zeros(len(tokens), np.uint64)
        weight[where] = np.log2(self.times[at]).astype(np.uint64) + _ONE << _SHIFT
        for order in orders:
            if length < len(tokens):
                key = (tokens if order == 0 else mixed(tokens, MIX[order]) >> _ONE) >> np.uint64(6) | weight
                pick = np.argpartition(key, length - 1)[:length]
                yield order, tokens[pick], times[pick]
            else:
                yield order, tokens, times


def _repeats(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that several sets have, and how many have them."""
    found, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
    return found[n > 1], n[n > 1]


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """How many tokens are in each of SKETCH classes, up to 127."""
    return np.minimum(np.bincount((tokens & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH), 127).astype(np.int8)


def text_key() -> Column:
    """What picks a text: a hash of it. Others that have the same do no harm, since sets are known by their digest."""
    return F.xxhash64("text")


def _measured(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, at (the text's key), n_shingles and cls (null for an empty set) of every row; and rows with token and times alone: tokens repeated among the sets of a task."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "at", "n_shingles", "cls", "token", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen = [], 0, _Seen()

        def counted() -> pa.RecordBatch:
            found, n = _repeats(held)
            held.clear()
            none = [pa.nulls(len(n), t) for t in (id_type, pa.int64(), pa.int64(), pa.int64())]
            return pa.RecordBatch.from_arrays([*none, pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names)

        for batch in batches:
            id_type = batch.column(0).type
            n, cls = [], []
            for s in sets_of(batch.column(2), size):
                n.append(len(s))
                cls.append(_class_of(s))
                if seen.new(cls[-1]):
                    held.append(s)
                    count += len(s)
                    if count >= COUNTED:
                        yield counted()
                        count = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64())], names)
        if held:
            yield counted()

    return docs.select("doc_id", text_key().alias("at"), "text").mapInArrow(run, f"doc_id {kind}, at long, n_shingles long, cls long, token long, times long")


def _orders(measured: DataFrame, scratch: Scratch) -> Orders:
    """The orders, from the repeats of all tasks: up to HEAVY_TOKENS of the most repeated tokens. Any set of them gives valid orders."""
    repeats = measured.filter("token is not null").groupBy("token").agg(F.sum("times").alias("times"))
    repeats = scratch.stored(repeats.withColumn("level", F.floor(8 * F.log2("times")).cast("int")), "repeats")
    room, least = HEAVY_TOKENS, None
    for level, n in repeats.groupBy("level").count().orderBy(F.desc("level")).collect():  # 504 rows at most
        if n > room:
            break
        room, least = room - n, level
    if least is None:
        return Orders(np.empty(0, np.uint64), np.empty(0, np.int64))
    found = repeats.filter(F.col("level") >= least).select("token", "times").toArrow()
    tokens, times = (found.column(k).to_numpy() for k in (0, 1))
    order = np.argsort(tokens)
    return Orders(tokens[order].astype(np.uint64), times[order])


def _prefix_rows(texts: DataFrame, size: int, num: int, den: int, orders, which: tuple[int, ...], sketched: bool) -> DataFrame:
    """rank (the order), token, salt, level (of its size), cls for each token of a set's prefix, each set once for a task; and a row of rank -1 with the set's sketch, if asked for.

    salt is -1, or for a hot token one of several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = orders.value, _Seen()
        rows: list[tuple] = []
        n_rows = 0

        def close() -> pa.RecordBatch:
            nonlocal n_rows
            n = [len(r[1]) for r in rows]
            rank, cls, level = (np.repeat(np.array([r[k] for r in rows], t), n) for k, t in ((0, np.int8), (3, np.int64), (5, np.int32)))
            lengths = np.repeat([0 if r[4] is None else SKETCH for r in rows], n)
            sketches = np.concatenate([np.empty(0, np.int8), *(r[4] for r in rows if r[4] is not None)])
            sketch = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(sketches), mask=pa.array(lengths == 0))
            found = [pa.array(rank), pa.array(np.concatenate([r[1] for r in rows])), pa.array(np.concatenate([r[2] for r in rows]).astype(np.int32)), pa.array(level), pa.array(cls), sketch]
            rows.clear()
            n_rows = 0
            return pa.RecordBatch.from_arrays(found, ["rank", "token", "salt", "level", "cls", "sketch"])

        for batch in batches:
            for s in sets_of(batch.column(0), size):
                cls = _class_of(s)
                if seen.new(cls):
                    level = size_level(len(s), num, den)
                    for rank, tokens, times in known.prefixes(s, longer_prefix(len(s), num, den), which):
                        rows.append((rank, tokens.view(np.int64), np.where(times >= HOT, cls % (times // HOT + 1), -1), cls, None, level))
                    if sketched:
                        rows.append((-1, np.array([cls]), np.array([-1]), cls, _sketch(s), level))
                    n_rows += len(s)
                    if n_rows >= SENT:
                        yield close()
        if rows:
            yield close()

    return texts.select("text").mapInArrow(run, "rank byte, token long, salt int, level int, cls long, sketch array<tinyint>")


def _meeting(rows: DataFrame) -> DataFrame:
    """Rows of each (rank, token, salt, level) that several classes have, with ``first``, the least of them; of a hot token all rows are kept."""
    group = Window.partitionBy("rank", "token", "salt", "level")
    rows = rows.withColumns({"first": F.min("cls").over(group), "last": F.max("cls").over(group), "owned": F.max("own").over(group)})
    return rows.filter("(rank < 0 and own) or (rank >= 0 and (salt >= 0 or (owned and first <> last)))").drop("last", "owned")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose token several classes of sizes that allow a link have; and those of sketches.

    Sizes that allow a link are at most one level apart: a row stands at its
    own level (``own``) and at the next. Tokens that one class alone has are
    left out before; the rest stay where they are.
    """
    group = Window.partitionBy("rank", "token", "salt")
    several = rows.withColumns({"first": F.min("cls").over(group), "last": F.max("cls").over(group)}).filter("rank < 0 or salt >= 0 or first <> last")
    levels = F.explode(F.array(F.struct("level", F.lit(True).alias("own")), F.struct((F.col("level") + 1).alias("level"), F.lit(False).alias("own"))))
    return _meeting(several.select(*(c for c in rows.columns if c != "level"), levels.alias("at")).select(*(c for c in rows.columns if c != "level"), "at.*"))


def _texts_of(docs: DataFrame, at: DataFrame) -> DataFrame:
    """The texts with the keys of ``at(at)``, which is stored."""
    few = F.broadcast(at) if at.count() <= BROADCAST_IDS else at
    return docs.select("text", text_key().alias("at")).join(few, "at", "left_semi").select("text")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """cls and tokens of each set, once for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        found: list[tuple[int, np.ndarray]] = []
        n = 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum([0, *(len(s) for _, s in found)]).astype(np.int32)
            out = [pa.array([c for c, _ in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([s for _, s in found]).astype(np.int64)))]
            found.clear()
            return pa.RecordBatch.from_arrays(out, ["cls", "tokens"])

        for batch in batches:
            for s in sets_of(batch.column(0), size):
                if seen.new(c := _class_of(s)):
                    found.append((c, s))
                    n += len(s)
                    if n >= SENT:
                        yield close()
                        n = 0
        if found:
            yield close()

    return texts.mapInArrow(run, "cls long, tokens array<bigint>").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    of = lambda side: sets.select(F.col("cls").alias(side), F.col("tokens").alias(f"{side}_tokens"))
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    either = F.size("a_tokens") + F.size("b_tokens") - both
    return pairs.join(of("a"), "a").join(of("b"), "b").filter(den * both >= num * either).select("a", "b")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label (the least node it is connected to) for each node of ``edges(a, b)``.

    Least labels go to neighbours and along labels in turn until none changes;
    each round is written to the shared folder.
    """
    both = scratch.stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        following = scratch.stored(lower.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        labels = following.select("node", "label")
        if following.filter("label != old").isEmpty():
            return labels


def may_link(num: int, den: int) -> Column:
    """Whether sizes n and m allow the similarity."""
    return den * F.least("n", "m") >= num * F.greatest("n", "m")


def agreeing(pairs: DataFrame, num: int, den: int, ranks: tuple[int, ...] = (1, 2)) -> DataFrame:
    """The pairs with columns n, m (sizes) and p1, q1, p2, q2 (shared tokens of both) that sizes allow and that share a token under each order."""
    pairs = pairs.filter(may_link(num, den))
    for rank in ranks:
        pairs = pairs.filter(F.arrays_overlap(f"p{rank}", f"q{rank}"))
    return pairs


def sketches_allow(num: int, den: int) -> Column:
    """Whether sketches s and t of sets of n and m tokens allow the similarity: sets differ in at least as many tokens as their sketches do.

    Overlap is num * (n + m) / (num + den) or more, so what is in one set only
    is (den - num) * (n + m) / (num + den) or less.
    """
    apart = F.aggregate(F.zip_with("s", "t", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda total, x: total + x)
    return (num + den) * apart <= (den - num) * (F.col("n") + F.col("m"))


def _blocks(rows: DataFrame, num: int, den: int) -> DataFrame:
    """``rows(centre, level, cls, label, own)`` of groups with several labels, each for every pair of blocks (i, j) that it belongs to.

    A group's rows outside its largest label are in the blocks from 0 on, the
    others in those after them; each of the first is paired with itself and
    with all that follow.
    """
    group = ["centre", "level"]
    # As size_level has it, sets of a level have fewer tokens than this.
    size = F.exp((F.col("level") + 1) * (1.0001 * np.log(den / num)))
    block_of = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), F.lit(float(BLOCK_TOKENS)) / size))
    labels = rows.groupBy(*group, "label").count().groupBy(*group).agg(F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("all"), F.count("*").alias("labels"))
    labels = labels.filter("labels > 1").select(*group, F.col("top.label").alias("top"), F.ceil((F.col("all") - F.col("top.count")) / block_of).cast("int").alias("minor"), F.ceil(F.col("top.count") / block_of).cast("int").alias("major"))
    rows = rows.join(labels, group)
    spread = F.xxhash64("cls")
    block = F.when(F.col("label") == F.col("top"), F.col("minor") + F.pmod(spread, F.col("major"))).otherwise(F.pmod(spread, F.col("minor"))).cast("int")
    rows = rows.withColumn("block", block)
    last = F.when(F.col("block") < F.col("minor"), F.col("minor") + F.col("major")).otherwise(F.col("minor")) - 1
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rows.select(*group, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("right"), "cls", "label", "own")


def _across(rows: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: labels that links join, of rows in a pair of blocks that sizes, both other orders and sketches allow.

    Of the links in a pair of blocks only those are returned that join what
    isn't joined yet by labels and by links found there before.
    """
    key = ["centre", "level", "i", "j"]
    columns = [*key, "right", "cls", "label", "own", "n", "p1", "p2", "sketch", "tokens"]

    def of_group(g: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        right, cls, label, own, n = (g.column(k).to_numpy(zero_copy_only=False) for k in range(4, 9))
        right, own, every = right.astype(bool), own.astype(bool), np.arange(len(cls))
        joined = np.unique(label, return_inverse=True)[1]
        ends, tokens = (x.to_numpy() for x in (g.column(12).offsets, g.column(12).values))
        set_of = lambda k: tokens[ends[k] : ends[k + 1]]
        within = g.column(2)[0].as_py() == g.column(3)[0].as_py()
        flat = []
        for k in (9, 10):
            starts = g.column(k).offsets.to_numpy() - g.column(k).offsets[0].as_py()
            flat.append((np.unique(g.column(k).flatten().to_numpy(), return_inverse=True)[1], starts))
        sketch = None
        for i in every[:-1] if within else every[~right]:
            others = every[i + 1 :] if within else every[right]
            others = others[(joined[others] != joined[i]) & (own[others] | own[i]) & (den * np.minimum(n[others], n[i]) >= num * np.maximum(n[others], n[i]))]
            for ids, starts in flat if len(others) else ():
                mine = np.zeros(ids.max() + 1, bool)
                mine[ids[starts[i] : starts[i + 1]]] = True
                others = others[np.logical_or.reduceat(mine[ids], starts[:-1])[others]]
            if len(others):
                if sketch is None:
                    sketch = g.column(11).flatten().to_numpy().reshape(-1, SKETCH).astype(np.int16)
                # As in sketches_allow.
                apart = np.abs(sketch[others] - sketch[i]).sum(1)
                for k in others[(num + den) * apart <= (den - num) * (n[others] + n[i])].tolist():
                    if joined[k] != joined[i]:
                        both = len(np.intersect1d(set_of(i), set_of(k), assume_unique=True))
                        if den * both >= num * (int(n[i]) + int(n[k]) - both):
                            joined[joined == joined[k]] = joined[i]
                            yield np.array([min(label[i], label[k])]), np.array([max(label[i], label[k])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in (*batches, None):
            whole = left if batch is None else batch if left is None else pa.concat_batches([left, batch])
            if whole is None or not len(whole):
                continue
            keys = [whole.column(k).to_numpy() for k in range(4)]
            cuts = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0)))
            ends = np.append(cuts[1:], len(whole))
            if batch is not None:
                left, cuts, ends = whole.slice(int(cuts[-1])), cuts[:-1], ends[:-1]
            found = [x for a, b in zip(cuts.tolist(), ends.tolist(), strict=True) if b > a + 1 for x in of_group(whole.slice(a, b - a))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *(x[k] for x in found)])) for k in (0, 1)], ["a", "b"])

    return rows.select(*columns).repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


def linked(docs: DataFrame, size: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """doc_id, at (the text's key), n_shingles, label of every row; equal labels are one component, null is an empty set."""
    spark = docs.sparkSession
    measured = scratch.stored(_measured(docs, size), "measured")
    orders = spark.sparkContext.broadcast(_orders(measured, scratch))
    members = measured.filter("token is null").drop("token", "times")
    classes = members.filter("cls is not null").groupBy("cls").agg(F.first("n_shingles").cast("int").alias("n"), F.min("at").alias("at"))

    met = scratch.stored(_shared(_prefix_rows(docs, size, num, den, orders, (0,), False).drop("sketch")).drop("first"), "met")
    several = met.groupBy("cls").agg(F.count_distinct("token").alias("met"))
    some = classes.join(several, "cls").filter(shared_enough(F.col("met"), F.col("n"), num, den)).drop("met")
    texts = _texts_of(docs, scratch.stored(some.select("at").distinct(), "keys"))
    other = _shared(_prefix_rows(texts, size, num, den, orders, (1, 2), True))
    # A class has as many tokens as its prefix at most.
    shared = other.groupBy("cls").agg(*(F.collect_set(F.when(F.col("rank") == k, F.col("token"))).alias(f"p{k}") for k in (1, 2)), F.first("sketch", True).alias("sketch"))
    enough = [shared_enough(F.size(f"p{k}"), F.col("n"), num, den) for k in (1, 2)]
    short = {f"p{k}": F.transform(f"p{k}", lambda x: F.pmod(x, F.lit((1 << 31) - 1)).cast("int")) for k in (1, 2)}
    known = scratch.stored(classes.join(shared, "cls").filter(enough[0] & enough[1]).withColumns(short), "classes")

    groups = _meeting(met.join(known.select("cls"), "cls", "left_semi"))
    second = F.min(F.when(F.col("cls") != F.col("first"), F.col("cls"))).over(Window.partitionBy("rank", "token", "salt", "level"))
    # Groups of near copies have the same two least classes under many tokens. Salts of a hot token are one group.
    groups = groups.withColumn("second", second).select(F.when(F.col("salt") < 0, F.xxhash64("first", "second")).otherwise(F.col("token")).alias("centre"), "level", "own", "cls", "first", "second", (F.col("salt") >= 0).alias("hot"))
    groups = groups.groupBy("centre", "level", "cls").agg(F.min("first").alias("first"), F.min("second").alias("second"), F.max("hot").alias("hot"), F.max("own").alias("own"))
    groups = scratch.stored(groups, "groups")
    # Narrow columns rule out most pairs; what classes share is looked up for the rest.
    narrow = known.select("cls", "n")
    starred = groups.select(F.col("cls").alias("a"), F.explode(F.array("first", "second")).alias("b")).filter("a <> b")
    starred = starred.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    starred = starred.join(narrow.withColumnRenamed("cls", "a"), "a").join(narrow.withColumnsRenamed({"cls": "b", "n": "m"}), "b").filter(may_link(num, den))
    starred = starred.join(known.select(F.col("cls").alias("a"), "p1", "p2"), "a").join(known.select(F.col("cls").alias("b"), F.col("p1").alias("q1"), F.col("p2").alias("q2")), "b")
    starred = agreeing(starred, num, den).select("a", "b", "n", "m")
    starred = starred.join(known.select(F.col("cls").alias("a"), F.col("sketch").alias("s")), "a").join(known.select(F.col("cls").alias("b"), F.col("sketch").alias("t")), "b")
    starred = scratch.stored(starred.filter(sketches_allow(num, den)).select("a", "b"), "pairs")

    def sets_for(nodes: DataFrame) -> DataFrame:
        at = scratch.stored(known.join(nodes.distinct(), "cls", "left_semi").select("at").distinct(), "keys")
        return scratch.stored(_sets(_texts_of(docs, at), size), "sets")

    edges = scratch.stored(_verified(starred, sets_for(starred.select(F.explode(F.array("a", "b")).alias("cls"))), num, den), "links")
    labels = components(edges, scratch)

    # Pairs of different labels in a group, without the two that all were compared to.
    rows = groups.filter("hot or cls <> first and cls <> second").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    rows = rows.select("centre", "level", "cls", F.coalesce("label", "cls").alias("label"), "own")
    blocks = scratch.stored(_blocks(rows, num, den), "blocks")
    # Links between components join their labels.
    more = scratch.stored(_across(blocks.join(known, "cls").join(sets_for(blocks.select("cls")), "cls"), num, den), "links")

    named = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    if not more.isEmpty():
        further = components(more, scratch).select(F.col("node").alias("label"), F.col("label").alias("least"))
        named = named.join(further, "label", "left").withColumn("label", F.coalesce("least", "label"))
    return named.select("doc_id", "at", "n_shingles", "label")


def link_components(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs(doc_id, text)``; links are Jaccard similarity num/den or more.

    component_id is the smallest doc_id that links reach, itself included. A
    null text, and one without words, has no shingle and is alone; a text of
    fewer than ``size`` words is one shingle; long texts are hashed piece by
    piece and count whole. A-Z count as small. Rows with the same doc_id, or
    without one, are each a set of their own; a null doc_id links like any
    other and names a component only if no row has an id. Sets are told apart
    by 64-bit digests, shingles by 63-bit ones. An empty table gives an empty
    result. Other columns are left out.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    named = linked(docs, size, num, den, scratch)
    named = scratch.kept(named, "named")
    scratch.clear()
    least = named.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "label", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at 3 words and 0.9."""
    return link_components(table(spark, sf_dir, "documents"), 3, 9, 10)


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(v, u) AS (SELECT doc_id, doc_id FROM documents UNION SELECT v, b FROM r JOIN e ON u = a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id
FROM (SELECT v AS doc_id, min(u) AS m FROM r GROUP BY v) LEFT JOIN n USING (doc_id)
"""
