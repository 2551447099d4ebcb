"""Benchmark decontamination with an FM-index for each training shard.

The words of a shard of documents are numbered by the benchmark's vocabulary,
0 for any other word. A shard's index is a Burrows-Wheeler transform of that
sequence in a wavelet matrix with rank counts, and sampled suffix positions.
All test phrases are searched backwards at once; what is found is located by
walking to sampled positions, and the spans are merged in each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import table

#: Words in a window.
WINDOW = 13
#: Words that an index holds; a longer document gets an index of its own.
SHARD_WORDS = 1 << 20
#: Every so many text positions one is kept with its row.
SAMPLED = 8
#: Bytes of benchmark text that are sent to the executors at a time; a larger benchmark is taken in blocks, each in a pass of its own.
BLOCK_BYTES = 16 << 20

#: A-Z lowered; all other ASCII but letters and digits to a space.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Positions in the order of their suffixes, each 0 being a symbol of its own, ordered by position.

    The first symbols are packed into one key; only suffixes that tie without
    having met a 0 are sorted again, by what follows, twice as far each time.
    """
    n, known = len(text), max(1, 62 // bits)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(known):
        alive[max(0, n - k) :] = False
        alive[: max(0, n - k)] &= text[k:] != 0
        key <<= bits
        key[: max(0, n - k)] |= np.where(alive[: max(0, n - k)], text[k:], 0)
    order = np.argsort(key, kind="stable")
    starts = np.append(True, (key[order][1:] != key[order][:-1]) | ~alive[order][1:])
    rank = np.empty(n, np.int64)
    while True:
        group = np.flatnonzero(starts)
        rank[order] = np.repeat(group, np.diff(np.append(group, n)))
        tied = np.flatnonzero(~starts | ~np.append(starts[1:], True))
        if not len(tied):
            return order
        rows = order[tied]
        key = rank[rows] << 31 | rank[rows + known]
        again = np.argsort(key)
        order[tied], key = rows[again], key[again]
        starts[tied[1:]] |= key[1:] != key[:-1]
        known *= 2


class FMIndex:
    """Counts and positions of patterns in a sequence of ints below ``symbols``; no pattern has a 0, and no match goes over one."""

    def __init__(self, text: np.ndarray, symbols: int, sampled: int = SAMPLED):
        text = np.append(text, 0).astype(np.int64)
        n, self.bits = len(text), max(1, int(symbols - 1).bit_length())
        order = suffix_order(text, self.bits)
        bwt = text[order - 1]
        self.n = n
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=symbols)))
        self.levels, self.zeros = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b & 1).astype(bool)
            self.levels.append(np.append(0, np.cumsum(one, dtype=np.int32)).astype(np.int32))
            level = np.concatenate([level[~one], level[one]])
            self.zeros.append(n - int(self.levels[-1][-1]))
        kept = (order % sampled == 0) | (bwt == 0)  # so no walk goes over a 0
        self.has_sample = np.append(0, np.cumsum(kept, dtype=np.int32)).astype(np.int32)
        self.samples = order[kept]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol is in the transform before each row, by the wavelet matrix."""
        low = np.zeros_like(row)
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            up = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            r, s = ones[row], ones[low]
            row, low = np.where(up, zeros + r, row - r), np.where(up, zeros + s, low - s)
        return row - low

    def access(self, row: np.ndarray) -> np.ndarray:
        """The symbol of the transform in each row."""
        symbol = np.zeros_like(row)
        for ones, zeros in zip(self.levels, self.zeros, strict=True):
            r = ones[row]
            up = ones[row + 1] > r
            symbol = symbol << 1 | up
            row = np.where(up, zeros + r, row - r)
        return symbol

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) whose suffixes begin with each pattern; patterns stand at the right end of their matrix row."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for step in range(patterns.shape[1]):
            live = live[(lengths[live] > step) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = patterns[live, patterns.shape[1] - 1 - step]
            base = self.first[symbol]
            low[live], high[live] = base + self.rank(symbol, low[live]), base + self.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def interval_rows(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every row of the intervals, and which interval it is of."""
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which], which


@dataclass
class Phrases:
    """Test phrases as rows of numbers, right-aligned; items[item_of[k]] is the item of phrase k."""

    vocabulary: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    item_of: np.ndarray
    items: list


def phrases_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> Phrases:
    """All windows of ``window`` consecutive words of each item; a shorter item is one window, one without words none."""
    vocabulary: dict[bytes, int] = {}
    rows, lengths, item_of = [], [], []
    for k, (_, text) in enumerate(items):
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        for i in range(max(1, len(ids) - window + 1)) if ids else ():
            part = ids[i : i + window]
            rows.append([0] * (window - len(part)) + part)
            lengths.append(len(part))
            item_of.append(k)
    return Phrases(vocabulary, np.array(rows, np.int64).reshape(-1, window), np.array(lengths, np.int64), np.array(item_of, np.int64), [i for i, _ in items])


def _positions(index: FMIndex, rows: np.ndarray) -> np.ndarray:
    """Text positions of rows, by the sampled suffixes. Rows are walked backwards in step; a row that meets a sample is done."""
    out = np.zeros(len(rows), np.int64)
    live, row, walked = np.arange(len(rows)), rows.copy(), 0
    while len(live):
        done = index.has_sample[row + 1] > index.has_sample[row]
        out[live[done]] = index.samples[index.has_sample[row[done]]] + walked
        live, row = live[~done], row[~done]
        symbol = index.access(row)
        row = index.first[symbol] + index.rank(symbol, row)
        walked += 1
    return out


def find(numbers: list[np.ndarray], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[set]]:
    """For each document, given as word numbers, its merged spans of hit words and the numbers of the items that occur in it."""
    spans: list[list[tuple[int, int]]] = [[] for _ in numbers]
    items: list[set] = [set() for _ in numbers]
    ends = np.cumsum([len(x) + 1 for x in numbers]) if numbers else np.empty(0, np.int64)
    whole = np.concatenate([y for x in numbers for y in (x, [0])]) if numbers else np.empty(0, np.int64)
    # Words that no phrase has match nothing: a run of them is one 0 in the index.
    kept = np.flatnonzero((whole != 0) | (np.append(1, whole[:-1]) != 0))
    text = whole[kept]
    if not len(phrases.patterns) or not text.any():
        return spans, items
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    low, high = index.search(phrases.patterns, phrases.lengths)
    rows, which = index.interval_rows(low, high)
    if not len(rows):
        return spans, items
    distinct, back = np.unique(rows, return_inverse=True)
    start = kept[_positions(index, distinct)[back.reshape(-1)]]
    doc = np.searchsorted(ends, start, "right")
    for d, i in {(int(a), int(b)) for a, b in zip(doc, phrases.item_of[which], strict=True)}:
        items[d].add(i)
    order = np.argsort(start, kind="stable")
    begin = ends - np.array([len(x) + 1 for x in numbers])
    for d, a, n in zip(doc[order].tolist(), (start - begin[doc])[order].tolist(), phrases.lengths[which][order].tolist(), strict=True):
        if spans[d] and a <= spans[d][-1][1]:
            spans[d][-1] = (spans[d][-1][0], max(spans[d][-1][1], a + n))
        else:
            spans[d].append((a, a + n))
    return spans, items


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _sorted_ids(ids: set[int | None]) -> list[int | None]:
    return sorted(ids, key=lambda i: (i is None, i))


def _lists(rows: Iterator[list[int | None]]) -> pa.ListArray:
    rows = list(rows)
    flat = pa.array([v for x in rows for v in x], pa.int64())
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in rows])).astype(np.int32)), flat)


#: Columns that locate adds.
FOUND = {"n_words": "long", "span_starts": "array<bigint>", "span_ends": "array<bigint>", "item_ids": "array<bigint>"}


def _one_pass(docs: DataFrame, phrases: Phrases, shard_words: int) -> DataFrame:
    """``docs`` with the columns of FOUND; those that are there from a pass before are added to."""
    from pyspark.sql.types import StructType

    earlier = "span_starts" in docs.columns
    base = [f for f in docs.schema.fields if f.name not in FOUND]
    at = [f.name for f in docs.schema.fields].index("text")
    sent = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        number = known.vocabulary.get
        for batch in batches:
            n_words, spans, items = [], [], []
            held: list[np.ndarray] = []
            words = 0

            def close() -> None:
                nonlocal words
                s, i = find(held, known)
                spans.extend(s)
                items.extend(_sorted_ids({known.items[k] for k in x}) for x in i)
                held.clear()
                words = 0

            for text in batch.column(at):
                found = words_of(text.as_py())
                n_words.append(len(found))
                held.append(np.fromiter(map(number, found, repeat(0)), np.int64, len(found)))
                words += len(found)
                if words >= shard_words:
                    close()
            close()
            if earlier:
                starts, stops = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("span_starts", "span_ends"))
                spans = [_merged(list(zip(a, b, strict=True)), s) for a, b, s in zip(starts, stops, spans, strict=True)]
                before = batch.column(batch.schema.get_field_index("item_ids")).to_pylist()
                items = [_sorted_ids({*b, *i}) for b, i in zip(before, items, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in base), pa.array(n_words, pa.int64()), _lists([a for a, _ in x] for x in spans), _lists([b for _, b in x] for x in spans), _lists(items)], [*(f.name for f in base), *FOUND])

    schema = StructType(list(base))
    for f in StructType.fromDDL(", ".join(f"{k} {v}" for k, v in FOUND.items())).fields:
        schema = schema.add(f)
    return docs.mapInArrow(run, schema)


def locate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs(text, ...)`` with n_words, span_starts and span_ends (word offsets of merged runs of hit words, end exclusive) and item_ids (sorted).

    ``benchmark(item_id, text)`` is measured first and sent to the executors
    in as many blocks as ``block_bytes`` asks for, one after another; documents
    are never shuffled. A null or empty text has no words and no span, and so
    has every text if the benchmark is empty. Items with the same item_id are
    searched each and named once; so are items without an item_id, as a null at
    the end of item_ids. Repeated documents are searched each; a document
    longer than a shard is a shard of its own and is searched whole. Columns of
    these names in ``docs`` are replaced; all others stay. An empty table of
    documents gives no row.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    out = docs.drop(*FOUND)
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        out = _one_pass(out, phrases_of([tuple(r) for r in part.orderBy("item_id", "text").collect()], window), shard_words)
    return out


def contaminated() -> F.Column:
    """The rule: some word is hit, and at least one in twenty."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def n_hit() -> F.Column:
    return F.aggregate(F.zip_with("span_starts", "span_ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda n, x: n + x)


def op5_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document against the whole benchmark."""
    found = locate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return (
        found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
        .withColumn("contaminated", contaminated())
        .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    )


OP5_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS phrase, least(len(w), 13) AS n
      FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
      FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
f AS (SELECT r, i, n, item_id FROM s JOIN p USING (phrase, n)),
h AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS k FROM (SELECT DISTINCT r, i, n FROM f)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT r, item_id FROM f) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
