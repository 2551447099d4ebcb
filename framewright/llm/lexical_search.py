"""Ranked lexical search: an Aho-Corasick automaton of all item terms reads the documents.

The texts' bytes become lower case and every byte between terms a blank, with
a blank before, between and after texts. The automaton's patterns are the
terms with a blank on both sides, so a match is a whole term, and neighbours
share their blank. No index of the documents is made: one scan gives the
numbers that weights need (documents, terms, documents of each item term), a
second one counts each document's terms again, scores it for all items and
keeps the best of each item in the task.

The automaton is built from a block of items whose terms have ``BLOCK_BYTES``
at most; more items are further blocks, each with scans of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm import words
from framewright.llm.common import table

K = 10
#: Bytes of the terms, blanks included, of one block of items, and the number of its (item, term) pairs.
BLOCK_BYTES = 1 << 20
BLOCK_PAIRS = 1 << 20
#: A term that more than this part of the items have is a column of a matrix, others have lists of items.
COMMON = 0.25
#: Bytes of text that are scanned at a time.
CHUNK = 1 << 18
#: Scores of one batch that are made at a time.
CELLS = 1 << 22
FOUND = "item long, item_id string, id long, score long"

_BYTES = np.arange(256)
_INSIDE = (_BYTES >= 128) | (_BYTES >= 48) & (_BYTES <= 57) | (_BYTES >= 65) & (_BYTES <= 90) | (_BYTES >= 97) & (_BYTES <= 122)
#: What each byte is read as: a byte of a term, A-Z as a-z, or a blank.
READ_AS = np.where(_INSIDE, np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES), 32).astype(np.uint8)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in their order, with repeats; null has none."""
    return READ_AS[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split()


class Items:
    """A block of items: its terms, and how often each item has each of them."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.terms: list[bytes] = []
        at: dict[bytes, int] = {}
        pairs: list[tuple[int, int, int]] = []  # term, item, times
        for i, text in enumerate(texts):
            times: dict[int, int] = {}
            for term in terms_of(text):
                t = at.setdefault(term, len(at))
                times[t] = times.get(t, 0) + 1
            pairs += [(t, i, n) for t, n in times.items()]
        self.terms = list(at)
        term, self.item, self.times = (np.array(x, np.int64) for x in (zip(*sorted(pairs), strict=True) if pairs else ((), (), ())))
        self.held = np.bincount(term, minlength=len(at))  # by how many items
        self.starts = np.cumsum(self.held) - self.held
        self.common = np.flatnonzero(self.held > COMMON * len(ids))
        self.column = np.full(len(at), -1)
        self.column[self.common] = np.arange(len(self.common))
        self.matrix = np.zeros((len(self.common), len(ids)))
        own = self.column[term]
        self.matrix[own[own >= 0], self.item[own >= 0]] = self.times[own >= 0]

    def __hash__(self) -> int:
        return hash((len(self.item), *self.terms[:100]))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Items) and (self.ids, self.terms) == (other.ids, other.terms)

    def scores(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, n_docs: int) -> np.ndarray:
        """Exact sums of part * times for every document and item; doubles hold each half of a part."""
        out = np.zeros((n_docs, len(self.ids)), np.int64)
        column = self.column[term]
        many = column >= 0
        for shift, half in ((24, part >> 24), (0, part & ((1 << 24) - 1))):
            left = np.zeros((n_docs, len(self.common)))
            left[doc[many], column[many]] = half[many]
            out += (left @ self.matrix).astype(np.int64) << shift
        doc, term, part = doc[~many], term[~many], part[~many]
        held = self.held[term]
        at = np.repeat(self.starts[term] - np.cumsum(held) + held, held) + np.arange(held.sum())
        np.add.at(out.reshape(-1), np.repeat(doc, held) * len(self.ids) + self.item[at], np.repeat(part, held) * self.times[at])
        return out


@lru_cache(1)
def automaton(items: Items):
    """The automaton whose outputs are numbers of terms; a worker builds it once."""
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, term in enumerate(items.terms):
        made.add_word(f" {term.decode('latin-1')} ", number)
    made.make_automaton()
    return made


def counted(texts: pa.Array, items: Items) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of texts: the first one's place, numbers of terms n of each, and as three columns (text, term, tf) what the automaton found.

    A long text is read in pieces that end between words; its numbers are sums.
    """
    found = automaton(items) if items.terms else None
    for at, upto, pieces in words.parts(texts, CHUNK):
        n, docs, terms = np.zeros(upto - at, np.int64), [], []
        for data, begins in pieces:
            read = np.append(np.insert(READ_AS[data], begins, 32), np.uint8(32))
            begins = begins + np.arange(len(begins))
            blank = read == 32
            opens = np.flatnonzero(blank[:-1] & ~blank[1:])
            doc = np.searchsorted(begins, opens, "right") - 1
            n += np.bincount(doc, minlength=len(n))
            if found is not None and len(opens):
                hits = np.fromiter(chain.from_iterable(found.iter(read.tobytes().decode("latin-1"))), np.int64).reshape(-1, 2)
                docs.append(np.searchsorted(begins, hits[:, 0] - 1, "right") - 1)
                terms.append(hits[:, 1])
        both, times = np.unique(np.concatenate([np.empty(0, np.int64), *docs]) * max(1, len(items.terms)) + np.concatenate([np.empty(0, np.int64), *terms]), return_counts=True)
        yield at, n, *np.divmod(both, max(1, len(items.terms))), times


def blocks(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> Iterator[Items]:
    """All different rows of items, in blocks of which each is small enough to be sent to every task."""
    ids: list = []
    texts: list = []
    size = pairs = 0
    rows = items.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).distinct().orderBy("id", "text")
    for row in rows.toLocalIterator():
        own = terms_of(row["text"])
        more, extra = sum(len(t) + 2 for t in set(own)), len(set(own))
        if ids and (size + more > BLOCK_BYTES or pairs + extra > BLOCK_PAIRS):
            yield Items(ids, texts)
            ids, texts, size, pairs = [], [], 0, 0
        ids.append(row["id"])
        texts.append(row["text"])
        size, pairs = size + more, pairs + extra
    if ids:
        yield Items(ids, texts)


class Weights:
    """What one scan of the documents tells: N, L, and the weight of every item term."""

    def __init__(self, n_docs: int, n_terms: int, df: np.ndarray):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def weigh(documents: DataFrame, items: Items, text_column: str = "text") -> Weights:
    """One scan that gives sums only: a row for each term of the items and task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_terms = np.zeros(len(items.terms), np.int64), 0, 0
        for batch in batches:
            for _, n, _, term, _ in counted(batch.column(0), items):
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
                df += np.bincount(term, minlength=len(df))
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(term, [-1, -2]).astype(np.int32)), pa.array(np.append(df[term], [n_docs, n_terms]))], ["term", "n"])

    df, one = np.zeros(len(items.terms), np.int64), {}
    for term, n in documents.select(text_column).mapInArrow(scan, "term int, n long").groupBy("term").agg(F.sum("n")).collect():  # a row for each term of the block
        one[term] = n
        if term >= 0:
            df[term] = n
    return Weights(one.get(-1, 0), one.get(-2, 0), df)


class Best:
    """The k best rows of each item so far, with their scores."""

    def __init__(self, n_items: int, k: int):
        self.k, self.least = k, np.ones(n_items, np.int64)
        self.item, self.doc, self.score = (np.empty(0, np.int64) for _ in range(3))

    def add(self, doc: np.ndarray, scores: np.ndarray) -> None:
        """doc: ids, ascending ids first among ties; scores: a row for each of them, a column for each item."""
        at, item = np.nonzero(scores >= self.least)
        if not len(at):
            return
        self.item, self.doc, self.score = np.append(self.item, item), np.append(self.doc, doc[at]), np.append(self.score, scores[at, item])
        order = np.lexsort((self.doc, -self.score, self.item))
        ranked = self.item[order]
        place = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        order, place = order[place < self.k], place[place < self.k]
        self.item, self.doc, self.score = self.item[order], self.doc[order], self.score[order]
        full = place == self.k - 1
        self.least[self.item[full]] = self.score[full]


def rank(documents: DataFrame, items: DataFrame, k: int = K, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, of those with a score above 0; ties by ascending doc_id.

    An item is a different row of ``items``: equal rows count once, two texts
    of one id are two items; a null text has no terms and finds nothing. Every
    row of ``documents`` is a document, equal ones too; rows without an id
    come last among ties. Without documents or items there is no row. Only the
    named columns are read.
    """
    spark = documents.sparkSession
    kinds = dict(documents.dtypes)[id_column], dict(items.dtypes)[item_column]
    docs = documents.select(F.col(text_column).alias("text"), F.col(id_column).cast("long").alias("id"))
    out = spark.createDataFrame([], f"{FOUND}, block int")
    for number, block in enumerate(blocks(items, item_column, item_text)):
        found = _scored(docs, block, weigh(docs, block), k).withColumn("block", F.lit(number))
        out = out.unionByName(found) if number else found
    best = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    out = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return out.select(F.col("item_id").cast(kinds[1]).alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("id").cast(kinds[0]).alias("doc_id"), "score")


def _scored(docs: DataFrame, items: Items, weights: Weights, k: int) -> DataFrame:
    """The scan that scores: each task gives the k best of its documents for each item."""
    n_docs, n_terms, weight = weights.n_docs, max(1, weights.n_terms), weights.weight
    unnamed = np.iinfo(np.int64).max

    def shares(n: np.ndarray) -> np.ndarray:
        if 75 * n_docs * int(n.max(initial=0)) < 1 << 63:
            return (75 * n * n_docs) // n_terms
        return np.array([75 * int(x) * n_docs // n_terms for x in n], np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, step = Best(len(items.ids), k), max(1, CELLS // max(len(items.ids), len(items.common), 1))
        for batch in batches:
            ids = batch.column(1).fill_null(unnamed).to_numpy()
            for at, n, doc, term, tf in counted(batch.column(0), items):
                m = 100 - 75 + shares(n)
                part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                for low in range(0, len(n), step):
                    own = (doc >= low) & (doc < low + step)
                    if own.any():
                        some = min(step, len(n) - low)
                        best.add(ids[at + low : at + low + some], items.scores(doc[own] - low, term[own], part[own], some))
        names = pa.array([None if x is None else str(x) for x in items.ids], pa.string())
        ids = pa.array(best.doc, mask=best.doc == unnamed)
        yield pa.RecordBatch.from_arrays([pa.array(best.item), names.take(pa.array(best.item)), ids, pa.array(best.score)], ["item", "item_id", "id", "score"])

    return docs.mapInArrow(scan, FOUND)


def op12_automaton_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY item_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g GROUP BY term),
s AS (SELECT q.item_id, tf.doc_id, sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n.n * g.docs) // g.terms))))::BIGINT AS score
    FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n ON n.doc_id = tf.doc_id, g GROUP BY q.item_id, tf.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {K}
"""
