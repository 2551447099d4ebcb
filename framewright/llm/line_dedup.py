"""Removal of repeated runs of lines by content-defined chunks of lines.

A rolling hash over line hashes chooses where chunks end, by what the lines
are and not by where they stand, so a passage has the same chunks in every text
but for its first and last lines. Chunks of several lines meet by their hash
and are compared by their bytes; one that a smaller doc_id has goes whole.
What is left of a passage, its lines outside its outer boundaries or all of
it if it holds none, is found by the densest mask: windows of ``least_lines``
lines from every line on, of all lines but those inside chunks that are gone
already (the document that keeps such a chunk has their windows). So every
repeated run of so many lines or more goes whole, wherever it begins. Of what
is repeated the first stays: the one in the smallest doc_id, and in it the
first. Hashes only bring chunks and windows together; their bytes decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import Scratch, document_key, stored, table

#: Lines under the rolling hash, and about how many there are in a chunk.
ROLLED, MEAN = 2, 4
#: Repeated hashes up to which they are broadcast; beyond, chunks are shuffled to them.
BROADCAST_HASHES = 1 << 20
#: Bits of the largest bitmap of repeated hashes, as a power of two.
BITMAP = 27
#: Lines from which a chunk or a run can be removed.
LINES = 2

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def line_hashes(lines: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64)


def chunk_ends(h: np.ndarray, rolled: int = ROLLED, mean: int = MEAN) -> np.ndarray:
    """Where the chunks of a text end, by its line hashes: after ``rolled`` lines whose rolling hash meets the mask, and at the end."""
    sums = np.append(np.uint64(0), np.cumsum(h * _FACTOR, dtype=np.uint64))
    roll = (sums[1:] - sums[np.maximum(np.arange(len(h)) + 1 - rolled, 0)]) * _FACTOR
    ends = np.flatnonzero((roll >> np.uint64(32)) % np.uint64(mean) == 0) + 1
    return ends if len(ends) and ends[-1] == len(h) else np.append(ends, len(h))


def rolled_up(h: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A hash of the ``n`` lines from each line on that has so many."""
    each = max(0, len(h) - n + 1)
    roll = h[:each].copy()
    for k in range(1, n):
        roll = (roll ^ (roll >> np.uint64(29))) * _FACTOR + h[k : each + k]
    roll = (roll ^ (roll >> np.uint64(32))) * _FACTOR
    return (roll >> np.uint64(64 - bits)).view(np.int64)


def chunk_hashes(h: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """A hash of the lines of each chunk."""
    starts = np.append(0, ends[:-1])
    return np.array([xxhash.xxh3_64_intdigest(h[a:b]) >> (64 - bits) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


def _measured(keyed: DataFrame, n: int, bits: int) -> DataFrame:
    """key, chunk (its hash, null if it is of fewer lines), inner and edge: hashes of the windows inside a chunk and of those that end behind it; chunks that are equal in a document are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int | None, np.ndarray, np.ndarray]] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = line_hashes(text.as_py().encode().split(b"\n")) if text.is_valid else np.empty(0, np.uint64)
                if len(h) < n:
                    continue
                ends, w = chunk_ends(h), rolled_up(h, n, bits)
                starts = np.append(0, ends[:-1])
                inner = np.clip(ends - n + 1, starts, ends)
                seen = set()
                for c, a, b, e in zip(chunk_hashes(h, ends, bits).tolist(), starts.tolist(), inner.tolist(), ends.tolist(), strict=True):
                    edge = w[b : min(e, len(w))]
                    if c not in seen or len(edge):
                        rows.append((key, c if e - a >= n else None, w[a:b], edge))
                        seen.add(c)
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(r[k]) for r in rows)]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *(r[k] for r in rows)]))) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *lists], ["key", "chunk", "inner", "edge"])

    return keyed.select("key", "text").mapInArrow(run, "key long, chunk long, inner array<bigint>, edge array<bigint>")


def _bitmap(hashes: DataFrame, n: int, bits: int) -> tuple[int, np.ndarray]:
    """Width, and bits of ``n`` hashes by their upper bits, about 16 bits for each up to BITMAP in all: what isn't set is none of them."""
    width = min(BITMAP, bits, max(16, int(16 * n).bit_length()))
    at = hashes.select(F.shiftright("h", bits - width).alias("at"))
    words = at.selectExpr("shiftright(at, 5) AS word", "shiftleft(1L, cast(at & 31 AS int)) AS bit").groupBy("word").agg(F.bit_or("bit").alias("set"))
    out = np.zeros(max(1, 1 << width >> 5), np.uint32)
    found = words.toArrow()
    out[found["word"].to_numpy()] = found["set"].to_numpy()
    return width, out


def _bytes_of(keyed: DataFrame, n: int, bits: int, sent, whole: bool) -> DataFrame:
    """h, lines, key for the chunks (``whole``) or windows whose hash the bitmap ``sent`` has: each of a batch once, with the least key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, bitmap = sent.value
        for batch in batches:
            rows: dict[tuple[int, bytes], int] = {}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                lines = text.as_py().encode().split(b"\n")
                h = line_hashes(lines)
                if whole:
                    ends = chunk_ends(h)
                    starts, h = np.append(0, ends[:-1]), chunk_hashes(h, ends, bits)
                else:
                    h = rolled_up(h, n, bits)
                    starts, ends = np.arange(len(h)), np.arange(len(h)) + n
                at = h >> (bits - width)
                hit = (bitmap[at >> 5] >> (at & 31).astype(np.uint32) & np.uint32(1)).astype(bool) & (ends - starts >= n)
                for i in np.flatnonzero(hit).tolist():
                    found = int(h[i]), b"\n".join(lines[starts[i] : ends[i]])
                    rows[found] = min(key, rows.get(found, key))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary()), pa.array(list(rows.values()), pa.int64())], ["h", "lines", "key"])

    return keyed.select("key", "text").mapInArrow(run, "h long, lines binary, key long")


def _owned(keyed: DataFrame, hashes: DataFrame, n: int, bits: int, whole: bool, scratch: Scratch) -> DataFrame:
    """key, and what of ``hashes(h, key)`` a smaller key has: ``gone`` (hashes), or ``lines`` (bytes) where different bytes share a hash.

    Only what has a repeated hash is compared, by bytes that are sent once for a
    batch.
    """
    several = scratch.stored(hashes.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("h"), "several")
    count = several.count()
    few = lambda df, k: F.broadcast(df) if k <= BROADCAST_HASHES else df
    bitmap = keyed.sparkSession.sparkContext.broadcast(_bitmap(several, count, bits))
    # The bitmap lets some others pass by chance.
    found = _bytes_of(keyed, n, bits, bitmap, whole).join(few(several, count), "h", "left_semi").groupBy("h", "lines").agg(F.min("key").alias("first"))
    # Where all bytes of a hash are equal the hash stands for them from here on; the others are named by their bytes.
    each = F.collect_list(F.struct("lines", "first"))
    found = found.groupBy("h").agg(F.min("first").alias("first"), each.alias("all")).select("h", "first", F.when(F.size("all") > 1, F.col("all")).alias("clash"))
    found = scratch.stored(found, "found")
    less = F.transform(F.filter("clash", lambda x: x["first"] < F.col("key")), lambda x: x["lines"])
    after = hashes.join(few(found, count), "h").filter("first < key")
    return scratch.stored(after.select("key", "h", F.col("clash").isNull().alias("sure"), less.alias("lines")).distinct(), "owned")


def _covered(lines: list[bytes], n: int, bits: int, gone_chunks: tuple[set, set], gone: np.ndarray, known: set[bytes]) -> np.ndarray:
    """Which lines go: those of a chunk that is gone, and those that a window covers whose hash is in ``gone``, whose bytes are in ``known``, or that is before it in the text without a common line."""
    hashes = line_hashes(lines)
    h = rolled_up(hashes, n, bits)
    hit = np.isin(h, gone)
    sure, spelled = gone_chunks
    if sure or spelled:
        ends = chunk_ends(hashes)
        for c, a, e in zip(chunk_hashes(hashes, ends, bits).tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if e - a >= n and (c in sure or spelled and b"\n".join(lines[a:e]) in spelled):
                hit[a : e - n + 1] = True
    first: dict[bytes, int] = {}
    several = np.isin(h, np.sort(h)[1:][np.diff(np.sort(h)) == 0])
    for i in np.flatnonzero(~hit & (several | bool(known))).tolist():
        window = b"\n".join(lines[i : i + n])
        hit[i] = window in known or first.setdefault(window, i) <= i - n
    covered = np.zeros(len(lines), bool)
    for k in range(n if len(h) else 0):
        covered[k : k + len(h)] |= hit
    return covered


def remove_repeated_chunks(docs: DataFrame, least_lines: int = LINES, bits: int = 63, scratch: Scratch | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the text left of each row, and n_lines, n_removed_lines, n_removed_chunks (maximal removed runs).

    Removed is every line of a run of ``least_lines`` lines or more whose equal
    is in a document with a smaller doc_id, or before it in the same text
    without a line in common. Empty lines count as lines; a single repeated
    line stays. Texts are judged on the input. A null text stays null and
    counts no lines; an empty one has one empty line. Rows with the same doc_id
    take nothing from each other; a null doc_id is smaller than any other,
    and rows without one stand in the order of a hash of their texts. Texts of
    any length count whole. Columns of these names are replaced, all others stay. Hashes have ``bits``
    bits; with fewer, more bytes are sent and the result is the same. An empty
    table gives no row. What is stored on the way lies in ``scratch``, which
    can be cleared when the result has been written.
    """
    from pyspark.sql.types import LongType, StructType

    docs = docs.drop("n_lines", "n_removed_lines", "n_removed_chunks")
    key = document_key()
    keyed = docs.select(key.alias("key"), "text")
    scratch = scratch or Scratch(docs.sparkSession, "chunks")
    measured = scratch.stored(_measured(keyed, least_lines, bits), "measured")
    chunk = _owned(keyed, measured.filter("chunk is not null").select(F.col("chunk").alias("h"), "key"), least_lines, bits, True, scratch)
    # A chunk whose hash stands for several texts keeps its windows: they are few, and judged by themselves.
    inside = measured.join(chunk.filter("sure").select(F.col("key").alias("__k"), F.col("h").alias("__h")).withColumn("__gone", F.lit(True)), (F.col("key") == F.col("__k")) & (F.col("chunk") == F.col("__h")), "left")
    left = inside.select(F.explode(F.when(F.col("__gone"), F.col("edge")).otherwise(F.concat("inner", "edge"))).alias("h"), "key").distinct()
    window = _owned(keyed, scratch.stored(left, "windows"), least_lines, bits, False, scratch)
    both = chunk.withColumn("whole", F.lit(True)).unionByName(window.withColumn("whole", F.lit(False)))
    names = lambda whole: [F.collect_list(F.when((F.col("whole") == whole) & F.col("sure"), F.col("h"))), F.flatten(F.collect_list(F.when(F.col("whole") == whole, F.col("lines"))))]
    after = both.groupBy("key").agg(*(c.alias(x) for c, x in zip([*names(True), *names(False)], ("__chunks", "__spelled", "__gone", "__known"), strict=True)))
    rows = docs.withColumn("__key", key).join(after.withColumnRenamed("key", "__key"), "__key", "left").drop("__key")
    at, last = rows.columns.index("text"), len(rows.columns) - 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, sure, spelled, gone, known in zip(batch.column(at), *(batch.column(last + k).to_pylist() for k in (0, 1)), batch.column(last + 2), batch.column(last + 3).to_pylist(), strict=True):
                if not text.is_valid:
                    texts.append(None)
                    counts.append((0, 0, 0))
                    continue
                lines = text.as_py().encode().split(b"\n")
                covered = _covered(lines, least_lines, bits, (set(sure or ()), set(spelled or ())), gone.values.to_numpy() if gone.is_valid else np.empty(0, np.int64), set(known or ()))
                texts.append(b"\n".join(x for x, c in zip(lines, covered, strict=True) if not c).decode())
                counts.append((len(lines), int(covered.sum()), int((np.diff(covered.astype(np.int8), prepend=0) == 1).sum())))
            yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:last])), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))], [*batch.schema.names[:last], "n_lines", "n_removed_lines", "n_removed_chunks"])

    schema = StructType(list(rows.schema.fields[:last]))
    for name in ("n_lines", "n_removed_lines", "n_removed_chunks"):
        schema = schema.add(name, LongType())
    return rows.mapInArrow(run, schema)


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document without the runs of several lines that a document before it has."""
    scratch = Scratch(spark, "chunks")
    found = remove_repeated_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch=scratch)
    out = stored(found.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", F.sha2("text", 256).alias("kept_sha256"), "text"), "lines")
    scratch.clear()
    return out
