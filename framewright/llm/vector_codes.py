"""Vector code compression: product codes whose distances are taken in the Walsh-Hadamard domain.

A vector of integers is cut into equal parts, and each part is replaced by the
index of the nearest entry of its codebook. The distance of a part to an entry
is summed over the integer Walsh-Hadamard transforms of both, zero-padded to a
power of two P: the transform keeps squared distances up to the factor P, so
nothing is rounded. Coefficients are taken in sequency order (by number of
sign changes), where most of the difference comes early; after each of them
an entry whose sum is over the smallest complete distance known so far is out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import Scratch, stored, table
from framewright.llm.vectors import LARGEST, integers, measured

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Labels of which the sums are broadcast at most.
BROADCAST_LABELS = 100_000


@lru_cache
def sequency(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of ``size`` (a power of two), rows by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")]


def transformed(parts: np.ndarray) -> np.ndarray:
    """Integer transforms of the last axis, zero-padded to a power of two, in sequency order."""
    size = 1 << max(0, parts.shape[-1] - 1).bit_length()
    padded = np.zeros((*parts.shape[:-1], size), np.int64)
    padded[..., : parts.shape[-1]] = parts
    return padded @ sequency(size).T


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row its nearest entry (ties to the lower index), their squared distance, and how many coefficients were compared.

    The first coefficient is compared with all entries; the entry that is
    nearest by it is then completed, and its distance bounds the others, which
    leave one by one.
    """
    x, e = transformed(parts), transformed(entries)
    size = x.shape[1]
    sums = np.square(x[:, :1] - e[:, 0])
    guess = sums.argmin(1)
    bound = np.square(x - e[guess]).sum(1)
    row, entry = np.nonzero(sums <= bound[:, None])
    part, compared = sums[row, entry], sums.size + len(x) * (size - 1)
    for c in range(1, size):
        part = part + np.square(x[row, c] - e[entry, c])
        compared += len(row)
        stays = part <= bound[row]
        row, entry, part = row[stays], entry[stays], part[stays]
    order = np.lexsort((entry, part, row))
    first = order[np.flatnonzero(np.append(True, np.diff(row[order]) != 0))] if len(order) else order
    return entry[first], part[first] // size, compared


def _cut(rows: np.ndarray, parts: int) -> np.ndarray:
    """Vectors in equal consecutive parts, the last ones filled up with zeros."""
    size = max(1, -(-rows.shape[1] // parts))
    out = np.zeros((len(rows), parts * size), np.int64)
    out[:, : rows.shape[1]] = rows
    return out.reshape(len(rows), parts, size)


class Codebooks:
    """Entries of every part position: an array of parts, entries, positions inside a part."""

    def __init__(self, entries: np.ndarray, width: int, scale: int):
        self.entries, self.width, self.scale = entries, width, scale
        size = 1 << max(0, entries.shape[2] - 1).bit_length()
        self.largest = LARGEST / (4 * size)  # so that sums of squared differences of transforms fit 64 bits

    def digest(self) -> str:
        return sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def codes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry, for each row and part."""
        cut = _cut(rows, len(self.entries))
        found = [nearest(cut[:, p], self.entries[p]) for p in range(len(self.entries))]
        return np.stack([x[0] for x in found], 1), np.stack([x[1] for x in found], 1)


def _moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Entries replaced by the floor of the means of their parts; one row for each part, entry and task meets in the sum."""
    parts, n_entries, size = books.entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((parts, n_entries), np.int64), np.zeros((parts, n_entries, size), np.int64)
        for batch in batches:
            _, x = integers(batch.column(0), books.scale, books.width, books.largest)
            if len(x):
                cut, (code, _) = _cut(x, parts), books.codes(x)
                for p in range(parts):
                    counts[p] += np.bincount(code[:, p], minlength=n_entries)
                    np.add.at(totals[p], code[:, p], cut[:, p])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(list(totals[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    spread = vectors.mapInArrow(sums, "part int, entry int, n long, total array<bigint>")
    summed = spread.select("part", "entry", "n", F.posexplode("total").alias("at", "value")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
    entries = books.entries.copy()
    for r in summed.collect():  # parts x entries x positions
        entries[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return Codebooks(entries, books.width, books.scale)


def train(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks that start as the parts of the vectors with the smallest ids and are moved in every round by all vectors.

    Rows without an id come last, equal ids go by the vector. With fewer
    vectors than ``entries`` there are as many entries as vectors, and none
    without vectors. Shorter vectors, and a width that ``parts`` doesn't
    divide, are filled up with zeros.
    """
    rows = vectors.select(F.col(vector_column).alias("vector"), F.col(id_column).alias("id"))
    _, width, _ = measured(rows, "vector", scale)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    first = rows.filter(F.col("vector").isNotNull() & finite).orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").toArrow()
    start = _cut(integers(first.column(0).combine_chunks(), scale, width)[1], parts) if first.num_rows else np.zeros((0, parts, max(1, -(-width // parts))), np.int64)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)), width, scale)
    if len(start):
        for _ in range(rounds):
            books = _moved(rows.select("vector"), books)
    return books


def encode(vectors: DataFrame, books: Codebooks, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """id, label, code (two hex digits for each part), error: one row for each vector that is kept; other columns don't come along."""
    rows = vectors.select(F.col(vector_column).alias("vector"), F.col(id_column).alias("id"), F.col(label_column).alias("label"))
    parts = len(books.entries)
    digits = np.array([f"{i:02x}" for i in range(256)])
    if books.entries.shape[1] > len(digits):
        raise ValueError("two hex digits hold 256 entries at most")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, x = integers(batch.column(0), books.scale, books.width, books.largest)
            if not len(x):
                continue
            code, error = books.codes(x)
            text = digits[code[:, 0]]
            for p in range(1, parts):
                text = np.char.add(text, digits[code[:, p]])
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(mask), batch.column(2).filter(mask), pa.array(text), pa.array(error.sum(1))], ["id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(coded, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``label_error``: the error summed over rows of an equal label, nulls together. ``coded`` is read twice: store it before."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    few = sums.count() <= BROADCAST_LABELS
    return coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op13_walsh_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by codebooks of six rounds, with their errors and the codebooks' digest.

    Vectors that are null or hold null or non-finite components are left out;
    equal rows stay rows; an empty table gives none.
    """
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = train(vectors)
    scratch = Scratch(spark, "codes")
    coded = scratch.stored(encode(vectors, books), "coded")
    out = with_label_error(coded).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
    out = stored(out, "codes")
    scratch.clear()
    return out


def _sql() -> str:
    """Every round as two common tables: the parts' nearest entries, and the entries moved."""
    assigned = """a{i} AS MATERIALIZED (SELECT r, p, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT x.r, x.p, e.c, list_sum(list_transform(list_zip(x.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM x JOIN e{i} e USING (p)) GROUP BY r, p)"""
    moved = """s{i} AS (SELECT p, c, pos, sum(val) AS total, count(*) AS n FROM (
    SELECT x.p, a.c, unnest(range(1, len(x.v) + 1)) AS pos, unnest(x.v) AS val FROM x JOIN a{i} a USING (r, p)) GROUP BY ALL),
m{i} AS (SELECT p, c, list((CASE WHEN total < 0 THEN -((n - 1 - total) // n) ELSE total // n END)::BIGINT ORDER BY pos) AS v FROM s{i} GROUP BY p, c),
e{j} AS MATERIALIZED (SELECT p, c, coalesce(m{i}.v, e{i}.v) AS v FROM e{i} LEFT JOIN m{i} USING (p, c))"""
    steps = ",\n".join(f"{assigned.format(i=i)},\n{moved.format(i=i, j=i + 1)}" for i in range(ROUNDS))
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM k, (SELECT unnest(range({PARTS})) AS p)),
e0 AS MATERIALIZED (SELECT p, r AS c, v FROM x WHERE r < {ENTRIES}),
{steps},
{assigned.format(i=ROUNDS)},
b AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, c)) AS codebooks_sha256 FROM e{ROUNDS}),
o AS (SELECT r, string_agg(printf('%02x', c::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT k.vec_id, o.code, o.error, (sum(o.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, b.codebooks_sha256
FROM k JOIN o USING (r), b
"""


OP13_SQL = _sql()
