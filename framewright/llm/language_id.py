"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams of a language, most
frequent first. A document's own profile is compared to each language's by
the out-of-place distance: for each n-gram of the document, how far its rank
is from its rank in the language, or the largest distance if it isn't there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm.common import table

#: Ranks in a profile.
RANKS = 300
#: Training takes about so many documents of a language at most, chosen by a hash of doc_id; all of them where there are fewer.
SAMPLE = 8000
#: N-grams that are counted at a time.
HELD = 1 << 22
UNKNOWN = "und"
#: Stands for what is between words.
_GAP = 1


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_)


def grams(text: str | None) -> np.ndarray:
    """Codes of all 1, 2 and 3 letter n-grams of a text in lower case; a gap at a word's ends counts as a letter in the longer two."""
    if not text:
        return np.empty(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letters()[c]
    if not letter.any():
        return np.empty(0, np.int64)
    c = np.concatenate(([_GAP], np.where(letter, c, _GAP), [_GAP]))
    c = c[np.append(True, (c[1:] != _GAP) | (c[:-1] != _GAP))]
    two = c[:-1] << 21 | c[1:]
    three = (two[:-1] << 21 | c[2:])[c[1:-1] != _GAP]
    return np.concatenate([c[c != _GAP], two, three])


def ranked(codes: np.ndarray, ranks: int = RANKS) -> np.ndarray:
    """The most frequent codes, most frequent first; of equally frequent ones the smaller code."""
    found, n = np.unique(codes, return_counts=True)
    if len(found) > 4 * ranks:
        least = np.partition(n, len(n) - ranks)[len(n) - ranks]
        found, n = found[n >= least], n[n >= least]
    return found[np.argsort(-n, kind="stable")][:ranks]


def learn(labelled: DataFrame, sample: int = SAMPLE, ranks: int = RANKS) -> dict[str, np.ndarray]:
    """Profiles by language, from ``labelled(doc_id, text, lang)``; rows without a language are left out.

    Only the profiles come to the driver: ``ranks`` codes for each language.
    Texts count whole. A language whose texts have no letter isn't learned.
    """
    named = labelled.filter(F.col("lang").isNotNull())
    sizes = named.groupBy("lang").count().withColumnRenamed("count", "__n")
    share = F.lit(float(sample)) / F.col("__n")
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    taken = named.join(F.broadcast(sizes), "lang").filter(drawn < share).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            held = 0
            for k, (lang, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                by.setdefault(lang, []).append(grams(text.as_py()))
                held += len(by[lang][-1])
                if held >= HELD or k == batch.num_rows - 1:
                    for name, codes in by.items():
                        found, n = np.unique(np.concatenate(codes), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(n)], ["lang", "code", "n"])
                    by, held = {}, 0

    counts = taken.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = counts.withColumn("rank", rank).filter(F.col("rank") <= ranks)
    out: dict[str, dict[int, int]] = {}
    for lang, code, r in best.select("lang", "code", "rank").toLocalIterator():
        out.setdefault(lang, {})[r] = code
    return {lang: np.array([by[r] for r in sorted(by)], np.int64) for lang, by in sorted(out.items())}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], ranks: int = RANKS) -> DataFrame:
    """``docs(text, ...)`` with lang_pred and score for each row; only the text is looked at.

    score is 1 less the distance as a share of the largest one, 0 for ``und``.
    A null text, one without a letter, and any text when nothing was learned
    are ``und``. Of equally near languages the first in the alphabet is taken.
    Texts of any length are judged whole, repeated rows each for itself.
    Columns lang_pred and score of ``docs`` are replaced; all others stay. An
    empty table gives no row.
    """
    langs = sorted(profiles)
    known = np.unique(np.concatenate([np.empty(0, np.int64), *profiles.values()]))
    place = np.full((len(known), max(1, len(langs))), 1 << 40, np.int64)
    for k, lang in enumerate(langs):
        place[np.searchsorted(known, profiles[lang]), k] = np.arange(len(profiles[lang]))
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")

    def judge(text: str | None) -> tuple[str, float]:
        mine = ranked(grams(text), ranks)
        if not len(mine) or not langs:
            return UNKNOWN, 0.0
        i = np.searchsorted(known, mine)
        i[i == len(known)] = 0
        hit = known[i] == mine
        far = np.full((len(mine), len(langs)), ranks, np.int64)
        far[hit] = np.minimum(np.abs(place[i[hit]] - np.flatnonzero(hit)[:, None]), ranks)
        total = far.sum(0)
        k = int(total.argmin())
        return langs[k], 1 - float(total[k]) / (ranks * len(mine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(run, schema)


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its doc_id as text, mod 4, is 2. A null doc_id isn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    docs = table(spark, sf_dir, "documents")
    profiles = learn(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
