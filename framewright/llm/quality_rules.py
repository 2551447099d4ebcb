"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the
measurements and one bit for each failed rule. A policy is a version with a
mask of rules; its verdict, and what each of its rules rejects alone, are
bitwise operations on the ledger, so a new policy never reads a text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Bit and condition of failure of each rule, over the measurements. Ids are never reused.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_windows": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "n_symbols > n_words"),
    "duplicate_lines": (3, "2 * n_dup_lines > n_lines"),
    "short_words": (4, "word_chars < 2 * n_words"),
    "long_words": (5, "word_chars > 20 * n_words"),
}
#: The rules of each policy, by version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words"),
}


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES[r][0] for r in rules)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more, the first included."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1].reshape(-1)
    windows = pairs[:-1] * len(numbers) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    covered = np.zeros(len(words), bool)
    at = np.concatenate([order[1:][same], order[:-1][same]])
    covered[at] = covered[at + 1] = covered[at + 2] = True
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one text; null has none of anything."""
    if not text:
        return (0,) * len(MEASURES)
    data = text.encode()
    words = data.split()
    spaces = len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), len(text) - spaces, len(data) - len(data.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed``, a bigint with the bit of every failed rule, for each row of ``docs(doc_id, text)``.

    A null or empty text measures 0 everywhere and fails ``few_words``.
    Texts of any length are measured whole. Repeated rows, and rows without a
    doc_id, are judged each on its own. Other columns are left out; an empty
    table gives an empty ledger. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(MEASURES)))], ["doc_id", *MEASURES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, rule in RULES.values()]
    failed = bits[0].cast("long")
    for b in bits[1:]:
        failed = failed.bitwiseOR(b.cast("long"))
    return rows.withColumn("failed", failed)


def passes(policy: str, failed: Column | None = None) -> Column:
    """Whether a ledger row passes a policy."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rule, n_failed, n_rejected_alone (kept if only this rule were dropped), n_kept (under the whole policy).

    The ledger is folded to one row for each distinct mask first; there are at
    most 2 to the number of rules, however long the ledger.
    """
    mask = mask_of(POLICIES[policy])
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count("*").alias("n"))
    rules = book.sparkSession.createDataFrame([(r, 1 << RULES[r][0]) for r in POLICIES[policy]], "rule string, bit long")
    has = F.col("failed").bitwiseAND(F.col("bit")) != 0
    per_rule = masks.withColumn("r", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in POLICIES[policy])))).select("failed", "n", "r.rule", "r.bit")
    counts = per_rule.groupBy("rule").agg(F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_rejected_alone"), F.sum(F.when(F.col("failed") == 0, F.col("n")).otherwise(0)).alias("n_kept"))
    return rules.select("rule").join(counts, "rule", "left").na.fill(0)


def any_all_failed(book: DataFrame, by: str) -> DataFrame:
    """For each value of a column: the rules that some of its rows fail, and those that all fail."""
    return book.groupBy(by).agg(F.bit_or("failed").alias("some_failed"), F.bit_and("failed").alias("all_failed"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents under policy v1."""
    book = ledger(table(spark, sf_dir, "documents"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes("v1").alias("kept"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
      FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
h AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM m, (VALUES (0), (1), (2)) AS o(k) GROUP BY r),
x AS (SELECT doc_id, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
      FROM w LEFT JOIN h USING (r)),
y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM y
"""
