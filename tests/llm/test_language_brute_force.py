"""Language identification against a version that counts strings in dictionaries."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framewright.llm import language_id

GAP = "\1"


def counted(text):
    out = Counter()
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    line = GAP + GAP.join(letters.split()) + GAP if letters.strip() else ""
    for k, c in enumerate(line):
        if c != GAP:
            out[c] += 1
        if k + 1 < len(line):
            out[line[k : k + 2]] += 1
        if k + 2 < len(line) and line[k + 1] != GAP:
            out[line[k : k + 3]] += 1
    return out


def profile(counts, ranks):
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:ranks]


def brute(rows, ranks=300):
    learned: dict[str, Counter] = {}
    for i, text, lang in rows:
        if lang is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2):
            learned.setdefault(lang, Counter()).update(counted(text))
    places = {lang: {g: k for k, g in enumerate(profile(c, ranks))} for lang, c in sorted(learned.items()) if c}
    out = []
    for i, text, _ in rows:
        mine = profile(counted(text), ranks)
        far = [(sum(min(ranks, abs(at[g] - k)) if g in at else ranks for k, g in enumerate(mine)), lang) for lang, at in places.items()]
        out.append((i, min(far)[1], round(1 - min(far)[0] / (ranks * len(mine)), 9)) if mine and far else (i, "und", 0.0))
    return sorted(out, key=repr)


def found(spark, rows, ranks=300):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("s"), "code": F.lit(1)}).repartition(3)
    out = language_id.predict(df, language_id.learn(df.filter(~language_id.held_out()), ranks=ranks), ranks)
    return sorted(((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in out.collect()), key=repr)


@pytest.mark.parametrize("ranks", [300, 20])
def test_whole_table(spark, ranks):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert found(spark, rows, ranks) == brute(rows, ranks)


def test_edge_rows(spark):
    rows = [(1, "Éa ÉA éa", "fr"), (2, "ab ab", "en"), (2, "ab ab", "en"), (3, None, "en"), (4, "", "en"), (5, "12 -- ٣", "xx"), (None, "ba", "en"), (6, "日本 語", "ja"), (7, "ǅ İ ß", None), (8, "z" * 5000, None), (9, "a b c d", None), (10, "퟿ x", "en")]
    assert found(spark, rows) == brute(rows)
