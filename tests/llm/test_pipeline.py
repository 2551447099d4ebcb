"""The pipeline against a brute-force version of every stage."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from framewright.llm import mixing
from tests.llm.test_operators import brute_components, brute_hits


def make(spark, path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("bcdfgst") for _ in range(rng.randrange(1, 4)))
    texts = [" ".join(word() for _ in range(rng.choice([6, 40, 120]))) for _ in range(40)]
    texts += [texts[k] for k in range(5)] + [t + " tail" for t in texts[1:40:7]] + ["", "12 34 !!", None]
    items = [(k, " ".join(texts[k].split()[:20])) for k in (10, 11, 12)] + [(20, "no such words here")]
    texts.append(" ".join(word() for _ in range(900)) + " " + items[0][1])
    rows = [(k, t, rng.choice(["en", "fr", None]), "a" if k % 3 else "b", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, items


def test_run(spark, tmp_path):
    rows, items = make(spark, tmp_path)
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    first = {i for i, _, c in brute_components([(r[0], r[1]) for r in rows], 5, 4, 5) if i == c}
    rows = [r for r in rows if r[0] in first]
    clean = lambda t: (lambda n, h, _: not (h > 0 and 20 * h >= n))(*brute_hits(t, items))
    assert {r[0] for r in rows if not clean(r[1])} and any(brute_hits(r[1], items)[1] for r in rows if clean(r[1]))
    rows = [r for r in rows if clean(r[1])]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows])
    times = Counter(r[0] for r in con.execute(f"select doc_id from ({mixing.OP8_SQL})").fetchall())
    assert set(times) == {r[0] for r in rows} and max(times.values()) == 2
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(r[0], np.array([*whole.encode(r[1], add_special_tokens=False).ids, 2], "<u4")) for r in sorted(rows) for _ in range(times[r[0]])]
    starts = np.cumsum([0, *(len(x) for _, x in ids)])
    want = [(i, int(s), len(x), zlib.crc32(x.tobytes())) for (i, x), s in zip(ids, starts, strict=False)]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted(want)


def test_stages_keep_columns_and_take_nothing(spark, tmp_path):
    make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0


def test_near_copies_by_row(spark):
    """Rows with one doc_id and different texts, without a doc_id, and repeated rows are told apart by their texts."""
    base = [f"w{k}" for k in range(60)]
    near = lambda k: " ".join([*base[:-1], f"edit{k}"])
    rows = [(5, near(1)), (5, "another text of its own"), (3, near(2)), (None, near(3)), (None, "only here without an id"), (None, "only here without an id"), (8, "same row"), (8, "same row"), (9, ""), (9, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_near_copies(spark, df, "").collect()), key=repr)
    assert got == sorted([(5, "another text of its own"), (3, near(2)), (None, "only here without an id"), (8, "same row"), (9, ""), (9, ""), (None, None)], key=repr)


def test_stages_leave_columns_alone(spark, tmp_path):
    """Columns with the names that operators use come out of every stage with the values that they had."""
    make(spark, tmp_path)
    names = ["score", "lang_pred", "n_words", "n_hit", "span_starts", "span_ends", "item_ids", "pass", "block", "at", "label", "cls", "others", "a.b"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        kept = [c for c in out.columns if name != "language_id" or c != "lang"]
        before = {tuple(r) for r in docs.select(*(F.col(f"`{c}`") for c in kept)).collect()}
        after = [tuple(r) for r in out.select(*(F.col(f"`{c}`") for c in kept)).collect()]
        assert after and set(after) <= before
