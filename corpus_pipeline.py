"""The corpus pipeline: language, near copies, benchmark passages, mixture, token files.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import decontaminate, jaccard_join, language_id, mixing, token_files
from framewright.llm.common import Scratch, smaller_batches, stored, table


def _carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The ``needed`` columns, and all others in one column, so that no name of theirs clashes with an operator's."""
    return docs.select(*needed, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in needed), F.lit(0).alias("carried")).alias("others"))


def _restored(rows: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of ``docs`` from what ``_carried`` made of them."""
    return rows.select(*(F.col(c) if c in needed else F.col(f"others.`{c}`").alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those that are ``und`` (no text, or none with a letter) go.

    The columns stay as they are: lang is what the corpus says, and empty ones
    take the prediction.
    """
    smaller_batches(spark)
    profiles = language_id.learn(docs.filter(~language_id.held_out()).select("doc_id", "text", "lang"))
    found = language_id.predict(_carried(docs, "text", "lang"), profiles).filter(F.col("lang_pred") != language_id.UNKNOWN)
    return _restored(found.withColumn("lang", F.coalesce("lang", "lang_pred")), docs, "text", "lang")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of five-word shingles at 0.8: of the least doc_id, nulls last, and of its rows one with the least hash of the text.

    Rows that have both in common are copies: one of them stays. Rows with the
    same doc_id, or none, and other texts are judged each by its own text; rows
    without a word are linked with nothing and all stay. Of copies, the one
    whose other columns are least as JSON stays. An empty table gives no row.
    """
    smaller_batches(spark)
    scratch = Scratch(spark, "copies")
    rows = scratch.stored(jaccard_join.linked(docs.select("doc_id", "text"), 5, 4, 5, scratch).filter("label is not null"), "rows")
    groups = rows.groupBy("label", "doc_id", "at").count().withColumn("key", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "at"))
    groups = scratch.stored(groups, "groups")
    first = groups.groupBy("label").agg(F.min("key").alias("first"))
    groups = groups.join(first, "label").withColumn("stays", F.col("key").eqNullSafe(F.col("first")))
    gone = stored(groups.filter("not stays").select(F.col("doc_id").alias("gone_id"), F.col("at").alias("gone_at")).distinct(), "gone")
    repeated = stored(groups.filter("stays and count > 1").select(F.col("doc_id").alias("gone_id"), F.col("at").alias("gone_at")).distinct(), "repeated")
    scratch.clear()

    def like(keys: DataFrame) -> tuple[DataFrame, Column]:
        return F.broadcast(keys) if keys.count() <= jaccard_join.BROADCAST_IDS else keys, (jaccard_join.text_key() == F.col("gone_at")) & F.col("doc_id").eqNullSafe(F.col("gone_id"))

    bare = _carried(docs, "doc_id", "text")
    rest = bare.join(*like(gone), "left_anti")
    if not repeated.isEmpty():
        again = rest.join(*like(repeated), "left_semi").groupBy("doc_id", "text").agg(F.min_by("others", F.to_json("others")).alias("others"))
        rest = rest.join(*like(repeated), "left_anti").unionByName(again)
    return _restored(rest, docs, "doc_id", "text")


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage worth a twentieth of their words. Null and empty texts hold none and stay."""
    smaller_batches(spark)
    found = decontaminate.locate(_carried(docs, "text"), table(spark, sf_dir, "benchmark"))
    return _restored(found.withColumn("n_hit", decontaminate.n_hit()).filter(~decontaminate.contaminated()), docs, "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources up to so often again as the mixture asks for."""
    plan = mixing.plan(mixing.token_counts(docs), mixing.TARGET, seed=mixing.SEED)
    return _restored(mixing.realise(_carried(docs, "doc_id", "source"), plan, mixing.SEED, mixing.BLOCKS), docs, "doc_id", "source")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files hold of each row: doc_id, start, n_tokens, ids_crc32."""
    smaller_batches(spark)
    return token_files.token_table(docs)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: A prediction of a language and ids of a tokenizer are not SQL: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, in turn; what a stage kept is deleted when the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        scratch = Scratch(spark, name)
        docs = scratch.stored(stage(spark, docs, sf_dir), name)
        if before:
            before.clear()
        before = scratch
    tokens = STAGES[-1][1](spark, docs, sf_dir)  # they are written by now
    before.clear()
    return tokens
