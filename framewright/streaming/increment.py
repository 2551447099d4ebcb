"""What is to be built, and building it as files arrive.

A target that a stream publishes to is a folder:

    commits/stream=<id>/batch=<n>             one JSON line, the manifest of a batch: written last
    staged/attempt=<name>/outcome=<outcome>   rows of an attempt at a batch with version, digest and reasons
    failures/attempt=<name>                   its rejected rows, with reasons, as a log
    index/attempt=<name>/bucket=<k>           key, version and digest of its published rows
    merged/attempt=<name>/bucket=<k>          indexes that were merged in it

Only attempts that a manifest names are there for readers. A manifest also
names the indexes that hold all keys published so far, so a batch reads the
manifest before its own and of the indexes only the buckets of its keys.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from framewright.functions import digests
from framewright.operators import quality
from framewright.sources.files import append_failures
from framewright.streaming.outcomes import Outcome, outcome_of

#: Keys that a bucket of a merged index is to hold, and buckets that a target begins with.
BUCKET_KEYS, BUCKETS = 100_000, 16
#: Indexes beside each other before they are merged.
MERGE_AFTER = 16
#: Buckets of a batch that are named in its filter; a batch of more reads all.
NAMED_BUCKETS = 10_000

#: The manifest of a batch.
MANIFEST = T.StructType([
    *(T.StructField(c, T.StringType() if c in ("stream", "attempt") else T.LongType()) for c in ("number", "stream", "batch", "attempt", "saved", "skipped", "rebuilt", "failed")),
    T.StructField("indexes", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("buckets", T.IntegerType()), T.StructField("n", T.LongType())]))),
])


def plan_increment(inventory: DataFrame, published: DataFrame, key: str, facts: list[str], valid: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``inventory`` with status (build, skip or rebuild) and reason, and ``carry``, columns of the published row.

    Published with equal facts and valid: skip. Published otherwise: rebuild,
    with what differs. Not published: build. ``valid`` is over the published
    table's columns.
    """
    done = published.select(F.col(key), *(F.col(f).alias(f"__{f}") for f in facts), (F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))).alias("__valid"), *carry)
    rows = inventory.join(done, key, "left")
    differ = [F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f"{f} changed")) for f in facts]
    reason = F.when(F.col("__valid").isNotNull(), F.concat_ws("; ", *differ, F.when(~F.col("__valid"), F.lit("invalid"))))
    status = F.when(F.col("__valid").isNull(), "build").when(reason == "", "skip").otherwise("rebuild")
    return rows.withColumns({"status": status, "reason": F.nullif(reason, F.lit(""))}).select(*inventory.columns, "status", "reason", *carry)


def increment_summary(plan: DataFrame) -> DataFrame:
    """Status and number of rows."""
    return plan.groupBy("status").agg(F.count("*").alias("n"))


def _there(spark: SparkSession, path: str, schema: T.StructType) -> list:
    """The JSON rows at a path, none if there is no such path."""
    try:
        return spark.read.schema(schema).json(path).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def manifests(spark: SparkSession, target: str) -> DataFrame:
    """The manifests of all committed batches."""
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(f"{target}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def run_outcome(spark: SparkSession, target: str, stream: str | None = None) -> Outcome:
    """What became of the rows of all committed batches, or of one stream's; a batch that was replayed counts once."""
    rows = manifests(spark, target)
    rows = rows if stream is None else rows.filter(F.col("stream") == stream)
    return Outcome(*(x or 0 for x in rows.agg(*(F.sum(c) for c in ("saved", "skipped", "rebuilt", "failed"))).first()))


def _staged_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("row", schema), T.StructField("version", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("reasons", T.ArrayType(T.StringType())), T.StructField("outcome", T.StringType())])


def published(spark: SparkSession, target: str, key: str, schema: T.StructType) -> DataFrame:
    """The newest version of every key in ``target``, with its number; no rows if nothing is there yet."""
    attempts = [r["attempt"] for r in manifests(spark, target).select("attempt").collect()]  # a row for each batch
    empty = spark.createDataFrame([], _staged_schema(schema))
    rows = spark.read.schema(empty.schema).option("basePath", f"{target}/staged").parquet(*(f"{target}/staged/attempt={a}" for a in attempts)) if attempts else empty
    newest = rows.filter(F.col("outcome").isin("saved", "rebuilt")).groupBy(F.col("row")[key].alias("__key")).agg(F.max_by(F.struct("row", "version"), "version").alias("newest"))
    return newest.select("newest.row.*", "newest.version")


def rejected(spark: SparkSession, target: str, columns: str) -> DataFrame:
    """The failure log of all committed batches: ``columns`` of the rejected rows, reasons and batch."""
    logs = [f"{target}/failures/attempt={r['attempt']}" for r in manifests(spark, target).filter("failed > 0").select("attempt").collect()]
    kind = T.StructType.fromDDL(f"{columns}, reasons array<string>, batch long")
    return spark.read.schema(kind).json(logs) if logs else spark.createDataFrame([], kind)


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _buckets_of(spark: SparkSession, index: dict, keys: DataFrame, kind: T.StructType) -> DataFrame:
    """The entries of an index in the buckets that ``keys`` are in."""
    rows = spark.read.schema(kind).parquet(index["path"])
    buckets = [r[0] for r in keys.select(_bucket(F.col("key"), index["buckets"])).distinct().limit(NAMED_BUCKETS + 1).collect()]
    return rows if len(buckets) > NAMED_BUCKETS else rows.filter(F.col("bucket").isin(buckets))


def _known(spark: SparkSession, indexes: list, keys: DataFrame, kind: T.StructType) -> DataFrame:
    """key, version and digest of the newest published version of ``keys``, from the buckets that they are in."""
    found = spark.createDataFrame([], kind)
    for index in indexes:
        found = found.unionByName(_buckets_of(spark, index, keys, kind))
    return found.groupBy("key").agg(F.max_by(F.struct("version", "digest"), "version").alias("newest")).select("key", "newest.*")


def _merged(spark: SparkSession, indexes: list, path: str, kind: T.StructType) -> list:
    """Indexes written as one at ``path``.

    The later ones are merged by themselves while they hold less than half of
    the keys of the first; otherwise all become a new first one, with as many
    buckets as its keys need. So a key is written again a logarithmic number
    of times, and a bucket stays of a size.
    """
    first, later = indexes[0], indexes[1:]
    whole = 2 * sum(x["n"] for x in later) >= first["n"]
    taken = indexes if whole else later
    rows = spark.read.schema(kind).parquet(taken[0]["path"])
    for x in taken[1:]:
        rows = rows.unionByName(spark.read.schema(kind).parquet(x["path"]))
    newest = rows.groupBy("key").agg(F.max_by(F.struct("version", "digest"), "version").alias("newest")).select("key", "newest.*")
    buckets = max(BUCKETS, -(-sum(x["n"] for x in taken) // BUCKET_KEYS)) if whole else first["buckets"]
    newest.withColumn("bucket", _bucket(F.col("key"), buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)
    made = {"path": path, "buckets": buckets, "n": spark.read.schema(kind).parquet(path).count()}
    return [made] if whole else [first, made]


def publish_batch(batch: DataFrame, number: int, target: str, key: str, rules: dict[str, Column] | None = None, order: list[str] | None = None, stream: str = "", root: str = "") -> Outcome:
    """One batch as a transaction; returns what became of its rows.

    Of the rows of one key the last by ``order``, then by all columns, counts.
    By J1 a key is saved, rebuilt as a new version, or skipped as it is there
    with equal values; a row without a key or failing a rule is rejected (A7)
    with its reasons and changes nothing of its key. The rows are staged, and
    what was written is judged once more (A8): if a row fails, or a key is
    there twice, it is an error and nothing is published. The manifest is
    written last, by Spark's committer and only if there is none; a batch that
    has one was published before, and adds no file. What an attempt without a
    manifest left behind is never read.
    """
    spark, kind = batch.sparkSession, batch.schema
    where = f"{target}/commits/stream={stream}/batch={number}"
    if done := _there(spark, where, MANIFEST):
        return Outcome(*(done[0][c] for c in ("saved", "skipped", "rebuilt", "failed")))
    before = _there(spark, f"{target}/commits/stream={stream}/batch={number - 1}", MANIFEST) if number else []
    before = before or manifests(spark, target).orderBy(F.desc("number")).limit(1).collect()
    indexes = [x.asDict() for x in before[0]["indexes"]] if before else []
    attempt = f"{stream}-{number}-{uuid.uuid4().hex}"
    at = lambda part: f"{target}/{part}/attempt={attempt}"

    row = F.struct(*(F.col(f"`{c}`").alias(c) for c in batch.columns))
    rows = batch.select(F.col(key).alias("key"), F.struct(*(order or []), row).alias("at"), row.alias("row"))
    named = rows.filter("key is not null").groupBy("key").agg(F.max_by("row", "at").alias("row"))
    named = named.withColumn("digest", digests.json_digest({c: F.col("row")[c] for c in batch.columns}))
    index_kind = T.StructType([T.StructField("key", kind[key].dataType), *T.StructType.fromDDL("version long, digest string, bucket int")])
    known = _known(spark, indexes, named, index_kind)
    plan = plan_increment(named, known, "key", ["digest"], carry=("version",))
    judged = quality.with_reasons(plan.select("row.*", F.struct("row", "digest", "version", "status").alias("__plan")), rules or {})
    outcome = F.when(F.col("__plan.status") == "skip", "skipped").when(F.size("reasons") > 0, "failed").when(F.col("__plan.status") == "build", "saved").otherwise("rebuilt")
    staged = judged.select("__plan.row", (F.coalesce(F.col("__plan.version"), F.lit(0)) + 1).alias("version"), "__plan.digest", "reasons", outcome.alias("outcome"))
    unnamed = rows.filter("key is null").select("row", F.lit(None).cast("long").alias("version"), F.lit(None).cast("string").alias("digest"), F.array(F.lit("no key")).alias("reasons"), F.lit("failed").alias("outcome"))
    staged.unionByName(unnamed).write.partitionBy("outcome").parquet(at("staged"))

    written = spark.read.schema(_staged_schema(kind)).parquet(at("staged"))
    good = written.filter(F.col("outcome").isin("saved", "rebuilt"))
    again = quality.with_reasons(good.select("row.*"), rules or {}).agg(F.count_if(F.size("reasons") > 0), F.count("*"), F.count_distinct(F.col(f"`{key}`"))).first()
    if again[0] or again[1] != again[2]:
        raise ValueError(f"batch {number}: {again[0]} staged rows fail a rule, {again[1]} rows have {again[2]} keys")
    counts = outcome_of(written)
    if counts.failed:
        texts = tuple(f.name for f in kind if isinstance(f.dataType, T.StringType))
        append_failures(written.filter("outcome = 'failed'").select("row.*", "reasons", F.lit(number).cast("long").alias("batch")), at("failures"), root, texts)
    if again[1]:
        buckets = indexes[0]["buckets"] if indexes else max(BUCKETS, -(-again[1] // BUCKET_KEYS))
        entries = good.select(F.col("row")[key].alias("key"), "version", "digest").withColumn("bucket", _bucket(F.col("key"), buckets))
        entries.repartition("bucket").write.partitionBy("bucket").parquet(at("index"))
        indexes = [*indexes, {"path": at("index"), "buckets": buckets, "n": again[1]}]
        if len(indexes) > MERGE_AFTER:
            indexes = _merged(spark, indexes, at("merged"), index_kind)
    manifest = {"number": before[0]["number"] + 1 if before else 0, "stream": stream, "batch": number, "attempt": attempt, "indexes": indexes, **{c: getattr(counts, c) for c in ("saved", "skipped", "rebuilt", "failed")}}
    # A writer that died here left a folder without a file.
    spark.createDataFrame([manifest], MANIFEST).coalesce(1).write.mode("append").json(where)
    return counts


def stream_increment(spark: SparkSession, root: str, schema: str, target: str, checkpoint: str, key: str, rules: dict[str, Column] | None = None, order: list[str] | None = None) -> StreamingQuery:
    """The Parquet files that arrive below ``root``, published to ``target`` batch by batch; runs until all that are there are done.

    A batch is known by the stream's own id, which its checkpoint holds, so a
    new checkpoint never passes for one that was here before. Rejected rows
    don't end the stream; ``run_outcome`` says how the run ends.
    """
    rows = spark.readStream.schema(schema).parquet(root)

    def publish(batch: DataFrame, number: int) -> None:
        stream = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        publish_batch(batch, number, target, key, rules, order, stream, root)

    return rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(publish).start()
