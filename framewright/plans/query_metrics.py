"""Queries of counts, digests, scores and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import arrays
from framewright.operators import metrics
from framewright.plans.registry import DAILY, FRAMES, daily, frames, query, r6, table
from framewright.sources import shared


@query("D2_length_histogram", "SELECT n AS length, count(*) AS n FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id) GROUP BY n")
def d2(spark: SparkSession, d: str) -> DataFrame:
    return metrics.length_histogram(table(spark, d, "conversations").groupBy("conv_id").count(), F.col("count"))


_LINES = "(SELECT DISTINCT doc_id || chr(9) || md5(text) || chr(10) AS line FROM documents)"


@query("D3_set_digest", f"SELECT sha256(string_agg(line, '' ORDER BY line)) AS digest, count(*) AS n, 'exact' AS method FROM {_LINES}")
def d3(spark: SparkSession, d: str) -> DataFrame:
    return metrics.digest_of_set(table(spark, d, "documents"), _line(), "exact")


@query("D3_additive_digest", f"SELECT count(*) || ':' || sum(('0x' || substr(sha256(line), 1, 15))::BIGINT::HUGEINT) AS digest, count(*) AS n, 'additive' AS method FROM {_LINES}")
def d3_additive(spark: SparkSession, d: str) -> DataFrame:
    return metrics.digest_of_set(table(spark, d, "documents"), _line(), "additive")


_TREE = f"""l AS (SELECT sha256(line) AS h FROM {_LINES}), n4 AS (SELECT substr(h, 1, 4) AS p, sha256(string_agg(h, '' ORDER BY h)) AS g, count(*) AS n FROM l GROUP BY 1),
{", ".join(f"n{k} AS (SELECT substr(p, 1, {k}) AS p, sha256(string_agg(substr(p, {k + 1}, 1) || g, '' ORDER BY p)) AS g, sum(n)::BIGINT AS n FROM n{k + 1} GROUP BY 1)" for k in (3, 2, 1, 0))}"""


def _line() -> Column:
    return F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.md5("text"), F.lit("\n"))


@query("D3_tree_digest", f"WITH {_TREE} SELECT g AS digest, n, 'tree' AS method FROM n0")
def d3_tree(spark: SparkSession, d: str) -> DataFrame:
    return metrics.digest_of_set(table(spark, d, "documents"), _line(), "tree")


@query("D3_tree_update", f"WITH {_TREE} SELECT level, count(*) AS n_nodes, sum(n)::BIGINT AS n_lines, md5(string_agg(p || g, '' ORDER BY p)) AS digests FROM ({' UNION ALL '.join(f'SELECT {k} AS level, * FROM n{k}' for k in range(5))}) GROUP BY level")
def d3_tree_update(spark: SparkSession, d: str) -> DataFrame:
    # The tree of half of the documents, brought up to all of them.
    docs = table(spark, d, "documents")
    more = F.xxhash64("doc_id") % 2 == 0
    before = shared.stored(metrics.digest_tree(docs.filter(~more), _line()), "tree")
    tree = metrics.update_tree(before, docs, _line(), docs.filter(more), _line())
    whole = F.md5(F.array_join(F.array_sort(F.collect_list(F.concat("prefix", "digest"))), ""))  # 65,536 nodes at most
    return tree.groupBy("level").agg(F.count("*").alias("n_nodes"), F.sum("n").alias("n_lines"), whole.alias("digests"))


@query("D4_single_valued", "SELECT 'n_regionkey' AS \"column\", count(DISTINCT n_regionkey) AS n_values, count(DISTINCT n_regionkey) = 1 AS ok FROM nation UNION ALL SELECT 'one', 1, true UNION ALL SELECT 'n_name', count(DISTINCT n_name), count(DISTINCT n_name) = 1 FROM nation")
def d4(spark: SparkSession, d: str) -> DataFrame:
    return metrics.single_valued(table(spark, d, "nation").withColumn("one", F.lit("v2")), ["n_regionkey", "one", "n_name"])


@query("D5_duplicate_content", "SELECT md5(text) AS digest, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def d5(spark: SparkSession, d: str) -> DataFrame:
    return metrics.duplicate_content(table(spark, d, "documents"), F.md5("text"), "doc_id")


@query("D6_trajectory_metrics", f"""
WITH {FRAMES}, e AS (SELECT episode_id, t, event_type AS joint, sqrt((x / 1000) ** 2 + (y / 1000) ** 2 + 0.01) AS err, ((x / 1000) ** 2 + (y / 1000) ** 2 + 0.01) / 3 AS mse FROM f)
SELECT episode_id, round(avg(err), 6) AS ade, round(arg_max(err, t), 6) AS fde, round(avg((err < 0.15)::INTEGER), 6) AS hit_rate, round(avg(mse), 6) AS mse FROM e GROUP BY episode_id""")
def d6(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    pred = f.select("episode_id", "t", F.col("event_type").alias("joint"), F.array(F.col("x") / 1000, F.col("y") / 1000, F.lit(0.1)).alias("xyz"))
    truth = pred.withColumn("xyz", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    out = metrics.trajectory_metrics(pred, truth, threshold=0.15)
    return out.select("episode_id", *(r6(c).alias(c) for c in ("ade", "fde", "hit_rate", "mse")))


_VECTORS = """p AS (SELECT list_transform(a.embedding, lambda v: v::DOUBLE) AS p, list_transform(b.embedding, lambda v: v::DOUBLE) AS q FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
u AS (SELECT row_number() OVER () AS r, p, q FROM p), x AS (SELECT r, unnest(p) AS a, unnest(q) AS b FROM u),
v AS (SELECT r, avg((a - b) ** 2) AS mse, sqrt(sum((a - b) ** 2)) AS l2, avg(CASE WHEN abs(a - b) < 1 THEN 0.5 * (a - b) ** 2 ELSE abs(a - b) - 0.5 END) AS sl1, sum(a * b) / (greatest(sqrt(sum(a * a)), 1e-8) * greatest(sqrt(sum(b * b)), 1e-8)) AS c FROM x GROUP BY r)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("pred")).join(e.select("vec_id", F.col("embedding").alias("truth")), "vec_id")


@query("D7_latent_metrics", f"WITH {_VECTORS} SELECT round(avg(mse), 6) AS mse, round(avg(l2), 6) AS l2, round(avg(sl1), 6) AS smooth_l1, round(1 - avg(c), 6) AS cosine_distance FROM v")
def d7(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latent_metrics(_pairs(spark, d)).select(*(r6(c).alias(c) for c in ("mse", "l2", "smooth_l1", "cosine_distance")))


@query("D8_global_mean", "SELECT l_returnflag, round(CASE WHEN sum(w) > 0 THEN sum(l_discount * w) / sum(w) END, 6) AS mean FROM (SELECT l_returnflag, l_discount::DOUBLE AS l_discount, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity::DOUBLE END AS w FROM lineitem) GROUP BY 1")
def d8(spark: SparkSession, d: str) -> DataFrame:
    weight = F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity").cast("double"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(r6(metrics.global_mean(F.col("l_discount").cast("double"), weight)).alias("mean"))


@query("D9_run_performance", "SELECT user_id % 20 AS epoch, sum(event_id % 9)::BIGINT AS samples, round(max(value), 6) AS seconds, max(event_id) AS peak_memory, round(sum(event_id % 9) / max(value), 6) AS rate, sum(event_id % 9) > 0 AS ok FROM events GROUP BY 1")
def d9(spark: SparkSession, d: str) -> DataFrame:
    logs = table(spark, d, "events").withColumn("epoch", F.col("user_id") % 20)
    out = metrics.run_performance(logs, "epoch", F.col("event_id") % 9, F.col("value"), F.col("event_id"))
    return out.select("epoch", "samples", r6("seconds").alias("seconds"), "peak_memory", r6("rate").alias("rate"), "ok")


@query("D10_masked_mean", "SELECT label, round(avg(x), 6) AS plain, round(sum(CASE WHEN vec_id % 3 = 0 THEN x ELSE 0 END) / greatest(count(*) FILTER (vec_id % 3 = 0), 1e-6), 6) AS masked, 0.0::DOUBLE AS none FROM (SELECT label, vec_id, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY label")
def d10(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("embedding")[0].cast("double")
    return table(spark, d, "embeddings").groupBy("label").agg(r6(metrics.masked_mean(x)).alias("plain"), r6(metrics.masked_mean(x, F.col("vec_id") % 3 == 0)).alias("masked"), metrics.masked_mean(x, F.lit(False)).alias("none"))


@query("D11_pair_features", "SELECT b.vec_id, 256 AS width, round(abs(a.embedding[1]::DOUBLE - b.embedding[1]::DOUBLE), 5) AS difference, round(a.embedding[1]::DOUBLE * b.embedding[1]::DOUBLE, 5) + 0.0::DOUBLE AS product FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def d11(spark: SparkSession, d: str) -> DataFrame:
    f = arrays.pair_features(arrays._double(F.col("pred")), arrays._double(F.col("truth")))
    return _pairs(spark, d).select("vec_id", F.size(f).alias("width"), F.round(f[128], 5).alias("difference"), (F.round(f[192], 5) + 0.0).alias("product"))


@query("D12_infer_width", "SELECT (20 + arg_min(vec_id, vec_id) % 40)::INTEGER AS width FROM embeddings WHERE vec_id % 10 > 2")
def d12(spark: SparkSession, d: str) -> DataFrame:
    # Vectors of many widths; the first three of ten aren't there.
    cut = F.slice("embedding", F.lit(1), (20 + F.col("vec_id") % 40).cast("int"))
    return metrics.infer_width(table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 10 > 2, cut)), "embedding", "vec_id")


@query("D13_split_summary", """
WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 6 = 0 AND source < 'src15' THEN 'test' ELSE 'train' END AS split FROM documents),
g AS (SELECT split, source, count(*) AS n, sum(('0x' || substr(sha256(doc_id::VARCHAR), 1, 15))::BIGINT::HUGEINT) AS s, count(*) OVER (PARTITION BY source) AS k FROM d GROUP BY split, source)
SELECT split, sum(n)::BIGINT AS n_rows, count(*) AS n_groups, count(*) FILTER (k > 1) AS n_shared_groups, count(*) || ':' || sum(('0x' || substr(sha256(source), 1, 15))::BIGINT::HUGEINT) AS groups_digest, sum(n) || ':' || sum(s) AS keys_digest FROM g GROUP BY split""")
def d13(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.when((F.col("doc_id") % 6 == 0) & (F.col("source") < "src15"), "test").otherwise("train").alias("split"))
    return metrics.split_summary(docs, "source", "doc_id")


@query("D14_experiment_summary", f"WITH {DAILY} SELECT count(*) AS n_epochs, max(epoch) AS last_epoch, (SELECT epoch FROM e WHERE NOT isnan(val) ORDER BY val, epoch LIMIT 1) AS selected_epoch, (SELECT train FROM e WHERE NOT isnan(val) ORDER BY val, epoch LIMIT 1) AS selected_train, arg_max(train, epoch) AS last_train FROM e")
def d14(spark: SparkSession, d: str) -> DataFrame:
    return metrics.experiment_summary(daily(spark, d), "epoch", ["train"], "val")


@query("D14_last_epoch", f"WITH {DAILY} SELECT count(*) AS n_epochs, max(epoch) AS last_epoch, max(epoch) AS selected_epoch, arg_max(train, epoch) AS selected_train, arg_max(train, epoch) AS last_train FROM e")
def d14_last(spark: SparkSession, d: str) -> DataFrame:
    return metrics.experiment_summary(daily(spark, d), "epoch", ["train"], "val", "last")


@query("D15_curve_points", f"WITH {DAILY} SELECT epoch, 'train' AS series, train AS value FROM e UNION ALL SELECT epoch, 'val', CASE WHEN isnan(val) THEN NULL ELSE val END FROM e")
def d15(spark: SparkSession, d: str) -> DataFrame:
    return metrics.curve_points(daily(spark, d), "epoch", ["train", "val"])


@query("D16_bundle_totals", "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS bytes, count(*) FILTER (o_orderstatus = 'F') AS complete, count(*) FILTER (o_orderstatus <> 'F') AS missing FROM orders")
def d16(spark: SparkSession, d: str) -> DataFrame:
    return metrics.bundle_totals(table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_orderstatus") == "F")


@query("D6_overall", f"""
WITH {FRAMES}, e AS (SELECT episode_id, t, sqrt((x / 1000 - y / 2000) ** 2 + (y / 1000) ** 2) AS err FROM f), s AS (SELECT episode_id, avg(err) AS ade, arg_max(err, t) AS fde, avg((err < 0.15)::INTEGER) AS hit_rate FROM e GROUP BY episode_id)
SELECT round(avg(ade), 6) AS ade, round(avg(fde), 6) AS fde, round(avg(hit_rate), 6) AS hit_rate, count(*) AS n FROM s""")
def d6_overall(spark: SparkSession, d: str) -> DataFrame:
    points = lambda x, y: frames(spark, d).select("episode_id", "t", F.col("event_type").alias("joint"), F.array(x, y, F.lit(0.5)).alias("xyz"))
    scores = metrics.trajectory_metrics(points(F.col("x") / 1000, F.col("y") / 1000), points(F.col("y") / 2000, F.lit(0.0)), threshold=0.15)
    return metrics.overall(scores, ["ade", "fde", "hit_rate"]).select(r6("ade").alias("ade"), r6("fde").alias("fde"), r6("hit_rate").alias("hit_rate"), "n")
