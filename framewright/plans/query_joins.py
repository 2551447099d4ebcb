"""Queries of pairing, repair, reconciliation, audits and increments (C, G, I, J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import geometry, paths
from framewright.operators import joins, quality, ranking
from framewright.plans.query_paths import scratch
from framewright.plans.query_sequences import _SPLIT
from framewright.plans.registry import page_paths, query, r6, table
from framewright.streaming import increment, outcomes


@query("C1_pair_episodes", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def c1(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return joins.pair_episodes(table(spark, d, "orders").select("o_orderkey"), lines, ["o_orderkey"], orders)


@query("C1_unmatched", "SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey + 40 FROM orders)) AS left_only, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey + 40 NOT IN (SELECT c_custkey FROM customer)) AS right_only")
def c1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    # Keys of one side are shifted, so that each side has some of its own.
    return joins.unmatched(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select((F.col("o_custkey") + 40).alias("k")), ["k"])


@query("C2_guard_unique_key", "SELECT source, lang, count(DISTINCT md5(text)) AS n_values FROM documents GROUP BY source, lang HAVING count(DISTINCT md5(text)) > 1")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return joins.guard_unique_key(table(spark, d, "documents").select("source", "lang", F.md5("text").alias("digest")), ["source", "lang"], "digest")


@query("C3_priority_lookup", """
WITH i AS (SELECT DISTINCT 'd' || p_size AS rel_dir, 's' || p_partkey % 200 AS stem, 'b' || p_partkey % 25 AS parent, 'p' || p_partkey AS path FROM part),
q AS (SELECT c_custkey AS id, 's' || c_custkey % 230 AS stem, 'b' || c_nationkey AS parent, ['d' || c_nationkey, 'd' || (c_nationkey + 25)] AS dirs FROM customer),
m AS (SELECT id, r AS rank, 0 AS other, i.path FROM (SELECT id, stem, unnest([0, 1]) AS r, unnest(dirs) AS rel_dir FROM q) JOIN i USING (rel_dir, stem)
      UNION ALL SELECT id, 1000000, (i.parent <> q.parent)::INTEGER, i.path FROM q JOIN i USING (stem)),
b AS (SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY rank, other, path) AS k FROM m)
SELECT q.id, b.path FROM q LEFT JOIN b ON q.id = b.id AND k = 1""")
def c3(spark: SparkSession, d: str) -> DataFrame:
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    index = table(spark, d, "part").select(s("d", F.col("p_size")).alias("rel_dir"), s("s", F.col("p_partkey") % 200).alias("stem"), s("b", F.col("p_partkey") % 25).alias("parent"), s("p", F.col("p_partkey")).alias("path")).distinct()
    n = F.col("c_nationkey")
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), s("s", F.col("c_custkey") % 230).alias("name"), s("b", n).alias("folder"), F.array(s("d", n), s("d", n + 25)).alias("dirs"))
    return joins.priority_lookup(wanted, index, "dirs", "name", "folder").select("id", "path")


@query("C4_reconcile", """
WITH o AS (SELECT DISTINCT o_custkey + 40 AS k FROM orders), l AS (SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT k FROM o)), r AS (SELECT k FROM o WHERE k NOT IN (SELECT c_custkey FROM customer))
SELECT 'left' AS side, k, (SELECT count(*) FROM l) AS n FROM (SELECT k FROM l ORDER BY k LIMIT 20) UNION ALL SELECT 'right', k, (SELECT count(*) FROM r) FROM (SELECT k FROM r ORDER BY k LIMIT 20)""")
def c4(spark: SparkSession, d: str) -> DataFrame:
    return joins.reconcile(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select((F.col("o_custkey") + 40).alias("k")), "k")


@query("C8_merge_pose_sources", """
WITH m(joint, source_joint, rank) AS (VALUES ('wrist', 'click', 0), ('wrist', 'view', 1), ('elbow', 'view', 0), ('tip', 'purchase', 0)),
s AS (SELECT user_id, event_type AS source_joint, event_id % 2 = 0 AS hand, event_id, value FROM events),
c AS (SELECT user_id, joint, value, row_number() OVER (PARTITION BY user_id, joint ORDER BY rank, (NOT hand)::INTEGER, CASE WHEN hand THEN -event_id ELSE event_id END) AS k FROM s JOIN m USING (source_joint)),
w AS (SELECT user_id, joint FROM (SELECT DISTINCT user_id FROM c), (VALUES ('wrist'), ('elbow'), ('tip')) AS j(joint))
SELECT w.user_id, w.joint, round(coalesce(c.value, e.value, 0), 6) AS x FROM w LEFT JOIN c ON w.user_id = c.user_id AND w.joint = c.joint AND c.k = 1
LEFT JOIN c e ON w.joint = 'tip' AND e.user_id = w.user_id AND e.joint = 'wrist' AND e.k = 1""")
def c8(spark: SparkSession, d: str) -> DataFrame:
    mapping = spark.createDataFrame([("wrist", "click", 0), ("wrist", "view", 1), ("elbow", "view", 0), ("tip", "purchase", 0)], "joint string, source_joint string, rank int")
    kind = F.when(F.col("event_id") % 2 == 0, "hand").otherwise("body")
    sources = table(spark, d, "events").select("user_id", F.col("event_type").alias("source_joint"), kind.alias("kind"), F.col("event_id").alias("nth"), F.array("value", F.lit(0.0), F.lit(0.0)).alias("xyz"))
    found = joins.merge_pose_sources(sources, mapping, ["user_id"])
    fallbacks = spark.createDataFrame([("tip", "wrist", 0)], "joint string, other string, rank int")
    full = joins.fill_forearms(found, mapping.select("joint").distinct(), ["user_id"], fallbacks)
    return full.select("user_id", "joint", r6(F.col("xyz")[0]).alias("x"))


@query("C9_bind_supervision", """
WITH l AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS first FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'no supervision' ELSE concat_ws('|', CASE WHEN n <> o_orderkey % 5 THEN 'n differs' END, CASE WHEN first <> 1 THEN 'first differs' END) END AS reasons FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""")
def c9(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.min("l_linenumber").cast("long").alias("first"))
    orders = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).cast("long").alias("n"), F.lit(1).cast("long").alias("first"))
    return joins.bind_supervision(orders, lines, "o_orderkey", ["n", "first"]).select("o_orderkey", F.array_join("reasons", "|").alias("reasons"))


@query("C10_repair", "SELECT doc_id, coalesce(CASE WHEN d.lang <> 'en' THEN d.lang END, CASE WHEN l.quality = 1 THEN 'good' END, 'zero') AS lang, coalesce(CASE WHEN n_chars > 500 THEN n_chars END, 0) AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def c10(spark: SparkSession, d: str) -> DataFrame:
    other = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("lang"), F.lit(None).cast("long").alias("n_chars"))
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return joins.repair(docs, other, "doc_id", {"lang": F.col("lang") != "en", "n_chars": F.col("n_chars") > 500}, {"lang": F.lit("zero"), "n_chars": F.lit(0).cast("long")})


@query("C12_attach_split", "SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM documents")
def c12(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    manifest = docs.filter("doc_id % 10 <> 3").withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("train"))
    return joins.attach_split(docs, manifest, "doc_id")


@query("C13_stack_with_fill", "SELECT doc_id, quality IS NOT NULL AS mask, CASE WHEN quality IS NULL THEN 0 ELSE 2 END AS length, coalesce(quality, 0)::DOUBLE AS first FROM documents LEFT JOIN labels USING (doc_id)")
def c13(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.array(F.col("quality").cast("float"), F.col("toxic").cast("float")).alias("vec"))
    return joins.stack_with_fill(table(spark, d, "documents").select("doc_id"), labels, "doc_id", "vec", 2).select("doc_id", "mask", "length", F.col("vec")[0].cast("double").alias("first"))


@query("G1_overlap", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return joins.overlap(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("G2_group_overlap", 'SELECT source AS "group", count(DISTINCT doc_id % 3 = 0) AS n_splits, count(*) AS n FROM documents GROUP BY source HAVING count(DISTINCT doc_id % 3 = 0) > 1')
def g2(spark: SparkSession, d: str) -> DataFrame:
    return joins.group_overlap(table(spark, d, "documents").withColumn("split", (F.col("doc_id") % 3 == 0).cast("string")), F.col("source"))


@query("G3_union_splits", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents")
def g3(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    part = lambda c, name: docs.filter(c).withColumn("split", F.lit(name))
    return joins.union_splits(part("doc_id % 5 = 0", "test"), part("doc_id % 5 <> 0", "train"), docs.count())


@query("I1_audit_features", """
WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, concat_ws('|', CASE WHEN user_id % 5 = 1 THEN 'schema_version differs' END, CASE WHEN user_id % 5 = 4 THEN 'forbidden key' END,
       CASE WHEN user_id % 5 = 2 THEN 'ids are not the midpoint samples|halves overlap' END, CASE WHEN user_id % 5 = 2 THEN 'branches disagree' END,
       CASE WHEN user_id % 5 = 3 THEN 'not finite' END, CASE WHEN user_id % 7 = 0 THEN 'tokens are not states + 1' END, CASE WHEN user_id % 11 = 0 THEN 'source changed' END) AS reasons FROM u""")
def i1(spark: SparkSession, d: str) -> DataFrame:
    from framewright.functions.arrays import midpoint_samples

    c = F.col("user_id") % 5
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total_frames")).withColumn("s", midpoint_samples(F.col("total_frames")))
    rows = rows.select(
        "user_id", "total_frames", F.when(c == 1, 1).otherwise(2).alias("schema_version"), F.lit(quality.CONTRACT["policy"]).alias("policy"), F.lit(quality.CONTRACT["sampling"]).alias("sampling"),
        F.when(c == 4, F.array(F.lit("imgs"), F.lit("gt_points"))).otherwise(F.array(F.lit("imgs"))).alias("tensor_names"), F.when(c == 2, F.col("s.target")).otherwise(F.col("s.past")).alias("past_ids"), F.col("s.target").alias("target_ids"),
        F.array("s.past").alias("branch_ids"), F.array(F.lit(0)).alias("layers"), F.create_map(F.lit("vision"), c != 3).alias("finite"), F.lit(9).alias("n_tokens"), F.when(F.col("user_id") % 7 == 0, 9).otherwise(8).alias("n_states"),
        F.col("total_frames").alias("source_size"), F.when(F.col("user_id") % 11 == 0, 0).otherwise(F.col("total_frames")).alias("now_size"), F.lit(1).alias("source_mtime"), F.lit(1).alias("now_mtime"),
    )
    return quality.audit_features(rows, forbidden=("gt_points",)).select("user_id", F.array_join("reasons", "|").alias("reasons"))


@query("I2_audit_pairs", """
WITH o AS (SELECT o_orderkey AS k, count(*) OVER (PARTITION BY CASE WHEN o_orderkey % 50 = 7 THEN 'x' ELSE o_orderkey::VARCHAR END) > 1 AS twice FROM orders)
SELECT 's/' || k AS sample_id, concat_ws('|', CASE WHEN k % 50 = 1 THEN 'unsafe path|paths name different samples' END, CASE WHEN k % 50 = 2 THEN 'unknown split' END, CASE WHEN twice THEN 'content is there twice' END,
       CASE WHEN k % 50 = 3 THEN 'file is missing' END, CASE WHEN k % 50 = 4 THEN 'size differs' END) AS reasons FROM o
UNION ALL SELECT NULL, 'file without a pair: stray/' || k FROM o WHERE k % 50 = 3
UNION ALL SELECT NULL, 'count differs'""")
def i2(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    c, s = k % 50, k.cast("string")
    sup = F.concat(F.lit("sup/s/"), s, F.lit(".h5"))
    pairs = table(spark, d, "orders").select(
        F.concat(F.lit("s/"), s).alias("sample_id"), F.when(c == 2, "dev").otherwise("train").alias("split"), F.when(c == 1, F.concat(F.lit("/feat/s/"), s, F.lit(".npz"))).otherwise(F.concat(F.lit("feat/s/"), s, F.lit(".npz"))).alias("feature_relpath"),
        sup.alias("supervision_relpath"), F.sha2(F.when(c == 7, "x").otherwise(s), 256).alias("digest"), k.cast("long").alias("size"),
    )
    inventory = table(spark, d, "orders").select(F.when(c == 3, F.concat(F.lit("stray/"), s)).otherwise(sup).alias("relpath"), F.when(c == 4, -1).otherwise(k).cast("long").alias("size"))
    n_train = pairs.filter("split = 'train'").count()
    return quality.audit_pairs(pairs, inventory, {"train": n_train, "test": 1}).select("sample_id", F.array_join("reasons", "|").alias("reasons"))


@query("I1_audit_archives", """
WITH u AS (SELECT user_id AS u, count(*) AS n FROM events GROUP BY user_id)
SELECT u AS user_id, concat_ws('|', CASE WHEN u % 11 = 1 THEN 'required key is missing' END, CASE WHEN u % 11 = 2 THEN 'forbidden prefix' END, CASE WHEN u % 11 IN (3, 4) THEN 'fingerprint differs' END, CASE WHEN u % 11 = 5 THEN 'split is not the midpoint' END,
       CASE WHEN u % 11 = 6 THEN 'unsafe source path' END, CASE WHEN u % 11 IN (6, 7) THEN 'archive is not of its source' END, CASE WHEN u % 11 = 8 THEN 'layers differ' END, CASE WHEN u % 11 = 9 THEN 'configuration $.mode differs' END, CASE WHEN u % 11 = 10 THEN 'imgs has another shape' END) AS reasons FROM u""")
def i1_archives(spark: SparkSession, d: str) -> DataFrame:
    c, s = F.col("user_id") % 11, F.col("user_id").cast("string")
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("total_frames"))
    stated = F.concat(F.lit('{"layers":[2,5],"mode":"'), F.when(c == 9, "all").otherwise("past"), F.lit('"}'))
    print_ = F.sha2("configuration_json", 256)
    rows = rows.withColumn("configuration_json", stated).select(
        "user_id", "total_frames", "configuration_json", F.when(c == 3, "0" * 64).otherwise(print_).alias("configuration_fingerprint"), F.when(c == 4, "0" * 64).otherwise(print_).alias("cache_config_fingerprint"),
        F.when(c == 1, F.array(F.lit("imgs"))).when(c == 2, F.array(F.lit("imgs"), F.lit("times"), F.lit("other_points"))).otherwise(F.array(F.lit("imgs"), F.lit("times"))).alias("tensor_names"),
        (F.floor(F.col("total_frames") / 2) + F.when(c == 5, 1).otherwise(0)).alias("split_raw_index"), F.when(c == 6, F.concat(F.lit("../v"), s, F.lit(".mp4"))).otherwise(F.concat(F.lit("t/v"), s, F.lit(".mp4"))).alias("source_video_relpath"),
        F.concat(F.lit("/cache/t/v"), s, F.when(c == 7, "x.npz").otherwise(".npz")).alias("archive_path"), F.when(c == 8, F.array(F.lit(5))).otherwise(F.array(F.lit(2), F.lit(5))).alias("layers"),
        F.create_map(F.lit("imgs"), F.array(F.lit(4), F.when(c == 10, 2).otherwise(3))).alias("shapes"), F.create_map(F.lit("imgs"), F.lit("uint8")).alias("dtypes"),
    )
    return quality.audit_archives(rows, ("imgs", "times"), ("other_",), {"$.mode": "past"}, {"imgs": ([4, 3], "uint8")}).select("user_id", F.array_join("reasons", "|").alias("reasons"))


_RECORDS = """u AS (SELECT user_id AS u, count(*) AS n FROM events GROUP BY user_id), k AS (SELECT unnest(range(0, 32)) AS pos),
i AS (SELECT u, n, list((pos * (n // 2 - 1)) // 31 ORDER BY pos) AS past, list(n // 2 + (pos * (n - 1 - n // 2)) // 31 ORDER BY pos) AS target FROM u, k GROUP BY u, n)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    from framewright.functions.arrays import midpoint_samples

    c, s = F.col("user_id") % 9, F.col("user_id").cast("string")
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("source_total_frames")).withColumn("s", midpoint_samples(F.col("source_total_frames")))
    frame_ids = F.sha2(F.regexp_replace(F.concat(F.col("s.past").cast("string"), F.col("s.target").cast("string")), r"[\[\] ]+", ","), 256)
    return rows.select(
        "user_id", F.concat(F.lit("t/v"), s).alias("sample_id"), F.when(F.col("user_id") % 10 == 0, "test").otherwise("train").alias("split"), F.concat(F.lit("feat/t/v"), s, F.lit(".npz")).alias("feature_relpath"),
        F.concat(F.when(c == 1, "t/w").otherwise("t/v"), s, F.lit(".mp4")).alias("source_video_relpath"), "source_total_frames", F.when(c == 2, F.col("s.target")).otherwise(F.col("s.past")).alias("past_frame_indices"), F.col("s.target").alias("target_frame_indices"),
        F.when(c == 3, frame_ids).otherwise(F.sha2(quality.json_list(F.concat("s.past", "s.target")), 256)).alias("frame_indices_sha256"), F.when(c == 4, "f2").otherwise("f1").alias("feature_config_fingerprint"), F.when(c == 5, "q2").otherwise("q1").alias("query_tf_names_sha256"),
        F.when(c == 6, 0).otherwise(F.col("user_id") + 1).cast("long").alias("feature_size_bytes"), F.lit(1).cast("long").alias("hdf5_size_bytes"), F.sha2(s, 256).alias("hdf5_sha256"),
    )


@query("I2_audit_records", """
WITH u AS (SELECT DISTINCT user_id AS u FROM events)
SELECT u AS user_id, concat_ws('|', CASE WHEN u % 9 = 1 THEN 'source is another sample' END, CASE WHEN u % 9 = 2 THEN 'frames are not the midpoint samples' END, CASE WHEN u % 9 IN (2, 3) THEN 'frame identity differs' END, CASE WHEN u % 9 = 4 THEN 'feature_config_fingerprint differs' END,
       CASE WHEN u % 9 = 5 THEN 'query_tf_names_sha256 differs' END, CASE WHEN u % 9 = 6 THEN 'size is not positive' END, CASE WHEN u % 9 IN (7, 8) THEN 'feature is missing or its size differs' END) AS reasons FROM u""")
def i2_records(spark: SparkSession, d: str) -> DataFrame:
    pairs = _records(spark, d)
    c = F.col("user_id") % 9
    features = pairs.select(F.when(c == 7, "gone").otherwise(F.col("feature_relpath")).alias("relpath"), F.when(c == 8, -1).otherwise(F.col("feature_size_bytes")).alias("size"))
    return quality.audit_records(pairs, features, {"feature_config_fingerprint": "f1", "query_tf_names_sha256": "q1"}).select("user_id", F.array_join("reasons", "|").alias("reasons"))


@query("I2_audit_identities", """
WITH u AS (SELECT DISTINCT user_id AS u FROM events), h AS (SELECT sha256('["' || string_agg(sha256(u::VARCHAR), '","' ORDER BY sha256(u::VARCHAR)) || '"]') AS x FROM u),
m AS (SELECT u % 10 = 0 AS test, sha256(string_agg('feat/t/v' || u || '.npz' || chr(10), '' ORDER BY 'feat/t/v' || u || '.npz')) AS x FROM u GROUP BY 1)
SELECT 'content' AS name, 'c' AS stated, x AS found, false AS ok FROM h UNION ALL SELECT CASE WHEN test THEN 'test' ELSE 'train' END, CASE WHEN test THEN x ELSE 't' END, x, test FROM m""")
def i2_identities(spark: SparkSession, d: str) -> DataFrame:
    pairs = _records(spark, d)
    right = quality.audit_identities(pairs, {"test": ""}).filter("name = 'test'").first()["found"]
    return quality.audit_identities(pairs, {"content": "c", "train": "t", "test": right})


@query("I3_audit_geometry", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws('|', CASE WHEN l_linenumber IN (2, 6) THEN 'not finite' END, CASE WHEN l_linenumber = 3 THEN 'last row' END, CASE WHEN l_linenumber = 4 THEN 'singular' END, CASE WHEN l_linenumber = 5 THEN 'camera corner' END) AS reasons FROM lineitem")
def i3(spark: SparkSession, d: str) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("double")
    m = geometry.pose_from_point(F.array(q, q, q))
    m = F.transform(m, lambda x, i: F.when((n == 3) & (i == 15), x + 0.5).when((n == 4) & (i == 0), 0.0).when((n == 2) & (i == 3), float("nan")).when((n == 6) & (i == 7), float("inf")).otherwise(x))
    k = F.transform(F.array(*(F.lit(float(v)) for v in (700, 0, 960, 0, 700, 540, 0, 0, 1))), lambda x, i: F.when((n == 5) & (i == 8), 2.0).otherwise(x))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", m.alias("m"), k.alias("k"))
    return quality.audit_camera(rows, "m", "k").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("reasons", "|").alias("reasons"))


@query("I3_audit_episodes", """
WITH p AS (SELECT user_id, count(DISTINCT event_type) FILTER (event_type IN ('click', 'view')) AS j, count(value) FILTER (event_type IN ('click', 'view') AND value > 10) AS c, count(*) FILTER (event_type IN ('click', 'view')) AS n, count(*) AS t FROM events GROUP BY user_id)
SELECT user_id AS episode_id, concat_ws('|', CASE WHEN user_id % 3 = 0 AND t - 1 <> t AND t - 1 <> 1 THEN 'number of cameras' END, CASE WHEN j <> 2 THEN 'joint is missing' END, CASE WHEN c <> 0 AND c <> n THEN 'confidences are partial' END) AS reasons FROM p""")
def i3_episodes(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    poses = events.select(F.col("user_id").alias("episode_id"), F.col("event_type").alias("joint"), F.when(F.col("value") > 10, F.col("value")).alias("conf"))
    lengths = events.groupBy(F.col("user_id").alias("episode_id")).agg(F.count("*").alias("n_frames"))
    cameras = lengths.select("episode_id", F.explode(F.sequence(F.lit(1), F.when(F.col("episode_id") % 3 == 0, F.col("n_frames") - 1).otherwise(1).cast("int"))).alias("i"))
    return quality.audit_geometry(cameras, poses, lengths, ["click", "view"]).select("episode_id", F.array_join("reasons", "|").alias("reasons"))


@query("I4_compare_contract", """
SELECT n_nationkey, 'n_name' AS field, n_name AS reported, CASE WHEN n_nationkey % 4 = 1 AND n_nationkey % 5 <> 0 THEN lower(n_name) END AS found FROM nation WHERE n_nationkey % 4 = 1 OR n_nationkey % 5 = 0
UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::VARCHAR, NULL FROM nation WHERE n_nationkey % 5 = 0""")
def i4(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    current = nation.filter("n_nationkey % 5 <> 0").withColumn("n_name", F.when(F.col("n_nationkey") % 4 == 1, F.lower("n_name")).otherwise(F.col("n_name")))
    found = quality.compare_contract(nation, current, "n_nationkey", ["n_name", "n_regionkey"])
    return found


@query("I4_compare_records", """
WITH k AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders)
SELECT k, '$.id' AS path, 'kind' AS difference, 'number' AS reported_kind, k::VARCHAR AS reported, 'string' AS found_kind, k::VARCHAR AS found FROM k WHERE k % 7 = 1
UNION ALL SELECT k, '$.meta.files', 'missing', 'array', NULL, NULL, NULL FROM k WHERE k % 7 = 2
UNION ALL SELECT k, '$.meta.files[2]', 'extra', NULL, NULL, 'object', NULL FROM k WHERE k % 7 = 3
UNION ALL SELECT k, '$.meta.customer', 'value', 'number', c::VARCHAR, 'number', (c + 1)::VARCHAR FROM k WHERE k % 7 IN (3, 4)
UNION ALL SELECT k, '$', 'missing', 'object', NULL, NULL, NULL FROM k WHERE k % 7 = 5
UNION ALL SELECT k, '$.meta', 'kind', 'object', NULL, 'array', NULL FROM k WHERE k % 7 = 6""")
def i4_records(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    case = k % 7
    json = lambda i, size, files, end="}": F.concat(F.lit('{"id":'), i, F.lit(',"meta":{"customer":'), size.cast("string"), files, F.lit("}" + end))
    plain, two = k.cast("string"), F.lit(',"files":["a.npz",{"n":"b.npz"}]')
    rows = table(spark, d, "orders").select(k.cast("long").alias("k"), json(plain, c, two).alias("record"), json(F.when(case == 1, F.concat(F.lit('"'), plain, F.lit('"'))).when(case == 0, F.concat(plain, F.lit(".0"))).otherwise(plain), F.when(case.isin(3, 4), c + 1).otherwise(c), F.when(case == 2, F.lit("")).when(case == 3, F.lit(',"files":["a.npz",{"n":"b.npz"},{"n":"c.npz"}]')).otherwise(two)).alias("now"), case.alias("case"))
    now = rows.filter("case <> 5").select("k", F.when(F.col("case") == 6, F.concat(F.lit('{"id":'), F.col("k").cast("string"), F.lit(',"meta":[1,2]}'))).otherwise(F.col("now")).alias("record"))
    return quality.compare_records(rows.select("k", "record"), now, "k")


@query("I5_run_identity", """
SELECT c_custkey, 'c_nationkey' AS field FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT c_custkey, 'c_mktsegment' FROM customer WHERE c_custkey % 10 = 0""")
def i5(spark: SparkSession, d: str) -> DataFrame:
    settings = ["c_nationkey", "c_mktsegment"]
    stored = quality.run_identity(table(spark, d, "customer"), settings)
    current = quality.run_identity(table(spark, d, "customer").withColumns({"c_nationkey": F.when(F.col("c_custkey") % 9 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")), "c_mktsegment": F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.col("c_mktsegment"))}), settings)
    changed = stored.select("c_custkey", "identity").join(current.select("c_custkey", F.col("identity").alias("now")), "c_custkey").filter("identity <> now").select("c_custkey")
    return quality.resume_mismatches(stored.join(changed, "c_custkey", "left_semi"), current.join(changed, "c_custkey", "left_semi"), "c_custkey", settings).select("c_custkey", "field")


@query("I6_finite_only", "SELECT vec_id, 'embedding' AS bad FROM embeddings WHERE vec_id % 6 = 0")
def i6(spark: SparkSession, d: str) -> DataFrame:
    broken = F.when(F.col("vec_id") % 6 == 0, F.concat("embedding", F.array(F.lit(float("nan")).cast("float")))).otherwise(F.col("embedding"))
    return quality.finite_only(table(spark, d, "embeddings").withColumn("embedding", broken), ["embedding"]).select("vec_id", F.array_join("not_finite", ",").alias("bad"))


@query("J1_plan_increment", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'build' WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'rebuild' ELSE 'skip' END AS status,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE nullif(concat_ws('; ', CASE WHEN o_orderkey % 5 = 0 THEN 'size changed' END, CASE WHEN o_orderkey % 7 = 0 THEN 'invalid' END), '') END AS reason FROM orders""")
def j1(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("size"))
    published = orders.filter("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit(-1)).otherwise(F.col("size")).alias("size"), (F.col("o_orderkey") % 7 != 0).alias("good"))
    return increment.plan_increment(orders, published, "o_orderkey", ["size"], F.col("good")).select("o_orderkey", "status", "reason")


@query("J1_increment_summary", "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'build' ELSE 'skip' END AS status, count(*) AS n FROM orders GROUP BY 1")
def j1_summary(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("size"))
    return increment.increment_summary(increment.plan_increment(orders, orders.filter("o_orderkey % 3 <> 0"), "o_orderkey", ["size"]))


_OUTCOME = """p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'build' WHEN o_orderkey % 5 = 0 THEN 'rebuild' ELSE 'skip' END AS s FROM orders),
o AS (SELECT k, CASE WHEN s = 'skip' THEN 'skipped' WHEN k % 11 = 0 THEN 'failed' WHEN s = 'build' THEN 'saved' ELSE 'rebuilt' END AS outcome,
      CASE WHEN s = 'skip' THEN 0 WHEN k % 11 = 0 THEN 3 WHEN k % 7 = 0 THEN 2 ELSE 1 END AS tries FROM p)"""


def _run(spark: SparkSession, d: str) -> tuple[str, outcomes.Outcome]:
    """A plan over orders, of which some fail at every try and some at the first."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("size"))
    done = orders.filter("o_orderkey % 3 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit(-1)).otherwise(F.col("size")).alias("size"))
    plan = increment.plan_increment(orders, done, "o_orderkey", ["size"])
    tried: set[int] = set()

    def build(row: dict) -> dict:
        k = row["o_orderkey"]
        if k % 11 == 0 or k % 7 == 0 and k not in tried:
            tried.add(k)
            raise ValueError(f"cannot read /data/x/{k}")
        return {"twice": 2 * k}

    out = scratch(spark, "run")
    return out, outcomes.run_plan(plan, build, "twice long", out, "/data/x")


@query("J1_run_outcome", f"WITH {_OUTCOME} SELECT outcome, count(*) AS n, sum(tries)::BIGINT AS tries, (sum(2 * k) FILTER (outcome IN ('saved', 'rebuilt')))::BIGINT AS built, (SELECT (count(*) > 0)::INTEGER FROM o WHERE outcome = 'failed') AS exit_code FROM o GROUP BY outcome")
def j1_outcome(spark: SparkSession, d: str) -> DataFrame:
    out, outcome = _run(spark, d)
    counts = spark.createDataFrame([(c, getattr(outcome, c)) for c in outcomes.OUTCOMES], "outcome string, n long")
    rows = spark.read.parquet(f"{out}/rows").groupBy("outcome").agg(F.sum("tries").alias("tries"), F.sum("built.twice").alias("built"))
    return counts.join(rows, "outcome").withColumn("exit_code", F.lit(outcome.exit_code))


@query("J1_failures", f"WITH {_OUTCOME} SELECT k AS o_orderkey, tries, 'ValueError: cannot read <DATASET_ROOT>/' || k AS message FROM o WHERE outcome = 'failed'")
def j1_failures(spark: SparkSession, d: str) -> DataFrame:
    out, _ = _run(spark, d)
    return spark.read.schema("o_orderkey long, tries int, message string").json(f"{out}/failures")


_ORDERS = "o_orderkey long, o_custkey long, note string"


def _streamed(spark: SparkSession, d: str) -> str:
    """Orders published in three steps: half of them, the others with some that are there already, and some with a new customer. A customer number that ends in 0 is broken."""
    root = scratch(spark, "stream")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"), F.concat(F.lit(f"{root}/in/"), F.col("o_orderkey").cast("string")).alias("note"))
    changed = orders.filter("o_orderkey % 4 = 0").withColumn("o_custkey", -F.col("o_custkey"))
    for part in (orders.filter("o_orderkey % 2 = 0"), orders.filter("o_orderkey % 2 = 1 or o_orderkey % 3 = 0"), changed):
        part.write.mode("append").parquet(f"{root}/in")
        increment.stream_increment(spark, f"{root}/in", _ORDERS, f"{root}/out", f"{root}/log", "o_orderkey", {"broken": F.col("o_custkey") % 10 == 0}).awaitTermination()
    return root


@query("J2_stream_increment", "SELECT version, count(*) AS n, sum(o_custkey)::BIGINT AS total FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN o_orderkey % 4 = 0 THEN -o_custkey ELSE o_custkey END AS o_custkey FROM orders WHERE o_custkey % 10 <> 0) GROUP BY version")
def j2(spark: SparkSession, d: str) -> DataFrame:
    newest = increment.published(spark, f"{_streamed(spark, d)}/out", "o_orderkey", spark.createDataFrame([], _ORDERS).schema)
    return newest.groupBy("version").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("total"))


@query("J2_rejected", """
WITH b AS (SELECT o_orderkey, o_custkey, 0::BIGINT AS batch FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey, 1 FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, -o_custkey, 2 FROM orders WHERE o_orderkey % 4 = 0)
SELECT o_orderkey, o_custkey, '<DATASET_ROOT>/' || o_orderkey AS note, 'broken' AS reasons, batch FROM b WHERE o_custkey % 10 = 0""")
def j2_rejected(spark: SparkSession, d: str) -> DataFrame:
    return increment.rejected(spark, f"{_streamed(spark, d)}/out", _ORDERS).withColumn("reasons", F.array_join("reasons", "|"))


@query("J2_replayed_batches", """
WITH b AS (SELECT 0::BIGINT AS batch, o_custkey % 10 = 0 AS bad, 'saved' AS o FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 1, o_custkey % 10 = 0, CASE WHEN o_orderkey % 2 = 0 THEN 'skipped' ELSE 'saved' END FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 3 = 0 UNION ALL SELECT 2, o_custkey % 10 = 0, 'rebuilt' FROM orders WHERE o_orderkey % 4 = 0)
SELECT batch, count(*) FILTER (NOT bad AND o = 'saved') AS saved, count(*) FILTER (NOT bad AND o = 'skipped') AS skipped, count(*) FILTER (NOT bad AND o = 'rebuilt') AS rebuilt, count(*) FILTER (bad) AS failed, 0::BIGINT AS new_files FROM b GROUP BY batch""")
def j2_replayed(spark: SparkSession, d: str) -> DataFrame:
    # Every batch comes once more: its outcome is the one that was committed, and no file is added.
    out = f"{_streamed(spark, d)}/out"
    n_files = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out).count()
    before, rows = n_files(), []
    for m in increment.manifests(spark, out).select("stream", "batch").collect():
        again = increment.publish_batch(table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.lit(1).cast("long").alias("o_custkey"), F.lit("").alias("note")), m["batch"], out, "o_orderkey", stream=m["stream"])
        rows.append((m["batch"], again.saved, again.skipped, again.rebuilt, again.failed))
    replayed = spark.createDataFrame(rows, "batch long, saved long, skipped long, rebuilt long, failed long")
    return replayed.withColumn("new_files", F.lit(n_files() - before).cast("long"))


@query("G2_page_groups", """
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages)
SELECT 'task:' || regexp_replace(path, '/?[^/]*$', '') AS "group", count(DISTINCT page_id % 2) AS n_splits, count(*) AS n FROM p GROUP BY 1 HAVING count(DISTINCT page_id % 2) > 1""")
def g2_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = page_paths(spark, d).withColumn("split", (F.col("page_id") % 2).cast("string"))
    return joins.group_overlap(pages, paths.group_key(F.col("path"), "tasks"))


@query("G1_disjoint_split", f"WITH {_SPLIT} SELECT source, CASE WHEN o.k <= b.k THEN 'train' ELSE 'test' END AS split FROM o, b")
def g1_split(spark: SparkSession, d: str) -> DataFrame:
    split = ranking.group_split(table(spark, d, "documents").select("doc_id", "source"), "source", 0.8, 3).select("source", "split").distinct()
    joins.assert_disjoint(split.filter("split = 'train'"), split.filter("split = 'test'"), "source")
    return split
