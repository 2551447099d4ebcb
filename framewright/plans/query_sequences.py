"""Queries of sequences, windows, ranking, geometry and arrays (E, F, H, C5-C7, C11, D1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import arrays, geometry
from framewright.operators import metrics, ranking, sequences
from framewright.plans.registry import DAILY, FRAMES, LENGTHS, SAMPLES, daily, frames, query, r6, table


@query("flagship_persistence", f"""
WITH {SAMPLES}, v AS (SELECT s.episode_id, s.half, s.pos, f.x, f.y FROM s JOIN f USING (episode_id, t)),
h AS (SELECT episode_id, x AS hx, y AS hy FROM v WHERE half = 'past' AND pos = 31),
e AS (SELECT episode_id, pos, sqrt((x - hx) * (x - hx) + (y - hy) * (y - hy)) AS err FROM v JOIN h USING (episode_id) WHERE half = 'target')
SELECT episode_id AS user_id, round(avg(err), 6) AS ade, round(max(err) FILTER (pos = 31), 6) AS fde FROM e GROUP BY episode_id""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    held = sequences.persistence_forecast(frames(spark, d))
    dx, dy = F.col("x") - F.col("held_x"), F.col("y") - F.col("held_y")
    scores = metrics.displacement(held.withColumn("err", F.sqrt(dx * dx + dy * dy)), "episode_id", "pos", F.col("err"))
    return scores.select(F.col("episode_id").alias("user_id"), r6("ade").alias("ade"), r6("fde").alias("fde"))


@query("D1_episode_lengths", f"WITH {FRAMES} SELECT episode_id, CASE WHEN bool_or(x IS NULL OR x > 400) THEN 0 ELSE count(*) END AS n_frames, CASE WHEN bool_or(x IS NULL OR x > 400) THEN 'unreadable frame' END AS reason FROM f GROUP BY episode_id")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return sequences.episode_lengths(frames(spark, d), readable=F.col("x") <= 400)


@query("E1_keep_first", "SELECT sha256(text) AS identity, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def e1(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("identity"))
    return ranking.keep_first(docs, F.col("identity"), [F.col("doc_id")]).select("identity", "doc_id")


@query("E2_seeded_order", "SELECT doc_id, row_number() OVER (ORDER BY sha256('13:' || doc_id), doc_id) - 1 AS position FROM documents")
def e2(spark: SparkSession, d: str) -> DataFrame:
    return ranking.seeded_rank(table(spark, d, "documents").select("doc_id"), "doc_id", 13)


@query("E3_balanced_subset", """
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('5:' || doc_id), doc_id) AS k FROM documents)
SELECT doc_id, source FROM r ORDER BY k, sha256('5:' || source), source LIMIT (SELECT count(*) // 3 FROM documents)""")
def e3(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return ranking.group_balanced_subset(docs, "source", "doc_id", docs.count() // 3, 5)


_SPLIT = """n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), o AS (SELECT source, sum(n) OVER w AS cut, row_number() OVER w AS k FROM n WINDOW w AS (ORDER BY sha256('3:' || source), source)),
g AS (SELECT greatest(1, least(floor(sum(n) * 0.8)::BIGINT, sum(n) - 1)) AS target FROM n),
b AS (SELECT k FROM o, g WHERE k < (SELECT count(*) FROM n) ORDER BY abs(cut - target), k LIMIT 1)"""


@query("E4_group_split", f"WITH {_SPLIT} SELECT doc_id, source, CASE WHEN o.k <= b.k THEN 'train' ELSE 'test' END AS split FROM documents JOIN o USING (source), b")
def e4(spark: SparkSession, d: str) -> DataFrame:
    return ranking.group_split(table(spark, d, "documents").select("doc_id", "source"), "source", 0.8, 3)


@query("E5_ordinal_split", """
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, position, CASE WHEN position < floor(n * 0.7) THEN 'train' ELSE 'test' END AS split FROM r WHERE position < floor(n * 0.9)""")
def e5(spark: SparkSession, d: str) -> DataFrame:
    return ranking.ordinal_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", (0.7, 0.9, 1.0))


@query("E6_modulo_shard", "SELECT p_partkey, position FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS position FROM part) WHERE position % 5 = 2")
def e6(spark: SparkSession, d: str) -> DataFrame:
    return ranking.modulo_shard(table(spark, d, "part").select("p_partkey"), "p_partkey", 5, 2)


@query("E7_hash_shard", "SELECT page_id, (('0x' || substr(sha256(url), 1, 16))::UBIGINT % 24)::INTEGER AS shard FROM pages")
def e7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", ranking.hash_shard(F.col("url"), 24).alias("shard"))


@query("E8_locate_offset", """
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT l_orderkey, n, sum(n) OVER (ORDER BY l_orderkey) AS upto FROM n)
SELECT o_orderkey AS "index", l_orderkey, (o_orderkey - (upto - n))::BIGINT AS "offset" FROM orders JOIN c ON o_orderkey >= upto - n AND o_orderkey < upto""")
def e8(spark: SparkSession, d: str) -> DataFrame:
    lengths = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("index"))
    return ranking.locate_offset(wanted, lengths, "l_orderkey").select("index", "l_orderkey", F.col("offset").cast("long").alias("offset"))


@query("E9_select_best", f"""
WITH {DAILY}, m AS (SELECT *, min(CASE WHEN NOT isnan(val) THEN val END) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM e),
i AS (SELECT epoch, train, CASE WHEN isnan(val) THEN NULL ELSE val END AS val, coalesce(NOT isnan(val) AND (low IS NULL OR val < low), false) AS improved FROM m)
SELECT *, epoch = (SELECT max(epoch) FROM i WHERE improved) AS chosen FROM i""")
def e9(spark: SparkSession, d: str) -> DataFrame:
    return sequences.select_best(daily(spark, d), "epoch", "val").withColumn("val", F.nanvl("val", F.lit(None).cast("double")))


@query("E9_best_of_runs", """
WITH m AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM events),
i AS (SELECT *, coalesce(low IS NULL OR value < low, false) AND value IS NOT NULL AS improved FROM m)
SELECT user_id, event_id, improved, coalesce(event_id = max(event_id) FILTER (improved) OVER (PARTITION BY user_id), false) AS chosen FROM i""")
def e9_runs(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_id", "value")
    return sequences.select_best(events, "event_id", "value", by="user_id").select("user_id", "event_id", "improved", "chosen")


@query("E10_audit_epoch_log", """
WITH r AS (SELECT conv_id, turn, (turn + 1) > coalesce(lag(turn + 1) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS ok FROM conversations)
SELECT conv_id, bool_and(ok) AS rising, max(turn + 1) AS last_epoch, max(turn + 1) = 4 AS ends_as_expected FROM r GROUP BY conv_id""")
def e10(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") + 1).alias("epoch"))
    return sequences.audit_epoch_log(rows, "conv_id", "epoch", "turn", F.lit(4).cast("long"))


@query("E11_midpoint_windows", f"WITH {SAMPLES} SELECT episode_id, half, pos::INTEGER AS pos, t AS frame_idx FROM s")
def e11(spark: SparkSession, d: str) -> DataFrame:
    return sequences.midpoint_windows(sequences.episode_lengths(frames(spark, d)))


@query("C6_take_samples", f"WITH {SAMPLES} SELECT episode_id, half, pos::INTEGER AS pos, t AS frame_idx, event_id FROM s JOIN f USING (episode_id, t)")
def c6(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    return sequences.take_samples(sequences.midpoint_windows(sequences.episode_lengths(f)), f).select("episode_id", "half", "pos", "frame_idx", "event_id")


@query("C11_hold_last_observed", f"""
WITH {LENGTHS}, o AS (SELECT episode_id, arg_max(event_id, t) AS held_event_id, arg_max(x, t) AS held_x FROM f JOIN l USING (episode_id) WHERE t < n // 2 GROUP BY 1)
SELECT episode_id, t, round(held_x, 6) AS held_x, held_event_id FROM f JOIN l USING (episode_id) JOIN o USING (episode_id) WHERE t >= n // 2""")
def c11(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    halves = f.join(sequences.episode_lengths(f).select("episode_id", F.floor(F.col("n_frames") / 2).alias("m")), "episode_id")
    held = sequences.hold_last_observed(halves.filter("t < m"), halves.filter("t >= m").select("episode_id", "t"), "episode_id", ["t"], ["x", "event_id"])
    return held.select("episode_id", "t", r6("held_x").alias("held_x"), "held_event_id")


@query("H18_persistence_forecast", f"""
WITH {SAMPLES}, v AS (SELECT s.episode_id, s.half, s.pos, f.x, f.y FROM s JOIN f USING (episode_id, t)), h AS (SELECT episode_id, x AS held_x, y AS held_y FROM v WHERE half = 'past' AND pos = 31)
SELECT episode_id, pos::INTEGER AS pos, round(x, 6) AS x, round(held_x, 6) AS held_x, held_y FROM v JOIN h USING (episode_id) WHERE half = 'target'""")
def h18(spark: SparkSession, d: str) -> DataFrame:
    return sequences.persistence_forecast(frames(spark, d)).select("episode_id", "pos", r6("x").alias("x"), r6("held_x").alias("held_x"), "held_y")


@query("H18_hand_reference", f"""
WITH {LENGTHS}, o AS (SELECT episode_id, event_type AS joint, arg_max(x, t) AS x, arg_max(y, t) AS y, arg_max(event_id % 2, t) AS side FROM f JOIN l USING (episode_id) WHERE t < n // 2 GROUP BY ALL),
r AS (SELECT episode_id, min(x) AS rx, max(x) AS lx FROM f GROUP BY episode_id)
SELECT f.event_id, round(o.x + CASE o.side WHEN 0 THEN rx ELSE lx END + 2, 6) AS x, round(3 * (o.y + 1), 6) AS y FROM f JOIN l USING (episode_id) JOIN o ON o.episode_id = f.episode_id AND o.joint = f.event_type JOIN r ON r.episode_id = f.episode_id WHERE t >= n // 2""")
def h18_hand(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    lengths = sequences.episode_lengths(f)
    rows = f.join(lengths.withColumn("m", F.floor(F.col("n_frames") / 2)), "episode_id").withColumnRenamed("event_type", "joint")
    c = lambda v: F.lit(float(v))
    observed = rows.filter("t < m").select("episode_id", "t", "joint", F.when(F.col("event_id") % 2 == 0, "right").otherwise("left").alias("side"), F.array("x", "y", c(0)).alias("xyz"))
    world = F.array(c(1), c(0), c(0), c(2), c(0), c(3), c(0), c(0), c(0), c(0), c(1), c(0), c(0), c(0), c(0), c(1))
    hands = f.groupBy("episode_id").agg(F.array(F.min("x"), c(1), c(0)).alias("right"), F.array(F.max("x"), c(1), c(0)).alias("left")).withColumn("pose", world)
    found = sequences.hand_reference_forecast(rows.filter("t >= m").select("episode_id", "t", "joint"), observed, hands, "perhand", "pose")
    return found.join(f.select("episode_id", "t", "event_id"), ["episode_id", "t"]).select("event_id", r6(F.get("xyz", F.lit(0))).alias("x"), r6(F.get("xyz", F.lit(1))).alias("y"))


@query("C5_nearest_match", f"""
WITH {FRAMES}, src AS (SELECT episode_id, t, event_id FROM f WHERE event_id % 3 = 0), tgt AS (SELECT episode_id, t, event_id FROM f WHERE event_id % 3 <> 0),
c AS (SELECT tgt.episode_id, tgt.event_id, tgt.t, src.t AS st, src.event_id AS se, row_number() OVER (PARTITION BY tgt.event_id ORDER BY abs(src.t - tgt.t), src.t DESC) AS k FROM tgt JOIN src USING (episode_id))
SELECT episode_id, event_id, t, st::DOUBLE AS match_key, se AS match_event_id FROM c WHERE k = 1""")
def c5(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("episode_id", "event_id", "t")
    found = sequences.nearest_match(f.filter("event_id % 3 <> 0"), f.filter("event_id % 3 = 0"), "episode_id", "t", ["event_id"], "event_id")
    return found.select("episode_id", "event_id", "t", "match_key", "match_event_id")


@query("E12_uniform_resample", """
WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
k AS (SELECT DISTINCT conv_id, n, pos FROM c, range(0, 4) AS r(pos))
SELECT k.conv_id, pos::INTEGER AS pos, turn, role FROM k JOIN c ON c.conv_id = k.conv_id AND c.t = (pos * (k.n - 1)) // 3""")
def e12(spark: SparkSession, d: str) -> DataFrame:
    return sequences.uniform_resample(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"], 4).select("conv_id", "pos", "turn", "role")


@query("E13_target_positions", f"WITH {LENGTHS} SELECT episode_id, pos::INTEGER AS pos, round_even((pos * (n - 1)::DOUBLE / 9)::FLOAT::DOUBLE, 0)::BIGINT AS frame_idx FROM l, range(0, 10) AS r(pos)")
def e13(spark: SparkSession, d: str) -> DataFrame:
    lengths = sequences.episode_lengths(frames(spark, d))
    return lengths.select("episode_id", F.posexplode(arrays.target_positions(10, F.col("n_frames"), rounded=True)).alias("pos", "frame_idx"))


@query("E14_temporal_stride", f"WITH {FRAMES} SELECT event_id, t // 3 AS t FROM f WHERE t % 3 = 0")
def e14(spark: SparkSession, d: str) -> DataFrame:
    return sequences.temporal_stride(frames(spark, d), 3).select("event_id", "t")


@query("E15_context_future", f"WITH {FRAMES} SELECT event_id, t // 2 AS t, CASE WHEN t // 2 < 16 THEN 'past' ELSE 'future' END AS part FROM f WHERE t % 2 = 0 AND t // 2 < 24")
def e15(spark: SparkSession, d: str) -> DataFrame:
    return sequences.context_future(sequences.temporal_stride(frames(spark, d), 2), 16, 8).select("event_id", "t", "part")


@query("E16_sampling_rate", f"WITH {FRAMES} SELECT episode_id, round(CASE WHEN count(DISTINCT ts_us) > 1 THEN (count(DISTINCT ts_us) - 1) / ((max(ts_us) - min(ts_us)) / 1000000.0) ELSE 1.0 END, 9) AS rate FROM f GROUP BY episode_id")
def e16(spark: SparkSession, d: str) -> DataFrame:
    return sequences.sampling_rate(frames(spark, d), "episode_id", F.col("ts_us") / 1e6).select("episode_id", F.round("rate", 9).alias("rate"))


@query("E17_frame_times", f"""
WITH {LENGTHS}, c AS (SELECT episode_id, event_id, t, n, CASE WHEN episode_id % 4 = 2 THEN t / 30.0 ELSE ts_us / 1000000.0 + 0.05 - CASE WHEN episode_id % 4 = 1 AND t = 5 THEN 1000000 ELSE 0 END END AS centre FROM f JOIN l USING (episode_id))
SELECT event_id, round(centre, 3) AS centre, round(avg(centre) FILTER (t IN (n // 2 - 1, n // 2)) OVER (PARTITION BY episode_id), 3) AS boundary, CASE WHEN episode_id % 4 = 1 AND n > 5 THEN 'times are not finite and rising' END AS reason FROM c""")
def e17(spark: SparkSession, d: str) -> DataFrame:
    # Some episodes go back once, and some span no time.
    c = F.col("episode_id") % 4
    start = F.when(c == 2, 100.0).otherwise(F.col("ts_us") / 1e6 - F.when((c == 1) & (F.col("t") == 5), 1_000_000).otherwise(0))
    out = sequences.frame_times(frames(spark, d), "episode_id", ["t"], start, start + F.when(c == 2, 0.0).otherwise(0.1), 30.0)
    return out.select("event_id", F.round("centre", 3).alias("centre"), F.round("boundary", 3).alias("boundary"), "reason")


@query("F1_first_n_per_worker", "SELECT p_partkey, worker FROM (SELECT p_partkey, p_partkey % 7 AS worker, row_number() OVER (PARTITION BY p_partkey % 7 ORDER BY p_partkey) AS k FROM part) WHERE k <= 5")
def f1(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 7).alias("worker"))
    return ranking.first_n_per_worker(parts, "worker", [F.col("p_partkey")], 5)


@query("F2_preview", "WITH o AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) SELECT string_agg(k::VARCHAR, ', ' ORDER BY k) || ' (+' || ((SELECT count(*) FROM o) - 2) || ' more)' AS preview FROM (SELECT o_orderkey AS k FROM o ORDER BY 1 LIMIT 2)")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return ranking.preview_text(table(spark, d, "orders").filter("o_totalprice > 100000"), "o_orderkey", 2)


@query("F2_first_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def f2_rows(spark: SparkSession, d: str) -> DataFrame:
    return ranking.preview(table(spark, d, "orders").filter("o_totalprice > 100000").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 20)


@query("F3_latest_valid", "SELECT 'run_epoch_' || max(o_orderkey) AS name, max(o_orderkey)::INTEGER AS epoch FROM orders WHERE o_orderstatus = 'F'")
def f3(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "orders").select(F.concat(F.lit("run_epoch_"), F.col("o_orderkey").cast("string")).alias("name"), "o_orderstatus")
    return ranking.latest_valid(runs, "name", F.col("o_orderstatus") == "F")


# A pose from a line item: a sheared, scaled frame and a translation; a point and a camera too.
_M = "ARRAY[1 + l_discount, 0.1, l_tax, l_quantity, -0.2, 1 - l_discount, 0.3, l_extendedprice / 1000, l_tax, -0.1, 2 + l_tax, l_linenumber, 0, 0, 0, 1]"


def _poses(spark: SparkSession, d: str) -> DataFrame:
    c = lambda v: F.lit(float(v))
    q, p, disc, tax, n = (F.col(x).cast("double") for x in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"))
    m = F.array(1 + disc, c(0.1), tax, q, c(-0.2), 1 - disc, c(0.3), p / 1000, tax, c(-0.1), 2 + tax, n, c(0), c(0), c(0), c(1))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", m.alias("m"), F.array(q, p / 1000, n).alias("xyz"))


_POSE = f"p AS (SELECT l_orderkey, l_linenumber, list_transform({_M}, lambda v: v::DOUBLE) AS m, l_quantity::DOUBLE AS x, (l_extendedprice / 1000)::DOUBLE AS y, l_linenumber::DOUBLE AS z FROM lineitem)"
_DET = "(m[1] * (m[6] * m[11] - m[7] * m[10]) - m[2] * (m[5] * m[11] - m[7] * m[9]) + m[3] * (m[5] * m[10] - m[6] * m[9]))"


@query("H1_as_4x4", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 16 WHEN 1 THEN 16 END::BIGINT AS n, CASE WHEN l_linenumber % 3 < 2 THEN 1.0::DOUBLE END AS corner FROM lineitem")
def h1(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("l_linenumber") % 3
    m = geometry.as_4x4(F.when(c == 0, F.col("m")).when(c == 1, F.slice("m", 1, 12)).otherwise(F.slice("m", 1, 9)))
    return _poses(spark, d).select("l_orderkey", "l_linenumber", F.when(m.isNotNull(), F.size(m)).cast("long").alias("n"), F.get(m, F.lit(15)).alias("corner"))


@query("H2_affine_inverse", f"""
WITH {_POSE}, i AS (SELECT *, {_DET} AS det FROM p),
a AS (SELECT *, (m[6] * m[11] - m[7] * m[10]) / det AS a, (m[3] * m[10] - m[2] * m[11]) / det AS b, (m[2] * m[7] - m[3] * m[6]) / det AS c FROM i)
SELECT l_orderkey, l_linenumber, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(-(a * m[4] + b * m[8] + c * m[12]), 6) AS tx FROM a""")
def h2(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: r6(F.get("inv", F.lit(i)))
    return geometry.with_inverse(_poses(spark, d), "m", "inv").select("l_orderkey", "l_linenumber", at(0).alias("a"), at(1).alias("b"), at(2).alias("c"), at(3).alias("tx"))


# A camera for each order and line: another matrix than the pose.
_EXT = "[1 + a, 0.2, b, 10 * a, -0.1, 2 - a, 0.1, 5 * b, a, 0.3, 1 + b, 1.5]"
_EXT_DET = _DET.replace("m[", "e[")
_COFACTORS = [[f"(e[{p}] * e[{q}] - e[{r}] * e[{s}])" for p, q, r, s in row] for row in (((6, 11, 7, 10), (3, 10, 2, 11), (2, 7, 3, 6)), ((7, 9, 5, 11), (1, 11, 3, 9), (3, 5, 1, 7)), ((5, 10, 6, 9), (2, 9, 1, 10), (1, 6, 2, 5)))]
_LINEAR = ", ".join(f"{_COFACTORS[r][k]} / det" for r in range(3) for k in range(3))
_BACK = ", ".join(f"-(v[{3 * r + 1}] * e[4] + v[{3 * r + 2}] * e[8] + v[{3 * r + 3}] * e[12])" for r in range(3))
_MOVED = ", ".join(f"round(v[{3 * r + 1}] * m[{c + 1}] + v[{3 * r + 2}] * m[{c + 5}] + v[{3 * r + 3}] * m[{c + 9}] + w[{r + 1}] * m[{c + 13}], 8) + 0.0::DOUBLE AS m{r}{c}" for r in range(3) for c in range(4))


@query("C7_to_camera_frame", f"""
WITH {_POSE}, e AS (SELECT *, list_transform({_EXT}, lambda v: v::DOUBLE) AS e FROM (SELECT *, (l_orderkey % 7)::DOUBLE / 10 AS a, l_linenumber::DOUBLE / 10 AS b FROM p)), i AS (SELECT *, {_EXT_DET} AS det FROM e),
v AS (SELECT *, [{_LINEAR}] AS v FROM i), w AS (SELECT *, [{_BACK}] AS w FROM v)
SELECT l_orderkey::VARCHAR AS episode_id, l_linenumber AS frame_idx, {_MOVED} FROM w""")
def c7(spark: SparkSession, d: str) -> DataFrame:
    rows = _poses(spark, d).select(F.col("l_orderkey").cast("string").alias("episode_id"), F.col("l_linenumber").alias("frame_idx"), F.lit("wrist").alias("joint"), "m")
    a, b = (F.col("episode_id").cast("long") % 7).cast("double") / 10, F.col("frame_idx").cast("double") / 10
    c = lambda v: F.lit(float(v))
    ext = F.array(1 + a, c(0.2), b, 10 * a, c(-0.1), 2 - a, c(0.1), 5 * b, a, c(0.3), 1 + b, c(1.5), c(0), c(0), c(0), c(1))
    found = sequences.to_camera_frame(rows, rows.select("episode_id", "frame_idx").distinct().withColumn("ext", ext))
    return found.select("episode_id", "frame_idx", *((F.round(F.get("m", F.lit(4 * r + k)), 8) + 0.0).alias(f"m{r}{k}") for r in range(3) for k in range(4)))


@query("H3_apply_pose", f"WITH {_POSE} SELECT l_orderkey, l_linenumber, round(m[1] * x + m[2] * y + m[3] * z + m[4], 6) AS x, round(m[9] * x + m[10] * y + m[11] * z + m[12], 6) AS z FROM p")
def h3(spark: SparkSession, d: str) -> DataFrame:
    out = geometry.apply_pose(F.col("m"), F.col("xyz"))
    return _poses(spark, d).select("l_orderkey", "l_linenumber", r6(F.get(out, F.lit(0))).alias("x"), r6(F.get(out, F.lit(2))).alias("z"))


@query("H4_pose_from_point", "SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS tx, 3.0::DOUBLE + 1 AS trace FROM lineitem")
def h4(spark: SparkSession, d: str) -> DataFrame:
    m = geometry.pose_from_point(F.col("xyz"))
    at = lambda i: F.get(m, F.lit(i))
    return _poses(spark, d).select("l_orderkey", "l_linenumber", at(3).alias("tx"), (at(0) + at(5) + at(10) + at(15)).alias("trace"))


@query("H5_split_pose", f"WITH {_POSE} SELECT l_orderkey, l_linenumber, round(m[1] + m[6] + m[11], 6) AS trace, round(m[4], 6) AS tx, round(m[12], 6) AS tz FROM p")
def h5(spark: SparkSession, d: str) -> DataFrame:
    r, t = geometry.rotation(F.col("m")), geometry.translation(F.col("m"))
    return _poses(spark, d).select("l_orderkey", "l_linenumber", r6(F.get(r, F.lit(0)) + F.get(r, F.lit(4)) + F.get(r, F.lit(8))).alias("trace"), r6(F.get(t, F.lit(0))).alias("tx"), r6(F.get(t, F.lit(2))).alias("tz"))


_CAMERA = (700.0, 0.0, 960.0, 0.0, 710.0, 540.0, 0.0, 0.0, 1.0)


@query("H6_project_pinhole", f"WITH {_POSE} SELECT l_orderkey, l_linenumber, CASE WHEN z - 3 <> 0 THEN round(700 * x / (z - 3) + 960, 6) END AS u, CASE WHEN z - 3 <> 0 THEN round(710 * y / (z - 3) + 540, 6) END AS v FROM p")
def h6(spark: SparkSession, d: str) -> DataFrame:
    xyz = F.transform("xyz", lambda x, i: F.when(i == 2, x - 3).otherwise(x))
    uv = geometry.project_pinhole(xyz, F.array(*(F.lit(v) for v in _CAMERA)))
    known = lambda i: r6(F.nanvl(F.get(uv, F.lit(i)), F.lit(None).cast("double")))
    return _poses(spark, d).select("l_orderkey", "l_linenumber", known(0).alias("u"), known(1).alias("v"))


@query("H7_rescale_intrinsics", "SELECT l_orderkey, l_linenumber, round((700 + l_quantity) * 256.0 / 1920, 6)::DOUBLE AS fx, 270.0::DOUBLE AS cy FROM lineitem")
def h7(spark: SparkSession, d: str) -> DataFrame:
    k = F.transform(F.array(*(F.lit(v) for v in _CAMERA)), lambda x, i: F.when(i == 0, x + F.col("l_quantity").cast("double")).otherwise(x))
    out = geometry.rescale_intrinsics(k, 256, 540)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(F.get(out, F.lit(0))).alias("fx"), F.get(out, F.lit(5)).alias("cy"))


@query("H8_visible_segments", f"""
WITH {FRAMES} SELECT a.episode_id, a.t AS a, b.t AS b FROM f a JOIN f b ON a.episode_id = b.episode_id AND b.t = a.t + 1
WHERE (a.x >= 0 AND a.x < 40 AND a.y >= 0 AND a.y < 60) OR (b.x >= 0 AND b.x < 40 AND b.y >= 0 AND b.y < 60)""")
def h8(spark: SparkSession, d: str) -> DataFrame:
    points = frames(spark, d).select("episode_id", F.col("t").alias("joint"), F.col("x").alias("u"), F.col("y").alias("v"))
    chain = points.select(F.col("joint").alias("a")).distinct().withColumn("b", F.col("a") + 1)
    return sequences.visible_segments(points, chain, ["episode_id"], 40, 60).select("episode_id", "a", "b")


@query("H9_mask_nonfinite", f"WITH {FRAMES} SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE round(x, 6) END AS x, CASE WHEN event_id % 5 = 0 THEN 0.0 WHEN event_id % 7 = 0 THEN 1.0 WHEN event_id % 11 = 0 THEN 0.0 ELSE round(x / 1000, 9) END AS conf FROM f")
def h9(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("x"))
    conf = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("x") / 1000)
    out = arrays.mask_nonfinite(F.array(x, F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), conf)
    return frames(spark, d).select("event_id", r6(out["camera"][0]).alias("x"), F.round(out["conf"], 9).alias("conf"))


@query("H10_pad_lossless", """
WITH w AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)
SELECT doc_id, CASE WHEN n <= 512 THEN n END::INTEGER AS length, CASE WHEN n <= 512 THEN 512 END::INTEGER AS padded, CASE WHEN n <= 512 THEN n END::INTEGER AS valid FROM w""")
def h10(spark: SparkSession, d: str) -> DataFrame:
    out = arrays.pad_lossless(F.split("text", " "), 512, F.lit(""))
    rows = table(spark, d, "documents").select("doc_id", out.alias("p"))
    known = F.col("p").isNotNull()
    return rows.select("doc_id", F.col("p.length").alias("length"), F.when(known, F.size("p.values")).alias("padded"), F.when(known, F.size(F.filter("p.mask", lambda m: m))).alias("valid"))


@query("H11_last_step", "SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def h11(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return steps.select("conv_id", arrays.last_step(F.col("turns")).alias("last_turn"))


@query("H12_span_drop", """
WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 WHEN turn % 4 = 3 THEN 2 ELSE 3 END AS id, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
-- Depth before a turn by the rule: starts add one, ends take one off, never below 0. Starts and ends alternate, so the least prefix sum settles it.
s AS (SELECT *, sum(CASE id WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS d FROM c),
z AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY conv_id ORDER BY i), 0) - least(0, coalesce(min(d) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS depth FROM s)
SELECT conv_id, count(*) FILTER (id = 1 OR depth > 0 OR i >= n - 1) AS n_dropped FROM z GROUP BY conv_id""")
def h12(spark: SparkSession, d: str) -> DataFrame:
    token = F.when(F.col("role") == "user", 1).when(F.col("turn") % 4 == 3, 2).otherwise(3)
    ids = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", token.alias("id")))), lambda x: x["id"]).alias("ids"))
    mask = arrays.span_drop_mask(F.col("ids"), starts=[1], ends=[2], suffix=1)
    return ids.select("conv_id", F.size(F.filter(mask, lambda m: m)).cast("long").alias("n_dropped"))


@query("H12_apply_drop", """
WITH v AS (SELECT vec_id, i, embedding[i + 1] AS a, embedding[i + 2] AS b FROM embeddings, range(0, 60, 2) AS r(i))
SELECT vec_id, round(sum(CASE WHEN (vec_id + i // 2) % 3 = 0 AND i < 40 THEN 0 ELSE a::DOUBLE + 2 * b::DOUBLE END), 6) AS total FROM v GROUP BY vec_id""")
def h12_apply(spark: SparkSession, d: str) -> DataFrame:
    # Features of two values each; the mask is shorter than they are.
    features = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.slice("embedding", 2 * k + 1, F.lit(2)))
    mask = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: (F.col("vec_id") + k) % 3 == 0)
    kept = arrays.apply_drop(features, mask)
    total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x[0].cast("double") + 2 * x[1].cast("double"))
    return table(spark, d, "embeddings").select("vec_id", r6(total).alias("total"))


@query("H13_align_tubelets", "SELECT vec_id, vec_id * 2 + j AS t FROM embeddings, range(0, 2) AS r(j)")
def h13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.explode(arrays.align_tubelets(F.col("vec_id"), 2)).alias("t"))


@query("H14_gather", "SELECT vec_id, (vec_id // 8) * 8 + vec_id % 8 AS flat, round(embedding[4]::DOUBLE + embedding[64]::DOUBLE, 6) AS total FROM embeddings")
def h14(spark: SparkSession, d: str) -> DataFrame:
    picked = arrays.gather(F.col("embedding"), F.array(F.lit(3), F.lit(63)))
    return table(spark, d, "embeddings").select("vec_id", arrays.flatten_index(F.floor(F.col("vec_id") / 8), F.col("vec_id") % 8, 8).alias("flat"), r6(picked[0].cast("double") + picked[1].cast("double")).alias("total"))


@query("H15_map_level", "SELECT p_partkey, CASE WHEN p_size <= 1 THEN 0 ELSE round_even((p_partkey % p_size) * 7.0 / (p_size - 1), 0)::INTEGER END AS level FROM part")
def h15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", arrays.map_level((F.col("p_partkey") % F.col("p_size")).cast("decimal(12,0)"), F.col("p_size"), F.lit(8)).alias("level"))


@query("H16_add_reference", f"WITH {FRAMES} SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN x + 1 ELSE x + 2 END, 6) AS perhand, round(x + 3, 6) AS both_hands, round(x + 1.5, 6) AS average FROM f")
def h16(spark: SparkSession, d: str) -> DataFrame:
    one = lambda v: F.array(F.lit(float(v)), F.lit(0.0), F.lit(0.0))
    side = F.when(F.col("event_id") % 2 == 0, "right").otherwise("left")
    xyz = F.array("x", "y", F.lit(0.0))
    out = {m: geometry.add_reference(xyz, side, one(1), one(2), m)[0] for m in ("perhand", "both", "avg")}
    return frames(spark, d).select("event_id", r6(out["perhand"]).alias("perhand"), r6(out["both"]).alias("both_hands"), r6(out["avg"]).alias("average"))


# Episodes have n cameras with ids (c = 0), too many with ids (1), too many without (2), none but a static one (3).
_CAMERAS = """c AS (SELECT *, episode_id % 4 AS c FROM f JOIN l USING (episode_id) WHERE n >= 20), d AS (SELECT *, CASE WHEN c = 0 THEN t < 16 ELSE t % 3 = 0 END AS kept FROM c WHERE c <> 3),
k AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY t) - 1 AS place, count(*) OVER (PARTITION BY episode_id) AS m FROM d WHERE kept),
w AS (SELECT DISTINCT episode_id, c, n, pos, (pos * (n - 1)::DOUBLE / 15)::FLOAT::DOUBLE AS id FROM c, range(0, 16) AS r(pos)),
h AS (SELECT w.episode_id, pos, event_id, row_number() OVER (PARTITION BY w.episode_id, pos ORDER BY abs(k.t::DOUBLE - id), k.t DESC) AS o FROM w JOIN k ON w.episode_id = k.episode_id WHERE w.c = 1 AND k.m <> 16),
p AS (SELECT episode_id, place AS pos, event_id FROM k WHERE m = 16
      UNION ALL SELECT episode_id, pos, event_id FROM h WHERE o = 1
      UNION ALL SELECT w.episode_id, pos, event_id FROM w JOIN k ON w.episode_id = k.episode_id AND k.place = (pos * (k.m - 1)) // 15 WHERE w.c = 2 AND k.m <> 16
      UNION ALL SELECT episode_id, pos, -episode_id FROM w WHERE c = 3)"""


def _cameras(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dynamic cameras, lengths and static cameras: event_id is what a matrix is made of."""
    f = frames(spark, d)
    lengths = sequences.episode_lengths(f).filter("n_frames >= 20")
    c, t = F.col("episode_id") % 4, F.col("t")
    rows = f.join(lengths.select("episode_id"), "episode_id", "left_semi").filter((c != 3) & F.when(c == 0, t < 16).otherwise(t % 3 == 0))
    dynamic = rows.select("episode_id", t.alias("place"), F.when(c != 2, t).alias("frame_id"), F.col("event_id").cast("double").alias("x"))
    return dynamic, lengths, lengths.filter(c == 3).select("episode_id", (-F.col("episode_id")).cast("double").alias("x"))


@query("H17_camera_per_frame", f"WITH {LENGTHS}, {_CAMERAS} SELECT episode_id, pos::INTEGER AS pos, -event_id::DOUBLE AS tx FROM p")
def h17(spark: SparkSession, d: str) -> DataFrame:
    dynamic, lengths, static = _cameras(spark, d)
    ext = F.slice(geometry.pose_from_point(F.array("x", F.lit(0.0), F.lit(0.0))), 1, 12).alias("ext")
    out = sequences.camera_per_frame(dynamic.select("episode_id", "place", "frame_id", ext), lengths, "episode_id", 16, static.select("episode_id", ext))
    return out.select("episode_id", "pos", F.get("ext", F.lit(3)).alias("tx"))


@query("H17_intrinsics_per_frame", f"WITH {LENGTHS}, {_CAMERAS} SELECT episode_id, pos::INTEGER AS pos, event_id::DOUBLE AS fx, event_id::DOUBLE + 1 AS cx FROM p")
def h17_intrinsics(spark: SparkSession, d: str) -> DataFrame:
    dynamic, lengths, static = _cameras(spark, d)
    k = F.array(*(F.col("x") + v if v is not None else F.lit(0.0) for v in (0, None, 1, None, 0, 1, None, None, None))).alias("intr")
    out = sequences.camera_per_frame(dynamic.select("episode_id", "place", "frame_id", k), lengths, "episode_id", 16, static.select("episode_id", k), "intr", invert=False)
    return out.select("episode_id", "pos", F.get("intr", F.lit(0)).alias("fx"), F.get("intr", F.lit(2)).alias("cx"))


@query("C5_match_by_type", """
WITH s AS (SELECT event_type, event_id, (event_id % 97)::DOUBLE AS k, event_id % 3 = 0 AS src FROM events),
lo AS (SELECT event_type, k, min(event_id) AS lo, max(event_id) AS hi FROM s WHERE src GROUP BY ALL),
t AS (SELECT s.event_type, event_id, s.k, max(lo.k) FILTER (lo.k < s.k) AS below, min(lo.k) FILTER (lo.k >= s.k) AS above FROM s JOIN lo USING (event_type) WHERE NOT src GROUP BY ALL)
SELECT t.event_type, t.event_id, CASE WHEN above IS NOT NULL AND (below IS NULL OR above - t.k <= t.k - below) THEN a.lo ELSE b.hi END AS match_event_id
FROM t LEFT JOIN lo a ON a.event_type = t.event_type AND a.k = above LEFT JOIN lo b ON b.event_type = t.event_type AND b.k = below""")
def c5_by_type(spark: SparkSession, d: str) -> DataFrame:
    # A few groups hold all rows, and keys repeat.
    events = table(spark, d, "events").select("event_type", "event_id", (F.col("event_id") % 97).alias("k"))
    found = sequences.nearest_match(events.filter("event_id % 3 <> 0"), events.filter("event_id % 3 = 0"), "event_type", "k", ["event_id"], "event_id")
    return found.select("event_type", "event_id", "match_event_id")


@query("D1_numbers_by_type", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t FROM events")
def d1_by_type(spark: SparkSession, d: str) -> DataFrame:
    return sequences.number_frames(table(spark, d, "events").select("event_id", "event_type", "ts"), "event_type", ["ts", "event_id"]).select("event_id", "event_type", "t")
