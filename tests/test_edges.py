"""Edge rows that the tables don't have."""

import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import arrays, geometry, paths
from framewright.operators import joins, metrics, quality, ranking, sequences
from framewright.sources import files
from framewright.streaming import increment


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()["v"]


@pytest.mark.parametrize("t", [2, 3, 63, 64, 65, 1000])
def test_midpoint_samples(spark, t):
    got = one(spark, arrays.midpoint_samples(F.lit(t).cast("long")))
    m = t // 2
    assert got["past"] == np.floor(np.linspace(0, m - 1, 32) + 1e-9).astype(int).tolist()
    assert got["target"] == np.floor(np.linspace(m, t - 1, 32) + 1e-9).astype(int).tolist()
    assert not {*got["past"]} & {*got["target"]}


def test_midpoint_rejects_short(spark):
    assert one(spark, arrays.midpoint_samples(F.lit(1).cast("long"))) is None


def test_nearest_match_ties_and_ends(spark):
    s = spark.createDataFrame([("a", 10.0, 1, "x"), ("a", 20.0, 2, "y"), ("a", 20.0, 3, "z")], "e string, k double, i long, v string")
    t = spark.createDataFrame([("a", k) for k in (1.0, 10.0, 14.0, 15.0, 99.0)], "e string, k double")
    got = {r.k: r.match_v for r in sequences.nearest_match(t, s, "e", "k", ["v"], "i").collect()}
    assert got == {1.0: "x", 10.0: "x", 14.0: "x", 15.0: "y", 99.0: "z"}
    assert sequences.nearest_match(t, s.limit(0), "e", "k", ["v"], "i").count() == 0


def test_unsafe_paths(spark):
    rows = ["/a/b.npz", "../b.npz", "a\\b.npz", "a/./b.mp4", "a/b.mp4\0x", "", "a//b.npz", "a/b.txt", "a/b.npz"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    assert [r[0] for r in df.select(paths.unsafe_reason(F.col("p"), ".npz")).collect()] == ["absolute", "dots", "backslash", "dots", "nul", "empty", "not canonical", "suffix", None]


def test_group_split_edges(spark):
    two = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 9)], "g string, i long")
    for seed in range(4):
        split = {r.g: r.split for r in ranking.group_split(two, "g", 0.9, seed).collect()}
        assert set(split.values()) == {"train", "test"}
    with pytest.raises(ValueError):
        ranking.group_split(two.filter("g = 'a'"), "g", 0.9, 0)


@pytest.mark.parametrize("n", [0, 1, 5, 10])
def test_balanced_subset_is_exact_and_stable(spark, n):
    df = spark.createDataFrame([("abc"[i % 3 if i < 6 else 0], i) for i in range(10)], "g string, i long")
    a = {r.i for r in ranking.group_balanced_subset(df, "g", "i", n, 1).collect()}
    b = {r.i for r in ranking.group_balanced_subset(df.repartition(7).orderBy(F.desc("i")), "g", "i", n, 1).collect()}
    assert len(a) == n and a == b


def test_balanced_subset_rejects_too_many(spark):
    with pytest.raises(ValueError):
        ranking.group_balanced_subset(spark.range(3).withColumn("g", F.lit("a")), "g", "id", 4, 0)


@pytest.mark.parametrize("total, bounds, want", [(0, None, (0, 0)), (1, None, (1, 1)), (10, None, (9, 10)), (10, (0.5, 0.5, 1), (5, 10)), (10, (0, 0, 0), (9, 10)), (10, (3, 7, 0), (3, 7)), (2, (2, 2, 2), (1, 2))])
def test_split_bounds(total, bounds, want):
    assert ranking.split_bounds(total, bounds) == want


def test_poses(spark):
    rng = np.random.default_rng(0)
    rows = [(list(map(float, np.vstack([rng.normal(size=(3, 4)), [0, 0, 0, 1]]).ravel())),) for _ in range(20)]
    df = spark.createDataFrame(rows, "m array<double>")
    got = df.select("m", geometry.let(F.col("m"), geometry.affine_inverse).alias("i")).collect()
    for r in got:
        assert np.allclose(np.array(r.m).reshape(4, 4) @ np.array(r.i).reshape(4, 4), np.eye(4), atol=1e-8)
    assert one(spark, geometry.affine_inverse(F.array(*(F.lit(0.0),) * 16))) is None
    assert one(spark, geometry.as_4x4(F.array(*(F.lit(1.0),) * 9))) is None


def test_projection_depth(spark):
    k = F.array(*(F.lit(float(v)) for v in (2, 0, 1, 0, 2, 1, 0, 0, 1)))
    uv = lambda z: one(spark, geometry.project_pinhole(F.array(F.lit(1.0), F.lit(1.0), F.lit(z)), k))
    assert uv(2.0) == [2.0, 2.0] and uv(-2.0) == [0.0, 0.0]
    assert all(math.isnan(x) for z in (0.0, 1e-7, -1e-7) for x in uv(z))


@pytest.mark.parametrize("ids, kw, want", [
    ([1, 5, 1, 5, 2, 5, 2, 5], {"starts": [1], "ends": [2]}, [1, 1, 1, 1, 1, 1, 1, 0]),
    ([2, 5, 1], {"starts": [1], "ends": [2]}, [0, 0, 1]),
    ([3, 5], {"starts": [3], "ends": [3]}, [1, 0]),
    ([5, 2, 5], {"ends": [2], "opened": True}, [1, 1, 0]),
    ([1, -1, 2], {"starts": [1], "ends": [2]}, [1, 0, 1]),
    ([7, 8, 9], {"drops": [8], "prefix": 1}, [1, 1, 0]),
    ([], {"starts": [1], "ends": [2]}, []),
])
def test_span_mask(spark, ids, kw, want):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    assert df.select(arrays.span_drop_mask(F.col("ids"), **kw)).first()[0] == [bool(x) for x in want]


def test_padding(spark):
    pad = lambda ids: spark.createDataFrame([(ids,)], "a array<int>").select(arrays.pad_lossless(F.col("a"), 3, F.lit(-1)).alias("p")).first()["p"]
    assert pad([4]).asDict() == {"values": [4, -1, -1], "mask": [True, False, False], "length": 1}
    assert pad([]).asDict()["length"] == 0 and pad([1, 2, 3]).asDict()["values"] == [1, 2, 3]
    assert pad([1, 2, 3, 4]) is None


def test_select_best(spark):
    log = lambda values: spark.createDataFrame(list(enumerate(values, 1)), "epoch long, val double")
    chosen = lambda values, policy="best": [r.epoch for r in sequences.select_best(log(values), "epoch", "val", policy).filter("chosen").collect()]
    nan = float("nan")
    assert chosen([3.0, 2.0, 2.0, 5.0]) == [2] and chosen([nan, 4.0]) == [2] and chosen([nan, nan]) == []
    assert chosen([1.0, 2.0], "last") == [2]
    with pytest.raises(ValueError):
        chosen([1.0], "worst")


def test_weighted_mean_without_weight(spark):
    assert spark.range(3).agg(metrics.global_mean(F.col("id"), F.lit(0))).first()[0] is None


def test_forecast_never_looks_ahead(spark):
    rows = [("e", t, float(t), 0.0) for t in range(64)]
    frame = lambda change: spark.createDataFrame([(e, t, x + (change if t >= 32 else 0), y) for e, t, x, y in rows], "episode_id string, t long, x double, y double")
    held = lambda df: {r.held_x for r in sequences.persistence_forecast(df).collect()}
    assert held(frame(0)) == held(frame(1000)) == {31.0}


def test_manifests(spark, tmp_path):
    text = "# c\n\n a/b.mp4\n{\"path\": \"c.mp4\"}\n{broken\nfile:///d.mp4\n"
    (tmp_path / "m.txt").write_text(text)
    rows = files.read_manifest(spark, str(tmp_path / "m.txt"), ".mp4").collect()
    assert {(r.path, r.reason) for r in rows} == {("a/b.mp4", None), ("c.mp4", None), ("{broken", "suffix"), ("/d.mp4", None)}
    (tmp_path / "j.json").write_text('["x.mp4", {"mp4": "y.mp4"}, "z.txt"]')
    assert {r.path for r in files.read_manifest(spark, str(tmp_path / "j.json"), ".mp4", strict=False).collect()} == {"x.mp4", "y.mp4"}
    (tmp_path / "d.txt").write_text("a.mp4\na.mp4\n")
    with pytest.raises(ValueError):
        files.read_manifest(spark, str(tmp_path / "d.txt"), ".mp4")


def test_archives_and_inventory(spark, tmp_path):
    out = io.BytesIO()
    np.savez(out, v=np.arange(12, dtype=np.float32).reshape(2, 2, 3), w_bf16=np.array([[0x3F80]], np.uint16), s=np.array("héllo"), bad=np.array([[np.nan]]))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "e1.npz").write_bytes(out.getvalue())
    (tmp_path / "a" / ".hidden.npz").write_bytes(b"x")
    listed = files.file_inventory(spark, str(tmp_path), ".npz").collect()
    assert [(r.relpath, r.stem) for r in listed] == [("a/e1.npz", "a/e1")]
    meta = {r["name"]: r for r in files.load_feature_archives(spark, str(tmp_path / "a" / "e1.npz")).collect()}
    assert meta["s"].text == "héllo" and meta["v"]["shape"] == [2, 2, 3] and not meta["bad"].finite
    long = files.load_feature_archives(spark, str(tmp_path / "a" / "e1.npz"), tensors=True).collect()
    assert {tuple(r["index"]): list(r.vec) for r in long if r["name"] == "v"}[1, 0] == [6.0, 7.0, 8.0]
    assert [list(r.vec) for r in long if r["name"] == "w_bf16"] == [[1.0]]


def test_tampered_pair_is_caught(spark):
    pair = ("s/1", "train", "feat/s/1.npz", "sup/s/1.h5", "0" * 64, 10)
    pairs = lambda p: spark.createDataFrame([p], "sample_id string, split string, feature_relpath string, supervision_relpath string, digest string, size long")
    inventory = spark.createDataFrame([("sup/s/1.h5", 10)], "relpath string, size long")
    assert quality.audit_pairs(pairs(pair), inventory, {"train": 1}).filter("size(reasons) > 0").isEmpty()
    with pytest.raises(ValueError):
        quality.audit_pairs(pairs((*pair[:4], "0" * 63 + "G", 10)), inventory, {"train": 1}, strict=True)


def test_stack_of_nothing_and_split_overlap(spark):
    df, empty = spark.range(2), spark.createDataFrame([], "id long, v array<float>")
    assert joins.stack_with_fill(df, empty, "id", "v", 3).count() == 0
    with pytest.raises(ValueError):
        joins.attach_split(df, spark.createDataFrame([(0, "train"), (0, "test")], "id long, split string"), "id")


def test_publish_keeps_target(spark, tmp_path):
    rules = {"negative": F.col("id") < 0}
    assert files.publish_if_valid(spark.range(3), rules, f"{tmp_path}/a", f"{tmp_path}/t")
    assert not files.publish_if_valid(spark.range(-1, 3), rules, f"{tmp_path}/b", f"{tmp_path}/u")
    assert not files.publish_if_valid(spark.range(9), rules, f"{tmp_path}/c", f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 3


def test_stream_replay_adds_nothing(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    for log in ("x", "x", "y"):
        increment.stream_increment(spark, f"{tmp_path}/in", "id long", f"{tmp_path}/out", f"{tmp_path}/{log}", "id").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/staged").filter("outcome = 'saved'").count() == 10


def test_stream_rebuilds_what_changed_and_leaves_out_what_fails(spark, tmp_path):
    rules = {"negative": F.col("v") < 0}
    step = lambda: increment.stream_increment(spark, f"{tmp_path}/in", "id long, v long", f"{tmp_path}/out", f"{tmp_path}/log", "id", rules).awaitTermination()
    for rows in ([(1, 1), (2, -1)], [(1, 1), (2, 5)], [(1, 7)]):
        spark.createDataFrame(rows, "id long, v long").write.mode("append").parquet(f"{tmp_path}/in")
        step()
    found = increment.published(spark, f"{tmp_path}/out", "id", spark.createDataFrame([], "id long, v long").schema)
    assert sorted((r.id, r.v, r.version) for r in found.collect()) == [(1, 7, 2), (2, 5, 1)]
    assert spark.read.parquet(f"{tmp_path}/out/staged").filter("outcome in ('saved', 'rebuilt')").count() == 3


def test_lookup_in_a_stem_of_many_folders(spark):
    index = spark.createDataFrame([(f"d{k}", "s", f"p{k % 3}", f"x{k:03}") for k in range(200)] + [("d1", None, None, "y")], "rel_dir string, stem string, parent string, path string")
    wanted = spark.createDataFrame([(1, "s", "p2", ["none", "d7"]), (2, "s", "p2", ["none"]), (3, "s", None, []), (4, "t", "p1", ["d1"]), (5, None, None, ["d1"])], "id int, name string, folder string, dirs array<string>")
    got = {r.id: r.path for r in joins.priority_lookup(wanted, index, "dirs", "name", "folder").collect()}
    assert got == {1: "x007", 2: "x002", 3: "x000", 4: None, 5: None}


def test_digest_method_is_the_callers(spark):
    rows = spark.range(5)
    line = F.col("id").cast("string")
    exact, additive = (metrics.digest_of_set(rows, line, m).first() for m in ("exact", "additive"))
    assert exact.n == additive.n == 5 and exact.digest != additive.digest and (exact.method, additive.method) == ("exact", "additive")
    with pytest.raises(ValueError):
        metrics.digest_of_set(rows, line, "auto")


@pytest.mark.parametrize("n", [0, 1, 7, 12, 13, 30])
def test_rounds_from_the_histogram(spark, n):
    sizes = {"a": 1, "b": 2, "c": 2, "d": 10, "e": 15}
    df = spark.createDataFrame([(g, k) for g, m in sizes.items() for k in range(m)], "g string, k int")
    got = {r.g: r["count"] for r in ranking.group_balanced_subset(df, "g", "k", n, 1).groupBy("g").count().collect()}
    low = max(k for k in range(17) if sum(min(k, m) for m in sizes.values()) <= n)
    assert sum(got.values()) == n and all(min(low, m) <= got.get(g, 0) <= min(low + 1, m) for g, m in sizes.items())


def test_nearest_match_grows_with_the_rows(spark):
    """No frame of a row reaches over all rows after it."""
    f = spark.range(10).select(F.lit("e").alias("e"), F.col("id").alias("t"), F.col("id").alias("v"))
    plan = sequences.nearest_match(f, f, "e", "t", ["v"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()
