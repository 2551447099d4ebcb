"""What has to hold for keys, runs and targets of any size: the same results when ranges, buckets and leaves are made small."""

import math
import random

import pytest
from pyspark.sql import functions as F

from framewright.functions import arrays, trees
from framewright.operators import joins, metrics, quality, ranking, scans, sequences
from framewright.plans import catalogue
from framewright.streaming import increment, outcomes

NAN = float("nan")


@pytest.fixture(params=[1_000_000, 20, 0], ids=["plain", "mixed", "ranges"])
def hot_rows(request, monkeypatch):
    monkeypatch.setattr(scans, "HOT_ROWS", request.param)
    return request.param


def episodes(seed=1):
    rng = random.Random(seed)
    return [(e, rng.randrange(50), i) for e, n in (("a", 300), ("b", 5), (None, 40), ("c", 1), ("d", 30)) for i in range(n)]


def test_numbers_of_hot_episodes(spark, hot_rows):
    rows = episodes()
    got = sequences.number_frames(spark.createDataFrame(rows, "e string, k int, i int"), "e", ["k", "i"])
    assert got.columns == ["e", "k", "i", "t"]
    want = {(e, k, i): t for e0 in {r[0] for r in rows} for t, (e, k, i) in enumerate(sorted((r for r in rows if r[0] == e0), key=lambda r: r[1:]))}
    assert {(r.e, r.k, r.i): r.t for r in got.collect()} == want


def test_hot_episodes_use_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(scans, "HOT_ROWS", 100)
    rows = scans.in_ranges(spark.range(20_000).select(F.lit("e").alias("e"), F.col("id").alias("k")), "e", ["k"])
    sizes = [r["count"] for r in rows.groupBy("__range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 20_000 / 2


def test_more_hot_keys_than_are_named(spark, monkeypatch):
    monkeypatch.setattr(scans, "HOT_ROWS", 3)
    monkeypatch.setattr(scans, "NAMED_KEYS", 2)
    got = sequences.number_frames(spark.range(60).select((F.col("id") % 6).alias("e"), "id"), "e", ["id"])
    assert {(r.e, r.id, r.t) for r in got.collect()} == {(i % 6, i, i // 6) for i in range(60)}


def test_nearest_match_in_ranges(spark, hot_rows):
    rng = random.Random(2)
    sources = [(e, float(rng.randrange(60)), i, f"{e}{i}") for i, e in enumerate(["a"] * 120 + ["b"] * 3 + [None] * 30)]
    targets = [(e, rng.uniform(-5, 70) if i % 3 else float(rng.randrange(60)), i) for i, e in enumerate(["a"] * 200 + ["b"] * 10 + [None] * 20 + ["none"] * 3)]
    found = sequences.nearest_match(spark.createDataFrame(targets, "e string, k double, n long"), spark.createDataFrame(sources, "e string, k double, i long, v string"), "e", "k", ["v"], "i")
    want = {}
    for e, k, n in targets:
        own = [s for s in sources if s[0] == e]
        if own:
            # The nearest key, the later one of two; its first row from below or on it, its last from above.
            key = min({s[1] for s in own}, key=lambda x: (abs(x - k), -x))
            rows = sorted((s[2], s[3]) for s in own if s[1] == key)
            want[n] = rows[-1][1] if key < k else rows[0][1]
    assert {r.n: r.match_v for r in found.collect()} == want


def test_best_of_runs(spark, hot_rows):
    rng = random.Random(3)
    rows = [(run, i, rng.choice([NAN, None, 0.5, *(rng.random() for _ in range(3))])) for run, n in (("a", 150), ("b", 1), (None, 40), ("c", 3)) for i in range(n)]
    got = sequences.select_best(spark.createDataFrame(rows, "run string, epoch int, val double"), "epoch", "val", by="run").collect()
    for run in {r[0] for r in rows}:
        low, last, improved = math.inf, None, set()
        for _, epoch, val in (r for r in rows if r[0] == run):
            if val is not None and val < low:
                low, last = val, epoch
                improved.add(epoch)
        own = [r for r in got if r.run == run]
        assert {r.epoch for r in own if r.improved} == improved and {r.epoch for r in own if r.chosen} == ({last} - {None})


def test_frame_times_and_logs_in_ranges(spark, hot_rows):
    rows = [(e, i, (i if e != "c" or i != 7 else 3) * 0.5) for e, n in (("a", 101), ("b", 2), ("c", 30), ("d", 1)) for i in range(n)]
    df = spark.createDataFrame([*rows, *(("flat", i, 4.0) for i in range(40))], "e string, i int, s double")
    got = {(r.e, r.i): r for r in sequences.frame_times(df, "e", ["i"], F.col("s"), F.col("s"), 10.0).collect()}
    assert len(got) == 174 and got["a", 7].centre == 3.5 and got["a", 0].boundary == 24.75 and got["a", 0].reason is None
    assert all(got["c", i].reason == "times are not finite and rising" for i in range(30))
    assert got["flat", 9].centre == pytest.approx(0.9) and got["flat", 0].reason is None and got["d", 0].centre == 0.0
    logs = {r.e: (r.rising, r.last_epoch) for r in sequences.audit_epoch_log(df.withColumn("epoch", F.when((F.col("e") == "c") & (F.col("i") == 7), 2).otherwise(F.col("i") + 1)), "e", "epoch", "i").collect()}
    assert logs == {"a": (True, 101), "b": (True, 2), "c": (False, 30), "d": (True, 1), "flat": (True, 40)}


def test_camera_branches(spark):
    m = lambda x: [1.0, 0.0, 0.0, x, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    rows = [("same", i, 5, m(float(i))) for i in range(4)] + [("ids", i, 10 * i, m(10.0 * i)) for i in range(9)] + [("even", i, None, m(float(i))) for i in range(9)] + [("unknown", i, 100 + 10 * i, m(float(i))) for i in range(3)] + [("one", 0, None, m(7.0))] + [("some", i, None if i else 3, m(float(i))) for i in range(2)]
    lengths = spark.createDataFrame([("same", 99), ("ids", 81), ("even", 81), ("one", 50), ("static", 50), ("some", 9)], "e string, n_frames long")
    static = spark.createDataFrame([("static", m(5.0)), ("ids", m(99.0))], "e string, ext array<double>")
    cameras = spark.createDataFrame(rows, "e string, place int, frame_id long, ext array<double>")
    found = sequences.camera_per_frame(cameras, lengths, "e", 4, static)
    got = {}
    for r in found.collect():
        got.setdefault(r.e, {})[r.pos] = -r.ext[3]
    at = lambda *v: dict(enumerate(map(float, v)))
    # Ids 0, 26.67, 53.33, 80; places 0, 2, 5, 8; ids 100, 106.67, 113.33, 120.
    assert got == {"same": at(0, 1, 2, 3), "ids": at(0, 30, 50, 80), "even": at(0, 2, 5, 8), "unknown": at(0, 1, 1, 2), "one": at(7, 7, 7, 7), "static": at(5, 5, 5, 5), "some": at(0, 0, 0, 1)}
    plain = sequences.camera_per_frame(cameras, lengths, "e", 4, static, invert=False)
    assert {tuple(r.ext) for r in plain.filter("e = 'same'").collect()} == {tuple(m(float(i))) for i in range(4)}


def test_group_split_by_brute_force(spark):
    from hashlib import sha256

    rng = random.Random(4)
    for ratio, seed in ((0.5, 1), (0.9, 2), (0.02, 3), (0.999, 4)):
        sizes = {f"g{k}": rng.choice([1, 1, 2, 30]) for k in range(40)} | {None: 3}
        df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
        got = {r.g: r.split for r in ranking.group_split(df, "g", ratio, seed).distinct().collect()}
        order = sorted(sizes, key=lambda g: "" if g is None else sha256(f"{seed}:{g}".encode()).hexdigest())
        total = sum(sizes.values())
        target = max(1, min(int(total * ratio), total - 1))
        cuts = [sum(sizes[g] for g in order[: k + 1]) for k in range(len(order) - 1)]
        best = min(range(len(cuts)), key=lambda k: (abs(cuts[k] - target), k))
        assert got == {g: "train" if k <= best else "test" for k, g in enumerate(order)}


@pytest.mark.parametrize("rows", [1, 7, 1000])
def test_number_buckets_grow_with_the_table(spark, monkeypatch, rows):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", rows)
    rng = random.Random(5)
    keys = sorted({int(rng.paretovariate(0.4)) % 10**9 for _ in range(600)} | set(range(-200, 0)))
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = ranking.global_rank(df, [F.col("k")], ranking.number_bucket(df, "k", 16)).collect()
    assert [r.k for r in sorted(got, key=lambda r: r.position)] == keys and sorted(r.position for r in got) == list(range(len(keys)))
    if rows == 1:
        assert df.select(ranking.number_bucket(df, "k", 16).alias("b")).distinct().count() > 100


def test_reconcile_in_one_pass(spark):
    left, right = spark.createDataFrame([(k,) for k in [*range(100), *range(50), None]], "k long"), spark.createDataFrame([(k,) for k in [*range(30, 103), None]], "k long")
    found = joins.reconcile(left, right, "k", 5)
    assert sorted(map(tuple, found.collect())) == [("left", k, 30) for k in range(5)] + [("right", k, 3) for k in (100, 101, 102)]
    assert joins.reconcile(left, left, "k").count() == 0
    assert found._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0


def test_tree_of_digests(spark):
    rows = spark.range(3000).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    tree = metrics.digest_tree(rows, F.col("line"), 2)
    again = metrics.digest_tree(rows.union(rows).repartition(13), F.col("line"), 2)
    nodes = lambda t: {(r.level, r.prefix, r.digest, r.n) for r in t.collect()}
    assert nodes(tree) == nodes(again) and len(nodes(tree)) == 256 + 16 + 1
    now = rows.filter("line <> 'line 7'").union(spark.createDataFrame([("new",)], "line string"))
    changed = spark.createDataFrame([("line 7",), ("new",)], "line string")
    updated = metrics.update_tree(tree.cache(), now, F.col("line"), changed, F.col("line"), 2).cache()
    assert nodes(updated.drop("rehashed")) == nodes(metrics.digest_tree(now, F.col("line"), 2)) != nodes(tree)
    assert 3 <= updated.filter("rehashed").count() <= 5
    few = spark.createDataFrame([("a",), ("b",)], "line string")
    gone = metrics.update_tree(metrics.digest_tree(few, F.col("line"), 2).cache(), few.filter("line = 'a'"), F.col("line"), few.filter("line = 'b'"), F.col("line"), 2)
    assert nodes(gone.drop("rehashed")) == nodes(metrics.digest_tree(few.filter("line = 'a'"), F.col("line"), 2))
    assert metrics.digest_of_set(few.limit(0), F.col("line"), "tree").first().n == 0


def test_identities_by_trees(spark):
    pairs = spark.createDataFrame([("x", "train", "f1"), ("y", "test", "f2")], "hdf5_sha256 string, split string, feature_relpath string")
    found = {r["name"]: r for r in quality.audit_identities(pairs, {}, "tree").collect()}
    assert found["train"].found == metrics.digest_of_set(pairs.limit(1), F.col("feature_relpath"), "tree").first().digest and not found["content"].ok


# Nested records


def test_walk(spark):
    text = '{"a":{"b":["x",1,null,true,2.50,{}]},"d.e":"z","l":[]}'
    df = spark.createDataFrame([(1, text), (2, '"s"'), (3, "broken{"), (4, None)], "k int, j string").withColumn("path", F.lit("kept?")).drop("path")
    got = {(r.k, r.path): (r.kind, r.value, r.parent) for r in trees.walk(df, "j").collect()}
    assert got == {
        (1, "$"): ("object", None, None), (1, "$.a"): ("object", None, "$"), (1, "$.a.b"): ("array", None, "$.a"), (1, "$.a.b[0]"): ("string", "x", "$.a.b"), (1, "$.a.b[1]"): ("number", "1", "$.a.b"), (1, "$.a.b[2]"): ("null", None, "$.a.b"),
        (1, "$.a.b[3]"): ("boolean", "true", "$.a.b"), (1, "$.a.b[4]"): ("number", "2.5", "$.a.b"), (1, "$.a.b[5]"): ("object", None, "$.a.b"), (1, "$.d.e"): ("string", "z", "$"), (1, "$.l"): ("array", None, "$"), (2, "$"): ("string", "s", None), (3, "$"): ("invalid", None, None), (4, "$"): ("invalid", None, None),
    }


def test_deep_trees_are_an_error(spark):
    df = spark.createDataFrame([(1, '{"a":' * 4 + "1" + "}" * 4)], "k int, j string")
    assert trees.walk(df, "j", depth=4).count() == 5
    with pytest.raises(Exception, match="more than 3 levels"):
        trees.walk(df, "j", depth=3).collect()


def test_records_that_differ(spark):
    a = '{"v":1,"w":"1","deep":{"x":{"y":1,"z":2}},"list":[1,2]}'
    cases = {1: (a, a, []), 2: (a, a.replace('"v":1', '"v":"1"'), [("$.v", "kind")]), 3: (a, a.replace('"v":1', '"v":1.0'), []), 4: (a, a.replace("[1,2]", "[1,3,4]"), [("$.list[1]", "value"), ("$.list[2]", "extra")]), 5: (a, a.replace('{"y":1,"z":2}', "null"), [("$.deep.x", "kind")]), 6: (a, '{"v":1,"w":"1","list":[1,2]}', [("$.deep", "missing")]), 7: (a, None, [("$", "missing")]), 8: (None, a, [("$", "extra")]), 9: ("x{", a, [("$", "kind")])}
    side = lambda i: spark.createDataFrame([(k, c[i]) for k, c in cases.items() if c[i] is not None], "k int, record string")
    got = sorted((r.k, r.path, r.difference) for r in quality.compare_records(side(0), side(1), "k").collect())
    assert got == sorted((k, *d) for k, c in cases.items() for d in c[2])


# Runs and streams

ROW = "id long, v long, at long"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), ROW)


def files(spark, target):
    return {r[0] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(target)).select("path").collect()}


def newest(spark, target):
    return {(r.id, r.v, r.version) for r in increment.published(spark, str(target), "id", spark.createDataFrame([], ROW).schema).collect()}


def test_batches_are_transactions(spark, tmp_path):
    rules = {"negative": F.col("v") < 0}
    publish = lambda n, *rows, **more: increment.publish_batch(batch(spark, *rows), n, str(tmp_path / "t"), "id", rules, ["at"], stream="s", **more)
    assert newest(spark, tmp_path / "t") == set()
    # The last by ``at`` counts; no key and a broken rule are rejected.
    assert publish(0, (1, 1, 1), (1, 9, 3), (1, 5, 2), (2, -1, 0), (None, 4, 0), (None, 4, 0)) == outcomes.Outcome(saved=1, failed=3)
    assert newest(spark, tmp_path / "t") == {(1, 9, 1)}
    assert publish(1, (1, 9, 3), (2, 7, 0), (3, 3, 3)) == outcomes.Outcome(saved=2, skipped=1)
    before = files(spark, tmp_path)
    assert publish(1, (8, 8, 8)) == outcomes.Outcome(saved=2, skipped=1) and files(spark, tmp_path) == before
    # A changed row that fails leaves the version that is there.
    assert publish(2, (1, -9, 4), (3, 4, 3)) == outcomes.Outcome(rebuilt=1, failed=1)
    assert newest(spark, tmp_path / "t") == {(1, 9, 1), (2, 7, 1), (3, 4, 2)}
    log = sorted(((r.id, r.v, r.reasons, r.batch) for r in increment.rejected(spark, str(tmp_path / "t"), ROW).collect()), key=repr)
    assert log == sorted([(2, -1, ["negative"], 0), (None, 4, ["no key"], 0), (None, 4, ["no key"], 0), (1, -9, ["negative"], 2)], key=repr)
    total = increment.run_outcome(spark, str(tmp_path / "t"))
    assert total == outcomes.Outcome(saved=3, skipped=1, rebuilt=1, failed=4) and total.exit_code == 1
    with pytest.raises(RuntimeError):
        total.check()
    # Another stream goes on where this one stopped.
    assert increment.publish_batch(batch(spark, (3, 4, 3), (4, 4, 4)), 0, str(tmp_path / "t"), "id", stream="other") == outcomes.Outcome(saved=1, skipped=1)
    assert increment.publish_batch(batch(spark), 1, str(tmp_path / "t"), "id", stream="other") == outcomes.Outcome()


def test_an_attempt_without_a_manifest_is_not_there(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    increment.publish_batch(batch(spark, (1, 1, 1)), 0, target, "id")
    with monkeypatch.context() as m:
        m.setattr(increment, "outcome_of", lambda rows: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            increment.publish_batch(batch(spark, (1, 2, 2), (2, 2, 2)), 1, target, "id")
    assert newest(spark, target) == {(1, 1, 1)}
    (tmp_path / "t" / "commits" / "stream=" / "batch=1" / "_temporary" / "0").mkdir(parents=True)
    assert increment.publish_batch(batch(spark, (1, 2, 2), (2, 2, 2)), 1, target, "id") == outcomes.Outcome(saved=1, rebuilt=1)
    assert newest(spark, target) == {(1, 2, 2), (2, 2, 1)}


def test_staged_rows_are_judged_again(spark, tmp_path):
    odd = {"flips": F.rand() < 2 * (F.input_file_name() != "").cast("int")}  # fails only when read back
    with pytest.raises(ValueError, match="staged rows fail"):
        increment.publish_batch(batch(spark, (1, 1, 1)), 0, str(tmp_path / "t"), "id", odd)
    assert newest(spark, tmp_path / "t") == set()


def test_a_batch_reads_its_buckets_only(spark, tmp_path, monkeypatch):
    """Indexes are merged, buckets grow with the keys, and what a small batch reads doesn't."""
    monkeypatch.setattr(increment, "BUCKET_KEYS", 20)
    monkeypatch.setattr(increment, "BUCKETS", 2)
    monkeypatch.setattr(increment, "MERGE_AFTER", 2)
    target, read = str(tmp_path / "t"), {}
    find = increment._buckets_of

    def counted(spark, index, keys, kind):
        rows = find(spark, index, keys, kind)
        read[n] = read.get(n, 0) + rows.select(F.input_file_name()).distinct().count()
        return rows

    monkeypatch.setattr(increment, "_buckets_of", counted)
    for n in range(8):
        rows = [(100 * n + k, k, 0) for k in range(100)] if n % 2 == 0 else [(5, n, 0)]
        increment.publish_batch(batch(spark, *rows), n, target, "id")
    last = increment.manifests(spark, target).orderBy(F.desc("number")).first()
    assert len(last.indexes) <= 3 and max(x.buckets for x in last.indexes) >= 10
    assert read[7] <= 3 < sum(x.buckets for x in last.indexes)
    assert newest(spark, target) == {(100 * n + k, k, 1) for n in (0, 2, 4, 6) for k in range(100) if (n, k) != (0, 5)} | {(5, 7, 5)}


def test_runs_go_on_after_failures(spark, tmp_path):
    plan = spark.createDataFrame([(1, "build", None), (2, "skip", None), (3, "rebuild", "size changed"), (4, "build", None), (5, "build", None)], "id long, status string, reason string")
    tried = []

    def build(row):
        tried.append(row["id"])
        if row["id"] == 4 or row["id"] == 5 and tried.count(5) < 2:
            raise KeyError("/data/root/x")
        return {"twice": 2 * row["id"]}

    outcome = outcomes.run_plan(plan, build, "twice long", f"{tmp_path}/run", "/data/root", attempts=2)
    assert outcome == outcomes.Outcome(saved=2, skipped=1, rebuilt=1, failed=1) and outcome.exit_code == 1
    rows = {r.id: (r.outcome, r.tries, r.built and r.built.twice) for r in spark.read.parquet(f"{tmp_path}/run/rows").collect()}
    assert rows == {1: ("saved", 1, 2), 2: ("skipped", 0, None), 3: ("rebuilt", 1, 6), 4: ("failed", 2, None), 5: ("saved", 2, 10)}
    log = spark.read.json(f"{tmp_path}/run/failures").collect()
    assert [(r.id, r.message) for r in log] == [(4, "KeyError: '<DATASET_ROOT>/x'")] and "Traceback" in log[0].trace
    assert outcomes.run_plan(plan.filter("status = 'skip'"), build, "twice long", f"{tmp_path}/again").exit_code == 0


# Work of one row


def test_padding_splits_a_text_once(spark):
    """The split isn't worked out again for each element of the mask."""
    plan = catalogue.QUERIES["H10_pad_lossless"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    df = spark.createDataFrame([(None,), ([1, 2],), ([1, 2, 3, 4],)], "a array<int>").select(arrays.pad_lossless(F.col("a"), 3, F.lit(0)).alias("p"))
    assert [r.p and (r.p["values"], r.p.mask, r.p.length) for r in df.collect()] == [([0, 0, 0], [False] * 3, 0), ([1, 2, 0], [True, True, False], 2), None]


def test_camera_frames_are_compiled(spark):
    """No generated method is larger than 8,000 bytes, beyond which the JVM interprets it."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = catalogue.QUERIES["C7_to_camera_frame"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().debug().codegenToSeq()
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) <= 8000


def test_records_meet_once(spark):
    """Both records of a key meet in one join, and places are made rows only where they differ."""
    plan = catalogue.QUERIES["I4_compare_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Generate ") == 1
