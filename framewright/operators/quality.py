"""Rules that say for each row what is wrong with it.

A rule is a condition of failure with its reason. Rows get ``reasons``, empty
if all is well; ``strict`` makes a table with any reason an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import arrays, digests, geometry, paths, trees
from framewright.operators import metrics


def with_reasons(df: DataFrame, rules: dict[str, Column], strict: bool = False) -> DataFrame:
    """``df`` with reasons; a condition that is null counts as failed. Reasons that are there stay in front."""
    failed = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(r)) for r, c in rules.items())))
    out = df.withColumn("reasons", F.concat("reasons", failed) if "reasons" in df.columns else failed)
    if strict and (row := out.filter(F.size("reasons") > 0).first()):
        raise ValueError(f"{row['reasons']}: {row}")
    return out


#: What a feature archive has to state.
CONTRACT = {"schema_version": 2, "policy": "observed_past_exact_frames", "sampling": "raw_index_midpoint_disjoint_uniform_v3"}


def feature_rules(expected: dict[str, object] | None = None, forbidden: tuple[str, ...] = (), names: str = "tensor_names", n: int = 32) -> dict[str, Column]:
    """The rules of a feature archive's row.

    Columns: those of ``expected``; tensor_names; total_frames; past_ids and
    target_ids, and branch_ids (arrays that have to equal past_ids); layers;
    shapes and dtypes by tensor name (maps) with finite flags; n_tokens and
    n_states; source_size, source_mtime and what they are now.
    """
    c = F.col
    ideal = arrays.midpoint_samples(c("total_frames"), n)
    rising = lambda a: F.forall(F.sequence(F.lit(0), F.size(a) - 2), lambda i: F.get(a, i) <= F.get(a, i + 1))
    inside = lambda a: F.forall(a, lambda x: (x >= 0) & (x < c("total_frames")))
    rules = {f"{k} differs": ~c(k).eqNullSafe(F.lit(v)) for k, v in (CONTRACT if expected is None else expected).items()}
    rules |= {"forbidden key": F.arrays_overlap(c(names), F.array(*(F.lit(k) for k in forbidden)))} if forbidden else {}
    return rules | {
        "number of ids": (F.size("past_ids") != n) | (F.size("target_ids") != n),
        "ids are not the midpoint samples": ~(c("past_ids").eqNullSafe(ideal["past"]) & c("target_ids").eqNullSafe(ideal["target"])),
        "halves overlap": F.arrays_overlap("past_ids", "target_ids"),
        "ids are not in order": ~(rising(c("past_ids")) & rising(c("target_ids"))),
        "ids out of bounds": ~(inside(c("past_ids")) & inside(c("target_ids"))),
        "branches disagree": F.exists("branch_ids", lambda b: b != c("past_ids")),
        "no layers": F.size("layers") < 1,
        "not finite": F.exists(F.map_values("finite"), lambda x: ~x),
        "tokens are not states + 1": c("n_tokens") != c("n_states") + 1,
        "source changed": ~(c("source_size").eqNullSafe(c("now_size")) & c("source_mtime").eqNullSafe(c("now_mtime"))),
    }


def shape_rule(name: str, shape: list[int], dtype: str) -> dict[str, Column]:
    """Shape and type of one tensor."""
    return {f"{name} has another shape": ~F.get(F.array(F.col("shapes")[name]), F.lit(0)).eqNullSafe(F.array(*(F.lit(s) for s in shape))), f"{name} has another type": ~F.col("dtypes")[name].eqNullSafe(F.lit(dtype))}


def archive_rules(required: tuple[str, ...], prefixes: tuple[str, ...], configuration: dict[str, str], shapes: dict[str, tuple[list[int], str]], names: str = "tensor_names") -> dict[str, Column]:
    """What an archive says of itself and where it is.

    Columns: ``names``; configuration_json, configuration_fingerprint and
    cache_config_fingerprint; split_raw_index and total_frames;
    source_video_relpath and archive_path; layers; shapes and dtypes (maps by
    tensor name). ``configuration`` has the values expected at JSON paths.
    """
    c, stated = F.col, F.col("configuration_json")
    source = c("source_video_relpath")
    archive = F.concat(paths.without_suffix(source), F.lit(".npz"))
    rules = {
        "required key is missing": F.size(F.array_except(F.array(*(F.lit(k) for k in required)), c(names))) > 0,
        "forbidden prefix": F.exists(names, lambda k: F.greatest(F.lit(False), *(k.startswith(p) for p in prefixes), F.lit(False))),
        "fingerprint differs": ~(paths.is_sha256(c("configuration_fingerprint")) & (c("configuration_fingerprint") == c("cache_config_fingerprint")) & (c("configuration_fingerprint") == F.sha2(stated, 256))),
        "split is not the midpoint": c("split_raw_index") != F.floor(c("total_frames") / 2),
        "unsafe source path": ~(paths.is_safe_relpath(source) & F.lower(source).endswith(".mp4")),
        "archive is not of its source": ~((c("archive_path") == archive) | c("archive_path").endswith(F.concat(F.lit("/"), archive))),
        "layers differ": ~F.from_json(F.get_json_object(stated, "$.layers"), "array<int>").eqNullSafe(c("layers")),
    }
    rules |= {f"configuration {path} differs": ~F.get_json_object(stated, path).eqNullSafe(F.lit(value)) for path, value in configuration.items()}
    for name, (shape, dtype) in shapes.items():
        rules |= shape_rule(name, shape, dtype)
    return rules


def audit_features(df: DataFrame, **rules) -> DataFrame:
    """The rules of feature_rules."""
    return with_reasons(df, feature_rules(**rules))


def audit_archives(df: DataFrame, *rules) -> DataFrame:
    """The rules of archive_rules."""
    return with_reasons(df, archive_rules(*rules))


def audit_pairs(pairs: DataFrame, inventory: DataFrame, expected: dict[str, int], strict: bool = False) -> DataFrame:
    """pairs(sample_id, split, relpaths, digest, size) against inventory(relpath, size) and expected counts by split.

    Returns pairs with reasons. Counts that differ, and files without a pair,
    are reasons of rows of their own with a null sample_id.
    """
    files = inventory.select(F.col("relpath").alias("supervision_relpath"), F.col("size").alias("__size"), F.lit(True).alias("__there"))
    twice = pairs.groupBy(F.col("digest").alias("__d")).agg(F.count("*").alias("__k")).filter("__k > 1")
    rows = pairs.join(files, "supervision_relpath", "left").join(twice, F.col("digest").eqNullSafe(F.col("__d")), "left").withColumn("__k", F.coalesce("__k", F.lit(1)))
    stem = lambda c: paths.without_suffix(F.regexp_replace(c, "^[^/]+/", ""))
    rows = with_reasons(rows, {
        "unsafe path": ~paths.is_safe_relpath(F.col("feature_relpath")) | ~paths.is_safe_relpath(F.col("supervision_relpath")),
        "paths name different samples": (stem(F.col("feature_relpath")) != F.col("sample_id")) | (stem(F.col("supervision_relpath")) != F.col("sample_id")),
        "unknown split": ~F.col("split").isin(*expected),
        "content is there twice": F.col("__k") > 1,
        "digest is not SHA-256": ~paths.is_sha256(F.col("digest")),
        "file is missing": F.col("__there").isNull(),
        "size differs": F.col("__there").isNotNull() & ~F.col("__size").eqNullSafe(F.col("size")),
    }).drop("__size", "__there", "__k", "__d")
    stray = inventory.join(pairs.select(F.col("supervision_relpath").alias("relpath")), "relpath", "left_anti").select(F.array(F.concat(F.lit("file without a pair: "), "relpath")).alias("reasons"))
    wanted = pairs.sparkSession.createDataFrame(list(expected.items()), "split string, __n long")
    counts = wanted.join(pairs.groupBy("split").count(), "split", "left").filter(~F.col("__n").eqNullSafe(F.coalesce("count", F.lit(0)))).select("split", F.array(F.lit("count differs")).alias("reasons"))
    out = rows.unionByName(stray, allowMissingColumns=True).unionByName(counts, allowMissingColumns=True)
    if strict and (row := out.filter(F.size("reasons") > 0).first()):
        raise ValueError(f"{row['reasons']}")
    return out


def json_list(values: Column, quoted: bool = False) -> Column:
    """A list as canonical JSON without spaces."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), v, F.lit('"'))) if quoted else values, ","), F.lit("]"))


def audit_records(pairs: DataFrame, features: DataFrame, stated: dict[str, str], n: int = 32) -> DataFrame:
    """Pair records against themselves, what is ``stated`` for all of them, and features(relpath, size).

    Columns are those of the pair schema (A3). ``stated`` has
    feature_config_fingerprint and query_tf_names_sha256. Returns pairs with
    reasons.
    """
    c = F.col
    ideal = arrays.midpoint_samples(c("source_total_frames"), n)
    files = features.select(c("relpath").alias("feature_relpath"), c("size").alias("__size"))
    rows = pairs.join(files, "feature_relpath", "left")
    return with_reasons(rows, {
        "source is another sample": ~(paths.is_safe_relpath(c("source_video_relpath")) & (paths.without_suffix(c("source_video_relpath")) == c("sample_id"))),
        "frames are not the midpoint samples": ~(c("past_frame_indices").eqNullSafe(ideal["past"]) & c("target_frame_indices").eqNullSafe(ideal["target"])),
        "frame identity differs": c("frame_indices_sha256") != F.sha2(json_list(F.concat("past_frame_indices", "target_frame_indices")), 256),
        **{f"{k} differs": ~c(k).eqNullSafe(F.lit(v)) for k, v in stated.items()},
        "size is not positive": (c("feature_size_bytes") <= 0) | (c("hdf5_size_bytes") <= 0),
        "feature is missing or its size differs": ~c("__size").eqNullSafe(c("feature_size_bytes")),
    }).drop("__size")


def audit_identities(pairs: DataFrame, stated: dict[str, str], method: str = "exact") -> DataFrame:
    """Name, stated, found and ok of the digests that stand for whole sets.

    content is that of all supervision digests in order, train and test those
    of the splits' feature paths, a line each, in order. Exact digests equal
    what a file's writer computed (see metrics.EXACT_UPTO); ``tree`` ones are
    those of D3's trees, over any number of pairs.
    """
    if method == "tree":
        lines = {"content": (pairs, F.col("hdf5_sha256")), **{split: (pairs.filter(F.col("split") == split), F.col("feature_relpath")) for split in ("train", "test")}}
        parts = [metrics.digest_of_set(df, line, "tree").select(F.lit(name).alias("name"), F.col("digest").alias("found")) for name, (df, line) in lines.items()]
        return _identities(parts[0].unionByName(parts[1]).unionByName(parts[2]), stated)
    if (n := pairs.count()) > metrics.EXACT_UPTO:
        raise ValueError(f"exact digests take {metrics.EXACT_UPTO} pairs, not {n}")
    of = lambda split: F.sha2(F.array_join(F.array_sort(F.collect_list(F.when(F.col("split") == split, F.concat("feature_relpath", F.lit("\n"))))), ""), 256)
    found = pairs.agg(F.sha2(json_list(F.array_sort(F.collect_list("hdf5_sha256")), True), 256).alias("content"), of("train").alias("train"), of("test").alias("test"))
    return _identities(found.unpivot([], ["content", "train", "test"], "name", "found"), stated)


def _identities(rows: DataFrame, stated: dict[str, str]) -> DataFrame:
    wanted = F.create_map(*(F.lit(x) for kv in stated.items() for x in kv))[F.col("name")] if stated else F.lit(None).cast("string")
    return rows.select("name", wanted.alias("stated"), "found", wanted.eqNullSafe(F.col("found")).alias("ok"))


def audit_camera(df: DataFrame, pose: str, camera: str, tolerance: float = 1e-3) -> DataFrame:
    """Rules for a pose and a camera matrix in each row."""
    m, k = F.col(pose), F.col(camera)
    near = lambda x, v: F.abs(x - v) <= tolerance
    last = near(F.get(m, F.lit(12)), 0) & near(F.get(m, F.lit(13)), 0) & near(F.get(m, F.lit(14)), 0) & near(F.get(m, F.lit(15)), 1)
    return with_reasons(df, {"pose is not 4 x 4": F.size(m) != 16, "not finite": ~(arrays.all_finite(m) & arrays.all_finite(k)), "last row": ~last, "singular": F.abs(geometry.determinant(m)) < 1e-6, "camera corner": ~near(F.get(k, F.lit(8)), 1)})


def audit_geometry(cameras: DataFrame, poses: DataFrame, lengths: DataFrame, joints: list[str]) -> DataFrame:
    """episode_id and reasons: number of cameras (1 or one a frame), joints that are missing, confidences for some frames only."""
    cams = cameras.groupBy("episode_id").agg(F.count("*").alias("n_cameras"))
    seen = poses.filter(F.col("joint").isin(joints)).groupBy("episode_id").agg(F.count_distinct("joint").alias("n_joints"), F.count("conf").alias("n_conf"), F.count("*").alias("n"))
    rows = lengths.join(cams, "episode_id", "left").join(seen, "episode_id", "left")
    return with_reasons(rows, {"number of cameras": ~F.col("n_cameras").isin(1) & (F.col("n_cameras") != F.col("n_frames")), "joint is missing": F.col("n_joints") != len(joints), "confidences are partial": (F.col("n_conf") != 0) & (F.col("n_conf") != F.col("n"))}).select("episode_id", "reasons")


def compare_contract(report: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """I4: key, field, reported, found for every field that differs, and for rows that one side lacks."""
    long = lambda d, name: d.select(key, *(F.col(c).cast("string").alias(c) for c in columns)).unpivot(key, columns, "field", name).withColumn(f"__{name}", F.lit(True))
    both = long(report, "reported").join(long(current, "found"), [key, "field"], "full_outer")
    same = F.col("reported").eqNullSafe(F.col("found")) & F.col("__reported").isNotNull() & F.col("__found").isNotNull()
    return both.filter(~same).select(key, "field", "reported", "found")


def compare_records(report: DataFrame, current: DataFrame, key: str, column: str = "record", depth: int = trees.DEPTH) -> DataFrame:
    """I4: key, path, difference, reported and found (kinds and values) of every place where two nested JSON records differ.

    The difference is ``value``, ``kind`` (1 and "1" differ, 1 and 1.0 don't),
    ``missing`` (reported only) or ``extra`` (found only). Of a subtree that one
    side lacks, or that has another kind, its highest node stands for all. A
    record that one side lacks is its root. Keys are distinct on each side. Places
    below ``depth`` levels are an error only where both sides have to be compared.
    """
    sides = [d.select(key, F.col(column).alias(name), F.lit(True).alias(f"__{name}")) for d, name in ((report, "reported"), (current, "found"))]
    both = sides[0].join(sides[1], key, "full_outer")
    there = [F.coalesce(F.col(f"__{name}"), F.lit(False)) for name in ("reported", "found")]
    rows = both.select(key, F.explode(trees.differences(F.col("reported"), F.col("found"), *there, depth=depth)).alias("__d"))
    return rows.select(key, "__d.path", "__d.difference", F.col("__d.a.kind").alias("reported_kind"), F.col("__d.a.value").alias("reported"), F.col("__d.b.kind").alias("found_kind"), F.col("__d.b.value").alias("found"))


def run_identity(df: DataFrame, settings: list[str]) -> DataFrame:
    """``df`` with the digest of the settings that define its run."""
    return df.withColumn("identity", digests.json_digest({s: F.col(s) for s in settings}))


def resume_mismatches(stored: DataFrame, current: DataFrame, key: str, settings: list[str]) -> DataFrame:
    """Settings that differ; an empty current value is one that does."""
    differ = compare_contract(stored, current, key, settings)
    empty = current.select(key, *(F.col(c).cast("string").alias(c) for c in settings)).unpivot(key, settings, "field", "found").filter("found is null or found = ''").select(key, "field", F.col("found").alias("reported"), "found")
    return differ.unionByName(empty).dropDuplicates([key, "field"])


def finite_only(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with an element that isn't finite in a numeric array, and which columns have one."""
    bad = F.array_compact(F.array(*(F.when(~arrays.all_finite(F.col(c)), F.lit(c)) for c in columns)))
    return df.withColumn("not_finite", bad).filter(F.size("not_finite") > 0)


