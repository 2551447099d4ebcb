"""Files in and out: inventories, manifests, archives, poses, logs."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions import paths
from framewright.operators.quality import with_reasons


def file_inventory(spark: SparkSession, root: str, suffix: str, any_case: bool = False) -> DataFrame:
    """A1: path, relpath, stem, size, mtime of all files below ``root`` with the suffix; contents aren't read.

    Hidden names are left out. See duplicate_stems for the check of a listing.
    """
    pattern = "*" + ("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix) if any_case else suffix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", r"^[A-Za-z0-9]+:(//[^/]*)?", ""), r"^\Q" + root.split(":", 1)[-1].rstrip("/") + r"\E/", "")
    out = files.select("path", rel.alias("relpath"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return out.filter(~F.col("relpath").rlike(r"(^|/)\.")).withColumn("stem", paths.without_suffix(F.col("relpath")))


def duplicate_stems(inventory: DataFrame) -> DataFrame:
    """A1: stems that are there twice; one row with a null stem if the listing is empty."""
    twice = inventory.groupBy("stem").agg(F.count("*").alias("n")).filter("n > 1")
    none = inventory.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(None).cast("string").alias("stem"), "n")
    return twice.unionByName(none)


#: Fields that may hold an entry's path, in this order.
PATH_FIELDS = ("video_path", "raw_video_path", "path", "file", "mp4")


def manifest_entries(lines: DataFrame, suffix: str, column: str = "value") -> DataFrame:
    """A2: ``lines`` of a manifest to rows with path and reason.

    A line is a path, a JSON string, or a JSON object with one of PATH_FIELDS.
    Blank lines and those that begin with # go; ``file://`` is taken off; a
    broken JSON line counts as a plain path. Another suffix is a reason.
    """
    line = F.trim(F.col(column))
    text = lines.filter((line != "") & ~F.startswith(line, F.lit("#"))).withColumn("__line", line)
    fields = [F.when(F.trim(v) != "", F.trim(v)) for v in (F.get_json_object("__line", f"$.{f}") for f in PATH_FIELDS)]
    is_object = F.startswith("__line", F.lit("{")) & F.from_json("__line", "map<string,string>").isNotNull() & F.rlike("__line", F.lit(r"\}\s*$"))
    quoted = F.when(F.rlike("__line", F.lit('^".*"$')), F.get_json_object(F.concat(F.lit('{"v":'), "__line", F.lit("}")), "$.v"))
    path = F.when(is_object, F.coalesce(*fields)).otherwise(F.coalesce(quoted, F.col("__line")))
    out = text.withColumn("path", F.regexp_replace(path, "^file://", "")).filter("path is not null").drop("__line")
    return out.withColumn("reason", F.when(~F.endswith(F.lower("path"), F.lit(suffix.lower())), "suffix"))


def read_manifest(spark: SparkSession, path: str, suffix: str, strict: bool = True) -> DataFrame:
    """A2: path and reason of a manifest, text, JSON lines or one JSON array; ``strict``: duplicates and none at all are errors, else wrong suffixes go."""
    head = spark.read.text(path).filter("trim(value) != ''").first()
    if head and head[0].lstrip().startswith("["):
        whole = spark.read.text(path, wholetext=True)
        items = F.from_json("value", "array<string>")
        lines = whole.select(F.explode(items).alias("value"))
    else:
        lines = spark.read.text(path)
    found = manifest_entries(lines, suffix)
    if not strict:
        return found.filter("reason is null")
    n = found.agg(F.count("*").alias("n"), F.count_distinct("path").alias("k")).first()
    if not n["n"] or n["n"] != n["k"]:
        raise ValueError(f"{path}: {n['n']} entries, {n['k']} distinct")
    return found.select("path", "reason")


#: The closed schema of a pair record.
PAIR_SCHEMA = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("bundle_schema", "feature_schema", "feature_extractor_version", "sample_id", "split", "group", "feature_relpath", "raw_video_relpath", "supervision_relpath", "source_video_relpath", "frame_indices_sha256", "feature_config_fingerprint", "hdf5_sha256", "query_tf_names_sha256")),
    *(T.StructField(c, T.LongType()) for c in ("source_total_frames", "feature_size_bytes", "hdf5_size_bytes")),
    *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("past_frame_indices", "target_frame_indices")),
    T.StructField("confidences_present", T.BooleanType()),
])


def canonical_json(row: Column, schema: T.StructType) -> Column:
    """A struct as JSON with sorted names, no spaces and nulls kept."""
    return F.to_json(F.struct(*(row[f.name].alias(f.name) for f in sorted(schema.fields, key=lambda f: f.name))), {"ignoreNullFields": "false"})


def pair_records(lines: DataFrame, column: str = "value", schema: T.StructType = PAIR_SCHEMA) -> DataFrame:
    """A3: the fields of canonical JSON lines, and reasons: blank, not JSON, other keys, or not its own canonical form.

    Text beyond ASCII has to be escaped in the line, as ``\\uXXXX``.
    """
    row = F.from_json(F.col(column), schema)
    keys = F.array_sort(F.map_keys(F.from_json(F.col(column), "map<string,string>")))
    expected = F.array(*(F.lit(f) for f in sorted(schema.names)))
    parsed = lines.withColumn("__row", row)
    rules = {"blank line": F.trim(F.col(column)) == "", "not the keys of the schema": ~keys.eqNullSafe(expected), "not canonical": ~canonical_json(F.col("__row"), schema).eqNullSafe(_unescaped(F.col(column))), "not ASCII": F.rlike(column, F.lit(r"[^\x00-\x7F]"))}
    return with_reasons(parsed, rules).select(*(F.col(f"__row.{f}").alias(f) for f in schema.names), "reasons")


def _unescaped(line: Column) -> Column:
    """A JSON line with its \\uXXXX escapes read, by one more pass through JSON."""
    plain = F.get_json_object(F.concat(F.lit('{"v":"'), F.regexp_replace(F.regexp_replace(line, r"\\(?!u[0-9a-f]{4})", r"\\\\\\\\"), '"', r'\\\\"'), F.lit('"}')), "$.v")
    return F.when(F.contains(line, F.lit("\\u")), plain).otherwise(line)


def read_pair_records(spark: SparkSession, path: str) -> DataFrame:
    """A3."""
    return pair_records(spark.read.text(path))


def _tensor(data: bytes, name: str) -> np.ndarray:
    a = np.load(io.BytesIO(data), allow_pickle=False)
    if a.dtype == np.uint16 and name.endswith("_bf16"):
        return (a.astype(np.uint32) << 16).view(np.float32)
    return a


def archive_rows(files: DataFrame, tensors: bool = False) -> DataFrame:
    """A4: archives (path, content) to one row for each tensor: path, name, dtype, shape, finite, text (of 0-d strings), and with ``tensors`` its vectors.

    With ``tensors`` a row is a vector of the innermost axis with its place
    before: (path, name, index, vec). Each member is read once; 16-bit brain
    floats, in members whose names end in ``_bf16``, are widened.
    """
    meta = pa.schema([("path", pa.string()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("finite", pa.bool_()), ("text", pa.string())])
    long = pa.schema([("path", pa.string()), ("name", pa.string()), ("index", pa.list_(pa.int64())), ("vec", pa.list_(pa.float32()))])

    def members(content: bytes) -> Iterator[tuple[str, np.ndarray]]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for member in z.namelist():
                name = member.removesuffix(".npy")
                yield name, _tensor(z.read(member), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for name, a in members(content.as_py()):
                    number = a.dtype.kind in "fiub"
                    if not tensors:
                        text = None
                        if a.ndim == 0 and not number:
                            value = a.item()
                            text = value.decode("utf-8") if isinstance(value, bytes) else str(value)
                        yield pa.RecordBatch.from_pylist([{"path": path, "name": name, "dtype": str(a.dtype), "shape": list(a.shape), "finite": bool(np.isfinite(a).all()) if number else None, "text": text}], meta)
                    elif number and a.ndim:
                        flat = a.reshape(-1, a.shape[-1]).astype(np.float32)
                        places = np.indices(a.shape[:-1]).reshape(a.ndim - 1, -1).T
                        for at in range(0, len(flat), 4096):
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(flat[at : at + 4096])), pa.array([name] * len(flat[at : at + 4096])), pa.array(places[at : at + 4096].tolist(), pa.list_(pa.int64())), pa.array(list(flat[at : at + 4096]), pa.list_(pa.float32()))], schema=long)

    ddl = "path string, name string, index array<bigint>, vec array<float>" if tensors else "path string, name string, dtype string, shape array<bigint>, finite boolean, text string"
    return files.select("path", "content").mapInArrow(run, ddl)


def load_feature_archives(spark: SparkSession, root: str, tensors: bool = False) -> DataFrame:
    """A4: all ``.npz`` archives below a folder; the one place where Python reads files, a partition of them at a time."""
    return archive_rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(root), tensors)


def load_pose_table(poses: DataFrame, joints: DataFrame) -> DataFrame:
    """A5: poses of the query joints only, with reason where an episode has confidences for some rows and not for others."""
    kept = poses.join(joints.select("joint"), "joint", "left_semi")
    some = kept.groupBy("episode_id").agg(F.count("conf").alias("k"), F.count("*").alias("n")).filter("k not in (0, n)").select("episode_id", F.lit("confidences are partial").alias("reason"))
    return kept.join(some, "episode_id", "left")


def write_manifests(df: DataFrame, out: str, meta: DataFrame | None = None) -> None:
    """``df(split, video_path, cache_path)`` as one text folder for each split, a TSV with header, train first, and metadata as JSON."""
    df.select("split", F.col("video_path").alias("value")).write.partitionBy("split").text(f"{out}/manifests")
    ordered = df.orderBy(F.col("split") != "train", "video_path", "cache_path")
    ordered.select("video_path", "cache_path").write.csv(f"{out}/pairs", sep="\t", header=True)
    if meta is not None:
        meta.write.json(f"{out}/metadata")


def redacted(text: Column, root: str) -> Column:
    """The text with the root's path replaced."""
    return F.replace(text, F.lit(root.rstrip("/")), F.lit("<DATASET_ROOT>"))


def append_failures(df: DataFrame, out: str, root: str, columns: tuple[str, ...] = ("message", "trace")) -> None:
    """Failure events added to a JSON log, host paths redacted."""
    df.withColumns({c: redacted(F.col(c), root) for c in columns if c in df.columns}).write.mode("append").json(out)


def publish_if_valid(staging: DataFrame, rules: dict[str, Column], staged: str, target: str) -> bool:
    """Write to ``staged``, judge what was written, and only then write to ``target``.

    Nothing is published if any row has a reason, and a target that is there
    isn't touched. Says whether it published.
    """
    spark = staging.sparkSession
    staging.write.parquet(staged)
    written = spark.read.schema(staging.schema).parquet(staged)
    judged = with_reasons(written, rules)
    if not judged.filter(F.size("reasons") > 0).isEmpty():
        return False
    try:
        written.write.mode("errorifexists").parquet(target)
    except AnalysisException as e:
        if e.getCondition() == "PATH_ALREADY_EXISTS":
            return False
        raise
    return True
