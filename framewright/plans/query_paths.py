"""Queries of path and name expressions, digests and sources (A, B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import digests, paths
from framewright.plans.registry import PAGE_PATH, page_paths, query, table
from framewright.sources import files
from framewright.sources.shared import shared_path as scratch


_NAME = "concat('v', page_id, CASE page_id % 3 WHEN 0 THEN '_L12_nf32_res256_new8_s1of4' WHEN 1 THEN '_L12_nf32_res256_new8_s1of4_cv2' ELSE '_raw' END)"


@query("B1_archive_stem", f"""
SELECT page_id, regexp_replace({_NAME}, '^(.+?)_L\\d+_nf\\d+_res\\d+_new\\d+_s\\d+of\\d+$', '\\1') AS strict_stem,
       regexp_replace({_NAME}, '^(.+?)_L\\d+_nf\\d+_res\\d+_new\\d+_s\\d+of\\d+(?:_cv\\d+)?$', '\\1') AS loader_stem FROM pages""")
def b1(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr(_NAME)
    return table(spark, d, "pages").select("page_id", paths.archive_stem(name).alias("strict_stem"), paths.archive_stem(name, True).alias("loader_stem"))


@query("B2_relative_stem", f"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/ext/' ELSE '/data/' END || {PAGE_PATH} || '.mp4' AS path FROM pages),
q AS (SELECT page_id, path, regexp_replace(path, '([^/])\\.mp4$', '\\1') AS s FROM p)
SELECT page_id, CASE WHEN path LIKE '/data/%' THEN substr(s, 7) ELSE '_external/' || substr(sha256(path), 1, 16) || '/' || regexp_extract(s, '[^/]+$') END AS stem,
       CASE WHEN path LIKE '/data/%' THEN substr(s, 7) ELSE 'external/' || path END AS sort_key FROM q""")
def b2(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "/ext/").otherwise("/data/"), F.col("path"), F.lit(".mp4"))
    return page_paths(spark, d).select("page_id", paths.relative_stem(path, "/data").alias("stem"), paths.relative_stem(path, "/data", sort_key=True).alias("sort_key"))


_ODD = f"CASE page_id % 7 WHEN 0 THEN '/' || {PAGE_PATH} WHEN 1 THEN '../' || {PAGE_PATH} WHEN 2 THEN replace({PAGE_PATH}, '/', chr(92)) WHEN 3 THEN {PAGE_PATH} || '/' WHEN 4 THEN '' ELSE {PAGE_PATH} || '.mp4' END"


@query("B3_safe_relpath", f"""
WITH p AS (SELECT page_id, {_ODD} AS path FROM pages)
SELECT page_id, CASE WHEN path = '' THEN 'empty' WHEN contains(path, chr(92)) THEN 'backslash' WHEN path LIKE '/%' THEN 'absolute'
    WHEN list_contains(string_split(path, '/'), '.') OR list_contains(string_split(path, '/'), '..') THEN 'dots'
    WHEN list_contains(string_split(path, '/'), '') THEN 'not canonical' WHEN path NOT LIKE '%.mp4' THEN 'suffix' END AS reason FROM p""")
def b3(spark: SparkSession, d: str) -> DataFrame:
    p, c = F.col("path"), F.col("page_id") % 7
    odd = F.when(c == 0, F.concat(F.lit("/"), p)).when(c == 1, F.concat(F.lit("../"), p)).when(c == 2, F.replace(p, F.lit("/"), F.lit("\\"))).when(c == 3, F.concat(p, F.lit("/"))).when(c == 4, F.lit("")).otherwise(F.concat(p, F.lit(".mp4")))
    return page_paths(spark, d).select("page_id", paths.unsafe_reason(odd, ".mp4").alias("reason"))


_CLIP = "concat('ep', page_id, CASE page_id % 4 WHEN 0 THEN '-clip1_chunk2' WHEN 1 THEN '_frames10-20' WHEN 2 THEN '_Window3-part4' ELSE '' END)"


@query("B4_episode_stem", f"SELECT page_id, 'ep' || page_id AS stem FROM pages WHERE {_CLIP} LIKE 'ep%'")
def b4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", paths.episode_stem(F.expr(_CLIP)).alias("stem"))


_STEM = f"CASE page_id % 4 WHEN 0 THEN 'x/takes/T' || page_id % 9 || '/cam' WHEN 1 THEN 'cap_' || page_id % 5 || '/Capture-' || page_id % 5 || '/v' WHEN 2 THEN 't' || page_id % 6 || '/frame_aligned_videos/v' ELSE {PAGE_PATH} END"


@query("B5_group_key", f"""
WITH p AS (SELECT page_id, {PAGE_PATH} AS path, {_STEM} AS stem FROM pages),
q AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS parent, regexp_extract(path, '[^/]+$') AS name FROM p)
SELECT page_id, CASE WHEN parent NOT IN ('', '.') THEN 'task:' || parent ELSE 'episode:' || name END AS task,
       'take:' || CASE page_id % 4 WHEN 0 THEN 'T' || page_id % 9 WHEN 1 THEN 'cap_' || page_id % 5 WHEN 2 THEN 't' || page_id % 6 ELSE string_split(path, '/')[1] END AS take,
       CASE WHEN page_id % 4 = 1 THEN 'capture:Capture-' || page_id % 5 END AS capture,
       'regex:' || regexp_extract(path, '^(?:www\\.|m\\.)?([^/]+)', 1) AS host
FROM q""")
def b5(spark: SparkSession, d: str) -> DataFrame:
    p, c, i = F.col("path"), F.col("page_id") % 4, F.col("page_id")
    n = lambda k: (i % k).cast("string")
    stem = F.when(c == 0, F.concat(F.lit("x/takes/T"), n(9), F.lit("/cam"))).when(c == 1, F.concat(F.lit("cap_"), n(5), F.lit("/Capture-"), n(5), F.lit("/v"))).when(c == 2, F.concat(F.lit("t"), n(6), F.lit("/frame_aligned_videos/v"))).otherwise(p)
    return page_paths(spark, d).select("page_id", paths.group_key(p, "tasks").alias("task"), paths.group_key(stem, "takes").alias("take"), paths.group_key(stem, "takes", "capture").alias("capture"), paths.group_key(p, "tasks", regex=r"^(?:www\.|m\.)?(?P<group>[^/]+)").alias("host"))


@query("B6_group_mode", """
SELECT CASE WHEN count(*) > 0 AND bool_and(page_id % 2 >= 0) THEN 'capture' ELSE 'take' END AS every_row,
       CASE WHEN count(*) > 0 AND bool_and(page_id % 2 = 0) THEN 'capture' ELSE 'take' END AS some_rows, 'parent' AS tasks FROM pages""")
def b6(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    every = pages.select(F.concat(F.lit("captures/c"), (F.col("page_id") % 7).cast("string"), F.lit("/v")).alias("stem"))
    some = pages.select(F.when(F.col("page_id") % 2 == 0, "captures/c/v").otherwise("other/v").alias("stem"))
    modes = [F.lit(group_mode(every, "takes")).alias("every_row"), F.lit(group_mode(some, "takes")).alias("some_rows"), F.lit(group_mode(some, "tasks")).alias("tasks")]
    return pages.agg(F.count("*")).select(*modes)


def group_mode(df: DataFrame, dataset: str, requested: str = "auto", stem: str = "stem") -> str:
    """The mode for a whole set: ``auto`` is parent for tasks, capture if every row has one, else take."""
    if requested != "auto":
        return requested
    if dataset == "tasks":
        return "parent"
    row = df.agg(F.bool_and(paths.capture_of(F.col(stem)).isNotNull()).alias("every")).first()
    return "capture" if row["every"] else "take"


@query("B7_joint_name", """
SELECT p_partkey, trim(regexp_replace(replace(lower(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1-\\2', 'g')), '_', '-'), '-+', '-', 'g'), '-') AS joint
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'rightHand' || 'LittleFinger' || p_partkey || 'Base' WHEN 1 THEN '_left_Arm__' || p_partkey ELSE 'Hip' || p_partkey END AS n FROM part)""")
def b7(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("rightHandLittleFinger"), k, F.lit("Base"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("_left_Arm__"), k)).otherwise(F.concat(F.lit("Hip"), k))
    return table(spark, d, "part").select("p_partkey", paths.joint_name(name).alias("joint"))


@query("B8_path_variants", """
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a/a/b' || page_id WHEN 1 THEN 'part' || page_id % 3 || '/t' WHEN 2 THEN 'cache/cache/c' || page_id ELSE 'q' || page_id END AS dir FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN dir || '|' || substr(dir, 3) WHEN 1 THEN dir || '|t' WHEN 2 THEN dir || '|' || substr(dir, 7) || '|' || substr(dir, 13) ELSE dir END AS variants FROM p""")
def b8(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    dir_ = F.when(i % 4 == 0, F.concat(F.lit("a/a/b"), i.cast("string"))).when(i % 4 == 1, F.concat(F.lit("part"), (i % 3).cast("string"), F.lit("/t"))).when(i % 4 == 2, F.concat(F.lit("cache/cache/c"), i.cast("string"))).otherwise(F.concat(F.lit("q"), i.cast("string")))
    return table(spark, d, "pages").select("page_id", F.array_join(paths.path_variants(dir_, "cache"), "|").alias("variants"))


@query("B9_pick_instruction", """
SELECT conv_id, turn, CASE WHEN role = 'user' AND turn % 2 = 1 THEN 'second ' || md5(text) ELSE 'first ' || md5(text) END AS instruction FROM conversations""")
def b9(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "reversible").otherwise("plain")
    direction = F.when(F.col("turn") % 2 == 1, "2").otherwise("1")
    return table(spark, d, "conversations").select("conv_id", "turn", paths.pick_instruction(kind, direction, F.concat(F.lit("first "), F.md5("text")), F.concat(F.lit("second "), F.md5("text"))).alias("instruction"))


@query("B10_host_paths", f"SELECT page_id, v AS value FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' || {PAGE_PATH} WHEN 1 THEN 'C:\\' || {PAGE_PATH} WHEN 2 THEN 'file://' || {PAGE_PATH} ELSE url END AS v FROM pages) WHERE regexp_matches(v, '^(/|\\\\\\\\|[A-Za-z]:[\\\\/]|file://)')")
def b10(spark: SparkSession, d: str) -> DataFrame:
    c, p = F.col("page_id") % 5, F.col("path")
    value = F.when(c == 0, F.concat(F.lit("/"), p)).when(c == 1, F.concat(F.lit("C:\\"), p)).when(c == 2, F.concat(F.lit("file://"), p)).otherwise(F.col("url"))
    return page_paths(spark, d).select("page_id", value.alias("value")).filter(paths.is_host_path(F.col("value")))


_HOME = "CASE page_id % 7 WHEN 0 THEN 'D:/home' WHEN 1 THEN '' WHEN 2 THEN 'file://x' ELSE 'home' END"


@query("B10_paths_in_records", f"""
WITH v AS (SELECT page_id, url, {_HOME} AS home, CASE page_id % 5 WHEN 0 THEN '/' || {PAGE_PATH} WHEN 1 THEN chr(92) || chr(92) || 'host' WHEN 2 THEN 'file://' || {PAGE_PATH} ELSE url END AS v FROM pages),
j AS (SELECT page_id, json_object('id', page_id, '/key', 1, 'meta', json_object('items', json_array(json_object('ref', v), json_array(url, v, NULL, page_id % 2 = 0)), 'home', home)) AS j FROM v)
SELECT page_id, replace(fullkey, '"', '') AS path, atom->>'$' AS value FROM j, json_tree(j) t WHERE t.type = 'VARCHAR' AND regexp_matches(atom->>'$', '^(/|\\\\\\\\|[A-Za-z]:[\\\\/]|file://)')""")
def b10_records(spark: SparkSession, d: str) -> DataFrame:
    c, h = F.col("page_id") % 5, F.col("page_id") % 7
    v = F.when(c == 0, F.concat(F.lit("/"), "path")).when(c == 1, F.lit("\\\\host")).when(c == 2, F.concat(F.lit("file://"), "path")).otherwise(F.col("url"))
    home = F.when(h == 0, "D:/home").when(h == 1, "").when(h == 2, "file://x").otherwise("home")
    text = lambda x: F.to_json(F.struct(x.alias("x")))
    inner = lambda x: F.substring(text(x), F.lit(6), F.length(text(x)) - 6)  # noqa: E731  the JSON of a value alone
    record = F.concat(F.lit('{"id":'), F.col("page_id").cast("string"), F.lit(',"/key":1,"meta":{"items":[{"ref":'), inner(v), F.lit("},["), inner(F.col("url")), F.lit(","), inner(v), F.lit(",null,"), (F.col("page_id") % 2 == 0).cast("string"), F.lit(']],"home":'), inner(home), F.lit("}}"))
    return paths.host_paths(page_paths(spark, d).select("page_id", record.alias("record")), "record").select("page_id", "path", "value")


@query("B11_portable_ref", f"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {PAGE_PATH} WHEN page_id % 3 = 1 THEN regexp_extract({PAGE_PATH}, '([^/]+)/*$', 1) ELSE '' END AS ref FROM pages""")
def b11(spark: SparkSession, d: str) -> DataFrame:
    c, p = F.col("page_id") % 3, F.col("path")
    value = F.when(c == 0, F.concat(F.lit("/runs/a/"), p)).when(c == 1, F.concat(F.lit("/else/"), p)).otherwise(F.lit(" "))
    return page_paths(spark, d).select("page_id", paths.portable_ref(value, "/runs/a").alias("ref"))


@query("B12_digests", """
SELECT doc_id, sha256(text) AS content, sha256('{"lang":' || to_json(lang) || ',"n":' || n_chars || ',"source":' || to_json(source) || '}') AS settings FROM documents""")
def b12(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", digests.content_digest(F.col("text")).alias("content"), digests.json_digest({"source": F.col("source"), "n": F.col("n_chars"), "lang": F.col("lang")}).alias("settings"))


@query("B13_id_list", """
WITH p AS (SELECT DISTINCT doc_id, try_cast(x AS INTEGER) AS i FROM (SELECT doc_id, unnest(regexp_split_to_array(trim(s), '[,\\s]+')) AS x
    FROM (SELECT doc_id, ' ' || (doc_id % 50) || ', ' || (n_chars % 50) || ' x ' || (doc_id % 7) || ',' AS s FROM documents)))
SELECT doc_id, count(i) AS n_ids, sum(i)::BIGINT AS total FROM p GROUP BY doc_id""")
def b13(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c, k: (F.col(c) % k).cast("string")
    spec = F.concat(F.lit(" "), n("doc_id", 50), F.lit(", "), n("n_chars", 50), F.lit(" x "), n("doc_id", 7), F.lit(","))
    ids = paths.parse_id_list(spec)
    return table(spark, d, "documents").select("doc_id", F.size(ids).cast("long").alias("n_ids"), F.aggregate(ids, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


_HEX = "CASE doc_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN upper(sha256(text)) WHEN 2 THEN substr(sha256(text), 1, 40) ELSE 'no' END"


@query("B14_is_sha", f"""
SELECT doc_id, regexp_matches(h, '^[0-9a-f]{{64}}$') AS small, regexp_matches(h, '^[0-9a-fA-F]{{64}}$') AS any_case, regexp_matches(h, '^[0-9a-f]{{40}}$') AS commit_sha
FROM (SELECT doc_id, {_HEX} AS h FROM documents)""")
def b14(spark: SparkSession, d: str) -> DataFrame:
    sha, c = F.sha2("text", 256), F.col("doc_id") % 4
    h = F.when(c == 0, sha).when(c == 1, F.upper(sha)).when(c == 2, F.substring(sha, 1, 40)).otherwise("no")
    return table(spark, d, "documents").select("doc_id", paths.is_sha256(h).alias("small"), paths.is_sha256(h, True).alias("any_case"), paths.is_commit_sha(h).alias("commit_sha"))


@query("A1_file_inventory", "SELECT coalesce(source, '__HIVE_DEFAULT_PARTITION__') AS folder, 1::BIGINT AS n_files FROM documents GROUP BY source")
def a1(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark, "inventory")
    table(spark, d, "documents").select("source", "doc_id").repartition("source").write.partitionBy("source").parquet(root)
    found = files.file_inventory(spark, root, ".parquet")
    return found.groupBy(F.regexp_extract("relpath", "source=([^/]+)/", 1).alias("folder")).agg(F.count_distinct("stem").alias("n_files"))


@query("A1_duplicate_stems", f"WITH p AS (SELECT {PAGE_PATH} AS p FROM pages) SELECT regexp_replace(p, '/[^/]*$', '') AS stem, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 1")
def a1_stems(spark: SparkSession, d: str) -> DataFrame:
    return files.duplicate_stems(page_paths(spark, d).select(F.regexp_replace("path", "/[^/]*$", "").alias("stem")))


@query("A2_manifest", f"""
WITH p AS (SELECT page_id, {PAGE_PATH} || CASE WHEN page_id % 10 = 0 THEN '.txt' ELSE '.mp4' END AS path FROM pages)
SELECT page_id, path, CASE WHEN path NOT LIKE '%.mp4' THEN 'suffix' END AS reason FROM p WHERE page_id % 6 NOT IN (4, 5)""")
def a2(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("page_id") % 6
    path = F.concat("path", F.when(F.col("page_id") % 10 == 0, ".txt").otherwise(".mp4"))
    line = F.when(c == 0, path).when(c == 1, F.concat(F.lit("file://"), path)).when(c == 2, F.to_json(F.struct(path.alias("path"), F.lit("").alias("video_path")))).when(c == 3, F.to_json(F.struct(path.alias("mp4")))).when(c == 4, F.concat(F.lit("# "), path)).otherwise("  ")
    return files.manifest_entries(page_paths(spark, d).select("page_id", line.alias("value")), ".mp4").select("page_id", "path", "reason")


@query("A3_pair_records", "SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'not the keys of the schema|not canonical' WHEN 2 THEN 'not canonical' ELSE '' END AS reasons FROM documents")
def a3(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("doc_id") % 4
    names = sorted(files.PAIR_SCHEMA.names)
    kinds = {f.name: f.dataType.simpleString() for f in files.PAIR_SCHEMA.fields}
    values = {"string": F.concat(F.lit("s"), F.col("doc_id").cast("string")), "bigint": F.col("n_chars"), "array<bigint>": F.array("doc_id", "n_chars"), "boolean": F.col("doc_id") % 2 == 0}
    row = lambda keys: F.to_json(F.struct(*(values[kinds[k]].alias(k) for k in keys)), {"ignoreNullFields": "false"})
    line = F.when(c == 1, row(names[1:])).when(c == 2, row(names[::-1])).otherwise(row(names))
    root = scratch(spark, "records")
    table(spark, d, "documents").select(line.alias("value")).write.text(root)
    found = files.read_pair_records(spark, root)
    return found.select(F.regexp_extract("sample_id", r"(\d+)", 1).cast("long").alias("doc_id"), F.array_join("reasons", "|").alias("reasons"))


@query("A4_feature_archives", "SELECT label, 64::BIGINT AS width, count(*) AS n_vectors, true AS finite, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 3) AS total FROM embeddings GROUP BY label")
def a4(spark: SparkSession, d: str) -> DataFrame:
    import io

    import numpy as np
    import pandas as pd

    def pack(batches):
        """Vectors of a batch as archives, one for each label."""
        for pdf in batches:
            for label, rows in pdf.groupby("label"):
                out = io.BytesIO()
                np.savez(out, vectors=np.stack(rows["embedding"].to_numpy()), label=np.array(str(label)))
                yield pd.DataFrame({"path": [f"{label}/{rows['vec_id'].min()}"], "content": [out.getvalue()]})

    archives = table(spark, d, "embeddings").select("vec_id", "label", "embedding").mapInPandas(pack, "path string, content binary")
    label = F.substring_index("path", "/", 1).cast("int").alias("label")
    meta = files.archive_rows(archives).filter("name = 'vectors'").groupBy(label).agg(F.max(F.col("shape")[1]).alias("width"), F.sum(F.col("shape")[0]).alias("n_vectors"), F.bool_and("finite").alias("finite"))
    total = files.archive_rows(archives, tensors=True).groupBy(label).agg(F.round(F.sum(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))), 3).alias("total"))
    return meta.join(total, "label")


@query("A4_archive_source", """
WITH v AS (SELECT label, vec_id, embedding FROM embeddings)
SELECT label, count(*) AS n_vectors, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 3) AS total, count(*) FILTER (vec_id % 2 = 0) AS n_even FROM v GROUP BY label""")
def a4_source(spark: SparkSession, d: str) -> DataFrame:
    from framewright.sources import archives

    root = scratch(spark, "archives")

    def write(batches):
        """Vectors of a batch as archives in the shared folder, one for each label; a task that runs again writes the same ones."""
        import numpy as np
        import pandas as pd
        from pyarrow.fs import FileSystem

        system, inner = FileSystem.from_uri(root)
        for pdf in batches:
            for label, rows in pdf.groupby("label"):
                system.create_dir(f"{inner}/{label}")
                with system.open_output_stream(f"{inner}/{label}/{rows['vec_id'].min()}.npz") as out:
                    np.savez(out, vectors=np.stack(rows["embedding"].to_numpy()), even=(rows["vec_id"].to_numpy() % 2 == 0)[:, None])
            yield pd.DataFrame({"n": [len(pdf)]})

    table(spark, d, "embeddings").select("vec_id", "label", "embedding").mapInPandas(write, "n long").agg(F.sum("n")).first()
    spark.dataSource.register(archives.ArchiveSource)
    label = F.element_at(F.split("path", "/"), -2).cast("int").alias("label")
    of = lambda name: spark.read.format("npz").option("names", name).load(root)
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double"))
    vectors = of("vectors").groupBy(label).agg(F.count("*").alias("n_vectors"), F.round(F.sum(total), 3).alias("total"))
    return vectors.join(of("even").groupBy(label).agg(F.sum(F.col("vec")[0]).cast("long").alias("n_even")), "label")


_JOINTS = ("click", "view")


@query("A5_pose_table", """
SELECT user_id AS episode_id, count(*) AS n_rows, CASE WHEN count(value) FILTER (value > 10) NOT IN (0, count(*)) THEN 'confidences are partial' END AS reason
FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id""")
def a5(spark: SparkSession, d: str) -> DataFrame:
    poses = table(spark, d, "events").select(F.col("user_id").alias("episode_id"), F.col("event_type").alias("joint"), F.when(F.col("value") > 10, F.col("value")).alias("conf"))
    joints = poses.select("joint").distinct().filter(F.col("joint").isin(*_JOINTS))
    return files.load_pose_table(poses, joints).groupBy("episode_id").agg(F.count("*").alias("n_rows"), F.max("reason").alias("reason"))


@query("A6_write_manifests", f"""
WITH p AS (SELECT DISTINCT CASE WHEN page_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, {PAGE_PATH} || '.mp4' AS v, page_id || '.npz' AS c FROM pages)
SELECT split, count(*) AS n_lines, count(*) AS n_pairs, min(v) AS first_video, max(v || chr(9) || c) AS last_pair, sum(('0x' || substr(md5(v || chr(9) || c), 1, 15))::BIGINT::HUGEINT)::VARCHAR AS content FROM p GROUP BY split""")
def a6(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark, "manifests")
    rows = page_paths(spark, d).select(F.when(F.col("page_id") % 10 == 0, "test").otherwise("train").alias("split"), F.concat("path", F.lit(".mp4")).alias("video_path"), F.concat(F.col("page_id").cast("string"), F.lit(".npz")).alias("cache_path"))
    files.write_manifests(rows, out, rows.groupBy("split").count())
    lines = spark.read.text(f"{out}/manifests").groupBy("split").agg(F.count("*").alias("n_lines"), F.min("value").alias("first_video"))
    pairs = spark.read.csv(f"{out}/pairs", sep="\t", header=True, schema="video_path string, cache_path string")
    both = F.concat("video_path", F.lit("\t"), "cache_path")
    split = F.when(F.regexp_extract("cache_path", r"^(\d+)", 1).cast("long") % 10 == 0, "test").otherwise("train")
    return lines.join(pairs.groupBy(split.alias("split")).agg(F.count("*").alias("n_pairs"), F.max(both).alias("last_pair"), F.sum(F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("content")), "split")


@query("A7_failure_log", f"SELECT page_id, 'cannot read <DATASET_ROOT>/' || {PAGE_PATH} AS message FROM pages")
def a7(spark: SparkSession, d: str) -> DataFrame:
    out = scratch(spark, "failures")
    rows = page_paths(spark, d).select("page_id", F.concat(F.lit("cannot read /data/x/"), "path").alias("message"))
    files.append_failures(rows.filter(F.col("page_id") % 2 == 0), out, "/data/x")
    files.append_failures(rows.filter(F.col("page_id") % 2 == 1), out, "/data/x")
    return spark.read.schema("page_id long, message string").json(out)


@query("A8_publish", "SELECT true AS good_published, false AS bad_published, false AS again, count(*) AS n FROM orders WHERE o_totalprice > 0")
def a8(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice").filter("o_totalprice > 0")
    rules = {"price": F.col("o_totalprice") <= 0}
    root = scratch(spark, "publish")
    good = files.publish_if_valid(orders, rules, f"{root}/a", f"{root}/target")
    bad = files.publish_if_valid(orders.withColumn("o_totalprice", -F.col("o_totalprice")), rules, f"{root}/b", f"{root}/other")
    again = files.publish_if_valid(orders.limit(1), rules, f"{root}/c", f"{root}/target")
    return spark.read.parquet(f"{root}/target").agg(F.lit(good).alias("good_published"), F.lit(bad).alias("bad_published"), F.lit(again).alias("again"), F.count("*").alias("n")).select("good_published", "bad_published", "again", "n")
