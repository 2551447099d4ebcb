"""Counts, digests, scores and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import arrays, digests


def length_histogram(df: DataFrame, value: Column) -> DataFrame:
    """Length and how many rows have it."""
    return df.groupBy(value.alias("length")).agg(F.count("*").alias("n"))


#: Lines that an exact digest takes; more is an error.
EXACT_UPTO = 1_000_000


def digest_of_set(df: DataFrame, line: Column, method: str = "additive") -> DataFrame:
    """D3: digest, n and method of all distinct lines.

    The caller names the method. ``exact`` holds all lines in one task;
    ``additive`` takes any number, but sums can be made to meet; ``tree`` takes
    any number and is as hard to forge as SHA-256 (see digest_tree).
    """
    if method == "tree":
        root = digest_tree(df, line).filter("level = 0").agg(F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
        return root.select("digest", "n", F.lit(method).alias("method"))
    lines = df.select(line.alias("line")).distinct()
    if method == "exact":
        if (n := lines.count()) > EXACT_UPTO:
            raise ValueError(f"an exact digest takes {EXACT_UPTO} lines, not {n}")
        digest = digests.set_digest(F.col("line"))
    elif method == "additive":
        digest = digests.additive_digest(F.col("line"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return lines.agg(digest.alias("digest"), F.count("*").alias("n"), F.lit(method).alias("method"))


#: Hex digits of a line's digest that name its leaf in a tree of digests.
TREE_DEPTH = 4


def _leaves(df: DataFrame, line: Column, depth: int) -> DataFrame:
    """prefix, digest and n of the leaves: lines are known by their digests, of which a leaf's are hashed in order."""
    each = df.select(F.sha2(line, 256).alias("line")).filter("line is not null").distinct()
    prefix = F.substring("line", 1, depth)
    return each.groupBy(prefix.alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ""), 256).alias("digest"), F.count("*").alias("n"))


def _parents(nodes: DataFrame, level: int) -> DataFrame:
    """The nodes of ``level`` above those of the next: of up to 16 children, digit and digest, in order."""
    child = F.concat(F.substring("prefix", level + 1, 1), F.col("digest"))
    return nodes.groupBy(F.substring("prefix", 1, level).alias("prefix")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(child)), ""), 256).alias("digest"), F.sum("n").alias("n"))


def digest_tree(df: DataFrame, line: Column, depth: int = TREE_DEPTH) -> DataFrame:
    """D3: level, prefix, digest and n of the nodes of a tree of digests over the distinct lines; the root has level 0, null is no line.

    A line stands in the leaf that the first ``depth`` hex digits of its SHA-256
    name, so leaves are alike in size, whatever the lines, and equal sets have
    equal trees however they are partitioned. 16 ** depth leaves of some
    thousand lines each are far from a task's memory.
    """
    nodes = _leaves(df, line, depth)
    tree = nodes.withColumn("level", F.lit(depth))
    for level in range(depth - 1, -1, -1):
        nodes = _parents(nodes, level)
        tree = tree.unionByName(nodes.withColumn("level", F.lit(level)))
    return tree.select("level", "prefix", "digest", "n")


def update_tree(tree: DataFrame, df: DataFrame, line: Column, changed: DataFrame, changed_line: Column, depth: int = TREE_DEPTH) -> DataFrame:
    """D3: the tree of ``df`` from the one it had before lines in ``changed`` came or went, and ``rehashed``: whether a node was worked out anew.

    Of ``df`` only the lines of leaves that changed are hashed into leaves, and
    of the nodes above only those on their paths. ``tree`` is read again for
    each level: store it before.
    """
    touched = changed.select(F.substring(F.sha2(changed_line, 256), 1, depth).alias("prefix")).filter("prefix is not null").distinct()
    own = df.withColumn("__prefix", F.substring(F.sha2(line, 256), 1, depth)).join(touched.withColumnRenamed("prefix", "__prefix"), "__prefix", "left_semi")
    nodes = _leaves(own, line, depth)
    out = []
    for level in range(depth, -1, -1):
        at = tree.filter(F.col("level") == level).select("prefix", "digest", "n")
        old = at.join(touched, "prefix", "left_anti")
        out.append(old.withColumn("rehashed", F.lit(False)).unionByName(nodes.withColumn("rehashed", F.lit(True))).withColumn("level", F.lit(level)))
        if level:
            touched = touched.select(F.substring("prefix", 1, level - 1).alias("prefix")).distinct()
            around = old.withColumn("__up", F.substring("prefix", 1, level - 1)).join(touched.withColumnRenamed("prefix", "__up"), "__up", "left_semi").drop("__up")
            nodes = _parents(around.unionByName(nodes), level - 1)
    tree = out[0]
    for more in out[1:]:
        tree = tree.unionByName(more)
    return tree.select("level", "prefix", "digest", "n", "rehashed")


def single_valued(df: DataFrame, columns: list[str]) -> DataFrame:
    """Column, n_values and ok (exactly one value; null is a value, and no row is a failure)."""
    row = df.agg(*((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns))
    return row.unpivot([], columns, "column", "n_values").select("column", F.coalesce("n_values", F.lit(0)).alias("n_values"), (F.coalesce("n_values", F.lit(0)) == 1).alias("ok"))


def duplicate_content(df: DataFrame, digest: Column, key: str) -> DataFrame:
    """Digest, first key and number of rows of everything that is there twice."""
    return df.groupBy(digest.alias("digest")).agg(F.min(key).alias("first"), F.count("*").alias("n")).filter("n > 1")


def trajectory_metrics(pred: DataFrame, truth: DataFrame, by: str = "episode_id", threshold: float = 0.05) -> DataFrame:
    """Ade, fde, hit_rate and mse for each episode of points(by, t, joint, xyz); only the last frame counts for fde."""
    both = pred.select(by, "t", "joint", F.col("xyz").alias("p")).join(truth.select(by, "t", "joint", F.col("xyz").alias("q")), [by, "t", "joint"])
    both = both.select(by, "t", arrays.vector_l2(F.col("p"), F.col("q")).alias("err"), arrays.vector_mse(F.col("p"), F.col("q")).alias("mse"))
    return displacement(both, by, "t", F.col("err"), threshold, F.col("mse"))


def displacement(df: DataFrame, by: str, t: str, err: Column, threshold: float = 0.05, mse: Column | None = None) -> DataFrame:
    """D6 from errors: sums for each frame, then for each episode, so an episode's frames need not meet in one task."""
    mse = err * err if mse is None else mse
    frames = df.groupBy(by, t).agg(F.sum(err).alias("e"), F.sum((err < threshold).cast("long")).alias("hit"), F.sum(mse).alias("m"), F.count("*").alias("n"))
    return frames.groupBy(by).agg((F.sum("e") / F.sum("n")).alias("ade"), F.max_by(F.col("e") / F.col("n"), t).alias("fde"), (F.sum("hit") / F.sum("n")).alias("hit_rate"), (F.sum("m") / F.sum("n")).alias("mse"))


def overall(scores: DataFrame, columns: list[str]) -> DataFrame:
    """Plain means over episodes."""
    return scores.agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("n"))


def latent_metrics(pairs: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Mse, l2, smooth_l1 and cosine_distance (1 less the mean similarity) over rows of two vectors."""
    p, q = F.col(pred), F.col(truth)
    return pairs.agg(F.avg(arrays.vector_mse(p, q)).alias("mse"), F.avg(arrays.vector_l2(p, q)).alias("l2"), F.avg(arrays.vector_smooth_l1(p, q)).alias("smooth_l1"), (1 - F.avg(arrays.vector_cosine(p, q))).alias("cosine_distance"))


def global_mean(value: Column, weight: Column) -> Column:
    """An aggregate, the weighted mean; null unless the weights sum to more than 0."""
    return F.when(F.sum(weight) > 0, F.try_divide(F.sum(value * weight), F.sum(weight)))


def run_performance(logs: DataFrame, epoch: str, samples: Column, seconds: Column, memory: Column) -> DataFrame:
    """For each epoch samples, the slowest worker's seconds (1e-9 at least), samples per second, peak memory and ok (some sample)."""
    rows = logs.groupBy(epoch).agg(F.sum(samples).alias("samples"), F.greatest(F.max(seconds), F.lit(1e-9)).alias("seconds"), F.max(memory).alias("peak_memory"))
    return rows.withColumns({"rate": F.col("samples") / F.col("seconds"), "ok": F.col("samples") > 0})


def masked_mean(value: Column, mask: Column | None = None) -> Column:
    """An aggregate, the mean of valid values, 0 if none is; without a mask the plain mean."""
    if mask is None:
        return F.avg(value)
    return F.sum(F.when(mask, value).otherwise(0.0)) / F.greatest(F.sum(mask.cast("double")), F.lit(1e-6))


def infer_width(df: DataFrame, column: str, order: str, first: int = 256) -> DataFrame:
    """The size of the first vector that is there, among the ``first`` rows in order."""
    return df.orderBy(order).limit(first).filter(F.size(column) > 0).agg(F.min_by(F.size(column), order).alias("width"))


def split_summary(df: DataFrame, group: str, key: str, split: str = "split") -> DataFrame:
    """For each split rows, groups, additive digests of groups and keys, and how many of its groups another split has."""
    per_group = df.groupBy(split, group).agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"))
    shared = per_group.groupBy(group).agg(F.count("*").alias("k"))
    rows = per_group.join(shared, group)
    return rows.groupBy(split).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.sum((F.col("k") > 1).cast("long")).alias("n_shared_groups"), digests.additive_digest(F.col(group).cast("string")).alias("groups_digest"), F.concat_ws(":", F.sum("n").cast("string"), F.sum("s").cast("string")).alias("keys_digest"))


def experiment_summary(epochs: DataFrame, epoch: str, scores: list[str], by: str, policy: str = "best") -> DataFrame:
    """The last epoch, the selected one and the scores of both. ``policy`` as in E9: best and validation select the least score, the earlier of equal ones, last the last epoch."""
    if policy not in ("best", "validation", "last"):
        raise ValueError(f"unknown policy {policy!r}")
    good = F.when(~F.isnan(F.col(by)), F.struct(F.col(by), F.col(epoch)))
    pick = lambda c: F.max_by(c, epoch) if policy == "last" else F.min_by(c, good)
    return epochs.agg(F.count("*").alias("n_epochs"), F.max(epoch).alias("last_epoch"), pick(epoch).alias("selected_epoch"), *(pick(s).alias(f"selected_{s}") for s in scores), *(F.max_by(s, epoch).alias(f"last_{s}") for s in scores))


def curve_points(epochs: DataFrame, epoch: str, columns: list[str]) -> DataFrame:
    """Epoch, series, value for each column; what isn't finite is null."""
    long = epochs.select(epoch, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(epoch, columns, "series", "value")
    return long.withColumn("value", F.when(arrays.finite(F.col("value")), F.col("value")))


def bundle_totals(df: DataFrame, size: Column, complete: Column) -> DataFrame:
    """Rows, bytes, how many are complete and how many aren't; the last two add up to the rows."""
    return df.agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.count_if(complete).alias("complete"), F.count_if(~F.coalesce(complete, F.lit(False))).alias("missing"))


