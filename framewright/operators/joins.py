"""Pairing, lookups, repair and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.sources.shared import width

#: Joints of a query at most.
JOINTS = 10_000


def pair_episodes(left: DataFrame, right: DataFrame, keys: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Rows of both sides with the same keys, if ``existing`` has them too; the rest goes without a word (see unmatched)."""
    pairs = left.join(right, keys)
    return pairs if existing is None else pairs.join(existing, keys, "left_semi")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys only one side has."""
    a, b = (d.select(*keys).distinct() for d in (left, right))
    sides = a.withColumn("__side", F.lit("l")).unionByName(b.withColumn("__side", F.lit("r"))).groupBy(*keys).agg(F.min("__side").alias("low"), F.max("__side").alias("high"))
    return sides.agg(F.count_if(F.col("high") == "l").alias("left_only"), F.count_if(F.col("low") == "r").alias("right_only"))


def guard_unique_key(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one value, and how many; empty is good."""
    return df.groupBy(*keys).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def priority_lookup(df: DataFrame, index: DataFrame, candidates: str, stem: str, parent: str) -> DataFrame:
    """``df`` with path: that of the first candidate folder that has the stem, else any of the stem, the same parent first, then by path; null if none.

    ``index(rel_dir, stem, parent, path)``. ``df`` has a distinct ``id``.
    """
    # The index is reduced to one path for each way to look a stem up, so a stem in many folders multiplies nothing.
    least = lambda *by: index.filter(F.col("stem").isNotNull()).groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(F.min("path").alias("__" + "_".join(by)))
    ranked = df.select("id", F.col(stem).alias("__stem"), F.posexplode(candidates).alias("rank", "__rel_dir")).join(least("rel_dir", "stem"), ["__rel_dir", "__stem"])
    first = ranked.groupBy("id").agg(F.min_by("__rel_dir_stem", "rank").alias("__first"))
    same = least("stem", "parent").withColumnRenamed("__stem", "__s")
    anywhere = index.filter(F.col("stem").isNotNull()).groupBy(F.col("stem").alias("__t")).agg(F.min("path").alias("__any"))
    out = df.join(first, "id", "left").join(same, (F.col(stem) == F.col("__s")) & F.col(parent).eqNullSafe(F.col("__parent")), "left").join(anywhere, F.col(stem) == F.col("__t"), "left")
    return out.select(*(df[c] for c in df.columns), F.coalesce("__first", "__stem_parent", "__any").alias("path"))


def reconcile(left: DataFrame, right: DataFrame, key: str, first: int = 20) -> DataFrame:
    """C4: side, key, n: the first keys that only one side has, and how many there are.

    One pass: keys of both sides meet once, each task keeps the first keys of
    its part and how many it has, and those meet by side. Null isn't a key.
    """
    both = left.select(key, F.lit("left").alias("side")).unionByName(right.select(key, F.lit("right").alias("side"))).filter(F.col(key).isNotNull())
    one = both.groupBy(key).agg(F.min("side").alias("side"), F.max("side").alias("__high")).filter(F.col("side") == F.col("__high")).drop("__high")
    one = one.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(width(left.sparkSession))))
    part, side = Window.partitionBy("side", "__part"), Window.partitionBy("side")
    shown = one.withColumns({"__nth": F.row_number().over(part.orderBy(key)), "__n": F.count("*").over(part)}).filter(F.col("__nth") <= first)
    shown = shown.withColumns({"n": F.sum(F.when(F.col("__nth") == 1, F.col("__n"))).over(side), "__nth": F.row_number().over(side.orderBy(key))})
    return shown.filter(F.col("__nth") <= first).select("side", key, F.col("n").cast("long").alias("n"))


def merge_pose_sources(sources: DataFrame, mapping: DataFrame, by: list[str]) -> DataFrame:
    """Query joints from foreign names: ``mapping(joint, source_joint, rank)``, the best rank that is there.

    ``sources(by, joint name as source_joint, kind body or hand, nth, xyz)``: a
    hand overrides a body; of equal names in a body the first counts, in a hand
    the last. A joint without any source is missing.
    """
    nth = F.when(F.col("kind") == "hand", -F.col("nth")).otherwise(F.col("nth"))
    ranked = sources.join(mapping, "source_joint")
    best = ranked.groupBy(*by, "joint").agg(F.min_by("xyz", F.struct("rank", (F.col("kind") == "body").cast("int"), nth)).alias("xyz"))
    return best


def fill_forearms(found: DataFrame, joints: DataFrame, by: list[str], fallbacks: DataFrame) -> DataFrame:
    """Every joint for every ``by``: its own point, else of ``fallbacks(joint, other, rank)`` the best there is, else zeros."""
    names = [r[0] for r in joints.select("joint").limit(JOINTS + 1).collect()]
    if len(names) > JOINTS:
        raise ValueError(f"over {JOINTS} joints")
    wanted = found.select(*by).distinct().withColumn("joint", F.explode(F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<string>")))
    other = found.select(*by, F.col("joint").alias("other"), F.col("xyz").alias("o")).join(fallbacks, "other").groupBy(*by, "joint").agg(F.min_by("o", "rank").alias("o"))
    return wanted.join(found, [*by, "joint"], "left").join(other, [*by, "joint"], "left").withColumn("xyz", F.coalesce("xyz", "o", F.array(*(F.lit(0.0),) * 3))).drop("o")


def bind_supervision(features: DataFrame, supervision: DataFrame, key: str, agree: Sequence[str]) -> DataFrame:
    """Features with bound and reasons: the same key only, and equal values in every column of ``agree``."""
    right = supervision.select(F.col(key).alias("__key"), *(F.col(c).alias(f"__{c}") for c in agree))
    both = features.join(right, features[key] == right["__key"], "left")
    rules = [F.when(F.col("__key").isNull(), F.lit("no supervision")), *(F.when(F.col("__key").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(f"{c} differs")) for c in agree)]
    return both.withColumn("reasons", F.array_compact(F.array(*rules))).withColumn("bound", F.size("reasons") == 0).drop("__key", *(f"__{c}" for c in agree))


def repair(df: DataFrame, alternates: DataFrame, key: str, valid: dict[str, Column], finally_: dict[str, Column]) -> DataFrame:
    """Each field from the row if it is valid, else from the alternate if that is, else the last resort.

    ``valid`` are conditions on the field's own name; they hold for both sides.
    """
    other = alternates.select(F.col(key), *(F.when(ok, F.col(c)).alias(f"__{c}") for c, ok in valid.items()))
    own = df.withColumns({c: F.when(ok, F.col(c)) for c, ok in valid.items()})
    out = own.join(other, key, "left")
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in valid})
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in finally_.items()}).drop(*(f"__{c}" for c in valid))


def attach_split(df: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """``df`` with its split, null where the manifest doesn't have the key. A key in two splits is an error."""
    twice = manifest.groupBy(key).agg(F.count_distinct("split").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][0]!r} is in two splits")
    return df.join(manifest.select(key, "split").distinct(), key, "left")


def stack_with_fill(df: DataFrame, other: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """Every row with its vector, zeros and mask false and length 0 where it has none; no rows if nobody has one."""
    both = df.join(other.select(key, vector), key, "left")
    full = both.withColumns({"mask": F.col(vector).isNotNull(), "length": F.coalesce(F.size(vector), F.lit(0)), vector: F.coalesce(F.col(vector), F.array_repeat(F.lit(0.0).cast("float"), width))})
    return full if not other.filter(F.col(vector).isNotNull()).isEmpty() else full.limit(0)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """G1: the keys of both sets."""
    return a.select(key).intersect(b.select(key))


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """G1: any overlap is an error."""
    if row := overlap(a, b, key).first():
        raise ValueError(f"{row[0]!r} is in both")


def group_overlap(df: DataFrame, group: Column, split: str = "split") -> DataFrame:
    """Groups, derived anew, that are in more than one split."""
    return df.groupBy(group.alias("group")).agg(F.count_distinct(split).alias("n_splits"), F.count("*").alias("n")).filter("n_splits > 1")


def union_splits(a: DataFrame, b: DataFrame, expected: int | None = None) -> DataFrame:
    """All rows; their number has to be the expected one."""
    out = a.unionByName(b)
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} rows, not {expected}")
    return out


