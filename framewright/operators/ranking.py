"""Global positions, seeded orders, subsets, splits and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_key(key: Column, seed: int) -> Column:
    """What a seeded order sorts by, 64 hex digits of seed and key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def global_rank(df: DataFrame, order: list[Column], bucket: Column, out: str = "position") -> DataFrame:
    """``df`` with each row's place from 0 in a total order that begins with ``bucket``.

    Rows are numbered inside a bucket, and a bucket's start comes from the
    small table of bucket counts, so no task sees all rows.
    """
    df = df.withColumn("__bucket", bucket)
    counts = df.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__bucket", before.alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    return df.withColumn("__in", inside).join(starts, df["__bucket"].eqNullSafe(starts["__bucket"])).withColumn(out, (F.col("__start") + F.col("__in")).cast("long")).drop("__bucket", "__start", "__in")


#: Rows that a bucket of numbers is to hold.
BUCKET_ROWS = 1_000_000


def number_bucket(df: DataFrame, column: str, cuts: int = 64) -> Column:
    """Buckets of about ``BUCKET_ROWS`` rows for the natural order of a number, as many as the table needs.

    One aggregate reads the count and ``cuts`` even quantiles, which become
    literals; between two quantiles buckets are of even width.
    """
    row = df.agg(F.count(column), F.min(column), F.max(column), F.percentile_approx(column, [i / cuts for i in range(1, cuts)], 1000)).first()
    inner = sorted(set(row[3] or []))
    edges = [row[1], *inner, row[2]]
    bucket = F.lit(0)
    for cut in inner:
        bucket = bucket + (F.col(column) > F.lit(cut)).cast("int")
    steps = max(1, -(-row[0] // (cuts * BUCKET_ROWS)))
    if steps == 1:
        return bucket
    low, high = (F.get(F.array(*(F.lit(e).cast("double") for e in edges)), bucket + k) for k in (0, 1))
    step = F.floor(F.coalesce(F.try_divide((F.col(column).cast("double") - low) * steps, high - low), F.lit(0.0)))
    return bucket * F.lit(steps).cast("long") + F.greatest(F.lit(0), F.least(step, F.lit(steps - 1)))


def seeded_rank(df: DataFrame, key: str, seed: int, out: str = "position") -> DataFrame:
    """Each row's place in the seeded order; the bucket is the key's first three hex digits."""
    df = df.withColumn("__seeded", seeded_key(F.col(key), seed))
    return global_rank(df, [F.col("__seeded"), F.col(key)], F.substring("__seeded", 1, 3), out).drop("__seeded")


def keep_first(df: DataFrame, identity: Column, order: list[Column]) -> DataFrame:
    """The first row of each identity."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(identity).orderBy(*order))).filter("__nth = 1").drop("__nth")


def group_balanced_subset(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows, in rounds over the groups: each gives its k-th row before any gives its next.

    The last round is found in one pass over the histogram of group counts, so
    only its rows are sorted.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))
    # Rounds up to a size give all rows of smaller groups, and one row a round of every group from that size on.
    upwards = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"less": F.coalesce(F.max("size").over(upwards), F.lit(0)), "before": F.coalesce(F.sum(F.col("size") * F.col("groups")).over(upwards), F.lit(0)), "from": F.sum("groups").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))})
    rounds = F.least("size", F.floor((n - F.col("before")) / F.col("from")))
    reached = F.when(F.col("before") + F.col("less") * F.col("from") <= n, F.struct(rounds.alias("low"), (n - F.col("before") - rounds * F.col("from")).alias("rest")))
    row = sizes.agg(F.coalesce(F.sum(F.col("size") * F.col("groups")), F.lit(0)).alias("total"), F.max(reached).alias("last")).first()
    if not 0 <= n <= row["total"]:
        raise ValueError(f"{n} rows of {row['total']}")
    low, rest = row["last"] or (0, 0)
    rows = df.withColumn("__round", F.row_number().over(Window.partitionBy(group).orderBy(seeded_key(F.col(key), seed), F.col(key))))
    whole = rows.filter(F.col("__round") <= low)
    part = rows.filter(F.col("__round") == low + 1).orderBy(seeded_key(F.col(group), seed), group).limit(rest)
    return whole.unionByName(part).drop("__round") if rest else whole.drop("__round")


def group_split(df: DataFrame, group: str, ratio: float, seed: int) -> DataFrame:
    """``df`` with split: whole groups to train or test, the seeded prefix of groups nearest to the ratio.

    The target is clamped to leave both sides a row; the last group is never
    in train; of equally near cuts the smaller one is taken.
    """
    key = F.coalesce(seeded_key(F.col(group), seed), F.lit(""))
    groups = df.groupBy(group).agg(F.count("*").alias("n")).select(key.alias("key"), "n").withColumn("bucket", F.substring("key", 1, 3)).persist()
    try:
        # Down to the bucket in which the target falls, by the sums of 4096 of them; only its groups are sorted.
        sums = sorted(groups.groupBy("bucket").agg(F.sum("n"), F.count("*")).collect())
        if sum(s[2] for s in sums) < 2:
            raise ValueError("a split needs two groups")
        total = sum(s[1] for s in sums)
        target = max(1, min(int(total * ratio), total - 1))
        before = 0
        for bucket, rows, _ in sums:
            if before + rows >= target:
                break
            before += rows
        cut = F.sum("n").over(Window.partitionBy("bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(before)
        # The last of all groups has the cut ``total``; the end of the bucket before is a cut, too.
        inside = groups.filter(F.col("bucket") == bucket).select("key", cut.alias("cut")).filter(F.col("cut") < total)
        best = inside.agg(F.min(F.struct(F.abs(F.col("cut") - target).alias("off"), "cut", "key"))).first()[0]
    finally:
        groups.unpersist()
    if best is None or before and target - before <= best["off"]:
        train = F.substring(key, 1, 3) < bucket
    else:
        train = key <= best["key"]
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def split_bounds(total: int, bounds: tuple | None = None, ratio: float = 0.9) -> tuple[int, int]:
    """E5: where train and test end. Floats are shares, ints are places; with two rows or more neither side is empty."""
    if total <= 1:
        return total, total
    if bounds is None:
        return max(1, min(int(total * ratio), total - 1)), total
    a, b = bounds[:2]
    if isinstance(a, float) or isinstance(b, float):
        if not (0 <= a <= 1 and 0 <= b <= 1):
            raise ValueError(f"shares are from 0 to 1, not {bounds}")
        a, b = int(total * a), int(total * b)
    a = max(0, min(a, total)) or max(1, min(int(total * ratio), total - 1))
    b = max(a, min(b, total))
    if b <= a:
        b = total
    a = max(1, min(a, b - 1, total - 1))
    return a, max(a + 1, min(b, total))


def ordinal_split(df: DataFrame, order: str, bounds: tuple | None = None, ratio: float = 0.9) -> DataFrame:
    """E5: rows before the first bound are train, those before the second test; others go. ``order`` is a distinct number."""
    a, b = split_bounds(df.count(), bounds, ratio)
    placed = global_rank(df, [F.col(order)], number_bucket(df, order))
    return placed.filter(F.col("position") < b).withColumn("split", F.when(F.col("position") < a, "train").otherwise("test"))


def modulo_shard(df: DataFrame, order: str, n: int, i: int) -> DataFrame:
    """Every ``n``-th row in order from ``i``."""
    return global_rank(df, [F.col(order)], number_bucket(df, order)).filter(F.col("position") % n == i)


def hash_shard(key: Column, n: int) -> Column:
    """A shard from the first 8 bytes of SHA-256, big end first."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("int")


def locate_offset(wanted: DataFrame, lengths: DataFrame, key: str, span: int = 4096) -> DataFrame:
    """``wanted(index)`` with the key and offset of the sequence that holds it; ``lengths(key, n)`` are laid end to end in key order.

    A sequence stands in every cell of ``span`` places that it touches, so the
    lookup is an equi-join on the cell and then a filter.
    """
    counted = lengths.withColumn("__bucket", number_bucket(lengths, key))
    sums = counted.groupBy("__bucket").agg(F.sum("n").alias("__n"))
    starts = sums.select("__bucket", F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = F.sum("n").over(Window.partitionBy("__bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    laid = counted.withColumn("__in", inside).join(starts, "__bucket").withColumn("__end", F.col("__start") + F.col("__in")).filter("n > 0")
    laid = laid.select(key, (F.col("__end") - F.col("n")).alias("__from"), "__end")
    cells = laid.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__from") / span), F.floor((F.col("__end") - 1) / span))))
    hit = wanted.withColumn("__cell", F.floor(F.col("index") / span)).join(cells, "__cell").filter("index >= __from and index < __end")
    return hit.withColumn("offset", F.col("index") - F.col("__from")).drop("__cell", "__from", "__end")


def first_n_per_worker(df: DataFrame, worker: str, order: list[Column], n: int) -> DataFrame:
    """the first ``n`` rows of each worker's shard; 0 means all."""
    if n == 0:
        return df
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(worker).orderBy(*order))).filter(F.col("__nth") <= n).drop("__nth")


def preview(df: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    """the first ``n`` rows in order."""
    return df.orderBy(*order).limit(n)


def preview_text(df: DataFrame, column: str, n: int = 2) -> DataFrame:
    """one row: the first ``n`` values in order and how many more there are."""
    first = df.select(column).orderBy(column).limit(n).agg(F.array_join(F.array_sort(F.collect_list(F.col(column).cast("string"))), ", ").alias("shown"), F.count("*").alias("k"))
    total = df.agg(F.count("*").alias("total"))
    more = F.col("total") - F.col("k")
    return first.join(total).select(F.when(more > 0, F.concat(F.col("shown"), F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(F.col("shown")).alias("preview"))


def latest_valid(df: DataFrame, name: str, valid: Column, explicit: str | None = None) -> DataFrame:
    """the name with the largest epoch among valid rows, -1 if it states none; an explicit name is taken as it is."""
    if explicit is not None:
        return df.filter(F.col(name) == explicit).select(name).distinct()
    epoch = F.coalesce(F.regexp_extract(name, r"epoch[_-]?(\d+)", 1).try_cast("int"), F.lit(-1))
    return df.filter(valid).agg(F.max(F.struct(epoch.alias("epoch"), F.col(name).alias("name"))).alias("x")).select(F.col("x.name").alias(name), F.col("x.epoch").alias("epoch"))
