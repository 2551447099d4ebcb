"""Scans along the rows of a key when one key may have more rows than one task should take.

A scan has two levels. The rows of hot keys are range-partitioned by key and
order and stored with the number of their range; a window then runs inside
each (key, range), and what a range takes from those before or behind it is
carried by a window over the small table of ranges. Keys with fewer rows go
through one window each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.sources.shared import stored, width

#: Rows of a key that one window takes.
HOT_ROWS = 1_000_000
#: Hot keys that are named in a filter; with more of them all rows are scanned in ranges.
NAMED_KEYS = 1_000


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def divided(df: DataFrame, by: str) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of keys with up to ``HOT_ROWS`` rows, and those of hot keys; None where there are none. Counts keys once."""
    hot = [r[0] for r in df.groupBy(by).agg(F.count("*").alias("__n")).filter(F.col("__n") > HOT_ROWS).limit(NAMED_KEYS + 1).select(by).collect()]
    if not hot:
        return df, None
    if len(hot) > NAMED_KEYS:
        return None, df
    is_hot = is_one_of(F.col(by), hot)
    return df.filter(~is_hot), df.filter(is_hot)


def is_one_of(key: Column, values: list) -> Column:
    """Whether a key is among values, null too."""
    found = F.coalesce(key.isin([v for v in values if v is not None]), F.lit(False))
    return found | key.isNull() if None in values else found


def in_ranges(df: DataFrame, by: str, order: list) -> DataFrame:
    """``df`` stored with ``__range``, which rises along ``order`` inside each key: about as many rows in each as a task's share."""
    parts = width(df.sparkSession)
    return stored(df.repartitionByRange(parts, by, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def carried(rows: DataFrame, by: str, edges: dict[str, Column], totals: dict[str, tuple[Column, str]]) -> DataFrame:
    """``rows`` with columns that hold, for the row's range, what the ranges of its key before it (or behind it) come to.

    ``edges`` are aggregates over a range, ``totals`` windowed expressions over
    them: (expression, ``before`` or ``behind``).
    """
    ranges = rows.groupBy(F.col(by).alias("__scan_by"), F.col("__range").alias("__scan_of")).agg(*(c.alias(name) for name, c in edges.items()))
    along = {"before": Window.partitionBy("__scan_by").orderBy("__scan_of").rowsBetween(Window.unboundedPreceding, -1), "behind": Window.partitionBy("__scan_by").orderBy(F.desc("__scan_of")).rowsBetween(Window.unboundedPreceding, -1)}
    ranges = ranges.select("__scan_by", "__scan_of", *(c.over(along[side]).alias(name) for name, (c, side) in totals.items()))
    return rows.join(ranges, same(F.col(by), F.col("__scan_by")) & (F.col("__range") == F.col("__scan_of")), "left").drop("__scan_by", "__scan_of")


def numbered(df: DataFrame, by: str, order: list, out: str) -> DataFrame:
    """``df`` with each row's place from 0 among those of its key; ``order`` has to be total."""
    cold, hot = divided(df, by)
    parts = []
    if cold is not None:
        parts.append(cold.withColumn(out, (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("long")))
    if hot is not None:
        rows = carried(in_ranges(hot, by, order), by, {"__n": F.count("*")}, {"__start": (F.sum("__n"), "before")})
        inside = F.row_number().over(Window.partitionBy(by, "__range").orderBy(*order)) - 1
        parts.append(rows.withColumn(out, (F.coalesce("__start", F.lit(0)) + inside).cast("long")).drop("__start", "__range"))
    return reduce(DataFrame.unionByName, parts)


def least_before(df: DataFrame, by: str, order: str, value: Column, out: str) -> DataFrame:
    """``df`` with the least value of the rows of its key before it, null if there is none."""
    cold, hot = divided(df, by)
    parts = []
    if cold is not None:
        parts.append(cold.withColumn(out, F.min(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))))
    if hot is not None:
        rows = carried(in_ranges(hot, by, [order]), by, {"__low": F.min(value)}, {"__least": (F.min("__low"), "before")})
        inside = F.min(value).over(Window.partitionBy(by, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
        parts.append(rows.withColumn(out, F.least(F.col("__least"), inside)).drop("__least", "__range"))
    return reduce(DataFrame.unionByName, parts)


def neighbours(points: DataFrame, by: str, key: str, low: str, high: str) -> DataFrame:
    """``points`` (distinct by key) with ``left``, the last ``high`` that isn't null up to a row, and ``right``, the first ``low`` from it on."""
    cold, hot = divided(points, by)
    back = lambda w: w.orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    on = lambda w: w.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    if cold is not None:
        w = Window.partitionBy(by)
        parts.append(cold.withColumns({"left": F.last(high, ignorenulls=True).over(on(w)), "right": F.last(low, ignorenulls=True).over(back(w))}))
    if hot is not None:
        there = lambda c: F.when(F.col(c).isNotNull(), F.col(key))
        edges = {"__first": F.min_by(low, there(low)), "__last": F.max_by(high, there(high))}
        rows = carried(in_ranges(hot, by, [key]), by, edges, {"__left": (F.last("__last", ignorenulls=True), "before"), "__right": (F.last("__first", ignorenulls=True), "behind")})
        w = Window.partitionBy(by, "__range")
        rows = rows.withColumns({"left": F.coalesce(F.last(high, ignorenulls=True).over(on(w)), "__left"), "right": F.coalesce(F.last(low, ignorenulls=True).over(back(w)), "__right")})
        parts.append(rows.drop("__left", "__right", "__range"))
    return reduce(DataFrame.unionByName, parts)
