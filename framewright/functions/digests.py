"""Content digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_digest(value: Column) -> Column:
    """SHA-256 of a text or bytes, in small hex."""
    return F.sha2(value, 256)


def json_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of named values: sorted names, no spaces, nulls kept, Unicode as it is."""
    row = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def set_digest(line: Column) -> Column:
    """D3, exact: an aggregate, SHA-256 of all lines in order. One array holds them: up to about a million lines."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256)


def additive_digest(line: Column) -> Column:
    """D3 at any size: an aggregate, count and sum of 60-bit slices of each line's SHA-256, joined by a colon."""
    part = F.conv(F.substring(F.sha2(line, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.concat_ws(":", F.count(line).cast("string"), F.coalesce(F.sum(part), F.lit(0)).cast("string"))
