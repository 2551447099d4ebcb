"""What became of each row of a plan, and of the run."""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from framewright.sources.files import append_failures

#: What can become of a row.
OUTCOMES = ("saved", "skipped", "rebuilt", "failed")
#: Characters of a trace that the log keeps.
TRACE = 2000


@dataclass(frozen=True)
class Outcome:
    """How many rows of a run were saved, skipped, rebuilt and failed; a row that was rebuilt isn't counted as saved."""

    saved: int = 0
    skipped: int = 0
    rebuilt: int = 0
    failed: int = 0

    @property
    def exit_code(self) -> int:
        """What a command ends with: 1 if anything failed."""
        return int(self.failed > 0)

    def check(self) -> None:
        if self.failed:
            raise RuntimeError(f"{self.failed} of {self.saved + self.skipped + self.rebuilt + self.failed} rows failed")


def outcome_of(rows: DataFrame) -> Outcome:
    """The counts of committed rows with an ``outcome``. What a lost or repeated task attempt did isn't among them, so each row counts once."""
    return Outcome(**{r["outcome"]: r["n"] for r in rows.groupBy("outcome").agg(F.count("*").alias("n")).collect()})


def run_plan(plan: DataFrame, build: Callable[[dict], dict], schema: str, out: str, root: str = "", attempts: int = 3) -> Outcome:
    """Do what a plan (``increment.plan_increment``) says, and go on after failures.

    ``build`` gets a row that is to be built or rebuilt, as a dictionary, and
    returns one by ``schema``; if it raises it is called again, ``attempts``
    times at most, and then the row has failed. ``out/rows`` gets the plan's
    columns, outcome, tries and built, in folders by outcome; ``out/failures``
    gets failures with message and trace, host paths below ``root`` redacted.
    Spark's committer takes one attempt of each task, so the counts, which are
    read from what was committed, hold each row once.
    """
    spark = plan.sparkSession
    built = T.StructType.fromDDL(schema)
    kind = T.StructType([*plan.schema.fields, T.StructField("outcome", T.StringType()), T.StructField("tries", T.IntegerType()), T.StructField("message", T.StringType()), T.StructField("trace", T.StringType()), T.StructField("built", built)])
    arrow = to_arrow_schema(kind)

    def one(row: dict) -> dict:
        if row["status"] == "skip":
            return {"outcome": "skipped", "tries": 0}
        for k in range(1, attempts + 1):
            try:
                return {"outcome": "saved" if row["status"] == "build" else "rebuilt", "tries": k, "built": build(row)}
            except Exception as e:  # a row that can't be built is an outcome; the run goes on
                failed = {"outcome": "failed", "tries": k, "message": f"{type(e).__name__}: {e}", "trace": traceback.format_exc()[-TRACE:]}
        return failed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([row | one(row) for row in batch.to_pylist()], arrow)

    plan.mapInArrow(run, kind).write.partitionBy("outcome").parquet(f"{out}/rows")
    done = spark.read.schema(kind).parquet(f"{out}/rows")
    append_failures(done.filter("outcome = 'failed'").drop("built", "outcome"), f"{out}/failures", root)
    return outcome_of(done)
