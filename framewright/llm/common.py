"""What several operators share: the shared folder, stored intermediate tables, counts of text bytes."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset and
    driver and executors are one process (tests) a new local folder is made and
    set; on a cluster that would lose what other machines write.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="framewright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage and survives lost executors."""
    return _written(df, shared_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables of one run, deleted together once what was made of them is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = shared_path(spark, name)
        self.tables: list[str] = []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{self.path}/{name}-{uuid.uuid4().hex}")

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """Stored outside, so that it stays."""
        return stored(df, name)

    def table(self, name: str) -> str:
        """A new name for a table whose files lie below ``path``."""
        self.tables.append(f"{name}_{uuid.uuid4().hex}")
        return self.tables[-1]

    def clear(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a batch between Spark and Python: texts are long, and both sides hold a batch several times over.
BATCH_ROWS = 1000


def smaller_batches(spark: SparkSession) -> None:
    """From now on the session sends ``BATCH_ROWS`` rows at a time to Python at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """The number of partitions that this session shuffles to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def document_key() -> F.Column:
    """What stands for a document: its doc_id; without one, a number below any id from a hash of the text, so that such rows don't all share a key."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)) + F.shiftrightunsigned(F.xxhash64("text"), 2))


def text_bytes(column: str = "text"):
    """UTF-8 bytes of a text, none for null."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0))
