"""Tables in the folder that driver and executors share, to end a plan's lineage so that it survives lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it names none, a session on one machine gets a temporary folder; on a
    cluster that is an error, as executors would write to disks that others cannot read."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparkweave-shared-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs in here delete their shuffle files when they end, as nothing reads them once their result is written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Rows of a file, where a table's size is known before it is written.
FILE_ROWS = 200_000


def cut(df: DataFrame, what: str = "cut", rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back. `rows`, a bound of its size, keeps a small table in
    few files, so that rounds over it do not pay for partitions that are made for large ones."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkweave/{what}-{uuid.uuid4().hex}"
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    with own_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, when nothing that is still to run reads them."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.table_folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def cut_counted(df: DataFrame, what: str = "cut", rows: int | None = None) -> tuple[DataFrame, int]:
    """cut(), and how many rows were written (counted while they were)."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")), what, rows)
    return out, seen.get["n"] or 0
