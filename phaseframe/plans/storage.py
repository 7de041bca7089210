"""Stage results in the shared folder: what several steps read is computed once, and no plan grows with the steps before it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame


def shared_folder(spark) -> str:
    """spark.checkpoint.dir; where it is unset, a session on one machine gets a folder, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="phaseframe-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read back; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """rows dealt by keys over as many partitions as shuffles have at most: small groups that take long are not put together
    by their size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Rows of a partition where `dealt` deals them out, and the fewest for which there is one more.
MOST, LEAST = 1 << 18, 1 << 14


def dealt(rows: DataFrame, count: int, *keys: str | Column) -> DataFrame:
    """rows dealt by keys over as many partitions as `count` rows ask for: what a task sorts and groups stays the same size
    however many rows there are, whatever number of partitions shuffles have otherwise."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, min(usual, count // LEAST), -(-count // MOST)), *keys)
