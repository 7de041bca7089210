"""Session and storage helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path is read by Spark alone, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where it is unset, a session on one machine
    (as in tests) gets one of its own; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="phaseframe-"))
    return context.getCheckpointDir()


def files_for(df: DataFrame, rows: int, rows_a_file: int = 20_000) -> int:
    """Files for a table of about so many rows: enough for all cores and for tables of any size, no more."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, rows // rows_a_file)


_written: dict[DataFrame, str] = {}


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def materialize(df: DataFrame, most_files: int | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage and survives lost executors.

    The table goes with release(), or when the application ends.
    """
    spark = df.sparkSession
    if most_files is not None:
        df = df.coalesce(most_files)
    path = f"{shared_dir(spark)}/phaseframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes materialized tables that nothing will read any more."""
    for df in tables:
        path = _written.pop(df, None)
        if path is not None:
            files, place = _file_system(df.sparkSession, path)
            files.delete(place, True)


#: Rows and bytes that go to Python at once, where the session does not say: the default would hold 10,000 whole texts.
BATCH_ROWS, BATCH_BYTES = 1_000, "4m"


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after small Arrow batches have been set in its session (settings that are there stay)."""
    conf = df.sparkSession.conf
    for name, usual, ours in (("maxRecordsPerBatch", "10000", str(BATCH_ROWS)), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if conf.get(name, usual) == usual:
            conf.set(name, ours)
    return df


def fold_of(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % modulus


def whole_id(df: DataFrame, id_col: str) -> Column:
    """An id column as long; an error where its type isn't an integer one."""
    kind = df.schema[id_col].dataType
    if not isinstance(kind, IntegralType):
        raise ValueError(f"{id_col} must be of an integer type, not {kind.simpleString()}")
    return F.col(id_col).cast("long")
