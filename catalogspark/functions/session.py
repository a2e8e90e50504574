"""Session helpers: the shared work folder, written tables that cut lineage, shipping the package to workers."""

import ctypes
import os
import tempfile
import uuid
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_A_TASK = 500_000
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that the cluster shares (spark.checkpoint.dir).

    Where the setting is absent, a local master (tests on one machine) gets a folder of this session; a cluster fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: a short lineage that survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_named(df: DataFrame, *columns: Column) -> DataFrame:
    """`rid`, a struct that names each row by its file (64-bit hash of the path) and its place there, and the columns.

    Unlike a number from partitions, it stays the same when a stored table is read again in other splits, as happens
    after executors are lost. A DataFrame that is not read from Parquet is written to the shared folder first. Columns
    of df cannot clash with `rid`, since only the given ones are taken.
    """

    def named(rows: DataFrame) -> DataFrame:
        place = rows.metadataColumn("_metadata")  # the file's, even where a column of rows has this name
        return rows.select(F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("row")).alias("rid"), *columns)

    try:
        return named(df)
    except AnalysisException:
        return named(written(df, "rows"))


def sealed(df: DataFrame) -> DataFrame:
    """df, below which no filter is pushed: a condition on a column of a long chain would otherwise carry the whole chain, several times over."""
    return df.withColumn("__n", F.monotonically_increasing_id()).filter("__n >= 0").drop("__n")


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """df dealt by keys over three tasks a core or more: a small file of rows that cost much each would otherwise be one task or few.

    rows: how many df has about, where a task that sorts or groups them shall hold ROWS_A_TASK whatever the session's settings.
    """
    spark = df.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))
    return df.repartition(tasks, *keys)


def give_back() -> None:
    """Hands memory that a Python task has freed back to the system, as idle workers would keep it beside the next stage's."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to Python workers, whatever their PYTHONPATH; once a SparkContext."""
    sc = spark.sparkContext
    if getattr(sc, "_catalogspark_shipped", False):
        return
    fd, path = tempfile.mkstemp(prefix="catalogspark-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(os.path.join(ROOT, "catalogspark")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, ROOT))
    sc.addPyFile(path)
    sc._catalogspark_shipped = True
