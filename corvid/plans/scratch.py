"""Where a plan writes the intermediate tables that cut its lineage.

The folder is the one the cluster names in ``spark.checkpoint.dir``; every
executor and the driver share it, so a lost executor costs only the tasks
that were running. Where the setting is missing and the master is local (tests, a
laptop) a temporary folder is made once for each Spark application.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="corvid-")
    return _own[app]


def materialise(df: DataFrame, label: str, *parts: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in folders by ``parts``, and read it back.

    The reader knows the table's size, so Spark itself decides from a checked
    size whether a later join broadcasts it.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/corvid-{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path) if parts else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(table: DataFrame, *parts: str) -> None:
    """Delete a table that ``materialise`` wrote, or some of its folders, once no later step reads it."""
    jvm, spark = table.sparkSession.sparkContext._jvm, table.sparkSession
    for part in parts or ("",):
        path = jvm.org.apache.hadoop.fs.Path(f"{table.scratch_path}/{part}".rstrip("/"))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of ``columns`` has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    Its cleaner deletes them once the driver's garbage collector finds that
    nothing refers to them, which may otherwise come hours later. The second
    round finds what Python let go in the first.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.java.lang.System.gc()
        time.sleep(0.5)
