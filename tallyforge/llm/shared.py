"""Reading inputs, tables that cut lineage in the folder all executors share, and passes through
Python whose batches are bounded in bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch of rows on its way to a worker and rows of one that is read from Parquet: with
#: Spark's own 10,000 and 4096 rows, both grow with the length of the texts.
BATCH_BYTES, READ_ROWS = 2 << 20, 512
#: Bytes of a Parquet row group of a written table, all of which a writer holds.
ROW_GROUP = 8 << 20
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's bounds, unless it has smaller ones."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        have = spark.conf.get(key)
        if not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(key, str(most))


def in_python(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow``, in batches of about ``BATCH_BYTES``; a longer text is a batch by itself."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """This application's part of ``spark.checkpoint.dir``. Where that is unset, a temporary folder
    in local mode, as in tests; on a cluster no such folder would be shared, so it is an error."""
    app, folder = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return f"{folder.rstrip('/')}/tallyforge/{app}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tallyforge-")
    return "file://" + _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back: the lineage ends
    there, and a lost executor costs a reread of that table and no earlier stage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    bound_batches(spark)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def clean(spark: SparkSession) -> None:
    """Deletes every table that this application has written with ``save``."""
    remove(spark, shared_dir(spark))
