"""Where iterative jobs keep what they cut from their lineage, and tables that several branches of a query read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for a local session that has none."""
    context = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="siteloom-"))
    return ensure_checkpoint_dir(spark)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key over a few tasks a core: rows of few bytes lie in few parts of a file, however much work each makes later on."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), key)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: what made it runs once however many branches read it.

    Rows that are alike make small files, from whose size a plan takes many rows for few and sends them to every task through the
    driver. So joins of what is read back sort and merge.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def written_by(df: DataFrame, key: str, label: str, buckets: int | None = None) -> DataFrame:
    """df as a table in buckets by a hash of the key: later groupings, windows and joins by the key alone need no exchange. One exchange writes it."""
    spark = df.sparkSession
    n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark)}/{name}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that written() or written_by() made and that no later plan reads."""
    for file in df.inputFiles()[:1]:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
