"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: \x20 and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null becomes the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local master may fall back to a fresh temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    global _LOCAL
    if _LOCAL is None:
        _LOCAL = tempfile.mkdtemp(prefix="ontoloom-")
    return _LOCAL


_LOCAL: str | None = None


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them back."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files (and the name) of tables that `written` or `bucketed` made and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        name = folder.rpartition("/")[2]
        if name.startswith("ontoloom_"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Like `written`, but in buckets of `key`: later joins on the key leave these rows where they are and move the other side only."""
    spark, name = df.sparkSession, f"ontoloom_{uuid.uuid4().hex}"
    n = shuffle_partitions(spark)
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def whole_id(name: str) -> list[Column]:
    """The id without nulls, and `none` where it was null: pandas would turn a column of longs with nulls into floats and lose digits."""
    return [F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name), F.col(name).isNull().alias("none")]


def id_again(name: str) -> Column:
    return F.when(~F.col("none"), F.col(name)).alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def small_batches(spark: SparkSession, rows: int, megabytes: int = 16) -> Iterator[None]:
    """Actions inside send Python at most so many rows and bytes at a time; for rows that hold whole texts or sets."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": megabytes << 20}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, n in wanted.items():
        spark.conf.set(k, n)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of frames that are no longer referenced; it follows the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
