"""What the operators of this subpackage share: words, staged tables, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: A side of a join is broadcast only after a count has shown that it has no more rows than this.
BROADCAST_ROWS = 50_000


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the session names none, that of SparkContext.setCheckpointDir; with neither, a temporary
    folder in local mode (tests), where there is one machine, and an error on a cluster.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    set_before = context._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get()
    if not context._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ledgerloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that no later action reads."""
    spark = df.sparkSession
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a count shows at most `rows` rows."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """broadcast(df) if a count shows at most `rows` rows; otherwise df, for a shuffled join."""
    return F.broadcast(df) if is_small(df, rows) else df
