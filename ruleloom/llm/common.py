"""Helpers shared by the corpus operators: tables, shared storage, text."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none a temporary folder is set, on a local master
    only: on a cluster the executors' folders are not the driver's.
    """
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="ruleloom-"))
    return context.getCheckpointDir().get()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike ``checkpoint()`` this computes the plan once, and unlike a cache it
    survives lost executors.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_written_to", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Parts into which a join deals the rows of one key.
SALTS = 8


def salted_join(rows: DataFrame, lines: DataFrame, key: str, line_key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one line of their key, by any distribution of keys.

    A key may hold most of the rows (the hub of a component, the texts without
    words): its rows are dealt into ``SALTS`` parts in turn, and every line goes
    to each part.  Lines are narrow and unique by key.
    """
    dealt = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copied = lines.withColumn("__part", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return dealt.join(copied, (F.col(key) == F.col(line_key)) & (F.col("__salt") == F.col("__part")), how).drop("__salt", "__part")
