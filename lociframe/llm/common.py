"""Shared pieces: the word class, table access, written intermediate tables.

Defined results: null text has no words; a table without rows is written and read back with its
schema; repeated rows stay repeated.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six characters that separate words.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own.

    Only where driver and executors are one process (local mode, as in tests) is a folder made up;
    elsewhere executors would write to disks that nobody else reads, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lociframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: short lineage, known size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.__dict__["written_at"] = path
    return back


def told_apart(rows: DataFrame, value: str, h: str = "h") -> DataFrame:
    """``rows`` with other hashes ``h`` for the second and later rows of a value; the first keeps its own.

    Blocks made by hash then stay of even size where a third of all rows is one row repeated. Rows are
    numbered by split (column ``split``, the partition they were written from, is dropped) and a split
    starts after the earlier ones, so no task meets all rows of a value. Which of a value's rows gets
    which hash depends on the splits; the hashes of a value as a whole do not.
    """
    earlier = Window.partitionBy(value).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(value, "split").count().withColumn("start", F.sum("count").over(earlier)).where("start > 0").drop("count")
    nth = F.row_number().over(Window.partitionBy(value, "split").orderBy(h)) - 1
    own = rows.withColumn("nth", nth).join(starts, [value, "split"], "left").withColumn("nth", F.col("nth") + F.coalesce("start", F.lit(0)))
    return own.withColumn(h, F.when(F.col("nth") == 0, F.col(h)).otherwise(F.xxhash64(h, "nth"))).select(*(c for c in rows.columns if c != "split"))


def discard(*frames: DataFrame) -> None:
    """Delete what `written` wrote for these tables, once nothing that is still to run reads them."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.__dict__["written_at"])
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: Column) -> Column:
    """Array of the words of ``text`` (null gives an empty array)."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE))
    return F.array_remove(F.split(flat, " "), "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
