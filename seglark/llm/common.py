"""Shared folder, table cuts and text helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: The white space that ends a word: U+0020 and U+0009 to U+000D.
SPACE = "\\x20\\x09-\\x0D"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    The setting of the session is used as it is.  Where it is unset, a folder of
    this machine is set for a session that has no other machine (master
    ``local``); on a cluster it would lose data, and so an error is raised.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="seglark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/seglark/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The lineage ends there, so that a lost executor costs one read and no
    recomputation, and values drawn before the cut cannot change after it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_written_order(df: DataFrame, name: str = "position") -> DataFrame:
    """``df`` with a number that grows in the order in which its rows were written.

    Spark reads files in any order, but a row keeps its file's number and its
    place there.  What is not a plain table of files is written first.
    """
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        df = cut(df, "ordered")
    file = F.col("_metadata.file_name")
    part, more = F.regexp_extract(file, r"^part-(\d+)", 1).cast("long"), F.regexp_extract(file, r"-c(\d+)\.", 1).cast("long")
    return df.select("*", (F.shiftleft(part, 42) + F.shiftleft(more, 32) + F.col("_metadata.row_index")).alias(name))


def drop_cut(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table from :func:`cut` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for parent in parents:
        if "/seglark/" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def ascii_lower(col: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def words_of(col: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
