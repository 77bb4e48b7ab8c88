"""What the training-data operators share: tables, folds, ASCII words, durable tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: the ASCII white space that separates words, as a Java character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % F.lit(folds)


def in_fold(doc_id: str | Column, folds: int, which: int) -> Column:
    """Whether a row is in a fold; a null id is in none."""
    return F.coalesce(fold(doc_id, folds) == which, F.lit(False))


def _root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a fresh one only under a local master where none is set."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="checkpoints-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def stored(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """Write a frame as Parquet in the shared folder and read it back; also the folder, for ``remove``.

    This cuts the lineage: a lost executor costs no recomputation of what stands
    below, and a frame that is read twice is computed once. The folder is removed
    when the driver ends.
    """
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    except Exception:  # noqa: BLE001 - a store without delete-on-exit keeps the table
        pass
    return spark.read.schema(df.schema).parquet(path), path


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """A frame whose rows stand in the shared folder."""
    return stored(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
