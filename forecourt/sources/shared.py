"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, removed with the session; a temporary one only under a local master where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not root and made.isDefined():
        root = made.get()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="forecourt-")
        atexit.register(shutil.rmtree, root, True)
        return f"{root}/{uuid.uuid4().hex}"
    home = f"{root}/{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return home


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Shuffle files go with the end of the query that wrote them.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Writes in here leave no shuffle files; else these stand beside what was written until the driver collects its garbage."""
    held = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANED) if held is None else spark.conf.set(_CLEANED, held)


#: The JVM never compiles a method of more bytes than this; it interprets it.
_METHOD_LIMIT, _COMPILED_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"


def stored(rows: DataFrame, compiled: bool = False) -> DataFrame:
    """Rows written once as Parquet and read back: for what several plans read and is dear to compute.

    A lost executor then costs no recomputation of what stands below. ``compiled`` is for wide
    rows of many expressions: while they are written, operators whose common method is too long
    for the JVM to compile go through one method each.
    """
    spark = rows.sparkSession
    path, held = f"{scratch(spark)}/rows", spark.conf.get(_METHOD_LIMIT, None)
    if compiled:
        spark.conf.set(_METHOD_LIMIT, _COMPILED_BYTES)
    try:
        rows.write.parquet(path)
    finally:
        if compiled:
            spark.conf.unset(_METHOD_LIMIT) if held is None else spark.conf.set(_METHOD_LIMIT, held)
    return spark.read.schema(rows.schema).parquet(path)
