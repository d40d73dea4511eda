"""Session helpers shared by every operator."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python stages can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, str(path.relative_to(PACKAGE.parent)))
    target = Path(sc._temp_dir) / f"sylva-{uuid.uuid4().hex[:8]}.zip"
    target.write_bytes(buffer.getvalue())
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where it is set, else one below the working folder.

    The fallback serves tests on one machine; on a cluster a folder that isn't named is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = f"file://{os.path.join(os.environ.get('TMPDIR', '/tmp'), 'sylva-shared')}"
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that is removed with the application."""
    path = f"{shared_dir(spark).rstrip('/')}/sylva-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    A lost executor then costs one stage, not the whole history. The folder is removed with the application.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete what materialise() wrote for df, once no later plan reads it."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if "/sylva-" in target.toString():
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    """How many shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def relieve(spark: SparkSession) -> None:
    """Have the executors collect garbage, so that their JVMs give free heap back before the next stage of a pipeline needs other memory."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("done")).agg(F.count("done")).collect()


def give_back() -> None:
    """Return freed memory of this process to the system; workers live on from task to task."""
    import ctypes

    try:
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (ImportError, OSError, AttributeError):  # another C library: nothing to trim
        return
