"""What every query of this subpackage asks of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from sylva.runtime import ship

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whole documents are large rows: batches of Spark's default length would hold a worker's memory for no gain.
ROWS, DEFAULT = 2000, "10000"


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers, and shorten Arrow batches unless the session names a length of its own."""
    ship(spark)
    if spark.conf.get(BATCH, DEFAULT) == DEFAULT and not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, str(ROWS))
