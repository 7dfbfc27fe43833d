"""Reading the Parquet tables of a folder."""

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Bytes of a batch on its way to a Python function; what it makes of them (lines, rows) takes several times as much.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; the path goes to Spark's reader unchanged, so any store Spark reads will do."""
    bounded(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bounded(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python functions get by rows and bytes, so that a worker holds the same whatever the table's size.

    The session keeps both settings: results are computed when the caller writes them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
