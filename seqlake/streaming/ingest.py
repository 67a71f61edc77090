"""Landing files to Bronze without reading old files again.

The flows scan their source as a whole. For a landing folder that only grows, this reads each file
once: the files already taken are kept in the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlake.spec import POSITIONS_SCHEMA


def append_new_files(
    spark: SparkSession,
    landing: str,
    path: str,
    checkpoint: str,
    schema: T.StructType = POSITIONS_SCHEMA,
) -> None:
    """Append the rows of the CSV files that are new since the last call to the table at ``path``.

    ``checkpoint`` and ``path`` are folders all executors share. A call that dies half way is
    finished by the next one, without rows twice.
    """
    rows = spark.readStream.schema(schema).csv(landing, header=True)
    stamped = rows.withColumn("ingested_at", F.current_timestamp())
    query = (
        stamped.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
