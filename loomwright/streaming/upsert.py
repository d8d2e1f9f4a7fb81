"""A file stream merged into a table: the latest row of each key, in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwright.session import shared_dir
from loomwright.sources.files import Table


def stream_upsert(spark: SparkSession, path: str, schema: str, key: list[str], order: list[str], max_files_per_trigger: int | None = None) -> DataFrame:
    """Reads all files at ``path`` as a stream and gives the table that its upserts leave.

    A batch that is run again after a failure upserts the same rows, which changes nothing.
    """
    table = Table(spark, shared_dir(spark, "upsert"), schema, key, order)
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    query = reader.parquet(path + "*").writeStream.foreachBatch(lambda df, _: table.upsert(df)).option("checkpointLocation", shared_dir(spark, "upsert-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()
