"""A stream of changed items kept in the index, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.maintenance import committed, opened, upsert


def changes(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def latest(batch: DataFrame, key: str = "item_key", version: str = "version") -> DataFrame:
    """The newest row of each item."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(F.desc(version))
    return batch.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def keep_index(stream: DataFrame, root: str, checkpoint: str, records: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Each micro-batch's newest rows become records and a new version of the index; doing a batch twice changes
    nothing, as records replace those of their items."""

    def apply(batch: DataFrame, _: int) -> None:
        spark, new = batch.sparkSession, records(latest(batch))
        try:
            old = opened(spark, root)
        except Exception as e:  # noqa: BLE001  the first batch has no version to read
            if "PATH_NOT_FOUND" not in str(e):
                raise
            committed(new, root)
            return
        committed(upsert(old, new), root)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in windows of event time, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
