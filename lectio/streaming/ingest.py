"""Extension: a folder watched by Structured Streaming, each batch upserted into an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..plans.pipeline import index_files
from ..sources.store import Index


def watch(spark: SparkSession, folder: str, index: Index, embedder, checkpoint: str, config: Config = DEFAULT):
    """A started query; upserts by content-hashed ids make a repeated batch harmless."""
    files = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).load(folder)

    def add(batch: DataFrame, _: int) -> None:
        index_files(batch.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"), index, embedder, config=config)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts and sums by event type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    )
