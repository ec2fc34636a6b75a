"""Continuous ingest: micro-batches of JSON lines upserted into an index, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from docquarry.engine import Index
from docquarry.sources.readers import documents, kafka_options


def ingest(lines: DataFrame, index: Index, checkpoint: str, interval: str | None = "5 seconds", name: str = "ingest") -> StreamingQuery:
    """Start a query that upserts a stream of (value: a JSON object).

    Each batch is flushed as one version that records the batch's number; a batch that is replayed after a failure finds its
    number in the manifest and is passed over, so every batch counts once. With no interval all that is there is read, then
    the query ends.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        if index.done(name) >= number:
            return
        index.add_documents(documents(batch.where("trim(value) <> ''").select("value"), index.mapping))
        index.flush(batch=(name, number))

    w = lines.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=interval) if interval else w.trigger(availableNow=True)).start()


def file_lines(spark, folder: str) -> DataFrame:
    """A stream of the lines of files as they arrive in a folder."""
    return spark.readStream.text(folder)


def kafka_lines(spark, topic: str, servers: list[str], offset: str | None = None, options: dict | None = None) -> DataFrame:
    """A stream of a topic's values. Spark's Kafka connector must be on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(topic, servers, offset, options)).load().selectExpr("cast(value as string) as value")
