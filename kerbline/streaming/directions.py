"""Directions for requests that arrive as files: each micro-batch runs the batch job and appends its responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..jobs.directions import directions

REQUESTS = "req_id bigint, start string, end string"


def serve(spark: SparkSession, requests_path: str, edges: DataFrame, stairs: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    """JSON lines of requests in, Parquet responses out, until no file is left; a batch that is run again overwrites its own folder."""

    def answer(batch: DataFrame, number: int) -> None:
        directions(batch, edges, stairs).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    stream = spark.readStream.schema(REQUESTS).json(requests_path)
    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
