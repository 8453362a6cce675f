"""Structured Streaming over trace files and documents; an addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.traces import counters, summary
from ..sources.jsonl import TRACE


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TRACE).json(path)


def live_counters(traces: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counters per tumbling window; traces later than the watermark are dropped, closed windows leave the state."""
    return traces.withWatermark("started_at", late).groupBy(F.window("started_at", window)).agg(*counters()).select("window.start", "window.end", *[c for c in _names()])


def _names() -> list[str]:
    return ["total", "generated", "refused", "failed", "exact_hits", "semantic_hits", "follow_ups", "follow_up_repeats", "prompt_tokens", "completion_tokens", "known_cost_usd", "content_captured"]


def accumulate(spark: SparkSession, source: str, table: str, checkpoint: str, result: str) -> StreamingQuery:
    """Append new traces to a table and rewrite its summary (with exact percentiles) after every batch."""

    def step(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again replaces its own folder
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")
        summary(spark.read.parquet(table)).write.mode("overwrite").parquet(result)

    return read_stream(spark, source).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
