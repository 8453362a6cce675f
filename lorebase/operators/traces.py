"""Query traces: building rows, cost, and the operational summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cost_usd
from ..settings import Settings


def trace_rows(answers: DataFrame, settings: Settings) -> DataFrame:
    """Trace rows of answered questions.

    ``answers`` holds question, query, history_turns, pool array<struct<chunk_id,document_id,rank,score>>, used_ids,
    sources, system, user, answer, refusal, cache, warnings, prompt_tokens, completion_tokens, error_type, error_message
    and a timings struct.
    Texts are recorded only with ``trace_content``.
    """
    content = lambda c: F.col(c) if settings.trace_content else F.lit(None).cast("string")
    chunks = F.transform(
        "pool",
        lambda c: F.struct(
            c["chunk_id"].alias("chunk_id"), c["document_id"].alias("document_id"), c["rank"].cast("int").alias("rank"), c["score"].alias("score"), F.lit(None).cast("double").alias("rerank_score"),
            F.array_contains("used_ids", c["chunk_id"]).alias("used"), F.exists("sources", lambda s: s["chunk_id"] == c["chunk_id"]).alias("cited"),
        ),
    )
    usage = F.create_map(F.lit("prompt_tokens"), F.coalesce("prompt_tokens", F.lit(0)), F.lit("completion_tokens"), F.coalesce("completion_tokens", F.lit(0)))
    null = lambda s: F.lit(s or None).cast("string")
    return answers.select(
        F.lit(1).alias("schema_version"), F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("trace_id"), F.current_timestamp().alias("started_at"), "question", F.col("query").alias("resolved_query"),
        F.col("history_turns").cast("int").alias("history_turns"), (F.col("history_turns") > 0).alias("follow_up"), ((F.col("history_turns") > 0) & F.coalesce(F.col("cache") == "exact", F.lit(False))).alias("follow_up_repeat"),
        F.lit(settings.generation_model).alias("model"), F.lit(settings.retrieval_mode).alias("retrieval_mode"), null(settings.query_transform).alias("transform"), null(settings.rerank_model).alias("reranker"),
        null(settings.compress_method).alias("compressor"), F.lit(settings.prompt_version).alias("prompt_version"), F.lit(settings.top_k).alias("top_k"), chunks.alias("chunks"),
        content("system").alias("system_prompt"), content("user").alias("user_prompt"), content("answer").alias("response"), "refusal", "cache", "warnings", usage.alias("usage"),
        cost_usd(F.col("prompt_tokens"), F.col("completion_tokens"), settings.generation_usd_per_mtok_input, settings.generation_usd_per_mtok_output).alias("cost_usd"),
        "timings", "error_type", "error_message",
    )


def counters() -> list:
    """Aggregates that batches and streams share; ``generated`` includes refusals."""
    tokens = lambda k: F.coalesce(F.sum(F.coalesce(F.try_element_at("usage", F.lit(k)), F.lit(0))), F.lit(0))
    return [
        F.count("*").alias("total"),
        F.count_if(F.col("cache").isNull() & F.col("error_type").isNull()).alias("generated"),
        F.count_if(F.col("refusal").isNotNull()).alias("refused"),
        F.count_if(F.col("error_type").isNotNull()).alias("failed"),
        F.count_if(F.col("cache") == "exact").alias("exact_hits"),
        F.count_if(F.col("cache") == "semantic").alias("semantic_hits"),
        F.count_if("follow_up").alias("follow_ups"),
        F.count_if("follow_up_repeat").alias("follow_up_repeats"),
        tokens("prompt_tokens").alias("prompt_tokens"),
        tokens("completion_tokens").alias("completion_tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("known_cost_usd"),
        F.count_if(F.col("response").isNotNull()).alias("content_captured"),
    ]


def summary(traces: DataFrame) -> DataFrame:
    """One row: counters, repeat rate (null without follow-ups) and interpolated latency percentiles."""
    got = traces.agg(*counters(), F.percentile("timings.total_ms", 0.5).alias("latency_p50_ms"), F.percentile("timings.total_ms", 0.95).alias("latency_p95_ms"))
    return got.withColumn("follow_up_repeat_rate", F.try_divide("follow_up_repeats", "follow_ups"))


def sink_report(traces: DataFrame, writes: DataFrame, most_ms: float = 5.0) -> DataFrame:
    """One row on a trace log read back and the times (ms) of its writes: rule_o holds if all are valid and p95 is below ``most_ms``."""
    valid = traces.agg(F.count_if(F.col("trace_id").isNotNull() & (F.col("schema_version") == 1)).alias("valid_lines"))
    times = writes.agg(F.count("*").alias("writes"), F.percentile("ms", 0.5).alias("p50_ms"), F.percentile("ms", 0.95).alias("p95_ms"))
    # both sides are single rows
    return times.crossJoin(F.broadcast(valid)).withColumn("rule_o", (F.col("valid_lines") == F.col("writes")) & (F.col("p95_ms") < most_ms))
