"""Answer cache: exact keys, a semantic layer on the question's vector, and the sweep that picks its threshold."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse
from ..settings import Settings
from .retrieval import dense

MARGIN, LEAST_HITS = 0.02, 19
#: Anchors that a sweep broadcasts (a vector each).
MOST_ANCHORS = 10_000


def digest(value) -> str:
    """sha256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def fingerprint(settings: Settings, kwargs: dict, revision: int = 0) -> str:
    """What besides question and history shapes an answer."""
    return digest({"settings": settings.keyed(), "kwargs": kwargs, "revision": revision})


def cache_key(question: Column, history: Column, fp: str) -> Column:
    """Key of a question with its last turns (``role: content`` lines or null) under a fingerprint. Case counts, white space doesn't."""
    return F.sha2(F.concat_ws("\u001f", F.lit(fp), collapse(question), F.coalesce(history, F.lit(""))), 256)


def lookup(questions: DataFrame, cache: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits with their stored answer, misses) of keyed questions by exact key; expired entries are misses."""
    now = F.current_timestamp() if now is None else now
    live = cache.where(F.col("expires_at") > now).select("key", "answer")
    return questions.join(live, "key").withColumn("cache", F.lit("exact")), questions.join(live, "key", "left_anti")


def semantic_lookup(questions: DataFrame, cache: DataFrame, threshold: float, fp: str, now: Column | None = None) -> DataFrame:
    """Per question without history the nearest live entry under the fingerprint, if (1 + cosine) / 2 >= (1 + threshold) / 2.

    The search is the dense top-k: each task keeps its nearest entry per question.
    """
    now = F.current_timestamp() if now is None else now
    live = cache.where((F.col("expires_at") > now) & (F.col("fp") == fp)).select(F.col("key").alias("chunk_id"), "vector", "answer")
    asked = questions.where("coalesce(history, '') = ''")
    best = dense(asked, live, 1).withColumn("score", (1 + F.col("score")) / 2).where(F.col("score") >= (1 + threshold) / 2).drop("rank")
    found = best.join(live.select("chunk_id", "answer"), "chunk_id").withColumnRenamed("chunk_id", "hit")
    return asked.join(found, "query_id").withColumn("cache", F.lit("semantic"))


def store(cache: DataFrame, answers: DataFrame, ttl_s: int, now: Column | None = None) -> DataFrame:
    """The cache with new answers (key, fp, vector, answer, refusal) put in; refusals are never stored, later entries win."""
    now = F.current_timestamp() if now is None else now
    new = answers.where(F.col("refusal").isNull()).select("key", "fp", "vector", "answer", (now + F.make_interval(secs=F.lit(ttl_s))).alias("expires_at"))
    return cache.join(new.select("key"), "key", "left_anti").select("key", "fp", "vector", "answer", "expires_at").unionByName(new)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns, 0 if a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)


def sweep(probes: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row: threshold, false hits, must-miss probes, paraphrase hits and whether the rule (no false hit, 19 hits) holds.

    ``anchors`` is a labelled fixture; every probe (probe_id, anchor_id, kind, vector) meets all of them, so more than
    MOST_ANCHORS raise.
    """
    if anchors.count() > MOST_ANCHORS:
        raise ValueError(f"a sweep takes at most {MOST_ANCHORS} anchors")
    a = anchors.select(F.col("anchor_id").alias("to"), F.col("vector").alias("v2"))
    pairs = probes.crossJoin(F.broadcast(a)).withColumn("score", F.round(cosine(F.col("vector"), F.col("v2")), 6))
    own = F.max(F.when(F.col("to") == F.col("anchor_id"), F.col("score")))
    near = pairs.groupBy("probe_id", "anchor_id", "kind").agg(own.alias("own"), F.max("score").alias("nearest"), F.min_by("to", F.struct(-F.col("score"), F.col("to"))).alias("nearest_id"))
    near = near.withColumn("must_miss", (F.col("kind") != "paraphrase") | (F.col("nearest_id") != F.col("anchor_id")))
    t = near.agg(F.round(F.max(F.when(F.col("must_miss"), F.col("nearest"))) + MARGIN, 6).alias("threshold"))
    return near.crossJoin(F.broadcast(t)).groupBy("threshold").agg(
        F.count_if(F.col("must_miss") & (F.col("nearest") >= F.col("threshold"))).alias("false_hits"),
        F.count_if("must_miss").alias("must_miss"),
        F.count_if(~F.col("must_miss") & (F.col("nearest") >= F.col("threshold"))).alias("paraphrase_hits"),
    ).withColumn("rule_s", (F.col("false_hits") == 0) & (F.col("paraphrase_hits") >= LEAST_HITS))


def replay_verdict(cold: DataFrame, replay: DataFrame, most_ms: float = 50.0) -> DataFrame:
    """One row on a replay (query_id, answer, cache, ms) of a cold run (query_id, answer, refusal): do hits repeat it?

    rule_e holds if every stored answer came back from the cache byte for byte and half the hits took under ``most_ms``.
    """
    both = cold.select("query_id", F.col("answer").alias("was"), "refusal").join(replay, "query_id")
    hit = F.col("cache").isNotNull()
    got = both.agg(
        F.count_if(F.col("refusal").isNull()).alias("stored"),
        F.count_if(hit).alias("hits"),
        F.count_if(~hit).alias("misses"),
        F.count_if(hit & (F.col("was") == F.col("answer"))).alias("identical"),
        F.percentile(F.when(hit, F.col("ms")), 0.5).alias("hit_p50_ms"),
        F.percentile(F.when(~hit, F.col("ms")), 0.5).alias("miss_p50_ms"),
    )
    return got.withColumn("rule_e", (F.col("hits") == F.col("stored")) & (F.col("identical") == F.col("hits")) & (F.col("hit_p50_ms") < most_ms))
