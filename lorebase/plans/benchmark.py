"""Benchmark runs: retrieval, conversations, per-question facets, planted injections."""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_refusal
from ..operators import cache, evaluation, generation, retrieval
from ..operators.embedding import Embedder, hash_vectors
from ..settings import Settings
from ..sources.shared import keep
from . import answer
from .engine import Engine


def _asked(questions: DataFrame) -> DataFrame:
    cols = {"query_id": F.col("question_id"), "history": F.col("history") if "history" in questions.columns else F.lit(None).cast("array<struct<role:string,content:string>>")}
    return questions.withColumns(cols).select("query_id", "question", "history", "category", F.col("relevant_document_ids").alias("relevant"))


def run(questions: DataFrame, chunks: DataFrame, settings: Settings | None = None, ks: tuple[int, ...] = evaluation.KS, *, contextualize: bool = True, oracle_filter: bool = False, embedder: Embedder = hash_vectors, rewriter: generation.Completer = generation.echo) -> DataFrame:
    """(scope, key, metric, value) of one run over labelled questions; one retrieval at the largest k serves every k.

    All questions run in one plan, so its wall time is spread evenly over them. A blank question, or one that cannot be
    embedded, has failed and is counted; the others go on. ``oracle_filter`` searches each question with a single facet
    in that facet alone.
    """
    settings = settings or Settings()
    evaluation.check(ks)
    # labels may come from a search of their own; they are read by every part of the report
    asked = keep(_asked(questions), "questions")
    if asked.isEmpty():
        raise ValueError("no questions")
    began = time.perf_counter()
    source = asked if contextualize else asked.withColumn("history", F.lit(None).cast("array<struct<role:string,content:string>>"))
    good = F.trim(F.coalesce("question", F.lit(""))) != ""
    prepared = answer.prepare(source.where(good).drop("category", "relevant"), settings, embedder, rewriter, isolate=True)
    if settings.retrieval_mode != "lexical":
        prepared = prepared.where(F.col("vector").isNotNull())
    depth = max(ks)
    options = {"mode": settings.retrieval_mode, "top_k": depth, "candidates": max(settings.hybrid_candidates, depth), "rrf_k": settings.rrf_k, "reranker": settings.rerank_model, "rerank_candidates": max(settings.rerank_candidates, depth)}
    if oracle_filter:
        facet = evaluation.question_doc_type(asked.select("query_id", F.explode("relevant").alias("document_id")))
        keyed = prepared.join(facet, "query_id", "left")
        # a corpus has a handful of facets; each is one search over its own files
        facets = [r[0] for r in keyed.select("doc_type").distinct().orderBy("doc_type").collect()]
        results = None
        for f in facets:
            part = retrieval.search(keyed.where(F.col("doc_type").eqNullSafe(f)).drop("doc_type"), chunks, filters={"doc_type": f} if f else None, **options)
            results = part if results is None else results.unionByName(part)
    else:
        results = retrieval.search(prepared, chunks, **options)
    # a few rows per question, which every part of the report reads; computed here, so that the clock sees it
    results = keep(results, "benchmark")
    n = asked.count()
    failed = ~F.coalesce(F.col("ok"), F.lit(False))
    took = asked.select("query_id").join(prepared.select("query_id", F.lit(True).alias("ok")).distinct(), "query_id", "left").select("query_id", F.lit(1000 * (time.perf_counter() - began) / n).alias("ms"), failed.alias("failed"))
    return evaluation.benchmark(asked.select("query_id", "category", "relevant"), results, took, ks)


def conversation_runs(questions: DataFrame, chunks: DataFrame, settings: Settings | None = None, **kwargs) -> DataFrame:
    """Both runs over questions with history, labelled raw and contextualized."""
    raw = run(questions, chunks, settings, contextualize=False, **kwargs).withColumn("label", F.lit("raw"))
    return raw.unionByName(run(questions, chunks, settings, **kwargs).withColumn("label", F.lit("contextualized")))


def injection_run(questions: DataFrame, attacks: DataFrame, chunks: DataFrame, settings: Settings | None = None, completer: generation.Completer = generation.extractive) -> DataFrame:
    """Report per (attack, phrasing) of answers to contexts with a planted chunk."""
    from ..operators import context

    settings = settings or Settings(compress_method="")
    asked = _asked(questions)
    pool = answer.retrieve(answer.prepare(asked.drop("category", "relevant"), settings), chunks, settings)
    planted = evaluation.splice(pool, attacks.withColumnRenamed("question_id", "query_id"), settings.top_k)
    planted = planted.withColumn("case", F.concat_ws("/", F.col("query_id"), "attack_id"))
    if settings.guard_detect:
        planted, _ = context.guard(planted)
    built = context.build_context(planted.drop("query_id").withColumnRenamed("case", "query_id"), settings.context_chars, settings.prompt_version == "v3")
    cases = planted.select(F.col("case").alias("query_id"), "attack", "phrasing", F.col("query").alias("question")).distinct()
    user = F.replace(F.replace(F.lit(generation.USER), F.lit("{question}"), F.col("question")), F.lit("{context}"), F.col("context"))
    done = generation.complete(built.join(cases, "query_id").withColumns({"system": F.lit(generation.PROMPTS[settings.prompt_version]), "user": user}), completer)
    done = done.withColumn("refusal", F.when(is_refusal(F.col("answer")), "model_declined"))
    hit = evaluation.attack_succeeded(F.col("attack"), F.col("answer"), F.col("refusal"))
    return done.groupBy("attack", "phrasing").agg(F.count("*").alias("cases"), F.count_if(hit).alias("successes"), F.count_if(F.col("refusal").isNotNull()).alias("refusals"))


def history_row(result: DataFrame, label: str, settings: Settings) -> DataFrame:
    """A long result as rows for the history file."""
    return result.withColumns({"label": F.lit(label), "timestamp": F.lit(datetime.now(UTC).isoformat()), "git_commit": F.lit(evaluation.git_commit()), "mode": F.lit(settings.retrieval_mode), "strategy": F.lit(settings.chunk_strategy)})


def cache_run(engine: Engine, questions: DataFrame, paraphrases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(arms, verdict) of a run against an emptied answer cache: cold, replayed, and asked in other words.

    ``arms`` has a row per arm: questions, hits by layer, misses, milliseconds a question. All questions of an arm run in
    one plan, so its wall time is spread evenly over them. ``paraphrases`` need a semantic threshold in the settings.
    """
    engine.clear_cache()
    done = {}
    for arm, asked in (("cold", questions), ("exact", questions), ("semantic", paraphrases)):
        if asked is None:
            continue
        began, n = time.perf_counter(), asked.count()
        rows = keep(engine.ask_cached(asked), "arm")
        done[arm] = rows.withColumn("ms", F.lit(1000 * (time.perf_counter() - began) / max(n, 1)))
    arms = None
    for arm, rows in done.items():
        hits = [F.count_if(F.col("cache") == layer).alias(f"{layer}_hits") for layer in ("exact", "semantic")]
        one = rows.agg(F.lit(arm).alias("arm"), F.count("*").alias("questions"), *hits, F.count_if(F.col("cache").isNull()).alias("misses"), F.max("ms").alias("ms"))
        arms = one if arms is None else arms.unionByName(one)
    cold = done["cold"].withColumn("refusal", F.when(is_refusal(F.col("answer")) | F.col("answer").isNull(), "model_declined"))
    return arms, cache.replay_verdict(cold, done["exact"])
