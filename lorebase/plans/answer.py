"""The answering plan over a DataFrame of questions: one question is one row of the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_refusal
from ..operators import context, generation, retrieval
from ..operators.embedding import Embedder, embed, hash_vectors
from ..settings import Settings
from ..sources.shared import keep, spread


def prepare(questions: DataFrame, settings: Settings, embedder: Embedder = hash_vectors, rewriter: generation.Completer = generation.echo, isolate: bool = False) -> DataFrame:
    """(query_id, variant, query, vector, ...): contextualised, transformed and embedded; with ``isolate`` a query that cannot be embedded has no vector."""
    asked = generation.contextualize(questions, settings.history_turns, rewriter)
    variants = generation.expand(asked, settings.query_transform, settings.transform_n, rewriter)
    keyed = variants.withColumn("text", F.col("query"))
    return embed(keyed, embedder, isolate).drop("text")


def retrieve(prepared: DataFrame, chunks: DataFrame, settings: Settings, filters: dict | None = None, lexical: retrieval.LexicalIndex | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Pools with chunk columns and the query that they are compressed against."""
    depth = settings.compress_candidates if settings.compress_method else settings.top_k
    if settings.compress_method and settings.compress_candidates < settings.top_k:
        raise ValueError("the compression pool must hold top_k chunks")
    found = retrieval.search(
        prepared, chunks, mode=settings.retrieval_mode, top_k=depth, candidates=max(settings.hybrid_candidates, depth), rrf_k=settings.rrf_k, filters=filters,
        reranker=settings.rerank_model, rerank_candidates=max(settings.rerank_candidates, depth), lexical=lexical, vectors=vectors,
    )
    query = prepared.where("variant = 0").select("query_id", "query")
    cols = [c for c in chunks.columns if c not in ("vector", "chunk_index", "char_start", "char_end")]
    return found.join(chunks.select(*cols), "chunk_id").join(query, "query_id")


def answer(
    questions: DataFrame,
    chunks: DataFrame,
    settings: Settings | None = None,
    *,
    filters: dict | None = None,
    completer: generation.Completer = generation.extractive,
    rewriter: generation.Completer = generation.echo,
    embedder: Embedder = hash_vectors,
    lexical: retrieval.LexicalIndex | None = None,
    vectors: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """Answers to (query_id, question, history): answer, sources, retrieved, used, dropped, context, warnings, usage, refusal,
    and for a question whose call failed a null answer with error_type and error_message.

    Questions that find nothing get the fixed refusal and never reach the model. The search runs here, once; its pools
    (a few dozen rows a question) are kept in the shared folder, from which the answers are computed.
    """
    settings = settings or Settings()
    if settings.prompt_version not in generation.PROMPTS:
        raise ValueError(f"unknown prompt version {settings.prompt_version!r}")
    if "history" not in questions.columns:
        questions = questions.withColumn("history", F.lit(None).cast("array<struct<role:string,content:string>>"))
    prepared = keep(prepare(questions, settings, embedder, rewriter), "prepared")
    full = keep(retrieve(prepared, chunks, settings, filters, lexical, vectors), "pools")
    seen = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "document_id", "score")))
    sizes = full.groupBy("query_id").agg(seen.alias("pool"), F.first("query").alias("query"), F.count("*").alias("pooled"))
    pool = full
    if settings.compress_method:
        pool = context.compress(pool, settings.compress_method, settings.compress_budget, settings.compress_length_penalty, embedder)
    guarded = None
    if settings.guard_detect:
        pool, hits = context.guard(pool)
        guarded = hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "warning"))), lambda w: w["warning"]).alias("guarded"))
    built = context.build_context(pool, settings.context_chars, settings.prompt_version == "v3").drop("retrieved", "dropped")
    user = F.replace(F.replace(F.lit(generation.USER), F.lit("{question}"), F.col("question")), F.lit("{context}"), F.col("context"))
    base = questions.select("query_id", "question", "history").join(sizes, "query_id", "left").join(built, "query_id", "left")
    if guarded is not None:
        base = base.join(guarded, "query_id", "left").withColumn("warnings", F.coalesce("guarded", F.array().cast("array<string>"))).drop("guarded")
    else:
        base = base.withColumn("warnings", F.array().cast("array<string>"))
    found = F.coalesce(F.col("used") > 0, F.lit(False))
    base = base.withColumns({"system": F.when(found, F.lit(generation.PROMPTS[settings.prompt_version])), "user": F.when(found, user), "sources": F.coalesce("sources", F.array().cast(context.SOURCE)), "used_ids": F.transform(F.coalesce("sources", F.array().cast(context.SOURCE)), lambda s: s["chunk_id"])})
    none = F.col("user").isNull()
    done = generation.check_answers(generation.complete(spread(base, "query_id"), _unless_empty(completer)), strict)
    refusal = F.when(none, "no_context").when(is_refusal(F.col("answer")), "model_declined")
    done = done.withColumn("refusal", refusal).withColumn("warnings", F.when(none, F.filter("warnings", lambda w: w != "answer_without_citations")).otherwise(F.col("warnings")))
    pooled, used = F.coalesce("pooled", F.lit(0)), F.coalesce("used", F.lit(0))
    turns = F.greatest(F.coalesce(F.size("history"), F.lit(0)), F.lit(0))
    return done.withColumns({"retrieved": pooled, "used": used, "dropped": pooled - used, "context_chars": F.coalesce(F.length("context"), F.lit(0)), "model": F.lit(settings.generation_model), "query": F.coalesce("query", "question"), "history_turns": turns}).drop("pooled")


def _unless_empty(completer: generation.Completer) -> generation.Completer:
    """Rows without a prompt get the fixed refusal without a call."""
    return lambda system, user: (generation.NO_CONTEXT, 0, 0) if user is None else completer(system, user)
