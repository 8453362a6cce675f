"""A facade for callers that ask one question at a time."""

from __future__ import annotations

import logging
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cache, generation, retrieval, traces
from ..operators.context import SOURCE
from ..operators.embedding import Embedder, embed, hash_vectors
from ..operators.traces import summary
from ..settings import Settings
from ..sources.jsonl import TRACE, append_json, read_traces
from ..sources.store import Collection
from . import answer, index

log = logging.getLogger(__name__)
_CACHE = "key string, fp string, vector array<float>, answer string, expires_at timestamp"


class Engine:
    """Questions against one collection, with an optional answer cache and trace log."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None, embedder: Embedder = hash_vectors, completer: generation.Completer = generation.extractive):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings or Settings()
        self.embedder, self.completer = embedder, completer
        self.store = Collection(spark, f"{self.path}/collection")
        self._lexical: tuple[int, retrieval.LexicalIndex] | None = None

    def index(self, docs: DataFrame, **kwargs) -> DataFrame:
        out = index.build_index(self.spark, docs, self.store.path, self.settings, embedder=self.embedder, **kwargs)
        self._lexical = None
        return out

    def replace_document(self, document: DataFrame) -> int:
        """The new revision; it is part of every cache key, so older answers are not served any more."""
        revision = index.replace_document(self.spark, document, self.store.path, self.settings, self.embedder)
        self._lexical = None
        return revision

    def lexical(self) -> retrieval.LexicalIndex:
        """The index of the present revision: built and saved once for it, then probed in its files."""
        revision = self.store.revision()
        if self._lexical is None or self._lexical[0] != revision:
            path = f"{self.path}/lexical/{revision}"
            if index.exists(self.spark, f"{path}/terms/_SUCCESS"):
                built = retrieval.LexicalIndex.load(self.spark, path)
            else:
                built = retrieval.LexicalIndex(self.store.read()).save(path)
            self._lexical = (revision, built)
        return self._lexical[1]

    def ask(self, questions: DataFrame, filters: dict | None = None) -> DataFrame:
        """Answers to (query_id, question[, history]) rows; a trace of each is recorded if there is a trace path.

        A blank question raises. With a trace path the answers are computed here, once, and read again from the engine's
        folder; a failing trace costs a warning, never the answer.
        """
        if not questions.where(F.trim(F.coalesce("question", F.lit(""))) == "").isEmpty():
            raise ValueError("blank question")
        lexical = self.lexical() if self.settings.retrieval_mode != "dense" else None
        began = time.perf_counter()
        out = answer.answer(questions, self.store.read(), self.settings, filters=filters, completer=self.completer, embedder=self.embedder, lexical=lexical)
        if not self.settings.trace_path:
            return out
        out = self._kept(out)
        self.record(out.withColumn("cache", F.lit(None).cast("string")), 1000 * (time.perf_counter() - began))
        return out

    def _kept(self, rows: DataFrame) -> DataFrame:
        path = f"{self.path}/runs/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def ask_cached(self, questions: DataFrame, filters: dict | None = None) -> DataFrame:
        """(query_id, answer, cache, warnings): from the cache if there, else computed and stored unless it is a refusal.

        A failing cache costs a warning, never the answer; after a failed lookup nothing is stored.
        """
        if "history" not in questions.columns:
            questions = questions.withColumn("history", F.lit(None).cast("array<struct<role:string,content:string>>"))
        none = F.array().cast("array<string>")
        try:
            hits, rest, keyed = self._looked_up(questions, filters)
            broken = None
        except Exception as e:
            hits, rest, keyed, broken = None, questions, None, e
            log.warning("the answer cache failed: %s", e)
        answered = self._kept(self.ask(rest.select("query_id", "question", "history"), filters))
        warned = F.array(F.lit("cache_unavailable")) if broken else none
        out = answered.select("query_id", "answer", F.lit(None).cast("string").alias("cache"), F.concat("warnings", warned).alias("warnings"))
        if broken:
            return out
        try:
            good = answered.where(F.col("answer").isNotNull()).join(keyed.select("query_id", "key", "fp"), "query_id")
            with_vectors = embed(good.withColumn("text", F.col("question")), self.embedder, isolate=True)
            new = cache.store(self.spark.createDataFrame([], _CACHE), with_vectors, self.settings.cache_ttl_s)
            # a folder of its own: a write to what the lookup reads would make Spark look again, and find these entries
            new.write.parquet(f"{self.path}/answers/{uuid.uuid4().hex}")
        except Exception as e:
            log.warning("answers were not stored in the cache: %s", e)
        if self.settings.trace_path:
            found = hits.join(questions.select("query_id", "question", "history"), "query_id")
            self.record(_hit_rows(found, self.settings), 0.0)
        return hits.select("query_id", "answer", "cache", none.alias("warnings")).unionByName(out)

    def _looked_up(self, questions: DataFrame, filters: dict | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(hits, questions without a hit, keyed questions); the hits are read here, so that a broken cache shows now."""
        fp = cache.fingerprint(self.settings, {"filters": filters}, self.store.revision())
        n = self.settings.history_turns
        turns = F.transform(F.slice("history", F.greatest(F.size("history") - n + 1, F.lit(1)), n), lambda t: F.concat(t["role"], F.lit(": "), t["content"]))
        keyed = questions.withColumn("key", cache.cache_key(F.col("question"), F.array_join(turns, "\n"), fp)).withColumn("fp", F.lit(fp))
        have = self._cache()
        hits, rest = cache.lookup(keyed, have)
        out = hits.select("query_id", "answer", "cache")
        if self.settings.cache_semantic_threshold is not None:
            vectors = embed(rest.withColumn("text", F.col("question")), self.embedder).drop("text")
            asked = vectors.withColumn("history", F.array_join(F.transform("history", lambda t: t["content"]), " "))
            near = cache.semantic_lookup(asked, have, self.settings.cache_semantic_threshold, fp)
            out = out.unionByName(near.select("query_id", "answer", "cache"))
        out = self._kept(out)
        return out, keyed.join(out.select("query_id"), "query_id", "left_anti"), keyed

    def _cache(self) -> DataFrame:
        if not index.exists(self.spark, f"{self.path}/answers"):
            return self.spark.createDataFrame([], _CACHE)
        rows = self.spark.read.schema(_CACHE).option("recursiveFileLookup", True).parquet(f"{self.path}/answers")
        last = F.max_by(F.struct("fp", "vector", "answer", "expires_at"), "expires_at")
        return rows.groupBy("key").agg(last.alias("r")).select("key", "r.*")

    def clear_cache(self) -> None:
        """Forget all stored answers."""
        index.remove(self.spark, f"{self.path}/answers")

    def record(self, answers: DataFrame, ms: float) -> None:
        """Append traces of answered questions; a failure is logged and goes no further."""
        try:
            n = max(1, answers.count())
            per = F.lit(ms / n)
            zero = F.lit(None).cast("double")
            timings = F.struct(*[(per if k == "total_ms" else zero).alias(k) for k in ("contextualize_ms", "retrieval_ms", "context_ms", "generation_ms", "total_ms")])
            append_json(traces.trace_rows(answers.withColumn("timings", timings), self.settings), self.settings.trace_path)
        except Exception as e:
            log.warning("traces were not written: %s", e)

    def health(self) -> dict[str, bool]:
        """Whether the collection is there, and whether the answer cache can be read (an absent one can)."""
        try:
            self._cache().limit(1).count()
            readable = True
        except Exception:
            readable = False
        return {"store": self.store.exists(), "cache": readable}

    def metrics(self) -> DataFrame:
        """Operational summary of the recorded traces; an empty one if there are none."""
        path = self.settings.trace_path
        if not path or not index.exists(self.spark, path):
            return summary(self.spark.createDataFrame([], TRACE))
        return summary(read_traces(self.spark, path))


def _hit_rows(hits: DataFrame, settings: Settings) -> DataFrame:
    """Answers from the cache in the shape that traces are made from."""
    text, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    return hits.withColumns(
        {"query": F.col("question"), "history_turns": F.greatest(F.coalesce(F.size("history"), F.lit(0)), F.lit(0)), "pool": F.array().cast("array<struct<rank:int,chunk_id:string,document_id:string,score:double>>"), "used_ids": none,
         "sources": F.array().cast(SOURCE), "system": text, "user": text, "refusal": text, "warnings": none, "prompt_tokens": F.lit(0), "completion_tokens": F.lit(0), "error_type": text, "error_message": text}
    )
