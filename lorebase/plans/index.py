"""Indexing jobs: documents -> cleaned -> chunks -> vectors -> collection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..operators.embedding import Embedder, cache_key, embed, embed_cached, hash_vectors, misses
from ..settings import Settings
from ..sources.documents import clean_documents
from ..sources.store import Collection


def vectors(docs: DataFrame, settings: Settings, embedder: Embedder = hash_vectors, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Chunks with vectors, and new rows for the embedding cache if one is given."""
    chunks = chunking.chunk(docs, settings.chunk_strategy, settings.chunk_size, settings.chunk_overlap, embedder)
    if cache is None:
        return embed(chunks, embedder), None
    return embed_cached(chunks, cache, settings.embedding_model, embedder)


def embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    """Rows (key, model, vector) of the cache kept beside a collection; none if there is none yet."""
    folder = f"{path}-embeddings"
    return spark.read.schema(CACHE).option("recursiveFileLookup", True).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], CACHE)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


CACHE = "key string, model string, vector array<float>"


def _embedded(spark: SparkSession, docs: DataFrame, path: str, settings: Settings, embedder: Embedder) -> DataFrame:
    """Chunks with vectors; texts that the cache lacks are embedded once and stored before the chunks are read with them."""
    have = embedding_cache(spark, path)
    chunks = chunking.chunk(docs, settings.chunk_strategy, settings.chunk_size, settings.chunk_overlap, embedder)
    new = embed(misses(chunks, have, settings.embedding_model), embedder).select("key", F.lit(settings.embedding_model).alias("model"), "vector")
    new.write.parquet(f"{path}-embeddings/{uuid.uuid4().hex}")
    every = embedding_cache(spark, path).select("key", "vector")
    return chunks.withColumn("key", cache_key(settings.embedding_model, F.col("text"))).join(every, "key").drop("key")


def build_index(spark: SparkSession, docs: DataFrame, path: str, settings: Settings | None = None, *, recreate: bool = False, dry_run: bool = False, cleaned: bool = False, embedder: Embedder = hash_vectors) -> DataFrame:
    """Index all documents; returns (or with ``dry_run`` only plans) the indexed chunks. A write moves the revision on."""
    settings = settings or Settings()
    docs = docs if cleaned else clean_documents(docs)
    if dry_run:
        return vectors(docs, settings, embedder)[0]
    rows = _embedded(spark, docs, path, settings, embedder)
    store = Collection(spark, path)
    if not store.exists() or recreate:
        store.ensure(rows, recreate=True)
    else:
        store.replace_documents(rows)
    return store.read()


def replace_document(spark: SparkSession, document: DataFrame, path: str, settings: Settings | None = None, embedder: Embedder = hash_vectors) -> int:
    """Index one document in the place of its old chunks; a stub or a document without chunks raises ``ValueError``."""
    settings = settings or Settings()
    rows = _embedded(spark, clean_documents(document), path, settings, embedder)
    if rows.isEmpty():
        raise ValueError("the document has too little prose to index")
    store = Collection(spark, path)
    return store.replace_document(rows) if store.exists() else store.ensure(rows)
