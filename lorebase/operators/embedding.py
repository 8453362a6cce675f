"""Embeddings behind a protocol, with a table as cache.

The default embedder is deterministic and needs no model: signed hashing of words into ``DIM`` components. It stands in
for a hosted model and makes no claim to its quality.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import frugal

DIM, BATCH = 64, 100
Embedder = Callable[[list[str]], np.ndarray]
_WORD = re.compile(r"\w+")


class _Places(dict):
    """Component and sign of a word, twice the component plus one for a negative sign; kept for words met before."""

    #: Words that a worker keeps.
    MOST = 1 << 18

    def __missing__(self, word: str) -> int:
        h = hashlib.md5(word.encode()).digest()
        place = 2 * (h[0] % DIM) + (h[1] & 1)
        if len(self) < self.MOST:
            self[word] = place
        return place


_places = _Places()


def hash_vectors(texts: list[str]) -> np.ndarray:
    """Unit vectors of signed word counts; a text without words is zero. Component and sign are the first two bytes of a word's md5."""
    words = [[_places[w] for w in _WORD.findall(t.lower())] for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    place = np.fromiter((p for w in words for p in w), np.int64, len(row))
    counts = np.bincount(row * 2 * DIM + place, minlength=len(texts) * 2 * DIM).reshape(len(texts), DIM, 2)
    out = (counts[:, :, 0] - counts[:, :, 1]).astype(float)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


#: Names of one and the same model with different providers.
ALIASES = {"text-embedding-hash-64": "hash-64"}


def cache_key(model: str, text: Column) -> Column:
    """sha256 of model (under its plain name), NUL and text, so a change of model never reads the other's vectors."""
    name = model.rsplit("/", 1)[-1]
    return F.sha2(F.concat(F.lit(ALIASES.get(name, name)).cast("binary"), F.unhex(F.lit("00")), text.cast("binary")), 256)


def misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts (key, text) that the cache does not hold."""
    keyed = texts.select(cache_key(model, F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    return keyed.join(cache.select("key"), "key", "left_anti")


def embed(texts: DataFrame, embedder: Embedder = hash_vectors, isolate: bool = False, retries: int = 5) -> DataFrame:
    """``texts`` with ``vector`` added, in batches of ``BATCH`` rows; vectors of two lengths are an error.

    A call that fails is tried again up to ``retries`` times. With ``isolate`` the texts of a batch that still fails are
    then embedded one by one, and those that fail alone get a null vector.
    """

    def vectors(batch: list[str]) -> np.ndarray:
        for left in range(retries, -1, -1):
            try:
                return np.asarray(embedder(batch), np.float32)
            except (ConnectionError, TimeoutError):
                if not left:
                    raise
                time.sleep(0.1 * 2 ** (retries - left))
        raise AssertionError

    def alone(text: str) -> np.ndarray | None:
        try:
            return vectors([text])[0]
        except Exception:
            return None

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = None
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = batch.slice(a, BATCH)
                texts = [t or "" for t in part.column("text").to_pylist()]
                try:
                    got = list(vectors(texts))
                except Exception:
                    if not isolate:
                        raise
                    got = [alone(t) for t in texts]
                lengths = {len(v) for v in got if v is not None} | ({dim} if dim else set())
                if len(lengths) > 1:
                    raise ValueError("vectors of two lengths in one run")
                dim = lengths.pop() if lengths else dim
                yield pa.record_batch([*part.columns, pa.array(got, pa.list_(pa.float32()))], names=[*part.schema.names, "vector"])

    return texts.mapInArrow(run, T.StructType([*texts.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


def embed_cached(texts: DataFrame, cache: DataFrame, model: str, embedder: Embedder = hash_vectors) -> tuple[DataFrame, DataFrame]:
    """(texts with vectors, new cache rows): each distinct missing text is embedded once."""
    new = embed(misses(texts, cache, model), embedder).select("key", F.lit(model).alias("model"), "vector")
    every = cache.select("key", "model", "vector").unionByName(new)
    keyed = texts.withColumn("key", cache_key(model, F.col("text")))
    return keyed.join(every.select("key", "vector"), "key").drop("key"), new


def check_dimension(vectors: DataFrame) -> DataFrame:
    """Distinct vector lengths and how many rows have each; more than one row is an error upstream."""
    return vectors.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"))
