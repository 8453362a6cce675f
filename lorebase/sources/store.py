"""Collections of chunks with vectors, kept as versioned Parquet tables.

A collection is a catalog-free folder: every write makes a new version folder and then moves the pointer file, so a
reader sees the old or the new version whole, and a failed write changes nothing. Rows are laid out by doc_type, so
filters on it prune files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns on which filters are allowed.
INDEXED_FIELDS = ("source", "document_id", "language", "doc_type")
# Fixed value: namespace of point ids.
POINT_NAMESPACE = uuid.UUID("1f1e7a64-0b9e-5c33-9f0e-2a6c4d8b1e77")


class Collection:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointer(self) -> str:
        return f"{self.path}/CURRENT"

    def exists(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._pointer())
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _versions(self) -> tuple[int, str]:
        row = self.spark.read.json(self._pointer()).orderBy(F.desc("revision")).head()
        return row["revision"], row["folder"]

    def revision(self) -> int:
        """Number of writes so far; part of every answer cache key."""
        return self._versions()[0] if self.exists() else 0

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._versions()[1]}")

    def _write(self, rows: DataFrame) -> int:
        revision, folder = self.revision() + 1, f"v-{uuid.uuid4().hex}"
        rows.write.partitionBy("doc_type").parquet(f"{self.path}/{folder}")
        self.spark.createDataFrame([(revision, folder)], "revision long, folder string").coalesce(1).write.mode("append").json(self._pointer())
        return revision

    def ensure(self, rows: DataFrame, recreate: bool = False) -> int:
        """Create from the given rows unless it exists; ``recreate`` replaces what is there."""
        if self.exists() and not recreate:
            return self.revision()
        _check_vectors(rows)
        return self._write(rows)

    def upsert(self, rows: DataFrame) -> int:
        """Insert or replace by chunk_id; of rows with one chunk_id in ``rows`` the last one stays."""
        _check_vectors(rows)
        last = rows.withColumn("_at", F.monotonically_increasing_id()).groupBy("chunk_id").agg(F.max_by(F.struct(*rows.columns), "_at").alias("r"))
        rows = last.select("r.*")
        old = self.read()
        return self._write(old.join(rows.select("chunk_id"), "chunk_id", "left_anti").unionByName(rows))

    def replace_document(self, rows: DataFrame) -> int:
        """Put one document's chunks in the place of all it had before."""
        ids = [r[0] for r in rows.select("document_id").distinct().limit(2).collect()]
        if len(ids) != 1:
            raise ValueError("a replacement takes the chunks of exactly one document")
        _check_vectors(rows)
        return self._write(replaced(self.read(), rows))

    def replace_documents(self, rows: DataFrame) -> int:
        """Put whole documents in the place of what they had before, so chunks of older, longer versions do not survive."""
        _check_vectors(rows)
        return self._write(replaced(self.read(), rows))

    def stats(self) -> DataFrame:
        return stats(self.read())


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the documents that ``new`` holds taken from ``new``."""
    return old.join(new.select("document_id").distinct(), "document_id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def stale_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunk ids of the replaced documents that have no successor."""
    same = old.join(new.select("document_id").distinct(), "document_id", "left_semi")
    return same.select("chunk_id").exceptAll(new.select("chunk_id"))


def stats(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("points"), F.max(F.size("vector")).alias("dim"), F.lit("cosine").alias("distance"))


def point_id(chunk_id):
    """Name-based (version 5) UUID of a chunk id."""
    h = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE.hex)), chunk_id.cast("binary")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4) + 1)
    return F.concat(F.substr(h, F.lit(1), F.lit(8)), F.lit("-"), F.substr(h, F.lit(9), F.lit(4)), F.lit("-5"), F.substr(h, F.lit(14), F.lit(3)), F.lit("-"), variant, F.substr(h, F.lit(18), F.lit(3)), F.lit("-"), F.substr(h, F.lit(21), F.lit(12)))


def _check_vectors(rows: DataFrame) -> None:
    found = rows.agg(F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b"), F.count_if(F.col("vector").isNull()).alias("n")).head()
    if found["n"] or found["a"] != found["b"]:
        raise ValueError("every chunk needs a vector, and all vectors one length")
