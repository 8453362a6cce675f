"""Markdown trees as rows of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown, text


def read_markdown(spark: SparkSession, root: str, source: str, base_url: str | None = None) -> DataFrame:
    """One row per .md or .markdown file (any case) below ``root`` outside dot-folders; no other file is read.

    Bytes that are no UTF-8 become replacement characters. document_id, source, title, path, doc_type, url, language, text, content_hash (of the file's bytes).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[mM][dD],[mM][aA][rR][kK][dD][oO][wW][nN]}").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    # file URIs are percent-encoded
    full = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    relative = F.substr(full, F.locate(base, full) + F.lit(len(base)))
    rows = files.select(relative.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("content_hash"))
    rows = rows.where(~F.col("path").rlike(r"(^|/)\."))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    slug = F.when(stem == "index", "").otherwise(F.regexp_replace(stem, "/index$", ""))
    url = F.lit(None).cast("string") if base_url is None else F.concat(F.lit(base_url + "/"), F.when(slug == "", "").otherwise(F.concat(slug, F.lit("/"))))
    return rows.select(
        F.concat(F.lit(f"{source}:"), stem).alias("document_id"),
        F.lit(source).alias("source"),
        markdown.title_column(F.col("text"), F.substring_index(stem, "/", -1)).alias("title"),
        "path",
        text.doc_type(F.col("path")).alias("doc_type"),
        url.alias("url"),
        F.lit("en").alias("language"),
        "text",
        "content_hash",
    )


def clean_documents(docs: DataFrame, least_prose: int = markdown.LEAST_PROSE) -> DataFrame:
    """Cleaned texts with a new hash; documents with less prose than ``least_prose`` go."""
    cleaned = docs.withColumn("text", markdown.clean_column(F.col("text")))
    return cleaned.where(markdown.prose_length_column(F.col("text")) >= least_prose).withColumn("content_hash", text.content_hash(F.col("text")))


def from_table(docs: DataFrame) -> DataFrame:
    """Rows of the ``documents`` table as documents: the source's name is also the title, the language the type."""
    return docs.select(
        F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("document_id"),
        "source",
        F.col("source").alias("title"),
        F.col("lang").alias("doc_type"),
        F.lit(None).cast("string").alias("url"),
        F.col("lang").alias("language"),
        "text",
        text.content_hash(F.col("text")).alias("content_hash"),
    )
