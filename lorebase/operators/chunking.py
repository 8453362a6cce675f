"""Chunking: documents -> chunks (document_id, chunk_index, char_start, char_end, text, section, metadata).

A document's chunks come out of its own row in one pass: windows are JVM expressions, the other strategies an Arrow
generator that carries the text along. Nothing is shuffled, and rows that share a document_id are cut separately.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import markdown, spans
from ..functions.batches import CHARS, cuts, frugal
from .embedding import Embedder, hash_vectors

META = ("source", "title", "url", "doc_type", "language")
_PIECE = "array<struct<char_start:int,char_end:int,text:string,section:string>>"
Split = Callable[[str], list[tuple[int, int]]]


def window_spans(text: Column, size: int, overlap: int) -> Column:
    """(char_start, char_end) of windows at stride size - overlap up to the first that reaches the end."""
    stride, n = size - overlap, F.length(text)
    last = F.greatest(F.ceil((n - size) / F.lit(float(stride))), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * stride).alias("char_start"), F.least(k * stride + size, n).alias("char_end")))


def headings(text: str) -> list[tuple[int, str]]:
    """(place, heading) of the headings of level 2 to 6 outside code."""
    code = markdown.code_spans(text)
    return [(m.start(), m[1]) for m in markdown.HEADING.finditer(text) if not any(a <= m.start() < b for a, b in code)]


def sections(chunks: DataFrame, headings: DataFrame) -> DataFrame:
    """As-of join: each chunk takes the last heading (document_id, pos, section) at or before its start."""
    w = Window.partitionBy("document_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = headings.select("document_id", F.col("pos").alias("at"), F.lit(0).alias("kind"), "section", F.lit(None).cast("int").alias("char_end")).unionByName(
        chunks.select("document_id", F.col("char_start").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("section"), "char_end")
    )
    found = both.withColumn("section", F.last("section", ignorenulls=True).over(w)).where("kind = 1")
    return found.select("document_id", F.col("at").alias("char_start"), "char_end", "section")


def _pieces(text: str | None, split: Split) -> list[tuple[int, int, str, str | None]]:
    if not text:
        return []
    heads = headings(text) if "#" in text else []
    places = [p for p, _ in heads]
    out = []
    for a, b in split(text):
        body = text[a:b]
        if body.strip():
            k = bisect_right(places, a)
            out.append((a, b, body, heads[k - 1][1] if k else None))
    return out


def _generated(docs: DataFrame, split: Split) -> DataFrame:
    keep = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("pieces", T.ArrayType(T.StructType([T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("section", T.StringType())])))])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a batch is cut by its characters: what is made of a part leaves before the next one
            for a, b in cuts(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64), CHARS):
                part = batch.slice(a, b - a)
                each = [_pieces(x, split) for x in part.column("text").to_pylist()]
                flat = [p for pieces in each for p in pieces]
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.string())
                fields = [pa.array([p[k] for p in flat], kind) for k, kind in enumerate(kinds)]
                off = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in each])]), pa.int32())
                pieces = pa.ListArray.from_arrays(off, pa.StructArray.from_arrays(fields, ["char_start", "char_end", "text", "section"]))
                yield pa.record_batch([*(part.column(c) for c in keep), pieces], names=[*keep, "pieces"])

    return docs.mapInArrow(run, schema)


def _fixed(docs: DataFrame, size: int, overlap: int, embedder: Embedder) -> DataFrame:
    """Texts without a heading never reach Python."""
    heading = F.coalesce(F.col("text").rlike(r"(?m)^#{2,6}[ \t]"), F.lit(False))
    cut = F.transform(window_spans(F.col("text"), size, overlap), lambda s: F.struct(s["char_start"].alias("char_start"), s["char_end"].alias("char_end"), F.substring(F.col("text"), s["char_start"] + 1, s["char_end"] - s["char_start"]).alias("text"), F.lit(None).cast("string").alias("section")))
    plain = docs.where(~heading).withColumn("pieces", F.filter(cut, lambda p: p["text"].rlike(r"\S")).cast(_PIECE)).drop("text")
    return plain.unionByName(_generated(docs.where(heading), lambda t: spans.split_fixed(t, size, overlap)))


#: Strategies by name; semantic cuts compare sentences with the injected embedder.
STRATEGIES: dict[str, Callable[[DataFrame, int, int, Embedder], DataFrame]] = {
    "fixed": _fixed,
    "recursive": lambda d, size, overlap, _: _generated(d, lambda t: spans.split_recursive(t, size, overlap)),
    "sentence": lambda d, size, overlap, _: _generated(d, lambda t: spans.split_sentence(t, size, overlap)),
    "semantic": lambda d, size, overlap, embedder: _generated(d, lambda t: spans.split_semantic(t, size, overlap, embedder)),
}


def chunk(docs: DataFrame, strategy: str = "sentence", size: int = 1000, overlap: int = 200, embedder: Embedder = hash_vectors) -> DataFrame:
    """Chunks of documents; an unknown strategy or a bad overlap raises before any work. Blank chunks are left out."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunk strategy {strategy!r}")
    spans.check_sizes(size, overlap)
    meta = [c for c in META if c in docs.columns]
    cut = STRATEGIES[strategy](docs.select("document_id", "text", *meta), size, overlap, embedder)
    rows = cut.select("document_id", *meta, F.posexplode("pieces").alias("chunk_index", "p")).select("document_id", "chunk_index", "p.*", *meta)
    return rows.select(F.concat_ws("#", "document_id", F.col("chunk_index").cast("string")).alias("chunk_id"), "document_id", "chunk_index", "char_start", "char_end", "section", "text", *meta)


def cover(docs: DataFrame, strategy: str, size: int = 1000, overlap: int = 200, embedder: Embedder = hash_vectors) -> DataFrame:
    """(document_id, first, last, wrong) of each row that has chunks: where they start and end, and how many are no piece of its text.

    A row's text goes along with its chunks, so nothing is shuffled.
    """
    cut = STRATEGIES[strategy](docs.select("document_id", "text", F.col("text").alias("whole")), size, overlap, embedder).where(F.size("pieces") > 0)
    wrong = F.filter("pieces", lambda p: p["text"] != F.substring(F.col("whole"), p["char_start"] + 1, p["char_end"] - p["char_start"]))
    edge = lambda name: F.transform("pieces", lambda p: p[name].cast("long"))
    return cut.select("document_id", F.array_min(edge("char_start")).alias("first"), F.array_max(edge("char_end")).alias("last"), F.size(wrong).cast("long").alias("wrong"))
