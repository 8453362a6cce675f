"""From ranked chunks to a prompt: sentence compression, injection guard, context block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import spans, text
from ..sources.shared import spread
from .embedding import Embedder, hash_vectors

GAP = " […] "
SEPARATOR = "\n\n"


def greedy(units: Column, budget: int) -> Column:
    """Positions taken from structs (score, pos, len): best score first, ties to the earlier; one that would overflow is skipped."""
    best_first = F.array_sort(F.transform(units, lambda u: F.struct((-u["score"]).alias("s"), u["pos"].alias("pos"), u["len"].alias("len"))))
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(0).cast("long").alias("used"))

    def step(acc: Column, u: Column) -> Column:
        take = (F.size(acc["kept"]) == 0) | (acc["used"] + u["len"] <= budget)
        taken = F.struct(F.array_append(acc["kept"], u["pos"]).alias("kept"), (acc["used"] + u["len"]).cast("long").alias("used"))
        return F.when(take, taken).otherwise(acc)

    return F.aggregate(best_first, start, step)["kept"]


UNIT = "array<struct<score:double,pos:int,len:int>>"


def score_units(query: str, texts: list[str], penalty: float, embed: Embedder) -> list[tuple[float, int, int]]:
    """(score, position, length) of all sentences of one query's chunk texts, numbered through."""
    bodies = [t[a:b] for t in texts for a, b in spans.sentences(t)]
    v = np.asarray(embed([query, *bodies]), float)
    norm = np.linalg.norm(v, axis=1)
    scale = norm[0] * norm[1:]
    near = np.where(scale > 0, (v[1:] @ v[0]) / np.where(scale > 0, scale, 1), 0.0)
    size = np.array([len(x) for x in bodies], int)
    return list(zip((near / np.maximum(size, 1) ** penalty).tolist(), range(len(bodies)), size.tolist(), strict=True))


def assemble(texts: list[str], kept: set[int]) -> list[str | None]:
    """Each text from its kept sentences in order, with a gap mark where some are missing; None where none is kept."""
    out, first = [], 0
    for t in texts:
        units = spans.sentences(t)
        mine = [(first + k, t[a:b]) for k, (a, b) in enumerate(units) if first + k in kept]
        first += len(units)
        parts = [body if i == 0 or mine[i - 1][0] + 1 == at else GAP + body for i, (at, body) in enumerate(mine)]
        # blanks before a gap go
        parts = [p.rstrip() if i + 1 < len(parts) and parts[i + 1].startswith(GAP) else p for i, p in enumerate(parts)]
        out.append("".join(parts).strip() or None)
    return out


def trim(texts: list[str], best_first: list[int], budget: int) -> list[str | None]:
    """The texts from as many of the kept sentences, best first, as the budget holds once gap marks are in; one at least."""
    for n in range(len(best_first), 0, -1):
        shown = assemble(texts, set(best_first[:n]))
        if n == 1 or sum(len(x or "") for x in shown) <= budget:
            return shown
    return [None] * len(texts)


def compress(pool: DataFrame, method: str = "embedding", budget: int = 3688, penalty: float = 0.0, embed: Embedder = hash_vectors) -> DataFrame:
    """Pools (query_id, query, chunk_id, rank, text, ...) with shorter texts; emptied chunks vanish, ranks and scores stay.

    Sentences are scored against the query, ``greedy`` picks those that fit, and the chunks are put together from them.
    Pools within the budget stay as they are and are not embedded.
    """
    if not method:
        return pool
    if method not in COMPRESSORS:
        raise ValueError(f"unknown compressor {method!r}")
    if budget < 1:
        raise ValueError("the budget must be at least 1")
    score = COMPRESSORS[method]
    # a pool is a few dozen rows: it travels as one array, so whatever made it is computed once
    rows = F.array_sort(F.collect_list(F.struct("rank", F.struct(*pool.columns).alias("row"))))
    pools = spread(pool, "query_id").groupBy("query_id").agg(F.first("query").alias("query"), rows.alias("rows"))
    pools = pools.withColumn("texts", F.transform("rows", lambda x: F.coalesce(x["row"]["text"], F.lit(""))))

    def units(query: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for q, t in zip(query, texts, strict=True):
            if not (q or "").strip():
                raise ValueError("blank query")
            fits = sum(map(len, t)) <= budget
            out.append(None if fits else [{"score": s, "pos": p, "len": n} for s, p, n in score(q, list(t), penalty, embed)])
        return pd.Series(out, dtype=object)

    def shorter(texts: pd.Series, kept: pd.Series) -> pd.Series:
        return pd.Series([list(t) if k is None else trim(list(t), list(k), budget) for t, k in zip(texts, kept, strict=True)], dtype=object)

    scored = pools.withColumn("u", F.pandas_udf(units, UNIT)("query", "texts"))
    done = scored.select("rows", F.pandas_udf(shorter, "array<string>")("texts", greedy(F.col("u"), budget)).alias("shown"))
    each = done.select(F.explode(F.arrays_zip("rows", "shown")).alias("z")).where(F.col("z.shown").isNotNull())
    return each.select(*[F.col("z.shown").alias(c) if c == "text" else F.col("z.rows.row")[c].alias(c) for c in pool.columns])


COMPRESSORS = {"embedding": score_units}


def guard(pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks that match no pattern of planted instructions, (query_id, warning) of those that do)."""
    marked = pool.withColumn("_hit", text.injection(F.col("text")))
    warning = F.concat(F.lit("injection pattern "), F.col("_hit"), F.lit(" in "), F.col("chunk_id"))
    return marked.where(F.col("_hit").isNull()).drop("_hit"), marked.where(F.col("_hit").isNotNull()).select("query_id", "rank", warning.alias("warning"))


def build_context(pool: DataFrame, max_chars: int = 12000, tagged: bool = False) -> DataFrame:
    """(query_id, context, sources, retrieved, used, dropped) of ranked pools.

    Entries are numbered by rank; they stop before the first that would overflow, but the first always stays. As every
    entry has a positive cost, a running sum that stays within the limit says the same as stopping.
    """
    has = set(pool.columns)
    opt = lambda c: F.col(c) if c in has else F.lit(None).cast("string")
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = pool.withColumn("n", F.row_number().over(order))
    head = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("source"), F.lit(" — "), F.col("title"), F.coalesce(F.concat(F.lit(" / "), opt("section")), F.lit("")))
    entry = F.concat(head, F.lit("\n"), F.col("text"))
    if tagged:
        body = F.replace(F.col("text"), F.lit("</entry>"), F.lit("<\\/entry>"))
        entry = F.concat(F.lit('<entry n="'), F.col("n").cast("string"), F.lit('">\n'), head, F.lit("\n"), body, F.lit("\n</entry>"))
    rows = rows.withColumn("entry", entry).withColumn("cost", F.length("entry") + F.when(F.col("n") > 1, len(SEPARATOR)).otherwise(0))
    rows = rows.withColumn("total", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("n") == 1) | (F.col("total") <= max_chars)
    source = F.struct(F.col("n").alias("index"), "document_id", "title", opt("url").alias("url"), opt("section").alias("section"), "chunk_id", "score")
    got = rows.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.when(fits, F.struct("n", "entry", source.alias("source"))))).alias("e"),
        F.count("*").alias("retrieved"),
    )
    used = F.size("e").cast("long")
    return got.select("query_id", F.array_join(F.transform("e", lambda e: e["entry"]), SEPARATOR).alias("context"), F.transform("e", lambda e: e["source"]).alias("sources"), "retrieved", used.alias("used"), (F.col("retrieved") - used).alias("dropped"))


SOURCE = "array<struct<index:int,document_id:string,title:string,url:string,section:string,chunk_id:string,score:double>>"
