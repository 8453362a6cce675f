"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again as the
next stage's documents. All but the last return the columns they were given. SQL cannot express the stages (a trained
network, alignments, random rounding), so ``ORACLE_SQL`` is None and they are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm import common, jaccard, langid, lines, mixing, packing

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language: those without a letter or without a likely language go (null and empty texts too).

    The network learns from the documents with a language whose crc32(doc_id) mod 4 is not 2; if there are none, only
    texts without a letter go.
    """
    model = langid.train(docs.where(common.crc_mod(F.col("doc_id"), 4) != 2))
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    names = docs.withColumnsRenamed({c: f"__{c}" for c in ("lang_pred", "score") if c in docs.columns})
    kept = langid.predict(names, model).where(~langid.rejected(F.col("lang_pred"), F.col("score"))).drop("lang_pred", "score")
    return kept.withColumnsRenamed({"__lang_pred": "lang_pred", "__score": "score"}).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated blocks out of later documents; documents that are left without a word by that go."""
    out = lines.dedup_lines(spark, docs, gone_as="__gone_lines")
    changed = F.size("__gone_lines") > 0
    out = out.where(~changed | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of linked documents, and all that link with none.

    Rows are told apart by id and text: of rows that agree in both one stays, and a row without an id stays if nothing
    with a smaller id (any id) links with it; of several rows without an id in one group the one with the least text hash.
    """
    scratch = common.Scratch(spark, "near")
    found = scratch.save(jaccard.classes(spark, docs, with_text=True).select("doc_id", "mark", "group"), "found")
    grouped = found.where("group is not null")
    best = grouped.groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "mark")).alias("b")).where("n > 1")
    best = scratch.save(best.select("group", "n", F.col("b.doc_id").alias("best_id"), F.col("b.mark").alias("best_mark"), F.lit(True).alias("several")), "best")
    named = common.attach(grouped, best, ["group"], ["best_id", "best_mark", "several"], found.count(), ["doc_id", "mark"])
    stays = F.col("doc_id").eqNullSafe(F.col("best_id")) & F.col("mark").eqNullSafe(F.col("best_mark"))
    gone = scratch.save(named.where(F.col("several") & ~stays).select(F.col("doc_id").alias("__gid"), F.col("mark").alias("__gmark")).distinct(), "gone")
    # what goes is little as a rule, and then the texts are not shuffled; in no case are they sorted
    gone = F.broadcast(gone) if gone.count() <= jaccard.BROADCAST_ROWS else gone.hint("shuffle_hash")
    own = docs.withColumn("__mark", F.xxhash64("text")).withColumn("__id", F.col("doc_id").cast("long"))
    out = own.join(gone, F.col("__id").eqNullSafe(F.col("__gid")) & F.col("__mark").eqNullSafe(F.col("__gmark")), "left_anti").drop("__mark", "__id")
    repeated = not found.groupBy("doc_id", "mark").count().where("count > 1").isEmpty()
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    common.shrink(spark)
    return mixing.apply_mix(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    common.shrink(spark)
    return packing.pack(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
