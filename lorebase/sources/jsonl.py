"""JSON Lines sources with a fixed schema; a bad line is an error that names its file and line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUESTION = "question_id string, question string, category string, relevant_document_ids array<string>, relevant_sections array<string>, notes string, held_out boolean"
CONVERSATION = QUESTION + ", history array<struct<role:string,content:string>>"
CACHE_PAIR = QUESTION + ", anchor_id string, kind string"
TRACE = (
    "schema_version int, trace_id string, started_at timestamp, question string, resolved_query string, history_turns int, follow_up boolean, "
    "follow_up_repeat boolean, model string, retrieval_mode string, transform string, reranker string, compressor string, prompt_version string, top_k int, "
    "chunks array<struct<chunk_id:string,document_id:string,rank:int,score:double,rerank_score:double,used:boolean,cited:boolean>>, system_prompt string, "
    "user_prompt string, response string, refusal string, cache string, warnings array<string>, usage map<string,int>, cost_usd double, "
    "timings struct<contextualize_ms:double,retrieval_ms:double,context_ms:double,generation_ms:double,total_ms:double>, error_type string, error_message string"
)
#: Rows of a benchmark history; what a kind of run does not have is null, and null fields are not published.
HISTORY = (
    "label string, timestamp string, git_commit string, config map<string,string>, ks array<int>, questions long, answerable long, unanswerable long, failures long, refusals long, "
    "aggregate map<string,double>, per_category map<string,map<string,double>>, latency_p50_ms double, latency_p95_ms double"
)
# Categories of questions and kinds of cache pairs.
CATEGORIES = ("conceptual", "code", "exact", "multi_doc", "unanswerable")
KINDS = ("paraphrase", "near_miss", "unanswerable")


def read_lines(spark: SparkSession, path: str, schema: str, comments: bool = True) -> DataFrame:
    """Rows of the given schema with file, line (from 1) and bad (the raw text of a line that is no such object)."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("mid"), "value")
    raw = raw.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("at", "mid")))
    raw = raw.where((F.trim("value") != "") & (~F.ltrim("value").startswith("#") if comments else F.lit(True)))
    row = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return raw.select("file", "line", row.alias("row")).select("file", "line", "row.*").withColumnRenamed("_bad", "bad")


def fail_if(rows: DataFrame, wrong: Column, message: str) -> None:
    """Raise ``ValueError`` with file and line of the first row for which ``wrong`` holds."""
    first = rows.where(wrong).orderBy("file", "line").select("file", "line").head()
    if first:
        raise ValueError(f"{first['file']}:{first['line']}: {message}")


def read_questions(spark: SparkSession, path: str, category: str | None = None, schema: str = QUESTION) -> DataFrame:
    """Labelled questions: no duplicate id, a known category, and no labels exactly for unanswerable ones."""
    rows = read_lines(spark, path, schema)
    fail_if(rows, F.col("bad").isNotNull() | F.col("question_id").isNull(), "not a question")
    rows = rows.drop("bad").withColumns({"held_out": F.coalesce("held_out", F.lit(False)), "relevant_document_ids": F.coalesce("relevant_document_ids", F.array().cast("array<string>")), "relevant_sections": F.coalesce("relevant_sections", F.array().cast("array<string>"))})
    fail_if(rows, F.coalesce(F.trim("question"), F.lit("")) == "", "blank question")
    fail_if(rows, ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)), "unknown category")
    fail_if(rows, (F.size("relevant_document_ids") == 0) != (F.col("category") == "unanswerable"), "labels and category disagree")
    again = F.row_number().over(Window.partitionBy("question_id").orderBy("file", "line"))
    fail_if(rows.withColumn("n", again), F.col("n") > 1, "duplicate question_id")
    return rows.where(F.col("category") == category) if category else rows


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    return read_questions(spark, path, schema=CONVERSATION)


def read_cache_pairs(spark: SparkSession, path: str) -> DataFrame:
    rows = read_questions(spark, path, schema=CACHE_PAIR)
    fail_if(rows, ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind")
    fail_if(rows, (F.col("kind") == "unanswerable") != (F.col("category") == "unanswerable"), "kind and category disagree")
    return rows


def read_injections(spark: SparkSession, path: str) -> DataFrame:
    """question_id x attack rows of an injection fixture (one JSON object)."""
    schema = "question_ids array<string>, attacks array<struct<attack_id:string,attack:string,phrasing:string,text:string>>"
    one = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return one.select(F.explode("question_ids").alias("question_id"), "attacks").select("question_id", F.inline("attacks"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    rows = read_lines(spark, path, TRACE, comments=False)
    fail_if(rows, F.col("bad").isNotNull() | F.col("trace_id").isNull(), "not a trace")
    return rows.drop("bad")


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Benchmark history in file order (column ``line``)."""
    rows = read_lines(spark, path, schema, comments=False)
    fail_if(rows, F.col("bad").isNotNull(), "not a JSON object")
    fail_if(rows, F.coalesce(F.col("label"), F.lit("")) == "", "benchmark row has no label")
    return rows.drop("bad")


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines (traces, benchmark history)."""
    df.write.mode("append").json(path)


def write_data_script(snapshot: dict, path: str) -> None:
    """A small report as a script that a page can load from disk."""
    import json

    with open(path, "w", encoding="utf-8") as f:
        f.write(f"window.BENCHMARK_DATA = {json.dumps(snapshot, ensure_ascii=False, separators=(',', ':'), sort_keys=True)};\n")
