"""Command line: index, search, ask, validate, trace reports and the dashboard's data."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluation, retrieval
from .operators.traces import summary
from .plans import index
from .plans.engine import Engine
from .settings import Settings
from .sources import documents, jsonl


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lorebase")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("index", help="index Markdown trees")
    a.add_argument("--source", action="append", required=True, metavar="NAME=FOLDER[=BASE_URL]", help="repeatable")
    a.add_argument("--strategy", default="sentence")
    a.add_argument("--chunk-size", type=int, default=1000)
    a.add_argument("--chunk-overlap", type=int, default=200)
    a.add_argument("--limit", type=int)
    a.add_argument("--dry-run", action="store_true")
    a.add_argument("--recreate", action="store_true")
    for name in ("search", "ask"):
        a = sub.add_parser(name)
        a.add_argument("question")
        a.add_argument("--mode", default="dense")
        a.add_argument("--top-k", type=int, default=5)
        a.add_argument("--filter", action="append", default=[])
    a = sub.add_parser("trace-report")
    a.add_argument("file")
    a = sub.add_parser("validate")
    a.add_argument("file")
    a = sub.add_parser("build-dashboard")
    a.add_argument("--history", action="append", default=[], metavar="KIND=FILE")
    a.add_argument("--out", default="data.js")
    for s in sub.choices.values():
        s.add_argument("--store", default="lorebase-store")
        s.add_argument("--collection", default="default")
    return p


def validate(questions, known) -> list[str]:
    """What is wrong with a set of labelled questions: too few, thin categories, labels of unknown documents."""
    n = questions.agg(F.count("*").alias("n"), F.avg(F.when(F.size("relevant_document_ids") > 0, F.size("relevant_document_ids"))).alias("labels")).head()
    wrong = [] if n["n"] >= evaluation.LEAST_QUESTIONS else [f"{n['n']} questions, fewer than {evaluation.LEAST_QUESTIONS}"]
    spark = questions.sparkSession
    floors = evaluation.category_floors(questions, spark.createDataFrame([(c,) for c in jsonl.CATEGORIES], "category string"))
    wrong += [f"category {r['category']} has {r['n']} questions, fewer than {evaluation.LEAST_PER_CATEGORY}" for r in floors.where("not enough").orderBy("category").collect()]
    if known is not None:
        wrong += [f"{r['question_id']} names the unknown document {r['document_id']}" for r in evaluation.unknown_labels(questions, known).orderBy("question_id", "document_id").collect()]
    return wrong


def _index(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    docs = None
    for spec in args.source:
        name, folder, *url = spec.split("=", 2)
        part = documents.read_markdown(spark, folder, name, url[0] if url else None)
        docs = part if docs is None else docs.unionByName(part)
    docs = docs.orderBy("document_id").limit(args.limit) if args.limit else docs
    engine = Engine(spark, f"{args.store}/{args.collection}", Settings(chunk_strategy=args.strategy, chunk_size=args.chunk_size, chunk_overlap=args.chunk_overlap))
    out = []
    for stage, count in (
        ("loaded", lambda: docs.count()),
        ("cleaned", lambda: documents.clean_documents(docs).count()),
        ("planned" if args.dry_run else "indexed", lambda: engine.index(docs, recreate=args.recreate, dry_run=args.dry_run).count()),
    ):
        began = time.perf_counter()
        out.append(f"{stage}: {count()} rows in {time.perf_counter() - began:.1f} s")
    return out


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("lorebase").getOrCreate()
    where = f"{args.store}/{args.collection}"
    if args.what == "index":
        print("\n".join(_index(spark, args)))
    elif args.what in ("search", "ask"):
        engine = Engine(spark, where, Settings(retrieval_mode=args.mode, top_k=args.top_k))
        asked = spark.createDataFrame([("q", args.question)], "query_id string, question string")
        engine.ask(asked, retrieval.parse_filters(args.filter)).select("answer" if args.what == "ask" else F.explode("sources")).show(50, False)
    elif args.what == "trace-report":
        summary(jsonl.read_traces(spark, args.file)).show(vertical=True)
    elif args.what == "build-dashboard":
        kinds = dict(x.split("=", 1) for x in args.history)
        rows = {k: jsonl.read_history(spark, f, jsonl.HISTORY) for k, f in kinds.items()}
        jsonl.write_data_script(evaluation.snapshot(rows), args.out)
        print(f"wrote {args.out}")
    else:
        questions = jsonl.read_questions(spark, args.file)
        known = Engine(spark, where).store.read().select("document_id").distinct() if index.exists(spark, f"{where}/collection/CURRENT") else None
        wrong = validate(questions, known)
        mean = questions.where(F.size("relevant_document_ids") > 0).agg(F.avg(F.size("relevant_document_ids"))).head()[0] or 0.0
        print("\n".join([*wrong, f"{questions.count()} questions, {mean:.2f} labels each"]))
        return 1 if wrong else 0
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
