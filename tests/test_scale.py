"""Work that must not grow with the product of queries and rows, against brute force."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorebase.functions import batches, text
from lorebase.operators import chunking, context, evaluation, retrieval


def brute_bm25(docs, queries, k):
    """(query, id, score, rank); rows that share an id and a length count their words together."""
    post = Counter((i, len(t.split()), w) for i, t in docs for w in t.split())
    df = Counter(w for _, _, w in post)
    n, avg = len(docs), sum(len(t.split()) for _, t in docs) / len(docs)
    out = []
    for q, words in queries:
        found = Counter()
        for (i, dl, w), tf in post.items():
            if w in words.split():
                found[i] += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
        best = sorted(((round(s, 6), i) for i, s in found.items()), key=lambda x: (-x[0], x[1]))[:k]
        out += [(q, i, s, r) for r, (s, i) in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("repeated", [False, True])
def test_bm25_in_blocks_and_rounds_is_brute_force(spark, monkeypatch, tmp_path, repeated):
    for name, value in (("BLOCK_ROWS", 7), ("HEAD", 2), ("DENSE_TERMS", 2)):
        monkeypatch.setattr(retrieval, name, value)
    monkeypatch.setattr(retrieval.LexicalIndex, "ASKED", 9)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)]
    docs = [(f"d{k % 50 if repeated else k}", " ".join(rng.choices(words, range(12, 0, -1), k=rng.randint(1, 6)))) for k in range(120)]
    queries = [(k, " ".join(rng.sample([*words, "absent"], 3))) for k in range(11)]
    c = spark.createDataFrame(docs, "chunk_id string, text string").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, query string")
    index = retrieval.LexicalIndex(c)
    want = brute_bm25(docs, queries, 4)
    for got in (index, index.save(str(tmp_path / "i"))):
        rows = sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in got.search(q, 4).collect())
        assert [x[:3] for x in rows] == sorted((a, d, b) for a, b, _, d in want)
        assert [x[3] for x in rows] == pytest.approx([x[1] for x in sorted(((a, d), s) for a, _, s, d in want)], abs=2e-6)


def test_bm25_sends_no_row_per_query_and_match(monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(0)
    parts = [
        pa.record_batch([pa.array([f"{b}-{k}" for k in range(50)]), pa.array(rng.integers(1, 30, 50)), pa.array([[0, 1]] * 50, pa.list_(pa.int32())), pa.array(rng.integers(1, 9, (50, 2)).tolist(), pa.list_(pa.int32()))], names=["chunk_id", "dl", "codes", "tfs"])
        for b in range(40)
    ]
    found = list(retrieval._scored(np.array([0, 1, 2]), np.array([0, 1]), np.array([1.0, 2.0]), 9.0, 5)(iter(parts)))
    # both queries match all 2,000 rows
    assert 2 * 5 <= sum(x.num_rows for x in found) < 2 * 5 * 12


def test_dense_memory_does_not_hold_all_scores():
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(20_000, 8)), rng.normal(size=(3000, 8))
    batch = pa.record_batch([pa.array([f"{k:05}" for k in range(20_000)]), pa.array(list(v), pa.list_(pa.float64()))], names=["chunk_id", "v"])
    tracemalloc.start()
    n = sum(x.num_rows for x in retrieval._nearest(retrieval._unit(q), 10)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # all scores are 480 MB
    assert peak < 120e6 and 3000 * 10 <= n <= 3000 * 20


def test_dense_in_blocks_keeps_ties_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 4)
    monkeypatch.setattr(retrieval, "HEAD", 3)
    monkeypatch.setattr(retrieval, "QUERIES_AT_ONCE", 2)
    rows = spark.createDataFrame([(f"c{k:02}", [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in range(30)], "chunk_id string, vector array<double>").repartition(2)
    q = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(5)], "query_id int, vector array<double>")
    got = retrieval.dense(q, rows, 6).orderBy("query_id", "rank").collect()
    assert [r["chunk_id"] for r in got] == [f"c{k:02}" for k in range(1, 12, 2)] * 5
    assert retrieval.dense(q, rows.limit(2), 6).count() == 10
    assert retrieval.dense(q.where("query_id < 0"), rows, 6).count() == 0


def test_metrics_by_label_are_those_of_the_pairs(spark):
    rng = random.Random(5)
    docs = [(str(k), rng.choice([1, 2, 3, None])) for k in range(60)]
    queries = [(k, docs[k][1]) for k in range(0, 60, 5)]
    ranked = [(q, str(d), r) for q, _ in queries for r, d in enumerate(rng.sample(range(60), 12), 1)]
    d = spark.createDataFrame(docs, "document_id string, label int")
    q = spark.createDataFrame(queries, "query_id int, label int")
    top = spark.createDataFrame(ranked, "query_id int, document_id string, rank int")
    want = evaluation.metrics(top, q.join(d, "label").select("query_id", "document_id"))
    got = evaluation.metrics_by_label(top, q, d)
    found, pairs = (np.array(sorted(map(tuple, x.select(want.columns).collect()))) for x in (got, want))
    assert len(found) == sum(x is not None for _, x in queries) and np.allclose(found, pairs, atol=1e-12)
    with pytest.raises(ValueError):
        evaluation.metrics_by_label(top, q, d.where("label > 9"))
    # a row for each query and relevant document was made by a join on the label alone
    keys = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert len(keys) == 3 and sum(x.count(" = ") for x in keys) == 4


def test_upper_keeps_the_length_of_a_text(spark):
    words = ["Straße ß", "éa", "ﬁn ǰ ᾳ", "", None, "ßß", "ΐx"]
    got = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "k int, t string").select("k", text.upper(F.col("t")).alias("u")).orderBy("k").collect()
    assert [r["u"] for r in got] == ["STRAẞE ẞ", "ÉA", "ﬁN ǰ ᾼ", "", None, "ẞẞ", "ΐX"]


def test_chunks_of_a_batch_leave_in_parts(monkeypatch):
    monkeypatch.setattr(chunking, "CHARS", 100)
    seen = []

    class Docs:
        columns = ["document_id", "text"]
        schema = {"document_id": T.StructField("document_id", T.StringType())}

        def mapInArrow(self, run, schema):
            batch = pa.record_batch([pa.array([str(k) for k in range(50)]), pa.array([None, ""] + ["One two. Three four."] * 48)], names=["document_id", "text"])
            seen.extend(run(iter([batch])))

    chunking._generated(Docs(), lambda t: [(0, 9), (9, len(t))])
    assert len(seen) >= 9 and sum(x.num_rows for x in seen) == 50
    rows = pa.Table.from_batches(seen).to_pylist()
    assert rows[0]["pieces"] == rows[1]["pieces"] == [] and rows[-1]["pieces"] == [{"char_start": 0, "char_end": 9, "text": "One two. ", "section": None}, {"char_start": 9, "char_end": 20, "text": "Three four.", "section": None}]


def test_terms_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(batches, "ITEMS", 10)
    words = [None, [], *([f"w{k % 3}", "w0", f"v{k}"] for k in range(40))]
    got = list(retrieval._counted(iter([pa.record_batch([pa.array([str(k) for k in range(42)]), pa.array(words, pa.list_(pa.string()))], names=["chunk_id", "t"])])))
    assert len(got) >= 12
    rows = pa.Table.from_batches(got).to_pylist()
    for r, w in zip(rows, words, strict=True):
        assert r["dl"] == len(w or []) and dict(zip(r["terms"], r["tfs"], strict=True)) == Counter(w or [])


def test_questions_are_looked_for_in_texts_with_their_word(spark):
    rng = random.Random(2)
    words = ["al", "bet", "gamma", "Delta", "eps_1", "ß", "x"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) + rng.choice(["", ".", "'s"]) for _ in range(80)] + [None]
    asked = ["bet gamma al", "gamma", "lpha", "a Delta x", "et gam", "x eps_1 be", "", "ma Delta", None, "nowhere at all", "delta x al", "al bet"]
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "document_id string, text string")
    questions = spark.createDataFrame([(f"q{k}", q) for k, q in enumerate(asked)], "question_id string, question string")
    got = evaluation.held_whole(questions, docs)
    want = {(f"q{i}", f"d{j}") for i, q in enumerate(asked) for j, t in enumerate(texts) if q is not None and t is not None and q in t}
    assert sorted(map(tuple, got.collect())) == sorted(want) and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_cover_shuffles_no_text(spark):
    docs = spark.createDataFrame([("a", "One. Two. Three four five. " * 80), ("b", ""), ("c", None), ("d", "x ß 😀 y")], "document_id string, text string")
    for name in ("sentence", "recursive", "semantic"):
        got = chunking.cover(docs, name)
        assert sorted(map(tuple, got.collect())) == [("a", 0, 2160, 0), ("d", 0, 7, 0)]
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    off = {"off": lambda d, *_: chunking._generated(d, lambda t: [(0, 2), (3, len(t))])}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(chunking, "STRATEGIES", off)
        m.setattr(chunking, "_pieces", lambda t, split: [(a, b, "?", None) for a, b in split(t)] if t else [])
        assert [r["wrong"] for r in chunking.cover(docs, "off").collect()] == [2, 2]


def test_pools_are_dealt_to_all_cores(spark):
    pool = spark.createDataFrame([(k, "red apple", f"c{j}", j + 1, f"An apple is red. {j} is a number. " * 4) for k in range(40) for j in range(3)], "query_id int, query string, chunk_id string, rank int, text string")
    got = context.compress(pool, budget=60)
    sizes = got.select(F.spark_partition_id().alias("p"), "query_id").groupBy("p").agg(F.count_distinct("query_id").alias("n")).collect()
    # few bytes were one task, whose worker got all texts at once
    assert len(sizes) > 8 and max(r["n"] for r in sizes) < 12 and sum(r["n"] for r in sizes) == 40


def test_vectors_are_made_in_batches(spark):
    from lorebase.operators import embedding

    got = embedding.embed(spark.createDataFrame([(k, "w" * (k % 5) or None) for k in range(250)], "k int, t string").withColumnRenamed("t", "text").coalesce(1), lambda ts: np.array([[len(t), len(ts)] for t in ts], np.float32))
    rows = sorted(map(tuple, got.select("k", "vector").collect()))
    assert [v[0] for _, v in rows] == [k % 5 for k in range(250)] and {v[1] for _, v in rows} <= {100.0, 50.0}
