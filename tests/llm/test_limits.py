"""What operators move and repeat: texts are dealt once and not sorted, unknown words are merged together."""

from collections import Counter

import numpy as np
import pyarrow as pa

from lorebase.llm import ann, jaccard, mixing, packing, tokens


def test_mixed_texts_are_not_sorted(spark):
    rows = [(k, f"a b {'c ' * (k % 7)}{k}", "ab"[k % 2]) for k in range(300)]
    out = mixing.apply_mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_mixed_rows_that_repeat_are_taken_as_decided(spark):
    """Rows that agree in id, source and size, with the same text or another, are taken as often as the mix says."""
    rows = [(k % 40, f"{'a b' if k % 3 else 'c d'} e f", "ab"[k % 2]) for k in range(400)] + [(None, "x y z", None)] * 9 + [(1, None, "a"), (1, " ", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want = Counter()
    for r in mixing.mix(spark, docs).collect():
        want[r["doc_id"], r["source"]] += r["copies"]
    got = mixing.apply_mix(spark, docs).collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == +want
    held = Counter((r["doc_id"], r["text"], r["source"]) for r in got)
    there = Counter(rows)
    assert all(n <= 2 * there[k] for k, n in held.items())


def test_unknown_words_of_a_shard_are_merged_together(monkeypatch):
    rnd = np.random.default_rng(3)
    texts = [" ".join("".join(chr(97 + c) for c in rnd.integers(0, 26, 9)) for _ in range(20_000)) for _ in range(14)]
    rows = pa.table({"doc_id": pa.array(range(14), pa.int64()), "text": texts})
    enc, calls = tokens.encoder(tokens.default_vocabulary()), []
    real = enc._distinct
    monkeypatch.setattr(enc, "_distinct", lambda *a: calls.append(len(a[1])) or real(*a))
    got = packing.pack_shard(rows, 0, tokens.default_vocabulary())
    assert len(calls) == 1 and sum(len(t) for t in texts) > 2 << 20
    sizes = {i: len(enc.lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    assert dict(zip(got["doc_id"].to_pylist(), got["doc_tokens"].to_pylist(), strict=True)) == sizes


def test_names_are_counted_without_their_texts():
    batch = pa.record_batch([pa.array([1, 2, 3, 4]), pa.array(["a b c", "a b c", None, "zz"])], names=["doc_id", "text"])
    weight = np.ones(1 << packing.CELL_BITS, np.float32)
    named = next(packing._named(weight)(iter([batch.append_column("place", pa.array([0, 1, 2, 3]))])))
    sums = next(packing._named(weight, sizes=True)(iter([batch])))
    assert sums.schema.names == ["name", "n", "b"]
    want, size = Counter(named["name"].to_pylist()), Counter()
    for name, text in zip(named["name"].to_pylist(), batch["text"].to_pylist(), strict=True):
        size[name] += len(text or "")
    assert {r["name"]: (r["n"], r["b"]) for r in sums.to_pylist()} == {k: (want[k], size[k]) for k in want}


def test_distinct_keys():
    rnd = np.random.default_rng(1)
    for keys in (rnd.integers(0, 50, 4000), rnd.integers(0, 1 << 40, 4000), np.arange(0), np.zeros(9, np.int64), np.arange(3000) << 20):
        assert np.array_equal(np.sort(packing._distinct(keys)), np.unique(keys))


def test_near_duplicates_go_without_moving_texts(spark, monkeypatch):
    import corpus_pipeline

    text = lambda k: " ".join(f"w{k * 31 + i}" for i in range(40))
    rows = [(k, text(k)) for k in range(60)] + [(100 + k, text(k % 3)) for k in range(40)] + [(None, text(4)), (None, "alone " + text(900)), (70, None), (71, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted([*map(str, range(60)), "70", "71", "None"])
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and "LeftAnti" in plan
    assert sorted(str(r["doc_id"]) for r in out.collect()) == want
    monkeypatch.setattr(corpus_pipeline.jaccard, "BROADCAST_ROWS", 0)
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == want


def test_search_opens_several_nodes_in_few_rounds(monkeypatch):
    """A search for many queries looks at its nodes in few rounds, sees each node once and finds the nearest ones."""
    x = np.random.default_rng(2).normal(size=(3000, 24)).astype(np.float32)
    graph = ann.Graph(x[:2800], 1)
    rounds, real = [], np.argpartition
    monkeypatch.setattr(ann.np, "argpartition", lambda *a, **k: rounds.append(1) or real(*a, **k))
    found, dist = graph.search(x[2800:], ann.EF)
    assert len(rounds) < 100
    exact = np.square(x[2800:, None, :].astype(float) - x[None, :2800].astype(float)).sum(2)
    want = np.argsort(exact, 1)[:, :10]
    assert np.mean([len({*f[:10]} & {*w}) / 10 for f, w in zip(found, want, strict=True)]) >= 0.95
    assert all(len({*f}) == len(f) for f in found) and (np.diff(dist, axis=1) >= 0).all()


def test_answers_of_a_batch_equal_those_of_each_query():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, (400, 4)).astype(float)
    x = np.unique(x, axis=0)
    off = np.concatenate([[0], np.cumsum(rng.integers(1, 5, len(x)))])
    ids = rng.permutation(off[-1])
    graph = ann.Graph(x, 0)
    node = np.repeat(np.arange(len(x)), np.diff(off))
    some = rng.permutation(off[-1])[:40]
    qid, qv = ids[some], x[node[some]]
    got = ann._answers(graph, off, ids, x, qid, np.ones(40, np.int32), qv, 10, 96).to_pylist()
    assert len(got) == 400
    for i in range(40):
        d = np.sqrt(np.square(x[node] - qv[i]).sum(1))
        want = sorted((float(a), int(b)) for a, b in zip(d, ids, strict=True) if b != qid[i])[:10]
        assert [(r["score"], r["vec_id"]) for r in got if r["query_id"] == qid[i]] == want


def test_frequent_shingles_are_counted_in_place():
    rnd = np.random.default_rng(8)
    for n, high in ((0, 9), (1, 9), (2, 1), (3, 1), (5000, 900), (5000, 9), (4000, 1 << 60)):
        held = [rnd.integers(0, high, m).astype(np.uint64) for m in (n // 2, n - n // 2)]
        u, c = np.unique(np.concatenate(held), return_counts=True)
        got, count = jaccard._often(held)
        assert held == [] and np.array_equal(got.view(np.uint64), u[c >= jaccard.REPORT]) and np.array_equal(count, c[c >= jaccard.REPORT])


def test_queries_go_to_the_shards_and_only_near_rows_leave():
    import io

    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(1200, 6)), rng.normal(size=(30, 6))
    shards = []
    for s in range(12):
        mine = np.arange(s * 100, s * 100 + 100)
        blob = io.BytesIO()
        np.savez(blob, off=np.arange(101), ids=mine, exact=x[mine])
        shards.append((6, ann.Graph(x[mine], s).dump(), blob.getvalue()))
    batch = pa.record_batch([pa.array([s[0] for s in shards], pa.int32()), pa.array([s[1] for s in shards], pa.binary()), pa.array([s[2] for s in shards], pa.binary())], names=["dim", "graph", "copies"])
    asked = pa.table({"vec_id": pa.array(range(5000, 5030)), "v": pa.array(q.tolist(), pa.list_(pa.float64()))})
    got = pa.Table.from_batches(list(ann._look(asked, 10, 96)(iter([batch]))))
    # every shard has ten neighbours of every query
    assert 300 <= got.num_rows < 12 * 300 / 2
    found = got.to_pylist()
    for n in range(30):
        best = sorted((r["score"], r["vec_id"]) for r in found if r["n"] == n)[:10]
        d = np.sqrt(((x - q[n]) ** 2).sum(1))
        assert len({i for _, i in best} & set(np.argsort(d)[:10].tolist())) >= 9
