import random

from pyspark.sql import functions as F

import corpus_pipeline

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_what_is_clean(spark, tmp_path):
    rnd = random.Random(1)
    kinds = {"aa": ["the", "thing", "of", "and", "ing"], "bb": ["über", "straße", "nicht", "sch", "ung"]}
    make = lambda k, n: " ".join(rnd.choice(kinds[k]) + str(rnd.randrange(300)) for _ in range(n))
    rows = [(k, make("ab"[k % 2] * 2, 80), "ab"[k % 2] * 2, f"s{k % 4}") for k in range(240)]
    passage = make("aa", 60)
    rows += [(300, "12 34 !!", "aa", "s0"), (301, None, "aa", "s0"), (302, rows[0][1], "aa", "s0"), (303, rows[1][1] + " tail", "bb", "s1")]
    rows += [(310 + k, make("aa", 40) + "\n" + passage, "aa", "s2") for k in range(5)]
    df = spark.createDataFrame([(i, t, a, s, None if t is None else len(t)) for i, t, a, s in rows], DOC)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = df, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == df.columns
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    clean = set(range(240))
    assert set(seen["language_id"]) == {i for i, *_ in rows} - {300, 301}
    after = seen["line_dedup"]
    assert 302 not in after and clean <= set(after) and passage in after[310]["text"]
    assert all(passage not in after[310 + k]["text"] and after[310 + k]["n_chars"] == len(after[310 + k]["text"]) for k in range(1, 5))
    assert set(seen["near_duplicates"]) == set(after) - {303}
    assert len(seen["mix_sources"]) > 50
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert pieces.groupBy("doc_id").count().count() == len(seen["mix_sources"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg(F.sum("length")).head()[0] == pieces.agg(F.sum("length")).head()[0]


CLASH = ("gone_lines", "lang_pred", "score", "size", "group", "mark", "component_id", "copies", "row_no", "name", "shard")


def test_stages_take_empty_tables_nulls_repeats_and_clashing_names(spark, tmp_path):
    rnd = random.Random(5)
    text = lambda: " ".join(f"w{rnd.randrange(400)}" for _ in range(30))
    rows = [(k, text(), "aa" if k % 2 else "bb", f"s{k % 3}", 9) for k in range(30)]
    rows += [(None, rows[0][1], None, None, None), (None, "lone words of a row without an id", "aa", "s0", 1), (None, None, None, None, None), (40, None, "aa", None, 0), (41, "", "bb", "s1", 0)]
    rows += [rows[3], rows[3], (50, "x " * 30_000, "aa", "s2", 60_000)]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit("mine") for c in CLASH})
    df.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (df, df.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == df.columns
            got = out.collect()
            assert all(r[c] == "mine" for r in got for c in CLASH)
            if docs is not df:
                assert got == []
            elif name == "language_id":
                assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in got) and len(got) >= 30
            elif name == "line_dedup":
                assert len([r for r in got if r["doc_id"] is None]) == 2 + 1 and {r["doc_id"] for r in got} >= set(range(30))
            elif name == "near_duplicates":
                # the row without an id that repeats document 0 goes, the one that links with nothing stays
                assert sorted(str(r["text"]) for r in got if r["doc_id"] is None) == ["None", "lone words of a row without an id"]
                assert sum(r["doc_id"] == 3 for r in got) == 1 and {r["doc_id"] for r in got} >= {*range(30), 40, 41, 50}
            else:
                assert all(r["text"] for r in got)
    pieces = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path))
    assert pieces.where("start = 0").count() == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, df.limit(0), str(tmp_path)).count() == 0
    # a table without a language still loses its letterless texts
    none = df.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.identify_language(spark, none, str(tmp_path)).count() == df.where("length(text) > 0").count()
