import hashlib

import numpy as np

from lorebase.llm import common, warc

FAKE = warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 60\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi" + " " * 20


def expected(rows):
    big = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            big[b] = min(big.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = b in big and big[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", big[b] if again else None))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("url", "url")
    got = warc.round_trip(spark, df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_round_trip_with_hostile_payloads(spark):
    rows = [(k, f"http://x/{k}", f"page {k} é " + "z" * (k * 7)) for k in range(60)]
    rows += [(100, "a\r\nb", "x" + FAKE + "y"), (101, None, FAKE * 3), (102, "u", warc.MAGIC), (103, "u", warc.MAGIC * 2 + "t"), (104, "u", ""), (105, "u", None)]
    rows += [(106, "u", "\r\n\r\n"), (107, "u", "a\r\n\r\nb\r\n\r\n"), (None, "u", "n" * 150), (108, "u", "n" * 150), (109, "u", "n" * 150), (109, "u", "n" * 150)]
    rows += [(200 + k, "same", "short") for k in range(3)] + [(300 + k, "same", "copy " * 40) for k in range(9)]
    assert run(spark, rows) == expected(rows)


def test_small_splits_cut_records_anywhere(spark):
    rows = [(k, f"http://x/{k}", f"{k}" * (k % 50) + (FAKE if k % 7 == 0 else "")) for k in range(120)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        assert run(spark, rows) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_extra_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, "u", "h", 5, "x")], "page_id long, url string, html string, n int, d string")
    assert warc.round_trip(spark, df).count() == 1


def test_reachable_skips_false_candidates_and_stops_at_breaks():
    offset = np.array([0, 10, 15, 30, 44, 60])
    successor = np.array([10, 30, 44, 60, 60, 75])
    assert warc.reachable(offset, successor).tolist() == [True, True, False, True, False, True]
    assert warc.reachable(offset, np.array([10, -1, 44, 60, 60, 75])).tolist() == [True, True, False, False, False, False]
    assert warc.reachable(offset[1:], successor[1:]).tolist() == [False] * 5


def test_exits_leave_the_split():
    offset, successor = np.array([10, 20, 25, 40]), np.array([20, 40, 90, 70])
    assert warc.exits(offset, successor).tolist() == [70, 70, 90, 70]
    assert warc.exits(offset[:0], successor[:0]).tolist() == []
    assert warc.exits(np.array([5]), np.array([-1])).tolist() == [-1]


def test_one_archive_over_many_splits(spark):
    """An archive of many splits, with records longer than a split, and nothing after a broken header."""
    rows = [(k, None, f"{k} " * (k % 40) + (FAKE if k % 5 == 0 else "") + ("y" * 5000 if k == 50 else "")) for k in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    scratch = common.Scratch(spark, "one")
    path = scratch.path("archives")
    warc.write_archives(spark, df, path, scratch)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    try:
        got = warc.read_records(spark, path, scratch).collect()
        assert len({r["file"] for r in got}) == 1 and len({r["record_id"] for r in got}) == len(got) == 150
        big = {r["record_id"]: r["bytes"] for r in got if r["kind"] == "response"}
        assert all(big.get(f"<urn:page:{i}>", len(h.encode())) == len(h.encode()) for i, _, h in rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    common.clean(spark)
    assert not common._roots
