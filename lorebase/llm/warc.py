"""WARC archives: writing pages with revisit records, and reading archives back by boundary-chain verification.

Writing. A page's payload is its html in UTF-8. Of pages with equal payloads of at least ``LEAST_BYTES`` bytes the one
with the smallest page_id is a ``response``; the others are ``revisit`` records that name it and carry no payload.
Records are written by Spark's own text writer, whose separator is the record end, so archives go to any store Spark
reaches. Each task writes one archive.

Reading. Spark's text reader, with the record magic as its separator, cuts archives at every magic, in parallel and
across splits. Each piece is a candidate record: its offset comes from running sums of lengths over its split and over
the splits of its archive, its successor's offset from its own header. A magic inside a payload makes false candidates,
so pointer jumping along successors from offset 0 keeps only what is reachable from the archive's start. Tasks hold the
candidates of one split: inside it each candidate jumps to where its chain leaves the split, then the places where chains
enter splits jump among each other by joins, and inside the splits that were entered the chains are marked. So an archive
may be of any size. A record whose payload holds a magic is put together again from its pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

MAGIC, END = "WARC/1.1\r\n", "\r\n\r\n"
LEAST_BYTES = 100
#: Copied payloads up to which the table of originals (about 100 bytes a row) is broadcast; beyond, it is joined by shuffle.
BROADCAST_ROWS = 200_000
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line ends inside a value are escaped."""
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archives(spark: SparkSession, pages: DataFrame, path: str, scratch: C.Scratch) -> None:
    """Write every row as one record under ``path``.

    A null html is an empty payload, a null url has no target line. Rows that repeat the response's page_id and payload
    are responses as well. A null page_id sorts last. An empty table writes no record.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest, size = F.sha2(F.col("html").cast("binary"), 256), F.octet_length("html").cast("long")
    keyed = rows.select("page_id", digest.alias("d"), size.alias("n")).where(F.col("n") >= LEAST_BYTES)
    firsts = scratch.save(keyed.groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").select(F.col("d").alias("d1"), "first"), "firsts")
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    rows = rows.withColumn("d", digest).withColumn("n", size)
    rows = rows.join(firsts, F.col("d") == F.col("d1"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    head = F.concat(F.lit(_HTTP), F.col("n").cast("string"), F.lit(END))
    block = F.when(revisit, head).otherwise(F.concat(head, F.col("html")))
    record = F.concat(
        F.lit(MAGIC),
        F.lit("WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\n"),
        _line("WARC-Record-ID", _id(F.col("page_id"))),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"),
        _line("WARC-Target-URI", F.col("url")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("d"))),
        _line("WARC-Refers-To", F.when(revisit, _id(F.col("first")))),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


# --------------------------------------------------------------------------------------------- reading


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magics: file, split start, order in the split, bytes after the magic."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), "value")


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1), F.lit(""))


def _parsed(value: Column) -> dict[str, Column]:
    """Fields of a candidate; null where the bytes do not start with a header."""
    head = F.substring_index(value, END, 1)
    has_end = F.instr(value, END) > 0
    rest = F.substr(value, F.length(head) + F.lit(len(END) + 1))
    http = F.substring_index(rest, END, 1)
    length = F.when(has_end, _field(head, "Content-Length").try_cast("long"))
    size = length - F.octet_length(http) - len(END)
    whole = F.octet_length(value) == F.octet_length(head) + 2 * len(END) + length
    payload = F.when(whole, F.substring(rest.cast("binary"), F.octet_length(http) + F.lit(len(END) + 1), size.cast("int")))
    return {
        "kind": _field(head, "WARC-Type"),
        "record_id": _field(head, "WARC-Record-ID"),
        "url": _field(head, "WARC-Target-URI"),
        "said_digest": F.regexp_extract(F.coalesce(_field(head, "WARC-Payload-Digest"), F.lit("")), "^sha256:(.*)$", 1),
        "refers": _field(head, "WARC-Refers-To"),
        "said_bytes": _field(http, "Content-Length").try_cast("long"),
        "body": F.octet_length(head).cast("long") + 2 * len(END) + length,
        "digest": F.sha2(payload, 256),
        "bytes": F.octet_length(payload).cast("long"),
    }


def _jumps(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Position of each candidate's successor among the sorted offsets, their number if it is none of them."""
    n = len(offset)
    at = np.searchsorted(offset, successor)
    return np.where((at < n) & (offset[np.minimum(at, max(n - 1, 0))] == successor), at, n) if n else at


def reachable(offset: np.ndarray, successor: np.ndarray, entry: np.ndarray | None = None) -> np.ndarray:
    """Which candidates chains of successors visit from the entries (offset 0 by default), by pointer jumping over sorted offsets."""
    n = len(offset)
    jump = np.append(_jumps(offset, successor), n)  # n: nowhere
    seen = np.append(offset == 0 if entry is None else entry, False)
    while True:
        more = seen.copy()
        more[jump[seen]] = True
        if (more[:n] == seen[:n]).all():
            return seen[:n]
        seen, jump = more, jump[jump]


def exits(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """The first offset on each candidate's chain that is not among the given ones."""
    n = len(offset)
    jump = np.append(_jumps(offset, successor), n)
    last = np.arange(n)
    # the last candidate of each chain, by doubling: a chain goes forward, so it has an end
    far = np.where(jump[:n] < n, jump[:n], last)
    while True:
        farther = far[far]
        if (farther == far).all():
            return successor[far]
        far = farther


def _local(rows: pa.Table, *columns: str) -> tuple[pa.Table, list[np.ndarray]]:
    rows = rows.sort_by("offset")
    return rows, [rows[c].to_numpy() for c in columns]


def read_records(spark: SparkSession, path: str, scratch: C.Scratch) -> DataFrame:
    """One row per verified record: file, offset, kind, record_id, url, refers, said_digest, said_bytes, digest, bytes.

    ``digest`` and ``bytes`` are of the payload as read. What follows a broken header is out of reach.
    """
    width = len(MAGIC)
    found = _pieces(spark, path)
    narrow = scratch.save(found.select("file", "block", "mid", F.octet_length("value").cast("long").alias("len"), *[c.alias(k) for k, c in _parsed(F.col("value")).items()]), "candidates")
    # offsets: a running sum over the splits of an archive, and one inside each split
    sums = narrow.groupBy("file", "block").agg(F.sum(F.col("len") + width).alias("sum"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("file").alias("fb"), F.col("block").alias("bb"), (F.coalesce(F.sum("sum").over(before), F.lit(0)) - width).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("mid")
    placed = narrow.join(base, (F.col("file") == F.col("fb")) & (F.col("block") == F.col("bb"))).drop("fb", "bb")
    upto = F.coalesce(F.sum(F.col("len") + width).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("offset", F.col("base") + upto).withColumn("idx", F.row_number().over(inside)).drop("base", "mid")
    placed = scratch.save(placed.withColumn("successor", F.coalesce(F.col("offset") + width + F.col("body"), F.lit(-1))).where("offset >= 0"), "placed")
    seen = _entered(placed, scratch).withColumnsRenamed({"file": "fe", "offset": "oe"}).withColumn("entry", F.lit(True))

    def verify(rows: pa.Table) -> pa.Table:
        rows, (offset, successor) = _local(rows, "offset", "successor")
        return rows.filter(pa.array(reachable(offset, successor, rows["entry"].fill_null(False).to_numpy()))).drop_columns("entry")

    marked = placed.join(seen, (F.col("file") == F.col("fe")) & (F.col("offset") == F.col("oe")), "left").select(*placed.columns, "entry")
    kept = scratch.save(marked.groupBy("file", "block").applyInArrow(verify, placed.schema), "records")
    out = ["file", "offset", "kind", "record_id", "url", "refers", "said_digest", "said_bytes", "digest", "bytes"]
    torn = kept.where("len != body")
    if torn.isEmpty():
        return kept.select(*out)
    # records with a magic in their payload: all pieces from the record to its successor, in order
    t = torn.select(F.col("file").alias("f1"), F.col("offset").alias("o1"), F.col("successor").alias("s1"))
    parts = placed.join(t, (F.col("file") == F.col("f1")) & (F.col("offset") >= F.col("o1")) & (F.col("offset") < F.col("s1"))).select(F.col("file").alias("f2"), F.col("block").alias("b2"), F.col("idx").alias("i2"), "o1", F.col("offset").alias("o2"))
    texts = found.join(t.select("f1").distinct(), F.col("file") == F.col("f1"), "left_semi").withColumn("idx", F.row_number().over(Window.partitionBy("file", "block").orderBy("mid")))
    joined = texts.join(parts, (F.col("file") == F.col("f2")) & (F.col("block") == F.col("b2")) & (F.col("idx") == F.col("i2")))
    whole = joined.groupBy("file", F.col("o1").alias("offset")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o2", "value"))), lambda p: p["value"]), MAGIC).alias("value"))
    mended = whole.select("file", "offset", *[c.alias(k) for k, c in _parsed(F.col("value")).items() if k in out])
    return kept.where("len = body").select(*out).unionByName(mended.select(*out))


def _entered(placed: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(file, offset) of the candidates at which the chains from offset 0 enter a split."""

    def leave(rows: pa.Table) -> pa.Table:
        rows, (offset, successor) = _local(rows, "offset", "successor")
        return pa.table([rows["file"], rows["offset"], pa.array(exits(offset, successor))], names=["file", "offset", "to"])

    chains = placed.select("file", "block", "offset", "successor").groupBy("file", "block").applyInArrow(leave, "file string, offset long, to long")
    chains = scratch.save(chains, "chains")
    goals = chains.select(F.col("file").alias("fg"), F.col("to").alias("og")).distinct()
    at = [F.col("file") == F.col("fg"), F.col("offset") == F.col("og")]
    first = chains.where("offset = 0")
    # places where a chain enters a split, and where it enters the next one
    jump = scratch.save(chains.where("offset > 0").join(goals, at, "left_semi").unionByName(first), "jumps")
    seen = scratch.save(first.select("file", "offset"), "entries")
    n = seen.count()
    while True:
        step = jump.select(F.col("file").alias("fj"), F.col("offset").alias("oj"), F.col("to").alias("tj"))
        target = seen.join(step, (F.col("file") == F.col("fj")) & (F.col("offset") == F.col("oj"))).select("file", F.col("tj").alias("offset"))
        real = target.join(jump.select(F.col("file").alias("fg"), F.col("offset").alias("og")), at, "left_semi")
        seen = scratch.save(seen.union(real).distinct(), "entries")
        now = seen.count()
        if now == n:
            return seen
        n = now
        twice = jump.join(step, (F.col("file") == F.col("fj")) & (F.col("to") == F.col("oj"))).select("file", "offset", F.col("tj").alias("to"))
        jump = scratch.save(twice.unionByName(jump.join(step.select("fj", "oj"), (F.col("file") == F.col("fj")) & (F.col("to") == F.col("oj")), "left_anti")), "jumps")


def _page(record_id: Column) -> Column:
    return F.regexp_extract(F.coalesce(record_id, F.lit("")), "^<urn:page:(-?\\d+)>$", 1).try_cast("long")


def round_trip(spark: SparkSession, pages: DataFrame, scratch: C.Scratch | None = None) -> DataFrame:
    """Write the pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url, archive, offset.

    The archives are removed once they are read; write_archives and read_records keep them.
    """
    scratch = scratch or C.Scratch(spark, "warc")
    path = scratch.path("archives")
    write_archives(spark, pages, path, scratch)
    got = read_records(spark, path, scratch)
    revisit = F.col("kind") == "revisit"
    out = got.select(
        _page(F.col("record_id")).alias("page_id"),
        F.when(revisit, F.col("said_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("said_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(revisit, _page(F.col("refers"))).alias("refers_to"),
        "url",
        F.element_at(F.split("file", "/"), -1).alias("archive"),
        "offset",
    )
    out = scratch.save(out, "read")
    C.remove(spark, path)
    return out


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, C.table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest AS fd, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM d LEFT JOIN f ON fd = payload_digest AND payload_bytes >= 100
"""
