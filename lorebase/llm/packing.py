"""Lexical retrieval packing: fill fixed windows with a seed document and its BM25 neighbours.

The inverted index is sharded, and documents are dealt to shards by what they share: a first pass over all documents
counts in how many each term (lower-cased word, by hash cell) occurs, and each document is named by one of its terms,
drawn by lot with odds in proportion to the term's idf weight. The lot is the same for a term in all documents, so two
documents get one name with the probability of their weighted overlap (the weight of their common terms over that of all
their terms): copies always, near copies nearly always, documents that share rare passages often. Names are dealt to
shards of about ``SHARD_DOCS`` documents and ``SHARD_BYTES`` bytes; a name with more than that is split over several.

A shard tokenises its documents and builds an inverted index (postings sorted by term). Long documents first give up
full windows. Then the next unused document seeds a window, the index scores all unused documents of the shard by BM25
against the seed's terms, and the window is filled greedily in that order: first with every neighbour that fits whole,
then the best remaining one is cut to fill it exactly; its rest is the next seed. So only a shard's last window is
padded, and that one is cut into sequences of 2048, 1024, ... ids as its length needs, which take no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens as T

WINDOW, END_ID = 4096, 2
SHARD_DOCS, SHARD_BYTES = 1024, 6 << 20
#: Bytes of texts whose unknown words are merged together.
ENCODE_BYTES = 3 << 20
#: Cells of the table of document frequencies, and how often a task must meet a term's cell to report it.
CELL_BITS, REPORT = 20, 3
#: Split names (about 40 bytes each) up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_NAMES = 100_000
K1, B = 1.5, 0.75
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class ShardIndex:
    """BM25 inverted index over the documents of one shard, from one row of (document, term) per word."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, n_docs: int):
        # one sorted key: the document's number takes the place of the lowest bits of the spread term
        bits = np.uint64(max(1, (n_docs - 1).bit_length()))
        key = np.sort(term * np.uint64(0x9E3779B97F4A7C15) >> bits << bits | doc.astype(np.uint64))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(key))).astype(np.float64)
        self.doc, t = (key[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), key[at] >> bits
        first = np.ones(len(t), bool)
        first[1:] = t[1:] != t[:-1]
        start = np.flatnonzero(first)
        self.start = np.append(start, len(t))
        df = np.diff(self.start)
        dl = np.bincount(doc, minlength=n_docs).astype(np.float64)
        norm = K1 * (1 - B + B * dl / max(dl.mean() if n_docs else 1.0, 1.0))
        idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        self.weight = (np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])).astype(np.float32)
        # terms of each document that another document of the shard has too
        number = np.repeat(np.arange(len(df)), df)
        shared = np.repeat(df > 1, df)
        by_doc = np.argsort(self.doc[shared], kind="stable")
        self.terms = number[shared][by_doc]
        self.terms_at = np.searchsorted(self.doc[shared][by_doc], np.arange(n_docs + 1))
        self.n = n_docs

    def scores(self, seed: int) -> np.ndarray:
        t = self.terms[self.terms_at[seed] : self.terms_at[seed + 1]]
        if not len(t):
            return np.zeros(self.n)
        start, n = self.start[t], self.start[t + 1] - self.start[t]
        rows = T.gather(np.arange(len(self.doc)), start, n) if len(t) < 2 else _ranges(start, n)
        return np.bincount(self.doc[rows], self.weight[rows], self.n)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    at = np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return at + np.arange(len(at))


def plan(sizes: np.ndarray, scores, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given sizes.

    ``scores(seed)`` ranks all documents; ties go to the earlier one.
    """
    out: list[tuple[int, int, int, int, int]] = []
    done = np.zeros(len(sizes), np.int64)
    seq = 0
    for d in np.flatnonzero(sizes >= window).tolist():
        for _ in range(int(sizes[d]) // window):
            out.append((d, int(done[d]), window, seq, 0))
            done[d] += window
            seq += 1
    left = sizes - done
    alive = left > 0
    nxt, seed = 0, -1
    while True:
        if seed < 0:
            while nxt < len(sizes) and not alive[nxt]:
                nxt += 1
            if nxt == len(sizes):
                break
            seed = nxt
        room = window - int(left[seed])
        here = [(seed, int(left[seed]))]
        alive[seed] = False
        cut = -1
        if room:
            near = np.flatnonzero(alive)
            if len(near):
                order = near[np.argsort(-scores(seed)[near], kind="stable")]
                lens = left[order]
                i = 0
                while room:
                    fit = np.flatnonzero(lens[i:] <= room)
                    if not len(fit):
                        break
                    i += int(fit[0])
                    here.append((int(order[i]), int(lens[i])))
                    alive[order[i]] = False
                    room -= int(lens[i])
                    i += 1
                if room:
                    open_ = order[alive[order]]
                    if len(open_):
                        cut = int(open_[0])
                        here.append((cut, room))
        at = 0
        for d, n in here:
            out.append((d, int(done[d]), n, seq, at))
            done[d] += n
            left[d] -= n
            at += n
        seq += 1
        seed = cut
    return out


def _powers(pieces: list[tuple[int, int, int, int, int]], window: int) -> list[tuple[int, int, int, int, int]]:
    """Cut the pieces of a short last window into sequences whose lengths are the powers of two in its length."""
    if not pieces:
        return pieces
    last = pieces[-1][3]
    tail = [p for p in pieces if p[3] == last]
    total = sum(p[2] for p in tail)
    if total == window or total & (total - 1) == 0:
        return pieces
    out = [p for p in pieces if p[3] != last]
    sizes = [1 << k for k in range(11, -1, -1) if total >> k & 1]
    seq, room, at = last, sizes[0], 0
    sizes = sizes[1:]
    for d, start, n, _, _ in tail:
        while n:
            take = min(n, room)
            out.append((d, start, take, seq, at))
            start, n, room, at = start + take, n - take, room - take, at + take
            if not room and sizes:
                seq, room, at, sizes = seq + 1, sizes[0], 0, sizes[1:]
    return out


def pack_shard(rows: pa.Table, shard: int, path: str) -> pa.Table:
    """All pieces of one shard, from its (doc_id, text) rows in order."""
    enc = T.encoder(path)
    buf, off = C.buffers(rows["text"])
    n = rows.num_rows
    ids, size, docs, terms = [], np.ones(n, np.int64), [], []
    for i, j, b, o in C.blocks(buf, off, ENCODE_BYTES):
        # words are scanned block by block, and those that the encoder does not know are merged together
        parts = []
        for k, m, b1, o1 in C.blocks(b, o):
            starts, ends, ptr = C.spans(b1, o1)
            docs.append(np.repeat(np.arange(i + k, i + m), np.diff(ptr)))
            terms.append(C.span_hashes(b1, starts, ends, lower=True))
            parts.append((starts + o[k], ends + o[k], C.span_hashes(b1, starts, ends)))
        starts, ends, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(starts):
            continue
        at, m = enc.chunks(b, starts, ends, h)
        ids.append(T.gather(enc.pool, at, m))
        total = np.concatenate(([0], np.cumsum(m)))
        ptr = np.searchsorted(starts, o)
        size[i:j] += total[ptr[1:]] - total[ptr[:-1]]
    ids = np.concatenate(ids) if ids else np.empty(0, np.uint16)
    begin = np.concatenate(([0], np.cumsum(size - 1)))
    index = ShardIndex(np.concatenate(docs), np.concatenate(terms), n) if any(map(len, docs)) else None
    pieces = _powers(plan(size, index.scores if index else lambda _: np.zeros(n)), WINDOW)
    crc = []
    for d, start, length, _, _ in pieces:
        whole = np.empty(length, "<u4")
        stop = min(start + length, int(size[d]) - 1)
        whole[: stop - start] = ids[begin[d] + start : begin[d] + stop]
        whole[stop - start :] = END_ID
        crc.append(zlib.crc32(whole.tobytes()))
    d, start, length, seq, at = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
    doc_id = rows["doc_id"].combine_chunks().take(pa.array(d))
    return pa.table([doc_id, start, length, np.array(crc, np.int64), size[d], (shard << 32) | seq, at], names=SCHEMA.replace(" long", "").split(", "))


def _distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct ones of non-negative integers below 2**63: each round, a key that holds its slot stands for its equals."""
    slots = 1 << max(10, (2 * len(keys)).bit_length())
    out = []
    for _ in range(8):
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - slots.bit_length())).astype(np.int64)
        holder = np.empty(slots, np.int32)
        place = np.arange(len(keys), dtype=np.int32)
        holder[slot] = place
        held = holder[slot]
        out.append(keys[held == place])
        keys = keys[keys[held] != keys]
    return np.concatenate([*out, np.unique(keys)])


@C.frugal
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, documents) of the cells that a task meets in REPORT documents or more; cell -1 counts documents, -2 bytes."""
    count = np.zeros(1 << CELL_BITS, np.int64)
    docs = size = 0
    for batch in batches:
        buf, off = C.buffers(batch.column(0))
        docs, size = docs + batch.num_rows, size + len(buf)
        for i, j, b, o in C.blocks(buf, off):
            starts, ends, ptr = C.spans(b, o)
            cell = (C.span_hashes(b, starts, ends, lower=True) >> np.uint64(64 - CELL_BITS)).astype(np.int64)
            seen = _distinct(np.repeat(np.arange(j - i), np.diff(ptr)) << CELL_BITS | cell)
            np.add.at(count, seen & ((1 << CELL_BITS) - 1), 1)
    at = np.flatnonzero(count >= REPORT)
    yield pa.record_batch([pa.array(np.concatenate([at, [-1, -2]])), pa.array(np.concatenate([count[at], [docs, size]]))], names=["cell", "n"])


def _named(weight: np.ndarray, sizes: bool = False):
    """(doc_id, text, place, name): each document's term that wins the lot, by the value it wins with; 0 without terms.

    With ``sizes``, (name, n, b): documents and bytes of the names in each batch, and no text travels back.
    """

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = C.buffers(batch.column(1))
            name = np.zeros(batch.num_rows, np.int64)
            for i, j, b, o in C.blocks(buf, off):
                starts, ends, ptr = C.spans(b, o)
                if not len(starts):
                    continue
                h = C.span_hashes(b, starts, ends, lower=True)
                draw = (C.mix64(h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64)
                value = -np.log((draw + 1) / 2.0**53) / weight[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                some = np.flatnonzero(np.diff(ptr))
                name[i + some] = np.minimum.reduceat(value, ptr[some]).view(np.int64)
            if sizes:
                u, back = np.unique(name, return_inverse=True)
                total = np.zeros(len(u), np.int64)
                np.add.at(total, back, np.diff(off))
                yield pa.record_batch([pa.array(u), pa.array(np.bincount(back, minlength=len(u)).astype(np.int64)), pa.array(total)], names=["name", "n", "b"])
            else:
                yield pa.record_batch([*batch.columns, pa.array(name)], names=["doc_id", "text", "place", "name"])

    return run


def deal(docs: DataFrame) -> DataFrame:
    """(doc_id, text, shard): documents that share rare terms share a shard."""
    rows = docs.select("text").mapInArrow(_frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cell, n = rows["cell"].to_numpy(), rows["n"].to_numpy()
    total, size = (int(n[cell == k].sum()) for k in (-1, -2))
    # a term that no task repeats is as rare as can be told
    df = np.ones(1 << CELL_BITS)
    df[cell[cell >= 0]] = n[cell >= 0]
    weight = np.log(1 + (total - df + 0.5) / (df + 0.5)).astype(np.float32)
    n_shards = max(1, -(-total // SHARD_DOCS), -(-size // SHARD_BYTES))
    # a row's place is taken where it is read: a task that runs again gives it the same one
    placed = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    weight = np.maximum(weight, 1e-6)
    named = placed.mapInArrow(_named(weight), "doc_id long, text string, place long, name long")
    sums = docs.select("doc_id", "text").mapInArrow(_named(weight, sizes=True), "name long, n long, b long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    parts = F.greatest(F.ceil(F.col("n") / SHARD_DOCS), F.ceil(F.col("b") / SHARD_BYTES)).cast("long")
    split = sums.select(F.col("name").alias("big"), parts.alias("parts")).where("parts > 1")
    # a name is split only if it fills a shard, so there are fewer split names than twice the shards
    split = F.broadcast(split) if 2 * n_shards <= BROADCAST_NAMES else split
    joined = named.join(split, F.col("name") == F.col("big"), "left")
    # part of the text joins in, so that rows with one id are parted, and the row's place parts equal rows
    part = F.pmod(F.xxhash64("doc_id", F.octet_length("text"), "place"), F.coalesce("parts", F.lit(1)))
    shard = F.pmod(F.xxhash64("name", part), F.lit(n_shards)).cast("int")
    return joined.select("doc_id", "text", shard.alias("shard"))


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Rows that share a doc_id are packed separately, in the order of their
    texts. An empty table gives no rows; other columns are not touched.
    """
    C.small_batches(spark)
    path = vocabulary or T.default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        out = pack_shard(rows, key[0].as_py(), path)
        C.give_back()
        return out

    return deal(docs).groupBy("shard").applyInArrow(run, SCHEMA)


def op7_pack_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, C.table(spark, sf_dir, "documents"))
