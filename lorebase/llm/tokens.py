"""Token counts by a whole-token shortcut.

The tokenizer drops white space and never merges across it, so a text is the concatenation of its space-separated
chunks, and a chunk is a sequence of pre-tokens (a run of letters, one digit, a run of other signs). When a worker
starts, every vocabulary string that the library itself encodes to that one token is recorded with a proof by
encoding it; pre-tokens found in this table are counted directly. Only the rest is merged, all distinct ones of a
batch at once: each round takes every word's lowest-ranked, leftmost pair. Chunks with signs outside ASCII and the
accented Latin-1 letters, with an apostrophe (contractions) or with ``<`` (special strings) go to the library whole.
Results per distinct chunk are kept in a bounded table of the worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Tokens above which a document is marked.
TOKEN_LIMIT = 2048
_SLOTS, _POOL = 1 << 21, 1 << 23
_SHIFT = np.uint64(65 - _SLOTS.bit_length())
#: Longer pre-tokens are merged by the library.
_LONGEST = 48


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else 256 and on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of ``values[start : start + length]`` over all rows."""
    total = int(length.sum())
    if not total:
        return values[:0]
    at = np.repeat(start - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    at += np.arange(total)
    return values[at]


class Known:
    """Bounded table from hashes to id sequences: a newcomer takes its slot, and a full pool starts anew."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(_SLOTS, np.uint64)
        self.at, self.n = np.zeros(_SLOTS, np.int32), np.zeros(_SLOTS, np.int32)
        self.pool, self.used = np.empty(1 << 16, np.uint16), 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of ids, and the rows that are not known."""
        if self.used > _POOL:
            self.clear()
        slot = (h >> _SHIFT).astype(np.int64)
        return self.at[slot].astype(np.int64), self.n[slot].astype(np.int64), np.flatnonzero(self.keys[slot] != h)

    def add(self, h: np.ndarray, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        begin = self.used + np.concatenate(([0], np.cumsum(n)[:-1]))
        need = self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(need, 2 * len(self.pool)) - self.used, np.uint16)])
        self.pool[self.used : need] = ids
        self.used = need
        slot = (h >> _SHIFT).astype(np.int64)
        self.keys[slot], self.at[slot], self.n[slot] = h, begin, n
        return begin


class Encoder:
    """Ids of space-separated chunks, exactly as the library gives them for a word-end BPE vocabulary."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, chars = model["vocab"], _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + "</w>"] for c in chars], np.int64)
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in model["merges"]], np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self._prove(vocab, {c: b for b, c in enumerate(chars)})
        self.known, self.pretokens = Known(), Known()
        ok = np.zeros(256, bool)
        ok[0x21:0x7F] = True
        ok[[ord("'"), ord("<")]] = False
        self.plain = ok
        kind = np.full(256, 3, np.uint8)
        for a, b in ((65, 91), (97, 123), (0x80, 0x100)):
            kind[a:b] = 1
        kind[48:58] = 2
        self.kind = kind

    def _prove(self, vocab: dict[str, int], byte_of: dict[str, int]) -> None:
        """Keep the whole-word vocabulary strings whose own encoding is that single token."""
        texts, ids = [], []
        for s, i in vocab.items():
            if s.endswith("</w>") and all(c in byte_of for c in s[:-4]):
                try:
                    texts.append(bytes(byte_of[c] for c in s[:-4]).decode())
                    ids.append(i)
                except UnicodeDecodeError:
                    pass
        got = self.lib.encode_batch(texts, add_special_tokens=False)
        sure = [(t.encode(), i) for t, i, e in zip(texts, ids, got, strict=True) if e.ids == [i]]
        buf = np.frombuffer(b"".join(t for t, _ in sure), np.uint8)
        ends = np.cumsum([len(t) for t, _ in sure])
        starts = np.concatenate(([0], ends[:-1]))
        h = C.span_hashes(buf, starts, ends)
        order = np.argsort(h)
        self.whole, self.whole_id = h[order], np.array([i for _, i in sure], np.int64)[order]

    @property
    def pool(self) -> np.ndarray:
        return self.known.pool

    def chunks(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``pool`` and number of ids of every chunk, whose ``span_hashes`` are ``h``; valid until the next call."""
        h = C.span_hashes(buf, starts, ends) if h is None else h
        at, n, miss = self.known.find(h)
        if len(miss):
            u, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            rows = miss[first]
            ids, count = self._distinct(buf, starts[rows], ends[rows])
            at[miss], n[miss] = self.known.add(u, ids, count)[back], count[back]
        return at, n

    def _distinct(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = ends - starts
        own = gather(buf, starts, size)
        edge = np.concatenate(([0], np.cumsum(size)))
        simple = self._simple(own, edge)
        ids_a, n_a = self._split(gather(own, edge[:-1][simple], size[simple]), size[simple])
        hard = np.flatnonzero(~simple)
        texts = [own[edge[k] : edge[k + 1]].tobytes().decode("utf-8", "replace") for k in hard.tolist()]
        got = [e.ids for e in self.lib.encode_batch(texts, add_special_tokens=False)] if texts else []
        count = np.empty(len(size), np.int64)
        count[simple], count[hard] = n_a, [len(x) for x in got]
        begin = np.empty(len(size), np.int64)
        begin[simple] = np.concatenate(([0], np.cumsum(n_a)[:-1])) if len(n_a) else 0
        if got:
            begin[hard] = len(ids_a) + np.concatenate(([0], np.cumsum(count[hard])[:-1]))
        pool = np.concatenate([ids_a, *[np.array(x, np.int64) for x in got]])
        return gather(pool, begin, count), count

    def _simple(self, own: np.ndarray, edge: np.ndarray) -> np.ndarray:
        ok = self.plain[own]
        lead = own == 0xC3
        trail = (own >= 0x80) & (own <= 0xBF) & (own != 0x97) & (own != 0xB7)
        if lead.any():
            pair = lead[:-1] & trail[1:]
            ok[:-1] |= pair
            ok[1:] |= pair
        bad = np.concatenate(([0], np.cumsum(~ok)))
        return bad[edge[1:]] == bad[edge[:-1]]

    def _split(self, own: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased pre-tokens of simple chunks, counted by table or merged."""
        if not len(own):
            return np.empty(0, np.int64), np.zeros(len(size), np.int64)
        low = own.copy()
        low[(own >= 65) & (own <= 90)] += 32
        high = np.zeros(len(own), bool)
        high[1:] = (own[:-1] == 0xC3) & (own[1:] <= 0x9E) & (own[1:] >= 0x80)
        low[high] += 32
        kind = self.kind[low]
        first = np.empty(len(low), bool)
        first[0] = True
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edge = np.concatenate(([0], np.cumsum(size)))
        first[edge[:-1]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(low))
        h = C.span_hashes(low, starts, ends)
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        k = np.minimum(np.searchsorted(self.whole, u), len(self.whole) - 1)
        sure = self.whole[k] == u
        begin, count = np.cumsum(sure) - 1, np.ones(len(u), np.int64)
        single = self.whole_id[k[sure]]
        rest = np.flatnonzero(~sure)
        b, c, new = self.pretokens.find(u[rest])
        if len(new):
            rows = rest[new]
            ids, m = self._merged(low, starts[at[rows]], ends[at[rows]])
            b[new], c[new] = self.pretokens.add(u[rows], ids, m), m
        begin[rest], count[rest] = len(single) + np.concatenate(([0], np.cumsum(c)[:-1])) if len(c) else b, c
        pool = np.concatenate([single, gather(self.pretokens.pool, b, c).astype(np.int64)])
        n_tok = count[back]
        chunk_of = np.searchsorted(starts, edge)
        total = np.concatenate(([0], np.cumsum(n_tok)))
        return gather(pool, begin[back], n_tok), total[chunk_of[1:]] - total[chunk_of[:-1]]

    def _merged(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge distinct pre-tokens, those of one length together."""
        length = ends - starts
        count, begin = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        pool, used = [], 0
        for n in np.unique(length).tolist():
            rows = np.flatnonzero(length == n)
            if n > _LONGEST:
                got = [e.ids for e in self.lib.encode_batch([low[starts[i] : ends[i]].tobytes().decode() for i in rows.tolist()], add_special_tokens=False)]
                ids, m = np.concatenate([np.array(x, np.int64) for x in got]), np.array([len(x) for x in got])
            else:
                ids, m = self._merge(low[starts[rows, None] + np.arange(n)])
            count[rows], begin[rows] = m, used + np.concatenate(([0], np.cumsum(m)[:-1]))
            pool.append(ids)
            used += len(ids)
        return gather(np.concatenate(pool), begin, count), count

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a << 20 | b
        k = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[k] == key, self.rank[k], 1 << 40), self.made[k]

    def _merge(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte rows of one length -> concatenated ids and the number for each row."""
        rows, n = raw.shape
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        left = np.full(rows, n, np.int64)
        live = np.arange(rows)
        if n > 1:
            rank, made = self._ranks(ids[:, :-1], ids[:, 1:])
            cur, width = ids.copy(), n
            while len(live):
                k = rank[:, : width - 1].argmin(1)
                here = np.arange(len(live))
                go = rank[here, k] < 1 << 40
                if not go.all():
                    stop = ~go
                    ids[live[stop], :width], left[live[stop]] = cur[stop, :width], width
                    live, cur, rank, made, k = live[go], cur[go], rank[go], made[go], k[go]
                    here = np.arange(len(live))
                    if not len(live):
                        break
                cur[here, k] = made[here, k]
                width -= 1
                if width == 1:
                    ids[live, 0], left[live] = cur[:, 0], 1
                    break
                after = np.arange(width)[None, :]
                cur = np.take_along_axis(cur, after + (after > k[:, None]), 1)
                after = after[:, : width - 1]
                step = np.minimum(after + (after >= k[:, None]), width - 1)
                rank, made = np.take_along_axis(rank, step, 1), np.take_along_axis(made, step, 1)
                for side in (k - 1, k):
                    ok = np.flatnonzero((side >= 0) & (side < width - 1))
                    s = side[ok]
                    rank[ok, s], made[ok, s] = self._ranks(cur[ok, s], cur[ok, s + 1])
        return ids[np.arange(n)[None, :] < left[:, None]], left


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; a null or empty text has 0 of both, repeated rows repeat."""
    C.small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            buf, off = C.buffers(batch.column(1))
            n_tok = np.zeros(batch.num_rows, np.int64)
            for i, j, b, o in C.blocks(buf, off):
                starts, ends, ptr = C.spans(b, o)
                if len(starts):
                    total = np.concatenate(([0], np.cumsum(enc.chunks(b, starts, ends)[1])))
                    n_tok[i:j] = total[ptr[1:]] - total[ptr[:-1]]
            yield pa.record_batch([batch.column(0), pa.array(np.diff(off)), pa.array(n_tok), pa.array(n_tok > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(C.table(spark, sf_dir, "documents"))
