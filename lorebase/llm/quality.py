"""Quality classifier over learned subword embeddings.

A document's features are its hashed words, hashed pairs of neighbouring words and character n-grams of 3 to 5 code
points inside words, all in one table of ``BUCKETS`` vectors. Pairs of a word with itself are one feature, whatever the
word is, so that what is learned of repetition carries over to words that were never seen. Word features and n-grams are averaged apart, the two
means are added, and a softmax over two classes follows. Training is numpy stochastic gradient descent, one document at
a time, with steps that shrink per bucket. As averaging and output are linear, prediction folds the output layer into one
number per bucket and sums those over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

BUCKETS, DIM, NGRAMS = 1 << 18, 8, (3, 4, 5)
#: The training sample: at most so many labelled documents of each class, and in all so many bytes of features.
ROWS_PER_CLASS, SAMPLE_BYTES = 1500, 96 << 20
EPOCHS, RATE, SEED, THRESHOLD = 6, 0.4, 7, 0.3
_SHIFT = np.uint64(64 - 18)
_PAIR = np.uint64(0xC6A4A7935BD1E995)


def word_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and word pairs of a block, and the first feature of each text (one entry more)."""
    starts, ends, ptr = C.spans(buf, off)
    h = C.span_hashes(buf, starts, ends, lower=True)
    pair = h.copy()
    if len(h) > 1:
        pair[:-1] = np.where(h[:-1] == h[1:], _PAIR, C.mix64(h[:-1] * _PAIR + h[1:]))
    both = np.empty(2 * len(h), np.uint64)
    both[0::2], both[1::2] = h, pair
    # the pair that starts at a text's last word is none: it repeats the word instead
    last = ptr[1:][np.diff(ptr) > 0] - 1
    both[2 * last + 1] = h[last]
    return (both >> _SHIFT).astype(np.int64), 2 * ptr


class Characters:
    """Code points of a block: their values, the word each is in (-1: a blank) and the first one of each text (one entry more)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        starts, ends, _ = C.spans(buf, off)
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        low = C._LOWER[buf].astype(np.uint64)
        size = np.diff(np.append(at, len(buf)))
        self.value = low[at]
        for k in range(1, 4):
            more = np.flatnonzero(size > k)
            self.value[more] |= low[at[more] + k] << np.uint64(8 * k)
        word = np.searchsorted(starts, at, side="right") - 1
        self.word = np.where((word >= 0) & (at < ends[np.maximum(word, 0)]), word, -1) if len(starts) else np.full(len(at), -1)
        self.first = np.searchsorted(at, off)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the n-grams of words, and the place at which each starts."""
        m = len(self.value) - n + 1
        if m <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero((self.word[:m] == self.word[n - 1 :]) & (self.word[:m] >= 0))
        h = np.full(len(at), n, np.uint64) * np.uint64(0xA24BAED4963EE407)
        for k in range(n):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + self.value[at + k]
        return (C.mix64(h) >> _SHIFT).astype(np.int64), at


def _sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[hi] - total[lo]


def document_features(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their weights in its vector."""
    off = np.array([0, len(buf)])
    words, _ = word_features(buf, off)
    chars = Characters(buf, off)
    grams = np.concatenate([chars.ngrams(n)[0] for n in NGRAMS])
    weight = np.concatenate([np.full(len(words), 1 / max(len(words), 1)), np.full(len(grams), 1 / max(len(grams), 1))])
    u, back = np.unique(np.concatenate([words, grams]), return_inverse=True)
    return u, np.bincount(back, weight, len(u))


@C.frugal
def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = C.buffers(batch.column(2))
        ids, weights = [], []
        for d in range(batch.num_rows):
            u, w = document_features(buf[off[d] : off[d + 1]])
            ids.append(u.astype(np.int32).tobytes())
            weights.append(w.astype(np.float32).tobytes())
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(weights, pa.binary())], names=["y", "u", "f", "w"])


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Fit on a bounded sample, chosen by hash, of the documents with a label 0 or 1.

    A doc_id with several labels takes the largest; rows that share one doc_id count once. With rows of one class alone,
    or none, the score is that share. Null texts are empty ones.
    """
    C.small_batches(docs.sparkSession)
    scratch = C.Scratch(docs.sparkSession, "quality")
    lab = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("y"))
    counts = {int(r["y"]): r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(counts) < 2:
        return {"share": share, "table": None}
    u = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "id"), 11) / F.lit(float(1 << 53))
    lab = lab.withColumn("u", u)
    # a small surplus over the bound, which the last step trims
    picked = [lab.where((F.col("y") == k) & (F.col("u") < 1.2 * ROWS_PER_CLASS / n)).orderBy("u", "id").limit(ROWS_PER_CLASS) for k, n in sorted(counts.items())]
    sample = picked[0].unionByName(picked[1])
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
    # of rows with one id and text one is enough, of an id with several texts the one with the least hash
    rows = rows.groupBy("id").agg(F.min_by(F.struct("y", "u", "text"), F.xxhash64("text")).alias("r")).select("r.y", "r.u", "r.text")
    made = scratch.save(rows.mapInArrow(_features, "y int, u double, f binary, w binary"), "features")
    # some thousand rows: in the order of the draw, as many as the bytes allow
    room = F.sum(F.octet_length("f") + F.octet_length("w")).over(Window.partitionBy("y").orderBy("u").rowsBetween(Window.unboundedPreceding, 0))
    got = made.withColumn("room", room).where(F.col("room") <= SAMPLE_BYTES // 2).drop("room").toArrow().sort_by([("u", "ascending"), ("y", "ascending")])
    data = [(int(y), np.frombuffer(f, np.int32), np.frombuffer(w, np.float32)) for y, f, w in zip(got["y"].to_pylist(), got["f"].to_pylist(), got["w"].to_pylist(), strict=True)]
    table = fit(data)
    return {"share": share, "table": table[0], "bias": table[1]}


def fit(data: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Learned vectors and output, folded into one number per bucket, and the bias; classes weigh alike."""
    rng = np.random.default_rng(SEED)
    vec = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    seen = np.zeros(BUCKETS, np.float32)
    out, bias = np.zeros((DIM, 2)), np.zeros(2)
    out[:, 0], out[:, 1] = -1 / DIM, 1 / DIM
    n_of = np.maximum(np.bincount([y for y, _, _ in data], minlength=2), 1)
    weight = len(data) / 2 / n_of
    step, steps = 0, epochs * len(data)
    for _ in range(epochs):
        for i in rng.permutation(len(data)).tolist():
            y, f, w = data[i]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = w @ vec[f]
            logit = hidden @ out + bias
            prob = np.exp(logit - logit.max())
            prob /= prob.sum()
            prob[y] -= 1
            prob *= weight[y]
            back = (out @ prob).astype(np.float32)
            out -= 0.1 * rate * np.outer(hidden, prob)
            bias -= 0.1 * rate * prob
            seen[f] += w * w * (back @ back)
            vec[f] -= (rate * w / np.sqrt(seen[f] + 1e-8))[:, None] * back
    return (vec @ (out[:, 1] - out[:, 0]).astype(np.float32)).astype(np.float32), float(bias[1] - bias[0])


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Columns of ``docs`` with ``score`` and ``predicted`` added (replaced if there); null and empty texts score by the bias, repeated rows alike."""
    C.small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*keep).withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model["table"]
        for batch in batches:
            buf, off = C.buffers(batch.column(batch.schema.get_field_index("text")))
            p = np.full(batch.num_rows, model["share"], np.float64)
            for i, j, b, o in C.blocks(buf, off) if table is not None else ():
                words, ptr = word_features(b, o)
                logit = _sums(table[words], ptr[:-1], ptr[1:]) / np.maximum(np.diff(ptr), 1)
                total, count = np.zeros(j - i), np.zeros(j - i)
                chars = Characters(b, o)
                for n in NGRAMS:
                    grams, at = chars.ngrams(n)
                    edge = np.searchsorted(at, chars.first)
                    total += _sums(table[grams], edge[:-1], edge[1:])
                    count += np.diff(edge)
                logit += total / np.maximum(count, 1) + model["bias"]
                p[i:j] = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.record_batch([*cols, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return docs.select(*keep).mapInArrow(run, out)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = C.table(spark, sf_dir, "documents").select("doc_id", "text"), C.table(spark, sf_dir, "labels")
    held = C.crc_mod(F.col("doc_id"), 5) == 0
    model = train(docs, labels.where(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
