"""Language identification by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes (the last one padded with spaces). Bytes are embedded,
filters of widths 2, 3 and 4 slide over them, each filter keeps its maximum in the window, and a softmax over the
rectified maxima gives log-probabilities, which are averaged over all windows of the text. For prediction the embedding
and the filters are folded into tables over byte pairs, so that a window costs two table reads per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

WINDOW, EMBED, FILTERS, WIDTHS = 128, 8, 16, (2, 3, 4)
#: The training sample: at most so many documents of a language, so many windows of a document, and so many languages
#: (the most frequent ones).
DOCS_PER_LANG, WINDOWS_PER_DOC, MOST_LANGS = 600, 8, 256
EPOCHS, BATCH, RATE, SEED = 4, 64, 0.004, 11
#: Below this score a document is rejected as being in no known language.
LEAST_SCORE = 0.3
_DEPTH = FILTERS * len(WIDTHS)
_STEP = 96


class ByteCNN:
    """Parameters and the forward and backward passes."""

    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "bias": np.zeros(_DEPTH), "out": rng.normal(0, 0.1, (_DEPTH, len(langs))), "out_bias": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS))

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter in each window and its position."""
        best, where = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            h = 0
            for k in range(w):
                h = h + (self.p["embed"] @ self.p[f"w{w}"][k])[x[:, k : k + n]]
            at = h.argmax(1)
            where.append(at)
            best.append(np.take_along_axis(h, at[:, None, :], 1)[:, 0, :])
        return np.concatenate(best, 1) + self.p["bias"], np.concatenate(where, 1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteCNN:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, steps = 0, epochs * -(-len(x) // BATCH)
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), -(-len(x) // BATCH)):
                t += 1
                grad = self._grad(x[rows], y[rows], weight[rows])
                rate = RATE * (1 - 0.9 * t / steps)
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def _grad(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        pre, where = self._pool(x)
        act = np.maximum(pre, 0)
        logit = act @ self.p["out"] + self.p["out_bias"]
        prob = np.exp(logit - logit.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(len(y)), y] -= 1
        d = prob * (weight / weight.sum())[:, None]
        g = {"out": act.T @ d, "out_bias": d.sum(0), "embed": np.zeros((256, EMBED))}
        back = (d @ self.p["out"].T) * (pre > 0)
        g["bias"] = back.sum(0)
        rows = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            part, at = back[:, i * FILTERS : (i + 1) * FILTERS], where[:, i * FILTERS : (i + 1) * FILTERS]
            gw = np.empty_like(self.p[f"w{w}"])
            for k in range(w):
                flat = x[rows, at + k].astype(np.int64) * FILTERS + np.arange(FILTERS)
                u = np.bincount(flat.ravel(), part.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                gw[k] = self.p["embed"].T @ u
                g["embed"] += u @ self.p[f"w{w}"][k].T
            g[f"w{w}"] = gw
        return g

    def frozen(self) -> dict:
        """Tables for prediction: responses by byte pair at a position and two positions on."""
        u = {w: [(self.p["embed"] @ self.p[f"w{w}"][k]).astype(np.float32) for k in range(w)] for w in WIDTHS}
        return {"u": u, "bias": self.p["bias"].astype(np.float32), "out": self.p["out"].astype(np.float32), "out_bias": self.p["out_bias"].astype(np.float32), "langs": self.langs}


class Scorer:
    def __init__(self, frozen: dict):
        u = frozen["u"]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.near = np.ascontiguousarray(np.concatenate([pair(u[w][0], u[w][1]) for w in WIDTHS], 1))
        zero = np.zeros((256, FILTERS), np.float32)
        self.far = np.ascontiguousarray(np.concatenate([pair(u[3][2], zero), pair(u[4][2], u[4][3])], 1))
        self.bias, self.out, self.out_bias = frozen["bias"], frozen["out"], frozen["out_bias"]

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """(windows, WINDOW) bytes -> (windows, languages)."""
        pooled = np.empty((len(x), _DEPTH), np.float32)
        for a in range(0, len(x), _STEP):
            part = x[a : a + _STEP].astype(np.uint16)
            code = part[:, :-1] << 8 | part[:, 1:]
            h = self.near[code]
            last = h[:, -2:, :FILTERS].max(1)
            mid = h[:, -2, FILTERS : 2 * FILTERS] + self.far[part[:, -1].astype(np.intp) << 8, :FILTERS]
            h = h[:, :-2]
            h[:, :, FILTERS:] += self.far[code[:, 2:]]
            top = h.max(1)
            np.maximum(top[:, :FILTERS], last, out=top[:, :FILTERS])
            np.maximum(top[:, FILTERS : 2 * FILTERS], mid, out=top[:, FILTERS : 2 * FILTERS])
            pooled[a : a + _STEP] = top
        logit = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        logit -= logit.max(1, keepdims=True)
        return logit - np.log(np.exp(logit).sum(1, keepdims=True))


def windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a block of texts and the first window of each text (one entry more)."""
    n = -(-np.diff(off) // WINDOW)
    at = np.concatenate(([0], np.cumsum(n)))
    x = np.full((int(at[-1]), WINDOW), 32, np.uint8)
    place = np.arange(len(buf)) + np.repeat(at[:-1] * WINDOW - off[:-1], np.diff(off))
    x.reshape(-1)[place] = buf
    return x, at


def _sample(docs: DataFrame) -> DataFrame:
    """(lang, bytes) of evenly spaced windows of a bounded number of documents of each language, chosen by hash of id and text."""
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "text"), 11) / F.lit(float(1 << 53))
    # a surplus over the bound, rows that repeat taken once, then the first of each language by the draw
    drawn = known.select("lang", "text", u.alias("u")).join(F.broadcast(counts.withColumnRenamed("lang", "l2")), F.col("lang") == F.col("l2"))
    drawn = drawn.where(F.col("u") < 1.5 * DOCS_PER_LANG / F.col("n")).groupBy("lang", "u").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("u"))
    drawn = drawn.withColumn("place", place).where(F.col("place") <= DOCS_PER_LANG)

    @C.frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = C.buffers(batch.column(1))
            x, at = windows(buf, off)
            rows, lang = [], []
            for d, name in enumerate(batch.column(0).to_pylist()):
                n = int(at[d + 1] - at[d])
                for k in np.unique(np.linspace(0, n - 1, min(n, WINDOWS_PER_DOC)).astype(int)).tolist():
                    rows.append(x[at[d] + k].tobytes())
                    lang.append(name)
            yield pa.record_batch([pa.array(lang, pa.string()), pa.array(rows, pa.binary())], names=["lang", "x"])

    return drawn.select("lang", "text").mapInArrow(cut, "lang string, x binary")


def train(docs: DataFrame) -> dict:
    """Fit on ``text`` and non-null ``lang`` of the given rows; no rows give a model that only says ``und``."""
    C.small_batches(docs.sparkSession)
    got = _sample(docs).toArrow()
    names = np.array(got["lang"].to_pylist(), object)
    langs = sorted(set(names.tolist()))
    if not langs:
        return {"langs": []}
    raw = sorted(zip(names.tolist(), got["x"].to_pylist(), strict=True))
    y = np.array([langs.index(a) for a, _ in raw])
    x = np.frombuffer(b"".join(b for _, b in raw), np.uint8).reshape(len(raw), WINDOW)
    weight = (len(y) / len(langs) / np.bincount(y, minlength=len(langs)))[y]
    return ByteCNN(langs).fit(x, y, weight).frozen()


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``score`` (mean-window probability of the prediction) added.

    A null text, or one without a letter, is ``und`` with score 0; so is any text if the model knows no language.
    Whole texts are read, in windows; repeated rows are predicted alike. Columns of ``docs`` named lang_pred or score are
    replaced.
    """
    C.small_batches(docs.sparkSession)
    schema = docs.schema
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*keep).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model["langs"] else None
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("text"))
            buf, off = C.buffers(col)
            pred, score = [None] * batch.num_rows, np.zeros(batch.num_rows)
            for i, j, b, o in C.blocks(buf, off):
                letter = _letters(b, o)
                if scorer is not None:
                    x, at = windows(b, o)
                    total = np.concatenate((np.zeros((1, len(model["langs"]))), np.cumsum(scorer.log_probs(x), 0, dtype=np.float64)))
                    n = np.maximum(np.diff(at), 1)[:, None]
                    mean = (total[at[1:]] - total[at[:-1]]) / n
                    prob = np.exp(mean - mean.max(1, keepdims=True))
                    prob /= prob.sum(1, keepdims=True)
                    best = prob.argmax(1)
                else:
                    best, prob, letter = np.zeros(j - i, int), np.zeros((j - i, 1)), np.zeros(j - i, bool)
                for d in range(j - i):
                    if letter[d]:
                        pred[i + d], score[i + d] = model["langs"][best[d]], min(1.0, prob[d, best[d]])
                    else:
                        pred[i + d] = "und"
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.record_batch([*cols, pa.array(pred, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    assert "text" in schema.names
    return docs.select(*keep).mapInArrow(run, out)


def _letters(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    if not len(buf):
        return np.zeros(len(off) - 1, bool)
    ascii_ = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    n = np.concatenate(([0], np.cumsum(ascii_)))
    found = n[off[1:]] > n[off[:-1]]
    for d in np.flatnonzero(~found).tolist():
        text = buf[off[d] : off[d + 1]].tobytes().decode("utf-8", "replace")
        found[d] = any(c.isalpha() for c in text)
    return found


def rejected(lang_pred, score):
    """Documents without a language: ``und``, or no language is likely."""
    return (lang_pred == "und") | (score < LEAST_SCORE)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = C.crc_mod(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
