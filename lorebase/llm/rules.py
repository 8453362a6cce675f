"""Quality rules: robust multivariate outliers per language and source.

Each document's statistics are turned into a vector; per (language, source) a minimum-covariance-determinant estimate
of centre and spread is fitted, and a document is rejected if its squared Mahalanobis distance exceeds ``CUT``.

The estimate is the fast one, from several deterministic starts: medians and median deviations of the features; the
same with the correlations that their rank-like signs show; the plain mean and covariance; and mean and covariance of
the half nearest to the medians. Each start takes concentration steps (measure every row, keep the half with the
smallest distances, take its mean and covariance), all starts side by side; a start has ended when a step does not
lower its determinant any more. The start that ends with the least determinant is the group's estimate.

It is distributed: the half is found from a histogram of distances per group and start, its mean and covariance from
sums of products. Rows never meet in one task; what is gathered per group is histograms of ``BINS`` bins and some dozen
sums. Groups with fewer than ``LEAST_ROWS`` rows, for which a covariance of half of them says little, are pooled with the
others of their language, and languages that stay below it with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: Least standard deviation of each feature: smaller differences are never a reason to reject. They stand for what a
#: clean text's mean word length (log), symbols, repeated lines and repeated words vary by from text to text.
FLOORS = (0.25, 0.03, 0.1, 0.1)
N_FEATURES = len(FLOORS)
#: Rows of a group of its own (ten for each of the 14 parameters of a centre and a covariance), bins of a histogram, the
#: share of rows that a step keeps, and steps after which a start counts as settled in any case.
LEAST_ROWS, BINS, HALF, MOST_STEPS = 140, 4096, 0.5, 30
#: A determinant that falls by less than this share has settled.
SETTLED = 1e-6
STARTS = 4
#: Chance that a document of a normal group is rejected: of ten thousand corpora of 10**10 documents one loses a document.
TAIL = 1e-14
#: (language, source) pairs up to which what is known of the groups (under 2 KB each) is broadcast to the rows; beyond,
#: rows and groups are joined by shuffle.
BROADCAST_GROUPS = 10_000


def chi_square_quantile(tail: float, dof: int = N_FEATURES) -> float:
    """The value that a chi-square variable of an even number of degrees of freedom exceeds with this probability."""
    beyond = lambda x: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))
    low, high = 0.0, 2000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beyond(mid) > tail else (low, mid)
    return high


#: Squared distances above this are outliers.
CUT = chi_square_quantile(TAIL)
#: Squared distance that half of a normal group lies within; the half's covariance is smaller than the whole's by
#: P(chi-square with two more degrees of freedom <= this) / HALF.
MEDIAN = chi_square_quantile(1 - HALF)
CONSISTENCY = HALF / (1 - math.exp(-MEDIAN / 2) * sum((MEDIAN / 2) ** k / math.factorial(k) for k in range(N_FEATURES // 2 + 1)))
_STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@C.frugal
def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = C.buffers(batch.column(3))
        out = np.zeros((6, batch.num_rows), np.int64)
        for i, j, b, o in C.blocks(buf, off):
            if len(b):
                out[:, i:j] = block_statistics(b, o)
        yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), *map(pa.array, out)], names=[x.split()[0] for x in _STATS.split(", ")])


def block_statistics(b: np.ndarray, o: np.ndarray) -> np.ndarray:
    """Rows of words, their code points, symbols, repeated lines, repeated words and lines with a word, by text."""
    starts, ends, ptr = C.spans(b, o)
    tally = lambda mask: (lambda n: n[o[1:]] - n[o[:-1]])(np.concatenate(([0], np.cumsum(mask))))
    chars = tally(((b & 0xC0) != 0x80) & ~C._SPACE[b])
    symbols = tally(_SYMBOL[b])
    doc = np.repeat(np.arange(len(o) - 1), np.diff(ptr))
    # lines: a text's start, and after each \n
    cut = np.flatnonzero(b == 10)
    l_start = np.union1d(o[:-1][np.diff(o) > 0], cut[cut + 1 < len(b)] + 1)
    l_end = np.append(l_start[1:], len(b))
    l_end = l_end - (b[l_end - 1] == 10)
    l_end = np.maximum(l_end, l_start)
    some = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    l_start, l_end = l_start[some], l_end[some]
    l_doc = np.searchsorted(o, l_start, side="right") - 1
    lines = np.bincount(l_doc, minlength=len(o) - 1)
    dup = lines - _distinct_per_doc(C.span_hashes(b, l_start, l_end), l_doc, len(o) - 1)
    # words inside a 3-word window that its text has twice or more
    repeat = np.zeros(len(o) - 1, np.int64)
    if len(starts) >= 3:
        w = C.span_hashes(b, starts, ends)
        h = w[:-2] * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        h += w[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h += w[2:] * np.uint64(0x165667B19E3779F9)
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        key = C.mix64(h[whole] + doc[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key)
        s = key[order]
        same = s[1:] == s[:-1]
        twice = np.zeros(len(s), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = whole[order[twice]]
        marked = np.zeros(len(starts), bool)
        for k in range(3):
            marked[at + k] = True
        repeat = np.bincount(doc[marked], minlength=len(o) - 1)
    return np.array([np.diff(ptr), chars, symbols, dup, repeat, lines])


def _distinct_per_doc(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    d, s = doc[order], h[order]
    new = np.ones(len(s), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    return np.bincount(d[new], minlength=n)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def features() -> list[Column]:
    """Transformed statistics: mean word length (log), and square roots of shares of symbols, repeated lines and words."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p(F.col("word_chars") / words),
        F.sqrt(F.least(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)), F.lit(1.0))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def _distance(x: Column, centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance; ``inverse`` is the flat inverse covariance."""
    d = [x[i] - centre[i] for i in range(N_FEATURES)]
    total = F.lit(0.0)
    for i in range(N_FEATURES):
        for j in range(i, N_FEATURES):
            total = total + (1 if i == j else 2) * d[i] * d[j] * inverse[i * N_FEATURES + j]
    return total


def _bin(distance: Column) -> Column:
    """Bin of a squared distance on a logarithmic scale; 0 for what lies next to the centre."""
    return F.least(F.greatest(F.floor(F.log(distance + 1e-9) * 128 + 2048), F.lit(0)), F.lit(BINS - 1)).cast("int")


def _edges(rows: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """(by, edge): the first bin at which ``share`` of a group's rows is reached."""
    n = rows.groupBy(*by, value).count()
    h = n.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(value, "count"))).alias("h"), F.sum("count").alias("n"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).alias("at"))
    step = lambda a, x: F.struct((a["seen"] + x["count"]).alias("seen"), F.when((a["at"] < 0) & (a["seen"] + x["count"] >= F.ceil(F.col("n") * share)), x[value]).otherwise(a["at"]).alias("at"))
    return h.select(*by, F.aggregate("h", start, step)["at"].alias("edge"))


def covariance(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from (n, sums, products)."""
    mean = sums[1 : 1 + N_FEATURES] / sums[0]
    cov = np.zeros((N_FEATURES, N_FEATURES))
    cov[np.triu_indices(N_FEATURES)] = sums[1 + N_FEATURES :] / sums[0]
    cov = np.triu(cov) + np.triu(cov, 1).T
    return mean, cov - np.outer(mean, mean)


def model_of(mean: np.ndarray, cov: np.ndarray) -> tuple[list[float], list[float], float]:
    """Centre, flat inverse and log-determinant of a spread with the floors added; rounded, so that the order of adding doesn't show."""
    cov = cov + np.diag(np.square(FLOORS))
    tidy = lambda v: [float(f"{x:.9g}") for x in np.ravel(v)]
    return tidy(mean), tidy(np.linalg.inv(cov)), float(f"{np.linalg.slogdet(cov)[1]:.9g}")


_MODEL = "centre array<double>, inverse array<double>, logdet double"


def _concentrated(sums: pd.Series) -> pd.DataFrame:
    """Model of the kept half, its covariance brought to that of the whole."""
    found = [covariance(np.asarray(s, float)) for s in sums]
    return pd.DataFrame([model_of(m, CONSISTENCY * c) for m, c in found], columns=["centre", "inverse", "logdet"])


def _plain(sums: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([model_of(*covariance(np.asarray(s, float))) for s in sums], columns=["centre", "inverse", "logdet"])


def _signed(centre: pd.Series, spread: pd.Series, sums: pd.Series) -> pd.DataFrame:
    """Model from medians, median deviations and the correlations of the signs around the medians (sine of a quarter turn of them)."""
    out = []
    for c, d, s in zip(centre, spread, sums, strict=True):
        _, agree = covariance(np.asarray(s, float))
        agree = agree + 1e-9 * np.eye(N_FEATURES)
        scale = np.sqrt(np.diag(agree))
        corr = np.sin(np.pi / 2 * np.clip(agree / np.outer(scale, scale), -1, 1))
        w, v = np.linalg.eigh(corr)
        corr = (v * np.maximum(w, 1e-3)) @ v.T
        out.append(model_of(np.asarray(c, float), corr * np.outer(d, d)))
    return pd.DataFrame(out, columns=["centre", "inverse", "logdet"])


def _moments(x: Column) -> Column:
    parts = [F.count("*").cast("double"), *[F.sum(x[i]) for i in range(N_FEATURES)]]
    parts += [F.sum(x[i] * x[j]) for i in range(N_FEATURES) for j in range(i, N_FEATURES)]
    return F.array(*parts)


def groups(stats: DataFrame, scratch: C.Scratch) -> tuple[DataFrame, bool]:
    """Adds ``grp``: (lang, source), or pooled keys for small groups; null is a value like any other.

    Also returns whether the groups are few enough to broadcast.
    """
    key = lambda a, b: F.to_json(F.struct(a.alias("l"), b.alias("s")), {"ignoreNullFields": "false"})
    used = stats.where(~F.col("base_failed"))
    n = used.groupBy("lang", "source").agg(F.count("*").alias("n"))
    n = n.withColumn("of_lang", F.sum(F.when(F.col("n") < LEAST_ROWS, F.col("n")).otherwise(0)).over(Window.partitionBy("lang")))
    grp = F.when(F.col("n") >= LEAST_ROWS, key(F.col("lang"), F.col("source"))).when(F.col("of_lang") >= LEAST_ROWS, F.concat(F.lit("lang "), key(F.col("lang"), F.lit("*")))).otherwise("all")
    n = scratch.save(n.select(F.col("lang").alias("l2"), F.col("source").alias("s2"), grp.alias("grp")), "groups")
    few = n.count() <= BROADCAST_GROUPS
    return stats.join(_hint(n, few), F.col("lang").eqNullSafe(F.col("l2")) & F.col("source").eqNullSafe(F.col("s2")), "left").drop("l2", "s2"), few


def _hint(of_groups: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(of_groups) if few else of_groups


def quality_rules(spark: SparkSession, docs: DataFrame, scratch: C.Scratch | None = None) -> DataFrame:
    """One row per document: its statistics, base_failed, kept, distance, grp.

    Null, empty and very short texts fail the base rules. Rows that fail them take no part in the estimates and are not
    kept. Repeated rows are judged alike. An empty table gives no rows; other columns are not touched.
    """
    C.small_batches(spark)
    scratch = scratch or C.Scratch(spark, "rules")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    stats = scratch.save(text.mapInArrow(_statistics, _STATS).withColumn("base_failed", base_failed()), "stats")
    grouped, few = groups(stats, scratch)
    rows = scratch.save(grouped.withColumn("x", F.array(*features())), "vectors")
    model = estimate(rows.where(~F.col("base_failed")).select("grp", "x"), few, scratch)
    scored = rows.join(_hint(model.withColumnRenamed("grp", "g2"), few), F.col("grp") == F.col("g2"), "left").withColumn("distance", _distance(F.col("x"), F.col("m.centre"), F.col("m.inverse")))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUT)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance", "grp")


def estimate(used: DataFrame, few: bool, scratch: C.Scratch) -> DataFrame:
    """(grp, m): each group's estimate of the least determinant over all starts."""
    model = scratch.save(_concentrate(used, scratch.save(_starts(used, few, scratch), "starts"), few), "model")
    for _ in range(MOST_STEPS):
        # a start that a step does not improve has ended and keeps its model
        new = _concentrate(used, model, few).toDF("g0", "s0", "new")
        both = model.join(new, (F.col("grp") == F.col("g0")) & (F.col("start") == F.col("s0")), "left")
        better = F.coalesce(F.col("m.logdet") - F.col("new.logdet") > SETTLED, F.lit(False))
        model = scratch.save(both.select("grp", "start", F.when(better, F.col("new")).otherwise(F.col("m")).alias("m"), better.alias("better")), "model")
        if model.where("better").isEmpty():
            break
        model = model.drop("better")
    return model.groupBy("grp").agg(F.min_by("m", F.struct("m.logdet", "start")).alias("m"))


def _starts(used: DataFrame, few: bool, scratch: C.Scratch) -> DataFrame:
    """(grp, start, m) of the first models."""
    # medians and deviations from histograms over a fixed grid
    grid = used.select("grp", F.posexplode("x").alias("k", "v")).select("grp", "k", F.floor(F.col("v") * 1024).cast("int").alias("b"))
    mid = scratch.save(_edges(grid, ["grp", "k"], "b", 0.5), "medians")
    near = grid.join(_hint(mid.toDF("g2", "k2", "mid"), few), (F.col("grp") == F.col("g2")) & (F.col("k") == F.col("k2"))).select("grp", "k", F.abs(F.col("b") - F.col("mid")).alias("dev"))
    mad = _edges(near, ["grp", "k"], "dev", 0.5).toDF("g3", "k3", "mad")
    both = mid.join(mad, (F.col("grp") == F.col("g3")) & (F.col("k") == F.col("k3"))).select("grp", "k", ((F.col("edge") + 0.5) / 1024).alias("c"), (F.col("mad") * 1.4826 / 1024).alias("s"))
    listed = both.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("k", "c", "s"))).alias("a"))
    robust = scratch.save(listed.select("grp", F.transform("a", lambda v: v["c"]).alias("c"), F.transform("a", lambda v: v["s"]).alias("s")), "robust")
    at = used.join(_hint(robust.withColumnRenamed("grp", "g4"), few), F.col("grp") == F.col("g4"))
    sign = F.array(*[F.signum(F.round(F.col("x")[i] - F.col("c")[i], 3)) for i in range(N_FEATURES)])
    far = F.aggregate(F.zip_with(F.zip_with("x", "c", lambda x, c: x - c), F.zip_with("s", F.array(*map(F.lit, FLOORS)), lambda s, f: s * s + f * f), lambda d, v: d * d / v), F.lit(0.0), lambda t, v: t + v)
    parts = at.select("grp", "x", sign.alias("sign"), _bin(far).alias("bin"))
    edge = _edges(parts, ["grp"], "bin", HALF).toDF("g5", "edge")
    inner = parts.join(_hint(edge, few), F.col("grp") == F.col("g5")).where(F.col("bin") <= F.col("edge"))
    of_half = inner.groupBy("grp").agg(_moments(F.col("x")).alias("half"))
    sums = parts.groupBy("grp").agg(_moments(F.col("x")).alias("sums"), _moments(F.col("sign")).alias("signs"))
    wide = robust.join(_hint(sums.withColumnRenamed("grp", "g6"), few), F.col("grp") == F.col("g6")).join(_hint(of_half.withColumnRenamed("grp", "g7"), few), F.col("grp") == F.col("g7"))
    plain, signed, half = F.pandas_udf(_plain, _MODEL), F.pandas_udf(_signed, _MODEL), F.pandas_udf(_concentrated, _MODEL)
    eye = F.array(*[F.lit(float(v)) for v in [len(FLOORS) * 1.0, *[0.0] * N_FEATURES, *[v for i in range(N_FEATURES) for v in [float(N_FEATURES), *[0.0] * (N_FEATURES - 1 - i)]]]])
    models = wide.select("grp", F.array(signed("c", "s", eye), signed("c", "s", "signs"), plain("sums"), half("half")).alias("models"))
    return models.select("grp", F.posexplode("models").alias("start", "m"))


def _concentrate(used: DataFrame, model: DataFrame, few: bool) -> DataFrame:
    """(grp, start, m): mean and covariance of the half nearest to each present model."""
    at = used.join(_hint(model.withColumnRenamed("grp", "g1"), few), F.col("grp") == F.col("g1"))
    at = at.select("grp", "start", "x", _bin(_distance(F.col("x"), F.col("m.centre"), F.col("m.inverse"))).alias("bin"))
    edge = _edges(at, ["grp", "start"], "bin", HALF).toDF("g2", "s2", "edge")
    inner = at.join(_hint(edge, few), (F.col("grp") == F.col("g2")) & (F.col("start") == F.col("s2"))).where(F.col("bin") <= F.col("edge"))
    return inner.groupBy("grp", "start").agg(_moments(F.col("x")).alias("sums")).select("grp", "start", F.pandas_udf(_concentrated, _MODEL)("sums").alias("m"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark, C.table(spark, sf_dir, "documents"))
