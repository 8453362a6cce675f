"""Line dedup by pairwise alignment.

Lines that two documents or more have are weighed by the number of documents that have them. Documents overlap if they
share a rare line in shared surroundings: each shortest window of ``LEAST_WORDS`` words of consecutive shared lines that
starts or ends at a line is named by its rarest line, and documents meet under (rarest line, window). Every line of a
shared block of ``LEAST_WORDS`` words or more is in such a window of the block, so no block is missed, however frequent
its lines are. Under each name a document meets the first one (by doc_id) that holds the window; a line that many
documents share makes as many pairs as documents, not their square.

Each overlapping pair is aligned with patience diff (lines that are unique in both, longest increasing chain, recursion
between the anchors), and aligned blocks of ``LEAST_WORDS`` words or more are deleted from the later document; this
repeats on what is left until no block remains, so moved and doubled passages go as well. Lines are aligned by two
64-bit hashes. The first occurrence of every line in the table stays.

Lines and windows that stand in more than one of ``common.HOT`` rows are fewer than that, so what is known of them is
broadcast; the others are joined by shuffle, and no key of those is hot.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Words of the shortest aligned block that is deleted.
LEAST_WORDS = 50
#: Bytes of the table of deletions (ids and line numbers) up to which it is broadcast to the texts; beyond, it is joined by shuffle.
BROADCAST_BYTES = 16 << 20
#: Seed of the second hash of a line.
SECOND = 40503


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest chain of pairs that increases in both, from pairs in order of the first."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
        back.append(at[p - 1] if p else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences of line hashes, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and x[a] == y[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and x[b - 1] == y[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        n, m = Counter(x[a:b]), Counter(y[c:d])
        once = {h: j for j, h in enumerate(y[c:d], c) if m[h] == 1 and n[h] == 1}
        if once:
            pairs = [(i, once[x[i]]) for i in range(a, b) if x[i] in once]
        else:
            # nothing is unique on both sides: k-th occurrences stand for each other
            seen: Counter = Counter()
            place = {}
            for j in range(c, d):
                place[y[j], seen[y[j]]] = j
                seen[y[j]] += 1
            seen.clear()
            pairs = []
            for i in range(a, b):
                if (x[i], seen[x[i]]) in place:
                    pairs.append((i, place[x[i], seen[x[i]]]))
                seen[x[i]] += 1
        chain = _chain(pairs)
        if not chain:
            continue
        out += chain
        for (i, j), (k, m2) in zip([(a - 1, c - 1), *chain], [*chain, (b, d)], strict=True):
            if k - i > 1 and m2 - j > 1:
                todo.append((i + 1, k, j + 1, m2))
    return sorted(out)


def _runs(x: list[int], words: list[int], y: list[int], rest: list[int], least: int) -> list[int]:
    """Positions among ``rest`` in any run of ``least`` words or more that ``x`` and ``y`` have in common, by a suffix automaton of ``y``."""
    known = set(y)
    total, before, best = 0, -2, 0
    for i in rest:
        total = (total if i == before + 1 else 0) + words[i] if x[i] in known else 0
        before, best = i, max(best, total)
    if best < least:
        return []
    step: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for h in y:
        new, p = len(step), last
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        while p >= 0 and h not in step[p]:
            step[p][h] = new
            p = link[p]
        if p >= 0:
            q = step[p][h]
            if size[q] > size[p] + 1:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(h) == q:
                    step[p][h] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        last = new
    upto = [0, *accumulate(words)]
    hit: list[int] = []
    at, n, before = 0, 0, -2
    for i in rest:
        if i != before + 1:
            at, n = 0, 0
        before = i
        while at and x[i] not in step[at]:
            at = link[at]
            n = size[at]
        if x[i] in step[at]:
            at, n = step[at][x[i]], n + 1
        if upto[i + 1] - upto[i + 1 - n] >= least:
            hit += range(max(i + 1 - n, hit[-1] + 1 if hit else 0), i + 1)
    return hit


def common_blocks(x: list[int], words: list[int], y: list[int], least: int = LEAST_WORDS) -> list[int]:
    """Positions in ``x`` of all aligned common blocks of ``least`` words or more, block after block."""
    gone: list[int] = []
    rest = list(range(len(x)))
    while rest:
        pairs = [(rest[i], j) for i, j in patience([x[i] for i in rest], y)]
        hit, run = [], []
        for p in [*pairs, (-9, -9)]:
            if run and (p[0] != run[-1][0] + 1 or p[1] != run[-1][1] + 1):
                if sum(words[i] for i, _ in run) >= least:
                    hit += [i for i, _ in run]
                run = []
            run.append(p)
        # the longest chain may hold no block although a moved passage does
        hit = hit or _runs(x, words, y, rest, least)
        if not hit:
            break
        gone += hit
        out = set(hit)
        rest = [i for i in rest if i not in out]
    return sorted(gone)


def _align(least: int):
    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, x2, w, y, y2 = (batch.column(k).to_pylist() for k in range(1, 6))
            gone = []
            for a, a2, b, c, c2 in zip(x, x2, w, y, y2, strict=True):
                number = {line: k for k, line in enumerate(zip(c, c2, strict=True))}
                # lines that the first document lacks are told apart by their place
                mine = [number.get(line, -1 - i) for i, line in enumerate(zip(a, a2, strict=True))]
                gone.append(common_blocks(mine, b, [number[line] for line in zip(c, c2, strict=True)], least))
            yield pa.record_batch([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["key", "gone"])

    return run


def _windows(least: int):
    """(key, rare, hash) of the shortest windows of ``least`` words or more that start, and that end, at each shared line.

    ``rare`` is the line of the window that the fewest documents have (of equals the smallest hash).
    """

    @C.frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            p, h, w, df = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten())
            n = len(p)
            doc = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(p) != 1)) + 1
            # bounds of the run of consecutive lines that each line is in
            low, high = np.concatenate(([0], cut)), np.concatenate((cut, [n]))
            size = high - low
            low, high = np.repeat(low, size), np.repeat(high, size)
            words = np.concatenate(([0], np.cumsum(w)))
            at = np.arange(n)
            end = np.searchsorted(words, words[:-1] + least)
            start = np.searchsorted(words, words[1:] - least, side="right") - 1
            a, b = end <= high, start >= low
            starts, ends = np.concatenate((at[a], start[b])), np.concatenate((end[a], at[b] + 1))
            terms = C.mix64(h.view(np.uint64).copy()) * C._power("up", n)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
            window = C.mix64((total[ends] - total[starts]) * C._power("down", n + 1)[starts] + (ends - starts).astype(np.uint64))
            # place in the order from rare to frequent; the least place of each window
            order = np.lexsort((h, df))
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            edges = np.stack([starts, np.minimum(ends, n - 1)], 1).ravel()
            least_place = np.minimum.reduceat(place, edges)[::2] if len(starts) else place[:0]
            # a window that ends with the last line leaves that line out of its slice
            least_place = np.minimum(least_place, place[np.minimum(ends, n) - 1]) if len(starts) else least_place
            key = batch.column(0).take(pa.array(doc[np.minimum(starts, n - 1)]))
            yield pa.record_batch([key, pa.array(h[order[least_place]]), pa.array(window.view(np.int64))], names=["key", "rare", "window"])

    return run


def deletions(spark: SparkSession, docs: DataFrame, scratch: C.Scratch, least: int = LEAST_WORDS) -> DataFrame:
    """(key, gone): numbers of the deleted lines (counted among all lines) of each document with deletions."""
    key_t = docs.select(_key().alias("key")).schema["key"].dataType.simpleString()
    split = docs.select(_key().alias("key"), F.split("text", "\n").alias("l")).where(F.col("l").isNotNull())
    line = lambda s, i: F.struct(F.xxhash64(F.rtrim(s)).alias("h"), C.n_words(s).cast("int").alias("w"), i.alias("i"), F.xxhash64(F.lit(SECOND), F.rtrim(s)).alias("g"))
    split = split.select("key", F.filter(F.transform("l", line), lambda s: s["w"] > 0).alias("l")).where(F.size("l") > 0)
    lines = scratch.save(split.dropDuplicates(["key"]), "lines")
    each = lines.select("key", F.posexplode("l").alias("p", "s")).select("key", "p", F.col("s.h").alias("h"), F.col("s.w").alias("w"))
    counts = each.groupBy("h").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n")).where("first < last")
    counts = scratch.save(counts.select("h", "n"), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    shared = C.attach(each, counts, ["h"], ["n"], total, ["key", "p"]).where(F.col("n").isNotNull()).select("key", "p", "h", "w", F.col("n").alias("df"))
    rows = shared.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("p", "h", "w", "df"))).alias("l"))
    windows = scratch.save(rows.mapInArrow(_windows(least), f"key {key_t}, rare long, window long").distinct(), "windows")
    holder = windows.groupBy("rare", "window").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    holder = scratch.save(holder, "holders")
    total = holder.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    held = C.attach(windows, holder, ["rare", "window"], ["first"], total, ["key"]).where(F.col("first") < F.col("key"))
    pairs = scratch.save(held.select("key", "first").distinct(), "pairs")
    x = lines.select(F.col("key").alias("k1"), F.col("l.h").alias("x"), F.col("l.g").alias("x2"), F.col("l.w").alias("w"))
    y = lines.select(F.col("key").alias("k2"), F.col("l.h").alias("y"), F.col("l.g").alias("y2"))
    both = pairs.join(x, F.col("key") == F.col("k1")).join(y, F.col("first") == F.col("k2")).select("key", "x", "x2", "w", "y", "y2")
    gone = both.mapInArrow(_align(least), f"key {key_t}, gone array<int>").where(F.size("gone") > 0)
    gone = gone.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("g"))
    number = lines.select(F.col("key").alias("k1"), F.col("l.i").alias("i"))
    named = gone.join(number, F.col("key") == F.col("k1")).select("key", F.array_sort(F.transform("g", lambda p: F.get("i", p))).alias("gone"))
    return scratch.save(named, "gone")


def _key():
    """Order of documents: doc_id with null last, then the text's hash. Rows that agree in both are one document."""
    return F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64("text").alias("t"))


def dedup_lines(spark: SparkSession, docs: DataFrame, scratch: C.Scratch | None = None, least: int = LEAST_WORDS, gone_as: str = "gone_lines") -> DataFrame:
    """All rows and columns of ``docs``, with deleted blocks taken out of ``text``, and ``gone_as``, the deleted lines' numbers.

    Null and empty texts stay as they are. Repeated rows (same doc_id and text) are one document and lose the same
    lines. Trailing spaces do not count in comparisons. Texts without a deletion are not changed at all; a text that
    loses all its lines is empty. ``n_chars`` is not touched. A column of ``docs`` named as ``gone_as`` is replaced; name
    another one to keep it.
    """
    C.small_batches(spark)
    scratch = scratch or C.Scratch(spark, "lines")
    gone = deletions(spark, docs.select("doc_id", "text"), scratch, least).select(F.col("key").alias("__key"), F.col("gone").alias("__gone"))
    size = gone.agg(F.coalesce(F.sum(4 * F.size("__gone") + 64), F.lit(0))).head()[0]
    if size <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    joined = docs.join(gone, _key() == F.col("__key"), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda s, i: ~F.array_contains("__gone", i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.when(F.regexp_count(left, F.lit(C.WORD)) > 0, left).otherwise(F.lit("")))
    none = F.array().cast("array<int>")
    return joined.withColumn("text", text).withColumn(gone_as, F.coalesce("__gone", none)).select(*[c for c in docs.columns if c != gone_as], gone_as)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(spark, docs).select("doc_id", F.size("gone_lines").cast("long").alias("n_removed"), "gone_lines", "text")
