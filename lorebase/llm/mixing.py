"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame and SQL functions alone.

Every document of a source starts with the same fractional number of copies, target / source size. The whole part is
taken; the rest is a mass of ``fraction * size`` words that must become 0 or ``size``. Documents are dealt by hash into
blocks of about ``BLOCK`` rows. A fold over a block pairs the unfinished document with the next one and moves words
between the two, in a random direction with odds that keep both expectations, until one of them is integral; large
documents come first, so that what stays unfinished is small. A block
ends with one unfinished document at most and its sum of words unchanged. The unfinished documents of all blocks form
the next, ``BLOCK`` times smaller level of the reduction tree, until each source has at most one, which is settled by a
draw. A source's taken words therefore miss its target by less than one document.

Random draws are hashes of seed, level, block and document, so reruns agree whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, n_words, table

#: Weights of the sources in the order of their names.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a percentage of all words, and the most copies of one document.
SHARE_PERCENT, MOST_COPIES = 150, 2
BLOCK, SEED = 48, 20240229

_ITEM = T.StructType([T.StructField("r", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("x", T.DoubleType())])


def _running(rows: DataFrame, order: list[Column], sums: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with idx, their place in the order (from 1), and before_<column>, the sums of all rows before them.

    Rows are dealt by ranges of the order; what meets in one task beside a range is one row of sums for each range.
    """
    dealt = scratch.save(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("part").orderBy(*order)
    upto = own.rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(F.col("part").alias("p2")).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in sums])
    earlier = Window.orderBy("p2").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select("p2", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"b_{c}") for c in ("n", *[f"s_{c}" for c in sums])])
    out = dealt.withColumn("idx", F.row_number().over(own).cast("long")).withColumns({f"before_{c}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in sums})
    out = out.join(first, F.col("part") == F.col("p2"))
    return out.withColumns({"idx": F.col("idx") + F.col("b_n")} | {f"before_{c}": F.col(f"before_{c}") + F.col(f"b_s_{c}") for c in sums}).select(*rows.columns, "idx", *[f"before_{c}" for c in sums])


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_COPIES) -> DataFrame:
    """(source, size) rows -> (source, source_size, target).

    Sources are ordered by code point with null last. Capping a source at ``most`` times its size and resharing the
    excess by weight ends at min(cap, level * weight) with one level for all; it is read off prefix sums over the
    sources ordered by cap / weight, in integers, with one division at the end. Sources without words get the target 0.
    There may be as many sources as documents: no task sees all of them.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = _running(s, [F.col("source").asc_nulls_last()], [], scratch)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("idx") - 1) % len(weights) + 1).cast("int"))
    s = named.select("source", "source_size", weight.alias("w"))
    ratio = F.col("source_size") / F.col("w")
    s = scratch.save(_running(s.withColumn("ratio", ratio), [F.col("ratio"), F.col("source").asc_nulls_last()], ["source_size", "w"], scratch), "ranked")
    # single rows from here on: the sums of all sources, and the level
    every = s.agg(F.sum("source_size").alias("total"), F.sum("w").alias("total_w"))
    s = s.crossJoin(F.broadcast(every))
    # level if exactly the sources before this one are capped, as a fraction num / den
    s = s.withColumn("num", share_percent * F.col("total") - 100 * most * F.col("before_source_size")).withColumn("den", 100 * (F.col("total_w") - F.col("before_w")))
    fits = F.col("w") * F.col("num").cast("double") <= most * F.col("source_size").cast("double") * F.col("den")
    level = s.where(fits).agg(F.min_by(F.struct("num", "den"), "idx").alias("level"))
    s = s.select("source", "source_size", "w").crossJoin(F.broadcast(level))
    level_target = F.col("w") * F.col("level.num") / F.col("level.den")
    cap = (most * F.col("source_size")).cast("double")
    under = F.col("w") * F.col("level.num").cast("double") <= most * F.col("source_size").cast("double") * F.col("level.den")
    return s.select("source", "source_size", F.when(F.col("level").isNotNull() & under, level_target).otherwise(cap).alias("target"))


def _uniform(*cols: Column) -> Column:
    """A draw in [0, 1) fixed by the values."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *cols), 11) / F.lit(float(1 << 53))


def _fold(items: Column, level: int) -> Column:
    """struct(open: the document that is still fractional or null, done: settled documents) of an ordered block."""
    done_t = T.ArrayType(T.StructType([T.StructField("r", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("take", T.BooleanType())]))
    start = F.struct(F.lit(None).cast(_ITEM).alias("open"), F.array().cast(done_t).alias("done"))

    def settled(item: Column, take: Column) -> Column:
        return F.struct(item["r"].alias("r"), item["doc_id"].alias("doc_id"), take.alias("take"))

    def item(of: Column, x: Column) -> Column:
        return F.struct(of["r"].alias("r"), of["doc_id"].alias("doc_id"), of["size"].alias("size"), x.alias("x"))

    def pair(acc: Column, b: Column) -> Column:
        a = acc["open"]
        to_a = F.least(a["size"] - a["x"], b["x"])
        to_b = F.least(a["x"], b["size"] - b["x"])
        toward_a = _uniform(F.lit(level), a["r"], b["r"]) * (to_a + to_b) < to_b
        a_closes = F.when(toward_a, a["size"] - a["x"] <= b["x"]).otherwise(a["x"] <= b["size"] - b["x"])
        # the one that closes is full if words moved to it, else empty; the other holds what is left
        b_left = F.when(toward_a, b["x"] - to_a).otherwise(b["x"] + to_b)
        a_left = F.when(toward_a, a["x"] + to_a).otherwise(a["x"] - to_b)
        joined = F.when(
            a_closes, F.struct(item(b, b_left).alias("open"), F.array_append(acc["done"], settled(a, toward_a)).alias("done"))
        ).otherwise(F.struct(item(a, a_left).alias("open"), F.array_append(acc["done"], settled(b, ~toward_a)).alias("done")))
        return F.when(a.isNull(), F.struct(b.alias("open"), acc["done"].alias("done"))).otherwise(joined)

    return F.aggregate(items, start, pair)


def mix(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, row_no, source, size, source_size, target, copies, taken (copies * size).

    Null texts and texts without words have size 0 and are taken 0 times. Rows that share a doc_id are rounded
    separately; ``row_no`` numbers those that agree in doc_id, source and size, which are interchangeable. A null doc_id
    or source is a value like any other. An empty table gives no rows. Other columns of ``docs`` are not touched.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    return _decide(sized, scratch or Scratch(spark, "mix"))


def _decide(sized: DataFrame, scratch: Scratch) -> DataFrame:
    """``mix`` of (doc_id, source, size) rows."""
    # equal rows are counted before they meet, and numbered from their count
    counted = sized.groupBy("doc_id", "source", "size").agg(F.count("*").cast("int").alias("c"))
    sized = scratch.save(counted.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("row_no")), "sizes")
    targets = scratch.save(source_targets(sized, scratch), "targets").withColumnRenamed("source", "of_source")
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    x = F.when(F.col("rate") >= MOST_COPIES, F.lit(0.0)).otherwise((F.col("rate") - F.floor("rate")) * F.col("size"))
    joined = (
        joined.withColumn("rate", rate)
        .withColumn("whole", F.when(F.col("size") > 0, F.least(F.floor("rate"), F.lit(MOST_COPIES))).otherwise(0).cast("long"))
        .withColumn("x", x)
        .withColumn("r", F.xxhash64(F.lit(SEED), "doc_id", "size", "row_no", "source"))
    )
    level = joined.where((F.col("x") > 0) & (F.col("size") > 0)).select("source", F.struct("r", F.col("doc_id"), F.col("size"), F.col("x")).alias("item"))
    most = level.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts, n, step = [], most, 0
    while n > 0:
        step += 1
        n_blocks = max(1, -(-n // BLOCK))
        slot = F.pmod(F.xxhash64(F.lit(step), F.col("item.r"), F.col("item.doc_id")), F.lit(n_blocks))
        folded = level.withColumn("slot", slot).groupBy("source", "slot").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("item.size")).alias("o"), "item"))), lambda p: p["item"]).alias("items"))
        folded = scratch.save(folded.select("source", _fold(F.col("items"), step).alias("f")), f"level{step}")
        parts.append(folded.select(F.explode("f.done").alias("d")).select("d.*"))
        level = folded.where(F.col("f.open").isNotNull()).select("source", F.col("f.open").alias("item"))
        if n_blocks == 1:
            last = level.select(F.col("item.r"), F.col("item.doc_id"), (_uniform(F.lit(0), F.col("item.r")) * F.col("item.size") < F.col("item.x")).alias("take"))
            parts.append(last)
            break
        n = n_blocks
    extra = None
    for p in parts:
        extra = p if extra is None else extra.unionByName(p)
    if extra is None:
        out = joined.withColumn("take", F.lit(False))
    else:
        extra = extra.where("take").select(F.col("r").alias("_r"), F.col("doc_id").alias("_d"), F.lit(True).alias("take"))
        out = joined.join(extra, (F.col("r") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    copies = F.col("whole") + F.coalesce(F.col("take").cast("long"), F.lit(0))
    return out.select("doc_id", "row_no", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``.

    Documents without words carry no words for the mix and go.
    """
    cols, scratch = docs.columns, Scratch(spark, "mix")
    own = {"__own_id": F.col("doc_id").cast("long"), "__own_source": F.col("source").cast("string"), "__own_mark": F.xxhash64("text")}
    marked = docs.withColumns(own).select(F.col("__own_id").alias("doc_id"), F.col("__own_source").alias("source"), n_words(F.col("text")).alias("size"), F.col("__own_mark").alias("mark"))
    marked = scratch.save(marked, "marked")
    key = ["doc_id", "source", "size"]
    places = marked.withColumn("no", F.row_number().over(Window.partitionBy(*key).orderBy("mark"))).withColumnsRenamed({c: f"__{c}" for c in key})
    decided = _decide(marked.select(*key), scratch).where("copies > 0").select(*key, "row_no", "copies")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    found = places.join(decided, [*on, F.col("no") == F.col("row_no")], "left")
    # rows that agree in id, source and text: their number, and the copies of each
    some = found.groupBy(F.col("__doc_id").alias("__mix_id"), F.col("__source").alias("__mix_source"), F.col("mark").alias("__mix_mark")).agg(F.sort_array(F.collect_list(F.coalesce("copies", F.lit(0)).cast("int")), asc=False).alias("__mix_copies"))
    some = scratch.save(some.where(F.col("__mix_copies")[0] > 0), "copies")

    def repeated(few: DataFrame, place: Column) -> DataFrame:
        # the texts are dealt once and never sorted: what is held of a task's rows is the narrow side
        on = [F.col(f"__own_{c}").eqNullSafe(F.col(f"__mix_{c}")) for c in ("id", "source", "mark")]
        both = docs.withColumns(own).join(few.hint("shuffle_hash"), on)
        n = F.get(F.col("__mix_copies"), place)
        return both.withColumn("__mix_n", n).where("__mix_n > 0").withColumn("__mix_i", F.explode(F.sequence(F.lit(1), F.col("__mix_n")))).select(*cols)

    out = repeated(some.where(F.size("__mix_copies") == 1), F.lit(0))
    many = some.where(F.size("__mix_copies") > 1)
    if many.isEmpty():
        return out
    same = Window.partitionBy("__own_id", "__own_source", "__own_mark").orderBy(F.lit(1))
    return out.unionByName(repeated(many, F.row_number().over(same) - 1))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
