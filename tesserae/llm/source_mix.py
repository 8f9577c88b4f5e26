"""Mixing sources to target weights by hash-threshold histograms.

Each source gets a target number of words.  A document has a fixed hash; whole
copies of the source are taken first, and the remaining budget goes to the
documents whose hash lies at or below a threshold.  The threshold is found
without a sort: words are summed by source and hash bucket, the boundary bucket
is the one in which the running sum crosses the budget, and only it is refined
into finer buckets until it holds a single hash.  Thresholds are nested: a
larger budget takes a superset of documents.

Nulls and odd cases: a null source is a source of its own, ordered last; a null
text has size 0; a null id hashes as the text 'null'; repeated ids share their
hash and are taken together; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, plain_names

WEIGHTS = (5, 2, 1)
TOTAL_PERCENT = 150
CAP = 2
BITS, STEP = 60, 12
ALL = -2


def doc_hash(col):
    """60 bits of the MD5 of the id, the same in every SQL engine that has md5."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").alias("source"), n_words(F.col("text")).alias("size"), doc_hash(F.col("doc_id")).alias("h"))


def source_targets(by_source: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights in source order, capped, the excess reshared.

    Water-filling in closed form: with sources ordered by size/weight, the ones
    below the level are full; one running sum finds the level, so nothing
    iterates.  The table has one row for each source.
    """
    w = F.array(*[F.lit(float(x)) for x in WEIGHTS])
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").cast("binary").asc_nulls_last())
    s = by_source.withColumn("w", F.element_at(w, ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    all_ = Window.partitionBy(F.lit(0))
    s = s.withColumn("cap", CAP * F.col("source_size").cast("double")).withColumn("r", F.col("cap") / F.col("w"))
    s = s.withColumn("budget", F.sum("source_size").over(all_) * (TOTAL_PERCENT / 100.0))
    upto = Window.partitionBy(F.lit(0)).orderBy("r").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("cap_le", F.sum("cap").over(upto)).withColumn("w_le", F.sum("w").over(upto)).withColumn("w_all", F.sum("w").over(all_))
    # source full at level r <=> filling everything up to level r does not exceed the budget
    s = s.withColumn("full", F.col("cap_le") + (F.col("w_all") - F.col("w_le")) * F.col("r") <= F.col("budget"))
    s = s.withColumn("full_cap", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(all_)).withColumn("open_w", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(all_))
    target = F.when(F.col("full"), F.col("cap")).otherwise((F.col("budget") - F.col("full_cap")) * F.col("w") / F.col("open_w"))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, t): the largest hash with sum(size of h <= t) <= budget, -1 if none; budgets has (source, budget)."""
    open_ = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("done"))
    for level in range(STEP, BITS + 1, STEP):
        shift = BITS - level
        o = open_.select(F.col("source").alias("__s"), "budget", "prefix", "done")
        inside = sized.join(o, F.col("source").eqNullSafe(F.col("__s")) & (F.shiftright("h", shift + STEP) == F.col("prefix")))
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first("done").alias("done"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.col("done") + F.sum("words").over(run))
        # the first bucket whose running sum exceeds the budget; none: the whole prefix fits
        crossing = hist.groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("budget"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")))).alias("x"),
            F.max("upto").alias("total"), F.first("budget").alias("budget"))
        nxt = open_.join(crossing.withColumnRenamed("source", "__s").drop("budget"), F.col("source").eqNullSafe(F.col("__s")), "left").select(
            "source", "budget", F.when(F.col("prefix") == ALL, ALL).otherwise(F.coalesce("x.bucket", F.lit(ALL))).cast("long").alias("prefix"), F.coalesce("x.before", "done").alias("done"))
        open_ = materialize(nxt, f"mix-level{level}")
    return open_.select("source", F.when(F.col("prefix") == ALL, F.lit((1 << BITS) - 1).cast("long")).otherwise(F.col("prefix") - 1).alias("t"))


def mix_plan(sized: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, t): a document is taken `whole` times, once more if its hash is at most t."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(by_source), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(CAP), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    targets = targets.withColumn("whole", ratio)
    t = thresholds(sized, targets.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    plan = targets.join(t.withColumnRenamed("source", "__t"), F.col("source").eqNullSafe(F.col("__t")), "left")
    return materialize(plan.select("source", "source_size", "target", "whole", F.coalesce("t", F.lit(-1).cast("long")).alias("t")), "mix-plan")


def with_copies(docs: DataFrame, plan: DataFrame, h, source: str = "source") -> DataFrame:
    """docs plus __size, __target and __copies from the plan of its source."""
    p = plan.select(F.col("source").alias("__s"), F.col("source_size").alias("__size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.col("t").alias("__t"))
    extra = F.when((F.col("__whole") < CAP) & (h <= F.col("__t")), 1).otherwise(0)
    return docs.join(p, F.col(source).eqNullSafe(F.col("__s")), "left").withColumn("__copies", (F.col("__whole") + extra).cast("int"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words taken, repeats counted, of every document."""
    sized = materialize(sizes(docs), "mix-sizes")
    m = with_copies(sized, mix_plan(sized), F.col("h"))
    return m.select("doc_id", "size", F.col("__size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__copies")).alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """Every taken copy as a row, columns unchanged; only narrow rows take part in the search for thresholds."""
    own, name, back = plain_names(docs)
    narrow = own.select(F.col(name["doc_id"]).alias("doc_id"), F.col(name["source"]).alias("source"), F.col(name["text"]).alias("text"))
    plan = mix_plan(materialize(sizes(narrow), "mix-sizes"))
    m = with_copies(own, plan, doc_hash(F.col(name["doc_id"])), name["source"])
    return back(m.select("*", F.explode(F.array_repeat(F.lit(1), F.col("__copies")))))
