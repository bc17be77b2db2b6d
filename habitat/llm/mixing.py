"""Mix sources to target weights by hash-threshold histograms, with SQL functions only.

A document's hash places it on a line of 60 bits. Each source keeps every document
``floor(target / size of the source)`` times and gives one copy more to the documents
below a threshold on that line. The threshold is found by histograms: sizes are
summed by source and hash bucket, the bucket in which the budget ends is looked up,
and only that bucket is counted again with finer buckets. Nothing is sorted, and the
documents themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from habitat.llm.common import WORD, clear_prefix, cut

#: Weights by rank of the source, repeated.
WEIGHTS = (1, 2, 3)
#: A source may be taken so many times at most.
MOST = 3
HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def hash_line(doc_id: str = "doc_id") -> Column:
    """60 bits of the md5 of the id as text; a null id counts as the empty text."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add ``target`` to a table (source, source_size) with one row per source.

    Sources by code point, null last, get the weights in turn. Targets share the sum of all
    sizes by weight; none is above ``most`` times its source's size. The common water
    level of the sources below their cap is the highest that any of them would need
    when those with lower caps are full. Only this one-row-per-source table is ordered.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("level", left / share)
        .withColumn("level", F.max("level").over(every))
        .select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, below_hash): documents whose hash is under ``below_hash`` get a copy more.

    ``sized`` has (source, size, h). Documents of one source and hash share a verdict; the
    one in which the budget ends is taken if that brings the sum nearer to it.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = cut(
        goals.withColumn("passes", passes)
        .withColumn("budget", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("below", F.lit(0).cast("long"))
        .withColumn("last", F.lit(0).cast("long"))
    )
    for used in range(0, HASH_BITS, LEVEL_BITS):
        state = cut(_refine(sized, state, used))
    nearer = F.abs(F.col("below") + F.col("last") - F.col("budget")) < F.abs(F.col("below") - F.col("budget"))
    edge = F.when(F.col("prefix").isNull(), F.lit(1 << HASH_BITS)).otherwise(F.col("prefix") + nearer.cast("long"))
    return state.select("source", "source_size", "target", "passes", edge.cast("long").alias("below_hash"))


def _refine(sized: DataFrame, state: DataFrame, used: int) -> DataFrame:
    """One level: count the boundary bucket of each source in finer buckets and find the next one.

    ``prefix`` becomes null where the budget is never reached, so that all documents are below it.
    """
    left = HASH_BITS - used
    inside = sized.join(
        state.select(F.col("source").alias("at"), "prefix"),
        F.col("source").eqNullSafe(F.col("at")) & (F.shiftright("h", left) == F.col("prefix")),
    )
    bucket = F.shiftright("h", left - LEVEL_BITS).bitwiseAND((1 << LEVEL_BITS) - 1)
    counts = (
        inside.groupBy("source", bucket.alias("b")).agg(F.sum("size").alias("s"))
        .groupBy(F.col("source").alias("at")).agg(F.array_sort(F.collect_list(F.struct("b", "s"))).alias("counts"))
    )
    start = F.struct(F.col("below").alias("below"), F.lit(None).cast("long").alias("b"), F.lit(0).cast("long").alias("last"))

    def step(acc: Column, x: Column) -> Column:
        done, over = acc["b"].isNotNull(), acc["below"] + x["s"] > F.col("budget")
        return F.when(done, acc).when(over, F.struct(acc["below"].alias("below"), x["b"].alias("b"), x["s"].alias("last"))).otherwise(
            F.struct((acc["below"] + x["s"]).alias("below"), acc["b"].alias("b"), acc["last"].alias("last"))
        )

    found = F.aggregate(F.coalesce("counts", F.array().cast("array<struct<b:bigint,s:bigint>>")), start, step)
    return (
        state.join(counts, F.col("source").eqNullSafe(F.col("at")), "left").drop("at")
        .withColumn("found", found).drop("counts")
        .withColumn("prefix", F.shiftleft("prefix", LEVEL_BITS) + F.col("found.b"))
        .withColumn("below", F.col("found.below")).withColumn("last", F.col("found.last")).drop("found")
    )


def _plan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    sized = cut(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count().alias("size"), hash_line().alias("h")))
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    return sized, thresholds(sized, goals)


def _copies() -> Column:
    return F.col("passes") + (F.col("h") < F.col("below_hash")).cast("long")


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken.

    ``docs`` needs doc_id, text, source; other columns are not read. Null or empty texts have size 0. A
    null source is a source of its own. Repeated rows share a verdict. A source without words has
    target 0 and is not taken. An empty table gives no rows.
    """
    sized, edges = _plan(docs)
    edges = edges.withColumnRenamed("source", "at")
    out = sized.join(edges, F.col("source").eqNullSafe(F.col("at"))).withColumn("copies", _copies())
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as many times as the mix takes it, with the same columns."""
    _, edges = _plan(docs)
    own = clear_prefix(docs)
    at, passes, below, copies, copy = (own + c for c in ("at", "passes", "below", "copies", "copy"))
    edges = edges.select(F.col("source").alias(at), F.col("passes").alias(passes), F.col("below_hash").alias(below))
    times = (F.col(passes) + (hash_line() < F.col(below)).cast("long")).cast("int")
    taken = docs.join(edges, docs["source"].cast("string").eqNullSafe(F.col(at))).withColumn(copies, times).filter(F.col(copies) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
