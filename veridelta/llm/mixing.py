"""Mixing sources to target weights by hash thresholds.

Words are summed by source and hash bucket. The bucket in which a source's budget runs out is split again, twice, so
three histograms of 4096 buckets place a threshold among 2**36 hash values. A filter on the hash makes the choice;
nothing is sorted but the histograms. Budgets are nested: a larger one takes all that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, join_small, text_of, word_count

BITS, LEVELS = 12, 3


def doc_hash(doc_id: str, text: str = "text") -> Column:
    """36 bits of MD5 of the id and the text (null: empty), the same in every run and engine; rows of one id differ by their texts."""
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), text_of(text))
    return F.conv(F.substring(F.md5(key), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def targets(sized: DataFrame, weights: list[int], most: int) -> DataFrame:
    """source, source_size, target: weights repeat over the sources by code point, null last; what a source can't use
    (over `most` times its size) is shared among the rest by weight, until none is above.

    Filling stops at one level for all: with sources by size over weight, the first for which an even share of what is
    left fits gives the level. The windows run over one row per source.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = s.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    every, before = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()), W.unboundedPreceding
    s = s.select(
        "*",
        F.coalesce(F.sum("cap").over(every.rowsBetween(before, -1)), F.lit(0.0)).alias("capped"),
        F.coalesce(F.sum("w").over(every.rowsBetween(before, -1)), F.lit(0.0)).alias("w_capped"),
        F.sum("source_size").over(W.partitionBy(F.lit(1))).cast("double").alias("total"),
        F.sum("w").over(W.partitionBy(F.lit(1))).alias("w_total"),
    )
    level = (F.col("total") - F.col("capped")) / (F.col("w_total") - F.col("w_capped"))
    fits = F.min(F.when(level * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("order"), level.alias("level")))).over(W.partitionBy(F.lit(1)))
    return s.withColumn("level", fits["level"]).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def thresholds(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """source, source_size, target, whole (times all of a source is taken), limit (hashes below it are taken once more).

    The last hash value at the boundary is taken if that comes nearer to the target.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = cut(goal.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("limit", F.lit(0).cast("long")).withColumn("open", F.col("left") > 0))
    for k in range(LEVELS):
        shift = BITS * (LEVELS - 1 - k)
        inside = join_small(sized, state.where("open").select("source", "limit", "left"), ["source"], "inner")
        inside = inside.where(F.shiftright("h", shift + BITS) == F.shiftright("limit", shift + BITS)) if k else inside
        hist = inside.groupBy("source", "left", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"))
        by = W.partitionBy("source").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
        over = hist.withColumn("below", F.coalesce(F.sum("n").over(by), F.lit(0))).where(F.col("below") + F.col("n") > F.col("left"))
        edge = cut(over.groupBy("source").agg(F.min(F.struct("b", "below", "n")).alias("e")))
        state = join_small(state, edge, ["source"])
        past = F.col("open") & F.col("e").isNull()  # all hashes from here on fit, which rounding of the target can bring about
        new_left = F.when(F.col("e").isNotNull(), F.col("left") - F.col("e.below")).otherwise(F.col("left"))
        at = F.when(F.col("e").isNotNull(), F.shiftleft(F.col("e.b"), shift)).otherwise(F.col("limit"))
        if k == LEVELS - 1:
            at = at + F.when(F.col("e.n") - new_left < new_left, 1).otherwise(0)
        at = F.when(past, F.lit(2 ** (BITS * LEVELS))).otherwise(at)
        state = cut(state.select("source", "source_size", "target", "whole", new_left.alias("left"), at.alias("limit"), (F.col("open") & ~past).alias("open")))
    return state.select("source", "source_size", "target", "whole", "limit")


def mix(docs: DataFrame, weights: list[int] = [1, 2, 3], most: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, and copies: how often the mix takes the row.

    Nulls: a null text has size 0, a null source is the last source, a null doc_id hashes as the empty text. Only rows
    equal in doc_id, source and text are taken together. Sources without words have target 0. An empty table gives an empty
    result.
    """
    sized = cut(docs.select("doc_id", "source", word_count("text").alias("size"), doc_hash("doc_id").alias("h")))
    limits = thresholds(sized, targets(sized, weights, most))
    copies = (F.col("whole") + F.when(F.col("h") < F.col("limit"), 1).otherwise(0)).cast("long")
    out = join_small(sized, limits, ["source"]).withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: list[int] = [1, 2, 3], most: int = 3) -> DataFrame:
    """The rows of docs as the mix takes them: some not at all, some up to `most` times."""
    sized = cut(docs.select("source", word_count("text").alias("size"), doc_hash("doc_id").alias("h")))
    limits = thresholds(sized, targets(sized, weights, most)).select("source", F.col("whole").alias("__whole"), F.col("limit").alias("__limit"))
    own = join_small(docs, cut(limits), ["source"])
    copies = F.col("__whole") + F.when(doc_hash("doc_id") < F.col("__limit"), 1).otherwise(0)
    return own.where(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*docs.columns)
