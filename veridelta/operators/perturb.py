"""Changes to tables that build the 'after' side of a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one task may sort.
FEW = 10_000


def first_k_by_key(df: DataFrame, pk: str, share: float, pred: Column | None = None) -> Column:
    """A condition on pk that holds for the ceil(n * share) smallest keys among rows that satisfy pred (at least one).

    No sort to one task: rows by range partition are counted, and the range in which the k-th key lies is split again
    until it holds few rows (`FEW`), whatever the size of the table. Keys are unique. No rows: the condition never holds.
    """
    rows = (df if pred is None else df.where(pred)).select(F.col(pk).alias("k")).where("k is not null")
    n = rows.count()
    if n == 0:
        return F.lit(False)
    k = max(1, -int(-n * share // 1))
    while n > FEW:
        ranges = rows.repartitionByRange(min(200, n // FEW + 1), "k").withColumn("p", F.spark_partition_id()).groupBy("p")
        edges = ranges.agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high")).orderBy("low").collect()  # at most 200 rows
        if len(edges) == 1:  # one key, repeated
            break
        for e in edges:
            if k <= e.n:
                break
            k -= e.n
        n, rows = e.n, rows.where((F.col("k") >= F.lit(e.low)) & (F.col("k") <= F.lit(e.high)))
    cutoff = rows.orderBy("k").limit(k).agg(F.max("k")).first()[0]
    return (F.col(pk) <= F.lit(cutoff)) & (F.lit(True) if pred is None else F.coalesce(pred, F.lit(False)))


def null_flood(df: DataFrame, c: str, pk: str, share: float = 0.15) -> DataFrame:
    """Sets c to null in the first share of rows in which it is filled."""
    return df.withColumn(c, F.when(~first_k_by_key(df, pk, share, F.col(c).isNotNull()), F.col(c)))


def blank_flood(df: DataFrame, c: str, pk: str, share: float = 0.15) -> DataFrame:
    return df.withColumn(c, F.when(first_k_by_key(df, pk, share, F.trim(c) != ""), "").otherwise(F.col(c)))


def domain_expand(df: DataFrame, c: str, pk: str, value: str, share: float = 0.05) -> DataFrame:
    return df.withColumn(c, F.when(first_k_by_key(df, pk, share), F.lit(value)).otherwise(F.col(c)))


def dominant(df: DataFrame, c: str) -> object:
    """The most frequent value; of equally frequent ones the smallest."""
    row = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(1).collect()
    return row[0][c] if row else None


def key_skew(df: DataFrame, c: str, pk: str, share: float = 0.15) -> DataFrame:
    """Sets c to its dominant value in the first share of rows."""
    return df.withColumn(c, F.when(first_k_by_key(df, pk, share), F.lit(dominant(df, c))).otherwise(F.col(c)))


def time_shift(df: DataFrame, c: str, pk: str, days: int = 7, share: float = 0.15) -> DataFrame:
    return df.withColumn(c, F.when(first_k_by_key(df, pk, share), F.col(c) - F.make_interval(days=F.lit(days))).otherwise(F.col(c)))


def volume_spike(df: DataFrame, pk: str, times: int = 10, share: float = 0.05) -> DataFrame:
    """Appends times - 1 copies of the first share (held between 0.01 and 0.2) of rows, without their key."""
    some = df.where(first_k_by_key(df, pk, min(0.2, max(0.01, share))))
    copies = some.withColumn("__i", F.explode(F.sequence(F.lit(1), F.lit(times - 1)))).drop("__i").withColumn(pk, F.lit(None).cast(df.schema[pk].dataType))
    return df.unionByName(copies)


def empty(df: DataFrame) -> DataFrame:
    return df.limit(0)


def drop_column(df: DataFrame, c: str) -> DataFrame:
    return df.drop(c)


def rename_column(df: DataFrame, c: str, to: str) -> DataFrame:
    return df.withColumnRenamed(c, to)


def add_column(df: DataFrame, c: str, kind: str = "string") -> DataFrame:
    return df.withColumn(c, F.lit(None).cast(kind))


def retype_column(df: DataFrame, c: str, kind: str) -> DataFrame:
    return df.withColumn(c, F.col(c).try_cast(kind))

