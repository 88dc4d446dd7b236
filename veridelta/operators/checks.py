"""Assumption checks on whole tables. A check is a few conditional aggregates, so many fuse into one pass."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import ratio


@dataclass(frozen=True)
class Check:
    """parts: aggregates by name; metric, drifted: what follows from them."""

    name: str
    parts: dict[str, Column]
    metric: Callable[[dict[str, Column]], Column]
    drifted: Callable[[dict[str, Column]], Column]


def shifted(ts: str | Column, hours: int) -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts) + F.make_interval(hours=F.lit(hours))


def temporal_bucket(ts: str, hours: int) -> Check:
    """Share of rows that fall on another day after a shift."""
    moved = F.count_if(F.to_date(ts) != F.to_date(shifted(ts, hours)))
    return Check("temporal_bucket", {"moved": moved, "total": F.count(ts)}, lambda p: ratio(p["moved"], p["total"]), lambda p: p["moved"] > 0)


def zone_bucket(ts: str, source: str, target: str) -> Check:
    """As temporal_bucket, from one named zone to another (daylight saving included)."""
    there = F.convert_timezone(F.lit(source), F.lit(target), F.col(ts))
    return Check("zone_bucket", {"moved": F.count_if(F.to_date(ts) != F.to_date(there)), "total": F.count(ts)}, lambda p: ratio(p["moved"], p["total"]), lambda p: p["moved"] > 0)


def selection_ratio(old: Column, new: Column, limit: float = 1.5) -> Check:
    """Rows a new predicate selects over those of the old one; null (and drift) if only the new one selects any."""
    r = lambda p: F.when(p["old"] > 0, p["new"] / p["old"]).when(p["new"] == 0, F.lit(1.0))
    return Check("selection_ratio", {"old": F.count_if(old), "new": F.count_if(new)}, r, lambda p: F.coalesce(r(p) > limit, F.lit(True)))


def unhandled_domain(c: str, handled: list[str]) -> Check:
    """Share of rows whose value isn't handled; null is not, unless it is listed."""
    ok = F.coalesce(F.col(c).isin([h for h in handled if h is not None]), F.lit(None in handled))
    return Check("unhandled_domain", {"hit": F.count_if(~ok), "total": F.count("*")}, lambda p: ratio(p["hit"], p["total"]), lambda p: p["hit"] > 0)


def masked_nulls(c: str) -> Check:
    return Check("masked_nulls", {"hit": F.count_if(F.col(c).isNull()), "total": F.count("*")}, lambda p: ratio(p["hit"], p["total"]), lambda p: p["hit"] > 0)


def truncation(c: str, n: int) -> Check:
    return Check("truncation", {"hit": F.count_if(F.char_length(c) > n), "longest": F.max(F.char_length(c))}, lambda p: p["longest"].cast("double"), lambda p: p["hit"] > 0)


def precision(c: str, p: int, s: int, eps: float = 1e-6) -> Check:
    """Values too large for numeric(p, s), or with more than s decimals."""
    v = F.col(c).cast("double")
    scaled = v * 10**s
    big, fine = F.abs(v) >= 10 ** (p - s), F.abs(scaled - F.rint(scaled)) > eps * 10**s
    return Check("precision", {"hit": F.count_if(big | fine), "total": F.count(c)}, lambda x: ratio(x["hit"], x["total"]), lambda x: x["hit"] > 0)


def not_null(c: str) -> Check:
    return Check("not_null", {"hit": F.count_if(F.col(c).isNull())}, lambda p: p["hit"].cast("double"), lambda p: p["hit"] > 0)


def run_checks(df: DataFrame, plan: dict[str, Check], by: list[Column] = []) -> DataFrame:
    """One row per check: check, family, metric, status, evidence (its counts). All checks share one pass over df.

    Null metrics mean that there is nothing to divide by. With `by`, checks run for each group.
    """
    one = df.groupBy(*by).agg(*[a.alias(f"{k}__{n}") for k, c in plan.items() for n, a in c.parts.items()])
    rows = []
    for k, c in plan.items():
        parts = {n: F.col(f"{k}__{n}") for n in c.parts}
        drift = F.coalesce(c.drifted(parts), F.lit(False))
        evidence = F.create_map(*[x for n, v in parts.items() for x in (F.lit(n), v.cast("long"))])
        rows.append(F.struct(F.lit(k).alias("check"), F.lit(c.name).alias("family"), c.metric(parts).cast("double").alias("metric"), F.when(drift, "drift_detected").otherwise("no_drift_detected").alias("status"), evidence.alias("evidence")))
    keys = [x for x in one.columns if "__" not in x]
    return one.select(*keys, F.inline(F.array(*rows)))


def bucket_migration(df: DataFrame, ts: str, hours: int) -> DataFrame:
    """Rows per day before and after the shift."""
    moved = df.select(F.explode(F.array(F.struct(F.to_date(ts).alias("day"), F.lit(1).alias("b"), F.lit(0).alias("a")), F.struct(F.to_date(shifted(ts, hours)).alias("day"), F.lit(0).alias("b"), F.lit(1).alias("a")))).alias("x"))
    return moved.groupBy("x.day").agg(F.sum("x.b").alias("before"), F.sum("x.a").alias("after"))


def scope_ratio(old: DataFrame, new: DataFrame, limit: float = 2.0) -> DataFrame:
    both = old.agg(F.count("*").alias("old_rows")).crossJoin(new.agg(F.count("*").alias("new_rows")))  # one row each
    r = F.when(F.col("old_rows") > 0, F.col("new_rows") / F.col("old_rows")).when(F.col("new_rows") == 0, F.lit(1.0))
    return both.select("old_rows", "new_rows", r.alias("metric"), F.coalesce(r > limit, F.lit(True)).alias("drift"))


def unhandled_values(df: DataFrame, c: str, handled: list[str], k: int = 20) -> DataFrame:
    """Up to k values that aren't handled, most frequent first."""
    return df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).where(~F.coalesce(F.col("value").isin(handled), F.lit(False))).orderBy(F.desc("n"), "value").limit(k)


def domain_drift(before: DataFrame, after: DataFrame, c: str) -> DataFrame:
    """Values, in lower case, that only `after` has."""
    values = lambda d: d.where(F.col(c).isNotNull()).select(F.lower(F.col(c).cast("string")).alias("value")).distinct()
    return values(after).join(values(before), "value", "left_anti")


def distribution_drift(before: DataFrame, after: DataFrame, c: str, nulls: float = 0.2, share: float = 0.25, least: float = 1.0) -> DataFrame:
    """Safe if null rates differ by less than `nulls` and averages by less than the larger of share x average and `least`."""

    def stats(d: DataFrame, s: str) -> DataFrame:
        v = F.col(c).cast("decimal(18,4)")
        return d.agg(F.count("*").alias(f"n_{s}"), F.count_if(F.col(c).isNull()).alias(f"nulls_{s}"), (F.sum(v).cast("double") / F.count(v)).alias(f"avg_{s}"))

    both = stats(before, "before").crossJoin(stats(after, "after"))  # one row each
    rate = lambda s: ratio(F.col(f"nulls_{s}"), F.col(f"n_{s}"))
    ok = (F.abs(rate("after") - rate("before")) < nulls) & (F.abs(F.col("avg_after") - F.col("avg_before")) < F.greatest(share * F.abs("avg_before"), F.lit(least)))
    return both.withColumn("safe", F.coalesce(ok, F.lit(False)))


def orphan_rows(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Rows of child without a parent; a null key is an orphan too."""
    return child.join(parent.select(F.col(pk).alias("__pk")).distinct(), F.col(fk) == F.col("__pk"), "left_anti")


def fanout(left: DataFrame, right: DataFrame, lk: list[str], rk: list[str], limit: float = 1.05, nulls_match: bool = False) -> DataFrame:
    """left_rows, joined_rows, metric, drift of an inner join, without building it: key counts are multiplied.

    Rows of one key are summed in parts before they meet, so a hot key costs no more than others.
    """
    ks = [f"k{i}" for i in range(len(lk))]
    count = lambda d, cols, n: d.groupBy(*[F.col(c).alias(k) for c, k in zip(cols, ks)]).agg(F.count("*").alias(n))
    a, b = count(left, lk, "nl"), count(right, rk, "nr").withColumnsRenamed({k: f"r{k}" for k in ks})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"r{k}")) if nulls_match else F.col(k) == F.col(f"r{k}") for k in ks])
    both = a.join(b, on, "left").agg(F.sum("nl").alias("left_rows"), F.sum(F.col("nl").cast("decimal(38,0)") * F.coalesce("nr", F.lit(0))).alias("joined_rows"))
    both = both.select(F.coalesce("left_rows", F.lit(0)).alias("left_rows"), F.coalesce("joined_rows", F.lit(0)).cast("long").alias("joined_rows"))
    r = F.when(F.col("left_rows") > 0, F.col("joined_rows") / F.col("left_rows")).otherwise(F.lit(1.0))
    return both.select("*", r.alias("metric"), (r > limit).alias("drift"))


def blank_key_fanout(before: DataFrame, after: DataFrame, right: DataFrame, lk: str, rk: str) -> DataFrame:
    """Join rows before and after keys were blanked; unsafe beyond half as many again, or ten, whichever is more."""
    b = fanout(before, right, [lk], [rk]).select(F.col("joined_rows").alias("before_rows"))
    a = fanout(after, right, [lk], [rk]).select(F.col("joined_rows").alias("after_rows"))
    return b.crossJoin(a).withColumn("safe", F.col("after_rows") <= F.greatest(F.floor(F.col("before_rows") * 1.5), F.col("before_rows") + 10))


def stale_rollup_rows(rollup: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Rows of a rollup whose base row is gone."""
    return rollup.join(base.select(key).distinct(), key, "left_anti")


def varchar_length(kind: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(kind), r"(?:var)?char(?:acter varying)?\s*\(\s*(\d+)\s*\)", 1), F.lit("")).cast("int")


def numeric_precision(kind: Column) -> Column:
    """struct(p, s) of numeric(p, s) or decimal(p[, s]); null for other types."""
    pattern = r"(?:numeric|decimal)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)"
    p, s = F.regexp_extract(F.lower(kind), pattern, 1), F.regexp_extract(F.lower(kind), pattern, 2)
    return F.when(p != "", F.struct(p.cast("int").alias("p"), F.when(s != "", s.cast("int")).otherwise(0).alias("s")))


def crosses_time_zone(before: Column, after: Column) -> Column:
    """Whether one type has a time zone and the other, also a timestamp, has none."""
    zoned = lambda c: F.lower(c).rlike(r"timestamp_?tz|timestamptz|with time zone|timestamp_ltz") & ~F.lower(c).contains("without")
    stamp = lambda c: F.lower(c).rlike("timestamp|datetime")
    return stamp(before) & stamp(after) & (zoned(before) != zoned(after))
