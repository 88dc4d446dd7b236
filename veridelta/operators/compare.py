"""Before and after: keys, values, schemas, whole results, and probe suites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import family


def _sides(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Full outer join on keys with markers in_a, in_b and columns a_<c>, b_<c>; null keys match each other."""
    x = a.select(*[F.col(k).alias(f"xk_{k}") for k in keys], *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("xa"))
    y = b.select(*[F.col(k).alias(f"yk_{k}") for k in keys], *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("yb"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"xk_{k}").eqNullSafe(F.col(f"yk_{k}"))
    j = x.join(y, on, "full_outer")
    return j.select(*[F.coalesce(f"xk_{k}", f"yk_{k}").alias(k) for k in keys], F.coalesce("xa", F.lit(False)).alias("in_a"), F.coalesce("yb", F.lit(False)).alias("in_b"), *[x for c in cols for x in (f"a_{c}", f"b_{c}")])


def key_diff(champion: DataFrame, challenger: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with the side."""
    j = _sides(champion.select(*keys).distinct(), challenger.select(*keys).distinct(), keys, [])
    return j.where("not (in_a and in_b)").select(*keys, F.when(F.col("in_a"), "champion_only").otherwise("challenger_only").alias("side"))


def value_diff(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Rows of unique keys that differ: the keys, status (added, removed, changed), and the changed columns."""
    j = _sides(a, b, keys, cols)
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in cols]))
    status = F.when(~F.col("in_b"), "removed").when(~F.col("in_a"), "added").when(F.size("changed") > 0, "changed")
    out = j.select(*keys, "in_a", "in_b", changed.alias("changed")).withColumn("status", status)
    return out.where("status is not null").select(*keys, "status", F.when(F.col("status") == "changed", F.col("changed")).alias("changed_columns"))


def value_diff_counts(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """How many keys each column changed in."""
    return value_diff(a, b, keys, cols).where("status = 'changed'").select(F.explode("changed_columns").alias("column_name")).groupBy("column_name").agg(F.count("*").alias("changed_rows"))


def schema_table(df: DataFrame, name: str) -> DataFrame:
    """The columns of a DataFrame as rows."""
    return df.sparkSession.createDataFrame([(name, f.name, f.dataType.simpleString(), family(f.dataType), f.nullable) for f in df.schema], "table_name string, column_name string, dtype string, family string, nullable boolean")


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """missing, extra and mismatched columns of two catalogs (table_name, column_name, dtype)."""
    j = _sides(a, b, ["table_name", "column_name"], ["dtype"])
    kind = F.when(~F.col("in_b"), "missing").when(~F.col("in_a"), "extra").when(~F.col("a_dtype").eqNullSafe(F.col("b_dtype")), "type_mismatch")
    return j.withColumn("finding", kind).where("finding is not null").select("table_name", "column_name", "finding", F.col("a_dtype").alias("before"), F.col("b_dtype").alias("after"))


def fingerprint(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """rows and a sum of row hashes: equal for equal rows in any order. Hashes pass over nulls, so their places go in too."""
    own = cols or df.columns
    h = F.xxhash64(*[F.col(c) for c in own], *[F.col(c).isNull() for c in own])
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("fingerprint"))


def compare_results(orig: DataFrame, after: DataFrame, tolerance: float = 0.001, allow_added: bool = False) -> DataFrame:
    """One row: status, rows before and after. In order: removed columns, added columns, row count, content, passed.

    Whole results are counted and hashed. The row counts differ if their change is over `tolerance` of the original,
    unless that is empty.
    """
    removed, added = [c for c in orig.columns if c not in after.columns], [c for c in after.columns if c not in orig.columns]
    same = [c for c in orig.columns if c in after.columns]
    o = fingerprint(orig, same).select(F.col("n").alias("before_rows"), F.col("fingerprint").alias("f"))
    a = fingerprint(after, same).select(F.col("n").alias("after_rows"), F.col("fingerprint").alias("g"))
    both = o.crossJoin(a)  # one row each
    far = (F.col("before_rows") > 0) & (F.abs(F.col("after_rows") - F.col("before_rows")) > tolerance * F.col("before_rows"))
    status = F.when(F.lit(bool(removed)), "COLUMN_REMOVED").when(F.lit(bool(added) and not allow_added), "COLUMN_ADDED").when(far, "ROW_COUNT_DRIFT").when(F.col("f") != F.col("g"), "VALUE_DRIFT").otherwise("PASSED")
    return both.select(status.alias("status"), "before_rows", "after_rows")


def tidy(probe: str, df: DataFrame, key: Column | None, metrics: dict[str, Column]) -> DataFrame:
    """(probe, key, metric, value) rows of an aggregate."""
    g = df.groupBy((F.lit("") if key is None else F.coalesce(key.cast("string"), F.lit("<null>"))).alias("key")).agg(*[m.cast("double").alias(k) for k, m in metrics.items()])
    return g.select(F.lit(probe).alias("probe"), "key", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])))


def top(df: DataFrame, k: int) -> DataFrame:
    return df.orderBy(F.desc("value"), "key").limit(k)


def exact(c: str) -> Column:
    """A number as a decimal, whose sum doesn't depend on the order."""
    return F.col(c).cast("decimal(18,4)")


def probe_suite(df: DataFrame, name: str, domains: list[str] = [], metrics: list[str] = [], ts: str | None = None, fks: list[tuple[str, DataFrame, str]] = []) -> DataFrame:
    """Row count, non-null counts, top values, count / sum / min / max of numbers, counts by day, orphans per foreign key."""
    parts = [tidy(f"{name}.rows", df, None, {"n": F.count("*")}), tidy(f"{name}.non_null", df, None, {c: F.count(c) for c in df.columns})]
    parts += [top(tidy(f"{name}.top.{c}", df, F.col(c), {"n": F.count("*")}), 20) for c in domains[:2]]
    parts += [tidy(f"{name}.stats.{c}", df, None, {"n": F.count(c), "sum": F.sum(exact(c)), "min": F.min(c), "max": F.max(c)}) for c in metrics[:2]]
    if ts:
        parts.append(tidy(f"{name}.daily", df, F.to_date(ts), {"n": F.count("*")}).orderBy(F.desc("key")).limit(20))
    for fk, parent, pk in fks:
        known = parent.select(F.col(pk).alias("__pk")).distinct()
        parts.append(tidy(f"{name}.orphans.{fk}", df.join(known, F.col(fk) == F.col("__pk"), "left_anti"), None, {"n": F.count("*")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forward_probes(df: DataFrame, c: str, name: str, now: str, ts: str | None = None, metric: str | None = None, status: str | None = None) -> DataFrame:
    """Probes for a new or changed column: non-null, distinct, top values; days to `now` by count and metric; metric by status."""
    parts = [tidy(f"{name}.{c}.filled", df, None, {"non_null": F.count(c), "total": F.count("*"), "distinct": F.count_distinct(F.col(c))}), top(tidy(f"{name}.{c}.top", df, F.col(c), {"n": F.count("*")}), 20)]
    if ts:
        day = F.to_date(ts)
        since = lambda k: df.where((day > F.date_sub(F.lit(now).cast("date"), k)) & (day <= F.lit(now).cast("date")))
        parts += [tidy(f"{name}.daily30", since(30), day, {"n": F.count("*")}), tidy(f"{name}.last7", since(7), None, {"n": F.count("*")})]
        parts += [tidy(f"{name}.metric14", since(14), day, {"sum": F.sum(exact(metric))})] if metric else []
    if metric and status:
        parts.append(top(tidy(f"{name}.by_status", df, F.col(status), {"sum": F.sum(exact(metric))}), 20))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_replay(before: DataFrame, after: DataFrame) -> DataFrame:
    """Status of each probe: both sides' tidy rows are compared, null values included."""
    j = _sides(before, after, ["probe", "key", "metric"], ["value"])
    bad = ~F.col("in_a") | ~F.col("in_b") | ~F.col("a_value").eqNullSafe(F.col("b_value"))
    return j.groupBy("probe").agg(F.count("*").alias("compared"), F.count_if(bad).alias("differing")).withColumn("passed", F.col("differing") == 0)


def replay_verdict(results: DataFrame) -> DataFrame:
    """pass_rate and verdict: all pass, at least 95 in 100, fewer, or no queries."""
    r = F.col("pass_rate")
    out = results.agg(F.count("*").alias("queries"), F.count_if("passed").alias("passed"), F.avg(F.col("passed").cast("int")).alias("pass_rate"))
    return out.withColumn("verdict", F.when(F.col("queries") == 0, "NO_QUERIES").when(r == 1.0, "SAFE").when(r >= 0.95, "SAFE_WITH_PATCHES").otherwise("BLOCKED"))
