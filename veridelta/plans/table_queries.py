"""Queries over tables: profiles, checks, comparisons, perturbations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as C
from ..operators import compare as D
from ..operators import perturb as P
from ..operators import profile as R
from .registry import query, table
from .views import view, with_views

ORDER_COLS = {"o_orderkey": "INTEGER", "o_custkey": "INTEGER", "o_orderstatus": "STRING", "o_totalprice": "FLOAT", "o_orderdate": "TEMPORAL", "o_orderpriority": "STRING"}
_PROFILE = " UNION ALL ".join(
    f"SELECT 'orders' AS table_name, '{c}' AS column_name, '{f}' AS family, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, (count(*) - count({c}))::DOUBLE / count(*) AS null_rate, count(DISTINCT {c})::DOUBLE / count(*) AS cardinality FROM orders" for c, f in ORDER_COLS.items()
)


@query(_PROFILE)
def d1_profile_exact(spark: SparkSession, sf: str) -> DataFrame:
    return R.profile_table(table(spark, sf, "orders"), "orders", exact=True)


@query(f"SELECT table_name, column_name, family, row_count, null_count, null_rate FROM ({_PROFILE})")
def d1_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Without its approximate columns, which other engines estimate otherwise."""
    return R.profile_table(table(spark, sf, "orders"), "orders").drop("distinct_count", "cardinality")


@query("SELECT count(*) AS row_count, count(*) - count(o_totalprice) AS null_rows, sum(o_totalprice::DECIMAL(18,4))::DOUBLE / count(o_totalprice) AS average FROM orders")
def d2_profile_column(spark: SparkSession, sf: str) -> DataFrame:
    return R.profile_column(table(spark, sf, "orders"), "o_totalprice")


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def d3_column_samples(spark: SparkSession, sf: str) -> DataFrame:
    return R.column_samples(table(spark, sf, "orders"), "o_orderpriority", 3)


@query("SELECT 'not_null' AS rule, 'o_custkey' AS column_name, count(*) - count(o_custkey) AS violations FROM orders UNION ALL SELECT 'unique', 'o_orderkey', count(*) - count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'unique', 'o_custkey', count(*) - count(DISTINCT o_custkey) FROM orders")
def g20_check_contracts(spark: SparkSession, sf: str) -> DataFrame:
    return R.check_contracts(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey", "o_custkey"])






def event_plan() -> dict[str, C.Check]:
    """The fused plan over events: reporting moves by five hours, a filter is loosened, values and nulls are checked."""
    return {
        "utc_minus_5": C.temporal_bucket("ts", -5),
        "recent": C.selection_ratio(F.col("event_id") % 10 == 0, F.col("event_id") % 10 < 3),
        "types": C.unhandled_domain("event_type", ["click", "view", "purchase"]),
        "values": C.masked_nulls("value"),
        "props_8": C.truncation("props", 8),
        "value_4_1": C.precision("value", 4, 1),
        "user": C.not_null("user_id"),
    }


_EVENTS = """WITH e AS (SELECT count(*) AS n, count(*) FILTER (CAST(ts AS DATE) <> CAST(ts - INTERVAL 5 HOUR AS DATE)) AS moved, count(*) FILTER (event_id % 10 = 0) AS o, count(*) FILTER (event_id % 10 < 3) AS w,
  count(*) FILTER (event_type NOT IN ('click','view','purchase')) AS u, count(*) - count(value) AS nv, count(*) FILTER (length(props) > 8) AS t, max(length(props)) AS m,
  count(*) FILTER (abs(value) >= 1000 OR abs(value * 10 - round_even(value * 10, 0)) > 1e-5) AS p, count(*) - count(user_id) AS nu FROM events)"""


@query(_EVENTS + """ SELECT 'utc_minus_5' AS "check", 'temporal_bucket' AS family, moved::DOUBLE / n AS metric, CASE WHEN moved > 0 THEN 'drift_detected' ELSE 'no_drift_detected' END AS status FROM e
 UNION ALL SELECT 'recent', 'selection_ratio', w::DOUBLE / o, CASE WHEN w > 1.5 * o THEN 'drift_detected' ELSE 'no_drift_detected' END FROM e
 UNION ALL SELECT 'types', 'unhandled_domain', u::DOUBLE / n, CASE WHEN u > 0 THEN 'drift_detected' ELSE 'no_drift_detected' END FROM e
 UNION ALL SELECT 'values', 'masked_nulls', nv::DOUBLE / n, CASE WHEN nv > 0 THEN 'drift_detected' ELSE 'no_drift_detected' END FROM e
 UNION ALL SELECT 'props_8', 'truncation', m::DOUBLE, CASE WHEN t > 0 THEN 'drift_detected' ELSE 'no_drift_detected' END FROM e
 UNION ALL SELECT 'value_4_1', 'precision', p::DOUBLE / n, CASE WHEN p > 0 THEN 'drift_detected' ELSE 'no_drift_detected' END FROM e
 UNION ALL SELECT 'user', 'not_null', nu::DOUBLE, CASE WHEN nu > 0 THEN 'drift_detected' ELSE 'no_drift_detected' END FROM e""")
def i5_run_checks(spark: SparkSession, sf: str) -> DataFrame:
    """D4, D6, D8, D9, D10, D11 and D12 in one pass."""
    return C.run_checks(table(spark, sf, "events"), event_plan()).drop("evidence")


@query("SELECT coalesce(b.day, a.day) AS day, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) b FULL JOIN (SELECT CAST(ts - INTERVAL 5 HOUR AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) a ON a.day = b.day")
def d5_bucket_migration(spark: SparkSession, sf: str) -> DataFrame:
    return C.bucket_migration(table(spark, sf, "events"), "ts", -5)


@query(with_views("SELECT (SELECT count(*) FROM orders_after) AS old_rows, (SELECT count(*) FROM orders) AS new_rows, (SELECT count(*) FROM orders)::DOUBLE / (SELECT count(*) FROM orders_after) AS metric, false AS drift", "orders_after"))
def d7_scope_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return C.scope_ratio(view(spark, sf, "orders_after"), table(spark, sf, "orders"))


@query("SELECT event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def d8_unhandled_values(spark: SparkSession, sf: str) -> DataFrame:
    return C.unhandled_values(table(spark, sf, "events"), "event_type", ["click", "view"])


@query("SELECT DISTINCT lower(event_type) AS value FROM events WHERE lower(event_type) NOT IN (SELECT lower(event_type) FROM events WHERE event_type IN ('click', 'error'))")
def d13_domain_drift(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return C.domain_drift(e.where(F.col("event_type").isin("click", "error")), e, "event_type")


@query(with_views("""SELECT n_before, nulls_before, avg_before, n_after, nulls_after, avg_after, abs(avg_after - avg_before) < greatest(0.25 * abs(avg_before), 1) AND abs(nulls_after::DOUBLE / n_after - nulls_before::DOUBLE / n_before) < 0.2 AS safe FROM
 (SELECT count(*) AS n_before, count(*) - count(o_totalprice) AS nulls_before, sum(o_totalprice::DECIMAL(18,4))::DOUBLE / count(o_totalprice) AS avg_before FROM orders),
 (SELECT count(*) AS n_after, count(*) - count(o_totalprice) AS nulls_after, sum(o_totalprice::DECIMAL(18,4))::DOUBLE / count(o_totalprice) AS avg_after FROM orders_after)""", "orders_after"))
def d14_distribution_drift(spark: SparkSession, sf: str) -> DataFrame:
    return C.distribution_drift(table(spark, sf, "orders"), view(spark, sf, "orders_after"), "o_totalprice")


@query(with_views("SELECT l_returnflag, count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders_after) GROUP BY 1", "orders_after"))
def c6_orphan_rows(spark: SparkSession, sf: str) -> DataFrame:
    return C.orphan_rows(table(spark, sf, "lineitem"), view(spark, sf, "orders_after"), "l_orderkey", "o_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("orphans"))


@query("SELECT (SELECT count(*) FROM orders) AS left_rows, count(*) AS joined_rows, count(*)::DOUBLE / (SELECT count(*) FROM orders) AS metric, count(*) > 1.05 * (SELECT count(*) FROM orders) AS drift FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def c7_fanout(spark: SparkSession, sf: str) -> DataFrame:
    return C.fanout(table(spark, sf, "orders"), table(spark, sf, "lineitem"), ["o_orderkey"], ["l_orderkey"])


@query("""WITH b AS (SELECT count(*) AS n FROM orders a JOIN orders c ON a.o_orderstatus = c.o_orderstatus), k AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS s FROM orders)
 SELECT b.n AS before_rows, (SELECT count(*) FROM k JOIN orders c ON k.s = c.o_orderstatus) AS after_rows, true AS safe FROM b""")
def c8_blank_key_fanout(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    after = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")))
    return C.blank_key_fanout(o, after, o, "o_orderstatus", "o_orderstatus")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 200 = 7")
def c9_stale_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return C.stale_rollup_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), view(spark, sf, "orders_after"), "o_orderkey")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'varchar(' || length(p_name) || ')' WHEN 1 THEN 'NUMERIC(' || p_size || ', ' || p_size % 5 || ')' WHEN 2 THEN 'timestamp with time zone' ELSE 'timestamp' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN length(p_name) END AS length, CASE WHEN p_partkey % 4 = 1 THEN p_size END AS p, CASE WHEN p_partkey % 4 = 1 THEN p_size % 5 END AS s, p_partkey % 4 = 2 AS crosses FROM part")
def b17_declared_types(spark: SparkSession, sf: str) -> DataFrame:
    """A declared type a part: text as wide as its name, numbers of its size, times with and without a zone."""
    k = F.col("p_partkey") % 4
    kind = F.when(k == 0, F.format_string("varchar(%d)", F.length("p_name"))).when(k == 1, F.format_string("NUMERIC(%d, %d)", "p_size", F.col("p_size") % 5)).when(k == 2, "timestamp with time zone").otherwise("timestamp")
    kinds = table(spark, sf, "part").select("p_partkey", kind.alias("kind"))
    ps = C.numeric_precision(F.col("kind"))
    return kinds.select("p_partkey", "kind", C.varchar_length(F.col("kind")).alias("length"), ps["p"].alias("p"), ps["s"].alias("s"), C.crosses_time_zone(F.lit("timestamp"), F.col("kind")).alias("crosses"))


@query(with_views("SELECT o_orderkey, 'champion_only' AS side FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_after)", "orders_after"))
def c1_key_diff(spark: SparkSession, sf: str) -> DataFrame:
    return D.key_diff(table(spark, sf, "orders"), view(spark, sf, "orders_after"), ["o_orderkey"])


@query(with_views("""SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS status,
 CASE WHEN a.o_orderkey IS NOT NULL THEN concat_ws(',', CASE WHEN b.o_orderstatus IS DISTINCT FROM a.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN b.o_totalprice IS DISTINCT FROM a.o_totalprice THEN 'o_totalprice' END) END AS changed
 FROM orders b FULL JOIN orders_after a ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR b.o_orderstatus IS DISTINCT FROM a.o_orderstatus OR b.o_totalprice IS DISTINCT FROM a.o_totalprice""", "orders_after"))
def c2_value_diff(spark: SparkSession, sf: str) -> DataFrame:
    out = D.value_diff(table(spark, sf, "orders"), view(spark, sf, "orders_after"), ["o_orderkey"], ["o_orderstatus", "o_totalprice"])
    return out.select("o_orderkey", "status", F.array_join("changed_columns", ",").alias("changed"))


@query("SELECT 'o_custkey' AS column_name, 'missing' AS finding FROM (SELECT count(*) FROM orders) UNION ALL SELECT 'o_orderdate', 'missing' UNION ALL SELECT 'o_orderpriority', 'missing'")
def c3_schema_diff(spark: SparkSession, sf: str) -> DataFrame:
    return D.schema_diff(D.schema_table(table(spark, sf, "orders"), "orders"), D.schema_table(view(spark, sf, "orders_after"), "orders")).select("column_name", "finding")


@query(with_views("SELECT 'ROW_COUNT_DRIFT' AS status, (SELECT count(*) FROM orders) AS before_rows, (SELECT count(*) FROM orders_after) AS after_rows", "orders_after"))
def i3_compare_results(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    return D.compare_results(table(spark, sf, "orders").select(*cols), view(spark, sf, "orders_after").select(*cols))


def _suite(df: DataFrame, spark: SparkSession, sf: str, suffix: str = "") -> DataFrame:
    return D.probe_suite(df, "orders", ["o_orderstatus"], ["o_totalprice"], None, [("o_orderkey", table(spark, sf, "lineitem"), "l_orderkey")])


_SUITE = """SELECT 'orders.rows' AS probe, '' AS key, 'n' AS metric, count(*)::DOUBLE AS value FROM {t} UNION ALL
 SELECT 'orders.non_null', '', 'o_orderkey', count(o_orderkey)::DOUBLE FROM {t} UNION ALL SELECT 'orders.non_null', '', 'o_orderstatus', count(o_orderstatus)::DOUBLE FROM {t} UNION ALL SELECT 'orders.non_null', '', 'o_totalprice', count(o_totalprice)::DOUBLE FROM {t} UNION ALL
 SELECT 'orders.top.o_orderstatus', coalesce(o_orderstatus, '<null>'), 'n', count(*)::DOUBLE FROM {t} GROUP BY 2 UNION ALL
 SELECT 'orders.stats.o_totalprice', '', unnest(['n','sum','min','max']), unnest([count(o_totalprice)::DOUBLE, sum(o_totalprice::DECIMAL(18,4))::DOUBLE, min(o_totalprice), max(o_totalprice)]) FROM {t} UNION ALL
 SELECT 'orders.orphans.o_orderkey', '', 'n', count(*)::DOUBLE FROM {t} WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""


@query(with_views(_SUITE.format(t="orders_after"), "orders_after"))
def i1_probe_suite(spark: SparkSession, sf: str) -> DataFrame:
    return _suite(view(spark, sf, "orders_after"), spark, sf)


@query("""SELECT 'orders.o_orderpriority.filled' AS probe, '' AS key, unnest(['non_null','total','distinct']) AS metric, unnest([count(o_orderpriority)::DOUBLE, count(*)::DOUBLE, count(DISTINCT o_orderpriority)::DOUBLE]) AS value FROM orders UNION ALL
 SELECT 'orders.o_orderpriority.top', o_orderpriority, 'n', count(*)::DOUBLE FROM orders GROUP BY 2 UNION ALL
 SELECT 'orders.daily30', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 'n', count(*)::DOUBLE FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-06-01' - 30 AND CAST(o_orderdate AS DATE) <= DATE '1997-06-01' GROUP BY 2 UNION ALL
 SELECT 'orders.last7', '', 'n', nullif(count(*), 0)::DOUBLE FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-06-01' - 7 AND CAST(o_orderdate AS DATE) <= DATE '1997-06-01' HAVING count(*) > 0 UNION ALL
 SELECT 'orders.metric14', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 'sum', sum(o_totalprice::DECIMAL(18,4))::DOUBLE FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1997-06-01' - 14 AND CAST(o_orderdate AS DATE) <= DATE '1997-06-01' GROUP BY 2 UNION ALL
 SELECT 'orders.by_status', o_orderstatus, 'sum', sum(o_totalprice::DECIMAL(18,4))::DOUBLE FROM orders GROUP BY 2""")
def i2_forward_probes(spark: SparkSession, sf: str) -> DataFrame:
    return D.forward_probes(table(spark, sf, "orders"), "o_orderpriority", "orders", "1997-06-01", "o_orderdate", "o_totalprice", "o_orderstatus")


def _replay(spark: SparkSession, sf: str) -> DataFrame:
    return D.run_replay(_suite(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), spark, sf), _suite(view(spark, sf, "orders_after"), spark, sf))


_REPLAY = f"""b AS ({_SUITE.format(t='orders')}), a AS ({_SUITE.format(t='orders_after')}), j AS (SELECT coalesce(b.probe, a.probe) AS probe, b.probe IS NULL OR a.probe IS NULL OR a.value IS DISTINCT FROM b.value AS bad FROM b FULL JOIN a ON a.probe = b.probe AND a.key = b.key AND a.metric = b.metric)"""


@query(with_views("WITH " + _REPLAY + " SELECT probe, count(*) AS compared, count(*) FILTER (bad) AS differing, count(*) FILTER (bad) = 0 AS passed FROM j GROUP BY 1", "orders_after"))
def i4_run_replay(spark: SparkSession, sf: str) -> DataFrame:
    return _replay(spark, sf)


@query(with_views("WITH " + _REPLAY + ", r AS (SELECT probe, count(*) FILTER (bad) = 0 AS passed FROM j GROUP BY 1) SELECT count(*) AS queries, count(*) FILTER (passed) AS passed, avg(passed::INT) AS pass_rate, CASE WHEN avg(passed::INT) = 1 THEN 'SAFE' WHEN avg(passed::INT) >= 0.95 THEN 'SAFE_WITH_PATCHES' ELSE 'BLOCKED' END AS verdict FROM r", "orders_after"))
def d35_replay_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return D.replay_verdict(_replay(spark, sf))


_FIRST = "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders WHERE o_orderstatus = 'F') WHERE r <= ceil(n * 0.15)"


@query(_FIRST)
def b8_first_k_by_key(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.where(P.first_k_by_key(o, "o_orderkey", 0.15, F.col("o_orderstatus") == "F")).select("o_orderkey")


@query("""WITH n AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders),
 d AS (SELECT o_orderstatus AS v FROM orders GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1)
 SELECT o_orderkey, CASE WHEN r > ceil(n * 0.15) THEN o_orderpriority END AS nulled, CASE WHEN r <= ceil(n * 0.15) THEN '' ELSE o_orderpriority END AS blanked, CASE WHEN r <= ceil(n * 0.05) THEN 'NEW' ELSE o_orderstatus END AS expanded,
 CASE WHEN r <= ceil(n * 0.15) THEN (SELECT v FROM d) ELSE o_orderstatus END AS skewed, CASE WHEN r <= ceil(n * 0.15) THEN o_orderdate - INTERVAL 7 DAY ELSE o_orderdate END AS moved FROM n""")
def b9_perturbations(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    o = o.withColumns({"nulled": F.col("o_orderpriority"), "blanked": F.col("o_orderpriority"), "expanded": F.col("o_orderstatus"), "skewed": F.col("o_orderstatus"), "moved": F.col("o_orderdate")})
    out = P.null_flood(o, "nulled", "o_orderkey")
    out = P.blank_flood(out, "blanked", "o_orderkey")
    out = P.domain_expand(out, "expanded", "o_orderkey", "NEW")
    out = P.time_shift(P.key_skew(out, "skewed", "o_orderkey"), "moved", "o_orderkey")
    return out.select("o_orderkey", "nulled", "blanked", "expanded", "skewed", "moved")


@query("SELECT count(*) + 9 * ceil(count(*) * 0.05)::BIGINT AS row_count, 9 * ceil(count(*) * 0.05)::BIGINT AS keyless FROM orders")
def b9_volume_spike(spark: SparkSession, sf: str) -> DataFrame:
    return P.volume_spike(table(spark, sf, "orders"), "o_orderkey").agg(F.count("*").alias("row_count"), F.count_if(F.col("o_orderkey").isNull()).alias("keyless"))


