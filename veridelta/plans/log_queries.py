"""Queries over query logs, texts, vectors, contracts and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import assumptions as A
from ..operators import checks as C
from ..operators import contracts as K
from ..operators import matching as M
from ..operators import workload as L
from ..sources import readers as R
from ..streaming import jobs as J
from .file_queries import scratch
from .registry import query, table
from .views import view, with_views


def history(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "history")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return history(spark, sf).withColumn("query_id", F.col("run_id")).withColumn("source", F.concat(F.lit("history:"), "engine")).withColumn("calls", F.col("run_id") % 150)


@query(with_views("""WITH h AS (SELECT *, run_id * 1000 AS bytes, CASE WHEN run_id % 4 = 0 THEN run_id % 7 END AS credits FROM history), r AS (SELECT engine, runtime_seconds, cost_usd, bytes, credits, unnest(list_distinct([model_name, 'mart.' || model_name])) AS key FROM h UNION ALL SELECT engine, runtime_seconds, cost_usd, bytes, credits, unnest(['dim.nation', 'nation']) FROM h WHERE run_id % 2 = 0),
 g AS (SELECT key, count(*) AS runs, sum(runtime_seconds::DECIMAL(18,4))::DOUBLE / count(*) AS avg_runtime, sum(cost_usd::DECIMAL(18,4))::DOUBLE / count(cost_usd) AS avg_cost, sum(bytes::DECIMAL(18,4))::DOUBLE / count(*) AS avg_bytes, sum(credits)::DOUBLE / count(credits) AS avg_credits FROM r GROUP BY 1),
 e AS (SELECT key, engine FROM (SELECT key, engine, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, engine) AS k FROM r GROUP BY key, engine) WHERE k = 1),
 p AS (SELECT key, runtime_seconds AS p95_runtime FROM (SELECT key, runtime_seconds, row_number() OVER (PARTITION BY key ORDER BY runtime_seconds) AS i, count(*) OVER (PARTITION BY key) AS n FROM r) WHERE i - 1 = least(n - 1, round_even((n - 1) * 0.95, 0)))
 SELECT key, runs, avg_runtime, avg_cost, avg_bytes, avg_credits, engine, p95_runtime, CASE WHEN runs >= 10 THEN 'high' WHEN runs >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM g JOIN e USING (key) JOIN p USING (key)""", "history"))
def d15_history_profile(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("run_id")
    return L.history_profile(history(spark, sf).withColumns({"bytes_scanned": n * 1000, "credits_used": F.when(n % 4 == 0, n % 7)}))


@query(with_views("SELECT model_name, runtime_seconds AS percentile FROM (SELECT model_name, runtime_seconds, row_number() OVER (PARTITION BY model_name ORDER BY runtime_seconds) AS i, count(*) OVER (PARTITION BY model_name) AS n FROM history) WHERE i - 1 = least(n - 1, round_even((n - 1) * 0.95, 0))", "history"))
def g4_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return L.nearest_rank(history(spark, sf), ["model_name"], "runtime_seconds")


@query(with_views("SELECT min(run_id) AS query_id, query_text FROM history GROUP BY query_text", "history"))
def b6_sanitize_workload(spark: SparkSession, sf: str) -> DataFrame:
    return L.sanitize_workload(queries(spark, sf)).select("query_id", "query_text")


@query(with_views("SELECT run_id, 'mart.' || model_name || CASE WHEN run_id % 2 = 0 THEN ',dim.nation' ELSE '' END AS tables, CASE WHEN run_id % 2 = 0 THEN 1 ELSE 0 END AS join_count, run_id % 2 = 0 AS is_aggregate FROM history", "history"))
def g17_query_assets(spark: SparkSession, sf: str) -> DataFrame:
    return L.query_assets(history(spark, sf)).select("run_id", F.array_join("tables", ",").alias("tables"), "join_count", "is_aggregate")


#: A text for each remainder of the run, and the signals it shows with the cost of a run.
_TEXTS = [
    ("select * from a", {"SELECT_STAR": 21.0}),
    ("select x.id from a x cross join b", {"CARTESIAN_JOIN": 55.0}),
    ("select a.id from a join b on a.i = b.i join c on a.i = c.i join d on a.i = d.i join e on a.i = e.i where a.i > 0", {"FANOUT_JOIN": 22.0}),
    ("select count(1) from a group by b", {"UNBOUNDED_AGGREGATION": 14.0}),
    ("create or replace table t as select id from a where id > 0", {"FULL_REFRESH_PATH": 42.0}),
    ("select id from {{ ref('a') }} where id > 0", {"MISSING_INCREMENTAL_FILTER": 28.0}),
    ("select v from a, unnest(a.vs) v", {"UNBOUNDED_FLATTEN": 20.0}),
    ("select row_number() over () from a", {"UNPARTITIONED_WINDOW": 16.0}),
    ("merge into t using s on t.i = s.i when matched then update when not matched then insert", {"UNBOUNDED_MERGE": 38.0, "MISSING_INCREMENTAL_FILTER": 28.0}),
    ("select a from x union all select a from y union all select a from z", {"UNION_ALL_FANIN": 22.0}),
    ("with a as (select 1), b as (select 2), c as (select 3), d as (select 4), e as (select 5) select 1 from e", {"DEEP_CTE_STACK": 29.5}),
    ("select distinct a.id from a join b on a.i = b.i where a.id > 0", {"JOIN_THEN_DEDUP": 24.0}),
    ("select id from a tablesample (5 percent)", {"EXPENSIVE_SAMPLING": 18.0}),
    ("select regexp_extract(a.s, 'x') from a join b on a.i = b.i join c on a.i = c.i where a.i > 0", {"HEAVY_REGEX_PIPELINE": 16.0}),
    ("select id from a where id > 0", {}),
]
_SHOWN = ", ".join(f"({i}, '{k}', {c}, '{L.LINT[k][0]}')" for i, (_, signals) in enumerate(_TEXTS) for k, c in signals.items())
_LINTED = f"SELECT run_id, engine, signal, cost, severity FROM history JOIN (VALUES {_SHOWN}) v(r, signal, cost, severity) ON r = run_id % {len(_TEXTS)}"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(t) for t, _ in _TEXTS]), (F.col("run_id") % len(_TEXTS) + 1).cast("int"))
    return history(spark, sf).select(F.col("run_id").alias("query_id"), "engine", text.alias("query_text"))


@query(with_views(f"SELECT run_id AS query_id, signal, severity, cost::DOUBLE AS run_cost, cost::DOUBLE * 7 AS weekly_cost FROM ({_LINTED})", "history"))
def g13_sql_lint(spark: SparkSession, sf: str) -> DataFrame:
    return L.sql_lint(_texts(spark, sf))


@query(with_views(f"SELECT *, round(weekly_cost * 4.3, 2)::DOUBLE AS monthly_cost, round(weekly_cost::DOUBLE / 0.55, 2) AS dbu, round(weekly_cost::DOUBLE * 2 / 7, 2) AS weekend_cost FROM (SELECT engine, count(*) AS signals, sum(cost)::DECIMAL(18,2) AS run_cost, (sum(cost) * 7)::DECIMAL(18,2) AS weekly_cost, CASE WHEN bool_or(severity = 'high') THEN 'high' ELSE 'medium' END AS confidence FROM ({_LINTED}) GROUP BY 1)", "history"))
def d36_finops_rollup(spark: SparkSession, sf: str) -> DataFrame:
    q = _texts(spark, sf)
    return L.finops_rollup(L.sql_lint(q).join(q.select("query_id", "engine"), "query_id"), ["engine"])


#: A model's text for each order, in twelve forms.
_MODELS = """SELECT o_orderkey AS query_id, o_orderkey % 24 < 12 AS keyed, CASE o_orderkey % 12
 WHEN 0 THEN concat('select date_trunc(''month'', o.created_at) as m, sum(x) from orders o join lines l on o.id = l.order_id where o.status in (''paid'', ''v', CAST(o_custkey % 5 AS VARCHAR(20)), ''') group by 1')
 WHEN 1 THEN 'select cast(o.updated_at as date) as d, coalesce(o.amount, 0) as a from orders o where o.kind = ''web'' and o.note is not null'
 WHEN 2 THEN 'select * from orders where is_incremental() and date(loaded_at) > current_date - interval 3 day or region is null'
 WHEN 3 THEN 'merge into orders using (select id, status from raw where id > 3) on id = raw.id'
 WHEN 4 THEN concat('create or replace table t', CAST(o_custkey % 9 AS VARCHAR(20)), ' as select case when o.status = ''x'' then 1 end as f, row_number() over (partition by id order by created_at) as r from orders o')
 WHEN 5 THEN 'config(materialized=''table'') select nvl(amount, ''unknown'') as a, case when order_type = 1 then 2 else 3 end as k from orders'
 WHEN 6 THEN 'config(materialized=''incremental'') select convert_timezone(''utc'', event_time) as e, cast(event_time as timestamp) as u from events where event_time > 5'
 WHEN 7 THEN 'config(materialized=''view'') select ifnull(amount, other) as a from orders join lines on orders.id = lines.order_id'
 WHEN 8 THEN 'select timestamp_trunc(created_at, week) as w, count(*) as n from orders group by 1'
 WHEN 9 THEN 'select distinct o.id from orders o join lines l on o.id = l.order_id join parts p on l.part_id = p.id'
 WHEN 10 THEN 'delete from orders where amount is null and to_date(event_date) < ''2020''' ELSE NULL END AS query_text FROM {orders}"""
_TOKENS_OF = r"""regexp_extract_all(lower(coalesce(query_text, '')), '''[^'']*''|"[^"]*"|[a-z_][a-z0-9_.]*|[0-9]+(?:\.[0-9]+)?|[^\s\w]')"""
_REST = "list_slice(tk, i + {k}, i + {k} - 1 + coalesce(nullif(list_position(list_transform(list_slice(tk, i + {k}, len(tk)), lambda x: list_contains({stops}, x)), true), 0) - 1, len(tk)))"
_ARGS, _BLOCK, _CLAUSE = _REST.format(k=2, stops="[')']"), _REST.format(k=1, stops="['end']"), _REST.format(k=1, stops="['join', 'where', 'group', 'order', 'limit']")
_BARE = "trim({x}, '''\"')"
_DOMAIN = "regexp_matches({x}, '^[a-z_]') AND regexp_extract({x}, '([a-z]+)$', 1) IN ('category', 'code', 'kind', 'state', 'status', 'type')"
_CUT = f"(w IN ('date_trunc', 'timestamp_trunc', 'date') OR list_contains({_ARGS}, 'date'))"
_ASSUMED = f"""WITH q AS ({_MODELS.replace('{orders}', 'orders')}), t AS (SELECT query_id, keyed, {_TOKENS_OF} AS tk FROM q),
 z AS (SELECT *, list_has_any(tk, ['convert_timezone', 'timezone']) AS zoned, list_has_any(tk, ['avg', 'count', 'sum']) AS summed, list_has_any(tk, ['distinct', 'qualify', 'row_number']) AS dedup, coalesce(list_position(tk, 'where'), 0) AS wh FROM t),
 y AS (SELECT *, CASE WHEN wh > 0 THEN list_slice(tk, wh + 1, wh + coalesce(nullif(list_position(list_transform(list_slice(tk, wh + 1, len(tk)), lambda x: x IN ('group', 'order', 'limit')), true), 0) - 1, len(tk))) ELSE [] END AS pred FROM z),
 p AS (SELECT *, tk[i] AS w, coalesce(tk[i + 1], '') AS w1, coalesce(tk[i + 2], '') AS w2, coalesce(tk[i + 3], '') AS w3, coalesce(tk[i + 4], '') AS w4, coalesce(tk[i + 5], '') AS w5 FROM y, range(1, len(tk) + 1) r(i)),
 inc AS (SELECT query_id, arg_min(w, i) AS w, any_value(list_has_any(pred, ['cast', 'date', 'to_date', 'date_trunc', 'timestamp_trunc'])) AS wrapped, any_value(list_contains(pred, 'or')) AS widened FROM p WHERE (w = 'is_incremental' AND w1 = '(') OR (w = 'merge' AND w1 = 'into') OR (w = 'materialized' AND w1 = '=' AND {_BARE.format(x='w2')} = 'incremental') GROUP BY 1),
 found AS (SELECT query_id, 'temporal_bucket' AS family, CASE WHEN w IN ('date_trunc', 'timestamp_trunc') THEN CASE WHEN {_BARE.format(x='w2')} IN ('day', 'hour', 'month', 'week') THEN {_BARE.format(x='w2')} WHEN {_BARE.format(x='w4')} IN ('day', 'hour', 'month', 'week') THEN {_BARE.format(x='w4')} ELSE w END WHEN {_CUT} THEN 'day' ELSE w END AS detail, CASE WHEN zoned OR {_CUT} THEN 'critical' ELSE 'high' END AS severity
   FROM p WHERE w1 = '(' AND (w IN ('date_trunc', 'timestamp_trunc') OR w IN ('cast', 'date', 'to_date') AND len(list_filter({_ARGS}, lambda x: regexp_matches(x, '^[a-z_]') AND (x LIKE '%!_at' ESCAPE '!' OR x LIKE '%!_ts' ESCAPE '!' OR contains(x, 'time') OR contains(x, 'date')))) > 0)
  UNION ALL SELECT query_id, 'incremental_filter', CASE WHEN wrapped THEN 'partition_column_wrapped' WHEN widened THEN 'or_expansion' ELSE w END, CASE WHEN wrapped OR widened THEN 'high' ELSE 'medium' END FROM inc
  UNION ALL SELECT query_id, 'join_cardinality', CASE WHEN dedup THEN 'dedup_hint' WHEN summed THEN 'aggregate_after_join' ELSE 'equality_join' END, CASE WHEN keyed THEN 'medium' WHEN summed THEN 'critical' ELSE 'high' END FROM p WHERE w = 'join' AND list_contains({_CLAUSE}, 'on') AND list_contains({_CLAUSE}, '=')
  UNION ALL SELECT query_id, 'enum_domain_closure', array_to_string(list_transform(list_filter(CASE WHEN w1 = 'in' THEN {_REST.format(k=3, stops="[')']")} ELSE [w2] END, lambda x: regexp_matches(x, '^[''\"]')), lambda x: {_BARE.format(x='x')}), ','), 'medium' FROM p WHERE {_DOMAIN.format(x='w')} AND ((w1 = 'in' AND w2 = '(') OR (w1 = '=' AND regexp_matches(w2, '^[''\"]')))
  UNION ALL SELECT query_id, 'enum_domain_closure', 'case_without_else', 'medium' FROM p WHERE w = 'case' AND len(list_filter({_BLOCK}, lambda x: {_DOMAIN.format(x='x')})) > 0 AND NOT list_contains({_BLOCK}, 'else')
  UNION ALL SELECT query_id, 'null_default_fallback', w4, CASE WHEN w5 = ')' AND w4 IN ('0', '0.0', 'false', '''''', '\"\"', '''none''', '''unknown''') THEN 'high' ELSE 'medium' END FROM p WHERE w IN ('coalesce', 'ifnull', 'nvl') AND w1 = '(' AND w3 = ','
  UNION ALL SELECT query_id, 'null_default_fallback', 'null_test', 'medium' FROM p WHERE w1 = 'is' AND (w2 = 'null' OR w2 = 'not' AND w3 = 'null')
  UNION ALL SELECT query_id, 'materialization_cost', CASE WHEN w = 'materialized' THEN {_BARE.format(x='w2')} ELSE 'rebuilt' END, CASE WHEN w <> 'materialized' OR {_BARE.format(x='w2')} = 'table' THEN 'critical' ELSE 'high' END FROM p WHERE (w = 'create' AND w1 = 'or' AND w2 = 'replace' AND w3 = 'table') OR w = 'full_refresh' OR (w = 'materialized' AND w1 IN ('=', ':') AND {_BARE.format(x='w2')} IN ('table', 'view', 'incremental')))"""


def _models(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_MODELS, orders=table(spark, sf, "orders"))


_LOW = "' ' || lower(trim(regexp_replace(query_text, '\\s+', ' ', 'g'))) || ' '"
_N = "len(regexp_extract_all(low, '{p}'))"
_COMPLEX = f"""WITH q AS ({_MODELS.replace('{orders}', 'orders')}), l AS (SELECT query_id, {_LOW} AS low FROM q),
 c AS (SELECT *, {_N.format(p=' join ')} * 12 + {_N.format(p=' group by ')} * 6 + {_N.format(p=' order by ')} * 4 + CASE WHEN contains(low, ' distinct ') THEN 5 ELSE 0 END + {_N.format(p=' over [(]')} * 8 + CASE WHEN contains(low, ' union ') THEN 5 ELSE 0 END + CASE WHEN regexp_matches(low, '(sum|avg|count|min|max)[(]') THEN 4 ELSE 0 END AS complexity FROM l)"""
_HAS = {
    "select[ ]+[*]": 0.03, "group by|order by": 0.015, "distinct ": 0.01, "over [(]": 0.015, "full_refresh|--full-refresh|create or replace table": 0.08, "cross join": 0.09,
}
_COSTED = _COMPLEX + f""", r AS (SELECT *, 0.02::DOUBLE + greatest(0, complexity) * 0.004::DOUBLE + {_N.format(p=' join ')} * 0.02::DOUBLE + {' + '.join(f"CASE WHEN regexp_matches(low, '{p}') THEN {v}::DOUBLE ELSE 0 END" for p, v in _HAS.items())} + CASE WHEN contains(low, 'merge into') AND NOT contains(low, 'where') THEN 0.05::DOUBLE ELSE 0 END
  + CASE WHEN contains(low, 'join') AND contains(low, 'distinct') THEN 0.025::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(low, 'row_number[(][)]|qualify ') AND NOT contains(low, 'partition by') THEN 0.025::DOUBLE ELSE 0 END AS run, log10(greatest(1, query_id % 1000) + 1) AS logs FROM c)"""


@query(_COMPLEX + " SELECT query_id, complexity FROM c")
def g12_query_complexity(spark: SparkSession, sf: str) -> DataFrame:
    return _models(spark, sf).select("query_id", L.query_complexity(F.col("query_text")).alias("complexity"))


@query(_COSTED + " SELECT query_id, round(run, 4) AS run_cost, round(run * CASE WHEN query_id % 2 = 0 THEN least(80, logs * 16 + 1) ELSE least(8, logs * 4 + 1) END * 7, 2) AS weekly_cost FROM r")
def g11_query_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Every second text's calls are known from history."""
    cost = L.query_cost(F.col("query_text"), L.query_complexity(F.col("query_text")), F.col("query_id") % 1000, F.col("query_id") % 2 == 0)
    return _models(spark, sf).select("query_id", cost.alias("c")).select("query_id", "c.run_cost", "c.weekly_cost")


@query(_ASSUMED + " SELECT query_id, family, detail, severity FROM found")
def g14_assumption_scan(spark: SparkSession, sf: str) -> DataFrame:
    return A.assumption_scan(_models(spark, sf), unique="keyed")


_FIELDS = ["status", "created_at", "updated_at", "amount", "id", "order_id", "event_time", "event_date", "order_type", "region"]
_NEAR = "list_slice(tk, greatest(1, i - 12), i + 12)"
_KINDS = {
    "GRAIN_OR_DEDUP": "CASE WHEN list_contains(s, 'row_number') THEN 0.9 WHEN list_has_any(s, ['group', 'distinct', 'qualify']) THEN 0.84 END",
    "INCREMENTAL_STATE": "CASE WHEN list_has_any(s, ['backfill', 'delete', 'incremental', 'is_incremental', 'merge']) THEN 0.86 END",
    "TEMPORAL_COMPLETENESS": "CASE WHEN list_has_any(s, ['business_date', 'event_date', 'event_time', 'freshness', 'late', 'watermark']) THEN 0.8 END",
    "FRESHNESS_WINDOW": "CASE WHEN list_has_any(s, ['current_date', 'current_timestamp', 'date_sub', 'dateadd', 'interval', 'now']) THEN 0.82 END",
    "STATUS_MAPPING": "CASE WHEN list_contains(s, 'case') AND list_contains(s, 'when') THEN 0.84 END",
    "DOMAIN_FILTER": "CASE WHEN (w1 IN ('=', '<') AND (regexp_matches(w2, '^[''\"]') OR w2 = '>')) OR (w1 = 'in' AND w2 = '(') THEN 0.88 END",
    "NULL_HANDLING": "CASE WHEN v2 IN ('coalesce', 'ifnull', 'nvl') AND v1 = '(' THEN 0.86 WHEN w1 = 'is' AND w2 IN ('null', 'not') THEN 0.78 END",
    "TEMPORAL_BUCKETING": "CASE WHEN list_has_any(b4, ['date_trunc', 'timestamp_trunc', 'cast', 'date', 'to_date', 'extract']) THEN 0.91 WHEN list_contains(b8, 'over') THEN 0.79 END",
    "JOIN_CARDINALITY": "CASE WHEN list_contains(b8, 'on') AND ((w1 = '=' AND regexp_matches(w2, '^[a-z_]')) OR (v1 = '=' AND regexp_matches(v2, '^[a-z_]'))) THEN 0.9 END",
}


@query(_ASSUMED + f""", o AS (SELECT query_id, split_part(w, '.', -1) AS name, w1, w2, CASE WHEN i > 1 THEN tk[i - 1] ELSE '' END AS v1, CASE WHEN i > 2 THEN tk[i - 2] ELSE '' END AS v2, {_NEAR} AS s, list_slice(tk, greatest(1, i - 4), i - 1) AS b4, list_slice(tk, greatest(1, i - 8), i - 1) AS b8 FROM p WHERE split_part(w, '.', -1) IN ({', '.join(f"'{f}'" for f in _FIELDS)}))
 SELECT query_id, name, kind, max(confidence)::DOUBLE AS confidence FROM (""" + " UNION ALL ".join(f"SELECT query_id, name, '{k}' AS kind, {c} AS confidence FROM o" for k, c in _KINDS.items()) + ") WHERE confidence IS NOT NULL GROUP BY ALL")
def g14_field_assumptions(spark: SparkSession, sf: str) -> DataFrame:
    return A.field_assumptions(_models(spark, sf), spark.createDataFrame([(f,) for f in _FIELDS], "name string"))


@query(with_views("SELECT run_id AS query_id, p AS priority FROM (SELECT run_id, (CASE WHEN query_text LIKE '%mart.model_7%' THEN 18 ELSE 0 END + 10 + CASE WHEN run_id % 2 = 0 THEN 6 + 5 ELSE 0 END + 10 + CASE WHEN run_id % 150 = 0 THEN 0 WHEN run_id % 150 > 100 THEN 12 WHEN run_id % 150 > 10 THEN 8 ELSE 4 END)::DOUBLE AS p FROM history) ORDER BY p DESC, query_id LIMIT 20", "history"))
def f4_rank_workload(spark: SparkSession, sf: str) -> DataFrame:
    return L.rank_workload(queries(spark, sf), ["mart.model_7"], 20).select("query_id", "priority")


@query(with_views("SELECT run_id AS query_id, 18 AS score FROM history WHERE run_id % 2 = 0 ORDER BY query_id LIMIT 6", "history"))
def f5_top_expensive(spark: SparkSession, sf: str) -> DataFrame:
    return L.top_expensive(queries(spark, sf).withColumn("score", L.query_complexity(F.col("query_text")))).select("query_id", "score")


@query(with_views("SELECT 20 AS selected, 20 AS hits, count(*) AS candidates, count(*) - 20 AS deferred, 1.0::DOUBLE AS hit_rate, 100.0 * (count(*) - 20) / count(*) AS saved_pct FROM history", "history"))
def d34_workload_budget(spark: SparkSession, sf: str) -> DataFrame:
    q = queries(spark, sf)
    return L.workload_budget(L.rank_workload(q, ["mart.model_7"], 20).withColumn("focus_hit", F.contains("query_text", F.lit("model_7"))), q)


@query(with_views("SELECT 'model_1' AS resource_id, 'model_1' AS key FROM (SELECT count(*) FROM history) UNION ALL SELECT 'r2', 'dim.nation' UNION ALL SELECT 'r3', NULL", "history"))
def c12_history_for_resource(spark: SparkSession, sf: str) -> DataFrame:
    res = spark.createDataFrame([("model_1", "model_1", None), ("r2", "warehouse.dim.nation", None), ("r3", "x", None)], "resource_id string, a string, b string")
    return L.history_for_resource(res, L.history_profile(history(spark, sf)), ["a", "b"])


@query(with_views("SELECT run_id, CASE engine WHEN 'snowflake' THEN 'snowflake' ELSE 'dbt' END AS engine, runtime_seconds::DOUBLE AS number FROM history", "history"))
def b1_b3_aliases_numbers_engine(spark: SparkSession, sf: str) -> DataFrame:
    h = history(spark, sf)
    raw = h.select(F.col("run_id").cast("string").alias("id"), F.lit("").alias("query_id"), F.format_number("runtime_seconds", 2).alias("duration"), F.when(F.col("engine") == "snowflake", "1").alias("credits"))
    out = L.coalesce_aliases(raw, {"run_id": ["query_id", "id"], "number": ["duration"], "credits_used": ["credits"]})
    return out.select(F.col("run_id").cast("long").alias("run_id"), L.infer_engine(out).alias("engine"), L.to_number(F.col("number")).alias("number"))


@query(with_views("SELECT run_id AS query_id FROM history WHERE run_id % 3 <> 0 AND run_id <= 5000 ORDER BY run_id DESC LIMIT 50", "history"))
def a5_warehouse_log(spark: SparkSession, sf: str) -> DataFrame:
    log = queries(spark, sf).select("query_id", "query_text", F.when(F.col("run_id") % 3 == 0, "failed").otherwise("SUCCESS").alias("status"), F.timestamp_seconds(F.col("run_id") * 60).alias("started_at"))
    return L.warehouse_log(log, F.timestamp_seconds(F.lit(300_000)), 30, 50).select("query_id")


@query("""WITH a AS (SELECT DISTINCT lower(regexp_extract(text, '^[^ ]+')) AS asset FROM benchmark), t AS (SELECT doc_id AS text_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_.]+'))) AS token FROM documents) SELECT asset, count(*) AS n FROM t JOIN a ON token = asset GROUP BY 1""")
def c14_reference_search(spark: SparkSession, sf: str) -> DataFrame:
    assets = table(spark, sf, "benchmark").select(F.lower(F.regexp_extract("text", "^[^ ]+", 0)).alias("asset")).distinct()
    found = L.reference_search(table(spark, sf, "documents").select(F.col("doc_id").alias("text_id"), "text"), assets)
    return found.groupBy("asset").agg(F.count("*").alias("n"))


@query(with_views("SELECT DISTINCT 'model_' || c AS parent, 'child' AS child, 'id' AS \"column\" FROM (SELECT o_custkey % 50 AS c FROM orders)", "history"))
def c21_downstream_column_refs(spark: SparkSession, sf: str) -> DataFrame:
    m = history(spark, sf).select("model_name").distinct()
    texts = m.select(F.lit("child").alias("model"), F.concat(F.lit("select "), "model_name", F.lit(".id from "), "model_name").alias("text"))
    return L.downstream_column_refs(texts, m.select(F.col("model_name").alias("source"), F.lit("child").alias("target")))


@query("SELECT event_type AS family, round(max((event_id % 10) / 10.0 * 0.5 * 0.8), 4)::DOUBLE AS specificity FROM events WHERE event_type <> 'view' GROUP BY 1")
def d38_family_specificity(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", (F.col("event_id") % 10 / 10).alias("fidelity"), F.lit(0.5).alias("confidence"))
    w = e.select("event_type").distinct().where("event_type <> 'view'").select("event_type", F.col("event_type").alias("family"), F.lit(0.8).alias("weight"))
    return L.family_specificity(e, w)


@query("SELECT p_brand AS model, count(*) * 2 AS tests, 0 AS domains, 0 AS relations FROM part GROUP BY 1")
def d39_dependency_contracts(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_brand").alias("model"), F.concat(F.lit("c"), "p_partkey").alias("column"))
    tests = p.withColumn("test", F.explode(F.array(F.lit("unique"), F.lit("not_null"))))
    return L.dependency_contracts(p.select("model").distinct(), tests).select("model", "tests", "domains", "relations")


@query("SELECT o_orderkey AS query_id, round((o_totalprice / 1024 * 18) * 2, 3) AS extra FROM orders")
def g10_cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit("m").alias("model"), F.col("o_totalprice").alias("gigabytes"), F.lit("databricks").alias("engine"), F.lit("temporal_bucket").alias("family"), F.lit(30).alias("runs_per_month"))
    none = spark.createDataFrame([], "key string, avg_cost double")
    return L.cost_estimate(d, none).select("query_id", F.round("extra_run_cost", 3).alias("extra"))


@query("SELECT p_partkey, CASE WHEN length(p_name) = 0 AND length(p_type) = 0 THEN 1.0 ELSE round(1 - levenshtein(lower(p_name), lower(p_type))::DOUBLE / greatest(length(p_name), length(p_type)), 9) END AS ratio FROM part")
def g3_edit_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.round(M.edit_ratio(F.col("p_name"), F.col("p_type")), 9).alias("ratio"))


@query("""WITH t AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[_\\-\\s]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(p_type), '[_\\-\\s]+'), lambda x: x <> '')) AS b FROM part) SELECT p_partkey, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS similarity FROM t""")
def g1_g2_g6_name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    low = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("a"), F.lower("p_type").alias("b"))
    return low.select("p_partkey", M.rename_similarity(F.col("a"), F.col("b")).alias("similarity"))


@query("WITH c AS (SELECT a.vec_id AS src_id, b.vec_id AS tgt_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) SELECT src_id, tgt_id, round(cosine, 6) AS cosine, round(exp(cosine) / sum(exp(cosine)) OVER (PARTITION BY src_id), 8) AS share FROM c")
def e1_embedding_softmax(spark: SparkSession, sf: str) -> DataFrame:
    """Every row whose id is divisible by 50, against all rows."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return M.embedding_softmax(v.where("id % 50 = 0"), v).select("src_id", "tgt_id", F.round("cosine", 6).alias("cosine"), F.round("share", 8).alias("share"))


#: Two catalogs of columns, of suppliers and of customers; those whose number is an embedding's have its vector.
_MATCH = {
    "supplier": """SELECT concat(CASE s_suppkey % 5 WHEN 0 THEN 'order' WHEN 1 THEN 'customer' WHEN 2 THEN 'line' WHEN 3 THEN 'part' ELSE 'region' END, '_', CASE s_suppkey % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'status' WHEN 2 THEN 'createdAt' ELSE 'total' END, '_', CAST(s_suppkey AS VARCHAR(20))) AS name,
      CASE s_suppkey % 3 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'STRING' ELSE 'FLOAT' END AS family, s_suppkey % 2 = 0 AS nullable, s_suppkey % 10 = 0 AS is_key, CAST(s_suppkey % 100 AS DOUBLE) / 100 AS cardinality, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('nation_', CAST(s_nationkey AS VARCHAR(20))) END AS refs, s_suppkey AS vec_id FROM {supplier}""",
    "customer": """SELECT concat(CASE c_custkey % 5 WHEN 0 THEN 'orders' WHEN 1 THEN 'customer' WHEN 2 THEN 'line' WHEN 3 THEN 'parts' ELSE 'region' END, '_', CASE c_custkey % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'state' WHEN 2 THEN 'created_at' ELSE 'total' END, '_', CAST(c_custkey AS VARCHAR(20))) AS name,
      CASE c_custkey % 3 WHEN 0 THEN 'INTEGER' WHEN 1 THEN 'STRING' ELSE 'FLOAT' END AS family, c_custkey % 2 = 0 AS nullable, c_custkey % 10 = 0 AS is_key, CAST(c_custkey % 100 AS DOUBLE) / 100 AS cardinality, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN concat('nation_', CAST(c_nationkey AS VARCHAR(20)), '|region') ELSE concat('nation_', CAST(c_nationkey AS VARCHAR(20))) END AS refs, c_custkey + 1 AS vec_id FROM {customer}""",
}
_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace({x}.name, '([a-z])([A-Z])', '\\1_\\2', 'g')), '[_\\-\\s]+'), lambda t: t <> ''))"
_JACCARD = "len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"
_MATCHED = f"""WITH src AS ({_MATCH['supplier'].format(supplier='supplier')}), tgt AS ({_MATCH['customer'].format(customer='customer')}),
 s AS (SELECT src.*, embedding::DOUBLE[] AS vec, {_TOKENS.format(x='src')} AS tok, coalesce(string_split(refs, '|'), []) AS rs FROM src LEFT JOIN embeddings USING (vec_id)), t AS (SELECT tgt.*, embedding::DOUBLE[] AS vec, {_TOKENS.format(x='tgt')} AS tok, coalesce(string_split(refs, '|'), []) AS rs FROM tgt LEFT JOIN embeddings USING (vec_id)),
 p AS (SELECT s.name AS source, t.name AS target, 0.2::DOUBLE * (0.5 * {_JACCARD.format(a='s.tok', b='t.tok')} + 0.5 * (1 - levenshtein(lower(s.name), lower(t.name))::DOUBLE / greatest(length(s.name), length(t.name))))
  + 0.25::DOUBLE * (CASE WHEN s.family = t.family THEN 0.4 ELSE 0 END + CASE WHEN s.nullable = t.nullable THEN 0.2 ELSE 0 END + CASE WHEN s.is_key = t.is_key THEN 0.2 ELSE 0 END + 0.2 * (1 - abs(s.cardinality - t.cardinality)))
  + 0.2::DOUBLE * CASE WHEN len(s.rs) = 0 AND len(t.rs) = 0 THEN 0.5 ELSE {_JACCARD.format(a='s.rs', b='t.rs')} END + 0.35::DOUBLE * CASE WHEN s.vec IS NULL OR t.vec IS NULL THEN 0.5 ELSE list_cosine_similarity(s.vec, t.vec) END AS confidence FROM s, t),
 m AS (SELECT source, target, confidence, CASE WHEN confidence >= 0.8 THEN 'auto' WHEN confidence >= 0.5 THEN 'review' ELSE 'unmapped' END AS decision FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY round(confidence, 9) DESC, target) = 1)"""


def _catalog(spark: SparkSession, sf: str, name: str) -> DataFrame:
    c = spark.sql(_MATCH[name], **{name: table(spark, sf, name)}).withColumn("refs", F.split("refs", r"\|"))
    return c.join(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec")), "vec_id", "left")


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    return M.match_columns(_catalog(spark, sf, "supplier"), _catalog(spark, sf, "customer"))


@query(_MATCHED + " SELECT source, target, round(confidence, 6) AS confidence, decision FROM m")
def c13_g5_match_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf).withColumn("confidence", F.round("confidence", 6))


@query()
def c13_match_by_planes(spark: SparkSession, sf: str) -> DataFrame:
    """The same from candidates only; a test measures how many of the matches above it finds."""
    return M.match_columns(_catalog(spark, sf, "supplier"), _catalog(spark, sf, "customer"), M.Planes())


@query(_MATCHED + " SELECT name FROM tgt WHERE name NOT IN (SELECT target FROM m WHERE decision <> 'unmapped')")
def f7_unmapped_targets(spark: SparkSession, sf: str) -> DataFrame:
    return M.unmapped_targets(_matches(spark, sf), _catalog(spark, sf, "customer"))


_FAR = "list_distance({a}::DOUBLE[], {b}::DOUBLE[])"


@query(f"""WITH b AS (SELECT vec_id, embedding::DOUBLE[] AS v, [label * 3, label * 3 + 1] AS refs FROM embeddings),
 a AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN vec_id % 3 = 0 THEN x + 0.01::DOUBLE WHEN vec_id % 3 = 1 THEN x + 0.12::DOUBLE ELSE -x END) AS v, CASE WHEN vec_id % 4 = 0 THEN [label * 3] ELSE [label * 3 + 1, label * 3] END AS refs FROM b JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id) WHERE vec_id % 5 <> 0),
 deg AS (SELECT r AS vec_id, count(*) AS n FROM b, unnest(refs) u(r) GROUP BY 1), anc AS (SELECT b.v AS v, a.v AS w FROM b JOIN a USING (vec_id) JOIN deg USING (vec_id) ORDER BY n DESC, b.vec_id::VARCHAR LIMIT 10),
 j AS (SELECT b.vec_id, a.v IS NULL AS gone, list_cosine_similarity(b.v, a.v) AS c, list_sort(b.refs) = list_sort(a.refs) AS kept, (SELECT max(abs({_FAR.format(a='b.v', b='anc.v')} - {_FAR.format(a='a.v', b='anc.w')})) FROM anc) AS delta FROM b LEFT JOIN a USING (vec_id)),
 s AS (SELECT *, CASE WHEN kept THEN least(1, c + 0.08) ELSE greatest(0, c - 0.05) END AS r FROM j), k AS (SELECT vec_id, CASE WHEN NOT gone THEN greatest(0, least(1, CASE WHEN delta < 0.12 THEN r + 0.03 ELSE r - 0.03 END)) END AS score, CASE WHEN NOT gone THEN delta END AS delta FROM s)
 SELECT vec_id::VARCHAR AS id, round(score::DOUBLE, 6) AS score, round(delta, 6) AS anchor_delta, CASE WHEN score IS NULL THEN 'block' WHEN score >= 0.85 THEN 'rename' WHEN score >= 0.5 THEN 'review' ELSE 'drift' END AS verdict FROM k""")
def g18_identity_check(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumn("vec", F.col("embedding").cast("array<double>"))
    text = lambda *c: F.array(*[x.cast("string") for x in c])
    first = F.col("label") * 3
    before = e.select(F.col("vec_id").cast("string").alias("id"), "vec", text(first, first + 1).alias("refs"))
    moved = F.when(F.col("vec_id") % 3 == 0, F.transform("vec", lambda x: x + 0.01)).when(F.col("vec_id") % 3 == 1, F.transform("vec", lambda x: x + 0.12)).otherwise(F.transform("vec", lambda x: -x))
    refs = F.when(F.col("vec_id") % 4 == 0, text(first)).otherwise(text(first + 1, first))
    after = e.where("vec_id % 5 <> 0").select(F.col("vec_id").cast("string").alias("id"), moved.alias("vec"), refs.alias("refs"))
    return M.identity_check(before, after).withColumns({"score": F.round("score", 6), "anchor_delta": F.round("anchor_delta", 6)})


def _topics(spark: SparkSession, sf: str, after: bool) -> tuple[DataFrame, DataFrame]:
    """One topic per event type, and a field per nation; the second version tightens and drops some."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("topic")).distinct()
    t = e.select("topic", F.lit("ts").alias("event_time"), F.lit(5 if after else 15).alias("lateness_min"), F.lit("user_id").alias("partition_key"), F.lit(1000).cast("long").alias("retention_ms"), F.lit("FULL").alias("compatibility"), F.lit(True).alias("idempotent"))
    n = table(spark, sf, "nation")
    n = n.where("n_nationkey % 10 <> 3") if after else n
    f = e.crossJoin(F.broadcast(n)).select("topic", F.col("n_name").alias("field"), F.when(F.lit(after) & (F.col("n_nationkey") == 1), "int").otherwise("string").alias("type"), F.lit(False).alias("required"), F.array(F.lit("a"), F.lit("b")).alias("symbols"))
    return t, f


_TOPIC = "SELECT DISTINCT event_type AS topic FROM events"


@query(f"WITH t AS ({_TOPIC}) SELECT topic, 'lateness_tightened' AS finding, 'high' AS severity FROM t UNION ALL SELECT topic, 'field_removed', 'critical' FROM t, nation WHERE n_nationkey % 10 = 3 UNION ALL SELECT topic, 'field_type_changed', 'critical' FROM t")
def c16_topic_diff(spark: SparkSession, sf: str) -> DataFrame:
    (tb, fb), (ta, fa) = _topics(spark, sf, False), _topics(spark, sf, True)
    return K.topic_diff(tb, ta, fb, fa).drop("detail")


@query(f"WITH t AS ({_TOPIC}), n AS (SELECT count(*) AS gone FROM nation WHERE n_nationkey % 10 = 3) SELECT topic, gone + 2 AS findings, gone + 1 AS critical, 1 AS high, (gone + 1) * 2500 + 900 AS cost, (gone + 1) * 6.0 + 3.0 AS hours, 'BLOCK' AS verdict FROM t, n")
def d30_streaming_verdict(spark: SparkSession, sf: str) -> DataFrame:
    (tb, fb), (ta, fa) = _topics(spark, sf, False), _topics(spark, sf, True)
    return K.streaming_verdict(K.topic_diff(tb, ta, fb, fa))


@query(f"WITH t AS ({_TOPIC}) SELECT topic, 'required_field_missing' AS finding FROM t UNION ALL SELECT topic, 'type_mismatch' FROM t UNION ALL SELECT topic, 'partition_key_mismatch' FROM t")
def c15_consumer_check(spark: SparkSession, sf: str) -> DataFrame:
    t, f = _topics(spark, sf, True)
    some = table(spark, sf, "nation").where("n_nationkey = 1").select("n_name")
    c = t.crossJoin(F.broadcast(some)).select(F.lit("c").alias("consumer"), "topic", F.array(F.lit("no_such"), "n_name").alias("required_fields"), F.create_map("n_name", F.lit("string")).alias("field_types"), F.lit("other").alias("partition_key"), F.lit("ts").alias("event_time"))
    return K.consumer_check(t, f, c).select("topic", "finding")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    one = spark.read.parquet(f"{sf}/events.parquet")
    return spark.readStream.schema(one.schema).parquet(f"{sf}/events.parquet*")


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream has written once all its input is read; the folders lie where the session's checkpoints do."""
    base = scratch(spark)
    J.run_to_table(stream, f"{base}/out", f"{base}/state")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


_OPEN = "date_trunc('day', (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)"


@query(f"SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS row_count, count(*) - count(value) AS value_nulls FROM events GROUP BY 1 HAVING date_trunc('day', min(ts)) < {_OPEN}")
def j2_windowed_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, J.windowed_profile(_stream(spark, sf), "ts", "1 day", ["value"])).drop("value_distinct")


@query("SELECT date_trunc('week', ts)::TIMESTAMP AS week_start, count(*) AS runs FROM events GROUP BY 1 HAVING date_trunc('week', min(ts)) + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def j3_windowed_trends(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, J.windowed_trends(_stream(spark, sf), "ts"))


@query("SELECT count(DISTINCT (event_type, user_id)) AS n FROM events")
def j4_dedupe_drift(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, J.dedupe_drift(_stream(spark, sf), "ts", ["event_type", "user_id"], "60 days")).agg(F.count("*").alias("n"))


@query('WITH RECURSIVE n AS (SELECT key, t, min(t) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN 1800000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM (SELECT DISTINCT event_type AS key, epoch_us(ts) // 1000 AS t FROM events)), r(key, t) AS (SELECT key, min(t) FROM n GROUP BY 1 UNION ALL SELECT n.key, n.nx FROM r JOIN n ON n.key = r.key AND n.t = r.t WHERE n.nx IS NOT NULL) SELECT key, t AS "at" FROM r')
def j5_cooldown_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, J.cooldown_alerts(_stream(spark, sf), "event_type", "ts"))


@query("SELECT event_id, lag_minutes FROM (SELECT event_id, event_type, (max(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - epoch_us(ts)) / 6e7 AS lag_minutes FROM (SELECT *, (event_id * 7919) % 100003 AS a FROM events)) WHERE lag_minutes > 600")
def j6_late_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("a", F.struct((F.col("event_id") * 7919) % 100003, "event_id"))
    return J.late_events(e, "ts", "a", "event_type", 600).select("event_id", "lag_minutes")


@query("SELECT event_type AS key, event_id AS rid, a AS arrival, lag_minutes FROM (SELECT event_id, event_type, a, (max(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - epoch_us(ts)) / 6e7 AS lag_minutes FROM (SELECT *, (event_id * 7919) % 100003 AS a FROM events)) WHERE lag_minutes > 600")
def j6_late_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows as a stream job."""
    return _run(spark, J.late_stream(_stream(spark, sf).withColumn("a", (F.col("event_id") * 7919) % 100003), "event_id", "ts", "a", "event_type", 600))


@query(f"SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, 'types' AS \"check\", count(*) FILTER (event_type NOT IN ('click', 'view'))::DOUBLE / count(*) AS metric, CASE WHEN count(*) FILTER (event_type NOT IN ('click', 'view')) > 0 THEN 'drift_detected' ELSE 'no_drift_detected' END AS status FROM events GROUP BY 1 HAVING date_trunc('day', min(ts)) < {_OPEN}")
def j7_windowed_checks(spark: SparkSession, sf: str) -> DataFrame:
    return _run(spark, J.windowed_checks(_stream(spark, sf), "ts", "1 day", {"types": C.unhandled_domain("event_type", ["click", "view"])}))


@query("SELECT event_type, count(*) FILTER (event_id % 10 <> 0) AS n, sum(event_id) FILTER (event_id % 10 <> 0) AS ids, count(*) FILTER (event_id % 10 = 0) AS unread FROM events GROUP BY 1")
def j1_stream_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of JSON, every tenth cut short; those are kept apart by their text."""
    path = scratch(spark)
    e = table(spark, sf, "events").select("event_id", "event_type")
    line = F.to_json(F.struct("event_type", "event_id"))
    e.select(F.when(F.col("event_id") % 10 == 0, F.substring_index(line, '"event_id"', 1)).otherwise(line).alias("value")).write.text(path)
    out = _run(spark, J.stream_ledger(spark, path, T.StructType.fromDDL("event_id long, event_type string, _corrupt_record string")))
    kind = F.coalesce("event_type", F.regexp_extract("_corrupt_record", '"event_type":"([^"]*)"', 1))
    bad = F.col("_corrupt_record").isNotNull()
    return out.groupBy(kind.alias("event_type")).agg(F.count_if(~bad).alias("n"), F.sum(F.when(~bad, F.col("event_id"))).alias("ids"), F.count_if(bad).alias("unread"))


@query(f"WITH w AS (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) FILTER (event_id % 3 = 0 OR value IS NULL)::DOUBLE / count(*) AS r, min(ts) AS t FROM (SELECT * REPLACE (CASE WHEN day(ts) % 2 = 0 THEN event_id ELSE 1 END AS event_id) FROM events) GROUP BY 1) SELECT window_start, 'value' AS column_name, round(r, 9) AS null_rate_now, 0.0::DOUBLE AS null_rate FROM w WHERE r > 0.15 AND date_trunc('day', t) < {_OPEN}")
def j2_profile_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Every second day a third of the values is missing; the windows are held against a baseline without nulls."""
    s = _stream(spark, sf).withColumn("value", F.when((F.day("ts") % 2 == 0) & (F.col("event_id") % 3 == 0), None).otherwise(F.col("value")))
    base = table(spark, sf, "events").agg((F.count_if(F.col("event_id").isNull()) / F.count("*")).alias("null_rate"))
    return J.profile_drift(_run(spark, J.windowed_profile(s, "ts", "1 day", ["value"])), base, "value").withColumn("null_rate_now", F.round("null_rate_now", 9))


@query(f"SELECT strftime(ts, '%Y-%m') AS month, count(*) AS row_count FROM events WHERE date_trunc('day', ts) < {_OPEN} GROUP BY 1")
def j3_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return J.monthly(_run(spark, J.windowed_profile(_stream(spark, sf), "ts", "1 day", [])))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CASE WHEN o_orderkey % 3 = 0 AND month(o_orderdate) % 4 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def a14_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Written once, then a third of the rows of some months replaced, twice."""
    path = scratch(spark)
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_totalprice", F.lit(1).alias("version"))
    new = o.where("o_orderkey % 3 = 0 and cast(right(month, 2) as int) % 4 = 1").withColumn("o_totalprice", F.col("o_totalprice") + 1).withColumn("version", F.lit(2))
    for rows in (o, new, new.unionByName(new)):
        R.upsert_evidence(rows, path, ["o_orderkey", "month"], "version", ["month"])
    return R.read_evidence(spark, path, ["month"]).drop("version")


@query("SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 97 <> 0 THEN o_orderstatus END, 'MISSING_MAPPING_CHECK_status') AS status FROM orders WHERE o_totalprice > 1000")
def b4_project_mapping(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("s", F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderstatus")))
    return R.project_mapping(o, [("o_orderkey", "id", 1.0), ("s", "status", 0.6)], F.col("o_totalprice") > 1000)


@query("SELECT 'o_orderpriority' AS column_name, count(*) AS lost_rows FROM orders WHERE try_cast(o_orderpriority AS INT) IS NULL")
def b5_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return R.reconcile(table(spark, sf, "orders"), [{"kind": "TYPE_CHANGED", "column": "o_orderpriority", "to": "int"}])[1]


@query("SELECT event_id AS scenario, 0.5::DOUBLE AS confidence, 2 AS risk_count, value + 1 AS risk_sum, greatest(value, 1.0) AS risk_max FROM events")
def a16_export_features(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("scenario"), F.lit(0.5).alias("confidence"), F.create_map(F.lit("a"), F.col("value"), F.lit("b"), F.lit(1.0)).alias("risks"))
    return R.export_features(e)


@query("SELECT count(*) AS n FROM (SELECT * FROM orders LIMIT 100)")
def b7_cap_rows(spark: SparkSession, sf: str) -> DataFrame:
    return L.cap_rows(table(spark, sf, "orders"), 100).agg(F.count("*").alias("n"))
