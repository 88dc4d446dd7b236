"""Derived tables, written so that Spark and other engines read the same text. {name} stands for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A catalog with one column for each part, eight to a table; h deals out the changes.
_COLUMNS = """WITH columns AS (SELECT t, c, s, h, concat(CASE t % 6 WHEN 0 THEN 'order_' WHEN 1 THEN 'customer_' WHEN 2 THEN 'event_' ELSE 'tbl_' END, CAST(t AS VARCHAR(20))) AS table_name,
       concat(CASE c WHEN 0 THEN 'row_id' WHEN 1 THEN 'status' WHEN 2 THEN 'created_at' WHEN 3 THEN 'amount' WHEN 4 THEN 'customer_id' WHEN 5 THEN 'email' WHEN 6 THEN 'note' ELSE 'flag' END, CASE WHEN s % 4 = 0 THEN '' ELSE concat('_', CAST(s % 4 AS VARCHAR(20))) END) AS column_name,
       CASE c WHEN 0 THEN 'bigint' WHEN 1 THEN 'varchar(20)' WHEN 2 THEN 'timestamp' WHEN 3 THEN 'numeric(12,2)' WHEN 4 THEN 'bigint' WHEN 5 THEN 'varchar(80)' WHEN 6 THEN 'text' ELSE 'boolean' END AS dtype,
       CASE c WHEN 0 THEN 'INTEGER' WHEN 2 THEN 'TEMPORAL' WHEN 3 THEN 'FLOAT' WHEN 4 THEN 'INTEGER' WHEN 7 THEN 'BOOLEAN' ELSE 'STRING' END AS family, s % 3 = 0 AS nullable,
       CASE WHEN s % 3 = 0 THEN CAST(k % 40 AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END AS null_rate, CASE WHEN c = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(k % 77 + 1 AS DOUBLE) / 100 END AS cardinality,
       CASE c WHEN 0 THEN CAST(NULL AS VARCHAR(20)) WHEN 1 THEN 'active|paused|done' WHEN 2 THEN '2024-01-01t00:00|2024-01-02t00:00' WHEN 7 THEN 'true|false' ELSE concat('v', CAST(k % 5 AS VARCHAR(20)), '|w') END AS samples,
       s % 7 = 0 AS has_default, CAST(t % 9 AS INT) AS blast, CASE c WHEN 0 THEN DATE '2024-01-30' WHEN 1 THEN DATE '2024-01-26' WHEN 2 THEN DATE '2024-01-20' WHEN 3 THEN DATE '2024-01-03' ELSE DATE '2023-12-15' END AS changed_on
       FROM (SELECT p_partkey AS k, p_size AS s, CAST(floor(p_partkey / 8) AS BIGINT) AS t, p_partkey % 8 AS c, (p_partkey * 7 + p_size) % 23 AS h FROM {part}) x)"""

VIEWS = {
    "findings": """SELECT event_id AS occurrence_id, CAST(ts AS DATE) AS receipt_day,
       concat('AG-', event_type, '-', CAST(user_id % 10 AS VARCHAR(20))) AS stable_id, event_type AS family, CAST(event_id % 101 AS INT) AS risk_score,
       CASE WHEN event_id % 101 >= 90 THEN 'critical' WHEN event_id % 101 >= 70 THEN 'high' WHEN event_id % 101 >= 40 THEN 'medium' ELSE 'low' END AS severity,
       event_id % 4 <> 0 AS replay_ran, CASE event_id % 4 WHEN 0 THEN 'not_run' WHEN 1 THEN 'drift_detected' ELSE 'no_drift_detected' END AS replay_status,
       CAST(event_id % 20 AS DOUBLE) / 20 AS fidelity_score,
       CASE user_id % 7 WHEN 0 THEN 'BOARD_CRITICAL' WHEN 1 THEN 'EXEC_CRITICAL' WHEN 2 THEN 'REVENUE_CRITICAL' WHEN 3 THEN 'CUSTOMER_FACING' WHEN 4 THEN 'INTERNAL_HIGH' WHEN 5 THEN 'INTERNAL_LOW' ELSE 'UNKNOWN' END AS business_severity,
       concat('model_', CAST(user_id % 25 AS VARCHAR(20))) AS source_id, CAST(value AS DECIMAL(12,2)) AS monthly_cost FROM {events}""",
    "feedback": """SELECT event_id AS feedback_id, concat('AG-', event_type, '-', CAST(user_id % 10 AS VARCHAR(20))) AS stable_finding_id,
       CASE event_id % 6 WHEN 0 THEN 'agree' WHEN 1 THEN 'fixed' WHEN 2 THEN 'disagree' WHEN 3 THEN 'false_positive' WHEN 4 THEN 'accepted_risk' ELSE 'needs_context' END AS disposition,
       ts AS created_at FROM {events} WHERE event_id % 11 = 0""",
    "exceptions": """SELECT n_nationkey AS exception_id, CASE n_nationkey % 3 WHEN 0 THEN 'stable_id' WHEN 1 THEN 'family' ELSE 'source' END AS scope,
       CASE n_nationkey % 3 WHEN 0 THEN concat('AG-click-', CAST(n_nationkey % 10 AS VARCHAR(20))) WHEN 1 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'error' ELSE 'view' END ELSE concat('model_', CAST(n_nationkey AS VARCHAR(20))) END AS value,
       CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 'accepted' END AS reason, CASE WHEN n_nationkey % 2 = 0 THEN DATE '2024-01-15' ELSE DATE '2024-03-01' END AS expires_on FROM {nation}""",
    "history": """SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'snowflake' WHEN 'O' THEN 'databricks' ELSE 'dbt' END AS engine,
       concat('model_', CAST(o_custkey % 50 AS VARCHAR(20))) AS model_name, CAST(o_totalprice AS DECIMAL(12,2)) AS runtime_seconds,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS cost_usd,
       concat('select * from mart.model_', CAST(o_custkey % 50 AS VARCHAR(20)), CASE WHEN o_orderkey % 2 = 0 THEN ' join dim.nation on 1 = 1 group by 1' ELSE ' order by 1' END) AS query_text FROM {orders}""",
    "edges": "SELECT CAST(floor(c_custkey / 2) AS BIGINT) AS source, c_custkey AS target FROM {customer} WHERE c_custkey > 1",
    "orders_after": """SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM {orders} WHERE o_orderkey % 200 <> 7""",
    "catalog_before": _COLUMNS + """ SELECT table_name, column_name, dtype, family, nullable, null_rate, cardinality, samples, has_default, blast, changed_on FROM columns""",
    "catalog_after": _COLUMNS + """ SELECT CASE WHEN t % 10 = 3 THEN concat('new_', table_name) ELSE table_name END AS table_name, CASE WHEN h = 1 THEN concat(column_name, '_v2') ELSE column_name END AS column_name,
       CASE WHEN h IN (2, 12) THEN CASE c WHEN 0 THEN 'int' WHEN 1 THEN 'varchar(10)' WHEN 2 THEN 'date' WHEN 3 THEN 'numeric(10,1)' WHEN 4 THEN 'numeric(20,0)' WHEN 5 THEN 'varchar(120)' WHEN 6 THEN 'varchar(50)' ELSE 'numeric(1,0)' END
         WHEN h = 10 THEN CASE c WHEN 1 THEN 'text' WHEN 2 THEN 'timestamptz' ELSE 'text' END ELSE dtype END AS dtype,
       CASE WHEN h IN (2, 12) THEN CASE c WHEN 3 THEN 'FLOAT' WHEN 4 THEN 'FLOAT' WHEN 7 THEN 'FLOAT' ELSE family END WHEN h = 10 THEN CASE c WHEN 2 THEN 'TEMPORAL' ELSE 'STRING' END ELSE family END AS family,
       CASE WHEN h = 3 THEN NOT nullable ELSE nullable END AS nullable, CASE WHEN h = 4 THEN null_rate + 0.4 ELSE null_rate END AS null_rate,
       CASE WHEN h = 5 THEN cardinality * 0.3 WHEN h IN (6, 7, 8) THEN cardinality + 0.2 ELSE cardinality END AS cardinality,
       CASE WHEN h IN (6, 12) AND samples IS NOT NULL THEN 'x1|x2' WHEN h = 7 AND samples IS NOT NULL THEN concat(samples, '|zz') ELSE samples END AS samples, has_default, blast, changed_on FROM columns WHERE t % 10 <> 4 AND h <> 0
       UNION ALL SELECT table_name, concat('extra_', CAST(c AS VARCHAR(20))), 'int', 'INTEGER', s % 2 = 0, CAST(0 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(NULL AS VARCHAR(20)), s % 4 = 1, blast, changed_on FROM columns WHERE t % 10 NOT IN (3, 4) AND h = 9
       UNION ALL SELECT concat('copy_of_', table_name), column_name, dtype, family, nullable, null_rate, cardinality, samples, has_default, blast, changed_on FROM columns WHERE t % 10 = 6""",
}
SOURCE = {"catalog_before": "part", "catalog_after": "part", "findings": "events", "feedback": "events", "exceptions": "nation", "history": "orders", "edges": "customer", "orders_after": "orders"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = SOURCE[name]
    return spark.sql(VIEWS[name], **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})


def with_views(sql: str, *names: str) -> str:
    """sql after the named views as common table expressions."""
    text = ", ".join(f"{n} AS ({VIEWS[n].format(**{SOURCE[n]: SOURCE[n]})})" for n in names)
    return f"WITH {text} {sql}" if not sql.lstrip().upper().startswith("WITH ") else f"WITH {text}, {sql.lstrip()[5:]}"
