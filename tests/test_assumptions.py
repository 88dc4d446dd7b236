"""What texts show, by known answers."""

from veridelta.operators import assumptions as A


def scan(spark, text, unique=False):
    df = spark.createDataFrame([(1, text, unique)], "query_id int, query_text string, u boolean")
    return sorted((r.family, r.detail, r.severity) for r in A.assumption_scan(df, unique="u").collect())


def test_families(spark):
    assert scan(spark, "SELECT DATE_TRUNC('Week', ts) FROM t") == [("temporal_bucket", "week", "critical")]
    assert scan(spark, "select cast(Created_At as timestamp), cast(amount as int) from t") == [("temporal_bucket", "cast", "high")]
    assert scan(spark, "select cast(created_at as timestamp) at time zone 'x' from t") == [("temporal_bucket", "cast", "critical")]
    assert scan(spark, "select to_date(loaded_at) from t") == [("temporal_bucket", "to_date", "high")]
    assert scan(spark, "is_incremental() where a > 1") == [("incremental_filter", "is_incremental", "medium")]
    assert scan(spark, "is_incremental() merge into t where a > 1 or b > 2") == [("incremental_filter", "or_expansion", "high")]
    join = "select a.x from a join b on a.id = b.id"
    assert scan(spark, join) == [("join_cardinality", "equality_join", "high")] and scan(spark, join, True)[0][2] == "medium"
    assert scan(spark, "select sum(x) from a join b on a.id = b.id") == [("join_cardinality", "aggregate_after_join", "critical")]
    assert scan(spark, "select * from a join b using (id)") == [] and scan(spark, "select * from a join b where a.id = b.id") == []
    assert scan(spark, "where a.order_status in ('x', 'Y z') and kind = \"q\" and statuses = 'n'") == [("enum_domain_closure", "q", "medium"), ("enum_domain_closure", "x,y z", "medium")]
    assert scan(spark, "case when status = 1 then 2 end") == [("enum_domain_closure", "case_without_else", "medium")] and scan(spark, "case when status = 1 then 2 else 3 end") == []
    assert scan(spark, "coalesce(a, 0), nvl(b, c), ifnull(d, ''), e is not null") == [("null_default_fallback", x, s) for x, s in (("''", "high"), ("0", "high"), ("c", "medium"), ("null_test", "medium"))]
    assert scan(spark, "materialized: 'view'") == [("materialization_cost", "view", "high")] and scan(spark, "create or replace table t") == [("materialization_cost", "rebuilt", "critical")]
    assert scan(spark, None) == scan(spark, "") == scan(spark, "it's ''' broken ( \" text in (") == []


def test_fields_by_what_stands_near(spark):
    text = lambda *more: spark.createDataFrame([(i, t) for i, t in enumerate(more)], "query_id int, query_text string")
    names = spark.createDataFrame([("Status",), ("id",), ("missing",)], "name string")
    far = " ".join(["x"] * A.NEAR)
    df = text("select o.status from t group by 1", f"status {far} group by 1", "coalesce(status, 1)", "status is null", "x join y on x.id = y.id", "date_trunc('day', o.id)", "row_number() over (order by id)", "case when status then 1 end where id <> 3", "delete from t where id > now()", None, "event_time as e, id")
    got = {}
    for r in A.field_assumptions(df, names).collect():
        got.setdefault((r.query_id, r.name), {})[r.kind] = r.confidence
    assert got == {
        (0, "status"): {"GRAIN_OR_DEDUP": 0.84}, (2, "status"): {"NULL_HANDLING": 0.86}, (3, "status"): {"NULL_HANDLING": 0.78}, (4, "id"): {"JOIN_CARDINALITY": 0.9}, (5, "id"): {"TEMPORAL_BUCKETING": 0.91},
        (6, "id"): {"GRAIN_OR_DEDUP": 0.9, "TEMPORAL_BUCKETING": 0.79}, (7, "status"): {"STATUS_MAPPING": 0.84}, (7, "id"): {"STATUS_MAPPING": 0.84, "DOMAIN_FILTER": 0.88}, (8, "id"): {"INCREMENTAL_STATE": 0.86, "FRESHNESS_WINDOW": 0.82}, (10, "id"): {"TEMPORAL_COMPLETENESS": 0.8},
    }


def test_a_text_of_many_rows_is_looked_at_once(spark):
    """Texts are made distinct before they are cut into tokens, and each row still gets its hits."""
    rows = [(i, "select a from t where status = 'x'") for i in range(50)] + [(7, "select coalesce(status, 0) from t"), (99, None), (100, "")]
    names = spark.createDataFrame([("status",)], "name string")
    out = A.field_assumptions(spark.createDataFrame(rows, "query_id int, query_text string"), names)
    got = sorted((r.query_id, r.kind) for r in out.collect())
    assert got == sorted([(i, "DOMAIN_FILTER") for i in range(50)] + [(7, "NULL_HANDLING")])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [__text" in plan[plan.index("Generate posexplode") :]
