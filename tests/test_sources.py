"""Round trips of readers and writers, and known answers of the checks."""

import json

import pytest
from pyspark.sql import functions as F

from veridelta.operators import checks, contracts, evidence, snapshot, workload
from veridelta.operators.profile import profile_table
from veridelta.sources import readers


def put(path, text):
    path.write_text(text)
    return str(path)


def test_query_history_forms(spark, tmp_path):
    csv = put(tmp_path / "h.csv", 'engine,model_name,query_text,cost_usd,total_elapsed_time\nsnowflake,a.b,select 1,"1,200.5",3\n')
    r = readers.read_query_history(spark, csv).first()
    assert (r.engine, r.model_name, r.cost_usd, r.runtime_seconds) == ("snowflake", "a.b", 1200.5, 3.0)
    runs = put(tmp_path / "r.json", json.dumps({"runs": [{"engine": "databricks", "model_name": "m", "run_duration_seconds": 7, "dbu_hours": 2}]}))
    assert readers.read_query_history(spark, runs, "json").first().dbu == 2.0
    rows = put(tmp_path / "l.json", json.dumps([{"model": "x"}, {"model": "y"}]))
    assert {r.model_name for r in readers.read_query_history(spark, rows, "json").collect()} == {"x", "y"}
    named = put(tmp_path / "m.json", json.dumps({"model_z": {"cost": 3}}))
    assert [(r.model_name, r.cost_usd) for r in readers.read_query_history(spark, named, "json").collect()] == [("model_z", 3.0)]


def test_workload_and_sql_texts(spark, tmp_path):
    log = put(tmp_path / "q.jsonl", '{"sql": "select 1", "calls": "3"}\n{"query_id": "q2", "query": "select 2"}\n')
    got = {r.query_text: (r.query_id, r.calls) for r in readers.read_workload(spark, log).collect()}
    assert got["select 2"][0] == "q2" and got["select 1"][0].startswith("HIST_") and got["select 1"][1] == 3
    sql = put(tmp_path / "a.sql", "select 1;\nselect 2;\n")
    assert [r.statement for r in readers.read_sql_texts(spark, sql).orderBy("pos").collect()] == ["select 1", "select 2"]


def test_receipts_and_ledgers(spark, tmp_path):
    d = tmp_path / "receipts"
    d.mkdir()
    put(d / "one.json", json.dumps({"generated_at": "2024-01-01T00:00:00Z", "verdict": "REVIEW", "findings": [{"id": "f", "stable_id": "s", "family": "x", "risk_score": 92, "blast_radius": [{"node": "a"}], "validation_replay": {"replay_ran": True, "status": "drift_detected"}}]}))
    r = readers.read_receipts(spark, str(d)).first()
    assert (r.stable_id, r.risk_score, r.blast, r.replay_status, r.business_severity) == ("s", 92, 1, "drift_detected", "UNKNOWN")
    ledger = put(tmp_path / "f.jsonl", '{"stable_finding_id": "s", "disposition": "False-Positive"}\nnot json\n{"disposition": "what"}\n')
    assert sorted(r.disposition for r in readers.read_ledger(spark, ledger, "feedback").collect()) == ["false_positive", "needs_context"]
    readers.append_ledger(spark.createDataFrame([("s", "agree")], "stable_finding_id string, disposition string"), str(tmp_path / "out"), F.lit("2024-01-01"))
    readers.append_ledger(spark.createDataFrame([("t", "agree")], "stable_finding_id string, disposition string"), str(tmp_path / "out"), F.lit("2024-01-02"))
    assert readers.read_ledger(spark, str(tmp_path / "out"), "feedback").count() == 2


def test_lineage_artifacts(spark, tmp_path):
    event = {"job": {"name": "j"}, "inputs": [{"name": "a"}], "outputs": [{"name": "b", "facets": {"columnLineage": {"fields": {"x": {"inputFields": [{"name": "a", "field": "y"}]}}}}}]}
    edges, cols = readers.read_openlineage(spark, put(tmp_path / "ol.json", json.dumps(event)))
    assert edges.collect() == [("a", "b", "j")] and cols.collect() == [("a.y", "b.x")]
    man = {"nodes": {"model.p.m": {"name": "m", "resource_type": "model", "raw_code": "select 1", "config": {"materialized": "table"}, "depends_on": {"nodes": ["model.p.n"]}}}}
    nodes, deps = readers.read_dbt_manifest(spark, put(tmp_path / "manifest.json", json.dumps(man)))
    assert nodes.first().materialized == "table" and deps.collect() == [("model.p.n", "model.p.m")]
    res = put(tmp_path / "run.json", json.dumps({"results": [{"unique_id": "model.p.m", "status": "error", "execution_time": 2.5}]}))
    assert readers.read_dbt_run_results(spark, res).collect() == [("model.p.m", "error", 2.5, True)]
    dag = put(tmp_path / "dag.json", json.dumps({"tasks": [{"task_id": "a", "downstream_task_ids": ["b", "c"]}]}))
    assert {tuple(r) for r in readers.read_orchestration(spark, dag, "airflow").collect()} == {("a", "b"), ("a", "c")}
    mon = put(tmp_path / "mc.json", json.dumps({"monitors": [{"table": "t"}]}))
    assert readers.read_orchestration(spark, mon, "montecarlo").select("asset", "kind").collect() == [("t", "montecarlo")]
    named = put(tmp_path / "dags.json", json.dumps({"dags": [{"dag_id": "d", "tasks": [{"task_id": "a"}, {"task_id": "b", "upstream_task_ids": ["a"]}], "downstream_map": {"b": ["c"]}}]}))
    assert {tuple(r) for r in readers.read_orchestration(spark, named, "airflow").collect()} == {("d.a", "d.b"), ("d.b", "d.c")}
    checks_file = put(tmp_path / "dg.json", json.dumps([{"asset_key": "x", "passed": False}, {"asset": "y", "passed": True, "severity": "WARN"}, {"asset": "z", "passed": True}]))
    assert {(r.asset, r.failing) for r in readers.read_orchestration(spark, checks_file, "dagster").collect()} == {("x", True), ("y", True), ("z", False)}
    view = put(tmp_path / "v.lkml", "sql_table_name: mart.orders ;; sql: ${orders.id} ;;")
    assert {r.asset for r in readers.read_orchestration(spark, view, "looker").collect()} == {"mart.orders", "orders.id"}
    fresh = put(tmp_path / "sources.json", json.dumps({"results": [{"unique_id": "s", "status": "warn"}, {"node": "t"}]}))
    assert {tuple(r) for r in readers.read_source_freshness(spark, fresh).collect()} == {("s", "warn"), ("t", "unknown")}
    hot = readers.hot_nodes(spark.createDataFrame([("model.p.m",), ("other",)], "node string"), readers.read_dbt_run_results(spark, res))
    assert {(r.node, r.hot) for r in hot.collect()} == {("model.p.m", True), ("other", False)}
    reg = put(tmp_path / "reg.json", json.dumps({"models": {"m": {"severity": "BOARD_CRITICAL"}}}))
    assert readers.read_registry(spark, reg, "struct<severity:string>").collect() == [("m", "BOARD_CRITICAL")]


def test_topic_contracts(spark, tmp_path):
    def topic(fields, key, late, event, compat):
        return {"topics": {"t": {"schema": {"fields": fields}, "config": {"partition_key": key, "retention_ms": 10, "idempotent": True}, "semantics": {"event_time_field": event, "lateness_tolerance_minutes": late}, "compatibility": compat}}}

    before = topic([{"name": "a", "type": "int"}, {"name": "b", "type": "enum", "symbols": ["x", "y"]}, {"name": "c", "type": "int"}], "a", 15, "ts", "FULL")
    after = topic([{"name": "a", "type": "string"}, {"name": "b", "type": "enum", "symbols": ["x"]}, {"name": "d", "type": "int", "required": True}], "b", 5, "at", "NONE")
    (tb, fb), (ta, fa) = (readers.read_topics(spark, put(tmp_path / f"{n}.json", json.dumps(x))) for n, x in (("b", before), ("a", after)))
    found = contracts.topic_diff(tb, ta, fb, fa)
    assert {r.finding for r in found.collect()} == {"event_time_changed", "lateness_tightened", "partition_key_changed", "compatibility_weakened", "field_removed", "required_field_added", "field_type_changed", "enum_symbol_removed"}
    assert contracts.streaming_verdict(found).first().verdict == "BLOCK"


def test_topics_as_lists_and_maps(spark, tmp_path):
    file = {"streams": [{"name": "t", "value_schema": {"fields": {"a": {"type": "int", "required": True}, "b": {"type": ["null", "string"]}}}}, {"topic_config": {"partition_key": "k"}}], "consumer_contracts": [{"name": "c", "source_topic": "t", "required_fields": ["a"]}]}
    path = put(tmp_path / "streams.json", json.dumps(file))
    topics, fields = readers.read_topics(spark, path)
    assert {(r.topic, r.partition_key) for r in topics.collect()} == {("t", None), ("topic_1", "k")}
    assert {(r.field, r.type, r.required) for r in fields.collect()} == {("a", "int", True), ("b", "null|string", False)}
    assert [(r.consumer, r.topic, r.required_fields) for r in readers.read_consumers(spark, path).collect()] == [("c", "t", ["a"])]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snap")
    p = profile_table(spark.range(5), "t")
    for i in (1, 2, 3):
        snapshot.write_snapshot(p, path, i, f"run {i}")
    snapshot.write_snapshot(p, path, 2, "again")
    assert [(r.snapshot_id, r.label) for r in snapshot.list_snapshots(spark, path).collect()] == [(3, "run 3"), (2, "again"), (1, "run 1")]
    assert snapshot.read_snapshot(spark, path).first().snapshot_id == 3
    assert snapshot.prune_snapshots(spark, path, 2) == [1] and snapshot.list_snapshots(spark, path).count() == 2


def test_known_answers(spark):
    ts = spark.createDataFrame([("2024-01-01 01:30:00",), ("2024-01-01 03:45:00",), ("2024-01-01 12:00:00",), ("2024-01-01 20:00:00",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("ts"))
    assert checks.run_checks(ts, {"x": checks.temporal_bucket("ts", -5)}).first().metric == 0.5
    assert checks.scope_ratio(spark.range(5), spark.range(500)).first().metric == 100.0
    left, right = spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1,), (1,), (1,), (2,), (3,)], "k int")
    r = checks.fanout(left, right, ["k"], ["k"]).first()
    assert (r.joined_rows, r.drift) == (5, True) and r.metric == pytest.approx(1.6667, abs=1e-4)
    gone = spark.createDataFrame([(None,)], "k int")
    assert checks.fanout(gone, gone, ["k"], ["k"]).first().joined_rows == 0 and checks.fanout(gone, gone, ["k"], ["k"], nulls_match=True).first().joined_rows == 1
    only_new = checks.run_checks(spark.range(4), {"x": checks.selection_ratio(F.col("id") < 0, F.col("id") < 2)}).first()
    assert only_new.metric is None and only_new.status == "drift_detected"
    h = spark.createDataFrame([("snowflake", "incremental_events", "", float(x), float(c)) for x, c in ((100, 40), (201, 45), (150, 40))], "engine string, model_name string, query_text string, runtime_seconds double, cost_usd double")
    p = workload.history_profile(h).first()
    assert (p.runs, p.p95_runtime, p.confidence, round(p.avg_cost, 4)) == (3, 201.0, "medium", 41.6667)


def test_decay_known_answer(spark):
    rows = [(i, "s", "x", "m", "critical", 92, "REVENUE_CRITICAL", True, "drift_detected", 0.9, f"2024-01-0{i + 1}", 1.0) for i in range(2)]
    f = spark.createDataFrame(rows, "occurrence_id int, stable_id string, family string, source_id string, severity string, risk_score int, business_severity string, replay_ran boolean, replay_status string, fidelity_score double, receipt_day string, monthly_cost double").withColumn("receipt_day", F.to_date("receipt_day"))
    fb = spark.createDataFrame([(1, "s", "fixed")], "feedback_id int, stable_finding_id string, disposition string")
    ex = spark.createDataFrame([], "exception_id int, scope string, value string, reason string, expires_on date")
    now = F.lit("2024-01-05").cast("date")
    r = evidence.decay(evidence.with_evidence(f, fb, ex, now), now).first()
    assert (r.state, r.feedback) == ("decaying_high_confidence", 2)


def test_artifacts_of_lines_are_those_of_files(spark, tmp_path):
    """Two artifacts as lines of a file, beside each as a file."""
    texts = [json.dumps({"nodes": {k: {"name": k, "depends_on": {"nodes": ["x"]}}}, "results": [{"unique_id": k, "status": "pass"}], "topics": {k: {"compatibility": "full"}}, "dags": [{"dag_id": k, "tasks": [{"task_id": "b", "upstream": ["a"]}]}]}) for k in ("m\n1", "m2")]
    (tmp_path / "files").mkdir()
    for i, x in enumerate(texts):
        (tmp_path / "files" / f"{i}.json").write_text(x)
    (tmp_path / "lines.json").write_text("\n".join(texts) + "\n")
    reads = [lambda *a: readers.read_dbt_manifest(*a)[1], readers.read_dbt_run_results, readers.read_source_freshness, lambda s, p, lines: readers.read_orchestration(s, p, "airflow", lines), lambda *a: readers.read_topics(*a)[0], lambda s, p, lines: readers.read_registry(s, p, "struct<name:string>", lines)]
    for read in reads:
        files, lines = (sorted(map(tuple, read(spark, str(tmp_path / at), many).collect())) for at, many in (("files", False), ("lines.json", True)))
        assert files == lines and len(files) == 2


def test_written_artifacts_take_few_files(spark, tmp_path):
    """Their number follows the partitions, not the rows."""
    from veridelta.plans import file_queries

    file_queries._files(spark.range(500).selectExpr("CAST(id AS STRING) AS value", "id AS part").coalesce(2), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").rglob("*.txt"))) <= 2
