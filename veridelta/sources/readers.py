"""Readers and writers of tables, ledgers, logs and artifacts. Schemas are explicit; unreadable JSON lines are set apart."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut
from ..operators.evidence import latest_per_key, normalize_disposition
from ..operators.workload import coalesce_aliases, to_number

#: Column names by which logs call the same thing (fixed values).
HISTORY_ALIASES = {
    "run_id": ["run_id", "query_id", "job_id", "id"], "engine": ["engine", "platform", "warehouse_type"], "model_name": ["model_name", "model", "unique_id", "name"], "relation_name": ["relation_name", "relation", "table_name"], "query_text": ["query_text", "query", "sql", "statement"],
    "runtime_seconds": ["runtime_seconds", "run_duration_seconds", "total_elapsed_time", "execution_time", "duration"], "cost_usd": ["cost_usd", "cost", "estimated_cost_usd"], "bytes_scanned": ["bytes_scanned", "bytes_processed"], "credits_used": ["credits_used", "credits"], "dbu": ["dbu_hours", "dbu", "dbus"],
}
NUMBERS = ["runtime_seconds", "cost_usd", "bytes_scanned", "credits_used", "dbu"]
ALL_ALIASES = sorted({a for names in HISTORY_ALIASES.values() for a in names})
LEDGERS = {
    "feedback": "stable_finding_id string, finding_id string, receipt string, disposition string, created_at string, _corrupt_record string",
    "exceptions": "exception_id string, scope string, value string, reason string, expires_at string, _corrupt_record string",
    "shadow": "recorded_at string, repo string, team string, verdict string, would_block boolean, would_require_review boolean, primary_reason string, assumption_count int, projected_weekly_cost_usd double, recurring_waste_patterns array<string>, _corrupt_record string",
}
RECEIPT = "receipt_kind string, generated_at string, verdict string, findings array<struct<id:string,stable_id:string,family:string,severity:string,risk_score:int,business_impact:struct<highest_business_severity:string>,validation_replay:struct<replay_ran:boolean,status:string>,replay_fidelity:struct<score:double>,source:struct<unique_id:string,path:string>,blast_radius:array<struct<node:string>>>>"


def read_table(spark: SparkSession, name: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A path (with a slash), a JDBC table (fmt='jdbc'), or a table of the catalog."""
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(dbtable=name, **options).load()
    return spark.read.format(fmt).options(**options).load(name) if "/" in name else spark.table(name)


def _history(df: DataFrame) -> DataFrame:
    out = coalesce_aliases(df, HISTORY_ALIASES)
    return out.withColumns({c: to_number(F.col(c)) for c in NUMBERS})


def read_query_history(spark: SparkSession, paths: str | list[str], fmt: str = "csv") -> DataFrame:
    """Runs from CSV, or from JSON: a list, a list under a usual name, or an object of measures by model."""
    if fmt == "csv":
        return _history(spark.read.option("header", True).csv(paths))
    row = "struct<" + ",".join(f"{a}:string" for a in ALL_ALIASES) + ">"
    text = spark.read.text(paths, wholetext=True)
    lists = [F.when(F.trim("value").startswith("["), F.from_json("value", f"array<{row}>"))] + [F.from_json(F.get_json_object("value", f"$.{k}"), f"array<{row}>") for k in ("rows", "results", "history", "queries", "jobs", "runs")]
    listed = text.select(F.coalesce(*lists).alias("l"), F.from_json("value", f"map<string,{row}>").alias("m"))
    rows = listed.where("l is not null").select(F.inline("l"))
    mapped = listed.where("l is null").select(F.explode("m").alias("k", "v")).select("v.*", "k").withColumn("model_name", F.coalesce("model_name", "k")).drop("k")
    return _history(rows.unionByName(mapped))


def read_workload(spark: SparkSession, paths: str | list[str], fmt: str = "json") -> DataFrame:
    """query_id, query_text, source, calls. A missing id is a hash of the text, since lines have no stable number."""
    df = spark.read.option("header", True).csv(paths) if fmt == "csv" else spark.read.schema(", ".join(f"{c} string" for c in ("query_id", "id", "query", "query_text", "sql", "statement", "calls", "source"))).json(paths)
    out = coalesce_aliases(df, {"query_id": ["query_id", "id"], "query_text": ["query", "query_text", "sql", "statement"], "source": ["source"], "calls": ["calls"]}).where("query_text is not null")
    return out.withColumn("query_id", F.coalesce("query_id", F.concat(F.lit("HIST_"), F.hex(F.xxhash64("query_text"))))).withColumn("calls", to_number(F.col("calls")).cast("long"))


def read_sql_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, pos and statement of .sql files, split at semicolons. A file is read whole, since pos counts from its start."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", ";")).alias("pos", "statement"))
    return df.withColumn("statement", F.btrim("statement", F.lit(" \t\r\n"))).where("statement <> ''")


def read_receipts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row per finding, with the file of its receipt; receipts without findings give none. A file is one receipt, or one a line."""
    df = spark.read.schema(RECEIPT).option("multiLine", not lines).json(path).select("*", F.col("_metadata.file_path").alias("receipt"))
    f = df.select("receipt", F.try_to_timestamp("generated_at").alias("generated_at"), "verdict", F.explode("findings").alias("f"))
    return f.select("receipt", "generated_at", "verdict", F.coalesce("f.stable_id", "f.id").alias("stable_id"), "f.family", "f.severity", "f.risk_score", F.coalesce("f.business_impact.highest_business_severity", F.lit("UNKNOWN")).alias("business_severity"), F.coalesce("f.validation_replay.replay_ran", F.lit(False)).alias("replay_ran"), F.coalesce("f.validation_replay.status", F.lit("not_run")).alias("replay_status"), F.col("f.replay_fidelity.score").alias("fidelity_score"), F.col("f.source.unique_id").alias("source_id"), F.coalesce(F.size("f.blast_radius"), F.lit(0)).alias("blast"))


def read_ledger(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Lines of a ledger; unreadable ones are left out, dispositions are normalised."""
    line = F.from_json("value", LEDGERS[kind], {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    df = spark.read.text(path).where(F.trim("value") != "").select(line.alias("l")).where("l._corrupt_record is null").select("l.*").drop("_corrupt_record")
    return df.withColumn("disposition", normalize_disposition(F.col("disposition"))) if kind == "feedback" else df


def append_ledger(df: DataFrame, path: str, now: Column) -> None:
    df.withColumn("recorded_at", now).write.mode("append").json(path)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing rows with new ones in place of those with the same key; the same input twice changes nothing."""
    return latest_per_key(existing.unionByName(new, allowMissingColumns=True), keys, [order])


def upsert_evidence(new: DataFrame, path: str, keys: list[str], order: str, by: list[str]) -> None:
    """Rows of `new` in place of stored ones of the same key, of several the newest by `order`; the same input twice changes nothing.

    The table is partitioned by some of the keys, so a key never moves; only partitions that `new` touches are read,
    merged and replaced, and all others keep their files. The merged rows are written beside the table first. Once they
    are complete, which a count says, the partitions are replaced from them; a job lost before leaves the old rows, and one lost
    after is completed by the next upsert or read_evidence. Of several writers one at a time may run.
    """
    if not set(by) <= set(keys):
        raise ValueError(f"partition columns {by} must be among the keys {keys}")
    spark = new.sparkSession
    complete_upsert(spark, path, by)
    fresh = cut(latest_per_key(new, keys, [order]))
    stored = _stored(spark, path, fresh.schema, by)
    if stored is not None:
        touched = fresh.select(*by).distinct()
        kept = stored.join(F.broadcast(touched) if touched.count() <= PARTITIONS else touched, by, "left_semi")
        both = kept.withColumn("__new", F.lit(False)).unionByName(fresh.withColumn("__new", F.lit(True)), allowMissingColumns=True)
        fresh = latest_per_key(both, keys, [order, "__new"]).drop("__new")
    fresh.write.mode("overwrite").parquet(f"{path}/_pending")
    merged = spark.read.schema(fresh.schema).parquet(f"{path}/_pending")
    merged.agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{path}/_pending_rows")
    complete_upsert(spark, path, by)


#: A list of so many partitions is broadcast, so that only these are read.
PARTITIONS = 100_000


def complete_upsert(spark: SparkSession, path: str, by: list[str]) -> bool:
    """Replaces partitions by those that a lost upsert had merged, if it had come that far; whether there were any."""
    mark = _stored(spark, f"{path}/_pending_rows")
    rows = mark.agg(F.sum("rows")).first()[0] if mark is not None else None
    if rows is None:
        return False
    merged = spark.read.parquet(f"{path}/_pending")
    if merged.count() != rows:
        raise ValueError(f"{path}/_pending has not the {rows} rows that were merged")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    spark.createDataFrame([], "rows long").write.mode("overwrite").parquet(f"{path}/_pending_rows")
    return True


def _stored(spark: SparkSession, path: str, known: T.StructType | None = None, by: list[str] = []) -> DataFrame | None:
    """What is stored there, its partition columns `by` of the types in `known`; None where nothing is."""
    try:
        df = spark.read.parquet(path)
        kinds = {f.name: f.dataType for f in known.fields} if known else {}
        return spark.read.schema(T.StructType([T.StructField(f.name, kinds[f.name] if f.name in by else f.dataType) for f in df.schema.fields])).parquet(path) if by else df
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_evidence(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    """The table that upsert_evidence writes, a lost upsert completed."""
    complete_upsert(spark, path, by)
    last = spark.read.parquet(f"{path}/_pending").schema
    stored = _stored(spark, path, last, by)
    return spark.createDataFrame([], last) if stored is None else stored


def read_openlineage(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Dataset edges (source, target, job) and column edges (source, target) of run events, one JSON object a line."""
    ds = "array<struct<namespace:string,name:string,facets:struct<columnLineage:struct<fields:map<string,struct<inputFields:array<struct<namespace:string,name:string,field:string>>>>>>>>"
    df = spark.read.schema(f"job struct<namespace:string,name:string>, inputs {ds}, outputs {ds}").json(path)
    edges = df.select(F.col("job.name").alias("job"), F.explode("inputs").alias("i"), "outputs").select("job", F.col("i.name").alias("source"), F.explode("outputs").alias("o")).select("source", F.col("o.name").alias("target"), "job").distinct()
    fields = df.select(F.explode("outputs").alias("o")).select(F.col("o.name").alias("t"), F.explode("o.facets.columnLineage.fields").alias("f", "v")).select("t", "f", F.explode("v.inputFields").alias("x"))
    return edges, fields.select(F.concat_ws(".", "x.name", "x.field").alias("source"), F.concat_ws(".", "t", "f").alias("target")).distinct()


def _texts(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """value: an artifact a file, or, with `lines`, an artifact a line, so that many lie in few files that can be split."""
    return spark.read.text(path, wholetext=not lines)


def read_dbt_manifest(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, name, kind, materialized, path, text) and edges (source, target) of a manifest."""
    text = _texts(spark, path, lines)
    node = "struct<name:string,resource_type:string,original_file_path:string,raw_code:string,compiled_code:string,config:struct<materialized:string>,depends_on:struct<nodes:array<string>>>"
    n = text.select(F.explode(F.from_json(F.get_json_object("value", "$.nodes"), f"map<string,{node}>")).alias("node", "v"))
    nodes = n.select("node", F.col("v.name").alias("name"), F.col("v.resource_type").alias("kind"), F.col("v.config.materialized").alias("materialized"), F.col("v.original_file_path").alias("path"), F.coalesce("v.compiled_code", "v.raw_code").alias("text"))
    return nodes, n.select(F.explode("v.depends_on.nodes").alias("source"), F.col("node").alias("target")).distinct()


def read_dbt_run_results(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """node, status, seconds, failing of executed nodes: failing are those with failures, or without a status of success."""
    text = _texts(spark, path, lines)
    rows = text.select(F.inline(F.from_json(F.get_json_object("value", "$.results"), "array<struct<unique_id:string,status:string,execution_time:double,failures:bigint>>"))).where("unique_id <> ''")
    bad = ~F.coalesce(F.lower("status").isin("success", "pass", "ok"), F.lit(False)) | (F.coalesce("failures", F.lit(0)) > 0)
    return rows.select(F.col("unique_id").alias("node"), "status", F.col("execution_time").alias("seconds"), bad.alias("failing"))


def read_source_freshness(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """node and freshness of sources, the last entry of a node; unknown where it has none."""
    text = _texts(spark, path, lines)
    rows = text.select(F.posexplode(F.from_json(F.get_json_object("value", "$.results"), "array<struct<unique_id:string,node:string,status:string,freshness:string>>")).alias("at", "r"))
    named = rows.select("at", F.coalesce("r.unique_id", "r.node").alias("node"), F.coalesce("r.status", "r.freshness", F.lit("unknown")).alias("freshness"))
    return named.where("node <> ''").groupBy("node").agg(F.max_by("freshness", "at").alias("freshness"))


def hot_nodes(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """nodes with hot: the failing ones, or, if none fails, all that were executed."""
    ran = results.groupBy("node").agg(F.bool_or("failing").alias("failing"))
    any_fails = results.agg(F.coalesce(F.bool_or("failing"), F.lit(False)).alias("any"))  # one row
    j = nodes.join(ran, "node", "left").crossJoin(F.broadcast(any_fails))
    return j.withColumn("hot", F.when(F.col("any"), F.coalesce("failing", F.lit(False))).otherwise(F.col("failing").isNotNull())).drop("failing", "any")


def read_orchestration(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    """Edges (source, target) between tasks for kind airflow; else asset, kind, status, severity, failing.

    Tasks are named by their DAG and id, by the id alone where a file holds one DAG without a name. Failing are checks
    that did not pass, or warn. Looker files are text: the tables and fields they name are their assets.
    """
    text = _texts(spark, path, lines)

    def listed(kind: str, *keys: str) -> Column:
        """The first list there is: the file itself, or one under a key."""
        own = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<{kind}>"))
        return F.coalesce(own, *[F.from_json(F.get_json_object("value", f"$.{k}"), f"array<{kind}>") for k in keys])

    if kind == "airflow":
        task = "struct<task_id:string,id:string,upstream_task_ids:array<string>,upstream:array<string>,downstream_task_ids:array<string>>"
        dag = f"struct<dag_id:string,id:string,tasks:array<{task}>,downstream_map:map<string,array<string>>>"
        dags = text.select(F.explode(F.coalesce(listed(dag, "dags", "data"), F.array(F.from_json("value", dag)))).alias("d"))
        prefix = F.coalesce(F.concat(F.coalesce("d.dag_id", "d.id"), F.lit(".")), F.lit(""))
        tasks = dags.select(prefix.alias("p"), F.explode("d.tasks").alias("t")).select("p", F.coalesce("t.task_id", "t.id").alias("own"), "t.*")
        up = tasks.select("p", F.explode(F.coalesce("upstream_task_ids", "upstream")).alias("a"), F.col("own").alias("b"))
        down = tasks.select("p", F.col("own").alias("a"), F.explode("downstream_task_ids").alias("b"))
        mapped = dags.select(prefix.alias("p"), F.explode("d.downstream_map").alias("a", "bs")).select("p", "a", F.explode("bs").alias("b"))
        return up.unionByName(down).unionByName(mapped).where("a <> '' and b <> ''").select(F.concat("p", "a").alias("source"), F.concat("p", "b").alias("target")).distinct()
    if kind == "looker":
        tables = F.regexp_extract_all("value", F.lit(r"(?i)(?:sql_table_name|from)\s*:\s*([\w.\-]+)"), F.lit(1))
        fields = F.transform(F.regexp_extract_all("value", F.lit(r"\$\{([^}]+)\}"), F.lit(1)), lambda f: F.trim(f))
        rows = text.select(F.explode(F.concat(tables, fields)).alias("asset"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("severity"), F.lit(False).alias("failing"))
    elif kind == "dagster":
        rows = text.select(F.inline(listed("struct<asset_key:string,asset:string,asset_name:string,passed:boolean,severity:string,level:string>", "asset_checks", "checks")))
        severity = F.lower(F.coalesce("severity", "level"))
        bad = F.coalesce(~F.col("passed"), F.lit(False)) | F.coalesce(severity.isin("warn", "warning", "error", "critical"), F.lit(False))
        rows = rows.select(F.coalesce("asset_key", "asset", "asset_name").alias("asset"), F.when(F.col("passed"), "passed").when(~F.col("passed"), "failed").alias("status"), severity.alias("severity"), bad.alias("failing"))
    elif kind == "montecarlo":
        rows = text.select(F.inline(listed("struct<dataset:string,table:string,asset:string,full_table_name:string,name:string,status:string,severity:string,upstream_assets:array<string>,downstream_assets:array<string>>", "monitors", "alerts", "data")))
        names = F.array_compact(F.concat(F.array("dataset", "table", "asset", "full_table_name", "name"), *[F.coalesce(c, F.array().cast("array<string>")) for c in ("upstream_assets", "downstream_assets")]))
        rows = rows.select(F.explode(F.array_distinct(names)).alias("asset"), "status", F.lower("severity").alias("severity"), F.coalesce(F.lower("status").isin("firing", "failed", "alert", "error"), F.lit(False)).alias("failing"))
    else:
        raise ValueError(kind)
    return rows.where("asset <> ''").select("asset", F.lit(kind).alias("kind"), "status", "severity", "failing")


def read_topics(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Topics and fields of a contract file; see contracts.topic_diff for the columns.

    Topics are a map by name or a list with names, under topics or streams; so are the fields of a topic. Lists of types
    (with null for optional ones) are joined by a bar.
    """
    field = "struct<name:string,type:string,required:boolean,symbols:array<string>>"
    config, semantics = "struct<partition_key:string,retention_ms:bigint,idempotent:boolean>", "struct<event_time_field:string,lateness_tolerance_minutes:int>"
    topic = f"struct<name:string,topic:string,schema:struct<fields:string>,value_schema:struct<fields:string>,config:{config},topic_config:{config},semantics:{semantics},stream_semantics:{semantics},compatibility:string>"
    raw = _texts(spark, path, lines).select(F.coalesce(F.get_json_object("value", "$.topics"), F.get_json_object("value", "$.streams")).alias("j"))
    is_list = F.startswith(F.ltrim("j"), F.lit("["))
    named = raw.where(~is_list).select(F.explode(F.from_json("j", f"map<string,{topic}>")).alias("topic", "v"))
    listed = raw.where(is_list).select(F.posexplode(F.from_json("j", f"array<{topic}>")).alias("at", "v")).select(F.coalesce("v.name", "v.topic", F.concat(F.lit("topic_"), "at")).alias("topic"), "v")
    t = named.unionByName(listed).select("topic", "v.compatibility", F.coalesce("v.config", "v.topic_config").alias("c"), F.coalesce("v.semantics", "v.stream_semantics").alias("s"), F.coalesce("v.schema.fields", "v.value_schema.fields").alias("f"))
    topics = t.select("topic", F.col("s.event_time_field").alias("event_time"), F.col("s.lateness_tolerance_minutes").alias("lateness_min"), F.col("c.partition_key").alias("partition_key"), F.col("c.retention_ms").alias("retention_ms"), F.upper("compatibility").alias("compatibility"), F.coalesce("c.idempotent", F.lit(False)).alias("idempotent"))
    as_list = F.from_json("f", f"array<{field}>")
    as_map = F.transform(F.map_entries(F.from_json("f", f"map<string,{field}>")), lambda e: F.struct(e["key"].alias("name"), e["value"]["type"].alias("type"), e["value"]["required"].alias("required"), e["value"]["symbols"].alias("symbols")))
    fields = t.where("f is not null").select("topic", F.explode(F.when(F.startswith(F.ltrim("f"), F.lit("[")), as_list).otherwise(as_map)).alias("f")).where("f.name <> ''")
    kinds = F.from_json("f.type", "array<string>")
    kind = F.when(F.startswith("f.type", F.lit("[")), F.array_join(F.sort_array(kinds), "|")).otherwise(F.col("f.type"))
    return topics, fields.select("topic", F.col("f.name").alias("field"), kind.alias("type"), F.coalesce("f.required", F.lit(False)).alias("required"), "f.symbols")


def read_consumers(spark: SparkSession, path: str) -> DataFrame:
    """consumer, topic, required_fields, field_types, partition_key, event_time of the consumer contracts of a file."""
    row = "struct<consumer:string,name:string,topic:string,source_topic:string,required_fields:array<string>,field_types:map<string,string>,partition_key:string,event_time_field:string>"
    both = [F.from_json(F.get_json_object("value", f"$.{k}"), f"array<{row}>") for k in ("consumers", "consumer_contracts")]
    rows = spark.read.text(path, wholetext=True).select(F.inline(F.coalesce(*both)))
    return rows.select(F.coalesce("consumer", "name").alias("consumer"), F.coalesce("topic", "source_topic").alias("topic"), "required_fields", "field_types", "partition_key", F.col("event_time_field").alias("event_time")).where("topic is not null")


def read_registry(spark: SparkSession, path: str, value: T.StructType | str, lines: bool = False) -> DataFrame:
    """key and its values, from an object by name, alone or under nodes or models."""
    kind = f"map<string,{value if isinstance(value, str) else value.simpleString()}>"
    text = _texts(spark, path, lines)
    m = F.coalesce(*[F.from_json(F.get_json_object("value", k), kind) for k in ("$.nodes", "$.models", "$")])
    return text.select(F.explode(m).alias("key", "v")).select("key", "v.*")


def export_features(records: DataFrame) -> DataFrame:
    """One numeric row per scenario. records: scenario, confidence, risks map<string,double>."""
    v = F.map_values("risks")
    return records.select("scenario", F.col("confidence").cast("double").alias("confidence"), F.size(v).alias("risk_count"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("risk_sum"), F.coalesce(F.array_max(v), F.lit(0.0)).alias("risk_max"))


def project_mapping(df: DataFrame, mappings: list[tuple[str, str, float]], where: Column | None = None, sure: float = 0.8) -> DataFrame:
    """Columns renamed by (source, target, confidence); doubtful ones are filled with a mark where they are null."""
    d = df if where is None else df.where(where)
    mark = lambda s, t: F.coalesce(F.col(s).cast("string"), F.lit(f"MISSING_MAPPING_CHECK_{t}"))
    return d.select(*[(F.col(s) if c >= sure else mark(s, t)).alias(t) for s, t, c in mappings])


def reconcile(df: DataFrame, events: list[dict]) -> tuple[DataFrame, DataFrame]:
    """df after repairs (rename, cast, null stub, null guard), and per cast the rows whose value was lost by it."""
    lost = None
    for e in events:
        c = e["column"]
        if e["kind"] == "COLUMN_RENAMED":
            df = df.withColumnRenamed(e["to"], c)
        elif e["kind"] == "TYPE_CHANGED":
            bad = df.agg(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(e["to"]).isNull()).alias("lost_rows"))
            lost = bad if lost is None else lost.unionByName(bad)
            df = df.withColumn(c, F.col(c).try_cast(e["to"]))
        elif e["kind"] == "COLUMN_REMOVED":
            df = df.withColumn(c, F.lit(None).cast(e["to"]))
        elif e["kind"] == "NULLABLE_CHANGED":
            df = df.withColumn(c, F.coalesce(c, F.lit(e["to"])))
        else:
            raise ValueError(f"{e['kind']} is left to people")
    return df, lost if lost is not None else df.sparkSession.createDataFrame([], "column_name string, lost_rows long")
