"""Contracts of streams: topics, fields and consumers, before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "topic string, finding string, severity string, detail string"


def _found(cond: Column, finding: str, severity: str, detail: Column) -> Column:
    return F.when(cond, F.struct(F.lit(finding).alias("finding"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail")))


def topic_diff(before: DataFrame, after: DataFrame, fields_before: DataFrame, fields_after: DataFrame) -> DataFrame:
    """Findings (topic, finding, severity, detail) between two versions.

    Topics: topic, event_time, lateness_min, partition_key, retention_ms, compatibility, idempotent. Fields: topic,
    field, type, required, symbols.
    """
    ranks = F.create_map(*[F.lit(x) for kv in {"NONE": 0, "BACKWARD": 1, "FORWARD": 1, "FULL": 2}.items() for x in kv])
    cols = ["event_time", "lateness_min", "partition_key", "retention_ms", "compatibility", "idempotent"]
    side = lambda d, p: d.select("topic", F.struct(*cols).alias(p))
    j = side(before, "b").join(side(after, "a"), "topic", "full_outer")
    b, a = F.col("b"), F.col("a")
    both = b.isNotNull() & a.isNotNull()
    t = F.array_compact(F.array(
        _found(a.isNull(), "topic_removed", "critical", F.col("topic")), _found(b.isNull(), "topic_added", "low", F.col("topic")),
        _found(both & ~b["event_time"].eqNullSafe(a["event_time"]), "event_time_changed", "critical", a["event_time"]), _found(both & (a["lateness_min"] < b["lateness_min"]), "lateness_tightened", "high", a["lateness_min"]),
        _found(both & ~b["partition_key"].eqNullSafe(a["partition_key"]), "partition_key_changed", "critical", a["partition_key"]), _found(both & (a["retention_ms"] < b["retention_ms"]), "retention_reduced", "high", a["retention_ms"]),
        _found(both & (ranks[a["compatibility"]] < ranks[b["compatibility"]]), "compatibility_weakened", "medium", a["compatibility"]), _found(both & b["idempotent"] & ~a["idempotent"], "idempotence_disabled", "high", F.lit("")),
    ))
    out = j.select("topic", F.inline(t))
    common = before.select("topic").join(after.select("topic"), "topic")
    f = lambda d, p: d.join(common, "topic", "left_semi").select("topic", "field", F.struct("type", "required", "symbols").alias(p))
    k = f(fields_before, "b").join(f(fields_after, "a"), ["topic", "field"], "full_outer")
    gone = F.array_except(F.coalesce(b["symbols"], F.array()), F.coalesce(a["symbols"], F.array()))
    c = F.array_compact(F.array(
        _found(a.isNull(), "field_removed", "critical", F.col("field")), _found(b.isNull() & a["required"], "required_field_added", "high", F.col("field")),
        _found(both & (b["type"] != a["type"]), "field_type_changed", "critical", F.col("field")), _found(both & (F.size(gone) > 0), "enum_symbol_removed", "high", F.array_join(gone, ",")),
    ))
    return out.unionByName(k.select("topic", F.inline(c)))


def consumer_check(topics: DataFrame, fields: DataFrame, consumers: DataFrame) -> DataFrame:
    """Findings of consumers (consumer, topic, required_fields, field_types, partition_key, event_time) against their topics."""
    base = consumers.select("consumer", "topic", "required_fields", "field_types", F.col("partition_key").alias("want_key"), F.col("event_time").alias("want_time"))
    need = base.select("consumer", "topic", F.explode("required_fields").alias("field"))
    missing = need.join(fields.select("topic", "field"), ["topic", "field"], "left_anti").select("topic", F.lit("required_field_missing").alias("finding"), F.lit("critical").alias("severity"), F.concat_ws(".", "consumer", "field").alias("detail"))
    typed = base.select("consumer", "topic", F.explode("field_types").alias("field", "want")).join(fields.select("topic", "field", "type"), ["topic", "field"]).where("want <> type")
    typed = typed.select("topic", F.lit("type_mismatch").alias("finding"), F.lit("critical").alias("severity"), F.concat_ws(".", "consumer", "field").alias("detail"))
    j = base.join(topics.select("topic", "partition_key", "event_time"), "topic")
    rest = j.select("topic", F.inline(F.array_compact(F.array(_found(F.col("want_key") != F.col("partition_key"), "partition_key_mismatch", "high", F.col("consumer")), _found(F.col("want_time") != F.col("event_time"), "event_time_mismatch", "high", F.col("consumer"))))))
    return missing.unionByName(typed).unionByName(rest)


def streaming_verdict(findings: DataFrame) -> DataFrame:
    """Per topic: BLOCK if anything is critical, REQUIRE_REVIEW from two high findings, else ADVISORY; cost and hours."""
    s = F.col("severity")
    g = findings.groupBy("topic").agg(F.count("*").alias("findings"), F.count_if(s == "critical").alias("critical"), F.count_if(s == "high").alias("high"), F.sum(F.when(s == "critical", 2500).when(s == "high", 900).otherwise(250)).alias("cost"), F.sum(F.when(s == "critical", F.lit(6.0)).when(s == "high", 3.0).otherwise(1.5)).alias("hours"))
    return g.withColumn("verdict", F.when(F.col("critical") > 0, "BLOCK").when(F.col("high") >= 2, "REQUIRE_REVIEW").otherwise("ADVISORY"))
