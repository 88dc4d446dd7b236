"""Review evidence: findings joined with feedback and exceptions, and the tables that sum them up.

findings: occurrence_id, stable_id, family, source_id, severity, risk_score, business_severity, replay_ran,
replay_status, fidelity_score, receipt_day, monthly_cost. feedback: feedback_id, stable_finding_id, disposition.
exceptions: exception_id, scope, value, reason, expires_on. `now` is always given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .graph import lookup

BUSINESS_RANK = {"UNKNOWN": 0, "INTERNAL_LOW": 1, "INTERNAL_HIGH": 2, "CUSTOMER_FACING": 3, "REVENUE_CRITICAL": 4, "EXEC_CRITICAL": 5, "BOARD_CRITICAL": 6}
HIGH_BUSINESS = ["BOARD_CRITICAL", "EXEC_CRITICAL", "REVENUE_CRITICAL"]
DISPOSITION_ALIASES = {"agreed": "agree", "confirmed": "agree", "true_positive": "agree", "disagreed": "disagree", "fp": "false_positive", "noise": "false_positive", "noisy": "false_positive", "resolved": "fixed", "accepted": "accepted_risk", "accept_risk": "accepted_risk", "unsure": "needs_context", "unknown": "needs_context"}
DISPOSITIONS = ["agree", "disagree", "false_positive", "fixed", "accepted_risk", "needs_context", "duplicate"]
SEVERITY_POTENTIAL = {"primary_key_changed": 1.0, "grain_changed": 0.95, "required_column_removed": 0.9, "metric_formula_changed": 0.85, "join_cardinality": 0.75, "join_grain_or_fanout": 0.75, "enum_domain_closure": 0.7, "null_default_drift": 0.6, "type_changed": 0.55, "filter_changed": 0.5, "materialization_changed": 0.35, "freshness_changed": 0.3, "column_added": 0.1}
SENSITIVITY = {"REVENUE_CRITICAL": 1.0, "CUSTOMER_FACING": 0.8, "OPERATIONAL": 0.6, "ANALYTICAL": 0.35, "EXPERIMENTAL": 0.1, "UNKNOWN": 0.3, "BOARD_CRITICAL": 1.0, "EXEC_CRITICAL": 1.0, "INTERNAL_HIGH": 0.6, "INTERNAL_LOW": 0.35}
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
KEYWORDS = [("BOARD_CRITICAL", "board"), ("EXEC_CRITICAL", "exec"), ("REVENUE_CRITICAL", "revenue"), ("CUSTOMER_FACING", "customer"), ("INTERNAL_HIGH", "internal")]


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def normalize_disposition(c: Column) -> Column:
    clean = F.regexp_replace(F.lower(F.trim(c)), r"[-\s]+", "_")
    named = F.coalesce(*[F.when(clean == k, F.lit(v)) for k, v in DISPOSITION_ALIASES.items()], clean)
    return F.when(named.isin(DISPOSITIONS), named).otherwise("needs_context")


def freshness_state(ts: Column, now: Column, review_after: int = 14, stale_after: int = 30) -> Column:
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86400e6
    return F.when(age.isNull(), "unknown").when(age > stale_after, "stale").when(age > review_after, "review_due").otherwise("fresh")


def business_severity(df: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """df with business_severity: the registry's entry (key, severity) for the first key column that has one, else by keyword."""
    out = df
    for i, k in enumerate(keys):
        out = out.join(registry.select(F.col("key").alias(f"__k{i}"), F.col("severity").alias(f"__s{i}")), F.col(k) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
    text = F.lower(F.concat_ws(" ", *keys))
    word = F.coalesce(*[F.when(text.contains(w), F.lit(s)) for s, w in KEYWORDS], F.lit("UNKNOWN"))
    return out.withColumn("business_severity", F.coalesce(*[f"__s{i}" for i in range(len(keys))], word)).drop(*[f"__s{i}" for i in range(len(keys))])


def exception_status(reason: Column, expires: Column, now: Column) -> Column:
    return F.when(reason.isNull() | (F.trim(reason) == ""), "invalid").when(expires < now, "expired").otherwise("active")


def match_feedback(findings: DataFrame, feedback: DataFrame, keys: list[str]) -> DataFrame:
    """occurrence_id, feedback_id, disposition: a row of feedback matches any of a finding's keys, and counts once."""
    own = findings.select("occurrence_id", F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(k).cast("string") for k in keys])))).alias("k"))
    return own.join(feedback.select("feedback_id", "disposition", F.col("stable_finding_id").alias("k")), "k").select("occurrence_id", "feedback_id", "disposition").distinct()


#: Keys over which rows that meet everything are spread.
SALTS = 64


def match_exceptions(findings: DataFrame, exceptions: DataFrame, now: Column) -> DataFrame:
    """occurrence_id, exception_id, status. A finding's scopes are spread to rows, so the match is an equi-join.

    Exceptions of global scope meet all findings: each is copied to SALTS keys and each finding has one of them, so that no
    key holds all findings.
    """
    salt = lambda i: F.concat(F.lit("*"), i.cast("string"))
    scopes = F.array(*[F.struct(F.lit(s).alias("scope"), v.cast("string").alias("value")) for s, v in (("global", salt(F.pmod(F.xxhash64("occurrence_id"), F.lit(SALTS)))), ("stable_id", F.col("stable_id")), ("family", F.col("family")), ("source", F.col("source_id")), ("receipt", F.col("receipt_day")))])
    own = findings.select("occurrence_id", F.inline(scopes)).where("value is not null")
    everywhere = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), salt)
    value = F.explode(F.when(F.col("scope") == "global", everywhere).otherwise(F.array("value")))
    ex = exceptions.select("exception_id", "scope", value.alias("value"), exception_status(F.col("reason"), F.col("expires_on"), now).alias("status")).where("status <> 'invalid'")
    return own.join(ex, ["scope", "value"]).select("occurrence_id", "exception_id", "status").distinct()


COUNTED = ("agree", "fixed", "disagree", "false_positive", "accepted_risk", "needs_context")


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """Per stable_finding_id: rows of feedback (each once) and how many of them have each disposition."""
    once = feedback.select("feedback_id", "disposition", "stable_finding_id").distinct()
    return once.groupBy("stable_finding_id").agg(F.count("*").alias("feedback"), *[F.count_if(F.col("disposition") == d).alias(d) for d in COUNTED])


def exception_counts(exceptions: DataFrame, now: Column) -> DataFrame:
    """Per scope and value: active and expired exceptions, each once; invalid ones don't count."""
    status = exception_status(F.col("reason"), F.col("expires_on"), now)
    once = exceptions.select("exception_id", "scope", F.when(F.col("scope") == "global", "*").otherwise(F.col("value")).alias("value"), status.alias("status")).where("status <> 'invalid'").distinct()
    return once.groupBy("scope", "value").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "expired").alias("expired"))


def with_evidence(findings: DataFrame, feedback: DataFrame, exceptions: DataFrame, now: Column) -> DataFrame:
    """findings with counts of dispositions and exceptions.

    Both are counted per key before they are joined, so that each join has one row for a finding, however much feedback
    a stable id has gathered.
    """
    out = findings.join(feedback_counts(feedback).withColumnRenamed("stable_finding_id", "stable_id"), "stable_id", "left")
    per = exception_counts(exceptions, now)
    everywhere = per.where("scope = 'global'").agg(F.coalesce(F.sum("active"), F.lit(0)).alias("__a_global"), F.coalesce(F.sum("expired"), F.lit(0)).alias("__e_global"), F.lit("*").alias("__v_global"))
    out, parts = out.crossJoin(F.broadcast(everywhere)), ["global"]  # one row, since each of them counts for all findings
    for scope, value in (("stable_id", F.col("stable_id")), ("family", F.col("family")), ("source", F.col("source_id")), ("receipt", F.col("receipt_day"))):
        own = per.where(F.col("scope") == scope).select(F.col("value").alias(f"__v_{scope}"), F.col("active").alias(f"__a_{scope}"), F.col("expired").alias(f"__e_{scope}"))
        out = out.join(own, value.cast("string") == F.col(f"__v_{scope}"), "left")
        parts.append(scope)
    total = lambda k: sum((F.coalesce(f"__{k}_{s}", F.lit(0)) for s in parts), F.lit(0))
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("feedback", *COUNTED)} | {"active": total("a"), "expired": total("e")}
    return out.withColumns(counts).drop(*[f"__{k}_{s}" for k in "vae" for s in parts])


def review_state(evidence: DataFrame, ts: Column, now: Column) -> DataFrame:
    high = F.col("severity").isin("high", "critical") | (F.col("risk_score") >= 80) | F.col("business_severity").isin(HIGH_BUSINESS)
    out = evidence.withColumn("freshness", freshness_state(ts, now)).withColumn("high_risk", high)
    out = out.withColumn("needs_review", high & (F.col("feedback") == 0) & (F.col("active") == 0))
    return out.withColumn("stale_unreviewed", F.col("needs_review") & (F.col("freshness") != "fresh"))


def decay(evidence: DataFrame, now: Column, recurring: int = 2, stale_days: int = 30, due_days: int = 14) -> DataFrame:
    """Per stable_id: counters, signals, a score of 0 to 100, and the first state whose rule holds."""
    n = F.col("occurrences")
    g = evidence.groupBy("stable_id").agg(
        F.min("family").alias("family"), F.count("*").alias("occurrences"), F.max("receipt_day").alias("last_seen"), F.max("risk_score").alias("max_risk"),
        F.max(lookup(F.col("business_severity"), BUSINESS_RANK, 0)).alias("business_rank"), F.count_if(F.col("business_severity").isin(HIGH_BUSINESS)).alias("critical"),
        F.count_if("replay_ran").alias("replays"), F.count_if(F.col("replay_status") == "drift_detected").alias("drifts"),
        (F.sum(F.when(F.col("fidelity_score") > 0, F.col("fidelity_score")).cast("decimal(10,4)")).cast("double") / F.count_if(F.col("fidelity_score") > 0)).alias("fidelity"),
        *[F.sum(c).alias(c) for c in ("feedback", "agree", "fixed", "false_positive", "accepted_risk", "active", "expired")],
    )
    age = F.datediff(now, F.col("last_seen"))
    risky = (F.col("max_risk") >= 80) | (F.col("critical") > 0)
    signal = {
        "recurring_stable_assumption": n >= recurring, "recurring_replay_validated_drift": F.col("drifts") >= recurring, "repeated_accepted_risk": (F.col("active") >= 2) | (F.col("accepted_risk") >= 2),
        "expired_exception_debt": F.col("expired") > 0, "repeated_false_positive_feedback": F.col("false_positive") >= 2, "high_risk_unreviewed": (F.col("feedback") == 0) & risky,
        "stale_assumption_evidence": age >= stale_days, "review_due_assumption_evidence": (age >= due_days) & (age < stale_days), "low_fidelity_history": F.col("fidelity") < 0.5,
    }
    cap = lambda c, step, most: F.least(c * step, F.lit(most))
    score = cap(n, 8, 32) + cap(F.col("drifts"), 12, 36) + cap(F.col("active") + F.col("accepted_risk"), 8, 24) + F.col("expired") * 12 + F.when(F.col("critical") > 0, 18).otherwise(0)
    score = score + F.when(F.col("max_risk") >= 90, 12).when(F.col("max_risk") >= 75, 6).otherwise(0) + F.when(signal["high_risk_unreviewed"], 10).otherwise(0) - cap(F.col("false_positive"), 12, 36)
    drifting = signal["recurring_replay_validated_drift"]
    state = F.when(signal["repeated_false_positive_feedback"], "tune_or_suppress").when(signal["expired_exception_debt"], "review_expired_exception").when(drifting & (F.col("feedback") > 0), "decaying_high_confidence").when(drifting, "decaying_needs_feedback").when(signal["repeated_accepted_risk"], "accepted_risk_debt").when(signal["high_risk_unreviewed"], "needs_review").when(signal["recurring_stable_assumption"], "watch").otherwise("stable_or_insufficient_history")
    out = g.withColumn("signals", F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in signal.items()])))
    return out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score))).withColumn("state", state)


def decay_families(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("family").agg(F.count("*").alias("stable_ids"), F.sum("occurrences").alias("occurrences"), F.max("score").alias("max_score"), F.sum("drifts").alias("drifts"), F.sum("false_positive").alias("false_positive"), F.sum("accepted_risk").alias("accepted_risk"))


#: Patterns that belong on the watchlist.
WATCHED = ["validated_recurring_drift", "recurring_drift_needs_feedback", "expired_risk_memory", "accepted_risk_memory", "noisy_pattern", "high_risk_unvalidated"]


def memory(evidence: DataFrame, k: int = 25) -> DataFrame:
    """kind, key, counters, score, pattern and rank at five grains, the k highest scores of each.

    Grains: organization, family, source, business severity, and owner where evidence has an array `owners` (without one,
    or where it is empty, the owner is unknown). Spark ranks within each task before it shuffles, so a grain of many keys
    sends k rows a task.
    """
    owners = F.filter(F.array_distinct(F.transform("owners", lambda o: F.trim(o))), lambda o: o != "") if "owners" in evidence.columns else F.array().cast("array<string>")
    named = F.when(F.size(owners) > 0, owners).otherwise(F.array(F.lit("unknown")))
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    parts = None
    for kind, key in (("organization", F.lit("all")), ("family", F.col("family")), ("source_resource", F.col("source_id")), ("business_severity", F.col("business_severity")), ("owner_or_team", F.explode(named))):
        g = evidence.select("*", F.lit(kind).alias("kind"), key.alias("key")).groupBy("kind", "key").agg(
            F.count("*").alias("occurrences"), F.count_if(F.col("replay_status") == "drift_detected").alias("drifts"), F.max("risk_score").alias("max_risk"), F.count_if(F.col("business_severity").isin(HIGH_BUSINESS)).alias("critical"),
            count("monthly_cost").alias("cost"), count("feedback").alias("feedback"), count(F.col("agree") + F.col("fixed")).alias("validated"), *[count(c).alias(c) for c in ("false_positive", "accepted_risk", "expired")],
        )
        parts = g if parts is None else parts.unionByName(g)
    cap = lambda c, step, most: F.least(F.col(c) * step, F.lit(most))
    flag = lambda c, v: F.when(F.col(c) > 0, v).otherwise(0)
    score = cap("occurrences", 5, 25) + cap("drifts", 8, 32) + flag("critical", 14) + flag("cost", 12) + cap("validated", 8, 24) + cap("accepted_risk", 5, 15) + cap("expired", 10, 20) - cap("false_positive", 12, 30)
    drifting = F.col("drifts") / F.col("occurrences") >= 0.5
    noisy = (F.col("feedback") >= 2) & (F.col("false_positive") / F.col("feedback") >= 0.5)
    pattern = F.when(noisy, "noisy_pattern").when(F.col("expired") > 0, "expired_risk_memory").when(drifting & (F.col("validated") > 0), "validated_recurring_drift").when(drifting, "recurring_drift_needs_feedback")
    pattern = pattern.when(F.col("accepted_risk") >= 2, "accepted_risk_memory").when((F.col("feedback") == 0) & (F.col("max_risk") >= 80), "high_risk_unvalidated").otherwise("watch")
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("score"), F.desc("occurrences"), F.desc("drifts"), "key"))
    return parts.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score))).withColumn("pattern", pattern).withColumn("rank", rank).where(F.col("rank") <= k)


def memory_watchlist(rows: DataFrame, k: int = 25) -> DataFrame:
    """The k rows of memory that deserve a look, by score."""
    return rows.where(F.col("kind").isin("family", "source_resource", "owner_or_team") & F.col("pattern").isin(WATCHED)).orderBy(F.desc("score"), F.desc("occurrences"), "kind", "key").limit(k)


def precision_flags(evidence: DataFrame, most_nodes: int = 12) -> DataFrame:
    """evidence with flags, precision_state and exception_state of each finding.

    Besides the counts of with_evidence it needs trigger_count, blast_count, control_status and cost (null: none known).
    """
    noisy, useful = F.col("disagree") + F.col("false_positive") > 0, F.col("agree") + F.col("fixed") > 0
    drift, low, active = F.col("replay_status") == "drift_detected", F.col("fidelity_score") < 0.5, F.col("active") > 0
    minor = F.coalesce(F.col("business_severity").isin("UNKNOWN", "INTERNAL_LOW"), F.lit(True))
    untriggered, unreached, broad = F.col("trigger_count") < 1, F.col("blast_count") == 0, (F.col("blast_count") > most_nodes) & minor
    flags = {
        "missing_trigger_evidence": untriggered, "no_blast_radius": unreached, "overbroad_blast_radius": broad, "negative_developer_feedback": noisy, "active_exception_do_not_enforce": active, "developer_validated": useful,
        "cost_evidence_present": F.col("cost").isNotNull() | F.col("monthly_cost").isNotNull(), "business_critical": ~minor, "weak_control_coverage": F.col("control_status") == "weak",
        "replay_validated": F.col("replay_ran"), "inferred_only_no_replay": ~F.col("replay_ran"), "replay_drift_detected": drift, "low_replay_fidelity": low,
    }
    state = F.when(active | (F.col("accepted_risk") > 0), "accepted_risk_review").when(noisy, "needs_noise_review").when(untriggered | unreached, "insufficient_evidence").when(broad, "overbroad").when(drift & useful, "replay_validated_developer_validated")
    state = state.when(drift, "replay_validated_shadow").when(low, "low_fidelity_review").when(useful, "developer_validated").when(F.col("risk_score") >= 80, "high_signal_shadow").otherwise("shadow_unvalidated")
    exception = F.when(active, "active_exception").when(F.col("expired") > 0, "expired_exception").otherwise("none")
    return evidence.withColumns({"flags": F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()])), "precision_state": state, "exception_state": exception})


def precision_eval(flagged: DataFrame) -> DataFrame:
    """Per family: findings, with feedback, one counter a flag, and the action that follows. flagged: see precision_flags."""
    counted = {
        "validated": "developer_validated", "negative": "negative_developer_feedback", "untriggered": "missing_trigger_evidence", "unreached": "no_blast_radius", "broad": "overbroad_blast_radius", "excepted": "active_exception_do_not_enforce",
        "costed": "cost_evidence_present", "critical": "business_critical", "replayed": "replay_validated", "drifts": "replay_drift_detected", "inferred": "inferred_only_no_replay", "low": "low_replay_fidelity",
    }
    g = flagged.groupBy("family").agg(F.count("*").alias("findings"), F.count_if(F.col("feedback") > 0).alias("with_feedback"), *[F.count_if(F.array_contains("flags", f)).alias(c) for c, f in counted.items()])
    n = {c: F.col(c) > 0 for c in counted}
    action = F.when(n["drifts"] & n["validated"] & ~n["negative"], "advisory_candidate_replay_validated").when((F.col("inferred") == F.col("findings")) & (F.col("findings") >= 2), "add_replay_fixtures_before_policy").when(n["low"], "improve_replay_fidelity_before_policy")
    action = action.when(n["negative"] & (F.col("negative") / F.col("findings") >= 0.3), "tune_or_suppress_before_advisory").when(n["untriggered"] | n["unreached"], "improve_evidence_before_policy").when(n["broad"], "tighten_blast_radius_scope").when(n["excepted"], "keep_advisory_with_exception_review")
    return g.withColumn("action", action.when(n["validated"] & (n["costed"] | n["critical"]), "advisory_candidate_not_blocking").otherwise("continue_shadow_collect_feedback"))


def policy_calibration(evidence: DataFrame, run_count: int) -> DataFrame:
    """Per family: findings by disposition (each finding once a disposition), agreement and false-positive rates, action."""
    dispositions = ("agree", "fixed", "disagree", "false_positive", "accepted_risk", "needs_context")
    g = evidence.groupBy("family").agg(F.count("*").alias("findings"), F.sum("monthly_cost").alias("cost"), *[F.count_if(F.col(d) > 0).alias(d) for d in dispositions])
    total = sum((F.col(d) for d in dispositions), F.lit(0))
    g = g.withColumn("feedback", total)
    rate = lambda c: F.when(F.col("feedback") > 0, F.round(c / F.col("feedback"), 4))
    g = g.withColumns({"agree_rate": rate(F.col("agree") + F.col("fixed")), "fp_rate": rate(F.col("false_positive"))})
    paid = (F.col("fixed") >= 1) & (F.coalesce("cost", F.lit(0)) > 0)
    few = (F.col("feedback") < 2) | (F.lit(run_count) < 10)
    action = F.when((F.col("fp_rate") >= 0.4) & (F.col("feedback") >= 2), "lower_severity_or_suppress_candidate").when(paid & (F.col("feedback") >= 3) & (F.coalesce("fp_rate", F.lit(0)) <= 0.25), "require_review_candidate").when(paid, "advisory_candidate").when(few, "keep_shadow_collect_feedback")
    action = action.when((F.col("accepted_risk") >= 2) & (F.col("accepted_risk") >= F.col("agree") + F.col("fixed")), "accepted_risk_policy_review_candidate").when((F.col("agree_rate") >= 0.7) & (F.col("findings") >= 3), "advisory_candidate")
    return g.withColumn("action", action.otherwise("keep_shadow_collect_feedback"))


def calibration_readiness(calibration: DataFrame, stable: DataFrame, feedback: DataFrame, run_count: int) -> DataFrame:
    """One row: how far the evidence allows stricter modes. stable: stable_id, feedback."""
    once = feedback.select("feedback_id", "disposition").distinct()
    f = once.agg(F.count("*").alias("feedback"), F.count_if(F.col("disposition") == "agree").alias("agreed"), F.count_if(F.col("disposition") == "false_positive").alias("false_positive"))
    s = stable.agg(F.count_if(F.col("feedback") > 0).alias("recurring"))
    c = calibration.agg(F.count_if(F.col("action") == "require_review_candidate").alias("require"), F.count_if(F.col("action") == "advisory_candidate").alias("advisory"))
    j = f.crossJoin(s).crossJoin(c)  # one row each
    agreement = F.when(F.col("feedback") > 0, F.round(F.col("agreed") / F.col("feedback"), 4))
    noise = F.col("false_positive") >= F.greatest(F.lit(2), F.floor(F.col("feedback") / 3))
    state = F.when((F.lit(run_count) < 20) | (F.col("feedback") < 5), "shadow_only").when(noise, "tune_noise_before_enforcement").when((F.col("require") > 0) & (F.col("recurring") >= 2) & (agreement >= 0.7), "require_review_candidate_human_review_required")
    return j.withColumn("agreement_rate", agreement).withColumn("state", state.when((F.col("advisory") > 0) | (agreement >= 0.6), "advisory_candidate").otherwise("continue_shadow_calibration"))


def dashboard(evidence: DataFrame, dims: list[str]) -> DataFrame:
    """dimension, key, and per value of each dimension: findings, receipts, cost, and the cost of what was validated, fixed
    (avoided) and accepted as a risk. A finding counts once under each."""
    spread = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dims])
    costs = {"validated_cost": F.col("agree") + F.col("fixed") > 0, "avoided_cost": F.col("fixed") > 0, "accepted_cost": F.col("accepted_risk") > 0}
    rows = evidence.select("receipt_day", "monthly_cost", *[F.when(v, F.col("monthly_cost")).alias(k) for k, v in costs.items()], F.inline(spread))
    return rows.groupBy("dimension", "key").agg(F.count("*").alias("findings"), F.count_distinct("receipt_day").alias("receipts"), F.sum("monthly_cost").alias("cost"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in costs])


def replay_rollup(findings: DataFrame, low: float = 0.5) -> DataFrame:
    ran = F.col("replay_ran")
    g = findings.groupBy("family").agg(F.count("*").alias("findings"), F.count_if(ran).alias("ran"), F.count_if(F.col("replay_status") == "drift_detected").alias("drifts"), F.count_if(ran & (F.col("replay_status") != "drift_detected")).alias("ran_without_drift"), F.count_if(~ran).alias("not_run"), F.count_if((F.col("fidelity_score") < low) | (~ran & F.col("fidelity_score").isNull())).alias("low_fidelity"))
    return g.withColumn("coverage", F.col("ran") / F.col("findings")).withColumn("drift_rate", F.when(F.col("ran") > 0, F.col("drifts") / F.col("ran")))


def counted_map(counts: dict[str, Column]) -> Column:
    """Names and counts, without those that are zero."""
    return F.map_filter(F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), v)]), lambda k, v: v > 0)


def stable_findings(evidence: DataFrame) -> DataFrame:
    """Per stable id: counters, and maps of its findings by disposition (each once a disposition) and by confidence."""
    confidence = F.lower(F.col("confidence")) if "confidence" in evidence.columns else F.lit(None).cast("string")
    levels = ("high", "medium", "low")
    other = F.count_if(~F.coalesce(confidence.isin(*levels), F.lit(False)))
    return evidence.groupBy("stable_id").agg(
        F.count("*").alias("occurrences"), F.count_distinct("receipt_day").alias("receipts"), F.max("risk_score").alias("max_risk"), F.max(lookup(F.col("severity"), SEVERITY_RANK, 0)).alias("severity_rank"), F.sum("monthly_cost").alias("cost"), F.sum("feedback").alias("feedback"),
        counted_map({d: F.count_if(F.col(d) > 0) for d in COUNTED}).alias("dispositions"), counted_map({c: F.count_if(confidence == c) for c in levels} | {"unknown": other}).alias("confidences"),
    )


def blast_node_rollup(hits: DataFrame) -> DataFrame:
    """Per node that is hit: findings, a map of findings by family (families are few), cost. hits: node, family, monthly_cost."""
    per = hits.groupBy("node", F.coalesce("family", F.lit("unknown")).alias("family")).agg(F.count("*").alias("n"), F.sum("monthly_cost").alias("c"))
    return per.groupBy("node").agg(F.sum("n").alias("findings"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("family", "n")))).alias("families"), F.sum("c").alias("cost"))


def business_rollup(findings: DataFrame, by: str) -> DataFrame:
    rank = lookup(F.col("business_severity"), BUSINESS_RANK, 0)
    return findings.groupBy(by).agg(F.count("*").alias("nodes"), F.max_by("business_severity", rank).alias("highest"), F.count_if(F.col("business_severity").isin(HIGH_BUSINESS)).alias("critical"))


#: What is enforced at each tier, beside what depends on the risks seen (fixed values).
RISK_CLASSES = ["financial_blowup", "semantic_break", "critical_assumption", "runtime_fragility"]
LOW_CLASSES = ["low_confidence_semantic", "low_confidence_assumption", "optimization_only"]


def shadow_rollup(runs: DataFrame, feedback: DataFrame, scopes: tuple[str, ...] = ("repo", "team"), patterns: int = 8) -> DataFrame:
    """Per scope (global, and each of the given columns) and value: how runs went, what recurs, and how far enforcement may go.

    runs: the scope columns, verdict, confidence, primary_reason, would_block, would_review, assumptions,
    critical_assumptions, savings, weekly_cost, monthly_cost (decimals), risk_categories and patterns (arrays). feedback:
    the scope columns, outcome. Values without a name count as unknown_<scope>; values with feedback only are kept. Rows
    are counted by scope, kind and key in parts before anything is gathered, so gathered are counts; of waste
    patterns only the `patterns` most frequent of a value are, the first by name of equals.
    """
    named = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", f"unknown_{c}").otherwise(F.col(c))
    spread = F.explode(F.array(F.struct(F.lit("global").alias("scope"), F.lit("all").alias("value")), *[F.struct(F.lit(c).alias("scope"), named(c).alias("value")) for c in scopes]))
    key = ["scope", "value"]
    r = runs.select("*", spread.alias("__s")).select("__s.*", *[c for c in runs.columns if c not in key])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = r.groupBy(*key).agg(F.count("*").alias("runs"), F.count_if("would_block").alias("blocked"), F.count_if("would_review").alias("reviewed"), F.count_if(F.lower("confidence") == "high").alias("high_confidence"), total("assumptions").alias("assumptions"), total("critical_assumptions").alias("critical_assumptions"), *[total(c).alias(c) for c in ("savings", "weekly_cost", "monthly_cost")])
    one = lambda c, other: F.array(F.coalesce(F.col(c), F.lit(other)))
    kinds = {"verdicts": one("verdict", "UNKNOWN"), "confidences": one("confidence", "unknown"), "reasons": one("primary_reason", "unknown"), "categories": F.col("risk_categories"), "patterns": F.col("patterns")}

    def of_kind(kind: str, names: Column) -> Column:
        return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    long = F.explode(F.flatten(F.array(*[of_kind(k, v) for k, v in kinds.items()])))
    counts = r.select(*key, long.alias("k")).groupBy(*key, "k.kind", "k.name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("n"), "name"))
    top = counts.where("kind = 'patterns'").withColumn("rank", rank).where(F.col("rank") <= patterns).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", "name", "n"))).alias("__top")).select(*key, F.transform("__top", lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n"))).alias("top_patterns"))
    others = counts.where("kind <> 'patterns'").groupBy(*key)
    maps = others.agg(*[F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.struct("name", "n"))))).alias(k) for k in kinds if k != "patterns"])
    fb = feedback.select("outcome", spread.alias("__s")).select("__s.*", F.coalesce("outcome", F.lit("unknown")).alias("outcome")).groupBy(*key, "outcome").agg(F.count("*").alias("n"))
    said = lambda *o: F.coalesce(F.sum(F.when(F.col("outcome").isin(*o), F.col("n"))), F.lit(0))
    fb = fb.groupBy(*key).agg(F.sum("n").alias("feedback"), said("confirmed", "useful", "fixed").alias("confirmed"), said("noisy", "false_positive").alias("noisy"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"))
    j = sums.join(maps, key, "left").join(top, key, "left").join(fb, key, "full_outer")
    zeros = ("runs", "blocked", "reviewed", "high_confidence", "assumptions", "critical_assumptions", "savings", "weekly_cost", "monthly_cost", "feedback", "confirmed", "noisy")
    j = j.withColumns({c: F.coalesce(c, F.lit(0)) for c in zeros})
    of = lambda c, digits: F.round(F.col(c) / F.greatest("runs", F.lit(1)), digits)
    j = j.withColumns({"block_rate": of("blocked", 4), "review_rate": of("reviewed", 4), "average_assumptions": of("assumptions", 2), "average_critical": of("critical_assumptions", 2), "precision": F.round(F.col("confirmed") / F.greatest(F.col("confirmed") + F.col("noisy"), F.lit(1)), 4)})
    return enforcement(j)


def enforcement(rollup: DataFrame) -> DataFrame:
    """A rollup with tier, reasons and the policy of that tier: hard_block, require_review, advisory."""
    n, p, critical, saved = F.col("runs"), F.col("precision"), F.col("critical_assumptions"), F.col("savings")
    blocks, reviews = F.col("blocked") / F.greatest(n, F.lit(1)), F.col("reviewed") / F.greatest(n, F.lit(1))
    selective = (p >= 0.8) & (F.col("high_confidence") >= 2) & ((saved >= 500) | (critical >= 2)) & (blocks <= 0.8)
    review = (p >= 0.65) & ((F.col("reviewed") >= 2) | (critical >= 1) | (saved >= 250))
    tier = F.when((n < 3) | (p < 0.5), 0).when(selective, 3).when(review, 2).otherwise(1)
    why = F.when(n < 3, "too_few_runs").when(p < 0.5, "precision_below_half").when(selective, "precise_and_material").when(review, "recurring_or_costly").otherwise("advisory_until_more_evidence")
    reasons = F.array_compact(F.array(why, F.when((blocks > 0.8) & (n >= 3), "blocks_too_often"), F.when((reviews > 0.9) & (n >= 3), "reviews_too_broad")))
    out = rollup.withColumns({"tier": tier, "enforcement_reasons": reasons})
    t = F.col("tier")
    seen = lambda *k: F.coalesce(F.exists(F.map_keys("categories"), lambda x: x.isin(*k)), F.lit(False))
    texts = lambda names: F.array(*[F.lit(x) for x in names]).cast("array<string>")
    hard = F.array_compact(F.array(F.when((t == 3) & seen("financial"), "high_confidence_financial_blowup"), F.when((t == 3) & seen("assumptions", "semantic"), "high_confidence_semantic_or_assumption_break")))
    ask = F.when(t == 3, texts(["medium_confidence_semantic", "critical_assumption_without_runtime_proof"])).when(t == 2, texts(RISK_CLASSES)).otherwise(texts([]))
    advise = F.when(t == 1, texts(LOW_CLASSES + RISK_CLASSES)).otherwise(texts(LOW_CLASSES))
    names = F.array(*[F.lit(x) for x in ("TIER_0_SHADOW_ONLY", "TIER_1_ADVISORY", "TIER_2_REQUIRE_REVIEW", "TIER_3_SELECTIVE_BLOCK")])
    return out.withColumns({"hard_block": hard, "require_review": ask, "advisory": advise}).withColumn("tier", F.element_at(names, t + 1))


def period_trends(runs: DataFrame, ts: str) -> DataFrame:
    """kind (week, month), period, runs; times that can't be read have the period null."""
    t = F.col(ts)
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))
    both = F.array(F.struct(F.lit("week").alias("kind"), week.alias("period")), F.struct(F.lit("month").alias("kind"), F.date_format(t, "yyyy-MM").alias("period")))
    return runs.select(F.inline(both)).groupBy("kind", "period").agg(F.count("*").alias("runs"))


def ledger_summaries(feedback: DataFrame, exceptions: DataFrame, now: Column, soon: int = 14) -> DataFrame:
    """kind, key, n: feedback by disposition, exceptions by scope and status, and those that expire within `soon` days."""
    s = exceptions.withColumn("status", exception_status(F.col("reason"), F.col("expires_on"), now))
    named = lambda d, kind, key: d.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"))
    all_rows = named(feedback, "disposition", "disposition").unionByName(named(s, "scope", "scope")).unionByName(named(s, "status", "status"))
    all_rows = all_rows.unionByName(named(s.where((F.col("status") == "active") & (F.datediff("expires_on", now) <= soon)), "expiring", "scope"))
    return count_by(all_rows, "kind", "key")


def evidence_summary(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("family", "severity").agg(F.count("*").alias("findings"), F.sum("false_positive").alias("false_positive"), F.sum("agree").alias("agreed"))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key by the order columns, without a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("r")).select(*keys, "r.*")


def attach_latest(calibrations: DataFrame, findings: DataFrame) -> DataFrame:
    """Calibrations with the newest finding of their stable_id."""
    last = latest_per_key(findings.select("stable_id", "occurrence_id", "receipt_day"), ["stable_id"], ["receipt_day", "occurrence_id"])
    return calibrations.join(last, calibrations["stable_finding_id"] == last["stable_id"], "left").drop("stable_id")


def compare_receipts(left: DataFrame, right: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """key, metric, before, after of shared receipts whose metric differs."""
    rows = lambda d, n: d.select(key, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(n)) for m in metrics])))
    return rows(left, "before").join(rows(right, "after"), [key, "metric"]).where(~F.col("before").eqNullSafe(F.col("after")))


def receipt_changes(left: DataFrame, right: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Per shared receipt: both verdicts, freshness states and confidences, whether verdict and freshness changed, and the
    metrics that differ, as names and as a map to both values. Needs verdict, freshness and confidence beside the metrics."""
    told = ["verdict", "freshness", "confidence"]
    side = lambda d, p: d.select(key, *[F.col(c).alias(f"{p}_{c}") for c in told], *[F.col(m).cast("double").alias(f"__{p}_{m}") for m in metrics])
    j = side(left, "left").join(side(right, "right"), key)
    pair = lambda m: F.struct(F.lit(m).alias("metric"), F.struct(F.col(f"__left_{m}").alias("left"), F.col(f"__right_{m}").alias("right")).alias("values"))
    other = lambda m: ~F.col(f"__left_{m}").eqNullSafe(F.col(f"__right_{m}"))
    deltas = F.array_compact(F.array(*[F.when(other(m), pair(m)) for m in metrics]))
    changed = {f"{c}_changed": ~F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")) for c in ("verdict", "freshness")}
    return j.withColumns(changed | {"changed_fields": deltas["metric"], "deltas": F.map_from_entries(deltas)}).drop(*[f"__{p}_{m}" for p in ("left", "right") for m in metrics])


def positions(df: DataFrame, by: str, order: list[Column | str], name: str = "pos") -> DataFrame:
    """df with the place of each row within its key, from 1. Rows are dealt by ranges of key and order, so that a hot key
    lies in many tasks; each range goes on from the rows of the key's earlier ranges. A null key is a key."""
    # written once, since the ranges are read twice and must not be dealt anew
    rows = cut(df.repartitionByRange(by, *order).withColumn("__p", F.spark_partition_id()).withColumn("__k", F.struct(by)))
    counts = rows.groupBy("__k", "__p").agg(F.count("*").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(W.partitionBy("__k").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__k", "__p", earlier.alias("__start"))
    within = F.row_number().over(W.partitionBy("__k", "__p").orderBy(*order))
    return rows.join(starts, ["__k", "__p"]).withColumn(name, (F.col("__start") + within).cast("int")).drop("__k", "__p", "__start")


def positional_compare(current: DataFrame, baseline: DataFrame, by: str, order: str, tolerance: int = 3) -> DataFrame:
    """Findings of a receipt compared by position: family must be equal, risk within the tolerance."""
    rows = lambda d, p: positions(d.select(by, order, "family", "risk_score"), by, [order]).select(by, "pos", F.col("family").alias(f"{p}_family"), F.col("risk_score").alias(f"{p}_risk"))
    j = rows(current, "now").join(rows(baseline, "was"), [by, "pos"], "full_outer")
    same = (F.col("now_family") == F.col("was_family")) & (F.abs(F.col("now_risk") - F.col("was_risk")) <= tolerance)
    return j.withColumn("matches", F.coalesce(same, F.lit(False)))


def rank_hypotheses(scored: DataFrame, by: str, floor: float = 0.34) -> DataFrame:
    """score, rank and role of a receipt's findings.

    Eligible are those with a change event, some specificity and a score of at least `floor`. The first of them is
    primary, the others secondary; of the rest, scores from 0.12 are advisory. Without an eligible one all of the
    receipt are suppressed.
    """
    s = 0.35 * F.col("specificity") + 0.25 * F.col("dependency") + 0.2 * F.col("fidelity_score") + 0.2 * F.col("actionability")
    out = scored.withColumn("score", F.round(F.when(F.col("has_event"), s).otherwise(F.least(s, F.lit(floor))), 9))
    eligible = F.col("has_event") & (F.col("specificity") > 0) & (F.col("score") >= floor)
    first = out.where(eligible).groupBy(by).agg(F.min(F.struct(-F.col("score"), F.col("occurrence_id").alias("id")))["id"].alias("__first"))
    out = out.join(first, by, "left")
    role = F.when(F.col("__first").isNull(), "suppressed").when(F.col("occurrence_id") == F.col("__first"), "primary").when(eligible, "secondary").when(F.col("score") >= 0.12, "advisory").otherwise("suppressed")
    return positions(out.withColumn("role", role).drop("__first"), by, [F.desc("score"), "occurrence_id"], "rank")


def recent_n(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    r = F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("recency", r).where(F.col("recency") <= n)


def dedupe_findings(findings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One finding per key: the highest severity, of those the first."""
    rest = [c for c in findings.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(lookup(F.col("severity"), SEVERITY_RANK, 0), -F.col(order)))
    return findings.groupBy(*keys).agg(best.alias("r")).select(*keys, "r.*")


def top_findings(findings: DataFrame, k: int = 10) -> DataFrame:
    return findings.orderBy(F.desc("risk_score"), "family", "occurrence_id").limit(k)


#: Families whose dependence must be on the property itself, and how far a change carries by its distance (fixed values).
STRUCTURAL_FAMILIES = ["join_cardinality", "join_grain_or_fanout", "grain_change", "primary_key_changed"]
PROPAGATION = {0: 0.85, 1: 1.0, 2: 0.8, 3: 0.6}
FAR, NO_DEPENDENCY = 0.35, 0.2
REPLAY_FACTOR = {"drift_detected": 1.2, "confirmed": 1.2, "replay_confirmed": 1.2, "no_drift": 0.5, "clean": 0.5, "failed": 0.6, "error": 0.6}


def sensitivity_label(c: Column) -> Column:
    """Labels in upper case, with plain grades named as what they stand for."""
    up = F.upper(F.coalesce(c, F.lit("UNKNOWN")))
    return F.when(up == "HIGH", "REVENUE_CRITICAL").when(up == "MEDIUM", "OPERATIONAL").when(up == "LOW", "ANALYTICAL").otherwise(up)


def dependency_signals(reached: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """source_id, structural, label, distance, confidence, kind: what depends on a changed source, for structural families and for others.

    reached: source_id, node, depth (as graph.reach gives them), sensitivity, and contract, whether the node relies on the
    source's keys or grain: only such nodes prove anything for structural families. own: source_id, sensitivity,
    has_contracts of sources themselves, which count where nothing is reached. The most sensitive node counts, of equals the nearest;
    those less sensitive than unknown ones don't.
    """
    label = sensitivity_label(F.col("sensitivity"))
    weight = lookup(label, SENSITIVITY, SENSITIVITY["UNKNOWN"])
    r = reached.select("source_id", F.coalesce("contract", F.lit(False)).alias("contract"), label.alias("label"), weight.alias("weight"), F.col("depth").alias("distance")).where(F.col("weight") >= SENSITIVITY["UNKNOWN"])
    best = F.max(F.struct("weight", (-F.col("distance")).alias("near"), "label")).alias("b")
    structural = r.where("contract").groupBy("source_id").agg(best).withColumn("structural", F.lit(True))
    plain = r.groupBy("source_id").agg(best).withColumn("structural", F.lit(False))
    d = -F.col("b.near")
    sure = F.when(F.col("structural"), F.when(d <= 1, 0.6).otherwise(0.45)).otherwise(F.when(d <= 1, 0.8).when(d <= 2, 0.65).otherwise(0.45))
    kind = F.when(F.col("structural"), "contract").otherwise("downstream")
    out = structural.unionByName(plain).select("source_id", "structural", "b.label", d.alias("distance"), sure.alias("confidence"), kind.alias("kind"))
    if own is None:
        return out
    mine = own.select("source_id", sensitivity_label(F.col("sensitivity")).alias("label"), F.coalesce("has_contracts", F.lit(False)).alias("has"))
    mine = mine.join(out.where("not structural").select("source_id"), "source_id", "left_anti").where(F.col("has") | (lookup(F.col("label"), SENSITIVITY, 0.3) > SENSITIVITY["UNKNOWN"]))
    return out.unionByName(mine.select("source_id", F.lit(False).alias("structural"), "label", F.lit(0).alias("distance"), F.when(F.col("has"), 0.8).otherwise(0.55).alias("confidence"), F.when(F.col("has"), "own_contract").otherwise("own").alias("kind")))


def change_confidence(family: Column, sure: Column, has_diff: Column, triggered: Column, excerpt: Column, structural: Column) -> Column:
    """How surely the finding itself shows a change; null if it doesn't. Structural families must show one of keys, grain or joins."""
    low = F.coalesce(F.lower(sure), F.lit(""))
    grade = lambda high, medium, least: F.when(low == "high", high).when(low == "low", least).otherwise(medium)
    known = F.when(has_diff, grade(0.85, 0.75, 0.65)).when(triggered, grade(0.7, 0.6, 0.5)).when(excerpt, grade(0.55, 0.55, 0.4))
    return F.when(~(family.isin(STRUCTURAL_FAMILIES) & ~F.coalesce(structural, F.lit(False))), known)


def causality(findings: DataFrame, dependencies: DataFrame | None = None, calibration: DataFrame | None = None) -> DataFrame:
    """findings with two_signal, propagation, evidence, replay_factor, causality and where it sends them (route).

    findings: family, source_id, change_confidence (see above; null: no change shown), blast_count and business_severity
    (its own reach, which counts as one step away), replay_status. dependencies: as dependency_signals gives them; of the
    two the more sensitive counts. calibration: family, false_positive_rate. A change shown and a dependency known make a
    two-signal finding; one of them alone is weak evidence.
    """
    family = F.coalesce("family", F.lit(""))
    f = findings.withColumn("__structural", family.isin(STRUCTURAL_FAMILIES))
    if dependencies is not None:
        d = dependencies.select("source_id", F.col("structural").alias("__structural"), F.struct("label", "distance", "confidence", "kind").alias("__d"))
        f = f.join(d, ["source_id", "__structural"], "left")
    else:
        f = f.withColumn("__d", F.lit(None).cast("struct<label:string,distance:int,confidence:double,kind:string>"))
    weight = lambda c: lookup(c, SENSITIVITY, SENSITIVITY["UNKNOWN"])
    label = sensitivity_label(F.col("business_severity"))
    blast = F.coalesce(F.col("blast_count"), F.lit(0)) > 0
    by_blast = blast & (F.col("__d").isNull() | (weight(label) >= weight(F.col("__d.label"))))
    found = by_blast | F.col("__d").isNotNull()
    distance = F.when(by_blast, 1).otherwise(F.col("__d.distance"))
    # known only from lineage, not from a contract or the finding's own reach
    drawn = F.when(~by_blast & F.col("__d.kind").isin("downstream", "own"), 0.9).otherwise(1.0)
    carries = F.when(found, F.when(distance <= 0, PROPAGATION[0]).otherwise(lookup(distance, {k: v for k, v in PROPAGATION.items() if k}, FAR)) * drawn).otherwise(NO_DEPENDENCY)
    sure, change = F.when(by_blast, 0.85).otherwise(F.col("__d.confidence")), F.col("change_confidence")
    two = change.isNotNull() & found
    most = 0.85 if dependencies is not None else 0.7
    least = 0.65 if dependencies is not None else 0.55
    evidence = F.when(two, F.least(F.lit(most), F.greatest(F.lit(least), (change + sure) / 2))).when(change.isNotNull() | found, F.least(F.lit(0.45), F.greatest(change, sure, F.lit(0.25)))).otherwise(0.0)
    replay = lookup(F.lower(F.coalesce("replay_status", F.lit(""))), REPLAY_FACTOR, 0.85)
    sensitive = weight(F.when(by_blast, label).when(found, F.col("__d.label")).otherwise("UNKNOWN"))
    f = f.withColumns({"two_signal": two, "propagation": carries, "evidence": evidence, "replay_factor": replay, "__raw": F.least(F.lit(1.0), carries * lookup(family, SEVERITY_POTENTIAL, 0.35) * sensitive * evidence * replay)})
    if calibration is not None:
        f = f.join(calibration.select("family", F.col("false_positive_rate").alias("__fp")), "family", "left")
    wrong = F.least(F.lit(0.95), F.greatest(F.lit(0.0), F.coalesce("__fp", F.lit(0.0)))) if calibration is not None else F.lit(0.0)
    out = f.withColumn("causality", F.col("__raw") * (1 - wrong))
    c = F.col("causality")
    route = F.when(c < 0.05, "suppressed").when(c < 0.15, "informational").when(c < 0.4, F.when(F.col("two_signal") & (c >= 0.35), "must_review").otherwise("advisory")).when(c < 0.65, "must_review").otherwise("must_review_escalated")
    return out.withColumn("route", route).drop("__structural", "__d", "__raw", *(["__fp"] if calibration is not None else []))


def finding_severity(base: Column, business: Column, downstream: Column) -> Column:
    """Rank of the base severity, one more for business weight and one for findings downstream, four at most."""
    up = F.when(business.isin(HIGH_BUSINESS + ["CUSTOMER_FACING"]), 1).otherwise(0) + F.when(downstream, 1).otherwise(0)
    rank = F.least(F.lit(4), lookup(base, SEVERITY_RANK, 1) + up)
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITY_RANK]), rank.cast("int"))


def risk_score(severity: Column, blast: Column, critical: Column, costed: Column) -> Column:
    return F.least(F.lit(100), lookup(severity, SEVERITY_RANK, 1) * 25 + F.least(blast, F.lit(5)) * 5 + F.when(critical, 15).otherwise(0) + F.when(costed, 10).otherwise(0))


#: Weights of business classes, of confidence and of replay states (fixed values).
REVIEW_BUSINESS = {"REVENUE_CRITICAL": 1.0, "FINANCE_CRITICAL": 1.0, "CUSTOMER_FACING": 0.8, "CUSTOMER_CRITICAL": 0.8, "OPERATIONAL": 0.6, "INTERNAL_ONLY": 0.4, "UNKNOWN_CONFIRMED": 0.35, "UNKNOWN": 0.3, "NONE": 0.3, "": 0.3}
REVIEW_CONFIDENCE = {"high": 1.0, "medium": 0.65, "low": 0.35}
REPLAY_WEIGHT = {"passed": 1.0, "validated": 1.0, "drift_detected": 1.0, "failed": 0.6, "failed_to_confirm": 0.6, "error": 0.75, "unavailable": 0.75}


def review_priority(findings: DataFrame) -> DataFrame:
    """findings with score (0 to 100), band, tier, caps and floors: how far a finding reaches and matters, times how well
    it is supported; half-even rounding.

    Needs blast_count, business_severity, confidence, replay_ran, replay_status, fidelity_score and has_diff (whether
    before and after were compared).
    """
    blast, business, sure = F.coalesce("blast_count", F.lit(0)), F.upper(F.coalesce("business_severity", F.lit(""))), F.lower(F.coalesce("confidence", F.lit("")))
    status, ran = F.lower(F.coalesce("replay_status", F.lit(""))), F.coalesce("replay_ran", F.lit(False))
    proven = status.isin("passed", "validated", "drift_detected") | ran
    tier = F.when(proven, 3).when(F.coalesce("has_diff", F.lit(False)), 2).when(F.col("fidelity_score").isNotNull(), 1).otherwise(0)
    fidelity = F.element_at(F.array(*[F.lit(x) for x in (0.4, 0.65, 0.8, 1.0)]), tier + 1)
    reach = F.when(blast <= 0, 0.10).otherwise(F.least(F.lit(1.0), F.log10(blast + 1) / F.log10(F.lit(51.0))))
    impact = reach * lookup(business, REVIEW_BUSINESS, 0.6)
    support = fidelity * lookup(sure, REVIEW_CONFIDENCE, 0.5) * F.when(proven, 1.0).otherwise(lookup(status, REPLAY_WEIGHT, 0.85))
    out = findings.withColumns({"tier": tier, "score": F.rint(100 * impact * support)})
    tier, low, local = F.col("tier"), sure == "low", blast == 0
    limits, caps = [F.col("score")], []
    for name, when, most in (("tier_below_2_cap_80", tier < 2, 80.0), ("no_confirmed_blast_cap_60", local, 60.0), ("low_confidence_cap_50", low, 50.0), ("low_confidence_no_blast_cap_35", low & local, 35.0)):
        caps.append(F.when(when & (F.least(F.lit(100.0), *limits) > most), F.lit(name)))
        limits.append(F.when(when, most))
    out = out.withColumns({"caps": F.array_compact(F.array(*caps)), "score": F.least(F.lit(100.0), *limits)})
    score = F.col("score")
    money, people, high = business.isin("REVENUE_CRITICAL", "FINANCE_CRITICAL"), business.isin("CUSTOMER_FACING", "CUSTOMER_CRITICAL"), sure == "high"
    floor = F.when(money & high & (blast > 0) & (score < 45), F.struct(F.lit("revenue_high_confidence_blast_floor_45").alias("name"), F.lit(45.0).alias("least")))
    floor = floor.when(people & high & (blast > 0) & (score < 35), F.struct(F.lit("customer_high_confidence_blast_floor_35").alias("name"), F.lit(35.0).alias("least")))
    floor = floor.when(money & high & (score < 35), F.struct(F.lit("revenue_high_confidence_floor_35").alias("name"), F.lit(35.0).alias("least")))
    out = out.withColumns({"floor": floor["name"], "score": F.coalesce(floor["least"], score).cast("int")})
    band = F.when(score >= 80, "block candidate").when(score >= 65, "review strongly recommended").when(score >= 45, "review recommended").when(score >= 25, "advisory").otherwise("informational")
    return out.withColumn("band", band)


def fidelity(replayed: Column, text: Column, cataloged: Column, timed: Column, reached: Column, costed: Column, triggered: Column, detailed: Column) -> Column:
    """struct(score, level) of the evidence there is. text: compiled, raw or null; costed: history, estimate or null."""
    add = lambda cond, v: F.when(cond, v).otherwise(0.0)
    s = 0.20 + add(replayed, 0.18) + F.when(text == "compiled", 0.16).when(text == "raw", 0.08).otherwise(0.0) + add(cataloged, 0.10) + add(timed, 0.10) + add(reached, 0.12) + F.when(costed == "history", 0.14).when(costed == "estimate", 0.08).otherwise(0.0) + add(triggered, 0.10) + add(detailed, 0.06)
    s = F.round(F.least(F.lit(0.95), s), 2)
    return F.struct(s.alias("score"), F.when(s >= 0.78, "high_static_history_fidelity").when(s >= 0.55, "medium_static_fidelity").otherwise("low_static_fidelity").alias("level"))


def control_coverage(family: Column, tested: Column, costed: Column, dedup: Column, has_else: Column) -> Column:
    """struct(status, present, missing): the controls that a finding's resource has, and those its family asks for."""
    pick = lambda d: F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in d.items()]))
    present = pick({"test_or_uniqueness_hint": tested, "cost_profile": costed, "dedup_hint": dedup})
    missing = pick({"grain_test": ~tested & (family == "join_cardinality"), "cost_profile": ~costed & family.isin("incremental_filter", "materialization_cost"), "else_branch": ~has_else & (family == "enum_domain_closure"), "null_rate_check": family == "null_default_fallback", "bucket_comparison": family == "temporal_bucket"})
    status = F.when((F.size(present) > 0) & (F.size(missing) == 0), "covered").when(F.size(present) > 0, "partial").otherwise("weak")
    return F.struct(status.alias("status"), present.alias("present"), missing.alias("missing"))


def scenario_report(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Scenarios and whether their expected family was found. expected: scenario, family; found: scenario, family."""
    hit = found.select("scenario", "family").distinct().withColumn("passed", F.lit(True))
    return expected.join(hit, ["scenario", "family"], "left").withColumn("passed", F.coalesce("passed", F.lit(False)))


def bundle_summary(items: DataFrame) -> DataFrame:
    """Per run: pieces of evidence by kind, and the stages seen (a small fixed set)."""
    return items.groupBy("run").agg(F.count("*").alias("items"), F.count_if(F.col("kind") == "observed").alias("observed"), F.count_if(F.col("kind") == "inferred").alias("inferred"), F.count_if(F.col("failed")).alias("failed"), F.sort_array(F.collect_set("stage")).alias("stages"))


def eval_metrics(records: DataFrame, expected: str, actual: str) -> DataFrame:
    """Per class: support, true positives, precision and recall, which are 1 where nothing is expected or claimed."""
    counts = records.select(F.inline(F.array(F.struct(F.col(expected).alias("label"), F.lit(1).alias("e"), F.lit(0).alias("a"), (F.col(expected) == F.col(actual)).cast("int").alias("hit")), F.struct(F.col(actual).alias("label"), F.lit(0).alias("e"), F.lit(1).alias("a"), F.lit(0).alias("hit")))))
    g = counts.groupBy("label").agg(F.sum("e").alias("support"), F.sum("a").alias("claimed"), F.sum("hit").alias("correct"))
    share = lambda of: F.when(F.col(of) > 0, F.col("correct") / F.col(of)).otherwise(1.0)
    return g.withColumn("precision", share("claimed")).withColumn("recall", share("support"))


#: Verdicts of a benchmark, in order of severity (fixed values).
VERDICTS = ["ALLOW", "ADVISORY", "REQUIRE_REVIEW", "BLOCK"]


def eval_by_class(records: DataFrame, verdicts: list[str] = VERDICTS) -> DataFrame:
    """Per class of records, and over all (class null): records, exact and near accuracy, confidence_median, and how often
    each verdict was expected and predicted.

    records: class, expected, predicted, confidence (null counts as 0). Near are verdicts at most one step apart. The
    median is exact: records are counted by class and confidence, and the middle is found by running counts
    over the distinct confidences, so that no task sorts a class.
    """
    step = lambda c: F.array_position(F.array(*[F.lit(v) for v in verdicts]), F.col(c))
    near = (step("expected") > 0) & (step("predicted") > 0) & (F.abs(step("expected") - step("predicted")) <= 1)
    of = F.explode(F.array(F.struct(F.lit(False).alias("all"), F.col("class").alias("class")), F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("class"))))
    rows = records.withColumn("__near", near).select(of.alias("__g"), "expected", "predicted", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "__near").select("__g.*", "expected", "predicted", "confidence", "__near")
    key = ["all", "class"]
    each = [F.count_if(F.col(side) == v).alias(f"{side}_{v.lower()}") for side in ("expected", "predicted") for v in verdicts]
    sums = rows.groupBy(*key).agg(F.count("*").alias("records"), (F.count_if(F.col("expected") == F.col("predicted")) / F.count("*")).alias("exact_accuracy"), (F.count_if("__near") / F.count("*")).alias("near_accuracy"), *each)
    values = rows.groupBy(*key, "confidence").agg(F.count("*").alias("n"))
    w = W.partitionBy(*key)
    at = values.withColumn("upto", F.sum("n").over(w.orderBy("confidence"))).withColumn("of", F.sum("n").over(w))
    low, high = F.floor((F.col("of") + 1) / 2), F.floor(F.col("of") / 2) + 1
    half = lambda k: F.min(F.when(F.col("upto") >= k, F.col("confidence")))
    middle = at.groupBy(*key).agg(((half(low) + half(high)) / 2).alias("confidence_median"))
    same = F.col("a.all").eqNullSafe(F.col("b.all")) & F.col("a.class").eqNullSafe(F.col("b.class"))
    return sums.alias("a").join(middle.alias("b"), same).select("a.*", "b.confidence_median").where("all or class is not null").drop("all")


def confusion(records: DataFrame, verdicts: list[str] = VERDICTS) -> DataFrame:
    """A row for each expected verdict, a column for each predicted one; verdicts that don't occur have zeros."""
    base = records.sparkSession.createDataFrame([(v,) for v in verdicts], "expected string")
    cells = records.groupBy("expected").pivot("predicted", verdicts).agg(F.count(F.lit(1)))
    return F.broadcast(base).join(cells, "expected", "left").select("expected", *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in verdicts])


def risk_metrics(records: DataFrame, risks: list[str]) -> DataFrame:
    """risk, tp, fp, fn, precision and recall (1 where there is nothing to count). records: truth and predicted, arrays of risks."""
    row = lambda k: F.struct(F.lit(k).alias("risk"), F.coalesce(F.array_contains("truth", k), F.lit(False)).alias("t"), F.coalesce(F.array_contains("predicted", k), F.lit(False)).alias("p"))
    g = records.select(F.inline(F.array(*[row(k) for k in risks]))).groupBy("risk").agg(F.count_if(F.col("t") & F.col("p")).alias("tp"), F.count_if(~F.col("t") & F.col("p")).alias("fp"), F.count_if(F.col("t") & ~F.col("p")).alias("fn"))
    share = lambda c: F.when(F.col("tp") + F.col(c) > 0, F.col("tp") / (F.col("tp") + F.col(c))).otherwise(1.0)
    return g.withColumn("precision", share("fp")).withColumn("recall", share("fn"))
