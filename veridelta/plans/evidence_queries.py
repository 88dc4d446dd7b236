"""Queries over findings, feedback and exceptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import graph as G
from .registry import query, table
from .views import view, with_views

ALL = ("findings", "feedback", "exceptions")
#: Evidence by occurrence, as SQL; now is 1 February 2024.
EV = """mf AS (SELECT DISTINCT occurrence_id, feedback_id, disposition FROM findings JOIN feedback ON stable_finding_id = stable_id),
 f AS (SELECT occurrence_id, count(*) AS feedback, count(*) FILTER (disposition = 'agree') AS agree, count(*) FILTER (disposition = 'fixed') AS fixed, count(*) FILTER (disposition = 'false_positive') AS false_positive, count(*) FILTER (disposition = 'accepted_risk') AS accepted_risk, count(*) FILTER (disposition = 'disagree') AS disagree, count(*) FILTER (disposition = 'needs_context') AS needs_context FROM mf GROUP BY 1),
 ex AS (SELECT *, CASE WHEN expires_on < DATE '2024-02-01' THEN 'expired' ELSE 'active' END AS status FROM exceptions WHERE reason IS NOT NULL),
 me AS (SELECT DISTINCT occurrence_id, exception_id, status FROM findings JOIN ex ON (scope = 'stable_id' AND value = stable_id) OR (scope = 'family' AND value = family) OR (scope = 'source' AND value = source_id)),
 e AS (SELECT occurrence_id, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'expired') AS expired FROM me GROUP BY 1),
 ev AS (SELECT findings.*, coalesce(feedback, 0) AS feedback, coalesce(agree, 0) AS agree, coalesce(fixed, 0) AS fixed, coalesce(false_positive, 0) AS false_positive, coalesce(accepted_risk, 0) AS accepted_risk, coalesce(disagree, 0) AS disagree, coalesce(needs_context, 0) AS needs_context, coalesce(active, 0) AS active, coalesce(expired, 0) AS expired FROM findings LEFT JOIN f USING (occurrence_id) LEFT JOIN e USING (occurrence_id))"""


def ev_sql(sql: str) -> str:
    return with_views("WITH " + EV + sql, *ALL)


def now():
    return F.lit("2024-02-01").cast("date")


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "findings")


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return E.with_evidence(*[view(spark, sf, v) for v in ALL], now())


@query(ev_sql(" SELECT disposition, count(*) AS n, count(DISTINCT occurrence_id) AS occurrences FROM mf GROUP BY 1"))
def c10_match_feedback(spark: SparkSession, sf: str) -> DataFrame:
    per = view(spark, sf, "feedback").select("feedback_id", "disposition", F.col("stable_finding_id").alias("stable_id")).distinct()
    per = per.groupBy("stable_id", "disposition").agg(F.count("*").alias("c"))
    return findings(spark, sf).join(per, "stable_id").groupBy("disposition").agg(F.sum("c").alias("n"), F.count_distinct("occurrence_id").alias("occurrences"))


@query(ev_sql(" SELECT occurrence_id, exception_id, status FROM me"))
def c11_match_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    return E.match_exceptions(findings(spark, sf), view(spark, sf, "exceptions"), now())


@query(with_views("SELECT feedback_id, arg_max(occurrence_id, (receipt_day, occurrence_id)) AS occurrence_id FROM feedback LEFT JOIN findings ON stable_finding_id = stable_id GROUP BY 1", *ALL))
def c17_attach_latest(spark: SparkSession, sf: str) -> DataFrame:
    return E.attach_latest(view(spark, sf, "feedback"), findings(spark, sf)).select("feedback_id", "occurrence_id")


_SIDE = "(SELECT receipt_day, count(*) AS n, max(risk_score) AS risk FROM findings WHERE occurrence_id % {k} = 0 GROUP BY 1)"


@query(with_views(f"SELECT * FROM (SELECT a.receipt_day, unnest(['n','risk']) AS metric, unnest([a.n::DOUBLE, a.risk::DOUBLE]) AS before, unnest([b.n::DOUBLE, b.risk::DOUBLE]) AS after FROM {_SIDE.format(k=2)} a JOIN {_SIDE.format(k=3)} b USING (receipt_day)) WHERE before IS DISTINCT FROM after", "findings"))
def c19_compare_receipts(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda k: findings(spark, sf).where(F.col("occurrence_id") % k == 0).groupBy("receipt_day").agg(F.count("*").alias("n"), F.max("risk_score").alias("risk"))
    return E.compare_receipts(side(2), side(3), "receipt_day", ["n", "risk"])


_TOLD = "SELECT receipt_day, count(*) AS n, max(risk_score) AS risk, count(*) FILTER (WHERE replay_ran) AS replayed, CASE WHEN max(risk_score) >= 100 THEN 'BLOCK' WHEN max(risk_score) >= 99 THEN 'REVIEW' ELSE 'ALLOW' END AS verdict, CASE WHEN min(occurrence_id) % 3 = 0 THEN NULL WHEN receipt_day < DATE '2024-01-10' THEN 'stale' ELSE 'fresh' END AS freshness, CAST(count(*) % 10 AS DOUBLE) / 10 AS confidence FROM findings WHERE occurrence_id % {k} = 0 GROUP BY receipt_day"


@query(with_views(f"""WITH a AS ({_TOLD.format(k=2)}), b AS ({_TOLD.format(k=3)}) SELECT receipt_day, a.verdict AS left_verdict, b.verdict AS right_verdict, a.freshness AS left_freshness, b.freshness AS right_freshness, a.confidence AS left_confidence, b.confidence AS right_confidence, a.verdict IS DISTINCT FROM b.verdict AS verdict_changed, a.freshness IS DISTINCT FROM b.freshness AS freshness_changed,
 concat_ws(',', CASE WHEN a.n <> b.n THEN 'n' END, CASE WHEN a.risk <> b.risk THEN 'risk' END, CASE WHEN a.replayed <> b.replayed THEN 'replayed' END) AS changed_fields, CASE WHEN a.replayed <> b.replayed THEN b.replayed - a.replayed END::DOUBLE AS replayed_more FROM a JOIN b USING (receipt_day)""", "findings"))
def c19_receipt_changes(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda k: spark.sql(_TOLD.format(k=k).replace("FROM findings", "FROM {findings}"), findings=findings(spark, sf))
    out = E.receipt_changes(side(2), side(3), "receipt_day", ["n", "risk", "replayed"])
    more = F.col("deltas")["replayed"]["right"] - F.col("deltas")["replayed"]["left"]
    return out.withColumn("replayed_more", more).withColumn("changed_fields", F.array_join("changed_fields", ",")).drop("deltas")


_DIMS = ["family", "severity", "business_severity", "replay_status", "exception_state", "freshness", "receipt_day"]
_STATES = "SELECT *, CASE WHEN active > 0 THEN 'active_exception' WHEN expired > 0 THEN 'expired_exception' ELSE 'none' END AS exception_state, CASE WHEN DATE '2024-02-01' - receipt_day > 30 THEN 'stale' WHEN DATE '2024-02-01' - receipt_day > 14 THEN 'review_due' ELSE 'fresh' END AS freshness FROM ev"


@query(ev_sql(f", x AS ({_STATES}) " + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d}::VARCHAR AS key, count(*) AS findings, count(DISTINCT receipt_day) AS receipts, sum(monthly_cost) AS cost, coalesce(sum(monthly_cost) FILTER (agree + fixed > 0), 0) AS validated_cost, coalesce(sum(monthly_cost) FILTER (fixed > 0), 0) AS avoided_cost, coalesce(sum(monthly_cost) FILTER (accepted_risk > 0), 0) AS accepted_cost FROM x GROUP BY {d}" for d in _DIMS)))
def d16_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("active") > 0, "active_exception").when(F.col("expired") > 0, "expired_exception").otherwise("none")
    return E.dashboard(evidence(spark, sf).withColumns({"exception_state": state, "freshness": E.freshness_state(F.col("receipt_day"), now())}), _DIMS)


@query(with_views("SELECT family, count(*) AS findings, count(*) FILTER (replay_ran) AS ran, count(*) FILTER (replay_status = 'drift_detected') AS drifts, count(*) FILTER (replay_ran AND replay_status <> 'drift_detected') AS ran_without_drift, count(*) FILTER (NOT replay_ran) AS not_run, count(*) FILTER (fidelity_score < 0.5) AS low_fidelity, count(*) FILTER (replay_ran)::DOUBLE / count(*) AS coverage, count(*) FILTER (replay_status = 'drift_detected')::DOUBLE / count(*) FILTER (replay_ran) AS drift_rate FROM findings GROUP BY 1", "findings"))
def d17_replay_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return E.replay_rollup(findings(spark, sf))


def _named(**columns: str) -> str:
    """SQL that joins names and counts above zero, by name."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {v} > 0 THEN '{k}:' || ({v})::VARCHAR END" for k, v in sorted(columns.items())) + ")"


def joined(c: str):
    """A map of counts as text, by name."""
    return F.array_join(F.transform(F.sort_array(F.map_entries(c)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")


def assured(df: DataFrame) -> DataFrame:
    """Every third finding is of high, medium and low confidence."""
    n = F.col("occurrence_id") % 3
    return df.withColumn("confidence", F.when(n == 0, "high").when(n == 1, "medium").otherwise("low"))


@query(ev_sql(" SELECT stable_id, count(*) AS occurrences, count(DISTINCT receipt_day) AS receipts, max(risk_score) AS max_risk, max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END) AS severity_rank, sum(monthly_cost) AS cost, sum(feedback) AS feedback, " + _named(**{d: f"count(*) FILTER ({d} > 0)" for d in E.COUNTED}) + " AS dispositions, " + _named(high="count(*) FILTER (occurrence_id % 3 = 0)", medium="count(*) FILTER (occurrence_id % 3 = 1)", low="count(*) FILTER (occurrence_id % 3 = 2)") + " AS confidences FROM ev GROUP BY 1"))
def d18_stable_findings(spark: SparkSession, sf: str) -> DataFrame:
    return E.stable_findings(assured(evidence(spark, sf))).withColumns({c: joined(c) for c in ("dispositions", "confidences")})


@query(with_views("SELECT node, sum(n) AS findings, string_agg(family || ':' || n::VARCHAR, ',' ORDER BY family) AS families, sum(c) AS cost FROM (SELECT source_id AS node, family, count(*) AS n, sum(monthly_cost) AS c FROM findings GROUP BY 1, 2) GROUP BY 1", "findings"))
def d19_blast_node_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return E.blast_node_rollup(findings(spark, sf).withColumnRenamed("source_id", "node")).withColumn("families", joined("families"))


_DECAY = """, g AS (SELECT stable_id, min(family) AS family, count(*) AS n, max(receipt_day) AS seen, max(risk_score) AS risk, count(*) FILTER (business_severity IN ('BOARD_CRITICAL','EXEC_CRITICAL','REVENUE_CRITICAL')) AS crit, count(*) FILTER (replay_status = 'drift_detected') AS d, sum(feedback) AS feedback, sum(false_positive) AS fp, sum(accepted_risk) AS acc, sum(active) AS active, sum(expired) AS expired FROM ev GROUP BY 1),
 s AS (SELECT *, greatest(0, least(100, least(n * 8, 32) + least(d * 12, 36) + least((active + acc) * 8, 24) + expired * 12 + CASE WHEN crit > 0 THEN 18 ELSE 0 END + CASE WHEN risk >= 90 THEN 12 WHEN risk >= 75 THEN 6 ELSE 0 END + CASE WHEN feedback = 0 AND (risk >= 80 OR crit > 0) THEN 10 ELSE 0 END - least(fp * 12, 36))) AS score,
 CASE WHEN fp >= 2 THEN 'tune_or_suppress' WHEN expired > 0 THEN 'review_expired_exception' WHEN d >= 2 AND feedback > 0 THEN 'decaying_high_confidence' WHEN d >= 2 THEN 'decaying_needs_feedback' WHEN active >= 2 OR acc >= 2 THEN 'accepted_risk_debt' WHEN feedback = 0 AND (risk >= 80 OR crit > 0) THEN 'needs_review' WHEN n >= 2 THEN 'watch' ELSE 'stable_or_insufficient_history' END AS state FROM g)"""


@query(ev_sql(_DECAY + " SELECT stable_id, family, n AS occurrences, d AS drifts, score, state FROM s"))
def d20_decay(spark: SparkSession, sf: str) -> DataFrame:
    return E.decay(evidence(spark, sf), now()).select("stable_id", "family", "occurrences", "drifts", "score", "state")


@query(ev_sql(_DECAY + " SELECT family, count(*) AS stable_ids, sum(n) AS occurrences, max(score) AS max_score, sum(d) AS drifts, sum(fp) AS false_positive, sum(acc) AS accepted_risk FROM s GROUP BY 1"))
def d20_decay_families(spark: SparkSession, sf: str) -> DataFrame:
    return E.decay_families(E.decay(evidence(spark, sf), now()))


@query(ev_sql(_DECAY + " SELECT stable_id, score FROM s ORDER BY score DESC, n DESC, d DESC, stable_id LIMIT 25"))
def f3_decay_top(spark: SparkSession, sf: str) -> DataFrame:
    d = E.decay(evidence(spark, sf), now())
    return d.orderBy(F.desc("score"), F.desc("occurrences"), F.desc("drifts"), "stable_id").limit(25).select("stable_id", "score")


_BUCKET = "count(*) AS occurrences, count(*) FILTER (replay_status = 'drift_detected') AS drifts, max(risk_score) AS risk, count(*) FILTER (business_severity IN ('BOARD_CRITICAL','EXEC_CRITICAL','REVENUE_CRITICAL')) AS crit, sum(monthly_cost) AS cost, sum(feedback) AS feedback, sum(agree) + sum(fixed) AS good, sum(false_positive) AS fp, sum(accepted_risk) AS acc, sum(expired) AS expired"
_MEMORY = ", o AS (SELECT *, CASE occurrence_id % 4 WHEN 0 THEN ['unknown'] WHEN 1 THEN ['team_' || family] ELSE ['team_' || family, source_id] END AS owners FROM ev), g AS (" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, {key} AS key, {_BUCKET} FROM {t} GROUP BY 2" for kind, key, t in (("organization", "'all'", "o"), ("family", "family", "o"), ("source_resource", "source_id", "o"), ("business_severity", "business_severity", "o"), ("owner_or_team", "owner", "(SELECT *, unnest(owners) AS owner FROM o)"))) + """),
 s AS (SELECT *, greatest(0, least(100, least(occurrences * 5, 25) + least(drifts * 8, 32) + CASE WHEN crit > 0 THEN 14 ELSE 0 END + CASE WHEN cost > 0 THEN 12 ELSE 0 END + least(good * 8, 24) + least(acc * 5, 15) + least(expired * 10, 20) - least(fp * 12, 30))) AS score,
 CASE WHEN feedback >= 2 AND fp / feedback >= 0.5 THEN 'noisy_pattern' WHEN expired > 0 THEN 'expired_risk_memory' WHEN drifts / occurrences >= 0.5 AND good > 0 THEN 'validated_recurring_drift' WHEN drifts / occurrences >= 0.5 THEN 'recurring_drift_needs_feedback' WHEN acc >= 2 THEN 'accepted_risk_memory' WHEN feedback = 0 AND risk >= 80 THEN 'high_risk_unvalidated' ELSE 'watch' END AS pattern FROM g),
 r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, occurrences DESC, drifts DESC, key) AS rank FROM s)"""


def _memory(spark: SparkSession, sf: str) -> DataFrame:
    team, n = F.concat(F.lit("team_"), "family"), F.col("occurrence_id") % 4
    owners = F.when(n == 0, F.array(F.lit(" "))).when(n == 1, F.array(team, team)).otherwise(F.array(team, "source_id"))
    return E.memory(evidence(spark, sf).withColumn("owners", owners))


@query(ev_sql(_MEMORY + " SELECT kind, key, occurrences, drifts, score, pattern, rank FROM r WHERE rank <= 25"))
def d21_memory(spark: SparkSession, sf: str) -> DataFrame:
    return _memory(spark, sf).select("kind", "key", "occurrences", "drifts", "score", "pattern", "rank")


@query(ev_sql(_MEMORY + " SELECT kind, key, score, pattern FROM r WHERE rank <= 25 AND kind IN ('family', 'source_resource', 'owner_or_team') AND pattern <> 'watch' ORDER BY score DESC, occurrences DESC, kind, key LIMIT 25"))
def d21_watchlist(spark: SparkSession, sf: str) -> DataFrame:
    return E.memory_watchlist(_memory(spark, sf)).select("kind", "key", "score", "pattern")


_FLAGS = {
    "missing_trigger_evidence": "trig < 1", "no_blast_radius": "blast = 0", "overbroad_blast_radius": "blast > 12 AND minor", "negative_developer_feedback": "disagree + false_positive > 0", "active_exception_do_not_enforce": "active > 0", "developer_validated": "agree + fixed > 0", "cost_evidence_present": "true",
    "business_critical": "NOT minor", "weak_control_coverage": "occurrence_id % 5 = 0", "replay_validated": "replay_ran", "inferred_only_no_replay": "NOT replay_ran", "replay_drift_detected": "replay_status = 'drift_detected'", "low_replay_fidelity": "fidelity_score < 0.5",
}
_FLAGGED = """, b AS (SELECT *, occurrence_id % 7 AS trig, occurrence_id % 17 AS blast, business_severity IN ('UNKNOWN', 'INTERNAL_LOW') AS minor FROM ev),
 fl AS (SELECT *, CASE WHEN active > 0 OR accepted_risk > 0 THEN 'accepted_risk_review' WHEN disagree + false_positive > 0 THEN 'needs_noise_review' WHEN trig < 1 OR blast = 0 THEN 'insufficient_evidence' WHEN blast > 12 AND minor THEN 'overbroad' WHEN replay_status = 'drift_detected' AND agree + fixed > 0 THEN 'replay_validated_developer_validated' WHEN replay_status = 'drift_detected' THEN 'replay_validated_shadow' WHEN fidelity_score < 0.5 THEN 'low_fidelity_review' WHEN agree + fixed > 0 THEN 'developer_validated' WHEN risk_score >= 80 THEN 'high_signal_shadow' ELSE 'shadow_unvalidated' END AS precision_state, concat_ws(',', """ + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _FLAGS.items()) + ") AS flags FROM b)"


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("occurrence_id")
    e = evidence(spark, sf).withColumns({"trigger_count": n % 7, "blast_count": n % 17, "control_status": F.when(n % 5 == 0, "weak").otherwise("covered"), "cost": F.lit(None).cast("double")})
    return E.precision_flags(e)


@query(ev_sql(_FLAGGED + " SELECT occurrence_id, flags, precision_state FROM fl"))
def d22_precision_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _flagged(spark, sf).select("occurrence_id", F.array_join("flags", ",").alias("flags"), "precision_state")


_COUNTS = ", ".join(f"count(*) FILTER ({_FLAGS[f]}) AS {c}" for c, f in (("validated", "developer_validated"), ("negative", "negative_developer_feedback"), ("untriggered", "missing_trigger_evidence"), ("unreached", "no_blast_radius"), ("broad", "overbroad_blast_radius"), ("excepted", "active_exception_do_not_enforce"), ("costed", "cost_evidence_present"), ("critical", "business_critical"), ("replayed", "replay_validated"), ("drifts", "replay_drift_detected"), ("inferred", "inferred_only_no_replay"), ("low", "low_replay_fidelity")))


@query(ev_sql(_FLAGGED + f", g AS (SELECT family, count(*) AS findings, count(*) FILTER (feedback > 0) AS with_feedback, {_COUNTS} FROM fl GROUP BY 1) SELECT *, CASE WHEN drifts > 0 AND validated > 0 AND negative = 0 THEN 'advisory_candidate_replay_validated' WHEN inferred = findings AND findings >= 2 THEN 'add_replay_fixtures_before_policy' WHEN low > 0 THEN 'improve_replay_fidelity_before_policy' WHEN negative > 0 AND negative / findings >= 0.3 THEN 'tune_or_suppress_before_advisory' WHEN untriggered > 0 OR unreached > 0 THEN 'improve_evidence_before_policy' WHEN broad > 0 THEN 'tighten_blast_radius_scope' WHEN excepted > 0 THEN 'keep_advisory_with_exception_review' WHEN validated > 0 AND (costed > 0 OR critical > 0) THEN 'advisory_candidate_not_blocking' ELSE 'continue_shadow_collect_feedback' END AS action FROM g"))
def d22_d23_precision_and_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return E.precision_eval(_flagged(spark, sf))


_DAYS = "(SELECT count(DISTINCT receipt_day) FROM findings)"
_POLICY = ", g AS (SELECT family, count(*) AS findings, sum(monthly_cost) AS cost, " + ", ".join(f"count(*) FILTER ({d} > 0) AS {d}" for d in E.COUNTED) + " FROM ev GROUP BY 1), p AS (SELECT *, " + " + ".join(E.COUNTED) + " AS feedback FROM g), q AS (SELECT *, round((agree + fixed) / feedback, 4) AS agree_rate, round(false_positive / feedback, 4) AS fp_rate FROM p), c AS (SELECT *, CASE WHEN fp_rate >= 0.4 AND feedback >= 2 THEN 'lower_severity_or_suppress_candidate' WHEN fixed >= 1 AND cost > 0 AND feedback >= 3 AND coalesce(fp_rate, 0) <= 0.25 THEN 'require_review_candidate' WHEN fixed >= 1 AND cost > 0 THEN 'advisory_candidate' WHEN feedback < 2 OR " + _DAYS + " < 10 THEN 'keep_shadow_collect_feedback' WHEN accepted_risk >= 2 AND accepted_risk >= agree + fixed THEN 'accepted_risk_policy_review_candidate' WHEN agree_rate >= 0.7 AND findings >= 3 THEN 'advisory_candidate' ELSE 'keep_shadow_collect_feedback' END AS action FROM q)"


def _days(spark: SparkSession, sf: str) -> int:
    return findings(spark, sf).select("receipt_day").distinct().count()


@query(ev_sql(_POLICY + " SELECT family, findings, feedback, agree_rate, fp_rate, action FROM c"))
def d23_policy_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return E.policy_calibration(evidence(spark, sf), _days(spark, sf)).select("family", "findings", "feedback", "agree_rate", "fp_rate", "action")


@query(ev_sql(_POLICY + f""", fb AS (SELECT count(*) AS feedback, count(*) FILTER (disposition = 'agree') AS agreed, count(*) FILTER (disposition = 'false_positive') AS false_positive FROM feedback), st AS (SELECT count(*) AS recurring FROM (SELECT stable_id FROM ev GROUP BY 1 HAVING sum(feedback) > 0)), cc AS (SELECT count(*) FILTER (action = 'require_review_candidate') AS require, count(*) FILTER (action = 'advisory_candidate') AS advisory FROM c), j AS (SELECT *, round(agreed / feedback, 4) AS agreement_rate FROM fb, st, cc)
 SELECT *, CASE WHEN {_DAYS} < 20 OR feedback < 5 THEN 'shadow_only' WHEN false_positive >= greatest(2, feedback // 3) THEN 'tune_noise_before_enforcement' WHEN require > 0 AND recurring >= 2 AND agreement_rate >= 0.7 THEN 'require_review_candidate_human_review_required' WHEN advisory > 0 OR agreement_rate >= 0.6 THEN 'advisory_candidate' ELSE 'continue_shadow_calibration' END AS state FROM j"""))
def d23_calibration_readiness(spark: SparkSession, sf: str) -> DataFrame:
    e, days = evidence(spark, sf), _days(spark, sf)
    return E.calibration_readiness(E.policy_calibration(e, days), E.stable_findings(e), view(spark, sf, "feedback"), days)


#: Every order as a shadow run; every event as feedback.
_RUNS = """SELECT concat('repo_', CAST(CASE WHEN o_custkey % 10 = 0 THEN o_custkey ELSE o_custkey % 40 END AS VARCHAR(20))) AS repo, CASE WHEN o_custkey % 6 = 5 THEN NULL ELSE concat('team_', CAST(o_custkey % 6 AS VARCHAR(20))) END AS team,
 CASE o_orderstatus WHEN 'F' THEN 'BLOCK' WHEN 'O' THEN 'ALLOW' ELSE NULL END AS verdict, CASE o_orderkey % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'medium' ELSE NULL END AS confidence, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('reason_', CAST(o_orderkey % 4 AS VARCHAR(20))) END AS primary_reason,
 o_orderstatus = 'F' AS would_block, o_orderkey % 5 = 0 AS would_review, CAST(o_orderkey % 7 AS INT) AS assumptions, CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS critical_assumptions, CAST(o_totalprice / 1000 AS DECIMAL(12, 2)) AS savings, CAST(o_totalprice AS DECIMAL(12, 2)) AS weekly_cost, CAST(o_totalprice * 4 AS DECIMAL(14, 2)) AS monthly_cost,
 CASE o_orderkey % 8 WHEN 0 THEN 'financial|semantic' WHEN 1 THEN 'assumptions' WHEN 2 THEN 'runtime' ELSE NULL END AS risk_categories, concat('p', CAST(o_orderkey % 13 AS VARCHAR(20)), '|q', CAST(o_custkey % 9 AS VARCHAR(20))) AS patterns FROM {orders}"""
_OUTCOMES = """SELECT concat('repo_', CAST(user_id % 45 AS VARCHAR(20))) AS repo, concat('team_', CAST(user_id % 5 AS VARCHAR(20))) AS team, CASE WHEN user_id % 45 < 15 AND event_id % 9 < 8 THEN 'confirmed' WHEN user_id % 45 < 30 AND event_id % 10 < 7 THEN 'useful' WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'fixed' WHEN event_id % 3 = 1 THEN 'noisy' ELSE 'false_positive' END AS outcome FROM {events}"""
_SHADOW = f"""WITH runs AS ({_RUNS.format(orders='orders')}), fb AS ({_OUTCOMES.format(events='events')}),
 r AS (SELECT 'global' AS scope, 'all' AS value, * FROM runs UNION ALL SELECT 'repo', repo, * FROM runs UNION ALL SELECT 'team', coalesce(team, 'unknown_team'), * FROM runs),
 f AS (SELECT 'global' AS scope, 'all' AS value, outcome FROM fb UNION ALL SELECT 'repo', repo, outcome FROM fb UNION ALL SELECT 'team', team, outcome FROM fb),
 s AS (SELECT scope, value, count(*) AS runs, count(*) FILTER (would_block) AS blocked, count(*) FILTER (would_review) AS reviewed, count(*) FILTER (lower(confidence) = 'high') AS high_confidence, sum(assumptions) AS assumptions, sum(critical_assumptions) AS critical_assumptions, sum(savings) AS savings, sum(weekly_cost) AS weekly_cost, sum(monthly_cost) AS monthly_cost FROM r GROUP BY ALL),
 long AS (SELECT scope, value, 'verdicts' AS kind, coalesce(verdict, 'UNKNOWN') AS name FROM r UNION ALL SELECT scope, value, 'confidences', coalesce(confidence, 'unknown') FROM r UNION ALL SELECT scope, value, 'reasons', coalesce(primary_reason, 'unknown') FROM r UNION ALL SELECT scope, value, 'categories', unnest(string_split(risk_categories, '|')) FROM r UNION ALL SELECT scope, value, 'patterns', unnest(string_split(patterns, '|')) FROM r),
 c AS (SELECT scope, value, kind, name, count(*) AS n FROM long GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY scope, value, kind ORDER BY n DESC, name) AS rank FROM c),
 m AS (SELECT scope, value, {', '.join(f"string_agg(name || ':' || n, ',' ORDER BY name) FILTER (kind = '{k}') AS {k}" for k in ('verdicts', 'confidences', 'reasons', 'categories'))}, string_agg(name || ':' || n, ',' ORDER BY rank) FILTER (kind = 'patterns' AND rank <= 8) AS top_patterns FROM ranked GROUP BY ALL),
 o AS (SELECT scope, value, sum(n)::BIGINT AS feedback, string_agg(outcome || ':' || n, ',' ORDER BY outcome) AS outcomes, coalesce(sum(n) FILTER (outcome IN ('confirmed', 'useful', 'fixed')), 0) AS confirmed, coalesce(sum(n) FILTER (outcome IN ('noisy', 'false_positive')), 0) AS noisy FROM (SELECT scope, value, coalesce(outcome, 'unknown') AS outcome, count(*) AS n FROM f GROUP BY ALL) GROUP BY ALL),
 j AS (SELECT scope, value, coalesce(runs, 0) AS runs, coalesce(blocked, 0) AS blocked, coalesce(reviewed, 0) AS reviewed, coalesce(high_confidence, 0) AS high_confidence, coalesce(assumptions, 0) AS assumptions, coalesce(critical_assumptions, 0) AS critical, coalesce(savings, 0) AS savings, coalesce(weekly_cost, 0) AS weekly_cost, coalesce(monthly_cost, 0) AS monthly_cost, coalesce(feedback, 0) AS feedback, verdicts, confidences, reasons, categories, top_patterns, outcomes, round(coalesce(confirmed, 0)::DOUBLE / greatest(1, coalesce(confirmed + noisy, 0)), 4) AS precision FROM s FULL JOIN o USING (scope, value) LEFT JOIN m USING (scope, value)),
 t AS (SELECT *, blocked::DOUBLE / greatest(1, runs) AS b, reviewed::DOUBLE / greatest(1, runs) AS v FROM j),
 k AS (SELECT *, CASE WHEN runs < 3 OR precision < 0.5 THEN 0 WHEN precision >= 0.8 AND high_confidence >= 2 AND (savings >= 500 OR critical >= 2) AND b <= 0.8 THEN 3 WHEN precision >= 0.65 AND (reviewed >= 2 OR critical >= 1 OR savings >= 250) THEN 2 ELSE 1 END AS tier FROM t)
 SELECT scope, value, runs, round(b, 4) AS block_rate, round(v, 4) AS review_rate, savings::DOUBLE AS savings, weekly_cost::DOUBLE AS weekly_cost, monthly_cost::DOUBLE AS monthly_cost, round(assumptions::DOUBLE / greatest(1, runs), 2) AS average_assumptions, feedback, precision, verdicts, confidences, reasons, categories, top_patterns, outcomes,
 CASE tier WHEN 0 THEN 'TIER_0_SHADOW_ONLY' WHEN 1 THEN 'TIER_1_ADVISORY' WHEN 2 THEN 'TIER_2_REQUIRE_REVIEW' ELSE 'TIER_3_SELECTIVE_BLOCK' END AS tier,
 concat_ws(',', CASE WHEN runs < 3 THEN 'too_few_runs' WHEN precision < 0.5 THEN 'precision_below_half' WHEN tier = 3 THEN 'precise_and_material' WHEN tier = 2 THEN 'recurring_or_costly' ELSE 'advisory_until_more_evidence' END, CASE WHEN b > 0.8 AND runs >= 3 THEN 'blocks_too_often' END, CASE WHEN v > 0.9 AND runs >= 3 THEN 'reviews_too_broad' END) AS enforcement_reasons,
 concat_ws(',', CASE WHEN tier = 3 AND categories LIKE '%financial%' THEN 'high_confidence_financial_blowup' END, CASE WHEN tier = 3 AND (categories LIKE '%assumptions%' OR categories LIKE '%semantic%') THEN 'high_confidence_semantic_or_assumption_break' END) AS hard_block,
 CASE tier WHEN 3 THEN 'medium_confidence_semantic,critical_assumption_without_runtime_proof' WHEN 2 THEN 'financial_blowup,semantic_break,critical_assumption,runtime_fragility' ELSE '' END AS require_review FROM k"""


@query(_SHADOW)
def d24_shadow_rollup(spark: SparkSession, sf: str) -> DataFrame:
    parts = lambda c: F.split(c, r"\|")
    runs = spark.sql(_RUNS, orders=table(spark, sf, "orders")).withColumn("risk_categories", parts("risk_categories")).withColumn("patterns", parts("patterns"))
    out = E.shadow_rollup(runs, spark.sql(_OUTCOMES, events=table(spark, sf, "events")))
    entries = lambda c: F.transform(F.sort_array(F.map_entries(c)), lambda x: F.struct(x["key"].alias("k"), x["value"].alias("v")))
    flat = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["k"], x["v"].cast("string"))), ","))
    top = F.transform("top_patterns", lambda x: F.struct(x["name"].alias("k"), x["n"].alias("v")))
    maps = {c: flat(entries(F.col(c))) for c in ("verdicts", "confidences", "reasons", "categories", "outcomes")}
    lists = {c: F.array_join(c, ",") for c in ("enforcement_reasons", "hard_block", "require_review")}
    doubles = {c: F.col(c).cast("double") for c in ("savings", "weekly_cost", "monthly_cost")}
    return out.withColumns(maps | lists | doubles | {"top_patterns": flat(top)}).select("scope", "value", "runs", "block_rate", "review_rate", *doubles, "average_assumptions", "feedback", "precision", *maps, "top_patterns", "tier", *lists)


@query("SELECT 'week' AS kind, strftime(ts, '%G-W%V') AS period, count(*) AS runs FROM events GROUP BY 2 UNION ALL SELECT 'month', strftime(ts, '%Y-%m'), count(*) FROM events GROUP BY 2")
def d25_period_trends(spark: SparkSession, sf: str) -> DataFrame:
    return E.period_trends(table(spark, sf, "events"), "ts")


@query(with_views("""WITH s AS (SELECT scope, CASE WHEN reason IS NULL THEN 'invalid' WHEN expires_on < DATE '2024-02-20' THEN 'expired' ELSE 'active' END AS status, expires_on FROM exceptions) SELECT 'disposition' AS kind, disposition AS key, count(*) AS n FROM feedback GROUP BY 2 UNION ALL SELECT 'scope', scope, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM s GROUP BY 2 UNION ALL SELECT 'expiring', scope, count(*) FROM s WHERE status = 'active' AND expires_on - DATE '2024-02-20' <= 14 GROUP BY 2""", *ALL))
def d26_ledger_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return E.ledger_summaries(view(spark, sf, "feedback"), view(spark, sf, "exceptions"), F.lit("2024-02-20").cast("date"))


@query(ev_sql(" SELECT family, severity, count(*) AS findings, sum(false_positive) AS false_positive, sum(agree) AS agreed FROM ev GROUP BY 1, 2"))
def d27_evidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.evidence_summary(evidence(spark, sf))


@query(with_views("SELECT source_id, count(*) AS nodes, count(*) FILTER (business_severity IN ('BOARD_CRITICAL','EXEC_CRITICAL','REVENUE_CRITICAL')) AS critical, arg_max(business_severity, CASE business_severity WHEN 'UNKNOWN' THEN 0 WHEN 'INTERNAL_LOW' THEN 1 WHEN 'INTERNAL_HIGH' THEN 2 WHEN 'CUSTOMER_FACING' THEN 3 WHEN 'REVENUE_CRITICAL' THEN 4 WHEN 'EXEC_CRITICAL' THEN 5 ELSE 6 END) AS highest FROM findings GROUP BY 1", "findings"))
def d32_business_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return E.business_rollup(findings(spark, sf), "source_id")


@query("SELECT label, sum(e) AS support, sum(a) AS claimed, sum(h) AS correct, CASE WHEN sum(a) > 0 THEN sum(h)::DOUBLE / sum(a) ELSE 1 END AS precision, CASE WHEN sum(e) > 0 THEN sum(h)::DOUBLE / sum(e) ELSE 1 END AS recall FROM (SELECT quality AS label, 1 AS e, 0 AS a, (quality = toxic)::INT AS h FROM labels UNION ALL SELECT toxic, 0, 1, 0 FROM labels) GROUP BY 1")
def d33_eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.eval_metrics(table(spark, sf, "labels"), "quality", "toxic")


_RECORDS = """SELECT class, confidence, truth, guess, CASE WHEN e = 0 THEN 'ALLOW' WHEN e = 1 THEN 'ADVISORY' WHEN e = 2 THEN 'REQUIRE_REVIEW' ELSE 'BLOCK' END AS expected, CASE WHEN p = 0 THEN 'ALLOW' WHEN p = 1 THEN 'ADVISORY' WHEN p = 2 THEN 'REQUIRE_REVIEW' ELSE 'BLOCK' END AS predicted
 FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN e WHEN doc_id % 7 = 0 THEN (e + 2) % 4 ELSE (e + doc_id % 2) % 4 END AS p FROM (SELECT doc_id, concat('class_', CAST(doc_id % 4 AS VARCHAR(20))) AS class, CASE WHEN doc_id % 29 = 0 THEN NULL ELSE CAST(doc_id % 101 AS DOUBLE) / 100 END AS confidence, CASE WHEN toxic = 1 THEN 3 WHEN quality = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS e,
  concat(CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END, '|', CASE WHEN quality = 0 THEN 'junk' ELSE '' END) AS truth, concat(CASE WHEN (toxic = 1) <> (doc_id % 10 = 0) THEN 'toxic' ELSE '' END, '|', CASE WHEN quality = 0 AND doc_id % 4 > 0 THEN 'junk' ELSE '' END) AS guess FROM {labels} WHERE quality IS NOT NULL AND toxic IS NOT NULL) x) y"""
_SQL_RECORDS = _RECORDS.format(labels="labels")
_STEP = "list_position(['ALLOW', 'ADVISORY', 'REQUIRE_REVIEW', 'BLOCK'], {c})"
_EACH = ", ".join(f"count(*) FILTER ({side} = '{v}') AS {side}_{v.lower()}" for side in ("expected", "predicted") for v in E.VERDICTS)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(_RECORDS, labels=table(spark, sf, "labels"))


@query(f"WITH r AS ({_SQL_RECORDS}), g AS (SELECT class, * EXCLUDE (class) FROM r UNION ALL SELECT NULL, * EXCLUDE (class) FROM r) SELECT class, count(*) AS records, count(*) FILTER (expected = predicted)::DOUBLE / count(*) AS exact_accuracy, count(*) FILTER (abs({_STEP.format(c='expected')} - {_STEP.format(c='predicted')}) <= 1)::DOUBLE / count(*) AS near_accuracy, {_EACH}, median(coalesce(confidence, 0)) AS confidence_median FROM g GROUP BY 1")
def d33_eval_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return E.eval_by_class(_records(spark, sf))


@query(f"WITH r AS ({_SQL_RECORDS}) SELECT v AS expected, " + ", ".join(f"count(*) FILTER (predicted = '{v}') AS {v}" for v in E.VERDICTS) + " FROM (SELECT unnest(['ALLOW', 'ADVISORY', 'REQUIRE_REVIEW', 'BLOCK']) AS v) LEFT JOIN r ON expected = v GROUP BY 1")
def d33_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion(_records(spark, sf))


@query(f"WITH r AS ({_SQL_RECORDS}), k AS (SELECT risk, count(*) FILTER (contains(truth, risk) AND contains(guess, risk)) AS tp, count(*) FILTER (NOT contains(truth, risk) AND contains(guess, risk)) AS fp, count(*) FILTER (contains(truth, risk) AND NOT contains(guess, risk)) AS fn FROM r, (SELECT unnest(['toxic', 'junk', 'never']) AS risk) GROUP BY 1) SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 1 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 1 END AS recall FROM k")
def d33_risk_metrics(spark: SparkSession, sf: str) -> DataFrame:
    r = _records(spark, sf).withColumn("truth", F.split("truth", r"\|")).withColumn("predicted", F.split("guess", r"\|"))
    return E.risk_metrics(r, ["toxic", "junk", "never"])


@query(with_views("SELECT family, severity, CASE WHEN family = 'click' OR (family = 'view' AND EXISTS (SELECT 1 FROM findings)) THEN true ELSE false END AS passed FROM (SELECT 'click' AS family, 's1' AS severity UNION ALL SELECT 'no_such', 's1')", "findings"))
def d37_scenario_report(spark: SparkSession, sf: str) -> DataFrame:
    expected = spark.createDataFrame([("s1", "click"), ("s1", "no_such")], "scenario string, family string")
    return E.scenario_report(expected, findings(spark, sf).withColumn("scenario", F.lit("s1"))).select("family", F.col("scenario").alias("severity"), "passed")


@query(with_views("SELECT receipt_day AS run, count(*) AS items, count(*) FILTER (replay_ran) AS observed, count(*) FILTER (NOT replay_ran) AS inferred, count(*) FILTER (severity = 'critical') AS failed, array_to_string(list_sort(list(DISTINCT family)), ',') AS stages FROM findings GROUP BY 1", "findings"))
def d40_bundle_summary(spark: SparkSession, sf: str) -> DataFrame:
    items = findings(spark, sf).select(F.col("receipt_day").alias("run"), F.when(F.col("replay_ran"), "observed").otherwise("inferred").alias("kind"), (F.col("severity") == "critical").alias("failed"), F.col("family").alias("stage"))
    return E.bundle_summary(items).withColumn("stages", F.array_join("stages", ","))


@query(with_views("SELECT stable_id, max(occurrence_id) AS occurrence_id FROM findings GROUP BY 1", "findings"))
def e2_latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return E.latest_per_key(findings(spark, sf), ["stable_id"], ["receipt_day", "occurrence_id"]).select("stable_id", "occurrence_id")


@query(with_views("""WITH a AS (SELECT receipt_day, row_number() OVER (PARTITION BY receipt_day ORDER BY occurrence_id) AS pos, family, risk_score FROM findings WHERE occurrence_id % 3 <> 0), b AS (SELECT receipt_day, row_number() OVER (PARTITION BY receipt_day ORDER BY occurrence_id) AS pos, family, risk_score FROM findings WHERE occurrence_id % 5 <> 0) SELECT receipt_day, pos, a.family AS now_family, a.risk_score AS now_risk, b.family AS was_family, b.risk_score AS was_risk, coalesce(a.family = b.family AND abs(a.risk_score - b.risk_score) <= 3, false) AS matches FROM a FULL JOIN b USING (receipt_day, pos)""", "findings"))
def e3_positional_compare(spark: SparkSession, sf: str) -> DataFrame:
    f = findings(spark, sf)
    return E.positional_compare(f.where("occurrence_id % 3 <> 0"), f.where("occurrence_id % 5 <> 0"), "receipt_day", "occurrence_id")


@query(with_views("""WITH s AS (SELECT occurrence_id, receipt_day, replay_ran AS ev, risk_score, CASE WHEN replay_ran THEN 0.35 * (risk_score / 100.0) + 0.25 * 0.5 + 0.2 * fidelity_score + 0.2 * 0.5 ELSE least(0.34, 0.35 * (risk_score / 100.0) + 0.25 * 0.5 + 0.2 * fidelity_score + 0.2 * 0.5) END AS score FROM findings), t AS (SELECT *, ev AND risk_score > 0 AND round(score, 9) >= 0.34 AS ok FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY receipt_day, ok ORDER BY round(score, 9) DESC, occurrence_id) AS k, bool_or(ok) OVER (PARTITION BY receipt_day) AS found FROM t) SELECT occurrence_id, round(score, 6) AS score, CASE WHEN NOT found THEN 'suppressed' WHEN ok AND k = 1 THEN 'primary' WHEN ok THEN 'secondary' WHEN round(score, 9) >= 0.12 THEN 'advisory' ELSE 'suppressed' END AS role FROM r""", "findings"))
def e4_rank_hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    s = findings(spark, sf).select("occurrence_id", "receipt_day", (F.col("risk_score") / 100).alias("specificity"), F.lit(0.5).alias("dependency"), "fidelity_score", F.lit(0.5).alias("actionability"), F.col("replay_ran").alias("has_event"))
    return E.rank_hypotheses(s, "receipt_day").select("occurrence_id", F.round("score", 6).alias("score"), "role")


@query(with_views("SELECT stable_id, occurrence_id, recency FROM (SELECT *, row_number() OVER (PARTITION BY stable_id ORDER BY receipt_day DESC, occurrence_id DESC) AS recency FROM findings) WHERE recency <= 4", "findings"))
def e5_recent_n(spark: SparkSession, sf: str) -> DataFrame:
    return E.recent_n(findings(spark, sf), "stable_id", ["receipt_day", "occurrence_id"], 4).select("stable_id", "occurrence_id", "recency")


@query(with_views("SELECT family, source_id, occurrence_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY family, source_id ORDER BY CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END DESC, occurrence_id) AS r FROM findings) WHERE r = 1", "findings"))
def e6_dedupe_findings(spark: SparkSession, sf: str) -> DataFrame:
    return E.dedupe_findings(findings(spark, sf), ["family", "source_id"], "occurrence_id").select("family", "source_id", "occurrence_id", "severity")


@query(with_views("SELECT occurrence_id, risk_score FROM findings ORDER BY risk_score DESC, family, occurrence_id LIMIT 10", "findings"))
def f1_top_findings(spark: SparkSession, sf: str) -> DataFrame:
    return E.top_findings(findings(spark, sf)).select("occurrence_id", "risk_score")


@query(with_views("SELECT family, count(*) AS n FROM findings GROUP BY 1 ORDER BY n DESC, family LIMIT 10", "findings"))
def f2_recurring_families(spark: SparkSession, sf: str) -> DataFrame:
    return E.count_by(findings(spark, sf), "family").orderBy(F.desc("n"), "family").limit(10)


@query(ev_sql(""", r AS (SELECT *, severity IN ('high','critical') OR risk_score >= 80 OR business_severity IN ('BOARD_CRITICAL','EXEC_CRITICAL','REVENUE_CRITICAL') AS high, CASE WHEN DATE '2024-02-01' - receipt_day > 30 THEN 'stale' WHEN DATE '2024-02-01' - receipt_day > 14 THEN 'review_due' ELSE 'fresh' END AS freshness FROM ev) SELECT freshness, high AS high_risk, high AND feedback = 0 AND active = 0 AS needs_review, count(*) AS n FROM r GROUP BY 1, 2, 3"""))
def b13_b14_review_state(spark: SparkSession, sf: str) -> DataFrame:
    r = E.review_state(evidence(spark, sf), F.col("receipt_day"), now())
    return E.count_by(r, "freshness", "high_risk", "needs_review")


@query(with_views("SELECT exception_id, CASE WHEN reason IS NULL THEN 'invalid' WHEN expires_on < DATE '2024-02-01' THEN 'expired' ELSE 'active' END AS status FROM exceptions", "exceptions"))
def b15_exception_status(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "exceptions").select("exception_id", E.exception_status(F.col("reason"), F.col("expires_on"), now()).alias("status"))


@query(with_views("SELECT disposition, count(*) AS n FROM feedback GROUP BY 1", "feedback"))
def b16_normalize_disposition(spark: SparkSession, sf: str) -> DataFrame:
    loud = view(spark, sf, "feedback").select(F.upper(F.replace("disposition", F.lit("_"), F.lit("-"))).alias("d"))
    return E.count_by(loud.select(E.normalize_disposition(F.col("d")).alias("disposition")), "disposition")


@query(with_views("SELECT source_id, CASE WHEN source_id = 'model_1' THEN 'REVENUE_CRITICAL' WHEN source_id LIKE '%customer%' THEN 'CUSTOMER_FACING' ELSE 'UNKNOWN' END AS business_severity, count(*) AS n FROM findings GROUP BY 1, 2", "findings"))
def b12_business_severity(spark: SparkSession, sf: str) -> DataFrame:
    reg = spark.createDataFrame([("model_1", "REVENUE_CRITICAL")], "key string, severity string")
    return E.count_by(E.business_severity(findings(spark, sf).select("source_id"), reg, ["source_id"]), "source_id", "business_severity")


@query(with_views("""SELECT occurrence_id, least(100, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END * 25 + least(occurrence_id % 8, 5) * 5 + CASE WHEN business_severity IN ('BOARD_CRITICAL','EXEC_CRITICAL','REVENUE_CRITICAL') THEN 15 ELSE 0 END + CASE WHEN monthly_cost > 50 THEN 10 ELSE 0 END) AS risk,
 CASE least(4, CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END + CASE WHEN business_severity IN ('BOARD_CRITICAL','EXEC_CRITICAL','REVENUE_CRITICAL','CUSTOMER_FACING') THEN 1 ELSE 0 END + CASE WHEN replay_ran THEN 1 ELSE 0 END) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END AS severity FROM findings""", "findings"))
def g15_severity_and_risk(spark: SparkSession, sf: str) -> DataFrame:
    f = findings(spark, sf)
    risk = E.risk_score(F.col("severity"), F.col("occurrence_id") % 8, F.col("business_severity").isin(E.HIGH_BUSINESS), F.col("monthly_cost") > 50)
    return f.select("occurrence_id", risk.alias("risk"), E.finding_severity(F.col("severity"), F.col("business_severity"), F.col("replay_ran")).alias("severity"))


_SENSITIVE = "CASE c_custkey % 7 WHEN 0 THEN 'revenue_critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'EXPERIMENTAL' WHEN 5 THEN NULL ELSE 'CUSTOMER_FACING' END"
_FAMILY = "CASE occurrence_id % 6 WHEN 0 THEN 'join_cardinality' WHEN 1 THEN 'enum_domain_closure' WHEN 2 THEN 'primary_key_changed' WHEN 3 THEN 'metric_formula_changed' WHEN 4 THEN 'freshness_changed' ELSE family END"
_KINDS = {"sure": "CASE occurrence_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' END", "has_diff": "occurrence_id % 5 = 0", "triggered": "occurrence_id % 5 = 1", "excerpt": "occurrence_id % 5 = 2", "structural": "occurrence_id % 7 < 4", "blast_count": "CASE WHEN occurrence_id % 3 = 0 THEN 2 ELSE 0 END"}
_UPPER = "CASE upper(coalesce({c}, 'UNKNOWN')) WHEN 'HIGH' THEN 'REVENUE_CRITICAL' WHEN 'MEDIUM' THEN 'OPERATIONAL' WHEN 'LOW' THEN 'ANALYTICAL' ELSE upper(coalesce({c}, 'UNKNOWN')) END"
_WEIGHT = "CASE WHEN {c} IN ('REVENUE_CRITICAL', 'BOARD_CRITICAL', 'EXEC_CRITICAL') THEN 1.0 WHEN {c} = 'CUSTOMER_FACING' THEN 0.8 WHEN {c} IN ('OPERATIONAL', 'INTERNAL_HIGH') THEN 0.6 WHEN {c} IN ('ANALYTICAL', 'INTERNAL_LOW') THEN 0.35 WHEN {c} = 'EXPERIMENTAL' THEN 0.1 ELSE 0.3 END"
_CAUSAL = f"""WITH RECURSIVE walk(root, node, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer WHERE c_custkey < 25 UNION ALL SELECT walk.root, e.target, walk.depth + 1 FROM walk JOIN edges e ON e.source = walk.node WHERE walk.depth < 8),
 hit AS (SELECT root, depth, c_custkey % 5 = 0 AS contract, {_UPPER.format(c=_SENSITIVE)} AS label FROM walk JOIN customer ON c_custkey = node WHERE depth > 0), rated AS (SELECT *, {_WEIGHT.format(c='label')} AS w FROM hit),
 deps AS (SELECT root, false AS structural, arg_max(label, (w, -depth, label)) AS label, arg_max(depth, (w, -depth, label)) AS distance FROM rated WHERE w >= 0.3 GROUP BY 1 UNION ALL SELECT root, true, arg_max(label, (w, -depth, label)), arg_max(depth, (w, -depth, label)) FROM rated WHERE w >= 0.3 AND contract GROUP BY 1),
 fp AS (SELECT split_part(stable_finding_id, '-', 2) AS family, count(*) FILTER (disposition = 'false_positive')::DOUBLE / count(*) AS rate FROM feedback GROUP BY 1),
 f AS (SELECT occurrence_id, {_FAMILY} AS family, business_severity, replay_status, split_part(source_id, '_', 2)::INT AS root, {', '.join(f'{v} AS {k}' for k, v in _KINDS.items())} FROM findings),
 g AS (SELECT *, family IN ('join_cardinality', 'join_grain_or_fanout', 'grain_change', 'primary_key_changed') AS structural_family FROM f),
 c AS (SELECT *, CASE WHEN structural_family AND NOT structural THEN NULL WHEN has_diff THEN CASE sure WHEN 'high' THEN 0.85 WHEN 'low' THEN 0.65 ELSE 0.75 END WHEN triggered THEN CASE sure WHEN 'high' THEN 0.7 WHEN 'low' THEN 0.5 ELSE 0.6 END WHEN excerpt THEN CASE sure WHEN 'low' THEN 0.4 ELSE 0.55 END END AS change FROM g),
 d AS (SELECT c.*, deps.label, deps.distance AS far, CASE WHEN deps.root IS NULL THEN NULL WHEN deps.structural THEN CASE WHEN deps.distance <= 1 THEN 0.6 ELSE 0.45 END ELSE CASE WHEN deps.distance <= 1 THEN 0.8 WHEN deps.distance = 2 THEN 0.65 ELSE 0.45 END END AS dep_sure, deps.root IS NOT NULL AS dep FROM c LEFT JOIN deps ON deps.root = c.root AND deps.structural = structural_family),
 b AS (SELECT *, blast_count > 0 AND (NOT dep OR {_WEIGHT.format(c='business_severity')} >= {_WEIGHT.format(c='label')}) AS by_blast FROM d),
 k AS (SELECT *, by_blast OR dep AS found, CASE WHEN by_blast THEN 1 ELSE far END AS distance, CASE WHEN by_blast THEN 0.85 ELSE dep_sure END AS known FROM b),
 p AS (SELECT *, CASE WHEN found THEN CASE distance WHEN 1 THEN 1.0 WHEN 2 THEN 0.8 WHEN 3 THEN 0.6 ELSE 0.35 END * CASE WHEN NOT by_blast AND NOT structural_family THEN 0.9 ELSE 1.0 END ELSE 0.2 END AS propagation,
  CASE WHEN change IS NOT NULL AND found THEN least(0.85, greatest(0.65, (change + known) / 2)) WHEN change IS NOT NULL OR found THEN least(0.45, greatest(coalesce(change, 0), coalesce(known, 0), 0.25)) ELSE 0 END AS evidence,
  CASE replay_status WHEN 'drift_detected' THEN 1.2 ELSE 0.85 END AS replay, CASE WHEN by_blast THEN {_WEIGHT.format(c='business_severity')} WHEN found THEN {_WEIGHT.format(c='label')} ELSE 0.3 END AS sensitive,
  CASE family WHEN 'join_cardinality' THEN 0.75 WHEN 'enum_domain_closure' THEN 0.7 WHEN 'primary_key_changed' THEN 1.0 WHEN 'metric_formula_changed' THEN 0.85 WHEN 'freshness_changed' THEN 0.3 ELSE 0.35 END AS severe FROM k),
 s AS (SELECT p.*, least(1.0, propagation::DOUBLE * severe * sensitive * evidence * replay) * (1 - least(0.95, coalesce(rate, 0))) AS causality FROM p LEFT JOIN fp ON fp.family = p.family)
 SELECT occurrence_id, change IS NOT NULL AND found AS two_signal, propagation::DOUBLE AS propagation, evidence::DOUBLE AS evidence, round(causality, 9) AS causality, CASE WHEN causality < 0.05 THEN 'suppressed' WHEN causality < 0.15 THEN 'informational' WHEN causality < 0.4 THEN CASE WHEN change IS NOT NULL AND found AND causality >= 0.35 THEN 'must_review' ELSE 'advisory' END WHEN causality < 0.65 THEN 'must_review' ELSE 'must_review_escalated' END AS route FROM s"""


@query(with_views(_CAUSAL.replace("WITH RECURSIVE ", "WITH ", 1), "findings", "feedback", "edges").replace("WITH ", "WITH RECURSIVE ", 1))
def g16_causality(spark: SparkSession, sf: str) -> DataFrame:
    """Sources are the first 24 nodes of the customers' tree; what they reach within eight steps depends on them."""
    f = findings(spark, sf).selectExpr("*", *[f"{v} AS {k}" for k, v in _KINDS.items()]).withColumn("family", F.expr(_FAMILY)).withColumn("source_id", F.split_part("source_id", F.lit("_"), F.lit(2)).cast("long"))
    f = f.withColumn("change_confidence", E.change_confidence(*[F.col(c) for c in ("family", "sure", "has_diff", "triggered", "excerpt", "structural")]))
    nodes = table(spark, sf, "customer").selectExpr("c_custkey AS node", f"{_SENSITIVE} AS sensitivity", "c_custkey % 5 = 0 AS contract")
    hit = G.reach(view(spark, sf, "edges"), f.select(F.col("source_id").alias("root")).distinct()).join(nodes, "node").withColumnRenamed("root", "source_id")
    fb = view(spark, sf, "feedback").groupBy(F.split_part("stable_finding_id", F.lit("-"), F.lit(2)).alias("family")).agg((F.count_if(F.col("disposition") == "false_positive") / F.count("*")).alias("false_positive_rate"))
    return E.causality(f, E.dependency_signals(hit), fb).select("occurrence_id", "two_signal", "propagation", "evidence", F.round("causality", 9).alias("causality"), "route")


_BLAST = "CASE WHEN blast <= 0 THEN 0.1::DOUBLE ELSE least(1.0::DOUBLE, log10(blast + 1) / log10(51.0::DOUBLE)) END"
_PRIORITY = f"""WITH f AS (SELECT *, occurrence_id % 60 * CASE WHEN occurrence_id % 9 = 0 THEN 0 ELSE 1 END AS blast, CASE occurrence_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS sure, occurrence_id % 8 = 0 AS diff, CASE WHEN occurrence_id % 16 = 4 THEN NULL ELSE fidelity_score END AS known FROM findings),
 t AS (SELECT *, CASE WHEN replay_ran OR replay_status = 'drift_detected' THEN 3 WHEN diff THEN 2 WHEN known IS NOT NULL THEN 1 ELSE 0 END AS tier FROM f),
 r AS (SELECT *, round_even(100 * ({_BLAST} * CASE business_severity WHEN 'REVENUE_CRITICAL' THEN 1.0::DOUBLE WHEN 'CUSTOMER_FACING' THEN 0.8::DOUBLE WHEN 'UNKNOWN' THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END) * (CASE tier WHEN 3 THEN 1.0::DOUBLE WHEN 2 THEN 0.8::DOUBLE WHEN 1 THEN 0.65::DOUBLE ELSE 0.4::DOUBLE END * CASE sure WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.65::DOUBLE ELSE 0.35::DOUBLE END * CASE WHEN tier = 3 THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END), 0) AS raw FROM t),
 c AS (SELECT *, least(raw, CASE WHEN tier < 2 THEN 80 ELSE 100 END, CASE WHEN blast = 0 THEN 60 ELSE 100 END, CASE WHEN sure = 'low' THEN CASE WHEN blast = 0 THEN 35 ELSE 50 END ELSE 100 END) AS capped FROM r),
 k AS (SELECT *, CASE WHEN sure <> 'high' THEN capped WHEN business_severity = 'REVENUE_CRITICAL' THEN greatest(capped, CASE WHEN blast > 0 THEN 45 ELSE 35 END) WHEN business_severity = 'CUSTOMER_FACING' AND blast > 0 THEN greatest(capped, 35) ELSE capped END AS s FROM c)
 SELECT occurrence_id, s::INT AS score, tier, CASE WHEN s >= 80 THEN 'block candidate' WHEN s >= 65 THEN 'review strongly recommended' WHEN s >= 45 THEN 'review recommended' WHEN s >= 25 THEN 'advisory' ELSE 'informational' END AS band FROM k"""


@query(with_views(_PRIORITY, "findings"))
def g24_review_priority(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("occurrence_id")
    f = assured(findings(spark, sf)).withColumns({"blast_count": F.when(n % 9 == 0, 0).otherwise(n % 60), "has_diff": n % 8 == 0, "fidelity_score": F.when(n % 16 != 4, F.col("fidelity_score"))})
    return E.review_priority(f).select("occurrence_id", "score", "tier", "band")


@query(with_views("""WITH s AS (SELECT occurrence_id, family, occurrence_id % 2 = 0 AS a, occurrence_id % 3 = 0 AS b, occurrence_id % 5 = 0 AS c, round(least(0.95, 0.20 + CASE WHEN replay_ran THEN 0.18 ELSE 0 END + CASE occurrence_id % 3 WHEN 0 THEN 0.16 WHEN 1 THEN 0.08 ELSE 0 END + CASE WHEN occurrence_id % 2 = 0 THEN 0.10 ELSE 0 END + CASE WHEN occurrence_id % 3 = 0 THEN 0.10 ELSE 0 END + CASE WHEN occurrence_id % 5 = 0 THEN 0.12 ELSE 0 END + CASE occurrence_id % 4 WHEN 0 THEN 0.14 WHEN 1 THEN 0.08 ELSE 0 END + CASE WHEN occurrence_id % 2 = 0 THEN 0.10 ELSE 0 END + CASE WHEN occurrence_id % 5 = 0 THEN 0.06 ELSE 0 END), 2)::DOUBLE AS score FROM findings)
 SELECT occurrence_id, score, CASE WHEN score >= 0.78 THEN 'high_static_history_fidelity' WHEN score >= 0.55 THEN 'medium_static_fidelity' ELSE 'low_static_fidelity' END AS level, CASE WHEN (a OR b OR c) AND NOT ((family = 'view' AND NOT a) OR (family = 'click' AND NOT b) OR (family = 'purchase' AND NOT c) OR family IN ('signup', 'error')) THEN 'covered' WHEN a OR b OR c THEN 'partial' ELSE 'weak' END AS coverage FROM s""", "findings"))
def g15_fidelity_and_coverage(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("occurrence_id")
    even, third, fifth = n % 2 == 0, n % 3 == 0, n % 5 == 0
    text = F.when(third, "compiled").when(n % 3 == 1, "raw")
    costed = F.when(n % 4 == 0, "history").when(n % 4 == 1, "estimate")
    kinds = {"view": "join_cardinality", "click": "incremental_filter", "purchase": "enum_domain_closure", "signup": "null_default_fallback", "error": "temporal_bucket"}
    family = E.lookup(F.col("family"), kinds, "other")
    fid = E.fidelity(F.col("replay_ran"), text, even, third, fifth, costed, even, fifth)
    cov = E.control_coverage(family, even, third, fifth, fifth)
    return findings(spark, sf).select("occurrence_id", fid["score"].alias("score"), fid["level"].alias("level"), cov["status"].alias("coverage"))
