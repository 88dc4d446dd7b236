"""Known answers of the rules for enforcement tiers, causality and evaluation."""

import statistics

from pyspark.sql import functions as F

from veridelta.operators import evidence

RUN = "repo string, team string, verdict string, confidence string, primary_reason string, would_block boolean, would_review boolean, assumptions int, critical_assumptions int, savings decimal(12,2), weekly_cost decimal(12,2), monthly_cost decimal(12,2), risk_categories array<string>, patterns array<string>"


def rollup(spark, runs, feedback):
    from decimal import Decimal

    r = spark.createDataFrame([(repo, None, "BLOCK", conf, None, block, review, 2, crit, Decimal(save), Decimal(1), Decimal(4), cats, pats) for repo, conf, block, review, crit, save, cats, pats in runs], RUN)
    f = spark.createDataFrame(feedback, "repo string, team string, outcome string")
    return {(x.scope, x.value): x for x in evidence.shadow_rollup(r, f).collect()}


def run(repo, conf="high", block=False, review=False, crit=0, save=0, cats=None, pats=None):
    return (repo, conf, block, review, crit, save, cats, pats)


def test_tiers_of_enforcement(spark):
    fb = lambda repo, good, bad: [(repo, "t", "confirmed")] * good + [(repo, "t", "noisy")] * bad
    runs = [run("few")] * 2 + [run("noisy", save=900)] * 5 + [run("strong", save=200, cats=["financial", "semantic"])] * 5
    runs += [run("blocky", block=True, save=200)] * 5 + [run("review", "low", review=True)] * 3 + [run("calm", "low")] * 4 + [run("broad", "low", review=True)] * 20 + [run("", "low")] * 3
    feedback = fb("few", 9, 0) + fb("noisy", 4, 6) + fb("strong", 8, 2) + fb("blocky", 9, 1) + fb("review", 7, 3) + fb("calm", 7, 3) + fb("broad", 3, 2) + fb("only_feedback", 1, 1)
    got = rollup(spark, runs, feedback)
    tier = lambda repo: got["repo", repo].tier
    assert tier("few") == tier("noisy") == tier("only_feedback") == "TIER_0_SHADOW_ONLY" and tier("unknown_repo") == "TIER_0_SHADOW_ONLY"
    assert tier("strong") == "TIER_3_SELECTIVE_BLOCK" and got["repo", "strong"].hard_block == ["high_confidence_financial_blowup", "high_confidence_semantic_or_assumption_break"]
    assert tier("blocky") == "TIER_2_REQUIRE_REVIEW" and got["repo", "blocky"].enforcement_reasons == ["recurring_or_costly", "blocks_too_often"]
    assert tier("review") == "TIER_2_REQUIRE_REVIEW" and tier("calm") == "TIER_1_ADVISORY"
    assert tier("broad") == "TIER_1_ADVISORY" and got["repo", "broad"].enforcement_reasons == ["advisory_until_more_evidence", "reviews_too_broad"]
    assert got["repo", "only_feedback"].runs == 0 and got["repo", "only_feedback"].feedback == 2 and got["team", "t"].runs == 0
    assert got["global", "all"].runs == len(runs) and got["team", "unknown_team"].runs == len(runs)


def test_patterns_are_the_most_frequent(spark):
    runs = [run("r", pats=[f"p{j}" for j in range(12) if i % (j + 1) == 0] + ["tie_a", "tie_b"]) for i in range(24)]
    got = rollup(spark, runs, [])["repo", "r"]
    assert [(x.name, x.n) for x in got.top_patterns] == [("p0", 24), ("tie_a", 24), ("tie_b", 24), ("p1", 12), ("p2", 8), ("p3", 6), ("p4", 5), ("p5", 4)]
    assert got.verdicts == {"BLOCK": 24} and got.reasons == {"unknown": 24} and got.average_assumptions == 2.0


def score(spark, family="metric_formula_changed", label="REVENUE_CRITICAL", blast=0, change=0.85, replay="drift_detected", deps=None, own=None, fp=None):
    f = spark.createDataFrame([(1, family, "s", label, blast, change, replay)], "id int, family string, source_id string, business_severity string, blast_count int, change_confidence double, replay_status string")
    d = None
    if deps is not None:
        d = evidence.dependency_signals(spark.createDataFrame(deps, "source_id string, node string, depth int, sensitivity string, contract boolean"), own)
    return evidence.causality(f, d, spark.createDataFrame([(family, fp)], "family string, false_positive_rate double") if fp is not None else None).first()


def test_causality_by_distance_and_replay(spark):
    at = lambda depth, label="REVENUE_CRITICAL": [("s", "n", depth, label, False)]
    carries = [score(spark, deps=at(d)).propagation for d in (1, 2, 3, 4)]
    assert [round(x, 6) for x in carries] == [0.9, 0.72, 0.54, 0.315]  # lineage alone counts a tenth less
    near = score(spark, deps=at(1))
    assert near.two_signal and near.evidence == 0.825 and abs(near.causality - 0.9 * 0.85 * 1.0 * 0.825 * 1.2) < 1e-12 and near.route == "must_review_escalated"
    assert [score(spark, deps=at(1), replay=r).replay_factor for r in ("confirmed", "clean", "error", "not_run", None)] == [1.2, 0.5, 0.6, 0.85, 0.85]
    own = score(spark, blast=3)
    assert own.propagation == 1.0 and own.evidence == 0.7
    assert score(spark, blast=3, fp=0.5).causality == own.causality / 2 and score(spark, blast=3, fp=2.0).causality < 0.06 * own.causality


def test_causality_needs_two_signals(spark):
    alone = score(spark, deps=[])
    assert not alone.two_signal and alone.propagation == 0.2 and alone.evidence == 0.45 and alone.route == "informational" or alone.route == "suppressed"
    silent = score(spark, change=None, deps=[])
    assert silent.evidence == 0 and silent.route == "suppressed"
    assert score(spark, change=None, blast=2).evidence == 0.45
    # less sensitive than unknown never counts; of equals the nearest does
    assert not score(spark, deps=[("s", "n", 1, "experimental", False)]).two_signal
    assert round(score(spark, deps=[("s", "a", 3, "high", False), ("s", "b", 2, "REVENUE_CRITICAL", False), ("s", "c", 1, "low", False)]).propagation, 6) == 0.72


def test_structural_families_need_contracts(spark):
    lineage, contract = [("s", "n", 1, "high", False)], [("s", "n", 1, "high", False), ("s", "k", 2, "medium", True)]
    assert not score(spark, family="join_cardinality", deps=lineage).two_signal
    got = score(spark, family="join_cardinality", deps=contract)
    assert got.two_signal and got.propagation == 0.8 and abs(got.evidence - (0.85 + 0.45) / 2) < 1e-12
    say = lambda family, structural: spark.range(1).select(evidence.change_confidence(F.lit(family), F.lit("high"), F.lit(True), F.lit(True), F.lit(True), F.lit(structural))).first()[0]
    assert say("primary_key_changed", False) is None and say("primary_key_changed", True) == 0.85 and say("filter_changed", False) == 0.85


def test_own_sensitivity_is_a_fallback(spark):
    own = spark.createDataFrame([("s", "high", False), ("t", "low", True), ("u", None, False)], "source_id string, sensitivity string, has_contracts boolean")
    none = spark.createDataFrame([("t", "n", 1, "high", False)], "source_id string, node string, depth int, sensitivity string, contract boolean")
    got = {(r.source_id, r.kind): (r.label, r.distance, r.confidence) for r in evidence.dependency_signals(none, own).collect()}
    assert got == {("t", "downstream"): ("REVENUE_CRITICAL", 1, 0.8), ("s", "own"): ("REVENUE_CRITICAL", 0, 0.55)}


def test_evaluation_of_verdicts(spark):
    v = evidence.VERDICTS
    rows = [(f"c{i % 3}" if i % 10 else None, v[i % 4], v[(i * 3) % 4] if i % 7 else "odd", (i * 37 % 50) / 50 if i % 6 else None) for i in range(101)]
    df = spark.createDataFrame(rows, "class string, expected string, predicted string, confidence double")
    got = {r["class"]: r for r in evidence.eval_by_class(df).collect()}
    for c in ("c0", "c1", "c2", None):
        own = [r for r in rows if c is None or r[0] == c]
        near = [r for r in own if r[2] in v and abs(v.index(r[1]) - v.index(r[2])) <= 1]
        assert got[c].records == len(own) and abs(got[c].near_accuracy - len(near) / len(own)) < 1e-12
        assert abs(got[c].exact_accuracy - sum(r[1] == r[2] for r in own) / len(own)) < 1e-12 and abs(got[c].confidence_median - statistics.median(r[3] or 0 for r in own)) < 1e-12
        assert got[c].predicted_block == sum(r[2] == "BLOCK" for r in own)
    cells = {r.expected: r for r in evidence.confusion(df).collect()}
    assert all(cells[a][b] == sum(r[1] == a and r[2] == b for r in rows) for a in v for b in v)
    assert evidence.eval_by_class(df.limit(0)).count() == 0 and evidence.confusion(df.limit(0)).agg(F.sum("BLOCK")).first()[0] == 0
