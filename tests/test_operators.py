"""Cases that the queries over the given tables don't reach."""

import math
import random

from veridelta.operators import compare, evidence, matching, perturb, workload
from veridelta.streaming import jobs


def test_fingerprint_sees_where_nulls_are(spark):
    a = spark.createDataFrame([("x", None), ("y", "z")], "p string, q string")
    b = spark.createDataFrame([(None, "x"), ("y", "z")], "p string, q string")
    assert compare.compare_results(a, b).first().status == "VALUE_DRIFT"
    assert compare.compare_results(a, a.repartition(3)).first().status == "PASSED"
    assert compare.compare_results(a.limit(0), a.limit(0)).first().status == "PASSED"


def test_columns_match_across_type_families(spark):
    shape = "name string, family string, nullable boolean, is_key boolean, cardinality double"
    src = spark.createDataFrame([("order_id", "integer", False, True, 1.0), ("note", "text", True, False, 0.2)], shape)
    tgt = spark.createDataFrame([("order_id", "string", False, True, 1.0), ("zzz_total", "integer", True, False, 0.1)], shape)
    got = {r.source: (r.target, r.decision) for r in matching.match_columns(src, tgt).collect()}
    assert got["order_id"] == ("order_id", "review") and set(got) == {"order_id", "note"}
    assert {(r.source, r.target, r.decision) for r in matching.match_columns(src, tgt.limit(0)).collect()} == {("order_id", None, "unmapped"), ("note", None, "unmapped")}


def test_roles_of_hypotheses(spark):
    rows = [(1, "a", 0.9, True), (2, "a", 1.0, False), (3, "a", 0.8, True), (4, "a", 0.0, True), (5, "b", 1.0, False), (6, "b", 0.0, True)]
    df = spark.createDataFrame(rows, "occurrence_id long, day string, specificity double, has_event boolean").selectExpr("*", "0.5D AS dependency", "0.5D AS fidelity_score", "0.5D AS actionability")
    assert {r.occurrence_id: r.role for r in evidence.rank_hypotheses(df, "day").collect()} == {1: "primary", 2: "advisory", 3: "secondary", 4: "advisory", 5: "suppressed", 6: "suppressed"}


def test_evidence_counts_each_row_once(spark):
    """Repeated feedback and exceptions, several scopes, null keys; equal to matching row by row."""
    f = spark.createDataFrame([(1, "s1", "fam", "src", "2024-01-01"), (2, "s1", "fam", None, "2024-01-02"), (3, None, None, None, None)], "occurrence_id long, stable_id string, family string, source_id string, receipt_day string")
    fb = spark.createDataFrame([(1, "s1", "agree"), (1, "s1", "agree"), (2, "s1", "fixed"), (3, "zz", "agree")], "feedback_id long, stable_finding_id string, disposition string")
    ex = spark.createDataFrame([(1, "family", "fam", "ok", "2025-01-01"), (1, "family", "fam", "ok", "2025-01-01"), (2, "source", "src", "ok", "2023-01-01"), (3, "global", None, "ok", "2025-01-01"), (4, "family", "fam", None, "2025-01-01")], "exception_id long, scope string, value string, reason string, expires_on string")
    from pyspark.sql import functions as F

    now = F.lit("2024-02-01")
    got = {r.occurrence_id: (r.feedback, r.agree, r.fixed, r.active, r.expired) for r in evidence.with_evidence(f, fb, ex, now).collect()}
    assert got == {1: (2, 1, 1, 2, 1), 2: (2, 1, 1, 2, 0), 3: (0, 0, 0, 1, 0)}
    slow = {(r.occurrence_id, r.n) for r in evidence.match_exceptions(f, ex, now).groupBy("occurrence_id").agg(F.count("*").alias("n")).collect()}
    assert slow == {(1, 3), (2, 2), (3, 1)}


def test_nearest_rank_equals_sorting(spark):
    """Few and many rows a key, ties, null keys and values, an empty table; equal to sorting each key whole."""
    rows = [(k, float((i * 37) % m) if i % 13 else None) for k, n, m in (("a", 1, 5), ("b", 2, 50), ("c", 12, 3), (None, 40, 1000), ("d", 3000, 997), ("e", 2000, 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {}
    for p in (0.0, 0.5, 0.95, 1.0):
        for key in {k for k, _ in rows}:
            values = sorted(v for k, v in rows if k == key and v is not None)
            if values:
                want[p, key] = values[min(len(values) - 1, round((len(values) - 1) * p))]
    got = {(p, r.k): r.percentile for p in (0.0, 0.5, 0.95, 1.0) for r in workload.nearest_rank(df, ["k"], "v", p).collect()}
    assert got == want
    assert workload.nearest_rank(df.limit(0), ["k"], "v").count() == 0


def test_late_events_equal_one_pass(spark):
    """A hot key over many ranges, ties in time, null keys and times; equal to one pass in order of arrival."""
    from pyspark.sql import functions as F

    rows = [("hot" if i % 3 else None, (i * 7919) % 5003 if i % 17 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, a int").withColumn("ts", F.timestamp_seconds(F.col("t") * 60))
    newest, want = {}, set()
    for k, t, a in rows:
        if t is not None:
            if k in newest and newest[k] - t > 100:
                want.add((a, float(newest[k] - t)))
            newest[k] = max(newest.get(k, t), t)
    assert {(r.a, r.lag_minutes) for r in jobs.late_events(df, "ts", "a", "k", 100).collect()} == want


def test_first_keys_of_repeated_splits(spark, monkeypatch):
    """Ranges are split again until few rows are left; nulls, predicates and empty tables."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(perturb, "FEW", 7)
    df = spark.range(5000).select((F.col("id") * 3).alias("k"), (F.col("id") % 2 == 0).alias("even"))
    for share in (0.0001, 0.15, 0.5, 1.0):
        n = max(1, -int(-5000 * share // 1))
        assert df.where(perturb.first_k_by_key(df, "k", share)).agg(F.count("*"), F.max("k")).first() == (n, 3 * (n - 1))
    assert df.where(perturb.first_k_by_key(df, "k", 0.1, F.col("even"))).count() == 250
    assert df.where(perturb.first_k_by_key(df.limit(0), "k", 0.1)).count() == 0


def test_review_priority_limits(spark):
    shape = "id int, blast_count int, business_severity string, confidence string, replay_ran boolean, replay_status string, fidelity_score double, has_diff boolean"
    rows = [(1, 60, "REVENUE_CRITICAL", "high", True, "passed", 0.9, False), (2, 0, "REVENUE_CRITICAL", "high", False, "not_run", None, False), (3, 60, "REVENUE_CRITICAL", "low", True, "passed", 0.9, False), (4, 1, "CUSTOMER_FACING", "high", False, "not_run", 0.2, False), (5, None, None, None, None, None, None, None)]
    got = {r.id: (r.score, r.band, r.tier, list(r.caps), r.floor) for r in evidence.review_priority(spark.createDataFrame(rows, shape)).collect()}
    assert got[1] == (100, "block candidate", 3, [], None)
    assert got[2] == (35, "advisory", 0, [], "revenue_high_confidence_floor_35")
    assert got[3][0] == 35 and got[4] == (35, "advisory", 1, [], "customer_high_confidence_blast_floor_35")
    assert got[5] == (1, "informational", 0, [], None)


def _vectors(spark, n, name, noise, seed):
    import numpy as np

    rng, base = np.random.default_rng(seed), np.random.default_rng(1).normal(size=(n, 32))
    vec = base + noise * rng.normal(size=(n, 32))
    rows = [(f"{name}{i}" if i % 4 else f"shared_token{i}_{name}", "INTEGER", True, False, (i % 10) / 10, [f"t{i % 40}"] if i % 3 == 0 else None, [float(x) for x in v] if i % 9 else None) for i, v in enumerate(vec)]
    return spark.createDataFrame(rows, "name string, family string, nullable boolean, is_key boolean, cardinality double, refs array<string>, vec array<double>")


def test_candidates_by_planes_find_most_matches(spark):
    """Recall of the candidates against all pairs, among matches that are kept."""
    src, tgt = _vectors(spark, 300, "old", 0.0, 2), _vectors(spark, 300, "new", 0.25, 3)
    every = {r.source: r for r in matching.match_columns(src, tgt).collect()}
    some = {r.source: r for r in matching.match_columns(src, tgt, matching.Planes()).collect()}
    mapped = [s for s, r in every.items() if r.decision != "unmapped"]
    assert every.keys() == some.keys() and len(mapped) > 250
    assert sum(some[s].target == every[s].target for s in mapped) >= 0.9 * len(mapped)
    pairs = matching.match_candidates(src, tgt, matching.Planes()).count()
    assert pairs < 0.3 * 300 * 300


def test_blocks_of_sources_give_the_same(spark, monkeypatch):
    src, tgt = _vectors(spark, 60, "old", 0.0, 2), _vectors(spark, 50, "new", 0.25, 3)
    whole = {tuple(r) for r in matching.match_columns(src, tgt).collect()}
    monkeypatch.setattr(matching, "BLOCK", 7)
    assert {tuple(r) for r in matching.match_columns(src, tgt).collect()} == whole
    left = {r.name for r in matching.unmapped_targets(matching.match_columns(src, tgt), tgt).collect()}
    assert left == {r.name for r in tgt.collect()} - {t for _, t, _, d in whole if d != "unmapped"}


def test_identity_needs_three_anchors(spark):
    shape = "id string, vec array<double>, refs array<string>"
    before = spark.createDataFrame([("a", [1.0, 0.0], ["b", "c", "d"]), ("b", [0.0, 1.0], []), ("c", [1.0, 1.0], ["b"]), ("d", [0.5, 0.1], None), ("e", [1.0, 2.0], ["x"])], shape)
    after = spark.createDataFrame([("a", [1.0, 0.0], ["d", "c", "b"]), ("b", [0.0, 1.0], []), ("c", [1.0, 1.0], ["a"]), ("d", [0.5, 0.1], None)], shape)
    got = {r.id: (round(r.score, 6) if r.score is not None else None, r.verdict) for r in matching.identity_check(before, after).collect()}
    assert got == {"a": (1.0, "rename"), "b": (1.0, "rename"), "c": (0.98, "rename"), "d": (1.0, "rename"), "e": (None, "block")}
    two = {r.id: r.anchor_delta for r in matching.identity_check(before, after.where("id <> 'd'")).collect()}
    assert set(two.values()) == {None}


def test_positions_of_a_hot_receipt(spark):
    """A receipt with most rows, ties, null keys; equal to a window, and dealt to many tasks evenly."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(6000).select("id", F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.concat(F.lit("r"), F.col("id") % 7)).alias("day"), (F.col("id") * 7919 % 101).alias("score"))
    order = [F.desc("score"), F.col("id")]
    want = {(r.id, r.pos) for r in df.withColumn("pos", F.row_number().over(Window.partitionBy("day").orderBy(*order))).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be joined
    try:
        out = evidence.positions(df, "day", order)
        assert {(r.id, r.pos) for r in out.collect()} == want
        dealt = [r["count"] for r in df.repartitionByRange("day", *order).groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(dealt) == 8 and max(dealt) < 2 * 6000 / 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert evidence.positions(df.limit(0), "day", order).count() == 0


def test_global_exceptions_meet_all_findings_without_one_key(spark):
    from pyspark.sql import functions as F

    f = spark.range(500).selectExpr("id AS occurrence_id", "cast(null AS string) AS stable_id", "'fam' AS family", "'s' AS source_id", "'d' AS receipt_day")
    ex = spark.createDataFrame([(1, "global", None, "ok", "2025-01-01"), (2, "global", "x", "ok", "2023-01-01"), (3, "global", None, "", "2025-01-01")], "exception_id long, scope string, value string, reason string, expires_on string")
    got = evidence.match_exceptions(f, ex, F.lit("2024-02-01")).groupBy("exception_id", "status").agg(F.count("*").alias("n")).collect()
    assert {(r.exception_id, r.status, r.n) for r in got} == {(1, "active", 500), (2, "expired", 500)}


def test_softmax_over_blocks_and_odd_vectors(spark, monkeypatch):
    """Null, zero, short and null-filled vectors, in several blocks and tiles; no pair is shuffled."""
    monkeypatch.setattr(matching, "BLOCK", 4)
    monkeypatch.setattr(matching, "TILE", 7)
    rng = random.Random(2)
    vecs = {i: [rng.uniform(-1, 1) for _ in range(3)] for i in range(30)} | {30: None, 31: [0.0, 0.0, 0.0], 32: [1.0, 2.0], 33: [1.0, None, 2.0], 34: []}
    df = spark.createDataFrame(list(vecs.items()), "id int, vec array<double>").repartition(3)

    def cosine(a, b):
        norm = [math.sqrt(sum(x * x for x in v)) if v is not None and None not in v else 0 for v in (a, b)]
        return 0.0 if not norm[0] * norm[1] else None if len(a) != len(b) else sum(x * y for x, y in zip(a, b)) / norm[0] / norm[1]

    out = matching.embedding_softmax(df.where("id % 3 = 0"), df)
    got = {(r.src_id, r.tgt_id): (r.cosine, r.share) for r in out.collect()}
    assert len(got) == 12 * 35
    for i in range(0, 35, 3):
        want = {j: cosine(vecs[i], v) for j, v in vecs.items()}
        total = sum(math.exp(c) for c in want.values() if c is not None)
        for j, c in want.items():
            assert (got[i, j] == (None, None)) if c is None else (abs(got[i, j][0] - c) < 1e-12 and abs(got[i, j][1] - math.exp(c) / total) < 1e-12)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def _catalog(rng, n, letters):
    """Odd columns: nulls, repeated and null references, vectors of other lengths, with nulls, or zero, names of several scripts."""
    def vec():
        v = [rng.uniform(-1, 1) for _ in range(rng.choice([4, 4, 4, 3]))]
        return rng.choice([v, v, v, None, [0.0] * 4, [1.0, None, 0.0, 1.0]])

    names = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(n)}
    refs = lambda: rng.choice([None, [], [rng.choice("uvw") for _ in range(rng.randint(1, 4))], ["u", None]])
    return [(x, rng.choice(["A", "B", None]), rng.choice([True, False, None]), rng.choice([True, False]), rng.choice([0.0, 0.5, 1.0, None]), refs(), vec()) for x in sorted(names)]


def test_best_matches_are_those_of_all_pairs(spark, monkeypatch):
    """Against the confidence of every pair by SQL functions, over several groups; pairs aren't shuffled."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    shape = "name string, family string, nullable boolean, is_key boolean, cardinality double, refs array<string>, vec array<double>"
    src, tgt = (spark.createDataFrame(_catalog(rng, n, "aB_-é𝔘1 x"), shape) for n in (60, 90))
    monkeypatch.setattr(matching, "SOURCES", 25)
    monkeypatch.setattr(matching, "TARGETS", 40)
    monkeypatch.setattr(matching, "TILE", 300)
    x, y = F.col("s"), F.col("t")
    names = 0.5 * matching.rename_similarity(x["name"], y["name"]) + 0.5 * matching.edit_ratio(x["name"], y["name"])
    refs = [F.array_distinct(F.coalesce(c["refs"], F.array().cast("array<string>"))) for c in (x, y)]
    near = F.when((F.size(refs[0]) == 0) & (F.size(refs[1]) == 0), 0.5).otherwise(matching.jaccard(*refs))
    vector = F.when(x["vec"].isNull() | y["vec"].isNull(), 0.5).otherwise(matching.cosine(x["vec"], y["vec"]))
    weights = matching.WEIGHTS
    confidence = weights["name"] * names + weights["structure"] * matching.structural_score("s", "t") + weights["neighbourhood"] * near + weights["vector"] * vector
    pairs = src.select(F.struct("*").alias("s")).crossJoin(tgt.select(F.struct("*").alias("t"))).select(F.col("s.name").alias("source"), F.col("t.name").alias("target"), confidence.alias("c"))
    best = lambda p: {r.source: (r.b.target, None if r.b.c is None else round(r.b.c, 9)) for r in p.groupBy("source").agg(F.min_by(F.struct("target", "c"), F.struct(F.col("c").isNull(), -F.round("c", 9), "target")).alias("b")).collect()}
    got = lambda df: {r.source: (r.target, None if r.confidence is None else round(r.confidence, 9)) for r in df.where("target is not null").collect()}
    assert got(matching.match_columns(src, tgt)) == best(pairs)
    some = {k: v for k, v in best(pairs.join(matching.match_candidates(src, tgt, matching.Planes()), ["source", "target"])).items() if v[1] is not None}
    assert {k: v for k, v in got(matching.match_columns(src, tgt, matching.Planes())).items() if v[1] is not None} == some
    plan = matching.match_columns(src, tgt)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_targets_alike_are_bounded_together(monkeypatch):
    """Sources meet classes of targets, not each of them."""
    import pyarrow as pa

    shape = pa.schema([("name", pa.string()), ("low", pa.string()), ("chars", pa.int32()), ("tokens", pa.list_(pa.string())), ("family", pa.string()), ("nullable", pa.int32()), ("is_key", pa.int32()), ("cardinality", pa.float64()), ("refs", pa.list_(pa.string())), ("vec", pa.list_(pa.float64()))])

    def catalog(n, word):
        names = [f"{word}{i % 7}_{i}" for i in range(n)]
        return pa.Table.from_pylist([{"name": x, "low": x, "chars": len(x), "tokens": x.split("_"), "family": f"f{i % 5}", "nullable": i % 2, "is_key": 0, "cardinality": i % 50 / 50, "refs": [f"r{i % 9}"], "vec": None} for i, x in enumerate(names)], schema=shape)

    seen, jaccard = [], matching._Sets.jaccard
    monkeypatch.setattr(matching._Sets, "jaccard", lambda self, shared, *more: (seen.append(shared.size), jaccard(self, shared, *more))[1])
    s, t = catalog(100, "item"), catalog(20_000, "item")
    got = matching._best_of(s, t)
    assert got.column("source").to_pylist() == got.column("target").to_pylist() and min(got.column("confidence").to_pylist()) > 0.82
    assert sum(seen) < 0.2 * 2 * 100 * 20_000


def test_edit_distances_of_short_and_long_texts():
    import numpy as np

    def plain(a, b):
        row = list(range(len(b) + 1))
        for x, p in enumerate(a):
            last, row = row, [x + 1]
            for y, q in enumerate(b):
                row.append(min(row[y] + 1, last[y + 1] + 1, last[y] + (p != q)))
        return row[-1]

    rng = random.Random(3)
    for most in (12, 64, 65, 90):  # numbers of 64 bits hold the first two
        a, b = (["", "a" * most] + ["".join(rng.choice("ab𝔘é_") for _ in range(rng.randint(0, most))) for _ in range(12)] + ([] if k else ["b"]) for k in range(2))
        i, j = np.divmod(np.arange(len(a) * len(b)), len(b))
        assert list(matching._edits(a, b + ["zü"])(i, j)) == [plain(a[x], b[y]) for x, y in zip(i, j)]


def test_bands_in_groups_are_those_of_sql(spark):
    """Vectors are told apart by the same hyperplanes; SQL's lambda functions aren't run for each match."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    rng, p = random.Random(4), matching.Planes(bands=5, bits=3)
    vecs = [[rng.uniform(-1, 1) for _ in range(rng.choice([6, 9]))] for _ in range(60)] + [None, [], [0.0] * 6, [1.0, None], [float("nan"), 1.0]]
    df = spark.createDataFrame(list(enumerate(vecs)), "id int, vec array<double>")
    sql = [r.b for r in df.orderBy("id").select(matching.plane_bands(F.col("vec"), p).alias("b")).collect()]
    got = matching._bands(pa.chunked_array([pa.array(vecs, pa.list_(pa.float64()))]), pa.chunked_array([pa.array([True] * len(vecs))]), p).to_pylist()
    pairs = {(x, y) for a, b in zip(got, sql) for x, y in zip(a, b)}
    assert len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}) > 30
    src, tgt = _vectors(spark, 5, "old", 0.0, 2), _vectors(spark, 5, "new", 0.25, 3)
    assert "band" not in matching.match_columns(src, tgt, p)._jdf.queryExecution().optimizedPlan().toString().replace("banded", "")
