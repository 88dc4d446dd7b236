"""Renamed tables, classes from samples and chains of keys against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from veridelta.operators import profile, snapshot

SHAPE = "table_name string, column_name string, dtype string, family string, nullable boolean, null_rate double, cardinality double"


def catalog(spark, tables):
    rows = [(t, c, d, "X", False, 0.0, 0.5) for t, cols in tables.items() for c, d in cols]
    return spark.createDataFrame(rows, SHAPE)


def test_renamed_tables_equal_comparing_all(spark):
    rng = random.Random(7)
    usual = [("id", "bigint"), ("created_at", "timestamp")]
    before = {f"old{i}": usual + [(f"c{rng.randrange(40)}", "int") for _ in range(rng.randrange(0, 9))] for i in range(60)}
    after = {f"old{i}": before[f"old{i}"] for i in range(0, 60, 6)}
    for i, cols in enumerate(before.values()):
        if i % 3:
            kept = [c for c in cols if rng.random() > 0.12]
            after[f"new{i}"] = (kept or cols) + [("fresh", "int")] * (i % 2)
            if i % 4 == 0:
                after[f"twin{i}"] = after[f"new{i}"]
    before = {t: sorted(set(c)) for t, c in before.items()}
    after = {t: sorted(set(c)) for t, c in after.items()}
    want = {}
    for t in before.keys() - after.keys():
        n = len(before[t])
        fit = [(-len(set(before[t]) & set(cols)), name) for name, cols in after.items() if n >= 3 and 100 * len(set(before[t]) & set(cols)) >= 80 * n]
        if fit:
            want[t] = min(fit)[1]
    got = {r.table_name: r.new_name for r in snapshot.table_renames(catalog(spark, before), catalog(spark, after)).collect()}
    assert got == want and len(want) > 10
    kinds = {(r.table_name, r.change_type) for r in snapshot.snapshot_diff(catalog(spark, before), catalog(spark, after)).where("column_name is null").collect()}
    assert kinds == {(t, "TABLE_RENAMED") for t in want} | {(t, "TABLE_REMOVED") for t in before.keys() - after.keys() - want.keys()} | {(t, "TABLE_ADDED") for t in after.keys() - before.keys()}


def test_usual_columns_are_narrowed_by_further_ones(spark, monkeypatch):
    """Every column is shared by many tables, so keys of one column are too wide; the pairs are those of brute force."""
    monkeypatch.setattr(snapshot, "SHARED_BY", 3)
    monkeypatch.setattr(snapshot, "NARROWED", 3)
    rng = random.Random(8)
    pick = lambda n: sorted(rng.sample([(f"c{i}", "int") for i in range(20)], n))
    before = {f"old{i}": pick(rng.randrange(5, 11)) for i in range(60)}
    after = {f"new{i}": pick(rng.randrange(3, 13)) for i in range(150)} | {f"copy{i}": before[f"old{i}"] for i in range(0, 60, 7)}
    want = {}
    for t, cols in before.items():
        fit = [(-len(set(cols) & set(c)), name) for name, c in after.items() if 100 * len(set(cols) & set(c)) >= 80 * len(cols)]
        if fit:
            want[t] = min(fit)[1]
    got = {r.table_name: r.new_name for r in snapshot.table_renames(catalog(spark, before), catalog(spark, after)).collect()}
    assert got == want and 20 < len(want) < 60, len(want)


def test_small_and_empty_catalogs(spark):
    two = catalog(spark, {"a": [("x", "int"), ("y", "int")]})
    assert snapshot.table_renames(two, catalog(spark, {"b": [("x", "int"), ("y", "int")]})).count() == 0
    none = catalog(spark, {})
    assert {r.change_type for r in snapshot.snapshot_diff(two, none).collect()} == {"TABLE_REMOVED"} and snapshot.snapshot_diff(none, none).count() == 0


def test_keys_and_other_types_are_not_renames(spark):
    base = spark.createDataFrame([("t", "stock", "int", "INTEGER", False, 0.0, 1.0, False), ("t", "k", "int", "INTEGER", False, 0.0, 1.0, False)], SHAPE + ", is_key boolean")
    now = lambda name, dtype, key: spark.createDataFrame([("t", name, dtype, "INTEGER", False, 0.0, 1.0, key), ("t", "k", "int", "INTEGER", False, 0.0, 1.0, False)], SHAPE + ", is_key boolean")
    kinds = lambda after: {r.change_type for r in snapshot.snapshot_diff(base, after).collect()}
    assert kinds(now("stock2", "int", False)) == {"COLUMN_RENAMED"}
    assert kinds(now("stock2", "int", True)) == kinds(now("stock2", "bigint", False)) == {"COLUMN_REMOVED", "COLUMN_ADDED"}


def test_classes_from_samples_and_defaults(spark):
    node = "struct<dtype:string,nullable:boolean,null_rate:double,cardinality:double,samples:array<string>,has_default:boolean>"
    n = lambda dtype="int", nullable=True, null_rate=0.0, card=0.5, samples=None, default=None: (dtype, nullable, null_rate, card, samples, default)
    cases = [
        ("TYPE_CHANGED", n("int", samples=["1", "2"]), n("bigint", samples=["1", "2"]), "TYPE_WIDENING"),
        ("TYPE_CHANGED", n("int", samples=["1", "2"]), n("bigint", samples=["7", "8"]), "SEMANTIC_BREAKING"),
        ("TYPE_CHANGED", n("varchar(9)", samples=["A", None, "b"]), n("text", samples=["a", "B"]), "TYPE_WIDENING"),
        ("TYPE_CHANGED", n("varchar(9)", samples=["a", "b"]), n("text", samples=["a", "c"]), "SEMANTIC_BREAKING"),
        ("TYPE_CHANGED", n("varchar(9)", samples=["a", "b"]), n("text", samples=["a", "b", "c"]), "TYPE_WIDENING"),
        ("TYPE_CHANGED", n("date", samples=["x"]), n("timestamp", samples=["x", "y"]), "SEMANTIC_BREAKING"),
        ("TYPE_CHANGED", n("varchar(9)", samples=["t1:1"]), n("text", samples=["t1:1", "t2:2"]), "SEMANTIC_BREAKING"),
        ("TYPE_CHANGED", n("varchar(9)", samples=[]), n("text", samples=["q"]), "TYPE_WIDENING"),
        ("TYPE_CHANGED", n("varchar(9)"), n("char(5)"), "TYPE_NARROWING"),
        ("STATS_DRIFTED", n(samples=["a"]), n(samples=["b"], card=0.7), "DATA_REGRESSION"),
        ("STATS_DRIFTED", n(samples=["a"]), n(samples=["a", "b"], card=0.7), "DATA_REGRESSION"),
        ("STATS_DRIFTED", n(samples=["a", "b"]), n(samples=["a"], card=0.7), "ADDITIVE_SAFE"),
        ("STATS_DRIFTED", n(), n(null_rate=0.05), "DATA_REGRESSION"),
        ("COLUMN_ADDED", None, n(nullable=False), "ADDITIVE_BREAKING"),
        ("COLUMN_ADDED", None, n(nullable=False, default=True), "ADDITIVE_SAFE"),
        ("NULLABLE_CHANGED", n(null_rate=0.1), n(nullable=False), "NULLABLE_HARDENING"),
        ("NULLABLE_CHANGED", n(null_rate=0.1), n(nullable=False, default=True), "ADDITIVE_SAFE"),
        ("NULLABLE_CHANGED", n(null_rate=None), n(nullable=False), "NULLABLE_HARDENING"),
    ]
    df = spark.createDataFrame([(i, k, b, a, "") for i, (k, b, a, _) in enumerate(cases)], f"i int, change_type string, before {node}, after {node}, detail string")
    got = {r.i: r.compatibility for r in snapshot.classify(df.withColumn("blast_count", F.lit(0))).collect()}
    assert [got[i] for i in range(len(cases))] == [c[3] for c in cases]


def test_chains_of_keys(spark):
    rng = random.Random(3)
    keys = [(f"t{i}", f"t{rng.randrange(i)}") for i in range(1, 80) for _ in range(2)] + [("t3", "t3b"), ("t3b", "t3c"), ("t3c", "t3b"), ("self", "self"), ("up", "self"), (None, "t1"), ("t1", None)]
    fks = spark.createDataFrame([(a, "c", b) for a, b in keys + keys[:5]], "child string, fk string, parent string").repartition(3)
    out = {}
    for a, b in keys:
        if a and b:
            out.setdefault(a, set()).add(b), out.setdefault(b, set())

    def depth(t, seen=()):
        if t in seen:
            return None
        below = [depth(x, (*seen, t)) for x in out[t]]
        return None if None in below else 1 + max(below, default=-1)

    got = {r.table_name: (r.depth, r.cyclic) for r in profile.key_chains(fks).collect()}
    assert got == {t: (depth(t), depth(t) is None) for t in out}
    assert profile.key_chains(fks.limit(0)).count() == 0


def test_score_is_capped_by_kind(spark):
    f = spark.createDataFrame([("wide_table", str(i), "") for i in range(9)] + [("deep_fk_chain", "a", "3"), ("isolated_table", "b", "")], "finding string, table_name string, detail string")
    assert profile.audit_score(f, 4).first().score == 30 + 5 + 2 and profile.audit_score(f.limit(0), 0).first().score == 0


def test_chains_write_each_table_once(spark, monkeypatch):
    """Rows written between rounds follow the keys, not keys times rounds; so with shuffled frontiers and joined parts."""
    written, cut = [], profile.cut
    monkeypatch.setattr(profile, "cut", lambda df: (written.append(df.count()), cut(df))[1])
    fks = spark.createDataFrame([(f"t{i}", f"t{i - 1}") for i in range(1, 8)] + [("t7", "t2"), ("x", "x"), ("y", "x"), ("y", "t1")], "child string, parent string")
    want = {f"t{i}": (i, False) for i in range(8)} | {"x": (None, True), "y": (None, True)}
    for frontier, parts, most in ((10, 32, 55), (0, 3, 100)):
        monkeypatch.setattr(profile, "FRONTIER", frontier)
        monkeypatch.setattr(profile, "PARTS", parts)
        written.clear()
        assert {r.table_name: (r.depth, r.cyclic) for r in profile.key_chains(fks).collect()} == want
        assert sum(written) < most
