"""Snapshots of profiles, their differences as typed events, and what follows from those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .checks import crosses_time_zone, numeric_precision, varchar_length
from .graph import lookup

#: What is known about a column; what a profile lacks is null.
NODE = {"dtype": "string", "family": "string", "nullable": "boolean", "null_rate": "double", "cardinality": "double", "samples": "array<string>", "has_default": "boolean", "is_key": "boolean"}
#: Pairs of type families (fixed values).
WIDENINGS = ["INTEGER>BIGINT", "INT>BIGINT", "SMALLINT>INTEGER", "SMALLINT>BIGINT", "VARCHAR>TEXT", "FLOAT>DOUBLE", "FLOAT>NUMERIC", "NUMERIC>DOUBLE", "CHAR>VARCHAR", "CHAR>TEXT"]
NARROWINGS = ["BIGINT>INTEGER", "BIGINT>SMALLINT", "INTEGER>SMALLINT", "TEXT>VARCHAR", "VARCHAR>DATE", "VARCHAR>TIMESTAMP", "VARCHAR>INTEGER", "DOUBLE>FLOAT", "NUMERIC>INTEGER", "TIMESTAMP>DATE", "TIMESTAMP>VARCHAR"]
CROSSES = ["VARCHAR>NUMERIC", "VARCHAR>BOOLEAN", "TIMESTAMP>VARCHAR", "TIMESTAMP>NUMERIC", "NUMERIC>BOOLEAN"]
ALIASES = {"INT": "INTEGER", "INT4": "INTEGER", "INT8": "BIGINT", "LONG": "BIGINT", "SHORT": "SMALLINT", "STRING": "VARCHAR", "DECIMAL": "NUMERIC", "REAL": "FLOAT", "BOOL": "BOOLEAN", "TIMESTAMP_NTZ": "TIMESTAMP", "TIMESTAMPTZ": "TIMESTAMP", "DATETIME": "TIMESTAMP"}
GROUPS = {"INTEGER": "NUMERIC", "BIGINT": "NUMERIC", "SMALLINT": "NUMERIC", "FLOAT": "NUMERIC", "DOUBLE": "NUMERIC", "TEXT": "VARCHAR", "CHAR": "VARCHAR", "DATE": "TIMESTAMP"}
#: Families of types, and changes of family that lose something (fixed values).
FAMILIES = {"INTEGER": "INTEGER", "INT": "INTEGER", "SMALLINT": "INTEGER", "TINYINT": "INTEGER", "BIGINT": "INTEGER", "FLOAT": "FLOAT", "DOUBLE": "FLOAT", "REAL": "FLOAT", "NUMERIC": "FLOAT", "DECIMAL": "FLOAT", "VARCHAR": "STRING", "TEXT": "STRING", "CHAR": "STRING", "NVARCHAR": "STRING", "STRING": "STRING", "TIMESTAMP": "TEMPORAL", "DATE": "TEMPORAL", "DATETIME": "TEMPORAL", "TIMESTAMPTZ": "TEMPORAL", "TIME": "TEMPORAL"}
FAMILY_NARROWINGS = ["INTEGER>FLOAT", "STRING>INTEGER", "STRING>FLOAT", "TEMPORAL>STRING", "TEMPORAL>INTEGER", "FLOAT>INTEGER"]
BLOCKING, REVIEW = ["DESTRUCTIVE_DELETE", "TYPE_NARROWING", "NULLABLE_HARDENING", "SEMANTIC_BREAKING", "ADDITIVE_BREAKING"], ["RENAME_LOW_CONFIDENCE", "RENAME_HIGH_CONFIDENCE", "DATA_REGRESSION"]


def write_snapshot(profile: DataFrame, path: str, snapshot_id: int, label: str = "") -> None:
    """Writes one partition, in place of an earlier one with that id; the others stay."""
    out = profile.withColumn("label", F.lit(label)).withColumn("snapshot_id", F.lit(snapshot_id))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def list_snapshots(spark: SparkSession, path: str, limit: int = 20) -> DataFrame:
    """snapshot_id, label, columns of the newest; ids come from partition names, so the scan reads one column."""
    return spark.read.parquet(path).groupBy("snapshot_id").agg(F.max("label").alias("label"), F.count("*").alias("columns")).orderBy(F.desc("snapshot_id")).limit(limit)


def read_snapshot(spark: SparkSession, path: str, snapshot_id: int | None = None) -> DataFrame:
    """One snapshot, the newest if no id is given."""
    df = spark.read.parquet(path)
    wanted = df.agg(F.max("snapshot_id")).first()[0] if snapshot_id is None else snapshot_id
    return df.where(F.col("snapshot_id") == wanted)


def prune_snapshots(spark: SparkSession, path: str, keep: int = 10) -> list[int]:
    """Deletes all but the newest partitions, through the file system that the path belongs to. Returns their ids."""
    ids = sorted((r[0] for r in spark.read.parquet(path).select("snapshot_id").distinct().collect()), reverse=True)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for i in ids[keep:]:
        p = hadoop(f"{path}/snapshot_id={i}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return ids[keep:]


def fingerprints(profile: DataFrame) -> DataFrame:
    """structure_fp (name, type, nullability) and stats_fp (rates) of each column, 16 hex digits each."""
    short = lambda *c: F.substring(F.sha2(F.to_json(F.struct(*c)), 256), 1, 16)
    return profile.withColumn("structure_fp", short("column_name", "dtype", "nullable")).withColumn("stats_fp", short("null_rate", "cardinality"))


def fingerprint_diff(before: DataFrame, after: DataFrame, fp: str = "structure_fp") -> DataFrame:
    """Columns whose fingerprint differs, or that one side lacks."""
    k = ["table_name", "column_name"]
    j = before.select(*k, F.col(fp).alias("before")).join(after.select(*k, F.col(fp).alias("after")), k, "full_outer")
    return j.where(~F.col("before").eqNullSafe(F.col("after")))


#: A set of columns that more tables of `after` share is narrowed by a further column, up to so many columns.
SHARED_BY, NARROWED = 100, 4


def table_renames(before: DataFrame, after: DataFrame, least: int = 3, percent: int = 80) -> DataFrame:
    """table_name, new_name of tables that are gone and of whose columns (`least` at least) a table of `after` has `percent` or more.

    Columns are the same if name, type and nullability are. Tables with the same columns are one row on either side. A
    similar table lacks at most d of an old one's n columns, so it has one of the old one's d + 1 rarest, two of its d + 2
    rarest, and so on. Rows meet by one column; where more than SHARED_BY rows of `after` have it, by two that both
    have, then by three, up to NARROWED or to the number that must be shared, so that usual columns don't bring all
    tables together. Of several the one with most columns in common counts, then the first by name.
    """
    columns = lambda df: fingerprints(df).select("table_name", F.xxhash64("structure_fp").alias("fp")).distinct()
    gone = before.select("table_name").distinct().join(after.select("table_name").distinct(), "table_name", "left_anti")
    sets = lambda df: df.groupBy("table_name").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    names = cut(sets(columns(before).join(gone, "table_name")).where(F.size("fps") >= least))
    same = cut(sets(columns(after)).groupBy("fps").agg(F.min("table_name").alias("new")))
    usual = same.select(F.explode("fps").alias("fp")).groupBy("fp").agg(F.count("*").alias("usual"))

    def ranked(df: DataFrame, *keep: str) -> DataFrame:
        """The columns of each row, rarest first, as pairs of how usual they are and what they are."""
        each = df.select("fps", *keep, F.explode("fps").alias("fp")).join(usual, "fp", "left")
        return each.groupBy("fps", *keep).agg(F.sort_array(F.collect_list(F.struct(F.coalesce("usual", F.lit(0)).alias("usual"), "fp"))).alias("at"))

    must = F.ceil(F.size("at") * percent / 100).cast("int")
    start = F.lit(0).cast("long").alias("key"), F.lit(0).alias("pos")
    old = ranked(names.select("fps").distinct()).select(F.col("fps").alias("old"), F.col("at")["fp"].alias("at"), must.alias("must"), *start)
    new = ranked(same, "new").select("fps", "new", F.col("at")["fp"].alias("at"), *start)
    found = None
    for width in range(1, NARROWED + 1):
        # keys of one more column, each after those before it in the common order
        longer = lambda df, last: df.withColumn("next", F.explode(F.when(F.col("pos") < last, F.sequence(F.col("pos") + 1, last)))).withColumn("key", F.xxhash64("key", F.element_at("at", F.col("next")))).withColumn("pos", F.col("next")).drop("next")
        old = cut(longer(old, F.least(F.size("at"), F.size("at") - F.col("must") + width)))
        new = cut(longer(new, F.size("at")).join(old.select("key").distinct(), "key", "left_semi"))
        heavy = new.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SHARED_BY).select("key", F.lit(True).alias("heavy"))
        marked = cut(old.join(heavy, "key", "left").withColumn("heavy", F.col("heavy").isNotNull() & (F.col("must") > width) & (width < NARROWED)))
        pairs = marked.where("not heavy").select("key", "old", "must").join(new.select("key", "fps", "new"), "key")
        shared = F.size(F.array_intersect("old", "fps"))
        best = cut(pairs.withColumn("shared", shared).where("shared >= must").groupBy("old").agg(F.min(F.struct((-F.col("shared")).alias("s"), "new")).alias("b")))
        found = best if found is None else found.union(best)
        old = marked.where("heavy").drop("heavy")
        if old.isEmpty():
            break
        new = new.join(old.select("key").distinct(), "key", "left_semi")
    best = found.groupBy("old").agg(F.min("b")["new"].alias("new_name"))
    return names.join(best.withColumnRenamed("old", "fps"), "fps").select("table_name", "new_name")


def snapshot_diff(before: DataFrame, after: DataFrame, stats_step: float = 0.15, rename_step: float = 0.05) -> DataFrame:
    """Events (table_name, column_name, change_type, before, after, detail) between two profiles.

    Profiles: table_name, column_name, dtype, family, nullable, null_rate, cardinality, and optionally samples, has_default
    and is_key. A removed column counts as renamed to a column added to the same table with its type, nullability and
    nearly its cardinality, if neither is a key: the nearest, then the last by name. For tables see table_renames.
    """
    k = ["table_name", "column_name"]
    node = lambda df, p: F.struct(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in NODE.items()]).alias(p)
    j = before.select(*k, node(before, "before")).join(after.select(*k, node(after, "after")), k, "full_outer")
    b, a = F.col("before"), F.col("after")
    both = b.isNotNull() & a.isNotNull()
    event = lambda cond, kind, detail: F.when(cond, F.struct(F.lit(kind).alias("change_type"), detail.cast("string").alias("detail")))
    far = lambda f: F.abs(F.coalesce(a[f], F.lit(0.0)) - F.coalesce(b[f], F.lit(0.0))) > stats_step
    found = F.array_compact(F.array(
        event(both & ~b["dtype"].eqNullSafe(a["dtype"]), "TYPE_CHANGED", F.concat_ws(" -> ", b["dtype"], a["dtype"])),
        event(both & ~b["nullable"].eqNullSafe(a["nullable"]), "NULLABLE_CHANGED", F.concat_ws(" -> ", b["nullable"].cast("string"), a["nullable"].cast("string"))),
        event(both & (far("null_rate") | far("cardinality")), "STATS_DRIFTED", F.lit("null_rate or cardinality")),
    ))
    changed = j.where(both).select(*k, "before", "after", F.explode(found).alias("e")).select(*k, "e.change_type", "before", "after", "e.detail")
    tables_b, tables_a = before.select("table_name").distinct(), after.select("table_name").distinct()
    none = F.lit(None).cast(f"struct<{','.join(f'{c}:{t}' for c, t in NODE.items())}>")
    whole = lambda t, kind: t.select("table_name", F.lit(None).cast("string").alias("column_name"), F.lit(kind).alias("change_type"), none.alias("before"), none.alias("after"), F.col("table_name").alias("detail"))
    gone_tables, new_tables = tables_b.join(tables_a, "table_name", "left_anti"), tables_a.join(tables_b, "table_name", "left_anti")
    common = tables_b.join(tables_a, "table_name", "left_semi")
    removed = j.where(a.isNull()).join(common, "table_name", "left_semi").select(*k, "before")
    added = j.where(b.isNull()).join(common, "table_name", "left_semi").select("table_name", F.col("column_name").alias("new_name"), "after")
    gap = F.abs(F.col("before.cardinality") - F.col("after.cardinality"))
    same = F.col("before.dtype").eqNullSafe(F.col("after.dtype")) & F.col("before.nullable").eqNullSafe(F.col("after.nullable"))
    keyed = F.coalesce("before.is_key", F.lit(False)) | F.coalesce("after.is_key", F.lit(False))
    pairs = removed.join(added, "table_name").where(same & ~keyed & (gap <= rename_step))
    renamed = pairs.groupBy(*k).agg(F.max_by(F.struct("before", "after", "new_name"), F.struct(-gap, "new_name")).alias("r")).select(*k, F.lit("COLUMN_RENAMED").alias("change_type"), "r.before", "r.after", F.concat(F.lit("renamed to "), "r.new_name").alias("detail"), F.col("r.new_name").alias("new_name"))
    dropped = removed.join(renamed.select(*k), k, "left_anti").select(*k, F.lit("COLUMN_REMOVED").alias("change_type"), "before", none.alias("after"), F.col("column_name").alias("detail"))
    fresh = added.join(renamed.select("table_name", "new_name"), ["table_name", "new_name"], "left_anti").select("table_name", F.col("new_name").alias("column_name"), F.lit("COLUMN_ADDED").alias("change_type"), none.alias("before"), "after", F.col("new_name").alias("detail"))
    out = changed
    moved = table_renames(before, after)
    named = moved.select("table_name", F.lit(None).cast("string").alias("column_name"), F.lit("TABLE_RENAMED").alias("change_type"), none.alias("before"), none.alias("after"), F.concat(F.lit("renamed to "), "new_name").alias("detail"))
    for part in (renamed.drop("new_name"), dropped, fresh, named, whole(gone_tables.join(moved, "table_name", "left_anti"), "TABLE_REMOVED"), whole(new_tables, "TABLE_ADDED")):
        out = out.unionByName(part)
    return out


def renamed(c: Column, names: dict) -> Column:
    """Another name where there is one. A map is looked up once, where a chain of cases would compute c for each of them."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c], c)


def normal_type(c: Column) -> Column:
    """The bare type name in upper case, common aliases resolved."""
    return renamed(F.upper(F.trim(F.regexp_replace(c, r"\(.*$", ""))), ALIASES)


def type_group(c: Column) -> Column:
    return renamed(c, GROUPS)


def is_shorter(before: Column, after: Column) -> Column:
    """A shorter varchar, or a numeric with fewer digits before or after the point."""
    x, y = numeric_precision(before), numeric_precision(after)
    shorter = varchar_length(after) < varchar_length(before)
    less = (y["p"] - y["s"] < x["p"] - x["s"]) | (y["s"] < x["s"])
    return F.coalesce(shorter, F.lit(False)) | F.coalesce(less, F.lit(False))


def is_narrowing(before: Column, after: Column) -> Column:
    """A listed pair of types, or a shorter one."""
    return F.concat_ws(">", normal_type(before), normal_type(after)).isin(NARROWINGS) | is_shorter(before, after)


def is_family_narrowing(before: Column, after: Column) -> Column:
    """The coarser rule, which looks at families of types only: widths within a family never count."""
    family = lambda c: lookup(F.upper(F.trim(F.regexp_replace(c, r"\(.*$", ""))), FAMILIES, "")
    return F.concat_ws(">", family(before), family(after)).isin(FAMILY_NARROWINGS)


def sample_set(c: Column) -> Column:
    """Distinct samples in lower case; null counts as none."""
    return F.array_distinct(F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()), F.lower))


def classify(events: DataFrame, blast: str = "blast_count", null_step: float = 0.05, card_step: float = 0.35) -> DataFrame:
    """events with compatibility, one of ten classes. Needs change_type, before, after, detail and a count of what is hit.

    Samples count where both sides have some: values that all changed, or two or more of few short ones, or any
    of points in time, break the meaning of a changed type; values that all changed, or were only added to, are a
    regression of a column whose statistics drifted. A default makes a column that was added or hardened safe.
    """
    b, a, kind = F.col("before"), F.col("after"), F.col("change_type")
    card = lambda x: F.coalesce(x["cardinality"], F.lit(0.0))
    nulls = lambda x: F.coalesce(x["null_rate"], F.lit(0.0))
    times = card(a) / F.greatest(card(b), F.lit(1e-9))
    old, new = normal_type(b["dtype"]), normal_type(a["dtype"])
    old_group, new_group = type_group(old), type_group(new)
    pair, groups = F.concat_ws(">", old, new), F.concat_ws(">", old_group, new_group)
    was, now = sample_set(b["samples"]), sample_set(a["samples"])
    both = (F.size(was) > 0) & (F.size(now) > 0)
    apart = both & ~F.arrays_overlap(was, now)
    gone, come = F.size(F.array_except(was, now)), F.size(F.array_except(now, was))
    few = (F.greatest(F.size(was), F.size(now)) <= 8) & F.exists(F.array_union(was, now), lambda v: F.length(v) <= 32)
    timed = F.exists(F.array_union(was, now), lambda v: v.contains("t") & v.contains(":")) | (old_group == "TIMESTAMP") | (new_group == "TIMESTAMP")
    by_samples = (apart & (old_group == new_group)) | (both & few & (gone + come >= 2)) | (both & timed & (gone + come > 0) & (old_group == new_group))
    semantic = ((card(b) > 0.5) & (card(a) < 0.1)) | ((card(b) > 0) & (card(a) > 0) & ((times >= 2.2) | (times <= 0.35))) | ((nulls(b) <= 0.05) & (nulls(a) >= 0.3)) | groups.isin(CROSSES) | by_samples
    typed = F.when(crosses_time_zone(b["dtype"], a["dtype"]), "SEMANTIC_BREAKING").when(is_shorter(b["dtype"], a["dtype"]), "TYPE_NARROWING").when(semantic, "SEMANTIC_BREAKING").when(old == new, "ADDITIVE_SAFE").when(pair.isin(WIDENINGS), "TYPE_WIDENING").when(pair.isin(NARROWINGS), "TYPE_NARROWING").when(old_group != new_group, "SEMANTIC_BREAKING").otherwise("TYPE_NARROWING")
    default = F.coalesce(a["has_default"], F.lit(False))
    hardened = b["nullable"] & ~a["nullable"] & ~(F.coalesce(b["null_rate"] == 0, F.lit(False)) & (F.col(blast) <= 1)) & ~default
    worse = (nulls(a) - nulls(b) >= null_step) | (card(b) - card(a) >= card_step) | apart | (both & (gone == 0) & (come > 0))
    out = F.when(kind.isin("COLUMN_REMOVED", "TABLE_REMOVED"), "DESTRUCTIVE_DELETE").when(kind == "TYPE_NARROWING", "TYPE_NARROWING")
    out = out.when((kind == "COLUMN_ADDED") & ~F.coalesce(a["nullable"], F.lit(True)) & ~default, "ADDITIVE_BREAKING")
    out = out.when(kind.isin("COLUMN_RENAMED", "TABLE_RENAMED"), F.when((F.col(blast) <= 3) | F.lower("detail").contains("renamed to"), "RENAME_HIGH_CONFIDENCE").otherwise("RENAME_LOW_CONFIDENCE"))
    out = out.when(kind == "TYPE_CHANGED", typed).when((kind == "NULLABLE_CHANGED") & F.coalesce(hardened, F.lit(False)), "NULLABLE_HARDENING").when((kind == "STATS_DRIFTED") & worse, "DATA_REGRESSION")
    return events.withColumn("compatibility", out.otherwise("ADDITIVE_SAFE"))


def backfill_cost(events: DataFrame, blast: str = "blast_count") -> DataFrame:
    """events with backfill_cost: a base that grows with what is hit, times a factor of the class, more for added nulls."""
    factor = F.when(F.col("compatibility") == "DESTRUCTIVE_DELETE", 1.7).when(F.col("compatibility") == "SEMANTIC_BREAKING", 1.6).when(F.col("compatibility") == "TYPE_NARROWING", 1.25).when(F.col("compatibility") == "DATA_REGRESSION", 1.5).when(F.col("compatibility") == "NULLABLE_HARDENING", 1.25).otherwise(1.0)
    more = F.greatest(F.lit(0.0), F.coalesce(F.col("after.null_rate"), F.lit(0.0)) - F.coalesce(F.col("before.null_rate"), F.lit(0.0)))
    return events.withColumn("backfill_cost", (15 + 12.5 * F.col(blast)) * factor * (1 + F.least(F.lit(0.5), more)))


def gate_verdict(assessments: DataFrame, by: str = "change_set", *more: Column) -> DataFrame:
    """BLOCK if any class blocks, NEEDS_REVIEW if any needs review, else SAFE; per change set, with more aggregates if given."""
    rank = F.when(F.col("compatibility").isin(BLOCKING), 2).when(F.col("compatibility").isin(REVIEW), 1).otherwise(0)
    out = assessments.withColumn("__r", rank).groupBy(by).agg(F.max("__r").alias("__r"), F.count_if(F.col("__r") == 2).alias("blocking"), F.count_if(F.col("__r") == 1).alias("review"), *more)
    return out.withColumn("verdict", F.when(F.col("__r") == 2, "BLOCK").when(F.col("__r") == 1, "NEEDS_REVIEW").otherwise("SAFE")).select(by, "verdict", *[c for c in out.columns if c not in (by, "__r")])


def reliability_score(assessments: DataFrame, by: str = "change_set", blast: str = "blast_count", cost: str = "backfill_cost") -> DataFrame:
    """0 to 100 per change set, with the on-call risk. The classes are computed once, for one aggregate."""
    v = gate_verdict(assessments, by, F.sum(blast).alias("blast"), F.sum(F.col(cost).cast("decimal(18,2)")).cast("double").alias("cost"))
    score = 100 - 28 * F.col("blocking") - 10 * F.col("review") - F.least(F.lit(20.0), 2.5 * F.col("blast")) - F.least(F.lit(18.0), F.col("cost") / 35) - F.when(F.col("verdict") == "BLOCK", 8).when(F.col("verdict") == "NEEDS_REVIEW", 4).otherwise(0)
    s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))
    return v.withColumn("score", s).withColumn("oncall_risk", F.when((F.col("blocking") > 0) | (s < 45), "high").when((F.col("review") > 0) | (s < 75), "medium").otherwise("low"))


def drift_velocity(events: DataFrame, now: Column | None = None, at: str | None = None) -> DataFrame:
    """Changes per table, within 7 and 30 days if events have times, and the column that changed most."""
    per = events.groupBy("table_name", "column_name").agg(F.count("*").alias("n"), *([F.count_if(F.datediff(now, F.col(at)).between(0, d - 1)).alias(f"n{d}") for d in (7, 30)] if at else []))
    sums = [F.sum(f"n{d}").alias(f"changes_{d}d") for d in (7, 30)] if at else []
    return per.groupBy("table_name").agg(F.sum("n").alias("changes"), *sums, F.max_by("column_name", F.when(F.col("column_name").isNotNull(), F.struct("n", "column_name"))).alias("hottest"))


def contract_violations(assessments: DataFrame, rules: DataFrame, most: int = 5) -> DataFrame:
    """Rules that a change breaks, up to `most` per column. rules: table_name, column_name, not_null, is_unique, pii, strict."""
    j = assessments.join(rules, ["table_name", "column_name"])
    c = F.col("compatibility")
    broken = F.array_compact(F.array(F.when(c == "DESTRUCTIVE_DELETE", "deleted_column"), F.when(c == "TYPE_NARROWING", "narrowed_type"), F.when(c.isin("DATA_REGRESSION", "NULLABLE_HARDENING") & F.col("not_null"), "not_null"), F.when(c.isin("DATA_REGRESSION", "SEMANTIC_BREAKING") & F.col("is_unique"), "unique"), F.when((c != "ADDITIVE_SAFE") & F.col("pii").isNotNull(), "pii"), F.when((c != "ADDITIVE_SAFE") & F.col("strict"), "strict_table")))
    return j.select("table_name", "column_name", "change_type", F.explode(F.slice(broken, 1, most)).alias("violation"))
