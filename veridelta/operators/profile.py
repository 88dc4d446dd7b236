"""Profiles of tables and columns, and rules read from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import cut

FAMILIES = {
    T.ByteType: "INTEGER", T.ShortType: "INTEGER", T.IntegerType: "INTEGER", T.LongType: "INTEGER", T.FloatType: "FLOAT", T.DoubleType: "FLOAT",
    T.DecimalType: "FLOAT", T.StringType: "STRING", T.DateType: "TEMPORAL", T.TimestampType: "TEMPORAL", T.TimestampNTZType: "TEMPORAL",
    T.BooleanType: "BOOLEAN", T.BinaryType: "BINARY", T.ArrayType: "SEMI", T.MapType: "SEMI", T.StructType: "SEMI",
}

#: Name patterns of personal data, first match wins (fixed values).
PII_GROUPS = [
    ("email", r"e_?mail"), ("phone", r"phone|mobile|tel(?:ephone)?$"), ("ssn", r"ssn|social_security|national_id"), ("name", r"(?:first|last|full|middle|sur)_?name|^c_name$"),
    ("address", r"address|street|postcode|zip(?:_?code)?$"), ("birth", r"birth|dob$"), ("payment", r"card|iban|cvv|acct|account_num"), ("network", r"ip_?addr|^ip$|mac_addr"),
    ("geo", r"latitude|longitude|geo_?loc"), ("credential", r"password|passwd|secret|token|api_?key"),
]

ROLES = [("primary_key", r"(^|_)id$|key$"), ("identity", r"(^|_)(id|uuid|guid|user|customer|account)(_|$)|key$"), ("domain", r"status|type|state|category|segment|priority|flag"), ("metric", r"amount|price|total|cost|qty|quantity|balance|acctbal|value|discount|tax"), ("temporal", r"(^|_)(at|ts|date|time|timestamp)$|date$")]


def family(kind: T.DataType) -> str:
    return FAMILIES.get(type(kind), "UNKNOWN")


def ratio(n: Column, of: Column) -> Column:
    """n / of as a double, 0 for an empty table."""
    return F.when(of > 0, n.cast("double") / of).otherwise(F.lit(0.0))


def profile_table(df: DataFrame, name: str, exact: bool = False) -> DataFrame:
    """One row per column: rows, nulls, distinct values, null_rate, cardinality.

    One aggregate gives all columns. Distinct counts are approximate, or exact by unpivoting to (column, value), which
    sums in parts and doesn't blow rows up once per column as many distinct counts in one aggregate do. An empty table
    gives zeros.
    """
    cols = df.columns
    kinds = {f.name: family(f.dataType) for f in df.schema}
    if exact:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for c in cols])).alias("x")).select("x.c", "x.v")
        per = long.groupBy("c", "v").agg(F.count("*").alias("n")).groupBy("c").agg(F.sum("n").alias("row_count"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("null_count"), F.count("v").alias("distinct_count"))
        base = df.sparkSession.createDataFrame([(c, kinds[c]) for c in cols], "c string, family string")
        out = F.broadcast(base).join(per, "c", "left").select("c", "family", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("row_count", "null_count", "distinct_count")])
    else:
        one = df.agg(F.count("*").alias("n"), *[F.count(f"`{c}`").alias(f"k{i}") for i, c in enumerate(cols)], *[F.approx_count_distinct(f"`{c}`").alias(f"d{i}") if kinds[c] != "SEMI" else F.lit(0).alias(f"d{i}") for i, c in enumerate(cols)])
        rows = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(kinds[c]).alias("family"), F.col("n").alias("row_count"), (F.col("n") - F.col(f"k{i}")).alias("null_count"), F.col(f"d{i}").cast("long").alias("distinct_count")) for i, c in enumerate(cols)])
        out = one.select(F.inline(rows))
    return out.select(F.lit(name).alias("table_name"), F.col("c").alias("column_name"), "family", "row_count", "null_count", "distinct_count", ratio(F.col("null_count"), F.col("row_count")).alias("null_rate"), ratio(F.col("distinct_count"), F.col("row_count")).alias("cardinality"))


def profile_column(df: DataFrame, c: str) -> DataFrame:
    """rows, null_rows, average of one column; numbers are averaged as decimals, so that the order doesn't matter."""
    v = F.col(c).cast("decimal(18,4)")
    return df.agg(F.count("*").alias("row_count"), F.count_if(F.col(c).isNull()).alias("null_rows"), (F.sum(v).cast("double") / F.count(v)).alias("average"))


def column_samples(df: DataFrame, c: str, k: int = 5) -> DataFrame:
    """The k most frequent values with counts; of equally frequent ones the smaller first."""
    return df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def semantic_roles(name: Column) -> Column:
    low = F.lower(name)
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(r)) for r, p in ROLES]))


def pii_tag(name: Column) -> Column:
    low, out = F.lower(name), F.lit(None).cast("string")
    for tag, pattern in reversed(PII_GROUPS):
        out = F.when(low.rlike(pattern), F.lit(tag)).otherwise(out)
    return out


def contract_rules(profile: DataFrame, max_null_rate: float = 0.02, min_cardinality: float = 0.99, in_degree: DataFrame | None = None) -> DataFrame:
    """Rules that a profile suggests: not_null, unique, criticality (by name, then by how many foreign keys point there), strict,
    and sla, how fresh the table must be, by name."""
    p = profile.withColumn("not_null", (F.col("row_count") > 0) & (F.col("null_rate") <= max_null_rate)).withColumn("is_unique", (F.col("row_count") > 0) & (F.col("null_count") == 0) & (F.col("cardinality") >= min_cardinality))
    p = p.join(in_degree, ["table_name"], "left") if in_degree is not None else p.withColumn("in_degree", F.lit(0))
    low, deg = F.lower("table_name"), F.coalesce("in_degree", F.lit(0))
    crit = F.when(low.rlike("payment|billing|revenue|order|invoice"), "critical").when(low.rlike("customer|user|account"), "high").when(deg >= 3, "high").when(deg >= 1, "medium").otherwise("low")
    sla = F.when(low.rlike("event|log|stream|realtime"), "1 hour").when(low.rlike("daily|revenue|order|payment"), "1 day").otherwise("7 days")
    return p.withColumn("pii", pii_tag(F.col("column_name"))).withColumn("criticality", crit).withColumn("strict", crit.isin("critical", "high")).withColumn("sla", sla)


def check_contracts(df: DataFrame, not_null: list[str], unique: list[str]) -> DataFrame:
    """Violations per column: null rows, and rows beyond the first of each value. Uniqueness sums in parts per value."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in not_null]).select(F.inline(F.array(*[F.struct(F.lit("not_null").alias("rule"), F.lit(c).alias("column_name"), F.col(c).alias("violations")) for c in not_null])))
    for c in unique:
        extra = df.where(F.col(c).isNotNull()).groupBy(c).agg((F.count("*") - 1).alias("x")).agg(F.coalesce(F.sum("x"), F.lit(0)).alias("violations"))
        nulls = nulls.unionByName(extra.select(F.lit("unique").alias("rule"), F.lit(c).alias("column_name"), "violations"))
    return nulls


#: A frontier of so many tables is broadcast; so many rounds are kept as parts before they become one.
FRONTIER, PARTS = 50_000, 32


def key_chains(fks: DataFrame) -> DataFrame:
    """table_name, depth, cyclic of each table in fks (child, parent): the longest chain of foreign keys from it.

    Tables without keys have depth 0. A round settles the tables all of whose parents are settled: keys of those settled
    last are counted for their children, and a key carries how many its child has. Between rounds only tables are kept
    of which some parents are settled, and each settled one is written once; there are as many rounds as the longest
    chain has keys. Tables that are never settled lie on a cycle or lead into one: cyclic, without depth. Repeated keys
    count once.
    """
    pairs = cut(fks.select("child", "parent").where("child is not null and parent is not null").distinct())
    every = pairs.select("child").union(pairs.select("parent")).distinct()
    e = cut(pairs.join(pairs.groupBy("child").agg(F.count("*").alias("open")), "child"))
    last = cut(every.join(pairs.select("child"), "child", "left_anti").select(F.col("child").alias("table_name"), F.lit(0).alias("depth")))
    done, waiting = [last], None
    while n := last.count():
        ends = last.select(F.col("table_name").alias("parent"), F.col("depth"))
        news = e.join(F.broadcast(ends) if n <= FRONTIER else ends, "parent").select("child", "open", F.lit(1).alias("seen"), "depth")
        news = news if waiting is None else news.union(waiting)
        state = cut(news.groupBy("child", "open").agg(F.sum("seen").alias("seen"), F.max("depth").alias("depth")))
        last = state.where("seen = open").select(F.col("child").alias("table_name"), (F.col("depth") + 1).alias("depth"))
        waiting = state.where("seen < open")
        done.append(last)
        if len(done) > PARTS:
            done = [cut(reduce(DataFrame.union, done))]
    settled = reduce(DataFrame.union, done)
    rest = every.join(settled.withColumnRenamed("table_name", "child"), "child", "left")
    return rest.select(F.col("child").alias("table_name"), "depth", F.col("depth").isNull().alias("cyclic"))


def catalog_audit(columns: DataFrame, fks: DataFrame, wide: int = 30, max_fk_nulls: float = 0.05, hops: int = 3) -> DataFrame:
    """Findings (finding, table_name, detail) about a catalog: wide tables, nullable foreign keys, their null rates, chains and
    cycles of keys, isolated tables.

    columns: table_name, column_name, nullable, null_rate, and optionally is_key; fks: child, fk, parent. Each of them is
    read once for all findings about it.
    """
    fks = cut(fks.select("child", "fk", "parent"))
    key = F.coalesce("is_key", F.lit(False)) if "is_key" in columns.columns else F.lit(False)
    item = lambda cond, kind, detail: F.when(cond, F.struct(F.lit(kind).alias("finding"), detail.cast("string").alias("detail")))
    found = lambda df, *items: df.select("table_name", F.inline(F.array_compact(F.array(*items)))).select("finding", "table_name", "detail")
    linked = fks.select(F.col("child").alias("table_name")).union(fks.select("parent")).distinct().withColumn("linked", F.lit(True))
    tables = columns.groupBy("table_name").agg(F.count("*").alias("n")).join(linked, "table_name", "left")
    on_fk = columns.join(fks.select(F.col("child").alias("table_name"), F.col("fk").alias("column_name")).distinct(), ["table_name", "column_name"])
    out = found(tables, item(F.col("n") > wide, "wide_table", F.col("n")), item((F.col("n") > 2) & F.col("linked").isNull(), "isolated_table", F.lit("")))
    out = out.union(found(on_fk, item(F.coalesce("nullable", F.lit(True)) & ~key, "nullable_fk", F.col("column_name")), item(F.col("null_rate") > max_fk_nulls, "fk_null_rate", F.col("column_name"))))
    return out.union(found(key_chains(fks), item(F.col("depth") >= hops, "deep_fk_chain", F.col("depth")), item(F.col("cyclic"), "cyclic_fks", F.lit(""))))


def audit_score(findings: DataFrame, tables: int, central: int = 0) -> DataFrame:
    """One row: how many findings of each kind, and the score, 0 to 100 (higher: more fragile). Each kind counts up to a bound of its own."""
    kinds = ("wide_table", "nullable_fk", "deep_fk_chain", "fk_null_rate", "isolated_table", "cyclic_fks")
    n = findings.agg(*[F.count_if(F.col("finding") == k).alias(k) for k in kinds])
    capped = lambda c, each, most: F.least(F.lit(most), F.col(c) * each)
    isolated = F.least(F.lit(5), F.floor(F.col("isolated_table") / max(1, tables) * 10))
    score = capped("wide_table", 6, 30) + capped("nullable_fk", 4, 20) + capped("deep_fk_chain", 5, 20) + min(15, 3 * central) + capped("fk_null_rate", 3, 10) + isolated
    return n.withColumn("score", F.least(F.lit(100), score).cast("long"))
