"""Assumptions that SQL texts make: detectors over their tokens.

A text is cut once into lower-case tokens; each detector asks what stands at a place and after it. The words that
detectors look for are the lists below, from the functions and clauses of common SQL dialects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings, quoted names, names with dots, numbers, and any other sign by itself.
TOKEN = r"""'[^']*'|"[^"]*"|[a-z_][a-z0-9_.]*|[0-9]+(?:\.[0-9]+)?|[^\s\w]"""
TRUNCATE = ("date_trunc", "timestamp_trunc")
CAST = ("cast", "date", "to_date")
FALLBACK = ("coalesce", "ifnull", "nvl")
ZONE = ("convert_timezone", "timezone")
AGGREGATE = ("avg", "count", "sum")
DEDUP = ("distinct", "qualify", "row_number")
DOMAIN = ("category", "code", "kind", "state", "status", "type")
EMPTY = ("0", "0.0", "false", "''", '""', "'none'", "'unknown'")
GRAINS = ("day", "hour", "month", "week")
STATE = ("backfill", "delete", "incremental", "is_incremental", "merge")
WINDOW = ("current_date", "current_timestamp", "date_sub", "dateadd", "interval", "now")
COMPLETE = ("business_date", "event_date", "event_time", "freshness", "late", "watermark")
#: Tokens before and after a name in which a detector looks.
NEAR = 12


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def bare(token: Column) -> Column:
    """A token without quotes."""
    return F.regexp_replace(token, "^['\"]|['\"]$", "")


def has_suffix(token: Column) -> Column:
    """Whether a name ends like one of a closed domain."""
    return token.rlike("^[a-z_]") & F.array_contains(F.array(*[F.lit(w) for w in DOMAIN]), F.regexp_extract(token, "([a-z]+)$", 1))


def timed_name(token: Column) -> Column:
    return token.rlike("^[a-z_]") & (token.endswith("_at") | token.endswith("_ts") | token.contains("time") | token.contains("date"))


def places(t: Column, found: Callable[[Callable[[int], Column], Column], Column], hit: Callable[[Callable[[int], Column], Column], Column]) -> Column:
    """hit at each place where found; both get a function that gives the token so many places on, and the place."""
    at = lambda i: (lambda k: F.coalesce(F.get(t, i + k), F.lit("")))
    where = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: found(at(i), i))
    return F.when(F.size(t) == 0, F.array().cast(HITS)).otherwise(F.transform(where, lambda i: hit(at(i), i)))


HITS = "array<struct<family:string,detail:string,severity:string>>"


def hit(family: str, detail: Column, severity: Column | str) -> Column:
    s = severity if isinstance(severity, Column) else F.lit(severity)
    return F.struct(F.lit(family).alias("family"), detail.cast("string").alias("detail"), s.cast("string").alias("severity"))


def until(t: Column, i: Column, stops: tuple[str, ...]) -> Column:
    """Tokens after place i up to the first of the stops, or to the end."""
    rest = F.slice(t, i + 2, F.size(t))
    ends = F.filter(F.sequence(F.lit(1), F.size(rest) + 1), lambda k: F.coalesce(F.get(rest, k - 1), F.lit(stops[0])).isin(*stops))
    return F.slice(rest, F.lit(1), F.get(ends, F.lit(0)) - 1)


def any_of(a: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(a, F.array(*[F.lit(w) for w in words]))


def family_hits(t: Column, unique: Column) -> Column:
    """All hits of the six families in a text's tokens."""
    zoned = any_of(t, ZONE) | F.array_join(t, " ").contains("at time zone")
    timed = lambda w, i: F.exists(until(t, i + 1, (")",)), timed_name)
    cut_at = lambda w, i: w(0).isin(*TRUNCATE) | (w(0) == "date") | any_of(until(t, i + 1, (")",)), ("date",))
    temporal = places(
        t,
        lambda w, i: (w(1) == "(") & (w(0).isin(*TRUNCATE) | (w(0).isin(*CAST) & timed(w, i))),
        lambda w, i: hit("temporal_bucket", F.when(w(0).isin(*TRUNCATE), F.coalesce(F.when(bare(w(2)).isin(*GRAINS), bare(w(2))), F.when(bare(w(4)).isin(*GRAINS), bare(w(4))), w(0))).when(cut_at(w, i), "day").otherwise(w(0)), F.when(zoned | cut_at(w, i), "critical").otherwise("high")),
    )
    state = lambda w: ((w(0) == "is_incremental") & (w(1) == "(")) | ((w(0) == "merge") & (w(1) == "into")) | ((w(0) == "materialized") & w(1).isin("=", ":") & (bare(w(2)) == "incremental"))
    predicate = F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size(t)), lambda i: F.coalesce(F.get(t, i), F.lit("")) == "where"), lambda i: until(t, i, ("group", "order", "limit"))))
    wrapped, widened = any_of(predicate, CAST + TRUNCATE), any_of(predicate, ("or",))
    grown = F.slice(places(t, lambda w, i: state(w), lambda w, i: hit("incremental_filter", F.when(wrapped, "partition_column_wrapped").when(widened, "or_expansion").otherwise(w(0)), F.when(wrapped | widened, "high").otherwise("medium"))), 1, 1)
    summed = any_of(t, AGGREGATE)
    clause = lambda i: until(t, i, ("join", "where", "group", "order", "limit"))
    joins = places(
        t,
        lambda w, i: (w(0) == "join") & any_of(clause(i), ("on",)) & any_of(clause(i), ("=",)),
        lambda w, i: hit("join_cardinality", F.when(any_of(t, DEDUP), "dedup_hint").when(summed, "aggregate_after_join").otherwise("equality_join"), F.when(unique, "medium").when(summed, "critical").otherwise("high")),
    )
    domain = places(
        t,
        lambda w, i: has_suffix(w(0)) & (((w(1) == "in") & (w(2) == "(")) | ((w(1) == "=") & w(2).rlike("^['\"]"))),
        lambda w, i: hit("enum_domain_closure", F.array_join(F.transform(F.slice(F.filter(F.when(w(1) == "in", until(t, i + 2, (")",))).otherwise(F.array(w(2))), lambda x: x.rlike("^['\"]")), 1, 12), bare), ","), "medium"),
    )
    block = lambda i: until(t, i, ("end",))
    cases = places(t, lambda w, i: (w(0) == "case") & F.exists(block(i), has_suffix) & ~any_of(block(i), ("else",)), lambda w, i: hit("enum_domain_closure", F.lit("case_without_else"), "medium"))
    empty = lambda w: w(4).isin(*EMPTY) & (w(5) == ")")
    nulls = places(t, lambda w, i: w(0).isin(*FALLBACK) & (w(1) == "(") & (w(3) == ","), lambda w, i: hit("null_default_fallback", w(4), F.when(empty(w), "high").otherwise("medium")))
    tests = places(t, lambda w, i: (w(1) == "is") & ((w(2) == "null") | ((w(2) == "not") & (w(3) == "null"))), lambda w, i: hit("null_default_fallback", F.lit("null_test"), "medium"))
    rebuilt = lambda w: (w(0) == "full_refresh") | ((w(0) == "create") & (w(1) == "or") & (w(2) == "replace") & (w(3) == "table"))
    built = lambda w: (w(0) == "materialized") & w(1).isin("=", ":")
    whole = places(t, lambda w, i: rebuilt(w) | (built(w) & bare(w(2)).isin("table", "view", "incremental")), lambda w, i: hit("materialization_cost", F.when(built(w), bare(w(2))).otherwise("rebuilt"), F.when(rebuilt(w) | (bare(w(2)) == "table"), "critical").otherwise("high")))
    return F.concat(*[x.cast(HITS) for x in (temporal, grown, joins, domain, cases, nulls, tests, whole)])


def assumption_scan(df: DataFrame, text: str = "query_text", key: str = "query_id", unique: str | None = None) -> DataFrame:
    """key, family, detail, severity: one row for each place where a text shows an assumption; incremental filters once a text.

    unique: a boolean column, whether the joined keys are known to be unique. Null and empty texts show nothing.
    """
    known = F.coalesce(F.col(unique), F.lit(False)) if unique else F.lit(False)
    cut = df.select(key, known.alias("__u"), tokens(F.col(text)).alias("__t"))
    return cut.select(key, F.inline(family_hits(F.col("__t"), F.col("__u"))))


def field_assumptions(df: DataFrame, names: DataFrame, text: str = "query_text", key: str = "query_id", near: int = NEAR) -> DataFrame:
    """key, name, kind, confidence: what a text assumes about each of the given fields (name), by what stands near them.

    Names are found by an equi-join with the tokens' last parts, so that texts and names never meet otherwise; near are so many
    tokens on both sides. Of several confidences of a kind the highest counts. A text that stands in many rows is looked at once.
    """
    each = df.select(key, F.coalesce(text, F.lit("")).alias("__text"))
    places_ = each.select("__text").distinct().select("__text", tokens(F.col("__text")).alias("t")).select("__text", "t", F.posexplode("t").alias("i", "token"))
    at = places_.withColumn("name", F.element_at(F.split("token", r"\."), -1)).join(names.select(F.lower("name").alias("name")).distinct(), "name")
    t, i = F.col("t"), F.col("i")
    w = lambda k: F.coalesce(F.get(t, i + k), F.lit(""))
    span = F.slice(t, F.greatest(i - near + 1, F.lit(1)), near + F.least(i, F.lit(near)) + 1)
    before = lambda n: F.slice(t, F.greatest(i - n + 1, F.lit(1)), F.least(i, F.lit(n)))
    has = lambda *words: any_of(span, words)
    call = any_of(before(4), TRUNCATE + CAST + ("extract",))
    kinds = {
        "GRAIN_OR_DEDUP": F.when(has("row_number"), 0.9).when(has("group", "distinct", "qualify"), 0.84),
        "INCREMENTAL_STATE": F.when(has(*STATE), 0.86),
        "TEMPORAL_COMPLETENESS": F.when(has(*COMPLETE), 0.8),
        "FRESHNESS_WINDOW": F.when(has(*WINDOW), 0.82),
        "STATUS_MAPPING": F.when(has("case") & has("when"), 0.84),
        "DOMAIN_FILTER": F.when((w(1).isin("=", "<") & (w(2).rlike("^['\"]") | (w(2) == ">"))) | ((w(1) == "in") & (w(2) == "(")), 0.88),
        "NULL_HANDLING": F.when(w(-2).isin(*FALLBACK) & (w(-1) == "("), 0.86).when((w(1) == "is") & (w(2).isin("null", "not")), 0.78),
        "TEMPORAL_BUCKETING": F.when(call, 0.91).when(any_of(before(8), ("over",)), 0.79),
        "JOIN_CARDINALITY": F.when(any_of(before(8), ("on",)) & ((w(1) == "=") & w(2).rlike("^[a-z_]") | (w(-1) == "=") & w(-2).rlike("^[a-z_]")), 0.9),
    }
    every = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("confidence")) for k, c in kinds.items()])
    found = at.select("__text", "name", F.inline(every)).where("confidence is not null").groupBy("__text", "name", "kind").agg(F.max("confidence").alias("confidence"))
    return each.join(found, "__text").groupBy(key, "name", "kind").agg(F.max("confidence").alias("confidence"))
