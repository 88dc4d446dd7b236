"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import sys
import tempfile
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the control characters 9 to 13.
WORD_SEP = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
#: A table with at most this many rows (of a few numbers and short strings each) may be broadcast.
BROADCAST_ROWS = 100_000


def fresh(df: DataFrame, name: str) -> str:
    """A name for a working column that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name in taken:
        name += "_"
    return name


def text_of(col: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(col: str | Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    t = F.btrim(text_of(col), F.lit(WHITE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_SEP))


def settled(c: Column) -> Column:
    """The same value, computed once for each row where it stands.

    The optimizer would copy a costly expression into the filters above it, even into the body of a lambda function,
    where it runs for each element. It does not move expressions that aren't deterministic.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def word_count(col: str | Column) -> Column:
    t = F.btrim(text_of(col), F.lit(WHITE))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, WORD_SEP))).cast("long")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and go on from there.

    The folder is the session's spark.checkpoint.dir. Only where that is unset (tests, notebooks) a local one is made.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "veridelta-checkpoints"))
    return df.checkpoint()


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Null-safe join with a table that was already cut: broadcast if counting shows at most `limit` rows.

    A larger one is joined by shuffling, where adaptive execution splits skewed partitions. `small` has one row a key;
    its own key columns are left out of the result.
    """
    renamed = small.select(*[F.col(c).alias(f"__k_{c}") for c in on], *[c for c in small.columns if c not in on])
    if small.count() <= limit:
        renamed = F.broadcast(renamed)
    cond = None
    for c in on:
        eq = F.col(c).eqNullSafe(F.col(f"__k_{c}"))
        cond = eq if cond is None else cond & eq
    return df.join(renamed, cond, how).drop(*[f"__k_{c}" for c in on])


def spans(text: Column, pattern: str, kind: str, ok: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,kind,m>>, in code points, end exclusive.

    The text between matches (split) and the matches themselves (regexp_extract_all) give the positions by adding up
    lengths. Matches for which ok(match) isn't true are left out but still use up their text.
    """
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,m:string>>")
    parts = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, m: F.struct(F.char_length(gap).alias("gap"), m.alias("m")),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.coalesce(F.char_length(x["m"]), F.lit(0))
        good = x["m"].isNotNull() if ok is None else x["m"].isNotNull() & ok(x["m"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("m")))
        return F.struct(end.alias("pos"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(empty)


def span_text(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_order(found: Column, kinds: list[str]) -> Column:
    """Spans by start, then by kind as listed, then by end."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    keyed = F.transform(found, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["m"].alias("m")))
    return F.sort_array(keyed)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(module: str) -> None:
    """Send the functions of a module with the tasks that call them, so that executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
