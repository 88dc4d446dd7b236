"""Quality rules with thresholds taken from the data (DataFrame functions only).

Each document gets a few counts. Their rates go into mergeable quantile sketches, one per language, source and measure:
a table of counts by logarithmic bucket, so that merging is adding and the result doesn't depend on the order. Fences
read from the sketches replace fixed cutoffs, and a join with them filters the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WHITE, cut, join_small, settled, text_of, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    """min_words, max_repeat_percent: the base rules. spread: interquartile ranges beyond the quartiles that are still
    usual. lower: measures that have a lower fence as well. some: measures whose sketches hold only values above zero,
    since most documents have none."""

    min_words: int = 50
    max_repeat_percent: int = 50
    spread: int = 6
    lower: tuple[str, ...] = ("word_length",)
    some: tuple[str, ...] = ("dup_line_rate",)


def sorted_windows(shingles: str) -> Column:
    """(hash, place) of each 3-word window, sorted; null if no window repeats, so that most texts sort nothing."""
    sh = F.col(shingles)
    return F.when(F.size(F.array_distinct(sh)) < F.size(sh), F.sort_array(F.transform(sh, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def repeat_words(pairs: str) -> Column:
    """Words that lie in a 3-word window found twice or more: such a window has an equal neighbour in sorted order."""
    p = F.col(pairs)
    twice = F.filter(p, lambda x, j: (x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"]))
    at = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.coalesce(F.size(F.array_distinct(at)), F.lit(0))


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The five counts of each row, beside the columns `keep` (all by default).

    A null text counts as empty, and an empty one has zero everywhere. Repeated rows are measured alike. Columns of docs
    that have the name of a count are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    first = docs.select(*keep, t.alias("__t"), words(text).alias("__w"), lines.alias("__l"))
    n = F.size("__w")
    shingles = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.col("__w")[i], F.col("__w")[i + 1], F.col("__w")[i + 2])))
    second = first.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", "__w")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").alias("__n_lines"),
        F.char_length(F.regexp_replace("__t", r"[^\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+", "")).cast("long").alias("__n_marks"),
        F.col("__w"),
        shingles.alias("__s"),
    )
    third = second.select(*[c for c in second.columns if c not in ("__w", "__s")], sorted_windows("__s").alias("__p"))
    return third.select(*[c for c in third.columns if c != "__p"], settled(repeat_words("__p").cast("long")).alias("n_repeat_words"))


def base_failed(r: Rules) -> Column:
    return (F.col("n_words") < r.min_words) | (100 * F.col("n_repeat_words") > r.max_repeat_percent * F.col("n_words"))


def rates() -> dict[str, Column]:
    """Whole numbers: marks (punctuation and symbols of ASCII) per thousand words, repeated lines per thousand lines (with
    five lines more, so that one repeated line doesn't decide over a short text), and hundredths of a word's mean length."""
    return {
        "mark_rate": F.expr("__n_marks * 1000 div greatest(n_words, 1)"),
        "dup_line_rate": F.expr("n_dup_lines * 1000 div (__n_lines + 5)"),
        "word_length": F.expr("word_chars * 100 div greatest(n_words, 1)"),
    }


def bucket(v: Column) -> Column:
    """Lower end of the sketch's bucket: exact below 64, then 32 buckets to each doubling (error 1 in 32 at most)."""
    k = F.greatest(F.char_length(F.bin(v)) - 6, F.lit(0))
    return v.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), k)).cast("long")


def sketch(measured: DataFrame, r: Rules, lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts by language, source, measure and bucket, of documents that pass the base rules. Sketches merge by adding counts."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.when((v > 0) | F.lit(k not in r.some), bucket(v)).alias("bucket")) for k, v in rates().items()]))
    return measured.where(~base_failed(r)).select(F.col(lang).alias("lang"), F.col(source).alias("source"), each.alias("x")).where("x.bucket is not null").groupBy("lang", "source", "x.measure", "x.bucket").agg(F.count("*").alias("n"))


def fences(sketches: DataFrame, r: Rules) -> DataFrame:
    """One row per language and source: <measure>_low and <measure>_high, from the quartiles of its sketches.

    A group's own quartiles set its fences; if they are equal, the range of all documents stands for theirs. No fence is
    wider than that of all documents, so a group that is mostly junk can't excuse itself. Nothing but the data moves a
    fence; a range counts as one part in 32 of its upper quartile more, since a sketch's values are that coarse.
    """

    def quartiles(s: DataFrame, keys: list[str]) -> DataFrame:
        w = W.partitionBy(*keys, "measure")
        cum = s.withColumn("cum", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
        return cum.groupBy(*keys, "measure").agg(*[F.min(F.when(F.col("cum") * 4 >= F.col("total") * q, F.col("bucket"))).alias(f"q{q}") for q in (1, 3)])

    own = quartiles(sketches, ["lang", "source"])
    every = quartiles(sketches.groupBy("measure", "bucket").agg(F.sum("n").alias("n")), []).select("measure", F.col("q1").alias("a1"), F.col("q3").alias("a3"))
    both = own.join(F.broadcast(every), "measure")  # one row a measure
    between = lambda low, high: r.spread * (F.col(high) - F.col(low) + F.ceil(F.col(high) / 32))
    wide = between("a1", "a3")
    near = F.when(F.col("q3") > F.col("q1"), between("q1", "q3")).otherwise(wide)
    out = []
    for k in rates():
        mine = F.col("measure") == k
        high, low = F.least(F.col("q3") + near, F.col("a3") + wide), F.greatest(F.col("q1") - near, F.col("a1") - wide)
        out.append(F.max(F.when(mine, high)).alias(f"{k}_high"))
        if k in r.lower:
            out.append(F.max(F.when(mine, low)).alias(f"{k}_low"))
    return both.groupBy("lang", "source").agg(*out)


def judge(measured: DataFrame, limits: DataFrame, r: Rules) -> DataFrame:
    """base_failed and kept. `limits` was cut. A row whose language and source have no fences fails the base rules."""
    joined = join_small(measured, limits, ["lang", "source"])
    usual = F.lit(True)
    for k, v in rates().items():
        usual = usual & (v <= F.coalesce(F.col(f"{k}_high"), v))
        if k in r.lower:
            usual = usual & (v >= F.coalesce(F.col(f"{k}_low"), v))
    failed = base_failed(r)
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & usual).drop(*[c for c in limits.columns if c not in ("lang", "source")], "__n_lines", "__n_marks")


def quality_rules(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of each row of docs (doc_id, text, lang, source).

    Nulls: a null text is empty, so it fails for want of words; null languages and sources are groups of their own; a
    null doc_id is carried. Rows are judged one by one, so repeated rows have equal verdicts. An empty table gives an
    empty result. Other columns are ignored.
    """
    r = rules or Rules()
    m = cut(measure(docs.select("doc_id", "text", "lang", "source"), keep=["doc_id", "lang", "source"]))
    return judge(m, cut(fences(sketch(m, r), r)), r).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their names.

    Rows are judged one by one: a null text is dropped for want of words, null languages and sources are groups of their
    own, repeated rows have equal verdicts, and an empty table gives an empty result. Texts are measured a second time instead of being shuffled or stored with their counts.
    """
    r = rules or Rules()
    limits = cut(fences(sketch(measure(docs, keep=["lang", "source"]), r), r))
    own = [F.col(c).alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    back = [F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)]
    return judge(measure(docs.select("text", "lang", "source", *own)).drop("text"), limits, r).where("kept").select(*back)
