"""Personal data (DataFrame functions only on the main path).

Four validated formats always count. Generators of high recall propose overlapping candidates beyond them: runs of
digits, groups of hexadecimal digits, and addresses that are spelled out. Boosted trees over format and context features
score them, and those above a threshold of their kind are added where no validated span lies. The trees are fitted on
the driver from a bounded sample of documents, into each of which one value is planted: personal data in formats that no
validator knows, or numbers and phrases that only look alike. Their labels come from what was planted, so the trees
learn what the validators can't tell; half of the documents are left out of the fit and set the thresholds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boost
from .common import fresh, in_order, spans, text_of

BASE = ["email", "ip", "card", "phone"]
ADDED = ["maybe_email", "maybe_number", "maybe_ip"]
SPANS = "array<struct<start:int,end:int,kind:string,m:string>>"

#: Fixed patterns. \G lets a match begin where the last one ended; the look-behind keeps others from starting inside a
#: run, where they would fail as the run's start did. Possessive loops don't recurse, so long runs are safe.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"  # maximal runs; those of fewer than 12 digits fail anyway
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOOSE_EMAIL = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[a-z0-9-]{1,64}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[a-z0-9-]{2,24}+){1,4}"
LOOSE_NUMBER = r"[+(]?[0-9](?:[\x20().,:/-]{0,2}[0-9]){6,}+"
LOOSE_IP = r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}"
#: Words searched in the 24 characters before a candidate: those that announce personal data, and other numbers.
ANNOUNCE = r"(?i)mail|tel|phone|fon|call|fax|mobile|card|visa|credit|\bip\b|addr|contact|reach|write|host|server"
NUMBERED = r"(?i)order|invoice|isbn|version|page|date|\bid\b|\bref|\bno\b|token|key|part|serial|figure|total|\bon\b|since"

#: What is planted for the fit: D is a digit, H a hexadecimal digit, W a letter.
PERSONAL = ["(DDD) DDD-DDDD", "DDD-DDD-DDDD", "DDD.DDD.DDDD", "0DDD DDDDDDD", "DDD DDD DDDD", "DDDD.DDDD.DDDD.DDDD", "WWWWW at WWWWWW dot com", "WWWW (at) WWWWW (dot) org", "WWWWWW[at]WWWWWW.net", "WWWW.WWW @ WWWWWW.com", "HHHH:HHHH:HHHH:HHHH:HHHH:HHHH:HHHH:HHHH", "HHHH:HHH::HHHH:HHHH"]
ORDINARY = ["20DD-0D-DD 1D:DD:DD", "1D.0D.20DD", "DDDDDDDDDD", "DDDDDDDD", "D,DDD,DDD.DD", "D.D.D.DD.D", "1D:DD:DD:DD", "DDD/DDDDDD", "HHHHHHHHDDDDDDDDHHHHHHH", "1DDD-1DDD, 1DDD-1DDD", "WWWWW at WWWWWW. WWWW", "WWWW at WWWWWW.\nWWWWWWW", "WWWWW @ WWWWW"]
BEFORE_PERSONAL = [" call ", " phone: ", " tel. ", " contact ", " write to ", " reach us ", " ", ", ", " mobile "]
BEFORE_ORDINARY = [" order ", " invoice no ", " on ", " version ", " page ", " ref. ", " ", ", ", " total "]


@dataclass(frozen=True)
class Fit:
    """sample_docs: documents that are planted into, about; sample_rows: candidates that are fitted on, at most. precision:
    what a threshold must reach on the half of the sample that isn't fitted on; least: positives above it, at least."""

    sample_docs: int = 4000
    sample_rows: int = 8000
    precision: float = 0.995
    least: int = 5
    rounds: int = 16
    depth: int = 3


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits pass Luhn's check: from the right, every second one is doubled and cast out by nines."""
    each = F.reverse(F.split(digits(m), ""))

    def add(acc: Column, d: Column) -> Column:
        v = d.cast("int")
        twice = 2 * v - F.when(v > 4, 9).otherwise(0)
        return F.struct((acc["sum"] + F.when(acc["second"], twice).otherwise(v)).alias("sum"), (~acc["second"]).alias("second"))

    return F.aggregate(each, F.struct(F.lit(0).alias("sum"), F.lit(False).alias("second")), add, lambda a: a["sum"] % 10 == 0)


def base_spans(t: Column) -> Column:
    """Validated spans of the four kinds, each leftmost and non-overlapping among its own kind."""
    none = F.array().cast(SPANS)
    n = lambda m: F.char_length(digits(m))
    return F.concat(
        F.when(F.contains(t, F.lit("@")), spans(t, EMAIL, "email")).otherwise(none),
        spans(t, IP, "ip", lambda m: m.rlike(OCTETS)),
        spans(t, CARD, "card", lambda m: F.when(n(m) <= 19, luhn(m)).otherwise(False)),
        F.when(F.contains(t, F.lit("+")), spans(t, PHONE, "phone", lambda m: n(m).between(9, 15))).otherwise(none),
    )


def candidate_spans(t: Column) -> Column:
    none = F.array().cast(SPANS)
    return F.concat(F.when(t.rlike(r"(?i)@|[(\[\x20]at[)\]\x20]"), spans(t, LOOSE_EMAIL, "maybe_email")).otherwise(none), spans(t, LOOSE_NUMBER, "maybe_number"), spans(t, LOOSE_IP, "maybe_ip"))


def features(c: Column, t: Column) -> list[Column]:
    """Format and context of a candidate in its text, as doubles. None of them repeats a validator."""
    m = c["m"]
    count = lambda keep: F.char_length(F.regexp_replace(m, f"[^{keep}]", ""))
    before = F.substring(t, F.greatest(c["start"] - 23, F.lit(1)), F.least(c["start"], F.lit(24)))
    after = F.substring(t, c["end"] + 1, F.lit(1))
    groups = F.transform(F.filter(F.split(m, "[^0-9]+"), lambda g: g != ""), lambda g: F.char_length(g))
    last = F.coalesce(F.try_element_at(groups, F.lit(-1)), F.lit(0))
    counts = [F.char_length(m), *[count(k) for k in ("0-9", "A-Za-z", ".", r"\x20", "()", "-", ":", ",/")], F.size(groups), F.coalesce(F.array_max(groups), F.lit(0)), last]
    flags = [F.contains(m, F.lit("@")), m.rlike(r"(?i)[(\[]at[)\]]"), m.rlike(r"(?i)\x20dot\x20|[(\[]dot[)\]]"), m.rlike(r"\.\s?[A-Z]"), m.rlike(r"^[(+0]"), m.rlike(r"^(19|20)[0-9]{2}"), before.rlike(ANNOUNCE), before.rlike(NUMBERED), before.rlike(r"[A-Za-z0-9]$"), after.rlike("[A-Za-z0-9]")]
    return [x.cast("double") for x in [*counts, *flags]]


def overlaps(c: Column, base: Column) -> Column:
    return F.exists(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))


@dataclass(frozen=True)
class Model:
    trees: list | None
    thresholds: dict[str, float]


def value(form: str, seed: Column) -> Column:
    """A planted form filled from the hash of seed."""
    hexes = F.sha2(seed, 512)
    made = {"D": F.translate(hexes, "abcdef", "012345"), "H": hexes, "W": F.translate(hexes, "0123456789", "ghijklmnop")}
    at, parts = 1, []
    for run in re.findall("D+|H+|W+|[^DHW]+", form):
        parts.append(F.substring(made[run[0]], at, len(run)) if run[0] in made else F.lit(run))
        at += len(run)
    return F.concat(*parts)


def last_hash(docs: DataFrame, how: Fit) -> int:
    """The how.sample_docs-th smallest hash of a text, or the largest there is: up to it, texts are in the sample.

    Hashes are counted once, so a text that fills much of the table is one of the sample at most, and the sample is of
    the same size however large the table.
    """
    hashes = docs.select(F.xxhash64("text", F.lit(1)).alias("o")).distinct().orderBy("o").limit(how.sample_docs)
    return hashes.agg(F.max("o")).first()[0] or 0


def planted(docs: DataFrame, how: Fit) -> DataFrame:
    """o (a hash of the text), t (the text with a value planted after one of its spaces), start and end of the value, good.

    Which texts are taken, each once, and what is planted where, follows from hashes of the texts.
    """
    hashed = docs.select(text_of("text").alias("t"), F.xxhash64("text", F.lit(1)).alias("o"))
    picked = hashed.where(F.col("o") <= F.lit(last_hash(docs, how))).dropDuplicates(["o"])
    pick = lambda salt, of: F.pmod(F.xxhash64("t", F.lit(salt)), F.lit(of)).cast("int")
    seed = F.sha2(F.col("t"), 256)
    from_list = lambda salt, values: F.element_at(F.array(*values), pick(salt, len(values)) + 1)
    good = pick(2, 2) == 0
    lead = F.when(good, from_list(3, [F.lit(x) for x in BEFORE_PERSONAL])).otherwise(from_list(3, [F.lit(x) for x in BEFORE_ORDINARY]))
    new = F.when(good, from_list(4, [value(f, seed) for f in PERSONAL])).otherwise(from_list(4, [value(f, seed) for f in ORDINARY]))
    place = F.call_function("locate", F.lit(" "), F.col("t"), 1 + pick(5, 2**30) % F.greatest(F.char_length("t"), F.lit(1)))
    rows = picked.select("o", "t", good.alias("good"), lead.alias("lead"), new.alias("new"), F.when(place > 0, place - 1).otherwise(F.char_length("t")).alias("p"))
    start = F.col("p") + F.char_length("lead")
    whole = F.concat(F.substring("t", F.lit(1), F.col("p")), F.col("lead"), F.col("new"), F.lit(" "), F.substring("t", F.col("p") + 1, F.lit(2**31 - 1)))
    return rows.select("o", whole.alias("t"), start.alias("start"), (start + F.char_length("new")).alias("end"), "good")


def fit(docs: DataFrame, how: Fit = Fit()) -> Model:
    """A model from candidates in documents that were planted into.

    Without candidates of both labels there is no model if the table has fewer texts than the sample may have, so that
    small tables get their validated spans; a full sample without them is an error.

    A candidate is personal if it holds most of a planted value of that sort. Those that hold only a part of one, or
    overlap a validated span, are left out.
    """
    rows = planted(docs, how).select("*", base_spans(F.col("t")).alias("base"), F.explode(candidate_spans(F.col("t"))).alias("c")).where(~overlaps(F.col("c"), F.col("base")))
    held_part = F.greatest(F.least(F.col("c.end"), F.col("end")) - F.greatest(F.col("c.start"), F.col("start")), F.lit(0)) / (F.col("end") - F.col("start"))
    label = F.when(~F.col("good") | (held_part == 0), 0).when(held_part >= 0.8, 1)
    rows = rows.select("o", F.col("c.start").alias("start"), F.col("c.kind").alias("kind"), label.alias("y"), F.array(*features(F.col("c"), F.col("t"))).alias("x")).where("y is not null")
    got = rows.orderBy("o", "start", "kind").limit(how.sample_rows).collect()
    x, y, kind = np.array([r.x for r in got]), np.array([r.y for r in got], dtype=float), np.array([r.kind for r in got])
    held = np.array([r.o % 2 == 0 for r in got], dtype=bool)
    if len(set(y[~held])) < 2:
        if docs.select(F.xxhash64("text", F.lit(1))).distinct().limit(how.sample_docs).count() == how.sample_docs:
            raise ValueError(f"no model can be fitted: {len(got)} candidates in {how.sample_docs} sampled texts")
        return Model(None, {})
    trees = boost.fit(x[~held], y[~held], how.rounds, how.depth)
    p = boost.predict(trees, x)
    limits = {}
    for k in ADDED:
        own = held & (kind == k)
        for c in np.unique(p[own]):
            above = y[own & (p >= c)]
            if above.mean() >= how.precision and above.sum() >= how.least:
                limits[k] = float(c)
                break
    return Model(trees, limits)


def find_pii(docs: DataFrame, model: Model | None = None, out: str = "pii") -> DataFrame:
    """docs with a column `out`: array<struct<start,rank,end,kind,m>> in order of start, then kind.

    Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated rows have equal ones; an empty
    table gives an empty result. A column of that name is replaced, others stay whatever their names. Without a model
    one is fitted on a sample of docs.
    """
    model = fit(docs) if model is None else model
    base, found = fresh(docs, "base"), fresh(docs, "found")
    own = docs.drop(out).withColumn(base, base_spans(text_of("text")))
    spans_all = F.col(base)
    if model.trees is not None and model.thresholds:
        own = own.withColumn(found, F.when(text_of("text").rlike(r"(?i)@|[(\[\x20]at[)\]\x20]|[0-9](?:[\x20().,:/-]{0,2}[0-9]){6}|:[0-9a-f]{0,4}:"), candidate_spans(text_of("text"))).otherwise(F.array().cast(SPANS)))
        limit = F.create_map(*[F.lit(v) for kv in model.thresholds.items() for v in kv])
        new = F.filter(found, lambda c: limit[c["kind"]].isNotNull() & ~overlaps(c, F.col(base)))
        scored = F.transform(new, lambda c: F.struct(c.alias("c"), F.array(*features(c, text_of("text"))).alias("x")))
        chosen = F.filter(scored, lambda s: boost.expression(model.trees, lambda f: s["x"][f]) >= limit[s["c"]["kind"]])
        spans_all = F.concat(spans_all, F.transform(chosen, lambda s: s["c"]))
    return own.withColumn(out, in_order(spans_all, BASE + ADDED)).drop(base, found)


def redacted(t: Column, found: Column) -> Column:
    """The text with each span, or group of overlapping spans, replaced by its first kind in brackets."""

    def step(acc: Column, s: Column) -> Column:
        new = F.concat(acc["out"], F.array(F.substring(t, acc["pos"] + 1, s["start"] - acc["pos"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(s["start"] >= acc["pos"], new).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(found, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["pos"] + 1, F.lit(2**31 - 1))))
    return F.when(F.size(found) == 0, t).otherwise(done)


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with the personal data in text replaced, and n_chars (if there) counted anew.

    A null text stays null and an empty one empty; repeated rows are redacted alike; an empty table gives an empty
    result. All other columns stay, whatever their names.
    """
    mark = fresh(docs, "spans")
    found = find_pii(docs, model, mark)
    new = {"text": F.when(F.col("text").isNotNull(), redacted(F.col("text"), F.col(mark)))}
    out = found.withColumns(new)
    out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
    return out.select(*docs.columns)
