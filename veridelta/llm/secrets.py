"""Secret scans with a trigram inverted index (DataFrame functions only).

Each rule's regular expression gives a Boolean query over trigrams that any match must contain. An index holds postings
(trigram, row) of those trigrams in the lower-cased texts. Intersecting postings leaves the candidate rows of each rule,
and only those are searched with its expression. Rules without mandatory trigrams search all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, in_order, join_small, span_text, spans, text_of

#: More alternatives than this are given up for a weaker query, and longer character classes end a literal.
MAX_WAYS, MAX_CLASS = 64, 4
#: Candidates are a long and an int each; up to this many are broadcast.
BROADCAST_CANDIDATES = 500_000


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ok: Callable[[Column], Column] | None = None
    base: bool = False


ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: Fixed patterns. The first three are the base rules.
RULES = [
    Rule("assign", ASSIGN, lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 1)) >= 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: F.char_length(m) >= 20, True),
    # runs of 24 or more; shorter runs fail, so that asking for the length in the pattern finds the same spans
    Rule("hex", r"[0-9a-f]{24,}", None, True),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of lower-case trigrams; a match contains all of one set. None: a match needs no trigram.

    A way through the expression is what it must contain so far and the literal text it ends in.
    """
    Ways = set[tuple[frozenset, str]]

    def broken(ways: Ways) -> Ways:
        return {(have, "") for have, _ in ways}

    def literal(ways: Ways, chars: list[str]) -> Ways:
        out = set()
        for have, tail in ways:
            for c in chars:
                end = (tail + c.lower())[-3:]
                out.add((have | {end} if len(end) == 3 else have, end[-2:] if len(end) == 3 else end))
        return out if len(out) <= MAX_WAYS else broken(ways)

    def walk(ways: Ways, items) -> Ways:
        for op, arg in items:
            if op is C.LITERAL:
                ways = literal(ways, [chr(arg)])
            elif op is C.IN and all(x is C.LITERAL for x, _ in arg) and len(arg) <= MAX_CLASS:
                ways = literal(ways, [chr(x) for _, x in arg])
            elif op is C.SUBPATTERN:
                ways = walk(ways, arg[3])
            elif op is C.BRANCH:
                ways = set().union(*(walk(ways, b) for b in arg[1]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                least, most, inner = arg
                if (least, most) == (0, 1):
                    ways = ways | walk(ways, inner)
                else:
                    ways = broken(walk(ways, inner) if least else ways)
            elif op is not C.AT:
                ways = broken(ways)
            ways = ways if len(ways) <= MAX_WAYS else broken(ways)
        return ways

    sets = {have for have, _ in walk({(frozenset(), "")}, _parser.parse(pattern))}
    least = [s for s in sets if not any(o < s for o in sets)]
    return None if any(not s for s in least) else sorted(least, key=sorted)


def row_key(text: str = "text") -> Column:
    """Rows with one text share one key, and with it their postings."""
    return F.xxhash64(text_of(text))


def postings(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """The inverted index: trigram (its place in the list) and row, one posting for each trigram that a row contains."""
    low = docs.select(row_key(text).alias("row"), F.lower(text_of(text)).alias("__low"))
    held = F.array_compact(F.array(*[F.when(F.contains("__low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select("row", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[frozenset[str]]], trigrams: list[str]) -> DataFrame:
    """row and rules (bit k: the k-th rule) of rows whose postings satisfy a rule's query."""
    place = {t: i for i, t in enumerate(trigrams)}
    words = -(-len(trigrams) // 62)
    held = index.groupBy("row").agg(*[F.bit_or(F.when(F.floor(F.col("trigram") / 62) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") % 62)).otherwise(0)).alias(f"h{k}") for k in range(words)])

    def holds(need: frozenset[str]) -> Column:
        out = F.lit(True)
        for k in range(words):
            mask = sum(1 << (place[t] % 62) for t in need if place[t] // 62 == k)
            out = out & (F.col(f"h{k}").bitwiseAND(F.lit(mask).cast("long")) == mask) if mask else out
        return out

    bits = F.lit(0)
    for k, ways in enumerate(queries.values()):
        any_way = F.lit(False)
        for need in ways:
            any_way = any_way | holds(need)
        bits = bits + F.when(any_way, 1 << k).otherwise(0)
    return held.select("row", bits.alias("rules")).where("rules > 0")


def find_secrets(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text") -> DataFrame:
    """docs with a column secrets: array<struct<start,rank,end,kind,m>> in order of start, then of the rules.

    Offsets are code points, ends exclusive. A null or empty text has no spans. Repeated rows share their postings and
    get equal spans. An empty table gives an empty result. A column named secrets is replaced.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for ways in queries.values() for s in ways for t in s})
    own = docs.drop("secrets")
    found = cut(candidates(postings(docs, trigrams, text), queries, trigrams).select(F.col("row").alias("__row"), F.col("rules").alias("__rules")))
    with_rules = join_small(own.withColumn("__row", row_key(text)), found, ["__row"], limit=BROADCAST_CANDIDATES)
    t, none = text_of(text), F.array().cast("array<struct<start:int,end:int,kind:string,m:string>>")
    each = []
    for r in rules:
        s = spans(t, r.pattern, r.kind, r.ok)
        if r.kind in queries:
            s = F.when(F.col("__rules").bitwiseAND(1 << list(queries).index(r.kind)) > 0, s).otherwise(none)
        each.append(s)
    return with_rules.withColumn("secrets", in_order(F.concat(*each), [r.kind for r in rules])).drop("__row", "__rules")


def digest(found: str, kinds: list[str], names: list[str]) -> list[Column]:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    base = F.filter(found, lambda s: s["kind"].isin(kinds))
    count = lambda k: F.size(F.filter(found, lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(n) for k, n in zip(kinds, names)]
    return [*counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col(found)).alias("spans")]
