"""Near-duplicate groups: fast similarity sketches, banding, exact verification.

A sketch of t coordinates places every shingle in one hashed bin a round; a bin keeps its smallest value, of which the
round is the leading part. After t rounds each further round fills one bin by force, so no coordinate stays empty, and
agreement of coordinates is concentrated as for as many independent hashes. Rounds end once all bins are filled.

Equal shingle sets form one class, and only classes are compared. Classes that agree in a band form a bucket. A few
classes of each bucket, its pivots, are compared with all others of it: those of the smallest components first, then the
most central. Pivots are at most `late` a bucket, so pairs grow with the rows. A bucket of no more classes is done then.
In a larger one, two classes that are still apart and aren't pivots can only be similar in one of two ways:

- They share a shingle that the first pivot doesn't have. Only shingles that another component's class has beyond the
  pivot, too, count. Of these, rarest first, each class needs only as many as a similar one can't miss all of. Classes
  that share one of them form a bucket of the next round.
- All they share is in the pivot. Then both lie in it to `percent`. Those of similar size form a bucket of the next round.

What a class can share at all bounds the other's size; classes that no other of their bucket fits are left out. Buckets of
one star that get the same first pivot are one star again, so a class isn't multiplied by its shingles in each round.
So no link between components is lost, and large groups don't give all their pairs. What two classes share with their
last pivot, and what they can share beyond it, bounds what they share with each other; pairs that can't reach the
threshold are left out. Similarity is checked on the full sets of shingle hashes (64 bits).
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, join_small, ship

ship(__name__)

#: A bucket's or a document's key is a long; tables of so many are broadcast. The driver collects them and builds their hash table.
BROADCAST_KEYS = 100_000
LINKS_A_TASK = 100_000


@dataclass(frozen=True)
class Near:
    """words a shingle has; percent: least Jaccard similarity of a link; rows in a band; miss: the chance that a pair at
    just that similarity shares no bucket, which sets the number of bands; small: band buckets of so many are compared in
    pairs; pivots: of larger ones, so many are compared with all others; late: as many in buckets of later rounds."""

    words: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 1e-6
    small: int = 64
    pivots: int = 2
    late: int = 64

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (constants of the splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles, A-Z in lower case; the whole sequence is one if it has fewer words."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters, and spaces of codes 9 to 13 and 32
    if not found:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64)
    n = min(k, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j])
    return np.unique(acc)


def sketch(x: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of a set that isn't empty. Rounds come in blocks, since later rounds can't beat earlier values."""
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    low, done = np.uint64((1 << 40) - 1), 0
    while done < t:
        many = min(t - done, max(1, -(-4 * t // len(x))))
        i = np.arange(done, done + many, dtype=np.uint64)[:, None]
        h = mix(x[None, :] + (i + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        np.minimum.at(out, ((h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).ravel().astype(np.intp), ((i << np.uint64(40)) | (h & low)).ravel())
        done += many
        if out.max() < np.iinfo(np.uint64).max:
            return out
    for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
        i = np.array([t + b], np.uint64)
        out[b] = (i << np.uint64(40) | mix(x + (i + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) & low).min()
    return out


def bands(x: np.ndarray, near: Near) -> np.ndarray:
    """A key for each band of the sketch; the band's number goes into it."""
    s = sketch(x, near.bands * near.rows).reshape(near.bands, near.rows)
    acc = np.arange(1, near.bands + 1, dtype=np.uint64)
    for j in range(near.rows):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + s[:, j])
    return acc.view(np.int64)


def fold(x: np.ndarray) -> int:
    """One hash of a sorted set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes())).view(np.int64))


def sketched(docs: DataFrame, near: Near, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, sig (hash of the set; null for an empty one) and bands; and the column `row`, a long, if it's named."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = [row] if row else []

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sig, keys = [], [], []
            for text in b.column(1):
                x = shingles(text.as_py(), near.words)
                n.append(len(x))
                sig.append(fold(x) if len(x) else None)
                keys.append(bands(x, near) if len(x) else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(keys, pa.list_(pa.int64())), *b.columns[2:]], ["doc_id", "n_shingles", "sig", "bands", *more])

    return docs.select("doc_id", "text", *more).mapInArrow(each, f"doc_id {kind}, n_shingles long, sig long, bands array<long>" + (f", {row} long" if row else ""))


def shingle_sets(docs: DataFrame, near: Near) -> DataFrame:
    """sig and set, of each row's text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(text.as_py(), near.words) for text in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([fold(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["sig", "set"])

    return docs.select("text").mapInArrow(each, "sig long, set array<long>")


def compared(pairs: DataFrame, sets: DataFrame, near: Near, few: bool = False) -> DataFrame:
    """The pairs (a, b) with their sizes na and nb, what they share, and rest_a and rest_b where want_a and want_b ask for them.

    rest_x is the part of x beyond the other side. With `few`, sets that don't occur in pairs are left out before the shuffle.
    """
    used = sets.withColumn("__sig", F.col("sig"))
    if few:
        need = cut(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().withColumn("__hit", F.lit(1)))
        used = join_small(used, need, ["sig"], "inner", BROADCAST_KEYS)
    one = pairs.join(used.select(F.col("__sig").alias("a"), F.col("set").alias("sa")), "a")
    both = one.join(used.select(F.col("__sig").alias("b"), F.col("set").alias("sb")), "b")

    out = [F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared")]
    return both.select("a", "b", *out, F.when(F.col("want_a"), F.array_except("sa", "sb")).alias("rest_a"), F.when(F.col("want_b"), F.array_except("sb", "sa")).alias("rest_b"))


def similar(sims: DataFrame, near: Near) -> DataFrame:
    return sims.where(100 * F.col("shared") >= near.percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def tidy(df: DataFrame) -> None:
    """Lets Spark's cleaner remove the shuffle files and broadcasts of rounds that are over; it follows the driver's garbage collection."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Joins tables of a round by merging.

    Left to itself Spark collects each small one into the driver to broadcast it, many times a round, each time in a new
    thread that stays for a minute with the memory it took.
    """
    return left.join(right.hint("merge"), on, how)


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable. Labels go to neighbours and then jump to their label's label.

    Links are few against documents, and counted: each LINKS_A_TASK of them make a partition.
    """
    both = cut(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct())
    both = both.coalesce(1 + both.count() // LINKS_A_TASK)
    labels = cut(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        seen = met(both, labels.select(F.col("node").alias("other"), F.col("comp").alias("c")), "other").groupBy("node").agg(F.min("c").alias("c"))
        step = met(labels, seen, "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        new = cut(met(step, jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp")))
        labels = new.select("node", "comp")
        tidy(links)
        if new.where("old <> comp").isEmpty():
            return labels


def merged(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (sig, comp) with the new links (a, b) taken in. Only links between components are followed."""
    if comp is None:
        return components(links).select(F.col("node").alias("sig"), "comp")
    ends = labelled(links.select("b", F.col("a").alias("sig")), comp).select("b", F.col("comp").alias("x"))
    ends = labelled(ends.select("x", F.col("b").alias("sig")), comp).select("x", F.col("comp").alias("y"))
    between = cut(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if between.isEmpty():
        return comp
    new = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    nodes = between.select(F.explode(F.array("a", "b")).alias("sig"))
    known = comp.union(nodes.select("sig", F.col("sig").alias("comp"))).groupBy("sig").agg(F.min("comp").alias("comp"))
    return cut(met(known, new, "comp", "left").select("sig", F.coalesce("top", "comp").alias("comp")))


def near_groups(docs: DataFrame, near: Near = Near(), row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs (doc_id, text); and the column `row`, if it's named.

    component_id is the smallest doc_id that links of similar shingle sets reach, kept whether it is the row's own.
    With a `row`, a long that tells rows of one doc_id apart, kept is true for one row of a component only: that with the
    smallest doc_id (null last), and of these with the smallest `row`.
    Nulls: a text without words has no shingles and no links. A row without doc_id takes part, but its component is
    named by other rows; if there is none, component_id is null. Rows are judged one by one: without `row`, all rows of
    a component that have its doc_id are kept, and all rows of a component without any. An empty table gives an empty
    result. Other columns are ignored.
    """
    sk = cut(sketched(docs, near, row))
    more = [row] if row else []
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row) if row else F.col("doc_id")
    entries = sk.select("sig", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = cut(entries.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo < hi").select("key"))
    members = cut(join_small(entries.withColumn("__key", F.col("key")), shared, ["key"], "inner", BROADCAST_KEYS).select(F.col("__key").alias("key"), "sig", "n").distinct())
    classes = sk.where("sig is not null").groupBy("sig").agg(F.min(who).alias("rep"), F.count("*").alias("rows"))
    tidy(sk)
    comp = linked(docs, sk, members, near)
    named = classes.join(comp, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))
    tops = named.groupBy("comp").agg(F.min("rep").alias("top"), F.sum("rows").alias("rows"))
    # a group of one row needs no name, and most groups are such
    groups = cut(named.select("sig", "comp").join(tops.where("rows > 1"), "comp").select("sig", "top"))
    out = join_small(sk.select("doc_id", "n_shingles", "sig", *more), groups, ["sig"], limit=BROADCAST_KEYS)
    top = F.coalesce("top", who)
    named_by = top["doc_id"] if row else top
    kept = who.eqNullSafe(top)
    return out.select("doc_id", "n_shingles", named_by.alias("component_id"), kept.alias("kept"), *more)


def linked(docs: DataFrame, sk: DataFrame, members: DataFrame, near: Near) -> DataFrame:
    """Components (sig, comp) of classes, from buckets (key, sig, n: its size). Classes without links have no row."""
    first = sk.join(members.select("sig").distinct(), "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("doc_id"))
    # one row of each class that shares a bucket; its text is read again, which is less than storing all sets
    ids = cut(first)
    texts = join_small(docs.select("doc_id", "text"), cut(ids.select("doc_id").distinct().withColumn("__hit", F.lit(1))), ["doc_id"], "inner", BROADCAST_KEYS)
    sets = cut(shingle_sets(texts, near).dropDuplicates(["sig"]))
    tidy(docs)
    sized = members.join(members.groupBy("key").agg(F.count("*").alias("of")), "key")
    central = sized.groupBy("sig").agg(F.sum("of").alias("central"))
    live = cut(sized.join(central, "sig").select("key", "sig", "n", F.lit(0).alias("held"), F.col("n").alias("more"), "central", F.lit(0).alias("parent"), F.col("sig").alias("comp"), F.lit(1).alias("same"), "of"))
    comp = None
    limits = near.small, near.pivots
    while not live.isEmpty():
        pivots = chosen(live, *limits)
        star = cut(stars(live, pivots))
        tidy(docs)
        sims = cut(compared(candidates(live, pivots, star, near), sets, near, few=comp is not None))
        comp = merged(comp, similar(sims, near))
        tidy(docs)
        if star.isEmpty():
            break
        live = live_buckets(cut(apart(star, sims, comp, near)), comp)
        tidy(docs)
        limits = near.late, near.late
    return comp if comp is not None else docs.sparkSession.createDataFrame([], "sig long, comp long")


def labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows with the component of their sig, which is its own if it has no links."""
    return met(rows.drop("comp"), comp, "sig", "left").withColumn("comp", F.coalesce("comp", "sig"))


def live_buckets(buckets: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components; `same`: rows of its component there, `of`: rows of the bucket."""
    now = labelled(buckets, comp)
    per = now.groupBy("key", "comp").agg(F.count("*").alias("same"))
    several = per.groupBy("key").agg(F.count("*").alias("comps"), F.sum("same").alias("of")).where("comps > 1").select("key", "of")
    return cut(met(now, met(per, several, "key"), ["key", "comp"]))


def chosen(live: DataFrame, small: int, most: int) -> DataFrame:
    """The pivots of each bucket, in order: all of a bucket of up to `small`, `most` of a larger one.

    The limit on the rank reaches the rows before they are shuffled, so a hot bucket doesn't meet in one task.
    """
    rank = F.row_number().over(W.partitionBy("key").orderBy("same", F.desc("central"), "sig"))
    top = live.withColumn("rank", rank).where(F.col("rank") <= max(small, most)).where((F.col("of") <= small) | (F.col("rank") <= most))
    return cut(top.select("key", "rank", F.col("sig").alias("hub"), F.col("comp").alias("hub_comp"), F.col("n").alias("hub_n"), F.col("held").alias("hub_held"), F.col("more").alias("hub_more")))


def stars(live: DataFrame, pivots: DataFrame) -> DataFrame:
    """g, hub, sig, n, central: rows of large buckets that aren't pivots, beside the first pivot.

    Buckets that come from one star and have the same first pivot are one star. It has fewer rows than the one it comes from.
    """
    own = pivots.select("key", F.col("hub").alias("sig"))
    rest = met(live, own, ["key", "sig"], "left_anti")
    return met(rest, pivots.where("rank = 1"), "key").where("sig <> hub").select(F.xxhash64("parent", "hub").alias("g"), "hub", "sig", "n", "central").distinct()


def candidates(live: DataFrame, pivots: DataFrame, star: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b) to compare: pivots with rows of other components that can be similar, and all of a star."""
    bound = F.least("held", "hub_held") + F.least("more", "hub_more")
    fit = (100 + near.percent) * bound >= near.percent * (F.col("n") + F.col("hub_n"))
    new = met(live, pivots, "key").where((F.col("comp") != F.col("hub_comp")) & fit).select("hub", "sig", F.lit(False).alias("want"))
    both = new.union(star.select("hub", "sig", F.lit(True)))
    small_first = F.col("hub") < F.col("sig")
    pairs = both.select(F.least("hub", "sig").alias("a"), F.greatest("hub", "sig").alias("b"), (F.col("want") & ~small_first).alias("want_a"), (F.col("want") & small_first).alias("want_b"))
    return cut(pairs.groupBy("a", "b").agg(F.bool_or("want_a").alias("want_a"), F.bool_or("want_b").alias("want_b")))


def apart(star: DataFrame, sims: DataFrame, comp: DataFrame, near: Near) -> DataFrame:
    """Buckets of the next round: rows of a star that aren't in its largest component, and what they could be similar to."""
    seen = met(star.withColumn("a", F.least("hub", "sig")).withColumn("b", F.greatest("hub", "sig")), sims.select("a", "b", "shared", "rest_a", "rest_b"), ["a", "b"])
    seen = labelled(seen.select("g", "sig", "n", "central", "shared", F.when(F.col("sig") == F.col("a"), F.col("rest_a")).otherwise(F.col("rest_b")).alias("rest")), comp)
    per = seen.groupBy("g", "comp").agg(F.count("*").alias("c")).groupBy("g").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp"))["comp"].alias("main")).where("comps > 1")
    rows = cut(met(seen, per.select("g", "main"), "g").withColumn("out", F.col("comp") != F.col("main")))
    shape = ["key", "g", "sig", "n", "out", "shared", "more", "central"]

    # they share a shingle beyond the hub: `more` of a row's are in rows of several components, rare ones come first
    beyond = rows.select("*", F.explode("rest").alias("q")).drop("rest")
    common = beyond.groupBy("g", "q").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("g", "q", "df")
    row = W.partitionBy("g", "sig")
    beyond = met(beyond, common, ["g", "q"]).withColumn("more", F.count("*").over(row)).withColumn("at", F.row_number().over(row.orderBy("df", "q")))
    must = F.greatest(F.ceil(F.col("n") * F.lit(near.percent) / 100) - F.col("shared"), F.lit(1))
    beyond = beyond.where(F.col("at") <= F.col("more") - must + 1).withColumn("key", F.xxhash64("g", "q")).select(*shape)

    # all they share is in the hub
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / near.percent) + 1e-9)
    inside = rows.where(100 * F.col("shared") >= near.percent * F.col("n")).withColumn("band", F.explode(F.array(band, band + 1)))
    inside = inside.withColumn("key", F.xxhash64("g", F.lit("inside"), "band")).withColumn("more", F.lit(0).cast("long")).select(*shape)

    # no row similar to one is larger than its room
    new = beyond.union(inside).withColumn("room", F.floor((F.col("shared") + F.col("more")) * (100 + near.percent) / near.percent) - F.col("n"))
    new = met(new, new.groupBy("key").agg(F.min("n").alias("least")), "key").where("room >= least")
    limits = new.where("out").groupBy("key").agg(F.min("n").alias("open_n"), F.max("room").alias("open_room"))
    new = cut(met(new, limits, "key").where("out or n <= open_room and room >= open_n").select(*shape))

    # equal buckets of a star become one, named by their rows; a star has a row once, and its shingles differ
    named = new.groupBy("key", "g").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("sig", "more")).alias("x")).where("c > 1").select(F.col("key").alias("old"), F.xxhash64("g", "c", "x").alias("key"))
    both = met(new.withColumnRenamed("key", "old"), named, "old")
    return both.select("key", "sig", "n", F.col("shared").alias("held"), "more", "central", F.col("g").alias("parent")).distinct()
