"""Near-duplicate vectors: an exact range join of angles by pivots.

Equal vectors form one class, and classes are compared. A cell of many classes takes some of them as pivots, no two
closer than half the range, and gives each class to its nearest pivot. By the triangle inequality

- classes within half the range of their pivot are all linked with each other: they are the pivot's core, a cell of its
  own in which nothing needs to be compared;
- the others are the pivot's ring. A class can only be linked with members of a core or ring whose distances from the
  pivot differ from its own by at most the range, and whose pivot isn't farther than its own by more than twice that.

A class is replicated to the cells that it can reach so, of two cells to that with the smaller number, and each cell is
then joined by itself: its own classes with each other and with those that were sent to it. Cells that are still large
are split again. Rings are only made if they leave clearly fewer pairs: where all distances are alike, as those of
random vectors in many dimensions, every class reaches every ring, so the rings stay together as one cell. Which of
both a cell does follows from counts of all its rows.

A cell is compared in pairs of blocks of bounded size, one row each, so that a hot cell is spread over many tasks. A pair
of blocks gives the number of links of each class and a tree of links for each of its components, not the links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, join_small, ship
from .near_dedup import BROADCAST_KEYS, components

ship(__name__)

#: For bounds, which are floating: a range of so much more is searched, and a core is so much smaller.
SLACK = 1e-6
TILE = 512
#: Tables of pivots, of some ten thousand bytes a row, are broadcast up to so many rows.
BROADCAST_CELLS = 500


@dataclass(frozen=True)
class Near:
    """least: cosine of a link; cell: classes that a cell may have without being split; pivots a split cell draws; block:
    classes of a block; gain: rings may leave at most this share of the pairs."""

    least: float = 0.95
    cell: int = 4096
    pivots: int = 128
    block: int = 4096
    gain: float = 0.5

    @property
    def reach(self) -> float:
        return math.acos(self.least)


def unit(members: pa.Array) -> np.ndarray:
    """Vectors of length 1, as rows."""
    x = np.asarray(members.flatten(), np.float64).reshape(len(members), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def spread_out(x: np.ndarray, near: Near) -> np.ndarray:
    """Numbers of the rows that are farther than half the range from all that were taken before."""
    a, taken = angles(x, x), []
    for i in range(len(x)):
        if all(a[i, j] > near.reach / 2 for j in taken):
            taken.append(i)
    return np.array(taken, np.int64)


def homes(a: np.ndarray, near: Near) -> np.ndarray:
    """Each row's own child from its angles: j the core of pivot j, and for p pivots p + j its ring."""
    j = a.argmin(axis=1)
    return np.where(a[np.arange(len(a)), j] <= near.reach / 2 - SLACK, j, a.shape[1] + j)


def reached(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, near: Near) -> np.ndarray:
    """Which children a row can have links in; lo and hi: least and greatest angle of each child's rows, by child."""
    r = near.reach + SLACK
    nearest = a.min(axis=1)[:, None] + 2 * r
    both = np.concatenate([a, a], axis=1)
    return (both <= nearest) & (both >= lo - r) & (both <= hi + r)


def valid(vec: str) -> F.Column:
    c = F.col(vec)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return c.isNotNull() & fine & F.exists(c, lambda x: x != 0)


def classes_of(rows: DataFrame) -> DataFrame:
    """One row for each different vector: its hash k, cid, copies, rep (smallest vec_id) and vec."""
    known = rows.where("k is not null").groupBy("k").agg(F.first("vec").alias("vec"), F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    return cut(known.withColumn("cid", F.monotonically_increasing_id()))


def blocked(live: DataFrame, near: Near) -> DataFrame:
    """Rows (cell, core, home, cid, copies, vec) gathered in blocks: cell, core, homes (rows that are at home), of_home and
    of_other (blocks), home, block, members."""
    per = cut(live.groupBy("cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("others")).where("homes > 0"))
    parts = lambda c: F.ceil(F.col(c) / near.block).cast("int")
    per = per.select("cell", "homes", parts("homes").alias("of_home"), parts("others").alias("of_other"))
    dealt = join_small(live, per, ["cell"], "inner", BROADCAST_KEYS)
    block = F.pmod(F.xxhash64("cid"), F.when(F.col("home"), F.col("of_home")).otherwise(F.col("of_other"))).cast("int")
    whole = dealt.withColumn("block", block).groupBy("cell", "core", "homes", "of_home", "of_other", "home", "block")
    return cut(whole.agg(F.collect_list(F.struct("cid", "copies", "vec")).alias("members")))


def pivots_of(big: DataFrame, near: Near) -> DataFrame:
    """cell, pivots: of each cell near.pivots classes by hash, without those too close to one before."""
    rows = big.where("home").select("cell", F.explode("members").alias("m")).select("cell", "m.cid", "m.vec")
    order = F.row_number().over(W.partitionBy("cell").orderBy(F.xxhash64("cell", "cid"), "cid"))
    drawn = rows.withColumn("i", order).where(F.col("i") <= near.pivots).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("i", "vec")))["vec"].alias("pivots"))
    kind = drawn.schema["pivots"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [p.values.take(pa.array(spread_out(unit(p.values), near))) for p in b.column(1)]
            offsets = pa.array(np.cumsum([0, *map(len, kept)]), pa.int32())
            values = pa.concat_arrays(kept) if kept else b.column(1).flatten()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, values)], ["cell", "pivots"])

    return cut(drawn.mapInArrow(each, f"cell long, pivots {kind}"))


def with_cells(big: DataFrame, cells: DataFrame) -> DataFrame:
    """Blocks beside what is known about their cell."""
    return join_small(big, cells, ["cell"], "inner", BROADCAST_CELLS)


def radii(big: DataFrame, pivots: DataFrame, near: Near) -> DataFrame:
    """cell, pivots, lo and hi: least and greatest angle of each child's own rows (beyond any angle if it has none), and n, their number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for cell, members, piv in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                a = angles(unit(members.values.field("vec")), unit(piv.values))
                own, low = homes(a, near), a.min(axis=1)
                for c in np.unique(own):
                    out.append((cell, int(c), int((own == c).sum()), float(low[own == c].min()), float(low[own == c].max())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64()])], ["cell", "child", "n", "lo", "hi"])

    blocks = with_cells(big.where("home").select("cell", "members"), pivots).select("cell", "members", "pivots")
    per = blocks.mapInArrow(each, "cell long, child int, n long, lo double, hi double").groupBy("cell", "child").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    known = per.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("child", F.struct("n", "lo", "hi")))).alias("m"))
    kids = F.sequence(F.lit(0), 2 * F.size("pivots") - 1)
    get = lambda f, other: F.transform(kids, lambda i: F.coalesce(F.col("m")[i][f], F.lit(other)))
    return cut(pivots.join(known, "cell").select("cell", "pivots", get("n", 0).cast("array<long>").alias("n"), get("lo", 99.0).alias("lo"), get("hi", -99.0).alias("hi")))


def sent(members: pa.Array, piv: pa.Array, lo: pa.Array, hi: pa.Array, home: bool, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Own child of each row of a block (-1 if it is not at home), and whether it goes to each child as a visitor."""
    a = angles(unit(members.field("vec")), unit(piv))
    to = reached(a, np.asarray(lo, np.float64), np.asarray(hi, np.float64), near)
    if not home:
        return np.full(len(a), -1), to
    own = homes(a, near)
    return own, to & (np.arange(to.shape[1])[None, :] < own[:, None])


def planned(big: DataFrame, cells: DataFrame, near: Near, first: bool) -> DataFrame:
    """cells with `mode`: rings, rest (cores only, all rings as one cell) or null, if splitting doesn't pay."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kids, n = [], [], []
            for i, cell in enumerate(b.column(0).to_pylist()):
                _, to = sent(b.column(2)[i].values, b.column(3)[i].values, b.column(4)[i].values, b.column(5)[i].values, b.column(1)[i].as_py(), near)
                found = to.sum(axis=0)
                for c in np.flatnonzero(found):
                    ids.append(cell), kids.append(int(c)), n.append(int(found[c]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kids, pa.int32()), pa.array(n, pa.int64())], ["cell", "child", "visitors"])

    blocks = with_cells(big.select("cell", "home", "members"), cells.drop("n")).select("cell", "home", "members", "pivots", "lo", "hi")
    visits = blocks.mapInArrow(each, "cell long, child int, visitors long").groupBy("cell", "child").agg(F.sum("visitors").cast("double").alias("visitors"))
    own = cells.select("cell", F.size("pivots").alias("p"), F.posexplode("n").alias("child", "n"))
    ring, n = F.col("child") >= F.col("p"), F.col("n").cast("double")
    kids = own.join(visits, ["cell", "child"], "left").withColumn("visitors", F.coalesce("visitors", F.lit(0.0)))
    others = big.where("not home").groupBy("cell").agg(F.sum(F.size("members")).cast("double").alias("others"))
    cost = kids.groupBy("cell").agg(
        F.sum(F.when(~ring, n * F.col("visitors")).otherwise(0.0)).alias("cores"),
        F.sum(F.when(ring, n * (n - 1) / 2 + n * F.col("visitors")).otherwise(0.0)).alias("rings"),
        F.sum(F.when(ring, n).otherwise(0.0)).alias("left"),
        F.sum(n).alias("h"),
    ).join(others, "cell", "left").withColumn("others", F.coalesce("others", F.lit(0.0)))
    rest = F.col("left") * (F.col("left") - 1) / 2 + F.col("left") * F.col("others")
    before = F.col("h") * (F.col("h") - 1) / 2 + F.col("h") * F.col("others")
    mode = F.when((F.col("rings") <= near.gain * rest) & (F.col("cores") + F.col("rings") <= near.gain * before), "rings")
    mode = mode.when(F.lit(first) | (F.col("cores") + rest <= near.gain * before), "rest")
    return cut(cells.join(cost.select("cell", mode.alias("mode")), "cell"))


def children(big: DataFrame, cells: DataFrame, near: Near) -> DataFrame:
    """Rows (cell, core, home, cid, copies, vec) of the cells that big ones are split into."""
    kind = big.schema["members"].dataType.elementType["vec"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, cell in enumerate(b.column(0).to_pylist()):
                members, piv = b.column(2)[i].values, b.column(3)[i].values
                own, to = sent(members, piv, b.column(4)[i].values, b.column(5)[i].values, b.column(1)[i].as_py(), near)
                p = len(piv)
                if b.column(6)[i].as_py() == "rest":
                    own = np.where(own >= p, p, own)
                    others = to[:, p:].any(axis=1) & (own < 0)
                    to = np.concatenate([to[:, :p], others[:, None]], axis=1)
                at, kid = np.nonzero(to)
                mine = np.flatnonzero(own >= 0)
                rows, kid = np.concatenate([mine, at]), np.concatenate([own[mine], kid])
                picked = members.take(pa.array(rows))
                home = np.arange(len(rows)) < len(mine)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), cell), pa.int64()), pa.array(kid, pa.int32()), pa.array(kid < p), pa.array(home), picked.field("cid"), picked.field("copies"), picked.field("vec")], ["parent", "child", "core", "home", "cid", "copies", "vec"])

    blocks = with_cells(big.select("cell", "home", "members"), cells.drop("n")).select("cell", "home", "members", "pivots", "lo", "hi", "mode")
    out = blocks.mapInArrow(each, f"parent long, child int, core boolean, home boolean, cid long, copies long, vec {kind}")
    return out.select(F.xxhash64("parent", "child").alias("cell"), "core", "home", "cid", "copies", "vec")


def tree(hits: list[tuple[int, np.ndarray]], wide: int, a: np.ndarray, b: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that links reach, for the rows of both blocks; hits: packed rows of links from a row number on."""
    la, lb = a.copy(), a if same else b.copy()
    lb = la if same else lb
    top = np.iinfo(np.int64).max
    while True:
        before = la.sum() + (0 if same else lb.sum())
        for at, bits in hits:
            hit = np.unpackbits(bits, axis=1, count=wide).astype(bool)
            part = slice(at, at + len(hit))
            la[part] = np.minimum(la[part], np.where(hit, lb[None, :], top).min(axis=1))
            np.minimum(lb, np.where(hit, la[part, None], top).min(axis=0), out=lb)
        if la.sum() + (0 if same else lb.sum()) == before:
            return la, lb


def compared(pairs: DataFrame, near: Near) -> DataFrame:
    """cid, n (vectors of the other block it is linked with), root (a class it is connected with) of pairs of blocks (a, b; b null: a itself)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1)):
                same = not two.is_valid
                a, b = one.values, one.values if same else two.values
                x, y = unit(a.field("vec")), unit(b.field("vec"))
                ca, cb = np.asarray(a.field("copies")), np.asarray(b.field("copies"))
                na, nb, hits = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), []
                for at in range(0, len(x), TILE):
                    hit = x[at : at + TILE] @ y.T >= near.least
                    if same:
                        hit[np.arange(len(hit)), at + np.arange(len(hit))] = False
                    if hit.any():
                        na[at : at + TILE] = hit @ cb
                        nb += ca[at : at + TILE] @ hit
                        hits.append((at, np.packbits(hit, axis=1)))
                if not hits:
                    continue
                ida, idb = np.asarray(a.field("cid")), np.asarray(b.field("cid"))
                ra, rb = tree(hits, len(y), ida, idb, same)
                sides = [(ida, na, ra)] if same else [(ida, na, ra), (idb, nb, rb)]
                cols = [np.concatenate([s[i][s[1] > 0] for s in sides]) for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["cid", "n", "root"])

    return pairs.select("a", "b").mapInArrow(each, "cid long, n long, root long")


def joined(blocks: DataFrame, near: Near) -> DataFrame:
    """Links of final cells, as compared() gives them."""
    till = lambda lo, n: F.when(n > lo, F.sequence(lo, n - 1)).otherwise(F.array().cast("array<int>"))
    home, key = blocks.where("home"), ["cell", "visit", "i", "j"]
    zero = F.lit(0)
    left = home.select("cell", F.col("block").alias("i"), F.col("members").alias("a"), F.explode(F.concat(
        F.when(F.col("core"), F.array().cast("array<struct<visit:boolean,j:int>>")).otherwise(F.transform(till(F.col("block"), F.col("of_home")), lambda j: F.struct(F.lit(False).alias("visit"), j.alias("j")))),
        F.transform(till(zero, F.col("of_other")), lambda j: F.struct(F.lit(True).alias("visit"), j.alias("j"))),
    )).alias("to")).select("cell", "to.visit", "i", "to.j", "a")
    right = blocks.where("not home").select("cell", F.lit(True).alias("visit"), F.explode(till(zero, F.col("of_home"))).alias("i"), F.col("block").alias("j"), F.col("members").alias("b"))
    right = right.union(home.where("not core").select("cell", F.lit(False), F.explode(till(zero, F.col("block"))), "block", "members"))
    # a block beside itself has no right side; a visiting block without members neither, and isn't a pair
    pairs = left.join(right, key, "left").where("b is not null or (not visit and i = j)")
    links = compared(pairs, near)
    rows = home.where("core").select("cell", F.explode("members").alias("m")).select("cell", "m.cid", "m.copies")
    core = rows.groupBy("cell").agg(F.sum("copies").alias("all"), F.min("cid").alias("root"))
    inside = join_small(rows, cut(core), ["cell"], "inner", BROADCAST_KEYS).select("cid", (F.col("all") - F.col("copies")).alias("n"), "root")
    return links.union(inside)


def near_vectors(vectors: DataFrame, near: Near = Near()) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding).

    n_links: other rows whose cosine with it is near.least or more; component_id: the smallest vec_id that links reach;
    kept: whether it is the row's own. Nulls: a vector that is null, empty or zero, or holds null or non-finite
    components, is linked with nothing; a row without vec_id takes part, but its component is named by other rows, and if
    there is none it is null. Vectors of different length aren't linked. Repeated rows are linked with each other like
    any others and are judged one by one. An empty table gives an empty result. Other columns are ignored.
    """
    vec = F.col("embedding")
    rows = vectors.select("vec_id", F.when(valid("embedding"), F.struct(F.xxhash64(vec), F.xxhash64(F.lit("again"), vec))).alias("k"), vec.alias("vec"))
    known = classes_of(rows)
    live = known.select(F.size("vec").cast("long").alias("cell"), F.lit(False).alias("core"), F.lit(True).alias("home"), "cid", "copies", "vec")
    found, first = None, True
    while True:
        blocks = blocked(live, near)
        big = blocks.where((F.col("homes") > near.cell) & ~F.col("core"))
        small = blocks.where((F.col("homes") <= near.cell) | F.col("core"))
        if not big.isEmpty():
            cells = planned(big, radii(big, pivots_of(big, near), near), near, first)
            split = cells.where("mode is not null")
            stuck = join_small(big, cut(cells.where("mode is null").select("cell")), ["cell"], "inner", BROADCAST_KEYS)
            small = small.unionByName(stuck)
        part = joined(small, near)
        found = part if found is None else found.union(part)
        if big.isEmpty() or split.isEmpty():
            break
        live, first = children(big, cut(split), near), False
    found = cut(found)
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    comp = components(found.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("cid"), "comp")
    named = known.select("k", "cid", "copies", "rep").join(counts, "cid", "left").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    tops = named.groupBy("comp").agg(F.min("rep").alias("top"))
    said = named.join(tops, "comp").where("copies > 1 or n > 0").select("k", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "top")
    out = join_small(rows.select("vec_id", "k"), cut(said.withColumn("linked", F.lit(True))), ["k"], "left", BROADCAST_KEYS)
    component = F.when(F.col("linked"), F.col("top")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
