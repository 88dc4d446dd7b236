"""Spelling variants: words one edit apart, found in dense tiles of code points.

Words are written as rows of two padded matrices of code points, one aligned left and one right. For a pair, the common
prefix p and the common suffix s are the leading runs of equal cells; words that differ are one insertion, deletion or
replacement apart exactly if their lengths differ by at most one and p + s is at least the longer length less one.

Which tiles can hold such pairs: with m = longer length - 1, either the first m // 2 code points agree or the last
m - m // 2 do. So words meet in a bucket of equal longer length and equal beginning, or equal ending; a pair that has
both is taken from the first only. A bucket of many words is cut into blocks, and tiles are pairs of blocks, so that no
task holds a bucket and none of its pairs is left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

ship(__name__)

RUN = re.compile(r"[a-zÀ-ÿ]+")
#: Words are added up in a task until it knows so many, then sent on.
KNOWN = 200_000
#: Words of a block, and the cells of matrices that a task compares at once.
BLOCK, CELLS = 256, 4_000_000


@dataclass(frozen=True)
class Variants:
    """least: code points of a word; often: its occurrences; ratio: how much more often its form is; drop: of hashes of
    id and word, those it divides lose a code point (0: none do)."""

    least: int = 5
    often: int = 3
    ratio: int = 2
    drop: int = 0


def words_of(text: str | None, doc_id: object, v: Variants) -> Iterator[tuple[str, int]]:
    """Distinct words with their counts, A-Z in lower case."""
    found = Counter(RUN.findall((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    if not v.drop:
        yield from found.items()
        return
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in found.items():
        h = zlib.crc32(w.encode(), start)
        if h % v.drop == 0:
            i = h % len(w)
            w = w[:i] + w[i + 1 :]
        yield w, n


def vocabulary(docs: DataFrame, v: Variants) -> DataFrame:
    """word, n: words of the whole texts of docs (doc_id, text) that are long and frequent enough."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(known.keys(), pa.string()), pa.array(known.values(), pa.int64())], ["word", "n"])
            known.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                for w, n in words_of(text.as_py(), doc_id.as_py(), v):
                    if len(w) >= v.least:
                        known[w] += n
                if len(known) > KNOWN:
                    yield flush()
        yield flush()

    counts = docs.select("doc_id", "text").mapInArrow(each, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= v.often)


def padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and code points aligned left and right; empty cells are 0."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = int(lens.max(initial=1))
    at = np.arange(wide)[None, :]
    left, right = np.zeros((len(words), wide), np.uint32), np.zeros((len(words), wide), np.uint32)
    left[at < lens[:, None]] = flat
    right[at >= wide - lens[:, None]] = flat
    return lens, left, right


def run_length(equal: np.ndarray) -> np.ndarray:
    """Leading true cells of each row."""
    return np.where(equal.all(axis=1), equal.shape[1], equal.argmin(axis=1))


def single_edits(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], longer: np.ndarray, ending: np.ndarray) -> np.ndarray:
    """Which rows of a and b are one edit apart, belong to buckets of this longer length, and aren't the other bucket's."""
    (la, lefta, righta), (lb, leftb, rightb) = a, b
    top = np.maximum(la, lb)
    fit = (top == longer) & (np.abs(la - lb) <= 1)
    low = np.minimum(la, lb)
    p = np.minimum(run_length(lefta == leftb), low)
    s = np.minimum(run_length(righta[:, ::-1] == rightb[:, ::-1]), low)
    same = (la == lb) & (p == la)
    return fit & ~same & (p + s >= top - 1) & (~ending | (p < (top - 1) // 2))


def tiles(blocks: DataFrame) -> DataFrame:
    """word, n, other, other_n: pairs one edit apart, both ways, of tiles (longer, ending, same, a, an, b, bn)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longer, ending, same = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            sizes = [np.asarray(batch.column(i).value_lengths()) for i in (3, 5)]
            words = [batch.column(i).flatten().to_pylist() for i in (3, 5)]
            counts = [np.asarray(batch.column(i).flatten()) for i in (4, 6)]
            starts = [np.cumsum(x) - x for x in sizes]
            first, t = 0, sizes[0] * sizes[1]
            width = max(map(len, words[0] + words[1]), default=1)
            while first < len(t):  # as many tiles at once as fit into CELLS
                last = max(first + 1, int(np.searchsorted(np.cumsum(t[first:]) * width, CELLS, "right")) + first)
                many = t[first:last]
                tile = np.repeat(np.arange(first, last), many)
                k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                i, j = starts[0][tile] + k // sizes[1][tile], starts[1][tile] + k % sizes[1][tile]
                # a block beside itself: each pair once
                keep = ~same[tile] | (k // sizes[1][tile] < k % sizes[1][tile])
                tile, i, j = tile[keep], i[keep], j[keep]
                low = [starts[x][first] for x in (0, 1)]
                high = [low[x] + int(sizes[x][first:last].sum()) for x in (0, 1)]
                a, b = words[0][low[0] : high[0]], words[1][low[1] : high[1]]
                lens, left, right = padded(a + b)
                pick = lambda at: (lens[at], left[at], right[at])  # noqa: E731, B023
                hit = single_edits(pick(i - low[0]), pick(j - low[1] + len(a)), longer[tile], ending[tile])
                i, j = i[hit], j[hit]
                wa, wb = [words[0][x] for x in i], [words[1][x] for x in j]
                na, nb = counts[0][i], counts[1][j]
                yield pa.RecordBatch.from_arrays([pa.array(wa + wb, pa.string()), pa.array(np.concatenate([na, nb])), pa.array(wb + wa, pa.string()), pa.array(np.concatenate([nb, na]))], ["word", "n", "other", "other_n"])
                first = last

    return blocks.select("longer", "ending", "same", "a", "an", "b", "bn").mapInArrow(each, "word string, n long, other string, other_n long")


def near_pairs(vocab: DataFrame) -> DataFrame:
    """word, n, other, other_n: every two words of vocab (word, n; one row a word) that are one edit apart, both ways."""
    size, half = F.char_length("word"), F.floor((F.col("longer") - 1) / 2).cast("int")
    sides = vocab.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("ending"))
    part = F.when(F.col("ending"), F.expr("right(word, longer - 1 - cast(floor((longer - 1) / 2) as int))")).otherwise(F.substring("word", F.lit(1), half))
    entries = sides.select("word", "n", "longer", "ending", part.alias("part"))
    key = ["longer", "ending", "part"]
    # words of one length only meet those of that length or one less: a bucket without the longer ones has no pairs
    sizes = entries.groupBy(*key).agg(F.count("*").alias("of"), F.count_if(F.char_length("word") == F.col("longer")).alias("long")).where("of > 1 and long > 0")
    dealt = entries.join(sizes.select(*key, F.ceil(F.col("of") / BLOCK).cast("int").alias("blocks")), key)
    block = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")).groupBy(*key, "blocks", "block")
    blocks = cut(block.agg(F.collect_list(F.struct("word", "n")).alias("w")))
    whole = blocks.select("longer", "ending", F.lit(True).alias("same"), F.col("w").alias("wa"), F.col("w").alias("wb"))
    more = blocks.where("blocks > 1")
    other = more.select(*key, F.col("block").alias("block2"), F.col("w").alias("wb"))
    across = more.withColumnRenamed("w", "wa").join(other, key).where("block < block2").select("longer", "ending", F.lit(False).alias("same"), "wa", "wb")
    pairs = whole.union(across)
    return tiles(pairs.select("longer", "ending", "same", F.col("wa.word").alias("a"), F.col("wa.n").alias("an"), F.col("wb.word").alias("b"), F.col("wb.n").alias("bn")))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form; one row a word) lead in the end. Paths double a round; they can't be circles."""
    at = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, v: Variants = Variants()) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of docs (doc_id, text).

    A word's form is its near word of largest n (the smallest in code-point order of equals) if that is at least v.ratio
    times its own; root follows forms to the last. Null and empty texts have no words; a null doc_id counts as empty in
    the hash that drops code points; repeated rows count each. Words of any length are whole, and no number of near
    words is a limit. An empty table gives an empty result. Other columns are ignored.
    """
    vocab = cut(vocabulary(docs, v))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("w")))
    near = near_pairs(vocab).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.n") >= v.ratio * F.col("n")
    near = cut(near.select("word", "n_near", F.when(is_form, F.col("best.w")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")))
    end = roots(near.where("form is not null").select("word", "form"))
    out = vocab.join(near, "word", "left").join(end, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
