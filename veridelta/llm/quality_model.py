"""Quality classifier: a convolutional network over bytes, trained and applied with numpy.

Learned filters slide over the bytes of the whole document in chunks, each of which takes along the bytes that its last
positions need from the next one. Each filter's maximum in a chunk is kept. Means and maxima over the chunks go through a
small hidden layer into one probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

PAD = 256


@dataclass(frozen=True)
class Net:
    """chunk: positions in a chunk; width: bytes under a filter. sample_docs: labelled documents that are learned from at
    most, chosen by hash; sample_bytes: longest document among them (longer ones are scored all the same)."""

    filters: int = 16
    width: int = 8
    depth: int = 6
    hidden: int = 8
    chunk: int = 512
    epochs: int = 14
    batch: int = 32
    rate: float = 0.01
    seed: int = 1
    sample_docs: int = 2400
    sample_bytes: int = 16_384


def to_bytes(text: str | None, net: Net) -> np.ndarray:
    """Byte values with padding: whole chunks, and the bytes under the filters at the end. At least one chunk."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.full(max(1, -(-len(raw) // net.chunk)) * net.chunk + net.width - 1, PAD, np.int32)
    out[: len(raw)] = raw
    return out


def start(net: Net) -> dict[str, np.ndarray]:
    r = np.random.default_rng(net.seed)
    make = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
    emb = make(257, net.depth, scale=0.5)
    emb[PAD] = 0
    return {"emb": emb, "w": make(net.width, net.depth, net.filters, scale=0.25), "b": np.zeros(net.filters, np.float32), "u": make(2 * net.filters, net.hidden, scale=0.2), "c": np.zeros(net.hidden, np.float32), "v": make(net.hidden, scale=0.3), "d": np.zeros(1, np.float32)}


def tables(p: dict[str, np.ndarray]) -> np.ndarray:
    """What each byte adds to each filter at each place under it: the embedding and the filter multiplied out."""
    return np.ascontiguousarray(np.einsum("be,kef->kbf", p["emb"], p["w"]), dtype=np.float32)


def convolve(x: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Filters by position: sums of table rows."""
    n = len(x) - len(table) + 1
    out = table[0].take(x[:n], axis=0)
    out += bias
    for k in range(1, len(table)):
        out += table[k].take(x[k : k + n], axis=0)
    return out


def head(p: dict[str, np.ndarray], feats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.maximum(feats @ p["u"] + p["c"], 0)
    return h, 1 / (1 + np.exp(-np.clip(h @ p["v"] + p["d"][0], -30, 30)))


def train(texts: list[str | None], y: np.ndarray, net: Net) -> dict[str, np.ndarray]:
    """Adam on the cross-entropy. Gradients pass through each chunk's maximum only."""
    p = start(net)
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    r, step = np.random.default_rng(net.seed + 1), 0
    coded = [to_bytes(t, net) for t in texts]
    k_at = np.arange(net.width)
    for epoch in range(net.epochs):
        order = r.permutation(len(coded))
        for at in range(0, len(order), net.batch):
            rows = order[at : at + net.batch]
            table = tables(p)
            tops, windows, feats, arg, sizes = [], [], [], [], []
            for i in rows:
                x = coded[i]
                a = np.maximum(convolve(x, table, p["b"]), 0).reshape(-1, net.chunk, net.filters)
                best = a.argmax(1)
                top = np.take_along_axis(a, best[:, None], 1)[:, 0]
                pos = best + np.arange(len(a))[:, None] * net.chunk
                tops.append(top)
                windows.append(x[pos[:, :, None] + k_at])
                feats.append(np.concatenate([top.mean(0), top.max(0)]))
                arg.append(top.argmax(0))
                sizes.append(len(a))
            f = np.array(feats)
            h, q = head(p, f)
            dz = ((q - y[rows]) / len(rows)).astype(np.float32)
            g = {"v": h.T @ dz, "d": np.array([dz.sum()], np.float32)}
            dh = np.outer(dz, p["v"]) * (h > 0)
            g["u"], g["c"] = f.T @ dh, dh.sum(0)
            df = dh @ p["u"].T
            dtop = []
            for i, n in enumerate(sizes):
                d = np.tile(df[i, : net.filters] / n, (n, 1))
                d[arg[i], np.arange(net.filters)] += df[i, net.filters :]
                dtop.append(d)
            dt = np.concatenate(dtop) * (np.concatenate(tops) > 0)
            win = np.concatenate(windows)
            g["b"] = dt.sum(0)
            g["w"] = np.einsum("cf,cfke->kef", dt, p["emb"][win], optimize=True)
            g["emb"] = np.zeros_like(p["emb"])
            np.add.at(g["emb"], win.ravel(), np.einsum("cf,kef->cfke", dt, p["w"], optimize=True).reshape(-1, net.depth))
            g["emb"][PAD] = 0
            step += 1
            lr = net.rate * (1 - 0.9 * epoch / net.epochs)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.99 * s[k] + 0.01 * g[k] ** 2
                p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return p


def score(text: str | None, p: dict[str, np.ndarray], table: np.ndarray, net: Net) -> float:
    """The probability of label 1 for a whole text; memory stays bounded for long ones."""
    x = to_bytes(text, net)
    block = 64 * net.chunk
    tops = [np.maximum(convolve(x[at : at + block + net.width - 1], table, p["b"]), 0).reshape(-1, net.chunk, net.filters).max(1) for at in range(0, len(x) - net.width + 1, block)]
    top = np.concatenate(tops)
    return float(head(p, np.concatenate([top.mean(0), top.max(0)])[None])[1][0])


def held_out(doc_id: str | Column) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, net: Net = Net()) -> dict[str, np.ndarray]:
    """Learns from labelled rows that aren't held out; of contradicting labels of a document the lower counts.

    A doc_id gives one text, of several that with the smallest hash, so that no more than net.sample_docs of at most
    net.sample_bytes come to the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(net.sample_docs)
    short = docs.select("doc_id", "text").where(F.octet_length(F.coalesce("text", F.lit(""))) <= net.sample_bytes)
    one = F.min(F.struct(F.md5(F.coalesce("text", F.lit(""))).alias("hash"), "text", "quality")).alias("r")
    got = short.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "r.text", "r.quality").collect()
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text or ""))
    return train([r.text for r in got], np.array([r.quality for r in got], np.float32), net)


def scored(docs: DataFrame, p: dict[str, np.ndarray], net: Net = Net()) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text).

    Null and empty texts are scored as padding alone, so each row has a score. A null doc_id is carried. Rows may repeat;
    an empty table gives an empty result. Other columns are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tables(p)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([score(t.as_py(), p, table, net) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
