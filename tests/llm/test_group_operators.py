"""Clusters, spelling variants and near vectors against plain versions, over odd rows and the small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridelta.llm import clustering, metric_join, spelling

SF = "/root/testdata/sf0.001"
NAN = float("nan")


def vectors(spark, rows, kind="double"):
    """With columns named like those of the results."""
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    return df.withColumns({c: F.lit("mine") for c in ("cluster", "k", "cid", "__cell", "__vector", "kept", "cell")}).repartition(3)


# clusters


def brute_clusters(rows, c):
    kept = [(i, [max(-clustering.LIMIT, min(clustering.LIMIT, math.floor(c.scale * x))) for x in v]) for i, v in rows if v is not None and len(v) == c.size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{c.seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(v) for _, v in order[: c.k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(centers))
    for _ in range(c.rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for j, g in groups.items():
            centers[j] = [sum(x) // len(g) for x in zip(*g)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = Counter()
    for _, j, d in found:
        per[j] += d
    return Counter((i, j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for i, j, d in found)


def same_clusters(df, rows, c):
    assert Counter(tuple(r) for r in clustering.clusters(df, c).collect()) == brute_clusters(rows, c)


def test_clusters_small_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    same_clusters(df, [(r.vec_id, r.embedding) for r in df.collect()], clustering.Clusters())


def test_clusters_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, 4) / 256]) for i in range(200)]  # a coarse grid: many ties
    rows += [(7, rows[7][1])] * 5 + [(None, [0.5, 0.5, 0.5, 0.5]), (300, None), (301, []), (302, [1.0, 2.0, 3.0]), (303, [1.0, None, 0.0, 0.0])]
    rows += [(304, [NAN, 0.0, 0.0, 0.0]), (305, [float("inf"), 0.0, 0.0, 0.0]), (306, [1e300, -1e300, 0.0, 0.0])]
    for k in (1, 3, 12, 500):
        same_clusters(vectors(spark, rows), rows, clustering.Clusters(k=k, rounds=3, size=4))


def test_clusters_empty(spark):
    assert clustering.clusters(vectors(spark, [])).count() == 0
    assert clustering.clusters(vectors(spark, [(1, None), (2, [1.0])])).count() == 0


def test_tree_skips_far_points():
    """Best-first search leaves out what the bounds rule out, and finds the same as measuring all."""
    rng = np.random.default_rng(5)
    centers = rng.integers(-10**6, 10**6, (200, 3))
    v = np.repeat(centers, 4, axis=0) + rng.integers(-50, 50, (800, 3))
    who, d, measured = clustering.Tree.of(centers).nearest(v)
    every = ((v[:, None] - centers[None]) ** 2).sum(axis=2)
    assert (who == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert measured < 0.3 * every.size


def test_tree_ties_go_to_the_smaller_number():
    centers = np.array([[0, 0], [4, 0], [0, 0], [4, 0], [2, 2], [2, -2]] * 3)
    v = np.array([[2, 0], [0, 0], [4, 0], [2, 1]])
    who, _, _ = clustering.Tree.of(centers).nearest(v)
    assert who.tolist() == [0, 0, 1, 4]


# spelling


def brute_words(rows, v):
    c = Counter()
    for doc_id, text in rows:
        for m in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in m)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if v.drop and h % v.drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += 1
    return {w: n for w, n in c.items() if len(w) >= v.least and n >= v.often}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_variants(rows, v):
    n = brute_words(rows, v)
    by = defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    near = {w: [x for k in (-1, 0, 1) for x in by[len(w) + k] if x != w and distance(w, x) == 1] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= v.ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


WORDS = "house houses hose horse hoouse Straße strasse Strase straßen naïve naive naivé aaaaa aaaaaa aaaab abcde bcdef abcdf xabcde ÀBCDÉ àbcde".split()


def test_variants_odd_rows(spark):
    rows = [(i, " ".join(w for j, w in enumerate(WORDS) if i % (j % 5 + 1) == 0)) for i in range(40)]
    rows += [(1, rows[1][1])] * 2 + [(None, "House, house; HOUSE 1house2"), (None, None), (99, None), (98, ""), (97, " 123 \n")]
    rows += [(96, "lengthy" * 5000), (95, "lengthy" * 5000), (94, "lengthy" * 4999 + "length"), (93, "word " * 50_000 + "wordy " * 3)] + [(92, "lengthy" * 5000)] * 2
    rows += [(91, "lengthy" * 4999 + "length")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("word", "n", "form", "root", "part", "block")}).repartition(3)
    for v in (spelling.Variants(), spelling.Variants(least=1, often=1, drop=3)):
        got = spelling.variants(df, v).collect()
        want = brute_words(rows, v)
        assert {r.word: r.n for r in got} == want
        short = [r for r in got if len(r.word) < 50]
        assert {tuple(r) for r in short} == {x for x in brute_variants([(d, t) for d, t in rows if not t or "lengthy" not in t], v) if len(x[0]) < 50}
    long = {len(r.word): r for r in spelling.variants(df).collect() if len(r.word) > 50}
    assert long[34_999].n_near == 1 and long[35_000].n_near == 1 and long[34_999].form is None


@pytest.mark.parametrize("block", [1, 3, 256])
def test_pairs_of_any_block(spark, monkeypatch, block):
    """Buckets cut into blocks lose no pair and give none twice."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "CELLS", 500)
    rng = np.random.default_rng(block)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(1, 8))) for _ in range(300)})
    vocab = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    got = Counter((r.word, r.n, r.other, r.other_n) for r in spelling.near_pairs(vocab).collect())
    assert got == Counter((a, i, b, j) for i, a in enumerate(words) for j, b in enumerate(words) if distance(a, b) == 1)


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5"), ("y", "z")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "z" if w == "y" else "w37" for w, _ in chain}


def test_variants_small_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    v = spelling.Variants(drop=97)
    assert {tuple(r) for r in spelling.variants(df, v).collect()} == brute_variants([tuple(r) for r in rows], v)


def test_variants_empty(spark, no_docs):
    assert spelling.variants(no_docs).count() == 0


# near vectors


def brute_near(rows, least=0.95):
    ok = lambda x: bool(x) and all(v is not None and math.isfinite(v) for v in x) and any(x)
    unit = [np.array(x) / np.abs(x).max() if ok(x) else None for _, x in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    n = len(rows)
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least] for i in range(n)]
    comp = [None] * n
    for i in range(n):
        if comp[i] is None:
            todo, group = [i], {i}
            while todo:
                for j in links[todo.pop()]:
                    if j not in group:
                        group.add(j), todo.append(j)
            top = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
            for j in group:
                comp[j] = (top,)
    return Counter((rows[i][0], len(links[i]), comp[i][0], rows[i][0] == comp[i][0]) for i in range(n))


def odd_vectors():
    rng = np.random.default_rng(1)
    rows = []
    for spread, many in ((0.05, 60), (0.25, 80), (0.4, 60), (0.6, 40)):
        c = rng.normal(size=6)
        rows += [c + spread * rng.normal(size=6) for _ in range(many)]
    rows += [rng.normal(size=6) for _ in range(80)] + [rng.normal(size=3) for _ in range(60)]
    rows += [rows[3]] * 30 + [rows[200] * 7, rows[200] * 1e-200, rows[201] * 1e200]  # copies and multiples
    out = [(1000 - i, [float(x) for x in v]) for i, v in enumerate(rows)]
    out += [(3, out[5][1]), (3, out[5][1]), (None, out[90][1]), (None, [9.0]), (None, None)]
    return out + [(-1, None), (-2, []), (-3, [0.0] * 6), (-4, [1.0] * 5 + [None]), (-5, [NAN] * 6), (-6, [float("inf")] + [0.0] * 5)]


@pytest.mark.parametrize("near", [metric_join.Near(), metric_join.Near(cell=40, pivots=12, block=25), metric_join.Near(cell=60, pivots=6, block=16, gain=0.9)])
def test_near_vectors_odd_rows(spark, near):
    rows = odd_vectors()
    assert Counter(tuple(r) for r in metric_join.near_vectors(vectors(spark, rows), near).collect()) == brute_near(rows)


def test_near_vectors_small_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert Counter(tuple(r) for r in metric_join.near_vectors(df).collect()) == brute_near([(r.vec_id, r.embedding) for r in df.collect()])


def test_near_vectors_hot_group_is_a_core(spark):
    """A group within half the range of its pivot is linked without comparing its pairs."""
    rng = np.random.default_rng(2)
    c = rng.normal(size=16)
    rows = [(i, [float(x) for x in c + 0.02 * rng.normal(size=16)]) for i in range(400)] + [(1000 + i, [float(x) for x in rng.normal(size=16)]) for i in range(100)]
    near = metric_join.Near(cell=100, pivots=16, block=100)
    df = vectors(spark, rows)
    blocks = metric_join.blocked(metric_join.classes_of(df.selectExpr("vec_id", "named_struct('a', vec_id) AS k", "embedding AS vec")).selectExpr("16L AS cell", "false AS core", "true AS home", "cid", "copies", "vec"), near)
    cells = metric_join.planned(blocks, metric_join.radii(blocks, metric_join.pivots_of(blocks, near), near), near, True)
    kids = metric_join.children(blocks, cells, near).groupBy("cell", "core").agg(F.count_if("home").alias("n")).collect()
    assert max(r.n for r in kids if r.core) == 400
    assert Counter(tuple(r) for r in metric_join.near_vectors(df, near).collect()) == brute_near(rows)


def test_near_vectors_empty(spark):
    assert metric_join.near_vectors(vectors(spark, [])).count() == 0


# samples that don't depend on the table's size, and rows of one id


def test_pii_sample_counts_each_text_once(spark):
    from veridelta.llm import pii

    rows = [(i, "one popular text") for i in range(3000)] + [(5000 + i, f"text number {i} of many") for i in range(500)] + [(None, None)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    how = pii.Fit(sample_docs=200)
    got = pii.planted(df, how).collect()
    hashes = sorted({r.o for r in df.select(F.xxhash64("text", F.lit(1)).alias("o")).collect()})
    assert sorted(r.o for r in got) == hashes[:200]
    assert len(pii.planted(df, pii.Fit(sample_docs=10_000)).collect()) == len(hashes)


def test_pii_full_sample_without_candidates_is_an_error(spark, monkeypatch):
    from veridelta.llm import pii

    df = spark.createDataFrame([(i, f"plain words {i}") for i in range(50)], "doc_id long, text string")
    monkeypatch.setattr(pii, "PERSONAL", ["WWWW"])
    monkeypatch.setattr(pii, "ORDINARY", ["WWW"])
    with pytest.raises(ValueError):
        pii.fit(df, pii.Fit(sample_docs=20))
    assert pii.fit(df, pii.Fit(sample_docs=60)).trees is None  # all there are


def test_quality_fit_collects_one_row_an_id(spark, monkeypatch):
    from veridelta.llm import quality_model

    seen = []
    monkeypatch.setattr(quality_model, "train", lambda texts, y, net: seen.append((texts, y.tolist())) or {})
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(2000)] + [(i, f"text {i}") for i in range(2, 60)] + [(61, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 62)] + [(1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    quality_model.fit(docs, labels)
    ids = [i for i in [*range(1, 60), 61] if zlib.crc32(str(i).encode()) % 5]
    first = min((f"copy {i}" for i in range(2000)), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    want = sorted(((first if i == 1 else None if i == 61 else f"text {i}"), 0 if i == 1 else i % 2) for i in ids if i != 61)
    assert sorted((t, int(q)) for t, q in zip(*seen[0]) if t is not None) == want


def test_mix_comes_near_its_target_without_ids(spark):
    from veridelta.llm import mixing

    rows = [(None, f"word{i} " * 10, s) for s in ("a", "b", "c") for i in range(200)] + [(7, f"x{i} y{i}", "c") for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    per = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(per) >= 2 and all(abs(r.taken - r.target) <= 10 * 3 for r in per if r.source_size != 2000)


def test_fences_follow_the_group(spark):
    """Each source's own marks and repeated lines set its fences; sketches of repeats leave out lines without any."""
    from veridelta.llm import quality_rules as q

    def doc(i, source, marks, same):
        lines = [f"w{i}x{j}" + "." * (j % 10 < marks) + f" z{i}y{j}" for j in range(30)] + ["again line"] * same
        return (i, "\n".join(lines), "en", source)

    rows = [doc(i, "calm", 1 + i % 3, 2 + i % 2 if i % 9 == 0 else 0) for i in range(80)] + [doc(100 + i, "busy", 5 + i % 4, 3 + i % 3 if i % 9 == 0 else 0) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    at = {r.source: r for r in q.fences(q.sketch(q.measure(df), q.Rules(spread=1)), q.Rules(spread=1)).collect()}
    assert 0 < at["calm"].mark_rate_high < at["busy"].mark_rate_high
    assert 0 < at["calm"].dup_line_rate_high <= at["busy"].dup_line_rate_high


@pytest.mark.parametrize("part", ["<a ", "<x y='", "<!", "</script ", "<!--", "<p class=\"", "<script>", "<x '>", "<b>x</i>"])
def test_html_of_broken_markup_is_read_in_linear_time(part):
    """A megabyte of it takes seconds; tags without an end are text, and comments without one hide the rest."""
    import time

    from veridelta.llm import html_text

    began = time.time()
    page = html_text.Page("<p>before</p>" + part * (1_000_000 // len(part)))
    assert time.time() - began < 20 and page.runs[0][0].strip() == "before"
    after = html_text.Page("<p>one</p> two <!-- three <b>four</b> five")
    assert " ".join(x[0].strip() for x in after.runs) == "one two"
    assert " ".join(x[0].strip() for x in html_text.Page("<p>one</p> two <!-- three").runs) == "one two"


def test_near_groups_are_the_same_without_broadcasts(spark, monkeypatch):
    """Tables of keys are no larger in the driver than other broadcast ones; beyond that they are shuffled."""
    from veridelta.llm import common, near_dedup

    assert near_dedup.BROADCAST_KEYS <= common.BROADCAST_ROWS
    docs = spark.createDataFrame([(i, " ".join(f"w{i % 4}_{k}" for k in range(60 + i % 3))) for i in range(24)], "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "BROADCAST_KEYS", 0)
    groups = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs).collect()}
    assert groups == {i: i % 4 for i in range(24)}


def test_near_rounds_broadcast_nothing(spark, monkeypatch):
    """The driver collects no table of a round, however small."""
    import sys

    from veridelta.llm import near_dedup

    plans, real = [], near_dedup.cut

    def cut(df):
        out = real(df)
        plans.append((sys._getframe(1).f_code.co_name, df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(near_dedup, "cut", cut)
    near = near_dedup.Near(small=2, pivots=1, late=2)
    texts = {i: " ".join(f"w{k}" if k < 60 or k >= 60 + i % 8 * 4 else f"v{i}_{k}" for k in range(120)) for i in range(40)}
    groups = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), near).collect()}
    sets, want = {i: set(near_dedup.shingles(t, near.words).tolist()) for i, t in texts.items()}, {i: i for i in texts}
    for _ in texts:
        want = {a: min(want[b] for b in texts if 100 * len(sets[a] & sets[b]) >= near.percent * len(sets[a] | sets[b])) for a in texts}
    assert groups == want and 1 < len(set(want.values())) < len(want)

    rounds = [(at, p) for at, p in plans if at in {"apart", "live_buckets", "merged", "components", "chosen", "candidates"}]
    assert {"apart", "live_buckets", "components"} <= {at for at, _ in rounds}
    assert not [at for at, p in rounds if "Broadcast" in p]


def test_near_rounds_do_not_multiply_rows(spark, monkeypatch):
    """Classes of a star share many shingles beyond its hub. A row isn't multiplied by them in each round."""
    import random

    from veridelta.llm import near_dedup

    rows = []

    def live(buckets, comp, real=near_dedup.live_buckets):
        out = real(buckets, comp)
        rows.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "live_buckets", live)
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(160)]
    texts = {i: " ".join(f"v{i}_{j}" if j in hit else w for j, w in enumerate(base)) for i in range(90) for hit in [set(rnd.sample(range(160), rnd.randint(1, 14)))]}
    near = near_dedup.Near(words=3, percent=85, small=4, pivots=1, late=16)
    groups = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), near).collect()}
    sets, want = {i: set(near_dedup.shingles(t, near.words).tolist()) for i, t in texts.items()}, {i: i for i in texts}
    links = {a: [b for b in texts if 100 * len(sets[a] & sets[b]) >= near.percent * len(sets[a] | sets[b])] for a in texts}
    for _ in texts:
        want = {a: min(want[b] for b in links[a]) for a in texts}
    assert groups == want and 1 < len(set(want.values())) < len(want)
    assert sum(rows) <= 10 * len(texts)
