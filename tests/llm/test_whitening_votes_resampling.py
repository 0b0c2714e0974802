"""Operators 11 to 13 against plain versions."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from evidara.llm import op11_jacobi_whitening as op11
from evidara.llm import op12_neighbour_quality as op12
from evidara.llm import op13_importance_resampling as op13
from evidara.llm.registry import queries
from tests.conftest import SMALL
from tests.llm.helpers import awkward, empty, lower, words

VECTORS = "id long, v array<float>, x string, component int"


def whitened_plainly(rows, k):
    """{row: (n, deviation, [(share, |whitened|)])} over the distinct lattice vectors, by the covariance's eigenvectors."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in rows], dtype=object)
    distinct = np.array(sorted({tuple(r) for r in x}), dtype=object)
    n, s = len(distinct), distinct.sum(axis=0)
    centred = (distinct - s / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    y = (x - s / n).astype(float) @ vectors[:, :k] / np.sqrt(np.maximum(values[:k], 1e-30))
    return n, [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x], values / values.sum(), y


@pytest.mark.parametrize("parts", [1, 5])
def test_op11_equals_eigenvectors(spark, parts, monkeypatch):
    monkeypatch.setattr(op11, "FAN", 2)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 20)) * np.linspace(8, 0.4, 20)
    rows = [(i, [float(c) for c in v], "x", 1) for i, v in enumerate(base)]
    rows += [(900 + i, rows[7][1], "x", 1) for i in range(400)] + [(None, rows[8][1], None, None)]  # copies are fitted once
    bad = [(2000, None, "x", 1), (2001, [1.0, None] + [0.0] * 18, "x", 1), (2002, [float("nan")] * 20, "x", 1), (2003, [float("inf")] * 20, "x", 1), (2004, [1.0, 2.0], "x", 1), (2005, [], "x", 1), (2006, [1e30] * 20, "x", 1)]
    got = op11.whiten(spark.createDataFrame(rows + bad, VECTORS).repartition(parts), "id", "v").toPandas()
    n, deviation, share, y = whitened_plainly([r[1] for r in rows], 16)
    assert n == 300 and (got.n == n).all() and len(got) == 16 * len(rows) and (got.identity_error < 1e-10).all() and got.identity_error.nunique() == 1
    got["id"] = got["id"].fillna(-1).astype(int)
    wide = got.pivot(index="id", columns="component", values="whitened").loc[[-1 if r[0] is None else r[0] for r in rows]].to_numpy()
    sign = np.sign((wide * y).sum(axis=0))
    assert np.allclose(wide * sign, y, atol=1e-8) and np.allclose(got.groupby("component").explained.first(), share[:16], rtol=1e-9)
    assert got.groupby("id").deviation.first().loc[[-1 if r[0] is None else r[0] for r in rows]].tolist() == deviation


def test_op11_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, VECTORS)
    for rows in ([], [(1, None, "x", 1)], [(1, [1.0, 2.0], "x", 1)] * 3):
        assert op11.whiten(make(rows), "id", "v").count() == 0  # nothing, or one distinct vector: no variance
    two = op11.whiten(make([(1, [1.0, 5.0], "x", 1), (2, [2.0, 5.0], "x", 1), (2, [2.0, 5.0], "x", 1)]), "id", "v").collect()
    assert sorted((r.id, r.component, abs(round(r.whitened, 9)), r.explained) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]
    huge = op11.whiten(make([(1, [1e12], "x", 1), (2, [-1e12], "x", 1), (3, [0.0], "x", 1)]), "id", "v").collect()
    assert {r.id: r.deviation for r in huge}[1] is None and {r.id: r.deviation for r in huge}[3] < 10  # (3 * x) ** 2 is no long


def test_op11_jacobi_is_accurate_for_small_singular_values():
    """Columns of lengths from 1 down to 1e-12 keep their relative accuracy, which a covariance matrix would lose."""
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 33):
        lengths = 10.0 ** -np.linspace(0, 12, d)
        q = np.linalg.qr(rng.normal(size=(d, d)))[0]
        found, vectors = op11.jacobi(q * lengths)
        assert np.allclose(found, lengths, rtol=1e-10) and np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13)
    r = np.triu(rng.normal(size=(40, 40)))
    found, vectors = op11.jacobi(r)
    assert np.allclose(found, np.linalg.svd(r)[1]) and np.allclose(np.linalg.norm(r @ vectors, axis=0), found)


def test_op12_votes_equal_brute_force():
    rng = np.random.default_rng(2)
    n, width = 40, 6
    vectors = rng.normal(size=(n, width)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = np.array([i % 4 > 0 for i in range(n)]).astype(int)
    space = rng.normal(size=(op12.TERMS, width)) / 10
    model = op12.Model(np.ones(op12.TERMS), np.zeros(op12.TERMS), space, vectors, labels)
    texts = ["Some words, more words\nof a text", "LOUD!! WORDS!! HERE!!", "a a a a a", " ".join(f"w{i}" for i in range(3000)), None, "  "]
    for text, got in zip(texts, model.score(pa.array(texts)), strict=True):
        w = words(text)
        if not w:
            assert got == 0.5
            continue
        terms = collections.Counter(op12._hash(x.lower(), 0) for x in w) + collections.Counter(op12._hash(op12.shape(x), 1) for x in w)
        terms.update(op12._hash(f"{op12.shape(a)} {op12.shape(b)}", 1) for a, b in itertools.pairwise(w))
        same = sum(a.lower() == b.lower() for a, b in itertools.pairwise(w))
        terms.update({op12.REPEATED: same} if same else {})
        value = np.zeros(op12.TERMS)
        for t, c in terms.items():
            value[t] = math.sqrt(c / len(w))
        for half in (slice(0, op12.HALF), slice(op12.HALF, None)):
            value[half] /= math.sqrt(2 * (value[half] ** 2).sum())
        own = value @ space
        cosine = vectors @ (own / np.linalg.norm(own))
        near = np.argsort(-cosine, kind="stable")[: op12.NEIGHBOURS]
        vote = np.maximum(cosine[near], 1e-6) * np.where(labels[near] == 1, 1 / labels.sum(), 1 / (1 - labels).sum())
        assert math.isclose(got, (vote * labels[near]).sum() / vote.sum(), abs_tol=1e-4), text


def test_op12_shapes():
    assert [op12.shape(w) for w in ("Word,", "WORD!!!", "x1y22", "###", "Été", "|", "a-b")] == ["B,", "A!!", "a0a0", "##", "B", "|", "a-a"]


def test_op12_learns_junk(spark):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "ko", "ti", "mu") for b in ("lon", "mir", "das") for c in ("e", "er", "ing", "")]
    clean = lambda n: " ".join(rng.choice(vocabulary).capitalize() if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(n)) + "."
    junk = [lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "### "), lambda t: t.replace(" ", " | "), lambda t: " ".join(w for w in t.split() for _ in range(9))]
    rows = [(i, junk[i // 4 % 4](clean(60)) if i % 4 == 0 else clean(rng.randrange(20, 200))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in rows] + [(None, 1), (9999, 0), (5, None)], "doc_id long, quality int")
    model = op12.learn(docs, labels)
    held = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    score = model.score(pa.array([t for _, t in held]))
    assert len(held) > 60 and np.mean((score >= op12.THRESHOLD) == [i % 4 > 0 for i, _ in held]) > 0.97
    df, all_rows = awkward(spark)
    got = op12.quality(df, model)
    assert got.count() == len(all_rows) and all(0 <= r.score <= 1 for r in got.collect())
    kept = op12.with_quality(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r.score >= op12.THRESHOLD for r in got.collect())
    assert op12.quality(empty(spark), model).count() == 0
    none = op12.learn(docs, labels.filter("quality = 1"))
    assert (none.score(pa.array(["x", None])) == 1.0).all() and (op12.learn(docs, labels.limit(0)).score(pa.array(["x"])) == 0.5).all()


def test_op12_sample_is_bounded_by_rows_of_each_class(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + "!! " * (i % 2)) for i in range(200)], "doc_id long, text string")
    model = op12.learn(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"), rows=30)
    assert len(model.labels) == 60 and model.labels.sum() == 30


def test_op12_held_out_accuracy(spark, duck):
    found = queries()["op12_neighbour_quality"](spark, "/root/testdata/sf0.01").toPandas()
    marks = duck.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").df()
    held = found[found.held_out].merge(marks, on="doc_id")
    assert len(found) == 1000 and ((held.predicted == held.quality).mean()) > 0.9
    assert (held[held.quality == 0].predicted == 0).mean() > 0.9


WORD13 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def drawn_plainly(rows, target, most, buckets, percent=10, least=20):
    def grams(t):
        w = WORD13.findall(lower(t))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    s, t = collections.Counter(b for r in rows for b in grams(r[1])[1]), collections.Counter(b for x in target for b in grams(x)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for r in rows:
        w, g = grams(r[1])
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((o for o in out if o[5] >= least), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    for i, o in enumerate(fit[: percent * len(fit) // 100]):
        o[4] = i + 1
    return [tuple(o[:5]) for o in out]


@pytest.mark.parametrize(("most", "buckets"), [(1, 10_000), (3, 101)])
def test_op13_equals_brute_force(spark, most, buckets):
    rng = random.Random(13)
    vocabulary = [f"v{i}" for i in range(90)] + ["Été", "ÉTÉ", "x_y", "a\x7fb", "😀", "q's"]
    more = [(1000 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(50))), "en", "s", 1) for i in range(150)]
    more += [(None, more[0][1], "en", "s", 1), (1001, more[1][1], "en", "s", 1)]
    df, rows = awkward(spark, more)
    items = ["v1 v2 v3 v4", None, "", "Été v1 v1"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for parts in (1, 7):
        got = sorted((tuple(r) for r in op13.importance(df.repartition(parts), target, most, buckets).collect()), key=key)
        assert got == sorted(drawn_plainly(rows, items, most, buckets), key=key)
    assert op13.importance(empty(spark), target).count() == 0
    flat = op13.importance(df, target.limit(0)).collect()
    assert len(flat) == len(rows)
    taken = op13.resampled(df, target, most, buckets)
    assert taken.columns == df.columns
    ids = lambda rows: collections.Counter(rows)
    assert ids(r.doc_id for r in taken.collect()) == ids(r[0] for r in drawn_plainly(rows, items, most, buckets) if r[4])


def test_op13_draws_over_many_ranges(spark, monkeypatch):
    """Equal texts: scores differ by the variates only, and ranks run through all ranges."""
    monkeypatch.setattr(op13, "RANGE_ROWS", 50)
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('same words ', 15) as text")
    got = op13.importance(docs, docs.limit(1), percent=50).filter("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1501))
    assert all((-a.score, a.doc_id) < (-b.score, b.doc_id) for a, b in itertools.pairwise(got))


def test_op13_suffix_order():
    order, common = op13.suffix_order(np.array([1, 2, 1, 2, 3, 1, 2], np.int32), np.array([0, 5, 7]), 3)
    assert order.tolist() == [5, 0, 2, 6, 1, 3, 4] and common.tolist() == [0, 2, 2, 0, 1, 1, 0]


@pytest.mark.parametrize("name", ["op11_jacobi_whitening", "op12_neighbour_quality", "op13_importance_resampling"])
def test_queries_give_every_row(spark, name):
    found = queries()[name](spark, SMALL)
    table = "embeddings" if name.startswith("op11") else "documents"
    n = spark.read.parquet(f"{SMALL}/{table}.parquet").count()
    assert found.count() == n * (16 if table == "embeddings" else 1)
