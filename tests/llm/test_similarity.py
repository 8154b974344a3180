"""Shingle join, embedding dedup, learned partitions: against brute force."""

import random

import numpy as np
import pytest

from tidewright.llm import ann, embdedup, shinglejoin


def components_by_hand(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    out = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice([3, 6, 40, 120, 300]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 8])):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w) + rng.choice(["", "!", " tail"]))
    base = [word() for _ in range(80)]
    for _ in range(150):  # a large group of near copies
        w = list(base)
        w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    passage = " ".join(word() for _ in range(60))
    out += [" ".join(word() for _ in range(100)) + " " + passage for _ in range(150)]
    return out + [None, "", "  ...", "One", "one."]


@pytest.mark.parametrize("limit", [shinglejoin.LIMIT, 20])
def test_shingle_join_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(shinglejoin, "LIMIT", limit)
    monkeypatch.setattr(shinglejoin, "BLOCK", 64)
    rows = [(i * 3 + 1, t, "x", 0) for i, t in enumerate(texts())]
    d = spark.createDataFrame(rows, "doc_id long, text string, t string, c int")
    got = {r.doc_id: r for r in shinglejoin.near_duplicates(d.repartition(6)).collect()}
    sets = [frozenset(shinglejoin.shingles(r[1], 5).tolist()) for r in rows]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or (a | sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j])):
                links.append((i, j))
    comp = components_by_hand(len(rows), links)
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(s, rows[i][0])
    for i, r in enumerate(rows):
        g = got[r[0]]
        assert (g.n_links, g.component_id, g.class_id, g.kept) == (n[i], rows[comp[i]][0], first[sets[i]], comp[i] == i), r[1]
    kept = shinglejoin.dedup(d)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted({rows[c][0] for c in comp})


def test_shingle_join_edges(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (1, "A b, c d e f"), (1, "A b, c d e f"), (2, "z " * 30000), (3, None)], "doc_id long, text string")
    got = shinglejoin.near_duplicates(d).collect()
    assert len(got) == 5 and sorted(r.n_links for r in got) == [0, 0, 2, 2, 2]
    assert sum(r.kept for r in got) == 3
    assert len(shinglejoin.dedup(d).collect()) == 3
    assert shinglejoin.near_duplicates(d.limit(0)).count() == 0
    assert shinglejoin.dedup(d.limit(0)).count() == 0


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for i in range(0, n // 2, 3):  # pairs around the threshold
        y = rng.standard_normal(d)
        y -= (y @ x[i]) / (x[i] @ x[i]) * x[i]
        y *= np.linalg.norm(x[i]) / np.linalg.norm(y)
        x[i + 1] = 2.5 * (x[i] + y * rng.uniform(0.2, 0.8))
    x[-60:] = x[-1] + 0.01 * rng.standard_normal((60, d))
    x[-80:-70] = x[-80]
    return x


@pytest.mark.parametrize("block", [None, 50])
def test_embedding_dedup_against_brute_force(spark, block):
    x = vectors(700, 32, 1)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(9000, None, 0), (9001, [0.0] * 32, 0), (9002, [float("nan")] + [1.0] * 31, 0), (9003, [None] + [1.0] * 31, 0), (9004, [1.0, 2.0], 0), (9005, [2.0, 4.0], 0), (9006, [float("inf")] * 32, 0), (9007, [], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, c int")
    got = {r.vec_id: r for r in embdedup.near_duplicates(d, block=block).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = [(i, j) for i, j in np.argwhere(u @ u.T >= 0.9) if i < j]
    n, comp = np.bincount(np.array(links).ravel(), minlength=len(x)), components_by_hand(len(x), links)
    assert len(got) == len(rows) and len(links) > 1500
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[i], comp[i], comp[i] == i)
    for i in (9000, 9001, 9002, 9003, 9006, 9007):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[9005].component_id == 9004 and got[9005].n_links == 1
    assert embdedup.near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize("d", [1, 2, 3, 5, 8])
def test_embedding_dedup_in_few_dimensions(spark, d):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((300, d))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=100).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [got[i] for i in range(300)] == ((u @ u.T >= 0.9).sum(1) - 1).tolist()


def test_learned_partitions_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 24)) * 1.5
    x = np.concatenate([centres[rng.integers(0, 30, 6000)] + rng.standard_normal((6000, 24)), np.tile(rng.standard_normal(24) * 3, (60, 1))]).astype("f4")
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x)] + [(9000, None, ""), (9020, [0.0] * 24, ""), (9040, [1.0, 2.0], ""), (9041, [3.0, 1.0], "")]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, part string")
    got = ann.search(d, d.where("vec_id % 20 = 0").select("vec_id")).toPandas()
    y = x.astype("f8")
    hit = total = 0
    for q, g in got[got["query_id"] < 9000].groupby("query_id"):
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and (np.diff(g["score"]) <= 0).all()
        assert np.allclose(g["score"], s[g["vec_id"]], rtol=1e-12)
        hit += len(set(best) & set(g["vec_id"]))
        total += 20
    assert total == 20 * len(range(0, len(x), 20)) and hit / total >= 0.9
    same = got[got["query_id"] == 6000].sort_values("rank")["vec_id"].tolist()
    assert same == list(range(6001, 6021))  # ties to the smaller id
    odd = got[got["query_id"] >= 9000]
    assert odd[["query_id", "vec_id"]].values.tolist() == [[9040, 9041]]
    assert ann.search(d.limit(0), d.select("vec_id")).count() == 0
