"""Toxicity on held-out rows, gradients, windows; the pipeline's stages."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tidewright.llm import toxicity


def corpus(n=900, seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "ti", "er", "on", "sh", "ed", "lo", "mi"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words, bad = [word() for _ in range(rng.choice([5, 40, 150, 400]))], i % 4 == 0
        if bad:
            for _ in range(1 + len(words) // 60):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["zorkan", "Zorkti", "blech", "grumpf"]))
        docs.append((i, " ".join(words), "en", f"s{i % 5}", len(" ".join(words))))
        labels.append((i, 1, int(bad)))
    return docs, labels


DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype("f8") for k, v in toxicity.fresh(rng).items()}
    x, mask = rng.standard_normal((5, 3, toxicity.INPUTS)), np.ones((5, 3))
    mask[3:, 1] = 0
    loss = lambda: float(toxicity.forward(p, toxicity.gates_of(p, x), mask)[0].astype("f8") @ np.array([1.0, -2.0, 0.5]))
    _, stuff = toxicity.forward(p, toxicity.gates_of(p, x), mask, True)
    g = toxicity.backward(p, x, mask, stuff, np.array([1.0, -2.0, 0.5]))
    for k in p:
        flat = p[k].reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 5)):
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-2 == pytest.approx(g[k].reshape(-1)[i], abs=5e-3)


def test_fast_and_plain_scores_agree():
    rng = np.random.default_rng(1)
    p = toxicity.fresh(rng)
    x, mask = rng.standard_normal((32, 40, toxicity.INPUTS)).astype("f4"), np.ones((32, 40), "f4")
    mask[10:, 5] = 0
    ids = np.arange(32 * 40).reshape(32, 40)
    table = np.stack([(x.reshape(-1, toxicity.INPUTS) @ p["wx"][w] + p["b"][w]).T for w in (0, 1)])
    assert np.allclose(toxicity.infer(p, table, ids, mask > 0), toxicity.forward(p, toxicity.gates_of(p, x), mask)[0], atol=1e-4)


def test_grams_of_long_runs_are_whole():
    odds = toxicity.Odds(grams={"zorkan": 2.0})
    run = "a" * 47 + "zorkan" + "b" * 47
    assert len(run) == 100 and odds.inputs(run)[6] == odds.inputs("zorkan")[6] == 2.0


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 56, 57, 400):
        seen = {i for s in toxicity.windows(n) for i in range(s, min(n, s + toxicity.WINDOW))}
        assert seen == set(range(n))


def test_held_out_accuracy(spark):
    rows, told = corpus()
    docs, labels = spark.createDataFrame(rows, DOC), spark.createDataFrame(told, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model).select("row.doc_id", "score").toPandas().set_index("doc_id")["score"]
    held = [i for i in range(len(rows)) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [(got[i] >= toxicity.REJECT) == bool(told[i][2]) for i in held]
    assert np.mean(right) > 0.97
    edge = spark.createDataFrame([(None, None, None, None, None), (1, "", "", "", 0), (2, "x " * 50000 + "zorkan", "", "", 0), (2, "é😀", "", "", 0)], DOC)
    out = toxicity.score(edge, model).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert max(r.score for r in out) >= toxicity.REJECT  # the last word of a very long text counts
    assert toxicity.score(edge.limit(0), model).count() == 0
    none = toxicity.learn(docs, labels.limit(0))
    assert {r.score < 0.7 for r in toxicity.score(edge, none).collect()} == {True}


def test_pipeline_stages(spark, tmp_path):
    rows, told = corpus(900, 7)
    passage = "This very line is shared by several of the documents here"
    extra = [(1000 + i, f"{passage}\n" + " ".join(f"w{i}x{j}" for j in range(30)), "en", "s0", 0) for i in range(5)]
    copies = [(2000 + i, rows[1][1] + "\n" + " ".join(f"same{j}" for j in range(40)), "en", "s1", 0) for i in range(4)]
    spark.createDataFrame(rows + extra + copies + [(None, None, None, None, None), (3000, "", "en", "s2", 0)], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(told, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = docs
    clean = {r[0] for r in rows if r[0] % 4} | {r[0] for r in extra + copies} | {None, 3000}
    left = {r.doc_id for r in seen["toxicity"].collect()}
    assert len(left ^ clean) <= 0.03 * len(rows)
    assert all(seen[n].columns == ["doc_id", "text", "lang", "source", "n_chars"] for n in list(seen)[:-1])
    assert seen["line_dedup"].count() == seen["toxicity"].count()
    assert sum(passage in (r.text or "") for r in seen["line_dedup"].collect()) == 1
    packed = seen["harmonic_packing"]
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in seen["source_mixing"].collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()
