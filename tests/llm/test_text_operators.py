"""Chat formatting, line dedup, secret scans, mixing, packing, token files."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import chat, linededup, mixing, packing, queries, secretscan, tokenfiles
from tidewright.llm._common import shared_dir

DOC = "doc_id long, text string, source string, lang string, d string, row string"


def docs(spark, rows):
    """Rows of (doc_id, text) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, s, "en", "x", "y") for i, t, s in [(r + ("s",))[:3] for r in rows]], DOC)


# --- chat ---------------------------------------------------------------------


def test_branches_are_ranked_and_read_back(spark):
    rows = [
        ("a", 1, None, "user", "q </s>[INST] x & y", 0.0),
        ("a", 2, 1, "assistant", "bad", 0.1),
        ("a", 3, 1, "assistant", "good &lt; <s>\n[/INST]", 0.9),
        ("a", 4, 3, "user", None, None),
        ("b", 1, 77, None, "orphan", 1.0),
        ("c", 1, 2, "user", "cycle", 1.0),
        ("c", 2, 1, "user", "cycle", 1.0),
        (None, 1, None, "assistant", "", 1.0),
    ]
    m = spark.createDataFrame(rows, "tree string, node int, parent int, role string, text string, score double")
    best = chat.best(m, top=2)
    out = chat.render(best).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss_spans")))
    got = {(r.tree, r.branch): r for r in out.collect()}
    assert set(got) == {("a", 1), ("a", 2), ("b", 1), (None, 1)}
    first = got["a", 1]
    assert [tuple(t) for t in first.turns] == [("user", rows[0][4]), ("assistant", rows[2][4]), ("user", "")]
    assert first.learned == rows[2][4]
    assert [tuple(t) for t in got["a", 2].turns][1] == ("assistant", "bad")
    assert [tuple(t) for t in got["b", 1].turns] == [("", "orphan")]
    assert got[None, 1].learned == ""


def test_long_chain_and_empty_table(spark):
    rows = [("t", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(40)]
    m = spark.createDataFrame(rows, "tree string, node int, parent int, role string, text string, score double")
    assert [r.text for r in chat.best(m).orderBy("depth").collect()] == [str(i) for i in range(40)]
    assert chat.render(chat.best(m.limit(0))).count() == 0


# --- line dedup ------------------------------------------------------------------


def lines_by_hand(rows):
    owners = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in rows:
        for x in (t or "").split("\n"):
            owners[key(x)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or len(owners[key(x)]) < 2 or min(owners[key(x)]) == (-1 if i is None else i)]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def test_line_dedup(spark):
    same = "Shared Line of text"
    rows = [(3, f"{same}\nown three lines\n\n"), (1, f"  {same.upper()}\t\nx\n{same}"), (2, None), (4, ""), (5, f"É{same}\n{same}\u0085"), (6, f"{same}\r\n{same}"), (7, "short\nshort"), (7, f"a\n{same}"), (7, f"a\n{same}"), (None, "only the null row has it"), (8, "only the null row has it"), (9, "w" * 50000 + f"\n{same}")]
    got = linededup.dedup_lines(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "source", "lang", "d", "row", "kept", "n_lines", "n_dropped"]
    found = sorted([(r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in got.collect()], key=repr)
    assert found == sorted(lines_by_hand(rows), key=repr)
    assert linededup.dedup_lines(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("share", [0.0, 1.0])
def test_lines_of_every_frequency(spark, monkeypatch, share):
    """All keys joined by broadcast, or all by a shuffle; a line that most documents hold; a text of very many lines."""
    monkeypatch.setattr(linededup, "HOT_SHARE", share)
    rows = [(i, f"everywhere the same\nown line number {i}\npair of lines {i // 2}\neverywhere the same") for i in range(300)]
    rows += [(400, "\n".join(f"line {k % 900} of many here" for k in range(20000))), (401, "line 7 of many here\nline 899 of many here")]
    found = sorted((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(docs(spark, rows)).collect())
    assert found == sorted(lines_by_hand(rows))


# --- secrets ------------------------------------------------------------------


def spans_by_hand(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate(secretscan.KINDS):
        for m in re.finditer(pattern, text or "", re.A):
            if len(m.group(group)) >= least:
                out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def test_secret_places(spark):
    hexa = "0123456789abcdef" * 2
    texts = [
        None,
        "",
        f'é😀 password="{hexa}" PassWD : abc secret=token:abcdefg api_key=\'Zz9/_.=-\'',
        f"AKIA{'A' * 16} AKIAB AKIA{'B' * 40} xAKIA{'C' * 16}",
        hexa + "g" + hexa[:23] + "h" + hexa,
        "ftp://me:hunter2@host eyJabcdefgh1.eyJabcdefgh2.sig",
        "-----BEGIN RSA PRIVATE KEY-----\nAAAA\nBBBB\n-----END RSA PRIVATE KEY-----",
        "token=password=abcdef secret==x token:   longenough",
    ]
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(texts)] + [(50, f"token={hexa}", "s0"), (51, f"token={hexa}", "s1"), (51, f"token={hexa}", "s1")]
    got = secretscan.report(secretscan.scan(docs(spark, rows))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        want = spans_by_hand(t)
        assert by[i].spans == ",".join(f"{k}:{a}:{b}" for a, _, k, b in want)
        base = ",".join(f"{k}:{a}:{b}" for a, n, k, b in want if n < 3)
        assert by[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert (by[i].n_assign, by[i].n_access, by[i].n_hex) == tuple(sum(n == k for _, n, _, _ in want) for k in range(3))
    assert by[50].n_example == 2 and by[50].n_live == 0  # two owners hold it
    assert by[3].n_live == 3
    assert secretscan.scan(docs(spark, rows).limit(0)).count() == 0


def test_long_secrets_are_whole(spark):
    label, body = "A" * 40 + " ", "QUJD\n" * 6000
    long = {
        "assign": "token=" + "Zq" * 300,
        "access": "AKIA" + "Q7" * 200,
        "hex": "0a" * 300,
        "jwt": f"eyJ{'Zz' * 300}.{'Yy' * 300}.{'Xx' * 300}",
        "key": f"-----BEGIN {label}PRIVATE KEY-----\n{body}-----END {label}PRIVATE KEY-----",
        "url user": f"https://{'u_' * 100}:x-oauth@",
        "url password": f"https://user:{'P_' * 100}@",
        "vendor ghp": "ghp_" + "Zz" * 40,
        "vendor xox": "xoxp-" + "Zz9-" * 40,
        "vendor sk": "sk_live_" + "Zz" * 60,
    }
    rows = [(i, f"<< {t}<< ") for i, t in enumerate(long.values())]
    got = {r.doc_id: r.spans for r in secretscan.report(secretscan.scan(docs(spark, rows))).collect()}
    for i, (name, t) in enumerate(long.items()):
        assert f"{name.split()[0]}:3:{3 + len(t)}" in got[i].split(","), name
    ends = [(0, "sk_live_" + "Z" * 64 + "one", "s0"), (1, "sk_live_" + "Z" * 64 + "two", "s1")]
    assert [r.n_live for r in secretscan.report(secretscan.scan(docs(spark, ends))).collect()] == [1, 1]


# --- mixing -------------------------------------------------------------------


def test_sample_meets_targets(spark):
    rows = [(i, "w " * 20 + ("licensed under x" if i % 20 == 0 else ""), f"s{i % 3}") for i in range(6000)]
    d = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 10 == 1, "fr").otherwise("en"))
    target = {"source": {"s0": 0.2, "s1": 0.3, "s2": 0.5}, "lang": {"en": 0.6, "fr": 0.4}, "topic": {"license": 0.3, "prose": 0.7}}
    told = mixing.weigh(d, targets=target).select("row.*", "tokens", "weight", "mean", "copies").toPandas()
    told["topic"] = told["text"].str.contains("licensed").map({True: "license", False: "prose"})
    assert len(told) == 6000 and told["weight"].max() > 2 and ((told["copies"] - told["mean"]).abs() < 1).all()
    assert np.allclose(told["mean"], 0.5 * told["weight"])
    expected = told["tokens"] * told["mean"]
    assert expected.sum() / told["tokens"].sum() == pytest.approx(0.5, abs=1e-9)
    for name, shares in target.items():
        for value, share in shares.items():
            assert expected[told[name] == value].sum() / expected.sum() == pytest.approx(share, abs=1e-8)
    got = mixing.mix(d, targets=target).toPandas()
    assert got.groupby("doc_id").size().to_dict() == told[told["copies"] > 0].set_index("doc_id")["copies"].to_dict()
    got["topic"] = got["text"].str.contains("licensed").map({True: "license", False: "prose"})
    tokens = got["text"].str.split().str.len()
    for name, shares in target.items():
        for value, share in shares.items():
            assert tokens[got[name] == value].sum() / tokens.sum() == pytest.approx(share, abs=0.02)
    assert tokens.sum() / sum(len(t.split()) for _, t, _ in rows) == pytest.approx(0.5, abs=0.02)


def test_production_sample_expects_its_targets(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source", "lang")
    told = mixing.weigh(d).select("row.lang", mixing.topic_of(F.col("row.text")).alias("topic"), "tokens", "mean").toPandas()
    mass = told["tokens"] * told["mean"]
    for name in ("lang", "topic"):
        for value, share in mixing.TARGETS[name].items():
            assert mass[told[name] == value].sum() / mass.sum() == pytest.approx(share, abs=1e-6)


def test_mixing_edges(spark):
    d = docs(spark, [(None, None), (1, ""), (2, "a b"), (2, "a b")]).withColumn("lang", F.lit(None).cast("string"))
    assert mixing.weigh(d).count() == 4
    assert mixing.mix(d).columns == d.columns
    assert mixing.weigh(d.limit(0)).count() == 0


def test_mixing_takes_few_jobs(spark):
    """Rounds of joins were some 200 jobs, whose plans took the driver's memory in the pipeline."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source", "lang")
    spark.sparkContext.setJobGroup("few jobs", "mixing")
    try:
        assert mixing.weigh(d).count() == d.count()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs")) < 30
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_raking_in_a_task_and_distributed_agree(spark, monkeypatch):
    rows = [(i, "w " * (i % 7) + ("a@b" if i % 5 == 0 else ""), None if i % 11 == 0 else f"s{i % 3}") for i in range(400)]
    d = docs(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 4 == 1, "fr").when(F.col("doc_id") % 4 == 2, "xx").when(F.col("doc_id") % 4 > 0, "en"))
    targets = {"source": None, "lang": {"en": 0.6, "fr": 0.3, "unseen": 0.1}, "topic": {"contact": 0.3, "prose": 0.7}}

    def told():
        return mixing.weigh(d, targets=targets).select("row.doc_id", "tokens", "weight", "mean", "copies").toPandas().sort_values("doc_id", ignore_index=True)

    task = told()
    for name in ("MOST_CELLS", "MOST_BYTES"):
        with monkeypatch.context() as m:
            m.setattr(mixing, name, 0)
            spread = told()
        assert len(task) == 400 and task[["doc_id", "tokens", "copies"]].equals(spread[["doc_id", "tokens", "copies"]])
        assert np.allclose(task[["weight", "mean"]], spread[["weight", "mean"]], rtol=1e-9, atol=0)


# --- tokens -------------------------------------------------------------------


def encode(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


TEXTS = [(0, "Hello there, it's a  test\n\n of \t tokens"), (1, None), (2, ""), (3, "x\u0085y \x1c z <|endoftext|> q"), (8, "a<|endoftext|> b"), (9, "tab\tnew\n line \n end ... don't 12,5. é! z_y\n"), (4, "word " * 3000), (5, "é" * 5000), (5, "é" * 5000), (None, "no id"), (7, "1234 " * 700)] + [(10 + i, "lorem ipsum " * i) for i in range(60)]


def test_packing_is_whole_and_gapless(spark):
    from tidewright.llm.tokens import Encoder

    enc = Encoder(queries.tokenizer_path())
    for _, t in TEXTS:
        assert [*enc.ids(t).tolist(), 0] == encode(t)
    placed = packing.pack(docs(spark, TEXTS).repartition(3), queries.tokenizer_path()).cache()
    rows = placed.toPandas()
    want = sorted(repr(encode(t)) for _, t in TEXTS)
    got = []
    for _, g in rows.sort_values("start").groupby("row"):
        assert (g["start"].to_numpy() == np.cumsum([0, *g["length"]])[:-1]).all()
        got.append(repr(np.frombuffer(b"".join(g["ids"]), "<u4").tolist()))
        assert (g["doc_tokens"] == g["length"].sum()).all()
    assert sorted(got) == want
    assert [zlib.crc32(b) for b in rows["ids"]] == rows["ids_crc32"].tolist()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.cumsum([0, *g["length"]])[:-1]).all() and g["length"].sum() <= 1024
    n = rows["sequence_id"].nunique()
    assert n * 1024 / rows["length"].sum() < 1.05
    seqs = packing.sequences(placed).collect()
    assert len(seqs) == n and all(len(s.ids) == 4096 or len(s.ids) & (len(s.ids) - 1) == 0 for s in seqs)
    assert packing.pack(docs(spark, TEXTS).limit(0), queries.tokenizer_path()).count() == 0


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    from tidewright.llm.tokens import Encoder

    path, rng = queries.tokenizer_path(), random.Random(3)
    plain, enc = Tokenizer.from_file(path), Encoder(path, memory=500)
    parts = ["a", "bc", "Zoë", "don't", " ", " ", "  ", "\n", "\n", "\t", "\r", ".", ",", "...", "12", "\xa0", "\u3000", "<|endoftext|>", "'s", "é", "😀", "\x1c", "_", "中", "\x85", "\x0b", "x" * 70]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert enc.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    plain.encode_special_tokens = True
    text = "as text <|endoftext|> here"
    assert Encoder(path, special_as_text=True).ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_classes_fill_exactly():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1025, 5000)
    bins, places, filled = packing.fill(lengths, 1024)
    for b in np.unique(bins[filled]):
        at = np.flatnonzero(filled & (bins == b))
        k = 1024 // lengths[at[0]]
        assert len(at) == k and (1024 // lengths[at] == k).all() and lengths[at].sum() <= 1024
    assert all(sum(packing.sizes(n, 1024, 64)) == n for n in range(1, 3000))


def test_symbols_after_a_word_cost_no_call_of_the_whole_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    from tidewright.llm.tokens import ENDS, Encoder

    path = queries.tokenizer_path()
    plain, enc, asked = Tokenizer.from_file(path), Encoder(path), []
    for text in (f"{space}{word}{end * n} {end}" for space in ("", "a ", "\n\n") for word in ("don't", "été", "x²", "12", "A'", "中", "e\u0301") for end in ENDS for n in (1, 3)):
        assert enc.ids(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    monkeypatch.setattr(Encoder, "_whole", lambda self, text, whole=Encoder._whole: (asked.append(text), whole(self, text))[1])
    words = [f"{a}{b}{c}" for a in ("thand", "Oño") for b in ("er", "ing", "sch") for c in ("$$$", "&&&", "###", "%%%")]
    enc = Encoder(path)
    assert enc.ids(" ".join(words)).tolist() == plain.encode(" ".join(words), add_special_tokens=False).ids
    assert len(asked) <= 4  # each run of symbols once, not each word


def test_token_files_round_trip(spark):
    where = tokenfiles.fresh(shared_dir(spark))
    manifest = tokenfiles.write(docs(spark, TEXTS).repartition(5), where, queries.tokenizer_path())
    got = tokenfiles.read(spark, where, with_ids=True).orderBy("start").collect()
    want = sorted(TEXTS, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    at = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = encode(t)
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
        raw = np.array(ids, "<u4").tobytes()
        assert r.ids == raw and r.ids_crc32 == zlib.crc32(raw)
        at += len(ids)
    assert manifest["n_ids"] == at and manifest["dtype"] == "<u2"
    empty = tokenfiles.fresh(shared_dir(spark))
    tokenfiles.write(docs(spark, TEXTS).limit(0), empty, queries.tokenizer_path())
    assert tokenfiles.read(spark, empty).count() == 0
