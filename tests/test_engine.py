"""Functions, grammar, sources and sessions, against plain Python."""

import hashlib
import json

from pyspark.sql import functions as F

from tidewright.functions import grammar as G
from tidewright.functions import scalars as S
from tidewright.functions import text as T
from tidewright.operators import selection as K
from tidewright.operators import sequences as W
from tidewright.sources import files
from tidewright.streaming import session


def stable(key, low, high):
    return low + int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big") % (high - low + 1)


def sizes(length, key):
    out, step = [], 0
    if 0 < length < 4:
        return [length]
    while length > 0:
        ok = [s for s in range(4, 8) if s == length or length - s >= 4]
        out.append(ok[stable(f"{key}:chunk:{step}", 0, len(ok) - 1)])
        length, step = length - out[-1], step + 1
    return out


def test_chunks(spark):
    d = spark.createDataFrame([(n, f"k{n}") for n in range(0, 140)], "n int, k string")
    for r in d.select("n", "k", S.chunk_sizes(F.col("n"), F.col("k")).alias("c")).collect():
        assert r.c == sizes(r.n, r.k)


def test_han_and_openers(spark):
    d = spark.createDataFrame([("你好 world 世界",), ("And then, it's fine",), ("",)], "v string")
    got = [tuple(r) for r in d.select(S.opening_key(F.col("v"), 2, 3), S.opener(F.col("v"))).collect()]
    assert got == [("han:你好世", "world"), ("en:and then", "then"), ("en:", "")]


def test_grammar_round_trip(spark):
    texts = ["plain", 'q"uote \\ back', "a\nb\tc\x1f", "<&>", "中文😀", " spaced "]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, m string")
    body = G.action_body(F.lit("respond"), **{"for": F.col("i"), "message": F.col("m")})
    rows = d.select("i", "m", body.alias("b"), G.parse_action(G.completion(body)).alias("p"), G.unescape(G.escape(F.col("m"), True)).alias("u")).collect()
    for r in rows:
        assert r.b == f"respond({session.compact({'for': r.i, 'message': r.m})})"
        assert r.p.valid and r.p.verb == "respond" and r.p["for"] == r.i and r.p.message == r.m and r.u == r.m
    bad = ["", None, " <action>idle()</action>", '<action>respond({"message":"x","for":1})</action>', '<action>respond({"for":true,"message":"x"})</action>', '<action>respond({"for":1,"message":" "})</action>', '<action>fly({"to":"x"})</action>', '<action>delegate({"task":"x","y":1})</action>']
    got = spark.createDataFrame([(x,) for x in bad], "r string").select(G.parse_action(F.col("r")).alias("p")).collect()
    assert [r.p.verb for r in got] == ["invalid"] * len(bad) and all(r.p.reason for r in got)
    assert all(session.parse(x)[2] for x in bad)


def test_sweep_and_merge(spark):
    rows = [("a", 0, 5), ("a", 3, 9), ("a", 5, 6), ("a", 20, 22), ("b", 1, 2)]
    d = spark.createDataFrame(rows, "k string, start int, end int")
    assert sorted(map(tuple, W.sweep(d, "k").collect())) == [("a", 0, 5), ("a", 5, 6), ("a", 20, 22), ("b", 1, 2)]
    assert sorted(map(tuple, W.merge_intervals(d, "k").collect())) == [("a", 0, 9), ("a", 20, 22), ("b", 1, 2)]


def test_shards_keep_to_their_cap(spark):
    d = spark.createDataFrame([(i, "x" * (10 + i)) for i in range(40)], "id int, line string")
    got = K.shards(d, "id", F.col("line"), 2, 200).collect()
    for s in {r.shard for r in got}:
        assert sum(len(r.line) + 1 for r in got if r.shard == s) <= 200
    assert K.shards(d.limit(0), "id", F.col("line"), 2, 200).count() == 0


def test_selection_is_the_same_for_any_partitioning(spark):
    d = spark.createDataFrame([(i, f"s{i % 7 % 3}") for i in range(200)], "id int, g string")
    runs = [sorted(r.id for r in K.stratified(d.repartition(n), "id", "g", 31, "x").collect()) for n in (1, 2, 7)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == 31


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.jsonl").write_text('{"x": 1, "y": "é"}\nnot json\n{"x": "no"}\n')
    got = files.json_lines(spark, f"file://{tmp_path}/a", "x int, y string").collect()
    assert [(r.x, r.y, r._bad is None) for r in got] == [(1, "é", True), (None, None, False), (None, None, False)]
    told = files.manifest(spark, f"file://{tmp_path}/a")
    assert told[0]["rows"] == 3 and told[0]["sha256"] == hashlib.sha256((tmp_path / "a/1.jsonl").read_bytes()).hexdigest()
    assert files.verify(spark, f"file://{tmp_path}/a", told) == []
    assert files.verify(spark, f"file://{tmp_path}/a", [told[0] | {"bytes": 1}]) == ["1.jsonl: bytes"]
    d = spark.createDataFrame([(1, "b"), (2, None)], "z int, a string")
    assert [r.value for r in files.canonical_lines(d).collect()] == ['{"a":"b","z":1}', '{"z":2}']
    for k in (1, 2):
        files.publish(d.where(F.col("z") <= k), f"file://{tmp_path}/out")
        assert files.current(spark, f"file://{tmp_path}/out", "z int, a string").count() == k
    (tmp_path / "b.json").write_text(json.dumps({"demo": "d", "records": [{"id": 1}]}, indent=1))
    assert files.authored(spark, f"file://{tmp_path}/b.json", "demo string, records array<struct<id:int>>").first()._path.endswith("b.json")


def act(verb, **a):
    return f"<action>{verb}({session.compact({k.rstrip('_'): v for k, v in a.items()}) if a else ''})</action>"


def events():
    user = lambda s, n, text, action: (s, n, "user", text, None, None, 0, action)
    tool = lambda s, n, name, status, action, g=0: (s, n, "tool", json.dumps({"status": status}), name, "job-1", g, action)
    return [
        user("a", 1, "Hello wrld", act("suggest_edit", quote="wrld", replacement="world")),
        user("a", 2, "Hello wrld wrld", act("suggest_edit", quote="wrld", replacement="world")),
        user("a", 3, "Hello", act("respond", for_=3, message="hi")),
        user("a", 4, "Hello", act("respond", for_=3, message="again")),
        user("a", 5, "aXaXa", act("highlight", quote="aXa", occurrence=2)),
        user("a", 6, "aXaXa", act("highlight", quote="aXa", occurrence=2)),
        user("a", 7, "find it", act("web_search", query="What is it?")),
        user("a", 8, "find it", act("web_search", query="what  IS it")),
        tool("a", 9, "web_search", "completed", act("respond", for_=9, message="found")),
        ("a", 10, "control", None, None, None, 0, None),
        tool("a", 11, "web_search", "completed", act("idle"), 0),
        user("a", 12, "One.", act("translate_commit", for_=1, message="Un.")),
        user("a", 13, "One. Two.", act("translate_commit", for_=2, message="Deux.")),
        user("a", 14, "Changed", act("translate_commit", for_=1, message="x")),
        user("b", 1, "x", "rubbish"),
        user("b", 2, "x", act("delegate", task="Do this")),
        user("b", 3, "x", act("delegate", task="do  THIS")),
        tool("b", 4, "delegate", "accepted", act("web_search", query="this")),
        tool("b", 5, "delegate", "completed", act("highlight", quote="x", occurrence=1)),
    ]


def test_session_rules(spark):
    d = spark.createDataFrame(events(), session.INPUT)
    got = {(r.session_id, r.seq): r for r in session.fold(d).collect()}
    valid = {k: r.valid for k, r in got.items()}
    assert [valid["a", i] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 14)] == [True, False, True, False, True, False, True, False, True, True, True, False]
    assert [valid["b", i] for i in (1, 2, 3, 4, 5)] == [False, True, False, True, False]
    assert ("a", 10) not in got and ("a", 11) not in got  # reset, and a result from before it
    assert got["a", 12].idx == 1 and got["a", 12].generation == 1 and got["a", 7].job_id == "job-7"


def test_stream_equals_batch(spark, tmp_path):
    rows = events()
    for k in range(0, len(rows), 6):
        spark.createDataFrame(rows[k : k + 6], session.INPUT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(session.INPUT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = session.stream(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = session.fold(spark.createDataFrame(rows, session.INPUT))
    assert sorted(map(repr, spark.read.parquet(f"{tmp_path}/out").select(session.COLUMNS).collect())) == sorted(map(repr, batch.select(session.COLUMNS).collect()))


def test_preceded(spark):
    d = spark.createDataFrame([(i, f"v{i}" if i % 7 else None) for i in range(0, 600, 3)], "id long, v string")
    got = {r.id: r.before for r in K.preceded(d, "id", "v", "before").collect()}
    ids = sorted(got)
    assert ids == list(range(0, 600, 3))
    assert all(got[b] == (f"v{a}" if a % 7 else None) for a, b in zip(ids[:-1], ids[1:], strict=True)) and got[0] is None
    assert K.preceded(d.limit(0), "id", "v", "before").count() == 0


def test_condensed(spark):
    def cut(text, n):
        return text if len(text) <= n else text[: n // 2] + "\n[...]\n" + text[len(text) - (n - n // 2) :]

    def event(i, text):
        return f'<stream_event index="{i}" source="user" time="t+0ms">{text}</stream_event>'

    prompts, want = [], []
    for n, size in ((0, 5), (1, 5), (3, 400), (4, 3000)):
        past = [(event(i, f"{i}" * size), f'respond({{"for":{i}}})' if i % 2 else "idle()") for i in range(n)]
        last = event(n, "z" * size)
        prompts.append("".join(f"{e}\n<action>{a}</action>\n" for e, a in past) + last + "\n" + G.MARKER)
        said = "\n".join(f"{e}\n<action>{a}</action>" for e, a in past if a != "idle()")
        part = f"<prior_responses>\n{cut(said, 300)}\n</prior_responses>\n" if said else ""
        want.append(part + cut(last, 600))
    d = spark.createDataFrame(list(enumerate(prompts)), "i int, prompt string")
    assert [r.e for r in d.select("i", T.condensed(F.col("prompt"), 900).alias("e")).orderBy("i").collect()] == want
