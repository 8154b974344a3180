"""Compilers, spans and numbering against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.test_engine import sizes, stable
from tidewright.functions import text as X
from tidewright.operators import compilers as C
from tidewright.operators import selection as K


def scene(rid, segments):
    """Turns of a scene: (elapsed, state, content, verb, role)."""
    at = stable(f"{rid}:initial-time", 520, 780)
    out = [(at, "idle", "", "idle", "empty-initial")]
    at += stable(f"{rid}:unchanged-gap", 540, 850)
    out.append((at, "idle", "", "idle", "empty-unchanged"))
    text = ""
    for i, s in enumerate(segments):
        more = ("\n" if text else "") + s["text"]
        parts, done = sizes(len(more), f"{rid}:segment:{i}"), 0
        for j, n in enumerate(parts):
            done += n
            at += stable(f"{rid}:segment:{i}:tick:{j}:time", 520, 820)
            last, talk = j == len(parts) - 1, s["kind"] == "address"
            role = ("address-positive" if last else "address-before" if j == len(parts) - 2 else None) if talk else (("narration-hard-idle" if set(s["traps"]) - {"none"} else "narration-ballast") if last else None)
            out.append((at, "active", text + more[:done], "respond" if talk and last else "idle", role))
        text += more
        at += stable(f"{rid}:segment:{i}:pause", *C.PAUSES[s["pause_after"]])
        out.append((at, "idle", text, "idle", "address-after" if s["kind"] == "address" else None))
    at += stable(f"{rid}:clear-gap", 560, 1100)
    return [*out, (at, "idle", "", "idle", "empty-cleared")]


def test_scenes(spark):
    seg = lambda kind, text, pause, traps: {"kind": kind, "text": text, "pause_after": pause, "gold_reply": "Yes." if kind == "address" else None, "traps": traps}
    records = [("a", [seg("narration", "The über kettle sang again.", "short", ["none"]), seg("narration", "tiny", "none", ["rhetorical_question"]), seg("address", "Are you listening to me?", "long", [])]), ("b", []), ("c", [seg("address", "Well now, what?", "medium", [])])]
    df = spark.createDataFrame(records, "id string, segments array<struct<kind:string,text:string,pause_after:string,gold_reply:string,traps:array<string>>>")
    got = C.scenes(df).orderBy("id", "idx").collect()
    for rid, segments in records:
        own = [r for r in got if r.id == rid]
        assert [r.idx for r in own] == list(range(1, len(own) + 1))
        assert [(r.elapsed_ms, r.state, r.content, r.verb, r.role) for r in own] == scene(rid, segments)
    assert C.scenes(df.limit(0)).count() == 0


def script(steps):
    out, cur = [], ""
    for kind, text, count, expect in steps:
        if kind == "type":
            more = ("\n" if cur else "") + text
            for end in range(5, len(more) + 5, 5):
                out.append((cur + more[:end], expect if end >= len(more) else "idle"))
            cur += more
        elif kind == "pause":
            out += [(cur, expect if k == count - 1 else "idle") for k in range(count)]
        else:
            for _ in range(max(1, count // 5)):
                cur = cur[:-5] if len(cur) > 5 else ""
                out.append((cur, "idle"))
    return out


def test_tick_scripts(spark):
    steps = [("type", "hello there", 0, "respond"), ("pause", "", 3, "fire"), ("backtrack", "", 12, "respond"), ("type", "abcde", 0, "idle"), ("pause", "", 0, "fire"), ("backtrack", "", 100, "idle"), ("type", "z", 0, "respond")]
    df = spark.createDataFrame([("s", steps), ("e", [])], "id string, steps array<struct<kind:string,text:string,count:int,expect:string>>")
    got = C.tick_scripts(df).orderBy("id", "tick").collect()
    assert [(r.content, r.expect) for r in got] == script(steps)


def test_spans_and_quotes(spark):
    texts = ["the cat, The hat and other the", "", "none here", "Thé the\nthe the", "a an an a an", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    got = {r.i: r.m for r in df.select("i", X.spans(F.col("s"), X.any_word(["the", "an"])).alias("m")).collect()}
    pattern = re.compile(r"\b(?:the|an)\b", re.I)
    for i, s in enumerate(texts):
        assert (got[i] is None) == (s is None)
        assert s is None or [tuple(m) for m in got[i]] == [(m.start(), m.end(), m.group()) for m in pattern.finditer(s)]
    cases = [("a cat and a cat sat", 12, 15, "a cat sat"[:0] or "and a cat"), ("one one", 0, 3, None), ("x y\nx y", 6, 7, None), ("only", 0, 4, "only"), ("b  aa aa", 6, 8, "aa aa")]
    df = spark.createDataFrame(cases, "s string, a int, b int, want string")
    for r in df.select("s", "want", X.unique_quote(F.col("s"), F.col("a"), F.col("b")).alias("q")).collect():
        assert r.q == r.want, r


@pytest.mark.parametrize("s, vague", [("see you at five", True), ("at five in the afternoon", False), ("at 5 p.m. sharp", False), ("at seven " + "x" * 30 + " today", True), ("Later then", True), ("latest news", False), ("at noon", False)])
def test_vague_time(spark, s, vague):
    assert spark.createDataFrame([(s,)], "s string").select(X.vague_time(F.col("s"))).first()[0] is vague


def test_actions_and_answers(spark):
    raw = {
        " <action>idle()</action>\n": ("idle", None, None),
        "<action> tool(ui, {\"a\":1}) </action>": ("tool", "ui", None),
        "<action>tool(ui, {\"a\":1}})</action>": ("invalid", None, None),
        "<action>tool(ui, [1])</action>": ("invalid", None, None),
        "<action>respond({\"for\":2,\"message\":\" hi &amp; bye \"})</action>": ("respond", None, "hi & bye"),
        "<action>respond({\"for\":\"2\",\"message\":\"hi\"})</action>": ("invalid", None, None),
        "<action>respond({\"for\":0,\"message\":\"hi\"})</action>": ("invalid", None, None),
        "<action>respond({\"for\":true,\"message\":\"hi\"})</action>": ("invalid", None, None),
        "idle()": ("invalid", None, None),
        "": ("invalid", None, None),
    }
    df = spark.createDataFrame([(k,) for k in raw], "s string").select("s", X.legacy_action(F.col("s")).alias("p"))
    for r in df.collect():
        assert (r.p.kind, r.p.tool, r.p.message) == raw[r.s], r
    good = '{"interval_ms":1,"anchor_ms":2,"now_ms":3,"elapsed_ms":4,"due":true}'
    answers = [(good, True), (good + "x", False), (good.replace("4", "4.5"), False), (good.replace("true", "1"), False), (good[:-1] + ',"more":1}', False), ("[]", False), (None, False)]
    df = spark.createDataFrame(answers, "s string, ok boolean").select("ok", X.numeric_answer(F.col("s")).isNotNull().alias("got"))
    assert all(r.ok == r.got for r in df.collect())


def test_translation_errors(spark):
    cases = [("你好，世界", "Hello, world", []), ("", "x", ["empty"]), ("hello", "hello", ["no han", "echo", "latin"]), (" 你好", "Hello", ["outer space"]), ("你好,世界", "Hello", ["half width"]), ("价3.14元", "Price 3.14", []), ("你", "A sentence that is much longer than that", ["length"]), ("你<好", "Hi", ["markup"])]
    df = spark.createDataFrame(cases, "r string, s string, want array<string>")
    for r in df.select("r", "want", X.translation_errors(F.col("r"), F.col("s")).alias("e")).collect():
        assert list(r.e) == list(r.want), r


def test_translation_outer_space(spark):
    cases = [("你好\n", ["outer space"], []), ("\t你好", ["outer space"], []), ("你好\u2028", ["outer space"], []), (" 你好", ["outer space"], ["outer space"]), ("\u3000你好\u00a0", ["outer space"], ["outer space"]), ("你\n好", [], [])]
    df = spark.createDataFrame(cases, "r string, everything array<string>, spaces array<string>")
    got = df.select("*", X.translation_errors(F.col("r"), F.lit("Hello")).alias("e"), X.translation_errors(F.col("r"), F.lit("Hello"), space=r"\p{Zs}").alias("z"))
    for r in got.collect():
        assert (list(r.e), list(r.z)) == (list(r.everything), list(r.spaces)), r


def test_numbering(spark):
    ids = [None, *[hashlib.md5(str(i).encode()).hexdigest() for i in range(500)]]
    df = spark.createDataFrame([(x,) for x in ids], "id string").repartition(7)
    got = K.numbered(df, "id", "n", buckets=8, sample=50).collect()
    want = sorted(ids, key=lambda x: x or "")
    assert {r.id: r.n for r in got} == {x: i + 1 for i, x in enumerate(want)}
    assert K.numbered(df.limit(0), "id", "n").count() == 0


def test_quotas(spark):
    caps = {"a": 3, "b": 0, "c": 10, "d": 5}
    pools = spark.createDataFrame(list(caps.items()), "name string, cap long")
    for budget in (0, 1, 7, 13, 18, 30):
        left, want = budget, dict.fromkeys(caps, 0)
        while left and any(want[k] < caps[k] for k in caps):
            for k in sorted(caps):
                if left and want[k] < caps[k]:
                    want[k], left = want[k] + 1, left - 1
        assert {r.name: r.allocation for r in K.water_fill(pools, "name", "cap", budget).collect()} == want
    rows = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (4, "y"), (5, None)], "id int, text string")
    assert sorted((r.id, r.copies) for r in K.keep_first(rows, F.col("text"), "id").collect()) == [(1, 2), (2, 2), (4, 1)]
