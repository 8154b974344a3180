"""Action checks and the demo policy against a turn-by-turn replay in plain Python."""

import json
import random
import re

import pytest

from tidewright.operators import validation as V

COLUMNS = "session_id long, idx long, source string, state string, tool_name string, content string, kind string, valid boolean, target long, tool string, query string, request string, operation string, quote string, occurrence long, replacement string, permissions array<string>, extra string"


def some_turns(n=3000):
    rng, rows = random.Random(5), []
    pick = rng.choice
    for i in range(n):
        source = pick(["user"] * 8 + ["tool", None])
        done = json.dumps({"status": pick(["completed", "failed"])})
        content = pick([done, None, "not json"]) if source == "tool" else pick(["aaa b"] * 30 + ["a b a", "aa", "", None, "b"])
        may = pick([["web_search", "highlight", "generate_ui", "suggest_edit"]] * 6 + [[], None])
        idx = i % 600 + 1
        rows.append((i // 600, idx, source, pick(["idle", "active", None]), pick(["web_search", "ui"]), content, pick(["idle", "respond", "tool", "tool", None]), pick([True] * 8 + [False, None]), pick([idx, max(1, idx - 1), idx + 2, pick(range(1, 9)), None]), pick(["web_search", "generate_ui", "odd", None] + ["ui", "suggest_edit"] * 3), pick(["One two", " one  TWO?", "b.", " ", None]), pick(["do it", "DO it!", "", None]), pick(["highlight"] * 4 + ["other", None]), pick(["a"] * 4 + ["aa", "b", "", None]), pick([1, 1, 1, 1, 2, 3, 0, None]), pick(["a", " b ", "c", " ", None]), may, "x"))
    return rows


def holds(text, quote, n):
    at = -1
    for _ in range(n):
        at = (text or "").find(quote, at + 1)
        if at < 0:
            return False
    return text is not None


def replay(rows, v6, provider):
    """Accepted actions, one turn after another."""
    out, state = {}, {}
    norm = lambda s: " ".join(s.lower().split()).rstrip("?.!")
    for s, idx, source, mood, tool_name, content, kind, valid, target, tool, query, request, op, quote, n, repl, may, _ in rows:
        at = state.setdefault(s, {"turns": {}, "done": set(), "live": set()})
        at["turns"][idx] = (source, tool_name, content)
        if source == "user":
            at["live"] = {(q, k) for q, k in at["live"] if holds(content, q, k)}
        may, key, user = may or [], None, source == "user"
        good = bool(valid)
        if good and kind == "respond":
            to = at["turns"].get(target, (None, None, None))
            hit = to[0] == "tool" and to[1] == "web_search"
            if v6 and hit:
                hit = (to[2] or "").startswith("{") and json.loads(to[2])["status"] == "completed"
            good = user and not (hit and mood != "idle") and (hit or to[0] == "user")
            key = ("respond", target)
        elif good and kind == "tool":
            good = user and tool in (("web_search", "generate_ui", "suggest_edit") if v6 else ("web_search", "ui"))
            if v6:
                good = good and tool in may
            if good and tool == "web_search":
                good = "web_search" in may and bool((query or "").strip())
                key = ("search", norm(query or ""))
            elif good and tool == "generate_ui":
                good = provider and bool((request or "").strip())
                key = ("request", norm(request or ""))
            elif good:
                good = bool(quote) and (n or 0) >= 1 and holds(content, quote, n) and (quote, n) not in at["live"]
                good = good and ((bool((repl or "").strip()) and repl.strip() != quote) if v6 else (op == "highlight" and "highlight" in may))
                if good:
                    at["live"].add((quote, n))
        if good and key:
            good = key not in at["done"]
            at["done"].add(key)
        out[s, idx] = good
    return out


@pytest.mark.parametrize(("surface", "provider"), [("legacy", True), ("v6", True), ("v6", False)])
def test_validate(spark, surface, provider):
    rows = some_turns()
    got = V.validate(spark.createDataFrame(rows, COLUMNS), surface, provider).collect()
    want = replay(rows, surface == "v6", provider)
    assert {(r.session_id, r.idx): r.accepted for r in got} == want and len(got) == len(rows)
    assert 30 < sum(want.values()) < len(rows)
    told = {(r[0], r[1]): r[7] for r in rows}
    assert all((r.error is None) == (r.accepted or not told[r.session_id, r.idx]) for r in got)
    seen = {r.error for r in got}
    assert {V.SAYS["answered"], V.SAYS["same search"], V.SAYS["edit twice" if surface == "v6" else "ui twice"]} <= seen


def test_validate_empty(spark):
    assert V.validate(spark.createDataFrame([], COLUMNS), "v6").collect() == []


def test_demo_queries(spark):
    rng, rows = random.Random(7), []
    for i in range(400):
        source = rng.choice(["user", "user", "tool", None])
        rows.append((i // 40, i % 40, source, rng.choice(["web_search", "other"]), rng.choice(["What is  a?", "who, me;", "plain", "", None, "x" * 300 + " where?", "When: ? "]), rng.choice([None, None, "", "me", "What  is", "zz"])))
    asked = re.compile(V.QUESTION[len("(?iu)") :], re.IGNORECASE)
    want, pending, seen = {}, {}, {}
    for s, idx, source, tool, content, query in rows:
        p, before = pending.get(s, 0), seen.setdefault(s, [])
        text = " ".join((content or "").split())[-240:].strip(" ,.;:")
        low = " ".join(text.lower().split())
        ok = source == "user" and content and asked.search(content) and not p and text and not any(q in low for q in before)
        want[s, idx] = text if ok else None
        if query:
            p, _ = p + 1, before.append(" ".join(query.lower().split()))
        if source == "tool" and tool == "web_search" and p:
            p -= 1
        pending[s] = p
    df = spark.createDataFrame(rows, "session_id long, idx long, source string, tool_name string, content string, query string")
    assert {(r.session_id, r.idx): r.search for r in V.demo_queries(df).collect()} == want and any(want.values())
