"""Per-session event processing: one pure step for batch and stream.

A session's events come in order. Each gets an index, its action is parsed and
held against what the session has done so far, and an action that breaks a rule
becomes idle with the reason. Whether an action repeats an earlier one counts
valid earlier ones only, so a session is a fold, not a window.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TICK_MS = 650
INPUT = "session_id string, seq long, source string, content string, tool string, job_id string, generation long, action string"
OUTPUT = "session_id string, seq long, idx long, elapsed_ms long, verb string, valid boolean, reason string, job_id string, generation long"

#: Keys of each verb's JSON.
KEYS = {"respond": {"for", "message"}, "suggest_edit": {"quote", "replacement"}, "highlight": {"occurrence", "quote"}, "delegate": {"task"}, "web_search": {"query"}, "translate_commit": {"for", "message"}}
ACTION = re.compile(r"<action>(?:idle\(\)|(\w+)\((\{.*\})\))</action>", re.S)


def compact(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def parse(raw: str | None) -> tuple[str, dict, str | None]:
    """Verb, arguments and what is wrong, if anything is."""
    m = ACTION.fullmatch(raw or "")
    if not m:
        return "idle", {}, "not an action"
    verb = m[1]
    if verb is None:
        return "idle", {}, None
    if verb not in KEYS:
        return "idle", {}, "unknown verb"
    try:
        args = json.loads(m[2])
    except ValueError:
        return "idle", {}, "not JSON"
    if set(args) != KEYS[verb] or f"<action>{verb}({compact(args)})</action>" != raw:
        return "idle", {}, "not canonical"
    for k, v in args.items():
        number = k in ("for", "occurrence")
        if number != (isinstance(v, int) and not isinstance(v, bool)) or not number and (not isinstance(v, str) or k != "replacement" and not v.strip()):
            return "idle", {}, "wrong argument"
    return verb, args, None


def occurrences(text: str, quote: str) -> int:
    """Overlapping ones."""
    return sum(text.startswith(quote, i) for i in range(len(text))) if quote else 0


def normal(q: str) -> str:
    return " ".join(q.casefold().split()).rstrip("?.!")


@dataclass
class Session:
    """What later decisions of a session depend on."""

    generation: int = 0
    next: int = 1
    text: str = ""
    users: dict[int, str] = field(default_factory=dict)
    tools: dict[int, list] = field(default_factory=dict)
    answered: list[int] = field(default_factory=list)
    marks: list[list] = field(default_factory=list)
    tasks: list[str] = field(default_factory=list)
    searches: list[str] = field(default_factory=list)
    commits: list[list] = field(default_factory=list)

    def dump(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def load(cls, text: str | None) -> Session:
        if not text:
            return cls()
        got = cls(**json.loads(text))
        got.users = {int(k): v for k, v in got.users.items()}
        got.tools = {int(k): v for k, v in got.tools.items()}
        return got


def problem(s: Session, idx: int, source: str, tool: str | None, status: str | None, verb: str, a: dict) -> str | None:
    """The rule an action breaks, or None."""
    if verb == "idle":
        return None
    user = source == "user"
    if verb == "respond":
        target = a["for"]
        if target in s.users:
            if not user:
                return "a user target needs a user event"
        elif target in s.tools and s.tools[target][0] == "web_search" and s.tools[target][1] in ("completed", "failed"):
            if target != idx:
                return "a search is answered on its own event"
        else:
            return "no such target"
        return "answered before" if target in s.answered else None
    if not user and not (verb == "web_search" and tool == "delegate" and status == "accepted"):
        return "tools act on user events"
    if verb == "highlight":
        if not 1 <= a["occurrence"] <= occurrences(s.text, a["quote"]):
            return "no such occurrence"
        return "highlighted already" if [a["quote"], a["occurrence"]] in s.marks else None
    if verb == "suggest_edit":
        if a["quote"] == a["replacement"]:
            return "nothing changes"
        return None if s.text.count(a["quote"]) == 1 else "the quote isn't unique"
    if verb == "delegate":
        return "delegated before" if normal(a["task"]) in s.tasks else None
    if verb == "web_search":
        return "searched before" if normal(a["query"]) in s.searches else None
    target = a["for"]
    if target not in s.users:
        return "no such target"
    if not s.text.startswith(s.users[target]):
        return "the text no longer extends the target"
    if any(c[0] == target for c in s.commits):
        return "committed before"
    if s.commits and (target <= s.commits[-1][0] or not s.users[target].startswith(s.commits[-1][1])):
        return "commits go forward"
    return None


def step(s: Session, e: dict) -> tuple[Session, dict | None]:
    """The session after an event, and the event's row; a result of an earlier generation is dropped."""
    if e["source"] == "control":
        return Session(generation=s.generation + 1), None
    generation = e.get("generation")
    if e["source"] == "tool" and generation is not None and int(generation) != s.generation:
        return s, None
    idx, content, status = s.next, e["content"] or "", None
    s.next += 1
    if e["source"] == "user":
        s.text = s.users[idx] = content
        s.marks = [m for m in s.marks if 1 <= m[1] <= occurrences(content, m[0])]
        kept: list[list] = []
        for c in s.commits:
            if not content.startswith(c[1]):
                break
            kept.append(c)
        s.commits = kept
    else:
        try:
            body = json.loads(content)
            status = body.get("status") if isinstance(body, dict) else None
        except ValueError:
            status = None
        s.tools[idx] = [e["tool"], status]
    verb, args, reason = parse(e["action"])
    reason = reason or problem(s, idx, e["source"], e["tool"], status, verb, args)
    job = None
    if reason is None:
        if verb == "respond":
            s.answered.append(args["for"])
        elif verb == "highlight":
            s.marks.append([args["quote"], args["occurrence"]])
        elif verb == "delegate":
            s.tasks.append(normal(args["task"]))
        elif verb == "web_search":
            s.searches.append(normal(args["query"]))
        elif verb == "translate_commit":
            s.commits.append([args["for"], s.users[args["for"]]])
        job = f"job-{idx}" if verb in ("delegate", "web_search") else None
    row = {"session_id": e["session_id"], "seq": e["seq"], "idx": idx, "elapsed_ms": idx * TICK_MS, "verb": verb if reason is None else "idle", "valid": reason is None, "reason": reason, "job_id": job, "generation": s.generation}
    return s, row


COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


def fold(events: DataFrame) -> DataFrame:
    """All sessions of a table of events, each in order of seq. A session must fit one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s, rows = Session(), []
        for e in pdf.sort_values("seq").astype(object).where(pdf.notna(), None).to_dict("records"):
            s, row = step(s, e)
            if row:
                rows.append(row)
        return pd.DataFrame(rows, columns=COLUMNS)

    return events.groupBy("session_id").applyInPandas(run, OUTPUT)


class Sessions(StatefulProcessor):
    """The same step on a stream; the session is its key's state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", "text string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        s = Session.load(self.state.get()[0] if self.state.exists() else None)
        out = []
        for pdf in [pd.concat(list(rows))]:
            for e in pdf.sort_values("seq").astype(object).where(pdf.notna(), None).to_dict("records"):
                s, row = step(s, e)
                if row:
                    out.append(row)
        self.state.update((s.dump(),))
        yield pd.DataFrame(out, columns=COLUMNS)

    def close(self) -> None:
        pass


def stream(events: DataFrame) -> DataFrame:
    """Rows of a stream of events, as ``fold`` gives them, session by session in arrival order."""
    return events.groupBy("session_id").transformWithStateInPandas(Sessions(), OUTPUT, "Append", "None")
