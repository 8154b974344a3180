"""The wire grammar: event lines, action completions, prompts and their strict parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The verbs of the grammar and the JSON keys of each.
VERBS = {
    "respond": {"for": "int", "message": "string"},
    "suggest_edit": {"quote": "string", "replacement": "string"},
    "highlight": {"occurrence": "int", "quote": "string"},
    "delegate": {"task": "string"},
    "web_search": {"query": "string"},
    "translate_commit": {"for": "int", "message": "string"},
}
MARKER = "<PREDICT_THIS_ACTION>"


def escape(c: Column, quotes: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#x27;")] if quotes else [])
    for plain, coded in pairs:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for coded, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def event_line(idx: Column, source: Column, content: Column, *, state=None, elapsed_ms=None, tool=None, call_id=None, job_id=None) -> Column:
    """One event; attributes whose value is null are left out."""
    attributes = [F.concat(F.lit('index="'), idx.cast("string"), F.lit('"')), F.concat(F.lit('source="'), source, F.lit('"'))]
    for name, value, before, after in (("state", state, "", ""), ("time", elapsed_ms, "t+", "ms"), ("tool", tool, "", ""), ("call_id", call_id, "", ""), ("job_id", job_id, "", "")):
        if value is not None:
            attributes.append(F.concat(F.lit(f'{name}="{before}'), escape(value.cast("string"), True), F.lit(f'{after}"')))
    return F.concat(F.lit("<stream_event "), F.concat_ws(" ", *attributes), F.lit(">"), escape(content), F.lit("</stream_event>"))


def canonical(json: Column) -> Column:
    """Control characters as the compact JSON writer has them: lower-case hex."""
    for n in range(32):
        code = f"\\u{n:04X}"
        if code != code.lower():
            json = F.replace(json, F.lit(code), F.lit(code.lower()))
    return json


def action_body(verb: Column, **arguments: Column) -> Column:
    """``verb(JSON)``, keys in order; ``idle()`` where the verb is idle. Arguments of other verbs are null."""
    out = F.lit("idle()")
    for name, keys in VERBS.items():
        if all(k in arguments for k in keys):
            body = canonical(F.to_json(F.struct(*[arguments[k].alias(k) for k in sorted(keys)])))
            out = F.when(verb == name, F.concat(F.lit(f"{name}("), body, F.lit(")"))).otherwise(out)
    return out


def completion(body: Column) -> Column:
    return F.concat(F.lit("<action>"), body, F.lit("</action>"))


def compile_prompts(turns: DataFrame, session: str = "session_id", idx: str = "idx", event: str = "event_line", body: str = "action_body") -> DataFrame:
    """Each turn's prompt: earlier events and actions, the turn's event, the marker.

    Lines are gathered once a session and cut for each turn, so the window's
    state doesn't hold a prompt for every row.
    """
    both = F.struct(F.col(idx).alias("i"), F.col(event).alias("e"), completion(escape(F.col(body))).alias("a"))
    lines = turns.groupBy(session).agg(F.array_sort(F.collect_list(both)).alias("t"))
    each = lines.select(session, F.posexplode("t").alias("at", "now"), "t")
    past = F.transform(F.slice("t", F.lit(1), F.col("at")), lambda x: F.concat(x["e"], F.lit("\n"), x["a"]))
    return each.select(session, F.col("now.i").alias(idx), F.concat_ws("\n", past, F.col("now.e"), F.lit(MARKER)).alias("prompt"))


def parse_action(raw: Column) -> Column:
    """Strict parse: struct of verb, argument columns, valid and the reason if it is not.

    An action is valid if rendering what was read gives the same characters.
    """
    shape = r"(?s)\A<action>(idle\(\)|(\w+)\((\{.*\})\))</action>\z"
    verb = F.when(raw == "<action>idle()</action>", "idle").otherwise(F.regexp_extract(raw, shape, 2))
    body = F.regexp_extract(raw, shape, 3)
    keys = sorted({k for v in VERBS.values() for k in v})
    kinds = {k: t for v in VERBS.values() for k, t in v.items()}
    got = F.from_json(body, "struct<" + ",".join(f"`{k}`:{kinds[k]}" for k in keys) + ">")
    want = F.lit(None).cast("string")
    named = F.lit(False)
    filled = F.lit(True)
    for name, own in VERBS.items():
        here = verb == name
        named = named | here
        have = F.lit(True)
        for k, t in own.items():
            have = have & got[k].isNotNull() & ((F.trim(got[k]) != "") if t == "string" and k in ("message", "task", "query", "quote") else F.lit(True))
        filled = F.when(here, F.coalesce(have, F.lit(False))).otherwise(filled)
        text = canonical(F.to_json(F.struct(*[got[k].alias(k) for k in sorted(own)])))
        want = F.when(here, F.concat(F.lit(f"<action>{name}("), text, F.lit(")</action>"))).otherwise(want)
    want = F.when(verb == "idle", F.lit("<action>idle()</action>")).otherwise(want)
    reason = (
        F.when(raw.isNull() | ~raw.rlike(shape), "not an action")
        .when((verb != "idle") & ~named, "unknown verb")
        .when(~filled, "missing or blank argument")
        .when(~raw.eqNullSafe(want), "not canonical")
    )
    return F.struct(F.when(reason.isNull(), verb).otherwise("invalid").alias("verb"), reason.isNull().alias("valid"), reason.alias("reason"), *[F.when(reason.isNull(), got[k]).alias(k) for k in keys])
