"""Text predicates and spans: matches with places, unique quotes, wording checks, legacy actions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidewright.functions.grammar import MARKER, unescape
from tidewright.functions.scalars import head_tail

#: Words of the wording checks, lengths and ratios of translations.
COMMAND_WORDS = ["respond", "suggest", "edit", "correct", "highlight", "delegate", "search", "remind", "translate", "wait"]
SPEECH_WORDS = ["said", "told", "explained", "asked", "reported", "mentioned", "suggested", "confirmed", "requested", "proposed", "recommended", "warned", "noted", "replied", "claimed", "announced"]
VAGUE_TIMES = ["later", "soon", "sometime", "in a while", "after a while"]
VAGUE_AMOUNTS = ["a few", "a couple", "a couple of", "several", "some", "many", "a bunch", "a bunch of"]
CLOCK = r"\bat\s+(?:one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|[0-9]{1,2})\b"
DAY_PART = r"\b(?:a\.?m\.?|p\.?m\.?|morning|afternoon|evening|tonight|tomorrow|today)\b"
DAY_PART_REACH = 24
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
LENGTH_RATIO, LENGTH_RATIO_FROM = (0.12, 1.30), 20
PROMPT_MARKUP = r"<action>|</action>|<stream_event|<PREDICT_THIS_ACTION>|\bidle\(\)|\brespond\(\{|\bsuggest_edit\(|\bhighlight\(|\bdelegate\("


def any_word(words: list[str]) -> str:
    """A pattern of whole words, longest first, whatever their case."""
    return r"(?iU)\b(?:" + "|".join(re.escape(w) for w in sorted(set(words), key=lambda w: (-len(w), w))) + r")\b"


def spans(text: Column, pattern: str) -> Column:
    """Matches in order: array of (start, end, surface), code points from 0.

    Places come from the lengths between and of matches, so no Python is needed.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    none = F.array().cast("array<struct<start:int,end:int,surface:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["m"].alias("surface"))).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]


def overlapping_count(text: Column, quote: Column) -> Column:
    """Occurrences that may overlap, in one pass; 0 of the empty quote."""
    quoted = F.concat(F.lit(r"(?s)(?=\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    return F.when(F.length(quote) > 0, F.regexp_count(text, quoted)).otherwise(0)


def unique_quote(text: Column, start: Column, end: Column) -> Column:
    """The span, or as many words before it in its line as make it occur once; null if none do."""
    head = F.left(text, start)
    line = F.substring_index(head, "\n", -1)
    base = F.length(head) - F.length(line)
    place = F.sequence(F.lit(0), F.length(line))
    opens = F.filter(place, lambda i: (i == F.length(line)) | (i == 0) | ((F.substring(line, i + 1, F.lit(1)) != " ") & (F.substring(line, i, F.lit(1)) == " ")))
    quotes = F.transform(F.reverse(opens), lambda i: F.substring(text, base + i + 1, end - base - i))
    return F.get(F.filter(quotes, lambda q: overlapping_count(text, q) == 1), F.lit(0))


def occurrence_at(text: Column, quote: Column, start: Column) -> Column:
    """Which occurrence of the quote, from 1, begins at ``start``; null if none does."""
    here = F.substring(text, start + 1, F.length(quote)) == quote
    return F.when(here, overlapping_count(F.left(text, start + F.length(quote)), quote))


def trap_flags(text: Column) -> Column:
    """Signs of wording traps, in order: quoted question, question, command word, reported speech."""
    return F.array_compact(
        F.array(
            F.when(text.rlike('["\\x{201C}][^"\\x{201D}]*\\?[^"\\x{201D}]*["\\x{201D}]'), "quoted_question"),
            F.when(F.contains(text, F.lit("?")), "question"),
            F.when(text.rlike(any_word(COMMAND_WORDS)), "command_word"),
            F.when(text.rlike(any_word(SPEECH_WORDS)), "reported_speech"),
        )
    )


def vague_time(text: Column) -> Column:
    """A relative time, or a clock time without a part of the day close behind it."""
    near = lambda s: F.substring(text, s["start"] + 1, F.length(s["surface"]) + DAY_PART_REACH)
    return text.rlike(any_word(VAGUE_TIMES)) | F.exists(spans(text, "(?iU)" + CLOCK), lambda s: ~near(s).rlike("(?iU)" + DAY_PART))


def vague_amount(text: Column) -> Column:
    return text.rlike(any_word(VAGUE_AMOUNTS))


def translation_errors(reference: Column, source: Column, allowed: list[str] = (), space: str = r"\s") -> Column:
    """What is wrong with a Chinese rendering of an English text, as codes; meaning is not looked at.

    ``space``: the characters taken off both ends, as a pattern of one; all white space, unless given.
    """
    ends = rf"(?U)^(?:{space})+|(?:{space})+\z"
    bare, origin = F.regexp_replace(reference, ends, ""), F.regexp_replace(source, ends, "")
    latin = F.filter(F.regexp_extract_all(F.lower(bare), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin([a.lower() for a in allowed]) if allowed else F.lit(True))
    ratio = F.length(bare) / F.nullif(F.length(origin), F.lit(0))
    low, high = LENGTH_RATIO
    found = F.array_compact(
        F.array(
            F.when(reference != bare, "outer space"),
            F.when(~bare.rlike(HAN), "no han"),
            F.when(bare == origin, "echo"),
            F.when(reference.rlike(PROMPT_MARKUP) | reference.rlike("[<>&]"), "markup"),
            F.when(F.size(latin) > 0, "latin"),
            F.when(bare.rlike(r"(?<![0-9])[,.;:?!](?![0-9])"), "half width"),
            F.when((F.length(origin) >= LENGTH_RATIO_FROM) & ~ratio.between(low, high), "length"),
        )
    )
    return F.when(bare == "", F.array(F.lit("empty"))).otherwise(found)


@F.pandas_udf(ArrayType(StringType()))
def scoring_tokens(text: pd.Series) -> pd.Series:
    """Words of the compatibility-composed, case-folded text; Spark has neither of the two. Null: none."""
    word = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
    return text.map(lambda s: word.findall(unicodedata.normalize("NFKC", s).casefold()) if s else [])


def fill(template: Column, **values: Column) -> Column:
    """``{name}`` in a template as its value; null values leave their place."""
    for name, v in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(v.cast("string"), F.lit("{" + name + "}")))
    return template


def safe_label(v: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(v, "[^A-Za-z0-9_.-]+", "-"), r"^-+|-+\z", "")
    return F.when(clean == "", "eval").otherwise(clean)


def visible_text(prompt: Column) -> Column:
    """The text of a prompt's last event."""
    last = F.element_at(F.regexp_extract_all(prompt, F.lit(r"(?s)<stream_event [^>]*>(.*?)</stream_event>"), F.lit(1)), -1)
    return unescape(last)


def prompt_times(prompt: Column) -> Column:
    return F.transform(F.regexp_extract_all(prompt, F.lit(r'<stream_event [^>]*time="t\+([0-9]+)ms"'), F.lit(1)), lambda x: x.cast("long"))


def prompt_actions(prompt: Column) -> Column:
    """Bodies of the actions before a prompt's event, unescaped."""
    return F.transform(F.regexp_extract_all(prompt, F.lit(r"(?s)<action>(.*?)</action>"), F.lit(1)), unescape)


def condensed(prompt: Column, limit: int, share: int = 3, each: int = 1500) -> Column:
    """Earlier responses and the last event, cut in the middle to a budget."""
    turns = F.regexp_extract_all(prompt, F.lit(r"(?s)(<stream_event [^>]*>[^<]*</stream_event>\n<action>respond\([^<]*</action>)"), F.lit(1))
    last = F.element_at(F.regexp_extract_all(prompt, F.lit(r"(?s)<stream_event [^>]*>.*?</stream_event>"), F.lit(0)), -1)
    prior = F.array_join(turns, "\n")
    part = F.when(F.size(turns) > 0, F.concat(F.lit("<prior_responses>\n"), head_tail(prior, min(limit // share, each * 2), "\n[...]\n"), F.lit("\n</prior_responses>")))
    return F.concat_ws("\n", part, head_tail(last, limit - limit // share, "\n[...]\n"))


def with_note(prompt: Column, note: Column) -> Column:
    """A JSON note before the marker."""
    return F.concat(F.substring_index(prompt, MARKER, 1), note, F.lit("\n" + MARKER))


def json_value(text: Column) -> Column:
    """The text as one JSON value, null if it isn't one; Spark's parser alone lets pass what follows a value."""
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"end"]')))
    return F.when(F.try_variant_get(both, "$[1]", "string") == "end", F.try_variant_get(both, "$[0]", "variant"))


def legacy_action(raw: Column) -> Column:
    """Lenient parse of the older format: struct of kind, tool, target, message.

    Outer space and escapes are taken off; the body is ``idle()``,
    ``tool(name, {...})`` or ``respond({"for": n, "message": "..."})``; anything
    else is invalid.
    """
    bare = F.regexp_replace(raw, r"(?U)^\s+|\s+\z", "")
    body = F.regexp_replace(unescape(F.regexp_extract(bare, r"(?s)\A<action>(.+)</action>\z", 1)), r"(?U)^\s+|\s+\z", "")
    tool = F.regexp_extract(body, r"(?s)\Atool\(([A-Za-z_][A-Za-z0-9_.-]*),\s*(\{.*\})\)\z", 1)
    tool_json = json_value(F.regexp_extract(body, r"(?s)\Atool\(([A-Za-z_][A-Za-z0-9_.-]*),\s*(\{.*\})\)\z", 2))
    said = json_value(F.regexp_extract(body, r"(?s)\Arespond\((\{.*\})\)\z", 1))
    typed = lambda path, kind: F.schema_of_variant(F.try_variant_get(said, path, "variant")) == kind
    target = F.when(typed("$.for", "BIGINT"), F.try_variant_get(said, "$.for", "bigint"))
    message = F.when(typed("$.message", "STRING"), F.regexp_replace(F.try_variant_get(said, "$.message", "string"), r"(?U)^\s+|\s+\z", ""))
    kind = (
        F.when(body == "idle()", "idle")
        .when((tool != "") & tool_json.isNotNull(), "tool")
        .when((target > 0) & (message != ""), "respond")
        .otherwise("invalid")
    )
    return F.struct(kind.alias("kind"), F.when(kind == "tool", tool).alias("tool"), F.when(kind == "respond", target).alias("target"), F.when(kind == "respond", message).alias("message"))


def numeric_answer(raw: Column) -> Column:
    """Strict numbers of a due-time answer: null unless exactly the five keys hold integers and a boolean."""
    #: Keys of the answer.
    keys = ["interval_ms", "anchor_ms", "now_ms", "elapsed_ms", "due"]
    v = json_value(F.regexp_replace(raw, r"(?U)^\s+|\s+\z", ""))
    shape = F.schema_of_variant(v)
    want = "OBJECT<" + ", ".join(f"{k}: {'BOOLEAN' if k == 'due' else 'BIGINT'}" for k in sorted(keys)) + ">"
    fields = [F.try_variant_get(v, f"$.{k}", "boolean" if k == "due" else "bigint").alias(k) for k in keys]
    return F.when(shape == want, F.struct(*fields))
