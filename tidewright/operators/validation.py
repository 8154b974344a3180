"""Action checks of the two older surfaces, and the demo policy, over whole tables of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import scalars as S

#: What a rejected action is told.
SAYS = {
    "respond source": "Responses may only be surfaced on a user event.",
    "respond idle": "Responses may only be surfaced when the user is idle.",
    "respond target": "Respond target must be a web_search result or a user event.",
    "respond target v6": "Respond target must be a completed web_search result or a user event.",
    "answered": "That event has already been answered.",
    "search source": "web_search may only be called from a user event.",
    "search permission": "web_search permission is not available.",
    "query": 'web_search requires a non-empty string "query".',
    "same search": "An equivalent web_search is already pending or complete.",
    "ui source": "UI actions may only be taken on a user event.",
    "ui operation": "The UI tool supports highlight operations.",
    "ui permission": "ui.highlight permission is not available.",
    "ui quote": 'ui.highlight target requires a non-empty "quote".',
    "ui occurrence": 'ui.highlight target "occurrence" must be a positive integer.',
    "ui missing": "ui.highlight target does not exist in the current text.",
    "ui twice": "ui.highlight target is already highlighted.",
    "tools source": "Tools may only be called from a user event.",
    "provider": "No UI generation provider is configured.",
    "request": 'generate_ui requires a non-empty string "request".',
    "same request": "An equivalent generate_ui job is already pending or complete.",
    "edit quote": 'suggest_edit target requires a non-empty "quote".',
    "edit occurrence": 'suggest_edit target "occurrence" must be a positive integer.',
    "edit replacement": 'suggest_edit requires a non-empty string "replacement".',
    "edit same": "suggest_edit replacement must differ from the quoted span.",
    "edit missing": "suggest_edit target does not exist in the current text.",
    "edit twice": "That span already has a live suggestion.",
}
#: Fixed value: what the demo policy takes for a question.
QUESTION = r"(?iu)(?:\?|\bwhat\b|\bwho\b|\bwhen\b|\bwhere\b|\bwhich\b|\bhow many\b|\bi wonder\b|\blook up\b|\bsearch for\b)"


def yes(c: Column) -> Column:
    """True where the condition holds; null counts as no."""
    return F.coalesce(c, F.lit(False))


def first_broken(rules: list[tuple[Column, str]]) -> Column:
    """The text of the first rule that is broken, null if none is."""
    return F.coalesce(*[F.when(yes(broken), F.lit(SAYS[name])) for broken, name in rules], F.lit(None).cast("string"))


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")) == "", F.lit(True))


def same_words(c: Column) -> Column:
    """A request as compared with earlier ones: lower case, single blanks, no closing marks."""
    return F.rtrim(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), F.lit("?.!"))


def span_there(text: Column, quote: Column, n: Column) -> Column:
    return yes(S.find_occurrence(text, quote, n) >= 0)


def validate(turns: DataFrame, surface: str = "legacy", provider: bool = True) -> DataFrame:
    """Each turn's action with ``accepted`` and, where it is rejected, ``error``.

    ``turns``: session_id, idx (unique in a session, in order), source (user or
    tool), state, tool_name (of a tool event), content, kind (idle, respond,
    tool), valid, target, tool, query, request, operation, quote, occurrence,
    replacement, permissions (array of names: ``web_search`` and ``highlight``
    on the legacy surface, tools on ``v6``). Nulls are missing values: a null
    source is no user, a null ``valid`` is an invalid action (error null, as one
    that came with its own), an empty table gives no rows.

    Rules that look back (answered, asked, highlighted before) count accepted
    actions alone. Of actions that pass all other rules and share a key the
    first is accepted, so one window over the keys decides; a highlight or a
    suggestion is forgotten at a user event that no longer holds its span, and
    its key begins anew after it. These spans meet the session's user events
    once each. Sessions are dealt by their id.
    """
    v6 = surface == "v6"
    user = F.col("source").eqNullSafe("user")
    past = turns.select("session_id", F.col("idx").alias("target"), F.struct("source", "tool_name", "content").alias("_to"))
    x = turns.join(past, ["session_id", "target"], "left")
    to = F.when(F.col("target") <= F.col("idx"), F.col("_to"))
    found = yes((to["source"] == "tool") & (to["tool_name"] == "web_search"))
    if v6:
        found = found & yes(F.get_json_object(to["content"], "$.status") == "completed")
    respond = [
        (~user, "respond source"),
        (found & ~F.col("state").eqNullSafe("idle"), "respond idle"),
        (~found & ~yes(to["source"] == "user"), "respond target v6" if v6 else "respond target"),
    ]
    tool, quote, n = F.col("tool"), F.col("quote"), F.col("occurrence")
    allowed = lambda name: yes(F.array_contains("permissions", name))
    gone = ~span_there(F.col("content"), quote, n)
    no_quote, no_place = F.coalesce(quote == "", F.lit(True)), F.coalesce(n < 1, F.lit(True))
    if v6:
        listed = F.coalesce(tool, F.lit(""))
        named = lambda end: F.concat(F.lit("Tool '"), listed, F.lit(f"' {end}"))
        kinds = {
            "web_search": [(blank(F.col("query")), "query")],
            "generate_ui": [(F.lit(not provider), "provider"), (blank(F.col("request")), "request")],
            "suggest_edit": [(no_quote, "edit quote"), (no_place, "edit occurrence"), (blank(F.col("replacement")), "edit replacement"), (F.trim("replacement") == quote, "edit same"), (gone, "edit missing")],
        }
        any_tool = F.when(~listed.isin(*kinds), named("is not part of this surface.")).when(~yes(F.array_contains(F.col("permissions"), listed)), named("is not permitted."))
        any_tool = any_tool.when(~user, F.lit(SAYS["tools source"]))
        twice = {"web_search": "same search", "generate_ui": "same request", "suggest_edit": "edit twice"}
        overlay = "suggest_edit"
    else:
        kinds = {
            "web_search": [(~user, "search source"), (~allowed("web_search"), "search permission"), (blank(F.col("query")), "query")],
            "ui": [(~user, "ui source"), (~F.col("operation").eqNullSafe("highlight"), "ui operation"), (~allowed("highlight"), "ui permission"), (no_quote, "ui quote"), (no_place, "ui occurrence"), (gone, "ui missing")],
        }
        any_tool = F.when(~F.coalesce(tool, F.lit("")).isin(*kinds), F.concat(F.lit("Tool '"), F.coalesce(tool, F.lit("")), F.lit("' is not registered.")))
        twice = {"web_search": "same search", "ui": "ui twice"}
        overlay = "ui"
    is_tool = F.col("kind") == "tool"
    own = F.coalesce(any_tool, *[F.when(tool == k, first_broken(rules)) for k, rules in kinds.items()])
    error = F.when(F.col("kind") == "respond", first_broken(respond)).when(is_tool, own)
    key = (
        F.when(F.col("kind") == "respond", F.concat(F.lit("respond:"), F.col("target").cast("string")))
        .when(is_tool & (tool == "web_search"), F.concat(F.lit("search:"), same_words(F.col("query"))))
        .when(is_tool & (tool == "generate_ui"), F.concat(F.lit("request:"), same_words(F.col("request"))))
        .when(is_tool & (tool == overlay), F.concat(F.lit("span:"), n.cast("string"), F.lit(":"), quote))
    )
    ok = F.coalesce(F.col("valid"), F.lit(False))
    checked = x.withColumn("_ok", ok).withColumn("_error", F.when(F.col("_ok"), error)).withColumn("_passes", F.col("_ok") & F.col("_error").isNull())
    checked = checked.withColumn("_key", F.when(F.col("_passes"), key)).select("session_id", "idx", "kind", "tool", "quote", "occurrence", "_ok", "_error", "_key")
    spans = checked.where(F.col("_key").startswith("span:")).select("session_id", "_key", "quote", "occurrence").distinct()
    texts = turns.where(user).select("session_id", "idx", "content")
    lost = spans.join(texts, "session_id").where(~span_there(F.col("content"), quote, n)).select("session_id", "idx", "_key", F.lit(1).alias("_lost"))
    rows = checked.withColumn("_lost", F.lit(0)).unionByName(lost, allowMissingColumns=True)
    order = Window.partitionBy("session_id", "_key").orderBy("idx")
    rows = rows.withColumn("_life", F.sum("_lost").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_lost = 0")
    earlier = F.col("_key").isNotNull() & (F.row_number().over(Window.partitionBy("session_id", "_key", "_life").orderBy("idx")) > 1)
    again = F.when(F.col("kind") == "respond", F.lit(SAYS["answered"]))
    for name, told in twice.items():
        again = again.when(tool == name, F.lit(SAYS[told]))
    error = F.coalesce("_error", F.when(earlier, again))
    return rows.select("session_id", "idx", (F.col("_ok") & error.isNull()).alias("accepted"), error.alias("error"))


def demo_queries(turns: DataFrame) -> DataFrame:
    """The search that the demo policy asks for at each turn, null where it stays idle.

    ``turns``: session_id, idx, source, tool_name, content and ``query``, what
    the turn's own action asked (null or empty: nothing). A question is searched
    unless a search is pending or an earlier query is part of it. Pending
    searches never fall below zero: the sum of steps less its least value so far.
    """
    before = Window.partitionBy("session_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    asked = F.nullif(F.col("query"), F.lit(""))
    result = yes((F.col("source") == "tool") & (F.col("tool_name") == "web_search"))
    x = turns.withColumn("_sum", F.sum(asked.isNotNull().cast("int") - result.cast("int")).over(upto))
    x = x.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(upto))).withColumn("_left", F.col("_sum") - F.col("_low"))
    squeezed = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    x = x.withColumn("_pending", F.coalesce(F.last("_left").over(before), F.lit(0)))
    x = x.withColumn("_before", F.collect_list(squeezed(F.lower(asked))).over(before))
    query = F.btrim(F.right(squeezed(F.col("content")), F.lit(240)), F.lit(" ,.;:"))
    repeated = F.exists("_before", lambda q: F.contains(squeezed(F.lower(query)), q))
    asks = yes((F.col("source") == "user") & F.col("content").rlike(QUESTION)) & (F.col("_pending") == 0) & yes(query != "") & ~yes(repeated)
    return x.select("session_id", "idx", F.when(asks, query).alias("search"))
