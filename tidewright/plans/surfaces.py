"""Queries of the older surfaces' action checks and of the demo policy, with their SQL.

Events of a user stand in for a session's turns; their fields pick the actions.
Conversations hold no questions, so some of their rows get a mark of one.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.operators import validation as V
from tidewright.plans.registry import query, t

NEEDLES = ("e", "click", "r", "zz")


def acted(spark, d):
    """Events as turns, numbered by time, with actions picked by their ``k``."""
    e = t(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.withColumn("idx", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    k, pick = F.col("k"), lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("k") % n + 1).cast("int"))
    tool_event = k % 7 == 0
    status = F.concat(F.lit('{"status":"'), F.when(k % 14 == 0, "completed").otherwise("failed"), F.lit('"}'))
    return e.select(
        F.col("user_id").alias("session_id"), "idx",
        F.when(tool_event, "tool").otherwise("user").alias("source"),
        F.when(F.col("event_type") == "view", "idle").otherwise("active").alias("state"),
        F.when(tool_event, "web_search").alias("tool_name"),
        F.when(tool_event, status).otherwise(F.concat_ws(" ", "event_type", "event_type")).alias("content"),
        pick(4, "idle", "respond", "tool", "tool").alias("kind"),
        (k % 10 != 9).alias("valid"),
        (F.col("idx") - k % 3 + F.when(k % 11 == 0, 5).otherwise(0)).cast("long").alias("target"),
        pick(5, "web_search", "generate_ui", "suggest_edit", "ui", "odd").alias("tool"),
        F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("Q  "), (k % 9).cast("string"))).alias("query"),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("Build "), (k % 17).cast("string"), F.lit("!"))).alias("request"),
        F.when(k % 6 == 0, "other").otherwise("highlight").alias("operation"),
        pick(4, *NEEDLES).alias("quote"),
        (k % 3).cast("long").alias("occurrence"),
        F.when(k % 8 == 3, F.lit("r")).otherwise(F.lit(" new ")).alias("replacement"),
        F.when(F.col("user_id") % 5 == 0, F.array(F.lit("web_search"))).otherwise(F.array(*map(F.lit, ("web_search", "highlight", "generate_ui", "suggest_edit")))).alias("permissions"),
    )


SQL_ACTED = """e AS (SELECT *, CAST(props->>'$.k' AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events),
acted AS (SELECT user_id AS session_id, idx, k % 7 <> 0 AS user, event_type = 'view' AS idle, k % 14 = 0 AS completed, event_type || ' ' || event_type AS content,
  ['idle', 'respond', 'tool', 'tool'][k % 4 + 1] AS kind, k % 10 <> 9 AS valid, idx - k % 3 + CASE WHEN k % 11 = 0 THEN 5 ELSE 0 END AS target,
  ['web_search', 'generate_ui', 'suggest_edit', 'ui', 'odd'][k % 5 + 1] AS tool, k % 13 = 0 AS blank, k % 9 AS query, k % 17 AS request, k % 6 <> 0 AS highlight,
  ['e', 'click', 'r', 'zz'][k % 4 + 1] AS quote, k % 3 AS occurrence, CASE WHEN k % 8 = 3 THEN 'r' ELSE 'new' END AS replacement, user_id % 5 <> 0 AS full_rights FROM e),
x AS (SELECT a.*, coalesce(b.user, false) AS to_user, coalesce(NOT b.user, false) AS to_result, coalesce(NOT b.user AND b.completed, false) AS to_completed,
  a.user AND (length(a.content) - length(replace(a.content, a.quote, ''))) / length(a.quote) >= a.occurrence AS there
  FROM acted a LEFT JOIN acted b ON b.session_id = a.session_id AND b.idx = a.target AND b.idx <= a.idx)"""


def quoted(name: str) -> str:
    return "'" + V.SAYS[name].replace("'", "''") + "'"


def sql_case(*rules: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {broken} THEN {quoted(name)}" for broken, name in rules) + " END"


def sql_validated(own: str, found: str, target: str, span_tool: str, twice: dict[str, str]) -> str:
    respond = sql_case(("NOT user", "respond source"), (f"{found} AND NOT idle", "respond idle"), (f"NOT {found} AND NOT to_user", target))
    again = " ".join(f"WHEN tool = '{k}' THEN {quoted(v)}" for k, v in twice.items())
    return f"""WITH {SQL_ACTED}, c AS (SELECT *, CASE WHEN valid THEN CASE kind WHEN 'respond' THEN {respond} WHEN 'tool' THEN {own} END END AS first_error FROM x),
y AS (SELECT *, CASE WHEN NOT valid OR first_error IS NOT NULL OR kind = 'idle' THEN NULL WHEN kind = 'respond' THEN 'r' || target WHEN tool = 'web_search' THEN 'q' || query WHEN tool = 'generate_ui' THEN 'u' || request WHEN tool = '{span_tool}' THEN 's' || quote || occurrence END AS key FROM c),
g AS (SELECT *, CASE WHEN key[1] = 's' THEN (SELECT count(*) FROM acted o WHERE o.session_id = y.session_id AND o.idx < y.idx AND o.user AND (length(o.content) - length(replace(o.content, y.quote, ''))) / length(y.quote) < y.occurrence) ELSE 0 END AS life FROM y),
n AS (SELECT *, CASE WHEN key IS NOT NULL THEN row_number() OVER (PARTITION BY session_id, key, life ORDER BY idx) END AS turn FROM g),
f AS (SELECT session_id, idx, valid, CASE WHEN first_error IS NOT NULL THEN first_error WHEN turn > 1 THEN CASE WHEN kind = 'respond' THEN {quoted("answered")} {again} END END AS error FROM n)
SELECT session_id, idx, valid AND error IS NULL AS accepted, error FROM f"""


SQL_LEGACY = f"""CASE tool WHEN 'web_search' THEN {sql_case(("NOT user", "search source"), ("blank", "query"))}
WHEN 'ui' THEN {sql_case(("NOT user", "ui source"), ("NOT highlight", "ui operation"), ("NOT full_rights", "ui permission"), ("occurrence < 1", "ui occurrence"), ("NOT there", "ui missing"))}
ELSE 'Tool ''' || tool || ''' is not registered.' END"""
SQL_V6 = f"""CASE WHEN tool IN ('ui', 'odd') THEN 'Tool ''' || tool || ''' is not part of this surface.' WHEN NOT full_rights AND tool <> 'web_search' THEN 'Tool ''' || tool || ''' is not permitted.' WHEN NOT user THEN {quoted("tools source")}
WHEN tool = 'web_search' THEN {sql_case(("blank", "query"))} WHEN tool = 'generate_ui' THEN {sql_case(("blank", "request"))}
ELSE {sql_case(("occurrence < 1", "edit occurrence"), ("replacement = quote", "edit same"), ("NOT there", "edit missing"))} END"""


@query(sql_validated(SQL_V6, "to_completed", "respond target v6", "suggest_edit", {"web_search": "same search", "generate_ui": "same request", "suggest_edit": "edit twice"}))
def t05_v6_validation(spark, d):
    return V.validate(acted(spark, d), "v6")


@query(sql_validated(SQL_LEGACY, "to_result", "respond target", "ui", {"web_search": "same search", "ui": "ui twice"}))
def t06_legacy_validation(spark, d):
    return V.validate(acted(spark, d), "legacy")


@query(r"""WITH c AS (SELECT * REPLACE (text || CASE WHEN (conv_id + turn) % 4 < 2 THEN ' ?' ELSE '' END AS text), CASE WHEN turn % 3 = 0 THEN substr(text, 1, 12) END AS query, role <> 'user' AS result, trim(regexp_replace(lower(CASE WHEN turn % 3 = 0 THEN substr(text, 1, 12) END), '\s+', ' ', 'g')) AS asked FROM conversations),
s AS (SELECT *, sum((coalesce(query, '') <> '')::INT - result::INT) OVER w AS total FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
l AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY conv_id ORDER BY turn)) AS pending FROM s),
b AS (SELECT conv_id, turn, NOT result AS user, text, coalesce(lag(pending) OVER w, 0) AS pending, list(asked) FILTER (coalesce(query, '') <> '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, trim(right(trim(regexp_replace(text, '\s+', ' ', 'g')), 240), ' ,.;:') AS search FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS session_id, turn AS idx, CASE WHEN user AND regexp_matches(text, '(?i)(\?|\bwhat\b|\bwho\b|\bwhen\b|\bwhere\b|\bwhich\b|\bhow many\b|\bi wonder\b|\blook up\b|\bsearch for\b)') AND pending = 0 AND search <> '' AND len(list_filter(coalesce(before, []), lambda q: contains(lower(search), q))) = 0 THEN search END AS search FROM b""")
def t18_demo_policy(spark, d):
    c = t(spark, d, "conversations")
    source = F.when(F.col("role") == "user", "user").otherwise("tool")
    tool_name = F.when(F.col("role") != "user", "web_search")
    asked = F.when(F.col("turn") % 3 == 0, F.substring("text", 1, 12))
    return V.demo_queries(c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("idx"), source.alias("source"), tool_name.alias("tool_name"), F.concat("text", F.when((F.col("conv_id") + F.col("turn")) % 4 < 2, " ?").otherwise("")).alias("content"), asked.alias("query")))
