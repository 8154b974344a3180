"""Compilers, record rules, corpus gates and audits over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import grammar as G
from tidewright.functions import scalars as S
from tidewright.functions import text as X
from tidewright.operators import compilers as C
from tidewright.operators import evaluation as E
from tidewright.operators import quality as V
from tidewright.operators import sequences as W
from tidewright.plans.registry import SQL_TURNS, query, sql_hash, t, turns


def sql_int(key: str, low: int, high: int) -> str:
    return f"({low} + {sql_hash(key)} % {high - low + 1})::BIGINT"


def scene_records(spark, d):
    """Benchmark items as scenes: sentences are segments, the last one addresses the reader."""
    parts = F.split("text", r"\. ")
    seg = F.transform(parts, lambda s, i: F.struct(F.when(i == F.size(parts) - 1, "address").otherwise("narration").alias("kind"), s.alias("text"), F.element_at(F.array(*map(F.lit, C.PAUSES)), (i % 4 + 1).cast("int")).alias("pause_after"), F.when(i == F.size(parts) - 1, "Noted.").alias("gold_reply"), F.when(F.contains(s, F.lit(",")), F.array(F.lit("aside"))).otherwise(F.array(F.lit("none"))).alias("traps")))
    return t(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), seg.alias("segments"))


@query(f"SELECT doc_id, {sql_int("doc_id || ':segment:0:tick:1:time'", 520, 820)} AS typing_ms, CASE doc_id % 2 WHEN 0 THEN {sql_int("doc_id || ':pause'", 1000, 3000)} ELSE {sql_int("doc_id || ':pause'", 10000, 30000)} END AS pause_ms FROM documents")
def c02_gaps(spark, d):
    i = F.col("doc_id").cast("string")
    kind = F.when(F.col("doc_id") % 2 == 0, "short").otherwise("long")
    return t(spark, d, "documents").select("doc_id", S.stable_int(F.concat(i, F.lit(":segment:0:tick:1:time")), *C.TYPING).alias("typing_ms"), C.pause(F.concat(i, F.lit(":pause")), kind).alias("pause_ms"))


@query()
def c03_scenes(spark, d):
    return C.scenes(scene_records(spark, d))


@query(f"SELECT doc_id, 'v' || v AS variant, v IN (1, 2, 3) AS lead_unchanged, v IN (0, 1, 2) AS clear, v = 2 AS tail_unchanged, {sql_int("doc_id || ':midpause'", 0, 2)} = 0 AS mid_long_pause FROM (SELECT doc_id, {sql_int("doc_id || ':skeleton'", 0, 3)} AS v FROM documents)")
def c06_skeleton(spark, d):
    return t(spark, d, "documents").select("doc_id", C.skeleton(F.col("doc_id").cast("string")).alias("s")).select("doc_id", "s.*")


@query(f"""WITH r AS (SELECT item_id::VARCHAR AS id, row_number() OVER (ORDER BY item_id::VARCHAR) - 1 AS a, count(*) OVER () AS n FROM benchmark), c AS (SELECT doc_id::VARCHAR AS id, row_number() OVER (ORDER BY doc_id::VARCHAR) - 1 AS a, count(*) OVER () AS n FROM documents WHERE lang = 'en'),
g AS (SELECT doc_id::VARCHAR AS id, row_number() OVER (ORDER BY doc_id::VARCHAR) - 1 AS a, count(*) OVER () AS n FROM documents WHERE lang = 'de'), p AS (SELECT range AS i, id AS request_id, 'plan-' || id || '-v' || range // n AS episode, ['check', 'nudge', 'plain'][(range % 3 + 1)::INT] AS content, CASE WHEN range % 5 = 0 THEN 'failure' ELSE 'success' END AS outcome FROM range(400), r WHERE a = range % n)
SELECT episode, request_id, content, outcome, CASE WHEN content = 'check' THEN (SELECT id FROM c WHERE a = {sql_hash("episode || ':check_id'")} % n) END AS check_id, CASE WHEN content = 'nudge' THEN (SELECT id FROM g WHERE a = {sql_hash("episode || ':nudge_id'")} % n) END AS nudge_id, CASE WHEN outcome = 'failure' THEN (SELECT id FROM c WHERE a = {sql_hash("episode || ':failure_id'")} % n) END AS failure_id FROM p""")
def c11_expanded(spark, d):
    x = t(spark, d, "documents")
    return C.expanded(spark, t(spark, d, "benchmark").select(F.col("item_id").alias("id")), x.where("lang = 'en'").select(F.col("doc_id").alias("id")), x.where("lang = 'de'").select(F.col("doc_id").alias("id")), 400)


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN '{\"status\":\"failed\",\"task\":\"' || event_type || '\",\"error\":\"timeout\"}' ELSE '{\"status\":\"completed\",\"task\":\"' || event_type || '\"}' END AS payload FROM events")
def c13_payloads(spark, d):
    bad = F.col("event_type") == "error"
    body = C.payload(status=F.when(bad, "failed").otherwise("completed"), task=F.col("event_type"), error=F.when(bad, "timeout"))
    return t(spark, d, "events").select("event_id", body.alias("payload"))


SQL_EVERY = f"{sql_int("id || ':kind'", 0, 2)} > 0"


@query(f"""WITH s AS (SELECT doc_id AS id FROM documents), k AS (SELECT id AS doc_id, CASE WHEN {SQL_EVERY} THEN 'every' ELSE 'once' END AS schedule_kind, CASE WHEN {SQL_EVERY} THEN [10, 15, 20, 30][(1 + {sql_int("id || ':interval'", 0, 3)})::INT] END AS interval_s, CASE WHEN {SQL_EVERY} THEN {sql_int("id || ':fire-cycles'", 2, 3)} ELSE 1 END AS fire_cycles,
CASE WHEN {SQL_EVERY} THEN ['none', 'early', 'late'][(1 + {sql_int("id || ':cancel-variant'", 0, 2)})::INT] ELSE 'none' END AS cancel_variant FROM s) SELECT *, CASE WHEN cancel_variant = 'none' THEN ['none', 'bait', 'address', 'both'][(1 + {sql_int("doc_id || ':collision'", 0, 3)})::INT] ELSE 'none' END AS collision FROM k""")
def c14_schedules(spark, d):
    return C.schedules(t(spark, d, "documents").select("doc_id"), "doc_id", [10, 15, 20, 30], ["none", "early", "late"])


@query()
def c17_tick_scripts(spark, d):
    c = t(spark, d, "conversations")
    kind = F.when(F.col("role") == "user", "type").when(F.col("turn") % 3 == 0, "backtrack").otherwise("pause")
    step = F.struct("turn", kind.alias("kind"), F.col("text"), (F.col("turn") + 2).cast("int").alias("count"), F.when(kind == "type", "respond").otherwise("idle").alias("expect"))
    return C.tick_scripts(c.groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(step)).alias("steps")))


@query("SELECT s AS scenario, range AS tick, CASE s WHEN 'silent' THEN '' WHEN 'steady' THEN 'Rain fell. ' ELSE substr(repeat('Rain fell. ', ceil(range * 4 / 11)::INT), 1, (range * 4)::INT) END AS content, range * 650 AS elapsed_ms FROM range(1, 121), (VALUES ('silent'), ('steady'), ('typing')) v(s)")
def c20_growth(spark, d):
    return C.growth(spark, F.array(*map(F.lit, ("silent", "steady", "typing"))), "Rain fell. ", 120, 4)


@query("""WITH s AS (SELECT item_id, string_split(text, '. ') AS p FROM benchmark) SELECT 'b' || item_id AS id, unnest(list_filter([CASE WHEN len(p) NOT BETWEEN 5 AND 9 THEN 'segments' END, CASE WHEN len(p) - 1 NOT BETWEEN 4 AND 8 THEN 'narrations' END], lambda x: x IS NOT NULL)) AS error FROM s""")
def v01_scene_rules(spark, d):
    return V.rule_rows(scene_records(spark, d), "id", V.scene_rules())


@query("SELECT name, share, share BETWEEN low AND high AS passed FROM (SELECT 'english' AS name, round_even(avg((lang = 'en')::INT), 6) AS share, 0.2 AS low, 0.8 AS high FROM documents UNION ALL SELECT 'long', round_even(avg((n_chars >= 900)::INT), 6), 0.5, 1.0 FROM documents UNION ALL SELECT 'unlabelled', round_even(avg((source = 'none')::INT), 6), 0.0, 0.1 FROM documents)")
def v10_corpus_gates(spark, d):
    return V.bounded_shares(t(spark, d, "documents"), {"english": (F.col("lang") == "en", 0.2, 0.8), "long": (F.col("n_chars") >= 900, 0.5, 1.0), "unlabelled": (F.col("source") == "none", 0.0, 0.1)})


@query("SELECT item_id, unnest(list_filter([CASE WHEN length(text) NOT BETWEEN 16 AND 200 THEN 'length' END, CASE WHEN contains(text, '{interval}') THEN 'template' END, CASE WHEN NOT regexp_matches(text, '[.?!]$') THEN 'no full stop' END], lambda x: x IS NOT NULL)) AS error FROM benchmark")
def v13_bank_rules(spark, d):
    x = F.col("text")
    return V.rule_rows(t(spark, d, "benchmark"), "item_id", {"length": ~F.length(x).between(16, 200), "template": F.contains(x, F.lit("{interval}")), "no full stop": ~x.rlike(r"[.?!]\z")})


@query(f"""WITH {SQL_TURNS}, b AS (SELECT session_id, count(*) FILTER (verb = 'respond') OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM turns)
SELECT CASE WHEN before > 0 THEN 'agree' ELSE 'unverifiable' END AS outcome, count(*) AS n FROM b GROUP BY 1""")
def v17_recomputed_due(spark, d):
    x = turns(spark, d)
    gold = W.anchors(x, "session_id", "idx", "elapsed_ms", F.lit(False), F.col("verb") == "respond", 2000).select("session_id", "idx", "due")
    p = G.compile_prompts(x).select("session_id", "idx", X.prompt_times(F.col("prompt")).alias("times"), X.prompt_actions(F.col("prompt")).alias("acts"))
    first = F.array_position(F.transform("acts", lambda a: a.startswith("respond(")), F.lit(True)).cast("int")
    anchor = F.when(first > 0, F.get("times", first - 1))
    due = F.element_at("times", -1) - anchor >= 2000
    outcome = F.when(anchor.isNull(), "unverifiable").when(due == F.col("due"), "agree").otherwise("disagree")
    return p.join(gold, ["session_id", "idx"]).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {SQL_TURNS} SELECT session_id, idx, verb = 'respond' AND session_id % 3 = 0 AS violation FROM turns")
def e05_permissions(spark, d):
    granted = F.when(F.col("session_id") % 3 == 0, F.array(F.lit("search"))).otherwise(F.array(F.lit("search"), F.lit("message")))
    needs = {"respond": "message", "web_search": "search", "delegate": "jobs", "suggest_edit": "edit", "highlight": "edit"}
    return turns(spark, d).select("session_id", "idx", E.violates(F.col("verb"), granted, needs).alias("violation"))


@query("""WITH x AS (SELECT source, avg(quality) AS now, avg(1 - toxic) AS before, sum(doc_id) % 2 = 0 AS same FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT source, CASE WHEN NOT same THEN 'not enforced' WHEN now > before THEN 'passed' ELSE 'failed' END AS outcome FROM x""")
def e23_beat_previous(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    x = rows.groupBy("source").agg(F.avg("quality").alias("now"), F.avg(1 - F.col("toxic")).alias("before"), (F.sum("doc_id") % 2 == 0).alias("same"))
    return x.select("source", E.beats(F.col("now"), F.col("before"), F.col("same")).alias("outcome"))
