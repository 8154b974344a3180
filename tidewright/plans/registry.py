"""Registered queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import grammar as G
from tidewright.functions import scalars as S
from tidewright.operators import evaluation as E
from tidewright.operators import quality as V
from tidewright.operators import selection as K
from tidewright.operators import sequences as W
from tidewright.streaming import session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


SQL_WORDS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9'']+', ' ', 'g'), ' '), lambda w: w <> '')"
SQL_WORDS_TEXT = SQL_WORDS.format("text")
SQL_NORM = "regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')"
SQL_OPENER = f"CASE WHEN ({SQL_WORDS_TEXT})[1] IN ('and','but','so','or','then','because') THEN coalesce(({SQL_WORDS_TEXT})[2], '') ELSE coalesce(({SQL_WORDS_TEXT})[1], '') END"


def sql_hash(key: str) -> str:
    return f"('0x' || substr(sha256({key}), 1, 16))::UBIGINT"


# --- scalar functions -----------------------------------------------------------


@query(f"SELECT doc_id, sha256({SQL_NORM}) AS norm_sha, regexp_replace(regexp_replace(lower(source || ' ' || lang), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def p01_normalize_slug(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2(S.normalized(F.col("text")), 256).alias("norm_sha"), S.slug(F.concat_ws(" ", "source", "lang")).alias("slug"))


@query(f"SELECT doc_id, array_to_string(({SQL_WORDS_TEXT})[1:7], ' ') AS prefix, {SQL_OPENER} AS opener FROM documents")
def p03_word_prefix(spark, d):
    return t(spark, d, "documents").select("doc_id", S.word_prefix(F.col("text"), 7).alias("prefix"), S.opener(F.col("text")).alias("opener"))


@query("SELECT doc_id, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 900 THEN 'medium' ELSE 'long' END AS bucket, CASE WHEN n_chars < 400 THEN 'short' WHEN n_chars < 700 THEN 'medium' ELSE 'long' END AS passage_bucket FROM documents")
def p07_length_bucket(spark, d):
    return t(spark, d, "documents").select("doc_id", S.length_bucket(F.col("n_chars"), "narration").alias("bucket"), S.length_bucket(F.col("n_chars"), "passage").alias("passage_bucket"))


@query("SELECT conv_id, turn, CASE WHEN (turn + 1) / n <= 1/3 THEN 'early' WHEN (turn + 1) / n <= 2/3 THEN 'middle' ELSE 'late' END AS bucket FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def p09_position_bucket(spark, d):
    c = t(spark, d, "conversations")
    n = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    return c.join(n, "conv_id").select("conv_id", "turn", S.position_bucket(F.col("turn") + 1, F.col("n")).alias("bucket"))


@query(f"SELECT doc_id, (520 + {sql_hash("'gap:' || doc_id")} % 301)::BIGINT AS gap_ms, ['none','short','long'][(1 + {sql_hash("'kind:' || doc_id")} % 3)::INT] AS kind, sha256(source || chr(0) || lang) AS digest FROM documents")
def p10_stable_int(spark, d):
    i = F.col("doc_id").cast("string")
    kinds = F.array(*map(F.lit, ("none", "short", "long")))
    return t(spark, d, "documents").select("doc_id", S.stable_int(F.concat(F.lit("gap:"), i), 520, 820).alias("gap_ms"), S.stable_choice(F.concat(F.lit("kind:"), i), kinds).alias("kind"), S.stable_digest(F.col("source"), F.col("lang")).alias("digest"))


@query("SELECT item_id, len(list_filter(range(1, greatest(length(text), 1) + 1), lambda i: substr(text, i, 2) = 'an'))::INT AS n, list_filter(range(1, greatest(length(text), 1) + 1), lambda i: substr(text, i, 2) = 'an')[2]::INT - 1 AS second FROM benchmark")
def p14_occurrences(spark, d):
    x, q = F.col("text"), F.lit("an")
    return t(spark, d, "benchmark").select("item_id", S.occurrence_count(x, q).alias("n"), S.find_occurrence(x, q, F.lit(2)).alias("second"))


@query("SELECT item_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 30) || ' ... ' || right(text, 30) ELSE text END AS short, regexp_replace(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '[?.!]+$', '') AS query FROM benchmark")
def p25_head_tail_query(spark, d):
    return t(spark, d, "benchmark").select("item_id", S.head_tail(F.col("text"), 60, " ... ").alias("short"), S.normalize_query(F.col("text")).alias("query"))


@query("SELECT event_id, props->>'$.k' AS k, greatest(1, floor(value * 1000 / 650))::BIGINT AS ticks FROM events")
def p27_payload_ticks(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), S.ticks_at(F.col("value")).alias("ticks"))


# --- grammar ----------------------------------------------------------------------


def turns(spark: SparkSession, d: str) -> DataFrame:
    """User rows as events, answered by the assistant row that follows if there is one."""
    c = t(spark, d, "conversations")
    w = W.Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("_r", F.lead("role").over(w)).withColumn("_t", F.lead("text").over(w)).where("role = 'user'")
    c = c.withColumn("idx", F.row_number().over(w)).withColumn("elapsed_ms", F.col("turn") * S.TICK_MS)
    verb = F.when(F.col("_r") == "assistant", "respond").otherwise("idle")
    line = G.event_line(F.col("idx"), F.lit("user"), F.col("text"), elapsed_ms=F.col("elapsed_ms"))
    body = G.action_body(verb, **{"for": F.col("idx"), "message": F.col("_t")})
    return c.select(F.col("conv_id").alias("session_id"), "idx", "text", "elapsed_ms", verb.alias("verb"), line.alias("event_line"), body.alias("action_body"))


SQL_ESC = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
SQL_TURNS = f"""c AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS m FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx FROM c WHERE role = 'user'),
turns AS (SELECT conv_id AS session_id, idx::INT AS idx, '<stream_event index="' || idx || '" source="user" time="t+' || turn * 650 || 'ms">' || {SQL_ESC.format('text')} || '</stream_event>' AS event_line,
  CASE WHEN r = 'assistant' THEN 'respond({{"for":' || idx || ',"message":' || to_json(m) || '}})' ELSE 'idle()' END AS action_body, CASE WHEN r = 'assistant' THEN 'respond' ELSE 'idle' END AS verb FROM u)"""


@query(f"WITH {SQL_TURNS} SELECT session_id, idx, event_line, action_body FROM turns")
def g01_event_and_action_lines(spark, d):
    return turns(spark, d).select("session_id", "idx", "event_line", "action_body")


@query(f"""WITH {SQL_TURNS}, l AS (SELECT *, event_line || chr(10) || '<action>' || {SQL_ESC.format('action_body')} || '</action>' AS line FROM turns)
SELECT session_id, idx, coalesce(array_to_string(list(line) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), chr(10)) || chr(10), '') || event_line || chr(10) || '<PREDICT_THIS_ACTION>' AS prompt FROM l""")
def g03_compile_prompt(spark, d):
    return G.compile_prompts(turns(spark, d))


@query(f"WITH {SQL_TURNS} SELECT session_id, idx, CASE WHEN idx % 5 = 3 THEN 'invalid' ELSE verb END AS verb, idx % 5 <> 3 AS valid FROM turns")
def g04_parse_action(spark, d):
    raw = G.completion(F.col("action_body"))
    broken = F.when(F.col("idx") % 5 == 3, F.concat(raw, F.lit(" "))).otherwise(raw)
    return turns(spark, d).withColumn("p", G.parse_action(broken)).select("session_id", "idx", "p.verb", "p.valid")


# --- joins --------------------------------------------------------------------------


def ticks(spark: SparkSession, d: str) -> DataFrame:
    """Events with milliseconds since 1970, whatever the session's time zone: ts has none."""
    since = "CAST(CAST(CAST(ts AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'1970-01-01 00:00:00' AS INTERVAL SECOND) AS DECIMAL(20, 6))"
    return t(spark, d, "events").withColumn("ms", F.expr(f"CAST(floor({since} * 1000) AS BIGINT)"))


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def j09_semi(spark, d):
    big = t(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return t(spark, d, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey").distinct()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def j10_anti(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events")
def j14_asof_backward(spark, d):
    e = t(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return W.last_earlier(e, "user_id", "o", F.col("event_type") == "click", "event_id", "before").select("event_id", "before")


@query("SELECT event_id, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM events")
def j15_asof_forward(spark, d):
    e = t(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return W.first_later(e, "user_id", "o", F.col("event_type") == "purchase", "event_id", "after").select("event_id", "after")


def ranges(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """An event's range: from its millisecond on, a hundred times its value long."""
    e = ticks(spark, d).where(F.col("event_type") == kind)
    return e.select("user_id", F.col("ms").alias("start"), (F.col("ms") + F.floor(F.col("value") * 100000)).alias("end"))


def sql_ranges(kind: str) -> str:
    return f"(SELECT user_id, (epoch_us(ts) // 1000) AS s, (epoch_us(ts) // 1000) + floor(value * 100000)::BIGINT AS e FROM events WHERE event_type = '{kind}')"


@query(f"SELECT user_id, s AS start, e AS \"end\" FROM {sql_ranges('click')} a WHERE NOT EXISTS (SELECT 1 FROM {sql_ranges('error')} b WHERE a.user_id = b.user_id AND a.s < b.e AND b.s < a.e)")
def j19_overlap_anti(spark, d):
    return W.overlap_anti(ranges(spark, d, "click"), ranges(spark, d, "error"), "user_id")


# --- windows ------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN starts_with(event_type, lag(event_type) OVER w) THEN length(event_type) - length(lag(event_type) OVER w) END AS typed, (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER w AS gap_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w01_deltas(spark, d):
    e = ticks(spark, d).withColumn("o", F.struct("ts", "event_id"))
    return W.deltas(e, "user_id", "o", F.col("event_type"), F.col("ms")).select("event_id", "typed", "gap_ms")


@query(f"SELECT event_id, sum((520 + {sql_hash("'d:' || event_id")} % 301)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS elapsed_ms FROM events")
def w02_running_elapsed(spark, d):
    gap = S.stable_int(F.concat(F.lit("d:"), F.col("event_id").cast("string")), 520, 820)
    return W.running(t(spark, d, "events"), "user_id", "event_id", gap, "elapsed_ms").select("event_id", "elapsed_ms")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY sha256('s:' || event_id)) - 1 AS round FROM events")
def w04_round_robin(spark, d):
    e = W.round_robin(t(spark, d, "events"), "user_id", F.concat(F.lit("s:"), F.col("event_id").cast("string")))
    return e.select("event_id", F.col("round").cast("long").alias("round"))


@query("SELECT event_id, bool_and(value < 40) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS kept FROM events")
def w05_valid_prefix(spark, d):
    e = t(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return W.valid_prefix(e, "user_id", "o", F.col("value") < 40).select("event_id", "kept")


@query("""WITH a AS (SELECT *, (epoch_us(ts) // 1000) AS ms FROM events), b AS (SELECT *, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN ms END IGNORE NULLS) OVER w, first_value(CASE WHEN event_type = 'click' THEN ms END IGNORE NULLS) OVER w) AS anchor FROM a
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT event_id, anchor, coalesce(ms - anchor >= 3600000, false) AS due FROM b""")
def w07_anchor_due(spark, d):
    e = ticks(spark, d).withColumn("o", F.struct("ts", "event_id"))
    return W.anchors(e, "user_id", "o", "ms", F.col("event_type") == "purchase", F.col("event_type") == "click", 3_600_000).select("event_id", "anchor", "due")


@query("SELECT event_id FROM (SELECT *, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR b IS DISTINCT FROM event_type")
def w13_without_repeats(spark, d):
    e = t(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return W.without_repeats(e, "user_id", "o", "event_type").select("event_id")


@query(f"""WITH r AS {sql_ranges('view')}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM r),
i AS (SELECT *, sum(CASE WHEN most IS NULL OR s > most THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e DESC ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(s) AS start, max(e) AS "end" FROM i GROUP BY user_id, k""")
def w15_interval_merge(spark, d):
    return W.merge_intervals(ranges(spark, d, "view"), "user_id")


@query()
def w16_greedy_sweep(spark, d):
    return W.sweep(ranges(spark, d, "view"), "user_id")


# --- aggregates and evaluation ----------------------------------------------------------


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def a01_facets(spark, d):
    return V.facets(t(spark, d, "documents"), ["lang", "source"])


@query("SELECT 'lang|source' AS fields, lang AS a, source AS b, count(*) AS n FROM documents GROUP BY lang, source UNION ALL SELECT 'source|lang', source, lang, count(*) FROM documents GROUP BY lang, source")
def a02_joint_distribution(spark, d):
    return V.joint(t(spark, d, "documents"), [("lang", "source"), ("source", "lang")])


@query("SELECT signature, count(*) AS records FROM (SELECT user_id, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS signature FROM events GROUP BY user_id) GROUP BY signature")
def a03_signatures(spark, d):
    return V.signatures(t(spark, d, "events"), "user_id", F.col("event_type"))


@query("SELECT min(g) AS least, max(g) AS most, count(DISTINCT g) AS kinds FROM (SELECT (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)")
def a05_delta_range(spark, d):
    e = ticks(spark, d).withColumn("o", F.struct("ts", "event_id"))
    g = W.deltas(e, "user_id", "o", F.col("event_type"), F.col("ms"))
    return g.agg(F.min("gap_ms").alias("least"), F.max("gap_ms").alias("most"), F.count_distinct("gap_ms").alias("kinds"))


SQL_SPLIT = f"CASE WHEN {sql_hash("'s:' || doc_id")} % 10 = 0 THEN 'dev' ELSE 'train' END"


def split_docs(spark, d):
    at = S.stable_int(F.concat(F.lit("s:"), F.col("doc_id").cast("string")), 0, 9)
    return t(spark, d, "documents").withColumn("split", F.when(at == 0, "dev").otherwise("train"))


@query(f"""WITH g AS (SELECT text, count(*) AS n, count(DISTINCT split) AS s, count(DISTINCT lang) AS c, count(DISTINCT source) AS a FROM (SELECT *, {SQL_SPLIT} AS split FROM documents) GROUP BY text)
SELECT sum(n)::BIGINT AS rows, count(*) AS unique_rows, count(*) FILTER (n > 1) AS groups, sum(n - 1)::BIGINT AS removed, count(*) FILTER (s > 1) AS cross_split, count(*) FILTER (c > 1) AS cross_corpus, count(*) FILTER (a > 1) AS conflicts FROM g""")
def a06_dedup_integrity(spark, d):
    return K.integrity(split_docs(spark, d), F.col("text"), "split", "lang", "source")


LABELS = [0, 1, 2]
SQL_REPORT = """report AS (SELECT l AS label, count(*) FILTER (quality = l) AS support, count(*) FILTER (toxic = l) AS predicted, count(*) FILTER (quality = l AND toxic = l) AS tp FROM labels, (VALUES (0), (1), (2)) v(l) GROUP BY l),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted WHEN support > 0 THEN 0 END AS p, CASE WHEN support > 0 THEN tp / support END AS r FROM report),
f AS (SELECT *, CASE WHEN p IS NOT NULL AND r IS NOT NULL AND p + r > 0 THEN 2 * p * r / (p + r) WHEN support > 0 THEN 0 END AS f FROM pr)"""


@query(f"WITH {SQL_REPORT} SELECT label, support, predicted, tp AS true_positive, predicted - tp AS false_positive, support - tp AS false_negative, round_even(p, 6) AS precision, round_even(r, 6) AS recall, round_even(f, 6) AS f1 FROM f")
def a12_class_report(spark, d):
    return E.class_report(t(spark, d, "labels"), "quality", "toxic", LABELS)


@query(f"WITH {SQL_REPORT} SELECT round_even(avg(f) FILTER (support > 0), 6) AS macro_f1 FROM (SELECT support, round_even(f, 6) AS f FROM f)")
def a13_macro_f1(spark, d):
    return E.macro_f1(a12_class_report(spark, d))


@query("SELECT quality || '->' || toxic AS pair, count(*) AS n FROM labels GROUP BY 1")
def a14_confusion(spark, d):
    return E.confusion(t(spark, d, "labels"), "quality", "toxic")


@query("SELECT source, count(*) AS n, bool_and(quality = 1) AS passed, round_even(avg((quality = 1)::INT), 6) AS row_accuracy, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (quality <> 1), '') AS failed_rows FROM labels JOIN documents USING (doc_id) GROUP BY source")
def a15_episode_rollup(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return E.episodes(rows, "source", "doc_id", F.col("quality") == 1)


SQL_WILSON = "CASE WHEN n > 0 THEN round_even(greatest(0.0, c - m), 4) END AS low, CASE WHEN n > 0 THEN round_even(least(1.0, c + m), 4) END AS high"


@query(f"""WITH b AS (SELECT lang, source, (quality = 1)::INT AS p FROM labels JOIN documents USING (doc_id)), g AS (SELECT 'lang' AS field, lang AS value, count(*) AS n, sum(p)::BIGINT AS h FROM b GROUP BY 2 UNION ALL SELECT 'source', source, count(*), sum(p)::BIGINT FROM b GROUP BY 2),
w AS (SELECT *, (h / n + 1.959964 * 1.959964 / (2 * n)) / (1 + 1.959964 * 1.959964 / n) AS c, 1.959964 * sqrt(h / n * (1 - h / n) / n + 1.959964 * 1.959964 / (4 * n * n)) / (1 + 1.959964 * 1.959964 / n) AS m FROM g)
SELECT field, value, n, h = n AS passed, round_even(h / n, 6) AS accuracy, {SQL_WILSON} FROM w""")
def a17_wilson_rollup(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return E.rollup(rows, ["lang", "source"], F.col("quality") == 1)


@query(f"""WITH w AS (SELECT item_id, {SQL_WORDS_TEXT} AS g FROM benchmark), b AS (SELECT item_id, g, coalesce(lag(g) OVER (ORDER BY item_id), []) AS p FROM w),
c AS (SELECT item_id, len(g) AS m, len(p) AS n, coalesce(list_sum(list_transform(list_distinct(g), lambda x: least(len(list_filter(g, lambda y: y = x)), len(list_filter(p, lambda y: y = x))))), 0) AS c FROM b),
r AS (SELECT item_id, CASE WHEN n > 0 THEN c / n ELSE (m = 0)::INT END AS p, CASE WHEN m > 0 THEN c / m ELSE (n = 0)::INT END AS r FROM c)
SELECT item_id, round_even(p, 6) AS precision, round_even(r, 6) AS recall, round_even(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM r""")
def a19_token_overlap(spark, d):
    b = t(spark, d, "benchmark").select("item_id", S.words(F.col("text")).alias("g"))
    both = K.preceded(b, "item_id", "g", "p").withColumn("p", F.coalesce("p", F.array().cast("array<string>")))
    return E.token_overlap(both, F.col("g"), F.col("p")).select("item_id", "precision", "recall", "f1")


@query("SELECT lang, source, count(*) AS n, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, max(n_chars) AS most, count(*) FILTER (n_chars > 4096) AS over FROM documents GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))")
def a22_percentiles(spark, d):
    return E.percentiles(t(spark, d, "documents"), "n_chars", ["lang", "source"], [0.5, 0.95], 4096)


@query("SELECT count(value) AS n, min(value) AS least, median(value) AS middle, quantile_disc(value, 0.95) AS p95, max(value) AS most, round_even(avg((value > 20)::INT), 6) AS miss_rate FROM events")
def a23_latency(spark, d):
    return E.latency(t(spark, d, "events"), "value", 20.0)


@query("SELECT n, v[n * 50 // 100 + 1] AS p50, v[n * 95 // 100 + 1] AS p95, v[n] AS most FROM (SELECT list_sort(list(value)) AS v, count(*) AS n FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 200))")
def a24_rolling_latency(spark, d):
    return E.rolling(t(spark, d, "events"), "event_id", "value")


@query("""WITH h AS (SELECT quantile_disc(doc_id, 0.5) AS m FROM labels), b AS (SELECT source AS g, avg((quality = 1)::INT) AS b, avg((toxic = 0)::INT) AS a FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT g AS "group", round_even(b, 6) AS baseline, round_even(a, 6) AS candidate, round_even(a - b, 6) AS delta, round_even(a - b, 6) >= -0.02 AS held FROM b""")
def a25_regression_deltas(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return E.deltas(rows.select("doc_id", "source", (F.col("quality") == 1).alias("ok")), rows.select("doc_id", (F.col("toxic") == 0).alias("ok")), "doc_id", "source", "ok")


@query("SELECT user_id, value::INT AS job, arg_max(CASE WHEN event_type = 'view' THEN 'running' ELSE event_type END, event_id) AS status, min(event_id) AS accepted_index, max(event_id) AS last_index FROM (SELECT user_id, event_type, event_id, CAST(props->>'$.k' AS INT) AS value FROM events) GROUP BY 1, 2")
def a32_job_status(spark, d):
    e = t(spark, d, "events").withColumn("job", F.get_json_object("props", "$.k").cast("int"))
    status = F.when(F.col("event_type") == "view", "accepted").otherwise(F.col("event_type"))
    return E.job_status(e, "user_id", "job", "event_id", status)


@query("""WITH s AS (SELECT avg((quality = 1)::INT) AS accuracy, avg((toxic = 0)::INT) AS restraint, avg(CASE WHEN quality = 9 THEN 1.0 END) AS recall FROM labels)
SELECT 'accuracy' AS gate, accuracy AS value, 0.8::DOUBLE AS floor, accuracy >= 0.8 AS passed FROM s UNION ALL SELECT 'restraint', restraint, 0.98::DOUBLE, restraint >= 0.98 FROM s UNION ALL SELECT 'recall', recall, 0.5::DOUBLE, coalesce(recall >= 0.5, false) FROM s""")
def e02_gates(spark, d):
    s = t(spark, d, "labels").agg(F.avg((F.col("quality") == 1).cast("int")).alias("accuracy"), F.avg((F.col("toxic") == 0).cast("int")).alias("restraint"), F.avg(F.when(F.col("quality") == 9, 1.0)).alias("recall"))
    return E.gates(s, {"accuracy": 0.8, "restraint": 0.98, "recall": 0.5})


# --- selection ---------------------------------------------------------------------------


@query("SELECT doc_id FROM documents ORDER BY sha256('pick:' || doc_id), doc_id LIMIT 50")
def k01_hash_sample(spark, d):
    return K.take(t(spark, d, "documents"), "doc_id", 50, "pick").select("doc_id")


@query("WITH i AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, row_number() OVER (ORDER BY sha256('split:' || conv_id), conv_id) <= round_even(count(*) OVER () * 0.1, 0) AS dev FROM i) SELECT conv_id, turn, CASE WHEN dev THEN 'dev' ELSE 'train' END AS split FROM conversations JOIN r USING (conv_id)")
def k02_exact_split(spark, d):
    return K.exact_split(t(spark, d, "conversations"), "conv_id", 0.1, "split").select("conv_id", "turn", "split")


SQL_ALLOC = """s AS (SELECT source, count(*) AS size FROM documents GROUP BY 1), b AS (SELECT *, 100 * size // sum(size) OVER () AS base, (100 * size) % sum(size) OVER () AS r FROM s),
a AS (SELECT source, size, (base + CASE WHEN row_number() OVER (ORDER BY base < size DESC, r DESC, sha256('q:stratum:' || source)) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS allocation FROM b)"""


@query(f"WITH {SQL_ALLOC} SELECT source, size, allocation FROM a")
def k04_largest_remainder(spark, d):
    sizes = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("size"))
    return K.largest_remainder(sizes, "source", "size", 100, "q")


@query(f"WITH {SQL_ALLOC}, r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('q:' || doc_id), doc_id) AS k FROM documents) SELECT doc_id, source FROM r JOIN a USING (source) WHERE k <= allocation")
def k03_stratified_sample(spark, d):
    return K.stratified(t(spark, d, "documents"), "doc_id", "source", 100, "q").select("doc_id", "source")


@query("WITH p AS (SELECT source, count(*) AS cap FROM documents GROUP BY 1), u AS (SELECT source, unnest(range(1, cap + 1)) AS r FROM p), g AS (SELECT source FROM u ORDER BY r, source LIMIT 333) SELECT source, cap, (SELECT count(*) FROM g WHERE g.source = p.source) AS allocation FROM p")
def k07_round_robin_fill(spark, d):
    return K.water_fill(t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("cap")), "source", "cap", 333)


@query("WITH u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sha256('e:' || event_id), event_id) AS k FROM events WHERE user_id % 7 <> 0) WHERE k = 1) SELECT event_id, user_id FROM u ORDER BY sha256('e:' || event_id), event_id LIMIT 40")
def k09_unique_episode_take(spark, d):
    e = t(spark, d, "events")
    return K.unique_take(e, "user_id", "event_id", 40, "e", used=e.where("user_id % 7 = 0")).select("event_id", "user_id")


@query(f"""WITH x AS (SELECT *, {SQL_SPLIT} AS split, CASE WHEN ('0x' || substr(sha256(text), 1, 8))::BIGINT % 10 = 0 THEN 'dev' ELSE 'train' END AS want FROM documents)
SELECT doc_id, split FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY (split <> want)::INT, source, doc_id) AS k FROM x) WHERE k = 1""")
def k14_dedup_representative(spark, d):
    return K.representatives(split_docs(spark, d), F.col("text"), "split", ["source", "doc_id"]).select("doc_id", "split")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def k17_longest(spark, d):
    return t(spark, d, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id", "n_chars")


@query("SELECT lang, arg_min(doc_id, n_chars * 10000000 + doc_id) AS shortest, arg_max(doc_id, n_chars * 10000000 - doc_id) AS longest FROM documents GROUP BY lang")
def k18_representative_samples(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("shortest"), F.max_by("doc_id", F.struct(F.col("n_chars"), -F.col("doc_id"))).alias("longest"))


@query("""WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM documents) SELECT doc_id, p // ceil(n / 4)::BIGINT + 1 AS shard, 4::BIGINT AS of FROM x""")
def s07_shards(spark, d):
    return K.shards(t(spark, d, "documents").select("doc_id", "text"), "doc_id", F.col("text"), 4, 1 << 40).select("doc_id", "shard", "of")


# --- sets and gates ------------------------------------------------------------------------


@query(f"SELECT count(*) AS shared FROM (SELECT {SQL_NORM} FROM documents INTERSECT SELECT {SQL_NORM} FROM benchmark)")
def u02_overlap(spark, d):
    own = [t(spark, d, n).select(S.normalized(F.col("text")).alias("k")) for n in ("documents", "benchmark")]
    return own[0].intersect(own[1]).agg(F.count("*").alias("shared"))


@query("SELECT DISTINCT lang FROM documents EXCEPT SELECT 'en'")
def u03_difference(spark, d):
    return t(spark, d, "documents").select("lang").exceptAll(t(spark, d, "documents").select("lang").where("lang = 'en'")).distinct()


@query(f"SELECT {SQL_NORM} AS key, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def v02_duplicates(spark, d):
    return V.duplicates(t(spark, d, "documents"), S.normalized(F.col("text")), "doc_id")


@query(f"SELECT prefix, count(*) AS n FROM (SELECT array_to_string(({SQL_WORDS_TEXT})[1:7], ' ') AS prefix FROM documents) WHERE prefix <> '' GROUP BY 1 HAVING count(*) >= 3")
def v03_templates(spark, d):
    return V.templates(t(spark, d, "documents"), S.word_prefix(F.col("text"), 7), 3)


@query("""WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), g AS (SELECT source, sum(n)::BIGINT AS total, max(n) AS top, arg_min(lang, row_number) AS value FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS row_number FROM n) GROUP BY source)
SELECT source, total, value, round_even(top / total, 6) AS share, top / total > 0.8 AS failed FROM g WHERE total >= 5""")
def v05_conditional_dominance(spark, d):
    return V.dominance(t(spark, d, "documents"), "source", "lang")


@query("SELECT field, count(*) AS values, round_even(max(n) / sum(n), 6) AS share, max(n) / sum(n) <= 0.6 AND count(*) >= 4 AS passed FROM (SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2) GROUP BY field")
def v06_share_gate(spark, d):
    return V.share_gate(t(spark, d, "documents"), ["lang", "source"], {"lang": (4, 0.6), "source": (4, 0.6)})


@query(f"""WITH n AS (SELECT source, {SQL_OPENER} AS opener, count(*) AS n FROM documents GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, opener) AS k FROM n),
g AS (SELECT source, sum(n)::BIGINT AS total, max(opener) FILTER (k = 1) AS opener, max(n) AS top, sum(n) FILTER (k <= 4) AS top4 FROM k GROUP BY source)
SELECT source, total, opener, round_even(top / total, 6) AS share, round_even(top4 / total, 6) AS top4_share, CASE WHEN total < 20 THEN 'small' WHEN top / total > 0.4 THEN 'error' WHEN top / total > 0.25 THEN 'warning' ELSE 'ok' END AS severity FROM g""")
def v08_opener_gate(spark, d):
    return V.opener_gate(t(spark, d, "documents"), "source", S.opener(F.col("text")))


# --- more text checks, reviews and quotas ---------------------------------------------------

SQL_STOP = "[" + ", ".join(f"'{w}'" for w in S.STOPWORDS) + "]"


@query(f"""WITH p AS (SELECT item_id, text, lag(text) OVER (ORDER BY item_id) AS before FROM benchmark),
s AS (SELECT item_id, list_filter(list_distinct(list_intersect({SQL_WORDS.format('text')}, {SQL_WORDS.format("coalesce(before, '')")})), lambda w: NOT list_contains({SQL_STOP}, w)) AS shared FROM p)
SELECT item_id, len(shared) >= 2 OR len(list_filter(shared, lambda w: regexp_matches(w, '[0-9]'))) > 0 AS grounded FROM s""")
def p31_grounded(spark, d):
    b = K.preceded(t(spark, d, "benchmark").select("item_id", "text"), "item_id", "text", "before")
    return b.select("item_id", S.grounded(F.col("text"), F.coalesce("before", F.lit(""))).alias("grounded"))


@query("SELECT doc_id, regexp_matches(text, '</?[A-Za-z][^>]*>') OR regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') OR len(regexp_extract_all(text, '```')) % 2 = 1 AS unsafe FROM documents")
def p20_unsafe_text(spark, d):
    return t(spark, d, "documents").select("doc_id", S.unsafe(F.col("text")).alias("unsafe"))


@query(f"SELECT item_id, round_even(len(list_filter(w, lambda x: contains('the of and anly', x))) / nullif(len(w), 0), 6) AS coverage FROM (SELECT item_id, {SQL_WORDS_TEXT} AS w FROM benchmark)")
def a20_term_coverage(spark, d):
    return t(spark, d, "benchmark").select("item_id", S.term_coverage(S.words(F.col("text")), F.lit("the of and anly")).alias("coverage"))


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'pass' WHEN quality = 0 THEN 'fail' END, 'missing') AS verdict, coalesce(quality = 1, false) AS passed FROM documents LEFT JOIN labels USING (doc_id)")
def e09_judgment_merge(spark, d):
    verdicts = t(spark, d, "labels").withColumn("v", F.when(F.col("quality") == 1, "pass").otherwise("fail"))
    return E.judged(t(spark, d, "documents").select("doc_id"), verdicts, "doc_id", "v")


@query("""SELECT doc_id, a = b AS agreed, CASE WHEN a = b AND c IS NOT NULL THEN 'ruled without need' WHEN a <> b AND c IS NULL THEN 'not ruled' END AS error,
CASE WHEN (a = b AND c IS NULL) OR (a <> b AND c IS NOT NULL) THEN coalesce(c, a) END AS verdict FROM (SELECT doc_id, quality AS a, toxic AS b, CASE WHEN doc_id % 3 = 0 THEN quality END AS c FROM labels)""")
def e10_adjudication(spark, d):
    x = t(spark, d, "labels")
    return E.adjudicated(x, x.select("doc_id", F.col("toxic").alias("quality")), x.where("doc_id % 3 = 0"), "doc_id", "quality")


@query("SELECT round_even(avg((quality = toxic)::INT), 6) AS agreement, count(*) AS n FROM labels")
def a26_agreement(spark, d):
    return t(spark, d, "labels").agg(E.rounded(F.avg((F.col("quality") == F.col("toxic")).cast("int"))).alias("agreement"), F.count("*").alias("n"))


@query("SELECT round_even(avg(CASE WHEN toxic = 1 THEN quality END), 6) AS mean, count(CASE WHEN toxic = 1 THEN quality END) AS n FROM labels")
def a11_null_skipping_mean(spark, d):
    x = F.when(F.col("toxic") == 1, F.col("quality")).cast("double")
    return t(spark, d, "labels").agg(E.rounded(F.avg(x)).alias("mean"), F.count(x).alias("n"))


@query("""WITH s AS (SELECT lang, count(*) AS w FROM documents GROUP BY 1), b AS (SELECT *, 97 * w // sum(w) OVER () AS base, (97 * w) % sum(w) OVER () AS r FROM s)
SELECT lang, w, (base + CASE WHEN row_number() OVER (ORDER BY r DESC, lang) <= 97 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS allocation FROM b""")
def k05_apportion(spark, d):
    return K.apportion(t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("w")), "lang", "w", 97)


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def k13_dedup_keep_first(spark, d):
    return K.keep_first(t(spark, d, "documents").select("doc_id", "text"), F.col("text"), "doc_id").select("doc_id", "copies")


@query(f"""WITH x AS (SELECT *, {SQL_SPLIT} AS split FROM documents) SELECT 'text' AS kind, count(*) AS shared FROM (SELECT text FROM x WHERE split = 'train' INTERSECT SELECT text FROM x WHERE split = 'dev')
UNION ALL SELECT 'source', count(*) FROM (SELECT source FROM x WHERE split = 'train' INTERSECT SELECT source FROM x WHERE split = 'dev')""")
def u06_leakage(spark, d):
    x = split_docs(spark, d)
    return K.leakage(x.where("split = 'train'"), x.where("split = 'dev'"), {"text": F.col("text"), "source": F.col("source")})


@query("SELECT source, sum(n)::BIGINT AS total, round_even(coalesce(sum(n) FILTER (k <= 4), 0) / sum(n), 6) AS top4 FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)) GROUP BY source")
def a35_top4_share(spark, d):
    n = t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    k = F.row_number().over(W.Window.partitionBy("source").orderBy(F.desc("n"), "lang"))
    g = n.withColumn("k", k).groupBy("source").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("k") <= 4, F.col("n"))).alias("top"))
    return g.select("source", "total", E.rounded(F.col("top") / F.col("total")).alias("top4"))


@query("SELECT conv_id, turn, (sum(length(text)) OVER w)::BIGINT AS size, length(text)::BIGINT AS added, sum(length(text)) OVER w > 3000 AS over FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def a34_context_growth(spark, d):
    c = W.running(t(spark, d, "conversations"), "conv_id", "turn", F.length("text"), "size")
    return c.select("conv_id", "turn", "size", F.length("text").cast("long").alias("added"), (F.col("size") > 3000).alias("over"))


@query("SELECT source FROM (SELECT source, avg((quality = 1)::INT) AS q, avg((toxic = 0)::INT) AS r FROM labels JOIN documents USING (doc_id) GROUP BY 1) ORDER BY least(q, r) DESC, q DESC, source LIMIT 1")
def k21_checkpoint_choice(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    r = rows.groupBy("source").agg(F.avg((F.col("quality") == 1).cast("int")).alias("q"), F.avg((F.col("toxic") == 0).cast("int")).alias("r"))
    return E.checkpoint_choice(r.withColumn("floor", F.least("q", "r")), "source", ["floor", "q"], "source").select("source")


# --- compilers and sessions ------------------------------------------------------------------


@query()
def c01_chunk_sizes(spark, d):
    b = t(spark, d, "benchmark")
    chunks = S.chunk_sizes(F.length("text"), F.concat(F.lit("b"), F.col("item_id").cast("string")))
    e = b.select("item_id", "text", F.posexplode(chunks).alias("step", "size"))
    e = W.running(e, "item_id", "step", F.col("size"), "typed")
    gap = S.stable_int(F.concat_ws(":", "item_id", "step"), 520, 820)
    e = W.running(e.withColumn("gap", gap), "item_id", "step", F.col("gap"), "elapsed_ms")
    return e.select("item_id", "step", "size", "elapsed_ms", F.substring(F.col("text"), F.lit(1), F.col("typed").cast("int")).alias("snapshot"))


def session_events(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as sessions: user rows carry the action that answers them, every fourth answer twice."""
    x = turns(spark, d).withColumn("action", G.completion(F.col("action_body")))
    again = x.where("idx % 4 = 0").withColumn("action", F.replace("action", F.concat(F.lit('"for":'), F.col("idx").cast("string"), F.lit(",")), F.lit('"for":1,')))
    both = x.withColumn("part", F.lit(0)).union(again.withColumn("part", F.lit(1)))
    null = F.lit(None).cast("string")
    return both.select(F.col("session_id").cast("string").alias("session_id"), (F.col("idx") * 2 + F.col("part")).cast("long").alias("seq"), F.lit("user").alias("source"), F.col("text").alias("content"), null.alias("tool"), null.alias("job_id"), F.lit(0).cast("long").alias("generation"), "action")


@query()
def t02_session_fold(spark, d):
    return session.fold(session_events(spark, d))


from tidewright.plans import compiled as _compiled  # noqa: E402, F401  (these register their queries)
from tidewright.plans import relations as _relations  # noqa: E402, F401
from tidewright.plans import reports as _reports  # noqa: E402, F401
from tidewright.plans import surfaces as _surfaces  # noqa: E402, F401
from tidewright.plans import texts as _texts  # noqa: E402, F401
