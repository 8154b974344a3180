"""Queries of action classes, report checks, promotion gates, token filters, orders and caches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import evaluation as E
from tidewright.operators import reports as R
from tidewright.operators import selection as K
from tidewright.plans.registry import SQL_SPLIT, query, split_docs, sql_hash, t

SQL_TOKENS = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+'))::BIGINT"


def scored(spark, d):
    """Labelled documents as scored rows: quality is the right kind, a row passes if it isn't toxic either."""
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    return rows.withColumn("kind", F.col("quality") == 1).withColumn("strict", (F.col("quality") == 1) & (F.col("toxic") == 0))


SQL_SCORED = "s AS (SELECT *, quality = 1 AS kind, quality = 1 AND toxic = 0 AS strict FROM labels JOIN documents USING (doc_id))"


@query("SELECT conv_id, count(*) AS n, CASE WHEN count(*) <= 6 THEN 'short' WHEN count(*) <= 7 THEN 'medium' ELSE 'long' END AS events, CASE WHEN count(*) <= 3 THEN 'short' WHEN count(*) <= 6 THEN 'medium' ELSE 'long' END AS clauses FROM conversations GROUP BY conv_id")
def p08_count_bucket(spark, d):
    n = t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.select("conv_id", "n", R.count_bucket(F.col("n"), 6, 7).alias("events"), R.count_bucket(F.col("n"), 3, 6).alias("clauses"))


@query("SELECT conv_id, turn, CASE WHEN p > 0 THEN p - 1 END AS start, CASE WHEN p > 0 THEN p + 1 END AS \"end\" FROM (SELECT conv_id, turn, CASE WHEN strpos(text, 'an') > 0 AND strpos(substr(text, strpos(text, 'an') + 1), 'an') > 0 THEN strpos(text, 'an') + strpos(substr(text, strpos(text, 'an') + 1), 'an') ELSE 0 END AS p FROM conversations)")
def p16_error_span(spark, d):
    span = R.error_span(F.col("text"), F.lit("an"), F.lit(2))
    return t(spark, d, "conversations").select("conv_id", "turn", span.alias("s")).select("conv_id", "turn", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


SQL_ACTIONS = "a AS (SELECT event_id, value IS NOT NULL AND event_type <> 'error' AS valid, CASE event_type WHEN 'view' THEN 'idle' WHEN 'click' THEN 'respond' ELSE 'tool' END AS kind, CASE k % 6 WHEN 0 THEN 'web_search' WHEN 1 THEN 'ui' WHEN 2 THEN 'writer' WHEN 3 THEN 'suggest_edit' WHEN 4 THEN 'other' END AS tool, CASE k % 4 WHEN 0 THEN 'highlight' WHEN 1 THEN 'pause' WHEN 2 THEN 'write' ELSE 'underline' END AS operation FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events))"


@query(f"WITH {SQL_ACTIONS} SELECT event_id, CASE WHEN NOT valid THEN 'invalid' WHEN kind IN ('idle', 'respond') THEN kind WHEN tool = 'web_search' THEN 'search' WHEN tool = 'ui' AND operation IN ('highlight', 'underline') THEN operation WHEN tool = 'writer' AND operation IN ('write', 'pause') THEN operation WHEN tool = 'suggest_edit' THEN tool ELSE 'tool:' || coalesce(tool, 'missing') END AS class FROM a")
def g06_action_class(spark, d):
    e, k = t(spark, d, "events"), F.get_json_object("props", "$.k").cast("int")
    pick = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    kind = F.when(F.col("event_type") == "view", "idle").when(F.col("event_type") == "click", "respond").otherwise("tool")
    valid = F.col("value").isNotNull() & (F.col("event_type") != "error")
    return e.select("event_id", R.action_class(valid, kind, pick(6, "web_search", "ui", "writer", "suggest_edit", "other", None), pick(4, "highlight", "pause", "write", "underline")).alias("class"))


@query("SELECT doc_id, a.source AS asked, b.source AS told, coalesce(a.source = b.source, false) AS same FROM (SELECT doc_id, source FROM documents) a FULL JOIN (SELECT doc_id, source FROM labels JOIN documents USING (doc_id)) b USING (doc_id)")
def j05_identity(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source")
    return R.identity(docs, t(spark, d, "labels").select("doc_id").join(docs, "doc_id"), "doc_id", "source")


@query("SELECT path, coalesce(reads, 0) AS reads, coalesce(listed, false) AS listed, CASE WHEN listed IS NULL THEN 'not listed' WHEN reads IS NULL THEN 'not read' WHEN reads > 1 THEN 'read twice' END AS error FROM (SELECT source || '/' || lang AS path, count(*) AS reads FROM documents GROUP BY 1) FULL JOIN (SELECT DISTINCT source || '/' || lang AS path, true AS listed FROM documents JOIN labels USING (doc_id)) USING (path)")
def j17_manifest_paths(spark, d):
    paths = t(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("path"))
    return R.listed_paths(paths, paths.join(t(spark, d, "labels").select("doc_id"), "doc_id"), "path")


@query(f"WITH {SQL_SCORED} SELECT lang AS \"group\", count(*) AS support, count(*) FILTER (strict) AS exact, count(*) FILTER (strict) >= CASE lang WHEN 'en' THEN 13 WHEN 'fr' THEN 13 ELSE count(*) END AS passed FROM s GROUP BY lang")
def a30_focused_groups(spark, d):
    return R.exact_groups(scored(spark, d), "lang", F.col("strict"), {"en": 13, "fr": 13, "de": None, "es": None})


@query(f"WITH x AS (SELECT doc_id, {SQL_TOKENS} AS tokens FROM documents) SELECT doc_id, tokens, tokens <= 512 AS kept FROM x")
def k16_context_filter(spark, d):
    return R.within_context(t(spark, d, "documents").select("doc_id", "text"), "text", 512).select("doc_id", "tokens", "kept")


@query(f"WITH x AS (SELECT {SQL_SPLIT} AS split, source, {SQL_TOKENS} AS tokens FROM documents) SELECT split, source, count(*) AS n, count(*) FILTER (tokens > 512) AS removed, max(tokens) FILTER (tokens <= 512) AS longest_kept, max(tokens) FILTER (tokens > 512) AS longest_removed FROM x GROUP BY split, source")
def a09_context_audit(spark, d):
    return R.removed_audit(R.within_context(split_docs(spark, d), "text", 512), ["split", "source"])


@query(f"WITH x AS (SELECT lang, {SQL_TOKENS} AS tokens FROM documents) SELECT lang, max(tokens) AS longest, count(*) FILTER (tokens > 65536) AS over, count(*) FILTER (tokens > 65536) = 0 AS passed FROM x GROUP BY lang")
def v22_preflight(spark, d):
    x = R.within_context(t(spark, d, "documents"), "text", 65_536)
    return x.groupBy("lang").agg(F.max("tokens").alias("longest"), F.count_if(~F.col("kept")).alias("over"), F.bool_and("kept").alias("passed"))


@query(f"WITH x AS (SELECT doc_id, source, lang, {SQL_SPLIT} AS split FROM documents) SELECT doc_id, row_number() OVER (ORDER BY split = 'dev', source, lang, doc_id) AS place FROM x")
def k15_output_order(spark, d):
    key = F.concat_ws("\x01", F.when(F.col("split") == "dev", "1").otherwise("0"), "source", "lang", F.lpad(F.col("doc_id").cast("string"), 20, "0"))
    return K.numbered(split_docs(spark, d).select("doc_id", key.alias("key")), "key", "place").select("doc_id", "place")


@query("SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY (event_type = 'purchase')::INT, event_type, event_id) AS place FROM events")
def k20_interleaved(spark, d):
    e = t(spark, d, "events").withColumn("day", F.to_date("ts")).withColumn("role", F.concat_ws("\x01", "event_type", F.lpad(F.col("event_id").cast("string"), 20, "0")))
    w = R.Window.partitionBy("user_id", "day").orderBy((F.col("event_type") == "purchase").cast("int"), "role")
    return e.withColumn("place", F.row_number().over(w)).select("user_id", "event_id", "event_type", "place")


@query("SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS record, role, length(text) AS size FROM conversations")
def c23_flattened(spark, d):
    c = t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").cast("long").alias("size")))).alias("records"))
    return R.with_provenance(c, ["conv_id"], "records").select("conv_id", F.col("record").cast("long").alias("record"), "role", "size")


SQL_RATES = ", ".join(f"r_{c} AS (SELECT '{c}' AS \"by\", {c} AS name, count(*) AS support, round_even(avg(kind::INT), 6) AS kind_accuracy, round_even(avg(strict::INT), 6) AS strict_accuracy FROM s GROUP BY {c})" for c in ("lang", "source"))


@query(f"WITH {SQL_SCORED}, {SQL_RATES} SELECT * FROM r_lang UNION ALL SELECT * FROM r_source")
def e07_contract_rates(spark, d):
    rows = scored(spark, d)
    return R.rates(rows, "lang", F.col("kind"), F.col("strict")).unionByName(R.rates(rows, "source", F.col("kind"), F.col("strict")))


CONTRACT = {"format_validity": 1.0, "translation_recall": 0.8, "search_recall": 0.85, "replay_kind_accuracy": 0.85}


@query(f"""WITH {SQL_SCORED}, m AS (SELECT avg((quality IS NOT NULL)::INT) AS format_validity, avg(kind::INT) FILTER (lang = 'fr') AS translation_recall, avg(kind::INT) FILTER (lang = 'es') AS search_recall, avg(kind::INT) FILTER (lang = 'xx') AS replay_kind_accuracy FROM s)
SELECT gate, value, floor, coalesce(value >= floor, false) AS passed FROM (""" + " UNION ALL ".join(f"SELECT '{k}' AS gate, {k}::DOUBLE AS value, {v}::DOUBLE AS floor FROM m" for k, v in CONTRACT.items()) + ")")
def e07_contract_gates(spark, d):
    rate = lambda c: F.avg(F.when(c, F.col("kind").cast("int")))
    lang = F.col("lang")
    m = scored(spark, d).agg(F.avg(F.col("quality").isNotNull().cast("int")).alias("format_validity"), rate(lang == "fr").alias("translation_recall"), rate(lang == "es").alias("search_recall"), rate(lang == "xx").alias("replay_kind_accuracy"))
    return E.gates(m, CONTRACT)


@query(f"WITH {SQL_SCORED} SELECT doc_id, source, sha256('{{\"case\":{{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}},\"judge_identity\":\"judge-1\"}}') AS key FROM s WHERE kind AND NOT strict")
def e08_semantic_cases(spark, d):
    return scored(spark, d).where("kind AND NOT strict").select("doc_id", "source", R.case_key(["lang", "doc_id"], "judge-1").alias("key"))


@query("SELECT doc_id, quality IS NOT NULL AND toxic IS NOT NULL AND length(trim(text)) > 0 AS valid, CASE WHEN quality IS NOT NULL AND toxic IS NOT NULL AND length(trim(text)) > 0 THEN sha256(substr(trim(text), 1, 500)) END AS reason_sha FROM documents LEFT JOIN labels USING (doc_id)")
def e11_verdicts(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.col("text").alias("reason")).join(t(spark, d, "labels"), "doc_id", "left")
    return R.verdicts(rows, ["quality", "toxic"], "reason").select("doc_id", "valid", F.sha2("reason", 256).alias("reason_sha"))


SQL_FLOORS = " UNION ALL ".join(f"SELECT '{d}' AS demo, '{m}' AS metric, {v}::DOUBLE AS floor" for d, (k, s) in {"en": (0.98, 0.80), "fr": (0.1, 0.05), "xx": (0.98, 0.70)}.items() for m, v in (("kind_accuracy", k), ("strict_accuracy", s)))
FLOORS = {"en": (0.98, 0.80), "fr": (0.1, 0.05), "xx": (0.98, 0.70)}


@query(f"WITH {SQL_SCORED}, {SQL_RATES}, v AS (SELECT name, 'kind_accuracy' AS metric, kind_accuracy AS value FROM r_lang UNION ALL SELECT name, 'strict_accuracy', strict_accuracy FROM r_lang), w AS ({SQL_FLOORS}) SELECT demo, w.metric AS metric, floor, value, coalesce(value >= floor, false) AS passed FROM w LEFT JOIN v ON v.name = w.demo AND v.metric = w.metric")
def e12_retained_floors(spark, d):
    return R.retained(R.rates(scored(spark, d), "lang", F.col("kind"), F.col("strict")), FLOORS)


@query(f"WITH {SQL_SCORED}, {SQL_RATES}, c AS (SELECT coalesce(avg(kind::INT) >= 0.3, false) AND coalesce(avg(strict::INT) >= 0.2, false) AS candidate_gates FROM s), k AS (SELECT bool_and(kind_accuracy >= 0.1 AND strict_accuracy >= 0.05) AS ok FROM r_lang WHERE name IN ('en', 'fr')) SELECT candidate_gates, ok AS retained_demo_floors, candidate_gates AND ok AS passed FROM c, k")
def e13_promotion(spark, d):
    rows = scored(spark, d)
    m = rows.agg(F.avg(F.col("kind").cast("int")).alias("kind"), F.avg(F.col("strict").cast("int")).alias("strict"))
    kept = R.retained(R.rates(rows, "lang", F.col("kind"), F.col("strict")), {"en": (0.1, 0.05), "fr": (0.1, 0.05)})
    return R.promotion(E.gates(m, {"kind": 0.3, "strict": 0.2}), kept)


@query(f"WITH {SQL_SCORED}, g AS (SELECT lang, avg(kind::INT) AS old, avg(strict::INT) AS new FROM s GROUP BY lang) SELECT count(*) AS demos, count(*) FILTER (round_even(new - old, 6) >= -0.02) AS held, count(*) = count(*) FILTER (round_even(new - old, 6) >= -0.02) AS passed FROM g")
def e14_repair_gate(spark, d):
    rows = scored(spark, d)
    g = E.deltas(rows, rows.withColumn("kind", F.col("strict")), "doc_id", "lang", "kind")
    return g.agg(F.count("*").alias("demos"), F.count_if("held").alias("held"), F.bool_and("held").alias("passed"))


@query(f"WITH {SQL_SCORED}, x AS (SELECT doc_id, lang FROM documents), m AS (SELECT x.lang AS a, s.lang AS b, s.strict AS strict FROM x FULL JOIN s USING (doc_id)) SELECT count(*) FILTER (a = b) AS aligned, count(*) FILTER (b IS NULL) AS unanswered, round_even(avg(strict::INT), 6) AS strict_accuracy FROM m")
def e19_rescored(spark, d):
    rows = scored(spark, d)
    m = R.identity(t(spark, d, "documents").select("doc_id", "lang"), rows.select("doc_id", "lang"), "doc_id", "lang").join(rows.select("doc_id", "strict"), "doc_id", "left")
    return m.agg(F.count_if("same").alias("aligned"), F.count_if(F.col("told").isNull()).alias("unanswered"), E.rounded(F.avg(F.col("strict").cast("int"))).alias("strict_accuracy"))


@query("WITH w AS (SELECT source, lang, count(*) AS n, sum(count(*)) OVER (PARTITION BY source) AS total FROM documents GROUP BY source, lang) SELECT source, total::BIGINT AS total, max(n) AS most, total >= 20 AND max(n) / total > 0.5 AS over FROM w GROUP BY source, total")
def v04_batch_caps(spark, d):
    n = t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    g = n.groupBy("source").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return g.withColumn("over", (F.col("total") >= 20) & (F.col("most") / F.col("total") > 0.5))


@query("WITH x AS (SELECT doc_id, source, lang FROM documents ORDER BY sha256('card:' || doc_id), doc_id LIMIT 200) SELECT count(*) AS cards, count(DISTINCT lang) AS langs, max(n) / 200.0 AS top_share, count(DISTINCT lang) >= 3 AND max(n) / 200.0 <= 0.7 AS passed FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM x)")
def v07_selected_gates(spark, d):
    x = K.take(t(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id", 200, "card")
    g = x.groupBy("lang").agg(F.count("*").alias("n")).agg(F.sum("n").alias("cards"), F.count("*").alias("langs"), (F.max("n") / 200.0).alias("top_share"))
    return g.withColumn("passed", (F.col("langs") >= 3) & (F.col("top_share") <= 0.7))


@query("WITH r AS (SELECT user_id, coalesce(list_sort(list_distinct(list(event_type) FILTER (event_type IN ('click', 'purchase', 'signup')))), []) AS traps FROM events GROUP BY user_id), n AS (SELECT count(*) AS n FROM r) SELECT array_to_string(traps, '+') AS signature, count(*) AS records, round_even(count(*) / any_value(n.n), 6) AS share, count(*) / any_value(n.n) > 0.5 AS over FROM r, n GROUP BY 1")
def v12_trap_signatures(spark, d):
    e = t(spark, d, "events")
    trap = F.when(F.col("event_type").isin("click", "purchase", "signup"), F.col("event_type"))
    r = e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(trap)), "+").alias("signature"))
    n = r.count()
    share = F.col("records") / F.lit(max(n, 1))
    return r.groupBy("signature").agg(F.count("*").alias("records")).select("signature", "records", E.rounded(share).alias("share"), (share > 0.5).alias("over"))


@query("SELECT item_id, array_to_string(list_filter([CASE WHEN contains(text, 'th') <> contains(text, 'an') THEN 'interval only for every' END, CASE WHEN contains(text, 'er') AND NOT contains(text, '\"') THEN 'bait without a quote' END, CASE WHEN text IS NULL OR trim(text) = '' THEN 'no reply' END], lambda x: x IS NOT NULL), '; ') AS problems FROM benchmark")
def v14_bank_rules(spark, d):
    has = lambda x: F.contains(F.col("text"), F.lit(x))
    rules = [("interval only for every", has("th") != has("an")), ("bait without a quote", has("er") & ~has('"')), ("no reply", F.col("text").isNull() | (F.trim("text") == ""))]
    said = F.array_join(F.array(*[F.when(bad, name) for name, bad in rules]), "; ")
    return t(spark, d, "benchmark").select("item_id", said.alias("problems"))


@query("SELECT user_id, string_agg(event_id::VARCHAR, '' ORDER BY ts, event_id) FILTER (event_type = 'click') AS translation, count(*) FILTER (event_type = 'purchase') AS panels, count(*) AS next_index, arg_max(event_type, (ts, event_id)) AS latest FROM events GROUP BY user_id")
def t12_session_view(spark, d):
    e = t(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    commits = F.array_sort(F.collect_list(F.when(F.col("event_type") == "click", F.col("o"))))
    said = F.when(F.size(commits) > 0, F.array_join(F.transform(commits, lambda x: x["event_id"].cast("string")), ""))
    return e.groupBy("user_id").agg(said.alias("translation"), F.count_if(F.col("event_type") == "purchase").alias("panels"), F.count("*").alias("next_index"), F.max_by("event_type", "o").alias("latest"))


@query("WITH x AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, turn, b IS NOT NULL AND NOT starts_with(text, b) AS reset, CASE WHEN b IS NULL OR NOT starts_with(text, b) THEN 0 ELSE length(b) END AS cached, length(text) - CASE WHEN b IS NULL OR NOT starts_with(text, b) THEN 0 ELSE length(b) END AS added FROM x")
def t15_prefix_cache(spark, d):
    return R.prefix_cache(t(spark, d, "conversations"), "conv_id", "turn", "text")


@query("SELECT user_id, event_id, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) // 1000 AS elapsed_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame FROM events")
def t16_replay(spark, d):
    return R.replayed(t(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "elapsed_ms", "frame")


@query("SELECT conv_id, turn, lag(role) OVER w AS before, lag(role) OVER w <> lag(CASE WHEN length(text) % 2 = 0 THEN role ELSE 'idle' END) OVER w AS changed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def t19_forced_history(spark, d):
    c = t(spark, d, "conversations").withColumn("said", F.when(F.length("text") % 2 == 0, F.col("role")).otherwise("idle"))
    out = R.forced(c, "conv_id", "turn", "role", "said")
    return out.select("conv_id", "turn", "before", F.when(F.col("before").isNotNull(), F.col("intervened")).alias("changed"))


SQL_REPAIR = f"""x AS (SELECT doc_id, lang, CASE lang WHEN 'en' THEN 'f' WHEN 'fr' THEN 'w' ELSE 'r' END AS g FROM documents WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY sha256('repair:' || doc_id), doc_id LIMIT 80)),
p AS (SELECT doc_id, lang, ((row_number() OVER (PARTITION BY g ORDER BY sha256('repair-batch:' || doc_id), doc_id) - 1 + CASE g WHEN 'w' THEN 4 ELSE 0 END) % 5)::INT AS batch FROM x WHERE g <> 'r'),
f AS (SELECT b.batch, count(p.doc_id) AS n FROM (SELECT range::INT AS batch FROM range(5)) b LEFT JOIN p ON p.batch = b.batch GROUP BY b.batch),
s AS (SELECT batch, row_number() OVER (ORDER BY level, batch) - 1 AS i FROM (SELECT batch, unnest(range(n, n + 81)) AS level FROM f)),
r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY sha256('repair-replay:' || doc_id), doc_id) - 1 AS i FROM x WHERE g = 'r')"""


@query(f"WITH {SQL_REPAIR} SELECT doc_id, lang, batch FROM p UNION ALL SELECT doc_id, lang, batch FROM r JOIN s USING (i)")
def k12_balanced_batches(spark, d):
    x = K.take(t(spark, d, "documents").select("doc_id", "lang"), "doc_id", 80, "repair").select("doc_id", "lang")
    return R.balanced_batches(x, "doc_id", "lang", 5, "en", "fr")


def _sql_steps(gap: str, key: str) -> str:
    n = f"least(({sql_hash(key + " || ':n'")} % 3 + 1)::BIGINT, greatest({gap}, 1))"
    return f"SELECT order_id, gap, n, ({sql_hash(key + " || ':a'")} % greatest(gap - n + 1, 1)::UBIGINT + 1)::BIGINT AS a FROM (SELECT order_id, {gap} AS gap, {n} AS n, order_id::VARCHAR AS k FROM g)"


@query(f"""WITH g AS (SELECT o_orderkey AS order_id, (o_orderkey % 40 + 3)::BIGINT AS gap, o_orderkey::VARCHAR AS k FROM orders), s AS ({_sql_steps('gap', 'k')}),
b AS (SELECT *, ({sql_hash("order_id::VARCHAR || ':b'")} % greatest(gap - a - 1, 1)::UBIGINT + 1)::BIGINT AS b FROM s)
SELECT order_id, CASE n WHEN 1 THEN gap::VARCHAR WHEN 2 THEN a || ',' || (gap - a) ELSE a || ',' || b || ',' || (gap - a - b) END AS steps FROM b""")
def c15_walk_steps(spark, d):
    g = t(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("order_id"), (F.col("o_orderkey") % 40 + 3).cast("long").alias("gap"))
    steps = R.walk_steps(F.col("gap"), F.col("order_id").cast("string"))
    return g.select("order_id", F.array_join(F.transform(steps, lambda x: x.cast("string")), ",").alias("steps"))
