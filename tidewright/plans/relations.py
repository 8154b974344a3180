"""Further joins, aggregates, windows, selections and gates over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions import scalars as S
from tidewright.operators import evaluation as E
from tidewright.operators import quality as V
from tidewright.operators import selection as K
from tidewright.operators import sequences as W
from tidewright.plans.registry import SQL_SPLIT, SQL_TURNS, query, split_docs, sql_hash, t, ticks, turns

# --- joins --------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, o_custkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45")
def j01_record_of_candidate(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    return t(spark, d, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber").join(o, "l_orderkey")


@query("SELECT conv_id, lang_hint, role, text FROM (SELECT conv_id, min(role) AS lang_hint FROM conversations GROUP BY conv_id) JOIN conversations USING (conv_id)")
def j02_flatten(spark, d):
    nested = t(spark, d, "conversations").groupBy("conv_id").agg(F.min("role").alias("lang_hint"), F.collect_list(F.struct("role", "text")).alias("rows"))
    return nested.select("conv_id", "lang_hint", F.inline("rows"))


@query("SELECT a.conv_id, a.turn, b.turn AS target FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND b.role = 'user' WHERE a.role = 'assistant'")
def j03_respond_target(spark, d):
    c = t(spark, d, "conversations")
    users = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("target"))
    return c.where("role = 'assistant'").select("conv_id", "turn").join(users, ["conv_id", "turn"], "left")


@query("SELECT count(*) FILTER (g IS NOT NULL AND p IS NOT NULL) AS both_sides, count(*) FILTER (p IS NULL) AS gold_only, count(*) FILTER (g IS NULL) AS predicted_only FROM (SELECT doc_id, 1 AS g FROM labels) FULL JOIN (SELECT doc_id, 1 AS p FROM labels WHERE quality = 1 OR toxic = 0) USING (doc_id)")
def j04_aligned(spark, d):
    x = t(spark, d, "labels")
    return E.alignment(x, x.where("quality = 1 OR toxic = 0"), "doc_id")


@query("SELECT l.doc_id, quality FROM labels l WHERE EXISTS (SELECT 1 FROM labels m WHERE m.doc_id = l.doc_id AND m.quality <> m.toxic)")
def j20_missed_only(spark, d):
    x = t(spark, d, "labels")
    return x.select("doc_id", "quality").join(x.where("quality <> toxic").select("doc_id"), "doc_id", "left_semi")


@query("SELECT user_id, k, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS fire, max(CASE WHEN event_type = 'view' THEN event_id END) AS wait FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events) GROUP BY user_id, k HAVING count(*) FILTER (event_type = 'purchase') > 0 AND count(*) FILTER (event_type = 'view') > 0")
def j07_fire_wait_pairs(spark, d):
    e = t(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return W.role_pairs(e, ["user_id", "k"], F.col("event_type"), "event_id", {"fire": "purchase", "wait": "view"})


@query("SELECT a.l_orderkey AS l_orderkey, a.l_linenumber AS before, b.l_linenumber AS after FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1")
def j08_neighbours(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("before"))
    after = x.select("l_orderkey", (F.col("before") - 1).alias("before"), F.col("before").alias("after"))
    return x.join(after, ["l_orderkey", "before"])


@query("SELECT c_custkey, coalesce(status, 'none') AS status, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderstatus) AS status, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def j16_merged_jobs(spark, d):
    own = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderstatus").alias("status"), F.count("*").alias("n"))
    return t(spark, d, "customer").select("c_custkey").join(own, "c_custkey", "left").na.fill({"status": "none", "n": 0})


@query(f"WITH b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark), s AS (SELECT range AS schedule FROM range(500)) SELECT schedule, item_id FROM s JOIN b ON i = {sql_hash("'bank:' || schedule")} % n")
def j18_bank_by_schedule(spark, d):
    bank = K.numbered(t(spark, d, "benchmark").select("item_id"), "item_id", "i").withColumn("i", F.col("i") - 1)
    n = bank.count()
    s = spark.range(500).withColumnRenamed("id", "schedule")
    return s.withColumn("i", S.stable_int(F.concat(F.lit("bank:"), F.col("schedule").cast("string")), 0, max(n, 1) - 1)).join(bank, "i").select("schedule", "item_id")


# --- aggregates -----------------------------------------------------------------------


@query("SELECT count(DISTINCT doc_id) AS docs, count(DISTINCT text) AS texts, count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources FROM documents")
def a04_distinct_counts(spark, d):
    return t(spark, d, "documents").agg(F.count("doc_id").alias("docs"), F.count_distinct(F.xxhash64("text"), F.sha2("text", 256)).alias("texts"), F.count_distinct("lang").alias("langs"), F.count_distinct("source").alias("sources"))


@query("SELECT sha256(text) AS key, count(*) AS n, count(DISTINCT source) AS answers FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def a07_conflicts(spark, d):
    g = t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("answers"))
    return g.where("answers > 1")


@query(f"SELECT source, count(DISTINCT split) AS splits FROM (SELECT source, {SQL_SPLIT} AS split FROM documents) GROUP BY source HAVING count(DISTINCT split) <> 1")
def a08_split_leak(spark, d):
    return split_docs(spark, d).groupBy("source").agg(F.count_distinct("split").alias("splits")).where("splits <> 1")


@query("SELECT count(*) FILTER (quality = 1) AS fires, count(*) FILTER (quality = 0) AS waits, count(*) FILTER (toxic = 1) AS silences, count(*) FILTER (quality = 9) AS clauses, count(*) FILTER (quality = 1) > 0 AND count(*) FILTER (quality = 0) > 0 AND count(*) FILTER (toxic = 1) > 0 AND count(*) FILTER (quality = 9) > 0 AS passed FROM labels")
def a10_slice_support(spark, d):
    q, x = F.col("quality"), F.col("toxic")
    return E.support(t(spark, d, "labels"), {"fires": q == 1, "waits": q == 0, "silences": x == 1, "clauses": q == 9})


@query("SELECT lang, source, count(*) AS n, round_even(avg((quality = 1)::INT), 6) AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), (source), (lang, source))")
def a16_group_role(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    g = rows.groupingSets([["lang"], ["source"], ["lang", "source"]], "lang", "source")
    return g.agg(F.count("*").alias("n"), E.rounded(F.avg((F.col("quality") == 1).cast("int"))).alias("accuracy")).select("lang", "source", "n", "accuracy")


@query("""WITH s AS (SELECT source, avg(quality) AS q, avg(1 - toxic) AS r, avg(CASE WHEN toxic = 1 THEN quality END) AS c FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT source, round_even(CASE WHEN c IS NOT NULL THEN 0.5 * q + 0.3 * r + 0.2 * c ELSE 0.6 * q + 0.4 * r END, 6) AS score FROM s""")
def a18_composite(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    s = rows.groupBy("source").agg(F.avg("quality").alias("q"), F.avg(1 - F.col("toxic")).alias("r"), F.avg(F.when(F.col("toxic") == 1, F.col("quality"))).alias("c"))
    return s.select("source", E.composite([(F.col("c").isNotNull(), {"q": 0.5, "r": 0.3, "c": 0.2}), (F.lit(True), {"q": 0.6, "r": 0.4})]).alias("score"))


@query("SELECT round_even(avg((toxic = 1)::INT) FILTER (quality = 1), 6) AS fire_recall, round_even(avg((toxic = 0)::INT) FILTER (quality = 0), 6) AS wait_accuracy, round_even(avg((quality = 1)::INT) FILTER (toxic = 9), 6) AS clause_accuracy FROM labels")
def a21_slice_metrics(spark, d):
    q, x = F.col("quality"), F.col("toxic")
    return E.slices(t(spark, d, "labels"), {"fire_recall": (q == 1, x == 1), "wait_accuracy": (q == 0, x == 0), "clause_accuracy": (x == 9, q == 1)})


@query("WITH i AS (SELECT source, bool_and(quality = 1) AS consistent, bool_or(quality = 1) AS any_hit FROM labels JOIN documents USING (doc_id) GROUP BY source) SELECT CASE WHEN consistent THEN 'recognised' WHEN any_hit THEN 'order dependent' ELSE 'missed' END AS diagnosis, count(*) AS n FROM i GROUP BY 1")
def a27_recognition(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return E.diagnoses(rows, "source", F.col("quality") == 1)


@query("SELECT count(*) FILTER (quality = toxic) AS same, count(*) FILTER (quality = 1 AND toxic = 0) AS clean, count(*) AS n, count(*) FILTER (quality = toxic) >= 10 AS passed FROM labels")
def a28_exact_counts(spark, d):
    q, x = F.col("quality"), F.col("toxic")
    return t(spark, d, "labels").agg(F.count_if(q == x).alias("same"), F.count_if((q == 1) & (x == 0)).alias("clean"), F.count("*").alias("n"), (F.count_if(q == x) >= 10).alias("passed"))


@query("SELECT lang, count(*) FILTER (quality = 1) AS fires, count(*) FILTER (quality = 0) AS waits, count(*) FILTER (quality = 1) >= 3 AND count(*) FILTER (quality = 0) >= 3 AS passed FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def a29_fire_wait_counts(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    f, w = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    return rows.groupBy("lang").agg(f.alias("fires"), w.alias("waits"), ((f >= 3) & (w >= 3)).alias("passed"))


@query("SELECT count(*) AS n, sum(('0x' || substr(sha256(doc_id || ':' || sha256(text)), 1, 12))::BIGINT)::VARCHAR AS fingerprint FROM documents")
def a31_fingerprint(spark, d):
    return K.fingerprint(t(spark, d, "documents"), "doc_id", F.sha2("text", 256))


@query("SELECT round_even(avg((quality = toxic)::INT), 6) AS accuracy, count(*) FILTER (quality = 1 AND toxic = 0) AS missed, count(*) FILTER (quality = 0 AND toxic = 1) AS false_fires FROM labels")
def a33_closed_loop(spark, d):
    x = t(spark, d, "labels")
    q, p = F.col("quality"), F.col("toxic")
    return x.agg(E.rounded(F.avg((q == p).cast("int"))).alias("accuracy"), F.count_if((q == 1) & (p == 0)).alias("missed"), F.count_if((q == 0) & (p == 1)).alias("false_fires"))


# --- windows ----------------------------------------------------------------------------


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS repeated FROM events")
def w06_already_done(spark, d):
    first = t(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("o"))
    return first.select("event_id", (n > 1).alias("repeated"))


SQL_RANK = "CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END"


@query(f"SELECT user_id, CAST(props->>'$.k' AS INT) AS k, arg_min(event_id, ({SQL_RANK})::BIGINT * 1000000000 + event_id) AS event_id FROM events GROUP BY 1, 2")
def w09_best_role(spark, d):
    e = t(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return W.claims(e, ["user_id", "k"], "event_id", [F.col("event_type") == x for x in ("purchase", "signup", "click")], "event_id")


@query(f"WITH {SQL_TURNS} SELECT session_id, idx, CASE WHEN verb = 'respond' AND count(*) FILTER (verb = 'respond') OVER (PARTITION BY session_id ORDER BY idx) > 1 THEN 'translate_commit' || substr(action_body, 8) ELSE action_body END AS action_body FROM turns")
def g08_later_responds(spark, d):
    w = Window.partitionBy("session_id").orderBy("idx")
    nth = F.count_if(F.col("verb") == "respond").over(w)
    body = F.when((F.col("verb") == "respond") & (nth > 1), F.concat(F.lit("translate_commit"), F.expr("substring(action_body, 8)"))).otherwise(F.col("action_body"))
    return turns(spark, d).select("session_id", "idx", body.alias("action_body"))


@query("WITH c AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS size FROM conversations) SELECT conv_id, turn, size, size - coalesce(lag(size) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS added FROM c WHERE turn % 2 = 0")
def w14_between_checkpoints(spark, d):
    c = W.running(t(spark, d, "conversations"), "conv_id", "turn", F.length("text"), "size").where("turn % 2 = 0")
    before = F.lag("size", 1, 0).over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", "size", (F.col("size") - before).alias("added"))


# --- selection ----------------------------------------------------------------------------


@query("WITH p AS (SELECT source, count(*) AS cap, row_number() OVER (ORDER BY source) AS k FROM documents GROUP BY source), w AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p) SELECT source, cap, greatest(0, least(cap, 120 - before))::BIGINT AS allocation FROM w")
def k06_spill(spark, d):
    pools = t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("cap"))
    return K.spill(pools, "source", "cap", 120)


@query("WITH r AS (SELECT doc_id, source, sha256('c:' || doc_id) AS h FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) = 1 AS first FROM r) SELECT doc_id, source FROM f ORDER BY first DESC, h, doc_id LIMIT 60")
def k10_cover_then_fill(spark, d):
    return K.cover(t(spark, d, "documents").select("doc_id", "source"), "doc_id", "source", 60, "c").select("doc_id", "source")


@query("WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY sha256('g:' || doc_id), doc_id LIMIT 10), b AS (SELECT doc_id FROM documents WHERE lang <> 'en' ORDER BY sha256('g:' || doc_id), doc_id LIMIT 5) SELECT doc_id, 'main' AS \"group\" FROM a UNION ALL SELECT doc_id, 'rest' FROM b")
def k11_tagged_take(spark, d):
    x = t(spark, d, "documents").select("doc_id", "lang")
    return K.tagged(x, "doc_id", {"main": (F.col("lang") == "en", 10), "rest": (F.col("lang") != "en", 5)}, "g").select("doc_id", "group")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 5 AS batch FROM (SELECT doc_id FROM labels ORDER BY sha256('p:' || doc_id), doc_id LIMIT 80)")
def k12_batches(spark, d):
    chosen = K.take(t(spark, d, "labels"), "doc_id", 80, "p")
    return K.numbered(chosen.select("doc_id"), "doc_id", "n").select("doc_id", F.pmod(F.col("n") - 1, F.lit(5)).alias("batch"))


@query(f"SELECT doc_id, {sql_hash("'shuffle:' || doc_id")} % 64 AS batch FROM documents")
def k19_hash_batches(spark, d):
    return t(spark, d, "documents").select("doc_id", S.stable_int(F.concat(F.lit("shuffle:"), F.col("doc_id").cast("string")), 0, 63).alias("batch"))


@query(f"SELECT item_id, o AS presentation, CASE WHEN ({sql_hash("'order:' || item_id")} % 2 + o) % 2 = 0 THEN 'A' ELSE 'B' END AS first FROM benchmark, (VALUES (0), (1)) v(o)")
def k22_counterbalanced(spark, d):
    start = S.stable_int(F.concat(F.lit("order:"), F.col("item_id").cast("string")), 0, 1)
    b = t(spark, d, "benchmark").select("item_id", start.alias("s"), F.explode(F.array(F.lit(0), F.lit(1))).alias("presentation"))
    return b.select("item_id", "presentation", F.when((F.col("s") + F.col("presentation")) % 2 == 0, "A").otherwise("B").alias("first"))


# --- sets, gates and reports ------------------------------------------------------------------


@query("SELECT doc_id AS id, text, NULL AS url FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark UNION ALL SELECT page_id, html, url FROM pages")
def u01_union(spark, d):
    a = t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    b = t(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    c = t(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"), "url")
    return a.unionByName(b, True).unionByName(c, True)


@query("SELECT doc_id, slug FROM (SELECT doc_id, regexp_replace(regexp_replace(lower(lang), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents) WHERE slug IN ('de', 'fr')")
def u04_reserved(spark, d):
    return t(spark, d, "documents").select("doc_id", S.slug(F.col("lang")).alias("slug")).where(F.col("slug").isin("de", "fr"))


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS extra")
def u05_exact_cover(spark, d):
    return K.coverage(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id")


@query("SELECT count(*) AS n, count(*) >= 24 AS enforced FROM documents")
def v15_floor(spark, d):
    return t(spark, d, "documents").agg(F.count("*").alias("n"), (F.count("*") >= 24).alias("enforced"))


@query("SELECT doc_id, CASE WHEN n <> 1 THEN 'repeated id' WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'unknown lang' WHEN n_chars <> length(text) THEN 'wrong length' END AS error FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM documents) WHERE error IS NOT NULL")
def v16_envelope(spark, d):
    rules = [("unknown lang", ~F.col("lang").isin("en", "de", "fr", "es")), ("wrong length", F.col("n_chars") != F.length("text"))]
    return V.envelope(t(spark, d, "documents"), "doc_id", rules)


@query("SELECT lang AS name, count(*) AS actual, 25 AS target, count(*) = 25 AS equal FROM documents GROUP BY lang")
def v18_targets(spark, d):
    g = t(spark, d, "documents").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("actual"))
    return g.withColumn("target", F.lit(25)).withColumn("equal", F.col("actual") == F.col("target"))


@query("SELECT count(*) FILTER (trim(coalesce(source, '')) = '') AS source, count(*) FILTER (trim(coalesce(lang, '')) = '') AS lang FROM documents")
def v21_provenance(spark, d):
    return V.blanks(t(spark, d, "documents"), ["source", "lang"])


@query(f"""WITH {SQL_TURNS}, x AS (SELECT verb AS gold, CASE WHEN idx % 5 = 3 THEN 'invalid' ELSE verb END AS predicted, idx FROM turns)
SELECT count(*) AS n, round_even(avg((predicted <> 'invalid')::INT), 6) AS format, round_even(avg((gold = predicted)::INT), 6) AS kind, count(*) FILTER (gold = predicted) AS passed FROM x""")
def e01_row_scores(spark, d):
    from tidewright.functions import grammar as G

    raw = G.completion(F.col("action_body"))
    rows = turns(spark, d).select(G.parse_action(raw).alias("g"), G.parse_action(F.when(F.col("idx") % 5 == 3, F.concat(raw, F.lit(" "))).otherwise(raw)).alias("p"))
    same = F.col("p.valid") & (F.col("g") == F.col("p")).eqNullSafe(True) | (F.to_json("g") == F.to_json("p")) & F.col("p.valid")
    return rows.agg(F.count("*").alias("n"), E.rounded(F.avg(F.col("p.valid").cast("int"))).alias("format"), E.rounded(F.avg((F.col("g.verb") == F.col("p.verb")).cast("int"))).alias("kind"), F.count_if(same).alias("passed"))


@query("WITH s AS (SELECT avg(quality) AS q, avg(toxic) AS x, avg(CASE WHEN quality = 9 THEN 1.0 END) AS c FROM labels) SELECT 'q' AS gate, q AS value, 0.5::DOUBLE AS floor, q >= 0.5 AS passed FROM s UNION ALL SELECT 'x', x, 0.9::DOUBLE, x >= 0.9 FROM s")
def e04_hard_gates(spark, d):
    s = t(spark, d, "labels").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("x"), F.avg(F.when(F.col("quality") == 9, 1.0)).alias("c"))
    return E.gates(s, {"q": 0.5, "x": 0.9, "c": 0.5}, missing="skip")


@query("WITH c AS (SELECT doc_id, sha256(doc_id || chr(0) || 'v1' || chr(0) || quality) AS key FROM labels) SELECT doc_id, key FROM c WHERE doc_id % 4 <> 0")
def e25_uncached(spark, d):
    c = t(spark, d, "labels").select("doc_id", S.stable_digest(F.col("doc_id").cast("string"), F.lit("v1"), F.col("quality").cast("string")).alias("key"))
    return c.join(c.where("doc_id % 4 = 0").select("key"), "key", "left_anti")


@query("SELECT lang AS demo, bool_and(quality = 1) AS passed, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def e20_acceptance(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", F.col("lang").alias("demo")), "doc_id")
    return rows.groupBy("demo").agg(F.bool_and(F.col("quality") == 1).alias("passed"), F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN n_chars > 0 THEN 1.0::DOUBLE / n_chars END AS token_weight FROM documents")
def e22_token_weights(spark, d):
    return t(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 0, F.lit(1.0) / F.col("n_chars")).alias("token_weight"))


@query("""WITH a AS (SELECT lang AS g, avg(quality) AS before, avg(1 - toxic) AS after FROM labels JOIN documents USING (doc_id) GROUP BY lang)
SELECT bool_and(CASE WHEN g = 'en' THEN after > before ELSE after >= before - 0.02 END) AS accepted FROM a""")
def e24_adaptation(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    a = rows.groupBy("lang").agg(F.avg("quality").alias("before"), F.avg(1 - F.col("toxic")).alias("after"))
    return a.agg(F.bool_and(F.when(F.col("lang") == "en", F.col("after") > F.col("before")).otherwise(F.col("after") >= F.col("before") - 0.02)).alias("accepted"))


# --- stream rules in batch ----------------------------------------------------------------


@query("SELECT user_id, ms // 60000 AS tick, arg_max(event_id, ms * 10000000 + event_id) AS event_id, count(*) - 1 AS skipped FROM (SELECT *, (epoch_us(ts) // 1000) - 1700000000000 AS ms FROM events) GROUP BY 1, 2")
def t13_conflate(spark, d):
    e = ticks(spark, d).withColumn("ms", F.col("ms") - 1_700_000_000_000)
    return e.groupBy("user_id", F.floor(F.col("ms") / 60000).alias("tick")).agg(F.max_by("event_id", F.struct("ms", "event_id")).alias("event_id"), (F.count("*") - 1).alias("skipped"))


@query("SELECT event_id, CASE WHEN ms - last_value(CASE WHEN event_type = 'click' THEN ms END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ms, event_id) < 1300000 THEN 'active' ELSE 'idle' END AS state FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)")
def t14_active_state(spark, d):
    e = ticks(spark, d)
    w = Window.partitionBy("user_id").orderBy("ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "click", F.col("ms")), True).over(w)
    return e.select("event_id", F.when(F.col("ms") - last < 1_300_000, "active").otherwise("idle").alias("state"))
