"""The ten operators' registered queries, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.llm import ann, chat, embdedup, linededup, mixing, packing, secretscan, shinglejoin, tokenfiles, toxicity
from tidewright.llm._common import shared_dir

#: Ids of a document's end.
END_ID = 0


def tokenizer_path() -> str:
    """The byte-level BPE vocabulary on this box; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are trees of one branch: each turn replies to the one before it.

    Rows of one conversation and turn follow one another by role and text.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    nodes = rows.union(own).withColumn("node", place)
    messages = nodes.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    made = chat.render(chat.best(messages))
    back = chat.read_back(F.col("formatted"))
    learned = chat.learned_text(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.withColumn("turns", back).withColumn("learned", learned).select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = """
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
coded AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS body,
    length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) AS head FROM own)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(head + body + 1 + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END)::BIGINT AS formatted_chars
FROM coded GROUP BY conv_id
"""


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
g AS MATERIALIZED (SELECT vec_id, e FROM v WHERE ok),
links AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, comp.component_id, v.vec_id = comp.component_id AS kept
FROM v LEFT JOIN n ON n.x = v.vec_id JOIN comp ON comp.x = v.vec_id
"""


def op3_learned_partition_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 20 = 0").select("vec_id"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, s.first IS NOT NULL AND s.first <> k.doc_id AS gone FROM k LEFT JOIN s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.report(secretscan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op5_sql() -> str:
    """Places by the lengths before each match, as in the operator; owners by source."""
    parts, union = [], []
    for i, (kind, pattern, group, least) in enumerate(secretscan.KINDS):
        quoted = pattern.replace("'", "''")
        parts.append(f"""k{i} AS (SELECT row, repo, {i} AS kind, unnest(range(len(m))) AS i, m, v, b FROM (
          SELECT row, repo, regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {group}) AS v, string_split_regex(text, '{quoted}') AS b FROM d) WHERE len(m) > 0)""")
        union.append(f"SELECT row, repo, kind, list_sum(list_transform(b[:i + 1], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[:i], lambda x: length(x))), 0)::BIGINT AS s, length(m[i + 1]) AS n, v[i + 1] AS v FROM k{i} WHERE length(v[i + 1]) >= {least}")
    names = "[" + ", ".join(f"'{k[0]}'" for k in secretscan.KINDS) + "]"
    return (
        "WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS repo FROM documents), "
        + ", ".join(parts)
        + ", a AS ("
        + " UNION ALL ".join(union)
        + f"""), o AS (SELECT v, count(DISTINCT string_split(repo, '/')[1]) AS owners FROM a GROUP BY v),
        t AS (SELECT a.row, a.kind, a.s, {names}[a.kind + 1] || ':' || a.s || ':' || (a.s + a.n) AS said, o.owners < 2 AS live FROM a JOIN o USING (v)),
        r AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
          string_agg(said, ',' ORDER BY s, kind) FILTER (kind < {secretscan.BASE}) AS base, string_agg(said, ',' ORDER BY s, kind) AS spans,
          count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM t GROUP BY row)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
          coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN r USING (row)"""
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id.alias("doc_id"), toxicity.held_out(doc_id).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=END_ID, capacity=1024, with_ids=False)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = tokenfiles.fresh(shared_dir(spark))
    tokenfiles.write(table(spark, sf_dir, "documents"), where, tokenizer_path(), end_id=END_ID)
    return tokenfiles.read(spark, where)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shinglejoin.near_duplicates(table(spark, sf_dir, "documents"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = mixing.weigh(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return told.select(F.col("row.doc_id").alias("doc_id"), "tokens", F.round("weight", 6).alias("weight"), F.round("mean", 6).alias("mean"), "copies")


QUERIES = {
    f.__name__: f
    for f in (op1_chat_formatting, op2_embedding_near_dedup, op3_learned_partition_ann, op4_line_dedup, op5_secret_scan, op6_toxicity, op7_harmonic_packing, op8_token_files, op9_ngram_jaccard_join, op10_source_mixing)
}
ORACLES = {"op1_chat_formatting": OP1_SQL, "op2_embedding_near_dedup": OP2_SQL, "op4_line_dedup": OP4_SQL, "op5_secret_scan": op5_sql(), "op10_source_mixing": mixing.oracle_sql()}
