"""Mixing documents to target weights by iterative proportional fitting.

Token weights are raked to the target shares of several marginals (source,
language, topic) on the table of their joint cells. ``mix`` takes a document
as often as its cell's factor times the budget says in the mean, more than once
where that passes 1, so the sample meets the targets. What is left of the mean
is decided by a hash of the id, so the same documents stay whatever the
partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewright.llm._common import cut, removed, written

#: Topics by what a text holds, the first that matches.
TOPICS = [("license", "%licensed under%"), ("table", "% | %"), ("contact", "%@%")]
OTHER = "prose"
#: Default targets; None: shares by the square root of what each value holds.
TARGETS = {
    "source": None,
    "lang": {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15},
    "topic": {"license": 0.05, "table": 0.1, "contact": 0.15, "prose": 0.7},
}
#: Raking ends when no marginal's share is off its target by more than TOLERANCE of it, or after MOST_ROUNDS (targets that no weights meet).
TOLERANCE, MOST_ROUNDS = 1e-10, 20
#: Tables of at most so many cells and bytes of their values are raked in one task, larger ones by aggregates and joins.
MOST_CELLS, MOST_BYTES = 50_000, 16 << 20


def topic_of(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(OTHER)
    for name, like in reversed(TOPICS):
        out = F.when(low.like(like), name).otherwise(out)
    return out


def n_tokens(text: Column) -> Column:
    """Runs of characters that are no ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r\f\x0B]+")).cast("long")


def chance(doc_id: Column, seed: int) -> Column:
    """Uniform in [0, 1) from the id: 32 bits of its MD5. A null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def rake(cells: DataFrame, targets: dict, tolerance: float, most_rounds: int, keep: float) -> DataFrame:
    """``factor`` (raked weight of a token) and ``mean`` (copies) for each cell, as a table with files of known size.

    The rounds are the same wherever they run: a table of cells that fits a
    task is raked there, as rounds of joins are some ten jobs each, whose plans
    fill the driver's memory; a larger one stays distributed.
    """
    size = F.sum(sum((F.coalesce(F.octet_length(n), F.lit(0)) for n in targets), F.lit(0)).cast("long"))
    whole, n, size = cells.agg(F.sum("tokens"), F.count("*"), size).first()
    total = float(whole or 0)
    if n <= MOST_CELLS and (size or 0) <= MOST_BYTES:
        return written(_rake_in_task(cells, targets, tolerance, most_rounds, keep, total))[0]
    return _rake_distributed(cells, targets, tolerance, most_rounds, keep, total)


def _rake_in_task(cells: DataFrame, targets: dict, tolerance: float, most_rounds: int, keep: float, total: float) -> DataFrame:
    """All cells in one task, in the order of their values, so sums don't depend on the partitioning."""
    names = list(targets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        own = pd.concat(parts, ignore_index=True)
        tokens = own["tokens"].to_numpy("f8")
        sides = []
        for name in names:
            code, values = pd.factorize(own[name], use_na_sentinel=False)
            held, shares = np.bincount(code, tokens), targets[name]
            raw = np.sqrt(held) if shares is None else np.array([np.nan if pd.isna(v) else shares.get(v, np.nan) for v in values], "f8")
            free = np.isnan(raw)
            listed = (1 - held[free].sum() / (total or 1.0)) * raw / (raw[~free].sum() or 1.0)
            sides.append((code, np.where(free, held / (total or 1.0), listed)))
        w = tokens.copy()
        for _ in range(most_rounds if total else 0):
            off = 0.0
            for code, share in sides:
                held = np.bincount(code, w)
                with np.errstate(divide="ignore", invalid="ignore"):
                    off = max(off, np.abs(held / (share * total) - 1).max(where=held > 0, initial=0.0))
                    w = np.where(held[code] > 0, w * share[code] * total / held[code], 0.0)
            if off <= tolerance:
                break
        own["factor"] = np.divide(w, tokens, out=np.ones_like(w), where=tokens > 0)
        mass = (tokens * own["factor"]).sum()
        own["mean"] = own["factor"] * (keep * total / mass if mass > 0 else keep)
        yield own

    return cells.coalesce(1).sortWithinPartitions(*names).mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema) + ", factor double, mean double")


def _rake_distributed(cells: DataFrame, targets: dict, tolerance: float, most_rounds: int, keep: float, total: float) -> DataFrame:
    """By aggregates and joins.

    Cells stay distributed however many there are; each round is written out
    and the one before deleted, and only sums and the largest deviation come to
    the driver.
    """
    spark = cells.sparkSession
    now = cells.withColumn("w", F.col("tokens").cast("double"))
    for name, shares in targets.items():
        held = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("h"))
        listed = F.lit(True) if shares is None else F.coalesce(F.col(name).isin(list(shares)), F.lit(False))
        raw = F.sqrt("h")
        if shares is not None:
            raw = F.element_at(F.create_map(*[F.lit(x) for v, s in shares.items() for x in (v, float(s))]), F.col(name))
        held = held.withColumn("raw", F.when(listed, raw))
        whole, free = held.agg(F.sum("raw"), F.sum(F.when(F.col("raw").isNull(), F.col("h")))).first()
        share = F.when(F.col("raw").isNull(), F.col("h") / (total or 1.0)).otherwise((1 - (free or 0.0) / (total or 1.0)) * F.col("raw") / F.lit(whole or 1.0))
        now = _beside(now, held.select(name, share.alias(f"_{name}")), name)
    now, path = written(now)
    for _ in range(most_rounds if total else 0):
        raked, seen = now, []
        for name in targets:
            held = raked.groupBy(name).agg(F.sum("w").alias("h"))
            raked = _beside(raked, held, name)
            seen.append(Observation())
            off = F.max(F.when(F.col("h") > 0, F.abs(F.col("h") / (F.col(f"_{name}") * (total or 1.0)) - 1)))
            raked = raked.observe(seen[-1], off.alias("off"))
            raked = raked.withColumn("w", F.when(F.col("h") > 0, F.col("w") * F.col(f"_{name}") * total / F.col("h")).otherwise(0.0)).drop("h")
        before, (now, path) = path, written(raked)
        removed(spark, before)
        if max((o.get["off"] or 0.0) for o in seen) <= tolerance:
            break
    now = now.withColumn("factor", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0))
    mass = now.agg(F.sum(F.col("tokens") * F.col("factor"))).first()[0] or 0
    now = now.withColumn("mean", F.col("factor") * F.lit(keep * total / mass if mass > 0 else keep)).select(*cells.columns, "factor", "mean")
    told, _ = written(now)
    removed(spark, path)
    return told


def _beside(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    r = right.withColumnRenamed(name, "_key")
    return left.join(r, left[name].eqNullSafe(r["_key"])).drop("_key")


def weigh(docs: DataFrame, *, targets: dict | None = None, keep: float = 0.5, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS, seed: int = 7) -> DataFrame:
    """All columns of ``docs`` in a struct ``row``, and tokens, weight, mean, copies.

    targets: marginal to shares; a marginal named ``topic`` is derived from the
    text, others are columns. ``keep`` is the share of all tokens that the
    sample holds in the mean. ``mean`` is weight times that budget, so the
    sample's expected token shares are the targets; ``copies`` is how often the
    sample holds the document: ``mean`` rounded down, and once more with a
    probability of what is left. A null is a value of its own; a value without
    a target keeps the share it holds. Null and empty texts have no tokens and
    share their cell's mean. Rows of one doc_id share one decision if they
    share a cell. An empty table gives no rows.
    """
    targets = TARGETS if targets is None else targets
    names = list(targets)
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    for name in names:
        own = own.withColumn(name, topic_of(F.col("row.text")) if name == "topic" else F.col(f"row.{name}").cast("string"))
    own = own.withColumn("tokens", n_tokens(F.col("row.text")))
    cells = cut(own.groupBy(*names).agg(F.sum("tokens").alias("tokens")))
    # joined by broadcast only where its files are small enough for the session's limit
    told = rake(cells, targets, tolerance, most_rounds, keep)
    told = told.select(*[F.col(n).alias(f"_{n}") for n in names], "factor", "mean")
    same = F.lit(True)
    for n in names:
        same = same & own[n].eqNullSafe(told[f"_{n}"])
    copies = F.floor("mean") + (chance(F.col("row.doc_id"), seed) < F.col("mean") - F.floor("mean")).cast("long")
    return own.join(told, same).select("row", "tokens", F.col("factor").alias("weight"), "mean", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The sample, with the columns of ``docs``: each document as often as ``weigh`` has copies of it."""
    told = weigh(docs, **options).where("copies > 0")
    return told.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def oracle_sql(keep: float = 0.5, rounds: int = MOST_ROUNDS, seed: int = 7) -> str:
    """DuckDB SQL of ``weigh`` over ``documents`` with the default targets."""
    topic = "CASE " + " ".join(f"WHEN lower(coalesce(text, '')) LIKE '{like}' THEN '{name}'" for name, like in TOPICS) + f" ELSE '{OTHER}' END"
    ctes = [
        f"own AS (SELECT doc_id, source, lang, {topic} AS topic, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+'))::BIGINT AS tokens FROM documents)",
        "c0 AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM own GROUP BY ALL)",
        "total AS (SELECT sum(tokens) AS t FROM c0)",
    ]
    for name, shares in TARGETS.items():
        raw = "sqrt(h)" if shares is None else f"CASE {name} " + " ".join(f"WHEN '{v}' THEN {s}" for v, s in shares.items()) + " END"
        ctes.append(f"h_{name} AS (SELECT {name} AS v, h, {raw} AS raw FROM (SELECT {name}, sum(tokens) AS h FROM c0 GROUP BY 1))")
        ctes.append(f"a_{name} AS (SELECT v, CASE WHEN raw IS NULL THEN h / t ELSE (1 - coalesce((SELECT sum(h) FROM h_{name} WHERE raw IS NULL), 0) / t) * raw / (SELECT sum(raw) FROM h_{name}) END AS share FROM h_{name}, total)")
    ctes.append("w0 AS MATERIALIZED (SELECT c0.*, tokens AS w, " + ", ".join(f"(SELECT share FROM a_{n} WHERE v IS NOT DISTINCT FROM c0.{n}) AS s_{n}" for n in TARGETS) + " FROM c0)")
    k = 0
    for _ in range(rounds):
        for name in TARGETS:
            ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(w) OVER (PARTITION BY {name}) > 0 THEN w * s_{name} * t / sum(w) OVER (PARTITION BY {name}) ELSE 0 END AS w) FROM w{k}, total)".replace("SELECT * REPLACE", f"SELECT w{k}.* REPLACE"))
            k += 1
    ctes.append(f"f AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN w / tokens ELSE 1.0 END AS factor FROM w{k})")
    ctes.append(f"g AS MATERIALIZED (SELECT source, lang, topic, factor, factor * {keep} * t / nullif((SELECT sum(tokens * factor) FROM f), 0) AS mean FROM f, total)")
    drawn = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0"
    final = f"SELECT doc_id, own.tokens, round(factor, 6) AS weight, round(mean, 6) AS mean, floor(mean)::BIGINT + ({drawn} < mean - floor(mean))::BIGINT AS copies FROM own JOIN g ON own.source IS NOT DISTINCT FROM g.source AND own.lang IS NOT DISTINCT FROM g.lang AND own.topic = g.topic"
    return "WITH " + ",\n".join(ctes) + "\n" + final
