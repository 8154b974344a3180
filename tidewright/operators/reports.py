"""Action classes, report checks and promotion gates, token filters, orders, caches, batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import scalars as S
from tidewright.operators.evaluation import rounded

#: Floors of the earlier corpora that a promoted model must keep.
RETAINED = {"demo-1": (0.98, 0.80), "demo-2": (0.98, 0.85), "demo-4": (0.98, 0.70)}


def count_bucket(n: Column, short: int, medium: int) -> Column:
    """short up to the first edge, medium up to the second, else long."""
    return F.when(n <= short, "short").when(n <= medium, "medium").otherwise("long")


def error_span(text: Column, wrong: Column, n: Column) -> Column:
    """Start and end of the n-th (overlapping) occurrence; null where there is none."""
    at = S.find_occurrence(text, wrong, n)
    return F.when(at >= 0, F.struct(at.alias("start"), (at + F.length(wrong)).alias("end")))


def action_class(valid: Column, kind: Column, tool: Column, operation: Column) -> Column:
    """A label for scoring; what doesn't parse is ``invalid``, never idle."""
    named = (
        F.when(tool == "web_search", "search")
        .when((tool == "ui") & operation.isin("highlight", "underline"), operation)
        .when((tool == "writer") & operation.isin("write", "pause", "resume", "revise"), operation)
        .when(tool.isin("suggest_edit", "generate_ui"), tool)
        .otherwise(F.concat(F.lit("tool:"), F.coalesce(F.nullif(tool, F.lit("")), F.lit("missing"))))
    )
    return F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(kind.isin("idle", "respond"), kind).when(kind == "tool", named).otherwise("invalid")


def identity(pairs: DataFrame, report: DataFrame, index: str, episode: str) -> DataFrame:
    """Pairs beside their report rows: ``same`` if both are there with one episode."""
    a, b = (x.select(index, F.col(episode).alias(n)) for x, n in ((pairs, "asked"), (report, "told")))
    return a.join(b, index, "full_outer").select(index, "asked", "told", F.coalesce(F.col("asked") == F.col("told"), F.lit(False)).alias("same"))


def listed_paths(paths: DataFrame, entries: DataFrame, path: str) -> DataFrame:
    """Each path: whether it was read, how often, whether the manifest lists it, and what is wrong."""
    read = paths.groupBy(path).agg(F.count("*").alias("reads"))
    m = read.join(entries.select(path).distinct().withColumn("listed", F.lit(True)), path, "full_outer")
    reads, listed = F.coalesce("reads", F.lit(0)), F.coalesce("listed", F.lit(False))
    error = F.when(~listed, "not listed").when(reads == 0, "not read").when(reads > 1, "read twice")
    return m.select(path, reads.cast("long").alias("reads"), listed.alias("listed"), error.alias("error"))


def exact_groups(rows: DataFrame, group: str, passed: Column, floors: dict[str, int | None]) -> DataFrame:
    """Support and exact rows of each group; a floor of None asks for all of them."""
    g = rows.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("support"), F.count_if(passed).alias("exact"))
    least = F.col("support")
    for name, floor in floors.items():
        if floor is not None:
            least = F.when(F.col("group") == name, F.lit(floor)).otherwise(least)
    return g.withColumn("passed", F.col("exact") >= least)


def runs_of_text(text: Column) -> Column:
    """The default token counter: runs of characters that are no ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t\n\r\f\x0B]+")).cast("long")


def within_context(rows: DataFrame, text: str, limit: int, counter: Callable[[Column], Column] = runs_of_text) -> DataFrame:
    """Rows with ``tokens`` of the whole text, by any counter (a column function, or a pandas UDF), and ``kept``."""
    return rows.withColumn("tokens", counter(F.col(text))).withColumn("kept", F.col("tokens") <= limit)


def removed_audit(counted: DataFrame, keys: list[str]) -> DataFrame:
    """What ``within_context`` leaves out, by group: rows, removed rows, the longest of either kind."""
    longest = lambda c: F.max(F.when(c, F.col("tokens")))
    return counted.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("removed"), longest(F.col("kept")).alias("longest_kept"), longest(~F.col("kept")).alias("longest_removed"))


def rates(rows: DataFrame, by: str, kind: Column, strict: Column) -> DataFrame:
    """Support and the shares of right kinds and whole rows for each value of ``by``."""
    g = rows.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("support"), F.avg(kind.cast("int")).alias("k"), F.avg(strict.cast("int")).alias("s"))
    return g.select(F.lit(by).alias("by"), "name", "support", rounded(F.col("k")).alias("kind_accuracy"), rounded(F.col("s")).alias("strict_accuracy"))


def retained(demos: DataFrame, floors: dict[str, tuple[float, float]] = RETAINED) -> DataFrame:
    """Each floor that an earlier corpus must keep, and whether it does; a corpus that is missing fails."""
    want = demos.sparkSession.createDataFrame([(d, m, v) for d, (k, s) in floors.items() for m, v in (("kind_accuracy", k), ("strict_accuracy", s))], "demo string, metric string, floor double")
    have = demos.select(F.col("name").alias("demo"), F.expr("stack(2, 'kind_accuracy', kind_accuracy, 'strict_accuracy', strict_accuracy) AS (metric, value)"))
    return want.join(have, ["demo", "metric"], "left").withColumn("passed", F.coalesce(F.col("value") >= F.col("floor"), F.lit(False)))


def promotion(candidate: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: all gates of the candidate, all retained floors, both."""
    all_of = lambda df, n: df.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias(n))
    both = all_of(candidate, "candidate_gates").join(all_of(kept, "retained_demo_floors"))  # a row each
    return both.withColumn("passed", F.col("candidate_gates") & F.col("retained_demo_floors"))


def verdicts(rows: DataFrame, fields: list[str], reason: str) -> DataFrame:
    """``valid`` where each field is a boolean and the reason has text; the reason without blanks at its ends, 500 characters at most."""
    said = F.trim(F.col(reason))
    ok = F.coalesce(F.length(said) > 0, F.lit(False))
    for f in fields:
        ok = ok & F.col(f).isNotNull()
    return rows.withColumn("valid", ok).withColumn("reason", F.when(ok, F.substring(said, 1, 500)))


def case_key(fields: list[str], judge: str) -> Column:
    """SHA-256 of the case and its judge as compact JSON with sorted keys."""
    case = F.struct(*[F.col(f) for f in sorted(fields)]).alias("case")
    return F.sha2(F.to_json(F.struct(case, F.lit(judge).alias("judge_identity"))), 256)


def interleaved(cases: DataFrame, pair: list[str], role: str, last: str) -> DataFrame:
    """``place`` in a pair: the cases of one pair side by side, ``last`` after the others."""
    w = Window.partitionBy(*pair).orderBy((F.col(role) == last).cast("int"), role)
    return cases.withColumn("place", F.row_number().over(w))


def with_provenance(nested: DataFrame, header: list[str], records: str) -> DataFrame:
    """A row a record, its place in the batch and the batch's header on it."""
    return nested.select(*header, F.posexplode(records).alias("record", "r")).select(*header, "record", "r.*")


def prefix_cache(rows: DataFrame, session: str, order: str, text: str) -> DataFrame:
    """What is new in each text against the one before it in its session: all of it after a reset, where that is no prefix."""
    before = F.lag(text).over(Window.partitionBy(session).orderBy(order))
    reset = before.isNotNull() & ~F.startswith(F.col(text), before)
    held = F.when(before.isNull() | reset, 0).otherwise(F.length(before))
    return rows.select(session, order, reset.alias("reset"), held.cast("long").alias("cached"), (F.length(text) - held).cast("long").alias("added"))


def replayed(frames: DataFrame, session: str, at: str, order: str) -> DataFrame:
    """Frames by the time since their session's first one, in milliseconds; nothing is computed anew."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    return frames.withColumn("elapsed_ms", F.floor((micros - F.min(micros).over(Window.partitionBy(session))) / 1000).cast("long")).withColumn("frame", F.row_number().over(Window.partitionBy(session).orderBy(at, order)))


def forced(rows: DataFrame, session: str, order: str, gold: str, predicted: str) -> DataFrame:
    """History as a policy sees it when its last action is replaced by gold: ``before`` and whether that intervened."""
    w = Window.partitionBy(session).orderBy(order)
    return rows.withColumn("before", F.lag(gold).over(w)).withColumn("intervened", F.coalesce(F.lag(gold).over(w) != F.lag(predicted).over(w), F.lag(predicted).over(w).isNull() & F.lag(gold).over(w).isNotNull()))


def balanced_batches(rows: DataFrame, id: str, group: str, batches: int, fires: str, waits: str) -> DataFrame:
    """``batch`` for each of a small hand-reviewed set: fires in turn, waits in turn from the last batch, the rest to the least filled.

    The rest follow one another in hash order; the j-th of them goes to the j-th
    free place by (fill, batch), which is what filling the least filled one by
    one gives. Meant for sets that one reviewer reads: ranks are taken in one
    task a group.
    """
    rank = lambda salt: F.row_number().over(Window.partitionBy("_g").orderBy(F.sha2(F.concat(F.lit(salt), F.col(id).cast("string")), 256), id)) - 1
    g = F.when(F.col(group) == fires, "f").when(F.col(group) == waits, "w").otherwise("r")
    own = rows.withColumn("_g", g)
    first = own.where("_g <> 'r'").withColumn("_i", rank("repair-batch:"))
    placed = first.withColumn("batch", F.pmod(F.col("_i") + F.when(F.col("_g") == "w", batches - 1).otherwise(0), F.lit(batches)).cast("int"))
    rest = own.where("_g = 'r'").withColumn("_i", rank("repair-replay:"))
    every = rows.sparkSession.range(batches).select(F.col("id").cast("int").alias("batch"))
    fill = every.join(placed.groupBy("batch").agg(F.count("*").alias("n")), "batch", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = rows.count()
    slots = fill.select("batch", F.explode(F.sequence(F.col("n"), F.col("n") + total)).alias("level"))
    slots = slots.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("level", "batch")) - 1)
    late = rest.join(slots.select("batch", "_i"), "_i")
    return placed.select(id, group, "batch").unionByName(late.select(id, group, "batch"))


def walk_steps(gap: Column, key: Column) -> Column:
    """One to three uneven steps that add up to ``gap`` exactly, chosen by hash."""
    n = F.least(S.stable_int(F.concat(key, F.lit(":n")), 1, 3), F.greatest(gap, F.lit(1)))
    a = S.stable_int(F.concat(key, F.lit(":a")), F.lit(1), F.greatest(gap - n + 1, F.lit(1)))
    rest = gap - a
    b = S.stable_int(F.concat(key, F.lit(":b")), F.lit(1), F.greatest(rest - 1, F.lit(1)))
    return F.when(n == 1, F.array(gap)).when(n == 2, F.array(a, rest)).otherwise(F.array(a, b, rest - b))
