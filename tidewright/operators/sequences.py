"""Windows over ordered rows and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deltas(df: DataFrame, key: str, order: str, content: Column, elapsed_ms: Column) -> DataFrame:
    """Characters typed (only where the text extends the one before) and milliseconds since the row before."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.lag(content).over(w)
    typed = F.when(F.coalesce(F.startswith(content, before), F.lit(False)), F.length(content) - F.length(before)).cast("long")
    return df.withColumn("typed", typed).withColumn("gap_ms", (elapsed_ms - F.lag(elapsed_ms).over(w)).cast("long"))


def running(df: DataFrame, key: str, order: str, amount: Column, name: str = "running") -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(amount).over(w))


def round_robin(df: DataFrame, record: str, key: Column) -> DataFrame:
    """``round``: a row's place in its record by hash; ordering by (round, rank) touches all records first."""
    rank = F.sha2(key, 256)
    w = Window.partitionBy(record).orderBy("rank", record)
    return df.withColumn("rank", rank).withColumn("round", F.row_number().over(w) - 1)


def valid_prefix(df: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """``kept``: all rows before and including this one hold."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("kept", F.bool_and(ok).over(w))


def without_repeats(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before in their key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_b", before).withColumn("_n", n).where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_b"))).drop("_b", "_n")


def merge_intervals(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching ranges as one."""
    w = Window.partitionBy(key).orderBy(start, F.desc(end))
    most = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = df.withColumn("_o", F.when(most.isNull() | (F.col(start) > most), 1).otherwise(0))
    island = opens.withColumn("_i", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def sweep(df: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Greedy: a range that starts before the end of the last kept one goes."""
    ranges = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e")))).alias("r"))
    kind = f"array<struct<s:{df.schema[start].dataType.simpleString()},e:{df.schema[end].dataType.simpleString()}>>"
    none = F.array().cast(kind)
    keep = F.aggregate("r", none, lambda acc, x: F.when((F.size(acc) == 0) | (x["s"] >= F.element_at(acc, -1)["e"]), F.array_append(acc, x)).otherwise(acc))
    return ranges.select(key, F.explode(keep).alias("_kept")).select(key, F.col("_kept.s").alias(start), F.col("_kept.e").alias(end))


def first_later(df: DataFrame, key: str, order: str, holds: Column, value: str, name: str) -> DataFrame:
    """As-of forward: the smallest ``value`` of the later rows of the key for which ``holds``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn(name, F.min(F.when(holds, F.col(value))).over(w))


def last_earlier(df: DataFrame, key: str, order: str, holds: Column, value: str, name: str) -> DataFrame:
    """As-of backward: ``value`` of the nearest earlier row of the key for which ``holds``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(holds, F.col(value)), ignorenulls=True).over(w))


def anchors(df: DataFrame, key: str, order: str, time: str, fire: Column, start: Column, interval_ms: int) -> DataFrame:
    """The last fire's time, or else the first start's, and whether the interval has passed since."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.coalesce(F.last(F.when(fire, F.col(time)), True).over(w), F.first(F.when(start, F.col(time)), True).over(w))
    return df.withColumn("anchor", anchor).withColumn("due", F.coalesce(F.col(time) - F.col("anchor") >= interval_ms, F.lit(False)))


def overlap_anti(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ranges of ``left`` that no range of ``right`` with the same key overlaps."""
    a, b = left.alias("a"), right.alias("b")
    return a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")), "left_anti")


def role_pairs(df: DataFrame, keys: list[str], role: Column, value: str, roles: dict[str, str]) -> DataFrame:
    """The latest ``value`` of each role, for the keys that have all of them; one aggregate, no self-join."""
    g = df.groupBy(*keys).agg(*[F.max(F.when(role == r, F.col(value))).alias(n) for n, r in roles.items()])
    return g.dropna(subset=list(roles))


def claims(df: DataFrame, keys: list[str], value: str, precedence: list[Column], order: str) -> DataFrame:
    """One ``value`` for each key: of the rows of the first rule that holds, the first in order."""
    rank = F.lit(len(precedence))
    for k, rule in reversed(list(enumerate(precedence))):
        rank = F.when(rule, k).otherwise(rank)
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(rank.alias("r"), F.col(order).alias("o"))).alias(value))


def empty_kind(df: DataFrame, key: str, order: str, content: Column) -> DataFrame:
    """``kind`` of an empty text: initial, unchanged (after another empty one) or cleared; null where the text is not empty."""
    before = F.lag(content).over(Window.partitionBy(key).orderBy(order))
    first = F.row_number().over(Window.partitionBy(key).orderBy(order)) == 1
    d = df.withColumn("_b", before).withColumn("_f", first).withColumn("_c", content)
    kind = F.when(F.col("_c") == "", F.when(F.col("_f"), "initial").when(F.col("_b") == "", "unchanged").otherwise("cleared"))
    return d.withColumn("kind", kind).drop("_b", "_f", "_c")
