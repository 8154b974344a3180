"""Distribution and wording gates: every rule gives rows, none stops at the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of all values of several columns, in one aggregate."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(each.alias("f")).groupBy("f.field", "f.value").agg(F.count("*").alias("n"))


def joint(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Two-way distributions of several pairs of columns, in one aggregate."""
    each = F.explode(F.array(*[F.struct(F.lit(f"{a}|{b}").alias("fields"), F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")) for a, b in pairs]))
    return df.select(each.alias("f")).groupBy("f.fields", "f.a", "f.b").agg(F.count("*").alias("n"))


def signatures(df: DataFrame, record: str, label: Column) -> DataFrame:
    """How many records carry each set of labels."""
    own = df.groupBy(record).agg(F.array_join(F.array_sort(F.collect_set(label)), "+").alias("signature"))
    return own.groupBy("signature").agg(F.count("*").alias("records"))


def duplicates(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Groups of rows with equal keys: count and the first of them. Null keys are no group."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1 AND key IS NOT NULL")


def templates(df: DataFrame, prefix: Column, least: int) -> DataFrame:
    """Openings that occur ``least`` times or more."""
    return df.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("prefix") != ""))


def dominance(df: DataFrame, bucket: str, value: str, most: float = 0.8, least: int = 5) -> DataFrame:
    """The commonest value of each bucket of ``least`` rows or more, its share, and whether that is over ``most``."""
    n = df.groupBy(bucket, value).agg(F.count("*").alias("n"))
    g = n.groupBy(bucket).agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias("value"))
    return g.where(F.col("total") >= least).select(bucket, "total", "value", F.bround(F.col("top") / F.col("total"), 6).alias("share"), (F.col("top") / F.col("total") > most).alias("failed"))


def opener_gate(df: DataFrame, file: str, opener: Column, warn: float = 0.25, fail: float = 0.4, least: int = 20) -> DataFrame:
    """Each file's commonest opener and its top four, as shares, with the severity."""
    n = df.groupBy(file, opener.alias("opener")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(file).orderBy(F.desc("n"), "opener")
    g = n.withColumn("k", F.row_number().over(w)).groupBy(file).agg(F.sum("n").alias("total"), F.max(F.when(F.col("k") == 1, F.col("opener"))).alias("opener"), F.max("n").alias("top"), F.sum(F.when(F.col("k") <= 4, F.col("n"))).alias("top4"))
    share = F.col("top") / F.col("total")
    severity = F.when(F.col("total") < least, "small").when(share > fail, "error").when(share > warn, "warning").otherwise("ok")
    return g.select(file, "total", "opener", F.bround(share, 6).alias("share"), F.bround(F.col("top4") / F.col("total"), 6).alias("top4_share"), severity.alias("severity"))


def share_gate(df: DataFrame, columns: list[str], bounds: dict[str, tuple[int, float]]) -> DataFrame:
    """For each column: distinct values, the largest share, and whether there are enough values and none too common."""
    n = facets(df, columns).where("value IS NOT NULL")
    g = n.groupBy("field").agg(F.count("*").alias("values"), F.max("n").alias("top"), F.sum("n").alias("total"))
    least, most = F.lit(0), F.lit(1.0)
    for c, (a, b) in bounds.items():
        least, most = F.when(F.col("field") == c, a).otherwise(least), F.when(F.col("field") == c, b).otherwise(most)
    share = F.col("top") / F.col("total")
    return g.select("field", "values", F.bround(share, 6).alias("share"), ((F.col("values") >= least) & (share <= most)).alias("passed"))


def envelope(df: DataFrame, id: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """Rows that break a rule, with the first they break; an id that occurs twice breaks the first."""
    n = df.groupBy(id).agg(F.count("*").alias("_n"))
    error = F.when(F.col("_n") != 1, "repeated id")
    for name, broken in rules:
        error = error.when(broken, name)
    return df.join(n, id).select(id, error.alias("error")).where("error IS NOT NULL")


def blanks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null or blank values of each column."""
    return df.agg(*[F.count_if(F.trim(F.coalesce(F.col(c), F.lit(""))) == "").alias(c) for c in columns])


def rule_rows(df: DataFrame, id: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule a record breaks; a rule that is null doesn't count as broken."""
    found = F.array_compact(F.array(*[F.when(broken, name) for name, broken in rules.items()]))
    return df.select(id, F.explode(found).alias("error"))


def scene_rules(segments: str = "segments") -> dict[str, Column]:
    """Structure of an authored scene: sizes, one address with a reply, known pauses, no lone marker beside a trap."""
    s = F.col(segments)
    own = lambda kind: F.filter(s, lambda x: x["kind"] == kind)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return {
        "segments": ~F.size(s).between(5, 9),
        "narrations": ~F.size(own("narration")).between(4, 8),
        "addresses": F.size(own("address")) != 1,
        "reply": F.exists(own("address"), lambda x: blank(x["gold_reply"])),
        "pause": F.exists(s, lambda x: ~x["pause_after"].isin("none", "short", "medium", "long")),
        "traps": F.exists(s, lambda x: F.array_contains(x["traps"], "none") & (F.size(x["traps"]) > 1)),
        "text": F.exists(s, lambda x: blank(x["text"])),
    }


def bounded_shares(df: DataFrame, gates: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """The share of rows for which each condition holds, and whether it is within its bounds; one aggregate."""
    shares = df.agg(*[F.bround(F.avg(c.cast("int")), 6).alias(k) for k, (c, _, _) in gates.items()])
    each = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("share"), F.col(k).between(a, b).alias("passed")) for k, (_, a, b) in gates.items()])
    return shares.select(F.inline(each))
