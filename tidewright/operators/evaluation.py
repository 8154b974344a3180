"""Scores of predictions against gold: class reports, intervals, percentiles, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scalars import wilson_95


def rounded(c: Column, digits: int = 6) -> Column:
    return F.bround(c, digits)


def class_report(rows: DataFrame, gold: str, predicted: str, labels: list) -> DataFrame:
    """A row a label: support, predicted, true positives, false ones, precision, recall, F1.

    Precision is null where a label has neither support nor predictions, and 0
    where it has support alone; a label that never occurs is listed all the same.
    """
    spark = rows.sparkSession
    both = rows.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(True).alias("is_gold")), F.struct(F.col(predicted).alias("label"), F.lit(False).alias("is_gold")))).alias("x"), (F.col(gold) == F.col(predicted)).alias("hit"))
    n = both.groupBy("x.label").agg(F.count_if("x.is_gold").alias("s"), F.count_if(~F.col("x.is_gold")).alias("p"), F.count_if(F.col("x.is_gold") & F.col("hit")).alias("t"))
    listed = spark.createDataFrame([(x,) for x in labels], n.select("label").schema)
    d = listed.join(n, "label", "left").na.fill(0, ["s", "p", "t"])
    s, p, t = F.col("s"), F.col("p"), F.col("t")
    zero = F.when(s > 0, F.lit(0.0))
    precision, recall = F.when(p > 0, t / p).otherwise(zero), F.when(s > 0, t / s)
    f1 = F.when(precision.isNotNull() & recall.isNotNull() & (precision + recall > 0), 2 * precision * recall / (precision + recall)).otherwise(zero)
    return d.select("label", s.alias("support"), p.alias("predicted"), t.alias("true_positive"), (p - t).alias("false_positive"), (s - t).alias("false_negative"), rounded(precision).alias("precision"), rounded(recall).alias("recall"), rounded(f1).alias("f1"))


def macro_f1(report: DataFrame) -> DataFrame:
    return report.agg(rounded(F.avg(F.when(F.col("support") > 0, F.col("f1")))).alias("macro_f1"))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.concat(F.col(gold).cast("string"), F.lit("->"), F.col(predicted).cast("string")).alias("pair")).agg(F.count("*").alias("n"))


def rollup(rows: DataFrame, by: list[str], passed: Column) -> DataFrame:
    """All-pass, accuracy and its interval for each group of several columns, in one pass."""
    g = rows.withColumn("_p", passed.cast("int"))
    facets = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in by]))
    d = g.select(facets.alias("f"), "_p").groupBy("f.field", "f.value").agg(F.count("*").alias("n"), F.sum("_p").cast("long").alias("hits"))
    low, high = wilson_95(F.col("hits"), F.col("n"))
    return d.select("field", "value", "n", (F.col("hits") == F.col("n")).alias("passed"), rounded(F.col("hits") / F.col("n")).alias("accuracy"), low.alias("low"), high.alias("high"))


def episodes(rows: DataFrame, episode: str, row: str, passed: Column) -> DataFrame:
    return rows.groupBy(episode).agg(F.count("*").alias("n"), F.bool_and(passed).alias("passed"), rounded(F.avg(passed.cast("int"))).alias("row_accuracy"), F.array_join(F.array_sort(F.collect_list(F.when(~passed, F.col(row)))).cast("array<string>"), ",").alias("failed_rows"))


def percentiles(rows: DataFrame, value: str, by: list[str], points: list[float], limit: int) -> DataFrame:
    """Nearest-rank percentiles and counts over a limit for all rows, each column and their pairs."""
    points_sql = ", ".join(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY {value}) AS BIGINT) AS p{round(p * 100)}" for p in points)
    sets = ["()", *[f"({c})" for c in by], f"({', '.join(by)})"] if len(by) > 1 else ["()", f"({by[0]})"]
    return rows.sparkSession.sql(f"SELECT {', '.join(by)}, count(*) AS n, {points_sql}, max({value}) AS most, count_if({value} > {limit}) AS over FROM {{rows}} GROUP BY GROUPING SETS ({', '.join(sets)})", rows=rows)


def latency(rows: DataFrame, ms: str, budget: float) -> DataFrame:
    return rows.agg(F.count(ms).alias("n"), F.min(ms).alias("least"), F.median(ms).alias("middle"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {ms})").alias("p95"), F.max(ms).alias("most"), rounded(F.avg((F.col(ms) > budget).cast("int"))).alias("miss_rate"))


def rolling(rows: DataFrame, order: str, ms: str, keep: int = 200) -> DataFrame:
    """Of the last rows: p50 and p95 as the sorted values at n*50//100 and n*95//100 (from 0), and the largest."""
    last = rows.orderBy(F.desc(order)).limit(keep)
    v = last.agg(F.array_sort(F.collect_list(ms)).alias("v"), F.count(ms).alias("n"))
    at = lambda p: F.get("v", F.floor(F.col("n") * p / 100).cast("int"))
    return v.select("n", at(50).alias("p50"), at(95).alias("p95"), F.element_at("v", -1).alias("most"))


def token_overlap(rows: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """Multiset precision, recall and F1 of two token arrays; two empty ones agree."""
    common = F.aggregate(F.array_distinct(gold), F.lit(0), lambda acc, w: acc + F.least(F.size(F.filter(gold, lambda x: x == w)), F.size(F.filter(predicted, lambda x: x == w))))
    n, m = F.size(predicted), F.size(gold)
    p, r = F.when(n > 0, common / n).otherwise((m == 0).cast("double")), F.when(m > 0, common / m).otherwise((n == 0).cast("double"))
    return rows.withColumn("precision", rounded(p)).withColumn("recall", rounded(r)).withColumn("f1", rounded(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))))


def gates(summary: DataFrame, floors: dict[str, float], missing: str = "fail") -> DataFrame:
    """A row a gate: value, floor, passed. A metric that is null fails, or is left out where ``missing`` is skip."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("floor")) for k, v in floors.items()]))
    out = summary.select(each.alias("g")).select("g.*")
    if missing == "skip":
        out = out.where("value is not null")
    return out.withColumn("passed", F.coalesce(F.col("value") >= F.col("floor"), F.lit(False)))


def deltas(before: DataFrame, after: DataFrame, row: str, group: str, passed: str, tolerance: float = -0.02) -> DataFrame:
    """Accuracy of each group in two reports joined by row, and whether the loss is within tolerance."""
    b = before.select(row, F.col(group).alias("group"), F.col(passed).cast("int").alias("b"))
    a = after.select(row, F.col(passed).cast("int").alias("a"))
    g = b.join(a, row).groupBy("group").agg(F.avg("b").alias("b"), F.avg("a").alias("a"))
    return g.select("group", rounded(F.col("b")).alias("baseline"), rounded(F.col("a")).alias("candidate"), rounded(F.col("a") - F.col("b")).alias("delta"), (rounded(F.col("a") - F.col("b")) >= tolerance).alias("held"))


def job_status(events: DataFrame, session: str, job: str, order: str, status: Column) -> DataFrame:
    """A job's last status by its lifecycle events; accepted counts as running."""
    named = F.when(status == "accepted", "running").otherwise(status)
    return events.groupBy(session, job).agg(F.max_by(named, F.col(order)).alias("status"), F.min(order).alias("accepted_index"), F.max(order).alias("last_index"))


def checkpoint_choice(reports: DataFrame, tag: str, keys: list[str], order: str) -> DataFrame:
    """The best report by several keys in turn, the earliest of equals."""
    return reports.orderBy(*[F.desc(k) for k in keys], order).limit(1).select(tag, *keys)


def judged(rows: DataFrame, judgments: DataFrame, id: str, verdict: str) -> DataFrame:
    """Rows with their verdict; a row without one is ``missing`` and fails. Verdicts without a row are left out."""
    v = judgments.select(id, F.col(verdict).alias("verdict"))
    return rows.join(v, id, "left").withColumn("verdict", F.coalesce("verdict", F.lit("missing"))).withColumn("passed", F.col("verdict") == "pass")


def adjudicated(first: DataFrame, second: DataFrame, rulings: DataFrame, id: str, verdict: str) -> DataFrame:
    """Two reviews of the same rows and rulings on their disagreements: final verdict, agreement, and what is wrong.

    A row in one review only, a disagreement without a ruling and a ruling
    without a disagreement have an error.
    """
    a, b, c = (x.select(id, F.col(verdict).alias(n)) for x, n in ((first, "a"), (second, "b"), (rulings, "c")))
    m = a.join(b, id, "full_outer").join(c, id, "full_outer")
    agreed = F.col("a") == F.col("b")
    error = F.when(F.col("a").isNull() | F.col("b").isNull(), "not reviewed twice").when(agreed & F.col("c").isNotNull(), "ruled without need").when(~agreed & F.col("c").isNull(), "not ruled")
    return m.select(id, F.coalesce(agreed, F.lit(False)).alias("agreed"), error.alias("error"), F.when(error.isNull(), F.coalesce("c", "a")).alias("verdict"))


def alignment(gold: DataFrame, predicted: DataFrame, row: str) -> DataFrame:
    """How many rows two reports share, and how many only one has: all is aligned if the latter are 0."""
    m = gold.select(row, F.lit(True).alias("g")).join(predicted.select(row, F.lit(True).alias("p")), row, "full_outer")
    return m.agg(F.count_if(F.col("g") & F.col("p")).alias("both_sides"), F.count_if(F.col("p").isNull()).alias("gold_only"), F.count_if(F.col("g").isNull()).alias("predicted_only"))


def support(rows: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """Rows in each slice, and whether no slice is empty."""
    n = rows.agg(*[F.count_if(c).alias(k) for k, c in slices.items()])
    full = F.lit(True)
    for k in slices:
        full = full & (F.col(k) > 0)
    return n.withColumn("passed", full)


def slices(rows: DataFrame, metrics: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A rate for each (which rows, what holds); null where no row is in the slice."""
    return rows.agg(*[rounded(F.avg(F.when(which, holds.cast("int")))).alias(k) for k, (which, holds) in metrics.items()])


def composite(kinds: list[tuple[Column, dict[str, float]]]) -> Column:
    """Weighted sum by the first kind that applies; a missing component counts 0."""
    out = None
    for applies, weights in kinds:
        total = F.lit(0.0)
        for name, w in weights.items():
            total = total + w * F.coalesce(F.col(name), F.lit(0.0))
        out = F.when(applies, total) if out is None else out.when(applies, total)
    return rounded(out)


def diagnoses(rows: DataFrame, item: str, right: Column) -> DataFrame:
    """Items answered rightly each time, at times, or never: a count of each."""
    i = rows.groupBy(item).agg(F.bool_and(right).alias("all"), F.bool_or(right).alias("some"))
    kind = F.when(F.col("all"), "recognised").when(F.col("some"), "order dependent").otherwise("missed")
    return i.groupBy(kind.alias("diagnosis")).agg(F.count("*").alias("n"))


def violates(verb: Column, granted: Column, needs: dict[str, str]) -> Column:
    """Whether an action needs a permission that isn't granted; verbs without a need never do."""
    need = F.lit(None).cast("string")
    for name, permission in needs.items():
        need = F.when(verb == name, permission).otherwise(need)
    return F.coalesce(~F.array_contains(granted, need), F.lit(False))


def beats(now: Column, before: Column, same_rows: Column) -> Column:
    """Better than the report before: only enforced where both are of the same rows."""
    return F.when(~F.coalesce(same_rows, F.lit(False)) | before.isNull(), "not enforced").when(now > before, "passed").otherwise("failed")
