"""One record to many turns: scenes, tick scripts, expanded banks, schedules and growth scenarios, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import scalars as S
from tidewright.operators.selection import numbered

#: Pauses by class, and gaps of a scene's silent ticks, in milliseconds.
PAUSES = {"none": (540, 820), "short": (1_000, 3_000), "medium": (4_000, 9_000), "long": (10_000, 30_000)}
TYPING, INITIAL, UNCHANGED, CLEAR = (520, 820), (520, 780), (540, 850), (560, 1_100)
CHUNK = 5


def pause(key: Column, kind: Column) -> Column:
    """A gap of the pause's class by hash; null for an unknown class."""
    out = F.lit(None).cast("long")
    for name, (low, high) in PAUSES.items():
        out = F.when(kind == name, S.stable_int(key, low, high)).otherwise(out)
    return out


def skeleton(id: Column) -> Column:
    """How an episode opens, settles and ends, by hash of its id."""
    v = S.stable_int(F.concat(id, F.lit(":skeleton")), 0, 3)
    return F.struct(
        F.concat(F.lit("v"), v.cast("string")).alias("variant"),
        v.isin(1, 2, 3).alias("lead_unchanged"),
        v.isin(0, 1, 2).alias("clear"),
        (v == 2).alias("tail_unchanged"),
        (S.stable_int(F.concat(id, F.lit(":midpause")), 0, 2) == 0).alias("mid_long_pause"),
    )


def scenes(records: DataFrame, id: str = "id", segments: str = "segments") -> DataFrame:
    """Turns of authored scenes: two silent ticks, each segment typed in chunks and followed by a pause, a clearing tick.

    Segments are structs of kind (narration, address), text, pause_after,
    gold_reply and traps. Rows have idx, state, elapsed_ms, content, verb,
    message, segment_index and role (null where a turn is no candidate). Empty
    segments are left out; a record without segments has its silent ticks.
    """
    key = F.col(id).cast("string")
    base = records.select(key.alias("id"), F.filter(segments, lambda s: F.length(s["text"]) > 0).alias("segs"))
    base = base.withColumn("full", F.array_join("segs.text", "\n"))
    seg = base.select("id", "full", F.posexplode("segs").alias("segment_index", "s"))
    before = Window.partitionBy("id").orderBy("segment_index")
    name = F.concat("id", F.lit(":segment:"), F.col("segment_index").cast("string"))
    length = F.length("s.text") + F.when(F.col("segment_index") > 0, 1).otherwise(0)
    seg = seg.withColumn("name", name).withColumn("length", length).withColumn("past", F.sum("length").over(before) - F.col("length"))
    address = F.col("s.kind") == "address"
    typed = seg.withColumn("sizes", S.chunk_sizes(F.col("length"), F.col("name"))).withColumn("n", F.size("sizes"))
    typed = typed.select("*", F.posexplode("sizes").alias("step", "size"))
    last = F.col("step") == F.col("n") - 1
    shown = F.col("past") + F.sum("size").over(Window.partitionBy("id", "segment_index").orderBy("step"))
    hard = F.size(F.filter(F.coalesce("s.traps", F.array().cast("array<string>")), lambda x: x != "none")) > 0
    role = F.when(address & last, "address-positive").when(address & (F.col("step") == F.col("n") - 2), "address-before").when(~address & last & hard, "narration-hard-idle").when(~address & last, "narration-ballast")
    gap = S.stable_int(F.concat("name", F.lit(":tick:"), F.col("step").cast("string"), F.lit(":time")), *TYPING)
    reply = F.when(address & last, F.col("s.gold_reply"))
    none = F.lit(None).cast("string")
    columns = ["id", "full", "segment_index", "step", "gap", "shown", "state", "message", "role"]
    rows = typed.select("id", "full", "segment_index", "step", gap.alias("gap"), shown.alias("shown"), F.lit("active").alias("state"), reply.alias("message"), role.alias("role"))
    rest = seg.select("id", "full", "segment_index", (F.lit(1 << 30)).alias("step"), pause(F.concat("name", F.lit(":pause")), F.coalesce("s.pause_after", F.lit("none"))).alias("gap"), (F.col("past") + F.col("length")).alias("shown"), F.lit("idle").alias("state"), none.alias("message"), F.when(address, "address-after").alias("role"))
    silent = F.array(*[F.struct(F.lit(at).alias("segment_index"), S.stable_int(F.concat("id", F.lit(f":{what}")), *span).alias("gap"), F.lit(r).alias("role")) for at, what, span, r in ((-2, "initial-time", INITIAL, "empty-initial"), (-1, "unchanged-gap", UNCHANGED, "empty-unchanged"), (1 << 30, "clear-gap", CLEAR, "empty-cleared"))])
    quiet = base.select("id", F.inline(silent)).select("id", F.lit("").alias("full"), "segment_index", F.lit(0).alias("step"), "gap", F.lit(0).cast("long").alias("shown"), F.lit("idle").alias("state"), none.alias("message"), "role")
    w = Window.partitionBy("id").orderBy("segment_index", "step")
    every = rows.select(columns).union(rest.select(columns)).union(quiet.select(columns))
    out = every.withColumn("idx", F.row_number().over(w)).withColumn("elapsed_ms", F.sum("gap").over(w))
    content = F.substring(F.col("full"), F.lit(1), F.col("shown").cast("int"))
    index = F.when(F.col("segment_index").between(0, (1 << 30) - 1), F.col("segment_index"))
    return out.select("id", "idx", "state", "elapsed_ms", content.alias("content"), F.when(F.col("message").isNotNull(), "respond").otherwise("idle").alias("verb"), "message", index.alias("segment_index"), "role")


def tick_scripts(sessions: DataFrame, id: str = "id", steps: str = "steps") -> DataFrame:
    """Ticks of scripts whose steps (kind, text, count, expect) type, pause or take back, five characters a tick.

    A typing step's expectation is at its last character, a pause's at its last
    tick; all others are idle. A pause of no ticks has none.
    """
    kind = "struct<cur:string,out:array<struct<before:string,added:string,n:int,kind:string,expect:string>>>"
    start = F.from_json(F.lit('{"cur":"","out":[]}'), kind)

    def step(acc: Column, s: Column) -> Column:
        cur = acc["cur"]
        added = F.when(s["kind"] == "type", F.concat(F.when(cur != "", "\n").otherwise(""), s["text"])).otherwise("")
        n = F.when(s["kind"] == "type", F.ceil(F.length(added) / CHUNK)).when(s["kind"] == "pause", s["count"]).otherwise(F.greatest(F.lit(1), F.floor(s["count"] / CHUNK))).cast("int")
        after = F.when(s["kind"] == "backtrack", F.left(cur, F.greatest(F.lit(0), F.length(cur) - CHUNK * n))).otherwise(F.concat(cur, added))
        row = F.struct(cur.alias("before"), added.alias("added"), n.alias("n"), s["kind"].alias("kind"), s["expect"].alias("expect"))
        return F.struct(after.alias("cur"), F.array_append(acc["out"], row).alias("out"))

    each = sessions.select(F.col(id).alias("id"), F.posexplode(F.aggregate(steps, start, step)["out"]).alias("step", "s")).where("s.n > 0")
    each = each.select("id", "step", "s.*", F.explode(F.sequence(F.lit(1), F.col("s.n"))).alias("k"))
    content = F.when(F.col("kind") == "type", F.concat("before", F.left("added", F.col("k") * CHUNK))).when(F.col("kind") == "backtrack", F.left("before", F.greatest(F.lit(0), F.length("before") - F.col("k") * CHUNK))).otherwise(F.col("before"))
    expect = F.when((F.col("kind") != "backtrack") & (F.col("k") == F.col("n")), F.col("expect")).otherwise("idle")
    tick = F.row_number().over(Window.partitionBy("id").orderBy("step", "k"))
    return each.select("id", tick.alias("tick"), content.alias("content"), expect.alias("expect"))


def expanded(spark: SparkSession, requests: DataFrame, checks: DataFrame, nudges: DataFrame, count: int) -> DataFrame:
    """``count`` plans from banks with ``id``: requests in turn, all else by hash or by place in the cycle; equi-joins on computed places."""
    banks = {n: numbered(b.select(F.col("id").cast("string").alias("id")), "id", "at").withColumn("at", F.col("at") - 1) for n, b in (("request", requests), ("check", checks), ("nudge", nudges))}
    size = {n: max(1, b.count()) for n, b in banks.items()}
    i = spark.range(count).withColumnRenamed("id", "i").withColumn("at", F.col("i") % size["request"])
    plan = i.join(banks["request"], "at").withColumn("episode", F.concat(F.lit("plan-"), "id", F.lit("-v"), F.floor(F.col("i") / size["request"]).cast("string")))
    plan = plan.withColumnRenamed("id", "request_id").withColumn("content", F.element_at(F.array(F.lit("check"), F.lit("nudge"), F.lit("plain")), (F.col("i") % 3 + 1).cast("int"))).withColumn("outcome", F.when(F.col("i") % 5 == 0, "failure").otherwise("success"))
    for column, bank, wanted in (("check_id", "check", F.col("content") == "check"), ("nudge_id", "nudge", F.col("content") == "nudge"), ("failure_id", "check", F.col("outcome") == "failure")):
        at = F.when(wanted, S.stable_int(F.concat("episode", F.lit(f":{column}")), 0, size[bank] - 1))
        plan = plan.withColumn("at", at).join(banks[bank].withColumnRenamed("id", column), "at", "left")
    return plan.select("episode", "request_id", "content", "outcome", "check_id", "nudge_id", "failure_id")


def schedules(df: DataFrame, id: str, intervals: list[int], cancels: list[str]) -> DataFrame:
    """Knobs of a schedule by hash of its id; a collision only where it isn't cancelled."""
    key = lambda what: F.concat(F.col(id).cast("string"), F.lit(f":{what}"))
    every = S.stable_int(key("kind"), 0, 2) > 0
    one_of = lambda what, options: S.stable_choice(key(what), F.array(*map(F.lit, options)))
    d = df.select(id, F.when(every, "every").otherwise("once").alias("schedule_kind"), F.when(every, one_of("interval", intervals)).alias("interval_s"), F.when(every, S.stable_int(key("fire-cycles"), 2, 3)).otherwise(1).alias("fire_cycles"), F.when(every, one_of("cancel-variant", cancels)).otherwise("none").alias("cancel_variant"))
    return d.withColumn("collision", F.when(F.col("cancel_variant") == "none", one_of("collision", ["none", "bait", "address", "both"])).otherwise("none"))


def growth(spark: SparkSession, scenario: Column, source: str, ticks: int, a_tick: int) -> DataFrame:
    """Text on screen at each tick of a scenario: silent, steady or typed from a repeated source."""
    n = F.col("tick").cast("int") * a_tick
    typed = F.left(F.repeat(F.lit(source), F.ceil(n / len(source)).cast("int")), n)
    d = spark.range(1, ticks + 1).withColumnRenamed("id", "tick").withColumn("scenario", F.explode(scenario))
    return d.select("scenario", "tick", F.when(F.col("scenario") == "silent", "").when(F.col("scenario") == "steady", source).otherwise(typed).alias("content"), (F.col("tick") * S.TICK_MS).alias("elapsed_ms"))


def payload(**fields: Column) -> Column:
    """A tool's JSON with keys in the order given; null fields are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))
