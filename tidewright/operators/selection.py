"""Deterministic samples, splits, quotas and duplicate removal. Ranks come from SHA-256, never from chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(salt: str, id: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:"), id.cast("string")), 256)


def take(df: DataFrame, id: str, n: int, salt: str) -> DataFrame:
    """The n rows of the lowest hashed ids."""
    return df.orderBy(ranked(salt, F.col(id)), id).limit(n)


def exact_split(df: DataFrame, id: str, fraction: float, salt: str) -> DataFrame:
    """``split``: exactly round(n * fraction) ids are dev, those of the lowest hash; rows of an id stay together.

    The cut is a hash value found by a top-n over ids, so no window orders all ids in one task.
    """
    ids = df.select(id).distinct()
    n = int(ids.agg(F.bround(F.count("*") * fraction)).first()[0] or 0)
    dev = ids.orderBy(ranked(salt, F.col(id)), id).limit(n).withColumn("_dev", F.lit(True))
    return df.join(dev, id, "left").withColumn("split", F.when(F.col("_dev"), "dev").otherwise("train")).drop("_dev")


def largest_remainder(sizes: DataFrame, name: str, size: str, count: int, salt: str) -> DataFrame:
    """``allocation`` of ``count`` over strata in proportion to size; leftovers by largest remainder, ties by hash."""
    total = int(sizes.agg(F.sum(size)).first()[0] or 0)
    if count > total:
        raise ValueError("more items asked for than there are")
    if not total:
        return sizes.withColumn("allocation", F.lit(0).cast("long"))
    base = sizes.withColumn("_b", F.floor(F.lit(count) * F.col(size) / total).cast("long")).withColumn("_r", (F.lit(count) * F.col(size)) % total)
    left = count - int(base.agg(F.sum("_b")).first()[0])
    key = F.sha2(F.concat(F.lit(f"{salt}:stratum:"), F.col(name).cast("string")), 256)
    place = F.row_number().over(Window.orderBy(F.desc("_open"), F.desc("_r"), key))  # one row a stratum
    base = base.withColumn("_open", F.col("_b") < F.col(size)).withColumn("_p", place)
    return base.withColumn("allocation", F.col("_b") + F.when(F.col("_p") <= left, 1).otherwise(0)).drop("_b", "_r", "_p", "_open")


def stratified(df: DataFrame, id: str, stratum: str, count: int, salt: str) -> DataFrame:
    """``count`` rows, shared over strata by largest remainder, within each by hash."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    quota = largest_remainder(sizes, stratum, "_n", count, salt).select(stratum, "allocation")
    w = Window.partitionBy(stratum).orderBy(ranked(salt, F.col(id)), id)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= count).join(quota, stratum).where(F.col("_k") <= F.col("allocation")).drop("_k", "allocation")


def water_fill(pools: DataFrame, name: str, capacity: str, budget: int) -> DataFrame:
    """Round-robin ``allocation``: one unit a pool and round, in name order, until the budget or the capacities end.

    The number of whole rounds is searched on sums, so work doesn't grow with the budget.
    """
    cap = F.col(capacity)
    taken = lambda level: int(pools.agg(F.sum(F.least(cap, F.lit(level)))).first()[0] or 0)
    low, high = 0, int(pools.agg(F.max(cap)).first()[0] or 0)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if taken(middle) <= budget else (low, middle - 1)
    left = max(0, budget - taken(low))
    more = pools.where(cap > low).orderBy(name).limit(left).select(name, F.lit(1).alias("_more"))
    return pools.join(more, name, "left").withColumn("allocation", (F.least(cap, F.lit(low)) + F.coalesce("_more", F.lit(0))).cast("long")).drop("_more")


def spill(pools: DataFrame, name: str, capacity: str, budget: int) -> DataFrame:
    """``allocation``: pools are filled in name order; what one can't hold goes to the next."""
    before = F.coalesce(F.sum(capacity).over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a pool
    return pools.withColumn("allocation", F.greatest(F.lit(0), F.least(F.col(capacity), F.lit(budget) - before)).cast("long"))


def unique_take(df: DataFrame, episode: str, id: str, n: int, salt: str, used: DataFrame | None = None) -> DataFrame:
    """n rows of the lowest hash, at most one an episode, none of an episode in ``used``."""
    if used is not None:
        df = df.join(used.select(episode).distinct(), episode, "left_anti")
    w = Window.partitionBy(episode).orderBy(ranked(salt, F.col(id)), id)
    return take(df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k"), id, n, salt)


def representatives(df: DataFrame, key: Column, split: str, order: list[str]) -> DataFrame:
    """One row of each group of equal keys: of the split the key's hash asks for if the group has one, then the smallest by ``order``."""
    want = F.when(F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 10 == 0, "dev").otherwise("train")
    w = Window.partitionBy("_key").orderBy((F.col(split) != want).cast("int"), *order)
    return df.withColumn("_key", key).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_key")


def integrity(df: DataFrame, key: Column, split: str, corpus: str, answer: str) -> DataFrame:
    """Duplicate counters of a corpus: one row."""
    g = df.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.count_distinct(split).alias("s"), F.count_distinct(corpus).alias("c"), F.count_distinct(answer).alias("a"))
    return g.agg(F.sum("n").alias("rows"), F.count("*").alias("unique_rows"), F.count_if(F.col("n") > 1).alias("groups"), F.sum(F.col("n") - 1).alias("removed"), F.count_if(F.col("s") > 1).alias("cross_split"), F.count_if(F.col("c") > 1).alias("cross_corpus"), F.count_if(F.col("a") > 1).alias("conflicts"))


def numbered(df: DataFrame, order: str, name: str, buckets: int = 64, sample: int = 4096) -> DataFrame:
    """``name``: each row's place by ``order``, from 1, without ordering all rows in one task.

    Rows are dealt to ranges of ``order`` and numbered within; ranges start at
    the counts before them. The bounds come from ``sample`` rows of the lowest
    hash: they set the balance alone, not the numbers. Rows of equal ``order``
    stay in one range, so ``order`` should be nearly unique. Nulls come first.
    """
    some = [r[0] for r in df.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order)).limit(sample).collect()]
    some = sorted(set(some))
    bounds = sorted({some[len(some) * k // buckets] for k in range(1, buckets)}) if some else []
    if not bounds:
        bucket = F.lit(0)
    else:
        bucket = F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))), F.lit(0))
    dealt = df.withColumn("_b", F.when(F.col(order).isNull(), 0).otherwise(bucket))
    counts = sorted((r[0], r[1]) for r in dealt.groupBy("_b").count().collect())  # a row a range
    before, at = {}, 0
    for b, n in counts:
        before[b], at = at, at + n
    start = F.element_at(F.create_map(*[F.lit(x) for b, n in before.items() for x in (int(b), int(n))]), F.col("_b")) if before else F.lit(0)
    return dealt.withColumn(name, (F.row_number().over(Window.partitionBy("_b").orderBy(order)) + start).cast("long")).drop("_b")


def preceded(df: DataFrame, order: str, column: str, name: str) -> DataFrame:
    """``name``: ``column`` of the row before by ``order``, null for the first; places come from ``numbered``, so no task orders all rows."""
    at = numbered(df, order, "_at")
    before = at.select((F.col("_at") + 1).alias("_at"), F.col(column).alias(name))
    return at.join(before, "_at", "left").drop("_at")


def shards(df: DataFrame, id: str, line: Column, least: int, most_bytes: int) -> DataFrame:
    """``shard`` (1-based) and ``of``: equal contiguous slices by id, as few as fit the byte cap, ``least`` at least.

    Places come from ``numbered``; sizes are searched on sums a shard.
    """
    place = numbered(df.withColumn("_bytes", F.octet_length(line).cast("long") + 1), id, "_at").withColumn("_at", F.col("_at") - 1)
    n = df.count()
    count = least
    sizes = place.select("_at", "_bytes")
    while True:
        size = max(1, -(-n // count))
        worst = sizes.groupBy(F.floor(F.col("_at") / size)).agg(F.sum("_bytes").alias("b")).agg(F.max("b")).first()[0] or 0
        if worst <= most_bytes or size == 1:
            break
        count += 1
    return place.withColumn("shard", (F.floor(F.col("_at") / size) + 1).cast("long")).withColumn("of", F.lit(count).cast("long")).drop("_at", "_bytes")


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key in order, with how many it stands for.

    Keys travel as digests and are aggregated before the shuffle, so a key that
    many rows share doesn't land in one task.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    g = df.groupBy(F.sha2(key, 256).alias("_key")).agg(F.min_by(row, F.col(order)).alias("_row"), F.count("*").alias("copies"))
    return g.select("_row.*", "copies")


def cover(df: DataFrame, id: str, value: str, n: int, salt: str) -> DataFrame:
    """n rows: first one of each value, then others, both by hash."""
    h = ranked(salt, F.col(id))
    first = df.groupBy(value).agg(F.min_by(id, F.struct(h.alias("h"), F.col(id).alias("i"))).alias(id)).withColumn("_first", F.lit(True))
    marked = df.join(first.select(id, "_first"), id, "left")
    return marked.orderBy(F.coalesce("_first", F.lit(False)).desc(), h, id).limit(n).drop("_first")


def tagged(df: DataFrame, id: str, groups: dict[str, tuple[Column, int]], salt: str) -> DataFrame:
    """Exactly so many rows of each group, by hash, with ``group``; fewer where a group has fewer."""
    out = None
    for name, (which, n) in groups.items():
        part = take(df.where(which), id, n, salt).withColumn("group", F.lit(name))
        out = part if out is None else out.union(part)
    return out


def fingerprint(df: DataFrame, id: str, digest: Column) -> DataFrame:
    """Rows and the sum of 48 bits of each row's digest: the same in any order, unlike a digest of all lines."""
    one = F.conv(F.substring(F.sha2(F.concat(F.col(id).cast("string"), F.lit(":"), digest), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.sum(one).cast("string").alias("fingerprint"))


def coverage(expected: DataFrame, found: DataFrame, id: str) -> DataFrame:
    """Ids that are missing and ids that are extra; both 0 for an exact cover."""
    miss = expected.join(found, id, "left_anti").agg(F.count("*").alias("missing"))
    return miss.join(found.join(expected, id, "left_anti").agg(F.count("*").alias("extra")))


def apportion(weights: DataFrame, name: str, weight: str, total: int) -> DataFrame:
    """``allocation`` of ``total`` by integer weights: largest remainder, ties by name."""
    whole = int(weights.agg(F.sum(weight)).first()[0] or 0)
    if not whole:
        return weights.withColumn("allocation", F.lit(0).cast("long"))
    d = weights.withColumn("_b", F.floor(F.lit(total) * F.col(weight) / whole).cast("long")).withColumn("_r", (F.lit(total) * F.col(weight)) % whole)
    left = total - int(d.agg(F.sum("_b")).first()[0])
    place = F.row_number().over(Window.orderBy(F.desc("_r"), name))  # one row a name
    return d.withColumn("_p", place).withColumn("allocation", F.col("_b") + F.when(F.col("_p") <= left, 1).otherwise(0)).drop("_b", "_r", "_p")


def leakage(train: DataFrame, dev: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """How many distinct keys of each kind two sets share: a row a kind."""
    out = None
    for name, key in keys.items():
        both = train.select(key.alias("k")).intersect(dev.select(key.alias("k"))).agg(F.lit(name).alias("kind"), F.count("*").alias("shared"))
        out = both if out is None else out.union(both)
    return out
