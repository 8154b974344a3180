"""Column builders for text keys, buckets and stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Conjunctions an opener skips, per-corpus length edges, tick length.
CONJUNCTIONS = ["and", "but", "so", "or", "then", "because"]
LENGTH_EDGES = {"narration": (500, 900), "passage": (400, 700), "clause": (220, 460), "request": (25, 45), "schedule": (40, 90)}
TICK_MS = 650


def normalized(v: Column) -> Column:
    """Trimmed, lower case, white space collapsed: the exact-duplicate key."""
    return F.regexp_replace(F.regexp_replace(F.lower(v), r"(?U)^\s+|\s+\z", ""), r"(?U)\s+", " ")


def slug(v: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(v), "[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def words(v: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(v), "[^a-z0-9']+", " "), " "), lambda w: w != "")


def word_prefix(v: Column, n: int) -> Column:
    """The first n words, punctuation aside."""
    return F.array_join(F.slice(words(v), 1, n), " ")


def opener(v: Column) -> Column:
    """The first word, after one conjunction if there is one."""
    w = words(v)
    return F.when(F.get(w, F.lit(0)).isin(CONJUNCTIONS), F.coalesce(F.get(w, F.lit(1)), F.lit(""))).otherwise(F.coalesce(F.get(w, F.lit(0)), F.lit("")))


def han_prefix(v: Column, n: int) -> Column:
    """The first n Han characters."""
    return F.substring(F.array_join(F.regexp_extract_all(v, F.lit(r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"), F.lit(0)), ""), 1, n)


def opening_key(v: Column, n_words: int, n_han: int) -> Column:
    han = han_prefix(v, n_han)
    return F.when(han != "", F.concat(F.lit("han:"), han)).otherwise(F.concat(F.lit("en:"), word_prefix(v, n_words)))


def share(count: Column, total: Column) -> Column:
    """0 where there is nothing to share."""
    return F.coalesce(F.try_divide(count.cast("double"), total.cast("double")), F.lit(0.0))


def length_bucket(n: Column, corpus: str) -> Column:
    low, high = LENGTH_EDGES[corpus]
    return F.when(n < low, "short").when(n < high, "medium").otherwise("long")


def position_bucket(position: Column, total: Column) -> Column:
    at = position / total
    return F.when(at <= 1 / 3, "early").when(at <= 2 / 3, "middle").otherwise("late")


def stable_int(key: Column, low: Column | int, high: Column | int) -> Column:
    """An integer of [low, high] from the key's SHA-256: its first 8 bytes modulo the span."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    n = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (low + (n % (high - low + 1)).cast("long")).cast("long")


def stable_choice(key: Column, options: Column) -> Column:
    return F.element_at(options, (stable_int(key, 0, F.size(options) - 1) + 1).cast("int"))


def stable_digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts), 256)


def occurrence_count(text: Column, quote: Column) -> Column:
    """Overlapping occurrences; none of the empty quote."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.length(quote)) == quote)
    return F.when(F.length(quote) > 0, F.size(places)).otherwise(0)


def find_occurrence(text: Column, quote: Column, n: Column) -> Column:
    """0-based start of the n-th overlapping occurrence, null if there is none."""
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: F.substring(text, i, F.length(quote)) == quote)
    return F.get(places, n - 1) - 1


def head_tail(v: Column, n: int, marker: str) -> Column:
    """The first and last half of n characters around a marker, where the text is longer."""
    return F.when(F.length(v) > n, F.concat(F.substring(v, 1, n // 2), F.lit(marker), F.right(v, F.lit(n - n // 2)))).otherwise(v)


def normalize_query(q: Column) -> Column:
    return F.regexp_replace(normalized(q), r"[?.!]+\z", "")


def ticks_at(seconds: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.floor(seconds * 1000 / TICK_MS))


def payload_status(content: Column) -> Column:
    """``status`` of a JSON body, null where the body is no JSON."""
    return F.get_json_object(content, "$.status")


def wilson_95(successes: Column, total: Column) -> tuple[Column, Column]:
    """95 % Wilson interval, clamped and rounded to 4 digits; null where nothing was tried."""
    z, n = 1.959964, total.cast("double")
    p = successes / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    some = lambda c: F.when(total > 0, F.bround(c, 4))
    return some(F.greatest(F.lit(0.0), centre - margin)), some(F.least(F.lit(1.0), centre + margin))


def chunk_sizes(length: Column, key: Column) -> Column:
    """Sizes of 4 to 7 characters that add up to ``length``, chosen by hash, with no rest under 4.

    A text of under 4 characters is one chunk, an empty one none.
    """
    state = F.struct(length.cast("long").alias("left"), F.array().cast("array<bigint>").alias("sizes"))

    def step(acc: Column, i: Column) -> Column:
        left = acc["left"]
        ok = F.filter(F.array(*[F.lit(s).cast("long") for s in range(4, 8)]), lambda s: (s == left) | (left - s >= 4))
        size = F.element_at(ok, (stable_int(F.concat(key, F.lit(":chunk:"), i.cast("string")), 0, F.greatest(F.size(ok), F.lit(1)) - 1) + 1).cast("int"))
        return F.when(left > 0, F.struct((left - size).alias("left"), F.array_append(acc["sizes"], size).alias("sizes"))).otherwise(acc)

    fold = F.aggregate(F.sequence(F.lit(0), F.ceil(length / 4).cast("int")), state, step)["sizes"]
    return F.when(length <= 0, F.array().cast("array<bigint>")).when(length < 4, F.array(length.cast("long"))).otherwise(fold)


#: Words that show no common ground.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"]


def grounded(message: Column, payload: Column) -> Column:
    """One shared token with a digit, or two shared tokens that are no stop words."""
    shared = F.array_except(F.array_intersect(words(message), words(payload)), F.array(*map(F.lit, STOPWORDS)))
    return F.exists(shared, lambda w: w.rlike("[0-9]")) | (F.size(shared) >= 2)


def term_coverage(terms: Column, text: Column) -> Column:
    """Share of the terms that occur in the text; null where there are none."""
    hit = F.size(F.filter(terms, lambda w: F.contains(text, w)))
    return F.bround(hit / F.nullif(F.size(terms), F.lit(0)), 6)


def unsafe(text: Column) -> Column:
    """Markup, control characters or an unbalanced code fence."""
    fences = F.regexp_count(text, F.lit("```")) % 2 == 1
    return text.rlike(r"</?[A-Za-z][^>]*>") | text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]") | fences
