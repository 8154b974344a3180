"""Credentials in texts, told from examples by who else has them.

DataFrame functions alone. Candidates come from patterns; a candidate's place
in the text is the sum of the lengths of what a split by the same pattern
leaves before it. Their hashes are then counted over the corpus by distinct
repositories and owners: a value that several owners hold is a widely copied
example, one that a single owner holds is likely live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm._common import cut

#: Kind, pattern, group that holds the value, least length of it. The first three are the base kinds.
KINDS = [
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", 0, 20),
    ("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", 0, 50),
    ("url", r"[a-z][a-z0-9+.]{1,15}://[^\s:/@]+:([^\s:/@]{4,})@", 1, 4),
    ("vendor", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})", 0, 10),
]
BASE = 3
#: What must be in a text before a pattern is worth its while (hex: a run of the least length).
HINT = {"hex": "[0-9a-f]{24}", "access": "AKIA[A-Z0-9]{16}", "key": "-----BEGIN ", "jwt": r"eyJ[A-Za-z0-9_-]{8}", "url": "://[^\\s:/@]+:"}


def _spans(text: Column, order: int) -> Column:
    """Matches of one kind: array of (start, kind order, end, value); in code points."""
    kind, pattern, group, least = KINDS[order]
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    if kind == "hex":
        pattern = "[0-9a-f]{%d,}" % least  # a run is matched from its first character, so short runs can be left out
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("before"), whole.alias("match"), value.alias("value"))
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["match"])
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), x["value"].alias("value")))
        good = F.length(x["value"]) >= least
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), F.when(good, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.when(text.rlike(HINT.get(kind, pattern)), F.aggregate(pairs, begin, add)["spans"]).otherwise(none)


def _said(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, *, repository: str = "source", owner: str | None = None, example_owners: int = 2) -> DataFrame:
    """One row a row of ``docs``: doc_id, spans (array of start, kind, end, repositories, owners, live).

    A value held by ``example_owners`` owners or more is an example. ``owner``
    defaults to the part of ``repository`` before the first ``/``. Null
    repositories are one repository. A null or empty text has no spans; an
    empty table gives no rows; repeated rows each get theirs. Texts are
    scanned once: what is found (no text) is written to the shared folder.
    """
    text = F.coalesce("text", F.lit(""))
    found = F.array_sort(F.concat(*[_spans(text, i) for i in range(len(KINDS))]))
    repo = F.coalesce(F.col(repository).cast("string"), F.lit(""))
    own = F.coalesce(F.col(owner).cast("string"), F.lit("")) if owner else F.substring_index(repo, "/", 1)
    hashed = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.md5(s["value"]).alias("hash"))
    seen = cut(docs.select("doc_id", repo.alias("repo"), own.alias("owner"), F.transform(found, hashed).alias("spans")))
    seen = seen.withColumn("row", F.monotonically_increasing_id())
    each = seen.select("row", "repo", "owner", F.explode("spans").alias("s"))
    held = each.select(F.col("s.hash").alias("hash"), "repo", "owner").distinct()
    owners = held.groupBy("hash").agg(F.count_distinct("repo").alias("repositories"), F.count_distinct("owner").alias("owners"))
    told = each.withColumn("hash", F.col("s.hash")).join(owners, "hash")
    span = F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), "repositories", "owners", (F.col("owners") < example_owners).alias("live"))
    per_row = told.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("found"))
    return seen.select("row", "doc_id").join(per_row, "row", "left").select("doc_id", F.coalesce("found", F.array()).alias("spans"))


def report(scanned: DataFrame) -> DataFrame:
    """Counts, digest and places a document, from ``scan``'s rows."""
    base = F.filter("spans", lambda s: s["kind"] < BASE)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    n = [count(k).alias(f"n_{KINDS[k][0]}") for k in range(BASE)]
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return scanned.select("doc_id", *n, F.sha2(_said(base), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"), live.alias("n_live"), (F.size("spans") - live).cast("long").alias("n_example"))
