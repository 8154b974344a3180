"""Lines that several documents share are kept in one of them only.

DataFrame functions alone. Lines are exploded as 128-bit hashes (no text is
shuffled), documents are counted for each hash by an aggregate that combines
before its shuffle, and lines of shared hashes go back to their documents as
positions, where the text is put together again in its own place.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm._common import cut, removed, written

BLANK = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id: before all others.
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), string.ascii_uppercase, string.ascii_lowercase)


#: A key with more than this share of all lines is hot; so there are fewer than HOT_SHARE ** -1 of them.
HOT_SHARE = 1 / 2000


def dedup_lines(docs: DataFrame, *, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """All columns of ``docs`` and kept (text), n_lines, n_dropped, one row a row.

    A line whose key has ``min_chars`` code points or more and occurs in
    ``min_docs`` or more documents is dropped, all its occurrences, from every
    document but the smallest doc_id that holds it. A null or empty text is one
    empty line. A null doc_id is one document, smaller than all others; rows of
    one doc_id are one document, each judged by its own lines. Clashing names
    are no matter: helper columns live in a struct of the table's own. Texts of
    very many lines are judged in time linear in their lines.

    Lines are hashed once, into a table of the shared folder. Keys that hold
    more than ``HOT_SHARE`` of all lines (fewer than 2,000 keys, whatever the
    corpus) are joined by broadcast, the others by a shuffle.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    lines = docs.select(doc.alias("d"), F.xxhash64(text).alias("t"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    key = line_key(F.col("line"))
    keyed, path = written(lines.where(F.length(key) >= min_chars).select("d", "t", "pos", F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")))
    counts = [F.count("*").alias("n"), F.min("d").alias("first")]
    if min_docs == 2:
        several = keyed.groupBy("h", "g").agg(*counts, F.max("d").alias("last")).where("first <> last")
    else:
        several = keyed.groupBy("h", "g").agg(*counts, F.count_distinct("d").alias("docs")).where(F.col("docs") >= min_docs)
    shared = cut(several.select("h", "g", "first", "n"))
    most = F.lit(int(keyed.count() * HOT_SHARE))
    hot = F.broadcast(shared.where(F.col("n") > most).select("h", "g", F.col("first").alias("hot_first")))  # fewer than 2,000 rows
    beside = keyed.join(hot, ["h", "g"], "left")
    common = beside.where("d <> hot_first").select("d", "t", "pos")
    rare = beside.where("hot_first IS NULL").drop("hot_first").join(shared.where(F.col("n") <= most).drop("n"), ["h", "g"]).where("d <> first").select("d", "t", "pos")
    gone = cut(common.union(rare).groupBy("d", "t").agg(F.collect_set("pos").alias("gone")))
    removed(spark, path)
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    own = own.withColumn("d", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID))).withColumn("t", F.xxhash64(F.coalesce("row.text", F.lit(""))))
    whole = F.split(F.coalesce("row.text", F.lit("")), "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col("gone"))  # by a hash set, in order
    left = F.array_join(F.transform(places, lambda i: F.get(whole, i)), "\n")
    stay = F.when(F.col("gone").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(left)
    told = own.join(gone, ["d", "t"], "left").select("row", stay.alias("kept"), F.size(whole).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    return told.select("row.*", "kept", "n_lines", "n_dropped")
