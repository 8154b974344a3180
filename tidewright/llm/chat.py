"""Reply trees to chat training text.

Messages form trees by parent links. Root-to-leaf paths come from iterative
self-joins with doubling strides (a round joins each path's topmost known
message with a table of 2^k-fold ancestors, so depth d takes log2(d) rounds).
Branches are ranked by the mean score of their messages, and each chosen path
becomes one conversation.

The template is text of turns. Turns under the loss are ``<s>role\\nbody</s>``,
others ``[INST role]``-like: ``[INST role\\nbody[/INST]``. In bodies and roles
``&``, ``<`` and ``[`` are written ``&amp;``, ``&lt;`` and ``&#91;`` (and in
roles the newline ``&#10;``), so no control string can come from a text, and
the texts can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm._common import cut

LEARNED = "assistant"
TURN = r"(?s)(<s>|\[INST )([^\n<\[]*)\n([^<\[]*)(?:</s>|\[/INST\])"


def escape(c: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in (("\n", "&#10;"), ("[", "&#91;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, hops) for every leaf and each message above it, itself at 0 hops.

    messages: tree, node, parent (any types, nulls compare equal in tree; node
    is unique in a tree). A parent that is not in the tree makes a root. A path
    that runs into a cycle stops after as many messages as its tree has; a
    cycle without a leaf has no path.
    """
    size = messages.groupBy("tree").agg(F.count("*").alias("most"))
    known = cut(messages.select("tree", "node", "parent"))
    same = lambda a, b, x, y: a["tree"].eqNullSafe(b["tree"]) & (a[x] == b[y])
    a, b = known.alias("a"), known.alias("b")
    jump = known.where("parent is not null").select("tree", F.col("node").alias("low"), F.col("parent").alias("high"))
    jump = cut(jump.alias("j").join(b, F.col("j.tree").eqNullSafe(F.col("b.tree")) & (F.col("j.high") == F.col("b.node")), "left_semi"))
    leaf = a.join(b, F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.node") == F.col("b.parent")), "left_anti")
    found = leaf.alias("l").join(size.alias("s"), F.col("l.tree").eqNullSafe(F.col("s.tree"))).select(F.col("l.tree").alias("tree"), F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("hops"), "most")
    step = 1
    while not jump.isEmpty():
        f, j = found.alias("f"), jump.alias("j")
        above = f.join(j, F.col("f.tree").eqNullSafe(F.col("j.tree")) & (F.col("f.node") == F.col("j.low"))).where(F.col("hops") + step < F.col("most"))
        found = cut(found.union(above.select("f.tree", "leaf", F.col("high"), F.col("hops") + step, "most")))
        x, y = jump.alias("x"), jump.alias("y")
        longest = found.agg(F.max("hops")).first()[0] or 0
        if longest < step:
            break
        jump = cut(x.join(y, F.col("x.tree").eqNullSafe(F.col("y.tree")) & (F.col("x.high") == F.col("y.low"))).select("x.tree", "x.low", "y.high"))
        step *= 2
    return found.drop("most")


def best(messages: DataFrame, top: int = 1) -> DataFrame:
    """The messages of the ``top`` branches of each tree, by mean score, ties to the smaller leaf.

    Result: tree, branch (1 is best), leaf, depth (0 at the root), and the
    messages' role and text. Null scores count as 0.
    """
    way = paths(messages).alias("p")
    m = messages.alias("m")
    full = cut(way.join(m, F.col("p.tree").eqNullSafe(F.col("m.tree")) & (F.col("p.node") == F.col("m.node"))).select("p.tree", "leaf", "hops", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score")))
    rank = Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")
    branch = full.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.max("hops").alias("longest")).withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= top)
    b, f = branch.alias("b"), full.alias("f")
    return b.join(f, F.col("b.tree").eqNullSafe(F.col("f.tree")) & (F.col("b.leaf") == F.col("f.leaf"))).select("b.tree", "branch", "b.leaf", (F.col("longest") - F.col("hops")).alias("depth"), "role", "text")


def render(chosen: DataFrame, learned: str = LEARNED) -> DataFrame:
    """One row a branch: tree, branch, formatted, loss_spans (start, length in code points of the escaped text).

    Null roles and texts are empty.
    """
    learn = F.coalesce(F.col("role"), F.lit("")) == learned
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&#10;"))
    body = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.when(learn, "<s>").otherwise("[INST "), role, F.lit("\n"))
    turn = F.struct("depth", head.alias("head"), body.alias("body"), F.when(learn, "</s>").otherwise("[/INST]").alias("tail"), learn.alias("learn"))
    got = chosen.groupBy("tree", "branch").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], x["tail"])), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        begin, n = acc["at"] + F.length(x["head"]), F.length(x["body"])
        span = F.array(F.struct(begin.alias("start"), n.alias("length")))
        return F.struct((begin + n + F.length(x["tail"])).alias("at"), F.when(x["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return got.select("tree", "branch", whole.alias("formatted"), F.aggregate("t", start, add)["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    roles, texts = (F.regexp_extract_all(formatted, F.lit(TURN), F.lit(k)) for k in (2, 3))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))


def learned_text(formatted: Column, spans: Column) -> Column:
    """What lies under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
