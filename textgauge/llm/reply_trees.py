"""Chat formatting of reply trees, with DataFrame functions only.

Messages that answer messages form trees; each path from a root to a leaf is a conversation.

1. Iterative self-joins double how far each message sees: a round joins every message's ancestor 2^k above it with that one's
   own, so a chain of n messages takes log2(n) rounds.  They give each message's depth and the scores above it.
2. Leaves are ranked within their tree by the mean score of their path, and the first `most` of them are chosen.
3. The rounds' tables enumerate the chosen paths: what a path has so far is joined with the messages 2^k above.
4. Texts join the enumerated paths once, and each path becomes one conversation with the mask of what is trained on.

The template is `<|im_start|>role LF text<|im_end|> LF`.  In texts every `<` with any number of backslashes before a `|` gets one
backslash more, so that none has a control string; roles have `%`, LF and `|` as percent codes.  Both can be undone.

Joins on ancestors are plain equi-joins, whose large partitions Spark splits at run time, so that a message with very many
replies doesn't fall to one task.  One path is one value in the end (2 GB at most).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_table, in_order, materialise

START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are trained on.
TRAINED = "assistant"
#: Pieces of a tree in which its best paths are looked for first.
SALTS = 64


def escape(text: Column) -> Column:
    """The text without any control string: one backslash more between each `<` and `|` that only backslashes part."""
    return F.regexp_replace(text, r"<(\\*+)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", r"<$1|")


#: What a role can't have as it is, and its code; the sign of the codes comes first.
CODES = [("%", "%25"), ("\n", "%0A"), ("|", "%7C")]


def escape_role(role: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), CODES, role)


def unescape_role(role: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), reversed(CODES), role)


def messages_of(df: DataFrame, tree: str, message: str, parent: str, role: str, text: str, score: str | None = None) -> DataFrame:
    """The messages as a table: tree, node, above, role, text, score; trees and nodes as text, so that nulls have a value too.

    Null roles and texts are empty, null scores 0.  Of rows with one tree and message the one with the best score, then the
    least digest of role and text, stays.  A message without an id has no replies and is never the same as another.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    points = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    alone = F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))
    rows = df.select(
        key(tree).alias("tree"), F.when(F.col(message).isNull(), alone).otherwise(key(message)).alias("node"), F.when(F.col(parent).isNotNull(), key(parent)).alias("above"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), points.alias("score"),
    )
    place = F.row_number().over(W.partitionBy("tree", "node").orderBy(F.desc("score"), F.md5(F.concat_ws("\n", "role", "text")), F.col("above")))
    return materialise(rows.withColumn("__place", place).where("__place = 1").drop("__place"), "messages")


def ancestors(messages: DataFrame) -> list[DataFrame]:
    """Tables, one a round: tree, node, up, steps, total.

    In that of round k, `up` is the ancestor 2^k above the node, or null where its root is nearer; steps counts the messages
    from the node up to before that, or to its root, and total sums their scores.  The last has no `up`, except on circles.
    """
    known = messages.select("tree", F.col("node").alias("above"), F.lit(True).alias("known"))
    first = messages.select("tree", "node", "above", "score").join(known, ["tree", "above"], "left")
    first = first.select("tree", "node", F.when(F.col("known"), F.col("above")).alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total"))
    rounds, n = [materialise(first, "ancestors")], messages.count()
    while 1 << (len(rounds) - 1) <= n and not rounds[-1].where("up is not null").isEmpty():
        last = rounds[-1]
        above = last.select("tree", F.col("node").alias("up"), F.col("up").alias("__up"), F.col("steps").alias("__steps"), F.col("total").alias("__total"))
        going = last.where("up is not null").join(above, ["tree", "up"])
        going = going.select("tree", "node", F.col("__up").alias("up"), (F.col("steps") + F.col("__steps")).alias("steps"), (F.col("total") + F.col("__total")).alias("total"))
        rounds.append(materialise(last.where("up is null").unionByName(going), "ancestors"))
    return rounds


def best_paths(rounds: list[DataFrame], most: int | None = 1) -> DataFrame:
    """tree, leaf, steps, path_score, rank of the chosen leaves: the first `most` of each tree by mean score, then by leaf.

    Without `most` all leaves, unranked.  The best are found in SALTS pieces of a tree first, so that no task ranks a whole one.
    """
    parents = rounds[0].where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    # what still sees an ancestor after the last round hangs on a circle and has no root
    leaves = rounds[-1].where("up is null").join(parents, ["tree", "node"], "left_anti")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), "steps", (F.col("total") / F.col("steps")).alias("path_score"))
    if most is None:
        return leaves.withColumn("rank", F.lit(None).cast("long"))
    order = [F.desc("path_score"), F.col("leaf")]
    leaves = leaves.withColumn("__salt", F.pmod(F.xxhash64("leaf"), F.lit(SALTS)))
    for keys in (["tree", "__salt"], ["tree"]):
        leaves = leaves.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return leaves.drop("__salt")


def members(rounds: list[DataFrame], paths: DataFrame) -> list[DataFrame]:
    """Tables of tree, leaf, node, up_by: the messages of each path and how far above its leaf they are, each once."""
    tables = [materialise(paths.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up_by"), "steps"), "path")]
    for k, found in enumerate(rounds[:-1]):
        so_far = reduce(DataFrame.unionByName, tables).where(F.col("up_by") + (1 << k) < F.col("steps"))
        above = found.where("up is not null").select("tree", "node", "up")
        tables.append(materialise(so_far.join(above, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("up_by") + (1 << k)).alias("up_by"), "steps"), "path"))
    return tables


def format_paths(df: DataFrame, tree: str, message: str, parent: str, role: str = "role", text: str = "text", score: str | None = None, most: int | None = 1) -> DataFrame:
    """One row per chosen path, as a table: tree, leaf (as text), rank, path_score, n_turns, formatted, loss.

    `loss` has a start and a stop (code points, end exclusive) in `formatted` for each turn: those of an assistant's text, or
    twice the same place.  A message whose parent is null or missing is a root; those on a circle, and their replies, are on no
    path.  Repeated rows count once (see `messages_of`); ties of scores go to the smaller leaf.  A tree without an id is a tree
    of its own, with tree null.  An empty table gives an empty result; other columns aren't read, whatever their names.
    """
    messages = messages_of(df, tree, message, parent, role, text, score)
    rounds = ancestors(messages)
    paths = materialise(best_paths(rounds, most), "best-paths")
    parts = members(rounds, paths)
    rows = reduce(DataFrame.unionByName, parts).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.select("tree", "leaf", (F.col("steps") - F.col("up_by")).alias("at"), (F.col("role") == TRAINED).alias("trained"), head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.select("*", F.concat("head", "body", F.lit(END + "\n")).alias("piece"))
    ends = F.sum(F.length("piece")).over(W.partitionBy("tree", "leaf").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    start = ends - F.length("piece") + F.length("head")
    rows = rows.select("tree", "leaf", "at", "piece", start.alias("start"), (start + F.when(F.col("trained"), F.length("body")).otherwise(0)).alias("stop"))
    turns = rows.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "start", "stop"))).alias("turns"))
    formatted = turns.select(
        "tree", "leaf", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t.piece), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t.start.alias("start"), t.stop.alias("stop"))).alias("loss"),
    )
    out = formatted.join(paths.select("tree", "leaf", "rank", "path_score"), ["tree", "leaf"])
    plain = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
    table = materialise(out.withColumn("tree", plain), "formatted")
    for x in (messages, *rounds, paths, *parts):
        drop_table(x)
    return table


def read_back(formatted: DataFrame) -> DataFrame:
    """tree, leaf, formatted_chars and turns of formatted paths: an array of at, role, text, and trained, the text under the mask.

    The strings are cut at their start marks, and the mask is laid on what is there; nothing but `formatted` and `loss` is read.
    """
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, 1 << 30)
    marked = F.zip_with(pieces, F.col("loss"), lambda p, m: F.struct(F.concat(F.lit(START), p).alias("piece"), m.start.alias("start"), m.stop.alias("stop")))
    rows = formatted.select("tree", "leaf", F.length("formatted").cast("long").alias("chars"), F.posexplode(marked).alias("at", "x")).select("tree", "leaf", "chars", "at", "x.*")
    ends = F.sum(F.length("piece")).over(W.partitionBy("tree", "leaf").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("begins", ends - F.length("piece")).withColumn("role", F.substring(F.substring_index("piece", "\n", 1), len(START) + 1, 1 << 30))
    used = F.length("role") + len(START) + 1
    text = F.substring(F.col("piece"), used + 1, F.length("piece") - used - len(END) - 1)
    trained = F.substring(F.col("piece"), (F.col("start") - F.col("begins") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int"))
    rows = rows.select("tree", "leaf", "chars", "at", unescape_role(F.col("role")).alias("role"), unescape(text).alias("text"), unescape(trained).alias("trained"))
    return rows.groupBy("tree", "leaf").agg(F.max("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("at", "role", "text", "trained"))).alias("turns"))


def replies(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations by turn as messages: each turn answers the one before.  Adds message and parent, from 1 on.

    Turns go in order, null ones first; those with one number by the digest of role and text.
    """
    placed = in_order(conversations, conv, turn, F.md5(F.concat_ws("\n", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))), "message")
    return placed.withColumn("parent", F.when(F.col("message") > 1, F.col("message") - 1))


def conversation_digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What is read back from formatted conversations, as counts and digests."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learned = F.array_join(F.transform("turns", lambda t: t.trained), "")
    return back.select(
        F.col("tree").cast("long").alias(conv), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars",
    )
