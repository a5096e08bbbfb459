"""A trie of conversations by their first turns.

Each distinct sequence of first turns is a node.  It belongs to its smallest member, and a conversation that owns a node owns
all nodes below it on its own path, so that the nodes of a conversation are a chain from its first owned depth to its last turn.

1. Digests of all prefixes run along each conversation.  The conversations that have a prefix in common are counted once by
   digest; prefixes of one conversation only aren't kept, as it owns them.
2. Every conversation's first owned depth is found by binary search: each round looks the middle prefixes of all conversations up
   among the minima of shared prefixes in one join.  A last look names the owner of the prefix before, to which the chain is tied.
3. Chains form a tree.  Their totals go up it by doubling: a round adds to each chain those of the chains 2^k below.  Then sums
   run up along each chain.

Conversations are cut into stretches of `STRETCH` turns wherever something runs along one, so that a very long one isn't one
task's; digests and sums of whole stretches are carried on.  Joins whose keys may be hot leave it to Spark to split them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_RE, drop_table, in_order, materialise

#: Turns of a stretch.
STRETCH = 1 << 10
#: Conversations of a node that are listed in one string each.
LISTED = 1 << 12
NODE = "depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns_of(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """c, at (from 1), said (digest of role and text), words: no text leaves the scan.  Rows without a conversation are left out."""
    r, t = (F.coalesce(F.col(x), F.lit("")) for x in (role, text))
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("__turn"), F.md5(F.concat_ws("\n", r, t)).alias("__tie"),
        F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256)).substr(1, 16).alias("said"), F.size(F.regexp_extract_all(t, F.lit(f"({WORD_RE})"), F.lit(1))).cast("long").alias("words"),
    )
    return in_order(rows, "c", "__turn", F.col("__tie"), "at").select("c", F.col("at").cast("long").alias("at"), "said", "words")


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """c, d (from 1), said, words and size of rebuilt conversations; one without turns has a row with d = 0.

    Conversation c begins with the first h turns of conversation c - c % every (all if it has fewer, none if it is absent) and
    goes on with its own from the one after its first h on; h is crc32 of c in decimal modulo `heads`.
    """
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % heads).alias("h")
    sizes = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.col("c") - F.col("c") % every).select("c", "n", "base", h)
    bases = sizes.where("c = base").select("base", F.least("n", F.lit(heads)).alias("m"))
    # a row for each conversation; few have one base
    plan = materialise(sizes.join(bases, "base", "left").select("c", "base", "n", "h", F.least(F.col("h"), F.coalesce("m", F.lit(0))).alias("taken")), "trie-plan")
    size = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    own = turns.where(F.col("at") > 0).join(plan, "c").where(F.col("at") > F.col("h")).select("c", (F.col("at") - F.col("h") + F.col("taken")).alias("d"), "said", "words", size.alias("size"))
    first = turns.where(F.col("at") < heads).withColumnRenamed("c", "base")
    lent = plan.where("taken > 0").join(first, "base").where(F.col("at") <= F.col("taken")).select("c", F.col("at").alias("d"), "said", "words", size.alias("size"))
    none = plan.where(size == 0).select("c", F.lit(0).cast("long").alias("d"), F.lit(b"").alias("said"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("size"))
    return own.unionByName(lent).unionByName(none)


def running(rows: DataFrame, keys: list[str], order: str, said: str) -> DataFrame:
    """With `said` replaced by the digest of all in the row's group so far; groups pass through a task in order."""

    def digests(batches):
        last, sofar = None, b""
        for batch in batches:
            cols, out = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys], []
            for *key, x in zip(*cols, batch.column(batch.schema.get_field_index(said)).to_pylist()):
                sofar = hashlib.blake2b((sofar if key == last else b"") + x, digest_size=16).digest()
                last = key
                out.append(sofar)
            i = batch.schema.get_field_index(said)
            yield batch.set_column(i, batch.schema.field(i), pa.array(out, pa.binary()))

    return rows.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(digests, rows.schema)


def prefixes(rows: DataFrame) -> DataFrame:
    """A table of c, stretch, d, words, size and prefix, the digest of the first d turns."""
    rows = rows.where("d > 0").select("c", F.floor((F.col("d") - 1) / STRETCH).alias("stretch"), "d", "said", "words", "size")
    local = materialise(running(rows, ["c", "stretch"], "d", "said"), "trie-local")
    # the last digests of full stretches, for those that follow
    ends = local.where((F.col("d") % STRETCH == 0) & (F.col("d") < F.col("size"))).select("c", (F.col("stretch") + 1).alias("stretch"), "said")
    carried = running(ends, ["c"], "stretch", "said").withColumnRenamed("said", "carried")
    later = local.where("stretch > 0").join(carried, ["c", "stretch"]).withColumn("said", F.unhex(F.md5(F.concat("carried", "said")))).drop("carried")
    out = materialise(local.where("stretch = 0").unionByName(later).withColumnRenamed("said", "prefix"), "trie-prefixes")
    drop_table(local)
    return out


def first_owned(members: DataFrame, listed: DataFrame, shared: DataFrame) -> DataFrame:
    """A table of c, size, first: the first depth from 1 on whose prefix no smaller conversation has, or size + 1.

    A round probes the middle of what is left for every conversation that isn't done.  What a conversation owns at a depth it
    owns below, so log2(size + 1) rounds find it.  Probes of prefixes that aren't shared find nothing: those are owned.
    """
    state = materialise(members.select("c", "size", F.lit(1).cast("long").alias("lo"), (F.col("size") + 1).alias("hi")), "trie-search")
    while not state.where("lo < hi").isEmpty():
        middle = F.floor((F.col("lo") + F.col("hi")) / 2)
        probes = owners(state.where("lo < hi").withColumn("at", middle), listed, shared)
        owned = F.coalesce(F.col("owner"), F.col("c")) == F.col("c")
        probed = probes.select("c", "size", F.when(owned, F.col("lo")).otherwise(F.col("at") + 1).alias("lo"), F.when(owned, F.col("at")).otherwise(F.col("hi")).alias("hi"))
        after = materialise(state.where("lo = hi").unionByName(probed), "trie-search")
        drop_table(state)
        state = after
    return state.select("c", "size", F.col("lo").alias("first"))


def owners(probes: DataFrame, listed: DataFrame, shared: DataFrame) -> DataFrame:
    """Probes (c, at) with the owner of c's prefix of that depth, or null if no other conversation has it."""
    stretch = F.floor((F.col("at") - 1) / STRETCH)
    found = probes.withColumn("stretch", stretch).join(listed, ["c", "stretch"])
    found = found.withColumn("prefix", F.element_at("prefixes", (F.col("at") - F.col("stretch") * STRETCH).cast("int"))).drop("prefixes", "stretch")
    return found.join(shared.select("prefix", "owner"), "prefix", "left").drop("prefix")


def totals(chains: DataFrame, top: int) -> DataFrame:
    """A table of c, leaves and saved: the sums of each chain and all below it, by doubling.

    `chains` has c, up (the chain it is tied to, null for `top`), leaves and saved.  After round k a chain has the sums of all
    less than 2^k below, and adds those of the chains just 2^k below; the top one, to which most are tied, is joined with none.
    """
    state = materialise(chains, "trie-totals")
    while not state.where("up is not null").isEmpty():
        below = state.where("up is not null").groupBy(F.col("up").alias("c")).agg(F.sum("leaves").alias("__leaves"), F.sum("saved").alias("__saved"))
        above = state.where("up is not null").select(F.col("c").alias("up"), F.col("up").alias("__up"))
        going = state.where((F.col("up") != top)).join(above, "up", "left").select("c", F.col("__up").alias("up"), "leaves", "saved")
        done = state.where(F.col("up").isNull() | (F.col("up") == top)).select("c", F.lit(None).cast("long").alias("up"), "leaves", "saved")
        summed = going.unionByName(done).join(below, "c", "left")
        after = materialise(summed.select("c", "up", *((F.col(x) + F.coalesce(f"__{x}", F.lit(0))).alias(x) for x in ("leaves", "saved"))), "trie-totals")
        drop_table(state)
        state = after
    return state.drop("up")


def summed_up(rows: DataFrame, names: list[str]) -> DataFrame:
    """Each row's sums of `names` over the rows of its chain from its depth on; whole stretches are summed first."""
    later = W.partitionBy("c").orderBy(F.desc("stretch")).rowsBetween(W.unboundedPreceding, -1)
    whole = rows.groupBy("c", "stretch").agg(*(F.sum(x).alias(x) for x in names)).select("c", "stretch", *(F.sum(x).over(later).alias(f"__{x}") for x in names))
    within = W.partitionBy("c", "stretch").orderBy(F.desc("d")).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({x: F.sum(x).over(within) for x in names})
    out = out.join(whole.where(F.col(f"__{names[0]}").isNotNull()), ["c", "stretch"], "left")
    return out.withColumns({x: F.col(x) + F.coalesce(f"__{x}", F.lit(0)) for x in names}).drop(*(f"__{x}" for x in names))


def ends_of(ends: DataFrame) -> DataFrame:
    """c, d, ends_sha256 of nodes (c, d) at which conversations e end: the digest of their ids in ascending order.

    Ids are listed in strings of LISTED numbers at most first; a task feeds a node's strings to one digest, one after another,
    so that it holds none of them for long.
    """
    parts = ends.withColumn("part", F.floor(F.col("e") / LISTED)).groupBy("c", "d", "part").agg(F.array_sort(F.collect_list("e")).alias("es"))
    parts = parts.select("c", "d", "part", F.array_join(F.transform("es", lambda e: e.cast("string")), ",").alias("ids"))

    def digests(batches):
        node, digest = None, None
        for batch in batches:
            cs, ds, shas = [], [], []
            for c, d, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (c, d) != node:
                    if node is not None:
                        cs.append(node[0]), ds.append(node[1]), shas.append(digest.hexdigest())
                    node, digest = (c, d), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(cs, pa.int64()), pa.array(ds, pa.int64()), pa.array(shas, pa.string())], names=["c", "d", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([digest.hexdigest()], pa.string())], names=["c", "d", "ends_sha256"])

    return parts.repartition("c", "d").sortWithinPartitions("c", "d", "part").mapInArrow(digests, "c long, d long, ends_sha256 string")


def prefix_trie(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per node of the trie of `rows` (c, d, said, words, size, as `rebuilt` makes them).

    conv, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.  Conversations with the same turns
    share all their nodes; the smallest owns them.  Conversations without turns are members of the root only.  Without any
    conversation there is no node.
    """
    rows = materialise(rows, "trie-rows")
    members = rows.groupBy("c").agg(F.max("size").alias("size"))
    least, n = members.agg(F.min("c"), F.count(F.lit(1))).first()
    if not n:
        return rows.sparkSession.createDataFrame([], f"`{conv}` long, {NODE}")
    smallest = F.lit(least).cast("long")
    pre = prefixes(rows)
    shared = pre.groupBy("prefix").agg(F.min("c").alias("owner"), F.max("d").alias("d"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 1")
    shared = materialise(shared, "trie-shared")
    # of one stretch of one conversation each
    listed = pre.groupBy("c", "stretch").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "prefix"))), lambda x: x.prefix).alias("prefixes"))
    listed = materialise(listed, "trie-listed")
    found = first_owned(members, listed, shared)
    # the owner of the prefix before the first owned one: what the chain is tied to, or where a copy ends
    tied = found.where((F.col("c") != smallest) & (F.col("first") > 1)).withColumn("at", F.col("first") - 1)
    tied = owners(tied, listed, shared).select("c", F.col("owner").alias("up"))
    chains = found.join(tied, "c", "left").withColumn("up", F.when(F.col("c") != smallest, F.coalesce("up", smallest)))
    chains = chains.withColumn("first", F.when(F.col("c") == smallest, 0).otherwise(F.col("first")))
    chains = materialise(chains.select("c", "size", "first", "up"), "trie-chains")
    owning = F.col("first") <= F.col("size")

    top = chains.where(F.col("c") == smallest).select("c", F.lit(0).cast("long").alias("stretch"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("words"))
    nodes = pre.join(chains.where(owning).select("c", "first"), "c").where("d >= first").select("c", "stretch", "d", "words").unionByName(top)
    counts = shared.select(F.col("owner").alias("c"), "d", "n_convs").unionByName(top.select("c", "d", F.lit(n).cast("long").alias("n_convs")))
    nodes = nodes.join(counts, ["c", "d"], "left").withColumn("n_convs", F.coalesce("n_convs", F.lit(1).cast("long")))
    nodes = materialise(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "trie-nodes")

    ends = chains.select(F.when(owning, F.col("c")).otherwise(F.col("up")).alias("c"), F.col("size").alias("d"), F.col("c").alias("e"))
    tied = chains.where(owning & F.col("up").isNotNull()).select(F.col("up").alias("on"), (F.col("first") - 1).alias("d"), "c")
    lasts = chains.where(owning).select("c", F.col("size").alias("d")).join(tied.select(F.col("on").alias("c"), "d").distinct(), ["c", "d"], "left_anti").select("c", F.lit(1).cast("long").alias("leaves"))
    own = nodes.groupBy("c").agg(F.sum("saved").alias("saved")).join(lasts, "c", "left").withColumn("leaves", F.coalesce("leaves", F.lit(0).cast("long")))
    sums = totals(own.join(chains.select("c", "up"), "c").select("c", "up", "leaves", "saved"), least)
    hung = tied.join(sums, "c").groupBy(F.col("on").alias("c"), "d").agg(F.count(F.lit(1)).alias("hung"), F.sum("leaves").alias("__leaves"), F.sum("saved").alias("__saved"))

    none = F.lit(0).cast("long")
    out = nodes.join(hung, ["c", "d"], "left").join(ends_of(ends), ["c", "d"], "left")
    out = out.join(chains.select("c", "size", "first", "up"), "c")
    out = out.withColumn("hung", F.coalesce("hung", none)).withColumn("goes_on", F.col("d") < F.col("size")).withColumn("above", F.when(F.col("d") > F.col("first"), F.col("c")).otherwise(F.col("up")))
    out = out.withColumn("n_children", F.col("hung") + F.col("goes_on").cast("long"))
    leaf = (F.col("n_children") == 0).cast("long")
    out = out.select("c", "stretch", "d", "above", "n_convs", "n_children", (F.coalesce("__leaves", none) + leaf).alias("n_leaves"), (F.coalesce("__saved", none) + F.col("saved")).alias("saved_tokens"), "ends_sha256")
    out = summed_up(materialise(out, "trie-sums"), ["n_leaves", "saved_tokens"])
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("c").alias(conv), F.col("d").alias("depth"), F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def conversation_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of rebuilt conversations (see `rebuilt`).

    Turns go in order, null ones first, those with one number by the digest of role and text; null roles and texts are empty.
    Rows without a conversation are left out; repeated rows are turns of their own.  Other columns aren't read.
    """
    return prefix_trie(rebuilt(materialise(turns_of(df, conv, turn, role, text), "trie-turns")), conv)
