"""A trie of conversation prefixes, named by prefix doubling.

1. Turns are numbered within their conversation. Each conversation is rebuilt from the first
   turns of the conversation that it branches from and its own later turns.
2. Level 0 gives each distinct turn a dense name (0, 1, 2, ...). Level j gives one to each
   distinct pair of names of level j - 1 that stand side by side at an even place: a block of
   2**j turns. Equal names mean equal blocks, after a number of join rounds that is the logarithm
   of the longest conversation.
3. A prefix of d turns is the blocks of d's binary digits, the largest first. It is named by the
   pair (name of the prefix without its last block, name of that block), from the largest last
   block down, so again a logarithmic number of rounds. A node is a depth with a name.
4. Nodes are groups of (depth, name). Each is represented by its smallest member. A conversation
   represents one unbroken run of nodes down to its end, so what a node sums up over its subtree
   is what its members sum up over the nodes that they represent, less what its own
   representative has above it: two aggregations, and no walk along the tree.

Every step is a join or an aggregation with keys that no more than a few rows share, or one that
Spark can split or pre-aggregate; a conversation of any length and a first turn that a third of
all conversations share are no task's own. Numbers and sums along a conversation are made in
stretches of STRETCH turns. The list of conversations that end at a node is hashed as a
stream: chunks of sorted ids are made apart, and only the chunks (a hash reads its input in
order) meet in one task. What comes to the driver is one count for each task of a naming.

Defined cases: rows without a conv_id belong to no conversation and are left out. Null roles and
texts are empty. Turns of equal number (or null, which comes first) are ordered by role, then
text; repeated rows are turns of their own. Turns are compared by SHA-256 of role and text. A
conversation of which nothing is left is a member of the root. Remainders of negative ids are
those of SQL: negative, so ids from -19 to 19 branch from 0. An empty table has no nodes, not
even a root. Texts may be of any length. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.llm.shared import by_batches, discard, materialise

#: Turns of one conversation that are numbered or summed up together.
STRETCH = 256
#: Conversations whose branches start alike, and the longest shared start.
FAMILY, MOST_SHARED = 20, 3
#: Ids of one chunk of a list.
CHUNK = 8192
_FIRST = -(2**63)


def _number(rows: DataFrame, keys: list[str], place: Column, order: list[Column], name: str) -> DataFrame:
    """rows with ``name``: their number (from 1) among equal ``keys``; ``place`` is an integer that
    ``order`` refines. Stretches of places are numbered apart and moved by what stands before them."""
    rows = rows.withColumn("stretch", F.coalesce(F.floor(place / STRETCH), F.lit(_FIRST)))
    sizes = rows.groupBy(*keys, "stretch").agg(F.count("*").alias("size"))
    before = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select(*keys, "stretch", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    within = rows.withColumn("own", F.row_number().over(Window.partitionBy(*keys, "stretch").orderBy(*order)))
    return within.join(moved, [*keys, "stretch"]).withColumn(name, F.col("own") + F.col("before")).drop("own", "before", "stretch")


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, d (number of the turn, from 1), key (what the turn is) and words (of its text)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    rows = _number(rows, ["conv"], F.col("turn"), [F.asc_nulls_first("turn"), F.col("role"), F.col("text")], "d")
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return rows.select("conv", "d", key.alias("key"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, d, key, words) of all conversations as rebuilt; and conv, size of each of
    them. The first h turns are those of the conversation conv - conv % FAMILY, the others its own."""
    counts = own.groupBy("conv").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_SHARED + 1)
    base = counts.select(F.col("conv").alias("base"), F.col("n").alias("there"))
    plans = counts.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % FAMILY}).join(base, "base", "left")
    plans = materialise(plans.select("conv", "base", "h", "n", F.least("h", F.coalesce("there", F.lit(0))).alias("shared")), "plans")
    start = own.where(F.col("d") <= MOST_SHARED).withColumnRenamed("conv", "base").join(plans.select("conv", "base", "h"), "base").where(F.col("d") <= F.col("h")).select("conv", "d", "key", "words")
    rest = own.join(plans.select("conv", "h", "shared"), "conv").where(F.col("d") > F.col("h")).select("conv", (F.col("d") - F.col("h") + F.col("shared")).alias("d"), "key", "words")
    return start.unionByName(rest), plans.select("conv", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))


def dense_names(keys: DataFrame) -> DataFrame:
    """The distinct rows of keys with ``name``: 0, 1, 2, ... without gaps."""
    spark = keys.sparkSession
    found = materialise(keys.distinct().withColumn("at", F.monotonically_increasing_id()), "names")
    part = F.shiftright("at", 33)
    counts = sorted(found.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each task that wrote names
    before, offsets = 0, []
    for task, n in counts:
        offsets.append((task, before))
        before += n
    offsets = spark.createDataFrame(offsets, "part long, before long")
    out = found.withColumn("part", part).join(F.broadcast(offsets), "part").select(*keys.columns, (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("name"))
    out.scratch_path = found.scratch_path
    return out


def _named(rows: DataFrame, keys: list[str], table: str) -> DataFrame:
    """conv, i and the dense name of ``keys``, as a table."""
    names = dense_names(rows.select(*keys))
    named = materialise(rows.join(names, keys).select("conv", "i", "name"), table)
    discard(names)
    return named


def blocks_of(turns_of: DataFrame, longest: int) -> list[DataFrame]:
    """Level by level: conv, i, name of the whole blocks of 2**j turns, the i-th of its conversation."""
    levels = [_named(turns_of.select("conv", (F.col("d") - 1).alias("i"), "key"), ["key"], "block0")]
    for j in range(1, longest.bit_length()):
        left, right = (F.max(F.when(F.col("i") % 2 == side, F.col("name"))) for side in (0, 1))
        pairs = levels[-1].groupBy("conv", F.floor(F.col("i") / 2).alias("i")).agg(left.alias("l"), right.alias("r")).where("l IS NOT NULL AND r IS NOT NULL")
        levels.append(_named(pairs, ["l", "r"], f"block{j}"))
    return levels


def prefixes(levels: list[DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """conv, d, name: the name of each prefix; with d it tells which prefix it is. And the tables that this reads."""
    done, used = None, []
    for j in range(len(levels) - 1, -1, -1):
        last = levels[j].where(F.col("i") % 2 == 0)  # the last block of a prefix of (i + 1) * 2**j turns
        depth = ((F.col("i") + 1) * F.lit(1 << j)).alias("d")
        found = last.where("i = 0").select("conv", depth, "name")
        if done is not None:
            ends = done.select("conv", (F.col("d") / F.lit(1 << j)).cast("long").alias("i"), F.col("name").alias("p"))
            longer = last.where("i > 0").join(ends, ["conv", "i"]).select("conv", "i", "p", F.col("name").alias("b"))
            named = _named(longer, ["i", "p", "b"], f"prefix{j}")
            used.append(named)
            found = found.unionByName(named.select("conv", depth, "name"))
        done = found if done is None else done.unionByName(found)
    return done, used


def list_digests(ends: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ends_sha256: the digest of each group's ``conv`` in ascending order, joined by commas."""
    kinds = {f.name: f.dataType for f in ends.select(*keys).schema}
    types = ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items())

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def sent():
            columns = [pa.array([x]) for x in (*key, ids[0], ",".join(map(str, ids)))]
            return pa.RecordBatch.from_arrays(columns, [*keys, "first", "ids"])

        for batch in batches:
            for *own, conv in zip(*(batch.column(c).to_pylist() for c in (*keys, "conv")), strict=True):
                if ids and (own != key or len(ids) == CHUNK):
                    yield sent()
                    ids = []
                key = own
                ids.append(conv)
        if ids:
            yield sent()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done: list[tuple] = []

        def sent():
            columns = [pa.array(x) for x in zip(*done, strict=True)]
            return pa.RecordBatch.from_arrays(columns, [*keys, "ends_sha256"])

        for batch in batches:
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*keys, "ids")), strict=True):
                if own == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield sent()
                done = []
        if key is not None:
            done.append((*key, state.hexdigest()))
            yield sent()

    parts = ends.select(*keys, "conv").repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv").transform(by_batches, chunks, f"{types}, first long, ids string")
    return parts.repartition(*keys).sortWithinPartitions(*keys, "first").transform(by_batches, digests, f"{types}, ends_sha256 string")


def trie(conversations: DataFrame, **names: str) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    own = materialise(turns(conversations, **names), "turns")
    rows, sizes = rebuilt(own)
    rows, sizes = materialise(rows, "rebuilt"), materialise(sizes, "sizes")
    discard(own)
    longest = sizes.agg(F.max("size")).first()[0] or 0
    levels = blocks_of(rows, longest) if longest else []
    paths = sizes.select("conv", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("name"))
    used = []
    if levels:
        longer, used = prefixes(levels)
        paths = paths.unionByName(longer)
    paths = materialise(paths, "paths")
    discard(*levels, *used)
    node = ["d", "name"]
    groups = materialise(paths.groupBy(*node).agg(F.min("conv").alias("rep"), F.count("*").alias("n_convs")), "groups")
    # what a node's representative says: the words of its last turn, and the prefix before that turn
    last = rows.select(F.col("conv").alias("rep"), "d", "words")
    above = paths.select(F.col("conv").alias("rep"), (F.col("d") + 1).alias("d"), F.col("name").alias("above"))
    saved = ((F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))).alias("own")
    nodes = groups.join(last, ["rep", "d"], "left").join(above, ["rep", "d"], "left").select(*node, "rep", "n_convs", "above", saved)
    parent = [(F.col("d") - 1).alias("d"), F.col("above").alias("name")]
    children = nodes.where("d > 0").select(*parent).groupBy(*node).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialise(nodes.withColumn("stretch", F.floor(F.col("d") / STRETCH)), "nodes")
    # what representatives save from a node on: the rest of its stretch, and the stretches below
    rest = Window.partitionBy("rep", "stretch").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    below = Window.partitionBy("rep").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    stretches = nodes.groupBy("rep", "stretch").agg(F.sum("own").alias("whole"))
    stretches = stretches.select("rep", "stretch", F.coalesce(F.sum("whole").over(below), F.lit(0)).alias("below"))
    down = nodes.withColumn("down", F.sum("own").over(rest)).join(stretches, ["rep", "stretch"]).withColumn("down", F.col("down") + F.col("below"))
    owners = materialise(nodes.groupBy("rep").agg(F.sum("own").alias("saves"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves")), "owners")
    members = paths.join(owners.withColumnRenamed("rep", "conv"), "conv").groupBy(*node).agg(F.sum("saves").alias("saves"), F.sum("leaves").alias("n_leaves"))
    ends = list_digests(paths.join(sizes.withColumnRenamed("size", "d"), ["conv", "d"]), node)
    whole = down.join(owners.select("rep", F.col("saves").alias("own_saves")), "rep").join(members, node).join(ends, node, "left")
    parents = groups.select((F.col("d") + 1).alias("d"), F.col("name").alias("above"), F.col("rep").alias("parent_conv_id"))
    return whole.join(parents, ["d", "above"], "left").select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("saves") - F.col("own_saves") + F.col("down")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
