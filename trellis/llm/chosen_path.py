"""N-gram Jaccard join by chosen paths.

A document is the set of its word 5-grams (64-bit hashes of the words as they
stand, split at ASCII white space; a text of one to four words is one gram).
Documents with equal sets form one class, whose least key stands for it.

Search. A run is a tree: a set goes on from a node to one child for each of its
grams whose hash under the run's and the level's function falls below
1 / (threshold * size), 1 / threshold children on average. Two sets with
Jaccard similarity at the threshold or above then share a leaf with constant
probability. Nodes with at most LEAF sets are compared pair by pair, by 128
one-permutation minima; larger nodes are split again, LEVELS times at most.
Nodes that are still larger are compared in square blocks. The number of runs
is what the target recall asks for.

Check. A leaf only links documents to others of the leaf (fewer links than
sets), and components of these links are the candidate clusters. Within each
cluster all pairs of sets are compared exactly, again in square blocks, so that
no task holds a whole cluster and no table has a row for each pair: a block
gives the number of partners of each of its documents and a spanning forest of
the pairs found. Components of the forests are the classes.

Defined cases: null and empty texts and texts of white space have no grams:
they have no partners and are alone. Rows that repeat a doc_id are told apart
by a hash of the text; rows equal in both count as one document (each gets its
result). Ids are integers; a null doc_id is the smallest. Of documents with equal
sets the least id (then hash) stands for all. A text of any length is used whole. An empty
table gives no rows. Other columns are not needed and do not disturb, whatever
their names; ``keep_one`` hands them on as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm import kernel as K
from trellis.llm.components import components
from trellis.llm.shared import blocks, by_batches, by_groups, discard, materialise, sent_if_few, text_bytes, whole

GRAM = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999
#: Nodes up to this size are compared at once; larger ones are split again.
LEAF = 64
LEVELS = 3
#: Rows of leaves that a task takes at once.
LEAF_ROWS = 20_000
#: Documents on a side of a square block: of a cluster, where sets are compared (fewer where
#: the sets are large, so that a side has some SIDE_GRAMS grams at most), and of a leaf.
SIDE = 512
SIDE_GRAMS = 400_000
LEAF_SIDE = 2048
CUTS = 4
BINS = 128
_LOWEST = -(2**63)


def candidate_share(threshold: float) -> float:
    """Share of equal minima from which a pair of a leaf is a candidate: six standard deviations below the threshold."""
    return threshold - 6 * math.sqrt(threshold * (1 - threshold) / BINS)


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold has met with the target probability.

    A shared gram is chosen by both with probability 1 / (threshold * larger
    size). A pair at the threshold shares at least threshold * larger size grams
    (as many where one set contains the other), so a level has one shared child
    on average, or more, and at least one with probability 1 - exp(-1), or more.
    All nodes of a run and level choose alike: a pair meets in a run if each of
    its LEVELS levels has a shared choice."""
    reach = (1 - math.exp(-1)) ** LEVELS
    return math.ceil(math.log(1 - recall) / math.log(1 - reach))


def _keyed(docs: DataFrame, doc: str, text: str) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(_LOWEST)).alias("doc"), F.col(text).alias("text"))
    counts = rows.select("doc").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("d")).first()
    return rows.withColumn("h", F.xxhash64("text") if counts["n"] != counts["d"] else F.lit(0).cast("long"))


def _sets(column: pa.Array, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram hashes of all texts, ascending within each, and the offsets of the texts."""
    data, offsets = text_bytes(column)
    starts, ends, first = K.word_spans(data, offsets, K.SPACES)
    words = K.span_hashes(data, starts, ends)
    counts = np.diff(first)
    start, text = K.gram_starts(first, gram)
    grams = K.gram_hashes(words, gram)[start] if len(start) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < gram))
    if len(short):
        whole = np.array([K.gram_hashes(words[first[i] : first[i + 1]], int(counts[i]))[0] for i in short], np.uint64)
        grams, text = np.concatenate([grams, whole]), np.concatenate([text, short])
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, text = grams[new], text[new]
    return grams, np.searchsorted(text, np.arange(len(counts) + 1))


_FEATURES = "id long, doc long, h long, size int, set_a long, set_b long, minima binary, paths array<array<long>>"


def _features(gram: int, threshold: float, runs: int):
    """Size, a 128-bit hash of the set, minima, and the chosen grams of each run and level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in blocks(batches, "text", 1 << 20):
            grams, at = _sets(batch.column("text"), gram)
            n, size = batch.num_rows, np.diff(at)
            owner = np.repeat(np.arange(n), size)
            # the set's hash: sums of mixed hashes do not depend on order
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(grams + np.uint64(k)))]) for k in (1, 2)]
            ids = [K.signed(K.mix(s[at[1:]] - s[at[:-1]] + size.astype(np.uint64))) for s in sums]
            # one permutation, BINS bins: the least of each bin, 7 bits of it kept; -1 is an empty bin
            mixed = K.mix(grams ^ np.uint64(0x5851F42D4C957F2D))
            bins = owner * BINS + (mixed >> np.uint64(57)).astype(np.int64)
            order = np.lexsort((mixed, bins))
            head = np.ones(len(order), bool)
            head[1:] = bins[order][1:] != bins[order][:-1]
            minima = np.full(n * BINS, -1, np.int8)
            minima[bins[order][head]] = (mixed[order][head] & np.uint64(0x7F)).astype(np.int8)
            minima = minima.reshape(n, BINS)
            # the chosen grams, run by run and level by level
            limit = np.minimum(2.0**64 / (threshold * np.maximum(size, 1)), 2.0**64 - 2048).astype(np.uint64)[owner]
            chosen, chosen_at, which = [], [], []
            for k in range(runs * LEVELS):
                picked = np.flatnonzero(K.mix(grams + np.uint64(0x9E3779B97F4A7C15 * (k + 11) % 2**64)) < limit)
                chosen.append(grams[picked])
                chosen_at.append(owner[picked])
                which.append(np.full(len(picked), k))
            chosen, chosen_at, which = map(np.concatenate, (chosen, chosen_at, which))
            order = np.lexsort((which, chosen_at))
            slot = chosen_at[order] * runs * LEVELS + which[order]
            inner = np.searchsorted(slot, np.arange(n * runs * LEVELS + 1)).astype(np.int32)
            paths = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * runs * LEVELS).astype(np.int32)), pa.ListArray.from_arrays(pa.array(inner), pa.array(K.signed(chosen[order]))))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column("doc"), batch.column("h"), pa.array(size.astype(np.int32)), *map(pa.array, ids), pa.array([m.tobytes() for m in minima], pa.binary()), paths], ["id", "doc", "h", "size", "set_a", "set_b", "minima", "paths"])
            row += n

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each node's component, for local edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _equal_share(minima: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima among the bins that either of two documents fills."""
    out = np.empty(len(a))
    for i in range(0, len(a), 8192):
        x, y = minima[a[i : i + 8192]], minima[b[i : i + 8192]]
        out[i : i + 8192] = ((x == y) & (x >= 0)).sum(1) / ((x >= 0) | (y >= 0)).sum(1)
    return out


def _pairs_of(heads: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions within each range."""
    size = ends - heads
    row = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(heads, size)
    after = np.repeat(ends, size) - row - 1
    a = np.repeat(row, after)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)


def _link_leaves(table: pa.Table, least: float) -> pa.Table:
    """Candidate links of many leaves (or squares of large ones): each document to the
    root of its component in the leaf.

    In a small leaf all pairs are compared. In a larger one documents are first
    compared with a leader; those like it need no comparison with each other, as
    they are linked already; everything else is compared."""
    order = np.lexsort([table.column(c).to_numpy() for c in ("id", "y", "x", "node")])
    ids = table.column("id").to_numpy()[order]
    minima = np.frombuffer(b"".join(table.column("minima").to_pylist()), np.int8).reshape(len(ids), BINS)[order]
    new = np.zeros(len(ids), bool)
    new[0] = True
    for c in ("node", "x", "y"):
        values = table.column(c).to_numpy()[order]
        new[1:] |= values[1:] != values[:-1]
    heads = np.flatnonzero(new)
    ends = np.append(heads[1:], len(ids))
    small = ends - heads <= 16
    a, b = _pairs_of(heads[small], ends[small])
    found = _equal_share(minima, a, b) >= least
    out_a, out_b = [a[found]], [b[found]]
    for head, end in zip(heads[~small], ends[~small], strict=True):
        rest, linked = np.arange(head, end), np.zeros(0, np.int64)
        while len(rest):
            leader, others = rest[0], rest[1:]
            like = _equal_share(minima, np.full(len(others), leader), others) >= least
            out_a.append(np.full(like.sum(), leader))
            out_b.append(others[like])
            group = np.append(leader, others[like])
            if len(linked):  # this leader's group with those of leaders before
                x, y = np.repeat(group, len(linked)), np.tile(linked, len(group))
                like2 = _equal_share(minima, x, y) >= least
                out_a.append(x[like2])
                out_b.append(y[like2])
            linked = np.append(linked, group)
            rest = others[~like]
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    root = _roots(len(ids), a, b)
    far = np.flatnonzero(root != np.arange(len(ids)))
    return pa.table({"a": ids[far], "b": ids[root[far]]})


def _in_squares(rows: DataFrame, size: str, order: str, side: Column) -> DataFrame:
    """Each row once for each square block of its group that it stands in: columns x <= y
    (the block) for blocks of ``side`` by ``side`` rows, dealt by a hash of ``order``."""
    count = F.ceil(F.col(size) / side).cast("int")
    own = F.pmod(F.xxhash64(order), count.cast("long")).cast("int")
    return rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1))).withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("other")


def candidate_links(features: DataFrame, reps: DataFrame, runs: int, threshold: float = THRESHOLD, leaf: int = LEAF, side: int = LEAF_SIDE) -> DataFrame:
    """a, b: ids of documents that a leaf links. features: id, minima, paths; reps: the ids to be joined."""

    def grams_of(level: int):
        picked = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda run: F.get("paths", run * LEVELS + level))
        return features.select("id", picked.alias("grams"))

    chosen = grams_of(0).join(reps.select("id"), "id", "left_semi").select("id", F.posexplode("grams").alias("run", "grams"))
    nodes = chosen.select("id", "run", F.explode("grams").alias("gram")).select("id", "run", F.xxhash64("run", "gram").alias("node"))
    leaves, used = None, []
    for level in range(1, LEVELS + 1):
        sizes = materialise(nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), f"nodes{level}")
        placed = materialise(nodes.join(sizes, "node"), f"placed{level}")
        used += [sizes, placed]
        done = (placed if level == LEVELS else placed.where(F.col("n") <= leaf)).select("id", "node", "n")
        leaves = done if leaves is None else leaves.unionByName(done)
        if level < LEVELS:  # split what is too large on the next level's grams
            split = placed.where(F.col("n") > leaf).join(grams_of(level), "id").select("id", "run", "node", F.explode(F.get("grams", F.col("run"))).alias("gram"))
            nodes = split.select("id", "run", F.xxhash64("node", "gram").alias("node"))
    leaves = _in_squares(leaves, "n", "id", F.lit(side)).select("id", "node", "x", "y")
    count = leaves.count()
    bucket = F.pmod(F.xxhash64("node", "x", "y"), F.lit(max(1, count // LEAF_ROWS))).alias("bucket")
    leaves = leaves.join(features.select("id", "minima"), "id").select("*", bucket)
    least = candidate_share(threshold)
    links = materialise(by_groups(leaves.groupBy("bucket"), lambda rows: _link_leaves(rows, least), "a long, b long").distinct(), "links")
    discard(*used)
    return links


def _compare_square(threshold: float):
    """Exact comparison of all pairs of a square: partners of each document, and a forest of the pairs."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, own = table.column("id").to_numpy(), table.column("own").to_numpy()
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        copies = table.column("copies").to_numpy().astype(np.int64)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("grams").to_pylist()]
        size = np.array([len(s) for s in sets])
        grams, owner = np.concatenate(sets), np.repeat(np.arange(len(ids)), size)
        _, code, seen = np.unique(grams, return_inverse=True, return_counts=True)
        shared = seen[code] > 1  # a gram of one document is in no intersection
        column = np.cumsum(seen > 1) - 1
        code, owner = column[code[shared]], owner[shared]
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        both = np.zeros((len(ids), len(ids)), np.float64)
        width = 4096
        for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            i, j = np.searchsorted(code, [begin, begin + width])
            part = np.zeros((len(ids), min(width, int(code[j - 1]) - begin + 1 if j > i else 1)), np.float32)
            part[owner[i:j], code[i:j] - begin] = 1
            both += part @ part.T
        union = size[:, None] + size[None, :] - both
        similar = both >= threshold * union - 1e-3  # whole numbers, each part of them exact in 32 bits and their sum in 64
        np.fill_diagonal(similar, False)
        if x != y:  # pairs within x or within y are in other squares
            similar &= own[:, None] != own[None, :]
        links = similar @ copies
        a, b = np.nonzero(np.triu(similar))
        root = _roots(len(ids), a, b) if len(a) else np.arange(len(ids))
        some = np.flatnonzero((links > 0) | (root != np.arange(len(ids))))
        return pa.table({"id": ids[some], "root": ids[root[some]], "links": links[some]})

    return run


def join(docs: DataFrame, doc: str = "doc_id", text: str = "text", gram: int = GRAM, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, leaf: int = LEAF, side: int = SIDE, leaf_side: int = LEAF_SIDE) -> DataFrame:
    """doc, h (tells rows of one doc apart), copy_of and class (both a doc and an h), n_links.

    copy_of is the least document with the same set of grams; class is the least
    document of the component of links; n_links counts the other documents whose
    similarity is at least ``threshold``, copies included."""
    runs = runs_for(recall, threshold)
    keyed = _keyed(docs, doc, text)
    features = materialise(keyed.select("doc", "h", "text").transform(by_batches, _features(gram, threshold, runs), _FEATURES), "features")
    # documents with equal sets are one class; texts without grams are no copies of each other
    members = materialise(features.select("doc", "h", "size", "set_a", "set_b", F.when(F.col("size") == 0, F.col("id")).otherwise(-1).alias("alone"), "id"), "members")
    same_set = ["set_a", "set_b", "alone"]
    least = members.groupBy(*same_set).agg(F.min(F.struct("doc", "h", "id")).alias("rep"), F.count_distinct("doc", "h").alias("copies"), F.max("size").alias("size"))
    least = materialise(least.select(*same_set, F.col("rep.id").alias("id"), F.struct("rep.doc", "rep.h").alias("rep"), "copies", "size"), "classes")
    reps = least.where("alone = -1").select("id", F.col("rep.doc").alias("doc"), F.col("rep.h").alias("h"), "copies", "size")
    links = candidate_links(features, reps, runs, threshold, leaf, leaf_side)
    discard(features)
    clusters = materialise(components(links), "clusters")
    discard(links)
    clustered = reps.join(clusters.withColumnRenamed("node", "id"), "id")
    sizes = clustered.groupBy("component").agg(F.count("*").alias("n"), F.max("size").alias("most"))
    # a cluster of more than one square is cut in CUTS at least, so that some tasks share it; each of its sets travels to as many squares
    shared = F.when(F.col("n") <= side, side).otherwise(F.least(F.lit(side), F.greatest(F.lit(side / 8), F.col("n") / CUTS)))
    own_side = F.greatest(F.lit(1), F.least(shared, F.lit(SIDE_GRAMS) / F.col("most"))).cast("int")
    sizes = materialise(sizes.select("component", "n", own_side.alias("side")), "sizes")
    wanted = sent_if_few(materialise(clustered.join(sizes, "component").select("id", "doc", "h", "copies", "component", "n", "side"), "wanted"))
    sets = keyed.join(wanted, ["doc", "h"]).select("id", "component", "n", "side", "copies", "text").transform(by_batches, _gram_sets(gram), "id long, component long, n long, side int, copies long, grams binary").dropDuplicates(["id"])
    sets = materialise(sets, "sets")
    squares = _in_squares(sets, "n", "id", F.col("side"))
    found = materialise(by_groups(squares.groupBy("component", "x", "y"), _compare_square(threshold), "id long, root long, links long"), "squares")
    discard(sets)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    grouped = joined.join(least.select(F.col("id").alias("node"), "rep"), "node").groupBy("component").agg(F.min("rep").alias("class"))
    of_node = joined.join(grouped, "component").select(F.col("node").alias("id"), "class")
    # all that is known of a class stands in one row before its copies, of which there may be very many, meet it
    known = materialise(least.join(links, "id", "left").join(of_node, "id", "left").select(*same_set, "rep", "copies", "links", "class"), "known")
    every = members.select("doc", "h", *same_set).distinct().join(known, same_set)
    return every.select("doc", "h", F.col("rep").alias("copy_of"), F.coalesce("class", "rep").alias("class"), (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"))


def _gram_sets(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            grams, at = _sets(batch.column("text"), gram)
            packed = [grams[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "component", "n", "side", "copies")), pa.array(packed, pa.binary())], ["id", "component", "n", "side", "copies", "grams"])

    return run


def _doc(column):
    return F.when(column != _LOWEST, column)


def classes(docs: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row for each row of docs (equal rows count once): doc, class_id, copy_of, n_links."""
    found = join(docs, doc, text, **how)
    return found.select(_doc(F.col("doc")).alias(doc), _doc(F.col("class.doc")).alias("class_id"), _doc(F.col("copy_of.doc")).alias("copy_of"), "n_links")


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without those that are not the least of their class; of equal rows one stays. Columns
    of any name keep their values: they travel as one struct."""
    found = join(docs, doc, text, **how)
    stays = materialise(found.where((F.col("class.doc") == F.col("doc")) & (F.col("class.h") == F.col("h"))).select("doc", "h"), "stays")
    several = not stays.where("h <> 0").isEmpty()
    h = F.xxhash64(text) if several else F.lit(0).cast("long")
    rows = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(_LOWEST)).alias("doc"), h.alias("h"), whole(docs).alias("own"))
    if several:
        rows = rows.dropDuplicates(["doc", "h"])
    return rows.join(sent_if_few(stays), ["doc", "h"], "left_semi").select("own.*")
