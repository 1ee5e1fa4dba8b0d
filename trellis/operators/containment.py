"""Containment of result sets: each expected row within a found row of its own.

A row is the multiset of its cells' texts. A found row answers an expected one if it has all its
cells, more columns or not; two results match if both have as many rows and each expected row can be
given a found row of its own. Any number of pairs of results, told apart by key columns, are compared
at once.

1. Equal rows are one class with a count. Of found rows only the cells count that some expected row
   of the same key has: extra columns vanish, and rows that differ there only become one class.
2. Set-containment join: found classes are indexed by their cells; an expected class is looked up by
   the cell of its own that fewest found classes have, and each candidate is checked cell by cell.
3. Where a class has one partner that has no other, counts say it all. The others are a bipartite
   graph with counts as capacities: its connected components are matched one by one (maximum flow),
   dealt to tasks by a hash, so neither side is collected. A task holds one component at a time.

Defined cases: null cells are the text ``null``; rows without cells are contained in any row; no rows
on both sides match; a key on one side only has no match. Key columns may be null.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.operators.components import components
from trellis.operators.evaluation import cell_token
from trellis.session import removed, written

#: Components of a bucket, about.
BUCKET = 2000


def _numbered(cells: Column) -> Column:
    """A multiset as a set: the k-th of equal texts gets the number k. The empty text stands in every row."""
    ordered = F.sort_array(cells)
    told = F.transform(ordered, lambda x, i: F.concat(x, F.lit("\x02"), (i - F.array_position(ordered, x) + 1).cast("string")))
    return F.array_append(told, F.lit(""))


def rows_of(df: DataFrame, keys: list[str], as_set: bool = False) -> DataFrame:
    """keys and ``cells``: the numbered texts of the other columns. With ``as_set`` lists in cells are sets."""
    cells = F.array(*[cell_token(F.col(f"`{f.name}`"), f.dataType, as_set) for f in df.schema if f.name not in keys]).cast("array<string>")
    return df.select(*keys, _numbered(cells).alias("cells"))


def _maximum(left: dict, right: dict, edges: list[tuple]) -> dict:
    """How much of each left node can be placed: maximum flow by shortest augmenting paths, layer by layer."""
    to = {u: [] for u in left}
    back = {v: [] for v in right}
    flow = {}
    for u, v in edges:
        to[u].append(v)
        back[v].append(u)
        flow[u, v] = 0
    free, room = dict(left), dict(right)
    while True:
        level, queue = {("l", u): 0 for u, n in free.items() if n}, deque(u for u, n in free.items() if n)
        open_end = False
        while queue:  # left nodes by distance; back along what flows
            u = queue.popleft()
            for v in to[u]:
                if ("r", v) not in level:
                    level["r", v] = level["l", u] + 1
                    if room[v]:
                        open_end = True
                    for w in back[v]:
                        if flow[w, v] and ("l", w) not in level:
                            level["l", w] = level["r", v] + 1
                            queue.append(w)
        if not open_end:
            return {u: left[u] - free[u] for u in left}
        at_l, at_r = dict.fromkeys(to, 0), dict.fromkeys(back, 0)
        for start in [u for u, n in free.items() if n]:
            while free[start]:
                path, side = [start], "l"
                while path:
                    x = path[-1]
                    if side == "l":
                        while at_l[x] < len(to[x]) and level.get(("r", to[x][at_l[x]])) != level["l", x] + 1:
                            at_l[x] += 1
                        if at_l[x] < len(to[x]):
                            path.append(to[x][at_l[x]])
                            side = "r"
                            continue
                    else:
                        if room[x]:
                            break
                        while at_r[x] < len(back[x]) and not (flow[back[x][at_r[x]], x] and level.get(("l", back[x][at_r[x]])) == level["r", x] + 1):
                            at_r[x] += 1
                        if at_r[x] < len(back[x]):
                            path.append(back[x][at_r[x]])
                            side = "l"
                            continue
                    path.pop()  # a dead end: the node before goes on with its next
                    side = "r" if side == "l" else "l"
                    if path:
                        (at_l if side == "l" else at_r)[path[-1]] += 1
                if not path:
                    break
                pairs = list(zip(path[::2], path[1::2], strict=True))  # taken; between them what is given back
                returned = list(zip(path[2::2], path[1::2], strict=False))
                more = min(free[start], room[path[-1]], *(flow[p] for p in returned)) if returned else min(free[start], room[path[-1]])
                for p in pairs:
                    flow[p] += more
                for p in returned:
                    flow[p] -= more
                free[start] -= more
                room[path[-1]] -= more


def _flows(groups: pd.DataFrame) -> pd.DataFrame:
    out: list[tuple] = []
    for _, rows in groups.groupby("component", sort=False):
        left, right = dict(zip(rows["g"], rows["n"], strict=True)), dict(zip(rows["f"], rows["m"], strict=True))
        out += _maximum(left, right, list(zip(rows["g"], rows["f"], strict=True))).items()
    return pd.DataFrame(out, columns=["g", "placed"]).astype("int64")


def matches(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_gold, n_found, n_matched (expected rows that get a found row of their own) and contained.
    Both sides: keys and ``cells`` of rows_of()."""
    names = {k: f"key{i}" for i, k in enumerate(keys)}
    own = list(names.values())
    key = F.struct(*[F.col(k) for k in own]) if own else F.struct(F.lit(0).alias("one"))
    gold, found = (df.select(*[F.col(k).alias(x) for k, x in names.items()], "cells").select(key.alias("key"), "cells") for df in (gold, found))
    # only rows without cells are looked up by the empty text: the others need their own cells
    gold = gold.select("key", F.when(F.size("cells") > 1, F.array_remove("cells", "")).otherwise(F.col("cells")).alias("cells"))
    golds = written(gold.groupBy("key", "cells").agg(F.count("*").alias("n")).withColumn("g", F.monotonically_increasing_id()), "expected")
    vocabulary = golds.select("key", F.explode("cells").alias("cell")).distinct()
    rows = written(found.groupBy("key", "cells").agg(F.count("*").alias("m")).withColumn("row", F.monotonically_increasing_id()), "found")
    cells = F.col("cells") if golds.where(F.array_contains("cells", "")).limit(1).count() else F.array_remove("cells", "")
    known = rows.select("key", "row", "m", F.explode(cells).alias("cell")).join(vocabulary, ["key", "cell"], "left_semi")
    classes = known.groupBy("key", "row").agg(F.first("m").alias("m"), F.sort_array(F.collect_list("cell")).alias("cells")).groupBy("key", "cells").agg(F.sum("m").alias("m"))
    classes = written(classes.withColumn("f", F.monotonically_increasing_id()), "classes")
    index = classes.select("key", "f", "m", "cells", F.explode("cells").alias("cell"))
    common = index.groupBy("key", "cell").agg(F.count("*").alias("there"))
    wanted = golds.select("key", "g", "n", "cells", F.explode("cells").alias("cell")).join(common, ["key", "cell"], "left")
    rarest = wanted.groupBy("key", "g").agg(F.min(F.struct(F.coalesce("there", F.lit(0)).alias("there"), "cell")).alias("r"))
    looked = golds.join(rarest.where("r.there > 0").select("g", F.col("r.cell").alias("cell")), "g").select("key", "cell", "g", "n", F.col("cells").alias("need"))
    pairs = looked.join(index, ["key", "cell"]).where(F.size(F.array_except("need", "cells")) == 0).select("g", "n", "f", "m")
    pairs = written(pairs, "pairs")
    alone = pairs.join(pairs.groupBy("g").agg(F.count("*").alias("of_g")), "g").join(pairs.groupBy("f").agg(F.count("*").alias("of_f")), "f").withColumn("single", (F.col("of_g") == 1) & (F.col("of_f") == 1))
    alone = written(alone, "degrees")
    placed = alone.where("single").select("g", F.least("n", "m").alias("placed"))
    rest = alone.where("not single").select("g", "n", "f", "m")
    n = rest.count()
    used = [pairs]
    if n:
        # odd numbers for found classes, even ones for expected ones
        label = components(rest.select((F.col("g") * 2).alias("a"), (F.col("f") * 2 + 1).alias("b")))
        graph = rest.join(label.select((F.col("node") / 2).cast("long").alias("g"), "component").where(F.col("node") % 2 == 0), "g")
        parts = max(1, n // BUCKET)
        flows = written(graph.groupBy(F.pmod(F.xxhash64("component"), F.lit(parts)).alias("bucket")).applyInPandas(_flows, "g long, placed long"), "flows")
        placed = placed.unionByName(flows)
    per = golds.join(placed, "g", "left").groupBy("key").agg(F.sum("n").alias("n_gold"), F.sum(F.coalesce("placed", F.lit(0))).alias("n_matched"))
    there = rows.groupBy("key").agg(F.sum("m").alias("n_found"))
    removed(*used)
    zero = lambda c: F.coalesce(c, F.lit(0))
    whole = per.join(there, "key", "full").select("key", zero("n_gold").alias("n_gold"), zero("n_found").alias("n_found"), zero("n_matched").alias("n_matched"))
    return whole.select(*[F.col(f"key.{x}").alias(k) for k, x in names.items()], "n_gold", "n_found", "n_matched", ((F.col("n_gold") == F.col("n_found")) & (F.col("n_matched") == F.col("n_gold"))).alias("contained"))


def contained(gold: DataFrame, found: DataFrame, as_set: bool = False) -> bool:
    """Whether one result is contained in another; one row comes to the driver."""
    row = matches(rows_of(gold, [], as_set), rows_of(found, [], as_set), []).first()
    return row is None or row["contained"]
