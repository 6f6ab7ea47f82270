"""Connected components of an edge table: every node sends its neighbours to the least of them.

Edges are dealt to as many tasks as they fill with HELD each, and each task puts a star forest of
the same components in the place of its edges; what fits one task is done with that. Else rounds
follow: a round takes the least m(u) of each node u and its neighbours, puts edges from u and all its
neighbours to m(u) in the place of u's, and contracts again. It is over when all nodes but roots
have one edge: the table is a star forest then.

The aggregation combines before the shuffle. In the join a hub's edges would meet in one task, so
hubs are split off: nodes with over 1/1024 of the edge ends, of which there can be 1024 at most, are
broadcast to their edges, which stay where they are. Nothing else reaches the driver but a few
numbers a round. Each round's tables are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

HUBS, LEAST_DEGREE, HELD = 1024, 512, 1 << 18


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, for edges (a, b) of nodes 0 to n - 1."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        least = np.minimum(x, y)
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        while (root[root] != root).any():
            root = root[root]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hi, lo): star forests of the same components as the edges (hi, lo), of about HELD edges each."""
    held, size = [], 0

    def contracted() -> Iterator[pa.RecordBatch]:
        n = sum(len(x) for x in held)
        ends = pa.concat_arrays([x.column(i) for i in (0, 1) for x in held]).dictionary_encode()
        order = pc.array_sort_indices(ends.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        code = rank[ends.indices.to_numpy(zero_copy_only=False)]
        root = _roots(code[:n], code[n:], len(order))
        leaf = np.flatnonzero(root != np.arange(len(order)))
        if len(leaf):
            yield pa.RecordBatch.from_arrays([ends.dictionary.take(pa.array(order[x])) for x in (leaf, root[leaf])], ["hi", "lo"])

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= HELD:
            yield from contracted()
            held, size = [], 0
    if size:
        yield from contracted()


def _to_least(edges: DataFrame, least: DataFrame, hub: Column | None) -> DataFrame:
    """(v, m) for edges (u, v) with the m of least(u, m, degree); hubs by broadcast, the others by a shuffle."""
    if hub is None:
        return edges.join(least.select("u", "m"), "u").select("v", "m")
    # Degrees add up to the edge ends, so there are HUBS rows at most.
    marked = edges.join(F.broadcast(least.where(hub).select("u", F.col("m").alias("hub_m"))), "u", "left")
    cold = marked.where("hub_m is null").select("u", "v").join(least.where(~hub).select("u", "m"), "u")
    return cold.select("v", "m").union(marked.where("hub_m is not null").select("v", "hub_m"))


def connected_components(space: Workspace, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of an edge (a, b) but a loop; root is the component's least node.

    Repeated edges change nothing; an empty table gives an empty table.
    """
    kind = edges.schema["a"].dataType.simpleString()

    def contracted(edges: DataFrame, count: int) -> DataFrame:
        tasks = count // HELD + 1
        forests = edges.repartition(tasks).mapInArrow(_forests, f"hi {kind}, lo {kind}")
        return space.save(forests if tasks == 1 else forests.distinct(), "edges")

    raw = space.save(edges.where("a <> b").select("a", "b"), "raw")
    now = contracted(raw, raw.count())
    space.drop(raw)
    for _ in range(rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("degree"))
        least = space.save(least, "least")
        ends, most, open_ = least.agg(F.sum("degree"), F.max("degree"), F.count(F.when((F.col("m") < F.col("u")) & (F.col("degree") > 1), 1))).first()
        if not open_:
            space.drop(now)
            return least.select(F.col("u").alias("node"), F.col("m").alias("root"))
        many = max(LEAST_DEGREE, ends // HUBS)
        moved = _to_least(both, least, F.col("degree") > many if most > many else None).union(least.select("u", "m"))
        new = contracted(moved.where("v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")), 2 * ends)
        space.drop(now, least)
        now = new
    raise RuntimeError(f"the components did not settle in {rounds} rounds")
