"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.session import pin

#: Edges that ``contracted`` looks at together.
CHUNK = 1 << 20


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64(*edges.columns).cast("decimal(38,0)"))).first())


def components(edges: DataFrame, by: str | None = None) -> DataFrame:
    """node, component (smallest node it is connected with) for every node of ``edges`` (two long columns u, v).

    Large-star and small-star steps take turns until the edges no longer
    change: each node's neighbours are hung on its smallest neighbour. Every
    step is stored, so lineage stays short. The smallest neighbours are found
    with partial aggregates and joined from a stored table, so the edges of a
    node with very many neighbours can be split among tasks. Loops and edges
    with a null end are ignored. The edges of each value of the column ``by``
    are a graph of their own; the result has that column too.
    """
    part = [by] if by else []
    own = edges.select(*part, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = pin(own.distinct())
    state = _state(now)
    while state[0]:
        # Large star: the larger neighbours of every node join its smallest neighbour.
        both = now.unionByName(now.select(*part, F.col("v").alias("u"), F.col("u").alias("v")))
        least = pin(both.groupBy(*part, "u").agg(F.min("v").alias("m")).select(*part, "u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, [*part, "u"]).select(*part, F.col("v").alias("u"), F.col("m").alias("v"))
        large = pin(large.where("u <> v").distinct())
        # Small star: the smaller neighbours and the node itself join the smallest of them.
        least = pin(large.groupBy(*part, "u").agg(F.min("v").alias("m")))
        small = large.join(least, [*part, "u"]).select(*part, F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select(*part, "u", F.col("m").alias("v")))
        now = pin(small.where("u <> v").distinct())
        before, state = state, _state(now)
        if state == before:
            break
    nodes = now.select(*part, F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(*part, F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, sorted, and the smallest node each is connected with by them."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            return nodes, nodes[label]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def contracted(edges: DataFrame, by: str | None = None) -> DataFrame:
    """Edges u, v with the same components, most of them in stars already: fewer rounds are left for ``components``.

    Each task hangs the nodes of up to ``CHUNK`` edges at a time on the smallest
    node they reach by them, first as the edges lie, then with the edges of a
    node together. Edges with a null end are ignored. ``by`` (an int column):
    see ``components``.
    """
    part = [by] if by else []

    def hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                yield hung(held)
                held, rows = [], 0
        if rows:
            yield hung(held)

    def hung(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        *graph, u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(len(part) + 2))
        graph = graph[0] if part else np.zeros(len(u), dtype=np.int32)
        out = []
        for k in np.unique(graph):
            node, root = _roots(u[graph == k], v[graph == k])
            below = node != root
            out.append((np.full(below.sum(), k, dtype=np.int32), node[below], root[below]))
        columns = [pa.array(np.concatenate(x)) for x in zip(*out)]
        return pa.RecordBatch.from_arrays(columns if part else columns[1:], [*part, "u", "v"])

    shape = "".join(f"{c} int, " for c in part) + "u long, v long"
    own = edges.select(*part, "u", "v").where("u IS NOT NULL AND v IS NOT NULL")
    return own.mapInArrow(hang, shape).repartition(*part, "u").mapInArrow(hang, shape)


def joined(edges: DataFrame, by: str | None = None, most: int | None = None) -> DataFrame:
    """The same as ``components``, after contraction: where that left only stars, they are the components and no round is made.

    Otherwise the stars are nodes of a smaller graph, whose edges are the nodes
    that hang in several of them, and that graph is joined in the same way.
    ``most``: of more such nodes than that the stars go through the rounds.
    """
    part = [by] if by else []
    stars = pin(contracted(edges, by))
    ends = stars.select(*part, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(*part, F.col("v").alias("node"), F.col("v").alias("root")))
    reached = pin(ends.groupBy(*part, "node").agg(F.min("root").alias("component"), F.max("root").alias("other")))
    torn = reached.where("component <> other").withColumnRenamed("node", "u")
    n = torn.count()
    if not n:
        return reached.select(*part, "node", "component")
    if most is not None and n > most:
        return components(stars, by)
    # All roots of a torn node belong together; a root that hangs itself is the largest of its own.
    bridges = stars.join(torn, [*part, "u"]).select(*part, F.col("v").alias("u"), F.col("component").alias("v"))
    bridges = bridges.unionByName(torn.where("u = other").select(*part, "u", F.col("component").alias("v"))).where("u <> v")
    whole = joined(bridges, by, n // 2).select(*part, F.col("component").alias("least"), F.col("node").alias("component"))
    return reached.join(whole, [*part, "component"], "left").select(*part, "node", F.coalesce("least", "component").alias("component"))
