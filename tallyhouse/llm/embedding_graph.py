"""Near-duplicate embeddings by a robust-pruned flat graph.

Centroids fitted on a bounded sample cut each label's vectors into overlapping
shards: every vector is in the shards of its two nearest centroids. In each
shard a graph is built whose lists are pruned so that no neighbour is much
closer to a nearer neighbour than to the node itself, and the lists of both
shards are united. A search from a shard's medoid walks greedily towards each
vector and then widens over everything within range. Pairs found are verified
in double precision, and the recall is audited against brute force.

A shard too large for a task is cut into blocks, each pair of which is a task.
Vectors equal in every component are one class and are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallyhouse.llm.components import components
from tallyhouse.session import pin

COSINE = 0.98
#: Vectors of a shard aimed at; most centroids; vectors they are fitted on.
SHARD, CENTROIDS, SAMPLE = 1000, 4096, 8192
#: Vectors of a block; vectors of small shards that share a task.
BLOCK, TOGETHER = 2048, 4000
#: Candidates and kept neighbours of a node; by how much a detour must be shorter to prune.
CANDIDATES, DEGREE, ALPHA = 48, 24, 1.2
#: Pool of the greedy walk; cosine below the threshold within which the search still widens.
POOL, SLACK = 16, 0.04
#: Queries of the recall audit.
AUDIT = 200


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and x (doubles) of the vectors that can link; equal vectors of a label are one row with their number."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x")).where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    rows = rows.where(~bad & F.exists("x", lambda v: v != 0))
    return rows.groupBy("label", "x").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("size")).select("vec_id", F.xxhash64("label").alias("label"), "x", "size")


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means; a centroid without members stays where it is."""
    sample = _units(sample)
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:count]]
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 1024] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 1024)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centres)
    return centres


def assign(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Add home and other: the two nearest centroids of each vector's width (other = home if there is but one)."""
    schema = StructType([*rows.schema.fields, StructField("home", IntegerType()), StructField("other", IntegerType())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.schema.get_field_index("x"))
            widths = np.array([len(v) for v in x])
            home, other = np.zeros(len(widths), dtype=np.int32), np.zeros(len(widths), dtype=np.int32)
            for width in np.unique(widths):
                where = np.flatnonzero(widths == width)
                if len(near := centres[int(width)]) > 1:
                    likeness = _units(np.array([x[int(i)].as_py() for i in where])) @ near.T
                    two = np.argpartition(-likeness, 1, axis=1)[:, :2]
                    first = np.take_along_axis(likeness, two, axis=1).argmax(axis=1)
                    home[where], other[where] = two[np.arange(len(two)), first], two[np.arange(len(two)), 1 - first]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(other)], schema.names)

    return rows.mapInArrow(nearest, schema)


def robust_pruned(x: np.ndarray, candidates: int = CANDIDATES, degree: int = DEGREE, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of the pruned graph over unit vectors, and the way from the medoid to every node."""
    n = len(x)
    if n < 2:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    x = x.astype(np.float32)
    likeness = x @ x.T
    np.fill_diagonal(likeness, -2)
    c = min(candidates, n - 1)
    near = np.argpartition(-likeness, c - 1, axis=1)[:, :c]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(likeness, near, axis=1), axis=1), axis=1)
    far = np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(likeness, near, axis=1)))
    kept, open_ = np.zeros((n, c), dtype=bool), np.ones((n, c), dtype=bool)
    for k in range(c):
        take = open_[:, k] & (kept.sum(axis=1) < degree)
        kept[:, k] = take
        between = np.sqrt(np.maximum(0, 2 - 2 * likeness[near[:, k][:, None], near]))
        open_ &= ~(take[:, None] & (alpha * between <= far))
    start, slot = np.nonzero(kept)
    # Every node hangs on its nearest one among those closer to the medoid, so a path leads to it.
    middle = medoid(x)
    order = np.argsort(-(x @ x[middle]), kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    rank[middle] = -1
    parent = np.where(rank[None, :] < rank[:, None], likeness, -3).argmax(axis=1)
    child = np.flatnonzero(np.arange(n) != middle)
    return np.concatenate((start, parent[child], child)), np.concatenate((near[start, slot], child, parent[child]))


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def range_search(x: np.ndarray, start: np.ndarray, to: np.ndarray, least: float, pool: int = POOL) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) within ``least``, by a walk from the medoid for every vector as a query, all in step."""
    n, x = len(x), x.astype(np.float32)
    order = np.argsort(start, kind="stable")
    to, bounds = to[order], np.searchsorted(start[order], np.arange(n + 1))
    seen = np.zeros((n, n), dtype=bool)
    opened = np.zeros((n, n), dtype=bool)
    entry = medoid(x)
    seen[:, entry] = True
    best = np.full((n, pool), -3, dtype=np.float32)
    node = np.zeros((n, pool), dtype=np.int64)
    done = np.zeros((n, pool), dtype=bool)
    best[:, 0], node[:, 0] = x @ x[entry], entry
    near_q, near_n = [np.flatnonzero(best[:, 0] >= least)], [np.full(int((best[:, 0] >= least).sum()), entry)]

    def widen(q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The neighbours of ``at`` that query ``q`` has not seen, with their likeness."""
        opened[q, at] = True
        count = bounds[at + 1] - bounds[at]
        who = np.repeat(q, count)
        which = to[np.repeat(bounds[at] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        fresh = ~seen[who, which]
        code = np.unique(who[fresh] * n + which[fresh])
        who, which = code // n, code % n
        seen[who, which] = True
        alike = np.empty(len(who), dtype=np.float32)
        for i in range(0, len(who), 1 << 17):
            alike[i : i + (1 << 17)] = np.einsum("ij,ij->i", x[who[i : i + (1 << 17)]], x[which[i : i + (1 << 17)]])
        within = alike >= least
        near_q.append(who[within])
        near_n.append(which[within])
        return who, which, alike

    while True:
        waiting = np.where(done | (best < -2), -4, best)
        pick = waiting.argmax(axis=1)
        q = np.flatnonzero(waiting[np.arange(n), pick] > -4)
        if not len(q):
            break
        done[q, pick[q]] = True
        who, which, alike = widen(q, node[q, pick[q]])
        by = np.lexsort((-alike, who))
        who, which, alike = who[by], which[by], alike[by]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        top = place < pool
        new_best, new_node = np.full((n, pool), -3, dtype=np.float32), np.zeros((n, pool), dtype=np.int64)
        new_best[who[top], place[top]], new_node[who[top], place[top]] = alike[top], which[top]
        best, node, done = np.hstack((best, new_best)), np.hstack((node, new_node)), np.hstack((done, np.zeros_like(done)))
        keep = np.argsort(-best, axis=1, kind="stable")[:, :pool]
        best, node, done = (np.take_along_axis(a, keep, axis=1) for a in (best, node, done))
    while True:  # the range: all that lies within it is opened in turn
        q, at = np.concatenate(near_q), np.concatenate(near_n)
        closed = ~opened[q, at]
        if not closed.any():
            return q, at
        widen(q[closed], at[closed])


def _tasks(rows: DataFrame) -> DataFrame:
    """A row for each shard a vector is in and each pair of blocks: lot, i, j, shard, block and the vector."""
    members = rows.withColumn("shard", F.explode(F.array_distinct(F.array("home", "other"))))
    sizes = pin(members.groupBy("label", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("b"), F.count("*").alias("n")))
    lots = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // TOGETHER))
    dealt = members.join(sizes.drop("n"), ["label", "shard"]).withColumn("block", F.expr("CAST(pmod(xxhash64(vec_id), b) AS INT)"))
    alone = F.col("b") == 1
    spread = dealt.withColumn("y", F.explode(F.expr("sequence(0, b - 1)")))
    return spread.select(
        F.when(alone, F.pmod(F.xxhash64("label", "shard"), F.lit(lots))).otherwise(F.xxhash64("label", "shard")).alias("lot"),
        F.when(alone, F.lit(-1)).otherwise(F.least("block", "y")).alias("i"),
        F.when(alone, F.lit(-1)).otherwise(F.greatest("block", "y")).alias("j"),
        "label", "shard", "block", "vec_id", "x", "size", "home", "other",
    )


def _of_one_width(group: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    widths = group["x"].map(len)
    for _, own in group.groupby(widths, sort=False):
        own = own.sort_values("vec_id")
        yield own, _units(np.stack(own["x"].to_numpy()))


def graph(tasks: DataFrame) -> DataFrame:
    """vec_id and neighbours: the lists of all shards and blocks a vector is in, united."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, shard in rows.groupby(["label", "shard"], sort=False):
            for own, x in _of_one_width(shard):
                start, to = robust_pruned(x)
                ids = own["vec_id"].to_numpy()
                out.append(pd.DataFrame({"vec_id": ids[start], "to": ids[to]}).groupby("vec_id")["to"].agg(list).reset_index(name="neighbours"))
        return pd.concat(out) if out else pd.DataFrame({"vec_id": [], "neighbours": []})

    lists = tasks.groupBy("lot", "i", "j").applyInPandas(build, "vec_id long, neighbours array<long>")
    return lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(vectors: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """One row per vector, vec_id, n_links, component_id, kept; and the usable classes the links are among.

    Vectors link if their labels are equal and not null and their cosine, in
    double precision, is at least ``cosine``. Vectors that are null, zero, of
    another width, or hold null or non-finite components link with nothing.
    ``component_id`` is the smallest vec_id reachable by links. A row that
    repeats a vec_id counts as another vector; rows without vec_id are not
    linked and have no component. Other columns are ignored.
    """
    rows = pin(usable(vectors))
    shapes = rows.groupBy(F.size("x").alias("width"), "label").agg(F.count("*").alias("n")).groupBy("width").agg(F.max("n").alias("n")).collect()
    centres = {}
    for width, most in shapes:
        count = min(CENTROIDS, -(-most // SHARD))
        sample = rows.where(F.size("x") == width).select("x", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE).select("x").collect() if count > 1 else []
        centres[width] = fit_centroids(np.array([r[0] for r in sample]), count) if sample else np.zeros((1, width))
    tasks = pin(_tasks(assign(rows, centres)))
    lists = pin(graph(tasks))
    searched = tasks.join(lists, "vec_id", "left")

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, shard in rows.groupby(["label", "shard"], sort=False):
            for own, x in _of_one_width(shard):
                ids = own["vec_id"].to_numpy()
                lists = [np.asarray(v if v is not None else (), dtype=np.int64) for v in own["neighbours"]]
                start, to = np.repeat(np.arange(len(ids)), [len(v) for v in lists]), np.concatenate(lists)
                at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
                here = ids[at] == to
                q, node = range_search(x, start[here], at[here], cosine - SLACK)
                code = np.unique(np.minimum(q, node) * len(ids) + np.maximum(q, node))
                a, b = code // len(ids), code % len(ids)
                ok = (a != b) & (np.einsum("ij,ij->i", x[a], x[b]) >= cosine)
                # A pair that meets in two shards counts in the first, one that meets in several blocks across them.
                home, other, here = own["home"].to_numpy(), own["other"].to_numpy(), own["shard"].iloc[0]
                mine = np.full(len(a), here)
                for p, r in ((home, home), (home, other), (other, home), (other, other)):
                    mine = np.where(p[a] == r[b], np.minimum(mine, p[a]), mine)
                ok &= mine == here
                if own["i"].iloc[0] != own["j"].iloc[0]:
                    block = own["block"].to_numpy()
                    ok &= block[a] != block[b]
                a, b = a[ok], b[ok]
                size, total = own["size"].to_numpy(), np.zeros(len(ids), dtype=np.int64)
                np.add.at(total, a, size[b])
                np.add.at(total, b, size[a])
                some = np.flatnonzero(total)
                out.append(pd.DataFrame({"vec_id": ids[some], "links": total[some], "root": ids[_local_roots(len(ids), a, b)[some]]}))
        return pd.concat(out) if out else pd.DataFrame({"vec_id": [], "links": [], "root": []})

    found = pin(searched.groupBy("lot", "i", "j").applyInPandas(search, "vec_id long, links long, root long"))
    counted = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "vec_id")
    known = rows.join(counted, "vec_id", "left").join(reached, "vec_id", "left").select(
        F.col("label").alias("_label"), F.col("x").alias("_x"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), F.coalesce("component", "vec_id").alias("_component")
    )
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.xxhash64("label")).alias("_l"), F.col("embedding").cast("array<double>").alias("_e"))
    out = own.join(known, (F.col("_l") == F.col("_label")) & (F.col("_e") == F.col("_x")), "left")
    component = F.coalesce("_component", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")), rows


def audit(rows: DataFrame, found: DataFrame, cosine: float = COSINE, queries: int = AUDIT) -> float:
    """Recall of links: those of at most ``queries`` vectors, chosen by hash, against brute force over all rows."""
    chosen = rows.select("vec_id", "label", "x", F.xxhash64("vec_id", F.lit("audit")).alias("h")).orderBy("h").limit(queries).collect()
    if not chosen:
        return 1.0
    asked: dict[tuple[int, int], list] = {}
    for r in chosen:
        asked.setdefault((r["label"], len(r["x"])), []).append((r["vec_id"], r["x"]))
    packed = {k: (np.array([i for i, _ in v]), _units(np.array([x for _, x in v]))) for k, v in asked.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for label, size, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (label, len(x)) in packed:
                    ids, near = packed[label, len(x)]
                    for i in ids[near @ _units(np.array([x]))[0] >= cosine].tolist():
                        total[i] = total.get(i, 0) + size
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["vec_id", "n"])

    true = rows.select("label", "size", "x").mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
    sums = true.join(found.groupBy("vec_id").agg(F.max("n_links").alias("n_links")), "vec_id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
    return float(sums[1] / sums[0]) if sums[0] else 1.0
