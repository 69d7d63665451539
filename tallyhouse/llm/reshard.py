"""Resharding by minimum-cost flow: new shards of nearly equal bytes, moving as few bytes as can be.

From the sizes of the old shards and the capacities of the new ones, one flow
says how many bytes go from each old shard to each new one; a byte that stays
costs nothing. Documents are then cut into contiguous blocks along it, large
ones before small ones: the large ones of a shard fill its own quota first and
then those of other shards. A cut falls between documents, so what these blocks
lack or exceed is levelled by the small documents, again by a cheapest flow.

The driver sees sizes of shards and blocks, never rows. Only shards that gain
or lose rows are written anew.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyhouse.llm.ordering import numbered

#: Bytes of a document besides its text; share of all bytes in small documents, which level the shards.
OVERHEAD, SMALL_SHARE = 16, 0.3


def min_cost_flow(supply: Sequence[int], demand: Sequence[int], cost: np.ndarray) -> np.ndarray:
    """Amounts from each source to each sink, at least total cost, by shortest augmenting paths.

    The totals must agree. A path may take back amounts sent before; its cost
    is found anew each time, as there are only as many nodes as shards.
    """
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    n, m = len(supply), len(demand)
    flow = np.zeros((n, m), dtype=np.int64)
    supply, demand = np.array(supply, dtype=np.int64), np.array(demand, dtype=np.int64)
    cost = np.asarray(cost, dtype=np.int64)
    far = np.iinfo(np.int64).max // 4
    while supply.any():
        out = np.where(supply > 0, 0, far)
        into, via, back = np.full(m, far), np.zeros(m, dtype=np.int64), np.full(n, -1)
        while True:
            reach = out[:, None] + cost
            best = reach.argmin(axis=0)
            new = np.where(reach.min(axis=0) < into, reach.min(axis=0), into)
            via = np.where(new < into, best, via)
            returned = np.where(flow > 0, new[None, :] - cost, far)
            nearest = returned.argmin(axis=1)
            shorter = returned.min(axis=1) < out
            if (new == into).all() and not shorter.any():
                break
            into = new
            out = np.where(shorter, returned.min(axis=1), out)
            back = np.where(shorter, nearest, back)
        sink = int(np.where(demand > 0, into, far).argmin())
        path, node = [], sink
        while True:
            source = int(via[node])
            path.append((source, node))
            if back[source] < 0:
                break
            node = int(back[source])
            path.append((source, node))
        start = path[-1][0]
        amount = min(int(supply[start]), int(demand[sink]), *[int(flow[p]) for p in path[1::2]])
        for i, edge in enumerate(path):
            flow[edge] += amount if i % 2 == 0 else -amount
        supply[start] -= amount
        demand[sink] -= amount
    return flow


def moving_costs(old: Sequence[int], shards: int) -> np.ndarray:
    """0 for a byte that stays in its shard, 1 for one that moves."""
    return np.array([[0 if o == s else 1 for s in range(shards)] for o in old], dtype=np.int64).reshape(len(old), shards)


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def levels(filled: Sequence[int], more: int) -> list[int]:
    """Shares of ``more`` that make the shards as equal as they can be without taking anything away."""
    level, left, order = 0, more, sorted(filled)
    for i, low in enumerate(order):
        top = order[i + 1] if i + 1 < len(order) else None
        level = low + left // (i + 1)
        if top is None or level <= top:
            break
        left -= (top - low) * (i + 1)
    shares = [max(0, level - f) for f in filled]
    for i in sorted((i for i, s in enumerate(filled) if s <= level), key=lambda i: filled[i])[: more - sum(shares)]:
        shares[i] += 1
    return shares


def _routes(flow: np.ndarray, old: Sequence[int], base: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks begin in the running total, in ascending order, and their shards."""
    starts, shards = [], []
    for row, shard in zip(flow, old):
        at = base[shard]
        for to in sorted(np.flatnonzero(row), key=lambda t: (t != shard, t)):
            starts.append(at)
            shards.append(int(to))
            at += int(row[to])
    order = np.argsort(starts, kind="stable")
    return np.array(starts, dtype=np.int64)[order], np.array(shards, dtype=np.int32)[order]


def reshard(documents: DataFrame, old_shard: str, shards: int, overhead: int = OVERHEAD) -> tuple[DataFrame, list[int]]:
    """All rows with _size, _old, _shard and _slot, and the shards that gain or lose rows.

    ``old_shard`` names an integer column; null is shard 0. The size of a row
    is the UTF-8 bytes of its text (null: none) plus ``overhead``. Slots are
    gapless from 0 in each shard. Repeated rows are rows like any others, and
    rows without doc_id come first in their shard. An empty frame gives none.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + overhead
    sized = documents.withColumns({"_old": F.coalesce(F.col(old_shard).cast("int"), F.lit(0)), "_size": size})
    classes = sized.groupBy("_old", F.ceil(F.log2("_size")).cast("int").alias("c")).agg(F.sum("_size").alias("bytes")).collect()  # shards times sizes' logarithms
    total = sum(r["bytes"] for r in classes)
    by_class: dict[int, int] = defaultdict(int)
    for r in classes:
        by_class[r["c"]] += r["bytes"]
    small, held = 0, 0
    for c in sorted(by_class):
        small, held = c, held + by_class[c]
        if held >= SMALL_SHARE * total:
            break
    bytes_of: dict[tuple[int, int], int] = defaultdict(int)
    for r in classes:
        bytes_of[r["_old"], int(r["c"] <= small)] += r["bytes"]
    old = sorted({o for o, _ in bytes_of})
    base, at = {0: {}, 1: {}}, 0
    for o in old:
        for kind in (0, 1):
            base[kind][o] = at
            at += bytes_of[o, kind]
    sized = sized.withColumn("_small", (F.ceil(F.log2("_size")) <= small).cast("int"))
    order = [F.col("_old"), F.col("_small"), F.col("doc_id").asc_nulls_first()]
    ordered = numbered(sized, order, index="_index", running="_size", total="_total")
    stones = [bytes_of[o, 0] for o in old]
    costs = moving_costs(old, shards)
    whole = min_cost_flow([bytes_of[o, 0] + bytes_of[o, 1] for o in old], even(total, shards), costs)
    first = _routes(_filled_first(whole, stones, old), old, base[0])
    placed = _placed(ordered.where("_small = 0"), *first)
    filled = [0] * shards
    for r in placed.groupBy("_shard").agg(F.sum("_size").alias("bytes")).collect():
        filled[r["_shard"]] = r["bytes"]
    sand = [bytes_of[o, 1] for o in old]
    second = _routes(min_cost_flow(sand, levels(filled, sum(sand)), costs), old, base[1])
    placed = placed.unionByName(_placed(ordered.where("_small = 1"), *second))
    blocks = placed.groupBy("_old", "_small", "_shard").agg(F.min("_index").alias("first"), F.count("*").alias("rows")).collect()  # a block for each flow
    blocks.sort(key=lambda r: (r["_shard"], r["_small"], r["_old"]))
    slot: dict[int, int] = defaultdict(int)
    shift = {}
    for r in blocks:
        shift[r["_old"], r["_small"], r["_shard"]] = slot[r["_shard"]] - r["first"]
        slot[r["_shard"]] += r["rows"]
    changed = sorted({s for r in blocks if r["_old"] != r["_shard"] for s in (r["_old"], r["_shard"]) if s < shards})
    spark = documents.sparkSession
    offsets = spark.createDataFrame([(*k, v) for k, v in shift.items()], "_old int, _small int, _shard int, _shift long")
    out = placed.join(F.broadcast(offsets), ["_old", "_small", "_shard"])  # one row for each block
    return out.select(*documents.columns, "_size", "_old", "_shard", (F.col("_index") + F.col("_shift")).alias("_slot")), changed


def _filled_first(flow: np.ndarray, amounts: Sequence[int], old: Sequence[int]) -> np.ndarray:
    """Of each row of the flow the part that ``amounts`` fill, the own shard's before the others'."""
    part = np.zeros_like(flow)
    for i, (amount, shard) in enumerate(zip(amounts, old)):
        for to in sorted(np.flatnonzero(flow[i]), key=lambda t: (t != shard, t)):
            part[i, to] = min(amount, int(flow[i, to]))
            amount -= int(part[i, to])
    return part


def _placed(ordered: DataFrame, starts: np.ndarray, shards: np.ndarray) -> DataFrame:
    """Give each row the shard of the block that holds its middle byte; there are no more blocks than shards, old and new."""
    middle = F.col("_total") + F.floor(F.col("_size") / 2)
    known = F.array(*[F.lit(int(s)) for s in starts]).cast("array<bigint>")
    names = F.array(*[F.lit(int(s)) for s in shards]).cast("array<int>")
    block = F.size(F.filter(known, lambda start: start <= middle))
    return ordered.withColumn("_shard", F.try_element_at(names, F.greatest(block, F.lit(1))))


def rewrite(resharded: DataFrame, changed: Sequence[int], path: str) -> None:
    """Write the rows of the changed shards as ``_shard=N`` folders of Parquet; blocks are contiguous, so a task opens few files."""
    resharded.where(F.col("_shard").isin(list(changed))).write.partitionBy("_shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
