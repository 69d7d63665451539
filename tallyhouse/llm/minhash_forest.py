"""N-gram Jaccard join by a MinHash LSH forest.

Every text is a set of word shingles with a label of ``DEPTH`` MinHash values
in each of ``TREES`` trees. The labels of all trees are sorted, so that a node
of a prefix trie is a run of neighbours, and only labels that share a long
enough prefix with a neighbour go on. The join starts with whole labels and
shortens the matched prefixes level by level. Each level verifies the pairs
that came together anew on the exact sets, and from the similarities of all
links found so far estimates the share of links it has found: a link of
similarity s is met at depth d in some tree with probability
1 - (1 - s^d)^trees. It stops at the target, and at the latest where even links
at the very threshold are met with the target probability.

Texts with equal sets are one class and are verified once. Texts that meet are
dealt in groups; a group too large for a task is cut into blocks, and each pair
of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.components import joined
from tallyhouse.llm.expressions import text_key
from tallyhouse.llm.textwords import mixed, shingle_sets, utf8
from tallyhouse.session import pin

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 8, 0.999
#: Classes and shingles of a block; classes of small groups that share a task.
BLOCK, BLOCK_SHINGLES, TOGETHER = 512, 1_000_000, 2000
#: Steps of similarity, from the threshold to 1, in which links are counted.
STEPS = 20
#: Up to so many candidates (16 bytes each) are sent to all tasks that look their texts up; beyond, texts and candidates are joined by an exchange.
SENT = 1_000_000


def met(similarity: np.ndarray | float, depth: int, trees: int = TREES) -> np.ndarray | float:
    """The probability with which a pair shares a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def stop_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with probability ``recall``; at least 1."""
    while depth > 1 and met(threshold, depth, trees) < recall:
        depth -= 1
    return depth


def estimated_recall(tally: np.ndarray, threshold: float, depth: int, trees: int = TREES) -> float:
    """The share of links found at ``depth``, by weighting each found one with the inverse of its probability.

    ``tally`` counts the found links by similarity in equal steps from the
    threshold to 1; a link has the lower end of its step. One more link at the
    threshold is assumed, so that nothing found does not pass for all found.
    """
    chance = met(threshold + (1 - threshold) * np.arange(len(tally)) / len(tally), depth, trees)
    return float((tally.sum() + chance[0]) / ((tally / chance).sum() + 1))


def labels(sets: list[np.ndarray], trees: int, depth: int) -> list[np.ndarray]:
    """For each set one label per tree: bytes of the tree's number and ``depth`` MinHash values of 16 bits, most significant first."""
    rng = np.random.default_rng(20)
    shape = (trees * depth, 1)
    odd = rng.integers(0, 1 << 31, shape, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    flip = rng.integers(0, 1 << 32, shape, dtype=np.uint32)
    out = []
    for own in sets:
        if not len(own):
            out.append(np.zeros((0, depth + 1), dtype=">u2"))
            continue
        low = (own >> np.uint64(32)).astype(np.uint32)
        least = np.full(trees * depth, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(low), 2048):
            np.minimum(least, (((low[at : at + 2048] ^ flip) * odd)).min(axis=1), out=least)
        values = (mixed(least.astype(np.uint64)) >> np.uint64(48)).reshape(trees, depth)
        out.append(np.column_stack([np.arange(trees, dtype=np.uint64), values]).astype(">u2"))
    return out


def sketches(documents: DataFrame, shingle: int, trees: int, depth: int) -> DataFrame:
    """doc_id, text_hash, n (shingles), k1 and k2 (of the set), labels (one for each tree; none without shingles)."""
    shape = "doc_id long, text_hash long, n int, k1 long, k2 long, labels array<binary>"
    names = ["doc_id", "text_hash", "n", "k1", "k2", "labels"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(*utf8(batch.column(2)), size=shingle)
            own = labels(sets, trees, depth)
            ends = np.cumsum([0, *map(len, own)], dtype=np.int32)
            data = pa.py_buffer(b"".join(x.tobytes() for x in own))
            width = 2 * (depth + 1)
            flat = pa.Array.from_buffers(pa.binary(), int(ends[-1]), [None, pa.py_buffer(np.arange(ends[-1] + 1, dtype=np.int32) * np.int32(width)), data])
            once = [int(x.sum()) for x in sets]
            twice = [int(mixed(x ^ np.uint64(0x5851F42D4C957F2D)).sum()) for x in sets]
            columns = [batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int32())]
            columns += [pa.array(np.asarray(x, dtype=np.uint64).view(np.int64)) for x in (once, twice)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends), flat)], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")), "text").mapInArrow(sketch, shape)


def tries(classes: DataFrame, depth: int, least: int) -> DataFrame:
    """rep, label, shared: the sorted labels that share at least ``least`` values with a neighbour, and how many.

    Equal labels may lie in several tasks. The first and last label of a batch
    have neighbours out of sight and pass as sharing all.
    """

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, _ = utf8(batch.column(1))
            values = text.view(np.uint16).reshape(batch.num_rows, depth + 1)
            # The number of the tree counts as one value.
            common = np.logical_and.accumulate(values[1:] == values[:-1], axis=1).sum(axis=1) - 1
            shared = np.full(batch.num_rows, depth, dtype=np.int32)
            shared[1:-1] = np.maximum(common[:-1], common[1:])
            yield batch.append_column("shared", pa.array(shared)).filter(pa.array(shared >= least))

    leaves = classes.select("rep", F.explode("labels").alias("label"))
    ordered = leaves.repartitionByRange("label", "rep").sortWithinPartitions("label", "rep")
    return ordered.mapInArrow(neighbours, "rep long, label binary, shared int")


def _linked(sets: list[np.ndarray], threshold: float, *sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of sets reach the threshold, a boolean matrix, exact, and their similarities. ``sides``: only pairs unlike in each."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    both = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 8192
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [at, at + width])
        part = np.zeros((n, min(width, int(column[-1]) + 1 - at)), dtype=np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        both += part @ part.T
    union = sizes[:, None] + sizes[None, :] - both
    found = both >= threshold * union - 1e-6
    np.fill_diagonal(found, False)
    for side in sides:
        found &= side[:, None] != side[None, :]
    return found, both / union


def _roots(found: np.ndarray) -> np.ndarray:
    """The smallest index each row is connected with."""
    label = np.arange(len(found))
    while True:
        least = np.where(found, label[None, :], len(found)).min(axis=1, initial=len(found))
        new = np.minimum(label, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(documents: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES) -> DataFrame:
    """One row per document: doc_id, class_id, copy_of, n_links, kept.

    Two documents are linked if the Jaccard similarity of their sets of
    ``shingle`` words in a row is at least ``threshold``. ``class_id`` is the
    smallest doc_id reachable by links, ``copy_of`` the smallest doc_id with
    the same set, ``n_links`` the number of other documents linked directly,
    ``kept`` whether the document is its class's. A text of fewer words is one
    shingle; null texts and texts without words are linked with nothing, and
    so are rows without doc_id (class_id null). Rows that repeat a doc_id are
    taken for one document: a repeated row counts as a link of the others.
    """
    sketched = pin(sketches(documents, shingle, trees, DEPTH))
    usable = sketched.where("n > 0 AND doc_id IS NOT NULL")
    classes = pin(
        usable.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("labels").alias("labels"))
        .select("k1", "k2", F.col("r.doc_id").alias("rep"), F.col("r.text_hash").alias("rep_hash"), "size", "n", "labels")
    )
    verified, _ = search(documents, classes, shingle, threshold, recall, trees)
    counted = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = joined(verified.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    known = classes.join(counted, "rep", "left").join(reached.withColumnRenamed("node", "rep"), "rep", "left")
    known = pin(known.select("k1", "k2", "rep", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")))
    own = sketched.select("doc_id", "n", "k1", "k2")
    # Only texts with shingles look their set up; the others must not all ask for the empty one.
    named = own.where("n > 0 AND doc_id IS NOT NULL").join(known, ["k1", "k2"])
    out = named.select("doc_id", F.col("component").alias("class_id"), F.col("rep").alias("copy_of"), F.col("links").alias("n_links"))
    alone = own.where("n = 0 OR doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def search(documents: DataFrame, classes: DataFrame, shingle: int, threshold: float, recall: float, trees: int) -> tuple[DataFrame, int]:
    """Verified links (see ``_verify``) between classes of unlike sets, and the depth to which prefixes were shortened."""
    least = stop_depth(threshold, recall, trees)
    levels = range(DEPTH, least - 1, -1)
    trie = pin(tries(classes, DEPTH, least))
    texts = pin(_candidates(documents, classes, trie))
    dealt = pin(_dealt(texts, _groups(trie, *levels)))
    members = dealt.agg(*[F.count(F.when(F.col("depth") == d, 1)) for d in levels]).first()
    tally, verified = np.zeros(STEPS, dtype=np.int64), None
    for depth, n in zip(levels, members):
        found = pin(_verify(texts, dealt.where(F.col("depth") == depth), n, shingle, threshold))
        verified = found if verified is None else verified.unionByName(found)
        # Every pair stands twice in its matrix.
        steps = found.agg(*[F.coalesce(F.sum(F.col("steps")[i]), F.lit(0)) for i in range(STEPS)]).first()
        tally += np.array(steps, dtype=np.int64) // 2
        if estimated_recall(tally, threshold, depth, trees) >= recall:
            break
    return verified, depth


def _candidates(documents: DataFrame, classes: DataFrame, trie: DataFrame) -> DataFrame:
    """rep, size, n, text of the classes in the tries."""
    own = documents.select(F.col("doc_id").cast("long").alias("rep"), text_key(F.col("text")).alias("rep_hash"), "text")
    reps = trie.select("rep").distinct()
    wanted = pin(classes.select("rep", "rep_hash", "size", "n").join(reps, "rep").dropDuplicates(["rep"]))
    if wanted.count() <= SENT:
        own = own.join(F.broadcast(wanted.select("rep", "rep_hash")), ["rep", "rep_hash"], "left_semi")
    # By the keys of the join: texts that were exchanged for it are not exchanged again.
    return wanted.join(own, ["rep", "rep_hash"]).dropDuplicates(["rep", "rep_hash"]).select("rep", "size", "n", "text")


def _groups(trie: DataFrame, *depths: int) -> DataFrame:
    """depth, rep and g: for each of ``depths`` the group of the classes that share a prefix of so many values in some tree with another one."""
    levels = F.filter(F.array(*map(F.lit, depths)), lambda d: d <= F.col("shared"))
    leaves = trie.select("rep", "label", F.explode(levels).alias("depth")).selectExpr("depth", "rep", "substring(label, 1, 2 * (depth + 1)) AS prefix")
    # Prefixes of unlike depths are of unlike lengths. Stored nodes let the leaves of a common one be split among tasks.
    nodes = pin(leaves.groupBy("prefix").agg(F.min("rep").alias("root"), F.count("*").alias("n")).where("n > 1").select("prefix", "root"))
    edges = leaves.join(nodes, "prefix").where("rep <> root").select("depth", F.col("rep").alias("u"), F.col("root").alias("v"))
    return joined(edges, "depth").select("depth", F.col("node").alias("rep"), F.col("component").alias("g"))


def _dealt(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """depth, g, rep, size, old (the member's group one level deeper, or rep) and b (blocks) of the groups that are new at their depth."""
    nested = groups.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("depth", "g"))).alias("groups"))
    own = texts.select("rep", "size", "n").join(nested, "rep").select("*", F.explode("groups").alias("depth", "g"))
    members = pin(own.select("depth", "g", "rep", "size", "n", F.coalesce(F.try_element_at("groups", F.col("depth") + 1), "rep").alias("old")))
    sizes = members.groupBy("depth", "g").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("b"), F.min("old").alias("a"), F.max("old").alias("z")
    )
    # Stored, so that the members of a large group can be split among tasks.
    sizes = pin(sizes.where("a <> z").select("depth", "g", "b"))
    return members.join(sizes, ["depth", "g"]).drop("n")


def _verify(texts: DataFrame, dealt: DataFrame, members: int, shingle: int, threshold: float) -> DataFrame:
    """rep, links (documents of other classes linked in this task), root (smallest rep connected in this task), steps.

    Only pairs that are together in a group of ``dealt`` (of one depth, with
    ``members`` rows) but have not the same ``old`` one are verified. ``steps``
    counts a task's links by similarity, in one row a group.
    """
    lots = max(1, -(-members // TOGETHER))
    dealt = dealt.withColumn("x", F.expr("CAST(pmod(xxhash64(rep), b) AS INT)"))
    tasks = dealt.withColumn("y", F.explode(F.expr("sequence(0, b - 1)"))).select(
        "rep", "size", "old", "g", "x",
        F.when(F.col("b") == 1, F.pmod(F.xxhash64("g"), F.lit(lots))).otherwise(F.col("g")).alias("lot"),
        F.when(F.col("b") == 1, F.lit(-1)).otherwise(F.least("x", "y")).alias("i"),
        F.when(F.col("b") == 1, F.lit(-1)).otherwise(F.greatest("x", "y")).alias("j"),
    )
    own = texts.select("rep", "text")
    if members <= SENT:
        own = own.join(F.broadcast(dealt.select("rep")), "rep", "left_semi")
    rows = tasks.join(own, "rep")

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("rep")
        out = []
        for _, group in rows.groupby("g", sort=False):
            group = group.sort_values("rep")
            sets = shingle_sets(*utf8(pa.array(group["text"], pa.large_string())), size=shingle)
            sides = [group["old"].to_numpy()]
            if group["i"].iloc[0] != group["j"].iloc[0]:
                sides.append(group["x"].to_numpy())
            found, alike = _linked(sets, threshold, *sides)
            some = np.flatnonzero(found.any(axis=1))
            if not len(some):
                continue
            reps = group["rep"].to_numpy()
            step = np.floor((alike[found] - threshold) / (1 - threshold) * STEPS) if threshold < 1 else np.zeros(found.sum())
            steps = np.bincount(step.clip(0, STEPS - 1).astype(int), minlength=STEPS)
            rest = [None] * (len(some) - 1)
            out.append(pd.DataFrame({"rep": reps[some], "links": (found @ group["size"].to_numpy())[some], "root": reps[_roots(found)][some], "steps": [steps, *rest]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["rep", "links", "root", "steps"], dtype=object)

    return rows.groupBy("lot", "i", "j").applyInPandas(verify, "rep long, links long, root long, steps array<long>")
