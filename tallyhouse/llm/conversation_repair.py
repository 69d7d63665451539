"""Repair of conversations to the turn order ``(s?(ua)+)?`` at least cost.

Rows of a conversation and the four states of that order (nothing yet, after
system, after user, after assistant) span a lattice with small integer costs:
keep, give another role, delete, insert. The cheapest repair is a shortest path
through it, found by the auction algorithm: node prices rise while one path is
extended over the best arc or contracted, until it reaches the end. The prices
then show which arcs are tight, and of the tight paths the one whose letters
come first is traced.

A conversation may be longer than a task can hold, so its rows are cut into
segments of bounded length that know each other by four border prices only:
segments are priced for each border by themselves, one pass over their short
tables hands the prices on from the last segment to the first, every segment is
traced from each of its four entries, and one pass forward picks the traces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.ordering import numbered
from tallyhouse.session import pin

BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a segment: an auction on so few rows ends after some thousand steps.
SEGMENT = 64
#: More than any path costs.
FAR = 1 << 40

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
BLANK_ROW, DUPLICATE_ROW, TRUNCATED_ROW = 1, 2, 3
#: States: nothing yet, after system, after user, after assistant; classes of a role: s, u, a, other.
START, SYSTEM, USER, ASSISTANT = range(4)
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
TURN = (USER, USER, ASSISTANT, USER)
#: The price of each state behind the last row, where only inserted rows can follow, and these rows.
END_PRICES = (0, 2 * INSERT, INSERT, 0)
END_ROWS = ("", "ua", "a", "")


def lattice(codes: list[int]) -> list[list[tuple[str, int, int]]]:
    """For each node (4 * row + state) its arcs: letter, cost, next node. A code is the role's class and four times the fault."""
    nodes: list[list[tuple[str, int, int]]] = []
    for i, code in enumerate(codes):
        role, fault = code & 3, code >> 2
        late = TRUNCATED if fault == TRUNCATED_ROW else 0
        for q in range(4):
            arcs = [("D", DELETE, 4 * i + 4 + q), ("I", INSERT, 4 * i + TURN[q])]
            if fault not in (BLANK_ROW, DUPLICATE_ROW):
                if (q, role) in KEPT:
                    arcs.append(("K", KEEP + late, 4 * i + 4 + KEPT[q, role]))
                arcs.append(("R", REROLE + late, 4 * i + 4 + TURN[q]))
            nodes.append(arcs)
    return nodes


def _reaching(nodes: list[list[tuple[str, int, int]]], good: list[bool], taken) -> list[bool]:
    """Which nodes reach a good one of the last layer over arcs that are ``taken(node, arc)``."""
    found = [False] * len(nodes) + good
    for first in range(len(nodes) - 4, -1, -4):
        changed = True
        while changed:  # inserted rows lead to a node of the same layer
            changed = False
            for v in range(first, first + 4):
                if not found[v] and any(found[arc[2]] and taken(v, arc) for arc in nodes[v]):
                    found[v] = changed = True
    return found


def auction(nodes: list[list[tuple[str, int, int]]], exits: list[int]) -> list[int]:
    """Prices of all nodes, of which those of the first layer are exact distances to the end.

    ``exits`` are the costs from the four nodes of the last layer to the end. A
    price never exceeds the cost of an arc plus the price of its head, and
    equals it along the path; FAR marks nodes that cannot reach the end.
    """
    n = len(nodes)
    alive = _reaching(nodes, [x < FAR for x in exits], lambda v, arc: True)
    prices = [0 if x else FAR for x in alive[:n]] + [FAR] * 4 + [0]
    arcs = [*[[(cost, head) for _, cost, head in own] for own in nodes], *[[(x, n + 4)] for x in exits]]
    for q, x in enumerate(exits):
        prices[n + q] = 0 if x < FAR else FAR
    for origin in range(4):
        path = [origin] if prices[origin] < FAR else [n + 4]
        while path[-1] != n + 4:
            v = path[-1]
            level, best = min([(cost + prices[head], head) for cost, head in arcs[v]])
            if prices[v] < level:
                prices[v] = level
                if len(path) > 1:
                    path.pop()
            else:
                path.append(best)
    return prices[: n + 4]


def border_prices(codes: list[int]) -> list[int]:
    """The least cost from each entry state to each exit state, row by row of the entries."""
    nodes, columns = lattice(codes), []
    for q in range(4):
        columns.append(auction(nodes, [0 if x == q else FAR for x in range(4)])[:4])
    return [min(columns[exit_][entry], FAR) for entry in range(4) for exit_ in range(4)]


def traces(codes: list[int], exits: list[int]) -> list[tuple[int, int, str, list[str]]]:
    """For each entry state: exit state, cost, letters, and for each row what becomes of it.

    The latter has ``u`` or ``a`` for each row inserted before, then ``k`` (kept),
    ``U`` or ``A`` (the new role), or ``d`` (deleted).
    """
    nodes = lattice(codes)
    prices, n = auction(nodes, exits), len(nodes)
    tight = lambda v, arc: prices[v] < FAR and prices[v] == arc[1] + prices[arc[2]]
    good = _reaching(nodes, [exits[q] < FAR and prices[n + q] == exits[q] for q in range(4)], tight)
    out = []
    for entry in range(4):
        v, cost, letters, rows, row = entry, 0, [], [], ""
        while v < n:
            letter, price, head = min(arc for arc in nodes[v] if tight(v, arc) and good[arc[2]])
            letters.append(letter)
            cost += price
            role = "ua"[head % 4 == ASSISTANT]
            row += {"I": role, "K": "k", "D": "d", "R": role.upper()}[letter]
            if letter != "I":
                rows.append(row)
                row = ""
            v = head
        out.append((v - n, cost, "".join(letters), rows))
    return out


def _key(conv_id: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def ordered_rows(conversations: DataFrame) -> DataFrame:
    """The rows in order, stored: key, turn, role, text, digest, row_index, segment and code.

    Rows of a conversation are ordered by turn (null first), then role and a
    digest of the text. A null role or text is one space.
    """
    rows = conversations.select(
        _key(F.col("conv_id")).alias("key"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("salt", F.monotonically_increasing_id())
    rows = pin(numbered(rows, ["key", "turn", "role", "digest", "salt"]).drop("salt"))
    repeated = rows.groupBy("key", "role", "digest").agg(F.min("row_index").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(repeated, ["key", "role", "digest"], "left")
    trimmed = F.btrim("text", F.lit(BLANKS))
    fault = (
        F.when(trimmed == "", BLANK_ROW)
        .when(F.col("row_index") > F.col("first"), DUPLICATE_ROW)
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), TRUNCATED_ROW)
        .otherwise(0)
    )
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return rows.select("key", "turn", "role", "text", "row_index", F.expr(f"row_index DIV {SEGMENT}").alias("segment"), (role + 4 * fault).alias("code"))


def _mapped(df: DataFrame, each, schema: str) -> DataFrame:
    """``each`` gets an iterator of rows as dictionaries of all batches of a task, and yields such rows."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = []
        for row in each(row for batch in batches for row in batch.to_pylist()):
            waiting.append(row)
            if len(waiting) == 1000:
                yield pa.RecordBatch.from_pylist(waiting, schema=arrow)
                waiting = []
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema=arrow)

    return df.mapInArrow(run, fields)


SEGMENTS = "key string, segment long, start long, codes array<int>"


def _priced(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        yield row | {"borders": border_prices(row["codes"])}


def _handed_on(rows: Iterator[dict]) -> Iterator[dict]:
    """From the last segment of a conversation to the first: the prices at each segment's end."""
    key, exits = None, []
    for row in rows:
        last = row["key"] != key
        if last:
            key, exits = row["key"], list(END_PRICES)
        borders = row.pop("borders")
        yield row | {"exits": exits, "last": last}
        exits = [min(borders[4 * q + x] + exits[x] for x in range(4)) for q in range(4)]


def _traced(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        found = traces(row["codes"], row.pop("exits"))
        yield row | {"options": [dict(zip(("state", "cost", "audit", "plan"), x)) for x in found]}


LEGAL = {(0, 1), (1, 2), (2, 1)}


def _picked(rows: Iterator[dict]) -> Iterator[dict]:
    """From the first segment of a conversation to the last: the trace of the state it is entered in."""
    key, state, before = None, START, None
    for row in rows:
        if row["key"] != key:
            key, state, before = row["key"], START, None
        roles, faults = [c & 3 for c in row["codes"]], [c >> 2 for c in row["codes"]]
        pairs = list(zip(roles, roles[1:])) + ([(before, roles[0])] if before is not None else [])
        found, before = row["options"][state], roles[-1]
        state, plan, more = found["state"], found["plan"], ""
        if row["last"]:
            more = END_ROWS[state]
            plan[-1] += more
        yield {
            "key": key, "segment": row["segment"], "start": row["start"], "plan": plan,
            "audit": found["audit"] + "I" * len(more), "cost": found["cost"] + INSERT * len(more),
            "blank": faults.count(BLANK_ROW), "duplicate": faults.count(DUPLICATE_ROW), "truncated": faults.count(TRUNCATED_ROW),
            "illegal": sum(p not in LEGAL for p in pairs),
        }


def repaired_segments(rows: DataFrame) -> DataFrame:
    """For each segment of ``ordered_rows`` its letters, cost, faults and what becomes of each row, stored."""
    numbers = F.sort_array(F.collect_list(F.struct("row_index", "code")))  # at most SEGMENT rows
    segments = rows.groupBy("key", "segment").agg(numbers.alias("r"))
    segments = segments.select("key", "segment", F.col("r")[0]["row_index"].alias("start"), F.col("r.code").alias("codes"))
    priced = _mapped(segments, _priced, f"{SEGMENTS}, borders array<long>")
    exits = _mapped(priced.repartition("key").sortWithinPartitions("key", F.desc("segment")), _handed_on, f"{SEGMENTS}, exits array<long>, last boolean")
    options = "options array<struct<state: int, cost: long, audit: string, plan: array<string>>>"
    traced = _mapped(exits.repartition("key", "segment"), _traced, f"{SEGMENTS}, last boolean, {options}")
    counts = "audit string, cost long, blank long, duplicate long, truncated long, illegal long"
    return pin(_mapped(traced.repartition("key").sortWithinPartitions("key", "segment"), _picked, f"key string, segment long, start long, plan array<string>, {counts}"))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired rows and a report with one row for each conv_id.

    Repaired rows: key, row_index, step, role, text, edit (keep, rerole or
    insert), in the order of row_index and step; ``key`` is of the report, too.
    The report: conv_id, key, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Null conv_ids are one conversation. A null turn comes first; a null role or
    text is one space. Equal rows of a turn are in any order, which changes no
    result; other ties are ordered by role and text. A role other than s..., u...
    or a... is never kept. The empty table gives no rows. Extra columns are left out.
    """
    rows = pin(ordered_rows(conversations))
    segments = repaired_segments(rows)
    joined = rows.join(segments.select("key", "segment", "start", "plan"), ["key", "segment"])
    steps = F.filter(F.split(F.get("plan", (F.col("row_index") - F.col("start")).cast("int")), ""), lambda s: ~s.isin("d", ""))
    step = F.col("did")
    repaired = joined.select("key", "row_index", "role", "text", F.posexplode(steps).alias("step", "did")).select(
        "key",
        "row_index",
        "step",
        F.when(step == "k", F.col("role")).when(F.lower(step) == "u", "user").otherwise("assistant").alias("role"),
        F.when(step.isin("u", "a"), "").otherwise(F.col("text")).alias("text"),
        F.when(step == "k", "keep").when(step.isin("u", "a"), "insert").otherwise("rerole").alias("edit"),
    )
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    letters = F.array_join(F.col("a.audit"), "").alias("audit")  # a letter for each row
    report = segments.groupBy("key").agg(*sums, F.sort_array(F.collect_list(F.struct("segment", "audit"))).alias("a")).select("*", letters).drop("a")
    distinct = rows.where("turn IS NOT NULL").groupBy("key", "turn").agg(F.lit(1).alias("one"))
    gaps = distinct.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    report = report.join(gaps, "key", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long")))
    names = rows_of(conversations)
    return repaired, names.join(report, "key").select("conv_id", "key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def rows_of(conversations: DataFrame) -> DataFrame:
    """The distinct conv_ids with their keys."""
    return conversations.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", _key(F.col("conv_id")).alias("key"))


def digests(repaired: DataFrame) -> DataFrame:
    """key and repaired_sha256, over ``role:text`` joined by newlines.

    A SHA-256 reads its text in order, so the rows of a conversation go through
    one task, one after another, without being held there.
    """

    def hashed(rows: Iterator[dict]) -> Iterator[dict]:
        key, digest = None, None
        for row in rows:
            if row["key"] != key:
                if digest:
                    yield {"key": key, "repaired_sha256": digest.hexdigest()}
                key, digest = row["key"], hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{row['role']}:{row['text']}".encode())
        if digest:
            yield {"key": key, "repaired_sha256": digest.hexdigest()}

    dealt = repaired.select("key", "row_index", "step", "role", "text").repartition("key").sortWithinPartitions("key", "row_index", "step")
    return _mapped(dealt, hashed, "key string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """A fixed tenth and more of the rows spoilt, by a hash of conv_id and turn: dropped, emptied, cut of its stops, repeated, said by the user."""
    named = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    case = F.crc32(named.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), case.alias("case"))
    copies = F.when(F.col("case") == 0, 0).when(F.col("case") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"),
    ).drop("copy")
