"""Exception rules: many predicates over one frame in a single pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import as_col

# Set while issues are only counted: rows then carry no sentence, name or key.
_COUNTING: ContextVar[bool] = ContextVar("counting", default=False)


@contextmanager
def counting(on: bool = True) -> Iterator[None]:
    """Whether frames built inside are only counted."""
    token = _COUNTING.set(on)
    try:
        yield
    finally:
        _COUNTING.reset(token)


ISSUE_COLUMNS = ("entity_id", "entity_name", "issue_type", "description", "severity", "recommended_action")


@dataclass(frozen=True)
class Rule:
    """One exception rule: what it is called, what it says, and when it fires."""

    issue_type: str
    severity: str
    action: str
    description: Column
    when: Column
    entity_id: Column | str | None = None
    entity_name: Column | str | None = None


def flag_rows(df: DataFrame, rules: Sequence[Rule], entity_id: Column | str, entity_name: Column | str | None, weight: Column | str | None = None) -> DataFrame:
    """Issue rows of every rule that fires, from one scan of ``df``.

    Each input row builds an array with one entry per fired rule and is then
    exploded, so N rules cost one read instead of N unioned branches. While
    issues are only counted, the rules are sums of one aggregate instead, and
    each that fired gives one row with its number ``n``; an input row then
    stands for ``weight`` issues.
    """
    if _COUNTING.get():
        return _numbers(df, rules, weight)
    entries = []
    for rule in rules:
        name = rule.entity_name if rule.entity_name is not None else entity_name
        entry = F.struct(
            as_col(rule.entity_id if rule.entity_id is not None else entity_id).cast("string").alias("entity_id"),
            (F.lit(None) if name is None else as_col(name)).cast("string").alias("entity_name"),
            F.lit(rule.issue_type).alias("issue_type"),
            rule.description.cast("string").alias("description"),
            F.lit(rule.severity).alias("severity"),
            F.lit(rule.action).alias("recommended_action"),
        )
        entries.append(F.when(rule.when, entry))
    fired = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return df.select(F.inline(fired))


@dataclass(frozen=True)
class Mark:
    """Rules that need nothing of a row but ``keys`` and what is looked up by them.

    ``add`` takes a frame and the name of its column of weights (None: each row
    counts once) and adds the columns that are looked up.
    """

    keys: Sequence[str]
    add: Callable[[DataFrame, str | None], DataFrame]
    rules: Sequence[Rule]


def flag_marked(df: DataFrame, marks: Sequence[Mark], rules: Sequence[Rule], entity_id: Column | str, entity_name: Column | str | None) -> DataFrame:
    """Issue rows of rules on a row and of rules on what is looked up by its keys.

    While issues are only counted, each look-up is done for the distinct keys
    and the numbers of their rows, so the rows themselves are not exchanged.
    """
    if _COUNTING.get():
        plain = [flag_rows(df, rules, entity_id, entity_name)] if rules else []
        return stack(*plain, *[flag_rows(m.add(df.groupBy(*m.keys).agg(F.count(F.lit(1)).alias("_weight")), "_weight"), m.rules, None, None, "_weight") for m in marks])
    marked = reduce(lambda frame, m: m.add(frame, None), marks, df)
    return flag_rows(marked, [*rules, *[rule for m in marks for rule in m.rules]], entity_id, entity_name)


#: Issues a row of numbers gives at once.
REPEATS = 1000


def flag_repeats(df: DataFrame, keys: Sequence[str], rule: Rule, entity_id: Column | str, entity_name: Column | str | None = None) -> DataFrame:
    """An issue for each row whose keys are repeated; the rule may read nothing but the keys, and a NULL is no repeat.

    Only the keys and the numbers of their rows are exchanged. The issues of a
    key repeated very often are dealt to many tasks.
    """
    filled = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    repeated = filled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_weight")).where(F.col("_weight") > 1)
    if _COUNTING.get():
        return flag_rows(repeated, [rule], None, None, "_weight")
    parts = F.sequence(F.lit(0).cast("bigint"), ((F.col("_weight") - 1) / REPEATS).cast("bigint"))
    dealt = repeated.select(*keys, "_weight", F.explode(parts).alias("_part")).repartition(*keys, "_part")
    size = F.least(F.lit(REPEATS), F.col("_weight") - F.col("_part") * REPEATS).cast("int")
    return flag_rows(dealt.select(*keys, F.explode(F.array_repeat(F.lit(True), size)).alias("_issue")), [rule], entity_id, entity_name)


def _numbers(df: DataFrame, rules: Sequence[Rule], weight: Column | str | None) -> DataFrame:
    each = F.lit(1).cast("bigint") if weight is None else as_col(weight).cast("bigint")
    row = df.agg(*[F.sum(F.when(rule.when, each)).alias(f"_{i}") for i, rule in enumerate(rules)])
    none = F.lit(None).cast("string")
    entries = []
    for i, rule in enumerate(rules):
        texts = dict(zip(ISSUE_COLUMNS, (none, none, F.lit(rule.issue_type), none, F.lit(rule.severity), F.lit(rule.action))))
        entries.append(F.struct(*[text.alias(name) for name, text in texts.items()], F.coalesce(f"_{i}", F.lit(0)).alias("n")))
    return row.select(F.inline(F.array(*entries))).where("n > 0")


def is_counting() -> bool:
    """Whether the frame under construction is only counted."""
    return _COUNTING.get()


def stack(*feeds: DataFrame) -> DataFrame:
    """All issue feeds under one schema."""
    return reduce(lambda a, b: a.unionByName(b), feeds)


def conform(issues: DataFrame, module_key: str, module_label: str, source: str, route: str) -> DataFrame:
    """Bring a module's issues to the ten-column common schema."""
    return issues.select(
        F.lit(module_key).alias("module_key"),
        F.lit(module_label).alias("module_label"),
        F.lit(source).alias("source_mart"),
        "entity_id",
        "entity_name",
        "issue_type",
        "description",
        "severity",
        "recommended_action",
        F.lit(route).alias("route_path"),
    )


# Severity labels by lower-case spelling (fixed values).
SEVERITIES = {"critical": "Critical", "warning": "Warning", "info": "Info"}


def normal_severity(severity: Column | str) -> Column:
    text = F.lower(F.trim(as_col(severity)))
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for raw, label in SEVERITIES.items():
        chain = chain.when(text == raw, label)
    return chain.otherwise("Unknown")


def count_issues(issues: DataFrame) -> DataFrame:
    """One row for each rule that fired, with the number n of its issues."""
    number = F.sum("n") if "n" in issues.columns else F.count(F.lit(1))
    return issues.groupBy("issue_type", "severity", "recommended_action").agg(number.alias("n"))


def summarise(issues: DataFrame, number: Column | None = None) -> DataFrame:
    """Issue counts per module, severity and type; ``number`` is the count a row stands for (one if not given)."""
    counted = F.count(F.lit(1)) if number is None else F.sum(number)
    return issues.groupBy("module_key", "module_label", "severity", "issue_type").agg(
        counted.alias("exception_count"),
        F.max("recommended_action").alias("recommended_action"),
        F.max("source_mart").alias("source_mart"),
        F.max("route_path").alias("route_path"),
    )
