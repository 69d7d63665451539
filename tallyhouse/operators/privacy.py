"""Masking, role views, suppression, pattern scans, retention and access records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import as_col
from tallyhouse.operators.identity import surrogate_id

# Replacement texts (fixed values).
FULL_REDACTION = "[REDACTED_FINANCIAL_DETAIL]"

LEGAL_REDACTION = "[RESTRICTED_LEGAL_NARRATIVE]"

# Sensitive patterns looked for in free text (fixed values).
PATTERNS = {
    "national_id": r"\b[12]\d{9}\b",
    "iban": r"(?i)\bSA\d{22}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@(?!(?:example\.com|synthetic\.local)(?![A-Za-z0-9-]|\.[A-Za-z0-9]))[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
}

# Entities blanked inside narratives (fixed values).
ENTITIES = {
    "[EMAIL]": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "[MONEY]": r"\d[\d,]*(\.\d+)? ?SAR",
}

# Smallest group that may be shown (fixed value).
MIN_GROUP = 5


def mask_part(value: Column | str, visible: int = 4, pad: str = "*", keep: str = "left") -> Column:
    """Keep some characters at one end and pad over the rest; a value no longer than the visible part is hidden whole."""
    text = as_col(value).cast("string")
    stars = F.repeat(F.lit(pad), F.length(text) - visible)
    shown = F.concat(F.left(text, F.lit(visible)), stars) if keep == "left" else F.concat(stars, F.right(text, F.lit(visible)))
    return F.when(F.length(text) > visible, shown).otherwise(F.repeat(F.lit(pad), F.length(text)))


def pseudonym(name: Column | str, identity: Column | str) -> Column:
    """Initials of the name parts with the key in brackets: ``K.A. (EMP-0019)``."""
    parts = F.filter(F.split(F.trim(as_col(name)), " +"), lambda p: p != "")
    initials = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lit("."))), "")
    return F.concat(initials, F.lit(" ("), as_col(identity).cast("string"), F.lit(")"))


def redact_entities(text: Column | str) -> Column:
    result = as_col(text)
    for label, pattern in ENTITIES.items():
        result = F.regexp_replace(result, pattern, label)
    return result


def extend_tokens(keys: DataFrame, known: DataFrame, prefix: str = "SUCC-", digits: int = 4) -> DataFrame:
    """Key-to-token table with tokens for the keys not numbered before.

    Old tokens stay as they are; new keys continue after the highest number, so
    tokens are stable between runs and never collide.
    """
    name = known.columns[0]
    fresh = keys.where(F.col(name).isNotNull()).select(name).distinct().join(known.select(name), name, "left_anti")
    last = known.agg(F.coalesce(F.max("token_number"), F.lit(0)).alias("last")).first()["last"]
    numbered = surrogate_id(fresh, [name], "_position")
    added = numbered.select(name, (F.col("_position") + F.lit(last)).alias("token_number"))
    text = F.col("token_number").cast("string")
    padded = F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text)
    return known.select(name, "token_number").unionByName(added).withColumn("token", F.concat(F.lit(prefix), padded))


def aggregate_only(df: DataFrame, keys: Sequence[str], measure: Column, name: str, minimum: int = MIN_GROUP) -> DataFrame:
    """A measure per group, hidden where the group is too small."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), measure.alias("_m")).select(
        *keys, "group_size", F.when(F.col("group_size") >= minimum, F.col("_m")).alias(name)
    )


# How a field is masked where a role sees it masked (fixed values): a function of value and key.
# Person names inside narratives are not recognised; addresses and amounts are.
FIELD_MASKS = {
    "national_id_number": lambda value, key: mask_part(value),
    "employee_name": lambda value, key: pseudonym(value, key),
    "bank_account_iban": lambda value, key: F.lit(FULL_REDACTION),
    "gross_salary": lambda value, key: F.lit(None).cast("double"),
    "disciplinary_cases_description": lambda value, key: redact_entities(value),
    "investigation_notes": lambda value, key: F.lit(LEGAL_REDACTION),
}

# Field visibility by role (fixed values); a field that is not named is hidden.
ROLE_FIELDS: dict[str, dict[str, str]] = {
    "admin_system": {
        "employee_name": "Full", "national_id_number": "Masked", "passport_number": "Hidden", "basic_salary": "Full",
        "deductions": "Full", "bank_account_iban": "Hidden", "successor_employee_key": "Pseudonymized", "disciplinary_cases_description": "Full",
    },
    "hr_executive": {
        "employee_name": "Full", "national_id_number": "Masked", "passport_number": "Hidden", "basic_salary": "Full",
        "deductions": "Full", "bank_account_iban": "Hidden", "successor_employee_key": "Pseudonymized", "disciplinary_cases_description": "Full",
    },
    "hr_operations_manager": {
        "employee_name": "Full", "national_id_number": "Masked", "passport_number": "Hidden", "basic_salary": "Hidden",
        "deductions": "Hidden", "bank_account_iban": "Hidden", "successor_employee_key": "Hidden", "disciplinary_cases_description": "Hidden",
    },
    "payroll_manager": {
        "employee_name": "Masked", "national_id_number": "Masked", "passport_number": "Hidden", "basic_salary": "Full",
        "deductions": "Full", "bank_account_iban": "Hidden", "successor_employee_key": "Hidden", "disciplinary_cases_description": "Hidden",
    },
    "employee_relations_manager": {
        "employee_name": "Full", "national_id_number": "Masked", "passport_number": "Hidden", "basic_salary": "Hidden",
        "deductions": "Hidden", "bank_account_iban": "Hidden", "successor_employee_key": "Hidden", "disciplinary_cases_description": "Full",
    },
    "recruitment_manager": {
        "employee_name": "Masked", "national_id_number": "Hidden", "passport_number": "Hidden", "basic_salary": "Hidden",
        "deductions": "Hidden", "bank_account_iban": "Hidden", "successor_employee_key": "Hidden", "disciplinary_cases_description": "Hidden",
    },
    "talent_manager": {
        "employee_name": "Masked", "national_id_number": "Hidden", "passport_number": "Hidden", "basic_salary": "Hidden",
        "deductions": "Hidden", "bank_account_iban": "Hidden", "successor_employee_key": "Pseudonymized", "disciplinary_cases_description": "Hidden",
    },
    "compliance_manager": {
        "employee_name": "Masked", "national_id_number": "Masked", "passport_number": "Hidden", "basic_salary": "Hidden",
        "deductions": "Hidden", "bank_account_iban": "Hidden", "successor_employee_key": "Hidden", "disciplinary_cases_description": "Hidden",
    },
    "project_manager": {
        "employee_name": "Hidden", "national_id_number": "Hidden", "passport_number": "Hidden", "basic_salary": "Hidden",
        "deductions": "Hidden", "bank_account_iban": "Hidden", "successor_employee_key": "Hidden", "disciplinary_cases_description": "Hidden",
    },
    "viewer_executive_aggregate_only": {
        "employee_name": "Hidden", "national_id_number": "Hidden", "passport_number": "Hidden", "basic_salary": "Aggregate",
        "deductions": "Aggregate", "bank_account_iban": "Hidden", "successor_employee_key": "Hidden", "disciplinary_cases_description": "Hidden",
    },
    "auditor_read_only": {
        "employee_name": "Masked", "national_id_number": "Masked", "passport_number": "Hidden", "basic_salary": "Full",
        "deductions": "Full", "bank_account_iban": "Hidden", "successor_employee_key": "Pseudonymized", "disciplinary_cases_description": "Full",
    },
}

# Export scope by role (fixed values).
EXPORT_SCOPE = {
    "admin_system": "Full Export",
    "hr_executive": "Full Export",
    "hr_operations_manager": "Masked Export",
    "payroll_manager": "Restricted Employee-Level Export",
    "employee_relations_manager": "Restricted Employee-Level Export",
    "recruitment_manager": "Department/Project Export",
    "talent_manager": "Restricted Employee-Level Export",
    "compliance_manager": "Department/Project Export",
    "project_manager": "No Export",
    "viewer_executive_aggregate_only": "Aggregate Export Only",
    "auditor_read_only": "Masked Export",
}


# Fields a role may not export besides (fixed values), and those nobody may.
EXPORT_RESTRICTED = {
    "admin_system": ("bank_account_iban", "passport_number"),
    "hr_executive": ("bank_account_iban", "passport_number"),
    "hr_operations_manager": ("gross_salary", "disciplinary_cases_description"),
    "payroll_manager": ("disciplinary_cases_description", "successor_employee_key"),
    "employee_relations_manager": ("gross_salary", "successor_employee_key"),
    "recruitment_manager": ("gross_salary", "disciplinary_cases_description"),
    "talent_manager": ("gross_salary", "disciplinary_cases_description"),
    "compliance_manager": ("gross_salary", "disciplinary_cases_description"),
    "auditor_read_only": ("bank_account_iban", "passport_number"),
}
NEVER_EXPORTED = ("national_id_number", "passport_number", "bank_account_iban")


def role_view(df: DataFrame, access: dict[str, str], key: str, public: Sequence[str] = ()) -> DataFrame:
    """The columns a role may see, each shown as its access level says.

    The key and the ``public`` columns are shown; any other column without an
    access level is hidden. A masked field is masked as its own rule says.
    ``Hidden`` and ``Aggregate`` fields are not selected at all, so the scan
    does not read them; totals come from :func:`role_totals`.
    """
    columns = []
    for column in df.columns:
        level = "Full" if column == key or column in public else access.get(column, "Hidden")
        if level == "Full":
            columns.append(F.col(column))
        elif level == "Masked":
            mask = FIELD_MASKS.get(column, lambda value, _: mask_part(value))
            columns.append(mask(F.col(column), F.col(key)).alias(column))
        elif level == "Pseudonymized":
            columns.append(pseudonym(column, key).alias(column))
    return df.select(*columns)


def role_totals(df: DataFrame, access: dict[str, str], groups: Sequence[str], minimum: int = MIN_GROUP) -> DataFrame:
    """Totals of the fields a role may see in aggregate or in full, hidden where a group is smaller than ``minimum``."""
    numbers = [c for c, t in df.dtypes if access.get(c) in ("Aggregate", "Full") and t in ("double", "float", "int", "bigint") or t.startswith("decimal") and access.get(c) in ("Aggregate", "Full")]
    sums = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("group_size"), *[F.sum(c).alias(c) for c in numbers])
    shown = F.col("group_size") >= minimum
    return sums.select(*groups, "group_size", *[F.when(shown, F.round(c, 2)).alias(f"{c}_total") for c in numbers])


def export(df: DataFrame, role: str, key: str, groups: Sequence[str], public: Sequence[str] = ()) -> DataFrame:
    """What a role may take out: rows, masked rows, totals of large enough groups, or nothing."""
    scope, access = EXPORT_SCOPE[role], ROLE_FIELDS[role]
    barred = {*NEVER_EXPORTED, *EXPORT_RESTRICTED.get(role, ())}
    allowed = {c: level for c, level in access.items() if c not in barred}
    if scope == "No Export":
        return df.select(key).where("false")
    if scope in ("Aggregate Export Only", "Department/Project Export"):
        return role_totals(df, allowed, groups)
    if scope == "Masked Export":
        allowed = {c: "Masked" if level == "Full" and c in FIELD_MASKS else level for c, level in allowed.items()}
    return role_view(df, allowed, key, public)


def scan_text(df: DataFrame, key: str, text: str, patterns: dict[str, str] = PATTERNS) -> DataFrame:
    """Hits per document and sensitive pattern over the whole text."""
    entries = [
        F.struct(F.lit(n).alias("pattern"), F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).cast("bigint").alias("hits"))
        for n, p in patterns.items()
    ]
    return df.select(key, F.inline(F.array(*entries))).where("hits > 0")


def retention_due(df: DataFrame, when: Column | str, days: int, today: Column, holds: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Rows older than the retention period that no legal hold protects."""
    due = df.where(F.datediff(today, as_col(when)) > days)
    return due if holds is None else due.join(holds.select(key), key, "left_anti")


def evidence_result(df: DataFrame, key: str, required: Sequence[str], allowed: dict[str, Sequence[str]], fixed: dict[str, str], fields: str, restricted: Sequence[str]) -> DataFrame:
    """Pass or reject each record, with the reasons joined in a fixed order."""
    reasons = [F.when(F.col(c).isNull(), F.lit(f"missing field: {c}")) for c in required]
    reasons += [F.when(~F.coalesce(F.col(c).isin(list(v)), F.lit(False)), F.lit(f"invalid {c}")) for c, v in allowed.items()]
    reasons += [F.when(~F.coalesce(F.col(c) == v, F.lit(False)), F.lit(f"{c} must remain {v}")) for c, v in fixed.items()]
    hit = F.array_sort(F.array_intersect(F.col(fields), F.array(*[F.lit(r) for r in restricted])))
    reasons.append(F.when(F.size(hit) > 0, F.concat(F.lit("restricted fields present: "), F.array_join(hit, ", "))))
    found = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    return df.select(
        key,
        F.when(F.size(found) == 0, "pass").otherwise("reject").alias("result"),
        F.array_join(found, "; ").alias("reasons"),
    )
