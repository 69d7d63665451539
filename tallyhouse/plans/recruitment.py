"""Requisition, candidate, offer, onboarding and workforce-plan views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import is_blank, percent, tally, whole
from tallyhouse.operators.identity import surrogate_id
from tallyhouse.operators.relational import latest_record, side_by_side, with_member_flag
from tallyhouse.operators.rules import Mark, flag_marked, flag_repeats, flag_rows, stack
from tallyhouse.plans.params import OPEN_REQUISITION, VOID_REQUISITION
from tallyhouse.plans.texts import RECRUITMENT
from tallyhouse.plans.warehouse import Warehouse, rule_from, view

# Only the *_source_records views carry row numbers: numbering needs a global
# sort, and every later view needs the order of the records, not the number.


def _requisitions(wh: Warehouse) -> DataFrame:
    return wh.table("recruitment_requisitions").select(
        "requisition_id", "job_title", "department", "project", "cost_center", F.col("owner_id").alias("recruiter_id"),
        "approval_date", "target_hire_date", "closed_date", "status",
    )


def _raw_candidates(wh: Warehouse) -> DataFrame:
    return wh.table("candidates").select(
        "candidate_id", "candidate_name", F.col("source").alias("raw_source"), "pipeline_stage", "requisition_id", "applied_date"
    )


def _with_source(wh: Warehouse, candidates: DataFrame) -> DataFrame:
    known = F.col("raw_source").isin(*wh.rules.source_channels)
    return candidates.select(
        "candidate_id", "candidate_name", F.when(known, F.col("raw_source")).otherwise("Other").alias("source"),
        "raw_source", "pipeline_stage", "requisition_id", "applied_date",
    )


def _candidates(wh: Warehouse) -> DataFrame:
    return _with_source(wh, _raw_candidates(wh))


def _interviews(wh: Warehouse) -> DataFrame:
    return wh.table("interviews").select(
        "interview_id", "candidate_id", "interview_date", F.col("recruiter_id").alias("interviewer_id"), "rating", "outcome"
    )


def _offers(wh: Warehouse) -> DataFrame:
    return wh.table("offers").select(
        "offer_id", "candidate_id", "offer_date", "salary", F.col("outcome_status").alias("offer_status"), "outcome_date"
    )


def _onboarding(wh: Warehouse) -> DataFrame:
    return wh.table("onboarding").select(
        "onboarding_id", "candidate_id", F.col("start_date").alias("hire_date"), "status", "employee_id"
    )


@view("base_requisition_source_records")
def requisition_source_records(wh: Warehouse) -> DataFrame:
    order = ["requisition_id", "job_title", "department", "project", "cost_center", "recruiter_id", "approval_date", "status", "target_hire_date", "closed_date"]
    return surrogate_id(_requisitions(wh), order, "requisition_record_id")


@view("base_candidate_source_records")
def candidate_source_records(wh: Warehouse) -> DataFrame:
    order = ["candidate_id", "candidate_name", "requisition_id", "applied_date", "raw_source", "pipeline_stage"]
    return surrogate_id(_candidates(wh), order, "candidate_record_id")


@view("base_interview_source_records")
def interview_source_records(wh: Warehouse) -> DataFrame:
    order = ["interview_id", "candidate_id", "interview_date", "interviewer_id", "rating", "outcome"]
    return surrogate_id(_interviews(wh), order, "interview_record_id")


@view("base_offer_source_records")
def offer_source_records(wh: Warehouse) -> DataFrame:
    return surrogate_id(_offers(wh), ["offer_id", "candidate_id", "offer_date"], "offer_record_id")


@view("base_onboarding_source_records")
def onboarding_source_records(wh: Warehouse) -> DataFrame:
    return surrogate_id(_onboarding(wh), ["onboarding_id", "candidate_id", "hire_date"], "onboarding_record_id")


def _open() -> Column:
    return F.col("status").isin(*OPEN_REQUISITION)


def _alive(start: Column, end: Column) -> Column:
    """Approved by the end of a month and open, closed or approved in it."""
    return (
        (F.col("approval_date") <= end)
        & ~F.col("status").isin(*VOID_REQUISITION)
        & (_open() | (F.col("closed_date") >= start) | F.col("approval_date").between(start, end))
    )


def _target(wh: Warehouse) -> Column:
    return F.coalesce("target_hire_date", F.date_add("approval_date", wh.rules.hire_sla_days))


@view("base_recruitment_requisitions_current")
def requisitions_current(wh: Warehouse) -> DataFrame:
    month = wh.hiring_month
    return _requisitions(wh).where(_alive(F.lit(month.start), F.lit(month.end))).withColumn("effective_target_hire_date", _target(wh))


@view("base_candidate_canonical")
def candidate_canonical(wh: Warehouse) -> DataFrame:
    """Latest application per candidate; ties follow the record order."""
    later = [F.desc_nulls_last("applied_date")]
    later += [F.desc_nulls_first(c) for c in ("candidate_name", "requisition_id", "raw_source", "pipeline_stage")]
    return _with_source(wh, latest_record(_raw_candidates(wh), ["candidate_id"], later))


@view("base_candidate_pipeline_current")
def candidate_pipeline_current(wh: Warehouse) -> DataFrame:
    current = wh.view("base_recruitment_requisitions_current").select("requisition_id")
    applied = wh.view("base_candidate_canonical").where(F.col("applied_date") <= F.lit(wh.hiring_month.end))
    return applied.join(current, "requisition_id").select(*applied.columns)


def _applications(wh: Warehouse) -> DataFrame:
    """Canonical applications for current requisitions, in the few columns that others are joined to, stored once."""

    def build() -> DataFrame:
        candidates = wh.view("base_candidate_canonical").select("candidate_id", "requisition_id", "applied_date")
        current = wh.view("base_recruitment_requisitions_current").select(
            "requisition_id", "approval_date", F.col("department").alias("req_department"), F.col("project").alias("req_project")
        )
        return candidates.join(current, "requisition_id")

    return wh.stored("current applications", build)


def _linked(wh: Warehouse, records: DataFrame) -> DataFrame:
    """Records of candidates whose canonical application is for a current requisition."""
    return records.join(_applications(wh).drop("applied_date"), "candidate_id")


def _in_pipeline(wh: Warehouse) -> DataFrame:
    """The rows of the candidate pipeline in the columns of the applications."""
    return _applications(wh).where(F.col("applied_date") <= F.lit(wh.hiring_month.end))


def _store_shared(wh: Warehouse) -> None:
    """Frames that most branches of the KPI row and the rules read are stored once."""
    for name in ("base_candidate_canonical", "base_recruitment_requisitions_current"):
        wh.settle(name)


def _in_month(wh: Warehouse, column: str) -> Column:
    return F.to_date(column).between(F.lit(wh.hiring_month.start), F.lit(wh.hiring_month.end))


@view("base_interview_activity_current")
def interview_activity_current(wh: Warehouse) -> DataFrame:
    records = _interviews(wh).where(_in_month(wh, "interview_date"))
    return _linked(wh, records).select(*records.columns)


@view("base_offer_activity_current")
def offer_activity_current(wh: Warehouse) -> DataFrame:
    records = _offers(wh).where(_in_month(wh, "offer_date"))
    return _linked(wh, records).select(*records.columns)


@view("base_onboarding_current")
def onboarding_current(wh: Warehouse) -> DataFrame:
    records = _onboarding(wh).where(_in_month(wh, "hire_date"))
    return _linked(wh, records).select(*records.columns)


@view("base_workforce_plan_current")
def workforce_plan_current(wh: Warehouse) -> DataFrame:
    return wh.table("workforce_plan").where(F.col("period") == wh.hiring_month.label)


@view("base_vacancy_population")
def vacancy_population(wh: Warehouse) -> DataFrame:
    return wh.table("vacancy_requests").where((F.col("status") == "Approved") & (F.col("approved_date") <= F.lit(wh.hiring_month.end)))


def _plan_with_actual(wh: Warehouse) -> DataFrame:
    actual = wh.view("base_active_workforce").groupBy("project", "department").agg(F.count(F.lit(1)).alias("_n"))
    plan = wh.view("base_workforce_plan_current")
    return plan.join(actual, ["project", "department"], "left").withColumn("actual_headcount", F.coalesce("_n", F.lit(0))).drop("_n")


@view("mart_recruitment_exceptions")
def recruitment_exceptions(wh: Warehouse) -> DataFrame:
    _store_shared(wh)
    end = F.lit(wh.hiring_month.end)

    def rule(issue, when, **slots):
        return rule_from(RECRUITMENT, issue, when, **slots)

    source = _requisitions(wh)
    pipeline = _in_pipeline(wh).select("requisition_id")
    current = with_member_flag(wh.view("base_recruitment_requisitions_current"), "requisition_id", pipeline, "has_candidates")
    candidates = _raw_candidates(wh)
    offers = with_member_flag(_offers(wh), "candidate_id", _onboarding(wh).select("candidate_id"), "onboarded")
    master = wh.table("employees").select("employee_id")
    channel = ~F.col("raw_source").isin(*wh.rules.source_channels)
    if wh.rules.null_channel_is_unknown:
        channel = channel | F.col("raw_source").isNull()
    unassigned = F.lit("Unassigned")
    plan_key = F.concat(F.coalesce("project", unassigned), F.lit("-"), F.coalesce("department", unassigned))
    actual, planned = F.col("actual_headcount"), F.col("planned_headcount")
    return stack(
        flag_rows(
            current,
            [
                rule("Missing Recruiter", _open() & is_blank("recruiter_id")),
                rule("Missing Project", _open() & (F.col("project").isNull() | (F.col("project") == unassigned))),
                rule("Missing Department", _open() & (F.col("department").isNull() | (F.col("department") == unassigned))),
                rule("Missing Cost Center", _open() & is_blank("cost_center")),
                rule("Missing Job Title", _open() & is_blank("job_title")),
                rule("Missing Target Hire Date", _open() & F.col("target_hire_date").isNull()),
                rule("Overdue Requisition", _open() & (end > F.col("effective_target_hire_date")), due="effective_target_hire_date"),
                rule("Empty Candidate Pipeline", _open() & F.col("requisition_id").isNotNull() & ~F.col("has_candidates")),
            ],
            "requisition_id",
            None,
        ),
        flag_rows(
            wh.view("base_candidate_canonical"), [rule("Missing Pipeline Stage", is_blank("pipeline_stage"))], "candidate_id", None
        ),
        # Three passes, each with the columns it needs: the rows of a candidate are not exchanged to be told apart.
        flag_marked(
            candidates,
            [
                Mark(
                    ["requisition_id"],
                    lambda rows, _: with_member_flag(rows, "requisition_id", source.select("requisition_id"), "known_requisition"),
                    [rule("Unknown Requisition Link", F.col("requisition_id").isNotNull() & ~F.col("known_requisition"))],
                )
            ],
            [],
            "candidate_id",
            None,
        ),
        flag_repeats(candidates, ["candidate_id"], rule("Duplicate Candidate ID", F.lit(True)), "candidate_id"),
        flag_rows(
            candidates, [rule("Unknown Source Channel", channel, raw_source=F.coalesce("raw_source", F.lit("NULL")))], "candidate_id", None
        ),
        flag_rows(
            _interviews(wh),
            [rule("Missing Interviewer", is_blank("interviewer_id")), rule("Missing Interview Date", F.col("interview_date").isNull())],
            "interview_id",
            None,
        ),
        flag_rows(
            offers,
            [
                rule("Offer Missing Salary", F.col("salary").isNull() | (F.col("salary") <= 0)),
                rule("Onboarding Not Triggered", (F.col("offer_status") == "Accepted") & F.col("candidate_id").isNotNull() & ~F.col("onboarded")),
            ],
            "offer_id",
            None,
        ),
        flag_marked(
            _onboarding(wh),
            [
                Mark(
                    ["employee_id"],
                    lambda rows, _: with_member_flag(rows, "employee_id", master, "known_employee"),
                    [rule("Unknown Employee ID", F.col("employee_id").isNotNull() & ~F.col("known_employee"))],
                )
            ],
            [],
            "onboarding_id",
            None,
        ),
        flag_repeats(source, ["requisition_id"], rule("Duplicate Requisition ID", F.lit(True)), "requisition_id"),
        flag_rows(
            _plan_with_actual(wh),
            [
                rule("Missing Plan Dimension", is_blank("project") | is_blank("department"), entity_id=F.lit("Plan_Row")),
                rule("Plan Exceeded", actual > planned, actual=actual, planned=planned),
                rule("Plan Unfulfilled", actual < planned, actual=actual, planned=planned, target=F.lit(str(wh.hiring_month.end))),
            ],
            plan_key,
            None,
        ),
        flag_rows(
            wh.view("base_vacancy_population"),
            [rule("Invalid Vacancy Quantity", F.col("quantity").isNull() | (F.col("quantity") <= 0), quantity=F.coalesce(F.col("quantity").cast("string"), F.lit("NULL")))],
            "request_id",
            None,
        ),
    )


def _hires(wh: Warehouse) -> DataFrame:
    linked = _linked(wh, _onboarding(wh).where(F.col("hire_date").isNotNull())).where(F.col("approval_date").isNotNull())
    return linked.withColumn("days_to_fill", F.datediff("hire_date", "approval_date"))


@view("mart_recruitment_kpis")
def recruitment_kpis(wh: Warehouse) -> DataFrame:
    _store_shared(wh)
    end = F.lit(wh.hiring_month.end)
    # Actual headcount on planned pairs; a repeated plan row counts its people again, as the plan total does.
    fulfilled = _plan_with_actual(wh).agg(whole("planned_headcount").alias("planned"), whole("actual_headcount").alias("actual"))
    offers = wh.view("base_offer_activity_current").agg(
        F.count(F.lit(1)).alias("offers_extended"),
        tally(F.col("offer_status") == "Accepted").alias("accepted"),
        tally(F.col("offer_status").isin("Accepted", "Rejected", "Declined")).alias("decided"),
    )
    row = side_by_side(
        wh.view("base_recruitment_requisitions_current").agg(
            tally(_open()).alias("open_requisitions"),
            tally(_open() & (end > F.col("effective_target_hire_date"))).alias("overdue_requisitions"),
        ),
        wh.view("base_vacancy_population").agg(whole("quantity").alias("approved_vacancies")),
        _in_pipeline(wh).agg(F.count(F.lit(1)).alias("candidates_in_pipeline")),
        wh.view("base_interview_activity_current").agg(F.count(F.lit(1)).alias("interviews_scheduled")),
        offers,
        wh.view("base_onboarding_current").agg(F.count(F.lit(1)).alias("hires_this_month")),
        _hires(wh).agg(F.coalesce(F.round(F.avg("days_to_fill"), 1), F.lit(0.0)).alias("average_time_to_fill")),
        fulfilled,
        wh.number_of_issues("mart_recruitment_exceptions", "recruitment_exception_count"),
    )
    no_plan = F.when(F.col("actual") == 0, 100.0).otherwise(0.0)
    return row.select(
        "open_requisitions", "approved_vacancies", "candidates_in_pipeline", "interviews_scheduled", "offers_extended",
        percent("accepted", "decided", 100.0).alias("offer_acceptance_pct"),
        "hires_this_month", "average_time_to_fill", "overdue_requisitions",
        F.when(F.col("planned") == 0, no_plan).otherwise(percent("actual", "planned")).alias("workforce_plan_fulfillment_pct"),
        "recruitment_exception_count",
    )


@view("mart_recruitment_pipeline")
def recruitment_pipeline(wh: Warehouse) -> DataFrame:
    return wh.view("base_candidate_pipeline_current").groupBy("pipeline_stage").agg(F.count(F.lit(1)).alias("candidate_count"))


@view("mart_recruitment_trends")
def recruitment_trends(wh: Warehouse) -> DataFrame:
    """Requisition lines opened and hires per month up to the report month.

    A requisition counts once per linked candidate line (at least once), as the
    requisition-candidate-hire chain does; the lines are counted per requisition
    before the join, so the chain itself is not expanded.
    """
    end = F.lit(wh.hiring_month.end)
    requisitions = _requisitions(wh).where((F.col("approval_date") <= end) & ~F.col("status").isin(*VOID_REQUISITION))
    # Read by the lines of a requisition and by the hires: a candidate with several hires has a row for each, one without has one.
    chain = wh.stored(
        "hires of candidates",
        lambda: wh.view("base_candidate_canonical")
        .select("candidate_id", "requisition_id")
        .join(_onboarding(wh).select("candidate_id", "hire_date"), "candidate_id", "left")
        .groupBy("requisition_id", "hire_date")
        .agg(F.count(F.lit(1)).alias("n")),
    )
    lines = chain.groupBy("requisition_id").agg(F.sum("n").alias("lines"))
    opened = (
        requisitions.join(lines, "requisition_id", "left")
        .groupBy(F.date_format("approval_date", "yyyy-MM").alias("period"))
        .agg(F.sum(F.coalesce("lines", F.lit(1))).alias("opened"), F.lit(0).cast("bigint").alias("hired"))
    )
    month_start, month_end = F.trunc("hire_date", "month"), F.last_day("hire_date")
    hired = (
        chain.where(F.col("hire_date") <= end)
        .join(requisitions, "requisition_id")
        .where(_alive(month_start, month_end))
        .groupBy(F.date_format("hire_date", "yyyy-MM").alias("period"))
        .agg(F.lit(0).cast("bigint").alias("opened"), F.sum("n").alias("hired"))
    )
    return (
        opened.unionByName(hired)
        .groupBy("period")
        .agg(F.sum("opened").alias("requisitions_opened"), F.sum("hired").alias("hires"))
        .orderBy("period")
    )


def _requisitions_by(wh: Warehouse, key: str) -> DataFrame:
    """Overdue is judged at the report month end, as in the KPI row."""
    late = F.col("effective_target_hire_date") < F.lit(wh.hiring_month.end)
    return wh.view("base_recruitment_requisitions_current").groupBy(key).agg(
        F.count(F.lit(1)).alias("total_requisitions"),
        tally(_open()).alias("open_requisitions"),
        tally(F.col("status").isin("Closed", "Filled")).alias("closed_requisitions"),
        tally(late & _open()).alias("overdue_requisitions"),
    )


@view("mart_recruitment_by_project")
def recruitment_by_project(wh: Warehouse) -> DataFrame:
    return _requisitions_by(wh, "project")


@view("mart_recruitment_by_department")
def recruitment_by_department(wh: Warehouse) -> DataFrame:
    return _requisitions_by(wh, "department")


@view("mart_recruitment_time_to_fill")
def recruitment_time_to_fill(wh: Warehouse) -> DataFrame:
    return (
        _hires(wh)
        .groupBy(F.col("req_department").alias("department"), F.col("req_project").alias("project"))
        .agg(F.coalesce(F.round(F.avg("days_to_fill"), 1), F.lit(0.0)).alias("average_time_to_fill"), F.count(F.lit(1)).alias("hire_count"))
    )


@view("mart_recruitment_source_effectiveness")
def recruitment_source_effectiveness(wh: Warehouse) -> DataFrame:
    hired = tally(F.col("pipeline_stage") == "Hired")
    return wh.view("base_candidate_pipeline_current").groupBy("source").agg(
        F.count(F.lit(1)).alias("candidate_count"), hired.alias("hire_count"), percent(hired, F.count(F.lit(1))).alias("conversion_pct")
    )


@view("mart_offer_acceptance")
def offer_acceptance(wh: Warehouse) -> DataFrame:
    return wh.view("base_offer_activity_current").groupBy("offer_status").agg(F.count(F.lit(1)).alias("offer_count"))


@view("mart_onboarding_status")
def onboarding_status(wh: Warehouse) -> DataFrame:
    return wh.view("base_onboarding_current").groupBy(F.col("status").alias("onboarding_status")).agg(F.count(F.lit(1)).alias("hire_count"))


@view("mart_workforce_plan_vs_actual")
def workforce_plan_vs_actual(wh: Warehouse) -> DataFrame:
    no_plan = F.when(F.col("actual_headcount") == 0, 100.0).otherwise(0.0)
    share = F.when(F.col("planned_headcount") == 0, no_plan).otherwise(percent("actual_headcount", "planned_headcount"))
    return _plan_with_actual(wh).select("project", "department", "planned_headcount", "actual_headcount", share.alias("fulfillment_pct"))
