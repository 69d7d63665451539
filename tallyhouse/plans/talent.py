"""Performance, learning, succession and talent-risk views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import is_blank, is_filled, percent, tally, total
from tallyhouse.operators.identity import surrogate_id
from tallyhouse.operators.relational import drop_members, keep_members, latest_record, side_by_side, with_member_flag, with_repeat_flag
from tallyhouse.operators.rules import Mark, flag_marked, flag_repeats, flag_rows, stack
from tallyhouse.plans.params import HIGH_RATINGS, LOW_RATINGS
from tallyhouse.plans.texts import TALENT
from tallyhouse.plans.warehouse import Warehouse, rule_from, view

# Sort keys of the row numbers of each source table.
RECORDS = {
    "base_performance_review_source_records": (
        "performance_reviews", "performance_review_record_id", ("review_id", "employee_id", "completed_date", "rating", "reviewer_id", "status", "review_period")),
    "base_performance_goal_source_records": ("performance_goals", "performance_goal_record_id", ("goal_id", "employee_id", "due_date")),
    "base_competency_source_records": (
        "competency_assessments", "competency_assessment_record_id",
        ("assessment_id", "employee_id", "competency_name", "assessed_date", "required_score", "actual_score")),
    "base_learning_source_records": ("learning_enrollments", "learning_enrollment_record_id", ("enrollment_id", "employee_id", "course_id", "enrollment_date")),
    "base_succession_source_records": ("succession_plans", "succession_plan_record_id", ("plan_id", "critical_role_id", "successor_employee_id")),
    "base_talent_review_source_records": ("talent_reviews", "talent_review_record_id", ("review_id", "employee_id", "performance_rating")),
    "base_employee_skill_source_records": ("employee_skills", "employee_skill_record_id", ("skill_id", "employee_id", "skill_name", "proficiency")),
}


def _define_records(name: str, table: str, number: str, order: tuple[str, ...]) -> None:
    @view(name)
    def records(wh: Warehouse) -> DataFrame:
        return surrogate_id(wh.table(table), order, number)


for _name, (_table, _number, _order) in RECORDS.items():
    _define_records(_name, _table, _number, _order)


def rating_text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(18,1)").cast("string")


@view("base_talent_employee_population")
def talent_population(wh: Warehouse) -> DataFrame:
    return wh.view("base_active_workforce").where(is_filled("employee_id")).select(
        "employee_id", "employee_name", "department", "project", "job_title", "status"
    )


def _store_shared(wh: Warehouse) -> None:
    """Frames that most branches of the KPI row and the rules read are stored once."""
    for name in ("base_talent_employee_population", "base_performance_reviews_current", "base_succession_plans_current"):
        wh.settle(name)


def _ids(wh: Warehouse) -> DataFrame:
    return wh.view("base_talent_employee_population").select("employee_id")


def _valid_reviews(wh: Warehouse) -> DataFrame:
    rating = F.col("rating")
    band = (
        F.when(rating >= 4.5, "Outstanding")
        .when(rating >= 3.5, "Exceeds Expectations")
        .when(rating >= 2.5, "Meets Expectations")
        .when(rating >= 1.5, "Needs Improvement")
        .otherwise("Unsatisfactory")
    )
    rows = wh.table("performance_reviews").where(
        (F.col("status") == "Completed") & rating.between(wh.rules.min_rating, wh.rules.max_rating)
    )
    return keep_members(rows, "employee_id", _ids(wh)).withColumn("performance_category", band)


def _latest_review(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last completed review; ties follow the record order backwards."""
    order = [F.desc_nulls_last("completed_date")]
    order += [F.desc_nulls_first(c) for c in ("review_id", "rating", "reviewer_id")]
    return latest_record(rows, keys, order)


@view("base_performance_reviews_current")
def performance_reviews_current(wh: Warehouse) -> DataFrame:
    return _latest_review(_valid_reviews(wh).where(F.col("review_period") == wh.talent_month.label), ["employee_id"])


@view("base_performance_goals_current")
def performance_goals_current(wh: Warehouse) -> DataFrame:
    return keep_members(wh.table("performance_goals").where("status is not null"), "employee_id", _ids(wh))


@view("base_competency_assessments_current")
def competency_assessments_current(wh: Warehouse) -> DataFrame:
    low, high = wh.rules.min_rating, wh.rules.max_rating
    valid = F.col("required_score").between(low, high) & F.col("actual_score").between(low, high)
    return keep_members(wh.table("competency_assessments").where(valid), "employee_id", _ids(wh))


@view("base_learning_enrollments_current")
def learning_enrollments_current(wh: Warehouse) -> DataFrame:
    rows = wh.table("learning_enrollments").where(F.col("enrollment_date") <= F.lit(wh.talent_month.end))
    return keep_members(rows, "employee_id", _ids(wh))


@view("base_training_catalog_current")
def training_catalog_current(wh: Warehouse) -> DataFrame:
    return wh.table("training_catalog")


@view("base_succession_plans_current")
def succession_plans_current(wh: Warehouse) -> DataFrame:
    return wh.table("succession_plans").where(F.col("is_critical") | F.col("role_title").isin(*wh.rules.critical_titles))


@view("base_talent_reviews_current")
def talent_reviews_current(wh: Warehouse) -> DataFrame:
    """Last talent review per employee in record order."""
    rows = keep_members(wh.table("talent_reviews"), "employee_id", _ids(wh))
    return latest_record(rows, ["employee_id"], [F.desc_nulls_first("review_id"), F.desc_nulls_first("performance_rating")])


@view("base_employee_skills_current")
def employee_skills_current(wh: Warehouse) -> DataFrame:
    return keep_members(wh.table("employee_skills"), "employee_id", _ids(wh))


@view("base_career_paths_current")
def career_paths_current(wh: Warehouse) -> DataFrame:
    return keep_members(wh.table("career_paths"), "employee_id", _ids(wh))


@view("mart_talent_exceptions")
def talent_exceptions(wh: Warehouse) -> DataFrame:
    _store_shared(wh)
    low, high = wh.rules.min_rating, wh.rules.max_rating
    ids = _ids(wh)

    def rule(issue, when, **slots):
        return rule_from(TALENT, issue, when, **slots)

    def outside(column: str) -> Column:
        return (F.col(column) < low) | (F.col(column) > high)

    def linked(rows: DataFrame, column: str = "employee_id") -> DataFrame:
        return with_member_flag(rows, column, ids, "known")

    stranger = F.col("employee_id").isNotNull() & ~F.col("known")

    def of_strangers(issue: str, **slots) -> Mark:
        return Mark(["employee_id"], lambda rows, _: linked(rows), [rule(issue, stranger, **slots)])

    plans = wh.view("base_succession_plans_current")
    named = is_filled("successor_employee_id")
    current_reviews = wh.view("base_performance_reviews_current")
    unreviewed = drop_members(wh.view("base_talent_employee_population"), "employee_id", current_reviews.select("employee_id"))
    inactive = wh.table("employees").where("status <> 'Active'").select("employee_id")
    risky = wh.view("base_talent_reviews_current").where("flight_risk = 'High'").select("employee_id")
    leading = current_reviews.where(F.col("performance_category").isin(*HIGH_RATINGS))
    critical = wh.view("base_talent_employee_population").where(F.col("job_title").isin(*wh.rules.critical_titles))
    uncovered = drop_members(critical, "employee_id", plans.where(named).select("current_employee_id"))
    no_hours = F.col("duration_hours").isNull() | (F.col("duration_hours") <= 0)
    return stack(
        flag_rows(unreviewed, [rule("Missing Performance Review", F.lit(True), month=F.lit(wh.talent_month.label))], "employee_id", None),
        flag_marked(
            wh.table("performance_reviews"),
            [
                of_strangers("Review Linked to Unknown Employee", entity_id="employee_id"),
                Mark(
                    ["review_id"],
                    lambda rows, weight: with_repeat_flag(rows, ["review_id"], "repeated", weight),
                    [rule("Duplicate Performance Review ID", F.col("repeated"))],
                ),
            ],
            [
                rule("Review Completed Without Rating", (F.col("status") == "Completed") & F.col("rating").isNull()),
                rule("Rating Outside Allowed Range", outside("rating"), rating=rating_text("rating"), low=F.lit(str(low)), high=F.lit(str(high))),
                rule("Review Missing Reviewer", is_blank("reviewer_id")),
            ],
            "review_id",
            None,
        ),
        flag_marked(
            wh.table("performance_goals"),
            [of_strangers("Goal Linked to Unknown Employee")],
            [
                rule("Goal Missing Status", is_blank("status")),
                rule("Goal Overdue", ~F.col("status").isin("Completed", "Cancelled") & (F.col("due_date") < F.lit(wh.talent_month.end))),
            ],
            "goal_id",
            None,
        ),
        flag_marked(
            wh.table("competency_assessments"),
            [of_strangers("Competency Linked to Unknown Employee")],
            [
                rule(
                    "Competency Score Outside Range",
                    outside("required_score") | outside("actual_score"),
                    required=rating_text("required_score"),
                    actual=rating_text("actual_score"),
                ),
            ],
            "assessment_id",
            None,
        ),
        flag_rows(
            linked(plans, "successor_employee_id"),
            [
                rule("Critical Role Missing Successor", ~named, entity_id="critical_role_id"),
                rule("Successor Linked to Unknown Employee", named & ~F.col("known"), entity_id="successor_employee_id"),
                rule("Successor Readiness Missing", named & is_blank("readiness")),
            ],
            "plan_id",
            None,
        ),
        flag_rows(
            plans.join(inactive, F.col("successor_employee_id") == F.col("employee_id")),
            [rule("Successor Assigned to Inactive Employee", F.lit(True))],
            "successor_employee_id",
            None,
        ),
        flag_marked(
            wh.table("learning_enrollments"),
            [of_strangers("Enrollment Linked to Unknown Employee")],
            [
                rule("Training Completed Without Date", (F.col("status") == "Completed") & F.col("completion_date").isNull()),
            ],
            "enrollment_id",
            None,
        ),
        flag_rows(
            wh.view("base_training_catalog_current"),
            [
                rule("Training Hours Missing or Invalid", no_hours, hours=F.coalesce(rating_text("duration_hours"), F.lit("NULL"))),
                rule("Learning Course Missing Category", is_blank("category")),
            ],
            "course_id",
            None,
        ),
        flag_rows(
            wh.table("talent_reviews"), [rule("Talent Review Missing Potential Rating", is_blank("potential_rating"))], "employee_id", None
        ),
        flag_rows(keep_members(leading, "employee_id", risky), [rule("High Performer With High Flight Risk", F.lit(True))], "employee_id", None),
        flag_rows(uncovered, [rule("Critical Employee Without Successor", F.lit(True))], "employee_id", None),
        flag_repeats(wh.table("employee_skills"), ["employee_id", "skill_name"], rule("Duplicate Skill Record", F.lit(True)), "employee_id"),
        flag_rows(wh.table("career_paths"), [rule("Career Path Missing Next Role", is_blank("next_role"))], "employee_id", None),
    )


def _valid_successor() -> Column:
    return is_filled("successor_employee_id") & F.col("known") & is_filled("readiness")


def _plans_with_flag(wh: Warehouse) -> DataFrame:
    return with_member_flag(wh.view("base_succession_plans_current"), "successor_employee_id", _ids(wh), "known")


def _learning(wh: Warehouse) -> DataFrame:
    catalog = wh.view("base_training_catalog_current").select("course_id", "category", "duration_hours")
    return wh.view("base_learning_enrollments_current").join(catalog, "course_id", "left")


def _done() -> Column:
    return F.col("status") == "Completed"


def _eligible() -> Column:
    return F.col("status") != "Cancelled"


def _done_hours() -> Column:
    return total(F.when(_done(), F.col("duration_hours")))


@view("mart_talent_kpis")
def talent_kpis(wh: Warehouse) -> DataFrame:
    _store_shared(wh)
    category = F.col("performance_category")
    roles = _plans_with_flag(wh)
    row = side_by_side(
        wh.view("base_talent_employee_population").agg(F.count(F.lit(1)).alias("people")),
        # One review per employee here, so plain counts are distinct counts.
        wh.view("base_performance_reviews_current").agg(
            F.count("employee_id").alias("reviewed"),
            F.round(F.avg("rating"), 2).alias("average_performance_rating"),
            tally(category.isin(*HIGH_RATINGS)).alias("high"),
            tally(category.isin(*LOW_RATINGS)).alias("low"),
        ),
        wh.view("base_performance_goals_current").agg(tally(_done()).alias("goals_done"), tally(_eligible()).alias("goals")),
        _learning(wh).agg(
            tally(_done()).alias("courses_done"),
            tally(_eligible()).alias("courses"),
            _done_hours().alias("hours"),
            F.count_distinct(F.when(_done(), F.col("employee_id"))).alias("trainees"),
        ),
        roles.groupBy("critical_role_id").agg(F.max(_valid_successor()).alias("covered")).where("critical_role_id is not null").agg(
            F.count(F.lit(1)).alias("roles"), tally(F.col("covered")).alias("covered")
        ),
        roles.where((F.col("readiness") == "Ready Now") & F.col("known")).agg(F.count_distinct("successor_employee_id").alias("ready")),
        wh.number_of_issues("mart_talent_exceptions", "issues"),
    )
    hours = F.when(F.col("trainees") == 0, 0.0).otherwise(F.round(F.col("hours") / F.nullif(F.col("trainees"), F.lit(0)), 2))
    return row.select(
        F.col("reviewed").cast("double").alias("employees_reviewed"),
        percent("reviewed", "people").alias("review_completion_pct"),
        "average_performance_rating",
        F.col("high").cast("double").alias("high_performers"),
        F.col("low").cast("double").alias("low_performers"),
        percent("goals_done", "goals").alias("goal_completion_pct"),
        percent("courses_done", "courses").alias("training_completion_pct"),
        hours.alias("average_training_hours"),
        percent("covered", "roles", 100.0).alias("critical_roles_covered_pct"),
        F.col("ready").cast("double").alias("ready_successors"),
        F.col("issues").cast("double").alias("talent_exception_count"),
    )


@view("mart_performance_distribution")
def performance_distribution(wh: Warehouse) -> DataFrame:
    return wh.view("base_performance_reviews_current").groupBy("performance_category").agg(F.count("employee_id").alias("employee_count"))


def _performance_by(wh: Warehouse, key: str) -> DataFrame:
    people = wh.view("base_talent_employee_population").select("employee_id", key)
    category = F.col("performance_category")
    return wh.view("base_performance_reviews_current").join(people, "employee_id").groupBy(key).agg(
        F.count("employee_id").alias("reviewed_count"),
        F.round(F.avg("rating"), 2).alias("average_rating"),
        tally(category.isin(*HIGH_RATINGS)).alias("high_performers"),
        tally(category.isin(*LOW_RATINGS)).alias("low_performers"),
    )


@view("mart_performance_by_project")
def performance_by_project(wh: Warehouse) -> DataFrame:
    return _performance_by(wh, "project")


@view("mart_performance_by_department")
def performance_by_department(wh: Warehouse) -> DataFrame:
    return _performance_by(wh, "department")


@view("mart_goal_completion")
def goal_completion(wh: Warehouse) -> DataFrame:
    people = wh.view("base_talent_employee_population").select("employee_id", "department")
    status = F.col("status")
    return (
        wh.view("base_performance_goals_current")
        .join(people, "employee_id", "left")
        .groupBy("department")
        .agg(
            tally(_done()).alias("completed_goals"),
            tally(status == "In Progress").alias("in_progress_goals"),
            tally(status == "Overdue").alias("overdue_goals"),
            tally(status == "Not Started").alias("not_started_goals"),
            tally(status == "Cancelled").alias("cancelled_goals"),
            tally(_eligible()).alias("eligible_goals"),
        )
        .withColumn("department", F.coalesce("department", F.lit("Unknown")))
    )


@view("mart_competency_gaps")
def competency_gaps(wh: Warehouse) -> DataFrame:
    return (
        wh.view("base_competency_assessments_current")
        .groupBy("competency_name")
        .agg(
            F.round(F.avg("required_score"), 2).alias("avg_required"),
            F.round(F.avg("actual_score"), 2).alias("avg_actual"),
            F.round(F.avg(F.col("required_score") - F.col("actual_score")), 2).alias("avg_gap"),
        )
        .orderBy(F.desc_nulls_last("avg_gap"), "competency_name")
    )


@view("mart_learning_completion")
def learning_completion(wh: Warehouse) -> DataFrame:
    return (
        _learning(wh)
        .groupBy("category")
        .agg(tally(_done()).alias("completed_enrollments"), tally(_eligible()).alias("eligible_enrollments"), _done_hours().alias("total_hours"))
        .withColumn("category", F.coalesce("category", F.lit("Uncategorized")))
    )


@view("mart_learning_by_project")
def learning_by_project(wh: Warehouse) -> DataFrame:
    people = wh.view("base_talent_employee_population").select("employee_id", "project", "department")
    return (
        _learning(wh)
        .join(people, "employee_id", "left")
        .groupBy("project", "department")
        .agg(tally(_done()).alias("completed_enrollments"), _done_hours().alias("total_hours"))
        .withColumn("project", F.coalesce("project", F.lit("Unassigned")))
        .withColumn("department", F.coalesce("department", F.lit("Unknown")))
    )


@view("mart_succession_coverage")
def succession_coverage(wh: Warehouse) -> DataFrame:
    valid = F.count_distinct(F.when(_valid_successor(), F.col("successor_employee_id")))
    return (
        _plans_with_flag(wh)
        .groupBy("critical_role_id", "role_title")
        .agg(valid.alias("valid_successor_count"))
        .withColumn("coverage_status", F.when(F.col("valid_successor_count") > 0, "Covered").otherwise("Not Covered"))
    )


@view("mart_successor_readiness")
def successor_readiness(wh: Warehouse) -> DataFrame:
    return (
        wh.view("base_succession_plans_current")
        .where(is_filled("successor_employee_id"))
        .groupBy("readiness")
        .agg(F.count_distinct("successor_employee_id").alias("successor_count"))
        .withColumn("readiness", F.coalesce("readiness", F.lit("Missing")))
    )


def risk_category(flight: Column, potential: Column, category: Column) -> Column:
    """Risk matrix of flight risk, potential and performance band; unknown inputs never raise the risk."""
    strong = category.isin(*HIGH_RATINGS)
    high = (flight == "High") & ((potential == "High") | strong)
    medium_flight = (flight == "Medium") & (potential.isin("High", "Medium") | strong | (category == "Meets Expectations"))
    medium = ((flight == "High") & (potential != "High") & ~strong) | medium_flight
    return F.when(high, "High Risk").when(medium, "Medium Risk").otherwise("Low Risk")


@view("mart_talent_risk")
def talent_risk(wh: Warehouse) -> DataFrame:
    reviews = wh.view("base_talent_reviews_current").select("employee_id", "potential_rating", "flight_risk")
    people = wh.view("base_talent_employee_population").select("employee_id", "department", "project")
    return (
        wh.view("base_performance_reviews_current")
        .select("employee_id", "performance_category")
        .join(reviews, "employee_id", "left")
        .join(people, "employee_id", "left")
        .select(
            "employee_id",
            F.coalesce("department", F.lit("Unknown")).alias("department"),
            F.coalesce("project", F.lit("Unassigned")).alias("project"),
            "performance_category",
            F.coalesce("potential_rating", F.lit("Unknown")).alias("potential_rating"),
            F.coalesce("flight_risk", F.lit("Unknown")).alias("flight_risk"),
            risk_category(F.col("flight_risk"), F.col("potential_rating"), F.col("performance_category")).alias("risk_category"),
        )
    )


@view("mart_talent_review_trends")
def talent_review_trends(wh: Warehouse) -> DataFrame:
    """Every review period: population, reviewed employees, completion share, average rating."""
    people = wh.view("base_talent_employee_population").agg(F.count(F.lit(1)).alias("total_reviewed"))
    periods = (
        _latest_review(_valid_reviews(wh), ["review_period", "employee_id"])
        .where(F.col("review_period") <= wh.talent_month.label)
        .groupBy(F.col("review_period").alias("period"))
        .agg(F.count("employee_id").alias("completed_reviews"), F.round(F.avg("rating"), 2).alias("avg_rating"))
    )
    return (
        periods.withColumn("total_reviewed", people.scalar())
        .select("period", "total_reviewed", "completed_reviews", percent("completed_reviews", "total_reviewed").alias("completion_pct"), "avg_rating")
        .orderBy("period")
    )
