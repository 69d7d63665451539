"""Declared schemas of the people tables (column types of the typed layer)."""

from __future__ import annotations

# Table layouts, in source column order (fixed values).
SCHEMAS: dict[str, str] = {
    "attendance": "attendance_date date, employee_id string, shift_name string, scheduled_start timestamp_ntz, scheduled_end timestamp_ntz, actual_check_in timestamp_ntz, actual_check_out timestamp_ntz, late_minutes bigint, excused_late_minutes bigint, net_late_minutes bigint, absence_days double, overtime_hours double, overtime_approved boolean, missing_punch_count bigint, project string",
    "candidates": "candidate_id string, candidate_name string, source string, pipeline_stage string, requisition_id string, applied_date date",
    "career_paths": "path_id string, employee_id string, current_role string, next_role string, readiness_months bigint",
    "competency_assessments": "assessment_id string, employee_id string, competency_name string, required_score double, actual_score double, assessed_date date",
    "compliance": "employee_id string, period string, qiwa_status string, gosi_status string, mudad_status string, contract_authenticated boolean, gosi_salary double, payroll_basic_salary double, occupation_code string, occupation_match_status string, work_permit_expiry date, iqama_expiry date, insurance_status string",
    "employee_relations": "case_id string, employee_id string, case_type string, case_status string, priority string, created_date date, target_due_date date, closed_date date, owner_id string, escalated boolean, escalation_reason string, legal_reference string, case_number string, description string",
    "employee_skills": "skill_id string, employee_id string, skill_name string, proficiency string",
    "employees": "employee_id string, employee_name string, nationality string, is_saudi boolean, company string, department string, project string, job_title string, job_family string, grade string, manager_id string, cost_center string, employment_type string, contract_type string, joining_date date, termination_date date, contract_end_date date, status string, basic_salary double, housing_allowance double, transport_allowance double",
    "hr_requests": "request_id string, employee_id string, request_type string, request_status string, created_at timestamp_ntz, closed_at timestamp_ntz, owner string, sla_hours bigint, actual_hours bigint, sla_breached boolean, project string",
    "interviews": "interview_id string, candidate_id string, interview_date timestamp_ntz, recruiter_id string, rating bigint, outcome string",
    "learning_enrollments": "enrollment_id string, employee_id string, course_id string, status string, enrollment_date date, completion_date date",
    "offers": "offer_id string, candidate_id string, offer_date date, salary double, outcome_status string, outcome_date date",
    "onboarding": "onboarding_id string, candidate_id string, start_date date, status string, employee_id string",
    "payroll": "payroll_period string, employee_id string, basic_salary double, housing_allowance double, transport_allowance double, other_allowances double, overtime_amount double, deductions double, gross_pay double, net_pay double, project string, cost_center string, payroll_status string",
    "performance_goals": "goal_id string, employee_id string, title string, status string, due_date date, completed_date date",
    "performance_reviews": "review_id string, employee_id string, reviewer_id string, review_period string, rating double, status string, completed_date date",
    "recruitment_requisitions": "requisition_id string, job_title string, department string, project string, cost_center string, owner_id string, approval_date date, target_hire_date date, closed_date date, status string",
    "succession_plans": "plan_id string, critical_role_id string, role_title string, current_employee_id string, successor_employee_id string, readiness string, flight_risk string, is_critical boolean",
    "talent_reviews": "review_id string, employee_id string, performance_rating double, potential_rating string, flight_risk string, retention_risk string",
    "training_catalog": "course_id string, course_name string, category string, duration_hours double",
    "vacancy_requests": "request_id string, department string, project string, job_title string, quantity bigint, status string, approved_date date",
    "workforce_plan": "period string, project string, department string, planned_headcount bigint",
}


def columns(name: str) -> list[tuple[str, str]]:
    """(column, type) pairs of a table."""
    return [tuple(field.split(" ")) for field in SCHEMAS[name].split(", ")]


ISSUE_SCHEMA = (
    "employee_id string, employee_name string, issue_type string, description string, severity string, recommended_action string"
)
MODULE_CHECK_SCHEMA = (
    "module_key string, api_health_status string, reconciliation_status string, required_marts_present boolean, page_render_status string, last_checked_at timestamp"
)

# Tables whose views read one month or day at a time, and the column that names it.
PARTITIONS = {"payroll": "payroll_period", "compliance": "period", "attendance": "attendance_date"}

# Tables a production refresh cannot run without.
CORE_TABLES = ("employees", "payroll", "attendance")
