"""Hand-made people tables for June 2026 in which every exception rule has a row to find."""

from __future__ import annotations

from datetime import date, datetime

from tallyhouse.sources.schemas import SCHEMAS, columns


def d(text: str) -> date:
    return date.fromisoformat(text)


def t(text: str) -> datetime:
    return datetime.fromisoformat(text)


DEFAULTS = {
    "employees": dict(
        nationality="India", is_saudi=False, company="Co", department="Ops", project="P1", job_title="Analyst", job_family="F", grade="G1", manager_id="E1",
        cost_center="CC1", employment_type="Full Time", contract_type="Fixed", joining_date=d("2024-01-01"), contract_end_date=d("2027-12-31"), status="Active",
        basic_salary=5000.0, housing_allowance=1000.0, transport_allowance=500.0,
    ),
    "payroll": dict(
        payroll_period="2026-06", basic_salary=5000.0, housing_allowance=1000.0, transport_allowance=500.0, other_allowances=0.0, overtime_amount=0.0, deductions=500.0,
        gross_pay=6500.0, net_pay=6000.0, project="P1", cost_center="CC1", payroll_status="Paid",
    ),
    "attendance": dict(
        shift_name="Day", late_minutes=0, excused_late_minutes=0, net_late_minutes=0, absence_days=0.0, overtime_hours=0.0, overtime_approved=False, missing_punch_count=0, project="P1",
    ),
    "compliance": dict(
        period="2026-06", qiwa_status="Active", gosi_status="Registered", mudad_status="Compliant", contract_authenticated=True, gosi_salary=5000.0, payroll_basic_salary=5000.0,
        occupation_code="1", occupation_match_status="Matched", work_permit_expiry=d("2027-06-30"), iqama_expiry=d("2027-06-30"), insurance_status="Active",
    ),
    "employee_relations": dict(
        employee_id="E1", case_type="Grievance", case_status="Open", priority="High", created_date=d("2026-06-20"), target_due_date=d("2026-07-20"), owner_id="E1", escalated=False,
        legal_reference="L", case_number="N", description="x",
    ),
    "recruitment_requisitions": dict(
        job_title="Clerk", department="Ops", project="P1", cost_center="CC1", owner_id="E1", approval_date=d("2026-06-05"), target_hire_date=d("2026-08-01"), status="Open",
    ),
    "candidates": dict(candidate_name="C", source="LinkedIn", pipeline_stage="Applied", requisition_id="Q1", applied_date=d("2026-06-10")),
    "interviews": dict(candidate_id="K1", interview_date=t("2026-06-15 10:00:00"), recruiter_id="E1", rating=3, outcome="Passed"),
    "offers": dict(offer_date=d("2026-06-16"), salary=1000.0, outcome_status="Pending"),
    "onboarding": dict(start_date=d("2026-06-20"), status="Completed", employee_id="E1"),
    "performance_reviews": dict(reviewer_id="E1", review_period="2026-06", rating=4.0, status="Completed", completed_date=d("2026-06-10")),
    "performance_goals": dict(employee_id="E1", title="G", status="Completed", due_date=d("2026-06-01")),
    "competency_assessments": dict(employee_id="E1", competency_name="SQL", required_score=4.0, actual_score=3.0, assessed_date=d("2026-06-01")),
    "learning_enrollments": dict(employee_id="E1", course_id="T1", status="Completed", enrollment_date=d("2026-05-01"), completion_date=d("2026-06-01")),
    "training_catalog": dict(course_name="Course", category="Tech", duration_hours=8.0),
    "succession_plans": dict(critical_role_id="R1", role_title="Head", current_employee_id="E1", successor_employee_id="E2", readiness="Ready Now", flight_risk="Low", is_critical=True),
    "talent_reviews": dict(performance_rating=4.0, potential_rating="High", flight_risk="Low", retention_risk="Low"),
    "employee_skills": dict(employee_id="E1", skill_name="SQL", proficiency="High"),
    "career_paths": dict(employee_id="E1", current_role="Clerk", next_role="Manager", readiness_months=6),
    "vacancy_requests": dict(department="Ops", project="P1", job_title="Clerk", quantity=2, status="Approved", approved_date=d("2026-06-01")),
    "workforce_plan": dict(period="2026-06", project="P1", department="Ops", planned_headcount=3),
    "hr_requests": dict(employee_id="E1", request_type="Letter", request_status="Closed", created_at=t("2026-06-02 09:00:00"), closed_at=t("2026-06-04 09:00:00"), owner="E1", sla_hours=48, actual_hours=40, sla_breached=False),
}


def shift(employee: str, day: str, start: str | None, end: str | None, **more) -> dict:
    return dict(
        employee_id=employee, attendance_date=d(day), scheduled_start=t(f"{day} 08:00:00"), scheduled_end=t(f"{day} 17:00:00"),
        actual_check_in=t(f"{day} {start}") if start else None, actual_check_out=t(f"{day} {end}") if end else None, **more,
    )


ROWS = {
    "employees": [
        dict(employee_id="E1", employee_name="Sara Ali", nationality="Saudi Arabia", is_saudi=True, manager_id="E2", job_title="HR Manager"),
        dict(employee_id="E2", employee_name="Omar Noor", manager_id=None),
        dict(employee_id="E3", employee_name="Lina", project=""),
        dict(employee_id="E4", employee_name="Huda", cost_center=None),
        dict(employee_id="E5", employee_name="Ziad", nationality="", project=None),
        dict(employee_id="E6", employee_name="Adam", joining_date=d("2025-01-01")),
        dict(employee_id="E6", employee_name="Adam Copy", joining_date=d("2023-01-01"), status="Inactive"),
        dict(employee_id="E7", employee_name="Mona", contract_end_date=d("2026-07-15")),
        dict(employee_id="E8", employee_name="Ravi"),
        dict(employee_id="E9", employee_name="Gone", status="Terminated", termination_date=d("2026-06-10")),
        dict(employee_id="E10", employee_name="Idle", status="Inactive"),
        dict(employee_id="E11", employee_name="NoEnd", contract_end_date=None, department=None),
        dict(employee_id="E12", employee_name="NoPermit", basic_salary=0.0),
        dict(employee_id="E13", employee_name="Minus", basic_salary=-5.0, joining_date=d("2026-06-15")),
        dict(employee_id="E14", employee_name="Dana", nationality="Saudi Arabia", is_saudi=True, job_title="Finance Director"),
    ],
    "payroll": [
        dict(employee_id="E1"), dict(employee_id="E1"),
        dict(employee_id="E2", overtime_amount=100.0, gross_pay=6600.0, net_pay=6100.0),
        dict(employee_id="E3", gross_pay=-100.0, net_pay=-600.0),
        dict(employee_id="E4", net_pay=7000.0, cost_center=None),
        dict(employee_id="E5", project=None),
        dict(employee_id="E9"), dict(employee_id="E10"), dict(employee_id="E99"),
        dict(employee_id="E8", basic_salary=7000.0, gross_pay=8500.0, net_pay=8000.0),
        dict(employee_id="E8", payroll_period="2026-05"), dict(employee_id="E1", payroll_period="2026-05"),
    ],
    "attendance": [
        shift("E1", "2026-06-01", None, "17:00:00", missing_punch_count=1),
        shift("E1", "2026-06-02", "08:00:00", None, missing_punch_count=1),
        shift("E1", "2026-06-03", None, None),
        shift("E1", "2026-06-04", "08:00:30", "16:00:00", overtime_hours=2.0, overtime_approved=True),
        shift("E2", "2026-06-01", "08:45:00", "17:00:00", late_minutes=45, net_late_minutes=45),
        shift("E2", "2026-06-02", "08:20:10", "17:00:00", excused_late_minutes=60, late_minutes=5),
        shift("E9", "2026-06-01", "08:00:00", "17:00:00"), shift("E10", "2026-06-01", "08:00:00", "17:00:00"), shift("X1", "2026-06-01", "08:00:00", "17:00:00"),
        shift("E3", "2026-06-30", "08:00:00", "17:00:00"),
    ],
    "compliance": [
        dict(employee_id="E1", gosi_status=None, mudad_status=None), dict(employee_id="E2", gosi_status="Pending", qiwa_status="Expired"),
        dict(employee_id="E3", contract_authenticated=False, gosi_salary=4000.0), dict(employee_id="E4", occupation_match_status=None, insurance_status="Lapsed", gosi_salary=None),
        dict(employee_id="E7", iqama_expiry=d("2026-06-29"), work_permit_expiry=d("2026-06-01")), dict(employee_id="E8", iqama_expiry=d("2026-06-30"), work_permit_expiry=d("2026-07-30")),
        dict(employee_id="E12", iqama_expiry=None, work_permit_expiry=None), dict(employee_id="E9"), dict(employee_id="E2", period="2026-05", gosi_status="Registered"),
    ],
    "employee_relations": [
        dict(case_id="C1", owner_id=" "), dict(case_id="C2", employee_id="E5", priority=None), dict(case_id="C3", employee_id="E11", case_type=""),
        dict(case_id="C4", target_due_date=None, created_date=d("2026-06-01"), case_number="N4"), dict(case_id="C5", case_status="Closed", closed_date=None),
        dict(case_id="C6", case_status="Closed", closed_date=d("2026-06-18")), dict(case_id="C7", owner_id="E10"), dict(case_id="C8", employee_id="E9"),
        dict(case_id="C9"), dict(case_id="C9", case_number="N9"), dict(case_id="C10", escalated=True), dict(case_id="C11", case_type="Labor Case", legal_reference=None),
        dict(case_id="C12", created_date=d("2026-04-01"), closed_date=d("2026-05-01"), case_status="Closed"),
    ],
    "recruitment_requisitions": [
        dict(requisition_id="Q1"), dict(requisition_id="Q2", owner_id=None), dict(requisition_id="Q3", project=None), dict(requisition_id="Q4", department="Unassigned"),
        dict(requisition_id="Q5", cost_center=""), dict(requisition_id="Q6", job_title=None), dict(requisition_id="Q7", target_hire_date=None, approval_date=d("2026-05-01")),
        dict(requisition_id="Q8"), dict(requisition_id="Q8", job_title="Other"), dict(requisition_id="Q9", status="Cancelled"),
        dict(requisition_id="Q10", status="Filled", approval_date=d("2026-05-01"), closed_date=d("2026-06-12")),
    ],
    "candidates": [
        dict(candidate_id="K1"), dict(candidate_id="K1", applied_date=d("2026-06-01"), requisition_id="Q2"), dict(candidate_id="K2", pipeline_stage=None),
        dict(candidate_id="K3", requisition_id="QX"), dict(candidate_id="K4", source="Job Fair", requisition_id="Q10", pipeline_stage="Hired"), dict(candidate_id="K5", source=None),
    ],
    "interviews": [dict(interview_id="I1"), dict(interview_id="I2", recruiter_id=""), dict(interview_id="I3", interview_date=None)],
    "offers": [
        dict(offer_id="O1", candidate_id="K1", salary=None), dict(offer_id="O2", candidate_id="K2", outcome_status="Accepted"),
        dict(offer_id="O3", candidate_id="K4", outcome_status="Accepted"), dict(offer_id="O4", candidate_id="K5", outcome_status="Declined"),
    ],
    "onboarding": [dict(onboarding_id="B1", candidate_id="K4"), dict(onboarding_id="B2", candidate_id="K1", employee_id="U1")],
    "performance_reviews": [
        dict(review_id="PR1", employee_id="E1", rating=4.6), dict(review_id="PR2", employee_id="E2"), dict(review_id="PR2", employee_id="E3", rating=2.0),
        dict(review_id="PR3", employee_id="E4", rating=None), dict(review_id="PR4", employee_id="E7", rating=6.0), dict(review_id="PR5", employee_id="E8", reviewer_id=None, rating=1.2),
        dict(review_id="PR6", employee_id="E99"), dict(review_id="PR7", employee_id="E1", rating=3.0, completed_date=d("2026-06-01")),
        dict(review_id="PR8", employee_id="E1", review_period="2026-05"),
    ],
    "performance_goals": [
        dict(goal_id="G1"), dict(goal_id="G2", employee_id="E99"), dict(goal_id="G3", status=None), dict(goal_id="G4", status="In Progress"), dict(goal_id="G5", status="Cancelled"),
    ],
    "competency_assessments": [dict(assessment_id="A1"), dict(assessment_id="A2", employee_id="E99"), dict(assessment_id="A3", actual_score=5.5)],
    "learning_enrollments": [
        dict(enrollment_id="L1"), dict(enrollment_id="L2", employee_id="E99"), dict(enrollment_id="L3", completion_date=None), dict(enrollment_id="L4", course_id="TX", status="Enrolled"),
    ],
    "training_catalog": [dict(course_id="T1"), dict(course_id="T2", duration_hours=0.0), dict(course_id="T3", category=None)],
    "succession_plans": [
        dict(plan_id="S1"), dict(plan_id="S2", critical_role_id="R2", successor_employee_id=None), dict(plan_id="S3", critical_role_id="R3", successor_employee_id="E99"),
        dict(plan_id="S4", critical_role_id="R4", successor_employee_id="E10"), dict(plan_id="S5", critical_role_id="R5", readiness=""),
        dict(plan_id="S6", critical_role_id="R6", role_title="Finance Director", is_critical=False), dict(plan_id="S7", critical_role_id="R7", is_critical=False),
    ],
    "talent_reviews": [
        dict(review_id="TR1", employee_id="E1", flight_risk="High"), dict(review_id="TR2", employee_id="E2", potential_rating=None, flight_risk="Medium"),
        dict(review_id="TR0", employee_id="E1", flight_risk="Low"),
    ],
    "employee_skills": [dict(skill_id="K1"), dict(skill_id="K2"), dict(skill_id="K3", skill_name="Java")],
    "career_paths": [dict(path_id="CP1"), dict(path_id="CP2", next_role=" ")],
    "vacancy_requests": [dict(request_id="V1"), dict(request_id="V2", quantity=-1), dict(request_id="V3", status="Pending")],
    "workforce_plan": [
        dict(), dict(project=None, planned_headcount=1), dict(project="P9", planned_headcount=0), dict(period="2026-05"),
    ],
    "hr_requests": [
        dict(request_id="H1"), dict(request_id="H2", sla_breached=True, actual_hours=60), dict(request_id="H3", sla_hours=None, closed_at=None),
        dict(request_id="H4", created_at=t("2026-03-01 09:00:00"), closed_at=t("2026-03-02 09:00:00")),
    ],
}


def tables(spark) -> dict:
    found = {}
    for name, ddl in SCHEMAS.items():
        rows = [{**DEFAULTS[name], **row} for row in ROWS[name]]
        found[name] = spark.createDataFrame([tuple(r.get(c) for c, _ in columns(name)) for r in rows], ddl)
    return found
