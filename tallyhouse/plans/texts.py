"""Wording of the exception rules.

Fixed values: issue types, severities, descriptions and actions are shown to
users and matched by downstream reports, so they are kept word for word.
``{slots}`` are filled with row values.
"""

from __future__ import annotations

from typing import NamedTuple


class Text(NamedTuple):
    severity: str
    description: str
    action: str


W, C = "Warning", "Critical"

WORKFORCE = {
    "Missing Manager": Text(W, "Active employee is missing a manager ID", "Assign supervisor/manager in employee profile"),
    "Missing Project": Text(W, "Active employee is missing a project code", "Assign cost project code in master profile"),
    "Missing Cost Center": Text(W, "Active employee is missing a cost center", "Assign financial cost center code in master profile"),
    "Missing Nationality": Text(W, "Employee nationality field is empty", "Update nationality field in employee record"),
    "Duplicate Employee ID": Text(C, "Employee ID is duplicated in master log", "Merge or delete duplicate employee record in ERP"),
    "Contract Expiry Risk": Text(W, "Active contract is expiring within 30 days: {contract_end_date}", "Initiate contract renewal in Qiwa"),
    "Iqama Expiry Risk": Text(W, "Iqama is expiring within 30 days: {iqama_expiry}", "Renew Iqama and update labor permit"),
    "Inactive Employee Payroll": Text(C, "Employee status is {status} but appeared in active payroll run", "Hold payroll run and check termination status/period logic"),
    "Missing Contract End Date": Text(W, "Active employee has no contract end date set", "Update contract records with end date"),
    "Missing Department": Text(W, "Active employee is not assigned to a department", "Assign employee to department"),
    "Missing Iqama Expiry Date": Text(W, "Active non-Saudi employee has no Iqama expiry date set", "Update compliance records with Iqama expiry date"),
}

PAYROLL = {
    "Inactive Employee Payroll": Text(C, "Employee has status {emp_status} but appeared in active payroll run", "Hold payroll and verify termination status"),
    "Active Employee Missing Payroll": Text(C, "Active employee has no payroll record for current period", "Check payroll run for missing record"),
    "Negative Gross Pay": Text(C, "Employee has negative gross pay: {gross}", "Correct payroll calculation"),
    "Negative Net Pay": Text(C, "Employee has negative net pay: {net}", "Correct payroll deductions"),
    "Net Pay Exceeds Gross Pay": Text(C, "Net pay ({net}) exceeds gross pay ({gross})", "Review deduction/tax calculations"),
    "Missing Cost Center": Text(W, "Payroll record is missing a cost center code", "Assign cost center in profile"),
    "Missing Project": Text(W, "Payroll record is missing a project assignment", "Assign project to employee"),
    "Overtime Cost Without Hours": Text(W, "Employee paid overtime ({overtime}) but has 0 overtime hours in attendance", "Verify attendance punches and overtime logs"),
    "Large Payroll Variance": Text(W, "Employee gross pay changed by {change} SAR vs last month (Basic salary change: {basic_pct}%)", "Review contract salary history for updates"),
    "Duplicate Payroll Record": Text(C, "Multiple payroll records found for employee {employee_id} in period {payroll_period}", "Remove duplicate payroll line"),
    "Payroll Component Mismatch": Text(C, "Gross pay ({gross}) does not equal sum of components ({components})", "Recalculate gross salary components"),
    "Net Pay Mismatch": Text(C, "Net pay ({net}) does not equal gross minus deductions ({expected_net})", "Check deduction sums and tax deductions"),
}

ATTENDANCE = {
    "Missing Check-in": Text(W, "Employee has actual check-out but actual check-in is missing on {day}", "Request employee to provide check-in time"),
    "Missing Check-out": Text(W, "Employee has actual check-in but actual check-out is missing on {day}", "Request employee to provide check-out time"),
    "Both Punches Missing": Text(W, "Expected workday on {day} has both check-in and check-out missing but absence days is 0", "Record absence or collect punch times"),
    "One Punch Only": Text(W, "Only one punch recorded on {day}", "Reconcile check-in or check-out time"),
    "Late Arrival Without Excuse": Text(W, "Employee arrived late by {late} minutes on {day} without an excuse", "Follow up with manager for excuse authorization"),
    "Excused Late Exceeds Actual": Text(W, "Excused late minutes ({excused}) exceeds actual late minutes ({late}) on {day}", "Review and adjust excused late minutes"),
    "Source Late Minutes Mismatch": Text(W, "Source late minutes ({source_late}) does not match calculated ({late}) on {day}", "Verify source system lateness logic and parameters"),
    "Source Net Late Minutes Mismatch": Text(W, "Source net late minutes ({source_net}) does not match calculated ({net_late}) on {day}", "Verify source system net lateness calculations"),
    "Overtime Amount Missing": Text(C, "Employee has approved overtime hours ({hours}) but payroll overtime amount is zero", "Process overtime payment in monthly payroll"),
    "Overtime Hours Missing": Text(C, "Employee has payroll overtime payment ({cost} SAR) but approved overtime hours are zero", "Investigate overtime validation or manual entry error"),
    "Attendance for Inactive Employee": Text(C, "Attendance record exists on {day} but employee is inactive", "Verify employee work status and attendance logs"),
    "Attendance for Terminated Employee": Text(C, "Attendance record exists on {day} but employee is terminated", "Deactivate employee security badge and delete profile"),
    "Attendance for Unknown Employee": Text(C, "Attendance record exists on {day} but employee is not found in master records", "Register employee in master file or verify employee ID"),
    "Missing Workday Attendance": Text(W, "Active employee has no attendance record for expected workday on {day}", "Confirm if employee was absent, on leave, or missed punch"),
}

COMPLIANCE = {
    "Missing GOSI Status Record": Text(C, "Active employee has no record in GOSI registration field", "Check GOSI enrollment status"),
    "Not Registered in GOSI": Text(C, "Active employee exists but status is {gosi_status}", "Register employee in GOSI portal"),
    "Missing WPS Record": Text(C, "Active employee has no record in WPS (Mudad) portal", "Add employee to WPS payroll files"),
    "WPS Record for Inactive Employee": Text(C, "Employee is appearing in government WPS file with status {mudad_status} but is inactive/terminated ({employee_status})", "Stop WPS payroll entry and verify status"),
    "Missing Project assignment": Text(W, "Active employee is missing project code assignment", "Update project mapping in master file"),
    "Missing Department assignment": Text(W, "Active employee is missing department mapping", "Update department mapping in master file"),
    "Missing Cost Center assignment": Text(W, "Active employee is missing cost center assignment", "Update cost center in master file"),
    "Missing Qiwa Contract": Text(C, "Active employee has no contract registered in Qiwa", "Register digital contract in Qiwa portal"),
    "Contract Not Authenticated": Text(W, "Digital contract is pending employee authentication", "Request employee to log into Qiwa and approve contract"),
    "GOSI Salary Mismatch": Text(C, "Registered GOSI salary ({gosi_salary}) differs from basic salary ({basic})", "Update GOSI salary records to match payroll basic"),
    "Missing Salary Info": Text(W, "Active employee has null salary values in GOSI or payroll base", "Update salary values in GOSI/payroll database"),
    "Occupation Mismatch": Text(W, "Qiwa occupational code does not match active role description", "Correct occupational designation code in Qiwa portal"),
    "Insurance Inactive": Text(C, "Medical insurance coverage status is not active", "Activate insurance profile in provider database"),
    "Missing Nationality": Text(W, "Active employee has null/missing nationality or Saudization status", "Update employee nationality records in master file"),
    "Missing Iqama Expiry Date": Text(W, "Non-Saudi employee is missing an Iqama expiry date", "Update compliance records with Iqama expiry date"),
    "Expired Iqama": Text(C, "Iqama has expired: {iqama_expiry}", "Renew Iqama immediately"),
    "Iqama Expiring Soon": Text(W, "Iqama is expiring within 30 days: {iqama_expiry}", "Initiate Iqama renewal"),
    "Missing Work Permit Expiry Date": Text(W, "Non-Saudi employee is missing a Work Permit expiry date", "Update compliance records with Work Permit expiry date"),
    "Expired Work Permit": Text(C, "Work permit has expired: {work_permit_expiry}", "Renew work permit immediately"),
    "Work Permit Expiring Soon": Text(W, "Work permit is expiring within 30 days: {work_permit_expiry}", "Initiate work permit renewal"),
}

CASES = {
    "Missing Case Owner": Text(C, "Open case has no owner assigned", "Assign an owner to investigate"),
    "Missing Project": Text(W, "Open case has no project link", "Update subject employee project assignment"),
    "Missing Department": Text(W, "Open case has no department link", "Update subject employee department assignment"),
    "Missing Case Type": Text(C, "Case type is blank", "Specify Grievance, Disciplinary, or Labor Case"),
    "Missing Priority": Text(W, "Case priority is blank", "Set priority level to High, Medium, or Low"),
    "Missing Target Due Date": Text(C, "Target due date is blank in source records", "Set target due date based on SLA rules"),
    "Overdue Open Case": Text(C, "Open case has breached its effective target due date: {due}", "Expedite investigation and case resolution"),
    "Missing Closure Date": Text(C, "Case is status Closed but has no closed_date", "Fill closed_date in log"),
    "Invalid Date Range": Text(C, "Case closed_date ({closed_date}) is before created_date ({created_date})", "Correct date entries"),
    "Inactive Case Owner": Text(W, "Case investigator owner is classified as: {owner_classification}", "Reassign case owner to active employee"),
    "Inactive Case Subject": Text(W, "Case subject employee is classified as: {subject_classification}", "Check if case is archive or needs resolution closure"),
    "Duplicate Case ID": Text(C, "Case ID is logged more than once", "Deduplicate ER logs"),
    "Missing SLA Status": Text(W, "SLA compliance clock cannot evaluate status", "Provide created_date and target_due_date"),
    "Missing Escalation Reason": Text(W, "Case is flagged escalated but reason is blank", "Document reason for case escalation"),
    "Missing Legal Reference": Text(W, "Labor case is missing court case number or reference log", "Enter legal case details"),
}

RECRUITMENT = {
    "Missing Recruiter": Text(C, "Open requisition has no owner recruiter assigned", "Assign a recruiter"),
    "Missing Project": Text(W, "Open requisition has no project assignment", "Assign a project code"),
    "Missing Department": Text(W, "Open requisition has no department", "Assign a department"),
    "Missing Cost Center": Text(W, "Open requisition has no cost center", "Assign a cost center"),
    "Missing Job Title": Text(C, "Open requisition job title is blank", "Enter job title"),
    "Missing Target Hire Date": Text(W, "Open requisition target hire date is blank", "Provide target hire date"),
    "Overdue Requisition": Text(C, "Open requisition has breached its effective target date: {due}", "Expedite sourcing and pipeline conversions"),
    "Empty Candidate Pipeline": Text(W, "Requisition is open but has 0 candidates linked", "Source and link candidates to requisition"),
    "Missing Pipeline Stage": Text(W, "Candidate application has no pipeline stage logged", "Assign current pipeline stage"),
    "Unknown Requisition Link": Text(C, "Candidate is linked to requisition ID {requisition_id} which does not exist in master requisitions table", "Link candidate to active requisition"),
    "Missing Interviewer": Text(W, "Interview has no interviewer assigned", "Assign interviewer employee ID"),
    "Missing Interview Date": Text(W, "Interview record has no scheduled date and time", "Set scheduled interview timestamp"),
    "Offer Missing Salary": Text(C, "Offer extended has no base salary details", "Enter base salary details"),
    "Onboarding Not Triggered": Text(C, "Offer status is Accepted but onboarding is not logged", "Create onboarding record"),
    "Unknown Employee ID": Text(W, "Onboarding record links to employee ID {employee_id} which is missing from employee directory", "Verify active employee ID and link"),
    "Duplicate Requisition ID": Text(C, "Requisition ID is logged multiple times in source records", "Deduplicate requisition records"),
    "Duplicate Candidate ID": Text(C, "Candidate ID is logged multiple times in source records", "Deduplicate candidate records"),
    "Missing Plan Dimension": Text(W, "Workforce plan record has null project or department", "Specify project and department details"),
    "Plan Exceeded": Text(W, "Actual headcount ({actual}) exceeds planned headcount ({planned})", "Review project hiring plan"),
    "Plan Unfulfilled": Text(W, "Planned headcount ({planned}) has not been fulfilled (Actual: {actual}) by target date {target}", "Expedite hiring pipeline"),
    "Invalid Vacancy Quantity": Text(C, "Vacancy request Approved has invalid quantity: {quantity}", "Enter positive quantity"),
    "Unknown Source Channel": Text(W, "Candidate has un-normalized source channel: {raw_source}", "Update to standard channel"),
}

TALENT = {
    "Missing Performance Review": Text(W, "Active employee {employee_id} has no completed review for {month}", "Assign and complete a performance review"),
    "Review Linked to Unknown Employee": Text(C, "Review ID {review_id} links to employee_id {employee_id} not in master directory", "Correct employee_id on review record"),
    "Duplicate Performance Review ID": Text(C, "Review ID {review_id} appears more than once in source records", "Deduplicate performance review records"),
    "Review Completed Without Rating": Text(C, "Review {review_id} for employee {employee_id} is Completed but has no rating", "Enter rating before marking review Completed"),
    "Rating Outside Allowed Range": Text(C, "Review {review_id} has rating {rating} which is outside allowed range {low}–{high}", "Correct rating to within 1.0–5.0 scale"),
    "Review Missing Reviewer": Text(C, "Review {review_id} has no reviewer_id assigned", "Assign a reviewer before finalizing review"),
    "Goal Linked to Unknown Employee": Text(C, "Goal {goal_id} links to employee {employee_id} not in master directory", "Correct employee_id on goal record"),
    "Goal Missing Status": Text(W, "Goal {goal_id} for employee {employee_id} has no status", "Set goal status (Completed/In Progress/Overdue etc.)"),
    "Goal Overdue": Text(W, "Goal {goal_id} for employee {employee_id} is past due date {due_date}", "Resolve or update overdue goal"),
    "Competency Linked to Unknown Employee": Text(C, "Assessment {assessment_id} links to employee {employee_id} not in master directory", "Correct employee_id on competency assessment"),
    "Competency Score Outside Range": Text(C, "Assessment {assessment_id} has score outside 1–5 (required={required}, actual={actual})", "Correct competency scores to 1.0–5.0 range"),
    "Critical Role Missing Successor": Text(W, "Critical role {role_title} ({critical_role_id}) has no nominated successor", "Nominate a successor for this critical role"),
    "Successor Linked to Unknown Employee": Text(C, "Succession plan {plan_id} successor {successor_employee_id} is not in employee master directory", "Correct successor_employee_id in succession plan"),
    "Successor Assigned to Inactive Employee": Text(W, "Succession plan {plan_id} successor {successor_employee_id} is inactive or terminated", "Reassign succession to an active employee"),
    "Successor Readiness Missing": Text(C, "Succession plan {plan_id} for role {role_title} has no readiness value", "Set readiness status for this successor nomination"),
    "Enrollment Linked to Unknown Employee": Text(C, "Enrollment {enrollment_id} links to employee {employee_id} not in master directory", "Correct employee_id on enrollment record"),
    "Training Completed Without Date": Text(C, "Enrollment {enrollment_id} has status Completed but no completion_date", "Set completion_date on completed enrollment"),
    "Training Hours Missing or Invalid": Text(C, "Course {course_name} has invalid/zero duration hours: {hours}", "Enter valid positive training hours for this course"),
    "Learning Course Missing Category": Text(W, "Course {course_name} has no category assigned", "Assign a category to this training course"),
    "Talent Review Missing Potential Rating": Text(C, "Talent review for employee {employee_id} is missing the potential_rating field", "Enter potential rating on talent review record"),
    "High Performer With High Flight Risk": Text(W, "Employee {employee_id} is rated {performance_category} but has high flight risk", "Engage retention measures for this high-performer"),
    "Critical Employee Without Successor": Text(W, "Employee {employee_id} ({job_title}) is in a critical role but has no succession plan", "Create a succession plan for this critical employee"),
    "Duplicate Skill Record": Text(W, "Employee {employee_id} has duplicate entry for skill: {skill_name}", "Deduplicate employee skill records"),
    "Career Path Missing Next Role": Text(W, "Career path for employee {employee_id} has no next_role defined", "Define the next_role for this career path entry"),
}

VALIDATION = {
    "Duplicate Employee ID": Text(C, "Employee ID '{employee_id}' is duplicated {copies} times in master file.", "Merge or delete duplicate employee record in ERP"),
    "Missing Manager": Text(W, "Active employee has no manager ID assigned.", "Assign supervisor/manager in employee profile"),
    "Missing Project": Text(W, "Active employee has no project code assigned.", "Assign cost project code in master profile"),
    "Missing Nationality": Text(W, "Employee has no nationality specified.", "Update nationality field in employee record"),
    "Missing Cost Center": Text(W, "Employee has no cost center assigned.", "Assign financial cost center code in master profile"),
    "Active Employee with Missing Salary": Text(C, "Active employee contract has basic salary recorded as 0 or missing.", "Input basic salary details in contract record"),
    "Abnormal Payroll Value": Text(C, "Employee contract has negative basic salary: {basic}", "Review contract salary figures for input errors"),
    "Inactive Employee with Payroll Record": Text(C, "Employee status is '{status}' but has active payroll run record for period {payroll_period}.", "Hold payroll run and check termination status/period logic"),
    "Negative or Abnormal Payroll Value": Text(C, "Payroll record has negative/abnormal monetary values: Gross {gross}, Net {net}.", "Review monthly payroll worksheet calculations for adjustments"),
    "Attendance Record with Missing Punch": Text(W, "Missing punch registered on {day}.", "Request employee punch reconciliation or supervisor approval"),
    "HR Request Breaching SLA": Text(W, "HR Request {request_id} of type '{request_type}' exceeded SLA: Actual {actual} hrs, SLA {sla} hrs.", "Escalate request status and allocate to alternate agent"),
}
