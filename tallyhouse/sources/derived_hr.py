"""People tables derived from the trade tables.

The given data has no people tables, so each one is computed from a trade table
that grows with the scale factor: customers and suppliers act as employees,
orders as payroll runs, reviews, cases and offers, events as clock punches,
line items as candidates, parts as requisitions. Gaps, blanks, duplicates and
wrong amounts come from attribute values, so every rule has rows to find.

The texts keep to SQL that Spark and the checking engine both read; ``{ntz}``
is the name of the zone-free timestamp type.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.sources.trade import TABLES, read_table

# Reporting month the derived dates end in.
_PERIOD = (
    "CASE year(o.o_orderdate) WHEN 1995 THEN '2023-07' WHEN 1996 THEN '2023-08' WHEN 1997 THEN '2023-09' "
    "WHEN 1998 THEN '2023-10' WHEN 1999 THEN '2023-11' WHEN 2000 THEN '2023-12' ELSE '2024-01' END"
)


def _back(days: str) -> str:
    return f"(DATE '2024-01-31' - CAST({days} AS INT))"


def _cents(cents: str) -> str:
    return f"(CAST({cents} AS DOUBLE) / 100)"


SQL: dict[str, str] = {}

SQL["employees"] = f"""
SELECT 'E' || c.c_custkey AS employee_id, c.c_name AS employee_name,
  CASE WHEN c.c_nationkey = 7 THEN NULL WHEN c.c_nationkey = 8 THEN ' ' ELSE n.n_name END AS nationality,
  CASE WHEN c.c_nationkey = 9 THEN NULL ELSE n.n_regionkey IN (3, 4) END AS is_saudi,
  'Company ' || (c.c_nationkey % 3) AS company,
  CASE WHEN c.c_nationkey = 10 AND c.c_mktsegment = 'BUILDING' THEN NULL ELSE c.c_mktsegment END AS department,
  CASE WHEN c.c_nationkey = 11 THEN NULL WHEN c.c_nationkey = 12 AND c.c_mktsegment = 'FURNITURE' THEN '' ELSE r.r_name END AS project,
  CASE c.c_custkey % 60 WHEN 0 THEN 'HR Manager' WHEN 1 THEN 'Finance Director' WHEN 2 THEN 'Engineering Director' ELSE 'Analyst' END AS job_title,
  'Family ' || (c.c_nationkey % 4) AS job_family, 'G' || (c.c_custkey % 9) AS grade,
  CASE WHEN c.c_acctbal > 9500 THEN NULL ELSE 'E' || CAST(floor(c.c_custkey / 10) AS BIGINT) END AS manager_id,
  CASE WHEN c.c_nationkey = 13 THEN NULL WHEN c.c_nationkey = 14 AND c.c_mktsegment = 'MACHINERY' THEN '' ELSE 'CC' || c.c_nationkey END AS cost_center,
  CASE WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'Contractor' WHEN c.c_nationkey = 15 THEN NULL ELSE 'Full Time' END AS employment_type,
  'Fixed' AS contract_type,
  {_back('(c.c_custkey * 37) % 1500')} AS joining_date,
  CASE WHEN c.c_acctbal < -500 THEN {_back('(c.c_custkey * 13) % 200')} END AS termination_date,
  CASE WHEN c.c_nationkey = 16 THEN NULL ELSE {_back('100 - (c.c_custkey * 29) % 400')} END AS contract_end_date,
  CASE WHEN c.c_acctbal < -500 THEN 'Terminated' WHEN c.c_acctbal < 0 THEN 'Inactive' WHEN c.c_acctbal > 9900 THEN 'On Leave' ELSE 'Active' END AS status,
  CASE WHEN c.c_nationkey = 17 THEN 0 WHEN c.c_nationkey = 18 THEN -c.c_acctbal ELSE c.c_acctbal END AS basic_salary,
  CAST(100 AS DOUBLE) AS housing_allowance, CAST(50 AS DOUBLE) AS transport_allowance
FROM {{customer}} c JOIN {{nation}} n ON c.c_nationkey = n.n_nationkey JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
UNION ALL
SELECT 'E' || s.s_suppkey, s.s_name, n.n_name, n.n_regionkey = 4, 'Company 9', 'HOUSEHOLD', r.r_name, 'Analyst', 'Family 9', 'G1',
  'E1', 'CC9', 'Full Time', 'Open',
  {_back('(s.s_suppkey * 53) % 1700')}, CAST(NULL AS DATE), {_back('-(s.s_suppkey % 70)')},
  CASE WHEN s.s_acctbal > 3000 THEN 'Active' ELSE 'Inactive' END,
  s.s_acctbal, CAST(100 AS DOUBLE), CAST(50 AS DOUBLE)
FROM {{supplier}} s JOIN {{nation}} n ON s.s_nationkey = n.n_nationkey JOIN {{region}} r ON n.n_regionkey = r.r_regionkey
"""

SQL["payroll"] = f"""
SELECT payroll_period, employee_id, {_cents('basic')} AS basic_salary, {_cents('housing')} AS housing_allowance,
  {_cents('transport')} AS transport_allowance, {_cents('other')} AS other_allowances, {_cents('overtime')} AS overtime_amount,
  {_cents('deducted')} AS deductions, {_cents('gross')} AS gross_pay, {_cents('net')} AS net_pay,
  project, cost_center, payroll_status
FROM (
  SELECT payroll_period, employee_id, base * 6 AS basic, base * 2 AS housing, base AS transport, base AS other,
    CASE WHEN priority = '5-LOW' THEN 0 ELSE base END AS overtime, base AS deducted,
    CASE WHEN priority = '5-LOW' THEN base * 10 ELSE base * 11 END
      + CASE WHEN custkey % 23 = 0 THEN 500 WHEN custkey % 29 = 1 THEN -base * 30 ELSE 0 END AS gross,
    CASE WHEN priority = '5-LOW' THEN base * 9 ELSE base * 10 END
      + CASE WHEN custkey % 23 = 0 THEN 500 WHEN custkey % 29 = 1 THEN -base * 30 WHEN custkey % 31 = 2 THEN base * 2 ELSE 0 END AS net,
    project, cost_center, payroll_status
  FROM (
    SELECT {_PERIOD} AS payroll_period, 'E' || o.o_custkey AS employee_id, o.o_custkey AS custkey, o.o_orderpriority AS priority,
      CAST(floor(round(o.o_totalprice * 100) / 600) AS BIGINT) AS base,
      CASE WHEN o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'P' THEN NULL ELSE 'P' || o.o_orderpriority END AS project,
      CASE WHEN o.o_orderpriority = '2-HIGH' AND o.o_orderstatus = 'O' THEN NULL ELSE 'CC' || (o.o_custkey % 25) END AS cost_center,
      CASE WHEN o.o_orderstatus = 'P' THEN 'Draft' ELSE 'Paid' END AS payroll_status
    FROM {{orders}} o
  ) amounts
) lines
"""

SQL["attendance"] = """
SELECT attendance_date, CASE WHEN user_id % 15 = 14 THEN 'X' || user_id ELSE 'E' || user_id END AS employee_id, 'Day' AS shift_name,
  CASE WHEN user_id % 40 = 7 THEN NULL ELSE CAST(attendance_date AS {ntz}) + INTERVAL '8' HOUR END AS scheduled_start,
  CAST(attendance_date AS {ntz}) + INTERVAL '17' HOUR AS scheduled_end,
  check_in AS actual_check_in, check_out AS actual_check_out,
  CAST(CASE WHEN punches = 1 THEN 0 WHEN punches = 5 THEN NULL ELSE punches * 60 END AS BIGINT) AS late_minutes,
  CAST(CASE WHEN punches = 2 THEN 0 WHEN punches = 3 THEN 60 WHEN punches = 4 THEN 900 END AS BIGINT) AS excused_late_minutes,
  CAST(CASE WHEN punches = 1 THEN 0 ELSE punches * 30 END AS BIGINT) AS net_late_minutes,
  CASE WHEN check_in IS NULL AND check_out IS NULL AND punches > 1 THEN CAST(1 AS DOUBLE)
       WHEN user_id % 9 = 3 AND punches = 1 THEN CAST(1 AS DOUBLE) / 2 ELSE CAST(0 AS DOUBLE) END AS absence_days,
  CASE WHEN punches >= 4 THEN CAST(punches AS DOUBLE) / 2 ELSE CAST(0 AS DOUBLE) END AS overtime_hours,
  CASE WHEN punches = 7 THEN NULL ELSE punches % 2 = 0 END AS overtime_approved,
  CAST(CASE WHEN check_in IS NULL THEN 1 ELSE 0 END + CASE WHEN check_out IS NULL THEN 1 ELSE 0 END AS BIGINT) AS missing_punch_count,
  'Site ' || (user_id % 6) AS project
FROM (
  SELECT user_id, CAST(ts AS DATE) AS attendance_date, count(*) AS punches,
    min(CASE WHEN event_type IN ('view', 'click', 'signup') THEN ts END) AS check_in,
    max(CASE WHEN event_type IN ('click', 'signup', 'purchase') THEN ts END) AS check_out
  FROM (SELECT user_id, event_type, ts - INTERVAL '31' DAY * (user_id % 4) AS ts FROM {events}) shifted GROUP BY user_id, CAST(ts AS DATE)
) days
"""

SQL["hr_requests"] = f"""
SELECT 'R' || d.doc_id AS request_id, 'E' || (d.doc_id * 3 % 1700) AS employee_id, 'Type ' || d.lang AS request_type,
  CASE WHEN d.n_chars % 5 = 0 THEN 'Open' ELSE 'Closed' END AS request_status,
  CAST({_back('d.doc_id % 90 - 3')} AS {{ntz}}) + INTERVAL '9' HOUR AS created_at,
  CASE WHEN d.n_chars % 5 <> 0 THEN CAST({_back('d.doc_id % 90 - 3 - d.n_chars % 12')} AS {{ntz}}) + INTERVAL '15' HOUR END AS closed_at,
  'E' || (d.doc_id % 50) AS owner,
  CAST(CASE WHEN d.lang = 'de' THEN NULL ELSE 48 END AS BIGINT) AS sla_hours,
  CAST(CASE WHEN d.n_chars % 11 = 0 THEN NULL ELSE d.n_chars % 100 END AS BIGINT) AS actual_hours,
  d.n_chars % 100 > 48 AS sla_breached,
  CASE WHEN d.n_chars % 3 = 0 THEN NULL ELSE d.source END AS project
FROM {{documents}} d
"""

SQL["compliance"] = f"""
SELECT 'E' || c.c_custkey AS employee_id, p.period AS period,
  CASE WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'Expired' WHEN c.c_nationkey = 1 THEN NULL ELSE 'Active' END AS qiwa_status,
  CASE WHEN c.c_nationkey = 2 THEN NULL WHEN c.c_mktsegment = 'BUILDING' THEN 'Pending' ELSE 'Registered' END AS gosi_status,
  CASE WHEN c.c_nationkey = 3 THEN NULL WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'Late' ELSE 'Compliant' END AS mudad_status,
  CASE WHEN c.c_nationkey = 4 THEN NULL ELSE c.c_custkey % 6 <> 0 END AS contract_authenticated,
  CASE WHEN c.c_nationkey = 6 THEN NULL WHEN c.c_mktsegment = 'FURNITURE' THEN c.c_acctbal + 100 ELSE c.c_acctbal END AS gosi_salary,
  CASE WHEN c.c_nationkey = 19 THEN NULL ELSE c.c_acctbal END AS payroll_basic_salary,
  'OC' || (c.c_custkey % 13) AS occupation_code,
  CASE c.c_custkey % 5 WHEN 0 THEN 'Mismatch' WHEN 1 THEN NULL ELSE 'Matched' END AS occupation_match_status,
  CASE WHEN c.c_nationkey = 21 THEN NULL ELSE {_back('100 - (c.c_custkey * 41) % 400')} END AS work_permit_expiry,
  CASE WHEN c.c_nationkey = 22 THEN NULL ELSE {_back('90 - (c.c_custkey * 43) % 400')} END AS iqama_expiry,
  CASE c.c_custkey % 7 WHEN 0 THEN 'Lapsed' WHEN 1 THEN NULL ELSE 'Active' END AS insurance_status
FROM {{customer}} c JOIN (
  SELECT n_nationkey, '2023-12' AS period FROM {{nation}} UNION ALL SELECT n_nationkey, '2023-11' FROM {{nation}} UNION ALL SELECT n_nationkey, '2023-10' FROM {{nation}}
  UNION ALL SELECT n_nationkey, '2023-09' FROM {{nation}} UNION ALL SELECT n_nationkey, '2023-08' FROM {{nation}}
  UNION ALL SELECT n_nationkey, '2024-01' FROM {{nation}} WHERE n_nationkey <> 5
) p ON c.c_nationkey = p.n_nationkey
"""

SQL["employee_relations"] = f"""
SELECT 'C' || CAST(floor(o.o_orderkey / 2) AS BIGINT) AS case_id, 'E' || (o.o_custkey + o.o_orderkey % 3 * 100) AS employee_id,
  CASE (o.o_custkey + CAST(substr(o.o_orderpriority, 1, 1) AS INT) - 1) % 6 WHEN 0 THEN 'Grievance' WHEN 1 THEN 'Labor Case' WHEN 2 THEN 'Disciplinary' WHEN 3 THEN 'Disciplinary' WHEN 4 THEN 'Other' END AS case_type,
  CASE o.o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN CASE WHEN o.o_custkey % 2 = 0 THEN 'In Progress' ELSE 'Pending' END ELSE 'Closed' END AS case_status,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' END AS priority,
  {_back('o.o_orderkey % 120')} AS created_date,
  CASE WHEN o.o_orderkey % 2 = 0 THEN {_back('o.o_orderkey % 120 - o.o_custkey % 25')} END AS target_due_date,
  CASE WHEN o.o_orderstatus = 'F' AND o.o_custkey % 17 <> 3 THEN {_back('o.o_orderkey % 120 - o.o_custkey % 40 + 2')} END AS closed_date,
  CASE WHEN o.o_custkey % 13 = 5 THEN NULL ELSE 'E' || (o.o_custkey * 7 % 1700) END AS owner_id,
  o.o_orderkey % 10 = 3 AS escalated,
  CASE WHEN o.o_custkey % 4 = 1 THEN 'Reason ' || o.o_orderpriority WHEN o.o_custkey % 4 = 2 THEN ' ' END AS escalation_reason,
  CASE WHEN o.o_orderkey % 5 <> 0 THEN 'Ref ' || o.o_orderkey END AS legal_reference,
  'N' || o.o_orderkey AS case_number, 'Case of ' || o.o_orderpriority AS description
FROM {{orders}} o
"""

SQL["recruitment_requisitions"] = f"""
SELECT 'Q' || p.p_partkey AS requisition_id, CASE WHEN p.p_size = 9 THEN NULL ELSE p.p_type END AS job_title,
  CASE WHEN p.p_size = 11 THEN NULL ELSE 'Dept ' || p.p_type END AS department,
  CASE WHEN p.p_size = 12 THEN NULL WHEN p.p_size = 13 THEN 'Unassigned' ELSE 'Project ' || (p.p_partkey % 7) END AS project,
  CASE WHEN p.p_size = 14 THEN '' ELSE 'CC' || (p.p_partkey % 25) END AS cost_center,
  CASE WHEN p.p_size = 15 THEN NULL ELSE 'E' || (p.p_partkey % 300) END AS owner_id,
  {_back('(p.p_partkey * 17) % 200')} AS approval_date,
  CASE WHEN p.p_size % 3 = 0 THEN NULL ELSE {_back('(p.p_partkey * 17) % 200 - p.p_size * 2')} END AS target_hire_date,
  CASE WHEN p.p_size % 8 >= 4 THEN {_back('(p.p_partkey * 17) % 200 - p.p_size')} END AS closed_date,
  CASE p.p_size % 8 WHEN 0 THEN 'Open' WHEN 1 THEN 'Approved' WHEN 2 THEN 'In Progress' WHEN 3 THEN 'On Hold'
    WHEN 4 THEN 'Closed' WHEN 5 THEN 'Filled' WHEN 6 THEN 'Cancelled' ELSE 'Draft' END AS status
FROM {{part}} p
UNION ALL
SELECT 'Q' || s.s_suppkey, 'SMALL', 'Dept SMALL', 'Project 1', 'CC' || s.s_nationkey, 'E' || s.s_suppkey, {_back('s.s_suppkey % 60')},
  CAST(NULL AS DATE), CAST(NULL AS DATE), CASE WHEN s.s_acctbal > 0 THEN 'Open' ELSE 'Rejected' END
FROM {{supplier}} s
"""

SQL["candidates"] = f"""
SELECT 'K' || l.l_orderkey AS candidate_id, 'Candidate ' || l.l_orderkey AS candidate_name,
  CASE l.l_linenumber WHEN 1 THEN 'LinkedIn' WHEN 2 THEN 'Indeed' WHEN 3 THEN 'Referral' WHEN 4 THEN 'Direct' WHEN 5 THEN 'Agency' WHEN 6 THEN 'Job Fair' END AS source,
  CASE l.l_returnflag || l.l_linestatus WHEN 'AF' THEN 'Hired' WHEN 'AO' THEN 'Applied' WHEN 'NF' THEN 'Interview' WHEN 'NO' THEN 'Offer' WHEN 'RF' THEN 'Rejected' END AS pipeline_stage,
  CASE WHEN l.l_suppkey % 50 = 7 THEN 'QX' || l.l_suppkey ELSE 'Q' || l.l_partkey END AS requisition_id,
  {_back('(l.l_orderkey * 3 + l.l_linenumber * 11) % 150 - 5')} AS applied_date
FROM {{lineitem}} l
"""

SQL["interviews"] = f"""
SELECT 'I' || l.l_orderkey || '-' || l.l_linenumber AS interview_id, 'K' || l.l_orderkey AS candidate_id,
  CASE WHEN l.l_quantity = 50 THEN NULL ELSE CAST({_back('l.l_partkey % 70 - 2')} AS {{ntz}}) + INTERVAL '23' HOUR END AS interview_date,
  CASE WHEN l.l_quantity = 49 THEN '' WHEN l.l_quantity = 48 THEN NULL ELSE 'E' || l.l_suppkey END AS recruiter_id,
  CAST(l.l_linenumber AS BIGINT) AS rating, CASE l.l_returnflag WHEN 'N' THEN l.l_linestatus ELSE l.l_returnflag || l.l_linestatus END AS outcome
FROM {{lineitem}} l
"""

SQL["offers"] = f"""
SELECT 'O' || o.o_orderkey AS offer_id, 'K' || o.o_orderkey AS candidate_id, {_back('(o.o_custkey + o.o_orderkey) % 70 - 2')} AS offer_date,
  CASE WHEN o.o_custkey % 37 = 0 THEN NULL WHEN o.o_custkey % 37 = 1 THEN 0 ELSE o.o_totalprice END AS salary,
  CASE WHEN o.o_orderstatus = 'F' THEN 'Accepted' WHEN o.o_orderstatus = 'O' THEN 'Pending'
       WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Declined' WHEN o.o_orderpriority = '5-LOW' THEN 'Expired' ELSE 'Rejected' END AS outcome_status,
  {_back('(o.o_custkey + o.o_orderkey) % 70 - 6')} AS outcome_date
FROM {{orders}} o
"""

SQL["onboarding"] = f"""
SELECT 'B' || o.o_orderkey AS onboarding_id, 'K' || o.o_orderkey AS candidate_id, {_back('(o.o_custkey + o.o_orderkey) % 70 - 9')} AS start_date,
  CASE WHEN o.o_orderstatus = 'P' THEN 'Cancelled' WHEN o.o_custkey % 3 = 0 THEN 'Completed'
       WHEN o.o_custkey % 3 = 1 OR o.o_orderpriority = '1-URGENT' THEN 'In Progress' ELSE 'Not Started' END AS status,
  CASE WHEN o.o_custkey % 11 = 0 THEN NULL WHEN o.o_custkey % 11 = 1 THEN 'U' || o.o_custkey ELSE 'E' || o.o_custkey END AS employee_id
FROM {{orders}} o
"""

SQL["workforce_plan"] = """
SELECT p.period AS period, r.r_name AS project,
  CASE WHEN r.r_name = 'ASIA' AND c.c_mktsegment = 'BUILDING' THEN NULL ELSE c.c_mktsegment END AS department,
  CASE WHEN r.r_name = 'AFRICA' AND c.c_mktsegment = 'MACHINERY' THEN CAST(0 AS BIGINT) WHEN r.r_regionkey >= 3 THEN count(*) - 20 ELSE count(*) END AS planned_headcount
FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
JOIN (SELECT r_regionkey, '2023-12' AS period FROM {region} UNION ALL SELECT r_regionkey, '2024-01' FROM {region}) p ON p.r_regionkey = r.r_regionkey
GROUP BY p.period, r.r_regionkey, r.r_name, c.c_mktsegment
"""

SQL["vacancy_requests"] = f"""
SELECT 'V' || p.p_partkey AS request_id, 'Dept ' || p.p_type AS department, 'Project ' || (p.p_partkey % 7) AS project, p.p_type AS job_title,
  CAST(CASE WHEN p.p_size = 20 THEN NULL ELSE p.p_size - 15 END AS BIGINT) AS quantity,
  CASE WHEN p.p_size > 10 THEN 'Approved' ELSE 'Pending' END AS status, {_back('(p.p_partkey * 7) % 90 - 4')} AS approved_date
FROM {{part}} p
"""

SQL["performance_reviews"] = f"""
SELECT 'PR' || CAST(floor(o.o_orderkey / CASE WHEN o.o_custkey % 20 = 3 THEN 4 ELSE 1 END) AS BIGINT) AS review_id,
  'E' || (o.o_custkey + o.o_orderkey % 2 * 50) AS employee_id,
  CASE WHEN o.o_custkey % 19 = 0 THEN NULL WHEN o.o_custkey % 19 = 1 THEN ' ' ELSE 'E' || (o.o_custkey % 90) END AS reviewer_id,
  {_PERIOD} AS review_period,
  CASE WHEN o.o_custkey % 21 = 4 THEN NULL ELSE CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 60 AS DOUBLE) / 10 END AS rating,
  CASE WHEN o.o_orderstatus = 'O' THEN 'In Progress' ELSE 'Completed' END AS status,
  {_back('o.o_orderkey % 200')} AS completed_date
FROM {{orders}} o
"""

SQL["performance_goals"] = f"""
SELECT 'G' || o.o_orderkey AS goal_id, 'E' || (o.o_custkey + o.o_orderkey % 2 * 60) AS employee_id, 'Goal ' || o.o_orderpriority AS title,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN 'Overdue' WHEN '2-HIGH' THEN 'Completed' WHEN '3-MEDIUM' THEN 'In Progress'
    WHEN '4-NOT SPECIFIED' THEN CASE o.o_orderstatus WHEN 'O' THEN NULL WHEN 'F' THEN 'Cancelled' ELSE '' END ELSE 'Not Started' END AS status,
  {_back('(o.o_orderkey * 7) % 100 - 30')} AS due_date,
  CASE WHEN o.o_orderpriority = '2-HIGH' THEN {_back('(o.o_orderkey * 7) % 100')} END AS completed_date
FROM {{orders}} o
"""

SQL["competency_assessments"] = f"""
SELECT 'A' || l.l_orderkey || '-' || l.l_linenumber AS assessment_id, 'E' || (l.l_partkey % 1800) AS employee_id,
  'Competency ' || l.l_linenumber AS competency_name,
  CASE WHEN l.l_quantity = 50 THEN NULL ELSE CAST(CAST(l.l_quantity AS BIGINT) % 6 AS DOUBLE) END AS required_score,
  CAST((l.l_partkey + l.l_suppkey) % 60 AS DOUBLE) / 10 AS actual_score, {_back('l.l_partkey % 300')} AS assessed_date
FROM {{lineitem}} l
"""

SQL["learning_enrollments"] = """
SELECT 'L' || event_id AS enrollment_id, 'E' || (user_id * 11 % 1700) AS employee_id, 'T' || (event_id % 120) AS course_id,
  CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'signup' THEN 'In Progress' WHEN 'error' THEN 'Cancelled' WHEN 'click' THEN 'Completed' ELSE 'Enrolled' END AS status,
  CAST(ts AS DATE) + CAST(event_id % 10 AS INT) AS enrollment_date,
  CASE WHEN event_type = 'purchase' OR (event_type = 'click' AND user_id % 4 = 0) THEN CAST(ts AS DATE) END AS completion_date
FROM {events}
"""

SQL["training_catalog"] = """
SELECT 'T' || s_suppkey AS course_id, 'Course ' || s_name AS course_name,
  CASE WHEN s_nationkey = 1 THEN NULL WHEN s_nationkey = 2 THEN ' ' ELSE 'Category ' || (s_nationkey % 5) END AS category,
  CASE WHEN s_nationkey = 3 THEN NULL WHEN s_acctbal < 0 THEN CAST(0 AS DOUBLE) ELSE CAST(s_suppkey % 16 + 1 AS DOUBLE) / 2 END AS duration_hours
FROM {supplier}
"""

SQL["succession_plans"] = """
SELECT 'SP' || p_partkey AS plan_id, 'CR' || CAST(floor(p_partkey / 4) AS BIGINT) AS critical_role_id,
  CASE p_type WHEN 'PROMO' THEN 'HR Manager' WHEN 'LARGE' THEN 'Finance Director' ELSE p_type END AS role_title,
  'E' || (p_partkey % 1500) AS current_employee_id,
  CASE WHEN p_size = 1 THEN NULL WHEN p_size = 2 THEN ' ' ELSE 'E' || (p_partkey * 3 % 1900) END AS successor_employee_id,
  CASE WHEN p_size % 10 = 3 THEN NULL WHEN p_size % 10 = 4 THEN '' WHEN p_size % 3 = 0 THEN 'Ready Now' WHEN p_size % 3 = 1 THEN '1-2 Years' ELSE '3+ Years' END AS readiness,
  CASE p_size % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS flight_risk,
  CASE WHEN p_size = 30 THEN NULL ELSE p_size < 25 END AS is_critical
FROM {part}
"""

SQL["talent_reviews"] = """
SELECT 'TR' || c_custkey AS review_id, 'E' || (c_custkey - c_custkey % 2) AS employee_id,
  CAST(c_custkey % 50 AS DOUBLE) / 10 AS performance_rating,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'High' WHEN 'FURNITURE' THEN 'Medium' WHEN 'HOUSEHOLD' THEN NULL WHEN 'MACHINERY' THEN ' ' ELSE 'Low' END AS potential_rating,
  CASE c_nationkey % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' END AS flight_risk,
  CASE c_nationkey % 3 WHEN 0 THEN 'High' ELSE 'Low' END AS retention_risk
FROM {customer}
"""

SQL["employee_skills"] = """
SELECT 'S' || l_orderkey || '-' || l_partkey AS skill_id, 'E' || l_orderkey AS employee_id, 'Skill ' || l_linenumber AS skill_name, l_returnflag AS proficiency
FROM {lineitem}
"""

SQL["career_paths"] = """
SELECT 'CP' || c_custkey AS path_id, 'E' || (c_custkey + c_nationkey) AS employee_id, c_mktsegment AS current_role,
  CASE WHEN c_acctbal > 8000 THEN NULL WHEN c_acctbal < 0 THEN ' ' ELSE 'Senior ' || c_mktsegment END AS next_role, CAST(c_nationkey AS BIGINT) AS readiness_months
FROM {customer}
"""


def derive(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The people table ``name`` computed from the trade tables in ``folder``."""
    text = SQL[name].replace("{ntz}", "TIMESTAMP_NTZ")
    inputs = {t: read_table(spark, folder, t) for t in TABLES if re.search(r"\{%s\}" % t, text)}
    return spark.sql(text, **inputs)
