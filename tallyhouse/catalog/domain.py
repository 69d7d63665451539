"""Temporal, reconciliation, exception and data-governance operators on the trade tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.catalog.registry import Catalog, Trade
from tallyhouse.functions import floor_zero, minute_boundaries, money_text, overlaps, percent, ratio, say, tally, total
from tallyhouse.functions.columns import expiry_bucket
from tallyhouse.operators import names, privacy, quality, rules
from tallyhouse.operators import relational as rel
from tallyhouse.operators import retention, suppression
from tallyhouse.operators import temporal as tm
from tallyhouse.operators.kpi import NEUTRAL, Kpi, Status, above, at_least, kpi_list
from tallyhouse.operators.reconcile import checks_of, presence_status
from tallyhouse.plans.command_center import health
from tallyhouse.session import scratch_dir
from tallyhouse.streaming.audit import AUDIT_SCHEMA, append_stream, audit_records

catalog = Catalog()
query = catalog.query

ENDS = [date(1999, 12, 31), date(2000, 1, 31), date(2000, 2, 29), date(2000, 3, 31)]


def _order_life(t: Trade) -> DataFrame:
    """Orders with the date of their last shipment; an order without lines is still open."""
    shipped = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("s"))
    return t.orders.join(shipped, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.to_date("o_orderdate").alias("opened"), F.to_date("s").alias("closed")
    )


_LIFE = """WITH life AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, CAST(o_orderdate AS DATE) AS opened, CAST(max(l_shipdate) AS DATE) AS closed
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) """


@query(
    "d1_as_of_count",
    _LIFE + """SELECT d AS as_of_date, count(DISTINCT o_custkey) AS customers FROM (SELECT unnest([DATE '1999-12-31', DATE '2000-01-31', DATE '2000-02-29', DATE '2000-03-31']) AS d)
LEFT JOIN life ON opened <= d AND (closed IS NULL OR closed > d) GROUP BY 1""",
)
def d1(t: Trade) -> DataFrame:
    return tm.as_of_count(_order_life(t), "o_custkey", "opened", "closed", ENDS, "customers")


@query(
    "d2_report_anchor",
    """SELECT strftime(m, '%Y-%m') AS label, CAST(date_trunc('month', m) AS DATE) AS month_start, last_day(m) AS month_end, coalesce(NULL, strftime(m, '%Y-%m'), '2026-06') AS chosen
FROM (SELECT CAST(max(o_orderdate) AS DATE) AS m FROM orders)""",
)
def d2(t: Trade) -> DataFrame:
    """Report month of a table with a fallback chain: configured, found, default."""
    m = F.to_date("m")
    label = F.date_format(m, "yyyy-MM")
    return t.orders.agg(F.max("o_orderdate").alias("m")).select(
        label.alias("label"),
        F.trunc(m, "month").alias("month_start"),
        F.last_day(m).alias("month_end"),
        F.coalesce(F.lit(None).cast("string"), label, F.lit("2026-06")).alias("chosen"),
    )


@query(
    "d3_period_change",
    """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS p, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1), c AS (SELECT p, v, coalesce(lag(v) OVER (ORDER BY p), 0) AS b FROM m)
SELECT p AS period, v AS current_value, b AS previous_value, round(v - b, 2) AS change_amount, CASE WHEN b = 0 THEN 0 ELSE round((v - b) / b, 6) END AS change_share,
  abs(v - b) > 2000 OR (b > 0 AND abs(v - b) / b > 0.1) AS large FROM c""",
)
def d3(t: Trade) -> DataFrame:
    """Month against month before; the window runs over one row per month."""
    months = t.orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("period")).agg(total("o_totalprice").alias("current_value"))
    rows = months.withColumn("previous_value", F.coalesce(F.lag("current_value").over(Window.orderBy("period")), F.lit(0.0)))
    amount, share = tm.change(F.col("current_value"), F.col("previous_value"))
    return rows.select(
        "period", "current_value", "previous_value",
        F.round(amount, 2).alias("change_amount"),
        F.round(share, 6).alias("change_share"),
        ((F.abs(amount) > 2000) | (F.abs(share) > 0.1)).alias("large"),
    )


@query(
    "d4_expiry_buckets",
    _LIFE + """SELECT CASE WHEN closed IS NULL THEN 'missing_date' WHEN closed < a THEN 'expired' WHEN closed <= a + 30 THEN '0_30' WHEN closed <= a + 60 THEN '31_60' WHEN closed <= a + 90 THEN '61_90' ELSE '90_plus' END AS bucket,
  count(*) AS orders FROM life, (SELECT DATE '2001-06-30' AS a) GROUP BY 1""",
)
def d4(t: Trade) -> DataFrame:
    bucket = expiry_bucket("closed", F.lit(date(2001, 6, 30)))
    return _order_life(t).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("orders"))


@query(
    "d5_lateness",
    """SELECT user_id, day, late, greatest(late - CASE WHEN n > 2 THEN 120 ELSE 0 END, 0) AS net_late, early FROM (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, greatest(date_diff('minute', CAST(ts AS DATE) + INTERVAL 8 HOUR, min(ts)) - 15, 0) AS late,
    CASE WHEN max(ts) < CAST(ts AS DATE) + INTERVAL 17 HOUR THEN date_diff('minute', max(ts), CAST(ts AS DATE) + INTERVAL 17 HOUR) ELSE 0 END AS early FROM events GROUP BY user_id, CAST(ts AS DATE))""",
)
def d5(t: Trade) -> DataFrame:
    """First and last event of a user's day against fixed hours: late, net of an excuse, and early leave."""
    days = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))
    midnight = F.col("day").cast("timestamp_ntz")
    start, end = midnight + F.expr("interval 8 hours"), midnight + F.expr("interval 17 hours")
    late = tm.late_minutes(start, "first", 15)
    early = F.when(F.col("last") < end, minute_boundaries("last", end)).otherwise(F.lit(0).cast("bigint"))
    excused = F.when(F.col("n") > 2, 120).otherwise(0)
    return days.select("user_id", "day", late.alias("late"), floor_zero(late - excused).alias("net_late"), early.alias("early"))


@query(
    "d6_calendar_densify",
    """WITH u AS (SELECT user_id, CAST(min(ts) AS DATE) AS s, CAST(max(ts) AS DATE) AS e FROM events GROUP BY 1), d AS (SELECT user_id, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS day FROM u)
SELECT user_id, day, coalesce(n, 0) AS events, CAST(CASE WHEN n IS NULL THEN 1 ELSE 0 END AS DOUBLE) AS absence FROM (SELECT * FROM d WHERE dayname(day) <> 'Friday')
LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2) USING (user_id, day)""",
)
def d6(t: Trade) -> DataFrame:
    spans = t.events.groupBy("user_id").agg(F.to_date(F.min("ts")).alias("s"), F.to_date(F.max("ts")).alias("e"))
    days = tm.expand_days(spans, F.col("s"), F.col("e"), "day", ("Friday",)).select("user_id", "day")
    seen = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(seen, ["user_id", "day"], "left").select(
        "user_id", "day", F.coalesce("n", F.lit(0)).alias("events"), F.when(F.col("n").isNull(), 1.0).otherwise(0.0).alias("absence")
    )


@query(
    "d7_two_source_status",
    """SELECT status, count(*) AS orders FROM (SELECT CASE WHEN r > 0 AND u > 0 THEN 'Both' WHEN r > 0 THEN 'Returned only' WHEN u > 0 THEN 'Urgent only' ELSE 'None' END AS status FROM (
  SELECT coalesce(r, 0) AS r, coalesce(u, 0) AS u FROM (SELECT l_orderkey AS k, sum(l_quantity) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
  FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS u FROM orders WHERE o_orderpriority = '1-URGENT') USING (k))) GROUP BY 1""",
)
def d7(t: Trade) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("r"))
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(1.0).alias("u")
    )
    status = presence_status(F.coalesce("r", F.lit(0.0)), F.coalesce("u", F.lit(0.0)), "Both", "Returned only", "Urgent only", "None")
    return rel.full_join_unique(returned, urgent, "k").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("orders"))


@query(
    "d8_zero_filled_spine",
    """SELECT e AS event_type, d AS day, (SELECT count(*) FROM events WHERE event_type = e AND CAST(ts AS DATE) = d AND value > 150) AS n
FROM (SELECT unnest(['view', 'click', 'signup', 'purchase', 'error', 'refund']) AS e), (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)""",
)
def d8(t: Trade) -> DataFrame:
    """Each day with each of the fixed event types, zero where none was seen."""
    types = F.array(*[F.lit(x) for x in ("view", "click", "signup", "purchase", "error", "refund")])
    day = F.to_date("ts")
    spine = t.events.select(day.alias("day")).distinct().select("day", F.explode(types).alias("event_type"), F.lit(0).alias("hit"))
    seen = t.events.where("value > 150").select(day.alias("day"), "event_type", F.lit(1).alias("hit"))
    return spine.unionByName(seen).groupBy("event_type", "day").agg(F.sum("hit").alias("n"))


@query(
    "d9_interval_overlap",
    _LIFE + "SELECT o_orderkey, opened, closed FROM life WHERE opened <= DATE '2000-02-29' AND (closed IS NULL OR closed >= DATE '2000-02-01')",
)
def d9(t: Trade) -> DataFrame:
    keep = overlaps("opened", "closed", F.lit(date(2000, 2, 1)), F.lit(date(2000, 2, 29)))
    return _order_life(t).where(keep).select("o_orderkey", "opened", "closed")


_SLA_DAYS = {"1-URGENT": 5, "2-HIGH": 10, "3-MEDIUM": 20}
_CLOCK = _LIFE + """, clock AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE opened + CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 10 WHEN '3-MEDIUM' THEN 20 ELSE 30 END END AS due,
  date_diff('day', opened, coalesce(closed, DATE '2001-08-31')) AS aging FROM life) """


def _clock(t: Trade) -> DataFrame:
    days = F.lit(30)
    for priority, limit in _SLA_DAYS.items():
        days = F.when(F.col("o_orderpriority") == priority, F.lit(limit)).otherwise(days)
    due = F.when(F.col("o_orderkey") % 3 != 0, F.date_add("opened", days))
    anchor = F.lit(date(2001, 8, 31))
    rows = _order_life(t).withColumn("due", due)
    return rows.select(
        "*",
        tm.aging_days(F.col("opened"), F.col("closed"), anchor).alias("aging"),
        tm.sla_status(F.col("opened"), F.col("closed"), F.col("due"), anchor).alias("sla_status"),
    )


@query(
    "d10_sla_clock",
    _CLOCK + """SELECT o_orderkey, due, aging, CASE WHEN due IS NULL THEN 'Not Eligible' WHEN closed <= due THEN 'Compliant' WHEN closed > due OR DATE '2001-08-31' > due THEN 'Breached' ELSE 'Pending' END AS sla_status FROM clock""",
)
def d10(t: Trade) -> DataFrame:
    return _clock(t).select("o_orderkey", "due", "aging", "sla_status")


@query(
    "d11_aging_bands",
    _CLOCK + """SELECT CASE WHEN aging BETWEEN 0 AND 3 THEN '0_3_days' WHEN aging BETWEEN 4 AND 7 THEN '4_7_days' WHEN aging BETWEEN 8 AND 14 THEN '8_14_days' WHEN aging BETWEEN 15 AND 30 THEN '15_30_days' ELSE '30_plus_days' END AS band,
  count(*) AS orders FROM clock GROUP BY 1""",
)
def d11(t: Trade) -> DataFrame:
    return _clock(t).groupBy(tm.aging_band(F.col("aging")).alias("band")).agg(F.count(F.lit(1)).alias("orders"))


@query(
    "d12_record_class",
    """SELECT e.user_id, CASE WHEN c_custkey IS NULL THEN 'Unknown' WHEN c_acctbal < 0 THEN 'Terminated' WHEN c_acctbal < 1000 THEN 'Inactive' WHEN c_mktsegment = 'BUILDING' THEN 'Other' ELSE 'Active' END AS class, n
FROM (SELECT user_id * 12 AS user_id, count(*) AS n FROM events GROUP BY 1) e LEFT JOIN customer ON c_custkey = e.user_id""",
)
def d12(t: Trade) -> DataFrame:
    users = t.events.groupBy((F.col("user_id") * 12).alias("user_id")).agg(F.count(F.lit(1)).alias("n"))
    balance = F.col("c_acctbal")
    kind = (
        F.when(F.col("c_custkey").isNull(), "Unknown")
        .when(balance < 0, "Terminated")
        .when(balance < 1000, "Inactive")
        .when(F.col("c_mktsegment") == "BUILDING", "Other")
        .otherwise("Active")
    )
    return users.join(t.customer, F.col("c_custkey") == F.col("user_id"), "left").select("user_id", kind.alias("class"), "n")


@query(
    "d13_funnel",
    """SELECT c_mktsegment, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'signup') AS signups,
  count(*) FILTER (event_type = 'purchase') AS purchases, round(100.0 * count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'view'), 0), 2) AS conversion_pct
FROM events JOIN customer ON c_custkey = user_id GROUP BY 1""",
)
def d13(t: Trade) -> DataFrame:
    kind = F.col("event_type")
    return t.events.join(t.customer, F.col("c_custkey") == F.col("user_id")).groupBy("c_mktsegment").agg(
        tally(kind == "view").alias("views"),
        tally(kind == "click").alias("clicks"),
        tally(kind == "signup").alias("signups"),
        tally(kind == "purchase").alias("purchases"),
        percent(tally(kind == "purchase"), tally(kind == "view")).alias("conversion_pct"),
    )


@query(
    "d13_time_to_fill",
    """SELECT c_mktsegment, round(avg(date_diff('day', f, p)), 1) AS average_days, count(*) AS buyers FROM (SELECT user_id, CAST(min(ts) FILTER (event_type = 'view') AS DATE) AS f,
  CAST(max(ts) FILTER (event_type = 'purchase') AS DATE) AS p FROM events GROUP BY 1) JOIN customer ON c_custkey = user_id WHERE f IS NOT NULL AND p IS NOT NULL GROUP BY 1""",
)
def d13_days(t: Trade) -> DataFrame:
    kind = F.col("event_type")
    users = t.events.groupBy("user_id").agg(
        F.to_date(F.min(F.when(kind == "view", F.col("ts")))).alias("f"), F.to_date(F.max(F.when(kind == "purchase", F.col("ts")))).alias("p")
    )
    return (
        users.where("f is not null and p is not null")
        .join(t.customer, F.col("c_custkey") == F.col("user_id"))
        .groupBy("c_mktsegment")
        .agg(F.round(F.avg(F.datediff("p", "f")), 1).alias("average_days"), F.count(F.lit(1)).alias("buyers"))
    )


@query(
    "d14_plan_vs_actual",
    """SELECT n_name, planned, coalesce(n, 0) AS actual, CASE WHEN planned = 0 THEN CASE WHEN coalesce(n, 0) = 0 THEN 100 ELSE 0 END ELSE round(100.0 * coalesce(n, 0) / planned, 2) END AS fulfilment_pct
FROM (SELECT n_nationkey, n_name, n_nationkey * 5 AS planned FROM nation) LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = n_nationkey""",
)
def d14(t: Trade) -> DataFrame:
    plan = t.nation.select("n_nationkey", "n_name", (F.col("n_nationkey") * 5).alias("planned"))
    actual = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    rows = plan.join(actual, F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn("actual", F.coalesce("n", F.lit(0)))
    none = F.when(F.col("actual") == 0, 100.0).otherwise(0.0)
    return rows.select("n_name", "planned", "actual", F.when(F.col("planned") == 0, none).otherwise(percent("actual", "planned")).alias("fulfilment_pct"))


@query(
    "d15_coverage",
    """SELECT p_brand, count(*) AS parts, count(*) FILTER (n > 0) AS covered, CAST(coalesce(sum(n), 0) AS BIGINT) AS suppliers, round(100.0 * count(*) FILTER (n > 0) / count(*), 2) AS coverage_pct FROM (
  SELECT p_brand, (SELECT count(DISTINCT l_suppkey) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey AND s_acctbal > 0 AND year(l_shipdate) = 1998) AS n FROM part) GROUP BY 1""",
)
def d15(t: Trade) -> DataFrame:
    valid = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    window = F.col("l_shipdate").between(F.lit("1998-01-01").cast("timestamp_ntz"), F.lit("1998-12-31 23:59:59.999999").cast("timestamp_ntz"))
    pairs = t.lineitem.where(window).select("l_partkey", "l_suppkey").join(valid, "l_suppkey", "left_semi")
    per_part = pairs.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("n"))
    rows = t.part.join(per_part, F.col("l_partkey") == F.col("p_partkey"), "left").select("p_brand", F.coalesce("n", F.lit(0)).alias("n"))
    covered = tally(F.col("n") > 0)
    return rows.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("parts"), covered.alias("covered"), F.sum("n").alias("suppliers"), percent(covered, F.count(F.lit(1))).alias("coverage_pct")
    )


@query(
    "d16_risk_matrix",
    """SELECT risk, count(*) AS customers FROM (SELECT CASE WHEN c_acctbal < 0 AND v > 3000000 THEN 'High Risk' WHEN c_acctbal < 0 OR (c_acctbal < 1000 AND v > 3000000) THEN 'Medium Risk' ELSE 'Low Risk' END AS risk
FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1) ON o_custkey = c_custkey) GROUP BY 1""",
)
def d16(t: Trade) -> DataFrame:
    spent = t.orders.groupBy("o_custkey").agg(total("o_totalprice").alias("v"))
    debt, large = F.col("c_acctbal") < 0, F.col("v") > 3000000
    risk = F.when(debt & large, "High Risk").when(debt | ((F.col("c_acctbal") < 1000) & large), "Medium Risk").otherwise("Low Risk")
    return t.customer.join(spent, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(risk.alias("risk")).agg(F.count(F.lit(1)).alias("customers"))


def _freshness(t: Trade) -> DataFrame:
    def latest(name: str, frame: DataFrame, column: str) -> DataFrame:
        return frame.agg(F.to_date(F.max(column)).alias("latest")).select(F.lit(name).alias("source"), "latest")

    return rules.stack(latest("orders", t.orders, "o_orderdate"), latest("lineitem", t.lineitem, "l_shipdate"), latest("events", t.events, "ts"))


_FRESH = """WITH f AS (SELECT 'orders' AS source, CAST(max(o_orderdate) AS DATE) AS latest FROM orders UNION ALL SELECT 'lineitem', CAST(max(l_shipdate) AS DATE) FROM lineitem
  UNION ALL SELECT 'events', CAST(max(ts) AS DATE) FROM events) """


@query(
    "d17_freshness",
    _FRESH + """SELECT source, latest, latest IS NULL OR latest < DATE '2001-10-31' AS stale, CASE WHEN latest IS NULL THEN 'No data' WHEN latest < DATE '2001-10-31' THEN 'Latest ' || latest || ' is older than 2001-10-31' ELSE 'Data is current' END AS reason FROM f""",
)
def d17(t: Trade) -> DataFrame:
    expected = F.lit(date(2001, 10, 31))
    old = F.col("latest") < expected
    reason = F.when(F.col("latest").isNull(), "No data").when(old, say("Latest {latest} is older than {e}", e=expected)).otherwise("Data is current")
    return _freshness(t).select("source", "latest", (F.col("latest").isNull() | old).alias("stale"), reason.alias("reason"))


@query(
    "d18_health",
    """SELECT c_mktsegment, critical, warning, CASE WHEN NOT present OR checks = 'Failed' OR critical > 30 THEN 'Critical' WHEN checks = 'Unknown' THEN 'Unknown' WHEN warning > 0 THEN 'Warning' ELSE 'Healthy' END AS status FROM (
  SELECT c_mktsegment, count(*) FILTER (c_acctbal < -200) AS critical, count(*) FILTER (c_acctbal BETWEEN -200 AND 0) AS warning, c_mktsegment <> 'FURNITURE' AS present,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Unknown' WHEN 'MACHINERY' THEN 'Failed' ELSE 'Passed' END AS checks FROM customer GROUP BY 1)""",
)
def d18(t: Trade) -> DataFrame:
    balance, segment = F.col("c_acctbal"), F.col("c_mktsegment")
    groups = t.customer.groupBy("c_mktsegment").agg(tally(balance < -200).alias("critical"), tally(balance.between(-200, 0)).alias("warning"))
    checks = F.when(segment == "BUILDING", "Unknown").when(segment == "MACHINERY", "Failed").otherwise("Passed")
    over = floor_zero(F.col("critical") - 30)
    status = health(F.lit("Healthy"), checks, segment != "FURNITURE", F.lit(False), over, F.col("warning"))
    return groups.select("c_mktsegment", "critical", "warning", status.alias("status"))


@query(
    "d19_kpi_list",
    """WITH k AS (SELECT count(*) AS orders, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 2) AS filled, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS DOUBLE) / count(*) AS urgent, min(o_totalprice) AS smallest FROM orders)
SELECT 'orders' AS key, 'Orders' AS label, CAST(orders AS DOUBLE) AS value, 'orders' AS unit, 'neutral' AS status FROM k
UNION ALL SELECT 'filled', 'Filled %', filled, '%', CASE WHEN filled >= 90 THEN 'healthy' WHEN filled >= 30 THEN 'warning' ELSE 'critical' END FROM k
UNION ALL SELECT 'urgent', 'Urgent Share', round(urgent * 100, 2), '%', CASE WHEN urgent > 0.1 THEN 'warning' ELSE 'healthy' END FROM k
UNION ALL SELECT 'smallest', 'Smallest Order', round(smallest, 2), 'SAR', CASE WHEN smallest < 500 THEN 'warning' ELSE 'healthy' END FROM k""",
)
def d19(t: Trade) -> DataFrame:
    rows = F.count(F.lit(1))
    row = t.orders.agg(
        rows.alias("orders"),
        percent(tally(F.col("o_orderstatus") == "F"), rows).alias("filled"),
        ratio(tally(F.col("o_orderpriority") == "1-URGENT"), rows).alias("urgent"),
        F.min("o_totalprice").alias("smallest"),
    )
    kpis = (
        Kpi("orders", "Orders", "orders", NEUTRAL),
        Kpi("filled", "Filled %", "%", at_least(90, "critical", 30)),
        Kpi("urgent", "Urgent Share", "%", above(0.1), scale=100.0),
        Kpi("smallest", "Smallest Order", "SAR", Status((("<", 500, "warning"),), "healthy")),
    )
    return kpi_list(row, kpis)


@query(
    "d20_quality_score",
    """SELECT 1 - CAST((SELECT count(*) FROM lineitem WHERE l_quantity > 45) + (SELECT count(*) FROM lineitem WHERE l_discount = 0) AS DOUBLE) / ((SELECT count(DISTINCT l_orderkey) FROM lineitem) * 8) AS score""",
)
def d20(t: Trade) -> DataFrame:
    rules_ = [
        rules.Rule("Large Quantity", "Warning", "Check", F.lit("Quantity above 45"), F.col("l_quantity") > 45),
        rules.Rule("No Discount", "Warning", "Check", F.lit("Discount is zero"), F.col("l_discount") == 0),
    ]
    issues = rules.flag_rows(t.lineitem, rules_, "l_orderkey", None).agg(F.count(F.lit(1)).alias("issues"))
    ids = t.lineitem.agg(F.count_distinct("l_orderkey").alias("ids"))
    return rel.side_by_side(issues, ids).select((1.0 - F.col("issues").cast("double") / (F.greatest("ids", F.lit(1)) * 8.0)).alias("score"))


@query(
    "d21_monthly_snapshot",
    """WITH c AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
  m AS (SELECT c.*, CAST(unnest(generate_series(date_trunc('month', s), date_trunc('month', e), INTERVAL 1 MONTH)) AS DATE) AS month_start FROM c)
SELECT strftime(month_start, '%Y-%m') AS snapshot_month, c_custkey, c_mktsegment, c_nationkey, c_acctbal, CASE WHEN e <= last_day(month_start) THEN 'Ended' ELSE 'Active' END AS status FROM m""",
)
def d21(t: Trade) -> DataFrame:
    """One row per customer and month between its first and last order."""
    life = t.orders.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("s"), F.to_date(F.max("o_orderdate")).alias("e"))
    people = t.customer.join(life, F.col("o_custkey") == F.col("c_custkey"))
    months = tm.entity_months(people, "c_custkey", F.col("s"), F.col("e"))
    status = F.when(F.col("e") <= F.last_day("month_start"), "Ended").otherwise("Active")
    return months.select(F.date_format("month_start", "yyyy-MM").alias("snapshot_month"), "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal", status.alias("status"))


# ------------------------------------------------------------ rules, feeds, reconciliation
def _order_issues(t: Trade) -> DataFrame:
    """Row rules and a relational rule in one catalogue: the join gives a flag, the rules share one pass."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"), F.min("l_shipdate").alias("first_ship"))
    rows = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    catalogue = [
        rules.Rule("Order Without Lines", "Critical", "Load lines", say("Order {o_orderkey} has no lines"), F.col("l_orderkey").isNull()),
        rules.Rule("Shipped Before Order", "critical ", "Correct dates", say("First shipment before order on {d}", d=F.to_date("o_orderdate")), F.col("first_ship") < F.col("o_orderdate")),
        rules.Rule("Large Pending Order", "WARNING", "Review", say("Pending value {v}", v=money_text("o_totalprice")), (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 450000)),
        rules.Rule("Many Lines", "info", "None", say("{lines} lines"), F.col("lines") > 8),
    ]
    return rules.flag_rows(rows, catalogue, "o_orderkey", None)


_ISSUES = """WITH j AS (SELECT o.*, lines, first_ship FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS lines, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
i AS (SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, CAST(NULL AS VARCHAR) AS entity_name, 'Order Without Lines' AS issue_type, 'Order ' || o_orderkey || ' has no lines' AS description, 'Critical' AS severity, 'Load lines' AS recommended_action FROM j WHERE lines IS NULL
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, 'Shipped Before Order', 'First shipment before order on ' || CAST(o_orderdate AS DATE), 'critical ', 'Correct dates' FROM j WHERE first_ship < o_orderdate
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, 'Large Pending Order', 'Pending value ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), 'WARNING', 'Review' FROM j WHERE o_orderstatus = 'P' AND o_totalprice > 450000
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, 'Many Lines', lines || ' lines', 'info', 'None' FROM j WHERE lines > 8) """


@query("x1_rule_catalogue", _ISSUES + "SELECT * FROM i")
def x1(t: Trade) -> DataFrame:
    return _order_issues(t)


def _feeds(t: Trade) -> DataFrame:
    debt = rules.Rule("Negative Balance", "Warning", "Call customer", F.lit("Balance below zero"), F.col("c_acctbal") < 0)
    short = rules.Rule("Short Text", "Note", "Check source", F.lit("Fewer than 50 characters"), F.col("n_chars") < 50)
    return rules.stack(
        rules.conform(_order_issues(t), "orders", "Orders", "order_issues", "/orders"),
        rules.conform(rules.flag_rows(t.customer, [debt], "c_custkey", "c_name"), "customers", "Customers", "customer_issues", "/customers"),
        rules.conform(rules.flag_rows(t.documents, [short], "doc_id", None), "documents", "Documents", "document_issues", "/documents"),
    ).withColumn("severity", rules.normal_severity("severity"))


_ALL = _ISSUES + """, f AS (SELECT module_key, module_label, source_mart, entity_id, entity_name, issue_type, description,
  CASE lower(trim(severity)) WHEN 'critical' THEN 'Critical' WHEN 'warning' THEN 'Warning' WHEN 'info' THEN 'Info' ELSE 'Unknown' END AS severity, recommended_action, '/' || module_key AS route_path FROM (
  SELECT 'orders' AS module_key, 'Orders' AS module_label, 'order_issues' AS source_mart, * FROM i
  UNION ALL SELECT 'customers', 'Customers', 'customer_issues', CAST(c_custkey AS VARCHAR), c_name, 'Negative Balance', 'Balance below zero', 'Warning', 'Call customer' FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'documents', 'Documents', 'document_issues', CAST(doc_id AS VARCHAR), NULL, 'Short Text', 'Fewer than 50 characters', 'Note', 'Check source' FROM documents WHERE n_chars < 50)) """


@query("x2_common_feed", _ALL + "SELECT * FROM f")
def x2(t: Trade) -> DataFrame:
    return _feeds(t)


@query(
    "x3_priority_alerts",
    _ALL + """SELECT module_key || '_' || issue_type AS alert_id, module_key, module_label, severity, issue_type, count(*) AS issue_count, max(recommended_action) AS recommended_action, max(source_mart) AS source_mart FROM f GROUP BY ALL""",
)
def x3(t: Trade) -> DataFrame:
    return (
        rules.summarise(_feeds(t))
        .select(
            F.concat_ws("_", "module_key", "issue_type").alias("alert_id"), "module_key", "module_label", "severity", "issue_type",
            F.col("exception_count").alias("issue_count"), "recommended_action", "source_mart",
        )
        .orderBy(F.when(F.col("severity") == "Critical", 1).otherwise(2), F.desc("issue_count"), "alert_id")
    )


@query(
    "r1_reconciliation",
    """WITH n AS (SELECT round(sum(o_totalprice), 2) AS direct, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders), g AS (SELECT round(sum(v), 2) AS v, CAST(sum(k) AS BIGINT) AS k FROM (
  SELECT c_nationkey, round(sum(o_totalprice), 2) AS v, count(DISTINCT o_custkey) AS k FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)), l AS (SELECT count(DISTINCT l_orderkey) AS with_lines FROM lineitem)
SELECT 'Revenue by nation' AS check_name, direct AS expected, v AS actual, round(abs(direct - v), 6) AS difference, CAST(0.01 AS DOUBLE) AS tolerance, abs(direct - v) <= 0.01 AS passed FROM n, g
UNION ALL SELECT 'Customers by nation', customers, k, abs(customers - k), 0, customers = k FROM n, g
UNION ALL SELECT 'Orders with lines', orders, with_lines, abs(orders - with_lines), 0, orders = with_lines FROM n, l""",
)
def r1(t: Trade) -> DataFrame:
    by_nation = (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy("c_nationkey")
        .agg(total("o_totalprice").alias("v"), F.count_distinct("o_custkey").alias("k"))
        .agg(total("v").alias("nation_value"), F.sum("k").alias("nation_customers"))
    )
    row = rel.side_by_side(
        t.orders.agg(total("o_totalprice").alias("direct"), F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers")),
        by_nation,
        t.lineitem.agg(F.count_distinct("l_orderkey").alias("with_lines")),
    )
    return checks_of(
        row,
        [
            ("Revenue by nation", "direct", "nation_value", 0.01),
            ("Customers by nation", "customers", "nation_customers", 0.0),
            ("Orders with lines", "orders", "with_lines", 0.0),
        ],
    )


@query(
    "r2_batch_validators",
    """SELECT CAST(l_orderkey AS VARCHAR) AS entity_id, CAST(l_linenumber AS VARCHAR) AS name, CAST(sum(n) OVER (PARTITION BY l_orderkey) AS BIGINT) AS copies FROM (
  SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)""",
)
def r2(t: Trade) -> DataFrame:
    """Repeated line numbers, a row each, with the copies of their order."""
    repeated = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = repeated.groupBy("l_orderkey").agg(F.sum("n").alias("copies"))
    return repeated.join(copies, "l_orderkey").select(F.col("l_orderkey").cast("string").alias("entity_id"), F.col("l_linenumber").cast("string").alias("name"), "copies")


# ------------------------------------------------------------ governance
def _order_checks(t: Trade) -> list[quality.Check]:
    c = quality.Check
    return [
        c("key_present", ("o_orderkey",), "NOT_NULL", "Reject"),
        c("status_format", ("o_orderstatus",), "REGEX", "Quarantine", "^[OF]$"),
        c("date_valid", ("day",), "DATE_VALID", "Quarantine"),
        c("value_logical", ("o_totalprice",), "EXPRESSION", "Flag", "o_totalprice > 5000 OR o_orderpriority = '1-URGENT'"),
        c("priority_allowed", ("o_orderpriority",), "IN_LIST", "Quarantine", ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")),
        c("customer_exists", ("o_custkey",), "FOREIGN_KEY", "Quarantine", reference=t.customer.where("c_acctbal >= 0").select("c_custkey")),
        c("price_positive", ("o_totalprice",), "GREATER_THAN", "Reject", 1200.0),
        c("key_not_negative", ("o_orderkey",), "GREATER_THAN_EQUAL", "Reject", 0),
        c("price_range", ("o_totalprice",), "IN_RANGE", "Flag", (2000, 490000)),
        c("one_per_day", ("o_custkey", "o_orderdate"), "UNIQUE_PER_PERIOD", "Reject"),
        c("customer_priority", ("o_custkey", "o_totalprice"), "UNIQUE", "Deduplicate"),
    ]


def _delivered(t: Trade) -> DataFrame:
    day = F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.withColumn("day", day)


_MARKED = """WITH m AS (SELECT o_orderkey, FALSE AS key_present, NOT regexp_matches(o_orderstatus, '^[OF]$') AS status_format, o_orderstatus = 'P' AS date_valid,
  NOT (o_totalprice > 5000 OR o_orderpriority = '1-URGENT') AS value_logical, o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') AS priority_allowed,
  o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) AS customer_exists, o_totalprice <= 1200 AS price_positive, o_orderkey < 0 AS key_not_negative,
  o_totalprice NOT BETWEEN 2000 AND 490000 AS price_range, count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1 AS one_per_day, count(*) OVER (PARTITION BY o_custkey, o_totalprice) > 1 AS customer_priority FROM orders) """
_KINDS = {
    "key_present": ("NOT_NULL", "Reject"), "status_format": ("REGEX", "Quarantine"), "date_valid": ("DATE_VALID", "Quarantine"), "value_logical": ("EXPRESSION", "Flag"),
    "priority_allowed": ("IN_LIST", "Quarantine"), "customer_exists": ("FOREIGN_KEY", "Quarantine"), "price_positive": ("GREATER_THAN", "Reject"),
    "key_not_negative": ("GREATER_THAN_EQUAL", "Reject"), "price_range": ("IN_RANGE", "Flag"), "one_per_day": ("UNIQUE_PER_PERIOD", "Reject"), "customer_priority": ("UNIQUE", "Deduplicate"),
}


@query(
    "g1_validation_rules",
    _MARKED + " UNION ALL ".join(f"SELECT o_orderkey, '{n}' AS rule_name, '{k}' AS check_type, '{a}' AS action FROM m WHERE {n}" for n, (k, a) in _KINDS.items()),
)
def g1(t: Trade) -> DataFrame:
    return quality.violations(_delivered(t), _order_checks(t), ["o_orderkey"])


@query(
    "g2_disposition",
    _MARKED + "SELECT CASE WHEN " + " OR ".join(n for n, v in _KINDS.items() if v[1] == "Reject") + " THEN 'Reject' WHEN " + " OR ".join(n for n, v in _KINDS.items() if v[1] == "Quarantine")
    + " THEN 'Quarantine' WHEN customer_priority THEN 'Deduplicate' WHEN value_logical OR price_range THEN 'Flag' ELSE 'Accept' END AS disposition, count(*) AS rows FROM m GROUP BY 1",
)
def g2(t: Trade) -> DataFrame:
    """Rows are routed to one folder per disposition and counted from there."""
    from tallyhouse.session import scratch_dir

    path = scratch_dir(t.spark, "routed")
    quality.route(_delivered(t), _order_checks(t), path)
    return t.spark.read.parquet(path).groupBy("disposition").agg(F.count(F.lit(1)).alias("rows"))


_TOTALS = {
    "rows": "count(*)", "customers": "count(distinct o_custkey)", "open": "sum(case when o_orderstatus = 'O' then 1 else 0 end)", "filled": "sum(case when o_orderstatus = 'F' then 1 else 0 end)",
    "missing_key": "sum(case when o_orderkey is null then 1 else 0 end)", "value": "round(sum(o_totalprice), 2)", "urgent_value": "round(sum(case when o_orderpriority = '1-URGENT' then o_totalprice else 0 end), 2)",
    "largest": "max(o_totalprice)", "smallest": "min(o_totalprice)", "years": "count(distinct year(o_orderdate))",
}


@query(
    "g3_control_totals",
    "WITH a AS (" + " UNION ALL ".join(f"SELECT '{n}' AS total_name, CAST({e} AS DOUBLE) AS actual FROM orders" for n, e in _TOTALS.items())
    + "), b AS (SELECT 'rows' AS total_name, CAST(count(o_orderkey) AS DOUBLE) AS expected FROM orders UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'delivered', 1 FROM region WHERE r_regionkey = 0)"
    + " SELECT total_name, expected, actual, coalesce(abs(expected - actual) <= 0.01, FALSE) AS passed FROM a FULL JOIN b USING (total_name)",
)
def g3(t: Trade) -> DataFrame:
    expected = rules.stack(
        t.orders.agg(F.count("o_orderkey").cast("double").alias("expected")).select(F.lit("rows").alias("total_name"), "expected"),
        t.customer.agg(F.count(F.lit(1)).cast("double").alias("expected")).select(F.lit("customers").alias("total_name"), "expected"),
        t.region.where("r_regionkey = 0").select(F.lit("delivered").alias("total_name"), F.lit(1.0).alias("expected")),
    )
    return quality.compare_totals(quality.control_totals(t.orders, _TOTALS), expected)


@query(
    "g4_schema_contract",
    """SELECT 'c_custkey' AS field, TRUE AS type_ok, count(*) FILTER (c_custkey IS NULL) AS missing, count(*) - count(DISTINCT c_custkey) AS repeated, CAST(0 AS BIGINT) AS not_allowed, count(*) FILTER (c_custkey < 10) AS below_minimum FROM customer
UNION ALL SELECT 'c_name', TRUE, count(*) FILTER (trim(c_name) = ''), count(*) - count(DISTINCT c_name), 0, 0 FROM customer
UNION ALL SELECT 'c_mktsegment', TRUE, 0, 0, count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')), 0 FROM customer
UNION ALL SELECT 'c_acctbal', FALSE, 0, 0, 0, count(*) FILTER (c_acctbal < 0) FROM customer
UNION ALL SELECT 'c_phone', FALSE, 0, 0, 0, 0 FROM region WHERE r_regionkey = 0""",
)
def g4(t: Trade) -> DataFrame:
    field = quality.FieldContract
    contract = [
        field("c_custkey", "bigint", required=True, unique=True, minimum=10),
        field("c_name", "string", required=True, unique=True),
        field("c_mktsegment", "string", allowed=("BUILDING", "MACHINERY", "HOUSEHOLD")),
        field("c_acctbal", "decimal(18,2)", minimum=0),
        field("c_phone", "string", required=True),
    ]
    return quality.contract_report(t.customer, contract)


@query(
    "g5_file_gate",
    r"""WITH f AS (SELECT DISTINCT CASE WHEN o_orderstatus = 'P' THEN 'netsuite_payroll_ledger_' || strftime(o_orderdate, '%Y%m') || '.xlsx' WHEN o_orderstatus = 'O' THEN 'zk_attendance_logs_' || strftime(o_orderdate, '%Y%m%d') || '.csv'
  ELSE 'orders_' || strftime(o_orderdate, '%Y') || '.csv' END AS file_name FROM orders)
SELECT file_name, CASE WHEN regexp_matches(file_name, '^netsuite_payroll_ledger_\d{6}\.xlsx$') THEN 'Payroll' WHEN regexp_matches(file_name, '^zk_attendance_logs_\d{8}\.csv$') THEN 'Attendance' END AS source_category,
  CASE WHEN file_name LIKE 'orders%' THEN 'Quarantine File' ELSE 'Accept' END AS gate FROM f""",
)
def g5(t: Trade) -> DataFrame:
    def name(prefix: str, pattern: str, suffix: str):
        return F.concat(F.lit(prefix), F.date_format("o_orderdate", pattern), F.lit(suffix))

    status = F.col("o_orderstatus")
    file_name = (
        F.when(status == "P", name("netsuite_payroll_ledger_", "yyyyMM", ".xlsx"))
        .when(status == "O", name("zk_attendance_logs_", "yyyyMMdd", ".csv"))
        .otherwise(name("orders_", "yyyy", ".csv"))
    )
    return quality.gate_files(t.orders.select(file_name.alias("file_name")).distinct(), "file_name")


@query(
    "g6_masking",
    """SELECT p_partkey, substr(p_name, 1, 4) || repeat('*', greatest(length(p_name) - 4, 0)) AS left_shown, repeat('*', greatest(length(p_name) - 4, 0)) || right(p_name, 4) AS right_shown,
  CASE WHEN length(split_part(p_name, ' ', 2)) <= 4 THEN repeat('*', length(split_part(p_name, ' ', 2))) ELSE substr(split_part(p_name, ' ', 2), 1, 4) || repeat('*', length(split_part(p_name, ' ', 2)) - 4) END AS short_part,
  upper(substr(p_name, 1, 1)) || '.' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || '. (' || p_partkey || ')' AS pseudonym, '[REDACTED_FINANCIAL_DETAIL]' AS price FROM part""",
)
def g6(t: Trade) -> DataFrame:
    return t.part.select(
        "p_partkey",
        privacy.mask_part("p_name").alias("left_shown"),
        privacy.mask_part("p_name", keep="right").alias("right_shown"),
        privacy.mask_part(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("short_part"),
        privacy.pseudonym("p_name", "p_partkey").alias("pseudonym"),
        F.lit(privacy.FULL_REDACTION).alias("price"),
    )


@query(
    "g6_entity_redaction",
    r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\d[\d,]*(\.\d+)? ?SAR', '[MONEY]', 'g')) AS digest FROM documents""",
)
def g6_text(t: Trade) -> DataFrame:
    return t.documents.select("doc_id", F.md5(privacy.redact_entities("text")).alias("digest"))


@query(
    "g6_person_redaction",
    r"""WITH people AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'Khalid Al-Harbi ' || c_custkey WHEN 1 THEN 'sara al-noor' ELSE 'Omar ' || c_name || ' Bin Said' END AS name FROM customer),
words AS (SELECT DISTINCT regexp_extract_all(name, '\p{L}[\p{L}\p{M}\p{N}_#]*') AS w FROM people),
grams AS (SELECT DISTINCT lower(array_to_string(w[i:i + n - 1], ' ')) AS gram FROM words, (VALUES (1), (2), (3)) t(n), unnest(range(1, len(w) - n + 2)) u(i)),
known AS (SELECT gram FROM grams WHERE contains(gram, ' ') OR length(gram) >= 3),
texts AS (SELECT doc_id, regexp_replace(regexp_replace(text || CASE doc_id % 5 WHEN 0 THEN ' Disputed 500 SAR with manager Khalid.' WHEN 1 THEN ' Told by Sara Al-Noor, khalid and Al.'
    WHEN 2 THEN ' Omar Customer#' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || ' Bin Said''s case, a@b.com' WHEN 3 THEN ' Khalid Al Harbi Omar' ELSE ' no one' END,
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\d[\d,]*(\.\d+)? ?SAR', '[MONEY]', 'g') AS text FROM documents),
cut AS (SELECT doc_id, regexp_extract_all(text, '\p{L}[\p{L}\p{M}\p{N}_#]*|[^\p{L}]+') AS ts FROM texts),
tok AS (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS p FROM cut),
near AS (SELECT *, lead(t, 1) OVER w AS t1, lead(t, 2) OVER w AS t2, lead(t, 3) OVER w AS t3, lead(t, 4) OVER w AS t4 FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
cand AS (SELECT doc_id, p, p AS z, lower(t) AS g FROM near WHERE regexp_matches(t, '^\p{Lu}')
  UNION ALL SELECT doc_id, p, p + 2, lower(t || ' ' || t2) FROM near WHERE regexp_matches(t, '^\p{Lu}') AND t2 IS NOT NULL AND regexp_matches(t1, '^[ \t\n''’-]{1,3}$')
  UNION ALL SELECT doc_id, p, p + 4, lower(t || ' ' || t2 || ' ' || t4) FROM near WHERE regexp_matches(t, '^\p{Lu}') AND t4 IS NOT NULL AND regexp_matches(t1, '^[ \t\n''’-]{1,3}$') AND regexp_matches(t3, '^[ \t\n''’-]{1,3}$')),
hit AS (SELECT DISTINCT doc_id, p, z FROM cand WHERE g IN (SELECT gram FROM known)),
covered AS (SELECT t.doc_id, t.p, t.t, bool_or(h.p IS NOT NULL) AS gone, bool_or(h.p < t.p) AS inside FROM tok t LEFT JOIN hit h ON h.doc_id = t.doc_id AND t.p BETWEEN h.p AND h.z GROUP BY ALL),
shown AS (SELECT doc_id, p, CASE WHEN NOT gone THEN t WHEN coalesce(inside, FALSE) THEN '' ELSE '[PERSON]' END AS t FROM covered)
SELECT doc_id, md5(string_agg(t, '' ORDER BY p)) AS digest, CAST(count(*) FILTER (t = '[PERSON]') AS INT) AS people FROM shown GROUP BY doc_id""",
)
def g6_people(t: Trade) -> DataFrame:
    """Narratives with names of the master in whole, in part, in other case and in passing."""
    kind = F.col("c_custkey") % 3
    name = F.when(kind == 0, F.concat(F.lit("Khalid Al-Harbi "), "c_custkey")).when(kind == 1, "sara al-noor").otherwise(F.concat(F.lit("Omar "), "c_name", F.lit(" Bin Said")))
    case = F.col("doc_id") % 5
    told = (
        F.when(case == 0, " Disputed 500 SAR with manager Khalid.")
        .when(case == 1, " Told by Sara Al-Noor, khalid and Al.")
        .when(case == 2, F.concat(F.lit(" Omar Customer#"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(" Bin Said's case, a@b.com")))
        .when(case == 3, " Khalid Al Harbi Omar")
        .otherwise(" no one")
    )
    texts = t.documents.select("doc_id", privacy.redact_entities(F.concat("text", told)).alias("text"))
    people = t.customer.select(name.alias("name"))
    found = names.redact_people(texts, "text", people, "name")
    return found.select("doc_id", F.md5("text").alias("digest"), F.regexp_count("text", F.lit(r"\[PERSON\]")).alias("people"))


@query(
    "g6_opaque_tokens",
    """WITH old AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer WHERE c_acctbal < 0), fresh AS (SELECT c_custkey, (SELECT max(n) FROM old) + row_number() OVER (ORDER BY c_custkey) AS n
  FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM old))
SELECT c_custkey, n AS token_number, 'SUCC-' || lpad(CAST(n AS VARCHAR), CAST(greatest(length(CAST(n AS VARCHAR)), 4) AS INT), '0') AS token FROM (SELECT * FROM old UNION ALL SELECT * FROM fresh)""",
)
def g6_tokens(t: Trade) -> DataFrame:
    """Debtors were numbered in an earlier run; the others are numbered after them."""
    from tallyhouse.operators.identity import surrogate_id

    known = surrogate_id(t.customer.where("c_acctbal < 0").select("c_custkey"), ["c_custkey"], "token_number").select("c_custkey", "token_number")
    return privacy.extend_tokens(t.customer, known)


@query(
    "g6_aggregate_only",
    "SELECT c_nationkey, c_mktsegment, count(*) AS group_size, CASE WHEN count(*) >= 10 THEN round(sum(c_acctbal), 2) END AS balance FROM customer GROUP BY 1, 2",
)
def g6_groups(t: Trade) -> DataFrame:
    return privacy.aggregate_only(t.customer, ["c_nationkey", "c_mktsegment"], total("c_acctbal"), "balance", 10)


@query(
    "g7_role_view",
    """WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Ali' WHEN c_custkey % 3 = 1 THEN 'sara  al-noor' ELSE c_name END AS n,
  CASE WHEN c_custkey % 3 = 0 THEN 'A.' WHEN c_custkey % 3 = 1 THEN 'S.A.' ELSE 'C.' END || ' (' || c_custkey || ')' AS masked, c_acctbal AS s FROM customer)
SELECT role, c_custkey, CASE named WHEN 'Full' THEN n WHEN 'Masked' THEN masked END AS employee_name, CASE WHEN paid THEN s END AS basic_salary FROM p, (VALUES
  ('admin_system', 'Full', true), ('hr_executive', 'Full', true), ('hr_operations_manager', 'Full', false), ('payroll_manager', 'Masked', true),
  ('employee_relations_manager', 'Full', false), ('recruitment_manager', 'Masked', false), ('talent_manager', 'Masked', false), ('compliance_manager', 'Masked', false),
  ('project_manager', 'Hidden', false), ('viewer_executive_aggregate_only', 'Hidden', false), ('auditor_read_only', 'Masked', true)) r(role, named, paid)""",
)
def g7(t: Trade) -> DataFrame:
    """Every role's view of short, two-part and ordinary names; an unlisted column is seen by nobody."""
    kind = F.col("c_custkey") % 3
    name = F.when(kind == 0, "Ali").when(kind == 1, "sara  al-noor").otherwise(F.col("c_name"))
    people = t.customer.select("c_custkey", name.alias("employee_name"), F.col("c_acctbal").alias("basic_salary"), F.col("c_mktsegment").alias("home_address"))
    shown = None
    for role in privacy.ROLE_FIELDS:
        part = privacy.role_view(people, privacy.ROLE_FIELDS[role], "c_custkey").withColumn("role", F.lit(role))
        shown = part if shown is None else shown.unionByName(part, allowMissingColumns=True)
    return shown.select("role", "c_custkey", "employee_name", "basic_salary")


@query(
    "g8_small_groups",
    "SELECT c_nationkey, c_mktsegment, c_acctbal < 0 AS debtor, count(*) AS group_size, CASE WHEN count(*) >= 5 THEN round(sum(c_acctbal), 2) END AS balance FROM customer GROUP BY 1, 2, 3",
)
def g8(t: Trade) -> DataFrame:
    rows = t.customer.withColumn("debtor", F.col("c_acctbal") < 0)
    return privacy.aggregate_only(rows, ["c_nationkey", "c_mktsegment", "debtor"], total("c_acctbal"), "balance")


@query(
    "g8_two_way_table",
    """WITH rows AS (SELECT 'N' || c_nationkey AS nation, c_mktsegment || CASE WHEN c_acctbal < 0 THEN ' debtor' ELSE '' END AS segment, c_acctbal FROM customer WHERE c_nationkey <> 3 OR c_mktsegment = 'BUILDING'),
cells AS (SELECT coalesce('=' || nation, 'all') AS r, coalesce('=' || segment, 'all') AS c, nation, segment, count(*) AS n, round(sum(c_acctbal), 2) AS v FROM rows GROUP BY CUBE (nation, segment)),
best AS (SELECT p.r, p.c, a.c AS c2, b.r AS r2, row_number() OVER (PARTITION BY p.r, p.c ORDER BY (a.c = 'all')::INT + (b.r = 'all')::INT, a.n + b.n + d.n, a.c, b.r) AS k
  FROM cells p JOIN cells a ON a.r = p.r AND a.c <> p.c JOIN cells b ON b.c = p.c AND b.r <> p.r JOIN cells d ON d.r = b.r AND d.c = a.c WHERE p.n < 5),
hidden AS (SELECT r, c FROM cells WHERE n < 5 UNION SELECT r, c2 FROM best WHERE k = 1 UNION SELECT r2, c FROM best WHERE k = 1 UNION SELECT r2, c2 FROM best WHERE k = 1)
SELECT nation, segment, cells.r = 'all' AS nation_total, cells.c = 'all' AS segment_total, n AS group_size, CASE WHEN h.r IS NULL THEN v END AS balance,
  CASE WHEN n < 5 THEN 'small' WHEN h.r IS NOT NULL THEN 'protecting' ELSE 'shown' END AS state FROM cells LEFT JOIN hidden h ON h.r = cells.r AND h.c = cells.c""",
)
def g8_table(t: Trade) -> DataFrame:
    """A table with totals of both ways, in which small groups do not follow from their totals."""
    segment = F.concat("c_mktsegment", F.when(F.col("c_acctbal") < 0, " debtor").otherwise(""))
    rows = t.customer.where("c_nationkey <> 3 OR c_mktsegment = 'BUILDING'")
    rows = rows.select(F.concat(F.lit("N"), "c_nationkey").alias("nation"), segment.alias("segment"), "c_acctbal")
    return suppression.protected_table(rows, "nation", "segment", total("c_acctbal"), "balance")


@query(
    "g8_export_scope",
    """SELECT 'hr_executive' AS role, c_custkey, c_name AS employee_name, c_acctbal AS basic_salary, NULL AS c_nationkey, NULL AS c_mktsegment, NULL AS group_size, NULL AS basic_salary_total FROM customer
UNION ALL SELECT 'auditor_read_only', c_custkey, 'C. (' || c_custkey || ')', c_acctbal, NULL, NULL, NULL, NULL FROM customer
UNION ALL SELECT 'viewer_executive_aggregate_only', NULL, NULL, NULL, c_nationkey, c_mktsegment, count(*), CASE WHEN count(*) >= 5 THEN round(sum(c_acctbal), 2) END FROM customer GROUP BY c_nationkey, c_mktsegment""",
)
def g8_export(t: Trade) -> DataFrame:
    """Full rows, masked rows, totals of groups of five or more, and nothing for the last role."""
    people = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment", F.col("c_name").alias("employee_name"), F.col("c_acctbal").alias("basic_salary"))
    taken = None
    for role in ("hr_executive", "auditor_read_only", "viewer_executive_aggregate_only", "project_manager"):
        part = privacy.export(people, role, "c_custkey", ["c_nationkey", "c_mktsegment"]).withColumn("role", F.lit(role))
        taken = part if taken is None else taken.unionByName(part, allowMissingColumns=True)
    return taken.select("role", "c_custkey", "employee_name", "basic_salary", "c_nationkey", "c_mktsegment", "group_size", "basic_salary_total")


@query(
    "g9_pattern_scan",
    r"""WITH texts AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 1 THEN ' write to x@example.com.evil.org' WHEN 2 THEN ' write to y@example.com.' WHEN 3 THEN ' z@example.community.org' WHEN 4 THEN ' w@synthetic.local, v@else.net' ELSE '' END AS text FROM documents)
SELECT * FROM (SELECT doc_id, 'national_id' AS pattern, len(regexp_extract_all(text, '\b[12]\d{9}\b')) AS hits FROM texts UNION ALL SELECT doc_id, 'iban', len(regexp_extract_all(text, '(?i)\bSA\d{22}\b')) FROM texts
UNION ALL SELECT doc_id, 'email', count(*) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS x FROM texts) WHERE NOT regexp_matches(x, '@(example\.com|synthetic\.local)$') GROUP BY doc_id) WHERE hits > 0""",
)
def g9(t: Trade) -> DataFrame:
    """Every text gets an address: allowed ones, and some that only begin like an allowed one."""
    added = {1: " write to x@example.com.evil.org", 2: " write to y@example.com.", 3: " z@example.community.org", 4: " w@synthetic.local, v@else.net"}
    kind, tail = F.col("doc_id") % 5, F.lit("")
    for n, words in added.items():
        tail = F.when(kind == n, words).otherwise(tail)
    return privacy.scan_text(t.documents.withColumn("text", F.concat("text", tail)), "doc_id", "text")


@query(
    "g10_retention",
    """SELECT event_id, ts FROM events WHERE date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') > 20 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150)""",
)
def g10(t: Trade) -> DataFrame:
    held = t.events.where("event_type = 'error' and value > 150").select("user_id")
    return privacy.retention_due(t.events, F.to_date("ts"), 20, F.lit(date(2024, 1, 31)), held, "user_id").select("event_id", "ts")


@query(
    "g10_purge",
    """SELECT event_id, ts, user_id FROM events WHERE NOT (date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') > 20 AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150))""",
)
def g10_purge(t: Trade) -> DataFrame:
    """What a purge leaves of a stored table: held users stay, old days without any are dropped whole."""
    path = scratch_dir(t.spark, "retained")
    rows = t.events.select("event_id", "ts", "user_id", F.to_date("ts").alias("day"))
    rows.repartitionByRange("day", "event_id").write.partitionBy("day").parquet(path)
    held = t.events.where("event_type = 'error' and value > 150").select("user_id")
    retention.purge(t.spark, path, "day", 20, date(2024, 1, 31), held, "user_id")
    return t.spark.read.parquet(path).drop("day")


@query(
    "g11_evidence",
    """WITH r AS (SELECT o_orderkey, concat_ws('; ', CASE WHEN o_orderstatus = 'P' THEN 'missing field: reference' END, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'invalid o_orderpriority' END,
  CASE WHEN o_orderstatus <> 'F' THEN 'o_orderstatus must remain F' END, CASE WHEN o_totalprice > 400000 THEN 'restricted fields present: iban, passport' WHEN o_totalprice > 300000 THEN 'restricted fields present: iban' END) AS r FROM orders)
SELECT o_orderkey, CASE WHEN r = '' THEN 'pass' ELSE 'reject' END AS result, r AS reasons FROM r""",
)
def g11(t: Trade) -> DataFrame:
    price = F.col("o_totalprice")
    fields = F.when(price > 400000, F.array(F.lit("passport"), F.lit("name"), F.lit("iban"))).when(price > 300000, F.array(F.lit("iban"), F.lit("name"))).otherwise(F.array(F.lit("name")))
    records = t.orders.withColumn("reference", F.when(F.col("o_orderstatus") != "P", F.lit("given"))).withColumn("included", fields)
    return privacy.evidence_result(
        records, "o_orderkey", ["reference"], {"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"]}, {"o_orderstatus": "F"}, "included", ["iban", "passport"]
    )


@query(
    "g12_audit_records",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS timestamp, CAST(NULL AS VARCHAR) AS user_role, CAST(user_id AS VARCHAR) AS user_identifier_placeholder,
  CASE event_type WHEN 'error' THEN 'failed_access_attempt' WHEN 'purchase' THEN 'export_event' ELSE 'dashboard_view' END AS action_type, event_type AS module, CAST(NULL AS VARCHAR) AS resource_type,
  CASE WHEN event_type IN ('error', 'purchase') THEN 'Critical' ELSE 'Low' END AS sensitivity_level, CASE event_type WHEN 'error' THEN 'deny' ELSE 'allow' END AS decision, CAST(NULL AS VARCHAR) AS export_file_reference,
  CAST(NULL AS VARCHAR) AS source_ip_placeholder, CAST(NULL AS VARCHAR) AS reason_comment, CAST(365 AS INT) AS retention_period FROM events""",
)
def g12(t: Trade) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "error", "failed_access_attempt").when(kind == "purchase", "export_event").otherwise("dashboard_view")
    return audit_records(
        t.events, event_id=F.col("event_id"), timestamp=F.col("ts"), user_identifier_placeholder=F.col("user_id"), action_type=action, module=kind,
        decision=F.when(kind == "error", "deny").otherwise("allow"), retention_period=F.lit(365),
    )


@query(
    "g12_audit_stream",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS timestamp, event_type AS action_type, CASE WHEN event_type = 'purchase' THEN 'Critical' ELSE 'Low' END AS sensitivity_level, CAST(365 AS INT) AS retention_period
FROM (SELECT event_id, ts, CASE event_type WHEN 'purchase' THEN 'purchase' ELSE 'view' END AS event_type FROM events)""",
)
def g12_stream(t: Trade) -> DataFrame:
    """Access records as a stream in which many events come twice, some in the same and some in a later delivery."""
    feed, out, state = (scratch_dir(t.spark, p) for p in ("feed", "audit", "state"))
    kind = F.when(F.col("event_type") == "purchase", "export_event").otherwise("dashboard_view")
    records = audit_records(t.events, event_id=F.col("event_id"), timestamp=F.col("ts"), action_type=kind, retention_period=F.lit(365))
    again = records.where("CAST(event_id AS BIGINT) % 3 = 0")
    records.unionByName(again).write.parquet(feed)
    arriving = t.spark.readStream.schema(AUDIT_SCHEMA).parquet(feed)
    append_stream(arriving, out, state).awaitTermination()
    again.write.mode("append").parquet(feed)
    append_stream(arriving, out, state).awaitTermination()
    action = F.when(F.col("action_type") == "export_event", "purchase").otherwise("view")
    return t.spark.read.schema(AUDIT_SCHEMA).parquet(out).select("event_id", "timestamp", action.alias("action_type"), "sensitivity_level", "retention_period")
