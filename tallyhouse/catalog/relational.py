"""Generic operators on the trade tables: sources, expressions, joins, aggregates, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.catalog.registry import Catalog, Trade
from tallyhouse.functions import is_blank, minute_boundaries, money_text, percent, ratio, say, tally, total
from tallyhouse.operators import relational as rel
from tallyhouse.operators.identity import surrogate_id
from tallyhouse.operators.rules import Rule, flag_rows, stack
from tallyhouse.operators.search import SearchIndex
from tallyhouse.operators.tables import KeyedTable, write_snapshot
from tallyhouse.session import scratch_dir
from tallyhouse.sources import intake
from tallyhouse.sources.derived_hr import derive

catalog = Catalog()
query = catalog.query

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


# ------------------------------------------------------------ sources, sinks, tables
@query("s1_csv_source", "SELECT * FROM customer")
def csv_source(t: Trade) -> DataFrame:
    """The file has its columns in another order than the schema declares."""
    path = scratch_dir(t.spark, "csv")
    t.customer.select("c_mktsegment", "c_acctbal", "c_custkey", "c_name", "c_nationkey").write.option("header", True).csv(path)
    return intake.read_csv(t.spark, path, CUSTOMER)


@query(
    "s5_load_gate",
    """SELECT 'career_paths' AS name, count(*) AS n FROM customer UNION ALL SELECT 'training_catalog', count(*) FROM supplier
UNION ALL SELECT 'production needs employees', 1""",
)
def load_gate(t: Trade) -> DataFrame:
    """Two tables were delivered: both load, the others are skipped, and a production load is refused."""
    path = scratch_dir(t.spark, "silver")
    for name in ("career_paths", "training_catalog"):
        derive(t.spark, t.folder, name).write.parquet(f"{path}/{name}.parquet")
    found = intake.load_tables(t.spark, path)
    counts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in found.items()]
    try:
        intake.load_tables(t.spark, path, production=True)
    except intake.IntakeError as refused:
        counts.append(t.spark.range(1).select(F.lit(f"production needs {str(refused).split(chr(39))[1]}").alias("name"), F.lit(1).cast("bigint").alias("n")))
    return stack(*counts)


@query(
    "s2_text_layer",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer",
)
def text_layer(t: Trade) -> DataFrame:
    path = scratch_dir(t.spark, "bronze")
    intake.write_text_layer(t.customer, path)
    return t.spark.read.parquet(path)


@query(
    "s3_typed_layer",
    """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS price,
  TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN '31.12.1999' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS DATE) AS ordered,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END AS stamped, o_orderpriority = '1-URGENT' AS urgent FROM orders""",
)
def typed_layer(t: Trade) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = t.orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("price"),
        F.when(F.col("o_orderstatus") == "P", "31.12.1999").otherwise(day).alias("ordered"),
        F.when(F.col("o_orderstatus") == "F", day).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("stamped"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "True").otherwise("False").alias("urgent"),
    )
    fields = [("o_orderkey", "bigint"), ("price", "double"), ("ordered", "date"), ("stamped", "timestamp_ntz"), ("urgent", "boolean")]
    return intake.typed_layer(text, fields)


@query("s4_parquet_table", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def parquet_table(t: Trade) -> DataFrame:
    intake.register({"trade_orders": t.orders})
    return t.spark.table("trade_orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def _negative_balance(t: Trade) -> DataFrame:
    rule = Rule("Negative Balance", "Warning", "Call customer", say("Balance is {b}", b=money_text("c_acctbal")), F.col("c_acctbal") < 0)
    return flag_rows(t.customer, [rule], "c_custkey", "c_name")


_NEGATIVE = """SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_name AS entity_name, 'Negative Balance' AS issue_type,
  'Balance is ' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS description, 'Warning' AS severity, 'Call customer' AS recommended_action FROM customer WHERE c_acctbal < {limit}"""


@query("s6_empty_result", _NEGATIVE.format(limit=-1000000))
def empty_result(t: Trade) -> DataFrame:
    """A rule nobody breaks still gives a frame with the full issue schema."""
    return _negative_balance(t).where(F.col("description").isNull())


@query("s7_issue_sink", _NEGATIVE.format(limit=0))
def issue_sink(t: Trade) -> DataFrame:
    path = scratch_dir(t.spark, "gold")
    issues = _negative_balance(t)
    intake.write_issues(issues, path)
    return t.spark.read.parquet(path).toDF(*issues.columns)


@query(
    "s8_view_layer",
    """SELECT c_mktsegment, count(*) AS n, round(sum(spent), 2) AS spent FROM (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
)
def view_layer(t: Trade) -> DataFrame:
    intake.register({"v_orders": t.orders, "v_customer": t.customer})
    t.spark.sql("SELECT o_custkey, sum(o_totalprice) AS spent FROM v_orders WHERE o_orderstatus = 'F' GROUP BY o_custkey").createOrReplaceTempView("v_spent")
    return t.spark.sql("SELECT c_mktsegment, count(*) AS n, round(sum(spent), 2) AS spent FROM v_spent JOIN v_customer ON c_custkey = o_custkey GROUP BY c_mktsegment")


@query(
    "s9_insert_missing",
    "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 'Checked' ELSE 'Unknown' END AS state FROM customer UNION ALL SELECT NULL, 'Unknown'",
)
def s9(t: Trade) -> DataFrame:
    """A stored table, all customers and a NULL key inserted twice: the second time nothing is missing."""
    table = KeyedTable(t.spark, scratch_dir(t.spark, "keyed"), ["c_custkey"])
    table.create(t.customer.where("c_acctbal >= 0").select("c_custkey", F.lit("Checked").alias("state")))
    none = t.customer.limit(1).select(F.lit(None).cast("bigint").alias("c_custkey"))
    incoming = t.customer.select("c_custkey").unionByName(none).withColumn("state", F.lit("Unknown"))
    table.insert(incoming)
    table.insert(incoming)
    return table.read()


@query(
    "s11_update_by_key",
    "SELECT c_custkey, coalesce(s_name, c_name) AS c_name, coalesce(s_acctbal, c_acctbal) AS c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
)
def s11(t: Trade) -> DataFrame:
    """A stored table updated in place: only the buckets with suppliers' keys are rewritten."""
    table = KeyedTable(t.spark, scratch_dir(t.spark, "keyed"), ["c_custkey"])
    table.create(t.customer.select("c_custkey", "c_name", "c_acctbal"))
    table.update(t.supplier.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal")))
    return table.read()


@query(
    "s10_snapshot",
    """SELECT (SELECT round(sum(o_totalprice), 2) FROM orders) AS revenue, (SELECT count(*) FROM customer) AS customers,
  (SELECT count(*) FROM events) AS events, (SELECT max(o_orderdate) FROM orders) AS last_order""",
)
def s10(t: Trade) -> DataFrame:
    row = rel.side_by_side(
        t.orders.agg(total("o_totalprice").alias("revenue"), F.max("o_orderdate").alias("last_order")),
        t.customer.agg(F.count(F.lit(1)).alias("customers")),
        t.events.agg(F.count(F.lit(1)).alias("events")),
    )
    path = scratch_dir(t.spark, "snapshot")
    write_snapshot(row, path)
    return t.spark.read.parquet(path)


@query(
    "s_lit_spine",
    """SELECT p AS priority, count(o_orderkey) AS orders FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NEVER')) v(p)
LEFT JOIN orders ON o_orderpriority = p GROUP BY 1""",
)
def s_lit(t: Trade) -> DataFrame:
    spine = t.spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("9-NEVER",)], "priority string")
    counts = t.orders.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counts, "priority", "left").select("priority", F.coalesce("n", F.lit(0)).alias("orders"))


@query(
    "s_map_canonical",
    """SELECT trim(c_name) AS customer_name, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS segment, upper(c_mktsegment) AS segment_code,
  CASE WHEN c_acctbal < 0 THEN 'Debit' ELSE 'Credit' END AS side, CAST(c_acctbal AS DECIMAL(18,2)) AS balance, coalesce(nullif(c_nationkey, 0), -1) AS nation,
  c_acctbal * 2 AS doubled, CAST(c_custkey AS VARCHAR) AS customer_id FROM customer""",
)
def s_map(t: Trade) -> DataFrame:
    mapping = {
        "customer_name": "TRIM(c_name)",
        "segment": "INITCAP(LOWER(c_mktsegment))",
        "segment_code": "UPPER(c_mktsegment)",
        "side": "CASE WHEN c_acctbal < 0 THEN 'Debit' ELSE 'Credit' END",
        "balance": "CAST(c_acctbal AS DECIMAL(18,2))",
        "nation": "COALESCE(NULLIF(c_nationkey, 0), -1)",
        "doubled": "c_acctbal * 2",
        "customer_id": "CAST(c_custkey AS STRING)",
    }
    return intake.map_columns(t.customer, mapping)


# ------------------------------------------------------------ projections and expressions
@query("p1_filter_blank", "SELECT doc_id, lang AS language FROM documents WHERE n_chars < 200 OR text IS NULL OR trim(text) = '' OR source IS NULL")
def p1(t: Trade) -> DataFrame:
    return t.documents.where((F.col("n_chars") < 200) | is_blank("text") | F.col("source").isNull()).select("doc_id", F.col("lang").alias("language"))


@query(
    "p2_predicates",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'F' AND o_totalprice BETWEEN 1000 AND 90000
AND o_custkey NOT IN (1, 2, 3)""",
)
def p2(t: Trade) -> DataFrame:
    keep = (
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        & (F.col("o_orderstatus") != "F")
        & F.col("o_totalprice").between(1000, 90000)
        & ~F.col("o_custkey").isin(1, 2, 3)
    )
    return t.orders.where(keep).select("o_orderkey", "o_totalprice")


@query(
    "p3_case_bands",
    """SELECT band, channel, count(*) AS n FROM (SELECT CASE WHEN o_totalprice >= 400000 THEN 'top' WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 50000 THEN 'mid' ELSE 'low' END AS band,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'Other' END AS channel FROM orders) GROUP BY 1, 2""",
)
def p3(t: Trade) -> DataFrame:
    price = F.col("o_totalprice")
    band = F.when(price >= 400000, "top").when(price >= 200000, "high").when(price >= 50000, "mid").otherwise("low")
    channel = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderpriority")).otherwise("Other")
    return t.orders.groupBy(band.alias("band"), channel.alias("channel")).agg(F.count(F.lit(1)).alias("n"))


@query("p4_drop_column", "SELECT * EXCLUDE (c_acctbal) FROM customer")
def p4(t: Trade) -> DataFrame:
    return t.customer.drop("c_acctbal")


@query(
    "p5_text_building",
    """SELECT o_orderkey, 'Order ' || o_orderkey || ' of ' || strftime(o_orderdate, '%Y-%m-%d') || ' costs ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ' (' ||
  coalesce(nullif(o_orderstatus, 'P'), 'N/A') || ')' AS description FROM orders""",
)
def p5(t: Trade) -> DataFrame:
    text = say(
        "Order {key} of {day} costs {price} ({state})",
        key="o_orderkey",
        day=F.date_format("o_orderdate", "yyyy-MM-dd"),
        price=money_text("o_totalprice"),
        state=F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("N/A")),
    )
    return t.orders.select("o_orderkey", text.alias("description"))


@query("p6_default_labels", "SELECT doc_id, coalesce(CAST(quality AS VARCHAR), CAST(toxic AS VARCHAR), 'Unlabelled') AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def p6(t: Trade) -> DataFrame:
    label = F.coalesce(F.col("quality").cast("string"), F.col("toxic").cast("string"), F.lit("Unlabelled"))
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", label.alias("quality"))


@query(
    "p7_normalise_category",
    """SELECT CASE lower(trim(substr(o_orderpriority, 3))) WHEN 'urgent' THEN 'High' WHEN 'high' THEN 'High' WHEN 'medium' THEN 'Medium' WHEN 'low' THEN 'Low' ELSE 'Unknown' END AS priority,
  count(*) AS n FROM orders GROUP BY 1""",
)
def p7(t: Trade) -> DataFrame:
    text = F.lower(F.trim(F.substring("o_orderpriority", 3, 20)))
    level = F.when(text.isin("urgent", "high"), "High").when(text == "medium", "Medium").when(text == "low", "Low").otherwise("Unknown")
    return t.orders.groupBy(level.alias("priority")).agg(F.count(F.lit(1)).alias("n"))


def parametrised(orders: DataFrame, statuses: list[str], sla_days: dict[str, int], minimum: float, enabled: bool) -> DataFrame:
    """Settings enter the plan as literals."""
    days = F.lit(10)
    for priority, limit in sla_days.items():
        days = F.when(F.col("o_orderpriority") == priority, F.lit(limit)).otherwise(days)
    keep = F.col("o_orderstatus").isin(statuses) & (F.col("o_totalprice") >= minimum) & F.lit(enabled)
    return orders.where(keep).select("o_orderkey", days.alias("sla_days"))


@query(
    "p8_parameters",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 5 ELSE 10 END AS sla_days FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice >= 250000""",
)
def p8(t: Trade) -> DataFrame:
    return parametrised(t.orders, ["O", "P"], {"1-URGENT": 2, "2-HIGH": 5}, 250000.0, True)


@query(
    "p9_guarded_math",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice / nullif(l_quantity - 1, 0) AS unit, round(l_extendedprice, 0) AS rounded, CASE WHEN l_tax = 0 THEN 0 ELSE l_discount / l_tax END AS share,
  abs(l_discount - l_tax) AS gap, greatest(l_discount - 0.05, 0) AS excess FROM lineitem""",
)
def p9(t: Trade) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        (F.col("l_extendedprice") / F.nullif(q - 1, F.lit(0.0))).alias("unit"),
        F.round("l_extendedprice", 0).alias("rounded"),
        ratio("l_discount", "l_tax").alias("share"),
        F.abs(F.col("l_discount") - F.col("l_tax")).alias("gap"),
        F.greatest(F.col("l_discount") - 0.05, F.lit(0.0)).alias("excess"),
    )


@query(
    "p10_dates",
    """SELECT event_id, last_day(CAST(ts AS DATE)) AS month_end, CAST(ts AS DATE) + 30 AS due, CAST(CAST(ts AS DATE) + INTERVAL 1 MONTH AS DATE) AS next_month,
  date_diff('day', DATE '2023-12-25', CAST(ts AS DATE)) AS age, dayname(ts) AS weekday, strftime(ts, '%Y-%m') AS period,
  date_diff('minute', date_trunc('day', ts), ts) AS minute FROM events""",
)
def p10(t: Trade) -> DataFrame:
    day = F.to_date("ts")
    return t.events.select(
        "event_id",
        F.last_day(day).alias("month_end"),
        F.date_add(day, 30).alias("due"),
        F.add_months(day, 1).alias("next_month"),
        F.datediff(day, F.lit("2023-12-25").cast("date")).cast("bigint").alias("age"),
        F.date_format("ts", "EEEE").alias("weekday"),
        F.date_format("ts", "yyyy-MM").alias("period"),
        minute_boundaries(day.cast("timestamp_ntz"), "ts").alias("minute"),
    )


@query(
    "p11_casts",
    """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS key_text, CAST(o_orderdate AS DATE) AS day, CAST(o_custkey AS DOUBLE) AS cust, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS price_text,
  o_orderstatus = 'F' AS done, CAST(NULL AS VARCHAR) AS note, CAST('2024-01' || '-01' AS DATE) AS anchor FROM orders""",
)
def p11(t: Trade) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        F.col("o_orderkey").cast("string").alias("key_text"),
        F.col("o_orderdate").cast("date").alias("day"),
        F.col("o_custkey").cast("double").alias("cust"),
        money_text("o_totalprice").alias("price_text"),
        (F.col("o_orderstatus") == "F").cast("boolean").alias("done"),
        F.lit(None).cast("string").alias("note"),
        F.concat(F.lit("2024-01"), F.lit("-01")).cast("date").alias("anchor"),
    )


# ------------------------------------------------------------ joins
@query("j1_inner", "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j1(t: Trade) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("j2_left", "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j2(t: Trade) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")


@query(
    "j3_full",
    """SELECT coalesce(l_orderkey, o_orderkey) AS order_key, coalesce(returned, 0) AS returned, o_orderkey IS NOT NULL AS urgent
FROM (SELECT l_orderkey, count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) FULL JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') ON l_orderkey = o_orderkey""",
)
def j3(t: Trade) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    keyed = urgent.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("urgent"))
    return rel.full_join_unique(returned, keyed, "l_orderkey").select(
        F.col("l_orderkey").alias("order_key"), F.coalesce("n", F.lit(0)).alias("returned"), F.coalesce("urgent", F.lit(False)).alias("urgent")
    )


@query(
    "j4_one_row_frames",
    """SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS debtors, (SELECT round(avg(l_discount), 4) FROM lineitem) AS discount,
  (SELECT max(ts) FROM events WHERE event_type = 'nothing') AS never""",
)
def j4(t: Trade) -> DataFrame:
    return rel.side_by_side(
        t.orders.agg(F.count(F.lit(1)).alias("orders")),
        t.customer.agg(tally(F.col("c_acctbal") < 0).alias("debtors")),
        t.lineitem.agg(F.round(F.avg("l_discount"), 4).alias("discount")),
        t.events.where("event_type = 'nothing'").agg(F.max("ts").alias("never")),
    )


@query(
    "j5_range_days",
    """SELECT d AS day, count(*) AS open_orders FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 3 AS e FROM orders) o
JOIN (SELECT CAST(unnest(generate_series((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders) + INTERVAL 4 DAY, INTERVAL 1 DAY)) AS DATE) AS d) c ON d BETWEEN s AND e GROUP BY 1""",
)
def j5(t: Trade) -> DataFrame:
    """Calendar days an order is open, generated from the row."""
    from tallyhouse.operators.temporal import expand_days

    start = F.col("o_orderdate").cast("date")
    days = expand_days(t.orders.select("o_orderdate"), start, F.date_add(start, 3), "day")
    return days.groupBy("day").agg(F.count(F.lit(1)).alias("open_orders"))


@query("j6_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j6(t: Trade) -> DataFrame:
    return rel.keep_members(t.customer, "c_custkey", t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey")).select("c_custkey", "c_name")


@query("j7_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def j7(t: Trade) -> DataFrame:
    return rel.drop_members(t.customer, "c_custkey", t.events.select("user_id")).select("c_custkey", "c_name")


@query(
    "j7_anti_null_rule",
    """SELECT doc_id, quality FROM (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)) WHERE quality IS NULL OR quality NOT IN (SELECT toxic FROM labels WHERE toxic = 1)""",
)
def j7_nulls(t: Trade) -> DataFrame:
    """NOT IN where a NULL value passes, as an explicit choice."""
    rows = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rel.drop_members(rows, "quality", t.labels.where("toxic = 1").select("toxic"), null_passes=True)


@query(
    "j8_composite_key",
    """SELECT p_partkey, planned, coalesce(n, 0) AS shipped FROM (SELECT p_partkey, p_size AS planned FROM part)
LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2) ON l_partkey = p_partkey AND l_suppkey = planned""",
)
def j8(t: Trade) -> DataFrame:
    shipped = t.lineitem.where("l_returnflag = 'N'").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    plan = t.part.select("p_partkey", F.col("p_size").alias("planned"))
    return plan.join(shipped, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_suppkey") == F.col("planned")), "left").select(
        "p_partkey", "planned", F.coalesce("n", F.lit(0)).alias("shipped")
    )


@query(
    "j9_repeated_rows",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b
WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber GROUP BY b.l_orderkey, b.l_linenumber HAVING count(*) > 1)""",
)
def j9(t: Trade) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    rows = t.lineitem.select(*keys, "l_partkey", "l_suppkey", "l_quantity")
    return rows.join(rel.repeated_keys(t.lineitem, keys), keys, "left_semi")


@query(
    "j10_previous_period",
    """WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS m, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)
SELECT a.o_custkey, strftime(a.m, '%Y-%m') AS period, a.v AS current_value, b.v AS previous_value, round(a.v - b.v, 2) AS change FROM m a JOIN m b ON a.o_custkey = b.o_custkey AND b.m = a.m - INTERVAL 1 MONTH""",
)
def j10(t: Trade) -> DataFrame:
    """Each customer's month against the month before: one row per customer and month, so ``lag`` replaces a self join."""
    months = t.orders.groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("m")).agg(total("o_totalprice").alias("v"))
    w = Window.partitionBy("o_custkey").orderBy("m")
    paired = months.withColumn("before", F.lag("v").over(w)).withColumn("before_m", F.lag("m").over(w))
    return paired.where(F.add_months("before_m", 1) == F.col("m")).select(
        "o_custkey",
        F.date_format("m", "yyyy-MM").alias("period"),
        F.col("v").alias("current_value"),
        F.col("before").alias("previous_value"),
        F.round(F.col("v") - F.col("before"), 2).alias("change"),
    )


@query("j11_scalar_subquery", "SELECT o_orderkey, o_orderdate FROM orders WHERE date_trunc('month', o_orderdate) = (SELECT max(date_trunc('month', o_orderdate)) FROM orders)")
def j11(t: Trade) -> DataFrame:
    month = F.date_trunc("month", "o_orderdate")
    return t.orders.where(month == t.orders.agg(F.max(month)).scalar()).select("o_orderkey", "o_orderdate")


@query(
    "j12_group_total",
    """SELECT c_mktsegment, count(*) AS customers, coalesce((SELECT round(sum(o_totalprice), 2) FROM orders JOIN customer x ON x.c_custkey = o_custkey WHERE o_orderstatus = 'P' AND x.c_mktsegment = customer.c_mktsegment), 0) AS pending
FROM customer GROUP BY c_mktsegment""",
)
def j12(t: Trade) -> DataFrame:
    groups = t.customer.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("customers"))
    facts = t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return rel.add_group_total(groups, ["c_mktsegment"], facts, total("o_totalprice"), "pending")


@query(
    "j13_chain",
    """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def j13(t: Trade) -> DataFrame:
    """Lines are summed per order and orders per customer before the chain grows wide."""
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    per_customer = t.orders.join(per_order, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("v").alias("v"))
    return (
        per_customer.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy("r_name", "n_name")
        .agg(F.round(F.sum("v"), 4).alias("revenue"))
    )


# ------------------------------------------------------------ aggregates
@query("a1_counts", "SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders")
def a1(t: Trade) -> DataFrame:
    return t.orders.agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_custkey").alias("customers"))


@query(
    "a2_conditional_counts",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS filled, count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_custkey END) AS pending_customers,
  round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS open_value FROM orders GROUP BY 1""",
)
def a2(t: Trade) -> DataFrame:
    status = F.col("o_orderstatus")
    return t.orders.groupBy("o_orderpriority").agg(
        tally(status == "O").alias("open"),
        tally(status == "F").alias("filled"),
        F.count_distinct(F.when(status == "P", F.col("o_custkey"))).alias("pending_customers"),
        total(F.when(status == "O", F.col("o_totalprice"))).alias("open_value"),
    )


@query(
    "a3_sums",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(avg(l_discount), 6) AS discount,
  min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, coalesce(sum(CASE WHEN l_tax > 1 THEN l_tax END), 0) AS over_tax FROM lineitem GROUP BY 1, 2""",
)
def a3(t: Trade) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        total("l_quantity").alias("quantity"),
        total("l_extendedprice").alias("price"),
        total(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
        total(F.when(F.col("l_tax") > 1, F.col("l_tax"))).alias("over_tax"),
    )


@query(
    "a4_ratio_policies",
    """SELECT o_orderpriority, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 2) AS filled_pct, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*) AS filled_share,
  CASE WHEN count(*) FILTER (o_totalprice < 0) = 0 THEN 100 ELSE 0 END AS none_pct FROM orders GROUP BY 1""",
)
def a4(t: Trade) -> DataFrame:
    filled, rows, none = tally(F.col("o_orderstatus") == "F"), F.count(F.lit(1)), tally(F.col("o_totalprice") < 0)
    return t.orders.groupBy("o_orderpriority").agg(
        percent(filled, rows).alias("filled_pct"), ratio(filled, rows).alias("filled_share"), percent(none, none, 100.0).cast("int").alias("none_pct")
    )


@query(
    "a5_group_by",
    """SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, o_totalprice > 250000 AS big, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY ALL""",
)
def a5(t: Trade) -> DataFrame:
    return t.orders.groupBy(
        "o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("bigint").alias("y"), (F.col("o_totalprice") > 250000).alias("big")
    ).agg(F.count(F.lit(1)).alias("n"), total("o_totalprice").alias("v"))


@query(
    "a6_stacked_dimensions",
    """SELECT 'status' AS category, o_orderstatus AS metric_value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), count(*) FROM orders GROUP BY 2""",
)
def a6(t: Trade) -> DataFrame:
    dims = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "year": F.year("o_orderdate")}
    return rel.stacked_counts(t.orders.select("o_orderstatus", "o_orderpriority", "o_orderdate"), dims, F.count(F.lit(1)), "n")


@query(
    "a7_measures_to_rows",
    """SELECT 'Price' AS component, round(sum(l_extendedprice), 2) AS amount FROM lineitem UNION ALL SELECT 'Discount', round(sum(l_extendedprice * l_discount), 4) FROM lineitem
UNION ALL SELECT 'Tax', round(sum(l_extendedprice * l_tax), 4) FROM lineitem UNION ALL SELECT 'Quantity', round(sum(l_quantity), 2) FROM lineitem""",
)
def a7(t: Trade) -> DataFrame:
    row = t.lineitem.agg(
        total("l_extendedprice").alias("price"),
        total(F.col("l_extendedprice") * F.col("l_discount"), 4).alias("discount"),
        total(F.col("l_extendedprice") * F.col("l_tax"), 4).alias("tax"),
        total("l_quantity").alias("quantity"),
    )
    labels = {"price": "Price", "discount": "Discount", "tax": "Tax", "quantity": "Quantity"}
    return rel.measures_to_rows(row, labels, "component", "amount")


@query("a8_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1 HAVING count(*) > 12 AND v > 1000000")
def a8(t: Trade) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), total("o_totalprice").alias("v")).where("n > 12 AND v > 1000000")


@query(
    "a9_filtered_distinct",
    """SELECT o_orderstatus, count(DISTINCT o_custkey) FILTER (o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT user_id FROM events)) AS active_urgent FROM orders GROUP BY 1""",
)
def a9(t: Trade) -> DataFrame:
    rows = rel.with_member_flag(t.orders.select("o_orderstatus", "o_custkey", "o_orderpriority"), "o_custkey", t.events.select("user_id"), "active")
    hit = F.when((F.col("o_orderpriority") == "1-URGENT") & F.col("active"), F.col("o_custkey"))
    return rows.groupBy("o_orderstatus").agg(F.count_distinct(hit).alias("active_urgent"))


@query("a10_bool_or", "SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS any_urgent FROM orders GROUP BY 1")
def a10(t: Trade) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"))


@query(
    "a11_distinct_arrays",
    "SELECT DISTINCT 'o_orderstatus' AS field, o_orderstatus AS value FROM orders UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT DISTINCT 'o_orderdate', strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') FROM orders",
)
def a11(t: Trade) -> DataFrame:
    """Distinct values as rows, so that their number has no bound."""
    return rel.distinct_values(t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd")), ["o_orderstatus", "o_orderpriority", "o_orderdate"])


# ------------------------------------------------------------ windows, order, sets
@query(
    "w1_latest_record",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice) = 1""",
)
def w1(t: Trade) -> DataFrame:
    order = [F.desc("l_shipdate"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_extendedprice")]
    return rel.latest_record(t.lineitem, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")


@query("w2_surrogate_id", "SELECT row_number() OVER (ORDER BY o_orderdate, o_totalprice, o_orderkey) AS row_id, o_orderkey FROM orders")
def w2(t: Trade) -> DataFrame:
    rows = t.orders.select("o_orderdate", "o_totalprice", "o_orderkey")
    return surrogate_id(rows, ["o_orderdate", "o_totalprice", "o_orderkey"], "row_id").select("row_id", "o_orderkey")


@query("w3_share_of_total", "SELECT o_orderstatus, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 2) AS pct FROM orders GROUP BY 1")
def w3(t: Trade) -> DataFrame:
    """The whole-set count is a window over the few groups, not over the rows."""
    groups = t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return groups.withColumn("pct", percent("n", F.sum("n").over(Window.partitionBy(F.lit(1)))))


@query("o1_sort", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey")
def o1(t: Trade) -> DataFrame:
    return t.customer.select("c_custkey", "c_acctbal").orderBy(F.desc_nulls_last("c_acctbal"), F.asc_nulls_last("c_custkey"))


@query(
    "o2_case_rank_sort",
    "SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END, n DESC",
)
def o2(t: Trade) -> DataFrame:
    counts = t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(2), F.desc("n"))


@query(
    "o3_top_changes",
    "SELECT o_orderkey, round(o_totalprice - 250000, 2) AS delta FROM orders ORDER BY abs(o_totalprice - 250000) DESC, o_orderkey LIMIT 100",
)
def o3(t: Trade) -> DataFrame:
    gap = F.col("o_totalprice") - 250000
    return rel.top_k(t.orders, 100, F.abs(gap).desc(), F.asc("o_orderkey")).select("o_orderkey", F.round(gap, 2).alias("delta"))


@query(
    "o4_browse_page",
    """SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(concat_ws(' ', c_custkey, c_name, c_mktsegment)), 'build') ORDER BY c_name LIMIT 5 OFFSET 10""",
)
def o4(t: Trade) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    return rel.browse(rows, ["c_custkey", "c_name", "c_mktsegment"], "Build", [F.asc("c_name")], page=2)


@query(
    "o4_search_page",
    """WITH hits AS (SELECT l_orderkey, l_linenumber, o_orderpriority, l_returnflag || ' ' || c_name AS who, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS n
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE contains(lower(concat_ws(' ', o_orderpriority, l_returnflag || ' ' || c_name)), 'n customer#00000001'))
SELECT l_orderkey, l_linenumber, o_orderpriority, who FROM hits WHERE n BETWEEN 6 AND 10""",
)
def o4_search(t: Trade) -> DataFrame:
    """The second page of a search in line items, found in a trigram index and by the last key of the first page."""
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.select("l_orderkey", "l_linenumber", "o_orderpriority", F.concat("l_returnflag", F.lit(" "), "c_name").alias("who"))
    index = SearchIndex(t.spark, scratch_dir(t.spark, "search"), ["l_orderkey", "l_linenumber"], ["o_orderpriority", "who"])
    index.build(rows)
    last = index.page("N Customer#00000001", size=5).collect()[-1:]  # one page
    return index.page("N Customer#00000001", after=tuple(last[0][:2]) if last else None, size=5)


@query(
    "s_union_all",
    """SELECT 'order:' || o_orderkey AS id, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS day FROM orders UNION ALL SELECT 'event:' || event_id, value, CAST(ts AS DATE) FROM events
UNION ALL SELECT 'customer:' || c_custkey, c_acctbal, NULL FROM customer""",
)
def s_union(t: Trade) -> DataFrame:
    orders = t.orders.select(say("order:{o_orderkey}").alias("id"), F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("day"))
    events = t.events.select(say("event:{event_id}").alias("id"), F.col("value").alias("amount"), F.to_date("ts").alias("day"))
    people = t.customer.select(say("customer:{c_custkey}").alias("id"), F.col("c_acctbal").alias("amount"), F.lit(None).cast("date").alias("day"))
    return orders.unionByName(events).unionByName(people)
