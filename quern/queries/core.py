"""Scans, filters, joins, aggregates, sorts, set operations, functions and constraints on the star schema."""

from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import constraints as C
from ..operators import relational as R
from ..session import register, table
from . import Theme

q = Theme()
MONEY = "decimal(18,2)"


def _t(spark, d, name):
    return table(spark, d, name)


@q("ag1_customer_value", """
SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS n_orders, CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'P' LEFT JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY c_custkey, c_name""")
def ag1(spark, d):
    """Orders and money of each customer, those without orders included: lines are summed by order before they meet customers."""
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast(MONEY) * F.col("l_extendedprice").cast(MONEY)).alias("m"))
    orders = _t(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    per = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("m").alias("m"))
    return _t(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).cast("long").alias("n_orders"), F.coalesce("m", F.lit(Decimal(0))).cast("double").alias("total"))


@q("ag2_average_column", "SELECT CAST(avg(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS avg_price FROM lineitem")
def ag2(spark, d):
    return _t(spark, d, "lineitem").agg((F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double") / F.count("l_extendedprice")).alias("avg_price"))


@q("ag3_filtered_average", "SELECT round(avg(s_acctbal), 6) AS avg_s_acctbal FROM supplier WHERE s_acctbal >= 5000")
def ag3(spark, d):
    return R.average(_t(spark, d, "supplier"), "s_acctbal", 5000).select(F.round("avg_s_acctbal", 6).alias("avg_s_acctbal"))


@q("ag3_average_of_none", "SELECT avg(s_acctbal) AS avg_s_acctbal FROM supplier WHERE s_acctbal >= 1e12")
def ag3_none(spark, d):
    return R.average(_t(spark, d, "supplier"), "s_acctbal", 1e12)


@q("ag4_status_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def ag4(spark, d):
    return _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@q("ag5_ordered_digest", "SELECT md5(string_agg(lpad(CAST(o_orderkey AS VARCHAR), 20, '0'), ',' ORDER BY o_orderkey)) AS digest FROM orders")
def ag5(spark, d):
    return R.digest(_t(spark, d, "orders"), "o_orderkey")


@q("ag6_order_totals", "SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS items FROM lineitem GROUP BY l_orderkey")
def ag6(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast(MONEY) * F.col("l_extendedprice").cast(MONEY)).cast("double").alias("total"), F.count("*").alias("items"))


@q("ag6_order_total_function", "SELECT CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total, count(*) AS items FROM lineitem WHERE l_orderkey = 7")
def ag6_function(spark, d):
    register(spark, d, "lineitem")
    return R.bound_sql(spark, "SELECT CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total, count(*) AS items FROM lineitem WHERE l_orderkey = :id", {"id": 7})


@q("ag7_conditional_total", "SELECT o_custkey, CAST(coalesce(sum(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 END), 0) AS BIGINT) AS done FROM orders GROUP BY o_custkey")
def ag7(spark, d):
    return _t(spark, d, "orders").groupBy("o_custkey").agg(F.coalesce(F.sum(F.when(F.col("o_orderstatus").isin("F", "O"), 1)), F.lit(0)).cast("long").alias("done"))


@q("ag22_rows_by_partition", "SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS n FROM orders GROUP BY ALL")
def ag22(spark, d):
    return _t(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), F.quarter("o_orderdate").cast("long").alias("q")).agg(F.count("*").alias("n"))


@q("sc1_scan", "SELECT * FROM nation")
def sc1(spark, d):
    return _t(spark, d, "nation")


@q("sc6_positional_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
def sc6(spark, d):
    return _t(spark, d, "customer").where("c_custkey = 42")


@q("sc7_column_scan", "SELECT l_discount FROM lineitem")
def sc7(spark, d):
    return _t(spark, d, "lineitem").select("l_discount")


@q("sc13_range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 1100")
def sc13(spark, d):
    return _t(spark, d, "orders").where(F.col("o_orderkey").between(1000, 1100)).select("o_orderkey", "o_totalprice").orderBy("o_orderkey")


@q("sc33_generated_series", "SELECT g AS id, CAST(g % 7 AS BIGINT) AS k, 'item' || lpad(CAST(g AS VARCHAR), 5, '0') AS name, ['a', 'b', 'c', 'd'][1 + g % 4] AS tag FROM range(1, 1001) t(g)")
def sc33(spark, d):
    g = spark.range(1, 1001)
    return g.select("id", (F.col("id") % 7).alias("k"), F.concat(F.lit("item"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("name"), F.element_at(F.array(*map(F.lit, "abcd")), (1 + F.col("id") % 4).cast("int")).alias("tag"))


@q("sc34_values_join", "SELECT n_nationkey, n_name, label FROM (VALUES (1, 'one'), (3, 'three'), (99, 'none')) v(k, label) JOIN nation ON n_nationkey = k")
def sc34(spark, d):
    register(spark, d, "nation")
    return spark.sql("SELECT n_nationkey, n_name, label FROM VALUES (1, 'one'), (3, 'three'), (99, 'none') AS v(k, label) JOIN nation ON n_nationkey = k")


@q("pf1_filter_project", "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03")
def pf1(spark, d):
    return R.project(R.where(_t(spark, d, "lineitem"), R.compare("l_quantity", ">=", 45) & R.compare("l_discount", "<", 0.03)), ["l_orderkey", "l_partkey", "l_extendedprice"])


@q("pf6_compare_null", "SELECT c_custkey FROM customer WHERE c_name = NULL")
def pf6(spark, d):
    return _t(spark, d, "customer").where(R.compare("c_name", "=", None)).select("c_custkey")


@q("pf22_bound_parameters", "SELECT o_orderkey, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_name = 'Customer#000000007' AND o_totalprice >= 1000")
def pf22(spark, d):
    register(spark, d, "orders", "customer")
    return R.bound_sql(spark, "SELECT o_orderkey, o_orderstatus FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_name = :name AND o_totalprice >= :least", {"name": "Customer#000000007", "least": 1000})


@q("pf22_injection_stays_data", "SELECT c_custkey FROM customer WHERE c_name = 'x'' OR ''1''=''1'")
def pf22_injection(spark, d):
    register(spark, d, "customer")
    return R.bound_sql(spark, "SELECT c_custkey FROM customer WHERE c_name = :name", {"name": "x' OR '1'='1"})


@q("pf26_pruned_ranges", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01'")
def pf26(spark, d):
    return _t(spark, d, "orders").where("o_orderdate >= timestamp_ntz '1995-01-01' and o_orderdate < timestamp_ntz '1995-04-01'").select("o_orderkey")


@q("jn1_join_pairs", "SELECT c_custkey AS left_index, s_suppkey AS right_index FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def jn1(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    s = _t(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    return R.join_pairs(c, s, "k", "c_custkey", "s_suppkey")


@q("jn2_hash_join", "SELECT l_orderkey AS k, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def jn2(spark, d):
    left = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey")
    right = _t(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    return R.hash_join(left, right, "k", build="right")


@q("jn4_theta_join", "SELECT r_name, n_name FROM region JOIN nation ON r_regionkey < n_regionkey AND length(r_name) > length(n_name)")
def jn4(spark, d):
    """A join without an equality: both sides have a fixed size, one row a region or nation."""
    return _t(spark, d, "region").join(_t(spark, d, "nation"), (F.col("r_regionkey") < F.col("n_regionkey")) & (F.length("r_name") > F.length("n_name"))).select("r_name", "n_name")


@q("jn6_three_tables", "SELECT n_name, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def jn6(spark, d):
    per = _t(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return per.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name", "o_orderstatus").agg(F.sum("n").alias("n"))


@q("jn7_left_join_chain", "SELECT c_custkey, o_orderkey, l_partkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '5-LOW' LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40")
def jn7(spark, d):
    o = _t(spark, d, "orders").where("o_orderpriority = '5-LOW'").select("o_orderkey", "o_custkey")
    li = _t(spark, d, "lineitem").where("l_quantity > 40").select("l_orderkey", "l_partkey")
    return _t(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("c_custkey", "o_orderkey", "l_partkey")


@q("jn8_cross_with_where", "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey")
def jn8(spark, d):
    register(spark, d, "supplier", "nation")
    return spark.sql("SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey")


@q("jn17_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def jn17(spark, d):
    o = _t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    return _t(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@q("sl1_limit", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10")
def sl1(spark, d):
    return R.limit(_t(spark, d, "customer").orderBy("c_custkey"), 10).select("c_custkey", "c_name")


@q("sl4_skip_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 20")
def sl4(spark, d):
    return R.page(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 20, 15)


@q("sl5_top_k", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def sl5(spark, d):
    return _t(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(25)


@q("so1_union_all", "SELECT 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier")
def so1(spark, d):
    one = lambda n: _t(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("t"), "n")
    return one("customer").unionByName(one("supplier"))


@q("so2_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def so2(spark, d):
    return _t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(_t(spark, d, "supplier").select("s_nationkey")).distinct()


@q("so4_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 30")
def so4(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k")).join(_t(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_partkey").alias("k")), "k", "left_anti").distinct()


@q("so5_intersection", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def so5(spark, d):
    return _t(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(_t(spark, d, "supplier").select("s_nationkey"))


@q("fn1_celsius", "SELECT CAST(g AS DOUBLE) AS c, g * 9.0 / 5 + 32 AS f FROM range(-40, 120) t(g)")
def fn1(spark, d):
    scalar.register(spark)
    return spark.range(-40, 120).select(F.col("id").cast("double").alias("c"), F.expr("celsius_to_fahrenheit(id)").alias("f"))


@q("fn5_sha256", "SELECT c_custkey, sha256(c_name) AS h FROM customer")
def fn5(spark, d):
    return _t(spark, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("h"))


@q("fn7_date_arithmetic", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS due, o_orderdate + INTERVAL 1 DAY AS next_day FROM orders")
def fn7(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 30).cast("string").alias("due"), F.expr("o_orderdate + interval 1 day").alias("next_day"))


@q("fn10_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn10(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@q("w1_insert_ignore", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, r_regionkey FROM region")
def w1(spark, d):
    n = _t(spark, d, "nation")
    new = _t(spark, d, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))
    return C.insert_ignore(n, new.unionByName(n), ["n_nationkey"])


@q("w2_upsert", "SELECT c_custkey, CASE WHEN c_custkey <= 50 THEN 'renamed' ELSE c_name END AS c_name, c_nationkey FROM customer")
def w2(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return C.upsert(c, c.where("c_custkey <= 50").withColumn("c_name", F.lit("renamed")), ["c_custkey"])


@q("w3_update_where", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def w3(spark, d):
    return C.update_where(_t(spark, d, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal") < 0, c_acctbal=F.lit(0.0))


@q("w4_compare_and_set", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_nationkey END AS balance, CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END AS version, c_custkey % 10 = 0 AS applied FROM customer")
def w4(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("balance"), F.lit(1).alias("version"))
    writes = c.where("c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(7).alias("expected"), F.lit(0).alias("new"))
    return C.compare_and_set(c, writes, "c_custkey", "balance")


@q("w5_reserve_stock", """
WITH RECURSIVE r AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS want, CAST(p_size * 10 AS BIGINT) AS have,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS k
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
s AS (
  SELECT l_partkey, k, coalesce(want <= have, false) AS accepted, coalesce(have, 0) - CASE WHEN want <= have THEN want ELSE 0 END AS rest FROM r WHERE k = 1
  UNION ALL SELECT r.l_partkey, r.k, r.want <= s.rest, s.rest - CASE WHEN r.want <= s.rest THEN r.want ELSE 0 END FROM s JOIN r ON r.l_partkey = s.l_partkey AND r.k = s.k + 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, accepted FROM r JOIN s USING (l_partkey, k)""")
def w5(spark, d):
    stock = _t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 10).alias("have"))
    req = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.col("l_quantity").cast("long").alias("want"))
    return C.reserve(stock, req, "l_partkey", "have", "want", ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "accepted")


@q("w7_audit_diff", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS operation FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 3 = 1
UNION ALL SELECT c_custkey + 1000000, 'INSERT' FROM customer WHERE c_custkey % 50 = 0""")
def w7(spark, d):
    before = _t(spark, d, "customer").select("c_custkey", "c_name")
    after = before.where("c_custkey % 3 <> 0").withColumn("c_name", F.when(F.col("c_custkey") % 3 == 1, F.lit("new")).otherwise(F.col("c_name"))).unionByName(before.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000))
    return C.audit_diff(before, after, "c_custkey").select("c_custkey", "operation")


@q("w8_violations", """
SELECT l_orderkey, 'check:quantity' AS rule FROM lineitem WHERE NOT (l_quantity > 3)
UNION ALL SELECT l_orderkey, 'foreign:l_partkey' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)""")
def w8(spark, d):
    part = _t(spark, d, "part").where("p_size > 2")
    return C.violations(_t(spark, d, "lineitem"), ["l_orderkey"], {"quantity": F.col("l_quantity") > 3}, ("l_orderkey",), foreign={"l_partkey": (part, "p_partkey")})


@q("ex_group_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return _t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@q("wn3_newest_per_partition", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
def wn3(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return _t(spark, d, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_custkey", "o_orderkey")
