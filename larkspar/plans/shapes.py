"""Sorting, limits, set operations, subqueries and changes to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspar.operators import relational as rel
from larkspar.plans.registry import both, register, sql
from larkspar.sources.tables import run_sql, table

# Sort, limit, distinct. Row order is not compared, so sorted results carry their position.

both("order_by_nulls", "SELECT o_orderkey, row_number() OVER (ORDER BY x ASC NULLS LAST, o_orderkey) AS a, row_number() OVER (ORDER BY x DESC NULLS FIRST, o_orderkey) AS d FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders WHERE o_orderkey < 200) t", bound="o_orderkey < 200")
sql("order_by_all", "SELECT c_nationkey, c_custkey FROM customer ORDER BY ALL LIMIT 25", "SELECT c_nationkey, c_custkey FROM customer ORDER BY ALL LIMIT 25")
both("order_by_expr", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY count(*) * -1, o_custkey LIMIT 20")
both("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 15 OFFSET 30")


@register("fetch_with_ties", "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size DESC) AS r FROM part) WHERE r <= 10")
def fetch_with_ties(spark, sf_dir):
    return rel.fetch_with_ties(table(spark, sf_dir, "part").select("p_partkey", "p_size"), 10, [("p_size", False)])


both("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey ASC NULLS LAST LIMIT 10")
both("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")


@register("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return rel.distinct_on(orders, ["o_custkey"], [F.col("o_totalprice").desc_nulls_first(), F.col("o_orderkey").asc_nulls_last()])


# Set operations

# All rows of two tables that share some rows, each with repeats of its own.
_ORDERS = "(SELECT o_custkey % 400 AS k, o_orderstatus AS s FROM orders)"
_LINES = "(SELECT l_partkey % 300 AS k, l_linestatus AS s FROM lineitem)"
for _name, _op in (("union_all", "UNION ALL"), ("union_distinct", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    both(_name, f"SELECT * FROM {_ORDERS} a {_op} SELECT * FROM {_LINES} b")

# Subqueries

both("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM customer JOIN per ON c_custkey = o_custkey WHERE n > 2")
both("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_name LIKE '%1')")
both("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders) AND EXISTS (SELECT 1 FROM region)")
both("derived_table", "SELECT seg, max(n) AS n FROM (SELECT c_mktsegment AS seg, c_nationkey, count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey) t GROUP BY seg")

# Changes to tables, as new tables

_NEW = "SELECT c_custkey, 'new' AS c_name, CAST(1 AS DOUBLE) AS c_acctbal FROM customer WHERE c_custkey % 97 = 0 UNION ALL SELECT 10000000, 'added', CAST(5 AS DOUBLE)"


@register("upsert_do_nothing", f"WITH n AS ({_NEW}) SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT * FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def upsert_do_nothing(spark, sf_dir):
    new = run_sql(spark, sf_dir, _NEW)
    return rel.upsert_do_nothing(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), new, ["c_custkey"])


@register("upsert_do_update", f"""WITH n AS ({_NEW})
SELECT coalesce(t.c_custkey, n.c_custkey) AS c_custkey, coalesce(t.c_name, n.c_name) AS c_name, CASE WHEN t.c_custkey IS NULL THEN n.c_acctbal WHEN n.c_custkey IS NOT NULL AND t.c_acctbal > 0 THEN t.c_acctbal + n.c_acctbal ELSE t.c_acctbal END AS c_acctbal
FROM customer t FULL JOIN n ON t.c_custkey = n.c_custkey""")
def upsert_do_update(spark, sf_dir):
    new = run_sql(spark, sf_dir, _NEW)
    target = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return rel.upsert_do_update(target, new, ["c_custkey"], {"c_acctbal": F.col("t.c_acctbal") + F.col("excluded.c_acctbal")}, F.col("t.c_acctbal") > 0)


@register("update_expr", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_expr(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return rel.update_where(orders, {"o_totalprice": F.col("o_totalprice") * 2, "o_orderstatus": F.lit("X")}, F.col("o_orderstatus") == "P")


@register("update_returning", "SELECT o_orderkey, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey < 20")
def update_returning(spark, sf_dir):
    changed = table(spark, sf_dir, "orders").filter("o_orderkey < 20")
    return rel.update_where(changed, {"o_totalprice": F.col("o_totalprice") + 1}, F.lit(True)).select("o_orderkey", "o_totalprice")


@register("delete_where", "SELECT o_orderkey FROM orders WHERE NOT coalesce(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END > 100000, FALSE)")
def delete_where(spark, sf_dir):
    price = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    return rel.delete_where(table(spark, sf_dir, "orders"), price > 100000).select("o_orderkey")


@register("delete_returning", "SELECT o_orderkey, o_totalprice FROM orders WHERE CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END > 100000")
def delete_returning(spark, sf_dir):
    price = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice"))
    return rel.delete_returning(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), price > 100000)[1]


@register("truncate_insert", "SELECT n_nationkey AS r_regionkey, n_name AS r_name FROM nation")
def truncate_insert(spark, sf_dir):
    new = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name"))
    return rel.insert(rel.truncate(table(spark, sf_dir, "region").select("r_regionkey", "r_name")), new)


@register("insert_default", "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT s_suppkey + 1000000, 'unnamed', NULL FROM supplier")
def insert_default(spark, sf_dir):
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("c_custkey"))
    return rel.insert(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), new, {"c_name": F.lit("unnamed")})


@register("explain")
def explain(spark, sf_dir):
    return rel.explain(run_sql(spark, sf_dir, "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey"))


@register("insert_select", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 1")
def insert_select(spark, sf_dir):
    more = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select((F.col("n_nationkey") + 100).alias("r_regionkey"), F.col("n_name").alias("r_name"))
    return table(spark, sf_dir, "region").select("r_regionkey", "r_name").unionByName(more)


@register("ctas", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def ctas(spark, sf_dir):
    made = run_sql(spark, sf_dir, "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY c_mktsegment")
    made.createOrReplaceTempView("segment_counts")
    return spark.table("segment_counts")


@register("alter_table", "SELECT n_nationkey AS id, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey, 'x' AS extra FROM nation")
def alter_table(spark, sf_dir):
    return table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "id").withColumn("n_regionkey", F.col("n_regionkey").cast("string")).withColumn("extra", F.lit("x")).withColumn("gone", F.lit(1)).drop("gone")


@register("not_null_violations", "SELECT 'x' AS column_name, count(*) AS n_nulls FROM orders WHERE o_orderkey % 11 = 0")
def not_null_violations(spark, sf_dir):
    holed = table(spark, sf_dir, "orders").withColumn("x", F.when(F.col("o_orderkey") % 11 != 0, 1))
    return rel.not_null_violations(holed, ["o_orderkey", "x", "o_custkey"])


@register("unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return rel.unique_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("analyze_stats", """
SELECT 'o_orderkey' AS column_name, count(*) AS row_count, 0.0::DOUBLE AS null_frac, count(DISTINCT o_orderkey) AS n_distinct, CAST(min(o_orderkey) AS VARCHAR) AS min_value, CAST(max(o_orderkey) AS VARCHAR) AS max_value FROM orders
UNION ALL SELECT 'o_orderstatus', count(*), 0.0::DOUBLE, count(DISTINCT o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders
UNION ALL SELECT 'part', count(*), round(1 - count(p) / count(*), 6), count(DISTINCT p), min(p), max(p) FROM (SELECT CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS p FROM orders)""")
def analyze_stats(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("part", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")))
    return rel.analyze_stats(orders, ["o_orderkey", "o_orderstatus", "part"], exact=True).withColumn("null_frac", F.round("null_frac", 6))


@register("analyze_mcv", "SELECT l_suppkey, count(*) AS freq FROM lineitem GROUP BY l_suppkey ORDER BY freq DESC, l_suppkey LIMIT 10")
def analyze_mcv(spark, sf_dir):
    return rel.most_common(table(spark, sf_dir, "lineitem"), "l_suppkey")


@register("analyze_histogram", " UNION ALL ".join(f"SELECT {k} AS k, round(quantile_cont(o_totalprice, {k / 8}), 4) AS bound FROM orders" for k in range(9)))
def analyze_histogram(spark, sf_dir):
    bounds = rel.histogram_bounds(table(spark, sf_dir, "orders"), "o_totalprice", 8)
    return spark.createDataFrame(list(enumerate(bounds)), "k int, b double").select("k", F.round("b", 4).alias("bound"))
