"""Aggregates and window functions. Doubles are rounded on both sides, every order is total, and every frame is spelt out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspar.operators import relational as rel
from larkspar.plans.registry import both, register, sql
from larkspar.sources.tables import table

# Aggregates

both("groupby_agg", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
both("agg_count", "SELECT count(*) AS n, count(x) AS nx, count(CASE WHEN x > 1000 THEN 1 END) AS big FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS x FROM orders) t")
both("agg_sum", "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS s, sum(CASE WHEN o_totalprice < 0 THEN o_totalprice END) AS nothing FROM orders GROUP BY o_orderstatus")
both("agg_avg", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS a, round(avg(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END), 4) AS even FROM customer GROUP BY c_mktsegment")
both("agg_min_max", "SELECT o_custkey % 50 AS g, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderpriority) AS first_, max(o_orderpriority) AS last_ FROM orders GROUP BY o_custkey % 50")
both("count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS d, count(DISTINCT CASE WHEN l_partkey % 3 = 0 THEN l_partkey END) AS dn, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS sd FROM lineitem GROUP BY l_returnflag")
sql("count_distinct_tuple", "SELECT count(DISTINCT o_orderstatus, o_orderpriority) AS d FROM orders", "SELECT count(DISTINCT (o_orderstatus, o_orderpriority)) AS d FROM orders")
both("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS o FROM orders GROUP BY o_orderpriority")


@register("agg_ordered", "SELECT c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_acctbal DESC, c_custkey) AS keys FROM customer GROUP BY c_nationkey")
def agg_ordered(spark, sf_dir):
    entry = F.struct((-F.col("c_acctbal")).alias("k"), F.col("c_custkey").alias("v"))
    keys = F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["v"].cast("string"))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(keys, ",").alias("keys"))


sql("string_agg", "SELECT n_regionkey, listagg(n_name, '; ') WITHIN GROUP (ORDER BY n_name) AS names, listagg(CASE WHEN n_nationkey < 0 THEN n_name END, ',') AS none_ FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names, CAST(NULL AS VARCHAR) AS none_ FROM nation GROUP BY n_regionkey")


@register("array_agg", "SELECT n_regionkey, string_agg(coalesce(CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS VARCHAR), 'null'), ',' ORDER BY n_nationkey) AS a FROM nation GROUP BY n_regionkey")
def array_agg(spark, sf_dir):
    x = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey"))
    kept = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", x.alias("x")))), lambda s: F.coalesce(s["x"].cast("string"), F.lit("null")))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(kept, ",").alias("a"))


both("bool_agg", "SELECT o_custkey, bool_and(o_totalprice > 50000) AS every_, bool_or(o_totalprice > 250000) AS any_, bool_and(CASE WHEN o_custkey < 0 THEN TRUE END) AS none_ FROM orders GROUP BY o_custkey")
both("bit_agg", "SELECT o_orderpriority, bit_and(o_orderkey) AS a, bit_or(o_orderkey) AS o FROM orders WHERE o_orderkey % 8 > 3 GROUP BY o_orderpriority", bound="o_orderkey % 8 > 3")


@register("json_agg", "SELECT n_regionkey, '[' || string_agg(coalesce(CAST(CASE WHEN n_nationkey % 5 <> 0 THEN n_nationkey END AS VARCHAR), 'null'), ',' ORDER BY n_nationkey) || ']' AS j FROM nation GROUP BY n_regionkey")
def json_agg(spark, sf_dir):
    x = F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey"))
    kept = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", x.alias("x")))), lambda s: s["x"])
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(kept).alias("j"))


@register("json_object_agg", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j FROM nation GROUP BY n_regionkey")
def json_object_agg(spark, sf_dir):
    entries = F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey")))
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(entries)).alias("j"))


sql("mode", "SELECT o_custkey % 20 AS g, mode() WITHIN GROUP (ORDER BY o_orderpriority) AS m, mode() WITHIN GROUP (ORDER BY o_orderpriority DESC) AS md FROM orders GROUP BY o_custkey % 20", """
WITH c AS (SELECT o_custkey % 20 AS g, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, p) AS a, row_number() OVER (PARTITION BY g ORDER BY n DESC, p DESC) AS d FROM c)
SELECT g, max(CASE WHEN a = 1 THEN p END) AS m, max(CASE WHEN d = 1 THEN p END) AS md FROM r GROUP BY g""")
sql("percentile_cont", "SELECT o_orderstatus, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS q, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice DESC), 4) AS qd FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 4) AS q, round(quantile_cont(o_totalprice, 0.75), 4) AS qd FROM orders GROUP BY o_orderstatus")
both("percentile_disc", "SELECT o_orderstatus, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS q FROM orders GROUP BY o_orderstatus")
both("stddev_var", "SELECT c_nationkey, round(stddev_samp(c_acctbal), 4) AS ss, round(stddev_pop(c_acctbal), 4) AS sp, round(var_samp(c_acctbal), 2) AS vs, round(var_pop(c_acctbal), 2) AS vp FROM customer GROUP BY c_nationkey")
both("stddev_single", "SELECT n_nationkey, stddev_samp(n_regionkey) AS s, var_pop(n_regionkey) AS v FROM nation GROUP BY n_nationkey")
sql("corr_covar", "SELECT l_returnflag, round(covar_pop(l_extendedprice, l_quantity) / nullif(stddev_pop(l_extendedprice) * stddev_pop(l_quantity), 0), 6) AS c, round(covar_pop(l_extendedprice, l_quantity), 2) AS cp, round(covar_samp(l_extendedprice, l_quantity), 2) AS cs FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS c, round(covar_pop(l_extendedprice, l_quantity), 2) AS cp, round(covar_samp(l_extendedprice, l_quantity), 2) AS cs FROM lineitem GROUP BY l_returnflag")
both("regr_all", """
SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
       CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 3) AS ay,
       round(regr_sxx(l_extendedprice, l_quantity) / 1e6, 4) AS sxx, round(regr_syy(l_extendedprice, l_quantity) / 1e12, 4) AS syy, round(regr_sxy(l_extendedprice, l_quantity) / 1e9, 4) AS sxy
FROM lineitem GROUP BY l_linestatus""")
both("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000")
both("bare_having", "SELECT count(*) AS n FROM orders HAVING min(o_totalprice) > -1")
both("group_by_all", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
both("groupby_expr", "SELECT o_orderkey % 7 AS m, o_totalprice > 100000 AS big, count(*) AS n FROM orders GROUP BY o_orderkey % 7, o_totalprice > 100000")
both("q6_style", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_quantity < 24 AND l_discount BETWEEN 0.05 AND 0.07")
both("multi_agg", "SELECT l_returnflag, count(DISTINCT l_partkey) AS p, count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 25) AS s, round(sum(l_tax), 2) AS t, count(*) AS n FROM lineitem GROUP BY l_returnflag")
both("agg_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS m, bool_or(o_totalprice > 0) AS b FROM orders WHERE o_orderkey < 0")

# Windows

ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
both("row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders")
both("rank_dense_rank", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS d FROM customer")
both("percent_rank_cume_dist", "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 8) AS p, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 8) AS c FROM customer")
both("ntile", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS t, ntile(1000) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS u FROM customer")
both("lag_lead", "SELECT o_orderkey, lag(o_orderkey) OVER w AS a, lag(o_orderkey, 2, -1) OVER w AS b, lead(o_orderkey, 1) OVER w AS c, lead(o_orderkey, 3, 0) OVER w AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
both("first_last_value", f"SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey {ALL}) AS f, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey {ALL}) AS l FROM orders")
both("nth_value", f"SELECT o_orderkey, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey {ALL}) AS n2, nth_value(o_orderkey, 40) OVER (PARTITION BY o_custkey ORDER BY o_orderkey {ALL}) AS n40 FROM orders")
_holes = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS x FROM orders)"
sql("window_ignore_nulls", f"""SELECT o_orderkey, lag(x) IGNORE NULLS OVER w AS lg, lead(x) IGNORE NULLS OVER w AS ld, first_value(x) IGNORE NULLS OVER (PARTITION BY o_custkey ORDER BY o_orderkey {ALL}) AS f, last_value(x) IGNORE NULLS OVER (PARTITION BY o_custkey ORDER BY o_orderkey {ALL}) AS l
FROM {_holes} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""", f"""SELECT o_orderkey, lag(x IGNORE NULLS) OVER w AS lg, lead(x IGNORE NULLS) OVER w AS ld, first_value(x IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey {ALL}) AS f, last_value(x IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey {ALL}) AS l
FROM {_holes} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
both("window_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS s FROM orders")
both("window_partition_agg", f"SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey {ALL}) AS n, min(o_totalprice) OVER (PARTITION BY o_custkey {ALL}) AS lo, max(o_totalprice) OVER (PARTITION BY o_custkey {ALL}) AS hi, round(avg(o_totalprice) OVER (PARTITION BY o_custkey {ALL}), 7) AS a FROM orders")
sql("window_string_agg", "SELECT o_orderkey, array_join(collect_list(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), ',') AS s FROM orders", "SELECT o_orderkey, string_agg(o_orderstatus, ',') OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM orders")
both("window_bool_bit", "SELECT o_orderkey, bool_and(o_totalprice > 20000) OVER w AS a, bool_or(o_totalprice > 300000) OVER w AS o, bit_and(o_orderkey) OVER w AS ba, bit_or(o_orderkey) OVER w AS bo FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


@register("window_mode", """
WITH c AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2),
m AS (SELECT o_custkey, p FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p) AS r FROM c) WHERE r = 1)
SELECT o_orderkey, p AS m FROM orders JOIN m USING (o_custkey)""")
def window_mode(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    counts = orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("o_custkey").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("o_orderpriority").alias("p")))["p"].alias("m"))
    return orders.join(top, "o_custkey").select("o_orderkey", "m")


both("window_stddev", f"SELECT o_orderkey, round(stddev_samp(o_totalprice) OVER (PARTITION BY o_custkey {ALL}), 2) AS s, round(var_pop(o_totalprice) OVER (PARTITION BY o_custkey {ALL}) / 1e6, 2) AS v FROM orders")
both("window_regr", f"SELECT c_custkey, round(regr_slope(c_acctbal, c_custkey) OVER (PARTITION BY c_nationkey {ALL}), 4) AS b, round(covar_pop(c_acctbal, c_custkey) OVER (PARTITION BY c_nationkey {ALL}), 1) AS c FROM customer")
sql("window_json_agg", "SELECT n_nationkey, to_json(collect_list(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS j FROM nation", "SELECT n_nationkey, '[' || string_agg(CAST(n_nationkey AS VARCHAR), ',') OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) || ']' AS j FROM nation")
sql("window_filter", "SELECT o_orderkey, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER w, 2) AS s, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "SELECT o_orderkey, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER w, 2) AS s, count(*) FILTER (WHERE o_orderstatus = 'O') OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
both("frame_rows", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS a, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 FOLLOWING AND 5 FOLLOWING) AS b, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING) AS c FROM orders")
both("frame_range_peers", "SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n, count(*) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS p FROM customer")
both("frame_range_offset", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 2 FOLLOWING) AS n, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size DESC RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS s FROM part")


@register("frame_groups", "SELECT p_partkey, count(*) OVER w AS n, CAST(sum(p_size) OVER w AS BIGINT) AS s FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def frame_groups(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    out = rel.groups_frame(part, ["p_brand"], F.col("p_size").asc(), lambda w: F.count(F.lit(1)).over(w), 1, 1, "n")
    return rel.groups_frame(out, ["p_brand"], F.col("p_size").asc(), lambda w: F.sum("p_size").over(w), 1, 1, "s").select("p_partkey", "n", "s")


def _exclude(kind: str, words: str, rows: str, start: int, end: int) -> None:
    oracle = f"SELECT c_custkey, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey % 3, c_custkey {rows} EXCLUDE CURRENT ROW), 2) AS s FROM customer"
    if kind != "current":
        # Peers that tie must still come in one order: a frame of the whole partition has no other.
        oracle = f"SELECT c_custkey, round(sum(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {words}), 2) AS s FROM customer"

    @register(f"frame_exclude_{kind}", oracle)
    def query(spark, sf_dir):
        order = [F.col("c_mktsegment")] if kind != "current" else [F.col("c_mktsegment"), F.col("c_custkey") % 3, F.col("c_custkey")]
        out = rel.frame_exclude(table(spark, sf_dir, "customer"), ["c_nationkey"], order, F.col("c_acctbal"), start, end, kind, "s")
        return out.select("c_custkey", F.round("s", 2).alias("s"))


_exclude("current", "CURRENT ROW", "ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING", -3, 1)
_exclude("group", "GROUP", "", Window.unboundedPreceding, Window.unboundedFollowing)
_exclude("ties", "TIES", "", Window.unboundedPreceding, Window.unboundedFollowing)


# Bounded frames whose peers tie: rows of a peer group have equal values here, so that their order does not show.
for _kind in ("group", "ties"):
    for _agg in ("sum", "count", "avg"):
        _call = f"{_agg}(CASE WHEN c_nationkey % 4 > 0 THEN c_nationkey END) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey ROWS BETWEEN 30 PRECEDING AND 12 FOLLOWING EXCLUDE {_kind.upper()})"

        @register(f"frame_exclude_{_kind}_rows_{_agg}", f"SELECT c_mktsegment, c_nationkey, v, count(*) AS n FROM (SELECT c_mktsegment, c_nationkey, {_call if _agg == 'count' else f'CAST(round({_call}, 6) AS DOUBLE)'} AS v FROM customer) GROUP BY ALL")
        def query(spark, sf_dir, kind=_kind, agg=_agg):
            value = F.when(F.col("c_nationkey") % 4 > 0, F.col("c_nationkey"))
            out = rel.frame_exclude(table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey"), ["c_mktsegment"], [F.col("c_nationkey")], value, -30, 12, kind, "v", agg)
            out = out if agg == "count" else out.withColumn("v", F.round("v", 6))
            return out.groupBy("c_mktsegment", "c_nationkey", "v").agg(F.count(F.lit(1)).alias("n"))


sql("named_window", "SELECT o_orderkey, count(*) OVER w AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WINDOW w AS (PARTITION BY o_custkey)", "SELECT o_orderkey, count(*) OVER w AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WINDOW w AS (PARTITION BY o_custkey)")
