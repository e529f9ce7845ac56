"""Scans, filters, predicates and joins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larkspar.functions import exprs
from larkspar.operators import relational as rel
from larkspar.plans.registry import both, register, sql
from larkspar.sources.tables import TABLES, copy_from, copy_to, run_sql, table
from larkspar.sources.tables import register as register_views


def _scratch(spark) -> str:
    """A new path in the folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{folder.rstrip('/')}/larkspar-{uuid.uuid4().hex}"


# Scans and sources

both("scan_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
both("pk_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
both("secondary_eq_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 7")
both("index_range", "SELECT event_id, user_id, value FROM events WHERE event_id BETWEEN 100 AND 250")
both("values_join", "SELECT c_custkey, tag FROM customer JOIN (VALUES (1, 'a'), (2, 'b'), (5, 'c'), (-1, 'z')) AS t(k, tag) ON c_custkey = k")


@register("generate_series", "SELECT CAST(v AS INTEGER) AS v, CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS ord FROM generate_series(2, 20, 3) t(v)")
def generate_series(spark, sf_dir):
    return spark.sql("SELECT v, p + 1 AS ord FROM (SELECT posexplode(sequence(2, 20, 3)) AS (p, v))")


@register("date_series", "SELECT strftime(d, '%Y-%m-%d') AS d FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 7 DAY) t(d)")
def date_series(spark, sf_dir):
    return spark.sql("SELECT date_format(d, 'yyyy-MM-dd') AS d FROM (SELECT explode(sequence(DATE '2024-01-01', DATE '2024-03-01', INTERVAL 7 DAY)) AS d)")


@register("unnest_ordinality", "SELECT * FROM (VALUES ('x', 1, 0), ('y', 2, 1), ('z', 3, 2)) t(v, ord, off)")
def unnest_ordinality(spark, sf_dir):
    return spark.sql("SELECT v, p + 1 AS ord, p AS off FROM (SELECT posexplode(array('x', 'y', 'z')) AS (p, v))")


@register("json_array_elements", """SELECT CAST(ord AS INTEGER) AS ord, v FROM (SELECT unnest(from_json('[1,"two",{"a":3},null]', '["JSON"]')) AS j, generate_subscripts([1,2,3,4], 1) AS ord), LATERAL (SELECT CASE WHEN json_type(j) = 'VARCHAR' THEN j ->> '$' WHEN json_type(j) = 'NULL' THEN NULL ELSE CAST(j AS VARCHAR) END AS v) l""")
def json_array_elements(spark, sf_dir):
    return spark.sql("""SELECT p + 1 AS ord, v FROM (SELECT posexplode(from_json('[1,"two",{"a":3},null]', 'array<string>')) AS (p, v))""")


@register("json_each", "SELECT event_id, 'k' AS key, props ->> '$.k' AS value FROM events WHERE event_id < 50", bound="event_id < 50")
def json_each(spark, sf_dir, bound):
    return run_sql(spark, sf_dir, f"SELECT event_id, e.key, e.value FROM events, LATERAL explode(from_json(props, 'map<string,string>')) AS e(key, value) WHERE {bound}")


@register("json_object_keys", "SELECT unnest(json_keys('{\"b\":1,\"a\":{\"c\":2},\"z\":[]}')) AS k")
def json_object_keys(spark, sf_dir):
    return spark.sql("""SELECT explode(array_sort(json_object_keys('{"b":1,"a":{"c":2},"z":[]}'))) AS k""")


@register("regexp_split_to_table", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_partkey < 100", bound="p_partkey < 100")
def regexp_split_to_table(spark, sf_dir, bound):
    return run_sql(spark, sf_dir, rf"SELECT p_partkey, w FROM part, LATERAL explode(split(p_name, '\\s')) AS t(w) WHERE {bound}")


@register("regexp_matches", "SELECT c_custkey, unnest(regexp_extract_all(c_name, '([0-9])', 1)) AS m FROM customer WHERE c_custkey < 20", bound="c_custkey < 20")
def regexp_matches(spark, sf_dir, bound):
    return run_sql(spark, sf_dir, f"SELECT c_custkey, explode(regexp_extract_all(c_name, '([0-9])', 1)) AS m FROM customer WHERE {bound}")


@register("knn_l2", """
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, q), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))), 5) AS distance
FROM embeddings, q ORDER BY list_sum(list_transform(list_zip(embedding, q), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2)), vec_id LIMIT 10""")
def knn_l2(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.filter("vec_id = 0").first()["embedding"]
    return rel.nearest(vectors, "embedding", query, 10, "l2", "vec_id").select("vec_id", F.round("distance", 5).alias("distance"))


@register("knn_cosine", """
WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3),
d AS (SELECT vec_id, 1 - list_sum(list_transform(list_zip(embedding, q), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(q, lambda x: CAST(x AS DOUBLE) * x)))) AS distance FROM embeddings, q)
SELECT vec_id, round(distance, 5) AS distance FROM d ORDER BY d.distance, vec_id LIMIT 5 OFFSET 2""")
def knn_cosine(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.filter("vec_id = 3").first()["embedding"]
    return rel.nearest(vectors, "embedding", query, 5, "cosine", "vec_id", offset=2).select("vec_id", F.round("distance", 5).alias("distance"))


@register("knn_l2_each", """
WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))) AS distance
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)
SELECT query_id, vec_id, round(distance, 5) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d.distance, vec_id) <= 10""")
def knn_l2_each(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    near = rel.nearest_each(vectors, vectors.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10, "l2")
    return near.select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), F.round("distance", 5).alias("distance"))


@register("knn_cosine_each", """
WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, 1 - list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x)))) AS distance
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q)
SELECT query_id, vec_id, round(distance, 5) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d.distance, vec_id) BETWEEN 3 AND 7""")
def knn_cosine_each(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    near = rel.nearest_each(vectors, vectors.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5, "cosine", offset=2)
    return near.select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), F.round("distance", 5).alias("distance"))


@register("copy_roundtrip", "SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE props || chr(9) || 'a\\b' || chr(10) END AS p FROM events WHERE event_id < 500", bound="event_id < 500")
def copy_roundtrip(spark, sf_dir, bound):
    df = run_sql(spark, sf_dir, f"SELECT event_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE props || '\\t' || 'a\\\\b' || '\\n' END AS p FROM events WHERE {bound}")
    path = _scratch(spark)
    copy_to(df, path)
    return copy_from(spark, path, df.schema)


@register("partition_pruned_scan", "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey = 1 OR n_regionkey = 3")
def partition_pruned_scan(spark, sf_dir):
    path = _scratch(spark)
    table(spark, sf_dir, "nation").select("n_name", "n_regionkey").write.partitionBy("n_regionkey").parquet(path)
    return spark.read.schema("n_name string, n_regionkey int").parquet(path).filter("n_regionkey = 1 OR n_regionkey = 3")


#: The names that the catalogue gives to types.
_TYPES = {"string": "text", "double": "double precision", "float": "real", "int": "integer", "timestamp_ntz": "timestamp without time zone", "array<float>": "real[]", "array<double>": "double precision[]"}


@register("info_schema_columns", """SELECT table_name, ordinal_position, column_name, CASE data_type WHEN 'VARCHAR' THEN 'text' WHEN 'DOUBLE' THEN 'double precision' WHEN 'FLOAT' THEN 'real' WHEN 'TIMESTAMP' THEN 'timestamp without time zone'
WHEN 'FLOAT[]' THEN 'real[]' WHEN 'DOUBLE[]' THEN 'double precision[]' ELSE lower(data_type) END AS data_type, is_nullable FROM information_schema.columns
WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')""")
def info_schema_columns(spark, sf_dir):
    """The session's catalogue, after the folder's tables are registered in it as views."""
    register_views(spark, sf_dir, " ".join(TABLES))
    fields = [(t, k, c.name, _TYPES.get(c.dataType, c.dataType), "YES" if c.nullable else "NO") for t in TABLES for k, c in enumerate(spark.catalog.listColumns(t), 1)]
    return spark.createDataFrame(fields, "table_name string, ordinal_position int, column_name string, data_type string, is_nullable string")


# Projection and predicates

both("project_expr", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem WHERE l_orderkey < 200", bound="l_orderkey < 200")
both("cmp_filter", "SELECT p_partkey, p_size FROM part WHERE p_size <> 10 AND p_size >= 5 AND p_size < 40 AND p_retailprice <= 1500 AND p_partkey > 3")
both("three_valued_logic", """
SELECT a, b, a AND b AS both_, a OR b AS either_, NOT a AS not_a
FROM (VALUES (TRUE, TRUE), (TRUE, FALSE), (TRUE, NULL), (FALSE, FALSE), (FALSE, NULL), (CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN))) AS t(a, b)""")
both("between", "SELECT o_orderkey, o_totalprice BETWEEN 1000 AND 50000 AS in_, o_orderkey NOT BETWEEN 10 AND 20 AS out_ FROM orders WHERE o_orderkey < 60", bound="o_orderkey < 60")
both("in_list", """
SELECT n_nationkey, n_nationkey IN (1, 2, 3) AS a, n_nationkey IN (1, NULL) AS b, n_nationkey NOT IN (1, 2) AS c, n_nationkey NOT IN (1, NULL) AS d FROM nation""")
both("is_null", "SELECT o_orderkey, x IS NULL AS a, x IS NOT NULL AS b FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS x FROM orders WHERE o_orderkey < 100) t", bound="o_orderkey < 100")
both("bool_tests", "SELECT k, b IS TRUE AS t, b IS NOT TRUE AS nt, b IS FALSE AS f, b IS NOT FALSE AS nf, b IS NULL AS u, b IS NOT NULL AS nu FROM (VALUES (1, TRUE), (2, FALSE), (3, CAST(NULL AS BOOLEAN))) AS v(k, b)")
both("is_distinct_from", "SELECT a, b, a IS DISTINCT FROM b AS d, a IS NOT DISTINCT FROM b AS s FROM (VALUES (1, 1), (1, 2), (1, NULL), (CAST(NULL AS INT), CAST(NULL AS INT))) AS t(a, b)")
sql("like_ilike", r"SELECT p_partkey, p_type LIKE 'S%' AS a, p_type ILIKE '%anda%' AS b, p_type NOT LIKE '_M%' AS c, 'a%c' LIKE 'a!%c' ESCAPE '!' AS d FROM part WHERE p_partkey < 300", r"SELECT p_partkey, p_type LIKE 'S%' AS a, p_type ILIKE '%anda%' AS b, p_type NOT LIKE '_M%' AS c, 'a%c' LIKE 'a!%c' ESCAPE '!' AS d FROM part WHERE p_partkey < 300", bound="p_partkey < 300")
sql("like_any", "SELECT p_partkey, p_type LIKE ANY ('S%', 'L%') AS a, NOT (p_type LIKE ANY ('S%', 'L%')) AS b FROM part", "SELECT p_partkey, p_type LIKE 'S%' OR p_type LIKE 'L%' AS a, NOT (p_type LIKE 'S%' OR p_type LIKE 'L%') AS b FROM part")


@register("similar_to", "SELECT p_partkey, p_type, regexp_full_match(p_type, '(STANDARD|LARGE|S.*L+)') AS a, NOT regexp_full_match(p_type, '.*(AR).*') AS b FROM part")
def similar_to(spark, sf_dir):
    t = F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", exprs.similar_to(t, "(STANDARD|LARGE|S%L+)").alias("a"), (~exprs.similar_to(t, "%(AR)%")).alias("b"))


@register("regex_ops", "SELECT p_partkey, regexp_matches(p_type, 'A[RN]') AS a, regexp_matches(p_type, 'a[rn]', 'i') AS b, NOT regexp_matches(p_type, '^S') AS c, NOT regexp_matches(p_type, '^s', 'i') AS d FROM part")
def regex_ops(spark, sf_dir):
    t = F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", t.rlike("A[RN]").alias("a"), t.rlike("(?i)a[rn]").alias("b"), (~t.rlike("^S")).alias("c"), (~t.rlike("(?i)^s")).alias("d"))


@register("any_all_array", """
SELECT n_nationkey, n_nationkey IN (1, 5, 9) AS eq_any, CASE WHEN n_nationkey IN (1, 5) THEN TRUE END AS eq_any_null, n_nationkey > 2 AND n_nationkey > 4 AS gt_all, CASE WHEN n_nationkey >= 7 THEN NULL ELSE FALSE END AS ge_all_null FROM nation""")
def any_all_array(spark, sf_dir):
    n = F.col("n_nationkey")
    null = F.lit(None).cast("int")
    return table(spark, sf_dir, "nation").select(
        n,
        exprs.any_of(n, "=", F.array(F.lit(1), F.lit(5), F.lit(9))).alias("eq_any"),
        exprs.any_of(n, "=", F.array(F.lit(1), F.lit(5), null)).alias("eq_any_null"),
        exprs.all_of(n, ">", F.array(F.lit(2), F.lit(4))).alias("gt_all"),
        exprs.all_of(n, ">=", F.array(F.lit(7), null)).alias("ge_all_null"),
    )


sql("any_all_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)", "SELECT c_custkey FROM customer WHERE c_custkey = ANY (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_nationkey <> ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)")
both("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size_, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders WHERE o_orderkey < 500", bound="o_orderkey < 500")
both("coalesce_nullif", "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'F'), 'none') AS s, NULLIF(o_orderkey % 5, 0) AS m FROM orders WHERE o_orderkey < 300", bound="o_orderkey < 300")
both("cast", "SELECT p_partkey, CAST(p_partkey AS STRING) AS t, CAST(p_retailprice AS STRING) IS NOT NULL AS f, CAST('12' AS INT) AS i, CAST('2.5' AS DOUBLE) AS d, TRY_CAST('x1' AS INT) AS bad, CAST('true' AS BOOLEAN) AS b FROM part WHERE p_partkey < 50", bound="p_partkey < 50")
both("greatest_least", "SELECT o_orderkey, GREATEST(o_orderkey, o_custkey, NULL) AS g, LEAST(o_orderkey, o_custkey, CASE WHEN o_orderkey > 50 THEN 3 END) AS l FROM orders WHERE o_orderkey < 100", bound="o_orderkey < 100")
sql("array_index", "SELECT n_nationkey, try_element_at(array(10, 20, 30), 2) AS second_, try_element_at(array(10, 20, 30), 9) AS none_, concat_ws('-', array(n_name, 'x')) AS a FROM nation", "SELECT n_nationkey, [10, 20, 30][2] AS second_, [10, 20, 30][9] AS none_, n_name || '-x' AS a FROM nation")


@register("vector_distance", """
SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))), 5) AS d
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_distance(spark, sf_dir):
    a = table(spark, sf_dir, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return a.join(b, "vec_id").select("vec_id", F.round(exprs.l2_distance(F.col("embedding"), F.col("next")), 5).alias("d"))


@register("at_time_zone", "SELECT event_id, strftime(ts + INTERVAL 5 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS kolkata, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') AS new_york FROM events WHERE event_id < 200", bound="event_id < 200")
def at_time_zone(spark, sf_dir, bound):
    ts = F.col("ts").cast("timestamp")
    form = "yyyy-MM-dd HH:mm:ss"
    return table(spark, sf_dir, "events").filter(bound).select("event_id", F.date_format(F.from_utc_timestamp(ts, "+05:30"), form).alias("kolkata"), F.date_format(F.from_utc_timestamp(ts, "America/New_York"), form).alias("new_york"))


@register("param_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 150000")
def param_filter(spark, sf_dir):
    return run_sql(spark, sf_dir, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = :status AND o_totalprice > :least", {"status": "P", "least": 150000})


@register("num_nulls", "SELECT o_orderkey, CAST(o_orderkey % 2 = 0 AS INTEGER) + CAST(o_orderkey % 3 = 0 AS INTEGER) AS nulls, 3 - CAST(o_orderkey % 2 = 0 AS INTEGER) - CAST(o_orderkey % 3 = 0 AS INTEGER) AS others FROM orders WHERE o_orderkey < 100", bound="o_orderkey < 100")
def num_nulls(spark, sf_dir, bound):
    k = F.col("o_orderkey")
    cols = [k, F.when(k % 2 != 0, k), F.when(k % 3 != 0, F.col("o_custkey"))]
    return table(spark, sf_dir, "orders").filter(bound).select(k, exprs.num_nulls(*cols).alias("nulls"), exprs.num_nonnulls(*cols).alias("others"))


@register("builder_filters", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000 AND c_nationkey <> 3")
def builder_filters(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "BUILDING").filter(F.col("c_acctbal") > 1000).filter(F.col("c_nationkey") != 3).select("c_custkey", "c_acctbal")


# Joins

both("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000")
both("join_left", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey < 400", bound="o_orderkey < 400")
both("join_right", "SELECT l_linenumber, l_quantity, o_orderkey FROM (SELECT * FROM lineitem WHERE l_quantity > 45) l RIGHT JOIN (SELECT * FROM orders WHERE o_orderkey < 300) o ON l_orderkey = o_orderkey", bound="o_orderkey < 300")
both("join_full", """
SELECT a.k AS ak, b.k AS bk, a.n AS an, b.n AS bn
FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey END AS k, c_custkey AS n FROM customer WHERE c_custkey < 60) a
FULL JOIN (SELECT CASE WHEN c_custkey % 15 = 0 THEN NULL ELSE c_custkey END AS k, c_custkey AS n FROM customer WHERE c_custkey BETWEEN 30 AND 90) b ON a.k = b.k""", bound=("c_custkey < 60", "c_custkey BETWEEN 30 AND 90"))
sql("join_semi", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 250000)")
sql("join_anti", "SELECT o_orderkey, o_custkey FROM orders LEFT ANTI JOIN lineitem ON o_orderkey = l_orderkey", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE o_orderkey = l_orderkey)")
both("not_in_nulls", """
SELECT 'with null' AS what, count(*) AS n FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey = 2 THEN NULL ELSE r_regionkey END FROM region)
UNION ALL SELECT 'without', count(*) FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)""")
both("join_theta", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > n_nationkey * 300")
both("join_theta_left", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a LEFT JOIN nation b ON a.n_nationkey * 2 < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
both("join_theta_right", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a RIGHT JOIN nation b ON a.n_nationkey > b.n_nationkey + 12")
both("join_theta_full", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a FULL JOIN nation b ON a.n_nationkey > b.n_nationkey + 20")
sql("join_merge", "SELECT /*+ MERGE(o) */ o_orderkey, l_linenumber, l_quantity FROM orders o JOIN lineitem l ON o_orderkey = l_orderkey WHERE o_orderkey < 500", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders o JOIN lineitem l ON o_orderkey = l_orderkey WHERE o_orderkey < 500", bound="o_orderkey < 500")
both("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
both("join_derived", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12) SELECT c.c_custkey, b.n, v.tag FROM customer AS c JOIN big b ON b.o_custkey = c.c_custkey JOIN (VALUES ('BUILDING', 1), ('MACHINERY', 2)) AS v(seg, tag) ON v.seg = c.c_mktsegment")
both("join_compound", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey % 10 = s_suppkey % 10 AND c_acctbal < s_acctbal")
both("corr_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
both("corr_in", "SELECT o_orderkey FROM orders o WHERE o_orderpriority IN (SELECT o2.o_orderpriority FROM orders o2 WHERE o2.o_custkey = o.o_custkey AND o2.o_orderkey < o.o_orderkey)")
both("corr_scalar", "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c")
both("corr_scalar_theta", "SELECT n_nationkey, (SELECT count(*) FROM nation m WHERE m.n_nationkey < n.n_nationkey AND m.n_regionkey <> n.n_regionkey) AS k FROM nation n")


@register("lateral_json_elements", "SELECT * FROM (VALUES (1, '1'), (1, '2'), (2, 'x')) t(id, v)")
def lateral_json_elements(spark, sf_dir):
    return spark.sql("""SELECT id, v FROM VALUES (1, '[1,2]'), (2, '["x"]'), (3, NULL), (4, '[]') AS d(id, doc), LATERAL explode(from_json(doc, 'array<string>')) AS e(v)""")


@register("lateral_json_each", "SELECT event_id, 'k' AS k, props ->> '$.k' AS v FROM events WHERE event_id % 50 = 0 UNION ALL SELECT event_id, 'n', '7' FROM events WHERE event_id % 50 = 0", bound="event_id % 50 = 0")
def lateral_json_each(spark, sf_dir, bound):
    return run_sql(spark, sf_dir, f"""SELECT event_id, k, v FROM (SELECT event_id, CASE WHEN {bound} THEN replace(props, '}}', ',"n":7}}') END AS doc FROM events), LATERAL explode(from_json(doc, 'map<string,string>')) AS e(k, v)""")


@register("lateral_json_keys", "SELECT * FROM (VALUES (1, 'a'), (1, 'b'), (2, 'c')) t(id, k)")
def lateral_json_keys(spark, sf_dir):
    return spark.sql("""SELECT id, k FROM VALUES (1, '{"b":1,"a":2}'), (2, '{"c":null}'), (3, '{}'), (4, NULL) AS d(id, doc), LATERAL explode(json_object_keys(doc)) AS e(k)""")


sql("lateral_unnest", "SELECT vec_id, p + 1 AS ord, CAST(v AS DOUBLE) AS v FROM embeddings, LATERAL posexplode(embedding) AS t(p, v)", "SELECT vec_id, CAST(ord AS INTEGER) AS ord, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS ord FROM embeddings)")
sql("lateral_regexp_split", "SELECT o_orderkey, p + 1 AS ord, w FROM orders, LATERAL posexplode(split(o_orderpriority, '-')) AS t(p, w) WHERE o_orderkey < 100", "SELECT o_orderkey, CAST(ord AS INTEGER) AS ord, w FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS w, generate_subscripts(string_split(o_orderpriority, '-'), 1) AS ord FROM orders WHERE o_orderkey < 100)", bound="o_orderkey < 100")
sql("lateral_regexp_matches", "SELECT p_partkey, m FROM part, LATERAL explode(regexp_extract_all(p_name, '([a-z]+)', 1)) AS t(m) WHERE p_partkey < 60", "SELECT p_partkey, unnest(regexp_extract_all(p_name, '([a-z]+)', 1)) AS m FROM part WHERE p_partkey < 60", bound="p_partkey < 60")

# Flagship

both("join_groupby_topn", """
SELECT c_mktsegment, count(DISTINCT o_orderkey) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY c_mktsegment ORDER BY revenue DESC LIMIT 3""")
