"""Queries in the dialect's own spelling, through its rewriting; the other engine reads the same text."""

from __future__ import annotations

from larkspar.plans.dialect import pg_sql
from larkspar.plans.registry import register


def pg(name: str, query: str, oracle: str | None = None) -> None:
    register(name, oracle or query)(lambda spark, sf_dir: pg_sql(spark, query, sf_dir=sf_dir))


pg("pg_casts", "SELECT c_custkey::text AS k, (c_acctbal * 100)::bigint % 7 AS m, c_nationkey::double precision / 4 AS q FROM customer WHERE c_acctbal = round(c_acctbal)")
pg("pg_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_custkey, o_orderkey DESC")
pg("pg_regex", "SELECT p_partkey, p_type ~ '^S' AS a, p_type ~ 'X|L' AS b FROM part WHERE NOT p_name ~ '9$'")
pg("pg_order_nulls", "SELECT o_orderkey, x FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS x FROM orders) t ORDER BY x DESC, o_orderkey LIMIT 40", "SELECT o_orderkey, x FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS x FROM orders) t ORDER BY x DESC NULLS FIRST, o_orderkey LIMIT 40")
pg("pg_string_agg", "SELECT n_regionkey, string_agg(n_name, '/' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
pg("pg_filter_over", "SELECT o_orderkey, count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM orders")
pg("pg_quantified", "SELECT o_orderkey FROM orders WHERE o_custkey = ANY(ARRAY[1, 4, 9]) AND o_orderkey <> ALL(SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 4, 9) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
pg("pg_with_ties", "SELECT p_partkey, p_size FROM part ORDER BY p_size FETCH FIRST 7 ROWS WITH TIES", "SELECT p_partkey, p_size FROM (SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) AS r FROM part) WHERE r <= 7")
pg("pg_json", "SELECT event_id, props->>'k' AS k FROM events WHERE event_type = 'click'")
pg("pg_series", "SELECT g.x, count(o_orderkey) AS n FROM generate_series(0, 9) AS g(x) LEFT JOIN orders ON o_orderkey % 10 = g.x GROUP BY g.x")
pg("pg_array_agg", "SELECT n_regionkey, array_join(array_agg(n_name ORDER BY n_nationkey DESC), '/') AS names, cardinality(array_agg(CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END)) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '/' ORDER BY n_nationkey DESC) AS names, CAST(count(*) AS INTEGER) AS n FROM nation GROUP BY n_regionkey")
pg("pg_regexp_replace", "SELECT c_custkey, regexp_replace(c_name, '0', 'x') AS one, regexp_replace(c_name, '0', 'x', 'g') AS every FROM customer")
pg("pg_window_refined", "SELECT o_orderkey, sum(o_orderkey) OVER (w ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey)", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders")
pg("pg_num_nulls", "SELECT p_partkey, num_nulls(nullif(p_size, 1), p_name, NULL) AS n, num_nonnulls(nullif(p_size, 1), p_name) AS m FROM part", "SELECT p_partkey, CAST(CASE WHEN p_size = 1 THEN 2 ELSE 1 END AS INTEGER) AS n, CAST(CASE WHEN p_size = 1 THEN 1 ELSE 2 END AS INTEGER) AS m FROM part")
pg("pg_quote", "SELECT r_regionkey, quote_ident(r_name) AS i, quote_literal(r_name || '''') AS l FROM region", "SELECT r_regionkey, '\"' || r_name || '\"' AS i, '''' || r_name || '''''''' AS l FROM region")
pg("pg_vector_distance", "SELECT vec_id, round(embedding <-> embedding, 5) AS d FROM embeddings", "SELECT vec_id, CAST(0 AS DOUBLE) AS d FROM embeddings")
pg("pg_json_contains", "SELECT event_id FROM events WHERE props::jsonb @> '{\"k\":5}'::jsonb OR '{\"k\":7}'::jsonb <@ props::jsonb", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IN ('5', '7')")
pg("pg_array_contains", "SELECT n_nationkey, ARRAY[n_nationkey, n_regionkey] @> ARRAY[1, 2] AS c, ARRAY[n_nationkey, n_regionkey] && ARRAY[0, 1] AS o FROM nation", "SELECT n_nationkey, n_regionkey IN (1, 2) AND n_nationkey IN (1, 2) AND n_nationkey <> n_regionkey AS c, n_regionkey < 2 OR n_nationkey < 2 AS o FROM nation")
pg("pg_jsonb_set", "SELECT event_id, jsonb_set(props, '{k}', '[9]') AS a, jsonb_set(props, '{n}', event_id::text) AS b, jsonb_insert('{\"a\":[1,2]}', '{a,1}', '7') AS c FROM events", "SELECT event_id, '{\"k\":[9]}' AS a, '{\"k\":' || (props ->> '$.k') || ',\"n\":' || event_id || '}' AS b, '{\"a\":[1,7,2]}' AS c FROM events")
pg("pg_json_delete", "SELECT event_id, props #- '{k}' AS a, jsonb_strip_nulls('{\"a\":null,\"b\":1}') AS b FROM events", "SELECT event_id, '{}' AS a, '{\"b\":1}' AS b FROM events")
pg("pg_isfinite", "SELECT o_orderkey, isfinite(CASE WHEN o_orderkey % 3 = 0 THEN 'Infinity'::double precision WHEN o_orderkey % 3 = 1 THEN o_totalprice END) AS f FROM orders")
