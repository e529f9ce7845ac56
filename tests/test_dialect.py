"""PostgreSQL-flavoured text: each query's rows."""

import pytest

from larkspar.plans.dialect import pg_sql, to_spark


@pytest.fixture(scope="module", autouse=True)
def emp(spark):
    rows = [(1, "ann", "eng", 10), (2, "bob", "eng", 20), (3, "cy", "ops", 20), (4, "dee", "ops", None)]
    spark.createDataFrame(rows, "id int, name string, dept string, pay int").createOrReplaceTempView("emp")
    spark.createDataFrame([(1, '{"a":{"b":[7,8]},"c":"x"}', "[1,2]"), (2, None, "[]")], "id int, doc string, arr string").createOrReplaceTempView("js")


CASES = [
    ("SELECT id::text || '!' AS s FROM emp WHERE id = 1", [("1!",)]),
    ("SELECT (1 + 2)::bigint AS x, '2.5'::double precision AS y", [(3, 2.5)]),
    ("SELECT name FROM emp WHERE name ~ '^[ab]' ORDER BY name", [("ann",), ("bob",)]),
    ("SELECT name FROM emp WHERE name !~* 'A|B' ORDER BY 1", [("cy",), ("dee",)]),
    ("SELECT name FROM emp WHERE name SIMILAR TO '(a|b)%' ORDER BY 1", [("ann",), ("bob",)]),
    ("SELECT name FROM emp WHERE name NOT SIMILAR TO '%(n|o|y)%'", [("dee",)]),
    ("SELECT (ARRAY[10,20,30])[2] AS a, ARRAY[1,2][5] AS b", [(20, None)]),
    ("SELECT id FROM emp WHERE id = ANY(ARRAY[1,3]) ORDER BY id", [(1,), (3,)]),
    ("SELECT id FROM emp WHERE pay > ALL(ARRAY[5,15]) ORDER BY id", [(2,), (3,)]),
    ("SELECT id FROM emp WHERE id <> ALL(SELECT id FROM emp WHERE dept = 'eng') ORDER BY id", [(3,), (4,)]),
    ("SELECT doc->'a'->'b'->>1 AS v, doc#>>'{a,b,0}' AS w, doc->>'c' AS c FROM js WHERE id = 1", [("8", "7", "x")]),
    ("SELECT DISTINCT ON (dept) dept, name FROM emp ORDER BY dept, pay DESC", [("eng", "bob"), ("ops", "dee")]),
    ("SELECT name FROM emp WHERE pay IS NOT NULL ORDER BY pay DESC FETCH FIRST 1 ROWS WITH TIES", [("bob",), ("cy",)]),
    ("SELECT name FROM emp ORDER BY pay, name FETCH FIRST 2 ROWS ONLY", [("ann",), ("bob",)]),
    ("SELECT name FROM emp ORDER BY pay DESC LIMIT 1", [("dee",)]),
    ("SELECT dept, string_agg(name, ',' ORDER BY name DESC) AS s FROM emp GROUP BY dept ORDER BY dept", [("eng", "bob,ann"), ("ops", "dee,cy")]),
    ("SELECT id, sum(pay) FILTER (WHERE dept = 'eng') OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS s FROM emp ORDER BY id", [(1, 10), (2, 30), (3, 30), (4, 30)]),
    ("SELECT count(*) FILTER (WHERE pay > 10) AS n FROM emp", [(2,)]),
    ("SELECT g.x FROM generate_series(1, 7, 3) AS g(x)", [(1,), (4,), (7,)]),
    ("SELECT v, n FROM unnest(ARRAY['p','q']) WITH ORDINALITY AS t(v, n) ORDER BY n", [("p", 1), ("q", 2)]),
    ("SELECT js.id, e.v FROM js, jsonb_array_elements_text(js.arr) AS e(v) ORDER BY e.v", [(1, "1"), (1, "2")]),
    ("SELECT EXTRACT(EPOCH FROM TIMESTAMP '1970-01-02 00:00:00') AS e, date_part('year', DATE '2024-05-06') AS y", [(86400.0, 2024)]),
    ("SELECT to_char(TIMESTAMP '2024-05-06 07:08:09', 'YYYY/MM/DD HH24:MI') AS c, strpos('hello', 'l') AS p, log(100) AS l", [("2024/05/06 07:08", 3, 2.0)]),
    ("SELECT \"name\" FROM emp WHERE name = 'it''s' OR id = 3", [("cy",)]),
    ("WITH t AS (SELECT dept, pay::bigint AS p FROM emp) SELECT dept, max(p) AS m FROM t GROUP BY dept HAVING max(p) >= 20 ORDER BY dept", [("eng", 20), ("ops", 20)]),
    ("SELECT array_agg(pay) AS a FROM emp WHERE id = 4", [([None],)]),
    ("SELECT dept, array_agg(pay ORDER BY pay) AS a FROM emp GROUP BY dept ORDER BY dept", [("eng", [10, 20]), ("ops", [20, None])]),
    ("SELECT array_agg(name ORDER BY pay DESC, id DESC) AS a FROM emp", [(["dee", "cy", "bob", "ann"],)]),
    ("SELECT array_agg(pay) FILTER (WHERE id > 3) AS a, array_agg(DISTINCT dept) AS d, array_agg(id) FILTER (WHERE id > 9) AS n FROM emp", [([None], ["eng", "ops"], None)]),
    ("SELECT id, array_agg(pay) FILTER (WHERE id > 2) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS a FROM emp ORDER BY id", [(1, None), (2, None), (3, [20]), (4, [20, None])]),
    ("SELECT regexp_replace('foobarbaz', 'b..', 'X') AS a, regexp_replace('foobarbaz', 'b..', 'X', 'g') AS b, regexp_replace('foobar', 'B(.)', '<\\1$>', 'i') AS c, regexp_replace('abc', 'z', 'y') AS d", [("fooXbaz", "fooXX", "foo<a$>r", "abc")]),
    ("SELECT trunc(2.78) AS a, trunc(-2.78) AS b, trunc(3.14159, 2) AS c, num_nulls(1, NULL, 2) AS d, num_nonnulls(1, NULL, 2) AS e", [(2, -2, 3.14, 1, 2)]),
    ("SELECT quote_ident('ok') AS a, quote_ident('No t') AS b, quote_literal('it''s') AS c, quote_nullable(NULL) AS d", [("ok", '"No t"', "'it''s'", "NULL")]),
    ("SELECT string_to_array('a.b..c', '.') AS a, string_to_array('x,y', ',', 'y') AS b", [(["a", "b", "", "c"], ["x", None])]),
    ("SELECT ARRAY[0, 0] <-> ARRAY[3, 4] AS d, isfinite(DATE '2024-01-01') AS f", [(5.0, True)]),
    ("SELECT (DATE '2024-01-01', DATE '2024-02-01') OVERLAPS (DATE '2024-01-31', DATE '2024-03-01') AS a, (DATE '2024-01-01', DATE '2024-02-01') OVERLAPS (DATE '2024-02-01', DATE '2024-03-01') AS b", [(True, False)]),
    ("SELECT max(n) AS n, max(r) AS r FROM (SELECT row_number() OVER () AS n, rank() OVER () AS r FROM emp) t", [(4, 1)]),
    ("SELECT id, sum(id) OVER (w ORDER BY id ROWS UNBOUNDED PRECEDING) AS s FROM emp WINDOW w AS (PARTITION BY dept) ORDER BY id", [(1, 1), (2, 3), (3, 3), (4, 7)]),
    ("SELECT a.id FROM emp a WHERE EXISTS (SELECT 1 FROM emp b WHERE b.dept = a.dept AND b.id > a.id) ORDER BY a.id", [(1,), (3,)]),
]


@pytest.mark.parametrize(("query", "want"), CASES)
def test_dialect(spark, query, want):
    got = [tuple(r) for r in pg_sql(spark, query).collect()]
    assert (got if "ORDER BY" in query and "DISTINCT ON" not in query and "TIES" not in query else sorted(got)) == want, to_spark(query)


def test_parameters(spark):
    assert pg_sql(spark, "SELECT name FROM emp WHERE id = $1 AND dept = $2", [3, "ops"]).first()[0] == "cy"


def test_tables_of_a_folder(spark, sf_dir):
    assert pg_sql(spark, "SELECT count(*) AS n FROM nation WHERE n_nationkey::text ~ '^1'", sf_dir=sf_dir).first()[0] == 11


def test_unbalanced():
    with pytest.raises(ValueError, match="unbalanced"):
        to_spark("SELECT (1")
