"""Queries read every row of their tables."""

import pytest

from larkspar import plans

#: By table, queries that return one row or more for each of its rows, with the column of its key.
EVERY = {
    "lineitem": ("l_orderkey", ["project_expr"]),
    "orders": ("o_orderkey", ["between", "is_null", "case_when", "coalesce_nullif", "greatest_least", "num_nulls", "join_left", "join_right", "lateral_regexp_split", "str_concat", "str_split_part", "str_to_array", "num_div_mod", "order_by_nulls"]),
    "part": ("p_partkey", ["cast", "like_ilike", "regexp_split_to_table", "lateral_regexp_matches", "str_translate", "str_regexp_replace", "str_starts"]),
    "customer": ("c_custkey", ["regexp_matches", "str_case", "str_substring", "str_ascii"]),
    "events": ("event_id", ["json_each", "copy_roundtrip", "at_time_zone", "lateral_json_each", "date_extract", "date_epoch", "date_trunc", "date_interval", "date_age", "date_to_char", "date_parse", "json_get", "json_valid", "json_path_exists", "json_concat", "json_pretty_compact", "json_contains", "json_set", "json_insert", "json_delete"]),
    "embeddings": ("vec_id", ["array_basic"]),
    "region": ("r_regionkey", ["pg_quote"]),
}


@pytest.mark.parametrize("table", EVERY)
def test_whole_queries_hold_every_key(table, spark, sf_dir):
    key, names = EVERY[table]
    want = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).distinct().count()
    got = {n: plans.QUERIES[n](spark, sf_dir).select(key).distinct().count() for n in names}
    assert got == dict.fromkeys(names, want)


def test_other_queries(spark, sf_dir):
    n = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("orders", "lineitem", "customer")}
    count = {k: plans.QUERIES[k](spark, sf_dir).count() for k in ("union_all", "join_full", "join_merge", "intersect", "intersect_all", "except", "except_all")}
    assert count["union_all"] == n["orders"] + n["lineitem"] and count["join_full"] > n["customer"]
    assert count["join_merge"] == plans.QUERIES["project_expr"](spark, sf_dir).count()
    assert 0 < count["intersect"] < count["intersect_all"] and 0 < count["except"] < count["except_all"]
    assert {r["a"] for r in plans.QUERIES["bit_agg"](spark, sf_dir).collect()} == {0}


def test_lengths_and_elements_are_those_of_whole_values(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n"], r["o"], r["b"]) for r in plans.QUERIES["str_lengths"](spark, sf_dir).collect()}
    assert got == {i: (None, None, None) if t is None else (len(t), len(t.encode()), 8 * len(t.encode())) for i, t in texts.items()}
    assert max(n or 0 for n, _, _ in got.values()) > 40
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    elements = plans.QUERIES["lateral_unnest"](spark, sf_dir).collect()
    assert {(r["vec_id"], r["ord"]) for r in elements} == {(v["vec_id"], k) for v in vectors for k in range(1, len(v["embedding"]) + 1)}
