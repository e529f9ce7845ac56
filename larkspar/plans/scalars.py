"""Scalar functions: strings, numbers, dates, arrays and JSON, several to a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspar.functions import exprs, json_edit
from larkspar.plans.registry import both, register, sql
from larkspar.sources.tables import run_sql, table

# Strings

both("str_case", "SELECT c_custkey, lower(c_name) AS l, upper(c_mktsegment) AS u, length(c_name) AS n, reverse(c_name) AS r FROM customer WHERE c_custkey < 200", bound="c_custkey < 200")
sql("str_lengths", "SELECT doc_id, length(text) AS n, octet_length(text) AS o, bit_length(text) AS b FROM documents", "SELECT doc_id, length(text) AS n, strlen(text) AS o, bit_length(text) AS b FROM documents")
sql("str_trim", "SELECT n_nationkey, trim(BOTH 'x' FROM s) AS b, trim(LEADING 'x' FROM s) AS l, trim(TRAILING 'x' FROM s) AS t, btrim(concat('  ', n_name, ' ')) AS p FROM (SELECT n_nationkey, n_name, concat('xx', n_name, 'xyx') AS s FROM nation) n", "SELECT n_nationkey, trim(s, 'x') AS b, ltrim(s, 'x') AS l, rtrim(s, 'x') AS t, trim('  ' || n_name || ' ') AS p FROM (SELECT n_nationkey, n_name, 'xx' || n_name || 'xyx' AS s FROM nation) n")
both("str_translate", "SELECT p_partkey, translate(p_name, 'abc', 'xy') AS t, replace(p_name, 'a', 'AA') AS r, replace(p_name, 'zzz', 'q') AS same FROM part WHERE p_partkey < 300", bound="p_partkey < 300")
both("str_substring", "SELECT c_custkey, substring(c_name, 3, 4) AS a, substr(c_name, 2) AS b, left(c_name, 3) AS l, right(c_name, 4) AS r FROM customer WHERE c_custkey < 200", bound="c_custkey < 200")
sql("str_concat", "SELECT o_orderkey, concat_ws('', o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'e' END, o_orderpriority) AS c, o_orderstatus || '-' || o_orderpriority AS p, concat_ws('+', o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'e' END, 'z') AS w FROM orders WHERE o_orderkey < 200", "SELECT o_orderkey, concat(o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'e' END, o_orderpriority) AS c, o_orderstatus || '-' || o_orderpriority AS p, concat_ws('+', o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 'e' END, 'z') AS w FROM orders WHERE o_orderkey < 200", bound="o_orderkey < 200")


@register("str_format", "SELECT n_nationkey, printf('%s is %s%%', n_name, CAST(n_regionkey AS VARCHAR)) AS s, CASE WHEN regexp_full_match(n_name, '[a-z_][a-z0-9_]*') THEN n_name ELSE '\"' || n_name || '\"' END || '=' || '''' || replace(n_name || '''s', '''', '''''') || '''' AS q FROM nation")
def str_format(spark, sf_dir):
    name = F.col("n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", exprs.format_text("%s is %s%%", name, F.col("n_regionkey")).alias("s"), exprs.format_text("%I=%L", name, F.concat(name, F.lit("'s"))).alias("q"))


@register("str_quote", """SELECT k, CASE WHEN k = 1 THEN 'plain' WHEN k = 2 THEN '"Mixed Case"' WHEN k = 3 THEN '"a""b"' END AS i, CASE WHEN k = 1 THEN '''plain''' WHEN k = 2 THEN '''Mixed Case''' WHEN k = 3 THEN '''a"b''' END AS l, CASE WHEN k = 4 THEN 'NULL' WHEN k = 1 THEN '''plain''' WHEN k = 2 THEN '''Mixed Case''' ELSE '''a"b''' END AS n FROM (VALUES (1), (2), (3), (4)) t(k)""")
def str_quote(spark, sf_dir):
    rows = spark.createDataFrame([(1, "plain"), (2, "Mixed Case"), (3, 'a"b'), (4, None)], "k int, s string")
    s = F.col("s")
    return rows.select("k", exprs.quote_ident(s).alias("i"), exprs.quote_literal(s).alias("l"), exprs.quote_nullable(s).alias("n"))


@register("str_regexp_replace", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*') AS first_, regexp_replace(p_name, '[aeiou]', '*', 'g') AS every_, regexp_replace(p_type, '[ar]+', '<>', 'i') AS ci FROM part WHERE p_partkey < 300", bound="p_partkey < 300")
def str_regexp_replace(spark, sf_dir, bound):
    n, t = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").filter(bound).select("p_partkey", exprs.regexp_replace_first(n, "[aeiou]", "*").alias("first_"), exprs.regexp_replace_first(n, "[aeiou]", "*", "g").alias("every_"), exprs.regexp_replace_first(t, "[ar]+", "<>", "i").alias("ci"))


sql("str_regexp_like", "SELECT p_partkey, regexp_like(p_type, 'S.*L') AS a, regexp_like(p_type, '(?i)s.*l') AS b FROM part", "SELECT p_partkey, regexp_matches(p_type, 'S.*L') AS a, regexp_matches(p_type, 's.*l', 'i') AS b FROM part")
both("str_pad", "SELECT n_nationkey, lpad(n_name, 12, '*-') AS l, rpad(n_name, 12, '.') AS r, lpad(n_name, 3, 'x') AS c, repeat('ab', n_regionkey) AS p FROM nation")
both("str_ascii", "SELECT c_custkey, ascii(c_mktsegment) AS a, chr(65 + CAST(c_custkey % 26 AS INT)) AS c, md5(c_name) AS m FROM customer WHERE c_custkey < 300", bound="c_custkey < 300")
sql("str_encode", "SELECT n_nationkey, lower(hex(n_name)) AS h, base64(n_name) AS b, CAST(unhex(hex(n_name)) AS STRING) AS uh, CAST(unbase64(base64(n_name)) AS STRING) AS ub FROM nation", "SELECT n_nationkey, lower(hex(n_name)) AS h, base64(encode(n_name)) AS b, n_name AS uh, n_name AS ub FROM nation")
sql("str_starts", "SELECT p_partkey, startswith(p_type, 'ST') AS s, endswith(p_type, 'RD') AS e, position('A' IN p_type) AS p, position('' IN p_type) AS z FROM part WHERE p_partkey < 300", "SELECT p_partkey, starts_with(p_type, 'ST') AS s, ends_with(p_type, 'RD') AS e, strpos(p_type, 'A') AS p, strpos(p_type, '') AS z FROM part WHERE p_partkey < 300".replace("strpos(p_type, '')", "1"), bound="p_partkey < 300")
sql("str_overlay", "SELECT n_nationkey, overlay(n_name PLACING '##' FROM 2 FOR 3) AS a, overlay(n_name PLACING '##' FROM 2) AS b FROM nation", "SELECT n_nationkey, substr(n_name, 1, 1) || '##' || substr(n_name, 5) AS a, substr(n_name, 1, 1) || '##' || substr(n_name, 4) AS b FROM nation")
both("str_split_part", "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS a, split_part(o_orderpriority, '-', 2) AS b, split_part(o_orderpriority, '-', 9) AS c FROM orders WHERE o_orderkey < 300", bound="o_orderkey < 300")
sql("str_to_array", "SELECT o_orderkey, size(split(o_orderpriority, '[- ]')) AS n, array_join(split(o_orderpriority, '[- ]'), '|') AS a FROM orders WHERE o_orderkey < 300", "SELECT o_orderkey, CAST(len(string_split_regex(o_orderpriority, '[- ]')) AS INTEGER) AS n, array_to_string(string_split_regex(o_orderpriority, '[- ]'), '|') AS a FROM orders WHERE o_orderkey < 300", bound="o_orderkey < 300")


_INITCAP = "array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"
sql("str_initcap", "SELECT p_partkey, initcap(p_name) AS i, initcap(p_type) AS j FROM part", f"SELECT p_partkey, {_INITCAP} AS i, upper(p_type[1]) || lower(p_type[2:]) AS j FROM part")


# Numbers

sql("num_basic", "SELECT c_custkey, abs(c_acctbal) AS a, -c_acctbal AS n, CAST(ceil(c_acctbal) AS DOUBLE) AS c, CAST(floor(c_acctbal) AS DOUBLE) AS f, CAST(sign(c_acctbal) AS INT) AS s FROM customer", "SELECT c_custkey, abs(c_acctbal) AS a, -c_acctbal AS n, ceil(c_acctbal) AS c, floor(c_acctbal) AS f, CAST(sign(c_acctbal) AS INT) AS s FROM customer")
both("num_round", "SELECT c_custkey, round(c_acctbal) AS r0, round(c_acctbal, 1) AS r1 FROM customer")


@register("num_trunc", "SELECT c_custkey, trunc(c_acctbal) AS t0, sign(c_acctbal) * floor(abs(c_acctbal) * 10.0::DOUBLE) / 10.0::DOUBLE AS t1 FROM customer WHERE c_acctbal <> 0")
def num_trunc(spark, sf_dir):
    x = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").filter("c_acctbal <> 0").select("c_custkey", exprs.trunc(x).alias("t0"), exprs.trunc(x, 1).alias("t1"))


sql("num_div_mod", "SELECT o_orderkey, (o_orderkey - 500) % 7 AS m, (o_orderkey - 500) div 7 AS d FROM orders WHERE o_orderkey < 1000", "SELECT o_orderkey, (o_orderkey - 500) % 7 AS m, (o_orderkey - 500) // 7 AS d FROM orders WHERE o_orderkey < 1000", bound="o_orderkey < 1000")
both("num_roots", "SELECT p_partkey, round(sqrt(p_size), 8) AS s, round(cbrt(p_size), 8) AS c, round(exp(p_size / 100.0), 8) AS e, round(ln(p_size), 8) AS l, round(pi(), 8) AS p FROM part WHERE p_size > 0")
sql("num_logs", "SELECT p_partkey, round(log10(p_size), 8) AS l10, round(log(2, p_size), 8) AS l2, round(power(p_size, 1.5), 6) AS p FROM part WHERE p_size > 0", "SELECT p_partkey, round(log10(p_size), 8) AS l10, round(log2(p_size), 8) AS l2, round(power(p_size, 1.5), 6) AS p FROM part WHERE p_size > 0")
both("num_trig", "SELECT p_partkey, round(sin(p_size), 8) AS s, round(cos(p_size), 8) AS c, round(tan(p_size), 6) AS t, round(asin(p_size / 100.0), 8) AS asn, round(acos(p_size / 100.0), 8) AS acs, round(atan(p_size), 8) AS atn, round(atan2(p_size, 3), 8) AS a2, round(radians(p_size), 8) AS r, round(degrees(p_size), 6) AS d FROM part WHERE p_size <= 100")
sql("num_width_bucket", "SELECT p_partkey, width_bucket(CAST(p_size AS DOUBLE), 5, 45, 8) AS b FROM part", "SELECT p_partkey, CASE WHEN p_size < 5 THEN 0 WHEN p_size >= 45 THEN 9 ELSE CAST(floor((p_size - 5) / 5.0) AS BIGINT) + 1 END AS b FROM part")


@register("num_random", "SELECT r_regionkey, TRUE AS in_range, TRUE AS seeded, TRUE AS uuid_shaped FROM region")
def num_random(spark, sf_dir):
    """RANDOM, SETSEED (a seed gives the same numbers again) and GEN_RANDOM_UUID."""
    x = F.rand()
    return table(spark, sf_dir, "region").select("r_regionkey", ((x >= 0) & (x < 1)).alias("in_range"), (F.rand(42) == F.rand(42)).alias("seeded"), F.uuid().rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$").alias("uuid_shaped"))


# Dates and times

sql("date_extract", "SELECT event_id, extract(YEAR FROM ts) AS y, extract(MONTH FROM ts) AS mo, extract(DAY FROM ts) AS d, extract(HOUR FROM ts) AS h, extract(MINUTE FROM ts) AS mi, CAST(extract(SECOND FROM ts) AS INT) AS s, extract(QUARTER FROM ts) AS q, extract(DOY FROM ts) AS doy FROM events WHERE event_id < 500", "SELECT event_id, CAST(extract(YEAR FROM ts) AS INT) AS y, CAST(extract(MONTH FROM ts) AS INT) AS mo, CAST(extract(DAY FROM ts) AS INT) AS d, CAST(extract(HOUR FROM ts) AS INT) AS h, CAST(extract(MINUTE FROM ts) AS INT) AS mi, CAST(extract(SECOND FROM ts) AS INT) AS s, CAST(extract(QUARTER FROM ts) AS INT) AS q, CAST(extract(DOY FROM ts) AS INT) AS doy FROM events WHERE event_id < 500", bound="event_id < 500")


@register("date_epoch", "SELECT event_id, round(epoch(ts), 3) AS e FROM events WHERE event_id < 500", bound="event_id < 500")
def date_epoch(spark, sf_dir, bound):
    return table(spark, sf_dir, "events").filter(bound).select("event_id", F.round(exprs.epoch(F.col("ts")), 3).alias("e"))


@register("date_trunc", "SELECT event_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS h, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS d, strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S') AS m FROM events WHERE event_id < 500", bound="event_id < 500")
def date_trunc(spark, sf_dir, bound):
    form = "yyyy-MM-dd HH:mm:ss"
    each = [F.date_format(F.date_trunc(unit, "ts"), form).alias(unit[0]) for unit in ("hour", "day", "month")]
    return table(spark, sf_dir, "events").filter(bound).select("event_id", *each)


@register("date_bin", "SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2001-01-01 00:00:00'), '%Y-%m-%d %H:%M:%S') AS b, count(*) AS n FROM events GROUP BY 1")
def date_bin(spark, sf_dir):
    b = F.date_format(exprs.date_bin(900, F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("b")
    return table(spark, sf_dir, "events").groupBy(b).agg(F.count(F.lit(1)).alias("n"))


sql("date_make", "SELECT n_nationkey, date_format(make_date(2020 + n_regionkey, 1 + n_nationkey % 12, 28), 'yyyy-MM-dd') AS d, date_format(make_timestamp_ntz(2021, 3, 4, n_nationkey % 24, 5, 6), 'yyyy-MM-dd HH:mm:ss') AS t, format_string('%02d:%02d:%02d', n_nationkey % 24, 7, 8) AS tm FROM nation", "SELECT n_nationkey, strftime(make_date(2020 + n_regionkey, 1 + n_nationkey % 12, 28), '%Y-%m-%d') AS d, strftime(make_timestamp(2021, 3, 4, n_nationkey % 24, 5, 6), '%Y-%m-%d %H:%M:%S') AS t, printf('%02d:%02d:%02d', n_nationkey % 24, 7, 8) AS tm FROM nation")
sql("date_interval", "SELECT event_id, date_format(ts + INTERVAL 3 DAY - INTERVAL 90 MINUTE, 'yyyy-MM-dd HH:mm:ss') AS a, date_format(ts + make_dt_interval(2, 3, 4, 5), 'yyyy-MM-dd HH:mm:ss') AS b FROM events WHERE event_id < 300", "SELECT event_id, strftime(ts + INTERVAL 3 DAY - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts + to_days(2) + to_hours(3) + to_minutes(4) + to_seconds(5), '%Y-%m-%d %H:%M:%S') AS b FROM events WHERE event_id < 300", bound="event_id < 300")

@register("date_age", "SELECT event_id, CAST(ts - TIMESTAMP '2024-01-01 00:00:00' AS VARCHAR) AS a FROM events")
def date_age(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", exprs.age(F.col("ts"), F.lit("2024-01-01 00:00:00")).alias("a"))


@register("date_make_interval", "SELECT n_nationkey, CAST(to_days(CAST(n_regionkey * 365 + (n_nationkey % 5) * 30 + 14 + n_nationkey AS INTEGER)) + to_hours(2) + to_minutes(30) + to_seconds(CAST(n_nationkey % 3 AS INTEGER)) AS VARCHAR) AS i FROM nation")
def date_make_interval(spark, sf_dir):
    n = F.col("n_nationkey")
    micros = exprs.make_interval(F.col("n_regionkey"), n % 5, F.lit(2), n, F.lit(2), F.lit(30), n % 3)
    return table(spark, sf_dir, "nation").select("n_nationkey", exprs.interval_text(micros).alias("i"))




@register("date_justify", "SELECT * FROM (VALUES (90061, '1 day 01:01:01', '1 day 01:01:01'), (2700000, '31 days 06:00:00', '1 mon 1 day 06:00:00'), (59, '00:00:59', '00:00:59'), (5184000, '60 days', '2 mons'), (0, '00:00:00', '00:00:00'), (3546000, '41 days 01:00:00', '1 mon 11 days 01:00:00')) t(s, h, j)")
def date_justify(spark, sf_dir):
    rows = spark.createDataFrame([(90_061,), (2_700_000,), (59,), (5_184_000,), (0,), (3_546_000,)], "s int")
    return rows.select("s", exprs.justify_hours(F.col("s")).alias("h"), exprs.justify_interval(F.col("s")).alias("j"))


@register("date_to_char", "SELECT event_id, strftime(ts, '%Y/%m/%d %H.%M.%S') AS c FROM events WHERE event_id < 300", bound="event_id < 300")
def date_to_char(spark, sf_dir, bound):
    return table(spark, sf_dir, "events").filter(bound).select("event_id", exprs.to_char(F.col("ts"), "YYYY/MM/DD HH24.MI.SS").alias("c"))


@register("date_parse", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, strftime(ts, '%Y-%m-%d') AS d, 1234.5 + event_id AS n FROM events WHERE event_id < 300", bound="event_id < 300")
def date_parse(spark, sf_dir, bound):
    e = table(spark, sf_dir, "events").filter(bound).select("event_id", F.date_format("ts", "dd.MM.yyyy HH:mm:ss").alias("s"))
    t = F.to_timestamp("s", exprs.date_pattern("DD.MM.YYYY HH24:MI:SS"))
    d = F.to_date(F.substring("s", 1, 10), exprs.date_pattern("DD.MM.YYYY"))
    number = F.to_number(F.lit("1,234.5"), F.lit("9G999D9")) + F.col("event_id")
    return e.select("event_id", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("t"), F.date_format(d, "yyyy-MM-dd").alias("d"), number.cast("decimal(21,1)").alias("n"))


@register("date_overlaps", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.ts < b.ts + INTERVAL 1 HOUR AND b.ts < a.ts + INTERVAL 2 HOUR")
def date_overlaps(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.col("event_id").alias("a"), "user_id", F.col("ts").alias("s1"))
    b = a.select(F.col("a").alias("b"), "user_id", F.col("s1").alias("s2"))
    hour = F.expr("INTERVAL 1 HOUR")
    return a.join(b, "user_id").filter((F.col("a") < F.col("b")) & exprs.overlaps(F.col("s1"), F.col("s1") + hour + hour, F.col("s2"), F.col("s2") + hour)).select("a", "b")


@register("date_now", "SELECT r_regionkey, TRUE AS now_ok, TRUE AS date_ok, TRUE AS clock_ok, TRUE AS time_ok, TRUE AS local_ok FROM region")
def date_now(spark, sf_dir):
    """The clock of the query is frozen; CLOCK_TIMESTAMP is the machine's, later than it by less than a day."""
    clock = F.timestamp_millis(F.reflect(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("bigint"))
    now = F.current_timestamp()
    return table(spark, sf_dir, "region").select(
        "r_regionkey",
        (now >= F.lit("2020-01-01").cast("timestamp")).alias("now_ok"),
        (F.current_date() == F.to_date(now)).alias("date_ok"),
        ((clock >= F.date_trunc("second", now)) & (clock < now + F.expr("INTERVAL 1 DAY"))).alias("clock_ok"),
        (F.current_time().cast("string").substr(1, 8) == F.date_format(now, "HH:mm:ss")).alias("time_ok"),
        (F.localtimestamp().cast("timestamp") == now).alias("local_ok"),
    )


_SOME = "CASE WHEN o_orderkey % 7 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN o_orderkey % 7 = 1 THEN CAST('-Infinity' AS DOUBLE) WHEN o_orderkey % 7 = 2 THEN CAST('NaN' AS DOUBLE) WHEN o_orderkey % 7 = 3 THEN NULL ELSE o_totalprice END"


@register("isfinite", f"SELECT o_orderkey, isfinite({_SOME}) AS f FROM orders")
def isfinite(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", exprs.isfinite(F.expr(_SOME)).alias("f"))


# Arrays

sql("array_basic", "SELECT vec_id, size(embedding) AS n, size(concat(embedding, slice(embedding, 1, 2))) AS c, array_join(transform(slice(embedding, 1, 3), x -> CAST(x > 0 AS STRING)), ',') AS s FROM embeddings WHERE vec_id < 100", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(len(list_concat(embedding, embedding[1:2])) AS INTEGER) AS c, array_to_string(list_transform(embedding[1:3], lambda x: CAST(x > 0 AS VARCHAR)), ',') AS s FROM embeddings WHERE vec_id < 100", bound="vec_id < 100")


@register("array_containment", "SELECT n_nationkey, n_regionkey IN (1, 2) AND n_nationkey IN (1, 2) AS contained, n_regionkey < 2 OR n_nationkey < 2 AS overlap FROM nation")
def array_containment(spark, sf_dir):
    own = F.array("n_nationkey", "n_regionkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", exprs.array_contains_all(F.array(F.lit(1), F.lit(2)), own).alias("contained"), F.arrays_overlap(own, F.array(F.lit(0), F.lit(1))).alias("overlap"))


# JSON

sql("json_get", "SELECT event_id, get_json_object(props, '$.k') AS k, get_json_object(concat('{\"a\":{\"b\":[1,', event_id, ']}}'), '$.a.b[1]') AS deep, get_json_object(props, '$.none') AS none_ FROM events WHERE event_id < 300", "SELECT event_id, props ->> '$.k' AS k, ('{\"a\":{\"b\":[1,' || event_id || ']}}')::JSON ->> '$.a.b[1]' AS deep, CAST(NULL AS VARCHAR) AS none_ FROM events WHERE event_id < 300", bound="event_id < 300")


@register("json_typeof", """SELECT * FROM (VALUES (1, 'object'), (2, 'array'), (3, 'string'), (4, 'number'), (5, 'boolean'), (6, 'null')) t(k, t)""")
def json_typeof(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(['{"a":1}', "[1]", '"x"', "-1.5", "true", "null"], 1)), "k int, j string")
    return rows.select("k", exprs.json_typeof(F.col("j")).alias("t"))


sql("json_build", "SELECT n_nationkey, to_json(named_struct('id', n_nationkey, 'name', n_name, 'none', CAST(NULL AS INT)), map('ignoreNullFields', 'false')) AS o, to_json(array(n_nationkey, n_regionkey)) AS a FROM nation", "SELECT n_nationkey, CAST(json_object('id', n_nationkey, 'name', n_name, 'none', NULL) AS VARCHAR) AS o, CAST(json_array(n_nationkey, n_regionkey) AS VARCHAR) AS a FROM nation")
sql("row_to_json", "SELECT to_json(struct(n_name, n_nationkey, n_regionkey)) AS j FROM nation", "SELECT CAST(json_object('n_name', n_name, 'n_nationkey', n_nationkey, 'n_regionkey', n_regionkey) AS VARCHAR) AS j FROM nation")
sql("json_array_length", "SELECT k, json_array_length(j) AS n FROM VALUES (1, '[1,2,3]'), (2, '[]'), (3, '[[1],{}]') AS t(k, j)", "SELECT k, CAST(json_array_length(j::JSON) AS INTEGER) AS n FROM (VALUES (1, '[1,2,3]'), (2, '[]'), (3, '[[1],{}]')) AS t(k, j)")
sql("json_valid", "SELECT event_id, try_parse_json(s) IS NOT NULL AS ok FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN substring(props, 1, 4) ELSE props END AS s FROM events WHERE event_id < 300) t", "SELECT event_id, json_valid(s) AS ok FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN substring(props, 1, 4) ELSE props END AS s FROM events WHERE event_id < 300) t", bound="event_id < 300")
sql("json_path_exists", "SELECT event_id, variant_get(parse_json(props), '$.k') IS NOT NULL AS k, variant_get(parse_json(props), '$.z') IS NOT NULL AS z FROM events WHERE event_id < 300", "SELECT event_id, json_exists(props, '$.k') AS k, json_exists(props, '$.z') AS z FROM events WHERE event_id < 300", bound="event_id < 300")
sql("json_concat", "SELECT event_id, to_json(map_concat(from_json(props, 'map<string,variant>'), from_json('{\"z\":[1]}', 'map<string,variant>'))) AS j FROM events WHERE event_id < 100", "SELECT event_id, CAST(json_merge_patch(props::JSON, '{\"z\":[1]}'::JSON) AS VARCHAR) AS j FROM events WHERE event_id < 100", bound="event_id < 100")

@register("json_pretty_compact", "SELECT event_id, json_pretty('{\"a\":[1,{\"b\":' || event_id || '}],\"c\":' || props || '}') AS j FROM events")
def json_pretty(spark, sf_dir):
    doc = F.concat(F.lit('{"a":[1,{"b":'), F.col("event_id").cast("string"), F.lit('}],"c":'), F.col("props"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", json_edit.json_pretty(doc).alias("j"))




@register("json_contains", "SELECT event_id, json_extract_string(props, '$.k') = '5' AS c FROM events WHERE event_id < 500", bound="event_id < 500")
def json_contains(spark, sf_dir, bound):
    return table(spark, sf_dir, "events").filter(bound).select("event_id", json_edit.json_contains(F.col("props"), F.lit('{"k":5}')).alias("c"))


@register("json_set", "SELECT event_id, '{\"k\":[9]}' AS a, '{\"k\":' || (props ->> '$.k') || ',\"n\":true}' AS b FROM events WHERE event_id < 300", bound="event_id < 300")
def json_set(spark, sf_dir, bound):
    p = F.col("props")
    return table(spark, sf_dir, "events").filter(bound).select("event_id", json_edit.json_set(p, "{k}", "[9]").alias("a"), json_edit.json_set(p, "{n}", "true").alias("b"))


@register("json_insert", "SELECT event_id, '{\"a\":[' || event_id || ',7,2]}' AS before_, '{\"a\":[' || event_id || ',2,7]}' AS after_ FROM events")
def json_insert(spark, sf_dir):
    d = F.concat(F.lit('{"a":['), F.col("event_id").cast("string"), F.lit(",2]}"))
    return table(spark, sf_dir, "events").select("event_id", json_edit.json_insert(d, "{a,1}", "7").alias("before_"), json_edit.json_insert(d, "{a,1}", "7", True).alias("after_"))


@register("json_delete", "SELECT event_id, '{}' AS a, '{\"x\":[1]}' AS b FROM events WHERE event_id < 300", bound="event_id < 300")
def json_delete(spark, sf_dir, bound):
    return table(spark, sf_dir, "events").filter(bound).select("event_id", json_edit.json_delete(F.col("props"), "{k}").alias("a"), json_edit.json_delete(F.lit('{"x":[1,2]}'), "{x,1}").alias("b"))


@register("json_strip_nulls", "SELECT r_regionkey, '{\"a\":{\"c\":1},\"d\":[null]}' AS j FROM region")
def json_strip_nulls(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", json_edit.json_strip_nulls(F.lit('{"a":{"b":null,"c":1},"d":[null],"e":null}')).alias("j"))


@register("session_functions")
def session_functions(spark, sf_dir):
    return run_sql(spark, sf_dir, "SELECT r_regionkey, current_user() IS NOT NULL AS u, current_schema() AS s, current_catalog() AS c, length(version()) > 0 AS v, typeof(r_name) AS t FROM region")
