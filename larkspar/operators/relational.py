"""Relational operators that Spark's syntax lacks, as compositions of what it has."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from larkspar.functions.exprs import cosine_distance, l2_distance


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """DISTINCT ON: the first row of each key in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).filter("__n = 1").drop("__n")


def sort_columns(order: Sequence[tuple[str, bool]]) -> list[Column]:
    """Sort keys of (column, ascending), nulls last when ascending and first when not."""
    return [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in order]


def fetch_with_ties(df: DataFrame, n: int, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES: the first n rows and all equal to the last of them, by (column, ascending) keys.

    The first n keys are found by a bounded top-n, at most n rows to broadcast, and the rows by a semi-join with them: no global sort, no task with all rows.
    """
    top = df.orderBy(*sort_columns(order)).limit(n).select(*[F.col(c).alias(f"__{k}") for k, (c, _) in enumerate(order)]).distinct()
    cond = F.lit(True)
    for k, (c, _) in enumerate(order):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__{k}"))
    return df.join(F.broadcast(top), cond, "left_semi")


def groups_frame(df: DataFrame, partition: Sequence[str], order: Column, agg: Callable[[WindowSpec], Column], preceding: int, following: int, out: str) -> DataFrame:
    """A GROUPS frame: offsets count peer groups, numbered by a dense rank, over which a RANGE frame is the same."""
    ranked = df.withColumn("__g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    frame = Window.partitionBy(*partition).orderBy("__g").rangeBetween(-preceding, following)
    return ranked.withColumn(out, agg(frame)).drop("__g")


def frame_exclude(df: DataFrame, partition: Sequence[str], order: Sequence[Column], value: Column, start: int, end: int, exclude: str, out: str, agg: str = "sum") -> DataFrame:
    """``agg`` (sum, count or avg) of ``value`` over ROWS start..end without the current row, its peer group, or its peers but itself (``exclude``: current, group, ties); a sum or average of nothing is null.

    A peer group is a run of rows, so its rows within the frame are the same frame over the group alone: what stays is one window's sums less the other's, and no row holds its frame. Numbers that are not finite are counted apart, since they cannot be taken off a sum.
    Rows that tie in ``order`` come in one order of the engine's choosing, the same in both windows.
    """
    by = Window.partitionBy(*partition).orderBy(*order)
    x = value.cast("double")
    ranked = df.withColumns({"__r": F.row_number().over(by), "__g": F.dense_rank().over(by), "__x": x})
    x, inf = F.col("__x"), float("inf")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf)
    terms = {"__s": F.when(finite, x).otherwise(0.0), "__n": x.isNotNull(), "__nan": F.isnan(x), "__up": x == inf, "__down": x == -inf}
    ranked = ranked.withColumns({k: c if k == "__s" else F.coalesce(c, F.lit(False)).cast("bigint") for k, c in terms.items()})
    frame = Window.partitionBy(*partition).orderBy("__r").rowsBetween(start, end)
    peers = Window.partitionBy(*partition, "__g").orderBy("__r").rowsBetween(start, end)
    here = start <= 0 <= end

    def gone(c: str) -> Column:
        own = F.col(c) if here else F.lit(0)
        return own if exclude == "current" else F.sum(c).over(peers) if exclude == "group" else F.sum(c).over(peers) - own

    left = ranked.withColumns({f"{c}_left": F.coalesce(F.sum(c).over(frame), F.lit(0)) - F.coalesce(gone(c), F.lit(0)) for c in terms})
    n, nan, up, down = (F.col(f"{c}_left") for c in ("__n", "__nan", "__up", "__down"))
    total = F.when((nan > 0) | (up > 0) & (down > 0), float("nan")).when(up > 0, inf).when(down > 0, -inf).otherwise(F.col("__s_left"))
    answer = {"sum": F.when(n > 0, total), "count": n, "avg": F.when(n > 0, total / n)}[agg]
    return left.withColumn(out, answer).drop("__r", "__g", "__x", *terms, *[f"{c}_left" for c in terms])


def upsert_do_nothing(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """INSERT ... ON CONFLICT DO NOTHING."""
    return target.unionByName(new.join(target.select(*key), list(key), "left_anti").select(*target.columns))


def upsert_do_update(target: DataFrame, new: DataFrame, key: Sequence[str], updates: dict[str, Column], where: Column | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT DO UPDATE SET ... [WHERE]: in the expressions, ``t.c`` is the row there and ``excluded.c`` the new one. One full join on the key."""
    t, e = target.alias("t"), new.alias("excluded")
    cond = [F.col(f"t.{k}") == F.col(f"excluded.{k}") for k in key]
    both = t.join(e, cond, "full")
    there, fresh = F.col(f"t.{key[0]}").isNotNull(), F.col(f"excluded.{key[0]}").isNotNull()
    hit = there & fresh & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
    return both.select(*[F.when(hit, updates[c]).when(there, F.col(f"t.{c}")).otherwise(F.col(f"excluded.{c}")).alias(c) if c in updates else F.when(there, F.col(f"t.{c}")).otherwise(F.col(f"excluded.{c}")).alias(c) for c in target.columns])


def update_where(df: DataFrame, updates: dict[str, Column], where: Column) -> DataFrame:
    """UPDATE ... SET ... WHERE: every expression sees the row as it was."""
    return df.select(*[F.when(where, updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c) for c in df.columns])


def delete_where(df: DataFrame, where: Column) -> DataFrame:
    """DELETE ... WHERE: rows for which the condition is null stay."""
    return df.filter(~F.coalesce(where, F.lit(False)))


def delete_returning(df: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """DELETE ... WHERE ... RETURNING *: the rows that stay, and those that go."""
    return delete_where(df, where), df.filter(where)


def truncate(df: DataFrame) -> DataFrame:
    """TRUNCATE: the table without rows; nothing of it is read."""
    return df.filter(F.lit(False))


def insert(target: DataFrame, new: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """INSERT INTO target (columns of new): a column that is not given takes its default, or null."""
    given, defaults = set(new.columns), defaults or {}
    types = dict(target.dtypes)
    return target.unionByName(new.select(*[(F.col(f"`{c}`") if c in given else defaults.get(c, F.lit(None))).cast(types[c]).alias(c) for c in target.columns]))


def explain(df: DataFrame) -> DataFrame:
    """EXPLAIN: the plan, a row for each line."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return df.sparkSession.createDataFrame(list(enumerate(text.splitlines(), 1)), "line int, plan string")


def not_null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column and number of its nulls, for columns that must have none and do; one pass."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_nulls")) for c in columns])
    return counts.select(F.explode(rows).alias("r")).select("r.column_name", "r.n_nulls").filter("n_nulls > 0")


def unique_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that occur more than once in columns that must be unique; nulls do not count."""
    present = df.na.drop(subset=list(columns))
    return present.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


#: Rows up to which distinct values are counted one by one, as a fixed value of ANALYZE.
EXACT_ROWS = 10_000


def analyze_stats(df: DataFrame, columns: Sequence[str], exact: bool | None = None) -> DataFrame:
    """Row count, null fraction, distinct values, least and greatest of each column; distinct values by HyperLogLog (within about 5 %) if not ``exact``, by default for more than EXACT_ROWS rows."""
    if exact is None:
        exact = df.limit(EXACT_ROWS + 1).count() <= EXACT_ROWS
    count = F.count_distinct if exact else F.approx_count_distinct
    aggs = [F.count(F.lit(1)).alias("n")]
    for k, c in enumerate(columns):
        aggs += [F.count(c).alias(f"c{k}"), count(F.col(c)).alias(f"d{k}"), F.min(c).cast("string").alias(f"lo{k}"), F.max(c).cast("string").alias(f"hi{k}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col("n").alias("row_count"),
                (F.lit(1.0) - F.try_divide(F.col(f"c{k}"), F.col("n"))).alias("null_frac"),
                F.col(f"d{k}").alias("n_distinct"),
                F.col(f"lo{k}").alias("min_value"),
                F.col(f"hi{k}").alias("max_value"),
            )
            for k, c in enumerate(columns)
        ]
    )
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def most_common(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The most common values of a column, ties by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("freq")).orderBy(F.desc("freq"), column).limit(n)


def histogram_bounds(df: DataFrame, column: str, buckets: int = 8, ranges: int = 256) -> list:
    """Bounds of an equi-depth histogram: exact percentiles, interpolated; None for a column without values.

    Values are counted, the counts are dealt to ``ranges`` ranges by a sketch of percentiles, and running counts are made within each: no task has them all, and the driver gets a count for each range and two values for each bound.
    """
    counts = df.select(F.col(f"`{column}`").cast("double").alias("x")).filter("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    cuts = sorted(set(counts.agg(F.percentile_approx("x", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []))
    dealt = counts.withColumn("range", F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c < F.col("x"))))
    before, total = {}, 0
    for r, n in sorted(dealt.groupBy("range").agg(F.sum("n")).collect()):
        before[r], total = total, total + n
    if not total:
        return [None] * (buckets + 1)
    start = F.element_at(F.create_map(*[F.lit(v).cast("bigint") for kv in before.items() for v in kv]), F.col("range").cast("bigint"))
    upto = start + F.sum("n").over(Window.partitionBy("range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    places = [k * (total - 1) / buckets for k in range(buckets + 1)]
    wanted = sorted({int(p) for p in places} | {min(int(p) + 1, total - 1) for p in places})
    ranked = dealt.withColumn("upto", upto).withColumn("at", F.explode(F.filter(F.lit(wanted).cast("array<bigint>"), lambda w: (w < F.col("upto")) & (w >= F.col("upto") - F.col("n")))))
    value = {r["at"]: r["x"] for r in ranked.select("at", "x").collect()}
    return [value[int(p)] + (value[min(int(p) + 1, total - 1)] - value[int(p)]) * (p - int(p)) if p > int(p) else value[int(p)] for p in places]


def nearest(df: DataFrame, vector: str, query: Sequence[float], k: int, metric: str = "l2", tie: str | None = None, offset: int = 0) -> DataFrame:
    """ORDER BY vector <-> query LIMIT k OFFSET offset: exact, by a bounded top-k of each task and one merge of those."""
    distance = {"l2": l2_distance, "cosine": cosine_distance}[metric]
    q = F.lit([float(x) for x in query])
    out = df.withColumn("distance", distance(F.col(vector), q)).orderBy("distance", *([tie] if tie else []))
    return (out.offset(offset) if offset else out).limit(k)


#: Query vectors that go to the tasks at once.
QUERIES = 1024


def _nearest_of_block(ids: list[int], block: np.ndarray, k: int, metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's rows (key, vector), the k nearest to each query, ties by key; vectors without a distance come last."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
        for batch in batches:
            keys, vectors = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(1).to_pylist(), np.float64)
            for i, q in enumerate(block):
                if metric == "l2":
                    d = np.sqrt(((vectors - q) ** 2).sum(axis=1))
                else:
                    with np.errstate(invalid="ignore", divide="ignore"):
                        d = 1 - vectors @ q / (np.sqrt((vectors**2).sum(axis=1)) * np.sqrt((q**2).sum()))
                d, at = np.concatenate((near[i][0], d)), np.concatenate((near[i][1], keys))
                best = np.lexsort((at, d))[:k]
                near[i] = d[best], at[best]
        each = [len(d) for d, _ in near]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), each)), pa.array(np.concatenate([a for _, a in near])), pa.array(np.concatenate([d for d, _ in near]))], names=["query", "key", "distance"])

    return work


def nearest_each(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int, metric: str = "l2", offset: int = 0) -> DataFrame:
    """(query, key, distance): for each row of ``queries``, ORDER BY vector <-> query, key LIMIT k OFFSET offset over all of ``df``.

    Exact, by one pass over ``df`` for each block of queries, with a bounded top-k of each task and query and one merge of those. Null vectors are left out on both sides.
    """
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("vector")).filter("vector IS NOT NULL")
    parts, block = [], []

    def close() -> None:
        work = _nearest_of_block([r[0] for r in block], np.array([r[1] for r in block], np.float64), k + offset, metric)
        parts.append(rows.mapInArrow(work, "query bigint, key bigint, distance double"))
        block.clear()

    for row in queries.select(F.col(key).cast("bigint"), F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL").toLocalIterator():
        block.append(row)
        if len(block) == QUERIES:
            close()
    if block or not parts:
        close() if block else parts.append(df.sparkSession.createDataFrame([], "query bigint, key bigint, distance double"))
    n = F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))
    return reduce(DataFrame.unionByName, parts).withColumn("n", n).filter((F.col("n") > offset) & (F.col("n") <= k + offset)).drop("n")
