"""Tables of an input folder as temporary views, and tab-separated copies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; nothing is read until an action, and then only the columns and row groups that are needed."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, query: str) -> None:
    """Make temporary views of the tables that a query names."""
    for name in sorted(set(re.findall(r"\w+", query)) & set(TABLES)):
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sf_dir: str, query: str, args: dict | list | None = None) -> DataFrame:
    """A query over the tables of a folder."""
    register(spark, sf_dir, query)
    return spark.sql(query, args=args) if args else spark.sql(query)


def _escaped(col: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        col = F.replace(col, F.lit(plain), F.lit(code))
    return col


def copy_to(df: DataFrame, path: str) -> None:
    """COPY ... TO: a line a row, fields apart by tabs, null as ``\\N``, and tab, line ends and backslash escaped."""
    fields = [F.coalesce(_escaped(F.col(f"`{f.name}`").cast("string")), F.lit("\\N")) for f in df.schema]
    df.select(F.concat_ws("\t", *fields).alias("value")).write.mode("overwrite").text(path)


def copy_from(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """COPY ... FROM: what ``copy_to`` wrote. A row with another number of fields is an error."""
    fields = F.split("value", "\t", -1)
    rows = spark.read.text(path).select(F.when(F.size(fields) == len(schema), fields).otherwise(F.raise_error(F.lit("a row has another number of fields"))).alias("f"))
    out = []
    for k, field in enumerate(schema):
        raw = F.get("f", F.lit(k))
        text = F.replace(raw, F.lit("\\\\"), F.lit("\x00"))
        for code, plain in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\x00", "\\")):
            text = F.replace(text, F.lit(code), F.lit(plain))
        out.append(F.when(raw != "\\N", text).cast(field.dataType).alias(field.name))
    return rows.select(*out)
