"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, the only separators of words and the only characters stripped from lines.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)

#: Rows of one Arrow batch handed to Python: long texts make a row count the wrong measure, so it is small.
BATCH_ROWS = 256


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder, by Spark's own reader, so that any Hadoop path does."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.translate(_FOLD)


def folded(col: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def words(col: Column) -> Column:
    """The folded words of a text as an array; empty for null, empty or blank texts.

    All separators become blanks by one character map, so that the split is on a fixed single character.
    """
    spaced = F.translate(F.coalesce(col, F.lit("")), UPPER + "\t\n\x0b\x0c\r", LOWER + " " * 5)
    return F.array_remove(F.split(spaced, " "), "")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, so that a batch of very long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with state that each Python task makes once, by ``make()``."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(run, schema)


def with_text(df: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, T.StructType]:
    """The ``keep`` columns and, last, the text, under a name that none of them has; and the schema without it. ``keep`` must not hold a name that the operator gives its results."""
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(fresh(df, "text_")))
    return kept, T.StructType(kept.schema.fields[:-1])


def texts(batch: pa.RecordBatch) -> list[str]:
    """The last column as Python strings, null as empty."""
    return [x or "" for x in batch.columns[-1].to_pylist()]


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where it is unset on one machine, as in tests, one of our own. On a cluster it must be set: executors do not see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="larkspar-")
        found = _own[app]
    return found.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Stash:
    """A DataFrame written as a compressed table in the shared folder: reread after a lost executor, deleted when done with.

    ``df`` reads it. ``drop()`` deletes the files; call it only when nothing will read ``df`` any more.
    """

    def __init__(self, df: DataFrame, sort: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/larkspar/{uuid.uuid4().hex}"
        if sort:
            df = df.sortWithinPartitions(*sort)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def dropped_with(df: DataFrame, *stashes: Stash) -> DataFrame:
    """``df``, with its tables in the shared folder deleted when the session's process ends."""
    for s in stashes:
        weakref.finalize(df.sparkSession, _quiet_drop, s.spark, s.path)
    return df


def numbered(df: DataFrame, name: str) -> Stash:
    """``df`` with a number of its own for each row, written, so that it stays the row's: an id may be null or repeated."""
    return Stash(df.withColumn(name, F.monotonically_increasing_id()))


def _quiet_drop(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # the session may be gone by then; the folder's owner clears it
        return


def input_bytes(df: DataFrame, text: str) -> int:
    """Bytes of the files that a plan reads, as the optimiser knows them without reading them; where it does not, the bytes of the ``text`` column, by a pass over it."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    known = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if known < 1 << 60:  # else a default that stands for any size
        return known
    return df.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0


def byte_text(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column as Python strings, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
