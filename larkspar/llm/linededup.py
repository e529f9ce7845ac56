"""Line dedup over levelled sorted runs of line hashes.

A run is a table (key, n_docs, top), bucketed and sorted by key: the hash of a line's key, how many documents of its batches hold it, and the largest id of a document that does, null where an earlier run has it. Batches are ranges of ids, from
the largest down. Each new batch is counted by key, which is its own sorted run; merge anti-joined with the runs, it is split into the lines that are new, which enter with the largest id that holds them, and the rest, which add
their counts only, since the document that keeps such a line came before. When a level has FANOUT runs, they are compacted into one of the next level, so that each entry is rewritten a logarithmic number of times. At the end all runs are
summed by key, and the lines that enough documents hold go from all documents but the one of the largest id.

All of it is DataFrame code. Runs have as many buckets as a shuffle has partitions, so that the merge joins read them without an exchange. Lines travel as 16-byte hashes, once to be counted and once, with their positions, to be looked up;
texts move once, to meet the positions that they lose. Counts are pre-aggregated before the shuffle, runs have one row for a key, and the join of a line that a third of all documents hold with its one entry is split by adaptive execution.

Rows: every row counts as a document; rows that share an id count one each and are treated alike, and all with the largest id keep the line. A null or empty text is one empty line. A null id is below all others. A very long text is split in one task,
and its lines cost time in proportion to them. Lines repeated within a document count once and go together. An empty table gives an empty one. Columns keep their names whatever they are, but those named like the counts asked for, which give way.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.llm.common import LOWER, UPPER, Stash, delete_path, dropped_with, shared_dir

#: Runs of a level that are compacted into one of the next.
FANOUT = 3
#: Batches that a whole table is added in.
BATCHES = 4
MIN_CHARS, MIN_DOCS = 40, 5
_BLANK = " \t\n\x0b\x0c\r"
#: Below every id: stands for a null one.
_LEAST = -(1 << 63)


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), UPPER, LOWER)


def lines(text: Column) -> Column:
    """Lines of a text; null or empty: one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def wrapped(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, id, print): the whole row as a struct, so that no name of it clashes with ours; its id, and a hash of its text that tells rows of one id apart."""
    row_id = F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(_LEAST))
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), row_id.alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("print"))


def keyed(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(id, key): the hash of each distinct long enough key of each row."""
    keys = F.array_distinct(F.filter(F.transform(lines(F.col("row")[text]), line_key), lambda k: F.length(k) >= min_chars))
    return docs.select("id", F.explode(keys).alias("line")).select("id", key_hash(F.col("line")).alias("key"))


def placed(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(id, print, pos, key): each line with a long enough key."""
    each = docs.select("id", "print", F.posexplode(F.transform(lines(F.col("row")[text]), line_key)).alias("pos", "line"))
    return each.filter(F.length("line") >= min_chars).select("id", "print", "pos", key_hash(F.col("line")).alias("key"))


class Run:
    """A table bucketed and sorted by ``key`` in the shared folder, so that joins on it need no exchange; ``drop()`` deletes it."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.name = f"line_run_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/larkspar/{self.name}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(buckets, "key").sortBy("key").option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    @property
    def rows(self) -> DataFrame:
        """The run's rows, not known to be bucketed: Spark 4.1 takes a union of equally bucketed tables for bucketed itself, and so would group each of them apart."""
        return self.spark.read.schema(self.df.schema).parquet(self.path)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


class LineRuns:
    """Levelled sorted runs."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[Run]] = []

    @property
    def runs(self) -> list[Run]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """Add the run of a batch (id, key), one row for each document and key, whose ids are below those of all batches before.

        Of its keys, those that no run holds enter with their largest id; the others add their counts.
        """
        own = batch.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("top"))
        if self.runs:
            counted = Run(own)
            new = Run(self.novel(counted.df))
            known = self._apart(counted.df, new).select("key", "n_docs", F.lit(None).cast("bigint").alias("top"))
            run = Run(new.df.unionByName(known))
            for r in (counted, new):
                r.drop()
        else:
            run = Run(own)
        self._put(run, 0)

    def _put(self, run: Run, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged, old = Run(self._merge(self.levels[level])), self.levels[level]
            self.levels[level] = []
            for r in old:
                r.drop()
            self._put(merged, level + 1)

    @staticmethod
    def _merge(runs: list[Run]) -> DataFrame:
        every = reduce(DataFrame.unionByName, [r.rows for r in runs])
        return every.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("top").alias("top"))

    @staticmethod
    def _apart(batch: DataFrame, run: Run) -> DataFrame:
        """Rows of a batch whose key a run lacks: a merge anti-join."""
        return batch.join(run.df.select("key").hint("merge"), "key", "left_anti")

    def known(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch whose key some run holds."""
        parts, rest = [], batch
        for r in self.runs:
            parts.append(rest.join(r.df.select("key").hint("merge"), "key", "left_semi"))
            rest = self._apart(rest, r)
        return reduce(DataFrame.unionByName, parts) if parts else batch.limit(0)

    def novel(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch whose key no run holds: a merge anti-join with one sorted run after another."""
        return reduce(self._apart, self.runs, batch)

    def frequent(self, min_docs: int) -> Stash | None:
        """Entries (key, top) of lines that at least ``min_docs`` documents hold, over all runs; the runs go."""
        if not self.runs:
            return None
        found = Stash(self._merge(self.runs).filter(F.col("n_docs") >= min_docs).select("key", "top"))
        for r in self.runs:
            r.drop()
        self.levels = []
        return found


def dedup_lines(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, counts: tuple[str, str] | None = ("n_lines", "n_dropped")
) -> DataFrame:
    """All columns of ``df``, ``text`` without its dropped lines, and how many lines it had and lost, under the names in ``counts``, if any, to which columns of those names give way.

    A line whose key has at least ``min_chars`` code points and is held by at least ``min_docs`` documents goes from every document but that of the largest id. Batches are ranges of ids, so that each reads
    its own row groups only where files are in order of id.
    """
    docs = wrapped(df, doc_id, text)
    runs = LineRuns(df.sparkSession)
    bounds = sorted(set(map(int, df.select(F.col(f"`{doc_id}`").cast("bigint").alias("i")).stat.approxQuantile("i", [k / batches for k in range(1, batches)], 0.02)))) if batches > 1 else []
    edges = [None, *bounds, None]
    raw = F.col(f"`{doc_id}`").cast("bigint")
    for low, high in reversed(list(zip(edges[:-1], edges[1:], strict=True))):
        part = df
        if low is not None:
            part = part.filter(raw >= low)
        if high is not None:
            part = part.filter((raw < high) | raw.isNull() if low is None else raw < high)
        runs.add(keyed(wrapped(part, doc_id, text), text, min_chars))
    frequent = runs.frequent(min_docs)
    drops = placed(docs, text, min_chars).join(frequent.df, "key").filter(F.col("id") != F.col("top")).select("id", "print", "pos")
    return dropped_with(_without(docs, drops, df.columns, text, counts), frequent)


def _without(docs: DataFrame, drops: DataFrame, columns: list[str], text: str, counts: tuple[str, str] | None) -> DataFrame:
    """``columns`` of wrapped documents, ``text`` without the lines at the places that ``drops`` (id, print, pos) lists, and the counts."""
    lost = drops.groupBy("id", "print").agg(F.collect_set("pos").alias("lost"))
    own = F.coalesce(F.col("row")[text], F.lit(""))
    n_lines = F.octet_length(own) - F.octet_length(F.replace(own, F.lit("\n"), F.lit(""))) + 1
    every = lines(own)
    stay = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), own).otherwise(F.array_join(F.transform(stay, lambda k: F.get(every, k)), "\n"))
    out = [kept.alias(text) if c == text else F.col("row")[c].alias(c) for c in columns if c not in (counts or ())]
    if counts:
        out += [n_lines.cast("bigint").alias(counts[0]), F.coalesce(F.size("lost"), F.lit(0)).cast("bigint").alias(counts[1])]
    return docs.join(lost, ["id", "print"], "left").select(*out)


def admit(runs: LineRuns, batch: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """A new batch of documents without the lines that earlier batches hold; its own lines are added to the runs. For streams of batches, whose ids may be in any order.

    Of the batch's lines only those that no run holds yet are added, with counts of this batch; the result is written before that, since it depends on the runs as they were. Lines repeated within the batch stay.
    """
    docs = wrapped(batch, doc_id, text)
    own = Stash(placed(docs, text, min_chars))
    out = Stash(_without(docs, runs.known(own.df).select("id", "print", "pos"), batch.columns, text, ("n_lines", "n_dropped")))
    runs.add(runs.novel(own.df.select("id", "print", "key").distinct()).select("id", "key"))
    own.drop()
    return out.df
