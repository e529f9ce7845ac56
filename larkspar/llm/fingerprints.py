"""Document fingerprints: content-defined chunks of a text, and the containment of one chunk set in another.

A gear hash runs over the UTF-8 bytes: h = (h << 1) + GEAR[byte], in 32 bits, so that the bits tested depend on the last few bytes only
and a boundary moves with its content. Chunking is normalised: up to the normal length a cut needs more zero bits, beyond it fewer, and lengths
stay between a least and a most. A fingerprint is the set of chunk digests, each weighted by its chunk's bytes; the likeness of two is the
weight they share over the weight of the lighter one.

Rows: null text counts as empty; an empty text has an empty fingerprint, which is wholly like another empty one and unlike all others. A very long text is chunked whole, in one task. Rows of one id are in order of text, and equal rows are each
other's next; rows of a null id come after all others, in order of text. Ids may be any 64-bit integers. A table of one row is its own next one; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from larkspar.llm.common import input_bytes, map_rows, small_batches, texts, with_text

#: Bytes of a chunk.
LEAST, NORMAL, MOST = 16, 48, 192
#: Bits that must be zero at a cut: 6 of them before the normal length, 4 of the same after it. Bits 12 to 19 see about the last 20 bytes.
STRICT, LOOSE = np.uint32(0x3F << 13), np.uint32(0x0F << 13)
#: A random number for each byte value, by a fixed seed.
GEAR = np.random.default_rng(20_240).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Bytes of a chunk's digest.
DIGEST = 8
#: Bytes of input for one task that edits and fingerprints.
TASK_BYTES = 8 << 20
#: Ranges of ids at most, since the driver and each task hold two numbers for each; beyond, ranges grow, and each is sorted on disk and streamed through its task.
MOST_RANGES = 20_000


def gear(raw: bytes) -> np.ndarray:
    """The rolling hash after each byte, all at once: windows of 1, 2, 4 ... 32 bytes, each from two of half the length."""
    h = GEAR[np.frombuffer(raw, np.uint8)]
    for w in (1, 2, 4, 8, 16):
        h[w:] += h[:-w] << np.uint32(w)
    return h


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks of ``raw``, the last one its length; none for no bytes."""
    n, out, start = len(raw), [], 0
    if not n:
        return out
    h = gear(raw)
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[loose] & STRICT) == 0).tolist()
    for end, hard in zip((loose + 1).tolist(), strict, strict=True):
        while end - start > MOST:
            start += MOST
            out.append(start)
        size = end - start
        if size >= LEAST and (hard or size >= NORMAL):
            out.append(end)
            start = end
    while n - start > MOST:
        start += MOST
        out.append(start)
    if n > start:
        out.append(n)
    return out


def chunks(raw: bytes) -> dict[str, int]:
    """Digest and bytes of each distinct chunk."""
    out, start, blake = {}, 0, hashlib.blake2b
    for end in cuts(raw):
        out[blake(raw[start:end], digest_size=DIGEST).hexdigest()] = end - start
        start = end
    return out


def joined(found: dict[str, int]) -> str:
    return ",".join(f"{k}:{v}" for k, v in sorted(found.items()))


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """Shared weight over that of the lighter; 1 for two empty ones, 0 for one."""
    if not a or not b:
        return float(not a and not b)
    shared = sum(a[k] for k in a.keys() & b.keys())
    return min(1.0, shared / min(sum(a.values()), sum(b.values())))


def fingerprint(df: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the fingerprint string of ``text``: ``digest:bytes`` by digest, comma-joined."""
    kept, schema = with_text(df, keep, text)
    schema = schema.add("fingerprint", "string")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [joined(chunks(x.encode())) for x in texts(batch)]
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string())], names=[*keep, "fingerprint"])

        return work

    return map_rows(kept, make, schema)


def with_neighbours(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (bucket, copy, id, text), partitioned by bucket and sorted, so that the row after a row is its next one by descending id.

    Buckets are ranges of ids of about as many rows each. A bucket's last row needs the first of the next lower bucket that has rows, so that one row
    goes to both, once as a copy; the lowest bucket gets the first row of all. So the texts are shuffled once. What the driver holds is two
    numbers for each bucket. Ties of id are in order of text; a null id comes after all others.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs, "text") // TASK_BYTES + 1), MOST_RANGES)
    bounds = np.unique(np.array(docs.stat.approxQuantile("id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else [], dtype=np.float64))
    # Ids reach Python without nulls, which would make them floating-point numbers there.
    known, missing = F.coalesce("id", F.lit(0)), F.col("id").isNull()

    @pandas_udf("int")
    def bucket_of(ids: pd.Series, missing: pd.Series) -> pd.Series:
        return pd.Series(np.where(missing, 0, np.searchsorted(bounds, ids.astype("float64"), side="right")).astype("int32"))

    tops = sorted((b, i) for b, i in docs.select("id").groupBy(bucket_of(known, missing).alias("b")).agg(F.max("id")).collect())
    targets: dict[int | None, list[int]] = {}
    for k, (_, top) in enumerate(tops):
        above = tops[(k + 1) % len(tops)][0]  # the highest bucket's first row also goes to the lowest
        targets.setdefault(top, []).append(above)

    @pandas_udf("array<int>")
    def goes_to(ids: pd.Series, missing: pd.Series) -> pd.Series:
        own = np.where(missing, 0, np.searchsorted(bounds, ids.astype("float64"), side="right"))
        return pd.Series([[int(b), *targets.get(None if m else int(i), ())] for b, i, m in zip(own, ids, missing, strict=True)])

    small_batches(spark)
    return (
        docs.select("*", F.posexplode(goes_to(known, missing)).alias("copy", "bucket"))
        .repartition(n, "bucket")
        .sortWithinPartitions(F.col("bucket"), F.col("copy") > 0, F.col("id").desc_nulls_last(), F.col("text"))
        .select("bucket", "copy", "id", "text")
    )


def compare_edited(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and of its next document.

    The edited text: the last floor(n / 3) code points give way to the first as many, or all, of the next document by descending id (after the last: the first).
    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A row alone is its own next one.
    """
    rows = with_neighbours(df, doc_id=doc_id, text=text)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        last = None  # bucket, id, text, chunks of the row before

        for batch in batches:
            out = []
            for bucket, copy, i, own in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                found = chunks(own.encode())
                if last is not None and last[0] == bucket:
                    _, before_id, before, before_chunks = last
                    n = len(before)
                    changed = n // 3
                    edited = (before[: n - changed] + own[:changed]).encode()
                    edited_chunks = chunks(edited)
                    out.append((before_id, n, hashlib.sha256(edited).hexdigest(), joined(before_chunks), joined(edited_chunks), likeness(before_chunks, edited_chunks), likeness(before_chunks, found)))
                last = None if copy else (bucket, i, own, found)  # a copy is only somebody's next row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
