"""Byte-level BPE by a rank queue.

A pre-token is a linked list of parts. For each merge rank there is a bucket of list positions whose pair has that rank; a
hierarchical bitmap over the ranks (words of about the square root of the ranks in bits, and one summary bit a word) says which buckets hold
something, so the next rank is found by a find-first-set on each level instead of a scan or a heap of all pairs. A popped position is stale, and
skipped, if its pair has changed since. The work is near n log n for a pre-token of n bytes, so a pre-token of a million letters does not take quadratic time.

Rows: null and empty texts have no tokens. A very long text, or pre-token, is encoded whole. Of equal ranks in a pre-token the leftmost is merged first. Repeated rows stay. An empty table gives an empty one; columns other than the text and those
kept are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspar.llm.common import map_rows, texts, with_text

#: Distinct pre-tokens that a task remembers, at most; then it forgets them all.
MEMO = 600_000
#: Longer pre-tokens, in bytes, are not remembered.
MEMO_BYTES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Encodes by ranks, as the tiktoken library does: a pre-token that is a token as a whole, else lowest rank first, leftmost first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.size = max(ranks.values(), default=0) + 1
        self.vocab: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.vocab[rank] = token
        self.of_byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(self.of_byte) < 0:
            raise ValueError("the ranks lack some single bytes")
        self.words = [i.to_bytes(4, "little") for i in range(self.size)]
        # Of the queue, empty between pre-tokens: the bucket of each rank, the bitmap's lower level and the shift and bits of its words.
        self.shift = ((self.size - 1).bit_length() + 1) // 2
        self.bits = [1 << k for k in range(1 << self.shift)]
        self.low = [0] * (1 << self.shift)
        self.buckets: list[list[int] | None] = [None] * self.size
        #: Rank of the token that two adjacent tokens make, -1 if they make none, by left * size + right.
        self.pairs: dict[int, int] = {}
        self.memo: dict[str, bytes] = {}

    def _pair(self, key: int) -> int:
        """Look a pair up that ``pairs`` lacks."""
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        left, right = divmod(key, self.size)
        rank = self.pairs[key] = self.ranks.get(self.vocab[left] + self.vocab[right], -1)
        return rank

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token. The queue's steps are written out here, since a call for each would take longer than the step."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        known, look, size = self.pairs.get, self._pair, self.size
        buckets, low, bits, shift, mask = self.buckets, self.low, self.bits, self.shift, (1 << self.shift) - 1
        of_byte = self.of_byte
        token = [of_byte[b] for b in piece]
        end = len(token)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        pending = []  # rank of the pair that starts at a position; -1: none, or the position is gone
        top = 0
        for i in range(end - 1):
            rank = known(key := token[i] * size + token[i + 1])
            if rank is None:
                rank = look(key)
            pending.append(rank)
            if rank >= 0:
                if (bucket := buckets[rank]) is not None:
                    bucket.append(i)  # in order of position, so a heap
                else:
                    buckets[rank] = [i]
                    low[w := rank >> shift] |= bits[rank & mask]
                    top |= bits[w]
        pending.append(-1)
        while top:
            w = (top & -top).bit_length() - 1
            word = low[w]
            rank = w << shift | ((word & -word).bit_length() - 1)
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                buckets[rank] = None
                low[w] = word = word & (word - 1)
                if not word:
                    top ^= bits[w]
            if pending[i] != rank:
                continue  # stale
            gone = after[i]
            token[i] = rank
            pending[gone] = pending[i] = -1
            follow = after[i] = after[gone]
            if follow < end:
                before[follow] = i
                new = known(key := rank * size + token[follow])
                if new is None:
                    new = look(key)
                if new >= 0:
                    pending[i] = new
                    if (bucket := buckets[new]) is not None:
                        heappush(bucket, i)
                    else:
                        buckets[new] = [i]
                        low[w := new >> shift] |= bits[new & mask]
                        top |= bits[w]
            back = before[i]
            if back >= 0:
                new = known(key := token[back] * size + rank)
                if new is None:
                    new = look(key)
                pending[back] = new
                if new >= 0:
                    if (bucket := buckets[new]) is not None:
                        heappush(bucket, back)
                    else:
                        buckets[new] = [back]
                        low[w := new >> shift] |= bits[new & mask]
                        top |= bits[w]
        out, i = [], 0
        while i < end:
            out.append(token[i])
            i = after[i]
        return out

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        memo, pieces, words = self.memo, self.split(text), self.words
        try:
            return b"".join(map(memo.__getitem__, pieces))
        except KeyError:
            pass
        get, out = memo.get, []
        for piece in pieces:
            ids = get(piece)
            if ids is None:
                raw = piece.encode()
                ids = b"".join([words[i] for i in self.merge(raw)])
                if len(raw) <= MEMO_BYTES:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return list(unpack(self.packed(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


def unpack(packed: bytes) -> array:
    ids = array("I")
    ids.frombytes(packed)
    if array("H", [1]).tobytes()[0] == 0:
        ids.byteswap()
    return ids


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a Python worker and vocabulary; the vocabulary file is installed on every machine."""
    return Encoder(load_ranks(path), pattern)


def encode(df: DataFrame, path: str, pattern: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids") -> DataFrame:
    """``keep`` columns and the token ids of ``text`` (array<int>; empty for null or empty texts), one row for each row."""
    kept, schema = with_text(df, keep, text)
    schema = schema.add(out, T.ArrayType(T.IntegerType()))

    def make():
        coder = encoder(path, pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            packed = [coder.packed(x) for x in texts(batch)]
            offsets = [0]
            for p in packed:
                offsets.append(offsets[-1] + len(p) // 4)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))]))
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*keep, out])

        return work

    return map_rows(kept, make, schema)


def decode(df: DataFrame, path: str, pattern: str, *, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), out: str = "decoded") -> DataFrame:
    """``keep`` columns and the bytes (binary) that ``ids`` stand for; null or empty lists give no bytes."""
    kept = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("__ids"))
    schema = kept.drop("__ids").schema.add(out, "binary")

    def make():
        coder = encoder(path, pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = [coder.decode(x or ()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())], names=[*keep, out])

        return work

    return map_rows(kept, make, schema)


def round_trip(df: DataFrame, path: str, pattern: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the bytes that the ids decode to).

    Encodes and decodes in one pass, so that the ids never leave the Python task.
    """
    kept, schema = with_text(df, keep, text)
    schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def make():
        coder = encoder(path, pattern)
        sha = hashlib.sha256

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, back = [], [], []
            for x in texts(batch):
                packed = coder.packed(x)
                n.append(len(packed) // 4)
                ids.append(sha(packed).hexdigest())
                back.append(sha(coder.decode(unpack(packed))).hexdigest())
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

        return work

    return map_rows(kept, make, schema)
