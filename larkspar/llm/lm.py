"""LM scoring by a weighted backoff automaton.

The model is a smoothed word trigram model of all training documents, as a weighted automaton. Its states are the contexts: a root, a state for each word seen as a context, one for the start of a text, and one for each pair of words seen. An arc
leaves the state of a context for each word seen after it, with the word's log10 probability there, for the longest context that is a state. What a state has no arc for goes by its failure arc, at the failure's weight, to the state of the context
without its first word, and from there on, to the root, which has an arc for every word seen and one for unknown words. A text is scored by one traversal from left to right that carries the state and adds up the weights of the arcs that it takes.

Weights: at the root, absolute discounting, p(w) = (c(w) - D) / N with D = n1 / (n1 + 2 n2), or a half where no word occurs once or none twice, and what is discounted is the unknown word's. At a longer context h, with h' for h without its first word,
p(w | h) = (c(hw) + K p(w | h')) / (c(h) + K); the failure arc weighs K / (c(h) + K), where K is WEIGHTS' number for that length.

The automaton of a large corpus fits no machine, and no text needs all of it. Documents are dealt by hash into chunks of bounded size; each chunk asks for the counts of the n-grams that occur in it, adding those of its own
training texts. Requests are dealt by n-gram hash into as many buckets; a bucket adds all chunks' counts of each n-gram up and answers each request in its own order. The chunk then builds the part of the automaton that its texts can reach,
whole in every arc it may take, and traverses it. Each document's text is shuffled once, each n-gram once for a chunk and not for each time it occurs, and a frequent word is one entry of a chunk like any other. Sorted hashes travel as their
gaps, in the fewest bytes that hold the largest, byte planes compressed: less than four bytes an n-gram, which pays for the third order. A hash has 48 bits, and more where chunks are many, so that of a million n-grams one or two at most share a hash with another. N, V and
the counts of counts come with the answers, so that nothing is collected.

Rows: null, empty and blank texts are one token, the end. A very long text is traversed in segments, all at a time, each after a run-up of two words, on which alone a state depends; no word is left out. Repeated rows count and are scored each. A null id is a training document. Without training
documents all words are unknown, at a probability of 1. An empty table gives an empty one; columns other than id and text are not read but by ``train``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspar.llm.common import input_bytes

#: Bytes of input for one chunk.
CHUNK_BYTES = 8 << 20
#: Weight of the shorter context's distribution at a state, in occurrences of the state: for contexts of one word and of two.
WEIGHTS = (300.0, 20.0)
#: Words of a text that are traversed one after another; longer texts are traversed in segments at a time.
SEGMENT = 512
#: Bits of an n-gram's hash that travel, for up to 64 chunks; one more for each doubling.
BITS = 48
_START = np.uint64(xxhash.xxh3_64_intdigest(b"\x00start"))
_END = b"\n"  # no word
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: The n-grams that travel, by length.
GRAMS = ("word", "pair", "triple")


def _longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams, of those of their contexts and last words."""
    keys = (context * _MIX + word) * _MIX2
    keys ^= keys >> np.uint64(31)
    return keys


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, the index of each key in them, and where one of each is."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], at, order[new]


class Chunk:
    """The tokens of a chunk's documents: ``keys`` has the sorted hashes of its distinct words, pairs and triples, ``at`` the index of each token's in them, ``one`` a token of each."""

    def __init__(self, texts: pa.ChunkedArray):
        texts = pc.ascii_lower(texts.cast(pa.large_string()).combine_chunks().fill_null(""))
        parts = pc.ascii_split_whitespace(texts)
        each = parts.flatten().dictionary_encode()
        vocabulary = each.dictionary.cast(pa.large_binary()).to_pylist()
        local = each.indices.to_numpy()
        empty = vocabulary.index(b"") if b"" in vocabulary else -1  # before white space that a text begins with, or after that at its end
        owner = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))[local != empty]
        local = local[local != empty]
        self.sizes = np.bincount(owner, minlength=len(parts)).astype(np.int64) + 1
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64)[: len(parts)]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, [*vocabulary, _END]), np.uint64, len(vocabulary) + 1)
        h = np.full(int(self.sizes.sum()), hashes[-1])
        h[np.arange(len(local)) + owner] = hashes[local]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[self.starts] = _START
        pair = _longer(before, h)
        triple = np.empty_like(pair)
        triple[1:] = _longer(pair[:-1], h[1:])
        triple[self.starts] = pair[self.starts]  # a text's first token has no triple
        found = [_distinct(x) for x in (h, pair, triple)]
        self.keys, self.at, self.one = (dict(zip(GRAMS, x, strict=True)) for x in zip(*found, strict=True))
        self.end = int(np.searchsorted(self.keys["word"], hashes[-1]))
        self.first = np.zeros(len(h), bool)
        self.first[self.starts] = True


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in the fewest bytes that hold the largest: how many bytes and integers, then each plane of bytes, compressed, after its length."""
    size = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T
    out = [bytes([size]), len(values).to_bytes(8, "little")]
    for plane in planes:
        blob = pa.compress(np.ascontiguousarray(plane).tobytes(), "zstd", asbytes=True)
        out += [len(blob).to_bytes(8, "little"), blob]
    return b"".join(out)


def unpack(blob: bytes) -> np.ndarray:
    size, n, at = blob[0], int.from_bytes(blob[1:9], "little"), 9
    out = np.zeros((n, 8), np.uint8)
    for k in range(size):
        end = at + 8 + int.from_bytes(blob[at : at + 8], "little")
        out[:, k] = np.frombuffer(pa.decompress(blob[at + 8 : end], n, "zstd", asbytes=True), np.uint8)
        at = end
    return out.view("<u8").reshape(n).astype(np.int64)


def _bits(buckets: int) -> int:
    return min(63, BITS + max(0, (buckets - 1).bit_length() - 6))


def _bounds(buckets: int) -> np.ndarray:
    """The least hash of each bucket: buckets are equal ranges."""
    return np.array([(b << 64) // buckets for b in range(buckets)], np.uint64)


def _gaps(keys: np.ndarray, bound: np.uint64, buckets: int) -> np.ndarray:
    """Of a bucket's sorted hashes, to the bits that travel: how far each is from the one before, the first from the bucket's least."""
    drop = np.uint64(64 - _bits(buckets))
    return np.diff(keys >> drop, prepend=bound >> drop)


def _request(buckets: int):
    bounds = _bounds(buckets)

    def ask(table: pa.Table) -> pa.Table:
        number = table.column("chunk")[0].as_py()
        chunk = Chunk(table.column("text"))
        train = np.repeat(table.column("train").combine_chunks().to_numpy(zero_copy_only=False).astype(bool), chunk.sizes)
        rows = {"bucket": pa.array(range(buckets), pa.int32()), "chunk": pa.array([number] * buckets, pa.int32())}
        for name in GRAMS:
            keys, learnt = chunk.keys[name], train if name != "triple" else train & ~chunk.first
            counts = np.bincount(chunk.at[name][learnt], minlength=len(keys))
            edges = [*np.searchsorted(keys, bounds).tolist(), len(keys)]
            spans = list(zip(edges[:-1], edges[1:], strict=True))
            rows[name + "s"] = pa.array([pack(_gaps(keys[a:b], bound, buckets)) for (a, b), bound in zip(spans, bounds, strict=True)], pa.binary())
            rows[name + "_counts"] = pa.array([pack(counts[a:b]) for a, b in spans], pa.binary())
        return pa.table(rows)

    return ask


def _answer(table: pa.Table) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    chunks = table.column("chunk").to_pylist()
    out = {"chunk": pa.array(chunks, pa.int32()), "bucket": pa.array([bucket] * len(chunks), pa.int32())}
    for name in GRAMS:
        asked = [np.cumsum(unpack(x)) for x in table.column(name + "s").to_pylist()]
        counts = np.concatenate([unpack(x) for x in table.column(name + "_counts").to_pylist()])
        keys, at, _ = _distinct(np.concatenate(asked))
        totals = np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)
        edges = np.cumsum([0, *map(len, asked)])
        out[name + "_counts"] = pa.array([pack(totals[at[a:b]]) for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
        if name == "word":
            facts = (int(totals.sum()), int((totals > 0).sum()), int((totals == 1).sum()), int((totals == 2).sum()))
    for name, fact in zip(("tokens", "types", "once", "twice"), facts, strict=True):
        out[name] = pa.array([fact] * len(chunks), pa.int64())
    return pa.table(out)


class Automaton:
    """The part of the backoff automaton that a chunk can reach.

    States: 0 the root, then one for each word of the chunk, the start of a text, and each pair. ``failure`` and ``failed`` are each state's failure arc, its end and its log10 weight; ``length`` is its context's words. Arcs are numbered by
    the n-gram that they complete, at each length of context: ``there`` tells whether the arc is in the automaton, ``weight`` its log10 weight, ``target`` the state that it ends in.
    """

    def __init__(self, chunk: Chunk, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, tokens: int, types: int, once: int, twice: int, weights: tuple[float, float] = WEIGHTS):
        n_words, n_pairs, (k1, k2) = len(words), len(pairs), weights
        of_word, self.start, of_pair = 1, n_words + 1, n_words + 2
        discount = once / (once + 2 * twice) if once and twice else 0.5
        root = np.where(words > 0, (words - discount) / tokens, discount * types / tokens) if tokens else np.ones(n_words)

        # Occurrences of each context before another token: an end has none, and each document has a start.
        context = words.astype(np.float64)
        context[chunk.end] = 0
        after = np.empty(len(chunk.first), np.int64)  # the state of the word before each token
        after[1:] = chunk.at["word"][:-1] + of_word
        after[chunk.first] = self.start
        one = chunk.one["pair"]
        last = chunk.at["word"][one]  # of each pair
        ends = last == chunk.end
        is_state = np.concatenate(([True], context > 0, [words[chunk.end] > 0], (pairs > 0) & ~ends))
        seen = np.concatenate(([0], context, [words[chunk.end]], np.where(ends, 0, pairs)))
        self.length = np.concatenate(([0], np.ones(n_words + 1, np.int8), np.full(n_pairs, 2, np.int8)))
        self.failure = np.concatenate((np.zeros(of_pair, np.int64), last + of_word))
        k = np.concatenate((np.full(of_pair, k1), np.full(n_pairs, k2)))
        self.failed = np.log10(k / (seen + k))
        self.failed[0] = 0

        of_two = (pairs + k1 * root[last]) / (seen[after[one]] + k1)
        one = chunk.one["triple"]
        context_pair = np.where(chunk.first[one], 0, chunk.at["pair"][one - 1])
        of_three = (triples + k2 * of_two[chunk.at["pair"][one]]) / (pairs[context_pair] + k2)
        self.there = [np.ones(n_words, bool), pairs > 0, (triples > 0) & ~chunk.first[one]]
        self.weight = [np.log10(x) for x in (root, of_two, of_three)]
        # The end of an arc: the longest context that is a state.
        by_word = np.where(is_state[of_word : of_word + n_words], np.arange(n_words) + of_word, 0)
        by_pair = np.where(is_state[of_pair:], np.arange(n_pairs) + of_pair, by_word[last])
        self.target = [by_word, by_pair, by_pair[chunk.at["pair"][one]]]

    def traverse(self, chunk: Chunk) -> np.ndarray:
        """The log10 weight of each document's way through the automaton.

        All documents are traversed at a time, a token of each at a step. A long one's segments are traversed beside each other, each from the root through two tokens before it, whose weights do not count: then its state is that of the whole.
        """
        segments = -(-chunk.sizes // SEGMENT)
        owner = np.repeat(np.arange(len(chunk.sizes)), segments)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
        begin, run_up = chunk.starts[owner] + nth * SEGMENT, np.where(nth > 0, 2, 0)
        size = np.minimum(chunk.sizes[owner] - nth * SEGMENT, SEGMENT) + run_up
        order = np.argsort(-size, kind="stable")
        owner, begin, run_up, size = owner[order], (begin - run_up)[order], run_up[order], size[order]
        active = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), side="left")  # segments longer than a step's number
        state = np.where(run_up > 0, 0, self.start)
        total = np.zeros(len(owner))
        arcs = [chunk.at[name] for name in GRAMS]
        for step, n in enumerate(active.tolist()):
            token, now, weight, moved = begin[:n] + step, state[:n], np.zeros(n), np.zeros(n, bool)
            for length in (2, 1, 0):
                here = ~moved & (self.length[now] == length)
                arc = arcs[length][token]
                taken = here & self.there[length][arc]
                failing = here & ~taken
                weight += np.where(taken, self.weight[length][arc], np.where(failing, self.failed[now], 0.0))
                now = np.where(taken, self.target[length][arc], np.where(failing, self.failure[now], now))
                moved |= taken
            state[:n] = now
            total[:n] += np.where(step >= run_up[:n], weight, 0.0)
        return np.bincount(owner, weights=total, minlength=len(chunk.sizes))


def _score(buckets: int, weights: tuple[float, float]):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _scored([], [], [], [], [], [], [])
        if answers.num_rows != buckets:
            raise ValueError(f"a chunk has {answers.num_rows} answers of {buckets}")
        answers = answers.sort_by("bucket")
        chunk = Chunk(docs.column("text"))
        words, pairs, triples = (np.concatenate([unpack(x) for x in answers.column(f"{n}_counts").to_pylist()]) for n in GRAMS)
        tokens, types, once, twice = (int(sum(answers.column(n).to_pylist())) for n in ("tokens", "types", "once", "twice"))
        model = Automaton(chunk, words, pairs, triples, tokens, types, once, twice, weights)
        each = words[chunk.at["word"]]
        base = np.log10((each + 0.5) / (tokens + 0.5 * (types + 1)))
        known, base = (np.add.reduceat(x, chunk.starts) for x in ((each > 0).astype(np.int64), base))
        n = docs.num_rows
        return _scored(docs.column("doc_id").to_pylist(), [not t for t in docs.column("train").to_pylist()], chunk.sizes, known, [tokens] * n, base, model.traverse(chunk))

    return score


_NAMES = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
_TYPES = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())


def _scored(*columns) -> pa.Table:
    return pa.table({n: pa.array(c, t) for n, c, t in zip(_NAMES, columns, _TYPES, strict=True)})


def score(df: DataFrame, train: Column, *, doc_id: str = "doc_id", text: str = "text", weights: tuple[float, float] = WEIGHTS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; ``train``: whether a row is learnt from.

    base_score is that of single words with half a count added, score the automaton's.
    """
    n = max(input_bytes(df, text) // CHUNK_BYTES + 1, df.sparkSession.sparkContext.defaultParallelism)
    ids = F.col(f"`{doc_id}`").cast("bigint")
    docs = df.select(ids.alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    requests = docs.groupBy("chunk").applyInArrow(_request(n), "bucket int, chunk int, " + ", ".join(f"{g}s binary, {g}_counts binary" for g in GRAMS))
    answers = requests.groupBy("bucket").applyInArrow(_answer, "chunk int, bucket int, " + ", ".join(f"{g}_counts binary" for g in GRAMS) + ", tokens bigint, types bigint, once bigint, twice bigint")
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _score(n, weights), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
