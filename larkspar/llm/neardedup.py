"""MinHash near-dedup by an inverted join on signature coordinates.

A text is a set of word shingles, as 64-bit hashes; its signature has COORDINATES values, each of ROWS min-hashes, so that unlike texts with some common shingles, whose number of pairs grows with the square of the corpus, rarely agree in
any. Rows with equal sets are one class at once. Each class is posted under each of its coordinate-value pairs. Two sets at a similarity of 0.8 agree in MATCHES coordinates but for one pair in three million, and the rest is the
T-occurrence problem: order a class's posting lists from short to long; two classes that agree in MATCHES coordinates share one of the first COORDINATES - MATCHES + 1 lists of each (the prefix), so the long lists are skipped, and lists of one class lead
nowhere. Pairs that meet in a prefix list have their collisions counted over all coordinates, the skipped lists' too: COORDINATES lanes of 7 bits, compared a word at a time, so that two values that differ count as a collision once in 128 and none is
overlooked. Pairs with MATCHES or more are confirmed on the full sets, and confirmed links join components.

Pairs within a list are not all made. First each class meets its lists' first classes only, which joins the bulk of a large group of near copies. Then lists that still hold several components make the rest: a list of up to SHORT classes all its
pairs of different components. A longer one sends its classes to the family of its first class, where those outside the largest component, or outside the family that most of them are also in and have been compared in, are held against all
in blocks, as exact matrix products of the sets that return links alone. So every pair of different components that shares a prefix list is looked at; a group of n near copies costs about n pairs, and one of n documents that share much
and are not linked costs rows in proportion to n, a row for each class and block of BLOCK others (the products' additions still grow with the square of such a group).

What goes between the steps is written to the shared folder. No list, component or group is ever in one task as a whole: minima and counts are partial sums, joins on a hot list are split by adaptive execution, and families by blocks.

Rows: null, empty and blank texts have an empty set and are linked with nothing. Fewer words than a shingle: the whole sequence is the only one. A very long text is one set, in one task; its words are never cut. Repeated rows link; rows that share an id are
one node of the graph. Ties: a list's first class is the one of the smallest id. Rows of a null id link nothing: they have the component of a row with an id and an equal set, if there is one, else none, and are then kept. near_dedup numbers the
rows and so decides on each of them. An empty table gives an empty one of the same columns; columns other than id and text are not read by ``link`` and go through ``near_dedup`` whatever their names.
"""

from __future__ import annotations

import hashlib
import operator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspar.llm.common import Stash, byte_text, dropped_with, fold, fresh, map_rows, numbered

COORDINATES, ROWS, MATCHES = 40, 3, 6
PREFIX = COORDINATES - MATCHES + 1
#: Classes of a list up to which all its pairs of different components are made.
SHORT = 12
#: Words of 7 lanes of 7 bits, a lane for each coordinate, and what tells the lanes in which two words differ.
TAGS = [f"t{k}" for k in range(-(-COORDINATES // 7))]
_FILL, _HIGH = 0x007F7F7F7F7F7F7F, 0x0080808080808080
#: Classes of a block that is held against another, and columns of their matrices at a time.
BLOCK, COLUMNS = 512, 4096
#: Distinct words that a task remembers the hashes of.
MEMO = 500_000
_rng = np.random.default_rng(97)
_MUL = (_rng.integers(0, 1 << 32, COORDINATES * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, COORDINATES * ROWS, dtype=np.uint32)[:, None]
_SEEDS = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


class Shingler:
    """Sets of word shingles as sorted unsigned 64-bit hashes."""

    def __init__(self, size: int):
        self.size = size
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        memo = self.memo
        words = fold(text).encode().split()  # of bytes: at ASCII white space
        if not words:
            return np.empty(0, np.uint64)
        if len(memo) > MEMO:
            memo.clear()
        try:
            h = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        except KeyError:
            digest = xxhash.xxh3_64_intdigest
            for w in words:
                if w not in memo:
                    memo[w] = digest(w) >> 1  # 63 bits, which numpy takes faster
            h = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        h = h.view(np.uint64)
        size = min(self.size, len(words))
        out = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            out = (out ^ (out >> np.uint64(29))) * _SEEDS[k] + h[k : len(h) - size + 1 + k]
        out ^= out >> np.uint64(32)
        out *= _SEEDS[15]
        out ^= out >> np.uint64(29)
        return np.unique(out)


def _least(found: np.ndarray) -> np.ndarray:
    """The min-hashes of a set, 32 bits each."""
    low = (found >> np.uint64(32)).astype(np.uint32)[None, :]
    least = np.full(COORDINATES * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, low.shape[1], 1024):
        least = np.minimum(least, (low[:, k : k + 1024] * _MUL + _ADD).min(axis=1))
    return least


def signature(found: np.ndarray) -> np.ndarray:
    """The COORDINATES values of a set, 64 bits each, of its min-hashes and the coordinate's number."""
    rows = _least(found).reshape(COORDINATES, ROWS).astype(np.uint64)
    out = np.arange(COORDINATES, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ (out >> np.uint64(31))) * _SEEDS[k] + rows[:, k]
    out = (out ^ (out >> np.uint64(29))) * _SEEDS[15]
    return (out ^ (out >> np.uint64(32))).astype("<u8")


def _tags(coordinates: np.ndarray) -> np.ndarray:
    """7 bits of each coordinate, in lanes of 8 bits, 7 lanes to a signed 64-bit word, so that lanes can be added without a carry between them or into the sign."""
    lanes = np.zeros(len(TAGS) * 7, np.uint64)
    lanes[:COORDINATES] = coordinates >> np.uint64(57)
    return (lanes.reshape(-1, 7) << (np.arange(7, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, cls, sig) of rows (id, text): set size, digest of the set and its signature; the last two null for an empty set."""

    def make():
        shingle = Shingler(size)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, cls, sig = [], [], []
            for text in byte_text(batch, "text"):
                found = shingle(text)
                n.append(len(found))
                cls.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sig.append(signature(found).tobytes() if len(found) else None)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n", "cls", "sig"])

        return work

    return map_rows(docs, make, "id bigint, n bigint, cls binary, sig binary")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(rep, n, full, t0, t1, ...) of rows (rep, text): the set's size, the set as packed sorted hashes, and 7 bits of each coordinate, 7 to a word."""

    def make():
        shingle = Shingler(size)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [shingle(t) for t in byte_text(batch, "text")]
            tags = np.stack([_tags(signature(x)) for x in found])
            words = [pa.array(np.ascontiguousarray(tags[:, k])) for k in range(len(TAGS))]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, found)), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary()), *words], names=["rep", "n", "full", *TAGS])

        return work

    return map_rows(docs, make, "rep bigint, n bigint, full binary, " + ", ".join(f"{t} bigint" for t in TAGS))


def _postings(classes: DataFrame) -> DataFrame:
    """(key, rep, c) of rows (rep, c, sig): a class under each of its coordinate-value pairs."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i8")
            same = [pa.array(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), COORDINATES)) for k in range(2)]
            return pa.RecordBatch.from_arrays([pa.array(keys), *same], names=["key", "rep", "c"])

        return work

    return map_rows(classes, make, "key bigint, rep bigint, c bigint")


def _overlaps(pairs: DataFrame) -> DataFrame:
    """(a, b, shared, whole) of rows (a, b, full_a, full_b): sizes of the sets' intersection and union."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            shared, whole = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
                both.sort(kind="stable")
                shared.append(int((both[1:] == both[:-1]).sum()))
                whole.append(len(both) - shared[-1])
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(whole, pa.int64())], names=["a", "b", "shared", "whole"])

        return work

    return map_rows(pairs, make, "a bigint, b bigint, shared bigint, whole bigint")


def components(edges: DataFrame) -> Stash:
    """(v, comp) of every node of the edges (a, b): the smallest node that it reaches.

    Every node takes the least label among its neighbours and itself, then the label of its label, until nothing changes: long chains halve each time.
    """
    both = Stash(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter(F.col("a") != F.col("b")).distinct())
    labels = Stash(both.df.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("near")).select("v", F.least("v", "near").alias("comp")))
    while True:
        near = both.df.join(labels.df, both.df["b"] == labels.df["v"]).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.df.join(near, F.col("v") == F.col("a"), "left").select("v", F.least("comp", F.coalesce("near", "comp")).alias("next"), "comp")
        jump = labels.df.select(F.col("v").alias("at"), F.col("comp").alias("there"))
        new = step.join(jump, F.col("next") == F.col("at"), "left").select("v", F.least("next", F.coalesce("there", "next")).alias("new"), "comp")
        after = Stash(new.select("v", F.col("new").alias("comp"), (F.col("new") != F.col("comp")).alias("moved")))
        labels.drop()
        labels = after
        if not after.df.filter("moved").limit(1).count():
            both.drop()
            return labels


def link(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, numerator: int = 4, denominator: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row for each row: documents linked if denominator * intersection >= numerator * union of their shingle sets.

    component_id: the smallest id reachable, itself included; kept: whether it is the row's own.
    """
    out, tables = _linked(df, doc_id, text, size, numerator, denominator)
    return dropped_with(out, *tables)


def _linked(df: DataFrame, doc_id: str, text: str, size: int, numerator: int, denominator: int) -> tuple[DataFrame, list[Stash]]:
    """What ``link`` returns, and the tables that it reads."""
    docs = df.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    signed = Stash(_signed(docs, size))
    real = signed.df.filter("n > 0 AND id IS NOT NULL")
    classes = Stash(real.groupBy("cls").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    links = _class_links(classes, docs, size, numerator, denominator)
    # Rows of one id may be of several classes: they are one node, so that an id and its classes' representatives are linked.
    several = real.groupBy("id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo <> hi").select("id")
    own = real.join(several, "id", "left_semi").join(classes.df.select("cls", "rep"), "cls").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    graph = components(links.df.unionByName(own))
    comp = classes.df.join(graph.df, F.col("rep") == F.col("v"), "left").select(F.col("cls").alias("c"), F.coalesce("comp", "rep").alias("comp"))
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("comp"))
    kept = F.coalesce(F.col("id") == component, component.isNull())
    links.drop()
    out = signed.df.select("id", "n", "cls").join(comp, F.col("cls") == F.col("c"), "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))
    return out, [signed, classes, graph]


def _class_links(classes: Stash, docs: DataFrame, size: int, numerator: int, denominator: int) -> Stash:
    """(a, b): confirmed links between class representatives, enough of them to join every component."""
    posted = Stash(_postings(classes.df.select("rep", F.xxhash64("cls").alias("c"), "sig")))
    repeated = Stash(posted.df.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    # Of each class: lists of one class come first in its order; of the others, the shortest fill the prefix.
    mine = posted.df.join(repeated.df, "key").groupBy("rep", "c").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("es"))
    room = F.size("es") + F.lit(PREFIX - COORDINATES)
    prefix = Stash(mine.filter(room > 0).select("rep", F.explode(F.slice("es", F.lit(1), room)).alias("e")).select(F.col("e.key").alias("key"), "rep").distinct())
    for s in (posted, repeated):
        s.drop()
    reps = prefix.df.select("rep").distinct()
    sets = Stash(_sets(docs.join(reps, F.col("id") == F.col("rep"), "left_semi"), size))
    if sets.df.count() > reps.count():  # repeated ids
        every, sets = sets, Stash(sets.df.dropDuplicates(["rep", "full"]))
        every.drop()
    tags = sets.df.select("rep", "n", *TAGS)
    lists = Stash(prefix.df.join(tags, "rep"))
    prefix.drop()

    first = lists.df.groupBy("key").agg(F.min(F.struct("rep", "n", *TAGS)).alias("p"))
    met = Stash(_colliding(lists.df.join(first.select("key", *_renamed("p.", "p")), "key").filter("rep <> prep"), numerator, denominator))
    links = Stash(_confirmed(met, sets, numerator, denominator))
    met.drop()
    graph = components(links.df)

    now = lists.df.join(graph.df, F.col("rep") == F.col("v"), "left").select("key", "rep", "n", F.coalesce("comp", "rep").alias("comp"), *TAGS)
    state = now.groupBy("key").agg(F.min("rep").alias("anchor"), F.count(F.lit(1)).alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    left = Stash(now.join(state.select("key", "anchor", "k"), "key"))
    for s in (lists, graph):
        s.drop()
    short = left.df.filter(F.col("k") <= SHORT).groupBy("key", "anchor").agg(F.collect_list(F.struct("rep", "n", "comp", *TAGS)).alias("m"))
    each = short.select("anchor", F.explode("m").alias("x"), "m").select("anchor", "x", F.explode("m").alias("y"))
    each = each.select("anchor", *_renamed("x.", "", "comp"), *_renamed("y.", "p", "comp"))
    met = Stash(_colliding(each.filter("rep < prep AND comp <> pcomp AND rep <> anchor"), numerator, denominator))  # the first class has met all others
    more, families = _family_links(left.df.filter(F.col("k") > SHORT), sets, numerator, denominator)
    every = Stash(links.df.unionByName(_confirmed(met, sets, numerator, denominator)).unionByName(more))
    for s in (met, left, links, sets, *families):
        s.drop()
    return every


def _renamed(inside: str, prefix: str, *more: str) -> list:
    return [F.col(inside + f).alias(prefix + f) for f in ("rep", "n", *more, *TAGS)]


def _colliding(pairs: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(a, b), once each: the pairs (rep, n, t0, ..., prep, pn, pt0, ...) whose sizes allow a link and that collide in MATCHES coordinates or more, of all COORDINATES."""
    sizes = (F.col("n") * denominator >= F.col("pn") * numerator) & (F.col("pn") * denominator >= F.col("n") * numerator)
    differ = [F.bit_count((F.col(t).bitwiseXOR(F.col("p" + t)) + F.lit(_FILL)).bitwiseAND(F.lit(_HIGH))) for t in TAGS]
    collisions = F.lit(COORDINATES) - reduce(operator.add, differ)
    return pairs.filter(sizes & (collisions >= MATCHES)).select(F.least("rep", "prep").alias("a"), F.greatest("rep", "prep").alias("b")).distinct()


def _confirmed(pairs: Stash, sets: Stash, numerator: int, denominator: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    full = sets.df.select("rep", "full")
    both = pairs.df.join(full.select(F.col("rep").alias("a"), F.col("full").alias("full_a")), "a").join(full.select(F.col("rep").alias("b"), F.col("full").alias("full_b")), "b")
    return _overlaps(both.select("a", "b", "full_a", "full_b")).filter(F.col("shared") * denominator >= F.col("whole") * numerator).select("a", "b")


def _linked_blocks(numerator: int, denominator: int):
    """Of two blocks (rep, comp, full) of one family, the links between classes of different components."""

    def link(few: pa.Table, all_: pa.Table) -> pa.Table:
        sets = [[np.frombuffer(x, np.uint64) for x in t.column("full").to_pylist()] for t in (few, all_)]
        out = {"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())}
        if sets[0] and sets[1]:
            each = [np.concatenate(x) for x in sets]
            owner = [np.repeat(np.arange(len(x)), list(map(len, x))) for x in sets]
            common = np.intersect1d(*each)
            shared = np.zeros((len(sets[0]), len(sets[1])), np.float32)
            for k in range(0, len(common), COLUMNS):
                part, ones = common[k : k + COLUMNS], []
                for x, o, n in zip(each, owner, map(len, sets), strict=True):
                    at = np.minimum(np.searchsorted(part, x), len(part) - 1)
                    hit = part[at] == x
                    ones.append(np.zeros((n, len(part)), np.float32))
                    ones[-1][o[hit], at[hit]] = 1
                shared += ones[0] @ ones[1].T
            sizes = [np.array(list(map(len, x)), np.float32) for x in sets]
            comps, reps = ([t.column(c).to_numpy() for t in (few, all_)] for c in ("comp", "rep"))
            hold = (denominator * shared >= numerator * (sizes[0][:, None] + sizes[1][None, :] - shared)) & (comps[0][:, None] != comps[1][None, :])
            x, y = np.nonzero(hold)
            if len(x):  # one link from a class to a component is as good as all
                _, one = np.unique(np.stack((x, comps[1][y])), axis=1, return_index=True)
                x, y = x[one], y[one]
            x, y = reps[0][x], reps[1][y]
            out = {"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))}
        return pa.table(out)

    return link


def _family_links(lists: DataFrame, sets: Stash, numerator: int, denominator: int) -> tuple[DataFrame, list[Stash]]:
    """(a, b), and the tables that it reads: a link from each class of the long lists (anchor, rep, comp), at least, to each other component with one among the classes that it shares a list with.

    The family of an anchor holds the classes of all long lists that begin with it, so that two classes of one list are in one family. A class's home is its family of the smallest anchor: classes of the same home are compared there, and
    elsewhere only if their homes differ. So a family whose classes mostly have one other home compares the rest alone with all.
    """
    members = lists.select("anchor", "rep", "comp").distinct()
    homes = members.groupBy(F.col("rep").alias("of")).agg(F.min("anchor").alias("home"))
    members = Stash(members.join(homes, F.col("rep") == F.col("of")).drop("of"))
    counted = members.df.groupBy("anchor", "comp", "home").agg(F.count(F.lit(1)).alias("c"))
    most = lambda by: counted.groupBy("anchor", by).agg(F.sum("c").alias("c")).groupBy("anchor").agg(F.max(F.struct("c", by)).alias(f"by_{by}"), F.sum("c").alias("k"))
    rest = lambda by: F.col("k") - F.col(f"by_{by}.c")
    plan = most("comp").join(most("home").select("anchor", "by_home"), "anchor")
    plan = plan.withColumns({"n_comp": rest("comp"), "n_home": F.when(F.col("by_home.home") == F.col("anchor"), F.col("k")).otherwise(rest("home"))})
    least = F.least("n_comp", "n_home")
    plan = plan.filter(least > 0).select(
        "anchor",
        F.when(F.col("n_comp") <= F.col("n_home"), F.col("by_comp.comp")).alias("largest"),
        F.when(F.col("n_comp") > F.col("n_home"), F.col("by_home.home")).alias("done"),
        F.ceil(least / BLOCK).alias("n_few"),
        F.ceil(F.col("k") / BLOCK).alias("n_all"),
    )
    here = Stash(members.df.join(plan, "anchor").join(sets.df.select("rep", "full"), "rep"))
    slot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = here.df.filter(~F.coalesce(F.col("comp") == F.col("largest"), F.col("home") == F.col("done"))).select("anchor", slot("n_few").alias("i"), every("n_all").alias("j"), "rep", "comp", "full")
    all_ = here.df.select("anchor", every("n_few").alias("i"), slot("n_all").alias("j"), "rep", "comp", "full")
    keys = ["anchor", "i", "j"]
    return few.groupBy(*keys).cogroup(all_.groupBy(*keys)).applyInArrow(_linked_blocks(numerator, denominator), "a bigint, b bigint"), [members, here]


def near_dedup(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, numerator: int = 4, denominator: int = 5) -> DataFrame:
    """All columns of ``df``, one row of each component: that of the smallest id, a null one after all others. Rows without shingles all stay.

    Rows are linked by their texts alone, each as a node of its own, so that a null or repeated id neither saves a copy nor joins unlike texts.
    """
    own = fresh(df, "row")
    rows = numbered(df, own)
    out, tables = _linked(rows.df, own, text, size, numerator, denominator)
    linked = Stash(out.select(F.col("doc_id").alias("r"), F.col("component_id").alias("component")))
    for s in tables:
        s.drop()
    order = F.struct(F.col("id").isNull().alias("last"), "id", "r")
    ids = rows.df.select(F.col(own).alias("r"), F.col(f"`{doc_id}`").cast("bigint").alias("id"))
    # Most components are single rows, of which none goes.
    shared = linked.df.groupBy("component").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("component")
    members = Stash(linked.df.join(shared, "component").join(ids, "r"))
    least = members.df.groupBy("component").agg(F.min(order)["r"].alias("stays"))
    gone = members.df.join(least, "component").filter("r <> stays").select(F.col("r").alias(own))
    return dropped_with(rows.df.join(gone, own, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns]), rows, linked, members)
