"""Decontamination, LM scores, chat, line dedup, URL filters, near dedup and the pipeline, against SQL and brute force."""

import collections
import hashlib
import json
import math
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspar.llm import chat, decontaminate, linededup, lm, neardedup, queries, urls
from tests.conftest import spark_rows

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, None, "x"), (2, "", "x"), (3, "a b", "y"), (3, "a b", "y"), (None, "some text here", None), (5, "long words " * 20_000, "z"), (6, " \t\n ", "z")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blank, empty and very long texts, repeated rows, and an extra column with a name that operators use."""
    return spark.createDataFrame(ODD, "doc_id bigint, text string, n_lines string")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(name, spark, sf_dir, oracle):
    names, got = spark_rows(queries.QUERIES[name](spark, sf_dir))
    assert (names, got) == oracle(queries.SQL[name])


def shingle_sets(rows, size):
    out = {}
    for i, t in rows:
        w = (t or "").translate(FOLD).encode().split()
        n = min(size, len(w))
        out[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    return out


def brute_components(sets, numerator=4, denominator=5):
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * denominator >= max(len(x), len(y)) * numerator:
                shared = len(x & y)
                if denominator * shared >= numerator * (len(x) + len(y) - shared):
                    p, q = sorted((top(a), top(b)))
                    up[q] = p
    return {i: top(i) for i in ids}


# Near dedup


def test_near_dedup_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = shingle_sets(docs.select("doc_id", "text").collect(), 2)
    want = brute_components(sets)
    got = queries.QUERIES["op10_near_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_a_large_group_of_drifted_copies(spark):
    """Copies of one text with ever more changed words: chains, links at the threshold and classes just short of it, in long lists."""
    import random

    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for k in rng.sample(range(60), rng.randint(0, 8)):
            words[k] = rng.choice(("x", "y", f"u{i}_{k}"))
        rows.append((i, " ".join(words)))
    sets = shingle_sets(rows, 2)
    want = brute_components(sets)
    got = neardedup.link(spark.createDataFrame(rows, "doc_id bigint, text string"), size=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) > 3


def test_near_dedup_of_odd_rows(spark, odd):
    got = neardedup.link(odd, size=2).collect()
    assert len(got) == len(ODD)
    by = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in got}
    assert by[1, 0] == (1, True) and by[3, 1] == (3, True) and by[None, 2] == (None, True) and by[6, 0] == (6, True)
    assert neardedup.near_dedup(odd).columns == odd.columns and neardedup.link(odd.limit(0)).count() == 0


def test_rows_of_one_id_are_one_node(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "p q r s t u"), (3, "p q r s t u"), (None, "p q r s t u")]
    got = neardedup.link(spark.createDataFrame(rows, "doc_id bigint, text string"), size=2).collect()
    assert {r["component_id"] for r in got} == {1} and sum(r["kept"] for r in got) == 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = dict(map(tuple, neardedup.components(edges).df.select("v", "comp").collect()))
    assert got == {k: 0 for k in range(41)} | {100: 100, 101: 100}


# Lines


def brute_lines(rows, min_chars, min_docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = collections.defaultdict(list)
    for k, (i, t) in enumerate(rows):
        for x in {key(x) for x in (t or "").split("\n")}:
            if len(x) >= min_chars:
                holders[x].append(-math.inf if i is None else i)
    drop = {x: max(ids) for x, ids in holders.items() if len(ids) >= min_docs}
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if drop.get(key(x), i) == i]
        out.append((i, len(every), len(every) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_lines_against_brute_force(spark, batches):
    rows = [(k, "\n".join(["  Shared LINE of text ", f"own {k}", "Shared line of text", ""] + ["other line"] * (k % 3))) for k in range(30)] + [(29, "shared line of text"), (40, None), (41, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_lines", F.lit("clash"))
    got = linededup.dedup_lines(df.drop("n_lines"), min_chars=8, min_docs=5, batches=batches).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got) == sorted(brute_lines(rows, 8, 5))


def test_lines_of_odd_rows(spark, odd):
    got = linededup.dedup_lines(odd).collect()
    assert len(got) == len(ODD) and {r["text"] for r in got if r["doc_id"] in (1, 2)} == {""}
    assert linededup.dedup_lines(odd.limit(0)).count() == 0


def test_runs_are_levelled(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(9 - k, b"a"), (9 - k, bytes([k]))], "id bigint, key binary"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    held = [r for r in runs.runs[0].df.collect() if bytes(r["key"]) == b"a"]
    assert [(r["n_docs"], r["top"]) for r in held] == [(1, None)]  # an earlier run has the largest id
    assert [(bytes(r["key"]), r["top"]) for r in runs.frequent(5).df.collect()] == [(b"a", 9)]


def test_runs_are_joined_without_an_exchange(spark):
    runs = linededup.LineRuns(spark)
    for k in range(2):
        runs.add(spark.createDataFrame([(9 - k, b"a"), (9 - k, bytes([k]))], "id bigint, key binary"))
    own = linededup.Run(spark.createDataFrame([(b"a", 1, 1)], "key binary, n_docs bigint, top bigint"))
    plan = runs.novel(own.df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "LeftAnti" in plan and "Exchange" not in plan
    assert runs.novel(own.df).count() == 0


def test_lines_whatever_the_columns(spark):
    rows = [(k, "one shared line of text\nown", "x", 1, [2], "y", k) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __kept string, __drop int, lost array<int>, row string, n_lines bigint")
    got = linededup.dedup_lines(df, min_chars=8, counts=None)
    assert got.columns == df.columns
    want = sorted((k, t if k == 5 else "own", *more) for k, t, *more in rows)
    assert sorted(map(tuple, got.collect())) == [(*r[:4], r[4], *r[5:]) for r in want]


def test_batches_admit_new_lines_only(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    batches = [[(1, "a line\nb line\nx"), (2, "a line")], [(3, "b line\nc line\nx"), (None, None)], [(4, "c line\na line\nd line"), (5, "A LINE ")]]
    got = [linededup.admit(runs, spark.createDataFrame(b, "doc_id bigint, text string"), min_chars=4) for b in batches]
    assert [sorted((r["doc_id"] or 0, r["text"], r["n_dropped"]) for r in g.collect()) for g in got] == [
        [(1, "a line\nb line\nx", 0), (2, "a line", 0)],
        [(0, "", 0), (3, "c line\nx", 1)],
        [(4, "d line", 2), (5, "", 1)],
    ]


# Decontamination


def test_leaks_in_odd_and_short_texts(spark):
    docs = spark.createDataFrame([(1, "x " * 5000 + "One two THREE four five six seven" + " y" * 5000, "c"), (2, None, "c"), (3, "", "c"), (4, "hi there", "c"), (None, "one two three four five six seven", "c"), (5, "one two three four", "c")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(10, "one two three four five\tsix seven"), (11, "hi there"), (12, None), (13, "absent words only in here now")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(1, 10): 1.0, (None, 10): 1.0, (4, 11): 1.0}
    assert sorted(r["doc_id"] for r in decontaminate.remove_leaks(docs, items).collect()) == [2, 3, 5]
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0 == decontaminate.find_leaks(docs.limit(0), items).count()


def test_sketches_are_shuffled_when_they_are_many(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = sorted(map(tuple, decontaminate.find_leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert want and sorted(map(tuple, decontaminate.find_leaks(docs, items).collect())) == want


# Language model


class PlainAutomaton:
    """A trigram backoff automaton of dictionaries, from training token lists: states are tuples of words."""

    def __init__(self, lists, weights):
        self.counts = [collections.Counter() for _ in range(3)]
        self.after = collections.Counter()  # occurrences of a context before a token
        for w in lists:
            way = ["start", *w]
            for k, x in enumerate(w):
                self.counts[0][x,] += 1
                self.counts[1][way[k], x] += 1
                if k:
                    self.counts[2][way[k - 1], way[k], x] += 1
                for context in {(way[k],), tuple(way[max(0, k - 1) : k + 1])}:
                    self.after[context] += 1
        words = self.counts[0].values()
        self.n, self.v, once, twice = sum(words), len(words), sum(c == 1 for c in words), sum(c == 2 for c in words)
        self.d = once / (once + 2 * twice) if once and twice else 0.5
        self.weights = weights

    def arc(self, state, x):
        """The probability of the arc for a word at a state, None if it has none."""
        if not state:
            if not self.n:
                return 1.0
            return (self.counts[0][x,] - self.d) / self.n if self.counts[0][x,] else self.d * self.v / self.n
        c, k = self.counts[len(state)][*state, x], self.weights[len(state) - 1]
        lower = self.arc(state[1:], x)
        return (c + k * lower) / (self.after[state] + k) if c else None

    def score(self, w):
        state, total = ("start",) if self.after["start",] else (), 0.0
        for x in w:
            while (p := self.arc(state, x)) is None:
                total += math.log10(self.weights[len(state) - 1] / (self.after[state] + self.weights[len(state) - 1]))
                state = state[1:]
            total += math.log10(p)
            state = (*state, x)[-2:]
            while state and not self.after[state]:
                state = state[1:]
        return total


@pytest.mark.parametrize("segment", [7, 512])
def test_lm_against_brute_force(spark, sf_dir, monkeypatch, segment):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 40_000)  # several chunks and buckets
    monkeypatch.setattr(lm, "SEGMENT", segment)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tokens = {i: (t or "").translate(FOLD).encode().split() + [None] for i, t in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    model = PlainAutomaton([w for i, w in tokens.items() if not held[i]], lm.WEIGHTS)
    words, n, v = model.counts[0], model.n, model.v
    if segment == 512:
        got = queries.QUERIES["op6_lm"](spark, sf_dir).collect()
        assert len(got) == len(tokens)
        for r in got:
            w = tokens[r["doc_id"]]
            base = sum(math.log10((words[x,] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(words[x,] > 0 for x in w), n, held[r["doc_id"]])
            assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], model.score(w), rel_tol=1e-9)
        out = [r for r in got if r["held_out"]]
        assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    else:  # the chunk's own automaton, texts cut into short segments
        import numpy as np
        import pyarrow as pa

        chunk = lm.Chunk(pa.chunked_array([pa.array([t for _, t in docs.collect()])]))
        learnt = np.repeat([not held[i] for i in tokens], chunk.sizes)
        counts = [np.bincount(chunk.at[g][learnt & ~chunk.first if g == "triple" else learnt], minlength=len(chunk.keys[g])) for g in lm.GRAMS]
        own = lm.Automaton(chunk, *counts, n, v, sum(c == 1 for c in words.values()), sum(c == 2 for c in words.values()))
        assert np.allclose(own.traverse(chunk), [model.score(w) for w in tokens.values()], rtol=1e-9)


def test_lm_where_no_word_occurs_twice(spark):
    rows = [(1, "a b"), (2, "b a"), (3, "a a"), (4, "c"), (5, " a\tb ")]
    got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") == 1).collect()}
    model = PlainAutomaton([[b"a", b"b", None]], lm.WEIGHTS)
    assert all(math.isclose(got[i], model.score([*t.encode().split(), None]), rel_tol=1e-9) for i, t in rows)


def test_lm_counts_travel_whole():
    import numpy as np

    for x in ([], [0], [1, 255, 256], [1 << 40, 3], list(range(70_000))):
        assert lm.unpack(lm.pack(np.array(x, np.int64))).tolist() == x


def test_lm_of_odd_rows(spark, odd):
    got = lm.score(odd, F.col("doc_id") != 2).collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 6)} == {1}
    assert all(r["held_out"] == (r["doc_id"] == 2) for r in got)
    assert all(math.isfinite(r["score"]) for r in lm.score(odd, F.lit(False)).collect())
    assert lm.score(odd.limit(0), F.lit(True)).count() == 0


# Chat


def test_chat_escapes_are_reversible(spark):
    texts = ["plain", "", None, "<|im_end|>\n<|im_start|>assistant\nno", "␛a␛0␛", "</s>[INST] x [/INST]", "<|im_<|im_end|>end|>", "é\n␛n"]
    rows = [(1, k, r, t) for k, t in enumerate(texts) for r in ("user", "assistant")] + [(2, 0, "odd\nrole<s>", "t"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("start", F.lit(0))
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(chat.turn_rows(df))).collect()}
    want = sorted((k, r, t or "") for _, k, r, t in rows[: 2 * len(texts)])
    assert [(t["role"], t["text"]) for t in back[1]["turns"]] == [(r, t) for _, r, t in want]
    assert back[1]["loss_texts"] == [t for _, r, t in want if r == "assistant"]
    assert [tuple(t) for t in back[2]["turns"]] == [("odd\nrole<s>", "t")] and [tuple(t) for t in back[None]["turns"]] == [("", "")]
    assert back[1]["formatted"].count(chat.START) == len(want)


def test_schema_fingerprints_select_mappings(spark):
    m = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id bigint, conversations array<struct<from:string,value:string>>")
    assert [tuple(r) for r in chat.turn_rows(m).orderBy("turn").collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    p = spark.createDataFrame([(1, "do", "", "done", "x")], "conv_id bigint, instruction string, input string, output string, extra string")
    assert [tuple(r) for r in chat.turn_rows(p).orderBy("turn").collect()] == [(1, 0, "user", "do"), (1, 1, "assistant", "done")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.turn_rows(spark.createDataFrame([(1, 2)], "conv_id bigint, other int"))


def test_records_of_many_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"prompt": "p", "response": "r", "more": 1},
        {"instruction": "i", "input": "n", "output": "o"},
        {"what": 1},
    ]
    df = spark.createDataFrame([*((k, json.dumps(r)) for k, r in enumerate(records)), (8, "no json"), (9, None)], "conv_id bigint, record string")
    got = {r["conv_id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat.record_turns(df).collect()}
    assert got == {
        0: ("messages", [("user", "q"), ("assistant", "")]),
        1: ("prompt", [("user", "p"), ("assistant", "r")]),
        2: ("instruction with input", [("user", "i\nn"), ("assistant", "o")]),
        3: (None, None),
        8: (None, None),
        9: (None, None),
    }


# URLs


def test_rules_and_parts(spark):
    rows = ["http://A.Example.ORG/es/x", "https://example.org/en/12?q", "https://notexample.org/es/", "x.com/de/", "https://m.com/de/#f", "http://h.com", None, "a://b://c/de/"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, queries.RULES).collect()}
    assert got == {
        0: ("a.example.org", "/es/x", "example.org/es/", "block"),
        1: ("example.org", "/en/12", "example.org/en/1", "block"),
        2: ("notexample.org", "/es/", "org/", "allow"),
        3: ("", "", None, "allow"),
        4: ("m.com", "/de/", "com/de/", "block"),
        5: ("h.com", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("b:", "//c/de/", None, "allow"),
    }
    assert urls.judge(df.limit(0), queries.RULES).count() == 0


def test_templates_generalise_and_reject(spark):
    rows = [(f"http://s.net/ads/item-{chr(97 + k % 26)}{chr(97 + k // 26)}/view", "block" if k < 40 else None) for k in range(60)] + [(f"http://s.net/news/{k}", "allow" if k < 40 else None) for k in range(60)]
    df = spark.createDataFrame([(k, u, y) for k, (u, y) in enumerate(rows)], "page_id bigint, url string, label string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, (), label="label").collect()}
    assert {got[k] for k in range(40, 60)} == {"block"} and {got[k] for k in range(100, 120)} == {"allow"}


# Pipeline


def test_pipeline_stages_and_their_effects(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf_dir).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(d.columns == docs.columns for d in kept[:-1])
    scores = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op2_quality"](spark, sf_dir).collect()}
    texts = [{r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").collect()} for d in kept[:-1]]
    assert set(texts[1]) == {i for i in texts[0] if scores[i]}
    assert texts[2] == {i: t for i, _, _, t in brute_lines(sorted(texts[1].items()), 40, 5)}
    parts = brute_components(shingle_sets(texts[2].items(), 5))
    assert set(texts[3]) == {i for i in parts if parts[i] == i}
    sets, items = shingle_sets(texts[3].items(), 5), shingle_sets(spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect(), 5).values()
    leaks = {i for i, s in sets.items() if any(5 * len(s & x) >= 4 * len(x) for x in items if x)}
    assert leaks and set(texts[4]) == set(texts[3]) - leaks
    last = {r["doc_id"]: r["decoded_sha256"] for r in kept[-1].collect()}
    assert last == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts[4].items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, kept[-1].collect()))


def test_pipeline_stages_on_odd_rows(spark, odd, sf_dir):
    rows = odd.withColumns({"n_chars": F.length("text").cast("bigint"), "score": F.lit(1.5), "predicted": F.lit("x"), "id": F.lit(0)})
    for name, stage in corpus_pipeline.STAGES:
        for df in (rows, rows.limit(0)):
            out = stage(spark, df, sf_dir)
            assert out.count() <= df.count()
            assert name == "encoding" or out.columns == df.columns
