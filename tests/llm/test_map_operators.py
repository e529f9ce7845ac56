"""Fingerprints, quality, BPE and secrets, against brute force, round trips and held-out labels."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspar.llm import bpe, fingerprints, quality, secrets
from larkspar.llm.queries import QUERIES

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [(1, None, "x"), (2, "", "x"), (3, "a", "y"), (3, "a", "y"), (None, "some text", None), (5, "long " * 30_000, "z")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and an extra column."""
    return spark.createDataFrame(ODD, "doc_id bigint, text string, score string")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r[0]: r[1] or "" for r in docs.select("doc_id", "text").collect()}


# Fingerprints


def test_chunks_cover_and_keep_their_bounds():
    raw = np.random.default_rng(1).integers(97, 110, 20_000, dtype=np.uint8).tobytes()
    ends = fingerprints.cuts(raw)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(raw) and sizes.max() <= fingerprints.MOST and sizes[:-1].min() >= fingerprints.LEAST
    assert fingerprints.cuts(b"") == [] and fingerprints.cuts(b"ab") == [2]


def test_gear_equals_the_rolling_definition():
    raw = b"content-defined boundaries move with their content, whatever comes before"
    h, want = 0, []
    for b in raw:
        h = ((h << 1) + int(fingerprints.GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert fingerprints.gear(raw).tolist() == want


def test_shift_changes_few_chunks():
    raw = np.random.default_rng(2).integers(97, 123, 10_000, dtype=np.uint8).tobytes()
    assert fingerprints.likeness(fingerprints.chunks(raw), fingerprints.chunks(b"inserted" + raw)) > 0.95


def test_edited_texts_against_brute_force(spark, sf_dir, texts):
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in QUERIES["op1_fingerprints"](spark, sf_dir).collect()}
    assert len(got) == len(texts)
    for k, i in enumerate(order):
        own, after = texts[i], texts[order[(k + 1) % len(order)]]
        changed = len(own) // 3
        edited = own[: len(own) - changed] + after[:changed]
        one, two, three = (fingerprints.chunks(t.encode()) for t in (own, edited, after))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == fingerprints.joined(one) and r["edited_fingerprint"] == fingerprints.joined(two)
        assert r["near_edited"] == fingerprints.likeness(one, two) and r["near_next"] == fingerprints.likeness(one, three)


def test_fingerprints_of_odd_rows(spark, odd):
    assert odd.count() == fingerprints.compare_edited(odd).count() == fingerprints.fingerprint(odd).count()
    one = fingerprints.compare_edited(odd.limit(1)).first()
    assert (one["n_chars"], one["near_edited"], one["near_next"]) == (0, 1.0, 1.0)
    assert fingerprints.compare_edited(odd.limit(0)).count() == 0


# Quality


def test_quality_on_held_out_labels(spark, sf_dir):
    scored = QUERIES["op2_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = scored.join(labels, "doc_id").filter("held_out").select("predicted", "quality").collect()
    assert len(got) > 100 and sum(a == b for a, b in got) >= 0.97 * len(got)


def test_quality_is_exact_nearest_neighbours():
    texts = ["the cat sat on the mat", "THE!! CAT!! SAT!!", "a b a b a b a b", "le chat dort", "der hund"]
    model = quality.fit(quality.counts(texts), np.array([1, 0, 0, 1, 1]))
    ask = model.embed(["the cat", ""])
    for k, score in enumerate(model.score(["the cat", ""])):
        near = sorted(((float(np.clip(ask[k] @ v, 0, 1)) ** quality.POWER, y) for v, y in zip(model.vectors, model.labels)), reverse=True)[: quality.NEIGHBOURS]
        want = (sum(w * y for w, y in near) + quality.PRIOR * model.share) / (sum(w for w, _ in near) + quality.PRIOR)
        assert abs(score - want) < 1e-5


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1), (None, 1), (5, None), (5, 0)], "doc_id bigint, quality int")
    model = quality.learn(odd, labels)
    assert len(model.labels) == 2  # document 3 is there twice, and has one vote
    got = quality.classify(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert {r["score"] for r in quality.classify(odd, quality.learn(odd, labels.limit(0))).collect()} == {0.5}
    assert quality.classify(odd.limit(0), model).count() == 0


# BPE


@pytest.fixture(scope="module")
def coder():
    return bpe.encoder(*VOCABULARY)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=VOCABULARY[1], mergeable_ranks=coder.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=80))
def test_bpe_equals_the_library(coder, reference, text):
    ids = coder.encode(text)
    assert ids == reference.encode_ordinary(text) and coder.decode(ids) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.text("abeint", min_size=1, max_size=400))
def test_bpe_of_long_pretokens(coder, reference, text):
    assert coder.encode(text) == reference.encode_ordinary(text)


def test_bpe_of_every_space_and_digit(coder, reference):
    import unicodedata

    for c in map(chr, range(0x3100)):
        if unicodedata.category(c)[0] in "ZN" or unicodedata.category(c) in ("Cc", "Mn"):
            text = f"a{c}{c}b {c}1"
            assert coder.encode(text) == reference.encode_ordinary(text), hex(ord(c))


def test_bpe_query(spark, sf_dir, texts, reference):
    for r in QUERIES["op3_bpe"](spark, sf_dir).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_of_odd_rows(spark, odd):
    ids = bpe.encode(odd, *VOCABULARY, keep=("doc_id", "text"))
    back = bpe.decode(ids, *VOCABULARY, keep=("text",)).collect()
    assert len(back) == len(ODD) and all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    assert bpe.round_trip(odd.limit(0), *VOCABULARY).count() == 0


# Secrets

_KEY = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""


def brute_spans(text):
    out = [("assign", m.start(), m.end()) for m in re.finditer(_KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_secret_rules_against_brute_force(spark, sf_dir, texts):
    for r in QUERIES["op4_secrets"](spark, sf_dir).collect():
        want = brute_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex")]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(",")) or not want


@settings(max_examples=200, deadline=None)
@given(st.text("paswordPASWORDtokensecriKEY_AKIA0123abcdef=:\"' \u017f\u212a", max_size=90))
def test_secret_rules_on_any_text(text):
    assert [(secrets.KINDS[k], a, b) for a, k, b in secrets.base_spans(text)] == brute_spans(text)


def test_models_tell_random_from_ordinary():
    model, held_out = secrets.RatioModel(secrets.samples(7)), secrets.samples(8)
    found = [(bool(secrets.model_spans(s, model, [])), y) for s, y in held_out if len(s) >= 20]
    random, ordinary = [f for f, y in found if y], [f for f, y in found if not y]
    assert sum(random) > 0.97 * len(random) and sum(ordinary) < 0.01 * len(ordinary)


def test_model_spans_leave_prose_and_rule_spans_alone(texts):
    model = secrets.RatioModel(secrets.samples())
    for text in texts.values():
        base = secrets.base_spans(text)
        for a, _, b in secrets.model_spans(text, model, base):
            assert all(b <= x or y <= a for x, _, y in base)
    assert secrets.model_spans("see https://example.com/some/quite/ordinary/path-name_here and internationalization", model, []) == []


def test_secrets_of_odd_rows(spark, odd):
    got = secrets.scan(odd, keep=("doc_id", "score")).collect()
    assert len(got) == len(ODD) and {r["spans"] for r in got} == {""}
    assert secrets.scan(odd.limit(0)).count() == 0


def test_held_out_rows_are_the_stated_ones(spark, sf_dir):
    for r in QUERIES["op2_quality"](spark, sf_dir).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
