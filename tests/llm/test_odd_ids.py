"""Ids beyond 2^53 beside null ones, labels of repeated ids, clashing names, and a boilerplate group whose documents are not linked."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspar.llm import chat, fingerprints, neardedup, quality, secrets


def test_no_row_is_lost_for_a_null_id_beside_large_ones(spark):
    big = 1 << 60
    rows = [(big + k, f"text number {k} " * 5) for k in range(190)] + [(None, f"none {k}") for k in range(10)]
    got = fingerprints.compare_edited(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()
    assert sorted((r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((i or 0, len(t)) for i, t in rows)
    first = next(r for r in got if r["doc_id"] == big + 1)
    t, u = rows[1][1], rows[0][1]  # the next one by descending id
    n = len(t) // 3
    import hashlib

    assert first["edited_sha256"] == hashlib.sha256((t[: len(t) - n] + u[:n]).encode()).hexdigest()


def test_labels_of_a_repeated_id_take_one_place_each(spark):
    docs = spark.createDataFrame([(0, f"copy {k}") for k in range(50)] + [(k, f"good text number {k}") for k in range(1, 21)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(21)] * 2, "doc_id bigint, quality int")
    model = quality.learn(docs, labels, most=21)
    assert len(model.labels) == 21


def test_scores_against_plain_votes(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    learnt = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = quality.learn(docs, labels, learnt=learnt)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    known = [(i, y) for i, y in labels.filter(learnt).select("doc_id", "quality").collect()]
    assert len(known) < quality.MAX_LABELLED and len(model.labels) == len(known)
    vectors = {i: model.embed([t])[0] for i, t in texts.items()}
    share = sum(y for _, y in known) / len(known)
    for r in quality.classify(docs, model).collect():
        near = sorted(((float(np.clip(vectors[r["doc_id"]] @ vectors[i], 0, 1)), y) for i, y in known), reverse=True)
        last = near[quality.NEIGHBOURS - 1][0]
        votes = [(s**quality.POWER, y) for s, y in near if s >= last - 1e-6]
        want = (sum(w * y for w, y in votes) + quality.PRIOR * share) / (sum(w for w, _ in votes) + quality.PRIOR)
        assert abs(r["score"] - want) < 2e-3 and r["predicted"] == (r["score"] >= 0.5)


def test_names_that_operators_use(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 2)] * 2, "doc_id bigint, text string, text_ string, row int")
    assert secrets.scan(df, keep=("doc_id", "text_", "row")).columns[:3] == ["doc_id", "text_", "row"]
    assert [tuple(r) for r in neardedup.near_dedup(df).collect()] == [(1, "a b c d e f", "x", 2)]


def test_turns_beside_a_field_of_another_layout(spark):
    df = spark.createDataFrame([(1, 0, "user", "q", "z")], "conv_id bigint, turn bigint, role string, text string, input string")
    assert [tuple(r) for r in chat.turn_rows(df).collect()] == [(1, 0, "user", "q")]


@pytest.mark.parametrize("n", [60])
def test_unlinked_boilerplate_costs_rows_in_proportion(spark, monkeypatch, n):
    """Documents that share three quarters of their words and are not linked: each is handed to blocks, and in no pair but with a list's first class."""
    rows = [(i, " ".join([f"b{k}" for k in range(145)] + [f"o{i}_{k}" for k in range(54)])) for i in range(n)]
    rows.append((n, rows[3][1] + " tail"))
    made, blocks, real = [], [], neardedup._confirmed

    def confirmed(pairs, *more):
        made.append(pairs.df.count())
        return real(pairs, *more)

    monkeypatch.setattr(neardedup, "_confirmed", confirmed)
    got = {r["doc_id"]: r["component_id"] for r in neardedup.link(spark.createDataFrame(rows, "doc_id bigint, text string"), size=2).collect()}
    assert got == {i: 3 if i == n else i for i in range(n + 1)} and not blocks
    assert sum(made) < 12 * n
