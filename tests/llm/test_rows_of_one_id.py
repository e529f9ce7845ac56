"""Near dedup and decontamination decide on rows, whatever their ids."""

import pytest

from larkspar.llm import decontaminate, neardedup

A = "one two three four five six seven eight nine ten"
B = "quite another text of words that nobody else holds here"
C = "and a third one that is clean and stands on its own"


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id bigint, text string, tag string")


@pytest.mark.parametrize("a", [None, 7])
def test_copies_of_null_or_repeated_ids_are_one(spark, a):
    df = rows(spark, [(a, A, "a"), (a, A, "a"), (a, A, "a"), (a, B, "b"), (None, B, "b"), (a, C, "c"), (None, None, "n"), (None, "", "e")])
    got = neardedup.near_dedup(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, rows(spark, [(a, A, "a"), (a, B, "b"), (a, C, "c"), (None, None, "n"), (None, "", "e")]).collect()))


def test_the_smallest_id_stays_and_a_null_one_goes(spark):
    df = rows(spark, [(9, A, "x"), (None, A, "y"), (3, A + " eleven", "z"), (3, C, "w")])
    assert sorted(r["tag"] for r in neardedup.near_dedup(df, size=2).collect()) == ["w", "z"]


@pytest.mark.parametrize("i", [None, 7])
def test_a_leak_takes_no_other_row_of_its_id(spark, i):
    df = rows(spark, [(i, A, "leak"), (i, C, "clean"), (i, None, "null"), (2, "x " + A, "leak")])
    items = spark.createDataFrame([(1, A)], "item_id bigint, text string")
    got = decontaminate.remove_leaks(df, items)
    assert got.columns == df.columns and sorted(r["tag"] for r in got.collect()) == ["clean", "null"]


@pytest.mark.parametrize("i", [None, 7])
def test_halves_of_an_item_in_two_rows_are_no_leak(spark, i):
    words = A.split()
    df = rows(spark, [(i, " ".join(words[:7]), "h"), (i, " ".join(words[3:]), "h")])
    assert decontaminate.remove_leaks(df, spark.createDataFrame([(1, A)], "item_id bigint, text string")).count() == 2
