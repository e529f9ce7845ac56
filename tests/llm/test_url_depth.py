"""Templates of every depth, generalised level by level."""

from larkspar.llm import urls


def judged(spark, rows):
    df = spark.createDataFrame([(k, u, y) for k, (u, y) in enumerate(rows)], "page_id bigint, url string, label string")
    return {r["page_id"]: r["verdict"] for r in urls.judge(df, (), label="label").collect()}


def test_segments_far_below_the_root_are_told_apart(spark):
    head = "http://s.net/a/b/c/d/e/f/g/h"
    rows = [(f"{head}/{kind}/{k}", verdict if k < 40 else None) for kind, verdict in (("spam", "block"), ("ok", "allow")) for k in range(50)]
    got = judged(spark, rows)
    assert {got[k] for k in range(40, 50)} == {"block"} and {got[k] for k in range(90, 100)} == {"allow"}


def name(k):
    return chr(97 + k % 26) + chr(97 + k // 26)


def test_branches_below_a_variable_segment_are_counted_together(spark):
    rows = [(f"http://s.net/user/{name(k)}/slug-{name(k)}/{kind}", verdict if k < 40 else None) for kind, verdict in (("ads", "block"), ("info", "allow")) for k in range(60)]
    got = judged(spark, rows)
    assert {got[k] for k in range(40, 60)} == {"block"} and {got[k] for k in range(100, 120)} == {"allow"}


def test_labels_below_names_are_pooled(spark):
    rows = [(f"http://s.net/shop/{name(k)}/{name(k + 7)}/{kind}", verdict if k % 2 else None) for kind, verdict in (("ads", "block"), ("info", "allow")) for k in range(60)]
    got = judged(spark, rows)
    assert {got[k] for k in range(60)} == {"block"} and {got[k] for k in range(60, 120)} == {"allow"}


def test_one_very_deep_path(spark):
    assert judged(spark, [("http://s.net/" + "x/" * 20, "allow"), ("http://s.net/", None), (None, None)]) == {0: "allow", 1: "allow", 2: "allow"}
