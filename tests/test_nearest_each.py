"""Nearest neighbours of many query vectors."""

from larkspar.operators import relational as rel


def test_every_query_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(rel, "QUERIES", 3)
    data = [(k, [float(k % 7), float(k // 7)]) for k in range(60)] + [(60, None)]
    df = spark.createDataFrame(data, "k bigint, v array<float>").repartition(3)
    got = {}
    for r in rel.nearest_each(df, df.filter("k % 5 = 0"), "k", "v", 4, "l2", offset=1).collect():
        got.setdefault(r["query"], []).append((r["distance"], r["key"]))
    want = {}
    for i, q in data[:60:5]:
        want[i] = sorted((((q[0] - v[0]) ** 2 + (q[1] - v[1]) ** 2) ** 0.5, k) for k, v in data[:60])[1:5]
    assert {i: sorted(x) for i, x in got.items()} == want
    assert rel.nearest_each(df, df.limit(0), "k", "v", 4).count() == 0
