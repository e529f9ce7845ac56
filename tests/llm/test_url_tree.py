"""The template tree against a plain one in Python, and its merged siblings."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd

from larkspar.llm import queries, urls


def differs(a, b):
    if not a[0] or not b[0]:
        return False
    p = (a[1] + b[1]) / (a[0] + b[0])
    spread = p * (1 - p) * (1 / a[0] + 1 / b[0])
    return spread > 0 and (a[1] / a[0] - b[1] / b[0]) ** 2 >= urls.DIFFERS * spread


def plain(rows):
    """Verdicts for (host, path, label), one node at a time."""
    segs = [tuple(s for s in re.sub("[0-9]+", "#", path).split("/") if s) for _, path, _ in rows]
    way = [(host,) for host, _, _ in rows]
    for level in range(max(map(len, segs), default=0)):
        below = defaultdict(Counter)
        for w, s in zip(way, segs):
            if len(s) > level:
                below[w][s[level]] += 1
        wild = {w for w, c in below.items() if len(c) >= urls.MANY and sum(c.values()) < urls.FEW * len(c)}
        way = [w if len(s) <= level else (*w, "*" if w in wild else s[level]) for w, s in zip(way, segs)]
    count = defaultdict(lambda: [0, 0])
    for w, (_, _, label) in zip(way, rows):
        for d in range(1, len(w) + 1):
            count[w[:d]][0] += label is not None
            count[w[:d]][1] += label == "block"
    less = lambda a, b: (a[0] - b[0], a[1] - b[1])
    sides, side_of = defaultdict(lambda: [0, 0]), {}
    for w, c in count.items():
        if len(w) > 1 and c[0]:
            rest = less(count[w[:-1]], c)
            if differs(c, rest):
                side_of[w] = (w[:-1], c[1] / c[0] > rest[1] / rest[0])
                sides[side_of[w]][0] += c[0]
                sides[side_of[w]][1] += c[1]
    out = []
    for w in way:
        while len(w) > 1 and w not in side_of:
            w = w[:-1]
        c = count[w]
        if len(w) > 1 and not differs(c, less(sides[side_of[w]], c)):
            c = sides[side_of[w]]
        out.append("block" if (c[1] + 1) / (c[0] + 2) >= urls.REJECT else "allow")
    return out


def made(seed, n):
    """Pages of a few hosts, whose branches lean to one verdict or the other, some with many names."""
    rnd, rows = random.Random(seed), []
    for _ in range(n):
        host = rnd.choice(["a.net", "b.net", "b.net", ""])
        path = "".join(f"/{rnd.choice('pqrst')}" if not d or rnd.random() < 0.5 else f"/n{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}" for d in range(rnd.randrange(5)))
        lean = 0.95 if "/p" in path else 0.8 if "/q" in path else 0.1
        rows.append((host, path, None if rnd.random() < 0.4 else "block" if rnd.random() < lean else "allow"))
    return rows


def judged(spark, rows):
    df = spark.createDataFrame([(k, f"http://{h}{p}", y) for k, (h, p, y) in enumerate(rows)], "page_id bigint, url string, label string")
    return [r["verdict"] for r in urls.judge(df, (), label="label").orderBy("page_id").collect()]


def test_random_trees(spark):
    for seed, n in ((1, 300), (2, 3000)):
        rows = made(seed, n)
        want = plain(rows)
        assert judged(spark, rows) == want
        assert {"block", "allow"} <= {v for v, r in zip(want, rows) if r[2] is None}


def test_like_siblings_lend_each_other_their_labels(spark):
    # One blocked page of two or three in each branch is too little on its own; together the branches are judged.
    rows = [("s.net", f"/good/{k}", "allow") for k in range(60)]
    rows += [("s.net", f"/{branch}/x{c}", "block" if c in "abc" else None) for branch in ("ads", "win", "spin") for c in "abcd"]
    got = judged(spark, rows)
    assert got == plain(rows) and [v for v, r in zip(got, rows) if r[2] is None] == ["block"] * 3


def test_the_sql_on_made_pages(spark):
    rnd = random.Random(5)
    pages = []
    for k in range(1500):
        host, lang = rnd.choice(["x.com", "x.com", "Y.com", "example.org", "z.net"]), rnd.choice(["fr", "de", "de", "en", "es"])
        pages.append((k, f"https://{host}/{rnd.choice([lang, lang, 'de', 'k'])}/{rnd.choice('abc')}{rnd.randrange(9)}/{chr(97 + rnd.randrange(26))}{chr(97 + rnd.randrange(26))}?q=1"))
    pages += [(2000, None), (2001, "no url"), (2002, "http://x.com"), (2003, "http://x.com/a/b/c/d/e/f/g/h/i")]
    pages = [*pages, pages[0]]
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url"]))
    want = sorted(map(str, con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({queries.OP9_SQL})").fetchall()))
    df = spark.createDataFrame(pages, "page_id bigint, url string")
    assert sorted(str(tuple(r)) for r in urls.judge(df, queries.RULES).select("page_id", "host", "path", "rule", "verdict").collect()) == want
