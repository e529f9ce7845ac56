"""URL filters: host and path rules, and for the rest a path-template tree of each host.

A path becomes a template in two steps: digits in a segment become ``#``, and, from the host's root down, where the branches below a node (as generalised so far) are many and hold few pages each, the segment is variable and becomes ``*``. Every prefix of a template is a
node, with the labelled pages below it and how many of those are blocked. A branch that is statistically like the rest of the node above it (a two-proportion test), that is all of it, or that has no labelled page, is merged into that
node. Of the branches of a node that stand out to the same side, more blocked or less, those that are like the others of their side are merged with them and share one count; one that differs from them too keeps its own. A page is judged
by the deepest node of its template that stands out, and blocked if the smoothed share of blocked pages there is high. Labels are the verdicts of the rules, or a column.

All of it is DataFrame code. Pages are first counted by (host, template), with partial sums before the shuffle, so that a host with a third of all pages is as many rows as it has templates; the tree is
grouped sums and joins by (host, node), never all of a host in one task.

Rows: a url that is null or lacks ``://`` has an empty host and path, fits no rule and is judged at the empty host's root. Repeated pages stay and count each. Every segment of a path is a level of the tree, so that a very long path costs a
row for each of its segments. Of rules of equal length the first by text wins; a share just at the limit blocks. An empty table gives an empty one; columns other than the id, the url and the label are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspar.llm.common import LOWER, UPPER, Stash, dropped_with

#: A node's branches are one variable segment if they are so many and hold fewer pages each, on average.
MANY, FEW = 16, 4
#: Square of the z value from which two blocked shares differ.
DIFFERS = 4.0
#: Smoothed share of blocked pages from which a template is rejected.
REJECT = 0.7


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rules(*lines: str) -> tuple[Rule, ...]:
    """Rules from lines such as ``block example.org/es/``."""
    out = []
    for line in lines:
        verdict, _, at = line.partition(" ")
        host, slash, path = at.partition("/")
        out.append(Rule(verdict, host, slash + path))
    return tuple(out)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url: after the first ``://``, up to ``/``, ``?`` or ``#``, A-Z lower-cased; then up to ``?`` or ``#``. Else both are empty."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, known: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equals, the first by text); nulls if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(known, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):  # later ones win
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def _levels(df: DataFrame, *more: str) -> DataFrame:
    """A row for each node on the way of each template: (host, template, depth, parent, seg)."""
    return df.select("host", "template", *more, F.posexplode(F.filter(F.split("template", "/"), lambda s: s != "")).alias("d", "seg"), F.filter(F.split("template", "/"), lambda s: s != "").alias("segs")).select(
        "host", "template", *more, (F.col("d") + 1).alias("depth"), F.array_join(F.slice("segs", F.lit(1), F.col("d")), "/").alias("parent"), "seg"
    )


def _generalised(counted: DataFrame) -> Stash:
    """``counted`` (host, template, n, ...) with ``general``: the template with variable segments as ``*``, level by level, each node's branches counted under its parents as already generalised."""
    segs = F.filter(F.split("template", "/"), lambda s: s != "")
    now = Stash(counted.withColumns({"general": F.lit(""), "depth": F.size(segs)}))
    for level in range(now.df.agg(F.max("depth")).first()[0] or 0):
        deep, seg = F.col("depth") > level, F.get(segs, F.lit(level))
        branches = now.df.filter(deep).groupBy("host", "general", seg.alias("seg")).agg(F.sum("n").alias("n"))
        variable = branches.groupBy("host", "general").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("m")).filter((F.col("k") >= MANY) & (F.col("m") < FEW * F.col("k"))).select("host", "general", F.lit("*").alias("wild"))
        longer = F.concat(F.col("general"), F.lit("/" if level else ""), F.coalesce("wild", seg))
        after = Stash(now.df.join(variable, ["host", "general"], "left").select(*[c for c in now.df.columns if c != "general"], F.when(deep, longer).otherwise(F.col("general")).alias("general")))
        now.drop()
        now = after
    return now


def _differs(labelled: Column, blocked: Column, others: Column, others_blocked: Column) -> Column:
    """Two-proportion test: the blocked share of some labelled pages differs from that of others; false if there are no others."""
    gap = F.try_divide(blocked, labelled) - F.try_divide(others_blocked, others)
    pooled = F.try_divide(blocked + others_blocked, labelled + others)
    spread = pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), labelled) + F.try_divide(F.lit(1.0), others))
    return F.coalesce((spread > 0) & (gap * gap >= DIFFERS * spread), F.lit(False))


def judge(pages: DataFrame, known: tuple[Rule, ...], *, page_id: str = "page_id", url: str = "url", label: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and block_share (of the deciding node) for each row.

    ``label``: a column with ``allow``, ``block`` or null to learn from; by default the verdicts of the rules are the labels.
    """
    host, path = split_url(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"), *([F.col(f"`{label}`").alias("label")] if label else []))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), known)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    segments = F.filter(F.split(F.regexp_replace("path", "[0-9]+", "#"), "/"), lambda s: s != "")
    rows = rows.withColumn("template", F.array_join(segments, "/"))
    given = F.col("label" if label else "ruled")

    counted = rows.groupBy("host", "template").agg(F.count(F.lit(1)).alias("n"), F.count(given).alias("labelled"), F.count(F.when(given == "block", 1)).alias("blocked"))
    grown = _generalised(counted)
    general = grown.df.select("host", "template", "general", "labelled", "blocked")
    # Nodes: labelled and blocked pages at every prefix of a general template, the host's root at depth 0.
    whole = general.groupBy("host", F.col("general").alias("template")).agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    below = _levels(whole, "labelled", "blocked")
    join_node = F.when(F.col("depth") == 1, F.col("seg")).otherwise(F.concat_ws("/", "parent", "seg"))
    nodes = below.groupBy("host", "depth", "parent", join_node.alias("node")).agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    roots = whole.groupBy("host").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).select("host", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("node"), "labelled", "blocked")
    tree = nodes.unionByName(roots)
    labelled, blocked = F.col("labelled"), F.col("blocked")
    up = tree.select("host", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), labelled.alias("up_labelled"), blocked.alias("up_blocked"))
    branches = tree.filter((F.col("depth") > 0) & (labelled > 0)).join(up, ["host", "depth", "parent"]).withColumns({"rest": F.col("up_labelled") - labelled, "rest_blocked": F.col("up_blocked") - blocked})
    out_of_line = branches.filter(_differs(labelled, blocked, F.col("rest"), F.col("rest_blocked"))).withColumn("worse", blocked / labelled > F.try_divide("rest_blocked", "rest"))
    sides = out_of_line.groupBy("host", "depth", "parent", "worse").agg(F.sum("labelled").alias("side"), F.sum("blocked").alias("side_blocked"))
    alone = _differs(labelled, blocked, F.col("side") - labelled, F.col("side_blocked") - blocked)
    own, pooled = (blocked + 1) / (labelled + 2), (F.col("side_blocked") + 1) / (F.col("side") + 2)
    standing = out_of_line.join(sides, ["host", "depth", "parent", "worse"]).select("host", "depth", "node", F.when(alone, own).otherwise(pooled).alias("share"))
    standing = standing.unionByName(roots.select("host", "depth", "node", own.alias("share")))
    # The deepest standing node of each template.
    ways = _levels(whole).select("host", "template", "depth", join_node.alias("node")).unionByName(whole.select("host", "template", F.lit(0).alias("depth"), F.lit("").alias("node")))
    decided = ways.join(standing, ["host", "depth", "node"]).groupBy("host", F.col("template").alias("general")).agg(F.max_by("share", "depth").alias("block_share"))
    verdicts = general.join(decided, ["host", "general"]).select("host", "template", "block_share")
    out = rows.join(verdicts, ["host", "template"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("block_share") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "block_share"
    )
    return dropped_with(out, grown)
