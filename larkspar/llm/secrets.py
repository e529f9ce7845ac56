"""Secret scans: rules for known forms, and two character Markov models for the rest.

The rules find assignments, access keys and long hexadecimal strings. Beyond them, every long run of key characters is scored by a Markov model of
random strings and one of ordinary identifiers, both of order 1 with start and end states; a run whose log-likelihood ratio is high enough, in all and a character, is a
span of kind ``random``. If the whole run is not, its maximal segments are tried, so that a key glued to a path or a name is found; of a run that meets a rule's span, the
parts outside it are scored. Both models are trained from labelled samples.

Rows: null text counts as empty; empty texts have no spans. A very long text, or run, is scanned whole, in time in proportion to it. Repeated rows are scanned each. Positions are code points, ends exclusive; spans that begin together are in
the order of KINDS. An empty table gives an empty one; columns other than the text and those kept are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspar.llm.common import map_rows, texts, with_text

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Log-likelihood ratio, in nats, that a run needs in all and for each character.
LEAST_RATIO, LEAST_MEAN = 15.0, 0.45
#: Characters that a segment of a run, or what a rule leaves of one, needs.
LEAST_LENGTH = 20
#: Labelled samples of each kind.
SAMPLES = 4_000

#: Words that identifiers are made of.
WORDS = (
    "account action address admin alias amount array async author backend balance batch block body buffer build button byte cache call category channel chunk class client close cluster "
    "code collection color column command comment common config connection constant container content context controller convert copy count country create cursor customer data database date "
    "default delete description destination device directory document domain download driver duration element email enable encode engine entity entry enum error event example exception execute "
    "expression factory feature field file filter flag float folder format frame function generate global graph group handle handler header height history host image import index info init "
    "input insert instance integer interface internal item iterator join key label language layout length level library license line link list load local location logger long main manager map "
    "match max memory merge message metadata method metric model module monitor name network node number object offset open option order output package page parameter parent parse partition "
    "path payload pending pixel player plugin point policy position prefix process product profile project property protocol provider proxy public query queue random range read record region "
    "register release remote render report request reset resource response result return role root route row rule schema scope screen script search section segment select sequence server "
    "service session setting shape signal size sort source stack start state static status step storage stream string style subject submit success summary switch symbol sync system table "
    "target task template test text thread time timer title tree trigger type unit update upload user utility valid value variable vector vendor version view widget width window worker wrapper write"
).split()


def samples(seed: int = 7) -> list[tuple[str, int]]:
    """Labelled strings: 1 random (base64, alphanumeric and hexadecimal keys), 0 ordinary (identifiers, paths, words run together, dates and numbers)."""
    rng, out = random.Random(seed), []
    forms = (_SYMBOLS[:64], _SYMBOLS[:62], _SYMBOLS[26:62], "0123456789abcdef", _SYMBOLS[:26] + "0123456789")
    for k in range(SAMPLES):
        out.append(("".join(rng.choices(forms[k % len(forms)], k=rng.randint(20, 64))), 1))
        parts = rng.choices(WORDS, k=rng.randint(3, 8))
        form = k % 6
        if form == 0:
            s = "_".join(parts)
        elif form == 1:
            s = parts[0] + "".join(p.title() for p in parts[1:])
        elif form == 2:
            s = "/".join(parts)
        elif form == 3:
            s = "-".join(parts) + (f"-{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}" if k % 12 == 3 else "")
        elif form == 4:
            s = "".join(parts) if k % 12 == 4 else "_".join(parts).upper()
        else:
            s = parts[0] + rng.choice("/=_-+") * rng.randint(8, 40) + parts[1] if k % 12 == 5 else "/".join(parts[:3]) + f"/{rng.randint(1, 99999)}"
        out.append((s, 0))
    return out


class RatioModel:
    """Log-likelihood ratio of two order-1 Markov models, each with ``smoothing`` added to every count."""

    def __init__(self, labelled: list[tuple[str, int]], smoothing: float = 0.5):
        states = "^" + _SYMBOLS + "$"
        counts = [{a: dict.fromkeys(states, smoothing) for a in states} for _ in range(2)]
        for text, label in labelled:
            of = counts[label]
            for a, b in zip("^" + text, text + "$", strict=True):
                if a in of and b in of:
                    of[a][b] += 1
        totals = [{a: sum(row.values()) for a, row in c.items()} for c in counts]
        self.ratio = {a + b: math.log(counts[1][a][b] / totals[1][a]) - math.log(counts[0][a][b] / totals[0][a]) for a in states for b in states}

    def steps(self, run: str) -> list[float]:
        """The ratio of each transition: into each character, and out of the last."""
        ratio = self.ratio
        return [ratio[a + b] for a, b in zip("^" + run, run + "$", strict=True)]

    def score(self, run: str) -> float:
        return sum(self.steps(run))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the rules find, kinds as numbers of KINDS; by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    out.sort()
    return out


def segments(steps: list[float]) -> list[tuple[int, int]]:
    """All maximal segments of positive sum, (start, end) by start: the best one, then the best on either side of it, and so on (Ruzzo and Tompa), in linear time."""
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum to the end, the nearest earlier one with a lower sum before
    at = 0.0
    for i, step in enumerate(steps):
        before, at = at, at + step
        if step <= 0:
            continue
        start = i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= at:
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
        found.append((start, i + 1, before, at, j))
    return [(a, b) for a, b, *_ in found]


def outside(start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a range that no span covers; spans are by start."""
    out = []
    for a, _, b in spans:
        if a >= end:
            break
        if b > start:
            if a > start:
                out.append((start, a))
            start = b
    if start < end:
        out.append((start, end))
    return out


def random_parts(run: str, model: RatioModel) -> list[tuple[int, int]]:
    """The run itself if it looks random as one, else those of its segments, of LEAST_LENGTH characters at least, that do."""
    n = len(run)
    if n < LEAST_LENGTH:
        return []
    steps = model.steps(run)
    got = sum(steps)
    if got >= LEAST_RATIO and got >= LEAST_MEAN * n:
        return [(0, n)]
    # Less the mean a character, a segment's sum is positive only if its mean is high enough.
    out = []
    for a, b in segments([x - LEAST_MEAN for x in steps]):
        if min(b, n) - a >= LEAST_LENGTH and sum(steps[a:b]) >= LEAST_RATIO:
            out.append((a, min(b, n)))
    return out


def model_spans(text: str, model: RatioModel, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs, and segments of runs, that look random, outside the spans in ``taken``."""
    out, order = [], sorted(taken)
    for m in _RUN.finditer(text):
        for start, end in outside(*m.span(), order):
            out += [(start + a, 3, start + b) for a, b in random_parts(text[start:end], model)]
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), labelled: list[tuple[str, int]] | None = None) -> DataFrame:
    """``keep`` columns, n_assign, n_access, n_hex, n_random, base_spans and spans (``kind:start:end`` by start, then kind, comma-joined), one row for each row."""
    kept, schema = with_text(df, keep, text)
    names = [*keep]
    for n in ("n_assign", "n_access", "n_hex", "n_random"):
        schema = schema.add(n, "long")
        names.append(n)
    for n in ("base_spans", "spans"):
        schema = schema.add(n, "string")
        names.append(n)
    model = RatioModel(samples() if labelled is None else labelled)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, base, every = [[], [], [], []], [], []
            for x in texts(batch):
                found = base_spans(x)
                more = model_spans(x, model, found)
                kinds = [k for _, k, _ in found]
                for k in range(3):
                    counts[k].append(kinds.count(k))
                counts[3].append(len(more))
                base.append(written(found))
                every.append(written(sorted(found + more)))
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(every, pa.string())], names=names)

        return work

    return map_rows(kept, make, schema)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
