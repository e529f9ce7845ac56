"""Column expressions for what the dialect has and Spark lacks or spells otherwise. All stay in the JVM."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def similar_pattern(pattern: str, escape: str = "\\") -> str:
    """An anchored regular expression for a SIMILAR TO pattern: ``%`` and ``_`` are wildcards, ``| * + ? ( ) { } [ ]`` keep their meaning."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == escape and k + 1 < len(pattern):
            k += 1
            out.append(re.escape(pattern[k]))
        elif c == "%":
            out.append("(?s:.*)")
        elif c == "_":
            out.append("(?s:.)")
        elif c in "|*+?(){}[]":
            out.append(c)
        else:
            out.append(re.escape(c))
        k += 1
    return "^(?:" + "".join(out) + ")$"


def similar_to(col: Column, pattern: str, escape: str = "\\") -> Column:
    return col.rlike(similar_pattern(pattern, escape))


COMPARE: dict[str, Callable[[Column, Column], Column]] = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def any_of(left: Column, op: str, array: Column) -> Column:
    """``left op ANY (array)``: null if no element compares true and some comparison is null."""
    return F.exists(array, lambda x: COMPARE[op](left, x))


def all_of(left: Column, op: str, array: Column) -> Column:
    """``left op ALL (array)``: null if no element compares false and some comparison is null."""
    return F.forall(array, lambda x: COMPARE[op](left, x))


def num_nulls(*cols: Column) -> Column:
    return functools.reduce(operator.add, [c.isNull().cast("int") for c in cols])


def num_nonnulls(*cols: Column) -> Column:
    return functools.reduce(operator.add, [c.isNotNull().cast("int") for c in cols])


def epoch(ts: Column) -> Column:
    """Seconds since 1970 in UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def date_bin(seconds: int, ts: Column, origin: str = "2001-01-01 00:00:00") -> Column:
    """The start of the stride of ``seconds``, counted from ``origin``, that ``ts`` falls in."""
    start = F.unix_seconds(F.lit(origin).cast("timestamp"))
    micros = F.unix_micros(ts.cast("timestamp")) - start * 1_000_000
    return F.timestamp_seconds(start + F.floor(micros / F.lit(seconds * 1e6)) * seconds).cast("timestamp_ntz")


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether two half-open periods overlap; those that only touch do not. A period's ends may come in either order."""
    return (F.least(s1, e1) < F.greatest(s2, e2)) & (F.least(s2, e2) < F.greatest(s1, e1))


def trunc(x: Column, digits: int = 0) -> Column:
    """A number toward zero at so many digits."""
    scale = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def regexp_replace_first(col: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """REGEXP_REPLACE: the first match, all with the flag ``g``; ``i`` ignores case."""
    if "i" in flags:
        pattern = f"(?i){pattern}"
    if "g" in flags:
        return F.regexp_replace(col, pattern, replacement)
    first = F.regexp_substr(col, F.lit(pattern))
    at = F.regexp_instr(col, F.lit(pattern))
    changed = F.concat(F.substr(col, F.lit(1), at - 1), F.regexp_replace(first, pattern, replacement), F.substr(col, at + F.length(first)))
    return F.when(at > 0, changed).otherwise(col)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine; null for a vector of length zero."""
    return F.lit(1.0) - F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def array_contains_all(a: Column, b: Column) -> Column:
    """``a @> b``."""
    return F.size(F.array_except(b, a)) == 0


def quote_ident(col: Column) -> Column:
    """A name as it is if it is a plain lower-case one, else in double quotes."""
    return F.when(col.rlike(r"^[a-z_][a-z0-9_]*$"), col).otherwise(F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"')))


def quote_literal(col: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(col, F.lit("'"), F.lit("''")), F.lit("'"))


def quote_nullable(col: Column) -> Column:
    return F.coalesce(quote_literal(col), F.lit("NULL"))


def format_text(template: str, *args: Column) -> Column:
    """FORMAT with %s, %I, %L and %%."""
    parts, k, last = [], 0, 0
    kinds = {"s": lambda c: F.coalesce(c, F.lit("")), "I": quote_ident, "L": quote_nullable}
    for m in re.finditer(r"%([sIL%])", template):
        parts.append(F.lit(template[last : m.start()]))
        if m[1] == "%":
            parts.append(F.lit("%"))
        else:
            parts.append(kinds[m[1]](args[k].cast("string")))
            k += 1
        last = m.end()
    return F.concat(*parts, F.lit(template[last:]))


#: Template fields and the letters that Spark's formatter has for them.
FIELDS = {"YYYY": "yyyy", "MM": "MM", "DD": "dd", "HH24": "HH", "HH12": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "Month": "MMMM", "Mon": "MMM", "Day": "EEEE", "Dy": "EEE", "AM": "a"}


def date_pattern(template: str) -> str:
    """Spark's date pattern for a template such as ``YYYY-MM-DD HH24:MI:SS``."""
    out = []
    for m in re.finditer("|".join(sorted(FIELDS, key=len, reverse=True)) + "|[A-Za-z]+|[^A-Za-z]+", template):
        out.append(FIELDS.get(m[0]) or ("'" + m[0] + "'" if m[0].isalpha() else m[0]))
    return "".join(out)


def to_char(ts: Column, template: str) -> Column:
    return F.date_format(ts, date_pattern(template))


_DAY = 86_400_000_000


def interval_text(micros: Column, months: Column | None = None) -> Column:
    """An interval as text: years, months and days that are not 0, in the plural unless 1, then the clock if it is not 0; ``00:00:00`` if all are."""

    def part(n: Column, unit: str) -> Column:
        return F.when(n != 0, F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s")))

    rest = micros % _DAY
    days, clock = ((micros - rest) / _DAY).cast("bigint"), F.abs(rest)
    fraction = F.when(clock % 1_000_000 != 0, F.concat(F.lit("."), F.regexp_replace(F.format_string("%06d", clock % 1_000_000), "0+$", ""))).otherwise("")
    of_day = F.format_string("%02d:%02d:%02d", F.floor(clock / 3_600_000_000), F.floor(clock % 3_600_000_000 / 60_000_000), F.floor(clock % 60_000_000 / 1_000_000))
    parts = [part(days, "day"), F.when(rest != 0, F.concat(F.when(rest < 0, "-").otherwise(""), of_day, fraction))]
    if months is not None:
        parts = [part(((months - months % 12) / 12).cast("bigint"), "year"), part(months % 12, "mon"), *parts]
    text = F.concat_ws(" ", *parts)
    return F.when(micros.isNotNull(), F.when(text == "", "00:00:00").otherwise(text))


def age(later: Column, earlier: Column) -> Column:
    """The plain difference of two times, in days and clock, as text."""
    return interval_text(F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp")))


def make_interval(years: Column, months: Column, weeks: Column, days: Column, hours: Column, minutes: Column, seconds: Column) -> Column:
    """An interval in microseconds; a year is 365 days and a month 30."""
    whole = (years.cast("bigint") * 365 + months * 30 + weeks * 7 + days) * 86_400 + hours * 3600 + minutes * 60
    return whole * 1_000_000 + F.round(seconds * 1_000_000).cast("bigint")


def justify_hours(seconds: Column) -> Column:
    """An interval of seconds as text, with days of 24 hours taken out."""
    return interval_text(seconds.cast("bigint") * 1_000_000)


def justify_interval(seconds: Column) -> Column:
    """An interval of seconds as text, with days of 24 hours and months of 30 days taken out."""
    micros, month = seconds.cast("bigint") * 1_000_000, 30 * _DAY
    return interval_text(micros % month, ((micros - micros % month) / month).cast("bigint"))


def isfinite(x: Column) -> Column:
    """False for infinities and NaN; times have none here."""
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def width_bucket(x: Column, low: float, high: float, n: int) -> Column:
    return F.width_bucket(x, F.lit(low), F.lit(high), F.lit(n))


def json_path(*keys: str | int) -> str:
    """A path of keys and positions as Spark's JSON functions take it."""
    return "$" + "".join(f"[{k}]" if isinstance(k, int) or k.lstrip("-").isdigit() else f"['{k}']" for k in keys)


def json_get_text(doc: Column, *keys: str | int) -> Column:
    """``->>`` and ``#>>``: the text of a value, null for JSON null."""
    return F.get_json_object(doc, json_path(*keys))


def json_typeof(doc: Column) -> Column:
    t = F.substr(F.ltrim(doc), F.lit(1), F.lit(1))
    return F.when(t == "{", "object").when(t == "[", "array").when(t == '"', "string").when(t.isin("t", "f"), "boolean").when(t == "n", "null").otherwise("number")
