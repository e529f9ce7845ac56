"""PostgreSQL-flavoured SQL text as Spark SQL: a rewriting of tokens, for the spellings that Spark lacks.

Covered: ``::`` casts; ``~ ~* !~ !~*``; SIMILAR TO; ARRAY[...] and 1-based subscripts; op ANY / ALL / SOME of an array or a subquery; ``-> ->> #> #>>``; DISTINCT ON; FETCH FIRST n ROWS ONLY / WITH TIES; the default place of
nulls in ORDER BY; FILTER before OVER; string_agg and array_agg with ORDER BY; set-returning functions in FROM, with ordinality; EXTRACT(EPOCH), DATE_PART, TO_CHAR, STRPOS, LOG; REGEXP_REPLACE of the first match, or all by flag; TRUNC of numbers, QUOTE_IDENT, QUOTE_LITERAL, QUOTE_NULLABLE, STRING_TO_ARRAY, NUM_NULLS, NUM_NONNULLS, ISFINITE;
OVERLAPS; ``<->``; OVER () of ranking functions and windows that refine a named one; E'' strings and double-quoted names. edits and containment of JSON (``jsonb_set jsonb_insert jsonb_strip_nulls jsonb_pretty @> <@ #-``), over Arrow batches; ``@> <@ &&`` of arrays, if a side is written ARRAY[...].
Not covered: GROUPS frames and EXCLUDE, intervals by AGE and MAKE_INTERVAL, AT TIME ZONE, and statements other than queries; all of them but the last are functions of ``larkspar.functions`` and ``larkspar.operators``.
DISTINCT ON and WITH TIES are taken at the end of a whole query or of a parenthesised one. GROUPS frames and EXCLUDE are in ``larkspar.operators.relational``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from larkspar.functions.exprs import date_pattern, similar_pattern
from larkspar.functions.json_edit import register_text
from larkspar.sources.tables import register

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>[eE]?'(?:[^'\\]|''|\\.)*')|(?P<quoted>"(?:[^"]|"")*")|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"""
    r"""|(?P<word>[A-Za-z_][A-Za-z_0-9]*(?:\.[A-Za-z_][A-Za-z_0-9]*|\."[^"]*")*)|(?P<param>[$:]\w+)|(?P<op>::|!~\*|!~|~\*|~|\#>>|\#>|\#-|@>|<@|&&|<->|->>|->|\|\||<=|>=|<>|!=|.)""",
    re.S | re.X,
)
_COMPARE = {"=", "<>", "!=", "<", "<=", ">", ">="}
#: What ends the items of an ORDER BY.
_AFTER_ORDER = {"limit", "offset", "fetch", "rows", "range", "groups", "for", "union", "intersect", "except"}
#: Set-returning functions as table functions over one array or map.
_SETS = {
    "generate_series": "explode(sequence({}))",
    "unnest": "explode({})",
    "jsonb_array_elements": "explode(from_json({}, 'array<string>'))",
    "json_array_elements": "explode(from_json({}, 'array<string>'))",
    "jsonb_array_elements_text": "explode(from_json({}, 'array<string>'))",
    "json_array_elements_text": "explode(from_json({}, 'array<string>'))",
    "jsonb_each": "explode(from_json({}, 'map<string,string>'))",
    "json_each": "explode(from_json({}, 'map<string,string>'))",
    "jsonb_each_text": "explode(from_json({}, 'map<string,string>'))",
    "json_each_text": "explode(from_json({}, 'map<string,string>'))",
    "jsonb_object_keys": "explode(array_sort(json_object_keys({})))",
    "json_object_keys": "explode(array_sort(json_object_keys({})))",
    "regexp_split_to_table": "explode(split({}))",
}


class Tok:
    """A token, or a parenthesised group of them."""

    __slots__ = ("kind", "text", "inner")

    def __init__(self, kind: str, text: str, inner: list[Tok] | None = None):
        self.kind, self.text, self.inner = kind, text, inner

    @property
    def low(self) -> str:
        return self.text.lower() if self.kind == "word" else self.text if self.kind == "op" else ""

    def __str__(self) -> str:
        if self.inner is None:
            return self.text
        return self.text[0] + " ".join(map(str, self.inner)) + self.text[1]


def _parse(query: str) -> list[Tok]:
    stack: list[tuple[str, list[Tok]]] = [("", [])]
    for m in _TOKEN.finditer(query):
        kind, text = m.lastgroup, m[0]
        if kind == "space":
            continue
        if text in ("(", "["):
            stack.append((text, []))
        elif text in (")", "]") and kind == "op":
            opened, inner = stack.pop()
            if not stack or {"(": ")", "[": "]"}.get(opened) != text:
                raise ValueError(f"unbalanced {text} in the query")
            stack[-1][1].append(Tok("group", opened + text, inner))
        elif kind == "quoted":
            stack[-1][1].append(Tok("word", "`" + text[1:-1].replace('""', '"').replace("`", "``") + "`"))
        elif kind == "string":
            body = text[2:-1] if text[0] in "eE" else text[1:-1].replace("\\", "\\\\")
            stack[-1][1].append(Tok("string", "'" + body.replace("''", "\\'") + "'"))
        elif kind == "param" and text[0] == "$":
            stack[-1][1].append(Tok("param", f":p{text[1:]}"))
        elif kind == "word":
            stack[-1][1].append(Tok("word", re.sub(r'"([^"]*)"', r"`\1`", text)))
        else:
            stack[-1][1].append(Tok(kind or "op", text))
    if len(stack) != 1:
        raise ValueError("unbalanced parentheses in the query")
    return stack[0][1]


def _raw(*parts: Tok | str) -> Tok:
    return Tok("raw", " ".join(map(str, parts)))


def _before(out: list[Tok]) -> list[Tok]:
    """Take the operand that ends ``out``: a literal, a name, a call, a parenthesised or subscripted expression."""
    if not out:
        raise ValueError("an operator lacks its left operand")
    taken = [out.pop()]
    while taken[0].kind == "group" and out and (out[-1].kind == "word" and out[-1].low not in _KEYWORDS or taken[0].text == "[]"):
        taken.insert(0, out.pop())
    return taken


_KEYWORDS = {"select", "where", "and", "or", "not", "on", "when", "then", "else", "in", "having", "by", "from", "as", "between", "like", "ilike", "case", "distinct", "all", "any", "some", "values", "over", "filter", "exists"}


def _after(tokens: list[Tok], at: int) -> tuple[list[Tok], int]:
    """The operand that starts at a place, and where it ends."""
    end = at + 1
    if tokens[at].kind == "word" and end < len(tokens) and tokens[end].kind == "group":
        end += 1
    return tokens[at:end], end


def _split(tokens: list[Tok], by: str = ",") -> list[list[Tok]]:
    out: list[list[Tok]] = [[]]
    for t in tokens:
        if t.kind == "op" and t.text == by:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _text(tokens: list[Tok]) -> str:
    return " ".join(map(str, tokens))


def _json_path(tok: Tok) -> str:
    if tok.kind == "number":
        return f"[{tok.text}]"
    return "".join(f"[{p}]" if p.strip().isdigit() else f".{p.strip()}" for p in tok.text.strip("'").strip("{}").split(","))


def _is(tokens: list[Tok], at: int, *words: str) -> bool:
    return all(at + k < len(tokens) and tokens[at + k].low == w for k, w in enumerate(words))


def _ordered(tokens: list[Tok]) -> list[Tok]:
    """ORDER BY items with their nulls' place: last when ascending, first when descending."""
    out, at = [], 0
    while at < len(tokens):
        if not _is(tokens, at, "order", "by"):
            out.append(tokens[at])
            at += 1
            continue
        end = at + 2
        while end < len(tokens) and tokens[end].low not in _AFTER_ORDER:
            end += 1
        items = []
        for item in _split(tokens[at + 2 : end]):
            if not any(t.low == "nulls" for t in item) and not (len(item) <= 2 and item and item[0].low == "all"):
                item = [*item, _raw("NULLS FIRST" if any(t.low == "desc" for t in item) else "NULLS LAST")]
            items.append(_text(item))
        out.append(_raw("ORDER BY", ", ".join(items)))
        at = end
    return out


def _set_functions(tokens: list[Tok]) -> list[Tok]:
    """Set-returning functions after FROM, JOIN, LATERAL or a comma there."""
    out, at, in_from = [], 0, False
    while at < len(tokens):
        t = tokens[at]
        if t.low in ("from", "join", "lateral"):
            in_from = True
        elif t.low in ("where", "select", "group", "order", "having", "limit", "on"):
            in_from = False
        if in_from and t.low in _SETS and at + 1 < len(tokens) and tokens[at + 1].kind == "group":
            lateral = "LATERAL " if out and out[-1].text == "," else ""
            call = _SETS[t.low].format(_text(tokens[at + 1].inner))
            at += 2
            if _is(tokens, at, "with", "ordinality"):
                at += 2
                alias, names = _alias(tokens, at)
                at = alias[1]
                names = names or ["value", "ordinality"]
                call = call.replace("explode(", "posexplode(", 1)
                out.append(_raw(f"{lateral}(SELECT {', '.join(f'`{n}`' for n in names[:-1])}, `__p` + 1 AS `{names[-1]}` FROM {call} AS __s(`__p`, {', '.join(f'`{n}`' for n in names[:-1])})) AS {alias[0]}"))
                continue
            out.append(_raw(lateral + call))
            continue
        out.append(t)
        at += 1
    return out


def _alias(tokens: list[Tok], at: int) -> tuple[tuple[str, int], list[str]]:
    if _is(tokens, at, "as"):
        at += 1
    name, at = (tokens[at].text, at + 1) if at < len(tokens) and tokens[at].kind == "word" and tokens[at].low not in _KEYWORDS else ("__t", at)
    names: list[str] = []
    if at < len(tokens) and tokens[at].kind == "group":
        names = [_text(x).strip("`") for x in _split(tokens[at].inner)]
        at += 1
    return (name, at), names


def _call(name: str, group: Tok) -> Tok | None:
    """A call that Spark spells otherwise."""
    args = _split(group.inner)
    if name == "string_agg" and group.inner:
        order = next((k for k, t in enumerate(group.inner) if t.kind == "raw" and t.text.startswith("ORDER BY")), None)
        within = f" WITHIN GROUP ({group.inner[order]})" if order is not None else ""
        return _raw(f"listagg({_text(group.inner[:order])}){within}")
    if name == "regexp_replace" and len(args) in (3, 4):
        x, pattern, by = (_text(a) for a in args[:3])
        if args[2][0].kind == "string":  # a group's number after a backslash, and dollars that stand for themselves
            by = re.sub(r"\\\\(\d)", r"$\1", by.replace("$", "\\\\$"))
        flags = _text(args[3]).strip("'") if len(args) == 4 else ""
        if "i" in flags:
            pattern = f"concat('(?i)', {pattern})"
        if "g" in flags:
            return _raw(f"regexp_replace({x}, {pattern}, {by})")
        at, first = f"regexp_instr({x}, {pattern})", f"regexp_substr({x}, {pattern})"
        return _raw(f"(CASE WHEN {at} > 0 THEN concat(substr({x}, 1, {at} - 1), regexp_replace({first}, {pattern}, {by}), substr({x}, {at} + length({first}))) ELSE {x} END)")
    if name == "trunc" and len(args) in (1, 2):
        x, p = _text(args[0]), f"power(10, {_text(args[1])})" if len(args) == 2 else ""
        return _raw(f"((CASE WHEN ({x}) < 0 THEN ceil(({x}) * {p}) ELSE floor(({x}) * {p}) END) / {p})" if p else f"(CASE WHEN ({x}) < 0 THEN ceil({x}) ELSE floor({x}) END)")
    if name in ("num_nulls", "num_nonnulls") and group.inner:
        null = "0" if name == "num_nonnulls" else "1"
        return _raw("(" + " + ".join(f"(CASE WHEN ({_text(a)}) IS NULL THEN {null} ELSE 1 - {null} END)" for a in args) + ")")
    if name == "isfinite" and len(args) == 1:
        return _raw(f"(CAST(({_text(args[0])}) AS STRING) NOT IN ('Infinity', '-Infinity', 'NaN'))")
    if name in _JSON_EDITS and 0 <= len(_JSON_EDITS[name][1]) - len(args) <= (_JSON_EDITS[name][1][-1] != ""):
        function, defaults = _JSON_EDITS[name]
        return _raw(f"{function}({', '.join([*map(_text, args), *defaults[len(args):]])})")
    if name == "quote_ident" and len(args) == 1:
        x = _text(args[0])
        return _raw(f"(CASE WHEN {x} RLIKE '^[a-z_][a-z0-9_]*$' THEN {x} ELSE concat('\"', replace({x}, '\"', '\"\"'), '\"') END)")
    if name in ("quote_literal", "quote_nullable") and len(args) == 1:
        quoted = f"concat('\\'', replace({_text(args[0])}, '\\'', '\\'\\''), '\\'')"
        return _raw(quoted if name == "quote_literal" else f"coalesce({quoted}, 'NULL')")
    if name == "string_to_array" and len(args) in (2, 3):
        parts = f"split({_text(args[0])}, concat('\\\\Q', {_text(args[1])}, '\\\\E'), -1)"
        return _raw(f"transform({parts}, __x -> nullif(__x, {_text(args[2])}))" if len(args) == 3 else parts)
    if name == "extract" and group.inner and group.inner[0].low == "epoch":
        return _raw(f"(unix_micros(CAST({_text(group.inner[2:])} AS TIMESTAMP)) / 1e6D)")
    if name == "date_part" and len(args) == 2:
        unit = _text(args[0]).strip("'")
        return _raw(f"(unix_micros(CAST({_text(args[1])} AS TIMESTAMP)) / 1e6D)" if unit.lower() == "epoch" else f"extract({unit} FROM {_text(args[1])})")
    if name == "to_char" and len(args) == 2 and args[1][0].kind == "string":
        pattern = date_pattern(args[1][0].text[1:-1]).replace("'", "\\'")
        return _raw(f"date_format({_text(args[0])}, '{pattern}')")
    if name == "strpos" and len(args) == 2:
        return _raw(f"instr({_text(args[0])}, {_text(args[1])})")
    if name == "log" and len(args) == 1:
        return _raw(f"log10({_text(args[0])})")
    return None


def _gathered(tokens: list[Tok], at: int) -> tuple[Tok, int]:
    """array_agg at a place, with its FILTER and OVER, and where it ends: nulls are kept, DISTINCT is in order, an ORDER BY is of one direction."""
    inner, end = tokens[at + 1].inner or [], at + 2
    where = over = ""
    if _is(tokens, end, "filter"):
        where, end = _text(tokens[end + 1].inner[1:]), end + 2
    if _is(tokens, end, "over"):
        over, end = f" OVER {tokens[end + 1]}", end + 2
    order = next((k for k, t in enumerate(inner) if t.kind == "raw" and t.text.startswith("ORDER BY")), None)
    distinct = bool(inner) and inner[0].low == "distinct"
    value = _text(inner[int(distinct) : order])
    fields, down = [], False
    if order is not None:
        for item in inner[order].text[len("ORDER BY ") :].split(", "):
            m = re.fullmatch(r"(.*?)(?: (asc|desc))? NULLS (FIRST|LAST)", item, re.I | re.S)
            if m is None or len(fields) and down != ((m[2] or "asc").lower() == "desc"):
                raise ValueError("array_agg takes an ORDER BY of one direction")
            down = (m[2] or "asc").lower() == "desc"
            fields += [f"({m[1]}) IS {'NOT ' if down == (m[3].upper() == 'LAST') else ''}NULL", m[1]]
    named = ", ".join(f"'o{k}', {f}" for k, f in enumerate(fields)) + (", " if fields else "") + f"'v', {value}"
    keep = f"'k', coalesce({where}, FALSE), " if where and over else ""
    tail = (f" FILTER (WHERE {where})" if where and not over else "") + over
    got = f"collect_{'set' if distinct else 'list'}(named_struct({keep}{named})){tail}"
    if keep:
        got = f"filter({got}, __s -> __s.k)"
    if fields:
        got = f"sort_array({got}, {'false' if down else 'true'})"
    got = f"transform({got}, __s -> __s.v)"
    return _raw(f"nullif({f'array_sort({got})' if distinct else got}, array())"), end


#: Functions that need an order of their window; without one all rows are peers.
#: Edits of JSON text: the function, and the defaults of its arguments (empty: it has none).
_JSON_EDITS = {
    "jsonb_set": ("lk_json_set", ["", "", "", "TRUE"]),
    "json_set": ("lk_json_set", ["", "", "", "TRUE"]),
    "jsonb_insert": ("lk_json_insert", ["", "", "", "FALSE"]),
    "json_insert": ("lk_json_insert", ["", "", "", "FALSE"]),
    "jsonb_strip_nulls": ("lk_json_strip_nulls", [""]),
    "json_strip_nulls": ("lk_json_strip_nulls", [""]),
    "jsonb_pretty": ("lk_json_pretty", [""]),
    "json_pretty": ("lk_json_pretty", [""]),
}


def _contained(op: str, left: str, right: str) -> str:
    """``@>``, ``<@`` and ``&&`` of arrays, if either side is written as one, and else containment of JSON."""
    whole, part = (left, right) if op != "<@" else (right, left)
    if re.match(r"array\s*\(", left.strip(), re.I) or re.match(r"array\s*\(", right.strip(), re.I):
        return f"arrays_overlap({left}, {right})" if op == "&&" else f"forall({part}, __x -> array_contains({whole}, __x))"
    if op == "&&":
        raise ValueError("&& is for arrays: write one side as ARRAY[...]")
    return f"lk_json_contains({whole}, {part})"


_RANKING = {"row_number", "rank", "dense_rank", "percent_rank", "cume_dist", "ntile", "lag", "lead"}


def _windows(tokens: list[Tok]) -> list[Tok]:
    """OVER () of ranking functions, and OVER (w ...) with the named window written out."""
    named, at = {}, _find(tokens, "window")
    while at >= 0 and _is(tokens, at + 2, "as") and at + 3 < len(tokens):
        named[tokens[at + 1].low] = tokens[at + 3].inner
        at = at + 4 if at + 4 < len(tokens) and tokens[at + 4].text == "," else -1
    for k, t in enumerate(tokens[:-1]):
        after = tokens[k + 1]
        if t.low == "over" and after.kind == "group":
            if after.inner and after.inner[0].low in named:
                after.inner = [*named[after.inner[0].low], *after.inner[1:]]
            if not after.inner and k >= 2 and tokens[k - 2].low in _RANKING:
                after.inner = [_raw("ORDER BY NULL")]
    return tokens


def _expressions(tokens: list[Tok]) -> list[Tok]:
    out: list[Tok] = []
    at = 0
    while at < len(tokens):
        t, low = tokens[at], tokens[at].low
        after = tokens[at + 1] if at + 1 < len(tokens) else None
        if low == "array_agg" and after is not None and after.kind == "group" and after.inner:
            call, at = _gathered(tokens, at)
            out.append(call)
        elif low == "<->":
            right, at = _after(tokens, at + 1)
            out.append(_raw(f"sqrt(aggregate(zip_with({_text(_before(out))}, {_text(_expressions(right))}, (__x, __y) -> power(CAST(__x AS DOUBLE) - CAST(__y AS DOUBLE), 2)), 0.0D, (__s, __x) -> __s + __x))"))
        elif low in ("@>", "<@", "&&"):
            right, at = _after(tokens, at + 1)
            while at + 1 < len(tokens) and tokens[at].low == "::":
                right, at = [*right, *tokens[at : at + 2]], at + 2
            out.append(_raw(_contained(low, _text(_before(out)), _text(_expressions(right)))))
        elif low == "#-" and after is not None:
            out.append(_raw(f"lk_json_delete({_text(_before(out))}, {_text([after])})"))
            at += 2
        elif low == "overlaps" and after is not None and after.kind == "group" and out and out[-1].inner is not None:
            (a, b), (c, d) = ([_text(x) for x in _split(g.inner)] for g in (out.pop(), after))
            out.append(_raw(f"(least({a}, {b}) < greatest({c}, {d}) AND least({c}, {d}) < greatest({a}, {b}))"))
            at += 2
        elif low == "array" and after is not None and after.text == "[]":
            out.append(_raw(f"array({_text(after.inner)})"))
            at += 2
        elif t.kind == "group" and t.text == "[]":
            out.append(_raw(f"try_element_at({_text(_before(out))}, {_text(t.inner)})"))
            at += 1
        elif low == "::":
            kind, end = _after(tokens, at + 1)
            if _is(tokens, at + 1, "double", "precision"):
                kind, end = [_raw("DOUBLE")], at + 3
            name = {"text": "STRING", "int4": "INT", "int8": "BIGINT", "int2": "SMALLINT", "float8": "DOUBLE", "float4": "FLOAT", "bool": "BOOLEAN", "integer": "INT", "numeric": "DECIMAL", "varchar": "STRING", "timestamptz": "TIMESTAMP", "json": "STRING", "jsonb": "STRING", "bytea": "BINARY"}.get(_text(kind).lower(), _text(kind))
            out.append(_raw(f"CAST({_text(_before(out))} AS {name})"))
            at = end
        elif low in ("~", "~*", "!~", "!~*"):
            pattern, end = _after(tokens, at + 1)
            insensitive = f"concat('(?i)', {_text(pattern)})" if low.endswith("*") else _text(pattern)
            out.append(_raw("NOT RLIKE" if low[0] == "!" else "RLIKE", insensitive))
            at = end
        elif low == "similar" and _is(tokens, at + 1, "to"):
            escape, end = "\\", at + 3
            if _is(tokens, end, "escape"):
                escape, end = tokens[end + 1].text[1:-1], end + 2
            pattern = similar_pattern(tokens[at + 2].text[1:-1].replace("\\\\", "\\"), escape).replace("\\", "\\\\").replace("'", "\\'")
            out.append(_raw(f"RLIKE '{pattern}'"))
            at = end
        elif low in ("->", "->>", "#>", "#>>") and after is not None and after.kind in ("string", "number"):
            path = "$" + (_json_path(after) if low[0] == "#" or after.kind == "number" else f".{after.text[1:-1]}")
            out.append(_raw(f"get_json_object({_text(_before(out))}, '{path}')"))
            at += 2
        elif low in _COMPARE and after is not None and after.low in ("any", "some", "all") and at + 2 < len(tokens) and tokens[at + 2].kind == "group":
            group, every = tokens[at + 2], after.low == "all"
            left = _text(_before(out))
            if group.inner and group.inner[0].low in ("select", "with"):
                if (low, every) not in (("=", False), ("<>", True), ("!=", True)):
                    raise ValueError(f"{low} {after.text} of a subquery is not supported")
                out.append(_raw(f"{left} {'NOT IN' if every else 'IN'} {group}"))
            else:
                out.append(_raw(f"{'forall' if every else 'exists'}({_text(group.inner)}, __x -> {left} {low} __x)"))
            at += 3
        elif low == "filter" and after is not None and after.kind == "group" and _is(tokens, at + 2, "over"):
            call = _before(out)
            inner = _text(call[-1].inner) if call[-1].inner is not None else ""
            out.append(_raw(f"{_text(call[:-1])}(CASE WHEN {_text(after.inner[1:])} THEN {'1' if inner.strip() == '*' else inner} END)"))
            at += 2
        elif t.kind == "word" and after is not None and after.kind == "group" and (call := _call(low, after)) is not None:
            out.append(call)
            at += 2
        else:
            out.append(t)
            at += 1
    return out


def _find(tokens: list[Tok], *words: str) -> int:
    return next((k for k in range(len(tokens)) if _is(tokens, k, *words)), -1)


def _whole(tokens: list[Tok]) -> list[Tok]:
    """DISTINCT ON and FETCH of one query; its ORDER BY has been written out by now."""
    fetch = _find(tokens, "fetch")
    if fetch >= 0:
        n = next(t.text for t in tokens[fetch:] if t.kind in ("number", "param"))
        ties, tokens = _find(tokens, "ties") >= 0, tokens[:fetch]
        if not ties:
            tokens = [*tokens, _raw("LIMIT", n)]
        else:
            order = next((k for k, t in enumerate(tokens) if t.kind == "raw" and t.text.startswith("ORDER BY")), None)
            if order is None:
                raise ValueError("WITH TIES needs an ORDER BY")
            start = _find(tokens, "from")
            body = _text([*tokens[:start], _raw(f", rank() OVER ({tokens[order]}) AS __rank"), *tokens[start:order]])
            return [_raw(f"SELECT * EXCEPT (__rank) FROM ({body}) WHERE __rank <= {n}")]
    at = _find(tokens, "distinct", "on")
    if at >= 0 and tokens[at + 2].kind == "group":
        keys = _text(tokens[at + 2].inner)
        order = next((k for k, t in enumerate(tokens) if t.kind == "raw" and t.text.startswith("ORDER BY")), len(tokens))
        by = str(tokens[order]) if order < len(tokens) else f"ORDER BY {keys}"
        start = _find(tokens, "from")
        body = _text([*tokens[:at], *tokens[at + 3 : start], _raw(f", row_number() OVER (PARTITION BY {keys} {by}) AS __n"), *tokens[start:order]])
        return [_raw(f"SELECT * EXCEPT (__n) FROM ({body}) WHERE __n = 1"), *tokens[order + 1 :]]
    return tokens


def _rewrite(tokens: list[Tok]) -> list[Tok]:
    tokens = _windows(tokens)
    for t in tokens:
        if t.inner is not None:
            t.inner = _rewrite(t.inner)
    return _whole(_ordered(_expressions(_set_functions(tokens))))


def to_spark(query: str) -> str:
    """The query as Spark SQL."""
    return _text(_rewrite(_parse(query.strip().rstrip(";"))))


def pg_sql(spark: SparkSession, query: str, args: list | None = None, sf_dir: str | None = None) -> DataFrame:
    """Run a PostgreSQL-flavoured query; ``args`` are $1, $2 and so on; tables of ``sf_dir`` that it names become views first."""
    if sf_dir is not None:
        register(spark, sf_dir, query)
    text = to_spark(query)
    if "lk_json_" in text:
        register_text(spark)
    return spark.sql(text, args={f"p{k + 1}": v for k, v in enumerate(args)}) if args else spark.sql(text)
