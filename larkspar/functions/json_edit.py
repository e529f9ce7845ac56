"""Deep edits and containment of JSON documents, for which Spark has no built-in: vectorised over Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql.pandas.functions import pandas_udf


def _path(path: str) -> list[str]:
    return [p for p in path.strip().strip("{}").split(",") if p]


def _dump(doc) -> str:
    return json.dumps(doc, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def _contains(a, b) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(_contains(x, y) for x in a) for y in b) if isinstance(b, list) else any(not isinstance(x, (dict, list)) and x == b for x in a)
    return type(a) is type(b) and a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)


def _index(at: list, key: str) -> int | None:
    try:
        k = int(key)
    except ValueError:
        return None
    return k + len(at) if k < 0 else k


def _set(doc, path: list[str], value, create: bool):
    if not path:
        return value
    key, rest = path[0], path[1:]
    if isinstance(doc, dict):
        if key in doc or create and not rest:
            return doc | {key: _set(doc.get(key), rest, value, create)}
    elif isinstance(doc, list) and (k := _index(doc, key)) is not None:
        if 0 <= k < len(doc):
            return [*doc[:k], _set(doc[k], rest, value, create), *doc[k + 1 :]]
        if create and not rest:
            return [value, *doc] if k < 0 else [*doc, value]
    return doc


def _insert(doc, path: list[str], value, after: bool):
    key, rest = path[0], path[1:]
    if isinstance(doc, dict):
        if rest:
            return doc | {key: _insert(doc[key], rest, value, after)} if key in doc else doc
        if key in doc:
            raise ValueError("cannot replace an existing key")
        return doc | {key: value}
    if isinstance(doc, list) and (k := _index(doc, key)) is not None:
        if rest:
            return [*doc[:k], _insert(doc[k], rest, value, after), *doc[k + 1 :]] if 0 <= k < len(doc) else doc
        k = min(max(k + after, 0), len(doc))
        return [*doc[:k], value, *doc[k:]]
    return doc


def _delete(doc, path: list[str]):
    if not path:
        return doc
    key, rest = path[0], path[1:]
    if isinstance(doc, dict) and key in doc:
        return doc | {key: _delete(doc[key], rest)} if rest else {k: v for k, v in doc.items() if k != key}
    if isinstance(doc, list) and (k := _index(doc, key)) is not None and 0 <= k < len(doc):
        return [*doc[:k], _delete(doc[k], rest), *doc[k + 1 :]] if rest else doc[:k] + doc[k + 1 :]
    return doc


def _strip(doc):
    if isinstance(doc, dict):
        return {k: _strip(v) for k, v in doc.items() if v is not None}
    return [_strip(x) for x in doc] if isinstance(doc, list) else doc


def _edited(series: pd.Series, edit) -> pd.Series:
    return series.map(lambda s: None if s is None else _dump(edit(json.loads(s))), na_action="ignore")


def json_set(doc: Column, path: str, value: str, create: bool = True) -> Column:
    """The document with the value at a path such as ``{a,0}`` replaced, or added if its key is missing."""
    new, at = json.loads(value), _path(path)

    @pandas_udf("string")
    def edit(docs: pd.Series) -> pd.Series:
        return _edited(docs, lambda d: _set(d, at, new, create))

    return edit(doc)


def json_insert(doc: Column, path: str, value: str, after: bool = False) -> Column:
    """The document with a value put before, or after, an array's element, or under a new key; an existing key is an error."""
    new, at = json.loads(value), _path(path)

    @pandas_udf("string")
    def edit(docs: pd.Series) -> pd.Series:
        return _edited(docs, lambda d: _insert(d, at, new, after))

    return edit(doc)


def json_delete(doc: Column, path: str) -> Column:
    """The document without what is at a path."""
    at = _path(path)

    @pandas_udf("string")
    def edit(docs: pd.Series) -> pd.Series:
        return _edited(docs, lambda d: _delete(d, at))

    return edit(doc)


def json_strip_nulls(doc: Column) -> Column:
    """The document without object fields that are null."""

    @pandas_udf("string")
    def edit(docs: pd.Series) -> pd.Series:
        return _edited(docs, _strip)

    return edit(doc)


def json_pretty(doc: Column) -> Column:
    """The document over several lines, four spaces a level, its keys in their order."""

    @pandas_udf("string")
    def edit(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: json.dumps(json.loads(d), indent=4, ensure_ascii=False), na_action="ignore")

    return edit(doc)


def json_contains(doc: Column, part: Column) -> Column:
    """``doc @> part``; null if either is."""

    @pandas_udf("boolean")
    def test(docs: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _contains(json.loads(a), json.loads(b)) for a, b in zip(docs, parts, strict=True)], dtype="object")

    return test(doc, part)


def _flag(v) -> bool:
    return bool(v) if v is not None else False


def register_text(spark: SparkSession) -> None:
    """The functions as ``lk_*`` of SQL text, whose path and value may come from columns; a null argument gives null."""

    def put(name: str, work: Callable[..., object]) -> None:
        @pandas_udf("string")
        def edit(*args: pd.Series) -> pd.Series:
            return pd.Series([None if any(v is None for v in row) else work(*row) for row in zip(*args, strict=True)], dtype="object")

        spark.udf.register(name, edit)

    put("lk_json_set", lambda d, path, value, create: _dump(_set(json.loads(d), _path(path), json.loads(value), _flag(create))))
    put("lk_json_insert", lambda d, path, value, after: _dump(_insert(json.loads(d), _path(path), json.loads(value), _flag(after))))
    put("lk_json_delete", lambda d, path: _dump(_delete(json.loads(d), _path(path))))
    put("lk_json_strip_nulls", lambda d: _dump(_strip(json.loads(d))))
    put("lk_json_pretty", lambda d: json.dumps(json.loads(d), indent=4, ensure_ascii=False))

    @pandas_udf("boolean")
    def contains(docs: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _contains(json.loads(a), json.loads(b)) for a, b in zip(docs, parts, strict=True)], dtype="object")

    spark.udf.register("lk_json_contains", contains)
