"""Chat formatting: schema fingerprints select declarative mappings into canonical turns, and a template that can be read back.

A schema's fingerprint is the hash of its sorted nested field paths, of those that any mapping names. A mapping says where the conversation, order, role and text of a turn are in such a layout.
For records of many layouts in one JSON column, each record's own fingerprint chooses its mapping.

The template marks each turn as START role newline text END newline. Control strings inside texts and roles, of this template and of other common ones, are replaced by a mark and
a code, and the mark itself by another, so that the output splits at its markers only and every text is got back exactly. The loss mask is the byte spans of assistant texts in the output.

All of it is DataFrame code. A conversation is one output value, so the turns of one conversation meet in one task, and of nothing else.

Rows: turns of one conversation with equal numbers are in order of role, then text, null numbers first; repeated rows stay. Null roles and texts count as empty. Rows of a null conversation are one conversation.
A very long turn, or conversation, is one value, in one task. Rows that are turns keep their roles as they are, so that they can be read back; other layouts' names of roles are put in ROLES' words. An empty table gives an empty one. Extra columns are not
read, whatever their names; of a table with fields of several layouts, see ``mapping_of``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

START, END, MARK = "<|im_start|>", "<|im_end|>", "␛"
#: Control strings that are escaped inside texts, each with its code.
CONTROLS = {START: "a", END: "b", "<|endoftext|>": "c", "<s>": "d", "</s>": "e", "[INST]": "f", "[/INST]": "g", "<<SYS>>": "h", "<</SYS>>": "i", "<|system|>": "j", "<|user|>": "k", "<|assistant|>": "l"}


@dataclass(frozen=True)
class Mapping:
    """How one layout gives turns. ``turns``: path of the array of turns, none if each row is a turn. ``parts``: fixed roles of fields, in order, for layouts without turns."""

    name: str
    paths: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()


#: The known layouts.
MAPPINGS = (
    Mapping("turn rows", ("turn", "role", "text"), role="role", text="text"),
    Mapping("messages", ("messages", "messages[].role", "messages[].content"), turns="messages", role="role", text="content"),
    Mapping("conversations", ("conversations", "conversations[].from", "conversations[].value"), turns="conversations", role="from", text="value"),
    Mapping("prompt", ("prompt", "response"), parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("completion", ("prompt", "completion"), parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("instruction", ("instruction", "output"), parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction with input", ("instruction", "input", "output"), parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)
#: Other names of roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_KNOWN = {p for m in MAPPINGS for p in m.paths}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema; an element of an array is ``[]``."""
    if isinstance(kind, T.StructType):
        paths = [(f"{at}.{f.name}" if at else f.name, f.dataType) for f in kind]
        return [p for path, inner in paths for p in (path, *field_paths(inner, path))]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return []


def schema_fingerprint(paths) -> str:
    """Hash of the sorted paths that any mapping names, as text."""
    return hashlib.sha256("\n".join(sorted(set(paths) & _KNOWN)).encode()).hexdigest()


_BY_FINGERPRINT = {schema_fingerprint(m.paths): m for m in MAPPINGS}


def mapping_of(schema: T.StructType) -> Mapping:
    """The mapping that a table's schema selects: that of its fingerprint; where fields of several layouts are there, the first in MAPPINGS of those whose fields all are, by the fingerprint of those fields, the most fields first."""
    paths = field_paths(schema)
    found = _BY_FINGERPRINT.get(schema_fingerprint(paths))
    if found is None:
        whole = [schema_fingerprint(set(paths) & set(m.paths)) for m in sorted(MAPPINGS, key=lambda m: -len(m.paths))]
        found = next((_BY_FINGERPRINT[f] for f in whole if f in _BY_FINGERPRINT), None)
    if found is None:
        raise ValueError(f"no mapping for a table with the fields {', '.join(sorted(paths))}")
    return found


def _role(col: Column) -> Column:
    return reduce(lambda c, x: F.when(col == x[0], F.lit(x[1])).otherwise(c), ROLES.items(), F.coalesce(col, F.lit("")))


def turn_rows(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a table of any known layout; ``conv_id`` names the id of a row's conversation."""
    m = mapping_of(df.schema)
    own = F.col(f"`{conv_id}`").alias("conv_id")
    if m.turns:
        each = df.select(own, F.posexplode(F.col(m.turns)).alias("turn", "t"))
        return each.select("conv_id", F.col("turn").cast("bigint").alias("turn"), _role(F.col("t")[m.role]).alias("role"), F.coalesce(F.col("t")[m.text].cast("string"), F.lit("")).alias("text"))
    if m.parts:
        turns = F.array(*[F.struct(F.lit(r).alias("role"), _joined([F.col(f"`{f}`") for f in fields]).alias("text")) for r, fields in m.parts])
        each = df.select(own, F.posexplode(turns).alias("turn", "t"))
        return each.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "t.role", "t.text")
    return df.select(own, F.col("`turn`").cast("bigint").alias("turn"), F.coalesce(F.col("`role`"), F.lit("")).alias("role"), F.coalesce(F.col("`text`"), F.lit("")).alias("text"))


def _joined(cols: list[Column]) -> Column:
    """Fields as one text, those that are null or empty left out."""
    return F.concat_ws("\n", *[F.when(c != "", c) for c in cols])


def _under(keys: Column, array: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(f"{array}[]."), k))


def _turns_of(each: Column, m: Mapping) -> Column:
    return F.transform(each, lambda t: F.struct(_role(t[m.role]).alias("role"), F.coalesce(t[m.text], F.lit("")).alias("text")))


def record_turns(df: DataFrame, record: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, layout, turns array<struct<role, text>>) of JSON records of many layouts, a row for each row.

    The keys at the top and in the first element of an array are a record's paths; their fingerprint selects the mapping. Records that fit none, or are no JSON, have a null layout and null turns.
    """
    doc = F.try_parse_json(F.col(f"`{record}`"))
    shape = F.schema_of_variant(doc)
    # A variant's schema as text, sorted by key: only names and nesting count, so types go and known arrays keep their brackets.
    top = F.coalesce(F.json_object_keys(F.col(f"`{record}`")), F.array().cast("array<string>"))
    paths = top
    for m in MAPPINGS:
        if m.turns:
            inner = F.coalesce(F.json_object_keys(F.get_json_object(F.col(f"`{record}`"), f"$.{m.turns}[0]")), F.array().cast("array<string>"))
            paths = F.concat(paths, _under(inner, m.turns))
    known = F.array_sort(F.array_intersect(paths, F.array(*[F.lit(p) for p in sorted(_KNOWN)])))
    out = df.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{record}`").alias("__record"), F.when(shape.isNotNull(), F.sha2(F.array_join(known, "\n"), 256)).alias("__print"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for print_, m in _BY_FINGERPRINT.items():
        if m.turns:
            each = F.from_json(F.get_json_object("__record", f"$.{m.turns}"), f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
            got = _turns_of(each, m)
        elif m.parts:
            got = F.array(*[F.struct(F.lit(r).alias("role"), _joined([F.get_json_object("__record", f"$.{f}") for f in fields]).alias("text")) for r, fields in m.parts])
        else:
            got = F.array(F.struct(_role(F.get_json_object("__record", "$.role")).alias("role"), F.coalesce(F.get_json_object("__record", "$.text"), F.lit("")).alias("text")))
        fits = F.col("__print") == print_
        layout, turns = F.when(fits, F.lit(m.name)).otherwise(layout), F.when(fits, got).otherwise(turns)
    return out.select("conv_id", layout.alias("layout"), turns.alias("turns"))


def escaped(col: Column) -> Column:
    """A text without control strings: the mark first, then each control string."""
    col = F.replace(col, F.lit(MARK), F.lit(MARK + "0"))
    for control, code in CONTROLS.items():
        col = F.replace(col, F.lit(control), F.lit(MARK + code))
    return col


def unescaped(col: Column) -> Column:
    """What ``escaped`` was given."""
    for control, code in CONTROLS.items():
        col = F.replace(col, F.lit(MARK + code), F.lit(control))
    return F.replace(col, F.lit(MARK + "0"), F.lit(MARK))


def _escaped_role(col: Column) -> Column:
    return F.replace(escaped(col), F.lit("\n"), F.lit(MARK + "n"))


def _unescaped_role(col: Column) -> Column:
    return unescaped(F.replace(col, F.lit(MARK + "n"), F.lit("\n")))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one row for each conversation; loss: the spans (start, bytes) of assistant texts in the UTF-8 output, starts from 0.

    Offsets are running sums over the turns of a conversation, on the same shuffle as the join of its pieces.
    """
    head = F.concat(F.lit(START), _escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    pieces = turns.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    pieces = pieces.withColumn("size", F.octet_length("head") + F.octet_length("body") + F.lit(len(END) + 1).cast("bigint"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("start", F.sum("size").over(order) - F.col("size"))
    whole = pieces.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "start",
                    F.concat("head", "body", F.lit(END + "\n")).alias("piece"),
                    F.when(F.col("role") == "assistant", F.struct((F.col("start") + F.octet_length("head")).alias("start"), F.octet_length("body").cast("bigint").alias("bytes"))).alias("loss"),
                )
            )
        ).alias("all")
    )
    return whole.select("conv_id", F.array_join("all.piece", "").alias("formatted"), F.filter(F.col("all.loss"), lambda x: x.isNotNull()).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss, turns array<struct<role, text>>, loss_texts array<string>), from the output and its mask alone."""
    raw = formatted.select("*", F.encode("formatted", "UTF-8").alias("__raw"), F.split("formatted", r"\Q" + END + "\n" + r"\E").alias("__split"))
    body = F.slice("__split", 1, F.size("__split") - 1)
    turns = F.transform(
        body,
        lambda p: F.struct(
            _unescaped_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescaped(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )
    texts = F.transform("loss", lambda m: unescaped(F.decode(F.substr(F.col("__raw"), (m["start"] + 1).cast("int"), m["bytes"].cast("int")), "UTF-8")))
    return raw.select("conv_id", "formatted", "loss", turns.alias("turns"), texts.alias("loss_texts"))
