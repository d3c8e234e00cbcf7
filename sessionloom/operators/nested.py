"""Deeply nested records to flat, linked tables, by Dewey labels.

Each node of a record gets the ordinals on the way from the root as its label;
its parent's label is the label without the last ordinal. Nodes are grouped by
schema path (the way from the root with ordinals left out) into tables, so the
tables' rows link by label and no key has to be made up.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom import runtime

#: In a schema path: a step into a list. A field's step is its name after a dot.
ITEM = "[]"
_BATCH = 20_000
_TYPES = [pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
NODES = "dewey array<int>, schema_path array<string>, node_kind string, node_value string, fields map<string,string>"


def decode(text: str | None):
    """The value written in ``text``: JSON, a Python literal, or either of them written as a JSON string, however often.

    ``ValueError`` if there is none. A string that holds no encoded value is the value.
    """
    value, steps = text, 0
    while isinstance(value, str):
        try:
            inner = json.loads(value)
        except (ValueError, RecursionError):
            try:
                inner = ast.literal_eval(value.strip())
            except (ValueError, SyntaxError, RecursionError, MemoryError, TypeError):
                if steps:
                    return value
                raise ValueError("neither JSON nor a literal") from None
        if isinstance(inner, str) and len(inner) >= len(value):
            return inner  # each encoding puts quotes around its text; this one can't be another
        value, steps = inner, steps + 1
    return value


def _kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, dict):
        return "object"
    if isinstance(v, (list, tuple, set, frozenset)):
        return "array"
    return "string"


def _scalar(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v) if isinstance(v, (bool, int, float)) else str(v)


def walk(value, only: re.Pattern | None = None, whole: re.Pattern | None = None) -> Iterator[tuple]:
    """(label, schema path, kind, value, fields) of each node, in preorder.

    ``fields`` are an object's scalar members. A node whose path matches
    ``whole`` has its entire content as JSON for its value.
    """
    todo = [((), (), value)]
    while todo:
        label, path, v = todo.pop()
        kind = _kind(v)
        if only is None or only.search("".join(path)):
            fields = list({str(k): _scalar(x) for k, x in v.items() if _kind(x) not in ("object", "array")}.items()) if kind == "object" else None
            scalar = _scalar(v) if kind not in ("object", "array") else None
            if scalar is None and v is not None and whole is not None and whole.search("".join(path)):
                scalar = json.dumps(v, ensure_ascii=False, default=str)
            yield label, path, kind, scalar, fields
        if kind == "object":
            todo += [((*label, i), (*path, f".{k}"), x) for i, (k, x) in reversed(list(enumerate(v.items())))]
        elif kind == "array":
            todo += [((*label, i), (*path, ITEM), x) for i, x in reversed(list(enumerate(v)))]


def label(rows: DataFrame, text: str, keys: list[str], only: str | None = None, whole: str | None = None) -> DataFrame:
    """The nodes of each row's record: ``keys`` and the columns of ``NODES``.

    ``only`` is a pattern searched for in the joined schema path; other nodes
    don't leave the Python worker. Nodes matching ``whole`` carry their content
    as JSON. The root has an empty label. Unreadable and
    null records have no nodes, repeated rows repeat theirs. Only ``keys`` of
    the other columns are read, so their names can't clash.
    """
    runtime.require_columns(rows, text, *keys)
    kept = rows.select(*(F.col(f"`{k}`") for k in keys), F.col(f"`{text}`").cast("string").alias("__record")).where("__record is not null")
    names = [*keys, "dewey", "schema_path", "node_kind", "node_value", "fields"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, entire = re.compile(only) if only else None, re.compile(whole) if whole else None
        for b in batches:
            *values, records = b.columns
            at, out = [], []

            def send() -> pa.RecordBatch:
                columns = zip(*out) if out else [()] * len(_TYPES)
                taken = [v.take(pa.array(at, pa.int32())) for v in values]
                return pa.RecordBatch.from_arrays([*taken, *(pa.array(c, t) for c, t in zip(columns, _TYPES))], names)

            for i, record in enumerate(records.to_pylist()):
                try:
                    value = decode(record)
                except ValueError:
                    continue
                for node in walk(value, wanted, entire):
                    at.append(i)
                    out.append(node)
                if len(out) >= _BATCH:
                    yield send()
                    at, out = [], []
            yield send()

    schema = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys) + ", " + NODES
    return kept.mapInArrow(run, schema)


def dewey_text(dewey: Column) -> Column:
    return F.array_join(dewey.cast("array<string>"), ".")


def parent_label(dewey: Column) -> Column:
    """The label without its last ordinal; null for the root."""
    return F.when(F.size(dewey) > 0, F.slice(dewey, 1, F.greatest(F.size(dewey) - 1, F.lit(0))))


def table_of(nodes: DataFrame, pattern: str) -> DataFrame:
    """The nodes whose schema path matches ``pattern``, with ``node`` and ``parent`` as texts."""
    return nodes.where(F.array_join("schema_path", "").rlike(pattern)).withColumns(
        {"node": dewey_text(F.col("dewey")), "parent": dewey_text(parent_label(F.col("dewey")))}
    )


def flat(nodes: DataFrame) -> DataFrame:
    """The rows of all tables at once: a row for each object, and for each list item that is none.

    ``table_path`` names the table (the schema path; ``$`` is the root),
    ``node`` and ``parent`` are labels, ``parent`` that of the nearest row above
    (lists have no rows; an empty one is the record, if its root is a list), ``place`` the ordinal in the list that holds the row, ``fields`` an object's scalar
    members, ``node_value`` another item's value. Needs the nodes of whole
    records (``label`` without ``only``).
    """
    path, dewey = F.col("schema_path"), F.col("dewey")
    item = F.coalesce(F.try_element_at(path, F.lit(-1)) == ITEM, F.lit(False))
    # A list stands between an item and the row above it, and lists in lists make as many steps more.
    fields_at = F.filter(F.sequence(F.lit(1), F.size(path)), lambda i: (i > 0) & (F.try_element_at(path, F.greatest(i, F.lit(1))) != ITEM))
    up = F.when(F.size(path) == 0, 0).otherwise(F.coalesce(F.array_max(fields_at), F.lit(1)) - 1)
    kept = nodes.where((F.col("node_kind") == "object") | (item & (F.col("node_kind") != "array")))
    return kept.withColumns(
        {
            "table_path": F.when(F.size(path) == 0, "$").otherwise(F.concat(F.lit("$"), F.array_join(path, ""))),
            "node": dewey_text(dewey), "parent": F.when(F.size(dewey) > 0, dewey_text(F.slice(dewey, 1, F.greatest(up, F.lit(0))))),
            "place": F.when(item, F.element_at(dewey, -1)),
        }
    ).drop("dewey", "schema_path")


#: Elements of lists named content, and contents that are plain strings.
CONTENT = r"\.content(\[\])?$"


def content_elements(nodes: DataFrame) -> DataFrame:
    """The elements of all content lists, with ``block_path`` and ``parent_path``.

    ``block_path`` keeps of the label the ordinals in content lists. A content
    that is a non-empty string is its own element 0.
    """
    path = F.col("schema_path")
    at = F.filter(F.sequence(F.lit(1), F.size(path)), lambda i: (F.element_at(path, i) == ITEM) & (i > 1) & (F.element_at(path, F.greatest(i - 1, F.lit(1))) == ".content"))
    ordinals = F.transform(at, lambda i: F.element_at(F.col("dewey"), i).cast("string"))
    plain = F.try_element_at(path, F.lit(-1)) == ".content"
    item = (F.try_element_at(path, F.lit(-1)) == ITEM) & (F.try_element_at(path, F.lit(-2)) == ".content")
    found = nodes.where(item | (plain & (F.col("node_kind") == "string") & (F.coalesce("node_value", F.lit("")) != "")))
    found = found.withColumn("__way", F.when(plain, F.concat(ordinals, F.array(F.lit("0")))).otherwise(ordinals))
    return found.withColumns(
        {
            "block_path": F.array_join("__way", "."),
            "parent_path": F.when(F.size("__way") > 1, F.array_join(F.slice("__way", 1, F.size("__way") - 1), ".")),
        }
    ).drop("__way")
