"""Nested documents to related flat tables by shared inlining (problem 1).

Two passes over the documents, both in Arrow batches:

1. ``schema_graph`` walks every document and returns the element graph: parent and child element, whether the child
   was seen repeated, and the kinds of its values. Each batch emits its distinct edges, so what is shuffled and
   collected is bounded by the vocabulary of element names, never by the data. ``element_graph`` collects it and fails
   where there are more than MAX_EDGES: then member names are data, and the model must name them as maps.
2. ``inline_plan`` decides which elements get a table: the root, elements that repeat, elements shared by several
   parents, recursive elements, and those asked for. All other elements are singletons and are inlined into their
   nearest ancestor with a table, as dotted columns. Each table's columns get the type that holds all their values.
3. ``shred`` emits one row per element with a table, with its own id, its parent's table and id, its place and the
   record keys of all its ancestors. ``flat_table`` gives the typed table of one element from these rows.

Defined results: a body that is null, empty, torn, not JSON or not an object or list of objects gives no rows. A null
element gives no row but holds its place in its list. An element standing alone instead of in a list has place 0. A
leading byte order mark is no part of a document. An item that stands apart under the key of a record which the document
lacks has no parent: it gives no row, and nothing in it does. Values of mixed kinds are text, lists and objects as JSON.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROOT = "document"
GRAPH_SCHEMA = "parent string, child string, repeated boolean, kinds int, seen bigint"
#: Bits of the kinds of a member's values.
TEXT, WHOLE, FLOAT, BOOLEAN, OBJECT, LIST = 1, 2, 4, 8, 16, 32
#: Most edges that an element graph may have.
MAX_EDGES = 100_000


@dataclass(frozen=True)
class DocumentModel:
    """What the schema graph cannot tell by itself.

    aliases: member name -> element name. keyed: elements that may stand as an object from record key to record.
    maps: members whose keys are data; each pair becomes an item. records: elements that are objects and nothing else
    (text that holds a JSON object is read as one). keys: element -> ways to its key, tried in order: a member name,
    "@key" (the key it stands under) or a template over members. references: member name -> element whose key the
    member's keys refer to. wrappers: members whose object belongs to the record around it. markers: text before and after the document.
    """

    aliases: dict[str, str] = field(default_factory=dict)
    keyed: frozenset[str] = frozenset()
    maps: frozenset[str] = frozenset()
    records: frozenset[str] = frozenset()
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    references: dict[str, str] = field(default_factory=dict)
    wrappers: frozenset[str] = frozenset()
    markers: tuple[str, str] | None = None


def _no_json(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def read_document(body: str | None, markers: tuple[str, str] | None) -> object | None:
    if not body:
        return None
    if markers:
        start = body.find(markers[0])
        if start >= 0:
            end = body.rfind(markers[1])
            if end < start:
                return None
            body = body[start + len(markers[0]) : end]
    try:
        return json.loads(body.removeprefix("﻿"), parse_constant=_no_json)
    except (ValueError, RecursionError):
        return None


def _record_in(text: str) -> dict | None:
    if text.lstrip()[:1] != "{":
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _items(model: DocumentModel, name: str, element: str, value: object) -> Iterator[tuple[int, str | None, object]]:
    """(place, key, item) of each item of a member, nulls left out; the key where it stands under one."""
    if isinstance(value, list):
        for place, item in enumerate(value):
            if item is not None:
                yield place, None, item
    elif isinstance(value, dict) and name in model.maps:
        for place, (key, item) in enumerate(value.items()):
            if item is not None:
                yield place, key, item
    elif isinstance(value, dict) and name in model.keyed and all(x is None or isinstance(x, dict) or isinstance(x, str) and _record_in(x) is not None for x in value.values()):
        for key, item in value.items():
            if item is not None:
                yield 0, key, item
    elif value is not None:
        yield 0, None, value


def _repeats(model: DocumentModel, name: str, value: object) -> bool:
    return isinstance(value, list) or name in model.maps or name in model.keyed


def _kind(value: object) -> int:
    if isinstance(value, str):
        return TEXT
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, int):
        return WHOLE if -(1 << 63) <= value < 1 << 63 else TEXT
    if isinstance(value, float):
        return FLOAT
    return OBJECT if isinstance(value, dict) else LIST


Edges = dict[tuple[str, str], list[int]]  # (parent, child) -> [repeated, kinds, seen]


def _edges(model: DocumentModel, document: object, out: Edges) -> None:
    def note(parent: str, child: str, repeated: bool, kind: int) -> None:
        edge = out.setdefault((parent, child), [0, 0, 0])
        edge[0] |= repeated
        edge[1] |= kind
        edge[2] += 1

    def visit(element: str, record: dict) -> None:
        for name, value in record.items():
            if value is None:
                continue
            child = model.aliases.get(name, name)
            if name in model.wrappers and isinstance(value, dict):
                visit(element, value)
                continue
            if isinstance(value, str) and child in model.records:
                value = _record_in(value)
                if value is None:
                    continue
            note(element, child, _repeats(model, name, value), _kind(value))
            if not isinstance(value, (dict, list)):
                continue
            for _, _, item in _items(model, name, child, value):
                if isinstance(item, str) and child in model.records:
                    item = _record_in(item)
                if isinstance(item, dict):
                    visit(child, item)
                elif item is not None:
                    note(child, "value", False, _kind(item))

    for item in document if isinstance(document, list) else [document]:
        if isinstance(item, dict):
            visit(ROOT, item)


def schema_graph(docs: DataFrame, body: str, model: DocumentModel) -> DataFrame:
    """(parent, child, repeated, kinds, seen): one row per distinct edge of the element graph."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Edges = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                _edges(model, read_document(text, model.markers), out)
        parent, child = [pa.array([k[n] for k in out], pa.string()) for n in (0, 1)]
        repeated, kinds, seen = [pa.array([v[n] for v in out.values()], t) for n, t in enumerate((pa.int64(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([parent, child, repeated.cast(pa.bool_()), kinds, seen], names=["parent", "child", "repeated", "kinds", "seen"])

    edges = docs.select(body).mapInArrow(run, GRAPH_SCHEMA)
    return edges.groupBy("parent", "child").agg(F.max("repeated").alias("repeated"), F.bit_or("kinds").alias("kinds"), F.sum("seen").alias("seen"))


Edge = tuple[str, str, bool, int]


def element_graph(docs: DataFrame, body: str, model: DocumentModel) -> list[Edge]:
    """The edges of schema_graph in the driver; fails where they are more than MAX_EDGES."""
    rows = schema_graph(docs, body, model).select("parent", "child", "repeated", "kinds").limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges: member names are data; name their elements in maps")
    return [tuple(r) for r in rows]


@dataclass(frozen=True)
class InlinePlan:
    """Elements with a table, the first reason that holds for each, and each table's columns with their types."""

    tables: frozenset[str]
    reasons: dict[str, str]
    columns: dict[str, dict[str, str]] = field(default_factory=dict)


def _type(kinds: int) -> str:
    if kinds == BOOLEAN:
        return "boolean"
    if kinds == WHOLE:
        return "bigint"
    return "double" if kinds and not kinds & ~(WHOLE | FLOAT) else "string"


def inline_plan(graph: Iterable[Edge], model: DocumentModel, wanted: Iterable[str] = ()) -> InlinePlan:
    graph = list(graph)
    edges = [(parent, child, repeated) for parent, child, repeated, kinds in graph if repeated or kinds & (OBJECT | LIST)]
    children: dict[str, set[str]] = {}
    parents: dict[str, set[str]] = {}
    for parent, child, _ in edges:
        children.setdefault(parent, set()).add(child)
        parents.setdefault(child, set()).add(parent)

    def reaches_itself(start: str) -> bool:
        seen, todo = set(), [start]
        while todo:
            for child in children.get(todo.pop(), ()):
                if child == start:
                    return True
                if child not in seen:
                    seen.add(child)
                    todo.append(child)
        return False

    reasons = {ROOT: "root"}
    for _, child, repeated in edges:
        if repeated:
            reasons[child] = "repeated"
    for child, from_ in parents.items():
        if child not in reasons and len(from_) > 1:
            reasons[child] = "shared"
        if child not in reasons and reaches_itself(child):
            reasons[child] = "recursive"
    for element in wanted:
        reasons.setdefault(element, "wanted")

    members: dict[str, list[tuple[str, int]]] = {}
    for parent, child, _, kinds in graph:
        members.setdefault(parent, []).append((child, kinds))

    def columns(element: str, prefix: str) -> Iterator[tuple[str, str]]:
        for child, kinds in sorted(members.get(element, ())):
            if child not in reasons:
                if kinds & ~OBJECT:
                    yield f"{prefix}{child}", _type(kinds & ~OBJECT)
                if kinds & OBJECT:
                    yield from columns(child, f"{prefix}{child}.")

    return InlinePlan(frozenset(reasons), reasons, {element: dict(columns(element, "")) for element in reasons})


SHRED_SCHEMA = "element string, node_id string, parent_element string, parent_id string, item_no int, item_key string, keys map<string,string>, has_fields boolean, attributes map<string,string>"


def shred(docs: DataFrame, doc_key: str, body: str, model: DocumentModel, plan: InlinePlan, elements: Iterable[str] | None = None, attributes: bool = True) -> DataFrame:
    """One row per element that has a table, beside the document's key.

    elements: only rows of these. attributes: whether the inlined values are carried (they can be left out where only
    keys are asked for). has_fields: the element is an object with at least one member, or a value.
    """
    kept = frozenset(elements) if elements is not None else plan.tables
    tables = plan.tables

    def text(value: object) -> str:
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    def key_of(element: str, item: object, at_key: str | None) -> str | None:
        for way in model.keys.get(element, ()):
            if way == "@key":
                found = at_key
            elif "{" in way:
                found = way.format_map(_Members(item)) if isinstance(item, dict) else None
            else:
                found = item.get(way) if isinstance(item, dict) else None
            if found is not None and found != "":
                return text(found)
        return None

    def rows_of(document: object) -> Iterator[tuple]:
        here: dict[str, set[str]] = {}  # keys of the document's records
        apart: list[tuple[str, str, tuple]] = []  # items under the key of a record, which may still come

        def emit(element: str, node_id: str, parent: tuple[str | None, str | None], place: int, at_key: str | None, item: object, keys: dict[str, str]) -> Iterator[tuple]:
            if element in model.records:
                item = _record_in(item) if isinstance(item, str) else item
                if not isinstance(item, dict):
                    return
            own = key_of(element, item, at_key)
            if own is not None:
                keys = keys | {element: own}
                here.setdefault(element, set()).add(own)
            values: dict[str, str] = {}
            below: list[tuple] = []

            def absorb(prefix: str, record: dict) -> None:
                for name, value in record.items():
                    child = model.aliases.get(name, name)
                    if value is None:
                        continue
                    if name in model.wrappers and isinstance(value, dict):
                        absorb(prefix, value)
                    elif child in tables:
                        below.append((name, child, f"{prefix}{name}", value))
                    elif isinstance(value, dict):
                        absorb(f"{prefix}{name}.", value)
                    else:
                        values[f"{prefix}{name}"] = text(value)

            if isinstance(item, dict):
                absorb("", item)
            else:
                values["value"] = text(item)
            if element in kept:
                yield element, node_id, *parent, place, at_key, list(keys.items()), not isinstance(item, dict) or bool(item), list(values.items()) if attributes else None
            for name, child, at, value in below:
                if child in model.records and isinstance(value, str):
                    value = _record_in(value)
                for n, key, inner in _items(model, name, child, value):
                    refers = model.references.get(name)
                    below_it = (child, f"{node_id}/{at}[{n if key is None else key}]", (element, node_id), n, key, inner)
                    if refers and key is not None:
                        apart.append((refers, key, (*below_it, keys | {refers: key})))
                    else:
                        yield from emit(*below_it, keys)

        if isinstance(document, list):
            for n, item in enumerate(document):
                if isinstance(item, dict):
                    yield from emit(ROOT, f"[{n}]", (None, None), n, None, item, {})
        elif isinstance(document, dict):
            yield from emit(ROOT, "", (None, None), 0, None, document, {})
        while apart:
            refers, key, item = apart.pop(0)
            if key in here.get(refers, ()):
                yield from emit(*item)

    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.map_(pa.string(), pa.string())]
    names = ["element", "node_id", "parent_element", "parent_id", "item_no", "item_key", "keys", "has_fields", "attributes"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start in range(0, batch.num_rows, 64):
                rows, source = [], []
                for n, body_text in enumerate(batch.column(1).slice(start, 64).to_pylist(), start):
                    for row in rows_of(read_document(body_text, model.markers)):
                        rows.append(row)
                        source.append(n)
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(source, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]], names=[doc_key, *names])

    key_type = docs.schema[doc_key].dataType.simpleString()
    return docs.select(doc_key, body).mapInArrow(run, f"`{doc_key}` {key_type}, {SHRED_SCHEMA}")


class _Members(dict):
    """Members of a record as text; a missing one as nothing."""

    def __init__(self, record: dict) -> None:
        super().__init__({k: "" if v is None else v for k, v in record.items()})

    def __missing__(self, name: str) -> str:
        return ""


def flat_table(rows: DataFrame, doc_key: str, element: str, columns: Mapping[str, str], key_elements: Iterable[str]) -> DataFrame:
    """The table of one element: keys of the document, of the row, of its parent and of its ancestors, its place and the
    key it stands under, then columns (path -> type). A value that its type cannot hold is null."""
    return rows.where(F.col("element") == element).select(
        doc_key, "node_id", "parent_element", "parent_id", "item_no", "item_key",
        *[F.col("keys")[k].alias(f"{k}_key") for k in key_elements],
        *[F.col("attributes")[c].try_cast(t).alias(c.replace(".", "_")) for c, t in columns.items()],
    )
