"""Deeply nested records into related flat tables.

Records are parsed as a stream into path-value-ordinal triples, paths are grouped by their nearest
repeated ancestor, and each group is pivoted into one flat table that keeps the parent link. Triples come in the order
of the record, so an element's are complete when the stream leaves it: the pivot runs in the stream, nothing is
shuffled, and only the elements that are open are held. Columns that are nested by type need no parsing; their
elements are made by the same rule in the JVM, from the schema.

A path is written with ``[]`` for an array step and ``{}`` for a step into an object that is used as
a map (its keys are data, e.g. section numbers). ``ords`` holds one position (from 0) per such step.
The key of a map entry comes out as the leaf ``@key``. Every container and every null is a triple too,
so an element all of whose fields are null still exists and positions never shift.

Which tables and columns there are is read from the data (``inventory``, ``group_table`` without columns): no field is
lost because nobody named it.

Defined results: a null or blank record gives nothing; a malformed one gives the single triple or element
``$error``; a null array element keeps its position and gives no row in a flat table; empty arrays and absent parts
give no rows; of a key that is repeated in one object the last value counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

_TOKEN = re.compile(
    r'[ \t\r\n]*(?:([{}\[\],:])|("(?:[^"\\]|\\.)*")|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))', re.S
)
#: Keys of an object used as a map: section numbers such as 3, 3.2.1, A, A.4.
SECTION_KEYS = r"(?:\d+|[A-Z])(?:\.\d+)*"

Triple = tuple[str, list[int], str, "str | None"]


def _text(token: str) -> str:
    return json.loads(token, strict=False) if "\\" in token else token[1:-1]


def stream_triples(text: str, map_keys: re.Pattern[str] | None = None) -> Iterator[Triple]:
    """(path, ords, kind, value) of one JSON text, in document order, without building a tree.

    kind is object, array, string, number, boolean or null. Raises ValueError on malformed text.
    """
    path, ords = "$", []
    stack: list[list] = []  # [kind, path, depth of ords, next position]
    pos, expect = 0, "value"
    size = len(text.rstrip())
    while pos < size:
        m = _TOKEN.match(text, pos)
        if not m:
            raise ValueError(f"no token at {pos}")
        pos = m.end()
        mark, string, scalar = m.groups()
        if expect == "end":
            raise ValueError("text after the value")
        if expect in ("key", "key or }"):
            if mark == "}" and expect == "key or }":
                stack.pop()
                expect = "next" if stack else "end"
                continue
            if string is None:
                raise ValueError("no key")
            key, frame = _text(string), stack[-1]
            del ords[frame[2] :]
            if map_keys is not None and map_keys.fullmatch(key):
                path = frame[1] + "{}"
                ords.append(frame[3])
                yield path + ".@key", list(ords), "string", key
            else:
                path = f"{frame[1]}.{key}"
            frame[3] += 1
            expect = ":"
            continue
        if expect == ":":
            if mark != ":":
                raise ValueError("no colon")
            expect = "value"
            continue
        if expect == "next":
            frame = stack[-1]
            if mark == ",":
                expect = "key" if frame[0] == "object" else "element"
                continue
            if mark != ("}" if frame[0] == "object" else "]"):
                raise ValueError("no comma")
            stack.pop()
            expect = "next" if stack else "end"
            continue
        if expect in ("element", "element or ]"):
            frame = stack[-1]
            if mark == "]" and expect == "element or ]":
                stack.pop()
                expect = "next" if stack else "end"
                continue
            del ords[frame[2] :]
            ords.append(frame[3])
            frame[3] += 1
            path = frame[1] + "[]"
        if mark == "{":
            yield path, list(ords), "object", None
            stack.append(["object", path, len(ords), 0])
            expect = "key or }"
            continue
        if mark == "[":
            yield path, list(ords), "array", None
            stack.append(["array", path, len(ords), 0])
            expect = "element or ]"
            continue
        if mark is not None:
            raise ValueError(f"unexpected {mark}")
        if string is not None:
            yield path, list(ords), "string", _text(string)
        elif scalar == "null":
            yield path, list(ords), "null", None
        else:
            yield path, list(ords), "boolean" if scalar in ("true", "false") else "number", scalar
        expect = "next" if stack else "end"
    if expect != "end" and size:
        raise ValueError("cut off")


LARGE = 1 << 20  # characters of a record that is checked before it is streamed, instead of being held until its end
ROWS = 50_000


def whole(text: str, map_keys: re.Pattern[str] | None) -> Iterator[Triple]:
    """The triples of a record, or the one triple ``$error`` if it is malformed anywhere."""
    try:
        if len(text) <= LARGE:
            return iter(list(stream_triples(text, map_keys)))
        for _ in stream_triples(text, map_keys):
            pass
        return stream_triples(text, map_keys)
    except (ValueError, RecursionError):
        return iter([("$error", [], "error", text[:200])])


def split_path(path: str) -> tuple[str, str]:
    """(ancestor, leaf): the nearest repeated step of the path, $ for none, and what is below it."""
    at = max(path.rfind("[]"), path.rfind("{}"))
    return ("$", path[2:]) if at < 0 else (path[: at + 2], path[at + 3 :])


def stream_elements(triples: Iterator[Triple]) -> Iterator[tuple[str, list[int], bool, dict[str, str | None]]]:
    """(ancestor, ords, present, values) of every element, and of the record itself as ``$``, when the stream leaves it.

    ``present`` is false for a null element; ``values`` has every leaf that is a value or null.
    """
    places: dict[str, tuple[str, str]] = {}
    open_: list[tuple[str, list[int], list[bool], dict[str, str | None]]] = []
    for path, ords, kind, value in triples:
        if kind == "error":
            yield "$error", [], False, {"": value}
            continue
        ancestor, leaf = places.get(path) or places.setdefault(path, split_path(path))
        while open_ and open_[-1][1] != ords[: len(open_[-1][1])] or open_ and not ancestor.startswith(open_[-1][0]):
            a, o, p, v = open_.pop()
            yield a, o, p[0], v
        if not open_ or open_[-1][0] != ancestor:
            open_.append((ancestor, ords, [True], {}))
        if leaf == "" and kind == "null":
            open_[-1][2][0] = False
        elif kind not in ("object", "array"):
            open_[-1][3][leaf] = value
    for a, o, p, v in reversed(open_):
        yield a, o, p[0], v


def _records(df: DataFrame, key: str, doc: str) -> DataFrame:
    """Other columns are left behind, so clashing names do no harm."""
    return df.select(F.col(key).cast("string").alias("rec_key"), F.col(doc).cast("string").alias("doc"))


def _stream(make, names: list[str], types: list[pa.DataType]):
    """A mapInArrow function: the rows that ``make`` gives of each text, sent on every ``ROWS`` rows, also inside a record."""

    def batch(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for b in batches:
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text is None or not text.strip():
                    continue
                for row in make(text):
                    out.append((k, *row))
                    if len(out) >= ROWS:
                        yield batch(out)
                        out = []
        yield batch(out)

    return run


def shred(df: DataFrame, key: str, doc: str, map_keys: str | None = None) -> DataFrame:
    """Triples (rec_key, path, ords, kind, value) of the JSON texts in column ``doc``, keyed by ``key``. Narrow: no shuffle."""
    pattern = re.compile(map_keys) if map_keys else None
    types = [pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.string()]
    run = _stream(lambda text: whole(text, pattern), ["rec_key", "path", "ords", "kind", "value"], types)
    return _records(df, key, doc).mapInArrow(run, "rec_key string, path string, ords array<int>, kind string, value string")


def elements(df: DataFrame, key: str, doc: str, map_keys: str | None = None) -> DataFrame:
    """Elements (rec_key, ancestor, ords, present, values) of the JSON texts in column ``doc``. Narrow: no shuffle."""
    pattern = re.compile(map_keys) if map_keys else None
    types = [pa.string(), pa.string(), pa.list_(pa.int32()), pa.bool_(), pa.map_(pa.string(), pa.string())]

    def make(text: str) -> Iterator[tuple]:
        return ((a, o, p, list(v.items())) for a, o, p, v in stream_elements(whole(text, pattern)))

    run = _stream(make, ["rec_key", "ancestor", "ords", "present", "values"], types)
    return _records(df, key, doc).mapInArrow(run, "rec_key string, ancestor string, ords array<int>, present boolean, values map<string,string>")


_ELEMENTS = "array<struct<ancestor:string,ords:array<int>,present:boolean,values:map<string,string>>>"


def _leaves(x: Column, kind: DataType, path: list[str]) -> list[tuple[str, Column]]:
    """The values below ``x`` that are not repeated."""
    if isinstance(kind, StructType):
        return [v for f in kind.fields for v in _leaves(x[f.name], f.dataType, [*path, f.name])]
    return [] if isinstance(kind, (ArrayType, MapType)) else [(".".join(path), x.cast("string"))]


def _element(path: str, ords: Column, present: Column, leaves: list[tuple[str, Column]]) -> Column:
    values = F.create_map(*[c for name, v in leaves for c in (F.lit(name), v)]).cast("map<string,string>")
    return F.struct(F.lit(path).alias("ancestor"), ords.alias("ords"), present.alias("present"), values.alias("values"))


def _repeated(x: Column, kind: DataType, path: str, ords: Column) -> list[Column]:
    """An array of elements for each repeated step below ``x``."""
    if isinstance(kind, StructType):
        return [a for f in kind.fields for a in _repeated(x[f.name], f.dataType, f"{path}.{f.name}", ords)]
    if isinstance(kind, ArrayType):
        step, entries, inner = f"{path}[]", x, kind.elementType
        key, value = (lambda e: []), (lambda e: e)
    elif isinstance(kind, MapType):
        step, entries, inner = path + "{}", F.map_entries(x), kind.valueType
        key, value = (lambda e: [("@key", e["key"].cast("string"))]), (lambda e: e["value"])
    else:
        return []
    at = lambda i: F.concat(ords, F.array(i))
    own = F.transform(entries, lambda e, i: _element(step, at(i), value(e).isNotNull(), key(e) + _leaves(value(e), inner, [])))
    out = [own]
    if _repeated(x, inner, step, ords):
        out.append(F.flatten(F.transform(entries, lambda e, i: F.concat(*_repeated(value(e), inner, step, at(i))))))
    return [F.coalesce(a, F.array().cast(_ELEMENTS)) for a in out]


def typed_elements(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """The same elements of nested columns {name: column}, made in the JVM from their types. Narrow: no shuffle."""
    kinds = df.select(*[F.col(c).alias(n) for n, c in columns.items()]).schema
    none = F.array().cast("array<int>")
    parts = [a for f in kinds.fields for a in _repeated(F.col(columns[f.name]), f.dataType, f"$.{f.name}", none)]
    own = _element("$", none, F.lit(True), [v for f in kinds.fields for v in _leaves(F.col(columns[f.name]), f.dataType, [f.name])])
    return df.select(F.col(key).cast("string").alias("rec_key"), F.explode(F.concat(F.array(own).cast(_ELEMENTS), *parts)).alias("e")).select("rec_key", "e.*")


def with_ancestor(triples: DataFrame) -> DataFrame:
    """Adds ``ancestor``, the nearest repeated step of the path ($ for none), and ``leaf`` below it."""
    anc = F.regexp_extract("path", r"^(.*(?:\[\]|\{\}))", 1)
    anc = F.when(anc == "", F.lit("$")).otherwise(anc)
    return triples.withColumn("ancestor", anc).withColumn(
        "leaf", F.regexp_replace(F.expr("substr(path, length(ancestor) + 1)"), r"^\.", "")
    )


def path_groups(triples: DataFrame) -> DataFrame:
    """The tables a set of triples falls into: one row per repeated ancestor and leaf, with counts."""
    return (
        with_ancestor(triples)
        .groupBy("ancestor", "leaf", "kind")
        .agg(F.count("*").alias("n_values"), F.approx_count_distinct("rec_key").alias("n_records"))
    )


def inventory(elems: DataFrame) -> DataFrame:
    """(ancestor, leaf, n_elements, n_values): the tables and columns that a set of elements falls into."""
    per = elems.where("present").select("ancestor", F.explode_outer("values").alias("leaf", "value"))
    return per.groupBy("ancestor", "leaf").agg(F.count("*").alias("n_elements"), F.count("value").alias("n_values"))


def group_table(elems: DataFrame, ancestor: str, columns: dict[str, str] | None = None) -> DataFrame:
    """The flat table of one repeated ancestor: rec_key, parent_ords (empty at the top), pos and a column for each leaf.

    ``columns`` names the wanted ones as {column: leaf}; without it every leaf that occurs is a column, which takes one
    pass over the leaf names.
    """
    rows = elems.where((F.col("ancestor") == ancestor) & F.col("present"))
    if columns is None:
        found = sorted(r[0] for r in rows.select(F.explode(F.map_keys("values"))).distinct().collect())  # schema, not data
        columns = {}
        for leaf in found:
            name = re.sub(r"\W", "_", leaf) or "value"
            while name in columns or name in ("rec_key", "parent_ords", "pos"):
                name += "_"
            columns[name] = leaf
    return rows.select(
        "rec_key",
        F.expr("array_join(slice(ords, 1, size(ords) - 1), '/')").alias("parent_ords"),
        F.try_element_at("ords", F.lit(-1)).alias("pos"),
        *[F.col("values")[leaf].alias(n) for n, leaf in columns.items()],
    )


def latest_records(df: DataFrame, key: str, order: str, doc: Column) -> DataFrame:
    """One (rec_id, doc) per key: the record with the latest ``order``; of equals the greatest text.

    A null ``order`` is earlier than any. If the latest record is null the key gives no triples.
    """
    return (
        df.select(F.col(key).alias("rec_id"), F.struct(F.col(order).alias("o"), doc.alias("doc")).alias("r"))
        .groupBy("rec_id")
        .agg(F.max("r").alias("r"))
        .select("rec_id", F.col("r.doc").alias("doc"))
    )


def chunk_elements(chunks: DataFrame) -> DataFrame:
    """All elements of the nested parts of chunks, one pass."""
    recs = latest_records(chunks, "chunk_id", "created_at", F.struct("crus", "traceability"))
    return typed_elements(recs, "rec_id", {"crus": "doc.crus", "traceability": "doc.traceability"})


def skeleton_elements(skeletons: DataFrame) -> DataFrame:
    recs = latest_records(skeletons, "doc_id", "generated_at", F.col("document_skeleton"))
    return elements(recs, "rec_id", "doc", SECTION_KEYS)


def skeleton_sections(skeletons: DataFrame) -> DataFrame:
    """Flat sections of the latest outline of each document, whatever the layout of its JSON.

    A section is an entry of a map of section numbers, or an array element with a section_path.
    """
    v = F.col("values")
    own = F.coalesce(v["section_path"], v["@key"])
    return skeleton_elements(skeletons).where((F.col("ancestor") != "$") & F.col("present") & own.isNotNull()).select(
        F.col("rec_key").alias("doc_id"),
        own.alias("section_path"),
        F.size(F.split(own, r"\.")).alias("depth"),
        F.regexp_extract(own, r"^(.*)\.[^.]+$", 1).alias("parent_path"),
        F.element_at("ords", -1).alias("pos"),
        v["title"].alias("title"),
        F.expr("try_cast(values['page'] as int)").alias("page"),
        F.expr("try_cast(values['level'] as int)").alias("level"),
        v["section_semantic_type"].alias("section_semantic_type"),
        F.expr("try_cast(values['toc_confirmed'] as boolean)").alias("toc_confirmed"),
        F.expr("try_cast(values['body_confirmed'] as boolean)").alias("body_confirmed"),
    )


def nested_found(chunks: DataFrame, skeletons: DataFrame) -> DataFrame:
    """p1_found: (child_table, parent_key, pos, child_key), one row per element."""
    tables = {
        "$.crus[]": "chunk_crus",
        "$.crus[].acceptance_criteria[]": "cru_criteria",
        "$.crus[].acceptance_criteria[].evidence[]": "criterion_evidence",
        "$.traceability.source_requirements[]": "chunk_requirements",
        "$.traceability.sections[]": "chunk_sections",
        "$.traceability.doc_ids[]": "chunk_docs",
        "$.traceability.source_locators[]": "chunk_locators",
    }
    child = F.create_map(*[F.lit(x) for kv in tables.items() for x in kv])
    e = chunk_elements(chunks).where(F.col("present") & F.col("ancestor").isin(list(tables)))
    v = F.col("values")
    part = lambda leaf: F.coalesce(v[leaf], F.lit(""))
    t = child[F.col("ancestor")]
    chunk_rows = e.select(
        t.alias("child_table"),
        F.concat_ws("/", "rec_key", F.expr("transform(slice(ords, 1, size(ords) - 1), x -> cast(x as string))")).alias("parent_key"),
        F.element_at("ords", -1).alias("pos"),
        F.when(t == "chunk_crus", part("cru_id")).when(t == "cru_criteria", part("criterion"))
        .when(t.isin("criterion_evidence", "chunk_locators"), F.concat(part("page"), F.lit(":"), part("para"))).otherwise(part("")).alias("child_key"),
    )
    sections = skeleton_sections(skeletons).select(
        F.lit("skeleton_sections").alias("child_table"),
        F.col("doc_id").alias("parent_key"),
        F.col("depth").alias("pos"),
        F.col("section_path").alias("child_key"),
    )
    return chunk_rows.unionByName(sections.distinct())
