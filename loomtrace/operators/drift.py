"""Schemas that drift between files: one consistent table and a list of every change.

Each payload is read once, as a variant, into its shape: the map of its paths to their raw types. Shapes are few, so
path and type statistics by file are an aggregate of them. Each file is compared with the one before it, and typed
columns are projected with a report of every cast that failed and a column for what the catalogue does not know.
All of it runs in the JVM but the reading of a shape and the naming rule, which see one row per file and shape or field.

Defined results: a payload that cannot be parsed or is no object is unreadable and adds nothing to its
file; a file without any readable payload is no file; repeated lines count once; a field that is null
everywhere is there, but has no type, so it can neither be nor cause a retyping. Objects may be nested to any depth
that the JSON reader takes; a field in them is named parent.child.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.session import materialize

#: Names that mean a catalogue field but share no letters with it.
SYNONYMS = {"heading": "title", "caption": "title", "summary": "description", "role": "actor"}


def _tokens(name: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower())


def _shortens(short: str, tokens: list[str]) -> bool:
    """Whether ``short`` is made of prefixes (2 letters or more) of some of the tokens, in order."""
    if not short:
        return True
    for i, t in enumerate(tokens):
        for n in range(min(len(t), len(short)), 1, -1):
            if short.startswith(t[:n]) and _shortens(short[n:], tokens[i + 1 :]):
                return True
    return False


def _likeness(name: str, field: str, synonyms: dict[str, str]) -> float:
    """How well ``name`` fits the catalogue's leaf ``field``: 0 for not at all."""
    a, b = _tokens(name), _tokens(field)
    x, y = "".join(a), "".join(b)
    if x == y:
        return 3.0
    if synonyms.get(x) == field:
        return 2.5
    x1, y1 = x.removesuffix("s"), y.removesuffix("s")
    share = min(len(x), len(y)) / max(len(x), len(y))
    if x1 == y1:
        return 2.0 + share / 2
    if len(x1) >= 3 and len(y1) >= 3 and (_shortens(x, b) or _shortens(x1, b) or _shortens(y, a) or _shortens(y1, a)):
        return 1.0 + share
    common = 0
    while common < min(len(x), len(y)) and x[common] == y[common]:
        common += 1
    return 0.5 + share / 2 if common >= 5 and 2 * common >= min(len(x), len(y)) else 0.0


def resolve_name(name: str, catalogue: list[str], synonyms: dict[str, str] = SYNONYMS) -> str:
    """The catalogue field that ``name`` (parent.child for nested ones) stands for, or ``name`` itself.

    Only fields of the same parent are considered; of equally good ones the first by name is taken.
    """
    if name in catalogue:
        return name
    parent, _, leaf = name.rpartition(".")
    best, found = 0.0, name
    for field in sorted(catalogue):
        p, _, own = field.rpartition(".")
        if p == parent and (s := _likeness(leaf, own, synonyms)) > best:
            best, found = s, field
    return found


_TOKEN = re.compile(r"`((?:[^`]|``)*)`|(\w+)(?:\([\d, ]*\))?|([<>:,])")


RAW_TYPES = {"VOID": "null", "STRING": "string", "BOOLEAN": "boolean", "ARRAY": "array"}  # all others are numbers


def shape_fields(shape: str) -> list[tuple[str, str]]:
    """(field, raw type) of every leaf of a shape as ``schema_of_variant`` writes it; objects themselves are none."""
    tokens = [m.groups() for m in _TOKEN.finditer(shape)]
    out: list[tuple[str, str]] = []

    def after_brackets(i: int) -> int:
        depth = 0
        while True:
            depth += {"<": 1, ">": -1}.get(tokens[i][2], 0)
            i += 1
            if not depth:
                return i

    def read(i: int, path: list[str]) -> int:
        word = tokens[i][1]
        if word != "OBJECT":
            if path:
                out.append((".".join(path), RAW_TYPES.get(word, "number")))
            return after_brackets(i + 1) if i + 1 < len(tokens) and tokens[i + 1][2] == "<" else i + 1
        i += 2
        while tokens[i][2] != ">":
            if tokens[i][2] == ",":
                i += 1
            quoted, plain, _ = tokens[i]
            i = read(i + 2, [*path, plain or (quoted or "").replace("``", "`")])
        return i + 1

    read(0, [])
    return out


def raw_type(kind: Column) -> Column:
    """The raw type of a value from what ``schema_of_variant`` says of it."""
    return (
        F.when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.like("ARRAY<%"), "array")
        .when(kind.like("OBJECT<%"), "object").otherwise("number")
    )


def shapes(records: DataFrame, keep: list[Column | str], payload: str = "payload") -> DataFrame:
    """(keep..., shape, n): how often each shape of a readable payload occurs. One reading of each payload, partial aggregation."""
    shape = F.expr(f"schema_of_variant(try_parse_json(`{payload}`))")
    return records.select(*keep, shape.alias("shape")).where("shape like 'OBJECT<%'").groupBy(*keep, "shape").agg(F.count("*").alias("n"))


_leaves: dict[str, list[str]] = {}  # of the shapes a worker has seen


def fields_of(shape: str) -> Column:
    """The leaves of a shape as an array of (field, raw_type). Meant for one row per file and shape."""

    @F.pandas_udf("array<string>")
    def leaves(s: pd.Series) -> pd.Series:
        if len(_leaves) > 1 << 16:
            _leaves.clear()
        for x in s.unique():
            if x not in _leaves:
                _leaves[x] = [f"{t}:{f}" for f, t in shape_fields(x)]
        return s.map(_leaves)

    # A type holds no colon, so what follows the first one is the field.
    return F.transform(leaves(shape), lambda x: F.struct(F.substr(x, F.instr(x, ":") + 1).alias("field"), F.substring_index(x, ":", 1).alias("raw_type")))


def canonical(catalogue: dict[str, list[str]], synonyms: dict[str, str] = SYNONYMS):
    """A pandas UDF (kind, field) -> catalogue field or the name itself. Meant for one row per file and field."""

    @F.pandas_udf("string")
    def attr(kind: pd.Series, field: pd.Series) -> pd.Series:
        known: dict[tuple, str] = {}
        for k, f in set(zip(kind, field, strict=True)):
            known[k, f] = None if f is None else resolve_name(f, catalogue.get(k, []), synonyms)
        return pd.Series([known[kf] for kf in zip(kind, field, strict=True)], dtype="object")

    return attr


def catalogue_of(field_catalog: DataFrame) -> dict[str, list[str]]:
    """The agreed fields per record kind. The catalogue is a fixed table of some dozens of rows."""
    rows = field_catalog.select("record_kind", "field_name").distinct().collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["record_kind"], []).append(r["field_name"])
    return {k: sorted(v) for k, v in out.items()}


FILE = ["feed_id", "record_kind", "file_seq"]


def file_statistics(records: DataFrame, catalogue: dict[str, list[str]]) -> DataFrame:
    """(feed_id, record_kind, file_seq, file_name, field, attr, types, n_values): one row per file and field.

    A file some of whose payloads have no field at all has a row without a field, so that it is a file even if all are so.
    """
    leaves = shapes(records, [*FILE, "file_name"]).select(*FILE, "file_name", "n", F.explode_outer(fields_of("shape")).alias("f"))
    stats = leaves.groupBy(*FILE, F.col("f.field").alias("field")).agg(
        F.max("file_name").alias("file_name"),
        F.array_sort(F.collect_set(F.when(F.col("f.raw_type") != "null", F.col("f.raw_type")))).alias("types"),
        F.sum("n").alias("n_values"),
    )
    return stats.withColumn("attr", canonical(catalogue)("record_kind", "field"))


def changes(records: DataFrame, field_catalog: DataFrame) -> DataFrame:
    """p5_found: (file_name, field_name, change_kind) of each file against the one with the next lower file_seq."""
    # One row per file and field; written, since files, the newer and the older side all come from it.
    stats = materialize(file_statistics(records, catalogue_of(field_catalog)), "file-statistics")
    per_attr = stats.where("field is not null").groupBy(*FILE, "attr").agg(
        F.max("file_name").alias("file_name"),
        F.array_sort(F.collect_set("field")).alias("names"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"),
    )
    # The file before: statistics are one row per file and attribute, so the window is over files, not records.
    files = stats.groupBy(*FILE).agg(F.max("file_name").alias("file_name"))
    order = Window.partitionBy("feed_id", "record_kind").orderBy("file_seq")
    pairs = files.withColumn("before", F.lag("file_seq").over(order)).where("before is not null")
    new = per_attr.join(pairs.select(*FILE), FILE).select(*FILE, "attr", F.col("names").alias("new_names"), F.col("types").alias("new_types"))
    old = per_attr.withColumnRenamed("file_seq", "before").join(pairs.select(*FILE, "before"), ["feed_id", "record_kind", "before"])
    old = old.select(*FILE, "attr", F.col("names").alias("old_names"), F.col("types").alias("old_types"))
    none = F.array().cast("array<string>")
    both = (
        new.join(old, [*FILE, "attr"], "full_outer")
        .withColumns({c: F.coalesce(c, none) for c in ("new_names", "old_names", "new_types", "old_types")})
        .withColumn("came", F.array_except("new_names", "old_names"))
        .withColumn("went", F.array_except("old_names", "new_names"))
    )
    went_on = (F.size("new_names") > 0) & (F.size("old_names") > 0)
    renamed = went_on & (F.size("came") > 0) & (F.size("went") > 0)
    retyped = went_on & (F.size("new_types") > 0) & (F.size("old_types") > 0) & (F.col("new_types") != F.col("old_types"))
    change = lambda names, kind: F.transform(names, lambda n: F.struct(n.alias("field_name"), F.lit(kind).alias("change_kind")))
    nothing = F.array().cast("array<struct<field_name:string,change_kind:string>>")
    found = both.withColumn(
        "c",
        F.concat(
            F.when(renamed, change(F.col("came"), "renamed")).otherwise(
                F.concat(change(F.col("came"), "added"), change(F.col("went"), "removed"))
            ),
            F.when(retyped, change(F.col("new_names"), "retyped")).otherwise(nothing),
        ),
    )
    return (
        found.select(*FILE, F.explode("c").alias("c"))
        .join(files, FILE)
        .select("file_name", "c.field_name", "c.change_kind")
    )


def _names_by_attr(records: DataFrame, catalogue: dict[str, list[str]], kind: str) -> dict[str, list[str]]:
    """Every spelling of each catalogue field that occurs: schema, not data, so its size does not follow the rows."""
    seen = shapes(records.where(F.col("record_kind") == kind), ["record_kind"]).select("record_kind", F.explode(fields_of("shape")).alias("f"))
    seen = seen.select("record_kind", F.col("f.field").alias("field")).distinct()
    rows = seen.withColumn("attr", canonical(catalogue)("record_kind", "field")).where(F.col("attr").isin(catalogue.get(kind, []))).collect()
    out: dict[str, list[str]] = {}
    for r in rows:
        out.setdefault(r["attr"], []).append(r["field"])
    return {a: sorted(n, key=lambda x, a=a: (x != a, x)) for a, n in out.items()}


SPARK_TYPE = {"string": "string", "number": "double", "boolean": "boolean", "array": "array<string>"}


def _other_fields(names: dict[str, list[str]]) -> Column:
    """The fields of ``v0`` that no name of the catalogue stands for, as one map of path to value; null for none."""
    known = sorted({n for spellings in names.values() for n in spellings})
    parents = sorted({p for n in known for p in _ancestors(n)})
    empty = F.create_map().cast("map<string,variant>")

    def unknown(parent: str) -> Column:
        def name(k: Column) -> Column:
            return F.concat(F.lit(parent + "."), k) if parent else k

        def keep(k: Column, v: Column) -> Column:
            return ~name(k).isin(known) & ~(name(k).isin(parents) & F.schema_of_variant(v).like("OBJECT<%"))

        inside = F.expr(f"try_variant_get(v0, '{_path(parent)}', 'map<string,variant>')")
        return F.coalesce(F.transform_keys(F.map_filter(inside, keep), lambda k, _: name(k)), empty)

    parts = [unknown(p) for p in ["", *parents]]
    both = F.map_concat(*parts)
    return F.when(F.size(both) > 0, F.to_json(both))


def _ancestors(name: str) -> list[str]:
    parts = name.split(".")
    return [".".join(parts[:i]) for i in range(1, len(parts))]


def _path(name: str) -> str:
    return "$" + "".join(f'["{p}"]' for p in name.split(".") if name).replace("'", "\\'")


def _typed(records: DataFrame, field_catalog: DataFrame, kind: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    names = _names_by_attr(records, catalogue_of(field_catalog), kind)
    fields = sorted({(r["field_name"], r["json_type"]) for r in field_catalog.where(F.col("record_kind") == kind).collect()})
    base = records.where(F.col("record_kind") == kind).select("feed_id", "file_name", "file_seq", "line_no", "payload").distinct()
    base = base.withColumn("v0", F.expr("try_parse_json(payload)")).where("schema_of_variant(v0) like 'OBJECT<%'")
    cols = []
    for f, _ in fields:
        raw = [f"try_variant_get(v0, '{_path(n)}', 'variant')" for n in names.get(f, [])]
        present = [f"case when schema_of_variant({r}) <> 'VOID' then {r} end" for r in raw]
        v = f"coalesce({', '.join(present)}, null)" if present else "cast(null as variant)"
        cols.append(F.expr(v).alias(f"raw:{f}"))
    return base.select("feed_id", "file_name", "file_seq", "line_no", *cols, _other_fields(names).alias("other_fields")), fields


def consistent_table(records: DataFrame, field_catalog: DataFrame, kind: str) -> DataFrame:
    """All readable records of one kind in the shape of the catalogue; nested fields are named parent__child.

    Values whose raw type cannot be cast are null here and rows of ``failed_casts``; fields that the catalogue does not
    know are in ``other_fields``, a JSON object of path to value, null for none.
    """
    raw, fields = _typed(records, field_catalog, kind)
    return raw.select(
        "feed_id", "file_name", "file_seq", "line_no",
        *[F.expr(f"try_variant_get(`raw:{f}`, '$', '{SPARK_TYPE[t]}')").alias(f.replace(".", "__")) for f, t in fields],
        "other_fields",
    )


def failed_casts(records: DataFrame, field_catalog: DataFrame, kind: str) -> DataFrame:
    """(file_name, line_no, field_name, raw_type, json_type, raw_value): one row per value that the cast lost."""
    raw, fields = _typed(records, field_catalog, kind)
    cells = F.array(*[
        F.struct(
            F.lit(f).alias("field_name"),
            raw_type(F.expr(f"schema_of_variant(`raw:{f}`)")).alias("raw_type"),
            F.lit(t).alias("json_type"),
            F.expr(f"to_json(`raw:{f}`)").alias("raw_value"),
            F.expr(f"`raw:{f}` is not null and try_variant_get(`raw:{f}`, '$', '{SPARK_TYPE[t]}') is null").alias("lost"),
        )
        for f, t in fields
    ])
    return raw.select("file_name", "line_no", F.explode(cells).alias("c")).where("c.lost").select(
        "file_name", "line_no", "c.field_name", "c.raw_type", "c.json_type", "c.raw_value"
    )
