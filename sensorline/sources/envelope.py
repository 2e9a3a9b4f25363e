"""Nested records: fields of structs, arrays and JSON strings as flat columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_DEPTH, MOST_COLUMNS, MOST_ITEMS = 6, 64, 32


def _leaves(kind: T.DataType, path: str, column: Column, depth: int):
    if isinstance(kind, T.StructType) and depth < MOST_DEPTH:
        for f in kind.fields:
            yield from _leaves(f.dataType, f"{path}.{f.name}" if path else f.name, column[f.name], depth + 1)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        for i in range(MOST_ITEMS):
            yield f"{path}.{i}", column, i
    else:
        yield path, column, None


def leaf_names(schema: T.StructType) -> list[str]:
    """Dotted names of all fields, arrays as one."""
    return list(dict.fromkeys(n if item is None else n.rsplit(".", 1)[0] for f in schema.fields for n, _, item in _leaves(f.dataType, f.name, F.lit(None), 1)))


def json_object(text: Column) -> Column:
    """A JSON object's text as a variant; null for all else."""
    return F.try_parse_json(F.when(F.ltrim(text).startswith("{"), text))


def schema_of(text: str) -> T.DataType:
    """The type that schema_of_variant_agg tells: decimals (of numbers with a point) are doubles, fields without a type strings."""
    pieces = text.split("`")  # names in back quotes stay as they are
    for i in range(0, len(pieces), 2):
        plain = pieces[i].replace("OBJECT<", "STRUCT<")
        plain = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", plain)
        pieces[i] = re.sub(r"(?<![\w`])(VOID|VARIANT)(?!\w|:)", "STRING", plain)
    return T._parse_datatype_string("`".join(pieces))


def _ddl(kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "STRUCT<" + ", ".join(f"`{f.name.replace('`', '``')}`: {_ddl(f.dataType)}" for f in kind.fields) + ">"
    return f"ARRAY<{_ddl(kind.elementType)}>" if isinstance(kind, T.ArrayType) else kind.simpleString()


def json_schemas(frame: DataFrame, columns: list[str] | None = None, share: float = 0.9) -> dict[str, T.DataType]:
    """{column: type} of the string columns of which so many values (nulls aside) are JSON objects: one aggregate over all rows."""
    columns = columns or [f.name for f in frame.schema if isinstance(f.dataType, T.StringType)]
    if not columns:
        return {}
    figures = []
    for i, c in enumerate(columns):
        value = json_object(F.col(f"`{c}`"))
        figures += [F.try_divide(F.count(value), F.count(F.col(f"`{c}`"))).alias(f"share{i}"), F.when(F.count(value) > 0, F.schema_of_variant_agg(value)).alias(f"type{i}")]
    told = frame.agg(*figures).first()
    kinds = {c: schema_of(told[f"type{i}"]) for i, c in enumerate(columns) if told[f"type{i}"] and (told[f"share{i}"] or 0) >= share}
    return {c: k for c, k in kinds.items() if isinstance(k, T.StructType) and len(k)}


def parsed(frame: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    """JSON strings as structs: fields that a row does not have, or has of another type, are null, and so are rows that are no object."""
    value = {c: F.try_variant_get(json_object(F.col(f"`{c}`")), "$", _ddl(k)) for c, k in kinds.items()}
    return frame.select(*[value[c].alias(c) if c in value else F.col(f"`{c}`") for c in frame.columns])


def expansion(frame: DataFrame, focus: list[str] | None = None, most: int = MOST_COLUMNS) -> tuple[DataFrame, list[str]]:
    """Flat columns a.b for fields and a.0 ... for numbers of arrays, at most so many, focus fields first; and what was left out.

    Columns of JSON objects are opened like structs. Array items beyond the longest array do not count; arrays longer than MOST_ITEMS
    are left out from there, as a.32... Schemas and lengths are aggregates over the table, not a sample.
    """
    kinds = json_schemas(frame)
    frame = parsed(frame, kinds) if kinds else frame
    leaves = [leaf for f in frame.schema.fields for leaf in _leaves(f.dataType, f.name, F.col(f"`{f.name}`"), 1)]
    arrays = sorted({n.rsplit(".", 1)[0]: c for n, c, item in leaves if item == 0}.items())
    sizes = frame.agg(*[F.max(F.size(c)).alias(str(i)) for i, (_, c) in enumerate(arrays)]).first() if arrays else []
    longest = {n: size or 0 for (n, _), size in zip(arrays, sizes, strict=True)}
    kept = []
    for name, column, item in leaves:
        if item is None:
            kept.append((name, column))
        elif item < longest[name.rsplit(".", 1)[0]]:
            kept.append((name, F.get(column, F.lit(item))))
    wanted = [x for x in kept if focus and any(x[0] == f or x[0].startswith(f"{f}.") for f in focus)]
    rest = [x for x in kept if x not in wanted]
    chosen = (wanted + rest)[:most]
    names = {n for n, _ in chosen}
    left = [n for n, _ in kept if n not in names] + [f"{n}.{MOST_ITEMS}..." for n, size in longest.items() if size > MOST_ITEMS]
    return frame.select(*[c.alias(n) for n, c in chosen]), left


def expand(frame: DataFrame, focus: list[str] | None = None, most: int = MOST_COLUMNS) -> DataFrame:
    """``expansion`` without what was left out."""
    return expansion(frame, focus, most)[0]


def json_fields(frame: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Add columns {name: (path, type)} read from JSON strings; what is missing or of another type is null."""
    return frame.select("*", *[F.get_json_object(column, path).try_cast(kind).alias(name) for name, (path, kind) in fields.items()])


def time_fields(schema: T.StructType, most: int = 8) -> list[str]:
    """Dotted paths of number fields whose names speak of time."""
    found: list[str] = []

    def walk(kind: T.DataType, path: str, depth: int) -> None:
        if isinstance(kind, T.StructType) and depth < MOST_DEPTH:
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name, depth + 1)
        elif isinstance(kind, T.NumericType) and any(h in path.rsplit(".", 1)[-1].lower() for h in ("time", "stamp", "ts", "_ns", "_us", "_ms", "sec")):
            found.append(path)

    walk(schema, "", 0)
    return found[:most]
