"""Projection: a configuration of wanted fields, compiled to columns over profiles."""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.values import HOOKS
from ..operators.resolve import number_text

SEGMENT = re.compile(r"([A-Za-z_]\w*)(\[(\d*)\])?")
#: Hooks that need text; the others leave other values alone.
TEXT_HOOKS = ("E164", "canonical")

#: The fields that are projected where a configuration names none.
DEFAULT_FIELDS = [
    {"path": "candidate_id", "type": "string", "required": True},
    {"path": "full_name", "type": "string"},
    {"path": "emails", "type": "string[]"},
    {"path": "phones", "type": "string[]"},
    {"path": "location", "type": "object"},
    {"path": "links", "type": "object"},
    {"path": "headline", "type": "string"},
    {"path": "years_experience", "type": "number"},
    {"path": "skills", "type": "object[]"},
    {"path": "experience", "type": "object[]"},
    {"path": "education", "type": "object[]"},
]


class ConfigError(ValueError):
    """A configuration that cannot be carried out on any profile."""


@dataclass
class Field:
    """A compiled field: its column (null where missing) and what decides about it."""

    key: str
    source: str
    base: str
    value: Column
    kind: S.DataType
    missing: Column
    required: bool
    declared: str


def _getter(name: str):
    return lambda x: x[name]


def resolve_path(schema: S.StructType, path: str) -> tuple[Column, S.DataType] | None:
    """The column and type of a path; None if no profile can have it.

    A segment is a name with an optional [n] (that item) or [] (the list itself); after
    a list, a name maps over its items, leaving out nulls.
    """
    node: Column | None = None
    kind: S.DataType = schema
    for segment in path.split("."):
        m = SEGMENT.fullmatch(segment)
        if not m:
            return None
        name, bracket, index = m.groups()
        if isinstance(kind, S.StructType) and name in kind.names:
            node = F.col(name) if node is None else node[name]
            kind = kind[name].dataType
        elif isinstance(kind, S.MapType):
            node, kind = F.try_element_at(node, F.lit(name)), kind.valueType
        elif isinstance(kind, S.ArrayType):
            item = kind.elementType
            known = isinstance(item, S.StructType) and name in item.names
            inner = item[name].dataType if known else S.StringType()
            node = F.array_compact(F.transform(node, _getter(name))) if known else F.array().cast(S.ArrayType(inner))
            kind = S.ArrayType(inner)
        else:
            return None
        if bracket:
            if not isinstance(kind, S.ArrayType):
                return None
            if index:
                node, kind = F.get(node, F.lit(int(index))), kind.elementType
    return node, kind


def _hooked(value: Column, kind: S.DataType, hook: str | None, key: str) -> tuple[Column, S.DataType]:
    if hook not in HOOKS:
        return value, kind
    item = kind.elementType if isinstance(kind, S.ArrayType) else kind
    if not isinstance(item, S.StringType):
        if hook in TEXT_HOOKS:
            raise ConfigError(f"field '{key}': '{hook}' needs text")
        return value, kind
    fn = HOOKS[hook]
    return (F.array_compact(F.transform(value, lambda x: fn(x))) if isinstance(kind, S.ArrayType) else fn(value)), kind


def _is_missing(value: Column, kind: S.DataType) -> Column:
    if isinstance(kind, S.ArrayType):
        return value.isNull() | (F.size(value) == 0)
    return value.isNull() | (value == "") if isinstance(kind, S.StringType) else value.isNull()


def compile_fields(schema: S.StructType, config: dict) -> list[Field]:
    out = []
    for spec in config.get("fields") or DEFAULT_FIELDS:
        key, source = spec["path"], spec.get("from", spec["path"])
        found = resolve_path(schema, source) or (F.lit(None).cast("string"), S.StringType())
        missing = _is_missing(*found)
        value, kind = _hooked(*found, spec.get("normalize"), key)
        out.append(Field(key, source, re.split(r"[.\[]", source, maxsplit=1)[0], F.when(~missing, value), kind, missing, bool(spec.get("required")), spec.get("type", "any")))
    return out


def is_number(kind: S.DataType) -> bool:
    return isinstance(kind, (S.DoubleType, S.FloatType))


def json_of(value: Column, kind: S.DataType, whole_numbers: bool = False) -> Column:
    """JSON text of a column; "null" for null. With whole_numbers, 12.0 is written 12."""
    if whole_numbers and is_number(kind):
        return F.coalesce(number_text(value), F.lit("null"))
    text = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(text, F.lit(2), F.length(text) - 2)


def quoted(key: str) -> Column:
    import json

    return F.lit(json.dumps(key, ensure_ascii=False) + ":")


def json_object(parts: list[Column]) -> Column:
    """An object of "key":value texts; null ones are left out."""
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def canonical_json(schema: S.StructType) -> Column:
    """The whole profile as JSON, in the order of its columns."""
    return json_object([F.concat(quoted(f.name), json_of(F.col(f.name), f.dataType, f.name == "years_experience")) for f in schema if f.name != "component"])


def project(profiles: DataFrame, config: dict) -> DataFrame:
    """profiles with output_json and projection_error; where there is an error, there is no output.

    A missing value is written as null, left out, or an error, as on_missing says; a
    required one is null unless it is an error.
    """
    schema, policy = profiles.schema, config.get("on_missing", "null")
    fields = compile_fields(schema, config)
    omitted = {id(f): f.missing if policy == "omit" and not f.required else F.lit(False) for f in fields}
    parts = [F.when(~omitted[id(f)], F.concat(quoted(f.key), json_of(f.value, f.kind, f.base == "years_experience"))) for f in fields]
    if config.get("include_confidence"):
        parts.append(F.concat(quoted("overall_confidence"), json_of(F.col("overall_confidence"), S.DoubleType())))
        each = [F.when(~f.missing, F.concat(quoted(f.key), F.to_json(F.array(F.try_element_at("field_confidence", F.lit(f.base)))))) for f in fields]
        each = [F.when(F.map_contains_key("field_confidence", F.lit(f.base)), F.regexp_replace(c, r"\[(.*)\]$", "$1")) for f, c in zip(fields, each, strict=True)]
        parts.append(F.concat(quoted("field_confidence"), json_object(each)))
    if config.get("include_provenance"):
        bases = F.array_compact(F.array(*[F.when(~omitted[id(f)], F.lit(f.base)) for f in fields]))
        kept = F.filter("provenance", lambda p: F.array_contains(bases, p["field"]))
        parts.append(F.concat(quoted("provenance"), json_of(kept, schema["provenance"].dataType)))
    error = F.lit(None).cast("string")
    if policy == "error":
        wrong = F.array_compact(F.array(*[F.when(f.missing, F.lit(f"missing value for '{f.key}' (from '{f.source}')")) for f in fields]))
        error = F.when(F.size(wrong) > 0, F.concat(F.lit("projection error: "), F.array_join(wrong, "; ")))
    return profiles.withColumns({"projection_error": error, "output_json": json_object(parts)}).withColumn("output_json", F.when(F.col("projection_error").isNull(), F.col("output_json")))
