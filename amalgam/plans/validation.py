"""Validation of projected fields against their declared types."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from .projection import Field, compile_fields, is_number, project


class ValidationError(ValueError):
    def __init__(self, errors: list[str]):
        self.errors = errors
        super().__init__("; ".join(errors))


def _name(kind: S.DataType, value: Column) -> Column:
    """What the type of a value is called in messages."""
    if is_number(kind):
        return F.when(value == F.floor(value), "int").otherwise("float")
    for types, name in (((S.StringType,), "str"), ((S.BooleanType,), "bool"), ((S.ArrayType,), "list"), ((S.StructType, S.MapType), "dict")):
        if isinstance(kind, types):
            return F.lit(name)
    return F.lit("int")


def _fits(declared: str, kind: S.DataType, value: Column) -> Column:
    """Whether a value is of a declared scalar type; unknown names fit all."""
    whole = isinstance(kind, (S.IntegerType, S.LongType, S.ShortType))
    known = {
        "string": F.lit(isinstance(kind, S.StringType)),
        "number": F.lit(whole or is_number(kind)),
        "integer": value == F.floor(value) if is_number(kind) else F.lit(whole),
        "boolean": F.lit(isinstance(kind, S.BooleanType)),
        "object": F.lit(isinstance(kind, (S.StructType, S.MapType))),
    }
    return known.get(declared, F.lit(True))


def check(f: Field, omitted: Column) -> Column:
    """The first error of a field, null if there is none. Optional nulls are fine."""
    label, declared = f"field '{f.key}", f.declared
    wrong = F.concat(F.lit(f"{label}' should be {declared} but is "), _name(f.kind, f.value))
    if declared.endswith("[]"):
        inner = declared[:-2]
        if isinstance(f.kind, S.ArrayType):
            item = f.kind.elementType
            bad = F.array_position(F.transform(f.value, lambda x: ~_fits(inner, item, x)), True)
            type_error = F.when(bad > 0, F.concat(F.lit(f"{label}["), (bad - 1).cast("string"), F.lit(f"]' violates element type '{inner}'")))
        else:
            type_error = wrong
    else:
        type_error = F.when(~_fits(declared, f.kind, f.value), wrong)
    needed = F.lit(f.required)
    return (
        F.when(omitted, F.when(needed, f"required {label}' is missing"))
        .when(f.value.isNull(), F.when(needed, f"required {label}' is null"))
        .otherwise(type_error)
    )


def validate(profiles: DataFrame, config: dict) -> DataFrame:
    """project()'s columns with validation_errors, an array of texts. Fields count only where the configuration names them."""
    out = project(profiles, config)
    named = compile_fields(profiles.schema, config) if config.get("fields") else []
    omit = config.get("on_missing") == "omit"
    errors = F.array_compact(F.array(*[check(f, f.missing if omit and not f.required else F.lit(False)) for f in named])) if named else F.array()
    return out.withColumn("validation_errors", F.when(F.col("projection_error").isNotNull(), F.array("projection_error")).otherwise(errors.cast("array<string>")))


def validate_or_raise(profiles: DataFrame, config: dict) -> DataFrame:
    """validate(), but the first profile with errors raises ValidationError."""
    out = validate(profiles, config)
    bad = out.where(F.size("validation_errors") > 0).select("validation_errors").first()
    if bad:
        raise ValidationError(list(bad[0]))
    return out
