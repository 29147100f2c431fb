"""The dynamically typed payload of a frame: JSON text, normalised where it enters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def kind(json: Column) -> Column:
    """empty, integer (32 bits, or a boolean), float, string, array or dictionary; null for what isn't JSON."""
    v = F.try_parse_json(json)
    name = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    whole = F.try_variant_get(v, "$", "bigint").between(INT_MIN, INT_MAX) & (number == F.floor(number)) & ~name.rlike("DECIMAL|DOUBLE|FLOAT")
    return (
        F.when(json.isNull() | (json == "") | (name == "VOID"), "empty")
        .when(v.isNull(), None)
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "dictionary")
        .when(name == "STRING", "string")
        .when((name == "BOOLEAN") | whole, "integer")
        .otherwise("float")
    )


def field(json: Column, path: str, type_: str = "bigint") -> Column:
    """A part of the payload; null if it is missing or of another type."""
    return F.try_variant_get(F.try_parse_json(json), path, type_)


def with_field(json: Column, name: str, value: Column) -> Column:
    """The payload, a JSON object or empty, with one string-keyed entry added or replaced."""
    old = F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: k != name), F.create_map(F.lit(name), value.cast("string"))))


def as_number(value: Column) -> Column:
    """What a number becomes: a 32-bit integer where it is one, else a double."""
    fits = (value == F.floor(value)) & value.between(INT_MIN, INT_MAX)
    return F.struct(F.when(fits, value.cast("int")).alias("i"), F.when(~fits, value.cast("double")).alias("f"))
