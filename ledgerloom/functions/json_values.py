"""Parts of JSON texts: what kind a value is, how long a list is, and a member put in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_type(text: Column) -> Column:
    """object, array, string, number, boolean or null; missing for what is no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
        .when(kind.isNotNull(), "number")
    )


def json_length(text: Column) -> Column:
    """Members of a list; missing for everything else."""
    return F.when(json_type(text) == "array", F.json_array_length(text))


def json_set(text: Column, name: str, value: Column) -> Column:
    """An object with a member put in, or in place of one of that name; value is JSON. What is no object stays as it is."""
    members = F.map_filter(F.from_json(text, "map<string,variant>"), lambda k, _: k != name)
    put = F.create_map(F.lit(name), F.try_parse_json(value))
    return F.when(json_type(text) == "object", F.to_json(F.map_concat(members, put))).otherwise(text)
