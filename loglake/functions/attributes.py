"""Flat attribute objects.

Two columns come out of one object: ``attributes``, a map of texts that filters
compare with, and ``attributes_json``, the typed form for output.

Most objects are *plain*: no member needs anything but the built-in casts,
which stay in generated code.  The others (exponents, very long numbers, and
members that are not scalars at all) go through higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .variants import as_members, kind, quoted, scalar_text


def is_plain(schema: str, json: str) -> str:
    """True when the built-in casts give the exact texts of a flat object.

    Looks at the object's schema and JSON text as a whole.  A key or text that
    only looks like one of these signs costs time, not correctness.
    """
    members = f"substr({schema}, {len('OBJECT<') + 1})"
    return (
        f"{schema} LIKE 'OBJECT<%' AND NOT {members} RLIKE 'DOUBLE|VOID|ARRAY<|OBJECT<'"
        f" AND NOT {json} RLIKE '[0-9.]{{16}}'"
    )


def plain_text_map(attributes: str) -> str:
    return f"try_variant_get({attributes}, '$', 'map<string,string>')"


def is_flat(members: str) -> str:
    """True when every member is a string, number or boolean."""
    return f"forall(map_values({members}), v -> NOT {kind('v')} RLIKE '^(VOID|OBJECT<|ARRAY<)')"


def has_infinity(attributes: str) -> str:
    """True when a number lies beyond the range of a double; false for no object."""
    vast = f"{kind('v')} = 'DOUBLE' AND abs(try_variant_get(v, '$', 'double')) = double('Infinity')"
    return f"coalesce(exists(map_values({as_members(attributes)}), v -> {vast}), false)"


def text_map(members: str) -> str:
    return f"transform_values({members}, (key, v) -> {scalar_text('v')})"


def json_text(members: str, texts: str) -> str:
    """The object as JSON, with numbers as in its text map."""
    value = f"""CASE WHEN {kind('e.value')} = 'STRING' THEN to_json(e.value)
        ELSE coalesce(try_element_at({texts}, e.key), 'null') END"""
    listed = f"transform(map_entries({members}), e -> concat({quoted('e.key')}, ':', {value}))"
    return f"concat('{{', array_join({listed}, ','), '}}')"


def with_attributes(rows: DataFrame, attributes: Column) -> DataFrame:
    """Add both columns for a VARIANT already known to be a flat object."""
    plain = is_plain("_schema", "_json")
    return (
        rows.withColumn("_object", attributes)
        .selectExpr("*", f"{kind('_object')} AS _schema", "to_json(_object) AS _json")
        .selectExpr("*", f"{plain} AS _plain", f"CASE WHEN NOT ({plain}) THEN {as_members('_object')} END AS _members")
        .selectExpr("*", f"CASE WHEN _plain THEN {plain_text_map('_object')} ELSE {text_map('_members')} END AS attributes")
        .selectExpr("*", f"CASE WHEN _plain THEN _json ELSE {json_text('_members', 'attributes')} END AS attributes_json")
        .drop("_object", "_schema", "_json", "_plain", "_members")
    )


def attribute_equals(attributes: Column, key: str, value: str) -> Column:
    """Exact text equality: the number 3 and the string "3" are both ``3``."""
    return F.coalesce(F.try_element_at(attributes, F.lit(key)) == F.lit(value), F.lit(False))
