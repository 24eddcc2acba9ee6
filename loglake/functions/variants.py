"""Type tests and text forms of parsed JSON values, as SQL expressions."""

from __future__ import annotations

from .numbers import let, plain_number_text, script_number_text

# Pieces of compact JSON text: a string, a bracket or separator, a bare word.
_JSON_PIECE = r"""r'("(?:[^"\\]++|\\.)*+"|[\[\]{},:]|[^\[\]{},:"]+)'"""
_MAX_EXACT_INTEGER = 2 ** 53


def kind(value: str) -> str:
    """STRING, BOOLEAN, BIGINT, DECIMAL(p,s), DOUBLE, VOID, OBJECT<..>, ARRAY<..>."""
    return f"schema_of_variant({value})"


def as_text(value: str) -> str:
    return f"try_variant_get({value}, '$', 'string')"


def as_members(value: str) -> str:
    """An object's members; NULL for anything that is not an object."""
    return f"try_variant_get({value}, '$', 'map<string,variant>')"


def quoted(text: str) -> str:
    """A text as a JSON string literal."""
    return f"trim(LEADING '[' FROM left(to_json(array({text})), length(to_json(array({text}))) - 1))"


def scalar_text(value: str) -> str:
    """The text an attribute filter compares with."""
    integer = f"try_variant_get({value}, '$', 'bigint')"
    short = f"k = 'BIGINT' AND {integer} BETWEEN {-_MAX_EXACT_INTEGER} AND {_MAX_EXACT_INTEGER}"
    number = plain_number_text(f"try_variant_get({value}, '$', 'double')")
    return let("k", kind(value), f"""CASE
        WHEN k IN ('STRING', 'BOOLEAN') OR ({short}) THEN {as_text(value)} ELSE {number} END""")


def _joined_elements(value: str) -> str:
    """An array as comma-joined element texts.

    Nested arrays join into the same list, null is empty and an object is
    ``[object Object]``, so one pass over the JSON pieces is enough at any depth.
    """
    element = f"""CASE
        WHEN s.depth = 0 AND piece = '{{' THEN '[object Object]'
        WHEN s.depth > 0 OR piece IN ('[', ']', '}}', 'null') THEN ''
        WHEN piece LIKE '"%' THEN {as_text('try_parse_json(piece)')}
        WHEN piece IN (',', 'true', 'false') THEN piece
        ELSE {script_number_text('try_cast(piece AS double)')} END"""
    deeper = "CASE piece WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END"
    return f"""aggregate(
        regexp_extract_all(to_json({value}), {_JSON_PIECE}, 1),
        named_struct('text', '', 'depth', 0),
        (s, piece) -> named_struct('text', concat(s.text, {element}), 'depth', s.depth + {deeper}),
        s -> s.text)"""


def script_text(value: str) -> str:
    """Any JSON value as shown in a rejection reason."""
    return let("k", kind(value), f"""CASE
        WHEN k IS NULL THEN 'undefined'
        WHEN k = 'VOID' THEN 'null'
        WHEN k IN ('STRING', 'BOOLEAN') THEN {as_text(value)}
        WHEN k LIKE 'OBJECT<%' THEN '[object Object]'
        WHEN k LIKE 'ARRAY<%' THEN {_joined_elements(value)}
        ELSE {script_number_text(f"try_variant_get({value}, '$', 'double')")} END""")
