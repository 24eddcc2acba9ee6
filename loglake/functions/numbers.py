"""Text forms of JSON numbers, as SQL expressions.

JSON numbers are IEEE doubles.  Two text forms are needed: plain digits (what
an attribute filter compares with) and the shortest script form, which turns
to an exponent from 1e21 up and below 1e-6.
"""

from __future__ import annotations


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once and use it as ``name`` inside ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _with_digits(magnitude: str, body: str) -> str:
    """``body`` may use p.digits and p.point: the number is 0.digits x 10^point.

    The digits are the fewest that read back as the same double (numbers
    closer to zero than any normal double may show one digit more).
    """
    forms = ", ".join(f"format_string('%.{n}e', {magnitude})" for n in (14, 15, 16))
    shortest = f"element_at(filter(array({forms}), f -> try_cast(f AS double) = {magnitude}), 1)"
    parts = """named_struct(
        'digits', regexp_replace(replace(substring_index(t, 'e', 1), '.', ''), '0+$', ''),
        'point', int(substring_index(t, 'e', -1)) + 1)"""
    return let("t", shortest, let("p", parts, body))


_POSITIONAL = """CASE
    WHEN p.point >= length(p.digits) THEN rpad(p.digits, p.point, '0')
    WHEN p.point > 0 THEN concat(left(p.digits, p.point), '.', substr(p.digits, p.point + 1))
    ELSE concat('0.', repeat('0', -p.point), p.digits) END"""
_EXPONENT = """concat(
    left(p.digits, 1), if(length(p.digits) > 1, '.', ''), substr(p.digits, 2),
    if(p.point >= 1, 'e+', 'e-'), string(abs(p.point - 1)))"""


def plain_number_text(number: str) -> str:
    """Digits without exponent; NULL for a number too large for a double."""
    digits = _with_digits("abs(n)", _POSITIONAL)
    return let("n", number, f"""CASE
        WHEN n = 0 THEN '0'
        WHEN abs(n) < double('Infinity') THEN concat(if(n < 0, '-', ''), {digits}) END""")


def script_number_text(number: str) -> str:
    """Shortest script form, e.g. ``1e+21``, ``1e-7``, ``1.5``."""
    digits = _with_digits(
        "abs(n)", f"CASE WHEN p.point BETWEEN -5 AND 21 THEN {_POSITIONAL} ELSE {_EXPONENT} END"
    )
    magnitude = f"CASE WHEN abs(n) < double('Infinity') THEN {digits} ELSE 'Infinity' END"
    return let(
        "n", number, f"CASE WHEN n = 0 THEN '0' ELSE concat(if(n < 0, '-', ''), {magnitude}) END"
    )
