"""Checksum and range tests on a candidate value, as SQL snippets."""

from __future__ import annotations

from veilmark.functions.arrays import let, raw


def digits(value):
    return f"regexp_replace({value}, '[^0-9]', '')"


def _at(value, i):
    return f"try_cast(substring({value}, {i}, 1) AS int)"


def card_ok(value):
    return let("_d", digits(value), "length(_d) BETWEEN 13 AND 19 AND luhn_check(_d)")


def iban_ok(value):
    """Remainder 1 modulo 97 after moving the first four characters to the end."""
    moved = "concat(substring(_iban, 5, 64), substring(_iban, 1, 4))"
    step = (
        "CASE WHEN _ch BETWEEN '0' AND '9' THEN (_rem * 10 + ascii(_ch) - 48) % 97 "
        "ELSE (_rem * 100 + ascii(_ch) - 55) % 97 END"
    )
    fold = f"aggregate(split({moved}, ''), 0, (_rem, _ch) -> {step}) = 1"
    return let("_iban", f"upper(replace({value}, ' ', ''))", fold)


def ssn_ok(value):
    return (
        f"substring({value}, 1, 3) NOT IN ('000', '666') AND substring({value}, 1, 3) < '900' "
        f"AND substring({value}, 5, 2) <> '00' AND substring({value}, 8, 4) <> '0000'"
    )


def ip_ok(value):
    """Version 4: octets up to 255.  Version 6: at most seven groups if shortened."""
    octets = (
        f"forall(split({value}, {raw('[.]')}), "
        "_oct -> coalesce(try_cast(_oct AS int) <= 255, false))"
    )
    groups = f"size(filter(split({value}, ':'), _grp -> _grp <> ''))"
    return (
        f"CASE WHEN NOT contains({value}, ':') THEN {octets} "
        f"ELSE NOT contains({value}, '::') OR {groups} <= 7 END"
    )


def provider_ok(value):
    """Two letters and seven digits; the last one checks the first six."""
    odd = " + ".join(_at(value, i) for i in (3, 5, 7))
    even = " + ".join(_at(value, i) for i in (4, 6, 8))
    return f"coalesce(({odd} + 2 * ({even})) % 10 = {_at(value, 9)}, false)"


def has_digit(value):
    return f"rlike({value}, '[0-9]')"
