"""Checksums of formatted identifiers, as Column functions and, for Arrow UDFs, as Python functions.

Casts are tried, not forced: Spark may evaluate a cast before the pattern that guards it. Null gives false.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATORS = r"[\s.\-]"


def compact(value: Column) -> Column:
    """Without blanks, dots and dashes."""
    return F.regexp_replace(value, rf"(?U){_SEPARATORS}", "")


def luhn(value: Column) -> Column:
    return F.luhn_check(compact(value)) if hasattr(F, "luhn_check") else F.call_function("luhn_check", compact(value))


def payment_card(value: Column) -> Column:
    """Network prefix with a length it allows, then Luhn."""
    v = compact(value)
    n = F.length(v)
    four = F.substring(v, 1, 4).try_cast("int")
    network = (
        (v.startswith("4") & n.isin(13, 16, 19))
        | ((F.substring(v, 1, 2).try_cast("int").between(51, 55) | four.between(2221, 2720)) & (n == 16))
        | (F.substring(v, 1, 2).isin("34", "37") & (n == 15))
        | ((v.startswith("6011") | v.startswith("65") | F.substring(v, 1, 3).try_cast("int").between(644, 649)) & n.between(16, 19))
        | ((F.substring(v, 1, 3).try_cast("int").between(300, 305) | F.substring(v, 1, 2).isin("36", "38")) & n.between(14, 19))
        | (four.between(3528, 3589) & n.between(16, 19))
    )
    return F.coalesce(v.rlike("^[0-9]+$") & network & luhn(value), F.lit(False))


def iban(value: Column) -> Column:
    """The country and key moved to the end, letters as 10 to 35, must leave 1 modulo 97."""
    v = F.upper(compact(value))
    turned = F.split(F.concat(F.substring(v, 5, 64), F.substring(v, 1, 4)), "")
    digit = lambda c: F.when(c.rlike("^[0-9]$"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: F.when(c == "", acc).when(digit(c) > 9, (acc * 100 + digit(c)) % 97).otherwise((acc * 10 + digit(c)) % 97)
    return F.coalesce(v.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (F.aggregate(turned, F.lit(0), step) == 1), F.lit(False))


def nir(value: Column) -> Column:
    """French social security number: the key is 97 minus the body modulo 97."""
    v = compact(value)
    body = F.replace(F.replace(F.substring(v, 1, 13), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
    key = F.lit(97) - body.try_cast("bigint") % 97 == F.substring(v, 14, 2).try_cast("int")
    return F.coalesce(v.rlike("^[0-9]{5}(?:[0-9]{2}|2[AB])[0-9]{8}$") & key, F.lit(False))


def french_tax_number(value: Column) -> Column:
    """The last three digits are the first ten modulo 511."""
    v = compact(value)
    key = F.substring(v, 1, 10).try_cast("bigint") % 511 == F.substring(v, 11, 3).try_cast("int")
    return F.coalesce(v.rlike("^[0-9]{13}$") & key, F.lit(False))


# The same for Python strings, in Arrow UDFs.
def bare(value: str) -> str:
    return re.sub(_SEPARATORS, "", value)


def luhn_ok(value: str) -> bool:
    digits = [int(c) for c in bare(value) if c.isdigit()]
    doubled = (sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return bool(digits) and (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def payment_card_ok(value: str) -> bool:
    v = bare(value)
    n, two, three, four = len(v), int(v[:2] or 0), int(v[:3] or 0), int(v[:4] or 0)
    network = (
        v[0] == "4" and n in (13, 16, 19)
        or (51 <= two <= 55 or 2221 <= four <= 2720) and n == 16
        or two in (34, 37) and n == 15
        or (four == 6011 or two == 65 or 644 <= three <= 649) and 16 <= n <= 19
        or (300 <= three <= 305 or two in (36, 38)) and 14 <= n <= 19
        or 3528 <= four <= 3589 and 16 <= n <= 19
    )
    return network and luhn_ok(v)


def iban_ok(value: str) -> bool:
    v = bare(value).upper()
    return v.isalnum() and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def nir_ok(value: str) -> bool:
    v = bare(value)
    return 97 - int(v[:13].replace("2A", "19").replace("2B", "18")) % 97 == int(v[13:])


def french_tax_number_ok(value: str) -> bool:
    v = bare(value)
    return int(v[:10]) % 511 == int(v[10:])
