"""Placeholders that stand for values: ``⟦KIND:0A1B2C3D⟧`` for a value that can be restored, ``⟦KIND:REDACTED⟧`` else."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The written form of placeholders.
TOKEN = re.compile(r"⟦([A-Z0-9_]+):([0-9A-F]{8,64})⟧")
PLACEHOLDER = re.compile(r"⟦[A-Z0-9_]+:(?:[0-9A-F]{8,64}|REDACTED)⟧")
TOKEN_JAVA = "⟦[A-Z0-9_]+:[0-9A-F]{8,64}⟧"
PLACEHOLDER_JAVA = "⟦[A-Z0-9_]+:(?:[0-9A-F]{8,64}|REDACTED)⟧"
ID_LENGTH = 8
LONG_ID = 32  # for sessions of any size: ids of 8 digits clash once a session holds some ten thousand values of a kind


def pads(key: bytes) -> tuple[str, str]:
    """Inner and outer pad of HMAC-SHA-256 as hexadecimal digits; keys of at most 64 bytes."""
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block).hex(), bytes(b ^ 0x5C for b in block).hex()


def token_id(value: Column, inner: Column, outer: Column, length: int = ID_LENGTH) -> Column:
    """The first digits of HMAC-SHA-256 of a value; the pads are columns, so that no plan shows a key as a literal."""
    first = F.sha2(F.concat(F.unhex(inner), F.encode(value, "UTF-8")), 256)
    return F.substring(F.upper(F.sha2(F.concat(F.unhex(outer), F.unhex(first)), 256)), 1, length)


def token(kind: Column, identifier: Column) -> Column:
    return F.concat(F.lit("⟦"), F.upper(kind), F.lit(":"), identifier, F.lit("⟧"))


def redaction(kind: Column) -> Column:
    return F.concat(F.lit("⟦"), F.upper(kind), F.lit(":REDACTED⟧"))
