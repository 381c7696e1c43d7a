"""What must never be shown: values of sensitive keys, and values that look like secrets."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FLOAT, py_human_bytes, py_is_float

REDACTED = "<redacted>"
MAX_VALUE = 40

# The words that make a key sensitive, the marks of a secret in a value, and the scalars that are never one.
KEY_WORDS = "password passwd pass pwd secret secrets token apikey credential credentials auth authorization key keys privatekey signature salt session cookie dsn connection connectionstring".split()
VALUE_MARKS = ["password=", "passwd=", "pwd=", "secret=", "token=", "apikey=", "api_key="]
PLAIN = ["true", "false", "null", "nil", "none", "~", "yes", "no", "on", "off"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_USERINFO = r"^[^/?#@]*:[^/?#@]*@"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def is_sensitive_key(key: Column) -> Column:
    """A word of the key, split at camel case and at all but ASCII letters and digits, is in KEY_WORDS."""
    bare = F.regexp_replace(F.regexp_replace(key, r"(?U)^\s+|\s+$", ""), "^[\"']+|[\"']+$", "")
    words = F.split(ascii_lower(F.regexp_replace(bare, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})", "_")), "[^a-z0-9]")
    return F.arrays_overlap(words, F.array(*map(F.lit, KEY_WORDS)))


def value_looks_secret(value: Column) -> Column:
    """The value holds a mark like `password=`, or an address with a user and password before the host."""
    low = ascii_lower(value)
    after = F.when(F.locate("://", low) > 0, F.substring(low, F.locate("://", low) + 3, F.length(low))).otherwise("")
    return low.rlike("|".join(VALUE_MARKS)) | after.rlike(_USERINFO)


def is_plain(value: Column) -> Column:
    """Empty, a boolean or null word, or a number, quotes aside."""
    bare = F.regexp_replace(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), "^[\"']+|[\"']+$", "")
    low = ascii_lower(bare)
    return (bare == "") | low.isin(PLAIN) | low.rlike("^" + FLOAT + "$")


def must_redact(key: Column, value: Column) -> Column:
    return ~is_plain(value) & (F.coalesce(is_sensitive_key(key), F.lit(False)) | value_looks_secret(value))


# --- twins ---------------------------------------------------------------------------------------------------------------

_WORD_SPLIT = re.compile(r"[^a-z0-9]")
_SECRET_ADDRESS = re.compile(r"[^/?#@]*:[^/?#@]*@")
_TO_LOWER = str.maketrans(_UPPER, _LOWER)
_WORDS = frozenset(KEY_WORDS)


def _bare(s: str) -> str:
    return s.strip().strip("\"'")


def py_sensitive_key(key: str) -> bool:
    key = _bare(key)
    spaced = "".join(f"_{c}" if i and c.isupper() and (key[i - 1].islower() or key[i - 1].isnumeric()) else c for i, c in enumerate(key))
    return not _WORDS.isdisjoint(_WORD_SPLIT.split(spaced.translate(_TO_LOWER)))


def py_secret_value(value: str) -> bool:
    low = value.translate(_TO_LOWER)
    if any(m in low for m in VALUE_MARKS):
        return True
    _, found, rest = low.partition("://")
    return bool(found) and _SECRET_ADDRESS.match(rest) is not None


def py_plain(value: str) -> bool:
    bare = _bare(value)
    return not bare or bare.translate(_TO_LOWER) in PLAIN or py_is_float(bare)


def py_must_redact(key: str | None, value: str) -> bool:
    return not py_plain(value) and ((key is not None and py_sensitive_key(key)) or py_secret_value(value))


def py_shown(key: str | None, value: str, size: int | None = None) -> str:
    """The value, or what stands for it: <redacted>, or its size if it is long."""
    if py_must_redact(key, value):
        return REDACTED
    return f"<{py_human_bytes(len(value.encode()) if size is None else size)}>" if len(value) > MAX_VALUE else value
