"""Column expressions shared by the native operators."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once for each row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; a text of ASCII alone takes the faster built-in."""
    plain = F.char_length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def text_key(text: Column) -> Column:
    """Tells rows with the same doc_id and other texts apart; null is the empty text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
