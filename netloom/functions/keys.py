"""Normalised reference keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ref_key(c: Column | str) -> Column:
    """Key without leading and trailing spaces and tabs and without regard to case; NULL if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.upper(F.btrim(c, F.lit(" \t"))), F.lit(""))


def is_empty(c: Column | str) -> Column:
    """NULL or only white space."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.btrim(c, F.lit(" \t\r\n\f\u000b ")) == "")
