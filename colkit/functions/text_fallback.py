"""Text functions that Spark cannot express, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import re
import textwrap
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def elementwise(func: Callable, returns: str) -> Callable[[Column], Column]:
    """A pandas UDF that applies ``func`` to each text and leaves nulls alone."""

    @pandas_udf(returns)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else func(x) for x in s], dtype=object)

    return run


def casefold(s: Column) -> Column:
    return elementwise(str.casefold, "string")(s)


def title(s: Column) -> Column:
    return elementwise(str.title, "string")(s)


def istitle(s: Column) -> Column:
    return elementwise(str.istitle, "boolean")(s)


def normalize(s: Column, form: str) -> Column:
    """NFC, NFKC, NFD or NFKD."""
    unicodedata.normalize(form, "")
    return elementwise(lambda x: unicodedata.normalize(form, x), "string")(s)


def wrap(s: Column, width: int, **options) -> Column:
    return elementwise(lambda x: "\n".join(textwrap.wrap(x, width, **options)), "string")(s)


def translate(s: Column, table: dict) -> Column:
    """Characters may become several or none."""
    by_code = {(ord(k) if isinstance(k, str) else k): v for k, v in table.items()}
    return elementwise(lambda x: x.translate(by_code), "string")(s)


def replace_regex(s: Column, pat: str, repl: str, n: int = -1, case: bool = True, flags: int = 0) -> Column:
    """Python's ``re.sub`` with a limit."""
    compiled = re.compile(pat, flags | (0 if case else re.IGNORECASE))
    return elementwise(lambda x: compiled.sub(repl, x, count=max(n, 0)), "string")(s) if n else s


CLASSES = ("isalnum", "isalpha", "isdecimal", "isdigit", "islower", "isnumeric", "isspace", "istitle", "isupper")


def is_exact(s: Column, name: str) -> Column:
    """``str.isalpha`` and its kin by Python's own tables, for all of Unicode."""
    if name not in CLASSES:
        raise AttributeError(name)
    return elementwise(getattr(str, name), "boolean")(s)


FALLBACK = {"casefold": casefold, "title": title, "istitle": istitle, "normalize": normalize, "wrap": wrap}
