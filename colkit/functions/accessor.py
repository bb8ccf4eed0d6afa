"""Two facades over the text functions: ``text`` falls back to Python, ``text_strict`` never does."""

from __future__ import annotations

from pyspark.sql import Column

from .text import NATIVE
from .text_fallback import CLASSES, FALLBACK, is_exact, replace_regex, translate


class TextStrict:
    """Functions that are Catalyst expressions; any other name is an ``AttributeError``."""

    def __init__(self, column: Column):
        if not isinstance(column, Column):
            raise AttributeError("only columns have text functions")
        self._column = column

    def __getattr__(self, name: str):
        func = self._find(name)
        if func is None:
            raise AttributeError(f"no text function {name!r}")
        return lambda *args, **kwargs: func(self._column, *args, **kwargs)

    def _find(self, name: str):
        return NATIVE.get(name)


class Text(TextStrict):
    """As ``TextStrict``; where Spark has no expression, Arrow-batched Python is used.

    Character classes (``isalpha`` and its kin) are expressions, which follow Python within Latin-1; with ``exact=True`` they follow
    Python's tables for all of Unicode.
    """

    def _find(self, name: str):
        if name in CLASSES:
            return lambda s, exact=False: is_exact(s, name) if exact else (NATIVE.get(name) or FALLBACK[name])(s)
        return NATIVE.get(name) or FALLBACK.get(name)

    def replace(self, pat: str, repl: str, n: int = -1, case: bool = True, regex: bool = False) -> Column:
        if n > 0 and (regex or not case):
            import re

            return replace_regex(self._column, pat if regex else re.escape(pat), repl if regex else repl.replace("\\", "\\\\"), n, case)
        return NATIVE["replace"](self._column, pat, repl, n, case, regex)

    def translate(self, table: dict) -> Column:
        try:
            return NATIVE["translate"](self._column, table)
        except NotImplementedError:
            return translate(self._column, table)


def text(column: Column) -> Text:
    return Text(column)


def text_strict(column: Column) -> TextStrict:
    return TextStrict(column)
