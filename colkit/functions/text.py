"""Text functions as ``Column -> Column`` expressions.

All are Catalyst expressions: they stay in whole-stage code generation, need no Python worker and work on
streams.  Null gives null unless a function says otherwise.  Positions count code points from 0, as in Python.
"""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that Python's ``str.isspace`` accepts (fixed values).
PY_SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACE_CLASS = "".join(f"\\x{{{ord(c):x}}}" for c in PY_SPACE)


def literal(pat: str) -> str:
    """A regular expression that matches ``pat`` itself."""
    return re.sub(r"([\\.^$|?*+()\[\]{}\-&#~ ])", r"\\\1", pat) if pat else ""


def java_regex(pat: str, case: bool = True) -> str:
    """A Python pattern in the JVM's syntax: named groups, ``\\Z``, ``$`` Unicode classes, only line feeds end lines."""
    out, i, in_class = [], 0, False
    while i < len(pat):
        two = pat[i : i + 2]
        if two == "\\Z":
            out.append("\\z")
            i += 2
        elif pat[i] == "\\":
            out.append(two)
            i += 2
        elif pat.startswith("(?P<", i):
            out.append("(?<")
            i += 4
        elif m := re.match(r"\(\?P=(\w+)\)", pat[i:]):
            out.append(f"\\k<{m[1]}>")
            i += m.end()
        elif pat[i] == "$" and not in_class:
            out.append("(?=\\n?\\z)")
            i += 1
        else:
            in_class = (pat[i] == "[") or (in_class and pat[i] != "]")
            out.append(pat[i])
            i += 1
    return ("(?dU)" if case else "(?diuU)") + "".join(out)


def java_replacement(repl: str) -> str:
    """``\\1`` and ``\\g<name>`` become ``$1`` and ``${name}``; dollar signs are escaped."""
    repl = repl.replace("$", "\\$")
    repl = re.sub(r"\\g<(\d+)>", r"$\1", repl)
    repl = re.sub(r"\\g<(\w+)>", r"${\1}", repl)
    return re.sub(r"\\(\d)", r"$\1", repl)


def _known(s: Column, value: Column) -> Column:
    """``value`` where ``s`` is not null: for expressions that would turn null into a constant."""
    return F.when(s.isNotNull(), value)


def _sub(s: Column, start: Column | int, length: Column | int) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring(s, as_col(start), as_col(length))


# --- concatenation, search, counting -------------------------------------------------------------------------------


def cat(a: Column, b: Column) -> Column:
    """Both texts joined, null if either is."""
    return F.concat(a, b)


def contains(s: Column, pat: str, case: bool = True, regex: bool = False) -> Column:
    if regex:
        return s.rlike(java_regex(pat, case))
    if not case:
        return F.contains(F.upper(s), F.lit(pat.upper()))
    return _known(s, F.lit(True)) if pat == "" else F.contains(s, F.lit(pat))


def count(s: Column, pat: str, regex: bool = False) -> Column:
    """Occurrences that do not overlap; the empty literal pattern occurs once more than there are bytes."""
    if regex:
        return F.regexp_count(s, F.lit(java_regex(pat)))
    if pat == "":
        return F.octet_length(s) + 1
    return ((F.length(s) - F.length(F.replace(s, F.lit(pat), F.lit("")))) / len(pat)).cast("int")


def startswith(s: Column, pat: str) -> Column:
    return F.startswith(s, F.lit(pat))


def endswith(s: Column, pat: str) -> Column:
    return F.endswith(s, F.lit(pat))


def match(s: Column, pat: str, case: bool = True) -> Column:
    return s.rlike(java_regex(f"^(?:{pat})", case))


def fullmatch(s: Column, pat: str, case: bool = True) -> Column:
    return s.rlike(java_regex(f"^(?:{pat})\\Z", case))


def find(s: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    """Position of the first occurrence, -1 if there is none."""
    if start == 0 and end is None:
        return F.instr(s, sub) - 1
    part = slice_(s, start, end)
    low = F.greatest(F.length(s) + start, F.lit(0)) if start < 0 else F.lit(start)
    at = F.instr(part, sub) - 1
    return _known(s, F.when((at >= 0) & (low <= F.length(s)), at + low).otherwise(-1))


def rfind(s: Column, sub: str) -> Column:
    at = F.length(s) - len(sub) - F.instr(F.reverse(s), sub[::-1]) + 1
    return _known(s, F.when(F.contains(s, F.lit(sub)), at).otherwise(-1))


def _or_raise(s: Column, at: Column) -> Column:
    return F.when(at >= 0, at).when(s.isNotNull(), F.raise_error(F.lit("substring not found")).cast("int"))


def index(s: Column, sub: str) -> Column:
    """As ``find``; an absent substring is an error."""
    return _or_raise(s, find(s, sub))


def rindex(s: Column, sub: str) -> Column:
    return _or_raise(s, rfind(s, sub))


def findall(s: Column, pat: str) -> Column:
    """All matches; if the pattern has a group, the group's."""
    return F.regexp_extract_all(s, F.lit(java_regex(pat)), F.lit(min(1, re.compile(pat).groups)))


def extract(s: Column, pat: str) -> list[Column]:
    """A column per group, null where the pattern does not match or the group takes no part."""
    java, groups = java_regex(pat), re.compile(pat)
    names = {i: n for n, i in groups.groupindex.items()}
    out = []
    for i in range(1, groups.groups + 1):
        value = F.regexp_extract(s, java, i)
        hit = s.rlike(java)
        if not re.compile(pat).groups or not _can_be_empty(pat, i):
            value = F.nullif(value, F.lit(""))
        out.append(F.when(hit, value).alias(names.get(i, str(i - 1))))
    return out


def _can_be_empty(pat: str, group: int) -> bool:
    """Whether the text of a group can be empty; unknown counts as no."""
    depth, opened, body, start = 0, 0, None, []
    for i, c in enumerate(pat):
        if c == "\\" or (i and pat[i - 1] == "\\"):
            continue
        if c == "(":
            start.append(i if not pat.startswith("(?", i) or pat.startswith("(?P<", i) else None)
            if start[-1] is not None:
                opened += 1
                if opened == group:
                    depth = len(start)
        elif c == ")" and start:
            if len(start) == depth and body is None and start[-1] is not None:
                body = re.sub(r"^\?P<\w+>", "", pat[start[-1] + 1 : i])
            start.pop()
    try:
        return body is not None and re.fullmatch(body, "") is not None
    except re.error:
        return False


def extractall(s: Column, pat: str) -> Column:
    """An array of structs, one per match, with a field per group: for ``posexplode``."""
    java, groups = java_regex(pat), re.compile(pat).groups
    return F.arrays_zip(*[F.regexp_extract_all(s, F.lit(java), F.lit(i)).alias(f"g{i - 1}") for i in range(1, groups + 1)])


# --- replacing and stripping ----------------------------------------------------------------------------------------


def replace(s: Column, pat: str, repl: str, n: int = -1, case: bool = True, regex: bool = False) -> Column:
    """The first ``n`` occurrences (all if negative) from left to right.  The empty literal pattern occurs before each character and at the end."""
    if n == 0:
        return s
    if regex or not case:
        java = java_regex(pat if regex else re.escape(pat), case)
        new = java_replacement(repl) if regex else java_replacement(repl.replace("\\", "\\\\"))
        if n < 0:
            return F.regexp_replace(s, java, new)
        raise NotImplementedError("a limited number of regular-expression replacements: text_fallback.replace_regex")
    if pat == "":
        chars = F.filter(F.split(s, ""), lambda c: c != "")
        if n < 0:
            return _known(s, F.concat(F.lit(repl), F.array_join(F.transform(chars, lambda c: F.concat(c, F.lit(repl))), "")))
        k = F.least(F.length(s), F.lit(n))
        head = F.array_join(F.transform(F.slice(chars, 1, F.greatest(k, F.lit(0))), lambda c: F.concat(F.lit(repl), c)), "")
        return _known(s, F.concat(head, _sub(s, k + 1, F.length(s)), F.when(F.length(s) < n, F.lit(repl)).otherwise("")))
    if n < 0:
        return F.replace(s, F.lit(pat), F.lit(repl))
    return F.array_join(F.split(s, literal(pat), n + 1), repl)


def strip(s: Column, to_strip: str | None = None) -> Column:
    return F.btrim(s, F.lit(PY_SPACE if to_strip is None else to_strip))


def lstrip(s: Column, to_strip: str | None = None) -> Column:
    return F.ltrim(s, F.lit(PY_SPACE if to_strip is None else to_strip))


def rstrip(s: Column, to_strip: str | None = None) -> Column:
    return F.rtrim(s, F.lit(PY_SPACE if to_strip is None else to_strip))


def removeprefix(s: Column, prefix: str) -> Column:
    return F.when(F.startswith(s, F.lit(prefix)), _sub(s, len(prefix) + 1, F.length(s))).otherwise(s)


def removesuffix(s: Column, suffix: str) -> Column:
    return F.when(F.endswith(s, F.lit(suffix)) & F.lit(suffix != ""), _sub(s, 1, F.length(s) - len(suffix))).otherwise(s)


def translate(s: Column, table: dict) -> Column:
    """``table`` maps characters or code points to one character or None; others need the fallback."""
    pairs = {(k if isinstance(k, str) else chr(k)): ("" if v is None else v if isinstance(v, str) else chr(v)) for k, v in table.items()}
    if any(len(v) > 1 for v in pairs.values()):
        raise NotImplementedError("characters that become several: text_fallback.translate")
    keep = [k for k, v in pairs.items() if v]
    gone = [k for k, v in pairs.items() if not v]
    return F.translate(s, "".join(keep + gone), "".join(pairs[k] for k in keep))


# --- slicing and padding ---------------------------------------------------------------------------------------------


def slice_(s: Column, start: int | None = 0, end: int | None = None, step: int | None = 1) -> Column:
    """Python's slice by code points."""
    step = 1 if step is None else step
    if step == 0:
        raise ValueError("slice step cannot be zero")
    n = F.length(s)
    if step > 0:
        start = start or 0
        lo = F.greatest(n + start, F.lit(0)) if start < 0 else F.least(F.lit(start), n)
        hi = n if end is None else F.greatest(n + end, F.lit(0)) if end < 0 else F.least(F.lit(end), n)
        if step == 1:
            return _known(s, _sub(s, lo + 1, F.greatest(hi - lo, F.lit(0))))
        some, last = lo < hi, hi - 1
    else:
        lo = n - 1 if start is None else n + start if start < 0 else F.least(F.lit(start), n - 1)
        hi = F.lit(-1) if end is None else F.greatest(n + end, F.lit(-1)) if end < 0 else F.least(F.lit(end), n - 1)
        some, last = (lo >= hi + 1) & (lo >= 0), hi + 1
    picked = F.transform(F.sequence(F.when(some, lo).otherwise(0), F.when(some, last).otherwise(0), F.when(some, F.lit(step)).otherwise(F.lit(1 if step > 0 else -1))), lambda i: F.substring(s, i + 1, F.lit(1)))
    return _known(s, F.when(some, F.array_join(picked, "")).otherwise(""))


def slice_replace(s: Column, start: int | None = None, stop: int | None = None, repl: str = "") -> Column:
    """The slice is replaced; an empty one inserts at its start."""
    n = F.length(s)
    at = lambda k, none: none if k is None else (F.greatest(n + k, F.lit(0)) if k < 0 else F.least(F.lit(k), n))
    lo, hi = at(start, F.lit(0)), at(stop, n)
    return F.concat(_sub(s, 1, lo), F.lit(repl), _sub(s, F.greatest(lo, hi) + 1, n))


def get(s: Column, i: int) -> Column:
    """The character at ``i``, null beyond the ends."""
    at = F.lit(i) if i >= 0 else F.length(s) + i
    return F.when((at >= 0) & (at < F.length(s)), _sub(s, at + 1, 1))


def get_item(c: Column, i: int) -> Column:
    """The element at ``i`` of a list, null beyond the ends."""
    return F.try_element_at(c, F.lit(i + 1 if i >= 0 else i))


def _width(s: Column, width: int) -> Column:
    return F.greatest(F.lit(width), F.length(s))


def ljust(s: Column, width: int, fillchar: str = " ") -> Column:
    return F.rpad(s, _width(s, width), F.lit(fillchar))


def rjust(s: Column, width: int, fillchar: str = " ") -> Column:
    return F.lpad(s, _width(s, width), F.lit(fillchar))


def center(s: Column, width: int, fillchar: str = " ") -> Column:
    pad = F.greatest(F.lit(width) - F.length(s), F.lit(0))
    left = F.floor(pad / 2).cast("int") + (pad.bitwiseAND(F.lit(width)).bitwiseAND(F.lit(1)))
    return F.rpad(F.lpad(s, F.length(s) + left, F.lit(fillchar)), _width(s, width), F.lit(fillchar))


def pad(s: Column, width: int, side: str = "left", fillchar: str = " ") -> Column:
    try:
        return {"left": rjust, "right": ljust, "both": center}[side](s, width, fillchar)
    except KeyError:
        raise ValueError("side is left, right or both") from None


def zfill(s: Column, width: int) -> Column:
    """Zeros after a sign, if there is one."""
    signed = F.concat(F.left(s, F.lit(1)), F.lpad(_sub(s, 2, F.length(s)), F.greatest(F.lit(width - 1), F.length(s) - 1), F.lit("0")))
    return F.when(s.rlike("^[+-]"), signed).otherwise(F.lpad(s, _width(s, width), F.lit("0")))


def repeat(s: Column, n: int) -> Column:
    return F.repeat(s, n)


# --- splitting and joining -------------------------------------------------------------------------------------------


def split(s: Column, sep: str | None = None, n: int = -1) -> Column:
    """A list of parts; without ``sep`` at white space, where the empty text has no part."""
    limit = n + 1 if n > 0 else -1
    if sep is None:
        bare = strip(s)
        if n > 0:
            bare = lstrip(s)
            parts = F.split(bare, f"[{_SPACE_CLASS}]+", limit)
            return _known(s, F.filter(parts, lambda p: p != ""))
        return _known(s, F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{_SPACE_CLASS}]+", limit)))
    return F.split(s, literal(sep), limit)


def rsplit(s: Column, sep: str | None = None, n: int = -1) -> Column:
    if n <= 0 or sep is None and n <= 0:
        return split(s, sep, n)
    turned = split(F.reverse(s), None if sep is None else sep[::-1], n)
    return F.transform(F.reverse(turned), lambda p: F.reverse(p))


def expand(parts: Column, size: int) -> list[Column]:
    """The first ``size`` elements of a list as columns, null where there are fewer."""
    return [F.get(parts, F.lit(i)).alias(str(i)) for i in range(size)]


def expand_rows(df: DataFrame, parts: Column, *keep: str) -> DataFrame:
    """``keep`` and all elements of a list as columns 0, 1, ...: as many as the longest list has, found by one aggregation."""
    held = df.select(*keep, parts.alias("__parts"))
    most = held.agg(F.max(F.when(F.col("__parts").isNotNull(), F.size("__parts")))).first()[0] or 0
    return held.select(*keep, *expand(F.col("__parts"), most))


def partition(s: Column, sep: str = " ") -> list[Column]:
    """(before, separator, after) of the first occurrence; (s, '', '') if there is none."""
    at = F.instr(s, sep)
    cut = [_sub(s, 1, at - 1), F.lit(sep), _sub(s, at + len(sep), F.length(s))]
    return [_known(s, F.when(at > 0, c).otherwise(s if i == 0 else F.lit(""))).alias(str(i)) for i, c in enumerate(cut)]


def rpartition(s: Column, sep: str = " ") -> list[Column]:
    """(before, separator, after) of the last occurrence; ('', '', s) if there is none."""
    at = rfind(s, sep)
    cut = [_sub(s, 1, at), F.lit(sep), _sub(s, at + len(sep) + 1, F.length(s))]
    return [_known(s, F.when(at >= 0, c).otherwise(s if i == 2 else F.lit(""))).alias(str(i)) for i, c in enumerate(cut)]


def join(c: Column, sep: str, is_list: bool = True) -> Column:
    """List elements joined, null if one of them is; a text's characters joined otherwise."""
    if is_list:
        return F.when(~F.exists(c, lambda e: e.isNull()), F.array_join(c, sep))
    return F.array_join(F.filter(F.split(c, ""), lambda e: e != ""), sep)


# --- case and length -------------------------------------------------------------------------------------------------


def len_(s: Column) -> Column:
    return F.length(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def upper(s: Column) -> Column:
    return F.upper(s)


def capitalize(s: Column) -> Column:
    return F.concat(F.upper(F.left(s, F.lit(1))), F.lower(_sub(s, 2, F.length(s))))


def swapcase(s: Column) -> Column:
    turned = F.transform(F.split(s, ""), lambda c: F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c)))
    return _known(s, F.array_join(turned, ""))


def encode(s: Column, encoding: str = "utf-8") -> Column:
    return F.encode(s, encoding)


def decode(b: Column, encoding: str = "utf-8") -> Column:
    return F.decode(b, encoding)


# --- character classes: exact for Latin-1; ``text_fallback.is_exact`` follows Python's tables beyond ------------------


def isalnum(s: Column) -> Column:
    return s.rlike(r"^[\p{L}\p{N}]+\z")


def isalpha(s: Column) -> Column:
    return s.rlike(r"^\p{L}+\z")


def isdecimal(s: Column) -> Column:
    return s.rlike(r"^\p{Nd}+\z")


def isdigit(s: Column) -> Column:
    return s.rlike(r"^[\p{Nd}\x{b2}\x{b3}\x{b9}]+\z")


def isnumeric(s: Column) -> Column:
    return s.rlike(r"^\p{N}+\z")


def isspace(s: Column) -> Column:
    return s.rlike(f"^[{_SPACE_CLASS}]+\\z")


def islower(s: Column) -> Column:
    return s.rlike(r"[\p{Ll}\x{aa}\x{ba}]") & ~s.rlike(r"[\p{Lu}\p{Lt}]")


def isupper(s: Column) -> Column:
    return s.rlike(r"\p{Lu}") & ~s.rlike(r"[\p{Ll}\p{Lt}\x{aa}\x{ba}]")


NATIVE = {
    "cat": cat, "contains": contains, "count": count, "startswith": startswith, "endswith": endswith, "match": match, "fullmatch": fullmatch,
    "find": find, "rfind": rfind, "index": index, "rindex": rindex, "findall": findall, "extract": extract, "extractall": extractall,
    "replace": replace, "strip": strip, "lstrip": lstrip, "rstrip": rstrip, "removeprefix": removeprefix, "removesuffix": removesuffix,
    "translate": translate, "slice": slice_, "slice_replace": slice_replace, "get": get, "ljust": ljust, "rjust": rjust, "center": center,
    "pad": pad, "zfill": zfill, "repeat": repeat, "split": split, "rsplit": rsplit, "partition": partition, "rpartition": rpartition,
    "join": join, "len": len_, "lower": lower, "upper": upper, "capitalize": capitalize, "swapcase": swapcase, "encode": encode,
    "decode": decode, "isalnum": isalnum, "isalpha": isalpha, "isdecimal": isdecimal, "isdigit": isdigit, "isnumeric": isnumeric,
    "isspace": isspace, "islower": islower, "isupper": isupper,
}
