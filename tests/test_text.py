"""Text functions against pandas' ``.str`` on Latin-1 and multilingual texts."""

import random
import textwrap

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colkit.functions import text as X
from colkit.functions import text_fallback as fallback
from colkit.functions.accessor import text, text_strict
from colkit.functions.udf import apply_binary_str

S = F.col("s")


def sample() -> list:
    rnd = random.Random(11)
    alphabet = [chr(c) for c in range(1, 256)] + list("  aabbAB..\t")
    out = [None, "", " ", "a", "aa", "aba", "ABC", "ß", "éÉ", " a ", "\xa0x", "123+", "123+a+", "+5", "-17", "a|b", "hello world", "²³", "½", "ªº"]
    return out + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 12))) for _ in range(150)]


DATA = sample()
SERIES = pd.Series(DATA, dtype=object)


def run(spark, *cols, data=None):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(DATA if data is None else data)], "i int, s string").repartition(3)
    rows = sorted(df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(cols)]).collect())
    return [r[1] if len(cols) == 1 else tuple(r)[1:] for r in rows]


def same(got, want):
    want = [None if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else x.item() if hasattr(x, "item") else x for x in want]
    assert got == want


@pytest.mark.parametrize(
    "name,args",
    [
        ("contains", ("a", True, 0, None, False)), ("startswith", ("a",)), ("endswith", ("b",)), ("count", (r"[ab]",)), ("find", ("a",)), ("rfind", ("ab",)), ("len", ()),
        ("lower", ()), ("capitalize", ()), ("center", (6,)), ("center", (7,)), ("ljust", (5,)), ("rjust", (5,)), ("zfill", (5,)), ("repeat", (3,)), ("get", (1,)), ("get", (-1,)), ("lstrip", ()), ("rstrip", ()),
        ("removeprefix", ("a",)), ("removesuffix", ("b",)), ("strip", ("ab",)), ("isalnum", ()), ("isalpha", ()), ("isdecimal", ()), ("isdigit", ()), ("islower", ()), ("isnumeric", ()), ("isspace", ()), ("isupper", ()),
        ("match", ("[a-z]+",)), ("fullmatch", ("[a-z ]+",)), ("findall", ("[ab]",)), ("slice_replace", (1, 3, "X")), ("slice_replace", (None, 2, "X")), ("slice_replace", (1, None, "X")),
        ("split", ("a",)), ("split", ()), ("rsplit", ("a", )), ("pad", (5, "both", "*")), ("pad", (5, "left", "*")), ("pad", (5, "right", "*")),
    ],
)
def test_equal_to_pandas(spark, name, args):
    if name == "contains":
        got = run(spark, X.contains(S, "a"))
    elif name == "count":
        got = run(spark, X.count(S, args[0], regex=True))
    else:
        got = run(spark, getattr(text(S), name)(*args))
    want = getattr(SERIES.str, name)(*args)
    if name == "capitalize":  # beyond Latin-1 and the sharp s, which has no capital
        got, want = zip(*[(g, w) for g, w, d in zip(got, want, DATA, strict=True) if not (d or "").startswith("ß")], strict=True)
    same(list(got), want)


@pytest.mark.parametrize("n", [-1, 0, 1, 2, 5])
@pytest.mark.parametrize("pat,repl", [("a", "len4"), ("aa", ""), ("ab", "z"), (".", "$1\\"), ("aabaa", "x")])
def test_literal_replacement(spark, n, pat, repl):
    same(run(spark, X.replace(S, pat, repl, n)), [None if x is None else x.replace(pat, repl, n) for x in DATA])


@pytest.mark.parametrize("n", [-1, 0, 1, 3])
def test_empty_pattern(spark, n):
    same(run(spark, X.replace(S, "", "-", n)), [None if x is None else x.replace("", "-", n) for x in DATA])
    same(run(spark, X.count(S, "")), [None if x is None else len(x.encode()) + 1 for x in DATA])
    same(run(spark, X.contains(S, "")), [None if x is None else True for x in DATA])


def test_literal_counts_and_case(spark):
    same(run(spark, X.count(S, "aa"), data=["aaaa", "aaa", None, ""]), [2, 1, None, 0])
    same(run(spark, X.contains(S, "A", case=False), data=["xa", "A", None, "b"]), [True, True, None, False])


@pytest.mark.parametrize("pat", ["", "a", "a$", "^a", "A", "A$", "^A"])
@pytest.mark.parametrize("case", [True, False])
def test_regex_search(spark, pat, case):
    data = ["aa", "Aa", "ab", "AB", "ba", "ba\n", None]
    same(run(spark, X.contains(S, pat, case=case, regex=True), data=data), pd.Series(data).str.contains(pat, case=case))


def test_regex_replacement(spark):
    same(run(spark, X.replace(S, r"([ab])(?P<x>.)", r"\2\1$", regex=True)), SERIES.str.replace(r"([ab])(?P<x>.)", r"\2\1$", regex=True))
    same(run(spark, text(S).replace("[ab]", "*", n=1, regex=True)), SERIES.str.replace("[ab]", "*", n=1, regex=True))
    same(run(spark, X.replace(S, "A.", "*", case=False)), [None if x is None else __import__("re").sub("(?i)A\\.", "*", x) for x in DATA])
    with pytest.raises(NotImplementedError):
        X.replace(S, "a", "b", n=1, regex=True)


def test_default_strip_is_pythons(spark):
    data = ["", None, " ", " ", " a", "a ", " a ", "\xa0", " a ", " ‌ ", "\n‌\r", " x　", *[chr(c) for c in range(1, 0x32)], *[chr(c) for c in range(0x200C, 0x2030)], "\U0010ffff"]
    same(run(spark, text_strict(S).strip(), data=data), [None if x is None else x.strip() for x in data])


@pytest.mark.parametrize("step", [None, 1, 2, -1, -3])
def test_slices(spark, step):
    bounds = [(a, b) for a in (None, 0, 1, 3, 20, -1, -2, -20) for b in (None, 0, 1, 4, 20, -1, -3, -20)]
    data = ["", "a", "héllo", "hello world", None, "🙈🙉🙊"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, s string")
    rows = sorted(df.select("i", *[X.slice_(S, a, b, step).alias(f"c{k}") for k, (a, b) in enumerate(bounds)]).collect())
    for row, x in zip(rows, data, strict=True):
        assert list(row)[1:] == [None if x is None else x[a:b:step] for a, b in bounds]
    with pytest.raises(ValueError):
        X.slice_(S, 0, 1, 0)


def test_cat_is_positional_and_null_wins(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None)], "a string, b string")
    assert [r[0] for r in df.select(X.cat(F.col("a"), F.col("b"))).collect()] == ["ab", None, None]


@pytest.mark.parametrize("data", [["123"], ["123+"], ["123+a+", "123+"], [None, "", "+"]])
def test_partitions_and_splits(spark, data):
    s = pd.Series(data, dtype=object)
    for name in ("partition", "rpartition"):
        want = getattr(s.str, name)("+")
        assert run(spark, *getattr(X, name)(S, "+"), data=data) == [tuple(None if pd.isna(v) else v for v in r) for r in want.itertuples(index=False)]
    for name in ("split", "rsplit"):
        for n in (-1, 1):
            same(run(spark, getattr(X, name)(S, "+", n), data=data), getattr(s.str, name)("+", n=n))
    wide = run(spark, *X.expand(X.split(S, "+"), 3), data=data)
    want = s.str.split("+", expand=True).reindex(columns=range(3))
    assert wide == [tuple(None if pd.isna(v) else v for v in r) for r in want.itertuples(index=False)]


def test_split_at_blanks_with_a_limit(spark):
    data = ["a  b c", "  x  y z ", "", None, "one"]
    same(run(spark, X.split(S, None, 1), data=[d if d is None else d.rstrip() for d in data]), [None if x is None else x.rstrip().split(None, 1) for x in data])


def test_extract(spark):
    data = ["123+", "123+a", "x", None]
    for pat in (r"([0-9]+)", r"([0-9]+)\+([a-z]+)*", r"(?P<n>[0-9]*)x"):
        want = pd.Series(data).str.extract(pat, expand=True)
        got = run(spark, *X.extract(S, pat), data=data)
        got = [g if isinstance(g, tuple) else (g,) for g in got]
        assert got == [tuple(None if pd.isna(v) else v for v in r) for r in want.itertuples(index=False)], pat
    df = spark.createDataFrame([(0, "a1b2"), (1, "zz"), (2, None)], "i int, s string")
    got = df.select("i", F.posexplode(X.extractall(S, "([a-z])([0-9])")).alias("match", "g")).select("i", "match", "g.g0", "g.g1").collect()
    assert sorted(map(tuple, got)) == [(0, 0, "a", "1"), (0, 1, "b", "2")]


def test_index_raises_where_find_does_not(spark):
    same(run(spark, X.index(S, "a"), data=["ba", "a", None]), [1, 0, None])
    same(run(spark, X.rindex(S, "a"), data=["baa", "a", None]), [2, 0, None])
    for func in (X.index, X.rindex):
        with pytest.raises(Exception, match="substring not found"):
            run(spark, func(S, "a"), data=["b"])
    same(run(spark, X.find(S, "b", 1, 3), data=["bbb", "abab", "a", "", None]), [1, 1, -1, -1, None])


def test_joins_translate_encode(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", None],), ([],), (None,)], "l array<string>")
    assert [r[0] for r in df.select(X.join(F.col("l"), "-")).collect()] == ["a-b", None, "", None]
    same(run(spark, X.join(S, "-", is_list=False), data=["abc", "", None]), ["a-b-c", "", None])
    table = {"a": "🤙", "👅": "a", ord("1"): "1", "x": None}
    data = ["a", "aa", "1, 👅, 3x", None]
    want = [None if x is None else x.translate(str.maketrans(table)) for x in data]
    same(run(spark, text(S).translate(table), data=data), want)
    same(run(spark, text(S).translate({"a": "<a>"}), data=data), [None if x is None else x.replace("a", "<a>") for x in data])
    same(run(spark, X.decode(X.encode(S)), data=data), data)
    assert run(spark, X.encode(S), data=["é"]) == [bytearray("é".encode())]
    lists = spark.createDataFrame([([1, 2],), ([],)], "l array<int>")
    assert [tuple(r) for r in lists.select(X.get_item(F.col("l"), 1), X.get_item(F.col("l"), -1)).collect()] == [(2, 2), (None, None)]


def test_swapcase_and_upper_on_ascii(spark):
    data = ["aBc dE1", "", None]
    same(run(spark, X.swapcase(S), data=data), pd.Series(data).str.swapcase())
    same(run(spark, X.upper(S), data=data), pd.Series(data).str.upper())


@pytest.mark.parametrize("name,args", [("casefold", ()), ("title", ()), ("istitle", ()), *[("normalize", (f,)) for f in ("NFC", "NFKC", "NFD", "NFKD")]])
def test_fallbacks(spark, name, args):
    same(run(spark, getattr(text(S), name)(*args)), getattr(SERIES.str, name)(*args))
    with pytest.raises(AttributeError):
        getattr(text_strict(S), name)


def test_wrap(spark):
    data = ["the quick brown fox jumps over", "", None, "averyveryverylongword x"]
    for options in ({}, {"break_long_words": False}, {"expand_tabs": False}):
        same(run(spark, text(S).wrap(10, **options), data=data), [None if x is None else "\n".join(textwrap.wrap(x, 10, **options)) for x in data])


def test_exact_classes_cover_all_of_unicode(spark):
    data = ["Ⅷ", "一", "ǅ", "٣", "𝔸", "", None]
    for name in ("isalpha", "isnumeric", "istitle", "isdigit"):
        same(run(spark, fallback.is_exact(S, name), data=data), [None if x is None else getattr(x, name)() for x in data])
    with pytest.raises(AttributeError):
        fallback.is_exact(S, "isnothing")


def test_accessors_refuse_what_they_do_not_know():
    with pytest.raises(AttributeError):
        text_strict("not a column")
    with pytest.raises(AttributeError):
        text(S).no_such_function


def test_binary_udf(spark):
    def prefix(a, n, b, m):  # local, so that workers need not import this module
        k = 0
        while k < min(n, m) and a[k] == b[k]:
            k += 1
        return k

    rows = [(0, "a", "aa"), (1, "bb", "bb"), (2, None, "c"), (3, "c", None), (4, "d", "c")]
    df = spark.createDataFrame(rows, "i int, a string, b string").repartition(3)
    for kind in ("bigint", "int", "double"):
        got = df.select("i", apply_binary_str(F.col("a"), F.col("b"), func=prefix, output_dtype=kind).alias("v"))
        assert [r["v"] for r in got.orderBy("i").collect()] == [1, 2, None, None, 0]
        assert got.schema["v"].dataType.simpleString() == kind
    with pytest.raises(ValueError):
        apply_binary_str(F.col("a"), F.col("b"), func=prefix, output_dtype="nonsense<")
    with pytest.raises(ValueError):
        apply_binary_str(F.col("a"), F.col("b"), func=None, output_dtype="int")


texts = st.lists(st.one_of(st.none(), st.text(st.characters(min_codepoint=1, max_codepoint=255), max_size=12)), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(data=texts, pat=st.text("ab.", min_size=1, max_size=3), n=st.integers(-1, 4))
def test_random_texts(spark, data, pat, n):
    data = [x if x is None or i % 2 else x + pat + pat for i, x in enumerate(data)] or [None]
    got = run(spark, X.contains(S, pat), X.count(S, pat), X.replace(S, pat, "zz", n), X.startswith(S, pat), X.endswith(S, pat), X.find(S, pat), X.rfind(S, pat), X.strip(S, pat), data=data)
    for x, row in zip(data, got, strict=True):
        want = (None,) * 8 if x is None else (pat in x, x.count(pat), x.replace(pat, "zz", n), x.startswith(pat), x.endswith(pat), x.find(pat), x.rfind(pat), x.strip(pat))
        assert row == want
