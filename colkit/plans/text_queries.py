"""Text queries: one per text function, each a projection over a whole table, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.accessor import text, text_strict

#: Sources: table, key, text.  Nulls are put in by key, in both engines alike.
SOURCES = {
    "part": ("part", "p_partkey", "p_name"),
    "brand": ("part", "p_partkey", "p_brand"),
    "customer": ("customer", "c_custkey", "c_name"),
    "documents": ("documents", "doc_id", "text"),
    "pages": ("pages", "page_id", "url"),
    "chat": ("conversations", "conv_id * 1000 + turn", "text"),
    "size": ("part", "p_partkey", "CAST(p_size - 25 AS STRING)"),
    "kinds": ("part", "p_partkey", "CASE p_partkey % 6 WHEN 0 THEN upper(replace(p_brand, '#', '')) WHEN 1 THEN lower(replace(p_name, ' ', '')) WHEN 2 THEN CAST(p_size AS STRING) WHEN 3 THEN '  ' WHEN 4 THEN '' ELSE p_type END"),
}


def source_sql(name: str) -> str:
    table, key, column = SOURCES[name]
    return f"(SELECT CAST({key} AS BIGINT) AS k, CASE WHEN ({key}) % 7 = 0 THEN NULL ELSE {column} END AS s FROM {table})"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, key, column = SOURCES[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(F.expr(f"CAST({key} AS BIGINT)").alias("k"), F.expr(f"CASE WHEN ({key}) % 7 = 0 THEN NULL ELSE {column} END").alias("s"))


S = F.col
Build = Callable[[Column], "Column | list[Column]"]

#: A text without white space at its ends, in SQL.
_BARE = "trim(s, ' ' || chr(10) || chr(9) || chr(13))"

#: name: (source, expression, SQL of the result columns; None where SQL has no equal)
TEXT: dict[str, tuple[str, Build, str | None]] = {
    "text_cat": ("part", lambda s: T.cat(s, F.concat(F.lit("/"), F.col("k").cast("string"))), "s || '/' || CAST(k AS VARCHAR) AS v"),
    "text_contains": ("documents", lambda s: text_strict(s).contains("the"), "contains(s, 'the') AS v"),
    "text_contains_empty": ("documents", lambda s: text_strict(s).contains(""), "CASE WHEN s IS NOT NULL THEN true END AS v"),
    "text_contains_nocase": ("documents", lambda s: T.contains(s, "THE", case=False), "contains(upper(s), 'THE') AS v"),
    "text_contains_regex": ("documents", lambda s: T.contains(s, "th[ae]+r", regex=True), "regexp_matches(s, 'th[ae]+r') AS v"),
    "text_count": ("documents", lambda s: text_strict(s).count("th"), "CAST((length(s) - length(replace(s, 'th', ''))) // 2 AS INTEGER) AS v"),
    "text_count_empty": ("documents", lambda s: text_strict(s).count(""), "CAST(strlen(s) + 1 AS INTEGER) AS v"),
    "text_count_regex": ("documents", lambda s: T.count(s, "[aeiou]{2}", regex=True), "CAST(len(regexp_extract_all(s, '[aeiou]{2}')) AS INTEGER) AS v"),
    "text_replace": ("documents", lambda s: text_strict(s).replace("th", "TH"), "replace(s, 'th', 'TH') AS v"),
    "text_replace_first": ("documents", lambda s: text_strict(s).replace("e", "#", n=1), "regexp_replace(s, 'e', '#') AS v"),
    "text_replace_empty": ("customer", lambda s: text_strict(s).replace("", "-"), "'-' || regexp_replace(s, '(.)', '\\1-', 'g') AS v"),
    "text_replace_regex": ("part", lambda s: T.replace(s, "a([b-z])", r"<\1>", regex=True), "regexp_replace(s, 'a([b-z])', '<\\1>', 'g') AS v"),
    "text_replace_regex_n": ("part", lambda s: text(s).replace("[aeiou]", "*", n=1, regex=True), "regexp_replace(s, '[aeiou]', '*') AS v"),
    "text_strip": ("documents", lambda s: text_strict(s).strip(".T "), "trim(s, '.T ') AS v"),
    "text_lstrip": ("part", lambda s: T.lstrip(s, "abcdefgh"), "ltrim(s, 'abcdefgh') AS v"),
    "text_rstrip": ("part", lambda s: T.rstrip(s, "rstuvwxyzn "), "rtrim(s, 'rstuvwxyzn ') AS v"),
    "text_zfill": ("size", lambda s: text_strict(s).zfill(5), "CASE WHEN s[1:1] IN ('-', '+') THEN s[1:1] || lpad(s[2:], CAST(greatest(4, length(s) - 1) AS INTEGER), '0') ELSE lpad(s, CAST(greatest(5, length(s)) AS INTEGER), '0') END AS v"),
    "text_startswith": ("pages", lambda s: text_strict(s).startswith("https://"), "starts_with(s, 'https://') AS v"),
    "text_endswith": ("pages", lambda s: text_strict(s).endswith(".html"), "suffix(s, '.html') AS v"),
    "text_slice": ("documents", lambda s: text_strict(s).slice(2, 7), "substring(s, 3, 5) AS v"),
    "text_slice_negative": ("part", lambda s: text_strict(s).slice(-5, -1), "CASE WHEN length(s) >= 1 THEN substring(s, CAST(greatest(length(s) - 5, 0) + 1 AS BIGINT), CAST(greatest(length(s) - 1 - greatest(length(s) - 5, 0), 0) AS BIGINT)) ELSE s END AS v"),
    "text_slice_step": ("part", lambda s: text_strict(s).slice(0, 9, 2), "array_to_string(string_split(s, '')[1:9:2], '') AS v"),
    "text_slice_reverse": ("part", lambda s: T.slice_(s, None, None, -1), "reverse(s) AS v"),
    "text_isalnum": ("kinds", lambda s: text_strict(s).isalnum(), "regexp_full_match(s, '[\\p{L}\\p{N}]+') AS v"),
    "text_isalpha": ("kinds", lambda s: text_strict(s).isalpha(), "regexp_full_match(s, '\\p{L}+') AS v"),
    "text_isdecimal": ("kinds", lambda s: text_strict(s).isdecimal(), "regexp_full_match(s, '\\p{Nd}+') AS v"),
    "text_isdigit": ("kinds", lambda s: text_strict(s).isdigit(), "regexp_full_match(s, '[\\p{Nd}²³¹]+') AS v"),
    "text_islower": ("kinds", lambda s: text_strict(s).islower(), "regexp_matches(s, '\\p{Ll}') AND NOT regexp_matches(s, '[\\p{Lu}\\p{Lt}]') AS v"),
    "text_isnumeric": ("kinds", lambda s: text_strict(s).isnumeric(), "regexp_full_match(s, '\\p{N}+') AS v"),
    "text_isspace": ("kinds", lambda s: text_strict(s).isspace(), "regexp_full_match(s, '\\s+') AS v"),
    "text_isupper": ("kinds", lambda s: text_strict(s).isupper(), "regexp_matches(s, '\\p{Lu}') AND NOT regexp_matches(s, '[\\p{Ll}\\p{Lt}]') AS v"),
    "text_istitle": ("part", lambda s: text(s).istitle(), "regexp_matches(s, '[A-Z]') AND NOT regexp_matches(s, '[A-Za-z][A-Z]') AND NOT regexp_matches(s, '(^|[^A-Za-z])[a-z]') AS v"),
    "text_istitle_kinds": ("kinds", lambda s: text(s).istitle(), "regexp_matches(s, '[A-Z]') AND NOT regexp_matches(s, '[A-Za-z][A-Z]') AND NOT regexp_matches(s, '(^|[^A-Za-z])[a-z]') AS v"),
    "text_isalpha_exact": ("kinds", lambda s: text(s).isalpha(exact=True), "regexp_full_match(s, '\\p{L}+') AS v"),
    "text_isdigit_exact": ("kinds", lambda s: text(s).isdigit(exact=True), "regexp_full_match(s, '[\\p{Nd}²³¹]+') AS v"),
    "text_isupper_exact": ("kinds", lambda s: text(s).isupper(exact=True), "regexp_matches(s, '\\p{Lu}') AND NOT regexp_matches(s, '[\\p{Ll}\\p{Lt}]') AS v"),
    "text_capitalize": ("part", lambda s: T.capitalize(s), "upper(s[1:1]) || lower(s[2:]) AS v"),
    "text_casefold": ("documents", lambda s: text(s).casefold(), "replace(lower(s), 'ß', 'ss') AS v"),
    "text_center": ("part", lambda s: T.center(s, 31, "*"), "rpad(lpad(s, CAST(length(s) + greatest(31 - length(s), 0) // 2 + (greatest(31 - length(s), 0) & 1) AS INTEGER), '*'), CAST(greatest(31, length(s)) AS INTEGER), '*') AS v"),
    "text_encode": ("documents", lambda s: F.hex(T.encode(s, "utf-8")), "hex(encode(s)) AS v"),
    "text_decode": ("documents", lambda s: T.decode(T.encode(s, "utf-8"), "utf-8"), "decode(encode(s)) AS v"),
    "text_extract": ("pages", lambda s: T.extract(s, r"^(https?)://([^/]+)"), "nullif(regexp_extract(s, '^(https?)://([^/]+)', 1), '') AS \"0\", nullif(regexp_extract(s, '^(https?)://([^/]+)', 2), '') AS \"1\""),
    "text_find": ("documents", lambda s: T.find(s, "th"), "CAST(instr(s, 'th') - 1 AS INTEGER) AS v"),
    "text_find_from": ("part", lambda s: T.find(s, "e", 3), "CAST(CASE WHEN instr(substring(s, 4), 'e') > 0 THEN instr(substring(s, 4), 'e') + 2 ELSE CASE WHEN s IS NOT NULL THEN -1 END END AS INTEGER) AS v"),
    "text_rfind": ("documents", lambda s: T.rfind(s, "th"), "CAST(CASE WHEN contains(s, 'th') THEN length(s) - instr(reverse(s), 'ht') - 1 WHEN s IS NOT NULL THEN -1 END AS INTEGER) AS v"),
    "text_index": ("pages", lambda s: T.index(s, "://"), "CAST(instr(s, '://') - 1 AS INTEGER) AS v"),
    "text_rindex": ("pages", lambda s: T.rindex(s, "/"), "CAST(length(s) - instr(reverse(s), '/') AS INTEGER) AS v"),
    "text_findall": ("documents", lambda s: F.array_join(T.findall(s, "[a-z]+tion"), ","), "array_to_string(regexp_extract_all(s, '[a-z]+tion'), ',') AS v"),
    "text_findall_group": ("part", lambda s: F.array_join(T.findall(s, "([a-z])a"), ","), "array_to_string(regexp_extract_all(s, '([a-z])a', 1), ',') AS v"),
    "text_match": ("part", lambda s: T.match(s, "[a-m]+"), "regexp_matches(s, '^(?:[a-m]+)') AS v"),
    "text_fullmatch": ("part", lambda s: T.fullmatch(s, "[a-z ]+"), "regexp_full_match(s, '[a-z ]+') AS v"),
    "text_get": ("documents", lambda s: T.get(s, 20), "CASE WHEN length(s) > 20 THEN substring(s, 21, 1) END AS v"),
    "text_join": ("part", lambda s: T.join(s, "-", is_list=False), "array_to_string(string_split(s, ''), '-') AS v"),
    "text_join_list": ("part", lambda s: T.join(T.split(s, " "), "+"), "array_to_string(string_split(s, ' '), '+') AS v"),
    "text_len": ("documents", lambda s: T.len_(s), "CAST(length(s) AS INTEGER) AS v"),
    "text_ljust": ("part", lambda s: T.ljust(s, 25), "rpad(s, CAST(greatest(25, length(s)) AS INTEGER), ' ') AS v"),
    "text_rjust": ("part", lambda s: T.rjust(s, 25), "lpad(s, CAST(greatest(25, length(s)) AS INTEGER), ' ') AS v"),
    "text_pad": ("brand", lambda s: [T.pad(s, 12, "left", "<").alias("l"), T.pad(s, 12, "right", ">").alias("r")], "lpad(s, CAST(greatest(12, length(s)) AS INTEGER), '<') AS l, rpad(s, CAST(greatest(12, length(s)) AS INTEGER), '>') AS r"),
    "text_lower": ("documents", lambda s: T.lower(s), "lower(s) AS v"),
    "text_upper": ("part", lambda s: T.upper(s), "upper(s) AS v"),
    "text_swapcase": ("brand", lambda s: T.swapcase(s), "array_to_string(list_transform(string_split(s, ''), lambda c: CASE WHEN c = upper(c) THEN lower(c) ELSE upper(c) END), '') AS v"),
    "text_title": ("part", lambda s: text(s).title(), "array_to_string(list_transform(string_split(s, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS v"),
    "text_normalize_nfc": ("documents", lambda s: text(s).normalize("NFC"), "nfc_normalize(s) AS v"),
    "text_normalize_nfd": ("documents", lambda s: F.regexp_replace(text(s).normalize("NFD"), r"\p{Mn}+", ""), "strip_accents(s) AS v"),
    "text_normalize_twice": ("documents", lambda s: text(text(s).normalize("NFD")).normalize("NFC"), "nfc_normalize(s) AS v"),
    "text_wrap": ("chat", lambda s: text(s).wrap(40), f"CASE WHEN {_BARE} = '' THEN '' ELSE list_reduce(regexp_split_to_array({_BARE}, '\\s+'), lambda a, w: CASE WHEN length(regexp_extract(a, '[^\\n]*$')) + 1 + length(w) <= 40 THEN a || ' ' || w ELSE a || chr(10) || w END) END AS v"),
    "text_partition": ("part", lambda s: [c.alias(n) for c, n in zip(T.partition(s, "e"), ("a", "b", "c"), strict=True)], "CASE WHEN contains(s, 'e') THEN substring(s, 1, instr(s, 'e') - 1) ELSE s END AS a, CASE WHEN contains(s, 'e') THEN 'e' WHEN s IS NOT NULL THEN '' END AS b, CASE WHEN contains(s, 'e') THEN substring(s, instr(s, 'e') + 1) WHEN s IS NOT NULL THEN '' END AS c"),
    "text_rpartition": ("part", lambda s: [c.alias(n) for c, n in zip(T.rpartition(s, "e"), ("a", "b", "c"), strict=True)], "CASE WHEN contains(s, 'e') THEN substring(s, 1, length(s) - instr(reverse(s), 'e')) WHEN s IS NOT NULL THEN '' END AS a, CASE WHEN contains(s, 'e') THEN 'e' WHEN s IS NOT NULL THEN '' END AS b, CASE WHEN contains(s, 'e') THEN substring(s, length(s) - instr(reverse(s), 'e') + 2) ELSE s END AS c"),
    "text_removeprefix": ("pages", lambda s: T.removeprefix(s, "https://"), "CASE WHEN starts_with(s, 'https://') THEN substring(s, 9) ELSE s END AS v"),
    "text_removesuffix": ("pages", lambda s: T.removesuffix(s, ".html"), "CASE WHEN suffix(s, '.html') THEN substring(s, 1, length(s) - 5) ELSE s END AS v"),
    "text_repeat": ("brand", lambda s: T.repeat(s, 3), "repeat(s, 3) AS v"),
    "text_slice_replace": ("part", lambda s: T.slice_replace(s, 1, 3, "X"), "substring(s, 1, 1) || 'X' || substring(s, 4) AS v"),
    "text_split": ("part", lambda s: [F.size(T.split(s, " ")).alias("n"), F.array_join(T.split(s, " "), "|").alias("v")], "CAST(len(string_split(s, ' ')) AS INTEGER) AS n, array_to_string(string_split(s, ' '), '|') AS v"),
    "text_split_blank": ("documents", lambda s: F.size(T.split(s)), "CAST(CASE WHEN s IS NULL THEN NULL WHEN trim(s, ' ' || chr(10) || chr(9) || chr(13)) = '' THEN 0 ELSE len(regexp_split_to_array(trim(s, ' ' || chr(10) || chr(9) || chr(13)), '\\s+')) END AS INTEGER) AS v"),
    "text_split_n": ("part", lambda s: F.array_join(T.split(s, "a", 1), "|"), "regexp_replace(s, 'a', '|') AS v"),
    "text_split_expand": ("part", lambda s: [c.alias(n) for c, n in zip(T.expand(T.split(s, " "), 3), ("a", "b", "c"), strict=True)], "string_split(s, ' ')[1] AS a, string_split(s, ' ')[2] AS b, string_split(s, ' ')[3] AS c"),
    "text_rsplit": ("part", lambda s: F.array_join(T.rsplit(s, "a", 1), "|"), "reverse(regexp_replace(reverse(s), 'a', '|')) AS v"),
    "text_translate": ("part", lambda s: T.translate(s, {"a": "4", "e": "3", "i": None}), "replace(translate(s, 'ae', '43'), 'i', '') AS v"),
    "text_translate_multi": ("part", lambda s: text(s).translate({"a": "<a>", "e": None}), "replace(replace(s, 'e', ''), 'a', '<a>') AS v"),
}


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    src, build, _ = TEXT[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = build(F.col("s"))
        return source(spark, sf_dir, src).select("k", *(made if isinstance(made, list) else [made.alias("v")]))

    run.__name__ = name
    return run


def extractall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, "part").select("k", F.posexplode(T.extractall(F.col("s"), "([a-z])a([a-z])")).alias("match", "g"))
    return rows.select("k", "match", F.col("g").getField("g0").alias("g0"), F.col("g").getField("g1").alias("g1"))


def split_expand_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.expand_rows(source(spark, sf_dir, "part"), T.split(F.col("s"), " "), "k")


QUERIES = {name: query(name) for name in TEXT} | {"text_extractall": extractall, "text_split_expand_all": split_expand_all}
ORACLES = {name: f"SELECT k, {sql} FROM {source_sql(src).replace('AS STRING', 'AS VARCHAR')}" for name, (src, _, sql) in TEXT.items() if sql}
_ALL = "regexp_extract_all(s, '([a-z])a([a-z])', {})"
ORACLES["text_extractall"] = f"SELECT k, CAST(unnest(range(len({_ALL.format(1)}))) AS INTEGER) AS match, unnest({_ALL.format(1)}) AS g0, unnest({_ALL.format(2)}) AS g1 FROM {source_sql('part')}"
#: Names have two words at every scale; the query finds the width itself.
ORACLES["text_split_expand_all"] = f"SELECT k, string_split(s, ' ')[1] AS \"0\", string_split(s, ' ')[2] AS \"1\" FROM {source_sql('part')}"
