"""Queries for all operators but the text functions: each over whole tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arith, boolean
from ..functions.udf import apply_binary_str
from ..operators import encode, frame, nulls, rows
from ..operators.reduce import reduce_expr
from ..sources.io import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def add(func):
        QUERIES[func.__name__] = func
        if sql:
            ORACLES[func.__name__] = sql
        return func

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", list(columns) or None)


def with_nulls(key: str, column: str) -> F.Column:
    return F.when(F.col(key) % 7 != 0, F.col(column))


def null_sql(key: str, column: str) -> str:
    return f"CASE WHEN {key} % 7 <> 0 THEN {column} END"


# --- scan, arithmetic, comparison ------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part")
def read_parquet_cols(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_partkey", "p_name")


@query("SELECT p_partkey, CAST(p_size + p_partkey AS BIGINT) AS a, CAST(p_size - p_partkey AS BIGINT) AS s, CAST(p_size * p_partkey AS BIGINT) AS m, CAST(CASE WHEN p_partkey % 7 <> 0 THEN p_size END + 1 AS BIGINT) AS n FROM part")
def arith_add_sub_mul(spark, sf_dir):
    df = table(spark, sf_dir, "part", "p_partkey", "p_size")
    a, b = F.col("p_size").cast("bigint"), F.col("p_partkey")
    return df.select("p_partkey", arith.add(a, b).alias("a"), arith.subtract(a, b).alias("s"), arith.multiply(a, b).alias("m"), arith.add(with_nulls("p_partkey", "p_size").cast("bigint"), F.lit(1).cast("bigint")).alias("n"))


_SIGNED = "(p_size - 25)"
_DIVISOR = "(CAST(p_partkey % 9 AS BIGINT) - 4)"


@query(f"SELECT p_partkey, CAST(CASE WHEN {_DIVISOR} = 0 THEN 0 ELSE floor({_SIGNED} / CAST({_DIVISOR} AS DOUBLE)) END AS BIGINT) AS q, CAST(CASE WHEN {_DIVISOR} = 0 THEN 0 ELSE {_SIGNED} - {_DIVISOR} * floor({_SIGNED} / CAST({_DIVISOR} AS DOUBLE)) END AS BIGINT) AS r FROM part")
def floordiv_mod_signs(spark, sf_dir):
    q, r = arith.divmod_(F.col("p_size") - 25, F.col("p_partkey") % 9 - 4)
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", q.alias("q"), r.alias("r"))


#: Powers of two, so that SQL's quotient is exact, too.
_HALVES = "CASE l_linenumber % 4 WHEN 0 THEN 0.5 WHEN 1 THEN -0.25 WHEN 2 THEN 8.0 ELSE -2.0 END"


@query(f"SELECT l_orderkey, l_linenumber, floor(l_extendedprice / {_HALVES}) AS q, l_extendedprice - {_HALVES} * floor(l_extendedprice / {_HALVES}) AS r FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice FROM lineitem)")
def divmod_float(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    kind = F.col("l_linenumber") % 4
    by = F.when(kind == 0, 0.5).when(kind == 1, -0.25).when(kind == 2, 8.0).otherwise(-2.0)
    q, r = arith.divmod_(F.col("l_extendedprice"), by, floating=True)
    return df.select("l_orderkey", "l_linenumber", q.alias("q"), r.alias("r"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_size > 25 THEN 'inf' WHEN p_size < 25 THEN '-inf' ELSE 'nan' END END AS kind, CASE WHEN p_partkey % 5 <> 0 THEN (p_size - 25) / CAST(p_partkey % 5 AS DOUBLE) END AS v FROM part")
def truediv(spark, sf_dir):
    v = arith.truediv(F.col("p_size") - 25, F.col("p_partkey") % 5)
    zero = F.col("p_partkey") % 5 == 0
    kind = F.when(F.isnan(v), F.lit("nan")).when(v == arith.INF, F.lit("inf")).when(v == -arith.INF, F.lit("-inf"))
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", F.when(zero, kind).alias("kind"), F.when(~zero, v).alias("v"))


@query("SELECT p_partkey, CAST(power(p_size, 3) AS BIGINT) AS v FROM part")
def pow_int(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", arith.power(F.col("p_size"), F.lit(3), integral=True).alias("v"))


@query(f"SELECT p_partkey, CAST(CASE WHEN p_partkey % 7 <> 0 THEN greatest(p_size, p_partkey) END AS BIGINT) AS hi, CAST(CASE WHEN p_partkey % 7 <> 0 THEN least(p_size, p_partkey) END AS BIGINT) AS lo, {null_sql('p_partkey', 'p_size')} IS NULL AS isnan FROM part")
def ufunc_max_min_isnan(spark, sf_dir):
    a = with_nulls("p_partkey", "p_size").cast("bigint")
    return table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", arith.ufunc("maximum", a, F.col("p_partkey")).alias("hi"), arith.ufunc("minimum", a, F.col("p_partkey")).alias("lo"), arith.ufunc("isnan", a).alias("isnan"))


_OPS = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
_SQL_OPS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


@query("SELECT o_orderkey, " + ", ".join(f"{null_sql('o_orderkey', 'o_custkey')} {op} 700 AS {n}" for n, op in _SQL_OPS.items()) + " FROM orders")
def cmp_numeric_nulls(spark, sf_dir):
    c = with_nulls("o_orderkey", "o_custkey")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_orderkey", *[arith.compare(op, c, 700, numeric=True).alias(n) for n, op in _OPS.items()])


@query("SELECT p_partkey, " + ", ".join(f"coalesce({null_sql('p_partkey', 'p_brand')} {op} 'Brand#2', {'true' if n == 'ne' else 'false'}) AS {n}" for n, op in _SQL_OPS.items()) + " FROM part")
def cmp_string_nulls(spark, sf_dir):
    c = with_nulls("p_partkey", "p_brand")
    return table(spark, sf_dir, "part", "p_partkey", "p_brand").select("p_partkey", *[arith.compare(op, c, "Brand#2", numeric=False).alias(n) for n, op in _OPS.items()])


# --- booleans, reductions --------------------------------------------------------------------------------------------

_B = "CASE WHEN event_id % 7 <> 0 THEN value > 20 END"
_C = "CASE WHEN event_id % 5 <> 0 THEN user_id % 2 = 0 END"


def _bools(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    return df.select("event_id", "event_type", F.when(F.col("event_id") % 7 != 0, F.col("value") > 20).alias("a"), F.when(F.col("event_id") % 5 != 0, F.col("user_id") % 2 == 0).alias("b"))


@query(f"SELECT event_id, ({_B}) OR ({_C}) AS v FROM events")
def or_kleene(spark, sf_dir):
    return _bools(spark, sf_dir).select("event_id", boolean.or_(F.col("a"), F.col("b")).alias("v"))


@query(f"SELECT event_id, ({_B}) OR NULL AS na, true AS t, {_B} AS f, CASE WHEN ({_B}) IS NOT NULL THEN true END AS same FROM events")
def or_scalars(spark, sf_dir):
    a = F.col("a")
    return _bools(spark, sf_dir).select("event_id", boolean.or_(a, None).alias("na"), boolean.or_(a, True).alias("t"), boolean.or_(a, False).alias("f"), boolean.all_true_like(a).alias("same"))


@query(f"SELECT event_type, coalesce(bool_or(coalesce({_B}, true)), false) AS any_na, coalesce(bool_or({_B}), false) AS any_skip, coalesce(bool_and({_B}), true) AS all_skip FROM events GROUP BY event_type")
def any_all_skipna(spark, sf_dir):
    a = F.col("a")
    return _bools(spark, sf_dir).groupBy("event_type").agg(boolean.any_(a).alias("any_na"), boolean.any_(a, skipna=True).alias("any_skip"), boolean.all_(a).alias("all_skip"))


def _quantities(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_returnflag", "l_linestatus")
    return df.select("l_returnflag", "l_linestatus", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("q"))


_Q = "CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END"
_FLAG = "FROM lineitem GROUP BY l_returnflag, l_linestatus"


def _reduced(spark, sf_dir, places: int | None, **names: str):
    cols = [reduce_expr(kind, F.col("q")).alias(name) for name, kind in names.items()]
    if places is not None:
        cols = [F.round(reduce_expr(kind, F.col("q")), places).alias(name) for name, kind in names.items()]
    return _quantities(spark, sf_dir).groupBy("l_returnflag", "l_linestatus").agg(*cols)


@query(f"SELECT l_returnflag, l_linestatus, sum({_Q}) AS s, max({_Q}) AS hi, min({_Q}) AS lo {_FLAG}")
def reduce_sum_min_max(spark, sf_dir):
    return _reduced(spark, sf_dir, None, s="sum", hi="max", lo="min")


#: Over all orders: a customer's orders are few at every scale, so that the product of their factors stays finite, and exact up to 33.
@query("SELECT o_custkey, product(CAST(1 + o_orderkey % 3 AS DOUBLE)) AS p FROM orders GROUP BY o_custkey")
def reduce_prod_all_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return orders.groupBy("o_custkey").agg(reduce_expr("prod", (1 + F.col("o_orderkey") % 3).cast("double")).alias("p"))


@query(f"SELECT l_returnflag, l_linestatus, round(coalesce(sum({_Q}), 0) / count(*), 6) AS m, round(avg({_Q}), 6) AS a {_FLAG}")
def reduce_mean_all_rows(spark, sf_dir):
    return _reduced(spark, sf_dir, 6, m="mean_all_rows", a="mean")


@query(f"SELECT l_returnflag, l_linestatus, round(stddev_samp({_Q}), 6) AS s, round(var_samp({_Q}), 6) AS v {_FLAG}")
def reduce_std_var(spark, sf_dir):
    return _reduced(spark, sf_dir, 6, s="std", v="var")


@query(f"SELECT l_returnflag, l_linestatus, round(skewness({_Q}), 6) AS s, round(kurtosis({_Q}), 6) AS k {_FLAG}")
def reduce_skew_kurt(spark, sf_dir):
    return _reduced(spark, sf_dir, 6, s="skew", k="kurt")


@query(f"SELECT l_returnflag, l_linestatus, median({_Q}) AS m {_FLAG}")
def reduce_median(spark, sf_dir):
    return _reduced(spark, sf_dir, None, m="median")


@query(f"SELECT l_returnflag, CASE WHEN count(*) = count({_Q}) THEN sum({_Q}) END AS s, CASE WHEN count(*) = count(l_quantity) THEN max(l_quantity) END AS m FROM lineitem GROUP BY l_returnflag")
def reduce_skipna_false(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_returnflag")
    q = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity"))
    return df.groupBy("l_returnflag").agg(reduce_expr("sum", q, skipna=False).alias("s"), reduce_expr("max", F.col("l_quantity"), skipna=False).alias("m"))


# --- distinct values, codes, counts ----------------------------------------------------------------------------------

_E = null_sql("event_id", "event_type")


def _events(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "value")
    return df.select("event_id", "user_id", with_nulls("event_id", "event_type").alias("e"), with_nulls("event_id", "value").alias("x"), "value")


@query(f"SELECT e, min(event_id) AS first_at FROM (SELECT event_id, {_E} AS e FROM events) GROUP BY e")
def unique_first_seen(spark, sf_dir):
    return encode.unique(_events(spark, sf_dir), "e", "event_id")


@query(f"SELECT e, count(*) AS count FROM (SELECT {_E} AS e FROM events) WHERE e IS NOT NULL GROUP BY e")
def value_counts(spark, sf_dir):
    return encode.value_counts(_events(spark, sf_dir), "e")


@query(f"SELECT e, count(*) AS count FROM (SELECT {_E} AS e FROM events) GROUP BY e")
def value_counts_dropna_false(spark, sf_dir):
    return encode.value_counts(_events(spark, sf_dir), "e", dropna=False)


@query(f"SELECT e, count(*) / sum(count(*)) OVER () AS share FROM (SELECT {_E} AS e FROM events) WHERE e IS NOT NULL GROUP BY e")
def value_counts_normalize(spark, sf_dir):
    return encode.value_counts(_events(spark, sf_dir), "e", normalize=True, name="share")


@query(f"WITH v AS (SELECT event_id, {_E} AS e FROM events), u AS (SELECT e, row_number() OVER (ORDER BY min(event_id)) - 1 AS c FROM v WHERE e IS NOT NULL GROUP BY e) SELECT event_id, v.e AS e, coalesce(c, -1) AS code FROM v LEFT JOIN u ON v.e = u.e")
def factorize(spark, sf_dir):
    return encode.factorize(_events(spark, sf_dir).select("event_id", "e"), "e", "event_id")


@query("SELECT o_orderkey, " + ", ".join(f"CAST(coalesce(list_contains(string_split(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus || '|' || CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END END, '|'), '{t}'), false) AS BIGINT) AS \"{t}\"" for t in ("F", "O", "P", "even", "odd")) + " FROM orders")
def get_dummies(spark, sf_dir):
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    tags = F.concat_ws("|", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.lit("even")).otherwise(F.lit("odd")))
    return encode.get_dummies(df.select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, tags).alias("tags")), "tags", "o_orderkey")


@query(f"SELECT event_id, row_number() OVER (PARTITION BY e ORDER BY event_id) > 1 AS duplicated FROM (SELECT event_id, {_E} AS e FROM events)")
def duplicated(spark, sf_dir):
    return encode.duplicated(_events(spark, sf_dir).select("event_id", "e"), "e", "event_id").select("event_id", "duplicated")


# --- missing values --------------------------------------------------------------------------------------------------

_X = null_sql("event_id", "value")
_GAPS = "(SELECT event_id, CASE WHEN event_id % 7 IN (1, 5) THEN value END AS x FROM events)"


@query(f"SELECT event_id, ({_E}) IS NULL AS na, ({_E}) IS NOT NULL AS ok FROM events")
def isna(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", nulls.isna(F.col("e")).alias("na"), nulls.notna(F.col("e")).alias("ok"))


@query(f"SELECT event_id, coalesce({_E}, 'none') AS v FROM events")
def fillna_scalar(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", nulls.fillna(F.col("e"), "none").alias("v"))


@query(f"SELECT event_id, coalesce({_X}, -value) AS v FROM events")
def fillna_column(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", nulls.fillna(F.col("x"), -F.col("value")).alias("v"))


@query(f"SELECT event_id FROM events WHERE ({_E}) IS NOT NULL")
def dropna(spark, sf_dir):
    return _events(spark, sf_dir).dropna(subset=["e"]).select("event_id")


def _gaps(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "value").select("event_id", F.when((F.col("event_id") % 7).isin(1, 5), F.col("value")).alias("x"))


def _fill_query(name: str, method: str, limit: int | None) -> None:
    def run(spark, sf_dir):
        return nulls.fill_in_order(_gaps(spark, sf_dir), "x", ["event_id"], method=method, limit=limit)

    run.__name__ = name
    frame_ = f"{limit or 'UNBOUNDED'} PRECEDING AND CURRENT ROW" if method == "ffill" else f"CURRENT ROW AND {limit or 'UNBOUNDED'} FOLLOWING"
    pick = "last_value" if method == "ffill" else "first_value"
    query(f"SELECT event_id, {pick}(x IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN {frame_}) AS x FROM {_GAPS}")(run)


for _name, _method, _limit in (("ffill", "ffill", None), ("ffill_limit", "ffill", 2), ("bfill", "bfill", None), ("bfill_limit", "bfill", 1)):
    _fill_query(_name, _method, _limit)


# --- positions -------------------------------------------------------------------------------------------------------

_NUMBERED = "(SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS r, count(*) OVER () AS n FROM customer)"


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal")


@query(f"SELECT (r - 10) // 7 AS rid, c_custkey, c_name FROM {_NUMBERED} WHERE r >= 10 AND r < n - 5 AND (r - 10) % 7 = 0")
def getitem_slice_step(spark, sf_dir):
    return rows.slice_rows(_customers(spark, sf_dir).select("c_custkey", "c_name"), 10, -5, 7, ["c_custkey"])


@query(f"SELECT (n - 1 - r) // 3 AS rid, c_custkey FROM {_NUMBERED} WHERE (n - 1 - r) % 3 = 0")
def getitem_slice_negative_step(spark, sf_dir):
    return rows.slice_rows(_customers(spark, sf_dir).select("c_custkey"), None, None, -3, ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE coalesce(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal > 0 END, false)")
def mask_filter(spark, sf_dir):
    return rows.filter_mask(_customers(spark, sf_dir), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") > 0)).select("c_custkey")


@query(f"WITH i AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE -p_size END AS idx FROM part) SELECT pos, c_custkey, c_name FROM i JOIN {_NUMBERED} c ON c.r = CASE WHEN idx < 0 THEN idx + n ELSE idx END")
def take_negative(spark, sf_dir):
    part = table(spark, sf_dir, "part", "p_partkey", "p_size")
    idx = part.select(F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size")).otherwise(-F.col("p_size")).alias("idx"))
    return rows.take(_customers(spark, sf_dir).select("c_custkey", "c_name"), idx, ["c_custkey"])


@query(f"WITH i AS (SELECT p_partkey AS pos, CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE p_size END AS idx FROM part) SELECT pos, c_custkey, CASE WHEN idx = -1 THEN 'missing' ELSE c_name END AS c_name FROM i LEFT JOIN {_NUMBERED} c ON c.r = idx")
def take_fill(spark, sf_dir):
    part = table(spark, sf_dir, "part", "p_partkey", "p_size")
    idx = part.select(F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 3 == 0, F.lit(-1)).otherwise(F.col("p_size")).alias("idx"))
    return rows.take(_customers(spark, sf_dir).select("c_custkey", "c_name"), idx, ["c_custkey"], allow_fill=True, fill_value="missing")


@query("SELECT vec_id, embedding[1] AS a, embedding[64] AS z FROM (SELECT n.pos, e.vec_id, e.embedding FROM (SELECT unnest([2, 0, 2, 7]) AS r, unnest([0, 1, 2, 3]) AS pos) n JOIN (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings) e USING (r))")
def take_lists(spark, sf_dir):
    idx = spark.createDataFrame([(0, 2), (1, 0), (2, 2), (3, 7)], "pos int, idx int")
    got = rows.take(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), idx, ["vec_id"])
    return got.select("vec_id", F.col("embedding")[0].alias("a"), F.col("embedding")[63].alias("z"))


@query("SELECT c_custkey, CASE WHEN coalesce(CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal < 0 END, false) THEN 0.0 ELSE c_acctbal END AS v FROM customer")
def setitem_mask(spark, sf_dir):
    mask = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") < 0)
    return _customers(spark, sf_dir).select("c_custkey", rows.set_where(F.col("c_acctbal"), mask, 0.0).alias("v"))


@query(f"SELECT c_custkey, CASE r WHEN 3 THEN 'three' WHEN 5 THEN NULL WHEN n - 1 THEN 'last' ELSE c_name END AS c_name FROM {_NUMBERED}")
def setitem_positions(spark, sf_dir):
    return rows.setitem(_customers(spark, sf_dir).select("c_custkey", "c_name"), "c_name", [3, 5, -1], ["three", None, "last"], ["c_custkey"])


@query("SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, unnest(embedding) AS value FROM embeddings")
def flatten_list(spark, sf_dir):
    return rows.flatten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "embedding", "vec_id")


@query("SELECT 0 AS part, CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT 1, CAST(r_regionkey AS BIGINT) FROM region UNION ALL SELECT 2, p_partkey FROM part")
def concat(spark, sf_dir):
    pick = lambda t, c: table(spark, sf_dir, t, c).select(F.col(c).cast("bigint").alias("k"))
    return rows.concat(pick("nation", "n_nationkey"), pick("region", "r_regionkey"), pick("part", "p_partkey"))


@query("SELECT event_id, value, lag(value, 3, -1.0) OVER (ORDER BY event_id) AS shifted FROM events")
def shift(spark, sf_dir):
    return rows.shift(table(spark, sf_dir, "events", "event_id", "value"), "value", 3, ["event_id"], fill_value=-1.0)


@query("SELECT event_id, value, lead(value, 2) OVER (ORDER BY event_id) AS shifted FROM events")
def shift_back(spark, sf_dir):
    return rows.shift(table(spark, sf_dir, "events", "event_id", "value"), "value", -2, ["event_id"])


@query("SELECT event_id, user_id - lag(user_id) OVER (ORDER BY event_id) AS diff FROM events")
def diff(spark, sf_dir):
    return frame.diff(table(spark, sf_dir, "events", "event_id", "user_id"), "user_id", 1, ["event_id"]).select("event_id", "diff")


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS t, CAST(round(p_retailprice) AS BIGINT) AS b, CAST(CAST(p_size AS VARCHAR) AS INTEGER) AS i FROM part")
def astype(spark, sf_dir):
    df = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    text = rows.cast(F.col("p_size"), "string")
    return df.select("p_partkey", text.alias("t"), F.round("p_retailprice").cast("bigint").alias("b"), rows.cast(text, "int").alias("i"))


@query("SELECT p_partkey, '[''' || replace(p_name, ' ', ''', ''') || ''']' AS t FROM part")
def astype_list_str(spark, sf_dir):
    from pyspark.sql.types import ArrayType, StringType

    df = table(spark, sf_dir, "part", "p_partkey", "p_name")
    return df.select("p_partkey", rows.cast(F.split("p_name", " "), "string", ArrayType(StringType())).alias("t"))


@query(f"SELECT c_custkey FROM {_NUMBERED} WHERE r NOT IN (0, 4, 9)")
def delete_positions(spark, sf_dir):
    return frame.delete(_customers(spark, sf_dir).select("c_custkey"), [0, 4, 9], ["c_custkey"])


@query("SELECT n_nationkey FROM nation, range(3)")
def repeat_rows(spark, sf_dir):
    return frame.repeat(table(spark, sf_dir, "nation", "n_nationkey"), 3)


# --- groups, joins, orders -------------------------------------------------------------------------------------------


@query("SELECT k, CAST(sum(o_custkey) AS BIGINT) AS s FROM (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS k, o_custkey FROM orders) WHERE k IS NOT NULL GROUP BY k")
def groupby_sum_dropna(spark, sf_dir):
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_custkey").withColumn("k", with_nulls("o_orderkey", "o_orderstatus"))
    return frame.group_agg(df, ["k"], {"s": F.sum("o_custkey")})


@query("SELECT o_orderkey, o_custkey - min(o_custkey) OVER (PARTITION BY o_orderpriority) AS v FROM orders")
def groupby_transform(spark, sf_dir):
    df = table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_custkey")
    return frame.group_transform(df, ["o_orderpriority"], F.min("o_custkey"), "low").select("o_orderkey", (F.col("o_custkey") - F.col("low")).alias("v"))


@query("SELECT c_nationkey, CAST(max(c_custkey) - min(c_custkey) AS BIGINT) AS span FROM customer GROUP BY c_nationkey")
def groupby_apply(spark, sf_dir):
    def span(pdf):
        return pdf.head(1)[["c_nationkey"]].assign(span=int(pdf["c_custkey"].max() - pdf["c_custkey"].min()))

    return frame.group_apply(table(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), ["c_nationkey"], span, "c_nationkey int, span bigint")


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def merge_inner(spark, sf_dir):
    orders, customer, nation = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey"), table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    both = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return both.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT p_partkey, n_nationkey FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS a FROM part) x JOIN (SELECT n_nationkey, CASE WHEN n_nationkey % 7 <> 0 THEN n_nationkey END AS b FROM nation) y ON a IS NOT DISTINCT FROM b")
def merge_null_keys(spark, sf_dir):
    a = table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", with_nulls("p_partkey", "p_size").alias("a"))
    b = table(spark, sf_dir, "nation", "n_nationkey").select("n_nationkey", with_nulls("n_nationkey", "n_nationkey").alias("b"))
    return frame.merge(a, b, "a", "b").select("p_partkey", "n_nationkey")


#: Unmatched rows on either side without leaving a row out: one key becomes null, one moves out of the other side's range.
@query("SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS a FROM customer) c FULL JOIN (SELECT s_suppkey, CASE WHEN s_nationkey = 5 THEN 105 ELSE s_nationkey END AS b FROM supplier) s ON a IS NOT DISTINCT FROM b")
def merge_outer_dups_all_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select("c_custkey", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("a"))
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey").select("s_suppkey", F.when(F.col("s_nationkey") == 5, 105).otherwise(F.col("s_nationkey")).alias("b"))
    return frame.merge(c, s, "a", "b", "full").select("c_custkey", "s_suppkey")


@query(f"SELECT event_id, {_X} AS x FROM events ORDER BY x ASC NULLS LAST, event_id")
def sort_nulls_last(spark, sf_dir):
    return frame.sort_values(_events(spark, sf_dir).select("event_id", "x"), "x", tie="event_id")


@query(f"SELECT event_id, row_number() OVER (ORDER BY x ASC NULLS LAST, event_id) - 1 AS rank FROM (SELECT event_id, {_X} AS x FROM events)")
def argsort(spark, sf_dir):
    return frame.argsort(_events(spark, sf_dir).select("event_id", "x"), "x", ["event_id"]).select("event_id", "rank")


@query("SELECT event_type, min(event_id) FILTER (value = lo) AS at_min, min(event_id) FILTER (value = hi) AS at_max FROM (SELECT *, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi FROM events) GROUP BY event_type")
def argmin_argmax(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_id", "event_type", "value")
    return df.groupBy("event_type").agg(frame.argmin(F.col("value"), F.col("event_id")).alias("at_min"), frame.argmax(F.col("value"), F.col("event_id")).alias("at_max"))


@query("SELECT event_type, count(*) FILTER (value < 25) AS at FROM events GROUP BY event_type")
def searchsorted(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_type", "value").groupBy("event_type").agg(frame.searchsorted(F.col("value"), 25.0).alias("at"))


@query(f"SELECT event_id, CASE WHEN coalesce({_B}, false) THEN value ELSE -1.0 END AS v FROM events")
def where(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_id", "value")
    return df.select("event_id", frame.where(F.col("value"), F.when(F.col("event_id") % 7 != 0, F.col("value") > 20), -1.0).alias("v"))


@query(f"SELECT event_id, coalesce({_X}, CASE WHEN event_id % 2 = 0 THEN value END) AS v FROM events")
def combine_first(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", frame.combine_first(F.col("x"), F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("v"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'seen' ELSE event_type END AS v FROM events")
def replace_values(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "event_type").select("event_id", frame.replace_values(F.col("event_type"), ["click", "view"], "seen").alias("v"))


@query("SELECT k AS n_nationkey, coalesce(n_name, 'none') AS n_name FROM (SELECT DISTINCT p_size AS k FROM part) LEFT JOIN nation ON k = n_nationkey")
def reindex(spark, sf_dir):
    keys = table(spark, sf_dir, "part", "p_size").distinct()
    return frame.reindex(table(spark, sf_dir, "nation", "n_nationkey", "n_name"), "n_nationkey", keys, "none")


@query("SELECT coalesce(a, b) AS k, x, y FROM (SELECT CASE WHEN n_nationkey > 3 THEN n_nationkey ELSE n_nationkey + 100 END AS a, n_name AS x FROM nation) FULL JOIN (SELECT r_regionkey AS b, r_name AS y FROM region) ON a = b")
def align_all_rows(spark, sf_dir):
    shifted = F.when(F.col("n_nationkey") > 3, F.col("n_nationkey")).otherwise(F.col("n_nationkey") + 100)
    a = table(spark, sf_dir, "nation", "n_nationkey", "n_name").select(shifted.alias("k"), "n_name")
    b = table(spark, sf_dir, "region", "r_regionkey", "r_name").withColumnsRenamed({"r_regionkey": "k"})
    return frame.align(a, b, "k", ("x", "y"))


@query("SELECT event_id, 'user_id' AS \"column\", user_id AS value FROM events UNION ALL SELECT event_id, 'double', user_id * 2 FROM events")
def stack(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_id", "user_id").withColumn("double", F.col("user_id") * 2)
    return frame.stack(df, "event_id", ["user_id", "double"])


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY o_custkey")
def unstack(spark, sf_dir):
    counts = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").groupBy("o_custkey", "o_orderstatus").count()
    wide = frame.unstack(counts, "o_custkey", "o_orderstatus", "count", ["F", "O"])
    return wide.select("o_custkey", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("SELECT count(DISTINCT event_type) AS n FROM events")
def hash_rows(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_type").select(frame.hash_rows(F.col("event_type")).alias("h")).agg(F.countDistinct("h").alias("n"))


_PREFIX = "list_sum(list_transform(range(1, least(length(p_brand), length('Brand#1' || p_type)) + 1), lambda i: CASE WHEN p_brand[1:i] = ('Brand#1' || p_type)[1:i] THEN 1 ELSE 0 END))"


@query(f"SELECT p_partkey, CAST(CASE WHEN p_partkey % 7 <> 0 THEN {_PREFIX} END AS BIGINT) AS n FROM part")
def apply_binary_str_prefix_len(spark, sf_dir):
    def prefix(a, n, b, m):
        k = 0
        while k < min(n, m) and a[k] == b[k]:
            k += 1
        return k

    df = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    other = F.concat(F.lit("Brand#1"), F.col("p_type"))
    return df.select("p_partkey", apply_binary_str(with_nulls("p_partkey", "p_brand"), other, func=prefix, output_dtype="bigint").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN array_to_string(string_split(p_brand, '')[1:1000:2], '') || '/' || p_type END AS v FROM part")
def apply_utf8_bytes(spark, sf_dir):
    """Every second byte of one text and the whole of another, written with the builder."""
    from ..functions.udf import apply_utf8

    def func(a, b, out):
        for i in range(len(a)):
            if a.is_null(i) or b.is_null(i):
                out.end_null()
                continue
            for k in range(0, a.byte_length(i), 2):
                out.put(a.view(i)[k])
            out.put(b"/")
            out.put(b.view(i))
            out.end_text()

    df = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    return df.select("p_partkey", apply_utf8(with_nulls("p_partkey", "p_brand"), F.col("p_type"), func=func).alias("v"))


@query(f"SELECT event_type, coalesce(bool_or(coalesce({_B}, true)), false) AS v FROM events GROUP BY event_type")
def ufunc_logical_or_reduce(spark, sf_dir):
    return _bools(spark, sf_dir).groupBy("event_type").agg(arith.ufunc("logical_or.reduce", F.col("a")).alias("v"))


# --- more of the data-frame contract ---------------------------------------------------------------------------------


@query(f"SELECT CAST(0 AS INTEGER) AS pos, (SELECT c_custkey FROM {_NUMBERED} WHERE r = 0) AS v UNION ALL SELECT 1, (SELECT c_custkey FROM {_NUMBERED} WHERE r = n - 3) UNION ALL SELECT 2, NULL")
def getitem_scalars(spark, sf_dir):
    df = _customers(spark, sf_dir).select("c_custkey")
    found = [rows.getitem(df, "c_custkey", i, ["c_custkey"]) for i in (0, -3, 10**9)]
    return spark.createDataFrame(list(enumerate(found)), "pos int, v bigint")


@query(f"SELECT c_custkey, CASE WHEN r BETWEEN 10 AND 19 AND r % 3 = 1 THEN 'X' ELSE c_name END AS c_name FROM {_NUMBERED}")
def setitem_slice(spark, sf_dir):
    return rows.setitem(_customers(spark, sf_dir).select("c_custkey", "c_name"), "c_name", slice(10, 20, 3), "X", ["c_custkey"])


@query(f"SELECT CASE WHEN r >= 5 THEN r + 1 ELSE r END AS rid, c_custkey FROM {_NUMBERED} UNION ALL SELECT 5, -1")
def insert_row(spark, sf_dir):
    return frame.insert(_customers(spark, sf_dir).select("c_custkey"), 5, {"c_custkey": -1}, ["c_custkey"])


@query(f"SELECT event_id, CASE WHEN ({_E}) IS NULL THEN 'none' ELSE reverse({_E}) END AS v FROM events")
def apply_elementwise(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", frame.apply_elementwise(F.col("e"), lambda x: "none" if x is None else x[::-1], "string").alias("v"))


@query("SELECT event_id, user_id <= event_id AS le, user_id + event_id AS s FROM events")
def combine(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_id", "user_id")
    a, b = F.col("user_id"), F.col("event_id")
    return df.select("event_id", frame.combine(a, b, lambda x, y: x <= y).alias("le"), frame.combine(a, b, arith.add).alias("s"))


@query("SELECT 'r_name' AS key, max(r_name) FILTER (r_regionkey = 0) AS \"0\", max(r_name) FILTER (r_regionkey = 1) AS \"1\", max(r_name) FILTER (r_regionkey = 2) AS \"2\", max(r_name) FILTER (r_regionkey = 3) AS \"3\", max(r_name) FILTER (r_regionkey = 4) AS \"4\" FROM region")
def transpose(spark, sf_dir):
    return frame.transpose(table(spark, sf_dir, "region", "r_regionkey", "r_name"), "r_regionkey")


@query("SELECT count(*) > 0 AS has_click, false AS has_other FROM events WHERE event_type = 'click'")
def contains_value(spark, sf_dir):
    df = table(spark, sf_dir, "events", "event_type")
    return spark.createDataFrame([(encode.contains_value(df, "event_type", "click"), encode.contains_value(df, "event_type", "no such"))], "has_click boolean, has_other boolean")


@query("SELECT CAST(r_regionkey AS DOUBLE) AS k, 0 AS part FROM region UNION ALL SELECT p_retailprice, 1 FROM part")
def concat_widened(spark, sf_dir):
    a = table(spark, sf_dir, "region", "r_regionkey").select(F.col("r_regionkey").alias("k"))
    b = table(spark, sf_dir, "part", "p_retailprice").select(F.col("p_retailprice").alias("k"))
    return rows.concat(a, b)


@query("SELECT count(*) AS size, CAST(sum(strlen(p_name)) AS BIGINT) AS text_bytes, count(*) * 4 AS int_bytes FROM part")
def metadata(spark, sf_dir):
    from ..sources.io import metadata as describe

    df = table(spark, sf_dir, "part", "p_name", "p_size")
    a, b = describe(df, "p_name"), describe(df, "p_size")
    return spark.createDataFrame([(a["size"], a["nbytes"], b["nbytes"])], "size bigint, text_bytes bigint, int_bytes bigint")


@query("SELECT doc_id, contains(text, 'the') AS c FROM documents")
def stream_text(spark, sf_dir):
    """The same expressions on a stream, run to its end into a table in the shared folder."""
    import uuid

    from ..functions.accessor import text_strict
    from ..streaming.stateless import read_parquet_stream, with_columns

    source = f"{sf_dir}/documents.parquet"
    schema = spark.read.parquet(source).schema
    base = f"{rows.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = with_columns(read_parquet_stream(spark, f"{source}*", schema), c=text_strict(F.col("text")).contains("the"))
    query_ = stream.select("doc_id", "c").writeStream.format("parquet").option("checkpointLocation", f"{base}/log").option("path", f"{base}/out").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema("doc_id bigint, c boolean").parquet(f"{base}/out")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def arrow_round_trip(spark, sf_dir):
    """Spark to Arrow and back: table, record batch and array."""
    from ..sources.io import from_arrow, to_arrow

    made = to_arrow(table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey"))
    whole = from_arrow(spark, made)
    batch = from_arrow(spark, made.select(["n_nationkey", "n_name"]).combine_chunks().to_batches()[0])
    keys = from_arrow(spark, made.column("n_nationkey"), "n_nationkey")
    return keys.join(batch, "n_nationkey").join(whole.select("n_nationkey", "n_regionkey"), "n_nationkey")


@query("SELECT p_partkey, p_name, p_size, p_brand FROM part")
def write_parquet(spark, sf_dir):
    """Written by brand in the shared folder, and read again."""
    import uuid

    from ..sources.io import write_parquet as write

    path = f"{rows.shared_folder(spark)}/write-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_brand"), path, partition_by=["p_brand"])
    return read_parquet(spark, path, ["p_partkey", "p_name", "p_size", "p_brand"])


@query("SELECT CAST(unnest([1, NULL, 3, NULL, 5]) AS BIGINT) AS value")
def from_sequence(spark, sf_dir):
    """A column from Python values, in which None and NaN are missing."""
    from ..sources.io import from_sequence as make

    return make(spark, [1, None, 3, float("nan"), 5], "int64")


@query("SELECT count(*) AS n, CAST(sum(r_regionkey) AS BIGINT) AS s FROM region")
def to_numpy(spark, sf_dir):
    from ..sources.io import to_numpy as fetch

    values = fetch(table(spark, sf_dir, "region", "r_regionkey"), "r_regionkey")
    return spark.createDataFrame([(int(values.size), int(values.sum()))], "n bigint, s bigint")


@query("SELECT kind, CAST(3 AS BIGINT) AS n FROM (VALUES ('bool'), ('int64'), ('double'), ('string')) t(kind)")
def example_values(spark, sf_dir):
    """Sample columns by type name, with how many rows each has."""
    from ..sources.io import from_sequence as make

    samples = {"bool": [True, None, False], "int64": [1, None, 2], "double": [0.5, None, 2.5], "string": ["a", None, "b"]}
    counts = [make(spark, values, kind).select(F.lit(kind).alias("kind"), "value").groupBy("kind").agg(F.count("*").alias("n")) for kind, values in samples.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("SELECT true AS itself, true AS in_any_order, false AS a_value_changed, false AS a_row_twice")
def equals(spark, sf_dir):
    df = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    changed = df.withColumn("n_name", F.when(F.col("n_nationkey") == 3, F.lit("x")).otherwise(F.col("n_name")))
    found = [frame.equals(df, other) for other in (df, df.orderBy(F.desc("n_name")), changed, df.union(df.where("n_nationkey = 3")))]
    return spark.createDataFrame([tuple(found)], "itself boolean, in_any_order boolean, a_value_changed boolean, a_row_twice boolean")


@query("SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS at FROM orders GROUP BY o_orderpriority")
def groupby_first_seen(spark, sf_dir):
    """Groups in the order in which they are first seen."""
    groups = frame.group_agg(table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority"), ["o_orderpriority"], {"n": F.count("*")}, first_seen="o_orderkey")
    return spark.createDataFrame([(*r, k) for k, r in enumerate(groups.toLocalIterator())], "o_orderpriority string, n bigint, at bigint")


#: Type names, and the Spark types that they stand for.
_KINDS = {"bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float": "float", "double": "double", "string": "string", "binary": "binary", "date32": "date", "list<item: string>": "array<string>"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _KINDS.items()) + ") t(name, kind)")
def parse_types(spark, sf_dir):
    from ..types import parse_dtype

    return spark.createDataFrame([(name, parse_dtype(name).simpleString()) for name in _KINDS], "name string, kind string")


@query(f"SELECT event_id, row_number() OVER (ORDER BY x ASC NULLS FIRST, event_id) - 1 AS rank FROM (SELECT event_id, {_X} AS x FROM events)")
def argsort_nulls_first(spark, sf_dir):
    return frame.argsort(_events(spark, sf_dir).select("event_id", "x"), "x", ["event_id"], na_position="first").select("event_id", "rank")


@query("SELECT coalesce(a, b) AS k, x, y FROM (SELECT n_nationkey AS a, n_name AS x FROM nation) FULL JOIN (SELECT r_regionkey * 10 AS b, r_name AS y FROM region) ON a = b")
def concat_columns(spark, sf_dir):
    a = table(spark, sf_dir, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("x"))
    b = table(spark, sf_dir, "region", "r_regionkey", "r_name").select((F.col("r_regionkey") * 10).alias("k"), F.col("r_name").alias("y"))
    return frame.concat_columns([a, b], "k")


@query("SELECT median(p_retailprice) AS price, median(p_size) AS size FROM part")
def median_by_position(spark, sf_dir):
    from ..operators.reduce import reduce

    df = table(spark, sf_dir, "part", "p_retailprice", "p_size")
    return spark.createDataFrame([(reduce(df, "p_retailprice", "median"), reduce(df, "p_size", "median"))], "price double, size double")


@query(f"SELECT r AS rid, c_custkey FROM (SELECT (r - 2) // 5 AS r, c_custkey FROM {_NUMBERED} WHERE r >= 2 AND (r - 2) % 5 = 0)")
def index_by_key(spark, sf_dir):
    """The indexer takes a slice; other kinds of keys must be refused."""
    df = _customers(spark, sf_dir).select("c_custkey")
    for key in ("a", 1.5, None, [0.5], [[0]]):
        try:
            rows.index(df, key, ["c_custkey"], "c_custkey")
        except IndexError:
            continue
        raise AssertionError(f"{key!r} was taken for an indexer")
    return rows.index(df, slice(2, None, 5), ["c_custkey"])


# --- flagship --------------------------------------------------------------------------------------------------------

FLAGSHIP_SQL = """
WITH l AS (
  SELECT replace(l_returnflag || l_linestatus, 'F', 'X') AS code, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS q,
    l_extendedprice * (1 - l_discount) AS revenue, l_discount, CASE WHEN l_orderkey % 5 <> 0 THEN l_tax END AS tax,
    CASE WHEN l_partkey % 11 <> 0 THEN l_returnflag END AS flag
  FROM lineitem
)
SELECT flag, count(*) AS n, count(*) FILTER (starts_with(code, 'A')) AS starts_a, round(coalesce(sum(revenue), 0), 2) AS revenue,
  round(coalesce(sum(q), 0) / count(*), 6) AS mean_all_rows, median(q) AS median, coalesce(bool_or(coalesce(tax > 0.07, true)), false) AS any_high_tax,
  min(substring(code, 2, 1)) AS status
FROM l WHERE coalesce((l_discount > 0.05) OR (tax IS NULL), false) AND flag IS NOT NULL GROUP BY flag
"""


@query(FLAGSHIP_SQL)
def flagship(spark, sf_dir):
    from ..functions.accessor import text_strict

    df = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    code = text_strict(text_strict(F.col("l_returnflag")).cat(F.col("l_linestatus"))).replace("F", "X")
    tax = F.when(F.col("l_orderkey") % 5 != 0, F.col("l_tax"))
    lines = df.select(
        code.alias("code"),
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("q"),
        arith.multiply(F.col("l_extendedprice"), arith.subtract(1, F.col("l_discount"))).alias("revenue"),
        "l_discount",
        tax.alias("tax"),
        F.when(F.col("l_partkey") % 11 != 0, F.col("l_returnflag")).alias("flag"),
    )
    kept = rows.filter_mask(lines, boolean.or_(F.col("l_discount") > 0.05, nulls.isna(F.col("tax"))))
    code = text_strict(F.col("code"))
    return frame.group_agg(
        kept,
        ["flag"],
        {
            "n": F.count("*"),
            "starts_a": F.count_if(code.startswith("A")),
            "revenue": F.round(reduce_expr("sum", F.col("revenue")), 2),
            "mean_all_rows": F.round(reduce_expr("mean_all_rows", F.col("q")), 6),
            "median": reduce_expr("median", F.col("q")),
            "any_high_tax": boolean.any_(F.col("tax") > 0.07),
            "status": F.min(code.slice(1, 2)),
        },
    )
