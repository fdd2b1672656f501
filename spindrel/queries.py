"""The driver's queries: rule programs over the star schema, each with its SQL."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrel.session import Session

#: Columns that are unique together; none where rows may repeat.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"],
    "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"],
    "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": [], "conversations": [],
}


def session_for(spark: SparkSession, sf_dir: str, script: str) -> Session:
    """A session with the tables that a script names."""
    session = Session(spark)
    for name in sorted(set(re.findall(r"[*~]([a-z]+)[{\[:]", script)) & set(KEYS)):
        session.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), KEYS[name])
    return session


@dataclass(frozen=True)
class Query:
    script: str
    columns: tuple[str, ...]
    sql: str | None
    texts: tuple[str, ...] = ()  # list columns, given as joined text
    prepare: Callable[[Session, str], dict | None] | None = None  # may give the script's parameters
    finish: Callable[[DataFrame], DataFrame] | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        session = session_for(spark, sf_dir, self.script)
        params = self.prepare(session, sf_dir) if self.prepare else None
        df = session.run(self.script, params)
        df = self.finish(df) if self.finish else df
        df = df.toDF(*self.columns)
        for c in self.texts:
            df = df.withColumn(c, joined(F.col(c)))
        return df


def joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ",")


Q: dict[str, Query] = {}


def add(name: str, script: str, columns: str, sql: str | None, texts: str = "", prepare=None, finish=None) -> None:
    Q[name] = Query(script, tuple(columns.split()), sql, tuple(texts.split()), prepare, finish)


# --- scans, joins, sets -------------------------------------------------------------

add(
    "agg_sum_count",
    "?[l_returnflag, sum(l_quantity), count(l_orderkey)] := *lineitem{l_returnflag, l_quantity, l_orderkey}",
    "flag sum_qty n",
    "SELECT l_returnflag AS flag, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem GROUP BY 1",
)
add(
    "scan_filter_project",
    "?[k, p] := *orders{o_orderkey: k, o_totalprice: p}, p > 1000.0",
    "k p",
    "SELECT DISTINCT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 1000",
)
add(
    "scan_constant_argument",
    "?[k, p] := *orders{o_orderkey: k, o_orderstatus: 'F', o_totalprice: p}",
    "k p",
    "SELECT DISTINCT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F'",
)
add(
    "join_two_hop",
    "?[c, n, r] := *customer{c_custkey: c, c_nationkey: nk}, *nation{n_nationkey: nk, n_name: n, n_regionkey: rk}, *region{r_regionkey: rk, r_name: r}",
    "c n r",
    "SELECT c_custkey AS c, n_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
add(
    "join_theta",
    "?[a, b] := *supplier{s_suppkey: a, s_nationkey: n, s_acctbal: x}, *supplier{s_suppkey: b, s_nationkey: n, s_acctbal: y}, x < y",
    "a b",
    "SELECT DISTINCT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_acctbal < y.s_acctbal",
)
add(
    "join_computed",
    "?[a, b] := *lineitem{l_orderkey: o, l_linenumber: n, l_partkey: a}, *lineitem{l_orderkey: o, l_linenumber: n + 1, l_partkey: b}",
    "a b",
    "SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1",
)
add("cross_product", "?[a, b] := *region{r_name: a}, *region{r_name: b}, a != b", "a b", "SELECT x.r_name AS a, y.r_name AS b FROM region x, region y WHERE x.r_name <> y.r_name")
add("implicit_equality", "?[k] := *nation[k, _, k]", "k", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey = n_regionkey")
add(
    "implicit_equality_computed",
    "?[o, n, p] := *lineitem[o, n, p, s, n + 1, _, _, _, _, _, _]",
    "o n p",
    "SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_partkey AS p FROM lineitem WHERE l_quantity = l_linenumber + 1",
)
add(
    "semi_join",
    "?[c, n] := *customer{c_custkey: c, c_name: n}, *orders{o_custkey: c}",
    "c n",
    "SELECT c_custkey AS c, c_name AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
)
add(
    "negated_predicate",
    "?[k] := *part{p_partkey: k, p_size: s, p_brand: b}, not (s > 3, b != 'Brand#17'), not s == 2",
    "k",
    "SELECT p_partkey AS k FROM part WHERE NOT (p_size > 3 AND p_brand <> 'Brand#17') AND p_size <> 2",
)
add(
    "anti_join",
    "?[c] := *customer{c_custkey: c}, not *orders{o_custkey: c, o_orderstatus: 'P'}",
    "c",
    "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
)
add(
    "anti_join_rule",
    "big[c] := *orders{o_custkey: c, o_totalprice: p}, p > 100000.0  ?[c, n] := *customer{c_custkey: c, c_name: n}, not big[c]",
    "c n",
    "SELECT c_custkey AS c, c_name AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)",
)
add(
    "union_disjunction",
    "x[k] := *part{p_partkey: k, p_size: s}, (s < 3 or s > 48)  x[k] := *part{p_partkey: k, p_retailprice: p}, p > 1900.0  ?[k] := x[k]",
    "k",
    "SELECT p_partkey AS k FROM part WHERE p_size < 3 OR p_size > 48 UNION SELECT p_partkey FROM part WHERE p_retailprice > 1900",
)
add(
    "difference_intersection",
    "a[n] := *customer{c_nationkey: n, c_acctbal: b}, b < 0.0  s[n] := *supplier{s_nationkey: n, s_acctbal: b}, b < 0.0  ?[n, both] := a[n], s[n], both = true  ?[n, both] := a[n], not s[n], both = false",
    "n both",
    "WITH a AS (SELECT DISTINCT c_nationkey AS n FROM customer WHERE c_acctbal < 0), s AS (SELECT DISTINCT s_nationkey AS n FROM supplier WHERE s_acctbal < 0) SELECT n, n IN (SELECT n FROM s) AS both FROM a",
)
add("spread", "?[r, x] := *region{r_regionkey: r}, x in int_range(r + 1)", "r x", "SELECT r_regionkey AS r, unnest(range(r_regionkey + 1)) AS x FROM region")
add("constant_rows", "a[x, y] <- [[1, 'a'], [2, 'b'], [1, 'a']]  ?[x, y] := a[x, y]", "x y", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) t(x, y)")
add(
    "null_joins_null",
    "a[x] := *region{r_regionkey: r}, x = if(r > 2, null, r)  b[x, y] := *region{r_regionkey: r}, x = if(r > 3, null, r), y = r  ?[x, y] := a[x], b[x, y]",
    "x y",
    "WITH a AS (SELECT DISTINCT CASE WHEN r_regionkey > 2 THEN NULL ELSE r_regionkey END AS x FROM region), b AS (SELECT CASE WHEN r_regionkey > 3 THEN NULL ELSE r_regionkey END AS x, r_regionkey AS y FROM region) SELECT a.x, b.y FROM a JOIN b ON a.x IS NOT DISTINCT FROM b.x",
)
add(
    "having",
    "t[c, sum(p), count(p)] := *orders{o_custkey: c, o_totalprice: p}  ?[c, n] := t[c, s, n], s > 500000.0",
    "c n",
    "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 500000",
)

# --- sort and limit -----------------------------------------------------------------

add(
    "topk",
    "?[k, p] := *orders{o_orderkey: k, o_totalprice: p} :order -p, k :limit 10",
    "k p",
    "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY 2 DESC, 1 LIMIT 10",
)
add(
    "topk_offset",
    "?[k, p] := *part{p_partkey: k, p_retailprice: p} :order p, -k :limit 7 :offset 5",
    "k p",
    "SELECT p_partkey AS k, p_retailprice AS p FROM part ORDER BY 2, 1 DESC LIMIT 7 OFFSET 5",
)
add(
    "rank",
    "c[n, count(k)] := *customer{c_custkey: k, c_nationkey: n}  ?[] <~ ReorderSort(c[n, k], out: [n, k], sort_by: [k], descending: true)",
    "rank n k",
    "SELECT rank() OVER (ORDER BY k DESC) AS rank, n, k FROM (SELECT c_nationkey AS n, count(*) AS k FROM customer GROUP BY 1)",
)
add(
    "rank_break_ties",
    "c[n, count(k)] := *customer{c_custkey: k, c_nationkey: n}  ?[] <~ ReorderSort(c[n, k], out: [n, k], sort_by: [k, n], break_ties: true, skip: 2, take: 9)",
    "rank n k",
    "SELECT rank, n, k FROM (SELECT row_number() OVER (ORDER BY k, n) AS rank, n, k FROM (SELECT c_nationkey AS n, count(*) AS k FROM customer GROUP BY 1)) WHERE rank BETWEEN 3 AND 11",
)

# --- aggregates ---------------------------------------------------------------------

_F = "l_returnflag: f"


def add_aggregate(name: str, column: str, expression: str, sql: str, texts: str = "") -> None:
    """One aggregate of lineitem by return flag."""
    setup = f"*lineitem{{{_F}, {column}}}" + (f", v = {expression}" if expression != "v" else "")
    add(f"agg_{name}", f"t[f, {name}(v)] := {setup}  ?[f, v] := t[f, v]", "f v", f"SELECT l_returnflag AS f, {sql} AS v FROM lineitem GROUP BY 1", texts)


add_aggregate("and", "l_quantity", "l_quantity > 1.0", "bool_and(l_quantity > 1)")
add_aggregate("or", "l_quantity", "l_quantity > 49.5", "bool_or(l_quantity > 49.5)")
add_aggregate("unique", "l_linenumber: v", "v", "array_to_string(list_sort(list(DISTINCT l_linenumber)), ',')", "v")
add_aggregate("count_unique", "l_partkey: v", "v", "count(DISTINCT l_partkey)")
add_aggregate("count", "l_partkey: v", "v", "count(*)")
add_aggregate("union", "l_linenumber", "[l_linenumber, l_linenumber + 1]", "array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT l_linenumber), list(DISTINCT l_linenumber + 1)))), ',')", "v")
add(
    "agg_intersection",
    "t[c, intersection(v)] := *orders{o_custkey: c, o_orderstatus: s, o_orderpriority: p}, v = [p, s, 'X']  ?[c, v] := t[c, w], v = sorted(w)",
    "c v",
    "WITH e AS (SELECT o_custkey AS c, o_orderkey AS k, unnest([o_orderpriority, o_orderstatus, 'X']) AS x FROM orders), n AS (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1), "
    "held AS (SELECT c, x, count(DISTINCT k) AS m FROM e GROUP BY 1, 2) SELECT c, string_agg(x, ',' ORDER BY x) AS v FROM held JOIN n USING (c) WHERE m = n GROUP BY c",
    "v",
)
add_aggregate("min", "l_extendedprice: v", "v", "min(l_extendedprice)")
add_aggregate("max", "l_extendedprice: v", "v", "max(l_extendedprice)")
for _name, _sql in (("variance", "var_samp(l_quantity)"), ("std_dev", "stddev_samp(l_quantity)"), ("mean", "avg(l_quantity)")):
    add(
        f"agg_{_name}",
        f"t[f, {_name}(v)] := *lineitem{{{_F}, l_quantity: v}}  ?[f, r] := t[f, v], r = round(v * 10000) / 10000",
        "f v",
        f"SELECT l_returnflag AS f, round({_sql} * 10000) / 10000 AS v FROM lineitem GROUP BY 1",
    )
add(
    "agg_sum",
    f"t[f, sum(v)] := *lineitem{{{_F}, l_extendedprice: p, l_discount: d}}, v = p * (1 - d)  ?[f, r] := t[f, v], r = round(v)",
    "f v",
    "SELECT l_returnflag AS f, round(sum(l_extendedprice * (1 - l_discount))) AS v FROM lineitem GROUP BY 1",
)
add("agg_product", "?[n, product(v)] := *nation{n_regionkey: n, n_nationkey: k}, v = k + 1", "n v", "SELECT n_regionkey AS n, product(n_nationkey + 1) AS v FROM nation GROUP BY 1")
add(
    "agg_group_count",
    "t[f, group_count(v)] := *lineitem{l_returnflag: f, l_linestatus: v}  ?[f, x, n] := t[f, p], q in p, x = first(q), n = last(q)",
    "f x n",
    "SELECT l_returnflag AS f, l_linestatus AS x, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
add(
    "agg_collect",
    "t[r, collect(k)] := *nation{n_regionkey: r, n_nationkey: k}  ?[r, k] := t[r, k]",
    "r v",
    "SELECT n_regionkey AS r, array_to_string(list_sort(list(n_nationkey)), ',') AS v FROM nation GROUP BY 1",
    "v",
)
add(
    "agg_latest_by",
    "?[c, latest_by(v)] := *orders{o_orderkey: k, o_custkey: c, o_totalprice: p}, v = [k, p]",
    "c k",
    "SELECT o_custkey AS c, arg_max(o_orderkey, o_totalprice)::BIGINT AS k FROM orders GROUP BY 1",
)
add(
    "agg_smallest_by",
    "?[c, smallest_by(v)] := *orders{o_orderkey: k, o_custkey: c, o_totalprice: p}, v = [k, p]",
    "c k",
    "SELECT o_custkey AS c, arg_min(o_orderkey, o_totalprice)::BIGINT AS k FROM orders GROUP BY 1",
)
add(
    "agg_min_cost",
    "t[c, min_cost(v)] := *orders{o_orderkey: k, o_custkey: c, o_totalprice: p}, v = [concat('o', to_string(k)), p]  ?[c, k, p] := t[c, v], k = first(v), p = last(v)",
    "c k p",
    "SELECT o_custkey AS c, 'o' || arg_min(o_orderkey, o_totalprice) AS k, min(o_totalprice) AS p FROM orders GROUP BY 1",
)
add(
    "agg_shortest",
    "t[r, shortest(v)] := *nation{n_regionkey: r, n_name: x}, v = chars(x)  ?[r, n] := t[r, v], n = length(v)",
    "r n",
    "SELECT n_regionkey AS r, min(length(n_name)) AS n FROM nation GROUP BY 1",
)
add("agg_choice", "t[r, choice(v)] := *nation{n_regionkey: r}, v = r * 2  ?[r, v] := t[r, v]", "r v", "SELECT DISTINCT n_regionkey AS r, n_regionkey * 2 AS v FROM nation")
for _name in ("bit_and", "bit_or", "bit_xor"):
    add(
        f"agg_{_name}",
        f"t[r, {_name}(v)] := *nation{{n_regionkey: r, n_nationkey: k}}, v = pack_bits([false, false, false, mod(div(k, 16.0), 2.0) >= 1.0, mod(div(k, 8.0), 2.0) >= 1.0, mod(div(k, 4.0), 2.0) >= 1.0, mod(div(k, 2.0), 2.0) >= 1.0, k % 2 == 1])  ?[r, v] := t[r, b], v = encode_base64(b)",
        "r v",
        f"SELECT n_regionkey AS r, to_base64(unhex(lpad(to_hex({_name}(n_nationkey::BIGINT)), 2, '0'))) AS v FROM nation GROUP BY 1",
    )
add("agg_choice_rand", "t[r, choice_rand(k)] := *nation{n_regionkey: r, n_nationkey: k}  ?[r, in_region] := t[r, k], *nation{n_nationkey: k, n_regionkey: q}, in_region = q == r", "r ok", "SELECT DISTINCT n_regionkey AS r, true AS ok FROM nation")
add("agg_empty", "?[count(a), min(a), sum(a), product(a)] := a in []", "n least total product", "SELECT 0::BIGINT AS n, NULL::BIGINT AS least, 0.0::DOUBLE AS total, 1.0::DOUBLE AS product")
add(
    "agg_multi_stratum",
    "a[count(k)] := *customer{c_custkey: k}  b[count(k)] := *orders{o_orderkey: k}  ?[x] := a[a], b[b], x = a + b",
    "x",
    "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS x",
)
add(
    "agg_two_definitions",
    "t[n, count(k)] := *customer{c_custkey: k, c_nationkey: n}  t[n, count(k)] := *supplier{s_suppkey: k, s_nationkey: n}  ?[n, c] := t[n, c]",
    "n c",
    "SELECT n, count(*) AS c FROM (SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1",
)

# --- scalar functions ---------------------------------------------------------------


def add_functions(name: str, table: str, key: str, outputs: list[tuple[str, str]], texts: str = "") -> None:
    """Several functions of each row of a table: (script, SQL) by output."""
    heads = [f"x{i}" for i in range(len(outputs))]
    atoms = ", ".join(f"x{i} = {script}" for i, (script, _) in enumerate(outputs))
    columns = ", ".join(sorted({c for s, _ in outputs for c in re.findall(rf"\b{key[0]}_\w+", s)} | {key}))
    sql = ", ".join(f"{q} AS x{i}" for i, (_, q) in enumerate(outputs))
    add(f"fn_{name}", f"?[{key}, {', '.join(heads)}] := *{table}{{{columns}}}, {atoms}", " ".join([key, *heads]), f"SELECT {key}, {sql} FROM {table}", texts)


add_functions(
    "comparison", "part", "p_partkey",
    [("p_size >= 25 && p_retailprice < 1500.0", "p_size >= 25 AND p_retailprice < 1500"), ("p_size == 7 || !(p_size != 8)", "p_size = 7 OR p_size = 8"),
     ("is_in(p_size, [1, 2, 3])", "p_size IN (1, 2, 3)"), ("if(p_size > 10, null, p_size) ~ 99", "CASE WHEN p_size > 10 THEN 99 ELSE p_size END"), ("is_null(p_name)", "p_name IS NULL"),
     ("cond(p_size < 10, 'small', p_size < 30, 'middle', 'large')", "CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END"), ("null == null", "true"), ("1 == 1.0", "true")],
)
add_functions(
    "arithmetic", "part", "p_partkey",
    [("p_size + 2 * 3 - 1", "p_size + 5"), ("p_size / 4", "p_size / 4.0::DOUBLE"), ("p_size % 7", "p_size % 7"), ("-p_size", "-p_size"), ("abs(10 - p_size)", "abs(10 - p_size)"),
     ("signum(25 - p_size)", "sign(25 - p_size)::BIGINT"), ("max(p_size, 20, 3)", "greatest(p_size, 20)"), ("min(p_size, 20)", "least(p_size, 20)"),
     ("floor(p_retailprice)", "floor(p_retailprice)"), ("ceil(p_retailprice)", "ceil(p_retailprice)"), ("round(p_retailprice)", "round(p_retailprice)"), ("is_infinite(p_size / 0)", "true"), ("p_size ^ 2", "(p_size * p_size)::DOUBLE")],
)
add_functions(
    "math", "supplier", "s_suppkey",
    [(f"round(1000000 * {a}) / 1000000", f"round(1000000 * {b}) / 1000000") for a, b in (
        ("sqrt(abs(s_acctbal))", "sqrt(abs(s_acctbal))"), ("exp(s_suppkey / 1000)", "exp(s_suppkey / 1000.0::DOUBLE)"), ("exp2(s_suppkey / 100)", "pow(2, s_suppkey / 100.0::DOUBLE)"),
        ("ln(s_suppkey)", "ln(s_suppkey)"), ("log2(s_suppkey)", "log2(s_suppkey)"), ("log10(s_suppkey)", "log10(s_suppkey)"))],
)
add_functions(
    "trigonometry", "supplier", "s_suppkey",
    [(f"round(1000000 * {a}) / 1000000", f"round(1000000 * {b}) / 1000000") for a, b in (
        *((f"{f}(s_suppkey / 200000)", f"{f}(s_suppkey / 200000.0::DOUBLE)") for f in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "atanh")),
        ("acosh(s_suppkey + 1)", "acosh(s_suppkey + 1)"), ("atan2(s_suppkey, 3)", "atan2(s_suppkey, 3)"), ("deg_to_rad(s_suppkey)", "radians(s_suppkey)"), ("rad_to_deg(s_suppkey)", "degrees(s_suppkey)"),
        ("haversine(s_suppkey / 2000, 0.1, 0.2, 0.3)", "2 * asin(sqrt(pow(sin((0.2 - s_suppkey / 2000.0::DOUBLE) / 2), 2) + cos(s_suppkey / 2000.0::DOUBLE) * cos(0.2::DOUBLE) * pow(sin(0.1::DOUBLE), 2)))"),
        ("haversine_deg_input(s_suppkey / 2000, 10, 20, 30)", "2 * asin(sqrt(pow(sin(radians(20 - s_suppkey / 2000.0::DOUBLE) / 2), 2) + cos(radians(s_suppkey / 2000.0::DOUBLE)) * cos(radians(20)) * pow(sin(radians(20) / 2), 2)))"))],
)
add_functions(
    "string", "part", "p_partkey",
    [("length(p_name)", "length(p_name)"), ("concat(p_brand, '-', p_type)", "p_brand || '-' || p_type"), ("p_brand ++ '!'", "p_brand || '!'"), ("lowercase(p_name)", "lower(p_name)"), ("uppercase(p_name)", "upper(p_name)"),
     ("str_includes(p_name, '1')", "contains(p_name, '1')"), ("starts_with(p_brand, 'Brand#1')", "starts_with(p_brand, 'Brand#1')"), ("ends_with(p_name, '7')", "ends_with(p_name, '7')"),
     ("slice_string(p_name, 1, 4)", "substring(p_name, 2, 3)"), ("trim(concat(' ', p_brand, '\\t\\n'))", "p_brand"), ("from_substrings(reverse(chars(p_brand)))", "reverse(p_brand)"), ("unicode_normalize(concat(p_brand, 'e\u0301A\u030a'), 'nfc')", "nfc_normalize(p_brand || 'e' || chr(769) || 'A' || chr(778))"),
     ("trim_start(concat(' ', p_brand, ' '))", "p_brand || ' '"), ("trim_end(concat(' ', p_brand, ' '))", "' ' || p_brand"), ("t2s(concat(p_brand, '漢語'))", "p_brand || '汉语'")],
)
add_functions(
    "regex", "part", "p_partkey",
    [("regex_matches(p_name, '[0-9]+$')", "regexp_matches(p_name, '[0-9]+$')"), ("regex_replace(p_name, '[0-9]', '#')", "regexp_replace(p_name, '[0-9]', '#')"), ("regex_replace_all(p_name, '[0-9]', '#')", "regexp_replace(p_name, '[0-9]', '#', 'g')"),
     ("regex_extract(p_name, '[0-9]')", "array_to_string(regexp_extract_all(p_name, '[0-9]'), ',')"), ("regex_extract_first(p_name, '[0-9]+')", "nullif(regexp_extract(p_name, '[0-9]+'), '')")],
    "x3",
)
add_functions(
    "list", "nation", "n_nationkey",
    [("[n_nationkey, n_regionkey, 7]", "array_to_string([n_nationkey, n_regionkey, 7], ',')"), ("append([1, 2], n_regionkey)", "array_to_string([1, 2, n_regionkey], ',')"), ("prepend([1, 2], n_regionkey)", "array_to_string([n_regionkey, 1, 2], ',')"),
     ("sorted([3, n_regionkey, 1])", "array_to_string(list_sort([3, n_regionkey, 1]), ',')"), ("reverse([3, n_regionkey, 1])", "array_to_string([1, n_regionkey, 3], ',')"), ("int_range(n_regionkey)", "array_to_string(range(n_regionkey), ',')"),
     ("union([1, 2], [n_regionkey])", "array_to_string(list_sort(list_distinct([1, 2, n_regionkey])), ',')"), ("intersection([1, 2, 3], [n_regionkey, 3])", "array_to_string(list_sort(list_distinct(list_filter([1, 2, 3], lambda x: x = n_regionkey OR x = 3))), ',')"),
     ("difference([1, 2, 3], [n_regionkey])", "array_to_string(list_filter([1, 2, 3], lambda x: x <> n_regionkey), ',')"), ("slice(int_range(10), n_regionkey, -2)", "array_to_string(range(n_regionkey, 8), ',')"),
     ("first(int_range(n_regionkey, 9))", "n_regionkey"), ("last(int_range(n_regionkey))", "CASE WHEN n_regionkey > 0 THEN n_regionkey - 1 END"), ("get([5, 6, 7, 8, 9], n_regionkey)", "n_regionkey + 5"), ("maybe_get([5], n_regionkey)", "CASE WHEN n_regionkey = 0 THEN 5 END"),
     ("length(chunks(int_range(n_nationkey), 3))", "ceil(n_nationkey / 3.0)::BIGINT"), ("length(chunks_exact(int_range(n_nationkey), 3))", "n_nationkey // 3"), ("length(windows(int_range(n_nationkey), 3))", "greatest(n_nationkey - 2, 0)")],
    "x0 x1 x2 x3 x4 x5 x6 x7 x8 x9",
)
add(
    "fn_vector",
    "?[i, a, b, c, d] := *embeddings{vec_id: i, embedding: v}, *embeddings{vec_id: 0, embedding: w}, a = round(100000 * l2_dist(v, w)) / 100000, b = round(100000 * ip_dist(v, w)) / 100000 + 0.0, c = round(100000 * cos_dist(v, w)) / 100000 + 0.0, n = l2_normalize(v), d = is_vec(n)",
    "i a b c d",
    "SELECT v.vec_id AS i, round(100000 * list_sum(list_transform(list_zip(v.embedding, w.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ^ 2))) / 100000 AS a, round(100000 * (1 - list_dot_product(v.embedding::DOUBLE[], w.embedding::DOUBLE[]))) / 100000 + 0.0 AS b, round(100000 * (1 - list_cosine_similarity(v.embedding::DOUBLE[], w.embedding::DOUBLE[]))) / 100000 + 0.0 AS c, true AS d FROM embeddings v, embeddings w WHERE w.vec_id = 0",
)
add_functions(
    "conversion", "part", "p_partkey",
    [("to_string(p_size)", "p_size::VARCHAR"), ("to_int(to_string(p_size))", "p_size"), ("to_float('2.5') + p_size", "2.5::DOUBLE + p_size"), ("to_bool(p_size - 1)", "p_size <> 1"), ("to_unity(p_size - 1)", "(p_size <> 1)::INT"),
     ("is_int(p_size)", "true"), ("is_float(p_retailprice)", "true"), ("is_string(p_name)", "true"), ("is_list([p_size])", "true"), ("is_num(p_name)", "false"), ("is_finite(p_retailprice)", "true"), ("is_nan(p_retailprice - p_retailprice)", "false"),
     ("to_uuid('F47AC10B-58CC-4372-A567-0E02B2C3D479')", "'f47ac10b-58cc-4372-a567-0e02b2c3d479'"), ("is_bytes(decode_base64('AA=='))", "true"),
     ("is_uuid(to_uuid('f47ac10b-58cc-4372-a567-0e02b2c3d479'))", "true"), ("is_uuid(p_name)", "false"), ("assert(p_size > 0, 'a size is above 0')", "true"), ("length(vec([p_size, 2, 3]))", "3")],
)
add_functions(
    "bytes", "nation", "n_nationkey",
    [("encode_base64(pack_bits([true, false, n_regionkey > 2]))", "CASE WHEN n_regionkey > 2 THEN 'oA==' ELSE 'gA==' END"), ("encode_base64(bit_not(decode_base64('/wA=')))", "'AP8='"), ("encode_base64(bit_and(decode_base64('8A=='), decode_base64('MA==')))", "'MA=='"),
     ("encode_base64(bit_or(decode_base64('8A=='), decode_base64('Dw==')))", "'/w=='"), ("encode_base64(bit_xor(decode_base64('8A=='), decode_base64('/w==')))", "'Dw=='"), ("length(unpack_bits(decode_base64('8A==')))", "8")],
)
add_functions(
    "json", "nation", "n_nationkey",
    [("dump_json({'a': n_nationkey, 'b': [1, 2]})", "'{\"a\":' || n_nationkey || ',\"b\":[1,2]}'"), ("dump_json(get(parse_json('{\"x\": [1, {\"y\": 5}]}'), ['x', 1, 'y']))", "'5'"), ("dump_json(set_json_path(json_object('k', 1), ['q', 'r'], n_regionkey))", "'{\"k\":1,\"q\":{\"r\":' || n_regionkey || '}}'"),
     ("dump_json(remove_json_path({'a': 1, 'b': 2}, ['a']))", "'{\"b\":2}'"), ("is_json(json(n_nationkey))", "true"), ("dump_json(concat({'a': 1}, {'b': 2}))", "'{\"a\":1,\"b\":2}'"), ("dump_json({'z': 1} -> 'z')", "'1'"),
     ("json_to_scalar(get(parse_json(concat('{\"n\": \"', n_name, '\"}')), ['n'])) == n_name", "true")],
)
add_functions(
    "time", "nation", "n_nationkey",
    [("format_timestamp(n_nationkey * 86400)", "strftime(make_timestamp(n_nationkey::BIGINT * 86400000000), '%Y-%m-%dT%H:%M:%S+00:00')"), ("parse_timestamp('1970-01-02T00:00:00Z') + n_nationkey", "86400.0::DOUBLE + n_nationkey"), ("now() > 1700000000", "true"),
     ("to_int(validity(n_nationkey, false))", "n_nationkey"), ("uuid_timestamp(rand_uuid_v1()) > 1700000000", "true")],
)
add(
    "fn_random",
    "?[k, a, b, c, d, e] := *nation{n_nationkey: k}, f = rand_float(), a = f >= 0.0 && f < 1.0, i = rand_int(1, 3), b = i >= 1 && i <= 3, h = rand_choose([4, 5]), c = h == 4 || h == 5, u = rand_uuid_v4(), d = length(u), w = rand_vec(8), e = length(w), z = rand_bernoulli(0.5)",
    "k a b c d e",
    "SELECT n_nationkey AS k, true AS a, true AS b, true AS c, 36::BIGINT AS d, 8::BIGINT AS e FROM nation",
)

# --- recursion and graphs -----------------------------------------------------------

#: Parts that follow each other within an order.
HOP = "hop[a, b] := *lineitem{l_orderkey: o, l_linenumber: n, l_partkey: a}, *lineitem{l_orderkey: o, l_linenumber: n + 1, l_partkey: b} "
HOP_SQL = "hop AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1)"
#: Hops from part 1 to every part that it reaches, which may be itself again.
FAR_SQL = f"WITH RECURSIVE {HOP_SQL}, far AS (SELECT b, 1 AS n FROM hop WHERE a = 1 UNION SELECT h.b, far.n + 1 FROM far JOIN hop h ON h.a = far.b WHERE far.n < 30), hops AS (SELECT b, min(n)::BIGINT AS n FROM far GROUP BY 1) "
#: The cheapest line between a customer's nation and a supplier's.
TRADE = "trade[a, b, min(w)] := *customer{c_custkey: c, c_nationkey: a}, *orders{o_orderkey: o, o_custkey: c}, *lineitem{l_orderkey: o, l_suppkey: s, l_extendedprice: w}, *supplier{s_suppkey: s, s_nationkey: b}, a != b "
TRADE_SQL = "trade AS (SELECT c_nationkey AS a, s_nationkey AS b, min(l_extendedprice) AS w FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"


def relaxed(rounds: int = 12) -> str:
    """SQL of the cheapest costs from nation 0, relaxing all edges so many times."""
    steps = ["d0 AS (SELECT 0 AS n, 0.0::DOUBLE AS c)"]
    for i in range(1, rounds + 1):
        steps.append(f"d{i} AS (SELECT n, min(c) AS c FROM (SELECT * FROM d{i - 1} UNION ALL SELECT b, d.c + w FROM d{i - 1} d JOIN trade ON a = d.n) GROUP BY 1)")
    return f"WITH {TRADE_SQL}, {', '.join(steps)} "


_FROM_ONE = "t[b] := hop[1, b]  t[b] := t[a], hop[a, b] "
add("reachable", HOP + _FROM_ONE + "?[b] := t[b]", "b", f"WITH RECURSIVE {HOP_SQL}, t AS (SELECT b FROM hop WHERE a = 1 UNION SELECT h.b FROM t JOIN hop h ON h.a = t.b) SELECT b FROM t")
add(
    "reachable_bound",
    HOP + "t[a, b] := hop[a, b]  t[a, c] := t[a, b], hop[b, c]  ?[b] := t[2, b]",
    "b",
    f"WITH RECURSIVE {HOP_SQL}, t AS (SELECT b FROM hop WHERE a = 2 UNION SELECT h.b FROM t JOIN hop h ON h.a = t.b) SELECT b FROM t",
)
add(
    "closure_nonlinear",
    "e[a, b] := *nation{n_nationkey: a, n_regionkey: b}  t[a, b] := e[a, b]  t[a, c] := t[a, b], t[b, c]  ?[a, c] := t[a, c]",
    "a c",
    "WITH RECURSIVE t AS (SELECT n_nationkey AS a, n_regionkey AS c FROM nation UNION SELECT t.a, n_regionkey FROM t JOIN nation ON n_nationkey = t.c) SELECT a, c FROM t",
)
add(
    "shortest_hops",
    HOP + "d[b, min(n)] := hop[1, b], n = 1  d[b, min(n)] := d[a, m], hop[a, b], n = m + 1  ?[b, n] := d[b, n]",
    "b n",
    FAR_SQL + "SELECT b, n FROM hops",
)
add(
    "min_cost_path",
    TRADE + "d[b, min_cost(p)] := trade[0, b, c], p = [['0'], c]  d[b, min_cost(p)] := d[a, q], trade[a, b, w], p = [append(first(q), to_string(a)), last(q) + w]  ?[b, c] := d[b, p], b != 0, c = round(last(p) * 100) / 100",
    "b c",
    relaxed() + "SELECT n AS b, round(c * 100) / 100 AS c FROM d12 WHERE n <> 0",
)
add(
    "mutual_recursion",
    HOP + "o[b] := hop[1, b]  o[b] := e[a], hop[a, b]  e[b] := o[a], hop[a, b]  ?[b, even] := e[b], even = true  ?[b, even] := o[b], even = false",
    "b even",
    f"WITH RECURSIVE {HOP_SQL}, t AS (SELECT b, false AS even FROM hop WHERE a = 1 UNION SELECT h.b, NOT t.even FROM t JOIN hop h ON h.a = t.b) SELECT b, even FROM t",
)
add(
    "stratified_negation",
    HOP + "t[b] := hop[1, b]  t[b] := t[a], hop[a, b], a < b  all[p] := hop[p, _]  all[p] := hop[_, p]  ?[p] := all[p], not t[p]",
    "p",
    f"WITH RECURSIVE {HOP_SQL}, t AS (SELECT b FROM hop WHERE a = 1 UNION SELECT h.b FROM t JOIN hop h ON h.a = t.b AND t.b < h.b) SELECT a AS p FROM hop WHERE a NOT IN (SELECT b FROM t) UNION SELECT b FROM hop WHERE b NOT IN (SELECT b FROM t)",
)
#: Who supplies what.
SUPPLY = "e[a, b] := *lineitem{l_suppkey: s, l_partkey: p}, a = concat('s', to_string(s)), b = concat('p', to_string(p)) "
SUPPLY_SQL = "e AS (SELECT DISTINCT 's' || l_suppkey AS a, 'p' || l_partkey AS b FROM lineitem)"


def spread_sql(rounds: int = 12) -> str:
    """CTEs of the smallest node that reaches each node of ``u`` (a, b) within so many steps."""
    steps = ["r0 AS (SELECT DISTINCT a AS n, a AS r FROM u)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS (SELECT n, min(r) AS r FROM (SELECT * FROM r{i - 1} UNION ALL SELECT b, r FROM u JOIN r{i - 1} ON n = a) GROUP BY 1)")
    return ", ".join(steps)


add(
    "graph_degree",
    SUPPLY + "?[] <~ DegreeCentrality(e[])",
    "node total outs ins",
    f"WITH {SUPPLY_SQL} SELECT node, sum(o + i)::BIGINT AS total, sum(o)::BIGINT AS outs, sum(i)::BIGINT AS ins FROM (SELECT a AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT b, 0, 1 FROM e) GROUP BY 1",
)
add(
    "graph_components",
    SUPPLY + "c[] <~ ConnectedComponents(e[])  m[g, min_name] := c[n, g], min_name = n  l[g, smallest_by(p)] := c[n, g], p = [n, n]  ?[n, r] := c[n, g], l[g, r]",
    "n r",
    f"WITH {SUPPLY_SQL}, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), {spread_sql()} SELECT n, r FROM r12",
)
add(
    "graph_clustering",
    TRADE + "u[a, b] := trade[a, b, _]  ?[] <~ ClusteringCoefficients(u[])",
    "node coefficient triangles degree",
    f"WITH {TRADE_SQL}, u AS (SELECT a, b FROM trade), e AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u), d AS (SELECT a AS node, count(*) AS degree FROM e GROUP BY 1), s AS (SELECT DISTINCT a, b FROM e), t AS (SELECT x.a AS node, count(*) AS n FROM s x JOIN s y ON y.a = x.a AND x.b < y.b JOIN s z ON z.a = x.b AND z.b = y.b GROUP BY 1) "
    "SELECT d.node, CASE WHEN degree < 2 THEN 0.0 ELSE 2.0::DOUBLE * coalesce(n, 0) / (degree * (degree - 1)) END AS coefficient, coalesce(n, 0) AS triangles, degree FROM d LEFT JOIN t ON t.node = d.node",
)
add(
    "graph_bfs_hops",
    HOP + "s[n] <- [[1]]  g[n] := hop[_, n]  p[] <~ ShortestPathBFS(hop[], s[], g[])  ?[b, n] := p[a, b, q], !is_null(q), n = length(q) - 1",
    "b n",
    FAR_SQL + "SELECT b, n FROM hops WHERE b <> 1",
)
add(
    "graph_bfs",
    HOP + "s[n] <- [[1]]  p[] <~ BFS(hop[], *part{p_partkey, p_size}, s[], condition: p_size == 50, limit: 1000000)  ?[a, b, n] := p[a, b, q], n = length(q) - 1",
    "start found hops",
    FAR_SQL + "SELECT 1 AS start, b AS found, n AS hops FROM hops JOIN part ON p_partkey = b WHERE p_size = 50 AND b <> 1",
)
add(
    "graph_dijkstra",
    TRADE + "s[n] <- [[0]]  g[n] := *nation{n_nationkey: n}  p[] <~ ShortestPathDijkstra(trade[], s[], g[])  ?[b, c] := p[a, b, x, q], is_finite(x), c = round(x * 100) / 100",
    "b c",
    relaxed() + "SELECT n AS b, round(c * 100) / 100 AS c FROM d12",
)
add(
    "graph_a_star",
    TRADE + "s[n] <- [[0]]  g[n] := *nation{n_nationkey: n}  p[] <~ ShortestPathAStar(trade[], *nation{n_nationkey: k}, s[], g[], heuristic: 0.0)  ?[b, c] := p[a, b, x, q], is_finite(x), c = round(x * 100) / 100",
    "b c",
    relaxed() + "SELECT n AS b, round(c * 100) / 100 AS c FROM d12",
)
#: The smallest of the largest steps between any two nations, both ways: what a minimum forest keeps.
WIDEST_SQL = (
    f"WITH {TRADE_SQL}, u AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(w) AS w FROM trade GROUP BY 1, 2), m0 AS (SELECT a, b, w FROM u UNION ALL SELECT b, a, w FROM u), "
    + ", ".join(f"m{i} AS (SELECT a, b, min(w) AS w FROM (SELECT * FROM m{i - 1} UNION ALL SELECT x.a, y.b, greatest(x.w, y.w) FROM m{i - 1} x JOIN m{i - 1} y ON y.a = x.b AND y.b <> x.a) GROUP BY 1, 2)" for i in range(1, 6))
)
_TREE_SQL = WIDEST_SQL + " SELECT round(sum(u.w) * 100) / 100 AS total FROM u JOIN m5 ON m5.a = u.a AND m5.b = u.b AND m5.w = u.w"
add("graph_mst_kruskal", TRADE + "f[] <~ MinimumSpanningForestKruskal(trade[])  t[sum(w)] := f[_, _, w]  ?[r] := t[x], r = round(x * 100) / 100", "total", _TREE_SQL)
add("graph_mst_prim", TRADE + "f[] <~ MinimumSpanningTreePrim(trade[])  t[sum(w)] := f[_, _, w]  ?[r] := t[x], r = round(x * 100) / 100", "total", _TREE_SQL)
add(
    "graph_topsort",
    "e[a, b] := *nation{n_nationkey: a, n_regionkey: r}, b = r + 100  p[] <~ TopSort(e[])  ?[a, b, ok] := e[a, b], p[i, a], p[j, b], ok = i < j",
    "a b ok",
    "SELECT n_nationkey AS a, n_regionkey + 100 AS b, true AS ok FROM nation",
)
add(
    "graph_scc",
    "e[a, b] := *nation{n_nationkey: a, n_regionkey: b}  c[] <~ SCC(e[])  l[g, smallest_by(p)] := c[n, g], p = [n, n]  ?[n, r] := c[n, g], l[g, r]",
    "n r",
    "WITH RECURSIVE t AS (SELECT n_nationkey AS a, n_regionkey AS c FROM nation UNION SELECT t.a, n_regionkey FROM t JOIN nation ON n_nationkey = t.c), n AS (SELECT n_nationkey AS n FROM nation UNION SELECT n_regionkey FROM nation) "
    "SELECT n.n, least(n.n, coalesce((SELECT min(x.c) FROM t x JOIN t y ON y.a = x.c AND y.c = n.n WHERE x.a = n.n), n.n))::BIGINT AS r FROM n",
)


def ranked(rounds: int = 10) -> str:
    """SQL of so many rounds of power iteration over the supply graph, both ways."""
    steps = [
        "u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)",
        "outs AS (SELECT a AS n, count(*) AS k FROM u GROUP BY 1)",
        "size AS (SELECT count(*)::DOUBLE AS m FROM outs)",
        "r0 AS (SELECT n, k, 1 / m AS r FROM outs, size)",
    ]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS (SELECT b AS n, any_value(t.k) AS k, 0.15 / any_value(m) + 0.85 * sum(s.r / s.k) AS r FROM u JOIN r{i - 1} s ON s.n = a JOIN outs t ON t.n = b, size GROUP BY 1)")
    return f"WITH {SUPPLY_SQL}, {', '.join(steps)} SELECT n AS node, round(r * 1000000) / 1000000 AS rank FROM r{rounds}"


add("graph_pagerank", SUPPLY + "p[] <~ PageRank(e[], undirected: true, iterations: 10, epsilon: 0.0)  ?[n, r] := p[n, x], r = round(x * 1000000) / 1000000", "node rank", ranked())


def all_pairs(edges: str, rounds: int = 5) -> str:
    """CTEs of the cheapest costs between all nodes, by paths twice as long in each round."""
    steps = [f"d0 AS (SELECT n AS a, n AS b, 0.0::DOUBLE AS w FROM (SELECT a AS n FROM {edges} UNION SELECT b FROM {edges}) UNION ALL SELECT a, b, w FROM {edges})"]
    for i in range(1, rounds + 1):
        steps.append(f"d{i} AS (SELECT x.a, y.b, min(x.w + y.w) AS w FROM d{i - 1} x JOIN d{i - 1} y ON y.a = x.b GROUP BY 1, 2)")
    return f"WITH {TRADE_SQL}, ways AS (SELECT a, b, min(w) AS w FROM (SELECT * FROM trade UNION ALL SELECT b, a, w FROM trade) GROUP BY 1, 2), {', '.join(steps)} "


add(
    "graph_closeness",
    TRADE + "p[] <~ ClosenessCentrality(trade[], undirected: true)  ?[n, r] := p[n, x], r = round(x * 1000000000) / 1000000000",
    "node centrality",
    all_pairs("ways") + "SELECT a AS node, round(count(*) * count(*) / sum(w) / ((SELECT count(DISTINCT a) FROM d0) - 1) * 1000000000) / 1000000000 AS centrality FROM d5 GROUP BY a",
)
add(
    "graph_betweenness",
    TRADE + "p[] <~ BetweennessCentrality(trade[])  ?[n, r] := p[n, x], r = round(x)",
    "node centrality",
    # prices differ, so between two nations there is one cheapest path; who lies on it has detours of no cost
    all_pairs("trade") + "SELECT n.n AS node, count(x.a)::DOUBLE AS centrality FROM (SELECT DISTINCT a AS n FROM d5 UNION SELECT b FROM d5) n "
    "LEFT JOIN (SELECT x.a, x.b AS via, y.b FROM d5 x JOIN d5 y ON y.a = x.b JOIN d5 z ON z.a = x.a AND z.b = y.b WHERE x.a <> x.b AND y.a <> y.b AND x.a <> y.b AND abs(x.w + y.w - z.w) < 1e-6) x ON x.via = n.n GROUP BY 1",
)
add(
    "graph_louvain",
    SUPPLY + "c[] <~ CommunityDetectionLouvain(e[], undirected: true)  k[count(n)] := c[l, n]  ?[n, one, ok] := c[l, n], k[_], one = length(l) > 0, ok = first(l) >= 0",
    "node one ok",
    f"WITH {SUPPLY_SQL} SELECT a AS node, true AS one, true AS ok FROM e UNION SELECT b, true, true FROM e",
)
add(
    "graph_label_prop",
    SUPPLY + "c[] <~ LabelPropagation(e[], undirected: true)  v[n] := e[n, _]  v[n] := e[_, n]  ?[n, ok] := c[l, n], v[l], ok = true",
    "node ok",
    f"WITH {SUPPLY_SQL} SELECT a AS node, true AS ok FROM e UNION SELECT b, true FROM e",
)
add(
    "graph_random_walk",
    TRADE + "s[n] := *nation{n_nationkey: n}, trade[n, _, _]  w[] <~ RandomWalk(trade[], *nation{n_nationkey}, s[], steps: 4, iterations: 5)  "
    "bad[i] := w[i, _, p], q in windows(p, 2), x = first(q), y = last(q), not trade[x, y, _]  ?[f, n, count(i)] := w[i, f, p], not bad[i], f == first(p), n = length(p)",
    "first nodes walks",
    f"WITH {TRADE_SQL} SELECT a AS first, 5 AS nodes, 5 AS walks FROM trade GROUP BY a",
)
add(
    "graph_yen",
    TRADE + "s[n] <- [[0]]  g[n] <- [[7]]  p[] <~ KShortestPathYen(trade[], s[], g[], k: 3)  ?[r, q] := p[_, _, c, q], r = round(c * 100) / 100",
    "cost path",
    # every way of up to 7 steps without a repeat that costs no more than the third direct or one-stop way
    f"WITH RECURSIVE {TRADE_SQL}, few AS (SELECT w AS c FROM trade WHERE a = 0 AND b = 7 UNION ALL SELECT x.w + y.w FROM trade x JOIN trade y ON y.a = x.b WHERE x.a = 0 AND y.b = 7 AND x.b <> 7), "
    "bound AS (SELECT max(c) AS most FROM (SELECT c FROM few ORDER BY c LIMIT 3)), "
    "p AS (SELECT [0] AS path, 0 AS place, 0.0::DOUBLE AS cost UNION ALL SELECT list_append(path, b), b, cost + w FROM p JOIN trade ON a = p.place CROSS JOIN bound WHERE p.place <> 7 AND NOT list_contains(path, b) AND cost + w <= most + 1e-9 AND len(path) < 8) "
    "SELECT round(cost * 100) / 100 AS cost, array_to_string(path, ',') AS path FROM p WHERE place = 7 ORDER BY p.cost LIMIT 3",
    "path",
)
add(
    "graph_dfs",
    HOP + "s[n] <- [[1]]  p[] <~ DFS(hop[], *part{p_partkey, p_size}, s[], condition: p_size == 50, limit: 1000000)  "
    "bad[b] := p[_, b, q], w in windows(q, 2), x = first(w), y = last(w), not hop[x, y]  ?[a, b, ok] := p[a, b, q], not bad[b], ok = first(q) == a && last(q) == b",
    "start found ok",
    FAR_SQL + "SELECT 1 AS start, p_partkey AS found, true AS ok FROM part WHERE p_size = 50 AND (p_partkey = 1 OR p_partkey IN (SELECT b FROM hops))",
)
add(
    "graph_dijkstra_ties",
    HOP + "s[n] <- [[1]]  g[n] := *part{p_partkey: n, p_size: 50}  p[] <~ ShortestPathDijkstra(hop[], s[], g[], keep_ties: true)  t[b, count(q)] := p[_, b, c, q], is_finite(c), c > 0.0  ?[b, n] := t[b, n]",
    "b paths",
    FAR_SQL + ", ways AS (SELECT 1::BIGINT AS b, 0::BIGINT AS n, 1::BIGINT AS k), "
    + ", ".join(
        f"w{i} AS (SELECT b, n, k FROM {'ways' if i == 1 else f'w{i - 1}'} UNION ALL SELECT h.b, hops.n, sum(k)::BIGINT FROM {'ways' if i == 1 else f'w{i - 1}'} w JOIN hop h ON h.a = w.b JOIN hops ON hops.b = h.b AND hops.n = {i} WHERE w.n = {i - 1} AND h.b <> 1 GROUP BY 1, 2)"
        for i in range(1, 11)
    )
    + " SELECT b, k AS paths FROM w10 JOIN part ON p_partkey = b WHERE p_size = 50 AND n > 0",
)

# --- time travel, search, mutation --------------------------------------------------


def versioned_events(session: Session, sf_dir: str) -> None:
    """events as a history: user, validity => last value; a refund takes the row back."""
    events = session.spark.read.parquet(f"{sf_dir}/events.parquet")
    vld = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_type") != "refund").alias("is_assert"))
    session.register("history", events.select("user_id", vld.alias("vld"), "event_id", "value"), ["user_id", "vld"])


_AT = "1704844800000000"
add(
    "time_travel",
    f"?[u, e] := *history{{user_id: u, event_id: e @ {_AT}}}",
    "u e",
    f"SELECT user_id AS u, event_id AS e FROM events WHERE epoch_us(ts) <= {_AT} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type <> 'refund' DESC) = 1 AND event_type <> 'refund'",
    prepare=versioned_events,
)
add(
    "time_travel_join",
    f"?[u, n] := *history{{user_id: u, event_id: e @ {_AT}}}, *customer{{c_custkey: u, c_name: n}}",
    "u n",
    f"SELECT user_id AS u, c_name AS n FROM (SELECT * FROM events WHERE epoch_us(ts) <= {_AT} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type <> 'refund' DESC) = 1 AND event_type <> 'refund') JOIN customer ON c_custkey = user_id",
    prepare=versioned_events,
)


def indexed(statement: str) -> Callable[[Session, str], None]:
    return lambda session, _: session.run(statement) and None


for _name, _metric, _sql in (
    ("l2", "L2", "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ^ 2))"),
    ("cosine", "Cosine", "1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"),
    ("ip", "IP", "1 - list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"),
):
    add(
        f"knn_{_name}",
        "?[a, i, r] := *embeddings{vec_id: a, embedding: q}, a % 100 == 0, ~embeddings:vec{vec_id: i | query: q, k: 10, ef: 50, bind_distance: d}, r = round(d * 10000) / 10000 + 0.0",
        "a i r",
        f"SELECT a, i, round(d * 10000) / 10000 + 0.0 AS r FROM (SELECT q.vec_id AS a, v.vec_id AS i, {_sql} AS d FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, i) <= 10",
        prepare=indexed(f"::hnsw create embeddings:vec {{dim: 64, m: 16, ef_construction: 50, dtype: F32, fields: [embedding], distance: {_metric}}}"),
    )
_FTS = indexed("::fts create documents:fts {extractor: text, tokenizer: Simple, filters: [Lowercase]}")
_WORDS = r"w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM documents), tf AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY 1, 2), df AS (SELECT word, count(*) AS held FROM tf GROUP BY 1), total AS (SELECT count(*) AS docs FROM documents)"
add(
    "fts_tfidf",
    "?[i, r] := ~documents:fts{doc_id: i | query: 'licensed apache', k: 20, bind_score: s}, r = round(s * 1000000) / 1000000",
    "i r",
    f"WITH {_WORDS} SELECT i, round(s * 1000000) / 1000000 AS r FROM (SELECT doc_id AS i, sum(n * ln(1 + (docs - held + 0.5) / (held + 0.5))) AS s, count(*) AS parts FROM tf JOIN df USING (word), total WHERE word IN ('licensed', 'apache') GROUP BY 1) WHERE parts = 2 QUALIFY row_number() OVER (ORDER BY s DESC, i) <= 20",
    prepare=_FTS,
)
add(
    "fts_boolean",
    "?[i, s] := ~documents:fts{doc_id: i | query: '(apache OR mit) NOT version', k: 1000, score_kind: 'tf', bind_score: s}",
    "i s",
    f"WITH {_WORDS} SELECT doc_id AS i, max(n)::DOUBLE AS s FROM tf WHERE word IN ('apache', 'mit') AND doc_id NOT IN (SELECT doc_id FROM tf WHERE word = 'version') GROUP BY 1 QUALIFY row_number() OVER (ORDER BY s DESC, i) <= 1000",
    prepare=_FTS,
)
_LSH = indexed("::lsh create documents:lsh {extractor: text, tokenizer: Simple, filters: [Lowercase], n_gram: 5, n_perm: 64, target_threshold: 0.75}")
add(
    "lsh_near_dup",
    "?[a, i] := *documents{doc_id: a, text: t}, a % 100 == 0, ~documents:lsh{doc_id: i | query: t}",
    "a i",
    None,
    prepare=_LSH,
)
add(
    "lsh_copies",
    "?[a, i] := *documents{doc_id: a, text: t}, a % 100 == 0, ~documents:lsh{doc_id: i, text: u | query: t}, u == t",
    "a i",
    "SELECT a.doc_id AS a, b.doc_id AS i FROM documents a JOIN documents b ON a.text = b.text WHERE a.doc_id % 100 = 0",
    prepare=_LSH,
)
add(
    "put_update_rm",
    """{?[k, v] := *region{r_regionkey: k, r_name: v} :create kv {k: Int => v: String}}
       {?[k, v] <- [[1, 'one'], [9, 'nine']] :put kv}
       {?[k, v] <- [[2, 'two']] :update kv}
       {?[k] <- [[0]] :rm kv}
       {?[k, v] := *kv{k, v}}""",
    "k v",
    "SELECT r_regionkey AS k, r_name AS v FROM region WHERE r_regionkey > 2 UNION ALL SELECT * FROM (VALUES (1, 'one'), (2, 'two'), (9, 'nine')) t(k, v)",
)
add(
    "imperative_loop",
    """{?[n] <- [[1]] :replace _s}
       %loop
         %if {?[big] := *_s{n}, big = n > 500} %then %break %end
         {?[n] := *_s{n: m}, n = m * 2 :replace _t}
         %swap _s _t
       %end
       %return _s""",
    "n",
    "SELECT 512 AS n",
)


# --- sources, keyed mutations, the catalog, extensions ------------------------------


def folder(session: Session) -> str:
    """A fresh folder beside the durable intermediates."""
    from spindrel.sources.durable import shared_dir

    return f"{shared_dir(session.spark)}/spindrel-files/{uuid.uuid4().hex}"


def read_table(session: Session, sf_dir: str, name: str) -> DataFrame:
    return session.spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv_of_parts(session: Session, sf_dir: str) -> dict:
    path = folder(session)
    parts = read_table(session, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_size") > 9, F.col("p_size")).alias("p_size"), "p_retailprice")
    parts.write.csv(path, header=True, sep=";")
    return {"url": path}


def json_of_orders(session: Session, sf_dir: str) -> dict:
    path = folder(session)
    read_table(session, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").write.json(path)
    return {"url": path}


add(
    "csv_reader",
    "?[] <~ CsvReader(url: $url, types: ['Int', 'String', 'Int?', 'Float'], delimiter: ';')",
    "k name size price",
    "SELECT p_partkey AS k, p_name AS name, CASE WHEN p_size > 9 THEN p_size END AS size, p_retailprice AS price FROM part",
    prepare=csv_of_parts,
)
add(
    "csv_reader_index",
    "c[] <~ CsvReader(url: $url, types: ['Int', 'String', 'Int?', 'Float'], delimiter: ';', prepend_index: true)  t[count(i), min(i), max(i)] := c[i, _, _, _, _]  ?[n, a, b] := t[n, a, b]",
    "n least most",
    "SELECT count(*) AS n, 0::BIGINT AS least, count(*) - 1 AS most FROM part",
    prepare=csv_of_parts,
)
add(
    "json_reader",
    "?[] <~ JsonReader(url: $url, fields: ['o_orderkey', 'o_orderpriority', 'nowhere'], null_if_absent: true)",
    "k priority absent",
    "SELECT o_orderkey AS k, o_orderpriority AS priority, NULL::VARCHAR AS absent FROM orders",
    prepare=json_of_orders,
)
add(
    "index_scan",
    "?[c, k] := *orders:of{o_custkey: c, o_orderkey: k}, c < 50",
    "c k",
    "SELECT o_custkey AS c, o_orderkey AS k FROM orders WHERE o_custkey < 50",
    prepare=lambda session, _: session.run("::index create orders:of {o_custkey}") and None,
)
add("parameters", "?[k, t] := *part{p_partkey: k, p_size: s}, s in $sizes, t = $tag", "k t", "SELECT p_partkey AS k, 'x' AS t FROM part WHERE p_size IN (3, 5)", prepare=lambda *_: {"sizes": [3, 5], "tag": "x"})
add(
    "recursion_without_rewriting",
    HOP + "t[a, b] := hop[a, b], a < 300, b < 300  t[a, c] := t[a, b], t[b, c]  ?[b] := t[2, b] :disable_magic_rewrite true",
    "b",
    f"WITH RECURSIVE {HOP_SQL}, e AS (SELECT a, b FROM hop WHERE a < 300 AND b < 300), t AS (SELECT b FROM e WHERE a = 2 UNION SELECT e.b FROM t JOIN e ON e.a = t.b) SELECT b FROM t",
)
add("timeout_and_sleep", "?[n, count(k)] := *customer{c_custkey: k, c_nationkey: n} :timeout 600 :sleep 0.01", "n k", "SELECT c_nationkey AS n, count(*) AS k FROM customer GROUP BY 1")
add(
    "assertions",
    "{?[k] := *region{r_regionkey: k}, k > 1000 :assert none} {?[k, n] := *region{r_regionkey: k, r_name: n} :assert some}",
    "k n",
    "SELECT r_regionkey AS k, r_name AS n FROM region",
)

#: A relation of customers by nation, and what becomes of it.
_KEPT = "{?[n, k, b] := *customer{c_nationkey: n, c_custkey: k, c_acctbal: b} :create kept {n: Int, k: Int => b: Float}}"
_KEPT_SQL = "SELECT c_nationkey AS n, c_custkey AS k, c_acctbal AS b FROM customer"
add(
    "mutation_insert",
    _KEPT + "{?[n, k, b] := *supplier{s_nationkey: n, s_suppkey: s, s_acctbal: b}, k = -1 - s :insert kept} {?[n, k, b] := *kept{n, k, b}}",
    "n k b",
    f"{_KEPT_SQL} UNION ALL SELECT s_nationkey, -1 - s_suppkey, s_acctbal FROM supplier",
)
add(
    "mutation_insert_refused",
    _KEPT + "%ignore_error {?[n, k, b] := *customer{c_nationkey: n, c_custkey: k}, b = 0.0 :insert kept} {?[n, k, b] := *kept{n, k, b}}",
    "n k b",
    _KEPT_SQL,
)
add(
    "mutation_delete",
    _KEPT + "{?[n, k] := *kept{n, k, b}, b < 0.0 :delete kept {n, k}} {?[n, k, b] := *kept{n, k, b}}",
    "n k b",
    f"{_KEPT_SQL} WHERE NOT c_acctbal < 0",
)
add(
    "mutation_ensure",
    _KEPT + "{?[n, k, b] := *customer{c_nationkey: n, c_custkey: k, c_acctbal: b} :ensure kept} {?[n, k] := *kept{n: m, k}, n = m + 1000 :ensure_not kept {n, k}} {?[count(k)] := *kept{k}}",
    "held",
    "SELECT count(*) AS held FROM customer",
)
add(
    "mutation_returning",
    _KEPT + "{?[n, k, b] := *kept{n, k, b: a}, n < 5, b = a + 1.0 :put kept :returning}",
    "kind n k b",
    "SELECT 'inserted' AS kind, c_nationkey AS n, c_custkey AS k, c_acctbal + 1 AS b FROM customer WHERE c_nationkey < 5 UNION ALL SELECT 'replaced', c_nationkey, c_custkey, c_acctbal FROM customer WHERE c_nationkey < 5",
)
add(
    "mutation_replace",
    _KEPT + "{?[n, total] := *kept{n, b}, total = 1 :replace kept {n => total}} {?[n, total] := *kept{n, total}}",
    "n total",
    "SELECT DISTINCT c_nationkey AS n, 1 AS total FROM customer",
)
add(
    "mutation_defaults",
    "{?[k] := *region{r_regionkey: k} :create made {k: Int => v: Float default 2.5, w: String?}} {?[k, v, w] := *made{k, v, w}}",
    "k v w",
    "SELECT r_regionkey AS k, 2.5::DOUBLE AS v, NULL::VARCHAR AS w FROM region",
)
add(
    "mutation_last_row_of_a_key",
    "{?[n, v] := *customer{c_nationkey: n, c_custkey: v} :create one {n: Int => v: Int}} {?[n, ok] := *one{n, v}, *customer{c_custkey: v, c_nationkey: m}, ok = m == n}",
    "n ok",
    "SELECT DISTINCT c_nationkey AS n, true AS ok FROM customer",
)


def triggered(session: Session, sf_dir: str) -> None:
    session.run("?[k, b] := *customer{c_custkey: k, c_acctbal: b} :create watched {k: Int => b: Float}")
    session.run("?[k, what] <- [[-1, 'start']] :create seen {k: Int, what: String}")
    session.run("::set_triggers watched on put { ?[k, what] := _new[k, _], what = 'put' :put seen } on rm { ?[k, what] := _old[k, _], what = 'gone' :put seen }")
    session.run("{?[k, b] := *watched{k, b: a}, a < 0.0, b = 0.0 :put watched} {?[k] := *watched{k, b}, b > 9000.0 :rm watched {k}}")


add(
    "triggers",
    "?[k, what] := *seen{k, what}, *customer{c_custkey: k}",
    "k what",
    "SELECT c_custkey AS k, 'put' AS what FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'gone' FROM customer WHERE c_acctbal > 9000",
    prepare=lambda session, sf_dir: session.register("customer", read_table(session, sf_dir, "customer"), KEYS["customer"]) and triggered(session, sf_dir),
)


def called_back(session: Session, sf_dir: str) -> None:
    session.register("region", read_table(session, sf_dir, "region"), KEYS["region"])
    session.run("?[k, v] := *region{r_regionkey: k, r_name: v} :create watched {k: Int => v: String}")
    heard: list[tuple[str, DataFrame, DataFrame]] = []
    number = session.register_callback("watched", lambda op, new, old: heard.append((op, new, old)))
    session.run("?[k, v] <- [[1, 'one'], [99, 'new']] :put watched")
    session.run("?[k] <- [[0]] :rm watched {k}")
    session.unregister_callback(number)
    session.run("?[k] <- [[2]] :rm watched {k}")
    out = None
    for op, new, old in heard:
        for side, df in (("new", new), ("old", old)):
            one = df.select(F.lit(op).alias("op"), F.lit(side).alias("side"), F.col("k").cast("long").alias("k"))
            out = one if out is None else out.union(one)
    session.register("heard", out)


add(
    "callbacks",
    "?[op, side, k] := *heard{op, side, k}",
    "op side k",
    "SELECT * FROM (VALUES ('put', 'new', 1), ('put', 'new', 99), ('put', 'old', 1), ('rm', 'new', 0), ('rm', 'old', 0)) t(op, side, k) WHERE side = 'new' OR k IN (SELECT r_regionkey FROM region)",
    prepare=called_back,
)


def imported(session: Session, sf_dir: str) -> None:
    session.register("part", read_table(session, sf_dir, "part"), KEYS["part"])
    session.run("?[k, s] := *part{p_partkey: k, p_size: s} :create sizes {k: Int => s: Int}")
    given = session.export_relations(["sizes"])["sizes"]
    session.import_relations({"sizes": given.selectExpr("k", "s * 10 AS s").where("k % 2 = 0"), "-sizes": given.select("k").where("k % 3 = 0")})


add(
    "import_export",
    "?[k, s] := *sizes{k, s}",
    "k s",
    "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_size * 10 ELSE p_size END AS s FROM part WHERE p_partkey % 3 <> 0",
    prepare=imported,
)


def restored(session: Session, sf_dir: str) -> None:
    """Backed up with types, a default, an index, a trigger and an access level; changed; restored."""
    session.register("nation", read_table(session, sf_dir, "nation"), KEYS["nation"])
    session.run("?[k, name] := *nation{n_nationkey: k, n_name: name} :create kept {k: Int => name: String default 'none'}")
    session.run("?[k] <- [[-1]] :create log {k: Int}")
    session.run("?[k] <- [[7]] :create fixed {k: Int}")
    session.run("::set_triggers kept on put { ?[k] := _new[k, _] :put log {k} }")
    session.run("::index create kept:by_name {name}")
    session.run("::access_level read_only fixed")
    path = folder(session)
    session.backup(path)
    for name in ("kept", "log", "fixed"):
        del session.catalog.relations[name]
    session.restore(path)
    session.run("?[k] <- [[1000]] :put kept {k}")
    with contextlib.suppress(Exception):  # read only, so nothing changes
        session.run("?[k] <- [[8]] :put fixed")


add(
    "backup_restore",
    "?[k, name, how] := *kept:by_name{name, k}, how = 'kept'  ?[k, name, how] := *log{k}, name = '', how = 'log'  ?[k, name, how] := *fixed{k}, name = '', how = 'fixed'",
    "k name how",
    "SELECT n_nationkey AS k, n_name AS name, 'kept' AS how FROM nation UNION ALL VALUES (1000, 'none', 'kept'), (-1, '', 'log'), (1000, '', 'log'), (7, '', 'fixed')",
    prepare=restored,
)


def failing(session: Session, sf_dir: str) -> None:
    session.register("region", read_table(session, sf_dir, "region"), KEYS["region"])
    session.run("?[k, v] := *region{r_regionkey: k, r_name: v} :create kept {k: Int => v: String}")
    with contextlib.suppress(Exception):  # the second statement fails, so the first is undone
        session.run("{?[k, v] <- [[0, 'changed'], [77, 'new']] :put kept} {?[k, v] <- [[1, 'again']] :insert kept}")
    with contextlib.suppress(ZeroDivisionError), session.transaction():
        session.run("?[k] <- [[1]] :rm kept {k}")
        raise ZeroDivisionError
    with session.transaction():
        session.run("?[k] <- [[2]] :rm kept {k}")


add("transactions", "?[k, v] := *kept{k, v}", "k v", "SELECT r_regionkey AS k, r_name AS v FROM region WHERE r_regionkey <> 2", prepare=failing)


def ruled(session: Session, sf_dir: str) -> None:
    """A rule of the user's: the ``most`` rows of each key with the largest values."""

    def largest(inputs: list[DataFrame], options: dict) -> DataFrame:
        key, value = inputs[0].columns
        place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(value)))
        return inputs[0].withColumn("place", place).where(F.col("place") <= options["most"]).select(key, value)

    session.register_fixed_rule("Largest", largest)


add(
    "custom_rule",
    "p[n, b] := *customer{c_nationkey: n, c_acctbal: b}  ?[n, b] <~ Largest(p[], most: 2)",
    "n b",
    "SELECT n, b FROM (SELECT n, b, row_number() OVER (PARTITION BY n ORDER BY b DESC) AS place FROM (SELECT DISTINCT c_nationkey AS n, c_acctbal AS b FROM customer)) WHERE place <= 2",
    prepare=ruled,
)


add(
    "custom_function",
    "?[k, x] := *part{p_partkey: k, p_name: n, p_size: s}, x = tagged(n, s + 1)",
    "k x",
    "SELECT p_partkey AS k, '<' || (p_size + 1) || '|' || p_name || '>' AS x FROM part",
    prepare=lambda session, _: session.register_function("tagged", 2, lambda n, s: F.concat(F.lit("<"), s.cast("string"), F.lit("|"), n, F.lit(">"))),
)


def arranged(session: Session, sf_dir: str) -> None:
    for name in ("nation", "region"):
        session.register(name, read_table(session, sf_dir, name), KEYS[name])
    session.run("?[k, v] := *region{r_regionkey: k, r_name: v} :create old {k: Int => v: String}")
    session.run("?[k] := *region{r_regionkey: k} :create gone {k: Int}")
    session.run("::rename old -> new")
    session.run("::remove gone")
    session.run("::access_level protected new")


add("sys_relations", "::relations", "name", "SELECT * FROM (VALUES ('nation'), ('new'), ('region')) t(name)", prepare=arranged, finish=lambda df: df.select("name"))
add("sys_columns", "::columns new", "name is_key", "SELECT * FROM (VALUES ('k', true), ('v', false)) t(name, is_key)", prepare=arranged, finish=lambda df: df.select("column", "is_key"))
add(
    "sys_rename_kept_rows",
    "?[k, v] := *new{k, v}",
    "k v",
    "SELECT r_regionkey AS k, r_name AS v FROM region",
    prepare=arranged,
)
add(
    "imperative_branches",
    """{?[k] := *region{r_regionkey: k} :replace _all}
       %if_not {?[k] := *_all{k}, k > 1000} %then {?[k] := *_all{k}, k % 2 == 0 :replace _all} %end
       %mark outer %loop %loop {?[k] := *_all{k}, k > 0 :replace _all} %break outer %end %end
       %ignore_error {?[x] := *nowhere{x}}
       {?[k] := *_all{k}}""",
    "k",
    "SELECT r_regionkey AS k FROM region WHERE r_regionkey % 2 = 0 AND r_regionkey > 0",
)
add(
    "time_travel_text",
    "?[u, e] := *history{user_id: u, event_id: e @ '2024-01-10T00:00:00Z'}",
    "u e",
    f"SELECT user_id AS u, event_id AS e FROM events WHERE epoch_us(ts) <= {_AT} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type <> 'refund' DESC) = 1 AND event_type <> 'refund'",
    prepare=versioned_events,
)
add(
    "time_travel_now",
    "?[u, e] := *history{user_id: u, event_id: e @ 'NOW'}",
    "u e",
    "SELECT user_id AS u, event_id AS e FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1",
    prepare=versioned_events,
)

# --- more of the searches -----------------------------------------------------------

_L2 = "list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ^ 2))"
add(
    "knn_radius_and_filter",
    "?[a, i, r] := *embeddings{vec_id: a, embedding: q}, a % 100 == 0, ~embeddings:vec{vec_id: i, label: l | query: q, k: 10, ef: 50, radius: 110.0, filter: l != 3, bind_distance: d}, r = round(d * 10000) / 10000 + 0.0",
    "a i r",
    f"SELECT a, i, round(d * 10000) / 10000 + 0.0 AS r FROM (SELECT q.vec_id AS a, v.vec_id AS i, {_L2} AS d FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.label <> 3) WHERE d <= 110 QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, i) <= 10",
    prepare=indexed("::hnsw create embeddings:vec {dim: 64, m: 16, ef_construction: 50, dtype: F32, fields: [embedding], distance: L2}"),
)
add(
    "fts_prefix",
    "?[i, s] := ~documents:fts{doc_id: i | query: 'apach* OR licen*^2', k: 100000, score_kind: 'tf', bind_score: s}",
    "i s",
    f"WITH {_WORDS}, a AS (SELECT doc_id, sum(n) AS s FROM tf WHERE starts_with(word, 'apach') GROUP BY 1), l AS (SELECT doc_id, 2 * sum(n) AS s FROM tf WHERE starts_with(word, 'licen') GROUP BY 1) "
    "SELECT coalesce(a.doc_id, l.doc_id) AS i, greatest(coalesce(a.s, 0), coalesce(l.s, 0))::DOUBLE AS s FROM a FULL JOIN l ON a.doc_id = l.doc_id",
    prepare=_FTS,
)
_PLACES = r"p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents))"
add(
    "fts_near",
    "?[i, s] := ~documents:fts{doc_id: i | query: 'NEAR/3(licensed apache)', k: 100000, score_kind: 'tf', bind_score: s}",
    "i s",
    f"WITH {_PLACES} SELECT b.doc_id AS i, count(DISTINCT b.at)::DOUBLE AS s FROM p a JOIN p b ON a.doc_id = b.doc_id AND abs(a.at - b.at) <= 3 WHERE a.word = 'licensed' AND b.word = 'apache' GROUP BY 1",
    prepare=_FTS,
)
add(
    "fts_phrase",
    "?[i] := ~documents:fts{doc_id: i | query: '\"apache license\" NOT mit', k: 100000}",
    "i",
    f"WITH {_WORDS} SELECT doc_id AS i FROM tf WHERE word = 'apache' AND doc_id IN (SELECT doc_id FROM tf WHERE word = 'license') AND doc_id NOT IN (SELECT doc_id FROM tf WHERE word = 'mit')",
    prepare=_FTS,
)
add(
    "fts_of_rows",
    "?[k, i] := *region{r_regionkey: k, r_name: t}, q = if(k == 0, 'apache', if(k == 1, 'mit', 'license')), ~documents:fts{doc_id: i | query: q, k: 100000}",
    "k i",
    f"WITH {_WORDS} SELECT r_regionkey AS k, doc_id AS i FROM region JOIN tf ON word = CASE r_regionkey WHEN 0 THEN 'apache' WHEN 1 THEN 'mit' ELSE 'license' END",
    prepare=_FTS,
)
add(
    "fts_tokenizers",
    "?[i] := ~documents:raw{doc_id: i | query: 'Apache', k: 100000}",
    "i",
    r"SELECT doc_id AS i FROM documents WHERE list_contains(regexp_extract_all(text, '\S+'), 'Apache')",
    prepare=indexed("::fts create documents:raw {extractor: text, tokenizer: Whitespace}"),
)
add(
    "fts_index_scan",
    "?[i, n] := *documents:fts{word: 'apache', doc_id: i, position: p}, n = length(p)",
    "i n",
    f"WITH {_WORDS} SELECT doc_id AS i, n FROM tf WHERE word = 'apache'",
    prepare=_FTS,
)
add(
    "fts_follows_changes",
    """{?[k, v] := *nation{n_nationkey: k, n_name: v} :create texts {k: Int => v: String}}
       {::fts create texts:f {extractor: v, tokenizer: Simple, filters: [Lowercase]}}
       {?[k, v] := *nation{n_nationkey: k}, k % 2 == 0, v = 'changed word' :put texts}
       {?[k] <- [[4]] :rm texts {k}}
       {?[k] := ~texts:f{k | query: 'word OR nation_3', k: 1000}}""",
    "k",
    "SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey <> 4 OR n_name = 'NATION_3'",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in Q.items() if q.sql is not None}
