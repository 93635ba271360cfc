"""Queries that call what the other queries leave out: functions, aggregates, changes, files; with SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..graph import Graph
from ..operators.store import scratch
from .tables import star_graph, trade_graph, with_partsupp

#: name -> (pattern, table, (result, Cypher, SQL) of each column)
COLUMNS: dict[str, tuple[str, str, list[tuple[str, str, str]]]] = {
    "more_strings": (
        "MATCH (p:PART)",
        "part",
        [
            ("k", "p.p_partkey", "p_partkey"),
            ("concat_ws", "concat_ws('-', p.p_type, null, p.p_brand)", "concat_ws('-', p_type, NULL, p_brand)"),
            ("contains", "p.p_name CONTAINS '1'", "contains(p_name, '1')"),
            ("suffix", "p.p_name ENDS WITH '3'", "ends_with(p_name, '3')"),
            ("prefix", "p.p_name STARTS WITH 'p'", "starts_with(p_name, 'p')"),
            ("length", "length(p.p_name)", "length(p_name)"),
            ("len", "len(p.p_type)", "length(p_type)"),
            ("array_length", "array_length([1, 2, p.p_size])", "len([1, 2, p_size])"),
            ("strlen", "strlen(p.p_name)", "strlen(p_name)"),
            ("bit_length", "bit_length(p.p_brand)", "bit_length(p_brand)::INTEGER"),
            ("octet_length", "octet_length(p.p_brand)", "octet_length(encode(p_brand))::INTEGER"),
            ("unicode", "unicode(p.p_type)", "unicode(p_type)"),
            ("ord", "ord(p.p_name)", "ord(p_name)"),
            ("chr", "chr(60 + p.p_size)", "chr(60 + p_size)"),
            ("is_like", "p.p_name LIKE '%a_t%'", "p_name LIKE '%a_t%'"),
            ("is_ilike", "p.p_type ILIKE 'pro%'", "p_type ILIKE 'pro%'"),
            ("is_glob", "glob(p.p_name, '*[0]')", "p_name = 'never[0]'"),
            ("globbed", "glob(p.p_brand, 'Brand?1*')", "p_brand GLOB 'Brand?1*'"),
            ("escaped", "like_escape(p.p_type, 'P$%', '$')", "p_type LIKE 'P$%' ESCAPE '$'"),
            ("not_escaped", "not_like_escape(p.p_type, 'P%', '$')", "p_type NOT LIKE 'P%' ESCAPE '$'"),
            ("regexp_matches", "regexp_matches(p.p_name, '[13]$')", "regexp_matches(p_name, '[13]$')"),
            ("regexp_extract", "regexp_extract(p.p_brand, '([0-9])', 1)", "regexp_extract(p_brand, '([0-9])', 1)"),
            ("split_regex", "string_split_regex(p.p_brand, '[#n]')[1]", "string_split_regex(p_brand, '[#n]')[2]"),
            ("printf", "printf('%d-%s', p.p_size, p.p_type)", "printf('%d-%s', p_size, p_type)"),
            ("formatted", "format('{}/{}', p.p_size, p.p_type)", "format('{}/{}', p_size, p_type)"),
            ("nfc", "nfc_normalize(p.p_name)", "nfc_normalize(p_name)"),
            ("tointeger", "toInteger(right(p.p_brand, 1))", "right(p_brand, 1)::BIGINT"),
            ("tofloat", "toFloat('2.5')", "2.5::DOUBLE"),
            ("toboolean", "toBoolean('TRUE')", "true"),
            ("md5", "md5(p.p_name)", "md5(p_name)"),
            ("base64", "base64(p.p_name)", "base64(encode(p_name))"),
            ("ltrim", "ltrim('  ' + p.p_type)", "ltrim('  ' || p_type)"),
            ("rtrim", "rtrim(p.p_type + ' ')", "rtrim(p_type || ' ')"),
        ],
    ),
    "more_numbers": (
        "MATCH (p:PART)",
        "part",
        [
            ("k", "p.p_partkey", "p_partkey"),
            *((f"f_{n}", f"round({n}(p.p_size / 100.0), 9)", f"round({n}(p_size / 100.0::DOUBLE), 9)") for n in ("degrees", "radians", "cbrt", "exp", "log10", "sin", "cos", "tan", "asin", "acos", "atan", "cot", "lgamma", "gamma")),
            ("f_atan2", "round(atan2(p.p_size * 1.0, 3.0), 9)", "round(atan2(p_size::DOUBLE, 3.0), 9)"),
            ("f_pi", "round(pi(), 9)", "round(pi(), 9)"),
            ("f_bit_count", "bit_count(p.p_size)", "bit_count(p_size)::INTEGER"),
            ("f_nextafter", "nextafter(1.0, 2.0) > 1.0", "nextafter(1.0::DOUBLE, 2.0::DOUBLE) > 1.0"),
            ("f_isnan", "isnan(p.p_retailprice)", "isnan(p_retailprice)"),
            ("f_isinf", "isinf(p.p_retailprice)", "isinf(p_retailprice)"),
            ("f_isfinite", "isfinite(p.p_retailprice)", "isfinite(p_retailprice)"),
            ("f_random", "random() < 1.0", "random() < 1.0"),
            ("f_or", "p.p_size | 5", "p_size | 5"),
            ("f_xor", "xor(p.p_size, 5)", "xor(p_size, 5)"),
            ("f_right", "p.p_size >> 1", "p_size >> 1"),
            ("f_not", "~p.p_size", "~p_size"),
            ("f_ceiling", "ceiling(p.p_retailprice)", "ceil(p_retailprice)::BIGINT"),
            ("f_pow", "pow(p.p_size, 3)", "pow(p_size, 3)"),
        ],
    ),
    "more_times": (
        "MATCH (o:ORDERS)",
        "orders",
        [
            ("k", "o.o_orderkey", "o_orderkey"),
            ("stamp", "make_timestamp(2001, 2, 3, 4, 5, 6.5)", "TIMESTAMP '2001-02-03 04:05:06.5'"),
            ("clock", "make_time(1, 2, 3)", "3723000000::BIGINT"),
            ("from_ms", "epoch_ms(o.o_orderkey)", "epoch_ms(o_orderkey)"),
            ("from_s", "to_timestamp(o.o_orderkey)", "make_timestamp(o_orderkey * 1000000)"),
            ("parsed", "strptime('2003-04-05', '%Y-%m-%d')", "strptime('2003-04-05', '%Y-%m-%d')"),
            ("years", "o.o_orderdate + to_years(2)", "o_orderdate + INTERVAL 2 YEAR"),
            ("months", "o.o_orderdate + to_months(13)", "o_orderdate + INTERVAL 13 MONTH"),
            ("days", "o.o_orderdate + to_days(40)", "o_orderdate + INTERVAL 40 DAY"),
            ("hours", "o.o_orderdate + to_hours(5)", "o_orderdate + INTERVAL 5 HOUR"),
            ("minutes", "o.o_orderdate + to_minutes(7)", "o_orderdate + INTERVAL 7 MINUTE"),
            ("seconds", "o.o_orderdate + to_seconds(9)", "o_orderdate + INTERVAL 9 SECOND"),
            ("millis", "o.o_orderdate + to_milliseconds(1500)", "o_orderdate + INTERVAL 1500 MILLISECOND"),
            ("micros", "o.o_orderdate + to_microseconds(2500000)", "o_orderdate + INTERVAL 2500000 MICROSECOND"),
            ("aged", "age(o.o_orderdate, datetime('1990-01-31 00:00:00')).months", "12 * datepart('year', age(o_orderdate, TIMESTAMP '1990-01-31')) + datepart('month', age(o_orderdate, TIMESTAMP '1990-01-31'))"),
            ("now", "now() > o.o_orderdate", "true"),
            ("today", "current_date() > date('2020-01-01')", "true"),
            ("clicks", "timestamp() > 0", "true"),
            ("at", "datetime({epochMillis: 86400000})", "TIMESTAMP '1970-01-02'"),
            ("weekday", "dayofweek(o.o_orderdate)", "dayofweek(o_orderdate)"),
            ("doy", "date_part('doy', o.o_orderdate)", "dayofyear(o_orderdate)"),
        ],
    ),
    "more_values": (
        "MATCH (n:NATION)-[r:IS_LOCATED_IN]->(m:REGION)",
        "nation JOIN region ON n_regionkey = r_regionkey",
        [
            ("k", "n.n_nationkey", "n_nationkey"),
            ("coalesced", "coalesce(null, n.n_name)", "n_name"),
            ("nulled", "nullif(n.n_nationkey, 3)", "nullif(n_nationkey, 3)"),
            ("in_list", "n.n_nationkey IN [1, 2, 9]", "n_nationkey IN (1, 2, 9)"),
            ("not_in", "NOT n.n_nationkey IN [1, 2, 9]", "n_nationkey NOT IN (1, 2, 9)"),
            ("between", "n.n_nationkey >= 3 AND n.n_nationkey <= 7", "n_nationkey BETWEEN 3 AND 7"),
            ("chained", "3 <= n.n_nationkey <= 7", "n_nationkey BETWEEN 3 AND 7"),
            ("is_not_null", "n.n_name IS NOT NULL", "true"),
            ("either", "(n.n_nationkey > 5) XOR (n.n_regionkey > 2)", "(n_nationkey > 5) <> (n_regionkey > 2)"),
            ("casted", "cast(n.n_nationkey AS varchar)", "n_nationkey::VARCHAR"),
            ("concat", "list_concat([1, 2], [n.n_nationkey])[2]", "n_nationkey"),
            ("flat", "flatten([[1], [2, n.n_nationkey]])[2]", "n_nationkey"),
            ("cardinality", "cardinality([1, 2, 3])", "3::BIGINT"),
            ("keys_n", "keys(n)[0]", "'n_nationkey'"),
            ("props", "properties(n).n_name", "n_name"),
            ("label", "labels(m)[0]", "'REGION'"),
            ("kind", "type(r)", "'IS_LOCATED_IN'"),
            ("starts", "startNode(r).id", "n_nationkey"),
            ("ends", "endNode(r).id", "r_regionkey"),
            ("sliced", "list_slice([1, 2, 3, 4], 1, 3)[0]", "2"),
            ("extracted", "list_extract([5, 6, 7], n.n_nationkey % 3)", "[5, 6, 7][n_nationkey % 3 + 1]"),
            ("packed", "list_value(1, n.n_nationkey)[1]", "n_nationkey"),
            ("position", "array_indexof([4, 5, n.n_nationkey + 6], 5)", "2::BIGINT"),
            ("extract", "struct_extract({a: n.n_name, b: 1}, 'a')", "n_name"),
            ("summed", "list_aggregate([1, 2, n.n_nationkey], 'sum')", "(3 + n_nationkey)::DOUBLE"),
            ("`backtick name`", "n.`n_name`", "n_name"),
        ],
    ),
}

LINES = "MATCH (l:LINEITEM)"
COLUMNS["more_aggregates"] = (
    LINES,
    "lineitem",
    [
        ("k", "l.l_returnflag", "l_returnflag"),
        ("n", "count(l)", "count(*)"),
        ("f_fsum", "round(fsum(l.l_tax), 6)", "round(fsum(l_tax), 6)"),
        ("f_kahan", "round(kahan_sum(l.l_tax), 6)", "round(sum(l_tax), 6)"),
        ("f_favg", "round(favg(l.l_tax), 9)", "round(favg(l_tax), 9)"),
        ("f_first", "first(l.l_returnflag)", "first(l_returnflag)"),
        ("f_last", "last(l.l_returnflag)", "last(l_returnflag)"),
        ("f_arbitrary", "arbitrary(l.l_returnflag)", "arbitrary(l_returnflag)"),
        ("f_argmin", "argmin(l.l_linenumber, l.l_linenumber)", "min(l_linenumber)"),
        ("f_max_by", "max_by(l.l_linenumber, l.l_linenumber)", "max(l_linenumber)"),
        ("f_bit_and", "bit_and(l.l_suppkey)", "bit_and(l_suppkey)"),
        ("f_bit_xor", "bit_xor(l.l_orderkey)", "bit_xor(l_orderkey)"),
        ("f_bool_and", "bool_and(l.l_quantity > 1.0)", "bool_and(l_quantity > 1)"),
        ("f_string_agg", "string_agg(DISTINCT l.l_returnflag, '+')", "string_agg(DISTINCT l_returnflag, '+')"),
        ("f_product", "product(DISTINCT l.l_linenumber)", "product(DISTINCT l_linenumber)"),
        ("f_stddev", "round(stddev(DISTINCT l.l_quantity), 6)", "round(stddev(DISTINCT l_quantity), 6)"),
        ("f_covar_samp", "round(covar_samp(l.l_quantity, l.l_tax), 6)", "round(covar_samp(l_quantity, l_tax), 6)"),
        ("f_stddev_pop", "round(stddev_pop(l.l_quantity), 6)", "round(stddev_pop(l_quantity), 6)"),
        ("f_var_samp", "round(var_samp(l.l_quantity), 6)", "round(var_samp(l_quantity), 6)"),
        ("f_variance", "round(variance(l.l_tax), 9)", "round(variance(l_tax), 9)"),
        ("f_regr_sxy", "round(regr_sxy(l.l_tax, l.l_quantity), 4)", "round(regr_sxy(l_tax, l_quantity), 4)"),
        ("f_list", "size(list(l.l_quantity))", "count(*)"),
        ("f_array_agg", "size(array_agg(DISTINCT l.l_linenumber))", "count(DISTINCT l_linenumber)"),
        ("f_histogram", "map_extract(histogram(l.l_linestatus), 'F')", "count(*) FILTER (l_linestatus = 'F')"),
        ("f_quantile", "reservoir_quantile(l.l_linenumber, 0.5)", "quantile_disc(l_linenumber, 0.5)"),
        ("f_mode", "mode(l.l_returnflag)", "mode(l_returnflag)"),
        ("f_approx", "abs(approx_count_distinct(l.l_quantity) - 50) < 6", "true"),
        ("f_median", "approx_quantile(l.l_linenumber, 0.5)", "quantile_disc(l_linenumber, 0.5)"),
        ("f_sem", "round(sem(l.l_quantity), 8)", "round(stddev_pop(l_quantity) / sqrt(count(*)), 8)"),
    ],
)
GROUPED = {"more_aggregates"}

#: Cypher with its parameters, SQL, graph
TEXTS: dict[str, tuple[str, dict, str, str]] = {
    "aggregate_of_key": (
        "MATCH (n:NATION)<-[:CUST_BELONG_TO]-(c:CUSTOMER) RETURN n.n_nationkey AS k, sum(n.n_nationkey) AS s, count(c) AS n, n.n_nationkey + count(*) AS t",
        {},
        "SELECT n_nationkey AS k, sum(n_nationkey)::BIGINT AS s, count(*) AS n, n_nationkey + count(*) AS t FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
        "star",
    ),
    "outer_variables": (
        "UNWIND [1, 2, 3] AS k MATCH (n:NATION {n_regionkey: k})<-[:SUPP_BELONG_TO]-(s:SUPPLIER) RETURN k, n.n_name AS name, count(s) AS n",
        {},
        "SELECT k, n_name AS name, count(*) AS n FROM (SELECT unnest([1, 2, 3]) AS k) JOIN nation ON n_regionkey = k JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL",
        "star",
    ),
    "parameters": (
        "MATCH (c:CUSTOMER) WHERE c.c_mktsegment = $segment AND c.c_acctbal > $least AND c.c_nationkey IN $nations RETURN c.c_custkey AS k, $mark AS m",
        {"segment": "BUILDING", "least": 100.0, "nations": [1, 2, 3, 4, 5], "mark": "x"},
        "SELECT c_custkey AS k, 'x' AS m FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100 AND c_nationkey IN (1, 2, 3, 4, 5)",
        "star",
    ),
    "trails_beside_hops": (
        "MATCH (a:NATION)-[r:TRADES]->(b:NATION), (c:NATION)-[q:TRADES*1..1]->(d:NATION) WHERE a.n_regionkey = 1 AND c.n_regionkey = 1 RETURN a.n_nationkey AS a, b.n_nationkey AS b, c.n_nationkey AS c, d.n_nationkey AS d",
        {},
        "WITH {trades} SELECT x.s AS a, x.t AS b, y.s AS c, y.t AS d FROM trades x JOIN trades y ON x.e <> y.e JOIN nation n ON n.n_nationkey = x.s JOIN nation m ON m.n_nationkey = y.s WHERE n.n_regionkey = 1 AND m.n_regionkey = 1",
        "trade",
    ),
    "path_parts": (
        "MATCH p = (a:NATION)-[:TRADES]->(b:NATION) RETURN nodes(p)[0] AS a, nodes(p)[1] AS b, size(relationships(p)) AS n, relationships(p)[0] AS e, length(p) AS l",
        {},
        "WITH {trades} SELECT s AS a, t AS b, 1::BIGINT AS n, e::BIGINT AS e, 1::BIGINT AS l FROM trades",
        "trade",
    ),
    "optional_trails": (
        "MATCH (a:NATION) OPTIONAL MATCH (a)<-[:TRADES*1..1]-(b:NATION) RETURN a.n_nationkey AS a, count(b) AS n",
        {},
        "WITH {trades} SELECT n_nationkey AS a, count(t) AS n FROM nation LEFT JOIN trades ON t = n_nationkey GROUP BY 1",
        "trade",
    ),
    "trails_in_predicates": (
        "MATCH (a:NATION) WHERE NOT (a)<-[:TRADES*1..2]-(:NATION) RETURN a.n_nationkey AS a",
        {},
        "WITH {trades} SELECT n_nationkey AS a FROM nation WHERE n_nationkey NOT IN (SELECT t FROM trades)",
        "trade",
    ),
    "many_types_from_zero": (
        "MATCH (s:SUPPLIER)-[:SUPP_BELONG_TO|IS_LOCATED_IN*0..2]->(x) RETURN labels(x)[0] AS label, count(*) AS n",
        {},
        "SELECT 'SUPPLIER' AS label, count(*) AS n FROM supplier UNION ALL SELECT 'NATION', count(*) FROM supplier UNION ALL SELECT 'REGION', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey",
        "star",
    ),
    "ends_of_shortest_paths": (
        "MATCH p = shortestPath((a:NATION)-[:TRADES*]->(b:NATION)) WHERE a.n_nationkey = 0 AND b.n_regionkey IN [1, 2, 3] AND a.n_nationkey <> b.n_nationkey RETURN b.n_nationkey AS b, length(p) AS n",
        {},
        "WITH RECURSIVE {trades}, reach AS (SELECT 0 AS x, 0 AS n UNION SELECT t, n + 1 FROM reach JOIN trades ON s = x WHERE n < 25) SELECT x AS b, min(n)::BIGINT AS n FROM reach JOIN nation ON n_nationkey = x WHERE n_regionkey IN (1, 2, 3) AND x <> 0 AND n > 0 GROUP BY 1",
        "trade",
    ),
    "tpch_q2": (
        "MATCH (p:PART)-[:PARTSUPP]->(s:SUPPLIER)-[:SUPP_BELONG_TO]->(n:NATION)-[:IS_LOCATED_IN]->(r:REGION {r_name: 'EUROPE'}) WHERE p.p_size = 15 WITH p, max(s.s_acctbal) AS most "
        "MATCH (p)-[:PARTSUPP]->(t:SUPPLIER)-[:SUPP_BELONG_TO]->(m:NATION)-[:IS_LOCATED_IN]->(q:REGION {r_name: 'EUROPE'}) WHERE t.s_acctbal = most "
        "RETURN t.s_acctbal AS balance, t.s_name AS name, m.n_name AS nation, p.p_partkey AS k ORDER BY balance DESC, nation, name, k LIMIT 100",
        {},
        "WITH ps AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), x AS (SELECT s_acctbal, s_name, n_name, p_partkey FROM ps JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey "
        "JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE' AND p_size = 15) SELECT s_acctbal AS balance, s_name AS name, n_name AS nation, p_partkey AS k FROM x WHERE s_acctbal = (SELECT max(s_acctbal) FROM x y WHERE y.p_partkey = x.p_partkey) "
        "ORDER BY balance DESC, nation, name, k LIMIT 100",
        "partsupp",
    ),
    "tpch_q4": (
        "MATCH (o:ORDERS) WHERE o.o_orderdate >= date('1997-07-01') AND o.o_orderdate < date('1997-10-01') AND EXISTS { MATCH (l:LINEITEM)-[:IS_PART_OF]->(o) WHERE l.l_quantity > 45.0 } RETURN o.o_orderpriority AS priority, count(*) AS n ORDER BY priority",
        {},
        "SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1",
        "star",
    ),
    "tpch_q11": (
        "MATCH (p:PART)-[:PARTSUPP]->(s:SUPPLIER)-[:SUPP_BELONG_TO]->(n:NATION) WHERE n.n_regionkey = 3 WITH sum(s.s_acctbal) AS total "
        "MATCH (p:PART)-[:PARTSUPP]->(s:SUPPLIER)-[:SUPP_BELONG_TO]->(n:NATION) WHERE n.n_regionkey = 3 WITH p.p_partkey AS k, total, sum(s.s_acctbal) AS own WHERE own > total * 0.0005 RETURN k, round(own, 4) AS own",
        {},
        "WITH ps AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), x AS (SELECT l_partkey, s_acctbal FROM ps JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 3) "
        "SELECT l_partkey AS k, round(sum(s_acctbal), 4) AS own FROM x GROUP BY 1 HAVING sum(s_acctbal) > (SELECT sum(s_acctbal) FROM x) * 0.0005",
        "partsupp",
    ),
    "tpch_q12": (
        "MATCH (l:LINEITEM)-[:IS_PART_OF]->(o:ORDERS) WHERE l.l_returnflag IN ['A', 'R'] AND l.l_shipdate >= date('1998-01-01') AND l.l_shipdate < date('1999-01-01') "
        "RETURN l.l_returnflag AS flag, sum(CASE WHEN o.o_orderpriority = '1-URGENT' OR o.o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS high, sum(CASE WHEN o.o_orderpriority <> '1-URGENT' AND o.o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS low ORDER BY flag",
        {},
        "SELECT l_returnflag AS flag, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS high, sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS low "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1999-01-01' GROUP BY 1",
        "star",
    ),
    "tpch_q16": (
        "MATCH (p:PART)-[:PARTSUPP]->(s:SUPPLIER) WHERE p.p_brand <> 'Brand#1' AND NOT p.p_type STARTS WITH 'PROMO' AND p.p_size IN [49, 14, 23, 45, 19, 3, 36, 9] AND NOT s.s_name CONTAINS '9' "
        "RETURN p.p_brand AS brand, p.p_type AS type, p.p_size AS size, count(DISTINCT s.s_suppkey) AS n ORDER BY n DESC, brand, type, size",
        {},
        "SELECT p_brand AS brand, p_type AS type, p_size AS size, count(DISTINCT s_suppkey) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey "
        "WHERE p_brand <> 'Brand#1' AND NOT starts_with(p_type, 'PROMO') AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND NOT contains(s_name, '9') GROUP BY ALL",
        "partsupp",
    ),
    "tpch_q19": (
        "MATCH (l:LINEITEM)-[:COMPOSED_BY]->(p:PART) WHERE (p.p_type = 'PROMO' AND 1.0 <= l.l_quantity <= 11.0 AND 1 <= p.p_size <= 5) OR (p.p_type = 'SMALL' AND 10.0 <= l.l_quantity <= 20.0 AND 1 <= p.p_size <= 10) "
        "OR (p.p_type = 'LARGE' AND 20.0 <= l.l_quantity <= 30.0 AND 1 <= p.p_size <= 15) RETURN round(sum(l.l_extendedprice * (1 - l.l_discount)), 4) AS revenue",
        {},
        "SELECT round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (p_type = 'PROMO' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) "
        "OR (p_type = 'SMALL' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10) OR (p_type = 'LARGE' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)",
        "star",
    ),
    "tpch_q20": (
        "MATCH (l:LINEITEM)-[:SUPPLIED_BY]->(s:SUPPLIER)-[:SUPP_BELONG_TO]->(n:NATION) WHERE l.l_shipdate >= date('1998-01-01') AND l.l_shipdate < date('1999-01-01') WITH s, n, sum(l.l_quantity) AS q WHERE q > 500.0 AND n.n_regionkey = 2 RETURN s.s_name AS name, q ORDER BY name",
        {},
        "SELECT s_name AS name, sum(l_quantity) AS q FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1999-01-01' AND n_regionkey = 2 "
        "GROUP BY s_suppkey, s_name HAVING sum(l_quantity) > 500",
        "star",
    ),
}
GRAPHS: dict[str, Callable[[SparkSession, str], Graph]] = {"star": star_graph, "trade": trade_graph, "partsupp": lambda s, d: with_partsupp(star_graph(s, d))}


def changed(*statements: str, then: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = star_graph(spark, sf_dir)
        for x in statements:
            g.execute(x)
        return g.sql(then).df

    return query


def csv_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, regions and their edges through typed-header files, with an edge that has a loose end."""
    from ..sources import files

    path = scratch(spark, "csv")
    nations, regions = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("nation", "region"))
    loose = spark.createDataFrame([(999, 1)], "a int, b int")
    for name, df, header in (
        ("nation", nations.select("n_nationkey", "n_name"), "key:ID(NATION)|name:STRING"),
        ("region", regions.select("r_regionkey", "r_name"), "key:ID(REGION)|name:STRING"),
        ("edge", nations.select("n_nationkey", "n_regionkey").union(loose), ":START_ID(NATION)|:END_ID(REGION)"),
    ):
        head = spark.createDataFrame([(header,)], "value string")
        lines = df.selectExpr("concat_ws('|', *) AS value")
        head.union(lines).coalesce(1).write.text(f"{path}/{name}")
    g = Graph(spark)
    files.import_vertices(g, "NATION", f"{path}/nation")
    files.import_vertices(g, "REGION", f"{path}/region")
    files.import_edges(g, "IS_IN", f"{path}/edge")
    return g.sql("MATCH (n:NATION)-[:IS_IN]->(r:REGION) RETURN r.name AS region, count(n) AS n, min(n.name) AS first").df


def workspace_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, changed, saved over itself, loaded."""
    from ..sources import workspace

    path = scratch(spark, "workspace")
    g = Graph(spark)
    read = star_graph(spark, sf_dir).catalog
    g.catalog.add_vertices("NATION", read.vertices["NATION"].df)
    g.catalog.add_vertices("REGION", read.vertices["REGION"].df)
    g.catalog.add_key_edges("IS_LOCATED_IN", "NATION", "REGION", "n_regionkey")
    workspace.save(g, path)
    h = workspace.load(spark, path)
    h.execute("MATCH (n:NATION) WHERE n.n_nationkey < 3 SET n.n_name = 'changed'")
    h.checkpoint(path)
    return workspace.load(spark, path).sql("MATCH (n:NATION)-[:IS_LOCATED_IN]->(r:REGION) RETURN n.n_name AS name, r.r_name AS region").df


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "change_set": (
        changed("MATCH (n:NATION) WHERE n.n_regionkey = 1 SET n.n_name = 'one'", then="MATCH (n:NATION) RETURN n.n_nationkey AS k, n.n_name AS name"),
        "SELECT n_nationkey AS k, CASE WHEN n_regionkey = 1 THEN 'one' ELSE n_name END AS name FROM nation",
    ),
    "change_create": (
        changed("CREATE (n:NATION {n_nationkey: 900, n_name: 'new', n_regionkey: 1})", then="MATCH (n:NATION) RETURN n.n_name AS name"),
        "SELECT n_name AS name FROM nation UNION ALL SELECT 'new'",
    ),
    "change_delete": (
        changed("MATCH (n:NATION) WHERE n.n_nationkey > 10 DETACH DELETE n", then="MATCH (n:NATION) RETURN n.n_nationkey AS k"),
        "SELECT n_nationkey AS k FROM nation WHERE n_nationkey <= 10",
    ),
    "change_remove": (
        changed("MATCH (n:NATION) WHERE n.n_nationkey < 5 REMOVE n.n_name", then="MATCH (n:NATION) RETURN n.n_nationkey AS k, n.n_name AS name"),
        "SELECT n_nationkey AS k, CASE WHEN n_nationkey >= 5 THEN n_name END AS name FROM nation",
    ),
    "change_merge": (
        changed("UNWIND [3, 4, 800, 800, 801] AS k MERGE (n:NATION {n_nationkey: k}) ON CREATE SET n.n_name = 'made' ON MATCH SET n.n_name = 'met'", then="MATCH (n:NATION) RETURN n.n_nationkey AS k, n.n_name AS name"),
        "SELECT n_nationkey AS k, CASE WHEN n_nationkey IN (3, 4) THEN 'met' ELSE n_name END AS name FROM nation UNION ALL VALUES (800, 'made'), (801, 'made')",
    ),
    "csv_import": (csv_import, "SELECT r_name AS region, count(*) AS n, min(n_name) AS first FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "workspace_round": (workspace_round, "SELECT CASE WHEN n_nationkey < 3 THEN 'changed' ELSE n_name END AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
}


def _columns(name: str) -> Callable[[SparkSession, str], DataFrame]:
    pattern, _, columns = COLUMNS[name]
    text = f"{pattern} RETURN " + ", ".join(f"{cypher} AS {alias}" for alias, cypher, _ in columns)
    return lambda spark, sf_dir: star_graph(spark, sf_dir).sql(text).df


def _columns_sql(name: str) -> str:
    _, source, columns = COLUMNS[name]
    listed = ", ".join(f'{sql} AS "{alias.strip("`")}"' for alias, _, sql in columns)
    return f"SELECT {listed} FROM {source}" + " GROUP BY l_returnflag" * (name in GROUPED)


def _text(name: str) -> Callable[[SparkSession, str], DataFrame]:
    cypher, params, _, graph = TEXTS[name]
    return lambda spark, sf_dir: GRAPHS[graph](spark, sf_dir).sql(cypher, params).df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _columns(n) for n in COLUMNS} | {n: _text(n) for n in TEXTS} | {n: f for n, (f, _) in OTHERS.items()}


def oracle_sql(trades: str) -> dict[str, str]:
    """trades: the common table of TRADES."""
    texts = {n: x[2].replace("{trades}", trades) for n, x in TEXTS.items()}
    return {n: _columns_sql(n) for n in COLUMNS} | texts | {n: sql for n, (_, sql) in OTHERS.items()}
