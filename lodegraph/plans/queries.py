"""Queries over the driver's tables: Cypher text, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from . import coverage
from .tables import star_graph, trade_graph, with_partsupp


class Q(NamedTuple):
    cypher: str
    sql: str | None
    graph: str = "star"


REV = "sum(l.l_extendedprice * (1 - l.l_discount))"
SREV = "sum(l_extendedprice * (1 - l_discount))"
#: TRADES as SQL.
TRADES = """trades AS (SELECT c_nationkey AS s, s_nationkey AS t, lines, c_nationkey * 1000 + s_nationkey AS e FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY lines DESC, s_nationkey) AS n FROM (SELECT c_nationkey, s_nationkey, count(*) AS lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey)) WHERE n <= 2)"""
BOTH = f"WITH RECURSIVE {TRADES}, both_ways AS (SELECT s, t, e FROM trades UNION ALL SELECT t, s, e FROM trades)"
ITEMS = "lineitem JOIN orders ON l_orderkey = o_orderkey"

TEXTS: dict[str, Q] = {
    "tpch_q1": Q(
        "MATCH (l:LINEITEM) WHERE l.l_shipdate <= date('2001-06-01') RETURN l.l_returnflag AS flag, l.l_linestatus AS status, sum(l.l_quantity) AS qty, "
        f"round(sum(l.l_extendedprice), 2) AS price, round({REV}, 4) AS disc_price, round(avg(l.l_discount), 6) AS disc, count(*) AS n ORDER BY flag, status",
        f"SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS qty, round(sum(l_extendedprice), 2) AS price, round({SREV}, 4) AS disc_price, round(avg(l_discount), 6) AS disc, count(*) AS n "
        "FROM lineitem WHERE l_shipdate <= DATE '2001-06-01' GROUP BY ALL",
    ),
    "tpch_q3": Q(
        f"MATCH (l:LINEITEM)-[:IS_PART_OF]->(o:ORDERS)-[:MADE_BY]->(c:CUSTOMER) WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderdate < date('1998-03-15') AND l.l_shipdate > date('1998-03-15') WITH o, round({REV}, 4) AS revenue RETURN o.o_orderkey AS k, o.o_orderdate AS d, revenue ORDER BY revenue DESC, d, k LIMIT 10",
        f"SELECT o_orderkey AS k, o_orderdate AS d, round({SREV}, 4) AS revenue FROM {ITEMS} JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY 1, 2 ORDER BY revenue DESC, d, k LIMIT 10",
    ),
    "tpch_q5": Q(
        f"MATCH (l:LINEITEM)-[:IS_PART_OF]->(o:ORDERS)-[:MADE_BY]->(c:CUSTOMER)-[:CUST_BELONG_TO]->(n:NATION)-[:IS_LOCATED_IN]->(r:REGION {{r_name: 'ASIA'}}), (l)-[:SUPPLIED_BY]->(s:SUPPLIER)-[:SUPP_BELONG_TO]->(n) WHERE o.o_orderdate >= date('1996-01-01') AND o.o_orderdate < date('1999-01-01') RETURN n.n_name AS nation, round({REV}, 4) AS revenue ORDER BY revenue DESC",
        f"SELECT n_name AS nation, round({SREV}, 4) AS revenue FROM {ITEMS} JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1999-01-01' GROUP BY 1",
    ),
    "tpch_q6": Q(
        "MATCH (l:LINEITEM) WHERE l.l_shipdate >= date('1997-01-01') AND l.l_shipdate < date('1998-01-01') AND 0.07 >= l.l_discount >= 0.05 AND l.l_quantity < 24 RETURN round(sum(l.l_extendedprice * l.l_discount), 4) AS revenue",
        "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    ),
    "tpch_q7": Q(
        f"MATCH (l:LINEITEM)-[:SUPPLIED_BY]->(s:SUPPLIER)-[:SUPP_BELONG_TO]->(n1:NATION), (l)-[:IS_PART_OF]->(o:ORDERS)-[:MADE_BY]->(c:CUSTOMER)-[:CUST_BELONG_TO]->(n2:NATION) WHERE (n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1') RETURN n1.n_name AS supp, n2.n_name AS cust, l.l_shipdate.year AS y, round({REV}, 4) AS volume ORDER BY supp, cust, y",
        f"SELECT n1.n_name AS supp, n2.n_name AS cust, year(l_shipdate) AS y, round({SREV}, 4) AS volume FROM {ITEMS} JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey WHERE (n1.n_name, n2.n_name) IN (('NATION_1', 'NATION_2'), ('NATION_2', 'NATION_1')) GROUP BY ALL",
    ),
    "tpch_q8": Q(
        f"MATCH (l:LINEITEM)-[:COMPOSED_BY]->(p:PART {{p_type: 'PROMO'}}), (l)-[:IS_PART_OF]->(o:ORDERS)-[:MADE_BY]->(:CUSTOMER)-[:CUST_BELONG_TO]->(:NATION)-[:IS_LOCATED_IN]->(r:REGION {{r_name: 'AMERICA'}}), (l)-[:SUPPLIED_BY]->(:SUPPLIER)-[:SUPP_BELONG_TO]->(n:NATION) WITH o.o_orderdate.year AS y, l.l_extendedprice * (1 - l.l_discount) AS v, n.n_name AS nation RETURN y, round(sum(CASE WHEN nation = 'NATION_3' THEN v ELSE 0.0 END) / sum(v), 6) AS share ORDER BY y",
        f"SELECT year(o_orderdate) AS y, round(sum(CASE WHEN n2.n_name = 'NATION_3' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / {SREV}, 6) AS share FROM {ITEMS} JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE p_type = 'PROMO' AND r_name = 'AMERICA' GROUP BY 1",
    ),
    "tpch_q9": Q(
        f"MATCH (l:LINEITEM)-[:SUPPLIED_BY]->(s:SUPPLIER), (l)-[:COMPOSED_BY]->(p:PART), (l)-[:IS_PART_OF]->(o:ORDERS), (p)-[:PARTSUPP]->(s), (s)-[:SUPP_BELONG_TO]->(n:NATION) WHERE p.p_name CONTAINS 'bolt' WITH l, n, o ORDER BY n.n_name, o.o_orderdate.year DESC RETURN n.n_name AS nation, o.o_orderdate.year AS year, round({REV}, 4) AS amount",
        f"SELECT n_name AS nation, year(o_orderdate) AS year, round({SREV}, 4) AS amount FROM {ITEMS} JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%bolt%' GROUP BY ALL",
        "partsupp",
    ),
    "tpch_q10": Q(
        f"MATCH (l:LINEITEM)-[:IS_PART_OF]->(o:ORDERS)-[:MADE_BY]->(c:CUSTOMER)-[:CUST_BELONG_TO]->(n:NATION) WHERE l.l_returnflag = 'R' AND o.o_orderdate.year = 1998 WITH c, n, round({REV}, 4) AS revenue RETURN c.c_custkey AS k, c.c_name AS name, revenue, c.c_acctbal AS bal, n.n_name AS nation ORDER BY revenue DESC, k LIMIT 20",
        f"SELECT c_custkey AS k, c_name AS name, round({SREV}, 4) AS revenue, c_acctbal AS bal, n_name AS nation FROM {ITEMS} JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' AND year(o_orderdate) = 1998 GROUP BY ALL ORDER BY revenue DESC, k LIMIT 20",
    ),
    "tpch_q13": Q(
        "MATCH (c:CUSTOMER) OPTIONAL MATCH (c)<-[:MADE_BY]-(o:ORDERS) WHERE o.o_orderstatus = 'F' WITH c, count(o) AS n RETURN n, count(*) AS customers ORDER BY customers DESC, n DESC",
        "SELECT n, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1) GROUP BY 1",
    ),
    "tpch_q14": Q(
        "MATCH (l:LINEITEM)-[:COMPOSED_BY]->(p:PART) WHERE l.l_shipdate.year = 1999 RETURN round(100.0 * sum(CASE WHEN p.p_type STARTS WITH 'PROMO' THEN l.l_extendedprice * (1 - l.l_discount) ELSE 0.0 END) / sum(l.l_extendedprice * (1 - l.l_discount)), 6) AS promo",
        f"SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0 END) / {SREV}, 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = 1999",
    ),
    "tpch_q15": Q(
        f"MATCH (l:LINEITEM)-[:SUPPLIED_BY]->(s:SUPPLIER) WHERE l.l_shipdate.year = 1999 WITH s, round({REV}, 4) AS total WITH max(total) AS best MATCH (l:LINEITEM)-[:SUPPLIED_BY]->(s:SUPPLIER) WHERE l.l_shipdate.year = 1999 WITH best, s, round({REV}, 4) AS total WHERE total = best RETURN s.s_suppkey AS k, s.s_name AS name, total ORDER BY k",
        f"WITH r AS (SELECT l_suppkey, round({SREV}, 4) AS total FROM lineitem WHERE year(l_shipdate) = 1999 GROUP BY 1) SELECT s_suppkey AS k, s_name AS name, total FROM supplier JOIN r ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM r)",
    ),
    "tpch_q17": Q(
        "MATCH (l:LINEITEM)-[:COMPOSED_BY]->(p:PART) WHERE p.p_brand = 'Brand#23' WITH p, avg(l.l_quantity) AS mean MATCH (i:LINEITEM)-[:COMPOSED_BY]->(p) WHERE i.l_quantity < 0.5 * mean RETURN round(sum(i.l_extendedprice) / 7.0, 4) AS yearly",
        "SELECT round(sum(l_extendedprice) / 7.0, 4) AS yearly FROM lineitem l JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#23' AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)",
    ),
    "tpch_q18": Q(
        "MATCH (l:LINEITEM)-[:IS_PART_OF]->(o:ORDERS) WITH o, sum(l.l_quantity) AS qty WHERE qty > 250 MATCH (o)-[:MADE_BY]->(c:CUSTOMER) RETURN c.c_name AS name, c.c_custkey AS ck, o.o_orderkey AS ok, o.o_orderdate AS d, o.o_totalprice AS price, qty ORDER BY price DESC, d, ok LIMIT 100",
        "SELECT c_name AS name, c_custkey AS ck, o_orderkey AS ok, o_orderdate AS d, o_totalprice AS price, qty FROM (SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 250) JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey ORDER BY price DESC, d, ok LIMIT 100",
    ),
    "tpch_q21": Q(
        "MATCH (l1:LINEITEM)-[:SUPPLIED_BY]->(s:SUPPLIER), (l1)-[:IS_PART_OF]->(o:ORDERS), (s)-[:SUPP_BELONG_TO]->(n:NATION) WHERE n.n_regionkey = 1 AND o.o_orderstatus = 'F' AND EXISTS { MATCH (l2:LINEITEM)-[:IS_PART_OF]->(o) WHERE s.s_suppkey <> l2.l_suppkey } AND NOT EXISTS { MATCH (l3:LINEITEM)-[:IS_PART_OF]->(o) WHERE s.s_suppkey <> l3.l_suppkey AND l3.l_returnflag = 'R' } RETURN s.s_name AS name, count(*) AS numwait ORDER BY numwait DESC, name LIMIT 100",
        "SELECT s_name AS name, count(*) AS numwait FROM lineitem l1 JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> s_suppkey) AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> s_suppkey AND l3.l_returnflag = 'R') GROUP BY 1 ORDER BY numwait DESC, name LIMIT 100",
    ),
    "tpch_q22": Q(
        "MATCH (c:CUSTOMER) WHERE c.c_acctbal > 0.0 WITH avg(c.c_acctbal) AS mean MATCH (c:CUSTOMER) WHERE c.c_acctbal > mean AND NOT EXISTS { MATCH (c)<-[:MADE_BY]-(o:ORDERS) WHERE o.o_orderstatus = 'P' } RETURN substring(c.c_mktsegment, 0, 2) AS code, count(*) AS n, round(sum(c.c_acctbal), 2) AS total ORDER BY code",
        "SELECT substring(c_mktsegment, 1, 2) AS code, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY 1",
    ),
    # patterns
    "hop_both_ways": Q(
        "MATCH (a:NATION)-[t:TRADES]-(b:NATION) RETURN a.n_name AS a, b.n_name AS b, t.lines AS lines",
        f"{BOTH}, u AS (SELECT s, t, lines FROM trades UNION ALL SELECT t, s, lines FROM trades) SELECT x.n_name AS a, y.n_name AS b, lines FROM u JOIN nation x ON s = x.n_nationkey JOIN nation y ON t = y.n_nationkey",
        "trade",
    ),
    "two_hops_without_repeats": Q(
        "MATCH (a:NATION)-[:TRADES]-(b:NATION)-[:TRADES]-(c:NATION) RETURN a.n_nationkey AS a, c.n_nationkey AS c, count(*) AS n",
        f"{BOTH} SELECT x.s AS a, y.t AS c, count(*) AS n FROM both_ways x JOIN both_ways y ON x.t = y.s AND x.e <> y.e GROUP BY ALL",
        "trade",
    ),
    "cycle": Q(
        "MATCH (a:NATION)-[:TRADES]->(b:NATION)-[:TRADES]->(a) RETURN a.n_name AS a, b.n_name AS b",
        f"WITH {TRADES} SELECT n.n_name AS a, m.n_name AS b FROM trades x JOIN trades y ON x.t = y.s AND y.t = x.s AND x.e <> y.e JOIN nation n ON n.n_nationkey = x.s JOIN nation m ON m.n_nationkey = x.t",
        "trade",
    ),
    "disconnected": Q("MATCH (a:REGION), (b:REGION) WHERE a.r_regionkey < b.r_regionkey RETURN a.r_name AS a, b.r_name AS b", "SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey"),
    "label_inference": Q("MATCH (n)-[x:IS_LOCATED_IN]->(r) RETURN n.n_name AS n, r.r_name AS r, type(x) AS t", "SELECT n_name AS n, r_name AS r, 'IS_LOCATED_IN' AS t FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "many_types": Q(
        "MATCH (x)-[r:CUST_BELONG_TO|SUPP_BELONG_TO]->(n:NATION) RETURN n.n_name AS n, type(r) AS t, count(*) AS k",
        "SELECT n_name AS n, t, count(*) AS k FROM (SELECT c_nationkey AS k, 'CUST_BELONG_TO' AS t FROM customer UNION ALL SELECT s_nationkey, 'SUPP_BELONG_TO' FROM supplier) x JOIN nation ON n_nationkey = x.k GROUP BY ALL",
    ),
    "labels_of_all": Q(
        "MATCH (n) RETURN labels(n)[0] AS l, count(*) AS k",
        " UNION ALL ".join(f"SELECT '{t.upper()}' AS l, count(*) AS k FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")),
    ),
    "optional_chain": Q(
        "MATCH (o:ORDERS) WHERE o.o_orderkey < 200 OPTIONAL MATCH (o)<-[:IS_PART_OF]-(l:LINEITEM)-[:COMPOSED_BY]->(p:PART) WHERE p.p_size < 10 RETURN o.o_orderkey AS k, p.p_partkey AS p",
        "SELECT o_orderkey AS k, p_partkey AS p FROM orders LEFT JOIN (SELECT l_orderkey, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10) ON l_orderkey = o_orderkey WHERE o_orderkey < 200",
    ),
    "pattern_predicate": Q("MATCH (n:NATION) WHERE NOT (n)<-[:TRADES]-(:NATION) RETURN n.n_name AS n", f"WITH {TRADES} SELECT n_name AS n FROM nation WHERE n_nationkey NOT IN (SELECT t FROM trades)", "trade"),
    "pattern_as_value": Q(
        "MATCH (n:NATION) RETURN n.n_name AS n, (n)<-[:TRADES]-(:NATION)<-[:TRADES]-(:NATION) AS two, exists((n)<-[:TRADES]-()) AS one",
        f"WITH {TRADES} SELECT n_name AS n, n_nationkey IN (SELECT y.t FROM trades x JOIN trades y ON x.t = y.s AND x.e <> y.e) AS two, n_nationkey IN (SELECT t FROM trades) AS one FROM nation",
        "trade",
    ),
    "pattern_comprehension": Q(
        "MATCH (n:NATION) RETURN n.n_name AS n, list_sum([(n)-[t:TRADES]->(m:NATION) WHERE m.n_nationkey > 5 | t.lines]) AS lines",
        f"WITH {TRADES} SELECT n_name AS n, coalesce(sum(lines), 0)::DOUBLE AS lines FROM nation LEFT JOIN trades ON s = n_nationkey AND t > 5 GROUP BY 1",
        "trade",
    ),
    "distinct_entities": Q("MATCH (o:ORDERS)-[:MADE_BY]->(c:CUSTOMER) WITH DISTINCT c RETURN count(c) AS n, round(sum(c.c_acctbal), 2) AS s", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS s FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "union": Q("MATCH (r:REGION) RETURN r.r_name AS n UNION MATCH (r:REGION) RETURN r.r_name AS n", "SELECT r_name AS n FROM region"),
    "union_all": Q("MATCH (r:REGION) RETURN r.r_name AS n UNION ALL MATCH (x:NATION) RETURN x.n_name AS n", "SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation"),
    "unwind": Q("UNWIND [3, 1, 2] AS x UNWIND range(1, x) AS y RETURN x, y", "SELECT x::INTEGER AS x, unnest(range(1, x + 1)) AS y FROM (VALUES (3), (1), (2)) v(x)"),
    "skip_limit": Q("MATCH (p:PART) RETURN p.p_partkey AS k ORDER BY p.p_retailprice DESC, k SKIP 5 LIMIT 7", "SELECT p_partkey AS k FROM part ORDER BY p_retailprice DESC, k LIMIT 7 OFFSET 5"),
    "case_forms": Q(
        "MATCH (p:PART) RETURN CASE p.p_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 ELSE 3 END AS a, CASE WHEN p.p_size > 25 THEN 'big' END AS b, count(*) AS n",
        "SELECT CASE p_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 ELSE 3 END AS a, CASE WHEN p_size > 25 THEN 'big' END AS b, count(*) AS n FROM part GROUP BY ALL",
    ),
    "comprehensions": Q(
        "MATCH (n:NATION) WITH collect(n.n_nationkey) AS ks RETURN size([k IN ks WHERE k % 2 = 0 | k * 10]) AS evens, reduce(s = 0, k IN ks | s + k) AS total, any(k IN ks WHERE k > 23) AS some, all(k IN ks WHERE k >= 0) AS every, none(k IN ks WHERE k < 0) AS no",
        "SELECT count(*) FILTER (n_nationkey % 2 = 0) AS evens, sum(n_nationkey)::INTEGER AS total, bool_or(n_nationkey > 23) AS some, bool_and(n_nationkey >= 0) AS every, true AS no FROM nation",
    ),
    "maps": Q("MATCH (r:REGION) WITH {name: r.r_name, key: r.r_regionkey} AS m RETURN m.name AS name, m.key + 1 AS k", "SELECT r_name AS name, r_regionkey + 1 AS k FROM region"),
    "ordered_head": Q(
        "MATCH (o:ORDERS)-[:MADE_BY]->(c:CUSTOMER) WITH c, o ORDER BY o.o_totalprice DESC, o.o_orderkey WITH c.c_custkey AS k, collect(o.o_orderkey) AS keys "
        "RETURN k, head(keys) AS dearest, keys[1] AS second, keys[-1] AS cheapest, size(keys) AS n",
        "SELECT o_custkey AS k, keys[1] AS dearest, keys[2] AS second, keys[-1] AS cheapest, len(keys) AS n FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS keys FROM orders GROUP BY 1)",
    ),
    "null_order": Q("UNWIND [1, null, 2] AS x RETURN x ORDER BY x DESC LIMIT 2", "SELECT * FROM (VALUES (NULL::INTEGER), (2)) v(x)"),
    # paths
    "trails": Q(
        "MATCH (a:NATION)-[r:TRADES*1..3]->(b:NATION) RETURN size(r) AS hops, count(*) AS n",
        f"WITH RECURSIVE {TRADES}, w AS (SELECT t, [e] AS es FROM trades UNION ALL SELECT x.t, list_append(es, x.e) FROM w JOIN trades x ON w.t = x.s AND NOT list_contains(es, x.e) WHERE len(es) < 3) SELECT len(es)::BIGINT AS hops, count(*) AS n FROM w GROUP BY 1",
        "trade",
    ),
    "trails_from_zero": Q(
        "MATCH (a:NATION {n_nationkey: 3})-[:TRADES*0..2]-(b:NATION) RETURN b.n_name AS b, count(*) AS n",
        f"{BOTH}, w AS (SELECT n_nationkey AS t, []::INTEGER[] AS es FROM nation WHERE n_nationkey = 3 UNION ALL SELECT x.t, list_append(es, x.e) FROM w JOIN both_ways x ON w.t = x.s AND NOT list_contains(es, x.e) WHERE len(es) < 2) SELECT n_name AS b, count(*) AS n FROM w JOIN nation ON t = n_nationkey GROUP BY 1",
        "trade",
    ),
    "shortest_path": Q(
        "MATCH (a:NATION {n_nationkey: 0}), (b:NATION), p = shortestPath((a)-[:TRADES*]-(b)) WHERE NOT a = b RETURN b.n_nationkey AS b, length(p) AS hops",
        f"{BOTH}, w AS (SELECT 0 AS t, 0 AS d UNION SELECT x.t, d + 1 FROM w JOIN both_ways x ON w.t = x.s WHERE d < 8) SELECT t AS b, min(d)::BIGINT AS hops FROM w WHERE t <> 0 GROUP BY 1",
        "trade",
    ),
    "all_shortest_paths": Q(
        "MATCH (a:NATION {n_nationkey: 0}), (b:NATION), p = allShortestPaths((a)-[:TRADES*]->(b)) RETURN b.n_nationkey AS b, length(p) AS hops, count(*) AS n",
        f"WITH RECURSIVE {TRADES}, w AS (SELECT t, 1 AS d, [e] AS es FROM trades WHERE s = 0 UNION ALL SELECT x.t, d + 1, list_append(es, x.e) FROM w JOIN trades x ON w.t = x.s AND NOT list_contains(es, x.e) WHERE d < 9), m AS (SELECT t, min(d) AS d FROM w GROUP BY 1) SELECT w.t AS b, w.d::BIGINT AS hops, count(*) AS n FROM w JOIN m ON w.t = m.t AND w.d = m.d GROUP BY ALL",
        "trade",
    ),
    # whole tables and all sources, where the queries above take some keys
    "optional_chain_of_all": Q(
        "MATCH (o:ORDERS) OPTIONAL MATCH (o)<-[:IS_PART_OF]-(l:LINEITEM)-[:COMPOSED_BY]->(p:PART) WHERE p.p_size < 10 RETURN o.o_orderkey AS k, p.p_partkey AS p",
        "SELECT o_orderkey AS k, p_partkey AS p FROM orders LEFT JOIN (SELECT l_orderkey, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10) ON l_orderkey = o_orderkey",
    ),
    "ordered_head_of_all": Q(
        "MATCH (o:ORDERS)-[:MADE_BY]->(c:CUSTOMER) RETURN c.c_custkey AS k, max_by(o.o_orderkey, o.o_totalprice) AS dearest",
        "SELECT o_custkey AS k, max_by(o_orderkey, o_totalprice) AS dearest FROM orders GROUP BY 1",
    ),
    "shortest_path_of_all": Q(
        "MATCH (a:NATION), (b:NATION), p = shortestPath((a)-[:TRADES*]-(b)) WHERE NOT a = b RETURN a.n_nationkey AS a, b.n_nationkey AS b, length(p) AS hops",
        f"{BOTH}, w AS (SELECT n_nationkey AS a, n_nationkey AS t, 0 AS d FROM nation UNION SELECT a, x.t, d + 1 FROM w JOIN both_ways x ON w.t = x.s WHERE d < 25) SELECT a, t AS b, min(d)::BIGINT AS hops FROM w WHERE t <> a GROUP BY ALL",
        "trade",
    ),
    "all_shortest_paths_of_all": Q(
        "MATCH (a:NATION), (b:NATION), p = allShortestPaths((a)-[:TRADES*]->(b)) RETURN a.n_nationkey AS a, b.n_nationkey AS b, length(p) AS hops, count(*) AS n",
        f"WITH RECURSIVE {TRADES}, r AS (SELECT s AS a, t, 1 AS d FROM trades UNION SELECT a, x.t, d + 1 FROM r JOIN trades x ON r.t = x.s WHERE d < 25), m AS (SELECT a, t, min(d) AS d FROM r GROUP BY ALL), "
        "w AS (SELECT s AS a, t, 1 AS d FROM trades UNION ALL SELECT w.a, x.t, w.d + 1 FROM w JOIN trades x ON w.t = x.s JOIN m ON m.a = w.a AND m.t = x.t AND m.d = w.d + 1) SELECT a, t AS b, d::BIGINT AS hops, count(*) AS n FROM w GROUP BY ALL",
        "trade",
    ),
    # functions
    "string_functions": Q(
        "MATCH (p:PART) RETURN p.p_partkey AS k, toUpper(p.p_name) AS a, toLower(p.p_brand) AS b, left(p.p_name, 3) AS c, right(p.p_name, 2) AS d, lpad(p.p_type, 9, '*') AS e, rpad(p.p_type, 9, '*') AS f, replace(p.p_brand, '#', '-') AS g, reverse(p.p_name) AS h, trim('  x ') AS i, "
        "concat(p.p_type, null, '!') AS j, p.p_type || '?' AS l, size(p.p_name) AS m, instr(p.p_brand, '#') AS n, repeat('ab', 2) AS o, levenshtein(p.p_type, 'PROMO') AS q, substring(p.p_name, 1, 2) AS r, p.p_name =~ '.*1' AS s, regexp_replace(p.p_name, '[0-9]', '_') AS t, string_split(p.p_brand, '#')[1] AS u, toString(p.p_size) AS v, ascii(p.p_name) AS w, strip_accents('éà') AS x, hamming('abc', 'abd') AS y, toInteger('x') IS NULL AS z",
        "SELECT p_partkey AS k, upper(p_name) AS a, lower(p_brand) AS b, left(p_name, 3) AS c, right(p_name, 2) AS d, lpad(p_type, 9, '*') AS e, rpad(p_type, 9, '*') AS f, replace(p_brand, '#', '-') AS g, reverse(p_name) AS h, 'x' AS i, "
        "concat(p_type, NULL, '!') AS j, p_type || '?' AS l, length(p_name) AS m, instr(p_brand, '#') AS n, 'abab' AS o, levenshtein(p_type, 'PROMO')::INTEGER AS q, substring(p_name, 2, 2) AS r, regexp_full_match(p_name, '.*1') AS s, regexp_replace(p_name, '[0-9]', '_') AS t, string_split(p_brand, '#')[2] AS u, p_size::VARCHAR AS v, ascii(p_name) AS w, 'ea' AS x, 1::BIGINT AS y, true AS z FROM part",
    ),
    "math_functions": Q(
        "MATCH (p:PART) RETURN p.p_partkey AS k, abs(0 - p.p_size) AS a, ceil(p.p_retailprice) AS b, floor(p.p_retailprice) AS c, round(sqrt(p.p_retailprice), 6) AS d, round(ln(p.p_retailprice), 6) AS e, round(log2(p.p_size), 6) AS f, p.p_size / 7 AS g, p.p_size % 7 AS h, p.p_size ^ 2 AS i, p.p_size & 12 AS j, p.p_size << 2 AS l, even(2.5) AS m, factorial(5) AS n, 4! AS o, sign(-2.5) AS q, round(gamma(4.5), 6) AS r, (p.p_size / 0) IS NULL AS s",
        "SELECT p_partkey AS k, abs(0 - p_size) AS a, ceil(p_retailprice)::BIGINT AS b, floor(p_retailprice)::BIGINT AS c, round(sqrt(p_retailprice), 6) AS d, round(ln(p_retailprice), 6) AS e, round(log2(p_size), 6) AS f, (p_size // 7)::BIGINT AS g, p_size % 7 AS h, pow(p_size, 2) AS i, p_size & 12 AS j, p_size << 2 AS l, even(2.5::DOUBLE) AS m, 120::BIGINT AS n, 24::BIGINT AS o, -1.0::DOUBLE AS q, round(gamma(4.5), 6) AS r, true AS s FROM part",
    ),
    "date_functions": Q(
        "MATCH (o:ORDERS) RETURN o.o_orderkey AS k, o.o_orderdate.year AS a, o.o_orderdate.month AS b, o.o_orderdate.day AS c, date_part('quarter', o.o_orderdate) AS d, date_trunc('month', o.o_orderdate) AS e, date_diff('year', date('1990-06-01'), o.o_orderdate) AS f, date_sub('month', date('1990-06-15'), o.o_orderdate) AS g, strftime(o.o_orderdate, '%Y/%m/%d') AS i, make_date(2000, 2, 29) AS j, date_part('dow', o.o_orderdate) AS l, date_part('century', o.o_orderdate) AS m",
        "SELECT o_orderkey AS k, year(o_orderdate) AS a, month(o_orderdate) AS b, day(o_orderdate) AS c, quarter(o_orderdate) AS d, date_trunc('month', o_orderdate)::TIMESTAMP AS e, date_diff('year', TIMESTAMP '1990-06-01', o_orderdate) AS f, date_sub('month', TIMESTAMP '1990-06-15', o_orderdate) AS g, strftime(o_orderdate, '%Y/%m/%d') AS i, DATE '2000-02-29' AS j, dayofweek(o_orderdate) AS l, century(o_orderdate) AS m FROM orders",
    ),
    "list_functions": Q(
        "UNWIND range(0, 4) AS i WITH i, [10, 20, 30, 40] AS l RETURN i, l[i] AS a, l[-1] AS b, size(l[1..3]) AS c, 20 IN l AS d, list_position(l, 30) AS e, head(l) AS f, list_sum(l) AS g, size(range(5, 1)) AS h, size(range(5, 1, -2)) AS j, list_contains(l, 7) AS m",
        "SELECT i, [10, 20, 30, 40][i + 1] AS a, 40 AS b, 2::BIGINT AS c, true AS d, 3::BIGINT AS e, 10 AS f, 100.0::DOUBLE AS g, 0::BIGINT AS h, 3::BIGINT AS j, false AS m FROM (SELECT unnest(range(0, 5)) AS i)",
    ),
    "aggregates": Q(
        "MATCH (l:LINEITEM) RETURN l.l_returnflag AS k, count(DISTINCT l.l_suppkey) AS a, min(l.l_quantity) AS b, max(l.l_shipdate) AS c, round(stddev(l.l_quantity), 6) AS d, round(var_pop(l.l_tax), 8) AS e, bit_or(l.l_linenumber) AS f, bool_or(l.l_quantity > 49.0) AS g, round(skewness(l.l_quantity), 6) AS h, round(kurtosis(l.l_quantity), 6) AS i, round(entropy(l.l_linestatus), 6) AS j, round(corr(l.l_quantity, l.l_extendedprice), 6) AS m, round(sem(l.l_quantity), 8) AS n, size(collect(DISTINCT l.l_linestatus)) AS o",
        "SELECT l_returnflag AS k, count(DISTINCT l_suppkey) AS a, min(l_quantity) AS b, max(l_shipdate) AS c, round(stddev(l_quantity), 6) AS d, round(var_pop(l_tax), 8) AS e, bit_or(l_linenumber) AS f, bool_or(l_quantity > 49) AS g, round(skewness(l_quantity), 6) AS h, round(kurtosis(l_quantity), 6) AS i, round(entropy(l_linestatus), 6) AS j, round(corr(l_quantity, l_extendedprice), 6) AS m, round(sem(l_quantity), 8) AS n, count(DISTINCT l_linestatus) AS o FROM lineitem GROUP BY 1",
    ),
    "regressions": Q(
        "MATCH (l:LINEITEM) RETURN l.l_linestatus AS k, regr_count(l.l_extendedprice, l.l_quantity) AS a, round(regr_slope(l.l_extendedprice, l.l_quantity), 4) AS b, round(regr_intercept(l.l_extendedprice, l.l_quantity), 4) AS c, round(regr_r2(l.l_extendedprice, l.l_quantity), 8) AS d, round(covar_pop(l.l_extendedprice, l.l_quantity), 2) AS e, round(regr_avgx(l.l_extendedprice, l.l_quantity), 6) AS f, round(regr_sxx(l.l_extendedprice, l.l_quantity), 2) AS g",
        "SELECT l_linestatus AS k, regr_count(l_extendedprice, l_quantity)::BIGINT AS a, round(regr_slope(l_extendedprice, l_quantity), 4) AS b, round(regr_intercept(l_extendedprice, l_quantity), 4) AS c, round(regr_r2(l_extendedprice, l_quantity), 8) AS d, round(covar_pop(l_extendedprice, l_quantity), 2) AS e, round(regr_avgx(l_extendedprice, l_quantity), 6) AS f, round(regr_sxx(l_extendedprice, l_quantity), 2) AS g FROM lineitem GROUP BY 1",
    ),
}
GRAPHS: dict[str, Callable] = {"star": star_graph, "partsupp": lambda s, d: with_partsupp(star_graph(s, d)), "trade": trade_graph}


def _query(q: Q) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: GRAPHS[q.graph](spark, sf_dir).sql(q.cypher).df


def fluent_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_graph(spark, sf_dir).node("NATION").degree("TRADES", "in").project("id", "degree").df


def fluent_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = star_graph(spark, sf_dir)
    r = g.sql("MATCH (c:CUSTOMER)-[:CUST_BELONG_TO]->(n:NATION) RETURN c.c_custkey AS k, n.n_name AS n, c.c_acctbal AS b")
    return r.filter("b > 100.0").aggregate("count(*) AS n_customers, round(max(b), 2) AS most", "n").order("n").df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _query(q) for k, q in TEXTS.items()} | {"fluent_degree": fluent_degree, "fluent_pipeline": fluent_pipeline} | coverage.queries()


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in TEXTS.items() if q.sql} | {
        "fluent_degree": f"WITH {TRADES} SELECT t AS id, count(*) AS degree FROM trades GROUP BY 1",
        "fluent_pipeline": "SELECT n_name AS n, count(*) AS n_customers, round(max(c_acctbal), 2) AS most FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 100 GROUP BY 1",
    } | coverage.oracle_sql(TRADES)
