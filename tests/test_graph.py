"""Semantics on small graphs: trails, loops, parallel edges, nulls, changes, files, the fluent API."""

import datetime

import pytest
from lodegraph.graph import Graph
from lodegraph.operators.paths import pair_weights, path_weight
from lodegraph.plans.parser import CypherError, parse
from lodegraph.sources import files, workspace
from lodegraph.sources.render import FORMS, render


@pytest.fixture
def g(spark):
    """A triangle 1-2-3, a loop at 3, parallel edges 3-4, an isolated node 5."""
    out = Graph(spark)
    people = [(1, "Alice", 30), (2, "Bob", None), (3, "Carol", 41), (4, "Dan", 25), (5, "Eve", 60)]
    out.catalog.add_vertices("Person", spark.createDataFrame(people, "id long, name string, age long"), "id", parents=("Being",))
    out.catalog.add_vertices("Pet", spark.createDataFrame([(1, "Rex")], "id long, name string"), "id", parents=("Being",))
    knows = [(1, 1, 2, 2010), (2, 2, 3, 2011), (3, 3, 1, 2012), (4, 3, 3, 2013), (5, 3, 4, 2014), (6, 3, 4, 2015)]
    out.catalog.add_edges("KNOWS", "Person", "Person", spark.createDataFrame(knows, "_eid long, _sid long, _tid long, year long"))
    out.catalog.add_edges("OWNS", "Person", "Pet", spark.createDataFrame([(1, 1, 1)], "_eid long, _sid long, _tid long"))
    return out


def rows(g, text, **params):
    return sorted((tuple(r) for r in g.sql(text, params).df.collect()), key=repr)


def test_patterns(g):
    assert rows(g, "MATCH (a:Person)-[:KNOWS]->(b) RETURN count(*) AS n") == [(6,)]
    assert rows(g, "MATCH (a:Person)-[:KNOWS]-(b) RETURN count(*) AS n") == [(11,)]  # the loop once
    assert rows(g, "MATCH (a:Person {id: 3})-[:KNOWS]-(b) RETURN count(*) AS n") == [(5,)]
    assert rows(g, "MATCH (a)-[r:KNOWS]->(b)-[s:KNOWS]->(a) WHERE a <> b RETURN count(*) AS n") == [(0,)]
    assert rows(g, "MATCH (n:Being) RETURN n.name AS n") == [("Alice",), ("Bob",), ("Carol",), ("Dan",), ("Eve",), ("Rex",)]
    assert rows(g, "MATCH (n:Being) WHERE n.age IS NULL RETURN n.name AS n, labels(n) AS l") == [("Bob", ["Person", "Being"]), ("Rex", ["Pet", "Being"])]
    assert rows(g, "MATCH (a)-[:OWNS]->(x) RETURN a.name AS a, x.name AS x") == [("Alice", "Rex")]
    assert rows(g, "MATCH (a:Person), (b:Pet) RETURN count(*) AS n") == [(5,)]
    assert rows(g, "MATCH (a:Person {name: $n}) RETURN a.id AS i", n="O'Brien' OR 1=1") == []


def test_trails_and_paths(g):
    # from 1: 1-2, 1-2-3, then 1-2-3-1, 1-2-3-3, 1-2-3-4 twice
    assert rows(g, "MATCH (a:Person {id: 1})-[r:KNOWS*1..3]->(b) RETURN size(r) AS n, count(*) AS k") == [(1, 1), (2, 1), (3, 4)]
    assert rows(g, "MATCH (a:Person {id: 1})-[:KNOWS*0..1]->(b) RETURN b.id AS b") == [(1,), (2,)]
    assert rows(g, "MATCH (a:Person {id: 1})-[:KNOWS*]->(b) RETURN count(*) AS n")[0][0] == brute_trails(1)
    assert rows(g, "MATCH (a:Person {id: 1})-[r:KNOWS*2]->(b) RETURN b.id AS b") == [(3,)]
    assert rows(g, "MATCH p = (a:Person {id: 1})-[:KNOWS*2]->(b) RETURN nodes(p) AS n, relationships(p) AS r, length(p) AS l") == [([1, 2, 3], [1, 2], 2)]
    assert rows(g, "MATCH (a:Person {id: 1}), (b:Person {id: 4}), p = shortestPath((a)-[:KNOWS*]->(b)) RETURN length(p) AS l, relationships(p) AS r") == [(3, [1, 2, 5])]
    assert len(rows(g, "MATCH (a:Person {id: 1}), (b:Person {id: 4}), p = allShortestPaths((a)-[:KNOWS*]-(b)) RETURN relationships(p) AS r")) == 2
    assert rows(g, "MATCH (a:Person {id: 1}), (b:Person {id: 5}), p = shortestPath((a)-[:KNOWS*]-(b)) RETURN p") == []
    assert rows(g, "MATCH (a:Person {id: 1}), (b:Person {id: 5}) OPTIONAL MATCH p = shortestPath((a)-[:KNOWS*]-(b)) RETURN CASE p IS NULL WHEN true THEN -1 ELSE length(p) END AS l") == [(-1,)]


def brute_trails(start):
    edges = {1: (1, 2), 2: (2, 3), 3: (3, 1), 4: (3, 3), 5: (3, 4), 6: (3, 4)}

    def count(at, used):
        return sum(1 + count(b, used | {e}) for e, (a, b) in edges.items() if a == at and e not in used)

    return count(start, frozenset())


def test_nulls(g):
    assert rows(g, "MATCH (a:Person) WHERE a.age > 0 RETURN count(a) AS n, count(a.age) AS k, size(collect(a.age)) AS c") == [(4, 4, 4)]
    assert rows(g, "MATCH (a:Person) RETURN size(collect(a.age)) AS c, size(list(a.age)) AS l") == [(4, 5)]
    assert [r[0] for r in g.sql("MATCH (a:Person) RETURN a.age AS x ORDER BY x").fetchall()] == [25, 30, 41, 60, None]
    assert [r[0] for r in g.sql("MATCH (a:Person) RETURN a.age AS x ORDER BY x DESC").fetchall()] == [None, 60, 41, 30, 25]
    assert rows(g, "UNWIND [] AS x RETURN x") == []
    assert rows(g, "RETURN 1 / 0 AS x, toInteger('12') AS i, toInteger('a') AS j, concat('a', null) AS c, 'a' || null AS d") == [(None, 12, None, "a", None)]
    assert rows(g, "RETURN null IS NULL AS b") == [(True,)]


def test_grouping_by_identity(spark):
    g = Graph(spark)
    g.catalog.add_vertices("T", spark.createDataFrame([(1, "x"), (2, "x")], "id long, name string"), "id")
    assert rows(g, "MATCH (t:T) WITH t, count(*) AS n RETURN t.name AS x, n") == [("x", 1), ("x", 1)]
    assert len(rows(g, "MATCH (t:T) WITH DISTINCT t RETURN t.name AS x")) == 2
    assert len(rows(g, "MATCH (t:T) RETURN DISTINCT t.name AS x")) == 1


def test_with_then_match_keeps_all_rows(spark):
    g = Graph(spark)
    g.catalog.add_vertices("P", spark.createDataFrame([(k,) for k in range(1, 3)], "id long"), "id")
    g.catalog.add_vertices("V", spark.createDataFrame([(k,) for k in range(8)], "id long"), "id")
    g.catalog.add_edges("HAS", "P", "V", spark.createDataFrame([(p * 10 + v, p, v) for p in (1, 2) for v in range(8)], "_eid long, _sid long, _tid long"))
    assert rows(g, "MATCH (p:P)-[:HAS]->(v:V) WITH p, count(v) AS n WHERE n > 3 MATCH (p)-[:HAS]->(v:V) RETURN p.id AS p, v.id AS v, n")[0] == (1, 0, 8)
    assert len(rows(g, "MATCH (p:P)-[:HAS]->(v:V) WITH p, count(v) AS n WHERE n > 3 MATCH (p)-[:HAS]->(v:V) RETURN p.id AS p, v.id AS v")) == 16


def test_entity_functions(g):
    assert rows(g, "MATCH (a:Person {id: 2}) RETURN keys(a) AS k, properties(a) AS p, id(a) AS i")[0][0] == ["id", "name"]
    assert rows(g, "MATCH (a)-[r:KNOWS {year: 2014}]->(b) RETURN type(r) AS t, startNode(r).id AS s, endNode(r).id AS e, r.year AS y") == [("KNOWS", 3, 4, 2014)]


def test_functions(g):
    one = lambda text: rows(g, f"RETURN {text} AS x")[0][0]
    assert one("date_diff('month', date('2020-01-31'), date('2020-02-01'))") == 1
    assert one("date_sub('month', date('2020-01-31'), date('2020-02-01'))") == 0
    assert one("date_diff('week', date('1970-01-01'), date('1970-01-15'))") == 2
    assert one("datetime({epochMillis: 1000})") == datetime.datetime(1970, 1, 1, 0, 0, 1)
    assert one("regexp_replace('abab', 'a', 'x')") == "xbab" and one("regexp_replace('abab', 'a', 'x', 'g')") == "xbxb"
    assert one("printf('%d-%s', 3, 'a')") == "3-a" and one("format('{}+{}', 1, 'b')") == "1+b"
    assert one("glob('abc', 'a*')") is True and one("'abc' LIKE 'a%'") is True
    assert one("[1, 2, 3][-1]") == 3 and one("[1, 2, 3][5]") is None and one("[1, 2, 3][1..]") == [2, 3]
    assert one("range(3)") == [0, 1, 2, 3] and one("range(5, 1)") == []
    assert one("5 / 2") == 2 and one("-5 / 2") == -2 and one("5.0 / 2") == 2.5 and one("2 ^ 3") == 8.0 and one("3!") == 6
    assert one("reduce(a = '', x IN ['p', 'q'] | a + x)") == "pq"
    assert one("cast('12' AS INTEGER)") == 12 and one("coalesce(null, 2)") == 2 and one("single(x IN [1, 2] WHERE x = 2)") is True
    assert one("nfc_normalize('e' + '\\u0301')") == "é" and one("strptime('2020/03/04', '%Y/%m/%d')") == datetime.datetime(2020, 3, 4)


def test_changes(g):
    g.execute("CREATE (a:Person {id: 6, name: 'Finn', age: 9})-[:KNOWS {year: 2020}]->(b:Person {id: 7, name: 'Gus'})")
    assert rows(g, "MATCH (a {name: 'Finn'})-[r:KNOWS]->(b) RETURN b.name AS b, r.year AS y") == [("Gus", 2020)]
    g.execute("MATCH (a:Person) WHERE a.age > 40 SET a.age = a.age + 1, a.old = true")
    assert rows(g, "MATCH (a:Person) WHERE a.old RETURN a.name AS n, a.age AS x") == [("Carol", 42), ("Eve", 61)]
    g.execute("MATCH (a:Person {name: 'Eve'}) REMOVE a.age")
    assert rows(g, "MATCH (a:Person {name: 'Eve'}) RETURN a.age AS x") == [(None,)]
    g.execute("MERGE (a:Person {name: 'Eve'}) ON MATCH SET a.age = 1")
    g.execute("MERGE (a:Person {name: 'Hal'}) ON CREATE SET a.age = 2")
    assert rows(g, "MATCH (a:Person) WHERE a.age < 3 RETURN a.name AS n, a.age AS x") == [("Eve", 1), ("Hal", 2)]
    g.execute("MATCH (a:Person {name: 'Carol'}) DETACH DELETE a")
    assert rows(g, "MATCH (a:Person)-[:KNOWS]->(b) RETURN a.name AS a, b.name AS b") == [("Alice", "Bob"), ("Finn", "Gus")]
    g.execute("MATCH (:Person {name: 'Alice'})-[r:KNOWS]->() DELETE r")
    assert rows(g, "MATCH (:Person)-[r:KNOWS]->() RETURN count(r) AS n") == [(1,)]
    g.execute("FOREACH (x IN ['u', 'v'] | CREATE (:Tag {name: x}))")
    assert rows(g, "MATCH (t:Tag) RETURN t.name AS t") == [("u",), ("v",)]
    with pytest.raises(CypherError):
        g.sql("MATCH (a:Person) RETURN b.x")


def test_files(spark, tmp_path):
    (tmp_path / "v.csv").write_text(":ID(P)|name:STRING|born:DATE_EPOCHMS|d:DECIMAL(6,2)\n1|a|1000|1.50\n2||5|\n3|c||2.25\n")
    (tmp_path / "e.csv").write_text(":START_ID(P)|:END_ID(P)|w:INT\n1|2|5\n999|3|6\n2|3|\n")
    (tmp_path / "v.json").write_text('{"vertices": [{"id": 9, "x": 1.5,}, {"id": 10, "x": Inf}]}')
    g = Graph(spark)
    files.import_vertices(g, "P:Being", str(tmp_path / "v.csv"))
    assert files.import_edges(g, "E", str(tmp_path / "e.csv")) == 1
    files.import_edges(g, "E", str(tmp_path / "e.csv"))
    assert rows(g, "MATCH (a)-[r:E]->(b) RETURN count(r) AS n") == [(4,)]
    assert rows(g, "MATCH (a:P) WHERE a.name IS NULL RETURN a.born AS b, a.d AS d") == [(5, None)]
    files.import_vertices(g, "J", str(tmp_path / "v.json"), "json")
    assert rows(g, "MATCH (j:J) RETURN id(j) AS i, j.x AS x") == [(10, float("inf")), (9, 1.5)]
    workspace.save(g, str(tmp_path / "w"))
    again = workspace.load(spark, str(tmp_path / "w"))
    assert rows(again, "MATCH (a:Being)-[:E]->(b) RETURN a.name AS a") == rows(g, "MATCH (a:Being)-[:E]->(b) RETURN a.name AS a")
    assert again.labels() == ["J", "P"] and again.relationship_types() == ["E"]


def test_fluent(g):
    r = g.sql("MATCH (a:Person) RETURN a.name AS name, a.age AS age")
    assert r.filter("age > 26").order("age DESC").limit(2).fetchall() == [("Eve", 60), ("Carol", 41)]
    assert r.count().fetchall() == [(5,)] and r.columns == ["name", "age"] and r.shape == (5, 2)
    assert r.aggregate("sum(age) AS s").fetchall() == [(156,)]
    assert g.sql("MATCH (a:Person)-[r:KNOWS]->(b) RETURN a.id AS i").aggregate("count(r) AS n, min(r.year) AS y").fetchall() == [(6, 2010)]
    assert len(r.union(r).fetchall()) == 10 and len(r.union_distinct(r).fetchall()) == 5
    assert sorted(g.node("Person").degree("KNOWS").fetchall()) == [(1, 1), (2, 1), (3, 4)]
    assert g.node("Person").where(name="Bob").count() == 1 and g.node("Person").where("n.age > 40").count() == 2
    assert g.node("Person").where(id=1).neighbors("KNOWS").df.select("m.name").collect()[0][0] == "Bob"
    assert g.path({"id": 1}, {"id": 4}, "Person", "KNOWS").shortest_path().fetchall()[0][2] == 2
    assert g.prepare("MATCH (a:Person {id: $i}) RETURN a.name AS n").execute({"i": 2}).fetchall() == [("Bob",)]
    assert r.execute().fetchone() is not None and len(r.fetchmany(2)) == 2
    cur = g.cursor().execute("MATCH (a:Person) RETURN a.id AS i")
    assert cur.description == [("i", "bigint")] and len(cur.fetchall()) == 5
    for form in FORMS:
        assert isinstance(render(r.df, form), str)
    assert "Scan" in g.explain("MATCH (a:Person) RETURN a.name AS n") and g.schema()["vertices"]["Pet"] == {"id": "bigint", "name": "string"}
    assert r.window("row_number()", [], ["age"], "n").df.where("n = 1").count() == 1


def test_path_weight(spark):
    hop = spark.createDataFrame([(1, 10), (2, 20)], "` from` long, ` to` long")
    back = spark.createDataFrame([(10, 2), (20, 3), (20, 3)], "` from` long, ` to` long")
    paths = spark.createDataFrame([([1, 2, 3],), ([3, 2],), ([5],)], "nodes array<long>")
    got = {tuple(r["nodes"]): r["weight"] for r in path_weight(paths, pair_weights([hop, back], 0.5)).collect()}
    assert got == {(1, 2, 3): 1.5, (3, 2): 1.0, (5,): 0.0}


@pytest.mark.parametrize("text", ["", "MATCH", "MATCH (a RETURN a", "RETURN 'a", "MATCH (a) RETURN a b"])
def test_bad_queries(text):
    with pytest.raises(CypherError):
        parse(text)


def test_aggregates_of_returned_values_and_distinct(g):
    assert rows(g, "MATCH (p:Person) WHERE p.id < 3 RETURN p.id AS i, sum(p.id) AS s, count(*) AS n") == [(1, 1, 1), (2, 2, 1)]
    got = rows(g, "UNWIND [1, 1, 2, null] AS x RETURN product(DISTINCT x) AS p, string_agg(DISTINCT x, ';') AS t, stddev_pop(DISTINCT x) AS d, avg(DISTINCT x) AS a, size(list(DISTINCT x)) AS n, max(DISTINCT x) AS m")
    assert len(got) == 1 and (got[0][0], got[0][2:]) == (2.0, (0.5, 1.5, 3, 2)) and sorted(got[0][1].split(";")) == ["1", "2"]
    assert rows(g, "UNWIND [[1, 5], [1, 5], [2, 6]] AS x RETURN x[0] % 2 AS k, product(DISTINCT x[1]) AS p") == [(0, 6.0), (1, 5.0)]


def test_inline_properties_of_outer_variables(g):
    assert rows(g, "UNWIND [1, 2] AS k MATCH (p:Person {id: k}) RETURN k, p.name AS n") == [(1, "Alice"), (2, "Bob")]
    assert rows(g, "MATCH (a:Person {id: 3}) MATCH (b:Person {id: a.id + 1}) RETURN b.name AS n") == [("Dan",)]
    assert rows(g, "UNWIND [1, 9] AS k OPTIONAL MATCH (p:Person {id: k}) RETURN k, p.name AS n") == [(1, "Alice"), (9, None)]


def test_relationships_are_distinct_from_those_of_paths(g, spark):
    h = Graph(spark)
    h.catalog.add_vertices("P", spark.createDataFrame([(1,), (2,), (3,)], "id long"), "id")
    h.catalog.add_edges("K", "P", "P", spark.createDataFrame([(1, 1, 2), (2, 2, 3)], "_eid long, _sid long, _tid long"))
    h.catalog.add_edges("L", "P", "P", spark.createDataFrame([(1, 1, 3)], "_eid long, _sid long, _tid long"))
    assert len(rows(h, "MATCH (a)-[r:K]->(b), (c)-[q:K*1..1]->(d) RETURN a.id AS a, c.id AS c")) == 2
    assert len(rows(h, "MATCH (a)-[:K*1..2]->(b), (c)-[:K*1..2]->(d) RETURN a.id AS a, b.id AS b, c.id AS c, d.id AS d")) == 2
    assert len(rows(h, "MATCH (a)-[:K|L*1..1]->(b), (c)-[:K]->(d) RETURN a.id AS a, b.id AS b, c.id AS c")) == 4
    assert len(rows(h, "MATCH (a)-[:L]->(b), (c)-[:K*1..1]->(d) RETURN a.id AS a, c.id AS c")) == 2


def test_merge_by_row(g):
    g.execute("UNWIND [1, 50, 60, 50] AS k MERGE (p:Person {id: k}) ON CREATE SET p.name = 'new' ON MATCH SET p.name = 'old'")
    assert rows(g, "MATCH (p:Person) WHERE p.id IN [1, 50, 60] RETURN p.id AS i, p.name AS n") == [(1, "old"), (50, "new"), (60, "new")]
    g.execute("MERGE (p:Person {id: 60})")
    g.execute("MERGE (c:City {name: 'Rome'})")
    assert rows(g, "MATCH (p:Person) RETURN count(*) AS n") == [(7,)] and rows(g, "MATCH (c:City) RETURN c.name AS n") == [("Rome",)]


def test_casts_and_matches_at_a_line_end(g):
    assert rows(g, "RETURN toInteger('9007199254740993') AS a, toInteger('2.9') AS b, 'ab\\n' =~ 'ab' AS c, 'ab' =~ 'a.' AS d") == [(9007199254740993, 2, False, True)]
    assert rows(g, "RETURN list_aggregate([3, 1, null], 'sum') AS s, list_aggregate([3, 1], 'min') AS m, struct_extract({a: 7}, 'a') AS x") == [(4.0, 1, 7)]


def test_a_seed_repeats_random(g):
    once = [g.sql("RETURN setseed(0.25) AS s").df.collect(), rows(g, "UNWIND [1, 2] AS i RETURN random() AS r")]
    g.sql("RETURN setseed(0.25) AS s").df.collect()
    from lodegraph.functions import registry

    assert rows(g, "UNWIND [1, 2] AS i RETURN random() AS r") == once[1]
    registry._SEED.clear()


def test_a_workspace_is_saved_over_itself(g, spark, tmp_path):
    path = f"{tmp_path}/own"
    workspace.save(g, path)
    h = workspace.load(spark, path)
    h.execute("MATCH (p:Person) WHERE p.id = 1 SET p.name = 'Ann'")
    h.checkpoint(path)
    assert rows(workspace.load(spark, path), "MATCH (p:Person) WHERE p.id = 1 RETURN p.name AS n") == [("Ann",)]


def test_json_strings_stay(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"vertices": [{"id": 1, "name": "a, Inf ,} x\\"", "w": -Inf,}, {"id": 2, "name": "Inf", "w": 2.5},]}')
    h = Graph(spark)
    files.import_vertices(h, "V", f"{tmp_path}/v.json", "json")
    assert rows(h, "MATCH (v:V) RETURN v.name AS n, v.w AS w") == sorted([('a, Inf ,} x"', float("-inf")), ("Inf", 2.5)], key=repr)


def test_conditions_on_the_ends_come_before_shortest_paths(g):
    q = "MATCH p = shortestPath((a:Person)-[:KNOWS*]->(b:Person)) WHERE a.id = 1 AND b.id = 4 AND length(p) > 1 RETURN length(p) AS n"
    assert rows(g, q) == [(3,)]


def test_collect_keeps_the_order_of_with(g):
    q = "UNWIND [[1, 3], [1, 1], [2, 9], [1, null], [1, 2]] AS x WITH x ORDER BY x[1] DESC RETURN x[0] AS k, collect(x[1]) AS c, head(collect(x[1])) AS h, list(x[1]) AS l"
    assert rows(g, q) == [(1, [3, 2, 1], 3, [None, 3, 2, 1]), (2, [9], 9, [9])]


def test_aggregates_hold_no_group_in_memory(g):
    lines = "UNWIND range(1, 60) AS x WITH x, CASE WHEN x % 4 = 0 THEN null ELSE x % 4 END AS v, CASE WHEN x > 40 THEN null ELSE 'k' END AS k "
    df = g.sql(lines + "RETURN k, size(list(v)) AS l, size(collect(v)) AS c, size(array_agg(DISTINCT v)) AS d, histogram(v) AS h, product(DISTINCT v) AS p, count(*) AS n").df
    got = {r["k"]: (r["l"], r["c"], r["d"], r["h"], r["p"], r["n"]) for r in df.collect()}
    assert got == {"k": (40, 30, 4, {"1": 10, "2": 10, "3": 10}, 6.0, 40), None: (20, 15, 4, {"1": 5, "2": 5, "3": 5}, 6.0, 20)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("collect_list") == 1  # of the counted values
    assert rows(g, "UNWIND [3, 1, 3, null, 2, 1] AS x RETURN list(DISTINCT x) AS l, size(list(DISTINCT x)) AS n") == [([3, 1, None, 2], 4)]
    assert rows(g, "UNWIND [1] AS x WITH x WHERE x > 1 RETURN size(list(x)) AS l, histogram(x) AS h, size(list(DISTINCT x)) AS d") == [(0, {}, 0)]


def test_aggregates_of_values_see_the_same_rows(g):
    for text in ("WITH x, random() AS r RETURN r < 0.5 AS k", "WITH x ORDER BY random() LIMIT 50 RETURN x % 3 AS k", "WITH x, null AS y LIMIT 50 RETURN random() < 0.5 AS k, count(y) AS c"):
        got = g.sql(f"UNWIND range(1, 200) AS x {text}, count(*) AS n, max(x) AS m, size(list(DISTINCT x)) AS d, histogram(x) AS h").df.collect()
        assert got and all(r["n"] == r["d"] == len(r["h"]) and max(map(int, r["h"])) == r["m"] for r in got)


def test_fsum_keeps_small_values_beside_large_ones(g):
    assert rows(g, "UNWIND [10000000000000000.0, 1.0, -10000000000000000.0, null] AS x RETURN fsum(x) AS s, kahan_sum(x) AS k, round(favg(x), 6) AS a") == [(1.0, 1.0, 0.333333)]
    assert rows(g, "UNWIND range(1, 100000) AS x WITH 0.1 AS x RETURN fsum(x) AS s") == [(10000.0,)]
    assert rows(g, "UNWIND [1.0e300, 0.5, -1.0e300] AS x RETURN fsum(x) IS NOT NULL AS s, favg(null) AS a") == [(True, None)]
