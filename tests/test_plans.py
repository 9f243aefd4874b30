"""Plans that the planner should give: one scan for a star, filters at the scan, hash joins, no Python."""

from triplane.plans.planner import run
from triplane.queries import PREFIX
from triplane.sources.mapped import relational_graph

SF = "/root/testdata/sf0.001"


def plan(spark, text):
    return run(relational_graph(spark, SF), PREFIX + text)._jdf.queryExecution().executedPlan().toString()


def test_star_is_one_scan(spark):
    got = plan(spark, "SELECT ?n ?b { ?c t:c_name ?n ; t:c_acctbal ?b ; t:c_mktsegment \"BUILDING\" }")
    assert got.count("FileScan") == 1 and "Join" not in got and "EqualTo(c_mktsegment,BUILDING)" in got


def test_number_comparison_reaches_scan(spark):
    got = plan(spark, "SELECT ?k { ?o t:o_orderkey ?k ; t:o_totalprice ?p FILTER(?p > 100) }")
    assert "GreaterThan(o_totalprice,100.0)" in got


def test_anti_join(spark):
    got = plan(spark, "SELECT ?n { ?c t:c_name ?n OPTIONAL { ?o t:o_cust ?c ; t:o_totalprice ?p FILTER(?p > 480000) } FILTER(!BOUND(?p)) }")
    assert "LeftAnti" in got


def test_doubtful_key_is_no_nested_loop(spark):
    got = plan(spark, """SELECT ?name { ?n t:n_name ?name OPTIONAL { ?c t:c_nation ?n ; t:c_mktsegment ?seg ; t:c_acctbal ?bal FILTER(?bal > 9900) }
        ?d t:c_mktsegment ?seg ; t:c_acctbal ?least FILTER(?least < -950) }""")
    assert "HashJoin" in got or "SortMergeJoin" in got


def test_top_k_and_no_python(spark):
    got = plan(spark, "SELECT ?k { ?o t:o_orderkey ?k ; t:o_totalprice ?p FILTER(REGEX(STR(?k), \"1\")) } ORDER BY ?p LIMIT 5")
    assert "TakeOrderedAndProject" in got and "Python" not in got and "Arrow" not in got


def test_equal_doubles_hash(spark):
    got = plan(spark, "SELECT ?a ?b { ?x t:c_name ?a ; t:c_acctbal ?k . ?y t:s_name ?b ; t:s_acctbal ?m FILTER(?k = ?m) }")
    assert ("HashJoin" in got or "SortMergeJoin" in got) and "NestedLoop" not in got and "Cartesian" not in got


def test_any_predicate_scans_a_table_once(spark):
    got = plan(spark, "SELECT ?p ?o { ?s ?p ?o }")
    assert got.count("FileScan") == 9


def test_filter_on_rows_without_a_key_reaches_the_scan(spark):
    got = plan(spark, "SELECT ?l ?q { ?l t:l_quantity ?q ; t:l_tax ?t FILTER(?t > 0.07e0) }")
    assert "GreaterThan(l_tax,0.07)" in got


def test_kinds_prune_tables(spark):
    got = plan(spark, "SELECT ?p ?o { ?n t:n_name \"NATION_5\" ; ?p ?o }")
    assert got.count("FileScan") == 2  # a nation's other predicates are in its own table


def test_cells_of_rows_without_a_key_need_no_join(spark):
    got = plan(spark, "SELECT ?q ?p ?o { ?l t:l_quantity ?q ; ?p ?o ; t:l_tax ?t }")
    assert got.count("FileScan") == 1 and "Join" not in got
    rows = run(relational_graph(spark, SF), PREFIX + "SELECT ?q ?p ?q { ?l t:l_quantity ?q ; ?p ?q }")
    table = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert rows.count() == table.count() and {r["p"] for r in rows.collect()} == {"urn:t:l_quantity"}


def test_few_keys_of_many_rows_are_spread(spark, monkeypatch):
    from triplane.operators import joins
    from triplane.queries import QUERIES

    monkeypatch.setattr(joins, "PIECE", 2)
    for name, where in (("bgp_shared_var", "c_mktsegment = 'BUILDING'"), ("sameterm", "c_acctbal > 9000")):
        df = QUERIES[name](spark, SF)
        spark.read.parquet(f"{SF}/supplier.parquet").createOrReplaceTempView("s_")
        spark.read.parquet(f"{SF}/customer.parquet").createOrReplaceTempView("c_")
        wanted = spark.sql(f"SELECT s_name, c_name FROM s_ JOIN c_ ON s_nationkey = c_nationkey WHERE {where}")
        assert df.count() and sorted(map(tuple, df.collect())) == sorted(map(tuple, wanted.collect()))
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
