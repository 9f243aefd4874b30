"""Registered queries of the engine, one or more for each operator, with the same in SQL.

``SPARQL`` holds (query text, SQL) by name; ``QUERIES`` holds callables of (spark, folder) that also cover loading, the
dictionary-encoded store, statistics and output.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.functions.terms import BLANK, IRI, XSD, Ex, as_statement, lexical
from triplane.plans.planner import run
from triplane.results import text_lines, xml_results
from triplane.sources import ntriples
from triplane.sources.encoded import EncodedStore, build
from triplane.sources.files import documents, read_statements
from triplane.sources.mapped import MappedTables, Table, relational_graph
from triplane.sources.shared import delete, shared_path

PREFIX = "PREFIX t: <urn:t:> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"
_DATE = '"1998-06-01T00:00:00"^^xsd:dateTime'
_CUSTOMER_ORDERS = "customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 480000) o ON o_custkey = c_custkey"

SPARQL: dict[str, tuple[str, str]] = {
    "flagship": (
        """SELECT ?order ?cust ?total WHERE { ?o t:o_orderkey ?order ; t:o_totalprice ?total ; t:o_cust ?c .
           ?c t:c_name ?cust ; t:c_nation ?n . ?n t:n_name "NATION_3" FILTER(?total > 200000) } ORDER BY DESC(?total) ?order LIMIT 10""",
        """SELECT o_orderkey AS "order", c_name AS cust, o_totalprice AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
           WHERE n_name = 'NATION_3' AND o_totalprice > 200000 ORDER BY total DESC, "order" LIMIT 10""",
    ),
    # basic graph patterns
    "bgp_star": (
        "SELECT ?c ?name ?bal ?seg WHERE { ?c t:c_name ?name ; t:c_acctbal ?bal ; t:c_mktsegment ?seg }",
        "SELECT 'urn:t:customer/' || c_custkey AS c, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer",
    ),
    "bgp_path": (
        "SELECT ?order ?region WHERE { ?o t:o_orderkey ?order ; t:o_cust ?c . ?c t:c_nation ?n . ?n t:n_region ?r . ?r t:r_name ?region }",
        """SELECT o_orderkey AS "order", r_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "bgp_shared_var": (
        'SELECT ?sn ?cn WHERE { ?s t:s_nation ?n ; t:s_name ?sn . ?c t:c_nation ?n ; t:c_name ?cn ; t:c_mktsegment "BUILDING" }',
        "SELECT s_name AS sn, c_name AS cn FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'",
    ),
    "bgp_repeat_var": (
        "SELECT ?o ?k WHERE { ?o t:o_orderkey ?k ; t:o_custkey ?k }",
        "SELECT 'urn:t:order/' || o_orderkey AS o, o_orderkey AS k FROM orders WHERE o_orderkey = o_custkey",
    ),
    "bgp_cross": (
        "SELECT ?a ?b WHERE { ?x t:r_name ?a . ?y t:r_name ?b }",
        "SELECT x.r_name AS a, y.r_name AS b FROM region x, region y",
    ),
    "bgp_blank_subject": (
        "SELECT ?qty ?part ?supp WHERE { _:l t:l_quantity ?qty ; t:l_part ?p ; t:l_supp ?s . ?p t:p_name ?part ; t:p_size 7 . ?s t:s_name ?supp }",
        "SELECT l_quantity AS qty, p_name AS part, s_name AS supp FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size = 7",
    ),
    "bgp_constant_subject": (
        "SELECT ?p ?o WHERE { <urn:t:customer/7> ?p ?o }",
        """SELECT 'urn:t:' || p AS p, o FROM (SELECT unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment', 'c_nation']) AS p,
           unnest([c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_acctbal::VARCHAR, c_mktsegment, 'urn:t:nation/' || c_nationkey]) AS o FROM customer WHERE c_custkey = 7)""",
    ),
    "bgp_variable_predicate": (
        "SELECT ?p ?o WHERE { ?r t:n_name \"NATION_5\" ; ?p ?o }",
        """SELECT 'urn:t:' || p AS p, o FROM (SELECT unnest(['n_nationkey', 'n_name', 'n_regionkey', 'n_region']) AS p,
           unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR, 'urn:t:region/' || n_regionkey]) AS o FROM nation WHERE n_name = 'NATION_5')""",
    ),
    "bgp_all_variables": (
        "SELECT ?s ?p ?o WHERE { ?s ?p ?o . ?s t:r_name ?name }",
        """SELECT 'urn:t:region/' || r_regionkey AS s, 'urn:t:' || p AS p, o FROM (SELECT r_regionkey, unnest(['r_regionkey', 'r_name']) AS p, unnest([r_regionkey::VARCHAR, r_name]) AS o FROM region)""",
    ),
    "bgp_blank_self_join": (
        "SELECT ?qty ?p ?o WHERE { ?l t:l_quantity ?qty ; t:l_tax 0.08e0 ; t:l_discount 0.1e0 . ?l ?p ?o FILTER(isIRI(?o)) }",
        """SELECT l_quantity AS qty, 'urn:t:' || p AS p, o FROM (SELECT l_quantity, unnest(['l_order', 'l_part', 'l_supp']) AS p,
           unnest(['urn:t:order/' || l_orderkey, 'urn:t:part/' || l_partkey, 'urn:t:supplier/' || l_suppkey]) AS o FROM lineitem WHERE l_tax = 0.08 AND l_discount = 0.1)""",
    ),
    "false_pattern": (
        'SELECT ?c ?x WHERE { ?c t:c_name ?n ; t:no_such_predicate ?x }',
        "SELECT c_name AS c, c_name AS x FROM customer WHERE false",
    ),
    "empty_group": ("SELECT ?r WHERE { {} ?x t:r_name ?r }", "SELECT r_name AS r FROM region"),
    "group_nesting": (
        "SELECT ?name ?region WHERE { { ?n t:n_name ?name } { ?n t:n_region ?r . { ?r t:r_name ?region } } }",
        "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    # unions
    "union_missing": (
        'SELECT ?name ?bal ?size WHERE { { ?c t:c_name ?name ; t:c_acctbal ?bal } UNION { ?p t:p_name ?name ; t:p_size ?size } }',
        "SELECT c_name AS name, c_acctbal AS bal, NULL::INTEGER AS size FROM customer UNION ALL SELECT p_name, NULL, p_size FROM part",
    ),
    "union_all_dups": (
        "SELECT ?name WHERE { { ?c t:c_name ?name } UNION { ?c t:c_name ?name } UNION { ?s t:s_name ?name } }",
        "SELECT c_name AS name FROM customer UNION ALL SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier",
    ),
    "union_false_branch": (
        "SELECT ?name WHERE { { ?c t:c_name ?name } UNION { ?c t:absent ?name } }",
        "SELECT c_name AS name FROM customer",
    ),
    # optional parts
    "optional_basic": (
        "SELECT ?name ?total WHERE { ?c t:c_name ?name OPTIONAL { ?o t:o_cust ?c ; t:o_totalprice ?total FILTER(?total > 480000) } }",
        f"SELECT c_name AS name, o_totalprice AS total FROM {_CUSTOMER_ORDERS}",
    ),
    "optional_filter_scope": (
        "SELECT ?name ?total WHERE { ?c t:c_name ?name ; t:c_acctbal ?bal OPTIONAL { ?o t:o_cust ?c ; t:o_totalprice ?total FILTER(?total > ?bal * 100) } }",
        "SELECT c_name AS name, o_totalprice AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 100",
    ),
    "optional_nested": (
        """SELECT ?name ?total ?day WHERE { ?c t:c_name ?name OPTIONAL { ?o t:o_cust ?c ; t:o_totalprice ?total FILTER(?total > 480000)
           OPTIONAL { ?o t:o_orderpriority "1-URGENT" ; t:o_orderdate ?day } } }""",
        f"SELECT c_name AS name, o_totalprice AS total, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END AS day FROM {_CUSTOMER_ORDERS}",
    ),
    "optional_alone": (
        "SELECT ?r WHERE { OPTIONAL { ?x t:r_name ?r } }",
        "SELECT r_name AS r FROM region",
    ),
    "anti_notbound": (
        "SELECT ?name WHERE { ?c t:c_name ?name OPTIONAL { ?o t:o_cust ?c ; t:o_totalprice ?total FILTER(?total > 480000) } FILTER(!BOUND(?o)) }",
        "SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)",
    ),
    "anti_and_filter": (
        "SELECT ?name WHERE { ?c t:c_name ?name ; t:c_acctbal ?bal OPTIONAL { ?o t:o_cust ?c ; t:o_totalprice ?total FILTER(?total > 480000) } FILTER(!BOUND(?total) && ?bal > 5000) }",
        "SELECT c_name AS name FROM customer WHERE c_acctbal > 5000 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)",
    ),
    "compat_join": (
        """SELECT ?name ?seg ?other WHERE { ?n t:n_name ?name OPTIONAL { ?c t:c_nation ?n ; t:c_mktsegment ?seg ; t:c_acctbal ?bal FILTER(?bal > 9900) }
           ?d t:c_mktsegment ?seg ; t:c_name ?other ; t:c_acctbal ?least FILTER(?least < -950) }""",
        """WITH a AS (SELECT n_name AS name, c_mktsegment AS seg FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9900) c ON c_nationkey = n_nationkey)
           SELECT a.name, d.c_mktsegment AS seg, d.c_name AS other FROM a JOIN customer d ON (a.seg IS NULL OR a.seg = d.c_mktsegment) WHERE d.c_acctbal < -950""",
    ),
    "compat_left_join": (
        """SELECT ?name ?seg ?other WHERE { ?n t:n_name ?name OPTIONAL { ?c t:c_nation ?n ; t:c_mktsegment ?seg ; t:c_acctbal ?bal FILTER(?bal > 9900) }
           OPTIONAL { ?d t:c_mktsegment ?seg ; t:c_name ?other ; t:c_acctbal ?least FILTER(?least < -990) } }""",
        """WITH a AS (SELECT n_name AS name, c_mktsegment AS seg FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9900) c ON c_nationkey = n_nationkey)
           SELECT a.name, coalesce(a.seg, d.c_mktsegment) AS seg, d.c_name AS other FROM a LEFT JOIN (SELECT * FROM customer WHERE c_acctbal < -990) d ON (a.seg IS NULL OR a.seg = d.c_mktsegment)""",
    ),
    # comparisons
    "filter_lt": ("SELECT ?k WHERE { ?o t:o_orderkey ?k ; t:o_totalprice ?p FILTER(?p < 50000) }", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice < 50000"),
    "filter_gt": (f"SELECT ?k WHERE {{ ?o t:o_orderkey ?k ; t:o_orderdate ?d FILTER(?d > {_DATE}) }}", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate > TIMESTAMP '1998-06-01'"),
    "filter_le": ('SELECT ?k WHERE { ?o t:o_orderkey ?k ; t:o_orderpriority ?p FILTER(?p <= "2-HIGH") }', "SELECT o_orderkey AS k FROM orders WHERE o_orderpriority <= '2-HIGH'"),
    "filter_ge": ("SELECT ?k ?s WHERE { ?p t:p_partkey ?k ; t:p_size ?s FILTER(?s >= 49.5) }", "SELECT p_partkey AS k, p_size AS s FROM part WHERE p_size >= 49.5"),
    "filter_eq": ("SELECT ?k WHERE { ?p t:p_partkey ?k ; t:p_size ?s FILTER(?s = 7.0) }", "SELECT p_partkey AS k FROM part WHERE p_size = 7"),
    "filter_ne": (f"SELECT ?k WHERE {{ ?o t:o_orderkey ?k ; t:o_orderdate ?d FILTER(?d != {_DATE}) }}", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate <> TIMESTAMP '1998-06-01'"),
    "filter_type_error": ('SELECT ?k WHERE { ?p t:p_partkey ?k ; t:p_size ?s FILTER(?s = "7" || ?s < "x") }', "SELECT p_partkey AS k FROM part WHERE false"),
    "filter_and_or_not_err": (
        """SELECT ?name ?total WHERE { ?c t:c_name ?name ; t:c_acctbal ?bal OPTIONAL { ?o t:o_cust ?c ; t:o_totalprice ?total FILTER(?total > 480000) }
           FILTER(?total > 490000 || ?bal > 9000 || !(?total > 485000 && ?bal > 0)) }""",
        f"SELECT c_name AS name, o_totalprice AS total FROM {_CUSTOMER_ORDERS} WHERE o_totalprice > 490000 OR c_acctbal > 9000 OR NOT (o_totalprice > 485000 AND c_acctbal > 0)",
    ),
    "filter_ebv": (
        "SELECT ?k WHERE { ?r t:r_regionkey ?k ; t:r_name ?n FILTER(?k && ?n) }",
        "SELECT r_regionkey AS k FROM region WHERE r_regionkey <> 0 AND r_name <> ''",
    ),
    "theta_join": (
        "SELECT ?a ?b WHERE { ?x t:n_nationkey ?a ; t:n_region ?r . ?y t:n_nationkey ?b ; t:n_region ?r FILTER(?a < ?b) }",
        "SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey",
    ),
    "value_eq_join": (
        "SELECT ?part ?qty WHERE { _:l t:l_quantity ?qty ; t:l_part ?p . ?p t:p_partkey ?part ; t:p_size ?size FILTER(?qty = ?size) }",
        "SELECT p_partkey AS part, l_quantity AS qty FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity = p_size",
    ),
    "value_eq_double": (
        "SELECT ?a ?b WHERE { ?x t:c_name ?a ; t:c_acctbal ?k . ?y t:c_name ?b ; t:c_acctbal ?m FILTER(?k / 2 = ?m / 2) }",
        "SELECT x.c_name AS a, y.c_name AS b FROM customer x JOIN customer y ON x.c_acctbal / 2 = y.c_acctbal / 2",
    ),
    "value_eq_only": (
        'SELECT ?s ?n WHERE { ?x t:s_name ?s ; t:s_nationkey ?k . ?y t:n_name ?n ; t:n_nationkey ?m FILTER(?k = ?m) }',
        "SELECT s_name AS s, n_name AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "sameterm": (
        "SELECT ?s ?c WHERE { ?x t:s_name ?s ; t:s_nation ?n . ?y t:c_name ?c ; t:c_nation ?m ; t:c_acctbal ?b FILTER(sameTerm(?n, ?m) && ?b > 9000) }",
        "SELECT s_name AS s, c_name AS c FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal > 9000",
    ),
    # arithmetic
    "arith_add": ("SELECT ?k WHERE { ?p t:p_partkey ?k ; t:p_size ?s FILTER(?k + ?s > 2000) }", "SELECT p_partkey AS k FROM part WHERE p_partkey + p_size > 2000"),
    "arith_sub": ("SELECT ?k WHERE { ?p t:p_partkey ?k ; t:p_size ?s FILTER(?k - ?s < 0) }", "SELECT p_partkey AS k FROM part WHERE p_partkey - p_size < 0"),
    "arith_mul": ("SELECT ?k WHERE { ?p t:p_partkey ?k ; t:p_size ?s ; t:p_retailprice ?r FILTER(?s * ?r > 45000) }", "SELECT p_partkey AS k FROM part WHERE p_size * p_retailprice > 45000"),
    "arith_div": ("SELECT ?k WHERE { ?p t:p_partkey ?k ; t:p_size ?s FILTER(?k / ?s > 30.5) }", "SELECT p_partkey AS k FROM part WHERE p_partkey * 2 > p_size * 61"),
    "arith_div_zero": ("SELECT ?k WHERE { ?r t:r_regionkey ?k FILTER(10 / ?k >= 5) }", "SELECT r_regionkey AS k FROM region WHERE r_regionkey <> 0 AND 10.0 / r_regionkey >= 5"),
    "arith_neg": ("SELECT ?c WHERE { ?x t:c_custkey ?c ; t:c_acctbal ?b FILTER(-?b > 900 && +?c >= 0) }", "SELECT c_custkey AS c FROM customer WHERE -c_acctbal > 900"),
    # tests and functions on terms
    "bound": (
        "SELECT ?name WHERE { ?c t:c_name ?name OPTIONAL { ?o t:o_cust ?c ; t:o_totalprice ?total FILTER(?total > 480000) } FILTER(BOUND(?total)) }",
        "SELECT c_name AS name FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 480000",
    ),
    "isiri": ("SELECT ?p WHERE { <urn:t:nation/3> ?p ?o FILTER(isIRI(?o) && isURI(?p)) }", "SELECT 'urn:t:n_region' AS p"),
    "isliteral": ("SELECT ?p WHERE { <urn:t:nation/3> ?p ?o FILTER(isLITERAL(?o)) }", "SELECT unnest(['urn:t:n_nationkey', 'urn:t:n_name', 'urn:t:n_regionkey']) AS p"),
    "isblank": ("SELECT ?q WHERE { ?l t:l_quantity ?q ; t:l_tax ?t FILTER(isBLANK(?l) && !isBLANK(?t) && ?t > 0.07) }", "SELECT l_quantity AS q FROM lineitem WHERE l_tax > 0.07"),
    "str_fn": (
        'SELECT ?n WHERE { ?c t:c_name ?n ; t:c_nation ?x ; t:c_custkey ?k FILTER(STR(?x) = "urn:t:nation/3" && STR(?k) < "5") }',
        "SELECT c_name AS n FROM customer WHERE c_nationkey = 3 AND c_custkey::VARCHAR < '5'",
    ),
    "lang_fn": ('SELECT ?k WHERE { ?d t:doc_id ?k ; t:tagged_text ?x FILTER(LANG(?x) = "de" && LANG(?k) = "") }', "SELECT doc_id AS k FROM documents WHERE text IS NOT NULL AND lang = 'de'"),
    "langmatches": ('SELECT ?k WHERE { ?d t:doc_id ?k ; t:tagged_text ?x FILTER(LANGMATCHES(LANG(?x), "FR")) }', "SELECT doc_id AS k FROM documents WHERE text IS NOT NULL AND lower(lang) = 'fr'"),
    "langmatches_any": ('SELECT ?k WHERE { ?d t:doc_id ?k ; t:tagged_text ?x FILTER(LANGMATCHES(LANG(?x), "*")) }', "SELECT doc_id AS k FROM documents WHERE text IS NOT NULL AND lang <> ''"),
    "datatype_fn": (
        "SELECT ?p WHERE { <urn:t:customer/3> ?p ?o FILTER(DATATYPE(?o) = xsd:integer || DATATYPE(?o) = xsd:string) }",
        "SELECT unnest(['urn:t:c_custkey', 'urn:t:c_name', 'urn:t:c_nationkey', 'urn:t:c_mktsegment']) AS p",
    ),
    "regex": ('SELECT ?k ?n WHERE { ?p t:p_partkey ?k ; t:p_name ?n FILTER(REGEX(?n, "^(red|blue) b")) }', "SELECT p_partkey AS k, p_name AS n FROM part WHERE regexp_matches(p_name, '^(red|blue) b')"),
    "regex_flags_i": ('SELECT ?k WHERE { ?p t:p_partkey ?k ; t:p_name ?n FILTER(REGEX(?n, "RED", "i")) }', "SELECT p_partkey AS k FROM part WHERE regexp_matches(p_name, 'RED', 'i')"),
    "regex_flags_s": ('SELECT ?k WHERE { ?d t:doc_id ?k ; t:text ?x FILTER(REGEX(?x, "[.].[A-Z]", "s")) }', "SELECT doc_id AS k FROM documents WHERE regexp_matches(text, '[.].[A-Z]', 's')"),
    "regex_flags_m": ('SELECT ?k WHERE { ?d t:doc_id ?k ; t:text ?x FILTER(REGEX(?x, "^[A-Z][a-z]+", "m")) }', "SELECT doc_id AS k FROM documents WHERE regexp_matches(text, '(?m)^[A-Z][a-z]+')"),
    "regex_flags_x": ('SELECT ?k WHERE { ?p t:p_partkey ?k ; t:p_name ?n FILTER(REGEX(?n, "r e d", "x")) }', "SELECT p_partkey AS k FROM part WHERE regexp_matches(p_name, 'red')"),
    "regex_flags_error": ('SELECT ?k WHERE { ?p t:p_partkey ?k ; t:p_name ?n FILTER(REGEX(?n, "red", "q")) }', "SELECT p_partkey AS k FROM part WHERE false"),
    "regex_bad_pattern": ('SELECT ?k WHERE { ?p t:p_partkey ?k ; t:p_name ?n ; t:p_size ?s FILTER(REGEX(?n, "(") || REGEX(?n, "[a", "i") || ?s = 7) }', "SELECT p_partkey AS k FROM part WHERE p_size = 7"),
    "regex_column_pattern": (
        """SELECT ?a ?b WHERE { ?x t:n_name ?a ; t:n_region ?r . ?y t:r_name ?b . ?z t:o_orderpriority ?p ; t:o_orderkey ?k FILTER(?k < 20 && (REGEX(?p, ?b) || REGEX(?a, "_1$"))) }""",
        "SELECT n_name AS a, r_name AS b FROM nation, region, orders WHERE o_orderkey < 20 AND (regexp_matches(o_orderpriority, r_name) OR regexp_matches(n_name, '_1$'))",
    ),
    # solution modifiers
    "distinct": ("SELECT DISTINCT ?seg ?nation WHERE { ?c t:c_mktsegment ?seg ; t:c_nationkey ?nation }", "SELECT DISTINCT c_mktsegment AS seg, c_nationkey AS nation FROM customer"),
    "reduced": ("SELECT REDUCED ?seg WHERE { ?c t:c_mktsegment ?seg }", "SELECT DISTINCT c_mktsegment AS seg FROM customer"),
    "distinct_nulls": (
        "SELECT DISTINCT ?seg ?prio WHERE { ?c t:c_mktsegment ?seg OPTIONAL { ?o t:o_cust ?c ; t:o_orderpriority ?prio ; t:o_totalprice ?total FILTER(?total > 490000) } }",
        "SELECT DISTINCT c_mktsegment AS seg, o_orderpriority AS prio FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 490000) o ON o_custkey = c_custkey",
    ),
    "distinct_order_hidden": (
        "SELECT DISTINCT ?seg WHERE { ?c t:c_mktsegment ?seg ; t:c_acctbal ?bal } ORDER BY ?bal LIMIT 3",
        "SELECT c_mktsegment AS seg FROM customer GROUP BY seg ORDER BY min(c_acctbal), seg LIMIT 3",
    ),
    "order_asc_desc": (
        "SELECT ?name ?bal WHERE { ?c t:c_name ?name ; t:c_acctbal ?bal ; t:c_nationkey ?n } ORDER BY ASC(?n) DESC(?bal) ?name",
        "SELECT c_name AS name, c_acctbal AS bal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_name",
    ),
    "order_expr": (
        "SELECT ?k WHERE { ?p t:p_partkey ?k ; t:p_size ?s } ORDER BY DESC(?s * 2 - ?k) ?k",
        "SELECT p_partkey AS k FROM part ORDER BY p_size * 2 - p_partkey DESC, p_partkey",
    ),
    "order_unbound": (
        "SELECT ?name ?total WHERE { ?c t:c_name ?name OPTIONAL { ?o t:o_cust ?c ; t:o_totalprice ?total FILTER(?total > 480000) } } ORDER BY ?total ?name",
        f"SELECT c_name AS name, o_totalprice AS total FROM {_CUSTOMER_ORDERS} ORDER BY o_totalprice NULLS FIRST, c_name",
    ),
    "limit_offset": (
        "SELECT ?k WHERE { ?o t:o_orderkey ?k } ORDER BY ?k LIMIT 20 OFFSET 40",
        "SELECT o_orderkey AS k FROM orders ORDER BY k LIMIT 20 OFFSET 40",
    ),
    "limit_zero": ("SELECT ?k WHERE { ?o t:o_orderkey ?k } ORDER BY ?k LIMIT 0", "SELECT o_orderkey AS k FROM orders LIMIT 0"),
    "topk": (
        "SELECT ?k ?p WHERE { ?o t:o_orderkey ?k ; t:o_totalprice ?p } ORDER BY DESC(?p) ?k LIMIT 25",
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 25",
    ),
    "topk_offset": (
        "SELECT ?k ?p WHERE { ?o t:o_orderkey ?k ; t:o_totalprice ?p } ORDER BY DESC(?p) ?k OFFSET 10 LIMIT 25",
        "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 25 OFFSET 10",
    ),
    "select_star": ("SELECT * WHERE { ?r t:r_name ?name ; t:r_regionkey ?key }", "SELECT 'urn:t:region/' || r_regionkey AS r, r_name AS name, r_regionkey AS key FROM region"),
    "select_unknown_var": ("SELECT ?name ?nothing WHERE { ?r t:r_name ?name }", "SELECT r_name AS name, NULL::VARCHAR AS nothing FROM region"),
    "ask_true": ('ASK { ?c t:c_mktsegment "BUILDING" }', "SELECT count(*) > 0 AS ask FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "ask_false": ('ASK { ?c t:c_mktsegment "NONE" }', "SELECT count(*) > 0 AS ask FROM customer WHERE c_mktsegment = 'NONE'"),
}


def _query(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(relational_graph(spark, sf_dir), PREFIX + text)


def format_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in N-Triples notation."""
    return run(relational_graph(spark, sf_dir), PREFIX + "SELECT ?c ?name ?k WHERE { ?c t:c_name ?name ; t:c_custkey ?k }", "terms")


def stats_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of each predicate of the virtual graph."""
    return relational_graph(spark, sf_dir).counts()


#: Bytes of tables whose statements are written as text at once.
PART_BYTES = 128e6


def text_parts(graph: MappedTables) -> int:
    """Parts in which to write a graph's statements, so that the text of one doesn't grow with the tables."""
    return max(1, math.ceil(sum(float(t.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for t in graph.tables) / PART_BYTES))


def export(graph: MappedTables, names: list[str], part: int = 0, parts: int = 1) -> DataFrame:
    """The statements of a virtual graph's tables, by the tables' subject prefixes; of several parts, by subject, one."""
    out = None
    for table in graph.tables:
        if table.prefix not in names:
            continue
        df, subject = MappedTables.keyed(table)
        cells = F.array(*[F.struct(F.lit(p).alias("p_lex"), *as_statement(Ex(kind, col))) for p, (kind, col) in table.predicates().items()])
        chosen = subject.isNotNull() if parts == 1 else F.pmod(F.xxhash64(subject), F.lit(parts)) == part
        rows = df.where(subject.isNotNull() & chosen).select(F.lit(IRI if table.key else BLANK).alias("s_cat"), lexical(Ex(table.subject_kind, subject)).alias("s_lex"), F.inline(cells)).where("o_lex IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out


def _read_parts(spark: SparkSession, graph: MappedTables) -> Iterator[DataFrame]:
    """A graph's statements written as N-Triples text and read, part by part: a part's text goes when the next is asked for."""
    parts = text_parts(graph)
    for i in range(parts):
        text = shared_path(spark, "statements")
        ntriples.write(export(graph, [t.prefix for t in graph.tables], i, parts), text, compression="gzip")
        yield read_statements(spark, text, "ntriples")
        delete(spark, text)


_stores: dict[tuple[str, str], EncodedStore] = {}


def _loaded(spark: SparkSession, sf_dir: str) -> EncodedStore:
    """All tables written as N-Triples text, read, and built into a store, which a session keeps."""
    at = spark.sparkContext.applicationId, sf_dir
    if at not in _stores:
        _stores[at] = build(spark, _read_parts(spark, relational_graph(spark, sf_dir)), shared_path(spark, "store"))
    return _stores[at]


def load_ntriples_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(_loaded(spark, sf_dir), PREFIX + _ACCOUNTS, "terms")


def store_optional_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT ?nation ?name WHERE { ?n t:n_name ?nation OPTIONAL { ?s t:s_nation ?n ; t:s_name ?name ; t:s_acctbal ?b FILTER(?b > 5000) } } ORDER BY DESC(?nation) ?name"
    return run(_loaded(spark, sf_dir), PREFIX + text)


def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).counts()


def stream_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of all tables read as a stream, matched with a star of patterns, counted by segment."""
    from triplane.streaming.statements import drain, match_star, read_stream

    graph, text, progress = relational_graph(spark, sf_dir), shared_path(spark, "statements"), shared_path(spark, "progress")
    parts, out = text_parts(graph), None
    for i in range(parts):
        # the stream goes on where it stopped, with its state; text that it has read goes
        ntriples.write(export(graph, [t.prefix for t in graph.tables], i, parts), f"{text}/{i}", compression="gzip")
        found = match_star(read_stream(spark, f"{text}/*"), {"urn:t:c_mktsegment": "seg"})
        got = drain(found.groupBy("seg").count(), "complete", progress)
        out = got if out is None or not got.isEmpty() else out
        delete(spark, f"{text}/{i}")
    return out.select(F.col("seg"), F.col("count").alias("n"))


_ACCOUNTS = "SELECT ?name ?nation ?bal WHERE { ?c t:c_name ?name ; t:c_nation ?n ; t:c_acctbal ?bal . ?n t:n_name ?nation FILTER(?bal > 5000) }"
_ACCOUNTS_SQL = f"""SELECT '"' || c_name || '"' AS name, '"' || n_name || '"' AS nation, '"' || c_acctbal || '"^^<{XSD}double>' AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000"""


def load_turtle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements of two tables written as Turtle files, read and built into a store."""
    text, store = shared_path(spark, "turtle"), shared_path(spark, "store")
    ntriples.write(export(relational_graph(spark, sf_dir), ["urn:t:nation/", "urn:t:customer/"]), text, lines=50_000)  # N-Triples are Turtle; a document is parsed whole
    return run(build(spark, read_statements(spark, text, "turtle"), store), PREFIX + _ACCOUNTS, "terms")


def load_rdfxml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document in RDF/XML for each nation, with its customers, read and built into a store."""
    nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    literal = lambda c, kind: F.concat(F.lit(f'<t:{c} rdf:datatype="{XSD}{kind}">'), F.col(c).cast("string"), F.lit(f"</t:{c}>"))
    text = lambda c: F.concat(F.lit(f"<t:{c}>"), F.col(c), F.lit(f"</t:{c}>"))
    one = F.concat(F.lit('<rdf:Description rdf:about="customer/'), F.col("c_custkey"), F.lit('">'), text("c_name"), literal("c_acctbal", "double"), F.lit('<t:c_nation rdf:resource="nation/'), F.col("c_nationkey"), F.lit('"/></rdf:Description>'))
    held = customer.select("c_nationkey", one.alias("x")).groupBy("c_nationkey").agg(F.concat_ws("", F.sort_array(F.collect_list("x"))).alias("body"))
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:t="urn:t:" xml:base="urn:t:">'
    named = F.concat(F.lit(f'{head}<rdf:Description rdf:about="nation/'), F.col("n_nationkey"), F.lit('">'), text("n_name"), F.lit("</rdf:Description>"), F.coalesce("body", F.lit("")), F.lit("</rdf:RDF>"))
    files = nation.join(held, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.concat(F.lit("urn:t:nation-"), "n_nationkey").alias("path"), F.encode(named, "UTF-8").alias("content"))
    return run(build(spark, documents(files, "rdfxml"), shared_path(spark, "store")), PREFIX + _ACCOUNTS, "terms")


def text_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's result as lines of text."""
    return text_lines(relational_graph(spark, sf_dir), PREFIX + "SELECT ?c ?name ?total WHERE { ?c t:c_name ?name OPTIONAL { ?o t:o_cust ?c ; t:o_totalprice ?total FILTER(?total > 480000) } }")


def xml_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's result as elements of the XML results format."""
    return xml_results(relational_graph(spark, sf_dir), PREFIX + "SELECT ?s ?name ?n ?k WHERE { ?s t:s_name ?name ; t:s_nation ?n ; t:s_suppkey ?k OPTIONAL { ?s t:absent ?x } }")


def blank_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a key, in files of several folders, met through two scans: each is one blank node in both."""
    path = shared_path(spark, "lines")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.partitionBy("l_returnflag", "l_linestatus").parquet(path)
    graph = MappedTables(spark, [Table(spark.read.parquet(path), "line", None, "urn:t:")])
    return run(graph, PREFIX + "SELECT ?order ?n ?tax WHERE { ?l t:l_orderkey ?order ; t:l_linenumber ?n . ?l ?p ?tax FILTER(?p = t:l_tax) }")


_EXTRA: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "format_terms": (
        format_terms,
        f"SELECT '<urn:t:customer/' || c_custkey || '>' AS c, '\"' || c_name || '\"' AS name, '\"' || c_custkey || '\"^^<{XSD}integer>' AS k FROM customer",
    ),
    "load_ntriples_roundtrip": (load_ntriples_roundtrip, _ACCOUNTS_SQL),
    "load_turtle_roundtrip": (load_turtle_roundtrip, _ACCOUNTS_SQL),
    "load_rdfxml": (load_rdfxml, _ACCOUNTS_SQL),
    "text_result": (
        text_result,
        f"""SELECT '<urn:t:customer/' || c_custkey || '> "' || c_name || '" ' || coalesce('"' || o_totalprice || '"^^<{XSD}double>', '') AS value FROM {_CUSTOMER_ORDERS}""",
    ),
    "xml_result": (
        xml_result,
        f"""SELECT '<result><binding name="s"><uri>urn:t:supplier/' || s_suppkey || '</uri></binding><binding name="name"><literal>' || s_name || '</literal></binding><binding name="n"><uri>urn:t:nation/' || s_nationkey
           || '</uri></binding><binding name="k"><literal datatype="{XSD}integer">' || s_suppkey || '</literal></binding></result>' AS value FROM supplier""",
    ),
    "blank_identity": (blank_identity, "SELECT l_orderkey AS \"order\", l_linenumber AS n, l_tax::VARCHAR AS tax FROM lineitem WHERE l_tax IS NOT NULL"),
    "store_optional_order": (
        store_optional_order,
        """SELECT n_name AS nation, s_name AS name FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON s_nationkey = n_nationkey ORDER BY n_name DESC, s_name NULLS FIRST""",
    ),
    "stream_statements": (stream_statements, "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1"),
}


def _counts_sql(tables: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(f"SELECT 'urn:t:{name}' AS predicate, count({column}) AS triples FROM {t}" for t, columns in tables.items() for name, _, column in (c.rpartition("=") if "=" in c else (c, "", c) for c in columns))


_ALL = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey", "n_region=n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "c_nation=c_nationkey"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal", "s_nation=s_nationkey"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "o_cust=o_custkey"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars", "tagged_text=text"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate", "l_order=l_orderkey", "l_part=l_partkey", "l_supp=l_suppkey"],
}
_EXTRA["stats_by_pattern"] = stats_by_pattern, _counts_sql(_ALL)
_EXTRA["store_counts"] = store_counts, _counts_sql(_ALL)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: partial(_query, text) for k, (text, _) in SPARQL.items()} | {k: f for k, (f, _) in _EXTRA.items()}
ORACLE_SQL: dict[str, str] = {k: sql for k, (_, sql) in (SPARQL | _EXTRA).items()}
