"""The registered queries of the lineage engine, each with the SQL that must give the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import LineageEngine
from .functions import exporters, reports, rewrite
from .operators import ast, graph, incremental, matrix, quality, ranges
from .sources import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

FLAGSHIP = """SELECT c.c_name AS name, SUM(o.o_totalprice) AS total
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderstatus = 'F' GROUP BY c.c_name"""

#: Statements with the edges that follow from their meaning: kind, from, to, transform.  A bare name in ORDER BY is a source column wherever it can be one.
STATEMENTS: dict[str, tuple[str, str]] = {
    "lineage_select": ("SELECT o.o_orderkey AS k, o.o_totalprice * 2 AS p FROM orders o WHERE o.o_orderstatus = 'F'", """
        OUTPUT orders.o_orderkey k DIRECT; OUTPUT orders.o_totalprice p EXPRESSION; PREDICATE orders.o_orderstatus k FILTER_PREDICATE;
        PREDICATE orders.o_orderstatus p FILTER_PREDICATE; SOURCE orders k SOURCE; SOURCE orders p SOURCE"""),
    "lineage_join": (FLAGSHIP, """
        OUTPUT customer.c_name name DIRECT; OUTPUT orders.o_totalprice total AGGREGATE; JOIN_KEY orders.o_custkey customer.c_custkey JOIN_KEY;
        PREDICATE orders.o_orderstatus name FILTER_PREDICATE; PREDICATE orders.o_orderstatus total FILTER_PREDICATE; GROUP_BY customer.c_name name GROUPING;
        GROUP_BY customer.c_name total GROUPING; SOURCE orders name SOURCE; SOURCE orders total SOURCE; SOURCE customer name SOURCE; SOURCE customer total SOURCE"""),
    "lineage_cte_chain": ("WITH a AS (SELECT n.n_name FROM nation n), b(x) AS (SELECT a.n_name FROM a) SELECT b.x FROM b", """
        OUTPUT nation.n_name a.n_name DIRECT; SOURCE nation a.n_name SOURCE; OUTPUT a.n_name b.x DIRECT; SOURCE a b.x SOURCE; OUTPUT b.x x DIRECT; SOURCE b x SOURCE"""),
    "lineage_union": ("SELECT r.r_name FROM region r UNION ALL SELECT n.n_name FROM nation n", """
        OUTPUT region.r_name r_name DIRECT; SOURCE region r_name SOURCE; OUTPUT nation.n_name r_name DIRECT; SOURCE nation r_name SOURCE"""),
    "lineage_window": ("SELECT rank() OVER (PARTITION BY p.p_brand ORDER BY p.p_size) AS r FROM part p", """
        OUTPUT part.p_brand r WINDOW; OUTPUT part.p_size r WINDOW; SOURCE part r SOURCE"""),
    "lineage_case": ("SELECT CASE WHEN s.s_acctbal > 0 THEN s.s_name ELSE 'none' END AS n FROM supplier s", """
        OUTPUT supplier.s_acctbal n CASE_BRANCH; OUTPUT supplier.s_name n CASE_BRANCH; SOURCE supplier n SOURCE"""),
    "lineage_aggregate": ("SELECT l.l_returnflag, SUM(l.l_quantity) AS q, COUNT(*) AS c FROM lineitem l GROUP BY l.l_returnflag HAVING SUM(l.l_tax) > 0 ORDER BY l.l_returnflag", """
        OUTPUT lineitem.l_returnflag l_returnflag DIRECT; OUTPUT lineitem.l_quantity q AGGREGATE; PREDICATE lineitem.l_tax l_returnflag FILTER_PREDICATE;
        PREDICATE lineitem.l_tax q FILTER_PREDICATE; PREDICATE lineitem.l_tax c FILTER_PREDICATE; GROUP_BY lineitem.l_returnflag l_returnflag GROUPING;
        GROUP_BY lineitem.l_returnflag q GROUPING; GROUP_BY lineitem.l_returnflag c GROUPING; ORDER_BY lineitem.l_returnflag l_returnflag ORDERING;
        ORDER_BY lineitem.l_returnflag q ORDERING; ORDER_BY lineitem.l_returnflag c ORDERING; SOURCE lineitem l_returnflag SOURCE; SOURCE lineitem q SOURCE; SOURCE lineitem c SOURCE"""),
    "lineage_derived": ("SELECT d.k FROM (SELECT e.user_id AS k FROM events e WHERE e.value > 1) d", """
        OUTPUT d.k k DIRECT; OUTPUT events.user_id d.k DIRECT; PREDICATE events.value d.k FILTER_PREDICATE; SOURCE events d.k SOURCE"""),
    "lineage_using": ("SELECT a.v FROM a JOIN b USING (k)", """
        OUTPUT a.v v DIRECT; SOURCE a v SOURCE; SOURCE b v SOURCE"""),
    "lineage_composite_on": ("SELECT l.l_tax AS t FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size > 3", """
        OUTPUT lineitem.l_tax t DIRECT; PREDICATE lineitem.l_partkey t FILTER_PREDICATE; PREDICATE part.p_partkey t FILTER_PREDICATE; PREDICATE part.p_size t FILTER_PREDICATE;
        SOURCE lineitem t SOURCE; SOURCE part t SOURCE"""),
    "lineage_insert": ("INSERT INTO sink (a, b) SELECT n.n_nationkey, upper(n.n_name) FROM nation n", """
        OUTPUT nation.n_nationkey sink.a DIRECT; OUTPUT nation.n_name sink.b EXPRESSION; SOURCE nation sink.a SOURCE; SOURCE nation sink.b SOURCE"""),
    "lineage_ctas": ("CREATE TABLE copy AS SELECT r.r_name FROM region r", "OUTPUT region.r_name copy.r_name DIRECT; SOURCE region copy.r_name SOURCE"),
    "lineage_view": ("CREATE VIEW v (n) AS SELECT r.r_name FROM region r", "OUTPUT region.r_name v.n DIRECT; SOURCE region v.n SOURCE"),
    "lineage_update": ("UPDATE part SET p_name = s.s_name FROM supplier s WHERE s.s_suppkey = part.p_partkey", """
        OUTPUT supplier.s_name part.p_name DIRECT; PREDICATE supplier.s_suppkey part.p_name FILTER_PREDICATE; PREDICATE part.p_partkey part.p_name FILTER_PREDICATE;
        SOURCE part part.p_name SOURCE; SOURCE supplier part.p_name SOURCE"""),
    "lineage_delete": ("DELETE FROM orders WHERE o_totalprice < 0", ""),
    "lineage_left_join": ("SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey", """
        OUTPUT customer.c_custkey k DIRECT; OUTPUT orders.o_orderkey o DIRECT; JOIN_KEY orders.o_custkey customer.c_custkey JOIN_KEY;
        SOURCE customer k SOURCE; SOURCE customer o SOURCE; SOURCE orders k SOURCE; SOURCE orders o SOURCE"""),
    "lineage_right_join": ("SELECT o.o_orderkey AS o FROM orders o RIGHT OUTER JOIN customer c ON o.o_custkey = c.c_custkey", """
        OUTPUT orders.o_orderkey o DIRECT; JOIN_KEY orders.o_custkey customer.c_custkey JOIN_KEY; SOURCE orders o SOURCE; SOURCE customer o SOURCE"""),
    "lineage_full_join": ("SELECT n.n_name AS n FROM nation n FULL JOIN supplier s ON n.n_nationkey = s.s_nationkey", """
        OUTPUT nation.n_name n DIRECT; JOIN_KEY nation.n_nationkey supplier.s_nationkey JOIN_KEY; SOURCE nation n SOURCE; SOURCE supplier n SOURCE"""),
    "lineage_cross_join": ("SELECT r.r_name AS r, n.n_name AS n FROM region r CROSS JOIN nation n", """
        OUTPUT region.r_name r DIRECT; OUTPUT nation.n_name n DIRECT; SOURCE region r SOURCE; SOURCE region n SOURCE; SOURCE nation r SOURCE; SOURCE nation n SOURCE"""),
    "lineage_comma_join": ("SELECT n.n_name AS n FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey", """
        OUTPUT nation.n_name n DIRECT; PREDICATE nation.n_regionkey n FILTER_PREDICATE; PREDICATE region.r_regionkey n FILTER_PREDICATE; SOURCE nation n SOURCE; SOURCE region n SOURCE"""),
    "lineage_theta_join": ("SELECT a.p_partkey AS x FROM part a JOIN part b ON a.p_size < b.p_size", """
        OUTPUT part.p_partkey x DIRECT; PREDICATE part.p_size x FILTER_PREDICATE; PREDICATE part.p_size x FILTER_PREDICATE; SOURCE part x SOURCE"""),
    "lineage_self_join": ("SELECT a.r_name AS x, b.r_name AS y FROM region a JOIN region b ON a.r_regionkey = b.r_regionkey", """
        OUTPUT region.r_name x DIRECT; OUTPUT region.r_name y DIRECT; JOIN_KEY region.r_regionkey region.r_regionkey JOIN_KEY; SOURCE region x SOURCE; SOURCE region y SOURCE"""),
    "lineage_exists": ("SELECT c.c_name AS n FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", """
        OUTPUT customer.c_name n DIRECT; PREDICATE orders.o_custkey n FILTER_PREDICATE; PREDICATE customer.c_custkey n FILTER_PREDICATE; SOURCE customer n SOURCE"""),
    "lineage_in_subquery": ("SELECT n.n_name AS n FROM nation n WHERE n.n_regionkey IN (SELECT r.r_regionkey FROM region r WHERE r.r_name < 'B')", """
        OUTPUT nation.n_name n DIRECT; PREDICATE nation.n_regionkey n FILTER_PREDICATE; PREDICATE region.r_regionkey n FILTER_PREDICATE; PREDICATE region.r_name n FILTER_PREDICATE; SOURCE nation n SOURCE"""),
    "lineage_scalar_subquery": ("SELECT c.c_name AS n, (SELECT MAX(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS m FROM customer c", """
        OUTPUT customer.c_name n DIRECT; OUTPUT orders.o_totalprice m EXPRESSION; OUTPUT orders.o_custkey m EXPRESSION; OUTPUT customer.c_custkey m EXPRESSION; SOURCE customer n SOURCE; SOURCE customer m SOURCE"""),
    "lineage_subquery_over_derived": ("SELECT p.p_name AS n FROM part p WHERE p.p_size > (SELECT AVG(d.s) FROM (SELECT q.p_size AS s FROM part q) d)", """
        OUTPUT part.p_name n DIRECT; PREDICATE part.p_size n FILTER_PREDICATE; PREDICATE d.s n FILTER_PREDICATE; SOURCE part n SOURCE; OUTPUT part.p_size d.s DIRECT; SOURCE part d.s SOURCE"""),
    "lineage_rollup": ("SELECT o.o_orderstatus AS s, COUNT(*) AS n FROM orders o GROUP BY ROLLUP (o.o_orderstatus, o.o_orderpriority)", """
        OUTPUT orders.o_orderstatus s DIRECT; GROUP_BY orders.o_orderstatus s GROUPING; GROUP_BY orders.o_orderstatus n GROUPING; GROUP_BY orders.o_orderpriority s GROUPING;
        GROUP_BY orders.o_orderpriority n GROUPING; SOURCE orders s SOURCE; SOURCE orders n SOURCE"""),
    "lineage_lag": ("SELECT lag(e.event_type, 1, 'none') OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS b FROM events e", """
        OUTPUT events.event_type b WINDOW; OUTPUT events.user_id b WINDOW; OUTPUT events.event_id b WINDOW; SOURCE events b SOURCE"""),
    "lineage_frame": ("SELECT SUM(o.o_totalprice) OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS t FROM orders o", """
        OUTPUT orders.o_totalprice t WINDOW; OUTPUT orders.o_custkey t WINDOW; OUTPUT orders.o_orderkey t WINDOW; SOURCE orders t SOURCE"""),
    "lineage_order_limit": ("SELECT o.o_orderkey AS k, o.o_orderdate AS d FROM orders o ORDER BY o.o_totalprice DESC, k LIMIT 10 OFFSET 2", """
        OUTPUT orders.o_orderkey k DIRECT; OUTPUT orders.o_orderdate d DIRECT; ORDER_BY orders.o_totalprice k ORDERING; ORDER_BY orders.o_totalprice d ORDERING;
        ORDER_BY orders.k k ORDERING; ORDER_BY orders.k d ORDERING; SOURCE orders k SOURCE; SOURCE orders d SOURCE"""),
    "lineage_distinct": ("SELECT DISTINCT o.o_orderstatus FROM orders o", "OUTPUT orders.o_orderstatus o_orderstatus DIRECT; SOURCE orders o_orderstatus SOURCE"),
    "lineage_intersect_except": ("SELECT o.o_custkey AS k FROM orders o INTERSECT SELECT c.c_custkey FROM customer c EXCEPT SELECT s.s_suppkey FROM supplier s", """
        OUTPUT orders.o_custkey k DIRECT; SOURCE orders k SOURCE; OUTPUT customer.c_custkey k DIRECT; SOURCE customer k SOURCE; OUTPUT supplier.s_suppkey k DIRECT; SOURCE supplier k SOURCE"""),
    "lineage_casts": ("SELECT CAST(p.p_size AS BIGINT) AS a, p.p_name || '-' || p.p_brand AS b, p.p_size BETWEEN 1 AND 9 AS c, p.p_type IS NULL AS d, 1 AS e FROM part p", """
        OUTPUT part.p_size a EXPRESSION; OUTPUT part.p_name b EXPRESSION; OUTPUT part.p_brand b EXPRESSION; OUTPUT part.p_size c EXPRESSION; OUTPUT part.p_type d EXPRESSION;
        SOURCE part a SOURCE; SOURCE part b SOURCE; SOURCE part c SOURCE; SOURCE part d SOURCE; SOURCE part e SOURCE"""),
    "lineage_nested_aggregate": ("SELECT SUM(l.l_tax) / COUNT(l.l_discount) AS r FROM lineitem l", "OUTPUT lineitem.l_tax r EXPRESSION; OUTPUT lineitem.l_discount r EXPRESSION; SOURCE lineitem r SOURCE"),
    "lineage_in_list": ("SELECT n.n_name AS n FROM nation n WHERE n.n_regionkey IN (1, 2) AND NOT n.n_name LIKE 'A%'", """
        OUTPUT nation.n_name n DIRECT; PREDICATE nation.n_regionkey n FILTER_PREDICATE; PREDICATE nation.n_name n FILTER_PREDICATE; SOURCE nation n SOURCE"""),
    "lineage_delete_exists": ("DELETE FROM orders WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = orders.o_custkey)", ""),
}
# Without a schema, USING (k) finds k in the only source to its left and in the right one.
STATEMENTS["lineage_using"] = (STATEMENTS["lineage_using"][0], STATEMENTS["lineage_using"][1] + "; JOIN_KEY a.k b.k JOIN_KEY")

#: Every construct that the engine recognises, run on the tables; {name} is a table.
EXECUTED: dict[str, str] = {
    "exec_filter_project": "SELECT o_orderkey, o_totalprice * 2 AS p2 FROM {orders} WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 200000",
    "exec_inner_join": "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "exec_left_join": "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey",
    "exec_right_join": "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM {orders} RIGHT JOIN {customer} ON o_custkey = c_custkey GROUP BY c_custkey",
    "exec_full_join": "SELECT n_nationkey, s_suppkey FROM {nation} FULL JOIN {supplier} ON n_nationkey = s_suppkey",
    "exec_cross_join": "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}",
    "exec_using_join": "SELECT a.r_name AS x, b.r_name AS y FROM {region} a JOIN {region} b USING (r_regionkey)",
    "exec_natural_join": "SELECT r_regionkey, r_name FROM {region} NATURAL JOIN (SELECT r_regionkey FROM {region}) q",
    "exec_semi_join": "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)",
    "exec_anti_join": "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)",
    "exec_in_subquery": "SELECT n_name FROM {nation} WHERE n_regionkey IN (SELECT r_regionkey FROM {region} WHERE r_name < 'B')",
    "exec_scalar_subquery": "SELECT p_partkey FROM {part} WHERE p_retailprice > (SELECT avg(p_retailprice) FROM {part})",
    "exec_lateral": "SELECT n_name, q.n AS n FROM {nation} CROSS JOIN LATERAL (SELECT CAST(count(*) AS BIGINT) AS n FROM {customer} WHERE c_nationkey = n_nationkey) q",
    "exec_aggregates": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, min(l_tax) AS lo, max(l_tax) AS hi, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS d, bool_and(l_quantity > 0) AS b FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "exec_filter_aggregate": "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS f FROM {orders} GROUP BY o_orderpriority",
    "exec_statistics": "SELECT p_brand, round(stddev_pop(p_size), 6) AS sd, round(var_samp(p_size), 6) AS vs, median(p_size) AS md FROM {part} GROUP BY p_brand",
    "exec_having": "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 12",
    "exec_rollup": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "exec_cube": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "exec_grouping_sets": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "exec_string_agg": "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey",
    "exec_rank": "SELECT p_partkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr FROM {part} WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey), v AS (PARTITION BY p_brand ORDER BY p_size)",
    "exec_lead_lag": "SELECT event_id, lag(event_type, 1, 'none') OVER (PARTITION BY user_id ORDER BY event_id) AS before, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM {events}",
    "exec_frame": "SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM {orders}",
    "exec_qualify": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM {orders}) q WHERE rn = 1",
    "exec_top_k": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "exec_limit_offset": "SELECT c_custkey FROM {customer} ORDER BY c_custkey LIMIT 5 OFFSET 7",
    "exec_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}",
    "exec_union": "SELECT n_regionkey AS k FROM {nation} UNION SELECT r_regionkey FROM {region}",
    "exec_union_all": "SELECT n_regionkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}",
    "exec_intersect": "SELECT o_custkey AS k FROM {orders} INTERSECT SELECT c_custkey FROM {customer}",
    "exec_except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}",
    "exec_cte": "WITH a AS (SELECT o_custkey, sum(o_totalprice) AS t FROM {orders} GROUP BY o_custkey), b AS (SELECT max(t) AS m FROM a) SELECT o_custkey FROM a, b WHERE t = m",
    "exec_recursive": "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT n FROM r",
    "exec_case": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS w, CASE c_mktsegment WHEN 'BUILDING' THEN 1 ELSE 0 END AS b FROM {customer}",
    "exec_strings": "SELECT n_nationkey, upper(n_name) || '-' || lower(n_name) AS a, length(n_name) AS l, substring(n_name, 2, 3) AS s, replace(n_name, 'A', '_') AS r, n_name ILIKE '%an%' AS i FROM {nation}",
    "exec_nulls": "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), -1) AS a, n_name IS NULL AS b, n_regionkey IN (1, 2) AS c, n_regionkey NOT BETWEEN 1 AND 2 AS d FROM {nation}",
    "exec_dates": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS d, date_trunc('month', o_orderdate) AS t, o_orderdate + INTERVAL '1' DAY AS n FROM {orders}",
    "exec_casts": "SELECT p_partkey, CAST(p_size AS BIGINT) AS a, CAST(p_size AS VARCHAR(10)) AS b, TRY_CAST(p_name AS INT) AS c FROM {part}",
    "exec_range_join": "SELECT a.p_partkey AS x, b.p_partkey AS y FROM {part} a JOIN {part} b ON a.p_brand = b.p_brand AND a.p_size < b.p_size AND b.p_size <= a.p_size + 1",
    "exec_pivot": "SELECT o_orderpriority, CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS BIGINT) AS f, CAST(count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS BIGINT) AS o FROM {orders} GROUP BY o_orderpriority",
}
#: Where DuckDB writes a construct otherwise.
DUCK = {"exec_string_agg": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- graphs of the tables -------------------------------------------------------


def key_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as edges: region -> nation -> customer -> orders, nation -> supplier."""
    t = lambda n: read(spark, sf_dir, n)

    def edges(df, a, b, p, q, kind, transform):
        return df.select(F.concat(F.lit(p), F.col(a).cast("string")).alias("src"), F.concat(F.lit(q), F.col(b).cast("string")).alias("dst"), F.lit(kind).alias("kind"), F.lit(transform).alias("transform"))

    return (
        edges(t("nation"), "n_regionkey", "n_nationkey", "r", "n", "OUTPUT", "DIRECT")
        .union(edges(t("customer"), "c_nationkey", "c_custkey", "n", "c", "OUTPUT", "DIRECT"))
        .union(edges(t("orders"), "o_custkey", "o_orderkey", "c", "o", "JOIN_KEY", "JOIN_KEY"))
        .union(edges(t("supplier"), "s_nationkey", "s_suppkey", "n", "s", "PREDICATE", "FILTER_PREDICATE"))
    )


KEY_SQL = """SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'OUTPUT' AS kind, 'DIRECT' AS transform FROM nation
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'OUTPUT', 'DIRECT' FROM customer
UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'JOIN_KEY', 'JOIN_KEY' FROM orders
UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'PREDICATE', 'FILTER_PREDICATE' FROM supplier"""


def cyclic_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with cycles, self-loops and many parallel edges: part key to supplier key of every line, in one name space."""
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    return read(spark, sf_dir, "lineitem").select(name("l_partkey").alias("src"), name("l_suppkey").alias("dst"), F.lit("OUTPUT").alias("kind"), F.lit("DIRECT").alias("transform"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


CYCLE_SQL = "SELECT 'p' || l_partkey AS src, 'p' || l_suppkey AS dst, 'OUTPUT' AS kind, 'DIRECT' AS transform, l_orderkey * 10 + l_linenumber AS seq FROM lineitem"


def _reach(graph_sql: str, start: str, direction: str = "d", depth: int | None = None) -> str:
    steps = {"d": "SELECT src AS a, dst AS b FROM e", "u": "SELECT dst AS a, src AS b FROM e", "b": "SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e"}[direction]
    return f"""WITH RECURSIVE e AS ({graph_sql}), s AS (SELECT DISTINCT * FROM ({steps})),
r AS (SELECT '{start}' AS id, 0 AS d UNION SELECT s.b, r.d + 1 FROM r JOIN s ON s.a = r.id WHERE r.d < {depth if depth is not None else 12})
SELECT id, min(d)::INTEGER AS distance FROM r GROUP BY id"""


def _impact(start: str, direction: str, depth: int | None = None, g=key_graph):
    return lambda spark, sf_dir: graph.impact(g(spark, sf_dir), start, direction, depth)


_CLOSURE = f"""WITH RECURSIVE e AS ({CYCLE_SQL}), s AS (SELECT DISTINCT src, dst FROM e),
n AS (SELECT src AS id FROM s UNION SELECT dst FROM s), r AS (SELECT src AS a, dst AS b FROM s UNION SELECT r.a, s.dst FROM r JOIN s ON s.src = r.b)"""


def impact_truncated(spark, sf_dir):
    e = key_graph(spark, sf_dir)
    cut = graph.truncated(e, graph.impact(e, "r1", depth=2), 2)
    return spark.createDataFrame([("r1", 2, cut)], "id string, depth int, truncated boolean")


def collapse_tables(spark, sf_dir):
    e = key_graph(spark, sf_dir)
    return graph.collapse(e, graph.nodes(e).where("id LIKE 's%'").select("id"))


def ownership_edges(spark, sf_dir):
    e = read(spark, sf_dir, "nation").select(F.concat(F.lit("region.k"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("nation.k"), F.col("n_nationkey").cast("string")).alias("dst"))
    return graph.ownership(e, spark.createDataFrame([("table:region",), ("table:nation",)], "id string"))


# ---- lineage of statements --------------------------------------------------------


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.from_frames({t: read(spark, sf_dir, t) for t in TABLES})


def _lineage(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return LineageEngine(spark).lineage(sql).select("kind", "from_id", "to_id", "transform")

    return run


def _golden(text: str) -> str:
    rows = [r.split() for r in text.split(";") if r.strip()]
    if not rows:
        return "SELECT '' AS kind, '' AS from_id, '' AS to_id, '' AS transform WHERE false"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + ") v(kind, from_id, to_id, transform)"


def _with_catalog(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return LineageEngine(spark).lineage(sql, _tables(spark, sf_dir)).where("kind = 'OUTPUT'").select("from_id", "to_id")

    return run


UNKNOWNS = "SELECT x, o.nosuch, q.y, c_name AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"


def lineage_unknowns(spark, sf_dir):
    facts = LineageEngine(spark).facts(spark.createDataFrame([("-", UNKNOWNS)], "source_file string, sql string"), _tables(spark, sf_dir))
    return LineageEngine.table(facts, "unknown").select("reason")


SCRIPT = "SELECT 1; -- no; statement\n/* a; b */ INSERT INTO t SELECT ';' FROM x;\n;SELECT \"a;b\" FROM y"


def statement_split(spark, sf_dir):
    facts = LineageEngine(spark).facts(spark.createDataFrame([("-", SCRIPT)], "source_file string, sql string"))
    return LineageEngine.table(facts, "statement").select("statement_index", "statement_kind", "span_start", "span_end")


def _scripts(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A script for each nation, from an expression over its row."""
    return read(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS STRING) AS source_file", f"{sql} AS sql")


#: A script for each nation: its columns and tables are named by the row's keys.  The text is the same expression in both engines.
NUMBERED = "'SELECT c' || n_nationkey || ' + 1 AS x FROM t' || n_regionkey"
SPREAD = "'select  c' || n_nationkey || ',count(*) from t' || n_regionkey || ' where a = 1 group by c' || n_nationkey"
SUSPECT = "'SELECT n.n_name, n.no' || n_nationkey || ' FROM nation n WHERE n.n_regionkey = ' || n_regionkey"


def lineage_numbered(spark, sf_dir):
    """Edge ids, order, expressions and spans of a script for each nation."""
    return LineageEngine.table(LineageEngine(spark).facts(_scripts(spark, sf_dir, NUMBERED)), "edge").drop("statement_index")


def model_json(spark, sf_dir):
    """Fields read back out of the JSON reports of the numbered scripts."""
    told = reports.model_report(LineageEngine(spark).facts(_scripts(spark, sf_dir, NUMBERED)))
    field = lambda path, name: F.get_json_object("report", path).alias(name)
    return told.select("source_file", field("$.statements[0].statement_kind", "kind"), field("$.tables[0].table_id", "table_id"), field("$.scopes[0].scope_kind", "scope"), field("$.columns[1].column_id", "second"), field("$.edges[0].expression", "expression"), field("$.edges[1].from_id", "source"), field("$.unknowns", "unknowns"), field("$.diagnostics", "diagnostics"))


def format_json(spark, sf_dir):
    return reports.format_report(LineageEngine(spark).formatted(_scripts(spark, sf_dir, SPREAD)))


def validate_json(spark, sf_dir):
    scripts = _scripts(spark, sf_dir, SUSPECT)
    return reports.validate_report(scripts, LineageEngine(spark).validated(scripts, _tables(spark, sf_dir)))


def matrix_lines(spark, sf_dir):
    return reports.compatibility_lines(matrix.compatibility(_scripts(spark, sf_dir, NUMBERED).select(F.col("source_file").alias("id"), F.lit("ansi").alias("dialect"), "sql"))).select("line")


def quality_report_lines(spark, sf_dir):
    return reports.quality_lines(quality.ratios(_verdicts(spark, sf_dir), "case_id"), "case_id")


def format_scripts(spark, sf_dir):
    return LineageEngine(spark).formatted(_scripts(spark, sf_dir, SPREAD)).select("source_file", "text")


def validate_scripts(spark, sf_dir):
    return LineageEngine(spark).validated(_scripts(spark, sf_dir, SUSPECT), _tables(spark, sf_dir))


def shared_sources(spark, sf_dir):
    """Scripts that share a source_file, and some without one, each resolved against the catalog: edges by end."""
    n = read(spark, sf_dir, "nation")
    scripts = n.selectExpr("CASE WHEN n_regionkey > 0 THEN CAST(n_regionkey AS STRING) END AS source_file", "CASE WHEN n_nationkey % 2 = 0 THEN 'SELECT * FROM region' ELSE 'SELECT * FROM nation' END AS sql")
    edges = LineageEngine.table(LineageEngine(spark).facts(scripts, _tables(spark, sf_dir)), "edge").where("kind = 'OUTPUT'")
    return edges.groupBy("source_file", "from_id").agg(F.count("*").alias("n"))


#: Conversions: source, target, text, and what it must become (None: it must be refused).
CONVERSIONS: list[tuple[str, str, str, str | None]] = [
    ("mysql", "oracle", "SELECT ISNULL(a) FROM t", None),
    ("mysql", "tsql", "SELECT DISTINCT a FROM t LIMIT 3", "SELECT DISTINCT TOP (3) a FROM t"),
    ("mysql", "oracle", "SELECT GROUP_CONCAT(a) FROM t", None),
    ("mysql", "oracle", "SELECT a FROM t WHERE a REGEXP 'x'", None),
    ("mysql", "postgresql", "SELECT IF(a, 1, 2) FROM t", None),
    ("mysql", "postgresql", "SELECT DATE_FORMAT(a, '%Y') FROM t", None),
    ("mysql", "postgresql", 'SELECT "x" FROM t', None),
    ("mysql", "postgresql", "SELECT a || b FROM t", None),
    ("mysql", "postgresql", "SELECT 'a\\'b' FROM t", None),
    ("mysql", "postgresql", "SELECT a / b FROM t", None),
    ("mysql", "oracle", "SELECT `a` FROM `t` LIMIT 5", 'SELECT "a" FROM "t" FETCH FIRST 5 ROWS ONLY'),
    ("mysql", "trino", "SELECT `a` FROM `t` LIMIT 5", 'SELECT "a" FROM "t" LIMIT 5'),
    ("mysql", "oracle", "SELECT IFNULL(a, 0) FROM t", "SELECT NVL(a, 0) FROM t"),
    ("mysql", "tsql", "SELECT IFNULL(a, 0) FROM t", "SELECT ISNULL(a, 0) FROM t"),
    ("mysql", "postgresql", "SELECT IFNULL(a, 0) FROM t", "SELECT COALESCE(a, 0) FROM t"),
    ("oracle", "mysql", "SELECT NVL(a, b) FROM t", "SELECT IFNULL(a, b) FROM t"),
    ("tsql", "mysql", "SELECT TOP 3 [a] FROM t", "SELECT `a` FROM t LIMIT 3"),
    ("tsql", "oracle", "SELECT TOP (7) [a b] FROM t", 'SELECT "a b" FROM t FETCH FIRST 7 ROWS ONLY'),
    ("tsql", "mysql", "SELECT TOP 3 PERCENT a FROM t", None),
    ("tsql", "mysql", "SELECT a + b FROM t", None),
    ("oracle", "postgresql", "SELECT a FROM t, u WHERE t.k = u.k (+)", None),
    ("oracle", "mysql", "SELECT a FROM t FETCH FIRST 4 ROWS ONLY", "SELECT a FROM t LIMIT 4"),
    ("postgresql", "tsql", 'SELECT "a" FROM t LIMIT 3', "SELECT TOP (3) [a] FROM t"),
    ("postgresql", "tsql", "SELECT a FROM t UNION SELECT b FROM u LIMIT 3", None),
    ("postgresql", "mysql", "SELECT a::int FROM t", None),
    ("postgresql", "mysql", "SELECT a FROM t LIMIT 5 OFFSET 2", None),
    ("postgresql", "mysql", "SELECT a FROM t FULL JOIN u ON t.k = u.k", None),
    ("postgresql", "mysql", "SELECT a FROM t LEFT JOIN u ON t.k = u.k", "SELECT a FROM t LEFT JOIN u ON t.k = u.k"),
    ("postgresql", "oracle", "SELECT a FROM t AS x", None),
    ("postgresql", "oracle", "SELECT a AS b FROM t", "SELECT a AS b FROM t"),
    ("postgresql", "spark", "SELECT CASE WHEN a > 1 THEN 'x' ELSE 'y' END AS z FROM t", "SELECT CASE WHEN a > 1 THEN 'x' ELSE 'y' END AS z FROM t"),
    ("postgresql", "hive", "SELECT 'a\\b' FROM t", None),
    ("hive", "spark", "SELECT `a`, COUNT(*) AS n FROM t GROUP BY `a` HAVING COUNT(*) > 2", "SELECT `a`, COUNT(*) AS n FROM t GROUP BY `a` HAVING COUNT(*) > 2"),
    ("trino", "mysql", "SELECT a FROM t QUALIFY x > 1", None),
    ("mysql", "hive", "INSERT INTO t (a, b) SELECT c, d FROM u", "INSERT INTO t (a, b) SELECT c, d FROM u"),
    ("mysql", "postgresql", "CREATE TABLE t (a INT)", None),
]


def convert_cases(spark, sf_dir):
    """Every conversion is right or refused."""
    rows = [(a, b, sql, rewrite.convert(sql, a, b)[0]) for a, b, sql, _ in CONVERSIONS]
    return spark.createDataFrame(rows, "source string, target string, sql string, converted string")


def _changes(spark, sf_dir) -> DataFrame:
    """A pair of texts for each nation: one loses an output, those of region 0 do not parse."""
    n = read(spark, sf_dir, "nation")
    return n.selectExpr("CAST(n_nationkey AS STRING) AS id", "CASE WHEN n_regionkey = 0 THEN 'SELECT a FROM' ELSE 'SELECT a, b FROM t WHERE x = 1' END AS left", "'SELECT a FROM t WHERE x = ' || n_regionkey AS right")


def ast_diff_summary(spark, sf_dir):
    return ast.diff_summary(ast.diff(_changes(spark, sf_dir)))


def _spans(spark, sf_dir, start: str, size: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("o_orderstatus AS source_file", f"CAST({start} AS INT) AS span_start", f"CAST({start} + {size} AS INT) AS span_end")


SPANS = ("o_orderkey * 9", "o_custkey % 700"), ("o_orderkey * 9 + 40", "o_custkey % 5")


def span_overlaps(spark, sf_dir):
    """Overlapping spans of each file, counted by the span on the left."""
    a, b = (_spans(spark, sf_dir, *x) for x in SPANS)
    return ast.overlapping(a, b).groupBy("source_file", "span_start").agg(F.count("*").alias("n"))


def _said(rows: list[tuple], schema: str):
    return lambda spark, sf_dir: spark.createDataFrame(rows, schema)


def format_sql(spark, sf_dir):
    return spark.createDataFrame([(rewrite.format_sql("select a,count(*) from t where x in (select y from u) group by a")[0],)], "text string")


def convert_sql(spark, sf_dir):
    cases = [("SELECT `a` FROM `t` LIMIT 5", "mysql", "postgresql"), ("SELECT `a` FROM `t` LIMIT 5", "mysql", "oracle"), ('SELECT "a" FROM t LIMIT 3', "postgresql", "tsql"), ("SELECT a FROM t QUALIFY x > 1", "trino", "mysql")]
    return spark.createDataFrame([(s, a, b, *rewrite.convert(s, a, b)) for s, a, b in cases], "sql string, source string, target string, converted string, reason string").select("source", "target", F.col("converted").alias("sql"), F.col("reason").isNull().alias("ok"))


def validate_sql(spark, sf_dir):
    schema: dict = {}
    for t in TABLES:
        schema[t] = [(f.name, f.dataType.simpleString(), f.nullable) for f in read(spark, sf_dir, t).schema.fields]
    got = rewrite.validate("SELECT o.nosuch FROM orders o; SELECT 1 FROM missing; SELECT c_name FROM customer", schema)
    return spark.createDataFrame([(m, s, e) for _, m, s, e in got], "message string, span_start int, span_end int")


def ast_diff(spark, sf_dir):
    return ast.diff(spark.createDataFrame([("1", "SELECT a, b FROM t WHERE x = 1", "SELECT a FROM t WHERE x = 2")], "id string, left string, right string")).select("ordinal", "status", "type", "text")


def ast_search(spark, sf_dir):
    n = ast.nodes(spark.createDataFrame([("-", FLAGSHIP)], "source_file string, sql string"))
    return ast.search(n, "o_totalprice").select("node_id", "type", "hit")


CASES = [
    ("a", "mysql", ["basic", "limit"], "SELECT `a` FROM `t` LIMIT 5"),
    ("b", "postgresql", ["basic"], 'SELECT "a" FROM t LIMIT 3; SELECT x FROM t, u'),
    ("c", "trino", ["qualify"], "SELECT a FROM t WHERE"),
]


def _cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CASES, "id string, dialect string, features array<string>, sql string")


def compat_matrix(spark, sf_dir):
    return matrix.compatibility(_cases(spark)).withColumn("reason", F.col("reason").isNotNull())


def convert_matrix(spark, sf_dir):
    return matrix.conversions(_cases(spark), "mysql>postgresql,mysql>oracle,postgresql>tsql,trino>mysql").select("case_id", "pair", "ok", "sql")


def quality_by_feature(spark, sf_dir):
    """Each market segment is a feature of its nation's case."""
    key = F.concat(F.lit("case"), F.col("n_regionkey").cast("string"))
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cases = c.groupBy(key.alias("id")).agg(F.collect_set("c_mktsegment").alias("features"))
    return matrix.by_feature(_verdicts(spark, sf_dir), cases)


def edge_lines(spark, sf_dir):
    return reports.edge_lines(LineageEngine(spark).lineage("SELECT a * 2 AS p FROM t").where("kind = 'OUTPUT'")).select("line")


def facts_summary(spark, sf_dir):
    facts = LineageEngine(spark).facts(spark.createDataFrame([("x", "SELECT a, b FROM t; SELEC"), ("y", "SELECT a FROM t, u")], "source_file string, sql string"))
    return reports.summary(facts).select("source_file", "statements", "edges", "unknowns", "diagnostics", "tables")


# ---- quality, fingerprints, exports ---------------------------------------------------


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected: each nation's region; emitted: the regions of rich suppliers' nations, and a wrong nation for each poor supplier."""
    n = read(spark, sf_dir, "nation")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    want = n.select(F.concat(F.lit("case"), F.col("n_regionkey").cast("string")).alias("case_id"), name("r", "n_regionkey").alias("from_id"), name("n", "n_nationkey").alias("to_id"), F.lit("OUTPUT").alias("kind"))
    s = read(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    edge = lambda df, to, kind: df.select(F.concat(F.lit("case"), F.col("n_regionkey").cast("string")).alias("case_id"), name("r", "n_regionkey").alias("from_id"), name("n", to).alias("to_id"), F.lit(kind).alias("kind"))
    got = edge(s.where("s_acctbal > 5000"), "n_nationkey", "OUTPUT").union(edge(s.where("s_acctbal < 2000").withColumn("wrong", F.col("n_regionkey") + 1), "wrong", "OUTPUT")).union(edge(s, "n_nationkey", "SOURCE"))
    return quality.compare(want, got)


VERDICT_SQL = """WITH w AS (SELECT DISTINCT 'case' || n_regionkey AS case_id, 'r' || n_regionkey AS from_id, 'n' || n_nationkey AS to_id, 'OUTPUT' AS kind FROM nation),
g AS (SELECT DISTINCT 'case' || n_regionkey AS case_id, 'r' || n_regionkey AS from_id, 'n' || CASE WHEN s_acctbal < 2000 THEN n_regionkey + 1 ELSE n_nationkey END AS to_id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000 OR s_acctbal < 2000),
v AS (SELECT case_id, from_id, to_id, 'tp' AS verdict FROM (SELECT case_id, from_id, to_id FROM w INTERSECT SELECT * FROM g) UNION ALL
  SELECT case_id, from_id, to_id, 'fn' FROM (SELECT case_id, from_id, to_id FROM w EXCEPT SELECT * FROM g) UNION ALL SELECT case_id, from_id, to_id, 'fp' FROM (SELECT * FROM g EXCEPT SELECT case_id, from_id, to_id FROM w))"""


def quality_precision_recall(spark, sf_dir):
    return quality.ratios(_verdicts(spark, sf_dir), "case_id")


def quality_gaps(spark, sf_dir):
    key = F.col("r_regionkey").cast("string")
    declared = read(spark, sf_dir, "region").where("r_name = 'ASIA'").select(F.concat(F.lit("case"), key).alias("case_id"), F.concat(F.lit("r"), key).alias("from_id"))
    return quality.gaps(_verdicts(spark, sf_dir), declared).select("case_id", "from_id", "to_id")


def _coverage_cells(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("dialect"), F.col("o_orderstatus").alias("engine"), (F.col("o_totalprice") > 100000).alias("ok"))


def coverage_pivot(spark, sf_dir):
    return quality.pivot(_coverage_cells(spark, sf_dir), ["F", "O"])


def coverage_totals(spark, sf_dir):
    """Every order status, with ok and total; ``coverage_pivot`` keeps the two of its SQL."""
    return quality.pivot_totals(_coverage_cells(spark, sf_dir), ["F", "O", "P"])


def unknown_rate(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return quality.unknown_rate(d.select(F.col("n_chars").alias("n_references")), d.where("lang <> 'en'"))


def fingerprints(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return incremental.fingerprints(d.select(F.col("doc_id").alias("source_file"), F.col("text").alias("sql")), "ctx")


def incremental_actions(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    now = c.where("c_acctbal > 1000").select(F.col("c_custkey").alias("source_file"), F.col("c_name").alias("fingerprint"))
    old = c.where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("source_file"), F.when(F.col("c_acctbal") > 5000, F.col("c_name")).otherwise("old").alias("fingerprint"))
    return incremental.actions(now, old)


def openlineage_fields(spark, sf_dir):
    e = LineageEngine(spark).lineage(STATEMENTS["lineage_join"][0]).select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "kind", "transform")
    return exporters.openlineage_fields(e, spark.createDataFrame([("name",), ("total",)], "id string"))


def mermaid_edges(spark, sf_dir):
    return exporters.mermaid_edges(key_graph(spark, sf_dir).withColumn("seq", F.lit(0))).drop("seq")


def graph_merge_dedupe(spark, sf_dir):
    return graph.merge_edges(cyclic_graph(spark, sf_dir))


def in_out_degree(spark, sf_dir):
    e = key_graph(spark, sf_dir)
    ends = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def catalog_search(spark, sf_dir):
    return catalog.search(_tables(spark, sf_dir), "LINE")


def catalog_search_path(spark, sf_dir):
    c = _tables(spark, sf_dir).withColumn("schema", F.when(F.col("name") == "orders", "shop").otherwise("other")).withColumn("table_id", F.concat_ws(".", "schema", "name"))
    return catalog.find(c, spark.createDataFrame([("orders",), ("shop.orders",), ("nation",)], "query string"), ("shop",))


def _executed(sql: str):
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    return lambda spark, sf_dir: spark.sql(sql, **{n: read(spark, sf_dir, n) for n in names})


def exec_range_join(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("long")
    a = p.select("p_brand", size.alias("lo"), (size + 1).alias("hi"), F.col("p_partkey").alias("x"))
    return ranges.within(a, p.select("p_brand", size.alias("v"), F.col("p_partkey").alias("y")), "p_brand")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a join over the tables, with their schema at hand."""
    return LineageEngine(spark).lineage(FLAGSHIP, _tables(spark, sf_dir))


_COLUMNS_SQL = f"SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in TABLES)})"
STAR = "SELECT * FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"
BY_SCHEMA = "INSERT INTO region SELECT n.n_nationkey, n.n_name FROM nation n"


def queries() -> dict:
    out = {name: _lineage(sql) for name, (sql, _) in STATEMENTS.items()}
    out |= {name: _executed(sql) for name, sql in EXECUTED.items()}
    out |= {
        "exec_range_join": exec_range_join,
        "impact_downstream": _impact("r1", "DOWNSTREAM"), "impact_upstream": _impact("o1", "UPSTREAM"), "impact_both": _impact("p1", "BOTH", None, cyclic_graph),
        "impact_depth2": _impact("r1", "DOWNSTREAM", 2), "impact_unknown_origin": _impact("zz", "DOWNSTREAM"), "impact_truncated": impact_truncated,
        "shortest_path_lex": lambda s, d: graph.shortest_path(cyclic_graph(s, d), "p150", "p160", "BOTH"),
        "cycles_scc": lambda s, d: graph.cycles(cyclic_graph(s, d)),
        "cycles_listed": lambda s, d: graph.cycle_list(cyclic_graph(s, d)),
        "self_loops": lambda s, d: cyclic_graph(s, d).where("src = dst").select("src").distinct(),
        "strong_components": lambda s, d: graph.components(cyclic_graph(s, d)),
        "graph_merge_dedupe": graph_merge_dedupe, "in_out_degree": in_out_degree,
        "edges_by_kind": lambda s, d: key_graph(s, d).groupBy("kind").count().withColumnRenamed("count", "n"),
        "edge_filter_traverse": lambda s, d: graph.impact(graph.visible(key_graph(s, d)), "r2"),
        "subgraph_edges": lambda s, d: graph.subgraph(key_graph(s, d), graph.impact(key_graph(s, d), "n3").select("id")),
        "collapse_tables": collapse_tables, "ownership_edges": ownership_edges,
        "layout_depth": lambda s, d: graph.layers(key_graph(s, d)), "layout_rows": lambda s, d: graph.layout(key_graph(s, d)),
        "compat_matrix": compat_matrix, "convert_matrix": convert_matrix, "quality_by_feature": quality_by_feature, "edge_lines": edge_lines, "facts_summary": facts_summary,
        "capabilities": lambda s, d: matrix.capabilities(s).groupBy("engine").agg(F.count("*").alias("features"), F.sum(F.col("supported").cast("long")).alias("supported")),
        "lineage_star_expand": _with_catalog(STAR), "lineage_insert_by_schema": _with_catalog(BY_SCHEMA), "lineage_unknowns": lineage_unknowns,
        "catalog_columns": lambda s, d: _tables(s, d).select("table_id", "column_name"), "catalog_search": catalog_search, "catalog_search_path": catalog_search_path,
        "quality_precision_recall": quality_precision_recall, "quality_gaps": quality_gaps, "coverage_pivot": coverage_pivot, "coverage_totals": coverage_totals, "unknown_rate": unknown_rate,
        "fingerprints": fingerprints, "incremental_actions": incremental_actions, "openlineage_fields": openlineage_fields, "mermaid_edges": mermaid_edges,
        "statement_split": statement_split, "format_sql": format_sql, "convert_sql": convert_sql, "validate_sql": validate_sql, "ast_diff": ast_diff, "ast_search": ast_search,
        "lineage_numbered": lineage_numbered, "format_scripts": format_scripts, "validate_scripts": validate_scripts, "shared_sources": shared_sources,
        "model_json": model_json, "format_json": format_json, "validate_json": validate_json, "matrix_lines": matrix_lines, "quality_lines": quality_report_lines,
        "convert_cases": convert_cases, "ast_diff_summary": ast_diff_summary, "span_overlaps": span_overlaps,
    }
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: _golden(rows) for name, (_, rows) in STATEMENTS.items()}
    out |= {name: DUCK.get(name, re.sub(r"\{(\w+)\}", r"\1", sql)) for name, sql in EXECUTED.items()}
    undirected = "SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e"
    out |= {
        "impact_downstream": _reach(KEY_SQL, "r1"), "impact_upstream": _reach(KEY_SQL, "o1", "u"), "impact_both": _reach(CYCLE_SQL, "p1", "b"),
        "impact_depth2": _reach(KEY_SQL, "r1", "d", 2), "impact_unknown_origin": _reach(KEY_SQL, "zz"),
        "impact_truncated": f"WITH r AS ({_reach(KEY_SQL, 'r1', 'd', 3)}) SELECT 'r1' AS id, 2::INTEGER AS depth, count(*) FILTER (distance = 3) > 0 AS truncated FROM r",
        "shortest_path_lex": f"""WITH RECURSIVE e AS ({CYCLE_SQL}), s AS MATERIALIZED (SELECT DISTINCT a, b FROM ({undirected})), far AS MATERIALIZED ({_reach(CYCLE_SQL, "p160", "b")}),
r AS (SELECT 0 AS step, 'p150' AS id, (SELECT distance FROM far WHERE id = 'p150') AS rest
  UNION ALL SELECT r.step + 1, (SELECT min(s.b) FROM s JOIN far ON far.id = s.b WHERE s.a = r.id AND far.distance = r.rest - 1), r.rest - 1 FROM r WHERE r.rest > 0)
SELECT step, id FROM r WHERE rest IS NOT NULL""",
        "cycles_scc": _CLOSURE + """, c AS (SELECT n.id, min(CASE WHEN x.b IS NOT NULL THEN r.b ELSE n.id END) AS m0, n.id AS self FROM n LEFT JOIN r ON r.a = n.id LEFT JOIN r x ON x.a = r.b AND x.b = n.id GROUP BY n.id),
k AS (SELECT id, least(id, m0) AS component FROM c)
SELECT component, count(*) AS size, bool_or(EXISTS (SELECT 1 FROM s WHERE s.src = k.id AND s.dst = k.id)) AS self_loop, string_agg(id, ',' ORDER BY id) AS members FROM k GROUP BY component
HAVING count(*) > 1 OR bool_or(EXISTS (SELECT 1 FROM s WHERE s.src = k.id AND s.dst = k.id))""",
        "strong_components": _CLOSURE + ", c AS (SELECT n.id, min(CASE WHEN x.b IS NOT NULL THEN r.b ELSE n.id END) AS m0 FROM n LEFT JOIN r ON r.a = n.id LEFT JOIN r x ON x.a = r.b AND x.b = n.id GROUP BY n.id) SELECT id, least(id, m0) AS component FROM c",
        "cycles_listed": _CLOSURE + """, c AS (SELECT n.id, min(CASE WHEN x.b IS NOT NULL THEN r.b ELSE n.id END) AS m0 FROM n LEFT JOIN r ON r.a = n.id LEFT JOIN r x ON x.a = r.b AND x.b = n.id GROUP BY n.id)
SELECT least(id, m0) AS first, count(*) AS size, string_agg(id, ',' ORDER BY id) AS members FROM c GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT src, 1, src FROM s WHERE src = dst""",
        "self_loops": f"SELECT DISTINCT src FROM ({CYCLE_SQL}) WHERE src = dst",
        "graph_merge_dedupe": f"SELECT src, dst, kind, transform, min(seq) AS seq FROM ({CYCLE_SQL}) GROUP BY ALL",
        "in_out_degree": f"SELECT id, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming FROM (SELECT src AS id, 1 AS o, 0 AS i FROM ({KEY_SQL}) UNION ALL SELECT dst, 0, 1 FROM ({KEY_SQL})) GROUP BY id",
        "edges_by_kind": f"SELECT kind, count(*) AS n FROM ({KEY_SQL}) GROUP BY kind",
        "edge_filter_traverse": _reach(f"SELECT * FROM ({KEY_SQL}) WHERE kind IN ('OUTPUT', 'JOIN_KEY')", "r2"),
        "subgraph_edges": f"WITH q AS ({_reach(KEY_SQL, 'n3')}) SELECT src, dst, kind, transform FROM ({KEY_SQL}) WHERE src IN (SELECT id FROM q) AND dst IN (SELECT id FROM q)",
        "collapse_tables": f"SELECT src, dst, kind, transform FROM ({KEY_SQL}) WHERE src NOT LIKE 's%' AND dst NOT LIKE 's%'",
        "ownership_edges": "SELECT DISTINCT 'own:region.k' || n_regionkey AS id, 'table:region' AS src, 'region.k' || n_regionkey AS dst FROM nation",
        "layout_depth": f"WITH RECURSIVE e AS ({KEY_SQL}), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r AS (SELECT id, 0 AS d FROM n UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON e.src = r.id) SELECT id, max(d)::INTEGER AS depth FROM r GROUP BY id",
        "layout_rows": f"SELECT id, depth, (row_number() OVER (PARTITION BY depth ORDER BY id) - 1)::INTEGER AS \"row\" FROM (WITH RECURSIVE e AS ({KEY_SQL}), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r AS (SELECT id, 0 AS d FROM n UNION SELECT e.dst, r.d + 1 FROM r JOIN e ON e.src = r.id) SELECT id, max(d)::INTEGER AS depth FROM r GROUP BY id)",
        "compat_matrix": "SELECT * FROM (VALUES ('a', 'mysql', 'tokens', true, 1::BIGINT, 0::BIGINT, false), ('b', 'postgresql', 'tokens', true, 2, 1, false), ('c', 'trino', 'tokens', false, 0, 0, true)) v(case_id, dialect, engine, ok, statements, unknowns, reason)",
        "convert_matrix": "SELECT * FROM (VALUES ('a', 'mysql>postgresql', true, 'SELECT \"a\" FROM \"t\" LIMIT 5'), ('a', 'mysql>oracle', true, 'SELECT \"a\" FROM \"t\" FETCH FIRST 5 ROWS ONLY'), ('b', 'postgresql>tsql', true, 'SELECT TOP (3) [a] FROM t;' || chr(10) || 'SELECT x FROM t, u'), ('c', 'trino>mysql', false, NULL)) v(case_id, pair, ok, sql)",
        "quality_by_feature": VERDICT_SQL + ", t AS (SELECT DISTINCT 'case' || n_regionkey AS case_id, c_mktsegment AS feature FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT feature, count(*) FILTER (verdict = 'tp') AS tp, count(*) FILTER (verdict = 'fp') AS fp, count(*) FILTER (verdict = 'fn') AS fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM v JOIN t USING (case_id) GROUP BY feature",
        "edge_lines": "SELECT 'e0  OUTPUT  t.a -> p  [EXPRESSION]  «a * 2»' AS line",
        "facts_summary": "SELECT * FROM (VALUES ('x', 1::BIGINT, 4::BIGINT, 0::BIGINT, 1::BIGINT, 1::BIGINT), ('y', 1, 2, 1, 0, 2)) v(source_file, statements, edges, unknowns, diagnostics, tables)",
        "capabilities": "SELECT 'tokens' AS engine, 11::BIGINT AS features, 10::BIGINT AS supported",
        "lineage_star_expand": f"SELECT table_name || '.' || column_name AS from_id, column_name AS to_id FROM ({_COLUMNS_SQL}) WHERE table_name IN ('nation', 'region')",
        "lineage_insert_by_schema": "SELECT * FROM (VALUES ('nation.n_nationkey', 'region.r_regionkey'), ('nation.n_name', 'region.r_name')) v(from_id, to_id)",
        "lineage_unknowns": "SELECT * FROM (VALUES ('column x matches no source'), ('column nosuch is not in table orders'), ('qualifier q matches no source')) v(reason)",
        "catalog_columns": f"SELECT table_name AS table_id, column_name FROM ({_COLUMNS_SQL})",
        "catalog_search": f"SELECT DISTINCT table_name AS table_id, table_name AS name FROM ({_COLUMNS_SQL}) WHERE table_name LIKE '%line%'",
        "catalog_search_path": "SELECT * FROM (VALUES ('orders', 'shop.orders'), ('shop.orders', 'shop.orders'), ('nation', NULL)) v(query, table_id)",
        "quality_precision_recall": VERDICT_SQL + " SELECT case_id, count(*) FILTER (verdict = 'tp') AS tp, count(*) FILTER (verdict = 'fp') AS fp, count(*) FILTER (verdict = 'fn') AS fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM v GROUP BY case_id",
        "quality_gaps": VERDICT_SQL + " SELECT case_id, from_id, to_id FROM v WHERE verdict = 'fn' AND from_id NOT IN (SELECT 'r' || r_regionkey FROM region WHERE r_name = 'ASIA')",
        "coverage_totals": "SELECT o_orderpriority AS dialect, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}' AND o_totalprice > 100000) AS \"{s}_ok\", count(*) FILTER (o_orderstatus = '{s}') AS \"{s}_total\"" for s in "FOP") + " FROM orders GROUP BY 1",
        "coverage_pivot": "SELECT o_orderpriority AS dialect, sum((o_totalprice > 100000)::INT) FILTER (o_orderstatus = 'F')::BIGINT AS \"F\", sum((o_totalprice > 100000)::INT) FILTER (o_orderstatus = 'O')::BIGINT AS \"O\" FROM orders GROUP BY 1",
        "unknown_rate": "SELECT count(*) FILTER (lang <> 'en') AS unknowns, sum(n_chars)::BIGINT AS \"references\", count(*) FILTER (lang <> 'en') / sum(n_chars) AS rate FROM documents",
        "fingerprints": "SELECT doc_id AS source_file, sha256('ctx' || chr(0) || text) AS fingerprint FROM documents",
        "incremental_actions": "WITH n AS (SELECT c_custkey AS k, c_name AS f FROM customer WHERE c_acctbal > 1000), o AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN c_name ELSE 'old' END AS f FROM customer WHERE c_mktsegment <> 'BUILDING') SELECT coalesce(n.k, o.k) AS source_file, CASE WHEN n.f IS NULL THEN 'remove' WHEN o.f IS NULL THEN 'add' WHEN n.f = o.f THEN 'reuse' ELSE 'replace' END AS action FROM n FULL JOIN o ON n.k = o.k",
        "openlineage_fields": "SELECT * FROM (VALUES ('name', 'customer', 'c_name', 'DIRECT', 'IDENTITY'), ('total', 'orders', 'o_totalprice', 'DIRECT', 'AGGREGATION'), ('name', 'orders', 'o_orderstatus', 'INDIRECT', 'FILTER'), ('total', 'orders', 'o_orderstatus', 'INDIRECT', 'FILTER'), ('name', 'customer', 'c_name', 'INDIRECT', 'GROUP_BY'), ('total', 'customer', 'c_name', 'INDIRECT', 'GROUP_BY')) v(output, \"table\", field, type, subtype)",
        "mermaid_edges": f"SELECT src, dst, string_agg(DISTINCT transform, ', ' ORDER BY transform) AS label FROM ({KEY_SQL}) GROUP BY src, dst",
        "statement_split": "SELECT * FROM (VALUES (0, 'SELECT', 0, 8), (1, 'INSERT', 38, 69), (2, 'SELECT', 72, 91)) v(statement_index, statement_kind, span_start, span_end)",
        "format_sql": "SELECT 'select a, count(*)' || chr(10) || 'from t' || chr(10) || 'where x in (' || chr(10) || '  select y' || chr(10) || '  from u' || chr(10) || ')' || chr(10) || 'group by a' AS text",
        "convert_sql": "SELECT * FROM (VALUES ('mysql', 'postgresql', 'SELECT \"a\" FROM \"t\" LIMIT 5', true), ('mysql', 'oracle', 'SELECT \"a\" FROM \"t\" FETCH FIRST 5 ROWS ONLY', true), ('postgresql', 'tsql', 'SELECT TOP (3) [a] FROM t', true), ('trino', 'mysql', NULL, false)) v(source, target, sql, ok)",
        "ast_diff": "SELECT * FROM (VALUES (0, 'changed', 'plain_select', 'SELECT a, b FROM t WHERE x = 1'), (1, 'same', 'select_item', 'a'), (2, 'same', 'column', 'a'), (3, 'removed', 'select_item', 'b'), (4, 'removed', 'column', 'b'), (5, 'same', 'table', 't'), (6, 'changed', 'where', 'x = 1'), (7, 'changed', 'binary_op', 'x = 1'), (8, 'same', 'column', 'x'), (9, 'changed', 'literal', '1')) v(ordinal, status, type, text)",
        "ast_search": "SELECT * FROM (VALUES (0, 'plain_select', true), (3, 'select_item', true), (4, 'function', true), (5, 'column', true)) v(node_id, type, hit)",
        "lineage_numbered": f"""WITH s AS (SELECT n_nationkey::VARCHAR AS source_file, 'c' || n_nationkey || ' + 1' AS x, 't' || n_regionkey AS t, 'c' || n_nationkey AS c, {NUMBERED} AS sql FROM nation)
SELECT source_file, 0 AS ordinal, 'e0' AS edge_id, t || '.' || c AS from_id, 'x' AS to_id, 'OUTPUT' AS kind, 'EXPRESSION' AS transform, x AS expression, 7 AS span_start, (7 + length(x))::INTEGER AS span_end FROM s
UNION ALL SELECT source_file, 1, 'e1', t, 'x', 'SOURCE', 'SOURCE', NULL, (length(sql) - length(t))::INTEGER, length(sql)::INTEGER FROM s""",
        "model_json": "SELECT n_nationkey::VARCHAR AS source_file, 'SELECT' AS kind, 't' || n_regionkey AS table_id, 'SELECT' AS scope, 'x' AS second, 'c' || n_nationkey || ' + 1' AS expression, 't' || n_regionkey AS source, '[]' AS unknowns, '[]' AS diagnostics FROM nation",
        "format_json": """SELECT n_nationkey::VARCHAR AS source_file, '{"engine":"tokens","sql":"select c' || n_nationkey || ', count(*)\\nfrom t' || n_regionkey || '\\nwhere a = 1\\ngroup by c' || n_nationkey || '","diagnostics":[]}' AS report FROM nation""",
        "validate_json": """SELECT n_nationkey::VARCHAR AS source_file, '{"engine":"tokens","diagnostics":[{"code":"tokens.validate_error","message":"column no' || n_nationkey || ' is not in table nation","span_start":17,"span_end":' || (21 + length(n_nationkey::VARCHAR)) || '}]}' AS report FROM nation""",
        "matrix_lines": "SELECT n_nationkey || '  ansi  tokens  ok, 1 statements, 0 unknowns' AS line FROM nation",
        "quality_lines": VERDICT_SQL + ", s AS (SELECT case_id, count(*) FILTER (verdict = 'tp') AS tp, count(*) FILTER (verdict = 'fp') AS fp, count(*) FILTER (verdict = 'fn') AS fn FROM v GROUP BY case_id) SELECT case_id || '  precision ' || CASE WHEN tp + fp = 0 THEN 'n/a' ELSE printf('%.2f%%', tp * 100.0 / (tp + fp)) END || '  recall ' || CASE WHEN tp + fn = 0 THEN 'n/a' ELSE printf('%.2f%%', tp * 100.0 / (tp + fn)) END AS line FROM s",
        "format_scripts": "SELECT n_nationkey::VARCHAR AS source_file, 'select c' || n_nationkey || ', count(*)' || chr(10) || 'from t' || n_regionkey || chr(10) || 'where a = 1' || chr(10) || 'group by c' || n_nationkey AS text FROM nation",
        "validate_scripts": "SELECT n_nationkey::VARCHAR AS source_file, 0 AS ordinal, 'tokens.validate_error' AS code, 'column no' || n_nationkey || ' is not in table nation' AS message, 17 AS span_start, (21 + length(n_nationkey::VARCHAR))::INTEGER AS span_end FROM nation",
        "shared_sources": f"""SELECT CASE WHEN n_regionkey > 0 THEN n_regionkey::VARCHAR END AS source_file, table_name || '.' || column_name AS from_id, count(*) AS n
FROM nation JOIN ({_COLUMNS_SQL}) ON table_name = CASE WHEN n_nationkey % 2 = 0 THEN 'region' ELSE 'nation' END GROUP BY ALL""",
        "convert_cases": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in row) + ")" for row in CONVERSIONS) + ") v(source, target, sql, converted)",
        "ast_diff_summary": """SELECT n_nationkey::VARCHAR AS id, 0::BIGINT AS added, CASE WHEN n_regionkey = 0 THEN 0 ELSE 2 END::BIGINT AS removed, CASE n_regionkey WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 4 END::BIGINT AS changed,
CASE n_regionkey WHEN 0 THEN 0 WHEN 1 THEN 7 ELSE 4 END::BIGINT AS same, CASE WHEN n_regionkey = 0 THEN 1 ELSE 0 END::BIGINT AS error FROM nation""",
        "span_overlaps": "SELECT source_file, span_start, count(*) AS n FROM (SELECT o_orderstatus AS source_file, ({0})::INT AS span_start, ({0} + {1})::INT AS e FROM orders) a JOIN (SELECT o_orderstatus AS f, {2} AS s2, {2} + {3} AS e2 FROM orders) b ON f = source_file AND span_start < e AND s2 < e2 AND span_start < e2 AND s2 < e GROUP BY ALL".format(*SPANS[0], *SPANS[1]),
        "validate_sql": "SELECT * FROM (VALUES ('column nosuch is not in table orders', 7, 15), ('table missing is not found', 45, 52)) v(message, span_start, span_end)",
    }
    return out
