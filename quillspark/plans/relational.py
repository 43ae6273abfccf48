"""Relational SQL through the read-only SQL tool: the same statements run in Spark and DuckDB."""

from __future__ import annotations

from quillspark.operators import sqltool
from quillspark.tables import read

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SQL = {
    "sql_pricing_summary": """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue,
  round(avg(l_discount), 6) AS avg_disc, count(*) AS n_lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_join_views": """SELECT n_name, c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment""",
    "sql_shipping_priority": """SELECT o_orderkey, o_orderpriority, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey, o_orderpriority""",
    "sql_window": """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events""",
    "sql_setops": """SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0
EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "sql_recursive": """WITH RECURSIVE steps(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM steps WHERE n < 20) SELECT n, total FROM steps""",
    "sql_correlated": """SELECT p_partkey, p_brand, p_retailprice FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)""",
    "sql_exists": """SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""",
    "sql_filter_distinct": """SELECT user_id, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE value > 50) AS n_large FROM events GROUP BY user_id""",
    "sql_full_join": """SELECT coalesce(a.user_id, b.custkey) AS id, a.n AS n_events, b.n AS n_orders FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) a
FULL JOIN (SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY o_custkey) b ON a.user_id = b.custkey""",
    "sql_having_union": """SELECT 'supplier' AS kind, s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY s_nationkey HAVING count(*) > 1
UNION ALL SELECT 'customer', c_nationkey, count(*) FROM customer GROUP BY c_nationkey HAVING count(*) > 1""",
}


def _run(statement: str):
    def query(spark, sf_dir):
        """The statement over its whole tables, guarded as read-only; the tool's row cap is for callers, not for this."""
        own = spark.newSession()
        for t in TABLES:
            read(own, sf_dir, t).createOrReplaceTempView(t)
        text = sqltool.check_text(statement)
        sqltool.check_plan(own, text)
        return own.sql(text)

    return query


QUERIES = {name: _run(statement) for name, statement in SQL.items()}
