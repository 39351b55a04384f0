"""Relational queries that users run over tables beside a vault; one SQL text for both engines where dialects agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels")
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
        return spark.sql(text, **tables)

    QUERIES[name], ORACLES[name] = run, (oracle or text).replace("{", "").replace("}", "")


_sql("join_inner", "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name")
_sql("join_left", "SELECT c_custkey, count(o_orderkey) AS orders FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey")
_sql("join_full", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} WHERE s_acctbal > 0 GROUP BY 1) b ON a.k = b.k")
_sql("join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 150000)")
_sql("join_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
_sql("pricing_summary", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= timestamp '1998-09-02 00:00:00' GROUP BY 1, 2")
_sql("cube_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) + 2 * grouping(o_orderpriority) AS g FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("rollup_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_sql("window_rank", "SELECT * FROM (SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}) t WHERE r <= 2")
_sql("window_frame", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM {orders}")
_sql("window_lag", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM {events}")
_sql("set_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}")
_sql("set_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier}")
_sql("set_except", "SELECT p_partkey AS k FROM {part} EXCEPT SELECT l_partkey AS k FROM {lineitem} WHERE l_quantity > 40")
_sql("subquery_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT 1.8 * avg(o_totalprice) FROM {orders})")
_sql("subquery_correlated", "SELECT l_orderkey, l_linenumber FROM {lineitem} l JOIN (SELECT l_partkey AS pk, avg(l_quantity) AS q FROM {lineitem} GROUP BY 1) a ON a.pk = l.l_partkey WHERE l_quantity < 0.2 * q")
_sql("topk_orders", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_sql("page_orders", "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 25 OFFSET 100")
_sql("having_filter", "SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > 10")
_sql("recursive_chain", "WITH RECURSIVE t(n, s) AS (SELECT 1 AS n, CAST(0 AS BIGINT) AS s UNION ALL SELECT n + 1, s + n FROM t WHERE n < 60) SELECT n, s FROM t")
_sql("json_props", "SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k FROM {events} GROUP BY event_type", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type")
_sql("asof_orders", "SELECT c.c_custkey, max_by(o.o_orderkey, struct(o.o_orderdate, o.o_orderkey)) AS last_order FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey AND o.o_orderdate <= timestamp '1996-01-01 00:00:00' GROUP BY 1", "SELECT c_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderdate <= timestamp '1996-01-01 00:00:00' GROUP BY 1")
_sql("range_price_band", "SELECT CAST(floor(p_retailprice / 100) AS BIGINT) AS band, count(*) AS n FROM {part} WHERE p_retailprice BETWEEN 900 AND 1500 GROUP BY 1")
_sql("percentiles", "SELECT o_orderpriority, round(percentile(o_totalprice, 0.5), 2) AS p50, round(percentile(o_totalprice, 0.95), 2) AS p95 FROM {orders} GROUP BY 1", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 2) AS p50, round(quantile_cont(o_totalprice, 0.95), 2) AS p95 FROM orders GROUP BY 1")
_sql("pivot_status", "SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'O') AS o, count_if(o_orderstatus = 'P') AS p FROM {orders} GROUP BY 1", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
