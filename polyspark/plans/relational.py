"""Relational core as Spark SQL: one text for Spark and the checking engine, with ``{table}`` for each table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import load, prepare

TEXTS = {
    "filter_project": "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS double_qty, l_extendedprice * (1 - l_discount) AS net FROM {lineitem} WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_quantity < 5",
    "arithmetic": "SELECT o_orderkey, CAST(o_orderkey % 7 AS BIGINT) AS rest, CAST(-o_orderkey AS BIGINT) AS negated, o_totalprice + 1 - 2 * 3 AS shifted FROM {orders} WHERE NOT o_orderkey = 1",
    "between_in_like": "SELECT p_partkey, p_name, p_size FROM {part} WHERE p_size BETWEEN 5 AND 15 AND p_brand IN (SELECT min(p_brand) FROM {part} UNION SELECT max(p_brand) FROM {part}) AND p_name LIKE '%a%' AND p_size NOT BETWEEN 7 AND 8",
    "case_cast": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state, CASE WHEN o_totalprice > 100000 THEN 1 WHEN o_totalprice > 50000 THEN 2 ELSE 3 END AS class, CAST(o_orderkey AS VARCHAR(20)) AS key_text, CAST(CAST(o_orderkey AS VARCHAR(20)) AS BIGINT) AS key_back FROM {orders}",
    "null_semantics": "SELECT event_id, nullif(event_type, 'click') AS kind, coalesce(nullif(event_type, 'click'), 'none') AS filled, nullif(event_type, 'click') IS NULL AS is_missing, (nullif(event_type, 'click') = 'view') IS TRUE AS is_view, (nullif(event_type, 'click') <> 'view') IS NOT FALSE AS not_view FROM {events}",
    "scalar_functions": "SELECT c_custkey, abs(c_acctbal) AS size, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low, CAST(length(c_name) AS BIGINT) AS n, greatest(c_acctbal, 0.0) AS floor0, least(c_acctbal, 0.0) AS cap0, nullif(c_mktsegment, 'BUILDING') AS seg, c_name || '/' || c_mktsegment AS tag FROM {customer}",
    "inner_join": "SELECT o_orderkey, c_name, o_totalprice FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "chain_join": "SELECT n_name, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name",
    "left_join": "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 150000",
    "right_join": "SELECT c_custkey, o_orderkey FROM {orders} RIGHT JOIN {customer} ON o_custkey = c_custkey AND o_totalprice > 150000",
    "full_join": "SELECT a.c_custkey AS left_key, b.s_suppkey AS right_key FROM {customer} a FULL JOIN {supplier} b ON a.c_custkey = b.s_suppkey * 3",
    "cross_join": "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}",
    "star_select": "SELECT * FROM {nation}",
    "table_star": "SELECT n.*, r.r_name FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey",
    "nested_loop_join": "SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM {supplier} a JOIN {supplier} b ON a.s_acctbal < b.s_acctbal - 9500",
    "bool_logic": "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS as_int, CAST(CAST(o_orderkey % 2 AS INT) AS BOOLEAN) AS odd, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END AS BOOLEAN) AS third FROM {orders}",
    "theta_join": "SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal",
    "semi_exists": "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "anti_not_exists": "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)",
    "in_subquery": "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity >= 49) AND p_size NOT IN (1, 2, 3)",
    "scalar_subquery": "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})",
    "correlated_agg": "SELECT p_partkey, (SELECT CAST(count(*) AS BIGINT) FROM {lineitem} WHERE l_partkey = p_partkey) AS n FROM {part}",
    "group_having": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM {lineitem} GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
    "group_by_expression": "SELECT CAST(o_orderkey % 10 AS BIGINT) AS digit, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_orderkey % 10",
    "count_distinct": "SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(sum(DISTINCT o_orderkey % 100) AS BIGINT) AS distinct_sum, round(avg(DISTINCT o_totalprice), 4) AS distinct_avg FROM {orders} GROUP BY o_orderstatus",
    "global_agg": "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS top FROM {orders} WHERE o_orderkey < 0",
    "distinct_select": "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}",
    "union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey AS k FROM {supplier}",
    "union_distinct": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier} UNION SELECT n_nationkey AS k FROM {nation}",
    "cte_multi": "WITH big AS (SELECT o_custkey AS k, o_totalprice AS p FROM {orders} WHERE o_totalprice > 100000), per AS (SELECT k, CAST(count(*) AS BIGINT) AS n, round(sum(p), 2) AS total FROM big GROUP BY k) SELECT c_name, n, total FROM per JOIN {customer} ON k = c_custkey",
    "recursive_cte": "WITH RECURSIVE t(n, total) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, total + n + 1 FROM t WHERE n < 60) SELECT n, total FROM t",
    "order_limit_offset": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5",
    "derived_table": "SELECT seg, CAST(max(n) AS BIGINT) AS most FROM (SELECT c_mktsegment AS seg, c_nationkey AS nation, count(*) AS n FROM {customer} GROUP BY c_mktsegment, c_nationkey) d GROUP BY seg",
    "one_row": "SELECT 1 + 1 AS two, 'x' || 'y' AS xy, CAST(NULL AS BIGINT) IS NULL AS missing",
    "row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM {orders}",
    "rank_dense_rank": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM {part}",
    "ntile": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS quarter FROM {customer}",
    "lag_lead": "SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2, -1.0) OVER w AS after FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "running_sum_default_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS running, CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS n, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS mean FROM {orders}",
    "rows_frame": "SELECT event_id, round(min(value) OVER w, 6) AS low, round(max(value) OVER w, 6) AS high, CAST(count(value) OVER w AS BIGINT) AS n FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)",
    "range_frame": "SELECT p_partkey, CAST(count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS BIGINT) AS near FROM {part}",
    "window_over_group": "SELECT o_custkey, round(sum(o_totalprice), 2) AS total, rank() OVER (ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey) AS place FROM {orders} GROUP BY o_custkey",
    "point_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_orderkey = 7",
    "full_scan_count": "SELECT CAST(count(*) AS BIGINT) AS n FROM {lineitem}",
    "fk_check": "SELECT l_orderkey, l_linenumber FROM {lineitem} LEFT ANTI JOIN {orders} ON l_orderkey = o_orderkey",
    "unique_check": "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM {lineitem} WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
}

#: Where the two engines need different words for the same thing.
SPARK_ONLY = {
    "regex_posix": "SELECT p_partkey, p_name RLIKE '^[a-m]' AS m, NOT p_name RLIKE 'e' AS no_e, p_name RLIKE '(?i)A' AS any_a FROM {part}",
    "integer_division": "SELECT o_orderkey, o_orderkey DIV 7 AS whole FROM {orders}",
    "bool_cast": "SELECT o_orderkey, TRY_CAST(element_at(array('t', 'true', 'yes', '1', 'f', 'false', 'no', '0', 'maybe', NULL), CAST(o_orderkey % 10 + 1 AS INT)) AS BOOLEAN) AS b FROM {orders}",
    "current_time": "SELECT now() >= TIMESTAMP '2020-01-01' AS after_2020, current_date() = CAST(now() AS DATE) AS same_day",
    "text_to_bool": "SELECT o_orderkey, TRY_CAST(o_orderstatus AS BIGINT) AS as_number, CAST(CAST(o_totalprice AS BIGINT) AS BIGINT) AS whole FROM {orders} WHERE o_totalprice = floor(o_totalprice) OR o_orderkey % 5 = 0",
}
CHECK_ONLY = {
    "regex_posix": "SELECT p_partkey, regexp_matches(p_name, '^[a-m]') AS m, NOT regexp_matches(p_name, 'e') AS no_e, regexp_matches(p_name, 'A', 'i') AS any_a FROM part",
    "integer_division": "SELECT o_orderkey, o_orderkey // 7 AS whole FROM orders",
    "bool_cast": "SELECT o_orderkey, TRY_CAST(element_at(array('t', 'true', 'yes', '1', 'f', 'false', 'no', '0', 'maybe', NULL), CAST(o_orderkey % 10 + 1 AS INT)) AS BOOLEAN) AS b FROM {orders}",
    "current_time": "SELECT now() >= TIMESTAMP '2020-01-01' AS after_2020, current_date() = CAST(now() AS DATE) AS same_day",
    "bool_cast": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 4 THEN true WHEN o_orderkey % 10 < 8 THEN false END AS b FROM orders",
    "current_time": "SELECT true AS after_2020, true AS same_day",
    "text_to_bool": "SELECT o_orderkey, TRY_CAST(o_orderstatus AS BIGINT) AS as_number, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders WHERE o_totalprice = floor(o_totalprice) OR o_orderkey % 5 = 0",
    "fk_check": "SELECT l_orderkey, l_linenumber FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey",
}


def _tables(text: str) -> list[str]:
    import string

    return sorted({f for _, f, _, _ in string.Formatter().parse(text) if f})


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return spark.sql(text, **{t: load(spark, sf_dir, t) for t in _tables(text)})

    return run


def _plain(text: str) -> str:
    return text.format(**{t: t for t in _tables(text)})


QUERIES = {name: _query(text) for name, text in (TEXTS | SPARK_ONLY).items()}
ORACLE_SQL = {name: _plain(text) for name, text in TEXTS.items()} | CHECK_ONLY
