"""Relational queries as SQL text that Spark runs; DuckDB runs the same text unless another is given.

Money is summed as decimals, so results do not depend on the order of rows; counts,
ranks and lengths are cast, as engines differ in their types.
"""

from __future__ import annotations

P = "CAST(l_extendedprice AS DECIMAL(18,2))"
D = "CAST(l_discount AS DECIMAL(4,2))"
T = "CAST(l_tax AS DECIMAL(4,2))"
Q = "CAST(l_quantity AS DECIMAL(18,2))"
REV = f"{P} * (1 - {D})"
O = "CAST(o_totalprice AS DECIMAL(18,2))"  # noqa: E741


def dbl(e: str) -> str:
    return f"CAST({e} AS DOUBLE)"


def big(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


#: name -> SQL, or (Spark SQL, DuckDB SQL)
SQL: dict[str, str | tuple[str, str]] = {}

SQL["tpch_q01"] = f"""
SELECT l_returnflag, l_linestatus, {dbl(f'sum({Q})')} AS sum_qty, {dbl(f'sum({P})')} AS sum_base_price, {dbl(f'sum({REV})')} AS sum_disc_price,
  {dbl(f'sum({REV} * (1 + {T}))')} AS sum_charge, {dbl(f'sum({Q})')} / count(*) AS avg_qty, {dbl(f'sum({P})')} / count(*) AS avg_price,
  {dbl(f'sum({D})')} / count(*) AS avg_disc, {big('count(*)')} AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""
#: Spark's text with money of 12 digits, so that a discounted price keeps 18 and stays a long.
SQL["tpch_q01"] = (SQL["tpch_q01"].replace("DECIMAL(18,2)", "DECIMAL(12,2)"), SQL["tpch_q01"])
SQL["tpch_q03"] = f"""
SELECT l_orderkey, {dbl(f'sum({REV})')} AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10"""
SQL["tpch_q04"] = f"""
SELECT o_orderpriority, {big('count(*)')} AS order_count FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-10-01 00:00:00'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_returnflag = 'R')
GROUP BY o_orderpriority ORDER BY o_orderpriority"""
SQL["tpch_q05"] = (
    f"""
SELECT n_name, {dbl(f'sum({REV})')} AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON c_custkey = o_custkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = n_nationkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00' GROUP BY n_name ORDER BY revenue DESC""",
    f"""
SELECT n_name, {dbl(f'sum({REV})')} AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1999-01-01 00:00:00' GROUP BY n_name ORDER BY revenue DESC""",
)
SQL["tpch_q06"] = f"""
SELECT {dbl(f'sum({P} * {D})')} AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1998-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"""
SQL["tpch_q07"] = (
    f"""
SELECT supp_nation, cust_nation, l_year, {dbl('sum(volume)')} AS revenue FROM (
  SELECT s.n_name AS supp_nation, c.n_name AS cust_nation, {big('extract(year FROM l_shipdate)')} AS l_year, {REV} AS volume
  FROM (SELECT s_suppkey, n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_2')) s JOIN lineitem ON s_suppkey = l_suppkey
    JOIN (SELECT o_orderkey, n_name FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON c_custkey = o_custkey WHERE n_name IN ('NATION_1', 'NATION_2')) c ON o_orderkey = l_orderkey
  WHERE s.n_name <> c.n_name) t
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    f"""
SELECT supp_nation, cust_nation, l_year, {dbl('sum(volume)')} AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, {big('extract(year FROM l_shipdate)')} AS l_year, {REV} AS volume
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
  WHERE ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))) s
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
)
SQL["tpch_q08"] = f"""
SELECT o_year, {dbl("sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END)")} / {dbl('sum(volume)')} AS mkt_share FROM (
  SELECT {big('extract(year FROM o_orderdate)')} AS o_year, {REV} AS volume, n2.n_name AS nation
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
  WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY') s GROUP BY o_year ORDER BY o_year"""
SQL["tpch_q09"] = f"""
SELECT nation, o_year, {dbl('sum(amount)')} AS sum_profit FROM (
  SELECT n_name AS nation, {big('extract(year FROM o_orderdate)')} AS o_year, {REV} - CAST(p_retailprice AS DECIMAL(18,2)) * {Q} AS amount
  FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
  WHERE p_name LIKE '%widget%') s GROUP BY nation, o_year ORDER BY nation, o_year DESC"""
SQL["tpch_q10"] = f"""
SELECT c_custkey, c_name, {dbl(f'sum({REV})')} AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
  JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1997-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20"""
SQL["tpch_q13"] = f"""
SELECT c_count, {big('count(*)')} AS custdist FROM (
  SELECT c_custkey, {big('count(o_orderkey)')} AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) c
GROUP BY c_count ORDER BY custdist DESC, c_count DESC"""
SQL["tpch_q14"] = f"""
SELECT 100 * {dbl(f"sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REV} ELSE 0 END)")} / {dbl(f'sum({REV})')} AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-10-01 00:00:00'"""
SQL["tpch_q15"] = f"""
WITH revenue AS (SELECT l_suppkey AS supplier_no, sum({REV}) AS total_revenue FROM lineitem
  WHERE l_shipdate >= TIMESTAMP '1997-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-04-01 00:00:00' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, {dbl('total_revenue')} AS total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no
WHERE total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey"""
SQL["tpch_q17"] = (
    f"""
WITH l AS (SELECT l_partkey, l_quantity, l_extendedprice FROM part JOIN lineitem ON p_partkey = l_partkey WHERE p_brand = 'Brand#12'),
m AS (SELECT l_partkey AS k, 0.2E0 * {dbl('sum(CAST(l_quantity AS DECIMAL(18,2)))')} / count(*) AS least FROM l GROUP BY l_partkey)
SELECT {dbl(f'sum({P})')} / 7.0E0 AS avg_yearly FROM l JOIN m ON l_partkey = k WHERE l_quantity < least""",
    f"""
SELECT {dbl(f'sum({P})')} / 7.0E0 AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#12' AND l_quantity < (SELECT 0.2E0 * {dbl('sum(CAST(i.l_quantity AS DECIMAL(18,2)))')} / count(*) FROM lineitem i WHERE i.l_partkey = p_partkey)""",
)
SQL["tpch_q18"] = f"""
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, {dbl(f'sum({Q})')} AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100"""
SQL["tpch_q19"] = f"""
SELECT {dbl(f'sum({REV})')} AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE
  (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
  OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)"""
SQL["tpch_q21"] = (
    f"""
WITH o AS (SELECT l_orderkey AS k, min(l_suppkey) AS a, max(l_suppkey) AS b, min(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS ra, max(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS rb FROM lineitem GROUP BY l_orderkey)
SELECT s_name, {big('count(*)')} AS numwait FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN lineitem ON s_suppkey = l_suppkey
  JOIN o ON k = l_orderkey JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderstatus = 'F' AND l_returnflag = 'R' AND n_name = 'NATION_5' AND a <> b AND ra = rb
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    f"""
SELECT s_name, {big('count(*)')} AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE o_orderstatus = 'F' AND l1.l_returnflag = 'R' AND n_name = 'NATION_5'
  AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
)
SQL["tpch_q22"] = f"""
SELECT code, {big('count(*)')} AS numcust, {dbl('sum(CAST(c_acctbal AS DECIMAL(18,2)))')} AS totacctbal FROM (
  SELECT substring(c_mktsegment, 1, 2) AS code, c_acctbal, c_custkey FROM customer
  WHERE substring(c_mktsegment, 1, 2) IN ('BU', 'MA', 'AU') AND c_acctbal > (SELECT {dbl('sum(CAST(c_acctbal AS DECIMAL(18,2)))')} / count(*) FROM customer WHERE c_acctbal > 0)) c
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY code ORDER BY code"""

# joins
SQL["join_inner"] = f"SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000"
SQL["join_left"] = f"SELECT c_custkey, {big('count(o_orderkey)')} AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY c_custkey"
SQL["join_full"] = """
WITH a AS (SELECT c_custkey AS k, c_name FROM customer WHERE c_acctbal > 0), b AS (SELECT o_custkey AS k, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)
SELECT coalesce(a.k, b.k) AS k, c_name, top FROM a FULL OUTER JOIN b ON a.k = b.k"""
SQL["join_semi"] = "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"
SQL["join_anti"] = "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"


def not_in(select: str, key: str, inner: str, column: str) -> tuple[str, str]:
    """``key NOT IN`` of a query's one column, for Spark as an anti join of distinct keys: its own null-aware join sends all of them to the driver.

    A null among the keys, or a null key beside any, makes NOT IN unknown.
    """
    spark = f"""WITH inside AS ({inner}), seen AS (SELECT count(*) AS n, count({column}) AS known FROM inside)
{select} CROSS JOIN seen WHERE (n = 0 OR n = known AND {key} IS NOT NULL)
AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT {column} FROM inside WHERE {column} IS NOT NULL) k WHERE k.{column} = {key})"""
    return spark, f"{select} WHERE {key} NOT IN ({inner})"


SQL["join_not_in"] = not_in("SELECT s_suppkey FROM supplier", "s_suppkey", "SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09", "l_suppkey")
_WITH_NULLS = "SELECT CASE WHEN l_linenumber = 1 THEN NULL ELSE l_suppkey END FROM lineitem"
SQL["join_not_in_null"] = not_in("SELECT s_suppkey FROM supplier", "s_suppkey", _WITH_NULLS, "supplied")
SQL["join_not_in_null"] = (SQL["join_not_in_null"][0].replace("END FROM", "END AS supplied FROM"), SQL["join_not_in_null"][1])
SQL["join_cross"] = f"SELECT r_name, n_name FROM region CROSS JOIN nation"
SQL["join_theta"] = f"""
SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"""
SQL["join_self"] = f"""
WITH m AS (SELECT user_id, {big("extract(day FROM ts)")} AS d, {big('count(*)')} AS n FROM events GROUP BY user_id, {big("extract(day FROM ts)")})
SELECT a.user_id, a.d, a.n, b.n AS n_before FROM m a JOIN m b ON a.user_id = b.user_id AND a.d = b.d + 1"""
#: Spark makes a window without an order of a lateral LIMIT, over rows that a shuffle has mixed; the order is within the window here.
SQL["join_lateral_topk"] = (
    "SELECT c_custkey, o_orderkey FROM customer JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST) AS n FROM orders) t ON o_custkey = c_custkey WHERE n = 1",
    "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t",
)
SQL["join_lookup"] = f"SELECT event_id, event_type, w.weight FROM events JOIN (VALUES ('view', 1), ('click', 2), ('purchase', 5)) AS w(kind, weight) ON event_type = w.kind"
SQL["join_stream_interval"] = """
SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts - INTERVAL '2' HOUR AND a.ts + INTERVAL '2' HOUR"""

# aggregates
SQL["agg_count_distinct"] = f"SELECT l_returnflag, {big('count(DISTINCT l_suppkey)')} AS n FROM lineitem GROUP BY l_returnflag"
SQL["agg_multi_distinct"] = f"SELECT {big('count(DISTINCT user_id)')} AS users, {big('count(DISTINCT event_type)')} AS kinds, {big('count(*)')} AS n FROM events"
SQL["agg_rollup"] = f"SELECT l_returnflag, l_linestatus, {big('count(*)')} AS n, {dbl(f'sum({Q})')} AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"
SQL["agg_cube"] = f"SELECT o_orderstatus, o_orderpriority, {big('count(*)')} AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"
SQL["agg_grouping_sets"] = f"SELECT o_orderstatus, o_orderpriority, {big('count(*)')} AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"
SQL["agg_grouping_fn"] = f"SELECT r_name, n_name, {big('grouping(r_name)')} + {big('grouping(n_name)')} AS lochierarchy, {big('count(*)')} AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)"
SQL["agg_having"] = f"SELECT o_custkey, {big('count(*)')} AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14"
SQL["agg_nested"] = f"SELECT n, {big('count(*)')} AS m FROM (SELECT o_custkey, {big('count(*)')} AS n FROM orders GROUP BY o_custkey) t GROUP BY n"
SQL["agg_stddev"] = f"SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_samp(value), 4) AS v FROM events GROUP BY event_type"
SQL["agg_case"] = f"SELECT event_type, {big('sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)')} AS high, {big('count(*) FILTER (WHERE value <= 50)')} AS low FROM events GROUP BY event_type"
SQL["agg_scalar"] = f"SELECT {dbl(f'sum({O})')} AS total, min(o_totalprice) AS low, max(o_totalprice) AS high, {big('count(*)')} AS n FROM orders"
SQL["agg_count_star_by_dict"] = f"SELECT l_returnflag, {big('count(*)')} AS n FROM lineitem GROUP BY l_returnflag"
SQL["agg_sum_by_key"] = f"SELECT l_orderkey, {dbl(f'sum({P})')} AS total, {dbl(f'sum({P})')} / count(*) AS mean FROM lineitem GROUP BY l_orderkey"
SQL["agg_fd_groupby"] = (
    f"SELECT c.c_custkey, c_name, c_acctbal, n FROM (SELECT o_custkey, {big('count(*)')} AS n FROM orders GROUP BY o_custkey) o JOIN customer c ON c.c_custkey = o.o_custkey",
    f"SELECT c_custkey, c_name, c_acctbal, {big('count(*)')} AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name, c_acctbal",
)
SQL["agg_first_last"] = (
    "SELECT user_id, min_by(event_type, ts) AS first_type, max_by(event_type, ts) AS last_type, max_by(value, ts) AS last_value FROM events GROUP BY user_id",
    "SELECT user_id, arg_min(event_type, ts) AS first_type, arg_max(event_type, ts) AS last_type, arg_max(value, ts) AS last_value FROM events GROUP BY user_id",
)
SQL["agg_group_by_expression"] = f"SELECT {big('extract(hour FROM ts)')} AS h, {big('count(*)')} AS n FROM events GROUP BY 1"
SQL["agg_wide_sums"] = "SELECT " + ", ".join(f"{big(f'sum(l_linenumber + {k})')} AS s{k}" for k in range(0, 90, 10)) + " FROM lineitem"

# windows
SQL["win_rank"] = f"SELECT o_orderkey, {big('rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC)')} AS r FROM orders"
SQL["win_dense_rank"] = f"SELECT event_id, {big('dense_rank() OVER (PARTITION BY user_id ORDER BY event_type)')} AS r FROM events"
SQL["win_row_number"] = f"SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n FROM events) t WHERE n <= 3"
SQL["win_ntile"] = f"SELECT c_custkey, {big('ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)')} AS q FROM customer"
SQL["win_lag_lead"] = "SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2, -1) OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
SQL["win_running_sum"] = f"SELECT o_orderkey, {dbl(f'sum({O}) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS s FROM orders"
SQL["win_running_max"] = "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM orders"
SQL["win_partition_avg"] = f"SELECT c_custkey, {dbl('sum(CAST(c_acctbal AS DECIMAL(18,2))) OVER (PARTITION BY c_nationkey)')} / count(*) OVER (PARTITION BY c_nationkey) AS mean FROM customer"
SQL["win_ratio"] = f"SELECT o_orderpriority, o_orderstatus, {dbl(f'sum({O})')} * 100 / {dbl(f'sum(sum({O})) OVER (PARTITION BY o_orderpriority)')} AS share FROM orders GROUP BY o_orderpriority, o_orderstatus"
SQL["win_range_frame"] = f"SELECT event_id, {big("count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW)")} AS n FROM events"
SQL["win_nested_rank"] = f"""
SELECT * FROM (SELECT p_brand, p_type, total, {big('rank() OVER (PARTITION BY p_brand ORDER BY total DESC)')} AS rk FROM (
  SELECT p_brand, p_type, {dbl(f'sum({P})')} AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ROLLUP (p_brand, p_type)) a) b WHERE rk <= 3"""

# sorting and limits
SQL["sort_multi"] = "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment ASC NULLS LAST, c_acctbal DESC NULLS LAST, c_custkey"
SQL["sort_topk"] = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"
SQL["limit_offset"] = "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 100"
SQL["sort_case"] = f"SELECT o_orderpriority, {big('count(*)')} AS n FROM orders GROUP BY o_orderpriority ORDER BY CASE WHEN o_orderpriority = '3-MEDIUM' THEN 0 ELSE 1 END, o_orderpriority"

# sets
for _name, _op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("except", "EXCEPT"), ("intersect_all", "INTERSECT ALL"), ("except_all", "EXCEPT ALL")):
    SQL[f"set_{_name}"] = f"SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 {_op} SELECT s_nationkey FROM supplier WHERE s_nationkey < 20"
SQL["cte"] = f"WITH t AS (SELECT o_custkey, {dbl(f'sum({O})')} AS s FROM orders GROUP BY o_custkey), u AS (SELECT * FROM t WHERE s > 1000000) SELECT {big('count(*)')} AS n, max(s) AS m FROM u"
SQL["recursive_cte"] = "WITH RECURSIVE r(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r"

# predicates and projections
SQL["filter_like"] = "SELECT p_partkey FROM part WHERE p_name LIKE 'small%' AND p_name NOT LIKE '%ring' AND p_type LIKE '%M%'"
SQL["filter_in_between"] = "SELECT p_partkey FROM part WHERE p_size IN (3, 7, 11) AND p_retailprice BETWEEN 900 AND 1000 AND NOT (p_brand = 'Brand#1' OR p_type = 'PROMO')"
SQL["filter_null_safe"] = (
    "SELECT event_id FROM events WHERE NOT (nullif(event_type, 'view') <=> nullif(event_type, 'click'))",
    "SELECT event_id FROM events WHERE nullif(event_type, 'view') IS DISTINCT FROM nullif(event_type, 'click')",
)
SQL["project_expressions"] = "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'few' END AS kind FROM lineitem"
SQL["select_distinct"] = "SELECT DISTINCT event_type, user_id % 4 AS g FROM events"

# scalar functions
SQL["fn_string"] = f"SELECT c_custkey, upper(substring(c_name, 1, 4)) AS u, lower(c_mktsegment) AS l, {big('length(c_name)')} AS n, trim(concat('  ', c_mktsegment, ' ')) AS t, replace(c_name, '#', '-') AS r FROM customer"
SQL["fn_regex"] = (
    r"SELECT p_partkey, regexp_replace(p_brand, '^Brand#([0-9])([0-9]*)$', '$2-$1') AS b FROM part",
    r"SELECT p_partkey, regexp_replace(p_brand, '^Brand#([0-9])([0-9]*)$', '\2-\1') AS b FROM part",
)
SQL["fn_date"] = f"SELECT event_id, {big('extract(year FROM ts)')} AS y, {big('extract(month FROM ts)')} AS m, {big('extract(minute FROM ts)')} AS mi, CAST(ts AS DATE) + INTERVAL '3' DAY > DATE '2024-01-10' AS late FROM events"
SQL["fn_date_trunc"] = (
    f"SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS h, {big('count(*)')} AS n FROM events GROUP BY 1",
    f"SELECT date_trunc('hour', ts) AS h, {big('count(*)')} AS n FROM events GROUP BY 1",
)
SQL["fn_math"] = "SELECT event_id, abs(value - 50) AS a, floor(value / 7) = ceil(value / 7) AS whole, sqrt(value * value) AS s, power(2, event_id % 10) AS p, event_id % 7 AS m FROM events"
SQL["fn_cond"] = "SELECT event_id, coalesce(nullif(event_type, 'view'), 'none') AS c, greatest(value, 50.0E0) AS g, least(value, 50.0E0) AS l, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS d FROM events"
SQL["fn_json"] = (
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
SQL["fn_array"] = (
    "SELECT event_id, pos, x FROM events LATERAL VIEW posexplode(array(event_id, user_id, event_id + 1)) t AS pos, x",
    "SELECT event_id, CAST(pos AS INTEGER) AS pos, x FROM (SELECT event_id, unnest([0, 1, 2]) AS pos, unnest([event_id, user_id, event_id + 1]) AS x FROM events)",
)
SQL["fn_struct_explode"] = (
    "SELECT user_id, s.kind, s.v FROM (SELECT user_id, explode(array(named_struct('kind', 'a', 'v', value), named_struct('kind', 'b', 'v', -value))) AS s FROM events)",
    "SELECT user_id, s.kind AS kind, s.v AS v FROM (SELECT user_id, unnest([{'kind': 'a', 'v': value}, {'kind': 'b', 'v': -value}]) AS s FROM events)",
)
SQL["fn_timestamp_seconds"] = (
    "SELECT event_id, CAST(timestamp_seconds(event_id * 60) AS TIMESTAMP_NTZ) AS t FROM events",
    "SELECT event_id, make_timestamp(event_id * 60 * 1000000) AS t FROM events",
)
# event-time windows over a finished table
SQL["evt_tumbling"] = (
    f"SELECT user_id, CAST(window.start AS TIMESTAMP_NTZ) AS window_start, {big('count(*)')} AS n, {dbl('sum(CAST(value AS DECIMAL(18,2)))')} AS s FROM events GROUP BY user_id, window(ts, '1 hour')",
    f"SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS window_start, {big('count(*)')} AS n, {dbl('sum(CAST(value AS DECIMAL(18,2)))')} AS s FROM events GROUP BY 1, 2",
)
SQL["evt_hopping"] = (
    f"SELECT event_type, CAST(window.start AS TIMESTAMP_NTZ) AS window_start, {big('count(*)')} AS n FROM events GROUP BY event_type, window(ts, '2 hours', '30 minutes')",
    f"SELECT event_type, time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS window_start, {big('count(*)')} AS n FROM events, (SELECT unnest(range(4)) AS k) GROUP BY 1, 2",
)
SQL["evt_session"] = (
    f"SELECT user_id, CAST(session_window.start AS TIMESTAMP_NTZ) AS window_start, max(ts) AS window_end, {big('count(*)')} AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')",
    f"""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, min(ts) AS window_start, max(ts) AS window_end, {big('count(*)')} AS n FROM g GROUP BY user_id, s""",
)
SQL["agg_grouping_id"] = f"SELECT l_returnflag, l_linestatus, {big('grouping_id(l_returnflag, l_linestatus)')} AS g, {big('count(*)')} AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"
SQL["agg_avg"] = f"SELECT l_suppkey, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY l_suppkey"
SQL["limit_any"] = f"SELECT {big('count(*)')} AS n FROM (SELECT l_orderkey FROM lineitem LIMIT 100) t"
