"""Scans, predicates, joins, aggregation, subqueries, set operations, ordering."""

from __future__ import annotations

from tidemill.plans.registry import dialect


def register() -> None:
    dialect(
        "flagship_revenue_by_nation",
        "SELECT n_name, sum(o_totalprice) AS revenue, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P' GROUP BY n_name HAVING count(*) > 10 ORDER BY revenue DESC, n_name LIMIT 10".replace("sum(o_totalprice)", "round(sum(o_totalprice), 2)"),
    )
    # -- scans, projection, predicates
    dialect("scan_filter_project", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000.0 AND o_orderstatus = 'F'")
    dialect("scan_star", "SELECT * FROM region")
    dialect("scan_alias_star", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
    dialect("one_row_source", "SELECT 1 + 2 AS a, 'x' AS b, NULL::int AS c", "SELECT 3::BIGINT AS a, 'x' AS b, NULL::BIGINT AS c")
    dialect("values_rows", "SELECT v.column1 AS id, v.column2 AS label FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) v", "SELECT id::BIGINT AS id, label FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) v(id, label)")
    dialect("filter_three_valued", "SELECT o_orderkey, (nullif(o_orderstatus, 'P') = 'F' OR o_totalprice > 300000.0) AS hit, NOT (nullif(o_orderstatus, 'P') = 'F') AS miss FROM orders")
    dialect("filter_is_null", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS NULL AND o_totalprice IS NOT NULL")
    dialect("filter_like_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget' OR p_brand ILIKE 'BRAND#1_'")
    dialect("filter_like_escape", "SELECT c_custkey, c_name FROM customer WHERE replace(c_name, '#', '%') LIKE 'Customer!%00000001_' ESCAPE '!' AND c_name NOT LIKE '%9'")
    dialect("filter_like_no_default_escape", r"SELECT count(*) AS n FROM customer WHERE replace(c_name, '#', '\') LIKE 'Customer\0000%'")
    dialect("filter_in_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A', 'R')")
    dialect("filter_not_in_list", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber NOT IN (1, 2, 3) AND l_quantity NOT BETWEEN 5 AND 45 GROUP BY l_returnflag")
    dialect("filter_in_with_null", "SELECT count(*) AS n FROM nation WHERE (n_nationkey IN (1, 2, NULL)) IS NULL")
    dialect("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice < 100000.0 THEN 'low' WHEN o_totalprice < 300000.0 THEN 'mid' END AS band FROM orders")
    dialect("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS status FROM orders")
    dialect(
        "arith_int_div_mod",
        "SELECT o_orderkey, o_orderkey / 7 AS d, o_orderkey % 7 AS m, o_orderkey / (o_orderkey - o_orderkey) AS z, -o_orderkey / 7 AS nd, o_totalprice / 0 AS rz FROM orders",
        "SELECT o_orderkey, o_orderkey // 7 AS d, o_orderkey % 7 AS m, NULL::BIGINT AS z, (-o_orderkey) // 7 AS nd, NULL::DOUBLE AS rz FROM orders",
    )
    dialect("arith_precedence", "SELECT c_custkey, 1 + 2 * c_custkey - 3 AS a, -(c_custkey - 5) AS b, round(c_acctbal * 1.5 + c_custkey, 3) AS r FROM customer", "SELECT c_custkey, 1 + 2 * c_custkey - 3 AS a, -(c_custkey - 5) AS b, round(c_acctbal * 1.5::DOUBLE + c_custkey, 3) AS r FROM customer")
    dialect("string_concat_op", "SELECT r_name || '-' || r_regionkey AS label, r_name || NULL AS nothing, 1 + 2 || 'x' AS loose FROM region", "SELECT r_name || '-' || r_regionkey::VARCHAR AS label, NULL::VARCHAR AS nothing, '3x' AS loose FROM region")
    dialect(
        "cast_forms",
        "SELECT l_orderkey, l_linenumber, l_extendedprice::int AS i, CAST(l_quantity AS TEXT) AS t, CAST('12' AS INTEGER) AS c, '1.7'::int AS r, l_linenumber::real AS f FROM lineitem",
        "SELECT l_orderkey, l_linenumber, (CASE WHEN l_extendedprice < 0 THEN -floor(-l_extendedprice + 0.5) ELSE floor(l_extendedprice + 0.5) END)::BIGINT AS i, CAST(l_quantity AS VARCHAR) AS t, 12::BIGINT AS c, 2::BIGINT AS r, l_linenumber::DOUBLE AS f FROM lineitem",
    )
    dialect("params_numbered", "SELECT o_orderkey, $2 AS tag FROM orders WHERE o_totalprice > $1 AND o_orderstatus = $2 ORDER BY o_orderkey LIMIT $3", "SELECT o_orderkey, 'F' AS tag FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 25", params=(100000.0, "F", 25))
    dialect("truth_of_numbers", "SELECT count(*) AS n FROM nation WHERE n_regionkey AND NOT (n_nationkey - 7)", "SELECT count(*) AS n FROM nation WHERE n_regionkey <> 0 AND n_nationkey = 7")
    # -- joins
    dialect("join_inner", "SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 450000.0")
    dialect("join_left", "SELECT o.o_orderkey, l.l_linenumber FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_quantity > 45")
    dialect("join_right", "SELECT r.r_name, n.n_name FROM nation n RIGHT OUTER JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_name LIKE '%1'")
    dialect("join_full", "SELECT a.n_nationkey AS left_key, b.s_suppkey AS right_key FROM nation a FULL OUTER JOIN supplier b ON a.n_nationkey = b.s_suppkey")
    dialect("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
    dialect("join_comma", "SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey")
    dialect("join_using", "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b USING (n_nationkey)")
    dialect("join_self", "SELECT a.n_name AS one, b.n_name AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
    dialect("join_theta_range", "SELECT n.n_name, count(*) AS suppliers FROM nation n JOIN supplier s ON s.s_acctbal BETWEEN n.n_nationkey * 300 AND n.n_nationkey * 300 + 1000 GROUP BY n.n_name")
    dialect("join_parenthesized", "SELECT c.c_custkey, r.r_name FROM customer c JOIN (nation n JOIN region r ON n.n_regionkey = r.r_regionkey) ON c.c_nationkey = n.n_nationkey")
    dialect(
        "join_multiway",
        "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE r_name = 'ASIA' GROUP BY r_name, n_name",
    )
    dialect("semi_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000.0)")
    dialect("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000.0)")
    dialect("anti_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000.0)")
    dialect("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000.0)")
    dialect("anti_not_in_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 5) FROM orders WHERE o_totalprice > 450000.0 OR o_custkey = 5)")
    dialect("subq_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9::DOUBLE FROM orders)")
    dialect("subq_scalar_empty", "SELECT n_name, (SELECT s_suppkey FROM supplier WHERE s_suppkey < 0) AS nobody FROM nation")
    dialect("subq_correlated_scalar", "SELECT c.c_custkey, (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c")
    dialect("subq_correlated_where", "SELECT c.c_custkey FROM customer c WHERE (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) >= 15")
    # -- aggregation
    dialect(
        "agg_global",
        "SELECT count(*) AS n, sum(l_linenumber) AS lines, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS first_day, max(l_returnflag) AS flag FROM lineitem",
        "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS lines, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS first_day, max(l_returnflag) AS flag FROM lineitem",
    )
    dialect(
        "agg_group",
        "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
    )
    dialect("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14 AND max(o_totalprice) > 400000.0")
    dialect("agg_having_alone", "SELECT count(*) AS n FROM nation HAVING count(*) > 3")
    dialect("agg_count_nullable", "SELECT n_regionkey, count(nullif(n_nationkey, 3)) AS n FROM nation GROUP BY n_regionkey")
    dialect("agg_distinct_count", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_linenumber) AS numbers FROM lineitem GROUP BY l_returnflag")
    dialect("agg_sum_distinct", "SELECT sum(DISTINCT l_linenumber) AS s, round(avg(DISTINCT l_quantity), 4) AS a, min(DISTINCT l_tax) AS lo, max(DISTINCT l_tax) AS hi FROM lineitem", "SELECT sum(DISTINCT l_linenumber)::BIGINT AS s, round(avg(DISTINCT l_quantity), 4) AS a, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem")
    dialect("agg_expr_key", "SELECT o_orderkey % 5 AS k, upper(o_orderstatus) AS s, count(*) AS n FROM orders GROUP BY o_orderkey % 5, upper(o_orderstatus)")
    dialect("agg_group_constant", "SELECT count(*) AS n FROM nation GROUP BY 1", "SELECT count(*) AS n FROM nation")
    dialect("agg_empty_input", "SELECT count(*) AS n, sum(n_nationkey) AS s, max(n_name) AS m, coalesce(json_agg(n_name), '[]') AS j FROM nation WHERE n_nationkey < 0", "SELECT count(*) AS n, NULL::BIGINT AS s, NULL::VARCHAR AS m, '[]' AS j FROM nation WHERE n_nationkey < 0")
    dialect("agg_first_of_group", "SELECT n.n_regionkey, r.r_name, count(*) AS n FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY n.n_regionkey", "SELECT n.n_regionkey, any_value(r.r_name) AS r_name, count(*) AS n FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY n.n_regionkey")
    dialect("agg_string_agg", "SELECT n_regionkey, string_agg(n_name, ';') AS names, group_concat(DISTINCT n_regionkey) AS keys FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names, n_regionkey::VARCHAR AS keys FROM nation GROUP BY n_regionkey")
    dialect("agg_json", "SELECT n_regionkey, json_agg(n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, to_json(list(n_name ORDER BY n_name))::VARCHAR AS names FROM nation GROUP BY n_regionkey")
    dialect("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
    # -- set operations
    arms = "SELECT n_nationkey AS k FROM nation", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal < 3000.0"
    for op in ("UNION", "UNION ALL", "INTERSECT", "INTERSECT ALL", "EXCEPT", "EXCEPT ALL"):
        dialect(op.lower().replace(" ", "_"), f"{arms[0]} {op} {arms[1]}" if not op.startswith("EXCEPT ALL") else f"{arms[1]} {op} {arms[0]}")
    dialect(
        "setop_left_assoc",
        "SELECT n_nationkey AS k FROM nation UNION SELECT c_custkey FROM customer INTERSECT SELECT s_suppkey FROM supplier",
        "(SELECT n_nationkey::BIGINT AS k FROM nation UNION SELECT c_custkey FROM customer) INTERSECT SELECT s_suppkey FROM supplier",
    )
    dialect("setop_order_limit", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region ORDER BY 1 DESC LIMIT 7", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region ORDER BY 1 DESC LIMIT 7")
    # -- ordering
    dialect("order_nulls", "SELECT o.o_orderkey, l.l_linenumber FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey ORDER BY l.l_linenumber, o.o_orderkey LIMIT 300", "SELECT o.o_orderkey, l.l_linenumber FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey ORDER BY l.l_linenumber NULLS FIRST, o.o_orderkey LIMIT 300")
    dialect("order_nulls_last", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s ASC NULLS LAST, o_orderkey DESC LIMIT 50")
    dialect("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
    dialect("order_by_aggregate", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 3")
    dialect("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
    dialect("limit_negative", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT -1", "SELECT o_orderkey FROM orders LIMIT 0")
    # -- named queries
    dialect("cte_basic", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey) SELECT c.c_name, round(b.spent, 2) AS spent FROM big b JOIN customer c ON c.c_custkey = b.o_custkey WHERE b.spent > 3000000.0")
    dialect("cte_in_set_arms", "WITH few AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1) SELECT k FROM few UNION ALL SELECT k + 100 FROM few", "WITH few AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1) SELECT k::BIGINT AS k FROM few UNION ALL SELECT k + 100 FROM few")
    dialect("derived_table", "SELECT t.status, t.n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus) t WHERE t.n > 10")
    view = "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey"
    dialect("view_basic", "SELECT o_custkey, n FROM v1 WHERE n > 12", f"SELECT o_custkey, n FROM ({view}) WHERE n > 12", views=(view,))
    dialect("view_over_view", "SELECT n, count(*) AS customers FROM v2 GROUP BY n", f"SELECT n, count(*) AS customers FROM (SELECT o_custkey, n FROM ({view}) WHERE n > 8) GROUP BY n", views=(view, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 8"))
