"""Statements for every operator of the dialect: (name, tables, statement, DuckDB's form; "" if it is the same text)."""

from __future__ import annotations

STATEMENTS: list[tuple[str, str, str, str | None]] = []


def add(name: str, tables: str, sql: str, duck: str | None = "") -> None:
    STATEMENTS.append((name, tables, sql, duck))


# -- sources -------------------------------------------------------------------------------------------------------------

add("source_scan", "region", "SELECT * FROM region")
add("source_values", "", "SELECT a, b FROM (VALUES ROW(1, 'x'), ROW(2, 'y'), ROW(3, NULL)) AS v(a, b)", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)")
add("source_table_statement", "nation", "TABLE nation", "SELECT * FROM nation")
add("source_select_without_from", "", "SELECT 1 AS one, 'a' AS letter, 2/5 AS ratio")
add("source_extend", "region", "SELECT r_regionkey, r_name, note FROM region EXTEND (note VARCHAR(10))", "SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS note FROM region")
add("source_sample_all", "nation", "SELECT n_nationkey FROM nation TABLESAMPLE BERNOULLI(100) REPEATABLE(7)", "SELECT n_nationkey FROM nation")
add("source_sub_schema", "mart.nation mart.region", "SELECT n.n_name, r.r_name FROM mart.nation n JOIN mart.region AS r ON n.n_regionkey = r.r_regionkey", "SELECT n.n_name, r.r_name FROM nation n JOIN region AS r ON n.n_regionkey = r.r_regionkey")

# -- projection, filter, predicates ------------------------------------------------------------------------------------------

add("project_expressions", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + 1 more, -l_tax AS minus_tax FROM lineitem")
add("project_all_columns", "orders", "SELECT o.* FROM orders o")
add("project_distinct", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
add("filter_comparisons", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F' AND NOT o_custkey < 50 OR o_orderkey = 7")
add("filter_implicit_cast", "orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > '100' AND o_orderkey = '42' OR o_custkey = '7'", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 100 AND o_orderkey = 42 OR o_custkey = 7")
add("filter_in", "part", "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
add("filter_in_rows", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('A', 'F'), ('N', 'O'))")
add("filter_in_subquery", "customer nation", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
add("filter_not_in_subquery", "customer nation", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
add("filter_exists", "customer orders", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
add("filter_not_exists", "customer orders", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
add("filter_between", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.08")
add("filter_between_symmetric", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN SYMMETRIC 12 AND 10", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
add("filter_like", "part", r"SELECT p_partkey FROM part WHERE p_type LIKE '%E%' AND p_name NOT LIKE 'a!%%' ESCAPE '!'")
add("filter_similar_to", "part", "SELECT p_partkey FROM part WHERE p_type SIMILAR TO '%(E|O)%' AND p_brand NOT SIMILAR TO 'Brand#1_'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_type, '.*(E|O).*') AND NOT regexp_full_match(p_brand, 'Brand#1.')")
add("filter_similar_to_column", "part", "SELECT p_partkey, p_brand SIMILAR TO concat('Brand#', substr(p_brand, 7, 1), '_') AS a, p_brand SIMILAR TO replace(p_brand, '#', '.') AS b, p_name SIMILAR TO concat('%', substr(p_name, 3, 2), '!%%') ESCAPE '!' c FROM part", "SELECT p_partkey, length(p_brand) = 8 AS a, false AS b, false AS c FROM part")
add("filter_rlike", "customer", "SELECT c_custkey FROM customer WHERE c_name RLIKE '[13579]$' AND c_mktsegment NOT RLIKE '^B' AND c_name REGEXP '0' AND c_name NOT REGEXP '99'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[13579]$') AND NOT regexp_matches(c_mktsegment, '^B') AND regexp_matches(c_name, '0') AND NOT regexp_matches(c_name, '99')")
add("filter_is_tests", "customer", "SELECT c_custkey, (c_acctbal > 0) IS TRUE AS pos, (c_acctbal > 0) IS NOT FALSE AS nonneg, (NULLIF(c_nationkey, 3) = 5) IS UNKNOWN AS unk, c_name IS NULL AS isn, c_name IS NOT NULL AS notn FROM customer", "SELECT c_custkey, coalesce(c_acctbal > 0, false) AS pos, coalesce(c_acctbal > 0, true) AS nonneg, (NULLIF(c_nationkey, 3) = 5) IS NULL AS unk, c_name IS NULL AS isn, c_name IS NOT NULL AS notn FROM customer")
add("filter_distinct_from", "customer", "SELECT c_custkey FROM customer WHERE NULLIF(c_nationkey, 3) IS DISTINCT FROM NULLIF(c_nationkey, 4) AND c_nationkey IS NOT DISTINCT FROM 3")
add("filter_quantified_any", "orders customer", "SELECT o_orderkey FROM orders WHERE o_totalprice > ANY (SELECT c_acctbal * 30 FROM customer) AND o_custkey = SOME (SELECT c_custkey FROM customer WHERE c_nationkey = 2)", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT min(c_acctbal * 30) FROM customer) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 2)")
add("filter_quantified_all", "orders customer", "SELECT o_orderkey FROM orders WHERE o_totalprice >= ALL (SELECT c_acctbal * 10 FROM customer) AND o_custkey <> ALL (SELECT c_custkey FROM customer WHERE c_nationkey < 20) AND o_orderkey > ALL (5, 9)", "SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT max(c_acctbal * 10) FROM customer) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) AND o_orderkey > 9")
add("filter_periods", "orders", "SELECT o_orderkey FROM orders WHERE (o_orderdate, o_orderdate + INTERVAL '30' DAY) OVERLAPS (TIMESTAMP '1995-01-01 00:00:00', TIMESTAMP '1995-02-01 00:00:00') AND PERIOD(TIMESTAMP '1994-12-01 00:00:00', TIMESTAMP '1995-03-01 00:00:00') CONTAINS PERIOD(o_orderdate, o_orderdate)", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-02-01' AND TIMESTAMP '1995-01-01' < o_orderdate + INTERVAL 30 DAY AND TIMESTAMP '1994-12-01' <= o_orderdate AND o_orderdate <= TIMESTAMP '1995-03-01'")
add("filter_multisets", "part", "SELECT p_partkey, p_size MEMBER OF ARRAY[1, 2, 3] AS low, ARRAY[p_size] SUBMULTISET OF ARRAY[4, 5] AS four, ARRAY[p_size, 7] IS A SET AS apart, ARRAY[p_size, 7] IS NOT EMPTY AS some FROM part", "SELECT p_partkey, p_size IN (1, 2, 3) AS low, p_size IN (4, 5) AS four, p_size <> 7 AS apart, true AS some FROM part")
add("case_simple_many", "part", "SELECT p_partkey, CASE p_size WHEN 1, 2, 3 THEN 'small' WHEN 48, 49, 50 THEN 'large' ELSE 'mid' END AS c FROM part", "SELECT p_partkey, CASE WHEN p_size IN (1, 2, 3) THEN 'small' WHEN p_size IN (48, 49, 50) THEN 'large' ELSE 'mid' END AS c FROM part")
add("case_searched", "orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS c, IF(o_orderstatus = 'O', 1, 0) AS f FROM orders")
add("row_comparison", "nation", "SELECT n_nationkey FROM nation WHERE ROW(n_regionkey, n_nationkey) = ROW(1, 1) OR (n_regionkey, n_nationkey) = (2, 8)", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1 AND n_nationkey = 1 OR n_regionkey = 2 AND n_nationkey = 8")
add("cast_failing", "part events", "SELECT p_partkey, CAST(p_name AS DOUBLE) AS d, CAST(p_brand AS INTEGER) AS i, CAST(p_size AS VARCHAR) AS s, CAST(p_retailprice AS INTEGER) AS t FROM part", "SELECT p_partkey, try_cast(p_name AS DOUBLE) AS d, try_cast(p_brand AS INTEGER) AS i, CAST(p_size AS VARCHAR) AS s, CAST(trunc(p_retailprice) AS INTEGER) AS t FROM part")
add("cast_decimal", "lineitem", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) * 2 AS DECIMAL(20, 2)) AS d FROM lineitem")
add("item_access", "embeddings", "SELECT vec_id, embedding[0] AS first_item, embedding[5000] AS beyond, ARRAY[label, 1][0] AS own FROM embeddings", "SELECT vec_id, embedding[1] AS first_item, CAST(NULL AS FLOAT) AS beyond, label AS own FROM embeddings")
add("literals", "", "SELECT 1 AS i, 1.5 AS dec, 'it''s' AS s, N'n' AS n, U&'\\00e9' AS u, TRUE AS t, UNKNOWN AS un, DATE '2020-02-29' AS d, TIMESTAMP_NTZ '2020-02-29 01:02:03' AS ts, 'a\\b' AS back", "SELECT 1 AS i, 1.5 AS dec, 'it''s' AS s, 'n' AS n, 'é' AS u, TRUE AS t, CAST(NULL AS BOOLEAN) AS un, DATE '2020-02-29' AS d, TIMESTAMP '2020-02-29 01:02:03' AS ts, 'a\\b' AS back")
add("escapes_and_comments", "nation", "SELECT {fn upper(n_name)} AS u, {d '2020-01-01'} AS d /* block */ FROM nation // to the end\n WHERE n_nationkey < 5 -- too", "SELECT upper(n_name) AS u, DATE '2020-01-01' AS d FROM nation WHERE n_nationkey < 5")
add("quoted_identifiers", "nation", "SELECT `n_name` AS `odd name`, N_NATIONKEY AS k FROM `nation`", 'SELECT n_name AS "odd name", n_nationkey AS k FROM nation')

# -- joins ---------------------------------------------------------------------------------------------------------------

add("join_inner", "orders customer", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
add("join_inner_keyword_using", "lineitem orders", "SELECT count(*) AS n, round(sum(l.l_quantity), 2) AS q FROM lineitem l INNER JOIN (SELECT o_orderkey AS l_orderkey, o_orderstatus FROM orders) o USING (l_orderkey) WHERE o_orderstatus = 'F'")
add("join_natural", "nation region", "SELECT n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r")
add("join_left", "customer orders", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey")
add("join_right", "orders customer", "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 100000")
add("join_full", "supplier customer", "SELECT s.s_suppkey, c.c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s FULL OUTER JOIN (SELECT * FROM customer WHERE c_acctbal < 0) c ON s.s_suppkey = c.c_custkey")
add("join_theta_outer_equi", "orders lineitem", "SELECT o.o_orderkey, l.l_linenumber FROM orders o LEFT OUTER JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND o.o_orderkey < 1000")
add("join_theta_outer_complex", "orders lineitem", """SELECT p AS o_orderpriority, n AS n_lines, total AS sum_price, top AS max_price FROM (
 SELECT o.o_orderpriority AS p, count(*) AS n, round(sum(l.l_extendedprice), 2) AS total, max(l.l_extendedprice) AS top
 FROM orders o LEFT OUTER JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND o.o_orderkey < 15000 GROUP BY o.o_orderpriority) t WHERE n > 2""")
add("join_theta", "nation region", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey")
add("join_mixed_types", "orders lineitem", "SELECT count(*) AS n FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders) o JOIN lineitem l ON o.k = l.l_orderkey", "SELECT count(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
add("join_cross_comma", "nation region", "SELECT n_name, r_name FROM nation, region WHERE r_regionkey = n_regionkey")
add("join_cross", "nation region", "SELECT n_name, r_name FROM nation CROSS JOIN region")
add("join_lateral_subquery", "customer orders", "SELECT c.c_custkey, t.total FROM customer c, LATERAL (SELECT round(sum(o_totalprice), 2) AS total FROM orders o WHERE o.o_custkey = c.c_custkey) t", "SELECT c.c_custkey, t.total FROM customer c LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) t ON t.o_custkey = c.c_custkey")
add("join_lateral_table", "part", "SELECT p.p_partkey, w.word FROM part p, LATERAL TABLE(explode(split(p.p_name, ' '))) AS w(word)", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
add("join_cross_apply", "part", "SELECT p.p_partkey, w.word FROM part p CROSS APPLY TABLE(explode(split(p.p_type, ' '))) AS w(word)", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
add("join_unnest", "part", "SELECT p.p_partkey, w.word, w.n FROM part p, UNNEST(split(p.p_name, ' ')) WITH ORDINALITY AS w(word, n)", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, CAST(unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS INTEGER) AS n FROM part")
add("join_semi", "customer orders", "SELECT c.c_custkey FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
add("join_anti", "customer orders", "SELECT c.c_custkey FROM customer c LEFT ANTI JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
add("join_many", "lineitem orders customer nation region", "SELECT r.r_name, count(*) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name")

# -- aggregation ---------------------------------------------------------------------------------------------------------

add("aggregate_group", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 6) AS a, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
add("aggregate_expression_key", "orders", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1")
add("aggregate_having", "orders", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
add("aggregate_grouping_sets", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS INTEGER) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
add("aggregate_rollup", "lineitem", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)")
add("aggregate_cube", "lineitem", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)")
add("aggregate_empty_group", "nation", "SELECT count(*) AS n FROM nation GROUP BY ()", "SELECT count(*) AS n FROM nation")
add("aggregate_distinct", "lineitem", "SELECT count(DISTINCT l_suppkey) AS s, count(DISTINCT l_returnflag) AS f, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS d FROM lineitem")
add("aggregate_filter", "orders", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS big FROM orders GROUP BY o_orderpriority")
add("aggregate_no_rows", "orders", "SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0")
add("aggregate_statistics", "lineitem", "SELECT l_returnflag, round(std(l_quantity), 6) AS a, round(stddev(l_quantity), 6) AS b, round(stddev_samp(l_quantity), 6) AS c, round(variance(l_quantity), 6) AS d, round(var_samp(l_quantity), 6) AS e FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS a, round(stddev_pop(l_quantity), 6) AS b, round(stddev_samp(l_quantity), 6) AS c, round(var_pop(l_quantity), 6) AS d, round(var_samp(l_quantity), 6) AS e FROM lineitem GROUP BY l_returnflag")
add("aggregate_two_columns", "lineitem", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 6) AS p, round(covar_samp(l_quantity, l_tax), 6) AS s, round(covariance(l_quantity, l_discount), 6) AS v FROM lineitem", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 6) AS p, round(covar_samp(l_quantity, l_tax), 6) AS s, round(covar_pop(l_quantity, l_discount), 6) AS v FROM lineitem")
add("aggregate_regression", "lineitem", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 3) AS ic, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_avgx(l_extendedprice, l_quantity), 6) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 4) AS ay FROM lineitem")
add("aggregate_regression_sums", "supplier", "SELECT round(regr_sxx(s_acctbal, s_nationkey), 3) AS xx, round(regr_syy(s_nationkey, s_acctbal), 3) AS yy, round(regr_sxy(s_acctbal, s_nationkey), 3) AS xy FROM supplier")
add("aggregate_percentile", "lineitem", "SELECT l_returnflag, round(percentile(l_extendedprice, 0.5), 4) AS m, round(percentile(l_quantity, 0.9), 4) AS p FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS m, round(quantile_cont(l_quantity, 0.9), 4) AS p FROM lineitem GROUP BY l_returnflag")
_HISTOGRAM = """WITH b AS (SELECT l_returnflag AS f, CAST(l_linenumber AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM lineitem GROUP BY 1, 2),
 c AS (SELECT f, x, y, sum(y) OVER (PARTITION BY f ORDER BY x) AS upto, sum(y) OVER (PARTITION BY f) AS total, lag(x) OVER (PARTITION BY f ORDER BY x) AS px FROM b),
 r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY x) AS k FROM c WHERE upto >= 0.8 * total)
 SELECT f AS l_returnflag, round(CASE WHEN px IS NULL THEN x ELSE px + (0.8 * total - (upto - y)) * (x - px) / y END, 6) AS p FROM r WHERE k = 1"""
add("aggregate_percentile_approx", "lineitem", "SELECT l_returnflag, round(percentile_approx(l_linenumber, 0.8), 6) AS p FROM lineitem GROUP BY l_returnflag", _HISTOGRAM)
add("aggregate_histogram", "lineitem", "SELECT f, h.x AS x, h.y AS y FROM (SELECT l_returnflag AS f, histogram_numeric(l_linenumber, 20) AS hs FROM lineitem GROUP BY l_returnflag) t, LATERAL TABLE(explode(hs)) AS e(h)", "SELECT l_returnflag AS f, CAST(l_linenumber AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS y FROM lineitem GROUP BY 1, 2")
add("aggregate_collect", "orders", "SELECT o_custkey, array_join(sort_array(collect_list(CAST(o_orderkey AS STRING))), ',') AS ks, size(collect_set(o_orderstatus)) AS n, array_join(sort_array(collect(o_orderstatus)), '') AS st FROM orders GROUP BY o_custkey", "SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS ks, CAST(count(DISTINCT o_orderstatus) AS INTEGER) AS n, string_agg(o_orderstatus, '' ORDER BY o_orderstatus) AS st FROM orders GROUP BY o_custkey")
add("aggregate_fusion", "orders", "SELECT o_orderstatus, size(fusion(ARRAY[o_orderkey, o_custkey])) AS n, $SUM0(NULLIF(o_orderkey, o_orderkey)) AS z FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(2 * count(*) AS INTEGER) AS n, CAST(0 AS BIGINT) AS z FROM orders GROUP BY o_orderstatus")
add("aggregate_bivalent", "events", "SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(value) AS n, round(sum(value), 3) AS s FROM events GROUP BY event_type")

# -- sort, limit, set operations, subqueries -----------------------------------------------------------------------------------

add("sort_limit", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
add("sort_nulls", "customer", "SELECT c_custkey, k FROM (SELECT c_custkey, NULLIF(c_nationkey, 24) AS k FROM customer) t ORDER BY k DESC, c_custkey LIMIT 40", "SELECT c_custkey, k FROM (SELECT c_custkey, NULLIF(c_nationkey, 24) AS k FROM customer) t ORDER BY k DESC NULLS FIRST, c_custkey LIMIT 40")
add("sort_nulls_first", "customer", "SELECT c_custkey, k FROM (SELECT c_custkey, NULLIF(c_nationkey, 24) AS k FROM customer) t ORDER BY k NULLS FIRST, c_custkey LIMIT 40")
add("limit_offset_fetch", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 20 ROWS FETCH NEXT 5 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 20")
add("limit_start_count", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7, 3", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3 OFFSET 7")
add("set_union_all", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
add("set_union", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
add("set_intersect", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
add("set_intersect_all", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
add("set_except", "nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
add("set_minus", "nation supplier", "SELECT n_nationkey AS k FROM nation MINUS SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
add("set_except_all", "customer supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
add("with_clause", "orders", "WITH spend(k, total) AS (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey), top AS (SELECT max(total) AS m FROM spend) SELECT k, round(total, 2) AS total FROM spend WHERE total = (SELECT m FROM top)")
add("subquery_scalar", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1.9 * (SELECT avg(o_totalprice) FROM orders)")
add("subquery_correlated", "lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > 1.5 * (SELECT avg(l_quantity) FROM lineitem i WHERE i.l_orderkey = l.l_orderkey)")
add("subquery_derived", "customer", "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) t WHERE n > 10")
add("subquery_array", "region", "SELECT size(ARRAY(SELECT r_name FROM region)) AS n, array_join(sort_array(MULTISET(SELECT r_name FROM region)), '|') AS names", "SELECT CAST(count(*) AS INTEGER) AS n, string_agg(r_name, '|' ORDER BY r_name) AS names FROM region")
add("subquery_map", "region", "SELECT size(MAP(SELECT r_regionkey, r_name FROM region)) AS n, MAP(SELECT r_regionkey, r_name FROM region)[1] AS one", "SELECT CAST(count(*) AS INTEGER) AS n, max(CASE WHEN r_regionkey = 1 THEN r_name END) AS one FROM region")
add("multiset_operators", "part", "SELECT p_partkey, size(ARRAY[p_size, 1] MULTISET UNION DISTINCT ARRAY[1, 2]) AS u, size(ARRAY[p_size, 1] MULTISET INTERSECT DISTINCT ARRAY[1, 2]) AS i, size(ARRAY[p_size, 1] MULTISET EXCEPT DISTINCT ARRAY[1, 2]) AS e, size(ARRAY[p_size, 1] MULTISET UNION ALL ARRAY[1, 2]) AS a FROM part", "SELECT p_partkey, CAST(CASE WHEN p_size IN (1, 2) THEN 2 ELSE 3 END AS INTEGER) AS u, CAST(CASE WHEN p_size = 2 THEN 2 ELSE 1 END AS INTEGER) AS i, CAST(CASE WHEN p_size IN (1, 2) THEN 0 ELSE 1 END AS INTEGER) AS e, CAST(4 AS INTEGER) AS a FROM part")

# -- windows -------------------------------------------------------------------------------------------------------------

add("window_ranking", "orders", "SELECT o_orderkey, CAST(row_number() OVER (p ORDER BY o_orderkey) AS BIGINT) AS rn, CAST(rank() OVER (p ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (p ORDER BY o_orderpriority) AS BIGINT) AS dr, CAST(ntile(3) OVER (p ORDER BY o_orderkey) AS BIGINT) AS nt FROM orders WINDOW p AS (PARTITION BY o_custkey)",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr, ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nt FROM orders")
add("window_distribution", "customer", "SELECT c_custkey, round(percent_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS pr, round(cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal), 9) AS cd FROM customer")
add("window_analytic", "events", "SELECT event_id, lead(value, 1, 10.0) OVER w AS nx, lag(value) OVER w AS pv, first_value(value) OVER w AS fv, last_value(value) OVER w AS lv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
add("window_nth_value", "events", "SELECT event_id, nth_value(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS second FROM events")
add("window_aggregates", "events", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS run, count(*) OVER (PARTITION BY user_id) AS n, max(value) OVER (PARTITION BY event_type) AS top FROM events")
add("window_rows_frame", "events", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS a, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 3 PRECEDING) AS c FROM events")
add("window_range_frame", "part", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS c FROM part")
add("window_filter", "lineitem", "SELECT l_orderkey, l_linenumber, count(*) FILTER (WHERE l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS r, round(sum(l_quantity) FILTER (WHERE l_tax > 0.04) OVER (PARTITION BY l_orderkey), 2) AS q FROM lineitem")
add("window_top_of_group", "orders", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2")

# -- infix operators and calls with their own syntax ------------------------------------------------------------------------------

add("arithmetic", "part", "SELECT p_partkey, p_size / 7 AS d, p_size % 7 AS m, p_size - 7 * 2 AS s, +p_size AS p, -p_size AS n, p_size / 0 AS z, 'x' || p_brand AS c FROM part", "SELECT p_partkey, p_size / 7 AS d, p_size % 7 AS m, p_size - 7 * 2 AS s, p_size AS p, -p_size AS n, CAST(NULL AS DOUBLE) AS z, 'x' || p_brand AS c FROM part")
add("extract_units", "orders", "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS q, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS d, CAST(extract(DOY FROM o_orderdate) AS BIGINT) AS doy, CAST(extract(WEEK FROM o_orderdate) AS BIGINT) AS w, CAST(extract(ISODOW FROM o_orderdate) AS BIGINT) AS iso, CAST(extract(CENTURY FROM o_orderdate) AS BIGINT) AS c, CAST(extract(DECADE FROM o_orderdate) AS BIGINT) AS dec, CAST(extract(ISOYEAR FROM o_orderdate) AS BIGINT) AS iy, CAST(extract(EPOCH FROM o_orderdate) AS BIGINT) AS ep FROM orders")
add("floor_ceil_time", "events", "SELECT event_id, FLOOR(ts TO HOUR) AS f, CEIL(ts TO DAY) AS c, floor_month(ts) AS m FROM events", "SELECT event_id, date_trunc('hour', ts) AS f, CASE WHEN date_trunc('day', ts) = ts THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS c, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m FROM events")
add("timestamp_arithmetic", "orders", "SELECT o_orderkey, timestampadd(SQL_TSI_DAY, 10, o_orderdate) AS a, CAST(timestampdiff(DAY, TIMESTAMP_NTZ '1992-01-01 00:00:00', o_orderdate) AS BIGINT) AS d, o_orderdate + INTERVAL '2' HOUR AS h FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS a, CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS BIGINT) AS d, o_orderdate + INTERVAL 2 HOUR AS h FROM orders")
add("string_syntax", "part", "SELECT p_partkey, POSITION('a' IN p_name) AS p1, POSITION('a' IN p_name FROM 4) AS p2, OVERLAY(p_name PLACING 'ZZ' FROM 2 FOR 3) AS o, SUBSTRING(p_name FROM 2 FOR 3) AS s, TRIM(BOTH 'a' FROM p_name) AS t, TRIM(LEADING 'b' FROM p_name) AS l, TRANSLATE(p_name, 'abc', 'xyz') AS tr FROM part", "SELECT p_partkey, CAST(instr(p_name, 'a') AS INTEGER) AS p1, CAST(CASE WHEN instr(substr(p_name, 4), 'a') > 0 THEN instr(substr(p_name, 4), 'a') + 3 ELSE 0 END AS INTEGER) AS p2, substr(p_name, 1, 1) || 'ZZ' || substr(p_name, 5) AS o, substr(p_name, 2, 3) AS s, trim(p_name, 'a') AS t, ltrim(p_name, 'b') AS l, translate(p_name, 'abc', 'xyz') AS tr FROM part")
add("constructors", "part", "SELECT p_partkey, size(ARRAY[p_size, 2, 3]) AS a, MAP['k', p_size, 'j', 5]['k'] AS m, cardinality(MULTISET[1, 1]) AS c, element(ARRAY[p_size]) AS e FROM part", "SELECT p_partkey, CAST(3 AS INTEGER) AS a, p_size AS m, CAST(2 AS INTEGER) AS c, p_size AS e FROM part")
add("standard_functions", "part", "SELECT p_partkey, char_length(p_name) AS cl, character_length(p_brand) AS c2, octet_length(p_name) AS ol, coalesce(NULLIF(p_size, 5), -1) AS co, mod(p_size, 3) AS m, truncate(p_retailprice, 1) AS t, ceiling(p_retailprice) AS ce, floor(p_retailprice) AS fl FROM part", "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS cl, CAST(length(p_brand) AS INTEGER) AS c2, CAST(strlen(p_name) AS INTEGER) AS ol, coalesce(NULLIF(p_size, 5), -1) AS co, p_size % 3 AS m, sign(p_retailprice) * floor(abs(p_retailprice) * 10) / 10 AS t, CAST(ceil(p_retailprice) AS BIGINT) AS ce, CAST(floor(p_retailprice) AS BIGINT) AS fl FROM part")

# -- scalar functions ------------------------------------------------------------------------------------------------------

add("string_case_and_trim", "part", "SELECT p_partkey, upper(p_name) AS u, ucase(p_name) AS u2, lower(p_brand) AS l, lcase(p_brand) AS l2, initcap(p_name) AS i, ltrim(concat('  ', p_name)) AS lt, rtrim(concat(p_name, '  ')) AS rt, trim(concat(' ', p_name, ' ')) AS t FROM part", "SELECT p_partkey, upper(p_name) AS u, upper(p_name) AS u2, lower(p_brand) AS l, lower(p_brand) AS l2, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS i, p_name AS lt, p_name AS rt, p_name AS t FROM part")
add("string_parts", "part", "SELECT p_partkey, substr(p_name, 3) AS a, substring(p_name, -3) AS b, substr(p_name, 2, 4) AS c, substring_index(p_name, ' ', 1) AS d, split(p_name, ' ')[0] AS e, reverse(p_name) AS f, repeat(p_brand, 2) AS g, space(2) AS h, replace(p_name, 'a', 'A') AS i FROM part", "SELECT p_partkey, substr(p_name, 3) AS a, substr(p_name, -3) AS b, substr(p_name, 2, 4) AS c, string_split(p_name, ' ')[1] AS d, string_split(p_name, ' ')[1] AS e, reverse(p_name) AS f, repeat(p_brand, 2) AS g, '  ' AS h, replace(p_name, 'a', 'A') AS i FROM part")
add("string_pad", "part", "SELECT p_partkey, lpad(p_brand, 12, '*') AS a, rpad(p_brand, 12, '-') AS b, lpad(p_brand, 3, '*') AS c, lpad(p_brand, 12, '') AS d, rpad(p_brand, 12, '') AS e FROM part", "SELECT p_partkey, lpad(p_brand, 12, '*') AS a, rpad(p_brand, 12, '-') AS b, lpad(p_brand, 3, '*') AS c, CAST(NULL AS VARCHAR) AS d, CAST(NULL AS VARCHAR) AS e FROM part")
add("string_search", "part", "SELECT p_partkey, instr(p_name, 'e') AS a, locate('e', p_name) AS b, locate('e', p_name, 5) AS c, find_in_set('b', 'a,b,c') AS d, field(p_size, 3, 7, 9) AS e, ascii(p_brand) AS f, length(p_name) AS g, elt(2, p_brand, p_name) AS h FROM part", "SELECT p_partkey, CAST(instr(p_name, 'e') AS INTEGER) AS a, CAST(instr(p_name, 'e') AS INTEGER) AS b, CAST(CASE WHEN instr(substr(p_name, 5), 'e') > 0 THEN instr(substr(p_name, 5), 'e') + 4 ELSE 0 END AS INTEGER) AS c, CAST(2 AS INTEGER) AS d, CAST(CASE p_size WHEN 3 THEN 1 WHEN 7 THEN 2 WHEN 9 THEN 3 ELSE 0 END AS INTEGER) AS e, CAST(ascii(p_brand) AS INTEGER) AS f, CAST(length(p_name) AS INTEGER) AS g, p_name AS h FROM part")
add("string_regexp", "part", "SELECT p_partkey, regexp_extract(p_brand, '#([0-9])([0-9])', 2) AS a, regexp_replace(p_name, '[aeiou]+', '_') AS b FROM part", "SELECT p_partkey, regexp_extract(p_brand, '#([0-9])([0-9])', 2) AS a, regexp_replace(p_name, '[aeiou]+', '_', 'g') AS b FROM part")
add("string_concat", "customer", "SELECT c_custkey, concat(c_name, '/', c_mktsegment) AS a, concat_ws('-', c_name, NULL, c_mktsegment) AS b, concat_ws(',', ARRAY[c_name, 'z']) AS c, concat(c_name, NULLIF(c_mktsegment, 'BUILDING')) AS d FROM customer", "SELECT c_custkey, c_name || '/' || c_mktsegment AS a, concat_ws('-', c_name, NULL, c_mktsegment) AS b, c_name || ',z' AS c, c_name || NULLIF(c_mktsegment, 'BUILDING') AS d FROM customer")
add("string_mask", "nation", "SELECT n_nationkey, mask_first_n(n_name, 3) AS a, mask_last_n(n_name, 2) AS b, mask_show_first_n(n_name, 2) AS c, mask_show_last_n(n_name, 2) AS d, mask_hash(n_name) AS h, mask(n_name) AS m FROM nation", "WITH m AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(n_name, '[a-z]', 'x', 'g'), '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g') AS k FROM nation) SELECT n_nationkey, k[1:3] || n_name[4:] AS a, n_name[1:length(n_name) - 2] || k[length(n_name) - 1:] AS b, n_name[1:2] || k[3:] AS c, k[1:length(n_name) - 2] || n_name[length(n_name) - 1:] AS d, sha256(n_name) AS h, k AS m FROM m")
add("string_other", "nation", "SELECT n_nationkey, levenshtein(n_name, 'NATION') AS lv, base64(encode(n_name, 'UTF-8')) AS b6, hex(n_name) AS hx, decode(unbase64('YWI='), 'UTF-8') AS d, format_number(n_nationkey * 1000.5, 1) AS f, printf('%d-%s', n_nationkey, n_name) AS p, soundex('Robert') AS sx FROM nation", "SELECT n_nationkey, CAST(levenshtein(n_name, 'NATION') AS INTEGER) AS lv, base64(encode(n_name)) AS b6, hex(n_name) AS hx, 'ab' AS d, CASE WHEN n_nationkey = 0 THEN '0.0' ELSE format('{:,.1f}', n_nationkey * 1000.5::DOUBLE) END AS f, n_nationkey || '-' || n_name AS p, 'R163' AS sx FROM nation")
add("string_urls", "pages", "SELECT page_id, parse_url(url, 'HOST') AS h, parse_url(url, 'PROTOCOL') AS p FROM pages", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS h, regexp_extract(url, '^([a-z]+)://', 1) AS p FROM pages")
add("json_path", "events", "SELECT event_id, get_json_object(props, '$.k') AS k, get_json_object(props, '$.nothing') AS nothing FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS nothing FROM events")
add("xml_path", "nation", "SELECT n_nationkey, xpath_string(concat('<a><b>', n_name, '</b></a>'), 'a/b') AS s, xpath_int('<a><b>3</b><b>4</b></a>', 'sum(a/b)') AS i, xpath_boolean('<a/>', 'a') AS b FROM nation", "SELECT n_nationkey, n_name AS s, CAST(7 AS INTEGER) AS i, true AS b FROM nation")
add("math_rounding", "lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice) AS a, round(l_discount, 1) AS b, floor(l_extendedprice) AS c, ceil(l_tax * 100) AS d, abs(l_discount - 0.05) AS e, sign(l_discount - 0.05) AS f, bround(2.5) AS g FROM lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice) AS a, round(l_discount, 1) AS b, CAST(floor(l_extendedprice) AS BIGINT) AS c, CAST(ceil(l_tax * 100) AS BIGINT) AS d, abs(l_discount - 0.05) AS e, CAST(sign(l_discount - 0.05) AS DOUBLE) AS f, CAST(2 AS DECIMAL(2, 0)) AS g FROM lineitem")
add("math_powers", "lineitem", "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity - 10), 9) AS a, round(power(l_quantity, 2), 6) AS b, round(exp(l_tax), 9) AS c, round(ln(l_quantity), 9) AS d, round(log10(l_quantity), 9) AS e, round(log2(l_quantity), 9) AS f, round(log(3, l_quantity), 9) AS g, round(cbrt(l_quantity), 9) AS h FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 10 THEN round(sqrt(greatest(l_quantity - 10, 0)), 9) END AS a, round(power(l_quantity, 2), 6) AS b, round(exp(l_tax), 9) AS c, round(ln(l_quantity), 9) AS d, round(log10(l_quantity), 9) AS e, round(log2(l_quantity), 9) AS f, round(ln(l_quantity) / ln(3), 9) AS g, round(cbrt(l_quantity), 9) AS h FROM lineitem")
add("math_trigonometry", "lineitem", "SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 9) AS a, round(cos(l_quantity), 9) AS b, round(tan(l_tax), 9) AS c, round(asin(l_discount), 9) AS d, round(acos(l_discount), 9) AS e, round(atan(l_quantity), 9) AS f, round(radians(l_quantity), 9) AS g, round(UDFDegrees(l_tax), 9) AS h, round(pi() + e(), 9) AS i FROM lineitem", "SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 9) AS a, round(cos(l_quantity), 9) AS b, round(tan(l_tax), 9) AS c, round(asin(l_discount), 9) AS d, round(acos(l_discount), 9) AS e, round(atan(l_quantity), 9) AS f, round(radians(l_quantity), 9) AS g, round(degrees(l_tax), 9) AS h, round(pi() + exp(1), 9) AS i FROM lineitem")
add("math_integers", "part", "SELECT p_partkey, pmod(p_size - 25, 7) AS a, p_size DIV 7 AS b, greatest(p_size, 10, 20) AS c, least(p_size, 10, 20) AS d, shiftleft(p_size, 2) AS e, shiftright(p_size, 1) AS f, p_size & 6 AS g, p_size | 1 AS h, p_size ^ 3 AS i, factorial(5) AS k, bin(p_size) AS l, conv('ff', 16, 10) AS m FROM part", "SELECT p_partkey, (((p_size - 25) % 7) + 7) % 7 AS a, CAST(p_size // 7 AS BIGINT) AS b, greatest(p_size, 10, 20) AS c, least(p_size, 10, 20) AS d, CAST(p_size << 2 AS INTEGER) AS e, CAST(p_size >> 1 AS INTEGER) AS f, p_size & 6 AS g, p_size | 1 AS h, xor(p_size, 3) AS i, CAST(120 AS BIGINT) AS k, bin(p_size) AS l, '255' AS m FROM part")
add("date_strings", "orders", "SELECT o_orderkey, to_date(o_orderdate) AS a, date_add(o_orderdate, 7) AS b, date_sub(o_orderdate, 7) AS c, add_months(o_orderdate, 1) AS d, last_day(o_orderdate) AS e, trunc(o_orderdate, 'MM') AS f, trunc(o_orderdate, 'YEAR') AS g FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate + INTERVAL 7 DAY, '%Y-%m-%d') AS b, strftime(o_orderdate - INTERVAL 7 DAY, '%Y-%m-%d') AS c, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS d, strftime(last_day(o_orderdate), '%Y-%m-%d') AS e, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS f, strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS g FROM orders")
add("date_next_day", "orders", "SELECT o_orderkey, next_day(o_orderdate, 'TU') AS a FROM orders", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + CAST((8 - isodow(o_orderdate)) % 7 + 1 AS INTEGER), '%Y-%m-%d') AS a FROM orders")
add("date_parts", "events", "SELECT event_id, year(ts) AS a, quarter(ts) AS b, month(ts) AS c, day(ts) AS d, dayofmonth(ts) AS e, hour(ts) AS f, minute(ts) AS g, second(ts) AS h, dayofweek(ts) AS i, yearweek(ts) AS j, weekofyear(ts) AS k FROM events", "SELECT event_id, CAST(year(ts) AS INTEGER) AS a, CAST(quarter(ts) AS INTEGER) AS b, CAST(month(ts) AS INTEGER) AS c, CAST(day(ts) AS INTEGER) AS d, CAST(day(ts) AS INTEGER) AS e, CAST(hour(ts) AS INTEGER) AS f, CAST(minute(ts) AS INTEGER) AS g, CAST(second(ts) AS INTEGER) AS h, CAST(dayofweek(ts) + 1 AS INTEGER) AS i, CAST(week(ts) AS INTEGER) AS j, CAST(week(ts) AS INTEGER) AS k FROM events")
add("date_differences", "orders", "SELECT o_orderkey, datediff(o_orderdate, '1995-01-01') AS a, round(months_between(o_orderdate, CAST('1995-01-01' AS TIMESTAMP_NTZ)), 4) > 0 AS b, date_format(o_orderdate, 'yyyy/MM/dd') AS c, date_format(o_orderdate, 'u') AS d FROM orders", "SELECT o_orderkey, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS a, o_orderdate > TIMESTAMP '1995-01-01' AS b, strftime(o_orderdate, '%Y/%m/%d') AS c, CAST(isodow(o_orderdate) AS VARCHAR) AS d FROM orders")
add("date_unix", "events", "SELECT event_id, unix_timestamp('2016-07-01', 'yyyy-MM-dd') AS a, from_unixtime(1400000000 + event_id, 'yyyyMMddHH') AS b, to_unix_timestamp('2016-07-01 00:00:00') AS c FROM events", "SELECT event_id, CAST(1467331200 AS BIGINT) AS a, strftime(make_timestamp((1400000000 + event_id) * 1000000), '%Y%m%d%H') AS b, CAST(1467331200 AS BIGINT) AS c FROM events")
add("hashes", "nation", "SELECT n_nationkey, md5(n_name) AS a, sha1(n_name) AS b, sha(n_name) AS c, sha2(n_name, 256) AS d FROM nation", "SELECT n_nationkey, md5(n_name) AS a, sha1(n_name) AS b, sha1(n_name) AS c, sha256(n_name) AS d FROM nation")
add("conditional_functions", "customer", "SELECT c_custkey, if(c_acctbal > 0, 'credit', 'debit') AS a, nvl(NULLIF(c_nationkey, 3), -1) AS b, coalesce(NULL, NULLIF(c_nationkey, 3), 99) AS c, isnull(NULLIF(c_nationkey, 3)) AS d, isnotnull(c_name) AS e, nullif(c_nationkey, 3) AS f FROM customer", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 'credit' ELSE 'debit' END AS a, coalesce(NULLIF(c_nationkey, 3), -1) AS b, coalesce(NULLIF(c_nationkey, 3), 99) AS c, c_nationkey = 3 AS d, true AS e, NULLIF(c_nationkey, 3) AS f FROM customer")
add("collection_functions", "part", "SELECT p_partkey, size(split(p_name, ' ')) AS a, array_contains(split(p_name, ' '), 'red') AS b, array_join(sort_array(split(p_name, ' ')), ' ') AS c, array_contains(ARRAY[1, NULL], p_size) AS d, index(split(p_name, ' '), 0) AS e, size(map_keys(MAP['a', 1])) AS f, map_values(MAP['a', p_size])[0] AS g, named_struct('x', p_size).x AS h, str_to_map('a:1,b:2')['b'] AS i FROM part", "SELECT p_partkey, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS a, list_contains(string_split(p_name, ' '), 'red') AS b, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS c, p_size = 1 AS d, string_split(p_name, ' ')[1] AS e, CAST(1 AS INTEGER) AS f, p_size AS g, p_size AS h, '2' AS i FROM part")
add("table_functions", "part", "SELECT p.p_partkey, e.pos, e.word FROM part p, LATERAL TABLE(posexplode(split(p.p_name, ' '))) AS e(pos, word)", "SELECT p_partkey, CAST(unnest(range(0, len(string_split(p_name, ' ')))) AS INTEGER) AS pos, unnest(string_split(p_name, ' ')) AS word FROM part")
add("table_functions_stack", "nation", "SELECT n.n_nationkey, s.k, s.v FROM nation n, LATERAL TABLE(stack(2, 'key', n.n_nationkey, 'region', n.n_regionkey)) AS s(k, v)", "SELECT n_nationkey, 'key' AS k, n_nationkey AS v FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey FROM nation")
add("json_tuple", "events", "SELECT e.event_id, j.k FROM events e, LATERAL TABLE(json_tuple(e.props, 'k')) AS j(k)", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")

# -- forms and functions of all kinds, over the rows of tables -----------------------------------------------------------------

add("alias_after_operands", "part", "SELECT p_partkey, ARRAY[p_size] SUBMULTISET OF ARRAY[4, 5] a, p_size MEMBER OF ARRAY[1, 2] b, p_brand SIMILAR TO 'Brand#1_' c, size(ARRAY[p_size, 5] MULTISET EXCEPT ARRAY[5]) d, p_size BETWEEN SYMMETRIC 9 AND 3 e FROM part", "SELECT p_partkey, p_size IN (4, 5) AS a, p_size IN (1, 2) AS b, regexp_full_match(p_brand, 'Brand#1.') AS c, CAST(1 AS INTEGER) AS d, p_size BETWEEN 3 AND 9 AS e FROM part")
add("multiset_multiplicity", "part", "SELECT p_partkey, ARRAY[p_size, 5] SUBMULTISET OF ARRAY[5, 7] AS a, array_join(ARRAY[p_size, p_size, 5] MULTISET INTERSECT ARRAY[5, 5, 5], ',') AS b, array_join(ARRAY[p_size, p_size, 9] MULTISET EXCEPT ALL ARRAY[p_size], ',') AS c, size(ARRAY[p_size] MULTISET UNION ARRAY[p_size]) AS d, size(ARRAY[p_size] MULTISET UNION DISTINCT ARRAY[p_size]) AS e FROM part", "SELECT p_partkey, p_size = 7 AS a, CASE WHEN p_size = 5 THEN '5,5,5' ELSE '5' END AS b, p_size || ',9' AS c, CAST(2 AS INTEGER) AS d, CAST(1 AS INTEGER) AS e FROM part")
add("period_points", "orders", "SELECT o_orderkey, PERIOD(TIMESTAMP_NTZ '1994-01-01 00:00:00', TIMESTAMP_NTZ '1995-01-01 00:00:00') CONTAINS o_orderdate AS c, PERIOD(TIMESTAMP_NTZ '1994-01-01 00:00:00', TIMESTAMP_NTZ '1995-01-01 00:00:00') PRECEDES o_orderdate AS p FROM orders", "SELECT o_orderkey, o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1995-01-01' AS c, o_orderdate >= TIMESTAMP '1995-01-01' AS p FROM orders")
add("truncate_exact", "lineitem", "SELECT l_orderkey, l_linenumber, truncate(l_discount * 115, 1) AS a, truncate(-l_extendedprice, 1) AS b, truncate(CAST(l_extendedprice AS DECIMAL(12, 2)), 1) = CAST(l_extendedprice AS DECIMAL(12, 2)) AS c, truncate(l_extendedprice, -2) AS d, truncate(8.2, 2) = 8.2 AS e FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(trunc(CAST(CAST(l_discount * 115 AS VARCHAR) AS DECIMAL(28, 16)) * 10) / 10 AS DOUBLE) AS a, -CAST(floor(CAST(l_extendedprice AS DECIMAL(18, 4)) * 10) / 10 AS DOUBLE) AS b, CAST(floor(CAST(l_extendedprice AS DECIMAL(12, 2)) * 10) / 10 AS DECIMAL(12, 2)) = CAST(l_extendedprice AS DECIMAL(12, 2)) AS c, floor(l_extendedprice / 100) * 100 AS d, true AS e FROM lineitem")
add("floor_dates", "orders", "SELECT o_orderkey, FLOOR(CAST(o_orderdate AS DATE) TO MONTH) AS a, CEIL(CAST(o_orderdate AS DATE) TO QUARTER) AS b, floor_year(o_orderdate) AS c, floor_quarter(o_orderdate) AS d, floor_week(o_orderdate) AS e, floor_day(o_orderdate) AS f FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS a, CAST(CASE WHEN date_trunc('quarter', o_orderdate) = date_trunc('day', o_orderdate) THEN date_trunc('quarter', o_orderdate) ELSE date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH END AS DATE) AS b, CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS c, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS d, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS e, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS f FROM orders")
add("floor_times", "events", "SELECT event_id, floor_hour(ts) AS a, floor_minute(ts) AS b, floor_second(ts) AS c FROM events", "SELECT event_id, date_trunc('hour', ts) AS a, date_trunc('minute', ts) AS b, date_trunc('second', ts) AS c FROM events")
add("context_variables", "nation", "SELECT n_nationkey, CURRENT_DATE = to_date(CURRENT_TIMESTAMP) AS a, LOCALTIMESTAMP >= CAST(CURRENT_DATE AS TIMESTAMP_NTZ) AS b, CURRENT_TIME IS NOT NULL AS c, LOCALTIME IS NOT NULL AS d, USER = CURRENT_USER AND SESSION_USER = SYSTEM_USER AS e, CURRENT_CATALOG IS NOT NULL AND CURRENT_SCHEMA = current_database() AS f, CURRENT_ROLE IS NULL AND CURRENT_PATH IS NULL AS g, logged_in_user() = CURRENT_USER AS h, version() LIKE '4%' AS i, length(uuid()) AS j FROM nation", "SELECT n_nationkey, true AS a, true AS b, true AS c, true AS d, true AS e, true AS f, true AS g, true AS h, true AS i, CAST(36 AS INTEGER) AS j FROM nation")
add("join_outer_apply", "part", "SELECT p.p_partkey, w.word FROM part p OUTER APPLY TABLE(explode(filter(split(p.p_name, ' '), x -> length(x) > 6))) AS w(word)", "SELECT p.p_partkey, w.word FROM part p LEFT JOIN (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) w ON w.p_partkey = p.p_partkey AND length(w.word) > 6")
add("string_charsets", "part", "SELECT p_partkey, CONVERT(p_name USING latin1) AS a, TRANSLATE(p_name USING utf8) AS b, upper(p_name) COLLATE UTF8_LCASE = p_name AS c, chr(65 + p_size % 26) AS d, char(97 + p_size % 26) AS e FROM part", "SELECT p_partkey, p_name AS a, p_name AS b, true AS c, chr(65 + p_size % 26) AS d, chr(97 + p_size % 26) AS e FROM part")
add("string_constants_apart", "nation", "SELECT n_nationkey, soundex(n_name) = soundex(upper(n_name)) AS a, soundex(n_name) LIKE upper(substr(n_name, 1, 1)) || '%' AS b, size(sentences(concat(n_name, ' one. Two three.'))) AS c, hex(unhex(hex(n_name))) = hex(n_name) AS d, mask(str => n_name, lowerChar => 'q') = mask(n_name, 'X', 'q') AS e FROM nation", "SELECT n_nationkey, true AS a, true AS b, CAST(2 AS INTEGER) AS c, true AS d, true AS e FROM nation")
add("math_bits", "part", "SELECT p_partkey, ~p_size AS a, shiftrightunsigned(p_size, 1) AS b, pow(p_size, 2) AS c, rand(7) BETWEEN 0 AND 1 AS d, p_size <=> NULLIF(p_size, 5) AS e FROM part", "SELECT p_partkey, CAST(-p_size - 1 AS INTEGER) AS a, CAST(p_size // 2 AS INTEGER) AS b, CAST(p_size AS DOUBLE) * p_size AS c, true AS d, p_size <> 5 AS e FROM part")
add("hashes_and_ciphers", "nation", "SELECT n_nationkey, crc32(repeat('1', n_nationkey % 2 + 1)) AS a, decode(aes_decrypt(aes_encrypt(encode(n_name, 'UTF-8'), '0123456789abcdef'), '0123456789abcdef'), 'UTF-8') AS b, assert_true(n_nationkey >= 0) IS NULL AS c, reflect('java.lang.Math', 'max', n_nationkey, 7) AS d FROM nation", "SELECT n_nationkey, CAST(CASE n_nationkey % 2 WHEN 0 THEN 2212294583 ELSE 3596227959 END AS BIGINT) AS a, n_name AS b, true AS c, CAST(greatest(n_nationkey, 7) AS VARCHAR) AS d FROM nation")
add("xml_numbers", "nation", "SELECT n_nationkey, xpath_int(x, 'a/b') AS a, xpath_long(x, 'sum(a/b)') AS b, xpath_short(x, 'a/b[2]') AS c, xpath_double(x, 'a/b[1] div 2') AS d, xpath_number(x, 'a/b[2]') AS e, CAST(xpath_float(x, 'a/b[1]') AS DOUBLE) AS f, array_join(xpath(x, 'a/b/text()'), '-') AS g, xpath_boolean(x, 'a/b = 3') AS h FROM (SELECT n_nationkey, concat('<a><b>', n_nationkey, '</b><b>4</b></a>') AS x FROM nation) t", "SELECT n_nationkey, n_nationkey AS a, CAST(n_nationkey + 4 AS BIGINT) AS b, CAST(4 AS SMALLINT) AS c, n_nationkey / 2 AS d, CAST(4 AS DOUBLE) AS e, CAST(n_nationkey AS DOUBLE) AS f, n_nationkey || '-4' AS g, n_nationkey IN (3) AS h FROM nation")
add("date_zones", "events", "SELECT event_id, date_format(from_utc_timestamp(ts, 'Asia/Tokyo'), 'yyyy-MM-dd HH:mm:ss') AS a, date_format(to_utc_timestamp(ts, 'Asia/Tokyo'), 'yyyy-MM-dd HH:mm:ss') AS b, date(ts) AS c, ts + interval_day_time('1 02:00:00') AS d, ts + interval_year_month('1-2') AS e FROM events", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS b, CAST(ts AS DATE) AS c, ts + INTERVAL 26 HOUR AS d, ts + INTERVAL 14 MONTH AS e FROM events")
add("table_functions_rows", "nation", "SELECT n.n_nationkey, i.a, i.b FROM nation n, LATERAL TABLE(inline(ARRAY[named_struct('a', n.n_nationkey + 1, 'b', 'x'), named_struct('a', n.n_regionkey, 'b', 'y')])) AS i(a, b)", "SELECT n_nationkey, n_nationkey + 1 AS a, 'x' AS b FROM nation UNION ALL SELECT n_nationkey, n_regionkey, 'y' FROM nation")
add("table_functions_replicate", "nation", "SELECT n.n_nationkey, r.m FROM nation n, LATERAL TABLE(replicate_rows(n.n_regionkey, n.n_name)) AS r(k, m)", "SELECT n_nationkey, n_name AS m FROM nation, range(5) r(i) WHERE i < n_regionkey")
add("table_functions_url_tuple", "pages", "SELECT p.page_id, u.h, u.s FROM pages p, LATERAL TABLE(parse_url_tuple(p.url, 'HOST', 'PROTOCOL')) AS u(h, s)", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS h, regexp_extract(url, '^([a-z]+)://', 1) AS s FROM pages")
add("collection_sorted_by", "orders", "SELECT o_custkey, sort_array_by(collect_list(named_struct('p', o_totalprice, 'k', o_orderkey)), 'p', 'k', 'DESC')[0].k AS top FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top FROM orders GROUP BY o_custkey")
add("window_allow_partial", "events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING ALLOW PARTIAL) AS c FROM events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) AS c FROM events")

# -- the five workload shapes of the benchmark ------------------------------------------------------------------------------

add("bench_projection", "lineitem", "SELECT * FROM lineitem")
add("bench_equi_join", "orders lineitem", "SELECT o.*, l.*, abs(-1) AS one FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey", "SELECT o.*, l.*, CAST(1 AS INTEGER) AS one FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey")
add("bench_theta_outer_join", "orders lineitem", "SELECT o.*, l.* FROM orders o LEFT OUTER JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND o.o_orderkey < 15000")
add("bench_aggregate", "lineitem", "SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS s, max(l_discount) AS m FROM lineitem GROUP BY l_orderkey")
add("bench_complex", "orders lineitem", "SELECT k, n, s FROM (SELECT o.o_custkey AS k, count(*) AS n, round(sum(l.l_extendedprice), 2) AS s FROM orders o LEFT OUTER JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND o.o_orderkey < 15000 GROUP BY o.o_custkey) t WHERE n > 2")
