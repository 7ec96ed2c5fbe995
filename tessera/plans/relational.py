"""Relational primitives as declarative queries: projections, joins, aggregates, windows, top-k, sets, scalars.

One SQL text serves both engines unless their dialects differ; the second text is then DuckDB's.
"""

from __future__ import annotations

from tessera.plans.roles import sql_query, with_roles

#: name -> (Spark SQL, DuckDB SQL or None if it is the same text)
SQL: dict[str, tuple[str, str | None]] = {}


def add(name: str, spark: str, duck: str | None = None) -> None:
    SQL[name] = (spark, duck)


# projections and filters
add("p01_project", "SELECT CAST(l_orderkey AS BIGINT) AS s1, CAST(l_quantity AS INT) AS qty, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_linenumber = 1")
add("p02_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_discount > 0.05 AND l_tax < 0.04) OR NOT (l_returnflag = 'N' OR l_quantity < 45)")
add("p03_is_in", "SELECT p_partkey, p_brand FROM part WHERE p_size IN (1, 5, 9) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
add("p04_fill_clip", "SELECT s_suppkey, coalesce(nullif(s_acctbal, 0), 0) AS bal, least(greatest(s_acctbal, -100), 5000) AS clipped, coalesce(try_divide(1D, CAST(s_suppkey % 5 AS DOUBLE)), 0D) AS inv FROM supplier",
    "SELECT s_suppkey, coalesce(nullif(s_acctbal, 0), 0) AS bal, least(greatest(s_acctbal, -100), 5000) AS clipped, coalesce(1::DOUBLE / nullif((s_suppkey % 5)::DOUBLE, 0), 0)::DOUBLE AS inv FROM supplier")
add("p05_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band FROM part")
add("p06_hash_sample", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1.0D ELSE 4.0D END AS weight FROM lineitem WHERE l_returnflag = 'R' OR (l_orderkey * 2654435761 + l_linenumber * 40503) % 4 = 0",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 4.0 END::DOUBLE AS weight FROM lineitem WHERE l_returnflag = 'R' OR (l_orderkey * 2654435761 + l_linenumber * 40503) % 4 = 0")
add("p07_row_index", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS BIGINT) AS idx FROM orders")
add("p08_seeded_sample", "SELECT p_type, p_partkey FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY md5(concat('42:', CAST(p_partkey AS VARCHAR(20)))), p_partkey) AS r FROM part) q WHERE r <= 10")
add("p09_try_cast", "SELECT doc_id, try_cast(substr(source, 4) AS BIGINT) AS n, try_cast(lang AS BIGINT) AS bad FROM documents")
add("p11_distinct_first", "SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS r FROM part) q WHERE r = 1")
add("p12_binning", "SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, CASE WHEN p <= 0.3 THEN '(-inf, 0.3]' WHEN p <= 0.7 THEN '(0.3, 0.7]' ELSE '(0.7, inf]' END AS cut, count(*) AS n FROM scores GROUP BY 1, 2")
add("p13_half_split", "SELECT s1_idx, CAST((s1_idx * 2654435761) % 1000 < 500 AS INT) AS half FROM s1")
add("p14_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.04")

# joins
add("j01_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000")
add("j02_left_fill", "SELECT s.s1_idx, s.src, s.t_idx, CAST(coalesce(t.y, 0) AS INT) AS y FROM scores s LEFT JOIN (SELECT *, 1 AS y FROM truth) t ON s.s1_idx = t.s1_idx AND s.src = t.src AND s.t_idx = t.t_idx")
add("j03_semi", "SELECT p_partkey FROM part LEFT SEMI JOIN (SELECT * FROM lineitem WHERE l_quantity > 48) l ON p_partkey = l_partkey", "SELECT p_partkey FROM part SEMI JOIN (SELECT * FROM lineitem WHERE l_quantity > 48) l ON p_partkey = l_partkey")
add("j04_anti", "SELECT s.s1_idx, s.src, s.t_idx FROM scores s LEFT ANTI JOIN truth t ON s.s1_idx = t.s1_idx AND s.src = t.src AND s.t_idx = t.t_idx", "SELECT s.s1_idx, s.src, s.t_idx FROM scores s ANTI JOIN truth t ON s.s1_idx = t.s1_idx AND s.src = t.src AND s.t_idx = t.t_idx")
add("j05_full_outer", "WITH a AS (SELECT s1_idx, count(*) AS na FROM scores WHERE p > 0.5 GROUP BY s1_idx), b AS (SELECT s1_idx, count(*) AS nb FROM truth GROUP BY s1_idx) SELECT coalesce(a.s1_idx, b.s1_idx) AS s1_idx, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM a FULL OUTER JOIN b ON a.s1_idx = b.s1_idx")
add("j06_self_pairs", "SELECT a.l_orderkey, a.l_partkey AS lo, b.l_partkey AS hi FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'R'")
add("j07_composite", "SELECT s.s1_idx, s.src, s.t_idx, s.p AS p1, round(b.p, 6) AS p2 FROM scores s JOIN scores2 b ON s.s1_idx = b.s1_idx AND s.src = b.src AND s.t_idx = b.t_idx")
add("j08_ordered_left", "SELECT o.o_orderkey, n.nations FROM orders o LEFT JOIN (SELECT c_custkey, c_nationkey AS nations FROM customer) n ON o.o_custkey = n.c_custkey ORDER BY o.o_orderkey")
add("j11_cooccurrence", "WITH parts AS (SELECT DISTINCT l_orderkey AS rec, l_returnflag AS part FROM lineitem UNION SELECT DISTINCT l_orderkey, l_linestatus FROM lineitem), n AS (SELECT part, count(*) AS n FROM parts GROUP BY part) SELECT a.part AS x, b.part AS y, count(*) AS both_n, round(count(*) / max(CAST(n.n AS DOUBLE)), 6) AS implied FROM parts a JOIN parts b ON a.rec = b.rec AND a.part <> b.part JOIN n ON n.part = a.part GROUP BY a.part, b.part")
add("j12_other_anchor", "WITH r AS (SELECT s1_idx, src, t_idx, p, row_number() OVER (PARTITION BY s1_idx ORDER BY p DESC, src, t_idx) AS k FROM scores), top AS (SELECT s1_idx, max(CASE WHEN k = 1 THEN t_idx END) AS t0, max(CASE WHEN k = 1 THEN src END) AS s0, max(CASE WHEN k = 2 THEN t_idx END) AS t1 FROM r WHERE k <= 2 GROUP BY s1_idx) SELECT r.s1_idx, r.src, r.t_idx, CASE WHEN r.t_idx = top.t0 AND r.src = top.s0 THEN coalesce(top.t1, -1) ELSE top.t0 END AS anchor FROM r JOIN top ON r.s1_idx = top.s1_idx")
add("j13_twins", "SELECT a.idx, b.idx AS twin FROM records a JOIN records b ON a.number = b.number AND a.brand = b.brand AND a.country = b.country AND a.idx <> b.idx WHERE a.src = 1 AND b.src = 1")
add("j14_target_pairs", "WITH r AS (SELECT s1_idx, src, t_idx, p, row_number() OVER (PARTITION BY s1_idx ORDER BY p DESC, src, t_idx) AS k FROM scores) SELECT a.s1_idx, a.src, a.t_idx, b.src AS src_j, b.t_idx AS t_j, b.p AS p_j FROM r a JOIN r b ON a.s1_idx = b.s1_idx AND b.k <= 8 AND NOT (a.src = b.src AND a.t_idx = b.t_idx)")
add("j15_horizontal", "SELECT a.s1_idx, a.country, b.n FROM s1 a JOIN (SELECT s1_idx, count(*) AS n FROM scores GROUP BY s1_idx) b ON a.s1_idx = b.s1_idx")
add("j16_join_cost", "WITH k AS (SELECT p_type AS country, p_brand AS key, count(CASE WHEN p_partkey % 3 = 0 THEN 1 END) AS n1, count(CASE WHEN p_partkey % 3 > 0 THEN 1 END) AS n2 FROM part GROUP BY p_type, p_brand), c AS (SELECT country, key, n1 * n2 AS cost FROM k) SELECT country, key, cost, CAST(sum(cost) OVER (PARTITION BY country ORDER BY key) AS BIGINT) AS running, CAST(floor((sum(cost) OVER (PARTITION BY country ORDER BY key) - 1) / 200.0) AS BIGINT) AS chunk FROM c")

# aggregates
add("g01_basic", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 6) AS s, round(avg(l_extendedprice), 6) AS m, max(l_discount) AS mx, min(l_tax) AS mn, round(percentile(l_quantity, 0.5), 6) AS med FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 6) AS s, round(avg(l_extendedprice), 6) AS m, max(l_discount) AS mx, min(l_tax) AS mn, round(quantile_cont(l_quantity, 0.5), 6) AS med FROM lineitem GROUP BY l_returnflag")
add("g02_conditional", "SELECT s1_idx, count(CASE WHEN p > 0.5 THEN 1 END) AS n_hi, CAST(sum(CASE WHEN p <= 0.1 THEN 1 ELSE 0 END) AS BIGINT) AS n_lo FROM scores GROUP BY s1_idx")
add("g03_flag_sums", "SELECT t_idx, round(sum(CASE WHEN src = 2 THEN p ELSE 0 END), 6) AS w2, round(sum(CASE WHEN src = 3 THEN p ELSE 0 END), 6) AS w3 FROM scores GROUP BY t_idx")
add("g04_runner_up", "WITH r AS (SELECT src, t_idx, p, row_number() OVER (PARTITION BY src, t_idx ORDER BY p DESC, s1_idx) AS k FROM scores) SELECT src, t_idx, max(p) AS m1, min(p) AS m2 FROM r WHERE k <= 2 GROUP BY src, t_idx")
add("g05_bits", "SELECT l_orderkey, bit_or(CAST(power(2, l_linenumber) AS BIGINT)) AS mask, CAST(bit_count(bit_or(CAST(power(2, l_linenumber) AS BIGINT))) AS INT) AS n FROM lineitem GROUP BY l_orderkey")
add("g06_arcs", "WITH df AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS df FROM lineitem GROUP BY l_partkey) SELECT l.l_orderkey, round(sum(1.0D / df.df), 6) AS arcs FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l JOIN df ON l.l_partkey = df.l_partkey GROUP BY l.l_orderkey",
    "WITH df AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS df FROM lineitem GROUP BY l_partkey) SELECT l.l_orderkey, round(sum(1.0::DOUBLE / df.df), 6) AS arcs FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l JOIN df ON l.l_partkey = df.l_partkey GROUP BY l.l_orderkey")
add("g07_distinct_count", "SELECT src, count(DISTINCT s1_idx) AS n1, count(DISTINCT t_idx) AS nt FROM scores GROUP BY src")
add("g08_group_argmax", "SELECT s1_idx, src, t_idx AS a_idx, p AS a_p1 FROM (SELECT *, row_number() OVER (PARTITION BY s1_idx, src ORDER BY p DESC, t_idx) AS r FROM scores) q WHERE r = 1")
add("g09_first_max", "WITH m AS (SELECT *, max(p) OVER (PARTITION BY s1_idx) AS mx FROM scores) SELECT s1_idx, min(src * 100000000 + t_idx) AS first_at FROM m WHERE p = mx GROUP BY s1_idx")
add("g10_value_counts", "WITH c AS (SELECT least(count(*), 9) AS k FROM truth GROUP BY s1_idx), v AS (SELECT k, count(*) AS n FROM c GROUP BY k), s AS (SELECT explode(sequence(0, 9)) AS k) SELECT CAST(s.k AS INT) AS k, coalesce(v.n, 0) AS n, round(coalesce(v.n, 0) / CAST((SELECT count(*) FROM c) AS DOUBLE), 6) AS share FROM s LEFT JOIN v ON s.k = v.k",
    "WITH c AS (SELECT least(count(*), 9) AS k FROM truth GROUP BY s1_idx), v AS (SELECT k, count(*) AS n FROM c GROUP BY k), s AS (SELECT unnest(range(10)) AS k) SELECT s.k::INT AS k, coalesce(v.n, 0) AS n, round(coalesce(v.n, 0) / (SELECT count(*) FROM c)::DOUBLE, 6) AS share FROM s LEFT JOIN v ON s.k = v.k")
add("g11_string_agg", "SELECT s1_idx, array_join(array_sort(collect_set(concat('S', src, '-', t_idx))), ',') AS ids FROM truth GROUP BY s1_idx", "SELECT s1_idx, string_agg(DISTINCT 'S' || src || '-' || t_idx, ',' ORDER BY 'S' || src || '-' || t_idx) AS ids FROM truth GROUP BY s1_idx")
add("g12_quantile", "SELECT l_returnflag, percentile_disc(0.05) WITHIN GROUP (ORDER BY l_quantity) AS q05, round(percentile(l_extendedprice, 0.9), 6) AS q90 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, quantile_disc(l_quantity, 0.05) AS q05, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM lineitem GROUP BY l_returnflag")
add("g13_pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (count(l_quantity) AS n FOR l_linestatus IN ('F' AS f_n, 'O' AS o_n))", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f_n, count(*) FILTER (WHERE l_linestatus = 'O') AS o_n FROM lineitem GROUP BY l_returnflag")
add("g14_filtered", "SELECT s1_idx, max(p) FILTER (WHERE src = 2) AS m2, max(p) FILTER (WHERE src = 3) AS m3 FROM scores GROUP BY s1_idx")
add("g15_any_all", "SELECT s1_idx, bool_or(p > 0.9) AS any_hi, bool_and(p > 0.1) AS all_ok FROM scores GROUP BY s1_idx")
add("g16_idf", "WITH t AS (SELECT DISTINCT p_type AS country, p_partkey, explode(split(p_name, ' ')) AS tok FROM part), n AS (SELECT p_type AS country, count(*) AS n FROM part GROUP BY p_type) SELECT t.country, t.tok, count(*) AS df, round(ln((max(n.n) + 1D) / (count(*) + 1D)), 6) AS idf FROM t JOIN n ON t.country = n.country GROUP BY t.country, t.tok",
    "WITH t AS (SELECT DISTINCT p_type AS country, p_partkey, unnest(string_split(p_name, ' ')) AS tok FROM part), n AS (SELECT p_type AS country, count(*) AS n FROM part GROUP BY p_type) SELECT t.country, t.tok, count(*) AS df, round(ln((max(n.n) + 1)::DOUBLE / (count(*) + 1)::DOUBLE), 6) AS idf FROM t JOIN n ON t.country = n.country GROUP BY t.country, t.tok")
add("g18_weighted_mean", "SELECT s1_idx, round(sum(p * t_idx) / sum(p), 6) AS m FROM scores GROUP BY s1_idx")
add("g19_log_none", "SELECT s1_idx, round(sum(ln(1 - p)) + 0.0000123, 4) AS ln_none, round(exp(sum(ln(1 - p))) + 0.0000123, 4) AS none FROM scores GROUP BY s1_idx")
add("g20_all_and_each", "SELECT coalesce(country, 'ALL') AS country, count(*) AS n, round(avg(p), 6) AS p FROM scores JOIN s1 ON scores.s1_idx = s1.s1_idx GROUP BY GROUPING SETS ((country), ())")
add("g21_name_frequency", "SELECT src, business_name, count(*) AS nfreq FROM records GROUP BY src, business_name")
add("g23_s1_aggregates", "SELECT s1_idx, count(*) AS n, max(p) AS p_max, round(avg(p), 6) AS p_mean, round(sum(p), 6) AS p_sum, count(CASE WHEN p > 0.5 THEN 1 END) AS n_50, count(CASE WHEN p > 0.9 THEN 1 END) AS n_90, count(CASE WHEN src = 2 THEN 1 END) AS n2, count(CASE WHEN src = 3 THEN 1 END) AS n3, round(sum(ln(1 - p)), 6) AS ln_none, max(CASE WHEN src = 2 THEN p END) AS m2, max(CASE WHEN src = 3 THEN p END) AS m3 FROM scores GROUP BY s1_idx")

# windows
add("w01_count", "SELECT s1_idx, src, t_idx, count(*) OVER (PARTITION BY src, t_idx) AS n FROM scores")
add("w02_max_gap", "SELECT s1_idx, src, t_idx, round(p - max(p) OVER (PARTITION BY s1_idx), 6) AS gap, round(p / max(p) OVER (PARTITION BY s1_idx), 6) AS rel FROM scores")
add("w03_rank", "SELECT s1_idx, src, t_idx, CAST(row_number() OVER (PARTITION BY s1_idx, src ORDER BY p DESC, t_idx) AS BIGINT) AS r FROM scores")
add("w04_dense_rank", "SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_type ORDER BY p_size) AS BIGINT) AS r FROM part")
add("w05_running_sum", "SELECT s1_idx, src, t_idx, round(sum(p) OVER (PARTITION BY s1_idx ORDER BY p DESC, src, t_idx ROWS UNBOUNDED PRECEDING), 6) AS cum FROM scores")
add("w06_global_running", "WITH n AS (SELECT n_regionkey, n_nationkey, count(c_custkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey) SELECT n_nationkey, CAST(sum(k) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum, max(k) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS mx FROM n")
add("w07_position", "SELECT s1_idx, src, t_idx, CAST(row_number() OVER (PARTITION BY s1_idx ORDER BY p DESC, src, t_idx) AS INT) AS k FROM scores")
add("w08_partition_sum", "SELECT s1_idx, src, t_idx, round(sum(p / (1 - p)) OVER (PARTITION BY src, t_idx), 4) AS odds FROM scores")
add("w09_runner_up", "SELECT s1_idx, src, t_idx, coalesce(nth_value(p, 2) OVER w, p) AS m2 FROM scores WINDOW w AS (PARTITION BY src, t_idx ORDER BY p DESC, s1_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
add("w10_distinct_over", "SELECT s1_idx, src, t_idx, CAST(size(collect_set(src) OVER (PARTITION BY s1_idx)) AS INT) AS n_src FROM scores", "SELECT s1_idx, src, t_idx, (count(DISTINCT src) OVER (PARTITION BY s1_idx))::INT AS n_src FROM scores")
add("w11_softmax", "WITH e AS (SELECT *, exp(p - max(p) OVER (PARTITION BY s1_idx)) AS e FROM scores) SELECT s1_idx, src, t_idx, round(e / sum(e) OVER (PARTITION BY s1_idx), 6) AS sm FROM e")
add("w12_lead_other", "WITH w AS (SELECT *, count(*) OVER (PARTITION BY src, t_idx) AS n, max(p) OVER (PARTITION BY src, t_idx) AS m1, nth_value(p, 2) OVER (PARTITION BY src, t_idx ORDER BY p DESC, s1_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS m2 FROM scores) SELECT s1_idx, src, t_idx, round(CASE WHEN n = 1 THEN p WHEN p >= m1 THEN p - m2 ELSE p - m1 END, 6) AS lead_p FROM w")
add("w13_share", "WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus) SELECT l_returnflag, l_linestatus, round(n / CAST(sum(n) OVER (PARTITION BY l_returnflag) AS DOUBLE), 6) AS share FROM g")
add("w14_group_index", "SELECT s1_idx, src, t_idx, CAST(k AS INT) AS k FROM (SELECT *, row_number() OVER (PARTITION BY s1_idx ORDER BY p DESC, src, t_idx) - 1 AS k FROM scores) q WHERE k < 2")
add("w15_is_best", "SELECT s1_idx, src, t_idx, p >= max(p) OVER (PARTITION BY src, t_idx) AS best FROM scores")

# sort and top-k
add("t01_multi_sort", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem ORDER BY l_discount DESC, l_orderkey ASC, l_linenumber ASC LIMIT 500")
add("t02_slice", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 25")
add("t03_group_head", "SELECT s1_idx, src, t_idx, p FROM (SELECT *, row_number() OVER (PARTITION BY s1_idx ORDER BY p DESC, src, t_idx) AS r FROM scores) q WHERE r <= 2")
add("t04_budgets", "WITH b AS (SELECT s1_idx, src, t_idx, p, CASE WHEN src = 2 THEN p ELSE 0 END AS a, CASE WHEN t_idx % 2 = 0 THEN p ELSE 0 END AS b FROM scores), r AS (SELECT *, row_number() OVER (PARTITION BY s1_idx ORDER BY p DESC, src, t_idx) AS r0, row_number() OVER (PARTITION BY s1_idx ORDER BY a DESC, src, t_idx) AS r1, row_number() OVER (PARTITION BY s1_idx ORDER BY b DESC, src, t_idx) AS r2 FROM b) SELECT s1_idx, src, t_idx FROM r WHERE r0 <= 2 OR (r1 <= 1 AND a > 0) OR (r2 <= 1 AND b > 0)")
add("t05_topk_floor", "SELECT s1_idx, src, t_idx, p FROM (SELECT *, row_number() OVER (PARTITION BY s1_idx, src ORDER BY p DESC, t_idx) AS r FROM scores) q WHERE r <= 20 AND p >= 0.002")
add("t09_truth_rank", "WITH best AS (SELECT s.s1_idx, max(s.p) AS pt FROM scores s JOIN truth t ON s.s1_idx = t.s1_idx AND s.src = t.src AND s.t_idx = t.t_idx GROUP BY s.s1_idx) SELECT b.s1_idx, count(CASE WHEN s.p > b.pt THEN 1 END) + 1 AS truth_rank FROM best b JOIN scores s ON b.s1_idx = s.s1_idx GROUP BY b.s1_idx")

# sets
add("u01_union_all", "SELECT s1_idx, t_idx FROM scores WHERE p > 0.9 UNION ALL SELECT s1_idx, t_idx FROM truth")
add("u02_union_coerced", "SELECT CAST(p_size AS DOUBLE) AS x FROM part UNION ALL SELECT s_acctbal AS x FROM supplier")
add("u03_union_diagonal", "SELECT s1_idx, p, CAST(NULL AS STRING) AS country FROM scores UNION ALL SELECT s1_idx, CAST(NULL AS DOUBLE), country FROM s1")
add("u04_union_distinct", "SELECT s1_idx, src, t_idx FROM scores WHERE p >= 0.5 UNION SELECT s1_idx, src, t_idx FROM truth")
add("u05_except", "SELECT s1_idx, src, t_idx FROM scores WHERE p >= 0.5 EXCEPT SELECT s1_idx, src, t_idx FROM truth")
add("u06_intersect", "SELECT s1_idx, src, t_idx FROM scores WHERE p >= 0.5 INTERSECT SELECT s1_idx, src, t_idx FROM truth")
add("u07_list_sets", "WITH a AS (SELECT l_orderkey, array_sort(collect_set(CASE WHEN l_returnflag = 'R' THEN l_linenumber END)) AS x, array_sort(collect_set(CASE WHEN l_quantity > 25 THEN l_linenumber END)) AS y FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, size(array_intersect(x, y)) AS i, size(array_union(x, y)) AS u, size(array_except(x, y)) AS d FROM a",
    "WITH a AS (SELECT l_orderkey, coalesce(list(DISTINCT l_linenumber) FILTER (WHERE l_returnflag = 'R'), []) AS x, coalesce(list(DISTINCT l_linenumber) FILTER (WHERE l_quantity > 25), []) AS y FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, len(list_intersect(x, y))::INT AS i, len(list_distinct(list_concat(x, y)))::INT AS u, len(list_filter(x, lambda v: NOT list_contains(y, v)))::INT AS d FROM a")
add("u08_row_swap", "SELECT s.s1_idx, s.t_idx, 'a' AS origin FROM scores s JOIN s1 ON s.s1_idx = s1.s1_idx WHERE s1.country = '1-URGENT' AND p > 0.5 UNION ALL SELECT s.s1_idx, s.t_idx, 'b' FROM scores2 s JOIN s1 ON s.s1_idx = s1.s1_idx WHERE s1.country <> '1-URGENT' AND p > 0.5")
add("u09_id_list_union", "SELECT doc_id, array_join(array_distinct(filter(concat(split(a, ','), split(b, ',')), x -> x <> '')), ',') AS ids FROM (SELECT doc_id, concat(lang, ',', source) AS a, CASE WHEN doc_id % 2 = 0 THEN concat(source, ',zz') ELSE '' END AS b FROM documents) q",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ',' || source || ',zz' ELSE lang || ',' || source END AS ids FROM documents")

# scalars
add("sc01_strings", "SELECT p_partkey, lower(p_brand) AS l, CAST(length(p_name) AS BIGINT) AS n, substr(p_name, 1, 4) AS pre, trim(concat('  ', p_type, ' ')) AS t FROM part")
add("sc02_regex", "SELECT p_partkey, regexp_like(p_name, '[aeiou][aeiou]') AS m, CAST(regexp_count(p_name, '[aeiou]') AS INT) AS v FROM part", "SELECT p_partkey, regexp_matches(p_name, '[aeiou][aeiou]') AS m, len(regexp_extract_all(p_name, '[aeiou]'))::INT AS v FROM part")
add("sc03_extract", "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS n, array_join(regexp_extract_all(p_name, '[a-z]+', 0), '|') AS w, regexp_replace(p_brand, '([A-Za-z]+)#?([0-9])', '$2-$1') AS r FROM part",
    "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS n, array_to_string(regexp_extract_all(p_name, '[a-z]+'), '|') AS w, regexp_replace(p_brand, '([A-Za-z]+)#?([0-9])', '\\2-\\1', 'g') AS r FROM part")
add("sc04_translate", "SELECT p_partkey, translate(lower(p_name), 'bfpvcgjkqsxzdtmn', '1111222222223355') AS ph FROM part")
add("sc05_split", "SELECT page_id, split_part(url, '/', 3) AS host FROM pages")
add("sc06_concat", "SELECT p_partkey, concat_ws(' | ', p_name, p_brand, p_type) AS txt FROM part")
add("sc07_lists", "SELECT p_partkey, array_join(array_sort(array_distinct(split(p_name, ' '))), ' ') AS s, CAST(size(split(p_name, ' ')) AS INT) AS n, split(p_name, ' ')[0] AS f, exists(split(p_name, ' '), x -> length(x) > 5) AS any_long FROM part",
    "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') AS s, len(string_split(p_name, ' '))::INT AS n, string_split(p_name, ' ')[1] AS f, len(list_filter(string_split(p_name, ' '), lambda x: length(x) > 5)) > 0 AS any_long FROM part")
add("sc08_list_map", "SELECT p_partkey, array_join(transform(split(p_type, ' '), x -> coalesce(element_at(map('STANDARD', 'STD', 'ECONOMY', 'ECO'), x), x)), ' ') AS t FROM part",
    "SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda x: CASE x WHEN 'STANDARD' THEN 'STD' WHEN 'ECONOMY' THEN 'ECO' ELSE x END), ' ') AS t FROM part")
add("sc09_explode", "SELECT p_partkey, explode(split(p_name, ' ')) AS tok FROM part", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS tok FROM part")
add("sc10_hash_keys", "SELECT p_type AS country, count(*) AS n, count(DISTINCT xxhash64(7L, p_brand, p_size)) AS keys FROM part GROUP BY p_type", "SELECT p_type AS country, count(*) AS n, count(DISTINCT (p_brand, p_size)) AS keys FROM part GROUP BY p_type")
add("sc11_math", "SELECT l_orderkey, l_linenumber, round(ln(l_quantity), 6) AS a, round(ln(1 + l_tax), 6) AS b, round(exp(l_discount), 6) AS c, abs(l_linenumber - 4) AS d, CAST(floor(l_quantity / 7) AS BIGINT) AS e, l_partkey % 7 AS f, greatest(l_tax, l_discount) AS g FROM lineitem")
add("sc12_logit", "SELECT s1_idx, src, t_idx, round(ln(least(greatest(p, 0.000001), 0.999999) / (1 - least(greatest(p, 0.000001), 0.999999))), 6) AS lp FROM scores")


def queries() -> dict:
    return {k: sql_query(a) for k, (a, _) in SQL.items()}


def oracles() -> dict:
    return {k: with_roles(b or a).replace("AS STRING)", "AS VARCHAR)") for k, (a, b) in SQL.items()}
