"""DuckDB twins of the sample and of the queries over it."""

from __future__ import annotations

_LAYOUT = lambda day, pick: f"CASE {pick} % 5 WHEN 0 THEN strftime({day}, '%Y-%m-%d') WHEN 1 THEN strftime({day}, '%Y/%m/%d') WHEN 2 THEN strftime({day}, '%Y.%m.%d') WHEN 3 THEN strftime({day}, '%Y%m%d') ELSE strftime({day}, '%Y年%-m月%-d日') END"

ROWS = f"""
raw AS (
  SELECT l_orderkey AS k, row_number() OVER w - 1 AS row_idx, c_name AS customer, p_name AS material_name, p_type AS spec_model,
    'ZB' || lpad(CAST(l_orderkey AS VARCHAR), 9, '0') AS delivery_no,
    first_value(CAST(floor(p_retailprice) AS DECIMAL(20,4))) OVER w AS price, first_value(CAST(l_shipdate AS DATE)) OVER w AS ship
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)),
rows_ AS (
  SELECT *, price + CASE WHEN k % 6 = 0 THEN 1.01 ELSE 0 END AS tax, CAST(price * 0.885 AS DECIMAL(20,4)) + CASE WHEN k % 8 = 0 THEN 2 ELSE 0 END AS notax,
    {_LAYOUT("ship", "k")} AS delivery_date, CASE WHEN k % 17 <> 0 THEN {_LAYOUT("(ship + CAST(k % 9 AS INTEGER))", "(k + 1)")} END AS confirm_date
  FROM raw),
g AS (
  SELECT k, delivery_no, price, ship, min(row_idx) AS first_row, string_agg(CAST(row_idx AS VARCHAR), ',' ORDER BY row_idx) AS row_list, count(*) AS n,
    arg_min(customer, row_idx) AS customer, arg_min(material_name, row_idx) AS material, arg_min(spec_model, row_idx) AS spec,
    CAST(sum(tax) AS DECIMAL(20,4)) AS tax, CAST(sum(notax) AS DECIMAL(20,4)) AS notax, min(delivery_date) AS delivery_date, coalesce(min(confirm_date), '') AS confirm_date
  FROM rows_ GROUP BY k, delivery_no, price, ship)"""

#: Documents of each order, as what they say.
DOCS = """
d AS (
  SELECT *, k % 5 <> 0 AS has_c, k % 7 <> 0 AS has_r, k % 4 <> 3 AS has_a, k % 3 = 0 AS has_l,
    CASE WHEN k % 13 = 0 THEN right(delivery_no, 6) ELSE delivery_no END AS short,
    CASE WHEN k % 10 = 3 THEN 'Another Company' ELSE customer END AS c_customer, CASE WHEN k % 7 = 1 THEN 'X-1' ELSE upper(spec) END AS c_spec,
    price + CASE WHEN k % 11 = 0 THEN 10 ELSE 0 END AS c_price, CASE WHEN k % 19 = 0 THEN 'ZB999999999' ELSE delivery_no END AS r_no,
    n + CASE WHEN k % 6 = 1 THEN 1 ELSE 0 END AS r_qty, ship + CASE WHEN k % 12 = 5 THEN 1 ELSE 0 END AS r_day, ship + 2 AS sign,
    'SF' || CASE WHEN k % 24 = 6 THEN '-' ELSE '' END || lpad(CAST(k AS VARCHAR), 10, '0') AS r_log, CASE WHEN k % 27 = 3 THEN strftime(ship + CASE WHEN k % 12 = 5 THEN 1 ELSE 0 END, '%Y%m%d') ELSE strftime(ship + CASE WHEN k % 12 = 5 THEN 1 ELSE 0 END, '%Y-%m-%d') END AS r_date,
    CASE WHEN k % 3 = 0 THEN strftime(ship + 2, '%-m/%-d') ELSE strftime(ship + 2, '%Y/%m/%d') END AS sign_text,
    CASE k % 4 WHEN 0 THEN '张三' WHEN 1 THEN '李四' WHEN 2 THEN '王五' ELSE '赵六' END AS signer,
    ship + CAST(k % 9 AS INTEGER) AS confirm
  FROM g),
files AS (
  SELECT k, k * 10 + 1 AS doc_seq, '合同_' || short || '.pdf' AS file_name, 'contract' AS doc_type FROM d WHERE has_c
  UNION ALL SELECT k, k * 10 + 2, '回签联_' || short || '.PDF', 'receipt' FROM d WHERE has_r
  UNION ALL SELECT k, k * 10 + 3, '授权书_' || delivery_no || '.pdf', 'authorization' FROM d WHERE has_a
  UNION ALL SELECT k, k * 10 + 4, '对账单_' || delivery_no || '.pdf', 'reconciliation' FROM d WHERE has_l)"""

#: Codes of the checks. A short sign date takes the year of the confirmation, as far as that can be read.
CODES = """
s AS (SELECT *, CASE WHEN k % 3 = 0 THEN TRY_CAST(CAST(year(confirm) AS VARCHAR) || '-' || month(sign) || '-' || day(sign) AS DATE) ELSE sign END AS signed FROM d),
v AS (
  SELECT *, CASE WHEN k % 3 = 1 THEN '孙七' ELSE signer END AS person,
    CASE WHEN NOT has_c THEN 'contract_missing' ELSE concat_ws(',', CASE WHEN NOT contains(customer, c_customer) AND NOT contains(c_customer, customer) THEN 'customer' END,
      CASE WHEN lower(spec) <> lower(c_spec) THEN 'spec' END, CASE WHEN price <> c_price THEN 'price' END) END AS check1,
    CASE WHEN NOT has_r THEN 'receipt_missing' ELSE concat_ws(',', CASE WHEN r_no <> delivery_no THEN 'delivery_no' END, CASE WHEN r_qty <> n THEN 'quantity' END, CASE WHEN r_day <> ship THEN 'delivery_date' END) END AS check2,
    concat_ws(',', CASE WHEN abs(tax - price * n) > 1 THEN 'revenue_tax' END, CASE WHEN abs(113 * notax - 100 * price * n) > 113 THEN 'revenue_notax' END) AS check3,
    CASE WHEN k % 17 = 0 THEN 'confirm_missing' WHEN NOT has_r THEN 'sign_missing' WHEN signed IS NULL THEN 'sign_unreadable'
      ELSE concat_ws(',', CASE WHEN signed > confirm THEN 'signed_late' END, CASE WHEN date_trunc('month', signed) <> date_trunc('month', confirm) THEN 'other_month' END) END AS check4,
    CASE WHEN NOT has_a THEN 'letter_missing' WHEN NOT has_r THEN 'signer_missing' WHEN (CASE WHEN k % 3 = 1 THEN '孙七' ELSE signer END) <> signer THEN 'not_authorized' ELSE '' END AS check5
  FROM s),
m AS (
  SELECT *, CASE WHEN NOT has_c THEN '缺合同' WHEN check1 = '' THEN '✓' ELSE concat_ws('; ', CASE WHEN contains(check1, 'customer') THEN '客户名称不一致：系统''' || customer || ''' vs 合同''' || c_customer || '''' END,
      CASE WHEN contains(check1, 'spec') THEN '规格型号不一致：系统''' || spec || ''' vs 合同''' || c_spec || '''' END, CASE WHEN contains(check1, 'price') THEN '单价不一致：系统' || CAST(price AS BIGINT) || ' vs 合同' || CAST(c_price AS BIGINT) END) END AS text1,
    CASE WHEN NOT has_r THEN '缺回签联' WHEN check2 = '' THEN '✓' ELSE concat_ws('; ', CASE WHEN contains(check2, 'delivery_no') THEN '出库单号不一致：系统''' || delivery_no || ''' vs 回签联''' || r_no || '''' END,
      CASE WHEN contains(check2, 'quantity') THEN '出库数量不一致：系统' || n || ' vs 回签联' || r_qty END, CASE WHEN contains(check2, 'delivery_date') THEN '出库日期不一致：系统' || delivery_date || ' vs 回签联' || r_date END) END AS text2,
    CASE WHEN check3 = '' THEN '✓' ELSE concat_ws('; ', CASE WHEN contains(check3, 'revenue_tax') THEN '含税收入差异：系统' || plain(tax) || ' vs 计算' || plain(price * n) || '，差' || plain(tax - price * n) END,
      CASE WHEN contains(check3, 'revenue_notax') THEN '不含税收入差异：系统' || plain(notax) || ' vs 计算' || cents((CAST(price * n AS BIGINT) * 20000 + 113) // 226) || '，差' || cents(share(CAST((113 * notax - 100 * price * n) * 10000 AS BIGINT))) END) END AS text3,
    CASE WHEN k % 17 = 0 THEN '收入确认日期缺失' WHEN NOT has_r THEN '日期缺失' WHEN signed IS NULL THEN '无法解析签收日期：' || sign_text WHEN check4 = '' THEN '✓'
      ELSE concat_ws('; ', CASE WHEN contains(check4, 'signed_late') THEN '签收' || CAST(signed AS VARCHAR) || ' > 确认' || CAST(confirm AS VARCHAR) || '，时点不合规' END, CASE WHEN contains(check4, 'other_month') THEN '签收' || CAST(signed AS VARCHAR) || ' vs 确认' || CAST(confirm AS VARCHAR) || '，跨月' END) END AS text4,
    CASE check5 WHEN '' THEN '✓' WHEN 'letter_missing' THEN '✗ 未提供授权书' WHEN 'signer_missing' THEN '✗ 回签联未识别到签收人' ELSE '✗ 授权人"' || person || '"≠签收人"' || signer || '"' END AS text5
  FROM v)"""


def _inlined(sql: str) -> str:
    """The SQL with its three formulas written out: an amount without trailing zeros, cents as an amount, and a 113th of ten-thousandths in cents, halves to even."""
    forms = {
        "plain": "regexp_replace(regexp_replace(CAST(CAST({0} AS DECIMAL(30,4)) AS VARCHAR), '0+$', ''), '[.]$', '')",
        "cents": "CASE WHEN {0} < 0 THEN '-' ELSE '' END || abs({0}) // 100 || '.' || lpad(CAST(abs({0}) % 100 AS VARCHAR), 2, '0')",
        "share": "sign({0}) * ((2 * abs({0}) + 11300) // 22600 - CASE WHEN (2 * abs({0}) + 11300) % 45200 = 22600 THEN 1 ELSE 0 END)",
    }
    for name in ("share", "cents", "plain"):
        while (at := sql.find(f" {name}(")) >= 0:
            begin, depth = at + len(name) + 2, 1
            end = begin
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[end], 0)
                end += 1
            sql = sql[: at + 1] + "(" + forms[name].format(f"({sql[begin : end - 1]})") + ")" + sql[end:]
    return sql


CODES = _inlined(CODES.replace("cents(share(", "cents( share("))

WITH_ROWS, WITH_DOCS, WITH_CHECKS = f"WITH {ROWS}", f"WITH {ROWS}, {DOCS}", f"WITH {ROWS}, {DOCS}, {CODES}"
_RESULT = "CASE WHEN check1 = '' AND check2 = '' AND check3 = '' AND check4 = '' AND check5 = '' THEN '全部通过' ELSE concat_ws('、', " + ", ".join(f"CASE WHEN check{i} <> '' THEN '{m}' END" for i, m in enumerate("①②③④⑤", 1)) + ") || '存在异常' END"
_INDEX = """array_to_string(list_transform(list_filter([CASE WHEN has_c THEN '合同合同_' || short END, CASE WHEN has_r THEN '回签联回签联_' || short END, CASE WHEN has_l THEN '对账单对账单_' || delivery_no END, CASE WHEN has_a THEN '授权书授权书_' || delivery_no END], lambda x: x IS NOT NULL), lambda x, i: '附件' || i || ':' || x), '; ')"""
_PASSES = ", ".join(f"count(*) FILTER (check{i} = '') AS check{i}_pass, count(*) FILTER (check{i} <> '') AS check{i}_fail" for i in range(1, 6))
_ALL = "check1 = '' AND check2 = '' AND check3 = '' AND check4 = '' AND check5 = ''"
_SUMMARY = f"SELECT count(*) AS total_groups, count(*) AS total_checked, {_PASSES}, count(*) FILTER ({_ALL}) AS all_pass FROM v"
_CENTS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, (l_orderkey + l_linenumber) % 8 AS f FROM lineitem"
_SPACES = r"regexp_replace(translate(regexp_replace(nfc_normalize(text), '[\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g'), '，．－（）：；　', ',.-():; '), '\s+', ' ', 'g')"
_TYPE_CASE = "CASE WHEN contains(file_name, '合同') THEN 'contract' WHEN contains(file_name, '回签联') THEN 'receipt' WHEN contains(file_name, '授权书') THEN 'authorization' WHEN contains(file_name, '对账单') THEN 'reconciliation' ELSE 'unknown' END"

SQL = {
    "delivery_groups": f"{WITH_ROWS} SELECT delivery_no, first_row, row_list, customer AS customer_name, material AS material_name, spec AS spec_model, CAST(price AS VARCHAR) AS unit_price, n AS total_qty, CAST(tax AS VARCHAR) AS total_revenue_tax, CAST(notax AS VARCHAR) AS total_revenue_notax, delivery_date, confirm_date FROM g",
    "group_preview": f"{WITH_ROWS} SELECT delivery_no, customer AS customer_name, material AS material_name, CAST(n AS INTEGER) AS n_rows, n AS total_qty, CAST(tax AS VARCHAR) AS total_revenue_tax FROM g",
    "amount_parse": f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN f IN (2, 5) THEN '-' ELSE '' END || c // 100 || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') || '0000' AS amount FROM ({_CENTS})",
    "date_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 5 AND day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE CAST(o_orderdate AS DATE) END AS d FROM orders",
    "short_date": "SELECT o_orderkey, CAST(TRY_CAST(CAST(year(o_orderdate) + 1 AS VARCHAR) || '-' || month(o_orderdate) || '-' || day(o_orderdate) AS DATE) AS VARCHAR) AS d FROM orders",
    "clean_text": f"SELECT doc_id, md5(trim({_SPACES})) AS clean_md5, length(trim({_SPACES})) AS n FROM documents",
    "fullwidth": "SELECT p_partkey, replace(replace(replace(p_name, ' ', '('), 'e', ':'), 'a', ', ') AS folded FROM part",
    "detect_language": "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN repeat('收入', CAST(doc_id % 40 AS INTEGER)) || text ELSE text END AS x FROM documents) SELECT doc_id, CAST(length(regexp_replace(x, '[^一-鿿]', '', 'g')) AS INTEGER) AS cjk, CASE WHEN length(regexp_replace(x, '[^一-鿿]', '', 'g')) > length(regexp_replace(x, '[^A-Za-z]', '', 'g')) THEN 'zh' ELSE 'en' END AS language FROM t",
    "truncate_text": "SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS short FROM documents",
    "doc_classify": f"{WITH_DOCS} SELECT file_name, {_TYPE_CASE} AS doc_type FROM files",
    "contract_fields": f"{WITH_DOCS} SELECT '合同_' || short || '.pdf' AS file_name, c_customer AS customer_name, trim(material) AS product_name, c_spec AS spec_model, CAST(c_price AS VARCHAR) AS unit_price FROM d WHERE has_c",
    "receipt_fields": f"{WITH_DOCS} SELECT '回签联_' || short || '.PDF' AS file_name, r_no AS delivery_no, CAST(r_qty AS INTEGER) AS delivery_qty, r_date AS delivery_date, '顺丰速运' AS logistics_company, r_log AS logistics_no, sign_text AS sign_date, signer, CASE WHEN k % 2 = 0 THEN customer ELSE '' END AS customer_name FROM d WHERE has_r",
    "authorization_fields": f"{WITH_DOCS} SELECT '授权书_' || delivery_no || '.pdf' AS file_name, CASE WHEN k % 3 = 1 THEN '孙七' ELSE signer END AS authorized_person FROM d WHERE has_a",
    "match_direct": f"{WITH_DOCS} SELECT file_name, regexp_extract(file_name, 'ZB[0-9]{{9}}') AS delivery_no FROM files WHERE regexp_matches(file_name, 'ZB[0-9]{{9}}')",
    "match_suffix": f"{WITH_DOCS} SELECT file_name, delivery_no FROM files JOIN g ON right(g.delivery_no, 6) = regexp_extract(file_name, '_([0-9]{{6}})[.]', 1) WHERE NOT regexp_matches(file_name, 'ZB[0-9]{{9}}')",
    "match_status": f"{WITH_DOCS}, m AS (SELECT delivery_no, concat_ws(' | ', CASE WHEN has_c THEN '合同: 合同_' || short || '.pdf' END, CASE WHEN has_r THEN '回签联: 回签联_' || short || '.PDF' END, CASE WHEN has_l THEN '对账单: 对账单_' || delivery_no || '.pdf' END, CASE WHEN has_a THEN '授权书: 授权书_' || delivery_no || '.pdf' END) AS f FROM d) SELECT delivery_no, CASE WHEN f = '' THEN '❌ 未匹配' ELSE f END AS files, CASE WHEN f = '' THEN '❌' ELSE '✅' END AS status FROM m",
    "assign_first_doc": f"{WITH_DOCS} SELECT delivery_no, CASE WHEN has_c THEN CAST(k * 10 + 1 AS VARCHAR) END AS contract_seq, CASE WHEN has_r THEN CAST(k * 10 + 2 AS VARCHAR) END AS receipt_seq, CASE WHEN has_l THEN CAST(k * 10 + 4 AS VARCHAR) END AS reconciliation_seq, CASE WHEN has_a THEN CAST(k * 10 + 3 AS VARCHAR) END AS authorization_seq FROM d",
    **{f"check{i}_{name}": f"{WITH_CHECKS} SELECT delivery_no, check{i} AS codes, text{i} AS message FROM m" for i, name in enumerate(("contract", "delivery", "amount", "timing", "signer"), 1)},
    "attachment_index": f"{WITH_CHECKS} SELECT delivery_no, {_INDEX} AS attachment_index, {_RESULT} AS attachment_result FROM v",
    "verification_summary": f"{WITH_CHECKS} {_SUMMARY}",
    "pass_rate": f"{WITH_CHECKS}, s1 AS ({_SUMMARY}) SELECT total_checked, all_pass, CAST(floor(all_pass * 1000000.0 / total_checked) AS BIGINT) AS rate_ppm, total_checked - all_pass AS exceptions FROM s1",
    "per_check_table": f"{WITH_CHECKS}, s1 AS ({_SUMMARY}) " + " UNION ALL ".join(f"SELECT 'check{i}' AS check_name, check{i}_pass AS passed, check{i}_fail AS failed FROM s1" for i in range(1, 6)),
    "matched_count": f"{WITH_DOCS} SELECT count(*) FILTER (has_c OR has_r) AS matched, count(*) AS total FROM d",
    "result_summary": f"{WITH_CHECKS} SELECT delivery_no AS \"出库单号\", customer AS \"客户名称\", n AS \"出库数量\", CAST(tax AS VARCHAR) AS \"含税收入\", text1 AS \"①合同\", text2 AS \"②出库单\", text3 AS \"③金额\", text4 AS \"④时点\", text5 AS \"⑤授权\", CASE WHEN {_ALL} THEN '全部通过' ELSE '存在异常' END AS \"总结\" FROM m",
    "result_rows": f"{WITH_CHECKS} SELECT m.delivery_no, r.row_idx, CASE WHEN has_r THEN '顺丰速运' ELSE '' END AS logistics_company, CASE WHEN has_r THEN r_log ELSE '' END AS logistics_no, CASE WHEN has_r THEN sign_text ELSE '' END AS customer_sign_date, CASE WHEN has_r THEN m.signer ELSE '' END AS signer, text1 AS check1, text2 AS check2, text3 AS check3, text4 AS check4, text5 AS check5, {_INDEX} AS attachment_index, {_RESULT} AS attachment_result FROM (SELECT k AS row_k, row_idx FROM rows_) r JOIN m ON row_k = m.k",
    "compare_amounts": "WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS e, CAST(round(l_extendedprice * 100) AS BIGINT) + CASE l_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2000 WHEN 3 THEN -150000 ELSE 7 END AS a FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(a - e) <= 1 OR (e <> 0 AND abs(a - e) * 100 <= abs(e)) AS matches, CASE l_orderkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '0.01' WHEN 2 THEN '20' WHEN 3 THEN '-1500' ELSE '0.07' END AS difference FROM c",
    "compare_dates": "SELECT o_orderkey, o_orderkey % 6 <= 3 AS matches, CAST(round(CASE WHEN o_orderkey % 6 = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - (o_orderkey % 6) / 6.0) END * 1000) AS BIGINT) AS confidence_milli, (o_orderkey % 6) || ' days' AS difference FROM orders",
    "page_types": "WITH p AS (SELECT page_id, 'html' AS what, html AS t, (page_id % 10) / 10.0 AS r FROM pages UNION ALL SELECT page_id, 'url', url, (page_id % 10) / 10.0 FROM pages), q AS (SELECT page_id, what, length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS n, CAST(r AS DOUBLE) AS r FROM p) SELECT page_id, what, CASE WHEN n >= 50 AND r < 0.3 THEN 'native' WHEN n < 50 AND r >= 0.3 THEN 'scanned' WHEN n >= 50 THEN 'mixed' WHEN n < 10 THEN 'scanned' ELSE 'native' END AS page_type FROM q",
    "block_types": "SELECT event_id, CASE WHEN (event_id % 800) / 792.0 < 0.05 THEN 'header' WHEN (event_id % 800) / 792.0 > 0.95 THEN 'footer' ELSE 'paragraph' END AS block_type FROM events",
    "rows_cluster": "WITH RECURSIVE sp AS (SELECT user_id, event_id, CAST(event_id % 701 AS DOUBLE) / 4 AS y FROM events), a AS (SELECT user_id, min(y) AS y, 0 AS n FROM sp GROUP BY user_id UNION ALL SELECT a.user_id, min(sp.y), a.n + 1 FROM a JOIN sp ON sp.user_id = a.user_id AND sp.y - a.y > 5 GROUP BY a.user_id, a.n) SELECT sp.user_id, sp.event_id, CAST(max(a.n) AS INTEGER) AS row_no FROM sp JOIN a ON a.user_id = sp.user_id AND a.y <= sp.y GROUP BY sp.user_id, sp.event_id",
    "columns_detect": "WITH RECURSIVE sp AS (SELECT DISTINCT user_id, round_even(CAST(event_id % 601 AS DOUBLE) / 15.0, 0) * 15 AS x FROM events), a AS (SELECT user_id, min(x) AS x FROM sp GROUP BY user_id UNION ALL SELECT a.user_id, min(sp.x) FROM a JOIN sp ON sp.user_id = a.user_id AND sp.x - a.x > 15 GROUP BY a.user_id, a.x) SELECT user_id, string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY x) AS columns FROM a GROUP BY user_id",
    "nearest_column": "WITH e AS (SELECT event_id, CAST(event_id % 500 AS DOUBLE) AS x FROM events), c AS (SELECT unnest([0, 60, 135, 300]) AS cx, unnest([0, 1, 2, 3]) AS i), b AS (SELECT event_id, arg_min({'i': i, 'd': abs(x - cx)}, abs(x - cx) * 10 + i) AS m FROM e, c GROUP BY event_id) SELECT event_id, CASE WHEN m.d < 50 THEN CAST(m.i AS VARCHAR) END AS col_no FROM b",
    "table_confidence": "WITH r AS (SELECT user_id, avg(CASE WHEN event_id % 4 = 0 OR user_id % 5 = 0 THEN 0.0 ELSE 1.0 END) AS r FROM events GROUP BY user_id) SELECT user_id, CAST(round(CASE WHEN r < 0.3 THEN 0.3 ELSE least(1.0, r * 0.8 + 0.2) END * 100000) AS BIGINT) AS confidence FROM r",
    "header_dedup": "WITH h AS (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'Column' ELSE p_type END AS h FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, h ORDER BY p_partkey) - 1 AS i FROM h) SELECT p_brand, md5(string_agg(h || CASE WHEN i > 0 THEN '_' || i ELSE '' END, '|' ORDER BY p_partkey)) AS headers FROM n GROUP BY p_brand",
    "ocr_blocks": "WITH w AS (SELECT user_id, event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS t, CAST(event_id % 103 - 3 AS DOUBLE) AS conf FROM events), m AS (SELECT *, sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS part FROM w), b AS (SELECT user_id, part, string_agg(t, ' ' ORDER BY event_id) AS content, avg(conf) AS c FROM m WHERE t <> '' AND conf > 0 GROUP BY user_id, part) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY part) - 1 AS INTEGER) AS block_no, content, CAST(round(greatest(0, least(1, c / 100)) * 1000000) AS BIGINT) AS confidence FROM b",
    "ocr_best_mode": "WITH r AS (SELECT user_id, CAST(event_id % 3 AS INTEGER) AS mode_no, CAST(sum(event_id % 97) AS DOUBLE) / count(*) / 100 AS c FROM events GROUP BY ALL), t AS (SELECT *, min(CASE WHEN c >= 0.5 THEN mode_no END) OVER (PARTITION BY user_id) AS good FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, mode_no) AS o FROM t WHERE good IS NULL OR mode_no <= good) SELECT user_id, mode_no, CAST(round(c * 1000000) AS BIGINT) AS confidence FROM k WHERE o = 1",
    "full_text": "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id",
    "table_quantities": "SELECT l_orderkey, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS INTEGER) AS table_qty FROM lineitem GROUP BY l_orderkey",
    "table_prices": "WITH r AS (SELECT l_orderkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS i FROM lineitem WHERE l_extendedprice > 0.01) SELECT l_orderkey, CAST(arg_min(c, i) AS BIGINT) AS cents FROM r GROUP BY l_orderkey",
    "file_listing": "WITH f AS (SELECT page_id, '/data/' || regexp_extract(url, '://([^/?#]*)', 1) || '/' || page_id || '.pdf' AS path, length(html) AS n FROM pages) SELECT CAST(row_number() OVER (ORDER BY path) AS BIGINT) AS doc_seq, page_id || '.pdf' AS file_name, regexp_extract(path, '^/data/(.*)/[^/]*$', 1) AS folder, printf('%.1f KB', floor(n / 1024.0 * 10 + 0.5) / 10) AS size_label FROM f",
    "compare_text": "WITH r AS (SELECT p_partkey, 2.0 * length(p_name) / (2 * length(p_name) + 1 + length(p_brand)) AS r FROM part) SELECT p_partkey, r >= 0.8 AS matches, round(CAST(r AS DOUBLE), 6) AS confidence FROM r",
    "auto_compare": "WITH n AS (SELECT s_suppkey, CAST(regexp_extract(s_name, '[0-9]+') AS BIGINT) AS n FROM supplier) SELECT s_suppkey, n = 0 AS matches, 'Abs diff: ' || 9 * n || ', Pct diff: ' || CASE WHEN n = 0 THEN '0.00%' ELSE '90.00%' END AS notes FROM n",
    "decimal_compare": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey % 4 <= 1 AS same FROM lineitem",
    "document_page_types": "WITH p AS (SELECT page_id % 40 AS doc_id, page_id, CASE WHEN page_id % 3 = 0 THEN 'scanned' ELSE 'native' END AS t FROM pages) SELECT doc_id, string_agg(t, ',' ORDER BY page_id) AS page_types FROM p GROUP BY doc_id",
    "sheet_head": "SELECT o_orderkey AS row_idx, o_orderstatus AS status FROM orders ORDER BY o_orderkey LIMIT 20",
    "column_letters": "SELECT n_nationkey, CAST(CASE WHEN n_nationkey < 13 THEN 1 + n_nationkey ELSE 26 + n_nationkey END AS INTEGER) AS idx FROM nation",
    "interface_texts": "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'Summary' WHEN 1 THEN 'Matched' ELSE r_name END AS english, CASE r_regionkey WHEN 0 THEN '核查汇总' WHEN 1 THEN '已匹配' ELSE r_name END AS chinese FROM region",
    "ocr_routing": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'ocr' WHEN 2 THEN 'native' ELSE 'native' END AS text, CASE WHEN page_id % 4 <> 3 AND page_id % 10 < 4 THEN 'Page ' || page_id || ': Low OCR confidence (' || (page_id % 10) * 10 || '%), manual review recommended' END AS warning FROM pages",
}
