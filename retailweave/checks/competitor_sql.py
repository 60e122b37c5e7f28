"""Reference SQL of the competitor-domain adapters."""

from __future__ import annotations

from .fact_sql import CODE

COMP = """comp AS (SELECT * FROM (VALUES (1,'Alpha Sound','c1.example.com','index'),(2,'Bravo Music','c2.example.com','stock'),
  (3,'Charlie','c3.example.com','tokens'),(4,'Delta Audio','c4.example.com','signature')) t(id,name,domain,profile))"""

URL = "'https://c' || CAST({c} AS VARCHAR) || '.example.com/p' || CAST({p} AS VARCHAR) || '/x'"

HISTORY = f"""history AS (
  SELECT CAST(l_suppkey % 4 + 1 AS INTEGER) AS competitor_id, l_partkey AS id_product,
    {URL.format(c='(l_suppkey % 4 + 1)', p='l_partkey')} AS url,
    CAST(CAST(p_retailprice AS DECIMAL(12,2)) * (CAST(0.50 AS DECIMAL(4,2)) + CAST(l_quantity AS DECIMAL(5,2))
      * CAST(0.02 AS DECIMAL(4,2))) AS DECIMAL(12,2)) AS price, 'seed' AS source, l_shipdate AS observed_at
  FROM lineitem JOIN part ON l_partkey = p_partkey),
pairs AS (
  SELECT id_product, competitor_id, url, price, observed_at, created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY id_product, competitor_id ORDER BY observed_at DESC, price DESC) AS rn,
      min(observed_at) OVER (PARTITION BY id_product, competitor_id) AS created_at FROM history) WHERE rn = 1)"""

FINALS = """finals AS (SELECT id_product, competitor_id, url, price AS competitor_price,
  CAST(id_product % 3 AS INTEGER) AS consecutive_http_failures, created_at, observed_at AS updated_at FROM pairs
  WHERE id_product % 3 <> 0)"""

TESTS = """tests AS (SELECT id_product, competitor_id,
  CASE id_product % 4 WHEN 0 THEN 'matched' WHEN 1 THEN 'not_found' WHEN 2 THEN 'pending' ELSE 'error' END AS result, url,
  CASE WHEN p_size % 9 = 0 THEN '' ELSE p_name || ' ' || p_brand END AS competitor_title, p_brand AS competitor_brand,
  CASE WHEN p_size % 4 = 0 THEN '' ELSE url || '.jpg' END AS competitor_image_url,
  CASE WHEN p_size % 10 = 0 THEN 'gone' ELSE 'ok' END AS competitor_page_status,
  'Home > ' || p_type AS competitor_breadcrumb, CAST(p_size * 2 AS INTEGER) AS score, price AS competitor_price,
  CASE id_product % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'postponed' WHEN 2 THEN 'valid' WHEN 3 THEN 'rejected'
    ELSE 'ignored' END AS validation_status, p_name AS matched_query, CAST(NULL AS VARCHAR) AS message,
  observed_at AS last_tested_at FROM pairs JOIN part ON id_product = p_partkey)"""

FEED = f"""feed AS (SELECT p_partkey AS id_product, {CODE} AS reference, lpad(CAST(p_partkey AS VARCHAR),13,'0') AS ean13,
  p_brand AS manufacturer_name, CASE WHEN p_size = 50 THEN ' ' ELSE p_brand || ' ' || p_name END AS product_name,
  CAST(p_retailprice AS DECIMAL(12,2)) AS price_tax_incl FROM part),
eligible AS (SELECT * FROM feed WHERE trim(reference) <> '' AND lower(reference) NOT LIKE '%b-%'
  AND lower(reference) NOT LIKE '%occas%' AND lower(reference) NOT LIKE '%depv%')"""

SNAPSHOT = """f.id_product, nullif(trim(f.reference),'') AS supplier_reference, nullif(trim(f.ean13),'') AS ean,
  nullif(trim(f.manufacturer_name),'') AS brand, CAST(f.price_tax_incl AS DOUBLE) AS source_price,
  coalesce(nullif(trim(f.product_name),''), 'Product ' || CAST(f.id_product AS VARCHAR)) AS name"""

REFERENCE = """refs AS (SELECT p_partkey AS id_product,
    CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.95 AS DECIMAL(4,2)) AS DECIMAL(12,2)) AS price_ttc,
    DATE '2001-01-01' AS date_upd FROM part WHERE p_partkey % 4 = 0
  UNION ALL SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN CAST(0 AS DECIMAL(12,2)) ELSE
    CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(0.90 AS DECIMAL(4,2)) AS DECIMAL(12,2)) END,
    DATE '2001-06-01' FROM part WHERE p_partkey % 4 = 0),
ref_price AS (SELECT id_product, price_ttc AS price, date_upd FROM (SELECT *, row_number() OVER (PARTITION BY id_product
  ORDER BY date_upd DESC) AS rn FROM refs WHERE price_ttc > 0) WHERE rn = 1)"""

CATEGORIES = """cats AS (SELECT p_partkey AS id_category, CASE p_partkey WHEN 9 THEN 8 WHEN 8 THEN 9 ELSE p_partkey // 10 END
  AS id_parent, CASE WHEN p_size = 50 THEN ' ' ELSE split_part(p_name,' ',1) END AS name FROM part WHERE p_partkey > 0),
walk AS (
  SELECT id_category AS leaf, id_category AS cur, [] ::BIGINT[] AS seen, []::VARCHAR[] AS names FROM cats
  UNION ALL
  SELECT leaf, c.id_parent, list_append(seen, cur), CASE WHEN trim(c.name) <> '' THEN list_prepend(trim(c.name), names)
    ELSE names END FROM walk JOIN cats c ON c.id_category = cur WHERE NOT list_contains(seen, cur)),
cat_paths AS (SELECT leaf AS id_category, nullif(array_to_string(names, ' > '), '') AS category_path FROM (
  SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY len(seen) DESC) AS rn FROM walk) WHERE rn = 1)"""

IMAGES = """images AS (SELECT p_partkey * 10 + j AS id_image, p_partkey AS id_product,
    CASE WHEN p_size % 4 = j THEN 1 ELSE 0 END AS cover, (j + p_size) % 3 AS position,
    CASE WHEN p_size % 5 = j THEN 1 WHEN p_size % 5 = 0 THEN 0 END AS shop_cover
  FROM part, (VALUES (1),(2),(3)) v(j) WHERE p_partkey > 0),
main_image AS (SELECT id_product, id_image FROM (SELECT *, row_number() OVER (PARTITION BY id_product ORDER BY
  coalesce(shop_cover, cover) DESC, position, id_image) AS rn FROM images) WHERE rn = 1)"""

INCOMING = f"""incoming AS (SELECT event_id AS seq, user_id AS id_product, CAST(event_id % 4 + 1 AS INTEGER) AS competitor_id,
  CASE event_type WHEN 'purchase' THEN 'matched' WHEN 'view' THEN 'pending' WHEN 'click' THEN 'not_found'
    WHEN 'error' THEN 'error' ELSE '' END AS result,
  CASE WHEN k % 7 = 0 THEN ' ' ELSE {URL.format(c='(event_id % 4 + 1)', p='user_id')} END AS url,
  '  Title ' || CAST(k AS VARCHAR) AS competitor_title, CASE WHEN k <> 50 THEN k END AS score,
  CASE WHEN k % 11 = 0 THEN NULL ELSE CAST(value AS DECIMAL(12,2)) END AS price,
  CASE WHEN k % 13 = 0 THEN 'gone' ELSE 'ok' END AS page_status, ts AS tested_at
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))"""

URL_EVENTS = f"""url_events AS (SELECT event_id AS seq, ts AS event_at, CAST(user_id % 4 + 1 AS INTEGER) AS competitor_id,
  user_id AS id_product, {URL.format(c='(user_id % 4 + 1)', p='user_id')} AS url,
  CASE event_type WHEN 'error' THEN 404 WHEN 'signup' THEN 410 WHEN 'purchase' THEN 500 END AS http_status,
  CASE WHEN event_type IN ('view','click') THEN CAST(value AS DECIMAL(12,2)) END AS price,
  CASE event_type WHEN 'error' THEN substr(trim(repeat(' HTTP 404 ' || CAST(event_id AS VARCHAR), 20)), 1, 255)
    WHEN 'purchase' THEN 'HTTP 500' ELSE '' END AS error FROM events)"""

BASE = [COMP, HISTORY, FINALS, TESTS, FEED]


def with_ci(body: str, *ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join([*BASE, *ctes]) + "\n" + body
