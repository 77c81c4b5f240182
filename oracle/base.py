"""DuckDB SQL that derives the ticket fact table from the driver's tables (the other side of sources/tpch.py)."""

from tillwatch.schema import STATUS_ROWS


def _text(v):
    return "CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''") + "'"


STATUS = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {_text(d)}, {_text(g)})" for i, d, g in STATUS_ROWS) + ") s(status_id, description, error_group)"

RAW = f"""
lines AS (
  SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS orig,
         sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS disc, min(l_partkey) AS pk
  FROM lineitem GROUP BY l_orderkey),
status AS ({STATUS}),
ticket_history AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS ticket_id, o_custkey * 4 + o_orderkey % 4 AS customer_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'money in app' WHEN '2-HIGH' THEN 'bank account'
      WHEN '3-MEDIUM' THEN 'credit card' WHEN '5-LOW' THEN 'debit card' ELSE 'other' END AS paying_method,
    CAST(p_size AS DOUBLE) AS theater_name, 'dev-' || o_custkey AS device_number,
    CAST(coalesce(orig, 0) AS DOUBLE) AS original_price, CAST(coalesce(disc, 0) AS DOUBLE) AS discount_value,
    CAST(coalesce(orig, 0) - coalesce(disc, 0) AS DOUBLE) AS final_price,
    o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS time,
    CASE WHEN o_orderstatus = 'P' THEN -(o_orderkey % 7) - 1 ELSE 1 END AS status_id,
    CASE WHEN orig IS NULL OR disc * 1000 < orig * 35 THEN 0
      ELSE (CASE WHEN disc * 1000 < orig * 45 THEN 2 WHEN disc * 1000 < orig * 55 THEN 1 ELSE 3 END) * 100
           + CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) END AS campaign_id,
    p_name AS movie_name
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey LEFT JOIN part ON pk = p_partkey),
customers AS (
  SELECT customer_id, CASE WHEN customer_id % 9 = 0 THEN 'Not verify' WHEN customer_id % 2 = 1 THEN 'Male'
      ELSE 'Female' END AS usergender,
    CASE WHEN customer_id % 9 = 0 THEN DATE '1970-01-01'
      ELSE make_date(customer_id % 69 + 1930, customer_id % 12 + 1, customer_id % 28 + 1) END AS dob
  FROM (SELECT c_custkey * 4 + i AS customer_id FROM customer, range(4) r(i))),
devices AS (
  SELECT 'dev-' || c_custkey AS device_number,
    CASE c_custkey % 5 WHEN 0 THEN 'iPhone 12' WHEN 1 THEN 'browser' WHEN 2 THEN 'devicemodel'
      WHEN 4 THEN 'SM-G991' ELSE 'Unknown' END AS model,
    CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'mobile'
      WHEN c_mktsegment = 'MACHINERY' THEN 'website' END AS platform
  FROM customer),
campaigns AS (
  SELECT t.n * 100 + b AS campaign_id, t.campaign_type
  FROM (SELECT DISTINCT CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS BIGINT) AS b FROM part),
       (VALUES (1, 'direct discount'), (2, 'voucher'), (3, 'reward point')) t(n, campaign_type)),
tickets AS MATERIALIZED (
  SELECT h.*, usergender, dob, coalesce(k.campaign_type, 'none') AS campaign_type, description,
    coalesce(error_group, 'none') AS error_group, coalesce(d.model, 'Unknown') AS model,
    coalesce(d.platform, 'Unknown') AS platform,
    CASE WHEN regexp_matches(coalesce(d.model, 'Unknown'), 'iPhone|iPod') THEN 'ios' WHEN d.model = 'browser' THEN 'browser'
      WHEN regexp_matches(coalesce(d.model, 'Unknown'), 'devicemodel|Unknown') THEN 'Unknown'
      ELSE 'android and other' END AS os_version,
    status_id = 1 AS is_success, status_id <> 1 AS is_failed,
    CASE WHEN k.campaign_type IS NULL THEN 'non-promotion' ELSE 'promotion' END AS type,
    discount_value / nullif(original_price, 0) AS discount_rate,
    year(time) AS year, strftime(time, '%Y-%m') AS year_month, date_trunc('week', time) AS week, hour(time) AS hour,
    dayname(time) AS day_name,
    date_diff('year', dob, ref) - CASE WHEN month(dob) > month(ref) OR (month(dob) = month(ref) AND day(dob) > day(ref))
      THEN 1 ELSE 0 END AS age,
    CASE WHEN year(dob) < 1965 THEN 'baby boomers' WHEN year(dob) < 1981 THEN 'gen x' WHEN year(dob) < 1997 THEN 'gen y'
      ELSE 'gen z' END AS age_generation
  FROM (SELECT DISTINCT * FROM ticket_history) h
  LEFT JOIN customers USING (customer_id) LEFT JOIN campaigns k USING (campaign_id) LEFT JOIN status USING (status_id)
  LEFT JOIN devices d USING (device_number)
  CROSS JOIN (SELECT CAST(max(time) AS DATE) AS ref FROM ticket_history)),
bounds AS (SELECT max(time) AS data_end FROM tickets)
"""

EVENTS = """
attempts AS MATERIALIZED (
  SELECT CAST(event_id AS VARCHAR) AS ticket_id, user_id AS customer_id, ts AS time, value AS final_price,
    CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 - CAST(json_extract_string(props, '$.k') AS INT) % 7 END AS status_id,
    event_type = 'purchase' AS is_success, event_type = 'error' AS is_failed
  FROM events WHERE event_type IN ('purchase', 'error'))
"""


def q(body: str, *ctes: str) -> str:
    """A query over the ticket fact; ``ctes`` are further named subqueries."""
    return "WITH " + ",\n".join([RAW.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


def e(body: str, *ctes: str) -> str:
    """A query over the event attempts."""
    return "WITH " + ",\n".join([EVENTS.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()
