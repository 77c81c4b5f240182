"""Oracle SQL for failure, KPI, finance, customer and campaign queries."""

from oracle.base import e, q

M = lambda c: f"CAST({c} AS DECIMAL(18,4))"
S = lambda c, f="": f"CAST(sum({M(c)}){f' FILTER (WHERE {f})' if f else ''} AS DOUBLE)"
N = lambda f="": f"count(*) FILTER (WHERE {f})" if f else "count(*)"
I = lambda x: f"CAST({x} AS BIGINT)"  # noqa: E731, E741
DAY = "86400000000"

FIRST = f"""
fa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY time, ticket_id) AS rn FROM tickets) WHERE rn = 1),
fs AS (SELECT customer_id, min(time) FILTER (WHERE is_success) AS first_success_time, {N('is_success')} AS n_success FROM tickets GROUP BY 1),
first AS (SELECT fa.customer_id, time, ticket_id, is_failed AS first_failed, final_price, description, error_group, paying_method,
    year, week, first_success_time, n_success, first_success_time IS NOT NULL AS ever_converted,
    CASE WHEN is_failed THEN (epoch_us(first_success_time) - epoch_us(time)) / 3600000000 END AS hours_to_convert
  FROM fa JOIN fs USING (customer_id))
"""
SUMMARY = f"""
summary AS (SELECT count(*) AS customers_total, {N('first_failed')} AS failed_first_attempt,
    {N('first_failed')} / count(*) AS failed_first_attempt_pct,
    {N('first_failed AND NOT ever_converted')} AS never_converted,
    {N('first_failed AND NOT ever_converted')} / {N('first_failed')} AS never_converted_pct_of_failed,
    {N('first_failed AND hours_to_convert <= 1')} AS recovered_within_1h,
    {N('first_failed AND hours_to_convert <= 24')} AS recovered_within_24h,
    {S('final_price', 'first_failed AND NOT ever_converted')} AS lost_first_order_value,
    (SELECT {S('final_price')} / count(*) FROM tickets WHERE is_success) AS avg_success_ticket_value
  FROM first)
"""
RATES = ", ".join(f"{g} / n_tickets AS {g}_rate" for g in ("customer", "external", "internal"))


def rates(period, table):
    groups = ", ".join(N(f"is_failed AND error_group = '{g}'") + f" AS {g}" for g in ("customer", "external", "internal"))
    return f"""
rates AS (SELECT *, {RATES}, (customer + external + internal) / n_tickets AS failure_rate
  FROM (SELECT {period}, count(*) AS n_tickets, {groups} FROM {table} GROUP BY 1))
"""


def alerts(period, min_tickets):
    """Median and MAD over the eight preceding eligible periods by a self-join on row numbers."""
    return f"""
long AS (SELECT {period}, n_tickets, error_group, n_errors, rate, row_number() OVER (PARTITION BY error_group ORDER BY {period}) AS rn
  FROM (SELECT {period}, n_tickets, unnest(['customer', 'external', 'internal']) AS error_group,
      unnest([CAST(customer AS DOUBLE), external, internal]) AS n_errors, unnest([customer_rate, external_rate, internal_rate]) AS rate
    FROM rates WHERE n_tickets >= {min_tickets})),
past AS (SELECT a.{period}, a.error_group, a.n_tickets, a.n_errors, a.rate, b.rate AS past_rate
  FROM long a LEFT JOIN long b ON a.error_group = b.error_group AND b.rn BETWEEN a.rn - 8 AND a.rn - 1),
base AS (SELECT {period}, error_group, any_value(n_tickets) AS n_tickets, any_value(n_errors) AS n_errors, any_value(rate) AS rate,
    CASE WHEN count(past_rate) >= 6 THEN median(past_rate) END AS baseline FROM past GROUP BY 1, 2),
spread AS (SELECT p.{period}, p.error_group, greatest(1.4826 * median(abs(p.past_rate - b.baseline)), 0.003) AS spread
  FROM past p JOIN base b ON p.{period} = b.{period} AND p.error_group = b.error_group GROUP BY 1, 2),
alerts AS (SELECT b.{period}, b.error_group, n_tickets, n_errors, rate, baseline,
    CASE WHEN baseline IS NOT NULL THEN (rate - baseline) / spread END AS z,
    coalesce((rate - baseline) / spread >= 3.0, false) AS is_alert,
    CASE WHEN baseline IS NOT NULL THEN greatest((rate - baseline) * n_tickets, 0.0) END AS excess_errors
  FROM base b JOIN spread s ON b.{period} = s.{period} AND b.error_group = s.error_group)
"""


def next_success(table, strict):
    op = "<" if strict else "<="
    return f"""
nx AS (SELECT t.*, s.next_success FROM {table} t ASOF LEFT JOIN
  (SELECT DISTINCT customer_id, time AS next_success FROM {table} WHERE is_success) s
  ON t.customer_id = s.customer_id AND t.time {op} s.next_success)
"""


SECOND = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY time, ticket_id) AS rn FROM tickets WHERE is_success),
two AS (SELECT a.*, b.time AS second_time, (epoch_us(b.time) - epoch_us(a.time)) // {DAY} AS gap
  FROM ranked a LEFT JOIN ranked b ON a.customer_id = b.customer_id AND b.rn = 2 WHERE a.rn = 1)
"""
MONTH_END = "CAST(last_day(CAST(year_month || '-01' AS DATE)) AS TIMESTAMP)"
KPIS = SECOND + f""",
cm AS (SELECT year_month, customer_id, count(*) AS n, {N('is_success')} AS s, {N("platform = 'mobile'")} AS m,
    {N("platform = 'mobile' AND is_success")} AS ms FROM tickets GROUP BY 1, 2),
conv AS (SELECT year_month, avg(CASE WHEN s > 0 THEN 1.0::DOUBLE ELSE 0 END) AS conversion,
    avg(CASE WHEN m > 0 THEN CASE WHEN ms > 0 THEN 1.0::DOUBLE ELSE 0 END END) AS mobile_conversion,
    sum(ms) / nullif(sum(m), 0) AS app_completion_rate, {N('s > 0')} AS active FROM cm GROUP BY 1),
mon AS (SELECT year_month, count(*) AS tickets, {N('is_success')} AS ok, {S('final_price', 'is_success')} AS revenue,
    {N("is_success AND type = 'non-promotion'")} AS ok_plain FROM tickets GROUP BY 1),
fm AS (SELECT year_month, count(*) AS new, {N("type = 'non-promotion'")} AS new_plain,
    avg(CASE WHEN gap <= 90 THEN 1.0::DOUBLE ELSE 0 END) AS repeat_90d, avg(CASE WHEN gap <= 30 THEN 1.0::DOUBLE ELSE 0 END) AS retention_30d,
    {S('discount_value', "type = 'promotion'")} AS pd, {N("type = 'promotion' AND gap <= 90")} AS pr FROM two GROUP BY 1),
kpi AS (SELECT year_month, tickets, ok / tickets AS payment_success_rate, 1.0::DOUBLE - ok / tickets AS payment_failure_rate,
    nullif(ok, 0) AS success_tickets, revenue, conversion, mobile_conversion, app_completion_rate,
    CASE WHEN {MONTH_END} + INTERVAL 90 DAY <= data_end THEN repeat_90d END AS repeat_90d,
    CASE WHEN {MONTH_END} + INTERVAL 30 DAY <= data_end THEN retention_30d END AS retention_30d,
    (ok_plain - coalesce(new_plain, 0)) / nullif(ok - coalesce(new, 0), 0) AS repeat_no_promo_share,
    CASE WHEN {MONTH_END} + INTERVAL 90 DAY <= data_end THEN pd / nullif(pr, 0) END AS discount_per_retained,
    nullif(ok, 0) / nullif(active, 0) AS frequency, revenue / nullif(active, 0) AS spend_per_customer,
    CAST(sum({M('coalesce(revenue, 0)')}) OVER (ORDER BY year_month) AS DOUBLE)
      / nullif(sum(coalesce(new, 0)) OVER (ORDER BY year_month), 0) AS ltv_to_date
  FROM mon JOIN conv USING (year_month) LEFT JOIN fm USING (year_month), bounds)
"""
KEYS = [("success_tickets", 1, 1), ("conversion", 1, 1), ("revenue", 1, 1), ("repeat_90d", 2, 1), ("retention_30d", 2, 1),
        ("repeat_no_promo_share", 3, 1), ("discount_per_retained", 3, -1), ("payment_success_rate", 4, 1),
        ("payment_failure_rate", 4, -1), ("mobile_conversion", 5, 1), ("app_completion_rate", 5, 1), ("frequency", 6, 1),
        ("spend_per_customer", 6, 1), ("ltv_to_date", 6, 1)]
CHANGES = KPIS + ",\nlong AS (" + " UNION ALL ".join(
    f"SELECT year_month, {g} AS kpi_group, '{k}' AS kpi, CAST({k} AS DOUBLE) AS value, {d} AS d FROM kpi WHERE tickets >= 100"
    for k, g, d in KEYS) + """),
prev AS (SELECT *, lag(value) OVER (PARTITION BY kpi ORDER BY year_month) AS previous FROM long),
changes AS (SELECT year_month, kpi_group, kpi, value, previous, value - previous AS change,
  CASE WHEN value - previous IS NULL OR value - previous = 0 THEN '' WHEN (value - previous) * d > 0 THEN 'Tốt hơn' ELSE 'Xấu hơn' END AS verdict
  FROM prev)
"""
FULL_WEEK = """
wk AS (SELECT CASE WHEN max(time) >= max(week) + INTERVAL '6 days 23 hours' THEN max(week) ELSE max(week) - INTERVAL 7 DAY END AS w FROM tickets)
"""
LOSS = next_success("tickets", True) + f""",
lossm AS (SELECT year_month, {S('final_price', 'is_failed')} AS failed_value,
    {S('final_price', 'is_failed AND NOT coalesce(epoch_us(next_success) - epoch_us(time) <= 7 * ' + DAY + ', false)')} AS u,
    {S('discount_value', "is_success AND type = 'promotion'")} AS discount_total,
    {S('discount_value', "is_success AND type = 'promotion' AND NOT coalesce(epoch_us(next_success) - epoch_us(time) <= 90 * " + DAY + ", false)")} AS d
  FROM nx WHERE is_failed OR type = 'promotion' GROUP BY 1),
loss AS (SELECT *, unrecovered_failed_value / nullif(failed_value, 0) AS unrecovered_share,
    discount_one_time / nullif(discount_total, 0) AS one_time_discount_share
  FROM (SELECT year_month, failed_value, discount_total,
      CASE WHEN {MONTH_END} + INTERVAL '23 hours 59 minutes' + INTERVAL 7 DAY <= data_end THEN u END AS unrecovered_failed_value,
      CASE WHEN {MONTH_END} + INTERVAL '23 hours 59 minutes' + INTERVAL 90 DAY <= data_end THEN d END AS discount_one_time
    FROM lossm, bounds))
"""
CUT = "cut AS (SELECT date_trunc('day', max(time)) + INTERVAL 1 DAY AS cut FROM tickets)"


def rfm(cuts, label=False):
    y = (f", max(CASE WHEN is_success AND time >= cut AND time < cut + INTERVAL 90 DAY THEN 1 ELSE 0 END) AS y") if label else ""
    P = "is_success AND time < cut"
    mean = lambda c: f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE {P})"
    return f"""
{cuts},
x AS (SELECT cut, customer_id, max(time) FILTER (WHERE {P}) AS l, min(time) FILTER (WHERE {P}) AS f, {N(P)} AS frequency,
    count(DISTINCT year_month) FILTER (WHERE {P}) AS n_months, {S('final_price', P)} AS monetary,
    {mean("type = 'promotion'")} AS promo_share, round(avg(discount_rate) FILTER (WHERE {P}), 6) AS discount_rate,
    {mean("paying_method = 'money in app'")} AS wallet_share, {mean("platform = 'mobile'")} AS mobile_share,
    {N('is_failed AND time < cut')} AS n_failed{y} FROM tickets, cut GROUP BY 1, 2),
rfm AS (SELECT cut, customer_id, (epoch_us(cut) - epoch_us(l)) // {DAY} AS recency_days, (epoch_us(cut) - epoch_us(f)) // {DAY} AS tenure_days,
    frequency, n_months, monetary, monetary / frequency AS avg_price, promo_share, discount_rate, wallet_share, mobile_share, n_failed
    {', y' if label else ''} FROM x WHERE frequency > 0)
"""


SEG = """
seg AS (SELECT *, CASE segment WHEN 'Khách giá trị cao' THEN 'Membership, ưu đãi đặc quyền, đặt vé sớm phim hot'
    WHEN 'Khách mua một lần (mới)' THEN 'Tặng coupon cho lần mua thứ hai trong vòng 7–14 ngày'
    WHEN 'Khách lâu chưa quay lại' THEN 'Kéo lại bằng phim mới, voucher quay lại, thông báo cá nhân hóa'
    WHEN 'Khách nhạy khuyến mãi' THEN 'Chuyển từ giảm giá trực tiếp sang tích điểm, voucher cá nhân hóa'
    ELSE 'Duy trì, không cần giảm giá sâu' END AS action
  FROM (SELECT *, CASE WHEN frequency >= 3 AND recency_days <= 180 THEN 'Khách giá trị cao'
      WHEN frequency = 1 AND recency_days <= 30 THEN 'Khách mua một lần (mới)' WHEN recency_days > 90 THEN 'Khách lâu chưa quay lại'
      WHEN promo_share >= 0.5 THEN 'Khách nhạy khuyến mãi' ELSE 'Khách thường xuyên' END AS segment FROM rfm))
"""
RFM_COLS = ("customer_id, recency_days, tenure_days, frequency, n_months, monetary, avg_price, promo_share, discount_rate, "
            "wallet_share, mobile_share, n_failed")


def effect(by, minimum, name="effect"):
    return f"""
{name} AS (SELECT {by}, count(*) AS new_customers, avg(CASE WHEN gap <= 90 THEN 1.0::DOUBLE ELSE 0 END) AS returned_90d,
    {S('discount_value')} AS discount_spend, {N('gap <= 90')} AS n_returned,
    1.0::DOUBLE - avg(CASE WHEN gap <= 90 THEN 1.0::DOUBLE ELSE 0 END) AS one_time_rate,
    {S('discount_value')} / nullif({N('gap <= 90')}, 0) AS discount_per_returned
  FROM two, bounds WHERE time + INTERVAL 90 DAY <= data_end AND {by} IS NOT NULL GROUP BY 1 HAVING count(*) >= {minimum})
"""


COHORT = """
cohort AS (SELECT c.*, s.customers AS cohort_size, c.customers / s.customers AS retention FROM
  (SELECT year, strftime(first_month, '%Y-%m') AS first_month, CAST(month(m) - month(first_month) AS BIGINT) AS k, count(DISTINCT customer_id) AS customers
   FROM (SELECT year, customer_id, date_trunc('month', time) AS m, date_trunc('month', min(time) OVER (PARTITION BY year, customer_id)) AS first_month
     FROM tickets WHERE is_success) GROUP BY 1, 2, 3) c
  JOIN (SELECT year, strftime(first_month, '%Y-%m') AS first_month, count(*) AS customers FROM
    (SELECT year, customer_id, date_trunc('month', min(time)) AS first_month FROM tickets WHERE is_success GROUP BY 1, 2) GROUP BY 1, 2) s
  ON c.year = s.year AND c.first_month = s.first_month)
"""


def failure_by(c):
    return q(f"SELECT {c}, count(ticket_id) AS n_tickets, {N('is_failed')} AS n_failed, {N('is_failed')} / count(ticket_id) AS failure_rate "
             f"FROM tickets WHERE {c} IS NOT NULL GROUP BY 1")


FIRST_COLS = ("customer_id, time, ticket_id, first_failed, final_price, description, error_group, paying_method, year, week, "
              "first_success_time, n_success, ever_converted, hours_to_convert")
MIX = ", ".join(f"{N(f'campaign_type = {t!r}')} AS n_{t.replace(' ', '_')}" for t in ("direct discount", "voucher", "reward point"))
MIXN = ["n_direct_discount", "n_voucher", "n_reward_point"]

SQL = {
    "clean_tickets": q("SELECT * FROM tickets"),
    "event_attempts": e("SELECT a.*, description, coalesce(error_group, 'none') AS error_group, year(time) AS year, "
                        "strftime(time, '%Y-%m') AS year_month, date_trunc('week', time) AS week, hour(time) AS hour, "
                        "dayname(time) AS day_name FROM attempts a LEFT JOIN status USING (status_id)",
                        "status AS (" + __import__("oracle.base", fromlist=["STATUS"]).STATUS + ")"),
    "failure_rate_by_method": failure_by("paying_method"),
    "failure_rate_by_platform": failure_by("platform"),
    "failure_rate_by_campaign": failure_by("campaign_type"),
    "first_attempts": q(f"SELECT {FIRST_COLS} FROM first", FIRST),
    "lost_summary": q("SELECT * FROM summary", FIRST, SUMMARY),
    "lost_by_reason": q("""
SELECT dimension, CASE WHEN dimension = 'description' THEN substring(value, 1, 32) ELSE value END AS value, customers,
  customers / sum(customers) OVER (PARTITION BY dimension) AS share FROM (
  SELECT dimension, value, count(*) AS customers FROM (
    SELECT unnest(['description', 'paying_method', 'year', 'error_group']) AS dimension,
           unnest([description, paying_method, CAST(year AS VARCHAR), error_group]) AS value
    FROM first WHERE first_failed AND NOT ever_converted) WHERE value IS NOT NULL GROUP BY 1, 2)""", FIRST),
    "rescue_scenarios": q("""
SELECT r.rate AS rescue_rate, CAST(round_even(r.rate * never_converted, 0) AS BIGINT) AS customers_rescued,
  round_even(r.rate * lost_first_order_value, 0) AS value_rescued
FROM summary, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) r(rate)""", FIRST, SUMMARY),
    "followup_rates": q(f"""
SELECT {N('first_failed AND ever_converted')} / {N('first_failed')} AS bought_after_failed_first,
  {N('NOT first_failed AND n_success > 1')} / {N('NOT first_failed')} AS bought_again_after_ok_first FROM first""", FIRST),
    "weekly_error_rates": q("SELECT * FROM rates", rates("week", "tickets")),
    "recovery_rate_7d": q(f"""
SELECT count(*) AS failures, avg(CASE WHEN epoch_us(next_success) - epoch_us(time) <= 7 * {DAY} THEN 1.0::DOUBLE ELSE 0 END) AS recovery_rate
FROM nx, bounds WHERE is_failed AND time <= data_end - INTERVAL 7 DAY""", next_success("tickets", False)),
    "recovery_rate_events": e(f"""
SELECT count(*) AS failures, avg(CASE WHEN epoch_us(next_success) - epoch_us(time) <= {DAY} THEN 1.0::DOUBLE ELSE 0 END) AS recovery_rate
FROM nx WHERE is_failed AND time <= (SELECT max(time) FROM attempts) - INTERVAL 1 DAY""", next_success("attempts", False)),
    "next_success_gap": q(f"SELECT ticket_id, customer_id, time, next_success, (epoch_us(next_success) - epoch_us(time)) / {DAY} AS gap_days FROM nx",
                          next_success("tickets", True)),
    "next_success_gap_events": e(f"SELECT ticket_id, customer_id, time, next_success, (epoch_us(next_success) - epoch_us(time)) / {DAY} AS gap_days FROM nx",
                                 next_success("attempts", True)),
    "monthly_success_rate": q(f"SELECT year_month, count(*) AS tickets, {N('is_success')} AS success, {N('is_success')} / count(*) AS success_rate FROM tickets GROUP BY 1"),
    "monthly_external_rate": q(f"""SELECT year_month, count(*) AS tickets, {N("error_group = 'external'")} / count(*) AS external_rate FROM tickets GROUP BY 1"""),
    "error_trend_group": q("SELECT year_month, error_group, count(*) AS n_ords FROM tickets WHERE is_failed GROUP BY 1, 2"),
    "error_trend_code": q("SELECT year_month, description, count(*) AS n_ords FROM tickets WHERE is_failed AND description IS NOT NULL GROUP BY 1, 2"),
    "monthly_kpis": q("SELECT * FROM kpi", KPIS),
    "kpi_changes": q("SELECT * FROM changes", CHANGES),
    "kpi_snapshot": q("SELECT year_month, kpi_group, kpi, value, previous FROM changes WHERE year_month = (SELECT max(year_month) FROM kpi WHERE tickets >= 100)", CHANGES),
    "kpi_last_finished_month": q("SELECT max(year_month) AS year_month FROM kpi, wk WHERE tickets >= 100 AND CAST(year_month || '-01' AS DATE) + INTERVAL 1 MONTH <= w + INTERVAL 7 DAY", KPIS, FULL_WEEK),
    "monthly_losses": q("SELECT * FROM loss", LOSS),
    "loss_totals": q(f"""
SELECT *, unrecovered_failed_value / failed_value AS unrecovered_share, discount_one_time / discount_total AS one_time_discount_share FROM (
  SELECT min(year_month) AS first_month, max(year_month) AS last_month, {S('failed_value')} AS failed_value,
    {S('unrecovered_failed_value')} AS unrecovered_failed_value, {S('discount_total')} AS discount_total, {S('discount_one_time')} AS discount_one_time
  FROM loss WHERE failed_value IS NOT NULL AND unrecovered_failed_value IS NOT NULL AND discount_total IS NOT NULL AND discount_one_time IS NOT NULL
    AND unrecovered_share IS NOT NULL AND one_time_discount_share IS NOT NULL)""", LOSS),
    "latest_losses": q("""
SELECT u.year_month AS unrecovered_month, u.failed_value, u.unrecovered_failed_value, u.unrecovered_share,
  d.year_month AS one_time_discount_month, d.discount_total, d.discount_one_time, d.one_time_discount_share
FROM (SELECT * FROM loss WHERE unrecovered_failed_value IS NOT NULL ORDER BY year_month DESC LIMIT 1) u,
     (SELECT * FROM loss WHERE discount_one_time IS NOT NULL ORDER BY year_month DESC LIMIT 1) d""", LOSS),
    "rfm_segments": q(f"SELECT {RFM_COLS}, segment, action FROM seg", rfm(CUT), SEG),
    "segment_summary": q("""SELECT segment, count(*) AS customers, round(avg(1.0::DOUBLE / (1 + recency_days)), 6) AS avg_score,
  sum(frequency) / count(*) AS avg_frequency, sum(recency_days) / count(*) AS avg_recency_days, any_value(action) AS action FROM seg GROUP BY 1""", rfm(CUT), SEG),
    "training_set": q(f"SELECT cut, {RFM_COLS}, y FROM rfm", rfm("cut AS (SELECT (SELECT date_trunc('day', max(time)) + INTERVAL 1 DAY FROM tickets) - INTERVAL 90 DAY - to_months(k) AS cut FROM (VALUES (0), (1), (2)) v(k))", True)),
    "campaign_effectiveness": q("SELECT * FROM effect", SECOND, effect("campaign_type", 100)),
    "campaign_id_effectiveness": q("SELECT * FROM effect", SECOND, effect("campaign_id", 20)),
    "campaign_verdict": q(f"""
SELECT (SELECT campaign_type FROM effect WHERE campaign_type <> 'none' ORDER BY one_time_rate DESC, campaign_type LIMIT 1) AS worst_campaign_type,
  (SELECT campaign_type FROM effect WHERE campaign_type <> 'none' ORDER BY one_time_rate, campaign_type DESC LIMIT 1) AS best_campaign_type,
  (SELECT {N('one_time_rate >= 0.4')} FROM byid) AS campaign_ids_one_time""", SECOND, effect("campaign_type", 100), effect("campaign_id", 20, "byid")),
    "cohort_retention": q("SELECT * FROM cohort", COHORT),
    "cohort_matrix": q("SELECT year, first_month, any_value(cohort_size) AS cohort_size, " + ", ".join(
        f"max(retention) FILTER (WHERE k = {k}) AS m{k}" for k in range(12)) + " FROM cohort GROUP BY 1, 2", COHORT),
    "mean_retention": q("SELECT year, k, round(avg(retention), 6) AS mean_retention FROM cohort GROUP BY 1, 2", COHORT),
    "customer_value": q(f"""SELECT customer_id, count(*) AS n_total, {N('is_success')} AS n_success, coalesce({S('original_price', 'is_success')}, 0) AS s_money,
  coalesce({S('discount_value', 'is_success')}, 0) AS s_discount, {N('is_success')} / count(*) AS success_rate FROM tickets GROUP BY 1"""),
    "buyer_value": q(f"""SELECT *, n_total - n_success AS n_failed, n_success / n_total AS success_rate, n_promotions / n_success AS promotion_value,
  s_discount / nullif(s_money, 0) AS discount_value FROM (
  SELECT customer_id, {N('is_success')} AS n_success, {S('original_price', 'is_success')} AS s_money, {S('discount_value', 'is_success')} AS s_discount,
    count(DISTINCT CAST(time AS DATE)) FILTER (WHERE is_success) AS n_days, count(DISTINCT year_month) FILTER (WHERE is_success) AS n_months,
    {N("is_success AND type = 'promotion'")} AS n_promotions, count(*) AS n_total FROM tickets GROUP BY 1) WHERE n_success > 0"""),
    "purchase_distribution": q(f"""SELECT measure, CASE WHEN v >= 4 THEN '4+' ELSE CAST(v AS VARCHAR) END AS bucket, count(*) AS customers FROM (
  SELECT unnest(['purchases', 'promo_purchases']) AS measure, unnest([a, b]) AS v FROM (
    SELECT customer_id, {N('is_success')} AS a, {N("is_success AND type = 'promotion'")} AS b FROM tickets GROUP BY 1)) GROUP BY 1, 2"""),
    "promo_usage": q(f"""SELECT sum(p) / sum(s) AS promo_ticket_share, {N('p > 0')} / {N('s > 0')} AS promo_buyer_share,
  {N('p = 1')} / {N('p > 0')} AS used_once_share, sum(d) / sum(p) AS direct_discount_share FROM (
  SELECT customer_id, {N('is_success')} AS s, {N("is_success AND type = 'promotion'")} AS p,
    {N("is_success AND campaign_type = 'direct discount'")} AS d FROM tickets GROUP BY 1)"""),
    "promo_mix": q("SELECT *, " + ", ".join(f"{n} / total AS {n}_pct" for n in MIXN) + f""" FROM (
  SELECT n_promotions, count(*) AS n_cus, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in MIXN)}, CAST(sum({' + '.join(MIXN)}) AS BIGINT) AS total FROM (
    SELECT customer_id, count(*) AS n_promotions, {MIX} FROM tickets WHERE is_success AND type = 'promotion' GROUP BY 1) GROUP BY 1)"""),
    "promo_vs_organic": q(f"""SELECT type AS first_type, count(*) AS customers, {N('second_time IS NOT NULL')} AS returned,
  {N('second_time IS NOT NULL')} / count(*) AS return_rate FROM two GROUP BY 1""", SECOND),
    "heavy_buyers": q("""SELECT customer_id, year_month, count(*) AS tickets FROM tickets WHERE is_success AND customer_id IN (
  SELECT customer_id FROM tickets WHERE is_success GROUP BY 1 HAVING count(*) > 5) GROUP BY 1, 2"""),
    "recovered_vs_never": q("""SELECT *, failures / sum(failures) OVER (PARTITION BY customers, dimension) AS share FROM (
  SELECT customers, dimension, value, count(*) AS failures FROM (
    SELECT CASE WHEN b.n = 0 THEN 'never bought' ELSE 'recovered' END AS customers, unnest(['error_group', 'paying_method']) AS dimension,
      unnest([error_group, paying_method]) AS value
    FROM tickets JOIN (SELECT customer_id, count(*) FILTER (WHERE is_success) AS n FROM tickets GROUP BY 1) b USING (customer_id) WHERE is_failed) GROUP BY 1, 2, 3)"""),
    "low_success_profile": q(f"""SELECT * EXCLUDE (s), n_promotions / n_orders AS promotion_rate, s_discount / nullif(s_money, 0) AS discount_rate FROM (
  SELECT customer_id, count(*) AS n_orders, {N('is_success')} AS s, {S('original_price')} AS s_money, {S('discount_value')} AS s_discount,
    {N("type = 'promotion'")} AS n_promotions FROM tickets GROUP BY 1) WHERE s > 0 AND s < n_orders"""),
    "low_success_errors": q("""SELECT year_month, description, count(*) AS n_ords FROM tickets WHERE is_failed AND customer_id IN (
  SELECT customer_id FROM tickets GROUP BY 1 HAVING count(*) FILTER (WHERE is_success) BETWEEN 1 AND count(*) - 1) GROUP BY 1, 2"""),
}
