"""Oracle SQL for volumes, alerts, weekly reports, marts, profiles, ranking metrics and the gold questions."""

from oracle.base import e, q
from oracle.payments import (CUT, DAY, FIRST, FULL_WEEK, I, KPIS, N, RFM_COLS, S, SECOND, SEG, alerts, effect, next_success, rates,
                             rfm)
from tillwatch.schema import RECOVERY_MESSAGES

ALERTS = (rates("week", "tickets"), alerts("week", 20))
METHODS = ["money in app", "bank account", "credit card", "debit card", "other"]
TYPES = ["none", "direct discount", "voucher", "reward point"]


def shares(by, within=()):
    keys = ", ".join([*within, by])
    over = f"PARTITION BY {', '.join(within)}" if within else ""
    return q(f"SELECT *, tickets / sum(tickets) OVER ({over}) AS share FROM (SELECT {keys}, count(*) AS tickets FROM tickets GROUP BY ALL)")


def pivot(col, values):
    cols = ", ".join(N(f"{col} = '{v}'") + " AS " + v.lower().replace(" ", "_") for v in values)
    return q(f"SELECT year_month, {cols} FROM tickets GROUP BY 1")


FACTS = f"""
prevw AS (SELECT a.week, sum(b.ok) / sum(b.n) AS success_rate_prev FROM wagg a LEFT JOIN wagg b
  ON b.week < a.week AND b.week >= a.week - INTERVAL 56 DAY GROUP BY 1),
te AS (SELECT week, description AS top_error, n AS top_error_count FROM (SELECT week, description, count(*) AS n,
    row_number() OVER (PARTITION BY week ORDER BY count(*) DESC, description) AS r FROM tickets WHERE is_failed AND description IS NOT NULL GROUP BY 1, 2) WHERE r = 1),
me AS (SELECT week, paying_method, {N('is_failed')} / count(*) AS fail FROM tickets GROUP BY 1, 2 HAVING count(*) >= 5),
mw AS (SELECT week, paying_method, fail FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY fail DESC, paying_method) AS r FROM me) WHERE r = 1),
mb AS (SELECT week, paying_method, fail FROM (SELECT *, row_number() OVER (PARTITION BY week ORDER BY fail, paying_method DESC) AS r FROM me) WHERE r = 1),
nw AS (SELECT week, count(*) AS a, {N('first_failed')} AS b, {N("first_failed AND NOT coalesce(date_trunc('week', first_success_time) = week, false)")} AS c FROM first GROUP BY 1),
ag AS (SELECT week, {', '.join(f"any_value({c}) FILTER (WHERE error_group = '{g}') AS {g}_{c}" for g in ('customer', 'external', 'internal') for c in ('rate', 'baseline', 'z', 'is_alert', 'excess_errors'))}
  FROM alerts GROUP BY 1)
"""
WAGG = f"""
wagg AS (SELECT week, count(*) AS n, {N('is_success')} AS ok, {N('is_failed')} AS failed, coalesce({S('final_price', 'is_failed')}, 0) AS fv,
  {N("is_success AND type = 'promotion'")} AS promo, coalesce({S('discount_value', 'is_success')}, 0) AS disc FROM tickets GROUP BY 1)
"""
CELLS = f"""
cells AS (SELECT description, platform, paying_method, {N('week = w')} AS n, {N('week = w AND is_failed')} AS errors, {N('week < w')} AS pn,
    {N('week < w AND is_failed')} AS pe FROM tickets, wk WHERE week <= w AND week >= w - INTERVAL 56 DAY GROUP BY 1, 2, 3),
chg AS (SELECT *, (rate - baseline_rate) * 100 AS change_pp, greatest((rate - baseline_rate) * attempts, 0.0) AS excess_errors FROM (
  SELECT description, platform, paying_method, errors, CAST(attempts AS BIGINT) AS attempts, errors / attempts AS rate, coalesce(pe / nullif(past, 0), 0.0) AS baseline_rate
  FROM (SELECT *, sum(n) OVER (PARTITION BY platform, paying_method) AS attempts, sum(pn) OVER (PARTITION BY platform, paying_method) AS past FROM cells)
  WHERE errors > 0 AND description IS NOT NULL AND attempts >= 1))
"""
MESSAGE = "CASE status_id " + " ".join(f"WHEN {k} THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in RECOVERY_MESSAGES.items()) + " END"
HIST = """
hist AS (SELECT *, row_number() OVER w - 1 AS prev_n, coalesce(sum(CAST(is_failed AS INT)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_f,
    lag(is_failed) OVER w AS lf, lag(time) OVER w AS lt FROM tickets WINDOW w AS (PARTITION BY customer_id ORDER BY time, ticket_id))
"""
FEATURES = f"""
feat AS (SELECT ticket_id, customer_id, time, status_id, coalesce(paying_method, 'unknown') AS paying_method, platform, os_version, campaign_type,
    coalesce(usergender, 'unknown') AS usergender, hour, isodow(time) - 1 AS dow, original_price, discount_rate, year(dob) AS birth_year, prev_n AS n_prev_attempts,
    {I('prev_f')} AS n_prev_failed, {I('prev_n - prev_f')} AS n_prev_success, coalesce(CAST(lf AS BIGINT), 0) AS last_attempt_failed,
    coalesce((epoch_us(time) - epoch_us(lt)) / 60000000, -1.0) AS minutes_since_prev, CAST(is_failed AS BIGINT) AS is_failed FROM hist)
"""
RULE = """
rule AS (SELECT f.*, coalesce(r.s, (SELECT avg(is_failed) FROM feat WHERE time < TIMESTAMP '2000-01-01')) AS score FROM feat f
  LEFT JOIN (SELECT paying_method, avg(is_failed) AS s FROM feat WHERE time < TIMESTAMP '2000-01-01' GROUP BY 1) r USING (paying_method)
  WHERE time >= TIMESTAMP '2000-01-01'),
scored AS (SELECT round(score, 6) AS score, is_failed AS y FROM rule)
"""
RECENCY = rfm("cut AS (SELECT date_trunc('day', max(time)) + INTERVAL 1 DAY - INTERVAL 90 DAY AS cut FROM tickets)", True) + """,
scored AS (SELECT -CAST(recency_days AS DOUBLE) AS score, y FROM rfm)
"""
# all pairs of score groups: the definition of the area under the curve
AUC = """
SELECT (SELECT sum(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5::DOUBLE ELSE 0 END * p.k * n.k)
  FROM (SELECT score, count(*) AS k FROM scored WHERE y = 1 GROUP BY 1) p, (SELECT score, count(*) AS k FROM scored WHERE y = 0 GROUP BY 1) n)
  / ((SELECT count(*) FROM scored WHERE y = 1) * (SELECT count(*) FROM scored WHERE y = 0)) AS auc
"""
GROUPS = """
sg AS (SELECT *, sum(n) OVER (ORDER BY score) - n AS below, sum(n) OVER (ORDER BY score DESC) - n AS above, (SELECT count(*) FROM scored) AS rows,
  (SELECT sum(y) FROM scored) AS positives FROM (SELECT score, count(*) AS n, sum(y) AS pos FROM scored GROUP BY 1))
"""
TOP = """
SELECT fraction, CAST(sum(taken) AS BIGINT) AS n_top, round(sum(pos * taken / n) / any_value(positives), 6) AS capture, round(sum(pos * taken / n) / sum(taken), 6) AS precision,
  any_value(positives) / any_value(rows) AS base_rate
FROM (SELECT *, greatest(least(n, floor(rows * fraction) - above), 0) AS taken FROM sg, (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) v(fraction)) GROUP BY 1
"""
DECILES = """
SELECT b AS decile, round(sum(score * part) / sum(part), 6) AS predicted, round(sum(pos * part / n) / sum(part), 6) AS actual, CAST(sum(part) AS BIGINT) AS tickets
FROM (SELECT *, greatest(least(below + n, b * rows // 10) - greatest(below, (b - 1) * rows // 10), 0) AS part FROM sg, range(1, 11) r(b)) WHERE part > 0 GROUP BY 1
"""
DIM = f"""
act AS (SELECT customer_id, min(time) AS first_attempt_time, min(time) FILTER (WHERE is_success) AS first_success_time, count(*) AS na, {N('is_success')} AS ns,
    {S('final_price', 'is_success')} AS sp, {S('discount_value', 'is_success')} AS sd FROM tickets GROUP BY 1),
fa AS (SELECT customer_id, is_failed AS first_attempt_failed FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY time, ticket_id) AS rn FROM tickets) WHERE rn = 1),
dim AS (SELECT customer_id, usergender, dob, first_attempt_time, first_success_time, coalesce(na, 0) AS n_attempts, coalesce(ns, 0) AS n_success,
    coalesce(sp, 0) AS total_spend, coalesce(sd, 0) AS total_discount, first_attempt_failed, na IS NOT NULL AS has_activity,
    coalesce(na, 0) - coalesce(ns, 0) AS n_failed, ns / nullif(na, 0) AS success_rate,
    date_diff('year', dob, ref) - CASE WHEN month(dob) > month(ref) OR (month(dob) = month(ref) AND day(dob) > day(ref)) THEN 1 ELSE 0 END AS age,
    CASE WHEN year(dob) < 1965 THEN 'baby boomers' WHEN year(dob) < 1981 THEN 'gen x' WHEN year(dob) < 1997 THEN 'gen y' ELSE 'gen z' END AS age_generation,
    coalesce(first_attempt_failed, false) AND first_success_time IS NULL AS lost_at_first_payment,
    usergender <> 'Not verify' AND year(dob) <> 1970 AS is_verified_profile
  FROM customers LEFT JOIN act USING (customer_id) LEFT JOIN fa USING (customer_id), (SELECT CAST(data_end AS DATE) AS ref FROM bounds))
"""
CAMP = SECOND + "," + effect("campaign_id", 1) + f""",
camp AS (SELECT t.*, new_customers, returned_90d, one_time_rate, discount_per_returned, coalesce(campaign_type, 'none') AS campaign_type FROM (
  SELECT campaign_id, count(*) AS tickets, {N('is_success')} AS success_tickets, count(DISTINCT customer_id) FILTER (WHERE is_success) AS customers,
    coalesce(CAST(round(sum(CAST(final_price AS DECIMAL(18,4))) FILTER (WHERE is_success), 2) AS DOUBLE), 0) AS revenue,
    coalesce(CAST(round(sum(CAST(discount_value AS DECIMAL(18,4))) FILTER (WHERE is_success), 2) AS DOUBLE), 0) AS discount_spend,
    {N('is_failed')} / count(*) AS failure_rate FROM tickets GROUP BY 1) t
  LEFT JOIN effect USING (campaign_id) LEFT JOIN campaigns USING (campaign_id))
"""
CUST = "cu AS (SELECT DISTINCT customer_id, usergender, dob, age, age_generation FROM tickets)"
MART_SCORE = "ms AS (SELECT *, round(1.0::DOUBLE / (1 + recency_days), 4) AS repurchase_score FROM seg)"
TICKET_COLS = ["ticket_id", "customer_id", "paying_method", "theater_name", "device_number", "original_price", "discount_value", "final_price",
               "time", "status_id", "campaign_id", "movie_name", "usergender", "dob", "campaign_type", "model", "platform", "description",
               "error_group", "is_success", "is_failed", "type", "os_version", "age", "age_generation", "discount_rate", "year", "year_month",
               "week", "hour", "day_name"]
MART_KEYS = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows, count(DISTINCT {key}) AS keys, count(*) = count(DISTINCT {key}) AS \"unique\" FROM {src}"
    for t, key, src in [
        ("fact_payment_attempts", "ticket_id", "hist"), ("dim_customer", "customer_id", "dim"),
        ("customer_features", "customer_id", "seg"), ("campaign_summary", "campaign_id", "camp")])


SQL = {
    "volume_by_month": q("""SELECT strftime(m, '%Y-%m') AS year_month, count(ticket_id) AS tickets FROM
  (SELECT unnest(generate_series((SELECT date_trunc('month', min(time)) FROM tickets), (SELECT max(time) FROM tickets), INTERVAL 1 MONTH)) AS m)
  LEFT JOIN tickets ON year_month = strftime(m, '%Y-%m') GROUP BY 1"""),
    "volume_by_weekday": q("SELECT isodow(time) - 1 AS dow, day_name, count(*) AS tickets FROM tickets GROUP BY 1, 2"),
    "volume_by_hour": q("SELECT hour, count(*) AS tickets FROM tickets GROUP BY 1"),
    "volume_by_device": q("SELECT platform, os_version, count(*) AS tickets FROM tickets GROUP BY 1, 2"),
    "weekend_ratio": q("""SELECT *, weekend_mean / weekday_mean AS ratio FROM (SELECT avg(n) FILTER (WHERE isodow(d) >= 6) AS weekend_mean,
  avg(n) FILTER (WHERE isodow(d) <= 4) AS weekday_mean FROM (SELECT CAST(time AS DATE) AS d, count(*) AS n FROM tickets GROUP BY 1))"""),
    "platform_shares": shares("platform"),
    "method_shares_by_month": shares("paying_method", ("year_month",)),
    "month_method_pivot": pivot("paying_method", METHODS),
    "month_campaign_pivot": pivot("campaign_type", TYPES),
    "movie_summary": q(f"SELECT movie_name, count(*) AS total_ticket, count(DISTINCT customer_id) AS total_customer, {S('final_price')} AS revenue FROM tickets WHERE is_success AND movie_name IS NOT NULL GROUP BY 1"),
    "movie_months": q("""SELECT movie_name, year_month, count(*) AS tickets FROM tickets WHERE is_success AND movie_name IN (
  SELECT movie_name FROM tickets WHERE is_success GROUP BY 1 HAVING count(*) > 150) GROUP BY 1, 2"""),
    "weekly_alerts": q("SELECT * FROM alerts", *ALERTS),
    "daily_alerts": e("SELECT * FROM alerts",
                      "status AS (" + __import__("oracle.base", fromlist=["STATUS"]).STATUS + ")",
                      "ev AS (SELECT a.*, CAST(time AS DATE) AS day, coalesce(error_group, 'none') AS error_group FROM attempts a LEFT JOIN status USING (status_id))",
                      rates("day", "ev"), alerts("day", 100)),
    "alerts_of_year": q("SELECT * FROM alerts WHERE is_alert AND year(week) = 2000", *ALERTS),
    "alert_calendar": q("""SELECT s.week, a.* EXCLUDE (week, error_group) FROM (SELECT unnest(generate_series(mw - INTERVAL 175 DAY, mw, INTERVAL 7 DAY)) AS week FROM (SELECT max(week) AS mw FROM alerts)) s
  LEFT JOIN (SELECT * FROM alerts WHERE error_group = 'external') a ON a.week = s.week""", *ALERTS),
    "weekly_facts": q("""
SELECT a.week, a.n AS tickets, a.ok / a.n AS success_rate, a.failed AS failed_tickets, a.fv AS failed_ticket_value, a.promo / nullif(a.ok, 0) AS promotion_share_of_success,
  a.disc AS discount_spend, success_rate_prev, top_error, coalesce(top_error_count, 0) AS top_error_count, mw.paying_method AS worst_payment_method,
  mw.fail AS worst_payment_method_failure_rate, mb.paying_method AS best_payment_method, mb.fail AS best_payment_method_failure_rate,
  coalesce(nw.a, 0) AS new_customers, coalesce(nw.b, 0) AS new_customers_failed_first_payment, coalesce(nw.c, 0) AS new_customers_lost_at_payment,
  ag.* EXCLUDE (week), CAST(a.week AS DATE) + 6 AS week_end
FROM wagg a LEFT JOIN prevw USING (week) LEFT JOIN te USING (week) LEFT JOIN mw ON mw.week = a.week LEFT JOIN mb ON mb.week = a.week
  LEFT JOIN nw ON nw.week = a.week LEFT JOIN ag ON ag.week = a.week""", FIRST, *ALERTS, WAGG, FACTS),
    "breakdown_changes": q("SELECT * FROM chg", FULL_WEEK, CELLS),
    "top_increases": q("SELECT * FROM chg WHERE change_pp > 0 ORDER BY excess_errors DESC, description, platform, paying_method LIMIT 3", FULL_WEEK, CELLS),
    "recovery_list": q(f"""SELECT ticket_id, customer_id, time, paying_method, status_id, description, {MESSAGE} AS message FROM (
  SELECT f.*, row_number() OVER (PARTITION BY f.customer_id ORDER BY f.time DESC, f.ticket_id DESC) AS r FROM tickets f, wk WHERE f.week = w AND f.is_failed
    AND NOT coalesce((SELECT max(s.time) FROM tickets s WHERE s.week = w AND s.is_success AND s.customer_id = f.customer_id) > f.time, false)) WHERE r = 1""", FULL_WEEK),
    "errors_by_code": q("SELECT description, count(*) AS errors FROM tickets, wk WHERE week = w AND is_failed GROUP BY 1", FULL_WEEK),
    "fact_payment_attempts": q("""SELECT ticket_id, customer_id, time, CAST(time AS DATE) AS date, week, year_month, hour, day_name, paying_method, platform, os_version,
  device_number, theater_name, movie_name, campaign_id, campaign_type, type = 'promotion' AS is_promotion,
  CAST(round(CAST(original_price AS DECIMAL(18,4)), 2) AS DOUBLE) AS original_price, CAST(round(CAST(discount_value AS DECIMAL(18,4)), 2) AS DOUBLE) AS discount_value,
  CAST(round(CAST(final_price AS DECIMAL(18,4)), 2) AS DOUBLE) AS final_price, round(discount_rate, 4) AS discount_rate, status_id, description AS status_description,
  error_group, is_success, prev_n + 1 AS attempt_number, prev_n = 0 AS is_first_attempt FROM hist""", HIST),
    "dim_customer": q("SELECT * FROM dim", DIM),
    "customer_features_mart": q(f"SELECT cut AS as_of, {RFM_COLS}, segment, action, repurchase_score, 'rule: recency' AS score_source FROM ms", rfm(CUT), SEG, MART_SCORE),
    "campaign_summary": q("SELECT * FROM camp", CAMP),
    "lost_by_generation": q(f"SELECT age_generation, count(*) AS customers, {N('lost_at_first_payment')} / count(*) AS lost_rate FROM dim WHERE has_activity AND is_verified_profile GROUP BY 1", DIM),
    "mart_keys": q(MART_KEYS, HIST, DIM, rfm(CUT), SEG, CAMP),
    "null_profile": q(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {N(f'{c} IS NULL')} AS null_count, {N(f'{c} IS NULL')} / count(*) AS null_rate FROM tickets" for c in TICKET_COLS)),
    "distinct_values": q(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n, (SELECT count(DISTINCT {c}) FROM tickets) AS n_unique FROM tickets WHERE {c} IS NOT NULL GROUP BY {c}"
                                            for c in ("paying_method", "platform", "usergender", "movie_name"))),
    "gender_counts": q("SELECT usergender, count(*) AS total FROM cu GROUP BY 1", CUST),
    "age_histogram": q("SELECT usergender, (age // 5) * 5 AS age_from, count(*) AS customers FROM cu GROUP BY 1, 2", CUST),
    "unverified_profile": q(f"""SELECT count(*) AS customers, {N("usergender = 'Not verify'")} AS not_verified,
  {N("usergender = 'Not verify' AND year(dob) = 1970")} / {N("usergender = 'Not verify'")} AS not_verified_born_1970,
  {N("usergender <> 'Not verify' AND age BETWEEN 26 AND 35")} / {N("usergender <> 'Not verify'")} AS verified_aged_26_35 FROM cu""", CUST),
    "unverified_top_ages": q("SELECT age, count(*) AS total FROM cu WHERE usergender = 'Not verify' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", CUST),
    "last_kpi_months": q("SELECT * FROM kpi ORDER BY year_month DESC LIMIT 12", KPIS),
    "score_description": q("SELECT segment, count(*) AS count, round(avg(repurchase_score), 6) AS mean, median(repurchase_score) AS median, max(repurchase_score) AS max FROM ms GROUP BY 1", rfm(CUT), SEG, MART_SCORE),
    "point_in_time_features": q("SELECT * FROM feat", HIST, FEATURES),
    "repeat_labels": q("SELECT customer_id, ticket_id, time, year, CASE WHEN gap <= 90 THEN 1 ELSE 0 END AS repeat_90d FROM two", SECOND),
    "recovery_labels": q(f"SELECT ticket_id, customer_id, time, year, CASE WHEN epoch_us(next_success) - epoch_us(time) <= 7 * {DAY} THEN 1 ELSE 0 END AS recovered_7d FROM nx WHERE is_failed", next_success("tickets", False)),
    "rule_auc": q(AUC, HIST, FEATURES, RULE),
    "rule_capture": q(TOP, HIST, FEATURES, RULE, GROUPS),
    "recency_auc": q(AUC, RECENCY),
    "recency_deciles": q(DECILES, RECENCY, GROUPS),
}
YES = "CAST(is_success AS INT)"
SQL |= {
    "gold_q01": q("SELECT count(*) AS attempts FROM tickets"),
    "gold_q02": q("SELECT count(DISTINCT customer_id) AS customers FROM tickets"),
    "gold_q03": q(f"SELECT avg({YES}) AS success_rate FROM tickets WHERE year = 2000"),
    "gold_q04": q(f"SELECT paying_method FROM tickets GROUP BY 1 ORDER BY 1 - avg({YES}) DESC, paying_method LIMIT 1".replace("BY 1 -", "BY 1.0 -")),
    "gold_q05": q("SELECT description FROM tickets WHERE NOT is_success GROUP BY 1 ORDER BY count(*) DESC, description LIMIT 1"),
    "gold_q06": q("SELECT CAST(round(sum(CAST(final_price AS DECIMAL(18,4))), 2) AS DOUBLE) AS revenue FROM tickets WHERE is_success AND year = 1999"),
    "gold_q07": q("SELECT movie_name FROM tickets WHERE is_success GROUP BY 1 ORDER BY count(*) DESC, movie_name LIMIT 1"),
    "gold_q08": q("SELECT year_month FROM tickets GROUP BY 1 ORDER BY count(*) DESC, year_month LIMIT 1"),
    "gold_q09": q("SELECT count(*) AS external_errors FROM tickets WHERE year = 2000 AND error_group = 'external'"),
    "gold_q10": q("SELECT campaign_type FROM tickets WHERE is_success AND type = 'promotion' GROUP BY 1 ORDER BY count(*) DESC, campaign_type LIMIT 1"),
    "gold_q11": q(f"SELECT platform, 1 - avg({YES}) AS failure_rate FROM tickets WHERE platform IN ('mobile', 'website') GROUP BY 1"),
    "gold_q12": q("SELECT day_name FROM tickets WHERE is_success GROUP BY 1 ORDER BY count(*) DESC, day_name LIMIT 1"),
}
