"""Oracle SQL for retrieval, grounding, daily-load checks and streams."""

from oracle.base import EVENTS, STATUS, q

WORD = r"[\p{L}\p{N}_]+"


def term_ctes(docs, queries):
    def grams(name, src, key):
        return f"""
{name}words AS MATERIALIZED (SELECT {key}, regexp_extract_all(lower(text), '{WORD}') AS w FROM {src}),
{name}t AS MATERIALIZED (SELECT {key}, term, count(*) AS n FROM (SELECT {key}, unnest(w) AS term FROM {name}words UNION ALL
    SELECT {key}, w[i] || ' ' || w[i + 1] AS term FROM (SELECT {key}, w, unnest(range(1, len(w))) AS i FROM {name}words)) GROUP BY 1, 2)"""
    return f"""
{grams('d', docs, 'doc_id')},
{grams('q', queries, 'item_id')},
idf AS MATERIALIZED (SELECT term, ln((1 + (SELECT count(*) FROM {docs})) / (1 + count(*))) + 1 AS idf FROM dt GROUP BY 1),
dw AS MATERIALIZED (SELECT doc_id, term, (1 + ln(n)) * idf AS w FROM dt JOIN idf USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM dw GROUP BY 1),
qw AS MATERIALIZED (SELECT item_id, term, (1 + ln(n)) * idf AS w FROM qt JOIN idf USING (term)),
qn AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
kw AS MATERIALIZED (SELECT item_id, doc_id, round(sum(qw.w / qn.norm * (dw.w / dn.norm)), 6) AS score
  FROM qw JOIN qn USING (item_id) JOIN dw USING (term) JOIN dn USING (doc_id) GROUP BY 1, 2)
"""


VEC = """
qv AS (SELECT item_id, embedding FROM benchmark JOIN embeddings ON item_id = vec_id),
vs AS MATERIALIZED (SELECT item_id, vec_id AS doc_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(qv.embedding[i] AS DOUBLE))), 6) AS score
  FROM embeddings a, qv)
"""


def top(scores, k=6):
    return (f"SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank "
            f"FROM {scores}) WHERE rank <= {k}")


def w(body, *ctes):
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n" + body.strip()


FUSED = """
vs2 AS MATERIALIZED (SELECT * FROM vs WHERE doc_id IN (SELECT doc_id FROM documents)),
kr AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM kw),
vr AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM vs2),
m AS (SELECT item_id, count(*) AS m FROM kw GROUP BY 1),
f AS (SELECT item_id, doc_id, coalesce(kr.r, coalesce(m, 0) + 1) AS keyword_rank, vr.r AS vector_rank,
    round(1.0::DOUBLE / (coalesce(kr.r, coalesce(m, 0) + 1) + 60) + coalesce(1.0::DOUBLE / (vr.r + 60), 0), 9) AS score
  FROM (SELECT item_id, doc_id FROM (SELECT DISTINCT item_id FROM benchmark), documents) LEFT JOIN kr USING (item_id, doc_id)
    LEFT JOIN vr USING (item_id, doc_id) LEFT JOIN m USING (item_id))
"""
HITS = """
top6 AS (""" + top("kw") + """),
h AS (SELECT b.item_id, min(CASE WHEN d.source IN ('src' || (b.item_id % 20), 'src' || ((b.item_id + 7) % 20)) THEN t.rank END) AS rank
  FROM benchmark b LEFT JOIN top6 t USING (item_id) LEFT JOIN searched d USING (doc_id) GROUP BY 1)
"""
# sections of these texts: documents have no headings; a turn has its path in the text built around it
PASSAGES = r"""
src AS (SELECT 'documents/' || doc_id AS source, lang || ' ' || source AS label, 0 AS section, lang || ' ' || source AS title, text FROM documents
  UNION ALL SELECT 'conversations/' || conv_id || '/' || turn, 'Conversations', 0, 'Turn ' || turn || ' › ' || role, text FROM conversations),
body AS (SELECT source, label, section, title, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM src),
long AS MATERIALIZED (SELECT *, string_split_regex(text, '\n') AS p FROM body WHERE length(text) > 1500),
pack AS (
  SELECT source, 1 AS i, 0 AS part, p[1] AS cur FROM long
  UNION ALL SELECT k.source, i + 1, CASE WHEN cur <> '' AND length(cur) + length(p[i + 1]) + 1 > 1500 THEN part + 1 ELSE part END,
    CASE WHEN cur = '' OR length(cur) + length(p[i + 1]) + 1 > 1500 THEN p[i + 1] ELSE cur || chr(10) || p[i + 1] END
  FROM pack k JOIN long USING (source) WHERE i < len(p)),
parts AS (SELECT source, part, arg_max(cur, i) AS text FROM pack GROUP BY 1, 2),
passage AS (SELECT source, label, section, title, 0 AS part, text FROM body WHERE length(text) BETWEEN 40 AND 1500
  UNION ALL SELECT source, label, section, title, x.part, x.text FROM parts x JOIN (SELECT source, label, section, title FROM long) USING (source))
"""
NUM = r"\d+(?:[.,]\d+)*%?"
CIT = r"\[\d+(?:\s*,\s*\d+)*\]"
SMALL = "[" + ", ".join(f"'{i}'" for i in range(11)) + "]"


def ungrounded(answer, evidence):
    return (f"list_sort(list_filter(list_distinct(regexp_extract_all(regexp_replace({answer}, '{CIT}', '', 'g'), '{NUM}')), lambda n: "
            f"NOT list_contains(list_concat(regexp_extract_all({evidence}, '{NUM}'), {SMALL}), n) AND "
            f"NOT list_contains(list_concat(regexp_extract_all({evidence}, '{NUM}'), {SMALL}), rtrim(n, '%'))))")


GRADED = f"""
qa AS (SELECT a.conv_id, a.turn, a.text, u.text AS question FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE a.role = 'assistant' AND u.role = 'user'),
st AS (SELECT *, CASE WHEN length(text) <= 100 THEN 'not_found' WHEN len({ungrounded('text', 'question')}) > 0 THEN 'blocked' ELSE 'answered' END AS status,
    len(list_distinct(list_filter([turn, turn % 3], lambda i: i >= 1 AND i <= 6))) AS cited,
    list_extract(regexp_extract_all(lower(question), '{WORD}'), -1) AS word FROM qa),
graded AS (SELECT conv_id, turn, status, cited, CASE WHEN conv_id % 5 > 0 THEN status = 'answered' AND cited > 0 AND contains(lower(text), word)
    ELSE status = 'not_found' END AS correct FROM st)
"""

# the delivered files with planted faults, then each check on its own
DELIVERED = """
del0 AS (SELECT CAST(ticket_id AS BIGINT) AS n, * FROM ticket_history),
del1 AS (SELECT 'ticket_history_' || CAST(time AS DATE) || '.csv' AS file, CAST(time AS DATE) AS fd, n, ticket_id,
    CASE WHEN n % 991 <> 5 THEN customer_id END AS customer_id, CASE WHEN n % 947 = 23 THEN 'cash' ELSE paying_method END AS paying_method, theater_name,
    CASE WHEN n % 941 = 29 THEN 'dev-x' ELSE device_number END AS device_number, original_price, discount_value,
    CASE WHEN n % 983 = 7 THEN original_price + 5 ELSE final_price END AS final_price, n % 977 = 11 AS soon, time,
    CASE WHEN n % 997 = 3 THEN 99 ELSE status_id END AS status_id, CASE WHEN n % 971 = 13 THEN 999 ELSE campaign_id END AS campaign_id, movie_name FROM del0),
del AS MATERIALIZED (SELECT * FROM del1 UNION ALL SELECT * FROM del1 WHERE n % 967 = 17 UNION ALL SELECT * REPLACE ('other cut' AS movie_name) FROM del1 WHERE n % 953 = 19),
dd AS MATERIALIZED (SELECT DISTINCT * FROM del),
fr AS (SELECT file, any_value(fd) AS fd, count(*) AS rows FROM del GROUP BY 1),
fk AS (SELECT file, any_value(fd) AS fd, count(*) AS kept_rows FROM dd GROUP BY 1),
vol AS (SELECT file, kept_rows, CASE WHEN count(past) >= 7 THEN kept_rows / median(past) < 0.1 OR kept_rows / median(past) > 10 END AS off FROM
  (SELECT a.file, a.kept_rows, b.kept_rows AS past FROM (SELECT *, row_number() OVER (ORDER BY fd, file) AS rn FROM fk) a LEFT JOIN
    (SELECT *, row_number() OVER (ORDER BY fd, file) AS rn FROM fk) b ON b.rn BETWEEN a.rn - 28 AND a.rn - 1) GROUP BY 1, 2),
chk AS (
  SELECT file, 'schema' AS c, 'error' AS s, 0 AS k FROM fr UNION ALL SELECT file, 'not_empty', 'error', 0 FROM fr
  UNION ALL SELECT file, 'parse_types', 'error', count(*) FILTER (WHERE soon) FROM del GROUP BY 1
  UNION ALL SELECT file, 'key_nulls', 'error', count(*) FILTER (WHERE customer_id IS NULL) FROM del GROUP BY 1
  UNION ALL SELECT file, 'exact_duplicates', 'warning', rows - kept_rows FROM fr JOIN fk USING (file)
  UNION ALL SELECT file, 'ticket_id_conflict', 'error', count(*) FILTER (WHERE m > 1) FROM (SELECT file, count(*) OVER (PARTITION BY file, ticket_id) AS m FROM dd) GROUP BY 1
  UNION ALL SELECT file, 'already_loaded', 'error', count(*) FILTER (WHERE n % 929 = 31) FROM dd GROUP BY 1
  UNION ALL SELECT file, 'unknown_status', 'error', count(*) FILTER (WHERE status_id NOT IN (SELECT status_id FROM status)) FROM dd GROUP BY 1
  UNION ALL SELECT file, 'unknown_customer', 'error', count(*) FILTER (WHERE c.customer_id IS NULL) FROM dd LEFT JOIN customers c USING (customer_id) GROUP BY 1
  UNION ALL SELECT file, 'unknown_campaign', 'error', count(*) FILTER (WHERE campaign_id <> 0 AND campaign_id NOT IN (SELECT campaign_id FROM campaigns)) FROM dd GROUP BY 1
  UNION ALL SELECT file, 'unknown_device', 'warning', count(*) FILTER (WHERE device_number NOT IN (SELECT device_number FROM devices)) FROM dd GROUP BY 1
  UNION ALL SELECT file, 'unknown_paying_method', 'warning', count(*) FILTER (WHERE paying_method = 'cash') FROM dd GROUP BY 1
  UNION ALL SELECT file, 'price_rules', 'error', count(*) FILTER (WHERE abs(original_price - discount_value - final_price) > 0.01) FROM dd GROUP BY 1
  UNION ALL SELECT file, 'date_matches_file', 'error', count(*) FILTER (WHERE soon) FROM dd GROUP BY 1
  UNION ALL SELECT file, 'volume', 'warning', CASE WHEN off THEN kept_rows ELSE 0 END FROM vol WHERE off IS NOT NULL),
res AS (SELECT file, c AS "check", s AS severity, CASE WHEN k > 0 THEN 'fail' ELSE 'pass' END AS status, k AS failed_rows, rows, kept_rows FROM chk JOIN fr USING (file) JOIN fk USING (file))
"""
ORDER = "'schema', 'not_empty', 'parse_types', 'key_nulls', 'exact_duplicates', 'ticket_id_conflict', 'already_loaded', 'unknown_status', 'unknown_customer', 'unknown_campaign', 'unknown_device', 'unknown_paying_method', 'price_rules', 'date_matches_file', 'volume'"
DECISION = f"""
su AS (SELECT file, max(rows) AS rows, max(kept_rows) AS kept_rows,
    coalesce(string_agg("check", ';' ORDER BY list_position([{ORDER}], "check")) FILTER (WHERE status = 'fail' AND severity = 'error'), '') AS errors,
    coalesce(string_agg("check", ';' ORDER BY list_position([{ORDER}], "check")) FILTER (WHERE status = 'fail' AND severity = 'warning'), '') AS warnings FROM res GROUP BY 1),
bad AS (SELECT min(file) AS first_bad FROM su WHERE errors <> ''),
dec AS (SELECT file, 'ticket_history' AS kind, CAST(substring(file, 16, 10) AS DATE) AS file_date, rows, kept_rows, CASE WHEN errors = '' THEN 'passed' ELSE 'failed' END AS status,
  CASE WHEN first_bad IS NULL OR file < first_bad THEN 'accept' WHEN file = first_bad THEN 'quarantine' ELSE 'pending' END AS decision, errors, warnings FROM su, bad)
"""
REFS = """
up AS (SELECT 'customer_' || (DATE '2024-01-01' + CAST(customer_id % 30 AS INT)) || '.csv' AS file, customer_id, usergender AS og, dob AS od,
    CASE WHEN customer_id % 89 = 3 THEN 'Other' WHEN customer_id % 83 = 5 THEN 'Male' ELSE usergender END AS g, CASE WHEN customer_id % 101 = 7 THEN NULL ELSE dob END AS d FROM customers),
fc AS (SELECT file, count(*) AS rows, count(*) FILTER (WHERE g = 'Other') AS inv, count(*) FILTER (WHERE g <> og OR d IS DISTINCT FROM od) AS ch FROM up GROUP BY 1),
rc AS (SELECT file, rows, unnest(['schema', 'not_empty', 'parse_types', 'key_nulls', 'exact_duplicates', 'key_conflict', 'invalid_usergender', 'updates_existing']) AS "check",
  unnest(['error', 'error', 'error', 'error', 'warning', 'error', 'warning', 'warning']) AS severity, unnest([0, 0, 0, 0, 0, 0, inv, ch]) AS failed_rows FROM fc)
"""


def all_references():
    """Update files of the four reference tables with one fault a file, and the checks that find it."""
    tables = {"customer": ("customers", "customer_id", "usergender", "dob", "'Male', 'Female', 'Not verify'", "warning"),
              "campaign": ("campaigns", "campaign_id", "campaign_type", "campaign_id", "'direct discount', 'voucher', 'reward point'", "warning"),
              "device_detail": ("devices", "device_number", "platform", "model", "'mobile', 'website'", "warning"),
              "status_detail": ("status", "status_id", "error_group", "description", "'customer', 'external', 'internal'", "error")}
    out = []
    for kind, (table, key, other, rest, allowed, severity) in tables.items():
        exempt = "AND k IS DISTINCT FROM '1'" if kind == "status_detail" else ""
        out.append(f"""
SELECT '{kind}' AS "table", * FROM (
  WITH n AS (SELECT CAST({key} AS VARCHAR) AS k0, {other} AS o0, CAST({rest} AS VARCHAR) AS r, CAST(regexp_extract(CAST({key} AS VARCHAR), '(\\d+)', 1) AS BIGINT) AS i FROM {table}),
  b AS (SELECT i % 30 AS f, i // 30 AS j, CASE WHEN i % 30 <> 7 OR (i // 30) % 5 <> 0 THEN k0 END AS k, CASE WHEN i % 30 = 17 THEN 'Other' ELSE o0 END AS o, r FROM n),
  u AS (SELECT f, k, o, r FROM b UNION ALL SELECT f, k, o, r FROM b WHERE f = 11 AND j % 3 = 0 UNION ALL SELECT f, k, 'x' || coalesce(o, ''), r FROM b WHERE f = 13 AND j % 4 = 0),
  v AS (SELECT DISTINCT * FROM u),
  kv AS (SELECT f, k, count(*) AS n FROM v GROUP BY 1, 2),
  s AS (SELECT f, count(*) AS rows, count(*) FILTER (WHERE k IS NULL) AS nulls FROM u GROUP BY 1),
  t AS (SELECT f, count(*) AS kept_rows, count(*) FILTER (WHERE (o IS NULL OR o NOT IN ({allowed})) {exempt}) AS invalid FROM v GROUP BY 1),
  c AS (SELECT f, coalesce(sum(n) FILTER (WHERE n > 1), 0) AS conflict, count(*) AS keys FROM kv GROUP BY 1),
  x AS (SELECT f, rows, kept_rows, unnest(['schema', 'not_empty', 'parse_types', 'key_nulls', 'exact_duplicates', 'key_conflict', 'invalid_{other}', 'updates_existing']) AS "check",
      unnest(['error', 'error', 'error', 'error', 'warning', 'error', '{severity}', 'warning']) AS severity, unnest(range(1, 9)) AS i,
      unnest([CASE WHEN f = 29 THEN 1 ELSE 0 END, 0, 0, nulls, rows - kept_rows, conflict, invalid, CASE WHEN f = 17 THEN keys ELSE 0 END]) AS failed_rows, nulls
    FROM s JOIN t USING (f) JOIN c USING (f))
  SELECT '{kind}_' || (DATE '2024-02-01' + CAST(f AS INT)) || '.csv' AS file, rows, kept_rows, "check", severity, CASE WHEN failed_rows > 0 THEN 'fail' ELSE 'pass' END AS status, failed_rows
  FROM x WHERE (f <> 29 OR i = 1) AND (nulls = 0 OR i <= 4))""")
    return " UNION ALL ".join(out)


OPS = """count(*) AS tickets, count(*) FILTER (WHERE status_id = 1) AS success, round(avg(CASE WHEN status_id = 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS success_rate,
  CAST(round(coalesce(sum(CAST(final_price AS DECIMAL(18,4))) FILTER (WHERE status_id = 1), 0), 2) AS DOUBLE) AS revenue,
  count(*) FILTER (WHERE error_group = 'customer') AS errors_customer, count(*) FILTER (WHERE error_group = 'external') AS errors_external,
  count(*) FILTER (WHERE error_group = 'internal') AS errors_internal"""
MATCH = """
gold AS (SELECT platform, 1 - avg(CAST(is_success AS INT)) AS f FROM tickets WHERE platform IN ('mobile', 'website') GROUP BY 1),
wide AS (SELECT platform, count(*) AS n_tickets, count(*) FILTER (WHERE is_failed) AS n_failed, count(*) FILTER (WHERE is_failed) / count(*) AS failure_rate
  FROM tickets WHERE platform <> 'Unknown' GROUP BY 1)
"""


# both ways to give two gold rows (one name each) the two answer rows (all names; two sums)
CROSSED = """
SELECT 'crossed', (SELECT count(*) FROM wide) = 2 AND ((list_contains(a, g) AND list_contains(b, h)) OR (list_contains(b, g) AND list_contains(a, h))) FROM
  (SELECT min(platform) AS g, max(platform) AS h, [min(platform), max(platform)] AS a, [CAST(sum(n_tickets) AS VARCHAR), CAST(sum(n_failed) AS VARCHAR)] AS b FROM wide)"""


def match_sql(rate):
    return ("((SELECT count(*) FROM gold) = (SELECT count(*) FROM wide) AND NOT EXISTS (SELECT 1 FROM gold g WHERE NOT EXISTS (SELECT 1 FROM wide w "
            f"WHERE w.platform = g.platform AND round(g.f, 3) IN (n_tickets, n_failed, round({rate}, 3)))))")


TERMS = term_ctes("documents", "benchmark")
REVISED = "revised AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN text || ' revised' ELSE text END AS text) FROM documents)"
SEARCHED = """searched AS MATERIALIZED (SELECT source || '#' || section || '#' || part AS doc_id, string_split(label, ' ')[-1] AS source,
  label || ' › ' || title || chr(10) || text AS text FROM passage)"""
PASSAGE_TERMS = term_ctes("searched", "benchmark")
SQL = {
    "refreshed_index": w("SELECT doc_id AS key, count(*) AS terms, CAST(sum(n) AS BIGINT) AS n FROM dt GROUP BY 1", REVISED, PASSAGES.replace("FROM documents", "FROM revised"),
                         "keyed AS (SELECT DISTINCT sha1(source || chr(10) || title || chr(10) || text) AS doc_id, text FROM passage)", term_ctes("keyed", "benchmark")),
    "tfidf_top_k": w(f"SELECT item_id, doc_id AS passage, score, rank FROM ({top('kw')})", PASSAGES, SEARCHED, PASSAGE_TERMS),
    "vector_top_k": w(top("vs"), VEC),
    "fused_top_k": w("SELECT item_id, doc_id, keyword_rank, vector_rank, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 6",
                     TERMS, VEC, FUSED),
    "hits_at_k": w("SELECT item_id, rank, rank IS NOT NULL AS hit FROM h", PASSAGES, SEARCHED, PASSAGE_TERMS, HITS),
    "hit_rate": w("SELECT count(*) AS questions, count(rank) AS hits, count(rank) / count(*) AS hit_rate FROM h", PASSAGES, SEARCHED, PASSAGE_TERMS, HITS),
    "passages": w("SELECT *, sha1(source || chr(10) || title || chr(10) || text) AS key FROM passage", PASSAGES),
    "ungrounded_numbers": w("SELECT doc_id, array_to_string(u, ' ') AS ungrounded, len(u) AS n FROM (SELECT d.doc_id, " + ungrounded("d.text", "coalesce(e.text, '')")
                            + " AS u FROM documents d LEFT JOIN documents e ON d.doc_id = e.doc_id + 1)", "one AS (SELECT 1)"),
    "graded_answers": w("SELECT * FROM graded", GRADED),
    "share_correct": w("SELECT count(*) AS answers, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE correct) / count(*) AS share FROM graded", GRADED),
    "result_match": q(f"SELECT 'wider' AS answer, {match_sql('failure_rate')} AS match UNION ALL SELECT 'wrong', {match_sql('failure_rate + 1')} UNION ALL {CROSSED}", MATCH),
    "dq_ticket_checks": q("SELECT * FROM res", DELIVERED),
    "dq_reference_checks": q("""SELECT file, rows, rows AS kept_rows, "check", severity, CASE WHEN failed_rows > 0 THEN 'fail' ELSE 'pass' END AS status, failed_rows FROM rc""", REFS),
    "dq_all_reference_checks": q(all_references()),
    "load_decision": q("SELECT * FROM dec", DELIVERED, DECISION),
    "quality_warning_counts": q("SELECT warning, count(*) AS files FROM (SELECT unnest(string_split(warnings, ';')) AS warning FROM dec WHERE warnings <> '') GROUP BY 1", DELIVERED, DECISION),
    "daily_ops": q(f"SELECT CAST(time AS DATE) AS day, {OPS} FROM ticket_history LEFT JOIN status USING (status_id) GROUP BY 1"),
    "stream_daily_ops": f"WITH {EVENTS.strip()}, status AS ({STATUS}) SELECT CAST(time AS DATE) AS day, {OPS} FROM attempts LEFT JOIN status USING (status_id) "
                        "GROUP BY 1",
    "stream_without_repeats": f"WITH {EVENTS.strip()} SELECT ticket_id, customer_id, time, final_price, status_id FROM attempts",
}
