"""Registered queries of the operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm import bpe, fingerprints, language, lm, negatives, packing, phrases, pseudonyms, rules, setsketch, substring, topk, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pseudonyms(spark, sf_dir):
    out = pseudonyms.pseudonymise(_read(spark, sf_dir, "documents"), pseudonyms.job_key(spark))
    return out.select("doc_id", "text", F.size("pii_found").cast("long").alias("n_pii"))


def op2_substring_dedup(spark, sf_dir):
    out = substring.remove_repeats(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_language(spark, sf_dir):
    out = language.identify(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op4_lm_scores(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return lm.score_texts(_read(spark, sf_dir, "documents"), held_out)


def op5_warc(spark, sf_dir):
    out = warc.round_trip(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_fingerprints(spark, sf_dir):
    out = fingerprints.edited_likeness(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
                      fingerprints.digest("fingerprint").alias("fingerprint"),
                      fingerprints.digest("edited").alias("edited_fingerprint"), "near_edited", "near_next")


def op7_near_duplicates(spark, sf_dir):
    out = setsketch.near_duplicates(_read(spark, sf_dir, "documents"), shingle=2)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def op8_packing(spark, sf_dir):
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_top_k(spark, sf_dir):
    vectors = topk.whole_vectors(_read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def op10_bpe(spark, sf_dir):
    out = bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.scaled_vectors(_read(spark, sf_dir, "embeddings"), label=label)
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op12_quality_rules(spark, sf_dir):
    out = rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      F.concat_ws(",", "reasons").alias("reasons"), "kept")


def op13_collocations(spark, sf_dir):
    return phrases.collocations(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_pseudonyms, op2_substring_dedup, op3_language, op4_lm_scores, op5_warc, op6_fingerprints, op7_near_duplicates, op8_packing, op9_top_k,
    op10_bpe, op11_hard_negatives, op12_quality_rules, op13_collocations)}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM k) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r),
g AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE
    [ws[x] FOR x IN range(1, len(ws) + 1) IF NOT list_contains(gone, x)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""

_OP5 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first != page_id THEN first END AS refers_to
FROM f
"""

_OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] ELSE ws END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS node, x AS low FROM e UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.node WHERE r.low < e.y),
m AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id,
  least(w.doc_id, coalesce(m.low, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = w.doc_id
"""

_OP9 = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id != b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10
"""

_OP11 = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id != b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM
  (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
r AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
"""

_OP12_RULES = " UNION ALL ".join(f"SELECT '{r}' AS rule, doc_id, stratum, {a} AS a, {b} AS b FROM c WHERE NOT base_failed" for r, (a, b) in rules.RULES.items())
_OP12 = f"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM
  (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1) GROUP BY 1),
c0 AS (SELECT doc_id, stratum, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
c AS MATERIALIZED (SELECT *, n_words < {rules.MIN_WORDS} OR n_repeat_words * 100 > n_words * {rules.MAX_REPEATS} AS base_failed FROM c0),
m AS MATERIALIZED ({_OP12_RULES}),
y AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1),
cut AS (SELECT unnest(range(1, {len(rules.CUTOFFS) + 1})) AS place, unnest({list(rules.CUTOFFS)}) AS cutoff),
t AS (SELECT stratum, rule, place, cutoff, count(*) FILTER (WHERE quality = 1) AS n, count(*) FILTER (WHERE quality = 1 AND b > 0 AND a * 1000 >= cutoff * b) AS k,
    count(*) FILTER (WHERE quality = 0 AND b > 0 AND a * 1000 >= cutoff * b) AS bad FROM m JOIN y USING (doc_id), cut GROUP BY 1, 2, 3, 4),
p AS (SELECT *, CASE WHEN k >= n THEN 1 ELSE list_sum([exp(CASE WHEN i = 0 THEN 0 ELSE lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) END
    + i * ln({rules.RISK / len(rules.RULES)}) + (n - i) * ln(1 - {rules.RISK / len(rules.RULES)})) FOR i IN range(0, k + 1)]) END AS p FROM t),
z AS (SELECT *, max(p) OVER (PARTITION BY stratum, rule ORDER BY place) AS worst FROM p),
best AS (SELECT stratum, rule, arg_min(cutoff, place - 100.0 * (bad - {rules.COST} * k)) AS cutoff FROM z
  WHERE worst <= {rules.ERROR} / ((SELECT count(DISTINCT stratum) FROM t) * {len(rules.RULES)}) AND bad > {rules.COST} * k GROUP BY 1, 2),
out AS (SELECT doc_id, string_agg(rule, ',' ORDER BY rule) AS reasons FROM m JOIN best USING (stratum, rule) WHERE a * 1000 >= cutoff * b GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(reasons, '') AS reasons,
  NOT base_failed AND reasons IS NULL AS kept FROM c LEFT JOIN out USING (doc_id)
"""

_OP13 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLDED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) x(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.k, a, x.f AS l, y.f AS r, n, cut, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM s) WHERE i = 1),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f z WHERE z.lang = b.lang AND z.k > b.k AND 100 * z.f >= 100 * b.a
  AND contains(' ' || z.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d) WHERE rank <= 2000
"""

SQL = {"op2_substring_dedup": _OP2, "op5_warc": _OP5, "op7_near_duplicates": _OP7, "op9_top_k": _OP9,
       "op11_hard_negatives": _OP11, "op12_quality_rules": _OP12, "op13_collocations": _OP13}
