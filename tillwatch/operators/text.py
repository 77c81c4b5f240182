"""Passages, keyword and vector search with rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.functions import columns as C
from tillwatch.functions.tables import union_on
from tillwatch.session import write_shared

# fixed values: they decide where passages are cut and how ranks are fused
MAX_CHARS, MIN_CHARS, TOP_K, RRF = 1500, 40, 6, 60
HEADING = r"(?d)\A(#{1,4})[ \t]+(.*)"
HEADING_LINE = r"(?dm)^(?=#{1,4}[ \t])"
FENCE_LINE = r"(?dm)^(?=[ \t]*```)"
MASK = "\u0001"
TITLE_SEPARATOR = " › "
TOKEN = r"[\p{L}\p{N}_]+"
BLANK_LINE = r"\n\s*\n"


# ---------------------------------------------------------------- passages

def sections(text: Column, label: Column) -> Column:
    """Sections of a Markdown text as an array of (title, body), within one row and without a shuffle.

    The text is cut at fence lines; in every second piece, which is code, line-initial ``#`` is masked. What still looks
    like a heading is one, so a second cut gives the sections, and only the short list of headings is folded into paths.
    """
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    pieces = F.transform(F.split(unix, FENCE_LINE), lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, r"(?dm)^#", MASK + "#")).otherwise(p))
    parts = F.split(F.array_join(pieces, ""), HEADING_LINE)
    start = F.struct(F.array_repeat(F.lit(None).cast("string"), 4).alias("path"), F.array().cast("array<string>").alias("titles"))

    def step(acc, part):
        level = F.length(F.regexp_extract(part, HEADING, 1))
        name = F.trim(F.regexp_extract(part, HEADING, 2))
        path = F.transform(acc["path"], lambda h, i: F.when(i + 1 == level, name).when(i + 1 < level, h))
        path = F.when(level > 0, path).otherwise(acc["path"])
        return F.struct(path.alias("path"), F.array_append(acc["titles"], _title(path, label)).alias("titles"))

    titles = F.aggregate(parts, start, step, lambda acc: acc["titles"])
    body = lambda p: _strip(F.replace(F.regexp_replace(p, HEADING, ""), F.lit(MASK), F.lit("")))
    return F.zip_with(titles, parts, lambda t, p: F.struct(t.alias("title"), body(p).alias("body")))


def _title(path: Column, label: Column) -> Column:
    """Headings below the first level joined; the first level alone when there is nothing below it."""
    deep = F.filter(F.slice(path, 2, 3), lambda h: h.isNotNull())
    used = F.when(F.size(deep) > 0, deep).otherwise(F.filter(path, lambda h: h.isNotNull()))
    return F.when(F.size(used) > 0, F.array_join(used, TITLE_SEPARATOR)).otherwise(label)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def split_long(text: Column, separator: str = BLANK_LINE, joiner: str = "\n\n", max_chars: int = MAX_CHARS) -> Column:
    """Pack paragraphs greedily into parts of at most ``max_chars``; a longer paragraph stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("cur"))
    grow = lambda acc, p: F.length(acc["cur"]) + F.length(p) + len(joiner) > max_chars

    def step(acc, p):
        full = (acc["cur"] != "") & grow(acc, p)
        return F.struct(
            F.when(full, F.array_append(acc["parts"], acc["cur"])).otherwise(acc["parts"]).alias("parts"),
            F.when(full | (acc["cur"] == ""), p).otherwise(F.concat(acc["cur"], F.lit(joiner), p)).alias("cur"))

    packed = F.aggregate(F.split(text, separator), start, step, lambda acc: F.when(
        acc["cur"] != "", F.array_append(acc["parts"], acc["cur"])).otherwise(acc["parts"]))
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(packed)


def chunk_markdown(docs: DataFrame, separator: str = BLANK_LINE, joiner: str = "\n\n") -> DataFrame:
    """Passages of (source, label, text) documents: heading path as title, short bodies dropped, long ones split."""
    found = F.filter(sections(F.col("text"), F.col("label")), lambda b: F.length(b["body"]) >= MIN_CHARS)
    out = docs.select("source", "label", F.posexplode(found).alias("section", "_b"))
    out = out.select("source", "label", "section", F.col("_b.title").alias("title"),
                     F.posexplode(split_long(F.col("_b.body"), separator, joiner)).alias("part", "text"))
    return out.withColumn("key", F.sha1(F.concat_ws("\n", "source", "title", "text")))


def drop_provenance(text: Column, prefix: str = "_Nguồn:") -> Column:
    """Text without the lines that only name the data source."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.startswith(prefix)), "\n")


def collect_passages(*sources: DataFrame, separator: str = BLANK_LINE, joiner: str = "\n\n", briefs: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Passages of several document tables with the columns source, label, text. Only ``briefs`` lose their provenance lines."""
    tables = [*sources, *(b.withColumn("text", drop_provenance(F.col("text"))) for b in briefs)]
    docs = tables[0]
    for s in tables[1:]:
        docs = docs.unionByName(s)
    return chunk_markdown(docs, separator, joiner)


def refresh(passages: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages not stored yet, stored rows still in use), by passage key."""
    keys = passages.select("key").distinct()
    return passages.join(stored.select("key"), "key", "left_anti"), stored.join(keys, "key", "left_semi")


# ---------------------------------------------------------------- scores

def terms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, term, n): lower-cased words and pairs of neighbouring words.

    A document's words are all in its own task, so the map-side step already counts them.
    """
    d = docs.select(key, _words(F.col(text)).alias("w"))
    return d.select(key, F.explode(_grams(F.col("w"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _grams(words: Column) -> Column:
    """Words and pairs of neighbouring words."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def counted_terms(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, terms, counts): the terms of each row's text in order and how often they occur, counted within the row; rows without words are left out."""
    d = docs.select(key, _words(F.col(text)).alias("w")).where(F.size("w") > 0).select(key, F.sort_array(_grams(F.col("w"))).alias("g"))
    first = F.filter(F.sequence(F.lit(1), F.size("g")), lambda i: (i == 1) | (F.get("g", i - 1) != F.get("g", i - 2)))
    d = d.select(key, "g", first.alias("at"))
    ends = F.concat(F.slice("at", 2, F.size("at")), F.array(F.size("g") + 1))
    return d.select(key, F.transform("at", lambda i: F.get("g", i - 1)).alias("terms"), F.zip_with("at", ends, lambda a, b: (b - a).cast("bigint")).alias("counts"))


def word_lists(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, words): one row per key with the lower-cased words of each of its texts. Texts are shuffled once, whole."""
    return docs.groupBy(*keys).agg(F.collect_list(text).alias("t")).select(*keys, F.transform("t", _words).alias("words"))


def term_hashes(words: str) -> Column:
    """64-bit hashes of all words and pairs of neighbouring words in a column of ``word_lists``."""
    return F.flatten(F.transform(words, lambda w: F.transform(_grams(w), lambda g: F.xxhash64(g))))


def document_frequencies(terms_of_docs: DataFrame, docs: DataFrame) -> DataFrame:
    """(term, idf) with idf = ln((1 + N) / (1 + df)) + 1."""
    n_docs = docs.agg(F.count("*")).scalar()
    df = terms_of_docs.groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", (F.ln((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"))


def _tf() -> Column:
    return 1 + F.ln("n")


def keyword_scores(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, text: str = "text") -> DataFrame:
    """Cosine of the tf-idf vectors (tf = 1 + ln n) for every query and document that share a term.

    Only postings of query terms become pairs: the query terms are one small table that Spark may broadcast, so postings
    need not move. Products are summed map-side, and the document's norm is joined to the finished pairs. Term joins have
    one row per term on the other side: a very frequent term is a plain skewed join that adaptive execution splits.
    """
    # the postings are the index: written once, read three times below, and joined by their real size instead of an
    # estimate from the size of the text
    t = write_shared(terms(docs, doc_key, text), "postings")
    idf = document_frequencies(t, docs)
    norm = t.join(idf, "term").groupBy(doc_key).agg(F.sqrt(F.sum(F.pow(_tf() * F.col("idf"), 2))).alias("norm"))
    q = terms(queries, query_key, text).join(idf, "term").withColumn("qw", _tf() * F.col("idf")).drop("n")
    qn = q.groupBy(query_key).agg(F.sqrt(F.sum(F.pow("qw", 2))).alias("qn"))
    q = q.join(qn, query_key).select(query_key, "term", (F.col("qw") / F.col("qn") * F.col("idf")).alias("qw"))
    pairs = t.join(q, "term").groupBy(query_key, doc_key).agg(F.sum(F.col("qw") * _tf()).alias("dot"))
    return pairs.join(norm, doc_key).select(query_key, doc_key, F.round(F.col("dot") / F.col("norm"), 6).alias("score"))


def vector_scores(vectors: DataFrame, queries: DataFrame, doc_key: str, query_key: str, block: int = 256,
                  salts: int = 32) -> DataFrame:
    """Dot product of unit vectors for every query and document.

    Queries are packed into blocks of about ``block`` vectors. A document row meets each block once through an
    equi-join on (block, salt): small query sets are broadcast by Spark, large ones are shuffled evenly.
    """
    n = F.greatest(F.ceil(queries.agg(F.count("*")).scalar() / block), F.lit(1)).cast("int")
    q = queries.select(F.pmod(F.xxhash64(query_key), n).cast("int").alias("_block"), F.struct(query_key, "embedding").alias("q"))
    q = q.groupBy("_block").agg(F.collect_list("q").alias("_qs"))  # one block of queries
    q = q.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    d = vectors.select(doc_key, "embedding", F.pmod(F.xxhash64(doc_key), F.lit(salts)).cast("int").alias("_salt"))
    d = d.withColumn("_n", n).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    pairs = d.join(q, ["_block", "_salt"]).select(doc_key, "embedding", F.explode("_qs").alias("_q"))
    product = F.zip_with("embedding", F.col("_q.embedding"), lambda a, b: a.cast("double") * b.cast("double"))
    dot = F.aggregate(product, F.lit(0.0), lambda total, x: total + x)
    return pairs.select(F.col(f"_q.{query_key}").alias(query_key), doc_key, F.round(dot, 6).alias("score"))


# ---------------------------------------------------------------- ranking

def top_k(scores: DataFrame, query_key: str, doc_key: str, k: int = TOP_K) -> DataFrame:
    """Best k documents per query. ``row_number() <= k`` prunes every task to k rows per query before the shuffle."""
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), doc_key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranks_of(scores: DataFrame, wanted: DataFrame, query_key: str, doc_key: str, salts: int = 32) -> DataFrame:
    """Exact ranks of a few wanted documents per query within all scored ones, without sorting a query's documents.

    Each scored pair is reduced to how many wanted documents come before it; counting these positions map-side and
    adding them up per query gives the ranks. Scored documents that are not wanted never travel.
    """
    place = lambda: F.struct((-F.col("score")).alias("s"), F.col(doc_key).alias("d"))
    mine = scores.join(wanted.select(query_key, doc_key), [query_key, doc_key]).groupBy(query_key).agg(
        F.array_sort(F.collect_list(place())).alias("_mine"))  # a few wanted documents per query
    before = F.size(F.filter("_mine", lambda c: c < F.col("_p"))).alias("pos")
    # a query's documents are spread over salts, so few queries with very many documents still fill all tasks
    spread = mine.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = scores.withColumn("_p", place()).withColumn("_salt", F.pmod(F.xxhash64(doc_key), F.lit(salts)).cast("int"))
    counts = salted.join(spread, [query_key, "_salt"]).select(query_key, before).groupBy(query_key, "pos").agg(
        F.count("*").alias("n"))
    listed = mine.select(query_key, F.posexplode("_mine").alias("pos", "_m")).select(query_key, "pos", F.col("_m.d").alias(doc_key))
    w = Window.partitionBy(query_key).orderBy("pos")  # one row per wanted document
    joined = listed.join(counts, [query_key, "pos"], "left")
    return joined.select(query_key, doc_key, F.sum(F.coalesce("n", F.lit(0))).over(w).alias("rank"))


def fuse(keyword: DataFrame, vector: DataFrame, query_key: str, doc_key: str, k: int = TOP_K, queries: DataFrame | None = None,
         docs: DataFrame | None = None) -> DataFrame:
    """Top k by reciprocal rank fusion, sum of 1 / (60 + rank).

    Ranks are by (score descending, document); documents that share no term with the query have the rank behind all
    that do. A document or query without a vector gets nothing from the vector list (vector_rank null). A document below rank
    60 + 2k in both lists scores less than 2 / (120 + 2k) = 1 / (60 + k), which k documents reach, so only the heads of the two
    lists can win; their rank in the other list is computed exactly. Documents in neither list come after all others: the k
    smallest of ``docs`` stand for them, for every one of ``queries``. Without these two only the documents of the lists are ranked.
    """
    depth = RRF + 2 * k
    # both lists are read several times below
    keyword, vector = write_shared(keyword, "keyword-scores"), write_shared(vector, "vector-scores")
    heads = [top_k(x, query_key, doc_key, depth).select(query_key, doc_key) for x in (keyword, vector)]
    if queries is not None and docs is not None:
        first = [r[0] for r in docs.select(doc_key).where(F.col(doc_key).isNotNull()).distinct().orderBy(doc_key).limit(k).collect()]
        heads.append(queries.select(query_key, F.explode(F.array(*map(F.lit, first)).cast(f"array<{docs.schema[doc_key].dataType.simpleString()}>")).alias(doc_key)))
    wanted = union_on(heads, query_key, doc_key).distinct()
    kw = ranks_of(keyword, wanted, query_key, doc_key).withColumnRenamed("rank", "keyword_rank")
    vec = ranks_of(vector, wanted, query_key, doc_key).withColumnRenamed("rank", "vector_rank")
    matched = keyword.groupBy(query_key).agg(F.count("*").alias("_matched"))
    j = wanted.join(vec, [query_key, doc_key], "left").join(kw, [query_key, doc_key], "left").join(matched, query_key, "left")
    j = j.withColumn("keyword_rank", F.coalesce("keyword_rank", F.coalesce("_matched", F.lit(0)) + 1)).drop("_matched")
    score = F.lit(1.0) / (F.col("keyword_rank") + RRF) + F.coalesce(F.lit(1.0) / (F.col("vector_rank") + RRF), F.lit(0.0))
    return top_k(j.withColumn("score", F.round(score, 9)).select(query_key, doc_key, "vector_rank", "keyword_rank", "score"), query_key, doc_key, k)


def hits_at_k(ranked: DataFrame, sources: DataFrame, questions: DataFrame, query_key: str, doc_key: str) -> DataFrame:
    """Per question with known sources: whether a retrieved document belongs to one of them, and the first such rank."""
    found = ranked.join(sources.select(doc_key, "source"), doc_key).select(query_key, "rank", "source")
    q = questions.where(F.size("sources") > 0)
    j = q.join(found, query_key, "left")
    rank = F.min(F.when(F.array_contains("sources", F.col("source")), F.col("rank")))
    return j.groupBy(query_key).agg(rank.cast("bigint").alias("rank")).withColumn("hit", F.col("rank").isNotNull())


def hit_rate(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("questions"), F.count_if("hit").alias("hits"), C.rate("hit").alias("hit_rate"))
