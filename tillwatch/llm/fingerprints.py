"""Winnowed document fingerprints with Spark's own functions only.

Every run of ``gram`` words is hashed from the hashes of its words; of each ``window`` consecutive hashes the least is chosen, of equal ones the
rightmost, and kept with its place. Two texts that share a run of gram + window - 1 words share a chosen hash. Fewer words than a gram
are one gram; text without words has an empty fingerprint.

The next document comes from range buckets: ids are cut at quantiles, each bucket is ordered by itself, and the first row of the
following bucket travels along as a guest at its end. No ordering runs over the whole table.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 5, 4
BUCKET_ROWS, MAX_BUCKETS = 2000, 1 << 16
_SPACE = r"\x20\x09-\x0D"
_LOWEST = -(2**63)


def winnow(df: DataFrame, text: Column, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``df`` with ``out``: array<struct<place int, hash long>>, in order of place."""
    c = lambda name: f"_{out}_{name}"
    kept = df.columns
    body = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{_SPACE}]+", "")
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"[{_SPACE}]+"))
    df = df.withColumn(c("w"), words)
    df = df.withColumn(c("w"), F.transform(F.filter(c("w"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    size = F.size(c("w"))
    n = F.when(size >= gram, size - gram + 1).otherwise(F.least(size, F.lit(1)))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(c("g"), F.transform(upto(n), lambda i: F.xxhash64(*[F.get(c("w"), i + k) for k in range(gram)])))
    n = F.size(c("g"))
    starts = upto(F.when(n >= window, n - window + 1).otherwise(F.least(n, F.lit(1))))
    df = df.withColumn(c("m"), F.transform(starts, lambda i: F.least(*[F.get(c("g"), i + k) for k in (0, *range(window))])))

    def rightmost(m, i):
        pick = F.when(F.get(c("g"), i + window - 1) == m, i + window - 1)
        for k in range(window - 2, 0, -1):
            pick = pick.when(F.get(c("g"), i + k) == m, i + k)
        return pick.otherwise(i)
    df = df.withColumn(c("p"), F.transform(c("m"), rightmost))
    df = df.withColumn(c("p"), F.filter(c("p"), lambda p, i: (i == 0) | (p != F.get(c("p"), i - 1))))
    df = df.withColumn(out, F.transform(c("p"), lambda p: F.struct(p.alias("place"), F.get(c("g"), p).alias("hash"))))
    # the grams are named once more, else the optimiser would compute them anew for every place
    return df.withColumn(out, F.when(F.size(c("g")) >= 0, F.col(out))).select(*kept, out)


def hashes(fingerprint: str) -> Column:
    return F.array_distinct(F.col(fingerprint)["hash"])


def likeness(one: Column, two: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; two empty ones are alike."""
    shared = F.size(F.array_intersect(one, two))
    union = F.size(one) + F.size(two) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def digest(fingerprint: str) -> Column:
    """SHA-256 of the chosen places and hashes."""
    return F.sha2(F.to_json(F.col(fingerprint)), 256)


def _bucketed(docs: DataFrame) -> DataFrame:
    """Range buckets of about BUCKET_ROWS rows by ``order_id``, the guests of each bucket included."""
    n = docs.count()
    buckets = int(max(1, min(MAX_BUCKETS, n // BUCKET_ROWS)))
    cuts = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        cuts = sorted(set(docs.agg(F.percentile_approx("order_id", shares, max(10_000, 20 * buckets))).first()[0]))
    bounds = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    steps = F.from_json(F.lit(json.dumps([1 << i for i in range(max(1, len(cuts)).bit_length() - 1, -1, -1)])), "array<int>")
    bucket = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) <= F.col("order_id"), at + s).otherwise(at))
    docs = docs.withColumn("bucket", bucket)
    heads = docs.groupBy("bucket").agg(F.max("order_id").alias("head"))
    by_bucket = Window.orderBy(F.desc("bucket"))  # a row for each bucket, MAX_BUCKETS at most
    whole = by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = F.coalesce(F.lead("head").over(by_bucket), F.first("head").over(whole))
    hosts = heads.select(F.col("bucket").alias("host"), after.alias("order_id"))
    guests = docs.join(F.broadcast(hosts), "order_id").select(*[c for c in docs.columns if c != "bucket"], F.col("host").alias("bucket"))
    return docs.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True))).repartition("bucket")


def with_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, text, fingerprint, next_text, next_hashes: each row with the next one by descending doc_id; after the last comes the
    first. Rows without id come last; equal ids are ordered by a hash of the text. A lone row is its own next. Null text counts as empty. Other columns are
    not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _bucketed(rows.withColumn("order_id", F.coalesce("doc_id", F.lit(_LOWEST))))
    rows = winnow(rows, F.col("text"), "fingerprint", gram, window).withColumn("hashes", hashes("fingerprint"))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("order_id"), F.xxhash64("text"))
    return rows.withColumns({"next_text": F.lead("text").over(order), "next_hashes": F.lead("hashes").over(order)}).where(
        ~F.col("guest")).select("doc_id", "text", "fingerprint", "hashes", "next_text", "next_hashes")


def edited_likeness(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited, near_edited, near_next: every text against itself with its second half replaced by
    the start of the next text, and against the next text."""
    rows = with_next(docs, text_col, id_col)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited_text", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = winnow(rows, F.col("edited_text"), "edited").withColumn("edited_hashes", hashes("edited"))
    return rows.select("doc_id", n.cast("long").alias("n_chars"), "edited_text", "fingerprint", "edited",
                       likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
                       likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))
