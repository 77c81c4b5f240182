"""Near-duplicate groups with SetSketch registers.

A document is the set of its distinct shingles (runs of ``shingle`` words, A-Z folded; the whole text where it has fewer words).

* **Registers.** Every element draws a Poisson process of points, each thrown at one of m registers; a register keeps its first point
  x as floor(1 - log_b(x)): exponentially spaced minima, truncated to 16 bits. Registers of a union are register-wise maxima, and
  two sets agree in a register with a probability of (nearly) their Jaccard similarity. Only points before a time that fills all registers are drawn.
* **Bands.** Texts with equal sets are one class. Classes that agree in all registers of a band meet: every member with the smallest
  of the bucket (linear in its size). Once those links are known, only what is still apart meets: in buckets of up to SMALL members pair by pair
  (so rows stay within SMALL / 2 of the members), in larger buckets block by block, where a task compares full sets and hands on a spanning
  forest of the links it found, never the pairs. Members of smaller components meet a component of more than LARGE as a whole, in blocks too.
  At a similarity of 0.8, 45 bands of 6 registers miss a pair with probability 1e-6.
* **Joint estimate.** The likelihood of (greater, smaller, equal) register counts and both sizes gives the similarity in closed
  form; pairs far below the threshold (7 standard errors) go no further.
* **Verification** counts the elements of both full sets; only that makes a link.

Nothing is capped: a bucket of any size is compared whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm import words as W
from tillwatch.llm.components import components
from tillwatch.llm.tables import row_key, store

BANDS, ROWS = 45, 6
BASE, RATE = 1.001, 20.0
SPARE = 6.0
#: Components above LARGE members, and buckets above SMALL, are compared in blocks of HOST_BLOCK of them and ASK_BLOCK others.
LARGE, SMALL, HOST_BLOCK, ASK_BLOCK = 64, 16, 256, 1024
_STEP, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)
_SHIFT = np.uint64(12)
MAX_DOCS = 1 << 12


def registers(elements: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """uint16 registers (documents, m) of non-empty sets; ``first`` bounds each document's elements."""
    size = np.diff(first)
    out = np.full(len(size) * m, np.inf)
    todo, spare = np.arange(len(size)), SPARE
    while len(todo):
        limit = np.zeros(len(size))
        limit[todo] = (np.log(m) + spare) / size[todo]
        doc = np.repeat(todo, size[todo])
        h = W.mix(elements[W.ragged(first[todo], size[todo])] ^ _SEED)
        t = np.zeros(len(h))
        while len(h):
            h = W.mix(h + _STEP)
            t = t - np.log(((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / m
            live = t <= limit[doc]
            h, t, doc = h[live], t[live], doc[live]
            spot = ((W.mix(h ^ _SEED) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            np.minimum.at(out, doc * m + spot.astype(np.int64), t)
        todo, spare = todo[np.isinf(out.reshape(-1, m)[todo]).any(axis=1)], spare * 4
    k = np.floor(1.0 - np.log(out / RATE) / np.log(BASE))
    return np.clip(k, 0, 65535).astype(np.uint16).reshape(-1, m)


def shingle_sets(w: W.Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, first): distinct 52-bit shingle hashes, sorted within each document."""
    n = w.counts
    own = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    start = W.ragged(w.first[:-1], own)
    doc = np.repeat(np.arange(len(n)), own)
    end = np.minimum(start + shingle, w.first[1:][doc])
    h = W.Spans(w.hash, 1).of(start, end)
    short = end - start < shingle
    h[short] = W.mix(h[short] ^ _SEED)
    key = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (h >> _SHIFT))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    first = np.searchsorted(key >> np.uint64(52), np.arange(len(n) + 1).astype(np.uint64))
    return key & np.uint64((1 << 52) - 1), first


def _small(batch: pa.RecordBatch):
    for i in range(0, batch.num_rows, MAX_DOCS - 1):
        yield batch.slice(i, MAX_DOCS - 1)


def _sets(shingle: int, m: int):
    def run(batches):
        for whole in batches:
            known: set = set()
            for batch in _small(whole):
                size, one, sketch = [], [], []
                for w in W.slices(batch.column("text"), fold=True):
                    elements, first = shingle_sets(w, shingle)
                    n = np.diff(first)
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(W.mix(elements ^ _STEP), dtype=np.uint64)))
                    key = W.mix((sums[first[1:]] - sums[first[:-1]]) + n.astype(np.uint64) * _SEED)
                    new = []
                    for i in np.flatnonzero(n > 0):
                        if int(key[i]) not in known:
                            known.add(int(key[i]))
                            new.append(i)
                    new = np.array(new, np.int64)
                    bounds = np.concatenate(([0], np.cumsum(n[new])))
                    made = registers(elements[W.ragged(first[new], n[new])], bounds, m)
                    cells = np.full(len(n), None, object)
                    for i, row in zip(new, made):
                        cells[i] = row.tobytes()
                    size.append(n)
                    one.append(key)
                    sketch.append(pa.array(cells, pa.binary()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key_high"), batch.column("key_low"), batch.column("doc_id"), pa.array(np.concatenate(size)),
                     pa.array(np.concatenate(one).view(np.int64)), pa.concat_arrays(sketch)],
                    names=["key_high", "key_low", "doc_id", "n", "node", "sketch"])
    return run


def _bands(bands: int, rows: int):
    factor = W.mix(np.arange(1, rows + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    salt = W.mix(np.arange(1, bands + 1, dtype=np.uint64) * _SEED)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(batch.num_rows, bands, rows)
            key = W.mix((k.astype(np.uint64) * factor).sum(axis=2, dtype=np.uint64) ^ salt)
            node = np.repeat(batch.column("node").to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node)], names=["band", "node"])
    return run


def joint_estimate(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of register rows ``x`` and ``y`` of sets with n_x and n_y elements."""
    m = x.shape[1]
    above, below = (x > y).sum(axis=1), (x < y).sum(axis=1)
    equal = m - above - below
    u = n_x / (n_x + n_y)
    v = 1.0 - u
    b = equal * (u * u + v * v) + above * v * v + below * u * u
    root = np.sqrt(np.maximum(b * b - 4.0 * m * equal * (u * v) ** 2, 0.0))
    return np.minimum((b - root) / (2.0 * m * u * v), np.minimum(u / v, v / u))


def _estimates(m: int, least: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, m) for c in ("sketch_a", "sketch_b"))
            n = [batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")]
            keep = pa.array(joint_estimate(x, y, *n) >= least)
            yield batch.select(["a", "b"]).filter(keep)
    return run


def _verified(shingle: int, percent: int):
    def run(batches):
        for whole in batches:
            for batch in _small(whole):
                keep = []
                both = zip(W.text_slices(batch.column("text_a"), 1 << 62), W.text_slices(batch.column("text_b"), 1 << 62))
                for x, y in both:
                    (e, f), (g, k) = (shingle_sets(W.find_words(*s, fold=True), shingle) for s in (x, y))
                    for i in range(len(f) - 1):
                        p, q = e[f[i]:f[i + 1]], g[k[i]:k[i + 1]]
                        shared = len(p) + len(q) - len(np.unique(np.concatenate((p, q))))
                        keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int, m: int) -> DataFrame:
    """Of the pairs (a, b) of classes, those whose full sets are similar enough. Stored."""
    half = classes.select("node", "n", "sketch")
    for side in ("a", "b"):
        pairs = pairs.join(half.toDF(side, f"n_{side}", f"sketch_{side}"), side)
    j = percent / 100.0
    least = max(0.0, j - 7.0 * np.sqrt(j * (1.0 - j) / m) - 0.01)
    pairs = pairs.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    close = store(pairs.mapInArrow(_estimates(m, least), "a long, b long"), "close")
    texts = _texts(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, docs)
    for side in ("a", "b"):
        close = close.join(texts.toDF(side, f"text_{side}"), side)
    return store(close.mapInArrow(_verified(shingle, percent), "a long, b long"), "verified")


def _texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of the distinct ``nodes``. Stored."""
    found = nodes.join(classes.select("node", "rep.*"), "node").join(docs, ["key_high", "key_low"]).select("node", "text")
    return store(found.dropDuplicates(["node"]), "texts")


def _labelled(bands: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: band, node, n, label, size (of the component). Stored."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    about = classes.select("node", "n").join(labels.join(sizes, "label"), "node", "left").select(
        "node", "n", F.coalesce("label", "node").alias("label"), F.coalesce("size", F.lit(1)).alias("size"))
    members = bands.join(about, "node")
    mixed = members.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    return store(members.join(mixed.select("band", "low"), "band"), "mixed")


def _asks(members: DataFrame) -> DataFrame:
    """node, host, host_size: documents that share a bucket with a larger component ``host`` of more than LARGE members. Stored."""
    into = members.where(F.col("size") > LARGE).select("band", F.col("label").alias("host"), F.col("size").alias("host_size")).distinct()
    smaller = F.struct("size", "label") < F.struct(F.col("host_size").alias("size"), F.col("host").alias("label"))
    return store(members.join(into, "band").where((F.col("label") != F.col("host")) & smaller).select("node", "host", "host_size").distinct(), "asks")


def _unmet(members: DataFrame, asks: DataFrame) -> DataFrame:
    """Members of components of up to LARGE, with the count of them in the bucket (crowd) and the host that they ask, if any. Stored."""
    small = members.where(F.col("size") <= LARGE)
    crowd = small.groupBy("band").agg(F.count(F.lit(1)).alias("crowd"))
    return store(small.join(crowd.where("crowd > 1"), "band").join(asks.groupBy("node").agg(F.min("host").alias("host")), "node", "left"), "unmet")


def _other_pairs(unmet: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a bucket of up to SMALL members, lie in different components and have not been compared. Two documents that both ask the
    same host meet in its blocks and are left out here."""
    few = unmet.where(F.col("crowd") <= SMALL)
    rest = few.where("label != low").select("band", F.col("node").alias("one"), F.col("label").alias("own"), F.col("n").alias("n_one"),
                                            F.col("host").alias("host_one"))
    fits = F.least("n", "n_one") * 100 >= F.greatest("n", "n_one") * percent
    apart = ~F.coalesce(F.col("host") == F.col("host_one"), F.lit(False))
    met = few.join(rest, "band").where((F.col("label") != F.col("own")) & fits & apart).select(
        F.least("node", "one").alias("a"), F.greatest("node", "one").alias("b"))
    return met.distinct().join(tried, ["a", "b"], "left_anti")


def _crowds(unmet: DataFrame) -> DataFrame:
    """node, host, host_size: members of buckets of more than SMALL, the bucket as host; of buckets with the same members one. Stored."""
    many = unmet.where(F.col("crowd") > SMALL)
    sign = many.groupBy("band").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sign"), F.max("crowd").alias("crowd"),
                                    F.min("label").alias("least"), F.max("label").alias("most"))
    one = sign.where("least != most").groupBy("sign", "crowd").agg(F.min("band").alias("band"))
    return store(many.join(one.select("band"), "band").select("node", F.col("band").alias("host"), F.lit(0).cast("long").alias("host_size")), "crowds")


def _block_links(asks: DataFrame, hosts_of: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links of documents with the large components or crowds they ask, and among those that ask the same: compared with all of them, block by
    block, on full sets. ``hosts_of`` has the members (node, host) that do not ask. A block returns a spanning forest of its links, so pairs are never written down."""
    if asks.isEmpty():
        return asks.select(F.col("node").alias("a"), F.col("host").alias("b"))
    hosts = asks.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / ASK_BLOCK).cast("int").alias("chunks"),
                                     F.ceil((F.first("host_size") + F.count(F.lit(1))) / HOST_BLOCK).cast("int").alias("blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    left = asks.select("node", "host").join(hosts, "host").select("node", "host", part("chunks").alias("chunk"), every("blocks").alias("block"))
    hosted = hosts_of.select("node", "host", F.lit(True).alias("inside")).unionByName(
        asks.select("node", "host", F.lit(False).alias("inside"))).repartition("host", "node")
    right = hosted.join(hosts, "host").select("node", "host", "inside", part("blocks").alias("block"), every("chunks").alias("chunk"))
    texts = _texts(left.select("node").unionByName(right.select("node")).distinct(), classes, docs)
    keys = ["host", "block", "chunk"]
    left, right = (x.join(texts.toDF("node", "text"), "node").toDF("node", *x.columns[1:], "text").groupBy(*keys) for x in (left, right))
    return store(left.cogroup(right).applyInPandas(_block(shingle, percent), "a long, b long"), "block-links")


def _block(shingle: int, percent: int):
    def sets(rows: pd.DataFrame):
        for begin in range(0, len(rows), MAX_DOCS - 1):
            for w in W.slices(pa.array(rows["text"].iloc[begin:begin + MAX_DOCS - 1]), fold=True):
                elements, first = shingle_sets(w, shingle)
                for i in range(len(first) - 1):
                    yield elements[first[i]:first[i + 1]]

    def run(asking: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        own = list(sets(members))
        size = np.array([len(s) for s in own], np.int64)
        owner = np.repeat(np.arange(len(own)), size)
        flat = np.concatenate(own) if own else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        found, above = [], {}
        ids, inside = members["node"].to_numpy(), members["inside"].to_numpy(bool)

        def top(x):
            while above.setdefault(x, x) != x:
                above[x] = x = above[above[x]]
            return x
        for node, s in zip(asking["node"].tolist(), sets(asking)):
            low = np.searchsorted(flat, s)
            shared = np.bincount(owner[W.ragged(low, np.searchsorted(flat, s, "right") - low)], minlength=len(own))
            hit = np.flatnonzero((100 * shared >= percent * (size + len(s) - shared)) & (ids != node))
            for other in ids[hit[inside[hit]][:1]].tolist() + ids[hit[~inside[hit]]].tolist():
                if top(node) != top(other):
                    above[top(node)] = top(other)
                    found.append((node, other))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")
    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                    text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """key_high, key_low (see ``row_key``), doc_id, n_shingles, root, component_id, kept for every row of ``docs``.

    Rows are linked if 100 * intersection >= percent * union. ``component_id`` is the smallest doc_id reachable. Null, empty and
    blank texts have no shingles and are linked with nothing (root null). Rows without doc_id take part; they are kept only where no row
    of their component has one. Repeated rows share a result. Other columns of ``docs`` are not read.
    """
    m = bands * rows
    keyed = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = store(keyed.mapInArrow(
        _sets(shingle, m), "key_high long, key_low long, doc_id long, n long, node long, sketch binary"), "sets")
    classes = store(sets.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"),
        F.min(F.struct("key_high", "key_low")).alias("rep")), "classes")
    banded = store(classes.select("node", "sketch").mapInArrow(_bands(bands, rows), "band long, node long"), "bands")
    hubs = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).where("size > 1")
    tried = store(banded.join(hubs, "band").where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "tried")
    texts = keyed.select("key_high", "key_low", "text")
    links = _links(tried, classes, texts, shingle, percent, m)
    labels = components(links)
    members = _labelled(banded, classes, labels)
    asks = _asks(members)
    unmet = _unmet(members, asks)
    crowds = _crowds(unmet)
    inside = labels.select("node", F.col("label").alias("host"))
    more = _links(_other_pairs(unmet, tried, percent), classes, texts, shingle, percent, m).unionByName(
        _block_links(asks, inside, classes, texts, shingle, percent)).unionByName(
        _block_links(crowds, inside.where("false"), classes, texts, shingle, percent))
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    roots = classes.select("node", "doc_id").join(labels, "node", "left").withColumn("root", F.coalesce("label", "node"))
    lowest = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = roots.select("node", "root").join(lowest, "root")
    out = sets.select("key_high", "key_low", "doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("key_high", "key_low", "doc_id", F.col("n").alias("n_shingles"), "root", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that with the smallest doc_id; of repeated rows one stays. Texts
    without words stay. Columns may have any names; besides doc_id and text they are handed on as they are."""
    blank = F.when(F.col("root").isNull(), F.struct("key_high", "key_low"))
    found = near_duplicates(docs, shingle, percent).where("kept").select("key_high", "key_low", "root", blank.alias("blank"))
    one = found.dropDuplicates(["root", "blank"]).select("key_high", "key_low")
    keyed = docs.select(*row_key(), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return keyed.join(one, ["key_high", "key_low"]).dropDuplicates(["key_high", "key_low"]).select("row.*")
