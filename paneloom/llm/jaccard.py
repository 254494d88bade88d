"""N-gram Jaccard join by a size-aware heavy-light scheme, and its connected components.

A document's set is its distinct word n-grams as 64-bit hashes. Documents of equal sets (a 128-bit digest) are linked at
once, and only the smallest id of each class goes on.

Light sets, of at most `boundary` elements, list their subsets of every size that an overlap with a light partner can
need. Two light sets are linked if and only if they share a subset as large as the overlap their sizes ask for; that
overlap grows with the sizes, so within one subset's list comparing with its smallest set finds every component.

Heavy sets scan inverted lists over prefixes. All sets are ordered alike: elements that a bounded sample of documents
shows to be frequent come last (by class of frequency), the rest by hash, and a set of s elements is listed under its
first s - ceil(threshold * s) + 1. A shared element at positions i and j is evidence only if both sets still have enough
elements from there on for the overlap their sizes ask for; the first shared element of a similar pair always is.

The boundary is the one of least cost, in rows listed: for light sets their subsets, for the others the elements of their
prefixes and PAIR_COST for each partner that the lists behind these hold. How many that are is counted on all small sets.
Scanning whole lists instead of those of prefixes finds no more links and lists every n-gram of every text.

A list is not expanded into its pairs. First each is compared with its pivot alone, the member of which the most is
frequent, the likely common origin; what is found similar becomes one component. Then only members of one list in
different components are paired, exactly, in ranges of size. Pairs are rejected by parity bitmaps of their sets, whose
distance never exceeds the true one, and those left are decided on the sets of their texts. So no link that a component
depends on is lost, copies and near copies of one text cost as many comparisons as there are of them, and no list meets
in one task: every step is an aggregate with partial sums or a join whose hot keys Spark may split.

`link_documents` so gives components; `similar_pairs` gives every link between different sets, which for a group of n
different near copies is of the order of n * n by definition.

Defined results: null or blank texts have the empty set, no links and themselves as component; rows of equal id count as
one document for links; a null id is never linked and keeps a null component; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.plans.shared import checked_broadcast, materialize

from .common import bounded_batches, leave_cache, released
from .graph import components

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A document in so many is asked which elements are frequent, and sets holding an element there that make it so.
SAMPLE_RATE, FREQUENT = 16, 4
#: Most frequent elements kept on the workers (8 bytes each and a class); the least frequent count as rare beyond it.
FREQUENT_KEPT = 1_000_000
_LARGEST_LIGHT = 16
#: Rows listed that cost as much as bringing two texts together and comparing their sets (about 30 and 2 microseconds).
PAIR_COST = 16.0
_SIZE_STEP = 1.03


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of the words, A-Z in lower case."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < n:  # the whole sequence is one, told from n-grams by its length
        acc = np.array([len(h)], np.uint64)
        for x in h:
            acc = acc * _ODD + x
        return _mix(acc)
    acc = h[: len(h) - n + 1]
    for j in range(1, n):
        acc = acc * _ODD + h[j : len(h) - n + 1 + j]
    return np.unique(_mix(acc))


def overlap_needed(s: int, t: int, num: int, den: int) -> int:
    return -(-num * (s + t) // (num + den))


def _needed(s: Column, t: Column, num: int, den: int) -> Column:
    return F.floor((F.lit(num) * (s + t) + F.lit(num + den - 1)) / F.lit(num + den)).cast("int")


def subset_sizes(s: int, boundary: int, num: int, den: int) -> list[int]:
    """Sizes of subsets that a light set of s elements lists."""
    return sorted({c for t in range(-(-num * s // den), min(boundary, den * s // num) + 1) if (c := overlap_needed(s, t, num, den)) <= min(s, t)})


def choose_boundary(sizes: dict[int, tuple[int, int]], num: int, den: int) -> int:
    """The boundary of least cost. sizes: size of set -> sets, and partners in the lists of all their prefix elements."""
    best, at = math.inf, 0
    for b in range(_LARGEST_LIGHT + 1):
        cost = 0.0
        for s, (count, partners) in sizes.items():
            if s <= b:
                cost += count * sum(math.comb(s, c) for c in subset_sizes(s, b, num, den))
            if s > b:
                cost += count * (s - -(-num * s // den) + 1) + PAIR_COST * partners
            elif s >= -(-num * (b + 1) // den):
                cost += count * (s - -(-num * s // den) + 1)
        if cost < best:
            best, at = cost, b
    return at


def _bitmap(u: np.ndarray) -> bytes:
    bits = max(64, 1 << int(2 * len(u) - 1).bit_length()) if len(u) else 64
    return np.packbits((np.bincount((u & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    leave_cache()
    for b in released(batches):
        sizes, d1, d2, maps = [], [], [], []
        for text in b.column(1):
            u = shingles(text.as_py(), n)
            digest = np.frombuffer(xxh3_128_digest(u.tobytes()), np.int64)
            sizes.append(len(u))
            d1.append(int(digest[0]))
            d2.append(int(digest[1]))
            maps.append(_bitmap(u))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "n", "d1", "d2", "bits"])


def _elements(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in released(batches):
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(t.as_py(), n) for t in b.column(0)]).view(np.int64))], names=["token"])


_POSTED = "doc_id long, token long, n int, i int, c int, rank float"


def _postings(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int, boundary: int, frequent) -> Iterator[pa.RecordBatch]:
    """doc_id, token, n, i, c, rank: c is a subset's size, or 0 for an element at position i; rank chooses pivots."""
    keys, classes = frequent.value
    names = ["doc_id", "token", "n", "i", "c", "rank"]
    for b in released(batches):
        out: list[list] = [[] for _ in names]
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            u = shingles(text.as_py(), n)
            s = len(u)
            if not s:
                continue
            if s <= boundary:
                for c in subset_sizes(s, boundary, num, den):
                    for chosen in itertools.combinations(range(s), c):
                        key = int(_mix(u[list(chosen)].sum(keepdims=True) + np.uint64(c * int(_ODD) % (1 << 64))).view(np.int64)[0])
                        for column, value in zip(out, (doc, key, s, 0, c, -float(s))):
                            column.append(np.array([value]))
            if s > boundary or s >= -(-num * (boundary + 1) // den):
                at = np.searchsorted(keys, u)
                at[at == len(keys)] = 0
                kind = np.where(keys[at] == u, classes[at], 0) if len(keys) else np.zeros(s, np.uint8)
                first = u[np.lexsort((u, kind))][: s - -(-num * s // den) + 1]
                k = len(first)
                for column, value in zip(out, (np.full(k, doc), first.view(np.int64), np.full(k, s), np.arange(k), np.zeros(k), np.full(k, float((kind > 0).mean())))):
                    column.append(value)
        if out[0]:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float32()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(t) for c, t in zip(out, kinds)], names=names)


def _near(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose bitmaps do not prove them too far apart."""
    for b in released(batches):
        keep = []
        for s, t, x, y in zip(*(b.column(c).to_pylist() for c in ("na", "nb", "xa", "xb"))):
            x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            keep.append(int(np.bitwise_count(x ^ y).sum()) <= s + t - 2 * overlap_needed(s, t, num, den))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _similar(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    last, held = None, np.empty(0, np.uint64)
    for b in released(batches):
        keep = []
        for x, y in zip(b.column("ta"), b.column("tb")):
            x, y = x.as_py(), y.as_py()
            if x != last:
                last, held = x, shingles(x, n)
            u = shingles(y, n)
            both = len(np.intersect1d(held, u, assume_unique=True))
            keep.append(bool(len(u)) and den * both >= num * (len(held) + len(u) - both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def frequent_elements(docs: DataFrame, n: int):
    """Broadcast of sorted hashes and their classes of frequency (1: least frequent), at most FREQUENT_KEPT."""
    sample = docs.where(F.abs(F.xxhash64(F.lit("sample"), "doc_id") % SAMPLE_RATE) == 0).select("text")
    counts = sample.mapInArrow(partial(_elements, n=n), "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    got = counts.orderBy(F.desc("n"), "token").limit(FREQUENT_KEPT).toPandas()
    keys, n_docs = got["token"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.float64)
    order = np.argsort(keys)
    classes = (1 + np.floor(np.log2(np.maximum(n_docs, FREQUENT) / FREQUENT) / 2)).astype(np.uint8)
    return docs.sparkSession.sparkContext.broadcast((keys[order], classes[order]))


def _plausible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    a = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    return materialize(pairs.join(a, "a").join(b, "b").mapInArrow(partial(_near, num=num, den=den), "a long, b long").distinct(), "plausible")


def _verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    texts = docs.join(checked_broadcast(ids), "doc_id")
    a, b = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return materialize(pairs.join(a, "a").join(b, "b").mapInArrow(partial(_similar, n=n, num=num, den=den), "a long, b long"), "edges")


def _classes(df: DataFrame, id_col: str, text_col: str, n: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs; their sets; pairs (smallest id, other id) of equal sets; docs with one row of each different set."""
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = materialize(docs.mapInArrow(partial(_sets, n=n), "doc_id long, n int, d1 long, d2 long, bits binary"), "sets")
    known = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = materialize(known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "classes")
    equal = known.select("doc_id", "n", "d1", "d2").join(checked_broadcast(classes), ["n", "d1", "d2"]).where("doc_id <> a")
    equal = materialize(equal.select("a", F.col("doc_id").alias("b")).distinct(), "equal")
    copies = checked_broadcast(equal.select(F.col("b").alias("doc_id")))
    return docs, sets, equal, docs.where(F.col("doc_id").isNotNull()).join(copies, "doc_id", "left_anti")


def _small_sizes(single: DataFrame, sets: DataFrame, posted, limit: int) -> dict[int, tuple[int, int]]:
    """What `choose_boundary` asks for, of all sets of at most `limit` elements (at most `limit` rows come to the driver)."""
    small = sets.where((F.col("n") > 0) & (F.col("n") <= limit) & F.col("doc_id").isNotNull()).select("doc_id", "n").distinct()
    small = materialize(small, "small")
    texts = single.join(checked_broadcast(small.select("doc_id")), "doc_id").select("doc_id", "text")
    listed = materialize(texts.mapInArrow(partial(posted, boundary=0), _POSTED), "small_lists")
    counts = listed.groupBy("token").agg(F.count(F.lit(1)).alias("k"))
    partners = listed.join(counts, "token").groupBy("n").agg(F.sum(F.col("k") - 1).alias("partners"), F.count_distinct("doc_id").alias("sets"))
    return {r["n"]: (r["sets"], r["partners"]) for r in partners.collect()}


def _lists(single: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Postings in lists of two or more: doc_id, token, n, i, c, rank (see `_postings`)."""
    posted = partial(_postings, n=n, num=num, den=den, frequent=frequent_elements(single, n))
    boundary = choose_boundary(_small_sizes(single, sets, posted, 2 * _LARGEST_LIGHT), num, den)
    postings = materialize(single.mapInArrow(partial(posted, boundary=boundary), _POSTED), "postings")
    shared = postings.groupBy("token", "c").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    return materialize(postings.join(shared, ["token", "c"]), "lists")


def _prefix_pairs(lists: DataFrame, num: int, den: int) -> DataFrame:
    """a, b (and their columns component, if any, as ca and cb) that may be similar by size and place in a list, a the larger.

    Members are paired in ranges of size a factor _SIZE_STEP wide, each with those that it can be similar to.
    """
    lists = lists if "component" in lists.columns else lists.withColumn("component", F.col("doc_id"))
    step = F.lit(math.log(_SIZE_STEP))

    def bucket(c: Column) -> Column:
        return F.floor(F.ln(c.cast("double")) / step + 1e-9).cast("int")

    smallest = F.ceil(F.col("n") * num / den).cast("int")
    larger = lists.withColumn("size", F.explode(F.sequence(bucket(F.greatest(smallest, F.lit(1))), bucket(F.col("n")))))
    low = F.greatest(smallest, F.floor(F.exp(F.col("size") * step)).cast("int"))
    larger = larger.where(F.col("n") - F.col("i") >= _needed(F.col("n"), low, num, den))
    larger = larger.select("token", "size", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("component").alias("ca"))
    smaller = lists.select("token", bucket(F.col("n")).alias("size"), F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("component").alias("cb"))
    need = _needed(F.col("na"), F.col("nb"), num, den)
    ordered = (F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    return larger.join(smaller, ["token", "size"]).where(ordered & (F.col("na") - F.col("ia") >= need) & (F.col("nb") - F.col("ib") >= need))


def similar_pairs(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (80, 100)) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets as (a, b), a < b, of the smallest ids that hold them; and membership (doc_id,
    class_id, class_rows) of the documents with a set. Two documents are linked if their classes are one or are linked."""
    num, den = threshold
    docs, sets, equal, single = _classes(df, id_col, text_col, n)
    lists = _lists(single, sets, n, num, den)
    light = lists.where("c > 0").select("token", "c", "doc_id", "n")
    other = light.select("token", "c", F.col("doc_id").alias("other"), F.col("n").alias("other_n"))
    light = light.join(other, ["token", "c"]).where((F.col("doc_id") < F.col("other")) & (_needed(F.col("n"), F.col("other_n"), num, den) <= F.col("c")))
    pairs = light.select(F.col("doc_id").alias("a"), F.col("other").alias("b")).union(_prefix_pairs(lists.where("c = 0"), num, den).select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    links = _verified(_plausible(pairs, sets, num, den), docs, n, num, den)
    held = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    member = held.join(equal.withColumnRenamed("b", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("a", "doc_id").alias("class_id"))
    rows = member.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_rows"))
    return links, materialize(member.join(rows, "class_id").select("doc_id", "class_id", "class_rows"), "member")


def link_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id for each row. `threshold` is a fraction of integers."""
    num, den = threshold
    docs, sets, equal, single = _classes(df, id_col, text_col, n)
    lists = _lists(single, sets, n, num, den)
    pivots = lists.groupBy("token", "c").agg(F.max(F.struct("rank", F.bitwise_not("doc_id").alias("neg"), "n", "i")).alias("p"))
    pivots = pivots.select("token", "c", F.bitwise_not("p.neg").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.i").alias("pi"))
    need = _needed(F.col("n"), F.col("pn"), num, den)
    fits = F.when(F.col("c") > 0, need <= F.col("c")).otherwise((F.col("n") - F.col("i") >= need) & (F.col("pn") - F.col("pi") >= need))
    stars = lists.join(pivots, ["token", "c"]).where((F.col("doc_id") != F.col("pivot")) & fits)
    stars = stars.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    edges = _verified(_plausible(stars, sets, num, den), docs, n, num, den).union(equal)
    grouped = components(edges)

    # Exactly: members of a list that are not yet in one component.
    held = checked_broadcast(grouped.withColumnRenamed("id", "doc_id"))
    apart = lists.where("c = 0").join(held, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    apart = materialize(apart.select("token", "doc_id", "n", "i", "component"), "apart")
    several = apart.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    apart = materialize(apart.join(several, "token"), "several")
    pairs = _prefix_pairs(apart, num, den).where("ca <> cb")
    more = _verified(_plausible(pairs.select("a", "b").distinct(), sets, num, den), docs, n, num, den)
    if more.limit(1).count():
        grouped = components(edges.union(more))
    label = checked_broadcast(grouped.withColumnRenamed("id", "doc_id"))
    out = sets.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(label, "doc_id", "left")
    return out.withColumn("component_id", F.coalesce("component", "doc_id")).drop("component")
