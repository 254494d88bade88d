"""Source divergence, ranked search and license scans against brute force on small tables."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from paneloom.llm import common, divergence, licenses, search

DOCS = "doc_id long, text string, lang string, source string, n int, term string"
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def make_rows():
    """Frequent and rare terms, a hot source, nulls, blanks, odd letters, repeated rows and ids, ends of the range of longs."""
    r = random.Random(3)
    vocabulary = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(80)] + ["Ärger", "naïve", "İx", "日本", "x\u0085y", "the"]
    rows = []
    for i in range(260):
        text = " ".join(r.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary) - 1)] + [2], k=r.randint(0, 60)))
        text = text.replace("the", r.choice(["the", "The", "THE7", "the_the"]))
        rows.append((i, text, r.choice(["en", "en", "de", None, ""]), r.choice(["hot"] * 4 + ["s1", "S1", "é", "😀", None, ""]), i, "clash"))
    rows += [(None, "the wak", "en", "s1", 0, None), (None, None, "en", "s9", 0, None), (5, "", "xx", "lonely", 0, None), (-(2**63), " 12 _ ", "yy", "a", 0, None), (2**63 - 1, "the the wak", "yy", "b", 0, None), rows[3], rows[3]]
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def audited(rows, least=10, top=10):
    counts, seen = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    groups = collections.defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = LETTERS.findall((text or "").translate(AZ))
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]

        def shares(count):
            total = sum(count(t) for t in kept) + 2 * len(kept)  # noqa: B023
            return {t: 1 + 1_000_000_000 * (count(t) + 2) // total for t in kept}  # noqa: B023

        p = {s: shares(lambda t, s=s: counts[lang, s][t]) for s in sources}  # noqa: B023
        q = shares(lambda t: sum(counts[lang, s][t] for s in sources))  # noqa: B023
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            found = {"pair": [(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]}
            found["term"] = [(-far(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in found.items():
                for k, (v, item) in enumerate(sorted(items), 1):
                    if part == "pair" or k <= top:
                        out.add((lang, s, part, item.decode(), -v, k))
    return out


@pytest.mark.parametrize("options", [{}, {"held_bytes": 300}, {"held_counts": 40}, {"block": 2}, {"block": 3, "cells": 1, "held_bytes": 20}, {"least_df": 1, "top": 2}, {"least_df": 500}])
def test_divergence(docs, options):
    got = divergence.audit(docs, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == audited(ROWS, options.get("least_df", 10), options.get("top", 10))


def test_divergence_of_nothing(spark, empty):
    assert divergence.audit(empty).count() == 0
    alone = spark.createDataFrame([(1, None, None, None, 0, None)], DOCS)
    assert divergence.audit(alone).count() == 0


def test_divergence_cuts_runs_over_ranges(spark):
    """One term in all documents of one source: many ranges hold a part of its run."""
    rows = [(i, "the", "en", "hot" if i % 3 else "other", 0, None) for i in range(300)]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        got = divergence.audit(spark.createDataFrame(rows, DOCS).repartition(40), held_bytes=1)
        assert {tuple(r) for r in got.collect()} == audited(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_shares_are_exact_for_large_counts(spark):
    """Counts for which 1e9 * count passes 2**63."""
    kept = spark.createDataFrame([("en", 10, 9_000_000_000 * 7 + 5, "a"), ("en", 10, 3, "b")], "lang string, df long, n long, term string")
    kept = kept.withColumn("by_source", F.array(F.struct(F.lit(0).alias("source"), F.col("n").alias("n"))))
    total = 9_000_000_000 * 7 + 5 + 3 + 4
    side = F.array(F.struct(F.lit(0).alias("source"), F.lit("s").alias("name"), F.lit(total).cast("long").alias("total")))
    rows = kept.select("lang", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(10**12).cast("long").alias("lang_total"), side.alias("left"), side.alias("right"), "term", "n", "by_source")
    got = {r["item"]: r["value"] for r in rows.mapInArrow(divergence._compared(10, 1000), divergence._PARTS).collect() if r["part"] == "term"}
    share = lambda n, of: 1 + 1_000_000_000 * (n + 2) // of
    n = 9_000_000_000 * 7 + 5
    p, q = share(n, total), share(n, 10**12)
    assert got["a"] == (p - q) ** 2 // (p + q)


ITEMS = [(1, "the wak wak"), (2, "Ärger naïve 12 the the the the the the the"), (2, "waq"), (None, "日本 waq"), (4, None), (5, ""), (6, "nowhere"), (7, "the"), (8, "wak wbl wcm wdk x\u0085y THE7")]


def ranked(rows, items, k=10):
    docs = [(d, ALNUM.findall((text or "").translate(AZ))) for d, text, *_ in rows]
    docs = [(d, w, collections.Counter(w)) for d, w in docs if w]
    total, out = sum(len(w) for _, w, _ in docs), []
    for item, text in items:
        terms = ALNUM.findall((text or "").translate(AZ))
        df = {t: sum(t in c for _, _, c in docs) for t in terms}
        scores = []
        for d, w, c in docs:
            m = 25 + 75 * len(w) * len(docs) // total
            s = sum(math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, i, d, -s) for i, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"segment_docs": 7}, {"k": 3, "segment_docs": 1}, {"group_bytes": 20}, {"k": 1000}])
def test_search(spark, docs, options):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("clash"))
    got = search.rank(docs, items, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(ROWS, ITEMS, options.get("k", 10))


def test_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.rank(empty, items).count() == 0
    assert search.rank(docs, items.where("false")).count() == 0


def test_slices_add_and_find_like_numbers():
    r = random.Random(1)
    for _ in range(50):
        n, terms, k = r.randint(1, 90), r.randint(1, 9), r.randint(1, 12)
        numbers = [[r.choice([0, 0, r.randint(0, 9), r.getrandbits(35)]) for _ in range(n)] for _ in range(terms)]
        columns = [[sum((row[d] >> b & 1) << d for d in range(n)) for row in numbers] for b in range(35)]
        total = search.add_slices(columns)
        sums = [sum(row[d] for row in numbers) for d in range(n)]
        assert [sum((s >> d & 1) << b for b, s in enumerate(total)) for d in range(n)] == sums
        best = sorted((d for d in range(n) if sums[d]), key=lambda d: (-sums[d], d))[:k]
        assert sorted(search.top_slices(total, k)) == sorted(best)


PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def base_places(text):
    words = ALNUM.findall((text or "").translate(AZ))
    places = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for label, p in PHRASES.items()}
    flat = [i for x in places.values() for i in x]
    return len(words), len(flat), min(flat, default=None), max(flat, default=None), ",".join(sorted(k for k, v in places.items() if v))


LICENSES = [
    None, "", "...", "cc by", "CC-BY cc by-by cc", "cc by cc by all rights reserved all rights all rights reserved", "general public license general public", "rights reserved",
    "x" * 50 + " Released under the MIT License.", "Released today under the well known MIT License", "mit licence", "Licensed under the Apache License, Version 2.0 (the x)", "Licensed under the Apache License, Version 1.0",
    "This work is licensed under the GNU General Public License, version 3.", "licensed under CC BY-NC 4.0.", "permission to use", "ⅭＣ BY ccby", "the general-public\nlicense_all rights\treserved",
]


def license_rows(spark):
    filler = "lorem ipsum the under of and to in "
    long_text = (filler * 3000 + "cc by " + filler * 2000 + "Released under the MIT License general public license ") * 3
    texts = [*LICENSES, long_text, long_text]
    return texts, spark.createDataFrame([(i, t, "clash", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, labels string, __m double").repartition(3)


@pytest.mark.parametrize("size", [1 << 20, 40, 5])
def test_licenses(spark, monkeypatch, size):
    runs = common.term_runs
    monkeypatch.setattr(licenses, "term_runs", lambda text, table, s=size: runs(text, table, s))
    texts, df = license_rows(spark)
    if size == 5:
        texts, df = texts[:-2], df.where(F.length("text") < 1000)
        texts = [t for t in texts if t]
    out = licenses.scan_licenses(df)
    assert out.columns == ["doc_id", "text", "__m", *licenses.ADDED]
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(license_rows(spark)[0]):
        if i in got:
            r = got[i]
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_places(t), t
            assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
            assert r["labels"].split(",") == sorted(set(r["labels"].split(",")))
            assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    by_text = {t: got[i]["labels"] for i, t in enumerate(LICENSES) if i in got}
    assert by_text["x" * 50 + " Released under the MIT License."] == "mit"
    assert by_text["Licensed under the Apache License, Version 2.0 (the x)"] == "apache-2.0"
    assert by_text["Licensed under the Apache License, Version 1.0"] == ""
    assert by_text["mit licence"] == by_text["permission to use"] == ""
    assert by_text["This work is licensed under the GNU General Public License, version 3."] == "gpl,gpl-3.0"
    assert by_text["licensed under CC BY-NC 4.0."] == "cc-by,cc-by-nc"
    if size > 5:
        assert got[len(LICENSES)]["labels"] == "cc-by,gpl,mit"
        assert len([m for m in got[len(LICENSES)]["matches"] if m["label"] == "mit"]) == 3


def test_licenses_at_every_cut(spark):
    """However a text is cut into runs, the matches are the same."""
    weight = collections.defaultdict(lambda: 1.0)
    held = licenses._indexed(licenses.TEMPLATES, licenses.BASE, weight, 8, common.LETTERS_AND_DIGITS)
    assert held["reach"] == max(len(ALNUM.findall(t.text)) for t in licenses.TEMPLATES)
    text = "a b c " + " d e ".join(t.text for t in licenses.TEMPLATES) + " cc by all rights reserved"
    want = None
    for size in (10**6, 700, 300, 100, 30):
        df = spark.createDataFrame([(0, text)], "doc_id long, text string")
        runs = common.term_runs
        licenses.term_runs = lambda t, table, s=size: runs(t, table, s)  # noqa: B023
        try:
            r = licenses.scan_licenses(df).first()
        finally:
            licenses.term_runs = runs
        want = want or r
        assert r["labels"] == want["labels"] and sorted(r["matches"]) == sorted(want["matches"])
        assert (r["n_base"], r["first_word"], r["last_word"]) == base_places(text)[1:4]
    assert set(want["labels"].split(",")) == {t.label for t in licenses.TEMPLATES} | set(PHRASES)


def test_licenses_of_nothing(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string"), [licenses.Template("x", "y " * (licenses.MOST_WORDS + 1), ())])


@pytest.mark.parametrize("text", [None, "", "a", "A-b 12\u0085x é  b", " a " * 50, "word" * 20])
@pytest.mark.parametrize("size", [1, 3, 1000])
def test_term_runs(text, size):
    for table, pattern in ((common.LETTERS, LETTERS), (common.LETTERS_AND_DIGITS, ALNUM)):
        got = [w.decode() for run in common.term_runs(None if text is None else text.encode(), table, size) for w in run]
        assert got == pattern.findall((text or "").translate(AZ))
