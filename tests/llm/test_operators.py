"""The training-data operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import collections
import hashlib
import html
import random
import re
import subprocess
import sys
import time
import tracemalloc
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from paneloom.llm import chat, extraction, fingerprints, graph, jaccard, language, mixing, packing, quality, rules, substrings
from paneloom.plans import shared

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, letters="abcdefgh"):
    r = random.Random(seed)
    return ["".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(n)]


def make_docs():
    """Copies, near copies, shared passages, nulls, blanks, odd characters, one long text and a repeated row."""
    r = random.Random(5)
    passage = words(70, 999)
    texts = [" ".join(words(r.randint(40, 160), i)) for i in range(40)]
    texts += [texts[0], texts[0], texts[1] + " ", texts[3].upper()]
    for i in range(8):
        base = texts[5].split()
        base[i * 3] = "edited"
        texts.append(" ".join(base))
    for i in range(8):
        texts.append(" ".join(words(30, 100 + i) + passage[: 50 + 3 * i] + words(20, 200 + i)))
    texts += [None, "", " \t\n", "one", "One", "one two three", "ONE  two\nthree", "x\x0bx\x0cx", "Ｆｕｌｌ ﬁ é", "full fi é", "a " * 300, " ".join(words(3000, 77) + passage)]
    rows = [(i, t, "en" if i % 2 else None, ["s0", "s0", "s1", None][i % 4], None) for i, t in enumerate(texts)]
    return [*rows, rows[7]]


ROWS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    r = ROWS[:]
    random.Random(1).shuffle(r)
    return spark.createDataFrame(r, DOCS).withColumn("size", F.lit("clash")).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(params=[False, True], ids=["broadcast", "shuffle"])
def both_ways(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(shared, "BROADCAST_ROWS", 1)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack_documents(docs).collect()
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for i, x, *_ in ROWS}
    covered, sequences = collections.Counter(), collections.defaultdict(list)
    for r in got:
        a = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(a) and zlib.crc32(a[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        covered.update((r["doc_id"], k) for k in range(r["start"], r["start"] + r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    times = collections.Counter(i for i, *_ in ROWS)
    assert covered == {(i, k): times[i] for i in times for k in range(len(ids[i]))}
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    assert packing.pack_documents(empty).count() == 0


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    e = packing.Encoder(packing.default_tokenizer())
    r = random.Random(3)
    alphabet = ["a", "B", "é", "ß", "1", "²", "½", "'s", "'ll", ".", "!!", "$", " ", " ", "  ", "\n", "\n\n", "\t", "\xa0", " ", "日本", "🙂", "́", "<|endoftext|>", "\x1c", "\r\n", "word", "The"]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 25))) for _ in range(3000)] + ["", " ", "x" * 100_000, "é " * 30_000, " ".join(words(500, 1)) + "  " + "日本" * 5000]
    for _ in range(2):  # the second time from memory
        for s, ids in zip(texts, e(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, repr(s[:80])
    assert e._end is not None and max(map(len, [*e._first, *e._after])) <= e.LONGEST
    e.HELD = 0
    assert e(texts[:3]) == e(texts[:3]) and len(e._after) < 60


def test_encoder_words_by_model_alone(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    r = random.Random(8)
    stems = ["".join(r.choices("abcdefgHIJKLéÈßñçŒžÅÿ", k=r.randint(1, 12))) for _ in range(300)] + ["don", "I", "Été", "Straße"]
    ends = ["", "", ".", "$$$", "'", "',", "'.''", "<|", "|>", "!?;:"]
    plain = ["".join(r.choice(stems) + r.choice(ends) + r.choice("  \n") for _ in range(r.randint(1, 40))).strip() for _ in range(500)]
    wide = [f"{a}  {b} {c}" for a, b, c in zip(stems, stems[1:], stems[2:])]
    odd = ["don't <|endoftext|> I'll", "A<|endoftext|>b", "a1 b", "ª º µ × ÷", "", "\n", "\na", "a\n", " a", "a ", "a\n\nb", "a \nb", None]
    want = {x: t.encode(x or "", add_special_tokens=False).ids for x in plain + wide + odd}
    e = packing.Encoder(packing.default_tokenizer())
    for texts in (plain, wide + odd[:-1] + plain):
        for x, ids in zip(texts, e(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == want[x], repr(x)
    rows = pa.RecordBatch.from_pydict({"doc_id": range(len(odd)), "text": odd})
    for size in (1, 8, 1 << 20):
        assert [(i, np.frombuffer(ids, "<u4").tolist()) for i, ids in packing._encoded(rows, e, size)] == [(i, want[x]) for i, x in enumerate(odd)]
    e = packing.Encoder(packing.default_tokenizer())
    calls, encode = [], e._encode
    monkeypatch.setattr(e, "_encode", lambda *a, **k: calls.append(a) or encode(*a, **k))
    assert [np.frombuffer(ids, "<u4").tolist() for ids in e(plain)] == [want[x] for x in plain] and not calls


#: Run alone, as a worker's allocator has no other history: MB held before each batch and at the end.
_HELD_BY_A_WORKER = """
import random, re, types
from pathlib import Path
import pyarrow as pa, pyspark
from paneloom.llm import packing

pyspark.TaskContext = types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0))
r, seen = random.Random(1), []
words = [f"w{i}" for i in range(1000)]

def held():
    seen.append(int(re.search(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10)

def batches():
    for n in (50, 3000, 3000, 50, 50):
        held()
        yield pa.RecordBatch.from_pydict({"doc_id": range(n), "text": [" ".join(r.choices(words, k=400)) for _ in range(n)]})
    held()

for _ in packing._pack(batches(), packing.default_tokenizer(), 1024, 1 / 128, 0):
    pass
print(*seen)
"""


def test_worker_gives_back_what_a_large_batch_took():
    got = subprocess.run([sys.executable, "-c", _HELD_BY_A_WORKER], capture_output=True, text=True, check=True, timeout=300).stdout
    seen = list(map(int, got.split()))
    assert seen[-1] - seen[1] < 25  # 43 where Arrow's allocator keeps it


def test_harmonic_cuts():
    for n, pieces in enumerate(packing.harmonic_cuts(1024, 1 / 128)):
        assert sum(p for p, _ in pieces) == n
        assert all(p * k <= 1024 for p, k in pieces)


def test_chat(spark):
    r = random.Random(2)
    logs, rows = {}, []
    for c in range(60):
        n = r.randint(1, 5)
        logs[c] = [("user" if i % 2 == 0 else "bot", r.choice(["hi", "yes", None, ""])) for i in range(n)]
    for c, turns in logs.items():
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {x["conv_id"]: x for x in chat.collapse_and_render(df).collect()}
    want = {}
    for c, t in logs.items():
        if any(len(o) > len(t) and o[: len(t)] == t for o in logs.values()):
            continue
        same = [k for k, o in logs.items() if o == t]
        if min(same) == c:
            want[c] = len(same)
    assert {c: x["copies"] for c, x in got.items()} == want
    for c in want:
        assert got[c]["text"] == "\n".join(f"<|im_start|>{a or ''}\n{b or ''}<|im_end|>" for a, b in logs[c])
    assert chat.collapse_and_render(df.where("false")).count() == 0


def test_fingerprints(docs, empty, both_ways):
    got = fingerprints.edited_report(docs).collect()
    assert len(got) == len(ROWS)
    order = sorted(((i, t or "") for i, t, *_ in ROWS), key=lambda x: (-x[0], x[1]))
    by_id = {r["doc_id"]: r for r in got}

    def canon(t):
        def nfkc(x):
            return unicodedata.normalize("NFKC", x)

        return " ".join(nfkc(nfkc(t).casefold()).split())

    def printed(t):
        b = canon(t).encode()
        second = xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(b"wide", 42))  # the hash of a column seeds the next
        return f"{xxhash.xxh64_intdigest(b, 42):016x}{second:016x}"

    firsts = {}
    for i, t in sorted(order):
        firsts.setdefault(canon(t), i)
    for k, (i, t) in enumerate(order):
        r = by_id[i]
        assert r["n_chars"] == len(t)
        assert r["fingerprint"] == printed(t)
        assert r["class_id"] == firsts[canon(t)]
        if i == 7:  # a repeated row: the next of one is the other, and of that the row below
            nexts = {ROWS[7][1], ROWS[6][1]}
            edits = {hashlib.sha256((t[: len(t) - len(t) // 3] + x[: len(t) // 3]).encode()).hexdigest() for x in nexts}
            assert {x["edited_sha256"] for x in got if x["doc_id"] == 7} == edits
            continue
        nxt = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(canon(edited) == canon(t)) and r["near_next"] == float(canon(nxt) == canon(t))
    assert fingerprints.edited_report(empty).count() == 0


def test_next_over_many_ranges(spark):
    df = spark.range(3000).select((F.col("id") * 7 - 5000).alias("doc_id"), F.col("id").cast("string").alias("text")).withColumn("fingerprint", F.col("text"))
    for size in (40, 1):
        got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(df, range_rows=size).collect()}
        assert got == {i * 7 - 5000: str((i - 1) % 3000) for i in range(3000)}


def test_fingerprint_collisions_are_told_apart(spark, monkeypatch):
    """With a hash of three values: classes are still those of equal bytes, also in a group that is split."""
    monkeypatch.setattr(fingerprints, "wide_hash", lambda c: F.substring(F.md5(c), 1, 1).cast("string"))
    monkeypatch.setattr(fingerprints, "SPLIT_ROWS", 7)
    rows = [(i, f"text {i % 40}" if i % 3 else "hot", None, None, None) for i in range(600)]
    got = {r["doc_id"]: r["class_id"] for r in fingerprints.edited_report(spark.createDataFrame(rows, DOCS).repartition(5)).collect()}
    first = {}
    assert got == {i: first.setdefault(t, i) for i, t, *_ in rows}


def test_rules(docs, empty):
    got = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    assert len(got) == len({i for i, *_ in ROWS})
    for i, t, *_ in ROWS:
        t = t or ""
        w = WORD.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:]))
        hit = set()
        for k in range(len(w) - 2):
            if grams[tuple(w[k : k + 3])] > 1:
                hit |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert rules.judge(empty).count() == 0


def test_rules_of_one_very_long_word(spark):
    """Measures and rules are linear in the text."""
    rows = [(1, "1" * 3_000_000, None, None, None), (2, "-" * 1_000_000 + "a " + "x y " * 100_000, None, None, None)]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1]["n_words"] == 1 and got[1]["failed_rule"] == "base" and got[2]["n_words"] == 200_001
    a = spark.createDataFrame([("--a1 12 b-c ½ é,é 日 .. x",)], "text string")
    assert a.selectExpr(f"NOT ({next(r.fails for r in rules.RULES if r.name == 'wordless').split(' < ')[0]} = 10) AS other").first()[0] is False


def test_cascade_takes_conditional_rates(spark, monkeypatch):
    """A rule that rejects only what an earlier one has rejected comes last, however much it rejects."""
    monkeypatch.setattr(rules, "_cpu_seconds", lambda *a: 0.0)
    df = spark.createDataFrame([(i, " ".join(words(60, i)) + " A" * (i % 10 < 6) + " B" * (i % 10 < 5) + " C" * (i % 10 == 9), None, None, None) for i in range(200)], DOCS)
    some = (rules.Rule("B", "text LIKE '% B'"), rules.Rule("C", "text LIKE '% C'"), rules.Rule("A", "text LIKE '% A%'"))
    assert [r.name for r in rules.cascade_order(df, some)] == ["A", "C", "B"]


def test_cascade_order_changes_no_verdict(docs):
    shouting = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("### "), F.upper("text"))).otherwise(F.col("text")))
    ways = [{r["doc_id"]: r["kept"] for r in rules.judge(shouting, order).collect()} for order in (rules.RULES, rules.RULES[::-1])]
    assert ways[0] == ways[1] and len(set(ways[0].values())) == 2


def mix_targets(sizes, weights=(5, 2, 1), share=1.5):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, full = share * sum(sizes.values()), set()
    while len(full) < len(order):
        level = (goal - sum(2 * sizes[s] for s in full)) / sum(w[s] for s in order if s not in full)
        more = {s for s in order if s not in full and level * w[s] >= 2 * sizes[s]}
        if not more:
            return {s: 2 * sizes[s] if s in full else level * w[s] for s in order}
        full |= more
    return {s: 2 * sizes[s] for s in order}


def test_mixing(docs, empty, both_ways):
    got = mixing.mix_plan(docs.drop("size")).collect()
    assert len(got) == len(ROWS)
    sizes = collections.Counter()
    for _, t, _, s, _ in ROWS:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = mix_targets(sizes), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.05 * sizes[s] + 60
    again = mixing.mix_plan(docs.drop("size").repartition(2)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in got)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def pareto_sample(rows, targets, power=0.5, seed="mix", max_copies=2):
    """(source, whole copies, probabilities by row, rows drawn) of each source, from the definitions; rows: id, source, size."""
    for source, target in targets.items():
        mine = [(i, n) for i, s, n in rows if s == source]
        total = sum(n for _, n in mine)
        if not total:
            continue
        whole = min(max_copies, int(target / total + 1e-12))
        rest = target - whole * total
        h = {i: 2.0 ** ((n.bit_length() - 1) * power) for i, n in mine if n}
        size, sure = dict(mine), set()
        while True:
            open_ = [i for i in h if i not in sure]
            level = (rest - sum(size[i] for i in sure)) / sum(h[i] * size[i] for i in open_)
            above = {i for i in open_ if level * h[i] > 1}
            if not above:
                break
            top = max(h[i] for i in above)
            sure |= {i for i in above if h[i] == top}
        p = {i: 1.0 if i in sure else level * h[i] for i in h}
        n = round(sum(p[i] for i in open_) if rest else 0)

        def quotient(i):
            u = (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            return u / (1 - u) * (1 - p[i]) / p[i]

        yield source, whole, p, sure | set(sorted(open_, key=quotient)[:n]) if rest else set()


def test_mixing_draws_a_fixed_size_with_unequal_chances(spark):
    r = random.Random(12)
    rows = [(i, f"s{i % 4}", int(2 ** r.uniform(0, 11))) for i in range(1600)]
    df = spark.createDataFrame([(i, "w " * n, "en", s, 0) for i, s, n in rows], DOCS).repartition(5)
    got = {x["doc_id"]: x for x in mixing.mix_plan(df, share=0.7, tolerance=10.0).collect()}
    targets = {x["source"]: x["target"] for x in got.values()}
    several = 0
    for source, whole, p, drawn in pareto_sample(rows, targets):
        assert {i for i, x in got.items() if x["source"] == source and x["drawn"]} == drawn
        assert all(got[i]["p"] == pytest.approx(p[i]) and got[i]["copies"] == whole + (i in drawn) for i in p)
        several += len(set(p.values())) > 3
        assert sum(p[i] * got[i]["size"] for i in p) == pytest.approx(targets[source] - whole * sum(got[i]["size"] for i in p))
    assert several >= 2
    # over many seeds a document is drawn about as often as its probability says
    few = [x for x in rows if x[1] == "s0"][:40]
    goal = {"s0": 0.4 * sum(n for *_, n in few)}
    times = collections.Counter()
    for k in range(1500):
        for _, _, p, drawn in pareto_sample(few, goal, seed=f"seed{k}"):
            times.update(drawn)
    assert all(abs(times[i] / 1500 - p[i]) < 0.06 for i in p)


def test_mixing_past_one_long_document(spark):
    sizes = [2770, *(30 + 7 * i % 50 for i in range(55))]
    df = spark.createDataFrame([(1000 * s + i, "w " * n, "en", f"s{s:02d}", 0) for s in range(12) for i, n in enumerate(sizes)], DOCS)
    taken, target = collections.Counter(), {}
    for r in mixing.mix_plan(df, weights=(1,), share=0.45).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(target) == 12
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in target), [(taken[s], target[s]) for s in target]


def test_quality(spark, empty, both_ways):
    r = random.Random(4)
    rows = [(i, " ".join(words(60, i)) if i % 4 else " ".join(w + "***" for w in words(60, i)), "en", f"s{i % 5}" if i % 7 else None, 0) for i in range(200)] + [(900, None, None, None, None), (901, "", "en", "s1", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(0, 200, 2)], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in quality.with_quality(df, labels).collect()}
    assert len(got) == len(rows)
    assert sum((got[i]["p_quality"] >= 0.5) == (i % 4 != 0) for i in range(1, 200, 2)) >= 98
    assert all(0 <= x["path_posterior"] <= 1 for x in got.values())
    assert quality.with_quality(empty, labels).count() == 0
    assert quality.with_quality(df, labels.limit(0)).count() == len(rows)
    del r


def test_quality_posteriors_against_brute_force(spark):
    """Host and path posteriors and the odds that a document gets, from the definitions; its own evidence counts once."""
    r = random.Random(9)
    rows = [(f"h{r.randrange(6)}", f"p{r.randrange(3)}", round(r.uniform(0.02, 0.98), 3)) for _ in range(300)] + [("lone", None, 0.2), (None, "p0", 0.9)]
    sites, prior = quality.posteriors(spark.createDataFrame(rows, "_host string, _path string, p_doc double").repartition(4))
    got = {(x["_host"], x["_path"]): x for x in sites.collect()}
    assert prior == pytest.approx((sum(p for *_, p in rows) + 0.5) / (len(rows) + 1))

    def sums(key):
        out = collections.defaultdict(list)
        for h, q, p in rows:
            out[key(h, q)].append(p)
        return out

    def precision(groups, mean):
        some = [(len(v), sum(v) / len(v), mean(k)) for k, v in groups.items() if len(v) > 1]
        n = sum(x[0] for x in some)
        noise = sum(x[0] * x[2] * (1 - x[2]) for x in some) / n
        between = max(1e-9, (sum(k * (p - m) ** 2 for k, p, m in some) - len(some) * noise) / n)
        return min(1e6, max(1.0, noise / between - 1))

    hosts, paths = sums(lambda h, q: h), sums(lambda h, q: (h, q))
    k = precision(hosts, lambda h: prior)
    host = {h: (sum(v) + k * prior) / (len(v) + k) for h, v in hosts.items()}
    k2 = precision(paths, lambda x: host[x[0]])
    assert set(got) == set(paths)
    for x, v in paths.items():
        assert got[x]["host_posterior"] == pytest.approx(host[x[0]]) and got[x]["_n"] == len(v)
        assert got[x]["path_posterior"] == pytest.approx((sum(v) + k2 * host[x[0]]) / (len(v) + k2))
        own = v[0]
        others = spark.range(1).select(quality.without_own(F.lit(got[x]["path_posterior"]), F.lit(len(v)), F.lit(k2), F.lit(own))).first()[0]
        assert others == pytest.approx((sum(v) - own + k2 * host[x[0]]) / (len(v) - 1 + k2))


def test_sparse_sites_shrink(spark):
    evidence = spark.createDataFrame([(f"h{h}", "p", 0.9 if h % 2 else 0.3) for h in range(6) for _ in range(50)] + [("tiny", "p", 0.0)], "_host string, _path string, p_doc double")
    sites, prior = quality.posteriors(evidence)
    got = {r["_host"]: r["host_posterior"] for r in sites.collect()}
    assert abs(got["h1"] - 0.9) < 0.1 and abs(got["h0"] - 0.3) < 0.1
    assert 0.0 < got["tiny"] < prior


@pytest.mark.parametrize("order", [1, 2, 4])
def test_language(spark, empty, order):
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "éüßñø"}
    rows = [(i, " ".join(words(30, i, alphabets[lang])), lang, "s", 0) for i, lang in enumerate(list(alphabets) * 40)]
    rows += [(1000, None, "aa", "s", 0), (1001, "12 !! ½ ² ① Ⅷ", "bb", "s", 0), (1002, "", None, "s", 0), (1003, "abcde", None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r["doc_id"]: r for r in language.identify(df, order=order).collect()}
    assert len(got) == len(rows)
    for i, text, lang, *_ in rows[:120]:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] == "aa"
    assert language.identify(empty).count() == 0
    nothing = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(nothing).collect()} == {"und"}


@pytest.mark.parametrize("bounds", [{"max_grams": 1}, {"max_grams": 60}, {"max_cells": 1000}])
def test_language_keeps_its_order_beyond_the_broadcast(spark, bounds):
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "éüßñø"}
    rows = [(i, " ".join(words(20, i, alphabets[lang])), lang, "s", 0) for i, lang in enumerate(list(alphabets) * 20)]
    rows += [(1000, None, "aa", "s", 0), (1001, "12 !!", "bb", "s", 0), (1002, "", None, "s", 0), (1003, "abcxyz Ω", None, "s", 0), rows[2]]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    key = lambda r: (r["doc_id"], r["score"])
    whole = sorted(language.identify(df).collect(), key=key)
    tables = sorted(language.identify(df, **bounds).collect(), key=key)
    assert len(whole) == len(tables) == len(rows)
    for a, b in zip(whole, tables):
        assert [a[c] for c in ("doc_id", "held_out", "lang_pred", "accepted")] == [b[c] for c in ("doc_id", "held_out", "lang_pred", "accepted")]
        assert b["score"] == pytest.approx(a["score"], abs=1e-4) and b["entropy"] == (a["entropy"] and pytest.approx(a["entropy"], rel=1e-5))


def test_language_counts_the_cells_of_its_arrays(spark):
    rows = [(i, " ".join(words(8, i, a)), lang) for i, (lang, a) in enumerate([("aa", "abc"), ("bb", "\u0430\u0431\u0432"), ("cc", "\u03b1\u03b2\u03b3")] * 4)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = language.count_grams(learn, 3)
    model = language.train(learn, seen)
    assert language.model_cells(seen) == sum(logs.size + weights.size for _, logs, _, weights in model.tables)
    for order in (0, 5):
        with pytest.raises(ValueError):
            language.identify(learn.withColumn("source", F.lit("s")), order=order)


def brute_entropies(learn, texts, order):
    """Interpolated Kneser-Ney straight from its definition, with dictionaries: cross-entropy per character by language."""
    tops = collections.defaultdict(collections.Counter)

    def chars(text):
        for w in re.findall(r"[a-zéüßñøà-ÿ]+", text.lower()):
            s = "\x01" * (order - 1) + w + "\x02"
            for i in range(order - 1, len(s)):
                yield s[i - order + 1 : i + 1]

    for text, lang in learn:
        tops[lang].update(chars(text))
    levels = {}
    for lang, top in tops.items():
        levels[lang] = [top]
        for _ in range(order - 1):
            levels[lang].append(collections.Counter(g[1:] for g in levels[lang][-1]))
    symbols = len({g for x in levels.values() for g in x[-1]}) + 1

    def prob(tables, g):
        if not g:
            return 1 / symbols
        table = tables[0]
        once, twice = (sum(v == k for v in table.values()) for k in (1, 2))
        d = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
        same = [v for x, v in table.items() if x[:-1] == g[:-1]]
        below = prob(tables[1:], g[1:])
        return max(table[g] - d, 0) * (table[g] > 0) / sum(same) + d * len(same) / sum(same) * below if same else below

    out = []
    for t in texts:
        gs = list(chars(t))
        out.append({lang: -sum(np.log(prob(x, g)) for g in gs) / len(gs) for lang, x in levels.items()})
    return out


def test_language_against_brute_force(spark):
    alphabets = {"aa": "abcde", "bb": "abcdf", "cc": "abcéüßñ"}
    rows = [(i, " ".join(words(6, i, alphabets[lang])), lang, "s", 0) for i, lang in enumerate(list(alphabets) * 12)]
    rows += [rows[3], (2000, "ab Café " * 3000, None, None, None)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows, DOCS).repartition(3), order=3).collect()}
    learn = [(t, lang) for i, t, lang, *_ in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2]
    texts = [t if i != 2000 else "ab Café" for i, t, *_ in rows]
    for (i, *_), h in zip(rows, brute_entropies(learn, texts, 3)):
        assert got[i]["lang_pred"] == min(h, key=h.get) and got[i]["entropy"] == pytest.approx(min(h.values()), rel=1e-5)


def test_language_accuracy_on_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.identify(df).where("held_out").join(df.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_kneser_ney_sums_to_one():
    codes, _ = language.grams(["abba", "abab", "bab"], 3)
    keys, n = np.unique(codes, return_counts=True)
    levels = [[(keys, n)]]
    for m in (2, 1):
        below, count = np.unique(levels[-1][0][0] & np.uint64((1 << (16 * m)) - 1), return_counts=True)
        levels.append([(below, count)])
    model = language.kneser_ney(["x"], 3, levels)
    symbols = [2, ord("a"), ord("b"), 9]  # 9 stands for all unseen characters
    for context in ((1, 1), (ord("a"), ord("b")), (9, ord("a"))):
        codes = np.array([(context[0] << 32) | (context[1] << 16) | s for s in symbols], np.uint64)
        assert np.exp(model.log_probs(codes)).sum() == pytest.approx(1.0, abs=1e-5)


def brute_repeats(rows, window):
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = True
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("shard_rows,options", [(1000, {}), (1, {}), (1000, {"rate": 1, "least": 2}), (1, {"rate": 2, "least": 2, "most": 3})])
def test_substrings(docs, empty, shard_rows, options):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.dedup_report(docs, shard_rows=shard_rows, shard_words=300, **options).collect()}
    want = brute_repeats(ROWS, 50)
    assert got == want and sum(x[1] for x in want.values()) > 500
    assert substrings.dedup_report(empty).count() == 0


def test_substrings_of_few_words(spark):
    r = random.Random(8)
    rows = [(i, " ".join(r.choices("ab", k=r.randint(0, 40))), None, None, None) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    for options in ({}, {"rate": 1, "least": 2}):
        got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substrings.dedup_report(df, window=7, gram=3, **options).collect()}
        assert got == brute_repeats(rows, 7)


def test_substrings_of_a_passage_in_all_documents(spark, monkeypatch):
    """It is covered by the broadcast reference: one row for each document, and anchors of the smallest ones only."""
    passage = words(400, 1)
    rows = [(i, " ".join(words(60, 1000 + i) + passage[i % 7 :] + words(60, 5000 + i)), None, None, None) for i in range(300)]
    rows += [(900, "w" * 5_000_000 + " " + " ".join(passage) + " z" * 20_000, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    seen = {}
    keep = substrings.materialize
    monkeypatch.setattr(substrings, "materialize", lambda t, name: seen.setdefault(name, keep(t, name)))
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substrings.dedup_report(df).collect()}
    assert got == brute_repeats(rows, 50)
    assert seen["anchors"].where("anchor IS NULL").count() >= 270
    assert seen["segments"].count() < 1500


def test_remove_repeats_keeps_columns(docs):
    out = substrings.remove_repeats(docs)
    assert out.columns == [*docs.columns, "n_removed"]
    texts = {i: t for i, t, *_ in ROWS}
    assert all(r["text"] == texts[r["doc_id"]] for r in out.collect() if not r["n_removed"])


def brute_components(rows, n, num, den):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("n,threshold", [(4, (85, 100)), (5, (80, 100))])
def test_jaccard(docs, empty, both_ways, n, threshold):
    got = jaccard.link_documents(docs, n=n, threshold=threshold).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(ROWS, n, *threshold)
    assert len(got) == len(ROWS)
    assert jaccard.link_documents(empty).count() == 0


@pytest.mark.parametrize("boundary", [0, 6, 12])
def test_jaccard_at_each_boundary(spark, monkeypatch, boundary):
    """Chains and stars of edited texts, short and long, with every element frequent."""
    monkeypatch.setattr(jaccard, "choose_boundary", lambda *a, **k: boundary)
    monkeypatch.setattr(jaccard, "SAMPLE_RATE", 1)
    r = random.Random(boundary)
    rows = []
    for size in (4, 7, 9, 14, 40, 120):
        base = words(size, size)
        for _ in range(12):
            w = base[:]
            for _ in range(r.randint(0, max(1, size // 25))):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], ["new" + str(r.randrange(9))], [w[k], "ins" + str(r.randrange(9))]])
            rows.append((len(rows), " ".join(w), None, None, None))
            if r.random() < 0.5:
                base = w
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.link_documents(df, n=2, threshold=(80, 100)).collect()}
    want = brute_components(rows, 2, 80, 100)
    assert got == want and len({c for _, c in want.values()}) < len(rows)


def similar_texts(seed, sizes, copies):
    r = random.Random(seed)
    rows = []
    for k, size in enumerate(sizes):
        base = words(size, 50 * seed + k, "abcdefghijklmnop")
        for _ in range(copies):
            w = base[:]
            k = r.choice([0, len(w)])  # at an end, so that one n-gram more does not make the others new
            rows.append((len(rows), " ".join([*w[:k], *words(r.choice([0, 1, 1]), r.random()), *w[k:]]), None, None, None))
    return rows


def test_jaccard_uses_both_halves_by_itself(spark, monkeypatch):
    """The boundary that the costs give lists proper subsets of small sets; both halves find links that count."""
    rows = similar_texts(3, [11, 12, 12, 13, 60, 80, 100], 9)
    seen, chosen = {}, []
    keep, choose = jaccard.materialize, jaccard.choose_boundary
    monkeypatch.setattr(jaccard, "materialize", lambda t, name: seen.setdefault(name, keep(t, name)))
    monkeypatch.setattr(jaccard, "choose_boundary", lambda *a: chosen.append(choose(*a)) or chosen[-1])
    monkeypatch.setattr(jaccard, "components", lambda e: graph.components(e))
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.link_documents(df, n=4, threshold=(85, 100)).collect()}
    assert got == brute_components(rows, 4, 85, 100)
    assert 8 <= chosen[0] <= 16
    lists = [(r["doc_id"], r["n"], r["c"]) for r in seen["lists"].collect()]
    assert any(0 < c < n for _, n, c in lists)
    light, heavy = {d for d, _, c in lists if c}, {d for d, n, c in lists if not c and n > chosen[0]}
    linked = {d for d, (_, c) in got.items() if any(o != d and x[1] == c for o, x in got.items())}
    assert len(light & linked) > 10 and len(heavy & linked) > 10


def test_similar_pairs(spark, docs):
    rows = similar_texts(4, [9, 12, 40, 90], 8)
    for df, rows in ((spark.createDataFrame(rows, DOCS), rows), (docs, ROWS)):
        links, member = jaccard.similar_pairs(df, n=4, threshold=(85, 100))
        class_of = {r["doc_id"]: r["class_id"] for r in member.collect()}
        got = {(r["a"], r["b"]) for r in links.collect()}
        sets = {}
        for i, t, *_ in rows:
            w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            if w:
                sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)}
        assert set(class_of) == set(sets)
        for a in sets:
            assert class_of[a] == min(b for b in sets if sets[b] == sets[a])
        want = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and class_of[a] == a and class_of[b] == b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
        assert got == want and want


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, r.randrange(101, 160)) for _ in range(40)] + [(300, 300), (201, 200)]
    got = {x["id"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and got[201] == 200 and {c for i, c in got.items() if 100 <= i < 200} == {100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def page(main, menu, foot, article=True):
    body = f"<h1>{main[0]}</h1>" + "".join(f"<p>{x}" for x in main[1:])
    body = f"<article>{body}</article>" if article else f"<div>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul>{''.join(f'<li><a href=x>{m}</a>' for m in menu)}</ul></nav><!-- c <p>x</p> -->{body}<div class='comment-list'><p>no</p></div><footer>{foot}</footer></body></html>"


def test_extraction(spark):
    menu = ["Home", "News"]
    rows = [(1, "https://a.org/x/1", page(["Title", "one &amp; <b>two</b>\n  three", "&lt;p&gt; &eacute;"], menu, "foot")), (2, "https://a.org/x/2", page(["Title", "same"], menu, "foot")), (3, "https://b.org/", None), (4, None, "<p>a<br>b"), (5, "https://a.org/x/2", "")]
    bare = [(10 + i, f"https://c.org/p/{i:02d}", f"<div>Site</div><p>{' '.join(words(5, i))}</p><div>Copyright</div>") for i in range(30)]
    df = spark.createDataFrame(rows + bare, "page_id long, url string, html string").withColumn("key", F.lit(1)).repartition(4)
    got = {r["page_id"]: r for r in extraction.extract_pages(df).collect()}
    assert got[1]["text"] == "Title\none & two three\n<p> é" and got[2]["text"] == "Title\nsame"
    assert (got[3]["text"], got[4]["text"], got[5]["text"]) == ("", "a\nb", "")
    for i in range(30):
        assert got[10 + i]["text"] == " ".join(words(5, i)) and got[10 + i]["n_shared"] == 2
    many = {r["page_id"]: (r["text"], r["n_shared"]) for r in extraction.extract_pages(df, range_pages=3).collect()}
    assert many == {k: (r["text"], r["n_shared"]) for k, r in got.items()}
    assert extraction.extract_pages(df.where("false")).count() == 0


def test_differencing_decides_inside_the_article(spark):
    """A notice in every article goes, a line that one neighbour quotes stays, a copy of the article is no evidence."""
    rows = [(i, f"https://a.org/{i:03d}", page([f"T{i}", "Subscribe now!", *(["quoted"] if i in (4, 5) else []), f"own {i}"], ["Home"], f"foot {i}")) for i in range(40)]
    rows[20] = (20, "https://a.org/020", rows[19][2])
    rows.append((99, "https://alone.org/", page(["T", "Subscribe now!"], [], "f")))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for size in (200, 5):
        got = {r["page_id"]: r["text"] for r in extraction.extract_pages(df, range_pages=size).collect()}
        for i in range(40):
            # next to its copy and at the ends of the host a page has one neighbour, which does not decide inside an article
            own = 19 if i == 20 else i
            want = [f"T{own}", *(["Subscribe now!"] if i in (0, 19, 20, 39) else []), *(["quoted"] if i in (4, 5) else []), f"own {own}"]
            assert got[i].split("\n") == want, i
        assert got[99] == "T\nSubscribe now!"


def test_differencing_against_brute_force(spark):
    """All pages of a test table: the decision from sorted neighbours and a table of subsequence lengths."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_shared"]) for r in extraction.extract_pages(df, range_pages=40).collect()}
    pages = sorted((*re.match(r"[a-z]+://([^/]*)([^?#]*)", r["url"]).groups(), r["page_id"], r["html"]) for r in df.collect())
    lined = [extraction.lines_of(p[3]) for p in pages]

    def common(a, b):
        n = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                n[i + 1, j + 1] = n[i, j] + 1 if x == y else max(n[i, j + 1], n[i + 1, j])
        return n[-1, -1]

    assert len(got) == len(pages)
    decided = 0
    for k, (host, _, page_id, _) in enumerate(pages):
        lines = [x for x, _ in lined[k]]
        near = [[x for x, _ in lined[j]] for j in (k - 1, k + 1) if 0 <= j < len(pages) and pages[j][0] == host]
        for theirs in near:
            assert len(extraction.shared_places(lines, theirs)) == common(lines, theirs)
        stay, shared, _ = extraction.decide(lines, [m for _, m in lined[k]], near)
        assert got[page_id] == ("\n".join(lines[i] for i in stay), shared)
        decided += shared
    assert decided > 50


@pytest.mark.parametrize(
    "html,want",
    [
        ('<main class="content with-sidebar"><p>a</p></main><div class="sidebar">x</div>', "a"),
        ('<article><div class="article-header"><h1>T</h1></div><p>a</p><div class="article-comments">x</div></article>', "T\na"),
        ("<body><aside><p>x<article><p>a</article></body>", "a"),
        ("<article><div><aside>x</div></aside>y</article>", "y"),
        ("<article><p>a<textarea>b<p>c</article>", "a\nb\nc"),
        ('<article><p>a</p><p class="x>b</p><p>c</p></article>', "a\nb\nc"),
        ('<article><p title="x > y">a</p></article>', "a"),
        ("<article>a<script>var x = '<p>';", "a"),
        ('<section class="comments"><article class="comment"><p>x</article></section><article><p>a</article>', "a"),
        ("<article><header><h1>T</h1></header><p>a<footer>x</footer></article>", "T\na"),
        ("<p>a<p>b", "a\nb"),
        ("<article>" + "<p>w" * 30_000 + "</article>", "\n".join(["w"] * 30_000)),
        ('<p a="' * 3000, ""),
    ],
)
def test_page_structure(html, want):
    lines, kinds = zip(*extraction.lines_of(html)) if extraction.lines_of(html) else ([], [])
    stay, *_ = extraction.decide(list(lines), list(kinds), [])
    assert "\n".join(lines[i] for i in stay) == want


def test_longest_common_subsequence():
    r = random.Random(6)
    for _ in range(200):
        a, b = r.choices("abc", k=r.randint(0, 9)), r.choices("abc", k=r.randint(0, 9))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        places = extraction.shared_places(a, b)
        assert len(places) == table[-1, -1]
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in sorted(places))


def test_entities_are_decoded_once():
    assert extraction.lines_of("<p>&amp;lt;b&amp;gt;</p>") == [("&lt;b&gt;", extraction.OTHER)]
    assert html.unescape("&amp;lt;") == "&lt;"


def test_attributes_of_any_length():
    for n in (10, 3900, 4100, 300_000):
        for quote in "\"'":
            page = f"<article><div data-x={quote}{'A' * n}> LEAK{quote} b={quote}>{quote}>real text</div></article>"
            assert extraction.lines_of(page) == [("real text", extraction.MAIN)]


def test_open_quotes_cost_no_more_than_the_page():
    """Whatever quotes are left open, each part of a page is gone through a bounded number of times."""
    for unit in ('"><p ', "'\"><p '", '<p a="', "<p a='>\"", '<p "> \' ', "<i \"'> "):
        page = "<article><p " + unit * 60_000 + '"'
        start = time.process_time()
        extraction.lines_of(page)
        assert time.process_time() - start < 20


def test_tags_end_as_a_plain_reading_says():
    r = random.Random(2)
    for _ in range(400):
        page = "".join(r.choices("<p> \"'=a/", k=r.randint(1, 40)))
        tags = extraction._Tags(page)
        for m in extraction._TOKEN.finditer(page):
            if not m[2]:
                continue
            here, open_quote, at = m.end(), None, None
            while here < len(page):
                c = page[here]
                if open_quote:
                    open_quote = None if c == open_quote else open_quote
                elif c in "\"'":
                    open_quote = c
                elif c == ">":
                    at = here
                    break
                here += 1
            if at is None:
                at = page.find(">", m.end())
            assert tags.end(m.end()) == (len(page) if at < 0 else at)


def test_alignment_of_long_pages_in_bounded_memory():
    a = [f"line {i}" for i in range(30_000)]
    b = [x for i, x in enumerate(a) if i % 3] + ["other"] * 10_000
    tracemalloc.start()
    try:
        places = extraction.shared_places(a, b)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert places == {i for i in range(len(a)) if i % 3}
    assert peak < 60e6


LEAST, MOST = -(2**63), 2**63 - 1


def test_extreme_ids_and_clashing_names(spark):
    texts = [" ".join(words(60, i)) for i in range(6)]
    texts[5] = texts[0]
    ids = [LEAST, MOST, None, 0, -1, LEAST + 1]
    df = spark.createDataFrame(list(zip(ids, texts, ["en"] * 6, ["s"] * 6, [None] * 6)), DOCS)
    for name in ("_m", "_n", "_k", "_host", "_path", "__n", "__h", "__p", "__k"):
        df = df.withColumn(name, F.lit(name))
    report = {r["doc_id"]: r for r in fingerprints.edited_report(df).collect()}
    assert set(report) == set(ids)
    order = [MOST, 0, -1, LEAST + 1, LEAST, None]
    for i, d in enumerate(order):
        text, after = (texts[ids.index(x)] for x in (d, order[(i + 1) % 6]))
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert report[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    linked = {r["doc_id"]: r["component_id"] for r in jaccard.link_documents(df, n=4, threshold=(85, 100)).collect()}
    assert linked[LEAST] == linked[LEAST + 1] == LEAST and linked[MOST] == MOST
    judged = rules.judge(df)
    assert [c for c in judged.columns if c in df.columns] == df.columns and judged.count() == 6
    assert {r["_m"] for r in judged.collect()} == {"_m"}
    scored = quality.with_quality(df, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int"))
    assert scored.columns == [*df.columns, *quality.ADDED] and {r["__n"] for r in scored.collect()} == {"__n"}


def test_rules_of_a_column_of_another_name(spark):
    rule = rules.Rule("loud", "text LIKE '%!%' OR length( text) < 3")
    body = " ".join(words(60, 3))
    rows = [(1, body, "x"), (2, body + " !", "x"), (3, None, "!")]
    named = spark.createDataFrame(rows, "doc_id long, body string, text string")
    got = {r["doc_id"]: (r["kept"], r["failed_rule"], r["text"]) for r in rules.judge(named, (rule,), text_col="body").collect()}
    assert got == {1: (True, None, "x"), 2: (False, "loud", "x"), 3: (False, "base", "!")}
    assert rules.judge(named, (rule,), text_col="body").columns == ["doc_id", "body", "text", *rules.ADDED]


def test_batches_are_bounded_from_no_limit(spark):
    from paneloom.llm import common

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, want in ((0, "1000"), (-1, "1000"), (10_000, "1000"), (300, "300")):
            spark.conf.set(key, given)
            common.bounded_batches(spark)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def test_samples_stay_bounded(spark):
    from paneloom.llm import common

    ids = spark.range(200_000)
    assert abs(ids.where(common.hash_below(F.col("id"), 1e-3)).count() - 200) < 80
    assert ids.where(common.hash_below(F.col("id"), 1e-12)).count() <= 1
    assert ids.where(common.hash_below(F.col("id"), 1.0)).count() == 200_000
    assert ids.where(common.hash_below(F.col("id"), 0.0)).count() == 0
