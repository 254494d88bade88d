"""Substring deduplication by broadcast suffix automata of reference shards.

A window of `window` consecutive words goes if the same words also stand in a document of smaller id; a word goes if any
such window covers it.

1. Reference. Passages that many documents share are found in one document of `rate` (by a hash of its id): pieces of
   `gram` words that at least `least` of those hold. The text around the `most` commonest, as it stands in the smallest of
   those documents, is the reference: at most `most` stretches of 2 * window words, whatever the input. Its suffix
   automaton, with the smallest document that each state's words occur in, is broadcast.
2. Streaming. Every document runs past the automaton wherever all its pieces are the reference's. The state of the last
   `window` words (matching statistics) says whether they stand in a smaller document; maximal spans of such windows are
   the document's, one row each, and nothing else of them is ever shuffled. A passage that all documents share costs a row
   for each document.
3. Anchors. Of the pieces of each window that is left, the one of least hash is the window's anchor, pieces of the
   reference only where there is no other. So equal windows have equal anchors, wherever they stand, and a window that
   reaches out of a common passage has an anchor of its own. Only anchors that two documents share go on (counted with
   partial sums). The smallest document of a window never loses it to the reference, so it is always among them.
4. Segments. A document is cut into the stretches of words whose windows one shared anchor owns. Equal segments of an anchor
   are collapsed to one by a 128-bit digest: its owner, the one of smallest id, stands for its copies.
5. Shards. The different segments of the anchors that two documents share are dealt to shards by anchor (those of an anchor
   with one text by document, where neighbours are one text again); a shard is bounded in words and bytes, and one suffix automaton over its segments decides on all their windows as that of the reference does:
   for a segment's owner by the smaller documents before it, for its copies by those and the owner. What a copy loses is
   what the automaton says of the text that it was collapsed to. What is shared by few grows with the input, so these shards
   are built in the task that streams their segments rather than broadcast.
6. An anchor with more than `shard_rows` different segments (a passage in many contexts, too rare for the reference), or more
   than `shard_bytes` of them, would fill a shard by itself. Its windows are grouped by a 128-bit digest with the smallest
   document instead, which has partial sums and no bound on the group: the exact way for what no shard may hold.

Steps 2 and 5 compare words; the collapsing of step 4 and step 6 compare 128-bit digests of words.

Defined results: words are runs of anything but space and \\t to \\r; a null text has none; a null id counts as the largest, 2^63
- 1, and is not told from it; rows of equal id are never deduplicated against one another; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.plans.shared import materialize

from .common import bounded_batches, leave_cache, released

_ODD = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = (1 << 63) - 1
#: Words of a document whose segments without another text are dealt together.
_BESIDE = 5000
#: Mean length of word up to which a stretch may be in the reference.
_LONG = 32


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").split()


def _grams(words: list[bytes], gram: int) -> np.ndarray:
    """Hashes of the pieces of `gram` words, by the place of their first word."""
    from xxhash import xxh3_64_intdigest

    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    acc = h[: len(h) - gram + 1]
    for j in range(1, gram):
        acc = acc * _ODD + h[j : len(h) - gram + 1 + j]
    acc = (acc ^ (acc >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (acc ^ (acc >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of `wanted` are in the sorted `keys`."""
    if not len(keys):
        return np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return keys[at] == wanted


def _owned(acc: np.ndarray, common: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a document of at least `window` words: hash, first and last start of the windows that each owns."""
    # the least hash of each window, those of the reference last, the leftmost of equal ones: hash above, place below
    low = (acc >> np.uint64(1)) | (common.astype(np.uint64) << np.uint64(63))
    low = (low & ~np.uint64(0xFFFFFFFF)) | np.arange(len(acc), dtype=np.uint64)
    span, wide = window - gram + 1, 1
    while 2 * wide <= span:
        low = np.minimum(low[: len(low) - wide], low[wide:])
        wide *= 2
    if span > wide:
        low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return acc[place[first]].view(np.int64), first, np.r_[first[1:] - 1, len(place) - 1]


def _stretches(marked: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true places: first, and one past the last."""
    edges = np.flatnonzero(np.diff(np.r_[False, marked, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _sampled(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for b in released(batches):
        keys, docs = [], []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
            words = _words(text.as_py())
            if len(words) >= window:
                acc = _grams(words, gram)
                k = np.unique(_owned(acc, np.zeros(len(acc), bool), window, gram)[0])
                keys.append(k)
                docs.append(np.full(len(k), doc))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(docs))], names=["anchor", "doc"])


def _quoted(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The stretches of words around the anchors asked for; those of words too long to be held are left out."""
    for b in released(batches):
        rows = []
        for doc, text, wanted in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            words, wanted = _words(text.as_py()), set(wanted)
            acc = _grams(words, gram)
            marked = np.zeros(len(words), bool)
            for k, first, last in zip(*(x.tolist() for x in _owned(acc, np.zeros(len(acc), bool), window, gram))):
                if k in wanted and sum(map(len, words[first : last + window])) <= _LONG * (last + window - first):
                    marked[first : last + window] = True
            rows += [(doc, b" ".join(words[x:y])) for x, y in _stretches(marked)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 2, (pa.int64(), pa.binary()))], names=["doc", "words"])


def reference(docs: DataFrame, window: int, gram: int, rate: int, least: int, most: int):
    """Broadcast of the reference's automaton (flat, see `SuffixAutomaton.flat`) and of the hashes of its pieces."""
    sample = docs.where(F.pmod(F.xxhash64(F.lit("reference"), "doc"), F.lit(rate)) == 0).select("doc", "text")
    anchors = sample.mapInArrow(partial(_sampled, window=window, gram=gram), "anchor long, doc long")
    often = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"), F.max("doc").alias("top"))
    often = often.where(f"n >= {least} AND doc < top").orderBy(F.desc("n"), "anchor").limit(most)
    sources = materialize(often.groupBy("doc").agg(F.collect_list("anchor").alias("wanted")), "sources")  # at most `most` rows
    quoted = sample.join(F.broadcast(sources), "doc").select("doc", "text", "wanted").mapInArrow(partial(_quoted, window=window, gram=gram), "doc long, words binary")
    automaton, pieces = SuffixAutomaton(), [np.empty(0, np.uint64)]
    for doc, held in sorted({(r["doc"], bytes(r["words"])) for r in quoted.collect()}):
        words = held.split(b" ")
        automaton.add(words, doc)
        pieces.append(_grams(words, gram))
    automaton.settle()
    return docs.sparkSession.sparkContext.broadcast((automaton.flat(), np.unique(np.concatenate(pieces))))


def _anchors(batches: Iterator[pa.RecordBatch], window: int, gram: int, held) -> Iterator[pa.RecordBatch]:
    """Spans that the reference covers (anchor null; first and past the last word), and anchors of the windows left."""
    leave_cache()
    automaton, common = held.value
    span = window - gram + 1
    names, kinds = ["anchor", "doc", "tag", "first", "past"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    for b in released(batches):
        keys, docs, tags, starts, covered = [], [], [], [], []
        for doc, text, tag in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
            words = _words(text.as_py())
            if len(words) < window:
                continue
            acc = _grams(words, gram)
            known = _among(common, acc)
            k, first, last = _owned(acc, known, window, gram)
            if known.any():
                upto = np.r_[0, np.cumsum(known)]
                gone = np.zeros(len(words) - window + 1, bool)
                for x, y in _stretches(upto[span:] - upto[:-span] == span):
                    gone[[x + s for s in covered_starts(automaton, words[x : y - 1 + window], doc, window)]] = True
                if gone.any():
                    covered += [(doc, tag, x, y) for x, y in _runs(np.flatnonzero(gone).tolist(), window)]
                    done = np.r_[0, np.cumsum(gone)]
                    open_ = done[last + 1] - done[first] < last + 1 - first
                    k, first = k[open_], first[open_]
            keys.append(k)
            docs.append(np.full(len(k), doc))
            tags.append(np.full(len(k), tag))
            starts.append(first)
        if covered:
            columns = list(zip(*covered))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(covered), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds[1:]))], names=names)
        if keys:
            n = sum(map(len, keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(tags)), pa.array(np.concatenate(starts).astype(np.int32)), pa.nulls(n, pa.int32())], names=names)


def _segments(batches: Iterator[pa.RecordBatch], window: int, gram: int, held) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    common = held.value[1]
    names = ["anchor", "doc", "tag", "first", "n", "g1", "g2", "words"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    for b in released(batches):
        rows = []
        for doc, text, tag, shared in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
            words, shared = _words(text.as_py()), set(shared)
            acc = _grams(words, gram)
            for k, first, last in zip(*(x.tolist() for x in _owned(acc, _among(common, acc), window, gram))):
                if first in shared:
                    text_of = b" ".join(words[first : last + window])
                    g = np.frombuffer(xxh3_128_digest(text_of), np.int64).tolist()
                    rows.append((k, doc, tag, first, last + window - first, *g, text_of))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


class SuffixAutomaton:
    """Of several sequences, added in ascending order of their ids."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [_NO_ID]

    def add(self, words: list, doc: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for w in words:
            p, q = last, nxt[last].get(w)
            if q is not None and length[q] == length[p] + 1:
                last = q
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                length.append(length[p] + 1)
                first.append(doc)
                link.append(0)
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p < 0:
                    last = cur
                    continue
                q = nxt[p][w]
                if length[q] == length[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
            else:
                cur = -1
            twin = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            first.append(min(first[q], doc))
            link.append(link[q])
            link[q] = twin
            if cur >= 0:
                link[cur] = twin
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = twin
                p = link[p]
            last = cur if cur >= 0 else twin

    def settle(self) -> None:
        """A state's words occur wherever those of the states linked to it do."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            p = self.link[v]
            self.first[p] = min(self.first[p], self.first[v])

    def flat(self) -> tuple:
        """words -> numbers; (state, number) as one integer -> state; links; lengths; first documents."""
        number: dict = {}
        for moves in self.next:
            for w in moves:
                number.setdefault(w, len(number))
        n = len(number)
        go = {v * n + number[w]: u for v, moves in enumerate(self.next) for w, u in moves.items()}
        return number, go, self.link, self.length, self.first

    def covered(self, words: list, doc: int, window: int) -> tuple[list[int], list[int]]:
        """Starts of the windows of `words` that occur in a sequence of smaller id, and of those that occur in one of smaller or
        equal id: what a copy of larger id loses. For an automaton used once, where it was built."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        v, n, at = 0, 0, -window
        less: list[int] = []
        upto: list[int] = []
        for word in words:
            at += 1
            to = nxt[v].get(word)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(word)
            if to is None:
                n = 0
                continue
            v, n = to, n + 1
            if n >= window:
                while length[link[v]] >= window:
                    v = link[v]
                    n = length[v]
                if first[v] <= doc:
                    upto.append(at)
                    if first[v] < doc:
                        less.append(at)
        return less, upto


def covered_starts(automaton: tuple, words: list, doc: int, window: int) -> list[int]:
    """Starts of the windows of `words` that occur in a sequence of smaller id."""
    number, go, link, length, first = automaton
    size = len(number)
    v, n, out = 0, 0, []
    for i, word in enumerate(words):
        w = number.get(word)
        if w is None:
            v, n = 0, 0
            continue
        to = go.get(v * size + w)
        while to is None and v:
            v = link[v]
            n = length[v]
            to = go.get(v * size + w)
        if to is not None:
            v, n = to, n + 1
        while v and length[link[v]] >= window:
            v = link[v]
            n = length[v]
        if n >= window and first[v] < doc:
            out.append(i - window + 1)
    return out


def _runs(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Starts of windows -> spans of words."""
    out: list[list[int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1][1] = s + window
        else:
            out.append([s, s + window])
    return [(a, b) for a, b in out]


def _joined(pdf: pd.DataFrame, window: int) -> Iterator[tuple[list, list]]:
    """Texts of a shard, in order of document, with the rows and word offsets of the segments in each: segments that follow one
    another in a document, and of whose anchors there is no other text, are one text again."""
    rows = list(pdf.itertuples(index=False))
    at = 0
    while at < len(rows):
        words, parts, last = rows[at].words.split(b" "), [(rows[at], 0)], rows[at]
        at += 1
        while at < len(rows) and last.pure and rows[at].pure and (last.doc, last.tag, last.first + last.n - window + 1) == (rows[at].doc, rows[at].tag, rows[at].first):
            last = rows[at]
            parts.append((last, len(words) - window + 1))
            words += last.words.split(b" ")[window - 1 :]
            at += 1
        yield words, parts


def _shard(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """Spans of the segments' owners (copies false), and of the segments as their copies have them (from a segment's start)."""
    texts = list(_joined(pdf.sort_values(["doc", "tag", "first"], kind="stable"), window))
    automaton = SuffixAutomaton()
    for words, parts in texts:
        automaton.add(words, parts[0][0].doc)
    automaton.settle()
    out = []
    for words, parts in texts:
        if all(r.lowest >= r.doc == r.top for r, _ in parts):
            continue
        lost, held = (np.array(x, np.int64) for x in automaton.covered(words, parts[0][0].doc, window))
        for r, offset in parts:
            for copies, starts in ((False, lost), (True, held)):
                if copies and r.doc == r.top:
                    continue
                some = starts[np.searchsorted(starts, offset) : np.searchsorted(starts, offset + r.n - window, "right")] - offset
                place = 0 if copies else r.first
                out += [(r.anchor, r.g1, r.g2, copies, r.doc, r.tag, place + a, place + b) for a, b in _runs(some.tolist(), window)]
    return pd.DataFrame(out, columns=["anchor", "g1", "g2", "copies", "doc", "tag", "a", "b"])


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    names = ["g1", "g2", "doc", "tag", "a"]
    for b in released(batches):
        for words, doc, tag, first in zip(*(b.column(c).to_pylist() for c in ("words", "doc", "tag", "first"))):
            words = words.split(b" ")
            n = len(words) - window + 1
            g = np.frombuffer(b"".join(xxh3_128_digest(b" ".join(words[i : i + window])) for i in range(n)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(g[:, 0].copy()), pa.array(g[:, 1].copy()), pa.array(np.full(n, doc)), pa.array(np.full(n, tag)), pa.array(np.arange(first, first + n, dtype=np.int32))], names=names)


def repeated_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 10, shard_words: int = 60_000, shard_rows: int = 1000, shard_bytes: int = 2 << 20, rate: int = 16, least: int = 4, most: int = 1500) -> DataFrame:
    """doc, tag, spans: for each document with repeated words, their spans [a, b) (word positions, unordered). `tag` is xxhash64 of the text."""
    bounded_batches(df.sparkSession)
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.col(text_col).cast("string").alias("text")).withColumn("tag", F.xxhash64("text"))
    held = reference(docs, window, gram, rate, least, most)
    streamed = materialize(docs.mapInArrow(partial(_anchors, window=window, gram=gram, held=held), "anchor long, doc long, tag long, first int, past int"), "anchors")
    common = streamed.where("anchor IS NULL").select("doc", "tag", F.col("first").alias("a"), F.col("past").alias("b"))
    anchors = streamed.where("anchor IS NOT NULL").drop("past")
    shared = anchors.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("anchor")
    shared = materialize(shared, "shared")  # a table of its own, so that Spark may split a hot anchor in the join
    places = anchors.join(shared, "anchor").groupBy("doc", "tag").agg(F.collect_set("first").alias("places"))
    places = materialize(places, "places")
    # What is shared is a steady part of the texts, so these joins shuffle at every size rather than switch at a bound.
    chosen = docs.join(places.hint("merge"), ["doc", "tag"]).select("doc", "text", "tag", "places")
    segments = chosen.mapInArrow(partial(_segments, window=window, gram=gram, held=held), "anchor long, doc long, tag long, first int, n int, g1 long, g2 long, words binary")
    segments = materialize(segments, "segments")

    keys = ["anchor", "g1", "g2"]
    kinds = segments.groupBy(*keys).agg(F.min("doc").alias("owner"), F.max("doc").alias("top"), F.max(F.octet_length("words")).alias("bytes"))
    kinds = materialize(kinds, "kinds")
    by_anchor = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("bytes").alias("held"), F.min("owner").alias("lowest"), F.max("top").alias("highest"))
    by_anchor = by_anchor.where("lowest < highest").withColumns({"alone": (F.col("kinds") > shard_rows) | (F.col("held") > shard_bytes), "pure": F.col("kinds") == 1})
    by_anchor = materialize(by_anchor.drop("highest", "kinds", "held"), "by_anchor")
    owners = kinds.join(by_anchor.hint("merge"), "anchor").select(*keys, F.col("owner").alias("doc"), "top", "lowest", "alone", "pure")
    owners = materialize(owners, "owners")
    contexts = materialize(segments.join(owners.hint("merge"), [*keys, "doc"]), "contexts")
    small, large = contexts.where("NOT alone"), contexts.where("alone")
    words, size = small.agg(F.sum("n"), F.sum(F.octet_length("words"))).first()
    shards = max(1, int((words or 0) // shard_words) + 1, int((size or 0) // shard_bytes) + 1)
    # what has no other text need only meet what stands beside it in its document
    key = F.when(F.col("pure"), F.xxhash64("doc", "tag", F.floor(F.col("first") / _BESIDE))).otherwise(F.xxhash64("anchor"))
    dealt = small.withColumn("shard", F.pmod(key, F.lit(shards)))
    schema = "anchor long, g1 long, g2 long, copies boolean, doc long, tag long, a int, b int"
    verdicts = materialize(dealt.groupBy("shard").applyInPandas(partial(_shard, window=window), schema), "verdicts")
    found = verdicts.where("NOT copies").select("doc", "tag", "a", "b")
    # a copy has its segment's spans at its own place; of segments that no shard may hold a copy is covered whole
    light = segments.select(*keys, "doc", "tag", "first", "n")
    # (once for each segment, however often its owner repeats it)
    of_copies = materialize(verdicts.where("copies").select(*keys, F.col("doc").alias("owner"), "a", "b").distinct(), "of_copies")
    copies = light.join(of_copies.hint("merge"), keys).where("doc > owner").select("doc", "tag", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
    alone = owners.where("alone AND doc < top").select(*keys, F.col("doc").alias("owner"))
    whole = light.join(alone.hint("merge"), keys).where("doc > owner").select("doc", "tag", F.col("first").alias("a"), (F.col("first") + F.col("n")).alias("b"))
    single = materialize(large.select("words", "doc", "tag", "first").mapInArrow(partial(_windows, window=window), "g1 long, g2 long, doc long, tag long, a int"), "windows")
    lowest = single.groupBy("g1", "g2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("g1", "g2", "lo")
    odd = single.join(lowest, ["g1", "g2"]).where("lo < doc").select("doc", "tag", "a", (F.col("a") + F.lit(window)).alias("b"))
    spans = common.unionByName(found).unionByName(copies).unionByName(whole).unionByName(odd)
    return materialize(spans.groupBy("doc", "tag").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")


def keep_words(words: list[bytes], spans) -> tuple[list[bytes], int]:
    gone = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        gone[a] += 1
        gone[b] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    return [w for w, g in zip(words, gone) if not g], int(gone.sum())


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in released(batches):
        rows = []
        for doc, text, spans in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("spans").to_pylist()):
            words = _words(text.as_py())
            kept, removed = keep_words(words, [(s["a"], s["b"]) for s in spans or ()])
            rows.append((doc, len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _rewritten(batches: Iterator[pa.RecordBatch], at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in released(batches):
        texts, removed = [], []
        for text, spans in zip(b.column(at), b.column("__spans").to_pylist()):
            text = text.as_py()
            n = 0
            if spans:
                kept, n = keep_words(_words(text), [(s["a"], s["b"]) for s in spans])
                text = b" ".join(kept).decode()
            texts.append(text)
            removed.append(n)
        columns = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names) - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int64())], names=names)


def _with_spans(df: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`df` and __spans. Spans are a steady part of the input, so they meet the texts in a shuffle at every size."""
    held = spans.select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("spans").alias("__spans")).hint("shuffle_hash")
    same = (F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)) == F.col("__doc")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__tag"))
    return df.join(held, same, "left").drop("__doc", "__tag")


def dedup_report(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row."""
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = _with_spans(base, repeated_spans(base, **options), "doc_id", "text").withColumnRenamed("__spans", "spans")
    return rows.mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", removed_col: str = "n_removed", **options) -> DataFrame:
    """`df` with the words kept as text where any were removed (joined by one space), and how many were."""
    df = df.drop(removed_col)
    rows = _with_spans(df, repeated_spans(df, id_col=id_col, text_col=text_col, **options), id_col, text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(removed_col, T.LongType())])
    return rows.select(*df.columns, "__spans").mapInArrow(partial(_rewritten, at=df.columns.index(text_col), names=[*df.columns, removed_col]), schema)
