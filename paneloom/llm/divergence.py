"""How the sources of a language differ in their words: a sort-based streaming audit.

1. A task takes texts of some megabytes together, sorts their words as (lang, term, source, document) and scans the runs, which
   gives each (lang, term, source) its documents and occurrences. Several such scans are merged the same way before they
   are emitted as a `block`: a row for each (lang, term) with its sources in order. This is the only look at the texts.
2. The rows are dealt into ranges of (lang, term, block) and sorted so. One scan of a range adds runs of equal terms source
   by source, and at the end of a run knows in how many documents of the language the term occurs. Ranges cut any run, so
   the most frequent term is spread like all others; only the first and last term of a range can go on elsewhere, and
   these few are added in one small aggregate.
3. Totals of each source and language come from the kept terms' runs. A second scan turns each run into smoothed shares and
   adds the terms' parts of every pair of sources to a matrix, of which a task emits one partial for each language, and
   keeps each source's first terms. With more than `BLOCK` sources in a language, matrices are cut in tiles, and a
   run goes to each tile of its language.

Shares are exact: 1e9 * (count + 2) / total is divided in three steps of 1000, in 64-bit integers, for totals below 9e15.

Memory: the words of 4 MB of texts and 1.5 million (term, source) counts in step 1 (a longer text is counted by itself, in
pieces); a batch and one term's sources in step 2; 4 million cells of matrices in step 3. The result has a row for each
ordered pair of sources of a language, so it is quadratic in those by contract.

Defined results: null text, lang and source are ''. Each row is a document, also with a repeated or null id. A group without
a term, and a language without a kept term, have pairs of value f over zero counts, or 0. An empty table gives no rows. No
column but the three named is read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paneloom.plans.ranking import global_ordinal
from paneloom.plans.shared import checked_broadcast, materialize

from .common import LETTERS, bounded_batches, released, term_runs

#: Sources of one side of a tile of the pair matrix.
BLOCK = 128
_HELD_BYTES, _HELD_DOCS, _HELD_COUNTS = 4 << 20, 10_000, 1_500_000
_CELLS = 4_000_000
#: `counts` is an array of (source's number int32, documents int32, occurrences int64), little-endian.
_BLOCKS = "lang string, term string, block long, counts binary"
_RUNS = "lang string, term string, edge boolean, sources array<int>, df long, dfs array<long>, ns array<long>"
_PARTS = "part string, lang string, source string, item string, value long"


def _counted(table: bytes, held_bytes: int, held_counts: int):
    def count(batches: Iterator) -> Iterator:
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        entry = np.dtype([("source", "<i4"), ("df", "<i4"), ("n", "<i8")])
        langs: dict = {}  # name -> number
        lang_of: dict = {}  # source -> number of its language
        held: list = []  # (terms, term's number, source, df, n)
        texts: list = []  # (sources, binary array)
        size = docs = held_n = block = 0
        task = TaskContext.get().partitionId() << 33

        def language(sources: np.ndarray) -> np.ndarray:
            unique, at = np.unique(sources, return_inverse=True)
            return np.array([lang_of[s] for s in unique.tolist()], np.int64)[at]

        def scanned() -> None:
            """Sort the words of `texts` as (lang, term, source, document) and hold their runs."""
            nonlocal size, docs, held_n
            columns = []
            for _, c in texts:
                offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
                blanked = memoryview(c.buffers()[2])[offsets[0] : offsets[-1]].tobytes().translate(table) if len(c) and c.buffers()[2] else b""
                own = np.ascontiguousarray(offsets - offsets[0])
                columns.append(pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(c), [None, pa.py_buffer(own), pa.py_buffer(blanked)])))
            sources = np.concatenate([s for s, _ in texts])
            texts.clear()
            split = pa.concat_arrays(columns)
            doc = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy())
            words = split.flatten()
            full = pc.greater(pc.binary_length(words), 0)
            words, doc = words.filter(full), doc[full.to_numpy(zero_copy_only=False)]
            size = docs = 0
            if not len(words):
                return
            coded = words.dictionary_encode()
            n_terms, n_docs = len(coded.dictionary), len(split)
            unique, own = np.unique(sources, return_inverse=True)
            key = language(sources)[doc] * n_terms + coded.indices.to_numpy()
            key = np.sort((key * len(unique) + own[doc]) * n_docs + doc)
            new_doc = np.append(True, key[1:] != key[:-1])
            run = key // n_docs
            at = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            n = np.diff(np.append(at, len(key)))
            df = np.add.reduceat(new_doc.astype(np.int32), at)
            run = run[at]
            held.append((coded.dictionary, (run // len(unique) % n_terms).astype(np.int32), unique[run % len(unique)], df, n))
            held_n += len(at)

        def long_text(source: int, text: bytes) -> None:
            nonlocal held_n
            n: Counter = Counter()
            for terms in term_runs(text, table):
                n.update(terms)
            if n:
                held.append((pa.array(list(n), pa.string()), np.arange(len(n), dtype=np.int32), np.full(len(n), source, np.int32), np.ones(len(n), np.int32), np.array(list(n.values()), np.int64)))
                held_n += len(n)

        def emitted() -> Iterator:
            """Merge what is held: a row for each (lang, term)."""
            nonlocal held_n, block
            if not held:
                return
            coded = pa.concat_arrays([h[0] for h in held]).dictionary_encode()
            number, start = coded.indices.to_numpy(), np.cumsum([0] + [len(h[0]) for h in held])
            term = np.concatenate([number[start[i] + h[1]] for i, h in enumerate(held)]).astype(np.int64)
            source, df, n = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
            held.clear()
            held_n = 0
            unique, own = np.unique(source, return_inverse=True)
            key = (language(source) * len(coded.dictionary) + term) * len(unique) + own
            order = np.argsort(key)
            key = key[order]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            out = np.empty(len(at), entry)
            out["source"], out["df"], out["n"] = unique[key[at] % len(unique)], np.add.reduceat(df[order], at), np.add.reduceat(n[order], at)
            rows = key[at] // len(unique)
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            ends, rows, names = np.append(first, len(out)), rows[first], list(langs)
            for i in range(0, len(rows), 5_000):
                some = rows[i : i + 5_000]
                bounds = ends[i : i + len(some) + 1]
                counts = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(((bounds - bounds[0]) * entry.itemsize).astype(np.int32)), pa.py_buffer(out[bounds[0] : bounds[-1]].tobytes())])
                lang = pa.array(names, pa.string()).take(pa.array(some // len(coded.dictionary)))
                yield pa.RecordBatch.from_arrays([lang, coded.dictionary.take(pa.array(some % len(coded.dictionary))), pa.array(np.full(len(some), task + block)), counts], ["lang", "term", "block", "counts"])
            block += 1

        for b in batches:
            sources = b.column("source").to_numpy()
            for s, name in zip(sources.tolist(), b.column("lang").to_pylist(), strict=True):
                lang_of[s] = langs.setdefault(name, len(langs))
            text = pc.fill_null(b.column("text"), b"")
            length = pc.binary_length(text).to_numpy()
            for i in np.flatnonzero(length > held_bytes).tolist():
                long_text(int(sources[i]), text[i].as_py())
            usual = np.flatnonzero(length <= held_bytes)
            texts.append((sources[usual], text.take(pa.array(usual)) if len(usual) < len(text) else text))
            size, docs = size + int(length[usual].sum()), docs + len(usual)
            if size >= held_bytes or docs >= _HELD_DOCS:
                scanned()
            if held_n >= held_counts:
                yield from emitted()
        if texts:
            scanned()
        yield from emitted()

    return lambda batches: released(count(batches))


def _scanned(least_df: int):
    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        entry = np.dtype([("source", "<i4"), ("df", "<i4"), ("n", "<i8")])
        carry, first = None, True  # the last term so far and its counts; whether it is the range's first

        def runs(lang, term, at: np.ndarray, source: np.ndarray, df: np.ndarray, n: np.ndarray, edge: np.ndarray) -> Iterator:
            """A row for each term; `at` is where its sources begin."""
            ends = np.append(at[1:], len(source))
            total = np.add.reduceat(df, at)
            keep = edge | (total >= least_df)
            inside = np.repeat(keep, ends - at)
            offsets = np.append(0, np.cumsum((ends - at)[keep])).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[inside])) for x in (source, df, n)]
            mask = pa.array(keep)
            out = pa.RecordBatch.from_arrays([lang.filter(mask), term.filter(mask), pa.array(edge[keep]), lists[0], pa.array(total[keep]), *lists[1:]], ["lang", "term", "edge", "sources", "df", "dfs", "ns"])
            for i in range(0, len(out), 1000):
                yield out.slice(i, 1000)

        for b in batches:
            if not len(b):
                continue
            lang, term, counts = (b.column(c) for c in ("lang", "term", "counts"))
            offsets = np.frombuffer(counts.buffers()[1], np.int32)[counts.offset : counts.offset + len(counts) + 1]
            entries = np.frombuffer(counts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(entry)
            source, df, n = entries["source"], entries["df"].astype(np.int64), entries["n"]
            of_row = np.diff(offsets) // entry.itemsize
            if carry is not None:
                lang, term = (pa.concat_arrays([x, y]) for x, y in zip(carry[:2], (lang, term), strict=True))
                source, df, n = (np.concatenate([x, y]) for x, y in zip(carry[2:], (source, df, n), strict=True))
                of_row = np.append(len(carry[2]), of_row)
            new = np.append(True, pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False)) if len(lang) > 1 else np.array([True])
            run = np.repeat(np.cumsum(new) - 1, of_row)
            order = np.lexsort((source, run))
            run, source = run[order], source[order]
            at = np.flatnonzero(np.append(True, (run[1:] != run[:-1]) | (source[1:] != source[:-1])))
            df, n, run, source = np.add.reduceat(df[order], at), np.add.reduceat(n[order], at), run[at], source[at]
            heads = pa.array(np.flatnonzero(new))
            lang, term = lang.take(heads), term.take(heads)
            begin = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            last = int(begin[-1])
            carry = (lang[-1:], term[-1:], source[last:], df[last:], n[last:])
            if last:
                edge = np.zeros(len(begin) - 1, bool)
                edge[0] = first
                yield from runs(lang[:-1], term[:-1], begin[:-1], source[:last], df[:last], n[:last], edge)
                first = False
        if carry is not None:
            yield from runs(carry[0], carry[1], np.array([0]), *carry[2:], np.array([True]))

    return lambda batches: released(scan(batches))


def _blank(c: str):
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))


def numbered_groups(docs: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Every (lang, source) that occurs, with a number."""
    groups = docs.select(_blank(lang_col).alias("lang"), _blank(source_col).alias("name")).distinct()
    return global_ordinal(groups, [F.col("lang"), F.col("name")], "source").withColumn("source", F.col("source").cast("int"))


def term_runs_of(docs: DataFrame, groups: DataFrame, *, least_df: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", table: bytes = LETTERS, held_bytes: int = _HELD_BYTES, held_counts: int = _HELD_COUNTS) -> DataFrame:
    """A row for each term that occurs in `least_df` documents or more of a language: (lang, term, df, n, by_source), the
    last an array of a group's number and the occurrences there."""
    bounded_batches(docs.sparkSession)
    read = docs.select(_blank(lang_col).alias("lang"), _blank(source_col).alias("name"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    read = read.join(checked_broadcast(groups), ["lang", "name"]).select("lang", "source", "text")
    blocks = materialize(read.mapInArrow(_counted(table, held_bytes, held_counts), _BLOCKS), "blocks")
    order = ["lang", "term", "block"]
    runs = materialize(blocks.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scanned(least_df), _RUNS), "runs")
    whole = runs.where("NOT edge").select("lang", "term", "df", F.arrays_zip(F.col("sources").alias("source"), F.col("ns").alias("n")).alias("by_source"))
    cut = runs.where("edge").select("lang", "term", F.explode(F.arrays_zip("sources", "dfs", "ns")).alias("x"))
    cut = cut.groupBy("lang", "term", F.col("x.sources").alias("source")).agg(F.sum("x.dfs").alias("df"), F.sum("x.ns").alias("n"))
    cut = cut.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("by_source")).where(F.col("df") >= least_df)
    out = whole.unionByName(cut).withColumn("n", F.aggregate("by_source", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    return materialize(out.select("lang", "term", "df", "n", "by_source"), "kept")


def _compared(top: int, cells: int):
    def compare(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def share(n: np.ndarray, total) -> np.ndarray:
            """1 + floor(1e9 * (n + 2) / total), exactly."""
            out, rest = np.divmod(n + 2, total)
            for _ in range(3):
                digit, rest = np.divmod(rest * 1000, total)
                out = out * 1000 + digit
            return out + 1

        def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            d = p - q
            return d * d // (p + q)

        tiles: dict = {}  # (lang, a, b) -> names and totals of both sides, their sums
        best: dict = {}  # (lang, source) -> [(-value, term)]
        size = 0

        def emit() -> Iterator:
            parts, langs, sources, items, values = [], [], [], [], []

            def batch() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (parts, langs, sources, items)] + [pa.array(values, pa.int64())], ["part", "lang", "source", "item", "value"])
                for c in (parts, langs, sources, items, values):
                    c.clear()
                return out

            for (lang, a, b), tile in tiles.items():
                for i, x in enumerate(tile["left"]):
                    for j in range(i + 1 if a == b else 0, len(tile["right"])):
                        for c, v in zip((parts, langs, sources, items, values), ("pair", lang, x, tile["right"][j], int(tile["sums"][i, j])), strict=True):
                            c.append(v)
                    if len(parts) >= 10_000:
                        yield batch()
            for (lang, source), found in best.items():
                for v, term in found:
                    for c, x in zip((parts, langs, sources, items, values), ("term", lang, source, term, -v), strict=True):
                        c.append(x)
                if len(parts) >= 10_000:
                    yield batch()
            if parts:
                yield batch()

        def side(by_source: pa.ListArray, numbers: list[int]) -> np.ndarray:
            """Counts of the terms (rows) in one side's sources (columns)."""
            out = np.zeros((len(by_source), len(numbers)), np.int64)
            row = np.repeat(np.arange(len(by_source)), pc.list_value_length(by_source).to_numpy())
            found = by_source.flatten()
            place = pc.fill_null(pc.index_in(found.field("source"), pa.array(numbers, pa.int32())), -1).to_numpy()
            ok = place >= 0
            out[row[ok], place[ok]] = found.field("n").to_numpy()[ok]
            return out

        for b in batches:
            groups: dict = {}
            keys = zip(*(b.column(c).to_pylist() for c in ("lang", "a", "b")), strict=True)
            for i, key in enumerate(keys):
                groups.setdefault(key, []).append(i)
            for key, at_rows in groups.items():
                lang, a, other = key
                rows = b.take(pa.array(at_rows))
                if key not in tiles:
                    left, right = (rows.column(k)[0].as_py() for k in ("left", "right"))
                    sides = [[x["name"] for x in y] for y in (left, right)]
                    numbers = [[x["source"] for x in y] for y in (left, right)]
                    totals = [np.array([x["total"] for x in y], np.int64) for y in (left, right)]
                    tiles[key] = {"left": sides[0], "right": sides[1], "numbers": numbers, "totals": totals, "sums": np.zeros((len(left), len(right)), np.int64)}
                    size += len(left) * len(right)
                tile = tiles[key]
                rows = rows.filter(pc.is_valid(rows.column("term")))
                step = max(1, 1_000_000 // max(1, tile["sums"].size))
                for at in range(0, len(rows), step):
                    some = rows.slice(at, step)
                    terms = some.column("term").to_pylist()
                    counts = side(some.column("by_source"), tile["numbers"][0])
                    p = share(counts, tile["totals"][0])
                    q = p if a == other else share(side(some.column("by_source"), tile["numbers"][1]), tile["totals"][1])
                    tile["sums"] += far(p[:, :, None], q[:, None, :]).sum(axis=0)
                    if a != other:
                        continue
                    all_p = share(some.column("n").to_numpy(), some.column("lang_total").to_numpy())
                    value = np.where((counts > 0) & (p > all_p[:, None]), far(p, all_p[:, None]), -1)
                    for i, source in enumerate(tile["left"]):
                        had = best.get((lang, source), [])
                        v = value[:, i]
                        # what can't be among the first: less than the last of those already found
                        low = -had[-1][0] if len(had) == top else 0
                        if len(v) > top:
                            low = max(low, int(np.partition(v, -top)[-top]))
                        hits = np.flatnonzero((v >= low) & (v >= 0))
                        if len(hits):
                            best[lang, source] = sorted(had + [(-int(v[t]), terms[t]) for t in hits])[:top]
            if size > cells or len(best) * top > cells // 10:
                yield from emit()
                tiles.clear()
                best.clear()
                size = 0
        yield from emit()

    return lambda batches: released(compare(batches))


def audit(docs: DataFrame, *, least_df: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", block: int = BLOCK, held_bytes: int = _HELD_BYTES, held_counts: int = _HELD_COUNTS, cells: int = _CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair`, how far the source is from each other one of its language;
    part `term`, the `top` terms that set it apart from the whole language."""
    groups = materialize(numbered_groups(docs, lang_col, source_col), "groups")
    kept = term_runs_of(docs, groups, least_df=least_df, text_col=text_col, lang_col=lang_col, source_col=source_col, held_bytes=held_bytes, held_counts=held_counts)
    counted = kept.select("lang", F.explode("by_source").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_n"))
    groups = groups.join(counted, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    of_lang = W.partitionBy("lang")
    groups = groups.withColumn("blocks", F.ceil(F.count(F.lit(1)).over(of_lang) / block).cast("int"))
    groups = groups.select("lang", "source", "name", "blocks", F.greatest(F.col("n") + 2 * F.col("v"), F.lit(1)).alias("total"), F.greatest(F.col("lang_n") + 2 * F.col("v"), F.lit(1)).alias("lang_total"))
    groups = groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    side = materialize(groups.groupBy("lang", "lang_total", "blocks", "block").agg(F.sort_array(F.collect_list(F.struct("source", "name", "total"))).alias("members")), "sides")
    left = side.select("lang", "lang_total", "blocks", F.col("block").alias("a"), F.col("members").alias("left"))
    right = side.select("lang", F.col("block").alias("b"), F.col("members").alias("right"))
    tiles = materialize(left.join(checked_broadcast(right), "lang").where("a <= b"), "tiles")
    many = tiles.where("blocks > 1").limit(1).count() > 0
    seeds = tiles.select("lang", "a", "b", "lang_total", "left", "right", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(None).cast(kept.schema["by_source"].dataType).alias("by_source"))
    rows = kept.select("lang", "term", "n", "by_source").join(checked_broadcast(tiles), "lang")
    if many:
        in_tile = lambda x: F.pmod(F.xxhash64(x["source"]), F.col("blocks")).isin(F.col("a"), F.col("b"))
        rows = rows.withColumn("by_source", F.filter("by_source", in_tile))
    rows = rows.select(*seeds.columns).unionByName(seeds)
    if many:
        tasks = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        salt = F.pmod(F.xxhash64("term"), F.greatest(F.lit(1), F.lit(tasks) / F.lit(tiles.count())).cast("int"))
        rows = rows.repartition("lang", "a", "b", salt)
    parts = materialize(rows.mapInArrow(_compared(top, cells), _PARTS), "parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    pairs = pairs.select("lang", "value", both).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    firsts = parts.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(firsts).select("lang", "source", "part", "item", "value", "rank")
