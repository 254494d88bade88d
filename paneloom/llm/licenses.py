"""License scan: a positional index of rare words of license notices.

Templates are short notices with mandatory key phrases. The words of all templates are counted over all documents (a
document counts once), which gives each an inverse document frequency. A template is indexed by its `rare` words of highest
frequency weight, with their positions; a base phrase by its one rarest word. A file's words are looked up in that index,
each hit of a word at place i for position p of a template votes for the template to begin at i - p. Votes for beginnings
within `slack` words meet (words may be put in or left out), and if the rare words that voted hold `share` of the template's
weight, its mandatory phrases must stand word for word inside the place, whereupon the file gets the label. A base phrase
holds where its words stand at their relative positions exactly, every place is counted.

Texts are read twice, once for the frequencies; nothing but these frequencies (one row for each template word and task) is
shuffled. A text is looked at in runs of about a megabyte that overlap by the longest template, so memory does not
grow with it. Templates travel to all tasks and may hold `MOST_WORDS` words together; more raise an error.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows and ids are scanned as they come; an
empty table gives no rows; the columns added replace any of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LETTERS_AND_DIGITS, bounded_batches, released, term_runs

MOST_WORDS = 200_000


@dataclass(frozen=True)
class Template:
    """A notice, and phrases without which it is not that license."""

    label: str
    text: str
    phrases: tuple[str, ...]


#: Phrases whose every place is counted, and their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

#: Notices of public licenses.
TEMPLATES = (
    Template("agpl", "under the terms of the GNU Affero General Public License", ("affero general public license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    Template("apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("license identifier apache 2 0",)),
    Template("artistic-2.0", "under the terms of the Artistic License 2.0", ("artistic license 2 0",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ("redistribution and use in source and binary forms",)),
    Template("bsd", "Licensed under the BSD License", ("bsd license",)),
    Template("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-nc", "Creative Commons Attribution-NonCommercial", ("creative commons attribution noncommercial",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("cc by nd",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("cc-by-sa", "Creative Commons Attribution-ShareAlike", ("creative commons attribution sharealike",)),
    Template("cc0", "dedicated to the public domain under CC0 1.0 Universal", ("cc0",)),
    Template("epl-2.0", "under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", ("lesser general public license",)),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ("hereby granted free of charge", "deal in the software without restriction")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)


def _words(text: str, table: bytes) -> tuple[bytes, ...]:
    return tuple(w for run in term_runs(text.encode(), table) for w in run)


def _frequencies(vocabulary, table: bytes):
    def count(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        wanted, df, rows = vocabulary.value, Counter(), 0
        for b in batches:
            rows += len(b)
            for text in b.column("text").to_pylist():
                seen: set = set()
                for words in term_runs(text, table):
                    seen |= wanted.intersection(words)
                df.update(seen)
        found = [(None, rows), *df.items()]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])

    return lambda batches: released(count(batches))


def _indexed(templates: Sequence[Template], base, weight: dict[bytes, float], rare: int, table: bytes) -> dict:
    """What tasks look words up in: word -> (template, position) of the templates and base phrases it is a rare word of."""
    entries, postings = [], {}
    for t in templates:
        entries.append({"label": t.label, "words": _words(t.text, table), "phrases": [_words(p, table) for p in t.phrases], "base": False})
    entries += [{"label": label, "words": _words(phrase, table), "phrases": [], "base": True} for label, phrase in base]
    for e, entry in enumerate(entries):
        words = entry["words"]
        if not words:
            raise ValueError(f"the template of {entry['label']} has no words")
        order = sorted(set(words), key=lambda w: (-weight[w], w))[: 1 if entry["base"] else rare]
        entry["weights"] = {i: weight[w] for i, w in enumerate(words) if w in order}
        for i, w in enumerate(words):
            if w in order[:1] or (not entry["base"] and w in order):
                postings.setdefault(w, []).append((e, i))
    return {"entries": entries, "postings": postings, "reach": max(len(e["words"]) for e in entries)}


def _scan(index, share: float, slack: int, table: bytes, columns: list[str]):
    def stands(words: list[bytes], phrase: tuple[bytes, ...], low: int, high: int) -> bool:
        """Whether the phrase stands word for word in words[low:high]."""
        low = max(low, 0)
        return any(tuple(words[i : i + len(phrase)]) == phrase for i in range(low, min(high, len(words)) - len(phrase) + 1) if words[i] == phrase[0])

    def scan_text(text: bytes | None, held: dict) -> dict:
        entries, postings = held["entries"], held["postings"]
        overlap = held["reach"] + 2 * slack
        out = {"n_words": 0, "n_base": 0, "first_word": None, "last_word": None, "base": set(), "matches": []}
        words: list[bytes] = []  # the run being looked at and what is before it
        first, done = 0, None  # place of words[0]; beginnings below are looked at

        def look(end: bool) -> None:
            nonlocal words, first, done
            limit = len(words) + 1 if end else len(words) - overlap
            votes: dict = {}
            for i, w in enumerate(words):
                if w in postings:
                    for e, p in postings[w]:
                        votes.setdefault(e, []).append((i - p, p))
            for e, found in votes.items():
                entry = entries[e]
                size, weights = len(entry["words"]), entry["weights"]
                if entry["base"]:
                    for at in dict.fromkeys(a for a, _ in found):
                        if at < limit and (done is None or first + at >= done) and at >= 0 and tuple(words[at : at + size]) == entry["words"]:
                            place = first + at
                            out["n_base"] += 1
                            out["base"].add(entry["label"])
                            out["first_word"] = place if out["first_word"] is None else min(place, out["first_word"])
                            out["last_word"] = place if out["last_word"] is None else max(place, out["last_word"])
                    continue
                found.sort()
                needed, begin, inside, mass = share * sum(weights.values()), 0, {}, 0.0
                reached = None  # the end of the last place reported
                for at, p in found:
                    while found[begin][0] < at - slack:
                        q = found[begin][1]
                        inside[q] -= 1
                        if not inside[q]:
                            mass -= weights[q]
                        begin += 1
                    inside[p] = inside.get(p, 0) + 1
                    if inside[p] == 1:
                        mass += weights[p]
                    if mass < needed - 1e-9 or at >= limit or done is not None and first + at < done or reached is not None and at <= reached:
                        continue
                    low, high = at - slack, at + size + slack
                    if all(stands(words, f, low, high) for f in entry["phrases"]):
                        out["matches"].append((entry["label"], max(first + at, 0), min(1.0, mass / max(sum(weights.values()), 1e-9))))
                        reached = at
            if not end:
                done = first + max(limit, 0) if limit > 0 else done
                cut = max(0, limit - overlap)
                words, first = words[cut:], first + cut

        for run in term_runs(text, table):
            out["n_words"] += len(run)
            words += run
            look(False)
        look(True)
        return out

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = index.value
        match = pa.list_(pa.struct([("label", pa.string()), ("place", pa.int64()), ("share", pa.float64())]))
        for b in batches:
            found = [scan_text(t, held) for t in b.column("__scanned").to_pylist()]
            labels = [sorted(f["base"] | {m[0] for m in f["matches"]}) for f in found]
            score = [max([1.0 if f["base"] else 0.0, *(m[2] for m in f["matches"])]) for f in found]
            added = [
                *(pa.array([f[c] for f in found], pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")),
                pa.array([",".join(sorted(f["base"])) for f in found], pa.string()),
                pa.array([",".join(x) for x in labels], pa.string()),
                pa.array(score, pa.float64()),
                pa.array([[{"label": m[0], "place": m[1], "share": m[2]} for m in f["matches"]] for f in found], match),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *added], [*columns, *ADDED])

    return lambda batches: released(scan(batches))


#: Columns that `scan_licenses` adds.
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
_ADDED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label string, place long, share double>>"


def word_weights(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, base=BASE, *, text_col: str = "text", table: bytes = LETTERS_AND_DIGITS) -> dict[bytes, float]:
    """Inverse document frequencies, over all documents, of the templates' words."""
    texts = [x for t in templates for x in (t.text, *t.phrases)] + [phrase for _, phrase in base]
    words = [w for t in texts for w in _words(t, table)]
    if len(words) > MOST_WORDS:
        raise ValueError(f"templates of {len(words)} words; at most {MOST_WORDS} are sent to tasks")
    sent = docs.sparkSession.sparkContext.broadcast(set(words))
    counts = docs.select(F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(_frequencies(sent, table), "word string, n long")
    df = {r["word"]: r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    rows = df.pop(None, 0)
    return {w: math.log((rows + 2) / (df.get(w.decode(), 0) + 1)) for w in set(words)}


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, base=BASE, *, text_col: str = "text", rare: int = 8, share: float = 0.8, slack: int = 2, table: bytes = LETTERS_AND_DIGITS) -> DataFrame:
    """`docs` with ADDED: words, places of base phrases, labels, the best share of a template's weight, and the matches."""
    spark = docs.sparkSession
    bounded_batches(spark)
    weight = word_weights(docs, templates, base, text_col=text_col, table=table)
    index = spark.sparkContext.broadcast(_indexed(templates, base, weight, rare, table))
    kept = [f for f in docs.schema if f.name not in ADDED]
    read = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text_col}`").cast("binary").alias("__scanned"))
    schema = T.StructType([*kept, *T.StructType.fromDDL(_ADDED)])
    return read.mapInArrow(_scan(index, share, slack, table, [f.name for f in kept]), schema)
