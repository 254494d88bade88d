"""Harmonic packing of documents into token sequences.

A piece of length n belongs to the class k = floor(capacity / n): k pieces of at most floor(capacity / k) tokens fill one
sequence, whatever their order, so each class fills its own bins with a fixed count and workers never talk to each other.
Documents are cut so that their pieces sit close below a class's limit: whole sequences first; then a remainder that
would waste more than `tolerance` of itself gives one piece of exactly the next class's limit, and what is left goes on.
At the end of a partition the pieces in unfilled bins are laid end to end and cut at the capacity, and the last sequence
is cut at powers of two, which need no padding.

There is no shuffle: the scan's partitions are packed as they are read, so no key can be hot. A worker holds the pieces
of its open bins (at most one sequence for each class, about `capacity` classes) and one batch of documents.

Token ids are those of the `tokenizers` file, by tokenizers itself. Single spaces between other characters are the only
places where texts are split before encoding (the pre-tokenizer never joins across them); in plain texts, those without
other white space than single spaces and line ends between other characters, line ends are such places too, as such a line
end is a token by itself. Plain texts of a batch are split and their equal pieces told by Arrow, so each piece is looked up
once a batch. Pieces that the worker does not remember: of Latin letters and then ASCII marks, the pre-tokenizer makes one
word and one run of marks, which go to the file's model by themselves; all others are encoded by the whole tokenizer, many
in one call, a line for each. Pieces of up to LONGEST characters are remembered, up to HELD bytes; past 0.6 of them only
those that come a second time: most words of a language come once, and a bitmap of hashes tells them apart.

Defined results: a null text counts as empty, an empty text is the one end token; a null doc_id is kept as null; repeated
rows are packed as often as they occur; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial
from struct import pack

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, released, worker_cache

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_WIDE = re.compile(r"\s\s|[\x1c-\x1f]")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
#: (RE2) Texts that are not plain: white space at an end or beside other white space, or other than spaces and line ends.
_NOT_PLAIN = r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

LETTERS = "".join(c for c in map(chr, range(0x41, 0x180)) if c.isalpha() and c not in "ªµº")
MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum())
_WORD = re.compile(rf"(\n?[{LETTERS}]+)([{re.escape(MARKS)}]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_EMPTY, _END, _SPACE = (pa.scalar(x, pa.large_string()) for x in ("", "\n", " "))


class Encoder:
    """texts -> their token ids as little-endian unsigned 32-bit bytes."""

    #: Bytes of remembered pieces and their ids (with 150 for the objects of each), and the longest piece remembered.
    HELD, LONGEST = 50 << 20, 64
    #: Bits of the bitmap of pieces seen, 8 MB; two pieces of one bit only make one remembered early.
    SEEN_BITS = 26
    #: Pieces encoded as one text.
    LINES = 300

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        end = self._ids_of("\n")
        # only if line ends are such tokens in this vocabulary
        probe = (" a", "\n", " b!", "\n", "d", "\n", "e?", "\n", " c")
        self._end = end[0] if len(end) == 1 and self._ids_of("".join(probe)) == [x for t in probe for x in self._ids_of(t)] else None
        self._model, self._space = tokenizer.model, ""
        self._letters = self._letters_of(tokenizer)
        self._marks: dict[str, bytes] = {"": b""}
        self._first: dict[str, bytes] = {}
        self._after: dict[str, bytes] = {}
        self._bytes = 0
        self._seen = bytearray(1 << (self.SEEN_BITS - 3))

    def _letters_of(self, tokenizer) -> dict[int, str] | None:
        """What the model reads for each of LETTERS; None if words and marks are not to be had from the model alone."""
        added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        if self._end is None or tokenizer.normalizer or not all(re.search(rf"[{re.escape(MARKS)}][^{re.escape(MARKS)}]", x) for x in added):
            return None
        split = lambda s: [x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(s)]
        letters = {ord(c): "".join(split(c)) for c in LETTERS}
        word = LETTERS.translate(letters)
        self._space = split(" a")[0].removesuffix("a")
        end = split("\n")
        return letters if split(f" {LETTERS}{MARKS}\n{LETTERS} {LETTERS}") == [self._space + word, MARKS, *end, word, self._space + word] else None

    def _again(self, pieces: list[str]) -> list[bool]:
        """Whether each was here before."""
        import numpy as np

        h = np.fromiter(map(hash, pieces), np.int64, len(pieces)) & ((1 << self.SEEN_BITS) - 1)
        seen = np.frombuffer(self._seen, np.uint8)
        bit = np.left_shift(1, h & 7).astype(np.uint8)
        again = seen[h >> 3] & bit
        np.bitwise_or.at(seen, h >> 3, bit)
        return again.astype(bool).tolist()

    def _ids_of(self, s: str) -> list[int]:
        return self._encode([s], add_special_tokens=False)[0].ids

    def _forget(self) -> None:
        """Half of HELD at most stays: what came early, among it the frequent."""
        while self._bytes > self.HELD // 2:
            for held in (self._first, self._after):
                for x in list(held)[len(held) // 2 :]:
                    self._bytes -= len(x) + len(held.pop(x)) + 150

    def _learn(self, pieces: list[str], space: str, held: dict[str, bytes]) -> dict[str, bytes]:
        """Ids of pieces that follow `space`; those that begin with a line end follow that instead."""
        import numpy as np

        got, others = self._learn_words(pieces, space, held) if self._letters else ({}, pieces)
        if self._end is not None and others:
            broken = [p for p in others if p[:1] == "\n"] if space else []
            whole = [p for p in others if p[:1] != "\n"] if broken else others
            others = self._learn_lines(broken, [p[1:] for p in broken], "", self._end.to_bytes(4, "little"), got)
            others += self._learn_lines(whole, whole, space, b"", got)
        alone = [p if p[:1] == "\n" and self._end is not None else space + p for p in others]
        for piece, ids in zip(others, self._encode(alone, add_special_tokens=False) if others else ()):
            got[piece] = np.array(ids.ids, dtype="<u4").tobytes()
        return got

    def _learn_words(self, pieces: list[str], space: str, held: dict[str, bytes]) -> tuple[dict[str, bytes], list[str]]:
        """Those of letters and then marks by the model; the others are returned."""
        got: dict[str, bytes] = {}
        stems: dict[str, bytes] = {}
        others: list[str] = []
        end, before = self._end.to_bytes(4, "little"), self._space if space else ""
        match, letters, known, longest = _WORD.fullmatch, self._letters, self._marks, self.LONGEST
        for piece in pieces:
            m = match(piece) if len(piece) <= longest else None
            if m is None or not space and piece[0] == "\n":
                others.append(piece)
                continue
            stem, marks = m.groups()
            ids = stems.get(stem) or held.get(stem)
            if ids is None:
                word = stem if stem.isascii() else stem.translate(letters)
                ids = stems[stem] = end + self._by_model(word[1:]) if stem[0] == "\n" else self._by_model(before + word)
            if marks:
                if marks not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[marks] = self._by_model(marks)
                ids += known[marks]
            got[piece] = ids
        return got, others

    def _by_model(self, word: str) -> bytes:
        ids = [x.id for x in self._model.tokenize(word)]
        return pack(f"<{len(ids)}I", *ids)

    def _learn_lines(self, pieces: list[str], words: list[str], space: str, before: bytes, held: dict[str, bytes]) -> list[str]:
        """The words many in one call, a line for each. Returns what has white space in it, is empty or could hold a special
        token: that is encoded by itself."""
        import numpy as np

        others: list[str] = []
        for at in range(0, len(pieces), self.LINES):
            keys, some = pieces[at : at + self.LINES], words[at : at + self.LINES]
            text = space + ("\n" + space).join(some)
            if "<|" in text or text.split() != some:
                fit = ["<|" not in w and w.split() == [w] for w in some]
                others += [k for k, ok in zip(keys, fit) if not ok]
                keys, some = [k for k, ok in zip(keys, fit) if ok], [w for w, ok in zip(some, fit) if ok]
                if not some:
                    continue
                text = space + ("\n" + space).join(some)
            ids = np.array(self._ids_of(text), dtype="<u4")
            ends = np.flatnonzero(ids == self._end) * 4
            if len(ends) != len(some) - 1:
                raise ValueError("a line end is no token by itself")
            ids = ids.tobytes()
            held.update(zip(keys, [before + ids[i:j] for i, j in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(ids)])]))
        return others

    def _all(self, pieces: list[str], space: str, held: dict[str, bytes]) -> list[bytes]:
        """Ids of different pieces that follow `space`, from memory or learned; of the latter some are remembered."""
        out = list(map(held.get, pieces))
        new = [x for x, ids in zip(pieces, out) if ids is None]
        if new:
            got = self._learn(new, space, held)
            out = [got[x] if ids is None else ids for x, ids in zip(pieces, out)]
            again = self._again(new)
            for x, known in zip(new, again):
                if len(x) <= self.LONGEST and (known or self._bytes <= self.HELD * 0.6):
                    held[x] = ids = got[x]
                    self._bytes += len(x) + len(ids) + 150
        return out

    def _plain(self, texts: pa.Array) -> list[bytes]:
        """Ids of plain texts. Each is taken as if after a line end, whose id is cut off again."""
        import numpy as np

        split = pc.split_pattern(pc.binary_join_element_wise(_EMPTY, pc.replace_substring(texts, "\n", " \n"), _END), " ")
        coded = split.values.dictionary_encode()
        n = len(coded.dictionary)
        pieces = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), coded.dictionary), _SPACE)[0].as_py().split(" ")
        ids = pa.array(self._all(pieces, " ", self._after), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist()
        data = memoryview(ids.buffers()[2])
        return [bytes(data[i + 4 : j]) for i, j in zip(ends, ends[1:])]

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        if self._bytes > self.HELD:
            self._forget()
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not len(texts):
            return []
        other = pc.match_substring_regex(texts, _NOT_PLAIN) if self._end is not None else pa.repeat(True, len(texts))
        if not other.true_count:
            return self._plain(texts)
        plain = iter(self._plain(texts.filter(pc.invert(other))) if other.true_count < len(texts) else ())
        split = [x.split(" ") if not _WIDE.search(x) else _SINGLE.split(x) for x in texts.filter(other).to_pylist()]
        firsts = [x.pop(0) for x in split]
        first, after = list(set(firsts)), list(set().union(*split))
        first, after = dict(zip(first, self._all(first, "", self._first))), dict(zip(after, self._all(after, " ", self._after)))
        rest = iter([first[f] + b"".join(map(after.__getitem__, x)) for f, x in zip(firsts, split)])
        return [next(rest) if x else next(plain) for x in other.to_pylist()]


def harmonic_cuts(capacity: int, tolerance: float) -> list[list[tuple[int, int]]]:
    """For each remainder below the capacity: its pieces as (length, class)."""
    table: list[list[tuple[int, int]]] = [[]]
    for n in range(1, capacity):
        k = capacity // n
        if capacity // k - n <= n * tolerance:
            table.append([(n, k)])
        else:
            limit = capacity // (k + 1)
            table.append([(limit, k + 1), *table[n - limit]])
    return table


def _encoded(batch: pa.RecordBatch, encode: Encoder, size: int = 2 << 20) -> Iterator[tuple]:
    """doc_id and ids of each row; texts are encoded together up to so many bytes."""
    import numpy as np

    docs, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(docs)]
    for i, j in zip(cuts, cuts[1:]):
        yield from zip(docs[i:j], encode(texts[i:j]))


def _pack(batches: Iterator[pa.RecordBatch], path: str, capacity: int, tolerance: float, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    cache = worker_cache()
    encode = cache.get(("encoder", path)) or cache.setdefault(("encoder", path), Encoder(path))
    cuts = harmonic_cuts(capacity, tolerance)
    end = end_id.to_bytes(4, "little")
    sequence = TaskContext.get().partitionId() << 33
    bins: dict[int, list[tuple]] = {}
    out: list[tuple] = []

    def close(pieces: list[tuple]) -> None:
        nonlocal sequence
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            out.append((doc, start, n, zlib.crc32(ids), total, sequence, at))
            at += n
        sequence += 1

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    for batch in released(batches):
        for doc, ids in _encoded(batch, encode):
            ids += end
            total, at = len(ids) // 4, 0
            while total - at >= capacity:
                close([(doc, at, ids[4 * at : 4 * (at + capacity)], total)])
                at += capacity
            for n, k in cuts[total - at]:
                piece = (doc, at, ids[4 * at : 4 * (at + n)], total)
                at += n
                held = bins.setdefault(k, [])
                held.append(piece)
                if len(held) == k:
                    close(bins.pop(k))
            if len(out) >= 50_000:
                yield flush()
    rest = [p for k in sorted(bins) for p in bins[k]]
    left = sum(len(p[2]) // 4 for p in rest)
    room, current = 0, []

    def next_room() -> int:
        return capacity if left >= capacity else 1 << (left.bit_length() - 1)

    for doc, start, ids, total in rest:
        while ids:
            if not room:
                room = next_room()
            n = min(room, len(ids) // 4)
            current.append((doc, start, ids[: 4 * n], total))
            ids, start, room, left = ids[4 * n :], start + n, room - n, left - n
            if not room:
                close(current)
                current = []
    if out:
        yield flush()


def pack_documents(df: DataFrame, id_col: str | Column = "doc_id", text_col: str | Column = "text", *, capacity: int = 1024, tolerance: float = 1 / 128, end_id: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents, each in one sequence of at most `capacity` tokens."""
    bounded_batches(df.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    id_col, text_col = (F.col(c) if isinstance(c, str) else c for c in (id_col, text_col))
    rows = df.select(id_col.cast("long").alias("doc_id"), text_col.cast("string").alias("text"))
    return rows.mapInArrow(partial(_pack, path=tokenizer, capacity=capacity, tolerance=tolerance, end_id=end_id), SCHEMA)
