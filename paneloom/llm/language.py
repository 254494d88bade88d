"""Language identification by interpolated Kneser-Ney character models.

A text is its words (runs of letters, lower case), as UTF-16 units (a letter beyond the first 65,536 code points is two), each
closed by an end mark and opened by start marks, so a word's
characters are modelled given at most `order - 1` before them. Counts of the highest order are taken over all learning
texts in parallel and summed by language and n-gram (each task sends its distinct n-grams); lower orders count distinct
left neighbours, as Kneser-Ney asks, by further aggregates on those.

The model is sorted arrays of n-gram codes (four 16-bit units in one 64-bit integer) with a row of log probabilities, one
for each language, already interpolated; unseen n-grams fall back through sorted arrays of contexts with their weights.
It is broadcast while the distinct pairs of language and n-gram are at most `max_grams`, and the cells of its arrays (n-grams
and contexts of all orders, by languages) at most `max_cells`, which languages of many scripts reach first. Beyond, the order and the
probabilities are the same but stay in tables: the n-grams that the texts ask for get their probabilities order by order
in joins. Those that make up at least one in `max_grams / languages` of all asked for are broadcast, and at most that many
can be; the rest are joined to their documents, where no n-gram is frequent. Entropies agree to single precision.

A text's language is the one of lowest cross-entropy per character. The score is a softmax over the languages of
-entropy * sqrt(characters) * b, and b is fitted on at most `calibration_rows` learning texts, which also give, for each
language, the entropy above which a text is rejected (column accepted) as none of them.

Defined results: a null text and one without letters is `und` with score 0, not accepted; with nothing to learn from,
everything is; ties go to the first language in order; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.plans.shared import materialize

_WORDS = re.compile(r"[^\W\d_]+")  # letters, and numbers such as ½ or ²
UNDETERMINED = "und"
#: Words counted together before they are taken apart.
_HELD = 300_000
#: Characters of text scored at once.
_SLICE = 4_000_000
_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, entropy double, accepted boolean"


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L), in lower case."""
    out = []
    for w in _WORDS.findall(text.lower()):
        if w.isalpha():
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram codes of the words one after another, and how many each word has."""
    start = "\x01" * (order - 1)
    units = np.frombuffer("".join([start + w + "\x02" for w in words]).encode("utf-16-le", "replace"), "<u2").astype(np.uint64)
    codes = np.zeros(len(units) - order + 1, np.uint64)
    for j in range(order):
        codes = (codes << np.uint64(16)) | units[j : len(units) - order + 1 + j]
    ends = units[order - 1 :]
    whole = ends != 1
    codes = codes[whole]
    closed = np.flatnonzero(ends[whole] == 2)
    return codes, np.diff(np.r_[-1, closed])


def _counted(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, words in held.items():
            codes, n = grams(list(words), order)
            keys, where = np.unique(codes, return_inverse=True)
            counts = np.bincount(where, np.repeat(np.fromiter(words.values(), np.float64, len(words)), n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])
        held.clear()

    for b in batches:
        for text, lang in zip(b.column(0), b.column(1).to_pylist()):
            held[lang].update(words_of(text.as_py()))
            if sum(map(len, held.values())) > _HELD:
                yield from flush()
    held = defaultdict(Counter, {k: v for k, v in held.items() if v})
    if held:
        yield from flush()


class Model:
    """languages; for each order from the highest: n-grams, their log probabilities, contexts, their log weights."""

    def __init__(self, languages: list[str], order: int, tables: list[tuple], floor: np.ndarray):
        self.languages, self.order, self.tables, self.floor = languages, order, tables, floor
        self.beta, self.limits = 1.0, np.full(len(languages), np.inf)

    def state(self) -> tuple:
        """What a broadcast holds: plain values, which workers read without this package."""
        return self.languages, self.order, self.tables, self.floor, self.beta, self.limits

    @classmethod
    def of(cls, state: tuple) -> Model:
        model = cls(*state[:4])
        model.beta, model.limits = state[4:]
        return model

    @staticmethod
    def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        return at, keys[at] == wanted

    def log_probs(self, codes: np.ndarray, level: int = 0) -> np.ndarray:
        if level == len(self.tables):
            return np.broadcast_to(self.floor, (len(codes), len(self.languages)))
        keys, logs, contexts, weights = self.tables[level]
        at, seen = self._find(keys, codes)
        out = logs[at]
        miss = np.flatnonzero(~seen)
        if len(miss):
            lost = codes[miss]
            at, known = self._find(contexts, lost >> np.uint64(16))
            order = self.order - level
            mask = np.uint64((1 << (16 * (order - 1))) - 1)
            out[miss] = np.where(known[:, None], weights[at], 0) + self.log_probs(lost & mask, level + 1)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy for each text and language, and the characters scored (0: no letters)."""
        found = [words_of(t) if t else [] for t in texts]
        n = np.array([len(f) for f in found], np.int64)
        total = np.zeros((len(texts), len(self.languages)))
        chars = np.zeros(len(texts), np.int64)
        if n.sum():
            coded = pa.array([w for f in found for w in f], pa.string()).dictionary_encode()
            codes, count = grams(coded.dictionary.to_pylist(), self.order)
            unique, where = np.unique(codes, return_inverse=True)
            logs = self.log_probs(unique)[where]
            begin = np.cumsum(count) - count
            by_word = np.add.reduceat(logs, begin, axis=0)
            word = coded.indices.to_numpy()
            some = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[some]
            total[some] = np.add.reduceat(by_word[word], first, axis=0)
            chars[some] = np.add.reduceat(count[word], first)
        return -total / np.maximum(chars, 1)[:, None], chars

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        return self.decide(*self.entropies(texts))

    def decide(self, h: np.ndarray, chars: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        best = h.argmin(1)
        z = -h * np.sqrt(chars)[:, None] * self.beta
        p = np.exp(z - z.max(1, keepdims=True))
        score = np.where(chars > 0, p.max(1) / p.sum(1), 0.0)
        lowest = h[np.arange(len(h)), best]
        ok = (chars > 0) & (lowest <= self.limits[best])
        return [self.languages[i] if c else UNDETERMINED for i, c in zip(best, chars)], score, np.where(chars > 0, lowest, np.nan), ok

    def calibrate_on(self, sample, tail: float = 0.999) -> None:
        """`sample`: lang, h (an entropy for each language) and chars of learning texts."""
        sample = sample[sample["chars"] > 0]
        if not len(sample):
            return
        h, chars = np.array(sample["h"].tolist()), sample["chars"].to_numpy(np.float64)
        truth = np.array([self.languages.index(x) for x in sample["lang"]])

        def loss(beta: float) -> float:
            z = -h * np.sqrt(chars)[:, None] * beta
            z = z - z.max(1, keepdims=True)
            return round(float((np.log(np.exp(z).sum(1)) - z[np.arange(len(z)), truth]).mean()), 9)

        self.beta = min(np.geomspace(0.05, 50, 40).tolist(), key=loss)
        own = h[np.arange(len(h)), truth]
        for i in range(len(self.languages)):
            mine = np.sort(own[truth == i])
            if len(mine):
                self.limits[i] = 1.25 * mine[min(len(mine) - 1, int(tail * len(mine)))]


def kneser_ney(languages: list[str], order: int, counts: list[list[tuple[np.ndarray, np.ndarray]]]) -> Model:
    """counts[k][l]: sorted n-grams of order `order - k` and their counts in language l."""

    class Level:
        def __init__(self, keys: np.ndarray, n: np.ndarray):
            self.keys, self.n = keys, n.astype(np.float64)
            ones, twos = (n == 1).sum(), (n == 2).sum()
            self.discount = float(np.clip(ones / max(1.0, ones + 2.0 * twos), 0.1, 0.95))
            self.contexts, self.at = np.unique(keys >> np.uint64(16), return_inverse=True)
            self.sum = np.bincount(self.at, self.n)
            self.weight = self.discount * np.bincount(self.at) / self.sum

    by_language = [[Level(*counts[k][i]) for k in range(order)] for i in range(len(languages))]
    symbols = len(np.unique(np.concatenate([k for k, _ in counts[-1]]))) + 1

    def prob(levels: list, codes: np.ndarray, k: int) -> np.ndarray:
        if k == order:
            return np.full(len(codes), 1.0 / symbols)
        v = levels[k]
        at, seen = Model._find(v.keys, codes)
        ctx, known = Model._find(v.contexts, codes >> np.uint64(16))
        own = np.where(seen, np.maximum(v.n[at] - v.discount, 0) / v.sum[ctx], 0.0)
        mask = np.uint64((1 << (16 * (order - k - 1))) - 1)
        return own + np.where(known, v.weight[ctx], 1.0) * prob(levels, codes & mask, k + 1)

    tables = []
    for k in range(order):
        keys = np.unique(np.concatenate([c[0] for c in counts[k]]))
        contexts = np.unique(keys >> np.uint64(16))
        logs = np.stack([np.log(prob(v, keys, k)) for v in by_language], 1)
        weights = []
        for v in by_language:
            at, known = Model._find(v[k].contexts, contexts)
            weights.append(np.log(np.where(known, v[k].weight[at], 1.0)))
        tables.append((keys, logs.astype(np.float32), contexts, np.stack(weights, 1).astype(np.float32)))
    return Model(languages, order, tables, np.full(len(languages), -np.log(symbols), np.float32))


def count_grams(learn: DataFrame, order: int) -> dict[int, DataFrame]:
    """Tables lang, gram, n by order: frequencies at the highest, distinct left neighbours below."""
    counted = learn.select("text", "lang").mapInArrow(partial(_counted, order=order), "lang string, gram long, n long")
    seen = {order: materialize(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")}
    for m in range(order - 1, 0, -1):
        code = F.col("gram").bitwiseAND(F.lit((1 << (16 * m)) - 1))
        seen[m] = materialize(seen[m + 1].groupBy("lang", code.alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"order{m}")
    return seen


def model_cells(seen: dict[int, DataFrame]) -> int:
    """Cells of the arrays of `kneser_ney`: a row for each n-gram and context of each order, a column for each language."""
    rows = 0
    for table in seen.values():
        grams = table.select("gram").distinct()
        rows += grams.count() + grams.select(F.shiftrightunsigned("gram", 16)).distinct().count()
    return rows * seen[1].select("lang").distinct().count()


def _calibration(learn: DataFrame, rows: int) -> DataFrame:
    sample = learn.orderBy(F.xxhash64(F.lit("calibration"), "doc_id"), "doc_id").select("doc_id", "lang").limit(rows)
    return F.broadcast(materialize(sample.select("doc_id").distinct(), "calibration"))


def train(learn: DataFrame, seen: dict[int, DataFrame], *, calibration_rows: int = 4000) -> Model | None:
    """`learn`: doc_id, text, lang, neither of the last two null; `seen`: its n-grams. None if there is nothing to learn from."""
    order = max(seen)
    frames = [seen[m].toPandas() for m in range(order, 0, -1)]
    languages = sorted(set(frames[0]["lang"]))
    if not languages:
        return None
    counts = []
    for f in frames:
        f = f.assign(gram=f["gram"].to_numpy(np.int64).view(np.uint64)).sort_values(["lang", "gram"])
        parts = dict(iter(f.groupby("lang")))
        counts.append([(parts[x]["gram"].to_numpy(np.uint64), parts[x]["n"].to_numpy(np.int64)) for x in languages])
    model = kneser_ney(languages, order, counts)
    rows = learn.join(_calibration(learn, calibration_rows), "doc_id")
    h = rows.select("text", "lang").mapInArrow(partial(_entropy_rows, model=learn.sparkSession.sparkContext.broadcast(model.state())), "lang string, h array<double>, chars long").toPandas()
    model.calibrate_on(h)
    return model


def gram_logs(asked: DataFrame, seen: dict[int, DataFrame], languages: list[str]) -> DataFrame:
    """gram, logs (a log probability for each language) for each n-gram of `asked`, as `kneser_ney` defines them."""
    order = max(seen)
    symbols = seen[1].select("gram").distinct().count() + 1

    def suffix(m: int) -> Column:
        return F.col("gram").bitwiseAND(F.lit((1 << (16 * m)) - 1))

    def by_language(value: str, missing: float) -> Column:
        return F.array(*[F.coalesce(F.max(F.when(F.col("lang") == x, F.col(value))), F.lit(missing)) for x in languages])

    wanted = {order: asked.select("gram")}
    for m in range(order - 1, 0, -1):
        wanted[m] = materialize(wanted[m + 1].select(suffix(m).alias("gram")).distinct(), f"wanted{m}")
    lower = None
    for m in range(1, order + 1):
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        found = {r["lang"]: float(np.clip(r["ones"] / max(1.0, r["ones"] + 2.0 * r["twos"]), 0.1, 0.95)) for r in seen[m].groupBy("lang").agg(ones.alias("ones"), twos.alias("twos")).collect()}
        discount = F.element_at(F.create_map(*[F.lit(v) for pair in found.items() for v in pair]), F.col("lang"))
        level = seen[m].withColumn("context", F.shiftrightunsigned("gram", 16)).withColumn("d", discount)
        contexts = materialize(level.groupBy("lang", "context", "d").agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("c")), "contexts")
        own = level.join(contexts.drop("d", "c"), ["lang", "context"]).withColumn("own", F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("s"))
        own = own.groupBy("gram").agg(by_language("own", 0.0).alias("own"))
        weights = contexts.withColumn("weight", F.col("d") * F.col("c") / F.col("s")).groupBy("context").agg(by_language("weight", 1.0).alias("weight"))
        rows = wanted[m].withColumn("context", F.shiftrightunsigned("gram", 16)).join(own, "gram", "left").join(weights, "context", "left")
        if lower is None:
            rows = rows.withColumn("below", F.array_repeat(F.lit(1.0 / symbols), len(languages)))
        else:
            rows = rows.withColumn("suffix", suffix(m - 1)).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        kept = F.coalesce("own", F.array_repeat(F.lit(0.0), len(languages)))
        passed = F.coalesce("weight", F.array_repeat(F.lit(1.0), len(languages)))
        p = F.zip_with(kept, F.zip_with(passed, "below", lambda w, b: w * b), lambda o, b: o + b)
        lower = materialize(rows.select("gram", p.alias("p")), f"p{m}")
    return lower.select("gram", F.transform("p", lambda x: F.log(x)).alias("logs"))


def _parts(batches: Iterator[pa.RecordBatch], order: int, frequent) -> Iterator[pa.RecordBatch]:
    """Sums over the frequent n-grams of each text, and the other n-grams with their counts."""
    keys, logs = frequent.value
    for b in batches:
        chars, sums, rare = [], [], []
        for text in b.column(b.num_columns - 1):
            words = words_of(text.as_py() or "")
            codes, n = np.unique(grams(words, order)[0], return_counts=True) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            at, known = Model._find(keys, codes) if len(keys) else (np.zeros(len(codes), np.int64), np.zeros(len(codes), bool))
            chars.append(int(n.sum()))
            sums.append(n[known] @ logs[at[known]])
            rare.append([{"gram": g, "n": c} for g, c in zip(codes[~known].view(np.int64).tolist(), n[~known].tolist())])
        columns = [pa.array(chars, pa.int64()), pa.array([x.tolist() for x in sums], pa.list_(pa.float64())), pa.array(rare, pa.list_(pa.struct([("gram", pa.int64()), ("n", pa.int64())])))]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[*b.schema.names[:-1], "chars", "sums", "rare"])


def _decided(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    known = Model.of(model.value)
    names = ["doc_id", "held_out", "lang_pred", "score", "entropy", "accepted"]
    for b in batches:
        if b.num_rows:
            pred, score, h, ok = known.decide(np.array(b.column(2).to_pylist()), b.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(h, pa.float64(), from_pandas=True), pa.array(ok, pa.bool_())], names=names)


def _by_joins(base: DataFrame, learn: DataFrame, seen: dict[int, DataFrame], max_grams: int, calibration_rows: int) -> DataFrame:
    """What `identify` returns, with a model of any size."""
    spark, order = base.sparkSession, max(seen)
    languages = sorted(r["lang"] for r in seen[1].select("lang").distinct().collect())
    texts = base.where("text IS NOT NULL").select("text", F.lit("").alias("lang"))
    asked = texts.mapInArrow(partial(_counted, order=order), "lang string, gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    asked = materialize(asked, "asked")
    logs = materialize(gram_logs(asked, seen, languages).join(asked, "gram"), "logs")
    often = logs.where(F.col("n") * F.lit(max(1, max_grams // len(languages))) >= F.lit(asked.agg(F.sum("n")).first()[0]))
    held = often.select("gram", *[F.col("logs")[i].alias(f"l{i}") for i in range(len(languages))]).toPandas()
    keys = held.pop("gram").to_numpy(np.int64).view(np.uint64)
    at = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[at], held.to_numpy(np.float64)[at]))
    rows = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "lang", "text")
    schema = f"row long, doc_id {base.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang string, chars long, sums array<double>, rare array<struct<gram:long,n:long>>"
    rows = materialize(rows.mapInArrow(partial(_parts, order=order, frequent=frequent), schema), "parts")
    rest = rows.select("row", F.inline("rare")).join(logs.select("gram", "logs"), "gram")
    rest = rest.groupBy("row").agg(*[F.sum(F.col("n") * F.col("logs")[i]).alias(f"s{i}") for i in range(len(languages))])
    h = F.array(*[-(F.col("sums")[i] + F.coalesce(f"s{i}", F.lit(0.0))) / F.greatest("chars", F.lit(1)) for i in range(len(languages))])
    entropies = materialize(rows.drop("rare").join(rest, "row", "left").select("doc_id", "held_out", "lang", "chars", h.alias("h")), "entropies")
    model = Model(languages, order, [], np.zeros(len(languages), np.float32))
    sample = entropies.where("NOT held_out AND lang IS NOT NULL").join(_calibration(learn, calibration_rows), "doc_id")
    model.calibrate_on(sample.select("lang", "h", "chars").toPandas())
    rows = entropies.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "h", "chars")
    return rows.mapInArrow(partial(_decided, model=spark.sparkContext.broadcast(model.state())), _SCHEMA)


def _entropy_rows(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    known = Model.of(model.value)
    for b in batches:
        h, chars = known.entropies(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(h.tolist(), pa.list_(pa.float64())), pa.array(chars)], names=["lang", "h", "chars"])


def _predicted(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    known = Model.of(model.value)
    names = ["doc_id", "held_out", "lang_pred", "score", "entropy", "accepted"]
    for b in batches:
        texts = b.column(2).to_pylist()
        pred, score, h, ok, at = [], [], [], [], 0
        while at < len(texts):
            n, stop = 0, at
            while stop < len(texts) and (stop == at or n < _SLICE):
                n += len(texts[stop] or "")
                stop += 1
            for column, values in zip((pred, score, h, ok), known.predict(texts[at:stop])):
                column.extend(values)
            at = stop
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(h, pa.float64(), from_pandas=True), pa.array(ok, pa.bool_())], names=names)


def identify(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4, max_grams: int = 4_000_000, max_cells: int = 16_000_000, calibration_rows: int = 4000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, accepted for each row; learns from rows not held out."""
    if not 1 <= order <= 4:
        raise ValueError("a code holds 1 to 4 units")
    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out(F.col(id_col)).alias("held_out"))
    learn = base.where("NOT held_out AND text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    seen = count_grams(learn, order)
    if seen[order].count() > max_grams or model_cells(seen) > max_cells:
        return _by_joins(base, learn, seen, max_grams, calibration_rows)
    model = train(learn, seen, calibration_rows=calibration_rows)
    rows = base.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    if model is None:
        return rows.selectExpr("doc_id", "held_out", f"'{UNDETERMINED}' AS lang_pred", "0D AS score", "CAST(NULL AS DOUBLE) AS entropy", "false AS accepted")
    return rows.mapInArrow(partial(_predicted, model=df.sparkSession.sparkContext.broadcast(model.state())), _SCHEMA)
