"""Text tables, sinks, stores, strings on the driver, calendars, series and streams."""

import gzip
import pickle
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from paneloom.functions import dates, strings
from paneloom.operators import joins, sets, spatial, windows
from paneloom.operators.calendar import Calendar, calendar_from
from paneloom.sources import sinks, text_table
from paneloom.streaming import moments

TABLE = """#fields symbol average_volume liquidity days min_close min_volume
#types string(14) double double long double double
#formats %-14s %9.0f %8.2f %3d %9.4f %9.0f
AA+ 1190 .08 31 56.0 100
ABL 6415 .09 48 12.875 200
XX #NA .10 5 1.0 1
"""


@pytest.fixture
def path(tmp_path):
    p = tmp_path / "t.txt"
    p.write_text(TABLE)
    return p


def test_text_table(spark, path, tmp_path):
    df = text_table.read_text_table(spark, str(path))
    assert df.dtypes[0] == ("symbol", "string") and df.dtypes[3] == ("days", "bigint")
    assert [tuple(r) for r in df.collect()][:2] == [("AA+", 1190.0, 0.08, 31, 56.0, 100.0), ("ABL", 6415.0, 0.09, 48, 12.875, 200.0)]
    assert df.collect()[2]["average_volume"] is None
    picked = text_table.read_text_table(spark, str(path), match_pattern="^A", select_fields=["symbol", "days"], select_field_values={"symbol": ["ABL"]})
    assert [tuple(r) for r in picked.collect()] == [("ABL", 48)]
    packed = tmp_path / "t.txt.gz"
    packed.write_bytes(gzip.compress(TABLE.encode()))
    assert text_table.read_text_table(spark, str(packed), skip_fields=["days"], sort=["liquidity"], reverse=True).first()["symbol"] == "XX"
    with pytest.raises(ValueError):
        text_table.read_text_table(spark, str(path), select_fields=["a"], skip_fields=["b"])
    with pytest.raises(ValueError):
        text_table.read_header(["#fields a b", "#types double"])


def test_header_round_trip(spark, path, tmp_path):
    df = text_table.read_text_table(spark, str(path))
    assert sinks.header(df).split("\n") == TABLE.replace("string(14)", "string").split("\n")[:3]
    sinks.write_text_table(df.coalesce(1), str(tmp_path / "out"), compress=True)
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[:3] == sinks.header(df).split("\n")
    assert lines[3].split() == ["AA+", "1190", "0.08", "31", "56.0000", "100"] and "#NA" in lines[5]
    with pytest.raises(ValueError):
        sinks.write_text_table(df, str(tmp_path / "x"), append=True, compress=True)


def test_rows_and_defaults(spark):
    df = text_table.from_rows(spark, [{"a": 1}, {"b": "x"}], [("a", "long"), ("b", "string", None, "none")], process_nones=True)
    assert sorted(tuple(r) for r in df.collect()) == [(0, "x"), (1, "none")]


def test_keyed_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,a\n2,b\n")
    (tmp_path / "b.csv").write_text("k,v\n1,a\n1,b\n")
    assert text_table.read_keyed_csv(spark, str(tmp_path / "a.csv"), "k").count() == 2
    with pytest.raises(KeyError):
        text_table.read_keyed_csv(spark, str(tmp_path / "a.csv"), "z")
    with pytest.raises(ValueError):
        text_table.read_keyed_csv(spark, str(tmp_path / "b.csv"), "k")


def test_arrays_and_store(spark, tmp_path):
    sinks.save_arrays(spark, [[1, 2, 3], [4, 5, 6]], str(tmp_path / "arr"), [True, False, True])
    got = sinks.load_arrays(spark, str(tmp_path / "arr"), start=1).orderBy("place").collect()
    assert [(r["array_index"], r["value"]) for r in got] == [(1, 4.0), (1, 6.0)]
    got = sinks.load_arrays(spark, str(tmp_path / "arr"), arrays=[0], select=[False, True]).collect()
    assert [(r["array_index"], r["place"], r["value"]) for r in got] == [(0, 0, 3.0)]
    base = sqlite3.connect(tmp_path / "kv.sqlite")
    for name in ("one", "t wo"):
        base.execute(f'CREATE TABLE "{name}" (key TEXT PRIMARY KEY, value BLOB)')
        base.executemany(f'INSERT INTO "{name}" VALUES (?, ?)', [("a", pickle.dumps("x")), ("b", "plain"), ("c", pickle.dumps(7)), ("d", None)])
    base.execute("CREATE TABLE other (n INT)")
    base.commit()
    base.close()
    rows = sinks.read_sqlite_store(spark, str(tmp_path / "kv.sqlite"))
    assert {r["tbl"] for r in rows.collect()} == {"one", "t wo"}
    assert {r["key"]: r["value"] for r in sinks.read_sqlite_store(spark, str(tmp_path / "kv.sqlite"), "t wo").collect()} == {"a": "x", "b": "plain", "c": "7", "d": None}
    kv = spark.createDataFrame([("t", "a", "1"), ("u", "a", "2")], "tbl string, key string, value string")
    sinks.write_store(kv, str(tmp_path / "kv"))
    assert sets.invert(sinks.read_store(spark, str(tmp_path / "kv"))).first()["tbl"] == "u"


def test_strings_on_the_driver(spark):
    assert strings.args2dict(["mode=fast", "depth=7", "share=0.25", "limit=rows=90", "l=a,1"]) == {"mode": "fast", "depth": 7, "share": 0.25, "limit": {"rows": 90}, "l": ["a", 1]}
    assert strings.args2listdict(["x", "k=1"]) == (["x"], {"k": 1})
    assert strings.lines2dict(["{'a':", " [1, 2]}"]) == {"a": [1, 2]}
    with pytest.raises(ValueError):
        strings.lines2dict(["__import__('os')"])
    assert strings.fmt_length("<%8.2fkg>") == 12 and strings.fmt_length("%s") is None
    assert strings.fmt_matrix([[1.0]], "%4.1f", ["a"]) == "a  1.0"
    df = spark.createDataFrame([("Ærø Café_Zürich--x",)], "s string")
    assert df.select(strings.slugify_any("s")).first()[0] == "r-cafe-zurich-x"


def test_dates(spark):
    df = spark.createDataFrame([("20020930", "1/Jan/2023"), ("", "2/Jan/2023:10:00")], "d string, l string")
    got = df.select(dates.decimalize("d"), dates.days_since("l", "1/Jan/2023"), dates.dt("d", "weekday")).collect()
    assert got[0][0] == pytest.approx(2002.747311827957) and got[1][0] is None
    assert [r[1] for r in got] == [0, 1] and got[0][2] == 0


def test_calendar_of_strings(spark):
    days = spark.createDataFrame([("20240102", "x"), ("20240103", "holiday"), ("20240104", "x"), ("20240401", "x")], "d string, t string")
    cal = Calendar(calendar_from(days, "d", "t", skip_tag="holiday"))
    probes = spark.createDataFrame([("20240103",), ("20240102",), ("20231231",), ("20250101",)], "p string")
    got = {r["p"]: (r["n"], r["b"], r["q"]) for r in cal.next_quarter(cal.previous_date(cal.next_valid(probes, "p", "n"), "p", "b"), "p", "q").collect()}
    assert got["20240103"] == ("20240104", "20240102", "20240401")
    assert got["20240102"] == ("20240102", None, "20240401")
    assert got["20231231"] == ("20240102", None, "20240104")
    assert got["20250101"] == (None, "20240401", None)


def test_rolling_windows(spark):
    df = spark.range(10).select((F.col("id") % 5).alias("pos"), F.floor(F.col("id") / 5).alias("r"), F.col("id").cast("double").alias("v"))
    got = windows.in_windows(df, "pos", 5, 3).groupBy("r", "window").agg(F.avg("v")).orderBy("r", "window").collect()
    assert [r[2] for r in got] == [1.0, 2.0, 3.0, 6.0, 7.0, 8.0]
    assert windows.size_offset(100, 0.1, 2) == (10, 5)
    for n in range(1, 30):
        for size in range(2, n + 1):
            grown, every = windows.size_offset(n, size, 2, True)
            assert every == max(1, round(size / 2)) and size <= grown <= n and (grown == n or (n - grown) % every == 0) and grown < size + every
    with pytest.raises(ValueError):
        windows.in_windows(df, "pos", 5, 0)


def test_asof_ties_and_edges(spark):
    left = spark.createDataFrame([(5, 0), (1, 1), (9, 2)], "k long, lp long")
    right = spark.createDataFrame([(3, 0, "a"), (5, 1, "b"), (5, 2, "c"), (8, 3, "d")], "k long, rp long, v string")
    one = [df.withColumn("g", F.lit(1)) for df in (left, right)]
    for whole in (True, False):
        for got in (joins.asof_join(left, right, "k", ["v"], right_pos="rp", distributed=whole), joins.asof_join(*one, "k", ["v"], by=["g"], right_pos="rp", distributed=whole)):
            assert {r["lp"]: r["v"] for r in got.collect()} == {0: "c", 2: "d"}


def test_asof_of_a_hot_group_over_ranges(spark):
    r = random.Random(3)
    left = [(None if g == 2 else g, r.randrange(400), i) for i, g in enumerate(r.choices([0, 1, 2], [8, 1, 1], k=600))]
    right = [(None if g == 2 else g, r.randrange(400), i, f"v{i}") for i, g in enumerate(r.choices([0, 1, 2], [8, 1, 1], k=300))]
    a, b = spark.createDataFrame(left, "g int, k long, lp long").repartition(3), spark.createDataFrame(right, "g int, k long, rp long, v string").repartition(3)
    for by in (["g"], []):
        want = {}
        for g, k, i in left:
            before = [x for x in right if x[1] <= k and (not by or x[0] == g)]
            if before:
                want[i] = max(before, key=lambda x: (x[1], x[2]))[3]
        drop = [] if by else ["g"]
        for whole in (True, False):
            got = joins.asof_join(a.drop(*drop), b.drop(*drop), "k", ["v"], by=by, right_pos="rp", distributed=whole)
            assert {x["lp"]: x["v"] for x in got.collect()} == want


def test_intervals_touching(spark):
    a = spark.createDataFrame([(0, 0.0, 2.0), (1, 2.0, 3.0)], "idx int, lo double, hi double")
    b = spark.createDataFrame([(0, 1.0, 2.0), (1, 2.5, 9.0)], "idx int, lo double, hi double")
    got = sorted((r["lo"], r["hi"], r["i"], r["j"]) for r in joins.intersect_intervals(a, b).collect())
    assert got == [(1.0, 2.0, 0, 0), (2.5, 3.0, 1, 1)]


def test_density_finds_the_crowd(spark):
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"), F.when(F.col("id") < 300, F.lit(5.0)).otherwise(F.col("id") % 17).alias("y"))
    center = spatial.DensityPeaks(2, bins=20, shape=(5, 5)).fit(df, "x", "y").centers[0]
    assert abs(center[1] - 5) < 1.5


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"k{i % 3}", float(i) if i % 5 else float("nan")) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], "id long, k string, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, k string, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["k"]: r for r in moments.run_to_end(moments.incremental_moments(stream, "x", by=["k"], shift=30.0)).collect()}
    for k in got:
        x = [v for _, g, v in rows if g == k and v == v]
        mean = sum(x) / len(x)
        assert got[k]["count"] == len(x) and got[k]["mean"] == pytest.approx(mean)
        assert got[k]["variance"] == pytest.approx(sum((v - mean) ** 2 for v in x) / len(x))


def plain_centers(counts, weight, mask, k, least):
    """Each window written out cell by cell."""
    h, v = weight.shape
    taken, out = np.zeros(counts.shape, bool), []
    while True:
        best = None
        for i in range(counts.shape[0] - h + 1):
            for j in range(counts.shape[1] - v + 1):
                if out and taken[i + h // 2, j + v // 2]:
                    continue
                total = sum(weight[h - 1 - a, v - 1 - b] * counts[i + a, j + b] for a in range(h) for b in range(v) if not taken[i + a, j + b])
                if best is None or total > best[0] + 1e-9:
                    best = (total, i, j)
        if best is None:
            return out
        total, i, j = best
        new = [(i + a, j + b) for a in range(h) for b in range(v) if mask[a, b] and not taken[i + a, j + b]]
        for cell in new:
            taken[cell] = True
        out.append((i + h // 2, j + v // 2, total, float(sum(counts[c] for c in new))))
        if len(out) >= k or out[-1][3] <= least or taken.sum() >= counts.size - mask.sum():
            return out


@pytest.mark.parametrize("circular", [True, False])
@pytest.mark.parametrize("window,shape", [(("gaussian", 0.3), (0.3, 0.45)), (("gaussian", 2.0), (3, 5)), ("boxcar", (4, 3))])
def test_density_against_plain_windows(spark, window, shape, circular):
    r = np.random.default_rng(1)
    xy = np.vstack([r.normal(size=(150, 2)), r.normal(size=(80, 2)) * 0.3 + 4])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in xy] + [(None, 1.0), (float("nan"), 2.0)], "x double, y double")
    got = spatial.DensityPeaks(6, bins=14, window=window, shape=shape, circular=circular).fit(df, "x", "y")
    assert got.weight[got.mask].mean() == pytest.approx(1) and all(s % 2 for s in got.weight.shape)
    counts = np.histogram2d(xy[:, 0], xy[:, 1], bins=14)[0]
    assert (got.grid == counts).all()
    want = plain_centers(counts, got.weight, got.mask, 6, 230 * 0.0005)
    found = spatial.dense_centers(counts, got.weight, got.mask, 6, 230 * 0.0005)
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert [x for f in found for x in f[2:]] == pytest.approx([x for w in want for x in w[2:]])
    assert got.table(spark).count() == len(want)


def test_density_windows():
    weight, mask = spatial.density_window((0.1, 0.1), ("gaussian", 0.3), 100, True)
    assert weight.shape == (11, 11) and weight[0, 0] == 0 and not mask[0, 0] and mask[5, 5]
    line = np.exp(-0.5 * ((np.arange(11) - 5.5) / 3) ** 2)
    assert weight[5] / weight[5, 5] == pytest.approx(line / line[5])
    with pytest.raises(ValueError):
        spatial.density_window((3, 3), ("gaussian", 0.1), 100, True)
    with pytest.raises(ValueError):
        spatial.density_window((3, 3), "hann", 100, True)
