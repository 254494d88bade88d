"""Text tables of any header, records from any source, statistics tables, user-defined aggregates and table functions."""

import gzip
import math

import pytest
from pyspark.sql import functions as F

from paneloom.functions import strings
from paneloom.operators import relational, stats, userdefined
from paneloom.sources import records, sinks, text_table
from paneloom.streaming import moments


def test_a_header_of_100_lines_and_comments_in_the_data(spark, tmp_path):
    path = tmp_path / "t.txt"
    path.write_text("".join(f"#note {i}\n" for i in range(99)) + "#fields a b\n" + "#types long string\n" + "1 x\n#fields c d e\n#note\n2 y\n")
    df = text_table.read_text_table(spark, str(path))
    assert df.dtypes == [("a", "bigint"), ("b", "string")]
    assert sorted(map(tuple, df.collect())) == [(1, "x"), (2, "y")]


def test_a_table_of_several_splits_and_files(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    lines = [f"{i} {'v' * (i % 50)}z" for i in range(3000)]
    (folder / "a.txt").write_text("#fields k v\n#types long string\n" + "\n".join(lines[:2000]) + "\n")
    (folder / "b.txt").write_text("#note not a header\n" + "\n".join(lines[2000:]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    try:
        df = text_table.read_text_table(spark, str(folder))
        assert df.select(F.spark_partition_id()).distinct().count() > 5
        assert sorted(map(tuple, df.collect())) == [(int(x.split()[0]), x.split()[1]) for x in lines]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_compressed_file_beside_a_missing_one(spark, tmp_path):
    with gzip.open(tmp_path / "t.txt.gz", "wt") as f:
        f.write("#fields a\n#types long\n7\n")
    assert text_table.read_text_table(spark, str(tmp_path / "t.txt")).collect()[0]["a"] == 7
    with pytest.raises(FileNotFoundError):
        text_table.read_text_table(spark, str(tmp_path / "none.txt"))
    assert records.records(spark, str(tmp_path / "none.txt")) is None
    with pytest.raises(ValueError):
        records.records(spark, str(tmp_path / "none.txt"), none_ok=False)
    (tmp_path / "bare.txt").write_text("1 2\n")
    with pytest.raises(ValueError):
        text_table.read_text_table(spark, str(tmp_path / "bare.txt"))
    (tmp_path / "sep.txt").write_text("#separator |\n#fields a b\n#types string long\nx y|3\n")
    assert tuple(text_table.read_text_table(spark, str(tmp_path / "sep.txt")).first()) == ("x y", 3)


SPEC = [("k", "string"), ("n", "long"), ("x", "double", "%8.2f", -1.0)]


def test_records_of_a_shape(spark):
    got = records.records(spark, None, SPEC, shape=(2, 3), add_spec=[("flag", "bool")])
    assert got.table.count() == 6 and sorted(r["pos"] for r in got.table.collect()) == list(range(6))
    assert tuple(got.rows.first()) == ("", 0, -1.0, False)
    assert got.empty_record() == {"k": "", "n": 0, "x": -1.0, "flag": False}
    with pytest.raises(ValueError):
        records.records(spark, None, SPEC)


def test_records_of_rows(spark):
    given = [("b", 2, 1.5), None, ("a", 1, None), ("b", 3, 2.5)]
    got = records.records(spark, given, SPEC, process_nones=True, index="k", sort=["k", "n"])
    assert [tuple(r) for r in got.table.orderBy("pos").select("k", "n", "x").collect()] == [("", 0, -1.0), ("a", 1, -1.0), ("b", 2, 1.5), ("b", 3, 2.5)]
    assert got.identifier == "k" and got.index == ("k",)
    assert {r["k"]: r["pos"] for r in got.index_table().collect()} == {"": 0, "a": 1, "b": 3}
    wanted = spark.createDataFrame([("b",), ("zz",)], "k string")
    assert {r["k"]: r["n"] for r in got.get(wanted, "n").collect()} == {"b": 3, "zz": 0}
    assert {r["k"]: r["x"] for r in got.get(wanted, "x", 9.0).collect()} == {"b": 2.5, "zz": 9.0}
    down = records.records(spark, given, SPEC, process_nones=True, identifier="n", sort="n", reverse=True)
    assert [r["n"] for r in down.table.orderBy("pos").collect()] == [3, 2, 1, 0] and down.identifier == "n"
    with pytest.raises(ValueError):
        records.records(spark, given, SPEC)
    with pytest.raises(ValueError):
        down.index_table()
    filled = records.records(spark, [{"k": "a", "x": None}, {"k": "b", "x": 4.0}], SPEC, default_missing=True)
    assert [r["x"] for r in filled.table.orderBy("pos").collect()] == [-1.0, 4.0]


def test_records_of_a_table_by_two_fields(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 1, 30.0), (None, 1, 40.0)], "k string, n long, x double")
    got = records.records(spark, df.coalesce(1), index=["k", "n"])
    wanted = spark.createDataFrame([("a", 1), (None, 1), ("b", 1)], "k string, n long")
    found = {(r["k"], r["n"]): r["x"] for r in got.get(wanted, "x").collect()}
    assert found["a", 1] == 30.0 and found[None, 1] == 40.0 and math.isnan(found["b", 1])


def test_arguments(spark):
    assert strings.args2listdict(["a,b", "3", "k=1,2"]) == ([["a", "b"], 3], {"k": [1, 2]})
    assert strings.args2listdict("a,b", preserve_commas=True) == (["a,b"], {})
    assert strings.args2dict(["l=rows=90", "l=cols=2.5", "s=a,b"], preserve_commas=True) == {"l": {"rows": 90, "cols": 2.5}, "s": "a,b"}
    assert strings.args2dict("k=None") == {"k": None}


def test_statistics_tables(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "label string, x double")
    full = stats.full_summary(df, "x", by=["label"]).withColumn("zeta", F.lit(1))
    assert sinks.statistics_table(full).columns == ["label", "count", "d_count", "mean_wt", "mean", "std_dev", "t_stat", "median", "mad", "min", "max"]
    some = sinks.statistics_table(full, include=["std_err", "zeta"], exclude=["mad"])
    assert some.columns == ["label", "count", "d_count", "mean_wt", "mean", "std_dev", "t_stat", "median", "std_err", "min", "max", "zeta"]
    every = sinks.statistics_table(full, all=True).columns
    assert every[:12] == ["label", "size", "count", "d_count", "mean_wt", "sum", "mean", "std_dev", "t_stat", "median", "mad", "p25"] and set(every) == set(full.columns)
    assert sinks.header(sinks.statistics_table(full)).split("\n")[2] == "#formats %s %7d %8.1f %7.3f %8.4f %8.4f %7.3f %8.4f %8.4f %8.3f %8.3f"


def test_the_first_of_each_key_by_partial_minima(spark):
    df = spark.createDataFrame([(i, i % 3, float(i * 7 % 10), "v") for i in range(50)], "i long, k long, x double, s string").repartition(4)
    for sort, reverse in ((None, False), (None, True), ("x", False), ("x", True)):
        got = relational.output(df, order=[F.col("i")], sort=sort, reverse=reverse, unique=["k"])
        rows = [(i, i % 3, float(i * 7 % 10)) for i in range(50)]
        rows.sort(key=lambda r: (r[2] if sort else 0, r[0]), reverse=reverse)
        first = list({r[1]: r for r in reversed(rows)}.values())
        assert sorted(r["i"] for r in got.collect()) == sorted(r[0] for r in first)
    plan = relational.unique_first(df, ["k"], [F.col("x"), F.col("i")])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min_by" in plan


LONGEST = userdefined.Aggregate(lambda: ("", 0), lambda s, r: (max(s[0], r["s"] or "", key=lambda x: (len(x), x)), s[1] + 1), lambda a, b: (max(a[0], b[0], key=lambda x: (len(x), x)), a[1] + b[1]), lambda s: {"longest": s[0], "rows": s[1]})


@pytest.mark.parametrize("options", [{}, {"parts": 1}, {"held_groups": 1}])
def test_aggregates_of_own_state(spark, options):
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"k{i % 5}", "ab" * (i % 13) + str(i) if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, s string").repartition(9)
    got = {r["k"]: (r["longest"], r["rows"]) for r in userdefined.aggregate(df, ["k"], ["s"], LONGEST, "longest string, rows long", **options).collect()}
    want = {}
    for k, s in rows:
        longest, n = want.get(k, ("", 0))
        want[k] = (max(longest, s or "", key=lambda x: (len(x), x)), n + 1)
    assert got == want
    whole = userdefined.aggregate(df, [], ["s"], LONGEST, "longest string, rows long", **options).collect()
    assert [tuple(r) for r in whole] == [(max((s or "" for _, s in rows), key=lambda x: (len(x), x)), 400)]
    assert [tuple(r) for r in userdefined.aggregate(df.where("false"), [], ["s"], LONGEST, "longest string, rows long").collect()] == [("", 0)]
    assert userdefined.aggregate(df.where("false"), ["k"], ["s"], LONGEST, "longest string, rows long").count() == 0


def test_states_are_shuffled_and_not_rows(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").cast("string").alias("s")).repartition(4)
    seen = spark.sparkContext.accumulator(0)

    def merge(a, b, seen=seen):
        seen.add(1)
        return LONGEST.merge(a, b)

    counted = userdefined.Aggregate(LONGEST.zero, LONGEST.step, merge, LONGEST.end)
    assert userdefined.aggregate(df, ["k"], ["s"], counted, "longest string, rows long").first()["rows"] == 20_000
    assert seen.value <= 4


def test_table_functions_take_parts(spark):
    class Gaps:
        def __init__(self):
            self.last = None

        def eval(self, row):
            if self.last is not None and row["t"] - self.last > 1:
                yield row["k"], self.last, row["t"]
            self.last = row["t"]

    gaps = userdefined.table_function(Gaps, "k string, after long, before long")
    df = spark.createDataFrame([(k, t) for k in "ab" for t in (1, 2, 5, 6, 9) if (k, t) != ("b", 5)], "k string, t long").repartition(3)
    assert sorted(map(tuple, gaps(df, ["k"], ["t"]).collect())) == [("a", 2, 5), ("a", 6, 9), ("b", 2, 6), ("b", 6, 9)]
    with pytest.raises(ValueError):
        gaps(df, [])


def test_a_stream_of_three_weighted_predictors_equals_the_batch(spark, tmp_path):
    from paneloom.operators.sweep import Fit, sweep

    rows = [(f"k{i % 2}", 1e8 + i % 17, float(i % 5), math.sin(i), 3.0 * (i % 17) - (i % 5) + math.cos(i), float(i % 4)) for i in range(200)]
    schema = "k string, a double, b double, c double, y double, w double"
    for part in range(4):
        spark.createDataFrame(rows[part::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    fits = [Fit("y", "y", ("a", "b", "c"))]
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["k"]: r for r in moments.grow_regression(stream, fits, "w", ["k"]).collect()}
    want = {r["k"]: r for r in sweep(spark.createDataFrame(rows, schema), fits, "w", by=["k"]).collect()}
    assert set(got) == set(want) == {"k0", "k1"}
    for k, r in want.items():
        assert got[k]["coefficients"][1:] == pytest.approx(r["coefficients"][1:], rel=1e-6)
        assert (got[k]["size"], got[k]["count"]) == (r["size"], r["count"]) and got[k]["d_count"] == pytest.approx(r["d_count"])


def test_a_batch_given_again_counts_once(spark):
    versions = moments._Versions(spark, "regression_again")
    one, two = spark.range(1), spark.range(2)
    assert versions.before(0) is None
    versions.put(0, one)
    versions.put(1, two)
    versions.put(1, one)
    assert versions.before(1).count() == 1 and versions.before(2).count() == 1
    for n in range(2, 6):
        versions.put(n, two)
    assert versions.before(6).count() == 2 and versions.before(2) is None


def test_sketches_on_a_stream(spark, tmp_path):
    spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("x")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    held = moments.run_to_end(moments.quantile_sketches(stream, "x", k=400))
    got = moments.sketched_quantiles(held, [0.1, 0.5, 0.9]).first()
    assert got["count"] == 20_000
    assert all(abs(x / 20_000 - q) < 0.02 for x, q in zip(got["quantiles"], [0.1, 0.5, 0.9], strict=True))
