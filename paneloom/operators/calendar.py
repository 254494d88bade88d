"""A calendar of valid dates ('YYYYMMDD' strings or DATE), small enough to broadcast, and moves along it.

Every move is an as-of lookup of the date's place, then arithmetic on places and an equality join back. The calendar is a
sorted array on the workers (a calendar of a century of days is 300 KB), so lookups need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days that a broadcast calendar may have.
MAX_DAYS = 200_000


def calendar_from(df: DataFrame, date: str, tag: str | None = None, *, start=None, finish=None, select_tag: str | None = None, skip_tag: str | None = None) -> DataFrame:
    """cal_date, ordinal: distinct dates inside [start, finish] whose tag is wanted, in dense ascending order."""
    rows = df.where(F.col(date).isNotNull())
    if start is not None:
        rows = rows.where(F.col(date) >= F.lit(start))
    if finish is not None:
        rows = rows.where(F.col(date) <= F.lit(finish))
    if select_tag is not None:
        rows = rows.where(F.col(tag) == select_tag)
    if skip_tag is not None:
        rows = rows.where(~F.coalesce(F.col(tag) == skip_tag, F.lit(False)))
    days = rows.select(F.col(date).alias("cal_date")).distinct()
    return days.withColumn("ordinal", F.row_number().over(W.orderBy("cal_date")) - 1)


class Calendar:
    """Lookups for date columns. Built from a `calendar_from` table of at most MAX_DAYS rows (checked)."""

    def __init__(self, table: DataFrame):
        days = table.orderBy("ordinal").limit(MAX_DAYS + 1).collect()
        if len(days) > MAX_DAYS:
            raise ValueError(f"a calendar may have at most {MAX_DAYS} days")
        self.days = [r["cal_date"] for r in days]
        self.kind = table.schema["cal_date"].dataType.simpleString()
        self.spark = table.sparkSession

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(rows, schema))

    def place(self, df: DataFrame, date: str, name: str = "place") -> DataFrame:
        """Ordinal of the last valid date at or before the date; -1 before the first.

        Every date between the calendar's ends is listed with its place, so the lookup is one hash join.
        """
        import datetime as dtm

        as_date = self.kind == "date"
        read = (lambda d: d) if as_date else (lambda d: dtm.datetime.strptime(d, "%Y%m%d").date())
        show = (lambda d: d) if as_date else (lambda d: d.strftime("%Y%m%d"))
        rows, at = [], 0
        if self.days:
            days = [read(d) for d in self.days]
            d = days[0]
            while d <= days[-1]:
                while at + 1 < len(days) and days[at + 1] <= d:
                    at += 1
                rows.append((show(d), at))
                d += dtm.timedelta(days=1)
            lo, hi = F.lit(self.days[0]), F.lit(self.days[-1])
            grid = self._frame(rows, f"_day {self.kind}, _at int")
            c = F.col(date).cast(self.kind)
            place = F.when(c < lo, F.lit(-1)).when(c > hi, F.lit(len(self.days) - 1)).otherwise(F.col("_at"))
            return df.join(grid, c == F.col("_day"), "left").withColumn(name, place).drop("_day", "_at")
        return df.withColumn(name, F.lit(-1))

    def at(self, df: DataFrame, place: str, name: str) -> DataFrame:
        """The date at an ordinal; missing outside the calendar."""
        grid = self._frame([(i, d) for i, d in enumerate(self.days)], f"_at int, _day {self.kind}")
        return df.join(grid, F.col(place) == F.col("_at"), "left").withColumn(name, F.col("_day")).drop("_day", "_at")

    def _move(self, df: DataFrame, date: str, name: str, step: Column, clip_old: bool = False, clip_new: bool = False) -> DataFrame:
        to = F.col("_p") + step
        if clip_old:
            to = F.greatest(to, F.lit(0))
        if clip_new:
            to = F.least(to, F.lit(len(self.days) - 1))
        return self.at(self.place(df, date, "_p").withColumn("_p", to), "_p", name).drop("_p")

    def search(self, df: DataFrame, date: str, offset: int = 0, *, clip_old: bool = False, clip_new: bool = False, name: str = "found") -> DataFrame:
        """The valid date `offset` places on from the date's own; outside: missing, or the first or last if clipped."""
        return self._move(df, date, name, F.lit(offset), clip_old, clip_new)

    def next_date(self, df: DataFrame, date: str, name: str = "next_date") -> DataFrame:
        return self.search(df, date, 1, name=name)

    def previous_date(self, df: DataFrame, date: str, name: str = "previous_date") -> DataFrame:
        """The valid date before; of a date that is not valid, the nearest earlier one."""
        found = self.at(self.place(df, date, "_p"), "_p", "_d")
        step = F.when(F.col("_d") == F.col(date).cast(self.kind), F.lit(-1)).otherwise(F.lit(0))
        return self.at(found.withColumn("_p", F.col("_p") + step), "_p", name).drop("_p", "_d")

    def previous_valid(self, df: DataFrame, date: str, name: str = "previous_valid") -> DataFrame:
        return self.search(df, date, 0, name=name)

    def next_valid(self, df: DataFrame, date: str, name: str = "next_valid") -> DataFrame:
        found = self.at(self.place(df, date, "_p"), "_p", "_d")
        step = F.when(F.col("_d") == F.col(date).cast(self.kind), F.lit(0)).otherwise(F.lit(1))
        return self.at(found.withColumn("_p", F.col("_p") + step), "_p", name).drop("_p", "_d")

    def next_valid_close(self, df: DataFrame, date: str, time: str, name: str = "close") -> DataFrame:
        """The date if valid and the time not after 15:59:59, else the next valid one."""
        found = self.at(self.place(df, date, "_p"), "_p", "_d")
        stay = (F.col("_d") == F.col(date).cast(self.kind)) & (F.col(time) <= F.lit("15:59:59"))
        return self.at(found.withColumn("_p", F.when(stay, F.col("_p")).otherwise(F.col("_p") + 1)), "_p", name).drop("_p", "_d")

    def days_between(self, df: DataFrame, a: str, b: str, name: str = "days") -> DataFrame:
        return self.place(self.place(df, a, "_a"), b, "_b").withColumn(name, F.col("_b") - F.col("_a")).drop("_a", "_b")

    def dates_between(self, df: DataFrame, a: str, b: str, *, closed: bool = False, name: str = "cal_date") -> DataFrame:
        """A row for each valid date in [a, b), or in [a, b] if closed."""
        grid = self._frame([(d,) for d in self.days], f"_day {self.kind}")
        upper = F.col("_day") <= F.col(b).cast(self.kind) if closed else F.col("_day") < F.col(b).cast(self.kind)
        return df.join(grid, (F.col("_day") >= F.col(a).cast(self.kind)) & upper).withColumnRenamed("_day", name)

    def _period(self, kind: str, last: bool) -> list[tuple]:
        out: dict[int, object] = {}
        for d in self.days:
            y, m = (d.year, d.month) if self.kind == "date" else (int(d[:4]), int(d[4:6]))
            key = {"year": y, "month": 12 * y + m - 1, "quarter": 4 * y + (m - 1) // 3}[kind]
            if last or key not in out:
                out[key] = d
        return sorted(out.items())

    def period(self, df: DataFrame, date: str, kind: str, step: int, name: str) -> DataFrame:
        """The first valid day of the year or month `step` after the date's (the last valid day of the quarter).

        kind: 'year', 'month' or 'quarter'. Missing where the calendar has no day in that period.
        """
        d = F.col(date).cast("date") if self.kind == "date" else F.to_date(F.col(date), "yyyyMMdd")
        key = {"year": F.year(d), "month": F.year(d) * 12 + F.month(d) - 1, "quarter": F.year(d) * 4 + F.quarter(d) - 1}[kind]
        grid = self._frame(self._period(kind, kind == "quarter"), f"_key int, _day {self.kind}")
        return df.join(grid, key + F.lit(step) == F.col("_key"), "left").withColumn(name, F.col("_day")).drop("_key", "_day")

    def next_year(self, df, date, name="next_year"):
        return self.period(df, date, "year", 1, name)

    def previous_year(self, df, date, name="previous_year"):
        return self.period(df, date, "year", -1, name)

    def next_month(self, df, date, name="next_month"):
        return self.period(df, date, "month", 1, name)

    def previous_month(self, df, date, name="previous_month"):
        return self.period(df, date, "month", -1, name)

    def next_quarter(self, df, date, name="next_quarter"):
        return self.period(df, date, "quarter", 1, name)

    def previous_quarter(self, df, date, name="previous_quarter"):
        return self.period(df, date, "quarter", -1, name)
