"""Missing values. Inside the engine a missing number is NULL; NaN becomes NULL at every operator's boundary.

Without that, Spark would count NaN, take it as the largest value, and put it into the top bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(x: str | Column) -> Column:
    """Double, NULL where missing."""
    return F.nanvl(col(x).cast("double"), F.lit(None).cast("double"))


def export_nan(x: str | Column) -> Column:
    """NULL back to NaN, for sinks that have no NULL."""
    return F.coalesce(col(x).cast("double"), F.lit(float("nan")))


def valid(x: str | Column, w: str | Column | None = None) -> Column:
    """Value known, weight known and positive."""
    ok = known(x).isNotNull()
    return ok if w is None else ok & F.coalesce(known(w) > 0, F.lit(False))


def is_nan_or_zero(x: str | Column) -> Column:
    return F.coalesce(known(x) == 0, F.lit(True))


def nan_mask(df: DataFrame, fields: list[str] | None = None, overlay: Column | None = None) -> DataFrame:
    """All (or the named) double and float columns with NaN, and what `overlay` covers, as NULL."""
    chosen = [f for f, t in df.dtypes if t in ("double", "float") and (fields is None or f in fields)]
    keep = F.lit(True) if overlay is None else ~F.coalesce(overlay, F.lit(False))
    return df.withColumns({f: F.when(keep, known(f)) for f in chosen})


def signed(x: str | Column, w: str | Column) -> tuple[Column, Column]:
    """Negative weights: the sign goes to the value, the magnitude stays the weight."""
    return known(x) * F.signum(known(w)), F.abs(known(w))
