"""String formatting and parsing as column functions; small parsers of argument lists run on the driver."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import col

_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def slugify(s, lower: bool = True) -> Column:
    """Accents off (Latin), lower case, runs of anything but letters and digits as '-'."""
    plain = F.translate(col(s), _ACCENTED, _PLAIN)
    return F.regexp_replace(F.lower(plain) if lower else plain, r"[\W_]+", "-")


def slugify_any(s, lower: bool = True) -> Column:
    """As slugify for any script that Unicode decomposes, in Arrow batches."""
    @F.pandas_udf("string")
    def apply(values: pd.Series) -> pd.Series:
        import unicodedata

        plain = values.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())
        plain = plain.str.lower() if lower else plain
        return plain.str.replace(r"[\W_]+", "-", regex=True)

    return apply(col(s))


_FORMAT = re.compile(r"%[-+ #0]*(\d+)?(?:\.(\d+))?[a-zA-Z]")


def fmt_length(fmt: str) -> int | None:
    """Width that a printf format implies, literals around it included; None without one."""
    m = _FORMAT.search(fmt)
    if not m or m[1] is None:
        return None
    return int(m[1]) + len(fmt) - (m.end() - m.start())


def fmt(s, format: str, align: str = "right") -> Column:
    """Padded to the format's width; longer strings stay whole."""
    width = fmt_length(format)
    c = col(s).cast("string")
    if width is None:
        return c
    pad = F.lpad if align == "right" else F.rpad
    return F.when(F.length(c) >= width, c).otherwise(pad(c, width, " "))


def fmt_list(x, format: str = "%s", separator: str = " ") -> Column:
    return F.array_join(F.transform(col(x), lambda v: F.format_string(format, v)), separator)


def fmt_matrix(matrix, format: str = "%8.3f", labels: list[str] | None = None) -> str:
    rows = [" ".join(format % v for v in row) for row in matrix]
    if labels:
        width = max(map(len, labels))
        rows = [f"{name:<{width}} {row}" for name, row in zip(labels, rows)]
    return "\n".join(rows)


def infer_type(s) -> Column:
    """'int', 'float' or 'str'."""
    c = F.trim(col(s))
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), F.lit("int")).when(c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") | F.lower(c).rlike(r"^[+-]?(nan|inf|infinity)$"), F.lit("float")).otherwise(F.lit("str"))


def convert_type(s) -> Column:
    """Typed slots: kind and one of i (long), f (double), b (boolean), s (string)."""
    c = col(s)
    kind = F.when(c == "None", F.lit("none")).when(c.isin("True", "False"), F.lit("bool")).otherwise(infer_type(c))
    return F.struct(kind.alias("kind"), F.when(kind == "int", c.try_cast("long")).alias("i"), F.when(kind == "float", c.try_cast("double")).alias("f"), F.when(kind == "bool", c == "True").alias("b"), F.when(kind == "str", c).alias("s"))


def convert(value: str):
    """The Python value of a word: int, float, True, False, None or itself."""
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            pass
    return {"True": True, "False": False, "None": None}.get(value, value)


def _read(value: str, preserve_commas: bool):
    """A typed value, or a list of them where commas part it."""
    return [convert(x) for x in value.split(",")] if "," in value and not preserve_commas else convert(value)


def args2dict(args: list[str] | str, preserve_commas: bool = False) -> dict:
    """['k=v', 'k=a,b', 'a=k=v'] -> typed values, lists and nested dicts."""
    out: dict = {}
    for arg in [args] if isinstance(args, str) else args:
        key, _, rest = arg.partition("=")
        inner, nested, value = rest.partition("=")
        if nested:
            out.setdefault(key, {})[inner] = _read(value, preserve_commas)
        else:
            out[key] = _read(rest, preserve_commas)
    return out


def args2listdict(args: list[str] | str, preserve_commas: bool = False) -> tuple[list, dict]:
    """Words without '=' as a list, typed like the values of the others."""
    args = [args] if isinstance(args, str) else args
    return [_read(a, preserve_commas) for a in args if "=" not in a], args2dict([a for a in args if "=" in a], preserve_commas)


def lines2dict(lines: list[str]):
    """The joined lines as a literal (JSON, or a Python literal); nothing is ever evaluated."""
    import ast

    text = "".join(lines)
    try:
        return json.loads(text)
    except ValueError:
        return ast.literal_eval(text)


def key_values(s, pair: str = " ", assign: str = "=") -> Column:
    return F.str_to_map(col(s), F.lit(pair), F.lit(assign))


def abbrev(s, length: int, pfx: int | None = None, sfx: int | None = None, spanner: str = "...") -> Column:
    """Middle ellipsis; without a prefix length a third of what remains goes before it."""
    room = length - len(spanner)
    if pfx is None and sfx is None:
        pfx = room // 3
        sfx = room - pfx
    elif pfx is None:
        pfx = room - sfx
    elif sfx is None:
        sfx = room - pfx
    c = col(s)
    tail = F.substring(c, F.length(c) - F.lit(sfx - 1), F.lit(sfx)) if sfx > 0 else F.lit("")
    return F.when(F.length(c) <= length, c).otherwise(F.concat(F.substring(c, 1, pfx), F.lit(spanner), tail))


def replace_ext(name, ext: str) -> Column:
    """Text after the last dot replaced; appended where there is no dot."""
    c, ext = col(name), ext.lstrip(".")
    return F.when(F.instr(c, ".") > 0, F.regexp_replace(c, r"\.[^.]*$", f".{ext}")).otherwise(F.concat(c, F.lit(f".{ext}")))


def url_basename(url, default: str = "index") -> Column:
    base = F.regexp_extract(F.coalesce(F.regexp_extract(col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), r"([^/]*)$", 1)
    return F.when(base == "", F.lit(default)).otherwise(base)
