"""Coercion, text and numeric expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = ("", "nan", "nat", "none", "null", "na", "<na>")

#: Cut-offs by p-value, smallest first: three legends in use.
STARS = {
    "three": ((0.001, "***"), (0.01, "**"), (0.05, "*")),
    "dagger": ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, "†")),
    "loose": ((0.01, "***"), (0.05, "**"), (0.1, "*")),
}


def missing_to_null(c: Column) -> Column:
    s = F.trim(c.cast("string"))
    return F.when(~F.lower(s).isin(*MISSING), s)


def to_bool(c: Column) -> Column:
    """true for "true" and "1" in any case, false for all else, NULL too."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1"), F.lit(False))


def number(c: Column) -> Column:
    return missing_to_null(c).try_cast("double")


def equals_loosely(c: Column, value: str) -> Column:
    """Equal as numbers where both are, else as text in any case."""
    as_number = c.cast("string").try_cast("double") == F.lit(value).try_cast("double")
    return F.coalesce(as_number, F.lower(F.trim(c.cast("string"))) == value.strip().lower())


def author_name(author: Column) -> Column:
    """The name of ``Name <email>``."""
    return F.split_part(author, F.lit(" <"), F.lit(1))


def author_email(author: Column) -> Column:
    e = F.regexp_extract(author, r"<([^>]+)>", 1)
    return F.when(e != "", e)


def author_keys(author: Column) -> Column:
    """Distinct lower-case keys to meet a login by: the mail's local part, the name without blanks, its first word."""
    name = F.lower(F.trim(author_name(author)))
    local = F.split_part(F.lower(author_email(author)), F.lit("@"), F.lit(1))
    keys = F.array(local, F.regexp_replace(name, r"\s+", ""), F.split_part(name, F.lit(" "), F.lit(1)))
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull() & (k != "")))


def is_tool_path(path: Column, names: Sequence[str] = (".cursorrules", ".cursorignore"), folder: str = ".cursor") -> Column:
    parts = F.split(path, "/")
    return F.element_at(parts, -1).isin(*names) | F.array_contains(parts, folder)


def humanise(c: Column) -> Column:
    return F.initcap(F.regexp_replace(c, "_", " "))


def trailing_integer(c: Column) -> Column:
    """The signed number at the end of a label; typographic minus signs count."""
    plain = F.regexp_replace(c.cast("string"), "[−–—]", "-")
    found = F.regexp_extract(plain, r"-?[0-9]+$", 0)
    return F.when(found != "", found).try_cast("int")


def log1p_guarded(c: Column) -> Column:
    return F.when(c >= 0, F.log1p(c))


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def percent(log_points: Column) -> Column:
    return F.expm1(log_points) * 100


def per_kloc(c: Column, ncloc: Column) -> Column:
    return F.when(ncloc > 0, c / ncloc * 1000)


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(0.0))


def clip(c: Column, low=None, high=None) -> Column:
    """Within the limits; NULL stays."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def any_null(*cs: Column) -> Column:
    out = F.lit(False)
    for c in cs:
        out = out | c.isNull()
    return out


def all_null(*cs: Column) -> Column:
    return F.coalesce(*cs).isNull()


def excludes_zero(low: Column, high: Column) -> Column:
    return F.coalesce((low > 0) | (high < 0), F.lit(False))


def stars(p: Column, legend: str = "three") -> Column:
    out = F.lit("")
    for cut, mark in reversed(STARS[legend]):
        out = F.when(p < cut, F.lit(mark)).otherwise(out)
    return F.when(p.isNull(), F.lit("")).otherwise(out)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p-value of a standard normal statistic. Result tables have a few rows only."""
    from math import erfc, sqrt

    return z.map(lambda x: None if pd.isna(x) else erfc(abs(x) / sqrt(2)))


def packed_map(c: Column) -> Column:
    """The map of ``k: v; k: v``."""
    return F.transform_values(F.str_to_map(c, F.lit("; "), F.lit(": ")), lambda k, v: v.try_cast("long"))


def largest_key(m: Column) -> Column:
    """The key of the largest value, the first of equals by name."""
    best = F.array_max(F.transform(F.map_entries(m), lambda e: e["value"]))
    return F.array_min(F.map_keys(F.map_filter(m, lambda k, v: v == best)))


def json_keys(c: Column) -> Column:
    return F.map_keys(F.from_json(c, "map<string,string>"))


def hash_text(c: Column, seed: int = 0) -> Column:
    """A seeded hash that any engine has: the MD5 of the seed and the value as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(c.cast("string"), F.lit(""))))


def hash_bucket(c: Column, n: int, seed: int = 0) -> Column:
    return F.conv(F.substring(hash_text(c, seed), 1, 8), 16, 10).cast("long") % n


def prefix(c: Column, n: int = 7) -> Column:
    """The first characters of a value as text, NULL for missing ones."""
    return missing_to_null(F.substring(F.trim(c.cast("string")), 1, n))


def bytes_text(c: Column) -> Column:
    """Bytes in the largest fitting unit up to GB, two digits."""
    out = F.concat(c.cast("long").cast("string"), F.lit(" bytes"))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = F.when(c >= 1024**k, F.concat(F.format_string("%.2f", c / float(1024**k)), F.lit(f" {unit}"))).otherwise(out)
    return out
